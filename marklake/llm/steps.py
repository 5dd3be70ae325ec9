"""Session steps as sorted, bounded stretches, shared by the sequence operators.

A session can hold a third of all rows, so no operator here puts a whole session into one task: the steps of a session are cut into
stretches by `pos div width`, and a stretch is what lies together in a partition, in order. What crosses two stretches is handled by the operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stretches(df: DataFrame, sess: str, pos: str, step: str, tool: str, width: int, values: dict[str, Column]) -> DataFrame:
    """(sess, stretch, pos, step, *values), co-located and sorted by stretch. Rows with a null session, position or tool are left out."""
    kept = df.where(F.col(sess).isNotNull() & F.col(pos).isNotNull() & F.col(tool).isNotNull())
    cut = kept.select(
        F.col(sess).alias("sess"),
        F.floor(F.col(pos) / F.lit(width)).cast("long").alias("stretch"),
        F.col(pos).cast("long").alias("pos"),
        F.coalesce(F.col(step).cast("long"), F.lit(-1)).alias("step"),
        *[c.alias(n) for n, c in values.items()],
    )
    return cut.repartition("sess", "stretch").sortWithinPartitions("sess", "stretch", "pos", "step")


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Batches without re-delivered rows; for each row whether it begins a stretch; whether the first row goes on with the last batch's stretch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = pc.dictionary_encode(batch.column("sess")).indices.to_numpy()
        stretch, pos, step = (batch.column(c).to_numpy() for c in ("stretch", "pos", "step"))
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (codes[1:] != codes[:-1]) | (stretch[1:] != stretch[:-1])
        again = np.zeros(len(codes), dtype=bool)
        again[1:] = ~new[1:] & (pos[1:] == pos[:-1]) & (step[1:] == step[:-1]) & (step[1:] >= 0)
        first = (batch.column("sess")[0].as_py(), int(stretch[0]))
        goes_on = last is not None and last[:2] == first
        again[0] = goes_on and last[2:] == (int(pos[0]), int(step[0])) and step[0] >= 0
        last = (batch.column("sess")[len(codes) - 1].as_py(), int(stretch[-1]), int(pos[-1]), int(step[-1]))
        if again.any():
            keep = ~again
            if not keep.any():
                continue
            if again[0]:  # the stretch goes on with the first row that is kept, if that is of the same stretch
                goes_on = not new[1 : np.argmax(keep) + 1].any()
            batch, new = batch.filter(pa.array(keep)), new[keep]
        new[0] = not goes_on
        yield batch, new, goes_on
