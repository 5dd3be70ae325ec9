"""Ordered patterns of steps that many sessions share, gaps allowed, with the number of sessions that contain each.

Prefix-projected growth. The steps are kept once as item codes per stretch of a session (steps.py), each stretch followed by a copy of
the few steps that a pattern begun in it can still reach; so every occurrence lies in one row. The projection of a frequent item is a table of suffixes: what can follow each of its occurrences. Growing reads a
projection, extends its prefix by each of the suffix's next `gap` steps, counts the sessions that hold the extended prefix, and keeps the projection of those that are frequent, shorter by the steps passed; so each level grows from
the one before, never from the sessions. A projection is spread over the workers by prefix, and by session within it, since one prefix may have a third of all rows: all suffixes of a prefix and session lie together, so every session counts once.

Only frequent items, prefixes and patterns come to the driver. There are few by definition: at most 1/min_share times as many as one session holds on
average, whatever the number of sessions.

Defined results: rows with a null session, position or tool are left out, a null argument is "(none)", rows with the same session, position and step id count once, different steps
at one position follow each other by step id. Other columns are ignored; an empty table gives no patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.steps import in_order, stretches
from marklake.sources.shared import dropped, written

_LISTS = pa.schema([("sess", pa.string()), ("stretch", pa.int64()), ("items", pa.list_(pa.int64()))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per stretch with its items in order."""
    sess, stretch, parts = None, None, []
    for batch, new, goes_on in in_order(batches):
        items = batch.column("item").to_numpy()
        at = np.flatnonzero(new)
        if goes_on:
            parts.append(items[: at[0] if len(at) else len(items)])
        if not len(at):
            continue
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sess], pa.string()), pa.array([stretch]), pa.array([np.concatenate(parts)], pa.list_(pa.int64()))], schema=_LISTS)
        if len(at) > 1:
            offsets = pa.array(at - at[0], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(items[at[0] : at[-1]]))
            heads = pa.array(at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("sess").take(heads), batch.column("stretch").take(heads), lists], schema=_LISTS)
        sess, stretch, parts = batch.column("sess")[int(at[-1])].as_py(), int(batch.column("stretch")[int(at[-1])].as_py()), [items[at[-1] :]]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([sess], pa.string()), pa.array([stretch]), pa.array([np.concatenate(parts)], pa.list_(pa.int64()))], schema=_LISTS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, row, own) of stretches with what follows them: own ones and then those of `after`, row by row."""
    lists, after = batch.column("items"), batch.column("after")
    n_own, n_after = np.diff(lists.offsets.to_numpy()), np.diff(after.offsets.to_numpy())
    row = np.concatenate([np.repeat(np.arange(len(n_own)), n_own), np.repeat(np.arange(len(n_after)), n_after)])
    order = np.argsort(row, kind="stable")
    items = np.concatenate([lists.flatten().to_numpy(), after.flatten().to_numpy()])
    return items[order], row[order], (np.arange(len(row)) < int(n_own.sum()))[order]


def _item_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, owner, n): sessions of one stretch are counted where they lie, of others the pairs of item and session go on."""
    for batch in batches:
        items, row, own = _flat(batch)
        codes, back = np.unique(items[own], return_inverse=True)
        pairs = np.unique(row[own] * max(len(codes), 1) + back)
        of, code = pairs // max(len(codes), 1), codes[pairs % max(len(codes), 1)]
        several = batch.column("several").to_numpy(zero_copy_only=False)[of] if len(of) else np.zeros(0, dtype=bool)
        alone, n = np.unique(code[~several], return_counts=True)
        owner = batch.column("owner").to_numpy()[of[several]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([alone, code[several]]).astype(np.int64)), pa.concat_arrays([pa.nulls(len(alone), pa.int64()), pa.array(owner, pa.int64())]), pa.array(np.concatenate([n, np.ones(len(owner))]).astype(np.int64))], ["code", "owner", "n"]
        )


_PROJECTION = "prefix int, owner long, suffix array<int>"


def _suffixes(prefix: np.ndarray, owner: np.ndarray, suffix: np.ndarray) -> pa.RecordBatch:
    """Projection rows, equal ones once; of a suffix only what comes before its last known item, as the rest cannot be reached."""
    if len(prefix):
        keys = np.concatenate([prefix[:, None].astype(np.int64), owner[:, None], suffix.astype(np.int64)], 1)
        keys = np.ascontiguousarray(keys).view([("", keys.dtype)] * keys.shape[1]).ravel()
        _, once = np.unique(keys, return_index=True)
        prefix, owner, suffix = prefix[once], owner[once], suffix[once]
    offsets = np.arange(len(prefix) + 1, dtype=np.int32) * suffix.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(suffix.ravel().astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(prefix.astype(np.int32)), pa.array(owner.astype(np.int64)), lists], ["prefix", "owner", "suffix"])


def _first(frequent: np.ndarray, reach: int):
    """The projection of every frequent item: its occurrences' next `reach` steps as numbers of frequent items, -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                items, row, own = _flat(batch)
                at = np.searchsorted(frequent, items)
                at[at == len(frequent)] = 0
                number = np.where(frequent[at] == items, at, -1)
                start = np.flatnonzero((number >= 0) & own)
                to = start[:, None] + np.arange(1, reach + 1)
                inside = to < len(items)
                to = np.where(inside, to, 0)
                suffix = np.where(inside & (row[to] == row[start][:, None]), number[to], -1)
                some = (suffix >= 0).any(1)
                yield _suffixes(number[start[some]], batch.column("owner").to_numpy()[row[start[some]]], suffix[some])

    return run


def _extensions(batch: pa.RecordBatch, members: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, step, item) of every extension by a new item within the gap, and the batch's prefixes and suffixes."""
    prefix = batch.column("prefix").to_numpy()
    suffix = batch.column("suffix").flatten().to_numpy().reshape(len(prefix), -1)
    near = suffix[:, :gap]
    fresh = (near >= 0) & ~(near[:, :, None] == members[prefix][:, None, :]).any(2)
    row, step = np.nonzero(fresh)
    return row, step, near[row, step], prefix, suffix


def _counted(members: np.ndarray, n_items: int, gap: int):
    """(code, n): in how many sessions each extended prefix is found; code: prefix number * number of items + item. The rows of a prefix and session follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        seen: np.ndarray = np.zeros(0, dtype=np.int64)
        for batch in batches:
            row, _, item, prefix, _ = _extensions(batch, members, gap)
            if not len(prefix):
                continue
            owner = batch.column("owner").to_numpy()
            group = np.concatenate([[0], np.cumsum((prefix[1:] != prefix[:-1]) | (owner[1:] != owner[:-1]))])
            found = np.unique(group[row] * np.int64(n_items) + item)
            of, item = found // n_items, found % n_items
            if last == (int(prefix[0]), int(owner[0])):  # the last batch ended inside this session
                again = (of == 0) & np.isin(item, seen)
                carried = np.union1d(seen, item[of == 0])
                of, item = of[~again], item[~again]
            else:
                carried = item[of == 0]
            seen = carried if group[-1] == 0 else item[of == group[-1]]
            last = int(prefix[-1]), int(owner[-1])
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            codes, n = np.unique(prefix[begin][of].astype(np.int64) * n_items + item, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    return run


def _projected(members: np.ndarray, n_items: int, gap: int, level: np.ndarray, reach: int):
    """The projection of the frequent extended prefixes (sorted codes `level`): what is left of the suffixes, `reach` steps at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, step, item, prefix, suffix = _extensions(batch, members, gap)
            code = prefix[row].astype(np.int64) * n_items + item
            at = np.searchsorted(level, code)
            at[at == len(level)] = 0
            ok = np.flatnonzero(level[at] == code)
            row, step, at = row[ok], step[ok], at[ok]
            to = step[:, None] + np.arange(1, reach + 1)
            rest = np.where(to < suffix.shape[1], suffix[row[:, None], np.minimum(to, suffix.shape[1] - 1)], -1)
            some = (rest >= 0).any(1)
            yield _suffixes(at[some], batch.column("owner").to_numpy()[row[some]], rest[some])

    return run


def _spread(projection: DataFrame, salts: int = 64) -> DataFrame:
    """Rows of a prefix and session together, a prefix over `salts` parts."""
    return projection.repartition("prefix", F.pmod(F.xxhash64("owner"), F.lit(salts))).sortWithinPartitions("prefix", "owner")


def frequent_patterns(
    df: DataFrame, sess: str = "sess", pos: str = "pos", step: str = "step_id", tool: str = "tool", arg: str = "arg", longest: int = 4, gap: int = 4, min_sessions: int = 4, min_share: float = 1 / 40, width: int = 512
) -> DataFrame:
    """(pattern, length, sessions): patterns of 2 to `longest` different items that at least `min_sessions` sessions and a share of `min_share` of them contain."""
    spark = df.sparkSession
    item = F.concat(F.col(tool), F.lit(":"), F.coalesce(F.col(arg), F.lit("(none)")))
    cut = stretches(df, sess, pos, step, tool, width, {"item": F.xxhash64(item)})
    reach = gap * (longest - 1)
    lists = written(cut.mapInArrow(_rows, "sess string, stretch long, items array<long>").withColumn("row", F.monotonically_increasing_id()), "steps")
    w = Window.partitionBy("sess").orderBy("stretch")
    session = Window.partitionBy("sess")
    heads = lists.select("sess", "stretch", "row", F.slice("items", 1, reach).alias("head")).select(
        "sess", "stretch", F.slice(F.flatten(F.collect_list("head").over(w.rowsBetween(1, reach))), 1, reach).alias("after"), F.count(F.lit(1)).over(session).alias("parts"), F.min("row").over(session).alias("session")
    )
    joined = lists.join(heads.where("parts > 1"), ["sess", "stretch"], "left")
    rows = written(joined.select(F.coalesce("session", "row").alias("owner"), F.col("parts").isNotNull().alias("several"), "items", F.coalesce("after", F.array().cast("array<bigint>")).alias("after")), "reaching")
    sessions = rows.where(~F.col("several")).count() + rows.where("several").select("owner").distinct().count()
    least = max(min_sessions, int(np.ceil(round(sessions * min_share, 9))))
    counts = rows.mapInArrow(_item_counts, "code long, owner long, n long").groupBy("code", "owner").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("code").agg(F.sum(F.when(F.col("owner").isNull(), F.col("n")).otherwise(1)).alias("n"))
    frequent = sorted(r.code for r in counts.where(F.col("n") >= least).collect())
    found: list[tuple[str, int, int]] = []
    tables = [lists, rows]
    if frequent:
        hashed = df.where(F.col(tool).isNotNull()).select(item.alias("item")).withColumn("code", F.xxhash64("item"))
        names = {r.code: r for r in hashed.where(F.col("code").isin(frequent)).groupBy("code").agg(F.min("item").alias("a"), F.max("item").alias("b")).collect()}
        if any(r.a != r.b for r in names.values()):
            raise ValueError("two items share a 64-bit hash")
        n_items, prefixes = len(frequent), [(k,) for k in range(len(frequent))]
        projection = rows.mapInArrow(_first(np.array(frequent, dtype=np.int64), reach), _PROJECTION)
        for length in range(2, longest + 1):
            members = np.array(prefixes)
            projection = written(projection, f"projection-{length}")
            tables.append(projection)
            support = _spread(projection).mapInArrow(_counted(members, n_items, gap), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
            level = sorted(support.where(F.col("n") >= least).collect(), key=lambda r: r.code)
            prefixes = [(*prefixes[r.code // n_items], r.code % n_items) for r in level]
            found += [(" > ".join(names[frequent[k]].a for k in p), length, r.n) for p, r in zip(prefixes, level)]
            if not level or length == longest:
                break
            projection = projection.mapInArrow(_projected(members, n_items, gap, np.array([r.code for r in level], dtype=np.int64), gap * (longest - length)), _PROJECTION)
    for t in tables:
        dropped(t)
    return spark.createDataFrame(found, "pattern string, length int, sessions long")
