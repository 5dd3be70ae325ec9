"""When a machine should shift: a governor with gears as a finite automaton over its windows.

The governor's state is a gear, how many windows in a row the backlog has grown and how many have been calm; a shift resets the counter that caused it. What a window shows comes down to a few signs, so a
window is a map of states to states, and maps compose. A series is cut into pieces; a piece is run from every possible state at once, the pieces' maps are composed in groups, the groups' maps along the series, and with its true
first state each piece is run again. So no task holds more than a piece, whatever a machine's share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.operators.folds import numbered

PIECE, GROUP = 1024, 1024  # windows in a piece, pieces in a group


def automaton(rows: DataFrame, table: np.ndarray, out: np.ndarray, start: int) -> DataFrame:
    """(key, n, state, out) of every row: the state before it and what it gives. rows: (key, n, sign), n from 0 without holes; table and out: (states, signs) next state and output."""
    states = len(table)
    placed = rows.withColumn("piece", F.floor(F.col("n") / PIECE)).withColumn("grp", F.floor(F.col("n") / (PIECE * GROUP)))

    def through(key: tuple, group: pa.Table) -> pa.Table:
        state = np.arange(states)
        for sign in group.sort_by("n").column("sign").to_numpy():
            state = table[state, sign]
        return pa.table({"key": [key[0].as_py()], "grp": [key[1].as_py()], "piece": [key[2].as_py()], "map": pa.array([state.tolist()], pa.list_(pa.int32()))})

    def composed(key: tuple, group: pa.Table) -> pa.Table:
        group, state, before = group.sort_by("piece"), np.arange(states), []
        for own in group.column("map").to_pylist():
            before.append(state.tolist())
            state = np.array(own)[state]
        return pa.table({"key": group.column("key"), "grp": group.column("grp"), "piece": group.column("piece"), "before": pa.array(before, pa.list_(pa.int32())), "whole": pa.array([state.tolist()] * len(before), pa.list_(pa.int32()))})

    kind = rows.schema["key"].dataType.simpleString()
    maps = placed.groupBy("key", "grp", "piece").applyInArrow(through, f"key {kind}, grp long, piece long, map array<int>")
    maps = maps.groupBy("key", "grp").applyInArrow(composed, f"key {kind}, grp long, piece long, before array<int>, whole array<int>")
    # Along the groups of a key, of which each stands for a million windows.
    wholes = F.collect_list("whole").over(Window.partitionBy("key").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    groups = maps.select("key", "grp", "whole").distinct().withColumn("first", F.aggregate(wholes, F.lit(start), lambda s, m: F.element_at(m, s + 1))).select("key", "grp", "first")
    entries = maps.join(groups, ["key", "grp"]).select("key", "piece", F.element_at("before", F.col("first") + 1).alias("entry"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group, now = group.sort_by("n"), []
        state = group.column("entry")[0].as_py()
        signs = group.column("sign").to_numpy()
        for sign in signs:
            now.append(state)
            state = int(table[state, sign])
        given = out[np.array(now), signs]
        return pa.table({"key": group.column("key"), "n": group.column("n"), "state": pa.array(now, pa.int32()), "out": pa.array(given.astype(np.int32))})

    return placed.drop("grp").join(entries, ["key", "piece"]).groupBy("key", "piece").applyInArrow(run, f"key {kind}, n long, state int, out int")


@dataclass(frozen=True)
class Governor:
    """gears: how many; batch_gear: the one that serves batches only, where single requests wait (None for none); a shift up after `growing` windows of growing backlog, down after `calm` ones without."""

    gears: int = 4
    batch_gear: int | None = 3
    start: int = 1
    growing: int = 2
    calm: int = 4

    def index(self, gear: int, grown: int, quiet: int) -> int:
        return (gear * (self.growing + 1) + grown) * (self.calm + 1) + quiet

    def gear(self, state: Column) -> Column:
        return F.floor(state / ((self.growing + 1) * (self.calm + 1))).cast("int")

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Signs: 1 backlog grows, 2 load locks, 4 calm, 8 a single request waits, 16 heat begins, 32 heat goes on."""
        size = self.gears * (self.growing + 1) * (self.calm + 1)
        table, out = np.zeros((size, 64), dtype=np.int64), np.zeros((size, 64), dtype=np.int64)
        for gear in range(self.gears):
            for grown in range(self.growing + 1):
                for quiet in range(self.calm + 1):
                    for sign in range(64):
                        at = self.index(gear, grown, quiet)
                        to = self._next(gear, grown, quiet, *(bool(sign >> k & 1) for k in range(6)))
                        table[at, sign], out[at, sign] = self.index(*to), to[0] - gear
        return table, out

    def _next(self, gear: int, grown: int, quiet: int, grows: bool, locked: bool, calm: bool, waits: bool, hot: bool, held: bool) -> tuple[int, int, int]:
        if hot:
            return 0, grown, quiet
        if held:
            return gear, grown, quiet
        if gear == self.batch_gear and waits:
            return gear - 1, 0, 0
        grown, quiet = min(grown + 1, self.growing) if grows else 0, min(quiet + 1, self.calm) if calm else 0
        if (grown >= self.growing or locked) and gear < self.gears - 1:
            into_batch = gear + 1 == self.batch_gear and waits
            return (gear, grown, quiet) if into_batch else (gear + 1, 0, quiet)
        if quiet >= self.calm and gear > 1:
            return gear - 1, grown, 0
        return gear, grown, quiet


def heat(rows: DataFrame, ts: str, temperature: str, cap: float, cooled: float, hold_seconds: float) -> DataFrame:
    """rows (key, n, ...) with `hot`, heat begins, and `held`, it goes on: from a reading at the cap until one below `cooled`, or until `hold_seconds` after the last one at the cap.

    An episode is told from the rows within `hold_seconds` before, so every row finds it in a time range, not in the whole series.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy("key", "span_").orderBy("at_").rangeBetween(-int(hold_seconds * 1_000_000), -1)
    span = F.floor(at / int(max(hold_seconds, 1) * 64 * 1_000_000))  # each span also gets the rows that its first ones look back to
    near = F.floor((at + int(hold_seconds * 1_000_000)) / int(max(hold_seconds, 1) * 64 * 1_000_000))
    spread = rows.withColumn("at_", at).withColumn("own_", span).withColumn("span_", F.explode(F.array_distinct(F.array(span, near))))
    reached = F.coalesce(F.col(temperature) >= cap, F.lit(False))
    last = F.max(F.when(reached, F.col("at_"))).over(w)
    cold = F.max(F.when(F.col(temperature) < cooled, F.col("at_"))).over(w)
    burning = F.coalesce(last.isNotNull() & (cold.isNull() | (cold < last)), F.lit(False))
    out = spread.withColumn("burning", burning).withColumn("hot", reached & ~F.col("burning")).withColumn("held", F.col("burning") & ~F.coalesce(F.col(temperature) < cooled, F.lit(False)))
    return out.where("own_ = span_").drop("at_", "own_", "span_", "burning")


def shifts(df: DataFrame, key: str, cut: Column, order: list[str], backlog: Column, load: Column, high: float = 0.92, low: float = 0.5, waiting: Column | None = None, temperature: Column | None = None, cap: float = 95.0, hold_seconds: float = 10.0, governor: Governor | None = None) -> DataFrame:
    """(key, n, gear, shift) of every window that shifts: up after windows of growing backlog or a high load with a backlog, down after calm ones (no backlog, little load), out of the batch gear where a single request waits, to gear 0 by
    heat (`order` then begins with a time), which holds the gear for a while. A null backlog or load is no growth and no calm. The gear is the one before the shift."""
    governor, none = governor or Governor(), F.lit(False)
    rows = numbered(df, key, cut, order).select(F.col(key).alias("key"), "n", F.col(order[0]).alias("ts_"), backlog.cast("double").alias("backlog"), load.cast("double").alias("load"), (F.coalesce(waiting > 0, none) if waiting is not None else none).alias("waits"), (temperature if temperature is not None else F.lit(None)).cast("double").alias("temp"))
    rows = heat(rows, "ts_", "temp", cap, cap - 5, hold_seconds) if temperature is not None else rows.withColumns({"hot": none, "held": none})
    piece = F.floor(F.col("n") / PIECE)
    edge = rows.where(F.col("n") % PIECE == PIECE - 1).select("key", (piece + 1).alias("piece"), F.col("backlog").alias("edge"))  # the row before a piece
    rows = rows.withColumn("piece", piece).join(edge, ["key", "piece"], "left")
    before = F.coalesce(F.lag("backlog").over(Window.partitionBy("key", "piece").orderBy("n")), F.when(F.col("n") % PIECE == 0, F.col("edge")), F.when(F.col("n") == 0, F.lit(0.0)))
    signs = [F.col("backlog") > before, (F.col("load") >= high) & (F.col("backlog") > 0), (F.col("backlog") == 0) & (F.col("load") < low), F.col("waits"), F.col("hot"), F.col("held")]
    sign = sum(F.coalesce(s, none).cast("int") * 2**k for k, s in enumerate(signs))
    table, out = governor.tables()
    done = automaton(rows.select("key", "n", sign.alias("sign")), table, out, governor.index(governor.start, 0, 0))
    return done.where("out != 0").select("key", "n", governor.gear(F.col("state")).alias("gear"), F.col("out").cast("long").alias("shift"))
