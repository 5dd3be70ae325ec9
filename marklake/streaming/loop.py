"""The tick loop: micro-batches that learn by writing marks and answer reads from them.

A batch writes, is checked, answers its reads and lets old marks fade, in this order. The same step serves a stream (foreachBatch) and the replay of a table,
so both give the same answers. A tick without events (`idle`) only checks and lets fade.

Everything stands in the folder, so a loop that is made anew on it goes on where the last one ended. A tick appends its own marks and then a line to the log that says whether they hold; what a mark weighs follows from its tick, so no
old mark is written again. A tick that is repeated after a failure reads the log before it only and overwrites what it left. Every `compact` ticks the standing marks are put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marklake.operators.similarity import top_k, voted
from marklake.sources.shared import dropped, written

MARKS = "id long, mark array<int>, label string, tick long"


def newest(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The last `cap` rows in an order: a first-in first-out store. The limit is the feature."""
    return df.orderBy(*[c.desc() for c in order]).limit(cap)


class Loop:
    """State and parameters of a loop over events (id, kind, mark, label). once_per_label: only marks of labels that are not yet known are learned."""

    def __init__(self, spark: SparkSession, folder: str, k: int = 7, fade: float = 0.0, cap: int | None = None, check: Callable[[DataFrame], bool] | None = None, on_tick: Callable[[int, DataFrame], None] | None = None, view: str = "numbers", once_per_label: bool = False, compact: int = 32) -> None:
        self.spark, self.folder, self.k, self.fade, self.cap = spark, folder.rstrip("/"), k, fade, cap
        self.check, self.on_tick, self.view, self.once_per_label, self.compact = check, on_tick, view, once_per_label, compact

    def log(self) -> list[tuple[int, bool, str]]:
        """(tick, holds, files) of every tick so far; files named base-N hold all marks up to N."""
        try:
            return sorted((r.tick, r.holds, r.files) for r in self.spark.read.schema("tick long, holds boolean, files string").parquet(f"{self.folder}/log").collect())
        except AnalysisException:
            return []

    def _noted(self, tick: int, holds: bool, files: str) -> None:
        row = self.spark.createDataFrame([(tick, holds, files)], "tick long, holds boolean, files string").coalesce(1)
        row.select("holds", "files", "tick").write.mode("overwrite").parquet(f"{self.folder}/log/t={tick}")

    def _standing(self, log: list[tuple[int, bool, str]]) -> list[str]:
        holding = [files for _, holds, files in log if holds and files]
        base = max((k for k, f in enumerate(holding) if f.startswith("base-")), default=0)
        return [f"{self.folder}/marks/{f}" for f in holding[base:]]

    def marks(self, before: int | None = None, extra: list[str] | None = None, now: int | None = None) -> DataFrame:
        """(id, mark, label, strength, tick) of what stands, after the last tick or before a given one."""
        log = [x for x in self.log() if before is None or x[0] < before]
        files = self._standing(log) + (extra or [])
        rows = self.spark.read.schema(MARKS).parquet(*files) if files else self.spark.createDataFrame([], MARKS)
        now = now if now is not None else max((t for t, _, _ in log), default=0)
        if self.cap:
            rows = newest(rows, [F.col("tick"), F.col("id")], self.cap)  # the newest are the strongest
        return rows.select("id", "mark", "label", F.pow(F.lit(1.0 - self.fade), F.lit(now) - F.col("tick")).alias("strength"), "tick")

    def tick(self, batch: DataFrame, number: int) -> None:
        new = batch.where("kind = 'write' and mark is not null and id is not null and label is not null")
        new = new.select(F.col("id").cast("long").alias("id"), F.col("mark").cast("array<int>").alias("mark"), "label", F.lit(number).cast("long").alias("tick"))
        if self.once_per_label:
            w = Window.partitionBy("label").orderBy("id")
            new = new.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").join(self.marks(number).select("label").distinct(), "label", "left_anti").select("id", "mark", "label", "tick")
        files = f"tick-{number}"
        new.write.mode("overwrite").parquet(f"{self.folder}/marks/{files}")
        marks = self.marks(number, [f"{self.folder}/marks/{files}"], number)
        holds = not self.check or self.check(marks)
        if not holds:
            marks = self.marks(number, now=number)
        reads = batch.where("kind = 'read' and mark is not null and id is not null").select(F.col("id").alias("qid"), "mark")
        if not marks.isEmpty():
            # Reads never meet themselves, as only writes are marks; ids of both may be equal, so marks get negative ones.
            top = top_k(marks.select((-1 - F.col("id")).alias("id"), "mark"), reads, self.k, ties=True, view=self.view)
            answers = voted(top, marks.select((-1 - F.col("id")).alias("id"), "label"))
            answers.write.mode("overwrite").parquet(f"{self.folder}/answers/tick={number}")
        if holds and number % self.compact == self.compact - 1:
            files = f"base-{number}"
            marks.select("id", "mark", "label", "tick").write.mode("overwrite").parquet(f"{self.folder}/marks/{files}")
        self._noted(number, holds, files)
        if self.on_tick:
            self.on_tick(number, batch)

    def idle(self, number: int) -> None:
        """A tick without events."""
        self.tick(self.spark.createDataFrame([], "id long, kind string, mark array<int>, label string"), number)

    def answers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/answers")

    def stream(self, events: DataFrame, checkpoint: str, available_now: bool = True):
        writer = events.writeStream.foreachBatch(self.tick).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 milliseconds")).start()

    def replay(self, events: DataFrame, order: Column, size: int = 256) -> None:
        """The same over a table, in batches of `size` by a number `order` from 0. The table is read once and laid out by batch."""
        placed = written(events.withColumn("batch_", F.floor(order / size).cast("long")).repartition("batch_"), "replay", ("batch_",))
        for r in placed.select("batch_").distinct().orderBy("batch_").toLocalIterator():
            self.tick(placed.where(F.col("batch_") == r["batch_"]).drop("batch_"), int(r["batch_"]))
        dropped(placed)


def tail(spark: SparkSession, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Events from JSON lines as files arrive; broken lines are kept apart in _corrupt_record and can be counted."""
    return spark.readStream.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", per_batch).json(folder)


def first_seen(events: DataFrame, digest: Column, ts: str, late: str = "1 hour") -> DataFrame:
    """Each content once, for a batch or a stream; a stream remembers what is younger than `late`."""
    keyed = events.withColumn("digest", digest)
    if events.isStreaming:
        return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["digest"])
    return keyed.dropDuplicates(["digest"])


def windows(events: DataFrame, ts: str, keys: list[str], size: str, step: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per tumbling or sliding window and key; with `late`, a stream drops what comes later."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size, step) if step else F.window(ts, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """(key, start, end, n) of stretches without a pause of `gap`."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
