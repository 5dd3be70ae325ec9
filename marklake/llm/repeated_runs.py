"""Runs of the same step, several times in a row, as one step with its count and duration.

Each step becomes a canonical event and each canonical event a Unicode character. The characters of a stretch of a session form
a string, the regular expression (.)\\1* with a backreference finds the maximal runs, and their spans are mapped back to positions and times.
Sessions are cut into stretches of positions (see steps.py), so that a session may hold any share of the rows; only the first
and the last run of each stretch are compared across stretches.

Defined results: rows with a null session, position or tool are left out, a null or empty argument equals "(none)", rows with the same session, position and
step id count once, different steps at one position follow each other by step id, a null time doesn't count for the duration, and a run without any time has a
null duration. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.steps import in_order, stretches

_AGAIN = re.compile(r"(?:\s*(?:#\s*\d+|[(\[{]\s*(?:re-?(?:try|tried|run|peat)|attempt|try|again|take)[\s:#=_-]*(?:no\.?\s*)?\d*\s*(?:/\s*\d+|of\s+\d+)?\s*[)\]}]|[(\[{]\s*\d+(?:st|nd|rd|th)\s+(?:attempt|try)\s*[)\]}]))+$")
_QUOTES = "\"'`“”‘’«»"


def canonical_tool(tool: str) -> str:
    return " ".join(tool.split()).casefold()


def canonical_target(arg: str | None) -> str:
    """The target without differences of spelling (case, white space, quotes, ./) and without marks of a further attempt."""
    text, before = " ".join((arg or "").split()).casefold(), None
    while text != before:
        before = text
        text = _AGAIN.sub("", text).strip()
        if len(text) > 1 and text[0] in _QUOTES and text[-1] in _QUOTES:
            text = text[1:-1].strip()
        while text.startswith("./"):
            text = text[2:].lstrip("/")
    return text or "(none)"


_RUN = re.compile(r"([^\0])\1*", re.DOTALL)
_SCHEMA = pa.schema([("sess", pa.string()), ("stretch", pa.int64()), ("event", pa.string()), ("first_pos", pa.int64()), ("last_pos", pa.int64()), ("n", pa.int64()), ("from_us", pa.int64()), ("to_us", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_())])
_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def symbols(codes: np.ndarray, new: np.ndarray) -> tuple[str, np.ndarray]:
    """A character for each event and a zero before each stretch; the row of each character."""
    points = codes + 1
    points = np.where(points >= 0xD800, points + 0x800, points).astype("<u4")  # surrogates are no characters
    at = np.arange(len(codes)) + np.cumsum(new)
    out = np.zeros(len(codes) + int(new.sum()), dtype="<u4")
    out[at] = points
    row = np.full(len(out), -1)
    row[at] = np.arange(len(codes))
    return out.tobytes().decode("utf-32-le"), row


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tools: dict[str, str] = {}
    args: dict[str | None, str] = {}
    held: dict | None = None
    for batch, new, goes_on in in_order(batches):
        if len(args) > 200_000:
            args.clear()
        coded = [pc.dictionary_encode(batch.column(c), null_encoding="encode") for c in ("tool", "arg")]
        names = [[memo[x] if x in memo else memo.setdefault(x, f(x)) for x in d.dictionary.to_pylist()] for d, memo, f in ((coded[0], tools, canonical_tool), (coded[1], args, canonical_target))]
        ids = [{v: k for k, v in enumerate(dict.fromkeys(n))} for n in names]
        t, a = (np.array([ids[k][v] for v in names[k]])[coded[k].indices.to_numpy()] for k in (0, 1))
        _, first_at, codes = np.unique(t * len(ids[1]) + a, return_index=True, return_inverse=True)
        text, row = symbols(codes, new)
        spans = np.array([m.span() for m in _RUN.finditer(text)])
        begin, end = row[spans[:, 0]], row[spans[:, 1] - 1] + 1
        us = batch.column("us")
        known = us.is_valid().to_numpy(zero_copy_only=False)
        us = us.fill_null(0).to_numpy()
        low, high = np.minimum.reduceat(np.where(known, us, _MAX), begin), np.maximum.reduceat(np.where(known, us, _MIN), begin)
        pos, sess, stretch = batch.column("pos").to_numpy(), batch.column("sess"), batch.column("stretch").to_numpy()
        tool_names, arg_names = list(ids[0]), list(ids[1])
        event = [f"{tool_names[t[first_at[c]]]}:{arg_names[a[first_at[c]]]}" for c in range(len(first_at))]
        n, first_pos, last_pos, opens = end - begin, pos[begin].copy(), pos[end - 1], new[begin].copy()
        closes = np.append(new[begin[1:]], False)
        skip = 0
        if held:
            if goes_on and held["event"] == event[codes[begin[0]]]:
                n[0] += held["n"]
                first_pos[0], low[0], high[0], opens[0] = held["first_pos"], min(low[0], held["from_us"]), max(high[0], held["to_us"]), held["opens"]
            else:
                yield _row(held | {"closes": not goes_on})
        last = len(begin) - 1
        held = {"sess": sess[int(begin[last])].as_py(), "stretch": int(stretch[begin[last]]), "event": event[codes[begin[last]]], "first_pos": int(first_pos[last]), "last_pos": int(last_pos[last]), "n": int(n[last]), "from_us": int(low[last]), "to_us": int(high[last]), "opens": bool(opens[last])}
        keep = np.flatnonzero(((n > 1) | opens | closes)[skip:last])
        if len(keep):
            rows = begin[keep]
            yield pa.RecordBatch.from_arrays(
                [sess.take(pa.array(rows)), pa.array(stretch[rows]), pa.array([event[c] for c in codes[rows]], pa.string()), pa.array(first_pos[keep]), pa.array(last_pos[keep]), pa.array(n[keep]), pa.array(low[keep]), pa.array(high[keep]), pa.array(opens[keep]), pa.array(closes[keep])],
                schema=_SCHEMA,
            )
    if held:
        yield _row(held | {"closes": True})


def _row(run: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([run], schema=_SCHEMA)


def repeated_runs(df: DataFrame, sess: str = "sess", pos: str = "pos", step: str = "step_id", tool: str = "tool", arg: str = "arg", ts: str = "ts", width: int = 4096, least: int = 2) -> DataFrame:
    """(sess, first_pos, last_pos, event, n, started_at, duration_s), a row per maximal run of at least `least` equal steps."""
    cut = stretches(df, sess, pos, step, tool, width, {"tool": F.col(tool), "arg": F.col(arg), "us": F.unix_micros(F.col(ts).cast("timestamp"))})
    runs = cut.mapInArrow(_runs, "sess string, stretch long, event string, first_pos long, last_pos long, n long, from_us long, to_us long, opens boolean, closes boolean")
    edge = F.col("opens") | F.col("closes")
    runs = runs.withColumn("part", F.when(~edge, F.col("stretch"))).withColumn("edge", edge)  # inner runs stay spread, only edges meet
    w = Window.partitionBy("sess", "edge", "part").orderBy("stretch", "first_pos", F.col("closes"))
    before = F.lag(F.struct("event", "closes")).over(w)
    go_on = F.coalesce(F.col("edge") & F.col("opens") & before["closes"] & (before["event"] == F.col("event")), F.lit(False))
    whole = (
        runs.withColumn("go_on", go_on)
        .withColumn("island", F.sum(F.when(F.col("go_on"), 0).otherwise(1)).over(w))
        .groupBy("sess", "edge", "part", "island")
        .agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.first("event").alias("event"), F.sum("n").alias("n"), F.min("from_us").alias("low"), F.max("to_us").alias("high"))
        .where(F.col("n") >= least)
    )
    timed = F.col("high") >= F.col("low")
    return whole.select("sess", "first_pos", "last_pos", "event", "n", F.when(timed, F.timestamp_micros("low")).alias("started_at"), F.when(timed, (F.col("high") - F.col("low")) / 1e6).alias("duration_s"))
