"""Fields that appear, vanish, change their type or are renamed from file to file of a producer.

Column lifespan catalogue. The leaves of each file give its fields with type and value. Per producer and field, lag and islands over the producer's
files give lifespans: where one starts the field was added, in the file after its end it was removed, and inside it a type that differs from the last
known one has changed. An ended and a started lifespan that meet in one file, with one type and a value that goes on, are a renaming. The renamings are the
alias table; following them to the last name and collecting the types met on the way gives the casts, and with these one consistent table of all values.

All windows are over one field of one producer or over the changes of one file, so a producer may hold any share of the rows.

Fields. A list spread over path/0, path/1, ... (numbered without a hole) or path[len] and path[mean] is one field path of type list, path/value with path/unit one
of type object. A number has `num` only, a flag text True or False, a text has text only. A missing value (text None, or neither) has no type
and is no change; the last known type and value go on.

A value goes on if numbers differ by five percent of the old one at most (a list by its mean, an object by value with the same unit; also numbers that lead a text, such as
"~1.02e+03", "0.27 ms" or "248.9 (est.)") and other texts are equal. If several fields could be the other's new name, equal numbers pair first, in the order of their names, then the least differences, again and again until no two fit; equal texts and flags pair in the order of their last names; each
has one partner at most.

Files that have footers (Parquet) are catalogued from these: names and types from the schema, values from the statistics, without reading a row (`footers`, `file_changes`, `read_consistently`).

Defined results: identical rows count once, of differing rows for one path and file the greatest (text, num) holds; rows with a null file or path, files without producer or
time, and values of files that are not registered are left out. Other columns are ignored; empty tables give no changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marklake.sources.shared import written

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_LED = rf"^[~≈<>=\s]*({_NUMBER})\s*(?:[a-zA-Zµ%/°]{{1,8}})?\s*(?:\([^()]*\))?\s*$"


def files_in_order(files: DataFrame) -> DataFrame:
    """(exp, file, seq, last_seq) by time of writing."""
    w = Window.partitionBy("exp").orderBy("written_at", "file")
    known = files.where(F.col("exp").isNotNull() & F.col("file").isNotNull() & F.col("written_at").isNotNull()).groupBy("file").agg(F.min(F.struct("exp", "written_at")).alias("f"))
    known = known.select("file", "f.exp", "f.written_at")
    return known.select("exp", "file", F.row_number().over(w).alias("seq"), F.count(F.lit(1)).over(Window.partitionBy("exp")).alias("last_seq"))


def fields_of(values: DataFrame) -> DataFrame:
    """(file, field, type, num, text): a row per field of a file; type null for a missing value."""
    leaves = values.where(F.col("file").isNotNull() & F.col("path").isNotNull()).groupBy("file", "path").agg(F.max(F.struct("text", "num")).alias("v")).select("file", "path", "v.num", "v.text")
    index = F.regexp_extract("path", r"/(\d{1,9})$", 1)
    part = (
        F.when(index != "", index)
        .when(F.col("path").rlike(r"\[(?:len|mean)\]$"), F.regexp_extract("path", r"\[(len|mean)\]$", 1))
        .when(F.col("path").rlike(r"/(?:value|unit)$"), F.regexp_extract("path", r"/(value|unit)$", 1))
    )
    whole = F.when(F.col("part").isNotNull(), F.regexp_replace("path", r"(?:/\d{1,9}|\[(?:len|mean)\]|/(?:value|unit))$", ""))
    split = leaves.withColumn("part", part).withColumn("whole", F.coalesce(whole, F.col("path")))
    number = F.col("part").try_cast("long")
    own = Window.partitionBy("file", "whole")
    has = lambda name: F.max(F.when(F.col("part") == name, 1).otherwise(0)).over(own) == 1
    listed = F.max(number).over(own) + 1 == F.count(number).over(own)
    kind = F.when(number.isNotNull() & listed, "list").when(F.col("part").isin("len", "mean") & has("len") & has("mean"), "list").when(F.col("part").isin("value", "unit") & has("value") & has("unit"), "object")
    split = split.withColumn("kind", kind).withColumn("field", F.when(F.col("kind").isNotNull(), F.col("whole")).otherwise(F.col("path")))
    num = F.when(~F.isnan("num"), F.col("num"))
    missing = F.coalesce(F.col("text") == "None", num.isNull() & F.col("text").isNull())
    kind = F.coalesce("kind", F.when(missing, None).when(F.col("text").isin("True", "False"), "flag").when(F.col("text").isNull(), "number").otherwise("text"))
    split = split.withColumn("type", kind).withColumn("num", F.coalesce(num, F.when(F.col("type") == "text", F.regexp_extract("text", _LED, 1).try_cast("double"))))
    mean = F.coalesce(F.max(F.when(F.col("part") == "mean", F.col("num"))), F.avg(F.when(F.col("part") != "len", F.col("num"))))
    return split.groupBy("file", "field").agg(
        F.max("type").alias("type"),
        F.when(F.max("type") == "list", mean).when(F.max("type") == "object", F.max(F.when(F.col("part") == "value", F.col("num")))).otherwise(F.max("num")).alias("num"),
        F.when(F.max("type") == "list", None).when(F.max("type") == "object", F.max(F.when(F.col("part") == "unit", F.col("text")))).when(F.max("type").isNull(), None).otherwise(F.max("text")).alias("text"),
    )


def lifespans(values: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue of the files' leaves."""
    return catalogued(fields_of(values), files)


def catalogued(fields: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue: a row per producer, file and field with its lifespan (island) and the last known type and value of the lifespan."""
    found = fields.join(files_in_order(files), "file")
    w = Window.partitionBy("exp", "field").orderBy("seq")
    found = found.withColumn("starts", F.coalesce(F.col("seq") - F.lag("seq").over(w) > 1, F.lit(True))).withColumn("ends", F.coalesce(F.lead("seq").over(w) - F.col("seq") > 1, F.lit(True)))
    found = found.withColumn("island", F.sum(F.col("starts").cast("int")).over(w))
    own = Window.partitionBy("exp", "field", "island").orderBy("seq")
    known = F.when(F.col("type").isNotNull(), F.struct("type", "num", "text"))
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("before", F.last(known, True).over(before)["type"]).withColumn("last", F.last(known, True).over(so_far))


def _sides(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Lifespans that start or end, at the file where that shows: (exp, seq, side, field, island, type, num, text)."""
    started = catalogue.where("starts and seq > 1").select("exp", "seq", F.lit("started").alias("side"), "field", "island", "type", "num", "text")
    ended = catalogue.where("ends and seq < last_seq").select("exp", (F.col("seq") + 1).alias("seq"), F.lit("ended").alias("side"), "field", "island", "last.type", "last.num", "last.text")
    return started.unionByName(ended)


def _goes_by(df: DataFrame) -> DataFrame:
    """df with what must be equal for a value to go on (`same`) and the number that must be near (`near`)."""
    led = (F.col("type") == "text") & F.col("num").isNotNull()
    same = F.when(F.col("type").isin("number", "list") | led, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    near = F.when(F.col("type").isin("number", "list", "object") | led, F.col("num"))
    return df.where("type is not null").withColumn("same", same).withColumn("near", near).where("near is not null or type in ('flag', 'text')")


def _equal(sides: DataFrame) -> DataFrame:
    """Ended and started numbers of one value (exp, seq, old, new), in the order of their names."""
    key = ["exp", "seq", "type", "same", "near"]
    ranked = sides.withColumn("k", F.row_number().over(Window.partitionBy(*key, "side").orderBy("field")))
    old = ranked.where("side = 'ended'").select(*key, "k", F.col("field").alias("old"))
    return old.join(ranked.where("side = 'started'").select(*key, "k", F.col("field").alias("new")), [*key, "k"]).select("exp", "seq", "old", "new")


def _nearest(sides: DataFrame, tolerance: float) -> DataFrame:
    """Ended and started numbers that are each other's nearest of those that fit (exp, seq, old, new), found in sorted order, without pairing all. What fits a number is an interval around it, so the
    next one on either side decides. Of equal numbers of one side the first name stands for all; of equal differences the lesser number counts. If any two fit, there is a pair."""
    group = ["exp", "seq", "type", "same"]
    sides = sides.withColumn("k", F.row_number().over(Window.partitionBy(*group, "near", "side").orderBy("field"))).where("k = 1")
    w = Window.partitionBy(*group).orderBy("near", "side", "field")
    other = F.when(F.col("side") == "started", F.struct("near", "field"))
    mine = F.when(F.col("side") == "ended", F.struct("near", "field"))
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)

    def best(low: Column, high: Column) -> Column:
        def away(other: Column) -> Column:
            was = F.when(F.col("side") == "ended", F.col("near")).otherwise(other["near"])
            by = F.abs(F.col("near") - other["near"])
            return F.when(by <= tolerance * F.abs(was), by)

        a, b = away(low), away(high)
        return F.when(a.isNotNull() & (b.isNull() | (a <= b)), low["field"]).when(b.isNotNull(), high["field"])

    ranked = sides.withColumns({"s_low": F.last(other, True).over(below), "s_high": F.first(other, True).over(above), "e_low": F.last(mine, True).over(below), "e_high": F.first(mine, True).over(above)})
    ended = ranked.where("side = 'ended'").select(*group, F.col("field").alias("old"), best(F.col("s_low"), F.col("s_high")).alias("new"))
    started = ranked.where("side = 'started'").select(*group, F.col("field").alias("new"), best(F.col("e_low"), F.col("e_high")).alias("old"))
    return ended.join(started, [*group, "old", "new"]).select("exp", "seq", "old", "new")


def _without(sides: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.select("exp", "seq", F.col("old").alias("field"), F.lit("ended").alias("side")).unionByName(pairs.select("exp", "seq", F.col("new").alias("field"), F.lit("started").alias("side")))
    return sides.join(used, ["exp", "seq", "field", "side"], "left_anti")


def renamings(sides: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The alias table (exp, seq, old, new)."""
    sides = _goes_by(sides)
    numbers = sides.where("near is not null")
    found = [_equal(numbers)]
    left = written(_without(numbers, found[0]), "drift-left")
    while not (more := written(_nearest(left, tolerance), "drift-nearest")).isEmpty():  # each round pairs the least difference that is left at least
        found.append(more)
        left = written(_without(left, more), "drift-left")
    pairs = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("exp", "seq", "type", "same", "side").orderBy(F.element_at(F.split("field", "/"), -1), "field")
    texts = sides.where("near is null").withColumn("k", F.row_number().over(w))
    key = ["exp", "seq", "type", "same", "k"]
    equal = texts.where("side = 'ended'").select(*key, F.col("field").alias("old")).join(texts.where("side = 'started'").select(*key, F.col("field").alias("new")), key)
    return pairs.unionByName(equal.select("exp", "seq", "old", "new"))


def schema_changes(values: DataFrame, files: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(exp, file, change, path, new_path): every change between a file and the one before it of its producer."""
    return _changes(written(lifespans(values, files), "lifespans"), files, tolerance)


def _changes(catalogue: DataFrame, files: DataFrame, tolerance: float) -> DataFrame:
    sides = written(_sides(catalogue, files), "drift-sides")
    pairs = written(renamings(sides, tolerance), "drift-aliases")
    rest = _without(sides, pairs).select("exp", "seq", F.when(F.col("side") == "started", "added").otherwise("removed").alias("change"), F.col("field").alias("path"), F.lit("").alias("new_path"))
    renamed = pairs.select("exp", "seq", F.lit("renamed").alias("change"), F.col("old").alias("path"), F.col("new").alias("new_path"))
    changed = catalogue.where("type is not null and before is not null and type != before").select("exp", "seq", F.lit("type_changed").alias("change"), F.col("field").alias("path"), F.lit("").alias("new_path"))
    out = rest.unionByName(renamed).unionByName(changed)
    return out.join(files_in_order(files).select("exp", "seq", "file"), ["exp", "seq"]).select("exp", "file", "change", "path", "new_path")


def consistent_values(values: DataFrame, files: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(exp, file, path, name, type, cast, number, text): all values under the last name of their field, with the type that holds for all files of the producer.

    cast: number and flag meeting text become text, any of them meeting a list or an object becomes its number (the mean, the value). number is
    filled where the value has one, text for what is text, flag or a unit.
    """
    catalogue = written(lifespans(values, files), "lifespans")
    sides = written(_sides(catalogue, files), "drift-sides")
    named = last_names(catalogue, renamings(sides, tolerance))
    kinds = named.groupBy("exp", "name").agg(F.collect_set("type").alias("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    cast = F.when(has("text"), F.when(has("list") | has("object"), "number or text").otherwise("text")).when(has("list") | has("object") | has("number"), "number").when(has("flag"), "flag")
    kinds = kinds.select("exp", "name", cast.alias("cast"))
    return named.join(kinds, ["exp", "name"]).select("exp", "file", F.col("field").alias("path"), "name", "type", "cast", F.col("num").alias("number"), F.coalesce("text", F.when((F.col("cast") == "text"), F.col("num").cast("string"))).alias("text"))


def last_names(catalogue: DataFrame, pairs: DataFrame) -> DataFrame:
    """The catalogue with `name`, the last name that the alias table leads to."""
    spans = catalogue.groupBy("exp", "field", "island").agg(F.min("seq").alias("since"), F.max("seq").alias("until"))
    old = spans.select("exp", F.col("field").alias("old"), F.col("island").alias("old_island"), (F.col("until") + 1).alias("seq"))
    new = spans.select("exp", F.col("field").alias("new"), F.col("island").alias("new_island"), F.col("since").alias("seq"))
    links = pairs.join(old, ["exp", "seq", "old"]).join(new, ["exp", "seq", "new"])
    node = lambda side: F.struct(F.col(side).alias("field"), F.col(f"{side}_island").alias("island"))
    to = written(links.select("exp", node("old").alias("node"), node("new").alias("to")), "drift-links")
    while True:  # each round doubles how far every name has been followed
        far = to.select("exp", F.col("node").alias("to"), F.col("to").alias("beyond"))
        step = written(to.join(far, ["exp", "to"], "left").select("exp", "node", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "drift-links")
        to = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    named = catalogue.withColumn("node", F.struct("field", "island")).join(to, ["exp", "node"], "left")
    return named.withColumn("name", F.coalesce("to.field", "field"))


# Files with footers: the catalogue comes from their metadata, no row is read.

_KINDS = (("int", "number"), ("uint", "number"), ("float", "number"), ("double", "number"), ("decimal", "number"), ("halffloat", "number"), ("bool", "flag"), ("list", "list"), ("large_list", "list"), ("struct", "object"), ("map", "object"))


def footers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(fields, files) of all Parquet files below a folder, read from their footers: (file, field, type, num, text, stored) and (exp, file, written_at). exp is the file's folder; stored is the type as stored; num is the middle of a
    number's least and greatest value, text the least text, null where the footer has no statistics. A field of only nulls has no type."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                system, inner = pyarrow.fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as file:
                    meta = pyarrow.parquet.read_metadata(file)
                schema, chunks = meta.schema.to_arrow_schema(), [meta.row_group(g) for g in range(meta.num_row_groups)]
                at = {meta.schema.column(c).path: c for c in range(meta.num_columns)}
                for f in schema:
                    stats = [s for g in chunks if f.name in at and (s := g.column(at[f.name]).statistics) is not None]
                    ends = [(s.min, s.max) for s in stats if s.has_min_max]
                    low, high = (pick(v) for pick, v in zip((min, max), zip(*ends))) if ends else (None, None)
                    numeric = isinstance(low, (int, float)) and not isinstance(low, bool)
                    known = not (stats and len(stats) == len(chunks) and all(s.null_count == g.num_rows for s, g in zip(stats, chunks)))
                    kind = next((k for prefix, k in _KINDS if str(f.type).startswith(prefix)), "text")
                    rows.append((path, f.name, kind if known else None, (low + high) / 2 if numeric else None, low if isinstance(low, str) else None, str(f.type)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.string()) for k, c in enumerate(cols)], ["file", "field", "type", "num", "text", "stored"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "modificationTime")
    fields = listed.select("path").mapInArrow(read, "file string, field string, type string, num double, text string, stored string")
    return fields, listed.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("exp"), F.col("path").alias("file"), F.col("modificationTime").alias("written_at"))


def file_changes(fields: DataFrame, files: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """schema_changes() of files by their footers."""
    return _changes(written(catalogued(fields.drop("stored"), files), "lifespans"), files, tolerance)


def read_consistently(spark: SparkSession, fields: DataFrame, files: DataFrame, exp: str, tolerance: float = 0.05) -> DataFrame:
    """One table of all files of a producer: `file` and every field under its last name. Fields that some file stores as text, or as different things, become text (lists and objects as JSON), different kinds of numbers double.

    Files of one layout are read together; there are as many reads as layouts.
    """
    own = files.where(F.col("exp") == exp)
    catalogue = written(catalogued(fields.join(own.select("file"), "file", "left_semi"), own), "lifespans")
    named = last_names(catalogue, renamings(written(_sides(catalogue, own), "drift-sides"), tolerance))
    named = named.select("file", "field", "name", "type", "stored")
    kinds = named.groupBy("name").agg(F.collect_set("type").alias("types"), F.collect_set("stored").alias("stored")).collect()  # a row per name
    as_text = {r.name for r in kinds if len(set(r.types)) > 1}
    as_double = {r.name for r in kinds if len(r.stored) > 1} - as_text
    layouts = named.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("field", "name", "type"))).alias("layout")).groupBy("layout").agg(F.collect_list("file").alias("files")).collect()
    parts = []
    for layout in layouts:
        df, columns = spark.read.parquet(*layout.files), [F.col("_metadata.file_path").alias("file")]
        for f in layout.layout:
            c = F.col(f"`{f.field}`")
            if f.name in as_text:
                c = F.to_json(c) if f.type in ("list", "object") else c.cast("string")
            elif f.name in as_double and f.type == "number":
                c = c.cast("double")
            columns.append(c.alias(f.name))
        parts.append(df.select(*columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
