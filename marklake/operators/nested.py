"""Deeply nested JSON records as flat tables that keep their parent-child links.

Each body is parsed into a VARIANT (in brackets and in braces, see `strict_variant`). Then one level after another is exploded: the containers of a level give the table of their members and elements,
with the parent's surrogate key and, in arrays, the ordinal. A level is written to the shared folder before the next one starts, so no level is computed twice, whatever the
depth; it ends with the level that has no containers left. The merged schema (all shapes seen under each path, array positions left out) is an aggregate over the nodes, and decides the flat tables: `catalogue` names one for every path
under which objects lie, with its parent, and a typed column for every member that is a scalar in some record; one for every array with scalar elements. `child_tables` makes them.

Shredding sets `spark.sql.variant.allowDuplicateKeys` for the session.

Defined results: a string holding a JSON object or array counts as that object or array, at any depth. A body that is null, empty or
not one complete valid JSON value gives no rows; so does a body without members. Of a member name repeated in one object the last value holds. Rows
with the same record id count once (the greatest body of differing ones); rows without an id are left out, as nothing could link to them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.sources.shared import written

NODES = ["record_id", "node_key", "parent_key", "parent_path", "node_path", "name", "ordinal", "depth", "kind", "text"]


def strict_variant(text: str) -> Column:
    """The text's JSON value, null unless it is one complete value. The parser ignores what follows a value: in brackets and in braces nothing can follow unseen."""
    inside = f"try_parse_json(concat('[', {text}, ']'))"
    braced = f"try_parse_json(concat('{{\"k\":', {text}, '}}'))"
    one = f"try_variant_get({inside}, '$[1]', 'variant') is null and {braced} is not null"
    return F.expr(f"case when {one} then try_variant_get({inside}, '$[0]', 'variant') end")


def _opened(df: DataFrame) -> DataFrame:
    """df with kind, text (of scalars) and v (of containers) in place of value."""
    shown = df.withColumn("json", F.expr("to_json(value)")).withColumn("text", F.when(F.substring("json", 1, 1) == '"', F.expr("try_variant_get(value, '$', 'string')")))
    shown = shown.withColumn("held", F.when(F.col("text").rlike(r"^[ \t\r\n]*[\[{]"), strict_variant("text")))
    shown = shown.withColumn("first", F.when(F.col("held").isNotNull(), F.expr("substring(to_json(held), 1, 1)")).otherwise(F.substring("json", 1, 1)))
    kind = F.when(F.col("first") == "{", "object").when(F.col("first") == "[", "array").when(F.col("first") == '"', "string").when(F.col("first").isin("t", "f"), "boolean").when(F.col("first") == "n", "null").otherwise("number")
    container = F.col("first").isin("{", "[")
    return shown.select(
        *[c for c in df.columns if c != "value"],
        kind.alias("kind"),
        F.when(~container, F.coalesce("text", "json")).alias("text"),
        F.when(container, F.coalesce("held", "value")).alias("v"),
    )


def _key(record: str, path: Column) -> Column:
    return F.xxhash64(F.col(record), path)


def shredded(df: DataFrame, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """A row per member of an object and per element of an array: its own and its parent's surrogate key and path, name or ordinal, kind, text of a scalar."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    records = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("record_id")).agg(F.max(body_col).alias("body"))
    level = records.select("record_id", strict_variant("body").alias("value")).where("value is not null")
    level = _opened(level.withColumn("node_path", F.lit(""))).where("v is not null").select("record_id", "node_path", "v")
    tables, depth = [], 0
    while True:
        depth += 1
        children = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        path = F.concat("node_path", F.lit("/"), name)
        rows = children.select(
            "record_id",
            _key("record_id", path).alias("node_key"),
            _key("record_id", F.col("node_path")).alias("parent_key"),
            F.col("node_path").alias("parent_path"),
            path.alias("node_path"),
            name.alias("name"),
            F.when(F.col("key").isNull(), F.col("pos")).alias("ordinal"),
            F.lit(depth).alias("depth"),
            "value",
        )
        table = written(_opened(rows), f"nested-{depth}")
        tables.append(table.drop("v"))
        level = table.where("v is not null").select("record_id", "node_path", "v")
        if level.isEmpty():
            break
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select(*NODES)


def generic(path: Column) -> Column:
    """A path with [] for each array position, the name of its table in the merged schema."""
    return F.regexp_replace(path, r"/\d+(?=/|$)", "/[]")


def merged_schema(nodes: DataFrame) -> DataFrame:
    """(path, kinds, nodes, records): every shape seen under a path, whichever records it comes from."""
    return nodes.groupBy(generic(F.col("node_path")).alias("path")).agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.count(F.lit(1)).alias("nodes"), F.countDistinct("record_id").alias("records")
    )


_SCALARS = {"number", "boolean", "string", "null"}


def _sql_type(kinds: set[str]) -> str:
    known = kinds & _SCALARS - {"null"}
    return {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}.get(frozenset(known), "string")


def catalogue(schema: DataFrame) -> dict[str, tuple[str, dict[str, str]]]:
    """path -> (path of the parent's table, column -> type) of the merged schema's tables. The schema has a row per path, however many records there are. The root's table has the path "" and no parent."""
    kinds = {r.path: set(r.kinds.split("|")) for r in schema.select("path", "kinds").collect()}
    above = lambda path: path.rsplit("/", 1)[0]
    objects = {""} | {p for p, k in kinds.items() if "object" in k}
    lists = {p for p, k in kinds.items() if p.endswith("/[]") and k & _SCALARS}
    out: dict[str, tuple[str, dict[str, str]]] = {}
    for path in sorted(objects | lists):
        columns = {p.rsplit("/", 1)[1]: _sql_type(k) for p, k in sorted(kinds.items()) if path in objects and p and above(p) == path and not p.endswith("/[]") and k & _SCALARS}
        if path in lists:
            columns["value"] = _sql_type(kinds[path])
        parent = above(path) if path else ""
        while parent and parent not in objects:  # arrays of arrays, and arrays of objects, hang on the object that holds them
            parent = above(parent)
        out[path] = (parent, columns)
    return out


def child_table(nodes: DataFrame, path: str, columns: dict[str, str], parent: str = "") -> DataFrame:
    """The flat table of what is found under a generic path (such as "/arms/[]"): a row per object or scalar element, with the record, the own key, the key of the row that holds it in the `parent` path's table, the ordinal and name,
    and a column per scalar member. A member named like one of these gets "_" at its end. A value that has not the column's type is null, for a string column its JSON."""
    fixed, value = ["record_id", "row_key", "parent_key", "ordinal", "row_name"], "value" if "value" in columns and path.endswith("/[]") else None
    scalar = F.col("kind").isin(*_SCALARS)
    if path:
        holder = _key("record_id", F.array_join(F.slice(F.split("node_path", "/"), 1, parent.count("/") + 1), "/"))
        rows = nodes.where((generic(F.col("node_path")) == path) & ((F.col("kind") == "object") | (scalar if value else F.lit(False))))
        rows = rows.select("record_id", F.col("node_key").alias("row_key"), holder.alias("parent_key"), "ordinal", F.col("name").alias("row_name"), F.when(scalar, F.col("text")).alias("_own"))
    else:
        rows = nodes.where("depth = 1").select("record_id", F.col("parent_key").alias("row_key")).distinct()
        rows = rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("parent_key", "bigint"), ("ordinal", "int"), ("row_name", "string"), ("_own", "string"))])
    members = [c for c in columns if c != value]
    if members:
        cells = nodes.where((generic(F.col("parent_path")) == path) & F.col("name").isin(members) & F.col("kind").isin(*(_SCALARS - {"null"}))).select("record_id", F.col("parent_key").alias("row_key"), "name", "text")
        wide = cells.groupBy("record_id", "row_key").agg(*[F.max(F.when(F.col("name") == c, F.col("text"))).try_cast(columns[c]).alias(c + "_" * (c in fixed)) for c in members])
        rows = rows.join(wide, ["record_id", "row_key"], "left")
    return (rows.withColumn("value", F.col("_own").try_cast(columns["value"])) if value else rows).drop("_own")


def child_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of the merged schema by path."""
    return {path: child_table(nodes, path, columns, parent) for path, (parent, columns) in catalogue(merged_schema(nodes)).items()}


def linked(nodes: DataFrame) -> DataFrame:
    """(path, parent, columns, rows): the flat tables, with the number of their rows."""
    spark = nodes.sparkSession
    known = [(p, parent, ", ".join(f"{c} {t}" for c, t in columns.items()), "value" in columns and p.endswith("/[]")) for p, (parent, columns) in catalogue(merged_schema(nodes)).items() if p]
    wanted = spark.createDataFrame(known, "path string, parent string, columns string, scalars boolean")
    found = nodes.select(generic(F.col("node_path")).alias("path"), "kind").join(F.broadcast(wanted), "path").where((F.col("kind") == "object") | (F.col("scalars") & F.col("kind").isin(*_SCALARS)))
    return found.groupBy("path", "parent", "columns").agg(F.count(F.lit(1)).alias("rows"))
