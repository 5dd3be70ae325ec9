import json
import random

from marklake.operators.nested import catalogue, child_tables, linked, merged_schema, shredded

BODIES = [
    '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}],[{}', '{"a":1},"x":{}', '{"a":NaN}', "{'a':1}", '{"a":', '{"a":01}', "", "  ", "null", "5", None, '[1,[2,{}],"[3]"]', '{"a":1,}', '{"a":1e400}',
    '{"":{"x/y":[{}]}}', ' {"a":"{\\"q\\":[1,null,\\"[{}]\\"]}","n":"{draft","m":"[1","s":" [2] "}\n', '"{\\"q\\":[1]}"', "[]", "{}", '{"a":{"b":{"c":{"d":{"e":{"f":[[[[0]]]]}}}}}}', '{"é漢":"\\ud83d\\ude00","t":true,"z":null}',
]


def strict(text):
    def no(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=no)
    except (ValueError, TypeError):
        return no


def brute(record, value, path=""):
    if isinstance(value, str) and value.strip(" \t\r\n")[:1] in ("[", "{") and value.strip(" \t\r\n"):
        held = strict(value)
        value = held if isinstance(held, (dict, list)) else value
    for k, x in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield record, path, f"{path}/{k}"
        yield from brute(record, x, f"{path}/{k}")


def found(df):
    return sorted((r.record_id, r.parent_path, r.node_path) for r in df.select("record_id", "parent_path", "node_path").collect())


def test_all_shapes_equal_brute_force(spark):
    rows = [(k, b, "clash") for k, b in enumerate(BODIES)] + [(13, BODIES[13], "again"), (None, '{"a":1}', "")]
    got = shredded(spark.createDataFrame(rows, "record_id long, body string, node_path string"))
    want = sorted(x for k, b in enumerate(BODIES) if (v := strict(b)) is not strict and not callable(v) for x in brute(k, v))
    assert found(got) == want
    keys = {r.node_key: r.node_path for r in got.collect()}
    assert all(r.parent_path == "" or keys[r.parent_key] == r.parent_path for r in got.collect())


def test_random_records(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(9 if depth else 5)
        if kind < 3:
            return {rng.choice("abcd/\"é"): value(depth - 1) for _ in range(rng.randrange(4))} if depth else None
        if kind < 5:
            return [value(depth - 1) for _ in range(rng.randrange(3))] if depth else True
        if kind == 5:
            return json.dumps(value(depth - 1))
        return rng.choice([1, 2.5, "x", None, False, "[", "{draft"])

    records = {k: value(5) for k in range(120)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "record_id long, body string")
    assert found(shredded(df)) == sorted(x for k, v in records.items() for x in brute(k, v))


def test_flat_tables(spark):
    bodies = ['{"run":7,"arms":[{"arm":"A","nats_1x":1.5,"ordinal":3},{"arm":"B","nats_1x":null,"ok":true,"curve":{"200":2,"400":"x"}}],"grid":[[1,2],[3]]}', '{"run":"eight","arms":[]}']
    nodes = shredded(spark.createDataFrame(list(enumerate(bodies)), "record_id long, body string"))
    kinds = {r.path: r.kinds for r in merged_schema(nodes).collect()}
    assert kinds["/arms/[]/nats_1x"] == "null|number" and kinds["/arms/[]"] == "object"
    assert catalogue(merged_schema(nodes)) == {
        "": ("", {"run": "string"}),
        "/arms/[]": ("", {"arm": "string", "nats_1x": "double", "ok": "boolean", "ordinal": "double"}),
        "/arms/[]/curve": ("/arms/[]", {}),
        "/arms/[]/curve/[]": ("/arms/[]/curve", {"value": "string"}),
        "/grid/[]/[]": ("", {"value": "double"}),
    }
    tables = {p: t.collect() for p, t in child_tables(nodes).items()}
    root, arms = {r.record_id: r for r in tables[""]}, {r.arm: r for r in tables["/arms/[]"]}
    assert (root[0].run, root[1].run) == ("7", "eight")
    assert (arms["A"].ordinal, arms["A"].ordinal_, arms["A"].nats_1x, arms["B"].nats_1x, arms["B"].ok, arms["A"].ok) == (0, 3.0, 1.5, None, True, None)
    assert arms["A"].parent_key == arms["B"].parent_key == root[0].row_key and tables["/arms/[]/curve"][0].parent_key == arms["B"].row_key
    assert {(r.row_name, r.value, r.parent_key) for r in tables["/arms/[]/curve/[]"]} == {("200", "2", tables["/arms/[]/curve"][0].row_key), ("400", "x", tables["/arms/[]/curve"][0].row_key)}
    assert sorted(r.value for r in tables["/grid/[]/[]"]) == [1.0, 2.0, 3.0] and {r.parent_key for r in tables["/grid/[]/[]"]} == {root[0].row_key}
    assert {(r.path, r.rows) for r in linked(nodes).collect()} == {("/arms/[]", 2), ("/arms/[]/curve", 1), ("/arms/[]/curve/[]", 2), ("/grid/[]/[]", 3)}


def test_empty(spark):
    assert shredded(spark.createDataFrame([], "record_id long, body string")).count() == 0
