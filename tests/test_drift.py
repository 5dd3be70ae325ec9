import datetime as dt

from marklake.operators.drift import consistent_values, schema_changes

T0 = dt.datetime(2031, 3, 3)
FILES = "file string, exp string, written_at timestamp, path string"
VALUES = "file string, path string, num double, text string, exp string"


def run(spark, *contents, extra=()):
    files = [(f"f{k}", "E", T0 + dt.timedelta(hours=k), "clash") for k in range(len(contents))]
    rows = [(f"f{k}", p, *(v if isinstance(v, tuple) else (float(v), None)), "clash") for k, c in enumerate(contents) for p, v in c.items()]
    return spark.createDataFrame(rows + rows[:2] + list(extra), VALUES), spark.createDataFrame(files, FILES)


def changes(spark, *contents, **more):
    return sorted(tuple(r) for r in schema_changes(*run(spark, *contents, **more)).select("file", "change", "path", "new_path").collect())


NONE, YES, NO = (None, "None"), (1.0, "True"), (0.0, "False")
KEEP = {"/keep": 7}


def test_added_removed_and_back(spark):
    assert changes(spark, KEEP | {"/a": 1}, KEEP, KEEP | {"/a": 1.01}, KEEP | {"/a": NONE}, KEEP | {"/a": YES}) == [("f1", "removed", "/a", ""), ("f2", "added", "/a", ""), ("f4", "type_changed", "/a", "")]


def test_types_lists_and_objects(spark):
    got = changes(
        spark,
        {"/a": 1, "/b": (None, "x"), "/c": 2, "/d/0": 1, "/d/1": 2, "/e/3": 5},
        {"/a": (None, "1.01 ms"), "/b/0": 1, "/b/1": 2, "/c/value": 2, "/c/unit": (None, "ms"), "/d[len]": 20, "/d[mean]": 1.5, "/e/3": 5},
        {"/a": NONE, "/b": YES, "/c/value": 2, "/c/unit": (None, "ms"), "/d/0": 9, "/e/3": 5},
        {"/a": (None, "1.01 ms"), "/b": NO, "/c/value": 2, "/c/unit": (None, "ms"), "/d/0": 9, "/e/3": 5},
    )
    assert got == [("f1", "type_changed", "/a", ""), ("f1", "type_changed", "/b", ""), ("f1", "type_changed", "/c", ""), ("f2", "type_changed", "/b", "")]


def test_renamings(spark):
    first = KEEP | {"/n": 100, "/t": (None, "same text 12"), "/l": (None, "~1.02e+03"), "/far": 10, "/f": YES, "/o/value": 3, "/o/unit": (None, "s"), "/zero": 0}
    second = KEEP | {"/n2": 104.9, "/t2": (None, "same text 12"), "/l2": (None, "1010.5 (est.)"), "/near": 11, "/g": YES, "/p/value": 3.1, "/p/unit": (None, "s"), "/nil": 0}
    assert changes(spark, first, second) == sorted([("f1", "renamed", "/n", "/n2"), ("f1", "renamed", "/t", "/t2"), ("f1", "renamed", "/l", "/l2"), ("f1", "removed", "/far", ""), ("f1", "added", "/near", ""), ("f1", "renamed", "/f", "/g"), ("f1", "renamed", "/o", "/p"), ("f1", "renamed", "/zero", "/nil")])


def test_last_known_value_goes_on(spark):
    assert changes(spark, KEEP | {"/a": 5}, KEEP | {"/a": NONE}, KEEP | {"/b": 5.1}) == [("f2", "renamed", "/a", "/b")]
    assert changes(spark, KEEP | {"/a": 100, "/b": 101}, KEEP | {"/c": 101.2, "/d": 99.5}) == [("f1", "renamed", "/a", "/d"), ("f1", "renamed", "/b", "/c")]


def test_nulls_and_empty(spark):
    assert changes(spark, KEEP, KEEP, extra=[(None, "/x", 1.0, None, ""), ("f1", None, 1.0, None, ""), ("unknown", "/x", 1.0, None, "")]) == []
    assert schema_changes(spark.createDataFrame([], VALUES), spark.createDataFrame([], FILES)).count() == 0


def test_consistent_table(spark):
    values, files = run(spark, {"/a": 1}, {"/b": 1.01}, {"/c": 1.02}, {"/c": (None, "1.03 s")})
    rows = sorted((r.file, r.path, r.name, r.cast, r.text) for r in consistent_values(values, files).collect())
    assert rows == [("f0", "/a", "/c", "text", "1.0"), ("f1", "/b", "/c", "text", "1.01"), ("f2", "/c", "/c", "text", "1.02"), ("f3", "/c", "/c", "text", "1.03 s")]


def by_hand(values, files):
    """The changes of all files by loops over dictionaries, an independent reading of the rules."""
    import re
    from collections import defaultdict

    number = re.compile(r"[~≈<>=\s]*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(?:[a-zA-Zµ%/°]{1,8})?\s*(?:\([^()]*\))?\s*")
    order = defaultdict(list)
    for f in sorted(files, key=lambda f: (f.written_at, f.file)):
        order[f.exp].append(f.file)
    leaves = defaultdict(dict)
    for v in values:
        leaves[v.file][v.path] = v

    def kind(v):
        if v.text == "None" or (v.text is None and v.num is None):
            return None
        return "number" if v.text is None else "flag" if v.text in ("True", "False") else "text"

    def fields(file):
        out, groups = {}, defaultdict(dict)
        for p, v in leaves[file].items():
            m = re.fullmatch(r"(.*)(?:/(\d+)|\[(len|mean)\]|/(value|unit))", p)
            if m:
                groups[m[1]][m[2] or m[3] or m[4]] = (p, v)
        taken = set()
        for g, own in groups.items():
            digits = sorted(int(k) for k in own if k.isdigit())
            for t, keys in (("list", [str(k) for k in digits] if digits and digits == list(range(len(digits))) else []), ("list", ["len", "mean"]), ("object", ["value", "unit"])):
                if keys and all(k in own for k in keys):
                    taken |= {own[k][0] for k in keys}
                    nums = [own[k][1].num for k in keys if k != "len" and own[k][1].num is not None]
                    out[g] = (t, sum(nums) / len(nums) if nums else None, own["unit"][1].text if t == "object" else "")
        for p, v in leaves[file].items():
            if p not in taken:
                t = kind(v)
                m = number.fullmatch(v.text) if t == "text" else None
                out[p] = (t, v.num if t == "number" else float(m[1]) if m else None, "" if m or t == "number" else v.text)
        return out

    found = set()
    for names in order.values():
        before, last = {}, {}
        for k, file in enumerate(names):
            now = fields(file)
            if k:
                gone, new = sorted(set(before) - set(now)), sorted(set(now) - set(before))
                pairs = sorted(
                    (abs(now[b][1] - last[a][1]) if now[b][1] is not None else 0, a, b)
                    for a in gone
                    for b in new
                    if a in last and last[a][0] == now[b][0] and last[a][2] == now[b][2] and ((last[a][1] is None and now[b][1] is None) or (last[a][1] is not None and now[b][1] is not None and abs(now[b][1] - last[a][1]) <= 0.05 * abs(last[a][1])))
                )
                for _, a, b in pairs:
                    if a in gone and b in new:
                        found.add((file, "renamed", a, b))
                        gone.remove(a)
                        new.remove(b)
                found |= {(file, "removed", p, "") for p in gone} | {(file, "added", p, "") for p in new}
                found |= {(file, "type_changed", p, "") for p in set(now) & set(before) if p in last and now[p][0] and last[p][0] != now[p][0]}
            last = {p: (v if v[0] else last.get(p)) for p, v in now.items() if v[0] or p in last}
            before = now
    return found


def test_equal_to_loops_over_the_data(spark):
    folder = "/root/testdata/sf0.01"
    values, files = spark.read.parquet(f"{folder}/results.parquet"), spark.read.parquet(f"{folder}/result_files.parquet")
    got = {tuple(r) for r in schema_changes(values, files).select("file", "change", "path", "new_path").collect()}
    assert got == by_hand(values.collect(), files.collect())


def test_all_that_fit_are_paired(spark):
    zeros = changes(spark, KEEP | {f"/a{k}": 0 for k in range(5)} | {"/x": 3}, KEEP | {f"/b{k}": 0 for k in range(5)} | {"/y": 3})
    assert zeros == sorted([("f1", "renamed", f"/a{k}", f"/b{k}") for k in range(5)] + [("f1", "renamed", "/x", "/y")])
    assert changes(spark, KEEP | {"/a": 100, "/b": 110.3}, KEEP | {"/c": 105.1}) == [("f1", "removed", "/a", ""), ("f1", "renamed", "/b", "/c")]
    assert changes(spark, KEEP | {"/a": 50, "/b": 50}, KEEP | {"/c": 51}) == [("f1", "removed", "/b", ""), ("f1", "renamed", "/a", "/c")]
    old, new = [100, 102, 103, 103.5, 103.7, 90], [103.8, 104.1, 104.6, 105.8, 103.9, 89]
    got = run(spark, KEEP | {f"/a{k}": v for k, v in enumerate(old)}, KEEP | {f"/b{k}": v for k, v in enumerate(new)})
    found = {tuple(r) for r in schema_changes(*got).select("file", "change", "path", "new_path").collect()}
    assert found == by_hand(got[0].collect(), got[1].collect())


def test_greedy_pairs_of_random_numbers(spark):
    import random

    r = random.Random(3)
    got = run(spark, *[KEEP | {f"/{k}.{j}": round(r.uniform(90, 120), 3) for j in range(12)} for k in range(6)])
    found = {tuple(r) for r in schema_changes(*got).select("file", "change", "path", "new_path").collect()}
    assert found == by_hand(got[0].collect(), got[1].collect())


def test_files_by_their_footers(spark, tmp_path):
    """Three files of one producer: a renamed number, a type that changes, a field that comes and one that goes."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from marklake.operators.drift import file_changes, footers, read_consistently

    folder = tmp_path / "maker"
    folder.mkdir()
    tables = [
        {"id": [1, 2], "speed": [10.0, 12.0], "note": ["a", "b"], "size": [1, 2], "tags": [["x"], ["y", "z"]]},
        {"id": [3], "velocity": [11.1], "note": ["c"], "size": ["big"], "tags": [["w"]]},
        {"id": [4.5], "velocity": [11.0], "size": ["small"], "extra": [True], "tags": [None]},
    ]
    for k, t in enumerate(tables):
        path = folder / f"f{k}.parquet"
        pq.write_table(pa.table(t) if k < 2 else pa.table({**t, "tags": pa.array([None], pa.list_(pa.string()))}), path)
        os.utime(path, (1_900_000_000 + 100 * k,) * 2)
    fields, files = footers(spark, str(tmp_path))
    got = {(r.file[-10:], r.change, r.path, r.new_path) for r in file_changes(fields, files).collect()}
    assert got == {("f1.parquet", "renamed", "speed", "velocity"), ("f1.parquet", "type_changed", "size", ""), ("f2.parquet", "removed", "note", ""), ("f2.parquet", "added", "extra", "")}
    rows = {r.id: r for r in read_consistently(spark, fields, files, "maker").collect()}
    assert [rows[k].velocity for k in (1.0, 2.0, 3.0, 4.5)] == [10.0, 12.0, 11.1, 11.0] and rows[1.0]["size"] == "1" and rows[4.5]["size"] == "small" and rows[4.5].extra is True and rows[3.0].note == "c"
