import random
import unicodedata

import numpy as np

from marklake.llm.leaks import common_run, common_subsequences, leaked, passages, stretches, words


def brute(docs, items, run=10):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return sorted({(d, i) for d, t in docs if d is not None for w in [words(t or "")] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ()) if i is not None})


def test_all_leaks_are_found(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs, items = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "eval_item"))
        got = sorted((r.doc_id, r.item_id) for r in leaked(docs, items).collect())
        want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
        assert want and got == want


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "ké", "lo", "mü", "ня"]) for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 60)))) for k in range(80)] + [(80, None), (None, "a " * 20), (3, "x")]
    docs = [(None, "null id " + items[1][1], 0), (900, None, 0), (901, "", 0)]
    for k in range(500):
        item = words(items[rng.randrange(80)][1])
        n = rng.choice([8, 9, 10, 11, 30])
        at = rng.randrange(max(1, len(item) - n + 1))
        planted = item[at : at + n]
        if k % 3 == 0:
            planted = [unicodedata.normalize("NFD", w.upper()) for w in planted]
        docs.append((k, " ".join(word() for _ in range(rng.randint(0, 30))) + " — " + rng.choice([" ", ", ", "_"]).join(planted) + ". " + " ".join(word() for _ in range(rng.randint(0, 9))), 0))
    docs += docs[-2:]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = brute([x[:2] for x in docs], items)
    assert len(want) > 150
    for block in (5000, 30):
        assert sorted((r.doc_id, r.item_id) for r in leaked(d, i, block=block).collect()) == want
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0


def test_paraphrases_at_the_default_thresholds(spark):
    """Item passages with every eighth word exchanged for one that no item has are found in a corpus of real texts; other documents are not."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = spark.read.parquet("/root/testdata/sf0.01/eval_item.parquet")
    texts, rng, planted = {r.item_id: words(r.text) for r in items.collect()}, random.Random(3), {}
    for n, (i, own) in enumerate(sorted(texts.items())):
        if len(own) < 24:
            continue
        at = rng.randrange(len(own) - 23)
        part = [f"zzq{k}" if k % 8 == 5 else w for k, w in enumerate(own[at : at + 24])]
        planted[10**6 + n] = i
        docs.append((10**6 + n, "Zzqa zzqb. " + " ".join(part) + ", zzqc!"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaked(df, items, paraphrases=True).collect()
    near = {(r.doc_id, r.item_id) for r in got if r.kind == "paraphrase"}
    assert len(planted) > 20 and len(near & set(planted.items())) >= 0.9 * len(planted)
    assert sorted((r.doc_id, r.item_id) for r in got if r.kind == "passage") == brute(docs, [(i, " ".join(w)) for i, w in texts.items()])


def test_latent_space_decides_candidates(spark, monkeypatch):
    """In a space of random word vectors the candidates are others."""
    from marklake.llm import leaks

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "eval_item"))
    want = leaked(docs, items).count()
    fitted = leaks.Query.__init__

    def damaged(self, ids, texts, space, *a):
        fitted(self, ids, texts, space, *a)
        self.direction = np.roll(self.direction, 1, axis=0)

    monkeypatch.setattr(leaks.Query, "__init__", damaged)
    assert leaked(docs, items).count() < want


def test_pieces():
    ids = np.array([1, 2, -1, 3, 4, 5, -1])
    assert [x.tolist() for x in stretches(ids, 2)] == [[1, 2], [3, 4, 5]]
    assert [x.tolist() for x in stretches(ids, 2, 1, 9)] == [[1, 2, 9, 3, 4, 5]]
    assert passages(np.arange(7), 4, 3, 9).tolist() == [[0, 1, 2, 3], [3, 4, 5, 6]]
    assert passages(np.arange(8), 4, 3, 9).tolist() == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 9, 9]]
    assert common_run(np.array([1, 2, 3, 9]), np.array([0, 1, 2, 3])) == 3 and common_subsequences(np.array([[1, 5, 2, 3], [9, 9, 1, 2]]), np.array([[1, 2, 4, 3], [9, 1, 9, 2]]), 9).tolist() == [3, 2]
