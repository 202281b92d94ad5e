"""The pipeline's near-duplicates against brute force."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tapedeck.llm import likeness, simhash
from tapedeck.llm.common import table


def brute(rows, size=5):
    def of(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def variants():
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    out = [None, "", " ", "one two", "One  two", "one two three four five six"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([8, 9, 40, 120]))]
        out.append(" ".join(base))
        for k in range(4):  # likeness from far below to far above 0.8
            x = list(base)
            for _ in range(k + 1):
                x[r.randrange(len(x))] = word()
            out.append(" ".join(x))
        out.append(" ".join([*base, word()]))
    common = " ".join(word() for _ in range(60))
    out += [common + " " + " ".join(word() for _ in range(k)) for k in range(0, 60, 4)]
    r.shuffle(out)
    return list(enumerate(out))


def test_stage_equals_brute_force(spark):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.copies_out(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == brute(rows)
    assert {r.doc_id: r.text for r in out}.items() <= dict(rows).items()


def test_stage_on_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = corpus_pipeline.copies_out(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == brute(rows)


def test_rows_that_share_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "ab"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[0]), (None, texts[0])], "doc_id long, text string")
    out = corpus_pipeline.copies_out(spark, docs, "")
    assert sorted(map(tuple, out.where(F.col("doc_id").isNotNull()).collect())) == [(1, texts[0]), (1, texts[1])]
    assert out.count() == 3


def test_many_variants_of_one_text(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(300):
        x = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 4, 6, 8, 12])):
            x[k] = f"v{r.randrange(400)}"
        rows.append((d, " ".join(x)))
    out = corpus_pipeline.copies_out(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_fingerprints_come_first(spark, monkeypatch):
    """The grid join's links, decided by the sets, are what the bands start from."""
    r, called = random.Random(3), []
    base = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join([*base[:200], f"v{d}", *base[201:]])) for d in range(40)]  # of one component by few bits
    rows += [(100 + d, " ".join(r.sample(base, 60))) for d in range(20)]
    links, by_bands = simhash.links, likeness._merged
    monkeypatch.setattr(simhash, "links", lambda *a, **k: called.append(links(*a, **k)) or called[-1])
    monkeypatch.setattr(likeness, "_merged", lambda roots, more: called.append(roots) or by_bands(roots, more))
    out = corpus_pipeline.copies_out(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in out.collect()) == brute(rows)
    prints = {simhash._signed(simhash.simhash(t.encode(), 5)) for _, t in rows}
    assert {x for e in called[0].collect() for x in (e.a, e.b)} <= prints
    assert called[1].count() >= 10  # nodes in components before any band was read


def test_bitmaps_differ_no_more_than_sets():
    r = np.random.default_rng(4)
    for n in (0, 1, 40, 3000):
        x = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate((x[n // 5 :], r.integers(0, 1 << 63, n // 7, np.uint64))))
        assert np.bitwise_count(likeness.marks(x) ^ likeness.marks(y)).sum() <= len(np.setxor1d(x, y))


def test_a_large_group_of_variants_is_not_listed_pair_by_pair(spark, monkeypatch):
    r, listed, across = random.Random(7), [], likeness._across
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(500):
        x = list(base)
        for k in r.sample(range(150), r.choice([2, 4, 6, 8, 12])):
            x[k] = f"v{r.randrange(400)}"
        rows.append((d, " ".join(x)))
    monkeypatch.setattr(likeness, "_across", lambda *a: listed.append(across(*a).cache()) or listed[-1])
    out = corpus_pipeline.copies_out(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in out.collect()) == brute(rows)
    assert listed[0].count() < len(rows)
