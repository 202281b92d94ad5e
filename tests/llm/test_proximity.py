"""Near matches against brute force, and in the pipeline."""

import random

import corpus_pipeline
import pytest
from tapedeck.llm import decontaminate
from tapedeck.llm.decontaminate import Phrases, words


def brute(texts, rows, slop, least):
    out = set()
    for d, text in enumerate(texts):
        t = words(text)
        for key, item in rows:
            w = words(item.encode())
            for i in range(max(1, len(w) - 7) if w else 0):
                x = w[i : i + 8]
                for p in range(-len(x) - slop, len(t) + slop + 1):
                    if sum(any(x[j] == t[q] for q in range(max(0, p + j - slop), min(len(t), p + j + slop + 1))) for j in range(len(x))) >= min(least, len(x)):
                        out.add((d, str(key)))
    return out


@pytest.mark.parametrize("slop, least", [(1, 7), (1, 6), (0, 7), (2, 5)])
def test_near_equals_brute_force(slop, least):
    r = random.Random(3)
    word = lambda: f"w{int(r.random() ** 2 * 60)}"
    rows = [(k, " ".join(word() for _ in range(r.choice([3, 8, 12])))) for k in range(12)]
    texts = []
    for _ in range(150):
        t = [word() for _ in range(r.randrange(6))]
        for _ in range(2):
            x = r.choice(rows)[1].split()
            for _ in range(r.randrange(4)):
                i = r.randrange(len(x))
                x[i : i + r.randrange(2)] = [word()] * r.randrange(2)
                x = x or [word()]
            t += x
        texts.append(" ".join(t).encode())
    want = brute(texts, rows, slop, least)
    phrases = Phrases.build(rows)
    near = lambda part, base: {(base + d, k) for d, _, _, ids in phrases.find(part, slop, least)[1] for k in ids}
    assert near(texts, 0) == want and want
    assert set().union(*(near([t], i) for i, t in enumerate(texts))) == want  # however texts are dealt


def test_pieces_of_the_hash():
    texts = [("wörd " * 50 + "x" * 40).encode(), b"", b"  a  b ", "日本 y".encode() * 30]
    whole = decontaminate.tokenise(texts)
    for piece in (1, 7, 64):
        for a, b in zip(whole[1:], decontaminate.tokenise(texts, piece)[1:]):
            assert (a == b).all()


def test_near_items_of_many_blocks(spark):
    r = random.Random(11)
    rows = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(10))) for k in range(8)]
    texts = [" ".join([*x.split()[:4], "zz", *x.split()[5:]]) + " " + y for (_, x), (_, y) in zip(rows, rows[1:])] * 2 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(rows, "item_id long, text string")
    one = decontaminate.report(docs, items, **decontaminate.NEAR)
    many = decontaminate.report(docs, items, limit=300, **decontaminate.NEAR)
    want = {}
    for d, k in brute([(t or "").encode() for t in texts], rows, 1, 7):
        want[d] = want.get(d, 0) + 1
    got = sorted(map(tuple, many.collect()))
    assert got == sorted(map(tuple, one.collect())) and {x[0]: x[-1] for x in got if x[-1]} == want


def test_changed_passages_are_rejected(spark, tmp_path):
    p = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [p, [*p[:3], "xx", *p[4:]], [*p[:4], "xx", *p[4:]], p[:3] + p[4:], p[1:], p[:6], [*p[::2], *p[1::2]], ["other"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spark.createDataFrame([(1, " ".join(p))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.benchmark_out(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [5, 6, 7]
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontaminate.report(docs, items, **decontaminate.NEAR).collect()}
    assert got[0] == (1, 1) and got[1] == got[2] == got[3] == (0, 1) and got[7] == (0, 0)
