"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: A-Z to lower case, look-alike letters of other scripts and digits
or signs that stand for letters to Latin ones, all else that is no letter to a blank. An
entry is a whole word, or the beginning of words. Hits inside an exception phrase don't
count. The hits' weights, as a sum and relative to the text's length, give the score.

Entries, weights and the final curve are learnt from labelled rows. At most ``rows`` of
each label are used (those with the least MD5 of their id; documented bound), whatever the
table's size, and weighted so that the labels count as they occur; scoring covers every whole
text. A word becomes an entry if it stands in more toxic rows than chance allows for any of
the words looked at, in as many different surroundings (so the words of one much copied text
don't), and nine of ten rows that hold it are toxic. A beginning of words does only if at
least ``WORDS`` different words have it, none of them in more than half of its rows: what
one word explains is left to the whole word.

Defined results: null and empty texts score as texts without hits; several labels of one
id count as toxic if any does; labels without a row teach nothing; without labels, or with
labels of one sort alone, the seed words and fixed weights are used; equal rows have equal
scores; a text of any length is folded and scored whole, in time in proportion to its length
and hits; columns of any other names stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import doc_crc_mod, fresh, stored

ROWS = 3000  # labelled rows of each label that teach
ENTRIES = 2000  # entries of a lexicon at most
WORDS = 4  # different words that a beginning stands for at least
SHORTEST, LONGEST = 3, 8  # letters of a beginning
SURE = 0.01  # chance that any one entry is there by chance
SEEDS = ("idiot", "stupid", "moron", "loser", "scum", "worthless", "pathetic", "disgusting")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "circus clown", "clown at the circus", "loser bracket")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡһӏԛԝοαενιρτυχκμ", "abekmhopctyxijsdghlqwoaeviptuxkm"))
# Digits that stand for letters, and signs that do so between letters.
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = dict(zip("@$!|+€", "asiite"))
_SIGN = re.compile(r"(?<=[^\W_])[@$!|+€](?=[^\W_])")


class _Folding(dict):
    """What each code point becomes; those not listed are looked up once."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        self[c] = out = chr(c) if kind[0] == "L" else "" if kind in ("Mn", "Me", "Cf") else " "
        return out


_FOLD = _Folding({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_FOLD |= {ord(a): b for a, b in DIGITS.items()} | {ord(a): b for a, b in LOOKALIKES.items()} | {ord(a.upper()): b for a, b in LOOKALIKES.items() if len(a.upper()) == 1 and ord(a.upper()) > 127}
_FOLD |= {c: chr(c - 0xFEE0).lower() for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}


def fold(text: str) -> str:
    """Folded text with a blank at either end."""
    return f" {_SIGN.sub(lambda m: SIGNS[m.group()], text).translate(_FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """entries: (" " + beginning, or " " + word + " ") with weights; curve: bias and slopes."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-3.0, 1.5, 0.5)

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + weight), log(1 + weight per 100 words)."""
        folded = fold(text)
        weight = self._weight(folded)
        return (math.log1p(weight), math.log1p(100 * weight / (folded.count(" ") + 1))) if weight > 0 else (0.0, 0.0)

    def _weight(self, folded: str) -> float:
        hits, free = [], []
        for end, (size, weight) in _automaton(self).iter(folded):
            (free if weight is None else hits).append((end - size + 1, end, weight))
        if free and hits:
            free.sort()
            starts, upto = [f[0] for f in free], np.maximum.accumulate([f[1] for f in free]).tolist()
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or upto[k - 1] < h[0]]
        # The heaviest entry counts where several begin at one place.
        best: dict[int, float] = {}
        for a, _, w in hits:
            best[a] = max(best.get(a, 0.0), w)
        return sum(best.values())

    def score(self, text: str) -> float:
        return self.curved(self.features(text))

    def curved(self, f: tuple[float, float]) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], f))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


@lru_cache(maxsize=2)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        a.add_word(key := fold(phrase), (len(key), None))
    for entry, weight in lexicon.entries:
        a.add_word(entry, (len(entry), weight))
    if not len(a):
        a.add_word("\0", (1, 0.0))
    a.make_automaton()
    return a


def terms(text: str) -> set[tuple[str, int]]:
    """(entry, its surroundings) of every word and beginning of words of a text."""
    words, out = fold(text).split(), set()
    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
        around = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
        out.add((f" {w} ", around))
        out.update((f" {w[:n]}", around) for n in range(SHORTEST, min(LONGEST + 1, len(w))))
    return out


def chance(bad: int, good: int, share: float) -> float:
    """-log of the chance bound that ``bad`` of bad + good rows are toxic, by their share."""
    n = bad + good
    return sum(k * math.log(k / (n * q)) for k, q in ((bad, share), (good, 1 - share)) if k)


def choose(rows: list[dict], looked: int, n_bad: int, n_good: int, weight: float, entries: int) -> list[tuple[str, float]]:
    """Entries and weights. rows: term, bad and good (rows that hold it), around (different
    surroundings in toxic rows), words and most (of a beginning: its different words in toxic
    rows, and the rows of its commonest); ``looked``: all terms looked at, these being those that
    may pass; ``weight``: what a harmless row counts."""
    share, need = n_bad / (n_bad + n_good), math.log(max(1, looked) / SURE)
    out = []
    for r in rows:
        bad, good = r["bad"], r["good"]
        support = min(bad, r["around"])
        if support * (n_bad + n_good) <= (support + good) * n_bad or chance(support, good, share) < need:
            continue
        if bad < 9 * good * weight or not r["term"].endswith(" ") and (r["words"] < WORDS or 2 * r["most"] > bad):
            continue
        out.append((r["term"], round(math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1)), 6), support))
    out.sort(key=lambda e: (-e[2] * e[1], e[0]))
    return sorted((t, w) for t, w, _ in out[:entries])


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, entries: int = ENTRIES, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled rows of each label."""
    spark = docs.sparkSession
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"]
    sizes = dict(lab.groupBy("toxic").agg(F.count("*")).collect())  # two rows at most
    chosen = [r for k in (0, 1) if sizes.get(k) for r in lab.where(F.col("toxic") == k).orderBy(*order).limit(rows).collect()]
    seeds = Lexicon(tuple((f" {w} ", 3.0) for w in SEEDS), exceptions)
    if not chosen:
        return seeds
    ids = spark.createDataFrame(chosen, "key bigint, label int")  # at most 2 x rows ids
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("key")).select("text", "label")
    sample = stored(sample.dropDuplicates(), "labelled")
    found = {k: n for k, n in sample.groupBy("label").agg(F.count("*")).collect()}
    if not found.get(0) or not found.get(1):
        return seeds
    weight = sizes[0] / min(sizes[0], rows) * min(sizes[1], rows) / sizes[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of: dict[str, set[int]] = {}
                for term, around in terms(t or ""):
                    of.setdefault(term, set()).add(around)
                yield pa.RecordBatch.from_arrays([pa.array(list(of)), pa.array([k] * len(of), pa.int32()), pa.array([list(x) if k else [] for x in of.values()], pa.list_(pa.int64()))], ["term", "label", "around"])

    seen = stored(sample.mapInArrow(count, "term string, label int, around array<bigint>"), "terms")
    c = seen.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    c = stored(c, "counts")
    around = seen.where("label = 1").select("term", F.explode("around").alias("a")).groupBy("term").agg(F.count_distinct("a").alias("around"))
    whole = c.where(F.col("term").endswith(" ") & (F.col("bad") > 0)).select(F.expr("trim(term)").alias("w"), "bad")
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("w") - 1)), lambda n: F.concat(F.lit(" "), F.substring("w", F.lit(1), n)))
    of_start = whole.where(F.length("w") > SHORTEST).select("w", "bad", F.explode(starts).alias("term")).groupBy("term").agg(F.count("*").alias("words"), F.max("bad").alias("most"))
    looked = c.count()
    share = found[1] / (found[0] + found[1])
    least = math.log(max(1, looked) / SURE) / -math.log(share)  # fewer toxic rows can prove nothing
    strong = c.where((F.col("bad") >= least) & (F.col("bad") >= 9 * weight * F.col("good")))
    rows_ = [r.asDict() for r in strong.join(around, "term").join(of_start, "term", "left").collect()]
    lexicon = Lexicon(tuple(choose(rows_, looked, found[1], found[0], weight, entries)), exceptions)
    shared = spark.sparkContext.broadcast(lexicon)

    @arrow_udf("struct<a:double,b:double>")
    def features(texts: pa.Array) -> pa.Array:
        f = [shared.value.features(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in f], pa.float64()), pa.array([x for _, x in f], pa.float64())], ["a", "b"])

    got = sample.select(features.asNondeterministic()("text").alias("f"), "label").toPandas()  # at most 2 x rows
    x = np.array([[1.0, f["a"], f["b"]] for f in got["f"]])
    y = got["label"].to_numpy().astype(float)
    return Lexicon(lexicon.entries, exceptions, tuple(_logistic(x, y, np.where(y == 1, 1.0, weight))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> list[float]:
    """Newton's method with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def toxicity(text: Column, lexicon: Lexicon, spark) -> Column:
    shared = spark.sparkContext.broadcast(lexicon)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        lex, out = shared.value, []
        for i in range(0, len(texts), 256):
            out += [lex.score(t or "") for t in texts[i : i + 256].to_pylist()]
        return pa.array(out, pa.float64())

    return score.asNondeterministic()(text)


def train_rows(docs: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    return docs.where(doc_crc_mod(F.col("doc_id"), modulus) != held)


def report(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held: int = 0, threshold: float = 0.5, **options) -> DataFrame:
    lexicon = learn(train_rows(docs, modulus, held), train_rows(labels, modulus, held), **options)
    out = docs.select("doc_id", (doc_crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), toxicity(F.col("text"), lexicon, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held: int = 0, threshold: float = 0.5, **options) -> DataFrame:
    """The documents below the threshold, columns as given."""
    lexicon = learn(train_rows(docs, modulus, held), train_rows(labels, modulus, held), **options)
    (name,) = fresh(docs, "toxicity")
    return docs.withColumn(name, toxicity(F.col("text"), lexicon, docs.sparkSession)).where(F.col(name) < threshold).drop(name)
