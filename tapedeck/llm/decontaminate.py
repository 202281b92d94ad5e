"""Benchmark decontamination by a positional inverted index.

The training side is indexed in segments, as search engines shard by document: every
task tokenises its own documents and stores, for each test term, the list of token
positions. A test phrase starts from the list of its rarest term in the segment and
intersects the offset-adjusted lists of its other terms. So postings never cross the
network, and only the test terms (checked against ``limit`` bytes) are broadcast. A larger
test set goes through in blocks, one pass over the texts for each: a pass before the last
writes its hits alone, by a digest of the text, and the last one gathers them.

Proximity: if at most m of a window's terms may be missing, one of any m + 1 of them is there;
so a window starts from the lists of its m + 1 rarest terms in the segment, and what is found
doesn't depend on the segments.

Defined results: a null or empty text has no words and no hits; an item without words
never occurs; an item without an id is none; repeated item ids count as one item; equal rows
give equal results; a very long text is hashed in pieces; empty tables give no rows or no
hits; columns of any other names stay as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BROADCAST_LIMIT, blocks, chunks, fresh, ragged, stored, text_of, utf8

WINDOW = 8
#: Bytes that are hashed at once.
PIECE = 1 << 18
#: Proximity for production: finds a word changed, inserted or dropped in each window.
NEAR = {"slop": 1, "least": 7}
#: Lower-cases A-Z and turns every byte that is in no word into a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOUND = "struct<n_words:bigint,hits:array<struct<begin:int,stop:int>>,items:array<string>,near:array<string>>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))),
    ("items", pa.list_(pa.string())),
    ("near", pa.list_(pa.string())),
])


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of folded bytes."""
    inside = np.concatenate(([False], a != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(a)), out=total[1:])
    return start, end, (total[end] - total[start]) * _powers(_INVERSE, len(a) + 1)[start]


def tokenise(texts: list[bytes], piece: int = PIECE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and for each word its start, end, document and 64-bit hash. Bytes are
    hashed in pieces that end between words: the hash takes some fifty bytes for each."""
    data = b" ".join(texts).translate(FOLD)
    a = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(a) or not parts:
        cut = data.find(b" ", at + piece) if len(a) - at > piece else -1
        cut = len(a) if cut < 0 else cut
        s, e, h = _hashed(a[at:cut])
        parts.append((s + at, e + at, h))
        at = cut if cut > at else len(a)
    start, end, h = (np.concatenate(x) for x in zip(*parts))
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, start, end, np.searchsorted(np.cumsum(size), start, side="right"), h


@dataclass
class Phrases:
    """One block of test phrases: distinct windows of terms and the items they are of."""

    terms: list[bytes]
    hashes: np.ndarray  # sorted
    by_hash: np.ndarray  # term of each sorted hash
    windows: np.ndarray  # windows x WINDOW terms, -1 beyond the end
    length: np.ndarray
    first: np.ndarray  # items of window w: item[first[w]:first[w+1]]
    item: np.ndarray
    names: list[str]

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        of_term: dict[bytes, int] = {}
        of_window: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for key, text in rows:
            ids = [of_term.setdefault(w, len(of_term)) for w in words((text or "").encode())]
            if key is None or not ids:
                continue
            item = names.setdefault(str(key), len(names))
            for i in range(max(1, len(ids) - window + 1)):
                of_window.setdefault(tuple(ids[i : i + window]), set()).add(item)
        terms = list(of_term)
        h = np.array([_hash(t) for t in terms], np.uint64)
        order = np.argsort(h)
        table = np.full((len(of_window), window), -1, np.int64)
        for k, w in enumerate(of_window):
            table[k, : len(w)] = w
        counts = np.array([len(x) for x in of_window.values()], np.int64)
        return cls(terms, h[order], order, table, (table >= 0).sum(1), np.concatenate(([0], np.cumsum(counts))).astype(np.int64), np.array([i for x in of_window.values() for i in sorted(x)], np.int64), list(names))

    def find(self, texts: list[bytes], slop: int = 0, least: int = 0) -> tuple[np.ndarray, list]:
        """Words of each text; (document, first word, past the last, items, near items)."""
        data, start, end, doc, h = tokenise(texts)
        n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        base = np.cumsum(n_words) - n_words
        none: list[tuple[int, list, list, list]] = []
        if not len(self.windows) or not len(start):
            return n_words, none
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        term = np.where(self.hashes[at] == h, self.by_hash[at], -2)
        # The segment's postings: the positions of each test term, in order.
        known = np.flatnonzero(term >= 0)
        known = known[np.argsort(term[known], kind="stable")]
        count = np.bincount(term[known], minlength=len(self.terms))
        begin = np.cumsum(count) - count
        lists = np.where(self.windows >= 0, count[self.windows], np.iinfo(np.int64).max)
        by_rarity = np.argsort(lists, axis=1, kind="stable")
        rarest = by_rarity[:, 0]
        live = np.flatnonzero(lists[np.arange(len(lists)), rarest] > 0)
        found_w, found_p = [], []
        cost = np.cumsum(count[self.windows[live, rarest[live]]])
        for part in np.split(live, np.searchsorted(cost, np.arange(2_000_000, int(cost[-1]) if len(cost) else 0, 2_000_000))):
            t = self.windows[part, rarest[part]]
            w = np.repeat(part, count[t])
            p = known[ragged(begin[t], count[t])] - np.repeat(rarest[part], count[t])
            ok = (p >= 0) & (p + self.length[w] <= len(term))
            w, p = w[ok], p[ok]
            for k in range(self.windows.shape[1]):  # the rarest lists first
                j = by_rarity[w, k]
                want = self.windows[w, j]
                ok = (want < 0) | (term[np.minimum(p + j, len(term) - 1)] == want)
                w, p = w[ok], p[ok]
            ok = doc[p] == doc[p + self.length[w] - 1]
            found_w.append(w[ok])
            found_p.append(p[ok])
        w, p = np.concatenate(found_w or [live]), np.concatenate(found_p or [live])
        # Equal hashes are no proof: the words of what is left are compared as bytes.
        sure = {i: data[start[i] : end[i]] == self.terms[term[i]] for i in np.unique(ragged(p, self.length[w])).tolist()}
        if not all(sure.values()):
            ok = np.array([all(sure[i] for i in range(a, a + n)) for a, n in zip(p.tolist(), self.length[w].tolist())], bool)
            w, p = w[ok], p[ok]
        v, home = self._near(data, start, end, doc, term, known, count, begin, by_rarity, slop, least) if least else (w[:0], p[:0])
        if not len(p) and not len(v):
            return n_words, none
        cover = np.zeros(len(term) + 1, np.int64)
        np.add.at(cover, p, 1)
        np.add.at(cover, p + self.length[w], -1)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))))
        runs = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while doc[a] != doc[b - 1]:  # hits on both sides of a document's end
                cut = int(base[doc[a]] + n_words[doc[a]])
                runs.append((a, cut))
                a = cut
            runs.append((a, b))
        out: dict[int, tuple[list, set, set]] = {}
        for a, b in runs:
            d = int(doc[a])
            out.setdefault(d, ([], set(), set()))[0].append((int(a - base[d]), int(b - base[d])))
        for k, (ws, ds) in enumerate(((w, doc[p]), (v, home))):
            for pair in np.unique(ds * len(self.windows) + ws).tolist():
                d, x = divmod(pair, len(self.windows))
                out.setdefault(d, ([], set(), set()))[1 + k].update(self.names[i] for i in self.item[self.first[x] : self.first[x + 1]])
        return n_words, [(d, *x) for d, x in out.items()]

    def _near(self, data: bytes, start, end, doc, term, known, count, begin, by_rarity, slop: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, document) of the near matches. If at most m terms may be missing, one of
        any m + 1 is there: a window starts from the lists of its m + 1 rarest terms."""
        spare = self.length - np.minimum(least, self.length)
        absent = ((self.windows >= 0) & (count[self.windows] == 0)).sum(1)
        w0, k0 = np.nonzero((np.arange(self.windows.shape[1]) <= spare[:, None]) & (absent <= spare)[:, None])
        j0 = by_rarity[w0, k0]
        t0 = self.windows[w0, j0]
        shifts = np.arange(-slop, slop + 1)
        cost = np.cumsum(count[t0] * len(shifts))
        last = len(term) - 1
        out_w, out_d = [w0[:0]], [w0[:0]]
        for part in np.split(np.arange(len(w0)), np.searchsorted(cost, np.arange(1_000_000, int(cost[-1]) if len(cost) else 0, 1_000_000))):
            t = t0[part]
            at = known[ragged(begin[t], count[t])]
            w = np.repeat(np.repeat(w0[part], count[t]), len(shifts))
            p = ((at - np.repeat(j0[part], count[t]))[:, None] + shifts).ravel()
            home = np.repeat(doc[at], len(shifts))
            missed = np.zeros(len(w), np.int64)
            for k in range(self.windows.shape[1]):
                j = by_rarity[w, k]
                want = self.windows[w, j]
                seen = want < 0
                for d in shifts:
                    q = np.clip(p + j + d, 0, last)
                    seen |= (term[q] == want) & (q == p + j + d) & (doc[q] == home)
                missed += ~seen
                ok = missed <= spare[w]
                w, p, home, missed = w[ok], p[ok], home[ok], missed[ok]
            sure = np.zeros(len(w), bool)
            for i, (x, y, h) in enumerate(zip(w.tolist(), p.tolist(), home.tolist())):  # equal hashes are no proof
                places = [range(max(0, y + j - slop), min(last, y + j + slop) + 1) for j in range(self.length[x])]
                there = sum(any(doc[q] == h and data[start[q] : end[q]] == self.terms[self.windows[x, j]] for q in at) for j, at in enumerate(places))
                sure[i] = there >= self.length[x] - spare[x]
            out_w.append(w[sure])
            out_d.append(home[sure])
        return np.concatenate(out_w), np.concatenate(out_d)


def _hash(word: bytes) -> int:
    total, power = 0, 1
    for c in word:
        total, power = total + (c + 1) * power, power * _BASE % (1 << 64)
    return total % (1 << 64)


def find_matches(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0, least: int = 0, limit: int = BROADCAST_LIMIT) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column and that column's name.

    n_words; hits: runs of hit words [begin, stop); items: ids of the items of which a
    window occurs; near: with ``least`` > 0, ids of items of which a window can be laid
    somewhere over the text so that ``least`` of its terms (all, if it has fewer) stand
    within ``slop`` positions of their places.
    """
    spark = docs.sparkSession
    (found,) = fresh(docs, "found")
    rows = ((r[0], r[1]) for r in items.select(item_id, item_text).toLocalIterator())
    # A row costs its text, and for each of its words about a window of term ids.
    size = lambda r: 100 + len(r[1] or "") * 12
    key, more = fresh(docs, "digest", "more")
    digest = F.md5(text_of(text).cast("binary"))
    earlier, ahead = [], None
    for block in blocks(rows, size, limit):
        if ahead is not None:
            one = docs.select(digest.alias(key), _scan(spark, ahead, slop, least, window)(F.col(text)).alias(more))
            some = one.where((F.size(f"{more}.items") > 0) | (F.size(f"{more}.near") > 0))
            earlier.append(stored(some.groupBy(key).agg(F.first(more).alias(more)), "hits"))
        ahead = block
    last = docs.withColumn(found, _scan(spark, ahead or [], slop, least, window)(F.col(text)))
    if not earlier:
        return last, found
    every = earlier[0]
    for e in earlier[1:]:
        every = every.unionByName(e)
    every = every.groupBy(key).agg(F.collect_list(more).alias(more))  # as many as there are blocks
    joined = last.withColumn(key, digest).join(every, key, "left")
    old, new = F.coalesce(F.col(more), F.array().cast(f"array<{_FOUND}>")), F.col(found)
    ids = lambda name: F.array_distinct(F.concat(new[name], F.flatten(old[name])))
    return joined.withColumn(found, F.struct(new["n_words"].alias("n_words"), F.concat(new["hits"], F.flatten(old["hits"])).alias("hits"), ids("items").alias("items"), ids("near").alias("near"))).select(*docs.columns, found), found


def _scan(spark, block: list, slop: int, least: int, window: int):
    phrases = spark.sparkContext.broadcast(Phrases.build(block, window))

    @arrow_udf(_FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        out: list[dict] = []
        for a, b in chunks(texts):
            n_words, found = phrases.value.find(utf8(texts[a:b]), slop, least)
            part = [{"n_words": n, "hits": [], "items": [], "near": []} for n in n_words.tolist()]
            for d, hits, items, near in found:
                part[d] |= {"hits": [{"begin": x, "stop": y} for x, y in hits], "items": sorted(items), "near": sorted(near)}
            out += part
        return pa.array(out, _FOUND_ARROW)

    return scan.asNondeterministic()


def hit_words(hits):
    """Number of words in the union of the runs (runs of several blocks can overlap)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda acc, r: F.struct(
        F.greatest(acc["upto"], r["stop"]).alias("upto"),
        (acc["n"] + F.greatest(r["stop"] - F.greatest(acc["upto"], r["begin"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame, *, min_items: int = 2, **options) -> DataFrame:
    """One row for each document: what the decontamination query returns; with ``least``
    also n_near, the number of items that match exactly or nearly."""
    found, name = find_matches(docs.select("doc_id", "text"), items, **options)
    r = F.col(name)
    ids = F.array_sort(r["items"])
    near = [F.size(F.array_union(r["items"], r["near"])).cast("long").alias("n_near")] if options.get("least") else []
    return found.select(
        "doc_id", r["n_words"].alias("n_words"), hit_words(r["hits"]).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size(ids) >= min_items).alias("contaminated"), *near,
    )


def clean(docs: DataFrame, items: DataFrame, *, min_items: int = 2, **options) -> DataFrame:
    """The documents that hold windows of fewer than ``min_items`` items (with ``least`` > 0
    near ones too), columns as given."""
    found, name = find_matches(docs, items, **options)
    return found.where(F.size(F.array_union(F.col(name)["items"], F.col(name)["near"])) < min_items).drop(name)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
