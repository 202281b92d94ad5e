"""Probabilistic suffix tree over words, learnt from the whole corpus and used to score it.

Words are told apart by 64-bit hashes. The root gives each word (c + 1) / (N + V + 1). The
tree grows depth by depth: contexts of d words are counted only where their last d - 1 words
are a state, and depths go on until no context passes. A context becomes a state by its
divergence from its suffix state: the symbols that follow it c times of n, where c log(c / (n p))
nats (p: the suffix state's probability) exceed the price of a transition, log N, are told
apart, all others lumped; n times the Kullback-Leibler divergence of the two distributions
must exceed the price of these transitions. Their counts are discounted, and the freed mass
goes to the suffix state, down to the root. A text is scored from the longest suffix state at
each word.

Contexts of two words are counted only if they occur often enough, which the counts of the
first depth tell; longer ones follow the few states of two words, and are counted only if the
two words that they begin with occur often enough (all, where these pairs are more than
``EDGES``).

Least counts keep chance out: a transition needs ``least(N)``, about sqrt(N) / 256, a context
``CONTEXT`` times that. So the tree grows with the corpus, and the counts that a task sends
with its input. Words of at least that count are listed in a broadcast; more than ``LISTED``
go in cuts, by their hashes, and each cut is a pass that looks at its own symbols, so the tree
is the same. Counts of words that aren't listed are joined, row by row of the result.
The tree is broadcast in parts of at most ``EDGES`` transitions, cut by the last word of the
contexts, so that all states that matter at a place are in one part: each part is one pass.

Defined results: null and empty texts are the end alone; without any training rows all
words are unknown; equal rows have equal scores; rows without an id are scored like others; a
text of any length is scored whole, in one piece; an empty table gives an empty one; columns
of any other names stay as they are, those of the added names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, doc_crc_mod, fresh, small, stored, text_of, utf8

DISCOUNT = 0.75
CONTEXT = 16
#: Words (16 bytes each) and transitions (16 bytes each) that one broadcast holds at most.
LISTED, EDGES = 4_000_000, 4_000_000
#: Entries that a task's partial counts hold before they are sent on.
PARTIAL = 1_000_000
#: Bytes that are hashed at once.
PIECE = 1 << 18
END, REST = np.uint64(1), np.uint64(2)  # the end of a text; a symbol that is not listed
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Most bytes of a word that is hashed beside others.
LONG = 64
_BASE = 0x9E3779B97F4A7C15
_PART = 52  # the top 12 bits of a context's key are those of its last word


def least(total: int) -> int:
    """Least count of a transition."""
    return max(2, math.ceil(math.sqrt(total) / 256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashed(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words (none empty) by eight bytes at once; eight more bytes end ``data``."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=1)
    h = mix((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_BASE))
    at, done = np.flatnonzero(size > 8), 8
    while len(at) and done < LONG:
        x = eight[start[at] + done] & _FIRST[np.minimum(size[at] - done, 8)]
        h[at] = mix(h[at] * np.uint64(0x9FB21C651E98DF25) + x)
        done += 8
        at = at[size[at] > done]
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    h[h < 4] += np.uint64(4)
    return h


def _words(data: bytes, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a stretch that begins and ends between words."""
    a = np.frombuffer(memoryview(data)[at:stop], np.uint8)
    inside = np.concatenate(([False], a != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start = edge[::2] + at
    return start, _hashed(data, start, edge[1::2] - edge[::2])


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol (the words of each text, then an end): its hash, text, and place there."""
    data = b" ".join([*texts, bytes(8)]).translate(_FOLD)
    starts, hashes, at, stop = [], [], 0, len(data) - 9
    while at < stop:
        cut = data.find(b" ", at + PIECE) if stop - at > PIECE else -1
        cut = stop if cut < 0 else cut
        s, h = _words(data, at, cut)
        starts.append(s)
        hashes.append(h)
        at = max(cut, at + 1)
    start = np.concatenate(starts or [np.empty(0, np.int64)])
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = np.diff(np.searchsorted(start, np.cumsum(size)), prepend=0) + 1  # with the end
    last = np.cumsum(n) - 1
    out, word = np.full(int(n.sum()), END, np.uint64), np.ones(int(n.sum()), bool)
    word[last] = False
    out[word] = np.concatenate(hashes or [np.empty(0, np.uint64)])
    return out, np.repeat(np.arange(len(texts)), n), np.arange(len(out)) - np.repeat(last + 1 - n, n)


class Index:
    """Places of sorted keys (hashes) by their low bits; where several share these, by search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(4, (8 * len(keys)).bit_length())) - 1)
        slot = (keys & self.mask).astype(np.int64)
        self.at = np.full(int(self.mask) + 1, -1, np.int32)
        self.at[slot] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.zeros(len(self.at), bool)
        self.shared[slot[self.at[slot] != np.arange(len(keys))]] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there)."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        slot = (wanted & self.mask).astype(np.int64)
        at = self.at[slot]
        there = (at >= 0) & (self.keys[at] == wanted)
        again = np.flatnonzero(self.shared[slot] & ~there)
        if len(again):
            other = np.minimum(np.searchsorted(self.keys, wanted[again]), len(self.keys) - 1)
            at[again], there[again] = other, self.keys[other] == wanted[again]
        return at, there


def _find(holder, name: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) in the sorted array ``name``, whose index each process makes once."""
    made = holder.__dict__.setdefault("_indexes", {})
    if name not in made:
        made[name] = Index(getattr(holder, name))
    return made[name].find(wanted)


def _extended(key: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """The key of a context with one more word at its beginning."""
    own = mix(word + np.uint64(_BASE))
    return own if key is None else _joined(key, own)


def _joined(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The key of a context and of the one word before it."""
    low = np.uint64((1 << _PART) - 1)
    return (mix(key * np.uint64(0xD6E8FEB86659FD93) + before) & low) | (key & ~low)


def _edge(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0xA0761D6478BD642F) + symbol)


@dataclass
class Level:
    """The states of one depth: sorted contexts with the mass left to their suffixes, and
    sorted transitions with their shares."""

    contexts: np.ndarray
    left: np.ndarray
    edges: np.ndarray
    shares: np.ndarray

    def after(self, key: np.ndarray, where: np.ndarray, symbols: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The probabilities of symbols after states (their keys and places); p: those from the suffix states."""
        e, there = _find(self, "edges", _edge(key, symbols))
        return np.where(there, self.shares[e] if len(self.shares) else 0.0, 0.0) + self.left[where] * p


@dataclass
class Tree:
    """One part of the tree, and the listed words."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    total: int
    distinct: int
    part: int = 0
    parts: int = 1
    levels: list[Level] = field(default_factory=list)
    often: np.ndarray | None = None  # sorted contexts of one or two words that may become states
    pairs: np.ndarray | None = None  # sorted contexts of the two words that longer ones may begin with
    cut: int = 0
    cuts: int = 1

    def owns(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(_PART) & np.uint64(0xFFF)) % np.uint64(self.parts) == self.part

    def looks_at(self, symbols: np.ndarray) -> np.ndarray:
        """Which symbols are this cut's to follow, listed or not."""
        return (symbols >> np.uint64(_PART)) % np.uint64(self.cuts) == self.cut

    def root(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability, count, whether listed); what isn't counts as unknown here."""
        at, known = _find(self, "words", symbols)
        c = np.where(known, self.counts[at] if len(self.counts) else 0, 0)
        return (c + 1) / (self.total + self.distinct + 1), c, known

    def _begin(self, s: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that this part and cut look at, and the keys of their contexts of one word."""
        at = np.flatnonzero((place >= 1) & self.looks_at(s) if self.cuts > 1 else place >= 1)
        key = _extended(None, s[at - 1])
        if self.parts > 1:
            own = self.owns(key)
            at, key = at[own], key[own]
        return at, key

    def walk(self, s: np.ndarray, place: np.ndarray, p: np.ndarray) -> None:
        """``p``, each symbol's probability from the root, becomes that from its longest suffix state."""
        at, key = self._begin(s, place)
        for depth, level in enumerate(self.levels, 1):
            where, state = _find(level, "contexts", key)
            at, key, where = at[state], key[state], where[state]
            p[at] = level.after(key, where, s[at], p[at])
            more = place[at] > depth
            at, key = at[more], key[more]
            key = _extended(key, s[at - depth - 1])

    def reach(self, s: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with a context one word longer than the deepest states, whose suffix is one of
        these and that may become a state itself; the keys of these contexts."""
        at, key = self._begin(s, place)
        for depth, level in enumerate(self.levels, 1):
            state = _find(level, "contexts", key)[1] & (place[at] > depth)
            at, key = at[state], key[state]
            key = _extended(key, s[at - depth - 1])
        if len(self.levels) < 2:
            own = _find(self, "often", key)[1]
            return at[own], key[own]
        if self.pairs is not None:
            first = at - len(self.levels) - 1
            own = _find(self, "pairs", _extended(_extended(None, s[first + 1]), s[first]))[1]
            at, key = at[own], key[own]
        return at, key

    def reached(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For such places: (probability from the deepest state, whether the symbol is listed)."""
        p, _, known = self.root(s[at])
        key = None
        for depth, level in enumerate(self.levels, 1):
            key = _extended(key, s[at - depth])
            p = level.after(key, _find(level, "contexts", key)[0], s[at], p)
        return p, known

    def probabilities(self, s: np.ndarray, place: np.ndarray) -> np.ndarray:
        p = self.root(s)[0]
        self.walk(s, place, p)
        return p


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of parallel arrays by the first: (places, sums of the second)."""
    key, n = keys
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return order[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def count_words(train: DataFrame, text: str) -> DataFrame:
    """(word, c) over all rows, one end for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], ["word", "c"])

        held = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                new = np.unique(sequence(utf8(batch.column(0)[a:b]))[0], return_counts=True)
                both = np.concatenate((held[0], new[0])), np.concatenate((held[1], new[1]))
                at, n = _summed(both)
                held = (both[0][at], n)
                if len(at) > PARTIAL:
                    yield out(held)
                    held = (held[0][:0], held[1][:0])
        yield out(held)

    return train.select(text).mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _transitions(train: DataFrame, text: str, tree) -> DataFrame:
    """(context, symbol, p, c) of the depth after the tree's last: what follows the contexts
    whose suffix is a state (of one or two words: those of ``often``; of more: those that
    begin with one of ``pairs``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size = tree.value, [], 0

        def out() -> pa.RecordBatch:
            context, symbol, p = (np.concatenate([h[i] for h in held]) if held else np.empty(0, k) for i, k in enumerate((np.uint64, np.uint64, np.float32)))
            at, n = _summed([_edge(context, symbol), np.ones(len(context), np.int64)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(context[at].view(np.int64)), pa.array(symbol[at].view(np.int64)), pa.array(p[at]), pa.array(n)], ["context", "symbol", "p", "c"])

        for batch in batches:
            for a, b in chunks(batch.column(0)):
                s, _, place = sequence(utf8(batch.column(0)[a:b]))
                at, key = t.reach(s, place)
                p, known = t.reached(s, at)
                held.append((key, np.where(known, s[at], REST), p.astype(np.float32)))
                size += len(at)
                if size > PARTIAL:
                    yield out()
                    size = 0
        yield out()

    return train.select(text).mapInArrow(run, "context bigint, symbol bigint, p float, c bigint").groupBy("context", "symbol").agg(F.sum("c").alias("c"), F.max("p").alias("p"))


def _often(frequent: DataFrame, tree) -> np.ndarray:
    """The frequent transitions of the first depth (a word, the next one) as contexts of two
    words; of a tree with states: those whose last word is a state of the tree's part. Sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            key = _extended(None, second)
            own = _find(t.levels[0], "contexts", key)[1] if t.levels else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(_joined(key[own], first[own]).view(np.int64))], ["key"])

    return np.sort(frequent.select("context", "symbol").mapInArrow(run, "key bigint").toArrow().column(0).to_numpy().view(np.uint64))


def states(counted: DataFrame, total: int, edge: int, need: int) -> DataFrame:
    """(context, symbol, share, left): the transitions of the contexts that pass."""
    of = stored(counted.groupBy("context").agg(F.sum("c").alias("n")).where(F.col("n") >= need), "contexts")
    c, n, p = F.col("c"), F.col("n"), F.col("p").cast("double")
    gain = c * F.log(c / (n * p)) - math.log(total)
    apart = counted.where((c >= edge) & (F.col("symbol") != int(REST))).join(small(of), "context").where(gain > 0)
    kept = apart.groupBy("context").agg(F.sum(gain).alias("gain"), F.sum("c").alias("seen"), F.sum(p).alias("mass"), F.count("*").alias("kinds"), F.first("n").alias("n"))
    rest = F.greatest(n - F.col("seen"), F.lit(0))
    lumped = F.when(rest > 0, rest * F.log(rest / n / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
    left = 1 - (F.col("seen") - DISCOUNT * F.col("kinds")) / n
    kept = stored(kept.where(F.col("gain") + lumped > 0).select("context", left.alias("left")), "states")
    return stored(apart.join(small(kept), "context").select("context", "symbol", ((c - DISCOUNT) / n).alias("share"), "left"), "level")


def _level(rows: DataFrame, part: int, parts: int) -> Level:
    """The transitions of one part (at most about ``EDGES``), sorted for search."""
    own = rows.where(F.shiftrightunsigned("context", _PART) % parts == part) if parts > 1 else rows
    t = own.toArrow()
    context, symbol = (t.column(c).to_numpy().view(np.uint64) for c in ("context", "symbol"))
    keys, first = np.unique(context, return_index=True)
    edges = _edge(context, symbol)
    order = np.argsort(edges)
    return Level(keys, t.column("left").to_numpy()[first], edges[order], t.column("share").to_numpy()[order])


@dataclass
class Model:
    """A learnt tree: (word, c) of the training rows, how many of these are listed, and the
    stored transitions of each depth."""

    counted: DataFrame
    listed: int
    total: int
    distinct: int
    least: int
    levels: list[DataFrame]
    sizes: list[int]

    def parts(self, more: int = 0) -> int:
        return max(1, math.ceil((sum(self.sizes) + more) / EDGES))

    def cuts(self) -> int:
        return max(1, math.ceil(self.listed / LISTED))

    def part(self, k: int, parts: int, cut: int = 0, cuts: int = 1) -> Tree:
        if self.__dict__.get("_cut", (None,))[0] != (cut, cuts):  # the last cut's words are kept
            own = self.counted.where(F.col("c") >= self.least)
            own = own.where(F.shiftrightunsigned("word", _PART) % cuts == cut) if cuts > 1 else own
            self._cut = (cut, cuts), _listing(own)
        return Tree(*self._cut[1], self.total, self.distinct, k, parts, [_level(x, k, parts) for x in self.levels], cut=cut, cuts=cuts)

    def roots(self) -> tuple[Tree, int]:
        """No transitions, but the most frequent words, and the least count of these."""
        need = self.least
        while self.counted.where(F.col("c") >= need).count() > LISTED:
            need *= 2
        return Tree(*_listing(self.counted.where(F.col("c") >= need)), self.total, self.distinct), need


def _listing(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words and their counts."""
    t = rows.select("word", "c").toArrow()
    words, c = t.column("word").to_numpy().view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(words)
    return words[order], c[order]


def learn(train: DataFrame, counts: DataFrame, text: str, *, context: int = CONTEXT, edge: int | None = None) -> Model:
    """The tree of the training rows; counts: (word, c) of these, stored."""
    spark = train.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    need = edge or least(total)
    listed = counts.where(F.col("c") >= need).count()
    model = Model(counts, listed, total, distinct, need, [], [])
    # Words of context * need: 16 times the root of the corpus at most.
    first = np.sort(_extended(None, _listing(counts.where(F.col("c") >= context * need))[0]))
    frequent, pairs, more, cuts = None, None, 0, model.cuts()
    while total:
        parts = model.parts(more)
        counted = None
        for cut, k in [(j, k) for j in range(cuts) for k in range(parts)]:
            part = model.part(k, parts, cut, cuts)
            if not model.levels:
                part.often = first
            part.pairs = pairs
            if len(model.levels) == 1:
                part.often = _often(frequent, spark.sparkContext.broadcast(part))
            tree = spark.sparkContext.broadcast(part)
            one = stored(_transitions(train, text, tree), "transitions")
            counted = one if counted is None else counted.unionByName(one)
        level = states(counted, total, need, context * need)
        n = level.count()
        if not n:
            break
        model.levels.append(level)
        model.sizes.append(n)
        if len(model.levels) == 1:
            frequent = counted.where((F.col("c") >= context * need) & (F.col("symbol") != int(REST)))
            more = frequent.count()
        elif len(model.levels) == 2:  # a context occurs no more often than the two words that it begins with
            if more <= EDGES:
                pairs = _often(frequent, spark.sparkContext.broadcast(Tree(first[:0], first[:0], total, distinct)))
            more = 0
    return model


_PARTIAL = "struct<n_tokens:bigint,n_known:bigint,base:double,score:double,rare:array<struct<word:bigint,n:int>>>"
_PARTIAL_ARROW = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32())])))])


def _scores(shared):
    """The sums of a text that need no join, and its words that are not listed."""

    @arrow_udf(_PARTIAL)
    def partial(texts: pa.Array) -> pa.Array:
        t, out = shared.value, []
        for a, b in chunks(texts):
            s, doc, place = sequence(utf8(texts[a:b]))
            p, c, known = t.root(s)
            n = np.bincount(doc, minlength=b - a)
            base = np.bincount(doc, np.log10(c + 1), b - a) - n * math.log10(t.total + t.distinct + 1)
            t.walk(s, place, p)
            score = np.bincount(doc, np.log10(p), b - a)
            other = np.flatnonzero(~known)
            order = other[np.lexsort((s[other], doc[other]))]
            first = np.flatnonzero(np.concatenate(([True], (s[order][1:] != s[order][:-1]) | (doc[order][1:] != doc[order][:-1]))))[: len(order)]
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            ends = np.searchsorted(doc[order[first]], np.arange(b - a + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s[order[first]].view(np.int64)), pa.array(times)], ["word", "n"]))
            out.append(pa.StructArray.from_arrays([pa.array(n), pa.array(np.bincount(doc, known, b - a).astype(np.int64)), pa.array(base), pa.array(score), rare], fields=list(_PARTIAL_ARROW)))
        return pa.concat_arrays(out) if out else pa.array([], _PARTIAL_ARROW)

    return partial.asNondeterministic()


def _gains(shared):
    """What one more part of the tree adds to a text's score."""

    @arrow_udf("double")
    def gain(texts: pa.Array) -> pa.Array:
        t, out = shared.value, [np.empty(0)]
        for a, b in chunks(texts):
            s, doc, place = sequence(utf8(texts[a:b]))
            out.append(np.bincount(doc, np.log10(t.probabilities(s, place) / t.root(s)[0]), b - a))
        return pa.array(np.concatenate(out))

    return gain.asNondeterministic()


def score(docs: DataFrame, train: DataFrame, *, text: str = "text", **options) -> tuple[DataFrame, Model]:
    """``docs`` with n_tokens, n_known, base_score and score of each row, and the model."""
    spark = docs.sparkSession
    counts = stored(count_words(train, text), "words")
    model = learn(train, counts, text, **options)
    parts, cuts = model.parts(), model.cuts()
    passes = [(j, k) for j in range(cuts) for k in range(parts)]
    if cuts == 1:
        begin, listed, passes = model.part(0, parts), model.least, passes[1:]
    else:
        begin, listed = model.roots()
    names = ("n_tokens", "n_known", "base_score", "score")
    row, p, key, extra, log_rare, known_rare = fresh(docs, "row", "partial", "digest", "extra", "log_rare", "known_rare")
    kept = [c for c in docs.columns if c != text and c not in names]
    digest = F.md5(text_of(text).cast("binary")) if passes else F.lit("")
    tree = spark.sparkContext.broadcast(begin)
    done = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(key, digest).withColumn(p, _scores(tree)(F.col(text)))
    done = stored(done.select(*kept, row, key, p), "partials")
    # A word that is not in the training rows adds log10(0 + 1) = 0: an inner join is enough.
    rare = done.select(row, F.explode(f"{p}.rare").alias("r")).select(row, F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    of = rare.join(counts.where(F.col("c") < listed), "word").groupBy(row).agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias(log_rare), F.sum("n").alias(known_rare))
    out = done.join(of, row, "left").withColumn(log_rare, F.coalesce(log_rare, F.lit(0.0))).withColumn(extra, F.lit(0.0))
    for j, k in passes:  # a part's gain is one of the text alone
        tree = spark.sparkContext.broadcast(model.part(k, parts, j, cuts))
        gain = docs.select(digest.alias(key), _gains(tree)(F.col(text)).alias("gain")).groupBy(key).agg(F.first("gain").alias("gain"))
        out = out.join(stored(gain, "gains"), key).withColumn(extra, F.col(extra) + F.col("gain")).drop("gain")
    return out.select(
        *kept, F.col(p)["n_tokens"].alias("n_tokens"), (F.col(p)["n_known"] + F.coalesce(known_rare, F.lit(0))).alias("n_known"),
        (F.col(p)["base"] + F.col(log_rare)).alias("base_score"), (F.col(p)["score"] + F.col(log_rare) + F.col(extra)).alias("score"),
    ), model


def report(docs: DataFrame, *, modulus: int = 7, held: int = 2, **options) -> DataFrame:
    """Scores of every whole text; the rows whose id's checksum is ``held`` teach nothing."""
    d = docs.select("doc_id", (doc_crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), "text")
    out, model = score(d, d.where(~F.col("held_out")), **options)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
