"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: the base patterns, and looser
ones for spelled-out mail addresses, local telephone numbers, identity numbers, accounts,
long addresses of hosts and card numbers with a wrong digit. Base spans always stay. Each
further candidate is described by its format and its context, and boosted trees give it a
probability; a threshold for each kind, set on held-out examples for ``PRECISION``, selects.
Selected spans that overlap a base span, or a likelier one, are dropped.

No table holds labelled spans, so the trees learn from examples composed here from stated
templates (seeded; ``EXAMPLES`` of them): numbers of either sort in contexts of either sort.

Defined results: a null text counts as empty and has no spans; equal rows give equal spans;
of equally likely candidates that overlap the first one stays; a text of any length is scanned
whole, in time in proportion to its length and (nearly) to its candidates; an empty table gives
an empty one; columns of any other names stay as they are.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_words", "phone_local", "identity", "account", "host6", "card_wrong")
KINDS = BASE + ADDED
EXAMPLES, PRECISION = 6000, 0.97

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MORE = {
    "mail_words": re.compile(r"[A-Za-z0-9._+-]{2,40} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b"),
    "phone_local": re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|0[0-9]{2,4}|[0-9]{3})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9-])"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "host6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
#: Words near a span that speak for or against personal data.
FOR = ("call", "phone", "tel", "mobile", "fax", "contact", "ssn", "social", "identity", "account", "iban", "bank", "mail", "write", "reach", "card", "visa", "pay", "address", "host", "telefon", "konto", "correo")
AGAINST = ("order", "invoice", "version", "isbn", "part", "item", "serial", "ref", "page", "score", "total", "model", "lot", "sku", "section", "ticket", "build", "meeting", "look")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping for each kind, by kind, then start."""
    out = []
    # An address ends at its "@" on the left: so that sign is looked for, not every letter.
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """What the looser generators propose; spans of several kinds may overlap."""
    if not (_DIGIT.search(text) or " at " in text or "(at)" in text or "[at]" in text):
        return []
    out = [(m.start(), m.end(), kind) for kind, p in _MORE.items() for m in p.finditer(text)]
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and not luhn(d):
            out.append((m.start(), m.end(), "card_wrong"))
    return out


def _account_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, a: int, b: int, kind: str) -> list[float]:
    """Format and context of one candidate."""
    s = text[a:b]
    digits = [c for c in s if c.isdigit()]
    before, after = text[max(0, a - 40) : a].lower(), text[b : b + 25].lower()
    near = re.findall(r"[a-z]+", before)[-5:] + re.findall(r"[a-z]+", after)[:2]
    n_for = sum(any(w.startswith(f) for f in FOR) for w in near)
    n_against = sum(any(w.startswith(f) for f in AGAINST) for w in near)
    return [
        *[float(kind == k) for k in ADDED],
        float(len(s)), float(len(digits)), float(len(set(digits))), float(sum(c in " -.()" for c in s)),
        float(s[:1] in "(0"), float(kind == "card_wrong" and digits[:1] in (["4"], ["5"], ["3"], ["6"])),
        float(kind == "account" and _account_valid(s)), float(kind == "identity" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00"),
        float(n_for), float(n_against), float(bool(before[-2:].strip(" :=(") == "" and before)), float("." in after[:1]), float("#" in before[-3:]),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted stumps and small trees: each tree is (feature, cut, left, right) nested."""

    bias: float
    trees: tuple
    thresholds: dict[str, float]

    def probability(self, x: list[float]) -> float:
        z = self.bias
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            z += t
        return float(1 / (1 + np.exp(-z)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: float = 5.0):
    total, weight = grad.sum(), hess.sum()
    best = (0.2, None)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(h[cut] >= least) & (weight - h[cut] >= least)]
            if len(cut):
                gain = g[cut] ** 2 / (h[cut] + 1) + (total - g[cut]) ** 2 / (weight - h[cut] + 1) - total**2 / (weight + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    if best[1] is None:
        return float(rate * total / (weight + 1))
    f, at = best[1]
    low = x[:, f] <= at
    return (f, at, _grow(x[low], grad[low], hess[low], depth - 1, rate, least), _grow(x[~low], grad[~low], hess[~low], depth - 1, rate, least))


def _values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _values(tree[2], x[low]), _values(tree[3], x[~low])
    return out


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """(text, start, stop, kind, 1 if personal), composed from templates."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join("".join(r.choice("aeiounrstlhd") for _ in range(r.randint(2, 8))) for _ in range(r.randint(1, 4)))

    def account(valid: bool) -> str:
        head, body = r.choice(["DE", "FR", "GB", "ES", "NL"]), digits(16)
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        return f"{head}{check if valid else (check + r.randint(1, 80)) % 97:02d}{body}"

    make = {
        "mail_words": lambda good: f"{filler().replace(' ', '.')[:20]}{r.choice([' at ', ' (at) ', '[at]'])}{''.join(r.choice('abcdefgh') for _ in range(6))}{r.choice([' dot ', '[dot]'])}{r.choice(['com', 'org', 'net'])}" if good else f"{r.choice(['look', 'meeting', 'arrive', 'stop'])} at {r.choice(['noon', 'line', 'page'])} dot {r.choice(['one', 'two', 'matrix'])}",
        "phone_local": lambda good: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "identity": lambda good: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{digits(4)}" if good else r.choice([f"9{digits(2)}-{digits(2)}-{digits(4)}", f"{r.randint(100, 665)}-{digits(2)}-{digits(4)}"]),
        "account": account,
        "host6": lambda good: ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)),
        "card_wrong": lambda good: r.choice("4563") + digits(15) if good else digits(r.randint(13, 19)),
    }
    out = []
    for i in range(n):
        kind, good = ADDED[i % len(ADDED)], r.random() < 0.5
        bare = r.random() < 0.3  # no word speaks for or against it
        if kind == "card_wrong" and bare:
            good = False  # such a number is a card's only by what is said of it
        cue = "" if bare else r.choice(FOR if good else AGAINST)
        s = make[kind](good or kind == "card_wrong" and r.random() < 0.5)
        head = f"{filler()} {cue}{r.choice([' ', ': ', ' no ', ' # ' if not good else ' is '])}"
        text = f"{head}{s} {filler()}."
        found = [c for c in candidates(text) if c[2] == kind and c[0] < len(head) + len(s) and c[1] > len(head)]
        out += [(text, *c, int(good)) for c in found[:1]]
    return out


@lru_cache(maxsize=1)
def model(rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Trees:
    rows = examples()
    x = np.array([features(t, a, b, k) for t, a, b, k, _ in rows])
    y = np.array([r[4] for r in rows], float)
    learn = np.arange(len(y)) % 4 != 3  # the fourth sets the thresholds
    bias = float(np.log(y[learn].mean() / (1 - y[learn].mean())))
    z, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x[learn], (y - p)[learn], (p * (1 - p))[learn], depth, rate)
        trees.append(tree)
        z += _values(tree, x)
    p, thresholds = 1 / (1 + np.exp(-z)), {}
    for kind in ADDED:
        own = np.array([not t and r[3] == kind for t, r in zip(learn, rows)])
        order = np.argsort(-p[own])
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = float(max(0.5, p[own][order][ok[-1]])) if len(ok) else 1.1
    return Trees(bias, tuple(trees), thresholds)


class _Taken:
    """Disjoint stretches, sorted: whether one more is free is one search."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for a, b, _ in sorted(spans):
            if self.stops and a < self.stops[-1]:
                self.stops[-1] = max(b, self.stops[-1])
            else:
                self.starts.append(a)
                self.stops.append(b)

    def take(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        if k and self.stops[k - 1] > a:
            return False
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.stops.insert(k, b)
        return True


def spans_of(text: str, trees: Trees) -> list[tuple[int, int, str]]:
    """All spans: base ones, then those selected, by kind as listed, then start."""
    base = base_spans(text)
    taken = _Taken(base)
    scored = [(trees.probability(features(text, *c)), c) for c in candidates(text)]
    likely = sorted((s for s in scored if s[0] >= trees.thresholds[s[1][2]]), key=lambda s: (-s[0], s[1]))
    return sorted(base + [c for _, c in likely if taken.take(c[0], c[1])], key=lambda s: (KINDS.index(s[2]), s[0]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch that spans cover replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_TYPE = "array<struct<start:int,stop:int,kind:string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))


def find(text: Column, spark, trees: Trees | None = None) -> Column:
    """Array of spans in code points, end exclusive."""
    shared = spark.sparkContext.broadcast(trees or model())

    @arrow_udf(_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for i, j in chunks(texts):
            for t in texts[i:j].to_pylist():
                out.append([{"start": a, "stop": b, "kind": k} for a, b, k in spans_of(t or "", shared.value)])
        return pa.array(out, _ARROW)

    return scan.asNondeterministic()(text)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    found = docs.select("doc_id", find(F.col("text"), docs.sparkSession, **options).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; other columns as given."""
    shared = docs.sparkSession.sparkContext.broadcast(trees or model())

    @arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for i, j in chunks(texts):
            out += [t and masked(t, spans_of(t, shared.value)) for t in texts[i:j].to_pylist()]
        return pa.array(out, pa.string())

    return docs.withColumn(text, mask.asNondeterministic()(F.col(text)))
