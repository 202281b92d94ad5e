"""Secret scanning through a trigram inverted index, in DataFrame functions alone.

From the parsed form of each rule's regular expression a Boolean query over trigrams is
derived, as alternatives of trigrams that must all be there: every match holds one of them.
The index lists for each trigram that some query needs the texts that hold it, by a 64-bit
hash of the text (``postings``; a text that occurs a million times is one posting, and two
texts of one hash can only make more candidates, never fewer). Postings of an alternative's
trigrams are intersected, those of a rule's alternatives united. Only the candidates of a
rule run its expression, over the whole text; a rule from which no trigram follows scans every
text. Candidates (a hash and a bit mask) are broadcast only while they are fewer than
``BROADCAST``, else joined by hash.

Spans are leftmost and non-overlapping for each rule, as code points, end exclusive. Their
places are running sums over matches and what lies between, made in chunks, so that a text's
time grows with its length and spans and not with their square.

Defined results: a null text counts as empty and has no spans; equal rows give equal spans;
spans of several rules may overlap or be equal, and are ordered by start, then rule; a text of
any length is scanned whole; an empty table gives an empty one; columns of any other names
stay as they are.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, stored, text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds of the contract, in their order, then those that the method adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a maximal run of 16 or more is a match of [0-9a-f]+ that counts
)
ADDED = (
    Rule("temporary", r"ASIA[A-Z0-9]{16,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE + ADDED

#: Candidates (some 20 bytes each) that are broadcast at most.
BROADCAST = 2_000_000
_MANY = 64  # strings that a set of alternatives may hold before it counts as unknown

#: A query: None (always true), a trigram, or ("and" | "or", (query, ...)).
Query = object


def _all(parts: list) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> Query:
    if not parts or None in parts:
        return None
    parts = list(dict.fromkeys(parts))
    # An alternative that another one follows from says nothing: only the weaker stays.
    terms = {p: {p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else None for p in parts}
    parts = [p for p in parts if terms[p] is None or not any(t is not None and t < terms[p] for t in terms.values())]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(text: str) -> Query:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def trigram_query(pattern: str) -> Query:
    """The trigrams (lower-case ASCII) that every match of ``pattern`` holds."""

    def flush(known: set[str], out: list) -> None:
        out.append(_any([_grams(s) for s in sorted(known)]))

    def known_of(items) -> tuple[set[str] | None, Query]:
        """All strings that the items match if these are few, and what else must hold."""
        known, must, whole = {""}, [], True
        for op, arg in items:
            strings, query = one(op, arg)
            must.append(query)
            if strings is not None and len(known) * len(strings) <= _MANY:
                known = {a + b for a, b in product(known, strings)}
            else:
                flush(known, must)
                known, whole = strings or {""}, False
        if whole:
            return known, _all(must)
        flush(known, must)
        return None, _all(must)

    def one(op, arg) -> tuple[set[str] | None, Query]:
        if op is sre.LITERAL:
            return ({chr(arg).lower()} if arg < 128 else None), None
        if op is sre.IN:
            found: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL and value < 128:
                    found.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                    found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None, None
            return (found if len(found) <= 8 else None), None
        if op is sre.SUBPATTERN:
            return known_of(arg[3])
        if op is sre.BRANCH:
            parts = [known_of(x) for x in arg[1]]
            if all(k is not None for k, _ in parts):
                return set().union(*(k for k, _ in parts)), None
            return None, _any([_all([q, _any([_grams(s) for s in sorted(k)]) if k else None]) for k, q in parts])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            low, high, inner = arg
            known, query = known_of(inner)
            if known is not None and high == 1:
                return known | {""}, None
            if low and known is not None:
                # Of several strings any may follow any: only those of one string are sure.
                return None, _all([query, _any([_grams(s * low if len(known) == 1 else s) for s in sorted(known)])])
            return None, query if low else None
        if op is sre.AT:
            return {""}, None
        return None, None

    strings, query = known_of(parser.parse(pattern))
    if strings is not None:
        query = _all([query, _any([_grams(s) for s in sorted(strings)])])
    return query


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def alternatives(query: Query) -> list[frozenset[str]]:
    """The query as alternatives, each of trigrams that must all be there; none: always true."""
    if query is None:
        return []
    if isinstance(query, str):
        return [frozenset([query])]
    parts = [alternatives(q) for q in query[1]]
    if query[0] == "or":
        return sorted({a for p in parts for a in p}, key=sorted)
    out = [frozenset()]
    for p in parts:
        # Past some hundred alternatives a part is left out: more candidates, none lost.
        out = [a | b for a, b in product(out, p)] if len(out) * len(p) <= 4 * _MANY else out
    return sorted({a for a in out if not any(b < a for b in out)}, key=sorted)


def needed(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(a for r in rules for a in alternatives(trigram_query(r.pattern)))))


def _any_of(grams: list[str]) -> str:
    """An expression that finds every place where one of the trigrams begins."""
    tree: dict[str, dict[str, list[str]]] = {}
    for g in grams:
        tree.setdefault(g[0], {}).setdefault(g[1], []).append(g[2])
    quote = lambda c: "\\" + c if not c.isalnum() and c != "_" else c
    ends = lambda x: f"[{''.join(map(quote, x))}]"
    second = lambda x: "|".join(quote(c) + ends(x[c]) for c in x)
    return "(?=(" + "|".join(f"{quote(c)}(?:{second(x)})" for c, x in tree.items()) + "))"


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """(trigram, key): the index, one row for each text (by hash) and trigram that it holds."""
    grams = needed(rules)
    if not grams:
        return docs.select(F.lit("").alias("trigram"), F.lit(0).cast("long").alias("key")).limit(0)
    # Only A-Z need folding, but lower() is what Spark has; ASCII trigrams are not harmed.
    low = F.lower(text_of(text))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(_any_of(grams)), F.lit(1)))
    return docs.select(F.xxhash64(text_of(text)).alias("key"), F.explode(found).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): texts that may match, and the rules in question as bits.

    Intersection: an alternative's trigrams are numbered, and a key has them all when the
    bits of its postings are all set, a sum that is combined before it is shuffled."""
    rows = []
    for rank, r in enumerate(rules):
        for k, grams in enumerate(alternatives(trigram_query(r.pattern))):
            of = sorted(grams)[:62]
            rows += [(g, 1 << rank, k, 1 << i, (1 << len(of)) - 1) for i, g in enumerate(of)]
    names = ("trigram", "rule", "alternative", "bit", "every")
    if not rows:
        return index.select("key", F.lit(0).cast("long").alias("rules")).limit(0)
    table = F.array(*[F.struct(*[F.lit(v).cast("string" if n == "trigram" else "bigint").alias(n) for n, v in zip(names, r)]) for r in rows])
    wanted = index.sparkSession.range(1).select(F.inline(table))
    hits = index.join(F.broadcast(wanted), "trigram").groupBy("key", "rule", "alternative", "every").agg(F.bit_or("bit").alias("bits"))
    return hits.where("bits = every").groupBy("key").agg(F.bit_or("rule").alias("rules"))


_SPAN = "struct<start:int,stop:int,kind:string,rank:int,from:int,to:int>"


def _running(values: Column, step, first: int = 0) -> Column:
    """array<int>: what ``step`` has made of ``first`` and the values before each place.

    Results are gathered in chunks of about a square root, so no long array is copied for
    each of its elements."""
    none = F.array().cast("array<int>")
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values))).cast("int"))
    parts = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(1), F.size(values), size), lambda i: F.slice(values, i, size))).otherwise(F.array().cast("array<array<int>>"))
    start = lambda at, of: F.struct(at.cast("int").alias("at"), F.array().cast(of).alias("out"))
    one = lambda acc, v: F.struct(step(acc["at"], v).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    inner = lambda at, chunk: F.aggregate(chunk, start(at, "array<int>"), one)
    outer = lambda acc, chunk: let(inner(acc["at"], chunk), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))
    return F.coalesce(F.flatten(F.aggregate(parts, start(F.lit(first), "array<array<int>>"), outer)["out"]), none)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, in code points (start, stop) and in bytes (from, to)."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def of(found: Column) -> Column:
        grouped = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
        sizes = F.transform(F.arrays_zip(found.alias("m"), grouped.alias("g"), gaps.alias("b")), lambda r: F.struct(F.length(r["m"]).alias("n"), F.length(r["g"]).alias("g"), F.length(r["b"]).alias("b"), F.octet_length(r["m"]).alias("on"), F.octet_length(r["b"]).alias("ob")))

        def placed(z: Column) -> Column:
            add = lambda at, v: at + v
            at = _running(F.transform(z, lambda r: r["n"] + r["b"]), add)
            byte = _running(F.transform(z, lambda r: r["on"] + r["ob"]), add)
            every = F.transform(F.arrays_zip(z.alias("z"), at.alias("at"), byte.alias("byte")), lambda r: F.struct(
                (r["at"] + r["z"]["b"]).alias("start"), (r["at"] + r["z"]["b"] + r["z"]["n"]).alias("stop"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"),
                (r["byte"] + r["z"]["ob"]).alias("from"), (r["byte"] + r["z"]["ob"] + r["z"]["on"]).alias("to"), r["z"]["g"].alias("g")))
            return F.filter(every, lambda r: r["g"] >= rule.least) if rule.least else every

        out = F.transform(let(sizes, placed), lambda r: F.struct(*[r[c].alias(c) for c in ("start", "stop", "kind", "rank", "from", "to")]))
        return F.when(F.size(found) > 0, out.cast(f"array<{_SPAN}>")).otherwise(none)

    return let(found, of)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", broadcast: int = BROADCAST) -> tuple[DataFrame, str]:
    """``docs`` with an array of spans (start, stop, kind, rank, from, to) by start, then by rule."""
    plain, spans, key, mask = fresh(docs, "plain", "spans", "key", "rules")
    found = stored(candidates(postings(docs, rules, text=text), rules), "candidates").select(F.col("key").alias(key), F.col("rules").alias(mask))
    if found.count() <= broadcast:
        found = F.broadcast(found)
    d = docs.withColumn(plain, text_of(text)).withColumn(key, F.xxhash64(plain)).join(found, key, "left")
    none = F.array().cast(f"array<{_SPAN}>")
    free = {i for i, r in enumerate(rules) if not alternatives(trigram_query(r.pattern))}
    of = lambda i, r: _spans(F.col(plain), r, i) if i in free else F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, _spans(F.col(plain), r, i)).otherwise(none)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
    every = let(F.concat(*[of(i, r) for i, r in enumerate(rules)]), lambda x: F.when(F.size(x) > 1, F.array_sort(x, order)).otherwise(x))
    return d.withColumn(spans, every).select(*docs.columns, spans), spans


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    found, name = scan(docs.select("doc_id", "text"), rules)
    count = lambda kind: F.size(F.filter(F.col(name), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(F.col(name), lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col(name)).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with each stretch that spans cover replaced by ``mark``; other columns as given."""
    found, name = scan(docs, rules, text=text, **options)
    (raw,) = fresh(found, "raw")
    # Pieces are cut from the bytes: a place in them is reached without reading what is before it.
    ends = _running(F.transform(name, lambda s: s["to"]), F.greatest)
    piece = lambda a, b: F.col(raw).substr(a + 1, b - a).cast("string")
    between = F.transform(F.arrays_zip(F.col(name).alias("s"), ends.alias("at")), lambda r: F.when(r["s"]["from"] >= r["at"], F.concat(piece(r["at"], r["s"]["from"]), F.lit(mark))))
    last = F.array_max(F.transform(name, lambda s: s["to"]))
    new = F.concat(F.array_join(between, ""), piece(last, F.length(raw)))
    new = F.when(F.size(name) > 0, new).otherwise(F.col(text))
    return found.withColumn(raw, F.col(text).cast("binary")).withColumn(text, new).select(*docs.columns)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same by plain scans: what lies between the matches, split by the expression."""
    parts = []
    for rank, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
      SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank,
             unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(list_slice(gap, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))) AS start,
             unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(g, lambda x: length(x))) AS len
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS g, string_split_regex(text, '{p}') AS gap
            FROM d WHERE regexp_matches(text, '{p}'))""")
    keep = " OR ".join(f"(rank = {i} AND len >= {r.least})" for i, r in enumerate(rules))
    sums = ", ".join(f"count(s.kind) FILTER (s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT *, kind || ':' || cast(start AS bigint) || ':' || cast(start + n AS bigint) AS span FROM ({" UNION ALL ".join(parts)}) WHERE {keep})
    SELECT d.doc_id, {sums},
           sha256(coalesce(string_agg(s.span, ',' ORDER BY s.start, s.rank) FILTER (s.rank < {len(BASE)}), '')) AS base_sha256,
           coalesce(string_agg(s.span, ',' ORDER BY s.start, s.rank) FILTER (s.kind IS NOT NULL), '') AS spans
    FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
