"""Token ids and token counts of a byte-level BPE vocabulary, batch by batch.

The vocabulary is read from its ``tokenizers`` file. Batches are encoded by ``tiktoken``'s
batch call, with ranks taken from that file (in such a vocabulary the rank of a merge is the
id of what it makes, which is checked when the file is loaded; where that doesn't hold, or
the file has other steps, ``tokenizers``' own batch call is used). Special strings inside a
text become their id, as is the library's default. Results are equal to the library's.

Each Arrow batch is cut into groups of near equal UTF-8 bytes, one library call each. Texts
over ``SPLIT`` characters are first split at safe boundaries, where a token always begins; a
run of one class of characters without any such place (letters alone, say) stays whole. So a
call holds about ``GROUP`` bytes, whatever the lengths of the texts.

Defined results: a null or empty text has no tokens; equal rows give equal counts; an empty
table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, text_of

#: Characters from which a text is split; bytes of a library call.
SPLIT, GROUP = 1 << 16, 1 << 18
# Fixed value: the pre-tokeniser's pattern of byte-level BPE vocabularies (possessive form).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# Safe boundaries: before a blank between two letters, and where a run of letters, digits or
# signs ends. (After an apostrophe no token need begin: it may be part of "'s".)
_LETTER, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3", r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
_SAFE = re.compile(f"(?<=[{_LETTER}])(?= [{_LETTER}]|[0-9{_SIGNS}])|(?<=[0-9])(?=[{_LETTER}{_SIGNS}])|(?<=[{_SIGNS}])(?=[{_LETTER}0-9])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain_special = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
        merged = {"".join(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model.get("merges", []))}
        ids = sorted(model["vocab"][w] for w in merged if w in model["vocab"])
        in_order = len(ids) == len(merged) and [model["vocab"][w] for w in merged] == ids
        simple = model["type"] == "BPE" and not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges")
        self.fast = None
        self.special = special
        if simple and in_order and plain_special:
            import tiktoken

            alphabet = _byte_alphabet()
            ranks = {bytes(alphabet[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    def batch(self, texts: list[str]) -> list:
        """The ids of each text, by one call of the library."""
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return self.fast.encode_batch(texts, num_threads=1, allowed_special="all")

    def split(self, text: str, size: int = SPLIT) -> list[str]:
        """Pieces whose tokens, one after another, are the whole text's."""
        out, at, seek = [], 0, size
        while self.fast is not None and len(text) - at > size:
            m = _SAFE.search(text, seek)
            if not m:
                break
            cut = m.start()
            if any(text.find(s, max(at, cut - len(s) + 1), cut + len(s) - 1) >= 0 for s in self.special):
                seek = cut + 1
                continue
            out.append(text[at:cut])
            at, seek = cut, cut + size
        out.append(text[at:] if at else text)
        return out

    def groups(self, texts: list[str]):
        """(positions, pieces) of each library call: groups of near equal bytes."""
        pieces = [(i, p) for i, t in enumerate(texts) for p in (self.split(t) if len(t) > SPLIT else [t])]
        for group in balanced([len(p.encode()) for _, p in pieces], GROUP):
            yield group, [pieces[k][0] for k in group], [pieces[k][1] for k in group]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for _, of, pieces in self.groups(texts):
            for i, ids in zip(of, self.batch(pieces)):
                out[i] += len(ids)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list] = [[] for _ in texts]
        for order, of, pieces in self.groups(texts):
            for k, i, ids in zip(order, of, self.batch(pieces)):
                parts[i].append((k, np.array(ids, "<u4")))
        return [p[0][1] if len(p) == 1 else np.concatenate([ids for _, ids in sorted(p, key=lambda x: x[0])]) for p in parts]


def balanced(sizes: list[int], target: int) -> list[list[int]]:
    """Groups of positions with sums near ``target``: the largest first, each to the lightest."""
    import heapq

    n = max(1, -(-sum(sizes) // target))
    heap = [(0, g) for g in range(n)]
    groups: list[list[int]] = [[] for _ in range(n)]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        total, g = heapq.heappop(heap)
        groups[g].append(k)
        heapq.heappush(heap, (total + sizes[k], g))
    return [g for g in groups if g]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process; the file is installed beside the libraries."""
    return Vocabulary(path)


def token_count(text: Column, path: str | None = None) -> Column:
    path = path or default_vocabulary()

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        v, out = vocabulary(path), []
        for a, b in chunks(texts):
            out += v.counts([t or "" for t in texts[a:b].to_pylist()])
        return pa.array(out, pa.int64())

    return count.asNondeterministic()(text)


def report(docs: DataFrame, *, path: str | None = None, limit: int = 1024) -> DataFrame:
    """Token count of every whole text; a null text counts as empty (no tokens)."""
    n = docs.select("doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
