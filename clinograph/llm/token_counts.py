"""Token counts of a byte-level BPE vocabulary by merging alone.

A pre-token starts as a doubly linked list of byte symbols.  A heap holds the adjacent pairs by
(rank, position); the lowest is popped and merged again and again.  The count is the number of
initial symbols minus the number of merges, so no identifier is ever made.
"""
from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_arrow

# The published split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The characters of Unicode's White_Space property.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A cut before white space that follows something else never falls inside a match of SPLIT, and
#: what stands left of it doesn't change what matches on the right.
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Entries a worker keeps per memo before it starts anew; memory only, the counts are the same.
MEMO = 500_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def rank_table(pairs: list[tuple[str, str]]) -> tuple[list[int], dict[int, int], list[int]]:
    """Symbols as numbers: that of each byte, {left << 32 | right: rank}, and what each rank merges into."""
    number: dict[str, int] = {}
    symbol = byte_symbols()
    first = [number.setdefault(symbol[b], len(number)) for b in range(256)]
    rank, into = {}, []
    for left, right in pairs:
        key = number.setdefault(left, len(number)) << 32 | number.setdefault(right, len(number))
        rank.setdefault(key, len(into))
        into.append(number.setdefault(left + right, len(number)))
    return first, rank, into


def merges_of(symbols: list[int], rank: dict[int, int], into: list[int]) -> int:
    """The number of merges that the ranks allow in this list of symbols; ties go to the leftmost pair."""
    n = len(symbols)
    get = rank.get
    best = [get(symbols[i] << 32 | symbols[i + 1], -1) for i in range(n - 1)]  # rank of the pair that starts here
    heap = [r << 32 | i for i, r in enumerate(best) if r >= 0]
    if not heap:
        return 0
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    best.append(-1)
    merged = 0
    while heap:
        entry = heappop(heap)
        i, r = entry & 0xFFFFFFFF, entry >> 32
        if best[i] != r:
            continue  # one of the two has been merged since
        j = after[i]
        k = after[i] = after[j]
        best[j] = -1
        merged += 1
        new = symbols[i] = into[r]
        if k < n:
            before[k] = i
            best[i] = r = get(new << 32 | symbols[k], -1)
            if r >= 0:
                heappush(heap, r << 32 | i)
        else:
            best[i] = -1
        h = before[i]
        if h >= 0:
            best[h] = r = get(symbols[h] << 32 | new, -1)
            if r >= 0:
                heappush(heap, r << 32 | h)
    return merged


class Memo(dict):
    """key -> count, made on first use by `make`."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        count = self.make(key)
        if len(self) >= MEMO:
            self.clear()
        if len(key) < 256:
            self[key] = count
        return count


class TokenCounter:
    """Counts the tokens of whole texts by a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        first, rank, into = rank_table(pairs)

        def of_word(word: str) -> int:
            symbols = [first[b] for b in word.encode()]
            return len(symbols) - merges_of(symbols, rank, into)

        split = regex.compile(SPLIT.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        words = self.words = Memo(of_word)
        self.memo = Memo(lambda segment: sum(map(words.__getitem__, split.findall(segment))))
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def __call__(self, text: str) -> int:
        """The library's default takes each special string in a text as one token."""
        parts = [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, SEGMENT.findall(part))) for part in parts)


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One counter per Python worker, so that its memo outlives a task."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs.

    path: the tokenizer file, which must lie at the same place on every node.  A null text counts
    as empty (0 bytes, 0 tokens).  Null and repeated ids are carried through row by row.  Rows are
    independent, so the plan is one scan without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter(t) for t in texts]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            schema = pa.schema([("id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield to_arrow(schema, id=batch.column(0), n_bytes=sizes.cast(pa.int64()), n_tokens=counts)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
