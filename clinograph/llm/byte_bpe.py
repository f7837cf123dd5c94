"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""
from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_arrow

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: Matches longer than this many bytes are merged by the heap below, whose time isn't quadratic.
LONG_MATCH = 2048
#: A letter or digit, then a blank or line feed: every match of the pattern ends before white space
#: that follows something else, and none looks back, so both sides encode as they do together.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe boundaries, each piece as short as they allow beyond `most` characters."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class ByteBpe:
    """Encodes and decodes by a rank file, without special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.long_run = regex.compile(r"[^\s]{%d,}|\s{%d,}" % (LONG_MATCH // 4, LONG_MATCH // 4))
        self.decimal = {r: str(r) for r in self.ranks.values()}

    def encode(self, text: str) -> list[int]:
        try:
            text.encode()
        except UnicodeEncodeError:  # lone surrogates, as the library does
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if len(text) <= PIECE_CHARS and not self.long_run.search(text):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text):
            if not self.long_run.search(piece):
                ids += self.encoding.encode_ordinary(piece)
                continue
            for part, alone in self.matches(piece):
                ids += self.merge(part.encode()) if alone else self.encoding.encode_ordinary(part)
        return ids

    def matches(self, piece: str) -> Iterator[tuple[str, bool]]:
        """Runs of short matches joined, and on its own each long match and white space right before it.

        A run encodes as it does in the whole text: the pattern looks ahead from white space only.
        """
        start = end = last = 0
        for match in self.pattern.finditer(piece):
            if match.end() - match.start() > LONG_MATCH // 4:
                if start < match.start():
                    blank = piece[last : match.start()].isspace()
                    if start < (cut := last if blank else match.start()):
                        yield piece[start:cut], False
                    if blank:
                        yield piece[last : match.start()], True
                yield match.group(), True
                start = match.end()
            elif match.start() - start > PIECE_CHARS and SAFE.match(piece, match.start()):
                yield piece[start : match.start()], False
                start = match.start()
            last, end = match.start(), match.end()
        if start < end:
            yield piece[start:end], False

    def merge(self, word: bytes) -> list[int]:
        """The ids of one match: the adjacent pair of lowest rank, leftmost first, merges until none can."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.ranks.get

        def rank(i: int) -> int:
            return -1 if end[i] >= n else get(word[i : end[end[i]]], -1)

        best = [rank(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(best) if r >= 0]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if best[i] != r:
                continue
            j = after[i]
            best[j] = -1
            after[i] = end[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    best[k] = rank(k)
                    if best[k] >= 0:
                        heappush(heap, (best[k], k))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per Python worker."""
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) for each row; a null text is empty and has no ids.

    One scan without a shuffle; path must name the rank file on every node.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("ids", pa.list_(pa.int32()))])
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield to_arrow(schema, id=part.column(0), ids=[bpe.encode(t or "") for t in part.column(1).to_pylist()])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the raw decoded bytes of each row; null ids decode to nothing."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("data", pa.binary())])
            yield to_arrow(schema, id=batch.column(0), data=[bpe.decode(x or []) for x in batch.column(1).to_pylist()])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, data binary")
    return out.select(F.col("id").alias(id_col), "data")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row: encodes, then decodes what was encoded.

    A null text is empty (0 tokens, the digests of nothing).  Both steps run in one pass over a
    batch, so that id lists never leave the worker that made them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        text_of, sha = bpe.decimal.__getitem__, hashlib.sha256
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(text_of, ids)).encode()).hexdigest())
                of_bytes.append(sha(bpe.decode(ids)).hexdigest())
            schema = pa.schema([("id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
            yield to_arrow(schema, id=batch.column(0), n_tokens=counts, ids_sha256=of_ids, decoded_sha256=of_bytes)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
