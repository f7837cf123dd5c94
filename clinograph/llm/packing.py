"""Packing of tokenised documents into fixed windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows.  Whole windows are cut off a long document;
what is left goes into the open window that it fills best.  Where none has room, the fullest is
emitted and a new one opened.  Windows still open at the end of a partition carry their ids along;
those of neighbouring partitions are merged by refilling, which cuts freely.
"""
from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import durable, to_arrow
from .token_counts import byte_symbols

#: Entries a worker keeps per memo before it starts anew; memory only.
MEMO = 500_000
#: Printable ASCII and the precomposed letters of Latin-1: here lower-casing is one to one and NFC changes nothing.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
# The published split pattern of the vocabulary, over those characters.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Memo(dict):
    """key -> little-endian ids, made on first use by `make`."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(self) >= MEMO:
            self.clear()
        if len(key) < 256:
            self[key] = ids
        return ids


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens.

    The vocabulary drops white space, so blanks and line feeds part a text into chunks that encode
    alone.  A chunk of plain characters is split here and its words go through the library's model;
    any other chunk goes through the whole library.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        symbol = byte_symbols()
        model = self.library.model
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        hint = next((s for n in range(4, 1, -1) for s in {special[0][-n:]} if special and all(s in x for x in special)), "") if special else None

        def of_word(word: str) -> bytes:
            mapped = "".join([symbol[b] for b in word.encode()])
            return np.array([t.id for t in model.tokenize(mapped)], "<u4").tobytes()

        words = Memo(of_word)

        def of_chunk(chunk: str) -> bytes:
            if PLAIN.fullmatch(chunk) and (hint is None or hint not in chunk):
                return b"".join(map(words.__getitem__, WORD.findall(chunk.lower())))
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

        self.memo = Memo(of_chunk)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    return WordEncoder(path)


class Windows:
    """At most `most` open windows of `capacity` ids; pieces are (row fields, ids)."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def open(self) -> int:
        self.opened += 1
        self.pieces[self.opened - 1] = []
        return self.opened - 1

    def add(self, piece, size: int) -> Iterator[tuple[int, list]]:
        """Places a piece and yields the windows that are done by that."""
        at = bisect_left(self.free, (size, -1))
        if size == self.capacity:
            window = self.open()
            room = size
        elif at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                yield fullest, self.pieces.pop(fullest)
            window, room = self.open(), self.capacity
        self.pieces[window].append(piece)
        if room == size:
            yield window, self.pieces.pop(window)
        else:
            insort(self.free, (room - size, window))

    def rest(self) -> Iterator[tuple[int, list]]:
        for _, window in self.free:
            yield window, self.pieces.pop(window)
        self.free = []


def cut(size: int, capacity: int) -> Iterable[tuple[int, int]]:
    """(start, length) of a document's whole windows, then of what is left."""
    return ((start, min(capacity, size - start)) for start in range(0, size, capacity))


def pack(docs: DataFrame, path: str, capacity: int = 4096, open_windows: int = 32, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", merge_partitions: int = 16, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A document's ids are those of the tokenizer file at `path`, then end_id; a null or empty text
    has end_id alone.  Sequences hold at most `capacity` ids and are to be padded to it.  Ids and
    repeated rows are carried through; sequence_id is unique, not gapless.  One scan makes and
    places all pieces and is written once; only what is left of open windows is shuffled, at most
    open_windows * capacity ids a partition, merge_partitions partitions to a task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def batch_of(id_type: pa.DataType, rows: list[tuple], open_parts: bool, merged: bool) -> pa.RecordBatch:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
        types = [id_type, *[pa.int64()] * 7, pa.binary()]
        return to_arrow(pa.schema(list(zip(names, types))[: 7 if merged and not keep_ids else 9]), **{n: [r[k] for r in rows] for k, n in enumerate(names)})

    def placed(part: int, window: int, pieces: list, left: bool) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, tokens, ids in pieces:
            length = len(ids) // 4
            rows.append((doc, start, length, zlib.crc32(ids), tokens, part << 33 | window, offset, part if left else -1, bytes(ids) if left or keep_ids else None))
            offset += length
        return rows

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, part = encoder(path), Windows(capacity, open_windows), TaskContext.get().partitionId()
        rows, id_type = [], None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encode(text or "") + end)
                tokens = len(ids) // 4
                for start, length in cut(tokens, capacity):
                    for window, pieces in windows.add((doc, start, tokens, ids[4 * start : 4 * (start + length)]), length):
                        rows += placed(part, window, pieces, False)
                if len(rows) >= 4096:
                    yield batch_of(id_type, rows, False, False)
                    rows = []
        for window, pieces in windows.rest():
            rows += placed(part, window, pieces, True)
        if rows:
            yield batch_of(id_type, rows, True, False)

    def refill(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py() // merge_partitions
        order = sorted(zip(table.column("sequence_id").to_pylist(), table.column("offset").to_pylist(), range(table.num_rows)))
        ids_of, rows, window, used = table.column("ids"), [], 0, 0
        own = {n: table.column(n).to_pylist() for n in ("id", "start", "doc_tokens")}
        for _, _, k in order:
            ids, start = ids_of[k].as_py(), own["start"][k]
            while ids:
                take = min(len(ids) // 4, capacity - used)
                rows.append((own["id"][k], start, take, zlib.crc32(ids[: 4 * take]), own["doc_tokens"][k], 1 << 62 | group << 33 | window, used, -1, ids[: 4 * take]))
                ids, start, used = ids[4 * take :], start + take, used + take
                if used == capacity:
                    window, used = window + 1, 0
        return pa.Table.from_batches([batch_of(table.schema.field("id").type, rows, False, True)])

    pieces = durable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(first, f"{columns}, part long, ids binary"), "pack-pieces")
    extra = ["part", "ids"] if keep_ids else []
    done = pieces.where("part < 0").select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *extra)
    left = pieces.where("part >= 0").groupBy(F.floor(F.col("part") / merge_partitions).alias("merge_group")).applyInArrow(refill, columns + (", part long, ids binary" if keep_ids else ""))
    out = done.unionByName(left).withColumnRenamed("id", id_col)
    return out.drop("part") if keep_ids else out
