"""Exact top-k inner products over a bit-sliced index.

A block of rows stores each attribute, shifted to be non-negative, as bitmaps of its highest bits.
For a query, the slices of all attributes (complemented where the query's value is negative) are
added with full adders on whole bitmaps, which gives the bitmaps of the quantised scores.  Walking
those from the most significant slice downward finds the k-th best quantised score; the rows whose
score may still reach it are the boundary, and their exact products decide.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import to_arrow

#: What sums of squared components stay under, so that scores fit a long; a little is left for rounding.
MOST = float(2**63 - 2**40)


def spread(bitmap: np.ndarray) -> np.ndarray:
    """The positions of a bitmap's ones."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Flags (..., rows) packed in 64-bit words along the last axis."""
    rows = flags.shape[-1]
    full = np.zeros((*flags.shape[:-1], -(-max(rows, 1) // 64) * 64), np.uint8)
    full[..., :rows] = flags
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


class Block:
    """The index of a block of rows sorted by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, low: int, bits: int, slices: int, packed: bytes | None = None) -> None:
        self.ids, self.values, self.low, self.bits = ids, values, low, bits
        self.slices = min(bits, slices)
        self.shift = bits - self.slices
        rows, dims = values.shape
        if packed is None:
            top = ((values - low) >> self.shift).T
            self.slice = np.stack([bitmaps((top >> i) & 1) for i in range(self.slices)], axis=1) if rows else np.zeros((dims, self.slices, 1), np.uint64)
        else:
            self.slice = np.frombuffer(packed, np.uint64).reshape(dims, self.slices, -1)
        self.inverse = ~self.slice
        self.all = bitmaps(np.ones(rows, np.uint8))

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """The bitmaps of the quantised scores, least significant first."""
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            source, q, j = (self.slice if q > 0 else self.inverse)[d], abs(q), 0
            while q:
                if q & 1:
                    while len(columns) < j + self.slices:
                        columns.append([])
                    for i in range(self.slices):
                        columns[i + j].append(source[i])
                q, j = q >> 1, j + 1
        out, w = [], 0
        while w < len(columns):
            column = columns[w]
            if len(column) > 1 and w + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                carry = a & b
                carry |= half & c
                half ^= c
                column.insert(0, half) if len(column) < 8 else column.append(half)
                columns[w + 1].append(carry)
            if len(column) == 2:
                a, b = column
                columns[w + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.all))
            w += 1
        return out

    def top(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows but the query's own; ties go to the smaller id."""
        rest = self.all.copy()
        if own is not None:
            for at in range(*np.searchsorted(self.ids, [own, own + 1])):
                rest[at >> 6] &= ~np.uint64(1 << (at & 63))
        if int(np.bitwise_count(rest).sum()) > k:
            score, chosen, tied, kth = self.add(query), np.zeros_like(rest), rest, 0
            for w in reversed(range(len(score))):  # the k-th best quantised score
                with_bit = tied & score[w]
                if int(np.bitwise_count(chosen | with_bit).sum()) >= k:
                    tied, kth = with_bit, kth | 1 << w
                else:
                    chosen, tied = chosen | with_bit, tied & ~score[w]
            lost = ((1 << self.shift) - 1) * int(np.abs(query).sum()) >> self.shift
            least = max(0, kth - lost)
            above, equal = np.zeros_like(rest), rest
            for w in reversed(range(len(score))):  # rows that may still reach it
                if least >> w & 1:
                    equal = equal & score[w]
                else:
                    above, equal = above | (equal & score[w]), equal & ~score[w]
            rest = above | equal
        rows = spread(rest)
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return scores[best], self.ids[rows[best]]


def components(vectors: pa.Array) -> tuple[np.ndarray, int]:
    """Integer components of a list column, shorter vectors filled up with zeros."""
    lists = [np.asarray(v, np.float64) for v in vectors.to_pylist()]
    dims = max((len(v) for v in lists), default=0)
    out = np.zeros((len(lists), dims), np.int64)
    for k, v in enumerate(lists):
        out[k, : len(v)] = np.floor(64 * v)
    return out, dims


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v: rows with an id and a vector whose components are all finite."""
    v = F.col(vec_col)
    if rows.schema[vec_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def top_k(rows: DataFrame, k: int = 20, every: int = 20, slices: int = 5, block_rows: int = 16384, chunk_queries: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; shorter vectors count as filled up with zeros.  Vectors so long that a score may not fit a
    long raise ValueError.  A row that stands twice is two candidates but one query.

    Every row is indexed, in blocks of about block_rows, dealt out by the hash of id and vector; of
    equal rows k are kept, as no more can be among the best.  A block goes to one task (to a few
    where there are fewer blocks than cores) and stays there; the queries come to it in chunks, one
    after the other, and it returns at most k rows a query.
    """
    spark = rows.sparkSession
    good = usable(rows, id_col, vec_col)
    scaled = lambda x: F.floor(64 * x.cast("double"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(scaled(x).cast("double"), 2))
    extent = good.agg(F.max(squares).alias("squares"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("id") % every == 0, 1).otherwise(0)).alias("q"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"), F.max(F.size("v")).alias("dims")).first()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not extent["n"] or not extent["q"]:
        return spark.createDataFrame([], out_schema)
    if extent["squares"] >= MOST:  # no product of two vectors is larger than the larger one's with itself
        raise ValueError("components too large: scores would not fit a long")
    low, high = (int(np.floor(64 * (x or 0.0))) for x in (extent["lo"], extent["hi"]))
    low, high = min(low, 0), max(high, 0)
    bits, dims = max(1, (high - low).bit_length()), extent["dims"]
    kind = np.int32 if -(2**31) <= low and high < 2**31 else np.int64
    blocks, chunks = -(-extent["n"] // block_rows), -(-extent["q"] // chunk_queries)
    lanes = min(chunks, max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks)))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        values = np.zeros((len(ids), dims), np.int64)
        part, width = components(table.column("v"))
        values[:, :width] = part
        block = Block(ids[order], values[order], low, bits, slices)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([block.ids.tobytes()], pa.binary()), "vals": pa.array([block.values.astype(kind).tobytes()], pa.binary()), "bitmaps": pa.array([block.slice.tobytes()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        values = np.zeros((len(ids), dims), kind)
        part, width = components(table.column("v").combine_chunks().take(pa.array(first)) if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v").take(pa.array(first)))
        values[:, :width] = part
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "vals": pa.array([values.tobytes()], pa.binary())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        block = None
        for batch in batches:
            for r in range(batch.num_rows):
                ids, values, packed = (batch.column(n)[r].as_buffer() for n in ("ids", "vals", "bitmaps"))
                ids = np.frombuffer(ids, np.int64)
                values = np.frombuffer(values, kind).reshape(len(ids), dims).astype(np.int64)
                if packed is not None:  # a block, which stands before its queries
                    block = Block(ids.copy(), values, low, bits, slices, packed.to_pybytes())
                    continue
                found = [block.top(q, i, k) for i, q in zip(ids.tolist(), values)]
                yield to_arrow(schema, query_id=np.repeat(ids, [len(s) for s, _ in found]), vec_id=np.concatenate([i for _, i in found]), score=np.concatenate([s for s, _ in found]))

    # more than k equal rows can't all be among the best
    distinct = good.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    copies = distinct.select("id", "v", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    index = copies.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(build, "block int, ids binary, vals binary, bitmaps binary")
    slot = (F.col("block") * lanes + F.col("lane")).cast("long").alias("slot")
    index = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(slot, F.lit(0).alias("turn"), "ids", "vals", "bitmaps")
    asked = good.where(F.col("id") % every == 0).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    asked = asked.groupBy("chunk").applyInArrow(gather, "chunk long, ids binary, vals binary")
    asked = asked.withColumn("lane", F.col("chunk") % lanes).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select(slot, F.lit(1).alias("turn"), "ids", "vals", F.lit(None).cast("binary").alias("bitmaps"))
    both = index.unionByName(asked).repartition(3 * blocks * lanes, "slot").sortWithinPartitions("slot", "turn")
    best = both.select("ids", "vals", "bitmaps").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
