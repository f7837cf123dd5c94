"""How many sets hold each element: set elements dealt out by hash as packed arrays, answers sent back.

A task gathers sets into parts of about PART_ELEMENTS elements.  Of each part every element goes out
once, however many sets of the part hold it, so the holders of the most common element are as many as
there are parts.  Elements travel as one array for each part and bucket, which costs the engine a row
where single elements would cost it thousands.  Buckets grow in number with the corpus, not in size.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import to_arrow

#: Elements of one part, about; of one that carries its sets along.
PART_ELEMENTS, CARRIED_ELEMENTS = 1 << 19, 1 << 18
#: Elements of one bucket, about.
BUCKET_ELEMENTS = 1 << 20
#: Buckets at most; beyond 2^36 elements in all they grow.
MOST_BUCKETS = 1 << 16

PACKED = "part long, bucket int, keys binary, sizes binary, elements binary, counts binary"
PACKED_SCHEMA = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "elements", "counts"))])
#: Bytes of a set's key.
KEY = 16

#: Keys, offsets, elements and, where wanted, rows of further numbers for each element.
Sets = Iterator[tuple]


def bucket_count(elements: int | None) -> int:
    return min(MOST_BUCKETS, max(1, -(-(elements or 0) // BUCKET_ELEMENTS)))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each element; larger elements never get a smaller one."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16)


def parts(sets: Sets, most: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray | None]]:
    """(part, keys, sizes, elements, further numbers): the sets of a task, each once a part, empty ones left out."""
    number = TaskContext.get().partitionId() << 32
    keys: dict[bytes, int] = {}
    kept: list[np.ndarray] = []
    more: list[np.ndarray] = []
    held = 0
    flush = lambda: (number, list(keys), np.fromiter(keys.values(), np.int64), np.concatenate(kept), np.concatenate(more) if more else None)
    for names, offsets, values, *further in sets:
        for i, key in enumerate(names):
            if key is None or key in keys or offsets[i] == offsets[i + 1]:
                continue
            own = slice(offsets[i], offsets[i + 1])
            kept.append(values[own])
            more += [x[own] for x in further]
            keys[key] = len(kept[-1])
            held += len(kept[-1])
            if held >= most:
                yield flush()
                keys, kept, more, held, number = {}, [], [], 0, number + 1
        kept, more = [x.copy() for x in kept], [x.copy() for x in more]  # not to hold on to the batch
    if kept:
        yield flush()


def blobs(array: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [array[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]


def in_unary(rising: np.ndarray) -> bytes:
    """Rising numbers as bits: a 0 for each step up, a 1 for each number."""
    if not len(rising):
        return b""
    bits = np.zeros(int(rising[-1]) + len(rising), np.uint8)
    bits[rising + np.arange(len(rising))] = 1
    return np.packbits(bits).tobytes()


def from_unary(stored: bytes, count: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(stored, np.uint8))) - np.arange(count)


def packed(part: int, buckets: int, **columns: list) -> pa.RecordBatch:
    """A row for each bucket, then one of the part itself."""
    where = [*range(buckets), ((part >> 32) + part) % (1 << 32) % buckets]  # parts' own rows go round
    return to_arrow(PACKED_SCHEMA, part=[part] * len(where), bucket=where, **columns)


def scatter_asked(sets: Sets, buckets: int, least: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Parts for keep_shared(): each bucket gets the low halves of its elements.

    `elements` are those that one set of the part holds, in the order of the sets, which `sizes` tells;
    `counts` are those that more hold, of which the part needs no answer.
    """
    for part, keys, sizes, values, _ in parts(sets, PART_ELEMENTS):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values)
        ordered = values[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        alone = np.diff(np.append(edge, len(ordered))) == 1
        common = ordered[edge[~alone]]
        asked = np.zeros(len(values), bool)
        asked[order[edge[alone]]] = True
        known = np.bincount(owner[~asked], minlength=len(sizes))
        values, owner = values[asked], owner[asked]
        at = bucket_of(values, buckets)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(buckets + 1))
        owner = owner[order]
        low = np.uint64(0xFFFFFFFF)
        none = [None] * buckets
        yield packed(
            part,
            buckets,
            keys=[*none, b"".join(keys)],
            sizes=[*(in_unary(owner[a:z]) for a, z in zip(cuts[:-1], cuts[1:])), (least(sizes) - known).astype(np.int32).tobytes()],
            elements=[*blobs((values[order] & low).astype(np.uint32), cuts), None],
            counts=[*blobs((common & low).astype(np.uint32), np.searchsorted(bucket_of(common, buckets), np.arange(buckets + 1))), None],
        )


def read_rows(table: pa.Table) -> tuple[pa.Table, list[dict]]:
    """(parts' own rows, the others): both stay where the table holds them, arrays as buffers of it.

    Own rows are large and most of a bucket's bytes, so each leaves as a batch of its own, not copied.
    """
    own = [i for i, key in enumerate(table.column("keys")) if key.is_valid]
    names = ("sizes", "elements", "counts")
    buffers = zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), table.column("keys"), *(table.column(c) for c in names))
    others = [{"part": part, "bucket": bucket, "keys": None} | {c: x.as_buffer() for c, x in zip(names, row)} for part, bucket, key, *row in buffers if not key.is_valid]
    return pa.concat_tables([table.slice(0, 0), *(table.slice(i, 1) for i in own)]), others


def own_row(own: pa.Table) -> dict:
    """A part's own row: its keys and, where they aren't null, its arrays as buffers."""
    return {"keys": own.column("keys")[0].as_py()} | {c: own.column(c)[0].as_buffer() for c in ("sizes", "elements", "counts")}


def answer_shared(table: pa.Table) -> pa.Table:
    """For one bucket: of each part the sets with elements that stand elsewhere too, and how many."""
    own, asking = read_rows(table)
    asked = [np.frombuffer(r["elements"], np.uint32) for r in asking]
    every = np.concatenate([*asked, *(np.frombuffer(r["counts"], np.uint32) for r in asking), np.zeros(0, np.uint32)])
    order = np.argsort(every)
    ordered = every[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    out, start = [], 0
    for row, mine in zip(asking, asked):
        hit = twice[start : start + len(mine)]
        start += len(mine)
        owner, times = np.unique(from_unary(row["sizes"], len(mine))[hit], return_counts=True)
        if len(owner):
            out.append(row | {"sizes": owner.astype(np.uint32).tobytes(), "elements": None, "counts": times.astype(np.uint32).tobytes()})
    return pa.concat_tables([own, pa.Table.from_pylist(out, table.schema)])


def reached(table: pa.Table) -> pa.Table:
    """For one part: the keys of the sets that share as many elements as they must."""
    own, told = read_rows(table)
    own = own_row(own)
    lacking = np.frombuffer(own["sizes"], np.int32).astype(np.int64)
    for r in told:
        lacking[np.frombuffer(r["sizes"], np.uint32)] -= np.frombuffer(r["counts"], np.uint32)
    return pa.table({"v": pa.array([own["keys"][KEY * i : KEY * i + KEY] for i in np.flatnonzero(lacking <= 0)], pa.binary())})


def keep_shared(source: DataFrame, sets: Callable[[Iterator[pa.RecordBatch]], Sets], buckets: int, least: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """v: the keys of sets of which least(size) elements stand in another set too, perhaps more than once.

    Elements are compared by 32 bits and their bucket, and equal sets of different parts count as two, so
    a set may be kept that should not; none is left out that should.
    """
    asked = source.mapInArrow(lambda batches: scatter_asked(sets(batches), buckets, least), PACKED)
    return asked.groupBy("bucket").applyInArrow(answer_shared, PACKED).groupBy("part").applyInArrow(reached, "v binary")


def scatter_counted(sets: Sets, buckets: int) -> Iterator[pa.RecordBatch]:
    """Parts for with_holders(): each bucket gets its elements and their holders in the part; the part keeps its sets."""
    for part, keys, sizes, values, more in parts(sets, CARRIED_ELEMENTS):
        distinct, times = np.unique(values, return_counts=True)
        cuts = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
        none = [None] * buckets
        yield packed(
            part,
            buckets,
            keys=[*none, b"".join(keys)],
            sizes=[*none, sizes.astype(np.int64).tobytes()],
            elements=[*blobs(distinct, cuts), values.tobytes()],
            counts=[*blobs(times.astype(np.uint32), cuts), None if more is None else np.ascontiguousarray(more.T).tobytes()],
        )


def answer_counted(table: pa.Table) -> pa.Table:
    """For one bucket: of each part the elements that several sets hold, and how many do."""
    own, asking = read_rows(table)
    elements = [np.frombuffer(r["elements"], np.uint64) for r in asking]
    distinct, which = np.unique(np.concatenate([*elements, np.zeros(0, np.uint64)]), return_inverse=True)
    times = np.concatenate([*(np.frombuffer(r["counts"], np.uint32) for r in asking), np.zeros(0, np.uint32)])
    total = np.bincount(which, weights=times, minlength=len(distinct)).astype(np.uint32)[which]
    out, start = [], 0
    for row, mine in zip(asking, elements):
        times = total[start : start + len(mine)]
        start += len(mine)
        hit = times > 1
        if hit.any():
            out.append(row | {"elements": mine[hit].tobytes(), "counts": times[hit].tobytes()})
    return pa.concat_tables([own, pa.Table.from_pylist(out, table.schema)])


def sets_of_part(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(keys, offsets, elements, holders, further numbers a row each) of one part's sets."""
    own, told = read_rows(table)
    own = own_row(own)
    sizes, values = np.frombuffer(own["sizes"], np.int64), np.frombuffer(own["elements"], np.uint64)
    elements = np.concatenate([*(np.frombuffer(r["elements"], np.uint64) for r in told), np.zeros(0, np.uint64)])
    times = np.concatenate([*(np.frombuffer(r["counts"], np.uint32) for r in told), np.zeros(0, np.uint32)])
    order = np.argsort(elements)
    elements, times = elements[order], times[order]
    holders = np.ones(len(values), np.int64)
    if len(elements):
        at = np.minimum(np.searchsorted(elements, values), len(elements) - 1)
        known = elements[at] == values
        holders[known] = times[at[known]]
    keys = [own["keys"][i : i + KEY] for i in range(0, len(own["keys"]), KEY)]
    more = None if own["counts"] is None else np.frombuffer(own["counts"], np.int64).reshape(-1, len(values))
    return keys, np.concatenate([[0], np.cumsum(sizes)]), values, holders, more


def with_holders(source: DataFrame, sets: Callable[[Iterator[pa.RecordBatch]], Sets], buckets: int, made: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `made` makes of each part's sets, which sets_of_part() reads from its table."""
    counted = source.mapInArrow(lambda batches: scatter_counted(sets(batches), buckets), PACKED)
    return counted.groupBy("bucket").applyInArrow(answer_counted, PACKED).groupBy("part").applyInArrow(made, schema)
