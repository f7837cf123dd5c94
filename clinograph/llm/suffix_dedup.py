"""Removal of long repeated passages with run-length compressed suffix indexes.

A text is a sequence of units, its bytes or its words.  Every window of `length` units names one anchor
in it: the leftmost gram of smallest hash.  Equal windows have equal anchors at equal places, so the
windows fall apart into groups by anchor, and nothing has to be compared across groups.  Windows of one
anchor stand together in a context.  Anchors that stand nowhere else end there; contexts that are equal
as a whole are one text of the index, with its number of copies.

Groups of different contexts are indexed block by block: suffix sort, Burrows-Wheeler transform, its
runs, and samples of the suffix array at run ends.  At a run end the match with the lexical neighbour is
measured; from there it is one shorter at each position on, until the next sample.  So the longest match
of every position with any other streams out of the samples alone, and windows that it covers are marked.

A group with very many contexts is split by where windows stand to the anchor and what they then must
all hold, again and again, down to single windows, which equal hashes settle.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import holders
from .common import durable, flat_bytes, forget, mix64, slices, tidy, to_arrow, utf8
from .words import BASE, powers, word_hashes, word_spans

#: Bytes of contexts in one index block, about.
BLOCK_BYTES = 1 << 20
#: Groups with more different contexts than this are split.
GROUP_CONTEXTS = 2000
#: Parts of a window's length within which windows begin that stay together in each split of a group, before single ones.
SPLITS = (6, 48)
#: Texts chosen by a broadcast of their keys at most; above, the choice shuffles.
BROADCAST_KEYS = 500_000
#: Positions that one kernel call takes of a text, and bytes of several texts.  It holds a dozen numbers for each.
SEGMENT = 1 << 20
SLICE_BYTES = 1 << 18
INVERSE = pow(BASE, -1, 1 << 64)


class Units(NamedTuple):
    """What texts are sequences of.

    read: from bytes and row offsets the units, the row offsets among them, and the place of each
    unit's first byte and of the byte after its last; `per`: bytes of a unit, about; kind: units as stored.
    """

    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]
    per: int
    kind: type


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, row = word_spans(data, offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return word_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(counts)]), starts, ends


BYTES = Units(lambda data, offsets: (data, offsets, None, None), 1, np.uint8)
#: Words stand for themselves alone, whatever white space parts them.
WORDS = Units(read_words, 6, np.uint64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, inverse: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end that doesn't depend on where they stand."""
    return mix64((prefix[end] - prefix[start]) * inverse[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` adjoining values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, anchor hash, context hash): the windows that start from lo to hi in a row share an anchor."""
    n, width = len(data), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix, inverse = prefix_sums(data), powers(INVERSE, n + 1)
    grams = span_hash(prefix, slice(0, n - gram + 1), slice(gram, n + 1), inverse[: n - gram + 1])
    place = np.uint64(24)
    least = sliding_min((grams >> place << place) | np.arange(len(grams), dtype=np.uint64), width)
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int32)  # windows that end in their row
    sizes = np.diff(offsets)
    long_rows = np.flatnonzero(sizes >= length)
    np.add.at(valid, offsets[long_rows], 1)
    np.add.at(valid, offsets[long_rows + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    row = np.searchsorted(offsets, starts, side="right") - 1
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[starts[1:]] != at[starts[:-1]]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    row, anchor = row[first], at[lo]
    context = mix64(span_hash(prefix, lo, hi + length, inverse) + ((anchor - lo) * 65536 + hi - lo).astype(np.uint64))
    return row, lo - offsets[row], hi - offsets[row], grams[anchor], context


def anchors_of_text(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of one long text, in segments that overlap by less than a window."""
    for start in range(0, len(data), SEGMENT):
        part = data[start : start + SEGMENT + length - 1]
        row, lo, hi, anchor, context = anchors(part, np.array([0, len(part)]), length, gram)
        yield row, lo + start, hi + start, anchor, context


def merge_spans(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of the bytes covered by windows that start from lo to hi."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    fresh = np.ones(len(lo), bool)
    fresh[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(fresh)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]


def suffix_ranks(symbols: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix array, ranks) of contexts that each end with a 0 of its own, smaller the earlier it stands.

    end: for each position that of its context's 0.  ranks: for growing h the order of suffixes by
    their first h symbols.  Prefix doubling, from 7 packed symbols where an alphabet of bytes allows.
    """
    n = len(symbols)
    index = np.arange(n)
    h = 7 if symbols.max() < 512 else 1
    key = np.zeros(n, np.int64)
    for j in range(h):
        inside = index + j <= end
        key = key << 9 | np.where(inside, symbols[np.minimum(index + j, n - 1)], 0) if h > 1 else symbols
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)  # of a suffix the first place of those that agree with it
    rank[order] = place[np.cumsum(fresh) - 1]
    ranks = [(h, rank.astype(np.int32))]
    tied = order[~(fresh & np.append(fresh[1:], True))]
    while len(tied) and h <= depth:
        key = rank[tied] * (n + 1) + np.where(tied + h <= end[tied], rank[np.minimum(tied + h, n - 1)] + 1, 0)
        sort = np.argsort(key)
        tied, key = tied[sort], key[sort]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = key // (n + 1)
        head = np.concatenate([[True], group[1:] != group[:-1]])
        start, first = np.flatnonzero(head), np.flatnonzero(fresh)
        rank[tied] = group + first[np.cumsum(fresh) - 1] - start[np.cumsum(head) - 1]
        h *= 2
        ranks.append((h, rank.astype(np.int32)))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
    if len(tied):  # wholes that agree to their ends: the earlier first
        return np.argsort(rank * n + index), ranks
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = index
    return suffixes, ranks


class RunIndex:
    """The runs of the Burrows-Wheeler transform of contexts, with the suffix array sampled at run ends."""

    def __init__(self, contexts: list[np.ndarray]) -> None:
        sizes = np.array([len(c) for c in contexts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        self.starts = ends - sizes
        self.symbols = np.zeros(int(ends[-1]) + 1, np.int64)
        inner = np.ones(len(self.symbols), bool)
        inner[ends] = False
        units = np.concatenate(contexts)
        self.symbols[inner] = units.astype(np.int64) + 1 if units.dtype == np.uint8 else np.unique(units, return_inverse=True)[1] + 1
        self.end = np.repeat(ends, sizes + 1)
        suffixes, self.ranks = suffix_ranks(self.symbols, self.end, int(sizes.max()) + 1)
        before = self.symbols[suffixes - 1].copy()
        first = np.flatnonzero(before == 0)
        before[first] = int(self.symbols.max()) + 1 + np.arange(len(first))  # each context's end is a symbol of its own
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        heads, tails = np.concatenate([[0], change]), np.concatenate([change - 1, [len(before) - 1]])
        self.runs = len(heads)
        self.lower = self.samples(suffixes[heads[1:]], suffixes[heads[1:] - 1])
        self.upper = self.samples(suffixes[tails[:-1]], suffixes[tails[:-1] + 1])
        self.ranks = []  # the samples hold all that is asked for

    def samples(self, at: np.ndarray, neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run ends in text order and how far each suffix there agrees with its neighbour across the border."""
        order = np.argsort(at)
        at, neighbour = at[order], neighbour[order]
        last = len(self.symbols) - 1
        agreed = np.zeros(len(at), np.int64)
        for h, rank in reversed(self.ranks):
            same = rank[np.minimum(at + agreed, last)] == rank[np.minimum(neighbour + agreed, last)]
            agreed[same] += h
        rest = np.arange(len(at))
        for _ in range(self.ranks[0][0] - 1):
            rest = rest[self.symbols[np.minimum(at[rest] + agreed[rest], last)] == self.symbols[np.minimum(neighbour[rest] + agreed[rest], last)]]
            agreed[rest] += 1
        return at, np.minimum(agreed, np.minimum(self.end[at] - at, self.end[neighbour] - neighbour))

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match with any other, within contexts.

        Matches are longest with a neighbour in the suffix array.  Inside a run a position's neighbour is
        that of the position before, moved along, and the match one shorter; every context begins at a
        run's end, as what stands before it is a symbol of its own.
        """
        at = np.arange(len(self.symbols))
        longest = np.zeros(len(at), np.int64)
        for places, agreed in (self.lower, self.upper):
            if len(places):
                sampled = np.zeros(len(at), np.int64)
                sampled[places] = 1
                k = np.cumsum(sampled) - 1
                np.maximum(longest, np.where(k >= 0, agreed[k] + places[k] - at, 0), out=longest)
        return longest


def index_spans(contexts: list[np.ndarray], single: list[bool], length: int) -> list[tuple[int, int, int]]:
    """(context, first, last): window starts in contexts marked single that have an equal window elsewhere."""
    index = RunIndex(contexts)
    hit = index.matching_statistics() >= length
    out = []
    for c, alone in enumerate(single):
        if alone:
            marks = np.flatnonzero(np.diff(hit[index.starts[c] : index.starts[c] + len(contexts[c])], prepend=False, append=False))
            out += [(c, int(a), int(z) - 1) for a, z in zip(marks[::2], marks[1::2])]
    return out


def choose(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose key is in a written table of keys; without a shuffle where that is small."""
    keys = keys.select("k").distinct()
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "k", "left_semi")


def repeated_windows(texts: DataFrame, length: int, units: Units = BYTES, most_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """k, lo, hi: windows of `length` units starting from lo to hi, in the text of key k, that also
    start anywhere else in texts(k binary, b binary), the same text included.

    A key that stands for several equal texts need only have its spans, not its multiplicity, here.
    Keys have 16 bytes.
    """
    gram = max(1, length // 4)
    spark = texts.sparkSession
    held = texts.agg(F.sum(F.octet_length("b").cast("long"))).first()[0] or 0
    buckets = holders.bucket_count(2 * held // units.per // (length - gram + 2))

    def text_anchors(batches: Iterator[pa.RecordBatch]) -> holders.Sets:
        for batch in batches:
            for part in slices(batch, "b", SLICE_BYTES):
                values, offsets, *_ = units.read(*flat_bytes(part.column("b")))
                made = anchors_of_text(values, length, gram) if part.num_rows == 1 else [anchors(values, offsets, length, gram)]
                made = [np.concatenate(x) for x in zip(*made)]
                if made:
                    row, lo, hi, ah, ch = made
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                    yield part.column("k").to_pylist(), ends, ah, np.stack([lo, hi, ch.view(np.int64)], axis=1)

    def rows_of_part(table: pa.Table) -> pa.Table:
        keys, ends, ah, count, (lo, hi, ch) = holders.sets_of_part(table)
        row = np.repeat(np.arange(len(keys)), np.diff(ends))
        row, lo, hi, ah, ch = (x[count > 1] for x in (row, lo, hi, ah.view(np.int64), ch))
        # the first of equal contexts in a text stands for all; their windows are settled
        order = np.lexsort((ch, ah, row))
        equal = (row[order][1:] == row[order][:-1]) & (ah[order][1:] == ah[order][:-1]) & (ch[order][1:] == ch[order][:-1])
        again, ahead = np.append(False, equal)[: len(order)], np.append(equal, False)[: len(order)]
        lead, alike = order[~again], np.sort(order[again | ahead])
        which, first = np.unique(row[alike], return_index=True)
        settled = [merge_spans(lo[own], hi[own], length) for own in np.split(alike, first)[1:]]
        none = pa.nulls(sum(len(s) for s, _ in settled), pa.int64())
        rows = np.concatenate([row[lead], np.repeat(which, [len(s) for s, _ in settled])]).astype(np.int64)
        begin = np.concatenate([lo[lead], *(s for s, _ in settled)]).astype(np.int32)
        last = np.concatenate([hi[lead], *(e - length for _, e in settled)]).astype(np.int32)
        times = np.concatenate([np.where(ahead[~again], 2, 1), np.zeros(len(none), np.int64)]).astype(np.int32)
        hashes = {c: pa.concat_arrays([pa.array(x[lead]), none]) for c, x in (("ah", ah), ("ch", ch))}
        return pa.table({"k": pa.array(keys, pa.binary()).take(pa.array(rows)), "lo": begin, "hi": last, **hashes, "m": times})

    found = durable(holders.with_holders(texts.select("k", "b"), text_anchors, buckets, rows_of_part, "k binary, lo int, hi int, ah long, ch long, m int"), "repeat-anchors")
    tidy(spark)
    settled = found.where("ah IS NULL").select("k", "lo", "hi")
    found = found.where("ah IS NOT NULL")
    contexts = durable(found.groupBy("ah", "ch").agg(F.sum("m").alias("n"), F.min(F.struct("k", "lo", "hi")).alias("one")), "repeat-contexts")
    by_count = found.join(contexts.where("n > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("k", "lo", "hi")
    out = settled.unionByName(by_count)
    shared = contexts.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = durable(contexts.join(shared, "ah").select("ah", "n", "kinds", "one.*"), "repeat-several")
    group = cut_contexts(texts, several, length, units)
    group, steps = durable(group, "repeat-group"), iter([*(max(1, length // part) for part in SPLITS), 1])
    forget(spark, several)
    while True:
        size = group.agg(F.sum(F.octet_length("units").cast("long")), F.max("kinds")).first()
        if not size[0]:
            return out
        out = out.unionByName(indexed(group.where(F.col("kinds") <= most_contexts), length, units, max(1, int(size[0] // BLOCK_BYTES))))
        if size[1] <= most_contexts:
            return out
        group, equal = split(group.where(F.col("kinds") > most_contexts), length, units, next(steps))
        out = out.unionByName(equal)


def cut_contexts(texts: DataFrame, several: DataFrame, length: int, units: Units) -> DataFrame:
    """g, kinds, n, k, lo, units: the contexts as stored units, from one text of each key."""
    wanted = several.groupBy("k").agg(F.collect_list(F.struct("ah", "n", "kinds", "lo", "hi")).alias("parts"))
    chosen = choose(texts, several).groupBy("k").agg(F.first("b").alias("b")).join(wanted, "k").select("k", "parts", "b")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), ("kinds", pa.int64()), ("n", pa.int64()), ("k", pa.binary()), ("lo", pa.int32()), ("units", pa.binary())])
        for batch in batches:
            for some in slices(batch, "b"):
                values, offsets, *_ = units.read(*flat_bytes(some.column("b")))
                parts = some.column("parts")
                row = np.repeat(np.arange(some.num_rows), np.diff(parts.offsets.to_numpy()))
                parts = parts.flatten()
                lo, hi = parts.field("lo").to_numpy(), parts.field("hi").to_numpy()
                from_, to = offsets[row] + lo, offsets[row] + hi + length
                stored = [values[a:z].tobytes() for a, z in zip(from_, to)]
                yield to_arrow(schema, g=parts.field("ah"), kinds=parts.field("kinds"), n=parts.field("n"), k=some.column("k").take(pa.array(row)), lo=parts.field("lo"), units=stored)

    return chosen.mapInArrow(cut, "g long, kinds long, n long, k binary, lo int, units binary")


def indexed(group: DataFrame, length: int, units: Units, blocks: int) -> DataFrame:
    """k, lo, hi: the windows of contexts without copies that the indexes of their blocks find elsewhere."""

    def block_spans(table: pa.Table) -> pa.Table:
        keys, lo = table.column("k").to_pylist(), table.column("lo").to_numpy()
        contexts = [np.frombuffer(c, units.kind) for c in table.column("units").to_pylist()]
        marks = index_spans(contexts, [n == 1 for n in table.column("n").to_pylist()], length)
        return pa.table({"k": pa.array([keys[c] for c, _, _ in marks], pa.binary()), "lo": pa.array([int(lo[c]) + a for c, a, _ in marks], pa.int32()), "hi": pa.array([int(lo[c]) + z for c, _, z in marks], pa.int32())})

    dealt = group.select(F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int").alias("block"), "k", "lo", "n", "units")
    return dealt.groupBy("block").applyInArrow(block_spans, "k binary, lo int, hi int")


def split(group: DataFrame, length: int, units: Units, step: int) -> tuple[DataFrame, DataFrame]:
    """(smaller groups, k, lo, hi of pieces that equal others): contexts in pieces of `step` window starts.

    Pieces are cut at places that count from the anchor.  All windows that may begin in a piece's range
    hold the same middle, so equal windows are in pieces of one place and one middle: the new group.
    """
    gram = max(1, length // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), ("ch", pa.int64()), ("n", pa.int64()), ("k", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("units", pa.binary())])
        for batch in batches:
            out = []
            for g, n, key, at, anchor, stored in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "k", "lo", "anchor", "units"))):
                values = np.frombuffer(stored, units.kind)
                prefix, inverse = prefix_sums(values), powers(INVERSE, len(values) + 1)
                if anchor is None:
                    grams = span_hash(prefix, slice(0, len(values) - gram + 1), slice(gram, len(values) + 1), inverse[: len(values) - gram + 1])
                    anchor = int(np.argmin(grams >> np.uint64(24)))
                last = len(values) - length  # the last window's start
                for place in range(-anchor // step, (last - anchor) // step + 1):
                    begin, stop = anchor + place * step, anchor + (place + 1) * step - 1
                    lo, hi = max(0, begin), min(last, stop)
                    ends = np.array([[stop, begin + length], [lo, hi + length]])
                    middle, own = mix64(span_hash(prefix, ends[:, 0], ends[:, 1], inverse))
                    salt = mix64(np.array([(g ^ place * 0x9E3779B97F4A7C15) & (1 << 64) - 1], np.uint64))[0]
                    context = mix64(np.array([own]) + np.uint64(hi - lo) * np.uint64(65536) + np.uint64(lo - begin))[0]
                    out.append((int((middle ^ salt).view(np.int64)), int(context.view(np.int64)), n, key, at + lo, at + hi, values[lo : hi + length].tobytes()))
            yield to_arrow(schema, **{f.name: [r[i] for r in out] for i, f in enumerate(schema)})

    pieces = group.withColumn("anchor", F.lit(None).cast("int")) if "anchor" not in group.columns else group
    pieces = durable(pieces.mapInArrow(cut, "g long, ch long, n long, k binary, lo int, hi int, units binary"), "repeat-pieces")
    alike = pieces.groupBy("g", "ch").agg(F.sum("n").alias("n"), F.min(F.struct("k", "lo")).alias("one"), F.first("units").alias("units"))
    copied = alike.where("n > 1").select("g", "ch")
    equal = pieces.where("n = 1").join(copied, ["g", "ch"], "left_semi").select("k", "lo", "hi")
    shared = alike.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return durable(alike.join(shared, "g").select("g", "kinds", "n", "one.k", "one.lo", "units"), "repeat-group"), equal


def keyed(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """columns, b, sha, k: the bytes of the text, their digest and the key that equal texts share."""
    return docs.select(*columns, utf8(text_col).alias("b")).withColumn("sha", F.sha2("b", 256)).withColumn("k", F.substring(F.unhex("sha"), 1, 16))


def of_repeated(rows: DataFrame, length: int, units: Units, make: Callable[[bytes, pa.Buffer, tuple | None, tuple], tuple], schema: pa.Schema) -> DataFrame:
    """What make(key, bytes, places of the units, runs of them) gives for each text with repeated windows.

    A text that equals another's whole is one run.
    """
    texts = rows.select("k", "b").where(F.octet_length("b") >= length)
    copies = durable(texts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "repeat-copies")
    spans = durable(repeated_windows(texts, length, units), "repeat-spans")
    lists = spans.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    lists = lists.join(copies.withColumn("whole", F.lit(True)), "k", "outer").select("k", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data, marks, whole in zip(batch.column("k").to_pylist(), batch.column("b"), batch.column("spans"), batch.column("whole").to_pylist()):
                data, marks = data.as_buffer(), marks.values
                values, _, *places = units.read(np.frombuffer(data, np.uint8), np.array([0, data.size]))
                if whole:
                    runs = np.zeros(1, np.int64), np.full(1, len(values))
                else:
                    runs = merge_spans(marks.field("lo").to_numpy().astype(np.int64), marks.field("hi").to_numpy().astype(np.int64), length)
                if len(values) >= length:
                    out.append(make(key, data, places, runs))
            yield to_arrow(schema, **{f.name: [r[i] for r in out] for i, f in enumerate(schema)})

    kinds = ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long' if pa.types.is_integer(f.type) else 'string'}" for f in schema)
    return choose(texts, lists).groupBy("k").agg(F.first("b").alias("b")).join(lists, "k").select("k", "b", "spans", "whole").mapInArrow(judge, kinds)


def removed(rows: DataFrame, length: int, units: Units, kept: bool) -> DataFrame:
    """k, n_removed, n_spans, kept_sha256 (and the kept bytes) of texts that lose anything.

    Word units take with them the white space between them, but not that before and after a run.
    """

    def make(key: bytes, data: pa.Buffer, places: tuple, runs: tuple) -> tuple:
        first, end = places
        start, stop = runs if first is None else (first[runs[0]], end[runs[1] - 1])
        edges = [0, *np.stack([start, stop], axis=1).reshape(-1).tolist(), data.size]
        rest = b"".join(memoryview(data)[a:z] for a, z in zip(edges[::2], edges[1::2]))
        return key, data.size - len(rest), len(start), hashlib.sha256(rest).hexdigest(), rest if kept else None

    schema = pa.schema([("k", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return of_repeated(rows, length, units, make, schema)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    Removed is each byte that a string of `length` bytes covers which also starts anywhere else, in
    this or another row; strings are judged on the input.  A null or short text loses nothing by
    itself.  Repeated rows are copies of each other, whatever their ids, and null ids are carried.
    With passage_words a last column of that name counts the words that runs of so many words cover
    which also stand elsewhere; they stay.
    """
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text")
    result = rows.select("id", "k", "sha", F.octet_length("b").cast("long").alias("n_bytes")).join(removed(rows, length, BYTES, False), "k", "left")
    none = F.lit(0).cast("long")
    columns = [F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    if passage_words:
        count = lambda key, data, places, runs: (key, int((runs[1] - runs[0]).sum()))
        words = of_repeated(rows, passage_words, WORDS, count, pa.schema([("k", pa.binary()), ("words", pa.int64())]))
        result = result.join(words, "k", "left")
        columns.append(F.coalesce("words", none).alias("passage_words"))
    return result.select(*columns)


def with_repeats_removed(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", units: Units = BYTES) -> DataFrame:
    """docs with the repeated units cut out of the text, and as the last column whether it was cut.

    What is left is decoded again; bytes of a character that was cut through are dropped.  Null
    texts and texts that lose nothing stay as they are.  Columns may have any names; the last one is
    called was_cut, with underscores behind it where that is taken.
    """
    flag = "was_cut"
    while flag in docs.columns:
        flag += "_"
    place = docs.columns.index(text_col)
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    rows = keyed(named, named.columns, f"c{place}")
    cut = rows.join(removed(rows, length, units, True), "k", "left").select(*named.columns, "kept")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()], pa.string())
            yield batch.set_column(place, f"c{place}", text)

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes)
    changed = cut.where("kept IS NOT NULL").mapInArrow(decode, kinds)
    done = cut.where("kept IS NULL").unionByName(changed)
    return done.withColumn("kept", F.col("kept").isNotNull()).toDF(*docs.columns, flag)
