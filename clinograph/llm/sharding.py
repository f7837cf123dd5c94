"""Byte-balanced shards by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts stand together.  Splitters between
shards are found on counts alone: each round counts the exact bytes below evenly spaced candidate
boundaries inside the still open key intervals, keeps for each splitter the interval that holds its
target, and refines until a boundary is within the tolerance.  Then one exchange numbers the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, utf8

#: Bits of the key that one round of probes resolves: 2 ** PROBE_BITS candidate boundaries an interval.
PROBE_BITS = 12
#: Rows of one numbering task, about.
SLOT_ROWS = 200_000


def ordered(value: int) -> int:
    """A 64-bit pattern read as a signed long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def unsigned(value: int) -> int:
    return value & ((1 << 64) - 1)


def bytes_below(rows: DataFrame, intervals: set[tuple]) -> dict[tuple, list[tuple[int, int, int, int]]]:
    """For each open interval (hash or None, start, bits) its probe bins (low, bytes, rows, one key if all rows share it).

    One job counts all intervals of a kind.  Partial sums are made before the shuffle, and at most
    2 ** PROBE_BITS rows an interval reach the driver.
    """
    found: dict[tuple, list] = {x: [] for x in intervals}
    for by_id, width in {(x[0] is not None, x[2]) for x in intervals}:
        own = [x for x in intervals if (x[0] is not None, x[2]) == (by_id, width)]
        key, step = F.col("id_bits" if by_id else "hash"), max(0, width - PROBE_BITS)
        base = F.shiftleft(F.shiftrightunsigned(key, width), width) if width < 64 else F.lit(0).cast("long")
        part = rows if width == 64 else rows.where(base.isin([ordered(x[1]) for x in own]))
        part = part.where(F.col("hash").isin([ordered(x[0]) for x in own])) if by_id else part
        bins = part.groupBy((F.col("hash") if by_id else F.lit(None).cast("long")).alias("inside"), base.alias("base"), F.shiftrightunsigned(key, step).alias("bin"))
        for row in bins.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect():
            name = (None if row["inside"] is None else unsigned(row["inside"]), unsigned(row["base"]), width)
            if name in found:
                found[name].append((unsigned(row["bin"] << step), row["size"], row["n"], unsigned(row["lo"]) if row["lo"] == row["hi"] else None))
    return {x: sorted(bins, key=lambda b: b[0]) for x, bins in found.items()}


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """Boundaries (hash, id bits): a row belongs above those that are not greater than its own pair.

    A boundary whose second part is None lies between two hashes, so that equal texts stay together;
    only a hash with more bytes than the tolerance leaves is cut by id.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int | None]] = {}
    opened = {i: (None, 0, 64, 0) for i in range(1, shards)} if total else {}  # hash, interval's start and bits, bytes below it
    while opened:
        counted = bytes_below(rows, {x[:3] for x in opened.values()})
        for i, (inside, start, bits, below) in list(opened.items()):
            target, step = i * total / shards, max(0, bits - PROBE_BITS)
            low, size, n, only = start, 0, 0, None
            for low, size, n, only in counted[inside, start, bits]:
                if below + size > target:
                    break
                below += size
            else:
                low, size = start + (1 << bits), 0
            # the target lies in the bin from `low` that holds `size` bytes, `below` bytes stand under it
            under, over = target - below, below + size - target
            place = lambda edge: (edge, None) if inside is None else (inside, edge)  # noqa: B023, E731
            if under <= slack or size == 0:
                done[i] = place(low)
            elif over <= slack:
                done[i] = place(low + (1 << step))
            elif n == 1 or (only is not None and inside is not None):  # no boundary splits one key
                done[i] = place(low if under <= over else low + (1 << step))
            elif only is not None:
                opened[i] = (only, 0, 64, below)  # one hash: go on by id
                continue
            else:
                opened[i] = (inside, low, step, below)
                continue
            del opened[i]
    return [done.get(i, (0, None)) for i in range(1, shards)]


def above(hash_col: Column, id_col: Column, cut: tuple[int, int | None]) -> Column:
    """Whether a row's pair is not below the boundary; the bits compare unsigned."""
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    signed = lambda v: ordered(v & ((1 << 64) - 1)) ^ -(1 << 63)
    if cut[0] >= 1 << 64:
        return F.lit(False)
    if cut[1] is None:
        return flip(hash_col) >= signed(cut[0])
    equal = F.lit(False) if cut[1] >= 1 << 64 else flip(id_col) >= signed(cut[1])
    return (flip(hash_col) > signed(cut[0])) | ((flip(hash_col) == signed(cut[0])) & equal)


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is that of nothing.
    Shards differ from the mean by at most `tolerance` of it, or by the one row that no boundary can
    split.  Equal texts lie in one shard unless a boundary has to cut their group.  Rows with equal
    id and text (or null ids) are equal keys and stay in one shard.  An empty table gives no rows.
    Slots number a shard's rows from 0 without gaps; their order is by salt, hash and id.
    """
    keys = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b")).select("id", F.xxhash64("b").alias("hash"), F.xxhash64("id", F.lit(1)).alias("id_bits"), (F.octet_length("b") + 8).cast("long").alias("size"), F.crc32("b").alias("text_crc32"))
    keys = durable(keys, "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    rows = keys.count()
    salts = max(1, -(-rows // (SLOT_ROWS * shards)))
    shard = sum((above(F.col("hash"), F.col("id_bits"), c).cast("int") for c in cuts), F.lit(0))
    placed = keys.withColumn("shard", shard).withColumn("salt", F.pmod(F.xxhash64("id", "hash", F.lit(2)), F.lit(salts)).cast("int"))
    first = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # shards x salts rows
    offsets, base = [], {}
    for row in sorted(first, key=lambda r: (r["shard"], r["salt"])):
        offsets.append((row["shard"], row["salt"], base.get(row["shard"], 0)))
        base[row["shard"]] = base.get(row["shard"], 0) + row["n"]
    start = docs.sparkSession.createDataFrame(offsets, "shard int, salt int, start long")
    own = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("hash", "id")) - 1
    numbered = placed.withColumn("own", own).join(start if len(offsets) > 100_000 else F.broadcast(start), ["shard", "salt"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
