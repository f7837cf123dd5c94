"""Jaccard self-join of documents on word n-grams with adaptive multi-match prefixes.

All n-grams have one order, by the true number of sets that hold them, rare ones first.  If two sets
share c elements, their prefixes of size - c + m share at least m.  Each document chooses its own m:
the one whose longer prefix is expected to cost less than the candidates it rules out.  A pair has to
share min(m, m') prefix elements before its sets are compared.

The prefix of a document that lacks too many elements elsewhere has none that another holds: such
documents are found by counting, and neither their sets nor their prefixes are made at all.

Links inside a group of copies are not listed: equal sets are one vertex, and within an n-gram's
documents a few hubs are compared with all others first.  What that joins into one component needs
no further comparison; what stays apart is compared with more hubs until every pair of documents of
different components that shares a prefix element has been compared.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import holders
from .common import durable, flat_bytes, forget, mix64, slices, tidy, to_arrow, utf8
from .components import contract
from .words import LOWER, word_hashes, word_spans

#: Prefix elements that a document may have to share: what it chooses from.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Cost of verifying a candidate against that of posting one prefix element.
VERIFY_COST = 4.0
#: Groups of at most this many open documents are compared pair by pair.
SMALL_GROUP = 16
#: Of so many n-grams one, in the rounds that look at some only.
SAMPLES = (16, 4)
#: Keys that are broadcast at most to choose texts or rename components.
BROADCAST_KEYS = 500_000


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the distinct hashes of each text's n-grams, sorted.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    factor = np.uint64(0xD6E8FEB86659FD93)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(grams) else 0):
        grams = grams * factor + words[j : j + len(grams)]
    value, owner = mix64(grams), row[: len(grams)]
    inside = owner == row[n - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
    value, owner = value[inside], owner[inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            extra[has] = extra[has] * factor + words[first[short][has] + j]
        value, owner = np.concatenate([value, mix64(extra + count[short].astype(np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]), value


def signatures(offsets: np.ndarray, values: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for each set; None for an empty one."""
    rows = len(offsets) - 1
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(values ^ np.uint64(c)))]) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    size = np.diff(offsets).astype(np.uint64)
    parts = np.stack([mix64(s[offsets[1:]] - s[offsets[:-1]] + size) for s in sums], axis=1)
    return [parts[i].tobytes() if size[i] else None for i in range(rows)]


def each_set(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches whose last column is the text, in parts, with their sets."""
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1):
            yield part, *gram_sets(*flat_bytes(part.column(batch.num_columns - 1)), n)


def least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    """Elements that a set of this size shares at least with any set it links to."""
    return -(-size * percent // 100)


def choose_matches(others: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix length, matches) of each set; others are its elements' other holders in prefix order.

    The expected candidates of a prefix are the other holders of its elements over the matches
    asked for.
    """
    size = np.diff(offsets)
    least = least_shared(size, percent)
    base = size - least
    total = np.concatenate([[0], np.cumsum(others)])
    matches, cost = np.zeros(len(size), np.int64), np.full(len(size), np.inf)
    for m in MATCHES:
        held = total[np.minimum(offsets[:-1] + base + m, offsets[1:])] - total[offsets[:-1]]
        price = np.where((m <= least) & (size > 0), base + m + VERIFY_COST * held / m, np.inf)
        better = price < cost
        matches, cost = np.where(better, m, matches), np.where(better, price, cost)
    return np.minimum(size, base + matches) * (size > 0), matches


def link_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D of the text with A-Z lower-cased; a
    document's set is its distinct n-grams (the whole sequence if shorter, nothing without words).
    Two documents link when 100 * shared >= percent * united.  component_id is the smallest id
    that links lead to, the document's own included; null ids are passed over, and a document
    whose class has no other id keeps its own.  Ids are taken to name one text; repeated rows are
    copies.  A document without words links with nothing, not even with another such.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b"))
    rows = rows.select("id", F.xxhash64("b").alias("th"), "b")

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, values in each_set(batches, n):
            schema = pa.schema([("id", part.schema.field(0).type), ("th", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])
            yield to_arrow(schema, id=part.column(0), th=part.column(1), n=np.diff(offsets), v=signatures(offsets, values))

    scanned = durable(rows.mapInArrow(first_scan, f"id {kind}, th long, n long, v binary"), "ngram-scan")
    open_sets = durable(sets_with_prefixes(rows, scanned, n, percent), "ngram-open-sets")
    tidy(spark)
    links = durable(verified_links(open_sets, percent), "ngram-all-links")
    roots = contract(links).withColumnRenamed("v", "d")
    joined = open_sets.select("d", "v").join(roots, "d", "left").select("v", F.coalesce("c", "d").alias("root"))
    classes = scanned.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first"))
    joined = durable(joined.join(classes, "v"), "ngram-classes")
    forget(spark, open_sets, links, roots)
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    of_class = classes.join(joined.join(least, "root").select("v", "least"), "v", "left").select("v", F.coalesce("least", "first").alias("component_id"))
    out = scanned.select("id", "n", "v").join(of_class, "v", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def sets_with_prefixes(rows: DataFrame, scanned: DataFrame, n: int, percent: int) -> DataFrame:
    """d, v, n, m, share, p, i, s of the classes that may link.

    p and i: the prefix elements that other open sets hold too, and their places in the order; share: how
    many they are of the n elements; s: the set; d: a number that stands for the class v.
    """
    spark = rows.sparkSession
    text_sets = lambda batches: ((signatures(offsets, values), offsets, values) for _, offsets, values in each_set(batches, n))
    buckets = holders.bucket_count(scanned.agg(F.sum("n")).first()[0])
    alive = durable(holders.keep_shared(rows.select("b"), text_sets, buckets, lambda size: least_shared(size, percent)).distinct(), "ngram-alive")
    tidy(spark)
    sets = durable(read_sets(rows.select("th", "b"), scanned.join(alive, "v", "left_semi"), n), "ngram-sets")
    forget(spark, alive)

    def stored_sets(batches: Iterator[pa.RecordBatch]) -> holders.Sets:
        for batch in batches:
            lists = batch.column("s")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy().view(np.uint64)
            yield batch.column("v").to_pylist(), offsets, values

    def prefixes_of_part(table: pa.Table) -> pa.Table:
        keys, offsets, values, count, _ = holders.sets_of_part(table)
        size = np.diff(offsets)
        order = np.lexsort((values, count, np.repeat(np.arange(len(size)), size)))
        ordered, others = values[order].view(np.int64), count[order] - 1
        length, matches = choose_matches(others, offsets, percent)
        at = np.arange(len(values)) - np.repeat(offsets[:-1], size)
        open_ = (at < np.repeat(length, size)) & (others > 0)
        ends = np.concatenate([[0], np.cumsum(open_)])[offsets]
        some = np.flatnonzero(np.diff(ends))
        lists = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)).take(pa.array(some))
        task, flush = divmod(table.column("part")[0].as_py(), 1 << 32)
        numbers = (task << 44) + (flush << 18) + some
        prefix = {"share": np.diff(ends)[some] / size[some], "p": lists(ends, ordered[open_]), "i": lists(ends, at[open_].astype(np.int32))}
        return pa.table({"d": numbers, "v": pa.array([keys[k] for k in some], pa.binary()), "n": size[some].astype(np.int32), "m": matches[some].astype(np.int32), **prefix, "s": lists(offsets, values.view(np.int64))})

    buckets = holders.bucket_count(sets.agg(F.sum(F.size("s"))).first()[0])
    return holders.with_holders(sets.select("v", "s"), stored_sets, buckets, prefixes_of_part, "d long, v binary, n int, m int, share double, p array<long>, i array<int>, s array<long>")


def read_sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """v, s: the sets of the wanted(v, th) classes, from one of the texts(th, b) of each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("v", pa.binary()), ("s", pa.list_(pa.int64()))])
        for part, offsets, values in each_set(batches, n):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
            yield to_arrow(schema, v=pa.array(signatures(offsets, values), pa.binary()), s=lists)

    by_text = durable(wanted.groupBy("v").agg(F.min("th").alias("th")).select("th").distinct(), "ngram-texts")  # before it is counted
    chosen = texts.join(F.broadcast(by_text) if by_text.count() <= BROADCAST_KEYS else by_text, "th", "left_semi")
    chosen = chosen.groupBy("th", F.xxhash64("b", F.lit(1))).agg(F.first("b").alias("b"))
    return chosen.select("b").mapInArrow(scan, "v binary, s array<long>").where("v IS NOT NULL")


def close(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified_links(open_sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes that link, enough of them to join all that links join.

    The first rounds look at some of the n-grams only and compare each document with the hub that it
    meets most often, which joins most copies; the rounds after them take all n-grams that still hold
    documents of different components, and all their hubs.
    """
    spark = open_sets.sparkSession
    found = []
    entries = open_sets.select("d", "n", "share", F.explode(F.arrays_zip("p", "i")).alias("e"))
    rest, sample, hubs_each = entries.select(F.col("e.p").alias("t"), "d", "n", F.col("e.i").alias("i"), "share", F.col("d").alias("c")), list(SAMPLES), 1
    while True:
        some = sample.pop(0) if sample else 1
        ranked = rank_hubs(rest.where(F.pmod("t", F.lit(some)) == 0), hubs_each)
        tidy(spark)
        if ranked.isEmpty() and some == 1:
            forget(spark, ranked)
            break
        links = compare(ranked, open_sets, percent, some > 1)
        if some == 1:
            rest, hubs_each = ranked.where("NOT hub").select("t", "d", "n", "i", "share", "c"), hubs_each * 4  # what was a hub is done with
        if links is None:
            continue
        found.append(links)
        label = lambda e: ranked.select(F.col("d").alias(e), F.col("c").alias(f"c{e}")).distinct()  # noqa: B023, E731
        merged = contract(links.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        rest = relabelled(rest, merged)
        if some > 1:
            forget(spark, ranked)
    out = spark.createDataFrame([], "a long, b long")
    for links in found:
        out = out.unionByName(links)
    return out.distinct()


def relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with each component replaced by what it was merged into."""
    merged = merged.select(F.col("v").alias("c"), F.col("c").alias("root"))
    return rows.join(F.broadcast(merged) if merged.count() <= BROADCAST_KEYS else merged, "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")


def rank_hubs(rows: DataFrame, hubs_each: int) -> DataFrame:
    """rows of n-grams that hold documents of different components, with place and hub.

    Hubs are the first documents of an n-gram, one of each component before a second of any.  First come
    those that share most of their prefix with anyone: among near copies the least changed, which link
    to most others.
    """
    order = [F.col("share").desc(), F.xxhash64("d"), F.col("d")]
    in_gram = Window.partitionBy("t")
    open_ = rows.withColumn("low", F.min("c").over(in_gram)).withColumn("high", F.max("c").over(in_gram)).withColumn("all", F.count(F.lit(1)).over(in_gram)).where("low <> high")
    turn = F.row_number().over(Window.partitionBy("t", "c").orderBy(*order))
    ranked = open_.withColumn("turn", turn).withColumn("place", F.row_number().over(in_gram.orderBy("turn", *order)))
    hub = F.col("place") <= F.when(F.col("all") <= SMALL_GROUP, F.col("all")).otherwise(F.lit(hubs_each))
    return durable(ranked.select("t", "d", "n", "i", "share", "c", "place", hub.alias("hub")), "ngram-open")


def compare(ranked: DataFrame, open_sets: DataFrame, percent: int, first_only: bool) -> DataFrame | None:
    """Links between documents and hubs of other components; None without any.

    A pair shares at most what its prefixes share and what lies behind one of them; its sets are
    read only if that reaches what a link takes and the prefixes share the elements asked for.  An
    element brings a pair up only if it can be the first that the two share.  With first_only each
    document is compared with one hub, that which comes up by most elements.
    """
    spark = ranked.sparkSession
    x, y = ranked.select("t", "d", "n", "i", "c", "place").alias("x"), ranked.where("hub").select("t", "d", "n", "i", "c", "place").alias("y")
    # at the first element that a pair shares, what stands from it on in each set holds all they share
    reachable = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    pairs = x.join(y, F.col("x.t") == F.col("y.t")).where((F.col("x.c") != F.col("y.c")) & (F.col("x.place") > F.col("y.place")) & close(F.col("x.n"), F.col("y.n"), percent) & reachable)
    pairs = pairs.select(F.col("x.d").alias("a"), F.col("y.d").alias("b"))
    if first_only:
        most = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).groupBy("a").agg(F.max(F.struct("times", F.xxhash64("b"), "b")).alias("one"))
        pairs = most.select("a", "one.b")
    met = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-met")
    shared = F.size(F.array_intersect("p_a", "p_b"))
    behind = lambda e: F.ceil(F.col(f"n_{e}") * percent / 100) - F.col(f"m_{e}")
    enough = (shared + F.greatest(behind("a"), behind("b"), F.lit(0))) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    pairs = durable(with_sides(met, open_sets, "p", "n", "m").where((shared >= F.least("m_a", "m_b")) & enough).select("a", "b"), "ngram-pairs")
    forget(spark, met)
    if pairs.isEmpty():
        forget(spark, pairs)
        return None
    both = with_sides(pairs, open_sets, "s").withColumn("i", F.size(F.array_intersect("s_a", "s_b")))
    links = durable(both.where(F.col("i") * 100 >= (F.size("s_a") + F.size("s_b") - F.col("i")) * percent).select("a", "b"), "ngram-links")
    forget(spark, pairs)
    tidy(spark)
    return links


def with_sides(pairs: DataFrame, open_sets: DataFrame, *columns: str) -> DataFrame:
    """A written table of pairs with columns of both sides; where few are asked for, no others are shuffled."""
    if pairs.count() <= BROADCAST_KEYS:
        asked = pairs.select(F.col("a").alias("d")).unionAll(pairs.select(F.col("b").alias("d"))).distinct()
        open_sets = open_sets.join(F.broadcast(asked), "d", "left_semi")
    for e in ("a", "b"):
        pairs = pairs.join(open_sets.select(F.col("d").alias(e), *(F.col(k).alias(f"{k}_{e}") for k in columns)), e)
    return pairs
