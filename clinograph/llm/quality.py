"""Document quality by histogram gradient-boosted trees over statistics of the text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, slices
from .words import BLANK, word_hashes, word_spans

#: Labelled rows that the trees are fitted on at most, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: Single bytes whose share of the text is a feature.
MARKS = b"!?.,;:*#%&$|<>{}[]()@-_/\\='\"+~^"
_class = np.zeros((5, 256), bool)
_class[0, [*range(65, 91), *range(97, 123)]] = True  # ASCII letters
_class[1, range(65, 91)] = True  # upper case
_class[2, range(48, 58)] = True  # digits
_class[3] = BLANK
_class[4, 128:] = True  # beyond ASCII
LETTER, UPPER, DIGIT, BLANKS, WIDE = _class


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; all zeros for an empty one."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets).astype(np.float64)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    per_byte = np.bincount(row_of * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    share = lambda top, bottom: np.divide(top, bottom, out=np.zeros(rows), where=bottom > 0)
    counts = {n: per_byte[:, c].sum(1) for n, c in (("letter", LETTER), ("upper", UPPER), ("digit", DIGIT), ("blank", BLANKS), ("wide", WIDE))}
    lines = per_byte[:, 10] + (sizes > 0)
    columns = [np.log1p(sizes), share(counts["letter"], sizes), share(counts["upper"], counts["letter"]), share(counts["digit"], sizes), share(counts["blank"], sizes), share(counts["wide"], sizes), np.log1p(lines), share(sizes, lines)]
    columns += [share(per_byte[:, b], sizes) for b in MARKS]
    starts, ends, row = word_spans(data, offsets)
    words = np.bincount(row, minlength=rows).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    mean = share(np.bincount(row, length, rows), words)
    spread = np.sqrt(np.maximum(0, share(np.bincount(row, length**2, rows), words) - mean**2))
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    group = np.flatnonzero(first)
    each = np.diff(np.append(group, len(order)))
    top = np.zeros(rows)
    np.maximum.at(top, row[order][group], each)
    distinct = np.bincount(row[order][group], minlength=rows).astype(np.float64)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    begin = data[starts] if len(starts) else np.zeros(0, np.uint8)
    by_word = lambda flag: share(np.bincount(row, flag, rows), words)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LETTER[data] | WIDE[data], out=inside[1:])
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(UPPER[data], out=upper[1:])
    lettered = inside[ends] - inside[starts]
    columns += [np.log1p(words), mean, spread, longest, by_word(same), share(distinct, words), share(top, words), by_word(lettered == 0), by_word((upper[ends] - upper[starts] == lettered) & (lettered > 1)), by_word(~(LETTER | WIDE | DIGIT)[last]), by_word(UPPER[begin]), share(words, lines)]
    return np.stack(columns, axis=1).astype(np.float32)


N_FEATURES = 8 + len(MARKS) + 12


class Trees:
    """Complete binary trees in flat arrays: feature and threshold of inner nodes, value of leaves.

    Node k has the children 2k + 1 and 2k + 2, so a traversal is a gather a level for all rows at once.
    """

    def __init__(self, depth: int, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.depth, self.base, self.feature, self.threshold, self.value = depth, base, feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: int = 8) -> Trees:
    """Boosts trees on the logistic loss; splits are sought on histograms of quantile bins.

    Without rows or with one class only, the result scores every text alike.
    """
    n, inner, leaves = len(x), 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(depth, base if n else 0.0, feature[:0], threshold[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, offset = 2**level, 2**level - 1
            local = node - offset
            best = np.full(width, 1e-9)
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                cell = local * bins + binned[:, f]
                g, h, c = (np.bincount(cell, w, width * bins).reshape(width, bins) for w in (gradient, curvature, None))
                gl, hl, cl = (a.cumsum(1)[:, : len(edge)] for a in (g, h, c))
                gt, ht, ct = (a.sum(1, keepdims=True) for a in (g, h, c))
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain = np.where((cl >= least) & (ct - cl >= least), gain, 0)
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                feature[t, offset : offset + width][better] = f
                threshold[t, offset : offset + width][better] = edge[at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, curvature, leaves) + penalty)
        margin += value[t][leaf]
    return Trees(depth, base, feature, threshold, value)


def with_features(docs: DataFrame, model: Trees | None) -> DataFrame:
    """docs, whose last column is a text, with the score as a column more; without a model with the statistics.

    Columns come back by place, named c0, c1, ..., whatever their names were.
    """
    docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kinds = ", ".join(f"{c} {kind}" for c, kind in docs.dtypes)
    last = len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, last):
                x = features(*flat_bytes(part.column(last)))
                if model:
                    made = pa.array(model.probability(x))
                else:
                    made = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*batch.schema.names, "made"])

    return docs.mapInArrow(run, f"{kinds}, made {'double' if model else 'array<float>'}")


def held_out(id_col: str) -> F.Column:
    """Rows that learning may not see: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits trees on at most sample_rows labelled documents that are not held out.

    Null labels and ids don't count; an id labelled twice takes the larger label, and of rows that
    repeat an id that with the smallest text counts.  The sample is the labelled ids of smallest hash,
    so it doesn't depend on how the tables are laid out.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # at most sample_rows of them
    table = with_features(rows, None).drop("c2").toArrow().sort_by([("c0", "ascending")])
    x = np.array(table.column("made").to_pylist(), np.float32).reshape(table.num_rows, N_FEATURES)
    return fit(x, table.column("c1").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row, whole text; a null text counts as empty."""
    made = with_features(docs.select(id_col, text_col), model)
    return made.select(F.col("c0").alias(id_col), held_out("c0").alias("held_out"), F.col("made").alias("score"), (F.col("made") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least 0.5.  Columns may have any names."""
    order = [c for c in docs.columns if c != text_col] + [text_col]
    made = with_features(docs.select(*(F.col(f"`{c}`") for c in order)), model)
    kept = made.where(F.col("made") >= 0.5).drop("made").toDF(*order)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
