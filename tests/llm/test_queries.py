"""The registered queries on the small tables, against SQL, the libraries or brute force."""
import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry

from .test_documents import brute_components


def result(spark, data_dir, name):
    return entry.queries()[name](spark, data_dir).collect()


@pytest.fixture(scope="module")
def texts(data_dir):
    table = pq.read_table(os.path.join(data_dir, "documents.parquet"), columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], (t or "" for t in table["text"])))


def test_all_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {"op2_warc", "op7_bitsliced_topk"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op2_warc", "op7_bitsliced_topk"])
def test_against_sql(spark, data_dir, name):
    db = duckdb.connect()
    for table in ("pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    key = lambda row: tuple((x is not None, x) for x in row)
    got = [tuple(r[c] for c in want.columns) for r in result(spark, data_dir, name)]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


def test_join(spark, data_dir, texts):
    got = result(spark, data_dir, "op1_ngram_join")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(texts.items()), 4, 85)


def test_dedup(spark, data_dir, texts):
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(b[k : k + 400]) for b in data.values() for k in range(len(b) - 399))
    words = {i: t.split() for i, t in texts.items()}
    runs = Counter(hash(tuple(w[k : k + 51])) for w in words.values() for k in range(len(w) - 50))
    for r in result(spark, data_dir, "op3_suffix_dedup"):
        b, gone = data[r.doc_id], np.zeros(len(data[r.doc_id]) + 1, bool)
        for k in range(len(b) - 399):
            if seen[hash(b[k : k + 400])] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        w = words[r.doc_id]
        repeated = {j for k in range(len(w) - 50) if runs[hash(tuple(w[k : k + 51]))] > 1 for j in range(k, k + 51)}
        assert r.passage_words == len(repeated)


def test_shards(spark, data_dir, texts):
    got = result(spark, data_dir, "op4_histogram_shards")
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()} and len(got) == len(texts)
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 24 for r in got)
    sizes, most = Counter(), max(r["size"] for r in got)
    for shard in range(24):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[shard] = sum(r["size"] for r in own)
    mean = sum(sizes.values()) / 24
    assert all(abs(s - mean) <= most + 0.05 * mean for s in sizes.values())
    groups = {}
    for r in got:
        groups.setdefault(texts[r.doc_id], []).append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values() if sum(r["size"] for r in g) < mean / 2)


def test_quality(spark, data_dir, texts):
    got = {r.doc_id: r for r in result(spark, data_dir, "op5_quality_trees")}
    labels = pq.read_table(os.path.join(data_dir, "labels.parquet")).to_pydict()
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in zip(labels["doc_id"], labels["quality"]) if i in got and got[i].held_out]
    assert held and np.mean([a == b for a, b in held]) > 0.9


def test_media(spark, data_dir, texts):
    for r in result(spark, data_dir, "op6_jpeg_media"):
        data = texts[r.doc_id].encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_tokens(spark, data_dir, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    got = result(spark, data_dir, "op8_token_counts")
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(texts[i].encode()), n, n > 512) for i, n in counts.items()}


def test_byte_bpe(spark, data_dir, texts):
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in result(spark, data_dir, "op9_byte_bpe"):
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_packing(spark, data_dir, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sequences, pieces = {}, {}
    for r in result(spark, data_dir, "op10_packing"):
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_trees_against_plain_search():
    """The first split is the best of all thresholds, and traversal is what walking node by node gives."""
    from clinograph.llm import quality

    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (300, 3)).astype(np.float32)
    y = (x[:, 1] + rng.normal(0, 1.5, 300) > 4).astype(float)
    trees = quality.fit(x, y, trees=3, depth=3, least=5)
    p = (y.sum() + 0.5) / 301
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(f, cut):
        left = x[:, f] <= cut
        if min(left.sum(), (~left).sum()) < 5:
            return 0.0
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return score(left) + score(~left) - score(np.ones(300, bool))

    best = max(((gain(f, c), f, c) for f in range(3) for c in range(9)), key=lambda r: r[0])
    assert trees.feature[0, 0] == best[1] and np.isclose(gain(int(trees.feature[0, 0]), trees.threshold[0, 0]), best[0])
    for row, margin in zip(x, trees.margin(x)):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert np.isclose(total, margin)
