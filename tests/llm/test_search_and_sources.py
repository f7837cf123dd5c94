"""Exact top-k and the WARC source."""
import gzip
import hashlib
import io
import math
import random

import numpy as np
import pytest

from clinograph.llm import bitsliced, warc
from clinograph.llm.common import work_path


def brute_top(rows, k, every):
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out, seen = [], set()
    for q, v in good:
        if q % every or q in seen:
            continue
        seen.add(q)
        found = sorted(((-int(v @ w), i) for i, w in good if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale, slices, block", [(0.1, 5, 100), (0.1, 2, 16384), (30.0, 4, 64), (0.0, 5, 64)])
def test_top_k_equals_brute_force(spark, scale, slices, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8) * scale]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one very common vector
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, [1.0] * 8), (2080, [0.5] * 3), (2100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = bitsliced.top_k(frame, k=20, every=20, slices=slices, block_rows=block, chunk_queries=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 20, 20)


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = bitsliced.top_k(frame).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top([(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [2.0, 0.0])], 20, 20)
    assert bitsliced.top_k(frame.where("false")).count() == 0


PAGES = "page_id long, url string, html string, record_type string"


def page_rows():
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a", big, None), (2, None, big, "clash"), (9, "http://b\r\nX: y", big, None), (3, "u", "small", None), (4, "u", "small", None), (6, "u", None, None), (7, "u", "", None), (8, "u", "y" * 300000, None), (2, None, big, "clash"), (None, "u", big, None), (None, "u", "alone " * 40, None)]
    return rows + [(100 + i, f"http://h/{i}", "common " * 30 if i % 3 else f"page {i} " * 20, None) for i in range(60)]


def want(rows):
    out, first = [], {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    count = [(html or "").encode() for _, _, html, _ in rows]
    for i, _, html, _ in rows:
        data = (html or "").encode()
        revisit = data in first and count.count(data) > 1 and (i is None or i > first[data])
        out.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else -1))
    return sorted(out)


def test_archive_round_trip(spark):
    rows = page_rows()
    got = warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want(rows)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_pushed_filters_and_columns(spark):
    rows = page_rows()
    path = work_path(spark, "warc-test")
    warc.write_pages(spark.createDataFrame(rows, PAGES).repartition(2), path)
    back = spark.read.format("warc").schema("page_id long, record_type string, payload binary").load(path)
    some = back.where("record_type = 'response' AND page_id > 4 AND page_id <= 8")
    assert sorted((r.page_id, bytes(r.payload)) for r in some.collect()) == sorted((i, (h or "").encode()) for i, _, h, _ in rows if i in (5, 6, 7, 8) and i != 5)
    assert spark.read.format("warc").schema("uri string").load(path).where("uri = 'http://h/7'").count() == 1
    assert back.where("page_id is null and record_type <> 'warcinfo'").count() == 2


class Counted:
    def __init__(self, *rows):
        self.data = b"".join(warc.member(warc.record(r)) for r in rows)


def row(page_id, payload):
    return {"page_id": page_id, "uri": "u", "record_type": "response", "payload": payload, "payload_bytes": len(payload), "payload_digest": "d", "refers_to": None}


def test_unwanted_payloads_are_not_inflated():
    data = Counted(*(row(i, bytes(1_000_000)) for i in range(5))).data
    records = warc.Records(io.BufferedReader(io.BytesIO(data)))
    seen = [headers["x-page-id"] for headers, _ in records]
    assert seen == list("01234") and records.inflated < 50_000
    assert gzip.decompress(data).count(b"WARC/1.1") == 5


def test_members_without_lengths_and_plain_records():
    rows = [row(i, b"payload %d " % i * 3000) for i in range(4)]
    packed = b"".join(gzip.compress(warc.record(r)) for r in rows)
    plain = b"".join(warc.record(r) for r in rows)
    for data in (packed, plain):
        got = [(h["x-page-id"], warc.payload_of(h, block()) if int(h["x-page-id"]) % 2 else None) for h, block in warc.Records(io.BufferedReader(io.BytesIO(data)))]
        assert got == [(str(i), rows[i]["payload"] if i % 2 else None) for i in range(4)]


def test_malformed_records(spark, tmp_path):
    good = [warc.record(row(i, b"payload %d " % i * 50)) for i in range(6)]
    no_figure = good[1].replace(b"Content-Length: ", b"Content-Length: x")
    plain = good[0] + no_figure + good[2] + good[3][:200] + b"\n" + good[4] + good[5][:-60]
    sized = [warc.member(r) for r in good]
    members = sized[0] + warc.member(no_figure) + sized[2] + warc.member(good[3][:100]) + sized[4] + sized[5][:-30]
    for k, data in enumerate((plain, members, gzip.compress(good[0]) + gzip.compress(good[1])[:-40], b"", b"no record at all\n")):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / f"a.warc{'.gz' if k in (1, 2) else ''}").write_bytes(data)
        warc.register(spark)
        read = lambda how: spark.read.format("warc").option("malformed", how).schema("page_id long, record_type string, payload binary").load(str(folder))  # noqa: B023, E731
        whole = {0: [0, 2, 4], 1: [0, 2, 4], 2: [0], 3: [], 4: []}[k]
        assert sorted((r.page_id, bytes(r.payload)) for r in read("skip").collect()) == [(i, b"payload %d " % i * 50) for i in whole]
        marked = [r.record_type for r in read("mark").collect()]
        assert marked.count("malformed") == {0: 3, 1: 3, 2: 1, 3: 0, 4: 1}[k] and marked.count("response") == len(whole)
        if k != 3:
            with pytest.raises(Exception, match="malformed"):
                read("fail").collect()


def test_large_components_are_scored_as_they_are_or_refused(spark):
    rng = random.Random(23)
    vectors = {i: [rng.choice([-1, 1]) * 2.0 ** rng.randrange(20, 25) + rng.randrange(64) / 64, rng.uniform(-9, 9)] for i in range(1, 200)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitsliced.top_k(rows, 3).collect()}
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    for q in range(20, 200, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -score) for score, i in best]
    with pytest.raises(ValueError):
        bitsliced.top_k(spark.createDataFrame([(20, [1e300, 1.0])], "vec_id long, embedding array<double>"), 3)
