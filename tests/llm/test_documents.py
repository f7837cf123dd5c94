"""Operators on documents against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clinograph.llm import components, jpeg_media, ngram_join, quality, sharding, suffix_dedup

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((-1 if i is None else i, len(s), -1 if (c := least.get(find(k), i)) is None else c) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(docs, rows, n, percent):
    got = ngram_join.link_components(docs, n, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components([(r[0], r[1]) for r in rows], n, percent)


def test_components_of_a_hot_group_and_chains(spark):
    words = [f"k{i}" for i in range(60)]
    rows = []
    for i in range(60):  # every copy differs from the next by little, the ends by much
        own = list(words)
        for j in range(i):
            own[j] = f"z{j}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join([*words[:50], *(f"q{i}x{j}" for j in range(6))])) for i in range(40)]
    rows += [(200 + i, "same text for a third of all rows here") for i in range(50)]
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_components_of_nothing(empty):
    assert ngram_join.link_components(empty).count() == 0


def test_longer_prefixes_are_chosen_for_common_elements():
    counts = np.array([1.0] * 3 + [1000.0] * 27)
    assert ngram_join.choose_matches(np.zeros(30), np.array([0, 30]), 85)[1][0] == 1
    length, matches = ngram_join.choose_matches(np.sort(counts), np.array([0, 30]), 85)
    assert matches[0] > 1 and length[0] == 30 - 26 + matches[0]


def test_contract(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.v: r.c for r in components.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {200: 100, 150: 100}


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [400, 48])
def test_repeats_equal_brute_force(docs, rows, length):
    got = suffix_dedup.remove_repeats(docs, length).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats([r[1] for r in rows], length)


def test_repeats_of_common_anchors(docs, rows, monkeypatch):
    whole = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda texts, length, units: whole(texts, length, units, most_contexts=1))
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats([r[1] for r in rows], 100)


def test_repeats_in_segments_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    text = "".join(chr(97 + (i * i // 7) % 26) for i in range(4000))
    rows = [(1, text + text[500:2500]), (2, text[1200:1900])]
    import pyarrow as pa
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    parts = list(suffix_dedup.anchors_of_text(data[0], 60, 15))
    assert sum((hi - lo + 1).sum() for _, lo, hi, _, _ in parts) == len(data[0]) - 59
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats([t for _, t in rows], 60)


def test_repeats_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_matching_statistics_are_longest_matches(kind):
    contexts = [b"banana" * 9, b"bandana" * 7, b"banana" * 9 + b"x", b"\x00\xff" * 20, b"an", bytes(random.Random(3).choices(b"ab", k=90))]
    index = suffix_dedup.RunIndex([np.frombuffer(c, np.uint8).astype(kind) * kind(1 if kind is np.uint8 else 2**55 + 1) for c in contexts])
    got = index.matching_statistics()
    ends = [c[i:] for c in contexts for i in range(len(c))]
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    best = [max(common(x, y) for j, y in enumerate(ends) if j != i) for i, x in enumerate(ends)]
    inner = np.concatenate([np.arange(s, s + len(c)) for s, c in zip(index.starts, contexts)])
    assert got[inner].tolist() == best
    assert index.runs < len(index.symbols) // 2


def test_equal_windows_of_one_anchor_go_through_the_index(docs, monkeypatch):
    marked = []
    inner = suffix_dedup.index_spans
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    shared = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(20)) + " " + shared + " " + " ".join(word() for _ in range(20)) for _ in range(5)]
    for length, units in ((100, suffix_dedup.BYTES), (12, suffix_dedup.WORDS)):
        values = [units.read(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
        spans = inner(values, [True] * 5, length)
        marked.append(sorted({z - a + length for _, a, z in spans}))
    assert marked[0][0] >= len(shared.encode()) and marked[1] == [40]


def test_words_of_repeated_passages(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    fifty, more, copy = prose(50), prose(51), prose(70)
    rows = [(1, prose(30) + " " + fifty + " " + prose(9)), (2, fifty + " " + prose(70)), (3, prose(9) + "\n" + more + " " + prose(60)), (4, more.replace(" ", "  ") + " " + prose(80)), (5, copy), (6, copy), (7, prose(300)), (8, None), (9, "")]
    got = {r.doc_id: r.passage_words for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, passage_words=51).collect()}
    assert got == {1: 0, 2: 0, 3: 51, 4: 51, 5: 70, 6: 70, 7: 0, 8: 0, 9: 0}


def test_cut_texts_stay_text(docs, rows):
    got = suffix_dedup.with_repeats_removed(docs, 48).collect()
    assert len(got) == len(rows) and set(docs.columns) < set(got[0].asDict())
    assert all(r.was_cut or r.text in {x[1] for x in rows} for r in got)
    assert sum(r.text is None for r in got) == sum(x[1] is None for x in rows)


def test_shards(docs, rows, empty):
    got = sharding.shard_by_bytes(docs, 5, 0.05).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((-1 if x[0] is None else x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows)
    for shard in range(5):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(6000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24, 0.01).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) < 0.03 * mean


def test_media(spark, docs, rows, empty):
    got = jpeg_media.media_features(jpeg_media.store_media(docs)).collect()
    want = []
    for r in rows:
        data = (r[1] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want.append((len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert jpeg_media.media_features(jpeg_media.store_media(empty)).count() == 0
    stored = {bytes(r.media) for r in jpeg_media.store_media(docs).collect()}
    told = {hashlib.sha256(m).hexdigest(): (len(m), m) for m in stored}
    assert all(told[r.media_sha256][0] == r.media_bytes for r in got)
    for r in got:
        if r.n_bytes < 10_000:
            image, blocks = told[r.media_sha256][1], -(-max(1, r.n_bytes) // 64)
            grid = plain_blocks(image)
            assert hashlib.sha256(b"".join(bytes(v + 128 if v < 0 else v + 127 for v in block) for block in grid[:blocks])).hexdigest() == r.payload_sha256
            side = math.ceil(math.sqrt(blocks))
            thumb = np.array([min(255, max(0, round(block[0] / 8 + 128))) for block in grid], np.uint8).reshape(-1, side)
            assert r.feature.startswith(f"{8 * side}x{8 * len(thumb)}:") and r.feature.endswith(f":{zlib.crc32(thumb.tobytes()):08x}")


def plain_blocks(data):
    """The blocks of a grey image with a restart after each, bit by bit."""
    tables, at = {}, 2
    while data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xC4:
            tables[body[0]] = {(f"{code:0{length}b}"): symbol for symbol, (code, length) in codes(list(body[1:17]), list(body[17:])).items()}
        at += 2 + size
    scan, out = data[at + 2 + int.from_bytes(data[at + 2 : at + 4], "big") : -2], []
    for part in re.split(rb"\xff[\xd0-\xd7]", scan):
        bits, place, block = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff")), 0, []
        while len(block) < 64:
            table, length = tables[0x10 if block else 0], 1
            while bits[place : place + length] not in table:
                length += 1
            symbol = table[bits[place : place + length]]
            assert symbol >> 4 == 0 and symbol
            raw = bits[place + length : place + length + symbol]
            block.append(int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << symbol) + 1)
            place += length + symbol
        assert len(bits) - place < 8
        out.append(block)
    return out


def test_media_that_hold_nothing(spark):
    good = jpeg_media.encode(b"some text " * 30)
    rows = [(1, None), (2, b""), (3, b"no image"), (4, good[:200]), (5, good[: len(good) // 2]), (6, good.replace(b"payload", b"nothing")), (7, good), (8, good[:-40] + b"\xff\xd9")]
    got = {r.doc_id: r for r in jpeg_media.media_features(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()}
    assert got[1].media_bytes is None and got[1].feature is None
    assert all(got[i].media_bytes == len(rows[i - 1][1]) and got[i].feature is None and got[i].n_bytes is None for i in (2, 3, 4, 5))
    assert got[6].feature == got[7].feature and got[6].n_bytes is None and got[7].n_bytes == 300
    assert got[7].payload_sha256 == hashlib.sha256(b"some text " * 30 + bytes(20)).hexdigest()



class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def number(self, value):
        size = abs(value).bit_length()
        self.put(value if value > 0 else value + (1 << size) - 1, size)

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def codes(counts, symbols):
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@pytest.mark.parametrize("restart", [0, 2])
def test_any_baseline_scan_is_decoded(restart):
    """Three components, 2 x 2 luminance sampling, zero runs, ends of blocks and restart markers."""
    import random
    import struct

    rng = random.Random(1)
    dc_table = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    ac_symbols = [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 5))]
    ac_table = ([0] * 7 + [len(ac_symbols)] + [0] * 8, ac_symbols)
    dc, ac = codes(*dc_table), codes(*ac_table)
    width, height, sampling = 40, 24, {1: (2, 2), 2: (1, 1), 3: (1, 1)}
    mcus_x, mcus_y = 3, 2
    grids = {c: np.zeros((mcus_y * v, mcus_x * h, 64), int) for c, (h, v) in sampling.items()}
    for g in grids.values():
        for block in g.reshape(-1, 64):
            block[0] = rng.randint(-500, 500)
            for k in rng.sample(range(1, 64), rng.choice([0, 1, 5])):
                block[k] = rng.choice([-9, -1, 1, 7])
    parts, bits, last = [], Bits(), dict.fromkeys(sampling, 0)
    for mcu in range(mcus_x * mcus_y):
        if restart and mcu and mcu % restart == 0:
            parts.append(bits.data())
            bits, last = Bits(), dict.fromkeys(sampling, 0)
        for c, (h, v) in sampling.items():
            for y in range(v):
                for x in range(h):
                    block = grids[c][mcu // mcus_x * v + y, mcu % mcus_x * h + x].tolist()
                    bits.put(*dc[abs(block[0] - last[c]).bit_length()])
                    bits.number(block[0] - last[c])
                    last[c], run = block[0], 0
                    for k in range(1, 64):
                        if not any(block[k:]):
                            bits.put(*ac[0])
                            break
                        if block[k] == 0:
                            run += 1
                            continue
                        while run > 15:
                            bits.put(*ac[0xF0])
                            run -= 16
                        bits.put(*ac[run << 4 | abs(block[k]).bit_length()])
                        bits.number(block[k])
                        run = 0
    parts.append(bits.data())
    scan = parts[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
    segment = jpeg_media.segment
    data = b"\xff\xd8" + segment(0xDB, bytes([0] + [16] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += segment(0xC4, bytes([0, *dc_table[0], *dc_table[1]])) + segment(0xC4, bytes([16, *ac_table[0], *ac_table[1]])) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    data += segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    image = jpeg_media.Jpeg(data)
    for c, grid in jpeg_media.decode_scan(image).items():
        assert (grid == grids[c]).all()
    assert (jpeg_media.thumbnail(image) == np.clip(np.rint(grids[1][:, :, 0] * 2 + 128), 0, 255)).all()


def test_trees_learn_and_score_everything(spark, docs, empty):
    import random

    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "over", "stones.", "Then", "night", "came,"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$", "%%%", "CLICK"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    got = quality.score(table, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 > 0) and 0 <= r.score <= 1 for r in got)
    assert quality.score(docs, model).count() == docs.count()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.score(empty, model).count() == 0
    none = quality.train(table, labels.where("false"))
    assert {r.score for r in quality.score(table, none).collect()} == {0.5}


def test_features_are_by_text():
    texts = ["Some words, some words!", "", "x", "A B\nC " * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = quality.features(data, offsets)
    alone = np.concatenate([quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts])
    assert together.shape == (4, quality.N_FEATURES) and np.allclose(together, alone) and not together[1].any()
