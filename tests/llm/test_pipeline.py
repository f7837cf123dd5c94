"""The pipeline's stages on small documents, each against brute force."""
import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from clinograph.llm.common import durable

from .conftest import OWN
from .conftest import SCHEMA as WIDE
from .test_documents import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def world(tmp_path, spark):
    rng = random.Random(11)
    clean = lambda n: " ".join(rng.choice(["river", "stone", "the", "of", "light", "and", "morning", "walked", "slowly", "home"]) + str(rng.randrange(3000)) for _ in range(n))
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "%%%", "CLICK###"]) for _ in range(80))
    base, passage = clean(200), clean(60)
    near = base.split()
    near[100] = "other"
    rows = [(i, clean(80) if i % 4 else junk(), "en", "s", 1) for i in range(240)]
    rows += [(1000, base, "en", "s", 1), (1001, base, "en", "s", 1), (1002, " ".join(near), "en", "s", 1), (1003, clean(50) + " " + passage + " " + clean(50), "en", "s", 1), (1004, clean(70) + " é" + passage, "en", "s", 1), (1005, "", None, None, None), (1006, None, None, None, None), (1000, base, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, str(tmp_path), passage


def brute_cut(texts, length):
    words = {i: (t or "").split() for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + length]) for w in words.values() for k in range(len(w) - length + 1))
    gone = {i: {j for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for j in range(k, k + length)} for i, w in words.items()}
    return {i: [x for j, x in enumerate(w) if j not in gone[i]] for i, w in words.items()}


def test_stages(spark, tmp_path):
    rows, folder, passage = world(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = durable(pipeline.classify(spark, docs, folder), "t")
    assert good.columns == docs.columns
    kept = {r.doc_id: r for r in good.collect()}
    assert all(i in kept for i, *_ in rows if i < 240 and i % 4) and not any(i < 240 and i % 4 == 0 for i in kept)
    assert {1000, 1001, 1002, 1003, 1004} <= set(kept)

    single = durable(pipeline.join_near_copies(spark, good, folder), "t")
    assert single.columns == docs.columns
    groups = brute_components([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted({i for i, _, c in groups if c == i})

    cut = durable(pipeline.cut_passages(spark, single, folder), "t")
    assert cut.columns == docs.columns and cut.count() == single.count()
    got = {r.doc_id: r for r in cut.collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert passage[:200] not in got[1003].text and passage[:200] not in got[1004].text
    assert {i: (r.text or "").split() for i, r in got.items()} == brute_cut(before, pipeline.PASSAGE_WORDS)
    assert all(got[i].text == t and got[i].n_chars in (1, None) for i, t in before.items() if i not in (1003, 1004))
    assert got[1003].n_chars == len(got[1003].text)

    pieces = pipeline.pack_sequences(spark, cut, folder).collect()
    assert {p.doc_id for p in pieces} == set(got)


def test_only_passages_of_over_fifty_words_are_cut(spark):
    rng = random.Random(13)
    prose = lambda n, letters=8: " ".join("".join(rng.choices("abcdefghijklmnop", k=letters)) for _ in range(n))
    own = lambda: "<" + prose(20) + "> "
    fifty, more, short, copy = prose(50), prose(51), prose(51, 1), prose(40)
    rows = [(i, own() + p + " " + own()) for p, i in ((fifty, 1), (fifty, 2), (more, 3), (more, 4), (short, 5), (short, 6))] + [(7, copy), (8, copy), (9, more), (10, more)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in pipeline.cut_passages(spark, docs, "").collect()}
    before = dict(rows)
    assert all(got[i].text == before[i] for i in (1, 2, 7, 8))
    assert all(p not in got[i].text and 300 < len(got[i].text) == got[i].n_chars for p, i in ((more, 3), (more, 4), (short, 5), (short, 6)))
    assert got[9].text == got[10].text == ""


def test_run(spark, tmp_path):
    _, folder, _ = world(tmp_path, spark)
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() >= 180


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_stages_take_edge_rows_and_nothing(spark, tmp_path, docs, empty, rows, stage):
    spark.createDataFrame([(r[0], int(r[1] is not None and len(r[1]) < 900), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, empty):
        out = stage(spark, frame, str(tmp_path))
        assert out.count() <= 3 * max(1, frame.count())
        if stage is not pipeline.pack_sequences:
            assert out.columns == [f.split()[0] for f in WIDE.split(", ")]
            assert {tuple(r[8:]) for r in out.collect()} <= {OWN, (None,) * len(OWN)}
