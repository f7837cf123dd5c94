import random

import pytest

#: Columns that operators might call their own.
CLASHING = "b string, k int, sha string, kept boolean, n_bytes long, was_cut boolean, cut_text string, known_id long, known_label int, quality_text string, id string, label int, made double, c0 string, v string, t long, slot long, part int".split(", ")
SCHEMA = ", ".join(["doc_id long, text string, lang string, source string, n_chars long, score double, shard int, component_id string", *CLASHING])
OWN = ("own b", 1, "own sha", False, 7, True, "own cut text", 5, 1, "own quality text", "own id", 0, 0.25, "own c0", "own v", 9, 8, 2)


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edge_rows():
    """Nulls, empty and white texts, ties, repeated rows, copies, near copies, passages and one long text."""
    rng = random.Random(7)
    base, passage = prose(rng, 300), prose(rng, 90, 10**6)
    near = base.split(" ")
    near[150] = "changed"
    texts = [None, "", "   \n\t ", "one", "One two", "one TWO", "a b c d", "a b c d e", base, base, base.upper(), " ".join(near), base + " tail",
             prose(rng, 200) + " " + passage + " " + prose(rng, 40), passage + " " + prose(rng, 150), prose(rng, 60) + "\n" + passage,
             "To To " * 300, "é日本語 ünïcode 😀 " * 30, "<|endoftext|> inside <|startoftext|> text", "x" * 5000, prose(rng, 30000, 500), "don't we'll 's 12345 ... !!!     z"]
    texts += [prose(rng, 120) for _ in range(12)]
    rows = [(i * 10, t, None if i % 3 else "en", "src0", None if i % 2 else 1, 0.5, 3, "clash", *OWN) for i, t in enumerate(texts)]
    rows += [rows[8], rows[13], (None, "no id here at all", *[None] * (6 + len(OWN))), (990, None, *[None] * (6 + len(OWN)))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
