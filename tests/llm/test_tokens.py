"""Operators on tokens against the libraries and exact round trips."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from clinograph.llm import byte_bpe, packing, token_counts

ALPHABET = [*" \n\t'sdtrevml aéÀßÉσΣİ日\x1c\x85 　​́µº×0123½!", "<|endoftext|>", "<|startoftext|>", " the", "'re", "\r\n", "😀", "\x00", "'S"]


def samples(count=3000):
    rng = random.Random(3)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(count)]


def test_counts_equal_the_library():
    count, library = token_counts.TokenCounter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in [*samples(), "x" * 3000, "ab" * 2000]:
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_word_ids_equal_the_library():
    encode, library = packing.WordEncoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in samples():
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_bpe_equals_the_library_on_long_texts():
    bpe = byte_bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(5)
    long = " ".join(rng.choice(["word", "número", "12", "x,y", "\n\n z", "don't", "  "]) for _ in range(60000))
    for text in [*samples(500), long, "a" * 3000 + " b", " " * 2500 + "x", "日本" * 1500 + "1" * 900, "!?" * 2000 + long[:70000]]:
        ids = bpe.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()
    assert "".join(byte_bpe.pieces(long)) == long and len(list(byte_bpe.pieces(long))) > 1


def test_byte_bpe_looks_ahead_before_long_matches(tmp_path):
    path, pattern = str(tmp_path / "ranks"), r"\p{L}+|\s+(?!\S)|\s+"
    tokens = [bytes([i]) for i in range(256)] + [b"\t\t", b"\n\n", b"\t\t\t"]
    with open(path, "wb") as file:
        file.writelines(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens))
    bpe = byte_bpe.ByteBpe(path, pattern)
    long = "x" * 600
    for text in ["ab\t\t" + long, "\n\n" + long, "ab\t\t\t\t" + long + "\n\n" + long, long + "\t\ty" * 300, " ab \t\t\n\n" + long + "\t\t"]:
        assert bpe.encode(text) == bpe.encoding.encode_ordinary(text), repr(text)
    real = byte_bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for text in ["a" * 3000 + " x  y \n\n z'll 12345" * 300, "a\n\n\t\t" + "b" * 700 + "  c" * 400]:
        assert real.encode(text) == real.encoding.encode_ordinary(text)


def test_count_query(docs, empty, rows):
    got = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe_query(docs, empty, rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.round_trip(docs, path, P.PATTERN).collect()
    plain = byte_bpe.ByteBpe(path, P.PATTERN).encoding
    want = []
    for r in rows:
        ids = plain.encode_ordinary(r[1] or "")
        want.append((-1 if r[0] is None else r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r[1] or "").encode() for r in rows)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, empty, rows, capacity):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=capacity, open_windows=4, keep_ids=True).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])
    pieces, sequences = {}, {}
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(own) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id][0])
        pieces.setdefault(r.doc_id, []).append((r.start, own))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, wanted in ids.items():
        held = {}
        for start, own in pieces[doc]:
            held.setdefault(start, []).append(own)
        assert sorted(x for _, own in pieces[doc] for x in own) == sorted(x for w in wanted for x in w)
        if len(wanted) == 1:
            assert [x for start in sorted(held) for x in held[start][0]] == wanted[0]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(empty, path).count() == 0


def test_windows_keep_their_number_and_fill_best():
    windows = packing.Windows(10, 2)
    done = [x for size in (6, 5, 4, 5, 3, 8) for x in windows.add(size, size)]
    assert [sorted(p) for _, p in done] == [[4, 6], [5, 5]] and len(windows.free) == 2
