import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratapanel.llm import packing
from stratapanel.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_encoder_equals_the_tokenizer(odd_rows, tokenizer):
    texts = [t or "" for _, t in odd_rows] + ["\x1c a\x1cb ́x ", "é ́", "ok<|startoftext|>ok <|endof text|>", "ǅ ﬁ İI ΑΣ ΑΣΑ 中文 字", "ȺB ɐȾ ſß ŉ ǰ",
        "".join(chr(c) + ("" if c % 7 else " ") for c in range(33, 0x24F)), "don't 'S'RE x'll 12ab3²½ª%$a-b\x7f"]
    encoder = WordEncoder(PATH)
    for got, t in zip(encoder.encode([t.encode() for t in texts]), texts, strict=True):
        assert np.frombuffer(got, dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:60]


def test_hilbert_visits_every_cell_by_single_steps():
    for dims, depth in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << depth)] * dims)).reshape(dims, -1).T
        key = packing.hilbert(cells, depth)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_every_id_lies_in_one_piece(odd_docs, odd_rows, tokenizer, no_docs):
    got = packing.pack(odd_docs, PATH, length=64).collect()
    texts = sorted(((i is None, i or 0), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in odd_rows)
    docs = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault((r.doc_id is None, r.doc_id or 0), []).append((r.start, r.doc_tokens, tuple(ids.tolist())))
    rebuilt = []
    for d, pieces in docs.items():  # rows of one doc_id follow each other piece by piece
        open_, at = [], 0
        for start, total, ids in pieces:
            assert start == at
            open_ += ids
            at += len(ids)
            if at == total:
                rebuilt.append((d, tuple(open_)))
                open_, at = [], 0
        assert not open_
    assert sorted(rebuilt) == texts
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(used) == list(range(len(used)))
    for s, spans in used.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 64 or s == len(used) - 1
    assert packing.pack(no_docs, PATH).collect() == []


def test_range_lookup(spark):
    bounds = [3, 5, 9, 20, 21, 40, 77]
    got = packing.in_ranges(spark.range(100), "id", bounds, "r").collect()
    assert all(r.r == sum(b <= r.id for b in bounds) for r in got)
    assert {r.r for r in packing.in_ranges(spark.range(9), "id", [], "r").collect()} == {0}


def test_neighbours_on_the_curve_are_alike(spark):
    rng = np.random.default_rng(0)
    topics = [[f"{a}{i}" for i in range(40)] for a in ("red", "blue", "green", "grey")]
    rows = [(i, " ".join(rng.choice(topics[i % 4], 200))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.encode_documents(docs, PATH).orderBy("curve").collect()
    order = [r.doc_id % 4 for r in got]
    same = sum(a == b for a, b in zip(order, order[1:]))
    assert same > 100  # by chance it would be 50


def test_order_and_cuts_against_brute_force(odd_docs, tokenizer):
    signs, bits, length = packing.projection(), packing.TIE_BITS, 64
    line = []
    for r in odd_docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tie")).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        if ids:
            seen = sorted(set(ids))
            mean = sum(signs[i].astype(float) for i in seen) / len(seen) ** 0.5
            cell = [min(int(1024 / (1 + math.exp(-1.7 * m))), 1023) for m in mean]
        else:
            cell = [512] * packing.DIMS
        curve = int(packing.hilbert(np.array([cell]))[0]) << bits | r.tie % 2**64 >> 64 - bits
        line.append((curve, r.doc_id is not None, r.doc_id or 0, len(ids) + 1, ids + [packing.END_ID]))
    want, at = [], 0
    for _, known, doc, total, ids in sorted(line):
        start = 0
        while start < total:
            n = min(length - at % length, total - start)
            piece = np.array(ids[start : start + n], dtype="<u4").tobytes()
            want.append((doc if known else None, start, n, zlib.crc32(piece), total, at // length, at % length))
            start, at = start + n, at + n
    got = packing.pack(odd_docs, PATH, length=length).drop("ids").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_encoder_numbers_distinct_pieces():
    """Ids of odd blanks and repeats are the tokenizer's; each distinct piece is computed once, in the order asked."""
    from stratapanel.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", " ", "a", " a  b\x0b\x0cc\t\r\n", "\x1c x\x1d y", "café  é don't <|endoftext|> 12½", "\n\n", "word " * 3000]
    whole = tokens.tokenizer_of(path)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    encoder = tokens.WordEncoder(path)
    for given in (slice(None), slice(None, None, -1), slice(0, 1), slice(0, 0)):
        assert encoder.encode([t.encode() for t in texts[given]]) == want[given]
    asked = []
    memory = tokens.Memory(4)
    for keys in (["b", "a"], ["a", "c", "b"], ["c", "a", "d"], ["a", "d", "b"]):
        assert memory.resolve(keys, lambda new: [asked.append(k) or k.encode() for k in new]) == [k.encode() for k in keys]
    assert asked[:2] == ["b", "a"]
    assert tokens.PIECES + tokens.RUNS <= 450_000  # at about 150 bytes, six workers keep 0.4 GB
