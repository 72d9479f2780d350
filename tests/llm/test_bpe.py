import hashlib
import json
import random

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer
from tokenizers.models import BPE

from stratapanel.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PATH = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_and_texts_equal_the_library(spark, odd_docs, odd_rows, tokenizer):
    with_ids = bpe.with_ids(odd_docs, PATH, out="score")  # a name that the table has
    got = bpe.with_text(with_ids, PATH, ids="score", out="fp")
    assert set(got.columns) == set(odd_docs.columns) and with_ids.count() == len(odd_rows)
    want = [(i, ids_of(tokenizer, t)) for i, t in odd_rows]
    want = [(i, x, tokenizer.decode(x, skip_special_tokens=False)) for i, x in want]
    rows = [(r.doc_id, r.score, r.fp) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_query(spark, tokenizer):
    got = {r.doc_id: r[1:] for r in queries.op13_prefix_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = ids_of(tokenizer, r.text)
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)))
        assert got[r.doc_id] == want


def test_empty_table(no_docs):
    assert bpe.round_trip(no_docs, PATH).count() == 0
    assert bpe.with_text(bpe.with_ids(no_docs, PATH), PATH).count() == 0


def test_strange_signs(tokenizer):
    rng = random.Random(8)
    signs = [chr(c) for c in range(1, 0x300)] + list("ßǅΣσςＡ😀é́中文ㄱ한‍　 ﬁ٣Ⅷ½") + [
        "<|endoftext|>", "<|startoftext|>", "<|", "'ll", "'S", " "]
    coder = bpe.PrefixCoder(PATH)
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(1500)]
    texts += ["a" * 5000, "ha" * 999, "<|endoftext|>" * 3, "x<|startoftext|>y"]
    for text, raw in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        ids = [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
        assert ids == ids_of(tokenizer, text), repr(text)
        assert coder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_prefixes_equal_merging_on_small_vocabularies(tmp_path):
    """Any merges learned from few letters, where overlaps and ties are frequent."""
    for seed in range(25):
        rng = random.Random(seed)
        vocab = {c: i for i, c in enumerate("abc")} | {f"{c}</w>": 3 + i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 30:
            open_ended = [t for t in vocab if not t.endswith("</w>")]
            a, b = rng.choice(open_ended), rng.choice(list(vocab))
            if a + b not in vocab:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        model = Tokenizer(BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>"))
        file = tmp_path / f"{seed}.json"
        model.save(str(file))
        spec = json.loads(file.read_text())
        spec["pre_tokenizer"] = {"type": "WhitespaceSplit"}
        file.write_text(json.dumps(spec))
        coder = bpe.PrefixCoder(str(file))
        for _ in range(300):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            raw = coder.encode_run(word)
            ids = [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
            assert ids == model.encode(word).ids, (seed, word, merges)
