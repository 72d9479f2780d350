import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratapanel.llm import materialise

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_feistel_permutes_any_range():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 1, 99):
            assert sorted(materialise.feistel(np.arange(size), size, key).tolist()) == list(range(size))
    a, b = (materialise.feistel(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9
    assert abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_shards_hold_every_token_once_in_slot_order(odd_docs, odd_rows, no_docs, tmp_path):
    root = f"file://{tmp_path}/order"
    df, where = materialise.write_in_order(odd_docs, PATH, 11, length=32, per_shard=50, root=root)
    got = df.collect()
    assert where == root
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all((r.shard, r.record) == divmod(r.slot, 50) for r in got)
    whole = materialise.read_from(root, 0, len(got) + 5, 32, 50)
    assert len(whole) == len(got)
    docs = {}
    for r in got:
        record = whole[r.slot]
        assert zlib.crc32(record.tobytes()) == r.ids_crc32
        assert (record[r.n_tokens :] == materialise.END_ID).all()
        at = 0
        for p in r.pieces:
            docs.setdefault(p.doc_id, []).append((p.start, record[at : at + p.length].tolist()))
            at += p.length
        assert at == r.n_tokens
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, t in odd_rows:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [materialise.END_ID])
    assert set(docs) == set(want)
    for i, parts in docs.items():
        if len(want[i]) == 1:
            assert sum((x for _, x in sorted(parts)), []) == want[i][0]
        assert sum(len(x) for _, x in parts) == sum(map(len, want[i]))
    resumed = materialise.read_from(root, 70, 60, 32, 50)
    assert (resumed == whole[70:130]).all()
    assert materialise.write_in_order(no_docs, PATH, 1)[0].collect() == []


def test_a_second_run_of_a_task_leaves_the_same_files(odd_docs, tmp_path):
    df, root = materialise.write_in_order(odd_docs, PATH, 3, length=64, per_shard=20, root=f"file://{tmp_path}/again")
    n = df.count()
    once = materialise.read_from(root, 0, n, 64, 20)
    df.count()
    assert (materialise.read_from(root, 0, n, 64, 20) == once).all()
    assert not [p for p in (tmp_path / "again").iterdir() if p.name.startswith(".")]


def brute_slot(index, size, key):
    """One number at a time through the network, walking on until it is back in range."""
    def mix(x, k):
        x = ((x ^ k) * 0xFF51AFD7ED558CCD) % 2**64
        x = ((x ^ x >> 33) * 0xC4CEB9FE1A85EC53) % 2**64
        return x ^ x >> 33

    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = index >> half, index % 2**half
        for r in range(materialise.ROUNDS):
            left, right = right, left ^ mix(right, mix(r + 1, key)) % 2**half
        index = left << half | right
        if index < size:
            return index


def test_slots_against_brute_force(odd_docs, tmp_path):
    for size in (1, 5, 1000):
        assert materialise.feistel(np.arange(size), size, 9).tolist() == [brute_slot(i, size, 9) for i in range(size)]
    docs = odd_docs.select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id", "text")  # one task, one order
    df, _ = materialise.write_in_order(docs, PATH, 5, length=32, per_shard=50, root=f"file://{tmp_path}/slots")
    tokenizer = Tokenizer.from_file(PATH)
    stream = []
    for r in docs.collect():
        stream += tokenizer.encode(r.text or "", add_special_tokens=False).ids + [materialise.END_ID]
    cut = [stream[i : i + 32] for i in range(0, len(stream), 32)]
    want = []
    for i, ids in enumerate(cut):
        padded = np.array(ids + [materialise.END_ID] * (32 - len(ids)), dtype="<u2").tobytes()
        want.append((brute_slot(i, len(cut), 5), len(ids), zlib.crc32(padded)))
    assert sorted((r.slot, r.n_tokens, r.ids_crc32) for r in df.collect()) == sorted(want)
