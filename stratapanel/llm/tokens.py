"""Public tokenizers inside tasks; their files' paths are parameters."""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and runs that a worker process remembers (about 150 bytes each) before the older half goes.
PIECES, RUNS = 300_000, 150_000
#: Hash values, a power of two, of which a memory notes whether they came up.
SEEN = 1 << 22
#: Visible characters below U+0250 but one: composed, with a single lower case, no blanks among them.
_PLAIN = re.compile(r"[!-~\u00A1-\u012F\u0131-\u024F\n]+")
#: How the tokenizer's file splits lower-cased text, said for plain characters, where the only numbers
#: that are no decimal digits are the six listed. A line end stands between pieces.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+|\n")
#: Between the ids of two pieces. No id has this upper byte, so it is not found inside or across ids.
_BETWEEN = b"\xff\xff"
_PACK = [struct.Struct(f"<{n}H").pack for n in range(16)]


class Memory:
    """What was computed lately and asked for more than once, in two generations.

    A key is kept from the second time on that it is computed, so the many words that occur once take no
    room: a bit for each hash value, fixed in number, tells which were computed before. When half of
    ``most`` are kept, the older generation goes and the younger becomes the older.
    """

    def __init__(self, most: int) -> None:
        self.half = most // 2
        self.known: dict[Any, bytes] = {}
        self.older: dict[Any, bytes] = {}
        self.seen = np.zeros(SEEN, dtype=bool)

    def resolve(self, keys: list, compute: Callable[[list], Iterable[bytes]]) -> list[bytes]:
        """The values of these distinct keys, in their order, computed where they are not kept."""
        found = list(map(self.known.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        again = {}
        if self.older and missing:
            for i in missing:
                found[i] = self.older.get(keys[i])
            again = {keys[i]: found[i] for i in missing if found[i] is not None}
            missing = [i for i in missing if found[i] is None]
        if missing:
            new = [keys[i] for i in missing]
            made = list(compute(new))
            for i, value in zip(missing, made, strict=True):
                found[i] = value
            bits = np.fromiter(map(hash, new), dtype=np.int64, count=len(new)) & (SEEN - 1)
            before = np.nonzero(self.seen[bits])[0].tolist()
            self.seen[bits] = True
            again |= {new[k]: made[k] for k in before}
        if len(self.known) + len(again) > self.half:
            self.older, self.known = self.known, {}
            self.seen[:] = False
        self.known |= again
        return found


class WordEncoder:
    """Token ids of whole texts with a tokenizer that never joins across blanks.

    Such a tokenizer gives a text the ids of its blank-separated pieces, one after the other, and a
    piece the ids of its runs of letters, digits and other signs. Each is encoded once and remembered;
    the ids are those of the whole text. The new pieces of some texts are lower-cased and split
    together and only their new runs are encoded; pieces that are not plain go through the whole
    tokenizer. Ids must fit 16 bits, with an upper byte below 255.
    """

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = tokenizer_of(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        lower = {chr(c).lower() for c in range(0xA1, 0x250) if c != 0x130}
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in lower}
        self.runs = Memory(RUNS)
        self.pieces = Memory(PIECES)

    def encode_run(self, run: str) -> bytes:
        """Ids of one run, in the byte alphabet."""
        ids = [t.id for t in self.model.tokenize(run)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}H", *ids)

    def encode_odd(self, piece: str) -> bytes:
        """Ids of a piece as the tokenizer's own rules give them."""
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _encode_runs(self, runs: list[str]) -> Iterable[bytes]:
        for run in runs:
            yield _BETWEEN if run == "\n" else self.encode_run(run if run.isascii() else run.translate(self.bytes))

    def _encode_pieces(self, pieces: list[bytes]) -> Iterable[bytes]:
        if not pieces:
            return []
        text = b"\n".join(pieces).decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return self._encode_mixed(text.split("\n"))
        runs = _SPLIT.findall(text.lower())
        distinct = list(set(runs))
        known = dict(zip(distinct, self.runs.resolve(distinct, self._encode_runs), strict=True))
        return b"".join(map(known.__getitem__, runs)).split(_BETWEEN)

    def _encode_mixed(self, pieces: list[str]) -> list[bytes]:
        plain = [p for p in pieces if _PLAIN.fullmatch(p) and "<|" not in p]
        made = iter(self._encode_pieces([p.encode() for p in plain]))
        return [next(made) if _PLAIN.fullmatch(p) and "<|" not in p else self.encode_odd(p) for p in pieces]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, little-endian, 16 bits each.

        Arrow cuts the texts and numbers their distinct pieces, so only those are looked up one by one; the ids
        of all places are then copied from the ids of the distinct pieces by number.
        """
        if not texts:
            return []
        whole = pa.array(texts, type=pa.large_binary()).view(pa.large_string())
        cut = pc.ascii_split_whitespace(whole)
        distinct = cut.flatten().dictionary_encode()
        pieces = distinct.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        made = pa.array(self.pieces.resolve(pieces, self._encode_pieces), type=pa.large_binary())
        placed = made.take(distinct.indices)
        stream = placed.buffers()[2]
        if stream is None:
            return [b""] * len(texts)
        ends = np.frombuffer(placed.buffers()[1], dtype=np.int64)
        stream, bounds = memoryview(stream), ends[cut.offsets.to_numpy()].tolist()
        return [bytes(stream[a:b]) for a, b in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Any:
    """One tokenizer for each worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process: the words of one task are mostly those of the next."""
    return WordEncoder(path)


class ByteEncoder:
    """Byte-level BPE from a rank file: the tokens of a text, put together, are its bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of a whole text begins and ends, in bytes."""
        ids = np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        return np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ids) else ends, ends


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for each worker process."""
    return ByteEncoder(path, pattern)
