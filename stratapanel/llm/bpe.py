"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is the encoding of its symbols exactly when each token encodes itself and each two
neighbours encode themselves. So every prefix of a word has one last token: the one that ends there
and goes with the last token of the prefix before it. An automaton over the vocabulary reports all
tokens that end at a position, in one pass; the last tokens are stored for all prefixes and followed
back from the end. The work is linear in the word, however long it is.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import SLICE_ROWS, add_by_text, unused
from stratapanel.llm.tokens import WordEncoder

#: Stands for the end of a word inside the automaton; the byte alphabet of the tokenizers lacks it.
END = "\n"
#: Pairs whose verdict is kept in a worker process; then they are forgotten.
PAIRS = 500_000


class Merges:
    """What a vocabulary's merges say: which tokens, and which two side by side, encode themselves."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], suffix: str) -> None:
        def symbols(token: str) -> str:
            return token.removesuffix(suffix) + END if suffix and token.endswith(suffix) else token

        self.names = {i: t for t, i in vocab.items()}
        #: merge order of a pair of ids, of a made token, and the two parts of a made token
        self.order: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            whole = vocab[a.removesuffix(suffix) + b if suffix else a + b]
            self.order[left, right] = n
            if whole in self.made:
                raise ValueError("a token with two merges has no unique last part")
            self.made[whole], self.parts[whole] = n, (left, right)
        self.never = len(merges)
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        #: tokens that their own symbols are encoded to, with their symbols
        self.usable: dict[int, str] = {}
        for token in sorted(vocab.values(), key=lambda i: self.made.get(i, -1)):
            parts = self.parts.get(token)
            if parts is None or all(p in self.usable for p in parts) and not self._crossed(*parts, self.made[token]):
                self.usable[token] = symbols(self.names[token])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces a token shows at one side while it is made, each with the merge that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            found, piece, until = [], token, self.never
            while True:
                found.append((piece, until))
                if piece not in self.parts:
                    break
                until, piece = self.made[piece], self.parts[piece][side]
            self.edges[side][token] = found
        return found

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge earlier than ``before`` joins what two tokens show each other.

        Of equal merges the left one goes first, so at the same step the left token's own wins and
        the right token's own loses.
        """
        for a, ends_a in self._edge(left, 1):
            for b, ends_b in self._edge(right, 0):
                n = self.order.get((a, b))
                if n is not None and n < before and n < ends_a and n <= ends_b:
                    return True
        return False

    def __call__(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode themselves."""
        found = self.verdicts.get((left, right))
        if found is None:
            if len(self.verdicts) >= PAIRS:
                self.verdicts.clear()
            found = self.verdicts[left, right] = not self._crossed(left, right, self.never)
        return found


class PrefixCoder(WordEncoder):
    """Encodes and decodes with a tokenizer file: words end in a suffix, no token crosses a blank.

    ``encode`` gives the ids of whole texts, those of the tokenizers library; ``decode`` the text of
    ids as a tokenizer without a decoder gives it: the tokens, special ones too, with a blank between.
    Every run is encoded by its prefixes; the library only normalises and splits what is not plain.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick

        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = END if model["end_of_word_suffix"] else ""
        self.fits = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.automaton = ahocorasick.Automaton()
        for token, symbols in self.fits.usable.items():
            self.automaton.add_word(symbols, (token, len(symbols)))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = self.fits.names | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def encode_run(self, run: str) -> bytes:
        """Ids of one run, in the byte alphabet, by its prefixes."""
        word = run + self.end
        fits, verdicts = self.fits, self.fits.verdicts
        last: list[int | None] = [None] * (len(word) + 1)
        back = last.copy()
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if last[end] is None:
                start = end - size
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fit = verdicts.get((before, token))
                    if not (fits(before, token) if fit is None else fit):
                        continue
                last[end], back[end] = token, start
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at = back[at]
        return struct.pack(f"<{len(ids)}H", *ids[::-1])

    def encode_odd(self, piece: str) -> bytes:
        """Ids of a piece with special tokens or signs that change when they are normalised."""
        found, at = [], 0
        for m in self.cut.finditer(piece):
            found += [self._encode_normal(piece[at : m.start()]), struct.pack("<H", self.special[m[0]])]
            at = m.end()
        return b"".join([*found, self._encode_normal(piece[at:])])

    def _encode_normal(self, text: str) -> bytes:
        runs = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return b"".join(self.encode_run(run) for run, _ in runs)

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def coder(path: str) -> PrefixCoder:
    """One coder for each worker process; what it remembers is bounded."""
    return PrefixCoder(path)


def with_ids(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text; null and empty texts, and texts of blanks alone, have none.

    Long texts are encoded whole, equal texts get equal ids, an empty table gives an empty one. A
    column that bears the new one's name is replaced, all others are kept.
    """
    def make() -> Any:
        encode = coder(path).encode
        return lambda texts: [[np.frombuffer(x, dtype="<u2").astype(np.int32) for x in encode(texts)]]

    return add_by_text(df, text, [(out, "array<int>", pa.list_(pa.int32()))], make)


def with_text(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that ids decode to; null ids and no ids give an empty text."""
    sent = unused("ids_for_python", df)

    def run(batches: Any) -> Any:
        decode = coder(path).decode
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [decode(x or ()) for x in part.column(part.num_columns - 1).to_pylist()]
                arrays = [*part.columns[:-1], pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], out])

    kept = [c for c in df.columns if c != out]
    chosen = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids}`").alias(sent))
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{out}` string"])
    return chosen.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Digests of every whole text's ids and of what they decode to, without storing either.

    ``ids_sha256`` is that of the decimal ids with a blank between, ``decoded_sha256`` that of the
    decoded text. No ids: both are that of the empty text. Odd inputs as in ``with_ids``; a null
    doc_id and repeated rows stay as they are.
    """
    def make() -> Any:
        c = coder(path)
        decimal = {i: str(i).encode() for i in c.names}

        def digests(texts: list[bytes]) -> Any:
            counts, firsts, seconds = [], [], []
            for x in c.encode(texts):
                ids = np.frombuffer(x, dtype="<u2").tolist()
                counts.append(len(ids))
                firsts.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                seconds.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return counts, firsts, seconds

        return digests

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()),
              ("decoded_sha256", "string", pa.string())]
    return add_by_text(df, text, fields, make, keep=keep)
