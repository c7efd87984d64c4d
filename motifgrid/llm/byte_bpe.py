"""Operator 10: byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1 so that one pyahocorasick automaton finds, for every position of a
pattern match, the longest vocabulary entry that starts there. Tokens are placed from left to right,
longest first. A token may follow another only if encoding their joined bytes would give just these
two, which is looked up in a memo of adjacent pairs; when no token fits, the last one is shortened. A
position from which no completion exists is never tried twice, so the work is linear in the bytes.

Defined results: null and empty texts give no ids; every byte is a vocabulary entry, so any text can
be encoded and decoding gives back its exact UTF-8 bytes. Rows are independent: repeated rows, ties
and extra columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, pieces, texts
from .tokens import UnitEncoder

#: Kept ids of pattern matches, and kept verdicts on adjacent pairs, of one Python worker.
MATCHES_KEPT, PAIRS_KEPT = 300_000, 1_000_000


#: Letters and numbers of the installed regex package that tiktoken's tables don't hold yet (first, last).
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def without_newer(pattern: str) -> str:
    """The pattern with the letters and numbers of `NEWER` taken out of its classes."""
    newer = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
    return "(?V1)" + pattern.replace("\\p{L}", f"[\\p{{L}}--[{newer}]]").replace("\\p{N}", f"[\\p{{N}}--[{newer}]]")


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.plain, self.wide, self.first = regex.compile(pattern), regex.compile(without_newer(pattern)), chr(NEWER[0][0])
        self.id_of = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text_of = {v: k for k, v in self.id_of.items()}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.find = ahocorasick.Automaton()
        for k, v in self.id_of.items():
            self.find.add_word(k, (v, len(k)))
        self.find.make_automaton()
        self.shorter = {v: self._shorter(k) for k, v in self.id_of.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.verdicts: dict[tuple[int, int], bool] = {}
        for v in sorted(self.text_of):
            self._halve(v)
        self.verdicts.clear()  # verdicts given before all merges were known
        self.memo: dict[str, tuple[int, ...]] = {}

    def _shorter(self, token: str) -> int:
        """The longest entry that is a proper prefix of the token, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (v := self.id_of.get(token[:n])) is not None:
                return v
        return -1

    def _halve(self, v: int) -> None:
        """Finds the two entries whose merge makes entry v, from merges of lower rank."""
        token, left = self.text_of[v], self.shorter[v]
        while left != -1:
            right = self.id_of.get(token[len(self.text_of[left]) :], v)
            if left < v and right < v and self._stay_apart(left, right):
                self.merged[left, right], self.halves[v] = v, (left, right)
                return
            left = self.shorter[left]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a then b, in order of rank, ends with just the tokens a and b.

        Both merge trees are undone along the border, latest merge first. If the two pieces that touch
        there could merge earlier than the merge that was undone, that merge would have come first.
        """
        before = None
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and (before is None or joined < before):
                return False
            split_a, split_b = self.halves.get(a), self.halves.get(b)
            if split_a and (a > b or not split_b):
                before, a = a, split_a[1]
            elif split_b:
                before, b = b + 1, split_b[0]  # of equal ranks the left one merges first
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.verdicts.get(key)) is None:
            known = self._stay_apart(a, b)
            if len(self.verdicts) < PAIRS_KEPT:
                self.verdicts[key] = known
        return known

    def encode_match(self, match: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        s = match.decode("latin-1")
        if (whole := self.id_of.get(s)) is not None:
            return (whole,)
        longest = [-1] * len(s)
        for end, (v, n) in self.find.iter(s):
            longest[end - n + 1] = v  # ends grow, so the last one is the longest
        placed: list[int] = []
        at, dead, token, size = 0, bytearray(len(s) + 1), longest[0], self.text_of
        while at < len(s):
            while token != -1:
                end = at + len(size[token])
                if not dead[end] and (not placed or self.fits(placed[-1], token)):
                    break
                token = self.shorter[token]
            if token != -1:
                placed.append(token)
                at = end
                token = longest[at] if at < len(s) else -1
            else:
                if not placed:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[at] = 1
                token = placed.pop()
                at -= len(size[token])
                token = self.shorter[token]
        return tuple(placed)

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        pattern = self.wide if text and max(text) >= self.first else self.plain
        for m in pattern.findall(text):
            if (ids := memo.get(m)) is None:
                ids = self.encode_match(m.encode())
                if len(memo) < MATCHES_KEPT:
                    memo[m] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_OPEN: dict[tuple[str, str], tuple[ByteBpe, UnitEncoder]] = {}


def codec(path: str, pattern: str, cuts: bool = False) -> tuple[ByteBpe, UnitEncoder]:
    """The worker's codec for a file of base64 entries and ranks; cuts: the pattern allows units."""
    if (path, pattern) not in _OPEN:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = ByteBpe(ranks, pattern)
        _OPEN[path, pattern] = bpe, UnitEncoder(lambda units: [array("I", bpe.encode(x)).tobytes() for x in units], cuts)
    return _OPEN[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", cuts: bool = False) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        bpe, encoder = codec(path, pattern, cuts)
        for batch in pieces(batches, "text", 1 << 20):
            ids = encoder.encode(texts(batch.column("text")))
            yield batch_of(schema, doc_id=batch.column("doc_id"), ids=ids, decoded=[bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, cuts: bool = False) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the decoded bytes, per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe, encoder = codec(path, pattern, cuts)
        decimal = {v: str(v) for v in bpe.bytes_of}
        for batch in pieces(batches, "text", 1 << 20):
            n, a, b = [], [], []
            for x in encoder.encode(texts(batch.column("text"))):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield batch_of(schema, doc_id=batch.column("doc_id"), n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
