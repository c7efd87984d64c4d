"""Memoised encoding of whole texts.

Byte-level BPE works inside the matches of a splitting pattern, and every such pattern used here ends a
match before a space or line feed that follows a character which is not white space, after a line feed that
stands alone, and between runs of letters, of digits and of marks (an apostrophe may take letters behind
it). Batches are cut there into units by the classes of their bytes; a unit's ids never depend on its
neighbours. Equal units of a batch are looked up once. Ids of frequent units are kept in a table of bounded
size; all other units are encoded once for each batch that holds them.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import buffers
from .common import texts as texts_of

#: Entries of the table of units of one Python worker (about 150 bytes each), and the longest unit kept, in bytes.
UNITS_KEPT, UNIT_BYTES = 900_000, 64
#: Classes of bytes. _UNSURE: control characters, white space other than space and line feed; no cut stands beside them.
_UNSURE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER, _SPACE, _LINE = range(8)
#: One match of the pattern each: letters that every version of Unicode classes alike, digits, or marks.
_ONE = re.compile(r"\n| ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and for each pair of classes (first * 8 + second) whether a cut stands between them."""
    of = np.full(256, _UNSURE, np.uint8)
    for c in map(chr, range(33, 127)):
        of[ord(c)] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _MARK
    of[ord(" ")], of[ord("\n")], of[128:] = _SPACE, _LINE, _OTHER
    cut = np.zeros((8, 8), bool)
    cut[_LETTER : _MARK + 1, _LETTER : _MARK + 1] = ~np.eye(3, dtype=bool)
    cut[_LETTER : _DIGIT + 1, _QUOTE] = True
    cut[_LETTER : _OTHER + 1, _SPACE:] = True
    return of, cut.ravel()


_CLASS, _CUT = _classes()


def cut_points(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units start in UTF-8 bytes; `at` holds the starts of texts and the end."""
    text = np.concatenate([held, np.zeros(3, np.uint8)])
    kind = _CLASS[text]
    lead = np.flatnonzero(held >= 0xC2)
    if len(lead):
        first, second, third = text[lead], text[lead + 1], text[lead + 2]
        latin = (first >= 0xC3) & (first <= 0xC8) | (first == 0xC9) & (second <= 0x8F)
        latin &= (first != 0xC3) | (second != 0x97) & (second != 0xB7)  # U+00C0 to U+024F without the signs of multiplication and division
        kind[lead[latin]] = kind[lead[latin] + 1] = _LETTER
        # U+0080 to U+00A0, U+1680, U+180E, U+2000 to U+200F, U+2028 to U+202F, U+2050 to U+206F, U+3000 to U+3003
        white = (first == 0xC2) & (second <= 0xA0) | (first == 0xE3) & (second == 0x80) & (third <= 0x83)
        white |= (first == 0xE1) & ((second == 0x9A) & (third == 0x80) | (second == 0xA0) & (third == 0x8E))
        white |= (first == 0xE2) & ((second == 0x80) & ((third <= 0x8F) | (third >= 0xA8) & (third <= 0xAF)) | (second == 0x81) & (third >= 0x90) & (third <= 0xAF))
        lead, three = lead[white], first[white] != 0xC2
        kind[lead] = kind[lead + 1] = _UNSURE
        kind[lead[three] + 2] = _UNSURE
    cut = np.zeros(len(text), bool)
    cut[1:] = _CUT[kind[:-1] * 8 + kind[1:]]
    line = np.flatnonzero(kind[1 : len(held)] == _LINE) + 1
    sure = np.array([_LETTER <= k <= _OTHER for k in range(8)])
    cut[line[sure[kind[line - 1]] & sure[kind[line + 1]]] + 1] = True
    cut[at] = True
    return np.flatnonzero(cut[: len(held)])


class UnitEncoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit integers, encoded(column) those of a column."""

    def __init__(self, backend: Callable[[list[str]], list[bytes]], cuts: bool = True, kept: int = UNITS_KEPT, single: Callable[[list[str]], list[bytes]] | None = None):
        """single: encodes units that are one match of the pattern each."""
        self.backend, self.cuts, self.kept, self.single = backend, cuts, kept, single or backend
        self.known: dict[bytes, bytes] = {}

    def _ids(self, units: list[bytes]) -> list[bytes]:
        out = [*map(self.known.get, units)]
        new = [i for i, x in enumerate(out) if x is None]
        text = [units[i].decode() for i in new]
        one = [_ONE(k) is not None for k in text]
        for encode, alone in ((self.single, True), (self.backend, False)):
            some = [k for k, x in zip(text, one, strict=True) if x is alone]
            for i, x in zip([i for i, x in zip(new, one, strict=True) if x is alone], encode(some) if some else (), strict=True):
                out[i] = x
        room = max(0, self.kept - len(self.known))
        self.known.update([(units[i], out[i]) for i in new if len(units[i]) <= UNIT_BYTES][:room])
        return out

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and where each text's ids start (n + 1 places)."""
        if not self.cuts:
            out = self.backend(texts_of(column))
            return np.frombuffer(b"".join(out), "<u4"), np.cumsum([0, *(len(x) // 4 for x in out)])
        held, at = buffers(column)
        starts = cut_points(held, at)
        offsets = np.append(starts, len(held)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        of = self._ids(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        size, code = np.fromiter(map(len, of), np.int64, len(of)) // 4, units.indices.to_numpy()
        n = size[code]
        end = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(size) - size)[code] - end[:-1], n)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(of), "<u4")[place], end[np.searchsorted(starts, at)]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encoded(pa.array(texts, pa.large_string()))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)]


_OPEN: dict[tuple, UnitEncoder | WordEncoder] = {}


def _single(spec: dict) -> Callable[[list[str]], list[bytes]] | None:
    """The same vocabulary without the splitting pattern, for units that the pattern wouldn't split.

    Many units are encoded in one call, their bytes written as byte-level vocabularies write them; each ends with a
    control character whose entry no merge holds, so its id marks the unit's end. None if there is no such character.
    """
    from tokenizers import Tokenizer

    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    written = "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))
    merged = set("".join("".join(x) for x in spec["model"]["merges"]))
    sign = next((chr(c) for c in range(32) if written[c] not in merged and written[c] in spec["model"]["vocab"]), None)
    if sign is None:
        return None
    held = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    end, mark = written[ord(sign)], spec["model"]["vocab"][written[ord(sign)]]

    def single(units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(units), 512):
            some = codecs.charmap_decode(sign.join(units[at : at + 512]).encode(), "strict", written)[0].split(end)
            ids = np.array(held.encode_batch_fast([[k + end for k in some]], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            for stop in (np.flatnonzero(ids == mark) * 4).tolist():
                out.append(data[start:stop])
                start = stop + 4
        return out

    return single


def library_encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file of the tokenizers library.

    Strings of special tokens in a text are ordinary text, as the vocabularies' description reads them.
    """
    if (path,) not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        cuts = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)

        def backend(units: list[str]) -> list[bytes]:
            return [array("I", x.ids).tobytes() for x in held.encode_batch_fast(units, add_special_tokens=False)]

        _OPEN[(path,)] = UnitEncoder(backend, cuts, single=_single(spec) if cuts else None)
    return _OPEN[(path,)]


class WordEncoder:
    """encode(texts) gives the ids of each text (UTF-8) as little-endian unsigned 32-bit integers.

    letters: no token of the vocabulary reaches over white space, so words between ASCII white space are encoded apart,
    and ids of frequent ones are kept in a table of bounded size; marks behind letters are a match of their own, and `letters` encodes
    lower-cased letters. backend encodes texts, or words, one by one.
    """

    def __init__(self, backend: Callable[[list[str]], list[bytes]], letters: Callable[[list[str]], list[bytes]] | None, kept: int = UNITS_KEPT):
        self.backend, self.letters, self.kept = backend, letters, kept
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _learn(self, new: list[bytes]) -> None:
        split, odd, parts, known = [], [], self.parts, self.words
        for k in new:
            if m := _LETTERS_MARKS(k.decode()):
                split.append((k, m[1].lower(), m[2]))
            else:
                odd.append(k)
        if len(parts) > self.kept:
            parts.clear()
            parts[""] = b""
        for encode, at in ((self.letters, 1), (self.backend, 2)):
            some = [*{x[at] for x in split}.difference(parts)]
            parts.update(zip(some, encode(some), strict=True))
        known.update((k, parts[a] + parts[b]) for k, a, b in split)
        known.update(zip(odd, self.backend([k.decode() for k in odd]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.letters:
            return self.backend([x.decode() for x in texts])
        known, words = self.words, [x.split() for x in texts]
        room = self.kept - len(known)
        new = [*set().union(*words).difference(known)]
        self._learn(new)
        of = known.__getitem__
        out = [b"".join(map(of, x)) for x in words]
        for k in new[max(0, room) :]:
            del known[k]
        return out


#: Letters of one case mapping and no decomposition in every version of Unicode, then marks that no contraction holds.
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Steps of a normaliser that change no character by what stands beyond white space, and a pattern whose matches hold none.
_APART_STEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_APART_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file of the tokenizers library; by words where its normaliser and pattern leave them apart.

    Strings of special tokens in a text are ordinary text, as the vocabularies' description reads them.
    """
    if ("words", path) not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, splits = ((spec.get(k) or {}).get(name) or [] for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        suffix = spec["model"].get("end_of_word_suffix")
        apart = suffix and splits[:1] == [_APART_SPLIT] and splits[1:] and all(x in _APART_STEPS for x in steps)
        single = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": splits[1]})) if apart else None
        last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        last[[i for k, i in spec["model"]["vocab"].items() if suffix and k.endswith(suffix)]] = True

        def letters(words: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(words), 4096):
                ids = np.array(single.encode_batch_fast([words[at : at + 4096]], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
                data, ends = ids.tobytes(), (np.flatnonzero(last[ids]) * 4 + 4).tolist()  # a word's last token has the suffix, and no other
                out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            return out

        def backend(texts: list[str]) -> list[bytes]:
            return [array("I", x.ids).tobytes() for x in held.encode_batch_fast(texts, add_special_tokens=False)]

        _OPEN["words", path] = WordEncoder(backend, letters if apart else None)
    return _OPEN["words", path]
