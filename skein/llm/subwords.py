"""Byte-level BPE ids of whole texts through the tokenizers library, fast on Zipfian text.

The library spends most of its time on the split into pieces and on the bookkeeping of offsets.
A text may be cut before any space that a non-space follows: no piece of a byte-level BPE reaches
over such a cut. So a text is a list of units, most of them one word with its leading space, and
the ids of a unit are computed once and kept. So are those of its pieces, which go straight to the
library's BPE model; units with characters that libraries may classify differently go through the
library's whole encode().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from skein.llm.common import quiet_threads

#: Units that a generation of a worker's cache holds, about 25 MB; there are two.
KEPT_UNITS = 120_000
#: Bytes of text that are split at once.
CHUNK_BYTES = 8 << 20
#: Pieces that are written in the byte-level alphabet at once.
PIECES_AT_ONCE = 8192
#: Letters on which all libraries agree, then marks that end a word, for Arrow's regular expressions.
PLAIN = r"^[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
MARKS = ".,;:!?$%&#*"
#: A space that Unicode white space or the end follows, for Arrow's regular expressions.
ODD_SPACE = r" (?:[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
#: Fixed value: how a byte-level BPE of this family splits text into pieces.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Beyond these, libraries may differ on what is a letter, a number or a space.
_RARE = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")


def default_tokenizer() -> str:
    """Path of the public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Kept:
    """A cache of two generations: at its limit the young one becomes the old one, whose entries
    come back when they are asked for. So what is frequent stays, and the size is bounded."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def all(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of the keys; those that are unknown are made at once."""
        out = list(map(self.young.get, keys))
        if None in out:
            lost = [k for k, got in enumerate(out) if got is None]
            found = [self.old.get(keys[k]) for k in lost]
            new = [k for k, got in zip(lost, found, strict=True) if got is None]
            for k, got in zip(lost, found, strict=True):
                out[k] = got
            for k, got in zip(new, make([keys[k] for k in new]), strict=True):
                out[k] = got
            if len(self.young) + len(lost) > self.most:
                self.young, self.old = {}, self.young
            self.young.update((keys[k], out[k]) for k in lost[: self.most])
        return out


def taken(flat: np.ndarray, size: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the items hold, one after the other, and where each ends; flat has them in order of number."""
    sizes = size[items]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = (np.cumsum(size) - size)[items]
    shift -= ends
    shift += sizes
    at = np.repeat(shift.astype(kind), sizes)
    del shift, sizes
    at += np.arange(total, dtype=kind)
    return flat[at], ends


def _flat(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(table), "<u4"), np.fromiter(map(len, table), np.int64, len(table)) // 4


class Subwords:
    """Encoder for one tokenizer file; encode() gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.spelled = [pack("<I", k) for k in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        self.size = len(self.spelled)
        self.stems, self.units, self.pieces = Kept(kept), Kept(kept // 4), Kept(kept // 4)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        if any(" " in s or s.isalpha() for s in special):
            raise ValueError("an added token that holds a space, or letters alone, can't be cut at spaces")

    def pieces_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of the library's own split, by the library's BPE model."""
        tokenize, spelled, alphabet, out = self.model.tokenize, self.spelled, self.alphabet, []
        for a in range(0, len(pieces), PIECES_AT_ONCE):
            # Translated pieces hold neither spaces nor line breaks, and plain ones no breaks, so all spaces are replaced at once.
            written = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(alphabet) for p in pieces[a : a + PIECES_AT_ONCE]]
            found = map(tokenize, "\n".join(written).replace(" ", "\u0120").split("\n"))
            out += [spelled[t[0].id] if len(t) == 1 else b"".join([spelled[x.id] for x in t]) for t in found]
        return out

    def stems_of(self, letters: list[str]) -> list[bytes]:
        """Ids of pieces of a space and letters."""
        return self.pieces_of([" " + x for x in letters])

    def unit(self, unit: str) -> bytes:
        """Ids of a stretch of text that no piece reaches out of."""
        if self.special.search(unit) or _RARE.search(unit):
            return b"".join([self.spelled[k] for k in self.tokenizer.encode(unit, add_special_tokens=False).ids])
        return b"".join(self.pieces.all(PIECES.findall(unit), self.pieces_of))

    def units_of(self, words: list[str]) -> list[bytes]:
        return [self.unit(" " + w) for w in words]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        words = text.split(" ")
        units = words[:1]
        for w in words[1:]:
            if not w or w[0].isspace():
                units[-1] += " " + w
            else:
                units.append(" " + w)
        return b"".join(map(self.unit, units))

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ids of a column of texts, chunk by chunk: number of the first text, ids, offsets by text.

        Arrow splits a chunk into words and finds the distinct ones, so Python sees each of those
        once. Null is empty. With end_id, it follows each text's ids.
        """
        if not len(texts):
            return
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        chunk = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        for a, z in zip(starts, [*starts[1:], len(chunk)], strict=True):
            ids, offsets = self._chunk(pc.fill_null(texts.slice(a, z - a), ""), end_id)
            yield int(a), ids, offsets

    def encode_distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each as if a space stood before it, one after the other, and their numbers of ids.

        Most words are letters, then marks or none: two pieces, which are looked up by themselves;
        the others are looked up whole.
        """
        if not len(distinct):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        letters = pc.utf8_rtrim(distinct, MARKS)
        marks = (pc.binary_length(distinct).to_numpy() - pc.binary_length(letters).to_numpy()).astype(np.int64)
        plain = pc.match_substring_regex(letters, PLAIN).to_numpy(zero_copy_only=False) & (marks < 8)
        stems = letters.filter(pa.array(plain)).dictionary_encode()
        table = self.stems.all(stems.dictionary.to_pylist(), self.stems_of)
        first, second = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        first[plain] = stems.indices.to_numpy()
        first[~plain] = len(table) + np.arange(len(distinct) - len(stems))
        table += self.units.all(distinct.filter(pa.array(~plain)).to_pylist(), self.units_of)
        second[~plain | (marks == 0)] = len(table)
        table.append(b"")
        for k in np.unique(marks[plain & (marks > 0)]).tolist():
            own = np.flatnonzero(plain & (marks == k))
            tails = pc.utf8_slice_codeunits(distinct.take(pa.array(own)), -k).dictionary_encode()
            second[own] = len(table) + tails.indices.to_numpy()
            table += self.pieces.all(tails.dictionary.to_pylist(), self.pieces_of)
        ids, ends = taken(*_flat(table), np.stack([first, second], axis=1).ravel())
        return ids, np.diff(ends[1::2], prepend=0)

    def _chunk(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        distinct = words.flatten().dictionary_encode()
        unit_of = distinct.indices.to_numpy().copy()
        bounds -= bounds[0]
        ids, size = self.encode_distinct(distinct.dictionary)
        # A text's first word has no space before it; a text with runs of spaces is taken whole.
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False))
        for d in odd:
            unit_of[bounds[d] : bounds[d + 1]] = len(size)
        table = [b"" if end_id is None else pack("<I", end_id), *map(self.unit, pc.list_element(words, 0).to_pylist())]
        for d in odd:
            table[d + 1] = self.encode(texts[d].as_py())
        del words, distinct
        unit_of[bounds[:-1]] = len(size) + 2 + np.arange(n)
        unit_of = np.insert(unit_of, bounds[1:], len(size) + 1)  # the end, empty without end_id
        bounds += np.arange(n + 1)
        more, sizes = _flat(table)
        ids, ends = taken(np.concatenate([ids, more]), np.concatenate([size, [0], sizes]), unit_of)
        return ids, np.concatenate([[0], ends])[bounds]


_ENCODERS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """This worker's encoder, which later tasks find filled."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Subwords(path)
    return _ENCODERS[path]
