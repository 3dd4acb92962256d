"""Texts cut into pieces that a byte-level BPE tokenizer can take one by one, so that each distinct piece is encoded once.

The cut is right for patterns that match a space only as the first character of a word or in a run of white space (as those of the public 50k vocabularies do): a piece
begins at every space and line feed. A text in which white space stands in threes, or in twos at its end, is left whole (`apart` is false), since such runs are one token.

A piece is what follows a space, or a line feed with what follows it. The first piece of every text has a line feed that the text has not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
RUNS = rf"{_SPACE}{_SPACE}(?:{_SPACE}|\z)"
ODD = _SPACE  # in a piece, after the line feed that it may begin with


def slices(texts: pa.Array, size: int = 4 << 20, rows: int = 4000) -> Iterator[pa.Array]:
    """Successive parts of about `size` bytes and at most `rows` texts; a longer text is a part of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows, len(texts))
        yield texts.slice(at, upto - at)
        at = upto


def cut(texts: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(number of pieces by text, the pieces' numbers, the distinct pieces, apart). Texts that hold one of `names` aren't apart; those that aren't have the pieces of an empty text."""
    texts = pc.fill_null(texts, "")
    whole = pc.match_substring_regex(pc.binary_join_element_wise("\n", texts, ""), RUNS)
    for name in names:
        whole = pc.or_(whole, pc.match_substring(texts, name))
    marked = pc.binary_join_element_wise("\n", pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), "")
    parts = pc.split_pattern(marked, " ")
    coded = parts.flatten().dictionary_encode()
    return np.asarray(pc.list_value_length(parts), dtype=np.int64), np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist(), ~np.asarray(whole, dtype=bool)


class Known(dict):
    """Piece -> its number; new ones are numbered as they are met."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Pieces:
    """Encodes texts by their distinct pieces. of_pieces(list) gives the ids of each piece (those of a piece that begins with a line feed begin with that line feed's
    one id), flat, and their number; of_text(str) the ids of a whole text. Pieces are kept until there are over `keep`; no result depends on it."""

    def __init__(self, of_pieces, of_text, names: list[str], keep: int) -> None:
        self.of_pieces, self.of_text, self.names, self.keep = of_pieces, of_text, names, keep
        self.reset()

    def reset(self) -> None:
        self.known, self.ids, self.size = Known(), [np.empty(0, np.int32)], np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and the number of ids of each."""
        if len(self.known) > self.keep:
            self.reset()
        n, codes, distinct, apart = cut(texts, self.names)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if len(self.known) > len(self.size):
            ids, size = self.of_pieces(list(self.known)[len(self.size) :])
            self.ids, self.size = [np.concatenate([*self.ids, ids])], np.r_[self.size, size]
        start = np.r_[0, np.cumsum(self.size)]
        p = number[codes]
        size = self.size[p]
        upto = np.cumsum(size)
        ids = self.ids[0][np.arange(upto[-1] if len(p) else 0) + np.repeat(start[p] - upto + size, size)]
        ends = upto[np.cumsum(n) - 1] if len(n) else upto
        sizes = np.diff(np.r_[0, ends]) - 1
        ids = np.delete(ids, np.r_[0, ends[:-1]]) if len(n) else ids  # the line feed before each text
        if not apart.all():
            parts, ends = np.split(ids, np.cumsum(sizes)[:-1]), sizes
            for i in (~apart).nonzero()[0]:
                parts[i] = np.asarray(self.of_text(texts[int(i)].as_py()), np.int32)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes


#: What a byte is to a cut: 1 a space, 2 a line feed, 4 an ASCII letter, 8 an ASCII sign other than the apostrophe. Letters of two bytes from À to ÿ (all but × and ÷) begin with 0xC3.
_KIND = np.zeros(256, np.uint8)
_KIND[ord(" ")], _KIND[ord("\n")] = 1, 2
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 4, 8


class Finer(Pieces):
    """Pieces with fewer distinct ones, for patterns that match no letter together with an ASCII sign, but for the apostrophe: line feeds are pieces of their own, and a letter and a sign next to
    each other are parted. Pieces keep their space and lie in the texts' own bytes; of_pieces(list) gives the ids of each as it stands."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.keep:
            self.reset()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(pc.binary_join_element_wise("\n", texts, ""), RUNS)
        for name in self.names:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        apart = pc.if_else(whole, "", texts) if pc.any(whole).as_py() else texts
        n, codes, distinct = self.parted(apart)
        number = np.fromiter(map(self.known.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = (number < 0).nonzero()[0]
        if len(new):
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            these = distinct[new].tolist()
            self.known.update(zip(these, number[new].tolist(), strict=True))
            ids, size = self.of_pieces(these)
            self.ids, self.size = [np.concatenate([*self.ids, ids])], np.r_[self.size, size]
        start = np.cumsum(self.size) - self.size
        p = number.take(codes)
        size = self.size.take(p)
        upto = np.cumsum(size)
        at = np.repeat(start.take(p) - upto + size, size)
        at += np.arange(len(at))
        ids, sizes = self.ids[0].take(at), np.diff(np.r_[0, np.r_[0, upto].take(np.cumsum(n))])
        odd = np.asarray(whole, bool).nonzero()[0]
        if len(odd):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in odd:
                parts[i] = np.asarray(self.of_text(texts[int(i)].as_py()), np.int32)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes

    @staticmethod
    def parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of pieces by text, the pieces' numbers, the distinct pieces)."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        ends = ends - ends[0]
        kind = _KIND.take(raw)
        begins = (kind & 3) != 0
        last, this = kind[:-1], kind[1:]
        begins[1:] |= (last == 2) | ((last | this) == 12)
        letter = (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)
        begins[2:] |= letter & (kind[2:] == 8)
        begins[ends[:-1][ends[:-1] < len(raw)]] = True
        at = begins.nonzero()[0]
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.r_[at, len(raw)]), pa.py_buffer(raw)]).dictionary_encode()
        return np.diff(np.searchsorted(at, ends)), np.asarray(pieces.indices, dtype=np.int64), pieces.dictionary.to_numpy(zero_copy_only=False)
