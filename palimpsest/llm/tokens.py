"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of encoded pieces.

Both tokenizers used here never let a token span white space (beyond one leading space of
a byte-level word), so the texts of a slice are cut at white space, each distinct piece is
encoded once by the library (words of plain letters by its model), and the ids of a text
are the ids of its pieces joined, all by array operations.  A text with white space other than single spaces and line ends between
words, or with a special token's string, is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: What the fast path does not cut: any white space but single " " or "\n" between words, and the mark of a tail.
_ODD = (
    r"\A[ \n]|[ \n]\z|  |\n\n| \n|\n |"
    r"[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Closing punctuation after a Latin letter is a piece of its own, marked by \x01.
_TAIL = r"""([A-Za-z\x{DF}-\x{F6}\x{F8}-\x{24F}])([,.;:!?%&$*#|)"]+)( |\z)"""
#: Pieces remembered by one Python worker; beyond it the memory is emptied and refilled.
MAX_PIECES = 1_000_000
#: Bytes of text that are cut into pieces together.
SLICE_BYTES = 4 << 20


class PieceEncoder:
    """ids of texts as the tokenizer gives them without added special tokens."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *special])
        # byte-level: a line end is a token and one space joins the word that follows it
        self.line_end = self._ids("\n")
        self.leading_space = bool(len(self.line_end))
        self.max_pieces = max_pieces
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that are not known: plain words by the tokenizer's model alone, others by the whole tokenizer."""
        tokenize, space = self.tokenizer.model.tokenize, "\u0120" if self.leading_space else ""
        lists: list[list[int]] = []
        hard: list[tuple[int, str]] = []
        for piece in new:
            if piece.isascii() and piece.isalpha():
                lists.append([t.id for t in tokenize(space + piece if self.leading_space else piece.lower())])
            else:
                own = piece[1:] if piece[:1] in ("\n", "\x01") else " " + piece if self.leading_space else piece
                hard.append((len(lists), own))
                lists.append([])
        line_end = self.line_end.tolist()
        for (k, _), found in zip(hard, self.tokenizer.encode_batch_fast([x for _, x in hard], add_special_tokens=False), strict=True):
            lists[k] = line_end + found.ids if new[k][:1] == "\n" else found.ids
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())))

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # as if each text came after a line end: a piece that starts with "\n" has no leading space
        marked = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        marked = pc.replace_substring_regex(marked, _TAIL, "\\1 \x01\\2\\3")
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        pieces = words.dictionary
        codes = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(codes < 0)
        if len(self.known) + len(missing) > self.max_pieces and len(self.known):
            self._forget()
            codes[:], missing = -1, np.arange(len(pieces))
        if len(missing):
            new = pieces.take(pa.array(missing))
            codes[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self._learn(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
        code = codes[words.indices.to_numpy()]
        first, sizes = self.first[code], self.first[code + 1] - self.first[code]
        heads = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        first[heads] += len(self.line_end)
        sizes[heads] -= len(self.line_end)
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) - np.repeat(ends - sizes - first, sizes)
        return self.ids[at], np.add.reduceat(sizes, heads)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all texts in order, number of ids of each) of a large_string array without nulls."""
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = ~whole & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        sizes = np.zeros(len(texts), np.int64)
        if plain.all() and len(texts):
            return self._by_pieces(texts)
        ids, own = np.empty(0, np.uint32), []
        if plain.any():
            ids, sizes[plain] = self._by_pieces(texts.filter(pa.array(plain)))
        if whole.any():
            own = [x.ids for x in self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
            sizes[whole] = [len(x) for x in own]
        out = np.empty(int(sizes.sum()), np.uint32)
        out[np.repeat(plain, sizes)] = ids
        out[np.repeat(whole, sizes)] = [i for x in own for i in x]
        return out, sizes

    def encode_with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with ``end_id`` after each text's ids."""
        ids, sizes = self.encode(texts)
        ends = np.cumsum(sizes)
        return np.insert(ids, ends, np.uint32(end_id)), sizes + 1


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
