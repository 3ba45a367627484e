"""The tokenizers library on the executors: one tokenizer and one bounded cache of encoded pieces a worker."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Pieces that a worker keeps; it starts anew beyond.
MAX_PIECES, ROW_WORDS = 400_000, 256


Apart = Callable[[str], tuple[str, ...] | None]


@dataclass(frozen=True)
class Row:
    """How words are encoded many at a time: which ones, what joins them, and which tokens end (or start) a word."""

    fits: Callable[[str], bool]
    joint: str
    edge: Callable[[str], bool]
    at_end: bool
    #: A tokenizer for such words, where the file's own does work that doesn't change them.
    plain: Callable | None = None


def _words_only(path: str):
    """The tokenizer of a file for words in lower case and normal form, with white space between them."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.normalizer = normalizers.Sequence([])
    split, to_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    found.pre_tokenizer = pre_tokenizers.Sequence([split, to_bytes])
    return found


class Encoder:
    """Encodes pieces (text that the tokenizer splits off in any case) as the library does, each once while cached.

    Ids are kept as little-endian bytes, two or four for each id, by the size of the vocabulary.
    """

    def __init__(self, path: str, row: Row | None = None, apart: Apart | None = None) -> None:
        self.row, self.apart = row, apart
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        self.edge = np.zeros(self.size, bool)
        self.plain = row.plain(path) if row and row.plain else self.tokenizer
        if row:
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.edge[i] = row.edge(token)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, each by itself."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.width).tobytes() for x in found]

    def encode_rows(self, words: list[str]) -> list[bytes]:
        """The ids of words that fit in a row, each by itself, but many in a text; the ids tell where words end. A word that
        the library parts after all adds an end, so the number of ends tells, and such rows are encoded word by word."""
        out: list[bytes] = []
        rows = [words[at : at + ROW_WORDS] for at in range(0, len(words), ROW_WORDS)]
        found = self.plain.encode_batch_fast([self.row.joint.join(r) for r in rows], add_special_tokens=False)
        step = self.width.itemsize
        for some, encoded in zip(rows, found, strict=True):
            ids = np.array(encoded.ids, self.width)
            ends = np.flatnonzero(self.edge[ids])
            ends = ends + 1 if self.row.at_end else np.append(ends[1:], len(ids))
            if len(ends) != len(some) or ends[-1] != len(ids) or not (self.row.at_end or self.edge[ids[0]]):
                out += self.encode_all(some)
                continue
            raw, edges = ids.tobytes(), [0, *(ends * step).tolist()]
            out += [raw[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def know(self, pieces: set[str]) -> dict[str, bytes]:
        """The cache, with all of ``pieces`` in it. Where ``apart`` takes a piece apart, its parts are encoded."""
        missing = pieces.difference(self.pieces)
        if len(self.pieces) + len(missing) > MAX_PIECES:
            self.pieces, missing = {}, pieces
        known, apart, made, new = self.pieces, self.apart, [], set()
        if apart:
            for piece in missing:
                if parts := apart(piece):
                    made.append((piece, parts))
                    new.update(parts)
                else:
                    new.add(piece)
            new = new.difference(known)
        else:
            new = missing
        fits = self.row.fits if self.row else lambda x: False
        alike, rest = [], []
        for piece in new:
            (alike if fits(piece) else rest).append(piece)
        known.update(zip(alike, self.encode_rows(alike), strict=True))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            known.update(zip(some, self.encode_all(some), strict=True))
        for piece, parts in made:
            known[piece] = b"".join([known[x] for x in parts])
        return known


#: ASCII marks but the apostrophe, as a pattern; any run of them behind letters is a word of its own.
#: Letters of scripts that no version of Unicode has changed of late, so all libraries agree on what they are.
LETTERS = "[A-Za-zÀ-ɏͰ-ϿЀ-ӿḀ-ỿ]"
#: Letters that are their own normal form, and whose lower case is one letter, the same in all libraries.
LATIN = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
MARKS = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""


def letters_and_mark(piece: str) -> tuple[str, str] | None:
    """For tokenizers that part a run of letters, after at most one space, from a mark that ends the text."""
    word, mark = piece[:-1], piece[-1:]
    return (word, mark) if mark in tuple(",.;:!?") and (word[1:] if word[:1] == " " else word).isalpha() else None


#: Words with an end-of-word mark, for tokenizers that drop white space; words behind a space, for byte-level ones.
ENDED_WORDS = Row(lambda w: False, " ", lambda t: t.endswith("</w>"), True, _words_only)
SPACED_WORDS = Row(lambda w: w[:1] == " " and w[1:].isalpha(), "", lambda t: t.startswith("Ġ"), False)

_encoders: dict[str, Encoder] = {}


def encoder(path: str, row: Row | None = None, apart: Apart | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; the first call says how its pieces may be joined and taken apart."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, row, apart)
    return _encoders[path]


def gathered(ids: list[bytes], index: np.ndarray, width: np.dtype) -> tuple[bytes, np.ndarray]:
    """The ids of items, given those of the distinct ones and each item's place among these: all of them one after the other,
    and the number of ids up to each item's end."""
    size = np.array([len(i) for i in ids], np.int64) // width.itemsize
    pool, start = np.frombuffer(b"".join(ids), width), np.cumsum(size) - size
    n = size[index]
    ends = np.cumsum(n)
    if not len(index) or not ends[-1]:
        return b"", ends
    return pool[np.repeat(start[index] - (ends - n), n) + np.arange(ends[-1])].tobytes(), ends
