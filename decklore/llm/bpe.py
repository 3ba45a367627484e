"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over bytes cuts each text into chunks, so that passages that documents share become equal chunks, wherever
they lie. A worker encodes each distinct chunk once while it remembers it. A cut may fall inside a word; then what stands
on either side of it is wrong, and is repaired: from the start of the last word of the left chunk the text is split anew,
over more and more of the right chunk, until a word ends where a word of the right chunk ends too. From there on both
splits must agree, as the splitter looks at nothing behind it; the ids in between are encoded anew. Where the left chunk
ends within what may become 're, 've or 'll, the apostrophe before its last word belongs to the repair.

Chunks are shared within a worker, not across the cluster: to bring equal chunks together would shuffle all of the text,
and cost more than encoding them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklore.llm import arrow
from decklore.llm.tokens import LETTERS, MARKS, SPACED_WORDS, Encoder, encoder, gathered, letters_and_mark

HASH_BYTES, MASK_BITS, LEAST_CHUNK, MOST_CHUNK = 32, 10, 256, 8192
#: Characters of chunks that a worker remembers: those of the last half for sure, and older ones that came again.
MAX_CHUNK_CHARS = 16_000_000
HEAD_PIECES = 8
HALF_CONTRACTIONS = ("'r", "'v", "'l")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def rolling_hash(data: np.ndarray, size: int = HASH_BYTES) -> np.ndarray:
    """For each byte a hash of it and the size - 1 bytes before (fewer at the start); size is a power of two."""
    byte = np.arange(256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        table = (byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        table = ((table ^ (table >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    h, n = table[data], 1
    while n < size:
        further = h.copy()
        further[n:] += h[:-n] << np.uint32(n) if n < 32 else np.uint32(0)
        h, n = further, n * 2
    return h


def cut_points(
    data: np.ndarray, starts: np.ndarray, bits: int = MASK_BITS, least: int = LEAST_CHUNK, most: int = MOST_CHUNK
) -> list[list[int]]:
    """data: UTF-8 of texts that lie one after the other, from ``starts`` (with the end). Per text: the ends of chunks."""
    after = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - bits) == 0) + 1
    after = after[after < len(data)]
    after = after[(data[after] & 0xC0) != 0x80]  # at characters
    low = np.searchsorted(after, starts[:-1], side="right").tolist()
    high = np.searchsorted(after, starts[1:], side="left").tolist()
    after, out = after.tolist(), []
    for i, (at, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        ends = []
        for point in [*after[low[i] : high[i]], end]:
            while point - at > most:
                at += most
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                ends.append(at)
            if point - at >= least or point == end:
                ends.append(point)
                at = point
        out.append(ends if ends else [end])
    return out


def one_kind(text: str) -> bool:
    """Letters alone, digits alone, white space alone or none of these: such text has no word's end inside."""
    return text.isalpha() or text.isnumeric() or text.isspace() or not any(c.isalnum() or c.isspace() for c in text)


def glued(chunks: list[str]) -> list[str]:
    """Chunks without a word's end inside have no place for a seam; they become one with what is on either side."""
    out, open_ = [], False
    for text in chunks:
        inside = one_kind(text)
        if out and (inside or open_):
            out[-1].append(text)
        else:
            out.append([text])
        open_ = inside
    return ["".join(parts) for parts in out]


@dataclass(slots=True)
class Chunk:
    """Encoded text, right if a word starts where it starts and ends where it ends."""

    text: str
    ids: bytes
    #: Ends of the first pieces: characters and bytes of ids.
    head: list[tuple[int, int]]
    #: Up to where the split holds, whatever follows: characters and bytes of ids.
    tail: tuple[int, int]


class ChunkEncoder:
    def __init__(self, base: Encoder, bits: int = MASK_BITS, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> None:
        self.base, self.limits = base, (bits, least, most)
        tokenizer = base.tokenizer
        added = tokenizer.get_added_tokens_decoder()
        if tokenizer.normalizer is not None or any(
            t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()
        ):
            raise ValueError("chunks can't be joined for a tokenizer that rewrites text or binds added tokens to words")
        self.split_words = tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = {t.content: np.array([i], base.width).tobytes() for i, t in added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.chunks: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}
        self.n_chars = 0
        #: Characters that were asked for, and those that were encoded: how much reuse there was.
        self.asked_chars = self.encoded_chars = 0
        alphabet = byte_alphabet()
        self.bytes_of = [b""] * base.size
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            if all(c in alphabet for c in token):
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
            else:
                self.bytes_of[i] = token.encode()
        self.decimals = [str(i) for i in range(base.size)]

    def word_ends(self, text: str) -> list[int]:
        return [end for _, (_, end) in self.split_words(text)]

    def open_words(self, text: str, ends: list[int]) -> int:
        """How many of the last words may be split in another way when text follows: one, or two where the apostrophe and
        the first letter of a contraction of three characters end the text."""
        return 1 + (len(ends) > 1 and text[-2:] in HALF_CONTRACTIONS and ends[-2] - (ends[-3] if len(ends) > 2 else 0) == 1)

    def is_plain(self, text: str) -> bool:
        """Is each run of white space one space or newline? Then every space starts a word, and a newline is one."""
        inner = text[text[:1] == " " : len(text) - (text[-1:] == " " and len(text) > 1)]
        return "\0" not in text and bool(inner) and " ".join(inner.split()) == inner.replace("\n", " ")

    def encode_words(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct pieces of plain text: letters behind at most one space are encoded in rows, marks behind those by
        themselves, anything else as it is."""
        marked = pc.match_substring_regex(words, rf"^ ?\p{{L}}+{MARKS}$")
        marked = pc.and_(marked, pc.match_substring_regex(words, rf"^ ?{LETTERS}+{MARKS}$"))
        marks = pc.if_else(marked, pc.replace_substring_regex(words, r"^ ?\p{L}+", ""), "").dictionary_encode()
        base = pc.if_else(marked, pc.replace_substring_regex(words, rf"{MARKS}$", ""), words).dictionary_encode()
        alike = pc.match_substring_regex(base.dictionary, r"^ \p{L}+$")
        if not self.base.row:
            alike = pc.and_(alike, False)
        own = np.empty(len(base.dictionary), object)
        rows = alike.to_numpy(zero_copy_only=False)
        own[rows] = self.base.encode_rows(base.dictionary.filter(alike).to_pylist())
        own[~rows] = self.base.encode_all(base.dictionary.filter(pc.invert(alike)).to_pylist())
        behind = np.empty(len(marks.dictionary), object)
        behind[:] = self.base.encode_all(marks.dictionary.to_pylist())
        return (own[base.indices.to_numpy()] + behind[marks.indices.to_numpy()]).tolist()

    def encode_chunks(self, texts: list[str]) -> dict[str, Chunk]:
        """The chunks of these texts, those that aren't remembered encoded now."""
        if self.n_chars > MAX_CHUNK_CHARS // 2:
            self.chunks, self.older, self.n_chars = {}, self.chunks, 0
        self.asked_chars += sum(map(len, texts))
        new = []
        for text in dict.fromkeys(texts):
            if text not in self.chunks:
                self.n_chars += len(text)
                if (known := self.older.pop(text, None)) is not None:
                    self.chunks[text] = known
                else:
                    new.append(text)
        plain = [t for t in new if self.is_plain(t)]
        self.encoded_chars += sum(map(len, new))
        if plain:
            self._encode_plain(plain)
        for text in new:
            if text not in self.chunks:
                ends = self.word_ends(text)
                words = [text[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                known = self.base.know(set(words))
                head, n = [], 0
                for end, word in list(zip(ends, words, strict=True))[:HEAD_PIECES]:
                    n += len(known[word])
                    head.append((end, n))
                ids = b"".join(known[w] for w in words)
                last = words[-self.open_words(text, ends) :]
                tail = (len(text) - sum(map(len, last)), len(ids) - sum(len(known[w]) for w in last))
                self.chunks[text] = Chunk(text, ids, head, tail)
        return self.chunks

    def _encode_plain(self, texts: list[str]) -> None:
        column = pa.array(texts, pa.string())
        for old, cut in ((" ", "\0 "), ("\n", "\0\n\0")):
            column = pc.replace_substring(column, old, cut)
        lists = pc.split_pattern(column, "\0")
        flat, of = lists.flatten(), pc.list_parent_indices(lists)
        there = pc.not_equal(flat, "")
        coded = flat.filter(there).dictionary_encode()
        upto = np.cumsum(np.bincount(of.filter(there).to_numpy(), minlength=len(texts)))
        index, width = coded.indices.to_numpy(), self.base.width
        ids, ends = gathered(self.encode_words(coded.dictionary), index, width)
        ends = np.concatenate([[0], ends]) * width.itemsize
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(coded.dictionary).to_numpy()[index])])
        # The open words of each last piece, and how many ids they have.
        last = index[upto - 1]
        distinct = np.unique(last)
        tails = {}
        for i, piece in zip(distinct.tolist(), coded.dictionary.take(pa.array(distinct)).to_pylist(), strict=True):
            cuts = self.word_ends(piece)
            tails[i] = piece[[0, *cuts][-1 - self.open_words(piece, cuts)] :]
        sizes = dict(zip(tails.values(), map(len, self.base.encode_all(list(tails.values()))), strict=True))
        start = 0
        for text, stop, piece in zip(texts, upto.tolist(), last.tolist(), strict=True):
            c, n = int(chars[start]), int(ends[start])
            z = min(start + HEAD_PIECES, stop) + 1
            head = list(zip((chars[start + 1 : z] - c).tolist(), (ends[start + 1 : z] - n).tolist(), strict=True))
            own, tail = ids[n : int(ends[stop])], tails[piece]
            self.chunks[text] = Chunk(text, own, head, (len(text) - len(tail), len(own) - sizes[tail]))
            start = stop

    def seam(self, left: Chunk, right: Chunk) -> tuple[bytes, int, int] | None:
        """What stands between the open words of ``left`` and a word's end of ``right`` that holds in both splits: the ids,
        and the characters and bytes of ids of ``right`` that they replace. None if there is no such end."""
        tail = left.text[left.tail[0] :]
        for i in range(len(right.head) - 1):
            until = right.head[i + 1][0]
            ends = self.word_ends(tail + right.text[:until])
            sure = ends[: -self.open_words(tail + right.text[:until], ends)]
            for chars, n in right.head[: i + 1]:
                if chars <= right.tail[0] and (at := len(tail) + chars) in sure:
                    words = [0, *ends[: ends.index(at) + 1]]
                    text = tail + right.text[:chars]
                    cut = [text[a:b] for a, b in zip(words[:-1], words[1:], strict=True)]
                    known = self.base.know(set(cut))
                    return b"".join(known[w] for w in cut), chars, n
        return None

    def join(self, chunks: list[Chunk]) -> bytes:
        """Ids of the text that the chunks make up."""
        left, chars, n, out, i = chunks[0], 0, 0, [], 1
        while i < len(chunks):
            right = chunks[i]
            i += 1
            seam = self.seam(left, right) if left.tail[0] >= chars and left.ids else None
            if seam is None:  # too short to agree: one chunk of both, and of as many more as double it
                both, more = [left.text[chars:], right.text], len(right.text)
                while i < len(chunks) and more < len(both[0]):
                    both.append(chunks[i].text)
                    more += len(chunks[i].text)
                    i += 1
                left, chars, n = self.one("".join(both)), 0, 0
                continue
            out += [left.ids[n : left.tail[1]], seam[0]]
            left, chars, n = right, seam[1], seam[2]
        return b"".join([*out, left.ids[n:]])

    def one(self, text: str) -> Chunk:
        return self.encode_chunks([text])[text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        plain: list[str] = []
        plan: list[list[int | bytes]] = []
        for text in texts:
            parts = self.added_pattern.split(text) if any(a in text for a in self.added) else [text]
            row: list[int | bytes] = []
            for part in parts:
                if part in self.added:
                    row.append(self.added[part])
                elif part:
                    row.append(len(plain))
                    plain.append(part)
            plan.append(row)
        coded = [p.encode() for p in plain]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        data = b"".join(coded)
        cuts = cut_points(np.frombuffer(data, np.uint8), starts, *self.limits) if data else []
        texts_of = []
        for start, ends in zip(starts[:-1].tolist(), cuts, strict=True):
            texts_of.append(glued([data[a:b].decode() for a, b in zip([start, *ends[:-1]], ends, strict=True)]))
        known = self.encode_chunks([t for row in texts_of for t in row])
        # What most seams will be made of, encoded together.
        pairs = ((known[a], known[b]) for row in texts_of for a, b in zip(row[:-1], row[1:], strict=True))
        self.base.know({a.text[a.tail[0] :] + b.text[: b.head[0][0]] for a, b in pairs if b.head})
        found = [self.join([known[t] for t in row]) for row in texts_of]
        return [b"".join(x if isinstance(x, bytes) else found[x] for x in row) for row in plan]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others, in
    order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(encoder(path, SPACED_WORDS, letters_and_mark))
    return _encoders[path]


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: SCHEMA, digests of the decimal ids joined by commas and of the decoded text.

    A null text is empty: no ids, and the digests of the empty string. Texts of any length are encoded whole. Null and
    repeated ids are rows like any other; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(tokenizer)
        for step in arrow.steps(batches):
            n, ids_digest, text_digest = [], [], []
            for raw in coder.encode(arrow.texts(step).to_pylist()):
                ids = np.frombuffer(raw, coder.base.width).tolist()
                n.append(len(ids))
                said = ",".join(map(coder.decimals.__getitem__, ids))
                ids_digest.append(hashlib.sha256(said.encode()).hexdigest())
                text_digest.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def bpe_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(tokenizer)
        for step in arrow.steps(batches):
            rows = [np.frombuffer(r, coder.base.width).astype(np.int32) for r in coder.encode(arrow.texts(step).to_pylist())]
            ids = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), ids], names=["doc_id", "ids"])

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>")
