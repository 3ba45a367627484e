"""Toxicity by compression distance.

Either class has a zstandard dictionary, trained by the library on text of that class, in front of a body trained on
ordinary text. The body lies at the same place in both, so a window of text compresses to different lengths only where it
meets what one class says and the other doesn't. A document's differences go through a logistic calibration to a score.

What a class's dictionary is trained on is itself found by compression distance: both classes' texts are dealt into pieces
of equal size, each piece is a raw dictionary, and a span (a word, or a few letters of a script without spaces) belongs to
the class whose pieces compress it to shorter lengths than the other's pieces do, by a margin in bytes, in standard errors
and in the share of pieces that know it at all. The rest is language that both classes have; trained on it too, the two
dictionaries would differ by chance alone.

Dictionaries and calibration are fitted on a bounded sample of labelled rows: the TRAIN_TOXIC and TRAIN_ORDINARY documents
with the lowest digests of their ids, of those with at most TRAIN_BYTES bytes. Scoring is a map over whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklore.llm import arrow
from decklore.llm.common import hex_bits

#: The bounds of the labelled sample: documents of either class, bytes of one document.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 1500, 4500, 32 << 10
WINDOW, THRESHOLD, FOLDS = 192, 0.7, 4
#: Sizes of a class's dictionary and of the common body; the shortest match; pieces of a class and documents in one.
CLASS_BYTES, BODY_BYTES, MATCH, MOST_PIECES, PIECE_DOCS = 4096, 16384, 6, 32, 16
#: What makes a span a class's own: bytes, standard errors, ratio of the shares of pieces; the least share of documents.
LEAST_GAIN, LEAST_Z, LEAST_LIFT, LEAST_SHARE = 0.5, 4.0, 2.0, 0.01
#: Windows of ordinary text whose difference a strong window exceeds.
STRONG = 0.99
LONG_SPAN, BODY_WINDOWS = 24, 4000
#: No text has this run; a span is compressed between its halves, as zstandard leaves shorter input as it is.
CARRIER = b"QXJZKVWQZXVKJWXQZKVJQWZXKJVZQXWKJZVQKXWJVZQKXJWZQVKXJZWQ" + b"KZXQWVJZKQXVWJKZQXJVKWZQ"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def compressor(content: bytes, thorough: bool = False) -> zstandard.ZstdCompressor:
    """With ``content`` as raw dictionary. A thorough one takes the best of many matches, so chance ones hardly tell."""
    made = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2 if thorough else zstandard.STRATEGY_FAST,
        min_match=MATCH,
        hash_log=17,
        chain_log=17,
        search_log=6,
        window_log=17,
        target_length=16 if thorough else 1,
        write_content_size=False,
        write_dict_id=False,
    )
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=made, dict_data=raw)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    #: The difference of a window, in bytes, from which on it is strong, for either pair of compressors.
    strong: list[float]
    weights: list[float]

    def score(self, text: str, pairs: Pairs) -> float:
        x = features(differences(text, pairs), self.strong) @ np.array(self.weights)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


#: (toxic, ordinary) compressors, fast and thorough.
Pairs = list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]


def loaded(toxic: bytes, ordinary: bytes) -> Pairs:
    return [(compressor(toxic, t), compressor(ordinary, t)) for t in (False, True)]


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text in pieces of at most ``size`` bytes, cut at spaces where there are any."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = n if n - at <= size else text.rfind(b" ", at + 1, at + size)
        end = end if end > 0 else min(at + size, n)
        out.append(text[at:end])
        at = end
    return out


def _clean(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" "


def differences(text: str, pairs: Pairs) -> list[np.ndarray]:
    """For each pair and window, by how many bytes the toxic dictionary makes the window shorter than the ordinary one."""
    cut = windows(_clean(text))
    return [np.array([len(o.compress(w)) - len(t.compress(w)) for w in cut], float) for t, o in pairs]


def features(found: list[np.ndarray], strong: list[float]) -> np.ndarray:
    out = [1.0, math.log(len(found[0]))]
    for d, least in zip(found, strong, strict=True):
        top, n, m = np.sort(d)[::-1], int((d >= least).sum()), int((d <= -least).sum())
        out += [top[0] / 8, top[:3].mean() / 8, d.mean() / 4, d.clip(0).sum() / math.sqrt(len(d)) / 8]
        out += [n / len(d), math.sqrt(n), math.sqrt(m)]
    return np.array(out)


def novel(texts: list[bytes]) -> list[bytes]:
    """The texts without words in runs of five that an earlier text has: a passage that documents of one class share isn't
    that class's language."""
    seen, out = set(), []
    for text in texts:
        words, gone = text.split(), set()
        for j in range(len(words) - 4):
            run = zlib.crc32(b" ".join(words[j : j + 5]))
            if run in seen:
                gone.update(range(j, j + 5))
            seen.add(run)
        own = [w for j, w in enumerate(words) if j not in gone]
        if own:
            out.append(b" " + b" ".join(own) + b" ")
    return out


def spans(text: bytes) -> set[bytes]:
    """The text's words with a space on either side; of longer ones all runs of four letters, eight in ASCII."""
    out = set()
    for word in text.split():
        spaced = b" " + word + b" "
        if len(spaced) <= LONG_SPAN:
            out.add(spaced)
            continue
        letters = word.decode("utf-8", "replace")
        size = 8 if letters.isascii() else 4
        out.update(letters[i : i + size].encode() for i in range(len(letters) - size + 1))
    return {s for s in out if len(s) >= MATCH}


def _lengths(found: list[bytes], pieces: list[bytes]) -> np.ndarray:
    """pieces x spans: the bytes that a span in the carrier takes with a piece as dictionary."""
    half, out = len(CARRIER) // 2, np.empty((len(pieces), len(found)))
    for i, piece in enumerate(pieces):
        zip_ = compressor(piece + CARRIER)
        out[i] = [len(zip_.compress(CARRIER[:half] + s + CARRIER[half:])) for s in found]
    return out


def own_spans(texts: list[bytes], mine: list[bytes], other: list[bytes]) -> set[bytes]:
    """The spans of texts of a class that its pieces compress better than the other's."""
    count = Counter(s for text in texts for s in spans(text))
    found = sorted(s for s, n in count.items() if n >= max(2, LEAST_SHARE * len(texts)))
    if not found:
        return set()
    a, b, plain = _lengths(found, mine), _lengths(found, other), _lengths(found, [b""])
    gain = b.mean(axis=0) - a.mean(axis=0)
    z = gain / np.sqrt((a.var(axis=0) + b.var(axis=0) + 0.05) / len(mine))
    known, known_there = (a < plain).mean(axis=0), (b < plain).mean(axis=0)
    good = (gain >= LEAST_GAIN) & (z >= LEAST_Z) & (known >= LEAST_LIFT * (known_there + 1 / len(mine)))
    return {s for s, ok in zip(found, good.tolist(), strict=True) if ok}


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary of the library's trainer; too little text to train on is its own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train(rows: list[tuple[str, int]]) -> tuple[bytes, bytes] | None:
    """The toxic and the ordinary dictionary; None where a class is missing."""
    toxic, ordinary = (novel([_clean(text) for text, label in rows if label == y]) for y in (1, 0))
    if not toxic or not ordinary:
        return None
    n = min(MOST_PIECES, max(2, min(len(toxic), len(ordinary)) // PIECE_DOCS))
    size = min(64 << 10, min(sum(map(len, toxic)), sum(map(len, ordinary))) // n)
    dealt = [[b"".join(texts[i::n])[:size] for i in range(n)] for texts in (toxic, ordinary)]
    parts = []
    for texts, mine, other in ((toxic, *dealt), (ordinary, *dealt[::-1])):
        own = own_spans(texts, mine, other)
        samples = [b"".join(sorted(found)) for text in texts if (found := spans(text) & own)]
        parts.append(trained(samples, CLASS_BYTES, 16, MATCH) if samples else b"")
    some = [w for text in ordinary for w in windows(text)]
    body = trained(some[:: max(1, len(some) // BODY_WINDOWS)], BODY_BYTES, 64, 8)
    room = max(map(len, parts))
    return tuple(b" " * (room - len(p)) + p + body for p in parts)


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """rows: (text, 1 for toxic or 0); None where a class is missing.

    The calibration sees each row through dictionaries that weren't trained on it.
    """
    pair = train(rows)
    if pair is None:
        return None
    seen, y = [], []
    for fold in range(FOLDS):
        pairs = loaded(*(train([r for i, r in enumerate(rows) if i % FOLDS != fold]) or pair))
        seen += [differences(text, pairs) for text, _ in rows[fold::FOLDS]]
        y += [label for _, label in rows[fold::FOLDS]]
    y = np.array(y, float)
    calm = [d for d, label in zip(seen, y, strict=True) if not label]
    strong = [float(np.quantile(np.concatenate([d[k] for d in calm]), STRONG)) + 1 for k in range(2)]
    strong = [max(1.0, s) for s in strong]
    x = np.array([features(d, strong) for d in seen])
    w = np.zeros(len(x[0]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return Model(*pair, strong, [float(v) for v in w])


def training_rows(docs: DataFrame, labels: DataFrame, n_toxic: int, n_ordinary: int) -> list[tuple[str, int]]:
    """At most n_toxic + n_ordinary labelled texts, those whose ids have the lowest digests, of at most TRAIN_BYTES each;
    doc_id, text; doc_id, toxic."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = hex_bits(F.col("doc_id"))
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(n_toxic)
    chosen = chosen.unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(n_ordinary))
    # At most n_toxic + n_ordinary rows are broadcast and come back, one for each id, each of bounded size.
    short = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_BYTES)
    found = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in found.collect())
    return [(text, int(toxic)) for _, text, toxic in rows]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, n_toxic: int = TRAIN_TOXIC, n_ordinary: int = TRAIN_ORDINARY
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): SCHEMA.

    Learns from ``labels`` (doc_id, toxic) of ids whose CRC-32 (of the id as text) mod 3 is not 1; the other rows are
    held out. Only texts enter a score. A null or empty text has the score of a text without any difference. Without
    labelled rows of both classes every score is 0. A null id is not held out. Several labels of one id count as toxic if
    one does; of several texts of a labelled id the least is learnt from. Repeated rows score alike; an empty table gives
    an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    model = fit(training_rows(slim, labels.select("doc_id", "toxic").filter(~held), n_toxic, n_ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(model.toxic, model.ordinary) if model else None
        for step in arrow.steps(batches):
            score = np.array([model.score(t, pairs) if model else 0.0 for t in arrow.texts(step).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [
                    step.column("doc_id"),
                    step.column("held_out"),
                    pa.array(score, pa.float64()),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return slim.withColumn("held_out", held).mapInArrow(run, SCHEMA)
