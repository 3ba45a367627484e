"""Odd rows that every operator must take, and plain-Python answers."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, keep_id long, pid int, n long, copies long, body string"


def row(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", 7, 8, 9, 10, 11, "y")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(2, 9))) for _ in range(3000)]
    return " ".join(vocabulary[i] + ("." if i % 11 == 0 else "") for i in rng.integers(0, 3000, n))


def odd_rows():
    base = prose(1, 300)
    near = base.split()
    near[40] = "changed"
    shared = prose(5, 80)
    return [
        row(1, base),
        row(2, None, None),
        row(3, ""),
        row(4, "  \n\t "),
        row(5, "word"),
        row(6, prose(2, 40_000), "b"),
        row(7, base, "b"),
        row(8, " ".join(near), None),
        row(9, "one two three four"),
        row(10, "one two three four", lang=None),
        row(11, prose(3, 60) + " " + shared),
        row(12, shared + "\n" + prose(4, 70), "c"),
        row(13, "the same words again " * 60),
        row(14, "Ünïcode wörds – “quotes” 日本語 😀 İstanbul Σίσυφος x é"),
        row(15, "<|endoftext|> not a mark <|endoftext|>"),
        row(16, "line\nline\nother\n\nline"),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts(rows):
    return sorted((r[0], r[1] or "") for r in rows if r[0] is not None)


def words(text):
    return WORD.findall(text)


def repeated_windows(rows, size):
    """doc_id to (n_words, n_removed, digest of what is kept)."""
    first = {}
    for i, t in texts(rows):
        w = words(t)
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = {}
    for i, t in texts(rows):
        w, gone = words(t), set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near_classes(rows, threshold=0.8):
    """doc_id to (class_id, n_links)."""
    sets, holders = {}, defaultdict(list)
    for i, t in texts(rows):
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for g in sets[i]:
            holders[g].append(i)
    links, top = Counter(), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g] if j > i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (find(i), links[i]) for i in sets}
