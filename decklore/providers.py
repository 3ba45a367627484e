"""Interfaces to models, with deterministic stand-ins for work without a network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH, WAITS = 64, (1, 2, 4, 8)


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def chat(self, prompt: str, json: bool = True) -> str: ...


class HashEmbedder:
    """Unit vectors that depend on a text's words alone."""

    def __init__(self, dim: int = 64) -> None:
        self.model_id, self.dim = f"hash-{dim}", dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[h[0] % self.dim] += 1 if h[1] & 1 else -1
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return out


def with_retry(call: Callable, waits: tuple[float, ...] = WAITS):
    """The call's result; after an error again, after each of the waits; the last error goes on."""
    for wait in waits:
        try:
            return call()
        except OSError:
            time.sleep(wait)
    return call()


def embed_texts(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """texts(text_key, text) to text_key, embedding, in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                found = with_retry(lambda p=part: embedder.embed(p["text"].tolist()))
                yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "embedding": found})

    return texts.select("text_key", "text").mapInPandas(run, "text_key string, embedding array<float>")


class ChatClient:
    """A chat model behind a call(prompt, json_mode): tried again after errors, asked for JSON until it once refuses that, and
    every question and answer logged."""

    def __init__(self, call: Callable[[str, bool], str], log: Callable[[dict], None] = lambda row: None, waits: tuple[float, ...] = WAITS) -> None:
        self.call, self.log, self.waits, self.json_mode = call, log, waits, True

    def chat(self, prompt: str, tag: str = "") -> str:
        try:
            answer = with_retry(lambda: self.call(prompt, self.json_mode), self.waits)
        except ValueError:
            if not self.json_mode:
                raise
            self.json_mode = False
            answer = with_retry(lambda: self.call(prompt, False), self.waits)
        self.log({"tag": tag, "prompt": prompt, "answer": answer})
        return answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
