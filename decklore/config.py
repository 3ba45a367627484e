"""Run-time settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    max_contexts: int = 4
    gate_min_margin: float = 0.002
    max_answer_sentences: int = 3
    rate_seconds: float = 30.0
    queue_size: int = 20
    calibrated: bool = False

    @classmethod
    def load(cls, path: str) -> Settings:
        """From JSON; keys that start with _ are notes, and unknown ones are refused."""
        given = {k: v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items() if not k.startswith("_")}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(given) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: kinds[k](v) for k, v in given.items()})
