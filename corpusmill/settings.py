"""Settings: defaults, a JSON file over them, the environment over both."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "CORPUSMILL_"


@dataclass(frozen=True)
class Settings:
    warehouse: str = "warehouse"
    models: str = ""
    embedding_dimension: int = 64
    target_tokens: int = 512
    max_tokens: int = 1200
    min_tokens: int = 40
    overlap_tokens: int = 64
    pool: int = 50
    rrf_k: int = 60
    rerank_top: int = 30
    limit: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.min_tokens <= self.target_tokens <= self.max_tokens:
            raise ValueError("tokens must satisfy 0 < min <= target <= max")
        if not 0 <= self.overlap_tokens < self.target_tokens:
            raise ValueError("overlap_tokens must be below target_tokens")
        for name in ("embedding_dimension", "pool", "rrf_k", "rerank_top", "limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def load_settings(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Unknown names in the file are ignored; values take the defaults' types."""
    env = dict(os.environ) if env is None else env
    given: dict[str, object] = {}
    if path and Path(path).exists():
        given |= {k.lower(): v for k, v in json.loads(Path(path).read_text()).items()}
    known = {f.name: type(f.default) for f in fields(Settings)}
    given |= {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}
    return replace(Settings(), **{k: known[k](v) for k, v in given.items() if k in known})
