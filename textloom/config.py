"""Settings of the stages; every field has the production default."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    top_terms: int = 10
    posts_per_term: int = 100
    news_per_term: int = 3
    geo: str = "GLOBAL"
    sort_modes: tuple[str, ...] = ("relevance", "top", "new")
    subreddits: tuple[str, ...] = ()
    positive_threshold: float = 0.05
    negative_threshold: float = -0.05
    neutral_margin: float = 0.05
    top_k: int = 200
    max_features: int = 1200
    sample_size: int = 200
    seed: int = 42
    test_size: float = 0.2
    grid: str = "small"
    strict: bool = False
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "TEXTLOOM_", env=None) -> "Config":
        """Fields from variables such as TEXTLOOM_TOP_K; lists are comma-separated."""
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or f.name == "extra":
                continue
            kind = type(f.default)
            out[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
        return cls(**out)

    def missing(self, needed: list[str], env=None) -> list[str]:
        """Names of required variables that are not set."""
        env = os.environ if env is None else env
        return [n for n in needed if not env.get(n)]
