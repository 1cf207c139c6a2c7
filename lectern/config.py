"""Configuration as a frozen value; `replace` makes a changed and checked one. Keys and secrets have no place in it."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    strategy: str = "sliding-window"
    size: int = 1500
    overlap: int = 200
    mode: str = "bm25"
    alpha: float = 0.5
    rerank: bool = False
    hyde: bool = False
    ocr: bool = False
    filter_stage: str = "post"

    def __post_init__(self):
        if self.strategy not in ("sliding-window", "by-heading"):
            raise ValueError(f"no such chunk strategy: {self.strategy}")
        if self.size > 0 and not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")
        if self.mode not in ("bm25", "vector", "hybrid"):
            raise ValueError(f"no such search mode: {self.mode}")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")
        if self.filter_stage not in ("post", "pre"):
            raise ValueError("filter_stage is post or pre")

    def replace(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)


def provider(wanted, known: dict):
    """A provider as it is given, or made by its name in `known`, alone or with options: "hashing" or ("service", {"url": …}). None stays None."""
    name, options = (wanted, {}) if isinstance(wanted, str) else wanted if isinstance(wanted, tuple) else (None, None)
    if name is None:
        return wanted
    if name not in known:
        raise ValueError(f"no such provider: {name}; there are {', '.join(sorted(known))}")
    return known[name](**options)
