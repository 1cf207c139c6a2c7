"""Pages, embeddings and language models over HTTP, for whoever has a network. Objects are small values that go to the workers.

Models speak the widespread JSON form of /embeddings and /chat/completions, which most services and local servers offer.
A key is read where it is used, from the environment variable that is named; it is never stored or written. Answers other than 2xx are errors.
"""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass


def asked(url: str, body: dict, key_variable: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"}
    if key_variable:
        headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class Get:
    """Fetches a page: its text, read as UTF-8, and its content type."""

    timeout: float = 15

    def __call__(self, url: str) -> tuple[str, str]:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "lectern"}), timeout=self.timeout) as answer:
            return answer.read().decode("utf-8", "replace"), answer.headers.get("Content-Type") or "text/html"


@dataclass(frozen=True)
class ServiceEmbedder:
    """Embeddings from <url>/embeddings, all texts of a batch in one request."""

    url: str
    model: str
    dimensions: int = 1536
    key_variable: str | None = None
    timeout: float = 30

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        rows = asked(self.url.rstrip("/") + "/embeddings", {"model": self.model, "input": texts}, self.key_variable, self.timeout)["data"]
        out = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
        if len(out) != len(texts) or any(len(v) != self.dimensions for v in out):
            raise ValueError(f"the service didn't give {len(texts)} vectors of {self.dimensions}")
        return out


@dataclass(frozen=True)
class ServiceModel:
    """Answers from <url>/chat/completions."""

    url: str
    model: str
    temperature: float = 0.1
    key_variable: str | None = None
    timeout: float = 120

    @property
    def name(self) -> str:
        return self.model

    def generate(self, prompt: str, system: str | None = None) -> str:
        messages = [{"role": "system", "content": system}] if system else []
        body = {"model": self.model, "temperature": self.temperature, "messages": [*messages, {"role": "user", "content": prompt}]}
        return asked(self.url.rstrip("/") + "/chat/completions", body, self.key_variable, self.timeout)["choices"][0]["message"]["content"] or ""
