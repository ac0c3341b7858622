"""Language models behind one interface, called from Arrow batches.

A model turns prompts into replies. ``complete`` sends each distinct prompt of a
batch once, keeps null prompts null and turns failures into nulls, as a failed
item must not stop the job. Replies should be stored (see ``storage.cut_lineage``)
before they are used twice, so retries don't ask again.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class Model(Protocol):
    def answer(self, prompt: str) -> str: ...

    def distribution(self, prompt: str) -> list[tuple[str, float]]: ...


@dataclass(frozen=True)
class StubModel:
    """Deterministic and offline: replies follow from the prompt's text alone."""

    def answer(self, prompt: str) -> str:
        if "Records so far" in prompt:
            return "<|COMPLETE|>"
        body = prompt.rpartition("Text:\n")[2]
        if prompt.startswith("Extract the entities"):
            names = list(dict.fromkeys(w for w in re.findall(r"\b[A-ZÀ-Ý][\w]{3,}", body)))[:4]
            out = [f'("entity"<|>{n}<|>concept<|>{n} is named in the text<|>{n})' for n in names]
            out += [f'("relationship"<|>{a}<|>{b}<|>related_to<|>{a} stands near {b}<|>{a}<|>0.8)' for a, b in zip(names, names[1:])]
            return "##".join(out) + "<|COMPLETE|>"
        first = body.strip().split("\n")[0][:200]
        return f"<question>What does the text say about {first[:60]}?</question><answer>{first}</answer>"

    def distribution(self, prompt: str) -> list[tuple[str, float]]:
        p = int(hashlib.md5(prompt.encode()).hexdigest()[:4], 16) / 0xFFFF
        return [("yes", round(p, 4)), ("no", round(1 - p, 4))]


@dataclass(frozen=True)
class ScriptedModel:
    """Replies from a table of prompt parts; for tests."""

    script: tuple[tuple[str, str], ...]
    default: str = ""

    def answer(self, prompt: str) -> str:
        return next((reply for part, reply in self.script if part in prompt), self.default)

    def distribution(self, prompt: str) -> list[tuple[str, float]]:
        return [("yes", 1.0)]


class RateLimit:
    """At most ``per_minute`` calls of this worker in any running minute; a cluster divides its quota by tasks."""

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.n, self.clock, self.sleep, self.calls = per_minute, clock, sleep, []

    def wait(self) -> None:
        now = self.clock()
        self.calls = [t for t in self.calls if now - t < 60]
        if len(self.calls) >= self.n:
            self.sleep(60 - (now - self.calls[0]))
        self.calls.append(self.clock())


@dataclass
class HttpModel:
    """A chat-completions endpoint: five tries with growing pauses, a minute's time-out."""

    url: str
    model: str
    key: str = ""
    kind: str = "chat"  # or "ollama"
    tries: int = 5
    timeout: float = 60
    top: int = 5
    per_minute: int = 600
    send: Callable[[urllib.request.Request, float], bytes] | None = None
    pause: Callable[[float], None] = time.sleep
    _limit: RateLimit | None = field(default=None, repr=False)

    def _post(self, payload: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        self._limit = self._limit or RateLimit(self.per_minute)
        for turn in range(self.tries):
            self._limit.wait()
            try:
                raw = self.send(request, self.timeout) if self.send else urllib.request.urlopen(request, timeout=self.timeout).read()
                return json.loads(raw)
            except (OSError, ValueError, urllib.error.URLError):
                if turn == self.tries - 1:
                    raise
                self.pause(min(10, 4 * 2**turn))
        raise AssertionError("unreachable")

    def answer(self, prompt: str) -> str:
        reply = self._post({"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False})
        return reply["message"]["content"] if self.kind == "ollama" else reply["choices"][0]["message"]["content"]

    def distribution(self, prompt: str) -> list[tuple[str, float]]:
        import math

        if self.kind == "ollama":
            raise NotImplementedError("this endpoint gives no token probabilities")
        reply = self._post({"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": 1, "logprobs": True, "top_logprobs": self.top})
        return [(t["token"], math.exp(t["logprob"])) for t in reply["choices"][0]["logprobs"]["content"][0]["top_logprobs"]]


class LocalModel:
    """Adapters for in-process inference libraries; each raises a clear error where its library is missing."""

    LIBRARIES = ("transformers", "vllm", "sglang")

    def __init__(self, library: str, name: str):
        import importlib

        if library not in self.LIBRARIES:
            raise ValueError(f"unknown library {library}; known: {', '.join(self.LIBRARIES)}")
        try:
            importlib.import_module(library)
        except ImportError as e:
            raise RuntimeError(f"a local model needs {library}, which is not installed") from e
        self.library, self.name = library, name


def from_environment(role: str, env: dict[str, str]) -> Model:
    """``ROLE_BACKEND``, ``ROLE_BASE_URL``, ``ROLE_MODEL``, ``ROLE_API_KEY``; the stub where no backend is named."""
    backend = env.get(f"{role}_BACKEND", "")
    if not backend:
        return StubModel()
    if backend in ("http_api", "openai_api", "azure_openai_api", "ollama_api"):
        return HttpModel(env[f"{role}_BASE_URL"], env[f"{role}_MODEL"], env.get(f"{role}_API_KEY", ""), "ollama" if backend.startswith("ollama") else "chat")
    return LocalModel({"huggingface": "transformers"}.get(backend, backend), env.get(f"{role}_MODEL", ""))  # type: ignore[return-value]


def complete(df: DataFrame, model: Model, prompt: str, out: str) -> DataFrame:
    """``df`` with the model's reply to column ``prompt``, reasoning blocks removed; null for null and failed prompts."""
    from weftgraph.functions.text import without_think

    @pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            known: dict[str, str | None] = {}
            for p in prompts.dropna().unique():
                try:
                    known[p] = model.answer(p)
                except Exception:
                    known[p] = None
            yield pd.Series([None if p is None else known.get(p) for p in prompts], dtype="str")

    return df.withColumn(out, without_think(ask(F.col(prompt))))


def yes_no(df: DataFrame, model: Model, prompt: str, out: str) -> DataFrame:
    """``df`` with the distribution of the reply's first token: array<struct<text,prob>>."""

    @pandas_udf("array<struct<text:string,prob:double>>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([None if p is None else [{"text": t, "prob": q} for t, q in model.distribution(p)] for p in prompts], dtype=object)

    return df.withColumn(out, ask(F.col(prompt)))
