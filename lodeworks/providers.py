"""Calls of outside models as plain callables: retries, a breaker for each, the first that works, and embeddings of texts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are embedded at most. Fixed value of the input contract of embedding models.
EMBEDDED_CHARS = 2000


def retrying(call: Callable[..., Any], attempts: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """``call`` tried up to ``attempts`` times; waits double from ``first_wait``, and the last error is raised."""

    def run(*args: Any, **more: Any) -> Any:
        for left in range(attempts - 1, -1, -1):
            try:
                return call(*args, **more)
            except Exception:
                if not left:
                    raise
                sleep(first_wait * 2 ** (attempts - 1 - left))

    return run


class Breaker:
    """Keeps a failing provider from being called: ``closed``, ``open`` after so many failures, ``half_open`` after a rest."""

    def __init__(self, failures: int = 3, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.rest, self.clock = failures, rest, clock
        self.failed, self.since = 0, None

    @property
    def state(self) -> str:
        if self.since is None:
            return "closed"
        return "half_open" if self.clock() - self.since >= self.rest else "open"

    def report(self, worked: bool) -> None:
        self.failed = 0 if worked else self.failed + 1
        self.since = self.clock() if self.failed >= self.limit else None


class FirstWorking:
    """Named callables in order of preference; a call gives the first result that is not empty, or ``default``."""

    def __init__(self, providers: dict[str, Callable[..., Any]], default: Any = "", failures: int = 3, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.providers, self.default = providers, default
        self.breakers = {name: Breaker(failures, rest, clock) for name in providers}

    def __call__(self, *args: Any, **more: Any) -> Any:
        for name, call in self.providers.items():
            breaker = self.breakers[name]
            if breaker.state == "open":
                continue
            try:
                result = call(*args, **more)
            except Exception:
                result = None
            breaker.report(bool(result))
            if result:
                return result
        return self.default

    def status(self) -> dict[str, dict[str, Any]]:
        return {name: {"state": b.state, "failures": b.failed} for name, b in self.breakers.items()}


def json_of(text: str) -> Any:
    """The JSON of a model's answer: as it stands, or within a fence or other words around one object or array."""
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    for part in (text, text[min(starts, default=0) : max(text.rfind("}"), text.rfind("]")) + 1]):
        try:
            return json.loads(part)
        except ValueError:
            continue
    raise ValueError("the answer holds no JSON")


def embedded(text_units: DataFrame, embed: Callable[[list[str]], list[list[float]]], chars: int = EMBEDDED_CHARS) -> DataFrame:
    """``text_units`` with ``embedding`` of the first ``chars`` characters of their content, in Arrow batches.

    Blank contents, failed calls and empty answers give null, so an ingest never fails for want of a model.
    """
    schema = text_units.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "")[:chars] for t in batch.column("content").to_pylist()]
            asked = [i for i, t in enumerate(texts) if t.strip()]
            try:
                got = embed([texts[i] for i in asked]) if asked else []
            except Exception:
                got = []
            found: list[Any] = [None] * len(texts)
            for i, v in zip(asked, got, strict=False):
                found[i] = [float(x) for x in v] if v else None
            place = batch.schema.get_field_index("embedding")
            yield batch.set_column(place, batch.schema.field(place), pa.array(found, batch.schema.field(place).type))

    return text_units.select(*[F.col(f.name) for f in schema.fields]).mapInArrow(run, schema)
