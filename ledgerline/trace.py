"""Spans of work as JSON lines: what ran, how long, inside what, and whether it failed."""

from __future__ import annotations

import contextvars
import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

Sink = Callable[[dict[str, Any]], None]
_sink: Sink | None = None
_inside: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("inside", default=())


def to(sink: Sink | str | Path | None) -> None:
    """Where spans go: a function, a file that lines are added to, or nowhere."""
    global _sink
    if sink is None or callable(sink):
        _sink = sink
        return
    path = Path(sink)
    path.parent.mkdir(parents=True, exist_ok=True)

    def add(record: dict[str, Any]) -> None:
        with path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(record, default=str, sort_keys=True) + "\n")

    _sink = add


@contextmanager
def span(name: str, **facts: Any) -> Iterator[dict[str, Any]]:
    """A span; what is put into the dictionary that it gives is told, too. An error passes on."""
    if _sink is None:
        yield facts
        return
    token = _inside.set((*_inside.get(), name))
    began, error = time.time(), None
    try:
        yield facts
    except BaseException as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        _sink({"span": "/".join(_inside.get()), "began": round(began, 3), "seconds": round(time.time() - began, 6), "error": error, **facts})
        _inside.reset(token)
