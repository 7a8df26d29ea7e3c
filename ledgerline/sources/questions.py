"""Questions with what answers them, from YAML or JSON."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class Question:
    id: str
    text: str
    #: SQL or a pick that gives the right rows.
    gold: str | dict[str, Any] | None = None
    ordered: bool = False
    tags: tuple[str, ...] = ()


def load_questions(path: str | Path) -> list[Question]:
    """A list of questions; ids are unique, texts aren't blank, and unknown keys are errors."""
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))  # JSON is YAML, too
    if found is None:
        return []
    if not isinstance(found, list):
        raise ValueError(f"{path} is no list")
    out: dict[str, Question] = {}
    for n, q in enumerate(found):
        if not isinstance(q, dict) or not str(q.get("text") or "").strip():
            raise ValueError(f"{path}: question {n} has no text")
        if extra := sorted(set(q) - {"id", "text", "gold", "ordered", "tags"}):
            raise ValueError(f"{path}: question {n} has {', '.join(extra)}")
        one = Question(str(q.get("id", n)), q["text"], q.get("gold"), bool(q.get("ordered")), tuple(q.get("tags", ())))
        if one.id in out:
            raise ValueError(f"{path}: {one.id} twice")
        out[one.id] = one
    return list(out.values())
