"""What surrounds model and tool calls of a workflow: parsing answers, planning with a fallback, approvals, budgets."""

from __future__ import annotations

import json
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from docweave.operators.research import parse_json_object
from docweave.operators.workflow import Graph, GraphError, validate


def category_of(answer: str, categories: list[dict]) -> str | None:
    """A classifier's category: by id, else by label; None if it names none. The answer is a JSON object."""
    found = parse_json_object(answer)
    value = str((found or {}).get("category", "")).strip()
    by_id = next((c["id"] for c in categories if c["id"] == value), None)
    return by_id or next((c["id"] for c in categories if c.get("label", "").casefold() == value.casefold() and value), None)


def fields_of(answer: str, fields: list[dict]) -> dict:
    """An extraction's fields: numbers as int or float or None, other scalars as text, structures as JSON."""
    found = parse_json_object(answer)
    if found is None:
        raise GraphError("the answer is no JSON object")
    out = {}
    for f in fields:
        v = found.get(f["id"])
        if f.get("type") == "number":
            try:
                x = float(str(v).replace(",", ""))
                out[f["id"]] = int(x) if x == int(x) and "." not in str(v) else x
            except (ValueError, OverflowError):
                out[f["id"]] = None
        elif v is None or isinstance(v, (str, bool)):
            out[f["id"]] = v
        else:
            out[f["id"]] = str(v) if isinstance(v, (int, float)) else json.dumps(v, ensure_ascii=False)
    return out


def plan(complete: Callable[[str], str], question: str, tools: set[str], max_nodes: int = 20) -> Graph | None:
    """A graph from a completion, or None (direct retrieval) on any failure."""
    try:
        raw = parse_json_object(complete(question))
        return validate(raw, tools, max_nodes) if raw else None
    except Exception:  # whatever goes wrong, direct retrieval remains
        return None


def nested_cycle(name: str, uses: dict[str, set[str]]) -> bool:
    """Whether a workflow reaches itself through the workflows that it uses."""
    seen, todo = set(), list(uses.get(name, ()))
    while todo:
        n = todo.pop()
        if n == name:
            return True
        if n not in seen:
            seen.add(n)
            todo += uses.get(n, ())
    return False


@dataclass
class Approvals:
    """Paused runs under single-use tokens, bound to a user, for a time."""

    seconds: float = 600.0
    clock: Callable[[], float] = time.monotonic
    held: dict = field(default_factory=dict)

    def store(self, user: str, state: object) -> str:
        token = secrets.token_urlsafe(24)
        self.held[token] = (user, self.clock() + self.seconds, state)
        return token

    def consume(self, user: str, token: str) -> object | None:
        """The state, once; another user's attempt leaves it in place."""
        found = self.held.get(token)
        if found is None or found[0] != user:
            return None
        del self.held[token]
        return found[2] if self.clock() <= found[1] else None


@dataclass
class ToolContext:
    """Calls left and depth, shared by nested runs; the depth is checked before a call is spent."""

    calls: int
    depth: int = 0
    max_depth: int = 3
    shared: list = field(default_factory=lambda: [0])

    def spend(self) -> None:
        if self.depth > self.max_depth:
            raise GraphError("nested too deep")
        if self.shared[0] >= self.calls:
            raise GraphError("no tool calls left")
        self.shared[0] += 1

    def nested(self) -> ToolContext:
        return ToolContext(self.calls, self.depth + 1, self.max_depth, self.shared)
