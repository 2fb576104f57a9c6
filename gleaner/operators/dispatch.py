"""Processors by name: ``Name(arguments)`` is looked up in a table and never evaluated."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Registry:
    """The processors of one kind. What isn't registered or can't be read gives the default."""

    suffix: str = "Processor"
    known: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def register(self, name: str, make: Callable[..., Any]) -> None:
        self.known[self.full(name)] = make

    def full(self, name: str) -> str:
        return name if name.endswith(self.suffix) else name + self.suffix

    def __call__(self, spec: str | None, default: Any = None) -> Any:
        """What the processor's maker gives for the arguments of ``spec``; ``default`` if there is no such processor or its arguments don't fit."""
        try:
            name, values, named = parse_call(spec or "")
            return self.known[self.full(name)](*values, **named)
        except (KeyError, TypeError, ValueError, SyntaxError):
            return default

    def chain(self, specs: list[str] | None, default: Any) -> list[Any]:
        """The processors of all specs that can be read; the default alone if there is none."""
        made = [p for p in (self(s) for s in specs or []) if p is not None]
        return made or [default]


def parse_call(spec: str) -> tuple[str, list, dict]:
    """Name, values and named values of ``Name`` or ``Name(1, 'a', key=[2])``; only literals are values."""
    node = ast.parse(spec.strip(), mode="eval").body
    if isinstance(node, ast.Name):
        return node.id, [], {}
    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name)):
        raise ValueError(f"not a processor: {spec}")
    return node.func.id, [ast.literal_eval(a) for a in node.args], {k.arg: ast.literal_eval(k.value) for k in node.keywords if k.arg}
