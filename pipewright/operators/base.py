"""The registry of tabular operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

OPERATORS: dict[str, Callable[..., Any]] = {}


def operator(*kinds: str) -> Callable:
    def add(f: Callable) -> Callable:
        for k in kinds:
            OPERATORS[k] = f
        return f

    return add
