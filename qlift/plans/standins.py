"""Deterministic stand-ins for language models, so that the inference queries have an oracle (not part of the operators)."""

from __future__ import annotations

from collections.abc import Callable


def enhancer_factory(tag: str | None = None) -> Callable:
    mark = f" [{tag}]" if tag else ""
    return lambda batch: [None if q is None else f"Explain {q} for <Audience>{mark}" for q in batch]


def responder_factory(tag: str | None = None) -> Callable:
    return lambda batch: [None if q is None else f"Answer: {q}" for q in batch]
