"""Bounded work on batches of texts."""

from __future__ import annotations

from collections.abc import Iterator


def slices(texts: list[str], rows: int = 8192, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive parts with at most so many texts, and characters unless a single text has more."""
    start = held = 0
    for k, text in enumerate(texts):
        if k > start and (k - start >= rows or held + len(text) > chars):
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
