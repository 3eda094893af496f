"""Embedders for tests and offline use; any function from a list of texts to a list of vectors will do in their place."""

from __future__ import annotations

import string


def letters(texts: list[str]) -> list[list[float]]:
    """Counts of the 26 letters: a plain embedder whose vectors SQL can state too."""
    return [[float(low.count(c)) for c in string.ascii_lowercase] for low in map(str.lower, texts)]
