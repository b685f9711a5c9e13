"""What the engine raises, always before anything runs."""

from __future__ import annotations


class QueryError(ValueError):
    """The text can't be parsed or means nothing here: unknown names, missing indexes, wrong widths, leftovers."""
