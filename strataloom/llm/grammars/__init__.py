"""Grammars and lexers of the languages whose files are checked."""

from __future__ import annotations


class LexError(Exception):
    """No token fits; `at` is the offset in the text."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at
