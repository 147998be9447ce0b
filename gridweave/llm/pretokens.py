"""Pre-tokens of the public byte-level vocabularies."""

from __future__ import annotations

import regex

#: Strings that the vocabulary file lists as special; text around them is cut there first.
SPECIAL = ("<|endoftext|>",)


def splitter(pattern: str):
    """``text -> list of pre-tokens`` for a pattern in the published notation.

    Letters that Unicode gained after the tables of an installed tokenizer
    library were made may be cut differently there.
    """
    return regex.compile(pattern).findall


def segments(text: str, special: tuple[str, ...] = SPECIAL) -> list[str]:
    """Text cut at special strings, which stay as items of their own."""
    if not any(s in text for s in special):
        return [text]
    return [s for s in regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if s]
