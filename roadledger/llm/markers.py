"""Control strings that stay recognisable wherever texts are put between them."""

from __future__ import annotations

import re


def checked(*markers: str) -> tuple[str, ...]:
    """The markers, if no text can complete or start one across its border.

    Each must be longer than one character and no marker's first character may stand further on
    in any of them. Then a marker found in a joined text is either one that was put there or
    lies wholly inside one of the texts.
    """
    first = {marker[:1] for marker in markers}
    if len(set(markers)) < len(markers) or any(len(m) < 2 or first & set(m[1:]) or "\\" in m for m in markers):
        raise ValueError(f"control strings that could run into texts: {markers}")
    return markers


def quoted(text: str) -> str:
    """A regular expression (of the JVM) for exactly this text."""
    return re.sub(r"([^\w\s<>/])", r"\\\1", text)


def as_replacement(text: str) -> str:
    """The text for use in a replacement, where a dollar sign names a group."""
    return re.sub(r"([\\$])", r"\\\1", text)
