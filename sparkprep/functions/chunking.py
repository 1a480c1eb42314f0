"""Cutting one text into chunks. Small helpers that run on whole texts inside pandas UDFs."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable


def words(text: str) -> int:
    return len(text.split())


def pack(pieces: list[str], size: int, overlap: int, joiner: str, length: Callable[[str], int]) -> list[str]:
    """Join pieces, in order, to chunks of at most ``size``; a chunk starts with the last pieces of the one before, as
    far as they fit into ``overlap``. A piece longer than ``size`` makes a chunk of its own."""
    gap = length(joiner)
    chunks: list[str] = []
    held: deque[tuple[str, int]] = deque()
    used = 0  # length of the held pieces, joined

    def emit() -> None:
        text = joiner.join(piece for piece, _ in held).strip()
        if text:
            chunks.append(text)

    for piece in pieces:
        n = length(piece)
        if held and used + gap + n > size:
            emit()
            # Keep a tail that is short enough to repeat and leaves room for the new piece.
            while held and (used > overlap or used + gap + n > size):
                _, first = held.popleft()
                used -= first + (gap if held else 0)
        used += n + (gap if held else 0)
        held.append((piece, n))
    if held:
        emit()
    return chunks


def split_fixed(text: str, separator: str, regex: bool, size: int, overlap: int, length) -> list[str]:
    """Split at one separator, then pack."""
    if separator == "":
        pieces = list(text)
    elif regex:
        pieces = re.split(separator, text)
    else:
        pieces = text.split(separator)
    return pack([p for p in pieces if p], size, overlap, " " if regex else separator, length)


def split_recursive(text: str, separators: list[str], regex: bool, size: int, overlap: int, length) -> list[str]:
    """Split at the first separator that occurs; parts that are still too long are split at the next ones.

    A separator stays at the start of the part that follows it, so packed parts give back the original text.
    """
    index = next((i for i, s in enumerate(separators) if s == "" or re.search(s if regex else re.escape(s), text)), None)
    if index is None:
        return [text.strip()] if text.strip() else []
    separator, rest = separators[index], separators[index + 1 :]
    if separator == "":
        parts = list(text)
    else:
        at = [m.start() for m in re.finditer(separator if regex else re.escape(separator), text) if m.group()]
        bounds = [0, *at, len(text)]
        parts = [text[a:b] for a, b in zip(bounds, bounds[1:]) if a < b]
    chunks: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if length(part) < size:
            fitting.append(part)
            continue
        chunks += pack(fitting, size, overlap, "", length)
        fitting = []
        if rest:
            chunks += split_recursive(part, rest, regex, size, overlap, length)
        elif part.strip():
            chunks.append(part)
    return chunks + pack(fitting, size, overlap, "", length)


def split_sentences(text: str) -> list[str]:
    """Sentences end at . ! or ? (with closing quotes or brackets) before white space, and at blank lines."""
    marked = re.sub(r"([.!?…]+[\"'”’)\]]*)\s+", "\\1\n\n", text)
    return [s.strip() for s in re.split(r"\n\s*\n", marked) if s.strip()]
