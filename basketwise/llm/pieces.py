"""Where a text can be split so that its tokens are those of its parts, and numbering of the parts.

With the usual byte-level word pattern each single space between two other characters begins a new word:
the character before it belongs to a word that holds no inner white space, and the space is taken up by
the word after it. Special strings hold no spaces. So a text is its first part and parts that each begin
with such a space; equal parts, which make up most of a corpus, have equal tokens.
"""

from __future__ import annotations

import re

import numpy as np

class Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = at = len(self)
        return at


def parts(text: str) -> list:
    """The parts of a text: the first as ``("", part)``, others without the space that begins them.

    Texts with runs of white space, or any but spaces and line feeds (which isn't printable), are rare; they
    are cut only at spaces that stand alone.
    """
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or not text.replace("\n", "x").isprintable():
        first, *rest = re.split(r"(?<=\S) (?=\S)", text)
    else:
        first, *rest = text.split(" ")
    return [("", first), *rest]


def string(part) -> str:
    return part[1] if isinstance(part, tuple) else " " + part


class PartTable:
    """Parts numbered across the blocks of one task, with what ``solve`` finds for new ones.

    It starts anew when its keys exceed ``most_bytes``, so its memory has a bound besides the block's own.
    """

    def __init__(self, most_bytes: int = 24 << 20):
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.known, self.bytes = Numbered(), 0

    def numbers(self, texts: list[str | None], divide=parts) -> tuple[np.ndarray, np.ndarray, list]:
        """The numbers of all parts in a row, each text's count of parts, and the new parts."""
        old = len(self.known)
        counts = np.zeros(len(texts), np.int64)
        rows = []
        look = self.known.__getitem__
        for i, text in enumerate(texts):
            if text:
                own = divide(text)
                counts[i] = len(own)
                rows.append(np.fromiter(map(look, own), np.int64, len(own)))
        new = list(self.known)[old:]
        self.bytes += sum(len(x[1]) if isinstance(x, tuple) else len(x) for x in new) + 16 * len(new)
        return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), counts, new

    def full(self) -> bool:
        return self.bytes > self.most_bytes


def gathered(values: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``values[first[i]:first[i + 1]]`` for each i of ``at`` in a row, and where each run ends."""
    sizes = first[at + 1] - first[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first[at] - ends + sizes, sizes) + np.arange(total)], ends
