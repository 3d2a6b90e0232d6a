"""Words as they are compared: runs of letters and digits after compatibility normalisation, lower-casing and dropping diacritics."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import regex

_DROPPED = regex.compile(r"[\p{M}­​⁠]+")
_WORD = re.compile(r"[^\W_]+")
_WORD_AND_GAP = re.compile(r"([^\W_]+)([\W_]*)")


def normal(text: str) -> str:
    out = unicodedata.normalize("NFKC", text).lower()
    return out if out.isascii() else _DROPPED.sub("", unicodedata.normalize("NFD", out))


class _Plain(dict):
    """What a word comes to without its diacritics: one word, as a rule."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = [word] if word.isascii() else _WORD.findall(_DROPPED.sub("", unicodedata.normalize("NFD", word)))
        return out


_PLAIN = _Plain()


def _composed(text: str) -> str | None:
    """The text after compatibility normalisation and lower-casing, if its words can then be taken one by one.

    They can where no combining mark or dropped character stands in it: what is left of diacritics is inside the letters.
    """
    out = (text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
    return out if out.isascii() or not _DROPPED.search(out) else None


def words(text: str | None) -> list[str]:
    if not text:
        return []
    out = _composed(text)
    if out is None:
        return _WORD.findall(normal(text))
    found = _WORD.findall(out)
    return found if out.isascii() else list(chain.from_iterable(map(_PLAIN.__getitem__, found)))


def words_and_gaps(text: str | None) -> list[tuple[str, str]]:
    """Each word with what stands between it and the next."""
    return _WORD_AND_GAP.findall(normal(text)) if text else []
