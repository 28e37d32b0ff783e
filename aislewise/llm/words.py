"""Words of a text whatever their writing: case, punctuation, spacing, markup, form of characters."""

from __future__ import annotations

import html
import re
import unicodedata

def _invisible(lo: int, hi: int) -> re.Pattern[str]:
    """Marks and format characters of a range; they belong to no word."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(lo, hi) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")) + "]+")


#: Apart, since the engine looks the first up in a table and walks through the second.
_INVISIBLE = _invisible(0, 0x10000)
_INVISIBLE_ASTRAL = (_invisible(0x10000, 0x20000), _invisible(0xE0000, 0xE1000))
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_TAG = re.compile(r"<[!/]?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_].)[ \t]*(?:\r\n|\n|\r)[ \t>#*|/]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, compatible forms, without marks, invisible characters, tags and line-end hyphens."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        if _ASTRAL.search(text):
            for pattern in _INVISIBLE_ASTRAL:
                text = pattern.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.casefold()
    if "-\n" in text or "-\r" in text or "- " in text or not text.isascii():
        text = _BROKEN.sub("", text)
    return text


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the plain text; a hyphen ends a word."""
    return _WORD.findall(plain(text))


def compounds_of(text: str) -> set[tuple[str, str]]:
    """Hyphenated words of two parts, so that their written-together and spaced forms can count as the same word."""
    joined = plain(text)
    return {tuple(m.split("-")) for m in re.findall(r"(?<![^\W_])[^\W_]+-[^\W_]+(?![^\W_])(?!-)", joined.replace("‐", "-").replace("‑", "-"))}
