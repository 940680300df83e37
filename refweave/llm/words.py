"""Words of a text as they count for comparison: runs of letters and digits, whatever wraps or escapes them."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Container

WORD = re.compile(r"[^\W_]+")
# Inline and block tags that may wrap quoted text (fixed values).
_TAG = re.compile(
    r"</?(?:a|abbr|article|b|blockquote|body|br|code|dd|del|div|dl|dt|em|font|h[1-6]|head|hr|html|i|img|ins|kbd|li|main|mark|ol|p|pre|q|s|samp|section|small|span|strong|sub|sup|table|tbody|td|th|thead|tr|tt|u|ul|var)(?:\s[^<>]*)?/?>",
    re.IGNORECASE,
)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.DOTALL)
_LINK = re.compile(r"\]\([^()\s]*\)")
_LINE_NO = re.compile(r"(?m)^[ \t]*(?:L?\d+[ \t]*[|:])[ \t]?")
_BROKEN = re.compile(r"([^\W_]+)[-‐‑][ \t]*\r?\n[ \t>#/*|;%+\-]*([^\W_]+)")
_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}
INVISIBLE = re.compile("[­᠎​-‍⁠﻿]")


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if code:
        return chr(int(code, 16))
    return {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(3), m.group(3))


def words(text: str | None, vocabulary: Container[str] = ()) -> list[str]:
    """The words of ``text`` in lower case; null or empty gives none.

    Character references, backslash escapes, tags, link targets, line numbers and invisible characters are dropped, and
    compatibility forms folded. A word broken by a hyphen at a line end is joined where the whole is in ``vocabulary``
    (or the vocabulary is empty), else it stays two words.
    """
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "\\" in t:
        t = _ESCAPE.sub(_unescape, t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "](" in t:
        t = _LINK.sub("]", t)
    if not t.isascii():
        t = INVISIBLE.sub("", t)
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
    t = t.lower()
    if "-\n" in t or "- \n" in t or "-\r" in t or "‐" in t:
        def join(m: re.Match) -> str:
            a, b = m.groups()
            return a + b if not vocabulary or a + b in vocabulary else a + " " + b

        t = _BROKEN.sub(join, t)
    if "|" in t or ":" in t:
        t = _LINE_NO.sub("", t)
    return t.translate(_ASCII).split() if t.isascii() else WORD.findall(t)
