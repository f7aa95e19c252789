"""Normalised character streams with offsets into the original text, shared by the text operators."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones, as in the Unicode confusables.
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁһɡӏкмтвнАВЕКМНОРСТУХІЈЅαοερντυιχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhglkmtbhabekmhopctyxijsaoepvtuixkabezhikmnoptyx", strict=True,
))
#: Letters that have no decomposition.
PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}


class _Fold(dict):
    """Character -> its letters and digits without case, marks and look-alikes; for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in LOOKALIKES:
            out = LOOKALIKES[c]
        else:
            parts = unicodedata.normalize("NFKD", c).casefold()
            out = "".join(PLAIN.get(x, LOOKALIKES.get(x, x)) for x in parts if unicodedata.category(x)[0] in "LN")
        self[code] = out
        return out


FOLD = _Fold()
_HARD = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}|\\[nrt]")


def stream(text: str) -> str:
    """Letters and digits of the text, one after the other: nothing of case, marks, markup, escapes, spacing is left."""
    if "<" in text or "&" in text or "\\" in text:
        text = _HARD.sub(_unescape, text)
    return text.translate(FOLD)


def _unescape(m: re.Match) -> str:
    s = m.group()
    if s[0] == "<":
        return " "
    if s[0] == "&":
        return html.unescape(s)
    return chr(int(s[2:], 16)) if s[1] == "u" else " "


def offsets(text: str) -> list[int]:
    """For each character of stream(text), the place of its source in text."""
    out: list[int] = []
    at = 0
    for m in [*_HARD.finditer(text), None]:
        end = m.start() if m else len(text)
        for i in range(at, end):
            out += [i] * len(text[i].translate(FOLD))
        if m:
            out += [m.start()] * len(_unescape(m).translate(FOLD))
            at = m.end()
    return out


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.UNICODE)


def words(text: str) -> list[str]:
    """The words of a text as stretches of its stream; apostrophes within a word don't split it."""
    return [w for w in (x.translate(FOLD) for x in _WORD.findall(text)) if w]
