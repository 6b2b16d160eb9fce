"""Which characters look the same: one table, built by rule from the Unicode database and one list of look-alikes.

A character maps to

* nothing, if it is invisible (format characters, controls that print nothing, variation selectors);
* a space, if it is any kind of space or a tab;
* its compatibility form, if the two look alike: wide, narrow, font and no-break variants, presentation
  forms, ligatures. Superscripts, fractions, circled and squared forms look different and stay, as do the
  spacing accents;
* the Latin letter that it looks like, accents being kept.

All other characters (case, digits, punctuation, accents) stay. Composition (NFC) comes after the mapping.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import cache

# Letters of other alphabets, and variants, that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "У": "Y", "Ӏ": "I", "ѵ": "v",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, and variants of Latin letters
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "ɑ": "a", "ɡ": "g", "Ð": "Đ", "Ɖ": "Đ",
}
#: Tags of the Unicode database for compatibility forms that look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Marks that aren't of category Cf but print nothing: grapheme joiner, Hangul and Khmer fillers, variation selectors.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _look(c: str) -> str:
    cp, kind = ord(c), ud.category(c)
    if kind == "Cf" or cp in INVISIBLE or kind == "Cc" and c not in "\t\n\x0b\x0c\r\x85":
        return ""
    if kind == "Zs" or c == "\t":
        return " "
    tag, _, rest = ud.decomposition(c).partition(" ")
    if tag in SAME_LOOK:
        inner = "".join(chr(int(x, 16)) for x in rest.split())
        return c if inner[0] == " " and len(inner) > 1 else "".join(map(_look, inner))
    base, *marks = ud.normalize("NFD", c)
    return ud.normalize("NFC", LOOKALIKES[base] + "".join(marks)) if base in LOOKALIKES else c


def assigned() -> Iterator[str]:
    """The characters of the planes in use, without surrogates, private use and unassigned code points."""
    for cp in (*range(0x32400), *range(0xE0000, 0xE0200)):
        c = chr(cp)
        if ud.category(c) not in ("Cs", "Co", "Cn"):
            yield c


@cache
def table() -> dict[str, str]:
    """The characters that don't stay as they are, with what they become."""
    out = {}
    for c in assigned():
        to = _look(c)
        if to != c:
            out[c] = to
    return out


def form(text: str) -> str:
    """The one form of a text, character by character: what the embedded SQL of ``normalize`` computes in bulk."""
    t = table()
    return ud.normalize("NFC", "".join(t.get(c, c) for c in text))


def fold(c: str) -> str:
    """A character as words are compared: its form without case and accents; a space for what isn't part of a word."""
    out = []
    for x in ud.normalize("NFD", form(c).casefold()):
        kind = ud.category(x)
        if kind == "Mn":
            continue
        x = "d" if x == "đ" else x
        out.append(x if kind[0] == "L" or kind in ("Nd", "Mc") else " ")
    return "".join(out)
