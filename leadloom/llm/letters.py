"""Character classes of the tokenizer library, which follows Unicode 16, for a pattern module of a later version."""

from __future__ import annotations

import re

# Code points that are letters, and numbers, only since Unicode 17 (first-last, hexadecimal).
LATER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capitals of Unicode 16 and 17 that the library lower-cases and Python's tables may not know, with the distance of the small letter.
LATER_CAPITALS = (
    ("1C89-1C89", 1), ("A7CB-A7CB", 0x264 - 0xA7CB), ("A7CC-A7CC", 1), ("A7CE-A7CE", 1), ("A7D2-A7D2", 1), ("A7D4-A7D4", 1), ("A7DA-A7DA", 1),
    ("A7DC-A7DC", 0x19B - 0xA7DC), ("10D50-10D65", 0x20), ("16EA0-16EB8", 0x1B),
)


def _spans(ranges: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, _, b in (r.partition("-") for r in ranges.split())]


def _inside(ranges: str) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _spans(ranges))


#: A letter, a number, and what is neither one nor white space, for the inside of a pattern.
LETTER = rf"[^\P{{L}}{_inside(LATER_LETTERS)}]"
NUMBER = rf"[^\P{{N}}{_inside(LATER_NUMBERS)}]"
OTHER = rf"(?:[^\s\p{{L}}\p{{N}}]|[{_inside(LATER_LETTERS)}{_inside(LATER_NUMBERS)}])"

LOWER = {c: c + by for ranges, by in LATER_CAPITALS for a, b in _spans(ranges) for c in range(a, b + 1)}

_BEYOND = re.compile("[\u0530-\U0010FFFF]")


def settled(text: str) -> bool:
    """Whether a text lies below the first code point that versions differ in, so that the plain classes hold."""
    return _BEYOND.search(text) is None
