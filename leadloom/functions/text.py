"""Column expressions over messy text. Everything stays inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed


def _folding() -> tuple[str, str]:
    """Lower-case accented letters and their plain letter; combining marks map to nothing."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if letter == letter.lower() and base != letter and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented) + "".join(map(chr, range(0x0300, 0x0370))), "".join(plain)


_ACCENTED, _PLAIN = _folding()
# Unicode-aware and case-insensitive, as the patterns in `fixed` expect.
FLAGS = "(?iU)"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def match_key(c: Column) -> Column:
    """Folded text with single spaces; NULL when blank."""
    return F.when(~is_blank(c), squeeze(fold(c)))


def title(c: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case."""
    runs = F.split(squeeze(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))),
        "",
    )


def canonical(c: Column, names: dict[str, str]) -> Column:
    """Official name by match key, NULL when the key is unknown. `names` is a literal dictionary."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(match_key(c), F.lit("")))


def channel(c: Column) -> Column:
    return canonical(c, fixed.CHANNELS)


def state(c: Column) -> Column:
    return canonical(c, fixed.STATES)


def city(c: Column) -> Column:
    return F.when(~is_blank(c), F.coalesce(canonical(c, fixed.CITIES), title(c)))


def phone(c: Column) -> Column:
    """Ten digits starting with 3, without separators or the country prefix; NULL otherwise."""
    digits = F.regexp_replace(c, r"\D", "")
    local = F.when((F.length(digits) == 12) & digits.startswith("57"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(local.rlike(r"^3\d{9}$"), local)


def email(c: Column) -> Column:
    clean = F.lower(strip(c))
    return F.when(clean.rlike(r"(?U)" + fixed.EMAIL), clean)


def person_name(c: Column) -> Column:
    return F.when(is_blank(c), F.lit("")).otherwise(title(c))


def clean_model(c: Column) -> Column:
    """Match key without model years, `a.k.t` as `akt`; NULL when nothing is left."""
    text = F.replace(match_key(c), F.lit("a.k.t"), F.lit("akt"))
    text = squeeze(F.regexp_replace(text, r"(?U)\b20\d{2}\b", ""))
    return F.when(text != "", text)


def message_hour(c: Column) -> Column:
    """`HH:mm` of a message, NULL when unreadable."""
    text = strip(c)
    return F.when(text.rlike(r"^([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d)?)?$"),
                  F.concat(F.substring(text, 1, 2), F.lit(":"),
                           F.when(F.length(text) >= 5, F.substring(text, 4, 2)).otherwise("00")))


def quote_key(c: Column) -> Column:
    """Folded text where punctuation and spaces are one space: how quotes are compared."""
    return F.trim(F.regexp_replace(fold(c), r"(?U)[^\w$]+", " "))


def phone_shape(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "9")


def client_template_key(c: Column, names: list[str]) -> Column:
    """Phrase with catalogue names as <MOTO> (longest first) and figures as <N>, in lower case."""
    ordered = sorted(set(names), key=lambda n: (-len(n), n))
    escaped = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", n) for n in ordered]
    named = F.regexp_replace(c, "(?iu)" + "|".join(escaped), "<MOTO>") if escaped else c
    return F.lower(strip(F.regexp_replace(named, r"\$?\s?\d[\d.,]*", "<N>")))
