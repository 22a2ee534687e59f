"""Text expressions: cleaning, entities, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space and control characters, and invisible format characters, as the inside of a character class.
SPACE = r"\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INVISIBLE = r"\x{ad}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}\x{fff9}-\x{fffb}\x{e0001}\x{e0020}-\x{e007f}"
#: A reference from ``&`` to the next ``;``, or the text between references.
_REFERENCES = "&[^;]*;|[^&]+|&"
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def sanitize(text: Column, most: int = 200) -> Column:
    """Runs of white space, controls and invisible characters become one space; no space at the ends; at most ``most`` characters; null if none are left."""
    t = F.trim(F.regexp_replace(text, f"[{SPACE}{INVISIBLE}]+", " "))
    return F.nullif(F.rtrim(F.substring(t, 1, most)), F.lit(""))


def xml_unescape(text: Column) -> Column:
    """Character references decoded once, in one pass: the five named ones, decimal and hexadecimal ones of characters other than controls.

    What is decoded is not read again, so ``&amp;lt;`` gives ``&lt;``. Other
    references, and ``&`` without a ``;`` after it, stay as they are.
    """

    def decoded(t: Column) -> Column:
        hexadecimal, decimal = (F.regexp_extract(t, p, 1) for p in ("^&#[xX][+]?([0-9A-Fa-f]+);$", "^&#[+]?([0-9]+);$"))
        code = F.coalesce(F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10).try_cast("long"), F.nullif(decimal, F.lit("")).try_cast("long"))
        allowed = code.isin(9, 10, 13) | code.between(0x20, 0x7E) | code.between(0xA0, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.coalesce(*(F.when(t == k, F.lit(v)) for k, v in _NAMED.items()))
        return F.when(~t.startswith("&"), t).otherwise(F.coalesce(named, F.when(allowed, char), t))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCES), F.lit(0)), decoded), "")).otherwise(text)


def attributes(markup: Column, name: str) -> Column:
    """All double-quoted values of an attribute, in order."""
    return F.regexp_extract_all(markup, F.lit(f'\\b{name}="([^"]*)"'), 1)
