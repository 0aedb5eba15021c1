"""Text functions: white space, UTF-16 lengths, estimated pixel widths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapsed(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(_col(c), f"{SPACE}+", " "))


# Parts of SPACE. The engine tests a class of Latin characters by one look into a table, a wider one by a call for each of its ranges,
# so WIDE first asks whether the character lies beyond them.
NARROW = r"\t\n\x0B\f\r "
WIDE = r"(?=[\u00A0-\uFEFF])[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def word_count(c) -> Column:
    """How many words, parted by white space, a text has. It is named and read once: of each word one character is left, of white space none."""
    plain = F.regexp_replace(_col(c), WIDE, " ")
    return F.length(F.regexp_replace(plain, f"[{NARROW}]*([^{NARROW}])[^{NARROW}]*|[{NARROW}]+", "$1"))


def utf16_length(c) -> Column:
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def rounded(c: Column) -> Column:
    """Half up, as a whole number."""
    return F.floor(c + 0.5)


def pixel_width(c) -> Column:
    """Estimated width of a text in pixels; 0 for null and empty. Counts characters by class, without leaving generated code."""
    text = F.coalesce(_col(c), F.lit(""))
    count = lambda chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))
    total = F.length(text) * F.lit(config.OTHER_WIDTH)
    special = "".join(chars for _, chars in config.GLYPHS)
    for width, chars in config.GLYPHS:
        total = total + count("[" + re.sub(r"([\[\]\\^-])", r"\\\1", chars) + "]") * F.lit(width - config.OTHER_WIDTH)
    upper = "".join(x for x in map(chr, range(65, 91)) if x not in special)
    lower = "".join(x for x in map(chr, range(97, 123)) if x not in special)
    total = total + count(f"[{upper}]") * F.lit(config.UPPER_WIDTH - config.OTHER_WIDTH) + count(f"[{lower}]") * F.lit(config.LOWER_WIDTH - config.OTHER_WIDTH)
    return rounded(total).cast("int")
