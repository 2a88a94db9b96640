"""Markup to plain text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag begins with a letter, '/', '!' or '?'; any other '<' is text. '>' may stand in a quoted value.
_TAG = r"<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*>"
_DROPPED = rf"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|{_TAG}"

# Old names are read without their semicolon, the longest first.
_UNCLOSED = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# What the numbers 128 to 159 stand for: the letters of the Windows code page.
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}


def markup_to_text(c: Column, sep: str = "") -> Column:
    """Remove scripts, styles, comments and tags; join the trimmed text pieces by ``sep``; decode entities."""
    mark = "\x1e"
    pieces = F.regexp_replace(F.coalesce(c, F.lit("")), _DROPPED, mark)
    joined = F.regexp_replace(pieces, rf"(?U)(?<!\s)\s*+{mark}[\s{mark}]*+", mark)
    text = F.regexp_replace(joined, rf"(?U)^[\s{mark}]++|(?<![\s{mark}])[\s{mark}]++$", "")
    return decode_entities(F.replace(text, F.lit(mark), F.lit(sep)))


def _constant(table: dict[str, str]) -> Column:
    """A map of constants; its text is read once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def decode_entities(c: Column) -> Column:
    """Named and numeric character references as characters; unknown ones stay.

    A text is cut before each '&', and only pieces that begin with a reference are looked up, so texts
    without '&' cost one search.
    """
    names, windows = _constant({n.rstrip(";"): v for n, v in html5.items()}), _constant(_WINDOWS)

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#(\d+|[xX][0-9a-fA-F]+)", 1)
        number = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 1 << 30), 16, 10)).otherwise(F.ltrim(digits, F.lit("0")))
        code = F.when(F.length(number) <= 7, number.try_cast("int"))
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        numeric = F.concat(F.coalesce(F.try_element_at(windows, number), char), F.regexp_replace(piece, r"^&#(?:\d+|[xX][0-9a-fA-F]+);?", ""))
        whole = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);", 1)
        named = F.try_element_at(names, whole)
        old = F.regexp_extract(piece, f"^&({_UNCLOSED})", 1)
        return (
            F.when(digits != "", numeric)
            .when(named.isNotNull(), F.concat(named, F.substring(piece, F.length(whole) + 3, F.lit(1 << 30))))
            .when(old != "", F.concat(F.try_element_at(names, old), F.substring(piece, F.length(old) + 2, F.lit(1 << 30))))
            .otherwise(piece)
        )

    pieces = F.transform(F.split(c, "(?=&)"), lambda p: F.when(p.startswith("&"), decoded(p)).otherwise(p))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def escape_markup(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c

