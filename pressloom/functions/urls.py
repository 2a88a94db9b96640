"""Url columns: clean-up, audit, domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.text import strip

MAX_URL = 2048

# Marks that make a url suspicious (matched in its lower-cased form).
SUSPICIOUS = r"javascript:|data:|vbscript:|file:|about:|\.\./|%00|%0d%0a"

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def sanitize_url(c: Column) -> Column:
    """Trim, delete NUL, collapse repeated slashes after the first '://'."""
    u = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\x00"), F.lit(""))
    return F.regexp_replace(u, r"(?s)^(.*?://)(/)?/*|(/)/*", "$1$2$3")


def authority(c: Column) -> Column:
    """The part between '//' and the path, user and port included; '' if none."""
    return F.coalesce(F.regexp_extract(c, _AUTHORITY, 1), F.lit(""))


def domain(c: Column, missing: str = "") -> Column:
    a = authority(c)
    return F.when(a == "", F.lit(missing)).otherwise(a)


# A bracket without its partner, and a host (after the last '@'; in brackets or up to a colon).
_AT_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_LOPSIDED = rf"{_AT_HOST}(?:[^/?#\]]*\[[^/?#\]]*|[^/?#\[]*\][^/?#\[]*)(?:[/?#]|$)"
_HAS_HOST = rf"{_AT_HOST}(?:[^/?#]*@)?+(?:\[[^\]/?#]+\]|[^:/?#\[\]])"


def url_reject_reason(c: Column) -> Column:
    """Why a url is refused, or null when it is accepted. The first failed check names the reason."""
    # Line breaks and tabs inside, and controls in front, do not count when a url is split up.
    u = F.regexp_replace(c, r"^[\x00-\x20]+|[\t\r\n]", "")
    return (
        F.when(c.isNull() | (c == ""), F.lit("empty"))
        .when(u.rlike(_LOPSIDED), F.lit("malformed"))
        .when(~u.rlike("^(?i:https?):"), F.lit("scheme"))
        .when(F.lower(c).rlike(SUSPICIOUS), F.lit("suspicious"))
        .when(~u.rlike(_HAS_HOST), F.lit("hostname"))
        .when(F.length(c) > MAX_URL, F.lit("length"))
    )
