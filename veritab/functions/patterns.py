"""Named formats and the small builders that turn a template into a regex."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named conformity standards.
STANDARDS: dict[str, str] = {
    "iso_8601": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$",
    "e164": r"^\+[1-9]\d{1,14}$",
    "iso_4217": r"^[A-Z]{3}$",
    "iso_3166": r"^[A-Z]{2}$",
    "email_rfc5322": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[\d\s\-\.\(\)]{7,}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$",
    "ip_address": r"^((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(25[0-5]|2[0-4]\d|[01]?\d\d?)$",
    "credit_card": r"^\d{13,19}$",
    "postal_code": r"^[A-Z0-9]{3,10}(-[A-Z0-9]{3,10})?$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
}

# The named character sets of the charset check.
CHARSETS: dict[str, str] = {
    "alpha": "A-Za-z",
    "numeric": "0-9",
    "alphanumeric": "A-Za-z0-9",
    "ascii": r"\x00-\x7F",
    "printable": r"\x20-\x7E",
}

# The documented validator names; the ones that are also standards share a pattern.
VALIDATORS: dict[str, str] = {
    "email": STANDARDS["email"],
    "url": STANDARDS["url"],
    "uuid": STANDARDS["uuid"],
    "ipv4": STANDARDS["ip_address"],
    "ipv6": r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?::(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?$",
    "isodate": r"^\d{4}-\d{2}-\d{2}$",
    "iso8601": STANDARDS["iso_8601"],
    "phone_e164": STANDARDS["e164"],
}

# POSIX bracket classes are legal in the source engines but not in Java regex.
POSIX_CLASSES: dict[str, str] = {
    "[:alpha:]": "a-zA-Z",
    "[:digit:]": "0-9",
    "[:alnum:]": "a-zA-Z0-9",
    "[:upper:]": "A-Z",
    "[:lower:]": "a-z",
    "[:space:]": r"\s",
    "[:punct:]": r"\p{Punct}",
    "[:xdigit:]": "0-9A-Fa-f",
}


def java_regex(pattern: str, flags: str = "") -> str:
    """Rewrite POSIX bracket classes and prepend inline flags (any of ``ims``)."""
    for posix, plain in POSIX_CLASSES.items():
        pattern = pattern.replace(posix, plain)
    return f"(?{flags}){pattern}" if flags else pattern


def template_regex(template: str) -> str:
    """``AA-9999`` style template: ``A`` is an upper-case letter, ``9`` a digit."""
    slots = {"A": "[A-Z]", "9": "[0-9]"}
    return "^" + "".join(slots.get(ch, re.escape(ch)) for ch in template) + "$"


def charset_regex(charset: str, custom: str = "") -> str:
    return f"^[{custom if charset == 'custom' else CHARSETS.get(charset, charset)}]*$"


def negative_match(col: Column, pattern: str, mode: str = "regex") -> Column:
    """Rows a negative check rejects. ``contains`` keeps LIKE wildcards alive."""
    if mode == "exact":
        return col == F.lit(pattern)
    if mode == "contains":
        return col.like(f"%{pattern}%")
    return col.rlike(java_regex(pattern))
