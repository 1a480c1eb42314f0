"""Named patterns, date formats and locales."""

from __future__ import annotations

import re

# The named extraction patterns, written for Java regular expressions.
PATTERNS = {
    "Email": r"(^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$)",
    "Email - RFC 5322": (
        r"""(^(?:(?:[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*"""
        r"""|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*")"""
        r"""@(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"""
        r"""|\[(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"""
        r"""(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?|[a-z0-9-]*[a-z0-9]:"""
        r"""(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\]))$)"""
    ),
    "URL": r"(https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&/=]*))",
    "IPv4 Address": r"(\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)",
    "IPv6 Address": (
        r"(([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:"
        r"|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4})"
    ),
    "Credit Card": r"(\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b)",
    "SSN": r"(\b\d{3}-\d{2}-\d{4}\b)",
    "Percentage": r"(\b\d{1,3}(\.\d{1,2})?%\b)",
    "JSON String": r'("([^"\\]*(\\.[^"\\]*)*))',
    "ISBN": r"(\b\d{3}-\d{10}\b)",
    # October is a month here, and MM.DD.YYYY has a year of four digits.
    "Date (YYYY-MM-DD)": r"(^(?:\d{4})[-](?:0[1-9]|1[0-2])[-](?:0[1-9]|[12][0-9]|3[01])$)",
    "Date (YYYY/MM/DD)": r"(^(?:\d{4})[/](?:0[1-9]|1[0-2])[/](?:0[1-9]|[12][0-9]|3[01])$)",
    "Date (YYYY.MM.DD)": r"(^(?:\d{4})[.](?:0[1-9]|1[0-2])[.](?:0[1-9]|[12][0-9]|3[01])$)",
    "Date (DD/MM/YYYY)": r"(^(?:0[1-9]|[12][0-9]|3[01])[/](?:0[1-9]|1[0-2])[/](?:\d{4})$)",
    "Date (DD-MM-YYYY)": r"(^(?:0[1-9]|[12][0-9]|3[01])[-](?:0[1-9]|1[0-2])[-](?:\d{4})$)",
    "Date (DD.MM.YYYY)": r"(^(?:0[1-9]|[12][0-9]|3[01])[.](?:0[1-9]|1[0-2])[.](?:\d{4})$)",
    "Date (DD/MM/YY)": r"(^(?:0[1-9]|[12][0-9]|3[01])[/](?:0[1-9]|1[0-2])[/](?:\d{2})$)",
    "Date (DD-MM-YY)": r"(^(?:0[1-9]|[12][0-9]|3[01])[-](?:0[1-9]|1[0-2])[-](?:\d{2})$)",
    "Date (DD.MM.YY)": r"(^(?:0[1-9]|[12][0-9]|3[01])[.](?:0[1-9]|1[0-2])[.](?:\d{2})$)",
    "Date (MM/DD/YYYY)": r"(^(?:0[1-9]|1[0-2])[/](?:0[1-9]|[12][0-9]|3[01])[/](?:\d{4})$)",
    "Date (MM-DD-YYYY)": r"(^(?:0[1-9]|1[0-2])[-](?:0[1-9]|[12][0-9]|3[01])[-](?:\d{4})$)",
    "Date (MM.DD.YYYY)": r"(^(?:0[1-9]|1[0-2])[.](?:0[1-9]|[12][0-9]|3[01])[.](?:\d{4})$)",
    "Date (MM/DD/YY)": r"(^(?:0[1-9]|1[0-2])[/](?:0[1-9]|[12][0-9]|3[01])[/](?:\d{2})$)",
    "Date (MM-DD-YY)": r"(^(?:0[1-9]|1[0-2])[-](?:0[1-9]|[12][0-9]|3[01])[-](?:\d{2})$)",
    "Date (MM.DD.YY)": r"(^(?:0[1-9]|1[0-2])[.](?:0[1-9]|[12][0-9]|3[01])[.](?:\d{2})$)",
}

# The date formats on offer, in strptime notation.
DATE_FORMATS = [
    "%A, %B %d, %Y", "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%m/%d/%Y", "%m-%d-%Y", "%d %b %Y",
    "%d %B %Y", "%d.%m.%Y", "%Y.%m.%d", "%b %d, %Y", "%a, %d %b %Y", "%A, %d %B %Y", "%Y-%m-%d %H:%M:%S",
    "%d/%m/%Y %H:%M", "%B %d, %Y %H:%M",
]

# The languages on offer.
LOCALES = [
    "en_US", "en_GB", "fr_FR", "de_DE", "es_ES", "it_IT", "pt_PT", "pt_BR", "ja_JP", "ko_KR", "zh_CN", "zh_TW", "nl_NL",
    "ru_RU", "sv_SE", "da_DK", "fi_FI", "nb_NO", "pl_PL", "tr_TR", "cs_CZ", "hu_HU", "el_GR",
]

# Strptime codes as Spark date patterns, (for writing, for reading). Reading takes one or two digits.
_CODES = {
    "A": ("EEEE", None), "a": ("EEE", None), "B": ("MMMM", "MMMM"), "b": ("MMM", "MMM"), "d": ("dd", "d"),
    "m": ("MM", "M"), "Y": ("yyyy", "yyyy"), "y": ("yy", "yy"), "H": ("HH", "H"), "I": ("hh", "h"), "M": ("mm", "m"),
    "S": ("ss", "s"), "f": ("SSSSSS", "SSSSSS"), "p": ("a", "a"), "j": ("DDD", "D"),
}


def spark_pattern(fmt: str, reading: bool) -> str:
    """A strptime format as a Spark pattern. A weekday at the start is left out for reading: see ``skips_weekday``."""
    if reading and skips_weekday(fmt):
        fmt = fmt[2:].lstrip(" ,")
    out = []
    for part in re.findall(r"%.|[A-Za-z']+|[^A-Za-z'%]+", fmt):
        if part == "%%":
            out.append("%")
        elif part.startswith("%"):
            if part[1] not in _CODES or _CODES[part[1]][reading] is None:
                raise ValueError(f"date code {part} in {fmt!r} is not supported for {'reading' if reading else 'writing'}")
            out.append(_CODES[part[1]][reading])
        elif part[0].isalpha() or part[0] == "'":
            out.append("'" + part.replace("'", "''") + "'")
        else:
            out.append(part)
    return "".join(out)


def skips_weekday(fmt: str) -> bool:
    """Spark does not read weekday names; a leading one is cut off the text, as it carries no date of its own."""
    return fmt[:2] in ("%A", "%a")


def locale_tag(locale: str | None) -> str | None:
    """``fr_FR.UTF-8`` -> ``fr-FR``; None for US English, which Spark uses anyway."""
    if not locale:
        return None
    tag = locale.split(".")[0].replace("_", "-")
    return None if tag == "en-US" else tag
