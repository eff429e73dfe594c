"""Text normalisation as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_employee_id(raw: Column) -> Column:
    """``E42``, ``42``, `` e0042 `` -> ``E00042``; text without digits is kept; null -> empty."""
    cleaned = F.upper(strip(raw))
    digits = F.regexp_replace(F.regexp_replace(cleaned, "[^0-9]", ""), "^0+(?=[0-9])", "")
    padded = F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0"))
    return F.coalesce(F.when(digits == "", cleaned).otherwise(F.concat(F.lit("E"), padded)), F.lit(""))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Compatibility decompositions that reach ASCII letters or digits, derived from Unicode data.

    Returns the one-to-one ``translate`` pair, the one-to-many map and a regex class of
    combining marks. Code points outside these tables turn into spaces later on.
    """
    src, dst, many, marks = [], [], {}, []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        full = unicodedata.normalize("NFKD", ch)
        kept = "".join(x for x in full if not unicodedata.combining(x))
        if not kept:
            if marks and marks[-1][1] == cp - 1:
                marks[-1][1] = cp
            else:
                marks.append([cp, cp])
            continue
        if not any(x.isascii() and x.isalnum() for x in kept):
            continue
        if len(kept) == 1:
            src.append(ch)
            dst.append(kept)
        else:
            many[ch] = kept
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in marks)
    return "".join(src), "".join(dst), many, f"[{ranges}]"


def _fold_accents(c: Column) -> Column:
    src, dst, many, marks = _fold_tables()
    single = F.translate(c, src, dst)
    listed = "\u0001".join(f"{ch}\u0002{spelled}" for ch, spelled in many.items())
    pairs = F.str_to_map(F.lit(listed), F.lit("\u0001"), F.lit("\u0002"))
    spelled = F.array_join(
        F.transform(
            F.regexp_extract_all(single, F.lit("(?s)(.)"), 1),
            lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch),
        ),
        "",
    )
    widened = F.when(single.rlike("[^\\x00-\\x7f]"), spelled).otherwise(single)
    return F.regexp_replace(widened, marks, "")


def normalize_name(raw: Column) -> Column:
    """Compatibility-fold, drop marks, lower, keep ``[a-z0-9]`` words; null -> empty.

    Pure ASCII names skip the folding branch.
    """
    folded = F.when(raw.rlike("[^\\x00-\\x7f]"), _fold_accents(raw)).otherwise(raw)
    return F.coalesce(F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " ")), F.lit(""))


def email_local(raw: Column) -> Column:
    return F.coalesce(F.substring_index(F.lower(strip(raw)), "@", 1), F.lit(""))


def email_domain(raw: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(strip(raw)), "(?s)^[^@]*@(.*)$", 1), F.lit(""))


def is_corporate(domain: Column, domains: Sequence[str]) -> Column:
    return domain.isin(*domains)


def text_true(c: Column) -> Column:
    return F.coalesce(F.upper(c) == "TRUE", F.lit(False))


def split_values(c: Column, separator: str) -> Column:
    """Delimited list -> array without empty entries."""
    parts = F.split(F.coalesce(c, F.lit("")), "\\" + separator)
    return F.filter(parts, lambda x: x != "")


def contains_ci(haystack: Column, needle: str) -> Column:
    """Case-insensitive substring test with no wildcard meaning for ``%`` and ``_``."""
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def natural_name(raw: Column) -> Column:
    """``Last, First Jr.`` -> ``First Last``; ``first.last@`` -> ``first last``; else unchanged."""
    text = strip(raw)
    last = strip(F.substring_index(text, ",", 1))
    first = F.regexp_extract(text, "(?s)^[^,]*,(.*)$", 1)
    first = strip(F.replace(F.replace(strip(first), F.lit("Jr."), F.lit("")), F.lit("Sr."), F.lit("")))
    handle = F.regexp_replace(F.regexp_replace(text, "@$", ""), "\\.", " ")
    return (
        F.when(F.contains(text, F.lit(",")), F.concat(first, F.lit(" "), last))
        .when(F.endswith(text, F.lit("@")), handle)
        .otherwise(text)
    )


def sort_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, " "), lambda t: t != "")), " ")
