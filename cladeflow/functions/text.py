"""Cleaning rules for cells of barcode dumps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, and the placeholders read as missing.
BLANK = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PLACEHOLDERS = ("", "none", "null", "na", "n/a", "nan", "unknown", "-")
UNKNOWN_SPECIES = ("", "none", "null", "nan", "unknown", "unclassified")


def collapse(cell: Column) -> Column:
    """Surrounding blanks dropped, inner runs made one."""
    return F.trim(F.regexp_replace(cell, BLANK + "+", " "))


def blank_clean(cell: Column) -> Column:
    """``collapse``, with placeholders of any letter case read as null."""
    text = collapse(cell)
    return F.when(~F.lower(text).isin(*PLACEHOLDERS), text)


def taxon_name(cell: Column) -> Column:
    """Cleaned taxon with a capital and small letters; null if missing.

    The collapsed text is bound once by a lambda, as it would otherwise be made anew at each of its uses.
    """
    def named(text: Column) -> Column:
        lower = F.lower(text)
        return F.when(~lower.isin(*PLACEHOLDERS), F.concat(F.upper(F.substring(text, 1, 1)), lower.substr(F.lit(2), F.length(lower))))

    return F.get(F.transform(F.array(collapse(cell)), named), F.lit(0))


def bin_name(cell: Column) -> Column:
    """``BOLD:ABC0123`` for a cell that names a BIN, else null.

    Blanks, letter case, punctuation and the prefix don't matter; exactly three
    letters and four digits must remain.
    """
    rest = F.regexp_replace(F.regexp_replace(F.upper(cell), r"[^\p{L}\p{N}]", ""), "^BOLD", "")
    return F.when(rest.rlike("^[A-Z]{3}[0-9]{4}$"), F.concat(F.lit("BOLD:"), rest))
