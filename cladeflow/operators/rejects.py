"""Delimited lines loaded as nullable text, checked by rules, and split into sound and failed rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.text import blank_clean
from cladeflow.functions.vectors import bind


@dataclass(frozen=True)
class Rule:
    """What a cell must be after blank cleaning: of a pattern, castable to a type, or both; a missing cell is sound."""

    cell: str
    pattern: str | None = None
    cast: str | None = None

    def fails(self, cell: Column) -> Column:
        text = blank_clean(cell)
        bad = F.lit(False)
        if self.pattern:
            bad = bad | ~text.rlike(self.pattern)
        if self.cast:
            bad = bad | text.try_cast(self.cast).isNull()
        return F.coalesce(text.isNotNull() & bad, F.lit(False))


# The cells of a dump line, and what its checked cells must look like.
DUMP_COLUMNS = (
    "processid", "bin_uri", "marker_code", "kingdom", "phylum", "class", "order", "family",
    "subfamily", "tribe", "genus", "species", "nuc", "collectors", "notes",
)
BIN_RULE = r"^(?i:BOLD):[A-Za-z]{3}[0-9]{4}$"
SPECIES_RULE = r"^[A-Z][a-z]{2,}( [A-Za-z0-9.\-]+){1,5}$"
DUMP_RULES = (Rule("bin_uri", BIN_RULE), Rule("species", SPECIES_RULE))


def split_cells(line: Column, width: int) -> Column:
    """struct(cells array<string>, n_cells int, broken boolean) of a tab-separated line.

    A cell that begins with a double quote runs to the next one that isn't
    doubled, tabs included; anything but a tab or the end behind that, or no
    such quote, breaks the line. Quotes elsewhere are ordinary. At most
    ``width`` + 1 cells are kept, all are counted, an open one too. A fold over the pieces
    between tabs, so that cells of any length need no backtracking.
    """
    pieces = F.split(line, "\t", -1)
    start = F.struct(
        F.array().cast("array<string>").alias("cells"),
        F.lit(0).alias("n_cells"),
        F.lit(False).alias("broken"),
        F.lit(None).cast("string").alias("held"),
    )

    def step(acc: Column, piece: Column) -> Column:
        inside = acc["held"].isNotNull()
        quoted = inside | piece.startswith('"')
        body = F.when(inside, piece).otherwise(piece.substr(F.lit(2), F.length(piece)))
        # Pairs are read from the left, so what remains single is the closing quote.
        plain = F.replace(F.replace(body, F.lit("\u0000"), F.lit("\u0000a")), F.lit('""'), F.lit("\u0000b"))
        at = F.instr(plain, '"')
        closes = at == F.length(plain)
        ends = quoted & (at > 0) & closes
        breaks = quoted & (at > 0) & ~closes
        kept = F.when(ends, plain.substr(F.lit(1), F.length(plain) - 1)).otherwise(plain)
        text = F.replace(F.replace(kept, F.lit("\u0000b"), F.lit('"')), F.lit("\u0000a"), F.lit("\u0000"))
        whole = F.when(inside, F.concat(acc["held"], F.lit("\t"), text)).otherwise(text)
        cell = F.when(quoted, whole).otherwise(piece)
        complete = ~quoted | ends | breaks
        return F.struct(
            F.when(complete & (acc["n_cells"] <= width), F.array_append(acc["cells"], cell)).otherwise(acc["cells"]).alias("cells"),
            (acc["n_cells"] + complete.cast("int")).alias("n_cells"),
            (acc["broken"] | breaks).alias("broken"),
            F.when(quoted & (at == 0), whole).alias("held"),
        )

    folded = F.aggregate(
        pieces,
        start,
        step,
        lambda acc: F.struct(
            acc["cells"].alias("cells"), (acc["n_cells"] + acc["held"].isNotNull().cast("int")).alias("n_cells"), (acc["broken"] | acc["held"].isNotNull()).alias("broken")
        ),
    )
    simple = F.struct(pieces.alias("cells"), F.size(pieces).alias("n_cells"), F.lit(False).alias("broken"))
    return F.when(line.startswith('"') | line.contains('\t"'), folded).otherwise(simple)


def parse_lines(lines: DataFrame, columns: Sequence[str] = DUMP_COLUMNS, rules: Sequence[Rule] = DUMP_RULES) -> DataFrame:
    """Each line with its cells as nullable text and ``errors``, an array of (reason, cell) of all that fails.

    In order: ``quoting``, ``columns`` (not as many cells as ``columns``), and
    ``value`` with the cell's name for each rule that fails, which is asked only
    where the number of cells is right. One carriage return at the end isn't
    part of the line. A null line has no cells, so it fails by ``columns``; an
    empty line is one empty cell. Cells of failed quoting or columns are null.
    Input columns other than line_no, source_file and raw_line are dropped, so
    none can clash with a cell's name. A generator binds the split line once,
    so neither cells nor filters on ``errors`` split it again.
    """
    line = F.coalesce(F.regexp_replace("raw_line", r"\r\z", ""), F.lit(""))
    names = list(columns)

    def checked(p: Column) -> Column:
        fits = (p["n_cells"] == len(names)) & F.col("raw_line").isNotNull()
        cell = {name: F.try_element_at(p["cells"], F.lit(i + 1)) for i, name in enumerate(names)}
        error = lambda reason, name=None: F.struct(F.lit(reason).alias("reason"), F.lit(name).cast("string").alias("cell"))
        failed = F.array(
            F.when(p["broken"], error("quoting")),
            F.when(~fits, error("columns")),
            *[F.when(fits & r.fails(cell[r.cell]), error("value", r.cell)) for r in rules if r.cell in cell],
        )
        return F.struct(
            *[F.when(fits & ~p["broken"], c).alias(f"cell_{n}") for n, c in cell.items()], F.filter(failed, lambda e: e.isNotNull()).alias("errors")
        )

    parsed = bind(line, lambda text: bind(split_cells(text, len(names)), checked))
    return lines.select("line_no", "source_file", "raw_line", F.inline(F.array(parsed)))


def sound_rows(parsed: DataFrame) -> DataFrame:
    """Lines without an error as typed columns; placeholders become null."""
    cells = [c for c in parsed.columns if c.startswith("cell_")]
    return parsed.where(F.size("errors") == 0).select("line_no", *[blank_clean(F.col(c)).alias(c[5:]) for c in cells])


def failed_rows(parsed: DataFrame) -> DataFrame:
    """Lines with an error: the first reason, all reasons with their cells, and the line as it came."""
    return parsed.where(F.size("errors") > 0).select(
        "line_no", "source_file", F.element_at("errors", 1)["reason"].alias("reason"), "errors", "raw_line"
    )
