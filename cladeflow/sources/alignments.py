"""Alignment files: SAM, BLAST tabular (b6o), PAF and plain maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cigar_lengths
from .files import first_line, read_lines

FORMATS = ("sam", "b6o", "paf", "map")
EXTENDED = ["query", "subject", "score", "length", "beg", "end"]


#: Fixed values of the formats: fewest columns, which of them (from 0) hold digits, and which a strand.
LAYOUTS = {
    "b6o": (12, (3, 4, 5, 6, 7, 8, 9), ()),
    "paf": (12, (1, 2, 3, 6, 7, 8, 9, 10, 11), (4,)),
    "sam": (11, (1, 3, 4), ()),
}


def _shape(least: int, digits: tuple[int, ...], strands: tuple[int, ...]) -> re.Pattern:
    cells = ["[0-9]+" if i in digits else "[+-]" if i in strands else r"[^\t]*" for i in range(least)]
    return re.compile(r"\t".join(cells) + r"(?:\t.*)?")


#: Shapes of a first line, in the order of trial: a SAM header, a plain map, rows of the layouts.
SHAPES = [("sam", re.compile(r"@[A-Z]{2}(?:\t.*)?")), ("map", re.compile(r"[^\t]*\t[^\t]*")), *((kind, _shape(*x)) for kind, x in LAYOUTS.items())]


def infer_format(line: str | None) -> str:
    """Format of a file by its first line."""
    text = (line or "").rstrip()
    if not text:
        raise ValueError("There is no first line to tell the alignment format by.")
    for kind, shape in SHAPES:
        if shape.fullmatch(text):
            return kind
    raise ValueError(f"No alignment format has such a first line: {text[:80]!r}.")


def parse(lines: DataFrame, kind: str, extended: bool = False) -> DataFrame:
    """Columns path, base, query, subject and, if ``extended``, score, length, beg, end (0-based, half-open).

    ``base`` is the query without its mate: what exclusion goes by.
    """
    if kind not in FORMATS:
        raise ValueError(f"Unknown alignment format: {kind}.")
    if kind == "map" and extended:
        raise ValueError("A plain map has no coordinates.")
    return {"sam": _sam, "b6o": _b6o, "paf": _paf, "map": _map}[kind](lines.withColumn("f", F.split("line", "\t")), extended)


def _f(i: int) -> Column:
    return F.get("f", i)


def _out(df: DataFrame, query: Column, subject: Column, extra: dict[str, Column] | None, base: Column | None = None) -> DataFrame:
    columns = [F.col("path"), (query if base is None else base).alias("base"), query.alias("query"), subject.alias("subject")]
    return df.select(*columns, *[c.alias(n) for n, c in (extra or {}).items()])


def _sam(df: DataFrame, extended: bool) -> DataFrame:
    """Unmapped records are skipped; FLAG bits 6 and 7 give the mate, /1 or /2; both at once are an error."""
    rows = df.filter(~F.col("line").rlike(r"^@[A-Z]{2}(\t|$)") & (F.size("f") > 2)).filter(_f(2) != "*")
    mate = F.shiftright(_f(1).cast("int"), 6).bitwiseAND(3)
    suffix = F.when(mate == 0, "").when(mate == 1, "/1").when(mate == 2, "/2").otherwise(F.raise_error(F.concat(F.lit("Both mate bits are set: "), _f(0))).cast("string"))
    extra = None
    if extended:
        aligned, span = cigar_lengths(_f(5))
        beg = _f(3).cast("long") - 1
        extra = {"score": F.lit(None).cast("double"), "length": aligned, "beg": beg, "end": beg + span}
    return _out(rows, F.concat(_f(0), suffix), _f(2), extra, _f(0))


def _b6o(df: DataFrame, extended: bool) -> DataFrame:
    extra = None
    if extended:
        a, b = _f(8).cast("long"), _f(9).cast("long")
        extra = {"score": _f(11).cast("double"), "length": _f(3).cast("long"), "beg": F.least(a, b) - 1, "end": F.greatest(a, b)}
    return _out(df.filter(F.size("f") >= (12 if extended else 3)), _f(0), _f(1), extra)


def _paf(df: DataFrame, extended: bool) -> DataFrame:
    rows, extra = df.filter(F.size("f") >= (12 if extended else 7)), None
    if extended:
        number = lambda i: F.trim(_f(i)).try_cast("long")
        rows = rows.filter(number(7).isNotNull() & number(8).isNotNull() & number(10).isNotNull() & number(11).isNotNull())
        extra = {"score": number(11).cast("double"), "length": number(10), "beg": number(7), "end": number(8)}
    return _out(rows, _f(0), _f(5), extra)


def _map(df: DataFrame, extended: bool) -> DataFrame:
    return _out(df.filter(F.size("f") >= 2), _f(0), F.rtrim(_f(1)), None)


def read_alignments(spark: SparkSession, paths: str | list[str], kind: str | None = None, extended: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    """Alignments of the files: path, query, subject and, if ``extended``, score, length, beg, end.

    The format of each file is inferred by its first line unless given. Queries with any subject
    in ``exclude`` (subject) are dropped whole, with all their mates.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(kind or infer_format(first_line(spark, p)), []).append(p)
    out = None
    for k, some in kinds.items():
        part = parse(read_lines(spark, some), k, extended)
        out = part if out is None else out.unionByName(part)
    if exclude is not None:
        out = drop_excluded(out, exclude)
    return out.drop("base")


def drop_excluded(alignments: DataFrame, exclude: DataFrame, keys: tuple[str, ...] = ("path", "base")) -> DataFrame:
    """Alignments of the queries none of whose subjects is in ``exclude`` (subject)."""
    bad = alignments.join(exclude.select("subject").distinct(), "subject", "left_semi").select(*keys).distinct()
    return alignments.join(bad, list(keys), "left_anti")
