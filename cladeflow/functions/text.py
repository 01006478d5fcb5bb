"""String functions on identifiers and CIGAR strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def demultiplex(query: Column, sep: str = "_") -> tuple[Column, Column]:
    """Sample and read of a query id, cut at the first separator.

    Without a separator, or with nothing behind it, the sample is '' and the read is what stands
    before the separator.
    """
    at = F.locate(sep, query)
    left = F.when(at > 0, F.substring(query, F.lit(1), at - 1)).otherwise(query)
    right = F.when(at > 0, F.substring(query, at + len(sep), F.length(query))).otherwise(F.lit(""))
    whole = right != ""
    return F.when(whole, left).otherwise(F.lit("")), F.when(whole, right).otherwise(left)


def strip_suffix(subject: Column, sep: str = "_") -> Column:
    """What stands before the last separator; all of it without one."""
    parts = F.split(subject, re.escape(sep))
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), sep)).otherwise(subject)


def cigar_lengths(cigar: Column) -> tuple[Column, Column]:
    """Aligned bases (M, =, X), and those with the deleted and skipped ones (D, N): the span on the subject."""
    def total(ops: str) -> Column:
        steps = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), 1)
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))

    aligned = total("M=X")
    return aligned, aligned + total("DN")


def feature_count(text: Column, sep: str = ":") -> tuple[Column, Column]:
    """'x:3' is x and 3; a text without a positive whole count behind the last separator counts once."""
    q = re.escape(sep)
    count = F.regexp_extract(text, rf"^.*{q}([1-9]\d*)$", 1).try_cast("long")
    name = F.when(count.isNotNull(), F.regexp_extract(text, rf"^(.*){q}[1-9]\d*$", 1)).otherwise(text)
    return name, F.coalesce(count, F.lit(1).cast("long"))


def last_value(values: Column) -> Column:
    """The last element that isn't null."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))
