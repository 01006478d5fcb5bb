"""The classification workflow, and hits from alignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import demultiplex, strip_suffix
from ..operators.assignment import assign_free, assign_none, assign_rank, distinct_hits
from ..operators.counting import count_taxa
from ..operators.intervals import match_genes
from ..operators.profiles import fraction, rounded, scale
from ..operators.tree import fill_root, lineages, merge_names, merge_nodes, rank_lookup
from ..session import small_side
from ..sources.files import rank_of_name
from ..sources.hierarchies import map_nodes, read_columns, read_lineages, read_names, read_newick, read_nodes
from ..sources.mappings import read_first_map


@dataclass
class Hierarchy:
    """lined: id, parent, rank, lineage; names: id, name (None if there are none)."""

    lined: DataFrame
    names: DataFrame | None = None


def build_hierarchy(spark: SparkSession, nodes: str | list[str] | None = None, newick: str | list[str] | None = None,
                    lineage: str | list[str] | None = None, columns: str | list[str] | None = None,
                    maps: list[str] = (), map_as_rank: bool | None = None, names: list[str] = ()) -> Hierarchy | None:
    """Nodes of all the given files together, with a root. Maps lend their targets the rank that
    their file's name stands for, by default if nothing but maps is given."""
    several = lambda x: [x] if isinstance(x, str) else x or []
    found = [read(spark, path) for read, paths in ((read_nodes, nodes), (read_newick, newick), (read_lineages, lineage), (read_columns, columns)) for path in several(paths)]
    if map_as_rank is None:
        map_as_rank = not found
    for path in maps:
        found.append(map_nodes(read_first_map(spark, path), rank_of_name(path) if map_as_rank else None))
    named = merge_names(*[read_names(spark, p) for p in names]) if names else None
    if not found:
        return None
    return Hierarchy(lineages(fill_root(merge_nodes(*found))), named)


def make_hits(alignments: DataFrame, demux: bool = False, samples: list[str] | None = None, exclude: DataFrame | None = None,
              trim: str | None = None, genes: DataFrame | None = None, overlap: int = 80) -> DataFrame:
    """sample, query, subject of alignments with the same columns (and length, beg, end where ``genes`` are given).

    In this order: queries with a subject in ``exclude`` are dropped; reads are matched to genes;
    query ids are cut into sample and read; samples are selected; subjects lose their suffix.
    """
    from ..sources.alignments import drop_excluded

    rows = alignments
    if exclude is not None:
        rows = drop_excluded(rows, exclude, ("sample", "query"))
    if genes is not None:
        rows = match_genes(rows, genes, overlap / 100)
    if demux:
        sample, read = demultiplex(F.col("query"))
        rows = rows.withColumn("_s", sample).withColumn("query", read).withColumn("sample", F.col("_s")).drop("_s")
    if samples:
        rows = rows.filter(F.col("sample").isin(samples))
    if trim:
        rows = rows.withColumn("subject", strip_suffix(F.col("subject"), trim))
    return distinct_hits(rows)


def assign(hits: DataFrame, rank: str, hierarchy: Hierarchy | None = None, uniq: bool = False, major: int | None = None, above: bool = False, subok: bool = False) -> DataFrame:
    if rank == "none" or hierarchy is None:
        return assign_none(hits, uniq)
    if rank == "free":
        return assign_free(hits, small_side(hierarchy.lined), subok)
    return assign_rank(hits, small_side(rank_lookup(hierarchy.lined, [rank])), major, above, uniq, small_side(hierarchy.lined) if above else None)


def check_ranks(hierarchy: Hierarchy | None, ranks: list[str]) -> None:
    """Raises if a rank other than none and free isn't among the hierarchy's."""
    asked = {r for r in ranks if r not in ("none", "free")}
    have = set() if hierarchy is None or not asked else {r[0] for r in hierarchy.lined.filter(F.col("rank").isin(list(asked))).select("rank").distinct().collect()}
    if asked - have:
        raise ValueError(f"Ranks not found in the hierarchy: {', '.join(sorted(asked - have))}.")


def classify(hits: DataFrame, hierarchy: Hierarchy | None = None, ranks: list[str] | None = None, uniq: bool = False, major: int | None = None, above: bool = False,
             subok: bool = False, sizes: DataFrame | None = None, strata: DataFrame | None = None, unassigned: bool = False, frac: bool = False,
             factor: str | float | None = None, digits: int | None = None) -> DataFrame:
    """Profiles at one or more ranks: rank, sample, feature, value (features as stratum|taxon with ``strata``).

    Ranks of the hierarchy are counted together in one pass over the hits; none and free are
    passes of their own. Values become fractions, are scaled and rounded, in this order.
    """
    ranks = ranks or (["free"] if hierarchy else ["none"])
    sizes = None if sizes is None else small_side(sizes.select("subject", "size"))
    check_ranks(hierarchy, ranks)
    fixed, out = [r for r in ranks if r not in ("none", "free")], []
    if len(fixed) > 1:
        lookup = small_side(rank_lookup(hierarchy.lined, fixed))
        assigned = assign_rank(hits, lookup, major, above, uniq, small_side(hierarchy.lined) if above else None, ("rank",), fixed)
        out.append(count_taxa(assigned, sizes, strata, unassigned, ("rank",)))
    for rank in ranks if len(fixed) < 2 else [r for r in ranks if r not in fixed]:
        one = count_taxa(assign(hits, rank, hierarchy, uniq, major, above, subok), sizes, strata, unassigned)
        out.append(one.withColumn("rank", F.lit(rank)))
    profile = out[0]
    for more in out[1:]:
        profile = profile.unionByName(more)
    if strata is not None:
        profile = profile.withColumn("feature", F.concat_ws("|", "stratum", "feature")).drop("stratum")
    if frac:
        profile = fraction(profile, ("rank", "sample"))
    if factor:
        profile = scale(profile, factor)
    return rounded(profile, digits).select("rank", "sample", "feature", "value")
