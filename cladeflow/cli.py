"""Command line: classify, collapse, normalize, filter, merge and coverage."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import sinks
from .operators import profiles as P
from .operators.counting import read_map
from .operators.intervals import cover_ranges, with_offsets
from .operators.tree import lineage_strings
from .plans.workflow import assign, build_hierarchy, classify, make_hits
from .session import session
from .sources.alignments import read_alignments
from .sources.files import files_of_directory, first_line, read_ids, resolve_inputs
from .sources.hierarchies import read_names
from .sources.mappings import gene_lengths, read_genes, read_groups, read_many_map, read_sizes, read_strata
from .sources.tables import Table, describe, name_as_id, read_table


def _at_least_one(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("1 or more is asked for")
    return int(text)


def _hundredths(text: str) -> float:
    if not 1 <= float(text) <= 100:
        raise argparse.ArgumentTypeError("1 to 100 is asked for")
    return float(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeflow", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, several: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("-i", "--input", required=True, action="append" if several else "store")
        p.add_argument("-o", "--output", required=True)
        return p

    c = command("classify", _classify)
    c.add_argument("-f", "--format", choices=["sam", "b6o", "paf", "map"])
    for flag in ("-e/--filext", "-s/--samples", "-x/--exclude", "-r/--rank", "-c/--coords",
                 "-t/--stratify", "-z/--sizes", "--scale", "-u/--outmap", "--outcov"):
        c.add_argument(*flag.split("/"))
    for flag in ("--nodes", "--newick", "--lineage", "--columns"):
        c.add_argument(flag, action="append", default=[])
    c.add_argument("--trim-sub", nargs="?", const="_")
    c.add_argument("-m", "--map", action="append", default=[])
    c.add_argument("-n", "--names", action="append", default=[])
    for yes, no in (("--demux", "--no-demux"), ("--map-as-rank", "--map-no-rank"), ("--to-parquet", "--to-tsv")):
        c.add_argument(yes, dest=yes[2:].replace("-", "_"), action="store_true", default=None)
        c.add_argument(no, dest=yes[2:].replace("-", "_"), action="store_false", default=None)
    for flag in ("--uniq", "--above", "--subok", "--frac", "--unassigned", "--name-as-id", "--add-rank", "--add-lineage"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--major", type=int, choices=range(51, 100), metavar="51-99")
    c.add_argument("--overlap", type=int, default=80, choices=range(1, 101), metavar="1-100")
    c.add_argument("--digits", type=int, choices=range(11), metavar="0-10")
    c.add_argument("--zipmap", default="gzip", choices=["none", "gzip", "gz", "bzip2", "bz2", "deflate"])
    for flag in ("--chunk", "--cache"):  # of no meaning here
        c.add_argument(flag, type=int)
    c.add_argument("--no-exe", action="store_true")
    c.add_argument("--cov-fmt", default="bed")

    p = command("collapse", _collapse)
    for flag in ("-m/--map", "-n/--names", "--sep"):
        p.add_argument(*flag.split("/"))
    p.add_argument("-f", "--field", type=int)
    p.add_argument("-d", "--divide", action="store_true")
    p.add_argument("-e", "--nested", action="store_true")
    p = command("normalize", _normalize)
    p.add_argument("-z", "--sizes")
    p.add_argument("-s", "--scale")
    p.add_argument("-d", "--digits", type=int, choices=range(11), metavar="0-10")
    p = command("filter", _filter)
    p.add_argument("-c", "--min-count", type=_at_least_one)
    p.add_argument("-p", "--min-percent", type=float)
    command("merge", _merge, several=True)
    p = command("coverage", _coverage)
    p.add_argument("-m", "--map", required=True)
    p.add_argument("-n", "--names")
    p.add_argument("-t", "--threshold", type=_hundredths)
    p.add_argument("-c", "--count", action="store_true")
    return top


def _listed(spark, text: str | None) -> list[str] | None:
    import os

    if not text:
        return None
    return read_ids(spark, text) if os.path.isfile(text) else text.split(",")


def _stdin() -> str:
    """Standard input as a file; where executors don't share the driver's disk, give a file instead."""
    import shutil
    import sys
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".txt", prefix="stdin-", delete=False) as f:
        shutil.copyfileobj(sys.stdin, f)
    return f.name


def _strata_files(folder: str, samples: list[str] | None) -> dict[str, str]:
    found = files_of_directory(folder, None, samples)
    if samples and len(found) < len(samples):
        raise ValueError("Provided sample ids and stratification files are inconsistent.")
    return found


def _classify(spark, a) -> None:
    if a.coords and a.outcov:
        raise ValueError("Covered ranges are not available where reads are matched to genes.")
    if a.input == "-":
        a.input = _stdin()
        a.demux = a.demux is not False
        samples, files, demux = _listed(spark, a.samples), {a.input: None}, a.demux
    else:
        samples, files, demux = resolve_inputs(spark, a.input, a.filext, _listed(spark, a.samples), a.demux)
    tree = build_hierarchy(spark, a.nodes, a.newick, a.lineage, a.columns, a.map, a.map_as_rank, a.names)
    excluded = _listed(spark, a.exclude)
    bad = spark.createDataFrame([(x,) for x in excluded], "subject string") if excluded else None
    rows = read_alignments(spark, list(files), a.format, bool(a.coords or a.outcov), bad)
    of = spark.createDataFrame([(p, s or "") for p, s in files.items()], "path string, sample string")
    rows = rows.join(F.broadcast(of), "path").drop("path")  # one row per input file
    genes = read_genes(spark, a.coords) if a.coords else None
    hits = make_hits(rows, demux, samples if demux else None, None, a.trim_sub, genes, a.overlap)
    if a.outcov:
        sinks.write_ranges(with_offsets(cover_ranges(rows), a.cov_fmt), a.outcov)
    sizes = None
    if a.sizes == ".":
        if genes is None:
            raise ValueError("Gene coordinates are needed for sizes from coordinates.")
        sizes = gene_lengths(genes)
    elif a.sizes:
        sizes = read_sizes(spark, a.sizes)
    strata = read_strata(spark, _strata_files(a.stratify, samples)) if a.stratify else None
    ranks = a.rank.split(",") if a.rank else (["free"] if tree else ["none"])
    hits = hits.persist()
    profile = classify(hits, tree, ranks, a.uniq, a.major, a.above, a.subok, sizes, strata, a.unassigned, a.frac, a.scale, a.digits)
    names = tree.names if tree else None
    wanted = [names if names is not None and not a.name_as_id else None, tree.lined if tree and a.add_rank else None,
              lineage_strings(tree.lined, names if a.name_as_id else None) if tree and a.add_lineage else None]
    metadata = describe(profile, *wanted) if any(x is not None for x in wanted) else None
    if a.name_as_id and names is not None:
        profile = name_as_id(profile, names)
    if not demux:
        samples = samples or None
    sinks.write_ranked(profile, a.output, ranks, samples, metadata, "parquet" if a.to_parquet else "tsv")
    if a.outmap:
        for rank in ranks:
            folder = a.outmap if len(ranks) == 1 else f"{a.outmap}/{rank}"
            sinks.write_read_map(read_map(assign(hits, rank, tree, a.uniq, a.major, a.above, a.subok), names), folder, {"gz": "gzip", "bz2": "bzip2"}.get(a.zipmap, a.zipmap))
    hits.unpersist()


def _named(spark, profile, names):
    return describe(profile, read_names(spark, names)) if names else None


def _collapse(spark, a) -> None:
    t = read_table(spark, a.input)
    if a.map:
        out = P.collapse(t.profile, read_many_map(spark, a.map), a.divide, a.field, a.sep, a.nested)
    else:
        out = P.clip(t.profile, a.field, a.sep, a.nested)
    out = P.rounded(out, t.digits)
    sinks.write_profile(out, a.output, t.samples, _named(spark, out, a.names))


def _normalize(spark, a) -> None:
    t, sizes = read_table(spark, a.input), None
    if a.sizes:
        head = first_line(spark, a.sizes)
        sizes = gene_lengths(read_genes(spark, a.sizes)) if head and head[0] in ">#" else read_sizes(spark, a.sizes)
    out = P.normalize(t.profile, sizes, a.scale, t.digits if a.digits is None else a.digits)
    _write(a, t, out)


def _filter(spark, a) -> None:
    t = read_table(spark, a.input)
    _write(a, t, P.filter_profile(t.profile, a.min_count, a.min_percent))


def _write(a, t: Table, out) -> None:
    sinks.write_profile(out, a.output, t.samples, t.metadata if len(t.metadata.columns) > 1 else None)


def _merge(spark, a) -> None:
    import os

    paths = [p for x in a.input for p in (sorted(files_of_directory(x).values()) if os.path.isdir(x) and not x.endswith(".parquet") else [x])]
    if len(paths) < 2:
        raise ValueError("Please provide two or more profiles.")
    tables = [read_table(spark, p) for p in paths]
    out = P.rounded(P.merge(*[t.profile for t in tables]), max(t.digits for t in tables))
    described = [t.metadata for t in tables if len(t.metadata.columns) > 1]
    metadata = P.merge_metadata(*described) if described else None
    sinks.write_profile(out, a.output, sorted({s for t in tables for s in t.samples}), metadata)


def _coverage(spark, a) -> None:
    t = read_table(spark, a.input)
    samples = spark.createDataFrame([(s,) for s in t.samples], "sample string")
    out = P.group_coverage(t.profile, read_groups(spark, a.map), samples, a.threshold, a.count)
    sinks.write_profile(out, a.output, t.samples, _named(spark, out, a.names))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
