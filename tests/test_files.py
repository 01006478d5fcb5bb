import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from cladeflow.cli import main
from cladeflow.sources import alignments as A
from cladeflow.sources import files as S
from cladeflow.sources import hierarchies as H
from cladeflow.sources import mappings as M
from cladeflow.sources.tables import read_table, split_header


def put(folder, name, text, opened=open):
    path = str(folder / name)
    with opened(path, "wt") as f:
        f.write(text)
    return path


@pytest.mark.parametrize(("name", "opened"), [("a.txt", open), ("a.txt.gz", gzip.open), ("a.txt.bz2", bz2.open), ("a.txt.xz", lzma.open), ("a.txt.gzip", gzip.open), ("a b+c.lzma", lzma.open)])
def test_lines(spark, tmp_path, name, opened):
    path = put(tmp_path, name, "one\ttwo\n\nthree\n", opened)
    rows = S.read_lines(spark, path).orderBy("block", "seq").collect()
    assert [r.line for r in rows] == ["one\ttwo", "", "three"] and {r.path for r in rows} == {path}


@pytest.mark.parametrize(("path", "rank"), [("/x/accession2taxid.txt.bz2", "taxid"), ("compound_2_reaction.txt", "reaction"), ("strain-to-species.map", "species"), ("you_and_i.txt", "you_and_i"), ("a2b2c", "a2b2c")])
def test_rank_of_name(path, rank):
    assert S.rank_of_name(path) == rank


def test_stem():
    assert S.stem("/a/S01.sam.gz") == "S01" and S.stem("S01.x.sam") == "S01.x" and S.stem("S01_R1.fq.gz", "_R1.fq.gz") == "S01"
    with pytest.raises(ValueError):
        S.stem("S01.sam", ".map")


def test_ids_and_inputs(spark, tmp_path):
    ids = put(tmp_path, "ids.txt", "# head\nS2\tx\n\nS1\n")
    assert S.read_ids(spark, ids) == ["S2", "S1"]
    for text in ("", "a\na\n"):
        with pytest.raises(ValueError):
            S.read_ids(spark, put(tmp_path, "bad.txt", text or "#\n"))
    folder = tmp_path / "in"
    folder.mkdir()
    paths = {s: put(folder, f"{s}.map", "q\tG1\n") for s in ("S1", "S2")}
    put(folder, ".hidden", "")
    assert S.resolve_inputs(spark, str(folder)) == (["S1", "S2"], {paths["S1"]: "S1", paths["S2"]: "S2"}, False)
    assert S.resolve_inputs(spark, str(folder), None, ["S2"]) == (["S2"], {paths["S2"]: "S2"}, False)
    with pytest.raises(ValueError):
        S.resolve_inputs(spark, str(folder), None, ["S2", "S9"])
    listed = put(tmp_path, "list.tsv", "A\tin/S1.map\nB\t" + paths["S2"] + "\n")
    assert S.resolve_inputs(spark, listed) == (["A", "B"], {paths["S1"]: "A", paths["S2"]: "B"}, False)
    with pytest.raises(ValueError):
        S.files_of_manifest(spark, put(tmp_path, "broken.tsv", "A\tin/S1.map\nB\tnope\n"))
    assert S.resolve_inputs(spark, paths["S1"]) == (None, {paths["S1"]: None}, True)
    assert S.resolve_inputs(spark, paths["S1"], demux=False) == (["S1"], {paths["S1"]: "S1"}, False)
    put(folder, "S1.sam", "")
    with pytest.raises(ValueError, match="Ambiguous"):
        S.files_of_directory(str(folder))


B6O = "q1\tG1\t95\t20\t0\t0\t1\t20\t30\t11\t1e-5\t37.5\n"
PAF = "q1\t50\t0\t50\t+\tG1\t900\t100\t150\t45\t50\t60\n"
SAM = "@HD\tVN:1.0\n@SQ\tSN:G1\nr1\t77\tG1\t186\t0\t50M5I20M5D20M\t*\t0\t0\t*\t*\nr1\t141\tG2\t10\t0\t5M\t*\t0\t0\t*\t*\nr2\t0\tG3\t1\t0\t9M\t*\t0\t0\t*\t*\nr3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


@pytest.mark.parametrize(("line", "kind"), [(B6O, "b6o"), (PAF, "paf"), ("@HD\tVN:1.0", "sam"), ("@SQ\tSN:x", "sam"), (SAM.split("\n")[2], "sam"), ("q\tG1", "map")])
def test_infer(line, kind):
    assert A.infer_format(line) == kind


@pytest.mark.parametrize("line", ["", None, "a\tb\tc", "hello"])
def test_infer_fails(line):
    with pytest.raises(ValueError):
        A.infer_format(line)


def test_formats(spark, tmp_path):
    rows = lambda *a, **k: sorted(tuple(r)[1:] for r in A.read_alignments(spark, *a, **k).collect())
    sam = put(tmp_path, "x.sam", SAM)
    assert rows(sam) == [("r1/1", "G1"), ("r1/2", "G2"), ("r2", "G3")]
    assert rows(sam, extended=True) == [("r1/1", "G1", None, 90, 185, 280), ("r1/2", "G2", None, 5, 9, 14), ("r2", "G3", None, 9, 0, 9)]
    assert rows(sam, exclude=spark.createDataFrame([("G1",)], "subject string")) == [("r2", "G3")]
    assert rows(put(tmp_path, "x.b6o", B6O + "short\tG1\n"), extended=True) == [("q1", "G1", 37.5, 20, 10, 30)]
    assert rows(put(tmp_path, "x.paf", PAF + PAF.replace("\t45\t50", "\t45\tx")), extended=True) == [("q1", "G1", 60.0, 50, 100, 150)]
    assert rows(put(tmp_path, "x.map", "q1\tG1 \nq2\nq1\tG2\textra\n"), "map") == [("q1", "G1"), ("q1", "G2")]
    with pytest.raises(ValueError):
        A.read_alignments(spark, str(tmp_path / "x.map"), "map", True)
    with pytest.raises(Exception, match="mate"):
        A.read_alignments(spark, put(tmp_path, "y.sam", SAM.replace("\t77\t", "\t192\t"))).collect()


def test_hierarchies(spark, tmp_path):
    tree = lambda df: sorted((r.id, r.parent, r["rank"]) for r in df.collect())
    dmp = put(tmp_path, "nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\tx\t|\n")
    assert tree(H.read_nodes(spark, dmp)) == [("1", "1", "no rank"), ("2", "1", "phylum")]
    assert tree(H.read_nodes(spark, put(tmp_path, "n.txt", "a\tb\nb\tc\tgenus\n"))) == [("a", "b", None), ("b", "c", "genus")]
    names = put(tmp_path, "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n1\t|\tall\t|\t\t|\tsynonym\t|\n")
    assert [tuple(r) for r in H.read_names(spark, names).collect()] == [("1", "root")]
    columns = put(tmp_path, "ranks.tsv", "#id\tphylum\tclass\tgenus\nG1\tP1\t\tX\nG2\tP1\tC1\t0\nG3\t\tunassigned\t\n")
    assert tree(H.read_columns(spark, columns)) == [("C1", "P1", "class"), ("G1", "X", None), ("G2", "C1", None), ("G3", None, None), ("P1", None, "phylum"), ("X", "P1", "genus")]
    with pytest.raises(Exception, match="Conflict"):
        H.read_columns(spark, put(tmp_path, "bad.tsv", "#id\tphylum\tclass\nG1\tP1\tC1\nG2\tP2\tC1\n")).collect()
    lineages = put(tmp_path, "lin.txt", "G1\tk__B; p__F;c__; o__L;f__\nG2\tk__B;p__F\nG3\tk__A;unassigned\n")
    assert tree(H.read_lineages(spark, lineages)) == [
        ("G1", "k__B;p__F;c__;o__L", None), ("G2", "k__B;p__F", None), ("G3", "k__A", None), ("k__A", None, "kingdom"), ("k__B", None, "kingdom"),
        ("k__B;p__F", "k__B", "phylum"), ("k__B;p__F;c__;o__L", "k__B;p__F", "order")]
    assert tree(H.read_newick(spark, put(tmp_path, "t.nwk", "((a:1,b:2)ab,c)r;\n"))) == [("a", "ab", None), ("ab", "r", None), ("b", "ab", None), ("c", "r", None), ("r", None, None)]


def test_mappings(spark, tmp_path):
    path = put(tmp_path, "m.txt", "a\t1\nb\t1\t2\nc\na\t3\nb\t2\n")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(M.read_unique_map(spark, path)) == [("a", "3"), ("b", "2")]
    assert pairs(M.read_first_map(spark, path)) == [("a", "3"), ("b", "2")]
    assert pairs(M.read_groups(spark, put(tmp_path, "g.txt", "a\t1\t1\nb\t1\t2\na\t4\t5\n"))) == [("a", "4"), ("a", "5"), ("b", "1"), ("b", "2")]
    assert pairs(M.read_many_map(spark, path)) == [("a", "1"), ("a", "3"), ("b", "1"), ("b", "2"), ("b", "2")]
    with pytest.raises(ValueError):
        M.read_strata(spark, {"S": put(tmp_path, "s.txt", "a\tb\tc\n")})


def test_genes(spark, tmp_path):
    text = ">n1\ng1\t5\t384\ng2\t410\t933\ng3\t912\t638\ng4\t529\t75\n"
    got = {r.subject: r["size"] for r in M.gene_lengths(M.read_genes(spark, put(tmp_path, "c.txt", text))).collect()}
    assert got == {"g1": 380, "g2": 524, "g3": 275, "g4": 455}
    two = put(tmp_path, "d.txt", "## group\n# n1\ng1\t29\t5\n# n2\ng1\t1\t10\n# n1\ng1\t7\t8\n")
    assert sorted(map(tuple, M.read_genes(spark, two).collect())) == [("n1", "n1_g1", 6, 8), ("n2", "n2_g1", 0, 10)]
    with pytest.raises(Exception, match="Cannot extract"):
        M.read_genes(spark, put(tmp_path, "e.txt", ">n\ng\t1\n")).collect()


def test_table(spark, tmp_path):
    assert split_header(["S1", "Name", "S2", "Name", "Lineage"]) == (["S1", "Name", "S2"], ["Name", "Lineage"])
    t = read_table(spark, put(tmp_path, "t.tsv", "#FeatureID\tS1\tS2\tName\nG1\t4\t0.25\tone\nG2\t0\t3\n"))
    assert (t.samples, t.digits) == (["S1", "S2"], 2)
    assert sorted(map(tuple, t.metadata.collect())) == [("G1", "one"), ("G2", "")]
    for text in ("", "#FeatureID\tName\n"):
        with pytest.raises(ValueError):
            read_table(spark, put(tmp_path, "u.tsv", text))


def test_command_line(spark, tmp_path):
    folder = tmp_path / "al"
    folder.mkdir()
    put(folder, "S1.map", "a\tG1\nb\tG1\nb\tG2\nc\tG3\n")
    put(folder, "S2.map.xz", "a\tG3_9\n", lzma.open)
    nodes = put(tmp_path, "nodes.txt", "G1\tT1\nG2\tT1\nG3\tT2\nT1\tT0\tgenus\nT2\tT0\tgenus\n")
    names = put(tmp_path, "names.txt", "T1\tOne\nT2\tTwo\n")
    out = str(tmp_path / "o.tsv")
    main(["classify", "-i", str(folder), "-o", out, "--nodes", nodes, "-n", names, "-r", "genus", "--trim-sub", "_", "--add-lineage", "--add-rank", "-u", str(tmp_path / "maps"), "--zipmap", "none"])
    assert open(out).read() == "#FeatureID\tS1\tS2\tName\tRank\tLineage\nT1\t2\t0\tOne\tgenus\t\nT2\t1\t1\tTwo\tgenus\t\n"
    maps = sorted(line for p in (tmp_path / "maps" / "sample=S1").glob("part-*") for line in p.read_text().split("\n") if line)
    assert maps == ["a\tOne", "b\tOne", "c\tTwo"]
    main(["classify", "-i", str(folder), "-o", str(tmp_path / "many"), "--nodes", nodes, "-r", "none,genus", "--trim-sub", "_"])
    assert (tmp_path / "many" / "none.tsv").read_text() == "#FeatureID\tS1\tS2\nG1\t2\t0\nG3\t1\t1\n"
    m = put(tmp_path, "map.txt", "T1\tX\tY\nT2\tX\n")
    main(["collapse", "-i", out, "-o", str(tmp_path / "c.tsv"), "-m", m])
    assert (tmp_path / "c.tsv").read_text() == "#FeatureID\tS1\tS2\nX\t3\t1\nY\t2\t0\n"
    main(["normalize", "-i", out, "-o", str(tmp_path / "n.tsv"), "-s", "100"])
    assert (tmp_path / "n.tsv").read_text().split("\n")[1:3] == ["T1\t67\t0\tOne\tgenus\t", "T2\t33\t100\tTwo\tgenus\t"]
    main(["filter", "-i", out, "-o", str(tmp_path / "f.tsv"), "-c", "2"])
    assert (tmp_path / "f.tsv").read_text().split("\n")[1:] == ["T1\t2\t0\tOne\tgenus\t", ""]
    main(["merge", "-i", out, "-i", str(tmp_path / "c.tsv"), "-o", str(tmp_path / "g.tsv")])
    assert (tmp_path / "g.tsv").read_text().split("\n")[0] == "#FeatureID\tS1\tS2\tName\tRank\tLineage"
    main(["coverage", "-i", out, "-o", str(tmp_path / "v.tsv"), "-m", put(tmp_path, "grp.txt", "P\tT1\tT2\n")])
    assert (tmp_path / "v.tsv").read_text() == "#FeatureID\tS1\tS2\nP\t100\t50\n"


def test_command_line_genes(spark, tmp_path):
    put(tmp_path, "S.b6o", B6O)
    coords = put(tmp_path, "coords.txt", ">G1\ng1\t5\t40\ng2\t60\t90\n")
    main(["classify", "-i", str(tmp_path / "S.b6o"), "-o", str(tmp_path / "o.tsv"), "-c", coords, "-z", ".", "--scale", "1k", "--no-demux"])
    assert (tmp_path / "o.tsv").read_text() == "#FeatureID\tS\ng1\t28\n"
    main(["classify", "-i", str(tmp_path / "S.b6o"), "-o", str(tmp_path / "p.tsv"), "--outcov", str(tmp_path / "cov"), "--no-demux"])
    assert [line for p in (tmp_path / "cov" / "sample=S").glob("part-*") for line in p.read_text().split("\n") if line] == ["G1\t10\t30"]


def test_command_line_stdin_and_strata(spark, tmp_path, monkeypatch):
    import io
    import sys

    monkeypatch.setattr(sys, "stdin", io.StringIO("S1_a\tG1\nS1_b\tG1\nS2_a\tG2\n"))
    folder = tmp_path / "strata"
    folder.mkdir()
    put(folder, "S1.txt", "a\tX\nb\tY\n")
    put(folder, "S2.txt", "a\tX\n")
    main(["classify", "-i", "-", "-o", str(tmp_path / "o.tsv"), "-t", str(folder)])
    assert (tmp_path / "o.tsv").read_text() == "#FeatureID\tS1\tS2\nX|G1\t1\t0\nX|G2\t0\t1\nY|G1\t1\t0\n"


def test_stream(spark, tmp_path):
    from cladeflow.plans.workflow import classify
    from cladeflow.streaming.incremental import compact, profile_stream, stream_profile

    schema, source = "sample string, query string, subject string", tmp_path / "in"
    rows = [("S", f"q{i}", f"G{j}") for i in range(30) for j in range(i % 3 + 1)]
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.filter(f"int(substring(query, 2)) % 3 = {part}").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        profile_stream(stream, str(tmp_path / "state"), str(tmp_path / "check"), "none").awaitTermination()
    want = {r.feature: r.value for r in classify(df, digits=6).collect()}
    assert {r.feature: round(r.value, 6) for r in stream_profile(spark, str(tmp_path / "state")).collect()} == pytest.approx(want)
    compact(spark, str(tmp_path / "state"))
    assert {r.feature: round(r.value, 6) for r in stream_profile(spark, str(tmp_path / "state")).collect()} == pytest.approx(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_decimals_of_plain_forms(spark):
    from cladeflow.sources.tables import decimals

    want = {"12345678.5": 1, "0.00012345": 8, "10000000.0": 1, "0.00001": 5, "1.25": 2, "3": 0, "3.0": 1, "0.001": 3}
    got = spark.createDataFrame([(x,) for x in want], "x string").select("x", decimals(F.col("x")).alias("n"))
    assert {r.x: r.n for r in got.collect()} == want


def test_options_that_repeat_or_have_a_default():
    from cladeflow.cli import parser

    got = parser().parse_args("classify -i x -o y --nodes a --nodes b --trim-sub --chunk 5 --no-exe --zipmap gz".split())
    assert got.nodes == ["a", "b"] and got.trim_sub == "_" and got.zipmap == "gz" and got.columns == []
    assert parser().parse_args("classify -i x -o y --trim-sub .".split()).trim_sub == "."
    for wrong in ("coverage -i x -o y -m z -t 101", "filter -i x -o y -c 0"):
        with pytest.raises(SystemExit):
            parser().parse_args(wrong.split())
