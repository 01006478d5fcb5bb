import pytest
from pyspark.sql import functions as F

from cladeflow.operators.tree import fill_root, lca, lineage_strings, lineages, merge_names, merge_nodes, rank_lookup
from cladeflow.sources.hierarchies import parse_newick

BACTERIA = [("1", "1", None), ("2", "1", "superkingdom"), ("1224", "2", "phylum"), ("1236", "1224", "class"), ("28211", "1224", "class"), ("32066", "2", "phylum"), ("2157", "1", "superkingdom")]


def nodes(spark, rows):
    return spark.createDataFrame([(*r, None)[:3] for r in rows], "id string, parent string, rank string")


def tree(df):
    return {r.id: r.parent for r in df.collect()}


@pytest.mark.parametrize(("given", "want"), [
    ([("2", "2"), ("3", "3"), ("4", "2")], {"1": "1", "2": "1", "3": "1", "4": "2"}),
    ([("1", None), ("2", None), ("3", "1"), ("4", "2"), ("5", "2")], {"6": "6", "1": "6", "2": "6", "3": "1", "4": "2", "5": "2"}),
    ([("a", "top"), ("b", "top")], {"a": "top", "b": "top", "top": "top"}),
    ([("a", None), ("b", "a")], {"a": "a", "b": "a"}),
    ([], {}),
])
def test_fill_root(spark, given, want):
    assert tree(fill_root(nodes(spark, given))) == want


def test_cycle(spark):
    with pytest.raises(ValueError):
        fill_root(nodes(spark, [("a", "b"), ("b", "a")]))
    for small in (0, 100):
        with pytest.raises(ValueError):
            lineages(fill_root(nodes(spark, [("r", "r"), ("a", "b"), ("b", "c"), ("c", "a")])), small)


def test_lca(spark):
    lined = lineages(nodes(spark, BACTERIA))
    cases = {"a": ["1236", "32066"], "b": ["1236", "2157"], "c": ["1236", "1224"], "d": ["1236", "nope"], "e": ["28211"], "f": ["1236", "28211"]}
    groups = spark.createDataFrame([(k, x) for k, v in cases.items() for x in v], "q string, subject string")
    assert {r.q: r.lca for r in lca(groups, lined, ["q"]).collect()} == {"a": "2", "b": "1", "c": "1224", "d": None, "e": "28211", "f": "1224"}


def test_deep_tree(spark):
    n = 300
    for small in (10, 1000):
        lined = lineages(nodes(spark, [(f"n{i}", f"n{max(0, i - 1)}") for i in range(n)]), small)
        assert lined.filter(F.col("id") == f"n{n - 1}").first().lineage == [f"n{i}" for i in range(n)]


def test_lineage_and_ranks(spark):
    lined = lineages(nodes(spark, BACTERIA))
    names = spark.createDataFrame([("2", "Bacteria"), ("1224", "Proteobacteria")], "id string, name string")
    plain = {r.id: r.Lineage for r in lineage_strings(lined).collect()}
    assert plain["1236"] == "2;1224" and plain["2"] == "" and plain["1"] == ""
    assert {r.id: r.Lineage for r in lineage_strings(lined, names, include_self=True, include_root=True).collect()}["1236"] == "1;Bacteria;Proteobacteria;1236"
    got = {(r.subject, r["rank"]): r.taxon for r in rank_lookup(lined, ["phylum", "class"]).collect()}
    assert got == {("1224", "phylum"): "1224", ("1236", "phylum"): "1224", ("28211", "phylum"): "1224", ("32066", "phylum"): "32066", ("1236", "class"): "1236", ("28211", "class"): "28211"}


def test_merge(spark):
    a, b = nodes(spark, [("x", "p"), ("y", None, "genus")]), nodes(spark, [("x", None, "species"), ("z", "x")])
    assert sorted(map(tuple, merge_nodes(a, b).collect())) == [("x", "p", "species"), ("y", None, "genus"), ("z", "x", None)]
    with pytest.raises(Exception, match="Conflicting"):
        merge_nodes(a, nodes(spark, [("x", "q")])).collect()
    n = spark.createDataFrame([("x", "one")], "id string, name string")
    with pytest.raises(Exception, match="Conflicting"):
        merge_names(n, n.withColumn("name", F.lit("two"))).collect()


def test_newick():
    assert sorted(parse_newick("((a:1,b:2.5e-1)ab[&c]:0.1,'it''s c':3)root;"), key=str) == sorted([("a", "ab"), ("b", "ab"), ("ab", "root"), ("it's c", "root"), ("root", None)], key=str)
    for bad in ("((a,b),c)r;", "(a,a)r;", "((a,b)x;", "(a,b)x)y;"):
        with pytest.raises(ValueError):
            parse_newick(bad)
