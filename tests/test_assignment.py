import pytest
from pyspark.sql import functions as F

from cladeflow import session
from cladeflow.operators.assignment import assign_free, assign_rank, distinct_hits
from cladeflow.operators.counting import count_taxa, read_map
from cladeflow.operators.tree import fill_root, lineages, rank_lookup
from cladeflow.plans.workflow import Hierarchy, assign, classify

TREE = [("G1", "T1", None), ("G2", "T1", None), ("G3", "T2", None), ("T1", "T0", "general"), ("T2", "T0", "general")]


@pytest.fixture(scope="module")
def tree(spark):
    return Hierarchy(lineages(fill_root(spark.createDataFrame(TREE, "id string, parent string, rank string"))))


def hits(spark, queries):
    return spark.createDataFrame([("S", q, s) for q, subs in queries.items() for s in subs], "sample string, query string, subject string")


def taxa(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query, set() if r.unique else []).__getattribute__("add" if r.unique else "append")(r.taxon)
    return {q: next(iter(x)) if isinstance(x, set) else sorted(x, key=str) for q, x in out.items()}


QUERIES = {"a": ["G1", "G2"], "b": ["G1", "G2", "G3"], "c": ["G1"], "d": ["Gx"], "e": ["G3", "Gx"], "f": ["G2", "G3"]}


def test_free(spark, tree):
    h = hits(spark, QUERIES)
    assert taxa(assign(h, "free", tree)) == {"a": "T1", "b": None, "c": "T1", "d": None, "e": None, "f": None}
    assert taxa(assign(h, "free", tree, subok=True)) == {"a": "T1", "b": None, "c": "G1", "d": "Gx", "e": None, "f": None}


@pytest.mark.parametrize(("options", "b", "e", "f"), [
    ({}, ["T1", "T1", "T2"], [None, "T2"], ["T1", "T2"]), ({"uniq": True}, None, None, None), ({"major": 60}, "T1", None, None), ({"major": 80}, None, None, None), ({"above": True}, None, None, None)])
def test_rank(spark, tree, options, b, e, f):
    assert taxa(assign(hits(spark, QUERIES), "general", tree, **options)) == {"a": "T1", "b": b, "c": "T1", "d": None, "e": e, "f": f}


def test_above_below_the_root(spark):
    rows = [*TREE[:3], ("T1", "T0", "general"), ("T2", "T0", "general"), ("T0", "R", None), ("R", "R", None)]
    h = Hierarchy(lineages(spark.createDataFrame(rows, "id string, parent string, rank string")))
    assert taxa(assign(hits(spark, QUERIES), "general", h, above=True)) == {"a": "T1", "b": "T0", "c": "T1", "d": None, "e": None, "f": "T0"}


def test_none(spark):
    queries = {"1": ["G1"], "2": ["G1", "G2"], "3": ["G2", "G3"]}
    value = lambda df: {r.feature: r.value for r in df.collect()}
    h = hits(spark, queries)
    assert value(count_taxa(assign(h, "none"))) == {"G1": 1.5, "G2": 1.0, "G3": 0.5}
    assert value(count_taxa(assign(h, "none", uniq=True), unassigned=True)) == {"G1": 1.0, "Unassigned": 2.0}


ASSIGNED = [("1", "G1", "Ecoli", True), ("2", "G2", "Cdiff", False), ("2", "G3", "Strep", False),
            ("3", "G3", "Strep", False), ("3", "G4", "Ecoli", False), ("3", "G5", "Cdiff", False), ("3", "G6", "Ecoli", False), ("3", "G7", None, False),
            ("4", "G4", "Ecoli", True), ("4", "G6", "Ecoli", True), ("5", "G7", None, True)]


def test_counters(spark):
    df = spark.createDataFrame([("S", *r) for r in ASSIGNED], "sample string, query string, subject string, taxon string, unique boolean")
    value = lambda d: {r.feature: round(r.value, 9) for r in d.collect()}
    assert value(count_taxa(df)) == {"Ecoli": 2.5, "Cdiff": 0.75, "Strep": 0.75}
    lengths = {"G1": 5, "G2": 5, "G3": 6, "G4": 9, "G5": 2, "G6": 4}
    sizes = spark.createDataFrame([(k, 1 / v) for k, v in lengths.items()], "subject string, size double")
    assert value(count_taxa(df, sizes)) == {"Ecoli": 14.75, "Cdiff": 3.0, "Strep": 4.5}
    strata = spark.createDataFrame([("S", "1", "A"), ("S", "2", "A"), ("S", "3", "B"), ("S", "9", "B")], "sample string, query string, stratum string")
    by = {(r.stratum, r.feature): round(r.value, 9) for r in count_taxa(df, None, strata).collect()}
    assert by == {("A", "Ecoli"): 1, ("A", "Cdiff"): 0.5, ("A", "Strep"): 0.5, ("B", "Strep"): 0.25, ("B", "Ecoli"): 0.5, ("B", "Cdiff"): 0.25}
    with pytest.raises(Exception, match="without a size"):
        count_taxa(df, sizes.filter("subject <> 'G5'")).collect()
    rows = {r.query: r.taxa for r in read_map(df).collect()}
    assert rows == {"1": "Ecoli", "2": "Cdiff:1\tStrep:1", "3": "Ecoli:2\tCdiff:1\tStrep:1", "4": "Ecoli"}


def test_values_sum_to_queries(spark, tree):
    h = hits(spark, QUERIES)
    got = classify(h, tree, ["general", "free", "none"], unassigned=True, digits=6)
    sums = {r["rank"]: r["n"] for r in got.groupBy("rank").agg(F.sum("value").alias("n")).collect()}
    assert all(x == pytest.approx(len(QUERIES), abs=1e-5) for x in sums.values()) and len(sums) == 3
    with pytest.raises(ValueError, match="not found"):
        classify(h, tree, ["species"])


def test_tasks_grow_with_the_input(spark, tree, tmp_path, monkeypatch):
    """What a task holds stays the same: rows are dealt by the size of their files, also after a join with a table that isn't small."""
    rows = spark.range(4000).selectExpr("'S' sample", "string(id div 4) query", "concat('G', 1 + id % 4) subject")
    rows.write.parquet(f"{tmp_path}/hits")
    found = spark.read.parquet(f"{tmp_path}/hits")
    n = -(-session.input_bytes(found) // 500)
    monkeypatch.setattr(session, "TASK_BYTES", 500)
    dealt = distinct_hits(found)
    assert dealt.rdd.getNumPartitions() == n > 4
    for most in (0, 100):
        free = assign_free(dealt, session.small_side(tree.lined, most))
        assert free.rdd.getNumPartitions() >= n
        ranked = assign_rank(dealt, session.small_side(rank_lookup(tree.lined, ["general"]), most))
        assert ranked.rdd.getNumPartitions() >= n
        got = {(r.feature, round(r.value, 6)) for r in count_taxa(ranked).collect()}
        assert got == {("T1", round(2000 / 3, 6)), ("T2", round(1000 / 3, 6))}  # the nearest of the rank; G4 is no node
        assert {(r.taxon, r.n) for r in free.groupBy("taxon").agg(F.count("*").alias("n")).collect()} == {(None, 4000)}
