import random

import pytest

from cladeflow.operators.intervals import count_genes, cover_ranges, match_genes, with_offsets

GENES = [("n1", "g1", 4, 29), ("n1", "g2", 32, 61), ("n1", "g3", 64, 94)]
READS = [(10, 29), (16, 35), (20, 39), (22, 41), (30, 49), (49, 30), (79, 60), (84, 65), (95, 82)]


def reads(spark, rows=READS):
    return spark.createDataFrame([("S", f"r{i + 1}", "n1", 20, min(r) - 1, max(r)) for i, r in enumerate(rows)], "sample string, query string, subject string, length long, beg long, end long")


@pytest.mark.parametrize(("th", "width", "more"), [(0.8, 4096, []), (0.8, 7, []), (0.5, 16, [("r2", "g1"), ("r3", "g1"), ("r7", "g3"), ("r9", "g3")])])
def test_match(spark, th, width, more):
    genes = spark.createDataFrame(GENES, "contig string, gene string, beg long, end long")
    got = {(r.query, r.subject) for r in match_genes(reads(spark), genes, th, width=width).collect()}
    assert got == {("r1", "g1"), ("r5", "g2"), ("r6", "g2"), ("r8", "g3"), *more}


def test_match_against_all_pairs(spark):
    rng = random.Random(3)
    genes = [("n1", f"g{i}", b := rng.randrange(5000), b + rng.randrange(1, 900)) for i in range(80)]
    rows = [("S", f"r{i}", "n1", rng.choice([0, n := rng.randrange(1, 300), max(1, n - 5)]), b := rng.randrange(5000), b + n) for i in range(200) if (n := 50)]
    want = {(q, g) for _, q, _, n, b, e in rows for _, g, gb, ge in genes if n > 0 and min(e, ge) - max(b, gb) >= -(-n * 4 // 5)}
    df = spark.createDataFrame(rows, "sample string, query string, subject string, length long, beg long, end long")
    got = match_genes(df, spark.createDataFrame(genes, "contig string, gene string, beg long, end long"), 0.8, width=64)
    assert {(r.query, r.subject) for r in got.collect()} == want


def test_ranges(spark):
    rows = [("A", "x", 1, 100), ("A", "x", 1, 50), ("A", "x", 251, 300), ("A", "x", 1, 50), ("A", "y", 1, 50), ("A", "y", 51, 100), ("A", "z", 0, 10), ("A", "z", 10, 20)]
    df = spark.createDataFrame(rows, "sample string, subject string, beg long, end long")
    for width in (1 << 20, 30, 1):
        got = sorted((r.subject, r.beg, r.end) for r in cover_ranges(df, width=width).collect())
        assert got == [("x", 1, 100), ("x", 251, 300), ("y", 1, 50), ("y", 51, 100), ("z", 0, 20)]


@pytest.mark.parametrize(("kind", "want"), [("bed", (0, 100)), (None, (0, 100)), ("gff", (1, 100)), ("0e", (0, 100)), ("1e", (1, 101)), ("0i", (0, 99)), ("1i", (1, 100))])
def test_offsets(spark, kind, want):
    df = spark.createDataFrame([("A", "x", 0, 100)], "sample string, subject string, beg long, end long")
    assert tuple(with_offsets(df, kind).first())[2:] == want


def test_bad_offsets(spark):
    with pytest.raises(ValueError):
        with_offsets(spark.range(1).selectExpr("0 beg", "1 end"), "xyz")


def test_repeated_pairs(spark):
    """Several reads of a query on a contig and genes at several places give a pair once; other pairs aren't dealt out after the join."""
    rng = random.Random(5)
    genes = [(f"n{rng.randrange(3)}", f"g{rng.randrange(25)}", b := rng.randrange(900), b + rng.randrange(1, 300)) for i in range(40)]
    rows = [(rng.choice("AB"), f"r{rng.randrange(90)}", f"n{rng.randrange(3)}", 20, b := rng.randrange(900), b + 20) for i in range(300)]
    want = {(s, q, g) for s, q, c, n, b, e in rows for d, g, gb, ge in genes if c == d and min(e, ge) - max(b, gb) >= 16}
    reads_ = spark.createDataFrame(rows, "sample string, query string, subject string, length long, beg long, end long")
    genes_ = spark.createDataFrame(genes, "contig string, gene string, beg long, end long")
    got = [tuple(r) for r in match_genes(reads_, genes_, 0.8, width=64).collect()]
    assert sorted(got) == sorted(want)
    shares = {}
    for s, q, g in want:
        shares[s, g] = shares.get((s, g), 0) + 1 / sum((s, q) == x[:2] for x in want)
    assert {(r.sample, r.feature): round(r.value, 9) for r in count_genes(reads_, genes_).collect()} == {k: round(v, 9) for k, v in shares.items()}
    # five reads of their own, each in 400 genes: the pairs are more than all rows that exchanges see
    few = spark.createDataFrame([("A", f"q{i}", "n1", 20, 100, 120) for i in range(5)], reads_.schema)
    deep = spark.createDataFrame([("n1", f"d{i}", 50, 200) for i in range(400)], genes_.schema)
    found = match_genes(few, deep)
    assert found.count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.startswith("Union")
