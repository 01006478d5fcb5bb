import pytest

from cladeflow.operators import profiles as P
from cladeflow.sources.tables import describe, name_as_id, wide

CELLS = {"S1": {"G1": 4, "G2": 5, "G3": 8}, "S2": {"G1": 2, "G4": 3, "G5": 7}, "S3": {"G2": 3, "G5": 5}}


def profile(spark, cells):
    return spark.createDataFrame([(f, s, float(v)) for s, x in cells.items() for f, v in x.items()], "feature string, sample string, value double")


def cells(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["sample"], {})[r.feature] = r.value
    return out


def pairs(spark, mapping):
    return spark.createDataFrame([(s, t) for s, ts in mapping.items() for t in ts], "source string, target string")


@pytest.mark.parametrize(("options", "want"), [
    ({"min_count": 4}, {"S1": {"G1": 4, "G2": 5, "G3": 8}, "S2": {"G5": 7}, "S3": {"G5": 5}}),
    ({"min_percent": 25}, {"S1": {"G2": 5, "G3": 8}, "S2": {"G4": 3, "G5": 7}, "S3": {"G2": 3, "G5": 5}}),
    ({"min_count": 10}, {})])
def test_filter(spark, options, want):
    assert cells(P.filter_profile(profile(spark, CELLS), **options)) == want


@pytest.mark.parametrize("options", [{}, {"min_count": 1, "min_percent": 1}, {"min_percent": 100}])
def test_filter_options(spark, options):
    with pytest.raises(ValueError):
        P.filter_profile(profile(spark, CELLS), **options)


def test_normalize(spark):
    p = profile(spark, {"S1": {"G1": 4, "G2": 12}, "S2": {"G1": 5}})
    assert cells(P.normalize(p, factor=100)) == {"S1": {"G1": 25, "G2": 75}, "S2": {"G1": 100}}
    assert cells(P.normalize(p, digits=2)) == {"S1": {"G1": 0.25, "G2": 0.75}, "S2": {"G1": 1.0}}
    assert cells(P.normalize(p)) == {"S1": {"G2": 1}, "S2": {"G1": 1}}
    sizes = spark.createDataFrame([("G1", 5.0), ("G2", 20.0)], "subject string, size double")
    assert cells(P.normalize(p, sizes, "1k")) == {"S1": {"G1": 800, "G2": 600}, "S2": {"G1": 1000}}
    with pytest.raises(Exception, match="without a size"):
        P.normalize(p, sizes.limit(1)).collect()


def test_merge(spark):
    p = profile(spark, CELLS)
    got = cells(P.merge(p, profile(spark, {"S1": {"G1": 1.5, "G9": 0}, "S4": {"G1": 2}})))
    assert got == {**CELLS, "S1": {"G1": 5.5, "G2": 5, "G3": 8}, "S4": {"G1": 2}}
    meta = spark.createDataFrame([("G1", "one")], "feature string, Name string")
    assert [tuple(r) for r in P.merge_metadata(meta, meta).collect()] == [("G1", "one")]
    with pytest.raises(Exception, match="Conflicting"):
        P.merge_metadata(meta, spark.createDataFrame([("G1", "two")], "feature string, Name string")).collect()


def test_clip(spark):
    p = profile(spark, {"S": {"A_G1_1": 1, "_G1_1": 2, "G2__3": 4, "G5_4_": 1, "__G0": 9, "x": 5}})
    assert cells(P.clip(p, 2, "_")) == {"S": {"G1": 3, "4": 1}}
    assert cells(P.clip(p, 2, nested=True)) == {"S": {"A_G1": 1, "_G1": 2, "G5_4": 1}}
    with pytest.raises(ValueError):
        P.clip(p, None)


def test_collapse(spark):
    p = profile(spark, {"S": {"G1": 4, "G2": 6, "G3": 8, "G4": 1}})
    m = pairs(spark, {"G1": ["H1"], "G2": ["H1", "H2"], "G3": ["H2", "H3", "H4", "H4"]})
    assert cells(P.collapse(p, m)) == {"S": {"H1": 10, "H2": 14, "H3": 8, "H4": 16}}
    assert cells(P.collapse(p, m, divided=True)) == {"S": {"H1": 7, "H2": 5, "H3": 2, "H4": 4}}


def test_collapse_fields(spark):
    p = profile(spark, {"S": {"A|K1": 4, "A|K2": 5, "B|K2": 1, "C": 7}})
    assert cells(P.collapse(p, pairs(spark, {"K1": ["L1"], "K2": ["L1", "L2"]}), field=2)) == {"S": {"A|L1": 9, "A|L2": 5, "B|L1": 1, "B|L2": 1}}
    assert cells(P.collapse(p, pairs(spark, {"A": ["Z"]}), field=1)) == {"S": {"Z|K1": 4, "Z|K2": 5}}
    nested = profile(spark, {"S": {"A_1_x": 4, "A_1": 2, "B_2_y": 1}})
    m = pairs(spark, {"A_1": ["T"], "B_2": ["U"], "A_1_x": ["V"], "A": ["W"]})
    assert cells(P.collapse(nested, m, field=2, nested=True)) == {"S": {"A|T|A_1_x": 4, "A|T": 2, "B|U|B_2_y": 1}}
    assert cells(P.collapse(nested, m, field=3, nested=True)) == {"S": {"A_1|V": 4}}
    assert cells(P.collapse(nested, m, field=1, nested=True)) == {"S": {"W|A_1_x": 4, "W|A_1": 2}}


def test_coverage(spark):
    p = profile(spark, {"S1": {"G1": 4, "G2": 1}, "S2": {"G3": 0.4}, "S3": {"G9": 1}})
    groups = spark.createDataFrame([("P1", "G1"), ("P1", "G2"), ("P1", "G2"), ("P1", "G7"), ("P2", "G3"), ("P3", "G8")], "grp string, member string")
    assert cells(P.group_coverage(p, groups)) == {"S1": {"P1": 66.667, "P2": 0}, "S2": {"P1": 0, "P2": 100}, "S3": {"P1": 0, "P2": 0}}
    assert cells(P.group_coverage(p, groups, threshold=80)) == {"S1": {"P2": 0}, "S2": {"P2": 1}, "S3": {"P2": 0}}
    assert cells(P.group_coverage(p, groups, count=True))["S1"] == {"P1": 2, "P2": 0}
    assert P.shape(p) == (4, 3)


def test_tables(spark):
    p = profile(spark, {"S1": {"T1": 4, "A|T2": 0}, "S2": {"A|T2": 3}})
    names = spark.createDataFrame([("T1", "one"), ("T2", "two")], "id string, name string")
    ranks = spark.createDataFrame([("T2", "genus")], "id string, rank string")
    meta = describe(p, names, ranks)
    rows = [tuple(r) for r in wide(p, ["S2", "S1", "S0"], meta).collect()]
    assert rows == [("A|T2", 3.0, 0.0, 0.0, "two", "genus"), ("T1", 0.0, 4.0, 0.0, "one", "")]
    assert {r.feature for r in name_as_id(p, names).collect()} == {"one", "A|two"}
