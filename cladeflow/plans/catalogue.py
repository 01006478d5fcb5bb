"""Queries over the driver tables and their SQL twins, by name.

The tables are re-keyed into what the operators take. Suppliers are subjects under nations and
regions, every 17th being left out of the hierarchy; orders are queries and their priorities
samples; parts are sized subjects, genes and features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import tolerant_round
from ..functions.text import demultiplex
from ..operators import profiles as P
from ..operators.assignment import distinct_hits
from ..operators.counting import read_map
from ..operators.intervals import count_genes, cover_ranges, match_genes, with_offsets
from ..operators.tree import fill_root, lca, lineage_strings, lineages, rank_lookup
from ..session import joined_large
from ..sources.tables import describe, name_as_id
from .workflow import Hierarchy, assign, classify, make_hits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# ---- the re-keyed tables -------------------------------------------------------------------

def _lines(spark, d, *columns):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    lines = table(spark, d, "lineitem", "l_orderkey", *columns)
    return joined_large(lines, orders, "l_orderkey", "o_orderkey").withColumnsRenamed({"o_orderpriority": "sample"}).withColumn("query", F.col("l_orderkey").cast("string"))


def alignments(spark, d) -> DataFrame:
    return _lines(spark, d, "l_suppkey").select("sample", "query", F.concat(F.lit("S"), F.col("l_suppkey")).alias("subject"))


def part_hits(spark, d) -> DataFrame:
    return _lines(spark, d, "l_partkey").select("sample", "query", F.concat(F.lit("P"), F.col("l_partkey")).alias("subject"))


def hits(spark, d) -> DataFrame:
    return distinct_hits(alignments(spark, d))


def nodes(spark, d) -> DataFrame:
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").filter("s_suppkey % 17 <> 0").select(node("S", "s_suppkey").alias("id"), node("N", "s_nationkey").alias("parent"), F.lit(None).cast("string").alias("rank"))
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey").select(node("N", "n_nationkey").alias("id"), node("R", "n_regionkey").alias("parent"), F.lit("nation").alias("rank"))
    r = table(spark, d, "region", "r_regionkey").select(node("R", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("rank"))
    return s.unionByName(n).unionByName(r)


def names(spark, d) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_name").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    r = table(spark, d, "region", "r_regionkey", "r_name").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"))
    return n.unionByName(r)


def hierarchy(spark, d) -> Hierarchy:
    return Hierarchy(lineages(fill_root(nodes(spark, d))), names(spark, d))


def sizes(spark, d) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_size").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("subject"), F.col("p_size").cast("double").alias("size"))


def strata(spark, d) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").filter("o_orderkey % 5 <> 0")
    return o.select(F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").cast("string").alias("query"), F.col("o_orderstatus").alias("stratum"))


def brand_hierarchy(spark, d) -> Hierarchy:
    part = table(spark, d, "part", "p_partkey", "p_brand")
    up = part.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("parent"), F.lit(None).cast("string").alias("rank"))
    top = part.select(F.col("p_brand").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("brand").alias("rank")).distinct()
    return Hierarchy(lineages(fill_root(up.unionByName(top))))


def reads(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    beg = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 200000
    return rows.select(
        F.col("l_returnflag").alias("sample"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("query"), F.concat(F.lit("C"), F.col("l_suppkey") % 100).alias("subject"),
        F.col("l_quantity").cast("long").alias("length"), beg.alias("beg"), (beg + F.col("l_quantity").cast("long")).alias("end"))


def genes(spark, d) -> DataFrame:
    beg = (F.col("p_partkey") * 997) % 200000
    return table(spark, d, "part", "p_partkey", "p_size").select(
        F.concat(F.lit("C"), F.col("p_partkey") % 100).alias("contig"), F.concat(F.lit("G"), F.col("p_partkey")).alias("gene"), beg.alias("beg"), (beg + 20 * F.col("p_size")).alias("end"))


def brand_types(spark, d) -> DataFrame:
    """A profile whose features are brand|type."""
    part = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    rows = _lines(spark, d, "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("sample", F.concat_ws("|", "p_brand", "p_type").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value"))


def parts_profile(spark, d) -> DataFrame:
    rows = _lines(spark, d, "l_partkey", "l_quantity")
    return rows.groupBy("sample", F.concat(F.lit("P"), F.col("l_partkey")).alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value"))


A = "a AS (SELECT DISTINCT o_orderpriority AS sample, CAST(l_orderkey AS VARCHAR) AS query, 'S' || l_suppkey AS subject FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
AP = "a AS (SELECT DISTINCT o_orderpriority AS sample, CAST(l_orderkey AS VARCHAR) AS query, 'P' || l_partkey AS subject, p_size AS size, p_brand AS taxon FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
S = "s AS (SELECT 'S' || s_suppkey AS subject, 'N' || s_nationkey AS nation, 'R' || n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 17 <> 0)"
STRATA = "z AS (SELECT o_orderpriority AS sample, CAST(o_orderkey AS VARCHAR) AS query, o_orderstatus AS stratum FROM orders WHERE o_orderkey % 5 <> 0)"
BT = "p AS (SELECT o_orderpriority AS sample, p_brand || '|' || p_type AS feature, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
PP = "p AS (SELECT o_orderpriority AS sample, 'P' || l_partkey AS feature, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
I = """r AS (SELECT l_returnflag AS sample, l_orderkey || '_' || l_linenumber AS query, 'C' || (l_suppkey % 100) AS contig, CAST(l_quantity AS BIGINT) AS length,
       (l_orderkey * 37 + l_linenumber * 11) % 200000 AS beg, (l_orderkey * 37 + l_linenumber * 11) % 200000 + CAST(l_quantity AS BIGINT) AS fin FROM lineitem),
  g AS (SELECT 'C' || (p_partkey % 100) AS contig, 'G' || p_partkey AS gene, (p_partkey * 997) % 200000 AS beg, (p_partkey * 997) % 200000 + 20 * p_size AS fin FROM part)"""


def _tolerant(x: str) -> str:
    half = f"(round_even(({x}) * 2, 0) / 2)"
    return f"CASE WHEN abs(({x}) - {half}) <= 1e-7 THEN round_even({half}, 0) ELSE round_even({x}, 0) END"


def _rounded(inner: str, keys: str = "sample, feature") -> str:
    return f"SELECT * FROM (SELECT {keys}, {_tolerant('value')} AS value FROM ({inner})) WHERE value <> 0"


def _ranked(taxon: str, unique: str, shared: bool) -> str:
    """Rows (sample, feature, value) of queries by the taxon of their hits: s.{taxon}; ``unique``: the result where they differ."""
    return f"""t AS (SELECT a.sample, a.query, a.subject, s.nation, s.region, s.{taxon} AS taxon FROM a LEFT JOIN s USING (subject)),
  q AS (SELECT *, count(*) OVER w AS k, count(taxon) OVER w AS named, min(taxon) OVER w AS lo, max(taxon) OVER w AS hi, min(region) OVER w AS rlo, max(region) OVER w AS rhi,
               count(*) OVER (PARTITION BY sample, query, taxon) AS n FROM t WINDOW w AS (PARTITION BY sample, query)),
  u AS (SELECT *, named = 0 OR (named = k AND lo = hi) AS same FROM q),
  v AS (SELECT DISTINCT sample, query, CASE WHEN same THEN lo ELSE {unique} END AS feature, 1.0 AS value FROM u WHERE same OR {not shared}
        UNION ALL SELECT sample, query, taxon, 1.0 / named FROM u WHERE NOT same AND {shared} AND taxon IS NOT NULL)"""


def _sum(cte: str, keys: str = "sample, feature") -> str:
    return f"SELECT {keys}, sum(value) AS value FROM {cte} WHERE feature IS NOT NULL GROUP BY {keys}"


# ---- subjects themselves -------------------------------------------------------------------

NONE = f"WITH {A}, v AS (SELECT sample, subject AS feature, 1.0 / count(*) OVER (PARTITION BY sample, query) AS value FROM a) "


@_query("ogu_counts", NONE + _rounded(_sum("v")))
def ogu_counts(spark, d):
    return classify(hits(spark, d)).drop("rank")


@_query("ogu_counts_uniq", NONE + _rounded(_sum("(SELECT * FROM v WHERE value = 1)")))
def ogu_counts_uniq(spark, d):
    return classify(hits(spark, d), uniq=True).drop("rank")


@_query("ogu_fractional", NONE + f", c AS ({_sum('v')}) " + _rounded("SELECT sample, feature, value / sum(value) OVER (PARTITION BY sample) * 1000000 AS value FROM c"))
def ogu_fractional(spark, d):
    return classify(hits(spark, d), frac=True, factor="1M").drop("rank")


# ---- fixed ranks and ancestors -------------------------------------------------------------

def _rank_query(name: str, rank: str, unique: str, shared: bool, **options):
    @_query(name, f"WITH {A}, {S}, {_ranked(rank, unique, shared)} " + _rounded(_sum("v")))
    def run(spark, d):
        return classify(hits(spark, d), hierarchy(spark, d), [rank], **options).drop("rank")


_rank_query("rank_region_split", "region", "NULL", True)
_rank_query("rank_nation_split", "nation", "NULL", True)
_rank_query("rank_uniq", "region", "NULL", False, uniq=True)
_MAJOR = "max(CASE WHEN n >= k * CAST({} AS DOUBLE) THEN taxon END) OVER (PARTITION BY sample, query)"
_rank_query("rank_major_60", "region", _MAJOR.format("0.6"), False, major=60)
_rank_query("rank_major_80", "region", _MAJOR.format("0.8"), False, major=80)
_rank_query("rank_above", "nation", "CASE WHEN named = k AND rlo = rhi THEN rlo END", False, above=True)

_FREE = """f AS (SELECT a.sample, a.query, count(*) AS k, count(s.subject) AS named, min(a.subject) AS one, min(nation) AS nlo, max(nation) AS nhi, min(region) AS rlo, max(region) AS rhi
        FROM a LEFT JOIN s USING (subject) GROUP BY 1, 2),
  v AS (SELECT sample, query, CASE WHEN k = 1 THEN {} WHEN named < k THEN NULL WHEN nlo = nhi THEN nlo WHEN rlo = rhi THEN rlo END AS feature, 1.0 AS value FROM f)"""


@_query("free_lca", f"WITH {A}, {S}, {_FREE.format('nlo')} " + _rounded(_sum("v")))
def free_lca(spark, d):
    return classify(hits(spark, d), hierarchy(spark, d), ["free"]).drop("rank")


@_query("free_lca_subok", f"WITH {A}, {S}, {_FREE.format('one')} " + _rounded(_sum("v")))
def free_lca_subok(spark, d):
    return classify(hits(spark, d), hierarchy(spark, d), ["free"], subok=True).drop("rank")


@_query("free_unassigned", f"WITH {A}, {S}, {_FREE.format('nlo')} " + _rounded(_sum("(SELECT sample, coalesce(feature, 'Unassigned') AS feature, value FROM v)")))
def free_unassigned(spark, d):
    return classify(hits(spark, d), hierarchy(spark, d), ["free"], unassigned=True).drop("rank")


def _multi(rank: str) -> str:
    return f"SELECT '{rank}' AS rank, sample, feature, value FROM (WITH {_ranked(rank, 'NULL', True)} {_rounded(_sum('v'))})"


@_query("multi_rank_profile", f"WITH {A}, {S}, {_FREE.format('nlo').replace('v AS', 'free AS')} {_multi('nation')} UNION ALL {_multi('region')} UNION ALL SELECT 'free', sample, feature, value FROM ({_rounded(_sum('free'))})")
def multi_rank_profile(spark, d):
    return classify(hits(spark, d), hierarchy(spark, d), ["nation", "region", "free"])


# ---- sizes and strata ----------------------------------------------------------------------

_SIZED = """q AS (SELECT *, count(*) OVER w AS k, min(taxon) OVER w = max(taxon) OVER w AS same FROM a WINDOW w AS (PARTITION BY sample, query)),
  v AS (SELECT sample, query, {} AS feature, CAST(1 AS DOUBLE) / size / k AS value FROM q)"""


@_query("size_normalised", f"WITH {AP}, {_SIZED.format('subject')} " + _rounded(f"SELECT sample, feature, value * 1000 AS value FROM ({_sum('v')})"))
def size_normalised(spark, d):
    return classify(distinct_hits(part_hits(spark, d)), sizes=sizes(spark, d), factor="1k").drop("rank")


@_query("size_split", f"WITH {AP}, {_SIZED.format('taxon')} " + _rounded(f"SELECT sample, feature, value * 1000 AS value FROM ({_sum('v')})"))
def size_split(spark, d):
    return classify(distinct_hits(part_hits(spark, d)), brand_hierarchy(spark, d), ["brand"], sizes=sizes(spark, d), factor="1k").drop("rank")


@_query("stratified_counts", f"WITH {A}, {S}, {STRATA}, {_ranked('region', 'NULL', True)}, x AS (SELECT sample, stratum || '|' || feature AS feature, value FROM v JOIN z USING (sample, query)) " + _rounded(_sum("x")))
def stratified_counts(spark, d):
    return classify(hits(spark, d), hierarchy(spark, d), ["region"], strata=strata(spark, d)).drop("rank")


@_query("size_stratified", f"WITH {AP}, {STRATA}, {_SIZED.format('taxon')}, x AS (SELECT sample, stratum || '|' || feature AS feature, value * 1000 AS value FROM v JOIN z USING (sample, query)) " + _rounded(_sum("x")))
def size_stratified(spark, d):
    return classify(distinct_hits(part_hits(spark, d)), brand_hierarchy(spark, d), ["brand"], sizes=sizes(spark, d), strata=strata(spark, d), factor="1k").drop("rank")


# ---- scan time -----------------------------------------------------------------------------

@_query("exclude_subject", f"WITH {A}, bad AS (SELECT DISTINCT sample, query FROM a WHERE CAST(substr(subject, 2) AS BIGINT) % 10 = 3) SELECT sample, query, subject FROM a WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.sample = a.sample AND bad.query = a.query)")
def exclude_subject(spark, d):
    bad = table(spark, d, "supplier", "s_suppkey").filter("s_suppkey % 10 = 3").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("subject"))
    return make_hits(alignments(spark, d), exclude=bad)


@_query("trim_suffix", "SELECT DISTINCT o_orderpriority AS sample, CAST(l_orderkey AS VARCHAR) AS query, 'S_' || (l_suppkey % 7) AS subject FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def trim_suffix(spark, d):
    rows = _lines(spark, d, "l_suppkey", "l_linenumber").withColumn("subject", F.concat_ws("_", F.lit("S"), F.col("l_suppkey") % 7, "l_linenumber"))
    return make_hits(rows, trim="_")


_DEMUX = """x AS (SELECT CASE WHEN event_id % 11 = 0 THEN event_type WHEN event_id % 13 = 0 THEN event_type || '_' ELSE event_type || '_' || user_id || '_' || (event_id % 3) END AS id FROM events),
  y AS (SELECT id, strpos(id, '_') AS cut FROM x),
  m AS (SELECT CASE WHEN cut > 0 AND cut < length(id) THEN substr(id, 1, cut - 1) ELSE '' END AS sample, CASE WHEN cut > 0 AND cut < length(id) THEN substr(id, cut + 1) WHEN cut > 0 THEN substr(id, 1, cut - 1) ELSE id END AS query FROM y)"""


def multiplexed(spark, d) -> DataFrame:
    whole = F.concat_ws("_", "event_type", "user_id", F.col("event_id") % 3)
    e = table(spark, d, "events", "event_id", "event_type", "user_id")
    return e.select(F.when(F.col("event_id") % 11 == 0, F.col("event_type")).when(F.col("event_id") % 13 == 0, F.concat("event_type", F.lit("_"))).otherwise(whole).alias("query"))


@_query("demux_first_sep", f"WITH {_DEMUX} SELECT sample, query, count(*) AS n FROM m GROUP BY 1, 2")
def demux_first_sep(spark, d):
    sample, read = demultiplex(F.col("query"))
    return multiplexed(spark, d).select(sample.alias("sample"), read.alias("query")).groupBy("sample", "query").agg(F.count(F.lit(1)).alias("n"))


@_query("demux_sample_filter", f"WITH {_DEMUX} SELECT DISTINCT sample, query, 'x' AS subject FROM m WHERE sample IN ('click', 'purchase', 'view')")
def demux_sample_filter(spark, d):
    rows = multiplexed(spark, d).select(F.lit("").alias("sample"), "query", F.lit("x").alias("subject"))
    return make_hits(rows, demux=True, samples=["click", "purchase", "view"])


# ---- hierarchy -----------------------------------------------------------------------------

_NODES = """n AS (SELECT 'S' || s_suppkey AS id, 'N' || s_nationkey AS parent, CAST(NULL AS VARCHAR) AS rank FROM supplier WHERE s_suppkey % 17 <> 0
        UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'nation' FROM nation UNION ALL SELECT 'R' || r_regionkey, '1', 'region' FROM region UNION ALL SELECT '1', '1', NULL)"""
_UP = f"{_NODES}, up AS (SELECT id, id AS anc, 0 AS dist FROM n UNION ALL SELECT up.id, n.parent, up.dist + 1 FROM up JOIN n ON up.anc = n.id WHERE n.parent <> n.id)"


@_query("tree_fill_root", f"WITH {_NODES} SELECT id, parent, rank FROM n")
def tree_fill_root(spark, d):
    return fill_root(nodes(spark, d))


@_query("tree_lineage_string", f"WITH RECURSIVE {_UP} SELECT id, coalesce(string_agg(anc, ';' ORDER BY dist DESC) FILTER (dist > 0 AND anc <> '1'), '') AS \"Lineage\" FROM up GROUP BY id")
def tree_lineage_string(spark, d):
    return lineage_strings(hierarchy(spark, d).lined)


@_query("tree_rank_lookup", f"WITH RECURSIVE {_UP} SELECT up.id AS subject, n.rank, arg_min(up.anc, up.dist) AS taxon FROM up JOIN n ON up.anc = n.id WHERE n.rank IS NOT NULL GROUP BY 1, 2")
def tree_rank_lookup(spark, d):
    return rank_lookup(hierarchy(spark, d).lined, ["nation", "region"])


@_query("lca_pairs", f"""WITH RECURSIVE {_UP}, {A}, k AS (SELECT sample, query, count(*) AS k FROM a GROUP BY 1, 2),
  c AS (SELECT sample, query, anc, count(*) AS c FROM a JOIN up ON a.subject = up.id GROUP BY 1, 2, 3),
  depth AS (SELECT id, max(dist) AS depth FROM up GROUP BY 1)
  SELECT k.sample, k.query, max_by(c.anc, depth.depth) AS lca FROM k LEFT JOIN (c JOIN depth ON c.anc = depth.id) ON k.sample = c.sample AND k.query = c.query AND c.c = k.k GROUP BY 1, 2""")
def lca_pairs(spark, d):
    return lca(hits(spark, d), hierarchy(spark, d).lined, ["sample", "query"])


# ---- intervals -----------------------------------------------------------------------------

def _match(th: str) -> str:
    return f"SELECT DISTINCT sample, query, gene AS subject FROM r JOIN g ON r.contig = g.contig AND least(r.fin, g.fin) - greatest(r.beg, g.beg) >= ceil(r.length * CAST({th} AS DOUBLE))"


@_query("gene_match_80", f"WITH {I} {_match('0.8')}")
def gene_match_80(spark, d):
    return match_genes(reads(spark, d), genes(spark, d), 0.8)


@_query("gene_match_50", f"WITH {I} {_match('0.5')}")
def gene_match_50(spark, d):
    return match_genes(reads(spark, d), genes(spark, d), 0.5)


@_query("gene_match_profile", f"WITH {I}, a AS ({_match('0.8')}), v AS (SELECT sample, subject AS feature, 1.0 / count(*) OVER (PARTITION BY sample, query) AS value FROM a) " + _rounded(_sum("v")))
def gene_match_profile(spark, d):
    return P.rounded(count_genes(reads(spark, d), genes(spark, d)))


@_query("gene_lengths", f"WITH {I} SELECT gene AS subject, CAST(fin - beg AS DOUBLE) AS size FROM g")
def gene_lengths_(spark, d):
    from ..sources.mappings import gene_lengths

    return gene_lengths(genes(spark, d))


_COVER = """x AS (SELECT sample, contig AS subject, beg, fin, max(fin) OVER (PARTITION BY sample, contig ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
  y AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < beg THEN 1 ELSE 0 END) OVER (PARTITION BY sample, subject ORDER BY beg, fin ROWS UNBOUNDED PRECEDING) AS part FROM x)"""


@_query("cover_ranges", f'WITH {I}, {_COVER} SELECT sample, subject, min(beg) AS beg, max(fin) AS "end" FROM y GROUP BY sample, subject, part')
def cover_ranges_(spark, d):
    return cover_ranges(reads(spark, d))


@_query("cover_ranges_gff", f'WITH {I}, {_COVER} SELECT sample, subject, min(beg) + 1 AS beg, max(fin) AS "end" FROM y GROUP BY sample, subject, part')
def cover_ranges_gff(spark, d):
    return with_offsets(cover_ranges(reads(spark, d)), "gff")


# ---- profiles ------------------------------------------------------------------------------

def _close(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6)).select("sample", "feature", "value")


_SHARE = "SELECT sample, feature, value / sum(value) OVER (PARTITION BY sample) AS value FROM p"


@_query("profile_fraction", f"WITH {BT} SELECT sample, feature, round(value, 6) AS value FROM ({_SHARE})")
def profile_fraction(spark, d):
    return _close(P.fraction(brand_types(spark, d)))


@_query("profile_percent", f"WITH {BT} SELECT sample, feature, round(value * 100, 6) AS value FROM ({_SHARE})")
def profile_percent(spark, d):
    return _close(P.scale(P.fraction(brand_types(spark, d)), 100))


@_query("profile_cpm", f"WITH {PP} " + _rounded(f"SELECT sample, feature, value * 1000000 AS value FROM ({_SHARE})"))
def profile_cpm(spark, d):
    return P.normalize(parts_profile(spark, d), factor="1M")


@_query("profile_rpk", f"WITH {PP} " + _rounded("SELECT sample, feature, value / CAST(p_size AS DOUBLE) * 1000 AS value FROM p JOIN part ON feature = 'P' || p_partkey"))
def profile_rpk(spark, d):
    return P.normalize(parts_profile(spark, d), sizes(spark, d), "1k").select("sample", "feature", "value")


@_query("profile_round", f"WITH {PP} " + _rounded("SELECT sample, feature, value / 8 AS value FROM p"))
def profile_round(spark, d):
    return P.rounded(P.scale(parts_profile(spark, d), 0.125))


@_query("filter_min_count", f"WITH {PP} SELECT * FROM p WHERE value >= 60")
def filter_min_count(spark, d):
    return P.filter_profile(parts_profile(spark, d), min_count=60)


@_query("filter_min_percent", f"WITH {BT}, b AS (SELECT *, CAST(0.7 AS DOUBLE) / 100 * sum(value) OVER (PARTITION BY sample) AS bound FROM p) SELECT sample, feature, value FROM b WHERE value >= bound")
def filter_min_percent(spark, d):
    return P.filter_profile(brand_types(spark, d), min_percent=0.7)


@_query("merge_additive", f"WITH {PP}, {BT.replace('p AS', 'b AS')} SELECT sample, feature, sum(value) AS value FROM (SELECT * FROM p UNION ALL SELECT * FROM p WHERE value > 30 UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def merge_additive(spark, d):
    p = parts_profile(spark, d)
    return P.merge(p, p.filter("value > 30"), brand_types(spark, d))


@_query("merge_disjoint_samples", f"WITH {PP} SELECT CASE WHEN value > 30 THEN 'high ' ELSE 'low ' END || sample AS sample, feature, value FROM p")
def merge_disjoint_samples(spark, d):
    p = parts_profile(spark, d)
    named = lambda x: F.concat(F.lit(x), F.col("sample"))
    return P.merge(p.filter("value > 30").withColumn("sample", named("high ")), p.filter("value <= 30").withColumn("sample", named("low ")))


_SUMMED = "SELECT sample, {} AS feature, sum(value) AS value FROM {} GROUP BY 1, 2"


@_query("clip_field1", f"WITH {BT} " + _SUMMED.format("split_part(feature, '|', 1)", "p"))
def clip_field1(spark, d):
    return P.clip(brand_types(spark, d), 1)


_URLS = "p AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS sample, url AS feature, CAST(count(*) AS DOUBLE) AS value FROM pages WHERE url IS NOT NULL GROUP BY 1, 2)"


@_query("clip_nested2", f"WITH {_URLS} " + _SUMMED.format("array_to_string(string_split(feature, '/')[1:3], '/')", "p WHERE len(string_split(feature, '/')) >= 3 AND split_part(feature, '/', 3) <> ''"))
def clip_nested2(spark, d):
    pages = table(spark, d, "pages", "page_id", "url").filter("url is not null")
    p = pages.groupBy(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("sample"), F.col("url").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return P.clip(p, 3, "/", True)


_MANY = "m AS (SELECT 'P' || p_partkey AS source, p_brand AS target FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT 'P' || p_partkey, p_type FROM part WHERE p_partkey % 9 <> 0)"


def many_map(spark, d) -> DataFrame:
    part = table(spark, d, "part", "p_partkey", "p_brand", "p_type").filter("p_partkey % 9 <> 0")
    return part.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("source"), F.explode(F.array("p_brand", "p_type")).alias("target"))


@_query("collapse_map", f"WITH {PP}, {_MANY} " + _SUMMED.format("target", "p JOIN m ON feature = source"))
def collapse_map(spark, d):
    return P.collapse(parts_profile(spark, d), many_map(spark, d))


@_query("collapse_divide", f"WITH {PP}, {_MANY} " + _SUMMED.format("target", "(SELECT p.sample, p.feature, p.value / 2 AS value FROM p) JOIN m ON feature = source"))
def collapse_divide(spark, d):
    return P.collapse(parts_profile(spark, d), many_map(spark, d), divided=True)


@_query("collapse_field2", f"WITH {BT} " + _SUMMED.format("split_part(feature, '|', 1) || '|' || left(split_part(feature, '|', 2), 1)", "p"))
def collapse_field2(spark, d):
    types = table(spark, d, "part", "p_type").distinct().select(F.col("p_type").alias("source"), F.substring("p_type", 1, 1).alias("target"))
    return P.collapse(brand_types(spark, d), types, field=2)


_DATES = "p AS (SELECT o_orderpriority AS sample, strftime(l_shipdate, '%Y_%m_%d') AS feature, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@_query("collapse_nested", f"WITH {_DATES} " + _SUMMED.format("substr(feature, 1, 4) || '|' || CASE WHEN CAST(substr(feature, 6, 2) AS INT) <= 6 THEN 'first' ELSE 'second' END || '|' || feature", "p"))
def collapse_nested(spark, d):
    p = _lines(spark, d, "l_shipdate").groupBy("sample", F.date_format("l_shipdate", "yyyy_MM_dd").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    months = p.select(F.substring("feature", 1, 7).alias("source")).distinct()
    halves = months.withColumn("target", F.when(F.substring("source", 6, 2).cast("int") <= 6, "first").otherwise("second"))
    return P.collapse(p, halves, field=2, nested=True)


_GROUPS = """h AS (SELECT 'N' || s_nationkey AS grp, 'S' || s_suppkey AS member FROM supplier), t AS (SELECT grp, count(*) AS total FROM h GROUP BY 1),
  x AS (SELECT DISTINCT sample, subject FROM a),
  c AS (SELECT grp, sample, count(*) AS covered FROM x JOIN h ON subject = member GROUP BY 1, 2),
  f AS (SELECT g.grp AS feature, s.sample, coalesce(covered, 0) AS covered, total FROM (SELECT DISTINCT grp FROM c) g CROSS JOIN (SELECT DISTINCT sample FROM x) s LEFT JOIN c ON c.grp = g.grp AND c.sample = s.sample JOIN t ON t.grp = g.grp)"""


def _coverage(spark, d, **options) -> DataFrame:
    p = alignments(spark, d).select("sample", F.col("subject").alias("feature"), F.lit(1.0).alias("value")).distinct()
    groups = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("grp"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("member"))
    return P.group_coverage(p, groups, **options)


@_query("coverage_percent", f"WITH {A}, {_GROUPS} SELECT sample, feature, round(100 * covered / CAST(total AS DOUBLE), 2) AS value FROM f")
def coverage_percent(spark, d):
    return _coverage(spark, d).withColumn("value", F.round("value", 2))


@_query("coverage_threshold", f"WITH {A}, {_GROUPS}, y AS (SELECT sample, feature, CASE WHEN 100 * covered / CAST(total AS DOUBLE) >= 80 THEN 1.0 ELSE 0.0 END AS value FROM f) SELECT sample, feature, CAST(value AS DOUBLE) AS value FROM y WHERE feature IN (SELECT feature FROM y WHERE value > 0)")
def coverage_threshold(spark, d):
    return _coverage(spark, d, threshold=80)


@_query("coverage_count", f"WITH {A}, {_GROUPS} SELECT sample, feature, CAST(covered AS DOUBLE) AS value FROM f")
def coverage_count(spark, d):
    return _coverage(spark, d, count=True)


# ---- read maps and metadata ----------------------------------------------------------------

@_query("readmap_rows", f"""WITH {A}, {S}, t AS (SELECT a.sample, a.query, s.region AS taxon FROM a LEFT JOIN s USING (subject)),
  q AS (SELECT sample, query, count(*) AS k, count(taxon) AS named, count(DISTINCT taxon) AS d FROM t GROUP BY 1, 2),
  c AS (SELECT sample, query, taxon, count(*) AS n FROM t WHERE taxon IS NOT NULL GROUP BY 1, 2, 3)
  SELECT c.sample, c.query, string_agg(CASE WHEN d = 1 AND named = k THEN taxon ELSE taxon || ':' || n END, chr(9) ORDER BY n DESC, taxon) AS taxa FROM c JOIN q ON c.sample = q.sample AND c.query = q.query GROUP BY 1, 2""")
def readmap_rows(spark, d):
    return read_map(assign(hits(spark, d), "region", hierarchy(spark, d)))


_LINEAGE = f"{_UP}, l AS (SELECT id, coalesce(string_agg(anc, ';' ORDER BY dist DESC) FILTER (dist > 0 AND anc <> '1'), '') AS \"Lineage\" FROM up GROUP BY id)"
_NAMES = "e AS (SELECT 'N' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region)"


@_query("rank_names_lineage", f"WITH RECURSIVE {_LINEAGE}, {_NAMES}, {A}, {S}, {_FREE.format('nlo')} SELECT DISTINCT feature, coalesce(e.name, '') AS \"Name\", coalesce(n.rank, '') AS \"Rank\", coalesce(l.\"Lineage\", '') AS \"Lineage\" FROM v LEFT JOIN e ON feature = e.id LEFT JOIN n ON feature = n.id LEFT JOIN l ON feature = l.id WHERE feature IS NOT NULL")
def rank_names_lineage(spark, d):
    tree = hierarchy(spark, d)
    return describe(classify(hits(spark, d), tree, ["free"]), tree.names, tree.lined, lineage_strings(tree.lined))


@_query("name_as_id", f"WITH {A}, {S}, {_NAMES}, {_ranked('nation', 'NULL', True)} SELECT sample, coalesce(name, feature) AS feature, value FROM ({_rounded(_sum('v'))}) LEFT JOIN e ON feature = id")
def name_as_id_(spark, d):
    tree = hierarchy(spark, d)
    return name_as_id(classify(hits(spark, d), tree, ["nation"]), tree.names).select("sample", "feature", "value")


@_query("tolerant_rounding", f"SELECT l_orderkey, l_linenumber, {_tolerant('l_quantity / 4 + 1e-9')} AS value FROM lineitem")
def tolerant_rounding(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", tolerant_round(F.col("l_quantity") / 4 + 1e-9).alias("value"))
