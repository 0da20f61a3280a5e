"""Registered queries over the star-schema tables, each with a DuckDB statement where SQL can express it.

Sequences are document and benchmark texts; points, blocks and intervals come
from orders and line items; a path is the event sequence of a user, and three
neighbouring users make one small layered graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import expr as E
from strandline.operators import annotate
from strandline.operators import arrange as A
from strandline.operators import bubbles as B
from strandline.operators import chain as C
from strandline.operators import graph as G
from strandline.operators import graph_align as GA
from strandline.operators import intervals as I
from strandline.operators import layout as L
from strandline.operators import match as M
from strandline.operators import msa, simulate
from strandline.operators import transforms as X
from strandline.operators.components import connected_components
from strandline.session import materialise, ship
from strandline.sources import text_formats as S
from strandline.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Least match length of the anchor queries.
K = 40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- sequences

@query("SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, '{b}', '')) AS n_{b.lower()}" for b in "ACGTN") + " FROM documents")
def base_composition(spark, sf_dir):
    """Letter counts of every document."""
    return _t(spark, sf_dir, "documents").select("doc_id", *[E.base_count(F.col("text"), b).alias(f"n_{b.lower()}") for b in "ACGTN"])


def _bases(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))


_BASES = "SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents"


@query(f"SELECT doc_id, length(seq) AS n, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM ({_BASES})")
def reverse_complement(spark, sf_dir):
    """Reverse complement of the bases among each document's letters."""
    return _bases(_t(spark, sf_dir, "documents")).select("doc_id", F.length("seq").cast("bigint").alias("n"), F.md5(E.reverse_complement(F.col("seq"))).alias("digest"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS piece, doc_id || '_' || i AS name, length(p[i + 1]) AS n
FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n+'), lambda x: x <> '') AS p FROM documents))""")
def split_runs(spark, sf_dir):
    """Documents cut at runs of a separator, as records are cut at runs of N."""
    out = S.split_runs(_t(spark, sf_dir, "documents"), "doc_id", "text", "\n+")
    return out.select("doc_id", "piece", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("name"), F.length("text").cast("bigint").alias("n"))


@query("""SELECT n AS multiplicity, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM (
SELECT substring(text, i, 8) AS kmer FROM (SELECT text, unnest(range(1, length(text) - 6)) AS i FROM documents)) GROUP BY kmer) GROUP BY n""")
def kmer_spectrum(spark, sf_dir):
    """How many 8-mers occur how often in all documents."""
    return M.kmer_counts(_t(spark, sf_dir, "documents"), "text", 8).groupBy(F.col("n").alias("multiplicity")).agg(F.count(F.lit(1)).alias("kmers"))


@query("""SELECT doc_id, CAST(length(line) AS BIGINT) AS n, md5(line) AS digest FROM (SELECT doc_id, '>' || doc_id || chr(10) || array_to_string(list_transform(range(0, length(seq), 100), lambda i: seq[i + 1:i + 100]), chr(10)) AS line
FROM (""" + _BASES + """))""")
def fasta_records(spark, sf_dir):
    """FASTA records of each document's bases."""
    rows = _bases(_t(spark, sf_dir, "documents"))
    line = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("seq", rf"(.{{{S.WIDTH}}})(?=.)", "$1\n"))
    return rows.select("doc_id", line.alias("line")).select("doc_id", F.length("line").cast("bigint").alias("n"), F.md5("line").alias("digest"))


# ---------------------------------------------------------------- exact matches

def _mem_sql(k: int) -> str:
    return f"""WITH a AS (SELECT item_id, i - 1 AS r_pos, substring(text, i, {k}) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - {k - 2})) AS i FROM benchmark)),
b AS (SELECT doc_id, i - 1 AS q_pos, substring(text, i, {k}) AS kmer FROM (SELECT doc_id, text, unnest(range(1, length(text) - {k - 2})) AS i FROM documents)),
s AS (SELECT item_id, r_pos, doc_id, q_pos FROM a JOIN b USING (kmer)),
m AS (SELECT item_id, doc_id, min(r_pos) AS r_start, min(q_pos) AS q_start, count(*) + {k - 1} AS length
  FROM (SELECT *, r_pos - row_number() OVER (PARTITION BY item_id, doc_id, q_pos - r_pos ORDER BY r_pos) AS g FROM s) GROUP BY item_id, doc_id, q_pos - r_pos, g),
u AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.item_id = m.item_id AND o.doc_id = m.doc_id AND (o.r_start <> m.r_start OR o.q_start <> m.q_start)
  AND ((o.r_start <= m.r_start AND o.r_start + o.length >= m.r_start + m.length) OR (o.q_start <= m.q_start AND o.q_start + o.length >= m.q_start + m.length))))
"""


def _seeds(spark, sf_dir) -> DataFrame:
    return M.seeds(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents").withColumnRenamed("text", "doc_text"), "item_id", "doc_id", "text", "doc_text", K)


def _mems(spark, sf_dir) -> DataFrame:
    return M.mems(_seeds(spark, sf_dir), "item_id", "doc_id", K)


@query(_mem_sql(K) + "SELECT item_id, doc_id, count(*) AS seeds FROM s GROUP BY item_id, doc_id")
def kmer_seeds(spark, sf_dir):
    """Common 40-mers of benchmark items and documents."""
    return _seeds(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("seeds"))


@query(_mem_sql(K) + "SELECT item_id, doc_id, r_start, q_start, length FROM m")
def mem_pairs(spark, sf_dir):
    """Maximal exact matches of benchmark items and documents."""
    return _mems(spark, sf_dir)


@query(_mem_sql(K) + "SELECT item_id, doc_id, r_start, q_start, length FROM u")
def mum_pairs(spark, sf_dir):
    """Maximal unique matches of benchmark items and documents."""
    return M.mums(_mems(spark, sf_dir), "item_id", "doc_id")


@query(_mem_sql(K) + "SELECT doc_id, count(*) AS anchors, CAST(sum(length) AS BIGINT) AS aligned, max(length) AS longest FROM u GROUP BY doc_id")
def anchor_coverage(spark, sf_dir):
    """How much of each document is anchored to benchmark items."""
    return mum_pairs(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("anchors"), F.sum("length").alias("aligned"), F.max("length").alias("longest"))


@query(_mem_sql(K) + "SELECT doc_id, item_id, r_start, q_start, length, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, item_id, r_start, q_start) AS INTEGER) AS rank FROM m) WHERE rank <= 3")
def top_anchors(spark, sf_dir):
    """The three longest matches of each document."""
    w = Window.partitionBy("doc_id").orderBy(F.col("length").desc(), "item_id", "r_start", "q_start")
    return _mems(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("doc_id", "item_id", "r_start", "q_start", "length", "rank")


def _multi_sql(once: str) -> str:
    return f"""WITH t AS (SELECT DISTINCT p_name AS s FROM part), w AS (SELECT s, i, substring(s, i, n) AS string, n FROM (SELECT s, i, unnest(range(3, length(s) - i + 2)) AS n FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM t))),
o AS (SELECT *, CASE WHEN i > 1 THEN substring(s, i - 1, 1) END AS l, nullif(substring(s, i + n, 1), '') AS r FROM w)
SELECT string, max(n) AS length, count(DISTINCT s) AS samples, string_agg(s || ':' || (i - 1), ',' ORDER BY s, i) AS places FROM o GROUP BY string
HAVING count(DISTINCT s) >= 2 {once} AND count(DISTINCT l) + count(*) FILTER (WHERE l IS NULL) > 1 AND count(DISTINCT r) + count(*) FILTER (WHERE r IS NULL) > 1"""


def _part_names(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_name").alias("sample"), F.col("p_name").alias("k"), F.col("p_name").alias("text")).distinct()


def _placed(found: DataFrame) -> DataFrame:
    return found.select("string", "length", "samples", F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["sample"], o["pos"].cast("string"))), ",").alias("places"))


@query(_multi_sql("AND count(*) = count(DISTINCT s)"))
def multi_mums(spark, sf_dir):
    """Strings of three letters or more that occur exactly once in each of two or more part names."""
    return _placed(M.multi_mums(_part_names(spark, sf_dir), "sample", "k", "text", 3))


@query(_multi_sql(""))
def multi_mems(spark, sf_dir):
    """Strings of three letters or more that two or more part names share, repeats within a name included."""
    return _placed(M.multi_mems(_part_names(spark, sf_dir), "sample", "k", "text", 3))


@query("""SELECT l_orderkey, l_linenumber, round(1 - exp(ln(1 - pow(0.25, CAST(l_quantity AS INTEGER))) * l_partkey * l_suppkey), 6) AS p FROM lineitem""")
def match_significance(spark, sf_dir):
    """Chance of matches as long as the quantity in spaces of the keys' sizes."""
    p = E.match_pvalue(F.col("l_quantity").cast("int"), F.lit(2), [F.col("l_partkey"), F.col("l_suppkey")])
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


@query("""SELECT l_suppkey, count(*) AS kept, CAST(sum(c) AS BIGINT) AS cents FROM (
SELECT l_suppkey, c, sum(c) OVER (PARTITION BY l_suppkey ORDER BY c DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY l_suppkey) AS total
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)) WHERE (upto - c) * 2 <= total GROUP BY l_suppkey""")
def coverage_cutoff(spark, sf_dir):
    """The largest items of each supplier up to the first that takes the running share past one half."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("c", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    w = Window.partitionBy("l_suppkey").orderBy(F.col("c").desc(), "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("l_suppkey")))
    return rows.where((F.col("upto") - F.col("c")) * 2 <= F.col("total")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("kept"), F.sum("c").alias("cents"))


@query("""SELECT samples, CAST(sum(n) AS BIGINT) AS events, CAST(sum(n) * max(k) AS BIGINT) AS weight FROM (
SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT unnest(list(event_type)) AS t)) AS samples FROM events GROUP BY user_id, hour(ts), CAST(ts AS DATE)) GROUP BY samples""")
def sample_subsets(spark, sf_dir):
    """Weight (events times kinds) of each set of event kinds that meet in a user's hour."""
    e = _t(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("h"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("event_type")).alias("s"))
    return e.groupBy(F.array_join("s", ",").alias("samples")).agg(F.sum("n").alias("events"), (F.sum("n") * F.max(F.size("s"))).alias("weight"))


# ---------------------------------------------------------------- clusters, blocks, chains

_POINTS = """SELECT l_suppkey, l_orderkey AS s1, l_orderkey - l_partkey % 5 + 10 AS s2, CAST(l_quantity AS BIGINT) AS length, l_linenumber % 2 AS orient FROM lineitem"""


@query(f"""WITH p AS ({_POINTS}), q AS (SELECT *, s1 + length AS e1, s2 + length AS e2, CASE WHEN orient = 0 THEN s1 - s2 ELSE s1 + s2 + length END AS diag FROM p),
r AS (SELECT *, CASE WHEN s1 - lag(e1) OVER w < 30 THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY l_suppkey, orient, diag ORDER BY s1, length)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey, orient, diag ORDER BY s1, length ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT l_suppkey, min(s1) AS s1, max(e1) AS e1, min(s2) AS s2, max(e2) AS e2, orient, CAST(sum(length) AS BIGINT) AS score FROM i GROUP BY l_suppkey, orient, diag, island HAVING sum(length) >= 50""")
def diagonal_clusters(spark, sf_dir):
    """Points of each supplier clustered along diagonals."""
    p = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("s1"), (F.col("l_orderkey") - F.col("l_partkey") % 5 + 10).alias("s2"), F.col("l_quantity").cast("bigint").alias("length"), (F.col("l_linenumber") % 2).alias("orient"))
    return C.cluster_diagonals(p, ["l_suppkey"])


@query()
def local_chains(spark, sf_dir):
    """Local chains of each supplier's points on both strands, each point in one at most."""
    p = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("s1"), (F.col("l_orderkey") - F.col("l_partkey") % 5 + 10).alias("s2"), F.col("l_quantity").cast("bigint").alias("length"), (F.col("l_linenumber") % 2).alias("orient"))
    return C.local_chains(p, ["l_suppkey"], 50, 200)


_BLOCKS = """SELECT l_orderkey, l_partkey AS s1, l_partkey + CAST(l_quantity AS BIGINT) AS e1, l_suppkey * 10 AS s2, l_suppkey * 10 + CAST(l_quantity AS BIGINT) AS e2, l_linenumber % 2 AS orient, CAST(l_quantity AS BIGINT) AS score FROM lineitem"""


def _blocks(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("s1"), (F.col("l_partkey") + q).alias("e1"), (F.col("l_suppkey") * 10).alias("s2"), (F.col("l_suppkey") * 10 + q).alias("e2"), (F.col("l_linenumber") % 2).alias("orient"), q.alias("score"))


@query(f"""WITH b AS ({_BLOCKS}), p AS (SELECT *, lag(s1) OVER w AS ps1, lag(e1) OVER w AS pe1, lag(s2) OVER w AS ps2, lag(e2) OVER w AS pe2, lag(orient) OVER w AS po FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY s1, e1, s2)),
d AS (SELECT *, s1 - pe1 AS d1, CASE WHEN orient = 0 THEN s2 - pe2 ELSE ps2 - e2 END AS d2, greatest(s1 - pe1, 0) AS c1, greatest(greatest(s2 - pe2, ps2 - e2), 0) AS c2 FROM p),
c AS (SELECT l_orderkey, score, CASE WHEN ps1 IS NULL THEN 0.0 WHEN po <> orient THEN 6.0 + least(10000.0, 3.0 * abs(c1 - c2)) + 2.0 * least(c1, c2)
  WHEN d2 < 0 THEN 10001.0 + 2.0 * greatest(d1, 0) ELSE 1.0 + least(10000.0, 3.0 * abs(d1 - d2)) + 2.0 * greatest(least(d1, d2), 0) END AS cost FROM d)
SELECT l_orderkey, CAST(sum(score) * 2.0 AS DOUBLE) AS weight, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(score) * 2.0 AS DOUBLE) - CAST(sum(cost) AS DOUBLE) AS score FROM c GROUP BY l_orderkey""")
def chain_scores(spark, sf_dir):
    """Weight and cost of each order's blocks as a chain."""
    return C.chain_score(_blocks(spark, sf_dir), ["l_orderkey"])


@query(f"""WITH b AS ({_BLOCKS}), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s1, e1, s2) AS r1, row_number() OVER (PARTITION BY l_orderkey ORDER BY s2, e2, s1) AS r2 FROM b),
n AS (SELECT *, CASE WHEN orient = lag(orient) OVER w AND r2 - lag(r2) OVER w = CASE WHEN orient = 0 THEN 1 ELSE -1 END THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY r1)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY r1 ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT l_orderkey, min(s1) AS s1, max(e1) AS e1, min(s2) AS s2, max(e2) AS e2, min(orient) AS orient, CAST(sum(score) AS BIGINT) AS score, count(*) AS blocks FROM i GROUP BY l_orderkey, island""")
def merged_blocks(spark, sf_dir):
    """Neighbouring blocks of each order merged."""
    return C.merge_consecutive(_blocks(spark, sf_dir), ["l_orderkey"])


@query(f"""WITH b AS ({_BLOCKS}), p AS (SELECT *, lag(e1) OVER w AS pe, lead(s1) OVER w AS ns FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY s1, e1))
SELECT l_orderkey, CAST(sum(CASE WHEN pe IS NULL THEN 0 WHEN pe < s1 THEN pe + (s1 - pe) // 2 ELSE s1 END) AS BIGINT) AS starts, CAST(sum(CASE WHEN ns IS NULL THEN 1000000 WHEN ns > e1 THEN e1 + (ns - e1) // 2 ELSE e1 END) AS BIGINT) AS ends FROM p GROUP BY l_orderkey""")
def extended_blocks(spark, sf_dir):
    """Blocks of each order stretched to the middle of their gaps."""
    rows = C.extend_blocks(_blocks(spark, sf_dir).withColumn("high", F.lit(1_000_000).cast("bigint")), ["l_orderkey"], "1", 0, "high")
    return rows.groupBy("l_orderkey").agg(F.sum("s1").alias("starts"), F.sum("e1").alias("ends"))


@query("""WITH RECURSIVE a AS (SELECT l_orderkey, l_partkey AS r, l_suppkey * 20 AS q, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
c AS (SELECT l_orderkey, r + n AS re, q + n AS qe, CAST(n AS DOUBLE) AS score FROM a
  UNION ALL SELECT c.l_orderkey, a.r + a.n, a.q + a.n, c.score + a.n - abs((a.r - c.re) - (a.q - c.qe)) FROM c JOIN a ON a.l_orderkey = c.l_orderkey AND a.r >= c.re AND a.q >= c.qe)
SELECT l_orderkey, max(score) AS chain_score FROM c GROUP BY l_orderkey""")
def colinear_chains(spark, sf_dir):
    """Score of the best colinear chain of each order's anchors."""
    a = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("r_start"), (F.col("l_suppkey") * 20).alias("q_start"), F.col("l_quantity").cast("bigint").alias("length"))
    return C.colinear_chains(a, "l_orderkey").groupBy("l_orderkey").agg(F.max("chain_score").alias("chain_score"))


@query()
def glocal_chains(spark, sf_dir):
    """Best chain of each order's blocks with rearrangements."""
    return C.glocal_chains(_blocks(spark, sf_dir), "l_orderkey")


@query()
def trimmed_blocks(spark, sf_dir):
    """Blocks of each order after both of two overlapping ones lost the overlap, on both axes."""
    return A.remove_overlaps(_blocks(spark, sf_dir), ["l_orderkey"])


@query()
def greedy_blocks(spark, sf_dir):
    """Blocks of each order after the weaker of two overlapping ones lost the overlap, on both axes."""
    return A.remove_overlaps(_blocks(spark, sf_dir), ["l_orderkey"], greedy=True)


@query()
def optimised_blocks(spark, sf_dir):
    """Blocks of each order that a chain gains from."""
    return A.optimise(_blocks(spark, sf_dir), ["l_orderkey"], alpha=20)


def _chains(spark, sf_dir) -> DataFrame:
    return _blocks(spark, sf_dir).withColumnsRenamed({"l_orderkey": "ctg"}).withColumn("ref", (F.col("ctg") % 7).cast("int"))


@query()
def reference_chains(spark, sf_dir):
    """Blocks of each order that share no stretch with better ones on either axis."""
    lengths = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ctg"), F.lit(2000).cast("bigint").alias("length"))
    return A.chains_to_reference(_chains(spark, sf_dir), lengths, least=1)[0]


@query(f"""WITH RECURSIVE a AS ({_BLOCKS}), c AS (SELECT l_orderkey, e1 AS e, CAST(score AS DOUBLE) AS score FROM a
  UNION ALL SELECT c.l_orderkey, a.e1, c.score + a.score - greatest(c.e - a.s1, 0) FROM c JOIN a ON a.l_orderkey = c.l_orderkey AND a.e1 > c.e)
SELECT l_orderkey, max(score) AS score FROM c GROUP BY l_orderkey""")
def contig_paths(spark, sf_dir):
    """Score of the best path of each order's blocks along the first axis, overlaps counted against it."""
    rows = _blocks(spark, sf_dir).withColumnsRenamed({"l_orderkey": "ref"}).withColumn("ctg", F.lit(0))
    w = Window.partitionBy("ref").orderBy("place")
    links = A.best_contig_path(rows).withColumn("over", F.greatest(F.coalesce(F.lag("e1").over(w) - F.col("s1"), F.lit(0)), F.lit(0)))
    return links.groupBy(F.col("ref").alias("l_orderkey")).agg((F.sum("score") - F.sum("over")).cast("double").alias("score"))


_NUMBERED = f"""SELECT l_orderkey % 50 AS ref, l_orderkey // 50 AS ctg, s1, e1, s2, e2, orient, score, row_number() OVER (PARTITION BY l_orderkey ORDER BY s2, e2, s1, e1) AS number FROM ({_BLOCKS})"""


@query(f"""WITH c AS ({_NUMBERED}), n AS (SELECT *, CASE WHEN ctg = lag(ctg) OVER w AND orient = lag(orient) OVER w AND number - lag(number) OVER w = CASE WHEN orient = 0 THEN 1 ELSE -1 END THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY ref ORDER BY e1, s1, ctg, number)),
i AS (SELECT *, sum(new) OVER (PARTITION BY ref ORDER BY e1, s1, ctg, number ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT ref, min(ctg) AS ctg, min(s1) AS s1, max(e1) AS e1, min(s2) AS s2, max(e2) AS e2, min(orient) AS orient, CAST(sum(score) AS BIGINT) AS score, count(*) AS chains FROM i GROUP BY ref, island""")
def joined_chains(spark, sf_dir):
    """Blocks of 50 references, those that follow each other on both axes joined."""
    w = Window.partitionBy("l_orderkey").orderBy("s2", "e2", "s1", "e1")
    rows = _blocks(spark, sf_dir).withColumn("number", F.row_number().over(w)).select((F.col("l_orderkey") % 50).alias("ref"), F.expr("l_orderkey div 50").alias("ctg"), *A.BLOCK, "number")
    return A.join_chains(rows)


@query(f"""WITH b AS ({_BLOCKS}), x AS (SELECT l_orderkey, s1 AS src, lead(s1) OVER (PARTITION BY l_orderkey ORDER BY s1, e1) AS dst, 1 AS axis FROM b UNION ALL SELECT l_orderkey, s1, lead(s1) OVER (PARTITION BY l_orderkey ORDER BY s2, e2, s1), 2 FROM b)
SELECT l_orderkey, src, dst, CAST(axis AS INTEGER) AS axis FROM x WHERE dst IS NOT NULL""")
def breakpoint_edges(spark, sf_dir):
    """Neighbouring blocks of each order on both axes."""
    return A.breakpoint_graph(_blocks(spark, sf_dir), ["l_orderkey"])


@query("""SELECT c_custkey, count(*) AS hits FROM customer JOIN lineitem ON l_partkey BETWEEN c_custkey AND c_custkey + 40 AND l_suppkey BETWEEN c_nationkey AND c_nationkey + 3 AND l_linenumber BETWEEN 2 AND 3 GROUP BY c_custkey""")
def box_hits(spark, sf_dir):
    """Line items in a customer's box of three dimensions."""
    boxes = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("a"), (F.col("c_custkey") + 40).alias("b"), F.col("c_nationkey").alias("c"), (F.col("c_nationkey") + 3).alias("d"), F.lit(2).alias("e"), F.lit(3).alias("f"))
    points = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    return I.box_join(points, boxes, [("l_partkey", "a", "b"), ("l_suppkey", "c", "d"), ("l_linenumber", "e", "f")], 64).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""WITH b AS ({_BLOCKS}), p AS (SELECT *, lag(e1) OVER w AS pe1, lag(orient) OVER w AS po, lag(s2) OVER w AS ps2, lag(e2) OVER w AS pe2 FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY s1, e1, s2))
SELECT l_orderkey, CAST(sum(CASE WHEN orient = po THEN 1.0 + least(10000.0, 2.0 * ((2000 - pe2) + s2)) ELSE 10001.0 + 2.0 * abs(s1 - pe1) END) AS DOUBLE) AS cost FROM p WHERE pe1 IS NOT NULL GROUP BY l_orderkey""")
def crossing_costs(spark, sf_dir):
    """Cost of each order's neighbouring blocks as if they lay on different contigs of 2000 letters."""
    w = Window.partitionBy("l_orderkey").orderBy("s1", "e1", "s2")
    rows = _blocks(spark, sf_dir).select("l_orderkey", "s1", "s2", "orient", F.lag("e1").over(w).alias("pe1"), F.lag("e2").over(w).alias("pe2"), F.lag("orient").over(w).alias("po")).where("pe1 is not null")
    return rows.groupBy("l_orderkey").agg(F.sum(E.cross_cost(F.col("s1") - F.col("pe1"), 2000 - F.col("pe2"), F.col("s2"), F.col("orient") == F.col("po"))).alias("cost"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey AS a1, l_suppkey AS a2, CAST(l_linenumber AS BIGINT) AS a3, lead(l_partkey) OVER w AS b1, lead(l_suppkey) OVER w AS b2, CAST(lead(l_linenumber) OVER w AS BIGINT) AS b3
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
d AS (SELECT *, abs(a1 - b1) AS d1, abs(a2 - b2) AS d2, abs(a3 - b3) AS d3 FROM p WHERE b1 IS NOT NULL)
SELECT l_orderkey, CAST(sum(abs(d1 - d2) + abs(d1 - d3) + abs(d2 - d3)) AS DOUBLE) AS sum_of_pairs, round(sum(ln(abs(d1 - d2) + 1.0) + ln(abs(d1 - d3) + 1.0) + ln(abs(d2 - d3) + 1.0)), 6) AS convex,
  CAST(sum(abs(a1 - b1 + a2 - b2 + a3 - b3) // 3) AS DOUBLE) AS star_avg, CAST(sum(list_sort([d1, d2, d3])[2]) AS DOUBLE) AS star_med FROM d GROUP BY l_orderkey""")
def gap_costs(spark, sf_dir):
    """Gap costs between consecutive items of each order, by model."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    point = F.array(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("bigint"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", point.alias("a"), F.lead(point).over(w).alias("b")).where("b is not null")
    cost = lambda m: E.gap_cost(F.col("a"), F.col("b"), m)
    return rows.groupBy("l_orderkey").agg(F.sum(cost("sumofpairs")).alias("sum_of_pairs"), F.round(F.sum(cost("convex")), 6).alias("convex"), F.sum(cost("star-avg")).alias("star_avg"), F.sum(cost("star-med")).alias("star_med"))


# ---------------------------------------------------------------- intervals

_SPANS = "SELECT o_custkey, o_orderkey, o_orderkey AS s, o_orderkey + CAST(floor(o_totalprice / 10) AS BIGINT) AS e FROM orders"


def _spans(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 10)).alias("e"))


@query(f"""WITH i AS ({_SPANS}) SELECT o_custkey, o_orderkey, s, e FROM i WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.o_custkey = i.o_custkey AND o.o_orderkey <> i.o_orderkey AND o.s <= i.s AND o.e >= i.e AND (o.s < i.s OR o.e > i.e OR o.o_orderkey < i.o_orderkey))""")
def containment_filter(spark, sf_dir):
    """Order intervals of a customer that no other of theirs contains."""
    return I.drop_contained(_spans(spark, sf_dir), ["o_custkey"], "s", "e", ["o_orderkey"])


@query()
def overlap_trim(spark, sf_dir):
    """Order intervals of each customer after both sides of an overlap gave it up."""
    return I.trim_overlap(_spans(spark, sf_dir), ["o_custkey"], "s", "e")


@query(f"""WITH i AS ({_SPANS}), g AS (SELECT o_custkey, s, e, coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM i)
SELECT o_custkey, upto AS gap_start, least(s, 1000000) AS gap_end FROM g WHERE upto < least(s, 1000000)
UNION ALL SELECT o_custkey, greatest(max(e), 0), 1000000 FROM i GROUP BY o_custkey HAVING max(e) < 1000000""")
def interval_complement(spark, sf_dir):
    """What a customer's order intervals leave uncovered."""
    return I.complement(_spans(spark, sf_dir), ["o_custkey"], "s", "e", F.lit(0).cast("bigint"), F.lit(1_000_000).cast("bigint"))


@query("""SELECT c_custkey, count(*) AS hits, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM customer JOIN orders ON o_orderkey >= c_custkey * 7 AND o_orderkey < c_custkey * 7 + 20 GROUP BY c_custkey""")
def interval_stab(spark, sf_dir):
    """Orders whose key lies in a customer's interval."""
    ranges = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7).alias("s"), (F.col("c_custkey") * 7 + 20).alias("e"))
    hits = I.stab_join(_t(spark, sf_dir, "orders").select("o_orderkey"), ranges, "o_orderkey", "s", "e", 64)
    return hits.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("hits"), F.sum("o_orderkey").alias("keys"))


@query(f"""WITH i AS ({_SPANS}) SELECT a.o_custkey, count(*) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS common FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND greatest(a.s, b.s) < least(a.e, b.e) GROUP BY a.o_custkey""")
def interval_overlap(spark, sf_dir):
    """Overlapping pairs among each customer's order intervals."""
    a = _spans(spark, sf_dir)
    b = a.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = I.overlap_join(a, b, "s", "e", "s2", "e2", 10_000, ["o_custkey"]).where("o_orderkey < other")
    return pairs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("common"))


# ---------------------------------------------------------------- graphs

_KINDS = "SELECT event_type, row_number() OVER (ORDER BY event_type) AS t FROM (SELECT DISTINCT event_type FROM events)"
_STEPS = f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type, t FROM events JOIN ({_KINDS}) USING (event_type)"""
_LAYERED = f"""SELECT user_id AS path, step, (user_id // 3) * 100000 + step * 10 + t AS node_id, upper(substring(event_type, 1, 3)) AS seq FROM ({_STEPS})"""


def _event_steps(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().withColumn("t", F.row_number().over(Window.orderBy("event_type")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.join(F.broadcast(kinds), "event_type").withColumn("step", F.row_number().over(w) - 1)  # a row for each event kind is broadcast


def _layered(spark, sf_dir, seq: str = "seq") -> G.Graph:
    s = _event_steps(spark, sf_dir).select(F.col("user_id").alias("path"), "step", (F.expr("user_id div 3") * 100000 + F.col("step") * 10 + F.col("t")).cast("bigint").alias("node_id"), F.upper(F.substring("event_type", 1, 3)).alias("seq"), F.lit("+").alias("orient"), F.upper("event_type").alias("name"))
    s = materialise(s, "layered")  # ordered once
    return G.Graph(s.groupBy("node_id").agg(F.first(seq).alias("seq")), s.select("path", "step", "node_id", "orient"))


_EDGE_SQL = f"""WITH s AS ({_STEPS}), p AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY step) AS dst FROM s), e AS (SELECT DISTINCT user_id, src, dst FROM p WHERE dst IS NOT NULL)
"""


def _event_edges(spark, sf_dir) -> DataFrame:
    s = _event_steps(spark, sf_dir).select(F.col("user_id").alias("path"), "step", F.col("event_type").alias("node_id"), F.lit("+").alias("orient"))
    return G.path_edges(s)


@query(_EDGE_SQL + "SELECT src, dst, count(*) AS n_paths, string_agg(user_id, ',' ORDER BY user_id) AS paths FROM e GROUP BY src, dst")
def path_edges(spark, sf_dir):
    """Transitions between event kinds with the users that make them."""
    e = _event_edges(spark, sf_dir)
    return e.select("src", "dst", F.size("paths").cast("bigint").alias("n_paths"), F.array_join(F.col("paths").cast("array<string>"), ",").alias("paths"))


@query(_EDGE_SQL + "SELECT src, dst, count(*) AS n_paths FROM e WHERE user_id % 2 = 0 GROUP BY src, dst")
def reference_edges(spark, sf_dir):
    """Transitions of the acyclic view, where odd users are original layouts."""
    e = G.acyclic_edges(_event_edges(spark, sf_dir), lambda p: p % 2 == 1)
    return e.select("src", "dst", F.size("paths").cast("bigint").alias("n_paths"))


_LAYER_EDGES = f"""WITH RECURSIVE s AS ({_LAYERED}), p AS (SELECT path, node_id AS src, lead(node_id) OVER (PARTITION BY path ORDER BY step) AS dst FROM s), e AS (SELECT DISTINCT path, src, dst FROM p WHERE dst IS NOT NULL), d AS (SELECT DISTINCT src, dst FROM e),
o AS (SELECT src, count(*) AS n FROM d GROUP BY src), i AS (SELECT dst, count(*) AS n FROM d GROUP BY dst)
"""


_COMPONENTS = """, u AS (SELECT DISTINCT a.path AS x, b.path AS y FROM s a JOIN s b USING (node_id)), u2 AS (SELECT DISTINCT u.x, w.y FROM u JOIN u w ON w.x = u.y),
k AS (SELECT u2.x AS path, min(s.node_id) AS component FROM u2 JOIN s ON s.path = u2.y GROUP BY u2.x)
"""


@query(_LAYER_EDGES + "SELECT src, dst, count(*) AS n_paths FROM e WHERE (src, dst) IN (SELECT src, dst FROM e GROUP BY src, dst HAVING bool_and(path % 2 = 1)) GROUP BY src, dst")
def structural_edges(spark, sf_dir):
    """Edges of the layered graphs that only original layouts traverse."""
    e = G.structural_edges(_layered(spark, sf_dir).edges(), lambda p: p % 2 == 1)
    return e.select("src", "dst", F.size("paths").cast("bigint").alias("n_paths"))


@query(_LAYER_EDGES + "SELECT n_paths, count(*) AS nodes, CAST(sum(length(seq)) AS BIGINT) AS length FROM (SELECT node_id, max(seq) AS seq, count(DISTINCT path) AS n_paths FROM s GROUP BY node_id) GROUP BY n_paths")
def shared_by_n(spark, sf_dir):
    """How many nodes exactly n users share."""
    return G.shared_by(_layered(spark, sf_dir))


@query(_LAYER_EDGES + """SELECT count(*) AS nodes, CAST(sum(length(seq)) AS BIGINT) AS length, """ + ", ".join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS n_{b.lower()}" for b in "ACGTN") + " FROM (SELECT node_id, max(seq) AS seq FROM s GROUP BY node_id)")
def graph_stats(spark, sf_dir):
    """Letters over all nodes of the layered graphs."""
    return G.node_stats(_layered(spark, sf_dir))


@query(_LAYER_EDGES + ", u AS (SELECT node_id AS n, coalesce(o.n, 0) AS outs, coalesce(i.n, 0) AS ins FROM (SELECT DISTINCT node_id FROM s) LEFT JOIN o ON o.src = node_id LEFT JOIN i ON i.dst = node_id) SELECT outs, ins, count(*) AS nodes FROM u GROUP BY outs, ins")
def node_degrees(spark, sf_dir):
    """How many nodes have which degrees."""
    g = _layered(spark, sf_dir)
    e = g.edges().select("src", "dst").distinct()
    outs, ins = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("outs")), e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("ins"))
    rows = g.nodes.join(outs, "node_id", "left").join(ins, "node_id", "left")
    return rows.groupBy(F.coalesce("outs", F.lit(0)).alias("outs"), F.coalesce("ins", F.lit(0)).alias("ins")).agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def order_components(spark, sf_dir):
    """Components of the graph that links consecutive orders of a customer."""
    ship(spark)
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"))
    return connected_components(edges)


_BUBBLES = """, mid AS (SELECT o.src AS m FROM o JOIN i ON i.dst = o.src WHERE o.n = 1 AND i.n = 1),
ways AS (SELECT a.src AS source, b.dst AS sink, a.dst AS m FROM d a JOIN mid ON mid.m = a.dst JOIN d b ON b.src = a.dst UNION ALL SELECT src, dst, NULL FROM d),
bub AS (SELECT source, sink, count(*) AS ways, string_agg(m, ',' ORDER BY m) AS inner_nodes FROM ways GROUP BY source, sink HAVING count(*) >= 2 AND count(*) = (SELECT n FROM o WHERE o.src = source) AND count(*) = (SELECT n FROM i WHERE i.dst = sink))
"""


@query(_LAYER_EDGES + _BUBBLES + "SELECT source, sink, coalesce(inner_nodes, '') AS inner_nodes FROM bub")
def simple_bubbles(spark, sf_dir):
    """Simple bubbles of the layered graphs."""
    return B.simple_bubbles(_layered(spark, sf_dir).edges()).select("source", "sink", F.array_join(F.col("inner").cast("array<string>"), ",").alias("inner_nodes"))


_ALLELES = _BUBBLES + """, al AS (SELECT bub.source, bub.sink, a.path, coalesce(x.seq, '-') AS allele FROM bub JOIN s a ON a.node_id = bub.source JOIN s b ON b.node_id = bub.sink AND b.path = a.path AND b.step - a.step IN (1, 2) LEFT JOIN s x ON x.path = a.path AND x.step = a.step + 1 AND b.step - a.step = 2),
g AS (SELECT source, sink, allele, min(path) AS first, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM al GROUP BY source, sink, allele),
v AS (SELECT source, sink, allele, first, paths, count(*) OVER w AS n_alleles, max(CASE WHEN allele = '-' THEN 1 ELSE 0 END) OVER w AS direct, max(length(allele)) OVER w AS longest, min(first) OVER w = first AS reference FROM g WINDOW w AS (PARTITION BY source, sink)),
t AS (SELECT source, sink, allele, n_alleles, CASE WHEN direct = 1 THEN 'indel' WHEN n_alleles = 2 AND longest = 1 THEN 'snp' WHEN n_alleles = 2 THEN 'region' ELSE 'multi-allelic' END AS type,
  CAST(row_number() OVER (PARTITION BY source, sink ORDER BY reference DESC, allele) - 1 AS INTEGER) AS allele_index, paths FROM v)
"""


@query(_LAYER_EDGES + _ALLELES + "SELECT source, sink, allele, n_alleles, type, allele_index, paths FROM t")
def variants(spark, sf_dir):
    """Alleles of the simple bubbles with their users."""
    return B.variants(_layered(spark, sf_dir)).withColumn("paths", F.array_join(F.col("paths").cast("array<string>"), ","))


@query(_LAYER_EDGES + _ALLELES + ", c AS (SELECT source, sink, type, allele_index, CAST(unnest(string_split(paths, ',')) AS BIGINT) % 3 AS lane FROM t) SELECT source, sink, type, " + ", ".join(f"min(allele_index) FILTER (WHERE lane = {i}) AS lane_{i}" for i in range(3)) + " FROM c GROUP BY source, sink, type")
def variant_calls(spark, sf_dir):
    """Variants by path, the three users of a graph in columns."""
    found = B.variants(_layered(spark, sf_dir)).withColumn("paths", F.transform("paths", lambda p: F.concat(F.lit("lane_"), (p % 3).cast("string"))))
    return B.calls(found, ["lane_0", "lane_1", "lane_2"])


_REGIONS = """, vis AS (SELECT node_id, min(step) AS step, list_sort(list(path)) AS p FROM s GROUP BY node_id),
meet AS (SELECT x.node_id AS source, y.step, min(y.node_id) AS node FROM s x JOIN s y ON x.path = y.path AND y.step > x.step GROUP BY x.node_id, y.step HAVING count(DISTINCT y.node_id) = 1 AND count(*) = (SELECT len(p) FROM vis v WHERE v.node_id = x.node_id)),
first_ AS (SELECT source, arg_min(node, step) AS sink, min(step) AS upto FROM meet GROUP BY source),
span_ AS (SELECT source, sink, upto, v.p, v.step FROM first_ JOIN vis v ON v.node_id = source JOIN vis w ON w.node_id = sink WHERE v.p = w.p AND upto > v.step + 1),
mid AS (SELECT g.source, g.sink, s.node_id, any_value(g.p) AS p FROM span_ g JOIN s ON s.path = g.p[1] OR list_contains(g.p, s.path) WHERE s.step > g.step AND s.step < g.upto GROUP BY g.source, g.sink, s.node_id),
reg AS (SELECT source, sink, string_agg(mid.node_id, ',' ORDER BY mid.node_id) AS "inner" FROM mid JOIN vis v USING (node_id) GROUP BY source, sink HAVING bool_and(list_has_all(mid.p, v.p)))
"""


@query(_LAYER_EDGES + _COMPONENTS + _REGIONS + "SELECT DISTINCT component, source, sink, \"inner\" FROM reg JOIN s ON s.node_id = source JOIN k USING (path)")
def superbubbles(spark, sf_dir):
    """Superbubbles of the layered graphs, nested ones included."""
    return B.superbubbles(_layered(spark, sf_dir)).withColumn("inner", F.array_join(F.col("inner").cast("array<string>"), ","))


_SKIPPED = f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY step) - 1 AS step, node_id, seq FROM ({_LAYERED}) WHERE path % 3 <> 1 OR step % 4 <> 1"""


def _skipping(spark, sf_dir) -> G.Graph:
    """The layered graphs where every third user leaves out every fourth step, so that there are indels."""
    g = _layered(spark, sf_dir)
    w = Window.partitionBy("path").orderBy("step")
    steps = g.steps.where("path % 3 <> 1 or step % 4 <> 1").withColumn("step", F.row_number().over(w) - 1)
    return G.Graph(g.nodes.join(steps.select("node_id").distinct(), "node_id", "left_semi"), steps)


_REPORT = _LAYER_EDGES.replace(_LAYERED, _SKIPPED) + _ALLELES + """, offs AS (SELECT path, step, node_id, length(seq) AS n, coalesce(sum(length(seq)) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
pos AS (SELECT bub.source, bub.sink, min(a.path) AS reference, CAST(arg_min(a.o + a.n, a.path) AS BIGINT) AS pos_start, CAST(arg_min(b.o, a.path) AS BIGINT) AS pos_end FROM bub JOIN offs a ON a.node_id = bub.source JOIN offs b ON b.node_id = bub.sink AND b.path = a.path AND b.step > a.step GROUP BY bub.source, bub.sink),
size AS (SELECT source, sink, type, max(CASE WHEN allele = '-' THEN 0 ELSE length(allele) END) AS max_size, min(CASE WHEN allele = '-' THEN 0 ELSE length(allele) END) AS min_size, string_agg(allele, ',' ORDER BY allele_index) AS genotypes,
  string_agg(CASE WHEN allele = '-' THEN '' ELSE allele END, '|' ORDER BY allele_index) AS texts FROM t GROUP BY source, sink, type)
"""


@query(_REPORT + "SELECT reference, pos_start, pos_end, source, sink, max_size, min_size, type, genotypes FROM size JOIN pos USING (source, sink)")
def variant_table(spark, sf_dir):
    """Variants of the layered graphs with sizes, and places on the first user that passes."""
    r = B.variant_report(_skipping(spark, sf_dir))
    return r.select("reference", "pos_start", "pos_end", "source", "sink", "max_size", "min_size", "type", F.array_join("genotypes", ",").alias("genotypes"))


@query(_REPORT + "SELECT reference, pos_start, pos_end, source, sink FROM size JOIN pos USING (source, sink) WHERE max_size - min_size >= 1 AND type = 'indel'")
def filtered_variants(spark, sf_dir):
    """Indels of the layered graphs that differ in size."""
    return B.variant_report(_skipping(spark, sf_dir), min_diff=1, kind="indel").select("reference", "pos_start", "pos_end", "source", "sink")


@query(_REPORT + """, m AS (SELECT node_id, max(seq) AS seq FROM s GROUP BY node_id), f AS (SELECT *, max_size > min_size AS differ, right(m.seq, 1) AS base FROM size JOIN pos USING (source, sink) JOIN m ON m.node_id = source),
h AS (SELECT *, list_transform(string_split(texts, '|'), lambda x: CASE WHEN differ THEN base || x ELSE x END) AS a, CASE WHEN differ THEN pos_start ELSE pos_start + 1 END AS p FROM f)
SELECT concat_ws(chr(9), reference, p, '.', a[1], array_to_string(a[2:], ','), '.', 'PASS', 'diffsize=' || (max_size - min_size) || ';source=' || source || ';sink=' || sink || ';bubbletype=' || type || ';start=' || p || ';end=' || pos_end, 'GT:SZ') AS line FROM h""")
def vcf_records(spark, sf_dir):
    """All variants of the layered graphs as VCF lines."""
    return B.vcf_lines(B.variant_report(_skipping(spark, sf_dir)), [])


@query(_LAYER_EDGES + _COMPONENTS + _BUBBLES + """, z AS (SELECT component, node_id, count(*) AS visits, count(DISTINCT s.path) AS paths, max(length(seq)) AS n FROM s JOIN k USING (path) GROUP BY component, node_id),
w AS (SELECT component, count(DISTINCT path) AS k, string_agg(DISTINCT CAST(path AS VARCHAR), ',') AS p FROM s JOIN k USING (path) GROUP BY component),
c AS (SELECT component, count(*) FILTER (WHERE visits = k AND paths = k) AS chain_nodes, CAST(coalesce(sum(n * k * (k - 1) // 2) FILTER (WHERE visits = k AND paths = k), 0) AS BIGINT) AS chain_weight, count(*) AS nodes, max(k) AS users FROM z JOIN w USING (component) GROUP BY component),
y AS (SELECT component, count(*) AS simple_bubbles FROM bub JOIN (SELECT DISTINCT node_id, component FROM s JOIN k USING (path)) ON node_id = source GROUP BY component)
SELECT component, nodes, users, coalesce(simple_bubbles, 0) AS simple_bubbles, chain_nodes, chain_weight FROM c LEFT JOIN y USING (component)""")
def component_stats(spark, sf_dir):
    """Nodes, users, simple bubbles and the chain of common nodes of each component of the layered graphs."""
    g = _layered(spark, sf_dir)
    rows = B.component_stats(g, B.marked_bubbles(g))
    return rows.select("component", "nodes", F.size(F.split("paths", ",")).cast("bigint").alias("users"), "simple_bubbles", "chain_nodes", "chain_weight")


@query()
def indel_wiggles(spark, sf_dir):
    """How far indels of the layered graphs can move."""
    return B.indel_wiggle(_skipping(spark, sf_dir))


@query(_LAYER_EDGES + "SELECT path, length(seq) AS n, md5(seq) AS digest FROM (SELECT path, string_agg(seq, '' ORDER BY step) AS seq FROM s GROUP BY path)")
def extract_paths(spark, sf_dir):
    """The sequence of every path."""
    return G.extract(_layered(spark, sf_dir)).select("path", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


@query(_LAYER_EDGES + "SELECT path, count(*) AS steps, CAST(max(o) AS BIGINT) AS last_offset, CAST(sum(o) AS BIGINT) AS total FROM (SELECT path, coalesce(sum(length(seq)) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s) GROUP BY path")
def path_offsets(spark, sf_dir):
    """Running offsets along every path."""
    return G.offsets(_layered(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("steps"), F.max("offset").alias("last_offset"), F.sum("offset").alias("total"))


@query(_LAYER_EDGES + "SELECT DISTINCT node_id FROM (SELECT path, node_id, seq, coalesce(sum(length(seq)) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s) WHERE path = 1 AND o < 60 AND o + length(seq) > 12")
def subgraph_range(spark, sf_dir):
    """Nodes that user 1 visits in an offset range."""
    return G.subgraph(_layered(spark, sf_dir), 1, 12, 60).nodes.select("node_id")


def _private(spark, sf_dir) -> G.Graph:
    """Graphs of three users where every step is a node of its own, after one that they share."""
    s = _event_steps(spark, sf_dir).select(F.col("user_id").alias("path"), (F.col("step") + 1).alias("step"), (F.col("user_id") * 100000 + F.col("step") + 1).cast("bigint").alias("node_id"), F.upper(F.substring("event_type", 1, 3)).alias("seq"))
    first = s.select("path").distinct().select("path", F.lit(0).alias("step"), (-F.expr("path div 3") - 1).cast("bigint").alias("node_id"), F.lit("<").alias("seq"))
    s = s.unionByName(first).withColumn("orient", F.lit("+"))
    return G.Graph(s.groupBy("node_id").agg(F.first("seq").alias("seq")), s.select("path", "step", "node_id", "orient"))


@query(f"""WITH p AS (SELECT user_id // 3 AS family, string_agg(upper(substring(event_type, 1, 3)), '' ORDER BY step) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS prefix FROM ({_STEPS}))
SELECT family, count(DISTINCT prefix) + 1 AS nodes FROM p GROUP BY family""")
def pruned_nodes(spark, sf_dir):
    """Nodes of each three users' graph after equal siblings were merged: as many as their sequences have different beginnings."""
    g = G.prune(_private(spark, sf_dir))
    family = g.steps.select(F.expr("path div 3").alias("family"), "node_id").distinct()
    return family.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"))


_UNARY = """, v AS (SELECT node_id, lead(node_id) OVER (PARTITION BY path ORDER BY step) AS a, lag(node_id) OVER (PARTITION BY path ORDER BY step) AS b FROM s),
x AS (SELECT node_id, min(a) AS a, min(b) AS b, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, count(*) - count(a) AS ea, count(*) - count(b) AS eb FROM v GROUP BY node_id),
l AS (SELECT x.node_id AS src, x.a AS dst FROM x JOIN x y ON y.node_id = x.a AND y.b = x.node_id WHERE x.na = 1 AND x.ea = 0 AND y.nb = 1 AND y.eb = 0),
q AS (SELECT node_id, max(seq) AS seq FROM s GROUP BY node_id),
r AS (SELECT node_id AS head, node_id AS at, seq, 1 AS n FROM q WHERE node_id NOT IN (SELECT dst FROM l) UNION ALL SELECT head, dst, r.seq || q.seq, n + 1 FROM r JOIN l ON l.src = r.at JOIN q ON q.node_id = l.dst)
"""


@query(_LAYER_EDGES + _UNARY + "SELECT head AS node_id, arg_max(seq, n) AS seq FROM r GROUP BY head")
def contracted_nodes(spark, sf_dir):
    """Nodes that are left after unary stretches were collapsed."""
    return G.contract(_layered(spark, sf_dir)).nodes


@query(_LAYER_EDGES + _COMPONENTS + "SELECT component, CAST(max(3 * (step + 1)) AS BIGINT) AS length, max(step) + 1 AS nodes FROM s JOIN k USING (path) GROUP BY component")
def longest_paths(spark, sf_dir):
    """Length and nodes of the longest path of each layered graph."""
    return G.longest_path(_layered(spark, sf_dir)).select("component", "length", F.size("path").cast("bigint").alias("nodes"))


@query(_LAYER_EDGES + _COMPONENTS + """SELECT component, string_agg(DISTINCT CAST(path AS VARCHAR), '_' ORDER BY CAST(path AS VARCHAR)) AS name, count(DISTINCT node_id) AS nodes FROM s JOIN k USING (path) GROUP BY component""")
def split_components(spark, sf_dir):
    """Components of the layered graphs, named by their users."""
    g = _layered(spark, sf_dir)
    text = G.Graph(g.nodes, g.steps.withColumn("path", F.col("path").cast("string")))
    return G.named_components(text).groupBy("component", "name").agg(F.count(F.lit(1)).alias("nodes"))


@query(_LAYER_EDGES + _COMPONENTS + """SELECT (SELECT count(DISTINCT node_id) FROM s) AS nodes, (SELECT count(*) FROM d) AS edges, (SELECT count(DISTINCT path) FROM s WHERE path % 2 = 0) AS samples, (SELECT count(DISTINCT component) FROM k) AS components,
(SELECT count(*) FROM (SELECT src, dst FROM e GROUP BY src, dst HAVING bool_and(path % 2 = 1))) AS structural_edges""")
def graph_counts(spark, sf_dir):
    """Nodes, edges, samples, components and structural edges of the layered graphs, where odd users are original layouts."""
    return G.graph_counts(_layered(spark, sf_dir), lambda p: p % 2 == 1)


@query(_LAYER_EDGES + "SELECT DISTINCT node_id, CAST(3 * step AS BIGINT) AS layer_offset FROM s")
def node_layers(spark, sf_dir):
    """Longest distance of every node from a start."""
    return X.layers(_layered(spark, sf_dir))


_WORDS = f"WITH s AS (SELECT path, step, upper(event_type) AS seq FROM (SELECT user_id AS path, step, event_type FROM ({_STEPS}))), x AS (SELECT path, string_agg(seq, '' ORDER BY step) AS seq FROM s GROUP BY path) "
_PATHS = _WORDS + "SELECT path, length(seq) AS n, md5(seq) AS digest FROM x"


def _wordy(spark, sf_dir) -> G.Graph:
    """The layered graphs with whole event names as node sequences."""
    return _layered(spark, sf_dir, "name")


def _path_digests(g: G.Graph) -> DataFrame:
    return G.extract(g).select("path", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


@query(_PATHS)
def unzipped_paths(spark, sf_dir):
    """Path sequences after flanks of bubbles moved into alleles: they stay the same."""
    return _path_digests(X.unzip(_wordy(spark, sf_dir), 2))


@query(_PATHS)
def refined_paths(spark, sf_dir):
    """Path sequences after alleles were realigned: they stay the same."""
    return _path_digests(X.refine(_wordy(spark, sf_dir)))


@query(_PATHS)
def contracted_paths(spark, sf_dir):
    """Path sequences after unary stretches were collapsed: they stay the same."""
    return _path_digests(G.contract(_wordy(spark, sf_dir)))


@query(_WORDS + "SELECT path, length(seq) AS n, md5(reverse(translate(seq, 'ACGTURYKMBVDH', 'TGCAAYRMKVBHD'))) AS digest FROM x")
def complement_paths(spark, sf_dir):
    """Path sequences of the reverse-complement graph."""
    return _path_digests(G.complement(_wordy(spark, sf_dir)))


@query(_WORDS + "SELECT count(DISTINCT substring(seq, i, 12)) AS kmers FROM (SELECT seq, unnest(range(1, length(seq) - 10)) AS i FROM x)")
def chopped_kmers(spark, sf_dir):
    """Letters of the overlap graph as 12-mers: as many as the paths have different ones."""
    nodes, _ = X.chop(_wordy(spark, sf_dir), 12)
    return nodes.agg(F.sum(F.length("seq").cast("bigint") - 11).alias("kmers"))


@query("""WITH b AS (SELECT item_id, text FROM benchmark), v AS (SELECT item_id || 'a' AS path, text AS seq FROM b UNION ALL SELECT item_id || 'b', substring(text, 1, 40) || 'XX' || substring(text, 61) FROM b WHERE length(text) > 80)
SELECT path, length(seq) AS n, md5(seq) AS digest FROM v""")
def aligned_paths(spark, sf_dir):
    """Recursive alignment of every item with an edited copy: the paths give the texts back."""
    return _path_digests(_aligned_items(spark, sf_dir))


def _aligned_items(spark, sf_dir) -> G.Graph:
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("group"), "text")
    edited = b.where("length(text) > 80").select("group", F.concat("group", F.lit("b")).alias("path"), F.expr("substring(text, 1, 40) || 'XX' || substring(text, 61)").alias("seq"))
    return X.recursive_align(b.select("group", F.concat("group", F.lit("a")).alias("path"), F.col("text").alias("seq")).unionByName(edited), k=12)


@query("""WITH b AS (SELECT item_id, length(text) AS n FROM benchmark WHERE length(text) > 80)
SELECT item_id, n >= 72 AND n - 60 >= 12 AS ends_shared FROM b""")
def aligned_ends(spark, sf_dir):
    """Whether the alignment of an item with its edited copy shares the first and the last node, as their equal ends say."""
    g = _aligned_items(spark, sf_dir)
    ends = g.steps.groupBy("path").agg(F.min_by("node_id", "step").alias("first"), F.max_by("node_id", "step").alias("last"))
    item = ends.select(F.expr("cast(substring(path, 1, length(path) - 1) as bigint)").alias("item_id"), F.substring("path", -1, 1).alias("copy"), "first", "last")
    a, b = (item.where(F.col("copy") == c).select("item_id", F.col("first").alias(f"f{c}"), F.col("last").alias(f"l{c}")) for c in "ab")
    return a.join(b, "item_id").select("item_id", ((F.col("fa") == F.col("fb")) & (F.col("la") == F.col("lb"))).alias("ends_shared"))


@query()
def simulated_accuracy(spark, sf_dir):
    """Sensitivity and precision of recursive alignment on simulated genomes."""
    ship(spark)
    seqs, truth = simulate.genomes(spark, 3, 500, 0.03, seed=7)
    return simulate.accuracy(simulate.aligned_columns(X.recursive_align(seqs, k=12)), truth)


@query("""WITH c AS (SELECT doc_id, i, l[i] AS ch FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, '') AS l FROM documents))),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c WHERE ch = 'e')
SELECT doc_id, min(i) - 1 AS "start", max(i) AS "end" FROM g GROUP BY doc_id, k HAVING count(*) >= 2""")
def letter_runs(spark, sf_dir):
    """Runs of two or more of one letter in documents, as gaps are runs of N."""
    return X.letter_runs(_t(spark, sf_dir, "documents"), "doc_id", "text", "e", 2)


@query(f"""WITH p AS ({_POINTS}) SELECT s1 AS x1, CASE WHEN orient = 0 THEN s2 ELSE s2 + length END AS y1, s1 + length AS x2, CASE WHEN orient = 0 THEN s2 + length ELSE s2 END AS y2 FROM p""")
def dotplot(spark, sf_dir):
    """Line segments of a dot plot of the suppliers' points."""
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1"), (F.col("l_orderkey") - F.col("l_partkey") % 5 + 10).alias("s2"), F.col("l_quantity").cast("bigint").alias("length"), (F.col("l_linenumber") % 2).alias("orient"))
    return X.dotplot_points(p)


@query(_LAYER_EDGES + """SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line UNION ALL SELECT 'S' || chr(9) || node_id || chr(9) || max(seq) FROM s GROUP BY node_id
UNION ALL SELECT 'L' || chr(9) || src || chr(9) || '+' || chr(9) || dst || chr(9) || '+' || chr(9) || '0M' FROM d
UNION ALL SELECT 'P' || chr(9) || path || chr(9) || string_agg(node_id || '+', ',' ORDER BY step) || chr(9) || array_to_string(list_transform(range(count(*) - 1), lambda x: '0M'), ',') FROM s GROUP BY path""")
def gfa_records(spark, sf_dir):
    """The layered graphs as GFA lines."""
    return S.gfa_lines(_layered(spark, sf_dir))


@query(f"WITH i AS ({_SPANS}) SELECT o_custkey || chr(9) || s || chr(9) || e || chr(9) || o_orderkey AS line FROM i")
def bed_records(spark, sf_dir):
    """Order intervals as BED lines."""
    return S.bed_lines(_spans(spark, sf_dir), ["o_custkey", "s", "e", "o_orderkey"])


@query("""WITH c AS (SELECT p_size, CAST(p_partkey AS VARCHAR) AS path, i, substring(p_brand, i, 1) AS base FROM (SELECT *, unnest(range(1, length(p_brand) + 1)) AS i FROM part)),
n AS (SELECT p_size, i, base, string_agg(path, ',' ORDER BY path) AS paths FROM c WHERE base <> '-' GROUP BY p_size, i, base),
r AS (SELECT *, i - row_number() OVER (PARTITION BY p_size, paths ORDER BY i) AS run FROM n)
SELECT p_size, md5(paths) AS paths, min(i) - 1 AS start, count(*) AS length, string_agg(base, '' ORDER BY i) AS seq FROM r GROUP BY p_size, paths, run""")
def alignment_nodes(spark, sf_dir):
    """Nodes of the alignments of brand names of equal part size."""
    rows = _t(spark, sf_dir, "part").select("p_size", F.col("p_partkey").cast("string").alias("path"), "p_brand")
    return msa.columns_to_nodes(rows, "p_size", "path", "p_brand").withColumn("paths", F.md5("paths"))


@query()
def aligned_regions(spark, sf_dir):
    """Multiple alignments of the distinct region and nation names of each region."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("bubble"), F.col("n_name").alias("path"), F.col("n_name").alias("seq"))
    return msa.align_alleles(n, "bubble").withColumn("conf", F.array_join(F.col("conf").cast("array<string>"), ","))


@query("""WITH b AS (SELECT item_id, text, length(text) // 2 AS h FROM benchmark)
SELECT CAST(item_id AS VARCHAR) AS ref, CAST(item_id AS VARCHAR) AS ctg, CAST(0 AS INTEGER) AS orient, h AS s1, length(text) AS e1 FROM b WHERE length(text) - h >= 50""")
def placed_contigs(spark, sf_dir):
    """Second halves of benchmark items placed on the items."""
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("seq"))
    halves = b.select("name", F.expr("substring(seq, int(length(seq) div 2) + 1)").alias("seq"))
    return L.place_contigs(b, halves, k=20, stop="").select("ref", "ctg", "orient", "s1", "e1")


# ---------------------------------------------------------------- measures and classes

@query("""WITH c AS (SELECT CAST(count(*) FILTER (WHERE p AND y) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p AND NOT y) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE NOT p AND y) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT p AND NOT y) AS DOUBLE) AS tn
FROM (SELECT quality = 0 AS y, text LIKE '%!!%' OR text LIKE '%| %' OR text LIKE '%&&&%' AS p FROM labels JOIN documents USING (doc_id)))
SELECT tp, fp, fn, tn, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fp), 9) AS precision, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def confusion(spark, sf_dir):
    """How well three marks of junk agree with the quality labels."""
    t = F.col("text")
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id").select((F.col("quality") == 0).alias("y"), (t.contains("!!") | t.contains("| ") | t.contains("&&&")).alias("p"))
    count = lambda c: F.count_if(F.expr(c)).cast("double")
    c = rows.agg(count("p and y").alias("tp"), count("p and not y").alias("fp"), count("not p and y").alias("fn"), count("not p and not y").alias("tn"))
    return c.select("*", F.round(F.expr("try_divide(tp, tp + fn)"), 9).alias("sensitivity"), F.round(F.expr("try_divide(tn, tn + fp)"), 9).alias("specificity"), F.round(F.expr("try_divide(tp, tp + fp)"), 9).alias("precision"), F.round(F.expr("try_divide(2 * tp, 2 * tp + fp + fn)"), 9).alias("f1"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def best_hits(spark, sf_dir):
    """The event of highest value of each user; ties keep the first."""
    best = F.min(F.struct((-F.col("value")).alias("v"), "event_id", "event_type", "value")).alias("b")
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(best).select("user_id", "b.event_id", "b.event_type", "b.value")


@query("""SELECT p_partkey, CASE WHEN p_size / 50.0 > 0.8 AND p_size / 45.0 > 0.8 AND p_brand <> 'Satellite' THEN 'mei' WHEN p_size / 40.0 > 0.5 THEN
CASE WHEN p_partkey % 1200 = 1 THEN 'homopolymer' WHEN p_partkey % 1200 <= 6 THEN 'microsatellite' WHEN p_partkey % 1200 < 100 THEN 'minisatellite' WHEN p_partkey % 1200 < 1000 THEN 'macrosatellite' ELSE 'megasatellite' END ELSE 'other' END AS class FROM part""")
def repeat_classes(spark, sf_dir):
    """Repeat classes from coverage-like measures of parts."""
    size = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", E.repeat_class(size / 50.0, size / 45.0, F.col("p_brand"), size / 40.0, F.col("p_partkey") % 1200).alias("class"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) + l_linenumber AS BIGINT) AS n FROM lineitem")
def cigar_lengths(spark, sf_dir):
    """Lengths of CIGAR strings made of quantity and line number."""
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M3D"), F.col("l_linenumber").cast("string"), F.lit("I"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.cigar_length(cigar).alias("n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Hourly counts of events, run as a stream over the table's files."""
    out = stream.drained(spark, sf_dir, "events", stream.windowed, ["window_start", "event_type"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island""")
def event_sessions(spark, sf_dir):
    """Sessions of each user, six hours or more apart."""
    out = stream.sessions(_t(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", "total")


@query("""WITH h AS (SELECT p_brand AS name, p_size AS score, p_partkey AS qbegin, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) SELECT name, score, qbegin FROM h WHERE k = 1""")
def best_annotations(spark, sf_dir):
    """The part of largest size of each brand; ties keep the first key."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("score"), F.col("p_partkey").alias("qbegin"))
    return annotate.best_hits(rows, "name", "score", ["qbegin"])


@query("SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def unplaced_contigs(spark, sf_dir):
    """Orders without a large line item."""
    placed = _t(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("ctg"))
    return A.unplaced(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name")), placed)


# ---------------------------------------------------------------- graphs aligned with graphs

_COPIES = """b AS (SELECT item_id, text FROM benchmark WHERE length(text) > 80),
v AS (SELECT item_id || 'a' AS path, text AS seq FROM b UNION ALL SELECT item_id || 'b', substring(text, 1, 40) || 'XX' || substring(text, 61) FROM b
  UNION ALL SELECT item_id || 'c', substring(text, 1, 25) || 'YY' || substring(text, 31) FROM b)"""


def _third_copies(spark, sf_dir) -> G.Graph:
    """The graphs of all items with an edited copy, each aligned with a third copy that is edited elsewhere."""
    b = _t(spark, sf_dir, "benchmark").where("length(text) > 80").select(F.col("item_id").cast("string").alias("group"), "text")
    third = b.select(F.concat("group", F.lit("c")).alias("path"), F.expr("substring(text, 1, 25) || 'YY' || substring(text, 31)").alias("seq"))
    base = _aligned_items(spark, sf_dir)
    group = base.steps.select("path").distinct().unionByName(third.select("path")).select("path", F.expr("substring(path, 1, length(path) - 1)").alias("group"))
    return GA.align_graphs(base, GA.linear(third), 12, group)


@query(f"""WITH {_COPIES} SELECT path, length(seq) AS n, md5(seq) AS digest, right(path, 1) <> 'c' OR length(seq) > 2 AS shared FROM v""")
def graph_aligned_paths(spark, sf_dir):
    """Third copies aligned onto the graph of the first two: every path gives its text back, and all letters of a third copy that the item has are on nodes that they share, but for those beside an edit."""
    g = _third_copies(spark, sf_dir)
    size = g.nodes.select("node_id", F.length("seq").alias("n"))
    visits = g.steps.select("path", "node_id").distinct()
    first = visits.where("path like '%a'").select("node_id").distinct()
    own = visits.join(first, "node_id").join(size, "node_id").groupBy("path").agg(F.sum("n").alias("common"))
    rows = _path_digests(g).join(own, "path", "left")
    return rows.select("path", "n", "digest", (~F.endswith("path", F.lit("c")) | (F.coalesce("common", F.lit(0)) >= F.col("n") - 2)).alias("shared"))


_AROUND = ", al AS (SELECT node_id FROM s GROUP BY node_id HAVING count(DISTINCT path) >= 2)" + "".join(f""",
{n} AS (SELECT al.node_id AS source, d.{there} AS node FROM al JOIN d ON d.{here} = al.node_id UNION SELECT {n}.source, d.{there} FROM {n} JOIN d ON d.{here} = {n}.node WHERE {n}.node NOT IN (FROM al)),
{n}_end AS (SELECT source, node FROM {n} WHERE node IN (FROM al)), {n}_many AS (SELECT source FROM {n}_end GROUP BY source HAVING count(*) > 1),
{n}_home AS (SELECT e.source, d.{here} AS node FROM {n}_end e JOIN {n}_many USING (source) JOIN d ON d.{there} = e.node
  UNION SELECT h.source, d.{here} FROM {n}_home h JOIN d ON d.{there} = h.node WHERE h.node NOT IN (FROM al) OR (h.source, h.node) IN (FROM {n}_end))""" for n, here, there in (("after_", "src", "dst"), ("before_", "dst", "src")))


@query(_LAYER_EDGES + _AROUND + " UNION ALL ".join(f" SELECT source, node AS node_id, '{part}' AS part FROM {n} WHERE node NOT IN (FROM al) AND (source NOT IN (FROM {n}_many) OR (source, node) IN (FROM {n}_home))" for n, part in (("after_", "trailing"), ("before_", "leading"))))
def anchor_segments(spark, sf_dir):
    """What leads to and trails every node that two users or more share, up to the next such nodes."""
    g = _layered(spark, sf_dir)
    aligned = g.steps.groupBy("node_id").agg(F.count_distinct("path").alias("n")).where("n >= 2").select("node_id")
    return GA.segments(g.edges(), aligned, aligned)


@query(_LAYER_EDGES + """, v AS (SELECT node_id, count(*) AS visits, count(DISTINCT path) AS paths, max(length(seq)) AS n FROM s GROUP BY node_id)
SELECT CAST(sum(n * visits) AS BIGINT) AS letters, CAST(sum(CASE WHEN paths > 1 THEN n * visits ELSE 0 END) AS BIGINT) AS aligned, 100 * sum(CASE WHEN paths > 1 THEN n * visits ELSE 0 END) / sum(n * visits) AS share FROM v""")
def alignment_identity(spark, sf_dir):
    """Letters of the layered graphs that two users or more share."""
    return GA.identity(_layered(spark, sf_dir))


# ---------------------------------------------------------------- as-of joins, subtraction, masks

@query("""WITH p AS (SELECT user_id, ts AS mark_ts, max(event_id) AS mark_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, p.mark_id FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.mark_ts""")
def last_purchases(spark, sf_dir):
    """Every event with its user's last purchase by then."""
    e = _t(spark, sf_dir, "events")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("mark_ts"), F.col("event_id").alias("mark_id"))
    return I.asof_join(e.select("user_id", "ts", "event_id"), marks, "ts", "mark_ts", ["user_id"], "left").select("event_id", "mark_id")


_LEFT_OVER = f"""WITH i AS (SELECT i.*, o_orderstatus FROM ({_SPANS}) i JOIN orders USING (o_orderkey)), l AS (SELECT * FROM i WHERE o_orderstatus = 'F' AND s < e), r AS (SELECT * FROM i WHERE o_orderstatus <> 'F'),
c AS (SELECT l.o_orderkey, l.s AS ls, l.e AS le, greatest(l.s, r.s) AS s, least(l.e, r.e) AS e FROM l JOIN r ON l.o_custkey = r.o_custkey AND r.s < l.e AND r.e > l.s),
g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY o_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ls) AS upto FROM c),
x AS (SELECT o_orderkey, upto AS s, s AS e FROM g WHERE upto < s UNION ALL SELECT o_orderkey, max(e), le FROM c GROUP BY o_orderkey, le HAVING max(e) < le UNION ALL SELECT o_orderkey, s, e FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c))
"""


def _finished(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _spans(spark, sf_dir).join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return rows.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "s", "e"), rows.where("o_orderstatus <> 'F'").select("o_custkey", F.col("s").alias("s2"), F.col("e").alias("e2"))


@query(_LEFT_OVER + "SELECT o_orderkey, s, e FROM x UNION ALL SELECT o_orderkey, NULL, NULL FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x)")
def interval_subtract(spark, sf_dir):
    """What a customer's other orders leave of the intervals of finished ones; covered ones without bounds."""
    return I.subtract(*_finished(spark, sf_dir), "s", "e", "s2", "e2", 10_000, ["o_custkey"], "outer").select("o_orderkey", "s", "e")


@query(_LEFT_OVER + "SELECT o_orderkey, s, e FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)")
def interval_anti(spark, sf_dir):
    """Finished orders whose interval no other order of the customer touches."""
    return I.subtract(*_finished(spark, sf_dir), "s", "e", "s2", "e2", 10_000, ["o_custkey"], "anti").select("o_orderkey", "s", "e")


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_orderkey >= c_custkey * 17 AND o_orderkey < c_custkey * 17 + 5)""")
def interval_stab_anti(spark, sf_dir):
    """Orders whose key lies in no customer's interval."""
    ranges = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 17).alias("s"), (F.col("c_custkey") * 17 + 5).alias("e"))
    return I.stab_join(_t(spark, sf_dir, "orders").select("o_orderkey"), ranges, "o_orderkey", "s", "e", 64, how="anti")


@query("""WITH c AS (SELECT doc_id, i, l[i] AS ch, coalesce(i > 1 AND l[i - 1] = 'e', false) OR coalesce(l[i + 1] = 'e', false) AS near FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)))
SELECT doc_id, md5(string_agg(CASE WHEN ch = 'e' AND near THEN 'N' ELSE ch END, '' ORDER BY i)) AS digest FROM c GROUP BY doc_id""")
def masked_documents(spark, sf_dir):
    """Documents with their runs of one letter masked."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return I.mask(docs, X.letter_runs(docs, "doc_id", "text", "e", 2), "doc_id", "text", "start", "end").where("text <> ''").select("doc_id", F.md5("text").alias("digest"))
