"""Identity of events: resolution by name, coverage components, display names and near-miss spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import scalars as s
from matchlake.operators.graph import smallest_member
from matchlake.operators.spans import containing, overlapping
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, table

_NAMES = """WITH reg AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation), raw AS (SELECT c_custkey AS k, lower(n_name) || CASE c_custkey % 3
  WHEN 0 THEN '' WHEN 1 THEN ' open' ELSE ' masters 1000' END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(_NAMES + """, hit AS (SELECT r.k, g.id, r.name = g.name AS exact FROM raw r JOIN reg g ON contains(r.name, g.name) OR contains(g.name, r.name))
SELECT r.k, CASE WHEN count(h.id) FILTER (WHERE h.exact) = 1 THEN max(h.id) FILTER (WHERE h.exact)
  WHEN count(DISTINCT h.id) = 1 THEN max(h.id) END AS id FROM raw r LEFT JOIN hit h USING (k) GROUP BY r.k""")
def event_resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id by equal name, else by the only name contained either way. The registry is a dimension of event names: distinct
    raw names meet it, not rows."""
    n = table(spark, sf_dir, "nation")
    registry = n.select(F.col("n_nationkey").alias("id"), s.event_key(F.col("n_name")).alias("known"))
    suffix = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, " open").otherwise(" masters 1000")
    raw = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.concat(s.event_key(F.col("n_name")), suffix).alias("name"))
    pairs = containing(raw, "name", registry, "known").unionByName(containing(registry, "known", raw, "name")).distinct()
    hits = pairs.join(registry, "known").groupBy("name").agg(F.max(F.when(F.col("name") == F.col("known"), F.col("id"))).alias("exact"), F.count_distinct("id").alias("n"), F.max("id").alias("one"))
    return raw.join(hits, "name", "left").select("k", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("id"))


_GROUPS = MATCHES.replace("WITH qty", "WITH RECURSIVE qty", 1) + """, ev AS (SELECT event_id AS e, min(date) AS lo, max(date) AS hi FROM matches
  GROUP BY event_id), pp AS (SELECT DISTINCT event_id AS e, least(winner, loser) AS a, greatest(winner, loser) AS b FROM matches),
edge AS (SELECT DISTINCT x.e AS a, y.e AS b FROM pp x JOIN pp y ON x.a = y.a AND x.b = y.b AND x.e < y.e JOIN ev u ON u.e = x.e JOIN ev v ON v.e = y.e
  WHERE u.lo <= v.hi AND v.lo <= u.hi),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge UNION SELECT e, e FROM ev),
walk(a, b) AS (SELECT a, b FROM sym UNION SELECT w.a, s.b FROM walk w JOIN sym s ON w.b = s.a)
"""




def coverage(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the given matches, and edges between those that overlap in time and share a pair of players."""
    ev = m.groupBy(F.col("event_id").alias("e")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    pairs = m.select(F.col("event_id").alias("e"), F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).distinct()
    x = pairs.join(ev, "e").select(F.col("e").alias("x"), "a", "b", F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    y = x.select(F.col("x").alias("y"), "a", "b", F.col("xlo").alias("ylo"), F.col("xhi").alias("yhi"))
    edges = overlapping(x, y, ["a", "b"]).filter("x < y").select("x", "y").distinct()
    return ev, edges


def components(m: DataFrame) -> DataFrame:
    ev, edges = coverage(m)
    roots = smallest_member(edges, "x", "y")
    return ev.join(roots, F.col("e") == F.col("vertex"), "left").select(F.col("e").alias("event_id"), F.coalesce("root", "e").alias("root"))


def coalesced(m: DataFrame) -> DataFrame:
    """Merged events with their span."""
    ev, edges = coverage(m)
    joined = ev.join(smallest_member(edges, "x", "y"), F.col("e") == F.col("vertex"), "left")
    return joined.groupBy(F.coalesce("root", "e").alias("root")).agg(F.count("*").alias("events"), F.min("lo").alias("start"), F.max("hi").alias("finish"))


@query(_GROUPS + "SELECT a AS event_id, min(b) AS root FROM walk GROUP BY a")
def event_coverage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every season and draw that overlap in time and share a pair of players, by their smallest id."""
    return components(matches(spark, sf_dir))


@query(_GROUPS + "SELECT a AS event_id, min(b) AS root FROM walk GROUP BY a")
def event_coverage_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every season and draw."""
    return components(matches(spark, sf_dir))


@query(_GROUPS + """, roots AS (SELECT a AS e, min(b) AS root FROM walk GROUP BY a) SELECT root, count(*) AS events, min(lo) AS start, max(hi) AS finish FROM roots
  JOIN ev USING (e) GROUP BY root""")
def event_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged events with their span."""
    return coalesced(matches(spark, sf_dir))


@query(_GROUPS + """, roots AS (SELECT a AS e, min(b) AS root FROM walk GROUP BY a) SELECT root, count(*) AS events, min(lo) AS start, max(hi) AS finish FROM roots
  JOIN ev USING (e) GROUP BY root""")
def event_coalesce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged events of every season and draw, with their span."""
    return coalesced(matches(spark, sf_dir))


@query("""WITH n AS (SELECT p_brand, p_name, p_type, length(p_name) AS len FROM part)
SELECT p_brand AS event, coalesce(arg_min(p_name, (len, p_name)) FILTER (WHERE len <= 12), arg_max(p_type, (length(p_type), p_type))) AS display,
  count(DISTINCT p_name) AS aliases FROM n GROUP BY p_brand""")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest alias of at most 12 letters, else the longest type name."""
    short = F.when(F.length("p_name") <= 12, F.struct(F.length("p_name"), "p_name"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("event")).agg(F.coalesce(F.min_by("p_name", short), F.max_by("p_type", F.struct(F.length("p_type"), "p_type"))).alias("display"), F.count_distinct("p_name").alias("aliases"))


@query("""WITH t AS (SELECT p_partkey AS k, list_sort(list_distinct(string_split(lower(p_name || ' ' || split_part(p_type, ' ', 1)), ' '))) AS w FROM part),
tok AS (SELECT k, w, unnest(w) AS x FROM t), c AS (SELECT a.k AS k, b.k AS other, count(*) AS shared, len(a.w) AS n, len(b.w) AS m FROM tok a
  JOIN tok b ON a.x = b.x AND a.k <> b.k GROUP BY ALL)
SELECT k, count(*) AS near, min(other) AS first FROM c WHERE shared = n AND m >= n GROUP BY k""")
def alias_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose words are all among another's: spellings that may be one player's."""
    return near_misses(spellings(table(spark, sf_dir, "part")))


@query()
def alias_near_miss_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every name."""
    return near_misses(spellings(table(spark, sf_dir, "part")))


def spellings(part: DataFrame) -> DataFrame:
    """k, w: the sorted distinct words of each name."""
    words = F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", F.split_part("p_type", F.lit(" "), F.lit(1)))), " ")))
    return part.select(F.col("p_partkey").alias("k"), words.alias("w"))


def near_misses(t: DataFrame) -> DataFrame:
    """k, near, first: for each name the number of others that hold all its words, and the first of them.

    Distinct sets of words meet, by the rarest word of the smaller one, which any larger one has too; rows with the same
    set are counted, not paired.
    """
    sets = t.groupBy("w").agg(F.count("*").alias("rows"), F.min("k").alias("least"))
    tok = sets.select("w", "rows", "least", F.explode("w").alias("x"))
    often = tok.groupBy("x").agg(F.count("*").alias("often"))
    rarest = tok.join(often, "x").groupBy("w").agg(F.min_by("x", F.struct("often", "x")).alias("x"))
    other = tok.select("x", F.col("w").alias("v"), "rows", "least")
    inside = rarest.join(other, "x").filter((F.size("v") > F.size("w")) & (F.size(F.array_except("w", "v")) == 0))
    larger = inside.groupBy("w").agg(F.sum("rows").alias("more"), F.min("least").alias("lowest"))
    same = W.partitionBy("w")
    peers = t.withColumns({"n": F.count("*").over(same), "low": F.min("k").over(same), "next": F.lead("k").over(same.orderBy("k"))})
    found = peers.join(larger, "w", "left").select("k", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("near"), F.least(F.when(F.col("k") == F.col("low"), F.col("next")).otherwise(F.col("low")), F.col("lowest")).alias("first"))
    return found.filter("near > 0")


@query("""WITH o AS (SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderpriority))) AS names, max(CAST(o_orderdate AS DATE)) AS seen FROM orders
  WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), n AS (SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderpriority))) AS names,
  max(CAST(o_orderdate AS DATE)) AS seen FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
SELECT coalesce(o.id, n.id) AS id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.names, []), coalesce(n.names, [])))), ',') AS names,
  greatest(coalesce(o.seen, DATE '1900-01-01'), coalesce(n.seen, DATE '1900-01-01')) AS last_seen FROM o FULL JOIN n ON o.id = n.id
WHERE greatest(coalesce(o.seen, DATE '1900-01-01'), coalesce(n.seen, DATE '1900-01-01')) >= DATE '2000-06-01'""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are only ever added, entries not seen for long are pruned."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"))
    half = lambda r, x: o.filter(F.col("o_orderkey") % 2 == r).groupBy("id").agg(F.collect_set("o_orderpriority").alias(x + "names"), F.max("d").alias(x + "seen"))
    joined = half(0, "o").join(half(1, "n"), "id", "full")
    empty = F.array().cast("array<string>")
    names = F.array_sort(F.array_union(F.coalesce("onames", empty), F.coalesce("nnames", empty)))
    return joined.select("id", F.array_join(names, ",").alias("names"), F.greatest("oseen", "nseen").alias("last_seen")).filter(F.col("last_seen") >= F.lit("2000-06-01").cast("date"))


@query(MATCHES + """, w AS (SELECT event_id, count(DISTINCT player) AS field, count(DISTINCT player) FILTER (WHERE won = 0) AS eliminated,
  count(DISTINCT player) - count(DISTINCT CASE WHEN won = 0 THEN player END) AS alive FROM pl GROUP BY event_id) SELECT * FROM w WHERE field >= 8""")
def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, losers and survivors of events with eight players or more."""
    m = matches(spark, sf_dir).select("event_id", F.explode(F.array(F.struct(F.col("winner").alias("p"), F.lit(1).alias("won")), F.struct(F.col("loser").alias("p"), F.lit(0).alias("won")))).alias("x"))
    out = F.count_distinct(F.when(F.col("x.won") == 0, F.col("x.p")))
    return m.groupBy("event_id").agg(F.count_distinct("x.p").alias("field"), out.alias("eliminated"), (F.count_distinct("x.p") - out).alias("alive")).filter("field >= 8")


@query(MATCHES + "SELECT event_id, winner AS player FROM matches WHERE round_order = 7 INTERSECT SELECT event_id, loser FROM matches WHERE round_order < 4")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return m.filter("round_order = 7").select("event_id", F.col("winner").alias("player")).intersect(m.filter("round_order < 4").select("event_id", F.col("loser").alias("player")))


@query(MATCHES + "SELECT event_id, winner AS player FROM matches WHERE round_order > 3 EXCEPT ALL SELECT event_id, loser FROM matches")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return m.filter("round_order > 3").select("event_id", F.col("winner").alias("player")).exceptAll(m.select("event_id", F.col("loser").alias("player")))
