"""Evidence of events: candidates from results and schedules, joins on shared players and pairs, names, withdrawals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import levels as lv
from matchlake.functions.names import name_key
from matchlake.functions.scalars import event_key
from matchlake.operators.assign import draw_names
from matchlake.operators.graph import smallest_member
from matchlake.operators.merge import keep_best
from matchlake.operators.spans import containing, overlapping, spanned
from matchlake.plans.gate import violations
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, table
from matchlake.sources.files import staged

#: Days of results that a candidate's evidence comes from, and days that it is kept after its end.
CAPTURE, RETENTION = 40, 18
#: The day that candidates are looked for.
REF = "1998-06-01"


def window(rows: DataFrame, ref: str, date: str = "date", days: int = CAPTURE) -> DataFrame:
    day = F.lit(ref).cast("date")
    return rows.filter(F.col(date).between(F.date_sub(day, days), day))


def result_candidates(m: DataFrame, ref: str) -> DataFrame:
    """event_id, start, finish, players, pairs, champion, level, surface of events with results in the capture window that
    ended within the retention: main-draw rows where there are any. A trusted surface goes before a month's guess."""
    rows = window(m.filter("round_order > 0"), ref)
    kept = rows.withColumns({"last": F.max("date").over(W.partitionBy("event_id")), "mains": F.max(F.col("draw_level") == "main").over(W.partitionBy("event_id"))})
    kept = kept.filter((F.col("last") >= F.date_sub(F.lit(ref).cast("date"), RETENTION)) & (~F.col("mains") | (F.col("draw_level") == "main")))
    final = F.when(F.col("round_order") == 7, F.struct("date", "match_id"))
    each = kept.groupBy("event_id").agg(
        F.min("date").alias("start"), F.max("date").alias("finish"), F.size(F.array_union(F.collect_set("winner"), F.collect_set("loser"))).alias("players"),
        F.count_distinct(F.least("winner", "loser"), F.greatest("winner", "loser")).alias("pairs"), F.max_by("winner", final).alias("champion"))
    source = F.when(F.col("match_id") % 3 == 0, "month").otherwise("archive")
    counted = kept.withColumn("source", source).groupBy("event_id", "surface", "source").agg(F.count("*").alias("n"))
    surface = counted.groupBy("event_id").agg(F.min(F.struct((F.col("source") == "month").alias("guess"), (-F.col("n")).alias("n"), "surface")).alias("s"))
    tier = kept.groupBy("event_id", "tier").agg(F.count("*").alias("n")).groupBy("event_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "tier")).alias("t"))
    return each.join(surface, "event_id").join(tier, "event_id").select(*each.columns, F.col("t.tier").alias("tier"), F.col("s.surface").alias("surface"), F.when(F.col("s.guess"), "month").otherwise("archive").alias("source"))


_CAND = MATCHES + f""", win AS (SELECT *, max(date) OVER (PARTITION BY event_id) AS last, bool_or(draw_level = 'main') OVER (PARTITION BY event_id) AS mains FROM matches WHERE date BETWEEN DATE '{REF}' - {CAPTURE} AND DATE '{REF}'),
kept AS (SELECT * FROM win WHERE last >= DATE '{REF}' - {RETENTION} AND (NOT mains OR draw_level = 'main'))
"""


@query(_CAND + """, pp AS (SELECT event_id, count(DISTINCT p) AS players FROM (SELECT event_id, winner AS p FROM kept UNION ALL SELECT event_id, loser FROM kept)
  GROUP BY event_id),
sf AS (SELECT event_id, arg_min({'s': surface, 'g': g}, (g, -n, surface)) AS x FROM (SELECT event_id, surface, match_id % 3 = 0 AS g, count(*) AS n
  FROM kept GROUP BY ALL) GROUP BY event_id), tr AS (SELECT event_id, arg_min(tier, (-n, tier)) AS tier FROM (SELECT event_id, tier, count(*) AS n
  FROM kept GROUP BY ALL) GROUP BY event_id),
e AS (SELECT event_id, min(date) AS start, max(date) AS finish, count(DISTINCT least(winner, loser) || '/' || greatest(winner, loser)) AS pairs,
  arg_max(winner, (date, match_id)) FILTER (WHERE round_order = 7) AS champion FROM kept GROUP BY event_id)
SELECT e.*, CAST(pp.players AS INTEGER) AS players, tr.tier, x.s AS surface, CASE WHEN x.g THEN 'month' ELSE 'archive' END AS source FROM e
  JOIN pp USING (event_id) JOIN sf USING (event_id) JOIN tr USING (event_id)""")
def coverage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_candidates(matches(spark, sf_dir), REF)


_SCHED = MATCHES + f""", up AS (SELECT CASE WHEN match_id % 3 > 0 THEN event_id END AS id, event || CASE WHEN match_id % 2 = 0 THEN ' Open' ELSE '' END AS name, date, CASE WHEN match_id % 13 = 0 THEN 'Qualifier 1' ELSE 'P' || winner END AS a, 'P' || loser AS b FROM matches WHERE date BETWEEN DATE '{REF}' - {RETENTION} AND DATE '{REF}'),
g AS (SELECT *, coalesce(id, 'name:' || name) AS k FROM up WHERE NOT starts_with(a, 'Qualifier'))
"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = matches(spark, sf_dir), F.col("match_id")
    return m.select(F.when(k % 3 > 0, F.col("event_id")).alias("id"), F.concat("event", F.when(k % 2 == 0, " Open").otherwise("")).alias("name"), "date", F.when(k % 13 == 0, "Qualifier 1").otherwise(F.concat(F.lit("P"), "winner")).alias("a"), F.concat(F.lit("P"), "loser").alias("b"))


@query(_SCHED + """SELECT k AS event, min(date) AS start, max(date) AS finish, array_to_string(list_sort(list_distinct(list(name))), ',') AS names,
  count(DISTINCT least(a, b) || '/' || greatest(a, b)) AS pairs FROM g GROUP BY k""")
def schedule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begun events of the schedule: by id, or by name where there is none; matches of two real players only."""
    rows = window(schedule(spark, sf_dir), REF, days=RETENTION).filter(lv.is_real(F.col("a")) & lv.is_real(F.col("b")))
    key = F.coalesce("id", F.concat(F.lit("name:"), "name"))
    return rows.groupBy(key.alias("event")).agg(F.min("date").alias("start"), F.max("date").alias("finish"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.count_distinct(F.least("a", "b"), F.greatest("a", "b")).alias("pairs"))


def shared(x: DataFrame, y: DataFrame, on: list[str], least: int = 0) -> DataFrame:
    """x, y, n: how many of the ``on`` values two groups have in common whose spans overlap; x and y as ``spanned`` makes them."""
    return overlapping(x, y, on, least=least).groupBy("x", "y").agg(F.count("*").alias("n"))


_PROOF = MATCHES + """, gr AS (SELECT event || '/' || year AS g, winner, loser, date FROM matches WHERE match_id % 2 = 0), dr AS (SELECT event_id AS id, winner, loser,
  date, round_order FROM matches WHERE match_id % 4 < 3),
gs AS (SELECT g, min(date) AS lo, max(date) AS hi FROM gr GROUP BY g), ds AS (SELECT id, min(date) AS lo, max(date) AS hi FROM dr GROUP BY id),
gp AS (SELECT DISTINCT g, p FROM (SELECT g, winner AS p FROM gr UNION ALL SELECT g, loser FROM gr)), dp AS (SELECT DISTINCT id, p
  FROM (SELECT id, winner AS p FROM dr UNION ALL SELECT id, loser FROM dr)),
gq AS (SELECT DISTINCT g, least(winner, loser) AS a, greatest(winner, loser) AS b
  FROM gr), dq AS (SELECT DISTINCT id, least(winner, loser) AS a, greatest(winner, loser) AS b FROM dr WHERE round_order = 1),
sp AS (SELECT g, id FROM gp JOIN dp USING (p) GROUP BY ALL HAVING count(*) >= 3), sq AS (SELECT g, id FROM gq JOIN dq USING (a, b) GROUP BY ALL
  HAVING count(*) >= 2),
hits AS (SELECT sp.g, sp.id FROM sp JOIN sq ON sq.g = sp.g AND sq.id = sp.id JOIN gs ON gs.g = sp.g JOIN ds ON ds.id = sp.id
  WHERE date_diff('day', greatest(gs.lo, ds.lo), least(gs.hi, ds.hi)) >= 2)
"""


def proven_ids(groups: DataFrame, draws: DataFrame) -> DataFrame:
    """g, id: the one draw whose days overlap a group's by two or more, with three shared players and two first-round pairs.

    groups: g, winner, loser, date; draws: id, winner, loser, date, round_order.
    """
    both = lambda d, k: d.select(k, F.explode(F.array("winner", "loser")).alias("p"), "date")
    pair = lambda d: d.withColumns({"a": F.least("winner", "loser"), "b": F.greatest("winner", "loser")})
    span = draws.groupBy("id").agg(F.min("date").alias("ylo"), F.max("date").alias("yhi"))
    first = pair(draws.filter("round_order = 1")).select("id", "a", "b").distinct().join(span, "id").withColumnRenamed("id", "y")
    pairs = shared(spanned(pair(groups), "g", "x", "a", "b"), first, ["a", "b"], 2).filter("n >= 2").drop("n")
    players = shared(spanned(both(groups, "g"), "g", "x", "p"), spanned(both(draws, "id"), "id", "y", "p"), ["p"], 2).filter("n >= 3").drop("n")
    hits = pairs.join(players, ["x", "y"]).select(F.col("x").alias("g"), F.col("y").alias("id"))
    return hits.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


@query(_PROOF + "SELECT g, min(id) AS id FROM hits GROUP BY g HAVING count(*) = 1")
def draw_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result groups without an id, proven to be a draw by players, pairs and days; names play no part."""
    m, k = staged(matches(spark, sf_dir).select("match_id", "event", "year", "event_id", "winner", "loser", "date", "round_order")), F.col("match_id")
    groups = m.filter(k % 2 == 0).select(F.concat_ws("/", "event", F.col("year").cast("string")).alias("g"), "winner", "loser", "date")
    draws = m.filter(k % 4 < 3).select(F.col("event_id").alias("id"), "winner", "loser", "date", "round_order")
    return proven_ids(groups, draws)


def merge_candidates(groups: DataFrame) -> DataFrame:
    """g, root, id: groups of rows (g, id or null, winner, loser, date) that are one event.

    Equal ids are one. Groups of which one at most has an id are one if their days overlap and they share a pair; a
    component that would join several ids is left as its single groups.
    """
    each = groups.groupBy("g").agg(F.max("id").alias("id"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    pairs = groups.select("g", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).distinct().join(each, "g")
    x, y = (pairs.select(F.col("g").alias(n), "a", "b", F.col("id").alias(n + "id"), F.col("lo").alias(n + "lo"), F.col("hi").alias(n + "hi")) for n in "xy")
    near = overlapping(x, y, ["a", "b"]).filter("x < y and (xid is null or yid is null)").select("x", "y")
    same = each.filter("id is not null").withColumn("first", F.min("g").over(W.partitionBy("id"))).filter("g <> first").select(F.col("first").alias("x"), F.col("g").alias("y"))
    roots = smallest_member(near.unionByName(same).distinct(), "x", "y")
    joined = each.join(roots, F.col("g") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "g"))
    ids = F.size(F.collect_set("id").over(W.partitionBy("root")))
    return joined.withColumn("ids", ids).select("g", F.when(F.col("ids") > 1, F.coalesce(F.min("g").over(W.partitionBy("root", "id")), "g")).otherwise(F.col("root")).alias("root"), "id")


@query(MATCHES.replace("WITH qty", "WITH RECURSIVE qty", 1) + """, gr AS (SELECT event || '/' || year || '/' || (match_id % 2) AS g, CASE WHEN match_id % 2 = 0 AND tour < 3 THEN event_id END AS id, winner, loser,
  date FROM matches),
ea AS (SELECT g, max(id) AS id, min(date) AS lo, max(date) AS hi FROM gr GROUP BY g), pq AS (SELECT DISTINCT g, least(winner, loser) AS a,
  greatest(winner, loser) AS b FROM gr),
ed AS (SELECT DISTINCT x.g AS a, y.g AS b FROM pq x JOIN pq y ON x.a = y.a AND x.b = y.b AND x.g <> y.g JOIN ea u ON u.g = x.g JOIN ea v ON v.g = y.g
  WHERE u.lo <= v.hi AND v.lo <= u.hi AND (u.id IS NULL OR v.id IS NULL)
  UNION SELECT u.g, v.g FROM ea u JOIN ea v ON u.id = v.id UNION SELECT g, g FROM ea),
wk(a, b) AS (SELECT a, b FROM ed UNION SELECT w.a, e.b FROM wk w JOIN ed e ON w.b = e.a), rt AS (SELECT a AS g, min(b) AS root FROM wk GROUP BY a),
n AS (SELECT rt.g, rt.root, ea.id, (SELECT count(DISTINCT e2.id) FROM rt r2 JOIN ea e2 ON e2.g = r2.g WHERE r2.root = rt.root) AS ids FROM rt
  JOIN ea ON ea.g = rt.g)
SELECT g, CASE WHEN ids > 1 THEN min(g) OVER (PARTITION BY root, id) ELSE root END AS root, id FROM n""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two sources, of all draws, merged on shared pairs; no bridge joins two ids."""
    m, k = staged(matches(spark, sf_dir).select("match_id", "event", "year", "tour", "event_id", "winner", "loser", "date")), F.col("match_id")
    key = F.concat_ws("/", "event", F.col("year").cast("string"), (k % 2).cast("string"))
    return merge_candidates(m.select(key.alias("g"), F.when((k % 2 == 0) & (F.col("tour") < 3), F.col("event_id")).alias("id"), "winner", "loser", "date"))


_SPLIT = MATCHES + """, f AS (SELECT event || ' ' || (match_id % 3) AS name, CASE WHEN match_id % 3 = 2 THEN event_id END AS id, winner AS p, date, year FROM matches
  UNION ALL SELECT event || ' ' || (match_id % 3), CASE WHEN match_id % 3 = 2 THEN event_id END, loser, date, year FROM matches),
g AS (SELECT name || '/' || year AS g, max(id) AS id, min(date) AS lo, max(date) AS hi, count(DISTINCT p) AS n FROM f
  GROUP BY 1), fp AS (SELECT DISTINCT name || '/' || year AS g, p FROM f),
sh AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM fp x JOIN fp y ON x.p = y.p AND x.g < y.g GROUP BY ALL)
"""


def split_identities(field: DataFrame) -> DataFrame:
    """a, b, shared: groups (g, id, p, date) of different names that overlap two days or more and share three players, or
    of which one's field lies in the other's; two different ids are two events."""
    g = field.groupBy("g").agg(F.max("id").alias("id"), F.min("date").alias("lo"), F.max("date").alias("hi"), F.count_distinct("p").alias("n"))
    own = spanned(field, "g", "x", "p")
    other = own.withColumnsRenamed({"x": "y", "xlo": "ylo", "xhi": "yhi"})
    n = shared(own, other, ["p"], 2).filter("x < y").withColumnsRenamed({"x": "a", "y": "b"})
    side = lambda x: g.select(*[F.col(c).alias(x if c == "g" else x + c) for c in g.columns])
    both = n.withColumnRenamed("n", "shared").join(side("a"), "a").join(side("b"), "b")
    close = (F.col("aid").isNull() | F.col("bid").isNull() | (F.col("aid") == F.col("bid")))
    inside = (F.least("an", "bn") >= 2) & (F.col("shared") == F.least("an", "bn"))
    return both.filter(close & ((F.col("shared") >= 3) | inside)).select("a", "b", "shared")


@query(_SPLIT + """SELECT 'identity' AS "check", sh.a || ' and ' || sh.b AS key, CAST(shared AS VARCHAR) || ' players' AS message FROM sh JOIN g x ON x.g = sh.a
  JOIN g y ON y.g = sh.b WHERE date_diff('day', greatest(x.lo, y.lo), least(x.hi, y.hi)) >= 2 AND (x.id IS NULL OR y.id IS NULL OR x.id = y.id)
  AND (shared >= 3 OR (least(x.n, y.n) >= 2 AND shared = least(x.n, y.n)))""")
def gate_split_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that may be one under two names."""
    k = F.col("match_id") % 3
    name = F.concat_ws("/", F.concat_ws(" ", "event", k.cast("string")), F.col("year").cast("string"))
    field = matches(spark, sf_dir).select(name.alias("g"), F.when(k == 2, F.col("event_id")).alias("id"), F.explode(F.array("winner", "loser")).alias("p"), "date")
    return violations(split_identities(field), "identity", F.concat_ws(" and ", "a", "b"), F.lit(True), F.concat(F.col("shared").cast("string"), F.lit(" players")))


@query(MATCHES + """, c AS (SELECT p_brand AS name, p_partkey AS k, p_size AS draw, CASE WHEN p_partkey % 2 = 0 THEN 'ATP Tour' ELSE 'ATP 250' END AS level FROM part)
SELECT lower(name) AS name, arg_max(k, (draw, level <> 'ATP Tour', -k)) AS k, max(draw) AS draw, min(k) AS place FROM c GROUP BY lower(name)""")
def cards_by_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card a shown name: the largest draw, then a named tier; it keeps the place where the name came first."""
    p = table(spark, sf_dir, "part").select(event_key(F.col("p_brand")).alias("name"), F.col("p_partkey").alias("k"), F.col("p_size").alias("draw"), F.when(F.col("p_partkey") % 2 == 0, "ATP Tour").otherwise("ATP 250").alias("level"))
    authority = F.struct("draw", F.col("level") != "ATP Tour", -F.col("k"))
    return p.groupBy("name").agg(F.max_by("k", authority).alias("k"), F.max("draw").alias("draw"), F.min("k").alias("place"))


@query(MATCHES + """, w AS (SELECT *, max(date) OVER () AS dmax FROM matches), g AS (SELECT event, min(date) AS start, max(date) AS finish, count(*) AS n,
  max(dmax) AS dmax FROM w WHERE date >= dmax - 40 GROUP BY event HAVING max(round_order) >= 1)
SELECT event, start, finish, n, row_number() OVER (ORDER BY finish DESC, event) AS place FROM g WHERE date_diff('day', finish, dmax) <= 18""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knock-out events of the last forty days of data that ended in the last eighteen, newest first."""
    m = matches(spark, sf_dir).select("event", "date", "round_order")
    latest = m.agg(F.max("date").alias("latest"))
    recent = m.join(F.broadcast(latest), F.col("date") >= F.date_sub("latest", 40))
    g = recent.groupBy("event").agg(F.min("date").alias("start"), F.max("date").alias("finish"), F.count("*").alias("n"), F.max("latest").alias("latest"), F.max("round_order").alias("depth"))
    kept = g.filter((F.col("depth") >= 1) & (F.datediff("latest", "finish") <= 18))
    from matchlake.operators.order import sequence

    return sequence(kept, [-F.unix_date("finish"), F.col("event")], "place").select("event", "start", "finish", "n", "place")


@query(MATCHES + """, pol AS (SELECT *, draw_level = 'main' AND NOT (tour = 1 AND tier = 5) AS admitted
  FROM matches) SELECT match_id, CASE WHEN admitted THEN 'model' ELSE 'policy' END AS population FROM pol
  WHERE admitted OR (tour = 1 AND draw_level = 'main')""")
def event_match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lifecycles see: the model's rows and those that only policy keeps from it."""
    m = matches(spark, sf_dir)
    admitted = (F.col("draw_level") == "main") & ~((F.col("tour") == 1) & (F.col("tier") == 5))
    model = m.filter(admitted).select("match_id", F.lit("model").alias("population"))
    return model.unionByName(m.filter(~admitted & (F.col("tour") == 1) & (F.col("draw_level") == "main")).select("match_id", F.lit("policy").alias("population")))


def first_match_a_round(rows: DataFrame) -> DataFrame:
    """event_id, round_order, match_id kept: in order, a match stays if neither player was kept in that round before.

    A row's fate depends on those before it, so each event's round is folded in order by one task; state is its players.
    """
    from matchlake.operators.order import ordered_fold

    def start():
        seen: set[int] = set()

        def step(event_id: str, round_order: int, place: str, match_id: int, winner: int, loser: int) -> tuple:
            keep = winner not in seen and loser not in seen
            if keep:
                seen.update((winner, loser))
            return event_id, round_order, match_id, keep

        return step

    keyed = rows.select("event_id", "round_order", F.concat_ws("/", "event_id", F.col("round_order").cast("string")).alias("place"), "date", "match_id", "winner", "loser")
    return ordered_fold(keyed, "place", ["date", "match_id"], start, "event_id string, round_order int, match_id bigint, kept boolean")


@query()
def one_match_a_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player plays once in a round: the first of several matches stays. Tested against a plain loop."""
    return first_match_a_round(matches(spark, sf_dir).filter("draw_level = 'main'"))


@query(MATCHES + """, ek AS (SELECT DISTINCT event_id, lower(event) AS name FROM matches), asked AS (SELECT DISTINCT event_id || '!' AS k, lower(event) || ' open' AS name
  FROM matches WHERE match_id % 9 = 0), rws AS (SELECT lower(event) AS t, surface, best_of, match_id % 4 = 0 AS guess FROM matches),
h AS (SELECT a.k, r.surface, r.best_of, r.guess FROM asked a JOIN rws r ON contains(a.name, r.t) OR contains(r.t, a.name)), s AS (SELECT k,
  arg_min(surface, (-n, surface)) AS surface FROM (SELECT k, surface, count(*) AS n FROM h WHERE NOT guess GROUP BY ALL) GROUP BY k)
SELECT a.k, s.surface, max(h.best_of) AS best_of FROM asked a LEFT JOIN s USING (k) LEFT JOIN h USING (k) GROUP BY a.k, s.surface""")
def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface (commonest, no guesses) and format of an event from all archive names that hold its name or lie in it.

    Archive rows are counted by name first; distinct names meet, not rows.
    """
    m, k = matches(spark, sf_dir), F.col("match_id")
    asked = m.filter(k % 9 == 0).select(F.concat("event_id", F.lit("!")).alias("k"), F.concat(F.lower("event"), F.lit(" open")).alias("name")).distinct()
    counted = m.groupBy(F.lower("event").alias("t"), "surface").agg(F.count_if(k % 4 != 0).alias("n"), F.max("best_of").alias("best_of"))
    names = containing(asked, "name", counted, "t").unionByName(containing(counted, "t", asked, "name")).distinct()
    each = names.join(counted, "t").groupBy("name", "surface").agg(F.sum("n").alias("n"), F.max("best_of").alias("best_of"))
    best = each.groupBy("name").agg(F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "surface")))["surface"].alias("surface"), F.max("best_of").alias("best_of"))
    return asked.join(best, "name", "left").select("k", "surface", "best_of")


@query("""WITH m AS (SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'Hard' ELSE 'Clay' END AS surface
  FROM nation), a AS (SELECT DISTINCT lower(n_name) || CASE n_nationkey % 2 WHEN 0 THEN ' classic' ELSE '' END AS event
  FROM nation UNION SELECT 'uni' UNION SELECT 'united states and united kingdom'),
h AS (SELECT a.event, m.surface, m.name = a.event AS exact FROM a JOIN m ON contains(a.event, m.name) OR (length(a.event) >= 5 AND contains(m.name,
  a.event)))
SELECT a.event, coalesce(max(h.surface) FILTER (WHERE exact), CASE WHEN count(DISTINCT h.surface) = 1 THEN max(h.surface) END) AS surface FROM a LEFT
  JOIN h USING (event) GROUP BY a.event""")
def surface_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached surface by name, else by the names contained either way as far as they agree; short names contain nothing."""
    n = table(spark, sf_dir, "nation")
    cache = n.select(F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "Hard").otherwise("Clay").alias("surface"))
    asked = n.select(F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, " classic").otherwise("")).alias("event"))
    asked = asked.unionByName(spark.createDataFrame([("uni",), ("united states and united kingdom",)], "event string")).distinct()
    return contained(asked, cache)


def contained(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """event, surface; both sides are distinct names of events, dimensions."""
    pairs = containing(asked, "event", cache, "name").unionByName(containing(cache, "name", asked.filter(F.length("event") >= 5), "event")).distinct()
    hits = pairs.join(cache, "name").groupBy("event").agg(F.max(F.when(F.col("name") == F.col("event"), F.col("surface"))).alias("exact"), F.count_distinct("surface").alias("n"), F.max("surface").alias("one"))
    return asked.join(hits, "event", "left").select("event", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("surface"))


@query(MATCHES + """, drawn AS (SELECT DISTINCT event_id, player FROM pl WHERE match_id % 5 > 0), field AS (SELECT DISTINCT event_id, player FROM pl
  WHERE match_id % 3 > 0), played AS (SELECT DISTINCT event_id, player FROM pl WHERE match_id % 7 = 0)
SELECT event_id, player FROM drawn EXCEPT SELECT event_id, player FROM field EXCEPT SELECT event_id, player FROM played""")
def drawn_and_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of the draw whom the feed no longer lists and who never played."""
    m = matches(spark, sf_dir).select("match_id", "event_id", F.explode(F.array("winner", "loser")).alias("player"))
    k = F.col("match_id")
    part = lambda c: m.filter(c).select("event_id", "player")
    return part(k % 5 > 0).subtract(part(k % 3 > 0)).subtract(part(k % 7 == 0))


@query()
def derived_withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who left a draw without losing, and who came in. Tested against a plain version on a fixture."""
    m, k = matches(spark, sf_dir), F.col("match_id")
    first = m.filter("round_order = 1")
    place = F.row_number().over(W.partitionBy("event_id").orderBy("match_id")) - 1
    pairs = first.select("event_id", place.alias("match"), "winner", "loser", "match_id")
    slots = pairs.select("event_id", F.posexplode(F.array(F.when(F.col("match_id") % 5 == 0, -F.col("winner")).otherwise(F.col("winner")), F.col("loser"))).alias("side", "player"), "match").select("event_id", (2 * F.col("match") + F.col("side")).alias("slot"), "player")
    field = m.select("event_id", F.explode(F.array("winner", "loser")).alias("player")).distinct()
    return withdrawals(slots, field, m.select("event_id", "winner", "loser"))


def withdrawals(slots: DataFrame, field: DataFrame, results: DataFrame, most: int = 4, real: Column | None = None) -> DataFrame:
    """event_id, gone, replacement, status of each player drawn, not in the field and without a match.

    With nobody new in the field it is a walkover. Else the absent claim new players in order: who has exactly one left among
    those who met the slot's first opponent is replaced by that one, whom nobody can claim again; none or several leave it
    unresolved. An event where more than ``most`` are absent is a broken feed, and all stay unresolved.
    slots: event_id, slot, player; field: event_id, player; results: event_id, winner, loser; real: whether a drawn player
    is somebody (placeholders can't withdraw).
    """
    played = results.select("event_id", F.explode(F.array("winner", "loser")).alias("player"))
    drawn = slots.filter(F.col("player").isNotNull() & (F.lit(True) if real is None else real)).select("event_id", "player")
    absent = drawn.subtract(field).subtract(played).withColumnRenamed("player", "gone")
    extra = field.filter("player is not null").subtract(drawn).withColumnRenamed("player", "new")
    count = absent.groupBy("event_id").agg(F.count("*").alias("absent")).join(extra.groupBy("event_id").agg(F.count("*").alias("extra")), "event_id", "left")
    other = slots.select("event_id", (F.col("slot").bitwiseXOR(1)).alias("slot"), F.col("player").alias("opponent"))
    vacated = absent.join(slots.withColumnRenamed("player", "gone"), ["event_id", "gone"]).join(other, ["event_id", "slot"])
    met = results.select("event_id", F.explode(F.array(F.struct(F.col("winner").alias("opponent"), F.col("loser").alias("new")), F.struct(F.col("loser").alias("opponent"), F.col("winner").alias("new")))).alias("x")).select("event_id", "x.*")
    hits = vacated.join(met, ["event_id", "opponent"]).join(extra, ["event_id", "new"]).groupBy("event_id", "gone").agg(F.collect_set("new").alias("hits"))
    few = absent.join(count, "event_id").filter(F.col("absent") <= most).join(hits, ["event_id", "gone"], "left")
    kind = drawn.schema["player"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    claims = few.groupBy("event_id").agg(F.max("extra").alias("extra"), F.array_sort(F.collect_list(F.struct("gone", F.coalesce("hits", none).alias("hits")))).alias("claims"))  # ``most`` of them

    def claim(state: Column, x: Column) -> Column:
        left = F.array_except(x["hits"], state["taken"])
        one = F.when(F.size(left) == 1, left[0])
        taken = F.when(one.isNotNull(), F.concat(state["taken"], F.array(one))).otherwise(state["taken"])
        return F.struct(taken.alias("taken"), F.concat(state["out"], F.array(F.struct(x["gone"].alias("gone"), one.alias("replacement")))).alias("out"))

    start = F.struct(none.alias("taken"), F.array().cast(f"array<struct<gone:{kind},replacement:{kind}>>").alias("out"))
    made = claims.select("event_id", "extra", F.explode(F.aggregate("claims", start, claim)["out"]).alias("x")).select("event_id", "extra", "x.*")
    status = F.when(F.col("extra").isNull(), "walkover").when(F.col("replacement").isNotNull(), "replaced").otherwise("unresolved")
    many = absent.join(count.filter(F.col("absent") > most).select("event_id"), "event_id")
    return made.select("event_id", "gone", "replacement", status.alias("status")).unionByName(many.select("event_id", "gone", F.lit(None).cast(kind).alias("replacement"), F.lit("unresolved").alias("status")))


_EVID = MATCHES + ", sp AS (SELECT event || CASE WHEN match_id % 5 = 0 THEN ' ' ELSE '' END || player AS spelling, player, opponent, event FROM pl WHERE year >= 1996) "


@query(_EVID + """SELECT player, count(DISTINCT opponent) AS opponents, count(DISTINCT spelling) AS spellings, arg_max(spelling, (n, spelling)) AS commonest
  FROM (SELECT player, opponent, spelling, count(*) OVER (PARTITION BY player, spelling) AS n FROM sp) GROUP BY player""")
def alias_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opponents and spellings of each player since a year."""
    m = matches(spark, sf_dir).filter("year >= 1996")
    both = m.select("match_id", "event", F.explode(F.array(F.struct(F.col("winner").alias("player"), F.col("loser").alias("opponent")), F.struct(F.col("loser").alias("player"), F.col("winner").alias("opponent")))).alias("x")).select("match_id", "event", "x.*")
    spelled = both.withColumn("spelling", F.concat("event", F.when(F.col("match_id") % 5 == 0, " ").otherwise(""), F.col("player").cast("string")))
    counts = spelled.groupBy("player", "spelling").agg(F.count("*").alias("n"))
    common = counts.groupBy("player").agg(F.count("*").alias("spellings"), F.max_by("spelling", F.struct("n", "spelling")).alias("commonest"))
    return both.groupBy("player").agg(F.count_distinct("opponent").alias("opponents")).join(common, "player")


def rejection(alias: Column, target: Column, asked: Column, known: Column, met: Column, ids_differ: Column) -> Column:
    """Why a proposed alias can't hold, null if nothing speaks against it."""
    return (
        F.when(alias.isNull() | target.isNull() | (alias == "") | (target == ""), "incomplete").when(alias == target, "same name").when(~asked, "not asked")
        .when(~known, "unknown player").when(met, "they played each other").when(ids_differ, "different ids")
    )


@query(MATCHES + """, pr AS (SELECT p_partkey AS k, 1 + p_partkey % 10 AS a, 1 + p_partkey * 3 % 12 AS b FROM part), met AS (SELECT DISTINCT player AS a, opponent AS b
  FROM pl WHERE match_id % 20 = 0), kn AS (SELECT DISTINCT player FROM pl)
SELECT k, CASE WHEN a = b THEN 'same name' WHEN k % 6 = 0 THEN 'not asked' WHEN b NOT IN (SELECT player
  FROM kn) THEN 'unknown player' WHEN EXISTS (SELECT 1 FROM met WHERE met.a = pr.a AND met.b = pr.b) THEN 'they played each other'
  WHEN a % 2 <> b % 2 THEN 'different ids' END AS reason FROM pr""")
def alias_falsified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed aliases with what speaks against them."""
    both = matches(spark, sf_dir).select("match_id", F.explode(F.array(F.struct(F.col("winner").alias("a"), F.col("loser").alias("b")), F.struct(F.col("loser").alias("a"), F.col("winner").alias("b")))).alias("x")).select("match_id", "x.*")
    met = both.filter("match_id % 20 = 0").select("a", "b").distinct().withColumn("met", F.lit(True))
    known = both.select(F.col("b")).distinct().withColumn("known", F.lit(True))
    k = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").select(k.alias("k"), (1 + k % 10).alias("a"), (1 + k * 3 % 12).alias("b"))
    joined = asked.join(known, "b", "left").join(met, ["a", "b"], "left")
    text = lambda c: F.col(c).cast("string")
    return joined.select("k", rejection(text("a"), text("b"), F.col("k") % 6 != 0, F.coalesce("known", F.lit(False)), F.coalesce("met", F.lit(False)), F.col("a") % 2 != F.col("b") % 2).alias("reason"))


_SLOTS = """WITH ev AS (SELECT s_nationkey AS event, s_name AS name, 'player ' || chr(CAST(97 + s_suppkey % 26 AS INTEGER)) || 'name' || s_suppkey AS nm
  FROM supplier),
raw AS (SELECT event, nm, CASE WHEN length(nm) % 2 = 0 THEN nm ELSE split_part(nm, ' ', 2) || ' x.' END AS raw FROM ev)
"""


@query(_SLOTS + "SELECT event, raw, nm AS player FROM raw")
def slots_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviated names of a draw matched to its field: by key, else by the only player with most words in common."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    full = F.concat(F.lit("player "), F.char((97 + k % 26)), F.lit("name"), k.cast("string"))
    rows = s.select(F.col("s_nationkey").alias("event"), full.alias("player"))
    raw = rows.select("event", F.when(F.length("player") % 2 == 0, F.col("player")).otherwise(F.concat(F.split_part("player", F.lit(" "), F.lit(2)), F.lit(" x."))).alias("raw"))
    return reconciled(raw, rows)


@query()
def draw_names_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's spellings of an event's entrants (another transliteration, one more given name, the order turned round)
    matched one to one to the event's own; a test holds the rows to a greedy loop over all pairs."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    letter = lambda n: F.char((97 + n % 26).cast("long"))
    given = F.concat(F.lit("Ale"), letter(F.floor(k / 5)), F.lit("x"), letter(k))
    surname = F.concat(F.lit("Shev"), letter(F.floor(k / 3)), F.lit("enko"))
    full = F.concat_ws(" ", given, surname)
    raw = F.when(k % 4 == 0, F.upper(full)).when(k % 4 == 1, F.concat_ws(" ", F.replace(given, F.lit("x"), F.lit("ks")), surname)).when(k % 4 == 2, F.concat_ws(" ", F.lit("Adolfo"), full)).otherwise(F.concat(surname, F.lit("-"), given))
    return draw_names(s.select(F.col("s_nationkey").alias("event"), k.alias("place"), raw.alias("raw")), s.select(F.col("s_nationkey").alias("event"), k.alias("place"), full.alias("player")))


def reconciled(raw: DataFrame, field: DataFrame) -> DataFrame:
    """event, raw, player: names (event, raw) matched one to one to a field (event, player).

    Equal keys match first; of the rest, those that share a word of four letters or more with exactly one best player
    (most shared words, then the longest shared word), where no other name claims that player; others stay as they are.
    """
    words = lambda c: F.array_distinct(F.split(name_key(F.col(c)), " "))
    a = raw.distinct().withColumn("key", name_key(F.col("raw")))
    b = field.distinct().withColumn("key", name_key(F.col("player")))
    exact = keep_best(a.join(b, ["event", "key"]).select("event", "raw", "player"), ["event", "player"], [F.col("raw")])
    left = a.join(exact, ["event", "raw"], "left_anti").withColumn("w", words("raw"))
    free = b.join(exact, ["event", "player"], "left_anti").withColumn("v", words("player"))
    meet = left.withColumn("x", F.explode("w")).join(free.withColumn("x", F.explode("v")), ["event", "x"]).filter(F.length("x") > 0)
    scored = meet.groupBy("event", "raw", "player").agg(F.count("*").alias("shared"), F.max(F.length("x")).alias("anchor")).filter("anchor >= 4")
    best = F.max(F.struct("shared", "anchor")).over(W.partitionBy("event", "raw"))
    top = scored.withColumn("best", best).filter((F.col("best.shared") == F.col("shared")) & (F.col("best.anchor") == F.col("anchor")))
    sole = top.withColumns({"n": F.count("*").over(W.partitionBy("event", "raw")), "claims": F.count("*").over(W.partitionBy("event", "player"))}).filter("n = 1 and claims = 1")
    found = exact.unionByName(sole.select("event", "raw", "player"))
    return a.select("event", "raw").join(found, ["event", "raw"], "left").select("event", "raw", F.coalesce("player", "raw").alias("player"))
