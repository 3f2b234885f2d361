"""Publishing: full and quick exports, the master list of checks, and what makes saved state stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.plans.registry import QUERIES, SQL, query
from matchlake.sources.adapters import facts, table
from matchlake.sources.files import scratch, write_json

#: Products that every quick run makes anew; the others come from full runs only.
VOLATILE = {"schedule", "results"}


def export(products: dict[str, DataFrame], folder: str, full: bool) -> None:
    """Write each product as strict JSON, all of them or the volatile ones only."""
    for name, rows in products.items():
        if full or name in VOLATILE:
            write_json(rows, f"{folder}/{name}")


@query("""SELECT 'schedule' AS product, 2 AS generation, count(*) AS rows FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'results', 2, count(*) FROM orders WHERE o_orderkey % 5 > 0
UNION ALL SELECT 'profiles', 1, count(*) FROM supplier""")
def export_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full export and a quick one after it: volatile products are of the second generation, the others of the first."""
    folder, orders = scratch(spark), table(spark, sf_dir, "orders").select("o_orderkey")
    for generation in (1, 2):
        stamp = F.lit(generation).alias("generation")
        products = {"schedule": orders.filter("o_orderkey % 5 = 0").select("*", stamp), "results": orders.filter("o_orderkey % 5 > 0").select("*", stamp), "profiles": table(spark, sf_dir, "supplier").select("s_suppkey", stamp)}
        export(products, folder, full=generation == 1)
    read = [spark.read.schema("generation int").json(f"{folder}/{name}").select(F.lit(name).alias("product"), "generation") for name in products]
    return reduce(DataFrame.unionByName, read).groupBy("product", "generation").agg(F.count("*").alias("rows"))


#: Checks of the master list, and those of them that only advise.
CHECKS = ("gate_match_rows", "gate_unique_keys", "gate_references", "gate_source_coverage", "gate_forecast_history", "gate_event_cards", "gate_event_coverage", "gate_ledger", "gate_watch_ranking", "gate_performance", "gate_profile_shards", "gate_matrix_shards", "gate_prediction_evidence")
ADVISORY = ("gate_event_cards", "gate_source_coverage")


def _master_sql() -> str:
    each = " UNION ALL ".join(f"""SELECT '{name}' AS family, "check", message FROM ({SQL[name]})""" for name in CHECKS)
    advice = ", ".join(f"'{x}'" for x in ADVISORY)
    return f"""SELECT family, "check", count(*) AS n, family NOT IN ({advice}) AND bool_or(NOT contains(message, '[advisory]')) AS blocks FROM ({each}) GROUP BY family, "check" """


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, check, message: what all checks find, over one making of the facts that they share."""
    with facts(spark, sf_dir):
        found = [QUERIES[name](spark, sf_dir).select(F.lit(name).alias("family"), "check", "message") for name in CHECKS]
    return reduce(DataFrame.unionByName, found)


@query(_master_sql())
def gate_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of all families counted; a family blocks unless it only advises or all it says is marked as advice."""
    firm = F.max(~F.col("message").contains("[advisory]"))
    return master(spark, sf_dir).groupBy("family", "check").agg(F.count("*").alias("n"), (~F.col("family").isin(*ADVISORY) & firm).alias("blocks"))


def stale(saved: dict[str, Column], current: dict[str, object]) -> Column:
    """Which of the saved versions differs from the current one first, null where none does."""
    return F.coalesce(*[F.when(~saved[name].eqNullSafe(F.lit(value)), name) for name, value in current.items()])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'schema' WHEN p_size % 3 <> 0 THEN 'parameters' WHEN p_brand <> 'Brand#13' THEN 'population' END AS stale FROM part""")
def state_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved states with what makes each unusable: another schema, other parameters, another population."""
    saved = {"schema": F.col("p_partkey") % 4, "parameters": F.col("p_size") % 3, "population": F.col("p_brand")}
    return table(spark, sf_dir, "part").select("p_partkey", stale(saved, {"schema": 0, "parameters": 0, "population": "Brand#13"}).alias("stale"))
