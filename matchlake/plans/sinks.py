"""Round trips through every sink and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.plans.registry import query
from matchlake.sources import files
from matchlake.sources.adapters import MATCHES, matches, table

_COLUMNS = "match_id bigint, date date, winner bigint, loser bigint, surface string, score string, w_svpt int"
_SAME = MATCHES + "SELECT match_id, date, winner, loser, surface, score, w_svpt FROM matches"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", "date", "winner", "loser", "surface", "score", "w_svpt")


@query(_SAME)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    _rows(spark, sf_dir).write.option("header", True).csv(path)
    return files.read_csv(spark, path, _COLUMNS).drop("file")


@query(_SAME)
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_json(_rows(spark, sf_dir), path)
    return files.read_jsonl(spark, path, _COLUMNS).drop("_corrupt")


@query(MATCHES + "SELECT match_id, date, winner, loser, surface, score, w_svpt FROM matches WHERE surface = 'Clay'")
def sink_shards_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by surface; the filter reads one folder."""
    path = files.scratch(spark)
    files.write_shards(_rows(spark, sf_dir), path, "surface")
    return spark.read.schema(_COLUMNS).parquet(path).filter("surface = 'Clay'").select("match_id", "date", "winner", "loser", "surface", "score", "w_svpt")


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS DOUBLE) AS value FROM embeddings")
def sink_finite_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that JSON can't hold come back as null."""
    path = files.scratch(spark)
    v = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("label").cast("double"))
    files.write_json(table(spark, sf_dir, "embeddings").select("vec_id", v.alias("value")), path)
    return files.read_jsonl(spark, path, "vec_id bigint, value double").drop("_corrupt")
