"""Venues by name: the longest known phrase in a name, joined by equality, and what a venue tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.names import city_norm, phrases

#: Nation codes that archives spell otherwise, and ties whose order of nations is reversed.
ALIASES = {"SIN": "SGP"}
REVERSED_TIES = {"Davis Cup WG F: ARG vs CRO": "CRO", "Davis Cup WG F: BEL vs FRA": "FRA"}


def with_city(names: DataFrame, name: str, cities: DataFrame) -> DataFrame:
    """Add ``norm`` and the columns of ``cities`` (key and others): the city whose key is the longest phrase in the name.

    Distinct names meet the keys by equality of phrases, as long as the longest key, so no name is compared with every city.
    """
    most_words = cities.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    known = names.select(name).distinct().withColumn("norm", city_norm(F.col(name)))
    asked = known.filter("norm <> ''").select(name, F.explode(phrases(F.col("norm"), most_words)).alias("key"))
    hit = asked.join(cities, "key").groupBy(name).agg(F.max_by(F.struct(*cities.columns), F.struct(F.length("key"), "key")).alias("city"))
    placed = known.join(hit, name, "left").select(name, "norm", "city.*")
    return names.join(placed.withColumnRenamed(name, "_name"), F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def host(name: Column, norm: Column, year: Column, tour: Column, city: Column, per_tour: dict[tuple[str, str], str], yearly: dict[str, dict[int, str]]) -> Column:
    """Host nation of an event: of a team tie the first nation (cup ties of one tour only), then by tour, by year, by city.

    per_tour: (normalised name, tour) to nation; yearly: normalised name to year to nation, where no other year is known.
    """
    tie = F.regexp_extract(name, r"\b([A-Z]{3}) vs [A-Z]{3}\b", 1)
    of_tie = F.when(name.startswith("Davis Cup") & ~F.lower(name).contains("finals"), tie)
    for title, code in REVERSED_TIES.items():
        of_tie = F.when(name == title, code).otherwise(of_tie)
    for code, other in ALIASES.items():
        of_tie = F.when(of_tie == code, other).otherwise(of_tie)
    out = city
    for key, years in yearly.items():
        then = F.lit(None).cast("string")
        for y, code in years.items():
            then = F.when(year == y, code).otherwise(then)
        out = F.when(norm == key, then).otherwise(out)
    for (key, of_tour), code in per_tour.items():
        out = F.when((norm == key) & (tour == of_tour), code).otherwise(out)
    return F.when(tie != "", of_tie).otherwise(out)


def local_date(stamp: Column, zone: Column) -> Column:
    """The calendar day at the venue of an ISO time with offset or Z; its first ten characters where the zone is unknown or
    the text has no offset or is no time."""
    raw = F.coalesce(stamp, F.lit(""))
    instant = F.try_to_timestamp(F.when(raw.rlike(r"(Z|[+-]\d\d:\d\d)$"), raw))
    return F.coalesce(F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd"), F.substring(raw, 1, 10))
