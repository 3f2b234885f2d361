"""Official draw documents in the dialects of their providers, calendar ranges and tiers."""

import datetime

import pytest
from pyspark.sql import functions as F

from matchlake.functions import levels
from matchlake.operators.venues import with_city
from matchlake.sources.printed import printed_draws


def draw(spark, text):
    rows = printed_draws(spark.createDataFrame([("x", text)], "id string, body string"), "id", "body").orderBy("slot").collect()
    return [r.player for r in rows], {r.player: r.seed for r in rows if r.seed is not None}


def document(names, between="   "):
    lines = ["Test Open", "TEST CITY", "27 July — 1 August 2026", "Main Draw Singles"]
    for i, name in enumerate(names, 1):
        lines.append(f" {i}       Bye" if name is None else f" {i}{between}{'1   ' if i == 1 else ''}{name.split(' ', 1)[1].upper()}, {name.split(' ', 1)[0]}          USA")
    return "\n".join(lines)


def test_entrants_and_byes(spark):
    names = [f"Player {i}" for i in range(1, 29)] + [None] * 4
    assert draw(spark, document(names)) == (names, {"Player 1": 1})


def test_open_places_are_told_apart(spark):
    lines = [f" {i}   PLAYER {i}, Test          USA" if i <= 80 else f" {i}   Q   Qualifier" if i <= 96 else f" {i}       Bye" for i in range(1, 129)]
    found, seeds = draw(spark, "\n".join(["National Open", *lines, "1 NOTES, Some"]))
    assert found[80:96] == [f"Qualifier {i}" for i in range(1, 17)] and len(found) == 128 and found[96:] == [None] * 32 and not seeds
    ligature = [f"{i}Q/LL   Qualiﬁer/LL" if i in (3, 6) else f" {i}       PLAYER {i}, Test          USA" for i in range(1, 9)]
    spaced = [f" {i}       Qualifier / Lucky Loser          USA" if i in (3, 6) else f" {i}       PLAYER {i}, Test          USA" for i in range(1, 9)]
    for text in (ligature, spaced):
        found, _ = draw(spark, "\n".join(text))
        assert (found[2], found[5], len(set(found))) == ("Qualifier 1", "Qualifier 2", 8)


@pytest.mark.parametrize(
    ("line", "player", "seed"),
    [
        (" 4       6   VAN DE ZANDSCHULP…           NED", "Van De Zandschulp…", 6),
        ("4WC    CROSS, Kayla                        CAN", "Kayla Cross", None),
        ("  4  WC  3 SMITH, John   USA", "John Smith", 3),
        (" 4   O'BRIEN-LEE, Mary Ann USA", "Mary Ann O'Brien-Lee", None),
        (" 4   ŠVIĄTEK, Iga", "Iga Šviątek", None),
        (" 4   McDonald Mackenzie      USA   6-4 6-3", "McDonald Mackenzie", None),
        ("4. Somebody Else [12]", "Somebody Else", 12),
        (" 4   LL   12  DE LA CRUZ,  Ana  Maria     ESP", "Ana", 12),
    ],
)
def test_lines(spark, line, player, seed):
    others = [f" {i}   PLAYER {i}, Test" for i in range(1, 9)]
    others[3] = line
    found, seeds = draw(spark, "\n".join(others))
    assert len(found) == 8 and found[3].split(" ")[0] == player.split(" ")[0] and (player == "Ana" or found[3] == player)
    assert seeds == ({} if seed is None else {found[3]: seed})


def test_blocks_of_numbers(spark):
    players = [f"{i} NAME {i}, Test" for i in range(1, 9)]
    assert draw(spark, "\n".join(["1 FALSE, Start", "2 FALSE, Second", "7 FALSE, Far", *players, "3 NOTE, Repeated", "12 TABLE, Behind", "9 LATE, Place"]))[0] == [f"Test Name {i}" for i in range(1, 9)]
    assert draw(spark, "\n".join([*players[:7], "12 GAP, Wide", players[7]])) == ([], {})  # seven places, then nothing that starts at 1
    assert draw(spark, "\n".join([*players, "9 NINTH, Test", "    10 DEEP, Table"])) == ([], {})  # nine places are no draw
    assert draw(spark, None) == ([], {}) == draw(spark, "7Up is no place\n8 of them")


def test_calendar_ranges(spark):
    day = datetime.date
    want = {
        "Mifel\n27 July — 1 August 2026": (day(2026, 7, 27), day(2026, 8, 1)), "VanOpen\nJuly 26-1 2026 | Hard": (day(2026, 7, 26), day(2026, 8, 1)), "July 27 - August 2, 2026": (day(2026, 7, 27), day(2026, 8, 2)),
        "17 - 24 May 2026": (day(2026, 5, 17), day(2026, 5, 24)), "27 - 2 May 2026": (day(2026, 5, 27), day(2026, 5, 2)), "December 28 – 3, 2026": (day(2026, 12, 28), day(2027, 1, 3)),
        "AUGUST 13-23 2026": (day(2026, 8, 13), day(2026, 8, 23)), "1 - 30 February 2026": None, "13 May 2026": None, "July 27 to 31, 2026": None, "27 July - 1 August 2025": None, None: None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "text string").select("text", levels.parse_date_span(F.col("text"), 2026).alias("x")).collect()
    assert {r.text: r.x and (r.x.start, r.x.finish) for r in rows} == want


def test_cities_of_many_words(spark):
    cities = spark.createDataFrame([("san pedro de la sierra", 1), ("san pedro", 2)], "key string, n int")
    names = spark.createDataFrame([("San Pedro de la Sierra Open",), ("San Pedro 2",), ("Elsewhere",)], "name string")
    assert {r.name: r.n for r in with_city(names, "name", cities).collect()} == {"San Pedro de la Sierra Open": 1, "San Pedro 2": 2, "Elsewhere": None}
