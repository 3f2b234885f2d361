"""Name keys against the definition by the Unicode tables, and spelled-out cases."""

import re
import unicodedata

from pyspark.sql import functions as F

from matchlake.functions.names import city_norm, name_key

CASES = {"Iga Świątek": "iga swiatek", "Barbora Krejčíková": "barbora krejcikova", "Miomir Kecmanović": "miomir kecmanovic", "Jo-Wilfried Tsonga": "jo wilfried tsonga", "K. O'Connell": "k o connell", "  Félix  Auger‑Aliassime": "felix auger‐aliassime", None: "", "ﬁve ½": "five 1⁄2", "Łukasz": "łukasz", "Ångström": "angstrom"}


def plain(name):
    if name is None:
        return ""
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[-.'`]", " ", text.lower())).strip()


def test_name_keys(spark):
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x390, 0x400), *range(0x410, 0x460), *range(0x1E00, 0x1EFA)) if chr(c).isalpha() and len(chr(c).lower()) == 1]
    names = [*CASES, *[f"a{x} {unicodedata.normalize('NFD', x)}b" for x in letters]]
    found = {r.n: r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", name_key(F.col("n")).alias("k")).collect()}
    assert found == {n: plain(n) for n in names}
    assert {n: found[n] for n in CASES} == CASES


def test_city_norm(spark):
    cases = {"Adelaide 2": "adelaide", "Hua Hin #2": "hua hin", "Bogotá 40K": "bogota", "St. Pölten 125k 3": "st polten", "2000 Guineas": "2000 guineas"}
    found = {r.n: r.k for r in spark.createDataFrame([(n,) for n in cases], "n string").select("n", city_norm(F.col("n")).alias("k")).collect()}
    assert found == cases
