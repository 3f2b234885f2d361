"""Products over every row."""

from matchlake import plans
from matchlake.sources.adapters import matches

SF = "/root/testdata/sf0.001"


def test_every_match_has_its_place(spark):
    found = plans.QUERIES["upcoming_order_all"](spark, SF).collect()
    rows = {r["match_id"]: (r["event_id"], r["date"], -r["round_order"], r["match_id"]) for r in matches(spark, SF).collect()}
    assert {r["match_id"] for r in found} == rows.keys() and len(found) == len(rows)
    ordered = [rows[r["match_id"]] for r in sorted(found, key=lambda r: (r["event_id"], r["place"]))]
    assert ordered == sorted(rows.values()) and max(r["place"] for r in found) > 3
