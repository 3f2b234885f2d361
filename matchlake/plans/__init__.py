"""Registered queries: each applies an operator to the supplied tables, with the SQL that gives the same rows."""

from matchlake.plans import boards, charting, context, draws, events, evidence, features, gate, ingest, ledger, markets, metrics, predictor, products, publish, ratings, scoreboard, sim, sinks, sources, stream, track, training, venues
from matchlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "boards", "charting", "context", "draws", "events", "evidence", "features", "gate", "ingest", "ledger", "markets", "metrics", "predictor", "products", "publish", "ratings", "scoreboard", "sim", "sinks", "sources", "stream", "track", "training", "venues"]
