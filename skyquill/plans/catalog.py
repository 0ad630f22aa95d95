"""All registered queries: name -> (query, oracle SQL or None)."""

from skyquill.plans import preference, replays, spatial, streams, temporal

QUERIES = {**preference.QUERIES, **streams.QUERIES, **spatial.QUERIES, **temporal.QUERIES, **replays.QUERIES}
