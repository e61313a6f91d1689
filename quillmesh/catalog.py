"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from quillmesh.plans import chat, corpus, retrieval, steps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, chat, corpus, steps):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)


def flagship(spark, sf_dir):
    return QUERIES["hybrid_search"](spark, sf_dir)
