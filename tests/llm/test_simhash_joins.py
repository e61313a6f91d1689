"""The joins of near-dedup by SimHash build nothing in the driver's memory."""

from quillmesh.llm import components, simhash


def test_no_table_is_broadcast(spark):
    docs = spark.createDataFrame([(i, f"one two three four five w{i % 7} six seven") for i in range(60)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(simhash.near_groups(docs))
    assert "Broadcast" not in plan(simhash.links(spark.range(50).selectExpr("id AS fp")))
    edges = spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")
    assert "Broadcast" not in plan(components._star(edges, True)) and "Broadcast" not in plan(components._star(edges, False))
