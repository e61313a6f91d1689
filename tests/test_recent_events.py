"""The ring buffer as state of a stream, against the batch operators, with restarts."""

import random

from pyspark.sql import functions as F

from quillmesh.operators import metrics
from quillmesh.streaming import recent_events as R

SCHEMA = "user_id long, id long, ts timestamp, type string, durationMs long, provider string, tokensIn long, tokensOut long, chunks int, files int, blocked boolean, redactedChunks int"


def made(spark, seed, first, n):
    r, rows = random.Random(seed), []
    for i in range(first, first + n):
        t = r.choice(["llm", "embed", "index", "search", "safety", "other"])
        some = lambda: r.choice([None, r.randrange(9)])
        rows.append((r.randrange(3), i, r.randrange(50), t, some(), r.choice(["gemini", "groq", "mlc", "x", None]), some(), some(), some(), some(), r.choice([True, False, None]), some()))
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "long"))
    return df.withColumn("ts", F.timestamp_seconds(F.col("ts")))


def test_buffers_and_totals_go_on_after_a_restart(spark, tmp_path):
    spark.conf.set(*R.STORE)
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        R.recent_and_totals(stream, most=20).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).collect()
        return {k: max((x for x in rows if x.user_id == k), key=lambda x: x.batch) for k in {x.user_id for x in rows}}

    for part in range(3):  # each a restart from the checkpoint
        made(spark, part, 100 * part, 90).coalesce(1).write.mode("append").parquet(src)
        got, all_ = run(), spark.read.schema(SCHEMA).parquet(src)
        for user, row in got.items():
            mine = all_.where(F.col("user_id") == user)
            recent = metrics.recent(mine, 20).collect()
            assert list(row.ids) == [x.id for x in recent] and row.held == len(recent) and row.last_ts == recent[0].ts and row.first_ts == recent[-1].ts
            want = metrics.totals(mine).first().asDict()
            assert {n: row[n] for n in want} == want
    assert len(got) == 3
