"""The driver's tables as the engine's inputs."""

from pyspark.sql import functions as F

from quillmesh.functions.vectors import doubles
from quillmesh.operators.bm25 import build_index


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), "label")


def vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 100 asks."""
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label")


def texts(spark, sf_dir):
    """The documents, dealt out where the file has fewer splits than there are cores."""
    docs, cores = documents(spark, sf_dir), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def numbered(spark, sf_dir, rows, id_col, *columns):
    """``rows`` with the vector ``v``, or the columns asked for, whose number is the row's, counted around: every row has one. The pairing is synthetic."""
    store = vectors(spark, sf_dir).select(F.col("id").alias("__v"), *(columns or ("v",)))
    return rows.join(store, F.pmod(F.col(id_col), F.lit(store.count())) == F.col("__v")).drop("__v")


def chunks(spark, sf_dir):
    """All documents with their vectors."""
    return numbered(spark, sf_dir, texts(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source"), "id")


def text_index(spark, sf_dir):
    """The BM25 index of ``chunks``: of the texts that have a vector, without joining the vectors to them."""
    store = vectors(spark, sf_dir).select(F.col("id").alias("__v"))
    rows = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return build_index(rows.join(store, F.pmod(F.col("id"), F.lit(store.count())) == F.col("__v"), "left_semi"), "id", "text")


def text_queries(spark, sf_dir):
    """Every benchmark passage asks, with its vector."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return numbered(spark, sf_dir, items, "query_id").withColumnRenamed("v", "q")
