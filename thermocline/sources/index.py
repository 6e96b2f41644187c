"""The vector index: one table of chunks with their vectors, and a one-row description."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.operators.cells import describe_cells

#: Rows of a cell that one task writes; a larger cell is cut into as many parts as its count asks for.
CELL_ROWS = 200_000


def write_index(indexed: DataFrame, path: str, model: str = "hashed-words", kind: str = None,
                id_col: str = "chunk_id", cell_rows: int = CELL_ROWS) -> None:
    """Vectors stay next to their metadata. An index with cells is stored by cell, beside a table
    that describes the cells, so that a search reads the cells it needs only."""
    spark, celled = indexed.sparkSession, "cell" in indexed.columns
    if celled:
        counts = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        parts = counts.select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("__parts"))
        salt = F.pmod(F.xxhash64(id_col), F.col("__parts"))
        indexed = (indexed.join(F.broadcast(parts), "cell").withColumn("__salt", salt)  # a row per cell
                   .repartition("cell", "__salt").drop("__parts", "__salt"))
        indexed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    else:
        indexed.write.mode("overwrite").parquet(f"{path}/vectors")
    # An index stored by cell has no file to tell its columns by when it is empty.
    indexed.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    stored = load_index(spark, path)
    if celled:
        describe_cells(stored).write.mode("overwrite").parquet(f"{path}/cells")
    info = index_info(stored, model, kind or ("cells" if celled else "exact"))
    info.write.mode("overwrite").parquet(f"{path}/info")


def index_info(index: DataFrame, model: str, kind: str) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.max(F.size("embedding")).alias("vector_dimension"),
    ).withColumns({"index_type": F.lit(kind), "embedding_model": F.lit(model),
                   "created_at": F.current_timestamp()})


def load_index(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns).parquet(f"{path}/vectors")


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """What ``cell_search`` needs beside the index."""
    return spark.read.parquet(f"{path}/cells")


def load_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/info")


def check_index(vectors: DataFrame, metadata: DataFrame, recorded: int = None, *, vector_key="chunk_id",
                metadata_key="chunk_id") -> DataFrame:
    """Vector, metadata and recorded counts, and how many of each have no partner."""
    v = vectors.groupBy(F.col(vector_key).alias("key")).agg(F.count(F.lit(1)).alias("v"))
    m = metadata.groupBy(F.col(metadata_key).alias("key")).agg(F.count(F.lit(1)).alias("m"))
    sides = v.join(m, "key", "full_outer")
    zero = F.lit(0).cast("long")
    row = sides.agg(
        F.coalesce(F.sum("v"), zero).alias("vectors"),
        F.coalesce(F.sum("m"), zero).alias("metadata_entries"),
        F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("v"))), zero).alias("vectors_unmatched"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("m"))), zero).alias("metadata_unmatched"))
    expected = F.col("vectors") if recorded is None else F.lit(recorded)
    return row.withColumn("consistent", (
        (F.col("vectors") == F.col("metadata_entries")) & (F.col("vectors") == expected)).cast("int"))
