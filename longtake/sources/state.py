"""State documents: checkpoints, metadata and reports stored as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
CHECKPOINT = (
    "job_id long, fingerprint string, "
    "chunks map<string,array<struct<start:double,end:double,text:string>>>"
)


def read_state(
    spark: SparkSession, path: str, schema: str, *, multi_line: bool = True
) -> DataFrame:
    """Documents that fit ``schema``; broken ones count as missing, and so does a missing folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    with_corrupt = f"{schema}, {CORRUPT} string"
    rows = spark.read.json(path, schema=with_corrupt, multiLine=multi_line, mode="PERMISSIVE")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def done_chunks(checkpoints: DataFrame) -> DataFrame:
    """The chunk map of each checkpoint as rows."""
    return checkpoints.select("job_id", F.explode("chunks").alias("chunk", "segments")).select(
        "job_id", F.col("chunk").cast("long").alias("chunk_idx"), "segments"
    )
