"""Files that arrive in a folder, chunked and upserted batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import chunking
from lexigrid.storage import shared_dir


def watch(spark: SparkSession, folder: str, schema: str = "doc_id string, text string", files_each: int = 1) -> DataFrame:
    """A stream of the Parquet rows that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def ingest(stream: DataFrame, engine, checkpoint: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP):
    """Start a query that upserts what arrives into the graph of ``engine``; one query holds a checkpoint folder."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates(["doc_id"]).persist()
        docs = rows.select("doc_id", F.col("doc_id").alias("title"), F.sha2("text", 256).alias("content_hash"))
        engine.ingest(docs, chunking.chunk_words(rows, size, overlap))
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, and return its result as a written table.

    In ``complete`` and ``update`` mode the last value of each batch is kept by rewriting, respectively appending.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    out = f"{home}/table"

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
