"""Lists the texts that are still to be embedded, as documents arrive.

An index is only as fresh as its vectors, and vectors are what costs. This job follows a folder of documents as a stream of files: each run (``availableNow``) takes the files that came since the last one, cuts their documents into
chunks as the index does, takes secrets out, and writes each different text once, ever: a text that any run has listed before, from whatever document, is known by its hash and passed over. The output is what an
embedding worker reads, ``(key, text, n_chars)`` in folders by ``shard`` (the key's first hexadecimal digit, so shards are even whatever the sources are).

Spark keeps the account: the checkpoint holds the files taken and the keys listed (RocksDB state, dealt by key), the file sink commits each batch in its own log. A run that is killed is finished by the next one without a
gap or a repeat; a run without new files writes nothing. Work grows with what is new. The number of state partitions is fixed by a checkpoint's first run.

Null and blank texts have no chunks; documents that come again, or copies of others, add only the chunks that are new.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings
from lodeseam.functions.text import redact
from lodeseam.operators.chunking import chunks
from lodeseam.sources.files import is_folder

OPTIONS = ["documents", "output", "checkpoint", "max_files_per_trigger", "state_partitions"]
#: Tasks for each core that the documents of a batch are dealt to.
TASKS_PER_CORE = 4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def worklist(documents: DataFrame) -> DataFrame:
    """``(key, text, n_chars, shard)`` of every chunk of ``documents`` (``doc_id``, ``text``), repeats included."""
    files = documents.select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), "text", F.lit("").alias("file_hash"))
    text = chunks(files).select(redact(F.col("raw_text")).alias("text"))
    return text.select(F.sha2("text", 256).alias("key"), "text", F.length("text").alias("n_chars")).withColumn("shard", F.concat(F.lit("x"), F.substring("key", 1, 1)))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, max_files_per_trigger: int | str = 1000, state_partitions: int | str | None = None) -> dict:
    """Adds the texts of new documents to the list of texts to embed."""
    folder, name = (documents, "*.parquet") if is_folder(spark, documents) else documents.rsplit("/", 1)
    wanted = {"spark__sql__streaming__stateStore__providerClass": ROCKS, "spark__sql__streaming__numRecentProgressUpdates": 100_000}
    if state_partitions:
        wanted["spark__sql__shuffle__partitions"] = state_partitions
    with settings(spark, **wanted):  # a stream copies the settings when it starts
        source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", int(max_files_per_trigger)).option("pathGlobFilter", name).parquet(folder)
        source = source.observe("read", F.count(F.lit(1)).alias("rows"))
        # a file is often one row group, which one task would read and cut alone; by hash, as round robin would sort the rows first
        source = source.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "doc_id")
        new = worklist(source).dropDuplicates(["key"]).observe("written", F.count(F.lit(1)).alias("rows"))
        query = new.writeStream.format("parquet").partitionBy("shard").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = {"batches": 0, "read": 0, "written": 0}
    for p in query.recentProgress:
        seen = p["observedMetrics"]
        if "read" in seen and p["numInputRows"]:
            done = {"batches": done["batches"] + 1, "read": done["read"] + seen["read"]["rows"], "written": done["written"] + seen["written"]["rows"]}
    log.info("embedding_worklist: read %(read)d documents in %(batches)d batches, wrote %(written)d texts", done)
    return done


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """The list as it stands."""
    return spark.read.schema("key string, text string, n_chars int, shard string").parquet(output)


if __name__ == "__main__":
    main(run, "embedding_worklist", OPTIONS, sys.argv[1:])
