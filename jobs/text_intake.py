"""Takes in new texts and tells what each holds: points, an ordering, faulty data or other text.

    python -m jobs.text_intake --tables DIR --output DIR --checkpoint DIR [--config FILE]

Clouds, graphs and orderings come as text. Before anything is read from a text, this job describes it line by line with
the readers' own grammar: lines of each kind, the number announced on line 1, the first line that holds no data, and the
format. It follows the table's folder as a stream of files: each run takes the files that are new since the last one
(``availableNow``), a bounded number at a time, and stops. What was taken is kept in the checkpoint, and the sink's own
log makes each batch count once; a run that finds nothing new, or is started again after it broke off, changes nothing
that was written. The output is partitioned (by language, as shipped; an empty one counts as none).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.functions import lines
from tessera.operators import intake

log = logging.getLogger("text_intake")
REPORT = ", ".join(["id long", "source string", "n_lines long", *[f"n_{k} long" for k in lines.KINDS], "first_text long", "announced long", "format string", "part string"])


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, config: dict) -> dict:
    """Appends reports of the new texts to ``output``; returns how many texts were read and how many reports there are now."""
    place = f"{tables.rstrip('/')}/{config['table']}"
    # the stream's schema comes from the files' footers; as a pattern, the path may name a folder of files or one file
    schema = spark.read.parquet(place).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{place[:-1]}[{place[-1]}]")
    part = F.col(config["partition"]).cast("string")
    texts = stream.select(F.col(config["id"]).cast("long").alias("id"), F.col(config["source"]).cast("string").alias("source"), F.when(part != "", part).alias("part"), F.col(config["text"]).alias("text"))
    report = intake.described(texts, "text", config["comment"])
    query = report.writeStream.format("parquet").partitionBy("part").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    total = read(spark, output).count()
    log.info("read %d new texts of %s; %s holds %d reports", taken, config["table"], output, total)
    return {"read": taken, "reports": total}


def read(spark: SparkSession, output: str) -> DataFrame:
    """All reports as they stand."""
    return spark.read.schema(REPORT).parquet(output)


if __name__ == "__main__":
    common.main("text_intake", "Describes new texts line by line.", {"tables": "folder of the tables", "output": "folder to append to", "checkpoint": "folder of the stream's progress"}, run)
