"""Files dropped into a folder, ingested as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeworks.engine import Engine
from lodeworks.sources.files import delimited_records, json_records, jsonl_records, text_records, with_route

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def dropped_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, file_name, suffix, text) of the files below a folder, each file once."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(folder)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.regexp_replace(text, "^﻿", "").alias("text"))


def ingest_stream(engine: Engine, folder: str, checkpoint: str, at: str | None = None) -> StreamingQuery:
    """Ingest dropped files until none is left. A batch that is repeated after a failure folds into the same rows."""

    def fold(files: DataFrame, _: int) -> None:
        if files.isEmpty():
            return
        records = json_records(files).unionByName(jsonl_records(files)).unionByName(delimited_records(files)).unionByName(text_records(files))
        engine.ingest_records(with_route(records), at)

    return dropped_files(engine.spark, folder).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
