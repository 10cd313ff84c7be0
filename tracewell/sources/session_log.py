"""Session logs: JSON lines of calls, outputs and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.lines import read_ranges, running

PAYLOAD = "timestamp string, session string, payload struct<type: string, role: string, id: string, call_id: string, name: string, input: string, output: string>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed lines with their ``line_no``, their ``record_index`` among these, and the ``episode_id``, the user
    messages of the file so far; malformed lines are left out. Files are read and counted by byte ranges."""
    parsed = read_ranges(spark, path).withColumn("r", F.from_json("value", PAYLOAD, {"mode": "PERMISSIVE"}))
    known, message = F.col("r.payload").isNotNull(), F.col("r.payload")
    user = (message["type"] == "message") & (message["role"] == "user")
    counted = running(parsed, {"line_no": F.lit(True), "record_index": known, "episode_id": user})
    return counted.where(known).select("file", "line_no", "record_index", "episode_id", "r.*")


def paired_calls(log: DataFrame) -> DataFrame:
    """Calls with their outputs and episodes; the last record of an id wins on each side."""
    kind, text = F.col("payload.type"), F.col("payload")
    rows = log.withColumn("call_id", F.coalesce(text["call_id"], text["id"]))
    call = rows.where(kind.isin("function_call", "custom_tool_call")).groupBy("file", "call_id").agg(F.max_by(F.struct("record_index", "episode_id", text["name"].alias("name"), text["input"].alias("input")), "record_index").alias("c"))
    output = rows.where(kind.isin("function_call_output", "custom_tool_call_output")).groupBy("file", "call_id").agg(F.max_by(text["output"], "record_index").alias("output"))
    joined = call.join(output, ["file", "call_id"]).select("file", "call_id", "c.*", "output")
    return joined.withColumn("n_bytes", F.octet_length("output").cast("long")).withColumn("sha", F.sha2("output", 256))


def fingerprint(log: DataFrame) -> DataFrame:
    """Per file: records, first and last time in file order, and a histogram of payload types."""
    at = F.when(F.col("timestamp").isNotNull(), F.struct("record_index", "timestamp"))
    types = log.groupBy("file", F.col("payload.type").alias("type")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return types.groupBy("file").agg(F.sum("n").alias("records"), F.min("first")["timestamp"].alias("first"), F.max("last")["timestamp"].alias("last"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """Per file: bytes and digest of the whole file, lines that are records, lines that are none, first and
    last time in file order, sessions, and a histogram of payload types."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", PAYLOAD, {"mode": "PERMISSIVE"}))
    known = F.col("r.payload").isNotNull()
    counts = parsed.groupBy("file").agg(F.count_if(known).alias("records"), F.count_if(~known).alias("malformed"), F.sort_array(F.collect_set("r.session")).alias("sessions"))
    return whole.join(counts, "file", "left").join(fingerprint(read_log(spark, path)).drop("records"), "file", "left")
