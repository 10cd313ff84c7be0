"""Tables, and the tool-call view that session analytics run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_calls(events: DataFrame) -> DataFrame:
    """Captured tool calls of every session in call order, from an event table.

    One window over the session numbers the calls and counts its episodes; everything else is
    row-local.
    """
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    family = F.create_map(*[F.lit(x) for pair in FAMILY_OF_EVENT.items() for x in pair])[kind]
    content = F.repeat(F.concat(F.lit("row "), (k % 5).cast("string"), F.lit("\n")), (1 + (k % 5) * 12).cast("int"))
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        F.row_number().over(order).cast("long").alias("call_index"),
        F.sum((kind == "signup").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("episode_id"),
        family.alias("tool_family"),
        (kind == "purchase").alias("is_mutation"),
        (kind == "error").cast("long").alias("exit_code"),
        k.alias("k"),
        F.concat(F.lit("src/m"), (k % 7).cast("string"), F.lit(".py")).alias("target_path"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.sha2(content, 256).alias("sha"),
        (k % 11 == 0).alias("truncated"),
    )


FAMILY_OF_EVENT = {"view": "FILE_READ", "click": "SEARCH", "signup": "DIRECTORY_LIST", "purchase": "WRITE_OR_EDIT", "error": "TEST"}

#: The families a report always lists, in order.
FAMILIES = ("FILE_READ", "SEARCH", "DIRECTORY_LIST", "WRITE_OR_EDIT", "TEST", "GIT")

TOOL_CALLS_SQL = """tool_calls AS (
  SELECT event_id, ts, 'u' || user_id AS session_id,
    row_number() OVER o AS call_index,
    CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_id,
    CASE event_type WHEN 'view' THEN 'FILE_READ' WHEN 'click' THEN 'SEARCH' WHEN 'signup' THEN 'DIRECTORY_LIST' WHEN 'purchase' THEN 'WRITE_OR_EDIT' WHEN 'error' THEN 'TEST' END AS tool_family,
    event_type = 'purchase' AS is_mutation, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS exit_code,
    k, 'src/m' || (k % 7) || '.py' AS target_path, content, strlen(content) AS n_bytes, sha256(content) AS sha, k % 11 = 0 AS truncated
  FROM (SELECT *, repeat('row ' || (k % 5) || chr(10), 1 + (k % 5) * 12) AS content
        FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events))
  WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""
