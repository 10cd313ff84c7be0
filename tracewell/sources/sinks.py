"""Writing results so that nothing is overwritten: publications, logs of metrics, chained ledgers and their check."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tracewell.operators.receipts import hash_chain

PAYLOAD = {"content", "raw", "visible", "text", "raw_content_b64"}


MANIFEST = "manifest.json"


def _claim(spark: SparkSession, made: str, place: str) -> bool:
    """Give the file ``made`` the name ``place``, in one step, unless that is taken.

    A hard link on a mounted file system, a rename that never overwrites elsewhere; either is done by one of
    several writers only. A store that can do neither raises.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(place).getFileSystem(conf)
    try:
        if fs.getUri().getScheme() == "file":
            nio = jvm.java.io.File
            jvm.java.nio.file.Files.createLink(nio(path(place).toUri().getPath()).toPath(), nio(path(made).toUri().getPath()).toPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(place).toUri(), conf).rename(path(made), path(place), none)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def publish_all(parts: dict[str, DataFrame], folder: str) -> None:
    """Several outputs at once or none; a folder that holds a publication is left as it is and raises.

    Every writer fills a private folder. What is published is what the manifest names, and that appears in
    one step, so of several writers one wins whole. A writer that fails or loses deletes its own
    folder only; one that is killed leaves it behind, where no reader looks.
    """
    spark = next(iter(parts.values())).sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = lambda: FileExistsError(f"{folder} holds a publication")
    if fs.exists(path(f"{folder}/{MANIFEST}")):
        raise taken()
    own = f"_{uuid.uuid4().hex}"
    try:
        for name, df in parts.items():
            df.write.json(f"{folder}/{own}/{name}")
        made = path(f"{folder}/{own}/manifest")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps({"parts": {n: f"{own}/{n}" for n in parts}, "schemas": {n: df.schema.jsonValue() for n, df in parts.items()}}, sort_keys=True).encode()))
        stream.close()
        if not _claim(spark, made.toString(), f"{folder}/{MANIFEST}"):
            raise taken()
    except Exception:
        fs.delete(path(f"{folder}/{own}"), True)
        raise


def publish(df: DataFrame, folder: str) -> None:
    """One output, as :func:`publish_all` does it."""
    publish_all({"data": df}, folder)


def is_published(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def published(spark: SparkSession, folder: str, part: str = "data") -> DataFrame:
    """An output of a publication, by its manifest; without one there is nothing to read."""
    if not is_published(spark, folder):
        raise FileNotFoundError(f"{folder} holds no publication")
    listed = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    return spark.read.schema(StructType.fromJson(listed["schemas"][part])).json(f"{folder}/{listed['parts'][part]}")


def append_metrics(results: DataFrame, path: str) -> None:
    """Sizes and decisions of results that may be kept, never their content."""
    kept = results.where(F.col("persistence") != "DO_NOT_PERSIST").drop(*PAYLOAD)
    kept.write.mode("append").json(path)


def chained(entries: DataFrame, session: str, order: str, payload: Column, digits: int = 64, heads: DataFrame | None = None) -> DataFrame:
    """Every entry with the digest of the one before it and its own, which covers that.

    ``heads`` (session, head) are the digests that sessions go on from. A chain is sequential within a session: a
    task runs through its sessions in order and holds one digest; sessions go in parallel.
    """
    kind = entries.schema[session].dataType.simpleString()
    rows = entries.select(F.col(session).alias("s"), F.col(order).cast("long").alias("at"), payload.alias("payload"))
    before = F.lit(None).cast("string")
    if heads is not None:
        rows, before = rows.join(heads.select(F.col(session).alias("s"), F.col("head").alias("_head")), "s", "left"), F.col("_head")
    placed = rows.select("s", "at", "payload", before.alias("head")).repartition("s").sortWithinPartitions("s", "at", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session_of, held = object(), ""
        for batch in batches:
            links, hashes = [], []
            for s, payload, head in zip(batch["s"], batch["payload"], batch["head"]):
                if s != session_of:
                    session_of, held = s, head or ""
                links.append(held)
                held = hashlib.sha256(":".join([held, payload] if payload is not None else [held]).encode()).hexdigest()[:digits]
                hashes.append(held)
            yield batch.assign(before=links, hash=hashes)[["s", "at", "payload", "before", "hash"]]

    return placed.mapInPandas(run, f"s {kind}, at long, payload string, before string, hash string").withColumnRenamed("s", session)


class StreamLedger:
    """A chained ledger behind a stream: ``foreachBatch(StreamLedger(...))``.

    A micro-batch is published whole, entries and the heads that all sessions then have, under its number. A
    batch that comes again after a crash finds its place taken and writes nothing; one that was cut off
    has published nothing and is written again. Records must come in order within a session.
    """

    def __init__(self, path: str, session: str, order: str, payload: Column, decision: str = "decision", digits: int = 64):
        self.path, self.session, self.order, self.payload, self.decision, self.digits = path, session, order, payload, decision, digits

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{self.path}/batch={number}"
        if is_published(spark, at):
            return
        old = published(spark, f"{self.path}/batch={number - 1}", "heads") if number else None
        new = chained(batch, self.session, self.order, self.payload, self.digits, old)
        counts = batch.groupBy(self.decision).agg(F.count("*").alias("n"))
        ends = new.groupBy(self.session).agg(F.max_by("hash", F.struct("at", "payload")).alias("head"), F.count("*").alias("entries"))
        if old is not None:
            went = old.select(self.session, F.col("head").alias("_h"), F.col("entries").alias("_n"))
            ends = ends.join(went, self.session, "full_outer").select(self.session, F.coalesce("head", "_h").alias("head"), (F.coalesce("entries", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("entries"))
        publish_all({"entries": new, "heads": ends, "counts": counts}, at)

    def _all(self, spark: SparkSession, part: str) -> DataFrame:
        number, found = 0, []
        while is_published(spark, at := f"{self.path}/batch={number}"):
            found.append(published(spark, at, part))
            number += 1
        if not found:
            raise FileNotFoundError(f"{self.path} holds no batch")
        return reduce(DataFrame.union, found)

    def entries(self, spark: SparkSession) -> DataFrame:
        return self._all(spark, "entries")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """What :func:`manifest` makes of all decisions, from the batches' counts."""
        return _manifest(self._all(spark, "counts").groupBy(self.decision).agg(F.sum("n").alias("n")), self.decision)


def write_ledger(entries: DataFrame, session: str, order: str, payload: Column, path: str, digits: int = 64) -> None:
    """A chained ledger; an existing one is never replaced."""
    publish(chained(entries, session, order, payload, digits), path)


def broken_chains(ledger: DataFrame, session: str, digits: int = 64) -> DataFrame:
    """Entries whose digest does not follow from their payload and the entry before: a sound ledger has none."""
    before = F.coalesce(F.lag("hash").over(W.partitionBy(session).orderBy("at", "payload")), F.lit(""))
    want = F.substring(F.sha2(F.concat_ws(":", F.col("want_before"), "payload"), 256), 1, digits)
    return ledger.withColumn("want_before", before).where((F.col("before") != F.col("want_before")) | (F.col("hash") != want)).drop("want_before")


def resume_head(spark: SparkSession, path: str, session: str, digits: int = 64) -> DataFrame:
    """Last digest of every session of a ledger, whose chain is checked first; a broken one raises."""
    ledger = published(spark, path)
    if not broken_chains(ledger, session, digits).isEmpty():
        raise ValueError(f"{path}: the chain is broken")
    return ledger.groupBy(session).agg(F.max_by("hash", F.struct("at", "payload")).alias("head"), F.count("*").alias("entries"))


def _manifest(counts: DataFrame, decision: str) -> DataFrame:
    return counts.agg(F.sum("n").alias("entries"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(decision, "n"))))).alias("counts"))


def manifest(decisions: DataFrame, decision: str = "decision") -> DataFrame:
    """One row: entries, and a count for each decision, in order of name."""
    return _manifest(decisions.groupBy(decision).agg(F.count("*").alias("n")), decision)


__all__ = ["publish", "publish_all", "published", "is_published", "append_metrics", "chained", "StreamLedger", "write_ledger", "broken_chains", "resume_head", "manifest", "hash_chain"]
