"""Streams of features and of changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.filters import compile_filter
from terraloom.sources.geojson import features_of


def read_messages(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """Stream of message texts from new files, one JSON message a line."""
    return spark.readStream.option("maxFilesPerTrigger", files_each).text(path)


def features(messages: DataFrame, text_col: str = "value") -> DataFrame:
    """Features of each message; messages that aren't GeoJSON give none."""
    return messages.select(F.explode(features_of(F.col(text_col))).alias("f")).select("f.id", "f.geometry", "f.properties")


def malformed(messages: DataFrame, text_col: str = "value") -> DataFrame:
    return messages.where(F.size(features_of(F.col(text_col))) == 0)


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, key, n: counts of tumbling windows; rows later than ``late`` are left out once a window has closed."""
    w = F.window(F.col(time_col), window)
    return events.withWatermark(time_col, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


STATE = "attributes map<string,string>"
CHANGE = "key string, ord long, op string, attributes map<string,string>"


def _apply(key, batches: Iterator, state):
    """Changes of one key in their order, merged into its attributes."""
    import pandas as pd

    rows = pd.concat(list(batches)).sort_values("ord")
    now = dict(state.get[0]) if state.exists else {}
    out = []
    for ord_, op, patch in zip(rows["ord"], rows["op"], rows["patch"]):
        now = {} if op in ("remove", "clear") else now | dict(patch or {})
        out.append((key[0], int(ord_), op, dict(now)))
    if now:
        state.update((now,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["key", "ord", "op", "attributes"])


def keyed_state(changes: DataFrame) -> DataFrame:
    """Stream of (key, ord, op, attributes): the attributes of a key after each of its changes.

    ``changes`` has key, ord, op (set, remove, clear), patch (map).  The state
    of a key is kept in Spark's state store, so it survives restarts.
    """
    return changes.groupBy("key").applyInPandasWithState(_apply, CHANGE, STATE, "append", "NoTimeout")


def filtered(stream: DataFrame, expr) -> DataFrame:
    return stream.where(compile_filter(expr))


def upsert_into(path: str, key: str):
    """foreachBatch function: merges each batch (op, columns) into the table at ``path``, one version a batch.

    The latest version is a whole table; earlier ones stay readable, so a batch
    that is run again after a failure writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("op != 'remove'").drop("op")
        out = new
        if number > 0:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            out = old.join(batch.select(key).distinct(), key, "left_anti").unionByName(new)
        out.write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge
