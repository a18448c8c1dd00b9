"""What leaves the boundary: the texts inside a request, what they still hold, and the release of placeholders in actions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.functions import json_text
from shroudline.operators import policy, rules, vault

SKIPPED = frozenset({"redactedScreenshot"})


def leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of every text in a JSON value, without those under a skipped key; an explicit stack, so any depth."""
    stack = [(value, path)]
    while stack:
        v, at = stack.pop()
        if isinstance(v, str):
            yield at, v
        elif isinstance(v, list):
            stack.extend((x, f"{at}[{i}]") for i, x in reversed(list(enumerate(v))))
        elif isinstance(v, dict):
            stack.extend((x, f"{at}.{k}" if at else k) for k, x in reversed(list(v.items())) if k not in SKIPPED)


def json_leaves(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, text) of all readable bodies; a body that is no JSON is one text with an empty path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, texts = [], [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    parsed = json_text.read(raw)
                except ValueError:
                    parsed = raw
                for path, text in leaves(parsed):
                    keys.append(k)
                    paths.append(path)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["key", "path", "text"])

    slim = bodies.where(F.col(body).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(body))
    return slim.mapInArrow(run, "key bigint, path string, text string").withColumnRenamed("key", key)


def gate(texts: DataFrame, key: str, places: int = 10) -> DataFrame:
    """Per request: number of texts with high-risk data left, and the first places; encoded data counts too."""
    held = texts.where(F.col("text") != "").select(key, "path", rules.detect(F.col("text")).alias("spans")).where(rules.has_residual(F.col("spans")))
    return held.groupBy(key).agg(F.count("*").alias("fixes"), F.slice(F.array_sort(F.collect_set("path")), 1, places).alias("where"))


def rehydrate(actions: DataFrame, vaulted: DataFrame, key: str, scope: str, text: str, label: str, origin: str) -> DataFrame:
    """(key, ok, text): the action's text with its placeholders resolved, if every one of them may go where it is going.

    One blocked placeholder blocks the action, and then nothing is resolved; a placeholder the vault does not know blocks
    too.
    """
    held = actions.select(key, F.col(scope).alias("t_scope"), F.col(label).alias("t_label"), F.col(origin).alias("t_origin"), F.explode(F.array_distinct(vault.tokens_in(F.col(text)))).alias("t_token"))
    v = vaulted.select("scope", "token", "type", "value", F.col("origin").alias("v_origin"))
    joined = held.join(v, F.col("t_scope").eqNullSafe(F.col("scope")) & (F.col("t_token") == F.col("token")), "left")
    fine = policy.release_ok(F.col("type"), policy.field_category(F.col("t_label")), F.col("v_origin"), F.col("t_origin")) & F.col("token").isNotNull()
    judged = joined.groupBy(key).agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("ok"), F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "value"))).alias("pairs"))
    whole = actions.select(key, F.col(text).alias("body")).join(judged, key, "left")
    back = F.aggregate("pairs", F.col("body"), lambda acc, p: F.replace(acc, p["token"], p["value"]))
    ok = F.coalesce("ok", F.lit(True))
    return whole.select(key, ok.alias("ok"), F.when(ok & F.col("pairs").isNotNull(), back).when(ok, F.col("body")).alias("text"))


def sse_text(event: Column, data: Column) -> Column:
    """A frame of a server-sent event stream: the event's name and its data, one line each, and the line that ends it."""
    line = F.regexp_replace(data, r"[\r\n]+", " ")
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), line, F.lit("\n\n"))


def sse_frames(streams: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, event, data) of server-sent event streams: frames end at a blank line, frames whose data is no JSON are left out."""
    frames = streams.select(key, F.posexplode(F.split(text, "\r?\n\r?\n")).alias("pos", "frame"))
    data = F.regexp_extract("frame", r"(?m)^data: ?(.*)$", 1)
    event = F.coalesce(F.nullif(F.regexp_extract("frame", r"(?m)^event: ?(.*)$", 1), F.lit("")), F.lit("message"))
    return frames.select(key, "pos", event.alias("event"), data.alias("data")).where(F.try_parse_json("data").isNotNull() | (F.trim("data") == "[DONE]"))


def joined_deltas(frames: DataFrame, key: str, delta: Column) -> DataFrame:
    """(key, text): the deltas of each stream in order, up to the end mark."""
    end = F.min(F.when(F.trim("data").isin("[DONE]", '"[DONE]"'), F.col("pos"))).over(Window.partitionBy(key))
    open_ = frames.withColumn("end", end).where("end is null or pos < end")
    parts = open_.where("event = 'delta'").select(key, "pos", delta.alias("d"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda s: s["d"]), "").alias("text"))
