"""Queries of the trust boundary and of streams of events as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.operators import egress, rules, vault
from shroudline.plans import detection
from shroudline.plans.privacy import _LEAVES
from shroudline.sources.tables import table


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return egress.json_leaves(table(spark, d, "step_messages"), "msg_id", "last_action_result")


def egress_gate(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose texts still hold high-risk data."""
    done = egress.gate(egress.json_leaves(table(spark, d, "audit_entries"), "entry_id", "body"), "entry_id")
    return done.select("entry_id", "fixes", F.array_join("where", ",").alias("places"))


def rehydrated(spark: SparkSession, d: str) -> DataFrame:
    """Customers' mail addresses as placeholders, released into mail fields only."""
    mail = F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@mail.example"))
    found = table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("scope"), F.lit("EMAIL").alias("type"), mail.alias("value"), "c_custkey", F.lit("https://a.example").alias("origin"))
    vaulted = vault.build(found.withColumn("scope", F.col("scope").cast("string")), ["c_custkey"], "origin")
    label = F.when(F.col("c_custkey") % 3 == 0, "Your e-mail").when(F.col("c_custkey") % 3 == 1, "Message").otherwise("E-mail address")
    place = F.when(F.col("c_custkey") % 5 == 0, "https://b.example").otherwise("https://a.example")
    actions = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100).cast("string").alias("scope"), F.lit("Write to [EMAIL_1] now").alias("text"), label.alias("label"), place.alias("place"))
    return egress.rehydrate(actions, vaulted, "c_custkey", "scope", "text", "label", "place")


def sse_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Prompts cut into three deltas, sent with a broken frame between, put together again."""
    p = F.coalesce("prompt", F.lit(""))
    third = F.ceil(F.length(p) / 3).cast("int")
    frame = lambda s: F.concat(F.lit("event: delta\ndata: "), F.to_json(F.struct(s.alias("d"))), F.lit("\n\n"))
    pieces = [F.substr(p, (third * i + 1).cast("int"), third) for i in range(3)]
    stream = F.concat(frame(pieces[0]), F.lit("event: delta\ndata: {broken\n\n"), frame(pieces[1]), F.lit(": comment\n\n"), frame(pieces[2]), F.lit("event: result\ndata: {}\n\n"))
    streams = table(spark, d, "step_messages").where("prompt is not null and prompt != ''").select("msg_id", stream.alias("stream"))
    return egress.joined_deltas(egress.sse_frames(streams, "msg_id", "stream"), "msg_id", F.get_json_object("data", "$.d"))


QUERIES = {f.__name__: f for f in (json_leaves, egress_gate, rehydrated, sse_deltas)}
ORACLE = {
    "egress_gate": f"""WITH {_LEAVES}, {detection.spans_sql("SELECT k, text AS body FROM leaves WHERE text <> ''")}, bad AS (SELECT DISTINCT entry_id, k, path FROM spans JOIN leaves USING (k) WHERE type IN ({', '.join(repr(t) for t in rules.HIGH_RISK)}) AND NOT regexp_matches("value", '^[Xx*]{{4}}'))
        SELECT entry_id, count(*) AS fixes, array_to_string((list_sort(list_distinct(list(path))))[1:10], ',') AS places FROM bad GROUP BY entry_id""",
    "json_leaves": """SELECT msg_id, k AS path, json_extract_string(last_action_result, '$.' || k) AS text FROM (SELECT msg_id, last_action_result, unnest(json_keys(last_action_result)) AS k FROM step_messages WHERE last_action_result IS NOT NULL AND json_valid(last_action_result))
        WHERE json_type(last_action_result, '$.' || k) = 'VARCHAR'""",
    "rehydrated": """WITH v AS (SELECT c_custkey % 100 AS scope, arg_min(lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@mail.example', c_custkey) AS value FROM customer GROUP BY 1)
        SELECT c_custkey, ok, CASE WHEN ok THEN 'Write to ' || value || ' now' END AS text FROM (SELECT c_custkey, c_custkey % 3 <> 1 AND c_custkey % 5 <> 0 AS ok, value FROM customer JOIN v ON v.scope = c_custkey % 100)""",
    "sse_deltas": "SELECT msg_id, prompt AS text FROM step_messages WHERE prompt IS NOT NULL AND prompt <> ''",
}
