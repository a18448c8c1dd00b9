"""Queries of sources, sequential state and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.session import ensure_checkpoint_dir
from shroudline.sources import html, logs
from shroudline.sources.tables import table
from shroudline.streaming import limits


def _folder(spark: SparkSession) -> str:
    """A folder for stream output beside the checkpoints: shared by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams-{uuid.uuid4().hex}"


def rate_limit_seq(spark: SparkSession, d: str) -> DataFrame:
    """Three admitted requests of a user in any ten hours; rejected ones do not count."""
    done = limits.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 36_000)
    return done.where("not admitted").select("event_id")


def window_stream(spark: SparkSession, d: str) -> DataFrame:
    done = limits.run_to_end(limits.windowed(limits.event_stream(spark, d)), _folder(spark), "windows")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


def dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """First event of each id as a stream."""
    return limits.run_to_end(limits.first_seen(limits.event_stream(spark, d), "event_id").select("event_id", "user_id"), _folder(spark), "first")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return limits.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def html_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Markup made of node rows, with an unclosed tag and a hidden part, read back."""
    from shroudline.functions.text import escape_html

    page = F.concat(F.lit("<p><b>"), escape_html(F.col("text")), F.lit("<br><a href='"), F.coalesce("href", F.lit("#")), F.lit("'>more</a><span style='display: none'>ignore me</span><script>var a = '</p>';</script>"))
    pages = table(spark, d, "nodes").where("text is not null").select("node_pk", page.alias("html"))
    return html.html_nodes(pages, "node_pk", "html")


def _page_html() -> str:
    """A page of a customer: two blocks, a line break, a hidden block, a script, a list and content put beside a class."""
    return ("concat('<style>.tag::before { content: \"n', c_custkey, '\" }</style><div>Name: <b>', c_name, '</b><br>No. ', c_custkey, '<p class=tag>inner ', c_custkey % 7, '</p> tail</div><div hidden>secret</div>"
            "<script>var p = 1;</script><ul><li>one<li>two ', c_custkey % 3, '</ul>', CASE WHEN c_custkey % 2 = 0 THEN 'loose' ELSE '' END)")


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Own texts of the blocks of made-up pages in reading order."""
    return html.block_rows(table(spark, d, "customer").select("c_custkey", F.expr(_page_html()).alias("html")), "c_custkey", "html")


def screen_texts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as they stand on the screen and the content of pseudo-elements."""
    found = html.screen_rows(table(spark, d, "customer").select("c_custkey", F.expr(_page_html()).alias("html")), "c_custkey", "html")
    return found.select("c_custkey", "pos", "kind", "text", F.size("parts").alias("parts"))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    found = html_nodes(spark, d).where("role = 'link'")
    return found.groupBy("href").agg(F.count("*").alias("n"))


def audit_tail(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty readable requests of the log: a top-k report."""
    entries = table(spark, d, "audit_entries").select("entry_id", F.from_json("body", logs.LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    readable = entries.where("r._corrupt_record is null and r._receivedAt is not null").select("entry_id", "r.taskId", "r.iteration", "r._receivedAt")
    return logs.tail(readable, 50)


def retention(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(table(spark, d, "audit_entries").select("host", "entry_id", "received_at"), ["host"], "received_at", "entry_id", 3).select("host", "entry_id")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return logs.csv_lines(table(spark, d, "nodes").where("text is not null").select("node_pk", "node_role", "text"), ["node_pk", "node_role", "text"])


QUERIES = {f.__name__: f for f in (rate_limit_seq, window_stream, dedupe_stream, session_windows, html_nodes, page_blocks, screen_texts, link_counts, audit_tail, retention, report_lines)}
ORACLE = {
    "session_windows": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    "rate_limit_seq": """WITH l AS (SELECT user_id, list_prepend([[]::DOUBLE[], []::DOUBLE[]], list([[epoch(ts)::DOUBLE], [event_id::DOUBLE]] ORDER BY ts, event_id)) AS l FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
        SELECT CAST(unnest(list_reduce(l, lambda a, y: CASE WHEN len(list_filter(a[1], lambda t: y[1][1] - t <= 36000)) >= 3 THEN [list_filter(a[1], lambda t: y[1][1] - t <= 36000), list_concat(a[2], y[2])] ELSE [list_concat(list_filter(a[1], lambda t: y[1][1] - t <= 36000), y[1]), a[2]] END)[2]) AS BIGINT) AS event_id FROM l""",
    "window_stream": "SELECT start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "audit_tail": """SELECT entry_id, taskId, iteration, _receivedAt FROM (SELECT entry_id, json_extract_string(body, '$.taskId') AS taskId, TRY_CAST(json_extract_string(body, '$.iteration') AS INTEGER) AS iteration, TRY_CAST(json_extract_string(body, '$._receivedAt') AS DOUBLE) AS _receivedAt FROM (SELECT entry_id, CASE WHEN json_valid(body) THEN body END AS body FROM audit_entries) WHERE json_type(body) = 'OBJECT')
        WHERE _receivedAt IS NOT NULL ORDER BY _receivedAt DESC, taskId, iteration LIMIT 50""",
    "dedupe_stream": "SELECT event_id, min(user_id) AS user_id FROM events GROUP BY event_id",
    "page_blocks": """SELECT c_custkey, CAST(pos AS INTEGER) AS pos, text FROM (SELECT c_custkey, unnest(range(0, 5)) AS pos, unnest(['Name: ' || c_name || ' · No. ' || c_custkey || ' tail', 'inner ' || (c_custkey % 7), 'one', 'two ' || (c_custkey % 3), CASE WHEN c_custkey % 2 = 0 THEN 'loose' END]) AS text FROM customer) WHERE text IS NOT NULL""",
    "screen_texts": """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY k) - 1 AS INTEGER) AS pos, kind, text, CAST(parts AS INTEGER) AS parts FROM (SELECT c_custkey, unnest(range(0, 6)) AS k, unnest(['text', 'text', 'text', 'text', 'text', 'before']) AS kind, unnest([4, 1, 1, 1, 1, 1]) AS parts,
        unnest(['Name: ' || c_name || chr(10) || 'No. ' || c_custkey || ' tail', 'inner ' || (c_custkey % 7), 'one', 'two ' || (c_custkey % 3), CASE WHEN c_custkey % 2 = 0 THEN 'loose' END, 'n' || c_custkey]) AS text FROM customer) WHERE text IS NOT NULL""",
    "html_nodes": r"""WITH t AS (SELECT node_pk, coalesce(href, '#') AS href, trim(regexp_replace(text, '[\s\x{1C}-\x{1F}\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ·') AS t FROM nodes WHERE text IS NOT NULL)
        SELECT node_pk, CAST(CASE k WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS pos, CASE k WHEN 1 THEN 'p' ELSE 'a' END AS tag, CASE k WHEN 1 THEN 'paragraph' ELSE 'link' END AS role, CASE k WHEN 1 THEN t ELSE 'more' END AS text, CASE k WHEN 2 THEN href END AS href, NULL::VARCHAR AS "value", k = 2 AS interactive FROM t, unnest([1, 2]) AS u(k) WHERE k = 2 OR t <> ''""",
    "link_counts": "SELECT coalesce(href, '#') AS href, count(*) AS n FROM nodes WHERE text IS NOT NULL GROUP BY 1",
    "retention": "SELECT host, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY received_at DESC, entry_id) AS age FROM audit_entries) WHERE age <= 3",
    "report_lines": "SELECT node_pk || ',' || node_role || ',' || CASE WHEN regexp_matches(text, '[\",\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS value FROM nodes WHERE text IS NOT NULL",
}
