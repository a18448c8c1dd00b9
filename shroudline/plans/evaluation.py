"""Queries of evaluation: corpora with gold, hard negatives, sizes, objects, leaks and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.operators import metrics
from shroudline.plans import sequences
from shroudline.plans.sequences import _boxes
from shroudline.sources import corpora
from shroudline.sources.tables import table


def corpus_detection(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision and false alarms of the rules over both made corpora."""
    return metrics.corpus_scores(corpora.predictions(corpora.corpora(spark)), "corpus")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sentences: gold and found spans made of their lines, some orders without gold."""
    start = (F.col("l_linenumber") * 20 + F.col("l_suppkey") % 7).cast("int")
    g = F.struct(start.alias("start"), (start + 6).alias("end"), F.lit("X").alias("type"))
    p = F.struct((start + F.col("l_partkey") % 8).cast("int").alias("start"), (start + F.col("l_partkey") % 8 + 5).cast("int").alias("end"), F.lit("X").alias("type"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when((F.col("l_orderkey") % 4 > 0) & (F.col("l_linenumber") < 5), g)).alias("gold"), F.collect_set(F.when(F.col("l_partkey") % 3 > 0, p)).alias("found"))
    return lines.withColumn("part", (F.col("l_orderkey") % 6).cast("int"))


def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.corpus_scores(_judged(spark, d), "part")


def size_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of boxes by their width, invalid ones ignored."""
    gold = _boxes(spark, d, 0).select(F.col("node_pk").alias("gold_id"), "w", (F.col("node_pk") % 13 == 0).alias("invalid"))
    return metrics.size_recall(gold, sequences.face_match(spark, d), "gold_id", "w")


def object_recall(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of each page that the union of the predicted ones covers."""
    return metrics.object_recall(_boxes(spark, d, 0), _boxes(spark, d, 3), "page_id", "node_pk")


def leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Received texts that hold a secret, spaces or not."""
    secrets = table(spark, d, "customer").where("c_custkey < 30").select(F.expr("concat('code ', c_custkey, ' x')").alias("secret"))
    received = table(spark, d, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('say code ', c_custkey % 50, ' x now') WHEN 1 THEN concat('code', c_custkey % 50, 'x') ELSE concat('code ', c_custkey % 50) END").alias("t"))
    return metrics.leaked(received, secrets, "c_custkey", "t")


def type_recall(spark: SparkSession, d: str) -> DataFrame:
    """Types each order's lines should show and those they do."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("PAN", "EMAIL", "PHONE", "NAME")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    images = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(kinds).alias("gold"), F.collect_list(F.when(F.col("l_partkey") % 3 > 0, kinds)).alias("found"))
    return metrics.type_recall(images, "l_orderkey", "gold", "found")


QUERIES = {f.__name__: f for f in (corpus_detection, sentence_scores, size_recall, object_recall, leak_check, type_recall)}
ORACLE = {
    "sentence_scores": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber * 20 + l_suppkey % 7 AS INTEGER) AS s FROM lineitem), g AS (SELECT DISTINCT l_orderkey, s, s + 6 AS e FROM l WHERE l_orderkey % 4 > 0 AND l_linenumber < 5), p AS (SELECT DISTINCT l_orderkey, s + l_partkey % 8 AS s, s + l_partkey % 8 + 5 AS e FROM l WHERE l_partkey % 3 > 0),
        h AS (SELECT g.l_orderkey, g.s, sum(least(p.e, g.e) - greatest(p.s, g.s)) AS n FROM g JOIN p ON p.l_orderkey = g.l_orderkey AND g.s < p.e AND p.s < g.e GROUP BY ALL),
        o AS (SELECT DISTINCT l_orderkey FROM l), c AS (SELECT l_orderkey, (SELECT count(*) FROM g WHERE g.l_orderkey = o.l_orderkey) AS g, (SELECT count(*) FROM h WHERE h.l_orderkey = o.l_orderkey AND n * 2 >= 6) AS h, (SELECT count(*) FROM p WHERE p.l_orderkey = o.l_orderkey) AS p, (SELECT count(*) FROM p WHERE p.l_orderkey = o.l_orderkey AND EXISTS (SELECT 1 FROM g WHERE g.l_orderkey = p.l_orderkey AND g.s < p.e AND p.s < g.e)) AS r FROM o),
        s AS (SELECT CAST(l_orderkey % 6 AS INTEGER) AS part, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(h) AS BIGINT) AS hit, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(r) AS BIGINT) AS "right", count(*) FILTER (g = 0) AS negatives, count(*) FILTER (g = 0 AND p > 0) AS false_alarms FROM c GROUP BY 1), q AS (SELECT *, round(hit / nullif(gold, 0), 3) AS recall, round("right" / nullif(predicted, 0), 3) AS precision FROM s)
        SELECT *, round(2 * recall * precision / nullif(recall + precision, 0), 3) AS f1 FROM q""",
    "size_recall": f"""SELECT bucket, count(*) AS gold, count(m) AS hit, round(count(m) / count(*), 3) AS recall FROM (SELECT CASE WHEN rect.w >= 96 THEN '96+' WHEN rect.w >= 48 THEN '48-96' WHEN rect.w >= 24 THEN '24-48' END AS bucket, m FROM nodes LEFT JOIN (SELECT DISTINCT gold_id AS m FROM ({sequences.ORACLE['face_match']})) ON m = node_pk
        WHERE rect.w > 0 AND rect.h > 0 AND node_pk % 4 > 0 AND node_pk % 13 > 0) WHERE bucket IS NOT NULL GROUP BY bucket""",
    "object_recall": """WITH g AS (SELECT page_id, node_pk, rect.x AS x, rect.w AS w, rect.h AS h, unnest(range(rect.y, rect.y + rect.h)) AS r FROM nodes WHERE rect.w > 0 AND rect.h > 0 AND node_pk % 4 > 0), p AS (SELECT page_id, unnest(range(rect.y + 3, rect.y + 3 + rect.h)) AS r, rect.x + 3 AS a, rect.x + 3 + rect.w AS b FROM nodes WHERE rect.w > 0 AND rect.h > 0 AND (node_pk + 3) % 4 > 0),
        f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY page_id, r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p), i AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id, r ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f), u AS (SELECT page_id, r, min(a) AS a, max(b) AS b FROM i GROUP BY page_id, r, k),
        m AS (SELECT g.page_id, node_pk, w, h, coalesce(sum(least(b, x + w) - greatest(a, x)), 0) AS px FROM g LEFT JOIN u ON u.page_id = g.page_id AND u.r = g.r AND a < x + w AND b > x GROUP BY ALL) SELECT page_id, count(*) AS objects, count(*) FILTER (px >= 0.9 * w * h) AS covered FROM m GROUP BY page_id""",
    "leak_check": "SELECT c_custkey, 'code ' || (c_custkey % 50) || ' x' AS secret FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 50 < 30 AND c_custkey % 50 IN (SELECT c_custkey FROM customer)",
    "type_recall": """WITH l AS (SELECT l_orderkey, ['PAN', 'EMAIL', 'PHONE', 'NAME'][l_suppkey % 4 + 1] AS k, l_partkey % 3 > 0 AS seen FROM lineitem), t AS (SELECT l_orderkey, k, bool_or(seen) AS seen FROM l GROUP BY ALL)
        SELECT l_orderkey, coalesce(string_agg(k, ',' ORDER BY k) FILTER (NOT seen), '') AS missed, round(count(*) FILTER (seen) / count(*), 3) AS recall FROM t GROUP BY 1""",
}
