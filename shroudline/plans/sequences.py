"""Queries of collections, loop guards, summaries, vectors, boxes and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroudline.operators import collect, metrics, vision
from shroudline.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


# collections and bounded lists
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """First item of each key in order of collection."""
    item = F.from_json("item_json", "href string, url string, text string", {"mode": "PERMISSIVE"})
    items = table(spark, d, "collected_items").where("item_json is not null").select("item_id", "task_id", collect.item_key(item["href"], item["url"], item["text"], F.col("item_json")).alias("key"))
    return collect.first_wins(items, ["key"], ["item_id"]).select("key", "item_id", "task_id")


def merge_cap(spark: SparkSession, d: str) -> DataFrame:
    """Nodes' addresses of the first half merged with those of the second, capped: a top-k list."""
    nodes = table(spark, d, "nodes").where("href is not null").select("href", "node_pk")
    half = F.col("node_pk") % 2
    old = collect.first_wins(nodes.where(half == 0), ["href"], ["node_pk"])
    return collect.merge_capped(old, nodes.where(half == 1), "href", "node_pk", 3000)


def fact_upsert(spark: SparkSession, d: str) -> DataFrame:
    return collect.upsert_facts(_events(spark, d).select(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("key"), "event_id", "value"), "key", "value", "event_id", 100)


def template_upsert(spark: SparkSession, d: str) -> DataFrame:
    return collect.upsert_templates(table(spark, d, "step_messages").where("prompt is not null"), "prompt", "msg_id", 50)


def newest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return collect.newest(_events(spark, d), ["user_id"], "ts", "event_id", 5).select("user_id", "event_id", "rn")


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each node in its page's reading order."""
    w = Window.partitionBy("page_id").orderBy("frame_id", "pos", "node_pk")
    return table(spark, d, "nodes").select("node_pk", F.row_number().over(w).alias("place"))


def roi_top(spark: SparkSession, d: str) -> DataFrame:
    """The forty largest boxes of a page of at least twenty pixels a side: a top-k report."""
    boxes = table(spark, d, "nodes").where("rect.w >= 20 and rect.h >= 20").withColumn("area", F.col("rect.w").cast("bigint") * F.col("rect.h"))
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), "node_pk")
    return boxes.withColumn("rn", F.row_number().over(w)).where("rn <= 40").select("page_id", "node_pk", "area", "rn")


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered marks of interactive nodes: the number in the id."""
    return table(spark, d, "nodes").where("interactive").select("node_pk", F.try_to_number(F.regexp_extract("id", r"(\d+)$", 1), F.lit("9999999")).cast("int").alias("mark"))


def field_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes").where("label is not null")
    secret = F.col("node_role") == "checkbox"
    return rows.select("node_pk", collect.field_text(F.col("label"), F.col("field_value"), secret, F.col("placeholder").isNotNull(), F.lit(None).cast("string")).alias("line"))


def site_config_join(spark: SparkSession, d: str) -> DataFrame:
    """Texts by site configuration; hosts without one are generic."""
    sites = table(spark, d, "site_hosts").select(F.col("host").alias("s_host"), F.col("site_config_id").alias("config"))
    joined = table(spark, d, "nodes").join(sites, F.col("host") == F.col("s_host"), "left")
    return joined.groupBy(F.coalesce("config", F.lit("generic")).alias("config")).agg(F.count("*").alias("nodes"))


def mock_collect(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").withColumn("task", F.coalesce("task_id", F.lit("")))
    return collect.mock_collect(nodes, "task", ["node_pk"], 10).select("task", "item", "node_pk", "rn")


def synth_concat(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a task joined in order; a task's share is bounded by its iterations."""
    said = table(spark, d, "step_messages").where("prompt is not null").groupBy(F.lower(F.trim("task_id")).alias("task"), "iteration").agg(F.min("prompt").alias("prompt"))
    return said.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "prompt"))), lambda s: s["prompt"]), "\n").alias("answer"))


def sanitize_items(spark: SparkSession, d: str) -> DataFrame:
    schema = "author string, text string, timestamp string, href string, fields map<string,string>"
    parsed = table(spark, d, "collected_items").where("item_json is not null").select("item_id", F.from_json("item_json", schema).alias("i")).where("i is not null")
    done = parsed.select("item_id", F.explode(collect.sanitize_items(F.array("i"), length=60)).alias("i"))
    return done.select("item_id", "i.author", "i.text", "i.timestamp", "i.href")


# loop guards over event sequences: the type is the action, the amount stands for the target
def _steps(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(x) for x in ("click", "type", "navigate", "scroll", "select")]), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))
    return _events(spark, d).select("user_id", "event_id", "ts", action.alias("action_type"), (F.col("value").cast("bigint") % 3).alias("target"), (F.col("event_id") % 4 > 0).alias("ok"), F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string"), F.lit(".example/p"), (F.col("event_id") % 3).cast("string"), F.lit("#x")).alias("url"), F.col("event_type"))


def repeat_streak(spark: SparkSession, d: str) -> DataFrame:
    sig = F.when(F.col("event_type") != "purchase", F.col("event_type"))
    return collect.streaks(_steps(spark, d), "user_id", ["ts", "event_id"], sig).where("streak >= 3").select("event_id", "streak")


def no_progress(spark: SparkSession, d: str) -> DataFrame:
    """Runs of steps without gain: a gain is a purchase."""
    idle = F.when(F.col("event_type") != "purchase", F.lit("idle"))
    runs = collect.streaks(_steps(spark, d), "user_id", ["ts", "event_id"], idle)
    return runs.groupBy("user_id").agg(F.max("streak").alias("longest"))


def url_visits(spark: SparkSession, d: str) -> DataFrame:
    done = collect.visits(_steps(spark, d), "user_id", ["ts", "event_id"], "url")
    return done.where("url_visits > 4 or host_visits > 25").select("event_id", "url_visits", "host_visits")


def retry_guard(spark: SparkSession, d: str) -> DataFrame:
    return collect.retries(_steps(spark, d).withColumn("action_type", F.when(F.col("event_type") == "view", "type").otherwise("select")), "user_id", ["ts", "event_id"]).where("retry").select("event_id")


def frame_tree(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of frames in the top page, over supplier numbers as a binary tree."""
    k = F.col("s_suppkey").cast("int")
    frames = table(spark, d, "supplier").select(k.alias("frame_id"), F.when(k > 1, F.floor(k / 2).cast("int")).alias("parent_id"), (k % 11).alias("dx"), (k % 7).alias("dy"))
    return collect.stitched_frames(frames)


# summaries
def floor_percentile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.floor_percentile(_events(spark, d), ["event_type"], "value", 0.9)


def median_loop(spark: SparkSession, d: str) -> DataFrame:
    means = _events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return metrics.median(_events(spark, d), ["event_type"], "value").join(means, "event_type").select("event_type", F.round("median", 6).alias("median"), "mean")


def stage_average(spark: SparkSession, d: str) -> DataFrame:
    """Average of each user's values without the first, cold one; missing counts as zero."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    warm = _events(spark, d).withColumn("rn", F.row_number().over(w)).where("rn > 1")
    return warm.groupBy("event_type").agg(F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("mean"), F.count("*").alias("n"))


def success_rate(spark: SparkSession, d: str) -> DataFrame:
    ok = F.get_json_object("last_action_result", "$.ok")
    kind = F.get_json_object("last_action_result", "$.type")
    return table(spark, d, "step_messages").where("last_action_result is not null").groupBy(kind.alias("action")).agg(F.round(F.avg((ok == "true").cast("int")), 6).alias("rate"), F.count("*").alias("n"))


def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    """Calls, total and last value of each type."""
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("last"))


def image_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "step_messages").agg(F.round(F.avg(F.coalesce("send_screenshot", F.lit(False)).cast("int")), 6).alias("rate"), F.count("*").alias("steps"))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """Difference of order statuses' mean price in percent points of the first."""
    by = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return by.select("o_orderpriority", F.round((F.col("O") - F.col("F")) / F.col("F") * 100, 4).alias("o_vs_f"), F.round((F.col("P") - F.col("F")) / F.col("F") * 100, 4).alias("p_vs_f"))


# vectors and boxes
def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = vision.l2_normalize(F.col("embedding"))
    return _embeddings(spark, d).select("vec_id", F.round(vision.dot(v, v), 6).alias("norm"), F.round(F.element_at(v, 1), 5).alias("first"))


def zero_shot(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    got = vision.zero_shot(e, vision.prototypes(e, "label", "embedding"), "vec_id", "embedding")
    return got.select("vec_id", "class", F.round("p", 4).alias("p"), "rank")


def zero_shot_top(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    got = vision.zero_shot(e, vision.prototypes(e, "label", "embedding"), "vec_id", "embedding", top=1)
    return got.select("vec_id", "class")


def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    joined = zero_shot_top(spark, d).join(_embeddings(spark, d).select("vec_id", F.col("label").cast("string").alias("label")), "vec_id")
    return metrics.class_accuracy(joined, "label", "class")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    joined = zero_shot_top(spark, d).join(_embeddings(spark, d).select("vec_id", F.col("label").cast("string").alias("label")), "vec_id")
    return metrics.confusion(joined, "label", "class")


def head_training(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each class under a softmax head trained here, classes balanced by weight."""
    done = vision.train_head(_embeddings(spark, d), "label", "embedding", "vec_id")
    return metrics.class_accuracy(done, "label", "predicted")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return vision.page_features(table(spark, d, "nodes"), "page_id")


def screen_priors(spark: SparkSession, d: str) -> DataFrame:
    return vision.screen_priors(_features(spark, d), "page_id")


def page_features(spark: SparkSession, d: str) -> DataFrame:
    """Structural counts of each page."""
    return _features(spark, d)


def fuse_priors(spark: SparkSession, d: str) -> DataFrame:
    """Zero-shot classes of vectors fused with evidence of pages of the same number."""
    e = _embeddings(spark, d)
    got = vision.zero_shot(e, vision.prototypes(e, "label", "embedding"), "vec_id", "embedding", top=10).select("vec_id", "class", "p")
    prior = _embeddings(spark, d).select("vec_id", F.explode(F.array(F.struct(F.lit("1").alias("class"), (F.col("vec_id") % 4).cast("double").alias("w")), F.struct(F.lit("2").alias("class"), (F.col("vec_id") % 3).cast("double").alias("w")))).alias("x")).select("vec_id", "x.class", "x.w")
    return vision.fuse(got, prior, "vec_id").select("vec_id", "class", F.round("p", 4).alias("p"))


def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    v = vision.feature_vector([F.col("fields"), F.col("links"), F.col("words")])
    return _features(spark, d).select("page_id", F.round(v[0], 6).alias("fields"), F.round(v[1], 6).alias("links"), F.round(v[2], 6).alias("words"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each vector's sign bits to those of the next number."""
    bits = _embeddings(spark, d).select("vec_id", vision.sign_bits(F.col("embedding")).alias("bits"))
    nxt = bits.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("next"))
    return bits.join(nxt, "vec_id").select("vec_id", vision.hamming(F.col("bits"), F.col("next")).cast("int").alias("distance"))


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("frame_id", "pos", "node_pk")
    pairs = table(spark, d, "nodes").where("rect is not null").withColumn("next", F.lead("rect").over(w)).where("next is not null")
    sides = [F.col(f"{r}.{c}").cast("double") for r in ("rect", "next") for c in "xywh"]
    return pairs.select("node_pk", F.round(vision.iou(*sides), 6).alias("iou"))


def mosaic_cells(spark: SparkSession, d: str) -> DataFrame:
    x, y = vision.mosaic_cell((F.col("p_partkey") % 16).cast("int"))
    return table(spark, d, "part").select("p_partkey", x.cast("int").alias("x"), y.cast("int").alias("y"))


def nms_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 20).cast("double").alias("y"), (F.col("l_quantity") + 5).alias("w"), (F.col("l_linenumber") + 10).cast("double").alias("h"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return lists.select("l_orderkey", F.size("boxes").alias("boxes"), F.size(vision.nms(F.col("boxes"))).alias("kept"))


def ctc(spark: SparkSession, d: str) -> DataFrame:
    labels = F.transform(F.split(F.col("c_custkey").cast("string"), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(vision.ctc_collapse(labels), lambda x: x.cast("string")), "").alias("out"))


# evaluation
def _gold(spark: SparkSession, d: str, shift: int) -> DataFrame:
    start = (F.col("l_linenumber") * 20 + F.col("l_suppkey") % 7 + shift * (F.col("l_partkey") % 3)).cast("int")
    return table(spark, d, "lineitem").where((F.col("l_partkey") + shift) % 5 > 0).select("l_orderkey", start.alias("start"), (start + 4 + (F.col("l_suppkey") % 5)).cast("int").alias("end"))


def span_prf(spark: SparkSession, d: str) -> DataFrame:
    return metrics.span_scores(_gold(spark, d, 0), _gold(spark, d, 2), "l_orderkey")


def _boxes(spark: SparkSession, d: str, shift: int) -> DataFrame:
    t = table(spark, d, "nodes").where("rect is not null and rect.w > 0 and rect.h > 0")
    c = lambda k: F.col(f"rect.{k}")
    return t.where((F.col("node_pk") + shift) % 4 > 0).select("page_id", "node_pk", (c("x") + shift).alias("x"), (c("y") + shift).alias("y"), c("w").alias("w"), c("h").alias("h"))


def face_match(spark: SparkSession, d: str) -> DataFrame:
    g = _boxes(spark, d, 0).select("page_id", F.col("node_pk").alias("gold_id"), *[F.col(c).cast("double").alias("g" + c) for c in "xywh"])
    p = _boxes(spark, d, 3).select("page_id", F.col("node_pk").alias("pred_id"), *[F.col(c).cast("double").alias("p" + c) for c in "xywh"])
    near = (F.col("gx") < F.col("px") + F.col("pw")) & (F.col("px") < F.col("gx") + F.col("gw"))
    sides = [F.col(a + c) for a in "gp" for c in "xywh"]
    got = metrics.box_matches(g, p, "page_id", F.when(near, vision.iou(*sides)).otherwise(0.0))
    return got.select("page_id", "pred_id", "gold_id", F.round("iou", 6).alias("iou"))


def pixel_prf(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pixel_scores(_boxes(spark, d, 0), _boxes(spark, d, 3), "page_id").select("page_id", *[F.col(c).cast("bigint").alias(c) for c in ("gold_px", "pred_px", "both_px")])


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.folds(table(spark, d, "nodes"), "host")


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """The stricter variant of the rate limit: events with more than three of their user in the ten hours up to them."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-36_000, 0)
    return _events(spark, d).withColumn("n", F.count("*").over(w)).where("n > 3").select("event_id", "n")


QUERIES = {f.__name__: f for f in (
    dedupe_first, merge_cap, fact_upsert, template_upsert, newest_per_user, reading_order, roi_top, marks, field_texts, site_config_join, mock_collect, synth_concat, sanitize_items, repeat_streak, no_progress, url_visits, retry_guard, frame_tree,
    floor_percentile, median_loop, stage_average, success_rate, engine_stats, image_rate, arms, l2_normalize, zero_shot, zero_shot_top, class_accuracy, confusion, head_training, page_features, screen_priors, fuse_priors, feature_vector, hamming_pairs, iou_pairs, mosaic_cells, nms_boxes, ctc,
    span_prf, face_match, pixel_prf, group_folds, rate_limit_window,
)}

_ISL = "SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN sig IS NOT NULL AND sig IS NOT DISTINCT FROM lag(sig) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM ({}))"
_ROWS = "SELECT *, lower(coalesce(text, '')) AS t, lower(concat_ws(' ', label, placeholder)) AS f FROM nodes"
_PAGE = ", ".join(vision.feature_sql(name, "regexp_matches", "", r"len(regexp_extract_all(t, '[^\t\n\x0B\f\r ]+'))") for name in vision.FEATURES)
_IOU = "CASE WHEN aw * ah + bw * bh - i > 0 THEN i / (aw * ah + bw * bh - i) ELSE 0 END"
_PROTO = """WITH e AS (SELECT vec_id, label::VARCHAR AS class, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
 m AS (SELECT class, i, avg(x) AS m FROM e GROUP BY ALL), u AS (SELECT class, i, m / sqrt(sum(m * m) OVER (PARTITION BY class)) AS m FROM m),
 s AS (SELECT vec_id, u.class, 100 * sum(x * m) AS s FROM e JOIN u USING (i) GROUP BY ALL),
 p AS (SELECT vec_id, class, exp(s - max(s) OVER w) / sum(exp(s - mx)) OVER w AS p FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS mx FROM s) WINDOW w AS (PARTITION BY vec_id)),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS INTEGER) AS rank FROM p)"""
_JSON = "CASE WHEN json_valid(item_json) THEN item_json END"
_VALID = f"coalesce(json_type({_JSON}) = 'OBJECT', false)"
_FIELD = f"CASE WHEN {_VALID} THEN json_extract_string({_JSON}, '$.{{}}') END"
ORACLE = {
    "dedupe_first": "SELECT key, min(item_id) AS item_id, arg_min({'t': task_id}, item_id).t AS task_id FROM (SELECT item_id, task_id, coalesce(" + ", ".join(f"nullif({_FIELD.format(k)}, '')" for k in ("href", "url", "text")) + ", item_json) AS key FROM collected_items WHERE item_json IS NOT NULL) GROUP BY key",
    "sanitize_items": "SELECT item_id, " + ", ".join(f"left({_FIELD.format(k)}, 60) AS {k}" for k in ("author", "text", "timestamp", "href")) + f" FROM collected_items WHERE {_VALID}",
    "face_match": f"""WITH g AS (SELECT page_id, node_pk AS gold_id, rect.x::DOUBLE AS ax, rect.y::DOUBLE AS ay, rect.w::DOUBLE AS aw, rect.h::DOUBLE AS ah FROM nodes WHERE rect.w > 0 AND rect.h > 0 AND node_pk % 4 > 0),
        p AS (SELECT page_id, node_pk AS pred_id, rect.x + 3.0::DOUBLE AS bx, rect.y + 3.0::DOUBLE AS by_, rect.w::DOUBLE AS bw, rect.h::DOUBLE AS bh FROM nodes WHERE rect.w > 0 AND rect.h > 0 AND (node_pk + 3) % 4 > 0),
        j AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS i FROM g JOIN p USING (page_id)), k AS (SELECT page_id, pred_id, gold_id, {_IOU} AS iou FROM j)
        SELECT page_id, pred_id, arg_max(gold_id, (iou, -gold_id)) AS gold_id, round(max(iou), 6) AS iou FROM k WHERE iou >= 0.5 GROUP BY page_id, pred_id""",
    "merge_cap": """WITH o AS (SELECT href, min(node_pk) AS node_pk FROM nodes WHERE href IS NOT NULL AND node_pk % 2 = 0 GROUP BY href),
        f AS (SELECT href, min(node_pk) AS node_pk FROM nodes WHERE href IS NOT NULL AND node_pk % 2 = 1 AND href NOT IN (SELECT href FROM o) GROUP BY href)
        SELECT href, node_pk FROM (SELECT *, 0 AS part FROM o UNION ALL SELECT *, 1 FROM f) ORDER BY part, node_pk, href LIMIT 3000""",
    "fact_upsert": "SELECT fact, value, since FROM (SELECT lower(event_type || (user_id % 50)) AS fact, arg_max(value, event_id) AS value, min(event_id) AS since FROM events GROUP BY 1) ORDER BY since DESC, fact LIMIT 100",
    "template_upsert": "SELECT prompt, max(msg_id) AS last_used, count(*) AS uses FROM step_messages WHERE prompt IS NOT NULL GROUP BY prompt ORDER BY last_used DESC, prompt LIMIT 50",
    "newest_per_user": "SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 5",
    "reading_order": "SELECT node_pk, CAST(row_number() OVER (PARTITION BY page_id ORDER BY frame_id, pos, node_pk) AS INTEGER) AS place FROM nodes",
    "roi_top": "SELECT page_id, node_pk, area, CAST(rn AS INTEGER) AS rn FROM (SELECT page_id, node_pk, CAST(rect.w AS BIGINT) * rect.h AS area, row_number() OVER (PARTITION BY page_id ORDER BY CAST(rect.w AS BIGINT) * rect.h DESC, node_pk) AS rn FROM nodes WHERE rect.w >= 20 AND rect.h >= 20) WHERE rn <= 40",
    "marks": r"SELECT node_pk, TRY_CAST(regexp_extract(id, '(\d+)$', 1) AS INTEGER) AS mark FROM nodes WHERE interactive",
    "field_texts": """SELECT node_pk, concat_ws(' | ', label, CASE WHEN node_role = 'checkbox' THEN 'filled' WHEN coalesce(field_value, '') = '' THEN 'empty' ELSE 'value: "' || field_value || '"' END,
        CASE WHEN placeholder IS NOT NULL THEN 'REQUIRED' END) AS line FROM nodes WHERE label IS NOT NULL""",
    "site_config_join": "SELECT coalesce(s.site_config_id, 'generic') AS config, count(*) AS nodes FROM nodes n LEFT JOIN site_hosts s ON n.host = s.host GROUP BY 1",
    "mock_collect": """SELECT task, item, node_pk, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY node_pk) AS rn FROM (SELECT coalesce(task_id, '') AS task,
        coalesce(nullif(href, ''), nullif(text, '')) AS item, min(node_pk) AS node_pk FROM nodes WHERE node_role = 'article' OR (coalesce(href, '') <> '' AND coalesce(text, '') <> '') GROUP BY 1, 2)) WHERE rn <= 10""",
    "synth_concat": "SELECT task, string_agg(prompt, chr(10) ORDER BY iteration) AS answer FROM (SELECT lower(trim(task_id)) AS task, iteration, min(prompt) AS prompt FROM step_messages WHERE prompt IS NOT NULL GROUP BY 1, 2) GROUP BY task",
    "repeat_streak": f"SELECT event_id, streak FROM (SELECT event_id, sig, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INTEGER) AS streak FROM ({_ISL.format('SELECT *, CASE WHEN event_type <> ' + chr(39) + 'purchase' + chr(39) + ' THEN event_type END AS sig FROM events')})) WHERE streak >= 3 AND sig IS NOT NULL",
    "no_progress": f"SELECT user_id, CAST(max(CASE WHEN sig IS NULL THEN 0 ELSE streak END) AS INTEGER) AS longest FROM (SELECT user_id, sig, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM ({_ISL.format('SELECT *, CASE WHEN event_type <> ' + chr(39) + 'purchase' + chr(39) + ' THEN 1 END AS sig FROM events')})) GROUP BY user_id",
    "url_visits": """SELECT event_id, url_visits, host_visits FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS url_visits,
        count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS host_visits FROM events) WHERE url_visits > 4 OR host_visits > 25""",
    "retry_guard": """SELECT event_id FROM (SELECT event_id, k, t, lag(k) OVER w AS pk, lag(t) OVER w AS pt, lag(event_id) OVER w AS pe FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'type' ELSE 'select' END AS k, trunc(value)::BIGINT % 3 AS t FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = pk AND t IS NOT DISTINCT FROM pt AND pe % 4 = 0""",
    "frame_tree": """WITH RECURSIVE f AS (SELECT s_suppkey::INTEGER AS id, CASE WHEN s_suppkey > 1 THEN (s_suppkey // 2)::INTEGER END AS parent, (s_suppkey % 11)::INTEGER AS dx, (s_suppkey % 7)::INTEGER AS dy FROM supplier),
        t AS (SELECT id AS frame_id, dx AS x, dy AS y, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.id, t.x + f.dx, t.y + f.dy, t.depth + 1 FROM f JOIN t ON f.parent = t.frame_id) SELECT * FROM t""",
    "floor_percentile": "SELECT event_type, s[CAST(least(n - 1, floor(0.9 * n)) AS INTEGER) + 1] AS percentile FROM (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)",
    "median_loop": "SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "stage_average": "SELECT event_type, round(avg(coalesce(value, 0)), 6) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 1 GROUP BY event_type",
    "success_rate": "SELECT json_extract_string(last_action_result, '$.type') AS action, round(avg(CASE WHEN json_extract_string(last_action_result, '$.ok') = 'true' THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n FROM step_messages WHERE last_action_result IS NOT NULL GROUP BY 1",
    "engine_stats": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(arg_max(value, (ts, event_id)), 6) AS last FROM events GROUP BY event_type",
    "image_rate": "SELECT round(avg(CASE WHEN send_screenshot THEN 1 ELSE 0 END), 6) AS rate, count(*) AS steps FROM step_messages",
    "arms": "SELECT o_orderpriority, round((o - f) / f * 100, 4) AS o_vs_f, round((p - f) / f * 100, 4) AS p_vs_f FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)",
    "l2_normalize": "SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS norm, round(v[1] / n, 5) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    "zero_shot": _PROTO + " SELECT vec_id, class, round(p, 4) AS p, rank FROM r WHERE rank <= 3",
    "zero_shot_top": _PROTO + " SELECT vec_id, class FROM r WHERE rank = 1",
    "class_accuracy": _PROTO + " SELECT label::VARCHAR AS label, round(avg(CASE WHEN label::VARCHAR = class THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM r JOIN embeddings USING (vec_id) WHERE rank = 1 GROUP BY 1",
    "confusion": _PROTO + " SELECT label::VARCHAR AS label, class, count(*) AS n FROM r JOIN embeddings USING (vec_id) WHERE rank = 1 AND label::VARCHAR <> class GROUP BY 1, 2",
    "fuse_priors": _PROTO + """, l AS (SELECT r.vec_id, class, ln(greatest(p, 1e-6)) + CASE class WHEN '1' THEN vec_id % 4 WHEN '2' THEN vec_id % 3 ELSE 0 END AS l FROM r WHERE rank <= 10),
        z AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS z FROM l) SELECT vec_id, class, round(z / sum(z) OVER (PARTITION BY vec_id), 4) AS p FROM z""",
    "page_features": f"SELECT page_id, {_PAGE} FROM ({_ROWS}) GROUP BY page_id",
    "screen_priors": f"WITH f AS (SELECT page_id, {_PAGE} FROM ({_ROWS}) GROUP BY page_id) SELECT page_id, class, sum(w) AS w FROM (" + " UNION ALL ".join(f"SELECT page_id, '{c}' AS class, {w}::DOUBLE AS w FROM f WHERE {condition}" for c, w, condition in vision.PRIORS) + ") GROUP BY ALL",
    "nms_boxes": f"""WITH l AS (SELECT l_orderkey, list([{{p: l_extendedprice, ax: (l_partkey % 50)::DOUBLE, ay: (l_suppkey % 20)::DOUBLE, aw: (l_quantity + 5)::DOUBLE, ah: (l_linenumber + 10)::DOUBLE}}] ORDER BY l_extendedprice DESC, l_partkey % 50 DESC, l_suppkey % 20 DESC, l_quantity DESC, l_linenumber DESC) AS bs FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CAST(len(bs) AS INTEGER) AS boxes, CAST(len(list_reduce(bs, lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(k.ax + k.aw, y[1].ax + y[1].aw) - greatest(k.ax, y[1].ax)) * greatest(0, least(k.ay + k.ah, y[1].ay + y[1].ah) - greatest(k.ay, y[1].ay)) > 0.3 * (k.aw * k.ah + y[1].aw * y[1].ah - greatest(0, least(k.ax + k.aw, y[1].ax + y[1].aw) - greatest(k.ax, y[1].ax)) * greatest(0, least(k.ay + k.ah, y[1].ay + y[1].ah) - greatest(k.ay, y[1].ay))))) > 0 THEN acc ELSE list_concat(acc, y) END)) AS INTEGER) AS kept FROM l""",
    "ctc": "SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: x <> '0' AND (i = 1 OR l[i - 1] <> x)), '') AS out FROM (SELECT c_custkey, string_split(c_custkey::VARCHAR, '') AS l FROM customer)",
    "pixel_prf": """WITH g AS (SELECT page_id, unnest(range(rect.y, rect.y + rect.h)) AS r, rect.x AS a, rect.x + rect.w AS b FROM nodes WHERE rect.w > 0 AND rect.h > 0 AND node_pk % 4 > 0), p AS (SELECT page_id, unnest(range(rect.y + 3, rect.y + 3 + rect.h)) AS r, rect.x + 3 AS a, rect.x + 3 + rect.w AS b FROM nodes WHERE rect.w > 0 AND rect.h > 0 AND (node_pk + 3) % 4 > 0),
        e AS (SELECT page_id, r, a AS x, 1 AS dg, 0 AS dp FROM g UNION ALL SELECT page_id, r, b, -1, 0 FROM g UNION ALL SELECT page_id, r, a, 0, 1 FROM p UNION ALL SELECT page_id, r, b, 0, -1 FROM p),
        s AS (SELECT page_id, r, x, sum(dg) AS dg, sum(dp) AS dp FROM e GROUP BY ALL), w AS (SELECT page_id, lead(x) OVER o - x AS n, sum(dg) OVER o > 0 AS in_g, sum(dp) OVER o > 0 AS in_p FROM s WINDOW o AS (PARTITION BY page_id, r ORDER BY x))
        SELECT page_id, coalesce(CAST(sum(n) FILTER (in_g) AS BIGINT), 0) AS gold_px, coalesce(CAST(sum(n) FILTER (in_p) AS BIGINT), 0) AS pred_px, coalesce(CAST(sum(n) FILTER (in_g AND in_p) AS BIGINT), 0) AS both_px FROM w GROUP BY page_id""",
    "feature_vector": r"""SELECT page_id, round(ln(1 + f) / 4, 6) AS fields, round(ln(1 + l) / 4, 6) AS links, round(ln(1 + w) / 4, 6) AS words FROM (SELECT page_id, count(*) FILTER (node_role IN ('textbox', 'combobox', 'checkbox', 'searchbox', 'password', 'file')) AS f,
        count(*) FILTER (node_role = 'link') AS l, sum(len(regexp_extract_all(coalesce(text, ''), '[^\t\n\x0B\f\r ]+'))) AS w FROM nodes GROUP BY page_id)""",
    "hamming_pairs": "SELECT vec_id, CAST(list_sum(list_transform(range(len(a)), lambda i: CASE WHEN (a[i + 1] > 0) <> (b[i + 1] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM (SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)",
    "iou_pairs": f"""SELECT node_pk, round({_IOU}, 6) AS iou FROM (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS i FROM (SELECT node_pk, r.x::DOUBLE AS ax, r.y::DOUBLE AS ay, r.w::DOUBLE AS aw, r.h::DOUBLE AS ah,
        n.x::DOUBLE AS bx, n.y::DOUBLE AS by_, n.w::DOUBLE AS bw, n.h::DOUBLE AS bh FROM (SELECT node_pk, rect AS r, lead(rect) OVER (PARTITION BY page_id ORDER BY frame_id, pos, node_pk) AS n FROM nodes WHERE rect IS NOT NULL) WHERE n IS NOT NULL))""",
    "mosaic_cells": "SELECT p_partkey, CAST((p_partkey % 16 % 4) * 160 AS INTEGER) AS x, CAST((p_partkey % 16 // 4) * 160 AS INTEGER) AS y FROM part",
    "span_prf": """WITH g AS (SELECT DISTINCT l_orderkey AS d, (l_linenumber * 20 + l_suppkey % 7)::INTEGER AS s, (l_linenumber * 20 + l_suppkey % 7 + 4 + l_suppkey % 5)::INTEGER AS e FROM lineitem WHERE l_partkey % 5 > 0),
        p AS (SELECT DISTINCT l_orderkey AS d, (l_linenumber * 20 + l_suppkey % 7 + 2 * (l_partkey % 3))::INTEGER AS s, (l_linenumber * 20 + l_suppkey % 7 + 2 * (l_partkey % 3) + 4 + l_suppkey % 5)::INTEGER AS e FROM lineitem WHERE (l_partkey + 2) % 5 > 0),
        c AS (SELECT g.d, g.s, g.e, count(DISTINCT x) AS n FROM g JOIN p ON g.d = p.d AND g.s < p.e AND p.s < g.e, unnest(range(greatest(g.s, p.s), least(g.e, p.e))) AS t(x) GROUP BY ALL),
        v AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM c WHERE n >= 0.5 * (e - s)) AS tp, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.d = p.d AND g.s < p.e AND p.s < g.e)) AS "right")
        SELECT gold, tp, predicted, "right", round(tp / gold, 3) AS recall, round("right" / predicted, 3) AS precision, round(2 * round(tp / gold, 3) * round("right" / predicted, 3) / (round(tp / gold, 3) + round("right" / predicted, 3)), 3) AS f1 FROM v""",
    "group_folds": "SELECT host, CAST(CAST('0x' || left(md5(host), 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT host FROM nodes)",
    "rate_limit_window": "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3",
}
