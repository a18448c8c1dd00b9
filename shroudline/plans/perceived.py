"""Queries of clipping, hints, regions, words read from images, detector outputs and made-up behaviour."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.operators import behavior, perception, vision
from shroudline.plans.sequences import _PROTO
from shroudline.session import slots
from shroudline.sources.tables import table


def viewport_clips(spark: SparkSession, d: str) -> DataFrame:
    """The parts of all boxes inside a viewport of 1280 by 720."""
    r = [F.col(f"rect.{c}") for c in "xywh"]
    box = perception.viewport_clip(*r, F.lit(1280), F.lit(720))
    return table(spark, d, "nodes").where("rect is not null").select("node_pk", box.alias("b")).where("b is not null").select("node_pk", "b.x", "b.y", "b.w", "b.h")


_HINT_WORDS = "CASE node_pk % 9 WHEN 0 THEN 'Signature of the buyer' WHEN 1 THEN 'pan-card.png' WHEN 2 THEN 'Credit card front' WHEN 3 THEN 'user_photo' WHEN 4 THEN 'qrcode' WHEN 5 THEN 'designed' WHEN 6 THEN 'id proof, signed' ELSE '' END"


def image_hints(spark: SparkSession, d: str) -> DataFrame:
    """What images' own words say they show."""
    return table(spark, d, "nodes").select("node_pk", perception.image_hint(F.col("label"), F.expr(_HINT_WORDS), F.regexp_extract("src", r"([^/]*)$", 1)).alias("hint"))


def region_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Regions judged by the classes of their vectors and by page hints on every seventh."""
    e = table(spark, d, "embeddings")
    classes = vision.zero_shot(e, vision.prototypes(e, "label", "embedding"), "vec_id", "embedding", top=10).select("vec_id", "class", "p").withColumn("hint", F.when(F.col("vec_id") % 7 == 0, "id_card"))
    return perception.region_sensitivity(classes, "vec_id", ["1", "2", "3"], "hint")


def face_regions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as regions, their order lines as faces."""
    regions = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") + 20).alias("w"), (F.col("p_size") % 7 + 30).alias("h"))
    faces = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_quantity").cast("int") % 9).alias("w"), F.col("l_linenumber").alias("h"))
    return perception.face_regions(regions, faces, "key")


def _ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as images: a block for each line status, a paragraph for each return flag, a line and a word for each order line."""
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("x"), F.col("l_partkey"), F.lit("@mail.example"))).when(F.col("l_linenumber") % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("item"), F.col("l_suppkey")))
    word = F.struct(said.alias("text"), (F.col("l_quantity") + 30).cast("double").alias("confidence"), F.col("l_linenumber").alias("x"), (F.col("l_partkey") % 90).cast("int").alias("y"), F.lit(10).alias("w"), F.lit(5).alias("h"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", word.alias("word")))).alias("ws"))
    paragraphs = lines.select("l_orderkey", "l_linestatus", F.struct("l_returnflag", F.transform("ws", lambda s: F.struct(F.array(s["word"]).alias("words"))).alias("lines")).alias("p"))
    blocks = paragraphs.groupBy("l_orderkey", "l_linestatus").agg(F.array_sort(F.collect_list("p")).alias("paragraphs"))
    return blocks.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linestatus", "paragraphs"))).alias("blocks"))


def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of a four-level tree in reading order with their places in the joined text."""
    return perception.ocr_words(_ocr_pages(spark, d), "l_orderkey", "blocks").select("l_orderkey", "ord", "word", "x", "y", "start", "stop")


def ocr_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the personal data read from images."""
    return perception.ocr_boxes(_ocr_pages(spark, d), "l_orderkey", "blocks").select("l_orderkey", "type", "word", "x", "y")


def box_union(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of several producers by kind: their number and area."""
    nodes = table(spark, d, "nodes").where("rect is not null").select(F.col("node_pk").alias("key"), "node_role", *[F.col(f"rect.{c}").alias(c) for c in "xywh"])
    union = perception.box_union(text=nodes.where("node_role = 'paragraph'"), field=nodes.where("node_role = 'textbox'"), image=nodes.where("node_role = 'img'"), link=nodes.where("node_role = 'link'"))
    return union.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"))


_WEIGHTS = [[((k * 7 + i * 3) % 5 - 2) / 4 for i in range(8)] for k in range(4)]
_BIAS, _CLASSES = [0.1, -0.2, 0.0, 0.3], ["form", "feed", "mail", "shop"]


def head_classes(spark: SparkSession, d: str) -> DataFrame:
    """The three best classes of a linear head over the first parts of each vector."""
    probs = perception.classify_head(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 8), _WEIGHTS, _BIAS, _CLASSES)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice(probs, 1, 3)).alias("pos", "c")).select("vec_id", (F.col("pos") + 1).alias("rank"), "c.class", F.round("c.p", 6).alias("p"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Detector cells made of order lines."""
    k = F.col("l_partkey")
    stride = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), stride.alias("stride"), ((k * 31 + F.col("l_suppkey")) % ((640 / stride) * (640 / stride)).cast("int")).cast("int").alias("cell"), ((k % 130) / 100).alias("cls"), (F.col("l_quantity") / 45).alias("obj"), ((k % 10) / 10).alias("dx"), ((k % 7) / 7).alias("dy"), ((k % 5) / 5).alias("dw"), ((k % 3) / 3).alias("dh"), F.lit(0.5).alias("scale"))


def detector_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a face detector's cells before suppression."""
    return perception.decode_detector(_cells(spark, d)).select("image", *[F.round(c, 4).alias(c) for c in ("score", "x", "y", "w", "h")])


def detector_kept(spark: SparkSession, d: str) -> DataFrame:
    """The best box of each image after suppression, which is its best box before."""
    found = perception.decode_detector(_cells(spark, d))
    kept = found.groupBy("image").agg(vision.nms(F.collect_list(F.struct("score", "x", "y", "w", "h"))).alias("boxes"))
    return kept.select("image", F.round(F.element_at("boxes", 1)["score"], 6).alias("best"))


def mosaic_back(spark: SparkSession, d: str) -> DataFrame:
    """A place in a mosaic and back on its page: the place itself."""
    cell = (F.col("p_partkey") % 16).cast("int")
    left, top, scale = F.col("p_size") * 3.0, F.col("p_size") * 2.0, F.lit(0.5)
    cx, cy = vision.mosaic_cell(cell)
    px, py = F.col("p_partkey") % 100 + left, F.col("p_partkey") % 60 + top
    x, y = perception.mosaic_back(cell, cx + (px - left) * scale, cy + (py - top) * scale, scale, left, top)
    return table(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"))


def merged_faces(spark: SparkSession, d: str) -> DataFrame:
    """Two finds of every face of an image become one."""
    faces = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).cast("bigint").alias("image"), (F.floor(F.col("s_suppkey") / 10) * 100).cast("double").alias("x"), F.lit(5.0).alias("y"), F.lit(40.0).alias("w"), F.lit(40.0).alias("h"))
    again = faces.select("image", (F.col("x") + 4).alias("x"), (F.col("y") + 3).alias("y"), "w", "h")
    return perception.merged_faces(faces.unionByName(again), "image")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Difference hashes of ramps made as pictures: bright to dark sets every bit, dark to bright none; what is no picture has none."""
    ramp = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.lpad(F.hex(F.when(F.col("c_custkey") % 3 == 0, 255 - i * 28).otherwise(i * 28)), 2, "0")), "")
    image = F.when(F.col("c_custkey") % 3 == 2, F.lit(b"none")).otherwise(F.concat(F.lit(b"P5\n9 8\n255\n"), F.unhex(F.repeat(ramp, 8))))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(perception.fingerprints(image), F.lit(-2).cast("bigint")).alias("hash"))


def _white(spark: SparkSession, d: str) -> DataFrame:
    """White pictures of 30 by 20 pixels, with a box each; made in as many tasks as a shuffle has, however few files the keys lie in."""
    image = F.concat(F.lit(b"P5\n30 20\n255\n"), F.unhex(F.repeat(F.lit("FF"), 600)))
    box = F.expr("struct(cast(c_custkey % 40 as int) as x, cast(c_custkey % 15 as int) as y, cast(c_custkey % 9 as int) as w, cast(c_custkey % 6 as int) as h)")
    return table(spark, d, "customer").select("c_custkey").repartition(slots(spark)).select("c_custkey", image.alias("image"), box.alias("box"))


def painted_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Black pixels after a padded box was painted over each picture."""
    done = _white(spark, d).select("c_custkey", perception.painted(F.col("image"), F.array("box")).alias("i"))
    pixels = F.decode(F.substr("i", F.lit(14)), "ISO-8859-1")  # behind the head, a character for each byte
    return done.select("c_custkey", (F.length(pixels) - F.length(F.replace(pixels, F.lit("\0"), F.lit("")))).alias("black"))


def crops(spark: SparkSession, d: str) -> DataFrame:
    """A box of each picture at twelve by ten pixels: the picture's head and length."""
    done = _white(spark, d).select("c_custkey", perception.resized(F.col("image"), 12, 10, F.col("box")).alias("i"))
    return done.select("c_custkey", F.hex(F.substr("i", F.lit(1), F.lit(9))).alias("head"), F.octet_length("i").alias("bytes"))


# behaviour
def delays(spark: SparkSession, d: str) -> DataFrame:
    """Clamped normal and log-normal delays of each order line."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    z, one = behavior.normal(key, "delay"), F.lit
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(behavior.clamped_normal(z, one(100.0), one(30.0), one(60.0), one(150.0)), 5).alias("normal"), F.round(behavior.clamped_log_normal(z, one(100.0), one(30.0), one(40.0), one(500.0)), 5).alias("log_normal"))


def target_points(spark: SparkSession, d: str) -> DataFrame:
    """A place inside each box, off its edges."""
    r = [F.col(f"rect.{c}").cast("double") for c in "xywh"]
    p = behavior.target_point(*r, behavior.normal(F.col("node_pk"), "x"), behavior.normal(F.col("node_pk"), "y"))
    return table(spark, d, "nodes").where("rect is not null").select("node_pk", p.alias("p")).select("node_pk", "p.x", "p.y")


def pointer_paths(spark: SparkSession, d: str) -> DataFrame:
    """Points of the pointer's way from each supplier's place to another's."""
    c = lambda e: F.expr(f"cast({e} as double)")
    moves = table(spark, d, "supplier").select("s_suppkey", c("s_suppkey * 37 % 900").alias("x0"), c("s_suppkey * 53 % 600").alias("y0"), c("s_suppkey * 71 % 900").alias("x1"), c("s_suppkey * 29 % 600").alias("y1"))
    return behavior.paths(moves, "s_suppkey")


QUERIES = {f.__name__: f for f in (viewport_clips, image_hints, region_sensitivity, face_regions, ocr_words, ocr_boxes, box_union, head_classes, detector_boxes, detector_kept, mosaic_back, merged_faces, fingerprints, painted_boxes, crops, delays, target_points, pointer_paths)}

_U = "((CAST('0x' || left(md5({k} || '|{s}'), 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _uniform(key: str, salt: str) -> str:
    return _U.replace("{k}", key).replace("{s}", salt)


def _normal(key: str, salt: str) -> str:
    return f"sqrt(-2.0 * ln({_uniform(key, salt + 'u')})) * cos({2 * math.pi!r} * {_uniform(key, salt + 'v')})"


_HINT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(h, '(?i){p}') THEN '{c}'" for c, p in perception.HINTS.items()) + " END"
_OCR_SQL = """WITH r AS (SELECT l_orderkey, l_linestatus, l_returnflag, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'x' || l_partkey || '@mail.example' WHEN 1 THEN '' ELSE 'item' || l_suppkey END AS word, l_quantity + 30 AS c, l_linenumber AS x, CAST(l_partkey % 90 AS INTEGER) AS y FROM lineitem),
    o AS (SELECT *, row_number() OVER w AS ord, coalesce(sum(length(word) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_returnflag, l_linenumber, word, c, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r WHERE word <> '' AND c >= 40 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linestatus, l_returnflag, l_linenumber, word, c, y))"""
_S = "[8, 16, 32][l_linenumber % 3 + 1]"
_DET = f"""WITH c AS (SELECT l_orderkey AS image, {_S} AS s, (l_partkey * 31 + l_suppkey) % CAST((640 / {_S}) * (640 / {_S}) AS INTEGER) AS cell, sqrt(least(1, (l_partkey % 130) / 100) * least(1, l_quantity / 45)) AS score, (l_partkey % 10) / 10 AS dx, (l_partkey % 7) / 7 AS dy, exp((l_partkey % 5) / 5) AS ew, exp((l_partkey % 3) / 3) AS eh FROM lineitem),
    b AS (SELECT image, score, ((cell % (640 / s) + dx) * s - ew * s / 2) / 0.5 AS x, ((floor(cell / (640 / s)) + dy) * s - eh * s / 2) / 0.5 AS y, ew * s / 0.5 AS w, eh * s / 0.5 AS h FROM c WHERE score >= 0.6)"""
_K = "CAST(s_suppkey AS VARCHAR)"
_T = "(step / steps)"
_J = f"(10 * {_T} ** 3 - 15 * {_T} ** 4 + 6 * {_T} ** 5)"


def _bezier(a: str, b: str, c: str, d: str) -> str:
    return f"((1 - e) ** 3 * {a} + 3 * (1 - e) ** 2 * e * {b} + 3 * (1 - e) * e ** 2 * {c} + e ** 3 * {d})"


ORACLE = {
    "viewport_clips": "SELECT node_pk, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 1280) - greatest(x, 0) AS w, least(y + h, 720) - greatest(y, 0) AS h FROM (SELECT node_pk, rect.x AS x, rect.y AS y, rect.w AS w, rect.h AS h FROM nodes WHERE rect IS NOT NULL) WHERE w > 0 AND h > 0 AND least(x + w, 1280) > greatest(x, 0) AND least(y + h, 720) > greatest(y, 0)",
    "image_hints": f"SELECT node_pk, {_HINT_SQL} AS hint FROM (SELECT node_pk, concat_ws(' ', label, {_HINT_WORDS}, regexp_extract(src, '([^/]*)$', 1)) AS h FROM nodes)",
    "region_sensitivity": _PROTO + """, g AS (SELECT vec_id, arg_max(class, (p, class)) AS top, max(p) AS c, coalesce(sum(p) FILTER (class IN ('1', '2', '3')), 0) AS joint FROM r WHERE rank <= 10 GROUP BY vec_id), j AS (SELECT *, top IN ('1', '2', '3') AND c >= 0.35 OR joint >= 0.5 AS seen, vec_id % 7 = 0 AS hinted FROM g)
        SELECT vec_id, CASE WHEN seen OR NOT hinted THEN top ELSE 'id_card' END AS label, seen OR hinted AS sensitive, CASE WHEN seen AND hinted THEN 'vision+dom' WHEN hinted THEN 'dom' ELSE 'vision' END AS source FROM j""",
    "face_regions": "SELECT p_partkey AS key FROM part JOIN (SELECT l_partkey, sum(CAST(floor(l_quantity) AS INTEGER) % 9 * l_linenumber) AS area FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE area >= 0.2 * (p_size + 20) * (p_size % 7 + 30)",
    "ocr_words": _OCR_SQL + " SELECT l_orderkey, CAST(ord AS INTEGER) AS ord, word, x, y, CAST(start AS BIGINT) AS start, CAST(start + length(word) AS BIGINT) AS stop FROM o",
    "ocr_boxes": _OCR_SQL + " SELECT l_orderkey, 'EMAIL' AS type, word, x, y FROM o WHERE contains(word, '@')",
    "box_union": "SELECT kind, count(*) AS n, CAST(sum(w * h) AS DOUBLE) AS area FROM (SELECT CASE node_role WHEN 'paragraph' THEN 'text' WHEN 'textbox' THEN 'field' WHEN 'img' THEN 'image' WHEN 'link' THEN 'link' END AS kind, rect.w::DOUBLE AS w, rect.h::DOUBLE AS h FROM nodes WHERE rect IS NOT NULL AND rect.x IS NOT NULL AND rect.y IS NOT NULL AND rect.w IS NOT NULL AND rect.h IS NOT NULL) WHERE kind IS NOT NULL GROUP BY kind",
    "head_classes": f"""WITH w AS (SELECT unnest(['form', 'feed', 'mail', 'shop']) AS class, unnest({_WEIGHTS}) AS ws, unnest({_BIAS}) AS b), z AS (SELECT vec_id, class, b + list_sum(list_transform(range(8), lambda i: ws[i + 1] * embedding[i + 1]::DOUBLE * 8)) AS z FROM embeddings, w),
        p AS (SELECT vec_id, class, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class DESC) AS INTEGER) AS rank FROM p) SELECT vec_id, rank, class, round(p, 6) AS p FROM r WHERE rank <= 3""",
    "detector_boxes": _DET + " SELECT image, round(score, 4) AS score, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM b",
    "detector_kept": _DET + " SELECT image, round(max(score), 6) AS best FROM b GROUP BY image",
    "mosaic_back": "SELECT p_partkey, CAST(p_partkey % 100 + p_size * 3 AS DOUBLE) AS x, CAST(p_partkey % 60 + p_size * 2 AS DOUBLE) AS y FROM part",
    "merged_faces": "SELECT s_suppkey % 10 AS image, CAST(s_suppkey // 10 * 100 AS DOUBLE) AS x, 5.0::DOUBLE AS y, 44.0::DOUBLE AS w, 43.0::DOUBLE AS h FROM supplier",
    "fingerprints": "SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE -2 END AS BIGINT) AS hash FROM customer",
    "painted_boxes": """SELECT c_custkey, CAST(greatest(0, least(30, x + w + 2) - least(30, greatest(0, x - 2))) * greatest(0, least(20, y + h + 2) - greatest(0, y - 2)) AS INTEGER) AS black FROM (SELECT c_custkey, c_custkey % 40 AS x, c_custkey % 15 AS y, c_custkey % 9 AS w, c_custkey % 6 AS h FROM customer)""",
    "crops": "SELECT c_custkey, hex('P5' || chr(10) || '12 10' || chr(10)) AS head, 133 AS bytes FROM customer",
    "delays": f"""SELECT l_orderkey, l_linenumber, round(greatest(60, least(150, 100 + z * 30)), 5) AS normal, round(greatest(40, least(500, exp(ln(10000 / sqrt(900 + 10000)) + sqrt(ln(900 / 10000 + 1)) * z))), 5) AS log_normal
        FROM (SELECT l_orderkey, l_linenumber, {_normal("(l_orderkey || '-' || l_linenumber)", 'delay')} AS z FROM lineitem)""",
    "target_points": f"""SELECT node_pk, CAST(round(greatest(x + px, least(x + w - px, x + w / 2 + zx * greatest(1, (w - 2 * px) / 6)))) AS INTEGER) AS x, CAST(round(greatest(y + py, least(y + h - py, y + h / 2 + zy * greatest(1, (h - 2 * py) / 6)))) AS INTEGER) AS y
        FROM (SELECT *, least(8, w * 0.18::DOUBLE) AS px, least(6, h * 0.18::DOUBLE) AS py FROM (SELECT node_pk, rect.x::DOUBLE AS x, rect.y::DOUBLE AS y, greatest(2, rect.w)::DOUBLE AS w, greatest(2, rect.h)::DOUBLE AS h, {_normal('node_pk::VARCHAR', 'x')} AS zx, {_normal('node_pk::VARCHAR', 'y')} AS zy FROM nodes WHERE rect IS NOT NULL))""",
    "pointer_paths": f"""WITH m AS (SELECT s_suppkey, (s_suppkey * 37 % 900)::DOUBLE AS x0, (s_suppkey * 53 % 600)::DOUBLE AS y0, (s_suppkey * 71 % 900)::DOUBLE AS x1, (s_suppkey * 29 % 600)::DOUBLE AS y1 FROM supplier), f AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS far FROM m),
        b AS (SELECT *, CASE WHEN far < 4 THEN 1 ELSE greatest(8, least(65, CAST(round(round(greatest(140, least(700, 150 + 130 * log2(far / 30 + 1)))) / 16) AS INTEGER))) END AS steps, CASE WHEN {_uniform(_K, 'side')} < 0.5 THEN 1 ELSE -1 END * (0.12::DOUBLE + {_uniform(_K, 'bend')} * 0.18::DOUBLE) * far AS bend,
            0.25::DOUBLE + {_uniform(_K, 'd1')} * 0.15::DOUBLE AS d1, ({_uniform(_K, 'j1')} - 0.5) * 6 AS j1, 0.70::DOUBLE + {_uniform(_K, 'd2')} * 0.15::DOUBLE AS d2, ({_uniform(_K, 'j2')} - 0.5) * 4 AS j2 FROM f),
        s AS (SELECT *, unnest(range(1, steps + 1)) AS step FROM b), p AS (SELECT *, {_J} AS e, x0 + dx * d1 - dy / far * bend * 0.85::DOUBLE + j1 AS ax, y0 + dy * d1 + dx / far * bend * 0.85::DOUBLE + j1 AS ay, x0 + dx * d2 - dy / far * bend * 0.35::DOUBLE + j2 AS bx, y0 + dy * d2 + dx / far * bend * 0.35::DOUBLE + j2 AS b_y FROM s)
        SELECT s_suppkey, CAST(step AS INTEGER) AS step, CAST(CASE WHEN step = steps THEN x1 ELSE round({_bezier('x0', 'ax', 'bx', 'x1')} + CASE WHEN {_T} < 0.95 THEN ({_uniform("(s_suppkey || '/' || step)", 'x')} - 0.5) * 0.8 ELSE 0 END) END AS INTEGER) AS x,
            CAST(CASE WHEN step = steps THEN y1 ELSE round({_bezier('y0', 'ay', 'b_y', 'y1')} + CASE WHEN {_T} < 0.95 THEN ({_uniform("(s_suppkey || '/' || step)", 'y')} - 0.5) * 0.8 ELSE 0 END) END AS INTEGER) AS y FROM p""",
}
