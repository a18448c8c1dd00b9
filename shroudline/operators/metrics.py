"""Evaluation and summary metrics as DataFrame operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.session import cut

#: Lines of a page that are cut and merged together.
BAND = 256


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: Column) -> DataFrame:
    """(keys, n, rank, value): the values at some places (``ranks``: array of zero-based places, from the group's size n) of each group in order.

    Equal values are counted first.  The counted values are spread by ranges of (keys, value), so a group of any size lies
    in as many partitions as it needs; the partition that holds a place is found from the partitions' totals, and only
    there values are put in order.
    """
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")))
    placed = cut(counted.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "part").agg(F.sum("c").alias("in_part"))
    w = Window.partitionBy(*keys).orderBy("part")
    before = totals.withColumn("before", F.sum("in_part").over(w) - F.col("in_part")).withColumn("n", F.sum("in_part").over(Window.partitionBy(*keys)))
    wanted = before.select(*keys, "part", "before", "in_part", "n", F.explode(F.array_distinct(ranks)).alias("rank")).where("rank >= before and rank < before + in_part")
    named = wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("part").alias("w_part"), "before", "n", "rank")
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]
    met = placed.join(named, [*same, F.col("part") == F.col("w_part")])
    inside = Window.partitionBy(*keys, "part", "rank").orderBy("v")
    upto = F.col("before") + F.sum("c").over(inside)
    here = met.withColumn("upto", upto).where("rank < upto and rank >= upto - c")
    return here.select(*keys, "n", "rank", F.col("v").alias("value"))


def floor_percentile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, percentile): the value at place floor(q n) of a group in order, the last at most."""
    place = F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    return ranked_values(df, keys, value, F.array(place)).select(*keys, F.col("value").alias("percentile"))


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the middle value of a group, or the mean of the two."""
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    return ranked_values(df, keys, value, middle).groupBy(*keys).agg(F.avg("value").alias("median"))


def span_scores(gold: DataFrame, predicted: DataFrame, doc: str, cover: float = 0.5) -> DataFrame:
    """One row: true positives, misses, false alarms and the scores, three places each.

    A gold span is found if predictions cover at least ``cover`` of its characters, counted once; a prediction is right
    if it touches any gold span.  Overlaps are an equi-join on the document plus a range condition.
    """
    g = gold.select(F.col(doc).alias("g_doc"), F.col("start").alias("g_start"), F.col("end").alias("g_end")).distinct()
    p = predicted.select(F.col(doc).alias("p_doc"), F.col("start").alias("p_start"), F.col("end").alias("p_end")).distinct()
    touch = (F.col("g_doc") == F.col("p_doc")) & (F.col("g_start") < F.col("p_end")) & (F.col("p_start") < F.col("g_end"))
    pieces = g.join(p, touch).select("g_doc", "g_start", "g_end", F.greatest("g_start", "p_start").alias("a"), F.least("g_end", "p_end").alias("b"))
    w = Window.partitionBy("g_doc", "g_start", "g_end").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = pieces.withColumn("seen", F.coalesce(F.max("b").over(w), F.col("a"))).withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest("a", "seen")))
    covered = fresh.groupBy("g_doc", "g_start", "g_end").agg(F.sum("new").alias("n")).where(F.col("n") >= cover * (F.col("g_end") - F.col("g_start")))
    right = p.join(g, touch, "left_semi")
    kinds = {"gold": g, "tp": covered, "predicted": p, "right": right}
    rows = [df.select(F.lit(kind).alias("kind")) for kind, df in kinds.items()]
    counted = rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
    one = counted.agg(*[F.count(F.when(F.col("kind") == kind, 1)).alias(kind) for kind in kinds])
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 3)).otherwise(F.lit(0.0))
    scored = one.select("gold", "tp", "predicted", "right", ratio(F.col("tp"), F.col("gold")).alias("recall"), ratio(F.col("right"), F.col("predicted")).alias("precision"))
    total = F.col("recall") + F.col("precision")
    return scored.withColumn("f1", F.when(total > 0, F.round(2 * F.col("recall") * F.col("precision") / total, 3)).otherwise(0.0))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Off-diagonal counts, most first."""
    return df.where(F.col(label) != F.col(predicted)).groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label).agg(F.round(F.avg((F.col(label) == F.col(predicted)).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def box_matches(gold: DataFrame, predicted: DataFrame, image: str, overlap: Column, least: float = 0.5) -> DataFrame:
    """(image, prediction, gold box, iou): each prediction's best gold box, where the overlap suffices."""
    joined = gold.join(predicted, image).withColumn("iou", overlap).where(F.col("iou") >= least)
    best = joined.groupBy(image, "pred_id").agg(F.max_by("gold_id", F.struct("iou", -F.col("gold_id"))).alias("gold_id"), F.max("iou").alias("iou"))
    return best


def pixel_scores(gold: DataFrame, predicted: DataFrame, page: str) -> DataFrame:
    """(page, gold px, predicted px, both px) over rasters of unions: rows are exploded, x-intervals merged per row."""

    def rows(boxes: DataFrame) -> DataFrame:
        lines = boxes.where("w > 0 and h > 0").select(page, F.explode(F.sequence("y", F.col("y") + F.col("h") - 1)).alias("row"), F.col("x").alias("a"), (F.col("x") + F.col("w")).alias("b"))
        w = Window.partitionBy(page, "row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        fresh = lines.withColumn("seen", F.max("b").over(w)).withColumn("a2", F.greatest("a", F.coalesce("seen", "a")))
        return fresh.where("b > a2").select(page, "row", F.col("a2").alias("a"), "b")

    g, p = rows(gold), rows(predicted)
    g_px = g.groupBy(page).agg(F.sum(F.col("b") - F.col("a")).alias("gold_px"))
    p_px = p.groupBy(page).agg(F.sum(F.col("b") - F.col("a")).alias("pred_px"))
    q = p.select(F.col(page).alias("q_page"), F.col("row").alias("q_row"), F.col("a").alias("q_a"), F.col("b").alias("q_b"))
    both = g.join(q, (F.col(page) == F.col("q_page")) & (F.col("row") == F.col("q_row")) & (F.col("a") < F.col("q_b")) & (F.col("q_a") < F.col("b")))
    b_px = both.groupBy(page).agg(F.sum(F.least("b", "q_b") - F.greatest("a", "q_a")).alias("both_px"))
    filled = g_px.join(p_px, page, "full").join(b_px, page, "left")
    return filled.fillna(0, ["gold_px", "pred_px", "both_px"])


def folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold of each group for leave-groups-out: by a digest of its name, so no global order is needed and new groups move none."""
    digest = F.conv(F.left(F.md5(F.col(group)), F.lit(8)), 16, 10).cast("bigint")
    return df.select(group).distinct().withColumn("fold", (digest % k).cast("int"))


def corpus_scores(judged: DataFrame, by: str, gold: str = "gold", found: str = "found") -> DataFrame:
    """(by, gold, hit, predicted, right, recall, precision, f1, negatives, false_alarms) of sentences with gold and found spans.

    A gold span is hit when found spans cover half of its characters or more; a found span is right when it touches gold;
    a sentence without gold is a hard negative, and alarmed when anything is found in it.
    """
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    covered = lambda g: F.aggregate(F.filter(found, lambda p: touches(g, p)), F.lit(0), lambda n, p: n + F.least(p["end"], g["end"]) - F.greatest(p["start"], g["start"]))
    row = judged.select(
        by, F.size(gold).alias("g"), F.size(F.filter(gold, lambda g: covered(g) * 2 >= g["end"] - g["start"])).alias("h"), F.size(found).alias("p"), F.size(F.filter(found, lambda p: F.exists(gold, lambda g: touches(g, p)))).alias("r")
    )
    sums = row.groupBy(by).agg(F.sum("g").alias("gold"), F.sum("h").alias("hit"), F.sum("p").alias("predicted"), F.sum("r").alias("right"), F.count(F.when(F.col("g") == 0, 1)).alias("negatives"), F.count(F.when((F.col("g") == 0) & (F.col("p") > 0), 1)).alias("false_alarms"))
    recall, precision = F.round(F.try_divide("hit", "gold"), 3), F.round(F.try_divide("right", "predicted"), 3)
    return sums.withColumns({"recall": recall, "precision": precision, "f1": F.round(F.try_divide(2 * recall * precision, recall + precision), 3)})


def size_recall(gold: DataFrame, matches: DataFrame, key: str, size: str, edges: tuple[int, ...] = (24, 48, 96)) -> DataFrame:
    """(bucket, gold, hit, recall): gold boxes by size, those below the first edge or marked invalid are ignored."""
    bucket = F.when(F.col(size) >= edges[-1], f"{edges[-1]}+")
    for low, high in zip(edges[-2::-1], edges[:0:-1]):
        bucket = bucket.when(F.col(size) >= low, f"{low}-{high}")
    hit = matches.select(F.col(key).alias("m_key")).distinct()
    rows = gold.where(~F.coalesce("invalid", F.lit(False))).select(key, bucket.alias("bucket")).where("bucket is not null").join(hit, F.col(key) == F.col("m_key"), "left")
    return rows.groupBy("bucket").agg(F.count("*").alias("gold"), F.count("m_key").alias("hit")).withColumn("recall", F.round(F.col("hit") / F.col("gold"), 3))


def object_recall(gold: DataFrame, predicted: DataFrame, page: str, key: str, least: float = 0.9) -> DataFrame:
    """(page, objects, covered): gold boxes of which the union of the predicted boxes covers ``least`` or more.

    As in the query's SQL, a line of a gold box that no predicted box meets counts as covered.

    A page is cut into bands of BAND lines, and a band where predicted boxes begin or end: a box has a row for each such
    slab it touches, not for each line.  One pass along a slab knows the length covered up to each place; what is covered
    of a gold box is the difference between its two sides.
    """
    sides = lambda df, k: df.where("w > 0 and h > 0").select(F.col(page).alias("page"), k.alias("key"), "x", "y", "w", "h")
    found = sides(predicted, F.lit(None).cast(gold.schema[key].dataType)).where("page is not null and x is not null")
    boxes = sides(gold, F.col(key)).withColumn("gold", F.lit(True)).unionByName(found.withColumn("gold", F.lit(False)))
    bands = boxes.withColumn("band", F.explode(F.sequence(F.floor(F.col("y") / BAND), F.floor((F.col("y") + F.col("h") - 1) / BAND))))
    above, below = F.col("band") * BAND, (F.col("band") + 1) * BAND
    parts = bands.select("page", "key", "gold", "band", "x", "w", "h", F.greatest("y", above).alias("top"), F.least(F.col("y") + F.col("h"), below).alias("low"))
    edge = lambda c: F.collect_set(F.when(~F.col("gold"), F.col(c))).over(Window.partitionBy("page", "band"))
    edged = parts.withColumn("edges", F.array_sort(F.array_union(F.array_union(edge("top"), edge("low")), F.array(above, below))))
    slabs = F.transform("edges", lambda e, i: F.struct(e.alias("top"), F.get("edges", i + 1).alias("low")))
    slab = edged.withColumn("slab", F.explode(F.filter(slabs, lambda s: (s["top"] < F.col("low")) & (s["low"] > F.col("top"))))).drop("edges")
    # a gold box stands at its left (-1) and its right (1), a predicted box at its left (2), behind gold ones of the same place
    sign = F.explode(F.when(F.col("gold"), F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(2)))).alias("sign")
    right = F.col("x") + F.col("w")
    along = slab.select("page", "key", "band", F.col("slab.top").alias("slab"), "x", "w", "h", (F.least("low", "slab.low") - F.greatest("top", "slab.top")).alias("lines"), sign).withColumn("at", F.when(F.col("sign") == 1, right).otherwise(F.col("x")))
    w = Window.partitionBy("page", "band", "slab").orderBy("at", "sign")
    reach = along.withColumn("reach", F.max(F.when(F.col("sign") == 2, right)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("sign") == 2, F.greatest(F.lit(0), right - F.greatest("x", "reach"))).otherwise(0)
    filled = reach.withColumn("filled", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("sign < 2")
    unmet = F.when((F.col("sign") == 1) & F.col("x").isNotNull() & (F.col("reach").isNull() | (F.col("reach") <= F.col("x"))), F.col("w")).otherwise(0)
    px = F.sum(F.col("lines") * (F.col("sign") * (F.col("filled") - F.greatest(F.lit(0), F.col("reach") - F.col("at"))) + unmet))
    each = filled.groupBy("page", "key", "w", "h").agg(px.alias("px"))
    return each.groupBy(F.col("page").alias(page)).agg(F.count("*").alias("objects"), F.count(F.when(F.col("px") >= F.lit(Decimal(str(least))) * F.col("w") * F.col("h"), 1)).alias("covered"))


def leaked(received: DataFrame, secrets: DataFrame, key: str, text: str, most: int = 10_000) -> DataFrame:
    """(key, secret): received texts that hold a secret as it is or without its spaces; secrets are a list checked in size."""
    few = secrets.select("secret").where("secret != ''").limit(most + 1)
    if few.count() > most:
        raise ValueError(f"more than {most} secrets")
    raw = F.col(text).contains(F.col("secret")) | F.col(text).contains(F.regexp_replace("secret", r"\s", ""))
    return received.select(key, text).join(F.broadcast(few), raw).select(key, "secret")


def type_recall(images: DataFrame, key: str, gold: str, found: str) -> DataFrame:
    """(key, missed, recall): types an image holds that no box shows."""
    wanted = F.array_distinct(gold)
    missed = F.array_sort(F.array_except(wanted, found))
    return images.select(key, F.array_join(missed, ",").alias("missed"), F.round(F.try_divide(F.size(wanted) - F.size(missed), F.size(wanted)), 3).alias("recall"))
