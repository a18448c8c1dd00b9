"""Vectors, boxes and image features: columns where arithmetic suffices, vectorised functions where pixels are needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a label table at most: it is configuration, broadcast only below this.
MOST_LABELS = 10_000
#: Evidence each structural cue adds to a class of screens.
PRIORS = (
    ("error_captcha", 4.0, "captcha > 0"), ("error_captcha", 3.0, "error_title > 0"), ("login", 3.0, "pw > 0 and other_fields <= 2"), ("login", 1.0, "pw = 0 and fields between 1 and 2 and words < 250 and search_value = 0 and url_query = 0"),
    ("signup_form", 2.5, "fields >= 4 and (pw > 0 or email_fields > 0)"), ("signup_form", 1.0, "fields >= 5 and card_fields = 0"), ("checkout_payment", 3.0, "card_fields > 0"), ("kyc_identity", 2.5, "kyc_hint > 0 and (file_inputs > 0 or images > 0)"),
    ("banking", 1.5, "bank_hint > 0"), ("email_inbox", 3.0, "inbox_hint > 0"), ("chat", 1.5, "chat_hint > 0"), ("profile_page", 1.5, "profile_hint > 0"), ("code_repo", 2.0, "repo_hint > 0 and code_lines >= 5"), ("code_repo", 1.5, "code_lines >= 30"),
    ("search_results", 2.5, "(search_value > 0 or url_query > 0) and links >= 10"), ("article", 2.0, "paragraphs >= 6 and words >= 500"), ("product_listing", 3.0, "prices >= 5 and images >= 4"), ("dashboard_table", 2.0, "table_rows >= 15"),
    ("dashboard_table", 1.0, "canvas_area >= 0.08 and map_hint = 0"), ("video", 3.0, "video_area >= 0.15"), ("map", 3.0, "map_hint > 0 or canvas_area >= 0.5"), ("document_viewer", 3.0, "pdf_hint > 0"), ("social_feed", 2.0, "feed_hint > 0 and (articles >= 3 or round_images >= 3)"),
)


def l2_normalize(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def zero_shot(vectors: DataFrame, labels: DataFrame, key: str, vector: str, top: int = 3, scale: float = 100.0) -> DataFrame:
    """(key, class, p, rank): the best prompt of each class, softmax over classes, the first ``top``; ties by class.

    The label table is broadcast after a check of its size; each vector meets it in one pass, without a cross join in
    the plan: the labels ride along as an array.
    """
    rows = labels.select("class", "emb").take(MOST_LABELS + 1)
    if len(rows) > MOST_LABELS:
        raise ValueError("the label table is larger than may be broadcast")
    names = sorted({r["class"] for r in rows})
    place = {n: i for i, n in enumerate(names)}
    matrix = np.array([r["emb"] for r in rows], dtype=np.float64)
    of = np.array([place[r["class"]] for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            scores = x @ matrix.T * scale
            best = np.full((len(pdf), len(names)), -np.inf)
            for k in range(len(names)):
                best[:, k] = scores[:, of == k].max(axis=1)
            e = np.exp(best - best.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")[:, :top]
            n = order.shape[1]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), n), "class": np.array(names, dtype=object)[order].ravel(), "p": np.take_along_axis(p, order, 1).ravel(), "rank": np.tile(np.arange(1, n + 1), len(pdf))})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"{key} {kind}, class string, p double, rank int")


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(class, emb): mean vector of each label, at length one; partial sums per place, no vector leaves its task."""
    means = vectors.select(F.col(label).cast("string").alias("class"), F.posexplode(vector).alias("i", "x")).groupBy("class", "i").agg(F.avg("x").alias("m"))
    gathered = means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("emb"))
    return gathered.select("class", l2_normalize(F.col("emb")).alias("emb"))


def train_head(vectors: DataFrame, label: str, vector: str, key: str, rounds: int = 60) -> DataFrame:
    """(key, label, predicted): a multinomial logistic head fitted over all rows with classes balanced by weight, and its answers."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = vectors.groupBy(F.col(label).alias("c_label")).agg(F.count("*").alias("c"))
    rows = vectors.select(key, F.col(label).cast("double").alias("label"), array_to_vector(vector).alias("features"))
    weighted = rows.join(F.broadcast(counts), rows["label"] == counts["c_label"].cast("double")).select(key, "label", "features", (1.0 / F.col("c")).alias("weight"))
    model = LogisticRegression(family="multinomial", weightCol="weight", maxIter=rounds, regParam=0.001).fit(weighted)
    return model.transform(weighted).select(key, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def fuse(probabilities: DataFrame, priors: DataFrame, key: str) -> DataFrame:
    """(key, class, p): softmax of log probability (at least 1e-6) plus prior evidence."""
    joined = probabilities.join(priors, [key, "class"], "left")
    logit = F.log(F.greatest(F.col("p"), F.lit(1e-6))) + F.coalesce(F.col("w"), F.lit(0.0))
    of = Window.partitionBy(key)
    shifted = joined.select(key, "class", logit.alias("l")).withColumn("e", F.exp(F.col("l") - F.max("l").over(of)))
    return shifted.select(key, "class", (F.col("e") / F.sum("e").over(of)).alias("p"))


#: Structural counts of a page from its nodes.  t is a node's text and f the words of its field, in lower case;
#: {m}(x, {q}'pattern') is a pattern match, {w} the number of words of t.  Areas are shares of a screen of 1280 by 720.
_FIELD = "node_role IN ('textbox', 'combobox', 'checkbox', 'searchbox', 'password', 'file')"
_N = "count(CASE WHEN {} THEN 1 END)"
_HAS = "max(CASE WHEN {} THEN 1 ELSE 0 END)"
FEATURES = {
    "fields": _N.format(_FIELD), "pw": _N.format(_FIELD + " AND {m}(f, {q}'password|passwd|pwd')"), "other_fields": _N.format(_FIELD + " AND NOT {m}(f, {q}'password|passwd|pwd')"),
    "email_fields": _N.format(_FIELD + " AND {m}(f, {q}'e-?mail')"), "card_fields": _N.format(_FIELD + " AND {m}(f, {q}'cc-|card|cvv|cvc|expir')"), "file_inputs": _N.format("node_role = 'file'"),
    "search_value": _HAS.format("(node_role = 'searchbox' OR " + _FIELD + " AND {m}(f, {q}'search|query|^q$')) AND coalesce(field_value, '') <> ''"), "url_query": _HAS.format("{m}(coalesce(href, ''), {q}'(?i)[?&](?:q|query|search|keyword|k|_nkw|text)=')"),
    "links": _N.format("node_role = 'link'"), "images": _N.format("node_role = 'img' AND rect.w >= 60"), "round_images": _N.format("node_role = 'img' AND rect.w = rect.h AND {m}(coalesce(src, ''), {q}'(?i)avatar|profile')"),
    "video_area": "round(coalesce(max(CASE WHEN node_role = 'video' THEN cast(rect.w AS double) * rect.h END), 0) / 921600, 2)", "canvas_area": "round(coalesce(max(CASE WHEN node_role = 'canvas' THEN cast(rect.w AS double) * rect.h END), 0) / 921600, 2)",
    "map_hint": _HAS.format("{m}(coalesce(src, ''), {q}'(?i)leaflet|mapbox|maplibre|/maps/|openstreetmap')"), "pdf_hint": _HAS.format("{m}(coalesce(href, ''), {q}'(?i)\\.pdf(?:$|[?])')"),
    "table_rows": _N.format("node_role IN ('row', 'cell')"), "code_lines": "coalesce(sum(CASE WHEN node_role = 'code' THEN 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) END), 0)",
    "articles": _N.format("node_role = 'article'"), "paragraphs": _N.format("node_role = 'paragraph' AND length(text) > 80"), "words": "sum({w})",
    "prices": _N.format("{m}(t, {q}'(?:₹|rs[.]?|[$]|€|£|inr|usd)\\s?\\d')"), "captcha": _HAS.format("{m}(t, {q}'verify you are human|not a robot|verification required|performing security|captcha')"),
    "error_title": _HAS.format("node_role = 'heading' AND {m}(t, {q}'\\b(?:404|403|500|not found|access denied|no such|unavailable|error)\\b')"),
    "kyc_hint": _HAS.format("{m}(t, {q}'\\b(?:kyc|aadhaa?r|pan card|passport|identity (?:proof|verification))\\b')"), "bank_hint": _HAS.format("{m}(t, {q}'\\b(?:account balance|available balance|a/c no|ifsc|net ?banking|statement|transactions?|beneficiar)')"),
    "inbox_hint": _HAS.format("{m}(t, {q}'\\b(?:inbox|compose|drafts|sent mail|spam)\\b')") + " * " + _HAS.format("{m}(t, {q}'\\b(?:from|subject|unread)\\b')"),
    "chat_hint": _HAS.format("{m}(t, {q}'\\b(?:type a message|send message|chat|channel|dm|direct message)\\b')") + " * " + _HAS.format("node_role = 'textbox'"),
    "profile_hint": _HAS.format("{m}(t, {q}'\\b(?:followers|following|joined|repositories|posts|connections|about me)\\b')") + " * " + _HAS.format("node_role = 'img' AND rect.w >= 120"),
    "repo_hint": _HAS.format("{m}(t, {q}'\\b(?:commits?|branch(?:es)?|pull requests?|readme|fork|star|issues)\\b')") + " * " + _HAS.format("{m}(t, {q}'\\b(?:code|files?)\\b')"),
    "feed_hint": _HAS.format("{m}(t, {q}'\\b(?:\\d+[hm] ago|\\d+[hmd]\\b|likes?|reposts?|retweets?|comments?|replies|points by|upvotes?)\\b')"),
}


def feature_sql(name: str, match: str, quote: str, words: str) -> str:
    """A feature as SQL of an engine: the name of its pattern match, what marks a literal without escapes, and its count of words."""
    out = FEATURES[name].replace("{m}", match).replace("{q}", quote).replace("{w}", words)
    return f"CAST({out} AS {'DOUBLE' if name.endswith('_area') else 'BIGINT'}) AS {name}"


def page_features(nodes: DataFrame, page: str) -> DataFrame:
    """The structural counts of each page, one aggregation with partial counts."""
    rows = nodes.withColumn("t", F.lower(F.coalesce("text", F.lit("")))).withColumn("f", F.lower(F.concat_ws(" ", "label", "placeholder")))
    return rows.groupBy(page).agg(*[F.expr(feature_sql(name, "regexp_like", "r", r"regexp_count(t, r'\S+')")) for name in FEATURES])


def screen_priors(features: DataFrame, key: str) -> DataFrame:
    """(key, class, w): summed evidence of the cues that hold."""
    cues = F.array(*[F.when(F.expr(condition), F.struct(F.lit(c).alias("class"), F.lit(w).alias("w"))) for c, w, condition in PRIORS])
    return features.select(key, F.explode(F.array_compact(cues)).alias("cue")).groupBy(key, F.col("cue.class").alias("class")).agg(F.sum("cue.w").alias("w"))


def feature_vector(values: list[Column]) -> Column:
    return F.array(*[F.log1p(F.greatest(F.lit(0.0), F.coalesce(v.cast("double"), F.lit(0.0)))) / 4 for v in values])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column) -> Column:
    """The signs of up to 64 components as one bigint."""
    return F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = w * h
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def mosaic_cell(i: Column, cell: int = 160, across: int = 4) -> tuple[Column, Column]:
    """Place of the i-th crop in a mosaic."""
    return (i % across) * cell, F.floor(i / across) * cell


def nms(boxes: Column, overlap: float = 0.3) -> Column:
    """Greedy non-maximum suppression over array<struct<score,x,y,w,h>> as a native fold."""
    ranked = F.reverse(F.array_sort(boxes))
    one = lambda a, b: iou(a["x"], a["y"], a["w"], a["h"], b["x"], b["y"], b["w"], b["h"])
    return F.aggregate(ranked, F.filter(boxes, lambda b: F.lit(False)), lambda kept, b: F.when(F.exists(kept, lambda k: one(k, b) > overlap), kept).otherwise(F.array_append(kept, b)))


def merge_boxes(pdf: pd.DataFrame, overlap: float = 0.3) -> pd.DataFrame:
    """One image's boxes: a box that shares more than ``overlap`` of the smaller with an earlier one is merged into it."""
    out: list[list] = []
    for x, y, w, h in pdf[["x", "y", "w", "h"]].itertuples(index=False):
        for k in out:
            iw, ih = min(k[0] + k[2], x + w) - max(k[0], x), min(k[1] + k[3], y + h) - max(k[1], y)
            if iw > 0 and ih > 0 and iw * ih > overlap * min(k[2] * k[3], w * h):
                right, low = max(k[0] + k[2], x + w), max(k[1] + k[3], y + h)
                k[0], k[1] = min(k[0], x), min(k[1], y)
                k[2], k[3] = right - k[0], low - k[1]
                break
        else:
            out.append([x, y, w, h])
    return pd.DataFrame(out, columns=["x", "y", "w", "h"])


# pixels ------------------------------------------------------------------------------------------------------------
def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, sampling at pixel centres."""
    h, w = image.shape[:2]
    ys = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    xs = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def dhash(image: np.ndarray) -> int:
    """64 bits: whether brightness falls from each pixel of a 9x8 copy to its right neighbour, as a signed bigint."""
    luma = image[..., :3] @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(float)
    small = np.round(resize(luma, 9, 8), 6)  # equal brightness stays equal
    value = 0
    for bit in (small[:, :-1] > small[:, 1:]).ravel():
        value = value << 1 | int(bit)
    return value - (1 << 64) if value >> 63 else value


def paint(image: np.ndarray, boxes: list[tuple], pad: int = 2) -> np.ndarray:
    """Opaque boxes; boxes with places that are no numbers are left out."""
    out = image.copy()
    for box in boxes:
        if all(np.isfinite(v) for v in box):
            x, y, w, h = box
            out[max(0, int(y) - pad) : max(0, int(np.ceil(y + h)) + pad), max(0, int(x) - pad) : max(0, int(np.ceil(x + w)) + pad), :3] = 0
    return out


def ctc_collapse(labels: Column, blank: int = 0) -> Column:
    """Runs of one label become one, blanks go."""
    kept = F.filter(F.transform(labels, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(labels, i - 1)).alias("p"))), lambda s: (s["x"] != blank) & (s["p"].isNull() | (s["p"] != s["x"])))
    return F.transform(kept, lambda s: s["x"])
