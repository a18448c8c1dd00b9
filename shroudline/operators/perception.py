"""What the page's pictures and boxes say: clipping, hints, regions, words read from images, detector outputs.

Boxes are rows.  Only decoding of pixels and of detector tensors runs in Python, over Arrow batches; all else is native.

Defined results: a box with a null side is left out; a region without classes is judged by its page hint alone; an image
that cannot be read has a null fingerprint.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.operators import rules, vision

#: Page hints of an image by the words of its texts, names and classes; the first that matches wins.
HINTS = {
    "signature": r"\bsign(?:ature|ed)?\b|autograph",
    "id_card": r"aadh?aa?r|\bpan[\s_-]?card|passport|licen[cs]e|voter|\bid[\s_-]?(?:card|proof|doc)|identity|kyc",
    "bank_card": r"credit[\s_-]?card|debit[\s_-]?card|\bcard[\s_-]?(?:front|back|image)",
    "face_photo": r"avatar|profile[\s_-]?(?:pic|photo|image)|headshot|selfie|portrait|user[\s_-]?photo|customer photo|\bdp\b",
    "qr_code": r"\bqr\b|qrcode",
}
#: The least confidence of a sensitive top class, the least joint share of sensitive classes, the least share
#: of a region that a face covers to explain it, the least confidence of a word read from an image.
TOP_SHARE, JOINT_SHARE, FACE_SHARE, WORD_CONFIDENCE = 0.35, 0.5, 0.2, 40


def viewport_clip(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the viewport as struct<x,y,w,h>; null where none is."""
    left, top, right, low = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), F.least(x + w, width), F.least(y + h, height)
    seen = (w > 0) & (h > 0) & (right > left) & (low > top)
    return F.when(seen, F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (low - top).alias("h")))


def image_hint(*words: Column) -> Column:
    """What an image's own words say it shows, or null."""
    said = F.concat_ws(" ", *words)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for hint, pattern in HINTS.items():
        out = out.when(said.rlike("(?i)" + pattern), hint)
    return out


def region_sensitivity(classes: DataFrame, key: str, sensitive: list[str], hint: str) -> DataFrame:
    """(key, label, sensitive, source) of each region from its classes (key, class, p, hint): vision and page hints, either can flag."""
    named = F.col("class").isin(*sensitive)
    by = classes.groupBy(key).agg(F.max_by("class", F.struct("p", "class")).alias("top"), F.max("p").alias("confidence"), F.coalesce(F.sum(F.when(named, F.col("p"))), F.lit(0.0)).alias("joint"), F.max(hint).alias("h"))
    seen = F.coalesce(F.col("top").isin(*sensitive) & (F.col("confidence") >= TOP_SHARE) | (F.col("joint") >= JOINT_SHARE), F.lit(False))
    hinted = F.col("h").isNotNull()
    label = F.when(seen | ~hinted, F.coalesce("top", F.lit("image"))).otherwise(F.col("h"))
    source = F.when(seen & hinted, "vision+dom").when(hinted & ~seen, "dom").otherwise("vision")
    return by.select(key, label.alias("label"), (seen | hinted).alias("sensitive"), source.alias("source"))


def face_regions(regions: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """(key) of regions a face dominates: the joint area of their faces is at least FACE_SHARE of their own."""
    covered = faces.groupBy(F.col(key).alias("f_key")).agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    return regions.join(covered, F.col(key) == F.col("f_key")).where(F.col("area") >= FACE_SHARE * F.col("w") * F.col("h")).select(key)


def ocr_words(pages: DataFrame, key: str, blocks: str) -> DataFrame:
    """(key, ord, word, confidence, x, y, w, h, start, stop): words of the four-level tree in reading order with their places in the joined text."""
    level = pages.select(key, F.posexplode(blocks).alias("b", "block"))
    level = level.select(key, "b", F.posexplode("block.paragraphs").alias("p", "paragraph"))
    level = level.select(key, "b", "p", F.posexplode("paragraph.lines").alias("l", "line"))
    words = level.select(key, "b", "p", "l", F.posexplode("line.words").alias("w", "word")).select(
        key, F.struct("b", "p", "l", "w").alias("ord"), F.trim("word.text").alias("t"), F.col("word.confidence").alias("confidence"), F.col("word.x").alias("x"), F.col("word.y").alias("y"), F.col("word.w").alias("width"), F.col("word.h").alias("height")
    ).where((F.col("t") != "") & (F.col("confidence") >= WORD_CONFIDENCE))
    w = Window.partitionBy(key).orderBy("ord")
    start = F.coalesce(F.sum(F.length("t") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.select(key, F.row_number().over(w).alias("ord"), F.col("t").alias("word"), "confidence", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"), start.alias("start"), (start + F.length("t")).alias("stop"))


def joined_words(words: DataFrame, key: str) -> DataFrame:
    """(key, text): the words of an image as one text; an image's words are a page at most."""
    return words.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda s: s["word"]), " ").alias("text"))


def span_boxes(spans: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, type, word, x, y, w, h): the boxes of the words that spans (key, start, stop, type) touch."""
    s = spans.select(F.col(key).alias("s_key"), F.col("start").alias("s_start"), F.col("stop").alias("s_stop"), "type")
    met = words.join(s, (F.col(key) == F.col("s_key")) & (F.col("start") < F.col("s_stop")) & (F.col("stop") > F.col("s_start")))
    return met.select(key, "type", "word", "x", "y", "w", "h")


def ocr_boxes(pages: DataFrame, key: str, blocks: str) -> DataFrame:
    """Boxes of all personal data read from images."""
    words = ocr_words(pages, key, blocks)
    found = joined_words(words, key).select(key, F.explode(rules.detect(F.col("text"))).alias("s")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.type").alias("type"))
    return span_boxes(found, words, key)


def box_union(**kinds: DataFrame) -> DataFrame:
    """(kind, key, x, y, w, h) of boxes of several producers, each given as (key, x, y, w, h)."""
    rows = [df.select(F.lit(kind).alias("kind"), "key", *[F.col(c).cast("double").alias(c) for c in "xywh"]) for kind, df in kinds.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out.where("x is not null and y is not null and w is not null and h is not null")


def classify_head(features: Column, weights: list[list[float]], bias: list[float], classes: list[str]) -> Column:
    """array<struct<p,class>> of a linear head under softmax, best first."""
    z = F.array(*[F.aggregate(F.zip_with(F.array(*[F.lit(float(v)) for v in row]), features, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.lit(float(b)) for row, b in zip(weights, bias)])
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    named = F.zip_with(e, F.array(*[F.lit(c) for c in classes]), lambda v, c: F.struct((v / total).alias("p"), c.alias("class")))
    return F.reverse(F.array_sort(named))


def decode_detector(cells: DataFrame, size: int = 640, least: float = 0.6) -> DataFrame:
    """(image, score, x, y, w, h) of a face detector's cells (image, stride, cell, cls, obj, dx, dy, dw, dh, scale), before suppression."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = F.sqrt(clamp(F.col("cls")) * clamp(F.col("obj")))
    across = F.lit(size) / F.col("stride")
    cx, cy = (F.col("cell") % across + F.col("dx")) * F.col("stride"), (F.floor(F.col("cell") / across) + F.col("dy")) * F.col("stride")
    w, h = F.exp("dw") * F.col("stride"), F.exp("dh") * F.col("stride")
    return cells.withColumn("score", score).where(F.col("score") >= least).select("image", "score", ((cx - w / 2) / F.col("scale")).alias("x"), ((cy - h / 2) / F.col("scale")).alias("y"), (w / F.col("scale")).alias("w"), (h / F.col("scale")).alias("h"))


def mosaic_back(cell: Column, x: Column, y: Column, scale: Column, left: Column, top: Column, side: int = 160, across: int = 4) -> tuple[Column, Column]:
    """A place in the mosaic back on the page: out of its cell, out of the crop's scale, to the crop's own place."""
    cx, cy = vision.mosaic_cell(cell, side, across)
    return left + (x - cx) / scale, top + (y - cy) / scale


def merged_faces(boxes: DataFrame, image: str, overlap: float = 0.3) -> DataFrame:
    """(image, x, y, w, h): faces found twice merged, image by image; an image has few faces."""
    kind = dict(boxes.dtypes)[image]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = vision.merge_boxes(pdf.sort_values(["x", "y", "w", "h"]), overlap)
        out.insert(0, image, pdf[image].iloc[0])
        return out

    return boxes.select(image, *[F.col(c).cast("double").alias(c) for c in "xywh"]).groupBy(image).applyInPandas(one, f"{image} {kind}, x double, y double, w double, h double")


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of an image a box covers, at least a pixel."""
    height, width = image.shape[:2]
    x, y = min(max(0, x), width - 1), min(max(0, y), height - 1)
    return image[y : min(height, y + max(1, h)), x : min(width, x + max(1, w))]


def clip_input(image: np.ndarray, size: int = 256) -> np.ndarray:
    """Shortest side to ``size``, centre crop, channels first, values of 0 to 1."""
    h, w = image.shape[:2]
    scale = size / min(w, h)
    wide, high = max(size, round(w * scale)), max(size, round(h * scale))
    big = vision.resize(image[..., :3].astype(float), wide, high)
    left, top = (wide - size) // 2, (high - size) // 2
    return (big[top : top + size, left : left + size] / 255).transpose(2, 0, 1)


def read_pixels(content: bytes) -> np.ndarray | None:
    """Rows, columns and channels of a binary PPM or PGM image; null where it is none."""
    stream = io.BytesIO(content or b"")
    head = stream.readline().split()
    if not head or head[0] not in (b"P5", b"P6"):
        return None
    numbers = head[1:]
    while len(numbers) < 3:
        line = stream.readline()
        if not line:
            return None
        numbers += line.split(b"#")[0].split()
    width, height, _ = map(int, numbers[:3])
    depth = 3 if head[0] == b"P6" else 1
    raw = stream.read(width * height * depth)
    if len(raw) < width * height * depth or width < 1 or height < 1:
        return None
    pixels = np.frombuffer(raw, dtype=np.uint8).reshape(height, width, depth)
    return pixels if depth == 3 else pixels[..., 0]


def fingerprints(content: Column) -> Column:
    """64-bit difference hash of each image, null where it cannot be read."""

    @F.pandas_udf("bigint")
    def run(images: pd.Series) -> pd.Series:
        pixels = [read_pixels(i) if i is not None else None for i in images]
        return pd.Series([vision.dhash(p) if p is not None else None for p in pixels], dtype="Int64")

    return run(content)


def write_pixels(pixels: np.ndarray) -> bytes:
    """A binary PPM or PGM image."""
    colour = pixels.ndim == 3
    head = f"{'P6' if colour else 'P5'}\n{pixels.shape[1]} {pixels.shape[0]}\n255\n".encode()
    return head + np.clip(np.round(pixels), 0, 255).astype(np.uint8).tobytes()


def painted(content: Column, boxes: Column, pad: int = 2) -> Column:
    """Each image with opaque boxes (array<struct<x,y,w,h>>) over it; null where it cannot be read."""

    @F.pandas_udf("binary")
    def run(images: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for image, held in zip(images, places):
            pixels = read_pixels(image) if image is not None else None
            if pixels is None:
                out.append(None)
                continue
            rows = pixels if pixels.ndim == 3 else pixels[..., None]
            done = vision.paint(rows, [(b["x"], b["y"], b["w"], b["h"]) for b in (held if held is not None else ()) if None not in (b["x"], b["y"], b["w"], b["h"])], pad)
            out.append(write_pixels(done if pixels.ndim == 3 else done[..., 0]))
        return pd.Series(out, dtype=object)

    return run(content, boxes)


def resized(content: Column, width: int, height: int, box: Column | None = None) -> Column:
    """Each image, or the part of it a box (struct<x,y,w,h>) covers, at another size; null where it cannot be read."""

    @F.pandas_udf("binary")
    def run(images: pd.Series, parts: pd.DataFrame) -> pd.Series:
        out = []
        for i, image in enumerate(images):
            pixels = read_pixels(image) if image is not None else None
            if pixels is not None and pd.notna(parts["x"].iloc[i]):
                pixels = crop(pixels, *[int(parts[c].iloc[i]) for c in "xywh"])
            out.append(write_pixels(vision.resize(pixels.astype(float), width, height)) if pixels is not None else None)
        return pd.Series(out, dtype=object)

    whole = F.struct(*[F.lit(None).cast("int").alias(c) for c in "xywh"])
    return run(content, box if box is not None else whole)


def screenshots(spark, folder: str) -> DataFrame:
    """(path, content, at) of the pictures under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content", F.col("modificationTime").alias("at"))
