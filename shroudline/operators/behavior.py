"""Made-up behaviour: clamped normal and log-normal delays, and paths of the pointer along Bezier curves.

Draws are functions of a key and a salt, so a repeated task gives the same values, and no order of rows matters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.operators.language import fitts_ms, minimum_jerk


def uniform(key: Column, salt: str) -> Column:
    """A number above 0 and below 1 for a key and a salt."""
    digest = F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), F.lit(8)), 16, 10).cast("double")
    return (digest + 0.5) / 4294967296.0


def normal(key: Column, salt: str) -> Column:
    """A standard normal number by the Box-Muller transform."""
    return F.sqrt(-2.0 * F.log(uniform(key, salt + "u"))) * F.cos(2.0 * math.pi * uniform(key, salt + "v"))


def clamped_normal(z: Column, mean: Column, deviation: Column, least: Column, most: Column) -> Column:
    return F.greatest(least, F.least(most, mean + z * deviation))


def clamped_log_normal(z: Column, mean: Column, deviation: Column, least: Column, most: Column) -> Column:
    """A log-normal number with the given mean and deviation, clamped."""
    variance = deviation * deviation
    mu = F.log(mean * mean / F.sqrt(variance + mean * mean))
    sigma = F.sqrt(F.log(variance / (mean * mean) + 1))
    return F.greatest(least, F.least(most, F.exp(mu + sigma * z)))


def target_point(x: Column, y: Column, w: Column, h: Column, zx: Column, zy: Column) -> Column:
    """A place inside a box, near its middle and off its edges, as struct<x,y>."""
    w, h = F.greatest(F.lit(2.0), w), F.greatest(F.lit(2.0), h)
    px, py = F.least(F.lit(8.0), w * 0.18), F.least(F.lit(6.0), h * 0.18)
    sx, sy = F.greatest(F.lit(1.0), (w - 2 * px) / 6), F.greatest(F.lit(1.0), (h - 2 * py) / 6)
    return F.struct(F.round(clamped_normal(zx, x + w / 2, sx, x + px, x + w - px)).cast("int").alias("x"), F.round(clamped_normal(zy, y + h / 2, sy, y + py, y + h - py)).cast("int").alias("y"))


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """A coordinate of a cubic Bezier curve."""
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3


def paths(moves: DataFrame, key: str, width: Column | None = None) -> DataFrame:
    """(key, step, x, y): the points of each move (key, x0, y0, x1, y1), slow at its ends, bent to one side, trembling on its way; the last is the target itself."""
    k = F.col(key)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    far = F.sqrt(dx * dx + dy * dy)
    steps = F.when(far < 4, 1).otherwise(F.greatest(F.lit(8), F.least(F.lit(65), F.round(fitts_ms(far, width if width is not None else F.lit(30.0)) / 16).cast("int"))))
    bend = F.when(uniform(k, "side") < 0.5, 1).otherwise(-1) * (0.12 + uniform(k, "bend") * 0.18) * far
    px, py = F.try_divide(-dy, far), F.try_divide(dx, far)
    d1, j1, d2, j2 = 0.25 + uniform(k, "d1") * 0.15, (uniform(k, "j1") - 0.5) * 6, 0.70 + uniform(k, "d2") * 0.15, (uniform(k, "j2") - 0.5) * 4
    control = {"ax": F.col("x0") + dx * d1 + px * bend * 0.85 + j1, "ay": F.col("y0") + dy * d1 + py * bend * 0.85 + j1, "bx": F.col("x0") + dx * d2 + px * bend * 0.35 + j2, "by": F.col("y0") + dy * d2 + py * bend * 0.35 + j2}
    rows = moves.withColumns({"steps": steps, **control}).withColumn("step", F.explode(F.sequence(F.lit(1), "steps")))
    linear = F.col("step") / F.col("steps")
    eased = minimum_jerk(linear)
    at = F.concat(k.cast("string"), F.lit("/"), F.col("step").cast("string"))
    tremor = lambda salt: F.when(linear < 0.95, (uniform(at, salt) - 0.5) * 0.8).otherwise(0.0)
    last = F.col("step") == F.col("steps")
    x = F.when(last, F.col("x1")).otherwise(F.round(bezier(F.col("x0"), F.col("ax"), F.col("bx"), F.col("x1"), eased) + tremor("x")))
    y = F.when(last, F.col("y1")).otherwise(F.round(bezier(F.col("y0"), F.col("ay"), F.col("by"), F.col("y1"), eased) + tremor("y")))
    return rows.select(key, "step", x.cast("int").alias("x"), y.cast("int").alias("y"))
