"""Filling fixed-capacity containers by vector best-fit.

Each container has three residual capacities: tokens, number of documents, and attention cost (the sum of squared
lengths).  A piece goes into the open container in which the weighted norm of what would remain is smallest, among
those where no capacity is exceeded; pieces are taken from the longest to the shortest.  A piece whose own cost is above
the limit stands alone.  Full pieces of longer documents fill a container each and never leave the JVM; the rest is
spread over shards of about ``shard_tokens`` tokens, each packed by one task, so a shard's memory does not grow with the
input; at most the last few containers of a shard stay part-filled.

Defined results: a document longer than the capacity becomes full pieces and one remainder, every other one stays
whole; empty and null texts take a place of 0 tokens; repeated rows are packed one by one, spread over the shards; no
documents, no rows; a container kind with a null or non-positive capacity is left out.  Containers depend on the
documents only, not on files or partitions.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroudline.session import cut

SHARD_TOKENS = 16_000_000
#: Weights of the residuals (tokens, documents, attention cost), each as a share of its capacity.
WEIGHTS = (1.0, 0.01, 0.05)
#: Documents a container takes per token of capacity, and its attention cost as a share of the squared capacity.
DOCS_SHARE, COST_SHARE = 1 / 128, 0.75
#: Containers table rows at most: it is configuration, and checked.
MOST_KINDS = 1_000


def best_fit(sizes: list[int], capacity: int, most_docs: int, most_cost: int, weights: tuple = WEIGHTS) -> list[int]:
    """The container number of each size (none above the capacity), numbered from 0 in order of opening."""
    places = [0] * len(sizes)
    residuals: list[int] = []  # token residuals that some open container has
    bins: dict[int, dict[tuple[int, int], list[int]]] = {}  # token residual -> (documents left, cost left) -> containers
    wt, wd, wc = weights
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        size, cost = sizes[i], sizes[i] * sizes[i]
        best, best_norm = None, float("inf")
        for r in residuals[bisect_left(residuals, size) :]:
            left = wt * ((r - size) / capacity) ** 2
            if left >= best_norm:
                break  # further residuals leave more
            for docs, room in bins[r]:
                if docs < 1 or room < cost:
                    continue
                norm = left + wd * ((docs - 1) / most_docs) ** 2 + wc * ((room - cost) / most_cost) ** 2
                if norm < best_norm:
                    best, best_norm = (r, docs, room), norm
        if best is None:
            r, docs, room, number = capacity, most_docs, most_cost, opened
            opened += 1
        else:
            r, docs, room = best
            same = bins[r][docs, room]
            number = same.pop()
            if not same:
                del bins[r][docs, room]
                if not bins[r]:
                    del bins[r]
                    del residuals[bisect_left(residuals, r)]
        places[i] = number
        r, docs, room = r - size, docs - 1, room - cost
        if docs > 0:
            if r not in bins:
                bins[r] = {}
                insort(residuals, r)
            bins[r].setdefault((docs, room), []).append(number)
    return places


_PACKED = "container_kind string, container_id bigint, doc_id bigint, piece int, tokens bigint"
_SHARD, _FULL = 1 << 32, 1 << 31  # a container's number: its shard, then full pieces above part-filled containers


def pack(sizes: DataFrame, containers: DataFrame, shard_tokens: int = SHARD_TOKENS, docs_share: float = DOCS_SHARE, cost_share: float = COST_SHARE) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens) for every kind; sizes are (doc_id, tokens, digest)."""
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().take(MOST_KINDS + 1)
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    if not kinds:
        return sizes.limit(0).selectExpr("cast(null as string) container_kind", "0L container_id", "doc_id", "0 piece", "tokens")
    # equal rows are counted and spread by their number, so that no document's copies meet in one shard
    rows = cut(sizes.select("doc_id", "digest", "tokens").groupBy("doc_id", "digest", "tokens").agg(F.count("*").alias("copies")))
    total = rows.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    each = rows.select("doc_id", "digest", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    placed = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", "copy"), F.lit(shards)))
    # all kinds in one pass over the sizes: an array of (kind, capacity) is exploded per document
    table = F.array(*[F.struct(F.lit(k.container_kind).alias("kind"), F.lit(int(k.capacity_tokens)).cast("bigint").alias("capacity")) for k in kinds])
    wide = placed.withColumn("of", F.explode(table)).select("doc_id", "digest", "copy", "shard", "tokens", F.col("of.kind").alias("container_kind"), F.col("of.capacity").alias("capacity"))
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    long = wide.where("tokens >= capacity").withColumn("whole", whole)
    before = F.sum("whole").over(Window.partitionBy("container_kind", "shard").orderBy("doc_id", "digest", "copy")) - F.col("whole")
    full = long.withColumn("before", before).select(
        "container_kind", "shard", "before", "doc_id", "capacity", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("whole"))).alias("k")
    ).select("container_kind", (F.col("shard") * _SHARD + _FULL + F.col("before") + F.col("k") - 1).alias("container_id"), "doc_id", (F.col("k") - 1).cast("int").alias("piece"), F.col("capacity").alias("tokens"))
    rest = wide.select("container_kind", "capacity", "shard", "doc_id", "digest", "copy", F.when(F.col("tokens") >= F.col("capacity"), whole).otherwise(0).cast("int").alias("piece"), F.pmod("tokens", "capacity").alias("left"), "tokens")

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("left", "descending"), ("doc_id", "ascending"), ("digest", "ascending"), ("copy", "ascending")])
        capacity, shard = group["capacity"][0].as_py(), group["shard"][0].as_py()
        places = best_fit(group["left"].to_pylist(), capacity, max(1, int(capacity * docs_share)), max(1, int(cost_share * capacity * capacity)))
        ids = pc.add(pa.array(places, pa.int64()), shard * _SHARD)
        return pa.table([group["container_kind"], ids, group["doc_id"], group["piece"], group["left"]], names=["container_kind", "container_id", "doc_id", "piece", "tokens"])

    return full.unionByName(rest.where("left > 0 or tokens = 0").drop("tokens").groupBy("container_kind", "shard").applyInArrow(one, _PACKED))


def utilisation(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers, tokens and fill of each kind."""
    filled = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"))
    return filled.join(containers.select("container_kind", "capacity_tokens").distinct(), "container_kind").select(
        "container_kind", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill")
    )
