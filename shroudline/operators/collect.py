"""Collections, bounded lists and loop guards: first-wins de-duplication, merges, upserts, streaks.

Defined results: ties go to the smaller order column; empty texts count as missing in item keys; a null key is a key of
its own only where said.  Windows are partitioned by the sequence's key, so each sequence is sorted within its own
partition and spills; no sequence is gathered into a Python object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.functions.text import frame_url, normalize_url
from shroudline.operators.groups import sorted_groups
from shroudline.session import cut

#: Actions a repeat, a reload or a retry is counted for.
LOOP_ACTIONS = ("open_tab", "navigate", "click", "back")
RETRY_ACTIONS = ("type", "select", "check", "press_key")


def item_key(href: Column, url: Column, text: Column, whole: Column) -> Column:
    """The first of address, url and text that is there, else the whole record."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(href), some(url), some(text), whole)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order.  A partial minimum before the shuffle, so copies of a hot key stay where they are."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def merge_capped(old: DataFrame, new: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Old rows, then new ones with unseen keys; the first ``cap`` of them."""
    fresh = first_wins(new.join(old.select(key), key, "left_anti"), [key], [order])
    both = old.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
    return both.orderBy("part", order, key).limit(cap).drop("part")


def upsert_facts(facts: DataFrame, key: str, value: str, time: str, cap: int) -> DataFrame:
    """Latest value of each key without regard to case; the place is the first; the oldest go beyond the cap."""
    latest = facts.groupBy(F.lower(key).alias("fact")).agg(F.max_by(value, time).alias("value"), F.min(time).alias("since"))
    return latest.orderBy(F.desc("since"), "fact").limit(cap)


def upsert_templates(uses: DataFrame, prompt: str, time: str, cap: int) -> DataFrame:
    """Each prompt once, last used first, the newest ``cap``."""
    last = uses.groupBy(F.col(prompt).alias("prompt")).agg(F.max(time).alias("last_used"), F.count("*").alias("uses"))
    return last.orderBy(F.desc("last_used"), "prompt").limit(cap)


def newest(df: DataFrame, by: list[str], time: str, tie: str, cap: int) -> DataFrame:
    """The newest ``cap`` rows of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), tie))).where(F.col("rn") <= cap)


def streaks(df: DataFrame, by: str, order: list[str], same: Column) -> DataFrame:
    """Length of the run of equal, counted rows that ends at each row (gaps and islands); rows with a null ``same`` reset it."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.withColumn("sig", same)
    broken = marked.withColumn("new", F.when(F.col("sig").eqNullSafe(F.lag("sig").over(w)) & F.col("sig").isNotNull(), 0).otherwise(1))
    grouped = broken.withColumn("run", F.sum("new").over(w))
    inner = Window.partitionBy(by, "run").orderBy(*order)
    return grouped.withColumn("streak", F.when(F.col("sig").isNull(), 0).otherwise(F.row_number().over(inner))).drop("new", "run")


def visits(df: DataFrame, by: str, order: list[str], url: str) -> DataFrame:
    """How often each row's address and host have been opened up to that row."""
    w = lambda k: Window.partitionBy(by, k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keyed = df.withColumn("norm_url", normalize_url(F.col(url))).withColumn("host", F.lower(F.regexp_extract(url, r"://([^/:?#]+)", 1)))
    return keyed.withColumn("url_visits", F.count("*").over(w("norm_url"))).withColumn("host_visits", F.count("*").over(w("host")))


def retries(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows that repeat an action on a target right after it failed: columns action_type, target, ok."""
    w = Window.partitionBy(by).orderBy(*order)
    same = F.col("action_type").isin(*RETRY_ACTIONS) & (F.lag("action_type").over(w) == F.col("action_type")) & F.lag("target").over(w).eqNullSafe(F.col("target")) & ~F.lag("ok").over(w)
    return df.withColumn("retry", F.coalesce(same, F.lit(False)))


def field_text(label: Column, value: Column, sensitive: Column, required: Column, error: Column) -> Column:
    """A form field as one line of text."""
    shown = F.when(sensitive, F.lit("filled")).when(F.coalesce(value, F.lit("")) == "", "empty").otherwise(F.concat(F.lit('value: "'), value, F.lit('"')))
    return F.concat_ws(" | ", label, shown, F.when(required, "REQUIRED"), F.when(error.isNotNull(), F.concat(F.lit("VALIDATION ERROR: "), error)))


def stitched_frames(frames: DataFrame) -> DataFrame:
    """(frame_id, x, y, depth): frames of any depth with their offset in the top page, from (frame_id, parent_id, dx, dy).

    Each round joins every frame with the chain of the ancestor it has reached, so chains double: the rounds are the
    logarithm of the depth.  Frames without a way to the top (a lost parent, a circle) are left out.
    """
    here = frames.select("frame_id", F.col("parent_id").alias("up"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    most = here.count()
    here, span = cut(here), 1
    while span <= most and here.where("up is not null").limit(1).count():
        above = here.select(F.col("frame_id").alias("a_id"), F.col("up").alias("a_up"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("depth").alias("a_depth"))
        met = here.join(above, F.col("up") == F.col("a_id"), "left").where("up is null or a_id is not null")
        here = cut(met.select("frame_id", F.col("a_up").alias("up"), (F.col("x") + F.coalesce("a_x", F.lit(0))).alias("x"), (F.col("y") + F.coalesce("a_y", F.lit(0))).alias("y"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth")))
        span *= 2
    return here.where("up is null").drop("up")


def placed_frames(frames: DataFrame, reported: DataFrame) -> DataFrame:
    """(parent_id, frame_id, x, y, w, h): where each frame (parent_id, frame_id, ord, url) lies by what its parent reports (parent_id, ord, src, x, y, w, h).

    A frame takes the first report of its address, without query and fragment, that is not taken, else the first that is
    not; one that finds none has no place, and its page is scanned whole.  A page has few frames.
    """
    f = frames.select("parent_id", F.lit(0).alias("side"), "ord", "frame_id", frame_url(F.col("url")).alias("at"), *[F.lit(None).cast("int").alias(c) for c in "xywh"])
    r = reported.select("parent_id", F.lit(1).alias("side"), "ord", F.lit(None).cast("int").alias("frame_id"), frame_url(F.col("src")).alias("at"), *[F.col(c).cast("int").alias(c) for c in "xywh"])

    def place(rows: list[tuple]) -> list[tuple]:
        free = [row for row in rows if row[1] == 1]
        out = []
        for parent, side, _, frame, at, *_ in rows:
            if side == 0:
                best = next((k for k, row in enumerate(free) if at and row[4] == at), 0 if free else None)
                out.append((parent, frame, *(free.pop(best)[5:] if best is not None else (None,) * 4)))
        return out

    return sorted_groups(f.unionByName(r), ["parent_id"], ["side", "ord"], place, "parent_id int, frame_id int, x int, y int, w int, h int")


def frame_nodes(nodes: DataFrame, frame: str, node_id: str) -> DataFrame:
    """The nodes of all frames as one page: ids of other frames than the top one carry their frame, so they are unique."""
    return nodes.withColumn(node_id, F.when(F.col(frame) == 0, F.col(node_id)).otherwise(F.concat(F.lit("f"), F.col(frame).cast("string"), F.lit("_"), F.col(node_id))))


def scroll_rounds(rounds: DataFrame, task: str, order: str, fresh: str, target: int, attempts: int = 15, stagnant: int = 3) -> DataFrame:
    """(task, order, items, stop): the rounds of a scroll collection up to the one that ends it, with the reason.

    It ends when ``target`` items are there, after ``attempts`` rounds, or after ``stagnant`` rounds without a new item.
    """
    w = Window.partitionBy(task).orderBy(order)
    sums = rounds.select(task, order, F.sum(fresh).over(w).alias("items"), F.row_number().over(w).alias("round"), *[F.lag(fresh, i).over(w).alias(f"f{i}") for i in range(1, stagnant)], F.col(fresh).alias("f0"))
    still = (F.col("round") >= stagnant) & (sum([F.coalesce(F.col(f"f{i}"), F.lit(0)) for i in range(stagnant)], F.lit(0)) == 0)
    why = F.when(F.col("items") >= target, "target").when(still, "stagnant").when(F.col("round") >= attempts, "attempts")
    marked = sums.select(task, order, "items", why.alias("stop"))
    ended = F.coalesce(F.sum(F.when(F.col("stop").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("ended", ended).where("ended = 0").drop("ended")


def sanitize_items(items: Column, count: int = 200, length: int = 500, fields: int = 20, name: int = 80) -> Column:
    """Bounded items: array<struct<author,text,timestamp,href,fields map>>, items left without any field dropped."""
    cut = lambda c: F.left(c, F.lit(length))
    clean = F.transform(
        F.slice(items, 1, count),
        lambda i: F.struct(*[cut(i[k]).alias(k) for k in ("author", "text", "timestamp", "href")], F.map_from_entries(F.transform(F.slice(F.filter(F.map_entries(i["fields"]), lambda e: e["key"] != ""), 1, fields), lambda e: F.struct(F.left(e["key"], F.lit(name)).alias("key"), cut(e["value"]).alias("value")))).alias("fields")),
    )
    return F.filter(clean, lambda i: i["author"].isNotNull() | i["text"].isNotNull() | i["timestamp"].isNotNull() | i["href"].isNotNull() | (F.coalesce(F.size(i["fields"]), F.lit(0)) > 0))


def mock_collect(nodes: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """The deterministic stepper: articles, or nodes with address and text, once per address (or text), the first ``cap`` of each task."""
    fresh = nodes.where("node_role = 'article' or (coalesce(href, '') != '' and coalesce(text, '') != '')").withColumn("item", F.coalesce(F.nullif("href", F.lit("")), F.nullif("text", F.lit(""))))
    once = first_wins(fresh.select(key, "item", *order), [key, "item"], order)
    return once.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= cap)
