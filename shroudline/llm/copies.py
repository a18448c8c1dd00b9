"""Records that differ only in formatting: one representative per group and the number of its copies.

A record's canonical form drops white space, punctuation and invisible characters, folds letter case and orders the
fields by name; its digest is the grouping key.  Keys with HOT_ROWS copies or more, whatever the size of the input, are
found exactly from partial counts; their rows are salted into a two-level aggregation, by as many salts as their number
of copies asks for, all others take a one-level shuffle.  The representative is the smallest identifier.

Defined results: identical records are copies too; two records with a null in the same field are equal there, a null
and a blank text too (both are empty once formatting is gone), an absent field and a null field are not; values that
are not one JSON object are no records; nodes without an href are no records; records with a null key cannot be named
and are left out; an empty table gives no rows.  Symbols such as currency signs and digits count as content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.session import cut

#: A key is hot from this many rows on.
HOT_ROWS = 2_000
#: So many hot keys are broadcast at most; more of them meet their rows in a shuffle, which splits its skewed partitions.
MOST_BROADCAST = 1_000_000

_DROP = r"[\p{P}\p{Z}\p{C}\s]+"


def fold_text(c: Column) -> Column:
    """Text without white space, punctuation, invisible characters and letter case (sharp s and final sigma included)."""
    low = F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss"))
    return F.translate(F.regexp_replace(low, _DROP, ""), "ςſ", "σs")


def fold_json(c: Column) -> Column:
    """A JSON object with its fields in order of name and every name and text folded; null if it is not one object.

    The variant type keeps fields ordered.  Once escapes are dropped from its text, every quote is structural, so the
    odd parts between quotes are names and texts and the even parts are structure, numbers and literals.
    """
    parsed = F.try_parse_json(c)
    text = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))
    bare = F.regexp_replace(text, r'\\(u[0-9a-fA-F]{4}|.)', " ")
    parts = F.split(bare, '"', -1)
    folded = F.transform(parts, lambda p, i: F.when(i % 2 == 1, fold_text(p)).otherwise(p))
    return F.array_join(folded, '"')


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """(id, key) of nodes by (href, text)."""
    record = F.concat(fold_text(F.col("href")), F.lit("\u0001"), F.coalesce(fold_text(F.col("text")), F.lit("")))
    return nodes.where(F.col("href").isNotNull() & F.col("node_pk").isNotNull()).select(F.col("node_pk").alias("id"), F.unhex(F.md5(record)).alias("key"))


def keyed_items(items: DataFrame) -> DataFrame:
    """(id, key) of items by the parsed JSON object."""
    return items.where(F.col("item_id").isNotNull()).select(F.col("item_id").alias("id"), F.unhex(F.md5(fold_json(F.col("item_json")))).alias("key")).where("key is not null")


def hot_keys(keyed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, salts) of keys with at least hot_rows rows, counted exactly; marked for broadcast under a checked bound."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows)
    hot = cut(counts.select("key", F.ceil(F.col("n") / hot_rows).alias("salts")))
    return F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot


def _hot_first(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    salted = keyed.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    partial = salted.groupBy("key", "salt").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return partial.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))


def representatives(keyed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, first_id, copies): hot keys by a salted two-level aggregation, the rest by one shuffle."""
    hot = hot_keys(keyed, hot_rows)
    rest = keyed.join(hot, "key", "left_anti").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return _hot_first(keyed, hot).unionByName(rest)


def copy_pairs(keyed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(first_id, copy_id): every row of a group but the smallest, with the smallest.

    Rows of hot keys meet their representative, never each other; no other key has hot_rows rows, so the rest is one
    shuffle with a window over small groups.
    """
    hot = hot_keys(keyed, hot_rows)
    first = _hot_first(keyed, hot).select("key", "first_id")
    hot_pairs = keyed.join(hot, "key", "left_semi").join(first, "key").select("first_id", F.col("id").alias("copy_id"))
    rest = keyed.join(hot, "key", "left_anti").select(F.min("id").over(Window.partitionBy("key")).alias("first_id"), F.col("id").alias("copy_id"))
    return hot_pairs.unionByName(rest).where("first_id < copy_id")
