"""Redaction of whole records: all fields of a node, values split over neighbours, and what leaves in a request.

Fields are rows, not columns, while they are searched: one pass over (record, field, text) finds all spans, the vault
numbers them in order of record and field, and only records with a span are put together again.

Defined results: a null or empty field stays as it is; a record without spans is untouched; equal values of a scope share
one token over all fields; numbers of types start above literal placeholders of the scope's texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.functions.text import collapse_spaces
from shroudline.operators import policy, rules, scrub, vault
from shroudline.session import cut

#: The fields of a node that are redacted, in order, and those the receiving side repairs.
FIELDS = ("text", "author", "label", "value", "placeholder")
REPAIRED = (*FIELDS, "href")
#: Fixed value: longer texts are no halves of a split value.
SPLIT_LENGTH = 24
#: Fixed value: a vault value of fewer letters and digits is too short to be searched in a request.
LEAST_VALUE = 4


def field_rows(records: DataFrame, key: str, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, at, field, body): one row per field with a text."""
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f).alias("field"), F.col(f).alias("body")) for i, f in enumerate(fields)])
    return records.select(key, *keep, F.explode(each).alias("f")).select(key, *keep, "f.*").where("body != ''")


def field_spans(records: DataFrame, key: str, scope: str, fields: tuple[str, ...] = FIELDS, origin: str | None = None) -> DataFrame:
    """(key, scope, at, field, ord, start, end, type, value, source, weak [, origin]) of all fields, found in one pass."""
    kept = ("scope", *((origin,) if origin else ()))
    rows = field_rows(records.withColumn("scope", F.col(scope)), key, fields, kept)
    found = rows.select(key, *kept, "at", "field", rules.detect(F.col("body")).alias("spans")).where(F.size("spans") > 0)
    return found.select(key, *kept, "at", "field", F.posexplode("spans").alias("ord", "s")).select(key, *kept, "at", "field", "ord", "s.*")


def redact_fields(records: DataFrame, key: str, scope: str, fields: tuple[str, ...] = FIELDS, origin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the records with tokens in their fields, the log (key, field, type, token) of every hit)."""
    spans = cut(field_spans(records, key, scope, fields, origin))  # numbered and joined back: the search runs once
    texts = field_rows(records.withColumn("scope", F.col(scope)), key, fields, ("scope",))
    tokens = vault.tokenise(spans, vault.build(spans, [key, "at", "ord"], origin, vault.reserved(texts, "body")))
    pieces = tokens.groupBy(key, "field").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("pieces"))
    by_record = pieces.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("field", "pieces"))).alias("__tokens"))
    joined = records.join(by_record, F.col(key) == F.col("__key"), "left")
    spliced = {f: F.coalesce(rules.apply_tokens(F.col(f), F.col("__tokens")[f], lambda s: s["token"]), F.col(f)) for f in fields}
    return joined.withColumns(spliced).drop("__key", "__tokens"), tokens.select(key, "field", "type", "token")


def split_spans(left: Column, right: Column) -> Column:
    """array<struct<start,end,type>> of values that only the two texts together show, in characters of their concatenation."""

    @F.pandas_udf("array<struct<start:int,`end`:int,type:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s[0], "end": s[1], "type": s[2]} for s in rules.rule_spans(x + y) if s[0] < len(x) < s[1]] if x and y else [] for x, y in zip(a, b)])

    return run(left, right)


def redact_splits(records: DataFrame, group: list[str], order: list[str], key: str, text: str) -> DataFrame:
    """(key, text) with the halves of values that stand in two short neighbours replaced on both sides.

    Pairs are judged on the texts as they came; a text between two such neighbours gives up both its ends.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    both = records.select(key, F.col(text).alias("t"), F.lead(text).over(w).alias("after"), F.lag(text).over(w).alias("before"))
    short = lambda c: F.coalesce(F.length(c).between(1, SPLIT_LENGTH), F.lit(False))
    found = both.select(
        key, "t",
        split_spans(F.when(short("t") & short("after"), F.col("t")).otherwise(""), F.coalesce("after", F.lit(""))).alias("ahead"),
        split_spans(F.when(short("t") & short("before"), F.col("before")).otherwise(""), F.coalesce("t", F.lit(""))).alias("behind"), F.coalesce(F.length("before"), F.lit(0)).alias("shift"),
    )
    mine = F.concat(
        F.transform("behind", lambda s: F.struct(F.lit(0).alias("start"), (s["end"] - F.col("shift")).cast("int").alias("end"), s["type"].alias("type"))),
        F.transform("ahead", lambda s: F.struct(s["start"].alias("start"), F.length("t").cast("int").alias("end"), s["type"].alias("type"))),
    )
    done = found.select(key, "t", mine.alias("mine"))
    return done.select(key, rules.apply_tokens(F.col("t"), F.col("mine"), rules.coarse_token).alias(text))


def gate(texts: DataFrame, values: DataFrame, key: str, text: str, scope: str = "scope") -> DataFrame:
    """(key, text, fixed): raw vault values of the scope become their tokens, longest first, and high-risk data left becomes coarse tokens.

    ``values`` are (scope, token, value); texts meet the values of their own scope only.
    """
    usable = values.where(F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")) >= LEAST_VALUE).select(F.col("scope").alias("v_scope"), F.col("token").alias("v_token"), F.col("value").alias("v_value"))
    held = texts.select(key, F.col(scope).alias("t_scope"), F.col(text).alias("t"))
    met = held.join(usable, F.col("t_scope").eqNullSafe(F.col("v_scope")) & F.col("t").contains(F.col("v_value")))
    pairs = met.groupBy(F.col(key).alias("m_key")).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.length("v_value").alias("n"), "v_value", "v_token")))).alias("pairs"))
    put = F.aggregate("pairs", F.col("t"), lambda acc, p: F.replace(acc, p["v_value"], p["v_token"]))
    clean = held.join(pairs, F.col(key) == F.col("m_key"), "left").select(key, "t", F.coalesce(put, F.col("t")).alias("s"))
    seen = clean.select(key, "t", "s", rules.detect(F.col("s")).alias("spans"))
    out = F.when(rules.has_residual(F.col("spans")), rules.apply_tokens(F.col("s"), F.col("spans"), rules.coarse_token)).otherwise(F.col("s"))
    return seen.select(key, out.alias(text), (~out.eqNullSafe(F.col("t"))).alias("fixed"))


def check_and_repair(records: DataFrame, key: str, fields: tuple[str, ...] = REPAIRED) -> DataFrame:
    """(key, field, type, hits, repaired): what the receiving side's own scrub still finds, field by field."""
    done = field_rows(records, key, fields).select(key, "field", scrub.scrub(F.col("body")).alias("s")).where(F.size("s.hits") > 0)
    return done.select(key, "field", F.col("s.text").alias("repaired"), F.explode("s.hits").alias("type", "hits"))


def data_types(text: Column, explicit: Column) -> Column:
    """Categories of sensitive data in a text about to be typed: those told, those of its placeholders, and those it holds raw."""
    trimmed = F.trim(text)
    told = F.transform(F.coalesce(explicit, F.array().cast("array<string>")), policy.normalize_category)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"\[([A-Z_]+)_\d+\]"), F.lit(1)), policy.normalize_category)
    raw = [
        F.when(trimmed.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), "EMAIL"), F.when(trimmed.rlike(r"^(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}$"), "PHONE"), F.when(trimmed.rlike(r"^[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]$"), "PAN"),
        F.when(trimmed.rlike(r"(?i)^[A-Za-z0-9][A-Za-z0-9._-]{1,63}@(?:ok)?[A-Za-z]{2,15}$") & ~trimmed.rlike(r"(?i)@(?:gmail|yahoo|outlook|hotmail)\."), "UPI"),
    ]
    checked = _checked(trimmed)
    spans = F.transform(rules.detect(text), lambda s: policy.normalize_category(s["type"]))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array_distinct(told)).otherwise(F.array_distinct(F.concat(told, tokens, F.array_compact(F.array(*raw)), checked, spans)))


def _checked(value: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [name for name, valid in (("AADHAAR", rules.aadhaar), ("CARD", rules.luhn)) if v and valid(v)])

    return run(value)


def rehydrate_action(actions: DataFrame, values: DataFrame, key: str, scope: str, label: str, origin: str, parts: tuple[str, ...] = ("text", "value", "url")) -> DataFrame:
    """(key, decision, *parts, fields): the placeholders of an action resolved in every part, if each of them may go where it is going.

    ``fields`` is array<struct<targetId,label,text>>.  One blocked placeholder blocks the whole action, which keeps its
    placeholders; a placeholder is never released into an address; one the vault does not know blocks too.
    """
    each = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("t"), F.col(label).alias("field_label")) for p in parts])
    of_fields = F.transform(F.coalesce("fields", F.array().cast("array<struct<targetId:string,label:string,text:string>>")), lambda f: F.struct(F.lit("fields").alias("part"), f["text"].alias("t"), f["label"].alias("field_label")))
    rows = actions.select(key, F.col(scope).alias("t_scope"), F.col(origin).alias("t_origin"), F.explode(F.concat(each, of_fields)).alias("p"))
    held = rows.select(key, "t_scope", "t_origin", F.col("p.part").alias("part"), F.col("p.field_label").alias("t_label"), F.explode(F.array_distinct(vault.tokens_in(F.col("p.t")))).alias("t_token"))
    v = values.select("scope", "token", "type", "value", F.col("origin").alias("v_origin"))
    joined = held.join(v, F.col("t_scope").eqNullSafe(F.col("scope")) & (F.col("t_token") == F.col("token")), "left")
    fine = policy.release_ok(F.col("type"), policy.field_category(F.col("t_label")), F.col("v_origin"), F.col("t_origin")) & F.col("token").isNotNull() & (F.col("part") != "url")
    judged = joined.groupBy(F.col(key).alias("j_key")).agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("ok"), F.collect_set(F.when(F.col("token").isNotNull(), F.struct("token", "value"))).alias("pairs"))
    whole = actions.join(judged, F.col(key) == F.col("j_key"), "left")
    put = lambda c: F.when(F.col("ok"), F.aggregate("pairs", c, lambda acc, p: F.replace(acc, p["token"], p["value"]))).otherwise(c)
    decision = F.when(F.coalesce("ok", F.lit(True)), "ALLOW").otherwise("BLOCK")
    return whole.select(key, decision.alias("decision"), *[put(F.col(p)).alias(p) for p in parts], F.transform("fields", lambda f: F.struct(f["targetId"].alias("targetId"), f["label"].alias("label"), put(f["text"]).alias("text"))).alias("fields"))


def squeezed(c: Column) -> Column:
    """Without any white space, as neighbours read one after the other."""
    return F.regexp_replace(collapse_spaces(c), r"\s+", "")


def reconstructed(records: DataFrame, secrets: DataFrame, group: list[str], order: list[str], key: str, text: str) -> DataFrame:
    """(key, secret): neighbours whose texts, read one after the other, spell a secret neither of them holds.

    Secrets are few and checked in size; a pair meets them by its words only, so no table is crossed with another.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    pairs = records.select(key, squeezed(F.col(text)).alias("a"), squeezed(F.lead(text).over(w)).alias("b")).where("a != '' and b != ''")
    few = F.broadcast(secrets.select("secret"))
    met = pairs.join(few, F.concat("a", "b").contains(F.col("secret")) & ~F.col("a").contains(F.col("secret")) & ~F.col("b").contains(F.col("secret")))
    return met.select(key, "secret")
