"""The vault: a bijection between values and placeholders, numbered in first-seen order.

Tables, not maps: found spans carry an order (scope, row, field, place), the vault keeps one row per distinct value of a
scope with its number, label and provenance, and texts are rewritten by joining back.  A scope is a task; numbering is a
window per (scope, type), so scopes spread over all partitions.  The vault holds raw values and stays apart: the catalog
never projects them.

Defined results: rows without a type or value take no number; equal values (after the type's normalisation) share one;
a null scope is a scope of its own.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.operators import rules
from shroudline.operators.groups import sorted_groups
from shroudline.operators.rules import apply_tokens
from shroudline.session import cut


#: Types whose values are compared by their digits only.
DIGIT_TYPES = ("PHONE", "CC", "AADHAAR", "BANK_ACCOUNT", "OTP", "CVV", "PINCODE")


def norm_key(type_: Column, value: Column) -> Column:
    """The form in which two values of a type are one."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.when(type_.isin(*DIGIT_TYPES), F.regexp_replace(value, "[^0-9]", "")).otherwise(plain)


def reserved(texts: DataFrame, text: str, scope: str = "scope") -> DataFrame:
    """(scope, type, top): the highest number of each type that texts of a scope hold as a literal placeholder."""
    held = texts.select(F.col(scope).alias("scope"), F.explode(F.array_distinct(tokens_in(F.col(text)))).alias("t"))
    number = F.regexp_extract("t", r"_(\d{1,9})\]$", 1)
    parts = held.select("scope", F.regexp_extract("t", r"^\[(.*)_\d+\]$", 1).alias("type"), F.when(number != "", number.cast("int")).alias("top"))
    return parts.where("top is not null").groupBy("scope", "type").agg(F.max("top").alias("top"))


def build(found: DataFrame, order: list[str], origin: str | None = None, held: DataFrame | None = None) -> DataFrame:
    """(scope, type, norm_key, n, token, label, value, origin) from found (scope, type, value, *order [, origin]).

    The first value seen gives the raw form; the origin is the first seen, but a prompt's origin gives way once to the
    first page's.  Numbers start above those ``held`` (see reserved), so that no literal placeholder is taken for a value's.
    """
    keyed = found.where("type is not null and value is not null").withColumn("norm_key", norm_key(F.col("type"), F.col("value"))).withColumn("at", F.struct(*order))
    source = F.col(origin) if origin else F.lit(None).cast("string")
    first = keyed.groupBy("scope", "type", "norm_key").agg(
        F.min("at").alias("at"),
        F.min_by("value", "at").alias("value"),
        F.coalesce(F.min_by(F.when(source != "user_prompt", source), F.when(source != "user_prompt", F.col("at"))), F.min_by(source, F.col("at"))).alias("origin"),
    )
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("scope", "type").orderBy("at")))
    if held is not None:
        h = held.select(F.col("scope").alias("h_scope"), F.col("type").alias("h_type"), "top")
        numbered = numbered.join(h, F.col("scope").eqNullSafe(F.col("h_scope")) & (F.col("type") == F.col("h_type")), "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0)))
    token = F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    return numbered.select("scope", "type", "norm_key", "n", token.alias("token"), F.concat_ws("_", "type", F.col("n").cast("string")).alias("label"), "value", "origin")


def labels_only(shown: DataFrame, vault: DataFrame, order: list[str]) -> DataFrame:
    """(scope, type, norm_key, label) of values that are only ever painted over: numbered after the vault's own of their type, never resolvable.

    Values the vault holds keep its label.
    """
    keyed = shown.where("type is not null and value is not null").withColumn("norm_key", norm_key(F.col("type"), F.col("value"))).withColumn("at", F.struct(*order))
    first = keyed.groupBy("scope", "type", "norm_key").agg(F.min("at").alias("at"))
    v = vault.select(F.col("scope").alias("v_scope"), F.col("type").alias("v_type"), F.col("norm_key").alias("v_key"), F.col("label").alias("v_label"))
    known = first.join(v, F.col("scope").eqNullSafe(F.col("v_scope")) & (F.col("type") == F.col("v_type")) & (F.col("norm_key") == F.col("v_key")), "left").drop("v_scope", "v_type", "v_key")
    top = vault.groupBy(F.col("scope").alias("t_scope"), F.col("type").alias("t_type")).agg(F.max("n").alias("top"))
    fresh = known.where("v_label is null").withColumn("k", F.row_number().over(Window.partitionBy("scope", "type").orderBy("at")))
    numbered = fresh.join(top, F.col("scope").eqNullSafe(F.col("t_scope")) & (F.col("type") == F.col("t_type")), "left")
    label = F.concat_ws("_", "type", (F.coalesce("top", F.lit(0)) + F.col("k")).cast("string"))
    return numbered.select("scope", "type", "norm_key", label.alias("label")).unionByName(known.where("v_label is not null").select("scope", "type", "norm_key", F.col("v_label").alias("label")))


def tokenize_outgoing(texts: DataFrame, key: str, scope: str, text: str) -> DataFrame:
    """(key, text) of prompts and the like with tokens for their values; their vault's origin is the user's prompt, which gives way to a page's."""
    rows = texts.select(key, F.col(scope).alias("scope"), F.col(text).alias("body"), F.lit("user_prompt").alias("origin"))
    found = cut(rules.exploded(rows, key, "body", ("scope", "origin")))
    vault = build(found, [key, "ord"], "origin", reserved(rows, "body"))
    return redact(rows, tokenise(found, vault), key, "body").withColumnRenamed("redacted", text)


def catalog(vault: DataFrame) -> DataFrame:
    """What may be shown: no value."""
    return vault.select("scope", "type", "n", "token", "label", "origin")


def tokenise(spans: DataFrame, vault: DataFrame) -> DataFrame:
    """The spans with their tokens."""
    keyed = spans.withColumn("norm_key", norm_key(F.col("type"), F.col("value")))
    v = vault.select(F.col("scope").alias("v_scope"), F.col("type").alias("v_type"), F.col("norm_key").alias("v_key"), "token")
    return keyed.join(v, F.col("scope").eqNullSafe(F.col("v_scope")) & (F.col("type") == F.col("v_type")) & (F.col("norm_key") == F.col("v_key"))).drop("v_scope", "v_type", "v_key", "norm_key")


def redact(texts: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted): each text with the tokens of its spans (key, start, end, token) in place."""
    pieces = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("pieces"))
    joined = texts.select(key, F.col(text).alias("body")).join(pieces, key, "left")
    spliced = apply_tokens(F.col("body"), F.col("pieces"), lambda s: s["token"])
    return joined.select(key, F.coalesce(spliced, F.col("body")).alias("redacted"))


_TOKEN = r"\[[A-Z_]+_\d+\]"


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))


def resolve(texts: DataFrame, vault: DataFrame, key: str, text: str, scope: str = "scope") -> DataFrame:
    """(key, resolved): known placeholders back to values; a join on the tokens a text holds."""
    held = texts.select(key, F.col(scope).alias("t_scope"), F.explode(F.array_distinct(tokens_in(F.col(text)))).alias("t_token"))
    v = vault.select("scope", "token", "value")
    known = held.join(v, F.col("t_scope").eqNullSafe(F.col("scope")) & (F.col("t_token") == F.col("token"))).groupBy(key).agg(F.collect_list(F.struct("token", "value")).alias("pairs"))
    joined = texts.select(key, F.col(text).alias("body")).join(known, key, "left")
    back = F.aggregate("pairs", F.col("body"), lambda acc, p: F.replace(acc, p["token"], p["value"]))
    return joined.select(key, F.coalesce(back, F.col("body")).alias("resolved"))


def scrub_log(hits: DataFrame, element: str) -> DataFrame:
    """Per type: hits and distinct elements."""
    return hits.groupBy("type").agg(F.count("*").alias("hits"), F.countDistinct(element).alias("elements"))


# surrogates: plausible made-up values of the same kind ------------------------------------------------------------
#: Invented names, places and domains surrogates are drawn from.
FIRST = "Asha Ananya Arjun Divya Farhan Gauri Harsh Isha Kabir Kavya Lakshmi Manav Meera Neha Nikhil Pooja Rahul Rohan Sana Tara Uday Varun Yash Zara".split()
LAST = "Bhatt Chauhan Desai Gupta Iyer Joshi Kapoor Kulkarni Malhotra Menon Nair Patel Pillai Rao Reddy Saxena Shetty Sinha Thakur Verma".split()
CITY = "Pune Jaipur Lucknow Nagpur Indore Bhopal Kochi Chandigarh Coimbatore Surat Nashik Guwahati Vadodara Ranchi Mysuru Dehradun Amritsar Bhubaneswar".split()
STATE = ("Maharashtra", "Rajasthan", "Uttar Pradesh", "Karnataka", "Gujarat", "Punjab", "Telangana", "Odisha", "Kerala", "Haryana")
STREET = "Nagar Colony Marg Layout Cross Vihar Enclave Phase Extension Sector".split()
DOMAIN = ("mailbox.example", "inboxmail.in", "netpost.example", "dakmail.example")
SURROGATE_TYPES = ("NAME", "EMAIL", "PHONE", "ADDRESS", "LOCATION")
_M = 0xFFFFFFFF


class _Draws:
    """The stream of numbers in [0, 1) of a 32-bit seed (mulberry32)."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _M

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _M
        x = self.state
        t = ((x ^ x >> 15) * (x | 1)) & _M
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & _M)) & _M
        return ((t ^ t >> 14) & _M) / 4294967296

    def below(self, n: int) -> int:
        return int(self() * n)

    def pick(self, values) -> str:
        return values[self.below(len(values)) % len(values)]

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def seed_of(text: str) -> int:
    """FNV-1a over UTF-16 units in 32 bits."""
    h = 2166136261
    raw = text.encode("utf-16-le", "surrogatepass")
    for unit in memoryview(raw).cast("H"):
        h = ((h ^ unit) * 16777619) & _M
    return h


def surrogate(type_: str, value: str, seed: int | None = None) -> str | None:
    """A made-up value of the type, always the same for the same value (or seed); null for types without a generator."""
    if type_ not in SURROGATE_TYPES:
        return None
    d = _Draws(seed_of(f"{type_}:{value.strip().lower()}") if seed is None else seed)
    if type_ == "NAME":
        return f"{d.pick(FIRST)} {d.pick(LAST)}"
    if type_ == "EMAIL":
        local = f"{d.pick(FIRST)}.{d.pick(LAST)}{d.below(90) + 10}".lower()
        return f"{local}@{d.pick(DOMAIN)}"
    if type_ == "PHONE":
        head, rest = "6789"[d.below(4)], d.digits(9)
        return f"+91 {head}{rest[:4]} {rest[4:]}"
    if type_ == "LOCATION":
        return f"{d.pick(CITY)}, {d.pick(STATE)}"
    house, sector = d.below(900) + 10, d.below(40) + 1
    code = f"{1 + d.below(8)}{d.digits(5)}"
    return f"House No. {house}, {d.pick(STREET)} {sector}, {d.pick(CITY)} {code}"


def surrogates(types: Column, values: Column) -> Column:
    """Surrogate of each value, vectorised; null for types without a generator."""

    @F.pandas_udf("string")
    def run(kinds: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([surrogate(t, v) if t is not None and v is not None else None for t, v in zip(kinds, raw)])

    return run(types, values)


def mint(rows: list[tuple]) -> list[tuple]:
    """One scope's vault rows (scope, type, n, norm_key, value, token) in first-seen order with surrogates; at most 25 tries to avoid a real or taken value, else the token."""
    real, taken, out = {r[4] for r in rows}, set(), []
    for scope, type_, n, key, value, token in rows:
        made = None
        for bump in range(25):
            made = surrogate(type_, value, seed_of(f"{type_}:{type_}:{key}:{bump}"))
            if made is None or made not in real and made not in taken:
                break
            made = None
        taken.add(made or token)
        out.append((scope, type_, n, token, made or token))
    return out


def minted(vault: DataFrame) -> DataFrame:
    """(scope, type, n, token, surrogate); a scope is one task's vault, whose placeholders a task has at hand anyway."""
    slim = vault.select("scope", "type", "n", "norm_key", "value", "token")
    return sorted_groups(slim, ["scope"], ["type", "n"], mint, "scope string, type string, n int, token string, surrogate string")
