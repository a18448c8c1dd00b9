"""The server's own scrub: ordered replacements over every text that arrives, with counts.

Each step sees the placeholders of the steps before.  Four steps are unconditional and run as native expressions; the
whole chain, whose other steps check a number, is one vectorised function.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.functions import json_text
from shroudline.operators.rules import luhn, verhoeff

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# The patterns of the scrub, in its order.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"(?:\d[ -]?){13,19}"
AADHAAR = r"[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}"
PAN = r"[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]"
UPI = r"[A-Za-z0-9][A-Za-z0-9._-]{1,63}@(?:ok)?[A-Za-z]{2,15}"
IN_MOBILE = r"(?<![\w+\[])(?:\+91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
PHONE = r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{2,4}(?:[\s.\-]?\d{2,4}){1,3}"
TOKENS = {k: f"[REDACTED_{k}]" for k in ("EMAIL", "SSN", "CC", "AADHAAR", "PAN", "UPI", "PHONE")}


def simple_scrub(c: Column) -> Column:
    """The unconditional steps as native expressions: mail, social security, PAN."""
    out = F.regexp_replace(c, _B + EMAIL + _E, TOKENS["EMAIL"])
    out = F.regexp_replace(out, _B + SSN + _E, TOKENS["SSN"])
    return F.regexp_replace(out, _B + PAN + _E, TOKENS["PAN"])


def _phone_like(v: str) -> bool:
    n = sum("0" <= x <= "9" for x in v)
    return 10 <= n <= 15 and re.search(r"[+()\-]", v) is not None and re.fullmatch(r"\d{4}-\d{2}-\d{2}.*", v) is None


STEPS = (
    ("EMAIL", re.compile(rf"\b{EMAIL}\b"), None),
    ("SSN", re.compile(rf"\b{SSN}\b"), None),
    ("CC", re.compile(rf"\b{CARD}\b"), luhn),
    ("AADHAAR", re.compile(rf"\b{AADHAAR}\b"), verhoeff),
    ("PAN", re.compile(rf"\b{PAN}\b"), None),
    ("UPI", re.compile(rf"\b{UPI}\b(?![.@-]\w)"), lambda v: re.search(r"@(gmail|yahoo|outlook|hotmail)$", v, re.I) is None),
    ("PHONE", re.compile(IN_MOBILE), None),
    ("PHONE", re.compile(PHONE), _phone_like),
)


def scrub_text(text: str | None) -> tuple[str | None, Counter]:
    """(the text with placeholders, hits by type)."""
    hits: Counter = Counter()
    if not text:
        return text, hits
    for kind, pattern, valid in STEPS:

        def put(m: re.Match, kind=kind, valid=valid) -> str:
            if valid is not None and not valid(m.group(0)):
                return m.group(0)
            hits[kind] += 1
            return TOKENS[kind]

        text = pattern.sub(put, text)
    return text, hits


def scrub(c: Column) -> Column:
    """struct(text, hits) of a text column, vectorised."""

    @F.pandas_udf("struct<text:string,hits:map<string,int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [scrub_text(t) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "hits": [dict(d[1]) for d in done]})

    return run(c)


def scrub_tree(value, skip: frozenset = frozenset({"redactedScreenshot"}), hits: Counter | None = None):
    """The same over every text of a JSON value of any depth but those under a skipped key."""

    def change(text: str) -> str:
        out, found = scrub_text(text)
        if hits is not None:
            hits.update(found)
        return out

    return json_text.map_texts(value, change, skip)


def scrub_bodies(bodies: DataFrame, key: str = "entry_id", body: str = "body") -> DataFrame:
    """(key, type, hits) of every JSON body with hits; unreadable bodies are scrubbed as plain text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, types, counts = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits: Counter = Counter()
                try:
                    scrub_tree(json_text.read(text), hits=hits)
                except ValueError:
                    hits.update(scrub_text(text)[1])
                for kind, n in sorted(hits.items()):
                    keys.append(k)
                    types.append(kind)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(types, pa.string()), pa.array(counts, pa.int64())], names=["key", "type", "hits"])

    return bodies.where(F.col(body).isNotNull()).select(F.col(key).cast("bigint"), body).mapInArrow(run, "key bigint, type string, hits bigint").withColumnRenamed("key", key)


def leak_rate(requests: int | Column, caught: Column) -> Column:
    """Caught texts per request, four places; no requests count as one."""
    return F.round(caught / F.greatest(F.lit(1), requests if isinstance(requests, Column) else F.lit(requests)), 4)
