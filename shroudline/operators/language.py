"""Word-level operators: tokenizer with offsets, decoding of word labels, aliases, lookups, action validation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of sites a prompt may use, in order of precedence, and their addresses.
KNOWN_SITES = {
    "chatgpt": "https://chatgpt.com", "chat gpt": "https://chatgpt.com", "google": "https://www.google.com", "youtube": "https://www.youtube.com", "gmail": "https://mail.google.com", "github": "https://github.com", "amazon": "https://www.amazon.com",
    "wikipedia": "https://en.wikipedia.org", "reddit": "https://www.reddit.com", "twitter": "https://x.com", "x.com": "https://x.com", "linkedin": "https://www.linkedin.com", "facebook": "https://www.facebook.com", "instagram": "https://www.instagram.com",
    "hacker news": "https://news.ycombinator.com", "hackernews": "https://news.ycombinator.com", "google maps": "https://maps.google.com",
}
#: The actions an agent may take, and the fields each needs.
ACTIONS = ("click", "scroll", "type", "wait", "extract", "navigate", "open_tab", "switch_tab", "back", "select", "check", "hover", "press_key", "fill_form", "remember", "note", "save_image", "compile_report")
NEEDS = {"targetId": ("click", "type", "select", "check", "remember", "save_image"), "url": ("navigate", "open_tab"), "key": ("press_key",), "fields": ("fill_form",), "text": ("remember", "note", "compile_report")}


def known_site(text: Column) -> Column:
    """Address of the site a prompt names; null if it gives an address itself or names none."""
    low = F.lower(text)
    named = F.trim(F.regexp_extract(low, r"\b(?:go to|open|visit|navigate to)\s+([a-z][a-z0-9.\s]{1,20}?)(?:\s+(?:and|,|to|then)\b|[.,!?]|$)", 1))
    table = F.create_map(*[F.lit(x) for pair in KNOWN_SITES.items() for x in pair])
    out = F.when(low.rlike("https?://"), F.lit(None).cast("string")).when(table[named].isNotNull(), table[named])
    for alias, url in KNOWN_SITES.items():
        out = out.when(low.rlike(rf"\b(?:on|from|in|at|search|using)\s+(?:the\s+)?{re.escape(alias)}\b"), url)
    return out


def _piece_breaks(ch: str) -> bool:
    code = ord(ch)
    return unicodedata.category(ch)[0] == "P" or ch in "$+<=>^`|~" or 0x4E00 <= code <= 0x9FFF or 0x3400 <= code <= 0x4DBF or 0xF900 <= code <= 0xFAFF


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words without accents and their places in the text; punctuation and ideographs stand alone."""
    out: list[tuple[str, int, int]] = []
    word, start = "", 0
    for i, ch in enumerate(text + " "):
        if ch.isspace() or _piece_breaks(ch):
            if word:
                out.append((word, start, i))
                word = ""
            if not ch.isspace():
                out.append((ch, i, i + 1))
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(c) != "Mn")
        if not word:
            start = i
        word += plain
    return out


def pieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100, limit: int = 512) -> list[tuple[str, int, int]]:
    """Greedy longest-match sub-words with places; words over ``longest`` characters, or without a match, are unknown."""
    out: list[tuple[str, int, int]] = []
    for word, start, end in words(text):
        found, at = [], 0
        while at < len(word) and len(word) <= longest:
            stop = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), 0)
            if not stop:
                found = []
                break
            found.append((("##" if at else "") + word[at:stop], start + at, min(end, start + stop)))
            at = stop
        out += found or [(unknown, start, end)]
    return out[:limit]


def piece_counts(c: Column, vocabulary: dict[str, int], unknown: str = "[UNK]") -> Column:
    """struct(pieces, unknown): how many sub-words a text has under a small vocabulary, and how many words have none; whole texts."""

    @F.pandas_udf("struct<pieces:int,unknown:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [[p for p, _, _ in pieces(t, vocabulary, unknown, limit=len(t) + 1)] if t is not None else [] for t in texts]
        return pd.DataFrame({"pieces": [len(f) for f in found], "unknown": [f.count(unknown) for f in found]}, dtype="int32")

    return run(c)


def word_counts(c: Column) -> Column:
    """Number of tokenizer words, vectorised."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(words(t))).astype("Int32")

    return run(c)


#: Single words of pages and calendars that are no people and no places.
STOP = frozenset(
    "aadhaar aadhar adhaar pan upi ifsc gstin otp kyc email e-mail mobile phone name address dob account accounts customer login logout signin signup register profile home dashboard settings submit cancel search menu help support payments "
    "india bharat usa uk china japan europe asia africa america earth moon mars isro nasa pslv gslv chandrayaan gaganyaan monday tuesday wednesday thursday friday saturday sunday january february march april may june july august "
    "september october november december today yesterday tomorrow inbox sent drafts spam trash".split()
)


def decode_subwords(tokens: DataFrame, doc: str, least: float = 0.6) -> DataFrame:
    """Entities from sub-word labels (doc, pos, sub, word, label, score): a word has the label of its first sub-word; single stop words are none."""
    first = tokens.where("label is not null").groupBy(doc, "pos").agg(F.min_by("word", "sub").alias("word"), F.min_by("label", "sub").alias("label"), F.min_by("score", "sub").alias("score"))
    bare = F.regexp_replace(F.lower("value"), r"[^\p{L}-]", "")
    return decode_labels(first, doc, least).where(F.col("value").contains(" ") | ~bare.isin(*sorted(STOP)))


def decode_labels(tokens: DataFrame, doc: str, least: float = 0.6) -> DataFrame:
    """Entities from word labels (doc, pos, word, label, score): B-/I- runs merged (gaps and islands), mean score at least ``least``, two letters together."""
    w = Window.partitionBy(doc).orderBy("pos")
    kind = F.regexp_extract("label", r"^[BI]-(.+)$", 1)
    marked = tokens.withColumn("kind", kind).withColumn("last", F.lag("kind").over(w)).withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    fresh = F.when((F.col("kind") != "") & ~F.col("label").startswith("B-") & (F.col("last") == F.col("kind")) & (F.col("gap") == 1), 0).otherwise(1)
    runs = marked.withColumn("run", F.sum(fresh).over(w)).where("kind != ''")
    merged = runs.groupBy(doc, "run", "kind").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.avg("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("value"))
    return merged.where((F.col("score") >= least) & F.col("value").rlike(r"\p{L}{2}")).drop("run")


def lookup(key: Column, table: dict[str, str], fallback: dict[str, str]) -> Column:
    """Text of a key, from the fallback table where it is missing, else the key."""
    as_map = lambda t: F.create_map(*[F.lit(x) for p in t.items() for x in p]) if t else F.create_map(F.lit(""), F.lit(None).cast("string"))
    return F.coalesce(as_map(table)[key], as_map(fallback)[key], key)


def action_problem(action: Column) -> Column:
    """What makes an action invalid (a variant column); null if it is valid."""
    get = lambda k: F.try_variant_get(action, f"$.{k}", "string")
    kind = get("type")
    out = F.when(action.isNull(), "not_an_object").when(kind.isNull() | ~kind.isin(*ACTIONS), "bad_type")
    for field, kinds in NEEDS.items():
        out = out.when(kind.isin(*kinds) & (F.coalesce(get(field), F.lit("")) == ""), f"needs_{field}")
    return out


def _given(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit("")) != ""


#: Fixed value: the most sub-tasks of a plan.
SUBTASKS = 5


def plan_problem(plan: Column) -> Column:
    """Why a plan (a variant) cannot be used: one to five sub-tasks with an id and a goal; null if it can."""
    steps = F.try_variant_get(plan, "$.subtasks", "array<variant>")
    whole = F.forall(steps, lambda s: _given(s, "$.id") & _given(s, "$.goal"))
    return F.when(plan.isNull() | ~F.coalesce(F.schema_of_variant(plan).startswith("OBJECT"), F.lit(False)), "not_an_object").when(~F.coalesce(F.size(steps).between(1, SUBTASKS), F.lit(False)), "bad_subtasks").when(~F.coalesce(whole, F.lit(False)), "subtask_needs_id_and_goal")


def answer_problem(answer: Column) -> Column:
    """Why an answer (a variant) cannot be used; null if it can."""
    return F.when(answer.isNull() | ~F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False)), "not_an_object").when(~_given(answer, "$.answer"), "needs_answer")


def fitts_ms(distance: Column, width: Column) -> Column:
    """Duration of a movement in milliseconds, between 140 and 700."""
    raw = 150 + 130 * F.log2(distance / F.greatest(F.lit(15.0), width) + 1)
    return F.round(F.greatest(F.lit(140.0), F.least(F.lit(700.0), raw))).cast("int")


def minimum_jerk(t: Column) -> Column:
    return 10 * t * t * t - 15 * t * t * t * t + 6 * t * t * t * t * t


def split_redaction(pdf: pd.DataFrame, detect) -> pd.DataFrame:
    """Neighbouring short texts of one page in order (pos, text): a value split over two gets one token in both; a text changed as the second is read changed as the first."""
    texts = pdf.sort_values("pos", kind="stable")["text"].tolist()
    n = 0
    for i in range(len(texts) - 1):
        a, b = texts[i] or "", texts[i + 1] or ""
        if not a or not b or len(a) > 24 or len(b) > 24:
            continue
        for s in reversed(detect(a + b)):
            if s[0] < len(a) < s[1]:
                n += 1
                token = f"[{s[2]}_{n}]"
                texts[i], texts[i + 1] = a[: s[0]] + token, token + b[s[1] - len(a) :]
                break
    return pdf.sort_values("pos", kind="stable").assign(text=texts)
