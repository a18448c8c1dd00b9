"""Queries of the word-level operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.functions import text
from shroudline.operators import language, policy, rules
from shroudline.plans import text as text_plan
from shroudline.sources.tables import table


def known_site(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.when(F.col("msg_id") % 3 == 0, F.concat(F.lit("open GitHub and "), F.col("prompt"))).when(F.col("msg_id") % 3 == 1, F.concat(F.col("prompt"), F.lit(" on Wikipedia"))).otherwise(F.col("prompt"))
    return table(spark, d, "step_messages").where("prompt is not null").select("msg_id", language.known_site(prompt).alias("url"))


#: Links with a mail address in the path of every twentieth.
_LINK = "CASE WHEN node_pk % 20 = 0 THEN concat('https://a.example/u/x', node_pk, '%40mail.example/in?k=1') ELSE href END"


def sanitize_url(spark: SparkSession, d: str) -> DataFrame:
    """Origin and path of each link with personal data in the path replaced, the query only hinted at."""
    rows = table(spark, d, "nodes").where("href is not null").select("node_pk", F.expr(_LINK).alias("href")).withColumn("path", F.coalesce(F.try_url_decode(text.url_path(F.col("href"))), F.lit("")))
    found = rows.withColumn("spans", rules.detect(F.col("path")))
    path = F.when(F.size("spans") > 0, rules.apply_tokens(F.col("path"), F.col("spans"), rules.coarse_token)).otherwise(text.url_path(F.col("href")))
    return found.select("node_pk", F.concat(text.origin(F.col("href")), path, F.when(F.col("href").rlike(r"^[^#]*\?"), "?…").otherwise("")).alias("url"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("text is not null").select("node_pk", language.word_counts(F.col("text")).alias("words"))


def label_runs(spark: SparkSession, d: str) -> DataFrame:
    """Entities merged from labels made of events, ten to a document."""
    e = F.col("event_id")
    label = F.element_at(F.array(*[F.lit(x) for x in ("O", "B-PER", "I-PER", "B-LOC", "I-LOC")]), ((e * e + F.col("user_id")) % 5 + 1).cast("int"))
    tokens = table(spark, d, "events").select(F.floor(e / 10).alias("doc"), e.alias("pos"), F.concat(F.lit("wo"), F.col("user_id").cast("string")).alias("word"), label.alias("label"), (0.5 + (e % 50) / 100).alias("score"))
    return language.decode_labels(tokens, "doc").select("doc", "kind", "start", "end", "value", F.round("score", 6).alias("score"))


def lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_hosts").select("host", language.lookup(F.col("default_lang"), {"de": "Deutsch", "fr": "Français"}, {"en": "English", "de": "German"}).alias("name"))


def action_problems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "step_messages").where("action_json is not null").select("msg_id", language.action_problem(F.try_parse_json("action_json")).alias("problem"))


def transient_errors(spark: SparkSession, d: str) -> DataFrame:
    error = F.coalesce(F.get_json_object("last_action_result", "$.error"), F.when(F.col("msg_id") % 7 == 0, F.lit("No frame with id 3")))
    return table(spark, d, "step_messages").select("msg_id", policy.transient_error(error).alias("transient"))


def fitts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("rect is not null").select("node_pk", language.fitts_ms(F.col("rect.x").cast("double"), F.col("rect.w").cast("double")).alias("ms"), F.round(language.minimum_jerk((F.col("rect.x") % 100) / 100.0), 6).alias("jerk"))


def next_row_meta(spark: SparkSession, d: str) -> DataFrame:
    """The text of the following node of a page as meta of each link."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("frame_id", "pos", "node_pk")
    return table(spark, d, "nodes").withColumn("meta_text", F.lead("text").over(w)).where("node_role = 'link'").select("node_pk", "meta_text")


#: Sub-words of the query below: single letters, and two words that match longer.
_PIECES = {p: i for i, p in enumerate([*"abcdefghijklmnopqrstuvwxyz", *[f"##{x}" for x in "abcdefghijklmnopqrstuvwxyz"], "the", "and"])}


def word_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Sub-words of all texts by longest match."""
    return table(spark, d, "nodes").where("text is not null").select("node_pk", language.piece_counts(F.col("text"), _PIECES).alias("p")).select("node_pk", "p.*")


#: Addresses and titles of the pages of the query below.
_WALL = {"u": "concat('https://', CASE WHEN page_id % 4 = 0 THEN 'x.com' ELSE 'a.example' END, CASE page_id % 7 WHEN 0 THEN '/sign_in?next=1' WHEN 1 THEN '/authors' ELSE '/page' END)", "title": "CASE WHEN page_id % 11 = 0 THEN 'Just a moment...' END", "said": "CASE WHEN node_pk % 40 = 0 THEN 'Log in or sign up' WHEN node_pk % 97 = 0 THEN 'Checking your browser' ELSE text END", "label": "CASE WHEN node_pk % 31 = 0 THEN 'Password' ELSE label END", "src": "CASE WHEN node_pk % 53 = 0 THEN 'https://hcaptcha.example/x' WHEN node_pk % 59 = 0 THEN 'https://g.example/recaptcha/api2/anchor' ELSE src END"}


def login_walls(spark: SparkSession, d: str) -> DataFrame:
    """Pages that ask to sign in or to prove one is human, with addresses, titles and cues put in by number."""
    nodes = table(spark, d, "nodes").select("page_id", "node_role", "placeholder", "rect", *[F.expr(e).alias("text" if n == "said" else n) for n, e in _WALL.items()])
    return policy.page_walls(nodes, "page_id", "u", "title")


def distinct_detection(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses of each node, with each distinct text searched once and joined back."""
    nodes = table(spark, d, "nodes").where("text is not null").select("node_pk", F.xxhash64("text").alias("h"), "text")
    once = nodes.groupBy("h", "text").agg(F.lit(1).alias("one")).select("h", F.col("text").alias("t"), F.size(rules.matched(F.col("text"), (1,))).alias("found"))
    return nodes.join(once.where("found > 0"), (nodes["h"] == once["h"]) & (nodes["text"] == once["t"])).select("node_pk", "found")


QUERIES = {f.__name__: f for f in (known_site, sanitize_url, word_counts, word_pieces, label_runs, lookup, action_problems, transient_errors, fitts, next_row_meta, login_walls, distinct_detection)}
_NEED = " ".join(f"WHEN t IN ({', '.join(repr(k) for k in kinds)}) AND coalesce(json_extract_string(a, '$.{f}'), '') = '' THEN 'needs_{f}'" for f, kinds in language.NEEDS.items())
_SITE_OF = " ".join(f"WHEN '{a}' THEN '{u}'" for a, u in language.KNOWN_SITES.items())
_SITE_ON = " ".join(f"WHEN regexp_matches(low, '\\b(?:on|from|in|at|search|using)\\s+(?:the\\s+)?{a.replace('.', '[.]')}\\b') THEN '{u}'" for a, u in language.KNOWN_SITES.items())
_SITE_TO = r"trim(regexp_extract(low, '\b(?:go to|open|visit|navigate to)\s+([a-z][a-z0-9.\s]{1,20}?)(?:\s+(?:and|,|to|then)\b|[.,!?]|$)', 1))"
_ALONE = r"\p{P}$+<=>^`|~\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
_WHITE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
_ACCOUNT = "(?i)" + rules.RULES[19].pattern.pattern.replace(r"\b(?:a/c", r"(\b(?:a/c").replace("((?:[Xx*]", ")((?:[Xx*]")
_AT = r"lower(regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'))"
_FLAT = text_plan.ORACLE["n6_scan_form"].split("SELECT node_pk, ", 1)[1].split(" AS out FROM", 1)[0]
ORACLE = {
    "distinct_detection": f"SELECT node_pk, CAST(len(regexp_extract_all({_FLAT}, '{rules.RULES[1].pattern.pattern}')) AS INTEGER) AS found FROM nodes WHERE text IS NOT NULL AND regexp_matches({_FLAT}, '{rules.RULES[1].pattern.pattern}')",
    "sanitize_url": f"SELECT node_pk, {_AT} || CASE WHEN node_pk % 20 = 0 THEN '/u/[REDACTED_EMAIL]/in' ELSE regexp_replace(regexp_extract(regexp_replace(h, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^[^?#]*'), '{_ACCOUNT}', '\\1[REDACTED_ID]') END || CASE WHEN regexp_matches(h, '^[^#]*\\?') THEN '?…' ELSE '' END AS url FROM (SELECT node_pk, {_LINK} AS h FROM nodes WHERE href IS NOT NULL)",
    "word_counts": f"SELECT node_pk, CAST(len(regexp_extract_all(text, '[{_ALONE}]|[^{_ALONE}{_WHITE}]+')) AS INTEGER) AS words FROM nodes WHERE text IS NOT NULL",
    "word_pieces": f"SELECT node_pk, CAST(coalesce(list_sum(list_transform(ws, lambda w: CASE WHEN NOT regexp_full_match(w, '[a-z]{{1,100}}') THEN 1 WHEN starts_with(w, 'the') OR starts_with(w, 'and') THEN length(w) - 2 ELSE length(w) END)), 0) AS INTEGER) AS pieces, CAST(len(list_filter(ws, lambda w: NOT regexp_full_match(w, '[a-z]{{1,100}}'))) AS INTEGER) AS unknown FROM (SELECT node_pk, list_transform(regexp_extract_all(text, '[{_ALONE}]|[^{_ALONE}{_WHITE}]+'), lambda x: strip_accents(lower(x))) AS ws FROM nodes WHERE text IS NOT NULL)",
    "known_site": f"SELECT msg_id, CASE WHEN regexp_matches(low, 'https?://') THEN NULL WHEN CASE {_SITE_TO} {_SITE_OF} END IS NOT NULL THEN CASE {_SITE_TO} {_SITE_OF} END {_SITE_ON} END AS url FROM (SELECT msg_id, lower(CASE msg_id % 3 WHEN 0 THEN 'open GitHub and ' || prompt WHEN 1 THEN prompt || ' on Wikipedia' ELSE prompt END) AS low FROM step_messages WHERE prompt IS NOT NULL)",
    "lookup": "SELECT host, CASE default_lang WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' WHEN 'en' THEN 'English' ELSE default_lang END AS name FROM site_hosts",
    "action_problems": f"SELECT msg_id, CASE WHEN NOT coalesce(json_valid(a), false) OR a = '' THEN 'not_an_object' WHEN t IS NULL OR t NOT IN ({', '.join(repr(k) for k in language.ACTIONS)}) THEN 'bad_type' {_NEED} END AS problem FROM (SELECT msg_id, action_json AS a, CASE WHEN json_valid(action_json) THEN json_extract_string(action_json, '$.type') END AS t FROM step_messages WHERE action_json IS NOT NULL)",
    "transient_errors": f"SELECT msg_id, coalesce(regexp_matches(coalesce(CASE WHEN json_valid(last_action_result) THEN json_extract_string(last_action_result, '$.error') END, CASE WHEN msg_id % 7 = 0 THEN 'No frame with id 3' END), '{policy.TRANSIENT}'), false) AS transient FROM step_messages",
    "fitts": "SELECT node_pk, CAST(round(greatest(140, least(700, 150 + 130 * log2(x / greatest(15, w) + 1)))) AS INTEGER) AS ms, round(10 * t ** 3 - 15 * t ** 4 + 6 * t ** 5, 6) AS jerk FROM (SELECT node_pk, rect.x::DOUBLE AS x, rect.w::DOUBLE AS w, (rect.x % 100) / 100.0::DOUBLE AS t FROM nodes WHERE rect IS NOT NULL)",
    "next_row_meta": "SELECT node_pk, meta_text FROM (SELECT node_pk, node_role, lead(text) OVER (PARTITION BY page_id ORDER BY frame_id, pos, node_pk) AS meta_text FROM nodes) WHERE node_role = 'link'",
    "login_walls": f"""WITH n AS (SELECT page_id, node_role, lower(concat_ws(' ', {_WALL['label']}, placeholder)) AS w, rect, coalesce({_WALL['said']}, '') AS t, {_WALL['u']} AS u, {_WALL['title']} AS title, {_WALL['src']} AS src FROM nodes), f AS (SELECT *, node_role IN ('textbox', 'combobox', 'password') AS field, node_role = 'password' OR node_role IN ('textbox', 'combobox', 'password') AND regexp_matches(w, 'password|passwd|pwd') AS secret FROM n)
        SELECT page_id, regexp_matches(max(u), '{policy.LOGIN_URL}') OR contains(max(u), '//x.com/') AND count(*) FILTER (node_role = 'article') = 0 AND count(*) FILTER (regexp_matches(t, '{policy.LOGIN_CTA}')) > 0 OR count(*) FILTER (secret) > 0 AND sum(length(t)) < 1800 AND count(*) FILTER (field AND NOT secret) <= 2 AS login_wall,
        count(*) FILTER (regexp_matches(src, '{policy.CAPTCHA_WIDGET}') AND NOT regexp_matches(src, '{policy.CAPTCHA_HELPER}') AND rect.w > 4 AND rect.h > 4) > 0 OR count(*) FILTER (regexp_matches(t, '{policy.CAPTCHA_TEXT.replace(chr(39), chr(39) * 2)}')) > 0 OR coalesce(regexp_matches(max(title), '{policy.CAPTCHA_TITLE}'), false) AS captcha FROM f GROUP BY page_id""",
    "label_runs": """WITH t AS (SELECT event_id // 10 AS doc, event_id AS pos, 'wo' || user_id AS word, ['O', 'B-PER', 'I-PER', 'B-LOC', 'I-LOC'][(event_id * event_id + user_id) % 5 + 1] AS label, 0.5 + (event_id % 50) / 100 AS score FROM events),
        k AS (SELECT *, regexp_extract(label, '^[BI]-(.+)$', 1) AS kind FROM t), m AS (SELECT *, CASE WHEN kind <> '' AND label[1] <> 'B' AND lag(kind) OVER w = kind AND pos - lag(pos) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY pos) AS run FROM m)
        SELECT doc, kind, min(pos) AS start, max(pos) AS "end", string_agg(word, ' ' ORDER BY pos) AS value, round(avg(score), 6) AS score FROM r WHERE kind <> '' GROUP BY doc, run, kind HAVING avg(score) >= 0.6""",
}
