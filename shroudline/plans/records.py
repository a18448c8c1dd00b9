"""Queries of whole-record redaction, requests, the loop around them and their logs, over records made of table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.operators import collect, redaction, requests
from shroudline.plans.detection import _CARD, _K, _N4, _N5, _SCRUB, _pick
from shroudline.plans.detection import ORACLE as DETECTION
from shroudline.sources.tables import table


def _customers(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    return table(spark, d, "customer").select(_K, *[F.expr(e).alias(name) for name, e in columns.items()])


def _duck(columns: dict[str, str]) -> str:
    return "SELECT c_custkey, " + ", ".join(f'{e} AS "{name}"' for name, e in columns.items()) + " FROM customer"


# redaction of records
_NODE = {
    "scope": f"concat('t', cast({_K} % 10 as string))", "text": _pick(f"concat('mail u', {_K} % 30, '@mail.example today')", "'nothing here'", f"concat('both u', {_K} % 30, '@mail.example and v', {_K} % 40, '@mail.example')"),
    "author": f"concat('v', {_K} % 40, '@mail.example')", "label": "'E-mail'", "value": _pick("''", f"concat('V', {_K} % 40, '@MAIL.example')"), "placeholder": "cast(null as string)",
}


def redact_fields(spark: SparkSession, d: str) -> DataFrame:
    """Five fields of a node with one vault: a mail address has one token over all fields of its scope."""
    done, _ = redaction.redact_fields(_customers(spark, d, **_NODE), _K, "scope")
    return done.select(_K, "text", "author", "label", "value", "placeholder")


def redaction_log(spark: SparkSession, d: str) -> DataFrame:
    """Hits and distinct elements by type and field."""
    _, log = redaction.redact_fields(_customers(spark, d, **_NODE), _K, "scope")
    return log.groupBy("type", "field").agg(F.count("*").alias("hits"), F.countDistinct(_K).alias("elements"))


_HALVES = {"page": f"floor({_K} / 2)", "text": f"CASE WHEN {_K} % 2 = 0 THEN concat('to u', floor({_K} / 2), '@mail') WHEN {_K} % 8 = 7 THEN concat('.example ', repeat('long ', 6)) ELSE '.example now' END"}


def redact_splits(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses split over two short neighbours go from both; a long neighbour is no half."""
    return redaction.redact_splits(_customers(spark, d, **_HALVES), ["page"], [_K], _K, "text")


def reconstructed(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that together spell a secret."""
    secrets = _customers(spark, d, secret=f"concat('tou', floor({_K} / 2), '@mail.example')").where(f"{_K} < 40 and {_K} % 2 = 0").select("secret")
    return redaction.reconstructed(_customers(spark, d, **_HALVES), secrets, ["page"], [_K], _K, "text")


_LEAVING = {"scope": f"cast({_K} % 10 as string)", "text": _pick("concat('ask ', c_name, ' now')", "concat('ask ', c_name, ', mail x@y.example')", "concat(c_name, ' and ', c_name)")}


def egress_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Raw vault values of the task become their tokens, mail addresses left become coarse ones."""
    values = _customers(spark, d, scope=f"cast({_K} % 10 as string)", token=f"concat('[NAME_', {_K}, ']')", value="c_name").where(f"{_K} % 5 < 3")
    return redaction.gate(_customers(spark, d, **_LEAVING), values, _K, "text")


_REPAIR = {
    "id": _K, "text": _pick(f"concat('mail x', {_K}, '@mail.example and y@z.example')", "'fine'", f"concat('id 123-45-', {_N4})"), "author": _pick("'A'", f"concat('ABCPK', {_N4}, 'F')"), "label": "'Field'",
    "value": f"CASE WHEN {_K} % 7 = 0 THEN concat('ring 98765', {_N5}) END", "placeholder": "'you@mail.example'", "href": f"concat('https://x.example/', {_K})",
}


def check_repair(spark: SparkSession, d: str) -> DataFrame:
    """What the receiving side still finds in six fields: hits and elements by type, an element counted once a field."""
    found = redaction.check_and_repair(_customers(spark, d, **_REPAIR), "id")
    return found.groupBy("type").agg(F.sum(F.col("hits").cast("bigint")).alias("hits"), F.count("*").alias("elements"))


def data_types(spark: SparkSession, d: str) -> DataFrame:
    """Categories in a text about to be typed."""
    t = _customers(spark, d, t=_pick(f"concat('u', {_K}, '@mail.example')", f"concat('98765', {_N5})", f"concat('ABCPK', {_N4}, 'F')", f"concat('u', {_K}, '@okaxis')", "'write to [EMAIL_1] or [TEL_2]'", "'plain words'", "'   '", _CARD), told=f"CASE WHEN {_K} % 3 = 0 THEN array('mobile') END")
    return t.select(_K, F.array_join(F.array_sort(redaction.data_types(F.col("t"), F.col("told"))), ",").alias("types"))


def rehydrate_parts(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders in a text, a value, an address and fields: one that may not go blocks all."""
    values = _customers(spark, d, scope=f"cast({_K} as string)", type="'EMAIL'", token="'[EMAIL_1]'", value="concat(lower(c_name), '@mail.example')", origin="'https://a.example'")
    actions = _customers(spark, d, scope=f"cast({_K} as string)", text=_pick("'to [EMAIL_1]'", "'no token'", "'[EMAIL_1] and [EMAIL_9]'", "'x'"), value=_pick("'[EMAIL_1]'", "''"), url=_pick("'https://a.example/'", "'https://a.example/'", "'https://a.example/'", "'https://a.example/?q=[EMAIL_1]'", "'u'"), label="'Your e-mail'", origin=_pick("'https://a.example'", "'https://a.example'", "'https://b.example'"),
                         fields="array(named_struct('targetId', 'n1', 'label', 'E-mail address', 'text', 'cc [EMAIL_1]'))")
    done = redaction.rehydrate_action(actions, values, _K, "scope", "label", "origin")
    return done.select(_K, "decision", "text", "value", "url", F.col("fields")[0]["text"].alias("field"))


# requests
_HOST = "lower(regexp_extract(current_url, '^https?://([^/?#:]+)', 1))"


def site_policy(spark: SparkSession, d: str) -> DataFrame:
    """What each step may send under its site's policy."""
    policies = table(spark, d, "site_hosts").select("host", F.expr("CASE length(host) % 5 WHEN 0 THEN 'local-only' WHEN 1 THEN 'never-screenshot' WHEN 2 THEN 'ask-before-send' WHEN 3 THEN 'none' END").alias("policy")).where("policy is not null")
    steps = table(spark, d, "step_messages").select("msg_id", "send_screenshot", F.expr(_HOST).alias("host"))
    return requests.by_policy(steps, policies, "host", "send_screenshot").select("msg_id", "site_policy", "calls_server", "asks_first", "sends_image")


#: Site patterns of the query below, the first that matches wins.
SITES = ((1, r"(^|\.)my\.", "account"), (2, r"\.test$", "test"), (3, r"press|wiki", "reading"), (4, r"^www\.", "front"))


def site_patterns(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame(list(SITES), "ord int, pattern string, config string")
    return requests.site_of(table(spark, d, "nodes"), patterns, "host")


def term_hits(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that hold user terms, a literal with signs and two patterns."""
    terms = spark.createDataFrame([("lamp", "lantern", False), ("kinds", r"\bgardens?\b", True), ("odd", "a.b", False)], "label string, term string, is_pattern boolean")
    return requests.term_hits(table(spark, d, "nodes").where("text is not null"), terms, "node_pk", "text")


def checked_terms(spark: SparkSession, d: str) -> DataFrame:
    """User terms made of part names, some of them broken or empty."""
    rows = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '(') WHEN 1 THEN ' ' ELSE p_name END").alias("term"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END").alias("label"), (F.col("p_partkey") % 2 == 0).alias("is_pattern"))
    return requests.checked_terms(rows).groupBy("label", "problem").agg(F.count("*").alias("n"))


_DECISIONS = {"token_id": _pick(f"concat('[EMAIL_', {_K}, ']')", "cast(null as string)"), "type": _pick("'tel'", "'EMAIL'", "cast(null as string)"), "origin": "'https://a.example'", "decision": _pick("'ALLOW'", "'BLOCK'", "cast(null as string)", "'USER_DECISION'"),
              "reason": _pick("'All checks passed'", f"concat('no place for x', {_K}, '@mail.example')", f"concat('asked at 98765', {_N5})", "cast(null as string)", f"concat('id 2345 6789 ', {_N4})"), "moment": "c_acctbal"}


def security_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest five hundred decisions whose reason holds no raw data: a bounded list."""
    return requests.security_log(_customers(spark, d, **_DECISIONS), "moment", _K).drop("moment")


def leaking_reasons(spark: SparkSession, d: str) -> DataFrame:
    return requests.leaking_reasons(_customers(spark, d, **_DECISIONS)).select(_K)


def audit_view(spark: SparkSession, d: str) -> DataFrame:
    """The newest two hundred prompts, scrubbed again and cut to the view: a top-k report."""
    log = _customers(spark, d, prompt=_SCRUB, at="c_acctbal")
    return requests.audit_view(log, 200, "at", _K, "prompt").select(_K, "prompt")


def body_cap(spark: SparkSession, d: str) -> DataFrame:
    """Bodies refused by what they declare or by what they are, at a small limit."""
    bodies = table(spark, d, "audit_entries")
    return bodies.select("entry_id", requests.body_status(F.col("body_bytes"), F.col("body"), 4_000).alias("status"))


def step_counters(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "step_messages").where("task_id is not null")
    return requests.counters(steps, "task_id", F.octet_length("prompt").cast("bigint"), F.when(F.col("prompt").contains("["), 1).otherwise(0), F.col("send_screenshot").cast("int"))


def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    payload = requests.prompt_payload({"prompt": c("prompt"), "iteration": c("iteration"), "max_iterations": c("max_iterations"), "current_url": c("current_url"), "screen_state": c("screen_state"), "confidence": F.round(c("screen_state_confidence") * 1000).cast("int"), "image": c("send_screenshot"), "site": c("site_config_id"), "last_result": c("last_action_result")})
    return table(spark, d, "step_messages").select("msg_id", payload.alias("payload"))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the nodes of their step and the items of their task so far."""
    done = requests.assembled(table(spark, d, "step_messages").where("task_id is not null and iteration is not null"), table(spark, d, "nodes").where("task_id is not null"), table(spark, d, "collected_items").where("task_id is not null"))
    return done.select("msg_id", "node_count", "item_count", "screen_state", "confidence")


def toast_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each toast once, in the order in which they came."""
    toasts = F.expr(f"array(concat('saved ', {_K} % 3), 'sent', concat('saved ', {_K} % 2), 'sent', concat('saved ', {_K} % 5))")
    return table(spark, d, "customer").select(_K, F.array_join(F.array_distinct(toasts), "|").alias("toasts"))


# the loop
_EVENTS = ("start", "planned", "seen", "clean", "act", "acted", "seen", "clean", "risky", "approve", "pause", "resume", "acted", "seen", "clean", "finish", "start")


def loop_states(spark: SparkSession, d: str) -> DataFrame:
    """States of tasks made of events, ten seconds apart in the order of their numbers: a task is a user."""
    name = F.element_at(F.array(*[F.lit(e) for e in _EVENTS]), (F.pmod(F.col("event_id"), F.lit(len(_EVENTS))) + 1).cast("int"))
    return requests.loop_states(table(spark, d, "events").select("user_id", "event_id", name.alias("event")), "user_id", ["event_id"], "event")


def confirmations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests, their lines as answers: the first within ten minutes counts."""
    asked = table(spark, d, "orders").select("o_orderkey", F.lit("2026-01-01 00:00:00").cast("timestamp").alias("at")).withColumnRenamed("o_orderkey", "key")
    later = F.timestamp_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp").cast("double") + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 31) % 1300 - 50)
    answers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), later.alias("at"), (F.col("l_suppkey") % 2 == 0).alias("approve"))
    return requests.confirmations(asked, answers, "key", "at")


def rescanned(spark: SparkSession, d: str) -> DataFrame:
    """Texts a host shows at a later step only."""
    return requests.rescanned(table(spark, d, "nodes").where("text is not null and iteration is not null and host is not null").select("host", "iteration", F.lower("node_role").alias("role"), "text"), "host", "iteration", "text").groupBy("host", "iteration").agg(F.count("*").alias("n"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 100).alias("digest"), "ts", "event_id")
    return requests.cache_hits(calls, "kind", "digest", ["ts", "event_id"], F.col("event_id") % 3 > 0)


def tail_reads(spark: SparkSession, d: str) -> DataFrame:
    """What a watcher reads of a log that grows by some and is cut now and then."""
    sizes = table(spark, d, "events").select((F.col("user_id") % 20).alias("file"), "event_id", ((F.col("event_id") % 37) * 100 + F.col("event_id") % 11).alias("size"))
    return requests.tail_reads(sizes, "file", ["event_id"], "size")


def scroll_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of a collection of each user up to the one that ends it."""
    rounds = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 0).otherwise(F.col("event_id") % 4).alias("fresh"))
    return collect.scroll_rounds(rounds, "user_id", "event_id", "fresh", 40)


def frame_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all frames of a page as one page's."""
    return collect.frame_nodes(table(spark, d, "nodes").where("id is not null"), "frame_id", "id").select("node_pk", "id")


QUERIES = {f.__name__: f for f in (
    redact_fields, redaction_log, redact_splits, reconstructed, egress_rewrite, check_repair, data_types, rehydrate_parts, site_policy, site_patterns, term_hits, checked_terms, security_log, leaking_reasons, audit_view, body_cap, step_counters, prompt_payload, assembled, toast_dedupe,
    loop_states, confirmations, rescanned, cache_hits, tail_reads, scroll_rounds, frame_nodes,
)}

_FIRST = f"""WITH n AS ({_duck(_NODE)}), f AS (SELECT c_custkey, scope, 0 AS part, text AS body FROM n UNION ALL SELECT c_custkey, scope, 1, author FROM n UNION ALL SELECT c_custkey, scope, 3, "value" FROM n),
    m AS (SELECT c_custkey, scope, part, generate_subscripts(regexp_extract_all(body, '[A-Za-z]\\d+@[A-Za-z]+\\.example'), 1) AS ord, unnest(regexp_extract_all(body, '[A-Za-z]\\d+@[A-Za-z]+\\.example')) AS raw FROM f),
    v AS (SELECT scope, lower(raw) AS value, row_number() OVER (PARTITION BY scope ORDER BY min((c_custkey, part, ord))) AS k FROM m GROUP BY scope, lower(raw)),
    t AS (SELECT m.*, '[EMAIL_' || k || ']' AS token FROM m JOIN v ON m.scope = v.scope AND lower(m.raw) = v.value)"""
_RAW_SQL = r"(?:\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b)|(?:(?:^|[^A-Za-z0-9_])(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?:$|[^0-9]))|(?:\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b)"
_DUCK_URL = "lower(regexp_extract(current_url, '^https?://([^/?#:]+)', 1))"
ORACLE = {
    "redact_fields": f"""{_FIRST}, x AS (SELECT c_custkey, part, list(raw ORDER BY ord) AS rs, list(token ORDER BY ord) AS ts FROM t GROUP BY 1, 2)
        SELECT n.c_custkey, """ + ", ".join(f'CASE WHEN x{a}.rs IS NULL THEN n."{c}" WHEN len(x{a}.rs) = 1 THEN replace(n."{c}", x{a}.rs[1], x{a}.ts[1]) ELSE replace(replace(n."{c}", x{a}.rs[2], x{a}.ts[2]), x{a}.rs[1], x{a}.ts[1]) END AS "{c}"' for a, c in ((0, "text"), (1, "author"), (3, "value"))) + ", n.label, n.placeholder FROM n " + " ".join(f"LEFT JOIN x x{a} ON x{a}.c_custkey = n.c_custkey AND x{a}.part = {a}" for a in (0, 1, 3)),
    "redaction_log": f"{_FIRST} SELECT 'EMAIL' AS type, CASE part WHEN 0 THEN 'text' WHEN 1 THEN 'author' ELSE 'value' END AS field, count(*) AS hits, count(DISTINCT c_custkey) AS elements FROM t GROUP BY part",
    "redact_splits": f"""WITH h AS (SELECT c_custkey, c_custkey // 2 AS page, {_HALVES['text'].replace('floor(', '(').replace(' / 2)', ' // 2)')} AS text FROM customer), b AS (SELECT *, lead(text) OVER w AS after, lag(text) OVER w AS before FROM h WINDOW w AS (PARTITION BY page ORDER BY c_custkey))
        SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND length(after) <= 24 THEN 'to [REDACTED_EMAIL]' WHEN c_custkey % 2 = 1 AND length(text) <= 24 AND before IS NOT NULL THEN '[REDACTED_EMAIL] now' ELSE text END AS text FROM b""",
    "reconstructed": "SELECT c_custkey, 'tou' || (c_custkey // 2) || '@mail.example' AS secret FROM customer WHERE c_custkey < 40 AND c_custkey % 2 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)",
    "egress_rewrite": f"""WITH t AS ({_duck(_LEAVING).replace('SELECT c_custkey,', 'SELECT c_custkey, c_name,')}), s AS (SELECT c_custkey, text AS t, CASE WHEN c_custkey % 5 < 3 THEN replace(text, c_name, '[NAME_' || c_custkey || ']') ELSE text END AS s FROM t)
        SELECT c_custkey, replace(s, 'x@y.example', '[REDACTED_EMAIL]') AS text, replace(s, 'x@y.example', '[REDACTED_EMAIL]') <> t AS fixed FROM s""",
    "check_repair": """SELECT type, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS elements FROM (SELECT 'EMAIL' AS type, 2 AS hits FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'EMAIL', 1 FROM customer UNION ALL SELECT 'SSN', 1 FROM customer WHERE c_custkey % 3 = 2
        UNION ALL SELECT 'PAN', 1 FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'PHONE', 1 FROM customer WHERE c_custkey % 7 = 0) GROUP BY type""",
    "data_types": f"""WITH t AS (SELECT c_custkey, c_custkey % 8 AS k, {_CARD} AS d FROM customer), l AS (SELECT *, list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[16 - i] AS INTEGER) ELSE (2 * CAST(d[16 - i] AS INTEGER)) % 10 + (2 * CAST(d[16 - i] AS INTEGER)) // 10 END)) % 10 = 0 AS luhn FROM t)
        SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'PHONE' END, CASE k WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'PAN' WHEN 3 THEN 'UPI' WHEN 4 THEN 'EMAIL' END, CASE WHEN k = 4 THEN 'PHONE' END, CASE WHEN k = 7 AND luhn THEN 'CARD' END], lambda x: x IS NOT NULL))), ',') AS types FROM l""",
    "rehydrate_parts": """WITH a AS (SELECT c_custkey, c_custkey % 3 <> 2 AND c_custkey % 4 <> 2 AND c_custkey % 5 <> 3 AS ok, lower(c_name) || '@mail.example' AS v, CASE c_custkey % 4 WHEN 0 THEN 'to [EMAIL_1]' WHEN 1 THEN 'no token' WHEN 2 THEN '[EMAIL_1] and [EMAIL_9]' ELSE 'x' END AS text, CASE WHEN c_custkey % 2 = 0 THEN '[EMAIL_1]' ELSE '' END AS "value",
        CASE WHEN c_custkey % 5 < 3 THEN 'https://a.example/' WHEN c_custkey % 5 = 3 THEN 'https://a.example/?q=[EMAIL_1]' ELSE 'u' END AS url FROM customer)
        SELECT c_custkey, CASE WHEN ok THEN 'ALLOW' ELSE 'BLOCK' END AS decision, CASE WHEN ok THEN replace(text, '[EMAIL_1]', v) ELSE text END AS text, CASE WHEN ok THEN replace("value", '[EMAIL_1]', v) ELSE "value" END AS "value", url, CASE WHEN ok THEN 'cc ' || v ELSE 'cc [EMAIL_1]' END AS field FROM a""",
    "site_policy": f"""WITH p AS (SELECT host, CASE length(host) % 5 WHEN 0 THEN 'local-only' WHEN 1 THEN 'never-screenshot' WHEN 2 THEN 'ask-before-send' WHEN 3 THEN 'none' END AS policy FROM site_hosts),
        s AS (SELECT msg_id, coalesce(send_screenshot, false) AS shot, coalesce(policy, 'none') AS site_policy FROM step_messages m LEFT JOIN p ON p.host = {_DUCK_URL})
        SELECT msg_id, site_policy, site_policy <> 'local-only' AS calls_server, site_policy = 'ask-before-send' AS asks_first, shot AND site_policy NOT IN ('never-screenshot', 'local-only') AS sends_image FROM s""",
    "site_patterns": "SELECT host, CASE " + " ".join(f"WHEN regexp_matches(host, '{p}') THEN '{c}'" for _, p, c in SITES) + " ELSE 'generic' END AS config FROM (SELECT DISTINCT host FROM nodes WHERE host IS NOT NULL)",
    "term_hits": r"SELECT node_pk, 'lamp' AS label FROM nodes WHERE contains(lower(text), 'lantern') UNION ALL SELECT node_pk, 'kinds' FROM nodes WHERE regexp_matches(text, '(?i)\bgardens?\b') UNION ALL SELECT node_pk, 'odd' FROM nodes WHERE contains(lower(text), 'a.b')",
    "checked_terms": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'CUSTOM' ELSE p_brand END AS label, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'no pattern' END WHEN 1 THEN 'empty' END AS problem, count(*) AS n FROM part GROUP BY 1, 2",
    "security_log": f"""SELECT * EXCLUDE (moment) FROM (SELECT c_custkey, coalesce(token_id, 'unknown') AS token_id, coalesce(CASE type WHEN 'tel' THEN 'PHONE' ELSE upper(type) END, 'UNKNOWN') AS type, origin, coalesce(decision, 'BLOCK') AS decision, coalesce(reason, '') AS reason, moment
        FROM ({_duck(_DECISIONS)}) WHERE NOT coalesce(regexp_matches(reason, '{_RAW_SQL}'), false) ORDER BY moment DESC, c_custkey DESC LIMIT 500)""",
    "leaking_reasons": f"SELECT c_custkey FROM ({_duck(_DECISIONS)}) WHERE regexp_matches(reason, '{_RAW_SQL}')",
    "audit_view": f"SELECT c_custkey, left(scrubbed, 160) AS prompt FROM ({DETECTION['scrub_chain']}) JOIN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200) USING (c_custkey)",
    "body_cap": "SELECT entry_id, CASE WHEN coalesce(body_bytes > 4000, false) THEN 'refused by header' WHEN coalesce(octet_length(encode(body)) > 4000, false) THEN 'refused by size' ELSE 'taken' END AS status FROM audit_entries",
    "step_counters": "SELECT task_id, coalesce(CAST(sum(octet_length(encode(prompt))) AS BIGINT), 0) AS bytes_sent, CAST(count(*) FILTER (contains(prompt, '[')) AS BIGINT) AS fixes, CAST(count(*) FILTER (send_screenshot) AS BIGINT) AS boxes, count(*) AS steps FROM step_messages WHERE task_id IS NOT NULL GROUP BY task_id",
    "prompt_payload": r"""SELECT msg_id, CAST(to_json({task: prompt, iteration: iteration, maxIterations: max_iterations, targetCountHint: CAST(coalesce(least(50, TRY_CAST(coalesce(nullif(regexp_extract(coalesce(prompt, ''), '(?i)\btop\s+(\d{1,3})\b', 1), ''), nullif(regexp_extract(coalesce(prompt, ''), '(?i)\b(\d{1,3})\s+(?:posts|items|results|articles|tweets|links|stories)\b', 1), '')) AS INTEGER)), 0) AS INTEGER),
        currentUrl: current_url, screenState: screen_state, screenStateConfidence: CAST(round(screen_state_confidence * 1000) AS INTEGER), screenshotAttached: send_screenshot, site: site_config_id, lastActionResult: last_action_result}) AS VARCHAR) AS payload FROM step_messages""",
    "assembled": """WITH n AS (SELECT task_id, iteration, count(*) AS c FROM nodes WHERE task_id IS NOT NULL GROUP BY ALL), i AS (SELECT task_id, iteration, count(*) AS c FROM collected_items WHERE task_id IS NOT NULL GROUP BY ALL),
        k AS (SELECT t.task_id, t.iteration, CAST(sum(coalesce(i.c, 0)) OVER (PARTITION BY t.task_id ORDER BY t.iteration) AS BIGINT) AS items FROM (SELECT DISTINCT task_id, iteration FROM step_messages WHERE task_id IS NOT NULL AND iteration IS NOT NULL) t LEFT JOIN i USING (task_id, iteration))
        SELECT msg_id, coalesce(n.c, 0) AS node_count, k.items AS item_count, coalesce(screen_state, 'unknown') AS screen_state, coalesce(screen_state_confidence, 0.0) AS confidence FROM step_messages s JOIN k USING (task_id, iteration) LEFT JOIN n USING (task_id, iteration)""",
    "toast_dedupe": "SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS toasts FROM (SELECT c_custkey, ['saved ' || (c_custkey % 3), 'sent', 'saved ' || (c_custkey % 2), 'sent', 'saved ' || (c_custkey % 5)] AS l FROM customer)",
    "confirmations": """WITH a AS (SELECT l_orderkey AS key, (l_partkey * 7 + l_linenumber * 31) % 1300 - 50 AS s, l_suppkey % 2 = 0 AS approve FROM lineitem)
        SELECT o_orderkey AS key, CASE (SELECT min_by(approve, (s, approve)) FROM a WHERE a.key = o_orderkey AND s BETWEEN 0 AND 600) WHEN true THEN 'approve' WHEN false THEN 'deny' ELSE 'timeout' END AS decision FROM orders""",
    "rescanned": "SELECT host, iteration, count(*) AS n FROM (SELECT host, text, min(iteration) AS iteration FROM nodes WHERE text IS NOT NULL AND iteration IS NOT NULL AND host IS NOT NULL GROUP BY 1, 2) JOIN (SELECT host, min(iteration) AS first FROM nodes WHERE text IS NOT NULL AND iteration IS NOT NULL GROUP BY 1) USING (host) WHERE iteration > first GROUP BY 1, 2",
    "cache_hits": "SELECT kind, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT event_type AS kind, coalesce(max(CASE WHEN event_id % 3 > 0 THEN 1 END) OVER (PARTITION BY event_type, user_id % 100 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM events) GROUP BY kind",
    "tail_reads": 'SELECT file, event_id, CASE WHEN size < before THEN 0 ELSE before END AS start, size AS stop, size < before AS truncated FROM (SELECT *, coalesce(lag(size) OVER (PARTITION BY file ORDER BY event_id), 0) AS before FROM (SELECT user_id % 20 AS file, event_id, (event_id % 37) * 100 + event_id % 11 AS size FROM events))',
    "scroll_rounds": """WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE event_id % 4 END AS fresh FROM events), s AS (SELECT *, CAST(sum(fresh) OVER w AS BIGINT) AS items, row_number() OVER w AS k, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS last3 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        m AS (SELECT *, CASE WHEN items >= 40 THEN 'target' WHEN k >= 3 AND last3 = 0 THEN 'stagnant' WHEN k >= 15 THEN 'attempts' END AS stop FROM s), f AS (SELECT user_id, min(k) AS k_end FROM m WHERE stop IS NOT NULL GROUP BY 1)
        SELECT user_id, event_id, items, stop FROM m LEFT JOIN f USING (user_id) WHERE k <= coalesce(k_end, k)""",
    "frame_nodes": "SELECT node_pk, CASE WHEN frame_id = 0 THEN id ELSE 'f' || frame_id || '_' || id END AS id FROM nodes WHERE id IS NOT NULL",
}
