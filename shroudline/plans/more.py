"""Queries of roles, labels, tokens of prompts, sub-word labels, reports, bundles and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroudline.operators import collect, egress, language, policy, requests, vault
from shroudline.plans.detection import _K, _N4, _pick
from shroudline.plans.records import _EVENTS, _customers
from shroudline.sources import logs
from shroudline.sources.tables import table

_TAGS = {
    "tag": _pick("'A'", "'input'", "'div'", "'h2'", "'select'", "'span'", "'IMG'", "'p'"), "type": _pick("'submit'", "'email'", "'checkbox'", "cast(null as string)", "'RANGE'"), "role": _pick("cast(null as string)", "''", "'tab'", "cast(null as string)", "'note'", "cast(null as string)", "''"),
    "editable": f"{_K} % 9 = 0", "classes": _pick("'box'", "'my-Toast x'", "cast(null as string)", "'field-error'"), "handler": f"{_K} % 13 = 0", "tab_index": _pick("-1", "0", "cast(null as int)"),
}


def element_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of made-up elements and whether a person can act on them."""
    e = _customers(spark, d, **_TAGS)
    c = F.col
    return e.select(_K, policy.element_role(c("tag"), c("type"), c("role"), c("editable"), c("classes")).alias("inferred"), policy.interactive(c("tag"), c("role"), c("editable"), c("handler"), c("tab_index")).alias("interactive"))


def _paid(spark: SparkSession, d: str) -> DataFrame:
    cards = _customers(spark, d, scope=f"cast({_K} % 10 as string)", type="'CC'", value=f"concat('4000 ', {_K} % 40)", origin="'https://a.example'")
    return vault.build(cards.where(f"{_K} % 2 = 0"), [_K], "origin")


def label_only(spark: SparkSession, d: str) -> DataFrame:
    """Values that are only painted over: numbered after the vault's, which keep their own."""
    shown = _customers(spark, d, scope=f"cast({_K} % 10 as string)", type="'CC'", value=f"concat('4000', {_K} % 40)")
    return vault.labels_only(shown, _paid(spark, d), [_K])


def tokenized_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with tokens, one vault for each task of ten customers."""
    prompts = _customers(spark, d, scope=f"cast(floor({_K} / 10) as string)", prompt=_pick(f"concat('write to u', {_K} % 3, '@mail.example')", f"concat('PAN ABCPK', {_N4}, 'F')", "'nothing'"))
    return vault.tokenize_outgoing(prompts, _K, "scope", "prompt")


def subword_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of order lines as sub-words: the first sub-word's label counts, single stop words are none."""
    word = F.when(F.col("l_suppkey") % 5 == 0, "Monday").otherwise(F.concat(F.lit("wo"), F.col("l_suppkey") % 7))
    label = F.element_at(F.array(*[F.lit(x) for x in ("O", "B-PER", "I-PER", "B-LOC")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    tokens = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.floor(F.col("l_linenumber") / 2).alias("pos"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("sub"), word.alias("word"), label.alias("label"), F.lit(0.9).alias("score"))
    return language.decode_subwords(tokens, "doc").select("doc", "kind", "start", "end", "value")


def recent_ring(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty messages by arrival: a bounded list."""
    return logs.recent(table(spark, d, "step_messages").where("received_at is not null").select("msg_id", "received_at"), "received_at", "msg_id").select("msg_id")


def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A report for each part."""
    notes = F.expr("CASE p_partkey % 3 WHEN 0 THEN array(named_struct('label', p_brand, 'text', p_name), named_struct('label', '', 'text', 'plain')) WHEN 1 THEN array() END")
    images = F.expr("CASE WHEN p_partkey % 2 = 0 THEN array(named_struct('filename', 'a.png', 'caption', 'front'), named_struct('filename', 'b.png', 'caption', cast(null as string))) END")
    return logs.markdown_lines(table(spark, d, "part"), "p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")), notes, images, F.col("p_size") % 4)


def bundle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Facts of orders as one text for each customer and back."""
    facts = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    return logs.unbundled(logs.bundle(facts, ["o_orderkey", "o_orderstatus", "price"], "o_custkey"), "o_custkey", "o_orderkey:bigint,o_orderstatus:string,price:double")


def empty_streak(spark: SparkSession, d: str) -> DataFrame:
    """Events of a third empty snapshot in a row or more: a view counts as empty."""
    empty = F.when(F.col("event_type") == "view", F.lit("empty"))
    return collect.streaks(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], empty).where("streak >= 3").select("event_id", "streak")


_PLAN = _pick("concat('{\"subtasks\": [{\"id\": \"a\", \"goal\": \"', c_name, '\"}]}')", "'[]'", "'{\"subtasks\": []}'", "'{\"subtasks\": [{\"id\": \"a\"}]}'", "'{oops'", "'{\"subtasks\": [{\"id\": 1, \"goal\": \"g\"}, {\"id\": 2, \"goal\": \"g\"}, {\"id\": 3, \"goal\": \"g\"}, {\"id\": 4, \"goal\": \"g\"}, {\"id\": 5, \"goal\": \"g\"}, {\"id\": 6, \"goal\": \"g\"}]}'", "'{\"answer\": \"x\"}'")


def plan_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with plans and answers."""
    v = F.try_parse_json("p")
    return _customers(spark, d, p=_PLAN).select(_K, language.plan_problem(v).alias("plan"), language.answer_problem(v).alias("answer"))


def sse_sink(spark: SparkSession, d: str) -> DataFrame:
    """Messages as frames of an event stream."""
    done = table(spark, d, "step_messages").where("action_json is not null")
    return done.select("msg_id", egress.sse_text(F.lit("result"), F.col("action_json")).alias("frame"))


def log_rotation(spark: SparkSession, d: str) -> DataFrame:
    """The newest two files of each host's log at a small limit."""
    entries = table(spark, d, "audit_entries").where("host is not null and body is not null").select("host", "entry_id", "body")
    return logs.rotated(entries, ["host"], ["entry_id"], "body", 20_000).select("host", "entry_id", "file")


def placed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Customers as frames of nations: two by their address, whatever the order of the reports, the rest by what is left."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("parent_id"), F.col("c_custkey").cast("int").alias("frame_id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("ord")).where("ord <= 4")
    frames = c.select("parent_id", "frame_id", "ord", F.expr("CASE WHEN ord <= 2 THEN concat('https://a.example/f', ord, '?k=', frame_id) END").alias("url"))
    reported = c.where("ord <= 3").select("parent_id", (4 - F.col("ord")).alias("ord"), F.expr("concat('https://a.example/f', ord, '#x')").alias("src"), (F.col("ord") * 10).alias("x"), F.lit(5).alias("y"), F.lit(7).alias("w"), F.lit(9).alias("h"))
    return collect.placed_frames(frames, reported)


QUERIES = {f.__name__: f for f in (plan_problems, sse_sink, log_rotation, placed_frames, element_roles, label_only, tokenized_prompts, subword_entities, recent_ring, markdown_report, bundle_roundtrip, empty_streak)}

_ROLE = "CASE WHEN coalesce(role, '') <> '' THEN role WHEN t = 'input' THEN CASE lower(coalesce(type, 'text')) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in policy.INPUT_ROLES.items()) + " ELSE 'textbox' END WHEN editable THEN 'textbox' WHEN regexp_matches(coalesce(classes, ''), '(?i)toast|alert|error|invalid|destructive') THEN 'alert' ELSE CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in policy.TAG_ROLES.items()) + " ELSE t END END"
_STOP = ", ".join(f"'{w}'" for w in sorted(language.STOP))
#: What each event leads to from each state, as a fold over a task's events; a pause keeps the state it holds behind a colon.
_NEXT = "CASE WHEN s IN ('DONE', 'ERROR') THEN s WHEN e = 'fail' THEN 'ERROR' WHEN e = 'stop' THEN 'DONE' WHEN e = 'pause' AND NOT starts_with(s, 'PAUSED') THEN 'PAUSED:' || s WHEN starts_with(s, 'PAUSED') THEN CASE WHEN e = 'resume' THEN s[8:] ELSE s END " + " ".join(f"WHEN s = '{a}' AND e = '{b}' THEN '{c}'" for (a, b), c in requests.MOVES.items()) + " ELSE s END"
ORACLE = {
    "plan_problems": f"SELECT {_K}, CASE {_K} % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not_an_object' WHEN 4 THEN 'not_an_object' WHEN 3 THEN 'subtask_needs_id_and_goal' ELSE 'bad_subtasks' END AS plan, CASE {_K} % 7 WHEN 6 THEN NULL WHEN 1 THEN 'not_an_object' WHEN 4 THEN 'not_an_object' ELSE 'needs_answer' END AS answer FROM customer",
    "sse_sink": r"SELECT msg_id, 'event: result' || chr(10) || 'data: ' || regexp_replace(action_json, '[\r\n]+', ' ', 'g') || chr(10) || chr(10) AS frame FROM step_messages WHERE action_json IS NOT NULL",
    "log_rotation": "SELECT host, entry_id, file FROM (SELECT *, max(file) OVER (PARTITION BY host) AS last FROM (SELECT host, entry_id, CAST(floor(coalesce(sum(octet_length(encode(body)) + 1) OVER (PARTITION BY host ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS BIGINT) AS file FROM audit_entries WHERE host IS NOT NULL AND body IS NOT NULL)) WHERE file > last - 2",
    "placed_frames": """WITH c AS (SELECT CAST(c_nationkey AS INTEGER) AS parent_id, CAST(c_custkey AS INTEGER) AS frame_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord FROM customer)
        SELECT parent_id, frame_id, CAST(CASE WHEN ord <= 3 THEN ord * 10 END AS INTEGER) AS x, CAST(CASE WHEN ord <= 3 THEN 5 END AS INTEGER) AS y, CAST(CASE WHEN ord <= 3 THEN 7 END AS INTEGER) AS w, CAST(CASE WHEN ord <= 3 THEN 9 END AS INTEGER) AS h FROM c WHERE ord <= 4""",
    "element_roles": f"SELECT {_K}, {_ROLE} AS inferred, t IN ('a', 'button', 'input', 'textarea', 'select') OR coalesce(role IN ('button', 'link', 'menuitem', 'tab', 'checkbox', 'textbox'), false) OR editable OR handler OR coalesce(tab_index >= 0, false) AS interactive FROM (SELECT *, lower(tag) AS t FROM (SELECT {_K}, " + ", ".join(f"{e} AS {n}" for n, e in _TAGS.items()) + " FROM customer))",
    "label_only": f"""WITH c AS (SELECT {_K}, {_K} % 10 AS s, '4000' || ({_K} % 40) AS v FROM customer), h AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY min({_K})) AS n FROM c WHERE {_K} % 2 = 0 GROUP BY s, v),
        f AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY min({_K})) + coalesce((SELECT max(n) FROM h WHERE h.s = c.s), 0) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.s = c.s AND h.v = c.v) GROUP BY s, v)
        SELECT s::VARCHAR AS scope, 'CC' AS type, v AS norm_key, 'CC_' || n AS label FROM (SELECT * FROM h UNION ALL SELECT * FROM f)""",
    "tokenized_prompts": f"""WITH c AS (SELECT {_K}, {_K} // 10 AS s, {_K} % 3 AS k, CASE {_K} % 3 WHEN 0 THEN 'u' || ({_K} % 3) || '@mail.example' WHEN 1 THEN 'ABCPK' || {_N4} || 'F' END AS v FROM customer),
        n AS (SELECT s, k, v, row_number() OVER (PARTITION BY s, k ORDER BY min({_K})) AS n FROM c WHERE v IS NOT NULL GROUP BY s, k, v) SELECT c.{_K}, CASE c.k WHEN 0 THEN 'write to [EMAIL_' || n || ']' WHEN 1 THEN 'PAN [PAN_' || n || ']' ELSE 'nothing' END AS prompt FROM c LEFT JOIN n ON n.s = c.s AND n.k = c.k AND n.v = c.v""",
    "subword_entities": f"""WITH t AS (SELECT l_orderkey AS doc, l_linenumber // 2 AS pos, arg_min({{w: CASE WHEN l_suppkey % 5 = 0 THEN 'Monday' ELSE 'wo' || (l_suppkey % 7) END, l: ['O', 'B-PER', 'I-PER', 'B-LOC'][l_partkey % 4 + 1]}}, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) AS x FROM lineitem GROUP BY 1, 2),
        k AS (SELECT doc, pos, x.w AS word, x.l AS label, regexp_extract(x.l, '^[BI]-(.+)$', 1) AS kind FROM t), m AS (SELECT *, CASE WHEN kind <> '' AND label[1] <> 'B' AND lag(kind) OVER w = kind AND pos - lag(pos) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY pos) AS run FROM m)
        SELECT * FROM (SELECT doc, kind, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS "end", string_agg(word, ' ' ORDER BY pos) AS value FROM r WHERE kind <> '' GROUP BY doc, run, kind) WHERE contains(value, ' ') OR regexp_replace(lower(value), '[^a-z-]', '', 'g') NOT IN ({_STOP})""",
    "recent_ring": "SELECT msg_id FROM step_messages WHERE received_at IS NOT NULL ORDER BY received_at DESC, msg_id DESC LIMIT 20",
    "markdown_report": """SELECT p_partkey, '# ' || CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE 'Task report' END || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '## Notes' || chr(10) || chr(10) || '- **' || p_brand || ':** ' || p_name || chr(10) || '- plain' || chr(10) ELSE '' END
        || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '## Saved images' || chr(10) || chr(10) || '- `a.png` — front' || chr(10) || '- `b.png`' || chr(10) ELSE '' END || CASE WHEN p_size % 4 > 0 THEN chr(10) || '## Collected items (' || (p_size % 4) || ') — see report.csv for full data' || chr(10) ELSE '' END AS report FROM part""",
    "bundle_roundtrip": "SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders",
    "empty_streak": "SELECT event_id, CAST(streak AS INTEGER) AS streak FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'view') WHERE streak >= 3",
    "loop_states": f"""WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list_prepend(['IDLE'], list([{list(_EVENTS)}[event_id % {len(_EVENTS)} + 1]] ORDER BY event_id)) AS es FROM events GROUP BY 1),
        f AS (SELECT user_id, ids, list_reduce(es, lambda acc, y: list_concat(acc, [{_NEXT.replace("starts_with(s,", "starts_with(acc[-1],").replace("s IN (", "acc[-1] IN (").replace("|| s ", "|| acc[-1] ").replace("THEN s[8:] ELSE s END", "THEN acc[-1][8:] ELSE acc[-1] END").replace("THEN s WHEN", "THEN acc[-1] WHEN").replace("s = '", "acc[-1] = '").replace("ELSE s END", "ELSE acc[-1] END").replace("e = '", "y[1] = '")}])) AS ss FROM l)
        SELECT user_id, event_id, split_part(state, ':', 1) AS state FROM (SELECT user_id, unnest(ids) AS event_id, unnest(ss[2:]) AS state FROM f)""",
}
