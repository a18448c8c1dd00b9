"""Requests of the agent: how they are put together, what may leave by site, what the log keeps, and the loop around them.

Defined results: a host without a policy has policy none; a term that is no pattern is set aside with the reason, never
dropped; a log line with raw data in its reason is an error row, never a log row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.functions.text import target_count
from shroudline.operators import policy, scrub
from shroudline.operators.groups import sorted_groups

#: The policies of a site, the most entries of the decision log, the widest prompt the view shows, the
#: largest body in bytes, and the seconds a confirmation waits.
POLICIES = ("none", "local-only", "never-screenshot", "ask-before-send")
LOG_ENTRIES, VIEW_WIDTH, BODY_BYTES, CONFIRM_S = 500, 160, 8_000_000, 600
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Raw numbers and addresses no log line may hold.
RAW = rf"{_B}[2-9]\d{{3}}\s?\d{{4}}\s?\d{{4}}{_E}|{_B}(?:\+91[\s-]?)?[6-9]\d{{4}}[\s-]?\d{{5}}(?!\d)|{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_E}"


def by_policy(steps: DataFrame, policies: DataFrame, host: str, screenshot: str) -> DataFrame:
    """The steps with their site's policy and what it lets happen: policies are (host, policy), one row a host."""
    p = policies.select(F.col("host").alias("p_host"), F.col("policy").alias("p_policy"))
    joined = steps.join(p, F.col(host) == F.col("p_host"), "left").drop("p_host").withColumn("site_policy", F.coalesce("p_policy", F.lit("none"))).drop("p_policy")
    return joined.withColumns({
        "calls_server": F.col("site_policy") != "local-only", "asks_first": F.col("site_policy") == "ask-before-send",
        "sends_image": F.coalesce(F.col(screenshot), F.lit(False)) & (F.col("site_policy") != "never-screenshot") & (F.col("site_policy") != "local-only"),
    })


#: Site patterns: configuration, and checked.
MOST_PATTERNS = 10_000


def site_of(hosts: DataFrame, patterns: DataFrame, host: str) -> DataFrame:
    """(host, config): the first pattern (ord, pattern, config) each distinct host matches, else generic.

    Hosts are made distinct first; the patterns are broadcast as configuration checked in size, and each host is tested
    against them as a pattern match has no key.
    """
    few = patterns.select("ord", "pattern", "config").limit(MOST_PATTERNS + 1)
    if few.count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} site patterns")
    distinct = hosts.where(F.col(host).isNotNull()).select(F.col(host).alias("host")).distinct()
    met = distinct.join(F.broadcast(few), F.rlike(F.col("host"), F.col("pattern")), "left")
    return met.groupBy("host").agg(F.coalesce(F.min_by("config", "ord"), F.lit("generic")).alias("config"))


def term_hits(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label): texts that hold a user's term (label, term, is_pattern), without regard to case; terms are configuration checked in size."""
    few = terms.limit(MOST_PATTERNS + 1)
    if few.count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} terms")
    literal = F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E"))
    ready = few.select("label", F.concat(F.lit("(?i)"), F.when(F.col("is_pattern"), F.col("term")).otherwise(literal)).alias("p"))
    held = texts.select(F.col(key).alias("t_key"), F.col(text).alias("t_text"))
    return held.join(F.broadcast(ready), F.rlike(F.col("t_text"), F.col("p"))).select(F.col("t_key").alias(key), "label").distinct()


def checked_terms(terms: DataFrame) -> DataFrame:
    """(label, term, is_pattern, problem): user terms with a default label; what is no pattern, or empty, has a problem."""

    @F.pandas_udf("string")
    def problem(term: pd.Series, is_pattern: pd.Series) -> pd.Series:
        def one(t, p):
            if not t:
                return "empty"
            try:
                re.compile(t if p else re.escape(t))
            except re.error:
                return "no pattern"
            return None

        return pd.Series([one(t, p) for t, p in zip(term, is_pattern)], dtype=object)

    trimmed = F.trim(F.coalesce("term", F.lit("")))
    label = F.coalesce(F.nullif(F.trim(F.coalesce("label", F.lit(""))), F.lit("")), F.lit("CUSTOM"))
    return terms.select(label.alias("label"), trimmed.alias("term"), F.coalesce("is_pattern", F.lit(False)).alias("is_pattern")).withColumn("problem", problem(F.col("term"), F.col("is_pattern")))


def security_log(decisions: DataFrame, time: str, tie: str, entries: int = LOG_ENTRIES) -> DataFrame:
    """The newest entries of the decision log (token_id, type, origin, decision, reason): a bounded list.

    Entries whose reason holds raw data are left out here and come from leaking_reasons.
    """
    kind = F.coalesce(policy.normalize_category(F.col("type")), F.lit("UNKNOWN"))
    clean = decisions.where(~F.coalesce(F.col("reason").rlike(RAW), F.lit(False)))
    rows = clean.select(F.coalesce("token_id", F.lit("unknown")).alias("token_id"), kind.alias("type"), F.coalesce("origin", F.lit("unknown")).alias("origin"), F.coalesce("decision", F.lit("BLOCK")).alias("decision"), F.coalesce("reason", F.lit("")).alias("reason"), time, tie)
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(entries)


def leaking_reasons(decisions: DataFrame) -> DataFrame:
    """The decisions that may not be logged."""
    return decisions.where(F.col("reason").rlike(RAW))


def audit_view(log: DataFrame, n: int, time: str, tie: str, prompt: str) -> DataFrame:
    """The newest lines (1 to 500: a top-k report), their prompt scrubbed once more and cut to the view's width."""
    newest = log.orderBy(F.desc(time), tie).limit(max(1, min(500, n)))
    return newest.withColumn(prompt, F.left(scrub.scrub(F.col(prompt))["text"], F.lit(VIEW_WIDTH)))


def body_status(declared: Column, body: Column, most: int = BODY_BYTES) -> Column:
    """Whether a body is taken: refused by what it declares before it is read, else by what was read."""
    return F.when(F.coalesce(declared > most, F.lit(False)), "refused by header").when(F.coalesce(F.octet_length(body) > most, F.lit(False)), "refused by size").otherwise("taken")


def counters(steps: DataFrame, by: str, sent: Column, fixes: Column, boxes: Column) -> DataFrame:
    """Bytes sent, repairs and boxes painted of each group."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return steps.groupBy(by).agg(n(sent).alias("bytes_sent"), n(fixes).alias("fixes"), n(boxes).alias("boxes"), F.count("*").alias("steps"))


def prompt_payload(step: dict[str, Column]) -> Column:
    """The body of a model's prompt: the request's fields under the names the model knows, as JSON with nulls kept."""
    fields = {
        "task": step["prompt"], "iteration": step["iteration"], "maxIterations": step["max_iterations"], "targetCountHint": target_count(F.coalesce(step["prompt"], F.lit(""))),
        "currentUrl": step["current_url"], "screenState": step["screen_state"], "screenStateConfidence": step["confidence"], "screenshotAttached": step["image"], "site": step["site"], "lastActionResult": step["last_result"],
    }
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def assembled(steps: DataFrame, nodes: DataFrame, items: DataFrame, task: str = "task_id") -> DataFrame:
    """The requests: each step with the number of nodes and items it carries and what is sent of its screen.

    Nodes belong to (task, iteration), items to the task up to the iteration; both are counted before they meet a step.
    """
    n = nodes.groupBy(F.col(task).alias("n_task"), F.col("iteration").alias("n_iteration")).agg(F.count("*").alias("node_count"))
    i = items.groupBy(F.col(task).alias("i_task"), F.col("iteration").alias("i_iteration")).agg(F.count("*").alias("item_n"))
    carried = F.sum(F.coalesce("item_n", F.lit(0))).over(Window.partitionBy(task).orderBy("iteration").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    with_nodes = steps.join(n, (F.col(task) == F.col("n_task")) & (F.col("iteration") == F.col("n_iteration")), "left")
    first = F.row_number().over(Window.partitionBy(task, "iteration").orderBy("msg_id")) == 1
    joined = with_nodes.withColumn("first", first).join(i, (F.col(task) == F.col("i_task")) & (F.col("iteration") == F.col("i_iteration")) & F.col("first"), "left")
    return joined.select("msg_id", task, "iteration", F.coalesce("node_count", F.lit(0)).alias("node_count"), carried.alias("item_count"), F.coalesce("screen_state", F.lit("unknown")).alias("screen_state"), F.coalesce("screen_state_confidence", F.lit(0.0)).alias("confidence"))


# the loop ------------------------------------------------------------------------------------------------------------
#: States of the loop, and where an event leads from a state; anything else leaves it where it is.
STATES = ("IDLE", "PLANNING", "PERCEIVING", "REDACTING", "REASONING", "ACTING", "DELEGATING", "SYNTHESIZING", "PAUSED", "AWAITING_CONFIRMATION", "DONE", "ERROR")
MOVES = {
    ("IDLE", "start"): "PLANNING", ("PLANNING", "planned"): "PERCEIVING", ("PLANNING", "delegate"): "DELEGATING", ("DELEGATING", "gathered"): "SYNTHESIZING", ("SYNTHESIZING", "answered"): "DONE", ("PERCEIVING", "seen"): "REDACTING", ("REDACTING", "clean"): "REASONING",
    ("REASONING", "act"): "ACTING", ("REASONING", "risky"): "AWAITING_CONFIRMATION", ("REASONING", "finish"): "DONE", ("ACTING", "acted"): "PERCEIVING", ("AWAITING_CONFIRMATION", "approve"): "ACTING", ("AWAITING_CONFIRMATION", "deny"): "PERCEIVING", ("AWAITING_CONFIRMATION", "timeout"): "PERCEIVING",
}
_HALTS = {"fail": "ERROR", "stop": "DONE"}


def next_state(state: str, held: str | None, event: str) -> tuple[str, str | None]:
    """(state, what a pause holds) after an event; done and failed tasks stay so, a pause gives back the state it held."""
    if state in ("DONE", "ERROR"):
        return state, None
    if event in _HALTS:
        return _HALTS[event], None
    if event == "pause":
        return ("PAUSED", state) if state != "PAUSED" else (state, held)
    if state == "PAUSED":
        return (held, None) if event == "resume" else (state, held)
    return MOVES.get((state, event), state), None


def loop_states(events: DataFrame, task: str, order: list[str], event: str) -> DataFrame:
    """(task, *order, state) after every event of a task, in order; a task's events are at most those of its iterations."""
    kinds = dict(events.dtypes)

    def run(rows: list[tuple]) -> list[tuple]:
        state, held, out = "IDLE", None, []
        for row in rows:
            state, held = next_state(state, held, row[-1])
            out.append((*row[:-1], state))
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in (task, *order)) + ", state string"
    return sorted_groups(events.select(task, *order, event), [task], order, run, schema)


def confirmations(requests: DataFrame, answers: DataFrame, key: str, time: str, limit_s: int = CONFIRM_S) -> DataFrame:
    """(key, decision): the first answer (key, time, approve) within the limit after each request, else deny by timeout."""
    a = answers.select(F.col(key).alias("a_key"), F.col(time).alias("a_time"), "approve")
    since = F.col("a_time").cast("double") - F.col(time).cast("double")
    met = requests.join(a, (F.col(key) == F.col("a_key")) & (since >= 0) & (since <= limit_s), "left")
    first = met.groupBy(key).agg(F.min_by("approve", F.struct("a_time", "approve")).alias("approve"))
    return first.select(key, F.when(F.col("approve").isNull(), "timeout").when(F.col("approve"), "approve").otherwise("deny").alias("decision"))


def rescanned(values: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """(group, value, step): values a page shows at a later step only, with the step that shows them first."""
    first = values.groupBy(group, value).agg(F.min(step).alias(step))
    start = values.groupBy(F.col(group).alias("s_group")).agg(F.min(step).alias("s_step"))
    return first.join(start, F.col(group) == F.col("s_group")).where(F.col(step) > F.col("s_step")).select(group, value, step)


def cache_hits(calls: DataFrame, kind: str, digest: str, order: list[str], ok: Column) -> DataFrame:
    """(kind, hits, misses) of an unbounded cache: a call hits if an earlier one of its kind and digest succeeded; failures are never kept."""
    w = Window.partitionBy(kind, digest).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(ok, 1)).over(w), F.lit(0)) == 1
    judged = calls.select(kind, seen.alias("hit"))
    return judged.groupBy(kind).agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))


def tail_reads(sizes: DataFrame, file: str, order: list[str], size: str) -> DataFrame:
    """(file, *order, start, stop, truncated): what a watcher reads at each look; a file that became shorter is read from its start."""
    w = Window.partitionBy(file).orderBy(*order)
    before = F.coalesce(F.lag(size).over(w), F.lit(0))
    cut = F.col(size) < before
    return sizes.select(file, *order, F.when(cut, 0).otherwise(before).cast("bigint").alias("start"), F.col(size).cast("bigint").alias("stop"), cut.alias("truncated"))
