"""Rebuilding conversations from message rows.

1. Roles and task ids are brought to one spelling, and re-sent rows collapse to the smallest id by a partial
   aggregation, so a task whose rows are mostly copies is small before anything is grouped by task.
2. Each iteration is judged on its own key (task, iteration): one user and one assistant turn, none empty.  The reply
   edge to an iteration exists if its result names the action of the iteration before; both sides meet by an equi-join
   on (task, iteration), so a task with very many iterations is spread over all partitions.
3. The edges and turns of tasks that can still be whole are sorted topologically with Kahn's algorithm, ties by the
   time of arrival; turns that are left over lie on a cycle or hang on a broken reply.  A graph above ``GRAPH_TURNS``
   turns never comes to one task: its turns are ordered by a window over the same keys, which for a chain of replies
   is the same order.

Defined results: rows without a task id or iteration belong to no conversation; empty means null, blank, JSON null or
an empty object; a row of unknown role is neither user nor assistant and breaks its conversation; two different turns
of one iteration and role break it; an empty table gives no rows; unused columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.operators.groups import sorted_groups
from shroudline.session import cut

#: Spellings of the roles.
ROLES = {"system": "system", "user": "user", "client": "user", "human": "user", "assistant": "assistant", "model": "assistant", "agent": "assistant"}
#: Turns of a reply graph that one task sorts; larger graphs are ordered by a window.
GRAPH_TURNS = 20_000


def _empty(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\s\u00a0]+", "").isin("", "null", "{}"), F.lit(True))


def clean_turns(messages: DataFrame) -> DataFrame:
    """One row per turn: (task_id, iteration, role, msg_id, at, prompt, action_json, last_action_result)."""
    said = F.lower(F.trim("msg_role"))
    spelled = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[said]
    unsaid = said.isNull() | (said == "")
    role = F.when(unsaid, F.when(_empty(F.col("action_json")), "user").otherwise("assistant")).otherwise(F.coalesce(spelled, said))
    task = F.lower(F.regexp_replace("task_id", r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return (
        messages.select(task.alias("task_id"), "iteration", role.alias("role"), "msg_id", "received_at", "prompt", "action_json", "last_action_result")
        .where("task_id != '' and iteration is not null")
        .groupBy("task_id", "iteration", "role", "prompt", "action_json", "last_action_result")
        .agg(F.min("msg_id").alias("msg_id"), F.min("received_at").alias("at"))
    )


def _iterations(turns: DataFrame) -> DataFrame:
    """One row per (task, iteration) with its turns' ids, times, whether it is sound by itself, and what links it to its neighbours."""
    role, result = F.col("role"), F.col("last_action_result")
    user, assistant = role == "user", role == "assistant"
    action, given = F.try_parse_json("action_json"), F.try_parse_json("last_action_result")
    marked = turns.select(
        "task_id", "iteration", "role", "msg_id", "at", user.alias("u"), assistant.alias("a"), (role == "system").alias("s"),
        F.when(assistant, _empty(F.col("action_json"))).otherwise(_empty(F.col("prompt"))).alias("void"),
        (~_empty(result)).alias("has_result"),
        F.when(assistant, F.struct(F.try_variant_get(action, "$.type", "string").alias("type"), F.try_variant_get(action, "$.targetId", "string").alias("target"))).alias("did"),
        F.when(~_empty(result), F.struct(F.try_variant_get(given, "$.type", "string").alias("type"), F.try_variant_get(given, "$.targetId", "string").alias("target"))).alias("answers"),
    )
    number = lambda c: F.count(F.when(c, 1))
    one = lambda c, v: F.min(F.when(F.col(c), F.col(v)))
    return marked.groupBy("task_id", "iteration").agg(
        number(F.col("u")).alias("users"), number(F.col("a")).alias("assistants"), number(F.col("s")).alias("systems"), F.count("*").alias("turns"),
        F.max("void").alias("void"), number(F.col("has_result")).alias("results"), F.max("did").alias("did"), F.max("answers").alias("answers"),
        one("s", "msg_id").alias("s_id"), one("s", "at").alias("s_at"), one("u", "msg_id").alias("u_id"), one("u", "at").alias("u_at"), one("a", "msg_id").alias("a_id"), one("a", "at").alias("a_at"),
    )


def judged_iterations(turns: DataFrame) -> DataFrame:
    """The iterations with ``sound`` (complete by itself) and ``linked`` (its reply edge to the iteration before exists)."""
    each = cut(_iterations(turns))  # read twice below, so written once: a few numbers a row
    before = each.select(F.col("task_id").alias("b_task"), (F.col("iteration") + 1).alias("b_next"), F.col("did").alias("b_did"), F.col("assistants").alias("b_assistants"))
    joined = each.join(before, (F.col("task_id") == F.col("b_task")) & (F.col("iteration") == F.col("b_next")), "left")
    start = F.col("iteration") == 0
    sound = F.when(start, (F.col("systems") == F.col("turns")) & (F.col("systems") == 1) & ~F.col("void")).otherwise(
        (F.col("users") == 1) & (F.col("assistants") == 1) & (F.col("turns") == 2) & ~F.col("void") & (F.col("iteration") >= 1)
    )
    linked = F.when(F.col("iteration") <= 1, F.col("results") == 0).otherwise(
        (F.col("b_assistants") == 1) & (F.col("results") >= 1) & F.col("answers.type").eqNullSafe(F.col("b_did.type")) & F.col("answers.target").eqNullSafe(F.col("b_did.target"))
    )
    return joined.select(
        "task_id", "iteration", F.coalesce(sound, F.lit(False)).alias("sound"), F.coalesce(linked, F.lit(False)).alias("linked"), "s_id", "s_at", "u_id", "u_at", "a_id", "a_at"
    )


def kahn(nodes: list[tuple], edges: list[tuple]) -> tuple[list, list]:
    """(order, leftover) of nodes (key, time) under edges (before, after); ties by time, then key."""
    time = dict(nodes)
    waiting = dict.fromkeys(time, 0)
    after: dict = {}
    for a, b in edges:
        if a in waiting and b in waiting:
            waiting[b] += 1
            after.setdefault(a, []).append(b)
    free = [(time[k], k) for k, n in waiting.items() if not n]
    heapq.heapify(free)
    order = []
    while free:
        _, k = heapq.heappop(free)
        order.append(k)
        for b in after.get(k, ()):
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(free, (time[b], b))
    done = set(order)
    return order, [k for k in time if k not in done]


_FOUND = "task_id string, turn bigint, msg_role string, msg_id bigint"


def sort_task(rows: list[tuple]) -> list[tuple]:
    """The ordered turns of one task's (task, exchanges, iteration, s_id, s_at, u_id, u_at, a_id, a_at), or nothing where the reply graph is not one whole chain.

    A task that came in parts is an error, never a shorter conversation.
    """
    nodes, edges, ids = [], [], {}
    exchanges = [r[2] for r in rows if r[2] >= 1]
    if len(exchanges) != rows[0][1] or exchanges[0] != 1:
        raise ValueError(f"task {rows[0][0]!r} has {rows[0][1]} exchanges, {len(exchanges)} of them here")
    for _, _, iteration, *turns in rows:
        for rank, (msg, at) in enumerate(zip(turns[::2], turns[1::2])):
            if msg is not None:
                ids[iteration, rank] = msg
                nodes.append(((iteration, rank), float("inf") if at is None else at.timestamp()))
        if iteration >= 1:
            edges.append(((iteration, 1), (iteration, 2)))
            edges.append(((iteration - 1, 2), (iteration, 1)) if iteration > 1 else ((0, 0), (1, 1)))
    order, leftover = kahn(nodes, edges)
    roles = [("system", "user", "assistant")[rank] for _, rank in order]
    talk = [r for r in roles if r != "system"]
    if leftover or not talk or talk != ["user", "assistant"] * (len(talk) // 2) or "system" in roles[1:]:
        return []
    return [(rows[0][0], n, role, ids[key]) for n, (key, role) in enumerate(zip(order, roles), 1)]


def conversations(messages: DataFrame, graph_turns: int = GRAPH_TURNS) -> DataFrame:
    """(task_id, turn, msg_role, msg_id) of every kept conversation."""
    judged = cut(judged_iterations(clean_turns(messages)))
    exchanges = F.col("iteration") >= 1
    tasks = judged.groupBy("task_id").agg(
        F.min(F.col("sound") & F.col("linked")).alias("ok"), F.count(F.when(exchanges, 1)).alias("n"), F.max("iteration").alias("last"), F.min("iteration").alias("first")
    )
    kept = tasks.where("ok and n >= 1 and n = last and first >= 0").select(F.col("task_id").alias("k_task"), F.col("n").alias("k_n"))
    whole = judged.join(kept, F.col("task_id") == F.col("k_task")).drop("k_task", "sound", "linked")
    small = whole.where(F.col("k_n") * 2 + 1 <= graph_turns).select("task_id", "k_n", "iteration", "s_id", "s_at", "u_id", "u_at", "a_id", "a_at")
    sorted_small = sorted_groups(small, ["task_id"], ["iteration"], sort_task, _FOUND)
    large = whole.where(F.col("k_n") * 2 + 1 > graph_turns)
    system = F.max(F.when(F.col("iteration") == 0, 1).otherwise(0)).over(Window.partitionBy("task_id"))
    placed = large.withColumn("shift", system).select(
        "task_id", F.explode(F.array(
            F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("system").alias("msg_role"), F.col("s_id").alias("msg_id")),
            F.struct((F.col("shift") + 2 * F.col("iteration") - 1).cast("bigint").alias("turn"), F.lit("user").alias("msg_role"), F.col("u_id").alias("msg_id")),
            F.struct((F.col("shift") + 2 * F.col("iteration")).cast("bigint").alias("turn"), F.lit("assistant").alias("msg_role"), F.col("a_id").alias("msg_id")),
        )).alias("t"),
    ).where("t.msg_id is not null").select("task_id", "t.turn", "t.msg_role", "t.msg_id")
    return sorted_small.unionByName(placed)
