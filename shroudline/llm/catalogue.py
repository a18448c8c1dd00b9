"""Queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.llm import conversations, copies, lookalikes, mojibake, packing, personal, residue, tokens, truncation
from shroudline.session import cut
from shroudline.sources.tables import table


def _p1_judged(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    counts = truncation.corpus_counts(nodes)
    texts = truncation.training_texts(nodes, nodes.count())
    return truncation.judged(nodes, truncation.fit(texts, known=truncation.known_of(texts, counts)), counts=counts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_judged(spark, d).where("cut").select("node_pk")


def p1_share_by_host(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares_of(table(spark, d, "nodes"), _p1_judged(spark, d), "host")


def p1_share_by_site_config(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares_of(table(spark, d, "nodes"), _p1_judged(spark, d), "site_config_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "step_messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    return lookalikes.same_looking(nodes, lookalikes.train(nodes))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    return lookalikes.canonical_texts(nodes, lookalikes.train(nodes), ["node_pk"]).select("node_pk", "canonical")


def _p5_keyed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """The keyed rows of both tables, written once (24 bytes a row), so that counting and grouping read no text again."""
    return [("nodes", cut(copies.keyed_nodes(table(spark, d, "nodes")))), ("collected_items", cut(copies.keyed_items(table(spark, d, "collected_items"))))]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    of_nodes, of_items = [copies.copy_pairs(keyed).select(F.lit(name).alias("table_name"), "first_id", "copy_id") for name, keyed in _p5_keyed(spark, d)]
    return of_nodes.unionByName(of_items)


def p5_representatives(spark: SparkSession, d: str) -> DataFrame:
    of_nodes, of_items = [copies.representatives(keyed).select(F.lit(name).alias("table_name"), "first_id", "copies") for name, keyed in _p5_keyed(spark, d)]
    return of_nodes.unionByName(of_items)


def _p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return personal.all_texts(table(spark, d, "nodes"), table(spark, d, "step_messages"), table(spark, d, "collected_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _p6_texts(spark, d)
    return personal.occurrences(texts, personal.bootstrap(spark, texts))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = _p6_texts(spark, d)
    return personal.redacted(texts, personal.bootstrap(spark, texts))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "nodes"), table(spark, d, "audit_entries"))


def p7_content(spark: SparkSession, d: str) -> DataFrame:
    return residue.content(table(spark, d, "nodes")).select("node_pk", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents")).drop("digest")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, d, "documents")), table(spark, d, "containers"))


def p9_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p9_packed(spark, d), table(spark, d, "containers"))


def _p10_judged(spark: SparkSession, d: str, restore: bool) -> DataFrame:
    documents = table(spark, d, "documents")
    words = cut(mojibake.corpus_words(documents))
    return mojibake.judged(documents, mojibake.corpus_classifier(words), words, restore=restore)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10_judged(spark, d, False).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return _p10_judged(spark, d, True).select("doc_id", F.col("restored").alias("text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_share_by_host": p1_share_by_host,
    "p1_share_by_site_config": p1_share_by_site_config,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_representatives": p5_representatives,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_content": p7_content,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_packed": p9_packed,
    "p9_utilisation": p9_utilisation,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
_ROLES = "CASE said " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in conversations.ROLES.items()) + " ELSE said END"
_VOID = r"coalesce(regexp_replace({}, '[\s\x0B\x{{A0}}]+', '', 'g') IN ('', 'null', '{{}}'), true)"
_DID = "{{type: CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$.type') END, target: CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$.targetId') END}}"


def _folded(e: str) -> str:
    return r"translate(regexp_replace(replace(lower(upper(" + e + r")), 'ß', 'ss'), '[\p{P}\p{Z}\p{C}\s\x0B]+', '', 'g'), 'ςſ', 'σs')"


def _leaf(e: str) -> str:
    return f"CASE json_type({e}) WHEN 'VARCHAR' THEN 's' || {_folded(f"({e} ->> '$')")} ELSE CAST({e} AS VARCHAR) END"


def _part(e: str, name: str) -> str:
    return f"json_extract({e}, '$.\"' || {name} || '\"')"


def _fields_of(e: str, name: str, value: str) -> str:
    return f"array_to_string(list_sort(list_transform(json_keys({e}), lambda {name}: {_folded(name)} || chr(2) || {value})), chr(3))"


_DEEP = _part(_part("j", "k"), "q")
_OBJECT = _fields_of("j", "k", f"CASE json_type({_part('j', 'k')}) WHEN 'OBJECT' THEN chr(4) || {_fields_of(_part('j', 'k'), 'q', _leaf(_DEEP))} || chr(5) ELSE {_leaf(_part('j', 'k'))} END")
#: The rules of whole conversations said over again as SQL; every other operator here learns, searches or packs, which SQL cannot say.
_P5_KEYED = f"""WITH k AS (SELECT 'nodes' AS table_name, node_pk AS id, {_folded('href')} || chr(1) || coalesce({_folded('text')}, '') AS key FROM nodes WHERE href IS NOT NULL AND node_pk IS NOT NULL
    UNION ALL SELECT 'collected_items', item_id, {_OBJECT} FROM (SELECT item_id, CASE WHEN json_valid(item_json) THEN CAST(item_json AS JSON) END AS j FROM collected_items WHERE item_id IS NOT NULL) WHERE json_type(j) = 'OBJECT')"""
ORACLE: dict[str, str] = {
    "p5_found": _P5_KEYED + " SELECT table_name, first_id, id AS copy_id FROM (SELECT *, min(id) OVER (PARTITION BY table_name, key) AS first_id FROM k) WHERE first_id < id",
    "p5_representatives": _P5_KEYED + " SELECT table_name, min(id) AS first_id, count(*) AS copies FROM k GROUP BY table_name, key",
    "p3_found": rf"""WITH m AS (SELECT lower(regexp_replace(task_id, '^[\s\x0B\x{{A0}}]+|[\s\x0B\x{{A0}}]+$', '', 'g')) AS task, iteration AS it, lower(trim(msg_role)) AS said, msg_id, prompt, action_json AS a, last_action_result AS r FROM step_messages WHERE iteration IS NOT NULL),
        t AS (SELECT task, it, CASE WHEN coalesce(said, '') = '' THEN CASE WHEN {_VOID.format('a')} THEN 'user' ELSE 'assistant' END ELSE {_ROLES} END AS role, prompt, a, r, min(msg_id) AS id FROM m WHERE task <> '' GROUP BY ALL),
        i AS (SELECT task, it, count(*) AS n, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS s, count(*) FILTER (role = 'system') AS y, bool_or(CASE WHEN role = 'assistant' THEN {_VOID.format('a')} ELSE {_VOID.format('prompt')} END) AS void,
            count(*) FILTER (NOT {_VOID.format('r')}) AS results, max({_DID.format('a')}) FILTER (role = 'assistant') AS did, max({_DID.format('r')}) FILTER (NOT {_VOID.format('r')}) AS answers FROM t GROUP BY task, it),
        j AS (SELECT i.*, CASE WHEN i.it = 0 THEN i.n = 1 AND i.y = 1 AND NOT i.void ELSE i.it > 0 AND i.n = 2 AND i.u = 1 AND i.s = 1 AND NOT i.void END AS sound, CASE WHEN i.it <= 1 THEN i.results = 0 ELSE coalesce(b.s = 1, false) AND i.results >= 1 AND i.answers.type IS NOT DISTINCT FROM b.did.type AND i.answers.target IS NOT DISTINCT FROM b.did.target END AS linked
            FROM i LEFT JOIN i b ON b.task = i.task AND b.it = i.it - 1),
        k AS (SELECT task FROM j GROUP BY task HAVING bool_and(sound AND linked) AND count(*) FILTER (it >= 1) >= 1 AND count(*) FILTER (it >= 1) = max(it) AND min(it) >= 0)
        SELECT task AS task_id, row_number() OVER (PARTITION BY task ORDER BY it, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END) AS turn, role AS msg_role, id AS msg_id FROM t JOIN k USING (task)""",
}
