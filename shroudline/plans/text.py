"""Queries of the text functions and checksum predicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.functions import checks, text
from shroudline.sources.tables import table


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map_nodes(column: str, function):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "nodes").where(F.col(column).isNotNull()).select("node_pk", function(F.col(column)).alias("out"))

    return query


def _nodes_sql(column: str, expression: str) -> str:
    return f"SELECT node_pk, {expression} AS out FROM nodes WHERE {column} IS NOT NULL"


_SPACES = r"'[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+'"
_CLEAN = "left(trim(regexp_replace({}, " + _SPACES + ", ' ', 'g')), 300)"
_ORIGIN = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'))"
_BARE = "regexp_extract(href, '^[^#]*')"

QUERIES = {
    "n1_devanagari_digits": _map_nodes("text", text.devanagari_digits),
    "n2_homoglyphs": _map_nodes("text", text.fold_homoglyphs),
    "n3_fullwidth": _map_nodes("text", text.fold_fullwidth),
    "n4_zero_width": _map_nodes("text", text.strip_zero_width),
    "n6_scan_form": _map_nodes("text", text.scan_form),
    "n7_clean_text": _map_nodes("text", text.clean_text),
    "n8_visible_text": _map_nodes("text", text.visible_text),
    "n10_safe_url": _map_nodes("href", text.safe_url),
    "n11_normalize_url": _map_nodes("href", text.normalize_url),
    "n12_frame_url": _map_nodes("href", text.frame_url),
    "n13_host": _map_nodes("href", text.host_from_url),
    "n14_filename": _map_nodes("text", text.filename_part),
    "n15_image_extension": _map_nodes("src", text.image_extension),
    "n16_csv_cell": _map_nodes("text", text.csv_cell),
    "n17_escape_html": _map_nodes("text", text.escape_html),
    "n17_truncate": _map_nodes("text", lambda c: text.truncate(c, 40)),
    "n24_chunks": _map_nodes("text", lambda c: text.word_chunks(c, 5)),
}
ORACLE = {
    "n1_devanagari_digits": _nodes_sql("text", f"translate(text, {_quote(text.DEVANAGARI)}, '0123456789')"),
    "n2_homoglyphs": _nodes_sql("text", f"translate(text, {_quote(text.HOMOGLYPHS)}, {_quote(text.HOMOGLYPHS_TO)})"),
    "n3_fullwidth": _nodes_sql("text", f"translate(text, {_quote(text.FULLWIDTH)}, {_quote(text.FULLWIDTH_TO)})"),
    "n4_zero_width": _nodes_sql("text", f"translate(text, {_quote(text.ZERO_WIDTH + text.BIDI)}, '')"),
    "n6_scan_form": _nodes_sql("text", f"translate(text, {_quote(text.HOMOGLYPHS + text.DEVANAGARI + text.FULLWIDTH + text.ZERO_WIDTH + text.BIDI)}, {_quote(text.HOMOGLYPHS_TO + '0123456789' + text.FULLWIDTH_TO)})"),
    "n7_clean_text": _nodes_sql("text", _CLEAN.replace('{}', "text")),
    "n8_visible_text": _nodes_sql("text", _CLEAN.replace('{}', r"regexp_replace(text, '\n+', ' · ', 'g')")),
    "n10_safe_url": _nodes_sql("href", f"CASE WHEN {_ORIGIN.format('href')} <> '' THEN {_ORIGIN.format('href')} || '/…' ELSE '' END"),
    "n11_normalize_url": _nodes_sql("href", f"regexp_replace({_ORIGIN.format(_BARE)} || regexp_replace({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/$', '')"),
    "n12_frame_url": _nodes_sql("href", f"{_ORIGIN.format('href')} || regexp_extract(regexp_replace(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^[^?#]*')"),
    "n13_host": _nodes_sql("href", "coalesce(nullif(split_part(regexp_replace(href, '^https?://', ''), '/', 1), ''), 'unknown')"),
    "n14_filename": _nodes_sql("text", "coalesce(nullif(left(regexp_replace(trim(regexp_replace(text, '[^a-zA-Z0-9_ -]', '', 'g')), ' +', '_', 'g'), 40), ''), 'untitled')"),
    "n15_image_extension": _nodes_sql("src", r"coalesce(nullif(lower(regexp_extract(src, '(?i)\.(jpg|jpeg|png|gif|webp|svg)(?:[?#]|$)', 1)), ''), 'jpg')"),
    "n16_csv_cell": _nodes_sql("text", "CASE WHEN regexp_matches(text, '[\",\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END"),
    "n17_escape_html": _nodes_sql("text", "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"),
    "n17_truncate": _nodes_sql("text", "CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END"),
    "n24_chunks": _nodes_sql("text", r"CAST(ceil(len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) / 5.0) AS INTEGER)"),
}


def n19_target_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "step_messages").where("prompt is not null").select("msg_id", text.target_count(F.col("prompt")).alias("target"))


def n21_json_type(spark: SparkSession, d: str) -> DataFrame:
    """Actions wrapped in prose are read all the same."""
    wrapped = F.concat(F.lit("Here is the action: "), F.col("action_json"), F.lit(" as asked."))
    got = F.try_variant_get(text.json_from_prose(wrapped), "$.type", "string")
    return table(spark, d, "step_messages").where("action_json is not null").select("msg_id", got.alias("action_type"))


def n22_rgb(spark: SparkSession, d: str) -> DataFrame:
    css = F.concat(F.lit("rgba("), (F.col("l_orderkey") % 256).cast("string"), F.lit(", "), (F.col("l_partkey") % 256).cast("string"), F.lit(", "), (F.col("l_suppkey") % 256).cast("string"), F.lit(", 0.5)"))
    parts = text.rgb(css)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parts[0].alias("r"), parts[1].alias("g"), parts[2].alias("b"))


def n18_markdown(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("**"), F.col("p_name"), F.lit("** *"), F.col("p_brand"), F.lit("* `"), F.col("p_type"), F.lit("` [x](https://parts.example/"), F.col("p_partkey"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.markdown_inline(body).alias("html"))


def v6_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.fnv1a(F.col("c_name")).alias("seed"))


def _sixteen() -> Column:
    return F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "4"), F.lpad(F.col("o_custkey").cast("string"), 8, "1"))


def p1_luhn_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", checks.luhn_valid(_sixteen()).alias("valid"))


def p2_verhoeff_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("2"), F.lpad(F.col("o_orderkey").cast("string"), 11, "7"))
    return table(spark, d, "orders").select("o_orderkey", checks.verhoeff_valid(n).alias("valid"), checks.aadhaar_valid(n).alias("aadhaar"))


def p4_gstin_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n = F.concat(F.lpad((k % 37 + 1).cast("string"), 2, "0"), F.lit("ABCPK"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z"), F.substr(F.lit(checks.MOD36), (k % 36 + 1).cast("int"), F.lit(1)))
    return table(spark, d, "customer").select("c_custkey", checks.gstin_valid(n).alias("valid"))


QUERIES |= {"n18_markdown": n18_markdown, "n19_target_count": n19_target_count, "n21_json_type": n21_json_type, "n22_rgb": n22_rgb, "v6_fnv1a": v6_fnv1a, "check_luhn": p1_luhn_check, "check_verhoeff": p2_verhoeff_check, "check_gstin": p4_gstin_check}
_D = "[" + ", ".join("[" + ", ".join(r) + "]" for r in checks.VERHOEFF_D) + "]"
_P = "[" + ", ".join("[" + ", ".join(r) + "]" for r in checks.VERHOEFF_P) + "]"
_LUHN = (
    "list_sum(list_transform(range(length(n)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(n[length(n) - i] AS INTEGER) "
    "ELSE (2 * CAST(n[length(n) - i] AS INTEGER)) % 10 + (2 * CAST(n[length(n) - i] AS INTEGER)) // 10 END)) % 10 = 0"
)
ORACLE |= {
    "n18_markdown": "SELECT p_partkey, '<strong>' || p_name || '</strong> <em>' || p_brand || '</em> <code>' || p_type || '</code> <a href=\"https://parts.example/' || p_partkey || '\" target=\"_blank\" rel=\"noopener noreferrer\">x</a>' AS html FROM part",
    "n19_target_count": r"""SELECT msg_id, CAST(coalesce(least(50, TRY_CAST(coalesce(nullif(regexp_extract(prompt, '(?i)\btop\s+(\d{1,3})\b', 1), ''),
        nullif(regexp_extract(prompt, '(?i)\b(\d{1,3})\s+(?:posts|items|results|articles|tweets|links|stories)\b', 1), '')) AS INTEGER)), 0) AS INTEGER) AS target
        FROM step_messages WHERE prompt IS NOT NULL""",
    "n21_json_type": "SELECT msg_id, CASE WHEN action_json LIKE '{%' AND json_valid(action_json) THEN json_extract_string(action_json, '$.type') END AS action_type FROM step_messages WHERE action_json IS NOT NULL",
    "n22_rgb": "SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 256 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g, CAST(l_suppkey % 256 AS INTEGER) AS b FROM lineitem",
    "v6_fnv1a": "SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS seed FROM customer",
    "check_luhn": f"SELECT o_orderkey, {_LUHN} AS valid FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '4') || lpad(o_custkey::VARCHAR, 8, '1') AS n FROM orders)",
    "check_verhoeff": f"""SELECT o_orderkey, valid, valid AS aadhaar FROM (SELECT o_orderkey, list_reduce(list_prepend(0, list_transform(range(12), lambda i: ({_P})[i % 8 + 1][CAST(n[12 - i] AS INTEGER) + 1])),
        lambda c, x: ({_D})[c + 1][x + 1]) = 0 AS valid FROM (SELECT o_orderkey, '2' || lpad(o_orderkey::VARCHAR, 11, '7') AS n FROM orders))""",
    "check_gstin": f"""SELECT c_custkey, substr('{checks.MOD36}', CAST((36 - s % 36) % 36 + 1 AS INTEGER), 1) = n[15] AS valid FROM (SELECT c_custkey, n, list_sum(list_transform(range(14), lambda i:
        ((instr('{checks.MOD36}', n[i + 1]) - 1) * (1 + i % 2)) // 36 + ((instr('{checks.MOD36}', n[i + 1]) - 1) * (1 + i % 2)) % 36)) AS s
        FROM (SELECT c_custkey, lpad((c_custkey % 37 + 1)::VARCHAR, 2, '0') || 'ABCPK' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F1Z' || substr('{checks.MOD36}', CAST(c_custkey % 36 + 1 AS INTEGER), 1) AS n FROM customer))""",
}


def n18_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lists and paragraphs made of parts' names."""
    body = F.concat(F.col("p_name"), F.lit("\nsecond *line*\n- a **b**\n* c\n1. one\n  12. two <x>\r\n\n\nend `"), F.col("p_brand"), F.lit("`\n- last"))
    return table(spark, d, "part").select("p_partkey", text.markdown(body).alias("html"))


def n22_frame_target(spark: SparkSession, d: str) -> DataFrame:
    """Where an element lies by its id, with every third node in a frame."""
    name = F.when(F.col("node_pk") % 3 == 0, F.concat(F.lit("f"), F.col("frame_id") + 1, F.lit("_"), F.col("id"))).otherwise(F.col("id"))
    return table(spark, d, "nodes").where("id is not null").select("node_pk", text.frame_target(name).alias("t")).select("node_pk", "t.*")


def n24_chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of seven words of made-up texts, with their places."""
    said = F.concat(F.repeat(F.lit("ab "), (F.col("c_custkey") % 20).cast("int")), F.lit("  end"))
    return table(spark, d, "customer").select("c_custkey", F.explode(text.chunk_texts(said, 7)).alias("c")).select("c_custkey", "c.start", F.length("c.text").alias("n"))


QUERIES |= {f.__name__: f for f in (n18_markdown_blocks, n22_frame_target, n24_chunk_texts)}
ORACLE |= {
    "n18_markdown_blocks": "SELECT p_partkey, '<p>' || p_name || '<br>second <em>line</em></p><ul><li>a <strong>b</strong></li><li>c</li></ul><ol><li>one</li><li>two &lt;x&gt;</li></ol><p>end <code>' || p_brand || '</code></p><ul><li>last</li></ul>' AS html FROM part",
    "n22_frame_target": r"SELECT node_pk, CASE WHEN node_pk % 3 = 0 THEN frame_id + 1 ELSE coalesce(TRY_CAST(regexp_extract(id, '^f(\d+)_.', 1) AS INTEGER), 0) END AS frame_id, CASE WHEN node_pk % 3 = 0 THEN id ELSE regexp_replace(id, '^f\d+_(.)', '\1') END AS local_id FROM nodes WHERE id IS NOT NULL",
    "n24_chunk_texts": "WITH w AS (SELECT c_custkey, c_custkey % 20 AS k FROM customer), c AS (SELECT *, unnest(range(0, (k + 7) // 7)) AS i FROM w) SELECT c_custkey, CAST(CASE WHEN i * 7 = k THEN k * 3 + 2 ELSE i * 21 END AS INTEGER) AS start, CAST(CASE WHEN i * 7 = k THEN 3 WHEN i * 7 + 7 > k THEN (k - i * 7) * 3 + 2 + 3 ELSE 20 END AS INTEGER) AS n FROM c",
}
