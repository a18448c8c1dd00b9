"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shroudline.operators import shred
from shroudline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.child_records(table(spark, d, "audit_entries"))


def _entity(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        adjacent = shred.adjacency(table(spark, d, "audit_entries"))
        return shred.entity_table(adjacent, name, shred.ENTITIES[name])

    return query


def p2_toasts(spark: SparkSession, d: str) -> DataFrame:
    return shred.text_table(shred.adjacency(table(spark, d, "audit_entries"), with_scalars=False))


QUERIES = {
    "p2_found": p2_found,
    "p2_nodes": _entity("node"),
    "p2_options": _entity("option"),
    "p2_badges": _entity("badge"),
    "p2_tabs": _entity("tab"),
    "p2_frames": _entity("frame"),
    "p2_page_meta": _entity("page_meta"),
    "p2_toasts": p2_toasts,
}


# The same records by DuckDB's own JSON functions: names by their plain form, strings of JSON read through.
def _get(j: str, name: str) -> str:
    key = f"list_filter(json_keys({j}), lambda k: replace(replace(lower(k), '_', ''), '-', '') = '{name}' AND json_type(json_extract({j}, '$.\"' || k || '\"')) <> 'NULL')[1]"
    return f"json_extract({j}, '$.\"' || {key} || '\"')"


def _step(source: str, name: str, label: str, kind: str = "list") -> str:
    """(entry_id, path, j) of the records under one field of the records of ``source``; a string is read through six times at most here."""
    rows = f"SELECT entry_id, path, {_get('j', name)} AS v0 FROM {source}"
    for n in range(6):
        rows = f"SELECT entry_id, path, CASE WHEN json_type(v{n}) = 'VARCHAR' AND left(trim(v{n} ->> '$'), 1) IN ('{{', '[', '\"') AND json_valid(v{n} ->> '$') THEN CAST(v{n} ->> '$' AS JSON) ELSE v{n} END AS v{n + 1} FROM ({rows})"
    if kind == "one":  # a single object, or a list of one
        return f"SELECT entry_id, path || '{label}' AS path, j FROM (SELECT entry_id, path, CASE WHEN json_type(v6) = 'ARRAY' AND json_array_length(v6) = 1 THEN json_extract(v6, '$[0]') ELSE v6 END AS j FROM ({rows})) WHERE json_type(j) = 'OBJECT'"
    each = f"SELECT entry_id, path, unnest(range(len(l))) AS i, unnest(l) AS v0 FROM (SELECT entry_id, path, CASE WHEN json_type(v6) = 'ARRAY' THEN CAST(v6 AS JSON[]) ELSE [v6] END AS l FROM ({rows}) WHERE v6 IS NOT NULL)"
    for n in range(2):
        each = f"SELECT entry_id, path, i, CASE WHEN json_type(v{n}) = 'VARCHAR' AND left(trim(v{n} ->> '$'), 1) IN ('{{', '[', '\"') AND json_valid(v{n} ->> '$') THEN CAST(v{n} ->> '$' AS JSON) ELSE v{n} END AS v{n + 1} FROM ({each})"
    return f"SELECT entry_id, path || '{label}/' || i AS path, v2 AS j FROM ({each}) WHERE json_type(v2) = 'OBJECT'"


_TOP = "top AS (SELECT entry_id, '' AS path, j FROM (SELECT entry_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM audit_entries WHERE entry_id IS NOT NULL) WHERE json_type(j) = 'OBJECT')"
_RECORDS = f"""WITH RECURSIVE {_TOP}, nodes_ AS ({_step('top', 'sanitizeddom', 'sanitizedDom')}), options_ AS ({_step('nodes_', 'options', '/options')}), meta_ AS ({_step('nodes_', 'meta', '/meta', 'one')}), badges_ AS ({_step('meta_', 'badges', '/badges')}),
    tabs_ AS ({_step('top', 'opentabs', 'openTabs')}), frames_ AS ({_step('tabs_', 'frames', '/frames')} UNION ALL SELECT * FROM ({_step('frames_', 'children', '/children')})), page_ AS ({_step('top', 'pagemeta', 'pageMeta', 'one')}),
    said AS (SELECT entry_id, path, {_get('j', 'toasts')} AS v FROM page_), toasts_ AS (SELECT entry_id, path || '/toasts/' || i AS path, t FROM (SELECT entry_id, path, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT entry_id, path,
        CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) WHEN json_type(v) = 'VARCHAR' AND left(ltrim(v ->> '$'), 1) = '[' AND json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON[]) WHEN v IS NOT NULL THEN [v] END AS l FROM said)) WHERE json_type(t) = 'VARCHAR')"""
ORACLE: dict[str, str] = {
    "p2_found": _RECORDS + " SELECT entry_id, path AS json_path FROM nodes_ UNION ALL SELECT entry_id, path FROM options_ UNION ALL SELECT entry_id, path FROM badges_ UNION ALL SELECT entry_id, path FROM tabs_ UNION ALL SELECT entry_id, path FROM frames_ UNION ALL SELECT entry_id, path FROM page_ UNION ALL SELECT entry_id, path FROM toasts_",
    "p2_toasts": _RECORDS + " SELECT entry_id, CAST(regexp_extract(path, '(\\d+)$', 1) AS INTEGER) AS ordinal, path AS json_path, 'pageMeta' AS parent_path, t ->> '$' AS text FROM toasts_",
}


def _scalar(e: str) -> str:
    return f"CASE json_type({e}) WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN {e} ->> '$' ELSE CAST({e} AS VARCHAR) END"


def _column(label: str) -> str:
    first, _, second = label.lower().partition(".")
    if not second:
        return _scalar(_get("j", first))
    if first == "meta":
        return _scalar(_get("m", second))
    inner = _get(_get("j", first), second)
    return f"CASE WHEN json_type({_get('j', first)}) = 'OBJECT' THEN {_scalar(inner)} END"


def _table_sql(entity: str, rows: str, parent: str) -> str:
    """A flat table: each record with its place, its parent's, and its scalar fields."""
    columns = ", ".join(f'{_column(label)} AS "{column}"' for label, column in shred.ENTITIES[entity].items())
    meta = "SELECT n.*, m.j AS m FROM nodes_ n LEFT JOIN meta_ m ON m.entry_id = n.entry_id AND m.path = n.path || '/meta'" if entity == "node" else f"SELECT * FROM {rows}"
    ordinal = "0" if entity == "page_meta" else "CAST(regexp_extract(path, '([0-9]+)$', 1) AS INTEGER)"
    return f"{_RECORDS} SELECT entry_id, {ordinal} AS ordinal, path AS json_path, regexp_replace(path, '{parent}', '') AS parent_path, {columns} FROM ({meta})"


ORACLE |= {
    "p2_nodes": _table_sql("node", "nodes_", "^.*$"), "p2_options": _table_sql("option", "options_", "/options/[0-9]+$"), "p2_badges": _table_sql("badge", "badges_", "/meta/badges/[0-9]+$"),
    "p2_tabs": _table_sql("tab", "tabs_", "^.*$"), "p2_frames": _table_sql("frame", "frames_", "/(frames|children)/[0-9]+$"), "p2_page_meta": _table_sql("page_meta", "page_", "^.*$"),
}
