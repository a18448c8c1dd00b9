"""Adjacency-table shredding of nested JSON records into related flat tables.

One pass turns every body into rows ``(node, parent, label, ordinal, kind, scalar)``; entity tables come from joining
object nodes with their scalar children and pivoting the labels.  Nesting may be of any depth, and strings of JSON in
JSON as well: a node carries the path of its record, so no recursive join is needed.

Defined results: a body that is null, blank or not one whole JSON object gives no rows; a value that should be an array
or object but is a string holding JSON is read through the string; a single value in place of an array counts as
element 0; elements of the wrong kind are no records but keep their place; keys may be spelled in camelCase or
snake_case (compared without case and underscores; the first spelling present wins).  Repeated bodies are separate
entries.  Extra columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.functions import json_text

ADJACENCY = (
    "entry_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string, "
    "entity string, json_path string, parent_path string"
)

#: Fixed shape of a request: field -> (entity, is an array, nested record fields).  Names are compared as norm() gives them.
_FRAME: dict = {}
_FRAME.update({"children": ("frame", True, _FRAME)})
_SPEC = {
    "sanitizedDom": ("node", True, {"options": ("option", True, {}), "meta": (None, False, {"badges": ("badge", True, {})})}),
    "openTabs": ("tab", True, {"frames": ("frame", True, _FRAME)}),
    "pageMeta": ("page_meta", False, {"toasts": ("toast", True, None)}),
}


def norm(name: str) -> str:
    return name.replace("_", "").replace("-", "").lower()


def _unwrap(value):
    """The value itself, or what a string holds if that is a JSON array, object or text."""
    while isinstance(value, str):  # each wrapping is longer than what it holds
        text = value.strip()
        if text[:1] not in ("{", "[", '"'):
            break
        try:
            inner = json_text.read(text)
        except ValueError:
            break
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


def _whole_object(body):
    if not body:
        return None
    try:
        found = json_text.read(body)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


class _Rows:
    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(10)]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return json_text.write(value)


def shred_body(entry_id: int, body: str | None, rows: _Rows, with_scalars: bool) -> None:
    """Append the adjacency rows of one body."""
    top = _whole_object(body)
    if top is None:
        return
    count = 0
    # explicit stack: depth is bounded by the data only, not by the interpreter; record is the path of the parent record
    stack = [(top, 0, "", "", _SPEC, None)]
    if with_scalars:
        rows.add(entry_id, 0, None, None, 0, "object", None, "entry", "", None)
    while stack:
        holder, parent, path, record, spec, entity = stack.pop()
        named = {}
        for key, value in holder.items():
            if named.get(norm(key), (key, None))[1] is None:
                named[norm(key)] = (key, value)
        taken = set()
        for label, (kind, is_array, inner) in spec.items():
            key = norm(label)
            taken.add(key)
            if key not in named or named[key][1] is None:
                continue
            value = _unwrap(named[key][1]) if inner is not None else named[key][1]
            here = f"{path}/{label}" if path else label
            if inner is None:  # texts, not objects
                text = _unwrap(value) if isinstance(value, str) and value.lstrip()[:1] == "[" else value
                for ordinal, element in enumerate(text if isinstance(text, list) else [value]):
                    if isinstance(element, str):
                        count += 1
                        rows.add(entry_id, count, parent, label, ordinal, "scalar", element, kind, f"{here}/{ordinal}", record)
                continue
            if not is_array:
                if isinstance(value, list) and len(value) == 1:
                    value = _unwrap(value[0])
                if isinstance(value, dict):
                    if kind is None:  # a plain container: its records belong to the object around it
                        stack.append((value, parent, here, record, inner, "inline"))
                    else:
                        count += 1
                        rows.add(entry_id, count, parent, label, 0, "object", None, kind, here, record)
                        stack.append((value, count, here, here, inner, kind))
                continue
            for ordinal, element in enumerate(value if isinstance(value, list) else [value]):
                element = _unwrap(element)
                if isinstance(element, dict):
                    count += 1
                    at = f"{here}/{ordinal}"
                    rows.add(entry_id, count, parent, label, ordinal, "object", None, kind, at, record)
                    stack.append((element, count, at, at, inner, kind))
        if with_scalars:
            for key, (label, value) in named.items():
                if key not in taken and value is not None:
                    flat = value.items() if isinstance(value, dict) else None
                    prefix = "meta." if entity == "inline" else ""
                    for name, item in [(f"{label}.{k}", v) for k, v in flat] if flat is not None else [(label, value)]:
                        count += 1
                        rows.add(entry_id, count, parent, prefix + name, 0, "scalar", _scalar(item), None, None, None)


_ARROW = pa.schema(
    [("entry_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()),
     ("kind", pa.string()), ("scalar", pa.string()), ("entity", pa.string()), ("json_path", pa.string()), ("parent_path", pa.string())]
)


def adjacency(bodies: DataFrame, key: str = "entry_id", body: str = "body", with_scalars: bool = True) -> DataFrame:
    """The adjacency table of all bodies; without scalars only the record nodes and texts come out."""

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows()
            for entry_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shred_body(entry_id, text, rows, with_scalars)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows.columns, _ARROW)], schema=_ARROW)

    slim = bodies.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("entry_id"), F.col(body).alias("body"))
    return slim.mapInArrow(shred, ADJACENCY)


def child_records(bodies: DataFrame) -> DataFrame:
    """One row (entry_id, json_path) per child record: the rows of all entity tables and of the texts.

    No scalar column is asked for, so none is shredded, and the join with them falls away.
    """
    return entity_rows(adjacency(bodies, with_scalars=False), {}).select("entry_id", "json_path")


def entity_rows(adjacent: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Record nodes joined with their scalar children, labels pivoted to columns: (entry_id, entity, ordinal, json_path, parent_path, columns).

    Records that are plain texts have no children.  ``fields`` maps a label (compared without case and underscores) to the output column.  Both sides are spread by
    (entry, node), so an entry of any size is spread as well.
    """
    objects = adjacent.where(F.col("json_path").isNotNull() & (F.col("entity") != "entry")).select(
        "entry_id", "node", "entity", "ordinal", "json_path", "parent_path"
    )
    wanted = {norm(label): column for label, column in fields.items()}
    plain = F.lower(F.regexp_replace("label", "[_-]", ""))
    scalars = (
        adjacent.where((F.col("kind") == "scalar") & F.col("json_path").isNull() & (plain.isin(*wanted) if wanted else F.lit(False)))
        .select(F.col("entry_id").alias("s_entry"), F.col("parent").alias("s_parent"), plain.alias("s_label"), "scalar")
    )
    joined = objects.join(scalars, (F.col("entry_id") == F.col("s_entry")) & (F.col("node") == F.col("s_parent")), "left")
    pick: list[Column] = [F.min(F.when(F.col("s_label") == label, F.col("scalar"))).alias(column) for label, column in wanted.items()]
    grouped = joined.groupBy("entry_id", "node", "entity", "ordinal", "json_path", "parent_path")
    return (grouped.agg(*pick) if pick else objects).drop("node")


def entity_table(adjacent: DataFrame, entity: str, fields: dict[str, str]) -> DataFrame:
    """Flat table of one entity."""
    return entity_rows(adjacent.where((F.col("entity") == entity) | F.col("entity").isNull()), fields).drop("entity")


def text_table(adjacent: DataFrame, entity: str = "toast") -> DataFrame:
    """Flat table of records that are plain texts."""
    return adjacent.where(F.col("entity") == entity).select(
        "entry_id", "ordinal", "json_path", "parent_path", F.col("scalar").alias("text")
    )


#: Columns of each entity table.
ENTITIES = {
    "node": {"id": "id", "role": "node_role", "text": "text", "rect.x": "x", "rect.y": "y", "rect.w": "w", "rect.h": "h",
             "interactive": "interactive", "href": "href", "author": "author", "meta.score": "score"},
    "option": {"value": "opt_value", "text": "opt_text"},
    "badge": {"name": "badge_name", "level": "badge_level"},
    "tab": {"index": "tab_index", "title": "title", "url": "url", "active": "active"},
    "frame": {"frameId": "frame_id", "url": "url"},
    "page_meta": {"title": "title", "nodeCount": "node_count", "loginWall": "login_wall", "scrollY": "scroll_y",
                  "scrollMax": "scroll_max", "viewport.w": "viewport_w", "viewport.h": "viewport_h"},
}
