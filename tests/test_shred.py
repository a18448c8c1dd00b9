import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shroudline.functions import json_text
from shroudline.operators import shred

BODY = "entry_id bigint, body string, json_path string, entity string"


def paths(body):
    rows = shred._Rows()
    shred.shred_body(1, body, rows, False)
    return sorted(p for p in rows.columns[8] if p)


def test_paths_of_all_kinds():
    body = {
        "sanitizedDom": [None, {"options": [{"value": 1}, "x", {"value": 2}], "meta": {"badges": [{"n": 1}]}}, "n/a"],
        "open_tabs": json.dumps([{"frames": [{"children": [{"children": {"a": 1}}]}]}]),
        "pageMeta": json.dumps({"title": "t", "toasts": "one"}),
    }
    assert paths(json.dumps(body)) == sorted([
        "sanitizedDom/1", "sanitizedDom/1/options/0", "sanitizedDom/1/options/2", "sanitizedDom/1/meta/badges/0", "openTabs/0", "openTabs/0/frames/0",
        "openTabs/0/frames/0/children/0", "openTabs/0/frames/0/children/0/children/0", "pageMeta", "pageMeta/toasts/0",
    ])


def test_single_values_count_as_place_zero():
    assert paths('{"sanitizedDom": {"options": {"value": 1}}, "pageMeta": {"toasts": [null, "b", 3]}}') == ["pageMeta", "pageMeta/toasts/1", "sanitizedDom/0", "sanitizedDom/0/options/0"]


def test_unreadable_bodies_give_nothing():
    for body in (None, "", "  ", "[]", "null", '"x"', '{"sanitizedDom": [{}', "{} {}", "not json", "[" * 100_000):
        assert paths(body) == []


def test_any_depth():
    for depth in (900, 20_000):
        frame = '{"frameId": 7, "children": [' * depth + '{"frameId": 0}' + "]}" * depth
        assert len(paths('{"openTabs": [{"frames": [' + frame + "]}]}")) == depth + 2


def test_any_number_of_wrappings():
    nodes = [{"id": "a"}]
    for _ in range(10):
        nodes = json.dumps(nodes)
    assert paths(json.dumps({"sanitizedDom": nodes})) == ["sanitizedDom/0"]
    text = "x"


def test_deep_reader_and_writer_agree_with_the_standard_ones():
    deep = '{"a": [' * 30_000 + '"e"' + "]}" * 30_000
    value = json_text.read(deep)
    assert json_text.write(value) == deep
    seen = []
    json_text.map_texts(value, lambda t: seen.append(t) or t)
    assert seen == ["e"]
    for text in ("[1, 2.5e3, -0, true, null, {}, [], {\"a\": \"\\u00e9\"}]", " 7 ", '"x"', "[NaN]"):
        assert repr(json_text._read_deep(text)) == repr(json.loads(text))
    for text in ("", "[1,]", "{1: 2}", "[1 2]", "[] []", '{"a" 1}', "{", "[01]", "tru"):
        with pytest.raises(ValueError):
            json_text._read_deep(text)


def test_tables_keep_links(spark):
    body = json.dumps({"sanitizedDom": [{"id": "a", "text": "x", "rect": {"x": 1}, "meta": {"score": 5, "badges": [{"name": "n", "level": 2}]}}], "pageMeta": {"title": "t"}})
    df = spark.createDataFrame([(1, body, "clash", "clash"), (2, body, "clash", "clash"), (3, None, "", ""), (None, body, "", "")], BODY)
    adjacent = shred.adjacency(df)
    node = shred.entity_table(adjacent, "node", shred.ENTITIES["node"]).orderBy("entry_id").collect()
    assert [(r.entry_id, r.json_path, r.id, r.text, r.x, r.score) for r in node] == [(1, "sanitizedDom/0", "a", "x", "1", "5"), (2, "sanitizedDom/0", "a", "x", "1", "5")]
    badge = shred.entity_table(adjacent, "badge", shred.ENTITIES["badge"]).where("entry_id = 1").collect()[0]
    assert (badge.parent_path, badge.badge_name, badge.badge_level) == ("sanitizedDom/0", "n", "2")
    assert shred.child_records(df).count() == 6
    assert shred.child_records(df.limit(0)).count() == 0


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["sanitizedDom", "options", "meta", "badges", "openTabs", "frames", "children", "pageMeta", "toasts", "x"]), c, max_size=4), max_leaves=25)


def brute(body):
    """Plain recursive reading of the statement."""
    out = []

    def many(value):
        return list(enumerate(value)) if isinstance(value, list) else [(0, value)]

    def frames(value, path, label):
        for i, v in many(value):
            if isinstance(v, dict):
                out.append(f"{path}/{label}/{i}")
                if v.get("children") is not None:
                    frames(v["children"], f"{path}/{label}/{i}", "children")

    for i, v in many(body.get("sanitizedDom")):
        if isinstance(v, dict):
            out.append(f"sanitizedDom/{i}")
            for j, o in many(v.get("options")):
                if isinstance(o, dict):
                    out.append(f"sanitizedDom/{i}/options/{j}")
            meta = v.get("meta")
            if isinstance(meta, dict):
                for j, o in many(meta.get("badges")):
                    if isinstance(o, dict):
                        out.append(f"sanitizedDom/{i}/meta/badges/{j}")
    for i, v in many(body.get("openTabs")):
        if isinstance(v, dict):
            out.append(f"openTabs/{i}")
            if v.get("frames") is not None:
                frames(v["frames"], f"openTabs/{i}", "frames")
    meta = body.get("pageMeta")
    if isinstance(meta, dict):
        out.append("pageMeta")
        for j, t in many(meta.get("toasts")):
            if isinstance(t, str):
                out.append(f"pageMeta/toasts/{j}")
    return sorted(out)


def _plain(value):
    """No strings that are JSON themselves and no one-element arrays around objects: those have their own rules and tests."""
    if isinstance(value, str):
        return "t" + value if value.strip()[:1] in '{["' else value
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: ({} if k in ("pageMeta", "meta") and isinstance(v, list) else _plain(v)) for k, v in value.items()}
    return value


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["sanitizedDom", "openTabs", "pageMeta", "z"]), json_values, max_size=4))
def test_same_as_a_plain_reading(body):
    body = _plain(body)
    assert paths(json.dumps(body)) == brute(body)


def test_shuffled_keys_change_nothing():
    random.seed(1)
    body = {"pageMeta": {"toasts": ["a"]}, "sanitizedDom": [{"meta": {"badges": [{}]}, "options": [{}]}], "openTabs": [{"frames": [{}]}]}
    keys = list(body)
    random.shuffle(keys)
    assert paths(json.dumps({k: body[k] for k in keys})) == paths(json.dumps(body))
