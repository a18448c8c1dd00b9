"""Whole records, requests, screens and corpora: nulls, empty tables, ties, clashing names and long inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudline.operators import behavior, collect, metrics, perception, redaction, requests, vision
from shroudline.sources import corpora, html
from shroudline.streaming import limits

NODE = "node_pk bigint, scope string, text string, author string, label string, value string, placeholder string, found string, at int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fields_share_one_vault(spark):
    data = [(1, "t", "a@x.example and B@x.example", "b@x.example", None, "", "no", "clash", 1), (2, "t", None, "A@X.example", None, None, None, "clash", 2), (3, None, "a@x.example", None, None, None, None, "clash", 3), (4, "t", "plain", None, None, None, None, "clash", 4)]
    df = spark.createDataFrame(data, NODE)
    done, log = redaction.redact_fields(df, "node_pk", "scope")
    got = {r.node_pk: (r.text, r.author, r.value) for r in done.collect()}
    assert got == {1: ("[EMAIL_1] and [EMAIL_2]", "[EMAIL_2]", ""), 2: (None, "[EMAIL_1]", None), 3: ("[EMAIL_1]", None, None), 4: ("plain", None, None)}
    assert log.count() == 5
    empty, none = redaction.redact_fields(df.limit(0), "node_pk", "scope")
    assert empty.count() == none.count() == 0


def test_literal_placeholders_keep_their_numbers(spark):
    df = spark.createDataFrame([(1, "t", "as [EMAIL_4] said, a@x.example", None, None, None, None, "", 0)], NODE)
    done, _ = redaction.redact_fields(df, "node_pk", "scope")
    assert done.first().text == "as [EMAIL_4] said, [EMAIL_5]"


def test_splits_need_two_short_neighbours(spark):
    texts = ["call a@b", ".example now", "x" * 30, None, "", "12", "3-45-6789", "y" * 30, "c@d.example"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page int, k bigint, text string")
    got = dict(rows(redaction.redact_splits(df, ["page"], ["k"], "k", "text")))
    assert got[0] == "call [REDACTED_EMAIL]" and got[1] == "[REDACTED_EMAIL] now" and got[5] == got[6] == "[REDACTED_SSN]"
    assert got[2] == "x" * 30 and got[3] is None and got[4] == "" and got[8] == "c@d.example"
    assert redaction.redact_splits(df.limit(0), ["page"], ["k"], "k", "text").count() == 0


def test_gate_puts_tokens_longest_first_and_leaves_other_tasks_alone(spark):
    values = spark.createDataFrame([("t", "[NAME_1]", "Asha Nair"), ("t", "[NAME_2]", "Asha Nair Rao"), ("t", "[X_1]", "abc"), ("u", "[NAME_9]", "Kabir Gupta"), (None, "[NAME_3]", "lone value")], "scope string, token string, value string")
    texts = spark.createDataFrame([(1, "t", "Asha Nair Rao met Asha Nair, abc"), (2, "t", "Kabir Gupta"), (3, None, "a lone value, a@b.example"), (4, "u", None), (5, "t", "")], "id int, scope string, text string")
    got = {r[0]: (r[1], r[2]) for r in redaction.gate(texts, values, "id", "text").collect()}
    assert got == {1: ("[NAME_2] met [NAME_1], abc", True), 2: ("Kabir Gupta", False), 3: ("a [NAME_3], [REDACTED_EMAIL]", True), 4: (None, False), 5: ("", False)}


def test_repair_counts_an_element_once_a_field(spark):
    df = spark.createDataFrame([("n1", "a@b.example", "a@b.example c@d.example", None, "", "123-45-6789", None), ("n2", "fine", None, None, None, None, "x")], "id string, text string, author string, label string, value string, placeholder string, href string")
    assert [(r.id, r.field, r.type, r.hits) for r in redaction.check_and_repair(df, "id").orderBy("field").collect()] == [("n1", "author", "EMAIL", 2), ("n1", "placeholder", "SSN", 1), ("n1", "text", "EMAIL", 1)]


def test_release_of_an_action_is_all_or_nothing(spark):
    values = spark.createDataFrame([("t", "[EMAIL_1]", "EMAIL", "a@b.example", "https://a.example")], "scope string, token string, type string, value string, origin string")
    fields = [("n1", "E-mail", "[EMAIL_1]")]
    data = [(1, "t", "to [EMAIL_1]", None, None, "E-mail", "https://a.example", fields), (2, "t", "x", None, "https://a.example/?[EMAIL_1]", "E-mail", "https://a.example", fields), (3, "t", "[EMAIL_2]", None, None, "E-mail", "https://a.example", None), (4, "t", "[EMAIL_1]", None, None, "Message", "https://a.example", None), (5, None, "none", None, None, None, None, None)]
    df = spark.createDataFrame(data, "id int, scope string, text string, value string, url string, label string, origin string, fields array<struct<targetId:string,label:string,text:string>>")
    got = {r.id: (r.decision, r.text, r.fields[0].text if r.fields else None) for r in redaction.rehydrate_action(df, values, "id", "scope", "label", "origin").collect()}
    assert got == {1: ("ALLOW", "to a@b.example", "a@b.example"), 2: ("BLOCK", "x", "[EMAIL_1]"), 3: ("BLOCK", "[EMAIL_2]", None), 4: ("BLOCK", "[EMAIL_1]", None), 5: ("ALLOW", "none", None)}


def test_frames_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, 1, 2) for i in range(300)] + [(1000, 1001, 1, 1), (1001, 1000, 1, 1), (2000, 9999, 1, 1)]
    got = {r.frame_id: (r.x, r.y, r.depth) for r in collect.stitched_frames(spark.createDataFrame(chain, "frame_id int, parent_id int, dx int, dy int")).collect()}
    assert got == {i: (i + 1, 2 * (i + 1), i) for i in range(300)}  # circles and lost parents are left out
    assert collect.stitched_frames(spark.createDataFrame([], "frame_id int, parent_id int, dx int, dy int")).count() == 0


def test_scroll_rounds_end_for_each_reason(spark):
    rounds = {"target": [5, 5, 5], "stagnant": [1, 0, 0, 0, 9], "attempts": [1] * 20, "open": [1, 1]}
    df = spark.createDataFrame([(k, i, f) for k, v in rounds.items() for i, f in enumerate(v)], "task string, k int, fresh int")
    got = {}
    for r in collect.scroll_rounds(df, "task", "k", "fresh", 12).orderBy("task", "k").collect():
        got[r.task] = (r.k + 1, r["items"], r.stop)
    assert got == {"target": (3, 15, "target"), "stagnant": (4, 1, "stagnant"), "attempts": (12, 12, "target"), "open": (2, 2, None)}


def test_sites_terms_and_logs(spark):
    hosts = spark.createDataFrame([("my.a.test",), ("b.test",), (None,), ("c",)], "host string")
    patterns = spark.createDataFrame([(2, r"\.test$", "test"), (1, "^my", "mine")], "ord int, pattern string, config string")
    assert rows(requests.site_of(hosts, patterns, "host")) == [("b.test", "test"), ("c", "generic"), ("my.a.test", "mine")]
    terms = spark.createDataFrame([("", "(", True), (None, " a ", None), ("l", "(", False), ("l", None, True)], "label string, term string, is_pattern boolean")
    assert rows(requests.checked_terms(terms)) == [("CUSTOM", "(", True, "no pattern"), ("CUSTOM", "a", False, None), ("l", "", True, "empty"), ("l", "(", False, None)]
    log = spark.createDataFrame([("[A_1]", "tel", None, None, "ok", 1), (None, None, "o", "ALLOW", "at a@b.example", 2), ("[B_1]", "x", "o", "ALLOW", None, 2)], "token_id string, type string, origin string, decision string, reason string, at int")
    assert [tuple(r)[:5] for r in requests.security_log(log, "at", "token_id").collect()] == [("[B_1]", "X", "o", "ALLOW", ""), ("[A_1]", "PHONE", "unknown", "BLOCK", "ok")]
    assert requests.leaking_reasons(log).count() == 1


def test_states_of_the_loop(spark):
    steps = ["start", "nonsense", "planned", "seen", "pause", "act", "resume", "clean", "risky", "timeout", "seen", "clean", "act", "fail", "start"]
    df = spark.createDataFrame([("t", i, e) for i, e in enumerate(steps)] + [("u", 0, "pause"), ("u", 1, "stop"), ("v", 0, None)], "task string, k int, event string")
    got = {}
    for r in requests.loop_states(df, "task", ["k"], "event").orderBy("task", "k").collect():
        got.setdefault(r.task, []).append(r.state)
    assert got["t"] == ["PLANNING", "PLANNING", "PERCEIVING", "REDACTING", "PAUSED", "PAUSED", "REDACTING", "REASONING", "AWAITING_CONFIRMATION", "PERCEIVING", "REDACTING", "REASONING", "ACTING", "ERROR", "ERROR"]
    assert got["u"] == ["PAUSED", "DONE"] and got["v"] == ["IDLE"] and set(sum(got.values(), [])) <= set(requests.STATES)


def test_words_of_images_and_their_boxes(spark):
    word = lambda t, c=90.0: (t, c, 1, 2, 3, 4)
    tree = [([([([word("write"), word("low", 10.0), word(" ")],), ([word("a@b.example"), word("now")],)],)],)]
    schema = "id int, blocks array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,confidence:double,x:int,y:int,w:int,h:int>>>>>>>>"
    df = spark.createDataFrame([(1, tree), (2, None), (3, [])], schema)
    assert [(r.word, r.start, r.stop) for r in perception.ocr_words(df, "id", "blocks").orderBy("ord").collect()] == [("write", 0, 5), ("a@b.example", 6, 17), ("now", 18, 21)]
    assert [(r.id, r.type, r.word) for r in perception.ocr_boxes(df, "id", "blocks").collect()] == [(1, "EMAIL", "a@b.example")]


def test_pictures(spark, tmp_path):
    ramp = np.tile(np.arange(0, 90, 10, dtype=np.uint8), (8, 1))
    content = b"P5\n9 8\n255\n" + ramp.tobytes()
    (tmp_path / "a.pgm").write_bytes(content)
    (tmp_path / "b.txt").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r.h for r in perception.screenshots(spark, str(tmp_path)).select("path", perception.fingerprints(F.col("content")).alias("h")).collect()}
    assert got == {"a.pgm": 0, "b.txt": None}
    assert perception.read_pixels(b"P5\n9 8\n255\nshort") is None and perception.read_pixels(None) is None
    image = np.zeros((40, 80, 3)) + 128
    assert perception.crop(image, 70, -5, 50, 10).shape == (10, 10, 3)
    tensor = perception.clip_input(image, 16)
    assert tensor.shape == (3, 16, 16) and abs(tensor.mean() - 128 / 255) < 1e-6
    assert vision.dhash(image) == 0


def test_draws_stay_in_bounds_and_repeat(spark):
    df = spark.range(2_000).withColumn("z", behavior.normal(F.col("id"), "s"))
    stats = df.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(stats[0]) < 0.08 and abs(stats[1] - 1) < 0.08
    one = F.lit
    low, high = df.select(behavior.clamped_log_normal(F.col("z"), one(100.0), one(30.0), one(40.0), one(160.0)).alias("v")).agg(F.min("v"), F.max("v")).first()
    assert low >= 40 and high == 160
    assert df.select("z").collect() == spark.range(2_000).withColumn("z", behavior.normal(F.col("id"), "s")).select("z").collect()
    moves = spark.createDataFrame([(1, 0.0, 0.0, 300.0, 40.0), (2, 5.0, 5.0, 6.0, 5.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    path = behavior.paths(moves, "k").orderBy("k", "step").collect()
    assert [(r.x, r.y) for r in path if r.k == 2] == [(6, 5)] and (path[-2].x, path[-2].y) == (300, 40) and sum(r.k == 1 for r in path) >= 8


def test_blocks_of_broken_pages():
    page = "loose<p>one<b>two</b><br>three<p hidden>never<div>four</div><svg><text>five</text></svg><style>b::after{content:'six'} .none:before{content:\"no\"}</style><script>x='</p>'</script>"
    assert html.text_blocks(page) == ["loose", "onetwo · three", "four", "five"]  # a block ends the hidden paragraph
    assert ("six", "after") in [(b["text"], b["kind"]) for b in html.screen_blocks(page)] and not any(b["text"] == "no" for b in html.screen_blocks(page))
    for odd in (None, "", "<", "<p", "</p></p>", "<br>", "x" * 100_000):
        html.text_blocks(odd), html.screen_blocks(odd)


def test_corpora_are_the_same_everywhere(spark, tmp_path):
    made = corpora.corpora(spark)
    assert rows(made.select("corpus", "sent_id", "text")) == rows(corpora.corpora(spark).select("corpus", "sent_id", "text"))
    for r in made.collect():
        assert all(0 <= g.start < g.end <= len(r.text) for g in r.gold)
    scores = {r.corpus: r for r in metrics.corpus_scores(corpora.predictions(made), "corpus").collect()}
    assert scores["indian"].negatives == 120 and scores["indian"].false_alarms <= 1 and scores["indian"].precision >= 0.99
    assert scores["hindi"].negatives == 42 and scores["hindi"].recall >= 0.9
    corpora.write_corpus(made.coalesce(1).orderBy("corpus", "sent_id"), str(tmp_path / "c"))
    for check in (tmp_path / "c").glob(".*.crc"):
        check.unlink()
    with open(next((tmp_path / "c").glob("part*")), "a") as f:
        f.write('{"corpus": "cut')
    assert corpora.read_corpus(spark, str(tmp_path / "c"), 7).count() == 7
    assert corpora.read_corpus(spark, str(tmp_path / "c"), 10_000).count() == 510


def test_requests_as_a_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"taskId": "t", "iteration": i, "sanitizedDom": [{"id": "n", "text": "x"}], "more": 1}) for i in range(3)] + ["{broken", ""]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    done = limits.run_to_end(limits.request_stream(spark, str(tmp_path / "in")).select("taskId", "iteration"), str(tmp_path / "out"), "requests")
    assert rows(done) == [("t", 0), ("t", 1), ("t", 2)]


@pytest.mark.parametrize("size, start, truncated", [([5, 9, 3, 3], [0, 5, 0, 3], [False, False, True, False])])
def test_tails_start_over_after_a_cut(spark, size, start, truncated):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(size)], "file string, k int, size int")
    got = requests.tail_reads(df, "file", ["k"], "size").orderBy("k").collect()
    assert [r.start for r in got] == start and [r.truncated for r in got] == truncated


def test_texts_of_every_kind(spark):
    from shroudline.functions import text

    df = spark.createDataFrame([(1, "a\n\n\n- x\n-y\n1. <b>\nz"), (2, ""), (3, None), (4, "   "), (5, "[l](javascript:x) `*a*`")], "id int, t string")
    got = {r.id: r.m for r in df.select("id", text.markdown(F.col("t")).alias("m")).collect()}
    assert got[1] == "<p>a</p><ul><li>x</li></ul><p>-y</p><ol><li>&lt;b&gt;</li></ol><p>z</p>" and got[2] == got[3] == got[4] == "" and "<a" not in got[5]
    frames = {r.id: (r.f.frame_id, r.f.local_id) for r in spark.createDataFrame([(1, "f12_n_1"), (2, "n1"), (3, None), (4, "f_1")], "id int, t string").select("id", text.frame_target(F.col("t")).alias("f")).collect()}
    assert frames == {1: (12, "n_1"), 2: (0, "n1"), 3: (0, None), 4: (0, "f_1")}
    chunks = {r.id: [(c.start, c.text) for c in r.c or []] for r in spark.createDataFrame([(1, "  a b  c d e"), (2, ""), (3, None), (4, " ")], "id int, t string").select("id", text.chunk_texts(F.col("t"), 2).alias("c")).collect()}
    assert chunks == {1: [(2, "a b"), (7, "c d"), (11, "e")], 2: [], 3: [], 4: []}


def test_entities_of_first_subwords(spark):
    from shroudline.operators import language

    data = [("d", 0, 0, "Rohan", "B-PER", 0.9), ("d", 0, 1, "Rohan", "O", 0.99), ("d", 1, 0, "Mehta", "I-PER", 0.8), ("d", 2, 0, "said", "O", 0.9), ("d", 3, 0, "Monday", "B-LOC", 0.9), ("d", 4, 0, "Pune", "B-LOC", 0.5), ("d", 5, 0, "Kochi", None, 0.9)]
    df = spark.createDataFrame(data, "doc string, pos int, sub int, word string, label string, score double")
    assert [(r.kind, r.value) for r in language.decode_subwords(df, "doc").collect()] == [("PER", "Rohan Mehta")]
    assert language.decode_subwords(df.limit(0), "doc").count() == 0


def test_bundles_reports_and_roles(spark):
    from shroudline.operators import policy
    from shroudline.sources import logs

    broken = spark.createDataFrame([("t", "{oops"), ("u", None), ("v", '[{"k":1},{"k":null}]')], "task string, bundle string")
    assert rows(logs.unbundled(broken, "task", "k:int")) == [("v", 1), ("v", None)]
    empty = spark.createDataFrame([(1, None, None, None)], "k int, title string, notes array<struct<label:string,text:string>>, images array<struct<filename:string,caption:string>>")
    assert logs.markdown_lines(empty, "k", F.col("title"), F.col("notes"), F.col("images"), F.lit(0)).first().report == "# Task report\n"
    e = spark.createDataFrame([(None, None, None, None, None, None, None), ("INPUT", None, None, None, None, None, None)], "tag string, type string, role string, editable boolean, classes string, handler boolean, tab int")
    got = e.select(policy.element_role(*[F.col(c) for c in ("tag", "type", "role", "editable", "classes")]).alias("r"), policy.interactive(*[F.col(c) for c in ("tag", "role", "editable", "handler", "tab")]).alias("i")).collect()
    assert got[1].r == "textbox" and got[1].i is True and got[0].r is None


def test_frames_take_the_report_of_their_address(spark):
    frames = spark.createDataFrame([(0, 1, 1, "https://a.b/x?q=1"), (0, 2, 2, None), (0, 3, 3, "https://a.b/y"), (0, 4, 4, "https://a.b/x"), (9, 5, 1, "u")], "parent_id int, frame_id int, ord int, url string")
    reported = spark.createDataFrame([(0, 1, "https://a.b/y", 1, 1, 1, 1), (0, 2, "https://a.b/x#f", 2, 2, 2, 2), (0, 3, None, 3, 3, 3, 3)], "parent_id int, ord int, src string, x int, y int, w int, h int")
    assert [(r.frame_id, r.x) for r in collect.placed_frames(frames, reported).orderBy("frame_id").collect()] == [(1, 2), (2, 1), (3, 3), (4, None), (5, None)]
    assert collect.placed_frames(frames.limit(0), reported.limit(0)).count() == 0


def test_plans_logs_and_walls(spark):
    from shroudline.operators import egress, language, policy
    from shroudline.sources import logs

    plans = spark.createDataFrame([(None,), ("{}",), ('{"subtasks": {"id": 1}}',), ('{"subtasks": [{"id": "a", "goal": "g"}, 7]}',), ('{"subtasks": [{"id": "a", "goal": "g"}]}',)], "t string").select(F.try_parse_json("t").alias("v"))
    assert [r[0] for r in plans.select(language.plan_problem(F.col("v"))).collect()] == ["not_an_object", "bad_subtasks", "bad_subtasks", "subtask_needs_id_and_goal", None]
    lines = spark.createDataFrame([("h", i, "x" * 9) for i in range(7)], "host string, k int, line string")
    assert [(r.k, r.file) for r in logs.rotated(lines, ["host"], ["k"], "line", 20).orderBy("k").collect()] == [(4, 2), (5, 2), (6, 3)]
    frame = spark.createDataFrame([("a", "1\n2"), ("b", None)], "e string, d string").select(egress.sse_text(F.col("e"), F.col("d")).alias("f")).collect()
    assert [r.f for r in frame] == ["event: a\ndata: 1 2\n\n", None]
    schema = "page int, node_role string, text string, label string, placeholder string, src string, rect struct<x:int,y:int,w:int,h:int>, u string, title string"
    pages = [(1, "password", None, None, None, None, None, "https://a.b/", None), (2, "paragraph", "x" * 2_000, None, None, None, None, "https://a.b/", None), (2, "textbox", None, "Password", None, None, None, None, None), (3, None, None, None, None, "https://hcaptcha.com/x", (0, 0, 300, 70), None, None), (4, "link", "log in", None, None, None, None, "https://x.com/home", "Just a moment"), (5, "p", "x", None, None, None, None, "https://a.b/author", None)]
    got = {r.page: (r.login_wall, r.captcha) for r in policy.page_walls(spark.createDataFrame(pages, schema), "page", "u", "title").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (True, True), 5: (False, False)}
