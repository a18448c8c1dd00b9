import json

from pyspark.sql import functions as F

from shroudline.operators import egress, vault


def test_leaves_of_any_depth():
    value = {"a": ["x", {"b": "y"}], "redactedScreenshot": "z", "n": 1, "e": ""}
    assert list(egress.leaves(value)) == [("a[0]", "x"), ("a[1].b", "y"), ("e", "")]
    deep = "t"
    for _ in range(3000):
        deep = [deep]
    assert len(list(egress.leaves(deep))) == 1


def test_gate(spark):
    bodies = [json.dumps({"a": "mail x@y.example", "b": ["fine", "123-45-6789"], "c": "[EMAIL_1]"}), json.dumps({"a": "fine"}), "plain x@y.example", None, ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies, 1)], "entry_id bigint, body string")
    got = {r.entry_id: (r.fixes, list(r["where"])) for r in egress.gate(egress.json_leaves(df, "entry_id", "body"), "entry_id").collect()}
    assert got == {1: (2, ["a", "b[1]"]), 3: (1, [""])}


def test_one_blocked_placeholder_blocks_the_action(spark):
    found = spark.createDataFrame([("s", "EMAIL", "x@y.example", 1, "https://a"), ("s", "PHONE", "98765 43210", 2, "https://a")], "scope string, type string, value string, row int, origin string")
    v = vault.build(found, ["row"], "origin")
    cases = [
        (1, "s", "[EMAIL_1]", "E-mail", "https://a", True, "x@y.example"), (2, "s", "[EMAIL_1] [PHONE_1]", "E-mail", "https://a", False, None), (3, "s", "[EMAIL_1]", "E-mail", "https://b", False, None),
        (4, "s", "[EMAIL_9]", "E-mail", "https://a", False, None), (5, "s", "nothing", "Message", "https://b", True, "nothing"), (6, "other", "[EMAIL_1]", "E-mail", "https://a", False, None), (7, "s", None, "E-mail", "https://a", True, None),
    ]
    df = spark.createDataFrame(cases, "id int, scope string, text string, label string, place string, want boolean, out string")
    got = {r.id: (r.ok, r.text) for r in egress.rehydrate(df, v, "id", "scope", "text", "label", "place").collect()}
    assert got == {c[0]: (c[5], c[6]) for c in cases}


def test_event_streams(spark):
    stream = 'event: delta\ndata: {"d":"a"}\n\ndata: {"x":1}\n\nevent: delta\ndata: oops\n\nevent: delta\r\ndata: {"d":"b"}\r\n\r\n'
    df = spark.createDataFrame([(1, stream), (2, ""), (3, None)], "id int, t string")
    frames = egress.sse_frames(df, "id", "t")
    assert [(r.id, r.event) for r in frames.orderBy("pos").collect()] == [(1, "delta"), (1, "message"), (1, "delta")]
    assert [tuple(r) for r in egress.joined_deltas(frames, "id", F.get_json_object("data", "$.d")).collect()] == [(1, "ab")]


def test_groups_cross_batches(spark):
    from shroudline.operators.groups import sorted_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
        got = {r.k: (r.n, r.first) for r in sorted_groups(df, ["k"], ["v"], lambda rows: [(rows[0][0], len(rows), rows[0][1])], "k bigint, n bigint, first bigint").collect()}
        assert got == {k: (len(range(k, 50, 7)), k) for k in range(7)}
        assert sorted_groups(df.limit(0), ["k"], ["v"], lambda rows: [(1, 1, 1)], "k bigint, n bigint, first bigint").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sorted_groups_stay_whole_where_a_join_below_turns_into_a_broadcast(spark):
    from shroudline.operators.groups import sorted_groups

    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    try:
        many = spark.range(0, 60_000, 1, 4).selectExpr("id % 3000 as k", "id as v", "repeat(md5(string(id)), 20) as pad")
        kept = spark.range(0, 3_000, 1, 2).selectExpr("id as k").where("k >= 0")  # planned as a sort-merge join on k, a broadcast at run time
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = sorted_groups(many.join(kept, "k"), ["k"], ["v"], lambda rows: [(rows[0][0], len(rows))], "k bigint, n bigint").collect()
            assert len(got) == 3000 and {r.n for r in got} == {20}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
