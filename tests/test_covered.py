"""Boxes covered by others: results line by line, and rows for slabs instead of lines."""

import random
from collections import defaultdict

from shroudline.operators import metrics

SCHEMA = "page bigint, k bigint, x int, y int, w int, h int"


def _written(spark):
    """Rows written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _by_lines(gold, predicted):
    """Brute force: what each line of a box has covered; a line that nothing meets counts as covered, as in the SQL."""
    px = defaultdict(int)
    for page, k, x, y, w, h in gold:
        for row in range(y, y + h):
            met = {c for q, _, a, b, v, u in predicted if q is not None and q == page and a is not None and b <= row < b + u for c in range(max(a, x or 0), min(a + v, (x or 0) + w))}
            px[page, k, w, h] += 0 if x is None else len(met) or w
    out = defaultdict(lambda: [0, 0])
    for (page, _, w, h), n in px.items():
        out[page][0] += 1
        out[page][1] += 10 * n >= 9 * w * h
    return {page: tuple(v) for page, v in out.items()}


def _got(spark, gold, predicted):
    df = metrics.object_recall(spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(predicted, SCHEMA), "page", "k")
    return {r.page: (r.objects, r.covered) for r in df.collect()}


def test_covered_boxes_equal_brute_force(spark):
    random.seed(12)
    box = lambda: (random.randint(-5, 40), random.randint(-280, 280), random.randint(1, 20), random.randint(1, 60))
    near = lambda b: (b[0] + random.randint(-1, 1), b[1] + random.randint(-2, 2), *b[2:])
    gold = [(page, k, *box()) for page in range(12) for k in range(8)]
    predicted = [(page, k, *(near(b) if k % 3 else box())) for page, k, *b in gold]
    gold += [(0, 0, *gold[0][2:]), (1, 1, 3, 3, *gold[9][4:]), (None, 1, 2, 2, 5, 5), (2, 99, None, 4, 5, 5), (50, 1, 0, 0, 4, 4)]
    predicted += [(None, 1, 2, 2, 1, 1), (2, 99, None, 4, 5, 5), (60, 1, 0, 0, 4, 4)]
    assert _got(spark, gold, predicted) == _by_lines(gold, predicted)


def test_a_share_of_exactly_the_least_is_covered(spark):
    assert _got(spark, [(1, 1, 0, 0, 90, 3)], [(1, 1, 0, 0, 81, 3)]) == {1: (1, 1)}
    assert _got(spark, [(1, 1, 0, 0, 3, 90), (1, 2, 9, 0, 10, 90)], [(1, 1, 0, 0, 2, 27), (1, 2, 9, 0, 8, 90)]) == {1: (2, 1)}


def test_boxes_have_rows_for_slabs_not_for_lines(spark):
    gold = [(page, k, 10 * k, 100 * k, 200, 150) for page in range(10) for k in range(10)]
    before = _written(spark)
    assert sum(n for n, _ in _got(spark, gold, gold).values()) == 100
    assert _written(spark) - before < 200 * 10  # their lines are 200 * 150
