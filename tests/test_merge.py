import random

from plain import overlap_free
from textveil.operators.merge import certain, clusters, merge_detections, uncertain

SCHEMA = (
    "record_id int, field_path string, rule_ord int, pattern string, match string, "
    "start int, end int, score double"
)


def _table(spark, cases):
    rows = [
        (case, "text", order, f"p{order}", "m", start, end, score)
        for case, spans in enumerate(cases)
        for order, (start, end, score) in enumerate(spans)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.record_id, []).append((r.start, r.end, r.rule_ord, r.score))
    return {k: sorted(v) for k, v in out.items()}


def test_named_cases(spark):
    cases = [
        [(0, 5, 1.0), (3, 10, 1.0), (3, 10, 1.0), (12, 14, 1.0)],
        [(0, 3, 0.6), (0, 3, 1.0)],
        [(0, 4, 1.0), (4, 8, 1.0)],
        [(0, 9, 1.0), (2, 5, 1.0)],
        [(0, 5, 1.0), (3, 7, 1.0), (6, 20, 1.0)],
    ]
    kept = _kept(merge_detections(_table(spark, cases)))
    assert [s[:3] for s in kept[0]] == [(3, 10, 1), (12, 14, 3)]
    assert kept[1] == [(0, 3, 1, 1.0)]
    assert [s[:2] for s in kept[2]] == [(0, 4), (4, 8)]
    assert [s[:2] for s in kept[3]] == [(0, 9)]
    assert [s[:2] for s in kept[4]] == [(0, 5), (6, 20)]


def test_same_as_scanning_everything(spark):
    rng = random.Random(3)
    cases = []
    for size in [1, 2, 5, 20, 63, 64, 65, 128, 129, 400] * 6:
        spans = []
        for _ in range(size):
            start = rng.randint(0, size * 3)
            spans.append((start, start + rng.randint(1, 9), rng.choice([0.6, 0.95, 1.0])))
        cases.append(spans)
    kept = _kept(merge_detections(_table(spark, cases)))
    for case, spans in enumerate(cases):
        numbered = [(s, e, order, score) for order, (s, e, score) in enumerate(spans)]
        expected = overlap_free(numbered, score=lambda x: x[3])
        assert kept[case] == expected
        assert all(a[1] <= b[0] for a, b in zip(kept[case], kept[case][1:]))


def test_uncertain_hit_may_displace_a_certain_one(spark):
    table = _table(spark, [[(4, 8, 1.0), (0, 20, 0.6)]])
    assert [s[:2] for s in _kept(merge_detections(table))[0]] == [(0, 20)]
    protected = merge_detections(table, protect_certain=True)
    assert [s[:2] for s in _kept(protected)[0]] == [(4, 8)]


def test_confidence_limits(spark):
    scores = [0.3, 0.49, 0.5, 0.89, 0.9, 1.0, None]
    table = _table(spark, [[(10 * i, 10 * i + 1, s) for i, s in enumerate(scores)]])
    assert sorted(r.start for r in certain(table).collect()) == [40, 50, 60]
    assert sorted(r.start for r in uncertain(table).collect()) == [20, 30]


def test_large_fields_are_cut_into_clusters(spark):
    """Fields beyond the limit give the same, whatever the stretches that they are cut by."""
    rng = random.Random(7)
    cases = [[], []]
    for case, dense in ((0, 2), (1, 9)):
        for _ in range(3000):
            start = rng.randint(0, 3000 * dense)
            cases[case].append((start, start + rng.choice([1, 2, 5, 9, 300 if case else 3]), rng.choice([0.6, 0.95, 1.0])))
    # One hit across many stretches, and a null key.
    cases.append([(0, 5000, 1.0)] + [(i * 7, i * 7 + 3, 1.0) for i in range(900)])
    table = _table(spark, cases)
    table = table.unionByName(table.where("record_id = 0").selectExpr("cast(null as int) as record_id", *table.columns[1:]))
    for protect in (False, True):
        whole = _kept(merge_detections(table, protect))
        assert _kept(merge_detections(table, protect, field_hits=100)) == whole
        assert _kept(merge_detections(table, protect, field_hits=10**6)) == whole
    for stretch in (1, 10, 64, 10**6):
        marked = clusters(table, stretch).collect()
        assert len(marked) == table.count()
        for key in (0, 1, 2, None):
            reached, begin, expected = -1, None, {}
            for r in sorted((r for r in marked if r.record_id == key), key=lambda r: r.start):
                if r.start >= reached and r.start != begin:
                    begin = r.start
                reached = max(reached, r.end)
                expected[r.start] = begin
            assert {r.start: r.cluster for r in marked if r.record_id == key} == expected
