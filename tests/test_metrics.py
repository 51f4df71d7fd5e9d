import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spanloom.functions.vectors import hash_vector
from spanloom.operators import metrics as m
from spanloom.plans.flows import calibrate, evaluate
from spanloom.plans.generate import PATTERNS, build_set
from spanloom.sources.files import Frozen


def percentile(values, p):
    s = sorted(values)
    k = (len(s) - 1) * p
    lo, hi = math.floor(k), math.ceil(k)
    return s[lo] + (s[hi] - s[lo]) * (k - lo)


def pairs(spark, dup, other):
    rows = [("t", True, float(x)) for x in dup] + [("t", False, float(x)) for x in other]
    return spark.createDataFrame(rows, "trace_id string, dup boolean, cosine double")


def test_separation(spark):
    rng = random.Random(1)
    dup, other = [rng.uniform(0.5, 1) for _ in range(40)], [rng.uniform(0, 0.7) for _ in range(60)]
    row = m.separation(pairs(spark, dup, other)).first()
    phi = (percentile(dup, 0.1) + percentile(other, 0.9)) / 2
    d = (statistics.mean(dup) - statistics.mean(other)) / math.sqrt((statistics.variance(dup) + statistics.variance(other)) / 2)
    assert row.phi == pytest.approx(phi) and row.gap == pytest.approx(percentile(dup, 0.1) - percentile(other, 0.9))
    assert row.cohens_d == pytest.approx(d) and row.pair_fpr == pytest.approx(sum(x >= phi for x in other) / 60)
    assert [m.separation(pairs(spark, [1, 1], [0, 0])).first().cohens_d, m.separation(pairs(spark, [1], [0, 0])).first().cohens_d] == [math.inf, 0.0]
    assert m.separation(pairs(spark, [0, 0], [1, 1])).first().failures == "gap,pair_fpr"  # without spread d is infinite
    none = m.separation(pairs(spark, [], [])).first()
    assert none.phi is None and none.pair_fpr == 0
    s = {r.dup: r for r in m.summary(pairs(spark, [0, 10], [5]), "cosine", "dup").collect()}
    assert (s[True].p10, s[True].median, s[True].p90, s[True].mean, s[False].p10) == (1.0, 5.0, 9.0, 5.0, 5.0)


def test_confusion_and_unlabelled(spark):
    verdicts = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", False), ("x", True)], "trace_id string, wasteful boolean")
    raw = spark.createDataFrame(
        [("a", "positive", "p", ["1"]), ("a", "positive", "p", ["2"]), ("b", "positive", "q", None), ("c", "negative", None, []), ("d", "negative", "", []), (None, "positive", "p", []), ("e", None, None, None)],
        "trace_id string, label_class string, waste_pattern string, waste_span_ids array<string>",
    )
    labels = m.clean_labels(raw)
    assert {r.trace_id: list(r.waste_span_ids) for r in labels.collect()} == {"a": ["1", "2"], "b": [], "c": [], "d": []}
    row = m.confusion(verdicts, labels).first()
    assert (row.tp, row.fp, row.tn, row.fn, row.f1, row.fpr, row.verdict) == (1, 1, 1, 1, 0.5, 0.5, "KILL")
    by = {r.pattern: (r.tp, r.fp, r.tn, r.fn, r.tpr) for r in m.confusion_by_pattern(verdicts, labels).collect()}
    assert by == {"p": (1, 0, 0, 0, 1.0), "q": (0, 0, 0, 1, 0.0), "_control": (0, 1, 1, 0, 0.0)}
    assert [r.trace_id for r in m.unlabelled(verdicts, labels).collect()] == ["x"]
    assert m.confusion(verdicts, labels.where("false")).first().f1 == 0
    assert {(r.label_class, r.pattern, r.n) for r in m.label_counts(labels).collect()} == {("positive", "p", 1), ("positive", "q", 1), ("negative", "_control", 2)}


def test_pair_statistics_in_blocks(spark):
    rng = random.Random(2)
    rows = [("t", f"{i}", rng.choice("abcdef")) for i in range(40)] + [("u", "1", "a"), ("u", "2", "b"), ("v", "1", "a")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, x string").withColumn("v", hash_vector(F.col("x")))
    one, many = ({r.trace_id: tuple(r)[1:] for r in m.pair_statistics(df, 0.9, block).collect()} for block in (1000, 7))
    assert set(one) == {"t", "u"} and one["t"][0] == 780
    for t in one:
        assert one[t] == pytest.approx(many[t])
    vectors = {r.span_id: r.v for r in df.where("trace_id = 't'").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    values = [cos(vectors[a], vectors[b]) for a in vectors for b in vectors if a < b]
    assert one["t"] == pytest.approx((780, min(values), statistics.median(values), max(values), sum(x >= 0.9 for x in values)))


def test_calibration_and_evaluation_of_a_generated_set(spark, tmp_path):
    spans, labels, manifest = build_set(spark, 7, 3)
    assert spans.groupBy("trace_id").count().count() == labels.count() == 2 * 3 * len(PATTERNS) and manifest.count() == 3 * len(PATTERNS)
    shape = spans.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("pos", "agent_or_node_id", "span_kind", "start_time"))).alias("s"))
    s = {r.trace_id: [tuple(x) for x in r.s] for r in shape.collect()}
    assert all(s[r.positive_trace_id] == s[r.negative_trace_id] and len(s[r.positive_trace_id]) == r.length for r in manifest.collect())
    result = calibrate(spans, labels)
    assert result["n"] == 2 and result["guards_passed"] and result["trace_fpr"] == 0 and 0.7 < result["phi"] < 1
    from spanloom.operators.detect import scored_pairs
    from spanloom.operators.structural import candidate_pairs
    from spanloom.sinks import calibration_markdown, read_runs, runs_markdown

    split = m.split_pairs(scored_pairs(candidate_pairs(spans)), m.clean_labels(labels))
    log = calibration_markdown(result, m.summary(split, "cosine", "dup"))
    assert "- **n**: 2" in log and "| duplicate | 15 |" in log
    params = Frozen(0.99, 2, "hash", "0")
    ledger = str(tmp_path / "runs")
    got = evaluate(spans, labels, params, ledger=ledger)
    # the hand-off pattern can't be found from structure
    assert (got["tp"], got["fp"], got["tn"], got["fn"], got["verdict"], got["run"]) == (9, 0, 12, 3, "GO", 1)
    assert got["f1"] == pytest.approx(18 / 21) and got["patterns"]["regen_handoff"]["tpr"] == 0
    assert "| 1 | " in runs_markdown(read_runs(spark, ledger)) and "| GO |" in runs_markdown(read_runs(spark, ledger))
    with pytest.raises(ValueError, match="no label"):
        evaluate(spans, labels.where("trace_id <> 't-0001'"), params)
    from spanloom.sinks import append_run

    for _ in range(3):
        append_run(spark, ledger, 0.5, 2, "m", 0.7, 0.1, "GREY")
    with pytest.raises(ValueError, match="budget"):
        evaluate(spans, labels, params, ledger=ledger)
    assert m.choose_n(spans, m.clean_labels(labels).where("false")).count() == 0


def test_intruders_by_pattern_and_source(spark):
    from spanloom.operators.detect import scored_pairs
    from spanloom.operators.structural import candidate_pairs
    from spanloom.plans.generate import build_set

    spans, labels, manifest = build_set(spark, 2, 12)
    pairs = m.split_pairs(scored_pairs(candidate_pairs(spans)), m.clean_labels(labels)).collect()
    twins = {r.negative_trace_id: r.pattern for r in manifest.collect()}
    lookups = {r.output_text for r in spans.where("input_text LIKE 'account=%'").collect()}
    assert any(x.startswith("the ") for x in lookups) and len({x for x in lookups if x.startswith("name=")}) > 2  # both pools occur
    assert not [p for p in pairs if twins.get(p.trace_id) == "requery_known"]  # the input gate holds all of them back
    df = m.split_pairs(scored_pairs(candidate_pairs(spans)), m.clean_labels(labels))
    want = {}
    for p in pairs:
        if not p.dup and p.cosine >= 0.5:
            key = (p.waste_pattern or "?", "positive(non-waste)") if p.label_class == "positive" else (twins.get(p.trace_id, "?"), "clean")
            want[key] = want.get(key, 0) + 1
    got = {(r.pattern, r.source): r.n for r in m.intruder_sources(df, manifest, 0.5).collect()}
    assert got == want and any(s == "clean" for _, s in got)
    bare = m.intruder_sources(df, manifest.limit(0), 0.5).collect()
    assert {r.pattern for r in bare if r.source == "clean"} == {"?"}
