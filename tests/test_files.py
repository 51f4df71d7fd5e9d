import base64
import json

import pytest

from spanloom.__main__ import main
from spanloom.operators.detect import detect
from spanloom.plans.generate import build_set, set_digest, write_set
from spanloom.sinks import append_run, json_reports, markdown_reports, read_runs, trace_texts
from spanloom.sources.files import frozen_parameters, load, read_labels, read_manifest, read_texts, trace_records
from spanloom.sources.otel import otel_spans


def sdk_span(span, parent, name, kind="CHAIN", out="done", second=0, **more):
    return {
        "name": name,
        "context": {"trace_id": "0xABC", "span_id": f"0x{span}"},
        "parent_id": parent and f"0x{parent}",
        "start_time": f"2026-01-01T00:00:{second:02d}.000001Z",
        "end_time": f"2026-01-01T00:00:{second + 1:02d}Z",
        "attributes": {"openinference.span.kind": kind, "input.value": "in", "output.value": out, **more},
    }


SDK = [
    sdk_span("1", None, "run"),
    sdk_span("2", "1", "writer", second=1, out='{"text": "a long answer", "n": 1}'),
    sdk_span("3", "2", "model", "LLM", second=1, **{"llm.token_count.total": 120, "llm.model_name": "m1"}),
    sdk_span("4", "1", "writer", second=5, out='{"text": "a long answer"}'),
    sdk_span("5", "4", "model", "LLM", second=6, **{"llm.token_count.total": 80, "llm.provider": "p"}),
    sdk_span("6", "1", "router", second=7),
]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SDK))
    (tmp_path / "b.json").write_text(json.dumps({"resource_spans": []}))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("[{")
    (tmp_path / "e.json").write_text(" \n")
    (tmp_path / "f.json").write_text('{"x": 1}')
    (tmp_path / "g.json").write_text("7")
    return tmp_path


def test_telemetry_is_preprocessed_and_the_rest_set_aside(spark, folder):
    costs = spark.createDataFrame([("m1", 0.5)], "model string, cost_per_token double")
    spans, refused = load(spark, f"{folder}/*.json", costs=costs)
    rows = {r.span_id[-1]: r for r in spans.collect()}
    assert {k: (r.agent_or_node_id, r.token_count, r.output_text) for k, r in rows.items()} == {
        "1": ("run", None, "done"), "2": ("writer", 120, "a long answer"), "4": ("writer", 80, "a long answer"),
    }
    assert rows["2"].trace_id == "abc".rjust(32, "0") and rows["2"].parent_span_id == "1".rjust(16, "0") and rows["2"].start_time.microsecond == 1
    assert {r.file[-6:]: r.reason for r in refused.collect()} == {
        "b.json": "otlp", "c.json": "array of something else", "d.json": "not JSON", "e.json": "empty", "f.json": "unknown object", "g.json": "not an object or array",
    }
    with pytest.raises(ValueError):
        load(spark, f"{folder}/*.json", strict=True)


def test_otlp_gives_the_same_spans(spark):
    wrap = lambda v: {"intValue": str(v)} if isinstance(v, int) else {"stringValue": v}
    b64 = lambda h: base64.b64encode(bytes.fromhex(h.rjust(16, "0"))).decode()
    spans = [
        {
            "traceId": "ABC".rjust(32, "0"), "spanId": b64(s["context"]["span_id"][2:].rjust(16, "0")), "name": s["name"],
            **({"parentSpanId": b64(s["parent_id"][2:].rjust(16, "0"))} if s["parent_id"] else {}),
            "startTimeUnixNano": str(1767225600000001000 + 10**9 * int(s["start_time"][17:19])), "endTimeUnixNano": 1767225600000000000 + 10**9 * int(s["end_time"][17:19]),
            "attributes": [{"key": k, "value": wrap(v)} for k, v in s["attributes"].items()],
        }
        for s in SDK
    ]
    texts = spark.createDataFrame([("o", json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})), ("s", json.dumps(SDK)), ("n", None)], "file string, text string")
    found, refused = otel_spans(texts, otlp=True)
    by = {f: sorted(tuple(r)[1:] for r in found.where(f"file = '{f}'").collect()) for f in "os"}
    assert by["o"] == by["s"] and len(by["s"]) == 6
    assert [tuple(r) for r in refused.collect()] == [("n", "empty")]


def test_saved_records_round_trip(spark, tmp_path):
    spans, labels, manifest = build_set(spark, 42, 2)
    meta = spark.createDataFrame([("t-0001", '{"source":"x"}')], "trace_id string, metadata string")
    texts = trace_texts(spans, meta)
    texts.repartition(16).select("text").write.text(str(tmp_path / "set"))
    one = json.loads(next(r.text for r in texts.collect() if r.trace_id == "t-0001"))
    assert one["metadata"] == {"source": "x"} and one["spans"][0]["parent_span_id"] is None
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    back, meta_back, _ = trace_records(read_texts(spark, str(tmp_path / "one.json")))
    original = sorted(tuple(r) for r in spans.where("trace_id = 't-0001'").collect())
    assert sorted(tuple(r) for r in back.drop("file", "record_trace").collect()) == original
    assert json.loads(meta_back.first().metadata) == {"source": "x"}
    loaded, refused = load(spark, str(tmp_path / "one.json"))
    assert loaded.count() == len(original) and refused.count() == 0
    one["spans"][0]["trace_id"] = "other"
    (tmp_path / "one.json").write_text(json.dumps(one))
    loaded, refused = load(spark, str(tmp_path / "one.json"))
    assert loaded.count() == 0 and [r.reason for r in refused.collect()] == ["span of another trace"]
    assert set_digest(texts) == set_digest(trace_texts(*[build_set(spark, 42, 2)[0], meta])) != set_digest(trace_texts(build_set(spark, 43, 2)[0], meta))


def test_written_sets_can_be_loaded(spark, tmp_path):
    figures = write_set(spark, str(tmp_path), 5, 2)
    assert figures == write_set(spark, str(tmp_path), 5, 2)
    assert figures["counts"] == {"positive": 8, "negative": 8} and figures["length_distribution"] == {"min": 5, "max": 7, "mean": 6.0}
    assert read_labels(spark, f"{tmp_path}/labels").count() == 16
    back, refused = load(spark, f"{tmp_path}/traces")
    spans, labels, manifest = build_set(spark, 5, 2)
    assert refused.count() == 0 and back.count() == 96 and back.exceptAll(spans).count() == 0
    assert read_manifest(spark, f"{tmp_path}/manifest").exceptAll(manifest).count() == 0 and manifest.count() == 8
    assert json.loads(spark.read.text(f"{tmp_path}/figures").first().value) == figures


def test_bad_records_are_refused_with_the_reason(spark, tmp_path):
    good = {
        "trace_id": "T", "span_id": "s", "parent_span_id": None, "agent_or_node_id": "n", "span_kind": "chain", "start_time": "2026-01-01T00:00:00Z",
        "end_time": "2026-01-01T00:00:01+00:00", "input_text": "", "output_text": "x", "token_count": "12", "model": None, "cost_rate": 1,
    }
    record = lambda **more: json.dumps({"trace_id": "T", "spans": [good | more], "metadata": {}})
    cases = {
        "a": record(), "b": '{"trace_id":"E","spans":[]}', "c": '{"trace_id":"N"}', "d": record(token_count="many"), "e": record(cost_rate="free"),
        "f": record(token_count=2.5), "g": record(colour="red"), "h": record(span_id=None), "i": record(output_text=7), "j": '{"trace_id":"T","spans":[3]}',
        "k": json.dumps({"trace_id": "T", "spans": [{k: v for k, v in good.items() if k != "input_text"}]}), "l": json.dumps({"trace_id": "T", "spans": [good], "x": 1}),
        "m": record(trace_id="U"), "n": record() + "\n\n" + record(model=5) + "\n{cut", "o": record(token_count=None, cost_rate=2.0, model="m"), "p": json.dumps({"spans": [good], "trace_id": None}),
        "q": record(token_count=7.0, parent_span_id=4),
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    spans, refused = load(spark, f"{tmp_path}/*.json")
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in refused.collect()} == {
        "b.json": "no spans", "c.json": "no spans", "d.json": "wrong type: token_count", "e.json": "wrong type: cost_rate", "f.json": "wrong type: token_count",
        "g.json": "unknown field: colour", "h.json": "wrong type: span_id", "i.json": "wrong type: output_text", "j.json": "a span that isn't an object",
        "k.json": "missing field: input_text", "l.json": "unknown field: x", "m.json": "span of another trace", "n.json#3": "wrong type: model", "n.json#4": "not JSON",
        "p.json": "no trace_id", "q.json": "wrong type: parent_span_id",
    }
    assert sorted((r.token_count or 0, r.cost_rate, r.model) for r in spans.collect()) == [(0, 2.0, "m"), (12, 1.0, None), (12, 1.0, None)]


def test_labels_manifest_and_parameters(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"trace_id":"t","class":"positive","pattern":null,"waste_span_ids":["s"]}\n\n')
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "l.jsonl")).collect()] == [("t", "positive", None, ["s"])]
    (tmp_path / "m.json").write_text(json.dumps({"seed": 1, "pairs": [{"positive_trace_id": "a", "negative_trace_id": "b", "pattern": "p", "length": 6}]}, indent=2))
    assert [tuple(r) for r in read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", "b", "p", 6)]
    sha = "e8" * 20
    p = frozen_parameters(f"- φ (threshold): 0.514345\n- 반복 임계 N: 2\n- 임베딩 모델: org/some-model @ revision {sha}\n")
    assert (p.phi, p.n, p.model, p.revision) == (0.514345, 2, "org/some-model", sha)
    for bad in ("", "φ: <2단계 동결 시점 채움>"):
        with pytest.raises(ValueError):
            frozen_parameters(bad)
    ledger = str(tmp_path / "runs")
    assert [append_run(spark, ledger, 0.5, 2, "m@r", 0.8, 0.0, v) for v in ("GO", "GREY")] == [1, 2]
    assert sorted((r.run, r.verdict) for r in read_runs(spark, ledger).collect()) == [(1, "GO"), (2, "GREY")]


def test_reports(spark):
    spans, _, _ = build_set(spark, 1, 1)
    verdicts, details = detect(spans, phi=0.99)
    texts = {r.trace_id: json.loads(r.report) for r in json_reports(verdicts, details, now="2026-01-01T00:00:00Z").collect()}
    first = texts["t-0001"]
    assert first["wasteful"] and first["waste_span_count"] == 2 == len(first["waste_details"]) and first["total_tokens_wasted"] == 20
    assert first["total_cost_wasted"] == pytest.approx(2e-5) and first["detector_params"]["n"] == 2
    d = first["waste_details"][0]
    assert (d["origin_node"], d["repeat_node"], d["cosine"], d["tokens_wasted"]) == ("analyze", "analyze", 1.0, 10) and d["snippet"].startswith("the main causes")
    assert not texts["t-0002"]["wasteful"] and texts["t-0002"]["total_tokens_wasted"] == "unknown"
    bare = {r.trace_id: json.loads(r.report) for r in json_reports(verdicts, details.withColumn("waste_tokens", details.waste_tokens.cast("long") * None), snippets=False).collect()}
    assert "snippet" not in bare["t-0001"]["waste_details"][0] and bare["t-0001"]["waste_details"][0]["tokens_wasted"] == "unknown"
    marks = {r.trace_id: r.report for r in markdown_reports(verdicts, details).collect()}
    assert "| analyze | analyze | 1.0000 | 10 | 0.000010 |" in marks["t-0001"] and "**2. analyze** (repeat)\n> the main causes" in marks["t-0001"]
    assert "no waste detected" in marks["t-0002"]


def test_command_line(spark, folder, capsys, tmp_path):
    assert main(["analyze", str(folder / "a.json"), "--json", str(tmp_path / "j"), "--no-snippets"]) == 0
    out = capsys.readouterr().out
    assert "WASTE DETECTED" in out and "| writer | writer |" in out and "Snippets" not in out
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["waste_span_count"] == 1
    assert main(["analyze", str(folder / "missing.json")]) == 1
    assert main(["analyze", str(folder / "c.json")]) == 1
    assert "Error" in capsys.readouterr().err
