import base64
import json

from spanloom.functions.strict_json import _loads_deep, loads
from spanloom.operators.nested import bridge, explode_records, objects, occurrences
from spanloom.sources.payloads import hex_id

SCHEMA = "dump_id long, file_name string, payload string, content string, ordinal int"


def brute(value, path="$", parent="$", element=False):
    """(obj_path, parent_path) by plain recursion."""
    if isinstance(value, dict):
        if element:
            yield path, parent
            parent = path
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}", parent)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}[{i}]", parent, True)


VALUE = {"m": [[{"a": 1, "c": [{"t": "x"}, {"t": "x"}, 5, [{"u": {"v": [{}]}}]]}], "s", None], "o": {"k": {"l": [{"é": []}]}}}


def sdk(span_id, **attributes):
    return {"context": {"trace_id": "0x1", "span_id": span_id}, "attributes": {k.replace("_", "."): v for k, v in attributes.items()}}


def typed(v, camel):
    name = lambda s: s.split("_")[0] + "".join(x.capitalize() for x in s.split("_")[1:]) if camel else s
    if isinstance(v, dict):
        return {name("kvlist_value"): {"values": [{"key": k, "value": typed(x, camel)} for k, x in v.items()]}}
    if isinstance(v, list):
        return {name("array_value"): {"values": [typed(x, camel) for x in v]}}
    if v is None:
        return {}
    return {name("int_value"): str(v)} if isinstance(v, int) else {name("string_value"): v}


def otlp(raw_id, value, camel):
    span = {"spanId" if camel else "span_id": raw_id, "attributes": [{"key": "input.value", "value": value}, {"key": "output.value", "value": {}}]}
    spans = {"spans": [span, span]}
    return {"resourceSpans" if camel else "resource_spans": [{"scopeSpans" if camel else "scope_spans": [spans]}]}


def found(spark, payloads):
    df = spark.createDataFrame([(i, "f", p, "clash", 7) for i, p in enumerate(payloads)], SCHEMA)
    return explode_records(df)


def test_every_way_in_gives_the_same_cases(spark):
    text, eight = json.dumps(VALUE), bytes.fromhex("00ab12cd34ef5678")
    payloads = [
        json.dumps([sdk("0x00AB12CD34EF5678", input_value=text)]),
        json.dumps([sdk("0x00ab12cd34ef5678", input_value=json.dumps(text))], indent=1),
        json.dumps([sdk("00ab12cd34ef5678", input_value=VALUE)], ensure_ascii=False),
        json.dumps(otlp(base64.b64encode(eight).decode(), {"string_value": text}, False)),
        json.dumps(otlp("00AB12CD34EF5678", typed(VALUE, True), True)),
        json.dumps(otlp("00ab12cd34ef5678", typed(VALUE, False), False)),
    ]
    expected = sorted(brute(VALUE))
    rows = bridge(found(spark, payloads)).collect()
    for i in range(len(payloads)):
        assert sorted((r.obj_path, r.parent_path) for r in rows if r.dump_id == i) == expected
    assert {r.span_id for r in rows} == {"00ab12cd34ef5678"} and {r.slot for r in rows} == {"input"}


def test_identical_objects_are_stored_once_and_rebuild_the_value(spark):
    df = found(spark, [json.dumps([sdk("0x1", input_value=VALUE, output_value={"again": [{"t": "x"}]})])])
    store = {r.object_id: (r.content, r.n_occurrences) for r in objects(df).collect()}
    assert store[next(k for k, v in store.items() if v[0] == '{"t":"x"}')][1] == 3
    rows = bridge(df).collect()
    assert len(rows) == len(list(brute(VALUE))) + 1 and len(store) == len(rows) - 2

    def rebuild(x):
        if isinstance(x, dict):
            return rebuild(json.loads(store[x["$object"]][0])) if "$object" in x else {k: rebuild(v) for k, v in x.items()}
        return [rebuild(v) for v in x] if isinstance(x, list) else x

    first = next(r for r in rows if r.obj_path == "$.m[0][0]")
    assert rebuild({"$object": first.object_id}) == VALUE["m"][0][0]
    kids = sorted((r.ordinal, r.obj_path) for r in rows if r.parent_object_id == first.object_id)
    assert kids == [(0, "$.m[0][0].c[0]"), (1, "$.m[0][0].c[1]"), (2, "$.m[0][0].c[3][0]")]


def test_dirt_gives_no_rows_and_no_failure(spark):
    deep = json.dumps([sdk("0x1", input_value="[" * 3000 + '{"a":1}' + "]" * 3000)])
    bad = [None, "", "[", "{}", "[1, null]", "NaN", json.dumps([{"context": None}]), json.dumps([sdk("zz", input_value="[{")])]
    bad += [json.dumps([sdk("0x1", input_value='[{"a": NaN}]')]), json.dumps([sdk("0x1", input_value=7)]), json.dumps({"resource_spans": None})]
    assert found(spark, bad).count() == 0
    assert bridge(found(spark, [deep, deep])).count() == 2  # two dumps
    odd = json.dumps([sdk("?", input_value='[{"\\ud800": [{"n": 1}]}]')])
    assert {(r.span_id, r.obj_path) for r in found(spark, [odd]).collect()} == {(None, "$[0]"), (None, "$[0].?[0]")}
    assert found(spark, []).count() == 0


def test_ids():
    assert [hex_id(x) for x in ("0x00AB", "00AB12CD34EF5678", "0XxIBW/ChY8=", "YTkU69/OeVs", "YTkU69_OeVs=", "zz", "", None, 7)] == [
        "00000000000000ab", "00ab12cd34ef5678", "d17c48056fc2858f", "613914ebdfce795b", "613914ebdfce795b", None, None, None, None,
    ]


def test_spans_without_an_id_keep_their_own_occurrences(spark):
    value = json.dumps([{"a": 1}])
    spans = [sdk(None, input_value=value), sdk("?", input_value=value), sdk("0x1", input_value=value), sdk("0x1", input_value=value)]
    df = found(spark, [json.dumps(spans)])
    rows = bridge(df).collect()
    assert sorted(r.span_at for r in rows if r.span_id is None) == [0, 1]
    assert [r.span_at for r in rows if r.span_id is not None] == [None]
    assert [r.n_occurrences for r in objects(df).collect()] == [3]


def test_strict_parser_agrees_with_the_built_in_one():
    for s in ('[1,2.5e3,-0,"a\\u00e9",null,true,{}, [] ,{"a":{}}]', " 3 ", '{"a":[{"b":[]}]}'):
        assert _loads_deep(s) == loads(s) == json.loads(s)
    for s in ("", "[1,]", '{"a":1,}', "[1", '{"a"}', "NaN", "01", "[1]]", '"a', "{a:1}", "[Infinity]"):
        for f in (loads, _loads_deep):
            try:
                f(s)
            except ValueError:
                continue
            raise AssertionError(s)
    assert len(occurrences(loads("[" * 5000 + "{}" + "]" * 5000))) == 1
