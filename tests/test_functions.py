import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars as sc
from spanloom.functions import vectors as ve
from spanloom.functions.text import span_name, words


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


def test_folding_agrees_with_python_on_every_letter(spark):
    points = [c for c in range(1, 0x2FFFF) if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha() and (chr(c).casefold() != chr(c) or chr(c).upper() != chr(c))]
    rows = spark.createDataFrame([(c, chr(c), chr(c).casefold()) for c in points], "c int, a string, b string")
    bad = rows.where(sc.fold(F.col("a")) != sc.fold(F.col("b"))).select("c").collect()
    assert len(bad) <= 1, [hex(r.c) for r in bad]  # the dotted capital I
    got = one(spark, sc.normal_input(F.col("t")), t="  Customer_ID=12\t\n")
    assert got == "customer_id=12"
    assert one(spark, sc.fold(F.lit("ı")) == sc.fold(F.lit("i"))) is False


def test_attributes(spark):
    assert [one(spark, sc.span_kind(F.col("k")), k=k) for k in ("LLM", "TOOL", "llm", "RETRIEVER", None)] == ["llm", "tool", "chain", "chain", "chain"]
    assert one(spark, sc.hex_digits(F.col("k"), 16), k="0xABC") == "0" * 13 + "abc"
    assert [one(spark, sc.token_count(F.col("k")), k=k) for k in ("12", "12.7", "x", None)] == [12, 12, None, None]
    assert [one(spark, sc.or_else(F.col("a"), F.col("b")), a=a, b="p") for a in ("m", "", None)] == ["m", "p", "p"]
    assert one(spark, sc.from_nanos(F.lit(1_700_000_000_123_456_789).cast("long"))) == dt.datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert one(spark, sc.snippet(F.lit("😀" * 100))) == "😀" * 80
    assert [one(spark, sc.after_prefix(F.col("t")), t=t) for t in ("a: b: c", "none")] == ["b: c", "none"]
    assert one(spark, sc.is_blank(F.lit(" \n"))) and not one(spark, sc.is_blank(F.lit("x")))
    rates = ((0.8, 0.1, "GO"), (0.59, 0, "KILL"), (0.9, 0.26, "KILL"), (0.7, 0.1, "GREY"))
    assert [one(spark, sc.verdict(F.lit(a), F.lit(b))) for a, b, _ in rates] == [v for *_, v in rates]
    assert one(spark, sc.holds_any(F.lit("A Loop"), ["loop", "x"])) and not one(spark, sc.holds_any(F.lit("A"), ["loop"]))
    assert sc.stable_seed("a", 1) == sc.stable_seed("a", 1) != sc.stable_seed("a", 2)


def test_longest_leaf(spark):
    cases = {
        '{"a": "short", "b": {"c": ["longest text", "x"]}}': "longest text",
        '["ab", "cd"]': "ab",
        '"quoted"': "quoted",
        "plain text": "plain text",
        '{"a": 1}': '{"a": 1}',
        '{"a": "  "}': '{"a": "  "}',
        "{broken": "{broken",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", sc.longest_leaf(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == {**cases, None: None}


def test_vectors(spark, tmp_path):
    import hashlib

    got = one(spark, ve.hash_vector(F.lit("text")))
    assert got == [b / 255 for b in hashlib.sha256(b"text").digest()[:16]]
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, ve.cosine(arr(1, 0), arr(1, 0))) == 1 and one(spark, ve.cosine(arr(1, 0), arr(-1, 0))) == -1
    assert one(spark, ve.cosine(arr(0, 0), arr(1, 0))) == 0 and math.isclose(one(spark, ve.cosine(arr(1, 1), arr(1, 0))), 0.5**0.5)
    with pytest.raises(Exception, match="different lengths"):
        one(spark, ve.cosine(arr(1, 0), arr(1)))
    with pytest.raises(ValueError):
        ve.TableEmbedder(spark.range(1), "m", "")
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def embed(texts):
            for t in texts:
                (calls / t).touch(exist_ok=False)  # each text once
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    embedder = ve.CachedEmbedder(str(tmp_path / "vectors"), "m", "r1", load)
    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "t string")
    for _ in range(2):
        assert sorted((r.t or "", r.v) for r in embedder.vectors(df, "t", "v").collect()) == [("", None), ("aa", [2.0, 1.0]), ("aa", [2.0, 1.0]), ("b", [1.0, 1.0])]


def test_words_and_names(spark):
    assert words("Don't STOP_now, ½ naïve ΣΑΣ İx") == ["don", "t", "stop", "now", "½", "naïve", "σας", "i̇x"]
    assert [one(spark, span_name(F.col("n")), n=n) for n in ("1:Re-searcher", "42", "", None)] == ["researcher", None, None, None]
