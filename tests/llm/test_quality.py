import random
import re
import unicodedata

import pytest

from spanloom.llm import quality
from spanloom.llm.quality import assess, broken_bounds, text_statistics

DOCS = "doc_id long, text string, n_chars long, n_words string, k int, h int, c string"
COMMON = ["the", "and", "of", "is", "in", "und", "Der", "그리고", None, "the", "a", "to", "was", "it"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "clash", 1, 1, "x") for i, t in enumerate(texts)], DOCS)


def common(spark, words=COMMON):
    return spark.createDataFrame([("en", w, 1) for w in words], "lang string, word string, text int")


def brute(text):
    if text is None:
        return None
    ln = lambda c: unicodedata.category(c)[0] in "LN"
    ws, word = [], ""
    for c in text + " ":
        if ln(c):
            word += c
        elif word:
            ws.append(word.lower())
            word = ""
    lines = [x for line in text.split("\n") if (x := line.strip(" \t\r"))]
    listed = {w.lower() for w in COMMON if w}
    return {
        "n_chars": len(text),
        "n_words": len(ws),
        "word_chars": sum(ln(c) for c in text),
        "n_symbols": sum(not ln(c) and c not in " \t\n\r" for c in text),
        "n_lines": len(lines),
        "n_ended": sum(x[-1] in ".!?…。" for x in lines),
        "n_common": sum(w in listed for w in ws),
        "n_digits": sum(unicodedata.category(c)[0] == "N" for c in text),
        "n_marked": len(re.findall(r"(?m)^[ \t]*(?:[-*•–+]|[0-9]{1,4}[.)])[ \t]+(?=\S)", text)),
        "n_code": sum(c in "[](){}<>=_\"'\\" for c in text),
    }


def faults(s):
    if not s:
        return set()
    n = s["n_words"]
    if n == 0:
        return {"few_words"}
    out = {"few_words"} if n < 25 else set()
    out |= {"word_length"} if not 2.5 <= s["word_chars"] / n <= 7.5 else set()
    out |= {"symbols"} if s["n_symbols"] / s["n_chars"] > 0.08 else set()
    out |= {"line_ends"} if s["n_ended"] / s["n_lines"] < 0.4 else set()
    return out | ({"common_words"} if s["n_common"] / n < 0.15 else set())


def texts(seed, n=150):
    rng = random.Random(seed)
    parts = ["the ", "and ", "Der ", "river ", "x9 ", "그리고 ", "漢字", "é", "é ", "😀", "…", "。\n", ". ", ".\r\n", "!\t\n", "\n", " \t\n", "  ", "½ ", "_", "[a]", "{", " ", "?", "-", "Σας "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return out + [None, "", "   \n\t", "…", "\n\n", "the", ". .", "word " * 60_000 + ".", "é" * 30, "﻿a."]


@pytest.mark.parametrize("joined", [False, True])
def test_counts_and_bounds(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(quality, "MOST_LITERALS", 2)
    rows = texts(1)
    rows.append(rows[0])
    got = text_statistics(docs(spark, rows).repartition(3), common(spark))
    found = {r.doc_id: r.asDict() for r in got.collect()}
    assert len(found) == len(rows)
    for i, t in enumerate(rows):
        expected = brute(t)
        mine = {k: v for k, v in found[i].items() if k != "doc_id"}
        assert mine == (expected or dict.fromkeys(mine)), repr(t)
    broken = {(r.doc_id, f) for r in got.select("doc_id", broken_bounds().alias("faults")).collect() for f in r.faults}
    assert broken == {(i, f) for i, t in enumerate(rows) for f in faults(brute(t))}


def test_empty_tables_and_repeated_ids(spark):
    assert text_statistics(docs(spark, []), common(spark)).count() == 0
    assert assess(docs(spark, []), common(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1)], "doc_id long, text string, word int")
    assert [r.n_common for r in text_statistics(twice, common(spark, [])).collect()] == [0, 0]


def test_kinds_of_held_out_texts(spark):
    """The mixture is fitted without labels; texts of known making must get the kind they are of."""
    rng, rows, truth = random.Random(4), [], []
    nouns = "river boat garden lamp engine ticket farmer window harbor letter signal".split()
    verbs = "was is had saw took left kept found".split()

    def sentence():
        return f"The {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(verbs)} in the {rng.choice(nouns)} and it {rng.choice(verbs)} to a {rng.choice(nouns)}."

    for _ in range(120):
        rows.append(" ".join(sentence() for _ in range(rng.randint(3, 12))))
        truth.append("prose")
    for _ in range(60):
        rows.append("\n".join(f"• {rng.choice(nouns)} {rng.choice(nouns)} {rng.choice(nouns)}" for _ in range(rng.randint(5, 14))))
        truth.append("list")
    for _ in range(60):
        rows.append("\n".join(f"| {rng.choice(nouns)} | {rng.randrange(9999)} | {rng.random() * 900:.2f} |" for _ in range(rng.randint(5, 14))))
        truth.append("table")
    for _ in range(60):
        rows.append(" ".join(f"{rng.getrandbits(80):020x}" for _ in range(rng.randint(6, 30))))
        truth.append("junk")
    found = assess(docs(spark, [*rows, None, "??"]).repartition(2), common(spark)).collect()
    got = {r.doc_id: r.kind for r in found}
    assert {(r.doc_id, f) for r in found for f in r.faults} == {(i, f) for i, t in enumerate([*rows, None, "??"]) for f in faults(brute(t))}
    assert got[len(rows)] is None and got[len(rows) + 1] == "junk"
    right = sum(got[i] == t for i, t in enumerate(truth))
    assert right >= 0.95 * len(rows), {(t, got[i]) for i, t in enumerate(truth)}
