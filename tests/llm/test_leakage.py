import random

import numpy as np
import pytest

from spanloom.functions.text import words
from spanloom.llm.leakage import align, align_many, leaked_items

DOCS = "doc_id long, text string, item_id long, score long"
ITEMS = "item_id long, item_text string, doc_id long, n int"


def brute_align(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    run = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            run[i][j] = run[i - 1][j - 1] + 1 if a == b else 0
    return max(map(max, h)), max(map(max, run))


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 15))]
        text = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        score, _, run = align(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert (score, run) == brute_align(item, text)


def brute_found(docs, items, span=12):
    grams = lambda t: {tuple(w[i : i + span]) for w in [words(t or "")] for i in range(len(w) - span + 1)}
    return {(d, i) for d, t, *_ in docs for i, x, *_ in items if grams(t) & grams(x)}


def tables(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "The", "is", "Über", "Σας"]) if rng.random() < 0.5 else f"w{rng.randrange(60)}"
    text = lambda n: [word() for _ in range(n)]
    items = [(i, text(rng.choice([3, 11, 12, 20, 60]))) for i in range(30)]
    items[1] = (1, items[4][1][:14] + items[1][1])  # two items share a passage
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 80))
        if d % 3 == 0:
            source = rng.choice(items)[1]
            at = rng.randrange(max(1, len(source) - 8))
            part = list(source[at : at + rng.choice([11, 12, 13, 40])])
            if d % 2:
                part[rng.randrange(len(part))] = "edited"
            where = rng.randrange(len(body) + 1)
            body[where:where] = part
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(body), 1, 1))
    docs += [(500, " ".join(items[4][1] * 30), 1, 1), (501, None, 1, 1), (502, "", 1, 1), (None, " ".join(items[4][1]), 1, 1)]
    return docs, [(i, " ".join(w), 1, 1) for i, w in items] + [(90, None, 1, 1), (91, "", 1, 1), (None, "", 1, 1)]


@pytest.mark.parametrize("seed,block", [(1, 5_000_000), (2, 300)])
def test_exact_passages_are_all_found(spark, seed, block):
    docs, items = tables(seed)
    found = leaked_items(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_chars=block)
    got = [(r.doc_id, r.item_id, r.longest_run) for r in found.collect()]
    assert len(got) == len(set(got))
    assert {(d, i) for d, i, run in got if run >= 12} == brute_found(docs, items)


def test_edited_copies_align(spark):
    item = " ".join(f"word{i}" for i in range(40))
    copy = [w for i, w in enumerate(item.split()) if i % 9 != 4]  # no twelve words in a row are left
    docs = [(1, "before it " + " ".join(copy) + " after it", 0, 0), (2, "nothing of it at all", 0, 0)]
    rows = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item, 0, 0)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 7)]
    assert rows[0].longest_run < 12 and rows[0].share > 0.75 and rows[0].at_word == 2 + len(copy)


def test_many_edited_copies_beside_an_exact_one(spark):
    item = " ".join(f"word{i}" for i in range(40))
    copy = " ".join(w for i, w in enumerate(item.split()) if i % 9 != 4)
    docs = [(d, copy, 0, 0) for d in range(12)] + [(99, item, 0, 0)]
    rows = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item, 0, 0)], ITEMS)).collect()
    assert {r.doc_id: r.longest_run >= 12 for r in rows} == {d: d == 99 for d in [*range(12), 99]}
    assert all(r.share > 0.75 for r in rows)


def test_every_pair_with_a_common_n_gram_and_its_alignment(spark):
    docs, items = tables(3)
    found = leaked_items(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_chars=300).collect()
    best = {(d, i): brute_align(words(x), words(t))[0] for d, t, *_ in docs for i, x, *_ in items if t and x and len(words(t)) < 200}
    wanted = {k for k in brute_found(docs, items, 5) if k in best and best[k] >= 2 * min(12, 0.5 * len(words(dict((i, x) for i, x, *_ in items)[k[1]])))}
    got = {(r.doc_id, r.item_id): r.score for r in found}
    assert got.keys() >= brute_found(docs, items)
    assert {k for k in got if k in best} <= wanted and len({k for k in got if k in best}) >= 0.97 * len(wanted)
    assert all(v <= best[k] for k, v in got.items() if k in best)
    runs = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), only_runs=True)
    assert {(r.doc_id, r.item_id) for r in runs.collect() if r.longest_run >= 12} == brute_found(docs, items)


@pytest.mark.parametrize("n_docs", [400, 2000])
def test_recall_of_edited_copies(spark, n_docs):
    """A share of an item's words replaced, dropped or doubled, inside other text, at two sizes of corpus."""
    rng = random.Random(n_docs)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60)), 0, 0) for i in range(20)]
    docs, planted = [], {}
    for d in range(n_docs):
        body = [f"w{rng.randrange(3000)}" for _ in range(120)]
        if d % 10 == 0:
            item, share = rng.choice(items), rng.choice([0.05, 0.1, 0.2])
            copy = [x for w in item[1].split() for x in ([w] if rng.random() >= share else rng.choice([[], [w, w], [f"w{rng.randrange(3000)}"]]))]
            body[50:50] = copy
            planted[d, item[0]] = share
        docs.append((d, " ".join(body), 0, 0))
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    for share in (0.05, 0.1, 0.2):
        mine = {k for k, s in planted.items() if s == share}
        assert len(mine & got) >= 0.9 * len(mine)
    assert got <= planted.keys()


def test_alignments_of_a_batch_equal_single_ones():
    rng = random.Random(4)
    some = lambda n: np.array([rng.randrange(6) for _ in range(n)], np.uint64)
    items, texts = [some(rng.randint(1, 15)) for _ in range(50)], [some(rng.randint(1, 25)) for _ in range(50)]
    for (score, _, run), i, t in zip(align_many(items, texts).tolist(), items, texts):
        assert (score, run) == brute_align(i.tolist(), t.tolist())


def test_empty_tables(spark):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    item = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"), 0, 0)], ITEMS)
    assert leaked_items(none_d, item).count() == leaked_items(none_d, none_i).count() == 0
