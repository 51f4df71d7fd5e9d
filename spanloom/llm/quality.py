"""Text statistics that tell prose from lists, tables and junk, and a mixture model over them.

The statistics are JVM expressions over each whole text, without a shuffle. The model is a Gaussian
mixture, fitted by expectation-maximisation over the standardised statistics of all documents: each
round every task sums its documents' responsibilities and moments, the sums are added up by cell,
and only the model's few thousand numbers reach the driver. There are more components than kinds,
one for each shape of text that was inspected; they are named after the examples they take up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.parallel import spread
from spanloom.storage import store

WORD = r"[\p{L}\p{N}]+"
_LINE = r"[^\n]*[^ \t\r\n][^\n]*"
_LINE_END = r"[.!?…。][ \t\r]*(?=\n|\z)"
_CODE = r"[^\[\](){}<>=_\"'\\]+"
MOST_LITERALS = 5_000
_MARKED = r"(?m)^[ \t]*(?:[-*•–+]|[0-9]{1,4}[.)])[ \t]+(?=\S)"
FEATURES = ("log_words", "word_length", "symbols", "line_ends", "common_words", "log_line_words", "digits", "code_marks", "marked_lines")

#: Inspected examples of each kind, in the shapes that the corpus has; the second field tells the shapes apart.
EXAMPLES = [
    ("prose", "en", "The committee met in the morning and heard both sides. After a short break it was decided that the plan should be changed. Nobody was surprised by this, as the old plan had failed twice."),
    ("prose", "en", "No office from Varnholt has opened the letter since day 14. When the first pump failed, Temmerik ordered a valve for 3300 litres. Each room in the report had 43 more chairs than the hall of Ostrava.\n\nWhich door did they need before the key was found? It was not the guard but the cook that had it."),
    ("prose", "headed", "# On the river\n\nWhen the rain stopped, we walked down to the bridge. The water was high and it had carried away the small boat that was tied there. We waited until the evening for someone to pass."),
    ("prose", "headed", "# Stable Garden Of Varnholt\n\nOnly 97 of the tickets were sold at the gate of Temmerik. From Ostrava to Varnholt the water rose by 62 litres.\n\nAfter the guard had counted the chairs, the hall was closed slowly."),
    ("prose", "wrapped", "Each answer in the report of Varnholt had 839 seconds\nmore than the manual one of Ostrava. The team says that\nthe old garden is one of two that\nTemmerik visited. It was closed in the evening and the\nkeys were given to the guard of the gate."),
    ("prose", "de", "Nach dem Essen ging die Gruppe in den Garten, und der alte Mann erzählte von seiner Reise. Er sprach leise, aber alle hörten zu. Am Ende war es so still, dass man die Uhr im Haus hören konnte."),
    ("prose", "de", "# Garten von Varnholt\n\nFür die Gruppe ist das Ergebnis der Reise noch nicht bekannt. Nach dem Regen ist das Wasser auf 88 gestiegen und wird gemessen. Es war nicht der Koch, sondern der Wächter, der zu spät kam."),
    ("prose", "ko", "그리고 회의가 끝난 뒤 모두 다시 자리로 돌아갔다. 하지만 그 보고서는 아직 다 읽지 못한 것으로 보였다. 먼저 한 사람이 두 번째 장을 설명했다."),
    ("prose", "ko", "# Varnholt 정원 기록\n\n이 정원 및 다리 기록은 Ostrava 단계에서 모두 같은 것으로 조정했다. Temmerik 대한 보고서는 12 쪽이며 이 창고 통해 저장했다."),
    ("prose", "turns", "reader: In Varnholt, a long letter was read aloud by the guard.\nwriter: The letter of the cook and the answer were both shown to the group, at 60 pages each.\nreader: When the lamp failed, Temmerik brought another one."),
    ("list", "bullets", "• green lantern of the pier\n• three loose planks\n• rope and anchor of Varnholt\n• spare oars\n• a map of the northern shore\n• old compass"),
    ("list", "bullets", "- check the valve\n- refill the tank\n- note the pressure\n- call the desk of Temmerik\n- sign the sheet"),
    ("list", "ended", "* local supplier of Varnholt.\n* second quote of Ostrava.\n* The team at Temmerik counted 498 rows on the old sheet.\n* broken window of the hall.\n* final inspection of the gate."),
    ("list", "numbered", "1) local supplier of timber.\n2) second quote for paint.\n3) delivery on monday.\n4) broken window.\n5) final inspection."),
    ("list", "numbered", "1. early garden of Varnholt\n2. long letter of Ostrava\n3. It was not the cook but the guard that had the key\n4. low bridge of Temmerik\n5. steep road"),
    ("table", "pipes", "| worker | 120 | 4.5 | first gate of Varnholt |\n| helper | 88 | 13 | long road of Ostrava |\n| reader | 902.10 | 7 | old bridge |\n| writer | 41 | 66.02 | new hall |\n| tester | 5 | 310 | lamp |"),
    ("table", "pipes", "| kind | n | cost |\n| red | 51 | 7.25 |\n| blue | 40 | 9 |\n| green | 3 | 881.4 |\n| white | 70 | 12 |"),
    ("table", "separated", "name;count;price;unit\nworker;120;4.50;rows;upper shelf of Varnholt\nhelper;88;13;pages;lower shelf\nreader;902;7;calls;door side\nwriter;41;66;units;window"),
    ("table", "separated", "name,count,price,unit\nworker,120.4,4.50,rows,upper shelf of Ostrava\nhelper,88,1330,pages,lower shelf\nreader,902.1,7,calls,door side\nwriter,41,6602,units,window of Temmerik"),
    ("table", "columns", "name\tcount\tprice\tunit\nworker\t120\t4.50\trows\nhelper\t88\t13\tpages\nreader\t902\t7\tcalls\nwriter\t41\t66\tunits"),
    ("table", "columns", "name  count  price  unit\nworker  5171  75  grams\nhelper  32  7437  pages\nreader  6955  2818  rows\nwriter  7967  1192  units\ntester  625.77  394.95  tickets"),
    ("junk", "hex", "9f86d081884c7d659a2f eaa0c55ad015a3bf4f1b 2b0b822cd15d6c15b0f0 0a08bd3c9a1e55f07c22 d4735e3a265e16eee03f 59718b9b5d03019c07d8"),
    ("junk", "code", "def handler(state):\n    value = state['value']\n    if state.get('limit', 300) > 12:\n        return 'stop'\n    return {'count': 7, 'ok': True}  # next"),
    ("junk", "code", "class Step:\n    def run(self, value, limit=10):\n        if value['size'] >= limit:\n            raise ValueError('too_large')\n        return {'size': value['size'] + 1}"),
    ("junk", "state", '{\n  "topic": "weekly report of Varnholt",\n  "messages": [\n    {"role": "user", "content": null},\n    {"role": "tool", "id": "call_81", "args": {"q": "x", "limit": 5}}\n  ],\n  "loop_count": 2\n}'),
    ("junk", "state", '{\n  "topic": "long letter of Ostrava",\n  "research": "Varnholt counted the chairs of the hall, which were 66 in all. Over 19 rows were kept for the guests of the evening by the guard.",\n  "critique": "The answer of the cook is not in the report.",\n  "loop_count": 1\n}'),
    ("junk", "state line", '{"topic": "old bridge of Temmerik", "research": "The garden and the long road of Varnholt are the same place. The team at Ostrava moved 32 chairs into the hall when the first lamp failed.", "critique": "No source for the second claim.", "loop_count": 2}'),
    ("junk", "state line", '{"topic": "neuer Garten von Varnholt", "research": "Nach dem Regen ist das Wasser auf 88 gestiegen und wird gemessen. Der Koch kam zu spät.", "loop_count": 1, "route": "end"}'),
    ("junk", "log", "2026-01-05T10:22 INFO [reader] span=4be1c9d2a7703f10 tokens=512 start of Varnholt\n2026-01-05T10:23 WARN [writer] span=90aa7cd0e51b2277 tokens=77 retry\n2026-01-05T10:25 INFO [reader] span=00ff31c8d9ab6e42 tokens=1033 done"),
    ("junk", "marks", "??? ### !!! --- *** /// +++ === ~~~ %%% x1 ;; :: ,, <> [] {} ^^ $$ @@"),
]


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Counts of each document's text; all of it, whatever its length.

    Output: ``doc_id``, ``n_chars`` (code points), ``n_words``, ``word_chars``, ``n_symbols``
    (neither letter or digit nor space, tab, line feed or carriage return), ``n_lines`` (with more
    than blanks), ``n_ended`` (lines that end in a full stop or the like), ``n_common``, ``n_digits``
    (category N), ``n_code`` (brackets, quotes, equals signs and the like) and ``n_marked`` (lines that
    begin with a bullet or number). All counts of a null text are null, those of an empty one 0.
    Repeated rows repeat; other columns, also those called like the output's, are ignored. Null words
    in the list don't count.

    A list of up to ``MOST_LITERALS`` words becomes part of the expression, a longer one is joined.
    """
    t = F.col("text")
    found = F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), 1)
    docs = spread(documents.select("doc_id", "text"))
    listed = common_words.select(F.lower("word").alias("word")).where("word IS NOT NULL").distinct()
    short = [r.word for r in listed.limit(MOST_LITERALS + 1).collect()]
    if len(short) <= MOST_LITERALS:
        n_common: Column = F.size(F.filter(found, lambda w: w.isin(short))) if short else F.lit(0)
    else:
        key = (F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), F.length("text").alias("l"))
        counted = docs.select(*key, "text").dropDuplicates(["k", "h", "l"]).select("k", "h", "l", F.explode(found).alias("word"))
        counted = counted.groupBy("k", "h", "l", "word").count().join(listed, "word").groupBy("k", "h", "l").agg(F.sum("count").alias("c"))
        docs = docs.withColumns(dict(zip(("h", "l"), key[1:]))).join(
            counted.withColumnsRenamed({"h": "h2", "l": "l2"}), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("h2")) & (F.col("l") == F.col("l2")), "left"
        )
        n_common = F.coalesce("c", F.lit(0))
    counts = {
        "n_chars": F.length(t),
        "n_words": F.regexp_count(t, F.lit(WORD)),
        "word_chars": F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")),
        "n_symbols": F.length(F.regexp_replace(t, r"[\p{L}\p{N} \t\n\r]+", "")),
        "n_lines": F.regexp_count(t, F.lit(_LINE)),
        "n_ended": F.regexp_count(t, F.lit(_LINE_END)),
        "n_common": n_common,
        "n_digits": F.length(F.regexp_replace(t, r"[^\p{N}]+", "")),
        "n_code": F.length(F.regexp_replace(t, _CODE, "")),
        "n_marked": F.regexp_count(t, F.lit(_MARKED)),
    }
    return docs.select("doc_id", *(F.when(t.isNotNull(), c).cast("long").alias(n) for n, c in counts.items()))


def broken_bounds() -> Column:
    """The names of the bounds that a document's statistics break.

    A text without words breaks ``few_words`` only, a null text nothing. Shares are compared as
    whole numbers.
    """
    some = F.col("n_words") > 0
    faults = {
        "few_words": F.col("n_words") < 25,
        "word_length": some & ((2 * F.col("word_chars") < 5 * F.col("n_words")) | (2 * F.col("word_chars") > 15 * F.col("n_words"))),
        "symbols": some & (100 * F.col("n_symbols") > 8 * F.col("n_chars")),
        "line_ends": some & (10 * F.col("n_ended") < 4 * F.col("n_lines")),
        "common_words": some & (100 * F.col("n_common") < 15 * F.col("n_words")),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in faults.items())))


def features() -> Column:
    """The numbers the mixture is fitted to; null for texts without words. Small shares are spread by logarithms."""
    words, lines, chars = F.col("n_words"), F.greatest("n_lines", F.lit(1)), F.col("n_chars")
    rare = lambda c: F.log(F.lit(0.002) + F.col(c) / chars)
    x = F.array(
        F.log1p(words),
        F.col("word_chars") / words,
        rare("n_symbols"),
        F.col("n_ended") / lines,
        F.col("n_common") / words,
        F.log1p(words / lines),
        rare("n_digits"),
        rare("n_code"),
        F.least(F.col("n_marked") / lines, F.lit(1.0)),
    )
    return F.when(words > 0, x)


@dataclass
class Mixture:
    mean: np.ndarray  # of the corpus
    scale: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    covariances: np.ndarray
    kinds: list[str] | None = None

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(documents, components): weighted log densities of raw feature rows."""
        z = (x - self.mean) / self.scale
        out = np.empty((len(z), len(self.weights)))
        for k, (w, c, s) in enumerate(zip(self.weights, self.centres, self.covariances)):
            root = np.linalg.cholesky(s)
            y = np.linalg.solve(root, (z - c).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * z.shape[1] * np.log(2 * np.pi)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((np.log(total) + top).sum())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(FEATURES)).astype(np.float64)


def _moments(model: Mixture):
    k, d = model.centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k * (1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                r, fit = model.responsibilities(x)
                z = (x - model.mean) / model.scale
                total[0] += fit
                total[1:] += np.concatenate([r.sum(axis=0), (r.T @ z).ravel(), np.einsum("nk,ni,nj->kij", r, z, z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "v"])

    return run


def fit_mixture(table: DataFrame, examples: list[tuple[str, str, np.ndarray]], rounds: int = 40, tolerance: float = 3e-3) -> Mixture:
    """Fits one component per example group, starting from the groups' means; ``table`` has ``x``.

    Ends once a round adds less than ``tolerance`` to the mean log-likelihood of a document.
    """
    d = len(FEATURES)
    first = table.select(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)), F.count("*").alias("n")).first()
    n = first["n"]
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([first[f"s{i}"] or 1.0 for i in range(d)])
    groups = list(dict.fromkeys((kind, g) for kind, g, _ in examples))
    centres = np.array([np.mean([(x - mean) / scale for kind, g, x in examples if (kind, g) == group], axis=0) for group in groups])
    k = len(groups)
    model = Mixture(mean, scale, np.full(k, 1 / k), centres, np.tile(0.3 * np.eye(d), (k, 1, 1)))
    last = -np.inf
    for _ in range(rounds if n else 0):
        cells = table.select("x").mapInArrow(_moments(model), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(1 + k * (1 + d + d * d))
        for c in cells:
            total[c.cell] = c.v
        mass, sums, squares = total[1 : 1 + k], total[1 + k : 1 + k + k * d].reshape(k, d), total[1 + k + k * d :].reshape(k, d, d)
        held = mass > 1e-6 * n  # a component without documents stays where it is
        safe = np.where(held, mass, 1.0)
        new = np.where(held[:, None], sums / safe[:, None], model.centres)
        scatter = squares / safe[:, None, None] - np.einsum("ki,kj->kij", new, new)
        model.covariances = np.where(held[:, None, None], (scatter + scatter.transpose(0, 2, 1)) / 2 + 1e-2 * np.eye(d), model.covariances)
        model.centres, model.weights = new, mass / n
        if total[0] - last <= tolerance * n:
            break
        last = total[0]
    return model


def name_components(model: Mixture, examples: list[tuple[str, str, np.ndarray]]) -> None:
    """Each component gets the kind whose examples it takes up most, else that of the nearest one."""
    kinds = list(dict.fromkeys(kind for kind, *_ in examples))
    x = np.array([e for *_, e in examples])
    r, _ = model.responsibilities(x)
    near = model.log_densities(x)
    of = np.array([kinds.index(kind) for kind, *_ in examples])
    share = np.array([r[of == i].mean(axis=0) for i in range(len(kinds))])
    model.kinds = [kinds[int(share[:, c].argmax())] if share[:, c].max() > 1e-3 else kinds[of[int(near[:, c].argmax())]] for c in range(len(model.weights))]


def assess(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Each document's statistics (see ``text_statistics``), ``kind`` (prose, list, table, junk),
    ``component``, ``probability`` of the kind, and ``faults``: the bounds of prose that it breaks.

    The mixture is fitted to all documents with words. Texts without words are junk of component -1,
    null texts have a null kind and no faults.
    """
    spark = documents.sparkSession
    shown = spark.createDataFrame([(i, t) for i, (*_, t) in enumerate(EXAMPLES)], "doc_id long, text string")
    seen = {r.doc_id: np.array(r.x) for r in text_statistics(shown, common_words).select("doc_id", features().alias("x")).collect()}
    examples = [(kind, group, seen[i]) for i, (kind, group, _) in enumerate(EXAMPLES)]
    counted = text_statistics(documents, common_words)
    table = store(counted.withColumns({"faults": broken_bounds(), "x": features()}), "features").df
    model = fit_mixture(table.where("x IS NOT NULL"), examples)
    name_components(model, examples)
    out = table.drop("x").withColumns({"kind": F.lit(None).cast("string"), "component": F.lit(None).cast("int"), "probability": F.lit(None).cast("double")}).schema

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.kinds)
        kinds = np.array(sorted(set(model.kinds)))
        for batch in batches:
            known = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
            words = np.nan_to_num(batch.column("n_words").to_numpy(zero_copy_only=False), nan=-1)
            kind = np.where(words == 0, "junk", None).astype(object)
            component = np.full(batch.num_rows, -1, np.int32)
            share = np.ones(batch.num_rows)
            if known.any():
                r, _ = model.responsibilities(_matrix(batch.column("x").drop_null()))
                by_kind = np.stack([r[:, names == k].sum(axis=1) for k in kinds], axis=1)
                kind[known], component[known], share[known] = kinds[by_kind.argmax(axis=1)], r.argmax(axis=1), by_kind.max(axis=1)
            none = words < 0
            columns = [batch.column(f.name) for f in out.fields[:-3]]
            columns += [pa.array(kind, pa.string()), pa.array(component, pa.int32(), mask=none), pa.array(share, pa.float64(), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out.fields])

    return table.mapInArrow(classify, out)
