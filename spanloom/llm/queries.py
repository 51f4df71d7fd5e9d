"""Queries of the training-data problems, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import span_name
from spanloom.llm.leakage import leaked_items
from spanloom.llm.near_duplicates import near_duplicates
from spanloom.llm.patterns import frequent_subsequences
from spanloom.llm.quality import assess, text_statistics
from spanloom.llm.runs import event_runs
from spanloom.llm.tokenizer import encode_corpus
from spanloom.operators.events import current_spans
from spanloom.sources.tables import table


def _patterns(spark: SparkSession, d: str, longer: bool = False) -> tuple[DataFrame, DataFrame]:
    spans = table(spark, d, "spans")
    traces = spans.select("trace_id").where("trace_id IS NOT NULL").distinct().count()
    current = current_spans(spans, "parent_span_id", "start_time", "pos", name=span_name("agent_or_node_id"))
    return frequent_subsequences(current.where("parent_span_id <> ''"), n_sequences=traces, longer=longer)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Orders of three to five node names that recur in enough traces."""
    return _patterns(spark, d)[0].select("steps")


def p1_supports(spark: SparkSession, d: str) -> DataFrame:
    """The same with the number of traces each occurs in."""
    return _patterns(spark, d)[0]


def p1_closed(spark: SparkSession, d: str) -> DataFrame:
    """The closed patterns of any length, from which all others follow."""
    return _patterns(spark, d, longer=True)[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three events of one name, from the programme of near-identical runs."""
    return p3_runs(spark, d).where("n_events >= 3").select("trace_id", "first_span_id", "last_span_id")


def _shown_runs(runs: DataFrame) -> DataFrame:
    micros = {"first_us": F.unix_micros("first_start"), "last_us": F.unix_micros("last_start")}
    return runs.withColumns(micros).drop("first_start", "last_start")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run of one name, with its number of events and its time: the stretches of the near-identical runs."""
    return _shown_runs(event_runs(table(spark, d, "spans"), max_dissimilarity=0.35, by_name=True)).drop("representative")


def p3_similar_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of names that differ by few letters."""
    return _shown_runs(event_runs(table(spark, d, "spans"), max_dissimilarity=0.35))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spans whose texts share at least 0.6 of their three-word shingles."""
    return near_duplicates(table(spark, d, "spans")).span_pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups that the pairs form, and each span's number of partners."""
    return near_duplicates(table(spark, d, "spans")).groups()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by the byte_bpe_50k vocabulary."""
    import public_tokenizers

    return encode_corpus(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def p6_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of every document."""
    return p6_ids(spark, d).selectExpr("doc_id", "size(ids) AS n_tokens")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold twelve consecutive words: alignments that score enough, checked."""
    runs = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), only_runs=True)
    return runs.where("longest_run >= 12").select("doc_id", "item_id").distinct()


def p7_aligned(spark: SparkSession, d: str) -> DataFrame:
    """All documents that align with an item as well as twelve words in a row, edited passages included."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("share", F.round("share", 6))


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return assess(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of natural prose that each document breaks."""
    return _assessed(spark, d).select("doc_id", F.explode("faults").alias("fault"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The counts behind every document's statistics; 0 where there is no text."""
    return _statistics(spark, d).withColumn("has_text", F.col("n_chars").isNotNull()).fillna(0)


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Prose, list, table or junk, by the mixture fitted to all documents."""
    return _assessed(spark, d).select("doc_id", "kind", "component", "probability")


_CURRENT = """current_spans AS (
  SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ingested_at DESC, pos DESC) = 1
)"""

_RUNS = f"""WITH {_CURRENT}, named AS (
  SELECT *, nullif(lower(regexp_replace(agent_or_node_id, '[^\\p{{L}}]', '', 'g')), '') AS nm FROM current_spans WHERE start_time IS NOT NULL
), marked AS (
  SELECT *, CASE WHEN nm = lag(nm) OVER w AND epoch_us(start_time) - epoch_us(lag(start_time) OVER w) <= 300000000 THEN 0 ELSE 1 END AS fresh
  FROM named WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, pos, span_id)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY start_time, pos, span_id ROWS UNBOUNDED PRECEDING) AS run FROM marked
), runs AS (
  SELECT trace_id, arg_min(span_id, (start_time, pos, span_id)) AS first_span_id, arg_max(span_id, (start_time, pos, span_id)) AS last_span_id,
         any_value(nm) AS node, count(*) AS n_events, epoch_us(min(start_time)) AS first_us, epoch_us(max(start_time)) AS last_us,
         (epoch_us(max(start_time)) - epoch_us(min(start_time))) / 1e6 AS seconds
  FROM numbered WHERE nm IS NOT NULL GROUP BY trace_id, run
)"""

#: The programme of near-identical runs, event by event, with the representatives chosen so far.
_SIMILAR = f"""WITH RECURSIVE {_CURRENT}, named AS (
  SELECT *, nullif(lower(regexp_replace(agent_or_node_id, '[^\\p{{L}}]', '', 'g')), '') AS nm FROM current_spans WHERE start_time IS NOT NULL
), marked AS (
  SELECT *, CASE WHEN lag(nm) OVER w IS NOT NULL AND epoch_us(start_time) - epoch_us(lag(start_time) OVER w) <= 300000000 THEN 0 ELSE 1 END AS fresh
  FROM named WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, pos, span_id)
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY start_time, pos, span_id ROWS UNBOUNDED PRECEDING) AS island FROM marked
), ev AS (
  SELECT trace_id, island, span_id, start_time, nm, row_number() OVER (PARTITION BY trace_id, island ORDER BY start_time, pos, span_id) AS t FROM islands WHERE nm IS NOT NULL
), vocabulary AS (SELECT DISTINCT nm FROM ev WHERE nm IS NOT NULL), near AS (
  SELECT a.nm, b.nm AS rep, levenshtein(a.nm, b.nm) * 1000000 // greatest(length(a.nm), length(b.nm)) AS d
  FROM vocabulary a JOIN vocabulary b ON levenshtein(a.nm, b.nm) / greatest(length(a.nm), length(b.nm)) <= 0.35
), state AS (
  SELECT trace_id, island, t, rep, d AS cost, [rep] AS labels FROM ev JOIN near USING (nm) WHERE t = 1
  UNION ALL
  SELECT e.trace_id, e.island, e.t, n.rep, n.d + CASE WHEN s.cost <= b.cost + 1000000 THEN s.cost ELSE b.cost + 1000000 END,
         list_append(CASE WHEN s.cost <= b.cost + 1000000 THEN s.labels ELSE b.labels END, n.rep)
  FROM (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY trace_id, island ORDER BY cost, rep) = 1) b
  JOIN ev e ON e.trace_id = b.trace_id AND e.island = b.island AND e.t = b.t + 1
  JOIN near n ON n.nm = e.nm
  LEFT JOIN state s ON s.trace_id = b.trace_id AND s.island = b.island AND s.rep = n.rep
), ends AS (
  SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY trace_id, island ORDER BY t DESC, cost, rep) = 1
), chosen AS (
  SELECT e.*, c.labels[e.t] AS node FROM ends c JOIN ev e ON e.trace_id = c.trace_id AND e.island = c.island
), turns AS (
  SELECT *, CASE WHEN node = lag(node) OVER (PARTITION BY trace_id, island ORDER BY t) THEN 0 ELSE 1 END AS turn FROM chosen
), runs AS (
  SELECT *, sum(turn) OVER (PARTITION BY trace_id, island ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM turns
)"""


#: Seeds, the words around them, and the plain recurrence of the alignment, one word of the item a step.
_ALIGNED = r"""WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL
), dg AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM dw, unnest(range(1, len(w) - 3)) AS t(i)
), ig AS (
  SELECT item_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM iw, unnest(range(1, len(w) - 3)) AS t(i)
), hits AS (
  SELECT DISTINCT doc_id, item_id, dg.i - ig.i AS b, len(iw.w) AS n FROM dg JOIN ig USING (g) JOIN iw USING (item_id)
), marked AS (
  SELECT *, CASE WHEN b <= lag(b) OVER w + n + 32 THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY b)
), placed AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS part FROM marked
), regions AS (
  SELECT row_number() OVER () AS r, doc_id, item_id, n, greatest(0, min(b) - 16) AS lo, max(b) + n + 16 AS hi FROM placed GROUP BY doc_id, item_id, n, part
), words AS (
  SELECT r, n, item_id, lo, j, dw.w[lo + j] AS word FROM regions JOIN dw USING (doc_id), unnest(range(1, least(len(dw.w), hi) - lo + 1)) AS t(j)
), cells AS (
  SELECT r, 0::BIGINT AS i, j, word, item_id, n, 0::BIGINT AS h, 0::BIGINT AS run FROM words
  UNION ALL
  SELECT r, i, j, word, item_id, n, greatest(0, max(h + j) OVER (PARTITION BY r ORDER BY j) - j)::BIGINT, run FROM (
    SELECT c.r, c.i + 1 AS i, c.j, c.word, c.item_id, c.n,
           greatest(0, coalesce(lag(c.h) OVER w, 0) + CASE WHEN c.word = iw.w[c.i + 1] THEN 2 ELSE -1 END, c.h - 1) AS h,
           CASE WHEN c.word = iw.w[c.i + 1] THEN coalesce(lag(c.run) OVER w, 0) + 1 ELSE 0 END AS run
    FROM cells c JOIN iw USING (item_id) WHERE c.i < c.n WINDOW w AS (PARTITION BY c.r ORDER BY c.j)
  )
), best AS (
  SELECT r, max(h) AS score, arg_min(j, (-h, i, j)) AS j, max(run) AS run FROM cells GROUP BY r
), pairs AS (
  SELECT doc_id, item_id, n, max(score) AS score, arg_min(lo + j, (-score, lo)) AS at_word, max(run) AS longest_run FROM best JOIN regions USING (r) GROUP BY ALL
)"""


def _pairs_sql() -> str:
    """All pairs of spans that share a shingle, with their exact similarity."""
    return f"""WITH {_CURRENT}, w AS (
  SELECT span_id, regexp_extract_all(lower(coalesce(input_text, '') || chr(10) || coalesce(output_text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM current_spans
), sh AS (
  SELECT DISTINCT span_id, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM (SELECT * FROM w WHERE len(w) >= 30), unnest(range(1, len(w) - 1)) AS t(i)
), sizes AS (SELECT span_id, count(*) AS n FROM sh GROUP BY span_id),
met AS (SELECT a.span_id AS x, b.span_id AS y, count(*) AS n FROM sh a JOIN sh b ON a.h = b.h AND a.span_id < b.span_id GROUP BY ALL), found AS (
  SELECT x AS span_id_a, y AS span_id_b FROM met JOIN sizes p ON p.span_id = x JOIN sizes q ON q.span_id = y WHERE 10 * met.n >= 6 * (p.n + q.n - met.n)
)"""


def _patterns_sql() -> str:
    """Leftmost ends of each frequent pattern in each trace, one item longer each time."""
    steps = [
        f"""WITH {_CURRENT}, ev AS (
  SELECT trace_id, nullif(lower(regexp_replace(agent_or_node_id, '[^\\p{{L}}]', '', 'g')), '') AS nm,
         row_number() OVER (PARTITION BY trace_id ORDER BY start_time, pos, span_id) AS seq
  FROM current_spans WHERE start_time IS NOT NULL AND parent_span_id <> ''
), least AS (SELECT greatest(6, ceil(6 * count(DISTINCT trace_id) / 100)) AS n FROM spans),
l1 AS (SELECT trace_id, nm AS p, min(seq) AS at FROM ev WHERE nm IS NOT NULL GROUP BY ALL)"""
    ]
    for k in range(1, 6):
        steps.append(f"f{k} AS (SELECT p, count(*) AS support FROM l{k} GROUP BY p HAVING count(*) >= (SELECT n FROM least))")
        if k < 5:
            steps.append(
                f"l{k + 1} AS (SELECT l.trace_id, l.p || '>' || ev.nm AS p, min(ev.seq) AS at FROM l{k} l JOIN f{k} USING (p) JOIN ev ON ev.trace_id = l.trace_id AND ev.seq > l.at"
                " WHERE ev.nm IN (SELECT p FROM f1) GROUP BY ALL)"
            )
    every = " UNION ALL ".join(f"SELECT p AS steps, {k} AS length, support FROM f{k}" for k in (3, 4, 5))
    return ", ".join(steps) + f", found AS ({every})"


_CLOSED = f"""WITH RECURSIVE {_CURRENT}, ev AS (
  SELECT trace_id, nullif(lower(regexp_replace(agent_or_node_id, '[^\\p{{L}}]', '', 'g')), '') AS nm,
         row_number() OVER (PARTITION BY trace_id ORDER BY start_time, pos, span_id) AS seq
  FROM current_spans WHERE start_time IS NOT NULL AND parent_span_id <> ''
), least AS (SELECT greatest(6, ceil(6 * count(DISTINCT trace_id) / 100)) AS n FROM spans),
first AS (
  SELECT * FROM (SELECT trace_id, nm, min(seq) AS reached FROM ev WHERE nm IS NOT NULL GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY nm) >= (SELECT n FROM least)
),
grown AS (
  SELECT trace_id, [nm] AS p, reached, count(*) OVER (PARTITION BY nm) AS support FROM first
  UNION ALL
  SELECT trace_id, p, reached, support FROM (
    SELECT *, count(*) OVER (PARTITION BY p) AS support FROM (
      SELECT g.trace_id, list_append(g.p, ev.nm) AS p, min(ev.seq) AS reached FROM grown g JOIN ev ON ev.trace_id = g.trace_id AND ev.seq > g.reached
      WHERE ev.nm IN (SELECT nm FROM first) GROUP BY ALL)
  ) WHERE support >= (SELECT n FROM least)
), found AS (SELECT p, any_value(support) AS support FROM grown GROUP BY p), shorter AS (
  SELECT DISTINCT list_concat(p[1:i - 1], p[i + 1:]) AS p, support FROM found, unnest(range(1, len(p) + 1)) AS t(i)
)"""


_STATISTICS = r"""WITH listed AS (
  SELECT list(DISTINCT lower(word)) AS ws FROM common_words WHERE word IS NOT NULL
), split AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w,
         list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS lines
  FROM documents
), stats AS (
  SELECT doc_id, text, length(text) AS n_chars, len(w) AS n_words,
         length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[\p{L}\p{N} \t\n\r]+', '', 'g')) AS n_symbols,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda l: right(l, 1) IN ('.', '!', '?', '…', '。'))) AS n_ended,
         len(list_filter(w, lambda x: list_contains(ws, x))) AS n_common,
         length(regexp_replace(text, '[^\p{N}]+', '', 'g')) AS n_digits,
         length(regexp_replace(text, '[^\[\](){}<>=_"''\\]+', '', 'g')) AS n_code,
         len(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*•–+]|[0-9]{1,4}[.)])[ \t]+\S')) AS n_marked
  FROM split, listed
)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_supports, p1_closed, p3_found, p3_runs, p3_similar_runs, p4_found, p4_groups, p6_ids, p6_lengths, p7_found, p7_aligned, p8_found, p8_statistics, p8_kinds)}

SQL = {
    "p1_closed": f"{_CLOSED} SELECT array_to_string(p, '>') AS steps, len(p) AS length, support FROM found WHERE (p, support) NOT IN (SELECT (p, support) FROM shorter)",
    "p3_similar_runs": f"""{_SIMILAR} SELECT trace_id, arg_min(span_id, t) AS first_span_id, arg_max(span_id, t) AS last_span_id, any_value(node) AS node, count(*) AS n_events,
  epoch_us(min(start_time)) AS first_us, epoch_us(max(start_time)) AS last_us, (epoch_us(max(start_time)) - epoch_us(min(start_time))) / 1e6 AS seconds
FROM runs GROUP BY trace_id, island, run""",
    "p7_aligned": f"""{_ALIGNED} SELECT doc_id, item_id, score, round(score / (2 * n), 6) AS share, longest_run, at_word
FROM pairs WHERE score >= least(24, n)""",
    "p1_found": f"{_patterns_sql()} SELECT steps FROM found",
    "p1_supports": f"{_patterns_sql()} SELECT * FROM found",
    "p4_found": f"{_pairs_sql()} SELECT * FROM found",
    "p4_groups": f"""{_pairs_sql().replace("WITH", "WITH RECURSIVE", 1)}, links AS (
  SELECT span_id_a AS a, span_id_b AS b FROM found UNION ALL SELECT span_id_b, span_id_a FROM found
), near AS (SELECT a, b FROM links UNION SELECT n.a, l.b FROM near n JOIN links l ON l.a = n.b),
least AS (SELECT a, min(b) AS b FROM near GROUP BY a)
SELECT trace_id, a AS span_id, least(a, b) AS group_id, (SELECT count(*) FROM links WHERE links.a = least.a) AS n_links FROM least JOIN current_spans ON span_id = a""",
    "p8_statistics": f"""{_STATISTICS}
SELECT doc_id, text IS NOT NULL AS has_text, coalesce(n_chars, 0) AS n_chars, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
       coalesce(n_symbols, 0) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_ended, 0) AS n_ended, coalesce(n_common, 0) AS n_common,
       coalesce(n_digits, 0) AS n_digits, coalesce(n_code, 0) AS n_code, coalesce(n_marked, 0) AS n_marked
FROM stats""",
    "p8_found": f"""{_STATISTICS}
SELECT doc_id, 'few_words' AS fault FROM stats WHERE n_words < 25
UNION ALL SELECT doc_id, 'word_length' FROM stats WHERE n_words > 0 AND (2 * word_chars < 5 * n_words OR 2 * word_chars > 15 * n_words)
UNION ALL SELECT doc_id, 'symbols' FROM stats WHERE n_words > 0 AND 100 * n_symbols > 8 * n_chars
UNION ALL SELECT doc_id, 'line_ends' FROM stats WHERE n_words > 0 AND 10 * n_ended < 4 * n_lines
UNION ALL SELECT doc_id, 'common_words' FROM stats WHERE n_words > 0 AND 100 * n_common < 15 * n_words""",
    "p3_found": f"{_RUNS} SELECT trace_id, first_span_id, last_span_id FROM runs WHERE n_events >= 3",
    "p3_runs": f"{_RUNS} SELECT * FROM runs",
    "p7_found": r"""WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items
), dg AS (
  SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM dw, unnest(range(1, len(w) - 10)) AS t(i)
), ig AS (
  SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM iw, unnest(range(1, len(w) - 10)) AS t(i)
) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
