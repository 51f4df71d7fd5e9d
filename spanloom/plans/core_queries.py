"""Queries of the trace analytics operators, each with the SQL that must give the same rows.

All run over the whole ``spans`` table (current spans). Similarities are those of hash vectors, so no
model is needed. Integers that can be missing are shown as -1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scalars import after_prefix, holds_any, longest_leaf, normal_input, snippet
from spanloom.functions.vectors import hash_vector
from spanloom.operators import detect as det
from spanloom.operators import metrics as m
from spanloom.operators import preprocess as pre
from spanloom.operators import structural as st
from spanloom.operators import validate as val
from spanloom.operators.events import current_spans, numbered
from spanloom.operators.hierarchy import topology, tree_edges
from spanloom.schema import MODEL
from spanloom.sinks import NOTE, json_reports, markdown_reports, trace_texts
from spanloom.sources.otel import otel_spans
from spanloom.sources.tables import table
from spanloom.streaming.live import node_activity as activity

PHI = 0.8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_COLUMNS = (
    "parent_span_id", "agent_or_node_id", "span_kind", "start_time", "end_time", "input_text", "output_text", "token_count", "model", "cost_rate", "pos",
)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def spans(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_spans(table(spark, d, "spans"), *(columns or _COLUMNS))


def narrow(spark: SparkSession, d: str) -> DataFrame:
    return st.current_narrow(table(spark, d, "spans"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return st.candidate_pairs(narrow(spark, d))


def details(spark: SparkSession, d: str, phi: float = PHI) -> DataFrame:
    return det.waste_details(det.scored_pairs(pairs(spark, d)), phi)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return m.clean_labels(table(spark, d, "trace_labels"))


def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return m.split_pairs(det.scored_pairs(pairs(spark, d)), labels(spark, d))


_CS = """cs AS (
  SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ingested_at DESC, pos DESC) = 1
)"""
_ORD = "ORDER BY start_time, pos, span_id"
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_U = f"""{_CS}, u AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id {_ORD}) AS seq,
         row_number() OVER (PARTITION BY trace_id, agent_or_node_id {_ORD}) AS occ,
         count(*) OVER (PARTITION BY trace_id, agent_or_node_id) AS n_node,
         replace(replace(lower({_strip("input_text")}), 'ß', 'ss'), 'ς', 'σ') AS inp
  FROM cs WHERE trace_id IS NOT NULL AND agent_or_node_id IS NOT NULL AND start_time IS NOT NULL
)"""


def _repeat(n: int) -> str:
    return f"""SELECT o.trace_id, o.span_id AS origin_id, c.span_id AS candidate_id,
       CASE WHEN o.span_kind = 'tool' THEN 'requery' ELSE 'repeat' END AS rule, 0 AS r, o.seq AS x, c.seq AS y
  FROM u o JOIN u c ON o.trace_id = c.trace_id AND o.agent_or_node_id = c.agent_or_node_id AND o.occ = 1 AND c.occ > 1
  WHERE c.n_node >= {n} AND (o.span_kind IS DISTINCT FROM 'tool' OR o.inp IS NOT DISTINCT FROM c.inp)"""


_PING = """SELECT trace_id, CASE part WHEN 0 THEN span_id ELSE s1 END AS origin_id, CASE part WHEN 0 THEN s2 ELSE s3 END AS candidate_id,
       'pingpong' AS rule, 1 AS r, seq AS x, part AS y
  FROM (SELECT trace_id, span_id, seq, agent_or_node_id AS n0,
               lead(agent_or_node_id, 1) OVER w AS n1, lead(agent_or_node_id, 2) OVER w AS n2, lead(agent_or_node_id, 3) OVER w AS n3,
               lead(span_id, 1) OVER w AS s1, lead(span_id, 2) OVER w AS s2, lead(span_id, 3) OVER w AS s3
        FROM u WINDOW w AS (PARTITION BY trace_id ORDER BY seq)), (VALUES (0), (1)) AS t(part)
  WHERE n0 = n2 AND n1 = n3 AND n0 <> n1"""
_PAIRS = f"""{_U}, pairs AS (
  SELECT * FROM ({_repeat(2)} UNION ALL {_PING}) QUALIFY row_number() OVER (PARTITION BY trace_id, origin_id, candidate_id ORDER BY r, x, y) = 1
)"""


def _vector(x: str) -> str:
    h = f"sha256({x})"
    digit = lambda i: f"(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
    return f"list_transform(range(0, 16), lambda i: ({digit('2 * i + 1')} * 16 + {digit('2 * i + 2')}) / 255.0::DOUBLE)"


_SCORED = f"""{_PAIRS}, vecs AS (
  SELECT trace_id, span_id, agent_or_node_id, token_count, cost_rate, {_vector("coalesce(output_text, '')")} AS v FROM u
), scored AS (
  SELECT p.*, o.agent_or_node_id AS origin_node, c.agent_or_node_id AS repeat_node, c.token_count AS waste_tokens, c.cost_rate,
         c.token_count * c.cost_rate AS waste_cost, list_cosine_similarity(o.v, c.v) AS cosine
  FROM pairs p JOIN vecs o ON p.trace_id = o.trace_id AND p.origin_id = o.span_id JOIN vecs c ON p.trace_id = c.trace_id AND p.candidate_id = c.span_id
)"""
_DETAILS = f"""{_SCORED}, hit AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id, candidate_id ORDER BY cosine DESC, r, x, y) AS best,
         first_value((r, x, y)) OVER (PARTITION BY trace_id, candidate_id ORDER BY r, x, y) AS first
  FROM scored WHERE cosine >= {PHI}
), details AS (SELECT * FROM hit WHERE best = 1)"""
_VERDICTS = f"""{_DETAILS}, verdicts AS (
  SELECT t.trace_id, count(d.candidate_id) > 0 AS wasteful, count(d.candidate_id) AS waste_spans,
         coalesce(sum(coalesce(d.waste_tokens, 0)) FILTER (d.candidate_id IS NOT NULL), 0)::BIGINT AS waste_tokens,
         coalesce(sum(coalesce(d.waste_tokens, 0) * coalesce(d.cost_rate, 0)), 0)::DOUBLE AS waste_cost
  FROM (SELECT DISTINCT trace_id FROM cs) t LEFT JOIN details d USING (trace_id) GROUP BY t.trace_id
)"""
_LABELS = """labels AS (
  SELECT trace_id, max(label_class) AS label_class, max(waste_pattern) AS waste_pattern,
         list_distinct(flatten(list(coalesce(waste_span_ids, [])))) AS ids
  FROM trace_labels WHERE trace_id IS NOT NULL AND label_class IS NOT NULL GROUP BY trace_id
)"""
_SPLIT = f"""{_SCORED}, {_LABELS}, split AS (
  SELECT s.*, label_class = 'positive' AND list_contains(ids, candidate_id) AS dup FROM scored s JOIN labels USING (trace_id)
)"""


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {_CS} SELECT trace_id, span_id, parent_span_id, agent_or_node_id, span_kind, coalesce(epoch_us(start_time), -1) AS start_us, coalesce(token_count, -1) AS tokens FROM cs")
def spans_current(spark: SparkSession, d: str) -> DataFrame:
    """The current version of each span."""
    df = spans(spark, d, "parent_span_id", "agent_or_node_id", "span_kind", "start_time", "token_count")
    return df.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "agent_or_node_id",
        "span_kind",
        F.coalesce(F.unix_micros("start_time"), F.lit(-1)).alias("start_us"),
        F.coalesce("token_count", F.lit(-1)).alias("tokens"),
    )


@query(f"WITH {_CS} SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id {_ORD}) AS seq FROM cs WHERE start_time IS NOT NULL")
def ordered_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Each event's place in its trace."""
    return numbered(spans(spark, d, "start_time", "pos")).select("trace_id", "span_id", "seq")


@query(f"WITH {_U} SELECT trace_id, origin_id, candidate_id, rule FROM ({_repeat(2)})")
def repeat_pairs_n2(spark: SparkSession, d: str) -> DataFrame:
    """Later spans of a node with its first one."""
    return st.shown(st.repeat_pairs(narrow(spark, d), 2), "rule")


@query(f"WITH {_U} SELECT trace_id, origin_id, candidate_id, rule FROM ({_repeat(3)})")
def repeat_pairs_n3(spark: SparkSession, d: str) -> DataFrame:
    """The same for nodes with at least three spans."""
    return st.shown(st.repeat_pairs(narrow(spark, d), 3), "rule")


@query(f"WITH {_U} SELECT trace_id, origin_id, candidate_id FROM ({_PING})")
def pingpong_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Alternations of two nodes, overlapping windows included."""
    return st.shown(st.pingpong_pairs(narrow(spark, d)))


@query(f"WITH {_PAIRS} SELECT trace_id, origin_id, candidate_id, rule FROM pairs")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of pairs, each once."""
    return st.shown(pairs(spark, d), "rule")


@query(f"WITH {_CS} SELECT trace_id, span_id, i - 1 AS i, round(v[i], 6) AS x FROM (SELECT trace_id, span_id, {_vector('output_text')} AS v FROM cs WHERE output_text IS NOT NULL), unnest(range(1, 17)) AS t(i)")
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The hash vector of each output, an element a row."""
    df = spans(spark, d, "output_text").where("output_text IS NOT NULL").select("trace_id", "span_id", F.posexplode(hash_vector(F.col("output_text"))).alias("i", "x"))
    return _round(df, "x")


@query(f"WITH {_SCORED} SELECT trace_id, origin_id, candidate_id, round(cosine, 6) AS cosine FROM scored")
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the outputs of each candidate pair."""
    return _round(st.shown(det.scored_pairs(pairs(spark, d)), "cosine"), "cosine")


@query(f"WITH {_DETAILS} SELECT trace_id, candidate_id, row_number() OVER (PARTITION BY trace_id ORDER BY first) AS seq FROM details")
def waste_spans(spark: SparkSession, d: str) -> DataFrame:
    """The wasted spans of each trace, in report order."""
    return det.waste_spans(details(spark, d))


@query(f"WITH {_VERDICTS} SELECT trace_id, wasteful, waste_spans, waste_tokens, round(waste_cost, 6) AS waste_cost FROM verdicts")
def trace_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Wasteful or not, with totals, for every trace."""
    return _round(det.verdicts(table(spark, d, "spans"), details(spark, d)), "waste_cost")


@query(f"""WITH {_DETAILS} SELECT trace_id, candidate_id, origin_id, origin_node, repeat_node, rule, round(cosine, 6) AS cosine,
  coalesce(waste_tokens, -1) AS waste_tokens, round(coalesce(waste_cost, -1), 8) AS waste_cost FROM details""")
def waste_details(spark: SparkSession, d: str) -> DataFrame:
    """Each wasted span with its most similar origin; -1 for unknown tokens or cost."""
    df = details(spark, d).select("trace_id", "candidate_id", "origin_id", "origin_node", "repeat_node", "rule", "cosine", "waste_tokens", "waste_cost")
    return _round(df, "cosine").withColumns({"waste_tokens": F.coalesce("waste_tokens", F.lit(-1)), "waste_cost": F.round(F.coalesce("waste_cost", F.lit(-1.0)), 8)})


_WORKERS = f"""{_CS}, up AS (
  SELECT c.trace_id, c.span_id AS child, c.span_kind, p.span_id FROM cs c JOIN cs p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
), workers AS (
  SELECT trace_id, span_id FROM up WHERE span_kind IN ('llm', 'tool')
  UNION
  SELECT u.trace_id, u.span_id FROM workers w JOIN up u ON u.trace_id = w.trace_id AND u.child = w.span_id
)"""


@query(f"WITH RECURSIVE {_WORKERS} SELECT * FROM workers")
def worker_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans with an llm or tool span anywhere below."""
    return pre.worker_spans(spans(spark, d, "parent_span_id", "span_kind"))


_COLLAPSED = """collapsed AS (
  SELECT s.trace_id, s.span_id, s.span_kind, CASE WHEN l.span_id IS NULL THEN s.parent_span_id ELSE l.parent_span_id END AS parent_span_id,
         CASE WHEN x.extra IS NULL THEN s.token_count ELSE coalesce(s.token_count, 0) + x.extra END AS token_count
  FROM cs s
  LEFT JOIN cs l ON l.span_kind = 'llm' AND l.trace_id = s.trace_id AND l.span_id = s.parent_span_id
  LEFT JOIN (SELECT trace_id, parent_span_id, sum(token_count)::BIGINT AS extra FROM cs
             WHERE span_kind = 'llm' AND parent_span_id IS NOT NULL AND token_count IS NOT NULL GROUP BY ALL) x
    ON x.trace_id = s.trace_id AND x.parent_span_id = s.span_id
  WHERE s.span_kind IS DISTINCT FROM 'llm'
)"""


@query(f"WITH {_CS}, {_COLLAPSED} SELECT trace_id, span_id, parent_span_id, coalesce(token_count, -1) AS token_count FROM collapsed")
def collapsed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Model calls folded into their nodes."""
    df = pre.collapse_llm(spans(spark, d, "parent_span_id", "span_kind", "token_count"))
    return df.select("trace_id", "span_id", "parent_span_id", F.coalesce("token_count", F.lit(-1)).alias("token_count"))


@query(f"""WITH RECURSIVE {_WORKERS}, {_COLLAPSED} SELECT trace_id, span_id FROM collapsed c
  WHERE NOT (span_kind IN ('chain', 'agent') AND parent_span_id IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM workers w WHERE w.trace_id = c.trace_id AND w.span_id = c.span_id))""")
def router_filtered(spark: SparkSession, d: str) -> DataFrame:
    """What is left without model calls and routers."""
    all_ = spans(spark, d, "parent_span_id", "span_kind", "token_count")
    return pre.filter_routers(pre.collapse_llm(all_), pre.worker_spans(all_)).select("trace_id", "span_id")


@query(f"""WITH RECURSIVE {_WORKERS}, {_COLLAPSED}, kept AS (
  SELECT trace_id, count(*) AS n FROM collapsed c
  WHERE NOT (span_kind IN ('chain', 'agent') AND parent_span_id IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM workers w WHERE w.trace_id = c.trace_id AND w.span_id = c.span_id)) GROUP BY trace_id
) SELECT trace_id, count(*) FILTER (span_kind = 'llm') AS collapsed_llm_spans,
         count(*) - count(*) FILTER (span_kind = 'llm') - coalesce(any_value(kept.n), 0) AS filtered_router_spans
  FROM cs LEFT JOIN kept USING (trace_id) GROUP BY trace_id""")
def preprocess_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many spans preprocessing removes from each trace, by reason."""
    return pre.preprocess(spans(spark, d))[1]


@query(f"""WITH {_CS}, leaves AS (
  SELECT trace_id, span_id, arg_min(leaf, (-length(leaf), n)) AS text FROM (
    SELECT trace_id, span_id, json_extract_string(t.value, '$') AS leaf, t.rowid AS n FROM cs, json_tree(output_text) t WHERE json_valid(output_text) AND t.type = 'VARCHAR'
  ) WHERE {_strip("leaf")} <> '' GROUP BY ALL
) SELECT trace_id, span_id, coalesce(l.text, output_text) AS text FROM cs LEFT JOIN leaves l USING (trace_id, span_id)""")
def json_text_extract(spark: SparkSession, d: str) -> DataFrame:
    """The longest text inside each output."""
    df = spans(spark, d, "output_text")
    return df.select("trace_id", "span_id", longest_leaf(F.col("output_text")).alias("text"))


@query(f"WITH {_CS} SELECT trace_id, span_id, replace(replace(lower({_strip('input_text')}), 'ß', 'ss'), 'ς', 'σ') AS text FROM cs WHERE input_text IS NOT NULL")
def normal_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs as they are compared."""
    return spans(spark, d, "input_text").where("input_text IS NOT NULL").select("trace_id", "span_id", normal_input(F.col("input_text")).alias("text"))


@query(f"""WITH {_CS} SELECT trace_id, span_id, unnest(list_filter([
  CASE WHEN agent_or_node_id IS NULL THEN 'no node' END,
  CASE WHEN span_kind IS NULL OR span_kind NOT IN ('llm', 'tool', 'chain', 'agent') THEN 'unknown kind' END,
  CASE WHEN start_time IS NULL THEN 'no start' END,
  CASE WHEN end_time IS NULL THEN 'no end' END,
  CASE WHEN end_time < start_time THEN 'end before start' END,
  CASE WHEN input_text IS NULL THEN 'no input' END,
  CASE WHEN coalesce({_strip("output_text")}, '') = '' THEN 'blank output' END,
  CASE WHEN token_count < 0 THEN 'negative tokens' END,
  CASE WHEN cost_rate < 0 THEN 'negative rate' END], lambda e: e IS NOT NULL)) AS error FROM cs""")
def row_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rules that single spans break."""
    return val.row_errors(spans(spark, d))


@query(f"""WITH RECURSIVE {_CS}, good AS (
  SELECT trace_id, span_id FROM cs WHERE parent_span_id IS NULL OR parent_span_id = ''
  UNION
  SELECT c.trace_id, c.span_id FROM cs c WHERE NOT EXISTS (
    SELECT 1 FROM cs p WHERE p.trace_id = c.trace_id AND lower(p.span_id) = regexp_replace(lower(c.parent_span_id), '^0x', ''))
  UNION
  SELECT c.trace_id, c.span_id FROM good g JOIN cs c ON c.trace_id = g.trace_id AND regexp_replace(lower(c.parent_span_id), '^0x', '') = lower(g.span_id)
)
SELECT trace_id, CASE WHEN n = 0 THEN 'no root' ELSE 'several roots' END AS error, n FROM
  (SELECT trace_id, count(*) FILTER (parent_span_id IS NULL) AS n FROM cs GROUP BY trace_id) WHERE n <> 1
UNION ALL
SELECT trace_id, 'orphan', count(*) FROM cs c WHERE parent_span_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM cs p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id) GROUP BY trace_id
UNION ALL
SELECT trace_id, 'circle', count(*) FROM cs c WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.trace_id = c.trace_id AND g.span_id = c.span_id) GROUP BY trace_id""")
def trace_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rules that whole traces break."""
    return val.trace_errors(spans(spark, d, "parent_span_id", "start_time"))


@query(f"WITH {_CS} SELECT trace_id, agent_or_node_id, count(*) AS n FROM cs GROUP BY ALL HAVING count(*) >= 2")
def node_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with more than one span in a trace."""
    return m.node_frequency(spans(spark, d, "agent_or_node_id"))


@query(f"WITH {_CS} SELECT min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, count(*) AS traces FROM (SELECT count(*) AS n FROM cs GROUP BY trace_id)")
def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    """How long traces are."""
    return _round(m.length_distribution(spans(spark, d, "pos")), "mean")


@query(f"WITH {_LABELS} SELECT label_class, coalesce(nullif(waste_pattern, ''), '_control') AS pattern, count(*) AS n FROM labels GROUP BY ALL")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels by class and pattern."""
    return m.label_counts(labels(spark, d))


_RATES = """count(*) FILTER (label_class = 'positive' AND wasteful) AS tp, count(*) FILTER (label_class <> 'positive' AND wasteful) AS fp,
  count(*) FILTER (label_class <> 'positive' AND NOT wasteful) AS tn, count(*) FILTER (label_class = 'positive' AND NOT wasteful) AS fn"""
_SHARES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS {recall},
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn)::DOUBLE END, 6) AS fpr"""


@query(f"""WITH {_VERDICTS}, {_LABELS}, c AS (SELECT {_RATES} FROM labels JOIN verdicts USING (trace_id)), r AS (SELECT *, {_SHARES.format(recall="recall")} FROM c)
SELECT *, CASE WHEN f1 >= 0.8 AND fpr <= 0.1 THEN 'GO' WHEN f1 < 0.6 OR fpr > 0.25 THEN 'KILL' ELSE 'GREY' END AS verdict FROM r""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against labels."""
    found = det.verdicts(table(spark, d, "spans"), details(spark, d))
    return _round(m.confusion(found, labels(spark, d)), "precision", "recall", "f1", "fpr")


@query(f"""WITH {_VERDICTS}, {_LABELS}, c AS (SELECT coalesce(nullif(waste_pattern, ''), '_control') AS pattern, {_RATES} FROM labels JOIN verdicts USING (trace_id) GROUP BY 1)
SELECT *, {_SHARES.format(recall="tpr")} FROM c""")
def pattern_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same by pattern."""
    found = det.verdicts(table(spark, d, "spans"), details(spark, d))
    return _round(m.confusion_by_pattern(found, labels(spark, d)), "precision", "tpr", "f1", "fpr")


@query(f"""WITH {_SPLIT} SELECT dup, count(*) AS n, round(quantile_cont(cosine, 0.1), 6) AS p10, round(quantile_cont(cosine, 0.5), 6) AS median,
  round(quantile_cont(cosine, 0.9), 6) AS p90, round(avg(cosine), 6) AS mean FROM split GROUP BY dup""")
def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of labelled duplicates and of other pairs."""
    return m.summary(labelled_pairs(spark, d), "cosine", "dup")


@query(f"""WITH {_SPLIT}, s AS (
  SELECT quantile_cont(cosine, 0.1) FILTER (dup) AS p10, quantile_cont(cosine, 0.9) FILTER (NOT dup) AS p90, avg(cosine) FILTER (dup) AS m0, avg(cosine) FILTER (NOT dup) AS m1,
         var_samp(cosine) FILTER (dup) AS v0, var_samp(cosine) FILTER (NOT dup) AS v1 FROM split
), r AS (
  SELECT (p10 + p90) / 2 AS phi, p10 - p90 AS gap, (m0 - m1) / sqrt((v0 + v1) / 2) AS cohens_d,
         (SELECT avg((cosine >= (p10 + p90) / 2)::INT) FROM split WHERE NOT dup) AS pair_fpr FROM s
) SELECT round(phi, 6) AS phi, round(gap, 6) AS gap, round(cohens_d, 6) AS cohens_d, round(pair_fpr, 6) AS pair_fpr,
  concat_ws(',', CASE WHEN gap <= 0 THEN 'gap' END, CASE WHEN cohens_d < 0.5 THEN 'cohens_d' END, CASE WHEN pair_fpr > 0.15 THEN 'pair_fpr' END) AS failures FROM r""")
def separation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The threshold between both kinds of pairs, how well it separates them, and failed guards."""
    return _round(m.separation(labelled_pairs(spark, d)), "phi", "gap", "cohens_d", "pair_fpr")


@query(f"""WITH {_U}, {_LABELS}, met AS (
  SELECT u.occ, u.trace_id, u.start_time, u.pos, u.span_id FROM u JOIN labels l ON l.trace_id = u.trace_id AND label_class = 'positive' AND list_contains(ids, u.span_id)
) SELECT occ AS n FROM met GROUP BY occ ORDER BY count(*) DESC, min((trace_id, start_time, pos, span_id)) LIMIT 1""")
def choose_n(spark: SparkSession, d: str) -> DataFrame:
    """At which occurrence of a node waste mostly begins."""
    return m.choose_n(spans(spark, d, "agent_or_node_id", "start_time", "pos"), labels(spark, d))


@query(f"WITH {_VERDICTS}, {_LABELS} SELECT round(coalesce(avg(wasteful::INT), 0), 6) AS trace_fpr FROM labels JOIN verdicts USING (trace_id) WHERE label_class = 'negative'")
def trace_fpr(spark: SparkSession, d: str) -> DataFrame:
    """Share of negative traces found wasteful."""
    return _round(m.trace_fpr(det.verdicts(table(spark, d, "spans"), details(spark, d)), labels(spark, d)), "trace_fpr")


@query(f"WITH {_SPLIT} SELECT trace_id, origin_id, candidate_id, rule, round(cosine, 6) AS cosine FROM split WHERE NOT dup ORDER BY split.cosine DESC, trace_id, origin_id, candidate_id LIMIT 8")
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The most similar pairs that aren't labelled duplicates."""
    return _round(m.top_pairs(labelled_pairs(spark, d)), "cosine")


@query(f"WITH {_SPLIT} SELECT rule, o.agent_or_node_id AS node, count(*) AS n FROM split s JOIN u o ON o.trace_id = s.trace_id AND o.span_id = s.origin_id WHERE NOT dup AND cosine >= {PHI} GROUP BY ALL")
def intruders(spark: SparkSession, d: str) -> DataFrame:
    """Where similar pairs that aren't duplicates come from."""
    return m.intruders(labelled_pairs(spark, d), PHI)


@query(f"""WITH {_SPLIT} SELECT CASE WHEN l.label_class = 'positive' THEN coalesce(l.waste_pattern, '?') ELSE '?' END AS pattern,
  CASE WHEN l.label_class = 'positive' THEN 'positive(non-waste)' ELSE 'clean' END AS source, count(*) AS n
FROM split s JOIN labels l USING (trace_id) WHERE NOT dup AND cosine >= {PHI} GROUP BY ALL""")
def intruder_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same by the pattern and class of their traces; these tables have no manifest, so clean ones have no pattern."""
    none = spark.createDataFrame([], "negative_trace_id string, pattern string")
    return m.intruder_sources(labelled_pairs(spark, d), none, PHI)


@query(f"""WITH s AS (
  SELECT DISTINCT dump_id, unnest(CAST(payload AS JSON[])) AS j FROM dump_sdk_json WHERE json_valid(payload) AND json_type(payload) = 'ARRAY'
), r AS (
  SELECT dump_id, j ->> '$.context.trace_id' AS t, lpad(regexp_replace(lower(j ->> '$.context.span_id'), '^0x', ''), 16, '0') AS span_id, nullif(j ->> '$.parent_id', '') AS parent,
         {_strip("""coalesce(j ->> '$.attributes."output.value"', '')""")} AS o FROM s
), n AS (SELECT dump_id, count(DISTINCT t) AS traces, count(DISTINCT span_id) FILTER (parent IS NULL) AS roots FROM r GROUP BY dump_id)
SELECT dump_id, 'several traces' AS error, '' AS span_id FROM n WHERE traces > 1
UNION ALL SELECT dump_id, CASE roots WHEN 0 THEN 'no root' ELSE 'several roots' END, '' FROM n WHERE roots <> 1
UNION ALL SELECT DISTINCT dump_id, 'blank output', span_id FROM r WHERE o = ''""")
def dump_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rules that whole telemetry documents break."""
    dumps = table(spark, d, "dump_sdk_json").select(F.col("dump_id").cast("string").alias("file"), F.col("payload").alias("text")).distinct()
    return val.document_errors(otel_spans(dumps)[0].distinct()).select(F.col("file").cast("bigint").alias("dump_id"), "error", F.coalesce("span_id", F.lit("")).alias("span_id"))


@query(f"""WITH {_CS} SELECT coalesce(cs.model, '_unknown') AS model, count(*) AS spans, coalesce(sum(token_count), 0)::BIGINT AS tokens,
  round(coalesce(sum(token_count * cost_per_token), 0), 6) AS cost FROM cs LEFT JOIN (SELECT DISTINCT ON (model) * FROM model_costs ORDER BY model, cost_per_token) k ON cs.model = k.model GROUP BY 1""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by model, and what they cost by the table of costs (one row a model, the least if repeated)."""
    costs = table(spark, d, "model_costs").groupBy("model").agg(F.min("cost_per_token").alias("rate"))
    sums = spans(spark, d, "model", "token_count").groupBy("model").agg(F.count("*").alias("spans"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    cost = F.round(F.coalesce(F.col("tokens") * F.col("rate"), F.lit(0.0)), 6)
    return sums.join(costs, "model", "left").select(F.coalesce("model", F.lit("_unknown")).alias("model"), "spans", "tokens", cost.alias("cost"))


@query(f"""WITH {_DETAILS}, kept AS (
  SELECT v.* FROM vecs v JOIN cs ON cs.trace_id = v.trace_id AND cs.span_id = v.span_id AND cs.output_text IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM details d WHERE d.trace_id = v.trace_id AND d.candidate_id = v.span_id)
), met AS (SELECT a.trace_id, list_cosine_similarity(a.v, b.v) AS cosine FROM kept a JOIN kept b ON a.trace_id = b.trace_id AND a.span_id < b.span_id)
SELECT trace_id, count(*) AS pairs, round(min(cosine), 6) AS min_cosine, round(quantile_cont(cosine, 0.5), 6) AS median_cosine, round(max(cosine), 6) AS max_cosine,
  count(*) FILTER (cosine >= {PHI}) AS above FROM met GROUP BY trace_id""")
def nonwaste_pair_stats(spark: SparkSession, d: str) -> DataFrame:
    """How similar the outputs of a trace are that aren't waste."""
    waste = details(spark, d).select("trace_id", F.col("candidate_id").alias("span_id"))
    usable = "trace_id IS NOT NULL AND agent_or_node_id IS NOT NULL AND start_time IS NOT NULL AND output_text IS NOT NULL"
    kept = spans(spark, d, "agent_or_node_id", "start_time", "output_text").where(usable).join(waste, ["trace_id", "span_id"], "left_anti")
    found = m.pair_statistics(kept.withColumn("v", hash_vector(F.col("output_text"))), PHI)
    return _round(found, "min_cosine", "median_cosine", "max_cosine")


@query("""WITH s AS (
  SELECT DISTINCT dump_id, unnest(CAST(payload AS JSON[])) AS j FROM dump_sdk_json WHERE json_valid(payload) AND json_type(payload) = 'ARRAY'
) SELECT DISTINCT dump_id, lpad(regexp_replace(lower(j ->> '$.context.trace_id'), '^0x', ''), 32, '0') AS trace_id,
  lpad(regexp_replace(lower(j ->> '$.context.span_id'), '^0x', ''), 16, '0') AS span_id,
  lpad(regexp_replace(lower(nullif(j ->> '$.parent_id', '')), '^0x', ''), 16, '0') AS parent_span_id,
  coalesce(nullif(j ->> '$.name', ''), 'anonymous') AS agent_or_node_id,
  CASE j ->> '$.attributes."openinference.span.kind"' WHEN 'LLM' THEN 'llm' WHEN 'TOOL' THEN 'tool' WHEN 'AGENT' THEN 'agent' ELSE 'chain' END AS span_kind,
  epoch_us((j ->> '$.start_time')::TIMESTAMPTZ) AS start_us, epoch_us((j ->> '$.end_time')::TIMESTAMPTZ) AS end_us,
  coalesce(TRY_CAST(j ->> '$.attributes."llm.token_count.total"' AS BIGINT), -1) AS token_count,
  coalesce(nullif(j ->> '$.attributes."llm.model_name"', ''), j ->> '$.attributes."llm.provider"', '') AS model,
  length(coalesce(j ->> '$.attributes."input.value"', '')) AS input_chars, length(coalesce(j ->> '$.attributes."output.value"', '')) AS output_chars FROM s""")
def ingested_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the raw SDK dumps as span records."""
    dumps = table(spark, d, "dump_sdk_json").select(F.col("dump_id").cast("string").alias("file"), F.col("payload").alias("text"))
    found, _ = otel_spans(dumps)
    return found.select(
        F.col("file").cast("bigint").alias("dump_id"), "trace_id", "span_id", "parent_span_id", "agent_or_node_id", "span_kind",
        F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), F.coalesce("token_count", F.lit(-1)).alias("token_count"),
        F.coalesce("model", F.lit("")).alias("model"), F.length("input_text").alias("input_chars"), F.length("output_text").alias("output_chars"),
    ).distinct()


@query(f"""WITH {_CS} SELECT trace_id, parent_span_id, span_id,
  row_number() OVER (PARTITION BY trace_id, coalesce(parent_span_id, '') {_ORD}) AS sibling_rank FROM cs WHERE start_time IS NOT NULL""")
def sibling_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the span trees, children in order of time."""
    return tree_edges(spans(spark, d, "parent_span_id", "start_time", "pos"))


@query(f"""WITH {_CS} SELECT c.trace_id, row_number() OVER (PARTITION BY c.trace_id ORDER BY c.start_time, c.pos, c.span_id) AS seq, c.agent_or_node_id AS node, c.span_kind AS kind,
  coalesce(p.agent_or_node_id, '<root>') AS parent_node
FROM cs c LEFT JOIN cs p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.start_time IS NOT NULL""")
def trace_topology(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each trace, step by step."""
    return topology(spans(spark, d, "parent_span_id", "agent_or_node_id", "span_kind", "start_time", "pos"))


@query(f"""WITH {_CS}, t AS (
  SELECT agent_or_node_id, span_kind, epoch_us(start_time) // 3600000000 * 3600000000 AS hour_us, coalesce(token_count, 0) AS tokens FROM cs WHERE start_time IS NOT NULL AND agent_or_node_id IS NOT NULL
) SELECT agent_or_node_id, hour_us, count(*) AS spans, sum(tokens)::BIGINT AS tokens FROM t GROUP BY ALL""")
def node_activity(spark: SparkSession, d: str) -> DataFrame:
    """Spans and tokens of each node by hour of start, as the stream counts them."""
    df = spans(spark, d, "agent_or_node_id", "start_time", "token_count").where("agent_or_node_id IS NOT NULL").fillna({"token_count": 0})
    return activity(df, "1 hour").select("agent_or_node_id", F.unix_micros("from").alias("hour_us"), "spans", "tokens")


@query(f"""WITH {_CS} SELECT trace_id, span_id FROM cs WHERE contains(lower(output_text), 'final answer') OR contains(lower(output_text), 'budget')""")
def hinted_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans whose output holds one of some phrases."""
    return spans(spark, d, "output_text").where(holds_any(F.col("output_text"), ["final answer", "budget"])).select("trace_id", "span_id")


@query(f"""WITH {_CS} SELECT trace_id, span_id, left(output_text, 80) AS snippet,
  CASE WHEN strpos(output_text, ': ') = 0 THEN output_text ELSE substr(output_text, strpos(output_text, ': ') + 2) END AS rest FROM cs WHERE output_text IS NOT NULL""")
def output_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first characters of each output, and what follows its first label."""
    df = spans(spark, d, "output_text").where("output_text IS NOT NULL")
    return df.select("trace_id", "span_id", snippet(F.col("output_text")).alias("snippet"), after_prefix(F.col("output_text")).alias("rest"))


@query(f"WITH {_CS}, {_LABELS} SELECT DISTINCT trace_id FROM cs WHERE trace_id NOT IN (SELECT trace_id FROM labels)")
def unlabelled_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces without a label."""
    return m.unlabelled(spans(spark, d, "pos").select("trace_id").distinct(), labels(spark, d))


@query()
def otlp_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the raw OTLP dumps as span records."""
    dumps = table(spark, d, "dump_otlp").select(F.col("dump_id").cast("string").alias("file"), F.col("payload").alias("text"))
    return otel_spans(dumps, otlp=True)[0]


@query(r"""SELECT dump_id::VARCHAR AS file, reason FROM (
  SELECT dump_id, CASE WHEN payload IS NULL OR NOT regexp_matches(payload, '\S') THEN 'empty' WHEN NOT json_valid(payload) THEN 'not JSON'
    WHEN json_type(payload) = 'ARRAY' THEN CASE WHEN json_extract(payload, '$[0].context') IS NULL THEN 'array of something else' END
    WHEN json_type(payload) <> 'OBJECT' THEN 'not an object or array' WHEN json_extract(payload, '$.trace_id') IS NOT NULL THEN 'trace'
    WHEN json_extract(payload, '$.resource_spans') IS NOT NULL OR json_extract(payload, '$.resourceSpans') IS NOT NULL THEN 'otlp' ELSE 'unknown object' END AS reason
  FROM (SELECT dump_id, payload FROM dump_sdk_json UNION ALL SELECT dump_id, payload FROM dump_otlp)
) WHERE reason IS NOT NULL""")
def refused_dumps(spark: SparkSession, d: str) -> DataFrame:
    """Raw dumps that aren't SDK arrays, with the reason."""
    both = table(spark, d, "dump_sdk_json").unionByName(table(spark, d, "dump_otlp"))
    return otel_spans(both.select(F.col("dump_id").cast("string").alias("file"), F.col("payload").alias("text")))[1]


_LINES = f"""{_VERDICTS}, lines AS (
  SELECT d.*, left(coalesce(o.output_text, ''), 80) AS snippet, row_number() OVER (PARTITION BY d.trace_id ORDER BY first) AS k
  FROM details d JOIN cs o ON o.trace_id = d.trace_id AND o.span_id = d.candidate_id
)"""


def _places(x: str, n: int) -> str:
    return f"coalesce(CAST(CAST({x} AS DECIMAL(38, {n})) AS VARCHAR), '\"unknown\"')"


@query(f"""WITH {_LINES}, shown AS (
  SELECT trace_id, string_agg('{{"origin_node":' || to_json(origin_node)::VARCHAR || ',"repeat_node":' || to_json(repeat_node)::VARCHAR || ',"cosine":' || {_places("cosine", 6)}
    || ',"tokens_wasted":' || coalesce(waste_tokens::VARCHAR, '"unknown"') || ',"cost_wasted":' || {_places("waste_cost", 8)} || ',"snippet":' || to_json(snippet)::VARCHAR || '}}', ',' ORDER BY k) AS lines
  FROM lines GROUP BY trace_id
) SELECT trace_id, '{{"trace_id":' || to_json(trace_id)::VARCHAR || ',"analyzed":"2026-01-01T00:00:00Z","detector_params":{{"phi":0.8,"n":2,"model":"{MODEL}"}},"wasteful":' || wasteful::VARCHAR
  || ',"waste_span_count":' || waste_spans::VARCHAR || ',"total_tokens_wasted":' || coalesce(nullif(waste_tokens, 0)::VARCHAR, '"unknown"')
  || ',"total_cost_wasted":' || {_places("CASE WHEN waste_cost > 0 THEN waste_cost END", 8)} || ',"waste_details":[' || coalesce(lines, '') || '],"note":"{NOTE}"}}' AS report
FROM verdicts LEFT JOIN shown USING (trace_id)""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON report on each trace."""
    found = details(spark, d)
    return json_reports(det.verdicts(table(spark, d, "spans"), found), found, phi=PHI, now="2026-01-01T00:00:00Z")


@query(f"""WITH {_LINES}, shown AS (
  SELECT trace_id, string_agg('| ' || origin_node || ' | ' || repeat_node || ' | ' || CAST(CAST(cosine AS DECIMAL(38, 4)) AS VARCHAR) || ' | ' || coalesce(waste_tokens::VARCHAR, 'unknown') || ' | '
      || CASE WHEN waste_cost IS NULL THEN 'unknown' ELSE CAST(CAST(waste_cost AS DECIMAL(38, 6)) AS VARCHAR) END || ' |', chr(10) ORDER BY k) AS lines,
    string_agg('**' || k || '. ' || repeat_node || '** (repeat)' || chr(10) || '> ' || snippet || chr(10) || chr(10), '' ORDER BY k) AS snippets
  FROM lines GROUP BY trace_id
) SELECT trace_id, replace('# Waste report~~- **trace_id**: `' || trace_id || '`~- **analyzed**: 2026-01-01T00:00:00Z~- **detector params**: φ=0.8, N=2, model={MODEL}~~', '~', chr(10))
  || CASE WHEN wasteful THEN replace('## Result: WASTE DETECTED~~- **wasted spans**: ' || waste_spans || '~- **estimated wasted tokens**: ' || coalesce(nullif(waste_tokens, 0)::VARCHAR, 'unknown')
       || '~- **estimated wasted cost**: ' || CASE WHEN waste_cost > 0 THEN CAST(CAST(waste_cost AS DECIMAL(38, 6)) AS VARCHAR) ELSE 'unknown' END
       || '~~## Wasted Span Details~~| origin_node | repeat_node | cosine | tokens (wasted) | cost (wasted) |~|-------------|-------------|--------|-----------------|---------------|~', '~', chr(10))
       || lines || chr(10) || chr(10) || '## Snippets' || chr(10) || chr(10) || snippets
     ELSE '## Result: no waste detected' || chr(10) || chr(10) END || '---' || chr(10) || '_{NOTE}_' AS report
FROM verdicts LEFT JOIN shown USING (trace_id)""")
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown report on each trace."""
    found = details(spark, d)
    return markdown_reports(det.verdicts(table(spark, d, "spans"), found), found, phi=PHI, now="2026-01-01T00:00:00Z")


@query()
def saved_traces(spark: SparkSession, d: str) -> DataFrame:
    """Each trace as one record to save, with its metadata."""
    return trace_texts(spans(spark, d), table(spark, d, "traces").select("trace_id", "metadata"))
