"""Calibration and evaluation: confusion matrix, separation of pair similarities, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import verdict
from spanloom.functions.vectors import cosine
from spanloom.operators.events import EVENT_ORDER, numbered
from spanloom.schema import GUARD_D, GUARD_PAIR_FPR
from spanloom.storage import store


def clean_labels(labels: DataFrame) -> DataFrame:
    """One label per trace: ``trace_id``, ``label_class``, ``waste_pattern``, ``waste_span_ids``.

    Repeated rows are one; of rows that differ the greatest class, pattern and the union of the ids.
    Rows without a trace or class don't count.
    """
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("waste_span_ids", F.array().cast("array<string>"))))))
    return (
        labels.where("trace_id IS NOT NULL AND label_class IS NOT NULL")
        .groupBy("trace_id")
        .agg(F.max("label_class").alias("label_class"), F.max("waste_pattern").alias("waste_pattern"), ids.alias("waste_span_ids"))
    )


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _counts(df: DataFrame, *by: str) -> DataFrame:
    positive = F.col("label_class") == "positive"
    counts = df.groupBy(*by).agg(
        F.count_if(positive & F.col("wasteful")).alias("tp"),
        F.count_if(~positive & F.col("wasteful")).alias("fp"),
        F.count_if(~positive & ~F.col("wasteful")).alias("tn"),
        F.count_if(positive & ~F.col("wasteful")).alias("fn"),
    )
    return counts.withColumns(
        {
            "precision": _share(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _share(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
            "fpr": _share(F.col("fp"), F.col("fp") + F.col("tn")),
        }
    )


def _judged(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(verdicts.select("trace_id", "wasteful"), "trace_id").select("trace_id", "label_class", "waste_pattern", "wasteful")


def unlabelled(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Traces that an evaluation of all traces would miss a label for."""
    return verdicts.select("trace_id").join(labels, "trace_id", "left_anti")


def confusion(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1, false positive rate and verdict; 0 for empty shares."""
    return _counts(_judged(verdicts, labels)).withColumn("verdict", verdict(F.col("f1"), F.col("fpr")))


def confusion_by_pattern(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """The same by pattern; labels without one form ``_control``."""
    judged = _judged(verdicts, labels).withColumn("pattern", F.coalesce(F.nullif("waste_pattern", F.lit("")), F.lit("_control")))
    return _counts(judged, "pattern").withColumnRenamed("recall", "tpr")


def split_pairs(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored pairs of labelled traces; ``dup``: the later span is labelled waste of a positive trace."""
    dup = (F.col("label_class") == "positive") & F.array_contains("waste_span_ids", F.col("c.span_id"))
    return scored.join(labels, "trace_id").withColumn("dup", F.coalesce(dup, F.lit(False)))


def percentiles(df: DataFrame, value: str, by: str, **shares: float) -> DataFrame:
    """Exact percentiles of each group, interpolated between neighbours; nulls don't count.

    The built-in exact percentile gathers a group's values in one buffer. Here the values are
    sorted over range partitions and numbered, and only those at the wanted places are aggregated.
    """
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("\0")).alias("trace_id"), F.col(value).alias("start_time")).where("start_time IS NOT NULL")
    placed = numbered(rows.withColumns({"pos": F.lit(0), "span_id": F.lit("")}))
    counts = rows.groupBy("trace_id").agg(F.count("*").alias("n"))
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in shares.items()}
    wanted = F.array(*(f(k) + 1 for k in at.values() for f in (F.floor, F.ceil)))
    near = placed.join(counts, "trace_id").where(F.array_contains(wanted, F.col("seq")))

    def between(k: Column) -> Column:
        low = F.max(F.when(F.col("seq") == F.floor(k) + 1, F.col("start_time")))
        high = F.max(F.when(F.col("seq") == F.ceil(k) + 1, F.col("start_time")))
        share = F.max(k - F.floor(k))
        return low + (high - low) * share

    return near.groupBy(F.nullif("trace_id", F.lit("\0")).cast(df.schema[by].dataType).alias(by)).agg(*(between(k).alias(name) for name, k in at.items()))


def summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Count, 10th, 50th and 90th percentile (interpolated) and mean of each group, to six places."""
    df = store(df.select(by, value), "values").df
    parts = percentiles(df, value, by, p10=0.1, median=0.5, p90=0.9)
    sums = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    shown = sums.join(parts.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    return shown.select(by, "n", *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90", "mean")))


def separation(pairs: DataFrame) -> DataFrame:
    """One row: the threshold halfway between duplicates and others, and how well they separate.

    ``phi``, ``gap``, ``cohens_d`` (0 with fewer than two values, infinite without spread),
    ``pair_fpr`` at that threshold, and ``failures`` of the guards joined by commas.
    """
    pairs = store(pairs.select("dup", "cosine"), "similarities").df
    parts = {r.dup: r for r in percentiles(pairs, "cosine", "dup", p10=0.1, p90=0.9).collect()}
    stats = pairs.groupBy("dup").agg(F.avg("cosine").alias("mean"), F.var_samp("cosine").alias("var"), F.count("cosine").alias("n")).collect()
    found = {f"{c}{i}": None if c != "n" else 0 for i in (0, 1) for c in ("mean", "var", "n")}
    for r in stats:
        found |= {f"{c}{0 if r.dup else 1}": r[c] for c in ("mean", "var", "n")}
    found |= {"p10": parts[True].p10 if True in parts else None, "p90": parts[False].p90 if False in parts else None}
    found["phi"] = None if None in (found["p10"], found["p90"]) else (found["p10"] + found["p90"]) / 2
    known = lambda c: F.lit(found[c]).cast("double")  # noqa: E731  # two rows of statistics, used as literals
    spread = F.sqrt((known("var0") + known("var1")) / 2)
    d = (
        F.when(F.lit(found["n0"] < 2 or found["n1"] < 2), 0.0)
        .when(spread == 0, F.when(known("mean0") == known("mean1"), 0.0).otherwise(float("inf")))
        .otherwise((known("mean0") - known("mean1")) / spread)
    )
    above = F.avg(F.when(~F.col("dup"), (F.col("cosine") >= known("phi")).cast("double")))
    row = (
        pairs.groupBy()
        .agg(above.alias("pair_fpr"))
        .select(known("phi").alias("phi"), (known("p10") - known("p90")).alias("gap"), d.alias("cohens_d"), F.coalesce("pair_fpr", F.lit(0.0)).alias("pair_fpr"))
    )
    failed = F.array_compact(
        F.array(
            F.when(F.col("gap").isNull() | (F.col("gap") <= 0), F.lit("gap")),
            F.when(F.col("cohens_d") < GUARD_D, F.lit("cohens_d")),
            F.when(F.col("pair_fpr") > GUARD_PAIR_FPR, F.lit("pair_fpr")),
        )
    )
    return row.withColumn("failures", F.array_join(failed, ","))


def choose_n(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``n``: the most frequent running number of a node at a span labelled waste.

    Positive traces only; of equally frequent numbers the one met first. Only nodes that hold a
    labelled span are numbered. Empty if there is none.
    """
    ids = labels.where("label_class = 'positive'").select("trace_id", F.explode("waste_span_ids").alias("span_id")).distinct().withColumn("waste", F.lit(True))
    rows = spans.where("agent_or_node_id IS NOT NULL AND start_time IS NOT NULL").select("trace_id", "agent_or_node_id", *EVENT_ORDER)
    marked = rows.join(ids, ["trace_id", "span_id"], "left")
    wanted = marked.where("waste").select("trace_id", "agent_or_node_id").distinct()
    mine = marked.join(wanted, ["trace_id", "agent_or_node_id"], "left_semi").withColumn("trace", F.col("trace_id"))
    placed = numbered(mine.withColumn("trace_id", F.concat_ws("\0", "trace_id", "agent_or_node_id")))
    at = placed.where("waste").withColumn("trace_id", F.col("trace")).withColumn("n", F.col("seq").cast("int"))
    met = at.groupBy("n").agg(F.count("*").alias("times"), F.min(F.struct("trace_id", *EVENT_ORDER)).alias("first"))
    return met.orderBy(F.col("times").desc(), "first").limit(1).select("n")


def trace_fpr(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of negative traces found wasteful."""
    return _judged(verdicts, labels).where("label_class = 'negative'").groupBy().agg(F.coalesce(F.avg(F.col("wasteful").cast("double")), F.lit(0.0)).alias("trace_fpr"))


def node_frequency(spans: DataFrame, least: int = 2) -> DataFrame:
    return spans.groupBy("trace_id", "agent_or_node_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def length_distribution(spans: DataFrame) -> DataFrame:
    """One row: least, greatest and mean number of spans of a trace."""
    per_trace = spans.groupBy("trace_id").agg(F.count("*").alias("n"))
    return per_trace.groupBy().agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.count("*").alias("traces"))


def label_counts(labels: DataFrame) -> DataFrame:
    pattern = F.coalesce(F.nullif("waste_pattern", F.lit("")), F.lit("_control"))
    return labels.groupBy("label_class", pattern.alias("pattern")).agg(F.count("*").alias("n"))


def top_pairs(pairs: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most similar pairs that aren't duplicates; equal ones by their ids."""
    ids = pairs.where("NOT dup").select("trace_id", F.col("o.span_id").alias("origin_id"), F.col("c.span_id").alias("candidate_id"), "rule", "cosine")
    return ids.orderBy(F.col("cosine").desc(), "trace_id", "origin_id", "candidate_id").limit(k)


def intruders(pairs: DataFrame, phi: float) -> DataFrame:
    """Pairs that aren't duplicates but similar enough to be taken for it, counted by rule and node."""
    hit = pairs.where(~F.col("dup") & (F.col("cosine") >= phi))
    return hit.groupBy("rule", F.col("o.agent_or_node_id").alias("node")).agg(F.count("*").alias("n"))


def intruder_sources(pairs: DataFrame, manifest: DataFrame, phi: float) -> DataFrame:
    """The same counted by ``pattern`` and ``source``: that of the label of positive traces, and of
    clean ones that of the pair they are the twin in; ``?`` where the manifest doesn't know it."""
    hit = pairs.where(~F.col("dup") & (F.col("cosine") >= phi))
    twin = manifest.groupBy(F.col("negative_trace_id").alias("trace_id")).agg(F.min("pattern").alias("__twin"))
    positive = F.col("label_class") == "positive"
    pattern = F.coalesce(F.when(positive, F.col("waste_pattern")).otherwise(F.col("__twin")), F.lit("?"))
    source = F.when(positive, "positive(non-waste)").otherwise("clean")
    return hit.join(twin, "trace_id", "left").groupBy(pattern.alias("pattern"), source.alias("source")).agg(F.count("*").alias("n"))


def pair_statistics(scored_spans: DataFrame, phi: float, block: int = 2_000) -> DataFrame:
    """Similarity of every two spans of a trace: count, least, median, greatest, count from ``phi``.

    Input: ``trace_id``, ``span_id``, ``v`` (vector). What is asked for is quadratic in the length of
    a trace; long traces are split into blocks, so that a task compares two blocks at a time.
    """
    sizes = scored_spans.groupBy("trace_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = scored_spans.select("trace_id", "span_id", "v").join(sizes, "trace_id").withColumn("own", F.pmod(F.xxhash64("span_id"), F.col("blocks")).cast("int"))
    left = placed.select("trace_id", F.col("span_id").alias("a"), F.col("v").alias("va"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = placed.select("trace_id", F.col("span_id").alias("b"), F.col("v").alias("vb"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    met = left.join(right, ["trace_id", "i", "j"]).where("i < j OR a < b").select("trace_id", cosine(F.col("va"), F.col("vb")).alias("cosine"))
    met = store(met, "similarities").df
    sums = met.groupBy("trace_id").agg(
        F.count("*").alias("pairs"), F.min("cosine").alias("min_cosine"), F.max("cosine").alias("max_cosine"), F.count_if(F.col("cosine") >= phi).alias("above")
    )
    middle = percentiles(met, "cosine", "trace_id", median_cosine=0.5)
    return sums.join(middle, "trace_id").select("trace_id", "pairs", "min_cosine", "median_cosine", "max_cosine", "above")
