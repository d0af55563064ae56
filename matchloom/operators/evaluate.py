"""Recall of candidates and quality of matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .decide import RULES, decide, expectation_grid, owners


def candidate_recall(candidates: DataFrame, truth: DataFrame, queries: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(true_pairs, found, recall, candidates); with ``targets`` only pairs that are in scope count."""
    if queries is not None:
        truth = truth.join(queries.select("s1"), "s1", "left_semi")
    if targets is not None:
        truth = truth.join(targets.select("tgt"), "tgt", "left_semi")
    found = truth.join(candidates.select("s1", "tgt").distinct().withColumn("hit", F.lit(1)), ["s1", "tgt"], "left")
    n = candidates.agg(F.count("*").alias("candidates"))
    return found.agg(F.count("*").alias("true_pairs"), F.count("hit").alias("found")).join(n).select("true_pairs", "found", share(F.col("found"), F.col("true_pairs")).alias("recall"), "candidates")


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def complete_queries(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, complete): S1 with matches, and those all of whose matches are candidates."""
    hit = truth.join(candidates.select("s1", "tgt").distinct().withColumn("hit", F.lit(1)), ["s1", "tgt"], "left")
    per = hit.groupBy("s1").agg(F.min(F.coalesce("hit", F.lit(0))).alias("all_found"))
    return per.agg(F.count("*").alias("queries"), F.sum("all_found").cast("long").alias("complete"))


def size_grid(candidates: DataFrame, truth: DataFrame, n_queries: int, a: tuple[int, ...] = (1, 2, 3, 5), b: tuple[int, ...] = (0, 1, 2, 3, 5, 10, 20)) -> DataFrame:
    """(k_a, k_b, recall, per_s1): what each pair of cuts finds and costs, in one pass."""
    total = truth.agg(F.count("*").alias("total"))
    rows = candidates.join(truth.select("s1", "tgt").withColumn("hit", F.lit(1)), ["s1", "tgt"], "left")
    kept = lambda x, y: (F.col("rank_a") < x) | (F.col("rank_b") < y)
    cells = [(x, y) for x in a for y in b]
    sums = rows.agg(*[F.count(F.when(kept(x, y), 1)).alias(f"n_{x}_{y}") for x, y in cells], *[F.count(F.when(kept(x, y), F.col("hit"))).alias(f"h_{x}_{y}") for x, y in cells]).join(total)
    cell = F.explode(F.array(*[F.struct(F.lit(x).alias("k_a"), F.lit(y).alias("k_b"), share(F.col(f"h_{x}_{y}"), F.col("total")).alias("recall"), (F.col(f"n_{x}_{y}") / n_queries).alias("per_s1")) for x, y in cells]))
    return sums.select(cell.alias("c")).select("c.*")


def recall_at(ranked: dict[str, DataFrame], truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """(channel, k, found, recall) of each channel and their union; channels have (s1, tgt, rank)."""
    total = truth.agg(F.count("*").alias("total"))
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("channel"), "s1", "tgt", "rank") for name, df in ranked.items()])
    every = every.join(truth.select("s1", "tgt"), ["s1", "tgt"])
    joined = every.groupBy("s1", "tgt").agg(F.min("rank").alias("rank")).select(F.lit("union").alias("channel"), "s1", "tgt", "rank")
    hits = every.unionByName(joined)
    counts = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank < k").groupBy("channel", "k").agg(F.count("*").alias("found"))
    return counts.join(total).select("channel", "k", "found", share(F.col("found"), F.col("total")).alias("recall"))


def per_query(queries: DataFrame, n_true: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, f05) of every query: nothing to find and nothing found is 1."""
    hits = predicted.select("s1", "tgt").join(truth.select("s1", "tgt").withColumn("hit", F.lit(1)), ["s1", "tgt"], "left")
    found = hits.groupBy("s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    rows = queries.select("s1").join(n_true, "s1", "left").join(found, "s1", "left").fillna(0, ["n_true", "n_pred", "tp"])
    down = 1.25 * F.col("tp") + 0.25 * (F.col("n_true") - F.col("tp")) + (F.col("n_pred") - F.col("tp"))
    return rows.select("s1", F.when(down > 0, 1.25 * F.col("tp") / down).otherwise(1.0).alias("f05"))


def macro_f05(queries: DataFrame, n_true: DataFrame, predicted: DataFrame, truth: DataFrame, by: str | None = None) -> DataFrame:
    """(queries, f05), for each value of ``by`` where it is named (a column of ``queries``)."""
    scores = per_query(queries, n_true, predicted, truth)
    if by:
        scores = scores.join(queries.select("s1", by), "s1")
    out = scores.groupBy(*([by] if by else []))
    return out.agg(F.count("*").alias("queries"), F.avg("f05").alias("f05"))


def rule_grid(scored: DataFrame, queries: DataFrame, n_true: DataFrame, truth: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """(rule, f05) of all rules; the best one is the first of the largest."""
    rules = RULES if rules is None else rules
    steps = [(i, r) for i, r in enumerate(rules) if r["mode"] == "threshold"]
    bets = [(i, r["floor"], r["extra"]) for i, r in enumerate(rules) if r["mode"] == "expected"]
    parts = [expectation_grid(scored, bets).select("rule", "s1", "tgt")] if bets else []
    if steps:  # all thresholds in one pass over the owners
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r["threshold"]).alias("least")) for i, r in steps]))
        parts.append(owners(scored).withColumn("x", each).where("p >= x.least").select("x.rule", "s1", "tgt"))
    predicted = reduce(DataFrame.unionByName, parts)
    hits = predicted.join(truth.select("s1", "tgt").withColumn("hit", F.lit(1)), ["s1", "tgt"], "left")
    found = hits.groupBy("rule", "s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    grid = queries.select("s1").join(n_true, "s1", "left").withColumn("rule", F.explode(F.array(*[F.lit(i) for i in range(len(rules))])))
    rows = grid.join(found, ["rule", "s1"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    down = 1.25 * F.col("tp") + 0.25 * (F.col("n_true") - F.col("tp")) + (F.col("n_pred") - F.col("tp"))
    return rows.groupBy("rule").agg(F.avg(F.when(down > 0, 1.25 * F.col("tp") / down).otherwise(1.0)).alias("f05"))


def confusion(labelled: DataFrame, thresholds: list[float], by: str | None = None, counted: str | None = None) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f05) of pairs (p, y) for each threshold, in one pass; ``counted``: pairs that a row stands for."""
    rows = labelled.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    yes, true = F.col("p") >= F.col("threshold"), F.col("y") == 1
    count = lambda c: F.sum(c.cast("long") * (F.col(counted) if counted else 1))
    sums = rows.groupBy("threshold", *([by] if by else [])).agg(count(yes & true).alias("tp"), count(yes & ~true).alias("fp"), count(~yes & true).alias("fn"), count(~yes & ~true).alias("tn"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f05", share(1.25 * F.col("precision") * F.col("recall"), 0.25 * F.col("precision") + F.col("recall")))


def end_to_end(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, n_pred, n_true, precision, recall, f05) over all true pairs: what blocking missed counts as missed."""
    tp = predicted.select("s1", "tgt").join(truth.select("s1", "tgt"), ["s1", "tgt"], "left_semi").agg(F.count("*").alias("tp"))
    n = predicted.agg(F.count("*").alias("n_pred")).join(truth.agg(F.count("*").alias("n_true"))).join(tp)
    p, r = share(F.col("tp"), F.col("n_pred")), share(F.col("tp"), F.col("n_true"))
    return n.withColumns({"precision": p, "recall": r}).withColumn("f05", share(1.25 * F.col("precision") * F.col("recall"), 0.25 * F.col("precision") + F.col("recall"))).select("tp", "n_pred", "n_true", "precision", "recall", "f05")


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, empties, distinct_values) of every column."""
    sums = df.agg(F.count("*").alias("rows"), *[F.sum(((F.col(c) == "") | F.col(c).isNull()).cast("long")).alias(f"e_{c}") for c in df.columns], *[F.count_distinct(c).alias(f"d_{c}") for c in df.columns])
    return sums.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"e_{c}").alias("empties"), F.col(f"d_{c}").alias("distinct_values")) for c in df.columns])).alias("x")).select("x.column", "rows", "x.empties", "x.distinct_values")


def country_table(scored: DataFrame, queries: DataFrame, n_true: DataFrame, truth: DataFrame, rule: dict) -> DataFrame:
    """(country, queries, singles, f05) of a rule: how many S1, the share of them without a match, and their score."""
    each = per_query(queries, n_true, decide(scored, rule), truth).join(queries, "s1").join(n_true, "s1", "left")
    single = F.coalesce("n_true", F.lit(0)) == 0
    return each.groupBy("country").agg(F.count("*").alias("queries"), F.avg(single.cast("double")).alias("singles"), F.avg("f05").alias("f05"))


def smaller_sets(scored: DataFrame, queries: DataFrame, n_true: DataFrame, truth: DataFrame, rule: dict, b: tuple[int, ...] = (0, 3, 5)) -> DataFrame:
    """(k_b, with_c, per_s1, f05) of a rule on smaller candidate sets: each cut of the second rank, with and without the address channel.

    ``scored`` has (s1, tgt, p, rank_a, rank_b, rank_c).
    """
    total, out = queries.agg(F.count("*").alias("total")), None
    for k_b in b:
        for with_c in (False, True):
            kept = scored.where((F.col("rank_a") < 1) | (F.col("rank_b") < k_b) | (F.lit(with_c) & (F.col("rank_c") < 1)))
            n = kept.join(queries.select("s1"), "s1", "left_semi").agg(F.count("*").alias("n")).join(total)
            row = macro_f05(queries, n_true, decide(kept, rule), truth).join(n).select(F.lit(k_b).alias("k_b"), F.lit(with_c).alias("with_c"), share(F.col("n"), F.col("total")).alias("per_s1"), "f05")
            out = row if out is None else out.unionByName(row)
    return out
