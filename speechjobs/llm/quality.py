"""Quality by a sparse rule ensemble.

Statistics of the text are Spark columns. Boosted trees over a bounded sample of labelled rows give paths, each a
conjunction of thresholds on statistics. A logistic regression with an L1 penalty weights the rules, most of them
with zero, and the rest is compiled into one Spark column expression that scores every row.

Defined results: null text is empty text, with all statistics zero; labels that are null, or held out, are not
learned from; with one label only, or none, or too few rows for a rule, the score is the smoothed share of label 1; null ids count as held out;
repeated labels count once, and of rows with one id one text is learned from; very long texts are read whole; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, id_remainder, text_of

SAMPLE = 20_000
HASHES = 1 << 40
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.3
PENALTY = 0.002
HELD_OUT = (5, 0)
THRESHOLD = 0.3
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound)

COUNTS = {
    "words": WORD, "symbols": r"[^\p{L}\p{N}\s]", "upper": r"\p{Lu}", "digits": r"\p{N}", "marks": r"[$*#%&]", "bars": r"\|", "shouts": "[!?]",
    "stops": r"[.](?=\s|$)", "lines": r"\n", "short": r"(?<!\S)\p{L}{1,3}(?!\S)", "capitals": r"(?<!\S)\p{Lu}\p{Ll}", "long": r"\S{14,}", "odd": r"(?<!\S)\P{L}+(?!\S)",
}
STATISTICS = ["n_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "bar_share", "shout_share", "words_per_stop", "line_length", "short_share", "capital_share", "long_share", "odd_share", "distinct_share", "line_repeats"]


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, carried columns, and the statistics of each text."""
    rows = text_of(docs, *carried).select("doc_id", *carried, "text", *(F.regexp_count("text", F.lit(p)).cast("double").alias(f"_{k}") for k, p in COUNTS.items()), F.length("text").cast("double").alias("_n"))
    rows = rows.withColumn("_parts", F.split("text", " ")).withColumn("_rows", F.split("text", "\n"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    columns = [
        F.col("_words"), share("_n", "_words"), share("_symbols", "_n"), share("_upper", "_n"), share("_digits", "_n"), share("_marks", "_n"), share("_bars", "_words"), share("_shouts", "_words"),
        F.col("_words") / (F.col("_stops") + 1), F.col("_n") / (F.col("_lines") + 1), share("_short", "_words"), share("_capitals", "_words"), share("_long", "_words"), share("_odd", "_words"),
        F.size(F.array_distinct("_parts")).cast("double") / F.size("_parts"), 1 - F.size(F.array_distinct("_rows")).cast("double") / F.size("_rows"),
    ]
    return rows.select("doc_id", *carried, *(c.alias(k) for k, c in zip(STATISTICS, columns, strict=True)))


def labelled_sample(labels: DataFrame, name: str, size: int) -> DataFrame:
    """doc_id, label for at most `size` learning rows: those with the smallest hashes of the id, found without a sort.

    A count gives the hashes below which about twice as many lie; counts in 1,000 slices of these give the cut.
    """
    mod, out = HELD_OUT
    rows = labels.where(labels["doc_id"].isNotNull() & labels[name].isin(0, 1) & (id_remainder(labels["doc_id"], mod) != out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).distinct()
    n = rows.count()
    if n <= size:
        return rows
    top, slices = min(HASHES, HASHES * 2 * size // n), 1000
    place = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    near = rows.where(place < top).withColumn("_slice", F.floor(place * slices / F.lit(top)))
    cut, held = slices, 0
    for r in near.groupBy("_slice").agg(F.count("*").alias("n")).orderBy("_slice").collect():
        held += r["n"]
        if held > size:
            cut = r["_slice"]
            break
    return near.where(F.col("_slice") < cut).drop("_slice")


def learning_rows(docs: DataFrame, labels: DataFrame, name: str, size: int) -> DataFrame:
    """doc_id, label, text for at most `size` labels; of rows with one id the smallest text counts."""
    return text_of(docs).join(F.broadcast(labelled_sample(labels, name, size)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rows: np.ndarray, path: tuple, out: dict) -> np.ndarray:
    """One regression tree by histograms; returns its values on all rows and adds its paths to `out`."""
    value = np.zeros(len(binned))
    value[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 20:
        return value
    g, h, best = gradient[rows].sum(), hessian[rows].sum(), (1e-3, None, None)
    for f in range(binned.shape[1]):
        left_g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], BINS))[:-1]
        left_h = np.cumsum(np.bincount(binned[rows, f], hessian[rows], BINS))[:-1]
        n = np.cumsum(np.bincount(binned[rows, f], minlength=BINS))[:-1]
        gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
        gain[(n < 5) | (n > len(rows) - 5)] = 0
        if gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        return value
    _, f, b = best
    for above in (False, True):
        part = rows[(binned[rows, f] > b) == above]
        step = (*path, (f, above, b))
        out[tuple(sorted(step))] = None
        value[part] = grow(binned, gradient, hessian, depth - 1, part, step, out)[part]
    return value


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, p = x.shape
    z = np.c_[np.ones(n), x]
    v = np.ones(p + 1)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(float(v @ (z.T @ (z @ v))), 1e-9)
    w = np.zeros(p + 1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[0] = np.log(share / (1 - share))
    u, t = w.copy(), 1.0
    for _ in range(rounds):
        new = u - step * (z.T @ (1 / (1 + np.exp(-np.clip(z @ u, -30, 30))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return float(np.log(share / (1 - share))), []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, paths, rng = np.full(len(y), np.log(share / (1 - share))), {}, np.random.default_rng(11)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        inside = np.zeros(len(y), bool)
        inside[rows] = True
        tree: dict = {}
        grow(binned, y - p, p * (1 - p), DEPTH, rows, (), tree)
        for path in tree:  # leaves and inner nodes alike move the score by their mean residual
            hit = np.logical_and.reduce([(binned[:, f] > b) == above for f, above, b in path])
            if len(path) == DEPTH or not any(set(path) < set(q) for q in tree):
                own = hit & inside
                score[hit] += RATE * (y - p)[own].sum() / ((p * (1 - p))[own].sum() + 1)
        paths |= tree
    if not paths:  # too few rows for a split
        return float(np.log(share / (1 - share))), []
    rules = [tuple((f, above, float(edges[f][min(b, len(edges[f]) - 1)])) for f, above, b in path) for path in paths]
    hits = np.stack([np.logical_and.reduce([(x[:, f] > c) == above for f, above, c in rule]) for rule in rules], axis=1).astype(np.float64)
    intercept, weights = lasso(hits, y, PENALTY)
    return intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as one column over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        hit = F.lit(True)
        for f, above, bound in rule:
            hit = hit & ((F.col(STATISTICS[f]) > bound) if above else (F.col(STATISTICS[f]) <= bound))
        total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    chosen = learning_rows(docs, labels, "quality", sample)
    rows = statistics(chosen, "label").orderBy("doc_id", "label").toPandas()
    return fit_rules(rows[STATISTICS].to_numpy(float).reshape(-1, len(STATISTICS)), rows["label"].to_numpy(float))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]]) -> DataFrame:
    mod, out = HELD_OUT
    scored = statistics(docs).select("doc_id", compiled(*model).alias("score"))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), mod) == out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
