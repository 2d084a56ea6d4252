"""Mixing to target weights with soft domain membership (DataFrame functions only).

A naive Bayes classifier over binned text statistics, counted on the labelled rows, gives every document a posterior
over domains. Rates w >= 0 minimise

    1/2 * sum_d (sum_i t_i p_id w_i / T - target_d)^2  +  RIDGE/2 * sum_i t_i / T * (w_i - 1)^2

(t_i: words of document i, T: all words, p_id: its posterior) by accelerated projected gradient. Posteriors are kept in
full and a step is one aggregate over the documents; only the residual (one number per domain) comes to the driver. Every
document moves by itself, so its rate is replayed from the residuals since the rates were last written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, row_key, written

# Character classes whose share of a text is a statistic.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "sign": r"[|!#$%&*@+=~^_<>]", "umlaut": r"[äöüß]",
           "acute": r"[áíóúñ]", "grave": r"[èêàçùâé]"}
STATISTICS = (*CLASSES, "word_length", "log_words")
#: Quantile bins per statistic, strength of staying near rate 1, most steps, largest change at rest.
BINS, RIDGE, STEPS, REST = 12, 0.01, 60, 1e-6
#: Steps that are replayed before the rates are written.
REPLAYED = 6


def _statistics(docs: DataFrame, *extra: str) -> DataFrame:
    text, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    marked = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "w")      # one mark per word
    words = F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", ""))
    shares = [((F.length(text) - F.length(F.regexp_replace(text, c + "+", ""))) / n).alias(k) for k, c in CLASSES.items()]
    d = documents(docs, row_key().alias("row_key"), *extra).select("*", words.cast("long").alias("n_words"), *shares)
    return d.select("doc_id", "row_key", *extra, "n_words", F.array(
        *CLASSES, F.length("text") / F.greatest("n_words", F.lit(1)), F.log1p("n_words")).alias("stats"))


def _binned(cuts: list[list[float]]) -> Column:
    """Bin numbers of the statistics."""
    def below(k: int):
        return lambda x: x < F.get("stats", F.lit(k))

    return F.array(*[F.size(F.filter(F.lit(c), below(k))) if c else F.lit(0) for k, c in enumerate(cuts)])


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], *extra: str) -> DataFrame:
    """(doc_id, row_key, n_words, posterior array in the order of ``domains``) of every row of ``docs``."""
    stats = written(_statistics(docs, *extra))
    known = (labelled.where("doc_id is not null and domain is not null").select(F.col("doc_id").cast("long"), "domain")
             .where(F.col("domain").isin(domains)).distinct())
    train = written(stats.select("doc_id", "stats").join(known, "doc_id"))
    at = [i / BINS for i in range(1, BINS)]
    quantiles = train.agg(*[F.percentile_approx(F.get("stats", F.lit(k)), F.lit(at), F.lit(5000)).alias(str(k))
                            for k in range(len(STATISTICS))]).first()
    cuts = [sorted(set(quantiles[k] or [])) for k in range(len(STATISTICS))]
    cells = (train.select("domain", F.posexplode(_binned(cuts)).alias("k", "bin"))
             .groupBy("domain", "k", "bin").agg(F.count(F.lit(1)).alias("n")).collect())
    count = {(r["domain"], r["k"], r["bin"]): r["n"] for r in cells}
    size = {d: sum(n for (e, k, _), n in count.items() if e == d and k == 0) for d in domains}
    total = sum(size.values())
    logs = []
    for d in domains:
        prior = F.lit(math.log((size[d] + 1.0) / (total + len(domains))))
        table = [[math.log((count.get((d, k, b), 0) + 0.5) / (size[d] + 0.5 * (len(c) + 1))) for b in range(len(c) + 1)]
                 for k, c in enumerate(cuts)]
        logs.append(sum((F.get(F.lit(row), F.get("bins", F.lit(k))) for k, row in enumerate(table)), prior))
    s = stats.withColumn("bins", _binned(cuts)).withColumn("logs", F.array(*logs))
    s = s.withColumn("odds", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return s.withColumn("total", total).select("doc_id", "row_key", *extra, "n_words",
                                               F.transform("odds", lambda x: x / F.col("total")).alias("posterior"))


def _dot(values: list[float]) -> Column:
    """Product of the posterior with ``values``."""
    return sum((F.get("posterior", F.lit(k)) * F.lit(x) for k, x in enumerate(values)), F.lit(0.0))


def _moved(state: DataFrame, residual: list[float], present: list[float], momentum: float) -> DataFrame:
    """``state`` (posterior, w, y, ...) after a step: w the rates, y the look-ahead point.

    A document's step is 1 / (p_i . present + RIDGE), present being the domains' shares at rate 1: the sum of its row
    of the (non-negative) Hessian, so together the steps never overshoot, and rare domains don't wait for large ones."""
    slope = _dot(residual) + RIDGE * (F.col("y") - 1)
    s = state.withColumn("next", F.greatest(F.lit(0.0), F.col("y") - slope / (_dot(present) + RIDGE)))
    return (s.withColumn("y", F.col("next") + momentum * (F.col("next") - F.col("w")))
            .withColumn("w", F.col("next")).drop("next"))


def fit_rates(documents_: DataFrame, targets: list[float]) -> DataFrame:
    """``documents_`` (posterior, n_words, ...) with w, their rates when the steps towards ``targets`` rest."""
    total = float(documents_.agg(F.sum("n_words")).first()[0] or 0)
    state = documents_.withColumns({"w": F.lit(1.0), "y": F.lit(1.0)})
    present: list[float] = []
    before: list[float] = []
    step = 1.0
    for k in range(STEPS if total else 0):
        v = F.col("y") * F.col("n_words") / total
        shares = state.agg(*[F.sum(F.get("posterior", F.lit(k)) * v) for k in range(len(targets))]).first()
        residual = [float(x) - t for x, t in zip(shares, targets)]
        present = present or list(map(float, shares))
        after = (1 + math.sqrt(1 + 4 * step * step)) / 2
        state = _moved(state, residual, present, (step - 1) / after)
        step = after
        if before and max(abs(a - b) for a, b in zip(residual, before)) < REST:
            break
        before = residual
        if (k + 1) % REPLAYED == 0:
            state = written(state)
    return state.drop("y")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_words, domain (likeliest), posterior (array in the sorted order
    of the target domains), rate (how often to take the document, 0 or more), row_key.

    ``labelled`` (doc_id, domain) teaches the classifier; rows with a null or unknown domain are skipped, a document
    with two domains teaches both. ``targets`` are weights per domain, scaled to sum to 1; a domain without labelled rows
    keeps a small prior. Null and empty texts have no words: they don't count in the totals and get the rate of their
    posterior. Without any words every rate is 1. Repeated rows are weighed one by one, a null doc_id teaches nothing.
    An empty table gives no rows."""
    domains = sorted(targets)
    scale = sum(targets.values())
    docs = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    p = written(posteriors(docs, labelled, domains, "source"))
    p = fit_rates(p, [targets[d] / scale for d in domains])
    likeliest = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return p.select("doc_id", "source", "n_words", F.element_at(F.lit(domains), likeliest).alias("domain"), "posterior",
                    F.col("w").alias("rate"), "row_key")
