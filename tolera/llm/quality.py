"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model of a document's form gives its own evidence (log odds of good).  Sites have a host level
(``source``) and a path level (``source`` and ``lang``: the tables hold no paths, and a host's languages are its
sections).  By grouped aggregation the soft counts of good documents of a host are shrunk toward the global share, and
those of a path toward its host's posterior.  Each level has its own prior strength, the ratio of the variance within
groups to the variance between them (method of moments for unequal groups), so sparse groups stay near their parent
and groups that don't differ stay there whatever their size.  A document's posterior adds the log odds of its path,
relative to the global ones, to its own evidence; its own soft count is left out of its host's and its path's, so
that nothing is counted twice.

The model is fitted on at most ``SAMPLE`` labelled documents, taken in the order of a hash of the id; everything
else (site counts, shares, strengths, decisions) covers all documents.

Defined results: a null or empty text has no words; null hosts or languages are groups of their own; null and
repeated ids are carried through, one result row per input row; without labels of both classes the evidence
is a fixed prior model; an empty table gives an empty result; other columns are kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolera.llm.graph import settle
from tolera.llm.rules import CAPITALS, DIGITS, SYMBOLS, count_of, lines, marks, words

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Largest prior strength, in documents: for levels whose groups don't differ.
STRONGEST = 1e6

FEATURES = ("symbols", "capitals", "bangs", "bars", "variety", "lines", "word_length", "short", "digits")
#: Used where labels of both classes are missing: intercept and weights of FEATURES.
PRIOR = (4.0, -12.0, -8.0, -6.0, -12.0, -5.0, -6.0, 0.0, -0.5, -2.0)


def form(docs: DataFrame) -> DataFrame:
    """docs with the columns ``_x`` (array of FEATURES, each within 0..1) and ``_empty``."""
    step = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    step = step.withColumn("_w", words("_t")).withColumn("_l", lines("_t")).withColumn("_m", marks("_t"))
    n = F.greatest(F.size("_w"), F.lit(1))
    wordy = F.greatest(F.length(F.array_join("_w", "")), F.lit(1))
    of = lambda letters: count_of("_m", letters)
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double")))
    x = F.array(
        unit(of(SYMBOLS) / n),
        unit(of(CAPITALS) / wordy),
        unit(of("!") / n),
        unit(of("|") / n),
        # repetition beyond what length alone explains
        unit(F.when(F.size("_w") >= 10, 1 - F.size(F.array_distinct("_w")) / n - 0.05 * F.log(n / F.lit(10.0))).otherwise(F.lit(0.0))),
        unit(1 - F.size(F.array_distinct("_l")) / F.greatest(F.size("_l"), F.lit(1))),
        unit(wordy / n / 20),
        unit(1 - n / 30),
        unit(of(DIGITS) / wordy),
    )
    return step.withColumn("_x", x).withColumn("_empty", F.size("_w") == 0).drop("_t", "_w", "_l", "_m")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps: intercept, then weights."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the SAMPLE labelled rows of smallest id hash (bounded, so it may be collected)."""
    sample = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_y").limit(SAMPLE)
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id")
    got = form(text).select("_id", "_y", "_x").orderBy("_id", "_y").limit(SAMPLE).collect()
    y = np.array([r["_y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return np.array(PRIOR)
    return logistic(np.array([r["_x"] for r in got], float), y)


def evidence(weights: np.ndarray) -> Column:
    z = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        z = z + F.lit(float(w)) * F.get(F.col("_x"), F.lit(i))
    return F.when(F.col("_empty"), F.lit(-20.0)).otherwise(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z)))


def strength(within: float, between: float) -> float:
    """Documents that a parent's share is worth, from the variances within and between groups."""
    return min(STRONGEST, max(1.0, within / between)) if between > 0 else STRONGEST


def sites(scored: DataFrame) -> DataFrame:
    """(source, lang, path_good, path_n, host_good, host_n, host_posterior, path_posterior, prior, host_strength,
    path_strength) from ``scored`` (source, lang, _z).

    Grouped sums only, aggregated on the map side, so a host of any size is one row per task; the driver sees one row."""
    p = 1 / (1 + F.exp(-F.col("_z")))
    path = settle(scored.groupBy("source", "lang").agg(F.sum(p).alias("path_good"), F.count("*").alias("path_n"), F.sum(p * p).alias("_sq")))
    host = path.groupBy("source").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n")).withColumnRenamed("source", "_host")
    joined = path.join(host, F.col("source").eqNullSafe(F.col("_host"))).drop("_host")
    square = lambda a, n: F.col(a) * F.col(a) / F.col(n)
    share = F.col("path_n") / F.col("host_n")  # each host's values, once a host, are sums over its paths
    total = joined.agg(
        F.sum("path_n").alias("n"), F.sum("path_good").alias("good"), F.sum("_sq").alias("sq"), F.count("*").alias("paths"), F.countDistinct(F.struct("source")).alias("hosts"),
        F.sum(square("path_good", "path_n")).alias("path_sq"), F.sum(share * square("host_good", "host_n")).alias("host_sq"),
        F.sum(F.col("path_n") * F.col("path_n") / F.col("host_n")).alias("path_nn"), F.sum(share * F.col("host_n") * F.col("host_n")).alias("host_nn"),
    ).first()
    n, good, paths, hosts = (float(total[c] or 0) for c in ("n", "good", "paths", "hosts"))
    sq, path_sq, host_sq, path_nn, host_nn = (float(total[c] or 0) for c in ("sq", "path_sq", "host_sq", "path_nn", "host_nn"))
    mean = (good + 1) / (n + 2)
    ratio = lambda a, b, other: a / b if b > 0 else other
    inside = ratio(sq - path_sq, n - paths, mean * (1 - mean))
    path_strength = strength(inside, ratio(path_sq - host_sq - (paths - hosts) * inside, n - path_nn, 0.0))
    inside = ratio(sq - host_sq, n - hosts, mean * (1 - mean))
    host_strength = strength(inside, ratio(host_sq - ratio(good * good, n, 0.0) - (hosts - 1) * inside, n - ratio(host_nn, n, 0.0), 0.0))
    out = joined.drop("_sq").withColumns({"prior": F.lit(mean), "host_strength": F.lit(host_strength), "path_strength": F.lit(path_strength)})
    out = out.withColumn("host_posterior", (F.col("host_good") + F.col("host_strength") * F.col("prior")) / (F.col("host_n") + F.col("host_strength")))
    return out.withColumn("path_posterior", (F.col("path_good") + F.col("path_strength") * F.col("host_posterior")) / (F.col("path_n") + F.col("path_strength")))


def _quality() -> Column:
    """Posterior of a document, from ``_z`` and its site's sums without the document itself."""
    inside = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    odds = lambda c: F.log(inside(c) / (1 - inside(c)))
    own = 1 / (1 + F.exp(-F.col("_z")))
    host = (F.col("host_good") - own + F.col("host_strength") * F.col("prior")) / (F.col("host_n") - 1 + F.col("host_strength"))
    path = (F.col("path_good") - own + F.col("path_strength") * host) / (F.col("path_n") - 1 + F.col("path_strength"))
    return 1 / (1 + F.exp(-(F.col("_z") + odds(path) - odds(F.col("prior")))))


_SITE = {"source": "_source", "lang": "_lang"}


def _of_site() -> Column:
    return F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, source, lang, evidence, host_posterior, path_posterior, quality, kept."""
    weights = train(docs, labels)
    scored = settle(form(docs.select("doc_id", "text", "source", "lang")).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", evidence(weights).alias("_z")))
    joined = scored.join(sites(scored).withColumnsRenamed(_SITE), _of_site(), "left").withColumn("quality", _quality())
    return joined.select("doc_id", "source", "lang", F.col("_z").alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with their columns; decided row by row, so texts aren't shuffled by id."""
    weights = train(docs, labels)
    columns = docs.columns
    scored = settle(form(docs.select("text", "source", "lang")).select("source", "lang", evidence(weights).alias("_z")))
    site = settle(sites(scored).withColumnsRenamed(_SITE))
    clash = [c for c in site.columns if c in columns]
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    joined = form(own).withColumn("_z", evidence(weights)).join(site, _of_site(), "left")
    return joined.where(_quality() >= threshold).select(*[F.col(f"_own_{c}" if c in clash else c).alias(c) for c in columns])
