"""Katz backoff of any order over plain tables of n-grams: the model of ``katz`` evaluated recursively, order by order.

Each order has a table of its n-grams (context, word, count) and one of its contexts (what discounting left, spread over the
words that were not seen).  An order's probabilities rest on those of the order below, so the tables are made from the
first order up, and a text's distinct n-grams are looked up the same way.  ``katz`` packs two orders into an exchange
that meets the check tool's limits; this one takes any order, at the cost of a shuffle per table.

Contexts are words joined by a space, which no word holds; texts begin with markers that hold white space, as no word does.

Defined results: as ``katz``: a null or empty text is the end alone; a null doc_id takes part in training; repeated rows count
and are scored each; with nothing to learn from, every token has probability one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolera.llm.graph import settle
from tolera.llm.katz import FOLDS, HELD, K, Unigram, discounts

START, END = "\t", "\n"


def grams(docs: DataFrame, order: int) -> DataFrame:
    """row, doc_id, train, w and the contexts c1 (empty) .. c{order} of every token."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    rows = settle(docs.select(doc_id.alias("doc_id"), held.alias("held"), F.concat(words, F.array(F.lit(END))).alias("words")).withColumn("row", F.monotonically_increasing_id()))
    padded = F.concat(F.array(*[F.lit(START)] * (order - 1)).cast("array<string>"), F.col("words"))
    spread = rows.select("row", "doc_id", "held", padded.alias("padded"), F.posexplode("words").alias("at", "w"))
    contexts = [F.array_join(F.slice("padded", F.col("at") + order - m + 1, m - 1), " ").alias(f"c{m}") for m in range(1, order + 1)]
    return settle(spread.select("row", "doc_id", "held", "w", *contexts))


def _counts_of_counts(counts: DataFrame) -> np.ndarray:
    """n[1..K+1] and, before them, the tokens and distinct n-grams; one row."""
    each = [F.sum(F.when(F.col("c") == r, 1).otherwise(0)).alias(f"n{r}") for r in range(1, K + 2)]
    got = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), *each).first()
    return np.array([got["n"], got["v"], *[got[f"n{r}"] or 0 for r in range(1, K + 2)]], np.int64)


def _discounted(d: np.ndarray) -> Column:
    c = F.col("c")
    out = c.cast("double")
    for r in range(1, K + 1):
        out = F.when(c == r, F.lit(float(r * d[r]))).otherwise(out)
    return out


def model(tokens: DataFrame, order: int) -> tuple[Unigram, list[tuple[DataFrame, DataFrame]]]:
    """The first order, and for each order from the second on: (ctx, w, p) of n-grams and (ctx, alpha) of contexts."""
    train = tokens.where(~F.col("held"))
    words = settle(train.groupBy("w").agg(F.count("*").alias("c")))
    first = Unigram(_counts_of_counts(words))
    below = words.select(F.lit("").alias("ctx"), "w", (_discounted(first.d) / first.total).alias("p"))
    out = [(below, below.limit(0).select("ctx", F.lit(0.0).alias("alpha")))]
    for m in range(2, order + 1):
        # an n-gram's lower order is its own without the first word; it was seen, too
        counts = settle(train.groupBy(F.col(f"c{m}").alias("ctx"), F.col(f"c{m - 1}").alias("short"), "w").agg(F.count("*").alias("c")))
        stats = _counts_of_counts(counts)
        d = discounts(np.concatenate(([0], stats[2:])))
        joined = counts.join(below.select(F.col("ctx").alias("short"), "w", F.col("p").alias("low")), ["short", "w"])
        sums = joined.groupBy("ctx").agg(F.sum("c").alias("n"), F.sum(F.col("c") - _discounted(d)).alias("left"), F.sum("low").alias("mass"))
        some = F.col("left") > 1e-9
        sums = settle(sums.select("ctx", F.when(some, F.col("n")).otherwise(F.col("n") + 1).alias("total"), (F.when(some, F.col("left")).otherwise(1.0) / F.when(some, F.col("n")).otherwise(F.col("n") + 1) / (1 - F.col("mass"))).alias("alpha")))
        seen = settle(counts.join(sums, "ctx").select("ctx", "w", (_discounted(d) / F.col("total")).alias("p")))
        out.append((seen, sums.select("ctx", "alpha")))
        below = seen
    return first, out


def score(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, score (log10 probability) under the model of ``order``."""
    tokens = grams(docs, order)
    first, levels = model(tokens, order)
    names = [f"c{m}" for m in range(2, order + 1)]
    asked = settle(tokens.select("w", *names).distinct())
    p = asked.join(levels[0][0].select("w", F.col("p").alias("p1")), "w", "left").withColumn("p", F.coalesce("p1", F.lit(float(first.unknown)))).drop("p1")
    for m in range(2, order + 1):
        seen, contexts = levels[m - 1]
        p = p.join(seen.select(F.col("ctx").alias(f"c{m}"), "w", F.col("p").alias("own")), [f"c{m}", "w"], "left").join(contexts.withColumnRenamed("ctx", f"c{m}"), f"c{m}", "left")
        p = p.withColumn("p", F.coalesce("own", F.coalesce("alpha", F.lit(1.0)) * F.col("p"))).drop("own", "alpha")
    scored = tokens.join(settle(p.select("w", *names, F.log10("p").alias("log_p"))), ["w", *names])
    return scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), F.count("*").alias("n_tokens"), F.sum("log_p").alias("score")).drop("row")
