"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good, votes bad or abstains on a document.  The votes are counted by pattern (at most
3**rules rows, whatever the input), expectation-maximisation over the counts estimates each rule's
accuracy and the share of good documents without labels, and the posterior probability of a good document
replaces a filter that every rule must pass.

Defined results: a null or empty text has no words, and so fails the base; null and repeated ids are carried
through, one result row per input row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolera.llm.graph import settle

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"


def words(text: str) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines(text: str) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def marks(text: str) -> Column:
    """Symbols, exclamation marks, capitals and digits of a text: one pass, so that they are counted on little."""
    return F.regexp_replace(text, "[^#*$%&|<>!A-Z0-9]+", "")


def count_of(column: str, letters: str) -> Column:
    return F.length(column) - F.length(F.translate(column, letters, ""))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame) -> DataFrame:
    """docs with a struct column ``_q`` of counts; no shuffle, nothing leaves the JVM."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.withColumn("_t", text)
    step = step.withColumn("_w", words("_t")).withColumn("_m", marks("_t"))
    step = step.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    step = step.withColumn("_l", lines("_t"))
    n = F.size("_h")
    gram = F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(5)]),
    )
    step = step.withColumn("_g", F.when(n >= 5, gram).otherwise(F.array().cast("array<long>")))
    # Only a text with equal windows sorts them: (hash, start) pairs, then neighbours are compared.
    pairs = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    s = F.col("_s")
    like = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    again = F.filter(s, lambda x, j: like(x, j - 1) | like(x, j + 1))
    step = step.withColumn("_f", F.when(s.isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))))
    f = F.col("_f")
    covered = F.aggregate(F.transform(f, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(f, j + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n_lines = F.size("_l")
    out = step.withColumn(
        "_q",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            count_of("_m", SYMBOLS).cast("long").alias("n_symbols"),
            (n_lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            n_lines.cast("long").alias("n_lines"),
            F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
            count_of("_m", "!").cast("long").alias("n_bangs"),
            count_of("_m", CAPITALS).cast("long").alias("n_upper"),
            count_of("_m", DIGITS).cast("long").alias("n_digits"),
        ),
    )
    return out.drop("_t", "_w", "_m", "_h", "_l", "_g", "_s", "_f")


def _share(a: str, b: str) -> Column:
    return F.col(f"_q.{a}") / F.greatest(F.col(f"_q.{b}"), F.lit(1))


def _vote(value: Column, good: float, bad: float) -> Column:
    """Good up to ``good``, bad from ``bad``, else no vote."""
    return F.when(value <= good, 1).when(value >= bad, -1).otherwise(0)


def base_failed() -> Column:
    return (F.col("_q.n_words") < 10) | (100 * F.col("_q.n_repeat_words") > 20 * F.col("_q.n_words"))


def _rules() -> dict[str, Column]:
    """name -> vote.  Every rule looks at another kind of defect."""
    mean = _share("word_chars", "n_words")
    return {
        "symbols": _vote(_share("n_symbols", "n_words"), 0.02, 0.2),
        "bangs": _vote(_share("n_bangs", "n_words"), 0.05, 0.3),
        "capitals": _vote(_share("n_upper", "word_chars"), 0.08, 0.3),
        "digits": _vote(_share("n_digits", "word_chars"), 0.05, 0.35),
        "repeats": _vote(_share("n_repeat_words", "n_words"), 0.03, 0.18),
        "variety": _vote(F.when(F.col("_q.n_words") >= 30, 1 - _share("n_distinct", "n_words")).otherwise(F.lit(0.6)), 0.45, 0.75),
        "lines": _vote(_share("n_dup_lines", "n_lines"), 0.05, 0.5),
        "word_length": F.when((mean >= 3) & (mean <= 9), 1).when((mean < 2.2) | (mean > 13), -1).otherwise(0),
        "size": F.when(F.col("_q.n_words") < 10, -1).when(F.col("_q.n_words") >= 25, 1).otherwise(0),
    }


RULES = ("symbols", "bangs", "capitals", "digits", "repeats", "variety", "lines", "word_length", "size")


def votes(features_: DataFrame) -> DataFrame:
    """With ``_v``: the votes in the order of RULES, -1 bad, 1 good, 0 none."""
    rules = _rules()
    return features_.withColumn("_v", F.array(*[rules[k] for k in RULES]))


#: Votes that the prior of a rule's behaviour in a class is worth.
WEIGHT = 20.0
#: Largest share of bad votes that a rule may cast on good documents.
ALARM = 0.01
#: ([class] shares, [class][rule] probability that a vote is "bad").
Model = tuple[list[float], list[list[float]]]


def expect(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 80) -> Model:
    """Class shares and each rule's voting in each class, from counts of vote patterns.

    Class 0 is good; class i + 1 is bad in the way that rule i looks for.  Defects exclude each other more often than
    not, so one bad class with independent votes would call a document good because most rules found nothing.
    Abstaining is no evidence.  Priors are worth ``WEIGHT`` votes, however many documents there are.  What tells the
    classes apart is a constraint on the estimates: a rule votes bad on no more than ``ALARM`` of the good documents it
    votes on (else a common defect could as well be a habit of good documents).  Without documents the priors remain."""
    m = len(patterns[0][0]) if patterns else len(RULES)
    usual, own, other = 0.002, 0.97, 0.1
    first = [[usual] * m] + [[own if i == c else other for i in range(m)] for c in range(m)]
    share, table = [0.8] + [0.2 / m] * m, [row[:] for row in first]
    for _ in range(rounds):
        size = [1.0] * (m + 1)
        bad = [[p * WEIGHT for p in row] for row in first]
        cast = [[WEIGHT] * m for _ in first]
        for votes, n in patterns:
            z = [math.log(share[c]) + sum(math.log(table[c][i] if v < 0 else 1 - table[c][i]) for i, v in enumerate(votes) if v) for c in range(m + 1)]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            for c, x in enumerate(e):
                w = n * x / sum(e)
                size[c] += w
                for i, v in enumerate(votes):
                    if v:
                        cast[c][i] += w
                        bad[c][i] += w * (v < 0)
        share = [x / sum(size) for x in size]
        table = [[b / k for b, k in zip(*rows, strict=True)] for rows in zip(bad, cast, strict=True)]
        table[0] = [min(x, ALARM) for x in table[0]]
    return share, table


def posterior(model: Model) -> Column:
    """Probability that a document is good, given its votes ``_v``."""
    share, table = model
    odds = F.lit(0.0)
    for c in range(1, len(share)):
        z = F.lit(math.log(share[c] / share[0]))
        for i, (good, bad) in enumerate(zip(table[0], table[c], strict=True)):
            vote = F.get(F.col("_v"), F.lit(i))
            z = z + F.when(vote == -1, math.log(bad / good)).when(vote == 1, math.log((1 - bad) / (1 - good))).otherwise(0.0)
        odds = odds + F.exp(z)
    return 1 / (1 + odds)


def fit(voted: DataFrame) -> Model:
    """Counts the vote patterns (bounded by 3**rules) and runs expectation-maximisation on them."""
    counted = voted.groupBy("_v").agg(F.count("*").alias("n")).collect()
    return expect(sorted((tuple(r["_v"]), r["n"]) for r in counted))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, quality (posterior) and each rule's vote."""
    seen = settle(votes(features(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long").alias("doc_id"), "_q", "_v"))
    probability = posterior(fit(seen))
    return seen.select(
        "doc_id",
        *[F.col(f"_q.{c}").alias(c) for c in COUNTS],
        base_failed().alias("base_failed"),
        (~base_failed() & (probability >= threshold)).alias("kept"),
        probability.alias("quality"),
        *[F.get(F.col("_v"), F.lit(i)).alias(f"vote_{k}") for i, k in enumerate(RULES)],
    )


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with their columns; decided row by row, so texts aren't shuffled."""
    model = fit(votes(features(docs.select("text"))).select("_v"))
    good = ~base_failed() & (posterior(model) >= threshold)
    # The condition must not move below the projections, where each of its many votes would count the text anew; an
    # expression that isn't deterministic stays where it is.
    once = F.when(F.monotonically_increasing_id() >= 0, good)
    return votes(features(docs)).withColumn("_keep", once).where("_keep").drop("_q", "_v", "_keep")
