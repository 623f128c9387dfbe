"""Weak supervision over quality rules, as DataFrame code.

Each rule looks at one trait of a document and votes good (1), bad (-1) or abstains (0). Nobody knows the
true quality; expectation-maximisation over the votes of all documents estimates how often each rule is
right and how common good documents are, and the posterior probability that a document is good decides,
instead of demanding that all rules pass.

Rules that look at kindred traits (many symbols, many words without letters) err together, so they aren't
taken for independent witnesses: a document is good or of one of a few kinds of junk (``KINDS``), and rules
err independently only given the kind. Each rule has a rate of votes against for good documents and one for
each kind. Where no other rule can tell, the starting belief stands: a good document breaks one rule in a
hundred, a document of a kind breaks half the rules of that kind. Limits are those of published rule sets
for web text (symbols to words, words without letters, capitals, repeated lines), loose enough that prose
keeps clear of them; no labels enter.

All statistics are computed inside the row (arrays and higher-order functions), so the text is never
exploded or shuffled. Votes are counted by pattern in one grouped sum. There are at most ``3 ** 10 = 59,049``
patterns whatever the number of documents, and the steps of the estimation run over these counts on the driver.

Defined results: null and empty texts have no words, fail the base rules and are not kept; equal texts
get equal results; a text of any length is one row; an empty table gives an empty result with the starting
model; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, spaced

WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window found twice or more in the text, the first one included.

    Hashes tell which windows may repeat; only those are compared as text, so the count is exact.
    """

    def covered(starts: Column) -> Column:
        done = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s + WINDOW - a["end"])).alias("n"), (s + WINDOW).alias("end")),
        )
        return done["n"]

    def twice(pairs: Column) -> Column:
        """Second fields of those sorted pairs whose first field equals a neighbour's."""
        return let(
            pairs,
            lambda p: F.transform(
                F.filter(
                    F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), ((F.get(p, i - 1)["k"] == x["k"]) | (F.get(p, i + 1)["k"] == x["k"])).alias("same"))),
                    lambda x: x["same"],
                ),
                lambda x: x["i"],
            ),
        )

    def starts(w: Column, hashes: Column) -> Column:
        maybe = twice(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i")))))
        exact = twice(F.array_sort(F.transform(maybe, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("k"), i.alias("i")))))
        return F.array_sort(exact)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(starts(w, h))).otherwise(F.lit(0)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(repeats)

    return let(words, count)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics that the rules look at, one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias(id_col), text.alias("__t"), spaced(F.col(text_col)).alias("__s"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    base = base.select(id_col, "__t", "__s", F.array_remove(F.split("__s", " "), "").alias("__w"), lines.alias("__l"))
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("long")
    single = lambda c: (F.length("__t") - F.length(F.replace("__t", F.lit(c), F.lit("")))).cast("long")
    return base.select(
        id_col,
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        count("[A-Z]").alias("n_capitals"),
        count("[.,;:!?]").alias("n_marks"),
        count("[0-9]").alias("n_digits"),
        single("!").alias("n_shouts"),
        F.regexp_count("__s", F.lit(r" [^\p{L} ]+(?= )")).cast("long").alias("n_bare"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes of each rule. A rule abstains where its statistic says little."""
    c = F.col
    words, chars, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    mean = c("word_chars") / words
    return {
        "symbols": _vote(c("n_symbols") < 0.02 * words, c("n_symbols") > 0.2 * words),
        "bare": _vote(c("n_bare") < 0.05 * words, c("n_bare") > 0.2 * words),
        "dup_lines": _vote(c("n_dup_lines") == 0, c("n_dup_lines") > 0.3 * lines),
        "repeats": _vote(c("n_repeat_words") <= 0.05 * words, c("n_repeat_words") > 0.15 * words),
        "variety": _vote(c("n_distinct") >= 0.4 * words, c("n_distinct") < 0.15 * words),
        "capitals": _vote(c("n_capitals") < 0.15 * chars, c("n_capitals") > 0.4 * chars),
        "marks": _vote((c("n_marks") >= 0.02 * words) & (c("n_marks") <= 0.5 * words), c("n_marks") > 0.9 * words),
        "shouting": _vote(c("n_shouts") < 0.02 * words, c("n_shouts") > 0.2 * words),
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
        "digits": _vote(c("n_digits") < 0.1 * chars, c("n_digits") > 0.3 * chars),
    }


#: Kinds of junk, and the rules that are there to catch each.
KINDS = {"symbols": ("symbols", "bare"), "repetition": ("dup_lines", "repeats", "variety"), "shouting": ("capitals", "marks", "shouting"), "no_words": ("word_length", "digits")}
#: Starting rates of votes against: of good documents, by the rules of a document's own kind, and by other rules.
GOOD_RATE, OWN_RATE, OTHER_RATE = 0.01, 0.5, 0.05
GOOD_SHARE = 0.9


def start(names: list[str], kinds: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of votes against by class (good, then the kinds) and rule, and the classes' shares."""
    rates = [[GOOD_RATE] * len(names)] + [[OWN_RATE if n in own else OTHER_RATE for n in names] for own in kinds.values()]
    return np.array(rates), np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / len(kinds)] * len(kinds))


def fit(votes: DataFrame, names: list[str], kinds: dict[str, tuple[str, ...]], steps: int = 200, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Rates and shares by expectation-maximisation.

    Each step's counts are smoothed with ten imagined votes of the starting rates and one imagined document
    of each class. The columns ``names`` hold votes; their patterns, 3 to the number of rules at most, are
    counted in the cluster and read by the driver.
    """
    rows = votes.groupBy(*names).agg(F.count("*").alias("n")).collect()
    rates, shares = start(names, kinds)
    if not rows:
        return rates, shares
    found = np.array(sorted(tuple(r) for r in rows), np.float64)
    n, against, both = found[:, -1], found[:, :-1] == -1, found[:, :-1] != 0
    first = rates
    for _ in range(steps):
        p = memberships(against, both, rates, shares) * n[:, None]
        moved = np.clip((p.T @ against + 10 * first) / (p.T @ both + 10), 1e-4, 0.999)
        parts = (p.sum(axis=0) + 1) / (n.sum() + len(shares))
        change = max(np.abs(moved - rates).max(), np.abs(parts - shares).max())
        rates, shares = moved, parts
        if change < tolerance:
            break
    return rates, shares


def memberships(against: np.ndarray, both: np.ndarray, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """P(class | votes) of each pattern."""
    logs = against @ np.log(rates).T + (both & ~against) @ np.log(1 - rates).T + np.log(shares)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posterior(votes: list[Column], rates: np.ndarray, shares: np.ndarray) -> Column:
    """P(good | votes) as an expression."""
    odds = F.lit(0.0)
    for k in range(1, len(shares)):
        logit = F.lit(float(np.log(shares[k] / shares[0])))
        for i, v in enumerate(votes):
            against, for_it = np.log(rates[k, i] / rates[0, i]), np.log((1 - rates[k, i]) / (1 - rates[0, i]))
            logit = logit + F.when(v == 1, float(for_it)).when(v == -1, float(against)).otherwise(0.0)
        odds = odds + F.exp(logit)
    return 1 / (1 + odds)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict of each document.

    ``kept`` is false where the base rules fail: fewer than ten words, or more than a fifth of the words
    in repeated windows; elsewhere the posterior decides. The statistics are written once to the shared
    folder (numbers only) because both the fit and the verdicts read them.
    """
    stats = materialise(statistics(docs, id_col, text_col))
    votes = rules()
    voted = stats.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    rates, shares = fit(voted.select(*names), names, {k: tuple(f"vote_{r}" for r in own) for k, own in KINDS.items()})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = voted.withColumn("p_good", posterior([F.col(x) for x in names], rates, shares)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
