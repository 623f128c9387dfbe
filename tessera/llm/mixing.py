"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture's bytes. The share over the source's own bytes gives its
repetition rate; every document draws its number of copies from a Poisson distribution with that mean,
by inverting the distribution function at a number hashed from the seed and the document's id. Copies
are exploded and the rows are sorted by another hash, which is a global shuffle that anyone can repeat.

The rates need one grouped sum per source (combined before the exchange). They are joined back by
broadcast if there are at most ``BROADCAST_SOURCES`` sources, else by a shuffled join that the engine
splits at a hot source. Rates above ``PART`` are drawn as a sum of independent parts, so the inversion
neither underflows nor runs long.

Defined results: a null source is a source of its own; null text has no bytes (each row weighs its bytes
plus one); rows with equal ids draw the same count; a null id draws by its text; a source without a
target weight gets none and its documents no copies; an empty table gives an empty result; extra columns
are kept, inner names carry the prefix ``__mx_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which the table of rates is broadcast (about 50 bytes each).
BROADCAST_SOURCES = 100_000
#: Largest mean of one draw.
PART = 16.0
_SCALE = float(16**13)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by '|': 52 bits, never 0 or 1."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _SCALE


def poisson(rate: Column, u: Column) -> Column:
    """The smallest k whose Poisson distribution function at ``rate`` (up to ``PART``) reaches u."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))
    done = F.aggregate(
        F.sequence(F.lit(1), most),
        start,
        lambda a, i: F.when(u <= a["cdf"], a).otherwise(F.struct(i.alias("k"), (a["p"] * rate / i).alias("p"), (a["cdf"] + a["p"] * rate / i).alias("cdf"))),
    )
    return done["k"]


def copies(rate: Column, seed: int, key: Column) -> Column:
    """Copies of a document: a sum of equal parts of at most ``PART`` each, drawn from separate hashes."""
    n = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    drawn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + poisson(rate / n, uniform(F.lit(str(seed)), key, i.cast("string"))))
    return F.when(rate > 0, drawn).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, budget: float, power: float) -> DataFrame:
    """Per source: __mx_source, bytes, rate.

    Targets are ``weights`` (any scale), or the sources' bytes to the given power if None. ``budget`` is
    the mixture's expected size as a multiple of the corpus.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sums = docs.groupBy(F.col("source").cast("string").alias("__mx_source")).agg(F.sum(size).cast("double").alias("bytes"))
    if weights is None:
        sums = sums.withColumn("target", F.pow("bytes", F.lit(power)))
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("__mx_source").eqNullSafe(F.lit(name)), float(w)).otherwise(target)
        sums = sums.withColumn("target", target)
    row = sums.agg(F.sum("bytes").alias("b"), F.sum("target").alias("t"), F.count("*").alias("n")).first()
    whole = F.lit(float(row["b"] or 0) * budget / float(row["t"] or 1))
    rates = sums.withColumn("rate", whole * F.col("target") / F.col("bytes"))
    return F.broadcast(rates) if row["n"] <= BROADCAST_SOURCES else rates


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, power: float = 0.5, seed: int = 7) -> DataFrame:
    """Copies of documents in shuffled order: all columns of ``docs``, and __mx_rate, __mx_copy, __mx_order."""
    rates = source_rates(docs, weights, budget, power)
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    joined = docs.withColumn("__mx_source", F.col("source").cast("string")).join(rates.select(F.col("__mx_source").alias("__mx_s"), F.col("rate").alias("__mx_rate")), F.col("__mx_source").eqNullSafe(F.col("__mx_s")))
    counted = joined.withColumn("__mx_key", key).withColumn("__mx_n", copies(F.col("__mx_rate"), seed, F.col("__mx_key")))
    told = counted.filter("__mx_n > 0").withColumn("__mx_copy", F.explode(F.sequence(F.lit(0), F.col("__mx_n") - 1)))
    order = F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "__mx_key", F.col("__mx_copy").cast("string"))), 1, 15)
    placed = told.withColumn("__mx_order", F.conv(order, 16, 10).cast("long"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], "__mx_rate", "__mx_copy", "__mx_order")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """Copies of documents with the columns of documents alone, in globally shuffled order."""
    return mix(docs, **how).orderBy("__mx_order", "doc_id", "__mx_copy").select(*[F.col(f"`{c}`") for c in docs.columns])
