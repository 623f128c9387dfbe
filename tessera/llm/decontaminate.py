"""Benchmark decontamination by a prefix-filtered set join, as DataFrame code.

A benchmark item is cut into windows of ten consecutive words (an item of fewer words is one window).
A window is a set of shingles at fixed places: runs of five words, or the whole window if it is
shorter. Shingles are ordered by rarity over all documents. A window can only occur where all its
shingles do, so the join needs just the prefix of one shingle, its rarest; the shingle's place in the
window fixes where the window must start (positional bound) and end (length bound), and there the
words themselves are compared. Nothing is decided by a hash alone.

Documents are read twice, once to count how common the benchmark's shingles are and once to join; each
time a document's shingles are exploded inside the task and meet the benchmark's side in a hash join.
That side is broadcast only if its measured size is below ``BROADCAST_ROWS``, and then only matches and one
row per document are shuffled. A larger benchmark goes through a shuffled join with the same results: the
documents are written with row numbers, slim rows (row, hash, length class, place) meet the benchmark, and
the places where a window may start come back to their document's row, where the words are compared. No
exchange holds a document's words. Hits carry the window's number; items are looked up once per document
and window, so a sentence that very many items share is never copied with each hit.

Defined results: null or empty texts have no words and no hits; items without words never match; items
with a null id mark words but are not listed; repeated items and rows with equal ids count once as an
item; documents are told apart by row, so equal doc_ids each get their own result; an empty benchmark
leaves every document clean; a text of any length is one row of slim matches; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, materialise

WINDOW = 10
SHINGLE = 5
#: Rows of the benchmark's side up to which it is sent to every executor (about 200 bytes a row).
BROADCAST_ROWS = 200_000


def _hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(length)])


def _hashes(words: Column, length: int) -> Column:
    """Hashes of all shingles of ``length`` words; the caller sees to it that there are that many words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: _hash(words, i, length))


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win_id, win, len), and which items hold them (win_id, item)."""
    words = items.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = materialise(words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("win")).distinct())
    wins = materialise(cut.select("win").distinct().select(F.monotonically_increasing_id().alias("win_id"), "win", F.size("win").alias("len")))
    return wins, cut.filter("item IS NOT NULL").join(wins, "win").select("win_id", "item")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per document (at = -1) and one per shingle: hash, length class and place.

    The arrays of all lengths are laid end to end, so a shingle's place follows from its ordinal.
    """
    arrays = [F.when(F.size("w") >= n, _hashes(F.col("w"), n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    laid = docs.withColumn("h", F.concat(F.array(F.lit(0).cast("bigint")), *arrays) if arrays else F.array(F.lit(0).cast("bigint")))
    # The outer form, though no array is empty: the plain one makes the optimiser infer a filter on the
    # array and push it below the tokeniser, where words would be split anew for every shingle.
    rows = laid.select(*docs.columns, F.posexplode_outer("h").alias("ord", "h"))
    k, at, base = F.lit(0), F.lit(-1), F.lit(1)
    for n in lengths:
        here = F.greatest(F.size("w") - (n - 1), F.lit(0))
        inside = (F.col("ord") >= base) & (F.col("ord") < base + here)
        k, at = F.when(inside, n).otherwise(k), F.when(inside, F.col("ord") - base).otherwise(at)
        base = base + here
    return rows.withColumn("k", k).withColumn("at", at).drop("ord")


def prefixes(docs_words: DataFrame, wins: DataFrame, lengths: list[int], n_windows: int) -> DataFrame:
    """For each window its rarest shingle over all documents: h, k, off (place in the window), win_id, win, len."""
    own = F.least(F.lit(SHINGLE), F.col("len"))
    hashed = F.lit(None).cast("array<bigint>")
    for n in lengths:
        hashed = F.when(own == n, _hashes(F.col("win"), n)).otherwise(hashed)
    parts = wins.withColumn("k", own).select("*", F.posexplode(hashed).alias("off", "h"))
    keys = parts.select("h", "k").distinct()
    seen = shingles(docs_words.select("w"), lengths).filter("at >= 0").select("h", "k").join(_small(keys, n_windows * (WINDOW - SHINGLE + 1)), ["h", "k"])
    rarity = seen.groupBy("h", "k").agg(F.count("*").alias("df"))
    ranked = parts.join(rarity, ["h", "k"], "left").select("*", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("off")).alias("rank"))
    first = ranked.groupBy("win_id", "k").agg(F.min("rank").alias("r"), F.first("win").alias("win"), F.first("len").alias("len"))
    return first.filter(F.col("r.df") > 0).select(F.col("r.h").alias("h"), "k", F.col("r.off").alias("off"), "win_id", "win", "len")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans (start, len)."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
        ),
    )
    return done["n"]


def _matched(docs: DataFrame, side: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """One row per document: row, keep, n_words, spans (sorted starts and lengths of occurrences) and wins (numbers of the windows).

    ``docs`` has columns row, keep and text.
    """
    words = alnum_words(F.col("text")).alias("w")
    if small:
        rows = shingles(docs.select("row", "keep", words), lengths)
        # Only a document's own row carries its columns on; matches need just the row's number.
        met = rows.join(F.broadcast(side), ["h", "k"], "left").filter((F.col("at") < 0) | F.col("win").isNotNull())
        start = F.col("at") - F.col("off")
        right = (F.col("at") >= 0) & (start >= 0) & (start + F.col("len") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        hits = met.select(
            "row",
            F.when(F.col("at") < 0, F.col("keep")).alias("keep"),
            F.when(F.col("at") < 0, F.size("w")).alias("n"),
            F.when(right, F.struct(start.alias("start"), F.col("len").alias("len"))).alias("span"),
            F.when(right, F.col("win_id")).alias("win_id"),
        ).filter("n IS NOT NULL OR span IS NOT NULL")
        return hits.groupBy("row").agg(
            F.first("keep", ignorenulls=True).alias("keep"),
            F.max("n").cast("long").alias("n_words"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.collect_set("win_id").alias("wins"),
        )
    slim = shingles(docs.select("row", words), lengths).filter("at >= 0").select("row", "h", "k", "at")
    maybe = slim.join(side, ["h", "k"]).select("row", F.struct((F.col("at") - F.col("off")).alias("start"), "len", "win_id", "win").alias("c")).filter("c.start >= 0")
    whole = docs.join(maybe.groupBy("row").agg(F.collect_set("c").alias("c")), "row", "left").select("row", "keep", words, F.coalesce("c", F.array().cast(f"array<{maybe.schema['c'].dataType.simpleString()}>")).alias("c"))
    found = whole.select("row", "keep", F.size("w").cast("long").alias("n_words"), F.filter("c", lambda c: F.slice(F.col("w"), c["start"] + 1, c["len"]) == c["win"]).alias("c"))
    return found.select(
        "row", "keep", "n_words", F.array_sort(F.array_distinct(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"))))).alias("spans"), F.array_distinct(F.transform("c", lambda c: c["win_id"])).alias("wins")
    )


def _occurrences(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`_matched` finds, and the table of windows and items."""
    wins, held_by = windows(items)
    shape = wins.agg(F.count("*").alias("n"), F.collect_set(F.least(F.lit(SHINGLE), F.col("len"))).alias("k")).first()
    n_windows, lengths = shape["n"], sorted(shape["k"] or [])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("keep"), F.col(f"`{text_col}`").alias("text"))
    if not lengths:
        nothing = F.array().cast("array<struct<start:int,len:int>>").alias("spans"), F.array().cast("array<bigint>").alias("wins")
        return rows.select("row", "keep", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"), *nothing), held_by
    small = n_windows <= BROADCAST_ROWS
    if not small:
        rows = materialise(rows)
    side = materialise(prefixes(rows.select(alnum_words(F.col("text")).alias("w")), wins, lengths, n_windows))
    return _matched(rows, side, lengths, small), held_by


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Hits of benchmark windows in each document.

    Returns the columns ``keep`` (doc_id unless named), n_words, n_hit, n_items, item_ids (array),
    spans (array of start and length of the occurrences) and contaminated.
    """
    keep = keep or ["doc_id"]
    found, held_by = _occurrences(docs, items, keep, text_col)
    found = materialise(found)
    of_row = found.select("row", F.explode("wins").alias("win_id")).join(held_by, "win_id").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = found.join(of_row, "row", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    n_hit = _covered(F.col("spans")).cast("long")
    return told.select(
        *[F.col(f"keep.c{i}").alias(c) for i, c in enumerate(keep)], "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", (n_hit > 0).alias("contaminated")
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any benchmark window, all columns kept, whatever their names."""
    safe = [f"__d{i}" for i in range(len(docs.columns))]
    found, _ = _occurrences(docs.toDF(*safe), items, safe, safe[docs.columns.index("text")])
    return found.filter(F.size("spans") == 0).select(*[F.col(f"keep.c{i}").alias(c) for i, c in enumerate(docs.columns)])
