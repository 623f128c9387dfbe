"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The trees learn from at most ``MAX_TRAIN`` labelled documents, those with the smallest hash of doc_id, so
the sample doesn't depend on the order of rows. They are flattened into arrays and traversed by numpy
for a whole Arrow batch at once. Only the text is read for a score: no label, id, language or source.

Defined results: null text scores as empty text; rows with a null doc_id or label are not learnt from;
a document labelled twice counts twice; without labels of both classes each score is the share of good
labels (one half without any); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import hash_sample, small_batches

MAX_TRAIN = 20_000
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32),
    "line": (10,),
    "high": range(128, 256),
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>",
    "other": b"@/\\_=+-~^`'\"()[]{}",
}
_GROUP = np.zeros((256, len(_CLASSES)), np.float64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _GROUP[list(_bytes), _i] = 1
_ENDING = re.compile(r"[.!?:;\"')]\s*(?:\n|$)")
FEATURES = (
    "log_words", "log_bytes", "word_length", "long_words", "short_words", "distinct", "top_word", "top3_words", "trigram_distinct", "log_lines",
    "dup_lines", "line_words", "ended_lines", "same_neighbour", "upper_words", *_CLASSES, "byte_entropy",
)


def statistics(text: str | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    common = Counter(words)
    top = [c for _, c in common.most_common(3)] if common else [0]
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    threes = max(1, len(words) - 2)
    share = counts[counts > 0] / size
    return [
        np.log1p(len(words)), np.log1p(len(raw)), float(lengths.mean()) if words else 0.0, float((lengths > 12).sum()) / n, float((lengths < 3).sum()) / n,
        len(common) / n, top[0] / n, sum(top) / n, len(set(zip(words, words[1:], words[2:], strict=False))) / threes, np.log1p(len(lines)),
        1 - len(set(lines)) / n_lines, len(words) / n_lines, len(_ENDING.findall(text)) / n_lines, sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.isupper, words)) / n,
        *(counts @ _GROUP / size), float(-(share * np.log2(share)).sum()),
    ]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, learn: Column, most: int) -> DataFrame:
    """Text and label of at most ``most`` documents whose labels may be learnt. The broadcast side has that bound."""
    small_batches(docs.sparkSession)
    pick = labels.select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("y")).filter("__id IS NOT NULL AND y IN (0, 1)").filter(learn)
    pick = hash_sample(pick, "__id", most, "y")
    return docs.select("doc_id", "text").join(F.broadcast(pick), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")


def feature_rows(rows: DataFrame, features: Callable[[str | None], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded set of rows on the driver, in the order of their ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "x": [list(map(float, features(t))) for t in b["text"]]})

    got = sorted((r["doc_id"], r["y"], tuple(r["x"])) for r in rows.mapInPandas(run, "doc_id string, y int, x array<double>").collect())
    if not got:
        return np.zeros((0, 1)), np.zeros(0)
    return np.array([r[2] for r in got]), np.array([r[1] for r in got], np.float64)


def scored(docs: DataFrame, features: Callable[[str | None], list[float]], score: Callable[[np.ndarray], np.ndarray], out: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    # Ids travel as text: pandas would turn whole numbers with nulls among them into floats.
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), out.alias("held_out"), F.col("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                s = np.clip(score(np.array([features(t) for t in part["text"]], np.float64)), 0, 1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return slim.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast(kind))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """Score each document; labels are learnt from rows whose crc32(doc_id) mod ``modulus`` isn't ``remainder``."""
    x, y = feature_rows(labelled(docs, labels, "quality", ~held_out(F.col("__id"), modulus, remainder), MAX_TRAIN), statistics)
    forest = gbt.fit(x, y)
    return scored(docs, statistics, forest.probability, held_out(F.col("doc_id"), modulus, remainder))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier doesn't reject, all columns kept, scored in the same pass over the text."""
    x, y = feature_rows(labelled(docs, labels, "quality", ~held_out(F.col("__id"), 3, 1), MAX_TRAIN), statistics)
    forest = gbt.fit(x, y)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [forest.probability(np.array([statistics(t) for t in texts.iloc[i : i + 2000]], np.float64)) for i in range(0, len(texts), 2000)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.filter(score(F.col("text")) >= 0.5)
