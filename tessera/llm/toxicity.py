"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon, how near its words stand to words that address the reader, shares
of capitals and of punctuation, and rates of obfuscation (characters that stand for letters, starred or
split words, drawn-out letters). The lexicon has a short hand-written part and a learnt part: words and
word beginnings that mark toxic documents with more than chance. The labelled documents are dealt to ``FOLDS``
parts, and each part is described with the lexicon learnt from the others, so that the trees see a lexicon as
it performs on unseen text. At most ``MAX_TRAIN`` documents are learnt from, those with the smallest hash of
doc_id. The isotonic map is fitted to margins of rows that a forest of the same size, learnt from the other
parts, has not seen; such a forest has all but a ``FOLDS``-th of the rows and of the lexicon, so its margins
are on the scale of the final forest's. Only the text is read for a score.

Defined results: null text scores as empty text; rows with a null doc_id or label are not learnt from;
a document labelled twice counts twice; without labels of both classes each score is the share of toxic
labels (one half without any); very long texts are read whole; repeated rows get equal scores; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import materialise
from .quality_classifier import held_out, labelled, scored

MAX_TRAIN = 20_000
FOLDS = 5
#: A learnt entry's log odds, and these over their standard error, must be above.
LEAST_ODDS, LEAST_Z = 1.5, 2.5
STEMS = (4, 5, 6, 7, 8)
#: Plain insults, and words that address the reader.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting clown clowns jerk jerks creep creeps "
    "bastard bitch shit crap fuck fucking asshole ass damn hate kill die ugly filthy vermin pig swine imbecile retard retarded freak liar "
    "idiote connard salaud imbécile merde crétin débile abruti ordure pourri dummkopf arschloch scheisse scheiße trottel depp dreck abschaum widerlich "
    "estúpido estúpida idiota imbécil basura asqueroso mierda cabrón tonto payaso".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr sie usted ustedes tú ti tus vosotros".split())
_LEET = str.maketrans("013457@$!|8", "oieastasi" + "lb")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
#: For ASCII text: letters in lower case and digits stay, the rest becomes spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_HIDDEN = re.compile(r"[0-9@$!|*#]*[^\W\d_]+(?:[0-9@$!|*#]+[^\W\d_]+)+|[@$*#][^\W\d_]{2,}|[^\W\d_]\*{2,}", re.UNICODE)
_SPLIT = re.compile(r"\b(?:[^\W\d_][.\-_ ]){3,}[^\W\d_]\b", re.UNICODE)
_DRAWN = re.compile(r"([^\W\d_])\1{2,}", re.UNICODE)


def _squeeze(word: str) -> str:
    """A word without disguise: characters read as letters, signs dropped, drawn-out letters cut to one."""
    return _DRAWN.sub(r"\1", re.sub(r"[^\w]", "", word.translate(_LEET)))


_SIGNS = np.array([ord(c) for c in "0123456789@$!|*#"], np.uint32)
_GAPS = np.array([ord(c) for c in ".-_ "], np.uint32)
_SMALL = np.zeros((2, 128), bool)
_SMALL[0, _SIGNS], _SMALL[1, _GAPS] = True, True


def _traits(text: str) -> tuple[bool, bool, bool]:
    """Whether the text can hold disguised, split or drawn-out words: exact necessary conditions, far
    cheaper than the patterns that look for such words."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 3:
        return True, True, True
    low = np.minimum(code, 127)
    gap = _SMALL[1][low]
    same = code[1:] == code[:-1]
    triple = same[1:] & same[:-1]
    return bool(_SMALL[0][low].any()), bool((gap[:-4] & gap[2:-2] & gap[4:]).any()), bool((code[2:][triple] >= 65).any())


def make_features(learnt: dict[str, float]) -> Callable[[str | None], list[float]]:
    """The feature function for a learnt lexicon of weights by word or ``beginning*``."""
    whole = {k: v for k, v in learnt.items() if not k.endswith("*")}
    stems = {k[:-1]: v for k, v in learnt.items() if k.endswith("*")}
    cache: dict[str, tuple[float, bool] | None] = {}

    def weight(word: str) -> tuple[float, bool] | None:
        """Lexicon weight of a word and whether it is an insult; None for other words."""
        if word in cache:
            return cache[word]
        best = max([whole.get(word, 0.0), *(stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
        found = (best, word in INSULTS) if best or word in INSULTS else None
        if len(cache) < 200_000:
            cache[word] = found
        return found

    def features(text: str | None) -> list[float]:
        text = text or ""
        if text.isascii():
            words = text.encode().translate(_PLAIN).decode("ascii").split()
        else:
            text = unicodedata.normalize("NFKC", text)
            words = _WORD.findall(text.lower())
        n, kinds = max(1, len(words)), set(words)
        marked = {w: x for w in kinds if (x := weight(w)) is not None}
        hits = [i for i, w in enumerate(words) if w in marked] if marked else []
        total, strong, plain, best = 0.0, 0, 0, 0.0
        for i in hits:
            x, insult = marked[words[i]]
            total += x
            strong += x >= 3
            plain += insult
            best = max(best, x)
        said = kinds & SECOND_PERSON
        n_you, near = sum(map(words.count, said)), 0
        if hits and said:
            you = [i for i, w in enumerate(words) if w in said]
            at = np.searchsorted(you, hits)
            gaps = [min(abs(you[k] - h) for k in (a - 1, a) if 0 <= k < len(you)) for a, h in zip(at.tolist(), hits, strict=True)]
            near = sum(g <= 5 for g in gaps)
        signs, gapped, triple = _traits(text)
        hidden = _HIDDEN.findall(text) if signs else []
        split = _SPLIT.findall(text) if gapped else []
        drawn = len(_DRAWN.findall(text)) if triple else 0
        disguised = [_squeeze(w.lower()) for w in hidden] + [re.sub(r"[^\w]|_", "", m).lower() for m in split]
        found = [x for x in map(weight, disguised) if x is not None and (x[0] >= 2 or x[1])]
        upper = sum(map(str.isupper, text.split()))
        return [
            plain, plain / n, strong, strong / n, total, total / n, best, len(hits) / n, near, near / n, n_you / n,
            math.log1p(len(words)), upper / n, text.count("!") / n, text.count("?") / n, (text.count("*") + text.count("$") + text.count("#")) / n,
            len(hidden) / n, len(disguised) / n, len(found), drawn / n, sum(map(len, words)) / n,
        ]

    return features


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Lexicons from all rows but those of each fold (column ``fold``), and last from all.

    A lexicon holds the weights of words and beginnings that mark toxic documents, as smoothed log odds of
    document counts. All that stand out from chance are taken; the documents counted are ``MAX_TRAIN`` at most.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    keys = F.concat(F.col("w"), *[_beginnings(k) for k in STEMS])
    tally = [F.sum(((F.col("fold") == f) & (F.col("y") == y)).cast("int")).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    toxic = sum((F.col(f"n{f}1") for f in range(FOLDS)), F.lit(0))
    counted = materialise(rows.select("fold", "y", words.alias("w")).select("fold", "y", F.explode(keys).alias("k")).groupBy("k").agg(*tally).filter(toxic >= 3))
    total, out = rows.agg(*tally).first(), []
    for left in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != left]
        toxic, clean = (sum((F.col(f"n{f}{y}") for f in folds), F.lit(0)) for y in (1, 0))
        all_toxic, all_clean = (sum(total[f"n{f}{y}"] or 0 for f in folds) for y in (1, 0))
        if not all_toxic or not all_clean:
            out.append({})
            continue
        odds = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))
        error = F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        best = counted.withColumn("t", toxic).withColumn("s", odds).withColumn("z", odds / error).filter((F.col("t") >= 3) & (F.col("s") > LEAST_ODDS) & (F.col("z") > LEAST_Z))
        out.append({r["k"]: float(r["s"]) for r in best.select("k", "s").collect()})
    return out


def _beginnings(k: int) -> Column:
    return F.array_distinct(F.transform(F.filter("w", lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))))


def _described(rows: DataFrame, lexicons: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of the rows learnt from, each described with the lexicon of the other folds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = [make_features(x) for x in lexicons[:FOLDS]]
        for b in batches:
            x = [list(map(float, describe[f](t))) for f, t in zip(b["fold"], b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "fold": b["fold"], "x": x})

    got = sorted((r["doc_id"], r["y"], r["fold"], tuple(r["x"])) for r in rows.select("doc_id", "text", "y", "fold").mapInPandas(run, "doc_id string, y int, fold int, x array<double>").collect())
    if not got:
        return np.zeros((0, 1)), np.zeros(0), np.zeros(0, int)
    return np.array([r[3] for r in got]), np.array([r[1] for r in got], np.float64), np.array([r[2] for r in got])


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Score each document; labels are learnt from rows whose crc32(doc_id) mod ``modulus`` isn't ``remainder``."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = materialise(labelled(docs, labels, "toxic", ~held_out(F.col("__id"), modulus, remainder), MAX_TRAIN).select("*", fold))
    lexicons = learn_lexicons(rows)
    x, y, folds = _described(rows, lexicons)
    forest = gbt.fit(x, y)
    calibrated = gbt.isotonic(gbt.out_of_fold(x, y, folds), y)
    features = make_features(lexicons[FOLDS])
    return scored(docs, features, lambda v: calibrated(forest.margin(v)), held_out(F.col("doc_id"), modulus, remainder))
