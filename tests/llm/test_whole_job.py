"""Cases in which an operator once did less than the whole job."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from tessera.llm import lm_scoring, near_dedup


def sentence(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_deduplication_keeps_different_texts_without_own_ids(docs):
    alone, shared, copy = [sentence(i) for i in range(5)], [sentence(10 + i) for i in range(3)], sentence(20)
    rows = [(None, t) for t in alone] + [(7, t) for t in shared] + [(None, copy), (None, copy), (9, copy), (3, sentence(21))]
    out = near_dedup.deduplicate(docs(rows)).collect()
    got = sorted((str(r.doc_id), r.text) for r in out)
    assert got == sorted([("None", t) for t in alone] + [("7", t) for t in shared] + [("9", copy), ("3", sentence(21))])


def test_rare_words_keep_their_counts(docs, monkeypatch):
    # More words of one count than have room: some of them are known, the two others are not.
    monkeypatch.setattr(lm_scoring, "KNOWN", 8)
    slot = lambda w: int(lm_scoring.rare_slots(lm_scoring.hashed_words(pa.array([w]))[0])[0])
    common = " ".join(f"k{i}" for i in range(30))
    # Two words of one slot, in the same place, differ by their counts alone.
    often = next(w for w in (f"often{i}" for i in range(1000)) if slot(w) == slot("seldom"))
    texts = [common] * 20 + ["seldom"] + [often] * 8
    rows = {r.doc_id: r for r in lm_scoring.score(docs(texts)).collect()}
    assert len(rows) == len(texts)
    assert rows[21].log_likelihood - rows[20].log_likelihood == pytest.approx(math.log(8))
    assert [(rows[i].n_rare, rows[i].n_rare_elsewhere) for i in (20, 21)] == [(1, 0), (1, 1)]
    known, counts = lm_scoring.corpus_vocabulary(docs([common] * 20))
    assert 0 < len(known.keys) <= 8 and counts.count() == 30 and known.rare == 20 * (30 - len(known.keys))


def right_and_wrong():
    """Pairs of words of two classes, and the same words with partners of the same class and frequency."""
    r = np.random.RandomState(3)
    i = r.randint(0, 8, 2000)
    pairs = lambda a, b: np.stack((a, 5 * lm_scoring.SLOTS + b), 1).ravel().astype(np.int16)
    return pairs(3 * lm_scoring.SLOTS + i, i), pairs(3 * lm_scoring.SLOTS + i, (i + 3) % 8)


def context_of(leaf):
    return lm_scoring.windows(leaf, np.array([len(leaf)]))


def test_words_of_one_class_are_told_apart():
    right, wrong = right_and_wrong()
    net = lm_scoring.Network.start(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    for _ in range(200):
        net.step(context_of(right), right, 0.5)
    mean = lambda x: net.log_likelihoods(context_of(x), x).mean()
    assert mean(right) > mean(wrong) + 0.3


def test_context_words_of_one_frequency_change_scores(docs):
    words = [f"m{i:03}" for i in range(300)]
    texts = [" ".join(words[i:] + words[:i]) for i in range(0, 300, 20)] + ["m001 m140 m141", "m002 m140 m141", "m003 m140 m141"]
    rows = {r.doc_id: r.log_likelihood for r in lm_scoring.score(docs(texts)).collect()}
    assert len({round(rows[len(texts) - k], 9) for k in (1, 2, 3)}) == 3
