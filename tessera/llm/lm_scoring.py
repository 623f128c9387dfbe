"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every word of a document is predicted from the ``SIDE`` words before and after it. The network predicts
the word's class, then its slot of the class, and the word's share of the slot completes the probability:

    log P(word | both sides) = log P(class | both sides) + log P(slot | class, both sides) + log P(word | slot)

Both softmaxes see the words around, not their classes. Classes split the corpus' words into groups of about
equal total frequency (by count, so a class of frequent words has few of them). Each class deals its words
to ``SLOTS`` slots in turn, so the few thousand most frequent words have a slot each and words of a slot
share no class neighbour; words that aren't among the ``KNOWN`` most frequent form the last class, where
their hash gives the slot. The three factors each sum to one over their choices, so the product is a
probability over all words of the corpus.

The counts come from all documents. The network (an embedding of each slot at each window place, a tanh
layer, a softmax over classes and one over the slots of each class) is trained on every word of all
documents too. In each round every partition takes gradient steps over its own share of the documents from
the current weights, and the partitions' weights are averaged by their words, in a tree of sums. A
document's score is the mean over its words; the sum is returned as well.

Words are hashed to 64 bits from the bytes of a whole batch at once, so no string is made of them. Counts of
all words stay in a distributed table that grows with the corpus. Tasks receive the ``KNOWN`` most frequent
words, which are most of a text; the exact counts of all others are joined to the scored documents, so a rare
word's share of its slot is exact too. No word is skipped and no count is lost. The same join tells how many
of a document's rare words other documents have as well (``n_rare_elsewhere``): a model of the whole corpus
has learnt those from elsewhere, all others from this document alone.

Defined results: null, empty or wordless texts have no words, sum 0 and a null mean; equal texts get equal
scores up to rounding; a text of any length is scored whole, in pieces of ``BATCH`` words; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, materialise, small_batches

SIDE = 2
CLASSES = 64  # the last two are rare words and the outside of the text
RARE, EDGE = CLASSES - 2, CLASSES - 1
HIDDEN = 16
SLOTS = 64  # of each class
LEAVES = CLASSES * SLOTS
#: Words that tasks hold in memory, 14 bytes each; what lies beyond is joined, with the same result.
KNOWN = 1 << 17
ROUNDS = 2
BATCH = 16384  # words at once when scoring
STEP = 8192  # words of a gradient step
RATE, EMBED_RATE = 3.0, 1500.0
PIECE = 4096  # weights in a row of the averaging

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _INSIDE[_a : _b + 1] = False
_INSIDE[65:91] = True  # A-Z count as a-z
_MULTIPLIER = 0x9E3779B97F4A7C15
_STRETCH = 1 << 20  # bytes hashed at once


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_MULTIPLIER, n), _powers(pow(_MULTIPLIER, -1, 1 << 64), n)
        return cls.up, cls.down


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (A-Z lower-cased) end to end, and where each text ends.

    The bytes of all texts are looked at together: a byte's class says where words start and end, and
    differences of a running sum give each word's polynomial hash.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts -= cuts[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = _INSIDE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(raw))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _STRETCH, side="right")))
        low, high = starts[at], ends[to - 1]
        up, down = _Powers.of(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((_LOWER[raw[low:high]].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31)), np.searchsorted(starts, cuts[1:])


class Network:
    """Weights as float32: an embedding of each slot per window place, a bias, output layers of classes and of slots."""

    SHAPES = ((2 * SIDE, LEAVES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, SLOTS), (CLASSES, SLOTS))

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.leaf, self.bias, self.out, self.out_bias, self.fine, self.fine_bias = parts

    @classmethod
    def start(cls, unigram: np.ndarray, slots: np.ndarray | None = None) -> Network:
        """From the classes' shares of all words, and the slots' shares of their classes; what no word has gets no probability."""
        r = np.random.RandomState(11)
        slots = np.full((CLASSES, SLOTS), 1 / SLOTS) if slots is None else slots
        return cls([
            r.normal(0, 0.3, cls.SHAPES[0]).astype(np.float32), np.zeros(HIDDEN, np.float32),
            r.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.log(np.maximum(unigram, 1e-30)).astype(np.float32),
            r.normal(0, 0.1, cls.SHAPES[4]).astype(np.float32), np.log(np.maximum(slots, 1e-30)).astype(np.float32),
        ])

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.leaf, self.bias, self.out, self.out_bias, self.fine, self.fine_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        at, parts = 0, []
        for s in cls.SHAPES:
            n = int(np.prod(s))
            parts.append(np.array(flat[at : at + n], np.float32).reshape(s))
            at += n
        return cls(parts)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.leaf[0][context[0]]
        for k in range(1, 2 * SIDE):
            z += self.leaf[k][context[k]]
        z += self.bias
        return np.tanh(z, out=z)

    def log_likelihoods(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each word's class and slot, given the slots around it."""
        h, target = self.hidden(context), leaf // SLOTS
        z, sums = _exponentials(h @ self.out, self.out_bias)
        out = np.log(z[np.arange(len(target)), target]) - np.log(sums)
        for c, at in _by_value(target):
            z, sums = _exponentials(h[at] @ self.fine[c], self.fine_bias[c])
            out[at] += np.log(z[np.arange(len(at)), leaf[at] - c * SLOTS]) - np.log(sums)
        return out

    def step(self, context: np.ndarray, leaf: np.ndarray, rate: float, embed_rate: float | None = None) -> None:
        """One gradient step on the mean log-loss of a batch. With ``embed_rate``, embeddings take steps of that rate over the root of their slot's count."""
        n, target = len(leaf), leaf // SLOTS
        h = self.hidden(context)
        g, sums = _exponentials(h @ self.out, self.out_bias)
        g *= (rate / n / sums)[:, None]
        g[np.arange(n), target] -= rate / n
        back = g @ self.out.T
        for c, at in _by_value(target):
            near = h[at]
            f, sums = _exponentials(near @ self.fine[c], self.fine_bias[c])
            f *= (rate / n / sums)[:, None]
            f[np.arange(len(at)), leaf[at] - c * SLOTS] -= rate / n
            back[at] += f @ self.fine[c].T
            self.fine[c] -= near.T @ f
            self.fine_bias[c] -= f.sum(axis=0)
        back *= 1 - h * h
        self.out -= h.T @ g
        self.out_bias -= g.sum(axis=0)
        self.bias -= back.sum(axis=0)
        if embed_rate is not None:
            back *= embed_rate / rate
        for k in range(2 * SIDE):
            # Rows of one slot are laid together and summed.
            order = np.argsort(context[k], kind="stable")
            slot = context[k][order]
            first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            moved = np.add.reduceat(back[order], first, axis=0)
            if embed_rate is not None:
                moved /= np.sqrt(np.diff(first, append=n)).astype(np.float32)[:, None]
            self.leaf[k][slot[first]] -= moved


def _exponentials(z: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z + bias), within what float32 holds, and the rows' sums."""
    z += bias
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    return z, z.sum(axis=1)


def _by_value(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each class among the targets: the class and its words' numbers."""
    order = np.argsort(target, kind="stable")
    ends = np.cumsum(np.bincount(target, minlength=CLASSES))
    for c in np.flatnonzero(np.diff(ends, prepend=0)):
        yield c, order[ends[c - 1] if c else 0 : ends[c]]


def windows(leaf: np.ndarray, ends: np.ndarray, edge: int = EDGE * SLOTS) -> np.ndarray:
    """Context slots (2 * SIDE rows) of each word of documents laid end to end; places outside of a text are ``edge``."""
    out = np.full((2 * SIDE, len(leaf)), edge, leaf.dtype)
    lengths = np.diff(ends, prepend=0)
    begins = ends - lengths
    for k in range(1, SIDE + 1):
        out[SIDE - k, k:], out[SIDE + k - 1, : max(0, len(leaf) - k)] = leaf[:-k], leaf[k:]
        for j in range(k):
            # The first k words of each text have no word k places before them, the last k none after them.
            there = lengths > j
            out[SIDE - k, begins[there] + j] = out[SIDE + k - 1, ends[there] - 1 - j] = edge
    return out


class Vocabulary:
    """Slot and log share of each known word; what is known is a bounded part of the corpus' words.

    ``keys`` are the hashes of the known words by falling count; ``sums`` holds the counts of all words by the
    slot that rare words take. The share of a word that isn't known is its count, joined later, over the
    count of all such words of its slot.
    """

    CELLS = 21  # bits of the table in front of the binary search

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        total, by_slot = int(sums.sum()), np.array(sums, np.float64)
        mass = np.cumsum(counts) - counts / 2
        group = np.minimum((mass / max(1, counts.sum()) * (CLASSES - 2)).astype(np.int64), CLASSES - 3) if len(keys) else np.zeros(0, np.int64)
        rare = self.rare = max(0, total - int(counts.sum()))
        self.unigram = np.bincount(group, counts, minlength=CLASSES).astype(np.float64) / max(1, total)
        self.unigram[RARE] = rare / max(1, total)
        # Words come by falling count, so a class is a run of them.
        turn = np.arange(len(keys)) - np.searchsorted(group, group)
        leaf = group * SLOTS + turn % SLOTS
        np.subtract.at(by_slot, rare_slots(keys), counts)
        mass = np.bincount(leaf, counts, minlength=LEAVES).astype(np.float64)
        mass[RARE * SLOTS : EDGE * SLOTS] = np.maximum(by_slot, 0)
        self.slots = mass.reshape(CLASSES, SLOTS) / np.maximum(1, mass.reshape(CLASSES, SLOTS).sum(axis=1, keepdims=True))
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)  # rank: place by falling count
        self.leaf = leaf.astype(np.int16)[order]
        self.share = (np.log(counts / mass[leaf]) if len(keys) else np.zeros(0)).astype(np.float32)[order]
        self.rare_share = -np.log(np.maximum(1, mass[RARE * SLOTS : EDGE * SLOTS]))
        self._cells: np.ndarray | None = None

    def cells(self) -> np.ndarray:
        """Of all known words whose hashes begin alike, the number of the most frequent; made once in each task."""
        if self._cells is None:
            self._cells = np.zeros(1 << self.CELLS, np.int32)
            seldom = np.argsort(-self.rank, kind="stable")
            self._cells[(self.keys[seldom] >> np.uint64(64 - self.CELLS)).astype(np.int64)] = seldom
        return self._cells

    def leaves(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each word (over all classes), log share as far as known here, and which words are rare."""
        rare = np.ones(len(words), bool)
        at = np.zeros(len(words), np.int64)
        if len(self.keys):
            at = self.cells()[(words >> np.uint64(64 - self.CELLS)).astype(np.int64)].astype(np.int64)
            miss = np.flatnonzero(self.keys[at] != words)
            at[miss] = np.minimum(np.searchsorted(self.keys, words[miss]), len(self.keys) - 1)
            rare[:] = False
            rare[miss] = self.keys[at[miss]] != words[miss]
            leaf, share = self.leaf[at], self.share[at].astype(np.float64)
        else:
            leaf, share = np.zeros(len(words), np.int16), np.zeros(len(words))
        slot = rare_slots(words[rare])
        leaf[rare], share[rare] = RARE * SLOTS + slot, self.rare_share[slot]
        return leaf, share, rare

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cells": None}


def rare_slots(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SLOTS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, merged over batches while they fit in a few million entries."""
    held, n = [], 0

    def merged() -> pa.RecordBatch:
        sums = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()
        return pa.RecordBatch.from_arrays([sums.column("word").combine_chunks(), sums.column("n").combine_chunks()], ["word", "n"])

    for b in batches:
        found = pc.value_counts(pa.array(hashed_words(b.column("text"))[0].view(np.int64)))
        held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
        n += len(found)
        if n > 2_000_000:
            yield merged()
            held, n = [], 0
    if held:
        yield merged()


def corpus_vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The known words, ``KNOWN`` of the most frequent, and the table of all words' counts, from the column text.

    A histogram of the counts (a few thousand steps, finer for small counts) tells how frequent a word must
    be, so only known words reach the driver. The last step that has room is filled by the words' hashes.
    """
    counts = materialise(docs.select("text").mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    sums = np.zeros(SLOTS)
    for r in counts.groupBy(F.col("word").bitwiseAND(SLOTS - 1).cast("int").alias("s")).agg(F.sum("n").alias("n")).collect():
        sums[r["s"]] = r["n"]
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64)).cast("int")
    least, known, split = 1 << 30, 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), reverse=True):
        if known + r["k"] > KNOWN:
            split = r["s"]
            break
        least, known = r["s"], known + r["k"]
    chosen = counts.filter(step >= least)
    if split is not None and known < KNOWN:
        chosen = chosen.unionByName(hash_sample(counts.filter(step == split), "word", KNOWN - known).select(*counts.columns))
    top = chosen.toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64), sums), counts


def _average(batch: pa.Table) -> pa.Table:
    """One row of the rows of a piece: weights averaged by words."""
    n = batch.column("n").to_numpy()
    rows = np.stack([np.asarray(w.values, np.float64) for chunk in batch.column("weights").chunks for w in chunk])
    mean = (rows * n[:, None]).sum(axis=0) / n.sum()
    return pa.table({"part": batch.column("part")[:1], "piece": batch.column("piece")[:1], "n": [int(n.sum())], "weights": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int | None = None, rate: float | None = None) -> Network:
    """Rounds of local steps over all documents and averages of the weights.

    Round k of n takes the documents whose text's hash falls in its share, so that a document is learnt from
    once and all are. Averages go by pieces of the weights and by groups of at most 64 partitions, level by
    level, so no task holds more than 64 rows of a piece; the driver receives one set of about a megabyte.
    """
    rounds, rate = rounds or ROUNDS, rate or RATE
    sc = docs.sparkSession.sparkContext
    network = Network.start(vocabulary.unigram, vocabulary.slots)
    known = sc.broadcast(vocabulary)
    for k in range(rounds):
        begin, speed = sc.broadcast(network.flat()), 1 / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], begin=begin, speed: float = speed) -> Iterator[pa.RecordBatch]:
            net, seen, v = Network.of(begin.value), 0, known.value
            for b in batches:
                words, ends = hashed_words(b.column("text"))
                leaf = v.leaves(words)[0]
                context = windows(leaf, ends)
                # Neighbouring words go to different steps.
                n = -(-len(leaf) // STEP)
                for j in range(n):
                    net.step(context[:, j::n], leaf[j::n], speed * rate, speed * rate * EMBED_RATE)
                seen += len(leaf)
            if seen:
                pieces = np.array_split(net.flat(), -(-len(begin.value) // PIECE))
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(pieces)), pa.int32()), "n": pa.array([seen] * len(pieces), pa.int64()), "weights": pa.array(pieces, pa.list_(pa.float32()))})

        share = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        sent, left = share.mapInArrow(run, "piece int, n bigint, weights array<float>").withColumn("part", F.spark_partition_id()), share.rdd.getNumPartitions()
        shape = "part int, piece int, n bigint, weights array<float>"
        while True:
            left = -(-left // 64)
            sent = sent.select(F.floor(F.col("part") / 64).cast("int").alias("part"), "piece", "n", "weights").groupBy("part", "piece").applyInArrow(_average, shape)
            if left <= 1:
                break
        rows = sorted(sent.select("piece", "weights").toArrow().to_pylist(), key=lambda r: r["piece"])
        if rows:
            network = Network.of(np.concatenate([np.asarray(r["weights"], np.float32) for r in rows]))
    return network


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pseudo-likelihood of every document.

    Returns doc_id, n_words, log_likelihood (sum), mean_log_likelihood, n_rare (words that aren't among the
    ``KNOWN`` most frequent) and n_rare_elsewhere (those of them that other documents have, or repeated rows).
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary, counts = corpus_vocabulary(slim)
    network = train(slim, vocabulary)
    sc = docs.sparkSession.sparkContext
    known, weights = sc.broadcast(vocabulary), sc.broadcast(network.flat())
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, v = Network.of(weights.value), known.value
        for b in batches:
            words, ends = hashed_words(b.column("text"))
            leaf, found, rare = v.leaves(words)
            context = windows(leaf, ends)
            for i in range(0, len(leaf), BATCH):
                part = slice(i, i + BATCH)
                found[part] += net.log_likelihoods(context[:, part], leaf[part])
            lengths = np.diff(ends, prepend=0)
            sums = np.concatenate(([0.0], np.cumsum(found)))
            # Rare words of each document, each with its count there.
            doc = np.repeat(np.arange(len(ends)), lengths)[rare]
            order = np.lexsort((words[rare], doc))
            doc, mine = doc[order], words[rare][order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (mine[1:] != mine[:-1])))) if len(doc) else np.zeros(0, np.int64)
            cuts = pa.array(np.searchsorted(doc[new], np.arange(len(ends) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (mine[new].view(np.int64), np.diff(new, append=len(doc)))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lengths), pa.array(sums[ends] - sums[ends - lengths]), pa.array(np.bincount(doc, minlength=len(ends)).astype(np.int64)), *lists],
                ["doc_id", "n_words", "log_likelihood", "n_rare", "rare", "own"],
            )

    shape = f"doc_id {kind}, n_words bigint, log_likelihood double, n_rare bigint, rare array<bigint>, own array<bigint>"
    # Written once: the rows' numbers and the counts joined to them must belong together.
    scored = materialise(slim.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()))
    # A rare word is at most one of KNOWN in the corpus, so no word is hot in this join.
    joined = scored.select("row", F.explode(F.arrays_zip("rare", "own")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.own").alias("own")).join(counts, "word")
    more = F.sum(F.col("own") * F.log("n")).alias("more"), F.sum(F.when(F.col("n") > F.col("own"), F.col("own")).otherwise(0)).alias("elsewhere")
    out = scored.join(joined.groupBy("row").agg(*more), "row", "left")
    total = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"), "n_rare", F.coalesce("elsewhere", F.lit(0)).alias("n_rare_elsewhere")
    )
