"""Near-duplicate detection with SetSketch registers (Ertl, "SetSketch", VLDB 2021).

1. Texts become sets of hashed five-word shingles. A set's digest joins equal sets into one class, so
   copies meet in a grouped minimum and never as pairs.
2. A sketch holds ``REGISTERS`` values: minima of exponentially distributed hashes on an exponential
   scale, truncated to 16 bits. Sketches of parts merge by maximum; equal registers are at least as
   likely as the sets' Jaccard similarity.
3. Bands of registers are hashed; classes that share a band meet in its bucket. Of buckets with the same
   members one is kept.
4. The member of a bucket that meets most others is its hub: of a text and its copies, the text. All members
   are compared with their hub, so a bucket gives as many pairs as it has members, and only 250-byte
   sketches travel. The likelihood of the registers, given both exact set sizes, drops pairs that can't
   reach the threshold; what stays is compared on the full sets. Connected components of these links settle
   a bucket when all its members are in one of them.
5. Buckets that aren't settled hold different texts, or copies that their hub doesn't reach. Those of one hub
   are taken together, so that a pair which shares many bands is looked at once. Members of different
   components are compared in blocks of at most ``BLOCK_ROWS`` members and ``BLOCK_SHINGLES`` shingles,
   sketches first and full sets after; a pair that is already connected inside the block is not compared
   again, so a block gives fewer links than it has members.
6. Components of all links give the result.

A linked pair shares no band with a probability of less than a millionth (:func:`banding`), and the
likelihood test lets pass all within about six standard errors. Work follows the hubs and not the clusters
that buckets chain together: a group holds what shares a band with its hub. No task collects an unbounded
group: one that isn't settled and has more members than a block is cut into blocks that meet pairwise in
separate tasks, and only that work grows with the square of the group's unconnected members.

Defined results: texts of fewer than five words are one shingle of the whole sequence; null, empty or
blank texts have none and link with nothing; rows with equal ids are told apart by their text; classes
whose ids are all null get a null component; very long texts are one set like any other, and a block holds
few of them; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .components import connected_components

SHINGLE = 5
REGISTERS = 125
#: SetSketch parameters of the two-byte form: base of the scale, rate, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
BLOCK_ROWS, BLOCK_SHINGLES = 128, 2_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_seeds = np.random.RandomState(20210).randint(0, 1 << 62, size=(2, REGISTERS), dtype=np.int64).astype(np.uint64)
_FACTORS, _OFFSETS = _seeds[0] * np.uint64(4) + np.uint64(1), _seeds[1] * np.uint64(4)


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier or its inverse, modulo 2^64."""
    if len(_powers[kind]) < n:
        one = _MULTIPLIER if kind == "up" else _INVERSE
        steps = np.full(max(n, 2 * len(_powers[kind])), one, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    b = b + np.where((b >= 65) & (b <= 90), np.uint8(32), np.uint8(0))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", len(b)), dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * _power("down", len(b))[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text)
    n = min(SHINGLE, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def minima(shingles: np.ndarray, chunk: int = 512) -> np.ndarray:
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), chunk):
        np.minimum(low, (shingles[i : i + chunk, None] * _FACTORS + _OFFSETS).min(axis=0), out=low)
    return low


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes: one 16-bit value per register."""
    u = (minima(shingles).astype(np.float64) + 1) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def banding(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows: the longest bands of which a pair at the threshold shares none with a probability below ``miss``."""
    for rows in range(8, 1, -1):
        bands = REGISTERS // rows
        if (1 - (percent / 100) ** rows) ** bands < miss:
            return bands, rows
    return REGISTERS, 1


def likely(equal: np.ndarray, above: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, slack: float = 18.0) -> np.ndarray:
    """Whether the registers leave a Jaccard similarity of ``threshold`` possible.

    equal, above: registers that are equal, and larger in the first sketch. Joint likelihood with known
    sizes: a register of the first is larger with probability p(u - vJ), of the second with p(v - uJ),
    where u and v are the sizes' shares and p(x) = -log_b(1 - x (b - 1) / b). The best similarity must
    not be more than ``slack`` in log-likelihood above the best one from the threshold on.
    """
    u = n_a / (n_a + n_b)
    v, below = 1 - u, REGISTERS - equal - above
    top = np.minimum(u / v, v / u)

    def fit(j: np.ndarray) -> np.ndarray:
        p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-9, 1))

    at = [fit(np.minimum(threshold + (1 - threshold) * t, np.maximum(top, threshold)) - 1e-9) for t in np.linspace(0, 1, 7)]
    low = [fit(np.minimum(threshold * t, top - 1e-9)) for t in np.linspace(0.3, 1, 15)]
    above_it = np.max(at, axis=0)
    return above_it + slack >= np.maximum(above_it, np.max(low, axis=0))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets of sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def block_links(sets: list[np.ndarray], sketches: np.ndarray, sides: np.ndarray, percent: int, components: list | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect similar members of a block; between sides 0 and 1 if both occur, else among all.

    Members that share an entry of ``components`` are connected from the start.
    """
    n = len(sets)
    first = {c: i for i, c in reversed(list(enumerate(components or [])))}
    root = np.array([first[c] for c in components]) if components else np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets], np.float64)
    two = len(set(sides.tolist())) > 1
    rows = np.flatnonzero(sides == 0) if two else np.arange(n)
    other = np.flatnonzero(sides == 1) if two else None
    for i in rows:
        j = other if two else np.arange(i + 1, n)
        j = j[(100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        if not len(j):
            continue
        same = (sketches[j] == sketches[i]).sum(axis=1)
        near = same >= (percent / 100 - 0.3) * REGISTERS
        j, same = j[near], same[near]
        if not len(j):
            continue
        above = (sketches[i] > sketches[j]).sum(axis=1)
        ok = likely(same, above, np.full(len(j), sizes[i]), sizes[j], percent / 100)
        for k in j[ok][np.argsort(-same[ok], kind="stable")]:
            a, b = find(i), find(k)
            if a != b and similar(sets[i], sets[k], percent):
                root[max(a, b)] = min(a, b)
                yield i, int(k)


def _sketched(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, counts, sketches, keys = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                r = registers(s) if len(s) else None
                sketches.append(r.tobytes() if len(s) else None)
                keys.append([xxhash.xxh3_64_intdigest(r[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(bands)] if len(s) else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "digest": digests, "n_shingles": counts, "sketch": sketches, "bands": keys})

    return run


def _probable(percent: int):
    """Pairs whose sketches leave the threshold possible."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("su", "sv"))
            n, m = batch["nu"].to_numpy(np.float64), batch["nv"].to_numpy(np.float64)
            same = (a == b).sum(axis=1)
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (same >= (percent / 100 - 0.3) * REGISTERS)
            ok[ok] = likely(same[ok], (a > b).sum(axis=1)[ok], n[ok], m[ok], percent / 100)
            yield batch.loc[ok, ["u", "v"]]

    return run


def _equal_sets(percent: int):
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch["xu"], batch["xv"], strict=True)]
            yield batch.loc[np.array(ok, bool), ["u", "v"]]

    return run


def _linker(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block; a block is compared as soon as it is complete."""
        key, held = None, []

        def links() -> pd.DataFrame:
            sets, sketches = [np.frombuffer(x[1], np.uint64) for x in held], np.stack([np.frombuffer(x[4], np.uint16) for x in held])
            found = list(block_links(sets, sketches, np.array([x[2] for x in held]), percent, [x[3] for x in held]))
            return pd.DataFrame({"u": [held[i][0] for i, _ in found], "v": [held[k][0] for _, k in found]}, dtype=object)

        for batch in batches:
            for hub, i, j, side, digest, shingles, component, sketch in zip(*(batch[c] for c in ("hub", "i", "j", "side", "digest", "shingles", "component", "sketch")), strict=True):
                if (hub, i, j) != key:
                    if len(held) > 1:
                        yield links()
                    key, held = (hub, i, j), []
                held.append((digest, shingles, side, component, sketch))
        if len(held) > 1:
            yield links()

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"digest": batch["digest"], "n_shingles": batch["n_shingles"], "sketch": batch["sketch"], "shingles": [shingle_set(t).tobytes() for t in batch["text"]]})


def _sides(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pairs (u, v) with columns of both members' rows of ``table``: for "sketch": "s", su and sv."""
    for side in "uv":
        pairs = pairs.join(table.select(F.col("digest").alias(side), *[F.col(c).alias(short + side) for c, short in columns.items()]), side)
    return pairs


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (u, v): by sketches, then by full sets."""
    told = _sides(pairs, sets, {"sketch": "s", "n_shingles": "n"}).select("u", "v", "su", "sv", "nu", "nv")
    maybe = materialise(told.mapInPandas(_probable(percent), "u binary, v binary"))
    whole = _sides(maybe, sets, {"shingles": "x"}).select("u", "v", "xu", "xv")
    return whole.mapInPandas(_equal_sets(percent), "u binary, v binary")


def _block_links(unsettled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups, given as rows (hub, digest, component).

    Members of a group's largest component are connected already, so their blocks only meet blocks of the
    others: copies with a few stragglers costs a row for each copy and block of stragglers.
    """
    spark = unsettled.sparkSession
    parts = unsettled.join(sets.select("digest", "n_shingles"), "digest").groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    top = parts.groupBy("hub").agg(F.max(F.struct("n", "component", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    needed = lambda n, s: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    # Written, so that the joins have exchanges of their own and the rows of a hot bucket can be split.
    blocks = materialise(top.select("hub", F.col("top.component").alias("major"), needed(F.col("top.n"), F.col("top.s")).alias("n_major"), needed(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("n_other")))
    hashed, major, last = F.xxhash64("digest"), F.col("component") == F.col("major"), F.col("n_major") + F.col("n_other") - 1
    own = F.when(major, F.pmod(hashed, F.col("n_major"))).otherwise(F.col("n_major") + F.pmod(hashed, F.col("n_other"))).cast("int")
    peers = F.sequence(F.when(major, F.col("n_major")).otherwise(0), last)
    # Pairs of blocks are made from slim rows; sets are joined to what each pair needs.
    slim = unsettled.join(blocks, "hub").select("hub", "digest", "component", own.alias("own"), F.explode(peers).alias("peer"))
    # Written, so that no later grouping makes the join gather a hub's rows in one task.
    slim = materialise(slim.select("hub", "digest", "component", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"), (F.col("own") > F.col("peer")).cast("int").alias("side")))
    # A pair of blocks whose members are all connected needs no look.
    mixed = slim.groupBy("hub", "i", "j").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("hub", "i", "j")
    rows = slim.join(materialise(mixed), ["hub", "i", "j"]).join(sets.select("digest", "sketch", "shingles"), "digest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(n, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "digest")
    return grouped.mapInPandas(_linker(percent), "u binary, v binary")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of each row of ``docs``: doc_id, text_key, n_shingles, component_id, kept."""
    return labelled(docs, percent, id_col, text_col).drop("label")


def labelled(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`near_duplicates`, with the component's own ``label``: ids may be shared or null, labels aren't."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"))
    # Ids travel as text: pandas would turn whole numbers with nulls among them into floats.
    shape = "doc_id string, text_key bigint, digest binary, n_shingles bigint, sketch binary, bands array<bigint>"
    told = slim.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_sketched(*banding(percent)), shape)
    sketched = materialise(told.withColumn("doc_id", F.col("doc_id").cast(slim.schema["doc_id"].dataType)))
    full = sketched.filter("digest IS NOT NULL")
    classes = materialise(full.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")]))
    found = _links(slim, classes, percent)

    linked = classes.select("digest", "first_id").join(found, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = materialise(linked.groupBy("label").agg(F.min("first_id").alias("component_id")))
    component = linked.join(least, "label").select("digest", "component_id", "label")
    rest = sketched.filter("digest IS NULL").withColumn("component_id", F.col("doc_id")).withColumn("label", F.lit(None).cast("binary")).select("doc_id", "text_key", "n_shingles", "component_id", "label")
    out = full.select("doc_id", "text_key", "digest", "n_shingles").join(component, "digest").select("doc_id", "text_key", "n_shingles", "component_id", "label")
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(slim: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Component of each class that has a link: digest, label."""
    met = classes.select("digest", F.explode("bands").alias("band"))
    # Two sums of hashes tell the members of a bucket; of buckets with the same members one is enough.
    members = [F.sum(F.xxhash64("digest", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)]
    shared = met.groupBy("band").agg(F.count("*").alias("n"), *members).filter("n > 1")
    # One row per bucket or component is written before it is joined back: the join then has exchanges of its
    # own on both sides, and the engine can split the rows of a hot one between tasks.
    buckets = materialise(shared.groupBy("n", "m1", "m2").agg(F.min("band").alias("band")).select("band", "n"))
    meets = materialise(met.join(buckets, "band").select("band", "digest", "n"))
    # What meets most others is the likeliest to be the text that the others are copies of.
    central = materialise(meets.groupBy("digest").agg(F.sum("n").alias("central")))
    meets = meets.drop("n").join(central, "digest")
    chosen = meets.select("digest").distinct().join(classes.select("digest", "one", "n_shingles", "sketch"), "digest")
    chosen = chosen.select("digest", "n_shingles", "sketch", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("key"))
    # Repeated rows have the same id and text: one of them is enough.
    texts = slim.join(chosen, slim["doc_id"].eqNullSafe(chosen["id"]) & (slim["text_key"] == chosen["key"])).select("digest", "n_shingles", "sketch", "text")
    sets = materialise(texts.mapInPandas(_sets, "digest binary, n_shingles bigint, sketch binary, shingles binary").dropDuplicates(["digest"]))

    hubs = materialise(meets.groupBy("band").agg(F.max(F.struct("central", "digest"))["digest"].alias("hub")))
    stars = materialise(meets.join(hubs, "band").select("band", "hub", "digest"))
    pairs = stars.filter("digest <> hub").select(F.least("digest", "hub").alias("u"), F.greatest("digest", "hub").alias("v")).distinct()
    links = materialise(_star_links(pairs, sets, percent))
    found = materialise(connected_components(links).withColumnsRenamed({"node": "digest"}))
    now = stars.join(found, "digest", "left").select("band", "hub", "digest", F.coalesce("label", "digest").alias("component"))
    # Buckets of two are settled by their one pair.
    unsettled = now.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a <> b AND n > 2").select("band")
    groups = materialise(now.join(materialise(unsettled), "band").select("hub", "digest", "component").distinct())
    more = materialise(_block_links(groups, sets, percent))
    # Components are joined by links between their labels.
    named = more.join(found.select(F.col("digest").alias("u"), F.col("label").alias("lu")), "u", "left").join(found.select(F.col("digest").alias("v"), F.col("label").alias("lv")), "v", "left")
    between = connected_components(named.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))).withColumnsRenamed({"node": "old", "label": "new"})
    ends = more.select(F.col("u").alias("digest")).unionByName(more.select(F.col("v").alias("digest"))).distinct()
    all_ = found.join(ends, "digest", "full").select("digest", F.coalesce("label", "digest").alias("old"))
    return all_.join(between, "old", "left").select("digest", F.coalesce("new", "old").alias("label"))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Documents with one row of each component: the one with the smallest doc_id. All columns are kept.

    Rows with the same id and text are one document; a document without words stays. Different texts that
    share an id, or have none, are different documents. Columns may have any names.
    """
    safe = [f"__d{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*safe)
    doc_id, text = (F.col(safe[docs.columns.index(c)]) for c in ("doc_id", "text"))
    id_key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    slim = named.select(doc_id.alias("doc_id"), text.alias("text"))
    kept = labelled(slim, percent).filter("kept").select(id_key(F.col("doc_id")).alias("__id"), F.col("text_key").alias("__key"), F.col("label").alias("__c"), "n_shingles")
    alone = kept.filter("n_shingles = 0").select("__id", "__key").distinct()
    one = kept.filter("n_shingles > 0").groupBy("__c").agg(F.min(F.struct("__id", "__key")).alias("r")).select("r.*")
    named = named.withColumn("__id", id_key(doc_id)).withColumn("__key", F.xxhash64(text))
    out = named.join(one.unionByName(alone), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return out.select(*[F.col(s).alias(c) for s, c in zip(safe, docs.columns, strict=True)])
