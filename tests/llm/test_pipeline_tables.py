"""The pipeline's stages on awkward tables, and the whole run against plain Python."""

import collections
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from samples import ODD, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 4 and 1 or 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(7, 30)), (None, "é é"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def awkward(docs):
    rows = [(i, prose(i, 40) if i % 4 else "### *** " * 30) for i in range(40)]
    return docs([*rows, *[(100 + i, t) for i, t in enumerate(ODD)], (None, prose(60)), (None, prose(61)), (5, prose(62)), (5, prose(5, 40)), (None, None), (7, prose(7, 40))], extra=True).withColumns({"slot": F.lit("mine"), "curve": F.lit("mine"), "__id": F.lit("mine")})


@pytest.mark.parametrize("k", range(5))
def test_stage_on_awkward_tables(spark, docs, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    given = awkward(docs)
    out = stage(spark, given, folder)
    last = k == 4
    assert out.columns == ([*given.columns, "shard_", "slot_"] if last else given.columns), name
    rows = out.collect()
    # Every row that comes out went in, with its own columns.
    known = {(r["doc_id"], r["text"], r["slot"], r["curve"], r["__id"], r["shard"]) for r in given.collect()}
    assert rows and {(r["doc_id"], r["text"], r["slot"], r["curve"], r["__id"], r["shard"]) for r in rows} <= known
    assert stage(spark, given.limit(0), folder).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_by_loops(spark, sf):
    """Duplicates, leaks and shards of the driver's smallest table, by comparing everything with everything."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    sets = {i: shingles(r.text) for i, r in rows.items()}
    ids, least = sorted(rows), {i: i for i in rows}
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    alone = corpus_pipeline.deduplication(spark, docs, sf)
    assert {r.doc_id for r in alone.collect()} == {i for i in ids if least[i] == i}

    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    cut = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    leaks = lambda w: any(tuple(w[i : i + n]) in cut for n in {len(x) for x in cut} for i in range(len(w) - n + 1))
    clean = corpus_pipeline.decontamination(spark, docs, sf).collect()
    assert {r.doc_id for r in clean} == {i for i in ids if not leaks(words(rows[i].text))}

    sharded = corpus_pipeline.shards(spark, docs, sf).collect()
    counts = collections.Counter(r["shard"] for r in sharded)
    assert sorted(r["doc_id"] for r in sharded) == ids and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in sharded if r["shard"] == s) == list(range(n)) for s, n in counts.items())
