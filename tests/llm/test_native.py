"""The operators written in DataFrame code, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from samples import ODD, prose
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import decontaminate, mixing, quality_rules, queries, sharding

quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plan_is_native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# Decontamination


def brute_hits(texts, items):
    at = collections.defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(1, len(w) - 9)):
            if w:
                at[tuple(w[i : i + 10])].add(item)
    out = []
    for text in texts:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(k) for k in at}:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                if k in at:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in at[k] if x is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check_hits(spark, docs, texts, items, extra=False):
    got = decontaminate.contamination(docs(texts, extra), bench(spark, items))
    assert plan_is_native(got)
    rows = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute_hits(texts, items)


def test_contamination_brute_force(spark, docs):
    passage = prose(99, 30)
    texts = [*ODD, prose(1), prose(2) + " " + passage + " " + prose(3), passage.upper(), passage.replace(" ", " -- "), " ".join(passage.split()[5:16]), " ".join(passage.split()[5:14]), "say two words twice: two words", "four short words here now four short words here"]
    items = [(1, passage), (2, passage), (1, "two words"), (3, "Four, SHORT words here"), (10, prose(50, 12)), (None, "say"), (4, None), (5, ""), (6, "é")]
    check_hits(spark, docs, texts, items, extra=True)


@quick
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=13), max_size=4))
def test_contamination_property(spark, docs, texts, items):
    check_hits(spark, docs, [" ".join(t) for t in texts], [(i, " ".join(x)) for i, x in enumerate(items)])


def test_contamination_large_benchmark_takes_the_shuffled_join(spark, docs, monkeypatch):
    passage = prose(99, 30)
    texts = [*ODD, prose(1), passage, passage + " " + prose(3) + " " + passage, prose(2) + " two words"]
    items = [(1, passage), (2, passage), (3, "two words"), (4, prose(1)), (None, "x x x x x x")]
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    check_hits(spark, docs, texts, items, extra=True)
    assert decontaminate.clean_documents(docs(texts), bench(spark, items)).count() == sum(not h for _, h, _ in brute_hits(texts, items))
    check_hits(spark, docs, [], items)


def test_no_exchange_holds_the_words(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "materialise", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontaminate.contamination(docs([prose(1)]), bench(spark, [(1, prose(1))]))
        plan = got._jdf.queryExecution().optimizedPlan()
        physical = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in physical or "ShuffledHashJoin" in physical
    shipped = []

    def walk(node):
        if "Exchange" in node.nodeName():
            shipped.append({a.name() for a in (node.output().apply(i) for i in range(node.output().size()))})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan))
    assert shipped and not any("w" in names for names in shipped)


def test_contamination_empty_tables(spark, docs):
    assert decontaminate.contamination(docs([]), bench(spark, [(1, "x")])).count() == 0
    got = decontaminate.contamination(docs(["some words"]), bench(spark, []).limit(0)).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (2, 0, False)


def test_contamination_repeated_rows_and_clean_documents(spark, docs):
    df = docs([(1, "two words"), (1, "two words"), (1, "other"), (None, "two words"), (2, None)])
    items = bench(spark, [(7, "two words")])
    assert sorted((r.n_hit for r in decontaminate.contamination(df, items).collect())) == [0, 0, 2, 2, 2]
    named = df.withColumnsRenamed({"n_chars": "contaminated", "lang": "spans"}).withColumn("n_words", F.lit("x"))
    assert decontaminate.clean_documents(named, items).columns == named.columns
    assert decontaminate.clean_documents(named, items).count() == 2
    left = decontaminate.clean_documents(df, items)
    assert left.columns == df.columns
    assert sorted(str(r.text) for r in left.collect()) == ["None", "other"]


def test_contamination_digest(spark, sf):
    got = queries.op2_decontamination(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()}
    want = brute_hits([r.text for r in texts], items)
    assert [rows[r.doc_id] for r in texts] == [(n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest()) for n, h, f in want]


# Mixing


def test_poisson_inversion(spark):
    import math

    def inverse(rate, u):
        k, p = 0, math.exp(-rate)
        c = p
        while u > c:
            k += 1
            p *= rate / k
            c += p
        return k

    cases = [(r, (i + 0.5) / 40) for r in (0.01, 0.7, 1.0, 3.3, 15.9) for i in range(40)]
    df = spark.createDataFrame(cases, "r double, u double")
    assert [x.k for x in df.select(mixing.poisson(F.col("r"), F.col("u")).alias("k")).collect()] == [inverse(r, u) for r, u in cases]


def test_mixture_reaches_its_weights(spark, docs):
    df = docs([prose(i, 20 + i % 7) for i in range(3000)])
    weights = {"src0": 0.6, "src1": 0.4}
    out = mixing.mix(df, weights, budget=2.0, seed=3)
    size = lambda d: {r.source: r.b for r in d.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()}
    got, whole = size(out), sum(size(df).values())
    assert "src2" not in got
    assert abs(got["src0"] / (2 * whole) - 0.6) < 0.04 and abs(got["src1"] / (2 * whole) - 0.4) < 0.04
    again = mixing.mix(df.repartition(7), weights, budget=2.0, seed=3)
    key = lambda d: sorted((r.doc_id, r.__mx_copy) for r in d.select("doc_id", "__mx_copy").collect()) if False else sorted(map(tuple, d.select("doc_id", "__mx_copy").collect()))
    assert key(out) == key(again)
    order = [r[0] for r in mixing.mixture(df, weights=weights).select("doc_id").collect()]
    assert order != sorted(order)


def test_mixture_high_rates(spark, docs):
    df = docs([(0, "a"), (3, "b")])
    n = mixing.mix(df, None, budget=400.0).count()
    assert abs(n - 800) < 150


def test_mixture_odd_rows(spark, docs):
    df = docs([*ODD, (None, "no id"), (1, "again"), (1, "again")], extra=True)
    out = mixing.mixture(df, budget=1.0)
    assert out.columns == df.columns and out.count() >= 0
    assert mixing.mixture(docs([])).count() == 0
    none = df.withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(none, budget=5.0).select("__mx_rate").distinct().count() == 1
    same = mixing.mix(docs([(1, "x y z")] * 5), budget=3.0).groupBy().agg(F.count("*")).first()[0]
    assert same % 5 == 0


def test_mixture_many_sources_take_the_shuffled_join(spark, docs, monkeypatch):
    df = docs([prose(i) for i in range(30)])
    want = sorted(map(tuple, mixing.mix(df).select("doc_id", "__mx_copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "__mx_copy").collect())) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toArrow(), con.sql(queries.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(tuple(str(r[c]) for c in names) for r in t.to_pylist())
    assert rows(got) == rows(want)


# Sharding


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        side = 1 << bits
        table = sharding.curve_table(dims, bits)
        assert sorted(table) == list(range(side**dims))
        cells = sorted(range(side**dims), key=table.__getitem__)
        point = lambda c: [c // side ** (dims - 1 - d) % side for d in range(dims)]
        assert all(sum(abs(a - b) for a, b in zip(point(x), point(y), strict=True)) == 1 for x, y in zip(cells, cells[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 5, 16, 100])
def test_shards_hold_equal_counts(docs, n):
    rows = sharding.document_shards(docs([(i, prose(i, 5 + i % 40)) for i in range(n)], extra=True), 16).collect()
    assert len(rows) == n
    counts = collections.Counter(r.shard for r in rows)
    if n:
        sizes = [counts.get(s, 0) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
    for s, c in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))
    ordered = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_shards_of_odd_rows(docs):
    df = docs([*ODD, (None, "x"), (1, "same"), (1, "same")])
    got = sharding.document_shards(df, 4)
    rows = got.collect()
    assert len(rows) == len(ODD) + 3
    first = {r.doc_id: r for r in rows if r.doc_id not in (None, 1)}
    for i, t in enumerate(ODD):
        if i != 1:
            b = (t or "").encode()
            assert (first[i].size, first[i].text_crc32) == (len(b) + 1, zlib.crc32(b))
    named = docs(["a", "b"], extra=True)
    whole = sharding.document_shards(named, 2, with_columns=True)
    assert whole.columns == [*named.columns, "curve", "shard_", "slot"] and {r["shard"] for r in whole.collect()} == {"shard"}


def files_read(rows, column, value):
    """Shards that a reader which filters by min and max of the column must open, and those that hold the value."""
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["shard"]].append(r[column])
    return sum(min(v) <= value <= max(v) for v in spans.values()), sum(value in v for v in spans.values())


@pytest.mark.parametrize("column,most", [("lang", 9), ("source", 8), ("n_chars", 14)])
def test_shards_prune_by_each_dimension(spark, docs, column, most):
    # Sources differ after a long common beginning, languages are four, sizes many; all are independent.
    df = docs([(i, f"{i:04} " + "x" * ((i * 37) % 997)) for i in range(4000)])
    df = df.withColumn("lang", F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.xxhash64("doc_id") % 4 + 4).cast("int") % 4 + 1)).withColumn("source", F.format_string("https://common.example/%02d", F.pmod(F.hash("doc_id"), F.lit(20))))
    rows = sharding.document_shards(df, 16, with_columns=True).select("lang", "source", "n_chars", "shard").collect()
    values = sorted({r[column] for r in rows})
    read = [files_read(rows, column, values[int(len(values) * q)])[0] for q in (0.1, 0.3, 0.5, 0.7, 0.9)]
    assert sum(read) / len(read) <= most, read


def test_copies_of_a_text_lie_together(spark, docs):
    df = docs([(i, prose(i % 40, 30)) for i in range(400)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 4)).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 7))
    rows = sharding.document_shards(df, 4).collect()
    at = collections.defaultdict(list)
    for r in rows:
        at[r.text_crc32].append((r.shard, r.slot))
    counts = collections.Counter(r.shard for r in rows)
    place = lambda s, k: sum(counts[i] for i in range(s)) + k
    assert len(at) == 40 and all(max(place(*x) for x in v) - min(place(*x) for x in v) == len(v) - 1 for v in at.values())


def test_runs_of_strings_are_even(spark):
    values = [f"prefix-of-many-letters-{i * i % 1009:04}" for i in range(5000)] + ["one"] * 3000 + [None] * 10
    bounds = sharding.string_bounds(spark.createDataFrame([(v,) for v in values], "v string"), 16)
    known, cuts = sorted(v for v in values if v), [*bounds, None]
    runs = [sum(1 for v in known if (low is None or v > low) and (high is None or v <= high)) for low, high in zip([None, *bounds], cuts, strict=True)]
    assert bounds == sorted(set(bounds)) and len(bounds) < 16 and sum(runs) == 8000 and max(r for r in runs if r < 3000) < 2 * 8000 / 16


def test_starts_of_partitions(spark):
    counts = spark.createDataFrame([(3, 5), (0, 2), (7, 1)], "p int, n long")
    assert sorted(map(tuple, sharding.running(counts, "p", "n").collect())) == [(0, 0, 8), (3, 2, 8), (7, 7, 8)]


def brute_shards(rows, n):
    """Shards and slots by sorting in memory: rows of (curve, crc, hash, id)."""
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    return {i: (k * n // len(rows), k - -(-(k * n // len(rows) * len(rows)) // n)) for k, i in enumerate(order)}


def test_shards_by_sorting(spark, sf):
    got = queries.op5_sharding(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("h", F.xxhash64("text")).collect()}
    assert len(got) == len(docs)
    rows = []
    for r in got:
        text = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
        rows.append((r.curve, r.text_crc32, docs[r.doc_id].h, r.doc_id))
    assert {i: (r.shard, r.slot) for i, r in enumerate(got)} == brute_shards(rows, 16)


# Quality rules


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def check_statistics(df, texts):
    got = quality_rules.statistics(df)
    assert plan_is_native(got)
    rows = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == [brute_statistics(t) for t in texts]


def test_statistics_brute_force(docs):
    texts = [*ODD, prose(1), prose(2) + "\n" + prose(2), "a b c d e a b c d e f a b c d e", "a a a a a", "a a a a a a a", "1 2 3 4 5 6 1 2 3 4 5 9 2 3 4 5 6", "x\n \nx\nx \n\t\n", "🙂 # * $ % & | < >", "a\x0bb\x0cc\rd\x85e f"]
    check_statistics(docs(texts, extra=True), texts)


@quick
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "#", "\n"]), max_size=40), min_size=1, max_size=5))
def test_statistics_property(docs, texts):
    texts = [" ".join(t) for t in texts]
    check_statistics(docs(texts), texts)


def test_rules_keep_prose_and_drop_junk(docs):
    good = [prose(i, 80) for i in range(60)]
    junk = ["!!! ### $$$ " * 30, "WORD!! " * 80, " ".join(f"{i}*** {i}%%%" for i in range(60)), "", None, "too short", "| ".join(["a", "|"] * 50)]
    rows = {r.doc_id: r for r in quality_rules.judge(docs(good + junk)).collect()}
    assert all(rows[i].kept for i in range(len(good)))
    assert not any(rows[len(good) + i].kept for i in range(len(junk)))
    for r in rows.values():
        assert 0 <= r.p_good <= 1 and (not r.base_failed or not r.kept)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def plain_em(rows, rates, shares, steps):
    """The same estimation by loops over documents."""
    first = [list(r) for r in rates]
    rates, shares, rules = [list(r) for r in rates], list(shares), range(len(rates[0]))
    for _ in range(steps):
        against, told, sums = [[0.0 for _ in rules] for _ in rates], [[0.0 for _ in rules] for _ in rates], [0.0 for _ in rates]
        for row in rows:
            p = [share * math.prod(r if v == -1 else 1 - r if v == 1 else 1 for v, r in zip(row, own, strict=True)) for share, own in zip(shares, rates, strict=True)]
            for k, x in enumerate(p):
                sums[k] += x / sum(p)
                for i, v in enumerate(row):
                    against[k][i] += (v == -1) * x / sum(p)
                    told[k][i] += (v != 0) * x / sum(p)
        rates = [[min(0.999, max(1e-4, (against[k][i] + 10 * first[k][i]) / (told[k][i] + 10))) for i in rules] for k in range(len(shares))]
        shares = [(x + 1) / (len(rows) + len(shares)) for x in sums]
    return rates, shares


def drawn_votes(n, seed=4):
    """Votes of five rules on good documents (four fifths) and on two kinds of junk, with known rates of votes against."""
    rng = random.Random(seed)
    truth = [(0.02, 0.01, 0.03, 0.02, 0.01), (0.8, 0.6, 0.03, 0.02, 0.05), (0.02, 0.05, 0.7, 0.9, 0.6)]
    kinds = rng.choices(range(3), (0.8, 0.12, 0.08), k=n)
    return truth, [tuple(0 if rng.random() < 0.1 else -1 if rng.random() < r else 1 for r in truth[k]) for k in kinds]


def test_expectation_maximisation_by_loops(spark):
    kinds = {"x": ("a", "b"), "y": ("c", "d", "e")}
    _, rows = drawn_votes(400)
    rates, shares = quality_rules.fit(spark.createDataFrame(rows, "a int, b int, c int, d int, e int"), list("abcde"), kinds, steps=7, tolerance=0)
    want = plain_em(rows, *(x.tolist() for x in quality_rules.start(list("abcde"), kinds)), 7)
    assert np.abs(rates - np.array(want[0])).max() < 1e-9 and np.abs(shares - np.array(want[1])).max() < 1e-9


def test_expectation_maximisation_finds_rates(spark):
    truth, rows = drawn_votes(8000)
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    rates, shares = quality_rules.fit(df, list("abcde"), {"x": ("a", "b"), "y": ("c", "d", "e")})
    assert np.abs(rates - np.array(truth)).max() < 0.1 and np.abs(shares - np.array([0.8, 0.12, 0.08])).max() < 0.04
    told = df.distinct().select("*", quality_rules.posterior([F.col(x) for x in "abcde"], rates, shares).alias("p")).collect()
    votes = np.array([tuple(r)[:5] for r in told])
    assert np.abs(np.array([r.p for r in told]) - quality_rules.memberships(votes == -1, votes != 0, rates, shares)[:, 0]).max() < 1e-9


def test_kindred_rules_are_few_and_each_has_a_kind():
    names = list(quality_rules.rules())
    assert sorted(r for own in quality_rules.KINDS.values() for r in own) == sorted(names) and len(names) == 10


def test_rules_on_empty_table(docs):
    assert quality_rules.judge(docs([])).count() == 0
