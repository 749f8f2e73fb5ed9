import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import mixing
from tests.llm.helpers import CLASH, SCHEMA, WORD, frame, odd_texts


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 10**9), max_size=12))
def test_targets(size_of):
    t = mixing.targets(size_of)
    total = sum(size_of.values())
    assert sum(t.values()) == pytest.approx(total, rel=1e-9)
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    free = [t[s] / weight[s] for s in order if t[s] < 3 * size_of[s] * (1 - 1e-12)]
    for s in order:
        assert t[s] <= 3 * size_of[s] * (1 + 1e-9)
        if free and t[s] < 3 * size_of[s] * (1 - 1e-12):
            assert t[s] / weight[s] == pytest.approx(max(free), rel=1e-9)
        elif free:
            assert t[s] <= weight[s] * max(free) * (1 + 1e-9)


def corpus(spark, n=3000):
    r = random.Random(1)
    size = lambda: int(min(2000, r.lognormvariate(3.5, 1)))
    rows = [(i, " ".join(["w"] * size()), "en", "hot" if i % 3 == 0 else None if i % 31 == 0 else f"s{i % 5}", 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_mix_meets_its_targets(spark):
    docs = corpus(spark)
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
    assert len(got) == 3000 and all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    want = mixing.targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.02)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_texts(spark):
    texts = odd_texts()
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)} == {i: r["size"] for i, r in got.items()}
    assert all(r["taken"] == 0 for r in got.values() if r["size"] == 0)
    kept = mixing.apply(df)
    assert kept.columns == df.columns
    copies = dict(kept.groupBy("doc_id").count().collect())
    assert copies == {i: r["taken"] // r["size"] for i, r in got.items() if r["taken"]}


def test_small_tables(spark):
    df = frame(spark, ["a b"])
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply(df.limit(0)).count() == 0
    assert mixing.mix(df).collect() == [(0, 2, 2, 2.0, 2)]
    assert mixing.mix(frame(spark, [None, ""])).filter("taken > 0 or target > 0").count() == 0
    rows = [(1, "a b", "en", "s", 1), (1, "a b", "en", "s", 1), (None, "c", "en", None, 1)]
    twice = spark.createDataFrame([r + (5, 6, 7, 8, "z", 9, "q", "w", "p", 1, 2, 3, 4, 5, "x", 6, 7, 8) for r in rows], SCHEMA + CLASH)
    assert mixing.mix(twice).count() == 3 and mixing.apply(twice).columns == twice.columns
    assert words_by_source(mixing.apply(twice)) == taken_by_source(twice)


def words_by_source(df):
    out = {}
    for r in df.collect():
        out[r["source"]] = out.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    return out


def taken_by_source(df):
    """Words that ``mix`` takes; its rows name no source, so sources here differ in size."""
    source = {n: s for s, n in words_by_source(df).items()}
    out = {}
    for r in mixing.mix(df).collect():
        out[source[r["source_size"]]] = out.get(source[r["source_size"]], 0) + r["taken"]
    return {s: n for s, n in out.items() if n}


@pytest.mark.parametrize("ids", ["null", "few", "equal rows"])
def test_apply_takes_what_mix_takes(spark, ids):
    r = random.Random(3)
    rows = []
    for i in range(400):
        text = " ".join(["w"] * r.randrange(1, 60)) if ids != "equal rows" else "w w w"
        doc_id = None if ids == "null" else i % 7 if ids == "few" else 1
        rows.append((doc_id, text, "en", f"s{i % 3}" if i % 5 else "s0", 0))
    df = spark.createDataFrame([x + (5, 6, 7, 8, "z", 9, "q", "w", "p", 1, 2, 3, 4, 5, "x", 6, 7, 8) for x in rows], SCHEMA + CLASH)
    assert words_by_source(mixing.apply(df)) == taken_by_source(df)


def test_rates_against_bisection(spark):
    """With no rounding, a source's rates are min(3, exp(t * size)) for the one t that meets the target."""
    docs = corpus(spark, 600)
    sizes = {r["doc_id"]: (r["source"], r["size"]) for r in mixing.sizes(docs).collect()}
    totals = {}
    for s, n in sizes.values():
        totals[s] = totals.get(s, 0) + n
    want = mixing.targets(totals)
    by_size = mixing.sizes(docs).groupBy("source", "size").count().withColumnRenamed("count", "docs")
    tilts = mixing.tilts(by_size, totals, want)
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    for s in totals:
        mine = [(d, n) for d, (x, n) in sizes.items() if x == s]
        low, high = -10.0, 10.0
        for _ in range(200):
            t = (low + high) / 2
            got = sum(n * min(3, math.exp(min(t * n, 2))) for _, n in mine)
            low, high = (t, high) if got < want[s] else (low, t)
        if want[s] < 3 * totals[s] * (1 - 1e-9):
            assert tilts[s][0] / tilts[s][1] == pytest.approx(low, rel=1e-3, abs=1e-7)
        for d, n in mine:  # a row's copies are its rate, rounded up or down
            rate = min(3, math.exp(min(low * n, 2)))
            assert math.floor(rate - 1e-3) <= copies[d] <= math.ceil(rate + 1e-3)


def test_rates_that_cannot_be_found(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_ROUNDS", 1)
    with pytest.raises(ArithmeticError):
        mixing.mix(corpus(spark, 100))


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    docs = corpus(spark, 300)
    once, again = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(5)))
    assert once == again and len(once) == 300


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(frame(spark, odd_texts()))
