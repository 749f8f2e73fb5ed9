import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import near_join, session
from marlstone.llm.components import components
from tests.llm.helpers import WORD, frame, lower, odd_texts


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, n, percent):
    sets, group = [shingles(t, n) for t in texts], list(range(len(texts)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_odd_texts(spark, n, percent):
    texts = odd_texts()
    got = near_join.join(frame(spark, texts), n, percent).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, n, percent)


def chain(n=60, length=80):
    """Texts where neighbours are similar and the ends are not, and hangers-on below the threshold."""
    out = [" ".join(f"w{i + j}" for j in range(length)) for i in range(0, n * 3, 3)]
    return out + [" ".join(f"w{i + j}" if j < length // 2 else f"x{i}{j}" for j in range(length)) for i in range(0, n, 5)]


def test_chains_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(near_join, "GROUP", 4)
    texts = chain()
    got = near_join.join(frame(spark, texts), 4, 85).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, 4, 85)


def test_crowds_that_share_signatures_and_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(near_join, "GROUP", 3)
    r = random.Random(4)
    head = " ".join(f"h{i}" for i in range(40))
    tail = lambda k: [f"t{r.randrange(40)}" for _ in range(4 + k % 9)] if k % 3 else [f"u{k % 2}", "u2", "u3"]
    texts = [" ".join([head, *tail(k)]) for k in range(30)]
    df = frame(spark, texts).repartition(5)
    got = near_join.join(df, 2, 85).collect()
    want = brute(texts, 2, 85)
    assert sorted(tuple(x) for x in got) == want and 1 < len({c for _, _, c in want}) < 30


def test_a_group_of_near_copies_gives_few_pairs():
    comp, calls = np.arange(300) // 3, []
    edges = near_join._forest(comp, lambda i, rest: calls.append(i) or np.ones(len(rest), bool))
    assert len(edges) < 300 and len(calls) == 1
    r = np.random.default_rng(1)
    ok = np.triu(r.random((90, 90)) < 0.02, 1)
    ok |= ok.T
    edges = near_join._forest(comp[:90], lambda i, rest: ok[i, rest])
    assert all(ok[i, j] for i, j in edges)
    linked = lambda extra: set(map(tuple, near_components(90, [(i, i + 1) for i in range(89) if comp[i] == comp[i + 1]] + extra)))
    assert linked(edges) == linked(list(zip(*np.nonzero(ok), strict=True)))


def near_components(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    return [[i for i in range(n) if label[i] == k] for k in sorted(set(label))]


def test_ids_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "FEW", 0)
    texts = odd_texts(3)
    got = near_join.join(frame(spark, texts), 4, 85).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, 4, 85)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, None), (9, ""), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_join.join(df, 4, 85).collect()), key=repr)
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (None, 0, None), (9, 0, 9), (9, 1, 9)], key=repr)
    rows = [(1, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "k l m n o p q r"), (7, "k l m n o p q r s")]
    got = near_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r["component_id"] for r in got} == {1}
    kept = near_join.distinct(df.withColumn("component_id", df.text), 4, 85).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 3, 9]


def brute_links(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    return [(*row, sum(near(s, t) for t in sets) - bool(s)) for row, s in zip(brute(texts, n, percent), sets, strict=True)]


@pytest.mark.parametrize("n,percent,block,elements", [(4, 85, 1024, 1 << 20), (4, 85, 3, 1 << 20), (2, 50, 1024, 200)])
def test_links_inside_components_are_counted(spark, monkeypatch, n, percent, block, elements):
    monkeypatch.setattr(near_join, "COUNT_MEMBERS", block)
    monkeypatch.setattr(near_join, "COUNT_ELEMENTS", elements)
    texts = odd_texts() + chain()
    got = near_join.linked(frame(spark, texts), n, percent).collect()
    assert sorted(tuple(r) for r in got) == brute_links(texts, n, percent)


def test_links_of_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, ""), (9, "z")]
    got = near_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(5, 3, 3, 2), (5, 3, 3, 2), (3, 3, 3, 2), (None, 3, None, 0), (9, 0, 9, 0), (9, 1, 9, 0)], key=repr)


def test_texts_of_one_id_are_one_node(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, near), (7, near + " z"), (8, "q r s t u"), (8, "q"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_join.linked(df, 4, 85).collect())
    assert got == [(1, 3, 1, 1), (5, 3, 1, 1), (5, 57, 1, 1), (7, 58, 1, 1), (8, 0, 8, 0), (8, 1, 8, 0), (8, 2, 8, 0)]
    assert sorted(tuple(r) for r in near_join.distinct(df, 4, 85).collect()) == [(1, "a b c d e f"), (8, "q r s t u")]


def test_empty_tables(spark):
    df = frame(spark, ["a b"])
    assert near_join.join(df.limit(0)).count() == 0 and near_join.distinct(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in near_join.join(frame(spark, [None, "", " "])).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def fake(sets):
    s = near_join.Sets.__new__(near_join.Sets)
    s.sizes = np.array([len(x) for x in sets])
    s.bounds = np.r_[0, np.cumsum(s.sizes)]
    s.values = np.concatenate([np.sort(x) for x in sets])
    s.owner = np.repeat(np.arange(len(sets)), s.sizes)
    return s


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.sampled_from([50, 80, 85, 95]))
def test_linked_sets_share_a_signature(seed, size, percent):
    r = np.random.default_rng(seed)
    pool = r.integers(0, 2**63, 3 * size + 10).astype(np.uint64)
    other = int(r.integers(size * percent // 100, size + 1))
    both = -(-percent * (size + other) // (100 + percent))  # just similar enough
    if both > min(size, other):
        return
    a = pool[:size]
    b = np.r_[a[:both], pool[size : size + other - both]]
    assert 100 * both >= percent * (len(a) + len(b) - both)
    one, two = fake([a, b]).signatures(percent)
    assert set(one.tolist()) & set(two.tolist())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 300), st.integers(0, 300))
def test_sketches_never_exceed_the_difference(seed, x, y, shared):
    pool = np.unique(np.random.default_rng(seed).integers(0, 2**63, 1000).astype(np.uint64))
    shared = min(shared, x, y)
    a, b = pool[:x], np.r_[pool[:shared], pool[400 : 400 + y - shared]]
    one, two = fake([a, b]).sketches()
    bits = 8 * min(len(one), len(two))
    differ = int(np.bitwise_count(near_join._words(one, bits) ^ near_join._words(two, bits)).sum())
    assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("at_once", [0, 500_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(session, "FEW", at_once)
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got[3] == got[2] == got[1] == 1 and got[10] == 7 and 5 not in got
    assert {got[i] for i in range(100, 141)} == {100} and {got[300 + i] for i in range(50)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
