import zlib

import numpy as np
import pytest

from marlstone.llm import boost, quality, toxicity
from tests.llm.helpers import frame, odd_texts

LABELS = "doc_id long, quality int, toxic int"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("classify,label,folds,fold,least", [(quality.classify, "quality", 5, 0, 0.97), (toxicity.classify, "toxic", 3, 1, 0.85)])
def test_held_out_rows(spark, classify, label, folds, fold, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % folds == fold) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.7))
    rows = [(got[r["doc_id"]]["score"], r[label]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    score, mark = map(np.array, zip(*rows))
    assert auc(score, mark) >= least


@pytest.mark.parametrize("classify,folds,fold", [(quality.classify, 5, 0), (toxicity.classify, 3, 1)])
def test_labels_of_held_out_rows_change_nothing(spark, classify, folds, fold):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    turned = [(d, 1 - q, 1 - t) if zlib.crc32(str(d).encode()) % folds == fold else (d, q, t) for d, q, t in labels]
    one, two = (sorted((r["doc_id"], round(r["score"], 9)) for r in classify(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_odd_texts_and_labels(spark, classify):
    texts = odd_texts()
    docs = frame(spark, texts)
    some = [(i, i % 2, i % 2) for i in range(len(texts))] + [(None, 1, 1), (0, None, None), (999_999, 1, 0), (3, 1, 1)]
    for labels in (some, [], [(i, 1, 1) for i in range(5)], [(None, None, None)]):
        got = classify(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert classify(docs.limit(0), spark.createDataFrame(some, LABELS)).count() == 0
    null_id = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted(r["held_out"] for r in classify(null_id, spark.createDataFrame(some, LABELS)).collect())[:2] == [False, False]


def test_clean_keeps_columns_and_clean_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = toxicity.clean(docs, labels)
    ids = {r["doc_id"] for r in toxicity.classify(docs, labels).filter("predicted = 0").select("doc_id").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == ids


def test_discriminant_matches_densities():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(4000, 3)), r.normal(1, 2, size=(2000, 3))
    sums = [(len(v), v.sum(0), v.T @ v) for v in (a, b)]
    model = quality.fit(*(np.array(s) for s in zip(*sums)), shrinkage=0.0)
    x = r.normal(size=(50, 3))
    logs = [np.log(len(v) / 6000) - 0.5 * (np.linalg.slogdet(c := np.cov(v.T, bias=True) + quality.FLOOR * np.eye(3))[1] + np.einsum("ij,jk,ik->i", x - v.mean(0), np.linalg.inv(c), x - v.mean(0))) for v in (a, b)]
    assert quality.score(model, x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_boosted_trees_learn_an_interaction():
    x = np.random.default_rng(1).uniform(-1, 1, (2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    model = boost.fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    assert (model.margin(x) == boost.fit(x[:1500], y[:1500]).margin(x)).all()
    assert boost.fit(np.zeros((0, 4)), np.zeros(0)).margin(x).std() == 0


def test_isotonic_fit():
    knots, values = boost.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and np.interp([2, 3], knots, values) == pytest.approx([0.5, 0.5], abs=0.51)
    assert values[0] == 0 and values[-1] == 1


def test_obfuscated_words():
    import pyarrow as pa

    lexicon = toxicity._seeded([])
    plain, leet, none = toxicity.features(pa.array(["you idiot", "you 1d10t", "you nice"]), lexicon)
    assert plain[0] > 0 and leet[8] > 0 and none[[0, 1, 2, 8]].sum() == 0
    assert plain[7] > 0 == none[7]
    assert toxicity.features(pa.array([None, ""]), lexicon).shape == (2, toxicity.FEATURES)
