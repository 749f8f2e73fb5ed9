import hashlib
import re

from pyspark.sql import functions as F

from marlstone.llm import exact_dedup
from tests.llm.helpers import frame, odd_texts


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc, i))
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda m: m[:3] if m[2] is not None else (m[0], True, 0))
        for m in g:
            out.append((m[2], best[2], len(g), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_texts(spark):
    texts = odd_texts()
    got = exact_dedup.exact_dedup(frame(spark, texts)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(list(enumerate(texts)))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "a  b"), (None, "c"), (None, "c"), (3, "c"), (-5, "c"), (4, None), (4, None)]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[3] for r in got) == 3


def test_colliding_hashes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_hashes", lambda norm: [F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2")])
    texts = ["a", "b", "a ", "c", "b\n", None]
    got = exact_dedup.exact_dedup(frame(spark, texts)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(list(enumerate(texts)))


def test_empty_table_and_plan(spark):
    df = frame(spark, odd_texts())
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    plan = exact_dedup.exact_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
