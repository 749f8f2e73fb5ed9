from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import codec
from marlstone.functions.order import batched, ordinal

MIN, MAX = -(2**63), 2**63 - 1
NUMBER = st.one_of(st.integers(MIN, MAX), st.integers(-300, 300), st.sampled_from([MIN, MIN + 1, -1, 0, 1, MAX - 1, MAX]))


def wrapped(n):
    return (n + 2**63) % 2**64 - 2**63


def leb(u):
    out = []
    while True:
        u, low = u >> 7, u & 127
        out.append(low | (128 if u else 0))
        if not u:
            return out


@settings(max_examples=6, deadline=None)
@given(st.lists(NUMBER, min_size=1, max_size=60))
def test_all_encodings(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").withColumn("b", F.floor(F.col("i") / 20).cast("long"))
    d = codec.delta_encode(df, "v", "b", "i", "d")
    back = codec.delta_decode(d, "d", "b", "i", "back")
    z = codec.zigzag(F.col("v"))
    rows = back.select("i", "v", "d", "back", z.alias("z"), codec.unzigzag(z).alias("u"), codec.vle_size(z).alias("n"), codec.vle_bytes(z).alias("bytes"), codec.vle_value(codec.vle_bytes(z)).alias("zz")).orderBy("i").collect()
    for r in rows:
        before = 0 if r["i"] % 20 == 0 else values[r["i"] - 1]
        assert r["d"] == wrapped(r["v"] - before) and r["back"] == r["v"] == r["u"]
        unsigned = 2 * r["v"] if r["v"] >= 0 else -2 * r["v"] - 1
        assert r["z"] % 2**64 == unsigned and r["zz"] == r["z"]
        assert list(r["bytes"]) == leb(unsigned) and r["n"] == len(leb(unsigned))


def test_ordinals_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000 * 3).alias("k"))
    assert [r["rn"] for r in ordinal(df, "k", rows=90).orderBy("k").collect()] == list(range(1000))
    assert ordinal(spark.createDataFrame([], "k long"), "k").count() == 0
    assert batched(df, "k", 300).groupBy("batch").count().orderBy("batch").collect() == [(0, 300), (1, 300), (2, 300), (3, 100)]
