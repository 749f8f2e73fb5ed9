import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import substrings
from marlstone.llm.words import SPACE, Alphabet, Words, windows
from tests.llm.helpers import WORD, frame, odd_texts


def brute(texts, n):
    words = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - n + 1):
            if starts[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [1, 5, 35, 45, 100])
def test_odd_texts(spark, window):
    texts = odd_texts()
    got = substrings.dedup(frame(spark, texts), window).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, window)


@pytest.mark.parametrize("window", [5, 35])
def test_texts_and_spans(spark, window):
    texts = odd_texts()
    want = brute(texts, window)
    for r in substrings.cut(frame(spark, texts), window).collect():
        words = WORD.findall(texts[r["doc_id"]] or "")
        gone = {i for s in r["removed"] for i in range(s["start"], s["stop"])}
        assert all(a["stop"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
        assert r["kept"] == " ".join(x for i, x in enumerate(words) if i not in gone)
        assert (r["doc_id"], r["n_words"], len(gone), hashlib.sha256(r["kept"].encode()).hexdigest()) == want[r["doc_id"]]


def test_many_slices(spark, monkeypatch):
    """Passages shared within a slice, between slices, and both."""
    monkeypatch.setattr(substrings, "slices", lambda offsets, limit: ((i, min(i + 3, len(offsets) - 1)) for i in range(0, len(offsets) - 1, 3)))
    texts = odd_texts(11)
    got = substrings.dedup(frame(spark, texts).repartition(3), 35).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, 35)


def test_ladder():
    assert substrings.ladder(35) == [9, 18, 35] and substrings.ladder(100) == [7, 13, 25, 50, 100] and substrings.ladder(5) == [5]
    for window in range(10, 200):
        lengths = substrings.ladder(window)
        left = substrings.reach(lengths)
        assert all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:])) and len(left) == len(lengths) - 1
        # the window of each level holds that of the level before
        assert all(x <= y and a - x <= b - y for a, b, x, y in zip(lengths, lengths[1:], left, left[1:]))


def test_task_that_forgets(spark, monkeypatch):
    monkeypatch.setattr(substrings.Seen, "LIMIT", 100)
    texts = odd_texts(3)
    assert sorted(tuple(r) for r in substrings.dedup(frame(spark, texts).repartition(2), 35).collect()) == brute(texts, 35)


def test_levels_stop_when_nothing_repeats(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(20)]
    lengths, df = substrings.ladder(35), frame(spark, texts)
    rows = df.select(*substrings.row_keys(df["doc_id"], df["text"]), "text")
    assert substrings.candidates(rows, lengths) is None
    assert {r["n_removed"] for r in substrings.dedup(df).collect()} == {0}
    half = " ".join(f"w{i}" for i in range(17))  # repeats on the first level alone
    again = [f"{t} {half} {t}x" for t in texts[:3]]
    assert sorted(tuple(r) for r in substrings.dedup(frame(spark, again)).collect()) == brute(again, 35)


def test_common_phrases_and_hot_passage(spark):
    r = random.Random(5)
    phrase, passage = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(40))
    words = lambda n: " ".join(f"v{r.randrange(9000)}" for _ in range(n))
    texts = [f"{words(r.randrange(60))} {phrase} {words(r.randrange(60))} {passage if i % 3 == 0 else ''}" for i in range(300)]
    assert sorted(tuple(x) for x in substrings.dedup(frame(spark, texts).repartition(7)).collect()) == brute(texts, 35)


def rows_shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    store = context.statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_anchors_are_shuffled_once(spark):
    """One exchange serves the counts of the first two levels; a third is sent what these leave."""
    r = random.Random(9)
    words = lambda n: " ".join(f"v{r.randrange(9000)}" for _ in range(n))
    shared = [words(30) for _ in range(40)]  # repeat on the levels of 9 and 18 words
    df = frame(spark, [f"{words(80)} {r.choice(shared)} {words(80)}" for _ in range(120)])
    rows, lengths = df.select(*substrings.row_keys(df["doc_id"], df["text"]), "text").repartition(4).localCheckpoint(), substrings.ladder(35)
    n, before = substrings.anchors(rows, lengths).count(), rows_shuffled(spark)
    found = substrings.candidates(rows, lengths)
    places = found.selectExpr("sum(size(places))").first()[0]
    sent = sum(x for k, x in rows_shuffled(spark).items() if k not in before)
    assert n > 1000 and places > 100
    assert n <= sent <= n + 120 + places


def anchor_phrase(n):
    """A phrase of n words whose hash is so small that it is an anchor in most surroundings."""
    phrases = [" ".join(f"p{k}x{i}" for i in range(n)) for k in range(2000)]
    return min(phrases, key=lambda t: windows(Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), Alphabet(SPACE, lower=False)).hashes, n)[0])


@pytest.mark.parametrize("window", [12, 35, 70])
def test_short_windows_that_are_often(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "OFTEN", 3)
    r, lengths = random.Random(6), substrings.ladder(window)
    words = lambda n: " ".join(f"v{r.randrange(9000)}" for _ in range(n))
    phrase = anchor_phrase(lengths[0])
    around = [(words(40), words(40)) for _ in range(25)]
    texts = [f"{words(50)} {phrase} {words(50)}" for _ in range(60)]  # the phrase alone
    texts += [f"{words(i % 5)} {a} {phrase} {b} {words(i % 3)}" for i, (a, b) in enumerate(around * 2)]  # and what is around it
    texts += [f"{words(9)} {a} {phrase} {words(50)}" for a, _ in around[:9]]
    r.shuffle(texts)
    df = frame(spark, texts).repartition(5).localCheckpoint()
    out = substrings.anchors(df, lengths).collect()
    # with one level but the last, a task knows that the window repeats once it has met it twice
    assert sum(x["often"] for x in out) > 40 if len(lengths) > 2 else sum(x["settled"] for x in out) > 40
    assert sorted(tuple(x) for x in substrings.dedup(df, window).collect()) == brute(texts, window)


def test_task_sends_few_rows_of_a_window_to_one_place(spark, monkeypatch):
    monkeypatch.setattr(substrings, "OFTEN", 3)
    monkeypatch.setattr(substrings, "slices", lambda offsets, limit: ((i, min(i + 2, len(offsets) - 1)) for i in range(0, len(offsets) - 1, 2)))
    texts = [" ".join(f"a{k}x{i}" for i in range(30)) + f" {anchor_phrase(9)} " + " ".join(f"b{k}x{i}" for i in range(30)) for k in range(40)]
    out = substrings.anchors(frame(spark, texts).coalesce(1), [9, 18, 35]).collect()
    alike = Counter(x["h0"] for x in out)
    assert max(alike.values()) == 3 and len({x["h1"] for x in out}) == len(out)
    assert sum(x["often"] for x in out) > 30 and sum(x["often"] and alike[x["h0"]] == 3 for x in out) == 1


def test_tally(monkeypatch):
    r, tally, met = random.Random(4), substrings.Tally(), Counter()
    for _ in range(30):
        keys = [r.randrange(1 << 64) if r.random() < 0.2 else r.randrange(12) for _ in range(r.randrange(20))]
        want = []
        for k in keys:
            want.append(met[k])
            met[k] += 1
        assert tally.before(np.array(keys, np.uint64)).tolist() == want
    monkeypatch.setattr(substrings.Seen, "LIMIT", 4)
    for _ in range(30):
        out = tally.before(np.array([r.randrange(9) for _ in range(3)], np.uint64))
        assert len(tally.keys) <= 4 and len(out) == 3 and (np.diff(tally.keys.astype(float)) > 0).all()


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "x y z"), (None, "q r s t"), (None, "u q r s t"), (2, None), (-(2**63), "k l m n"), (None, "k l m o")]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in got), key=repr) == sorted([(1, 5, 5), (1, 5, 5), (1, 3, 0), (None, 4, 4), (None, 5, 4), (2, 0, 0), (-(2**63), 4, 3), (None, 4, 3)], key=repr)


def test_null_ids_whose_texts_share_a_32_bit_hash(spark):
    df = spark.createDataFrame([(None, "p16914 a b c"), (None, "q291467 d"), (1, "a b c")], "doc_id long, text string")
    assert df.selectExpr("hash(text)").distinct().count() == 2
    got = substrings.cut(df, 3).collect()
    assert sorted((r["n_words"], r["kept"], [tuple(s) for s in r["removed"]]) for r in got) == [(2, "q291467 d", []), (3, "", [(0, 3)]), (4, "p16914", [(1, 4)])]


def test_empty_table(spark):
    assert substrings.dedup(frame(spark, ["a"]).limit(0)).count() == 0
