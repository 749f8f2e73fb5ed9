import hashlib
import random
import re

import numpy as np
import pytest

from marlstone.llm import decontaminate
from marlstone.llm.words import NOT_ALNUM, Alphabet, Words, buffers
from tests.llm.helpers import frame, lower, odd_texts

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items, window=8, least=2):
    known = {}
    for item, text in items:
        w = PATTERN.findall(lower(text or ""))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            known.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for k, t in enumerate(texts):
        w, hit, found = PATTERN.findall(lower(t or "")), set(), set()
        for m in {len(p) for p in known}:
            for i in range(len(w) - m + 1):
                if got := known.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= got
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= least))
    return out


def cases(seed=5):
    r = random.Random(seed)
    texts = odd_texts(seed)
    items = [(None, "one two three"), (1, None), (2, ""), (3, "?! ..."), (4, "Same"), (4, "w1 w2"), (10, "a b c d e"), (9, "a, B; c. d")]
    for i in range(20, 40):
        w = PATTERN.findall(lower(r.choice(texts) or "x"))
        s = r.randrange(max(1, len(w) - 12))
        items.append((i, " ".join(w[s : s + r.randint(1, 14)]).upper()))
    return texts, items


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 60])
def test_odd_texts(spark, limit):
    texts, items = cases()
    bench = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, n long")
    docs = frame(spark, texts)
    got = decontaminate.flag(docs, bench, block_bytes=limit).collect()
    want = brute(texts, items)
    assert sorted(tuple(r) for r in got) == want
    kept = decontaminate.clean(docs, bench, block_bytes=limit)
    assert kept.columns == docs.columns
    long = [(i, t) for i, t in items if len(PATTERN.findall(lower(t or ""))) >= 8]
    whole = {w[0] for w in brute(texts, long) if w[2]}
    assert whole and sorted(r["doc_id"] for r in kept.collect()) == [w[0] for w in want if not w[5] and w[0] not in whole]


def test_empty_tables(spark):
    docs, bench = frame(spark, ["a b c", None]), spark.createDataFrame([], "item_id long, text string")
    assert [r["n_items"] for r in decontaminate.flag(docs, bench).collect()] == [0, 0]
    assert decontaminate.clean(docs, bench).count() == 2
    assert decontaminate.flag(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("m", [1, 2, 3, 8])
def test_search_finds_every_place(m):
    r = np.random.default_rng(m)
    words = [f"w{i}" for i in r.integers(0, 4, 3000)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 1500), (1500, 1501), (1501, 3000))]
    raw, offsets = buffers(__import__("pyarrow").array(texts))
    w = Words(raw, offsets, Alphabet(NOT_ALNUM, True))
    chosen = {tuple(words[i : i + m]) for i in range(0, 60, 7)}
    (group,) = decontaminate.patterns_of([(str(k), " ".join(p)) for k, p in enumerate(sorted(chosen))], m)
    starts, pattern = group.search(w.hashes, w.bounds)
    want = [i for a, b in ((0, 1500), (1501, 3000)) for i in range(a, b - m + 1) if tuple(words[i : i + m]) in chosen]
    want += [1500] if m == 1 and (words[1500],) in chosen else []
    assert sorted(starts.tolist()) == sorted(want) and len(pattern) == len(starts)
