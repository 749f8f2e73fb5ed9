"""Small corpora with every odd case, and brute-force pieces."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names operators use themselves.
CLASH = ", size long, h1 long, n long, k long, text_sha256 string, rank long, shard string, component string, place string, y long, r1 long, r2 long, times long, copy long, __items string, __id long, __times long, spans long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def odd_texts(seed=7):
    """Nulls, empty and blank texts, ties, repeats, near copies, shared passages and a long text."""
    r = random.Random(seed)
    vocabulary = [a + b for a in "bcdfg" for b in ("a", "é", "o", "Ü", "i.", "u,")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [None, "", " \t\n", "one", "one two", "One  two\n", "one two three", "a b c d", "a b c d e"]
    base = [text(r.randint(20, 120)) for _ in range(12)]
    passage = text(60)
    for b in base:
        out += [b, b, b.replace(" ", "\n ")]
        words = b.split(" ")
        for _ in range(3):
            w = list(words)
            for _ in range(max(1, len(w) // r.choice((20, 40, 60)))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        out.append(b + " " + passage if r.random() < 0.5 else passage + " " + b)
    out += ["same " * 80, "same " * 81, text(3000), "x" * 70_000, "ab " * 40 + text(50) + " ab" * 40]
    return out


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, SCHEMA)
    more = (5, 6, 7, 8, "z", 9, "q", "w", "p", 1, 2, 3, 4, 5, "x", 6, 7, 8)
    return spark.createDataFrame([r + more for r in rows], SCHEMA + CLASH)
