"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tributary.llm import collocations as co

SCHEMA = "text string, lang string, n int, phrase string, score int, a int, rank int, h string"


def brute(rows, threshold, top=2000):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= threshold}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in candidates.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, left, right))
        out += [(lang, i, p.decode(), a, left, right, n, -s) for i, (s, _, p, a, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def result(spark, rows, threshold, **more):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y") for r in rows], SCHEMA).repartition(3)
    got = co.mine(table, threshold, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def table(seed=1, n=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "g\xa0ma", "délta", "e", "Ω", "mu", "nu", "-", "x1"] + [f"w{i}" for i in range(200)]
    stock = ["alpha beta gamma delta", "of the one", "a a a a a a", "nu\tmu  nu mu nu mu", "rare but whole phrase here now"]
    def sentence():
        return " ".join(rng.choice(stock) if rng.random() < 0.2 else rng.choice(words[: rng.choice((4, 10, 210))]) for _ in range(rng.randint(0, 12)))
    mark = lambda: rng.choice([". ", ",", "\n", "!?", ";\r\n", ":", " "])
    rows = [("".join(sentence() + mark() for _ in range(rng.randint(0, 6))), rng.choice(["en", "en", "en", "de", None])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \t \n,", "zz"), ("hot stuff " * 4000, "en"), ("x" * 90_000 + " y", "de")] + rows[:20]


def test_phrases_of_a_mixed_table(spark):
    rows = table()
    want = brute(rows, 12)
    assert len(want) > 60 and result(spark, rows, 12) == want
    assert result(spark, rows, 12, top=7) == brute(rows, 12, 7)


def test_summaries_of_small_capacity_lose_nothing(spark):
    rows = table(2, 400)
    assert result(spark, rows, 30, capacity=8) == brute(rows, 30) != []


def test_no_rows(spark):
    assert result(spark, [], 3) == [] == result(spark, [(None, None), ("one two", "en")], 3)


def test_summaries_merge_within_their_error():
    rng = np.random.default_rng(1)
    stream = (rng.zipf(1.3, 40_000) % 5000).astype(np.uint64)
    whole = co.Summary(300)
    for part in np.array_split(stream, 23):
        one = co.Summary(300)
        one.add(*np.unique(part, return_counts=True))
        one.merge()
        assert len(one.h) <= 300
        whole.add(one.h, one.n, one.error)
    whole.merge()
    true = Counter(stream.tolist())
    held = dict(zip(whole.h.tolist(), whole.n.tolist()))
    assert whole.error <= len(stream) / 300 and all(held.get(h, 0) <= n <= held.get(h, 0) + whole.error for h, n in true.items())


def test_long_texts_are_cut_at_marks_only():
    text = b"aa bb. cc dd, ee" + b"f" * 50 + b"; gg hh!ii"
    got = list(co.parts(text, 10))
    cut = lambda x: re.split(rb"[.,;!\n]", x)
    assert cut(b"\n".join(got)) == cut(text) and [len(x) for x in got] == [5, 6, 53, 9]
