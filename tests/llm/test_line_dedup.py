"""Line deduplication against brute force."""

import random
import re
from collections import defaultdict

from tributary.llm import line_dedup

SCHEMA = "doc_id long, text string, _at int, n_lines string, _GONE int, pos int, a int, last string"
HOT = "This line stands in most of the documents there are"


def brute(rows, least_chars=40, least_docs=5):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda line: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if doc_id is None else doc_id)
    bad = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in bad or (-1 if doc_id is None else doc_id) == bad[key(x)]]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y") for r in rows], SCHEMA)
    got = line_dedup.dedup(table, **more)
    assert got.columns == [*table.columns, "n_dropped"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)


def test_lines_of_a_mixed_table(spark):
    rng = random.Random(4)
    pool = [f"line number {i} of the pool is " + "w" * rng.randint(5, 40) for i in range(60)]
    forms = [lambda s: s, lambda s: "  \t" + s + "\x0b\r", lambda s: s.upper(), lambda s: s + "\xa0"]
    rows = []
    for i in range(120):
        lines = [rng.choice(forms)(rng.choice(pool[: rng.choice((10, 60))])) for _ in range(rng.randint(0, 12))] + [HOT] * (i % 3 < 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, HOT), (203, HOT), (5, HOT + "\n" + HOT), (None, HOT + "\nown"), (300, "é" * 39 + "\n" + "z" * 200_000), (301, "\n".join([HOT, "short", HOT]))]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, least_chars=5, least_docs=2) == brute(rows, 5, 2)


def test_repeated_rows_are_one_document(spark):
    rows = [(7, HOT)] * 6 + [(i, HOT) for i in range(3)]
    assert result(spark, rows) == brute(rows) and all(r[3] == 0 for r in result(spark, rows))
    rows += [(3, HOT)]
    got = result(spark, rows)
    assert got == brute(rows) and sum(r[1] == HOT for r in got) == 6
    assert result(spark, [(None, HOT)] * 9) == brute([(None, HOT)] * 9)


def test_an_empty_table(spark):
    assert result(spark, []) == []
