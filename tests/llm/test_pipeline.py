"""The pipeline on a small table with planted cases, against a brute-force version of its stages."""

import random
import zlib

import numpy as np
import pytest
from test_operators import removed_by_hand

import corpus_pipeline
from tributary.llm import common

#: Documents' own columns, and some that clash with names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _at string, spans int, lang_pred string, rejected string, _doc string"
RNG = random.Random(9)
ENGLISH, GERMAN = ["the", "ing", "at", "er", "on", "li"], ["ung", "sch", "ei", "ber", "ich", "en"]
#: Null, without letters, or in no known language: these are rejected.
JUNK = [None, "", "12 !? 99", "zq" * 400]


def sentence(parts, n):
    return " ".join("".join(RNG.choice(parts) for _ in range(3)) for _ in range(n))


def planted():
    clean = [sentence(p, RNG.randint(90, 130)) for _ in range(40) for p in (ENGLISH, GERMAN)]
    passage = sentence(ENGLISH, 40)
    words = clean[5].split()
    near = [" ".join([*words[:40], "the", *words[41:]]), " ".join([*words[:40], "the", *words[41:70], "on", *words[71:]])]
    copies = [clean[3].upper(), clean[3], clean[5]]
    shared = [f"{sentence(ENGLISH, 60)} {passage} {sentence(GERMAN, 50)}" for _ in range(4)]
    return clean + near + copies + shared + JUNK + [clean[7] + " " + passage * 60]


def of_language(i):
    return None if i % 11 == 0 else "de" if i < 80 and i % 2 else "en"


def survivors(texts):
    """doc_id and text of the documents that reach packing."""
    last = {t.lower(): i for i, t in enumerate(texts) if t not in JUNK}
    docs = {i: texts[i] for i in sorted(last.values())}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in docs.items())}
    group = {i: i for i in docs}
    for _ in docs:  # the smallest doc_id that links reach
        for a in docs:
            for b in docs:
                if group[b] < group[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b]
    stay = [i for i in docs if group[i] == i]
    cut = removed_by_hand([docs[i] for i in stay])
    return {i: cut[k][3].decode() for k, i in enumerate(stay)}


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    exact = tokenizers.Tokenizer.from_file(common.tokenizer_file())
    texts = planted()
    folder = write(spark, [(i, t, of_language(i), "s", len(t or ""), "a", 1, "b", "c", "d") for i, t in enumerate(texts)], tmp_path)
    want = survivors(texts)
    assert len(want) < len(texts) - len(JUNK) - 3 and sum(map(len, want.values())) < sum(len(texts[i]) for i in want)
    pieces, windows = {}, {}
    for p in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(pieces) == set(want)
    for i, text in want.items():
        ids, at = np.array([*exact.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_keep_the_columns(spark, tmp_path):
    folder = write(spark, [(i, sentence(ENGLISH, 60), "en", "s", 1, "a", 1, "b", "c", "d") for i in range(12)], tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 12 and {r._at for r in out.collect()} == {"a"}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, [], tmp_path)).count() == 0
