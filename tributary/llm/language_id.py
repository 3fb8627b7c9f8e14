"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

For each language, Spark counts the words (with a start and an end mark; runs of more than LONGEST letters in pieces that overlap, so that
every n-gram counts once) of a bounded hash sample of labelled rows.  The driver counts their character n-grams up to ORDER, and turns the counts into interpolated Kneser-Ney
probabilities.  All languages share one sorted array of n-gram hashes per order; beside it stand the languages' log
probabilities and back-off weights.  A letter is looked up at the longest order that any language has seen and,
failing that, at shorter ones with the back-off weights added.  As no context crosses a word's border, each
distinct word is scored once per task and kept in a bounded table.

The language with the lowest cross-entropy per letter wins (ties: the first by name).  A text is rejected when its
cross-entropy lies above the limit of that language: the quantile QUANTILE of every CALIBRATE-th row of its sample under models of the others, plus SLACK nats, so
that clean texts pass; a language without such rows, or without others, rejects none.  The final models are learned from all rows of the sample, so no label is lost, however few rows it has.
With ``drop_odd`` (off by default; the pipeline's filter asks for it) rows that models which have not seen them reject in the same way are not learned from, so labelled junk does not pass for its
label; a label's rare scripts or dialects can go with it.  Null texts and texts without letters get ``und``, score 0, and are rejected.
``score`` is the softmax over languages of minus the cross-entropy per letter, sharpened by SHARP.

Rows with null lang are not learned from, nor is a label without any letters in its sample; with no labelled rows at all every text gets ``und``.  lang, source and
doc_id are never inputs of a prediction; doc_id only decides which rows are learned from.  Repeated rows count as often as they
come; whole texts are read; columns of the input that are named like those of PREDICTED are replaced, other extra columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, keep, release, shared_folder

ORDER, DISCOUNT = 5, 0.75
#: Rows of each language that a model is fitted on, at most (in expectation: a hash sample).
SAMPLE_ROWS = 1500
#: Every CALIBRATE-th of them calibrates the limits before it is learned from.
CALIBRATE = 8
QUANTILE, SLACK, SHARP = 0.9, 1.25, 8.0
#: Distinct words whose scores are kept per task, and the longest that is kept or counted in one piece.
TABLE, LONGEST = 200_000, 40
START, STOP = "\x01", "\x02"
WORD = re.compile(r"[^\W\d_]+")
PREDICTED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n symbols that end at each place (places before the first n-1 are not meant)."""
    h = np.full(len(codes), np.uint64(n), np.uint64)
    for back in range(n - 1, -1, -1):
        h = (h ^ np.concatenate([np.zeros(min(back, len(codes)), np.uint64), codes[: max(0, len(codes) - back)]])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def marked(word: Column) -> Column:
    """The pieces of a word, as ``lay_out`` takes them."""
    n = F.length(word)
    part = lambda i: F.concat(F.when(i == 0, START).otherwise(""), F.substring(word, F.greatest(i - (ORDER - 1), F.lit(0)) + 1, F.lit(LONGEST) + F.least(i, F.lit(ORDER - 1))), F.when(i + LONGEST >= n, STOP).otherwise(""))
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(LONGEST)), part)


def lay_out(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all pieces in a row; each symbol's piece and place in it.

    A piece starts with the start mark (then letters, and the end mark where the word ends), or with ORDER - 1
    letters that only are the context of the next ones: their place is -1.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(first, size)
    inner = np.repeat(codes[first] != ord(START), size) if len(codes) else np.zeros(0, bool)
    return codes, np.repeat(np.arange(len(pieces)), size), np.where(inner & (place < ORDER - 1), -1, place)


class Models:
    """One Kneser-Ney model per language, over one sorted hash array per order."""

    def __init__(self, langs: list[str], counts: dict[str, Counter]) -> None:
        """counts: for each language how often each piece (see ``lay_out``) came; none may be empty."""
        self.langs = langs
        self.limits = np.full(len(langs), math.inf)
        raw = []
        for lang in langs:
            words = list(counts[lang])
            codes, owner, place = lay_out(words)
            weight = np.fromiter(map(counts[lang].__getitem__, words), np.float64, len(words))[owner]
            raw.append((codes, place, weight))
        self.keys: list[np.ndarray] = []
        grams: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for n in range(1, ORDER + 1):
            per = []
            for codes, place, weight in raw:
                at = np.flatnonzero(place >= max(1, n - 1))
                h, back = hashes(codes, n)[at], hashes(codes, n - 1)[at - 1] if n > 1 else np.zeros(len(at), np.uint64)
                low = hashes(codes, n - 1)[at] if n > 1 else np.zeros(len(at), np.uint64)
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                per.append((h[first], back[first], low[first], np.bincount(inverse, weight[at], len(first)), place[at][first] == n - 1))
            grams.append(per)
            mark = [hashes(np.array([ord(START)], np.uint64), 1)] if n == 1 else []  # a context, though never predicted
            self.keys.append(np.unique(np.concatenate([p[0] for p in per] + mark)) if per else np.zeros(0, np.uint64))
        shape = [(len(k), len(langs)) for k in self.keys]
        self.logp = [np.full(s, 0.0) for s in shape]
        self.back = [np.full(s, 0.0) for s in shape]  # log weight of the lower order, for an n-gram as context
        self.floor = math.log(1e-7)
        prob = [np.full(s, 0.0) for s in shape]
        for j in range(len(langs)):
            for n in range(1, ORDER + 1):
                h, ctx, low, count, _ = grams[n - 1][j]
                if n < ORDER:  # continuation counts: how many different symbols stand before; n-grams at a word's start keep their own
                    follow = grams[n][j]
                    at = np.searchsorted(h, follow[2])
                    cont = np.bincount(at, minlength=len(h)).astype(np.float64)
                    count = np.where(cont > 0, cont, count)
                if n == 1:
                    total = count.sum()
                    p = np.maximum(count - DISCOUNT, 0) / max(total, 1) + DISCOUNT * len(h) / max(total, 1) / 5000
                    prob[0][np.searchsorted(self.keys[0], h), j] = p
                    continue
                _, inverse = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(inverse, count), np.bincount(inverse)
                lam = np.minimum(DISCOUNT * kinds / total, 1.0)
                at_low = np.searchsorted(self.keys[n - 2], low)
                p = np.maximum(count - DISCOUNT, 0) / total[inverse] + lam[inverse] * prob[n - 2][at_low, j]
                prob[n - 1][np.searchsorted(self.keys[n - 1], h), j] = p
                place = np.searchsorted(self.keys[n - 2], ctx)
                found = np.minimum(place, len(self.keys[n - 2]) - 1)
                good = self.keys[n - 2][found] == ctx
                self.back[n - 2][found[good], j] = np.log(lam[inverse][good])
        # n-grams that only other languages have seen: their back-off probability here
        self.lows = grams
        for n in range(1, ORDER + 1):
            p = prob[n - 1]
            self.logp[n - 1] = np.log(np.where(p > 0, p, 1.0))
            missing = p <= 0
            if n == 1:
                self.logp[0][missing] = self.floor
                continue
            ctx, low = np.zeros(len(self.keys[n - 1]), np.uint64), np.zeros(len(self.keys[n - 1]), np.uint64)
            for h, c, lo, _, _ in grams[n - 1]:
                at = np.searchsorted(self.keys[n - 1], h)
                ctx[at], low[at] = c, lo
            lower = self.logp[n - 2][np.searchsorted(self.keys[n - 2], low)]
            where = np.minimum(np.searchsorted(self.keys[n - 2], ctx), max(len(self.keys[n - 2]) - 1, 0))
            weight = np.where((self.keys[n - 2][where] == ctx)[:, None], self.back[n - 2][where], 0.0)
            self.logp[n - 1] = np.where(missing, lower + weight, self.logp[n - 1])
        del self.lows
        self.logp = [x.astype(np.float32) for x in self.logp]
        self.back = [x.astype(np.float32) for x in self.back]

    def score(self, words: list[str]) -> np.ndarray:
        """Summed log probability of each word (rows) in each language; last column: its symbols but the start."""
        codes, owner, place = lay_out([f"{START}{w}{STOP}" for w in words])
        total = np.zeros((len(codes), len(self.langs)), np.float32)
        live = np.flatnonzero(place > 0)
        for n in range(ORDER, 0, -1):
            if not len(live):
                break
            can = live[place[live] >= n - 1]
            if not len(can):
                continue
            found = self.find(n, hashes(codes, n)[can])
            hit = found >= 0
            total[can[hit]] += self.logp[n - 1][found[hit]]
            miss = can[~hit]
            if n > 1:
                ctx = self.find(n - 1, hashes(codes, n - 1)[miss - 1])
                total[miss[ctx >= 0]] += self.back[n - 2][ctx[ctx >= 0]]
            else:
                total[miss] += self.floor
            live = np.sort(np.concatenate([live[place[live] < n - 1], miss]))
        first = np.flatnonzero(place == 0)
        sums = np.add.reduceat(total.astype(np.float64), first) if len(first) else np.zeros((0, len(self.langs)))
        size = np.diff(np.append(first, len(codes))) - 1
        return np.column_stack([sums, size])

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        keys = self.keys[n - 1]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)


class Scorer:
    """Texts' cross-entropies, by a bounded table of words."""

    def __init__(self, models: Models) -> None:
        self.models, self.index = models, {}
        self.rows = np.zeros((0, len(models.langs) + 1))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Nats per symbol of each text in each language; nan where a text has no letters."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = [w for w in set().union(*words).difference(self.index)]
        if len(self.rows) + len(new) > TABLE:
            self.index, self.rows = {}, self.rows[:0]
            new = list(set().union(*words))
        if new:
            self.index.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            fresh = self.models.score(new)
            fresh[[i for i, w in enumerate(new) if not any(map(str.isalpha, w))]] = 0.0
            self.rows = np.concatenate([self.rows, fresh])
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.index[w] for ws in words for w in ws), np.int64, int(size.sum()))
        for w in [w for w in new if len(w) > LONGEST]:  # not kept: its row is never asked for again
            del self.index[w]
        sums = np.zeros((len(words), self.rows.shape[1]))
        full = np.flatnonzero(size)
        if len(full):
            starts = (np.cumsum(size) - size)[full]
            sums[full] = np.add.reduceat(self.rows[at], starts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(sums[:, -1:] > 0, -sums[:, :-1] / sums[:, -1:], np.nan)

    def predict(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        h = self.entropies(texts)
        none = np.isnan(h).all(axis=1) if h.shape[1] else np.ones(len(texts), bool)
        langs, scores, low, reject = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        good = np.flatnonzero(~none)
        if len(good):
            best = h[good].argmin(axis=1)
            low[good] = h[good, best]
            scores[good] = 1.0 / np.exp(-(h[good] - low[good, None]) * SHARP).sum(axis=1)
            reject[good] = low[good] > self.models.limits[best]
            for i, b in zip(good.tolist(), best.tolist()):
                langs[i] = self.models.langs[b]
        return langs, scores.tolist(), [None if math.isnan(x) else x for x in low.tolist()], reject.tolist()


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, drop_odd: bool = False) -> Models:
    """Models from the labelled rows of ``docs`` (text, lang, and doc_id for the sampling hash)."""
    known = docs.filter("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Models([], {})
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, rows / n))])
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(dice < share[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(8)), F.lit(CALIBRATE)) == 0).alias("tune"))
    folder = shared_folder(docs.sparkSession)
    sample = keep(sample, folder, "sample")
    tune, train = sample.filter("tune"), sample.filter("not tune")
    if drop_odd:
        train = within(own_entropies(train, learn(tune)))
    tuned = own_entropies(tune, learn(train))  # by models that have not seen these rows
    bounds = limits(tuned)
    if drop_odd:
        tune = within(tuned, bounds)
    models = learn(train.select("lang", "text").unionByName(tune.select("lang", "text")))
    for lang, limit in bounds.items():
        if lang in models.langs:
            models.limits[models.langs.index(lang)] = limit
    discard(docs.sparkSession, folder, "sample")
    return models


def learn(sample: DataFrame) -> Models:
    """Models of all rows of ``sample`` (lang, text)."""
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("w"))
    words = words.filter("w != ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    counts: dict[str, Counter] = {}
    for r in words.select("lang", F.explode(marked(F.col("w"))).alias("w"), "n").groupBy("lang", "w").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["w"]] = r["n"]
    models = Models(sorted(counts), counts)
    counts.clear()
    release()  # what the counts took of the driver
    return models


def own_entropies(sample: DataFrame, models: Models) -> DataFrame:
    """``sample`` (lang, text) with h: the cross-entropy of a text in its own language; null where the models lack the language or the text has no letters."""
    column = {k: i for i, k in enumerate(models.langs)}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            at = [column.get(k) for k in batch.column(0).to_pylist()]
            h = scorer.entropies(batch.column(1).to_pylist())
            values = [None if c is None or math.isnan(h[i, c]) else float(h[i, c]) for i, c in enumerate(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=["lang", "text", "h"])

    return arrow_map(sample.select("lang", "text"), own, "lang string, text string, h double")


def limits(scored: DataFrame) -> dict[str, float]:
    return {r["lang"]: r["h"] + SLACK for r in scored.filter("h IS NOT NULL").groupBy("lang").agg(F.percentile("h", F.lit(QUANTILE)).alias("h")).collect()}  # a row per language


def within(scored: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """The rows whose entropy is below their label's limit, or that have none."""
    bounds = limits(scored) if bounds is None else bounds
    bound = F.create_map(*[F.lit(x) for item in bounds.items() for x in item])[F.col("lang")] if bounds else F.lit(None)
    return scored.filter(F.col("h").isNull() | bound.isNull() | (F.col("h") <= bound))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` (every column that does not clash) with the columns of PREDICTED."""
    spark = docs.sparkSession
    shared_folder(spark)
    shared = spark.sparkContext.broadcast(models)
    added = [c.split()[0] for c in PREDICTED.split(", ")]
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), PREDICTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                langs, scores, low, reject = scorer.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.float64()), pa.array(reject, pa.bool_())], names=[*names, *added])

    return arrow_map(docs, run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), models).drop("text", "rejected")
