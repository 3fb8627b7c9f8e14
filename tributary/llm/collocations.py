"""Phrase collocation mining by mergeable Misra-Gries summaries.

Texts are lower-cased (A-Z only), cut into pieces at break marks and these into words at blanks; everything is counted by language (null: ``und``).

A phrase is wanted if it occurs ``threshold`` times.  Words are counted exactly.  Then phrases are summarised: each task sums the phrases of its
texts by 64-bit hash, deals the counters to hash partitions and cuts each to its capacity as Misra and Gries do (the first counter beyond
it is subtracted from all, and what is subtracted is noted as error); a partition's summaries are merged and cut in the same way as they
stream in.  The capacity of all partitions together is SLACK times the mass of phrases divided by the threshold, and more.  A count is
never less than its counter and never more than counter and error, so every phrase with counter + error >= threshold survives, and if all
errors are below the threshold no frequent phrase is lost.  That is checked after each summary; with more capacity it would be made again.

Phrases of two words are summarised first, and those of more words only where all their words and word pairs have survived: a frequent phrase holds no
other.  Survivors are known by Bloom filters of bounded size (with very many survivors they pass more, never less).  The second pass
counts the survivors exactly, by language and the phrase itself, and drops those below the threshold; hashes decide nothing in the end.

Cutting a candidate after its first k words gives l, the count of the first part, r, that of the rest, and the score
floor(1000 * a * n / (l * r)) in decimals of 38 digits; the lowest score counts, ties to the smallest k.  Both parts are at least as
frequent, so they are among the words and candidates counted.  A candidate goes if a longer one that holds its words is as frequent; if so, one longer
by one word is.  Each language's first ``top`` are ranked by score, a (both falling) and the phrase in byte order.

Null and empty texts have no words, and a language without any word has no rows.  Rows that repeat count again.  Empty tables
give none; extra columns are ignored.  Very long texts are worked through in parts cut at break marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, discard, keep, shared_folder

#: Counters of a summary, at least; counters beyond mass / threshold, as a factor; counters of one row that is shuffled.
CAPACITY, SLACK, PACK = 1 << 18, 2.0, 4096
#: Bytes of text that are cut into words at once; phrases or distinct rows that a task holds before it hands them on.
TEXT_BYTES, HELD, ROWS = 8 << 20, 1 << 22, 1 << 19
#: Bits for each survivor of a Bloom filter and the most bits it is given.
BLOOM_BITS, BLOOM_MOST, BLOOM_HASHES = 12, 1 << 27, 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What a byte is: 0 part of a word, 1 blank, 2 break.
KINDS = bytes(1 if c in b"\x20\x09" else 2 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0 for c in range(256))
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
LONGEST = 5
U = np.uint64


class Words:
    """The words of some texts, in order: ids into the dictionary, the language's number, and which piece each is in."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = b"\n".join(texts).translate(LOWER)
        kinds = np.frombuffer(data.translate(KINDS), np.uint8)
        inside = np.zeros(len(kinds) + 2, np.int8)
        inside[1:-1] = kinds == 0
        edges = np.diff(inside)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        breaks = np.flatnonzero(kinds == 2)
        self.piece = np.searchsorted(breaks, start)
        letters = np.frombuffer(data, np.uint8)[kinds == 0]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.ids, self.known = column.indices.to_numpy().astype(np.int64), column.dictionary.to_pylist()
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
        self.lang = np.array([number[x] for x in langs], np.int64)[np.searchsorted(first, start, "right") - 1] if len(start) else np.zeros(0, np.int64)

    def counts(self) -> tuple[list[str], list[bytes], np.ndarray]:
        keys, n = np.unique(self.lang * len(self.known) + self.ids, return_counts=True)
        return [self.langs[k // len(self.known)] for k in keys.tolist()], [self.known[k % len(self.known)] for k in keys.tolist()], n

    def hashes(self) -> np.ndarray:
        """A hash of each word and its language, as Spark's xxhash64 of the two."""
        keys, place = np.unique(self.lang * max(1, len(self.known)) + self.ids, return_inverse=True)
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs]
        return np.array([xxhash.xxh64_intdigest(self.known[k % len(self.known)], seeds[k // len(self.known)]) for k in keys.tolist()], U)[place]

    def starts(self, size: int, good: np.ndarray) -> np.ndarray:
        """Where phrases of ``size`` words start, as far as ``good`` holds for each of them."""
        if len(self.ids) < size:
            return np.zeros(0, np.int64)
        n = len(self.ids) - size + 1
        return np.flatnonzero((self.piece[:n] == self.piece[size - 1 :]) & good[:n])


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    x = h * U(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def together(good: np.ndarray, size: int, span: int) -> np.ndarray:
    """Whether ``good`` (of spans of ``span`` words) holds for all spans inside ``size`` words; at ends as far as there are any."""
    out = good.copy()
    for j in range(1, size - span + 1):
        out[: max(0, len(good) - j)] &= good[j:]
    return out


class Filter:
    """A Bloom filter of 64-bit hashes, of bounded size, that Spark builds and tasks read."""

    def __init__(self, hashes: DataFrame) -> None:
        spark, n = hashes.sparkSession, hashes.count()
        self.bits = 1 << max(6, min(BLOOM_MOST, max(1, n * BLOOM_BITS)).bit_length())
        h = F.col(hashes.columns[0])
        bit = lambda i: (h.bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(i) * F.shiftrightunsigned(h, 33)).bitwiseAND(F.lit(self.bits - 1))
        ones = hashes.select(F.explode(F.array(*[bit(i) for i in range(BLOOM_HASHES)])).alias("b"))
        rows = ones.groupBy(F.shiftright("b", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int))) as w")).toArrow()  # of bounded size
        words = np.zeros(self.bits // 64, np.int64)
        words[rows["i"].to_numpy()] = rows["w"].to_numpy()
        self.words: Broadcast = spark.sparkContext.broadcast(words.view(U))

    def passes(self, h: np.ndarray) -> np.ndarray:
        words, out = self.words.value, np.ones(len(h), bool)
        low, step = h & U(0x7FFFFFFF), h >> U(33)
        for i in range(BLOOM_HASHES):
            b = (low + U(i) * step) & U(self.bits - 1)
            out &= (words[(b >> U(6)).astype(np.int64)] >> (b & U(63))) & U(1) == 1
        return out


def parts(text: bytes, most: int = TEXT_BYTES) -> Iterator[bytes]:
    """A text in parts cut at break marks, each of ``most`` bytes if its marks allow that."""
    while len(text) > most:
        at = max(text.rfind(c, 0, most) for c in (BREAKS[i : i + 1] for i in range(len(BREAKS))))
        if at < 0:
            at = min((p for c in BREAKS if (p := text.find(c, most)) >= 0), default=len(text))
        yield text[:at]
        text = text[at + 1 :]
    yield text


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """batches: text, lang."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in parts((text or "").encode()):
                if size + len(part) > TEXT_BYTES and texts:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append("und" if lang is None else lang)
                size += len(part) + 1
    if texts:
        yield Words(texts, langs)


def summed(tables: list[pa.Table], by: list[str]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(by).aggregate([("n", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*by, "n"])


def handed_on(tables: Iterator[pa.Table], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts, summed as far as ROWS distinct rows allow."""
    held: list[pa.Table] = []
    for t in tables:
        held.append(t)
        if sum(map(len, held)) >= ROWS:
            held = [summed(held, by)]
            if len(held[0]) >= ROWS // 2:
                yield from held.pop().to_batches(10_000)
    if held:
        yield from summed(held, by).to_batches(10_000)


def text_table(langs: list[str], phrases: list[bytes], n: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array([p.decode() for p in phrases], pa.string()), "n": pa.array(n, pa.int64())})


def count_words(texts: DataFrame) -> DataFrame:
    """lang, phrase, n: all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handed_on((text_table(*w.counts()) for w in read(batches)), ["lang", "phrase"])

    return arrow_map(texts, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def hashed(w: Words, sizes: range, good_words: Filter, good_pairs: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """size, starts and hashes of the phrases whose words (and word pairs) have survived."""
    h = w.hashes()
    word = good_words.passes(h)
    starts = w.starts(2, together(word, 2, 1))
    pairs = longer(h[starts], h[starts + 1])
    if 2 in sizes:
        yield 2, starts, pairs
    if sizes.stop > 3:
        good = np.zeros(len(h), bool)
        good[starts] = good_pairs.passes(pairs)
        for size in range(3, sizes.stop):
            starts = w.starts(size, together(good, size, 2))
            x = h[starts]
            for j in range(1, size):
                x = longer(x, h[starts + j])
            yield size, starts, x


class Summary:
    """Misra-Gries counters of hashes: ``n`` of each, and the error by which they can be too small."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.h, self.n, self.waiting = np.zeros(0, U), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray, n: np.ndarray, error: int = 0) -> None:
        self.waiting.append((h, n))
        self.error += error
        if sum(len(x) for x, _ in self.waiting) > 4 * self.capacity:
            self.merge()

    def merge(self) -> None:
        h, n = (np.concatenate(c) for c in zip((self.h, self.n), *self.waiting))
        self.waiting = []
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        self.h, self.n = h[first], np.add.reduceat(n, first) if len(h) else n
        if len(self.h) > self.capacity:
            cut = int(np.partition(self.n, len(self.n) - self.capacity - 1)[len(self.n) - self.capacity - 1])
            self.error += cut
            self.h, self.n = self.h[self.n > cut], self.n[self.n > cut] - cut


def summaries(texts: DataFrame, sizes: range, good_words: Filter, good_pairs: Filter | None, threshold: int, partitions: int, capacity: int) -> DataFrame:
    """h, error: hashes that can belong to frequent phrases, and of each partition the error (with a null h)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def deal() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            to = (h % U(partitions)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            h, n, to = h[order], n[order], to[order]
            edges = np.searchsorted(to, np.arange(partitions + 1))
            for p in np.unique(to).tolist():
                own = Summary(capacity)
                own.add(h[edges[p] : edges[p + 1]], n[edges[p] : edges[p + 1]])
                own.merge()
                for i in range(0, max(1, len(own.h)), PACK):
                    yield pa.RecordBatch.from_pydict({"p": [p], "h": [own.h[i : i + PACK].tobytes()], "n": [own.n[i : i + PACK].astype(np.int32).tobytes()], "error": [own.error if i == 0 else 0]}, pa.schema([("p", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("error", pa.int64())]))

        for w in read(batches):
            held += [x for _, _, x in hashed(w, sizes, good_words, good_pairs)]
            if sum(map(len, held)) >= HELD:
                yield from deal()
                held.clear()
        if held:
            yield from deal()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Summary] = {}
        for batch in batches:
            for p, h, n, error in zip(*(batch.column(c).to_pylist() for c in range(4))):
                own.setdefault(p, Summary(capacity)).add(np.frombuffer(h, U), np.frombuffer(n, np.int32).astype(np.int64), error)
        for s in own.values():
            s.merge()
            live = s.h[s.n + s.error >= threshold].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([None, *live.tolist()], pa.int64()), pa.array(np.full(len(live) + 1, s.error), pa.int64())], names=["h", "error"])

    dealt = arrow_map(texts, local, "p int, h binary, n binary, error long").repartition(max(1, min(partitions, 20_000)), "p")
    return arrow_map(dealt, merged, "h long, error long")


def survivors(texts: DataFrame, sizes: range, good_words: Filter, good_pairs: Filter | None, threshold: int, mass: int, folder: str, name: str, capacity: int) -> Filter:
    """A filter that every frequent phrase passes."""
    tasks, slack = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), SLACK
    while True:
        partitions = max(tasks, -(-int(slack * mass) // threshold // capacity))
        out = keep(summaries(texts, sizes, good_words, good_pairs, threshold, partitions, capacity), folder, name)
        if (out.agg(F.max("error")).first()[0] or 0) < threshold:
            found = Filter(out.filter("h IS NOT NULL").select("h"))
            discard(texts.sparkSession, folder, name)
            return found
        slack *= 2  # nothing may be lost: more partitions, so smaller errors


def count_phrases(texts: DataFrame, good_words: Filter, good_pairs: Filter, good_rest: Filter) -> DataFrame:
    """lang, phrase, n: exact counts of all phrases that pass the filters (and of some others)."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for w in read(batches):
            for size, starts, h in hashed(w, range(2, LONGEST + 1), good_words, good_pairs):
                starts = starts[(good_pairs if size == 2 else good_rest).passes(h)]
                if not len(starts):
                    continue
                key = w.lang[starts]
                for j in range(size):  # numbers of the same words in the same order, no hashes
                    key = np.unique(key * len(w.known) + w.ids[starts + j], return_inverse=True)[1]
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                at = starts[at]
                words = [[w.known[i] for i in w.ids[at + j].tolist()] for j in range(size)]
                yield text_table([w.langs[i] for i in w.lang[at].tolist()], list(map(b" ".join, zip(*words))), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handed_on(tables(batches), ["lang", "phrase"])

    return arrow_map(texts, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def first_words(words: str, k: str) -> str:
    return f"array_join(slice({words}, 1, {k}), ' ')"


def mine(docs: DataFrame, threshold: int = 100, top: int = 2000, capacity: int = CAPACITY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score.  docs: text, lang."""
    folder = shared_folder(docs.sparkSession)
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    words = keep(count_words(texts), folder, "all_words")
    totals = keep(words.groupBy("lang").agg(F.sum("n").alias("n")), folder, "totals")
    words = keep(words.filter(F.col("n") >= threshold), folder, "words")
    mass = totals.agg(F.sum("n")).first()[0] or 0
    good_words = Filter(words.select(F.xxhash64("lang", "phrase")))
    good_pairs = survivors(texts, range(2, 3), good_words, None, threshold, mass, folder, "pairs", capacity)
    good_rest = survivors(texts, range(3, LONGEST + 1), good_words, good_pairs, threshold, 3 * mass, folder, "rest", capacity)
    found = keep(count_phrases(texts, good_words, good_pairs, good_rest).filter(F.col("n") >= threshold), folder, "found")
    for f in (good_words, good_pairs, good_rest):
        f.words.unpersist()
    discard(docs.sparkSession, folder, "all_words")

    known = words.unionByName(found).select("lang", "phrase", F.col("n").alias("f"))
    split = found.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    cuts = split.select("lang", "phrase", F.col("n").alias("a"), "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(first_words("w", "k")).alias("left"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("right"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("c"))

    inside = split.filter("size > 2").select("lang", F.col("n").alias("longer"), F.explode(F.expr(f"array({first_words('w', 'size - 1')}, array_join(slice(w, 2, size - 1), ' '))")).alias("phrase"))
    held = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = scored.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = [F.desc("c.score"), F.desc("a"), "phrase"]
    # the first of each language by parts, so that a language with most phrases is not one task's
    dealt = stay.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    dealt = dealt.withColumn("i", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("i") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, COUNT(*) AS f FROM s, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(SUM(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 100),
x AS (SELECT c.*, unnest(range(1, size)) AS k FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM x JOIN g l ON l.lang = x.lang AND l.k = x.k AND l.phrase = array_to_string(w[1:x.k], ' ') JOIN g r ON r.lang = x.lang AND r.k = size - x.k AND r.phrase = array_to_string(w[x.k + 1:size], ' ') JOIN n ON n.lang = x.lang
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, x.k) = 1),
z AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = y.lang AND length(c.phrase) > length(y.phrase) AND contains(' ' || c.phrase || ' ', ' ' || y.phrase || ' ') AND 100 * c.a >= 100 * y.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000
"""
