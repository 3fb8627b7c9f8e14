"""Removal of repeated passages by suffix arrays, built with a difference cover, over the windows that can repeat.

A byte goes if a WINDOW-byte string that covers it also starts earlier (in a smaller doc_id, in an earlier row of the
same doc_id, or earlier in the same text).  Most windows of a corpus are unique, so they are set apart exactly before any suffix is sorted:

1. Every window has a minimiser: the smallest hash of its ANCHOR-byte substrings, the leftmost of equals.  Equal windows have
   equal minimisers.  Neighbouring windows with one minimiser form a run, about 40 windows.
2. Runs are shuffled by minimiser hash, packed in binary blocks, a task's own copies of a run already removed (they
   start later, so their windows repeat).  Runs with the same content: all but the earliest repeat, once step 3 has confirmed it.  Runs whose minimiser
   occurs in one content only are unique.  What is left is the runs that share a minimiser but not all of their bytes.
3. Contents are told apart by quick fingerprints, so the bytes of each run that repeats, and of the one that stays, are hashed once more, by
   BLAKE2 in 128 bits; should the runs of one fingerprint differ (no case is known), all windows under their minimiser are dealt out one by one, as
   below.  The bytes of the runs that are left are fetched, dealt out by minimiser again, and each task builds the suffix array of its
   runs with the difference cover modulo 3: sample suffixes are sorted by triples, named, the names recurse (until names are
   unique or cover the window), the other suffixes are merged in, and neighbours in the array that agree in their first
   WINDOW bytes are one string; all but its earliest start repeat.
   Texts are never shuffled: what is found of a row lies beside the table by blocks of rows, where the task that scans the row reads it.
   A minimiser with more than HOT different contents is dealt window by window instead, by the window's own fingerprint, so no
   task gets an unbounded group.

Windows dealt one by one are told apart by BLAKE2 in 128 bits.  Defined results: null text counts as empty; matches never cross documents, and a text
of fewer than WINDOW bytes loses nothing.  Rows are told apart by file
and row, so of rows with the same doc_id the one earlier there (by name of the file, then row) counts as earlier, and
repeated rows are removed but for one.  A null doc_id counts as the smallest.  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, free_name, keep, located, locator, shared_folder

WINDOW, ANCHOR = 100, 24
#: Different contents with one minimiser beyond which its windows are dealt out by their own fingerprints.
HOT = 4096
#: Buckets that minimisers are dealt to, for each partition of the input and at least, and bytes of runs whose suffixes are sorted together.
BUCKETS, LEAST, TOGETHER = 8, 256, 1 << 18
#: Bits of a row's number within its block: what is found of 2**BLOCK neighbouring rows lies in one folder.
BLOCK = 11
#: Bytes of text handled at once (small enough that the arrays stay in the processor's cache); documents of a slice.
CHUNK, SLICE = 1 << 18, 256
RUN = np.dtype([("hash", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("windows", "<i4")])
_FACTOR = 0x9E3779B97F4A7C15


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(factor), np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_FACTOR, CHUNK + 1), _powers(pow(_FACTOR, -1, 1 << 64), CHUNK + 1)
_LETTER = (np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LETTER2 = (np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Fingerprints of any stretch of at most CHUNK bytes."""

    def __init__(self, data: np.ndarray, letters: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * _UP[: len(data)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _DOWN[start])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each start, the place of the smallest of w values from there on, the leftmost of equals.

    The places stand in the low bits, which decide between equals; the hashes lose as many.
    """
    low = np.uint64(CHUNK - 1)
    best, span, n = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, len(h) - w + 1
    while span * 2 <= w:  # the minimum over 2**k values; two that overlap make w
        best = np.minimum(best[span:], best[:-span])
        span *= 2
    return (np.minimum(best[:n], best[w - span : w - span + n]) & low).astype(np.int64)


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(part.column(c).to_pylist() for c in ("doc", "row", "body")))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def beside(found: DataFrame, folder: str, name: str) -> None:
    """Write ``found`` (row and more columns) by blocks of rows, for the tasks that scan these rows (see Beside): texts need no shuffle to meet it."""
    blocks = found.withColumn("block", F.shiftright("row", BLOCK)).repartition("block").sortWithinPartitions("block", "row")
    blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("block").parquet(f"{folder}/{name}")


class Beside:
    """What ``beside`` wrote, for rows that come about in the order of their numbers; the last blocks are held."""

    HELD = 2

    def __init__(self, folder: str, name: str, *fields: str) -> None:
        self.path, self.fields = f"{folder}/{name}", fields
        self.held: dict[int, list[np.ndarray]] = {}

    def block(self, b: int) -> list[np.ndarray]:
        if b not in self.held:
            while len(self.held) >= self.HELD:
                del self.held[next(iter(self.held))]
            files, path = fs.FileSystem.from_uri(f"{self.path}/block={b}")
            parts = [f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
            columns = ["row", *self.fields]
            tables = [pq.read_table(x, columns=columns, filesystem=files, partitioning=None) for x in sorted(parts)]
            read = [np.concatenate([t[c].to_numpy() for t in tables] or [np.zeros(0, np.int64)]) for c in columns]
            order = np.argsort(read[0], kind="stable")
            self.held[b] = [v[order] for v in read]
        return self.held[b]

    def __call__(self, rows: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where the list of each of ``rows`` starts (and the last ends), and the fields of all elements."""
        rows = rows.to_numpy()
        owners, parts = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] * len(self.fields)]
        for b in np.unique(rows >> BLOCK).tolist():
            mine, (known, *fields) = np.flatnonzero(rows >> BLOCK == b), self.block(b)
            lo, hi = (np.searchsorted(known, rows[mine], side) for side in ("left", "right"))
            size = hi - lo
            at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
            owners.append(np.repeat(mine, size))
            parts.append([v[at] for v in fields])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.searchsorted(owner[order], np.arange(len(rows) + 1)), [np.concatenate(v)[order] for v in zip(*parts)]


def stretches(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """A text in pieces of at most CHUNK bytes that share no window."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(data) - WINDOW + 1), CHUNK - WINDOW + 1):
        yield at, data[at : at + CHUNK]


def copies(runs: np.ndarray) -> np.ndarray:
    """Whether an earlier run has the same content."""
    key = both(runs)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    some = order[np.append(same, False) | np.append(False, same)] if len(runs) else order
    part = runs[some]
    by = np.lexsort((part["start"], part["row"], part["doc"], part["content"], part["hash"]))
    part, again = part[by], np.zeros(len(runs), bool)
    again[some[by][1:]] = (part["hash"][1:] == part["hash"][:-1]) & (part["content"][1:] == part["content"][:-1])
    return again


def own_copies(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest run of each content, the others)."""
    again = copies(runs)
    return runs[~again], runs[again]


def pack_runs(runs: np.ndarray) -> bytes:
    """Runs field by field, numbers as differences and by bytes of one place, so that all but the hashes take little room."""
    small = b"".join(np.diff(runs[f], prepend=RUN[f].type(0)).view(np.uint8).reshape(-1, RUN[f].itemsize).T.tobytes() for f in RUN.names[2:])
    return runs["hash"].tobytes() + runs["content"].tobytes() + pa.compress(small, "zstd", asbytes=True)


def unpack_runs(block: bytes, n: int) -> np.ndarray:
    out, at = np.zeros(n, RUN), 0
    out["hash"], out["content"] = np.frombuffer(block, "<u8", 2 * n).reshape(2, n)
    small = np.frombuffer(pa.decompress(memoryview(block)[16 * n :], n * (RUN.itemsize - 16), "zstd", asbytes=True), np.uint8)
    for f in RUN.names[2:]:
        size = RUN[f].itemsize
        out[f] = np.cumsum(np.ascontiguousarray(small[at : at + size * n].reshape(size, n).T).view(RUN[f])[:, 0], dtype=RUN[f])
        at += size * n
    return out


def pack_buckets(runs: np.ndarray, gone: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of runs by bucket, and their sizes; runs that are known to repeat travel along, marked by bucket -1 - bucket."""
    keys, sizes, blocks = [], [], []
    for part, sign in ((runs, 0), (gone, 1)):
        bucket = (part["hash"] >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for block in np.split(part[order], cuts) if len(part) else []:
            b = int(block["hash"][0] >> np.uint64(40)) % buckets
            keys.append(-1 - b if sign else b)
            sizes.append(len(block))
            blocks.append(pack_runs(block))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "n", "runs"])


def find_runs(docs: DataFrame, buckets: int, most: int = 500_000) -> DataFrame:
    """bucket, n, runs: blocks of n RUN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0
        for group in gathered(documents(batches)):
            new = np.concatenate(group) if group else np.zeros(0, RUN)
            found.append(new)
            size += len(new)
            if size >= most:
                yield pack_buckets(*own_copies(np.concatenate(found)), buckets)
                found, size = [], 0
        if size:
            yield pack_buckets(*own_copies(np.concatenate(found)), buckets)

    return arrow_map(docs, run, "bucket int, n int, runs binary")


def gathered(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[list[np.ndarray]]:
    """RUN arrays: short texts are laid side by side, so that the arrays are long; windows across their borders are dropped."""
    ids, rows, parts, offsets, size = [], [], [], [], 0

    def flush() -> list[np.ndarray]:
        if not parts:
            return []
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < WINDOW:
            return []
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(parts)), length)[: len(data) - WINDOW + 1]
        whole = np.arange(len(owner)) + WINDOW <= (first + length)[owner]
        one, two = Rolling(data, _LETTER), Rolling(data, _LETTER2)
        places = np.arange(len(data) - ANCHOR + 1)
        h = one(places, places + ANCHOR)
        at = window_minima(h, WINDOW - ANCHOR + 1)
        edge = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1]))
        start = np.flatnonzero(edge)
        windows = np.diff(np.append(start, len(at)))
        good = whole[start]
        start, windows = start[good], windows[good]
        out = np.zeros(len(start), RUN)
        out["hash"], out["content"] = h[at[start]], two(start, start + windows + WINDOW - 1) ^ windows.astype(np.uint64)
        out["doc"] = np.array(ids, np.int64)[owner[start]]
        out["row"] = np.array(rows, np.int64)[owner[start]]
        out["start"] = start - first[owner[start]] + np.array(offsets, np.int64)[owner[start]]
        out["windows"] = windows
        return [out]

    for doc, row, text in docs:
        for offset, data in stretches(text):
            if size + len(data) > CHUNK:
                yield flush()
                ids, rows, parts, offsets, size = [], [], [], [], 0
            ids.append(doc)
            rows.append(row)
            parts.append(data.tobytes())
            offsets.append(offset)
            size += len(data)
    yield flush()


def sort_out(runs: np.ndarray, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs that repeat an earlier one, runs whose bytes must be compared, whether those are hot)."""
    first, again = own_copies(runs)
    first = first[np.argsort(first["hash"])]
    edge = np.flatnonzero(np.append(True, first["hash"][1:] != first["hash"][:-1])) if len(first) else np.zeros(0, np.int64)
    kinds = np.diff(np.append(edge, len(first)))
    kinds = np.repeat(kinds, kinds)
    open_ = kinds > 1
    return again, first[open_], kinds[open_] > hot


def rows_of(parts: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    kind = np.concatenate([np.full(len(r), k, np.int32) for r, k in parts])
    runs = np.concatenate([r for r, _ in parts])
    columns = [runs["doc"], runs["row"], runs["start"], runs["windows"], kind, runs["hash"].view(np.int64), runs["content"].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


FOUND = "doc long, row long, start int, windows int, kind int, hash long, content long"
REPEAT, COMPARE, ALONE, FIRST = range(4)
#: What runs meet by: the minimiser where bytes are compared, else minimiser and fingerprint.
KEY = f"if(kind in ({COMPARE}, {ALONE}), hash, xxhash64(hash, content))"


def both(runs: np.ndarray) -> np.ndarray:
    return mix(runs["hash"] ^ runs["content"] * np.uint64(_FACTOR))


def meet_runs(blocks: DataFrame, buckets: int, hot_from: int) -> DataFrame:
    """FOUND rows: what repeats, what stays of it (FIRST), and what must be compared by bytes (ALONE: window by window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        gone: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, n, block in zip(*(c.to_pylist() for c in batch.columns)):
                runs = unpack_runs(block, n)
                if bucket < 0:
                    gone.setdefault(-1 - bucket, []).append(np.unique(both(runs)))
                    yield rows_of([(runs, REPEAT)])
                else:
                    held.setdefault(bucket, []).append(runs)
        for bucket in sorted(held):
            runs = np.concatenate(held.pop(bucket))
            again, rest, hot = sort_out(runs, hot_from)
            first = runs[np.isin(both(runs), np.concatenate([both(again), *gone.pop(bucket, [])]))]
            yield rows_of([(again, REPEAT), (own_copies(first)[0], FIRST), (rest[~hot], COMPARE), (rest[hot], ALONE)])

    even = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return arrow_map(blocks.repartition(buckets, even), run, FOUND)


def suffix_order(text: np.ndarray, covers: int, enough: int = WINDOW) -> np.ndarray:
    """Ranks of the suffixes of ``text`` (small positive integers; 0 ends a string), by the difference cover modulo 3.

    Suffixes that agree over ``enough`` bytes may share a rank; a symbol stands for ``covers`` bytes.
    """
    n = len(text)
    t = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.int64)
    rests, ones, twos = (np.arange(i, n, 3) for i in range(3))
    sample = np.concatenate([ones, twos])
    names = name_triples(t[sample], t[sample + 1], t[sample + 2])
    if covers * 3 < enough and len(names) and names.max() < len(names):
        cut = (n + 1) // 3  # those of residue 1; a 0 ends their half
        names = np.delete(suffix_order(np.insert(names, cut, 0), covers * 3, enough), cut) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    base, symbols = int(rank.max()) + 1, int(t.max(initial=0)) + 1
    # a rest suffix against those of residue 1 by (symbol, rank of the next), of residue 2 by (symbol, next, rank after)
    pair = t[:-1] * symbols + t[1:] if symbols * symbols * base < 1 << 63 else name_pairs(t[:-1], t[1:])
    short, long = t[:-1] * base + rank[1:], pair[:-1] * base + rank[2:]
    own, below1, before1 = merged(short[rests], short[ones])
    _, below2, before2 = merged(long[rests], long[twos])
    # sample suffixes: those before them in the sample, and the rest suffixes that come before
    sizes = np.bincount(names) if len(names) else np.zeros(1, np.int64)
    out = np.zeros(n, np.int64)
    out[rests] = own + below1 + below2
    out[sample] = (np.cumsum(sizes) - sizes)[names] + np.concatenate([before1, before2])
    return out


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` are smaller than each of ``a``, and how many of ``a`` than each of ``b``; sought in order, so that neighbours lie close in memory."""
    by_a, by_b = np.argsort(a), np.argsort(b)
    a, b = a[by_a], b[by_b]
    out = []
    for among, sought, by in ((a, a, by_a), (b, a, by_a), (a, b, by_b)):
        count = np.empty(len(by), np.int64)
        count[by] = np.searchsorted(among, sought)
        out.append(count)
    return tuple(out)


def name_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, names = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
    return names


def name_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the triples in their order."""
    if not len(a):
        return np.zeros(0, np.int64)
    m = int(max(a.max(), b.max(), c.max())) + 1
    if m < 1 << 21:
        key = (a * m + b) * m + c
    else:
        key = name_pairs(name_pairs(a, b), c)
    _, names = np.unique(key, return_inverse=True)
    return names + 1


def compare_runs(doc: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every window of the runs that an earlier one repeats."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    first = np.cumsum(size) - size
    text = raw.astype(np.int64) + 1
    text[first + size - 1] = 0
    rank = suffix_order(text, 1)
    run = np.repeat(np.arange(len(texts)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[run] + inner
    order = np.argsort(rank[at])
    at, run, inner = at[order], run[order], inner[order]
    view = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
    same = np.zeros(len(at), bool)
    for lo in range(1, len(at), 1 << 16):
        hi = min(len(at), lo + (1 << 16))
        same[lo:hi] = (view[at[lo:hi]] == view[at[lo - 1 : hi - 1]]).all(axis=1)
    some = same | np.append(same[1:], False)  # windows that have an equal
    group, run, inner = np.cumsum(~same)[some], run[some], inner[some]
    d, r, s = doc[run], row[run], start[run] + inner
    by = np.lexsort((s, r, d, group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by][1:] == group[by][:-1]
    return r[by][later], s[by][later]


SPAN = "row long, start int, windows int"


def spans_of(row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows as one row."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(row[edge].astype(np.int64)), pa.array(start[edge].astype(np.int32)), pa.array(np.diff(np.append(edge, len(row))).astype(np.int32))], names=["row", "start", "windows"])


#: Digests of runs that a task remembers as sent.
SENT = 500_000


def compared(docs: DataFrame, found: DataFrame, buckets: int, folder: str, name: str) -> DataFrame:
    """SPAN rows of the windows that repeat among the runs that share a minimiser but not all bytes; and, with 0 windows and their
    KEY as row, of runs that share a fingerprint but not their digest."""
    beside(found.select("row", "start", "windows", "kind", F.expr(KEY).alias("key")), folder, f"wanted_{name}")
    schema = "bucket int, doc long, row long, start int, windows int, kind int, key long, body binary"
    names, types = [c.split()[0] for c in schema.split(", ")], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    digest = lambda data: hashlib.blake2b(data, digest_size=16).digest()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Beside(folder, f"wanted_{name}", "start", "windows", "kind", "key")
        sent: set[tuple] = set()
        for part in (part for batch in batches for part in slices(batch)):
            edge, (start, windows, kind, key) = wanted(part.column("row"))
            owner = np.repeat(np.arange(part.num_rows), np.diff(edge))
            bodies, docs_, rows_ = (part.column(c).to_pylist() for c in ("body", "doc", "row"))
            bucket = (key.view(np.uint64) >> np.uint64(40)).astype(np.int64) % buckets
            if len(sent) > SENT:
                sent.clear()
            out: list[tuple] = []
            for b, o, s, n, k, x in zip(*(v.tolist() for v in (bucket, owner, start, windows, kind, key))):
                if k == COMPARE:
                    out.append((b, docs_[o], rows_[o], s, n, k, x, bodies[o][s : s + n + WINDOW - 1]))
                elif k == ALONE:
                    for i in range(s, s + n):
                        own = digest(bodies[o][i : i + WINDOW])
                        out.append((int.from_bytes(own[:4], "little") % buckets, docs_[o], rows_[o], i, 1, k, 0, own))
                elif (told := (x, digest(bodies[o][s : s + n + WINDOW - 1]))) not in sent:
                    sent.add(told)
                    out.append((b, 0, 0, 0, 0, FIRST, *told))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        kind = rows["kind"].to_numpy()
        told = rows.filter(pa.array(kind == FIRST))
        if told.num_rows:
            x, key = told["key"].to_numpy(), digests_of(told)
            by = np.argsort(x)
            torn = (x[by][1:] == x[by][:-1]) & (key[by][1:] != key[by][:-1]).any(axis=1)
            torn = np.unique(x[by][1:][torn])
            yield pa.RecordBatch.from_arrays([pa.array(torn), *[pa.array(np.zeros(len(torn), np.int32))] * 2], names=["row", "start", "windows"])
        alone = rows.filter(pa.array(kind == ALONE))
        if alone.num_rows:
            key = digests_of(alone)
            d, r, s = (alone[c].to_numpy() for c in ("doc", "row", "start"))
            by = np.lexsort((s, r, d, key[:, 0], key[:, 1]))
            later = np.append(False, (key[by][1:] == key[by][:-1]).all(axis=1))
            yield spans_of(r[by][later], s[by][later])
        rest = rows.filter(pa.array(kind == COMPARE))
        if not rest.num_rows:
            return
        h = rest["key"].to_numpy()
        order = np.argsort(h, kind="stable")
        h = h[order]
        size = np.cumsum(rest["windows"].to_numpy()[order].astype(np.int64) + WINDOW)
        edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        lo = 0
        while lo < len(h):  # whole groups, about TOGETHER bytes at a time
            base = size[lo - 1] if lo else 0
            hi = int(edges[max(np.searchsorted(edges, np.searchsorted(size, base + TOGETHER), "right") - 1, np.searchsorted(edges, lo, "right"))])
            part = rest.take(pa.array(order[lo:hi]))
            yield spans_of(*compare_runs(part["doc"].to_numpy(), part["row"].to_numpy(), part["start"].to_numpy().astype(np.int64), part["windows"].to_numpy(), part["body"].to_pylist()))
            lo = hi

    pieces = arrow_map(docs.select("doc", "row", "body"), fetch, schema).repartition(buckets, "bucket").drop("bucket")
    out = keep(arrow_map(pieces, compare, SPAN), folder, name)
    discard(docs.sparkSession, folder, f"wanted_{name}")
    return out


def digests_of(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["body"].to_pylist()), "<u8").reshape(-1, 2)


def numbered(docs: DataFrame, name: str, folder: str) -> DataFrame:
    """``docs`` with a number for each row, by name of the file and row in it (see locator); 2**40 rows a file."""
    place, file = free_name(docs, "_at"), free_name(docs, "_file")
    docs = located(docs, folder)
    docs = docs.withColumn(place, locator()).withColumn(file, F.col(place)["file"])
    files = docs.select(file).distinct().coalesce(1).sortWithinPartitions(file)
    files = keep(files.withColumn(name, F.shiftleft(F.monotonically_increasing_id(), 40)), folder, "files")
    return docs.join(F.broadcast(files), file).withColumn(name, F.col(name) + F.col(place)["row"]).drop(place, file)


def removed(docs: DataFrame, name: str, folder: str, buckets: int | None, hot: int) -> DataFrame:
    """Documents: doc_id, doc (its order), row and body; the windows (start, count) that repeat lie beside them as ``spans``. ``name`` is the column of the row's number."""
    buckets = buckets or max(LEAST, BUCKETS * docs.select(F.spark_partition_id()).distinct().count())
    doc = F.col("doc_id").cast("long")
    docs = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-(1 << 63))).alias("doc"), F.col(name).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    found = keep(meet_runs(find_runs(docs.drop("doc_id"), buckets), buckets, hot), folder, "found")
    spans = compared(docs, found, buckets, folder, "compared")
    torn = spans.filter("windows = 0").select(F.col("row").alias("key"))
    repeats = found.filter(F.col("kind") == REPEAT)
    if not torn.isEmpty():  # one by one, whatever their fingerprints say
        torn = found.withColumn("key", F.expr(KEY)).join(torn, "key", "left_semi").select("hash").distinct()
        apart = found.join(torn, "hash", "left_semi").select("doc", "row", "start", "windows", F.lit(ALONE).alias("kind"), "hash", F.lit(0).cast("long").alias("content")).distinct()
        spans, repeats = spans.unionByName(compared(docs, apart, buckets, folder, "apart")), repeats.join(torn, "hash", "left_anti")
    beside(spans.filter("windows > 0").unionByName(repeats.select("row", "start", "windows")), folder, "spans")
    discard(docs.sparkSession, folder, "found", "compared", "apart")
    return docs


def cut_text(body: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[list[bytes], int, int]:
    """(the stretches that stay, bytes removed, maximal stretches removed) for windows that repeat."""
    if not len(start):
        return [body], 0, 0
    order = np.argsort(start, kind="stable")
    lo = start[order].astype(np.int64)
    hi = np.maximum.accumulate(lo + windows[order] + WINDOW - 1)
    first = np.append(True, lo[1:] > hi[:-1])
    lo, hi = lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(hi) - 1)]
    stay = [body[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(body)])]
    return stay, int((hi - lo).sum()), len(lo)


def dedup(docs: DataFrame, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, in order) of each document."""
    folder, row = shared_folder(docs.sparkSession), free_name(docs, "_row")
    bodies = removed(numbered(docs, row, folder), row, folder, buckets, hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Beside(folder, "spans", "start", "windows")
        for part in (part for batch in batches for part in slices(batch)):
            edge, (start, windows) = spans(part.column("row"))
            out = []
            for i, (doc_id, body) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist())):
                stay, gone, n = cut_text(body, start[edge[i] : edge[i + 1]], windows[edge[i] : edge[i + 1]])
                out.append((doc_id, len(body), gone, n, b"".join(stay)))
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_map(bodies.select("doc_id", "row", "body"), run, schema)


def strip(docs: DataFrame, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """``docs`` with all columns, repeated bytes cut from text; letters cut in half go too, n_chars (if there) is counted anew."""
    folder, row = shared_folder(docs.sparkSession), free_name(docs, "_row")
    rows = numbered(docs, row, folder)
    removed(rows, row, folder, buckets, hot)
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Beside(folder, "spans", "start", "windows")
        for batch in (part for whole in batches for part in slices(whole)):
            edge, (start, windows) = spans(batch.column(len(names)))
            texts = batch.column(at).to_pylist()
            for i in np.flatnonzero(np.diff(edge)).tolist():
                texts[i] = b"".join(cut_text(texts[i].encode(), start[edge[i] : edge[i + 1]], windows[edge[i] : edge[i + 1]])[0]).decode(errors="ignore")
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(rows.select(*names, row), run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
