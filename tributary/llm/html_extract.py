"""Main text of web pages, by differencing each page against the nearest url of its host.

A page is read into lines (one for each block of markup, character references decoded, white space reduced);
scripts, styles and controls give none.  All lines, those of an <article> or <main> element too, are compared with the
page's nearest neighbour: pages are ranked by host and path over the whole table, a run of pages of one host with
the same lines stands as one page, the neighbour is the page just before or after of the same host, whichever shares the
longer start of the path (ties: before), the two pages' lines are aligned by a longest common subsequence of line
hashes, and shared lines are deleted.  Inside an article a line is aligned together with the path of elements it stands in, and goes only if the pages on both sides
share it at such a place: a sentence that one other article has too is text.  A line that is the page's own title never goes.  A neighbour that is a near copy deletes nothing, for two copies would delete each other:
then the page on the other side is taken, and if that is a near copy too, or there is none, the page loses no line.
Near copies: of the lines that may be text by their markup, shared ones at the very start and end count as header and footer
(a quarter of these lines at each end, and one at least); of either page's other characters half or more are shared.
Of what is left, a check by markup takes what one page alone shows: lines of elements that name themselves navigation,
header, footer, sidebar, form, notice, advert or comments, and, where a page has an article, lines outside it.

Ranks come from a range-partitioned sort with summed partition sizes; the comparison runs in blocks of BLOCK
ranks with one row of margin on both sides, so a host with a third of all pages is spread over many tasks.

Defined results: null html gives an empty text; a null url has an empty host and is compared like any other; pages
without a neighbour lose no line; of pages with equal host and path the page_id decides the order.  Repeated rows are pages of
their own, with equal texts if they stand in one run.  Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, keep, probably_in, shared_folder
from .url_filter import host_of, path_of

BLOCK = 256
#: Of the number that stands for a line: whether the line may be text by its markup, is in an article, is the page's title; the rest is a hash.
FINE, INSIDE, TITLE, BITS = 1, 2, 4, 3
# Elements of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("script style noscript template button select option textarea input title head svg math canvas object iframe audio video map".split())
AROUND = set("form dialog nav header footer aside menu".split())
MAIN = set("article main".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|side-bar|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar)$", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")


def unwanted(tag: str, attributes: str) -> bool:
    """Whether an element names itself something other than text."""
    if tag in AROUND:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id") and NAMED.search(value) or name == "role" and ROLE.match(value.strip()) or name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


PLAIN, ARTICLE, UNWANTED, NO_TEXT = range(4)


def page_lines(source: str) -> tuple[list[str], list[int]]:
    """Lines of a page in order, and what each stands in: PLAIN, ARTICLE or UNWANTED markup."""
    return page_parts(source)[:2]


def reduced(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def page_parts(source: str) -> tuple[list[str], list[int], list[str], str]:
    """Lines, kinds, the path of elements of each line, and the page's title (empty if none)."""
    lines: list[str] = []
    kinds: list[int] = []
    paths: list[str] = []
    title = ""
    now: list[str] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]

    def flush() -> None:
        text = reduced("".join(now))
        now.clear()
        if text:
            lines.append(text)
            kinds.append(stack[-1][1])
            paths.append("/".join(t for t, _ in stack if t not in INLINE))

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at and stack[-1][1] != NO_TEXT:
            now.append(source[at:end])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and stack[-1][1] != NO_TEXT:
                now.append(m[0][9:-3])
            continue
        block = tag not in INLINE
        if m[1]:
            if block:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and (block or all(t in INLINE for t, _ in stack[depth:])):  # a stray inline end tag closes no block
                if stack[depth][1] != stack[depth - 1][1]:
                    flush()
                del stack[depth:]
            continue
        kind = stack[-1][1]
        inner = NO_TEXT if tag in NEVER or kind == NO_TEXT else UNWANTED if kind == UNWANTED or unwanted(tag, m[3]) else ARTICLE if tag in MAIN else kind
        if block or inner not in (kind, NO_TEXT):
            flush()
        if tag == "li" or tag in CLOSES_P:
            closes = "li" if tag == "li" else "p"
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == closes), 0)
            if depth and all(t in INLINE or t in ("p", "li") for t, _ in stack[depth:]):
                del stack[depth:]
                kind = stack[-1][1]
                inner = NO_TEXT if tag in NEVER or kind == NO_TEXT else UNWANTED if kind == UNWANTED or unwanted(tag, m[3]) else ARTICLE if tag in MAIN else kind
        if tag in VOID or m[3].endswith("/"):
            continue
        stack.append((tag, inner))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if close is None:
                break
            if inner != NO_TEXT:
                now.append(source[at : close.start()])
            if tag == "title" and not title:
                title = reduced(source[at : close.start()])
            at = close.end()
            stack.pop()
    flush()
    return lines, kinds, paths, title


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of a and b; among several, the last matches are taken first.

    Common starts and ends match at once; the rest goes by bit-parallel rows, halved (Hirschberg) when large.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [*range(lo), *range(len(a) - hi, len(a))]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(x) & set(y)
    keep_x = [i for i, v in enumerate(x) if v in both]
    y = [v for v in y if v in both]
    x = [x[i] for i in keep_x]
    if not x or not y:
        return ends
    if len(x) * len(y) > 1 << 28 and len(x) > 1:
        half = len(x) // 2
        down, up = prefix_lengths(x[:half], y), prefix_lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(down + up))
        found = [*common_lines(x[:half], y[:cut]), *(half + i for i in common_lines(x[half:], y[cut:]))]
    else:
        rows, mask = bit_rows(x, y)
        found, j = [], len(y)
        for i in range(len(x), 0, -1):
            below = (~rows[i - 1]) & ((1 << j) - 1)
            here = (~rows[i]) & ((1 << j) - 1)
            if here.bit_count() > below.bit_count():
                found.append(i - 1)
                m = mask[x[i - 1]] & ((1 << j) - 1)
                # the last match that reaches the length
                need = here.bit_count()
                while True:
                    p = m.bit_length() - 1
                    if (below & ((1 << p) - 1)).bit_count() == need - 1:
                        j = p
                        break
                    m ^= 1 << p
    return sorted(ends + [lo + keep_x[i] for i in found])


def bit_rows(x: list[int], y: list[int]) -> tuple[list[int], dict[int, int]]:
    """Row i has a zero at j where the subsequence of x[:i] and y[:j+1] is longer than that of y[:j]."""
    mask: dict[int, int] = {}
    for j, v in enumerate(y):
        mask[v] = mask.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for v in x:
        u = row & mask.get(v, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    return rows, mask


def prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """The length of the common subsequence of x and each start of y."""
    mask: dict[int, int] = {}
    for j, v in enumerate(y):
        mask[v] = mask.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        u = row & mask.get(v, 0)
        row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, body (the lines that may be text by their markup, packed), lines (a number for each line of the page, see FINE) and sizes (their lengths)."""
    schema = "page_id long, url string, body binary, lines array<long>, sizes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, sizes = [], [], []
            for source in batch.column(2).to_pylist():
                lines, kinds, paths, title = page_parts(source or "")
                wanted = ARTICLE if ARTICLE in kinds else PLAIN
                texts.append(zlib.compress("\n".join([s for s, k in zip(lines, kinds) if k == wanted]).encode("utf-8", "surrogatepass"), 6))  # a line holds no line break
                numbers.append([line_number(s, k == wanted, k == ARTICLE, s == title, p) for s, k, p in zip(lines, kinds, paths)])
                sizes.append(list(map(len, lines)))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(numbers, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "body", "lines", "sizes"])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, schema)


def line_number(line: str, fine: bool, inside: bool, title: bool, path: str) -> int:
    h = xxhash.xxh64_intdigest((f"{path}\n{line}" if inside else line).encode("utf-8", "surrogatepass")) >> BITS
    return (h << BITS | FINE * fine | INSIDE * inside | TITLE * title) - (1 << 63)


def flag(numbers: np.ndarray, bit: int) -> np.ndarray:
    return (numbers & bit).astype(bool)


def shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the sorted rows of a partition: the number of its run, whether it is the run's first row, and what its path shares with the one before (-1: another host)."""
    last, node = None, -1
    for batch in batches:
        nodes, heads, nears = [], [], []
        for host, path, digest in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "digest"))):
            head = last is None or (host, digest) != (last[0], last[2])
            node += head
            nodes.append(node)
            heads.append(head)
            nears.append(shared_start(path, last[1]) if head and last and host == last[0] else -1)
            last = host, path, digest
        first = pa.array([i if h else None for i, h in enumerate(heads)], pa.int64())
        lines, sizes = (batch.column(c).take(first) for c in ("lines", "sizes"))
        columns = [batch.column(c) for c in ("part", "i", "row", "host", "path", "digest")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(nodes, pa.int64()), pa.array(heads, pa.bool_()), pa.array(nears, pa.int32()), lines, sizes], names=[c.split()[0] for c in PLACED.split(", ")])


PLACED = "part int, i long, row long, host string, path string, digest long, node long, head boolean, near int, lines array<long>, sizes array<int>"


Lines = tuple[np.ndarray, np.ndarray]  # numbers and sizes


def mostly_shared(page: Lines, gone: np.ndarray) -> bool:
    """Whether half or more of a page's text, beyond its header and footer, is shared."""
    fine = flag(page[0], FINE)
    length, shared = page[1][fine], gone[fine]
    edge = max(1, len(shared) // 4)
    top = int(np.append(shared, False).argmin())  # shared lines that lead
    end = int(np.append(shared[top:][::-1], False).argmin())
    inner = slice(min(top, edge), len(shared) - min(end, edge))
    return len(shared) > 0 and 2 * int(length[inner][shared[inner]].sum()) >= int(length[inner].sum())


def compare_pair(a: Lines, b: Lines) -> tuple[np.ndarray, np.ndarray] | None:
    """Which lines of either page the other has; None for near copies."""
    x, y = (a[0] >> BITS).tolist(), (b[0] >> BITS).tolist()
    gone_a, gone_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
    gone_a[common_lines(x, y)] = True
    gone_b[common_lines(y, x)] = True
    return None if mostly_shared(a, gone_a) or mostly_shared(b, gone_b) else (gone_a, gone_b)


def compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Places, among the lines that may be text, of those that each page of the block (without its margin) loses to its neighbours."""
    rows = rows.sort_values("rank")
    block = int(rows["block"].iloc[0])
    rank, near = rows["rank"].tolist(), rows["near"].tolist()
    pages: list[Lines] = [(np.asarray(x, np.int64), np.asarray(n, np.int64)) for x, n in zip(rows["lines"], rows["sizes"])]
    pairs: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
    out = []
    for i, (numbers, _) in enumerate(pages):
        fine = flag(numbers, FINE)
        if rank[i] // BLOCK != block or not fine.any():
            continue
        sides = [(near[k], k < i + 1, k) for k in (i, i + 1) if 0 < k < len(pages) and rank[k] == rank[k - 1] + 1 and near[k] >= 0]  # k: a pair's second page
        for _, _, k in sides:
            if k not in pairs:
                pairs[k] = compare_pair(pages[k - 1], pages[k])
        shared = [pairs[k][before] for _, before, k in sorted(sides, reverse=True) if pairs[k] is not None]  # the nearest that is no near copy first
        if not shared:
            continue
        everywhere = shared[0] & shared[1] if len(shared) == 2 else np.zeros(len(numbers), bool)
        lost = np.where(flag(numbers, INSIDE), everywhere, shared[0]) & ~flag(numbers, TITLE)
        if (gone := np.flatnonzero(lost[fine]).tolist()):
            out.append((rank[i], gone))
    return pd.DataFrame({"rank": pd.Series([r for r, _ in out], dtype="int64"), "gone": pd.Series([g for _, g in out], dtype="object")})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (its lines joined by one space) and n_chars of each page."""
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    lined = keep(read_pages(pages).withColumn("row", F.monotonically_increasing_id()), folder, "lines")
    keys = lined.select("row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("lines").alias("digest"), "lines", "sizes")
    order = keys.repartitionByRange("host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row")
    order = order.withColumns({"part": F.spark_partition_id(), "i": F.expr("monotonically_increasing_id() & ((1L << 33) - 1)")})
    placed = keep(arrow_map(order, mark_runs, PLACED), folder, "placed")
    ends = F.struct("host", "path", "digest")
    parts = placed.groupBy("part").agg(F.max("node").alias("node"), F.min_by(ends, "i").alias("first"), F.max_by(ends, "i").alias("last"))
    start, joined, last, before = {}, {}, None, 0
    for r in parts.orderBy("part").collect():  # a row per partition
        same = last is not None and last["host"] == r["first"]["host"]
        again = same and last["digest"] == r["first"]["digest"]  # the run goes on from the partition before
        start[r["part"]] = before - again
        joined[r["part"]] = -2 if again else shared_start(r["first"]["path"], last["path"]) if same else -1
        before, last = start[r["part"]] + r["node"] + 1, r["last"]
    if start:
        by_part = lambda values: F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("part")]
        placed = placed.withColumns({"rank": F.col("node") + by_part(start).cast("long"), "near": F.when(F.col("i") == 0, by_part(joined)).otherwise(F.col("near"))})
        blocks = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("rank") + d) / BLOCK)))
        ranked = placed.filter("head and near >= -1").withColumn("block", F.explode(blocks)).select("block", "rank", "near", "lines", "sizes")
        gone = keep(ranked.groupBy("block").applyInPandas(compare_block, "rank long, gone array<int>"), folder, "gone")
        gone = keep(placed.select("row", "rank").join(gone, "rank").drop("rank"), folder, "cut")
        some = probably_in(F.col("row"), gone.select("row"), folder, "bloom")  # only these pages' lines are shuffled
        lined = lined.filter(some).join(gone, "row", "left").unionByName(lined.filter(~some).withColumn("gone", F.lit(None).cast("array<int>")))
        discard(spark, folder, "placed", "gone")
    else:
        lined = lined.withColumn("gone", F.lit(None).cast("array<int>"))
    return arrow_map(lined.select("page_id", "url", "body", "gone"), join_lines, "page_id long, url string, text string, n_chars long")


def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that are not gone, joined by one space."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = []
            for body, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines, gone = zlib.decompress(body).decode("utf-8", "surrogatepass").split("\n"), set(gone or ())
                texts.append(" ".join([s for i, s in enumerate(lines) if i not in gone]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
