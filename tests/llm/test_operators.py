"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import bpe_coding, common, exact_dedup, html_extract, jaccard_join, language_id, multi_index, packing, suffix_dedup, url_filter, warc
from tributary.llm.tokens import WordBpe

DOCS = "doc_id long, text string, lang string, digest string, start int, bucket int"
RNG = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi"]
LONG = " ".join(RNG.choice(WORDS) + str(RNG.randint(0, 99)) for _ in range(400))
TEXTS = [None, "", "  ", "Same Text", "same text", LONG, LONG, LONG[:900] + " changed " + LONG[900:], "x" * 300, "短い文 and é", "a" * 120_000, LONG[200:700]]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 2) for i, t in enumerate(texts)], DOCS)


def test_url_cascade_equals_the_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://b.example.com/de/1#f", "http://x.org/fr/", "http://net/", "http://net", "ftp://www.some.net/a", "http://x.org/frx", "http://x.org/fr/://y"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, extra string")
    rules = spark.sql("SELECT * FROM VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/') AS r(action, rule)")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][2:] == ("net/", "block") and got[7] == ("net", "", None, "allow")
    assert got[8][2:] == ("net/", "block") and got[9][2] is None
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {(None, "block")}


def test_url_cascade_of_a_long_list(spark, monkeypatch):
    rng = random.Random(3)
    hosts = [f"{a}{rng.randint(0, 400)}.{b}" for a in ("x", "y") for b in ("com", "net", "co.uk") for _ in range(60)]
    rules = {f"{h}{rng.choice(['/', '/a/', '/b/c'])}": rng.choice(["allow", "block"]) for h in hosts[:180]}
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/1', '/b/cd?x', '/b/'])}" for _ in range(400)] + ["http://x.com/a/"] * 3
    pages = spark.createDataFrame([(i, u, "h", "p", "r", 9) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, verdict int")
    table = spark.createDataFrame([(a, r) for r, a in rules.items()], "action string, rule string")
    levels, own = [], url_filter.Cascade.__init__
    monkeypatch.setattr(url_filter.Cascade, "__init__", lambda self, *a: (own(self, *a), levels.append(len(self.levels)))[0])
    got = url_filter.judge(pages, table, most_bytes=40)
    assert len(levels) >= 4 and max(levels) > 1 and got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]  # several shards, several levels
    for r in got.collect():
        rest = urls[r.page_id].split("://")[1].split("?")[0]
        host, path = rest.split("/")[0], rest[len(rest.split("/")[0]) :]
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        want = max(fits, key=lambda k: (len(k), len(k.split("/")[0])), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want, rules.get(want, "allow"))


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, None, None), (3, "http://a/\ny", "<p>é</p>"), (4, "u", ""), (5, "u", "z" * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, own string, at int, payload string")
    folder = common.shared_folder(spark)
    records = common.keep(warc.read(warc.write(pages, folder), folder), folder, "records")
    captures = warc.assemble(records)
    got = {r.page_id: r for r in warc.resolve(captures).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None)}
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), warc.base32_sha1(data))
    read = {r.page_id: r for r in captures.select("page_id", "uri", "response.payload", "response.refers_to").collect()}
    assert bytes(read[5].payload) == b"z" * 200_000 and read[2].uri is None and read[3].uri == "http://a/ y"
    ids = {r.record_id for r in records.filter("type = 'response'").collect()}
    assert {r.refers_to for r in read.values() if r.refers_to} <= ids and len(ids) == 3
    folder = common.shared_folder(spark)
    assert warc.write(pages.limit(0), folder).count() == 0


def test_warc_of_rows_with_one_page_id(spark):
    rows = [(1, "u", "A" * 5), (2, "u", "A" * 5), (2, "u", "B" * 7), (1, "u", "C" * 9), (3, "u", "C" * 9), (3, "u", "C" * 9), (1, "u", "A" * 5), (None, "u", "B" * 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least, want in (
        (0, [(0, 7, "response", None), (1, 5, "response", None), (1, 5, "revisit", 1), (1, 9, "response", None), (2, 5, "revisit", 1), (2, 7, "revisit", None), (3, 9, "revisit", 1), (3, 9, "revisit", 1)]),
        (6, [(0, 7, "response", None), (1, 5, "response", None), (1, 5, "response", None), (1, 9, "response", None), (2, 5, "response", None), (2, 7, "revisit", None), (3, 9, "revisit", 1), (3, 9, "revisit", 1)]),
    ):
        folder = common.shared_folder(spark)
        captures = warc.assemble(warc.read(warc.write(pages, folder, least), folder))
        got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve(captures).collect()), key=str)
        assert got == sorted(want, key=str)
        assert {bytes(r.p) for r in captures.select(F.col("response.payload").alias("p")).collect()} >= {b"A" * 5, b"B" * 7, b"C" * 9}


def plain_kneser_ney(words, alphabet=5000, discount=0.75, floor=1e-7):
    """Interpolated Kneser-Ney by dictionaries: the log probability of a word's letters and end mark."""
    order = language_id.ORDER
    grams = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        w = "^" + w + "$"
        for i in range(1, len(w)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[k][w[i - k + 1 : i + 1]] += n
    for k in range(1, order):
        before = Counter(g[1:] for g in grams[k + 1])
        grams[k] = Counter({g: before[g] or n for g, n in grams[k].items()})

    def p(gram):
        k = len(gram)
        if k == 1:
            total = sum(grams[1].values())
            return (grams[1][gram] - discount) / total + discount * len(grams[1]) / total / alphabet if gram in grams[1] else floor
        same = [n for g, n in grams[k].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(grams[k][gram] - discount, 0) / sum(same) + min(1, discount * len(same) / sum(same)) * p(gram[1:])

    return lambda w: sum(math.log(p(("^" + w + "$")[max(0, i - order + 1) : i + 1])) for i in range(1, len(w) + 2))


def test_language_models_equal_plain_kneser_ney():
    rng = random.Random(6)
    words = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)) for lang, letters in (("a", "abcde"), ("b", "cdefgh"))}
    models = language_id.Models(["a", "b"], {k: Counter({f"{language_id.START}{w}{language_id.STOP}": n for w, n in v.items()}) for k, v in words.items()})
    asked = [*list(words["a"])[:20], *list(words["b"])[:20], "zz", "abzcd", "x"]
    got = models.score(asked)
    for j, lang in enumerate("ab"):
        own = plain_kneser_ney(words[lang])
        for i, w in enumerate(asked):
            assert abs(got[i, j] - own(w)) < 1e-3 and got[i, -1] == len(w) + 1, (lang, w)


def test_language_id_of_odd_labels(spark):
    long = "漢字仮名交文" * 40  # a run of 240 letters
    rows = [(i, "the thing at hand is there", "en") for i in range(40)] + [(i, long[i % 6 :], "ja") for i in range(40, 80)] + [(80, "12 345 !", "digits"), (81, "", "none"), (82, None, "none"), (0, "the thing at hand is there", "en")]
    models = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.langs == ["en", "ja"]
    pieces = spark.createDataFrame([(w,) for w in ("x", long, "y" * 40, "z" * 41)], "w string").select(language_id.marked(F.col("w")).alias("p")).collect()
    for n in range(1, language_id.ORDER + 1):  # every n-gram counts once
        for w, r in zip(("x", long, "y" * 40, "z" * 41), pieces):
            codes, _, place = language_id.lay_out(r.p)
            whole, _, where = language_id.lay_out([f"{language_id.START}{w}{language_id.STOP}"])
            assert sorted(language_id.hashes(codes, n)[place >= max(1, n - 1)]) == sorted(language_id.hashes(whole, n)[where >= max(1, n - 1)])
    test = spark.createDataFrame([(1, long[::-1], 5), (1, "at the", 6), (1, "at the", 6)], "doc_id long, text string, score int")
    got = language_id.predict(test, models)
    assert [f.dataType.typeName() for f in got.schema.fields if f.name == "score"] == ["double"] and sorted(r.lang_pred for r in got.collect()) == ["en", "en", "ja"]


def test_language_id_learns_every_label(spark):
    rows = [(i, f"the thing number {'abcdefghij'[i % 10]} at hand is there", "en") for i in range(60)] + [(1, "das ist der eine deutsche satz hier", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for fitted in (language_id.fit(table), language_id.fit(table, drop_odd=True)):
        assert fitted.langs == ["de", "en"] and np.isinf(fitted.limits[0]) and np.isfinite(fitted.limits[1])
        got = {r.text: (r.lang_pred, r.score, r.rejected) for r in language_id.predict(spark.createDataFrame([(t,) for t in ("der eine satz ist hier", "is the thing there", None, "", "12 34 !")], "text string"), fitted).collect()}
        assert got["der eine satz ist hier"][0] == "de" and got["is the thing there"][0] == "en"
        assert [got[t] for t in (None, "", "12 34 !")] == [("und", 0.0, True)] * 3
    odd = spark.createDataFrame([*rows[:-1], (2, "zq" * 300, "en")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([("zq" * 200,)], "text string")
    assert [language_id.predict(asked, language_id.fit(odd, drop_odd=d)).first().rejected for d in (False, True)] == [False, True]
    many = [(i, "".join(chr(0x4E00 + 3 * k + j % 3) for j in range(12)) + " " + chr(0x4E00 + 3 * k) * 3, f"l{k:03d}") for i, k in enumerate(range(200))]
    models = language_id.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert len(models.langs) == 200


def test_packing_leaves_no_gap(spark):
    d = docs(spark)
    total = {r.doc_id: r.n_tokens + 1 for r in bpe_coding.digests(d).collect()}
    pieces = packing.pack(d).collect()
    own, windows = {}, {}
    for p in pieces:
        own.setdefault(p.doc_id, []).append((p.start, p.length))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts, end in [(v, total[k]) for k, v in own.items()] + [(v, None) for v in windows.values()]:
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == end if end else at <= packing.WINDOW
    assert set(own) == set(total) and packing.pack(d.limit(0)).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    where, offset = packing.best_fit_decreasing(lengths, 100)
    left = []
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [w for w, r in enumerate(left) if r >= lengths[i]]
        best = min((left[w] for w in fits), default=None)
        if best is None:
            left.append(100 - lengths[i])
        else:
            left[next(w for w in fits if left[w] == best)] -= lengths[i]
    assert len(left) == where.max() + 1 and sorted(left) == sorted(100 - sum(n for n, w in zip(lengths, where) if w == x) for x in range(len(left)))


def test_html_lines_and_common_lines():
    read = html_extract.page_lines
    assert read("<body><div class='menu'>A<p>B</div>T <b>x</b>y<p>one<p>two<ul><li>l1<li>l2</ul><aside>no</aside>end") == (["A", "B", "T xy", "one", "two", "l1", "l2", "no", "end"], [2, 2, 0, 0, 0, 0, 0, 2, 0])
    assert read("<article>unclosed <p>a &amp;<br>b<script>x='</p>'</script>") == (["unclosed", "a &", "b"], [1, 1, 1])
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 10))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, rest = html_extract.common_lines(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_html_differencing(spark):
    page = lambda body: f"<div>shared top</div><p>{body}</p><div>shared end</div>"
    rows = [(1, "http://h/a/1", page("one")), (2, "http://h/a/2", page("two")), (3, "http://solo/x", page("three")), (4, None, None), (5, "http://h/a/9", "<nav>n</nav><article>art</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, lines string, row int")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {1: "one", 2: "two", 3: "shared top three shared end", 4: "", 5: "art"}
    assert html_extract.extract(pages.limit(0)).count() == 0


def texts_of(spark, htmls):
    pages = spark.createDataFrame([(i, f"http://h/a/{i:03d}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(pages).orderBy("page_id").collect()]


def test_html_differencing_inside_articles(spark):
    page = lambda i: f"<nav>menu</nav><article><p>shared notice</p><p>body of page {i}, long enough</p><p>more of {i}</p></article>"
    body = lambda i: f"body of page {i}, long enough more of {i}"
    assert texts_of(spark, [page(1), page(2), page(3)]) == ["shared notice " + body(1), body(2), "shared notice " + body(3)]  # both sides must share it
    assert texts_of(spark, [page(1), page(1)]) == ["shared notice " + body(1)] * 2


def test_html_articles_keep_their_text(spark):
    """Planted truth: what stands in the pages' articles, although neighbours share much of it."""
    rng = random.Random(9)
    stock = [f"sentence {i} that articles of this host may share" for i in range(12)]
    htmls, want = [], []
    for i in range(60):
        title = "The same title" if i % 3 else f"Title {i}"
        body = [f"own words of page {i} part {j} " + "w" * 5000 * (i == 7) for j in range(4)]
        body.insert(rng.randint(0, 4), stock[i // 2 % 12])  # shared with one neighbour
        paragraphs = "".join(f"<p>{x.strip()}</p>" for x in body)
        htmls.append(f"<html><head><title>{title}</title></head><body><div>top of the site</div><article><h1>{title}</h1>{paragraphs}<div><small>All rights reserved by this site.</small></div></article><div>end of the site</div></body></html>")
        want.append(" ".join([title, *(x.strip() for x in body)]))
    got = texts_of(spark, htmls)
    assert got[1:-1] == want[1:-1]  # the notice that all share is gone, nothing else is
    assert [got[0], got[-1]] == [f"{want[0]} All rights reserved by this site.", f"{want[-1]} All rights reserved by this site."]


def shared_by_hand(a, b):
    """Whether each line of either page is shared; None for near copies.  Pages: (line, whether it may be text, what it is aligned by)."""
    x, y = [k for *_, k in a], [k for *_, k in b]
    out = []
    for page, own, other in ((a, x, y), (b, y, x)):
        gone = set(html_extract.common_lines([hash(s) for s in own], [hash(s) for s in other]))
        fine = [(i in gone, len(s)) for i, (s, f, _) in enumerate(page) if f]
        edge = max(1, len(fine) // 4)
        inner = list(fine)
        for _ in range(edge):
            if inner and inner[0][0]:
                inner.pop(0)
        rest = list(inner)
        for _ in range(edge):
            if rest and rest[-1][0]:
                rest.pop()
        if fine and 2 * sum(n for g, n in rest if g) >= sum(n for _, n in rest):
            return None
        out.append(gone)
    return out


def test_html_of_a_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(table).collect()}
    keyed = table.select("page_id", html_extract.host_of(F.col("url")).alias("host"), html_extract.path_of(F.col("url")).alias("path"), "html").collect()
    nodes: list[list] = []  # pages of one host with the same lines, side by side
    title_of: list[str] = []
    for r in sorted(keyed, key=lambda r: (r.host, r.path, r.page_id)):
        lines, kinds, paths, title = html_extract.page_parts(r.html or "")
        wanted = html_extract.ARTICLE if html_extract.ARTICLE in kinds else html_extract.PLAIN
        page = [(s, k == wanted, (s, p if k == html_extract.ARTICLE else None)) for s, k, p in zip(lines, kinds, paths)]
        if nodes and nodes[-1][0].host == r.host and nodes[-1][1] == page:
            nodes[-1][2].append(r)
            nodes[-1][3] = r.path
        else:
            nodes.append([r, page, [r], r.path])
            title_of.append(title)
    start = lambda a, b: len(os.path.commonprefix([a, b]))
    pairs = {}
    for i in range(1, len(nodes)):
        (_, a, _, last), (r, b, _, _) = nodes[i - 1], nodes[i]
        if nodes[i - 1][0].host == r.host:
            pairs[i] = start(r.path, last), shared_by_hand(a, b)
    touched = 0
    for i, (_, page, rows, _) in enumerate(nodes):
        shared = [pairs[k][1][1 if before else 0] for _, before, k in sorted([(pairs[k][0], k == i, k) for k in (i, i + 1) if k in pairs], reverse=True) if pairs[k][1] is not None]
        both = shared[0] & shared[1] if len(shared) == 2 else set()
        gone = {j for j, (s, _, (_, path)) in enumerate(page) if s != title_of[i] and shared and j in (shared[0] if path is None else both)}
        text = " ".join(s for j, (s, fine, _) in enumerate(page) if fine and j not in gone)
        for r in rows:
            assert got.pop(r.page_id) == (text, len(text)), r.page_id
    assert not got


def test_html_copies_keep_their_text(spark):
    page = lambda names: "<div>top</div>" + "".join(f"<p>paragraph {n} of the text</p>" for n in names) + "<div>end</div>"
    whole = lambda names: " ".join(["top", *(f"paragraph {n} of the text" for n in names), "end"])
    body = lambda names: " ".join(f"paragraph {n} of the text" for n in names)
    assert texts_of(spark, [page("abcdefgh")] * 40) == [whole("abcdefgh")] * 40  # only copies: no other page to compare with
    near = [[*"abcdefgh"[:4], f"{i}", *"efgh"] for i in range(20)]
    assert texts_of(spark, [page(n) for n in near]) == [whole(n) for n in near]
    assert texts_of(spark, [page("abcdefgh"), page("abcdqfgh"), page("uvwxyz")]) == [whole("abcdefgh"), body("abcdqfgh"), body("uvwxyz")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a run over several blocks and partitions
    try:
        assert texts_of(spark, [page("abcdefgh")] * 600 + [page("uvwxyz")]) == [body("abcdefgh")] * 600 + [body("uvwxyz")]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_jaccard_join(spark):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    got = {r.doc_id: r for r in jaccard_join.join(docs(spark)).collect()}
    first = {}
    for i, s in sets.items():
        if s is not None:
            first.setdefault(s, i)
    for i, s in sets.items():
        links = [j for o, j in first.items() if s and o != s and len(o & s) >= 0.8 * len(o | s)]
        assert (got[i].class_id, got[i].n_links) == (first[s] if s else i, len(links)), i
        assert got[i].group_id == min([first[s] if s else i, *links])
    assert jaccard_join.join(docs(spark).limit(0)).count() == 0


def near_texts():
    """Groups of edited copies, from nearly equal to just below the threshold."""
    rng, out = random.Random(12), []
    for edits in (1, 2, 4, 6, 8, 10, 12, 14):
        for _ in range(6):
            words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(150, 400))]
            for _ in range(4):
                copy = list(words)
                for _ in range(rng.randint(0, edits) if edits < 14 else edits):
                    copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**9)}"
                out.append(" ".join(copy))
    return out


def links_by_hand(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (re.findall(r"\w+", t.lower()) for t in texts)]
    return sets, [{j for j, b in enumerate(sets) if b != a and len(a & b) >= 0.8 * len(a | b)} for a in sets]


@pytest.mark.parametrize(("unit", "most"), [("BLOCK", 3), ("WEIGHT", 700)])
def test_jaccard_join_finds_all_links(spark, monkeypatch, unit, most):
    texts = near_texts()
    sets, want = links_by_hand(texts)
    monkeypatch.setattr(jaccard_join, unit, most)  # components and nodes in many blocks, by classes or by shingles
    deep = []
    own = jaccard_join.links_at
    monkeypatch.setattr(jaccard_join, "links_at", lambda d, c, depth, *a: deep.append(depth) or own(d, c, depth, *a))
    got = {r.doc_id: r for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert deep[0] == jaccard_join.DEPTH and len(deep) > 1 and deep == sorted(set(deep), reverse=True)
    found, there = sum(r.n_links for r in got.values()), sum(len({sets[j] for j in w}) for w in want)
    assert there > 250 and found >= 0.995 * there and all(got[i].n_links <= len({sets[j] for j in w}) for i, w in enumerate(want))
    assert sum(got[i].n_links != len({sets[j] for j in w}) for i, w in enumerate(want)) <= 2


def test_forest_depth_follows_the_links():
    assert jaccard_join.next_depth({}, 8) == jaccard_join.depth_for() == 4  # nothing found proves nothing
    assert jaccard_join.next_depth({0.99: 1_000_000}, 8) == 8
    assert jaccard_join.next_depth({0.8: 1_000_000}, 8) == 4
    assert 4 < jaccard_join.next_depth({0.85: 100_000}, 8) < 8
    assert jaccard_join.next_depth({0.8: 1_000_000}, 4) == 4


def test_jaccard_join_of_rows_with_one_doc_id(spark):
    words = [f"w{i}" for i in range(300)]
    near = [" ".join([*words[:k], f"e{k}", *words[k + 1 :]]) for k in (50, 200)]
    other = " ".join(f"o{i}" for i in range(300))
    rows = [(1, " ".join(words)), (2, near[0]), (2, other), (None, near[1]), (None, other + " x"), (2, near[0]), (3, None), (3, "")]
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, id int, root string")
    got = sorted((r.doc_id or 0, r.n_links, r.class_size, r.group_id or 0) for r in jaccard_join.join(table).collect())
    assert got == sorted([(1, 2, 1, 1), (2, 2, 2, 1), (2, 2, 2, 1), (2, 1, 1, 2), (0, 2, 1, 1), (0, 1, 1, 2), (3, 0, 1, 3), (3, 0, 1, 3)])
    stay = jaccard_join.survivors(table)
    assert stay.columns == table.columns and sorted((r.doc_id or 0, r.text or "") for r in stay.collect()) == sorted([(0, near[1]), (0, other + " x"), (3, ""), (3, "")])


def test_exact_dedup_of_odd_identifiers(spark):
    rows = [(None, "A b"), (5, "a B"), (None, "x"), (None, "X"), (5, "a b"), (7, None), (None, "")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, at int")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.dedup(table).collect())
    assert [(g[2], g[1]) for g in got] == [(2, 0), (2, 0), (3, 5), (2, 7), (3, 5), (3, 5), (2, 7)] and sum(g[3] for g in got) == 3
    stay = exact_dedup.survivors(table)
    assert stay.columns == table.columns and sorted((r.text or "").lower() for r in stay.collect()) == ["", "a b", "x"]


def test_exact_dedup_with_a_weak_digest(spark):
    d = docs(spark).unionByName(docs(spark, TEXTS[:1]))  # a repeated row
    weak = exact_dedup.dedup(d.repartition(3), digest=lambda c: F.substring(F.sha2(c, 256), 1, 1), max_files_per_trigger=1)
    want = exact_dedup.dedup(d)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    rows = sorted(map(tuple, want.select(columns).collect()))
    assert sorted(map(tuple, weak.select(columns).collect())) == rows
    assert [r for r in rows if r[0] in (3, 4)] == [(3, 4, 2, False), (4, 4, 2, True)] and sum(r[3] for r in rows) == len({(t or "").lower() for t in TEXTS})
    assert exact_dedup.dedup(d.limit(0)).count() == 0


def test_multi_index_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=8).tolist() for _ in range(120)] + [None, [0.0] * 8, [float("nan")] * 8, [1.0] * 7, [1.0] * 7 + [None]] + [[1.0] * 8] * 30
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    got = {}
    for r in multi_index.search(table, F.col("vec_id") % 20 == 0, k=20, recall=1.0, probes=10_000).collect():  # every vector tells how far to walk
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v) for i, v, _ in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q), key=lambda x: (round(x[0], 9), x[1]))[:20]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
    assert multi_index.search(table.limit(0), F.lit(True)).count() == 0


def test_multi_index_recall_of_a_partial_walk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 16)) * 2
    vectors = np.concatenate([centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.5, rng.normal(size=(3000, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(40, vectors[40].tolist())], "vec_id long, embedding array<double>")  # a repeated row
    walks, own = [], multi_index.Index.need
    monkeypatch.setattr(multi_index.Index, "need", lambda self, *a: walks.append(own(self, *a)) or walks[-1])
    found = {}
    for r in multi_index.search(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert walks[0] < 0.7 * len(vectors) and set(found) == set(range(0, 6000, 20)) and len(found[40]) == 40
    hit = 0
    for q, rows in found.items():
        scores = vectors @ vectors[q]
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in rows) and [r for r, _, _ in sorted(rows)][:1] == [1]
        scores[q] = -np.inf
        hit += len({i for _, i, _ in rows} & set(np.argsort(-scores)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(found)


def test_multi_index_of_single_numbers(spark):
    table = spark.createDataFrame([(i, [float(i - 5)]) for i in range(12)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in multi_index.search(table, F.col("vec_id") == 0, k=3, recall=1.0, probes=100).collect()}
    assert got == {(0, 1): (1, 20.0), (0, 2): (2, 15.0), (0, 3): (3, 10.0)}


def test_bpe_equals_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = common.tokenizer_file()
    exact, own, rng = tokenizers.Tokenizer.from_file(path), WordBpe(path), random.Random(3)
    for _ in range(3000):
        letters = rng.choice(["ab", "rl", "aeiou", "the quick!?'s", "ñéüß 漢字👍", "123 a.,", "Σσ İı \x1c\x85 <|endoftext|>"])
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "<|startoftext|>x"])
        [chunks] = own.encode([s])
        assert np.frombuffer(b"".join(own.table[c] for c in chunks), "<u4").tolist() == exact.encode(s, add_special_tokens=False).ids, s
    for r in bpe_coding.digests(docs(spark)).collect():
        ids = exact.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(exact.decode(ids, skip_special_tokens=False)))


def removed_by_hand(texts, width=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = True
            seen.add(w)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_suffix_dedup(spark):
    texts = TEXTS + ["é" * 130 + LONG[300:420] + "é" * 130]
    want = removed_by_hand(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs(spark, texts), buckets=8).collect()}
    assert got == want
    assert suffix_dedup.dedup(docs(spark).limit(0), buckets=4).count() == 0
    assert set(suffix_dedup.strip(docs(spark, texts), buckets=4).columns) == set(docs(spark).columns)


def test_suffix_dedup_of_crowded_minimisers(spark):
    rng = random.Random(8)
    core = LONG[:130]
    texts = [f"{rng.randint(0, 10**12)} {core}{rng.randint(0, 10**12)}" + "ab" * rng.randint(40, 90) for _ in range(40)]
    want = removed_by_hand(texts)
    for hot in (3, 4096):  # beyond 3 contents a minimiser's windows are dealt one by one
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs(spark, texts), buckets=4, hot=hot).collect()}
        assert got == want


def test_suffix_dedup_with_a_weak_fingerprint(spark, monkeypatch):
    """Runs of one fingerprint and different bytes keep what they do not share."""
    own = suffix_dedup.gathered

    def weak(rows):
        for group in own(rows):
            for runs in group:
                runs["content"] = runs["windows"] % 2
            yield group

    monkeypatch.setattr(suffix_dedup, "gathered", weak)
    texts = [LONG[:700], LONG[300:1000], "v" * 250, LONG[:700], LONG[650:] + "v" * 120]
    found = suffix_dedup.own_copies(next(weak([(i, i, t.encode()) for i, t in enumerate(texts)]))[0])
    assert len(found[1])
    want = removed_by_hand(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs(spark, texts), buckets=4).collect()}
    assert got == want


def test_suffix_dedup_of_rows_with_one_doc_id(spark, tmp_path):
    other = " ".join(RNG.choice(WORDS) + str(RNG.randint(100, 999)) for _ in range(60))
    texts = [LONG, LONG, other, other[200:] + LONG[:150], "tail " + LONG[300:600], "short", "short"]  # the first row is repeated
    ids = [1, 1, 1, 2, 2, None, None]
    spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    want = sorted(((i is not None, i or 0, *w) for i, w in zip(ids, removed_by_hand(texts).values())))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(table, buckets=4).collect())
    assert got == want
    assert sorted(r.text for r in suffix_dedup.strip(table, buckets=4).collect()) == sorted(w[3].decode() for w in removed_by_hand(texts).values())


def test_suffix_dedup_shuffles_no_text(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what repeats were too large to broadcast
    try:
        for f in (suffix_dedup.dedup, suffix_dedup.strip):
            plan = f(spark.read.parquet(str(tmp_path / "d")), buckets=4)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


def test_lists_beside_the_rows_of_a_scan(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1)
    rng, file = random.Random(4), 1 << 40
    lists = {r: [(rng.randint(0, 99), rng.randint(1, 9)) for _ in range(rng.randint(0, 3))] for r in [*range(9), *range(file, file + 5)]}
    folder = common.shared_folder(spark)
    suffix_dedup.beside(spark.createDataFrame([(r, *x) for r, own in lists.items() for x in own], "row long, start int, windows int"), folder, "some")
    read = suffix_dedup.Beside(folder, "some", "start", "windows")
    for rows in ([*lists], [5, 0, 8, file + 3, 2], [7, 8, 500, file], [500], []):  # in order, in none, with blocks that nobody wrote
        edge, (start, windows) = read(pa.array(rows, pa.int64()))
        assert [sorted(zip(start[a:b].tolist(), windows[a:b].tolist())) for a, b in zip(edge, edge[1:])] == [sorted(lists.get(r, [])) for r in rows]


def test_packed_runs():
    rng = np.random.default_rng(5)
    runs = np.zeros(3000, suffix_dedup.RUN)
    runs["hash"], runs["content"] = rng.integers(0, 1 << 63, (2, 3000), dtype=np.uint64) * np.uint64(2)
    runs["doc"], runs["row"] = np.sort(rng.integers(-(1 << 62), 1 << 62, 3000)), np.sort(rng.integers(0, 5 << 40, 3000))
    runs["doc"][:3], runs["doc"][-3:] = -(1 << 63), (1 << 63) - 1
    runs["start"], runs["windows"] = rng.integers(0, 1 << 31, 3000), rng.integers(1, 78, 3000)
    for part in (runs, runs[:1], runs[:0]):
        assert (suffix_dedup.unpack_runs(suffix_dedup.pack_runs(part), len(part)) == part).all()
    near = runs.copy()
    near["doc"], near["row"], near["start"] = np.arange(3000) // 7 + 10**9, np.arange(3000) // 7, np.arange(3000) * 40 % 3400
    assert len(suffix_dedup.pack_runs(near)) < 0.6 * near.nbytes


def test_earliest_runs():
    rng = np.random.default_rng(6)
    runs = np.zeros(400, suffix_dedup.RUN)
    for f, most in (("hash", 9), ("content", 5), ("doc", 20), ("row", 3), ("start", 9)):
        runs[f] = rng.integers(0, most, 400)
    runs["start"] += np.arange(400, dtype=np.int32) * 10  # no two are the same
    first, again = suffix_dedup.own_copies(runs)
    least = {}
    for r in runs.tolist():
        least[r[:2]] = min(r, least.get(r[:2], r), key=lambda x: x[2:5])
    assert sorted(first.tolist()) == sorted(least.values()) and len(first) + len(again) == 400


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(200):
        t = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))])
        rank = suffix_dedup.suffix_order(t, 1, 1 << 30)
        padded = [[*t[i:], *[0] * (i + 3)] for i in range(len(t))]
        order = np.argsort(rank, kind="stable")
        assert all(padded[a] <= padded[b] for a, b in zip(order, order[1:]))


def test_warc_of_a_whole_table_against_brute_force(spark):
    path = f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}"
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    first = {}
    for page_id, data in pages:
        first[data] = min(page_id, first.get(data, page_id))
    want = [(i, len(data), warc.base32_sha1(data), "response" if first[data] == i else "revisit", None if first[data] == i else first[data]) for i, data in pages]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_warc(spark, path).collect()]
    assert sorted(got) == sorted(want)


def test_packed_ids_equal_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    exact = tokenizers.Tokenizer.from_file(common.tokenizer_file())
    texts = [*TEXTS, TEXTS[5], TEXTS[5]]
    table = spark.createDataFrame([(i, t, 7, 9) for i, t in enumerate(texts)], "doc_id long, text string, length int, ids_crc32 int").coalesce(1)
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}
    pieces = packing.pack(table).collect()
    for p in pieces:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert (p.length, p.ids_crc32, p.doc_tokens) == (len(part), zlib.crc32(part.tobytes()), len(ids[p.doc_id]))
    filled, windows = sum(p.length for p in pieces), len({p.sequence_id for p in pieces})
    assert filled == sum(map(len, ids.values())) and windows <= -(-filled // packing.WINDOW) + 1  # one task: little padding


def test_bpe_of_repeated_rows_and_none(spark):
    table = spark.createDataFrame([(1, "Same text", 3, "x"), (1, "Same text", 3, "x"), (None, None, 4, "y")], "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe_coding.digests(table).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 3 and got.count((None, 0, empty)) == 1 and len({x for x in got if x[0] == 1}) == 1
    assert bpe_coding.digests(table.limit(0)).count() == 0


def test_language_id_predictions_against_plain_kneser_ney(spark):
    rng = random.Random(9)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(8))
    rows = [(i, text("abcde" if i % 2 else "cdefg"), "xy"[i % 2]) for i in range(60)]
    asked = [text("abcde"), text("cdefg"), text("cde"), "AbC 12 gf!", "zzz"]
    models = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = {k: plain_kneser_ney(Counter(w for _, t, lang in rows if lang == k for w in t.split())) for k in "xy"}
    got = {r.text: r for r in language_id.predict(spark.createDataFrame([(t,) for t in asked], "text string"), models).collect()}
    for t in asked:
        words = language_id.WORD.findall(t.lower())
        h = {k: -sum(map(p, words)) / sum(len(w) + 1 for w in words) for k, p in own.items()}
        best = min(sorted(h), key=h.get)
        score = 1 / sum(math.exp((h[best] - v) * language_id.SHARP) for v in h.values())
        assert got[t].lang_pred == best and abs(got[t].cross_entropy - h[best]) < 1e-3 and abs(got[t].score - score) < 1e-2, t


def test_language_id_of_a_whole_table(spark):
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    known = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = language_id.op3_language_id(spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(known) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    learned = {lang for i, (t, lang) in known.items() if lang and t and zlib.crc32(str(i).encode()) % 4 != 2}
    assert {r.lang_pred for r in got} <= learned | {"und"}
    held = [(r.lang_pred, known[r.doc_id][1]) for r in got if r.held_out and known[r.doc_id][1] in learned and re.search(r"[^\W\d_]", known[r.doc_id][0] or "")]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) > 0
