"""Resampling, collocations and pages, against brute force and hand-made cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pytest

from lumenvec.llm import collocations, cqf, html, licenses, mixing, radix, resample, secret_scan

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, text string, lang string, n_words string, place string, `a.b` string"


def odd(rows):
    return [(*r, "clash", "clash", "clash") for r in rows]


# ---- 11


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_resampling_against_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "ü-mlaut", "gamma9", "日本", "x" * 70, "d,e"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60))), "en") for i in range(300)]
    rows += [(400, None, None), (401, "", "en"), (402, "word " * 40000, "en"), (403, "y" * 300_000, "en"), (404, "a b c " * 10, "en"), (404, "a b c " * 10, "en"), (None, "null id " * 20, "en")]
    docs = spark.createDataFrame(odd(rows), ODD).repartition(5)
    target = spark.createDataFrame([("alpha gamma9 alpha",), (None,), ("日本 alpha",)], "text string")
    got = [tuple(r) for r in resample.resample(docs, target).collect()]
    made = [(i, *features(t)) for i, t, _ in rows]
    s, t = Counter(x for *_, f in made for x in f), Counter(x for y in ("alpha gamma9 alpha", "日本 alpha") for x in features(y)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    want = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in want if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = k + 1
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[:5])) for r in want)
    none = docs.limit(0)
    assert resample.resample(none, target).collect() == [] and resample.resample(docs.limit(3), target.limit(0)).count() == 3


def test_crc_in_step_and_alone():
    texts = ["a " + "b" * 47 + " " + "c" * 48 + " " + "d" * 49 + " " + "e" * 5000 + " é", "", None, "A"]
    ((lo, hi, n, runs),) = resample.features(pa.array(texts))
    want = [features(t) for t in texts]
    assert (lo, hi) == (0, 4) and n.tolist() == [w[0] for w in want]
    for row in range(4):
        assert [int(b) for buckets, of in runs for b in buckets[of == row]] == want[row][1]


@pytest.mark.parametrize("low,high", [(-5, 5), (-(1 << 62), (1 << 62)), (7, 7), (0, (1 << 40))])
def test_ranks_by_radix(spark, monkeypatch, low, high):
    monkeypatch.setattr(radix, "LEAST_BLOCK", 37)
    rng = random.Random(low)
    rows = [(rng.randint(low, high), rng.randrange(3), k) for k in range(500)]
    got = radix.ranked(spark.createDataFrame(rows, "a long, b long, id long").repartition(3), [("a", True), ("b", False)]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (-x[0], x[1]))


# ---- 12


@pytest.mark.parametrize("n,width,bits", [(2, 1, 1), (2, 15, 3), (3, 15, 7), (3, 31, 20), (4, 31, 31), (4, 12, 1), (2, 20, 20)])
def test_filters_lose_nothing(n, width, bits):
    p, rng = cqf.Packing(n, width, bits), np.random.default_rng(n * width)
    ids = [rng.integers(1, 1 << width, 3000) for _ in range(n)]
    for x in ids:
        x[:900] = x[0]  # one that counts over 255
    want = Counter(zip(*[x.tolist() for x in ids]))
    halves = np.array_split(np.arange(3000), 3)
    by_bucket = defaultdict(list)
    for part in halves:
        for bucket, size, raw in cqf.filters(p, [x[part] for x in ids]):
            by_bucket[bucket].append(raw)
            assert len(cqf.decode(p, bucket, raw)[0]) == size
    got = Counter()
    for bucket, raws in by_bucket.items():
        left, right, counts = cqf.merged(p, bucket, raws)
        again = cqf.decode(p, bucket, cqf.encode(p, left, right, counts))
        assert all((a == b).all() for a, b in zip(again, (left, right, counts)))
        got.update(dict(zip(zip(*[x.tolist() for x in p.unpack(*p.restored(left, right))]), counts.tolist())))
        few = cqf.merged(p, bucket, raws, 2)
        assert (cqf.within(p, left, right, *few[:2]) == (counts >= 2)).all()
    assert got == want


def brute_collocations(rows, least, covered, first):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    may = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, g), a in may.items():
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        if not any(other == lang and len(x) > len(g) and any(x[i : i + len(g)] == g for i in range(len(x))) and 100 * b >= covered * a for (other, x), b in may.items()):
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1))


@pytest.mark.parametrize("least,first,shards,held", [(4, 2000, 2048, 1 << 20), (7, 5, 2, -1)])
def test_collocations_against_brute_force(spark, monkeypatch, least, first, shards, held):
    monkeypatch.setattr(collocations, "MERGED_SHARDS", shards)
    monkeypatch.setattr(collocations, "HELD_BYTES", held)
    rng = random.Random(least)
    words = ["new", "York", "city", "of", "the", "état", "日本", "a.b", "x" * 3000]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice([". ", "\n", "\t", "!?"]) + "New york City of the", rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(500, None, "en"), (501, "", None), (502, "very long text , " * 20000, "fr"), (503, "same row twice again", "es"), (503, "same row twice again", "es"), (None, "new york " * 9, "en"), (504, " ..,, \n", "pt")]
    docs = spark.createDataFrame(odd(rows), ODD).repartition(6)
    got = sorted(map(tuple, collocations.collocations(docs, least, 80, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute_collocations(rows, least, 80, first)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], ODD)
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame(odd([(1, None, None), (2, " ", "en")]), ODD)).collect() == []


# ---- 13


def texts(*pages):
    w = html.Wrapper()
    for p in pages:
        w.add(p)
    plan = html.Plan(html.Wrapper.loads(w.dumps()).plan())
    return [plan.extract(p) for p in pages]


def test_alignment():
    a, b = html.folded(["h1", "p", "p", "ul"]), html.folded(["h1", "img", "p", "ul", "p"])
    assert a == [[["h1"], 1, 0], [["p"], 1, 1], [["ul"], 1, 0]] and b == [[["h1"], 1, 0], [["img"], 1, 0], [["p", "ul"], 1, 1]]
    assert html.aligned(a, b) == [[["h1"], 1, 0], [["img"], 0, 0], [["p", "ul"], 1, 1]]
    assert html.aligned(html.folded(["a", "b"]), html.folded(["b", "a"])) == [[["a", "b"], 1, 1]]
    assert html.aligned(a, []) == [[["h1"], 0, 0], [["p"], 0, 1], [["ul"], 0, 0]]


def test_alignment_takes_in_both_sides():
    """Any row of children fits the expression of all rows, whatever their order, and every name stands once."""
    rng = random.Random(3)
    for _ in range(300):
        rows = [rng.choices("abcde", k=rng.randrange(8)) for _ in range(4)]
        body = None
        for row in rows:
            body = html.folded(row) if body is None else html.aligned(body, html.folded(row))
        names = [x for f in body for x in f[0]]
        assert len(names) == len(set(names))
        pattern = "".join(("(?:" + "".join(x + "?" for x in f[0]) + ")" if len(f[0]) > 1 else f[0][0]) + {(1, 0): "", (0, 0): "?", (1, 1): "+", (0, 1): "*"}[min(f[1], 1), f[2]] for f in body)
        assert all(re.fullmatch(pattern, "".join(row)) for row in rows), (rows, body)


def test_wrapper_is_an_expression():
    w = html.Wrapper()
    for k in range(2):
        w.add(f"<nav>Menu</nav><article><h1>T{k}</h1>" + "<p>x" * (k + 1) + "</article>" + "<footer>f</footer>" * k)
    assert w.expression() == 'nav!("Menu") article(h1(#) p(#)+) footer!("f")?'


def test_articles():
    page = '<html><head><title>t</title></head><body><header>H</header><nav><a href="/">m</a></nav><main><article><h1>One &amp; two</h1><p>A&nbsp;b <b>c</b><br>d<p>e<ul><li>f<li>g</ul><section class="comments"><p>no</section><div class="ad-box">no</div></article><aside>no</aside></main><script>"<p>no"</script><!-- no --><footer>no</footer>'
    assert texts(page) == ["One & two\nA b c d\ne\nf\ng"]
    assert texts(page[: page.index("<li>g")]) == ["One & two\nA b c d\ne\nf"]  # cut off
    assert texts("") == [""] and texts("just text &lt;") == ["just text <"] and texts("<article>x</article <p") == ["x"]


def test_header_of_an_article_is_its_title():
    page = '<div class="site-header"><p>Site {0}</div><article><header class="entry-header"><h1>Title {0}</h1></header><div class="post-header">By someone {0}</div><p>Text {0}.<footer>Tags</footer></article>'
    assert texts(*[page.format(k) for k in range(3)]) == [f"Title {k}\nBy someone {k}\nText {k}." for k in range(3)]


def test_pages_without_an_article_element():
    page = '<div class="header"><ul><li><a>Home</a></ul></div><div id="content" class="with-sidebar"><h2>Title {0}</h2><p>Words {0} of the text.<p>More {0} words.</div><div class="sidebar"><p>Side {0} and a few more words</div><div id="comments"><p>Comment {0}</div><div>Always the same</div>'
    assert texts(*[page.format(k) for k in range(4)]) == [f"Title {k}\nWords {k} of the text.\nMore {k} words." for k in range(4)]
    plain = '<div class="x1"><p>Real text {0} with many words<p>and more {0} of it</div><div class="x2"><a>l1</a> <a>l2</a></div>'
    assert texts(*[plain.format(k) for k in range(4)]) == [f"Real text {k} with many words\nand more {k} of it" for k in range(4)]


SF = "/root/testdata/sf0.001"


def by_pattern(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)\b[^>]*>", inside))
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("bytes_,merged,part", [(html.BROADCAST_BYTES, html.MERGED, html.PART_PAGES), (-1, 2, 1)])
def test_pages_of_the_fixture(spark, monkeypatch, bytes_, merged, part):
    for name, value in (("BROADCAST_BYTES", bytes_), ("MERGED", merged), ("PART_PAGES", part)):
        monkeypatch.setattr(html, name, value)
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(7)
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    want = {r["page_id"]: (r["url"], by_pattern(r["html"])) for r in pages.collect()}
    assert {k: (r["url"], r["text"]) for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("bytes_", [html.BROADCAST_BYTES, -1])
def test_odd_pages(spark, monkeypatch, bytes_):
    monkeypatch.setattr(html, "BROADCAST_BYTES", bytes_)
    long = "<article>" + "<div>" * 2000 + "<p>deep" + "</div>" * 2000 + "<p>word </p>" * 20000 + "</article>"
    rows = [(1, "http://a/x", None), (2, None, "<p>no url"), (None, "no host", ""), (4, "http://A:80/y", long), (5, "http://a/z", "<article>x</article>"), (5, "http://a/z", "<article>x</article>")]
    pages = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], "page_id long, url string, html string, host string, plan string, text string, `a.b` string").repartition(3)
    got = sorted(map(tuple, html.extract(pages).select("page_id", "url", "n_chars").collect()), key=repr)
    assert got == sorted([(1, "http://a/x", 0), (2, None, 6), (None, "no host", 0), (4, "http://A:80/y", 4 + 5 * 20000), (5, "http://a/z", 1), (5, "http://a/z", 1)], key=repr)
    assert html.extract(pages.limit(0)).collect() == []


# ---- mended: 9, and the pipeline's secret scans


def test_repeated_notices_take_no_square_of_their_number(spark):
    """20,000 notices in one text, with words between some of them; each is still found, and a text of other words has none."""
    import time

    notice = "licensed under the mit license "
    long = notice * 20000
    mixed = "".join(notice + ("and then " if k % 3 == 0 else "") for k in range(5000)) + "you may not use this file except in compliance with the license"
    docs = spark.createDataFrame([(1, long), (2, mixed), (3, "plain words of prose " * 50000), (4, notice)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.labels, r.score, r.n_words) for r in licenses.scan(docs).collect()}
    assert got == {1: ("mit", 1.0, 100000), 2: ("apache-2.0,mit", 1.0, 5000 * 5 + 2 * 1667 + 12), 3: ("", 0.0, 200000), 4: ("mit", 1.0, 5)}
    assert time.time() - began < 120


def test_redacted_columns_have_any_names(spark):
    rows = [(1, 'x token = "abcdef123456" y', 7, "p", "q", 26), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "`doc_id` long, text string, `a.b` long, `_keep` string, `we``ird name` string, n_chars int")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got[0][2:5] == (7, "p", "q") and "abcdef123456" not in got[0][1] and got[0][5] == len(got[0][1]) and got[1] == (None,) * 6
    assert secret_scan.redact(docs.limit(0)).collect() == []


def test_ranges_of_keys_are_even(spark):
    """Whatever the share of symbols in a source's texts, no range holds much more than its share, and ranges follow the keys."""
    from pyspark.sql import functions as F

    for weight in (1.0, 0.6, 0.3, 0.1):
        n = 200_000
        rows = spark.range(n).select((-F.ln((F.col("id") + 0.5) / float(n)) / weight).alias("key")).select("key", mixing.key_range(F.col("key")).alias("part"))
        got = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("part").collect()
        assert max(r.n for r in got) <= 3 * n / mixing.RANGES + 2
        assert all(a.high <= b.low for a, b in zip(got, got[1:]))


def test_licenses_that_differ_in_a_word(spark):
    texts = {
        1: ("either version 2 of the License, or (at your option) any later version", "gpl-2.0"),
        2: ("either version 3 of the License, or (at your option) any later version", "gpl-3.0"),
        3: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        4: ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0"),
        5: ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
        6: ("licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {i: x for i, (_, x) in texts.items()}
