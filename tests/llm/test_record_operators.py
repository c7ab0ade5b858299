"""Operators 1, 2, 4, 5, 6, 10 and the pipeline, held against brute force on small tables."""

import hashlib
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from talkledger.llm import common, mips, quality, sharding, simhash, sitetree, warc


def test_warc_round_trip(spark):
    big = "é" * 600
    pages = [(1, "http://a.example/x y", big, 0), (5, None, big, 0), (3, "ftp://b", big, 0), (None, "", big, 0), (7, "u", "small", 0), (8, "u", "small", 0), (9, "u", None, 0), (2, "http://c", "\r\n\r\nWARC/1.1\r\n\x00", 0), (6, "v", big + "z", 0), (6, "v", big + "z", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type int").repartition(3)
    rows = [tuple(r)[:5] for r in warc.report(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    expected = []
    seen = Counter()
    for page_id, _, html, _ in pages:
        data = (html or "").encode()
        keep = max((p for p, _, h, _ in pages if (h or "") == (html or "") and p is not None), default=None)
        again = len(data) >= 1000 and (page_id != keep or seen[page_id, html] > 0)
        seen[page_id, html] += 1
        expected.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep if again else None))
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    assert warc.report(df.limit(0)).count() == 0


def test_arc_versions(tmp_path):
    body = b"line\nline"
    for version in (1, 2):
        name = f"v{version}.arc.gz"
        out = warc._Out(str(tmp_path / name))
        out.add(warc.arc_version_block(name, version))
        out.add(warc.arc_record(version, 4, "http://x/", body, name, out.size))
        out.add(b"dns:x.example 1.2.3.4 20000101000000 text/dns " + (b"" if version == 1 else b"200 - - 0 f ") + b"5\nA rec\n")
        out.close()
        records = list(warc.read_arc(str(tmp_path / name)))
        made = [warc.synthesise(r, name) for r in records]
        assert [m["type"] for m in made] == ["response", "resource"]
        assert made[0]["payload"] == body and made[0]["page_id"] == 4 and made[1]["date"] == "2000-01-01T00:00:00Z"
        assert made[0]["digest"] == hashlib.sha1(body).hexdigest() and made[0]["id"] != made[1]["id"]


@pytest.mark.parametrize("shape", ["ties", "mixed", "huge"])
def test_exact_search(spark, shape):
    rng = np.random.default_rng(3)
    n, k = 300, 5
    vectors = rng.normal(size=(n, 8)) * (1 if shape == "ties" else rng.lognormal(0, 2, size=(n, 1)))
    if shape == "ties":
        vectors[50:150] = vectors[50]
    if shape == "huge":
        vectors *= 2e3  # scores beyond 2^53, within a long
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1004, []), (3, [float(x) for x in vectors[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mips.top_k(mips.quantised(df), F.col("vec_id") % 7 == 0, k, bucket=32, block=16, run=80)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in enumerate(vectors)} | {1004: []}
    expected = []
    for q in whole:
        if q % 7 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(whole[q], c)), i) for i, c in whole.items() if i != q))[:k]  # noqa: B905
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(expected)


def test_search_of_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(mips, "UNIT_BYTES", 8 * 3000 * 7)  # seven vectors in a task
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(40, 3000))
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, run int, theta int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mips.report(df, every=5).collect()}
    whole = np.floor(256 * vectors).astype(np.int64)
    for q in range(0, 40, 5):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(40) if c != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(c, -s) for s, c in best]


def test_search_without_vectors(spark):
    assert mips.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


NOISY = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Head &amp; line</h1><p>by me</p></header><p>First <b>bold</b>\n  text&nbsp;here<p>Second &eacute; &#x41;<br>line<form><input><button>Go</button>Form text</form>
<div class="advert">Buy</div><ul><li>one<li>two</ul><section id="comments"><p>Reader says</p></section></article><aside>Side</aside><div class="related-posts">More</div><footer>Foot</footer><script>var x = "</p><article>no</article>";</script></body></html>"""


def test_main_text():
    assert sitetree.main_text(sitetree.parse(NOISY)).split("\n") == ["Head & line", "First bold text here", "Second é A line", "one", "two"]
    assert sitetree.main_text(sitetree.parse("")) == "" and sitetree.main_text(sitetree.parse("plain &lt;b&gt;")) == "plain <b>"
    assert sitetree.main_text(sitetree.parse("<div><p>a<p>b</div>c")) == "a\nb\nc"
    assert sitetree.main_text(sitetree.parse("<body><!-- x --><p>a<!-- <p>no</p> --> b</p><script>x")) == "a b"
    assert sitetree.main_text(sitetree.parse("<p>" * 3000 + "deep")) == "deep"
    assert sitetree.main_text(sitetree.parse("<article class='post has-comments'><div class='article-header'><h1>T</h1><i>by</i></div>x<article class=comment>no</article></article>")) == "T\nx"
    assert sitetree.main_text(sitetree.parse("<div class='no-sidebar'><div>top</div><div id=content><p>x<div class=sidebar>s</div></div></div>")) == "x"


def test_style_tree_removes_what_a_site_repeats(spark):
    page = "<html><body><div class=box><p>Welcome to our site</p></div><div class=text><p>Story {n} begins</p><p>and part {n} ends</p></div></body></html>"
    pages = [(n, f"http://One.example:80/{n}", page.format(n=n)) for n in range(30)] + [(100, "http://two.example/", page.format(n=100)), (101, None, None), (None, "", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = {r["page_id"]: r for r in sitetree.extract(df).collect()}
    assert rows[7]["text"] == "Story 7 begins\nand part 7 ends" and rows[7]["n_chars"] == len(rows[7]["text"])
    assert rows[100]["text"].startswith("Welcome") and rows[101]["text"] == "" and rows[None]["text"] == "x"
    assert sitetree.extract(df.limit(0)).count() == 0


def test_style_tree_keeps_the_text_of_copied_pages(spark):
    page = "<html><body><div class=box><p>Welcome to our site</p></div><article><p>Story {n} begins</p><p>and part {n} ends</p><p>Read on every page</p></article></body></html>"
    pages = [(n, f"http://one.example/{n}", page.format(n=max(n, 12))) for n in range(20)]
    rows = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(rows[n] == f"Story {max(n, 12)} begins\nand part {max(n, 12)} ends" for n in range(20))


class PlainTree(HTMLParser):
    """A page's (path, children, contents) by the standard library's parser, for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.stack, self.kinds, self.line, self.found, self.shown = [("html", "")], [[]], [], [], []

    def flush(self):
        if text := " ".join("".join(self.line).split()):
            self.found.append((tuple(self.stack), text))
        self.line = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.kinds[-1].append(tag)
        self.stack.append((tag, dict(attrs).get("class", "")))
        self.kinds.append([])

    def handle_endtag(self, tag):
        self.flush()
        self.shown.append((tuple(self.stack), tuple(dict.fromkeys(self.kinds.pop()))))
        self.stack.pop()

    def handle_data(self, data):
        if not data.isspace():
            self.kinds[-1].append("#")
        self.line.append(data)


def plain_extract(pages):
    """Texts of one host's pages by the definition: importances from dictionaries over the different pages."""
    trees = {}
    for source in set(pages):
        trees[source] = tree = PlainTree()
        tree.feed(source)
        tree.shown.append(((("html", ""),), tuple(dict.fromkeys(tree.kinds[0]))))
    m = len(trees)
    contents = Counter(x for t in trees.values() for x in set(t.found))
    shown = Counter(x for t in trees.values() for x in set(t.shown))
    single = {x: 1 - np.log(c) / np.log(m) for x, c in contents.items()}
    importance = {}
    for path in {p for p, _ in contents}:
        own = [v for (p, _), v in single.items() if p == path]
        c = np.array([v for (p, _), v in shown.items() if p == path], float)
        entropy = -(c / c.sum() * np.log(c / c.sum())).sum() / np.log(c.sum()) if c.sum() > 1 else 1.0
        importance[path] = max(np.mean(own), entropy)
    on = Counter(p for t in trees.values() for p in {p for p, _ in t.shown})
    gone = {p for p, v in importance.items() if v < sitetree.ELEMENT and on[p] >= m**0.5}
    return {s: "\n".join(x for p, x in t.found if p not in gone and single[p, x] >= sitetree.CONTENT) for s, t in trees.items()}


def test_style_tree_against_dictionaries(spark):
    rng = random.Random(5)
    pages = []
    for n in range(40):
        parts = [f"<div class=k1><p>Way {rng.choice('ab')}</p><p>Start here</p></div>", f"<div class=k2><p>Story {n} goes on</p><p>{'Shared by some' if n % 3 else 'Only ' + str(n)}</p></div>"]
        parts.append(f"<section class=k{n % 4}>Told in {n % 9}</section>" if n % 2 else "<section class=x><p>Last words</p></section>")
        pages.append("<body>" + "".join(parts) + "</body>")
    pages += pages[:9]
    df = spark.createDataFrame([(n, "http://one.example/", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    expected = plain_extract(pages)
    got = {r["page_id"]: r["text"] for r in sitetree.extract(df, names=False).collect()}
    assert got == {n: expected[p] for n, p in enumerate(pages)}
    assert len({expected[p].count("\n") for p in pages}) > 1 and not any("Start here" in t for t in got.values())


def test_style_tree_acts_inside_articles(spark):
    page = "<html><body><article><p>Story {n} begins</p><div class=q7><p>Follow this place</p></div><p>and part {n} ends</p><p>Half say {h}</p></article></body></html>"
    pages = [(n, "http://one.example/", page.format(n=n, h="this" if n % 2 else n)) for n in range(40)]
    rows = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows == {n: f"Story {n} begins\nand part {n} ends\nHalf say {'this' if n % 2 else n}" for n in range(40)}


@pytest.mark.parametrize("source", ["<a " * 350_000, "<a x='" * 170_000 + '"', '<a x=">" ' * 110_000, "<div>" * 90_000 + "</b>" * 90_000, "<p><div>" + "<b>" * 90_000 + "</p>" * 90_000, "<div><span>" * 50_000 + "t"])
def test_parsing_is_linear(source):
    began = time.process_time()
    sitetree.main_text(sitetree.parse(source))
    whole = time.process_time() - began
    began = time.process_time()
    sitetree.main_text(sitetree.parse(source[: len(source) // 8]))
    assert whole < 20 * (time.process_time() - began) + 0.5


def plain_fingerprint(text, size=4):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_report(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(120)) for _ in range(12)]
    texts = [*base, *(b + " extra" for b in base[:6]), base[0], None, "", " ", "A b", "a  B\n", "É é x y z"]
    df = spark.createDataFrame([(n if n != 3 else None, t, 1) for n, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    rows = simhash.report(df).collect()
    prints = [plain_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = [n if n != 3 else None for n in range(len(texts))]
    least = {g: min((ids[n] for n in range(len(texts)) if group[n] == g and ids[n] is not None), default=None) for g in set(group)}
    expected = [(ids[n], format(prints[n], "016x"), least[group[n]]) for n in range(len(texts))]
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in rows)
    assert simhash.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("errors", [4, 7])
def test_trie_links_are_whole(spark, errors):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, size=25, dtype=np.uint64)
    values = [int(c) for c in centres]
    for c in centres:
        for _ in range(30):
            v = int(c)
            for b in rng.choice(64, rng.integers(1, errors + 3), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for chunk in (8192, 10):  # small chunks: units are dealt as pairs of chunks
        links = simhash.link_forest(fps, len(values), errors, chunk=chunk)
        roots = {r["node"]: r["root"] for r in common.components(links, "test").collect()}
        parent = list(range(len(values)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(values)):
            for j in range(i):
                if bin(values[i] ^ values[j]).count("1") <= errors:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        mine = {frozenset(signed[i] for i in range(len(values)) if find(i) == r) for r in {find(i) for i in range(len(values))}}
        theirs = {}
        for v in signed:
            theirs.setdefault(roots.get(v, v), set()).add(v)
        assert mine == {frozenset(s) for s in theirs.values()}


def test_keep_one(spark):
    rng = random.Random(2)
    a, b = ([f"w{rng.randint(0, 9999)}" for _ in range(200)] for _ in range(2))
    near = [*a[:100], "changed", *a[101:]]
    texts = [" ".join(a), " ".join(near), " ".join(a), " ".join(b), " ".join(sorted(a)), None, "", "lone"]
    df = spark.createDataFrame([(n, t, "en", n) for n, t in enumerate(texts)] + [(0, texts[0], "en", 99)], "doc_id long, text string, lang string, root int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 4, 5, 7]
    # Small batches: the rest of a component is held against what each keeps.
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, batch=1).collect()) == [0, 3, 4, 5, 7]
    assert simhash.keep_one(df.limit(0)).count() == 0
    # Different texts under one key are told apart by the other hash.
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, key=lambda t: F.length(t) % 3).collect()) == [0, 3, 4, 5, 7]
    ids = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (4, "same text here"), (None, "other")], "doc_id long, text string")
    assert sorted(map(str, simhash.keep_one(ids).collect())) == ["Row(doc_id=4, text='same text here')", "Row(doc_id=None, text='other')"]


def test_keep_one_finds_every_near_copy(spark):
    """Appended, cut and edited copies from a similarity of 0.8 up, against brute force."""
    rng = random.Random(7)
    texts = []
    for n in range(60):
        w = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randint(60, 400))]
        more = [f"x{rng.randint(0, 10**6)}" for _ in range(int(len(w) * (0.08, 0.15, 0.2)[n % 3]))]
        at = rng.randrange(len(w))
        cut = w[: len(w) - len(more)] if n % 4 == 0 else w + more if n % 4 == 1 else w[:at] + more + w[at:] if n % 4 == 2 else more + w[len(more) :]
        texts += [" ".join(w), " ".join(cut)]
    passage = " ".join(f"p{n}" for n in range(60))
    texts += [f"{passage} " + " ".join(f"q{n}" for n in rng.sample(range(10**6), 20 + n)) for n in range(40)]
    sets = [simhash.shingle_hashes(t.encode(), 5) for t in texts]
    like = lambda i, j: simhash.similarity(sets[i], sets[j]) >= 0.8
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if like(i, j)]
    assert sum(i < 120 for i, _ in pairs) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert not [p for p in pairs if kept.issuperset(p)]
    assert all(any(like(i, k) for k in kept) for i in range(len(texts)))


def plain_statistics(t):
    t = t or ""
    space, solid = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
    count = lambda p: len(regex.findall(p, t))
    chars, w = max(len(t), 1), max(count(solid + "+"), 1)
    fresh = regex.split(space + "+", t)
    return [
        np.log1p(len(t)), np.log1p(w), count(solid) / w, count(r"\p{Lu}") / chars, count(rf"[^\p{{L}}\p{{N}} \t\n\x0B\f\r]") / chars, count("[0-9]") / chars,
        count(r"([!%*#&$?~^=_<>@])\1") / w, count(rf"(?<!{solid})[|/\\•·–-](?!{solid})") / w, sum(1 for _ in regex.finditer(rf"(?<!{solid})({solid}+){space}+(?=\1(?!{solid}))", t)) / w,
        count(rf"[.!?](?={space}|$)") / w, t.count("\n") / w, len(set(fresh)) / w,
    ]


def test_quality_against_numpy(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "Word. ", "again again ", "!!", " | ", "12 ", "É", "\n", "x%%% ", "- "]) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "word " * 20_000]
    docs = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)], "doc_id long, text string, s_upper int")
    x = np.array([plain_statistics(t) for t in texts])
    got = np.array([list(r) for r in quality.with_statistics(docs.select("doc_id", "text")).orderBy("doc_id").select(*[f"s_{k}" for k in quality.FEATURES]).collect()])
    assert np.allclose(got, x, atol=1e-12)
    y = [int(x[n, 3] < 0.08 or rng.random() < 0.1) for n in range(len(texts))]
    labels = spark.createDataFrame([(n, v) for n, v in enumerate(y)] * 2, "doc_id long, quality int")
    learnt = [n for n in range(len(texts)) if zlib.crc32(str(n).encode()) % 5]
    model = quality.fit(x[learnt], np.array([float(y[n]) for n in learnt]))
    assert model["rules"]
    margin = model["bias"] + sum(w * np.all([(x[:, f] <= at) == low for f, low, at in rule], axis=0) for w, rule in model["rules"])
    # Documents in many copies of an id, and labels given twice, teach no more than once.
    rows = quality.report(docs.unionByName(docs), labels).collect()
    assert len(rows) == 2 * len(texts) and all(abs(r["score"] - 1 / (1 + np.exp(-margin[r["doc_id"]]))) < 1e-9 for r in rows)


def test_quality_learns_a_rule(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for n in range(600):
        good = n % 3 > 0
        rows.append((n, " ".join(rng.choice(["alpha", "beta", "gamma"]) + ("" if good else "$$$") + str(rng.randint(0, 99)) for _ in range(30)), "en", n))
        labels.append((n, int(good), 0))
    docs = spark.createDataFrame([*rows, (None, "x", "en", 0), (9999, None, "en", 0), (9998, "", "en", 0)], "doc_id long, text string, lang string, score int")
    marks = spark.createDataFrame([*labels, (1, None, 0), (123456, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.report(docs, marks).collect()}
    held = [n for n in range(600) if out[n]["held_out"]]
    assert held == [n for n in range(600) if zlib.crc32(str(n).encode()) % 5 == 0]
    assert np.mean([out[n]["predicted"] == labels[n][1] for n in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values()) and len(out) == 603
    assert not out[None]["held_out"]
    none = quality.report(docs, marks.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.report(docs.limit(0), marks).count() == 0
    kept = quality.keep_good(docs, docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id % 3 = 0 and doc_id < 600").count() < 10


def test_shards(spark):
    texts = ["copy"] * 200 + ["other"] * 40 + [None, ""] + [f"t{n}" for n in range(250)]
    df = spark.createDataFrame([(n, t, 7) for n, t in enumerate(texts)] + [(None, "x", 7), (0, "copy", 7)], "doc_id long, text string, shard int")
    rows = sharding.assign_shards(df).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) + 2 and len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert of[240]["size"] == 8 and of[240]["text_crc32"] == 0 and of[0]["text_crc32"] == zlib.crc32(b"copy")
    assert len({of[n]["shard"] for n in range(200, 240)}) <= 5 and len({of[n]["shard"] for n in range(1, 200)}) <= 15
    assert {r["law"] for r in rows} == {"rows"} and sharding.assign_shards(df.limit(0)).count() == 0
    few = sharding.assign_shards(df.limit(3)).collect()
    assert len({r["shard"] for r in few}) == 3


def test_shards_cut_few_links(spark):
    """Against dealing documents by a hash of their ids: far fewer members of a group stand away from its largest part."""
    rng = random.Random(9)
    texts = [f"group {g}" for g in range(150) for _ in range(rng.randint(2, 12))] + [f"single {n}" for n in range(900)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.assign_shards(df).collect()

    def away(shard):
        parts = {}
        for n, t in enumerate(texts):
            parts.setdefault(t, Counter())[shard[n]] += 1
        return sum(sum(c.values()) - max(c.values()) for c in parts.values())

    simple = away({n: zlib.crc32(str(n).encode()) % 24 for n in range(len(texts))})
    assert away({r["doc_id"]: r["shard"] for r in rows}) < 0.1 * simple
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_batches_are_compared_at_once(monkeypatch):
    """What is kept is an index: only the last few kept texts are compared one by one."""
    import pandas as pd

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.choice([0, 3, 30, 31]))).encode() for _ in range(400)]
    texts += [t + b" more" for t in texts[:100]]
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    kept = []
    for n, s in enumerate(sets):
        if not any(simhash.similarity(s, sets[k]) >= 0.8 for k in kept):
            kept.append(n)
    asked = []
    plain = simhash.similarity
    monkeypatch.setattr(simhash, "similarity", lambda a, b: asked.append(1) or plain(a, b))
    frame = pd.DataFrame({"tkey": range(len(texts)), "rank": range(len(texts)), "text": texts})
    got = simhash._greedy(frame, 5, 0.8)
    assert got.loc[got["kept"], "tkey"].tolist() == kept
    assert len(asked) < len(texts) * 64  # before, each with all that were kept: some 80,000
    same = simhash._held_against(frame[300:], frame[:300], 5, 0.8)["same"].tolist()
    assert same == [any(plain(sets[i], sets[j]) >= 0.8 for j in range(300)) for i in range(300, len(texts))]


def test_fingerprint_links_have_a_small_plan(spark):
    """The driver holds a plan's expressions several times over: their number may not grow with the choices of blocks."""
    from itertools import combinations

    values = [0, 5, -1, 1 << 40, -(1 << 63), (1 << 63) - 1, 0x123456789ABCDEF]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    sizes = {}
    for errors, count in ((4, 10), (7, 44_000), (7, 1 << 24)):
        blocks, k = simhash._blocks(count, errors)
        plan = simhash.link_forest(fps, count, errors)._jdf.queryExecution().analyzed().toString()
        sizes[len(list(combinations(blocks, k)))] = len(plan)
    assert min(sizes) == 5 and max(sizes) > 100 and max(sizes.values()) < 1.2 * min(sizes.values()) < 12_000
    blocks, k = simhash._blocks(44_000, 7)
    choices = list(combinations(range(len(blocks)), k))
    cut = lambda v, i: v >> blocks[i][0] & (1 << blocks[i][1]) - 1
    for r in simhash._keyed(fps, choices, blocks).collect():
        order = [*choices[r["choice"]], *[i for i in range(len(blocks)) if i not in choices[r["choice"]]]]
        told = "".join(f"{cut(r['fp'] % (1 << 64), i):0{blocks[i][1]}b}" for i in order)
        assert int(told, 2) == r["bits"] % (1 << 64) and int(told[: sum(blocks[i][1] for i in order[:k])], 2) == r["key"]


def test_keep_one_leaves_no_tables_of_its_steps(spark, monkeypatch):
    """Rounds write who is open, not their texts again, and what a step wrote goes when the next one has read it."""
    import os

    from talkledger.llm import common

    rng = random.Random(11)
    said = [f"w{n}" for n in range(400)]
    hot = " ".join(["one", "line", "that", "all", "texts", "have"])
    rows = [(n, " ".join(rng.choices(said, k=20)) + " " + hot) for n in range(150)]  # a component of 150 texts, none like another
    df = spark.createDataFrame([*rows, (900, rows[3][1]), (901, rows[4][1] + " x")], "doc_id long, text string")
    wrote, plain = [], common.materialize

    def seen(frame, tag):
        out = plain(frame, tag)
        wrote.append((tag, out))
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    monkeypatch.setattr(common, "materialize", seen)
    texts = {}
    for batch in (2048, 16):
        wrote.clear()
        out = simhash.keep_one(df, batch=batch)
        there = [tag for tag, t in wrote if os.path.exists(t.path__)]
        assert sorted(there) == ["dedup-clashes", "dedup-kept"]
        texts[batch] = sum("text" in t.columns for _, t in wrote)
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(150))
    assert 1 <= texts[16] <= 1 + 8  # halvings, not rounds
    assert simhash._blocks(2_200_000, 7)[1] == 2 and simhash._blocks(250_000, 7)[1] == 2
