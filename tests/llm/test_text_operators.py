"""Operators 3, 7, 8, 9 on whole texts, held against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
import sentencepiece

from talkledger.llm import decontaminate, licences, pii, sentencepieces

NASTY = [
    None, "", " ", "a@b.c", "x a@b.c_d@e.f y", "a@b.c@d.e", "..@x.y. 1.2.3.4.5.6.7.8 999.1.1.1", "256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111",
    "+1 (017) 555-7713 tel +12345 +1 2345678901234567", "é日本 a@b.co 😀 1.2.3.4 😀", "9" * 3000, "a." * 3000 + "@", "a@" + "b." * 3000 + "c", "1 " * 3000, "x@y.z" * 50, "4111 1111 1111 1111 4111 1111 1111 1111",
    "mail a%b+c@d-e.f-g.h! ip:10.0.0.1:80 +44 20 7946 0958x", " a@b.c \n1.1.1.1\t+49-30-1234567",
]


def documents(spark, texts):
    return spark.createDataFrame([(n, t, "en", "clash") for n, t in enumerate(texts)], "doc_id long, text string, lang string, spans string")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern, ok) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(found)


def test_pii_base_spans(spark):
    rows = pii.report(documents(spark, NASTY)).collect()
    assert len(rows) == len(NASTY)
    for r in rows:
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(NASTY[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), NASTY[r["doc_id"]]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("term")] == [x for x in listed.split(",") if x]


def test_pii_terms_and_sanitised_text(spark):
    shown = [f"filler{n} zebrafish boss@corp.example word{n} tail" for n in "abcd"]
    others = [f"plain sentence about nothing, number {n}" for n in range(30)]
    texts = [*shown, *others, "tail end common", None]
    df = documents(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert all("term:8:17" in spans[n] and "email:18:35" in spans[n] for n in range(4)) and not any(spans[n] for n in range(4, 36))
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "zebrafish" not in out[0] and "[EMAIL]" in out[0] and "boss" not in out[0]
    assert [out[n] for n in range(4, 36)] == texts[4:]
    assert pii.sanitise(df).columns == df.columns


def test_pii_copies_count_once(spark):
    shown = [f"zebrafish boss@corp.example word{n} tail" for n in "abcd"]
    others = [f"plain sentence about nothing, number {n}" for n in range(30)]
    df = documents(spark, shown * 20 + others)
    spans = [r["spans"] for r in pii.report(df).orderBy("doc_id").collect()]
    assert all("term:0:9" in s for s in spans[:80]) and not any(spans[80:])


def plain_disclosures(texts, threshold):
    """(kind, value, term): disclosure, by counting over sets of texts."""
    ids = {}
    for t in set(texts):
        found = set()
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            v = m.group()
            name = re.match("[A-Za-z]*", v).group().lower()
            found |= {("email", v), ("email:any", ""), ("email:domain", v.split("@")[1].lower())} | ({("email:name", name)} if name else set())
        for start, _, kind, end in base_spans(t):
            v, digits = t[start:end], re.sub("[^0-9]", "", t[start:end])
            if kind == "ip":
                found |= {("ip", v), ("ip:any", ""), ("ip:network", ".".join(v.split(".")[:2])), ("ip:block", v.split(".")[0])}
            if kind == "card":
                found |= {("card", v), ("card:any", ""), ("card:issuer", digits[:6])}
            if kind == "phone":
                found |= {("phone", v), ("phone:any", ""), ("phone:country", digits[:2]), ("phone:area", digits[:5])}
        ids[t] = found
    terms = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", " ", t))} for t in ids}
    every = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in ids}
    df = {}
    for t in ids:
        for w in every[t]:
            df[w] = df.get(w, 0) + 1
    out = {}
    for c in set().union(*ids.values()):
        of = [t for t in ids if c in ids[t]]
        content = math.log2(len(ids) / len(of))
        for w in set().union(*(terms[t] for t in of)):
            n = sum(w in terms[t] for t in of)
            m = min(len(of), df[w])
            d = n / (n + 1) * m / (m + 1) * math.log2(len(ids) * n / (len(of) * df[w])) / content if content else 0
            if d >= threshold:
                out[(*c, w)] = d
    return out


def test_pii_disclosures_equal_plain_counts(spark):
    from talkledger.llm.common import materialize

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "token", "boss", "desk"]
    texts = []
    for n in range(220):
        t = " ".join(rng.choices(words[:6], k=5)) + f" w{n}x"
        if n % 9 == 0:
            t += f" token mail {rng.choice('ab')}nn.{n % 7}@{rng.choice(['x', 'y'])}.example.com"
        if n % 11 == 0:
            t += f" desk 10.{n % 3}.{n}.1"
        if n % 13 == 0:
            t += f" +1 (20{n % 2}) 555-77{n % 10}{n % 10} boss"
        texts.append(t)
    texts += texts[:30]
    df = documents(spark, texts)
    base = materialize(pii._entities(df), "t")
    copies = base.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    _, shown, _ = pii.shown_terms(df, base, copies, len(set(texts)), 0.55)
    got = {(r["kind"], r["value"], r["term"]): r["disclosure"] for r in shown.collect()}
    want = plain_disclosures(texts, 0.55)
    assert got.keys() == want.keys() and len(want) > 4 and {"token", "desk", "boss"} <= {k[2] for k in want}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert pii.least_texts(0.55) == 3 and (2 / 3) ** 2 < 0.55 <= (3 / 4) ** 2


def test_pii_terms_on_the_tables(spark):
    """What the corpus discloses is marked, and only that."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    allowed = plain_disclosures(list(texts.values()), 0.55)
    found = [(r["doc_id"], x.split(":")) for r in pii.report(docs).collect() for x in r["spans"].split(",") if x.startswith("term:")]
    assert found and {texts[i][int(a) : int(b)].lower() for i, (_, a, b) in found} <= {k[2] for k in allowed}


def test_pii_terms_go_wherever_they_stand(spark):
    far = " ".join(f"filling{chr(97 + n % 26)}" for n in range(60))
    shown = [f"Zebrafish came first {far} mail boss@zebrafish.example word{n} {far} (ZEBRAFISH) zebrafishes" for n in "abcd"]
    others = [f"plain sentence about nothing, first {far} mail of number {n}" for n in range(30)]
    df = documents(spark, [*shown, *others])
    spans = [r["spans"] for r in pii.report(df).orderBy("doc_id").collect()]
    places = [[(m.start(), m.end()) for m in re.finditer(r"(?<!\w)zebrafish(?![\w.])", t, re.I)] for t in shown]
    assert all(len(p) == 2 and all(f"term:{a}:{b}" in s for a, b in p) for p, s in zip(places, spans)) and not any(spans[4:])
    out = [r["text"] for r in pii.sanitise(df).orderBy("doc_id").collect()]
    assert not any(re.search(r"zebrafish\b", t, re.I) for t in out) and out[4:] == others


def test_pii_empty_and_repeated(spark):
    assert pii.report(documents(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a@b.c")] * 3 + [(1, "a@b.c")], "doc_id long, text string")
    assert [r["n_email"] for r in pii.report(same).collect()] == [1] * 4
    assert [r["text"] for r in pii.sanitise(same).collect()] == ["[EMAIL]"] * 4


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, limit):
    passage = " ".join(f"W{n}" for n in range(14))
    items = [(1, passage), (2, "short Item"), (10, passage + " more"), (3, None), (4, "!!")]
    texts = ["x " + passage.lower() + " y", "a SHORT, item! and short item", "w0 w1 w2", None, "", passage + " short", "É short é item", passage * 2, passage.replace("W5", "other"), "ΑΣ. Β w0 w1 ΑΣ Β short item", "stuff " * 20_000 + passage, passage]
    items.append((5, "αΣ"))
    items.append((6, "ΑΣ Β"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.mark_hits(documents(spark, texts).withColumn("words", F.lit(1)).withColumn("h_id", F.lit(1)), bench, broadcast_windows=limit).collect()}
    for n, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            size = min(10, len(iw))
            for i in range(len(iw) - size + 1 if iw else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == iw[i : i + size]:
                        hit |= set(range(j, j + size))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        r = rows[n]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(ids), digest, bool(hit)), t[-300:]
    assert decontaminate.mark_hits(documents(spark, []), bench, broadcast_windows=limit).count() == 0
    same = spark.createDataFrame([(None, "short item"), (None, "short item"), (7, "short item")], "doc_id long, text string")
    assert [r["n_hit"] for r in decontaminate.mark_hits(same, bench, broadcast_windows=limit).collect()] == [2] * 3


def test_frequent_ends_of_windows_bring_no_candidates(spark):
    """Windows that differ anywhere have different hashes; a filter lets all of the set pass, and few others."""
    rng = random.Random(6)
    said = [["of", "the"] + [f"m{rng.randint(0, 9)}" for _ in range(n - 4)] + ["in", "the"] for n in (5, 6, 7, 8, 9, 10) for _ in range(60)]
    df = spark.createDataFrame([(n, w) for n, w in enumerate(said)], "i int, words array<string>")
    rows = decontaminate.hashed(df, list(range(5, 11))).filter("at = 0 and len = size(words)").collect()
    assert len(rows) == len(said) and len({r["h"] for r in rows}) == len({tuple(w) for w in said})
    one = spark.createDataFrame([(["a", "b"],), (["A", "b"],), (["b", "a"],)], "words array<string>")
    assert decontaminate.hashed(one, [2]).filter("at = 0").select("h").distinct().count() == 2
    windows = spark.range(1000).select(F.xxhash64("id").alias("h"))
    rows = windows.withColumn("mine", F.lit(True)).unionByName(spark.range(5000, 25000).select(F.xxhash64("id").alias("h"), F.lit(False).alias("mine")))
    got = decontaminate.passed(rows, windows, 1 << 16).groupBy("mine").count().collect()
    got = {r["mine"]: r["count"] for r in got}
    assert got[True] == 1000 and 0 < got.get(False, 0) < 2000


def test_decontamination_removes(spark):
    passage = " ".join(f"w{n}" for n in range(12))
    texts = ["one two three four five six seven eight nine ten eleven twelve, " + passage + ". The end", passage, "clean  text\n", None]
    df = documents(spark, texts)
    out = {r["doc_id"]: r["text"] for r in decontaminate.remove_hits(df, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert out == {0: "one two three four five six seven eight nine ten eleven twelve, The end", 2: texts[2], 3: None}
    assert decontaminate.remove_hits(df, spark.createDataFrame([], "item_id long, text string")).count() == 4


def test_licences(spark):
    texts = [
        "x Released under the MIT License. y", "This work is licensed under the GNU General Public License, version 3.", "cc by", "CC BY-NC 4.0", None, "", "mit licensed", "Apache License apache license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
        "the of and to " * 200,
    ]
    rows = {r["doc_id"]: r for r in licences.report(documents(spark, texts)).collect()}
    assert [(rows[n]["n_base"], rows[n]["first_word"], rows[n]["last_word"], rows[n]["base_labels"]) for n in range(8)] == [
        (1, 4, 4, "mit"), (1, 6, 6, "gpl"), (1, 0, 0, "cc-by"), (1, 0, 0, "cc-by"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (2, 0, 2, "apache"),
    ]
    assert rows[1]["labels"] == "gpl,gpl-3.0" and rows[8]["labels"] == "mit" and rows[8]["base_labels"] == "" and rows[9]["labels"] == ""
    assert all(0 <= r["score"] <= 1 and r["n_words"] == len(words(texts[n])) for n, r in rows.items())
    assert licences.report(documents(spark, [])).count() == 0


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_labels(text):
    """Labels and scores by trying every place of every template."""
    w, found = [x.encode() for x in words(text)], {}
    for n, (label, _, keys) in enumerate(licences.TEMPLATES):
        tokens = licences.TOKENS[n]
        d = licences.band(tokens)
        for at in range(-len(tokens) - d, len(w) + d):
            there = w[max(0, at - d) : max(0, at + len(tokens) + d)]
            if len(set(tokens) & set(there)) < 0.5 * len(set(tokens)):
                continue
            share = plain_subsequence(tokens, there) / len(tokens)
            line = b" " + b" ".join(there) + b" "
            if share >= licences.LEAST_SHARE and all(b" " + k.encode() + b" " in line for k in keys):
                found[label] = max(found.get(label, 0), share)
    return found


def test_licences_against_every_alignment(spark):
    rng = random.Random(7)
    texts = []
    for _, wording, _ in licences.TEMPLATES:
        w = wording.split()
        if len(w) > 60:
            w = w[:60]
        for change in range(4):
            v = list(w)
            for _ in range(change * max(1, len(w) // 20)):
                at = rng.randrange(len(v))
                if rng.random() < 0.4:
                    v[at] = rng.choice(["software", "changed", "license"])
                elif rng.random() < 0.5:
                    v.insert(at, rng.choice(["inserted", "the"]))
                else:
                    del v[at]
            texts.append(" ".join(["before", "it"] * rng.randrange(3) + v + ["after"] * rng.randrange(3)))
    texts += [texts[0] + " filler " * 30 + texts[9], "mit license " * 20, None, ""]
    rows = {r["doc_id"]: r for r in licences.report(documents(spark, texts).withColumn("words", F.lit(1))).collect()}
    labelled = 0
    for n, t in enumerate(texts):
        expected = plain_labels(t)
        base = {label for phrase, label in licences.PHRASES.items() if f" {phrase} " in f" {' '.join(words(t))} "}
        assert rows[n]["labels"] == ",".join(sorted(base | set(expected))), t
        assert abs(rows[n]["score"] - max(expected.values(), default=0.5 if base else 0.0)) < 1e-12
        labelled += bool(expected)
    assert labelled > 40
    long = documents(spark, ["cc by mit license " * 60_000, "cc by", "cc by"])
    assert [r["n_base"] for r in licences.report(long).orderBy("doc_id").collect()] == [120_000, 1, 1]


TEXTS = [None, "", " ", "  two  spaces ", "hello world", "日本語 😀\n\ttab", "a" * 500, "é" * 60, "Don't stop -- 1234567!", "\x00odd\x7f", "word " * 300, "ﬁ ligature ① ½", "mixed space"]


def test_sentencepiece_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = {r["doc_id"]: r for r in sentencepieces.report(documents(spark, TEXTS)).collect()}
    for n, t in enumerate(TEXTS):
        assert rows[n]["ids"] == (None if t is None else library.encode(t)), t
        assert rows[n]["round_trip"]


def test_long_parts_take_their_edges_from_stretches(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    model = sentencepieces.load_model()
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh你好世界éß🙂") for _ in range(n)) for n in (48, 49, 50, 300, 5000)] + ["x" * 3000, "漢字" * 400 + " ab " + "ü" * 60, "word " * 3000]
    whole = sentencepieces.Stretches.__init__
    for stretch in (64, 1000, sentencepieces.PART_CHARS):
        monkeypatch.setattr(sentencepieces.Stretches, "__init__", lambda self, m, t, n=stretch: whole(self, m, t, n))
        memo = sentencepieces.Memo()
        for _ in range(2):  # the second time from the memo
            assert [f.tolist() for f in sentencepieces.encode_batch(model, texts, memo)] == [library.encode(t) for t in texts]


def test_sentencepiece_empty_and_repeated(spark):
    assert sentencepieces.report(documents(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a word", 1)] * 3 + [(1, None, 2)], "doc_id long, text string, decoded int")
    rows = sentencepieces.report(same).collect()
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] is None}) == 1 and [r["ids"] for r in rows if r["doc_id"] == 1] == [None] and all(r["round_trip"] for r in rows)


def test_unigram_best_path():
    model = sentencepieces.Model(["<unk>", "▁", "a", "b", "ab", "▁a", "ba"], [0, -4, -3, -3, -2.5, -2, -2.2], [2, 1, 1, 1, 1, 1, 1], sentencepieces.UNIGRAM)

    def brute(text):
        best = {0: (0.0, [])}
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                piece = model.ids.get(text[i:j], 0 if j == i + 1 else None)
                if piece is not None:
                    s = best[i][0] + (model.scores[piece] if piece else -14.0)
                    if j not in best or s > best[j][0]:
                        best[j] = (s, [*best[i][1], piece])
        return best[len(text)][1]

    texts = ["abab", "ba b", "aab bba", "xa b", "b"]
    found = sentencepieces.encode_batch(model, texts, sentencepieces.Memo())
    for t, ids in zip(texts, found, strict=True):
        assert ids.tolist() == [x for p in sentencepieces.parts_of(model, sentencepieces.normalise(model, t)) for x in brute(p)]


@pytest.mark.parametrize("size", [1, 7, 300])
def test_index_finds_every_occurrence(size):
    model = sentencepieces.load_model()
    parts = ["▁the", "▁theory", "they", "日本", "ab" * size]
    index = sentencepieces.Index(model, parts)
    expected = {(at, n) for at in range(len(index.text)) for n in range(1, model.longest + 1) if index.text[at : at + n] in model.ids and "\0" not in index.text[at : at + n]}
    assert {(int(e) // (index.reach + 1), int(e) % (index.reach + 1)) for e in index.edge} == expected
