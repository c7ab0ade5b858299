"""Information-theoretic sanitisation (operator 3): DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by
pattern. Protected entities are what recurs of their values: the value itself, the groups it belongs to (an
address's domain and name, a network, an issuer, a dial code) and its kind. Terms (runs of three letters or
more, outside e-mail addresses) of the texts that hold an entity are counted over the whole corpus,
wherever they stand, and the pointwise mutual information of term and entity is held against the entity's information content:

    PMI(c; t) / IC(c) = log2(N n(c,t) / (n(c) df(t))) / log2(N / n(c))

It is 1 if t occurs in texts with c only, 0 if they are independent. All four are counts of
different texts, so copies of a text count once. Few texts tell little: the ratio is smoothed by the factor
n(c,t) / (n(c,t) + 1) * m / (m + 1), m the smaller of n(c) and df(t), which makes the disclosure. A term goes up a hierarchy as
it discloses more, at every place in each text that holds the entity: from `generalise_at` on its class stands for it (a name, an acronym,
a word), from `kind_at` on the kind of what it discloses, and from `remove_at` on nothing. How few texts can pass the
first threshold follows from the factor.

Matches are found by patterns that need no backtracking over groups, so very long runs
neither recurse nor take quadratic time; they give the same matches as the plain ones.

Defined cases: a null text is empty in the query and stays null in `sanitise`; rows with
the same doc_id and text get the same spans; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    # A local part starts where a run starts, or where the last match ended.
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with single separators, of 14 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MUST_HAVE = {"email": "@", "ip": ".", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^(?:{_PART}\.){{3}}{_PART}$"
TERM = r"\p{L}{3,}"
GENERALISE_AT, KIND_AT, REMOVE_AT = 0.55, 0.7, 0.85
#: Up to so many different terms are broadcast (some 40 bytes each).
BROADCAST_TERMS = 500_000
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"


def _located(pieces: Column, matches: Column) -> Column:
    """(start, end, value) of matches, from them and the pieces between them."""
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        start = a["to"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("to"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(matches, i).alias("value")))).alias("out"))

    some = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda a: a["out"])
    return F.when(F.size(matches) > 0, some).otherwise(zero["out"])


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return _luhn(F.regexp_replace(value, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with spans, sorted by start and kind."""
    df = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        found = F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0))
        df = df.withColumn(f"m_{kind}", F.when(F.col("t").contains(MUST_HAVE[kind]), found).otherwise(none) if kind in MUST_HAVE else found)
    for kind in KINDS:
        df = df.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("t", PATTERNS[kind], -1)))
    every = []
    for n, kind in enumerate(KINDS):
        at = F.filter(_located(F.col(f"p_{kind}"), F.col(f"m_{kind}")), lambda s: _valid(kind, s["value"]))  # noqa: B023
        labelled = lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))  # noqa: B023, E731
        every.append(F.transform(at, labelled))
    some = F.greatest(*[F.size(f"m_{k}") for k in KINDS]) > 0
    return df.withColumn("spans", F.when(some, F.array_sort(F.concat(*every))).otherwise(F.array().cast(f"array<{SPAN}>"))).select(*docs.columns, "t", "spans")


def _masked(text: Column) -> Column:
    """text with blanks for its e-mail addresses, the only base spans with letters; places stay."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    blanks = F.transform(F.split(text, PATTERNS["email"], -1), lambda p, i: F.concat(p, F.repeat(F.lit(" "), F.coalesce(F.length(F.get(found, i)), F.lit(0)))))
    return F.when(text.contains("@"), F.array_join(blanks, "")).otherwise(text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _entities(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, spans, and the terms of texts with spans: all that later steps need."""
    based = base_spans(docs.select("doc_id", "text"))
    terms = F.when(F.size("spans") > 0, F.array_distinct(F.transform(_terms(_masked(F.col("t"))), F.lower))).otherwise(F.array().cast("array<string>"))
    return based.select("doc_id", F.xxhash64("text").alias("tkey"), "spans", terms.alias("terms"))


def least_texts(threshold: float) -> int:
    """The fewest texts with an entity and a term for which the smoothed ratio can reach the threshold: (n / (n + 1)) ** 2 is its most."""
    root = min(threshold, 1.0) ** 0.5
    return max(1, math.ceil(root / (1 - root) - 1e-9)) if root < 1 else 1 << 30


def units(span: Column) -> Column:
    """The entities of a value, as (kind, value) with kind:group for groups: what several values share recurs where values don't."""
    v, kind = span["value"], span["kind"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    of = lambda group, x: F.struct(F.concat(kind, F.lit(f":{group}")).alias("kind"), x.alias("value"))
    groups = (
        F.when(kind == "email", F.array(of("domain", F.lower(F.substring_index(v, "@", -1))), of("name", F.lower(F.regexp_extract(v, "^[A-Za-z]*", 0)))))
        .when(kind == "ip", F.array(of("network", F.substring_index(v, ".", 2)), of("block", F.substring_index(v, ".", 1))))
        .when(kind == "card", F.array(of("issuer", F.substring(digits, 1, 6))))
        .otherwise(F.array(of("country", F.substring(digits, 1, 2)), of("area", F.substring(digits, 1, 5))))
    )
    own = F.array(F.struct(kind.alias("kind"), v.alias("value")), of("any", F.lit("")))
    return F.filter(F.concat(own, groups), lambda u: (u["value"] != "") | F.endswith(u["kind"], F.lit(":any")))


def term_counts(docs: DataFrame, copies: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: how many different texts of the whole corpus have each of the terms.

    A row counts for its share among the copies of its text (tkey, copies: of texts in several rows), so that the sums need no list of texts."""
    terms_of = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    rows = docs.select(F.xxhash64("text").alias("tkey"), "text")
    rows = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_TERMS else copies, "tkey", "left")
    has = rows.select((1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(terms_of).alias("term"))
    n = terms.count()
    has = has.join(F.broadcast(terms), "term", "left_semi") if n <= BROADCAST_TERMS else has
    return (has if n else has.limit(0)).groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("df"))


def disclosures(held: DataFrame, terms: DataFrame, total: int, generalise_at: float) -> DataFrame:
    """kind, value, term, disclosure of the pairs beyond the threshold.

    held: kind, value, tkey, n_c; terms: tkey, term, beside (how many texts with any entity have it), df; total: the number of different texts."""
    whole = F.lit(float(max(total, 1)))
    # The threshold bounds what a term's frequency can be beside an entity, smoothing aside: df <= n_ct (N / n_c)^(1 - threshold), and
    # n_ct is at most n_c and at most beside. That leaves out all words that are as frequent elsewhere, before pairs are counted.
    room = F.pow(whole / F.col("n_c"), F.lit(1 - generalise_at)) * (1 + 1e-9)
    pairs = held.join(terms, "tkey").filter(F.col("df") <= F.least("n_c", "beside") * room)
    pairs = pairs.groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.max("n_c").alias("n_c"), F.max("df").alias("df"))
    pairs = pairs.filter((F.col("n_ct") >= least_texts(generalise_at)) & (F.col("df") <= F.col("n_ct") * room))
    few = F.least("n_c", "df")
    smooth = F.col("n_ct") / (F.col("n_ct") + 1) * few / (few + 1)
    content = F.log2(whole / F.col("n_c"))
    score = smooth * F.log2(whole * F.col("n_ct") / (F.col("n_c") * F.col("df"))) / content
    scored = pairs.withColumn("disclosure", F.when(content > 0, score)).filter(F.col("disclosure") >= generalise_at)
    return scored.select("kind", "value", "term", "disclosure")


def shown_terms(docs: DataFrame, base: DataFrame, copies: DataFrame, total: int, generalise_at: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities that recur (kind, value, tkey, n_c), what discloses them (kind, value, term, disclosure), and the terms of their texts (tkey, term)."""
    least = least_texts(generalise_at)
    of = base.filter(F.size("spans") > 0).select("tkey", F.explode(F.array_distinct(F.flatten(F.transform("spans", units)))).alias("u"))
    held = of.select("u.kind", "u.value", "tkey").distinct()
    often = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= least)
    held = materialize(held.join(often, ["kind", "value"]), "pii-held")
    terms = base.filter(F.size("terms") > 0).join(held.select("tkey").distinct(), "tkey", "left_semi").select("tkey", F.explode("terms").alias("term")).distinct()
    terms = materialize(terms, "pii-near")
    beside = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("beside")).filter(F.col("beside") >= least), "pii-terms")
    counts = beside.join(term_counts(docs, copies, beside.select("term")), "term").withColumn("df", F.greatest("df", "beside"))  # a few letters change the length of a run in lower case
    terms = terms.join(materialize(counts, "pii-counts"), "term")
    return held, materialize(disclosures(held, terms, total, generalise_at), "pii-shown"), terms


def _general(term: Column) -> Column:
    """The class that stands for a term: what it is written like, which all terms of that kind share."""
    return F.when(term.rlike(r"^\p{Lu}+$"), "[ACRONYM]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def _places(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, tkey, added: every place of the terms (tkey, actions: action and kind by term) in the texts."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).join(hits, "tkey").dropDuplicates(["doc_id", "tkey"])
    rows = rows.withColumn("m", _masked(F.col("text")))
    # The very forms of the terms, as whole runs of letters: few places, whatever the text's length.
    forms = F.array_join(F.filter(_terms(F.col("m")), lambda w: F.map_contains_key("actions", F.lower(w))), "|")
    rows = rows.withColumn("one", F.concat(F.lit(r"(?<!\p{L})(?:"), forms, F.lit(r")(?!\p{L})")))
    rows = rows.withColumn("found", F.regexp_extract_all("m", F.col("one"), F.lit(0))).withColumn("between", F.split("m", F.col("one"), -1))
    at = _located(F.col("between"), F.col("found"))
    does = lambda s: F.element_at("actions", F.lower(s["value"]))
    put = lambda s: F.when(does(s)["action"] == "remove", F.lit("")).when(does(s)["action"] == "kind", F.concat(F.lit("["), F.upper(does(s)["kind"]), F.lit(" CONTEXT]"))).otherwise(_general(s["value"]))
    added = F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), does(s)["action"].alias("action"), put(s).alias("put")))
    return rows.select("doc_id", "tkey", added.alias("added"))


def find_spans(docs: DataFrame, generalise_at: float = GENERALISE_AT, kind_at: float = KIND_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id, tkey, spans (base), added (the method's: start, end, action, put: what stands for the term): a row for each row of docs."""
    base = materialize(_entities(docs), "pii-base")
    total = base.select("tkey").distinct().count()
    copies = materialize(base.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "pii-copies")
    held, shown, terms = shown_terms(docs, base, copies, total, generalise_at)
    # The strongest disclosure of a term in a text, whichever entities call for it.
    hits = held.join(terms.join(shown.select("term").distinct(), "term", "left_semi"), "tkey").join(shown, ["kind", "value", "term"])
    action = F.when(F.col("most.disclosure") >= remove_at, "remove").when(F.col("most.disclosure") >= kind_at, "kind").otherwise("generalise")
    hits = hits.groupBy("tkey", "term").agg(F.max(F.struct("disclosure", "kind")).alias("most"))
    hits = hits.select("tkey", "term", F.struct(action.alias("action"), F.substring_index("most.kind", ":", 1).alias("kind")).alias("does"))
    hits = hits.groupBy("tkey").agg(F.map_from_entries(F.collect_list(F.struct("term", "does"))).alias("actions"))
    added = _places(docs, materialize(hits, "pii-hits")).withColumnsRenamed({"doc_id": "a_id", "tkey": "a_key"})
    out = base.join(added, base["doc_id"].eqNullSafe(added["a_id"]) & base["tkey"].eqNullSafe(added["a_key"]), "left")
    bare = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,action:string,put:string>>")
    return out.select("doc_id", "tkey", bare.alias("spans"), F.coalesce("added", none).alias("added"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _all_spans() -> Column:
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), s["end"].alias("end"), F.lit("term").alias("kind")))
    return F.array_sort(F.concat(F.col("spans"), F.array_distinct(more)))


def report(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs."""
    found = find_spans(docs, **limits)
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(_all_spans()).alias("spans"))


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """docs with a placeholder for each base span and each generalised term, and without removed terms."""
    found = find_spans(docs.select("doc_id", "text"), **limits)
    labelled = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    labelled_more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["put"].alias("put")))
    cuts = found.filter((F.size("spans") > 0) | (F.size("added") > 0)).select(F.col("doc_id").alias("c_id"), F.col("tkey").alias("c_key"), F.array_sort(F.concat(labelled, labelled_more)).alias("cuts"))
    cuts = cuts.dropDuplicates(["c_id", "c_key"])
    last = lambda a: F.get(a, F.size(a) - 1)
    # Overlapping spans become one, with the first's placeholder.
    merged = F.aggregate(
        "cuts",
        F.array().cast("array<struct<start:int,end:int,put:string>>"),
        lambda a, s: F.when(
            last(a)["end"] > s["start"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), F.when(last(a)["put"] == "", s["put"]).otherwise(last(a)["put"]).alias("put")))),
        ).otherwise(F.concat(a, F.array(s))),
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text").withColumn("tkey", F.xxhash64("text"))
    out = packed.join(cuts, packed["doc_id"].eqNullSafe(cuts["c_id"]) & packed["tkey"].eqNullSafe(cuts["c_key"]), "left")
    out = out.withColumn("merged", F.when(F.col("cuts").isNotNull(), merged))
    before = lambda i: F.when(i > 0, F.get("merged", i - 1)["end"]).otherwise(F.lit(0))
    parts = F.transform("merged", lambda s, i: F.concat(F.substring(F.col("text"), before(i) + 1, s["start"] - before(i)), s["put"]))
    tail = F.substring(F.col("text"), F.get("merged", F.size("merged") - 1)["end"] + 1, F.length("text"))
    clean = F.when(F.col("cuts").isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))
    return out.withColumn("clean", clean).select(*[(F.col("clean") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def base_sql() -> str:
    """How many base spans of each kind documents have, in DuckDB's SQL."""
    digits = "list_transform(range(1, length(g) + 1), lambda i: cast(substr(g, length(g) - i + 1, 1) as integer) * (case when i % 2 = 0 then 2 else 1 end))"
    return rf"""
    with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    ips as (select r, unnest(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) as m from t),
    ip as (select r, count(*) as n from ips where len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast(concat('0', right(p, 3)) as integer) > 255)) = 0 group by r),
    cards as (select r, regexp_replace(unnest(regexp_extract_all(t, '[0-9]([ -]?[0-9])+')), '[ -]', '', 'g') as g from t),
    card as (select r, count(*) as n from cards where length(g) between 14 and 19 and list_sum(list_transform({digits}, lambda d: case when d > 9 then d - 9 else d end)) % 10 = 0 group by r),
    phones as (select r, regexp_replace(unnest(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]')), '[^0-9]', '', 'g') as g from t),
    phone as (select r, count(*) as n from phones where length(g) between 10 and 15 group by r)
    select doc_id, cast(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as bigint) as n_email, cast(coalesce(ip.n, 0) as bigint) as n_ip, cast(coalesce(card.n, 0) as bigint) as n_card, cast(coalesce(phone.n, 0) as bigint) as n_phone
    from t left join ip using (r) left join card using (r) left join phone using (r)"""
