"""Registered queries of functions that are told apart by cases: spellings, answers, gates, prompts, orders.

Every row of a table takes one of the stated cases, in turn, mostly together with its own text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalogue as c
from .catalogue import collapse_sql, query
from .functions import labels as L
from .functions import text as T
from .functions.jsonx import first_array_udf, judge_object_udf, llm_object_udf
from .operators import metrics, payloads, present, rules, samples, snippets
from .plans import generate
from .session import table
from .sources import readers, sinks

#: (rows of a table as id and own text) in Spark, and the same in SQL.
SOURCES = {
    "documents": (lambda t: t.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("own")), "(select doc_id as id, coalesce(text, '') as own from documents)"),
    "conversations": (lambda t: t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("own")), "(select conv_id * 1000 + turn as id, coalesce(text, '') as own from conversations)"),
    "events": (lambda t: t.select(F.col("event_id").alias("id"), F.col("props").alias("own")), "(select event_id as id, props as own from events)"),
}


def dealt(spark: SparkSession, sf: str, rows: list[tuple], schema: str, source: str = "documents") -> DataFrame:
    """id and own text of every row of a table, with one of the cases."""
    cases = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"case_n int, {schema}")
    of = SOURCES[source][0](table(spark, sf, source)).filter("id is not null")
    return of.withColumn("case_n", (F.col("id") % len(rows)).cast("int")).join(F.broadcast(cases), "case_n").drop("case_n")


def literal(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool | int | float):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(literal(y) for y in x) + "]" if x else "cast([] as varchar[])"
    return "'" + "' || chr(10) || '".join(str(x).replace("'", "''").split("\n")) + "'"


def dealt_sql(name: str, rows: list[tuple], columns: str, source: str = "documents") -> str:
    values = ", ".join(f"({n}, {', '.join(literal(x) for x in r)})" for n, r in enumerate(rows))
    return f"{name} as (select d.id, d.own, v.* exclude (case_n) from {SOURCES[source][1]} d join (values {values}) v(case_n, {columns}) on d.id % {len(rows)} = v.case_n)"


# --- labels and scalars ------------------------------------------------------------------------

SPELT = [(x,) for x in [*c.SPELLINGS, None]]


def _dialect(name: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return dealt(spark, sf, SPELT, "x string").select("id", "x", L.normalise(F.col("x"), name).alias("label"))

    f.__name__ = f"label_normalise_{name}"
    replaced, case = c._LABEL_SQL[name]
    query(f"with {dealt_sql('s', SPELT, 'x')}, n as (select id, x, {c._T[replaced]} as t from s) select id, x, {case} as label from n")(f)


for _name in c._LABEL_SQL:
    _dialect(_name)


def _override_sql() -> str:
    case = ""
    for f in L.FAMILIES:
        satisfied = " or ".join("(" + " and ".join(c._like("t", g) for g in groups) + ")" for groups in f["for"])
        case += f" when {c._like('a', f['anchor'])} and {c._like('t', f['against'])} then 'Non-Compliant' when {c._like('a', f['anchor'])} and ({satisfied}) then 'Compliant'"
    fam = " ".join(f"when {c._like('a', f['anchor'])} then '{f['name']}'" for f in L.FAMILIES)
    return f"with {dealt_sql('s', c.OVERRIDE_ROWS, 'anchor, said')}, n as (select *, lower(trim(anchor)) as a, lower({collapse_sql("concat(said, ' ', own)")}) as t from s) select id, anchor, case {case} end as label, case {fam} else 'other' end as family from n"


@query(_override_sql())
def keyword_override(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase of the families' terms before every document's whole text."""
    s = dealt(spark, sf, c.OVERRIDE_ROWS, "anchor string, said string")
    return s.select("id", "anchor", L.keyword_override(F.col("anchor"), F.concat("said", F.lit(" "), "own")).alias("label"), L.family(F.col("anchor")).alias("family"))


SCALARS = [(x,) for x in c.SCALARS]
_ROLE_STEPS = ""
_before = "p0"
for _n, _p in enumerate(T.ROLE_PREFIXES, 1):
    _ROLE_STEPS += f", p{_n} as (select id, x, case when starts_with(lower(o), '{_p}') then {c.strip_sql(f'substr(o, {len(_p) + 1})')} else o end as o from {_before})"
    _before = f"p{_n}"


@query(
    f"with {dealt_sql('s', SCALARS, 'said', 'conversations')}, p0 as (select id, concat(said, own) as x, {c.strip_sql('concat(said, own)')} as o from s){_ROLE_STEPS}"
    rf" select id, {c.strip_sql("regexp_replace(o, '\r\n|[\n\r\x0B\f]', ' ', 'g')")} as turn, {c.strip_sql("regexp_replace(x, '(?is)<think>.*?</think>', '', 'g')")} as bare from {_before}"
)
def scalar_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn with a role or thoughts in front."""
    x = F.concat("said", "own")
    return dealt(spark, sf, SCALARS, "said string", "conversations").select("id", T.single_turn(x).alias("turn"), T.strip_think(x).alias("bare"))


NUMBERS = [(x,) for x in [*c.NUMBERS, None]]


@query(
    f"with {dealt_sql('s', NUMBERS, 'x', 'events')}, n as (select id, x, try_cast(x as double) as d, case when regexp_matches(x, '^-?[0-9]+$') then try_cast(x as integer) end as i from s)"
    " select id, least(0.75, greatest(0.0, least(1.0, case when coalesce(d, 0) > 1 then d / 100 else coalesce(d, 0) end))) as conf, greatest(1, coalesce(nullif(i, 0), 1)) as weight, round(1 / (1 + exp(-coalesce(d, 0.0) / 100)), 6) as sig from n"
)
def scalar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    s = dealt(spark, sf, NUMBERS, "x string", "events")
    return s.select("id", T.confidence(F.col("x"), 0.0, 0.75).alias("conf"), T.weight(F.col("x")).alias("weight"), F.round(T.sigmoid(T.score_or(F.col("x")) / 100), 6).alias("sig"))


@query("with g as (select source, lang, round(avg(quality), 6) as candidate, case when lang <> 'es' then round(avg(case when n_chars > 1000 then 1 else 0 end), 6) end as active from documents join labels using (doc_id) group by source, lang) select source, lang, active is null or candidate >= active - 1e-9 as promoted from g")
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The share of good documents against that of long ones, by source and language; one language has no measure in use."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    g = d.groupBy("source", "lang").agg(F.round(F.avg("quality"), 6).alias("candidate"), F.round(F.avg(F.when(F.col("n_chars") > 1000, 1).otherwise(0)), 6).alias("active"))
    return g.select("source", "lang", metrics.promote(F.col("candidate"), F.when(F.col("lang") != "es", F.col("active"))).alias("promoted"))


ANCHORS = [r[1:] for r in c.ANCHOR_ROWS]


@query(
    f"""with {dealt_sql('a', ANCHORS, 'anchor, prompt_index, disclaimer_id')},
    r(rid, txt, lst) as (values ('101', 'the of and by', null), ('102', null, ['der die und', 'in zu von']), ('103', null, ['le la des', 'qui que dans']), ('104', null, ['the and', 'is that with', 'les une']), ('105', null, []))
    select id, coalesce(nullif(trim(anchor), ''), txt, case when try_cast(prompt_index as integer) >= 0 then lst[try_cast(prompt_index as integer) + 1] end) as resolved from a left join r on rid = disclaimer_id"""
)
def anchor_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The anchor of every document as a training row of one of the rules."""
    a = dealt(spark, sf, ANCHORS, "anchor string, prompt_index string, disclaimer_id string").drop("own")
    return rules.resolve_anchor(a, c.demo_rules(spark)).select("id", "resolved")


# --- generated text ----------------------------------------------------------------------------


def _snippet_parts() -> tuple[Column, Column]:
    """What a generator made of a turn: its label, and its text with the faults that checks look for."""
    n, text = F.pmod(F.col("turn"), F.lit(6)), F.coalesce("text", F.lit(""))
    label = F.when(n == 1, "compliant").when(n == 2, "Non-Compliant").otherwise("Compliant")
    return label, F.when(n == 3, F.concat(F.lit("Agent: "), text)).when(n == 4, F.concat(F.lit("so client: "), text)).when(n == 5, F.lit("too short")).otherwise(text)


def snippet_answers(spark: SparkSession, sf: str) -> DataFrame:
    """answer_id, answer: one JSON array for each conversation, with an item for each turn; items of system turns have a key too many."""
    label, text = _snippet_parts()
    t = table(spark, sf, "conversations").filter("turn is not null").select("conv_id", "turn", F.when(F.col("role") == "system", F.to_json(F.struct(label.alias("label"), text.alias("text"), F.lit(1).alias("more")))).otherwise(F.to_json(F.struct(label.alias("label"), text.alias("text")))).alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"])
    return t.groupBy(F.col("conv_id").cast("string").alias("answer_id")).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("answer"))


_ONE_TURN = "sx as (select *, " + c.strip_sql("said") + " as o0 from sn)"
for _n, _p in enumerate(T.ROLE_PREFIXES, 1):
    _ONE_TURN += f", s{_n} as (select *, case when starts_with(lower(o{_n - 1}), '{_p}') then {c.strip_sql(f'substr(o{_n - 1}, {len(_p) + 1})')} else o{_n - 1} end as o{_n} from {'sx' if _n == 1 else f's{_n - 1}'})"
_SNIPPETS = rf"""with sn as (select cast(conv_id as varchar) as answer_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as pos, role, case turn % 6 when 1 then 'compliant' when 2 then 'Non-Compliant' else 'Compliant' end as label,
      case turn % 6 when 3 then 'Agent: ' || coalesce(text, '') when 4 then 'so client: ' || coalesce(text, '') when 5 then 'too short' else coalesce(text, '') end as said from conversations where turn is not null),
    {_ONE_TURN}, tx as (select answer_id, pos, role, label, {c.strip_sql(f"regexp_replace(o{len(T.ROLE_PREFIXES)}, '\r\n|[\n\r\x0B\f]', ' ', 'g')")} as text from s{len(T.ROLE_PREFIXES)}),
    jd as (select answer_id, pos, case when role <> 'system' then label end as label, case when role <> 'system' then text end as text, case when role = 'system' then 'schema' when label = 'compliant' then 'label' when regexp_matches(lower(text), 'client:|rm:|advisor:|agent:') then 'multi_speaker'
      when len({c.words_sql('text')}) < 5 then 'too_short' when len({c.words_sql('text')}) > 60 then 'kept_long' else 'kept' end as reason from tx)"""


@query(f"{_SNIPPETS} select * from jd")
def snippet_filter(spark: SparkSession, sf: str) -> DataFrame:
    return snippets.judged_snippets(snippet_answers(spark, sf))


@query(f"{_SNIPPETS} select answer_id, count(*) as input_len, count(*) filter (where reason in ('kept', 'kept_long')) as kept, count(*) filter (where reason = 'schema') as dropped_schema, count(*) filter (where reason = 'label') as dropped_label, count(*) filter (where reason = 'multi_speaker') as dropped_multi_speaker, count(*) filter (where reason = 'too_short') as dropped_too_short, count(*) filter (where reason = 'kept_long') as kept_too_long from jd group by answer_id")
def snippet_stats(spark: SparkSession, sf: str) -> DataFrame:
    return snippets.snippet_stats(snippets.judged_snippets(snippet_answers(spark, sf)))


@query("select doc_id, doc_id % 7 <> 0 and quality = 1 and doc_id % 12 >= 9 as accepted from labels")
def judge_accept(spark: SparkSession, sf: str) -> DataFrame:
    """A judgement for every label: good ones pass, scores go from 0 to 11, and a seventh is broken."""
    said = F.to_json(F.struct((F.col("quality") == 1).alias("pass"), (F.col("doc_id") % 12).alias("score")))
    return table(spark, sf, "labels").select("doc_id", snippets.judge_accepts(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("["), said)).otherwise(said)).alias("accepted"))


@query(
    """with p(scenario, system_instruction, prompt_index, user_prompt) as (values ('Calm', 'be calm', 0, 'one'), ('Busy', 'be brisk', 0, 'two'), ('Busy', 'be brisk', 1, 'three'), ('Own', '', 0, null)), d as (select doc_id, cast(doc_id as varchar) as rule_id, md5(coalesce(text, '')) as own from documents)
    select rule_id, scenario, system_instruction, prompt_index, coalesce(user_prompt, own) as user_prompt from d, p where not (scenario = 'Busy' and prompt_index = 0 and doc_id % 2 = 0) and not (scenario = 'Own' and doc_id % 3 = 0)"""
)
def resume_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of four prompts for every document, two of which are done for some."""
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("rule_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own"))
    scenes = '": {"Calm": {"system_instruction": "be calm", "user_prompt": "one"}, "Busy": {"system_instruction": "be brisk", "user_prompt": ["two", " ", "three"]}, "x_qa": {"user_prompt": "no"}, "Odd": {"user_prompt": 5}, "Own": {"user_prompt": "'
    p = rules.prompts(d.select(F.concat(F.lit('{"'), "rule_id", F.lit(scenes), "own", F.lit('"}}}')).alias("value")))
    done = lambda n, scenario: d.filter(f"doc_id % {n} = 0").select("rule_id", F.lit(scenario).alias("scenario"), F.lit(0).alias("prompt_index"))
    return snippets.remaining(p, done(2, "Busy").unionByName(done(3, "Own"))).select("rule_id", "scenario", "system_instruction", "prompt_index", "user_prompt")


WRAPPED = [("x [", "] y [3]"), ("```json\n", "\n```"), ("<think>[0]</think> ", " tail"), ("", ""), ("[1, ", ""), ("so {", "")]


@query(
    f"with {dealt_sql('s', WRAPPED, 'before, behind')}, n as (select id, before, md5(own) as h from s)"
    " select id, case before when 'x [' then h end as in_array, case when before in ('x [', '```json' || chr(10), '<think>[0]</think> ', '', '[1, ') then h end as in_object, case when before in ('x [', '```json' || chr(10), '<think>[0]</think> ', '', '[1, ') then h end as in_answer from n"
)
def json_extract_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """An object about every document's text, in the wrappings that models put around JSON, as each scanner finds it."""
    x = F.concat("before", F.lit('{"h": "'), F.md5(F.col("own").cast("binary")), F.lit('", "odd": "}\\"]"}'), "behind")
    found = dealt(spark, sf, WRAPPED, "before string, behind string").select("id", first_array_udf(x).alias("a"), judge_object_udf(x).alias("o"), llm_object_udf(x).alias("l"))
    return found.select("id", F.get_json_object("a", "$[0].h").alias("in_array"), F.get_json_object("o", "$.h").alias("in_object"), F.get_json_object("l", "$.h").alias("in_answer"))


# --- tables that people edit -------------------------------------------------------------------


@query("select d.doc_id as pos, case when l.doc_id is null then 'Compliant' when l.doc_id % 5 = 0 then '' when quality = 1 then 'Compliant' else 'Non-Compliant' end as final_label, case when l.doc_id is null then true else l.doc_id % 4 < 2 end as approved from documents d left join labels l using (doc_id)")
def merge_edits(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as review rows, edited where there are labels."""
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.lit("Compliant").alias("final_label"), F.lit(True).alias("approved"))
    label = F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("quality") == 1, "Pass").otherwise("fail")
    said = F.element_at(F.array(*[F.lit(x) for x in ("Yes", " checked", "no", "")]), (F.col("doc_id") % 4).cast("int") + 1)
    return present.merge_edits(items, table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), label.alias("label"), said.alias("approved")))


@query("select doc_id, display in ('Pass', 'Fail') as approved from (select doc_id, case when toxic = 1 then 'Skip' when quality = 1 then 'Pass' else 'Fail' end as display from labels)")
def selected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Approve all rows with a label: toxic documents are skipped."""
    raw = F.when(F.col("toxic") == 1, "unclear").when(F.col("quality") == 1, "compliant").otherwise("non_compliant")
    return table(spark, sf, "labels").select("doc_id", present.select_all(raw).alias("approved"))


@query("with n as (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) select source || '.txt' as name, doc_id as pos, case when n = 1 then source || '.txt' else concat(source, '_', n, '.txt') end as \"unique\" from n")
def source_upload_names(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files named by their source."""
    return readers.distinct_names(table(spark, sf, "documents").select(F.concat("source", F.lit(".txt")).alias("name"), F.col("doc_id").alias("pos")))


# --- investigations ----------------------------------------------------------------------------


def _outcomes_sql(old: str) -> str:
    """The catalogue's SQL over dealt answers."""
    return old.replace(f"with {c._ANSWERED},", f"with {dealt_sql('a', c.ANSWERED, 'answer, causes')},").replace("select answer, array_to_string(causes", "select id, answer, array_to_string(causes")


def _outcomes(name: str, of) -> None:  # noqa: ANN001
    def f(spark: SparkSession, sf: str) -> DataFrame:
        rows = dealt(spark, sf, c.ANSWERED, "answer string, causes array<string>")
        return rows.select("id", "answer", F.array_join("causes", ",").alias("causes"), of(F.col("answer"), F.col("causes")).alias("outcome"))

    f.__name__ = name
    query(_outcomes_sql(c.OUTCOME_SQL[name]))(f)


_outcomes("investigated_outcomes", samples.outcome)
_outcomes("regressed_outcomes", samples.regression_outcome)

GAPS = [r[1:] for r in c.GAPS]
GAP_SCHEMA = c.GAP_SCHEMA.split(", ", 1)[1]


def gap_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as cases; case is which of the stated ones."""
    return dealt(spark, sf, [(n, *r) for n, r in enumerate(GAPS, 1)], f"gap int, {GAP_SCHEMA}").withColumnRenamed("id", "item_id").drop("own")


def _for_gaps(spark: SparkSession, sf: str, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of cases (gap first) for all documents of that case."""
    given = spark.createDataFrame(rows, f"gap int, {schema}")
    return gap_items(spark, sf).select("item_id", "gap").join(F.broadcast(given), "gap").drop("gap")


def _gaps_sql(old: str, columns: str) -> str:
    """What the catalogue states for each case, for all documents of that case."""
    return f"with e as ({old}) select d.doc_id as item_id, {columns} from documents d join e on e.item_id = d.doc_id % {len(GAPS)} + 1"


@query(_gaps_sql(c.GAP_SQL["gap_samples"], "n, e.text, e.source"))
def gap_samples(spark: SparkSession, sf: str) -> DataFrame:
    items = gap_items(spark, sf).withColumn("outcome", F.when(F.col("gap") == 4, "possible_label_noise").otherwise("missing_coverage")).drop("gap")
    answers = _for_gaps(spark, sf, c.GAP_TEXTS, "pos int, text string")
    return samples.samples(items, answers)


@query(_gaps_sql(c.GAP_SQL["investigations"], "outcome, rationale, causes, n_samples, e.source, recommendation"))
def investigations(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.investigate(gap_items(spark, sf).drop("gap"), _for_gaps(spark, sf, c.GAP_ANSWERS, "answer string"))
    return out.select("item_id", "outcome", "rationale", F.array_join("causes", ",").alias("causes"), F.size("samples").alias("n_samples"), "source", "recommendation")


@query(_gaps_sql(c.GAP_SQL["investigated_regressions"], "outcome, rationale, recommendation"))
def investigated_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return samples.investigate_regressions(gap_items(spark, sf).drop("gap"), _for_gaps(spark, sf, c.GAP_ANSWERS, "answer string"))


@query(f"with {dealt_sql('a', c.GATES, 'mode, models_exist, metric')}, e as ({c.GATE_SQL}) select a.id, a.mode, a.models_exist, cast(a.metric as decimal(6, 5)) as metric, e.status, e.message from a join e on a.mode is not distinct from e.mode and a.models_exist = e.models_exist and a.metric is not distinct from e.metric")
def training_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = dealt(spark, sf, c.GATES, "mode string, models_exist boolean, metric double")
    return rows.withColumn("g", metrics.training_gate(F.col("mode"), F.col("models_exist"), F.col("metric"))).select("id", "mode", "models_exist", F.col("metric").cast("decimal(6,5)").alias("metric"), "g.status", "g.message")



@query(f"with e as ({c.CHAT_SQL}) select d.id, e.answer from {SOURCES['conversations'][1]} d join e on e.id = d.id % {len(c.QUESTIONS)} + 1")
def chat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A question for every turn of all conversations."""
    rows = dealt(spark, sf, [r[1:] for r in c.QUESTIONS], "question string, n_items int, said string", "conversations")
    return rows.select("id", present.chat_answer(F.col("question"), F.col("n_items"), F.lit("SUM"), F.lit("SUGGESTED"), F.lit("EXPLAINED"), F.col("said")).alias("answer"))


PAYLOADS = [('{"results":{"', '":{"status":"PASS"}},"x":1}'), ('{"', '":{"status":"FAIL"}}'), ('{"results":["', '"]}')]


@query("with d as (select doc_id as id, md5(coalesce(text, '')) as h from documents) select id, case id % 3 when 0 then '{\"' || h || '\":{\"status\":\"PASS\"}}' when 1 then '{\"' || h || '\":{\"status\":\"FAIL\"}}' else '{\"results\":[\"' || h || '\"]}' end as results from d")
def results_only(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads about every document, bare or within their envelope."""
    rows = dealt(spark, sf, PAYLOADS, "before string, behind string")
    return rows.select("id", present.results_only(F.concat("before", F.md5(F.col("own").cast("binary")), "behind")).alias("results"))


_AUDIT = """with r as (select source as rule_id, lang as anchor_key, case when quality = 1 then 'Compliant' else 'Non-Compliant' end as label, doc_id as pos, md5(coalesce(text, '')) as dialogue, md5(concat('11|', doc_id)) as h from documents join labels using (doc_id)),
    k as (select *, row_number() over (partition by rule_id, anchor_key, label order by h, pos) as rank from r),
    i as (select rule_id, anchor_key, count(*) filter (where label = 'Compliant') as n_pass, count(*) filter (where label <> 'Compliant') as n_fail, coalesce(string_agg(dialogue, ',' order by rank) filter (where label = 'Compliant' and rank <= 4), '') as positives, coalesce(string_agg(dialogue, ',' order by rank) filter (where label <> 'Compliant' and rank <= 4), '') as negatives from k group by rule_id, anchor_key),
    t as (select *, case when n_pass < 2 or n_fail < 2 then 'gap' else 'covered' end as heuristic, length(rule_id || anchor_key) % 3 as turn from i)"""


def audit_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as a pool; the hash of the whole text stands for it."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("source").alias("rule_id"), F.col("lang").alias("anchor_key"), L.from_bit(F.col("quality")).alias("label"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("dialogue"), F.col("doc_id").alias("pos"))


@query(f"{_AUDIT} select rule_id, anchor_key, n_pass, n_fail, positives, negatives, heuristic from t")
def audit_samples(spark: SparkSession, sf: str) -> DataFrame:
    """What a labeller is shown of each anchor's examples."""
    i = samples.audit_inputs(audit_pool(spark, sf))
    return i.select("rule_id", "anchor_key", "n_pass", "n_fail", F.array_join("positives", ",").alias("positives"), F.array_join("negatives", ",").alias("negatives"), "heuristic")


@query(
    f"""{_AUDIT} select rule_id, anchor_key, n_pass, n_fail, case turn when 0 then 'gap' else heuristic end as coverage_status, case turn when 0 then 'fine' else case when n_pass >= 2 then 'Positive pool size is acceptable.' else 'Positive pool is still thin.' end end as positive_quality_note,
    case when n_fail >= 2 then 'Negative pool size is acceptable.' else 'Negative pool is still thin.' end as negative_quality_note, case turn when 0 then 'labeller' else 'heuristic' end as source from t"""
)
def dataset_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audits of all anchors: a third have an answer, a third an answer with another status, a third none."""
    i = samples.audit_inputs(audit_pool(spark, sf))
    turn = F.length(F.concat("rule_id", "anchor_key")) % 3
    said = F.when(turn == 0, 'Well: {"coverage_status": " GAP ", "positive_quality_note": "fine ", "generated_variants": ["x"]}').when(turn == 1, '{"coverage_status": "unsure"}')
    return samples.audited(i, i.filter(said.isNotNull()).select(F.concat_ws(":", "rule_id", "anchor_key").alias("key"), said.alias("answer")))


# --- orders and rules --------------------------------------------------------------------------


@query("with r as (select distinct cast(n_chars % 97 as varchar) as rule_id from documents union select distinct source from documents union select distinct lang from documents) select rule_id, cast(row_number() over (order by try_cast(rule_id as bigint) is null, try_cast(rule_id as bigint), rule_id) as integer) as n, cast(row_number() over (order by rule_id) as integer) as by_text from r")
def rule_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rules named by numbers, sources and languages of the documents, some hundred in all."""
    d = table(spark, sf, "documents")
    rows = d.select(F.explode(F.array((F.col("n_chars") % 97).cast("string"), "source", "lang")).alias("rule_id")).filter("rule_id is not null").distinct()
    return rows.select("rule_id", F.row_number().over(Window.orderBy(*T.rule_order(F.col("rule_id")))).alias("n"), F.row_number().over(Window.orderBy("rule_id")).alias("by_text"))


@query("with r as (select distinct concat(n_chars % 13, '.', n_chars % 7) as scenario from documents union select distinct cast(n_chars % 13 as varchar) from documents union select distinct source from documents) select scenario, cast(row_number() over (order by not regexp_matches(scenario, '^[0-9]+(\\.[0-9]+)*$'), case when regexp_matches(scenario, '^[0-9]+(\\.[0-9]+)*$') then list_transform(string_split(scenario, '.'), lambda p: cast(p as bigint)) end, scenario) as integer) as n from r")
def scenario_order(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf, "documents").select(F.explode(F.array(F.concat_ws(".", (n % 13).cast("string"), (n % 7).cast("string")), (n % 13).cast("string"), "source")).alias("scenario")).distinct()
    return rows.select("scenario", F.row_number().over(Window.orderBy(*T.dotted_order(F.col("scenario")))).alias("n"))


_ANCHOR_JSON = {"en": '"the of and by"', "de": '{"mandatory": ["der die und", " ", "in zu von"], "standard": []}', "fr": '{"mandatory": [], "standard": ["le la des", "qui que dans"]}', "es": "null"}


def table_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for every source and language of the documents."""
    d = table(spark, sf, "documents").select("source", "lang").distinct()
    anchor = F.element_at(F.create_map(*[F.lit(x) for kv in _ANCHOR_JSON.items() for x in kv]), F.col("lang"))
    body = F.concat(F.lit('{"Theme": "'), "source", F.lit('", "Description": "speaks '), "lang", F.lit('", "Purpose_of_control": "language", "Criteria": "'), "lang", F.lit(' words", "anchor": '), anchor, F.lit("}"))
    return rules.parse_rules(d.select(F.concat(F.lit('{"'), "source", F.lit("-"), "lang", F.lit('": '), body, F.lit("}")).alias("value")))


_TABLE_RULES = "tr as (select distinct source, lang, source || '-' || lang as rule_id from documents where lang in ('en', 'de', 'fr', 'es'))"


@query(f"with {_TABLE_RULES}, a(lang, claim_type, claim_ord, anchor) as (values ('en', 'single', 0, 'the of and by'), ('de', 'mandatory', 0, 'der die und'), ('de', 'mandatory', 2, 'in zu von'), ('fr', 'standard', 0, 'le la des'), ('fr', 'standard', 1, 'qui que dans'), ('es', 'single', 0, 'es words')) select rule_id, claim_type, claim_ord, anchor from tr join a using (lang)")
def claim_index(spark: SparkSession, sf: str) -> DataFrame:
    return rules.claims(table_rules(spark, sf)).select("rule_id", "claim_type", "claim_ord", "anchor")


@query(f"with {_TABLE_RULES}, l(lang, listed) as (values ('en', '- the of and by'), ('de', concat('- der die und', chr(10), '- in zu von')), ('fr', ''), ('es', '- ')) select rule_id, 'speaks ' || lang as description, concat('Description: speaks ', lang, chr(10), 'Purpose: language', chr(10), 'Criteria: ', lang, ' words', chr(10), 'Anchor meanings that count as compliant:', chr(10), listed) as rubric from tr join l using (lang)")
def rule_rubrics(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rubric(table_rules(spark, sf))


@query(f"with {_TABLE_RULES} select rule_id from tr where lang <> 'de' and source = (select min(source) from documents)")
def included_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the first source, but for one language."""
    every = table_rules(spark, sf)
    first = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    return rules.select_rules(every, include=[f"{first}-{x}" for x in ("en", "de", "fr", "es", "none")], exclude=[f"{first}-de"]).select("rule_id")


# --- generation --------------------------------------------------------------------------------


def _model(system: str, prompt: str, hint: str, number: int) -> str:
    """A stand-in for a generator: half of the prompts succeed at once, a quarter once they are told why they failed."""
    d = int(prompt[-1], 16)
    if d < 8 or (d < 12 and number and hint):
        return json.dumps([{"label": "Compliant", "text": f"{prompt} one two three four"}, {"label": "Non-Compliant", "text": f"Agent: {prompt} five six seven eight"}, {"label": "odd", "text": "dropped"}])
    return "no json"


def _supervisor(system: str, prompt: str, answer: str) -> str:
    """A stand-in for a judge: it refuses what a quarter of prompts give."""
    return json.dumps({"pass": True, "score": 5 if prompt[-2] in "0123" else 9 + int(prompt[-1], 16) % 2, "violations": [], "notes": "shorter"})


_GENERATED = """with p as (select source as rule_id, lang as scenario, doc_id as prompt_index, md5(coalesce(text, '')) as h from documents), q as (select *, cast('0x' || right(h, 1) as integer) as d, substr(h, 31, 1) in ('0', '1', '2', '3') as refused from p),
    a as (select *, case when d < 8 then 0 else 1 end as round from q where d < 12 and not refused), i(type, before, behind) as (values ('compliant', '', ' one two three four'), ('non-compliant', '', ' five six seven eight'))"""


@query(f"{_GENERATED} select rule_id, scenario, cast(prompt_index as integer) as prompt_index, type, h || behind as dialogue, 3 as source_batch_size, 2 as kept_after_filter, cast(9 + d % 2 as integer) as supervisor_score, round from a, i")
def generated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows made for a prompt of every document, in rounds with hints and a judge."""
    d = table(spark, sf, "documents")
    p = d.select(F.col("source").alias("rule_id"), F.col("lang").alias("scenario"), F.col("doc_id").cast("int").alias("prompt_index"), F.lit("").alias("system_instruction"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("user_prompt"))
    out = c._folder(spark, "generated")
    generate.generate(p, _model, out, least_kept=2, rounds=2, judge=_supervisor)
    return generate.rows_of(spark, out)


# --- payloads of tables ------------------------------------------------------------------------


def table_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A table of two rows about every labelled document, in one of six shapes."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    yes, score = F.when(F.col("toxic") == 1, "no").otherwise("Yes"), F.col("n_chars").cast("string")
    model, human = F.when(F.col("quality") == 1, "Pass").otherwise("fail"), F.when(F.col("doc_id") % 5 == 0, "").when(F.col("quality") == 1, "fail").otherwise("compliant")
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    cells = {"add": yes, "rule": F.col("source"), "score": score, "text": h, "model_label": model, "qwen_label": F.lit("Skip"), "final_label": human}
    seven = F.array(*cells.values())
    eight = F.array(yes, F.col("source"), score, F.col("lang"), h, model, F.lit("Skip"), human)
    nine = F.array(yes, F.lit("t"), F.col("source"), score, h, model, F.lit("Skip"), human, F.lit("beyond"))
    bare = F.struct(*[x.alias(n) for n, x in cells.items()])
    twice = lambda x: F.to_json(F.array(x, x))
    heads = F.to_json(F.array(*[F.lit(n) for n in cells]))
    objects = F.concat(F.lit("["), *[F.lit(f'{", " if i else ""}{{"{"name" if i % 2 else "id"}": " {n} "}}') for i, n in enumerate(cells)], F.lit("]"))
    kind = F.col("doc_id") % 6
    payload = (
        F.when(kind == 0, twice(bare)).when(kind == 1, twice(eight)).when(kind == 2, F.concat(F.lit("[7, "), F.to_json(seven), F.lit(", "), F.to_json(nine), F.lit("]")))
        .when(kind == 3, F.concat(F.lit('{"headers": [], "columns": '), heads, F.lit(', "data": '), twice(seven), F.lit("}")))
        .when(kind == 4, F.concat(F.lit('{"headers": '), objects, F.lit(', "data": '), twice(seven), F.lit("}"))).otherwise(F.concat(F.lit('{"data": '), twice(bare), F.lit("}")))
    )
    return d.select(F.col("doc_id").alias("id"), payload.alias("payload"))


@query(
    """select doc_id as id, cast(n as integer) as row_n, toxic <> 1 as approved, source as rule_id, cast(n_chars as double) as score, md5(coalesce(text, '')) as text, case when quality = 1 then 'Compliant' else 'Non-Compliant' end as model_label, '' as reviewer_label,
    case when doc_id % 5 = 0 then case when quality = 1 then 'Compliant' else 'Non-Compliant' end when quality = 1 then 'Non-Compliant' else 'Compliant' end as final_label from documents join labels using (doc_id), (values (0), (1)) r(n)"""
)
def table_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Review rows of payloads of all shapes, which say the same."""
    return payloads.review_rows(payloads.records(table_payload(spark, sf)))


# --- measures and tables that had no query of their own ----------------------------------------


@query(
    f"""with y as ({c._metrics_sql("lang")}), {c._LAB}, k as (select * from lab qualify row_number() over (partition by lang order by doc_id) <= 4),
    x as (select lang, string_agg(concat(doc_id, ':', expected, ':', predicted, ':', md5(coalesce(text, ''))), ',' order by doc_id) as examples from k group by lang) select y.*, examples from y left join x using (lang)"""
)
def anchor_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The measures of each language with its first four documents."""
    rows = c._labelled(spark, sf).withColumns({"pos": F.col("doc_id"), "phrase": F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    said = F.transform("examples", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["expected"], x["predicted"], x["phrase"]))
    return metrics.with_examples(rows, ["lang"]).withColumn("examples", F.array_join(said, ","))


@query("select doc_id, case when quality = 1 then cast(n_chars as double) else least(try_cast(source as double), cast(toxic as double), cast(n_chars as double) / 10) end as cell from (select doc_id, quality, toxic, n_chars, '0' as source from documents join labels using (doc_id))")
def rule_cells(spark: SparkSession, sf: str) -> DataFrame:
    """What a table shows for a rule: its score, or the least of its claims' where it has none."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    score = F.when(F.col("quality") == 1, F.col("n_chars").cast("string")).otherwise("n/a")
    claims = F.array(F.lit("none"), F.col("toxic").cast("string"), (F.col("n_chars") / 10).cast("string"))
    return d.select("doc_id", present.rule_cell(score, claims).alias("cell"))


@query("select doc_id, case when quality = 1 then 'train' else 'test' end as split from labels")
def split_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written by split and read again."""
    f = c._folder(spark, "split")
    sinks.write_split(table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split")), f)
    return spark.read.parquet(f).select("doc_id", "split")
