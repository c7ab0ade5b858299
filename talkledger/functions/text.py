"""Scalar text and number functions, all of them built-in expressions.

White space is ASCII's, named explicitly, so that results don't depend on an engine's idea of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\x0B\f]+"
CJK = "[㐀-䶿一-鿿]"
#: Prefixes of speaker roles, in the order in which they are stripped.
ROLE_PREFIXES = ("rm:", "relationship manager:", "agent:", "advisor:")
#: What reasoning that leaked into an answer looks like.
LEAK_MARKERS = (
    "we are given", "rules to follow", "the user is asking", "let me check", "looking at the", "i need to",
    "the current context", "from the context", "let me draft", "we can say", "wait,",
)
#: How such answers start.
LEAK_LEAD = r"(?i)^\s*(?:okay|alright|let me|i need to|the user|looking at|first,|wait,|we need to|we are given|rules to follow|from the context)\b"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}|{SPACE}\z", "")


def collapse(x: Column, lower: bool = False) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    x = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " "))
    return F.lower(x) if lower else x


def words(x: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(x, F.lit("")), SPACE, -1), "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def compact(x: Column, n: int) -> Column:
    """Collapsed, and cut to n characters with dots at the end."""
    c = collapse(x)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("...")))


def preview(x: Column, n: int) -> Column:
    w = words(x)
    head = F.array_join(F.slice(w, 1, n), " ")
    return F.when(F.size(w) > n, F.concat(head, F.lit(" ..."))).otherwise(head)


def normal_speaker(x: Column) -> Column:
    """A speaker's name for comparison: no colon at its end, lower case, single spaces."""
    return collapse(F.regexp_replace(strip(x), r":+\z", ""), lower=True)


def single_turn(x: Column) -> Column:
    """One line without a role in front. The prefixes are tried one after the other, once each."""
    out = strip(F.coalesce(x, F.lit("")))
    for p in ROLE_PREFIXES:
        out = F.when(F.startswith(F.lower(out), F.lit(p)), strip(F.substr(out, F.lit(len(p) + 1)))).otherwise(out)
    return strip(F.regexp_replace(out, r"\r\n|[\n\r\x0B\f]", " "))


def strip_think(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<think>.*?</think>", ""))


def strip_think_open(x: Column) -> Column:
    """As strip_think, also for <thinking>, and for blocks of which only one end is there."""
    out = strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    out = F.when(F.contains(out, F.lit("</think>")), strip(F.regexp_replace(out, r"(?s)^.*?</think>", ""))).otherwise(out)
    return F.when(F.startswith(F.lower(out), F.lit("<think>")), F.lit("")).otherwise(out)


def cjk_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(CJK))


def leaks_reasoning(x: Column) -> Column:
    """Reasoning at the start, or at least two markers in the first 500 characters."""
    answer = strip(F.coalesce(x, F.lit("")))
    head = F.lower(F.substring(answer, 1, 500))
    n = sum((F.contains(head, F.lit(m)).cast("int") for m in LEAK_MARKERS), F.lit(0))
    return (answer != "") & (answer.rlike(LEAK_LEAD) | (n >= 2))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence(x: Column, default: float = 0.0, cap: float = 1.0) -> Column:
    """A number in [0, cap]; values over 1 are percentages."""
    v = F.coalesce(x.try_cast("double"), F.lit(default))
    v = F.when(v > 1, v / 100).otherwise(v)
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))))


def weight(x: Column) -> Column:
    """A whole number of at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.nullif(x.try_cast("int"), F.lit(0)), F.lit(1)))


def score_or(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(x.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def checked(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x.cast("string"))).isin("true", "t", "yes", "y", "1", "checked"), F.lit(False))


def pass_labels(x: Column) -> Column:
    """The set in a comma-separated list, without blanks and NONE."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), strip)
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & (F.upper(p) != "NONE")))


def rule_order(x: Column) -> list[Column]:
    """Numbers first, by value, then names."""
    number = x.try_cast("bigint")
    return [number.isNull(), number, x]


def dotted_order(x: Column) -> list[Column]:
    """Dotted numbers by their parts, then other names."""
    dotted = x.rlike(r"^[0-9]+(?:\.[0-9]+)*\z")
    return [~dotted, F.when(dotted, F.transform(F.split(x, r"\."), lambda p: p.cast("bigint"))), x]


def any_term(x: Column, terms: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t))
