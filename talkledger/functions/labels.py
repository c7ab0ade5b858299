"""Label spellings. One table of dialects, one builder of CASE expressions.

Dialects differ on purpose: sources spell one boolean in different ways, and what one
accepts another rejects."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, strip

PASS, FAIL = "Compliant", "Non-Compliant"


@dataclass(frozen=True)
class Dialect:
    """Rules are tried in order: ("is", values, result), ("has", parts, result) or ("starts", prefix, result)."""

    replace: tuple[str, ...]  # characters that become "-"
    rules: tuple[tuple[str, tuple[str, ...], str], ...]
    otherwise: str | None = ""  # None: the text itself, as it came; "=": as normalised


_YES, _NO = ("pass", "passed", "positive", "compliant", "yes", "true", "1"), ("fail", "failed", "negative", "non-compliant", "noncompliant", "no", "false", "0")
_NON = ("non-compliant", "non compliant", "noncompliant")

#: The spellings that each dialect accepts.
DIALECTS = {
    "review": Dialect(("_", " "), (("is", _YES, PASS), ("is", _NO, FAIL), ("has", ("non-compliant", "noncompliant"), FAIL), ("has", ("compliant",), PASS))),
    "display": Dialect(
        ("_",),
        (("has", _NON, "Fail"), ("has", ("compliant",), "Pass"), ("is", ("pass", "passed", "positive", "yes", "y", "true", "1"), "Pass"), ("is", ("fail", "failed", "negative", "no", "n", "false", "0"), "Fail"), ("is", ("skip", "skipped", "ambiguous", "unclear"), "Skip")),
        None,
    ),
    "reviewer": Dialect(("_",), (("has", _NON, FAIL), ("has", ("compliant",), PASS))),
    "dataset_model": Dialect(("_",), (("is", ("compliant", "positive", "pass"), PASS), ("is", (*_NON, "negative", "fail"), FAIL))),
    "dataset": Dialect(("_",), (("is", ("compliant", "positive", "pass"), PASS), ("is", ("non-compliant", "noncompliant", "negative", "fail"), FAIL))),
    "generator": Dialect(("_", " "), (("is", ("compliant",), "compliant"), ("starts", ("non",), "non-compliant")), "="),
    "triplet": Dialect(("_", " "), (("is", ("compliant", "positive", "pass"), "compliant"), ("is", ("non-compliant", "noncompliant", "negative", "fail"), "non-compliant"))),
    "pair": Dialect(("_", " "), (("is", ("compliant",), "compliant"), ("is", ("non-compliant", "noncompliant"), "non-compliant"))),
    "training": Dialect((), (("is", ("pass", "compliant"), PASS), ("is", ("fail", "non-compliant"), FAIL))),
}


def normalise(x: Column, dialect: str) -> Column:
    d = DIALECTS[dialect]
    raw = F.coalesce(x, F.lit(""))
    text = F.lower(strip(raw))
    for c in d.replace:
        text = F.replace(text, F.lit(c), F.lit("-"))
    out = None
    for how, values, result in d.rules:
        if how == "is":
            test = text.isin(*values)
        else:
            test = F.lit(False)
            for v in values:
                test = test | (F.contains(text, F.lit(v)) if how == "has" else F.startswith(text, F.lit(v)))
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(strip(raw) if d.otherwise is None else text if d.otherwise == "=" else F.lit(d.otherwise))


def from_score(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, F.lit(PASS)).otherwise(F.lit(FAIL))


def from_bit(x: Column) -> Column:
    return F.when(x == 1, F.lit(PASS)).otherwise(F.lit(FAIL))


#: Families of anchors, the terms that contradict them, and those that satisfy them.
#: Each satisfying entry is a list of groups, of each of which one term must occur.
FAMILIES = [
    {
        "name": "change_fee", "anchor": ("change fee",),
        "against": ("no change fee", "no fee", "no change charge", "fee does not apply", "fee that will not apply", "not be a fee", "fee is waived", "without a fee", "already confirmed", "confirmed the change first", "reviewed afterward", "discuss it later", "change fee appears", "fee appears", "after ticketing"),
        "for": [[("change fee", "fee to make the change", "fee for the change", "change charge", "rebooking fee")], [("fee",), ("change",)]],
    },
    {
        "name": "fare_difference", "anchor": ("fare difference", "travel credit"),
        "against": ("no fare difference", "no extra amount", "not pay any extra", "not need to pay", "will not pay", "no travel credit", "not be any travel credit", "will not be any travel credit", "decide later whether", "settled afterward", "fare difference afterward", "work out any fare difference afterward", "fare balance or credit applies", "cost details can be settled afterward", "not sure yet"),
        "for": [[("fare difference", "higher", "lower", "costs more", "more expensive", "cheaper", "extra amount", "travel credit", "credit", "balance")]],
    },
    {
        "name": "identity", "anchor": ("verify your identity first", "reset or unlock"),
        "against": ("do not need to verify", "don't need to verify", "not need to verify", "verification is optional", "verify your identity afterward", "verify your identity after", "after i reset or unlock", "after i unlock your account", "once i unlock your account", "once your account is unlocked", "after reset", "after unlock", "already unlocked", "unlock your account first"),
        "for": [[("verify", "identity", "confirm a couple of details", "confirm some information"), ("before", "first")]],
    },
]


def _has(x: Column, terms: tuple[str, ...]) -> Column:
    """Whether x has any of the terms: one pattern, so that x is evaluated once."""
    return F.contains(x, F.lit(terms[0])) if len(terms) == 1 else x.rlike("|".join(re.escape(t) for t in terms))


def family(anchor: Column) -> Column:
    a = F.lower(strip(F.coalesce(anchor, F.lit(""))))
    out = None
    for f in FAMILIES:
        out = F.when(_has(a, f["anchor"]), F.lit(f["name"])) if out is None else out.when(_has(a, f["anchor"]), F.lit(f["name"]))
    return out.otherwise(F.lit("other"))


def keyword_override(anchor: Column, text: Column) -> Column:
    """A label that follows from key terms alone, else null. Of each family that the anchor belongs to, terms against come first."""
    a, t = F.lower(strip(F.coalesce(anchor, F.lit("")))), collapse(text, lower=True)
    out = F.lit(None).cast("string")
    for f in reversed(FAMILIES):
        satisfied = F.lit(False)
        for groups in f["for"]:
            one = F.lit(True)
            for g in groups:
                one = one & _has(t, g)
            satisfied = satisfied | one
        mine = _has(a, f["anchor"])
        out = F.when(mine & _has(t, f["against"]), F.lit(FAIL)).when(mine & satisfied, F.lit(PASS)).otherwise(out)
    return out
