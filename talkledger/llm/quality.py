"""Quality classifier: a sparse ensemble of rules (operator 6).

Statistics of a text are Spark columns. Small boosted trees are grown on a bounded sample
of labelled rows; each path from a root to a node is a conjunctive rule; a logistic
regression with an L1 penalty weighs the rules, most of them zero; the rest are compiled
into one column expression, so scoring is a projection without Python.

The fit takes at most `sample` labelled rows, those with the smallest hash of their id: a
parameter, 20,000 by default. It only learns from rows with crc32(id as text) mod 5 <> 0.
Neither labels, lang, source nor ids are inputs of a score.

Defined cases: null and empty texts have zeros for statistics and a score like others;
labels that are null, or whose document is missing, are not learnt from; without labels, or
with one class only, all scores are the share of ones, smoothed; an id is learnt from once, by the
least of its labels and of its documents' statistics; repeated rows are scored as any other; null ids are never held out and never learnt from; an empty table gives an empty
result; other columns are handed through by `keep_good`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.3, 20
PENALTY = 0.002
THRESHOLD = 0.3
FEATURES = ("n_chars", "n_words", "word_len", "upper", "symbols", "digits", "marks", "bars", "again", "ends", "lines", "fresh")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name; all of them finite doubles."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(count(r"\S+"), F.lit(1.0))
    found = {
        "n_chars": F.log1p(F.length(t).cast("double")),
        "n_words": F.log1p(words),
        "word_len": count(r"\S") / words,
        "upper": count(r"\p{Lu}") / chars,
        "symbols": count(r"[^\p{L}\p{N}\s]") / chars,
        "digits": count(r"[0-9]") / chars,
        "marks": count(r"([!%*#&$?~^=_<>@])\1") / words,
        "bars": count(r"(?<!\S)[|/\\•·–-](?!\S)") / words,
        "again": count(r"(?<!\S)(\S+)\s+(?=\1(?!\S))") / words,
        "ends": count(r"[.!?](?=\s|$)") / words,
        "lines": count(r"\n") / words,
        "fresh": F.size(F.array_distinct(F.split(t, r"\s+"))).cast("double") / words,
    }
    return {k: found[k] for k in FEATURES}


def with_statistics(docs: DataFrame) -> DataFrame:
    return docs.withColumns({f"s_{k}": c for k, c in statistics(F.col("text")).items()})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[list[list[tuple[int, bool, float]]], np.ndarray]:
    """The rules of one tree, and its values for the rows. x: bin of each row and feature."""
    out, rules = np.zeros(len(x)), []
    stack = [(np.arange(len(x)), [])]
    while stack:
        rows, path = stack.pop()
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST:
            for f in range(x.shape[1]):
                b = x[rows, f]
                n = np.bincount(b, minlength=BINS).cumsum()[:-1]
                sg, sh = np.bincount(b, g[rows], BINS).cumsum()[:-1], np.bincount(b, h[rows], BINS).cumsum()[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(n < LEAST) | (n > len(rows) - LEAST) | (np.arange(BINS - 1) >= len(edges[f]))] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            out[rows] = -total_g / (total_h + 1)
            continue
        _, f, b = best
        low = x[rows, f] <= b
        for side, part in ((True, rows[low]), (False, rows[~low])):
            rules.append([*path, (f, side, float(edges[f][b]))])
            stack.append((part, rules[-1]))
    return rules, out


def _holds(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= at) == low for f, low, at in rule])


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """{"bias", "rules": [(weight, [(feature, at most, bound)])]} from statistics and labels 0 or 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = {"bias": float(np.log(prior / (1 - prior))), "rules": []}
    if len(y) < 2 * LEAST or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin <= b: value <= edge b
    margin, rules = np.full(len(y), model["bias"]), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, step = _grow(bins, p - y, p * (1 - p), edges)
        margin += RATE * step
        rules |= {tuple(r): r for r in found}
    kept = list(rules.values())
    z = np.stack([_holds(r, x) for r in kept], axis=1).astype(float) if kept else np.zeros((len(y), 0))
    mean = z.mean(axis=0) if kept else np.zeros(0)
    scale = np.maximum(z.std(axis=0), 0.05) if kept else np.ones(0)
    z -= mean  # in place, and its norm by its square: copies of it are the most that a fit has in memory
    z /= scale
    # Proximal gradient steps with momentum on the logistic loss with an L1 penalty.
    w, v, bias, momentum = np.zeros(z.shape[1]), np.zeros(z.shape[1]), model["bias"], 1.0
    rate = 4.0 / (np.linalg.eigvalsh(z.T @ z)[-1] / len(y) + 1) if kept else 1.0
    for _ in range(600):
        p = 1 / (1 + np.exp(-(z @ v + bias)))
        step = v - rate * (z.T @ (p - y)) / len(y)
        bias -= (p - y).mean()
        new = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    weights = w / scale
    used = np.flatnonzero(np.abs(weights) > 1e-4)
    model["bias"] = float(bias - (weights[used] * mean[used]).sum())
    model["rules"] = [(float(weights[i]), kept[i]) for i in used]
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` labelled rows, which are collected with their statistics."""
    chosen = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y")).filter("l_id is not null and y in (0, 1)").filter(~held_out(F.col("l_id")))
    chosen = chosen.groupBy("l_id").agg(F.min("y").alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("l_id"), "l_id").limit(sample))  # bounded by the parameter
    rows = with_statistics(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("l_id")))
    # One row for each id, however often documents repeat it: no more than the sample comes to the driver.
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(*[f"s_{k}" for k in FEATURES])).alias("s")).select("y", "doc_id", "s.*").toArrow().to_pandas()
    rows = rows.sort_values("doc_id")
    return fit(rows[[f"s_{k}" for k in FEATURES]].to_numpy(float), rows["y"].to_numpy(float))


def score_column(model: dict) -> Column:
    """The rules as one expression over the columns s_*."""
    margin = F.lit(model["bias"])
    for weight, rule in model["rules"]:
        holds = None
        for f, low, at in rule:
            test = F.col(f"s_{FEATURES[f]}") <= at if low else F.col(f"s_{FEATURES[f]}") > at
            holds = test if holds is None else holds & test
        margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    model = learn(docs, labels, sample)
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all columns. labelled: what it learns from.

    Null and empty texts are scored like any other; rows that are equal stay or go together; without labels the score is that of no rule."""
    score = score_column(learn(labelled, labels, sample))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    # A filter would be pushed below the statistics, which would then be computed anew for each rule that
    # tests them. A generator isn't: it makes one row of a good document, and none of another.
    kept = with_statistics(packed).select(F.explode(F.slice(F.array("row"), 1, F.when(score >= THRESHOLD, 1).otherwise(0))).alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
