"""Licence scan by a positional index of rare tokens (operator 8).

Templates of licence wording are indexed: word -> (template, position). Inverse document
frequencies of their words are counted over the whole corpus. A template of L words is in a file
at s if `LEAST_SHARE` of its words, in their order, and all its key phrases stand in the file's words
from s - d to s + L + d (d: `BAND` of L), so words may be left out, changed or put in between.
Of each file and template, the words of highest IDF that the file holds are looked up, as many as
cover more positions than may be missing and `VOTES` more; each occurrence votes for a relative
position. A place with so few votes within d of it can't hold the template; the others are checked
word by word. So the votes lose nothing. The template table is fixed, so what is sent to the
tasks doesn't grow with the corpus: wording of the licences most used, whole where it is short, else
the notices that files carry; a licence that isn't listed has no label.

Base places are those where a listed phrase's words stand consecutively; they stay,
whatever the method adds.

Defined cases: a null text is empty and has no words; ties in IDF go to the word first in
the alphabet; repeated rows are rows as any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wording that licences and their notices use, as they are published: label, wording, key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["this permission notice shall be included", "provided as is"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["without any express or implied warranty", "redistribute it freely"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
]
LEAST_SHARE = 0.75  # of a template's words that must stand in their order
BAND = 0.1  # of its length by which they may be moved, two words at least
VOTES = 3
PHRASE_SCORE = 0.5  # of a file with a base phrase but no template

_TABLE = bytes(
    (c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20) for c in range(256)
)
TOKENS = [t.encode().split() for _, t, _ in TEMPLATES]
POSTINGS: dict[bytes, list[tuple[int, int]]] = {}
for _n, _t in enumerate(TOKENS):
    for _p, _w in enumerate(_t):
        POSTINGS.setdefault(_w, []).append((_n, _p))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and all beyond ASCII; A-Z in lower case."""
    return text.translate(_TABLE).split()


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of each place of a base phrase, by start."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        at, counted, words_before = line.find(needle := b" " + phrase.encode() + b" "), 0, 0
        while at >= 0:
            words_before += line.count(b" ", counted, at)
            counted = at
            found.append((words_before, label))
            at = line.find(needle, at + 1)
    return sorted(found)


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each licence word: as many rows as the templates have words."""
    bound_batches(docs.sparkSession)
    vocabulary = sorted(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for b in batches:
            for t in b.column(0):
                counts.update(POSTINGS.keys() & set(words_of(t.as_py())))
                n += 1
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in vocabulary)], "n": pa.array([n, *(counts[w] for w in vocabulary)], pa.int64())})

    raw = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = raw.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


def in_order(tokens: list[bytes], words: list[bytes]) -> int:
    """How many of tokens stand in words in their order, others between: the longest common subsequence, in bit vectors."""
    places: dict[bytes, int] = {}
    for i, t in enumerate(tokens):
        places[t] = places.get(t, 0) | 1 << i
    full = free = (1 << len(tokens)) - 1
    for w in words:
        if (at := places.get(w)) is not None:
            used = free & at
            free = ((free + used) | (free - used)) & full
    return len(tokens) - free.bit_count()


def band(tokens: list[bytes]) -> int:
    return max(2, int(BAND * len(tokens)))


def share_at(n: int, words: list[bytes], at: int) -> float:
    """The share of template n that stands at a place; 0 below the least, or without its key phrases."""
    tokens, d = TOKENS[n], band(TOKENS[n])
    there = words[max(0, at - d) : max(0, at + len(tokens) + d)]
    share = in_order(tokens, there) / len(tokens)
    if share < LEAST_SHARE:
        return 0.0
    line = b" " + b" ".join(there) + b" "
    return share if all(b" " + k.encode() + b" " in line for k in TEMPLATES[n][2]) else 0.0


def candidates(n: int, words: list[bytes], known: set[bytes], idf: dict[bytes, float]) -> list[int]:
    """The places that the votes leave for template n."""
    tokens, d = TOKENS[n], band(TOKENS[n])
    absent = sum(w not in known for w in tokens)
    spare = len(tokens) - math.ceil(LEAST_SHARE * len(tokens) - 1e-9) - absent  # known words that may be out of place
    if spare < 0:
        return []
    rare: set[bytes] = set()
    covered = 0
    for w in sorted(known.intersection(tokens), key=lambda w: (-idf[w], w)):
        if covered >= spare + VOTES:
            break
        rare.add(w)
        covered += tokens.count(w)
    votes: Counter = Counter()
    for at, w in enumerate(words):
        if w in rare:
            votes.update(at - p for m, p in POSTINGS[w] if m == n)
    # A sliding sum of the votes at most d from a place.
    shifts, left, lo, hi, found = sorted(votes), 0, 0, 0, []
    near = sorted({s for v in shifts for s in range(v - d, v + d + 1)})
    for s in near:
        while hi < len(shifts) and shifts[hi] <= s + d:
            left += votes[shifts[hi]]
            hi += 1
        while shifts[lo] < s - d:
            left -= votes[shifts[lo]]
            lo += 1
        if left >= max(1, covered - spare):
            found.append(s)
    return found


def scan(text: bytes, idf: dict[bytes, float]) -> tuple[list[bytes], list[tuple[int, str]], dict[str, float]]:
    """The words, the base places, and the method's labels with their scores."""
    words = words_of(text)
    base = base_places(words)
    known = POSTINGS.keys() & set(words)
    labels: dict[str, float] = {}
    for n, (label, _, _) in enumerate(TEMPLATES):
        for at in candidates(n, words, known, idf):
            if labels.get(label, 0.0) == 1.0:
                break
            if (share := share_at(n, words, at)) > labels.get(label, 0.0):
                labels[label] = share
    return words, base, labels


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text)."""
    total, df = document_frequencies(docs)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in POSTINGS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                words, base, labels = scan(t.as_py(), idf)
                named = sorted({x for _, x in base})
                score = max(labels.values(), default=PHRASE_SCORE if base else 0.0)
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(named), ",".join(sorted({*named, *labels})), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]  # noqa: B905
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return raw.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def base_sql() -> str:
    """The words and base places of documents, in DuckDB's SQL."""
    at = [f"list_transform(list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES.items()]
    return rf"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select doc_id, len(w) as n_words, list_concat(list_concat({at[0]}, {at[1]}), list_concat({at[2]}, {at[3]})) as found from d)
    select doc_id, cast(n_words as bigint) as n_words, cast(len(found) as bigint) as n_base, cast(list_min(list_transform(found, lambda x: x.at)) as bigint) as first_word,
      cast(list_max(list_transform(found, lambda x: x.at)) as bigint) as last_word, array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') as base_labels from b"""
