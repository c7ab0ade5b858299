"""The index of claims gives what comparing every chunk with every claim gives."""

import random

import pytest

from talkledger.operators import retrieval, scoring, segment


@pytest.mark.parametrize("size", [4, 20])
def test_same_as_the_cross_product(spark, size):
    rng = random.Random(size)
    said = [(str(n), " ".join(rng.choices(["The", "of", "fee", "x", "y", "z", "é", "w"], k=rng.choice([0, 1, 3, 21, 22, 26, 70]))) + rng.choice(["", "  ", "\n"])) for n in range(40)] + [("none", None)]
    s = scoring.Settings(top_k=3, chunk_words=size, overlap=size // 2)
    said = spark.createDataFrame(said, "transcript_id string, text string")
    claims = spark.createDataFrame([(0, "the of"), (1, "fee fee FEE"), (2, " "), (3, "absent"), (4, "x y z w")], "claim_id int, anchor string")
    want = scoring.hits(segment.chunks(said, s.chunk_words, s.overlap), claims, s)
    got = retrieval.hits(said, claims, s)
    columns = ["transcript_id", "claim_id", "chunk_id", "chunk", "retr", "rank", "ver"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(got) == key(want)
    both = retrieval.hits(said, claims, s, verify={"a": scoring.lexical_verifier, "b": lambda c, w: scoring.lexical_verifier(c, w) / 2})
    assert both.filter("abs(a - 2 * b) > 1e-12").count() == 0 and both.count() == got.count()
