import random

import pytest

from talkledger.operators import segment


def transcripts(spark, *texts):
    return spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "transcript_id string, transcript string")


def spoken(spark, text, *names, **more):
    return segment.speaker_text(transcripts(spark, text), names, **more).first()["text"]


def test_speaker_text(spark):
    assert spoken(spark, "pre\nAgent: a\nmore\nUser: no\nAGENT :  b", "agent") == "a more b"
    # A header without text loses the lines after it.
    assert spoken(spark, "Agent:\nlost\nUser: x\nlost: y", "Agent") == ""
    assert spoken(spark, "Agent: hello\nat noon we say: x\r\nAgent: end", "Agent:") == "hello end"
    assert spoken(spark, "SPEAKER_00 [1.00s - 2.00s]: a\ncont\nSPEAKER_01 [2s - 3s]: b", "speaker_00") == "a cont"
    assert spoken(spark, "nobody speaks here", "Agent") == ""
    assert spoken(spark, "nobody speaks here", "Agent", keep_unlabelled=True) == "nobody speaks here"
    assert spoken(spark, "  all of it ") == "all of it"


def test_structured_sides(spark):
    text = "lost\nSPEAKER_00 [0s - 1s]: a\nSPEAKER_02 [1s - 2s]: b\nmore\nSPEAKER_01 [2s - 3s]: c\nSPEAKER_00 [3s - 4s]: d"
    row = segment.structured_sides(transcripts(spark, text)).first()
    assert (row["sca"], row["client"]) == (["a b more", "d"], ["c"])


def brute_chunks(text, size, overlap):
    words = text.split()
    if len(words) <= size:
        return [text] if text else []
    windows = [words[i : i + size] for i in range(0, len(words), size - overlap)]
    return [" ".join(w) for n, w in enumerate(windows) if n == 0 or len(w) > 1]


def test_chunks_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "  two  spaces ", *[" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(n)) for n in (1, 19, 20, 21, 22, 25, 26, 40, 41, 63)]]
    for size, overlap in ((20, 15), (5, 0), (3, 2), (50, 20)):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        found = {}
        for r in segment.chunks(df, size, overlap).orderBy("id", "chunk_id").collect():
            found.setdefault(r["id"], []).append(r["chunk"])
        assert found == {n: brute_chunks(t, size, overlap) for n, t in enumerate(texts) if t}
    with pytest.raises(ValueError):
        segment.chunks(df, 5, 5)
