"""Chat models over HTTP, asked from tasks.

Every task has one client for its partition. Requests go out in a window of bounded size, each with a deadline; a refused or late
one is tried again after a growing pause, until the attempts or the deadline of the whole request are used up. Answers are kept
in a table by the hash of what was asked, so a job that is run again asks only for what has none.

Defined cases: equal prompts are asked once; a null prompt is empty; a request that fails for good has a null answer and the
reason, and isn't kept."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import exists

_ASKED = "key string, answer string, failure string, attempts int"


@dataclass(frozen=True)
class HttpChat:
    """A model behind an HTTP endpoint that takes and gives JSON messages."""

    url: str
    model: str
    timeout: float = 90.0
    json_mode: bool = False
    temperature: float = 0.0
    max_tokens: int | None = None
    token: str | None = None

    def __call__(self, system: str, user: str, timeout: float | None = None) -> str:
        options = {"temperature": self.temperature, "top_p": 1.0} | ({} if self.max_tokens is None else {"num_predict": self.max_tokens})
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "stream": False, "options": options} | ({"format": "json"} if self.json_mode else {})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urlopen(Request(self.url, json.dumps(body).encode(), headers), timeout=timeout or self.timeout) as reply:  # noqa: S310
            content = json.loads(reply.read().decode()).get("message", {}).get("content")
        if not isinstance(content, str):
            raise ValueError("the reply has no message")
        return content.strip()


@dataclass(frozen=True)
class Limits:
    in_flight: int = 4  # requests of a task at a time
    attempts: int = 3
    pause: float = 0.5  # seconds before the second attempt, then twice as long each
    deadline: float = 180.0  # seconds for all attempts of a request


def persistent(client: Callable[..., str], system: str, user: str, limits: Limits, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[str | None, str | None, int]:
    """answer, or the last failure; and how many attempts were made."""
    end, pause, failure = clock() + limits.deadline, limits.pause, "deadline"
    for n in range(1, limits.attempts + 1):
        left = end - clock()
        if left <= 0:
            return None, f"deadline: {failure}", n - 1
        try:
            return client(system, user, timeout=left), None, n
        except Exception as e:  # noqa: BLE001 - what a service does wrong is data here
            failure = f"{type(e).__name__}: {str(e)[:200]}"
        if n < limits.attempts:
            sleep(max(0.0, min(pause, end - clock())))
            pause *= 2
    return None, failure, limits.attempts


def prompt_key(system: str = "system", user: str = "user") -> F.Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.sha2(F.to_json(F.array(text(system), text(user))).cast("binary"), 256)


def ask_all(prompts: DataFrame, client: Callable[..., str], limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """key, answer, failure, attempts of prompts (key, system, user)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(limits.in_flight) as pool:
            for b in batches:
                asked = zip(b.column("system").to_pylist(), b.column("user").to_pylist(), strict=True)
                got = list(pool.map(lambda p: persistent(client, p[0] or "", p[1] or "", limits), asked))
                cols = [b.column("key"), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32())))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "answer", "failure", "attempts"])

    return prompts.select("key", "system", "user").mapInArrow(run, _ASKED)


def answers(prompts: DataFrame, client: Callable[..., str], kept: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """prompts (system, user, ...) with answer and failure. Answers are read from the folder `kept`, and new ones added to it.

    Failures are written as well, for their reasons, and asked again the next time."""
    spark = prompts.sparkSession
    read = lambda: spark.read.schema(_ASKED).parquet(kept) if exists(spark, kept) else spark.createDataFrame([], _ASKED)
    keyed = prompts.withColumn("key", prompt_key())
    open_ = keyed.select("key", "system", "user").dropDuplicates(["key"]).join(read().filter("answer is not null").select("key").distinct(), "key", "left_anti")
    ask_all(open_, client, limits).write.mode("append").parquet(kept)
    known = read().groupBy("key").agg(F.max("answer").alias("answer"), F.max("failure").alias("failure"))
    return keyed.join(known, "key", "left").withColumn("failure", F.when(F.col("answer").isNull(), F.col("failure"))).drop("key")
