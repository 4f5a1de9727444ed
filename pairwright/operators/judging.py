"""Running a judge over requests, and finding the requests still to be sent."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.parsing import parse_winner, parse_winner_comment, score
from pairwright.operators.items import judge_requests
from pairwright.operators.pairing import valid
from pairwright.schemas import COMMENTS, JUDGMENTS

# judge(model, system_prompt, user_message) -> reply text or None
Judge = Callable[[str, str, str], str | None]


# Replies handed on at once.
CHUNK_ROWS = 32


def answering(
    make_judge: Callable[[], Judge], names: Sequence[str], concurrency: int = 1, pause: float = 0.0, rows: int = CHUNK_ROWS
) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function over batches of requests that yields ``names`` with replies and errors, ``rows`` at a time.

    Calls of several threads begin at least ``pause`` seconds apart. No call begins before the last rows are handed on.
    All of it is nested, so that it travels to the workers by value: they need not have this package.
    """

    def answer_all(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        lock, begin = threading.Lock(), [0.0]

        def wait() -> None:
            with lock:
                now = time.monotonic()
                turn = max(begin[0], now)
                begin[0] = turn + pause
            time.sleep(turn - now)

        def one(call: tuple[str, str, str]) -> tuple[str | None, str | None]:
            if pause > 0:
                wait()
            try:
                return judge(*call), None
            except Exception as failure:
                return None, str(failure)

        with ThreadPoolExecutor(concurrency) as threads:
            for batch in batches:
                for at in range(0, len(batch), rows):
                    chunk = batch.iloc[at : at + rows]
                    calls = zip(chunk["model"], chunk["system_prompt"], chunk["user_message"], strict=True)
                    found = list(threads.map(one, calls))
                    answered = chunk[list(names)].copy()
                    for i, name in enumerate(("raw_response", "error")):
                        answered[name] = pd.Series([f[i] for f in found], index=chunk.index, dtype="object")
                    yield answered

    return answer_all


def collect_replies(
    requests: DataFrame,
    make_judge: Callable[[], Judge],
    parallelism: int | None = None,
    pause: float = 0.0,
    concurrency: int = 1,
) -> DataFrame:
    """Requests with ``raw_response`` and ``error`` in place of the texts sent.

    ``make_judge`` is called once per task, on the worker, so a client need not be
    shippable; with ``concurrency`` it is called from so many threads of the task. A failing call
    becomes a row with ``error``; the run goes on. The rate is at most ``parallelism`` calls per ``pause``
    seconds, whatever the threads. Replies leave a task some tens of rows at a time.

    Replies cost money: write the result to storage and parse what was written,
    so that later steps never call the judge again; send what a lost run left
    open with ``pending_requests``.
    """
    sent = ("system_prompt", "user_message")
    kept = [f for f in requests.schema if f.name not in sent]
    names = [f.name for f in kept]
    out = T.StructType(
        [*kept, T.StructField("raw_response", T.StringType()), T.StructField("error", T.StringType())]
    )
    spread = requests.repartition(parallelism) if parallelism else requests
    return spread.mapInPandas(answering(make_judge, names, concurrency, pause, max(CHUNK_ROWS, concurrency)), out)


def judgments_from_replies(replies: DataFrame, strict: bool = False) -> DataFrame:
    """Parse and score replies to requests for a verdict."""
    return score(parse_winner(replies, strict=strict)).select(*JUDGMENTS.fieldNames())


def comments_from_replies(replies: DataFrame) -> DataFrame:
    """Parse and score replies to requests for a verdict and a comment."""
    if "comment_case_type" not in replies.columns:
        replies = replies.withColumn("comment_case_type", F.lit(None).cast("string"))
    return score(parse_winner_comment(replies)).select(*COMMENTS.fieldNames())


def pending_requests(
    items: DataFrame,
    roster: Sequence[tuple[str, str]],
    prompt_version: str,
    system_prompt: str,
    judgments: DataFrame,
    swap: bool = False,
) -> DataFrame:
    """Requests without a parsed verdict so far: never sent, failed, empty or unreadable.

    Finished judges are gathered per item, no more than the roster has, and taken
    off before the texts are multiplied by judges: a text is shuffled once.
    """
    done = valid(judgments, swap).filter(
        (F.col("prompt_version") == prompt_version) & F.col("model").isin(*[m for m, _ in roster])
    )
    answered = done.groupBy("sample_id").agg(F.collect_set("model").alias("models"))
    return judge_requests(items, roster, prompt_version, system_prompt, swap, answered)
