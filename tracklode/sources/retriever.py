"""Retrieval and model boundaries: injectable clients called once an Arrow batch."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(queries: DataFrame, client: Callable[[list[str]], list[list[dict]]], query: str = "query") -> DataFrame:
    """``queries`` with ``hits``; the client gets a batch of queries and returns passages (id, score, contents) for each, in order."""
    kind = "array<struct<id:string,score:double,contents:string>>"

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        found = client(s.tolist())
        if len(found) != len(s):
            raise ValueError("the retriever returned another number of answers")
        return pd.Series(found)

    return queries.withColumn("hits", run(query))


def single_query(queries: DataFrame, client, column: str = "queries") -> DataFrame:
    """Searches of exactly one query; any other number is an invalid action and is not sent."""
    one = F.size(column) == 1
    asked = search(queries.filter(one).withColumn("__q", F.col(column)[0]), client, "__q").drop("__q").withColumn("invalid_action", F.lit(False))
    rest = queries.filter(~F.coalesce(one, F.lit(False)))
    return asked.unionByName(rest.withColumn("hits", F.array().cast(asked.schema["hits"].dataType)).withColumn("invalid_action", F.lit(True)))


def with_retries(call: Callable[[str], str], attempts: int = 3, wait: Callable[[int], None] = lambda n: None) -> Callable[[list[str]], list[str | None]]:
    """A client for ``generate`` that tries each prompt several times; null where all fail."""

    def run(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            reply = None
            for n in range(attempts):
                try:
                    reply = call(p)
                    break
                except Exception:  # noqa: BLE001  the model's client may raise anything
                    if n + 1 < attempts:
                        wait(n)
            out.append(reply)
        return out

    return run


def generate(prompts: DataFrame, client: Callable[[list[str]], list[str | None]], prompt: str = "prompt", out: str = "reply") -> DataFrame:
    """``prompts`` with the model's replies."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(client(s.tolist()), dtype=object)

    return prompts.withColumn(out, run(prompt))


#: What a call leaves beside its reply: whether it succeeded, the attempts made, the milliseconds they took, and the tokens the client reports.
CALL = "struct<reply:string,status:string,attempts:int,latency_ms:bigint,prompt_tokens:bigint,completion_tokens:bigint,error:string>"


def within(call: Callable[[], object], seconds: float):
    """The call's result, or TimeoutError; a call that hangs is left behind in a daemon thread."""
    box: list = []

    def run() -> None:
        try:
            box.append((call(), None))
        except Exception as e:  # noqa: BLE001  handed to the caller
            box.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not box:
        raise TimeoutError(f"no answer in {seconds} s")
    value, error = box[0]
    if error is not None:
        raise error
    return value


def one_call(client: Callable[[str, int], str | dict], prompt: str | None, attempts: int, first_wait: float, timeout: float) -> dict:
    """Up to so many attempts, with waits that double in between; never raises."""
    began, status, error, reply = time.monotonic(), "error", None, {}
    n = 0
    for n in range(1, attempts + 1):
        try:
            got = within(lambda n=n: client(prompt or "", n), timeout)
            reply, status, error = (got if isinstance(got, dict) else {"reply": got}), "ok", None
            break
        except TimeoutError as e:
            status, error = "timeout", str(e)
        except Exception as e:  # noqa: BLE001  the client may raise anything
            status, error = "error", f"{type(e).__name__}: {e}"
        if n < attempts and first_wait:
            time.sleep(first_wait * 2 ** (n - 1))
    count = lambda k: reply.get(k) if isinstance(reply.get(k), int) else None
    text = reply.get("reply")
    return {"reply": text if text is None else str(text), "status": status, "attempts": n, "latency_ms": round(1000 * (time.monotonic() - began)), "prompt_tokens": count("prompt_tokens"), "completion_tokens": count("completion_tokens"), "error": error}


def call_model(prompts: DataFrame, client: Callable[[str, int], str | dict], prompt: str = "prompt", out: str = "call", concurrency: int = 8, attempts: int = 3, first_wait: float = 1.0, timeout: float = 90.0) -> DataFrame:
    """``prompts`` with a CALL struct each, in order.

    A batch has at most ``concurrency`` calls under way at a time; a call that
    raises or takes longer than ``timeout`` seconds is tried again after 1, 2,
    4, ... times ``first_wait``.  ``client(prompt, attempt)`` returns a text, or a
    dict with ``reply`` and, if it knows them, ``prompt_tokens`` and
    ``completion_tokens``.  Nothing it does fails the job.
    """

    @F.pandas_udf(CALL)
    def run(s: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            made = list(pool.map(lambda p: one_call(client, p, attempts, first_wait, timeout), s))
        return pd.DataFrame({k: pd.Series([m[k] for m in made], dtype=object) for k in CALL_FIELDS})

    return prompts.withColumn(out, run.asNondeterministic()(prompt))


CALL_FIELDS = [f.split(":")[0] for f in CALL.removeprefix("struct<").removesuffix(">").split(",")]
