"""Resumable batch jobs with a pluggable scorer: generation, judging, retries, cost.

A call is a function from a row's prompt to a Response. It runs in mapInPandas, one client a
partition; results are appended in chunks, and a later run takes only what is missing."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_score, missing_answer
from ..operators.ranking import counted
from ..session import ship
from ..sources.sinks import exists


@dataclass
class Response:
    text: str | None
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost: float | None = None
    finish_reason: str = "stop"


class BadRequest(Exception):
    """Never retried."""


class RateLimited(Exception):
    """Waits, without counting as an attempt."""

    def __init__(self, wait: float = 1.0) -> None:
        super().__init__(wait)
        self.wait = wait


@dataclass
class Retry:
    attempts: int = 4
    first: float = 1.0
    longest: float = 60.0
    patience: float = 7200.0

    def call(self, fn: Callable[[], Response], sleep: Callable[[float], None] = time.sleep) -> tuple[Response | None, str | None]:
        """(response, error): an error finish or no tokens is a failure; the last failure gives no response."""
        waited, tries, error = 0.0, 0, None
        while tries < self.attempts:
            try:
                r = fn()
                if r.finish_reason != "error" and r.completion_tokens > 0:
                    return r, None
                error = f"finish {r.finish_reason}"
            except BadRequest as e:
                return None, f"bad request: {e}"
            except RateLimited as e:
                if waited + e.wait > self.patience:
                    return None, "rate limit"
                waited += e.wait
                sleep(min(e.wait, 3600.0))
                continue
            except Exception as e:  # what a client raises isn't known here
                error = repr(e)
            sleep(min(self.first * 2**tries, self.longest))
            tries += 1
        return None, error


def stub(prompt: str) -> Response:
    """A scorer without a model: the share of distinct words decides, so results repeat."""
    words = re.findall(r"\w+", prompt.lower())
    n, distinct = max(1, len(words)), len(set(words))
    score = (200 * distinct + n) // (2 * n) / 100  # in whole numbers, so that other engines round alike
    return Response(f"<think>{len(words)} words</think> [[{score}]]", len(words), 4)


RESULT = "answer string, prompt_tokens long, completion_tokens long, reported_cost double, finish_reason string, error string"


def generate(work: DataFrame, keys: list[str], prompt: str, call: Callable[[str], Response] = stub, retry: Retry | None = None) -> DataFrame:
    """keys with the results of their prompts; a failed row has an error and no answer."""
    ship(work.sparkSession)
    policy = retry or Retry()

    def run(frames):
        for f in frames:
            rows = []
            for p in f[prompt]:
                r, error = policy.call(lambda p=p: call(p or ""))
                rows.append((r.text, r.prompt_tokens, r.completion_tokens, r.cost, r.finish_reason, None) if r else (None, None, None, None, None, error))
            out = pd.DataFrame(rows, columns=["answer", "prompt_tokens", "completion_tokens", "reported_cost", "finish_reason", "error"])
            yield pd.concat([f[keys].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"{k} {work.schema[k].dataType.simpleString()}" for k in keys)
    return work.select(*keys, prompt).mapInPandas(run, f"{kinds}, {RESULT}")


def done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a job's table holds; nothing if it isn't there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def successful(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull() & ~missing_answer(F.col("answer")))


def run_resumable(work: DataFrame, keys: list[str], prompt: str, path: str, call: Callable[[str], Response] = stub, retry: Retry | None = None, rounds: int = 2, holes: int = 0) -> int:
    """Append results for the rows of work that have no successful one; again for holes, in rounds.
    Returns how many are left; more than `holes` is for the caller to refuse."""
    spark = work.sparkSession
    schema = ", ".join(f"{k} {work.schema[k].dataType.simpleString()}" for k in keys) + ", " + RESULT
    for _ in range(rounds):
        todo = work.join(successful(done(spark, path, schema)).select(*keys).distinct(), keys, "left_anti")
        if todo.limit(1).count() == 0:
            return 0
        generate(todo, keys, prompt, call, retry).write.mode("append").parquet(path)
    left = work.join(successful(done(spark, path, schema)).select(*keys).distinct(), keys, "left_anti").count()
    return left


def cost(reported: Column, prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Reported, else tokens at the model's prices (for a million), else null."""
    return F.coalesce(reported, (prompt_tokens * price_in + completion_tokens * price_out) / 1e6)


def panel_cost(costs: Column, present: Column) -> Column:
    """Sum of the present responses' costs; null if one lacks it, or there are none (an aggregate)."""
    return F.when((F.count_if(present) > 0) & (F.count_if(present & costs.isNull()) == 0), F.sum(F.when(present, costs)))


def judge(answers: DataFrame, keys: list[str], answer: str, seats: list[str], call: Callable[[str], Response] = stub) -> DataFrame:
    """(keys, judge, score): every answer before every seat; missing answers are judged by nobody."""
    work = answers.where(~missing_answer(F.col(answer))).withColumn("judge", F.explode(F.array(*map(F.lit, seats))))
    work = work.withColumn("__prompt", F.concat_ws("\n", "judge", answer))
    out = generate(work, [*keys, "judge"], "__prompt", call)
    return out.select(*keys, "judge", last_score(F.col("answer")).alias("score"))


def identical_inputs(new: DataFrame, stored: DataFrame, keys: list[str], prompt: str) -> int:
    """Rows whose rebuilt prompt isn't, byte for byte, the stored one."""
    s = stored.select(*keys, F.col(prompt).alias("__s"))
    return new.join(s, keys, "full_outer").where(~F.col(prompt).eqNullSafe(F.col("__s"))).count()


def spend_estimate(work: DataFrame, prices: DataFrame) -> DataFrame:
    """(judge, rows, cost): live rows at each seat's price."""
    return work.groupBy("judge").agg(F.count("*").alias("rows")).join(counted(prices), "judge").select("judge", "rows", (F.col("rows") * F.col("price")).alias("cost"))


PROMPTS = {"plain": "Answer the question.\n\n", "cited": "Answer and cite the norms you use.\n\n", "judge": "Rate the answer from 0 to 1 as [[n]].\n\n"}


def prompt_of(kind: str, context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPTS[kind]), F.coalesce(context, F.lit("")), F.lit("\n\n"), question)


def reassemble(chunks: list[str]) -> str:
    """The text of a streamed answer: the contents of its `data:` lines in order, up to [DONE]; broken lines
    and lines without content drop out."""
    import json

    out = []
    for line in chunks:
        body = line.removeprefix("data:").strip() if line.startswith("data:") else ""
        if body == "[DONE]":
            break
        try:
            out += [c.get("delta", {}).get("content") or "" for c in json.loads(body).get("choices", [])]
        except (ValueError, AttributeError):
            continue
    return "".join(out)


def evaluate(tasks: DataFrame, key: str, question: str, model: str, seats: list[str], call: Callable[[str], Response] = stub) -> DataFrame:
    """One row a task: the answer, its tokens, each seat's score and the least of them (missing seats as 1,
    null if all are missing)."""
    from ..operators.panel import ensemble_min

    work = tasks.select(key, prompt_of("plain", F.lit(""), F.col(question)).alias("__p"))
    answers = generate(work, [key], "__p", call).withColumn("model", F.lit(model))
    scored = judge(answers, [key], "answer", seats, call)
    wide = scored.groupBy(key).pivot("judge", seats).agg(F.first("score"))
    least = scored.groupBy(key).agg(ensemble_min(F.col("score")).alias("score"))
    return answers.join(wide, key, "left").join(least, key, "left")


def with_reassembled(df: DataFrame, lines: str, name: str) -> DataFrame:
    """df with the text of each array of streamed lines."""
    from ..session import ship

    ship(df.sparkSession)

    @F.pandas_udf("string")
    def whole(x: pd.Series) -> pd.Series:
        return x.map(lambda v: reassemble(list(v)) if v is not None else None)

    return df.withColumn(name, whole(lines))


def overwrite_models(results: DataFrame, path: str) -> None:
    """Replace the partitions of the models in results, and no others."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


# --- a supervisor of seats ---


@dataclass
class Seat:
    """A seat's job: waiting, running, complete or given up; how often it was launched and what it still lacks."""

    name: str
    holes: int
    state: str = "waiting"
    launches: int = 0


def supervise(seats: list[Seat], alive: dict[str, bool], slots: int, launches: int) -> tuple[list[str], bool]:
    """One step: (seats to launch now, whether all are complete and may be merged).

    A seat without holes is complete, whatever its process does. A running seat whose process ended with holes waits for
    another launch, or is given up after `launches` of them. Free slots go to waiting seats in order."""
    for s in seats:
        if s.holes == 0:
            s.state = "complete"
        elif s.state == "running" and not alive.get(s.name, False):
            s.state = "waiting" if s.launches < launches else "given up"
    free = slots - sum(s.state == "running" for s in seats)
    now = [s for s in seats if s.state == "waiting"][: max(0, free)]
    for s in now:
        s.state, s.launches = "running", s.launches + 1
    return [s.name for s in now], all(s.state == "complete" for s in seats)
