"""Detectors: anything that adds a raw_response or an entities column to documents."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import truncate_input
from . import reply
from .entities import empty, reclassified, supplemented

INPUT_BYTES, MAX_TOKENS, TEMPERATURE, TIMEOUT = 90_000, 4096, 0.1, 300
SYSTEM = {
    "en": 'You list personal data in medical documents. Answer with JSON alone: {"entities": [{"original": text as written, "category": one of name, date, id, address, phone, email, institution, age, "confidence": 0 to 1}]}.',
    "tr": 'Tıbbi belgelerdeki kişisel verileri listelersin. Yalnızca JSON ile yanıtla: {"entities": [{"original": metindeki hali, "category": name, date, id, address, phone, email, institution, age, "confidence": 0 ile 1 arası}]}.',
}
JSON_ONLY = "Answer with one JSON object and nothing else."


class Detector(Protocol):
    def detect(self, docs: DataFrame) -> DataFrame:
        """docs (text, lang, ...) with the columns entities and error."""


def corrected(df: DataFrame) -> DataFrame:
    """What follows every detector: misread phones become dates, national ids of the whole text are added."""
    return df.withColumn("entities", supplemented(reclassified(F.coalesce("entities", empty())), F.col("text")))


class RuleDetector:
    """National ids alone, without a model."""

    def detect(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("entities", empty()).withColumn("error", F.lit(None).cast("string"))


class ReplyColumnDetector:
    """Replies that are there already, in a column."""

    def __init__(self, column: str = "raw_response"):
        self.column = column

    def detect(self, docs: DataFrame) -> DataFrame:
        return reply.parsed(docs, self.column)


def prompts(docs: DataFrame) -> DataFrame:
    """docs with the columns system and prompt, the text cut to what a model takes."""
    turkish = F.col("lang") == "tr"
    body = truncate_input(F.coalesce("text", F.lit("")), INPUT_BYTES)
    return docs.withColumn("system", F.when(turkish, SYSTEM["tr"]).otherwise(SYSTEM["en"])).withColumn("prompt", F.concat(F.when(turkish, "Belge:").otherwise("Document:"), F.lit("\n---\n"), body, F.lit("\n---")))


def digest() -> Column:
    """Of what a model is asked, whatever document it came from."""
    return F.sha2(F.concat_ws("\n\n", "system", F.coalesce("prompt", F.lit(""))), 256)


def ask(url: str, system: str, prompt: str, timeout: float = TIMEOUT) -> str:
    """One chat completion; a server that refuses the response format is asked again without it."""
    body = {"messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "response_format": {"type": "json_object"}}

    def post(b: dict) -> dict:
        req = urllib.request.Request(f"{url}/v1/chat/completions", json.dumps(b).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return json.load(r)

    try:
        out = post(body)
    except urllib.error.HTTPError as e:
        if e.code != 400:
            raise
        again = {k: v for k, v in body.items() if k != "response_format"}
        again["messages"] = [{"role": "system", "content": f"{system} {JSON_ONLY}"}, body["messages"][1]]
        out = post(again)
    try:
        content = out["choices"][0]["message"]["content"]
    except (AttributeError, IndexError, KeyError, TypeError):
        content = None
    if not isinstance(content, str) or not content:
        raise ValueError("an empty reply")
    return content


ANSWERS = "digest string, raw_response string, request_error string, asked timestamp"


class HttpDetector:
    """A local model server, asked by `at_once` tasks at a time and for each distinct prompt once.

    With a ledger (a folder) every reply is kept there under the digest of its prompt, in
    `rounds` jobs: a run that comes after a lost one, or over more documents, asks only for what
    no reply is there. Errors are kept too, and asked again by the next run.
    """

    def __init__(self, url: str = "http://localhost:8081", at_once: int = 4, ledger: str | None = None, rounds: int = 16, timeout: float = TIMEOUT):
        self.url, self.at_once, self.ledger, self.rounds, self.timeout = url, at_once, ledger, rounds, timeout

    def asked(self, prompted: DataFrame) -> DataFrame:
        """ANSWERS for rows of (digest, system, prompt)."""
        url, timeout = self.url, self.timeout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, failed = [], []
                for s, p in zip(batch.column("system").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                    try:
                        out.append(ask(url, s, p, timeout))
                        failed.append(None)
                    except (OSError, ValueError) as e:
                        out.append(None)
                        failed.append(str(e))
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.string()), pa.array(failed, pa.string())], ["digest", "raw_response", "request_error"])

        made = prompted.repartition(self.at_once).mapInArrow(run, "digest string, raw_response string, request_error string")
        return made.withColumn("asked", F.current_timestamp())

    def known(self, spark: SparkSession) -> DataFrame:
        """What the ledger holds: for each digest a reply, or the last error."""
        kept = spark.read.schema(ANSWERS).option("pathGlobFilter", "*.parquet").parquet(self.ledger)
        return kept.groupBy("digest").agg(F.max("raw_response").alias("raw_response"), F.max_by("request_error", "asked").alias("request_error"))

    def replies(self, docs: DataFrame) -> DataFrame:
        """docs with raw_response and request_error; a null text is asked for like an empty one."""
        spark = docs.sparkSession
        prompted = prompts(docs).withColumn("digest", digest())
        keyed, distinct = prompted.drop("system", "prompt"), prompted.select("digest", "system", "prompt").dropDuplicates(["digest"])
        if not self.ledger:
            answers = self.asked(distinct).drop("asked")
            return keyed.join(answers, "digest", "left").drop("digest")
        spark.createDataFrame([], ANSWERS).write.mode("append").parquet(self.ledger)
        for i in range(self.rounds):
            mine = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(self.rounds)) == i)
            self.asked(mine.join(self.known(spark).where("raw_response IS NOT NULL"), "digest", "left_anti")).write.mode("append").parquet(self.ledger)
        answers = self.known(spark).withColumn("request_error", F.when(F.col("raw_response").isNull(), F.col("request_error")))
        return keyed.join(answers, "digest", "left").drop("digest")

    def detect(self, docs: DataFrame) -> DataFrame:
        return reply.parsed(self.replies(docs)).withColumn("error", F.coalesce("request_error", "error")).drop("request_error")
