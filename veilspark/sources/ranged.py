"""Files over HTTP by byte ranges: a Python data source whose partitions are ranges, and a folder that keeps what has come.

A task reads its range from where a cut connection left it. Pieces that are whole stay in the
folder, so a download that is begun again asks for the rest alone. The rows (offset, fetched,
content) are also the chunks that streaming.progress counts.
"""

from __future__ import annotations

import datetime
import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "ranged_file"
SCHEMA = "offset long, fetched timestamp, content binary"
PIECE, BLOCK, TRIES, TIMEOUT = 64 << 20, 1 << 20, 5, 60


@dataclass
class Range(InputPartition):
    start: int
    stop: int


def length(url: str) -> int:
    """The size of a file, by a request for its first byte."""
    req = urllib.request.Request(url, headers={"Range": "bytes=0-0"})
    try:
        with urllib.request.urlopen(req, timeout=TIMEOUT) as r:
            return int(r.headers["Content-Range"].rsplit("/", 1)[1]) if r.status == 206 else int(r.headers["Content-Length"])
    except urllib.error.HTTPError as e:
        if e.code == 416:  # an empty file has no first byte
            return 0
        raise


class RangedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.piece = options["url"], int(options.get("piece", PIECE))
        self.only = json.loads(options["pieces"]) if "pieces" in options else None
        self.size = int(options["size"]) if "size" in options else None

    def partitions(self) -> list[Range]:
        size = length(self.url) if self.size is None else self.size
        pieces = self.only if self.only is not None else range(-(-size // self.piece))
        return [Range(i * self.piece, min(size, (i + 1) * self.piece)) for i in pieces] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        at, tries = partition.start, 0
        while at < partition.stop:
            before = at
            try:
                req = urllib.request.Request(self.url, headers={"Range": f"bytes={at}-{partition.stop - 1}"})
                with urllib.request.urlopen(req, timeout=TIMEOUT) as r:
                    skip = at if r.status == 200 else 0  # a server that knows no ranges sends all
                    while skip and (gone := r.read(min(BLOCK, skip))):
                        skip -= len(gone)
                    while at < partition.stop and (block := r.read(min(BLOCK, partition.stop - at))):
                        yield at, datetime.datetime.now(), block
                        at += len(block)
                cut: Exception = EOFError(f"{self.url} ends at byte {at} of {partition.stop}")
            except urllib.error.HTTPError:
                raise
            except (OSError, http.client.HTTPException) as e:
                cut = e
            tries = tries + 1 if at == before else 0
            if at < partition.stop and tries >= TRIES:
                raise cut


class RangedFile(DataSource):
    """spark.read.format("ranged_file").option("url", ...).load(): (offset, fetched, content) in blocks."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RangedReader:
        return RangedReader(self.options)


def read(spark: SparkSession, url: str, **options: object) -> DataFrame:
    spark.dataSource.register(RangedFile)
    return spark.read.format(NAME).options(url=url, **{k: str(v) for k, v in options.items()}).load()


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(folder)


def fetch(spark: SparkSession, url: str, folder: str, piece: int = PIECE, at_once: int = 4) -> DataFrame:
    """The blocks of a file, kept in a folder of Parquet files; `at_once` connections at a time, and as many pieces a job. Called again after a failure, it asks only for pieces that are not there."""
    size = length(url)
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(folder)
    whole = {r.piece: r.n for r in kept(spark, folder).groupBy(F.expr(f"offset div {piece}").alias("piece")).agg(F.sum(F.octet_length("content")).alias("n")).collect()}
    missing = [i for i in range(-(-size // piece)) if whole.get(i) != min(piece, size - i * piece)]
    for k in range(0, len(missing), at_once):
        read(spark, url, piece=piece, size=size, pieces=json.dumps(missing[k : k + at_once])).write.mode("append").parquet(folder)
    return kept(spark, folder)
