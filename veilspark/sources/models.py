"""Model files: the catalogue, what lies in folders, and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import quantisation

#: Models on offer, with their file's size in GB.
CATALOGUE = (
    ("9b", "Qwen 3.5 9B", "Qwen_Qwen3.5-9B-Q4_K_M.gguf", 5.87),
    ("27b", "Qwen 3.5 27B", "Qwen_Qwen3.5-27B-Q4_K_M.gguf", 17.13),
    ("35b-a3b", "Qwen 3.5 35B-A3B", "Qwen3.5-35B-A3B-Q4_K_M.gguf", 21.0),
)
PRESENT = 1_000_000


@dataclass
class Settings:
    language: str = "en"
    theme: str = "dark"
    selected_model: str = "4b"
    gguf_path: str | None = None
    llama_server_path: str | None = None
    age_conversion: bool = False
    birth_date: str | None = None

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Settings of a JSON file; the defaults where it is missing or broken."""
        try:
            x = json.loads(Path(path).read_text(encoding="utf-8"))
            return cls(**{f.name: x[f.name] for f in fields(cls) if f.name in x})
        except (OSError, ValueError, TypeError):
            return cls()

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False), encoding="utf-8")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "id string, name string, filename string, size_gb double")


def catalogue_status(models: DataFrame, files: DataFrame, active: str) -> DataFrame:
    """The catalogue with downloaded (a file of over a million bytes is there) and active. files: (path, length)."""
    there = files.where(F.col("length") > PRESENT).select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("filename")).distinct().withColumn("there", F.lit(True))
    return models.join(there, "filename", "left").select("id", "name", "filename", "size_gb", F.coalesce("there", F.lit(False)).alias("downloaded"), (F.col("id") == active).alias("active"))


def inventory(files: DataFrame) -> DataFrame:
    """(name, path, size_gb, quantisation) of model files (path, length), the preferred family first, then by size."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    size = F.round(F.col("length") / 1073741824, 2)
    out = files.where(F.lower("path").endswith(".gguf")).select(name.alias("name"), "path", size.alias("size_gb")).withColumn("quantisation", quantisation(F.col("name"), F.col("size_gb")))
    return out.orderBy(F.lower("name").contains("qwen").desc(), F.col("size_gb").desc(), "path")


def find_models(spark: SparkSession, folders: list[str], nested: tuple[str, ...] = ()) -> DataFrame:
    """Model files of folders, and of `nested` ones also a level below; file contents are not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.gguf")
    files = read.load(folders).select("path", "length") if folders else None
    for x in nested:
        deep = read.option("recursiveFileLookup", "true").load(x).select("path", "length").where(F.col("path").rlike(rf"\Q{x.rstrip('/')}\E/([^/]+/)?[^/]+\z"))
        files = files.union(deep) if files is not None else deep
    return inventory(files if files is not None else spark.createDataFrame([], "path string, length long"))
