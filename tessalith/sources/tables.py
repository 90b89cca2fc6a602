"""CSV, JSON and text tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith.functions.text import member_key
from tessalith.schemas import CACHE, DRUG_RECORD, MANIFEST, TRANSCRIPTS

SPLITS = ("test", "dev", "train")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) leads anywhere, in whatever store it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def read_sheet(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """A filled review sheet or any other CSV with these columns, all as text."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """One transcript split; the clip id is the audio id: base names repeat between sessions."""
    raw = spark.read.schema(TRANSCRIPTS).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return raw.withColumn("clip_id", F.col("audio_ids")).withColumnsRenamed({"user_ids": "speaker_id", "audio_paths": "path"})


def choose_split(read: Callable[[str], DataFrame], splits: tuple[str, ...] = SPLITS) -> tuple[str, DataFrame]:
    """The first split that loads and has a transcript that is not blank, without its blank rows; else all reasons."""
    reasons = []
    for split in splits:
        try:
            usable = read(split).filter(F.length(F.trim("transcript")) > 0)
            if not usable.isEmpty():
                return split, usable
            reasons.append(f"{split}: all transcripts are empty")
        except Exception as e:  # whatever a reader raises: the next split may load
            reasons.append(f"{split}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
    raise RuntimeError("no split has transcripts: " + "; ".join(reasons))


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """Every answer under ``root/<provider>/<clip>.json``; folders that begin with an underscore are not read."""
    if not exists(spark, f"{root}/[^_]*/*.json"):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).json(f"{root}/[^_]*/*.json", multiLine=True)


def cached_path(root: str, provider: str, clip_id: str) -> str:
    return f"{root}/{provider}/{clip_id}.json"


def read_text_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text in ``value``, for nested JSON."""
    return spark.read.text(path, wholetext=True)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a list: trimmed and lower-cased, without blank lines and lines that begin with ``#``. A missing file is an error."""
    line = F.trim(F.lower("value"))
    return spark.read.text(path).select(line.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(term) of an optional word list; none where it is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "term string")
    return spark.read.text(path).select(F.trim(F.lower("value")).alias("term")).filter("term != ''").distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a built lexicon, as written."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: build the lexicon first")
    return spark.read.text(path).select(F.trim("value").alias("term")).filter("term != ''").distinct()


def read_drug_records(spark: SparkSession, path: str) -> DataFrame:
    """Product records, one JSON object a line; what does not parse comes out null."""
    return spark.read.schema(DRUG_RECORD).json(path)


def fetch_pages(get: Callable[[int, int], tuple[int, list]], page: int = 1000, most: int = 25_000) -> list:
    """All records of a paged service: ``get(skip, limit)`` gives a status and records.

    400, 404 or no records end it; trouble on the line after the first page
    keeps what there is, before it it is an error.
    """
    out: list = []
    for skip in range(0, most, page):
        try:
            status, records = get(skip, page)
        except OSError:
            if not out:
                raise
            break
        if status in (400, 404) or not records:
            break
        if status >= 300:
            raise RuntimeError(f"HTTP {status}")
        out += records
    if not out:
        raise RuntimeError("the service returned no record")
    return out


def archive_address(base: str, accent: str, split: str, shard: int = 0) -> str:
    return f"{base}/audio/{accent}/{split}/{split}_{accent}_{shard}.tar.gz"


def needed_archives(manifest: DataFrame) -> DataFrame:
    return manifest.select("accent", "split").distinct().orderBy("accent", "split")


def members_wanted(manifest: DataFrame) -> DataFrame:
    """(key, clip_id): how the manifest's rows are called inside archives."""
    return manifest.select(member_key(F.col("path")).alias("key"), "clip_id")
