"""Sound: archives of clips, and the length and loudness of files."""

from __future__ import annotations

import io
import tarfile
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith.sources.tables import members_wanted

RATE = 16_000


def samples_of(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (frames x channels, -1 to 1) and rate of a PCM WAV file of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    kinds = {1: (np.uint8, 128.0, 128.0), 2: (np.dtype("<i2"), 0.0, 32768.0), 4: (np.dtype("<i4"), 0.0, 2147483648.0)}
    if width not in kinds:
        raise wave.Error(f"{8 * width} bits a sample")
    kind, centre, scale = kinds[width]
    return ((np.frombuffer(raw, kind).astype(np.float64) - centre) / scale).reshape(-1, channels), rate


def to_mono(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """One channel at the target rate as float32: channels are averaged; resampling is a windowed-sinc low pass and linear interpolation."""
    audio = samples.mean(axis=1) if samples.ndim > 1 else np.asarray(samples, np.float64)
    if rate != target and len(audio):
        if target < rate:  # what the lower rate cannot hold has to go first
            taps = np.arange(-64, 65)
            kernel = np.sinc(taps * target / rate * 0.95) * np.blackman(len(taps))
            audio = np.convolve(audio, kernel / kernel.sum(), "same")
        n = round(len(audio) * target / rate)
        audio = np.interp(np.arange(n) * rate / target, np.arange(len(audio)), audio)
    return audio.astype(np.float32)


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A mono WAV file of 16-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def measure(files: DataFrame) -> DataFrame:
    """(clip_id, seconds, rms, error) of files (path, content); an empty file is silent, an unreadable one has an error."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                clip = path.rsplit("/", 1)[-1].removesuffix(".wav")
                try:
                    samples, rate = samples_of(bytes(content))
                    rows.append((clip, len(samples) / rate, float(np.sqrt(np.mean(samples**2))) if samples.size else 0.0, None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((clip, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["clip_id", "seconds", "rms", "error"])

    return files.select("path", "content").mapInPandas(measured, "clip_id string, seconds double, rms double, error string")


def read_audio(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")


def opened(path: str, content: bytes | None):
    """A file object over an archive: its bytes where they are given, else a stream from the store that its path names."""
    if content is not None:
        return io.BytesIO(bytes(content))
    from urllib.parse import urlparse

    import pyarrow.fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem().open_input_stream(parts.path, compression=None)
    fs, place = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_stream(place, compression=None)


def extract(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """(clip_id, content, archive, error) of the wanted members of tar.gz archives, as 16 kHz mono WAV.

    ``archives`` has a path, and a content or not: without it the archive is
    streamed from its store and only one member is in memory.  Each archive is
    read forward in one task.  The wanted keys (two path parts each) go along
    with it, collected per archive by the (accent, split) in its name, and it is
    left as soon as all are found; each key is taken once.  A member that cannot
    be read gives its clip a row with the error, and the members behind it are
    read; an archive that breaks off gives one row with its error, and the
    clips not yet found say so too.
    """
    name = F.element_at(F.split("path", "/"), -1)  # split_accent_shard.tar.gz
    wanted = members_wanted(manifest).join(manifest.select("clip_id", "split", "accent"), "clip_id").groupBy("split", "accent").agg(F.collect_list(F.struct("key", "clip_id")).alias("wanted"))
    named = archives.withColumn("split", F.regexp_extract(name, r"^([^_]+)_", 1)).withColumn("accent", F.regexp_extract(name, r"^[^_]+_(.+)_\d+\.tar\.gz$", 1))
    content = F.col("content") if "content" in archives.columns else F.lit(None).cast("binary").alias("content")

    def members(path: str, content: bytes | None, left: dict[str, str]) -> Iterator[tuple]:
        missing = "not in the archive"
        try:
            with opened(path, content) as file, tarfile.open(fileobj=file, mode="r|gz") as archive:
                for member in archive:
                    if not left:
                        break
                    parts = member.name.strip().lstrip("/").split("/")
                    clip = left.pop("/".join(parts[-2:]), None) if member.isfile() else None
                    if clip is None:
                        continue
                    data = archive.extractfile(member).read()
                    try:
                        yield clip, wav_bytes(to_mono(*samples_of(data))), path, None
                    except (wave.Error, EOFError, ValueError) as e:
                        yield clip, None, path, f"{type(e).__name__}: {e}"
        except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
            missing = f"{type(e).__name__}: {e}"
            yield None, None, path, missing
        for clip in left.values():
            yield clip, None, path, missing

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, wanted in zip(batch.path, batch.content, batch.wanted, strict=True):
                for row in members(path, content, {w["key"]: w["clip_id"] for w in wanted}):
                    yield pd.DataFrame([row], columns=["clip_id", "content", "archive", "error"])

    return named.join(wanted, ["split", "accent"]).select("path", content, "wanted").mapInPandas(read, "clip_id string, content binary, archive string, error string")


def missing_audio(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest's rows without a sound file (path) named after them: what is still to be fetched."""
    there = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.wav$", "").alias("clip_id")).distinct()
    return manifest.join(there, "clip_id", "left_anti")


def total_bytes(archives: DataFrame, most: int = 8 * 1024**3) -> int:
    """Bytes of all archives (length); more than ``most`` is an error before anything is read."""
    total = int(archives.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    if total > most:
        raise ValueError(f"{total} bytes are more than {most}")
    return total
