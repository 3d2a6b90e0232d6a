"""Audio files as tables: recursive listing, header metadata, decoding with fallbacks, and a block-wise WAV data source."""

from __future__ import annotations

import io
import os
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sonarmill.functions import dsp, parsing


def audio_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = parsing.AUDIO_SUFFIXES, content: bool = False) -> DataFrame:
    """Audio files below a folder: ``path, length`` and, if asked for, ``content``. Only what is asked for is read.

    Files without a single byte are not listed: Spark gives no task anything to read for them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = listed.where(parsing.suffix(F.col("path")).isin(*suffixes))
    return rows.select("path", F.col("length"), *(["content"] if content else []))


class Unsupported(ValueError):
    """A container that no header reader knows."""


def _wave_header(content: bytes) -> tuple[float, int, int, str]:
    """WAVE by its chunks, so that float samples and extensible formats, which the standard library refuses, are read too."""
    at, known = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
            known = channels, rate, align, f"{'FLOAT' if kind == 3 else 'PCM'}_{bits}"
        elif name == b"data" and known:
            channels, rate, align, kind = known
            return min(size, len(content) - at - 8) // align / rate, rate, channels, kind
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _flac_header(content: bytes) -> tuple[float, int, int, str]:
    """The STREAMINFO block, which comes first: 20 bits of rate, 3 of channels, 5 of sample size, 36 of samples."""
    info = int.from_bytes(content[18:26], "big")
    rate, samples = info >> 44, info & ((1 << 36) - 1)
    if content[4] & 127 or not rate or len(content) < 42:
        raise ValueError("no stream information")
    return samples / rate, rate, (info >> 41 & 7) + 1, f"PCM_{(info >> 36 & 31) + 1}"


def _ogg_header(content: bytes) -> tuple[float, int, int, str]:
    """Rate and channels from the first page of Vorbis or Opus, the length from the last page's position."""
    body = content[27 + content[26] :]
    last = content.rfind(b"OggS")
    end = struct.unpack("<q", content[last + 6 : last + 14])[0]
    if body[:7] == b"\x01vorbis":
        channels, rate = struct.unpack("<BI", body[11:16])
        return end / rate, rate, channels, "VORBIS"
    if body[:8] == b"OpusHead":
        skip, rate = struct.unpack("<HI", body[10:16])
        return max(0, end - skip) / 48_000, rate or 48_000, body[9], "OPUS"
    raise Unsupported("OGG stream of another codec")


def _mp3_header(content: bytes) -> tuple[float, int, int, str]:
    """The first frame behind the tag; a count of frames in it, or else the bit rate, gives the length."""
    at = 0
    if content[:3] == b"ID3":
        at = 10 + sum((content[6 + i] & 127) << (7 * (3 - i)) for i in range(4))
    word = int.from_bytes(content[at : at + 4], "big")
    version, layer, bits, rates = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 2047 or layer != 1 or version == 1 or bits in (0, 15) or rates == 3:
        raise ValueError("no layer III frame")
    # fixed values: kbit/s of layer III for MPEG-1 and for MPEG-2 and 2.5, and the rates of MPEG-1
    speed = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if version == 3 else (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))[bits] * 1000
    rate = (44_100, 48_000, 32_000)[rates] >> {3: 0, 2: 1, 0: 2}[version]
    channels = 1 if word >> 6 & 3 == 3 else 2
    side = {(3, 2): 32, (3, 1): 17}.get((version, channels), 17 if channels == 2 else 9)
    tag = content[at + 4 + side : at + 16 + side]
    samples = 1152 if version == 3 else 576
    if tag[:4] in (b"Xing", b"Info") and tag[7] & 1:
        return int.from_bytes(tag[8:12], "big") * samples / rate, rate, channels, "MP3"
    return (len(content) - at) * 8 / speed, rate, channels, "MP3"


def _atoms(content: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        size = int.from_bytes(content[start : start + 4], "big")
        head = 8
        if size == 1:
            size, head = int.from_bytes(content[start + 8 : start + 16], "big"), 16
        size = size or end - start
        if size < head:
            raise ValueError("broken atom")
        yield content[start + 4 : start + 8], start + head, min(end, start + size)
        start += size


def _mp4_header(content: bytes) -> tuple[float, int, int, str]:
    """The sound track's media header and sample description."""
    found: dict[bytes, tuple[int, int]] = {}

    def walk(start: int, end: int) -> bool:
        for name, a, b in _atoms(content, start, end):
            if name == b"hdlr" and content[a + 8 : a + 12] == b"soun":
                found[b"soun"] = a, b
            if name in (b"mdhd", b"stsd"):
                found[name] = a, b
            if name in (b"moov", b"mdia", b"minf", b"stbl") and walk(a, b):
                return True
            if name == b"trak":
                found.clear()
                walk(a, b)
                if {b"soun", b"mdhd", b"stsd"} <= set(found):
                    return True
        return False

    if not walk(0, len(content)):
        raise ValueError("no sound track")
    a = found[b"mdhd"][0]
    wide = content[a] == 1
    scale, length = struct.unpack(">IQ" if wide else ">II", content[a + (20 if wide else 12) : a + (32 if wide else 20)])
    entry = found[b"stsd"][0] + 8
    return length / scale, int.from_bytes(content[entry + 32 : entry + 34], "big") or scale, int.from_bytes(content[entry + 24 : entry + 26], "big"), content[entry + 4 : entry + 8].decode("latin-1").upper()


def header(content: bytes) -> tuple[float, int, int, str]:
    """``seconds, rate, channels, subtype`` of a file by what it begins with, whatever its name."""
    if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
        return _wave_header(content)
    if content[:4] == b"fLaC":
        return _flac_header(content)
    if content[:4] == b"OggS":
        return _ogg_header(content)
    if content[4:8] == b"ftyp":
        return _mp4_header(content)
    if content[:3] == b"ID3" or (len(content) > 1 and content[0] == 255 and content[1] & 0xE0 == 0xE0):
        return _mp3_header(content)
    raise Unsupported("no known container")


METADATA = "path string, duration_sec double, sample_rate int, channels int, subtype string, file_size_mb double, sha256 string, status string"
#: Suffixes of files that should begin as one of the known containers do; if they don't, they are broken.
READABLE = (".wav", ".flac", ".ogg", ".mp3", ".m4a")


def wav_metadata(files: DataFrame) -> DataFrame:
    """Header metadata of ``path, length, content`` of WAVE, FLAC, OGG, MP3 and MP4 files.

    A file that can't be read has nulls and the status CORRUPTED, or UNSUPPORTED if it is of another kind.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    seconds, rate, channels, kind = header(content)
                    rows.append((path, round(seconds, 2), rate, channels, kind, "OK"))
                except Exception as error:  # whatever is wrong with a file is its status, not the batch's
                    named = path.lower().endswith(READABLE) and not path.lower().endswith(".ogg")
                    rows.append((path, None, None, None, None, "UNSUPPORTED" if isinstance(error, Unsupported) and not named else "CORRUPTED"))
            out = pd.DataFrame(rows, columns=["path", "duration_sec", "sample_rate", "channels", "subtype", "status"])
            yield out.assign(file_size_mb=(frame["length"] / 2**20).round(3).values, sha256=frame["sha256"].values).astype({"sample_rate": "Int32", "channels": "Int32"})[[x.split()[0] for x in METADATA.split(", ")]]

    return files.withColumn("sha256", F.sha2("content", 256)).mapInPandas(run, METADATA)


def _pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / 2 ** (8 * width - 1)
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def decode_wave(content: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(content)) as f:
        return _pcm(f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()), f.getframerate()


def decode_float_wave(content: bytes) -> tuple[np.ndarray, int]:
    """WAVE files with 32-bit float samples, which the standard library refuses."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and kind == 3 and bits == 32:
            x = np.frombuffer(body[: len(body) // 4 * 4], "<f4").astype(np.float64)
            return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate
        at += 8 + size + size % 2
    raise ValueError("no float samples")


#: Decoders, tried in this order; others may be added for other containers.
DECODERS: list[Callable[[bytes], tuple[np.ndarray, int]]] = [decode_wave, decode_float_wave]


def decode(content: bytes, rate: int = dsp.RATE) -> np.ndarray:
    """Mono samples at the wanted rate by the first decoder that reads the content."""
    reasons = []
    for decoder in DECODERS:
        try:
            samples, source = decoder(content)
            return dsp.resampled(samples, source, rate)
        except Exception as error:
            reasons.append(f"{decoder.__name__}: {error}")
    raise ValueError("; ".join(reasons))


def decoded(files: DataFrame, rate: int = dsp.RATE) -> DataFrame:
    """``path, status, error, wave`` of ``path, content``; a file that no decoder reads is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, "success", "", decode(content, rate)))
                except ValueError as error:
                    rows.append((path, "failed", str(error), None))
            yield pd.DataFrame(rows, columns=["path", "status", "error", "wave"])

    return files.select("path", "content").mapInPandas(run, "path string, status string, error string, wave array<double>")


class _File(InputPartition):
    def __init__(self, path: str, first: int, frames: int):
        self.path, self.first, self.frames = path, first, frames


class WavReader(DataSourceReader):
    """Splits files into stretches of frames, so that one long recording is read by many tasks in bounded memory."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.block = int(options.get("block_frames", 1 << 16))
        self.stretch = int(options.get("partition_frames", 1 << 22))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root, folders, names in os.walk(self.folder):
            folders.sort()
            for name in sorted(names):
                if name.lower().endswith(".wav"):
                    path = os.path.join(root, name)
                    try:
                        with wave.open(path) as f:
                            n = f.getnframes()
                    except (wave.Error, EOFError, OSError):
                        continue
                    out += [_File(path, a, min(self.stretch, n - a)) for a in range(0, max(n, 1), self.stretch)]
        return out or [_File("", 0, 0)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        with wave.open(partition.path) as f:
            f.setpos(partition.first)
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            at, end = partition.first, partition.first + partition.frames
            while at < end:
                raw = f.readframes(min(self.block, end - at))
                if not raw:
                    break
                samples = _pcm(raw, width, channels)
                yield partition.path, at, rate, channels, samples.tolist()
                at += len(samples)


class WavSource(DataSource):
    """``spark.read.format("wav_blocks").load(folder)``: mono blocks of PCM WAVE files in a folder that all workers see."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return "path string, first_frame bigint, sample_rate int, channels int, samples array<double>"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
