"""Spectral features with NumPy, for Arrow batches: resampling, trimming, six feature families and live-view scalars.

Only what needs a Fourier transform or a filter bank is here; everything else about waveforms is in ``signals``. Results
follow the published definitions (periodic Hann window, zero padding when centred, Slaney mel scale and area norm, 80 dB
range, orthonormal DCT-II, Savitzky-Golay derivatives); no golden values of another library exist here to compare with,
so no equality in the last digits is claimed. A waveform that can't be analysed gives a row with its error, never a
failed batch.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 16_000
TINY = 1e-8


class FeatureError(ValueError):
    """A waveform or parameter that an extractor can't work with."""


@dataclass(frozen=True)
class Stft:
    n_fft: int = 2048
    hop: int = 512
    win: int = 2048
    center: bool = True

    def __post_init__(self) -> None:
        if self.n_fft <= 0 or self.hop <= 0 or not 0 < self.win <= self.n_fft:
            raise FeatureError("n_fft, hop and window must be positive, the window not longer than n_fft")


@dataclass(frozen=True)
class Mfcc(Stft):
    n_fft: int = 1024
    win: int = 1024
    n_mfcc: int = 40
    n_mels: int = 128
    fmin: float = 20.0
    fmax: float | None = None
    delta: bool = True
    normalise: bool = True


@dataclass(frozen=True)
class Mel(Stft):
    win: int = 1024
    n_mels: int = 128
    fmin: float = 20.0
    fmax: float | None = None
    power: float = 2.0
    normalise: bool = True


@dataclass(frozen=True)
class Spectral(Stft):
    bands: int = 6
    fmin: float = 20.0
    quantile: float = 0.02
    normalise: bool = True


@dataclass(frozen=True)
class Chroma(Stft):
    n_chroma: int = 12
    tuning: float | None = None
    normalise: bool = True


@dataclass(frozen=True)
class Framed:
    length: int = 2048
    hop: int = 512
    center: bool = True
    normalise: bool = True


def checked(wave, rate: int = RATE, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    out = np.asarray(wave, np.float64)
    if out.ndim != 1 or not out.size:
        raise FeatureError("the waveform must be one-dimensional and not empty")
    if not np.isfinite(out).all():
        raise FeatureError("the waveform has values that are not finite")
    if rate <= 0 or fmin >= rate / 2 or (fmax is not None and not fmin < fmax <= rate / 2):
        raise FeatureError("frequencies must lie below half the sample rate")
    return out


def framed(wave: np.ndarray, length: int, hop: int, center: bool) -> np.ndarray:
    """``(frames, length)``; with ``center`` half a frame of zeros is added at either end."""
    padded = np.pad(wave, length // 2) if center else wave
    if len(padded) < length:
        raise FeatureError("the waveform is shorter than a frame")
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::hop]


@functools.lru_cache(maxsize=16)
def _hann(win: int, n_fft: int) -> np.ndarray:
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    left = (n_fft - win) // 2
    return np.pad(w, (left, n_fft - win - left))


def spectrum(wave: np.ndarray, s: Stft) -> np.ndarray:
    """Magnitudes ``(bins, frames)``."""
    return np.abs(np.fft.rfft(framed(wave, s.n_fft, s.hop, s.center) * _hann(s.win, s.n_fft), axis=1)).T


def _to_mel(hz):
    hz = np.asarray(hz, np.float64)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def _from_mel(mel):
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@functools.lru_cache(maxsize=16)
def mel_filters(rate: int, n_fft: int, n_mels: int, fmin: float, fmax: float | None) -> np.ndarray:
    edges = _from_mel(np.linspace(_to_mel(fmin), _to_mel(fmax or rate / 2), n_mels + 2))
    bins = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def decibels(power: np.ndarray, span: float | None = 80.0) -> np.ndarray:
    out = 10 * np.log10(np.maximum(power, 1e-10))
    return out if span is None else np.maximum(out, out.max() - span)


@functools.lru_cache(maxsize=16)
def _dct(n_out: int, n_in: int) -> np.ndarray:
    table = np.cos(np.pi * np.outer(np.arange(n_out), np.arange(n_in) + 0.5) / n_in) * math.sqrt(2 / n_in)
    table[0] /= math.sqrt(2)
    return table


def derivative(x: np.ndarray, order: int) -> np.ndarray:
    """Savitzky-Golay derivative along time over 9 frames, or the largest odd number that fits; edges are repeated."""
    n = x.shape[1]
    if n < 3:
        raise FeatureError("derivatives need at least 3 frames")
    half = (9 if n >= 9 else n - 1 + n % 2) // 2
    at = np.arange(-half, half + 1)
    taps = np.linalg.pinv(np.vander(at, order + 1, increasing=True))[order] * math.factorial(order)
    wide = np.pad(x, ((0, 0), (half, half)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=1) @ taps


def standardised(x: np.ndarray, per_channel: bool) -> np.ndarray:
    axis = 1 if per_channel else None
    return (x - x.mean(axis=axis, keepdims=True)) / (x.std(axis=axis, keepdims=True) + TINY)


def mfcc(wave, rate: int = RATE, c: Mfcc = Mfcc()) -> np.ndarray:
    """Cepstral coefficients with first and second derivatives, each channel standardised over time."""
    x = checked(wave, rate, c.fmin, c.fmax)
    out = _dct(c.n_mfcc, c.n_mels) @ decibels(mel_filters(rate, c.n_fft, c.n_mels, c.fmin, c.fmax) @ spectrum(x, c) ** 2)
    if c.delta:
        out = np.concatenate([out, derivative(out, 1), derivative(out, 2)])
    return (standardised(out, True) if c.normalise else out).astype(np.float32)


def mel(wave, rate: int = RATE, c: Mel = Mel()) -> np.ndarray:
    """Log mel spectrogram, standardised as a whole."""
    x = checked(wave, rate, c.fmin, c.fmax)
    out = decibels(mel_filters(rate, c.n_fft, c.n_mels, c.fmin, c.fmax) @ spectrum(x, c) ** c.power)
    return (standardised(out, False) if c.normalise else out).astype(np.float32)


def centroid(mag: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    weight = mag / np.maximum(mag.sum(0, keepdims=True), np.finfo(np.float64).tiny)
    return (freqs[:, None] * weight).sum(0)


def bandwidth(mag: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    weight = mag / np.maximum(mag.sum(0, keepdims=True), np.finfo(np.float64).tiny)
    return np.sqrt((weight * (freqs[:, None] - centroid(mag, freqs)[None, :]) ** 2).sum(0))


def rolloff(mag: np.ndarray, freqs: np.ndarray, part: float) -> np.ndarray:
    """The lowest frequency below which the given part of the magnitude lies."""
    run = np.cumsum(mag, axis=0)
    return freqs[np.argmax(run >= part * run[-1], axis=0)]


def flatness(mag: np.ndarray) -> np.ndarray:
    power = np.maximum(1e-10, mag**2)
    return np.exp(np.log(power).mean(0)) / power.mean(0)


def contrast(mag: np.ndarray, freqs: np.ndarray, bands: int, fmin: float, quantile: float, rate: int) -> np.ndarray:
    """Peaks against valleys in octave bands, in decibels: one band below ``fmin``'s octave and ``bands`` above."""
    edges = np.concatenate([[0.0], fmin * 2.0 ** np.arange(bands + 1)])
    edges[-1] = max(edges[-1], rate / 2) if edges[-1] >= rate / 2 else edges[-1]
    out = np.zeros((bands + 1, mag.shape[1]))
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        held = (freqs >= low) & (freqs <= high)
        first = np.flatnonzero(held)
        if i and len(first):
            held[max(0, first[0] - 1)] = True
        if i == bands:
            held[np.flatnonzero(held)[-1] + 1 :] = True if held.any() else False
        part = np.sort(mag[held] if i == bands or held.sum() < 2 else mag[np.flatnonzero(held)[:-1]], axis=0)
        if not len(part):
            continue
        n = max(1, round(quantile * held.sum()))
        out[i] = decibels(part[-n:].mean(0), None) - decibels(part[:n].mean(0), None)
    return out


def spectral(wave, rate: int = RATE, c: Spectral = Spectral()) -> np.ndarray:
    """Centroid, bandwidth, two roll-offs, flatness and contrast bands, standardised as a whole."""
    x = checked(wave, rate, c.fmin)
    mag, freqs = spectrum(x, c), np.fft.rfftfreq(c.n_fft, 1 / rate)
    out = np.vstack([centroid(mag, freqs), bandwidth(mag, freqs), rolloff(mag, freqs, 0.85), rolloff(mag, freqs, 0.95), flatness(mag), contrast(mag, freqs, c.bands, c.fmin, c.quantile, rate)])
    return (standardised(out, False) if c.normalise else out).astype(np.float32)


def tuning(mag: np.ndarray, freqs: np.ndarray) -> float:
    """Deviation of the strongest bins from the tempered scale, in parts of a semitone."""
    strong = (mag >= np.median(mag[mag > 0])) if (mag > 0).any() else np.zeros_like(mag, bool)
    peaks = strong[1:-1] & (mag[1:-1] > mag[:-2]) & (mag[1:-1] >= mag[2:])
    at = freqs[1:-1][np.nonzero(peaks)[0]]
    at = at[(at > 150) & (at < 4000)]
    if not len(at):
        return 0.0
    off = (12 * np.log2(at / 440.0) + 0.5) % 1.0 - 0.5
    counts, edges = np.histogram(off, bins=np.linspace(-0.5, 0.5, 101))
    return float(edges[np.argmax(counts)])


def chroma(wave, rate: int = RATE, c: Chroma = Chroma()) -> np.ndarray:
    """Energy of the pitch classes, each frame scaled to its largest, standardised as a whole."""
    x = checked(wave, rate)
    mag, freqs = spectrum(x, c), np.fft.rfftfreq(c.n_fft, 1 / rate)
    off = tuning(mag, freqs) if c.tuning is None else c.tuning
    n = c.n_chroma
    octaves = np.log2(np.maximum(freqs[1:], 1e-9) / (440.0 * 2 ** (off / n) / 16))
    place = np.concatenate([[n * octaves[0] - 1.5 * n], n * octaves])
    width = np.concatenate([np.maximum(np.diff(place), 1.0), [1.0]])
    apart = np.subtract.outer(place, np.arange(n)).T
    apart = np.remainder(apart + n // 2 + 10 * n, n) - n // 2
    weight = np.exp(-0.5 * (2 * apart / width) ** 2)
    weight /= np.maximum(np.sqrt((weight**2).sum(0, keepdims=True)), TINY)
    weight *= np.exp(-0.5 * ((place / n - 5.0) / 2.0) ** 2)
    weight = np.roll(weight, -3 * (n // 12), axis=0)
    raw = weight @ mag**2
    out = raw / np.maximum(raw.max(0, keepdims=True), np.finfo(np.float64).tiny)
    return (standardised(out, False) if c.normalise else out).astype(np.float32)


def zcr(wave, rate: int = RATE, c: Framed = Framed()) -> np.ndarray:
    """Part of the samples of a frame at which the sign changes; zero is positive."""
    x = checked(wave, rate)
    padded = np.pad(x, c.length // 2, mode="edge") if c.center else x
    sign = framed(padded, c.length, c.hop, False) < 0
    out = ((sign[:, 1:] != sign[:, :-1]).sum(1) / c.length)[None, :]
    return (standardised(out, False) if c.normalise else out).astype(np.float32)


def energy(wave, rate: int = RATE, c: Framed = Framed()) -> np.ndarray:
    """Root mean square of each frame."""
    out = np.sqrt((framed(checked(wave, rate), c.length, c.hop, c.center) ** 2).mean(1))[None, :]
    return (standardised(out, False) if c.normalise else out).astype(np.float32)


#: The feature extractors by name; more may be registered, each a function of waveform and rate to (channels, frames).
FAMILIES: dict[str, Callable[..., np.ndarray]] = {"mfcc": mfcc, "mel": mel, "spectral": spectral, "chroma": chroma, "zcr": zcr, "energy": energy}


def resampled(wave, source: int, target: int = RATE, half: int = 10) -> np.ndarray:
    """Polyphase resampling by the reduced ratio of the rates, with a windowed low-pass filter."""
    if source <= 0 or target <= 0:
        raise FeatureError("sample rates must be positive")
    x = np.asarray(wave, np.float64)
    g = math.gcd(source, target)
    up, down = target // g, source // g
    if up == down or not len(x):
        return x
    widest = max(up, down)
    at = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(at / widest) * np.kaiser(len(at), 5.0)
    taps *= up / taps.sum()
    n = math.ceil(len(x) * up / down)
    out = np.zeros(n)
    # the output at k reads inputs whose place, scaled up, lies within the filter
    centre = np.arange(n) * down
    lowest = -((half * widest - centre) // up)
    for j in range(2 * half * widest // up + 2):
        i = lowest + j
        tap = centre - i * up + half * widest
        ok = (i >= 0) & (i < len(x)) & (tap >= 0) & (tap < len(taps))
        out[ok] += x[i[ok]] * taps[tap[ok]]
    return out


def trimmed(wave, top_db: float = 25.0, length: int = 2048, hop: int = 512) -> np.ndarray:
    """Without leading and trailing frames more than ``top_db`` below the loudest; silence is left as it is."""
    x = np.asarray(wave, np.float64)
    if not len(x):
        return x
    level = np.sqrt((framed(x, length, hop, True) ** 2).mean(1))
    loud = np.flatnonzero(20 * np.log10(np.maximum(level, 1e-10) / max(level.max(), 1e-10)) > -top_db)
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)] if level.max() > 0 and len(loud) else x


def live_scalars(wave, rate: int = RATE) -> dict[str, float]:
    """Level, peak, centroid, crossings, onset and roll-off of one window, from a single transform of at most 8 s."""
    x = checked(wave, rate)
    n = min(len(x), rate * 8)
    mag, freqs = np.abs(np.fft.rfft(x[:n] * np.hanning(n))), np.fft.rfftfreq(n, 1 / rate)
    middle = float((mag * freqs).sum() / (mag.sum() + 1e-9))
    sign = np.signbit(x[:n])
    return {"rms": float(np.sqrt((x * x).mean() + 1e-12)), "peak": float(np.abs(x).max() + 1e-9), "centroid": middle, "zcr": float((sign[1:] != sign[:-1]).mean()) if n > 1 else 0.0, "onset": float(mag.std()), "rolloff": middle * 1.7}


def seed_of(content: bytes | None) -> int:
    """A seed from content: the first 8 hex digits of its SHA-256, 42 if there is none."""
    import hashlib

    return int(hashlib.sha256(content).hexdigest()[:8], 16) if content else 42


# Spark


def content_noise(content: Column, spread: float = 0.7) -> Column:
    """A normal draw that depends on the content alone, for scores that must come out alike for the same recording."""

    @F.pandas_udf("double")
    def draw(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: float(np.random.default_rng(seed_of(bytes(x) if x is not None else None)).normal(0, spread)))

    return draw(content)


_FAMILY = "struct<values:array<array<float>>,shape:string>"
FEATURES = "status string, error string, " + ", ".join(f"{name} {_FAMILY}" for name in ("mfcc", "mel", "spectral", "chroma", "zcr", "energy"))


def features(df: DataFrame, key: str, wave: str, rate: int = RATE, condition: bool = True) -> DataFrame:
    """``key``, status, error and the six feature matrices of each waveform, one Arrow batch at a time.

    With ``condition`` the offset is removed and the peak scaled to 0.99 first.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, w in zip(frame["k"], frame["w"], strict=True):
                row = {"k": k, "status": "success", "error": ""} | dict.fromkeys(FAMILIES)
                try:
                    x = checked(w if w is not None else [], rate)
                    if condition:
                        x = x - x.mean()
                        x = x / np.abs(x).max() * 0.99 if np.abs(x).max() > 0 else x
                    for name, extract in FAMILIES.items():
                        out = extract(x, rate)
                        if not np.isfinite(out).all():
                            raise FeatureError(f"{name} has values that are not finite")
                        row[name] = {"values": [c.tolist() for c in out], "shape": str(out.shape)}
                except (FeatureError, ValueError) as error:
                    row |= {"status": "failed", "error": str(error)} | dict.fromkeys(FAMILIES)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["k", "status", "error", *FAMILIES])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(wave).alias("w")).mapInPandas(run, f"k {kind}, {FEATURES}").withColumnRenamed("k", key)


def feature_summaries(df: DataFrame, key: str, wave: str, rate: int = RATE) -> DataFrame:
    """Status and shape of each family, and the mean absolute value of the cepstral coefficients."""
    out = features(df, key, wave, rate)
    flat = F.flatten("mfcc.values")
    size = F.aggregate(flat, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(flat)
    return out.select(key, "status", "error", *[F.col(f"{n}.shape").alias(f"{n}_shape") for n in FAMILIES], F.round(size, 4).alias("mfcc_size"))


def live_windows(df: DataFrame, key: str, wave: str, rate: int = RATE) -> DataFrame:
    """``live_scalars`` of each waveform; nulls where it can't be analysed."""
    names = ("rms", "peak", "centroid", "zcr", "onset", "rolloff")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, w in zip(frame["k"], frame["w"], strict=True):
                try:
                    rows.append({"k": k} | live_scalars(w if w is not None else [], rate))
                except FeatureError:
                    rows.append({"k": k} | dict.fromkeys(names))
            yield pd.DataFrame(rows, columns=["k", *names])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(wave).alias("w")).mapInPandas(run, f"k {kind}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("k", key)
