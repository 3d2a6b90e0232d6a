"""Waveform expressions over ``array<double>`` columns, inside the JVM: no row leaves for Python.

An empty or null waveform gives null, except that silence in gives silence out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, where a lambda over samples would work it out for each of them."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def as_double(wave: Column) -> Column:
    return F.transform(wave, lambda x: x.cast("double"))


def total(wave: Column) -> Column:
    return F.aggregate(wave, F.lit(0.0), lambda s, x: s + x)


def mean(wave: Column) -> Column:
    return F.when(F.size(wave) > 0, total(wave) / F.size(wave))


def mono(channels: Column) -> Column:
    """Mean of the channels, frame by frame; channels is an array of equally long arrays."""
    first = F.get(channels, F.lit(0))
    rest = F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0)))
    summed = F.aggregate(rest, first, lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.transform(summed, lambda x: x / F.size(channels))


def finite(wave: Column) -> Column:
    return F.forall(wave, lambda x: ~(F.isnan(x) | x.isin(float("inf"), float("-inf")) | x.isNull()))


def duration(wave: Column, rate: int = 16_000) -> Column:
    return F.size(wave) / F.lit(rate)


def long_enough(wave: Column, seconds: float = 0.25, rate: int = 16_000) -> Column:
    return F.size(wave) >= F.lit(round(seconds * rate))


def without_offset(wave: Column) -> Column:
    return _given(mean(wave), lambda m: F.transform(wave, lambda x: x - m))


def peak(wave: Column) -> Column:
    return F.array_max(F.transform(wave, lambda x: F.abs(x)))


def peak_normalised(wave: Column, to: float = 0.99) -> Column:
    """Scaled so that the largest value is ``to``; silence stays silence."""
    return _given(peak(wave), lambda top: F.when(top > 0, F.transform(wave, lambda x: x / top * to)).otherwise(wave))


def rms(wave: Column) -> Column:
    return F.when(F.size(wave) > 0, F.sqrt(F.aggregate(wave, F.lit(0.0), lambda s, x: s + x * x) / F.size(wave)))


def dynamic_range(wave: Column) -> Column:
    return 20 * F.log10((peak(wave) + 1e-8) / (rms(wave) + 1e-8))


def silence_ratio(wave: Column, below: float = 0.001) -> Column:
    return F.when(F.size(wave) > 0, F.size(F.filter(wave, lambda x: F.abs(x) < below)) / F.size(wave))


def quality(wave: Column, rate: int = 16_000) -> Column:
    """Duration, level, peak, dynamic range and silence of a waveform."""
    return F.struct(duration(wave, rate).alias("duration"), rms(wave).alias("rms"), peak(wave).alias("peak"), dynamic_range(wave).alias("dynamic_range"), silence_ratio(wave).alias("silence_ratio"))


def zero_crossings(wave: Column) -> Column:
    """Number of sign changes between neighbours; zero counts as positive."""
    before, after = F.slice(wave, 1, F.greatest(F.size(wave) - 1, F.lit(0))), F.slice(wave, 2, F.greatest(F.size(wave) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(before, after, lambda a, b: F.when((a < 0) != (b < 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def zero_crossing_rate(wave: Column) -> Column:
    return F.when(F.size(wave) > 0, zero_crossings(wave) / F.size(wave))


def frames(wave: Column, length: int, hop: int) -> Column:
    """Overlapping frames without padding, those that fit whole."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(wave) - length, F.lit(0)), F.lit(hop))
    return F.transform(F.filter(starts, lambda s: s + length <= F.size(wave)), lambda s: F.slice(wave, s + 1, F.lit(length)))


def frame_rms(wave: Column, length: int, hop: int) -> Column:
    return F.transform(frames(wave, length, hop), rms)


def frame_zcr(wave: Column, length: int, hop: int) -> Column:
    return F.transform(frames(wave, length, hop), zero_crossing_rate)


def standardised(values: Column, tiny: float = 1e-8) -> Column:
    """z-scores; a constant sequence gives zeros."""

    def scaled(m: Column) -> Column:
        spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(values))
        return _given(spread, lambda k: F.transform(values, lambda x: (x - m) / (k + tiny)))

    return _given(mean(values), scaled)


def time_masked(channels: Column, start: Column, length: Column) -> Column:
    """Frames ``start .. start+length-1`` of every channel set to 0: a mask in time for training rows."""
    return F.transform(channels, lambda c: F.transform(c, lambda x, i: F.when((i >= start) & (i < start + length), 0.0).otherwise(x)))


def random_time_mask(channels: Column, probability: float = 0.10, most: int = 8, seed: int = 42) -> Column:
    """With the given probability masks 1 to ``most`` frames, at most an eighth of the time, at a drawn place."""
    n = F.size(F.get(channels, F.lit(0)))
    longest = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / 8)))
    drawn = F.struct((F.lit(1) + F.floor(F.rand(seed) * longest)).cast("int").alias("length"), F.rand(seed + 1).alias("place"), (F.rand(seed + 2) < probability).alias("masked"))

    def masked(g: Column) -> Column:
        start = F.floor(g["place"] * F.greatest(F.lit(1), n - g["length"] + 1)).cast("int")
        return F.when(g["masked"], time_masked(channels, start, g["length"])).otherwise(channels)

    return _given(drawn, masked)


def shape_text(channels: Column) -> Column:
    return F.concat(F.lit("("), F.size(channels).cast("string"), F.lit(", "), F.coalesce(F.size(F.get(channels, F.lit(0))), F.lit(0)).cast("string"), F.lit(")"))


def joined_blocks(blocks: Column) -> Column:
    """Blocks of channels put one behind the other in time, down to the fewest channels that any block has."""
    fewest = F.array_min(F.transform(blocks, F.size))
    return _given(fewest, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.flatten(F.transform(blocks, lambda b: F.get(b, c))))).otherwise(F.array().cast("array<array<double>>")))


def kept_blocks(blocks: Column, most: int = 240, shown: int = 120) -> Column:
    """A bounded view of many blocks: every second one beyond ``most``, and at most the last ``shown``."""
    thinned = F.when(F.size(blocks) > most, F.filter(blocks, lambda _, i: i % 2 == 0)).otherwise(blocks)
    return F.slice(thinned, F.greatest(F.size(thinned) - shown + 1, F.lit(1)), F.lit(shown))
