"""Same and near-same records across splits, by content-defined chunks (problem 3).

``chunks`` cuts normalised records where a rolling hash over ``window`` characters hits a mask, so that equal stretches
are cut alike wherever they stand. ``overlap_fractions`` joins the chunk digests across the sides and sums the lengths of
the shared chunks into an overlap fraction for each record; ``shared`` does so for each pair of records. Records are
reduced to classes of equal text before they are cut, so copies cost nothing and a class of a third of all rows is one.

Two kinds of record need other chunks, for which content-defined cuts can't give the required result:

* a segment is a stretch of samples, its chunks are the hop cells it covers (``shared_cells``): two segments of one
  recording share a cell just if their indexes differ by at most 1;
* a 128-bit print differs by flipped bits, and a flip moves or spoils every cut near it, so no cut rule promises a
  shared chunk. ``near_prints`` cuts at fixed bit positions and lets a chunk differ by as many bits as the pigeonhole
  principle asks for, which loses no pair (``pigeonhole``).

Defined results: null and empty records have no chunks and overlap with nothing; records shorter than a chunk are one
chunk; a print that isn't 32 hex digits is not given. Repeated rows are members of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.functions.keys import strip

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK64 = (1 << 64) - 1
PRINT_BITS, PRINT_RADIUS = 128, 8
WINDOW, AVERAGE, LEAST, MOST = 6, 16, 8, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def cut_all(texts: list[str], window: int = WINDOW, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text's number, start, end, digest`` of the chunks of several texts.

    The texts are laid one behind the other; prefix sums of one polynomial hash then give every window and every chunk,
    and only the places where the rolling hash hits are walked through one by one.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if not n:
        return (np.empty(0, np.int64),) * 4
    with np.errstate(over="ignore"):
        up, down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[:n], out=sums[1:])
        hits = np.empty(0, np.int64)
        if n >= window:
            rolled = _mix((sums[window:] - sums[: n - window + 1]) * down[: n - window + 1])
            hits = np.flatnonzero(rolled % np.uint64(average) == 0) + window
        owner = np.searchsorted(first, hits - 1, "right") - 1
        inside = hits - window >= first[owner]  # the window lies in one text
        hits, owner = hits[inside], owner[inside]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        found, whose, stops = hits.tolist(), [], []
        for text, (begin, size) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True)):
            start, end, ends = begin, begin + size, []
            for hit in found[bounds[text] : bounds[text + 1]]:
                while hit - start > most:
                    start += most
                    ends.append(start)
                if hit - start >= least:
                    ends.append(hit)
                    start = hit
            while end - start > most:
                start += most
                ends.append(start)
            if start < end:
                ends.append(end)
            stops += ends
            whose += [text] * len(ends)
        of, ends = np.array(whose, np.int64), np.array(stops, np.int64)
        starts = np.where(np.diff(of, prepend=-1) != 0, first[of], np.concatenate([[0], ends[:-1]]))
        digests = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return of, starts - first[of], ends - first[of], digests.view(np.int64)


def cut(text: str, *rule: int) -> list[tuple[int, int, int]]:
    """``(start, end, digest)`` of the chunks of one text."""
    return list(zip(*(x.tolist() for x in cut_all([text], *rule)[1:]), strict=True))


def chunks(df: DataFrame) -> DataFrame:
    """``(record, digest, length, times, size)`` of the texts in ``record bigint, text``.

    times: how often the record has the chunk; size: the record's length.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            of, starts, ends, digests = cut_all(texts)
            order = np.lexsort((ends - starts, digests, of))
            of, lengths, digests = of[order], (ends - starts)[order], digests[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (digests[1:] != digests[:-1]) | (lengths[1:] != lengths[:-1])
            at = np.flatnonzero(new)
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pd.DataFrame({"record": frame["record"].to_numpy()[of[at]], "digest": digests[at], "length": lengths[at].astype(np.int32), "times": np.diff(np.append(at, len(of))).astype(np.int32), "size": sizes[of[at]].astype(np.int32)})

    return df.select("record", "text").where("record IS NOT NULL AND text IS NOT NULL AND text <> ''").mapInPandas(run, "record bigint, digest bigint, length int, times int, size int")


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left, right, fraction)``: which part of the longer record the two share; pairs that share nothing don't occur.

    A chunk that a record repeats counts as often as both records have it.
    """
    a = left.select(F.col("record").alias("left"), "digest", "length", F.col("size").alias("left_size"), F.col("times").alias("left_times"))
    b = right.select(F.col("record").alias("right"), "digest", "length", F.col("size").alias("right_size"), F.col("times").alias("right_times"))
    total = F.sum(F.col("length") * F.least("left_times", "right_times"))
    return a.join(b, ["digest", "length"]).groupBy("left", "right").agg((total / F.max(F.greatest("left_size", "right_size"))).alias("fraction"))


def overlap_fractions(chunked: DataFrame, side: Column) -> DataFrame:
    """``(record, fraction)``: which part of a record lies in chunks that some record of the other side has; records without such are left out.

    ``side`` is 1 or 2, by the record. Who has a chunk is kept as two bits and not as a list, so a chunk of a third of all
    records is one row, and no pair of records is made.
    """
    held = chunked.withColumn("side", side)
    who = held.groupBy("digest", "length").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("digest", "length")
    return held.join(who, ["digest", "length"]).groupBy("record").agg((F.sum(F.col("length") * F.col("times")) / F.max("size")).alias("fraction"))


def shared_cells(df: DataFrame, hop: int = 32_000, cells: int = 2) -> DataFrame:
    """``(recording, left, right, fraction)``: segments of two sides that share samples; df: ``recording, index, side``, side 0 or 1.

    Segment i covers the hop cells i .. i+cells-1, its chunks. A cell belongs to at most ``cells`` indexes of each side,
    so who has it is kept in the bits of one number and a segment of a third of all rows is one bit.
    """
    cell = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("offset")
    held = df.where("recording IS NOT NULL AND index IS NOT NULL").select("recording", "index", "side", cell)
    held = held.groupBy("recording", (F.col("index") + F.col("offset")).alias("cell")).agg(F.expr("bit_or(shiftleft(bigint(1), offset * 2 + side))").alias("who"))
    evens = sum(1 << (2 * i) for i in range(cells))
    both = held.where((F.col("who").bitwiseAND(F.lit(evens)) != 0) & (F.col("who").bitwiseAND(F.lit(2 * evens)) != 0))
    ways = F.array(*[F.when((F.col("who").bitwiseAND(F.lit(1 << (2 * x))) != 0) & (F.col("who").bitwiseAND(F.lit(2 << (2 * y))) != 0), F.struct((F.col("cell") - x).alias("left"), (F.col("cell") - y).alias("right"))) for x in range(cells) for y in range(cells)])
    pairs = both.select("recording", F.inline(F.array_compact(ways)))
    return pairs.groupBy("recording", "left", "right").agg((F.sum(F.lit(hop)) / F.lit(hop * cells)).alias("fraction"))


# prints


def print_halves(c: Column | str) -> tuple[Column, Column]:
    """The two 64-bit halves of a print, as bigint; null where it isn't 32 hex digits."""
    text = F.lower(strip(c))
    given = (F.length(text) == 32) & (F.translate(text, "0123456789abcdef", "") == "")
    word = [F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return tuple(F.when(given, F.shiftleft(word[i], 32).bitwiseOR(word[i + 1])) for i in (0, 2))


def pigeonhole(n_left: float, n_right: float, bits: int = PRINT_BITS, radius: int = PRINT_RADIUS) -> list[tuple[int, int, int]]:
    """``(first bit, width, flips)`` of the bands. Any two prints within ``radius`` agree on some band up to its flips.

    That holds whenever the flips plus one, summed over the bands, exceed the radius. Of the layouts with at most one
    flip a band the cheapest is taken, a chance candidate counted as a tenth of a key that is sent. Every layout is
    exact; only its cost depends on the counts.
    """
    best, cost = [], float("inf")
    for m in range((radius + 2) // 2, radius + 2):
        flips = [1] * (radius + 1 - m) + [0] * (2 * m - radius - 1)
        edges = [bits * i // m for i in range(m + 1)]
        bands = [(edges[i], edges[i + 1] - edges[i], flips[i]) for i in range(m)]
        keys = sum(1 + w * f for _, w, f in bands)
        chance = sum((1 + w * f) * n_left * n_right / 2.0**w for _, w, f in bands)
        if (now := keys * n_right + m * n_left + 0.1 * chance) < cost:
            best, cost = bands, now
    return best


def _band(hi: Column, lo: Column, first: int, width: int) -> Column:
    """Bits ``first .. first+width-1`` of a print, counted from the highest, as a number."""
    out = F.lit(0).cast("bigint")
    for half, base in ((hi, 0), (lo, 64)):
        low, high = max(first, base), min(first + width, base + 64)
        if low < high:
            part = F.shiftrightunsigned(half, base + 64 - high).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))
            out = F.shiftleft(out, high - low).bitwiseOR(part)
    return out


def _keys(bands: list[tuple[int, int, int]], flipped: bool) -> Column:
    """Band keys with the band's number in the lowest digits; with ``flipped`` also those at one flipped bit, where the band allows it."""
    each = []
    for i, (first, width, flips) in enumerate(bands):
        value = _band(F.col("hi"), F.col("lo"), first, width)
        ways = [value, *[value.bitwiseXOR(F.lit(1 << b).cast("bigint")) for b in range(width)]] if flipped and flips else [value]
        each += [F.shiftleft(x, 4).bitwiseOR(F.lit(i).cast("bigint")) for x in ways]
    return F.explode(F.array(*each))


def near_prints(prints: DataFrame, n_left: float, n_right: float, radius: int = PRINT_RADIUS) -> DataFrame:
    """Pairs ``(left_hi, left_lo, right_hi, right_lo)`` of prints of two sides within ``radius`` bits, each once.

    prints: distinct ``hi, lo, sides``, bit 0 of sides for the left and bit 1 for the right side. ``n_left`` and
    ``n_right`` are the rough sizes that the layout of the bands is chosen by.
    """
    bands = pigeonhole(max(1, n_left), max(1, n_right), radius=radius)
    a = prints.where(F.col("sides").bitwiseAND(F.lit(1)) != 0).select(F.col("hi").alias("left_hi"), F.col("lo").alias("left_lo"), _keys(bands, False).alias("key"))
    b = prints.where(F.col("sides").bitwiseAND(F.lit(2)) != 0).select(F.col("hi").alias("right_hi"), F.col("lo").alias("right_lo"), _keys(bands, True).alias("key"))
    far = F.bit_count(F.col("left_hi").bitwiseXOR(F.col("right_hi"))) + F.bit_count(F.col("left_lo").bitwiseXOR(F.col("right_lo")))
    return a.join(b, (a["key"] == b["key"]) & (far <= radius)).select("left_hi", "left_lo", "right_hi", "right_lo").distinct()
