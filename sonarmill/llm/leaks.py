"""Evaluation passages inside training texts, by CGK embedding and bit-sampling LSH (problem 7).

An item is cut into passages of ``window`` words, one from each word on, and every document into windows of that size.
The CGK random walk turns a window into a string of three times its length, so that few edits become few differing
places; an LSH table samples ``sample`` places of one walk. Tables are repeated, each with its own walk and sample,
until windows within ``edits`` word edits meet in some table with probability ``recall``; equal windows meet in every
table. Each meeting is then verified by the exact edit distance of the words, so nothing false comes out.
An inserted or dropped word moves the end of a document's window: with ``free_end`` a passage is compared with all windows
that begin where the meeting's does and have up to ``edits`` words less or more, the nearest counting; else with the one
of equal length, where a moved end costs an edit of its own.

Most windows are nowhere near an item and need no embedding. Of a passage cut into ``edits + 1`` runs of words, ``edits``
edits leave one run as it is, so only windows that may hold such a run where it belongs are embedded. That loses nothing.

The item side is small and the corpus is never shuffled: documents are read once, in Arrow batches, against the items'
keys. That side is broadcast only up to ``ITEM_CHARS`` characters, measured before; beyond it a filter of fixed size
names the items' runs, and the keys of the windows that pass it are joined with those of the items, with the same result.

Defined results: null and empty texts hold nothing, a text shorter than a window has none, and so has a shorter item.
Repeated documents or items come out once for each pair of ids. Texts are read whole; a very long one costs memory in
proportion to itself only.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.llm.words import words
from sonarmill.session import cut_lineage, spread

WINDOW = 12
SAMPLE = 8
#: Sought in the simulation that the number of tables comes from; measured on the given documents it must be 0.95 at least.
RECALL = 0.97
#: Items of up to so many characters in all are broadcast to the workers.
ITEM_CHARS = 16_000_000
#: Words of documents that are worked on at once in a worker.
BLOCK_WORDS = 200_000
#: Windows that are embedded at once.
BLOCK_WINDOWS = 100_000
#: The filter of the items' runs has at most ``2**FILTER_BITS`` places, a byte each in a worker; it only saves work.
FILTER_BITS = 24


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_keys(windows: np.ndarray, table: int, sample: int | None) -> np.ndarray:
    """The LSH key in one table of each window, a row of 64-bit hashes of its words.

    The walk stands at a word of the window, writes it and goes on by the bit that the table draws for word and step;
    past the window's end it writes a blank. Only sampled places enter the key; with ``sample`` None all do.
    """
    n, window = windows.shape
    steps = 3 * window
    draw = np.random.default_rng(7919 + table)
    taken = set(range(steps) if sample is None else draw.choice(steps, sample, replace=False).tolist())
    salt = np.uint64(draw.integers(1, 1 << 62))
    # a blank column past the end, which every step leaves as it is
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1).ravel()
    bits = [_mix(padded ^ (salt + np.uint64(i))) for i in range((steps + 63) // 64)]
    key = np.full(n, np.uint64(table), np.uint64)
    at, end = np.arange(n) * (window + 1), np.arange(n) * (window + 1) + window
    for step in range(max(taken) + 1):
        if step in taken:
            with np.errstate(over="ignore"):
                key = _mix(key * np.uint64(31) + padded[at])
        at = np.minimum(at + ((bits[step // 64][at] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), end)
    return key


def edit_distance(a: list[str], b: list[str], most: int, free_end: bool = False) -> int:
    """Word edit distance, or ``most + 1`` if it is larger; with ``free_end`` that of ``a`` to the nearest beginning of ``b``."""
    if not free_end and abs(len(a) - len(b)) > most:
        return most + 1
    if a == (b[: len(a)] if free_end else b):
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return min(min(row) if free_end else row[-1], most + 1)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int, free_end: bool = False) -> np.ndarray:
    """``edit_distance`` of each row of ``a`` to the same row of ``b``, words given as numbers."""
    width = a.shape[1]
    if most == 1 and free_end and b.shape[1] == width + 1:
        return _one_edit(a, b)
    out = np.zeros(len(a), np.int64)
    todo = np.flatnonzero((a != b[:, :width]).any(1)) if b.shape[1] >= width else np.arange(len(a))
    x, y = a[todo].T, b[todo].T
    row = [np.full(len(todo), j, np.int16) for j in range(len(y) + 1)]
    for i in range(len(x)):
        new = [np.full(len(todo), i + 1, np.int16)]
        for j in range(len(y)):
            new.append(np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + (x[i] != y[j])))
        row = new
    out[todo] = np.min(row, 0) if free_end else row[-1]
    return np.minimum(out, most + 1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for more: behind the first difference the rest must agree in place, moved on by a word or moved back by one."""
    n, width = a.shape

    def rest(equal: np.ndarray) -> np.ndarray:
        """Whether all is equal from each word on; past the end it is."""
        return np.concatenate([np.logical_and.accumulate(equal[:, ::-1], 1)[:, ::-1], np.ones((n, 1), bool)], 1)

    same = a == b[:, :width]
    first = np.where(same.all(1), width, (~same).argmax(1))
    line, at = np.arange(n), np.minimum(first, width - 1)
    near = rest(same)[line, at + 1] | rest(a == b[:, 1:])[line, at] | rest(a[:, 1:] == b[:, : width - 1])[line, at]
    return np.where(first == width, 0, np.where(near, 1, 2))


@functools.lru_cache(maxsize=64)
def tables_for(recall: float, edits: int, window: int = WINDOW, sample: int = SAMPLE, trials: int = 4000) -> int:
    """How many tables reach the recall for windows ``edits`` word edits apart, from the rate at which random ones meet."""
    if not edits:
        return 1
    draw = np.random.default_rng(5)
    met = 0.0
    rounds = 8
    for table in range(rounds):
        a = draw.integers(1, 1 << 62, (trials // rounds, window)).astype(np.uint64)
        b = a.copy()
        for row in b:
            for _ in range(edits):
                i, kind = int(draw.integers(window)), int(draw.integers(3))
                new = np.uint64(draw.integers(1, 1 << 62))
                if kind == 0:
                    row[i] = new
                elif kind == 1:
                    row[i + 1 :] = row[i:-1].copy()
                    row[i] = new
                else:
                    row[i:-1] = row[i + 1 :].copy()
                    row[-1] = new
        met += float(np.mean(window_keys(a, table, sample) == window_keys(b, table, sample)))
    rate = max(1e-4, met / rounds)
    return math.ceil(math.log(1 - recall) / math.log(1 - min(rate, 0.999999)))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class Block:
    """Documents with at least one window, their words behind each other as hashes."""

    def __init__(self, ids: list, docs: list[list[str]], hashes: _Hashes, window: int):
        self.ids, self.docs = np.array(ids), docs
        self.flat = np.array([hashes[w] for d in docs for w in d], np.uint64)
        sizes = np.array([len(d) for d in docs], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.counts = sizes - window + 1  # windows of each document

    def starts(self) -> np.ndarray:
        """Where every window begins, among the block's words."""
        before = np.cumsum(self.counts) - self.counts
        return np.arange(self.counts.sum()) + np.repeat(self.first - before, self.counts)

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, starts, "right") - 1


def blocks(ids: list, texts: list, hashes: _Hashes, window: int, spare: int = 0) -> Iterator[Block]:
    """Blocks of bounded words; a longer text is a block of its own.

    ``spare`` blanks, which equal no word, end each document, so that its last windows may be so many words short.
    """
    held, docs, n = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        found = words(text)
        if key is None or len(found) + spare < window or not found:
            continue
        found += [""] * spare
        if docs and n + len(found) > BLOCK_WORDS:
            yield Block(held, docs, hashes, window)
            held, docs, n = [], [], 0
        held.append(key), docs.append(found)
        n += len(found)
    if docs:
        yield Block(held, docs, hashes, window)


def run_length(window: int, edits: int) -> int:
    """Length of the runs of which ``edits`` edits leave one as it is."""
    return max(1, window // (edits + 1))


def runs(flat: np.ndarray, length: int) -> np.ndarray:
    """A hash of the words from each place on."""
    out = np.zeros(max(0, len(flat) - length + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = out * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + len(out)]
    return _mix(out)


def near_starts(block: Block, hit: np.ndarray, window: int, edits: int) -> np.ndarray:
    """Where windows begin that hold a run of an item where it may belong; hit: whether the run from each word on is an item's.

    Of the passage's runs each may be the one that is intact, moved by up to ``edits`` words.
    """
    length = run_length(window, edits)
    places = np.flatnonzero(hit)
    doc = block.owner(places)
    near = np.zeros(len(block.flat), bool)
    for part in range(edits + 1):
        for moved in range(-edits, edits + 1):
            start = places - part * length + moved
            inside = (start >= block.first[doc]) & (start < block.first[doc] + np.maximum(block.counts[doc], 0))
            near[start[inside]] = True
    return np.flatnonzero(near)


def gathered(flat: np.ndarray, starts: np.ndarray, width: int, blank: int = 0) -> np.ndarray:
    """``width`` words from each start on, blank past the end."""
    padded = np.concatenate([flat, np.full(width, blank, flat.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[starts]


class Passages:
    """The items' passages and their keys, as broadcast to the workers."""

    def __init__(self, rows: list[tuple[int, str]], window: int, tables: int, sample: int | None, edits: int, free_end: bool = False):
        self.window, self.tables, self.sample, self.edits, self.free_end = window, tables, sample, edits, free_end
        self.numbers: dict[str, int] = {}
        items, begin, ids, numbers, keys = [], [], [], [], [[] for _ in range(tables)]
        known = [np.empty(0, np.uint64)]
        base = 0
        for block in blocks([r[0] for r in rows], [r[1] for r in rows], _Hashes(), window):
            starts = block.starts()
            of = block.owner(starts)
            numbers += [self.numbers.setdefault(w, len(self.numbers)) for d in block.docs for w in d]
            ids.append(block.ids[of])
            begin.append(starts - block.first[of])
            items.append(starts + base)
            known.append(runs(block.flat, run_length(window, edits)))
            for table in range(tables):
                keys[table].append(window_keys(gathered(block.flat, starts, window), table, sample))
            base += len(block.flat)
        empty = np.empty(0, np.int64)
        self.words = np.array(numbers, np.int32)
        self.ids, self.begin, self.at = (np.concatenate(x) if x else empty for x in (ids, begin, items))
        self.keys, self.refs = [], []
        for table in keys:
            every = np.concatenate(table) if table else np.empty(0, np.uint64)
            order = np.argsort(every, kind="stable")
            self.keys.append(every[order]), self.refs.append(order)
        self.runs = np.unique(np.concatenate(known))
        bits = min(FILTER_BITS, max(12, (32 * len(self.runs)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.runs >> self.shift] = True

    def hit(self, flat: np.ndarray) -> np.ndarray:
        found = runs(flat, run_length(self.window, self.edits))
        out = self.filter[found >> self.shift]
        maybe = np.flatnonzero(out)
        out[maybe] = np.isin(found[maybe], self.runs)
        return out

    def meetings(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``window's number, passage's number`` of every meeting in some table, each once."""
        every = [np.empty(0, np.int64)]
        for table in range(self.tables):
            keys = window_keys(windows, table, self.sample)
            low, high = np.searchsorted(self.keys[table], keys, "left"), np.searchsorted(self.keys[table], keys, "right")
            n = high - low
            ref = self.refs[table][np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]
            every.append(np.repeat(np.arange(len(keys)), n) * len(self.at) + ref)
        code = np.concatenate(every)
        code.sort()
        code = code[np.diff(code, prepend=-1) > 0]
        return code // max(1, len(self.at)), code % max(1, len(self.at))

    def verified(self, block: Block) -> pd.DataFrame:
        """The block's ``FOUND`` rows, each place once."""
        starts = near_starts(block, self.hit(block.flat), self.window, self.edits)
        numbers = np.full(len(block.flat), -1, np.int32)
        for doc in np.unique(block.owner(starts)).tolist():
            own = block.docs[doc]
            numbers[block.first[doc] : block.first[doc] + len(own)] = [self.numbers.get(w, -1) for w in own]
        out = []
        for a in range(0, len(starts), BLOCK_WINDOWS):
            own = starts[a : a + BLOCK_WINDOWS]
            window, passage = self.meetings(gathered(block.flat, own, self.window))
            left = gathered(self.words, self.at[passage], self.window, -1)
            right = gathered(numbers, own[window], self.window + (self.edits if self.free_end else 0), -1)
            doc = block.owner(own[window])
            # what lies behind the document's end belongs to the next one
            right[own[window][:, None] + np.arange(right.shape[1]) >= (block.first + block.counts + self.window - 1)[doc][:, None]] = -1
            far = edit_distances(left, right, self.edits, self.free_end)
            ok = far <= self.edits
            window, passage, doc = window[ok], passage[ok], doc[ok]
            out.append(pd.DataFrame({"doc_id": block.ids[doc], "item_id": self.ids[passage], "doc_start": own[window] - block.first[doc], "item_start": self.begin[passage], "edits": far[ok]}))
        return pd.concat(out) if out else pd.DataFrame({x.split()[0]: pd.Series(dtype="int64") for x in FOUND.split(", ")})


FOUND = "doc_id bigint, item_id bigint, doc_start int, item_start int, edits int"


def found_passages(documents: DataFrame, items: DataFrame, edits: int = 0, window: int = WINDOW, recall: float = RECALL, sample: int = SAMPLE, item_chars: int = ITEM_CHARS, free_end: bool = False) -> DataFrame:
    """Every verified meeting ``FOUND`` of a document's window with an item's passage.

    documents: ``doc_id, text``; items: ``item_id, text``. With ``edits`` 0 a table samples all places of its walk: equal
    windows still meet for certain and others hardly ever.
    """
    tables, places = tables_for(recall, edits, window, sample), sample if edits else None
    items = items.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    documents = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > item_chars:
        return _joined_passages(documents, items, edits, window, tables, places, free_end)
    passages = Passages([(r["item_id"], r["text"]) for r in items.distinct().collect()], window, tables, places, edits, free_end)  # at most item_chars characters
    shared = documents.sparkSession.sparkContext.broadcast(passages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages, hashes = shared.value, _Hashes()
        for frame in frames:
            for block in blocks(frame["doc_id"].tolist(), frame["text"].tolist(), hashes, passages.window, passages.edits if passages.free_end else 0):
                yield passages.verified(block)

    return spread(documents).mapInPandas(run, FOUND)


# an item side too large to broadcast


def _run_filter(items: DataFrame, length: int) -> np.ndarray:
    """Which of ``2**FILTER_BITS`` places the runs of the items fall on: at most ``2**(FILTER_BITS - 6)`` rows reach the driver."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            for block in blocks(frame["item_id"].tolist(), frame["text"].tolist(), hashes, length):
                yield pd.DataFrame({"place": np.unique(runs(block.flat, length) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)})

    set_bits = spread(items).mapInPandas(places, "place bigint").groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[set_bits["word"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little").astype(bool)


def _window_rows(df: DataFrame, key: str, window: int, edits: int, spare: int = 0, known=None) -> DataFrame:
    """``(owner, start, passage)`` of the windows that pass the filter ``known``, all without one; passages have ``spare`` words more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            for block in blocks(frame[key].tolist(), frame["text"].tolist(), hashes, window, spare):
                if known is None:
                    starts = block.starts()
                else:
                    starts = near_starts(block, known.value[runs(block.flat, run_length(window, edits)) >> np.uint64(64 - FILTER_BITS)], window, edits)
                doc = block.owner(starts)
                within = starts - block.first[doc]
                text = [" ".join(block.docs[d][s : s + window + spare]) for d, s in zip(doc.tolist(), within.tolist(), strict=True)]
                yield pd.DataFrame({"owner": block.ids[doc], "start": within, "passage": text})

    return spread(df).mapInPandas(run, "owner bigint, start int, passage string")


def _keyed(classes: DataFrame, window: int, tables: int, sample: int | None) -> DataFrame:
    """``(key, id)`` of each passage and table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            if len(frame):
                rows = np.array([[hashes[w] for w in text.split(" ")[:window]] for text in frame["passage"]], np.uint64)
                for table in range(tables):
                    yield pd.DataFrame({"key": window_keys(rows, table, sample).view(np.int64), "id": frame["id"]})

    return classes.mapInPandas(run, "key bigint, id binary")


def _joined_passages(documents: DataFrame, items: DataFrame, edits: int, window: int, tables: int, sample: int | None, free_end: bool = False) -> DataFrame:
    """The same meetings for an item side too large to broadcast. A passage that many share is joined once, as a class.

    The windows of both sides are written once; keys are joined with 16-byte digests of the passages, and only passages
    that meet are fetched as text.
    """
    known = documents.sparkSession.sparkContext.broadcast(_run_filter(items, run_length(window, edits)))
    digest = F.unhex(F.md5("passage"))
    left = cut_lineage(_window_rows(documents, "doc_id", window, edits, edits if free_end else 0, known).withColumn("id", digest))
    right = cut_lineage(_window_rows(items, "item_id", window, edits).withColumn("id", digest))
    a, b = (side.select("id", "passage").distinct() for side in (left, right))
    pairs = _keyed(a, window, tables, sample).withColumnRenamed("id", "a").join(_keyed(b, window, tables, sample).withColumnRenamed("id", "b"), "key").select("a", "b").distinct()
    texts = pairs.join(a.select(F.col("id").alias("a"), F.col("passage").alias("x")), "a").join(b.select(F.col("id").alias("b"), F.col("passage").alias("y")), "b")

    @F.pandas_udf("int")
    def far(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(q.split(" "), p.split(" "), edits, free_end) for p, q in zip(x, y, strict=True)], dtype="int32")

    close = texts.withColumn("edits", far("x", "y")).where(F.col("edits") <= edits).select("a", "b", "edits")
    in_docs = left.select(F.col("id").alias("a"), F.col("owner").alias("doc_id"), F.col("start").alias("doc_start")).distinct()
    in_items = right.select(F.col("id").alias("b"), F.col("owner").alias("item_id"), F.col("start").alias("item_start")).distinct()
    return close.join(in_docs, "a").join(in_items, "b").select("doc_id", "item_id", "doc_start", "item_start", "edits")
