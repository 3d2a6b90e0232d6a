"""Mixing sources to target shares along a curriculum (problem 8).

Each source has a weight schedule over the training run, integrated to its cumulative demand. Sizes are counted in
tokens of a public tokenizer. A source gives ``share * budget`` tokens, or what its documents come to when each is used
``max_repeats`` times, if that is less; documents are taken in an order drawn by hash, pass after pass. The position of
a use is where the source's cumulative demand, scaled to what it gives, reaches the tokens used so far; the mix is then
range-sorted by position. What a small source can't give isn't made up by others: that would move the shares further
from their targets.

Schedules are linear: source s has weight ``g * (1 + tilt * (2 t - 1))`` at time t of 0 to 1, g being the tokens it gives,
so its integral is g whatever its tilt. Its demand until t is ``g * (t + tilt * (t*t - t))`` and is inverted in closed
form. At time t the mix takes tokens at the summed weights of all sources, and a use's position is their integral: how
many tokens of the mix come before it. At every position each source then has its weight's share of the summed weights.

Defined results: documents without a source or of a source without target are left out; null and empty texts have no
tokens and are left out; a source without documents is reported with 0. Target rows that repeat a source are one target
with their shares summed and their largest cap. Repeated documents are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.functions.keys import source_key
from sonarmill.operators.prefix import running_total
from sonarmill.session import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER, alias: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text; the tokenizer file must be readable by all workers."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for batch in texts:
            sizes = []
            whole = batch.fillna("").tolist()
            for start in range(0, len(whole), 256):
                sizes += [len(x) for x in model.encode_batch_fast(whole[start : start + 256], add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return df.withColumn(alias, count(F.col(text)))


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents that have both; written once, as counting is the dear part."""
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return cut_lineage(token_counts(spread(rows), "text", tokenizer).select("doc_id", "source", "n_tokens").where("n_tokens > 0"))


def supply(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """One row per target source: ``source, target_share, max_repeats, n_docs, n_tokens, demand``.

    ``budget`` is the mix's intended size in tokens; by default the tokens that the target sources hold.
    """
    wanted = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = cut_lineage(wanted.join(held, "source", "left").fillna(0, ["n_docs", "n_tokens"]))
    whole = rows.agg(F.sum("n_tokens").alias("n")).scalar() if budget is None else F.lit(budget)
    share = F.col("target_share") / rows.agg(F.sum("target_share").alias("s")).scalar()
    return rows.withColumn("target_share", share).withColumn("demand", F.least(F.col("n_tokens") * F.col("max_repeats"), F.floor(F.col("target_share") * whole)))


def time_of(used: Column, tilt: Column) -> Column:
    """The time at which a schedule's demand reaches the part ``used`` of its whole: the inverse of t + tilt (t^2 - t)."""
    root = (-(1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * used)) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, used).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def tilts(max_repeats: Column, strength: float = 0.5) -> Column:
    """Default schedule: sources that may be repeated, the curated ones, gain weight towards the end; others lose some."""
    return F.when(max_repeats > 1, F.lit(strength)).otherwise(F.lit(-strength / 2))


def mix(sized: DataFrame, supplied: DataFrame, tilt: Column | None = None, seed: int = 42) -> DataFrame:
    """Every use of a document: ``position, source, doc_id, pass, n_tokens``, range-sorted by position, in tokens of the mix.

    Documents of passes that are wholly used need no order among passes; a running total over hash ranges places the
    uses of a source, so a source of a third of all documents is spread over many tasks.
    """
    wanted = supplied.where("demand > 0").withColumn("tilt", tilts(F.col("max_repeats")) if tilt is None else tilt)
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("demand") / F.col("n_tokens")).cast("int"))
    shape = wanted.select("source", "demand", "tilt", F.col("n_tokens").alias("held"), passes.alias("passes"))
    docs = sized.join(F.broadcast(shape), "source")  # one row for each target source
    order = F.xxhash64(F.lit(seed), "pass", "doc_id")
    uses = docs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("order", order)
    placed = running_total(uses, ["source", "pass"], "order", "n_tokens", "doc_id")
    before = F.col("before") + F.col("pass") * F.col("held")
    kept = placed.withColumn("so_far", before).where("so_far < demand")
    used = (F.col("so_far") + F.col("n_tokens") / 2) / F.greatest(F.col("demand"), F.col("so_far") + F.col("n_tokens"))
    whole = wanted.agg(F.sum("demand").cast("double").alias("whole"), F.sum(F.col("demand") * F.col("tilt")).alias("lean"))
    timed = kept.withColumn("time", time_of(used, F.col("tilt"))).crossJoin(F.broadcast(whole))  # one row
    passed = F.col("whole") * F.col("time") + F.col("lean") * (F.col("time") * F.col("time") - F.col("time"))
    return timed.select(passed.alias("position"), "source", "doc_id", "pass", "n_tokens").orderBy("position", "source", "doc_id", "pass")


def shares(mixed: DataFrame, supplied: DataFrame) -> DataFrame:
    """Target and actual share of every target source."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("tokens_used"), (F.max("pass") + 1).alias("most_uses"))
    rows = cut_lineage(supplied.join(got, "source", "left").fillna(0, ["n_uses", "tokens_used", "most_uses"]))
    total = rows.agg(F.sum("tokens_used").alias("n")).scalar()
    return rows.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "n_uses", "most_uses", "tokens_used", F.round(F.col("tokens_used") / total, 6).alias("actual_share"), (F.col("tokens_used") >= F.col("n_tokens") * F.col("max_repeats")).alias("exhausted"))
