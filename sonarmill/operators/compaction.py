"""Size-tiered incremental compaction of many small files, with an idempotent transaction journal (problem 4).

The operator works on an inventory, one row per file, that is hundreds of times smaller than the records:

1. ``slots``, ``inventory`` and ``audit``: what each file holds, with what is too small, lost or taken twice;
2. ``plan``: files below half of ``target`` are merged with files of their own size tier, a power of two. So many files
   make a transaction that its output is at least half full and never over the target; a file that is half full stays
   as it is. What the tiers leave over, less than ``target`` files of a part, is packed at the last level;
3. ``journal``: one row per transaction, its id a digest of level and inputs, so that the same plan gives the same ids;
4. ``relocate``: every record's new file and slot. Data move once;
5. ``compact_directory``: the same for a folder of Parquet files that keeps growing. There ``fan`` files of one tier are
   enough for a transaction, its output enters the tier of its size and is merged again with others of that tier, and
   files that find no partners wait for later runs.

Defined results: a record is a distinct (file, slot, record id); rows delivered again are the same record; two records
that claim one slot are both kept and get slots of their own. Rows without a file or slot can't be located: they have no
place in the plan and are counted by ``unplaced``. Negative slots count as held but aren't searched for gaps. Empty
tables give empty results; extra columns are left out, whatever their name.
"""

from __future__ import annotations

import math
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarmill.operators.prefix import ordered_totals
from sonarmill.session import cut_lineage

TARGET = 256
SMALL = 64
#: Slots are counted, searched and numbered in stretches of ``2**STRETCH_BITS``, so that no task takes a whole file.
STRETCH_BITS = 16
#: Lost slots are listed in blocks of so many.
BLOCK = 4096


def records(df: DataFrame, file: Column, slot: Column, record: Column) -> DataFrame:
    return df.select(file.alias("file"), slot.alias("slot"), record.alias("record"))


def placed_records(rows: DataFrame) -> DataFrame:
    """Each record once."""
    return rows.where("file IS NOT NULL AND slot IS NOT NULL").distinct()


def slots(rows: DataFrame) -> DataFrame:
    """One row per held slot: its records and whether different ones claim it. A null record is no record of its own."""
    held = placed_records(rows).groupBy("file", "slot").agg(F.count("*").alias("n_records"), (F.count("record") > 1).alias("twice"))
    return held.withColumn("stretch", F.shiftright("slot", STRETCH_BITS))


def inventory(held: DataFrame) -> DataFrame:
    """``(file, stretch, n_slots, n_records, place, before)``: what each stretch of a file holds.

    n_slots and n_records are those of the whole file, place counts the records of its earlier stretches and before is
    the last slot held there. A file has at most ``2**(32 - STRETCH_BITS)`` stretches, nearly always one.
    """
    parts = held.groupBy("file", "stretch").agg(F.count("*").alias("s"), F.sum("n_records").alias("r"), F.max("slot").alias("top"))
    whole, upto = Window.partitionBy("file"), Window.partitionBy("file").orderBy("stretch")
    return parts.select("file", "stretch", F.sum("s").over(whole).alias("n_slots"), F.sum("r").over(whole).alias("n_records"), (F.sum("r").over(upto) - F.col("r")).alias("place"), F.lag("top").over(upto).alias("before"))


def file_sizes(stretches: DataFrame) -> DataFrame:
    """``(file, n_slots, n_records)``: one row per file of an inventory."""
    return stretches.where("before IS NULL").select("file", "n_slots", "n_records")


def tier(size: Column) -> Column:
    """Size tier: the power of two at or below the size."""
    return F.floor(F.log2(size.cast("double"))).cast("int")


def audit(held: DataFrame, least: int = SMALL) -> DataFrame:
    """``(kind, file, slot)`` of everything wrong with the files, from the held slots and their inventory.

    ``small_shard`` (slot null) for files below the tier of ``least`` records, ``lost_index`` for every slot below a
    file's largest that no row has, ``taken_twice`` for slots that different records claim. Slots are sorted within a
    stretch; a gap is spread in blocks, so that one wild slot number makes many small lists and not one of billions.
    """
    if least & (least - 1):
        raise ValueError("the least size must be a power of two, where a tier begins")
    stretches = inventory(held)
    small = file_sizes(stretches).where(tier(F.col("n_slots")) < int(math.log2(least))).select(F.lit("small_shard").alias("kind"), "file", F.lit(None).cast("int").alias("slot"))
    twice = held.where("twice").select(F.lit("taken_twice").alias("kind"), "file", F.col("slot").cast("int").alias("slot"))
    w = Window.partitionBy("file", "stretch").orderBy("slot")
    seen = held.select("file", "stretch", "slot").withColumn("last", F.lag("slot").over(w)).join(stretches.select("file", "stretch", "before"), ["file", "stretch"])
    start = F.greatest(F.coalesce("last", "before", F.lit(-1)), F.lit(-1)).cast("bigint") + 1
    gaps = seen.select("file", start.alias("a"), (F.col("slot").cast("bigint") - 1).alias("b")).where("a <= b")
    blocks = gaps.select("file", "b", F.explode(F.sequence("a", "b", F.lit(BLOCK).cast("bigint"))).alias("a")).repartition("file", "a")
    lost = blocks.select(F.lit("lost_index").alias("kind"), "file", F.explode(F.sequence(F.col("a").cast("int"), F.least("b", F.col("a") + (BLOCK - 1)).cast("int"))).alias("slot"))
    return small.unionByName(twice).unionByName(lost)


def repeated_files(df: DataFrame, file: Column) -> DataFrame:
    """Files that more than one row names."""
    return df.select(file.alias("file")).where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def unplaced(rows: DataFrame) -> DataFrame:
    return rows.where("file IS NULL OR slot IS NULL").select(F.count("*").alias("n_rows"))


def _next_fit(files: Column, target: int) -> Column:
    """``(pack, n, file)`` of an array of ``(n, file)``: a file that the open pack can't take closes it and opens another."""
    start = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("bigint").alias("fill"), F.array().cast("array<struct<pack:int,n:bigint,file:string>>").alias("done"))

    def put(a: Column, x: Column) -> Column:
        full = a["fill"] + x["n"] > target
        pack = a["pack"] + F.when(full, 1).otherwise(0)
        fill = F.when(full, F.lit(0).cast("bigint")).otherwise(a["fill"]) + x["n"]
        return F.struct(pack.alias("pack"), fill.alias("fill"), F.concat(a["done"], F.array(F.struct(pack.alias("pack"), x["n"].alias("n"), x["file"].alias("file")))).alias("done"))

    return F.aggregate(files, start, put)["done"]


_PLANNED = ("file", "n", "part", "output", "level", "start")


def _as_transactions(df: DataFrame, by: list[str], level: Column, fits: Column) -> DataFrame:
    """Planned rows of packed files; ``by`` names a pack, which holds at most ``target`` files."""
    pack = Window.partitionBy(*by)
    before = Window.partitionBy(*by).orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({"total": F.sum("n").over(pack), "inputs": F.count("*").over(pack), "first": F.min("file").over(pack), "start": F.sum("n").over(before) - F.col("n")})
    name = F.sha2(F.concat_ws("|", level.cast("string"), "part", "first", F.col("total").cast("string"), F.col("inputs").cast("string")), 256)
    return rows.withColumns({"output": F.when(fits, name), "level": F.when(fits, level), "start": F.when(fits, F.col("start")).otherwise(0)})


def plan(files: DataFrame, size: str = "n_records", target: int = TARGET, part: str | None = None, fan: int | None = None, rest: bool = True) -> DataFrame:
    """``(file, n, part, output, level, start)``: the transaction that takes each file and the place of its first record.

    output is null for files left as they are. ``part`` names a column that transactions must not mix, such as a split.
    In tier t so many files make a transaction as fit if all are as large as the largest, which is below ``2**(t+1)``, so
    they come to half of the target at least and never exceed it. With ``fan`` so many of those left are merged too, into outputs that will be merged again. Files of a tier are
    numbered in the order of a digest of their names, stretch by stretch of it, so no task sees a whole tier. With ``rest`` the files that are left,
    less than twice ``target`` of a part, are packed by next fit from the smallest on; at most one pack of a part is then below
    half. Without it they wait.
    """
    if target < 2 or target & (target - 1):
        raise ValueError("the target must be a power of two")
    top = int(math.log2(target))
    # written once, as settled, packed and lone files are picked from it in turn
    each = cut_lineage(files.select("file", F.col(size).cast("bigint").alias("n"), (F.lit("") if part is None else F.col(part)).alias("part")))
    small = (F.col("n") > 0) & (F.col("n") * 2 < target)
    # null sizes are settled as well
    settled = each.where(~F.coalesce(small, F.lit(False))).select("file", "n", "part", F.lit(None).cast("string").alias("output"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("bigint").alias("start"))
    tiers = each.where(small).withColumn("tier", tier(F.col("n")))
    digest = F.md5("file")
    ranked = ordered_totals(tiers, ["part", "tier"], F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"), [digest, F.col("file")], {"place": F.lit(1).cast("bigint")})
    due = tiers.groupBy("tier").agg(F.floor(F.lit(target) / F.max("n")).alias("due"))
    packs = ranked.join(F.broadcast(due), "tier").withColumn("pack", F.floor((F.col("place") - 1) / F.col("due")))  # one row for each tier
    merged = _as_transactions(packs, ["part", "tier", "pack"], F.col("tier"), F.col("inputs") == F.col("due"))
    done, left = [settled, merged.where("output IS NOT NULL").select(*_PLANNED)], merged.where("output IS NULL")
    if fan is not None:
        few = left.withColumn("pack", F.floor((F.col("place") - 1) % F.col("due") / fan))
        merged = _as_transactions(few, ["part", "tier", "pack"], F.col("tier"), F.col("inputs") == fan)
        done, left = [*done, merged.where("output IS NOT NULL").select(*_PLANNED)], merged.where("output IS NULL")
    if rest:
        bundle = left.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("n", "file"))).alias("files"))  # less than twice `target` files
        put = bundle.select("part", F.inline(_next_fit(F.col("files"), target)))
        left = _as_transactions(put, ["part", "pack"], F.lit(top), F.col("inputs") > 1)
    out = left.select(*_PLANNED)
    for more in done:
        out = out.unionByName(more)
    return out


def journal(planned: DataFrame) -> DataFrame:
    """One row per transaction: id, level, inputs, records. The digest of the inputs makes a second run recognisable."""
    return planned.where("output IS NOT NULL").groupBy(F.col("output").alias("txn_id")).agg(
        F.first("level").alias("level"), F.first("part").alias("part"), F.count("*").alias("n_inputs"), F.sum("n").alias("n_records"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("file")), "|"), 256).alias("inputs_digest"),
    )


def relocate(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Every record once, with its new file and slot: ``(record, file, slot, new_file, new_slot)``.

    A record's slot is its file's place in the output, plus that of its stretch, plus its rank in the stretch, so the
    records are shuffled by stretch of their file only and neither a file nor an output is gathered.
    """
    moves = inventory(slots(rows)).select("file", "stretch", "place").join(planned.select("file", F.coalesce("output", "file").alias("new_file"), "start"), "file")
    each = placed_records(rows).withColumn("stretch", F.shiftright("slot", STRETCH_BITS))
    w = Window.partitionBy("file", "stretch").orderBy("slot", "record")
    return each.withColumn("rank", F.row_number().over(w)).join(moves, ["file", "stretch"]).select("record", "file", "slot", "new_file", (F.col("start") + F.col("place") + F.col("rank") - 1).alias("new_slot"))


# folders of Parquet files

JOURNAL = "txn_id string, state string, level int, inputs array<string>, at timestamp"
TXN = "__txn_id"
#: So many files of one tier are merged as soon as they are there.
FAN = 4
#: Input files of the transactions that one job carries out; the driver holds their names.
BATCH_FILES = 10_000
#: The journal is folded into one file when it has more than so many.
JOURNAL_FILES = 24


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _entries(spark: SparkSession, journal_dir: str) -> tuple[list[str], list[str]]:
    """Folders of the journal that count, the newest snapshot and what was written after it, and those that don't any more.

    Entries are numbered; a folder without ``_SUCCESS`` is one whose writer broke off.
    """
    fs, _ = _fs(spark, journal_dir)
    whole = [f for f in _folders(spark, journal_dir) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{journal_dir}/{f}/_SUCCESS"))]
    last = max((f[:12] for f in whole if f.endswith("-snapshot")), default="")
    return [f for f in whole if f[:12] >= last], [f for f in whole if f[:12] < last]


def _note(spark: SparkSession, journal_dir: str, rows: DataFrame, kind: str = "log") -> None:
    number = max((int(f[:12]) for f in _folders(spark, journal_dir) if f[:12].isdigit()), default=0) + 1
    rows.coalesce(1).write.parquet(f"{journal_dir}/{number:012d}-{uuid.uuid4().hex[:8]}-{kind}")


def read_journal(spark: SparkSession, journal_dir: str) -> DataFrame:
    live, _ = _entries(spark, journal_dir)
    return spark.read.schema(JOURNAL).parquet(*[f"{journal_dir}/{f}" for f in live]) if live else spark.createDataFrame([], JOURNAL)


def _fold(spark: SparkSession, journal_dir: str) -> None:
    """One snapshot instead of many entries. It holds what is committed, and what began since, and replaces the rest only when it is whole."""
    live, old = _entries(spark, journal_dir)
    if len(live) > JOURNAL_FILES:
        known = read_journal(spark, journal_dir)
        done = known.where("state = 'commit'")
        begun = known.where("state = 'begin'").join(done.select("txn_id"), "txn_id", "left_anti").select(*known.columns)
        _note(spark, journal_dir, done.unionByName(begun).dropDuplicates(["txn_id", "state"]), "snapshot")
        _, old = _entries(spark, journal_dir)
    for folder in old:
        _remove(spark, f"{journal_dir}/{folder}")


def _parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, n bigint")
    return listed.select(F.col("_metadata.file_path").alias("file"), F.greatest("length", F.lit(1)).cast("bigint").alias("n"))


def _live_files(spark: SparkSession, source: str, output: str, known: DataFrame) -> DataFrame:
    """``(file, n)``: the files of ``source`` and of committed transactions that no committed transaction has taken."""
    done = known.where("state = 'commit'")
    made = _parquet_files(spark, output).withColumn("txn_id", F.regexp_extract("file", f"/{TXN}=([0-9a-f]+)/", 1))
    made = made.join(done.select("txn_id").distinct(), "txn_id", "left_semi").select("file", "n")
    taken = done.select(F.explode("inputs").alias("file")).distinct()
    return _parquet_files(spark, source).unionByName(made).join(taken, "file", "left_anti")


def _readable(file: str) -> str:
    """A listed file's address as a path: without percent signs, and with what would be a pattern escaped."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in unquote(file))


def _carry_out(spark: SparkSession, txns: list, output: str, journal_dir: str) -> None:
    """Writes the transactions' records, each into its own folder, replacing what is there, and commits them. Only their inputs are read."""
    moves = spark.createDataFrame([(f, r["txn_id"]) for r in txns for f in r["inputs"]], f"__file string, {TXN} string")
    data = spark.read.option("mergeSchema", "true").parquet(*[_readable(f) for r in txns for f in r["inputs"]])
    moved = data.withColumn("__file", F.col("_metadata.file_path")).join(F.broadcast(moves), "__file").drop("__file")  # at most BATCH_FILES rows and a transaction more
    moved.repartition(F.col(TXN)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(TXN).parquet(output)
    done = spark.createDataFrame([(r["txn_id"], "commit", r["level"], r["inputs"]) for r in txns], "txn_id string, state string, level int, inputs array<string>")
    _note(spark, journal_dir, done.withColumn("at", F.current_timestamp()))


def _in_batches(spark: SparkSession, txns: DataFrame, output: str, journal_dir: str) -> int:
    count, held, files = 0, [], 0
    for row in txns.select("txn_id", "level", "inputs").toLocalIterator():
        held.append(row)
        count, files = count + 1, files + len(row["inputs"])
        if files >= BATCH_FILES:
            _carry_out(spark, held, output, journal_dir)
            held, files = [], 0
    if held:
        _carry_out(spark, held, output, journal_dir)
    return count


def compact_directory(spark: SparkSession, source: str, output: str, journal_dir: str, target_bytes: int = 128 << 20, fan: int = FAN, finish: bool = False) -> int:
    """Consolidate the Parquet files of ``source`` into ``output``, a run at a time; returns how many transactions were carried out.

    A transaction is named by the digest of its inputs and journalled before it begins and after it is done. What an
    earlier run began and didn't commit is carried out first, with the inputs that it named. Then ``fan`` files of one
    tier are merged, be they new or outputs of earlier transactions, level by level until no tier has so many; fewer wait
    for later runs, so each byte is written about once a level. ``finish`` merges what waits as well. Outputs that were
    merged again are removed, files of ``source`` never. Running again without new files does nothing.
    ``consolidated`` reads the records of all committed transactions, ``waiting_files`` lists what they haven't taken.
    One run at a time may work on a journal.
    """
    known = read_journal(spark, journal_dir)
    begun = known.where("state = 'begin'").join(known.where("state = 'commit'").select("txn_id"), "txn_id", "left_anti").dropDuplicates(["txn_id"])
    count = _in_batches(spark, begun, output, journal_dir)
    more = True
    while more:  # every transaction makes one file of several, so this ends
        txns = _transactions(spark, source, output, journal_dir, target_bytes, fan, False)
        if not txns.head(1) and finish:
            txns, more = _transactions(spark, source, output, journal_dir, target_bytes, fan, True), False
        if not txns.head(1):
            break
        _note(spark, journal_dir, txns.select("txn_id", F.lit("begin").alias("state"), "level", "inputs", F.current_timestamp().alias("at")))
        count += _in_batches(spark, txns, output, journal_dir)
    if count:
        _sweep(spark, output, journal_dir)
        _fold(spark, journal_dir)
    return count


def _transactions(spark: SparkSession, source: str, output: str, journal_dir: str, target_bytes: int, fan: int, rest: bool) -> DataFrame:
    """``(txn_id, level, inputs)`` for the files that are there now."""
    files = _live_files(spark, source, output, read_journal(spark, journal_dir))
    planned = plan(files, "n", 1 << int(math.log2(target_bytes)), fan=fan, rest=rest).where("output IS NOT NULL")
    # an output takes at most its target's bytes of files
    txns = planned.groupBy("output").agg(F.sort_array(F.collect_list("file")).alias("inputs"), F.max("level").alias("level"))
    return cut_lineage(txns.select(F.sha2(F.array_join("inputs", "|"), 256).alias("txn_id"), "level", "inputs"))


def _sweep(spark: SparkSession, output: str, journal_dir: str) -> None:
    """Removes the folders of outputs that a committed transaction has merged again."""
    done = read_journal(spark, journal_dir).where("state = 'commit'")
    merged = done.select(F.explode("inputs").alias("file")).select(F.regexp_extract("file", f"/{TXN}=([0-9a-f]+)/", 1).alias("txn_id")).where("txn_id <> ''").distinct()
    there = {f.split("=", 1)[1] for f in _folders(spark, output) if f.startswith(f"{TXN}=")}
    for row in merged.toLocalIterator():
        if row["txn_id"] in there:
            _remove(spark, f"{output}/{TXN}={row['txn_id']}")


def consolidated(spark: SparkSession, output: str, journal_dir: str) -> DataFrame:
    """The records of all committed transactions, without those of outputs that were merged again."""
    done = read_journal(spark, journal_dir).where("state = 'commit'")
    merged = done.select(F.explode("inputs").alias("file")).select(F.regexp_extract("file", f"/{TXN}=([0-9a-f]+)/", 1).alias(TXN)).distinct()
    live = done.select(F.col("txn_id").alias(TXN)).distinct().join(merged, TXN, "left_anti")
    return spark.read.option("mergeSchema", "true").parquet(output).join(live, TXN, "left_semi").drop(TXN)


def waiting_files(spark: SparkSession, source: str, journal_dir: str) -> DataFrame:
    """``(file, n)``: the files of ``source`` that no committed transaction has taken yet."""
    taken = read_journal(spark, journal_dir).where("state = 'commit'").select(F.explode("inputs").alias("file")).distinct()
    return _parquet_files(spark, source).join(taken, "file", "left_anti")
