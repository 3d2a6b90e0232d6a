"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import keys
from sonarmill.llm import splits
from sonarmill.plans import oracle_keys as sql
from sonarmill.session import cut_lineage, read_table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "combined_manifest").select("row_seq", keys.split_name("split").alias("split"), F.col("binary_label").alias("label"), keys.group_key("recording_group_id").alias("group"), F.col("recording_group_id").alias("spelling"), keys.sha_key("sha256").alias("sha"))


def _by_component(rows: DataFrame, *links: str) -> DataFrame:
    """Rows with the number of their component; one without links is alone under the number of its row, a text of its own kind."""
    found = splits.record_components(rows, F.col("row_seq"), {k: F.col(k) for k in links}).withColumnRenamed("key", "row_seq")
    alone = F.concat(F.lit("row="), F.col("row_seq").cast("string"))
    return rows.join(found, "row_seq").withColumn("component", F.coalesce(F.col("component").cast("string"), alone))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The groups that break the rule now: the components of spellings linked through the id as compared."""
    rows = _rows(spark, d).where("group IS NOT NULL").select("row_seq", "split", "label", "group", F.when(F.col("spelling") != F.col("group"), F.col("spelling")).alias("spelling"))
    states = splits.component_states(_by_component(rows, "group", "spelling"), F.min("group").alias("group"))
    return splits.violations(states).select("kind", F.col("group").alias("recording_group_id"))


def _name() -> Column:
    """A component is named by its first group, else its first content, else its row: the same on every run and in SQL."""
    return F.min(F.coalesce(F.concat(F.lit("group="), F.col("group")), F.concat(F.lit("sha="), F.col("sha")), F.concat(F.lit("row="), F.col("row_seq").cast("string"))))


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their component by group and content, and the name and new split of each component."""
    rows = cut_lineage(_by_component(_rows(spark, d).drop("spelling"), "group", "sha"))
    states = cut_lineage(splits.component_states(rows, _name().alias("name")))
    return rows, splits.assign(states, by="name").join(states.select("component", "name"), "component")


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows, new = _assigned(spark, d)
    return rows.join(new.select("component", "name", F.col("split").alias("new_split")), "component").select("row_seq", "group", F.col("name").alias("component"), "label", F.col("split").alias("old_split"), "new_split")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each new split per binary label."""
    rows, new = _assigned(spark, d)
    counts = rows.groupBy("component", "label").agg(F.count("*").alias("n")).join(new.select("component", "split"), "component").groupBy("label", "split").agg(F.sum("n").alias("n_rows"))
    whole = rows.groupBy("label").agg(F.count("*").alias("n_label"))
    return counts.join(whole, counts["label"].eqNullSafe(whole["label"])).select(counts["label"], "split", "n_rows", F.round(F.col("n_rows") / F.col("n_label"), 6).alias("share"))


_GROUP = sql.group_key("recording_group_id")
QUERIES = {"p6_found": p6_found, "p6_assignment": p6_assignment, "p6_shares": p6_shares}
_ASSIGNED_SQL = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT row_seq, {sql.split_name('split')} AS split, binary_label AS label, {_GROUP} AS g, {sql.sha_key('sha256')} AS sha FROM combined_manifest),
e AS MATERIALIZED (SELECT DISTINCT a.g, b.g AS h FROM (SELECT DISTINCT g, sha FROM r WHERE g IS NOT NULL) a JOIN (SELECT DISTINCT g, sha FROM r WHERE g IS NOT NULL) b ON a.sha = b.sha),
t AS (SELECT DISTINCT g, g AS h FROM r WHERE g IS NOT NULL UNION SELECT t.g, e.h FROM t JOIN e ON e.g = t.h),
gn AS MATERIALIZED (SELECT g, 'group=' || min(h) AS name FROM t GROUP BY 1),
sn AS MATERIALIZED (SELECT sha, coalesce(min(name), 'sha=' || sha) AS name FROM r LEFT JOIN gn ON gn.g = r.g WHERE sha IS NOT NULL GROUP BY 1),
c AS MATERIALIZED (SELECT r.*, coalesce(gn.name, sn.name, 'row=' || row_seq) AS name FROM r LEFT JOIN gn ON gn.g = r.g LEFT JOIN sn ON sn.sha = r.sha),
states AS (SELECT name, count(*) AS n, coalesce(bool_or(label = 0), false) AS h0, coalesce(bool_or(label = 1), false) AS h1 FROM c GROUP BY 1),
s AS MATERIALIZED (SELECT name, n, CASE WHEN h0 AND h1 THEN 'mixed' WHEN h1 THEN '1' WHEN h0 THEN '0' ELSE 'none' END AS stratum, ('0x' || left(md5('42|' || name), 15))::BIGINT AS o FROM states),
w AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY stratum) AS total, n >= 0.01::DOUBLE * sum(n) OVER (PARTITION BY stratum) AS heavy FROM s),
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, o) AS i FROM w WHERE heavy),
p AS (SELECT DISTINCT stratum, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS name, 0.7::DOUBLE * total AS a, 0.15::DOUBLE * total AS b, 0.15::DOUBLE * total AS d, CAST(NULL AS VARCHAR) AS split FROM w
UNION ALL SELECT q.stratum, q.i, q.name, CASE WHEN p.a >= p.b AND p.a >= p.d THEN p.a - q.n ELSE p.a END, CASE WHEN p.b > p.a AND p.b >= p.d THEN p.b - q.n ELSE p.b END, CASE WHEN p.d > p.a AND p.d > p.b THEN p.d - q.n ELSE p.d END,
CASE WHEN p.a >= p.b AND p.a >= p.d THEN 'train' WHEN p.b >= p.d THEN 'validation' ELSE 'test' END FROM p JOIN q ON q.stratum = p.stratum AND q.i = p.i + 1),
room AS (SELECT stratum, greatest(0, arg_max(a, i)) AS a, greatest(0, arg_max(b, i)) AS b, greatest(0, arg_max(d, i)) AS d FROM p GROUP BY 1),
edge AS (SELECT room.stratum, a * k AS e1, (a + b) * k AS e2 FROM room JOIN (SELECT stratum, sum(CASE WHEN heavy THEN 0 ELSE n END) AS lights FROM w GROUP BY 1) l ON l.stratum = room.stratum, LATERAL (SELECT greatest(1e-9, lights) / (CASE WHEN a + b + d = 0 THEN 1 ELSE a + b + d END) AS k)),
light AS (SELECT name, stratum, sum(n) OVER (PARTITION BY stratum ORDER BY o, name) - n / 2 AS middle FROM w WHERE NOT heavy),
new AS MATERIALIZED (SELECT name, split FROM p WHERE i > 0 UNION ALL SELECT name, CASE WHEN middle <= e1 THEN 'train' WHEN middle <= e2 THEN 'validation' ELSE 'test' END FROM light JOIN edge ON edge.stratum = light.stratum)"""
ORACLE = {
    "p6_assignment": _ASSIGNED_SQL + ' SELECT row_seq, g AS "group", c.name AS component, label, c.split AS old_split, new.split AS new_split FROM c JOIN new ON new.name = c.name',
    "p6_shares": _ASSIGNED_SQL + " SELECT label, new.split, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM c x WHERE x.label IS NOT DISTINCT FROM c.label), 6) AS share FROM c JOIN new ON new.name = c.name GROUP BY 1, 2",
    "p6_found": f"""SELECT 'split' AS kind, {_GROUP} AS recording_group_id FROM combined_manifest WHERE {_GROUP} IS NOT NULL GROUP BY 2 HAVING count(DISTINCT {sql.split_name('split')}) >= 2
UNION ALL SELECT 'label', {_GROUP} FROM combined_manifest WHERE {_GROUP} IS NOT NULL AND binary_label IN (0, 1) GROUP BY 2 HAVING count(DISTINCT binary_label) = 2""",
}
