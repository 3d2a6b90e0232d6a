"""Key rules on random texts: the Column expressions, their SQL twins and a plain Python form must agree."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sonarmill.functions import keys
from sonarmill.plans import oracle_keys

BLANK = keys.BLANKS


def path(text):
    steps = [s for s in text.strip(BLANK).replace("\\", "/").split("/") if s not in ("", ".")]
    first = min((steps.index(r) for r in keys.PATH_ROOTS if r in steps), default=0)
    return "/".join(steps[first:]) or None


def segment(text):
    text = text.strip(BLANK).lower().replace("_", ":")
    found = re.search(r":0+([0-9]+)$", text)
    return (text[: found.start()] + ":" + found[1] if found else text) or None


def split(text):
    return {"tra": "train", "val": "validation", "tes": "test"}.get(text.strip(BLANK).lower()[:3])


def sha(text):
    text = text.strip(BLANK).lower()
    return (text[7:] if text.startswith("sha256:") else text).strip(BLANK) or None


def plain(text):
    return text.strip(BLANK).lower() or None


def source(text):
    return text.strip(BLANK).lower().replace("-", "_") or None


RULES = {
    "path_key": (path, ["segments", "features", "raw", "/", "\\", "//", "/./", ".", "..", "a", "Raw", "rawx", "x.wav", " ", "\t", "D:", "\n"]),
    "segment_key": (segment, ["ab", "AB", ":", "_", "0", "00", "7", "10", " ", "x", "\t"]),
    "split_name": (split, ["train", "TRA", "val", "Test", "ing", " ", "te", "s", "\t", "x"]),
    "sha_key": (sha, ["sha256:", "SHA256:", "ab", "F0", " ", "\t", ":", "sha"]),
    "group_key": (plain, ["ddl:", "Session", " ", "T0", "\t", "/"]),
    "source_key": (source, ["field", "-", "_", " ", "Log", "\t"]),
}


@pytest.mark.parametrize("name", RULES)
def test_three_forms_agree(spark, name):
    rule, pieces = RULES[name]
    draw = random.Random(name)
    texts = sorted({"".join(draw.choice(pieces) for _ in range(draw.randrange(0, 8))) for _ in range(1500)})
    expected = {t: rule(t) for t in texts}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", getattr(keys, name)(F.col("t")).alias("k")).collect()}
    assert got.pop(None) is None and got == expected
    db = duckdb.connect()
    db.execute("CREATE TABLE x (t VARCHAR)")
    db.executemany("INSERT INTO x VALUES (?)", [(t,) for t in texts])
    found = dict(db.execute(f"SELECT t, {getattr(oracle_keys, name)('t')} FROM x").fetchall())
    assert found == expected
