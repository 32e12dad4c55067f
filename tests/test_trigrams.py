from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import table
from tillbook.functions.text import contains_pattern
from tillbook.operators import trigrams

SCHEMA = "key long, name string, code string"
TEXTS = ["name", "code"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcäÉo%_ ") for _ in range(rnd.randrange(12)))
    made = [(i, rnd.choice([None, word(), word()]), word()) for i in range(400)]
    return [*made, (400, "", None), (401, None, None), (402, "x" * 5_000 + "needle", "long"), (None, "needle", "needle")]


@pytest.fixture(scope="module")
def indexed(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, SCHEMA)
    trigrams.write_index(df, "key", TEXTS, path)
    return df, path


def scan(df, needle):
    return table(df.where(F.col("key").isNotNull() & contains_pattern(needle, *[F.col(c) for c in TEXTS])), "key")


def find(spark, path, needle):
    return table(trigrams.matching_ids(spark, path, needle))


@pytest.mark.parametrize("needle", ["abc", "ÁBC", "a%b", "bca_oa", "abco", "needle", "xxxxneedle", "no such text", "ae", "%", "oa%abc", "\\%ab"])
def test_same_rows_as_the_scan(spark, indexed, needle):
    df, path = indexed
    assert find(spark, path, needle) == scan(df, needle)


def test_grams_lie_between_wildcards(spark):
    assert trigrams.needle_grams(spark, "RïnG_ab%Cdef") == ["cde", "def", "ing", "rin"]
    assert trigrams.needle_grams(spark, "r_d%w") == trigrams.needle_grams(spark, "") == []


def test_only_the_needles_buckets_and_the_hits_parts_are_read(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    trigrams.write_index(df, "key", TEXTS, str(tmp_path))
    grams = trigrams.needle_grams(spark, "needle")
    own = {r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(trigrams._hashed(F.col("g"), trigrams.BUCKETS)).collect()}
    part = spark.sql("SELECT 402L AS key").select(trigrams._hashed(F.col("key"), trigrams.BUCKETS)).first()[0]
    keep = {f"bucket={b}" for b in own} | {f"part={part}"}
    broken = 0
    for file in Path(tmp_path).rglob("*.parquet"):
        if file.parent.name not in keep and "counts" not in str(file):
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            file.write_bytes(b"unreadable")
            broken += 1
    assert broken > 50
    assert find(spark, str(tmp_path), "needle") == [(402,)]


def test_versions_add_and_replace_rows(spark, tmp_path):
    path = str(tmp_path)
    first = spark.createDataFrame([(1, "red ring", "a"), (2, "blue wheel", "b"), (3, "ring", None)], SCHEMA)
    trigrams.write_index(first, "key", TEXTS, path)
    for _ in range(2):  # the same version twice counts once
        trigrams.write_index(spark.createDataFrame([(1, "red wheel", "a"), (4, "ringlet", "d")], SCHEMA), "key", TEXTS, path, version=1)
    assert find(spark, path, "ring") == [(3,), (4,)]
    assert find(spark, path, "WHEEL") == [(1,), (2,)]
    assert find(spark, path, "i") == [(3,), (4,)]


def test_an_empty_table_has_no_hits(spark, tmp_path):
    trigrams.write_index(spark.createDataFrame([], SCHEMA), "key", TEXTS, str(tmp_path))
    assert find(spark, str(tmp_path), "ring") == [] == find(spark, str(tmp_path), "r")


def test_one_file_is_folded_by_many_tasks(spark, tmp_path, monkeypatch):
    """A text is folded once, not for each of its grams, and a table in one piece is spread before its grams are made."""
    folded, made = [], []
    real, grams = trigrams.fold, trigrams._grams
    monkeypatch.setattr(trigrams, "fold", lambda x: folded.append(1) or real(x))
    monkeypatch.setattr(trigrams, "_grams", lambda x: made.append(len(folded)) or grams(x))
    df = spark.range(300).select("id", F.concat(F.lit("Ärm "), "id").alias("name")).coalesce(1)
    trigrams.write_index(df, "id", ["name"], str(tmp_path))
    # all folding is over when the first gram is made
    assert folded and set(made) == {len(folded)}
    assert trigrams.matching_ids(spark, str(tmp_path), "arm 29").count() == 11
