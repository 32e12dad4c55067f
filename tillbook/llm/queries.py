"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tillbook
from tillbook.llm import automaton, bond, bytebpe, decontaminate, hostpaths, neardup, pii, secrets, sharding, suffixdedup, topk, toxicity, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHARDS = 24
TOP = 20


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# Rows that Spark hands to Python at once; the usual 10,000 whole texts take too much of a worker's memory.
ROWS_AT_ONCE = "1000"


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, once, and keeps their batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(tillbook.__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tillbook-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/tillbook-code.zip", "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(archive.filename)
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_sharding(spark, sf_dir):
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op2_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda id: id % 20 == 0, TOP, every_row=True)


@query
def op3_minhash_neardup(spark, sf_dir):
    return neardup.class_of_each(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _removed(found, size):
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return ["doc_id", size, total.alias("n_removed")], F.sha2("kept", 256).alias("kept_sha256")


@query
def op5_substring_automaton(spark, sf_dir):
    found = automaton.remove_repeats(table(spark, sf_dir, "documents"))
    columns, kept = _removed(found, "n_words")
    return found.select(*columns, kept)


@query
def op6_suffix_dedup(spark, sf_dir):
    found = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    columns, kept = _removed(found, "n_bytes")
    return found.select(*columns, F.size("spans").cast("long").alias("n_spans"), kept)


@query
def op7_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind.name) for kind in secrets.KINDS],
        F.sha2(F.encode(secrets.written("base"), "UTF-8"), 256).alias("base_sha256"),
        secrets.written(secrets.with_live("base", "live")).alias("spans"),
    )


@query
def op8_pii(spark, sf_dir):
    found = pii.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in pii.KINDS],
        F.sha2(F.encode(secrets.written("base"), "UTF-8"), 256).alias("base_sha256"),
        secrets.written("spans").alias("spans"),
    )


@query
def op9_decontamination(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    found = found.withColumn("n_hit", decontaminate.covered("spans").cast("long"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_byte_bpe(spark, sf_dir):
    path, pattern = vocabulary()
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return bond.hard_negatives(rows, lambda id: id % 100 == 0)


@query
def op12_turn_repair(spark, sf_dir):
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


@query
def op13_host_paths(spark, sf_dir):
    return hostpaths.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


# --- SQL ---------------------------------------------------------------------

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE: dict[str, str] = {
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item, least(10, len(w)) AS k, unnest(list_transform(
                range(1, len(w) - least(10, len(w)) + 2),
                lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS gram
            FROM b WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (
            SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
        dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram FROM dw),
        h AS (SELECT dg.doc_id, dg.k, dg.i, bw.item FROM dg JOIN bw USING (gram, k)),
        p AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM h))
            GROUP BY doc_id),
        it AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, len(embedding) AS n,
                   list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS double)) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
                   cast(CASE WHEN a.n = 0 THEN 0 ELSE list_dot_product(a.vec, c.vec) END AS bigint) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND a.n = c.n WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS w
            FROM s WHERE same),
        r AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, w ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE w <= 5 AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, cast(rank AS int) AS rank, negative_id, positive_score, negative_score
        FROM r WHERE rank <= 5""",
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS double)) AS double)) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   cast(list_dot_product(q.vec, c.vec) AS bigint) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT query_id, vec_id, score,
                   cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
