"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidates. Their hashes are counted over distinct repositories
and owners of the whole corpus: what many owners have is a copied example, what
few have and looks random is a live credential of its owner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import cut_lineage


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value: int  # group that holds the secret
    least: int  # characters it must have


# The patterns looked for, in the order in which kinds are listed.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]+", 0, 16),
)
LIVE = "live"

# A value that more distinct repositories or owners have is a copied example.
MOST_REPOSITORIES = 2
MOST_OWNERS = 2
# A live-looking value has letters and digits and so many different characters.
LEAST_VARIETY = 6

_SPAN = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def _searched(kind: Kind) -> str:
    """The pattern to run; where a run of one class decides, short runs are skipped at once."""
    if kind.pattern.endswith("]+") and kind.value == 0:
        fixed = len(kind.pattern.split("[")[0])
        return kind.pattern[:-1] + f"{{{kind.least - fixed},}}"
    return kind.pattern


def _spans_of(order: int, kind: Kind, matches, gaps):
    """Spans of a kind from its matches and the pieces of text around them, in code points."""
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.cast(_SPAN).alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        value = F.regexp_extract(x["match"], kind.pattern, kind.value)
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind.name).alias("kind"), value.alias("value"))
        return state(end, F.when(F.length(value) >= kind.least, F.concat(a["out"], F.array(span))).otherwise(a["out"]))

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.aggregate(pairs, state(F.lit(0), F.array()), step, lambda a: a["out"])


def candidates(docs: DataFrame, *, keep: list, text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``base``: spans of all kinds by start, then kind, with their values."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = rows.columns[:-1]
    found = [F.regexp_extract_all("_text", F.lit(_searched(k)), F.lit(0)).alias(f"_m{i}") for i, k in enumerate(KINDS)]
    rows = rows.select(*names, "_text", *found)
    spans = [
        F.when(F.size(f"_m{i}") > 0, _spans_of(i, k, F.col(f"_m{i}"), F.split("_text", _searched(k), -1)))
        .otherwise(F.array().cast(_SPAN))
        for i, k in enumerate(KINDS)
    ]
    return rows.select(*names, F.array_sort(F.concat(*spans)).alias("base"))


def _live_looking(value):
    variety = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (variety >= LEAST_VARIETY)


def scan(docs: DataFrame, *, keep: list, repository: str = "source", owner: str = "source", text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, with base (all spans found) and live (those judged live).

    Offsets are code points, ends exclusive; spans of one kind never overlap. A
    value counts once per repository and owner however often it is repeated; a
    null repository or owner is one of its own. Null and empty texts have no
    spans. Columns not kept play no part; ``keep`` may hold expressions.
    """
    rows = candidates(docs, keep=[*keep, F.col(repository).alias("_repo"), F.col(owner).alias("_owner")], text=text)
    names = rows.columns[:-3]
    # without the texts; and row numbers hold from here on
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    spans = rows.select("_row", "_repo", "_owner", F.explode("base").alias("s")).withColumn("_hash", F.md5(F.encode("s.value", "UTF-8")))
    has = spans.select("_hash", F.struct("_repo").alias("_repo"), F.struct("_owner").alias("_owner")).distinct()
    spread = has.groupBy("_hash").agg(F.count_distinct("_repo").alias("repos"), F.count_distinct("_owner").alias("owners"))
    own = spread.where((F.col("repos") <= MOST_REPOSITORIES) & (F.col("owners") <= MOST_OWNERS)).select("_hash")
    live = (
        spans.where(_live_looking(F.col("s.value"))).join(own, "_hash", "left_semi")
        .groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("live"))
    )
    return rows.drop("_repo", "_owner").join(live, "_row", "left").select(
        *names, "base", F.coalesce("live", F.array().cast(_SPAN)).alias("live")
    )


def written(spans):
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_live(base, live):
    """Base spans and, as spans of a further kind, those judged live; by start, then kind."""
    marked = F.transform(live, lambda s: s.withField("kind", F.lit(LIVE)).withField("order", F.lit(len(KINDS))))
    return F.array_sort(F.concat(base, marked))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "<secret>", length: str | None = None, **options) -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; rows and columns stay, overlaps get one mark.

    ``length``: a column that states the characters of the text; it follows a changed text, if ``docs`` has it.
    """
    key = F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    found = scan(docs, keep=[key.alias("__key")], text=text, **options).where(F.size("live") > 0)
    found = found.groupBy("__key").agg(F.first("live").alias("__live"))
    state = lambda out, at: F.struct(out.alias("out"), at.cast("int").alias("at"))

    def step(a, s):
        gap = F.col(text).substr(a["at"] + 1, s["start"] - a["at"])
        further = state(a["out"], F.greatest(a["at"], s["end"]))
        return F.when(s["start"] < a["at"], further).otherwise(state(F.concat(a["out"], gap, F.lit(mark)), s["end"]))

    kept = F.aggregate("__live", state(F.lit(""), F.lit(0)), step, lambda a: F.concat(a["out"], F.col(text).substr(a["at"] + 1, F.length(text))))
    changed = F.col("__live").isNotNull()
    joined = docs.join(found, key == found["__key"], "left").withColumn(text, F.when(changed, kept).otherwise(F.col(text)))
    if length in docs.columns:
        joined = joined.withColumn(length, F.when(changed, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return joined.select(*docs.columns)
