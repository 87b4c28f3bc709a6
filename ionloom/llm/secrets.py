"""Secrets in a corpus, told apart by who owns them.

Candidates are found in every whole text; the value of each is hashed and counted over the corpus by distinct
repositories and distinct owners. A value that many owners hold is a copied example; one that a single owner
holds looks live. Strings that merely look like keys (long, of mixed characters) count only where an owner has
them for itself. Everything is DataFrame functions.

A match's place follows from what lies before it: a text split by a pattern gives the gaps between its matches,
and a running sum over gaps and matches, per text, gives their starts in code points.

Defined results: a null text is empty. A null owner is an owner of its own; a null repository counts as one.
Repeated rows are found alike and add nothing to the counts. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import staged

# Pattern, group of the value, and the least length of match and value, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
OWNED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
BASE = ("assign", "access", "hex")


def _found(kind: str, order: int, pattern: str, group: int, present: Column, whole: int, value: int) -> Column:
    """Per text an array of (gap, size, value, ...), one entry per match, failing matches included."""
    text, p = F.col("t"), F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    entries = F.zip_with(
        F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v")),
        gaps,
        lambda m, g: F.struct(g.alias("gap"), m["m"].alias("m"), m["v"].alias("v")),
    )
    entries = F.transform(
        F.filter(entries, lambda e: e["m"].isNotNull()),
        lambda e: F.struct(
            e["gap"].alias("gap"),
            F.char_length(e["m"]).alias("size"),
            F.sha2(e["v"], 256).alias("hash"),
            ((F.char_length(e["m"]) >= whole) & (F.char_length(e["v"]) >= value)).alias("good"),
            (e["v"].rlike("[A-Z]") & e["v"].rlike("[a-z]") & e["v"].rlike("[0-9]")).alias("mixed"),
        ),
    )
    return F.when(present, F.struct(F.lit(order).alias("rank"), F.lit(kind).alias("kind"), entries.alias("entries")))


def candidates(documents: DataFrame, owner: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(row, doc_id)`` and the candidate spans with the hash of their value."""
    text = F.col("t")
    kinds = F.array(
        _found("assign", 0, ASSIGN, 2, text.rlike(ASSIGN), 0, 12),
        _found("access", 1, ACCESS, 0, text.contains("AKIA"), 18, 0),
        _found("hex", 2, HEX, 0, text.rlike(HEX), 16, 0),
        _found("owned", 3, OWNED, 0, text.rlike(OWNED), 20, 0),
    )
    rows = documents.select(
        "doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"), F.coalesce("text", F.lit("")).alias("t")
    )
    rows = rows.select("doc_id", "owner", "repo", F.filter(kinds, lambda k: k.isNotNull()).alias("kinds"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.select("row", "doc_id", "owner", "repo", F.explode("kinds").alias("k")).select("row", "doc_id", "owner", "repo", "k.rank", "k.kind", F.posexplode("k.entries").alias("at", "e"))
    upto = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("e.gap") + F.col("e.size")).over(upto)
    spans = each.withColumn("stop", stop.cast("long")).where("e.good and (kind <> 'owned' or e.mixed)")
    return rows.select("row", "doc_id"), spans.select("row", "doc_id", "owner", "repo", "rank", "kind", (F.col("stop") - F.col("e.size")).alias("start"), "stop", F.col("e.hash").alias("hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """Per value hash the number of distinct owners and of distinct repositories of an owner, summed."""
    per_owner = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(F.count("repo").alias("repos"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(documents: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 1, most_repositories: int | None = None) -> DataFrame:
    """One row per document with its spans: structs of start, rank, kind, stop, n_owners, n_repos and live.

    A span is live if at most ``most_owners`` owners hold its value and, where a bound is given, at most
    ``most_repositories`` repositories do. Base kinds are always kept, others only if live.
    """
    rows, spans = candidates(documents, owner, repository)
    spans = staged(spans, "secret-spans")
    live = F.col("n_owners") <= most_owners
    if most_repositories is not None:
        live &= F.col("n_repos") <= most_repositories
    known = spans.join(ownership(spans), "hash").withColumn("live", live)
    known = known.where(F.col("live") | F.col("kind").isin(*BASE))
    per_row = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "stop", "n_owners", "n_repos", "live"))).alias("spans"))
    return rows.join(per_row, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
