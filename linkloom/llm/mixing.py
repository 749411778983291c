"""A mix of sources at target weights: hash thresholds from nested histograms, no sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.tokens import VOCABULARY, with_token_counts
from linkloom.runtime import cut

#: Bits per histogram level and levels: 36 bits tell 10**10 documents of one source apart.
LEVEL_BITS, LEVELS = 12, 3
#: Most sources a table of targets may name for its broadcast; a longer one is joined by shuffle.
MAX_SOURCES = 10_000


def source_key(source):
    """Letter case and outer white space don't count; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(source), r"^\s+|\s+$", ""), F.lit(""))


def _small(df: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(df) if n_sources <= MAX_SOURCES else df


def mix_budgets(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame, int]:
    """(sized documents, budgets, number of sources).

    Sized documents: (doc_id, key, n_tokens, h), those with text and a source. Budgets, one row per source of ``targets``:
    size, all (size of all sized documents), budget (target_share of it), full (whole uses, at most max_repeats), part
    (tokens of a further partial use) and reachable (max_repeats uses hold the budget). A source listed twice keeps its
    largest target; null targets count as 0 and null max_repeats as 1.
    """
    docs = documents.where("doc_id is not null and text is not null").withColumn("key", source_key(F.col("source"))).where("key is not null")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - LEVEL_BITS * LEVELS)
    sized = cut(with_token_counts(docs, "text", ["doc_id", "key"], vocabulary).withColumn("h", h))
    sizes = sized.groupBy("key").agg(F.sum("n_tokens").alias("size"))
    wanted = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("key")).agg(
        F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "source")).alias("t")
    ).select("key", "t.source", "t.target_share", "t.max_repeats")
    n_sources = wanted.count()
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all"))
    raw = wanted.join(sizes, "key", "left").crossJoin(F.broadcast(total)).withColumn("size", F.coalesce("size", F.lit(0)))  # total: one row
    budget = F.col("target_share") * F.col("all")
    uses = F.when(F.col("size") > 0, F.least(F.floor(budget / F.nullif(F.col("size"), F.lit(0))), F.col("max_repeats").cast("bigint"))).otherwise(0)
    budgets = (
        raw.withColumn("budget", budget)
        .withColumn("full", uses)
        .withColumn("part", F.when((F.col("full") < F.col("max_repeats")) & (F.col("size") > 0), budget - F.col("full") * F.col("size")).otherwise(0.0))
        .withColumn("reachable", F.col("max_repeats") * F.col("size") >= budget)
    )
    return sized, cut(budgets), n_sources


def thresholds(sized: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """(key, below): documents of a source with h < below together have about ``part`` tokens.

    Each level sums tokens per hash bucket inside the bucket where the level above passed the budget; the buckets before
    it are taken whole. Only that bucket's documents are summed again; at the last level it is taken if that comes closer.
    """
    state = budgets.where("part > 0").select("key", F.lit(0).cast("bigint").alias("base"), F.col("part").alias("room"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sized.join(_small(state, n_sources), "key").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("base"))
        hist = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"), F.first("base").alias("base"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = hist.withColumn("upto", F.sum("n").over(upto))
        passed = F.col("upto") > F.col("room")
        first = F.min(F.when(passed, F.struct("bucket", (F.col("room") - F.col("upto") + F.col("n")).alias("room"), "n")))
        end = F.shiftleft(F.col("base") + 1, LEVEL_BITS)
        state = sums.groupBy("key").agg(first.alias("f"), F.max("base").alias("base"), F.max("room").alias("was")).select(
            "key", F.coalesce("f.bucket", end).alias("base"), F.coalesce("f.room", F.lit(0.0)).alias("room"), F.coalesce("f.n", F.lit(0)).alias("n")
        )
        if level < LEVELS - 1:
            state = state.drop("n")
    return state.select("key", (F.col("base") + F.when((F.col("n") > 0) & (F.col("room") * 2 >= F.col("n")), 1).otherwise(0)).alias("below"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixed, budgets). mixed: (doc_id, source, n_tokens, copies) of each document used at least once.

    A source is used whole ``full`` times, its documents below the threshold once more, so uses differ by one at most and
    never exceed max_repeats. Nothing is sampled: the same documents come out in every run. Null or empty texts and
    documents without a source take no part; an empty table of documents gives no rows, and budgets of size 0.
    """
    sized, budgets, n = mix_budgets(documents, targets, vocabulary)
    below = thresholds(sized, budgets, n)
    plan = budgets.select("key", "source", "full").join(_small(below, n), "key", "left")
    copies = F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    mixed = sized.where("n_tokens > 0").join(_small(plan, n), "key").select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
    return mixed, budgets


def mix_report(mixed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source of the targets: tokens it has, tokens wanted and used, share of the mix wanted and reached, reachable."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    rows = budgets.select("source", "target_share", "max_repeats", "size", F.round("budget").cast("bigint").alias("wanted"), "reachable").join(used, "source", "left")
    rows = rows.withColumn("used", F.coalesce("used", F.lit(0)))
    total = rows.agg(F.sum("used").alias("sum"))
    return rows.crossJoin(F.broadcast(total)).select(  # total: one row
        "source", "target_share", "max_repeats", "size", "wanted", "used", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(F.col("sum") > 0, F.round(F.col("used") / F.col("sum"), 6)).otherwise(0.0).alias("actual_share"), "reachable",
    )
