"""References to records that do not exist at the time of the reference, from signed existence counts per key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.spelling import anchor_key, path_key
from linkloom.runtime import cut

DAY_US = 86_400_000_000


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def existence_deltas(rows: DataFrame, keys: list[str], since: str, until: str) -> DataFrame:
    """(keys, t, d, s): d is +1 when a record begins to exist and -1 when it ends, s is +1 when one begins. Rows that never
    began (null ``since``) give nothing; null ``until`` means still there. Repeated rows raise and lower a count alike.
    """
    ticks = F.array(
        F.struct(micros(since).alias("t"), F.lit(1).alias("d"), F.lit(1).alias("s")),
        F.struct(micros(until).alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("s")),
    )
    return rows.where(F.col(since).isNotNull()).select(*keys, F.inline(ticks)).where("t is not null")


def daily_counts(refs: DataFrame, deltas: DataFrame, keys: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """(keys, day, refs, d, s, ticks): the signed counts of each key and day: references made, existence gained and lost, records
    begun, and the day's changes of existence in order. ``refs`` (keys, v, optional sign: -1 takes a reference back) and
    ``deltas`` are changes; ``earlier`` is what a run before returned, which the new changes carry on.
    """
    sign = F.col("sign") if "sign" in refs.columns else F.lit(1)
    no = F.lit(None).cast("struct<t:bigint,d:bigint,s:bigint>")
    zero = F.lit(0).cast("bigint")
    instants = deltas.groupBy(*keys, "t").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    rows = instants.select(*keys, F.floor(F.col("t") / DAY_US).alias("day"), zero.alias("refs"), F.struct("t", "d", "s").alias("tick"))
    asked = refs.groupBy(*keys, F.floor(F.col("v") / DAY_US).alias("day")).agg(F.sum(sign).cast("bigint").alias("refs"))
    rows = rows.unionByName(asked.select(*keys, "day", "refs", no.alias("tick")))
    if earlier is not None:
        rows = rows.unionByName(earlier.select(*keys, "day", "refs", no.alias("tick"))).unionByName(earlier.select(*keys, "day", zero.alias("refs"), F.explode("ticks").alias("tick")))
    total = lambda c: F.coalesce(F.sum(f"tick.{c}"), F.lit(0)).alias(c)
    return rows.groupBy(*keys, "day").agg(F.sum("refs").alias("refs"), total("d"), total("s"), F.sort_array(F.collect_list("tick")).alias("ticks"))  # one key's changes in a day


def orphan_days(daily: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, refs, d, s, total, ticks) of the keys and days with positive references and, at some time of the day, zero
    existence. d and s are the sums before the day, total the records that ever begin; a key has a row a day at most.
    """
    past = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c)
    state = daily.select(*keys, "day", "refs", "ticks", before("d"), before("s"), F.sum("s").over(Window.partitionBy(*keys)).alias("total"))
    start = F.struct(F.col("d").alias("now"), F.col("d").alias("least"))
    step = lambda acc, x: F.struct((acc["now"] + x["d"]).alias("now"), F.least(acc["least"], acc["now"] + x["d"]).alias("least"))
    least = F.when(F.size("ticks") == 0, F.col("d")).otherwise(F.aggregate("ticks", start, step)["least"])
    return state.where((F.col("refs") > 0) & (least <= 0))


def probe(refs: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``found`` to each reference row (keys, id, v, ...): ok, missing, deleted or late, judged at time v (microseconds).

    A key exists at v if its deltas up to and including v sum to more than zero. The orphan keys come from the signed counts
    of references and existence alone; only the references that fall on an orphan key's day are judged at their instant, all
    others are ok. References are summed before they are shuffled and meet one row each, in a join whose skew Spark splits;
    no window or group holds a key's references.
    """
    state = orphan_days(daily_counts(refs, deltas, keys), keys).drop("refs")
    sums = F.aggregate(
        "ticks", F.struct(F.col("d"), F.col("s")),
        lambda acc, x: F.when(x["t"] <= F.col("v"), F.struct((acc["d"] + x["d"]).alias("d"), (acc["s"] + x["s"]).alias("s"))).otherwise(acc),
    )
    found = F.when(F.col("total").isNull() | (F.col("sums.d") > 0), "ok").when(F.col("total") == 0, "missing").when(F.col("sums.s") == 0, "late").otherwise("deleted")
    judged = refs.withColumn("day", F.floor(F.col("v") / DAY_US)).join(state, [*keys, "day"], "left").withColumn("sums", F.when(F.size("ticks") == 0, F.struct("d", "s")).otherwise(sums))
    return judged.select(*refs.columns, found.alias("found"))


def current_links(links: DataFrame) -> DataFrame:
    """(id, doc, anchor, v): each link once, as last loaded, with its target in one spelling. External links, links without
    link_id or validated_at (they can't be judged at a time) and links without a target are left out; an internal bookmark
    without target_doc points to its own document.
    """
    own = F.when(F.col("link_kind") == "internal_bookmark", path_key(F.col("source_doc")))
    doc = F.when(F.col("link_kind").isNull() | (F.col("link_kind") != "external_url"), F.coalesce(path_key(F.col("target_doc")), own))
    rows = links.where("link_id is not null and validated_at is not null").select(F.col("link_id").alias("id"), F.struct("loaded_at", micros("validated_at").alias("v"), doc.alias("doc"), anchor_key(F.col("target_anchor")).alias("anchor")).alias("r"))
    return rows.groupBy("id").agg(F.max("r").alias("r")).where("r.doc is not null").select("id", "r.doc", "r.anchor", "r.v")


def orphan_links(links: DataFrame, docs: DataFrame, anchors: DataFrame, shared: DataFrame) -> DataFrame:
    """(link_id, missing_table, period_month, reason): every link whose target document or anchor did not exist when the link
    was validated, at most once; status and error_msg are not consulted. Blank anchors ask for no anchor. Empty tables
    give no rows for no links; extra columns are ignored.
    """
    refs = cut(current_links(links))
    shared_keys = shared.select(path_key(F.col("doc_path")).alias("doc"), anchor_key(F.col("anchor_key")).alias("anchor")).where("doc is not null").distinct()
    marked = refs.join(shared_keys.select("doc").distinct().withColumn("is_shared", F.lit(True)), "doc", "left")
    in_shared = marked.where("is_shared and anchor is not null").join(shared_keys, ["doc", "anchor"], "left_anti").select("id", "v", F.lit("shared_docs").alias("missing_table"), F.lit("missing").alias("found"))

    versions = docs.select("file_id", path_key(F.col("source_path")).alias("doc"), "ingested_at", "deleted_at").where("doc is not null")
    judged = cut(probe(marked.where("is_shared is null").select("id", "doc", "anchor", "v"), existence_deltas(versions, ["doc"], "ingested_at", "deleted_at"), ["doc"]))
    in_docs = judged.where("found <> 'ok'").select("id", "v", F.lit("dossier_docs").alias("missing_table"), "found")

    defined = (
        anchors.select(F.col("doc_id").alias("file_id"), anchor_key(F.col("anchor_key")).alias("anchor"), "defined_at", "removed_at")
        .where("anchor is not null")
        .join(versions.select("file_id", "doc").distinct(), "file_id")
    )
    passed = judged.where("found = 'ok' and anchor is not null").select("id", "doc", "anchor", "v")
    in_anchors = probe(passed, existence_deltas(defined, ["doc", "anchor"], "defined_at", "removed_at"), ["doc", "anchor"]).where("found <> 'ok'").select("id", "v", F.lit("anchor_def").alias("missing_table"), "found")

    month = F.date_format(F.expr("timestampadd(MICROSECOND, v, timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM")
    return in_shared.unionByName(in_docs).unionByName(in_anchors).select(F.col("id").alias("link_id"), "missing_table", month.alias("period_month"), F.col("found").alias("reason"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans.groupBy("missing_table", "period_month", "reason").agg(F.count(F.lit(1)).alias("n_links"))
