"""Scores, pivots and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points per occurrence, lowest scores of the grades.
WEIGHTS = {"default": {"broken": 5.0, "orphan": 2.0, "style": 3.0, "blocker": 10.0, "warning": 2.0}, "strict": {"broken": 8.0, "orphan": 3.0, "style": 4.0, "blocker": 15.0, "warning": 3.0},
           "lenient": {"broken": 3.0, "orphan": 1.0, "style": 1.0, "blocker": 5.0, "warning": 1.0}}
GRADES = {"readiness": [(95, "A"), (85, "B"), (70, "C"), (55, "D")], "run": [(95, "A"), (85, "B"), (70, "C")], "report": [(90, "A"), (80, "B"), (70, "C")]}
STATUS_ORDER = ["broken", "suspicious", "unverified", "ok"]


def grade(score: Column, scale: str = "readiness") -> Column:
    out = None
    for least, g in GRADES[scale]:
        out = F.when(score >= least, g) if out is None else out.when(score >= least, g)
    return out.otherwise("F")


def readiness(broken: Column, orphan: Column, style: Column, blocker: Column, warning: Column, weights: str = "default") -> Column:
    """100 less the weighted counts, between 0 and 100, to two places."""
    w = WEIGHTS[weights]
    lost = broken * w["broken"] + orphan * w["orphan"] + style * w["style"] + blocker * w["blocker"] + warning * w["warning"]
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost)), 2)


def deduction(counts: dict[str, Column], weights: str = "default") -> Column:
    """What the weighted counts take off, unclamped; counts by name (broken, orphan, style, blocker, warning), absent ones 0."""
    out = F.lit(0.0)
    for k, c in counts.items():
        out = out + F.coalesce(c, F.lit(0)) * WEIGHTS[weights][k]
    return out


def module_scores(modules: DataFrame, links: DataFrame, anomalies: DataFrame, weights: str = "default") -> DataFrame:
    """Per module of the map (module, doc), processed or not: documents, broken links, orphans, blockers, warnings, score.

    links: (doc, status); anomalies: (doc, kind, severity). Orphaned references also count as warnings, and are charged twice.
    """
    once = modules.select("module", "doc").distinct()
    broken = links.where("status = 'broken'").groupBy("doc").agg(F.count(F.lit(1)).alias("broken"))
    odd = anomalies.groupBy("doc").agg(F.count_if(F.col("kind") == "orphaned_reference").alias("orphan"), F.count_if(F.col("severity") == "blocker").alias("blocker"), F.count_if(F.col("severity") == "warning").alias("warning"))
    sums = once.join(broken, "doc", "left").join(odd, "doc", "left").groupBy("module").agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("broken", "orphan", "blocker", "warning")])
    lost = deduction({c: F.col(c) for c in ("broken", "orphan", "blocker", "warning")}, weights)
    return sums.withColumn("deduction", lost).withColumn("score", F.round(F.greatest(F.lit(0.0), 100.0 - F.col("deduction")), 2))


def is_ready(score: Column, blockers: Column) -> Column:
    return (score >= 90) & (blockers == 0)


def verdict(score: Column, blockers: Column, broken: Column) -> Column:
    """The last line of a readiness summary in one word."""
    return F.when(is_ready(score, blockers), "ready").when(blockers > 0, "blockers").when(broken > 0, "broken links").otherwise("conditional")


def status_scores(links: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: links by status, and three scores with their grades: of a run (5 a broken link, 85 of no link), of a loaded
    report (5 a broken link and 5 times the share of unverified ones) and of a pushed report (5 and 0.5 each).
    """
    n = lambda s: F.count_if(F.col("status") == s)
    per = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n("ok").alias("ok"), n("broken").alias("broken"), n("unverified").alias("unverified"))
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    run = F.when(F.col("total") == 0, 85.0).otherwise(held(100.0 - 5.0 * F.col("broken")))
    loaded = held(100.0 - 5 * F.col("broken") - F.coalesce(F.try_divide(F.col("unverified") * 5.0, F.col("total")), F.lit(0.0)))
    pushed = held(100.0 - 5 * F.col("broken") - 0.5 * F.col("unverified"))
    rows = per
    for name, x, scale in (("run", run, "run"), ("report", loaded, "report"), ("pushed", pushed, "report")):
        rows = rows.withColumn(f"{name}_score", F.round(x, 1)).withColumn(f"{name}_grade", grade(x, scale))
    return rows.withColumn("is_ready", (loaded >= 85) & (F.col("broken") == 0))


def batch_totals(results: DataFrame, seconds: float) -> DataFrame:
    """One row: documents, links, broken links, broken rate (0 of nothing) and documents an hour. results: (doc, links, broken)."""
    sums = results.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))
    per_hour = F.lit(0.0) if seconds <= 0 else F.round(F.col("documents") * 3600.0 / seconds, 2)
    return sums.withColumn("broken_rate", rate(F.col("broken"), F.col("links"))).withColumn("docs_per_hour", per_hour)


# What acceptance asks for.
GATES = {"hours": 4.0, "readiness": 85.0, "blocker_docs": 0.20, "viewer": 0.50}


def acceptance_gates(totals: DataFrame, target_docs: int, seconds: float, failures: int = 0) -> DataFrame:
    """(gate, value, passed) from one row (documents, score, blocker_docs, pass_rate)."""
    share = F.col("blocker_docs") / F.greatest(F.col("documents"), F.lit(1))
    gate = lambda name, value, ok: F.struct(F.lit(name).alias("gate"), F.round(value.cast("double"), 6).alias("value"), ok.alias("passed"))
    gates = F.array(
        gate("throughput", F.col("documents"), (F.col("documents") >= target_docs) & F.lit(seconds <= GATES["hours"] * 3600 and not failures)),
        gate("readiness", F.col("score"), F.col("score") >= GATES["readiness"]),
        gate("blocker documents", share, share < GATES["blocker_docs"]),
        gate("viewers", F.col("pass_rate"), F.col("pass_rate") >= GATES["viewer"]),
    )
    return totals.select(F.explode(gates).alias("g")).select("g.*")


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole to six places; ``empty`` of nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(empty)), 6)


def pivot_with_totals(rows: DataFrame, row: str, column: str, columns: list[str], all_rows: list[str] | None = None) -> DataFrame:
    """Counts of row by column, zero-filled, with a TOTAL row and a total column. ``columns`` are given, so one pass does."""
    counts = [F.count_if(F.col(column) == c).alias(c) for c in columns]
    per = rows.groupBy(row).agg(*counts, F.count(F.lit(1)).alias("total"))
    if all_rows is not None:
        names = rows.sparkSession.createDataFrame([(r,) for r in all_rows], f"{row} string")
        per = names.join(per, row, "left").na.fill(0)
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*columns, "total"]]).select(F.lit("TOTAL").alias(row), *columns, "total")
    return per.unionByName(total)


def link_table(links: DataFrame, status: str | None = None, text: str | None = None, order: str = "source_doc", offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of the link table: an optional status (all is none), a part of the document's name in any case, sorted."""
    if status and status != "all":
        links = links.where(F.col("status") == status)
    if text:
        links = links.where(F.contains(F.lower("source_doc"), F.lit(text.lower())))
    links = links.orderBy(order, "link_id").offset(offset)
    return links if limit is None else links.limit(limit)


# The columns of the link report and of a run's report, in order.
REPORT_COLUMNS = ["source_doc", "link_text", "link_location", "target_doc", "target_anchor", "status", "confidence", "error_msg", "detected_by", "ner_pattern", "llm_called", "llm_confidence_before", "llm_confidence_after"]
RUN_COLUMNS = ["source_doc", "link_text", "link_location_descriptor", "target_doc", "target_anchor", "status", "confidence", "detected_by", "error_msg"]


def csv_rows(links: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns of a report, as text: decimals with three places, flags as yes or no, nulls empty. Columns the links lack are
    empty (flags: no); link_location is the links' link_location_descriptor. link_id comes along if there is one.
    """
    have = set(links.columns)

    def one(c: str) -> Column:
        source = "link_location_descriptor" if c == "link_location" and c not in have else c
        if c == "llm_called":
            return F.when(F.coalesce(F.col(c), F.lit(False)), "yes").otherwise("no") if c in have else F.lit("no")
        if source not in have:
            return F.lit("")
        decimal = c.startswith("llm_confidence") or (c == "confidence" and columns is not RUN_COLUMNS)
        return F.coalesce(F.format_string("%.3f", F.col(source)) if decimal else F.col(source).cast("string"), F.lit("")) if not decimal else F.when(F.col(source).isNull(), "").otherwise(F.format_string("%.3f", F.col(source)))

    return links.select(*(["link_id"] if "link_id" in have else []), *[one(c).alias(c) for c in columns or REPORT_COLUMNS])


def report_from_rows(rows: DataFrame) -> DataFrame:
    """Anomalies (kind, severity, document, text, suggested_fix, confidence) that a re-read report implies by its statuses."""
    low = F.lower("status")
    kind = F.when(low == "broken", "broken_link").when(low == "unverified", "unverified_link")
    severity = F.when(low == "broken", "blocker").otherwise("warning")
    fix = F.when(low == "broken", F.concat(F.lit("Check target: "), F.coalesce("target_doc", F.lit("")))).otherwise("Manually verify target exists in submission package")
    usual = F.when(low == "broken", 0.9).otherwise(0.7)
    held = rows.where(low.isin("broken", "unverified"))
    return held.select(kind.alias("kind"), severity.alias("severity"), F.coalesce("source_doc", F.lit("")).alias("document"), F.coalesce("link_text", F.lit("")).alias("text"), fix.alias("suggested_fix"), F.coalesce(F.expr("try_cast(confidence as double)"), usual).alias("confidence"))


def by_severity(links: DataFrame) -> DataFrame:
    """Sorted for the report: broken, suspicious, unverified, ok, then document. A range sort; nothing is gathered."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), F.lit(0))
    return links.orderBy(F.when(order == 0, 99).otherwise(order), "source_doc", "link_id")


def set_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, precision, recall, f1 of two sets (1 where a side is empty)."""
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng"))
    p, r = rate(F.col("tp"), F.col("np"), 1.0), rate(F.col("tp"), F.col("ng"), 1.0)
    return n.select("tp", p.alias("precision"), r.alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with edited values: an edit changes every row of its key, and only the fields it gives (null gives none)."""
    changed = edits.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    both = rows.join(changed, keys, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def blueish(color: Column, tolerance: int = 40) -> Column:
    """Whether a colour of six hex digits is blue: its blue is 128 or more and exceeds red and green by ``tolerance``."""
    part = lambda k: F.conv(F.substring(color, k, 2), 16, 10).cast("int")
    return F.coalesce(F.rlike(color, F.lit("^[0-9A-Fa-f]{6}$")) & (part(5) >= 128) & (part(5) - F.greatest(part(1), part(3)) >= tolerance), F.lit(False))


def packed_color(value: Column) -> Column:
    """Six hex digits of a colour packed in an integer."""
    return F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit(0xFFFFFF))), 6, "0")


def link_class(kind: Column, source: Column, target: Column) -> Column:
    """external, internal (no target or the document itself) or cross_doc."""
    return F.when(kind == "external_url", "external").when(target.isNull() | (target == source), "internal").otherwise("cross_doc")
