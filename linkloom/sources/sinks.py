"""Writing reports, link plans and audit trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.reporting import by_severity, csv_rows


def write_links_csv(links: DataFrame, path: str, columns: list[str] | None = None) -> bool:
    """The link report, most severe first, quoted so that read_report gives the same cells back. Nothing is written, and False
    returned, where there are no links.
    """
    if links.isEmpty():
        return False
    csv_rows(by_severity(links), columns).drop("link_id").write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)
    return True


def write_audit(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, times in UTC to the second, details as text."""
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    events.withColumn("timestamp", stamp).withColumn("details", F.transform_values("details", lambda _, v: v.cast("string"))).write.mode("append").json(path)


def edit_plan(links: DataFrame) -> DataFrame:
    """Adds ``step``: the order in which a document's links are applied, last run and last place first, so places hold."""
    w = Window.partitionBy("document").orderBy(F.desc("run"), F.desc("span_start"))
    return links.withColumn("step", F.row_number().over(w))


def missing_insertions(plan: DataFrame, present: DataFrame) -> DataFrame:
    """The planned (document, href) that are not there yet: applying a plan twice changes nothing."""
    return plan.distinct().join(present.select("document", "href").distinct(), ["document", "href"], "left_anti")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``current`` with ``changes`` merged in by key: changed values win, but columns of ``keep`` stay as first written."""
    rest = [c for c in current.columns if c not in keys]
    both = current.alias("a").join(changes.alias("b"), keys, "full")
    pick = lambda c: (F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))).alias(c)
    return both.select(*keys, *map(pick, rest))
