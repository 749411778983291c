"""Validation of links, anomalies and rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.reporting import blueish
from linkloom.operators.resolution import jaccard

SCHEMES = ["http", "https", "ftp", "mailto"]


def url_status(url: Column) -> Column:
    """broken for empty addresses, other schemes and missing hosts; else unverified (nothing is fetched)."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    bad = F.coalesce(F.trim(url), F.lit("")) == ""
    return F.when(bad | ~scheme.isin(SCHEMES) | ((scheme != "mailto") & (host == "")), "broken").otherwise("unverified")


def link_status(links: DataFrame, docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds ``found_status`` and ``found_confidence``: external links by their address; a missing target document, or an
    anchor its document lacks, is broken; the rest is ok. 1.0 if ok, else 0.5. links: (link_kind, target, doc, anchor).
    """
    has_doc = docs.select("doc").distinct().withColumn("has_doc", F.lit(True))
    has_anchor = anchors.select("doc", "anchor").distinct().withColumn("has_anchor", F.lit(True))
    seen = links.join(has_doc, "doc", "left").join(has_anchor, ["doc", "anchor"], "left")
    status = (
        F.when(F.col("link_kind") == "external_url", url_status(F.col("target")))
        .when(F.col("has_doc").isNull(), "broken")
        .when(F.col("anchor").isNotNull() & F.col("has_anchor").isNull(), "broken")
        .otherwise("ok")
    )
    return seen.withColumn("found_status", status).drop("has_doc", "has_anchor").withColumn("found_confidence", F.when(F.col("found_status") == "ok", 1.0).otherwise(0.5))


def integrity_issue(sources_known: Column, target_known: Column, is_self: Column, file_known: Column, anchor_known: Column) -> Column:
    """The first check that fails, in this order; ok if none does."""
    return (
        F.when(~sources_known, "missing_source").when(~target_known, "missing_target").when(is_self, "self_reference")
        .when(~file_known, "missing_file").when(~anchor_known, "missing_anchor").otherwise("ok")
    )


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))


def text_similarity(a: Column, b: Column) -> Column:
    """Token Jaccard: 1 if both are empty, 0 if one is."""
    return jaccard(tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit(""))), 1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def suspicious_target(text: Column, anchor: Column, threshold: float = 0.5) -> Column:
    """1 - Jaccard of the digit groups of text and anchor where it shows that they don't belong together; else null."""
    digits = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    a, b = digits(text), digits(anchor)
    j = jaccard(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (j < 1 - threshold), F.round(1 - j, 3))


def deprecated_ids(units: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, line_no, id, n): uses of ids of the registry, none with a capital, digit or dash next to them.

    An id of capitals, digits and dashes is used exactly where a whole run of such signs equals it; so the runs are taken out
    of the text and joined by equality, whatever the ids' shapes and number. Ids with other signs are an error.
    """
    wanted = registry.select("id").where("id is not null").distinct()
    if wanted.where(~F.rlike("id", F.lit("^[A-Z0-9-]+$"))).limit(1).count():
        raise ValueError("ids of the registry must be made of capitals, digits and dashes")
    ids = units.select("doc_id", "line_no", F.explode(F.regexp_extract_all("text", F.lit("[A-Z0-9-]+"), F.lit(0))).alias("id"))
    return ids.join(wanted, "id", "left_semi").groupBy("doc_id", "line_no", "id").agg(F.count(F.lit(1)).alias("n"))


def blue_text(runs: DataFrame) -> DataFrame:
    """(doc, text, kind, severity, confidence): runs with text that are blue and no link."""
    found = runs.where(blueish(F.col("color")) & ~F.coalesce("is_hyperlink", F.lit(False)) & (F.trim("text") != ""))
    return found.select("doc", "text", F.lit("blue_text_no_link").alias("kind"), F.lit("warning").alias("severity"), F.lit(0.85).alias("confidence"))


def orphaned_references(references: DataFrame, links: DataFrame) -> DataFrame:
    """References (doc, ref, ...) whose text no link of the same document has, one row per reference."""
    linked = links.select("doc", F.col("link_text").alias("ref")).where("doc is not null and ref is not null").distinct()
    return references.join(linked, ["doc", "ref"], "left_anti")


def anomaly_report(found: list[DataFrame], toggles: dict[str, bool] | None = None) -> DataFrame:
    """Per document: anomalies, blockers, warnings. found: (doc, kind, severity); kinds a toggle switches off don't count."""
    every = found[0].select("doc", "kind", "severity")
    for f in found[1:]:
        every = every.unionByName(f.select("doc", "kind", "severity"))
    off = [k for k, on in (toggles or {}).items() if not on]
    if off:
        every = every.where(~F.col("kind").isin(off))
    return every.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def pipeline_status(kind: Column, target: Column, has_file: Column, is_pdf: Column, page: Column, n_pages: Column, has_mark: Column) -> Column:
    """struct(kind, status) after the pipeline's own rules: what isn't on the web is a link to a document; web addresses need a
    dot; a document must exist; without a fragment its top will do; a PDF's page must be within the file, else unverified; a
    bookmark must exist. ``has_mark`` and ``n_pages`` are null for files that can't be read.
    """
    web = F.startswith(F.lower(target), F.lit("http://")) | F.startswith(F.lower(target), F.lit("https://"))
    kind = F.when((kind == "external_url") & ~F.coalesce(web, F.lit(False)), "cross_doc").otherwise(kind)
    file, mark = F.substring_index(target, "#", 1), F.when(F.contains(target, F.lit("#")), F.regexp_replace(target, "^[^#]*#", "")).otherwise("")
    pdf = F.when(n_pages.isNull(), "unverified").when(page.isNull(), "ok").when(page.between(1, n_pages), "ok").otherwise("unverified")
    marked = F.when(has_mark.isNull(), "unverified").when(has_mark, "ok").otherwise("broken")
    status = (
        F.when(kind == "external_url", F.when(F.contains(target, F.lit(".")), "ok").otherwise("broken"))
        .when(F.coalesce(file, F.lit("")) == "", "unverified")
        .when(~has_file, "broken")
        .when((kind == "cross_doc") & (mark == ""), "ok")
        .otherwise(F.when(is_pdf, pdf).otherwise(marked))
    )
    return F.struct(kind.alias("kind"), status.alias("status"))


# The status an integrity issue gives a link.
ISSUE_STATUS = {"ok": "ok", "missing_target": "broken", "missing_file": "broken", "missing_anchor": "broken", "missing_source": "broken", "self_reference": "suspicious", "circular_reference": "suspicious"}


def issue_status(issue: Column) -> Column:
    out = None
    for k, v in ISSUE_STATUS.items():
        out = F.when(issue == k, v) if out is None else out.when(issue == k, v)
    return out


#: Viewers that only a person can check; they report every link as unverified.
MANUAL_VIEWERS = ["adobe_acrobat_pro", "fda_esg", "ema_espre", "pmda_gateway"]


def viewer_results(links: DataFrame, structural: DataFrame | None = None, manual: list[str] | None = None) -> DataFrame:
    """(viewer, doc, link_kind, status): what each viewer makes of each link and document.

    links: (doc, link_kind, resolves), resolves being null where it can't be told. The headless viewer follows the links; the
    structural one has a row per document, from ``structural`` (doc, sound), unverified without a result; manual viewers
    have an unverified row per document and per link. Links meet viewers by an explode, not by a join.
    """
    manual = MANUAL_VIEWERS if manual is None else manual
    docs = links.select("doc").distinct()
    checked = docs.withColumn("sound", F.lit(None).cast("boolean")) if structural is None else docs.join(structural, "doc", "left")
    follow = F.when(F.col("resolves").isNull(), "unverified").when(F.col("resolves"), "ok").otherwise("broken")
    row = lambda v, kind, status: F.struct(F.lit(v).alias("viewer"), kind.alias("link_kind"), status.alias("status"))
    per_link = links.select("doc", F.explode(F.array(row("headless", F.col("link_kind"), follow), *[row(v, F.col("link_kind"), F.lit("unverified")) for v in manual])).alias("r"))
    sound = F.when(F.col("sound").isNull(), "unverified").when(F.col("sound"), "ok").otherwise("structural_error")
    per_doc = checked.select("doc", F.explode(F.array(row("structural", F.lit("document"), sound), *[row(v, F.lit("document"), F.lit("unverified")) for v in manual])).alias("r"))
    return per_link.unionByName(per_doc).select("r.viewer", "doc", "r.link_kind", "r.status")


def viewer_report(results: DataFrame) -> DataFrame:
    """Per viewer: total, ok, broken, unverified, structural errors and the share that passes (1 of nothing)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    per = results.groupBy("viewer").agg(F.count(F.lit(1)).alias("total"), n("ok").alias("ok"), n("broken").alias("broken"), n("unverified", "viewer_limitation").alias("unverified"), n("structural_error").alias("structural_errors"))
    return per.withColumn("pass_rate", F.round(F.coalesce(F.try_divide("ok", "total"), F.lit(1.0)), 6))


def file_name_problems(path: Column) -> Column:
    """What is wrong with a file name, joined by "; "; empty if nothing is."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat_ws(
        "; ",
        F.when(name != F.lower(name), "contains uppercase characters"),
        F.when(F.contains(name, F.lit(" ")), "contains spaces"),
        F.when(F.startswith(name, F.lit("_")), "starts with underscore"),
        F.when(F.rlike(name, F.lit(r"[^\x00-\x7f]")), "contains non-ASCII characters"),
    )


def _survives(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def ok(t: str | None) -> bool:
        try:
            return t is None or t.encode("shift_jis").decode("shift_jis") == t
        except UnicodeError:
            return False

    for s in titles:
        yield s.map(ok)


def sjis_round_trip(title: Column) -> Column:
    """Whether a title survives Shift-JIS; null titles do. (Spark's encode knows no Shift-JIS, so Arrow batches do it.)"""
    return F.pandas_udf(_survives, "boolean")(title)


#: Lowest bookmark depth a rule asks for unless its params say otherwise.
DEPTHS = {"fda_bookmark_depth_min_3": 3, "ema_bookmark_depth_min_2": 2, "pmda_bookmark_depth_min_3": 3, "hc_bookmark_depth_min_3": 3}
#: What the rules on PDF/A accept.
PDF_A = {"pdf_a_2b_compliance": ["PDF/A-2b"], "pdf_a_1b_or_2b_compliance": ["PDF/A-1b", "PDF/A-2b"]}


def is_pdf_a(format_name: Column) -> Column:
    """Whether a file's metadata name a PDF/A format."""
    return F.startswith(F.upper(F.trim(F.coalesce(format_name, F.lit("")))), F.lit("PDF/A"))


def bookmark_depth_violations(pdfs: DataFrame, bookmarks: DataFrame, least: int) -> DataFrame:
    """(target, detail) of PDFs (path) whose bookmarks (path, level) go less deep than ``least``; none is depth 0."""
    depth = bookmarks.groupBy("path").agg(F.max("level").alias("depth"))
    found = pdfs.select("path").distinct().join(depth, "path", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).where(F.col("depth") < least)
    return found.select(F.col("path").alias("target"), F.concat(F.lit("depth "), "depth", F.lit(f", at least {least} wanted")).alias("detail"))


def rule_checks() -> dict:
    """Check name to a function (facts, params) that gives (target, detail); more may be added by name.

    facts: leaves (leaf_id, title, path), pdfs (path, format), bookmarks (path, level), runs (doc, text, color, is_hyperlink).
    """
    leaf = lambda f: f["leaves"]
    checks = {
        "leaf_title_max_length": lambda f, p: leaf(f).where(F.length("title") > int(p.get("max_length", 256))).select(F.col("leaf_id").alias("target"), F.length("title").cast("string").alias("detail")),
        "espre_filename_convention": lambda f, p: leaf(f).select(F.col("leaf_id").alias("target"), file_name_problems(F.col("path")).alias("detail")).where("detail <> ''"),
        "pmda_sjis_round_trip": lambda f, p: leaf(f).where("title is not null").select(F.col("leaf_id").alias("target"), F.col("title").alias("detail"), sjis_round_trip(F.col("title")).alias("ok")).where("not ok").drop("ok"),
        "hyperlink_color_blue": lambda f, p: blue_text(f["runs"]).groupBy(F.col("doc").alias("target")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" blue runs without link")).alias("detail")),
    }
    for name, least in DEPTHS.items():
        checks[name] = lambda f, p, least=least: bookmark_depth_violations(f["pdfs"], f["bookmarks"], int(p.get("min_depth", least)))
    for name, accepted in PDF_A.items():
        checks[name] = lambda f, p, accepted=accepted: f["pdfs"].where(~is_pdf_a(F.col("format"))).select(F.col("path").alias("target"), F.lit("not one of " + ", ".join(accepted)).alias("detail"))
    return checks


def evaluate_rules(rules: list[dict], facts: dict[str, DataFrame], regions: list[str] | None = None, checks: dict | None = None) -> tuple[DataFrame | None, list[str]]:
    """(violations, skipped): violations (rule_id, region, severity, target, detail) of the rules of the given regions (none
    given: of all), None if no rule applies; skipped names the rules whose check is not known.
    """
    checks, out, skipped = checks or rule_checks(), None, []
    for r in rules:
        if regions and r["region"] not in regions:
            continue
        if r["validator"] not in checks:
            skipped.append(r["rule_id"])
            continue
        found = checks[r["validator"]](facts, r.get("params") or {}).select(*[F.lit(r[k]).alias(k) for k in ("rule_id", "region", "severity")], "target", "detail")
        out = found if out is None else out.unionByName(found)
    return out, skipped


def rule_report(violations: DataFrame) -> DataFrame:
    """Per region and in all (region TOTAL): violations, blockers, warnings and whether it passes, which blockers alone prevent."""
    per = violations.rollup("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return per.select(F.coalesce("region", F.lit("TOTAL")).alias("region"), "n", "blockers", "warnings", (F.col("blockers") == 0).alias("passed"))
