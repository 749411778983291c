"""Files as DataFrames: listings with digests, Word documents, eCTD backbones, labelled JSON lines."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of the .docx and .pdf files under a folder, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = files.where(F.rlike(F.lower("path"), F.lit(r"\.(docx|pdf)$")))
    return wanted.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def docx_runs(content: bytes) -> list[tuple]:
    """(para, run, text, bold, highlighted, color, style, in_table) of a Word file's runs: body first, then table cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return []
    plain = [(p, False) for p in body.findall(f"{_W}p")]
    cells = [(p, True) for t in body.findall(f"{_W}tbl") for p in t.iter(f"{_W}p")]
    out = []
    for n, (para, in_table) in enumerate(plain + cells):
        style = para.find(f"{_W}pPr/{_W}pStyle")
        for k, run in enumerate(para.iter(f"{_W}r")):
            text = "".join(t.text or "" for t in run.findall(f"{_W}t"))
            color, props = run.find(f"{_W}rPr/{_W}color"), run.find(f"{_W}rPr")
            has = lambda tag: props is not None and props.find(f"{_W}{tag}") is not None
            out.append((n, k, text, has("b"), has("highlight"), None if color is None else color.get(f"{_W}val"), None if style is None else style.get(f"{_W}val"), in_table))
    return out


_DOCX = "path string, error string, para int, run int, text string, bold boolean, highlighted boolean, color string, style string, in_table boolean"


def _parse_docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _DOCX.split(", ")]
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"]):
            try:
                rows += [(path, None, *r) for r in docx_runs(content)]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                rows.append((path, type(e).__name__, *[None] * 8))
        yield pd.DataFrame(rows, columns=names)


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    """Runs of every Word file under a folder; a file that is no Word file gives one row with ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(root)
    return files.select("path", "content").mapInPandas(_parse_docx, _DOCX)


_BACKBONE = "path string, error string, schema_version string, region string, sequence_number string, leaf_id string, relative_path string, operation string, checksum string, checksum_type string, title string, ord int"
# Authorities and the regions they stand for.
REGIONS = {"fda": "us", "us": "us", "ema": "eu", "eu": "eu", "pmda": "jp", "jp": "jp", "hc": "ca", "ca": "ca"}


def backbone_leaves(content: bytes) -> list[tuple]:
    """One row per leaf with a href: schema version, region and sequence of the file, then the leaf's own fields."""
    root = ElementTree.fromstring(content)
    local = lambda e: e.tag.rpartition("}")[2].lower()
    get = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2].lower() == name), None)
    version = get(root, "dtd-version") or get(root, "schema-version")
    version = f"v{version.lstrip('v')}" if version else {"ectd": "v3.2", "submission": "v4.0", "documentlibrary": "v4.0"}.get(local(root), "unknown")
    prefix = next((local(e).removesuffix("-regional") for e in root.iter() if local(e).endswith("-regional")), None)
    raw = get(root, "sequence-number") or get(root, "sequence") or get(root, "submission-sequence")
    tail = re.search(r"(\d{4})$", raw or "")
    rows = []
    for n, leaf in enumerate(e for e in root.iter() if local(e) == "leaf"):
        href = leaf.get("{http://www.w3.org/1999/xlink}href") or get(leaf, "href")
        if not href:
            continue
        title = next(((c.text or "").strip() for c in leaf if local(c) == "title"), "") or None
        check = get(leaf, "checksum") or next((c.text for c in leaf if local(c) == "checksum"), None)
        op = (get(leaf, "operation") or "new").lower()
        rows.append((version, REGIONS.get(prefix, prefix) if prefix else None, tail[1] if tail else raw, get(leaf, "id") or f"leaf-anon-{n}", href, op if op in ("new", "replace", "append", "delete") else "new", check, get(leaf, "checksum-type"), title, n))
    return rows


def _parse_backbones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _BACKBONE.split(", ")]
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"]):
            try:
                rows += [(path, None, *r) for r in backbone_leaves(content)]
            except ElementTree.ParseError as e:
                rows.append((path, str(e), *[None] * 10))
        yield pd.DataFrame(rows, columns=names)


def read_backbones(spark: SparkSession, root: str, glob: str = "*.xml") -> DataFrame:
    """Leaves of every backbone file under a folder; malformed XML gives one row with ``error``. (The parser fetches nothing.)"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "content").mapInPandas(_parse_backbones, _BACKBONE)


def merge_regional(leaves: DataFrame, source_order: str = "src_ord") -> DataFrame:
    """Each leaf_id once: the row of the lowest ``source_order`` (the main backbone before regional ones), then ord."""
    rest = [c for c in leaves.columns if c not in ("leaf_id", source_order, "ord")]
    return leaves.groupBy("leaf_id").agg(F.min(F.struct(source_order, "ord", *rest)).alias("r")).select("leaf_id", "r.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(text, entities) from JSON lines whose entities are [start, end, label] lists."""
    raw = spark.read.schema("text string, entities array<array<string>>").json(path)
    return raw.select("text", F.transform("entities", lambda e: F.struct(e[0].cast("int").alias("span_start"), e[1].cast("int").alias("span_end"), e[2].alias("label"))).alias("entities"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines; blank and malformed lines are passed over."""
    schema = "timestamp string, actor string, action string, document string, links_added int, details map<string,string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("action is not null")


def _yaml(path: str) -> dict | None:
    """A YAML file's content; None if there is no such file. Without the yaml package the ImportError goes on: no file may pass
    for an empty one.
    """
    if not os.path.exists(path):
        return None
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_rules(path: str) -> list[dict]:
    """Rules of a YAML file of regions; a missing file and unknown regions give none, an unknown severity is warning."""
    rules = []
    for region, items in (_yaml(path) or {}).items():
        if region not in REGIONS.values() or not isinstance(items, list):
            continue
        for r in items:
            rules.append({"rule_id": r["id"], "region": region, "severity": r.get("severity") if r.get("severity") in ("info", "warning", "blocker") else "warning", "validator": r.get("validator", ""), "params": r.get("params") or {}})
    return rules


def read_deprecated_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, reason, replaced_by, since) of a YAML registry; entries without id, and a missing or malformed file, give none."""
    try:
        content = _yaml(path)
    except ValueError:  # the yaml package's errors are no ValueErrors; a file that isn't text is
        content = None
    except Exception as e:  # noqa: BLE001
        if type(e).__name__ != "YAMLError" and not any(c.__name__ == "YAMLError" for c in type(e).__mro__):
            raise
        content = None
    items = content.get("deprecated") if isinstance(content, dict) else None
    rows = [tuple(None if r.get(k) is None else str(r[k]) for k in ("id", "reason", "replaced_by", "since")) for r in items or [] if isinstance(r, dict) and r.get("id")]
    return spark.createDataFrame(rows, "id string, reason string, replaced_by string, since string")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A link report as it was written: columns as text, empty cells as empty text, status in lower case."""
    rows = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    return rows.select(*[F.coalesce(F.lower(c) if c == "status" else F.col(c), F.lit("")).alias(c) for c in rows.columns])
