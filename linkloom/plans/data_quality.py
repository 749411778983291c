"""Queries p2 and p3."""

from __future__ import annotations

from linkloom.operators import orphan_refs, snapshot_delta
from linkloom.runtime import table


def p2_found(spark, sf_dir):
    return snapshot_delta.snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "timeline_entries"))


def p2_counts(spark, sf_dir):
    return snapshot_delta.change_counts(p2_found(spark, sf_dir))


def p3_found(spark, sf_dir):
    return orphan_refs.orphan_links(*(table(spark, sf_dir, t) for t in ("link_records", "dossier_docs", "anchor_def", "shared_docs")))


def p3_counts(spark, sf_dir):
    return orphan_refs.orphan_counts(p3_found(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_counts": p3_counts}


def _path(col: str) -> str:
    """DuckDB: a path in one spelling; three rounds undo up to three ``x/..`` steps."""
    x = f"regexp_replace(regexp_replace(lower(trim({col})), '[/\\\\]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
    for _ in range(3):
        x = f"regexp_replace({x}, '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
    return f"nullif(regexp_replace({x}, '^/|/$', '', 'g'), '')"


def _anchor(col: str) -> str:
    return f"nullif(regexp_replace(lower({col}), '[\\s#]+', '', 'g'), '')"


def _squeezed(col: str) -> str:
    return f"regexp_replace(lower({col}), '\\s+', '', 'g')"


P2 = f"""
WITH s AS (
  SELECT dossier_id, lpad(CAST(CAST(coalesce(nullif(regexp_extract(sequence_number, '([0-9]+)\\s*$', 1), ''), '0') AS BIGINT) AS VARCHAR), 4, '0') AS seq,
         snapshot_id, delivered_at FROM snapshots),
c AS (SELECT dossier_id, seq, arg_max(snapshot_id, (delivered_at, snapshot_id)) AS snapshot_id FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY dossier_id ORDER BY seq) AS ord FROM c),
l AS (
  SELECT DISTINCT o.dossier_id, o.ord, e.leaf.leaf_id AS leaf_id, {_path('e.leaf.relative_path')} AS p, {_squeezed('e.leaf.module')} AS m,
         {_squeezed('e.leaf.checksum')} AS k, {_squeezed('e.leaf.title')} AS t
  FROM timeline_entries e JOIN o USING (snapshot_id) WHERE coalesce(lower(trim(e.leaf.operation)), '') <> 'delete'),
d AS (
  SELECT coalesce(a.dossier_id, b.dossier_id) AS dossier_id, coalesce(a.ord, b.ord + 1) AS ord, coalesce(a.leaf_id, b.leaf_id) AS leaf_id,
         CASE WHEN b.leaf_id IS NULL THEN 'added' WHEN a.leaf_id IS NULL THEN 'removed'
              WHEN a.p <> b.p OR a.m <> b.m OR a.k <> b.k OR a.t <> b.t THEN 'changed' END AS change_kind
  FROM l a FULL JOIN l b ON a.dossier_id = b.dossier_id AND a.leaf_id = b.leaf_id AND a.ord = b.ord + 1)
SELECT d.dossier_id, o.seq AS sequence_number, d.leaf_id, d.change_kind FROM d JOIN o ON o.dossier_id = d.dossier_id AND o.ord = d.ord
WHERE d.change_kind IS NOT NULL AND d.ord > 1
"""

P3 = f"""
WITH l AS (
  SELECT DISTINCT link_id, coalesce({_path('target_doc')}, CASE WHEN link_kind = 'internal_bookmark' THEN {_path('source_doc')} END) AS doc,
         {_anchor('target_anchor')} AS anchor, validated_at AS v FROM link_records WHERE link_kind <> 'external_url'),
sh AS (SELECT DISTINCT {_path('doc_path')} AS doc, {_anchor('anchor_key')} AS anchor FROM shared_docs),
dd AS (SELECT DISTINCT file_id, {_path('source_path')} AS doc, ingested_at AS f, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS u FROM dossier_docs),
ad AS (SELECT DISTINCT dd.doc, {_anchor('a.anchor_key')} AS anchor, a.defined_at AS f, coalesce(a.removed_at, TIMESTAMP '9999-01-01') AS u
       FROM anchor_def a JOIN (SELECT DISTINCT file_id, doc FROM dd) dd ON dd.file_id = a.doc_id),
m AS (SELECT l.*, EXISTS (SELECT 1 FROM sh WHERE sh.doc = l.doc) AS is_shared FROM l WHERE l.doc IS NOT NULL),
j AS (SELECT m.link_id, m.v, m.anchor, m.doc, count(dd.doc) AS n, count(*) FILTER (dd.f <= m.v) AS began, count(*) FILTER (dd.f <= m.v AND m.v < dd.u) AS alive
      FROM m LEFT JOIN dd ON dd.doc = m.doc WHERE NOT is_shared GROUP BY ALL),
k AS (SELECT j.link_id, j.v, count(ad.doc) AS n, count(*) FILTER (ad.f <= j.v) AS began, count(*) FILTER (ad.f <= j.v AND j.v < ad.u) AS alive
      FROM j LEFT JOIN ad ON ad.doc = j.doc AND ad.anchor = j.anchor WHERE j.alive > 0 AND j.anchor IS NOT NULL GROUP BY ALL),
r AS (
  SELECT link_id, v, 'shared_docs' AS missing_table, 'missing' AS reason FROM m WHERE is_shared AND anchor IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.doc = m.doc AND sh.anchor = m.anchor)
  UNION ALL SELECT link_id, v, 'dossier_docs', CASE WHEN n = 0 THEN 'missing' WHEN began = 0 THEN 'late' ELSE 'deleted' END FROM j WHERE alive = 0
  UNION ALL SELECT link_id, v, 'anchor_def', CASE WHEN n = 0 THEN 'missing' WHEN began = 0 THEN 'late' ELSE 'deleted' END FROM k WHERE alive = 0)
SELECT link_id, missing_table, strftime(v, '%Y-%m') AS period_month, reason FROM r
"""

SQL = {
    "p2_found": P2,
    "p2_counts": f"SELECT dossier_id, sequence_number, change_kind, count(*) AS n FROM ({P2}) GROUP BY ALL",
    "p3_found": P3,
    "p3_counts": f"SELECT missing_table, period_month, reason, count(*) AS n_links FROM ({P3}) GROUP BY ALL",
}
