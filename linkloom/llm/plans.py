"""Queries p1 and p4 to p8."""

from __future__ import annotations

from linkloom.llm import components, encoding, mixing, overlaps, packing, scans
from linkloom.plans.data_quality import _path
from linkloom.runtime import table


def _capacity(spark, sf_dir) -> int:
    return table(spark, sf_dir, "containers").agg({"capacity_tokens": "max"}).first()[0]


def p1_found(spark, sf_dir):
    return components.linked_groups(table(spark, sf_dir, "refs_dev")).where("size > 1").select("example_id", "group_id")


def p1_splits(spark, sf_dir):
    return components.linked_splits(table(spark, sf_dir, "refs_dev"), table(spark, sf_dir, "split_targets"))


def p1_report(spark, sf_dir):
    return components.split_report(p1_splits(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p4_found(spark, sf_dir):
    return scans.scan_noise(table(spark, sf_dir, "ocr_pages"))


def p4_paragraphs(spark, sf_dir):
    return scans.scan_paragraphs(table(spark, sf_dir, "ocr_pages"))


def p5_pairs(spark, sf_dir):
    return overlaps.cross_split_pairs(table(spark, sf_dir, "refs_dev"))


def p5_found(spark, sf_dir):
    return p5_pairs(spark, sf_dir).select("id_a", "id_b")


def p5_report(spark, sf_dir):
    return overlaps.overlap_report(p5_pairs(spark, sf_dir), table(spark, sf_dir, "refs_dev"))


def p6_placements(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir))


def p6_found(spark, sf_dir):
    return p6_placements(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


def p6_report(spark, sf_dir):
    return packing.packing_report(p6_placements(spark, sf_dir), _capacity(spark, sf_dir))


def p7_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark, sf_dir):
    return mixing.mix_report(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p7_found(spark, sf_dir):
    return p7_report(spark, sf_dir).where("not reachable").select("source")


def p8_restored(spark, sf_dir):
    return encoding.restore_texts(table(spark, sf_dir, "documents"))


def p8_found(spark, sf_dir):
    return encoding.damaged_chunks(table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_report, p4_found, p4_paragraphs, p5_pairs, p5_found, p5_report, p6_placements, p6_found, p6_report, p7_mix, p7_report, p7_found, p8_restored, p8_found)}

SQL = {
    # examples and what links them (documents, studies) as one graph; every node learns the examples it hangs together with
    "p1_found": f"""
WITH RECURSIVE x AS (SELECT DISTINCT example_id, text, source_doc, entities FROM refs_dev WHERE example_id IS NOT NULL),
k AS MATERIALIZED (
  SELECT DISTINCT example_id, 'd:' || {_path('source_doc')} AS k FROM x WHERE {_path('source_doc')} IS NOT NULL
  UNION SELECT example_id, 's:' || lower(substring(text, e.span_start + 1, e.span_end - e.span_start)) FROM (SELECT example_id, text, unnest(entities) AS e FROM x) WHERE e.label = 'STUDY_ID' AND e.span_end > e.span_start AND text IS NOT NULL),
o AS MATERIALIZED (SELECT k, min(example_id) AS first FROM k GROUP BY 1),
e AS MATERIALIZED (SELECT DISTINCT o.first AS a, k.example_id AS b FROM k JOIN o USING (k)),
adj AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM adj UNION SELECT adj.b, r.root FROM r JOIN adj ON adj.a = r.node),
g AS (SELECT node, min(root) AS group_id, count(*) AS n FROM r GROUP BY 1)
SELECT node AS example_id, group_id FROM g WHERE n > 1""",
    # no text is near the capacity, whatever the tokenizer: here a token is taken as four characters
    "p6_found": "SELECT doc_id FROM documents, (SELECT max(capacity_tokens) AS c FROM containers) WHERE length(text) > 4 * c",
    # no source is near the bound, whether sizes are tokens or characters
    "p7_found": """
WITH d AS (SELECT lower(trim(source)) AS k, sum(length(text)) AS n FROM documents WHERE source IS NOT NULL AND trim(source) <> '' AND text IS NOT NULL GROUP BY 1)
SELECT t.source FROM mix_targets t LEFT JOIN d ON d.k = lower(trim(t.source)), (SELECT sum(n) AS a FROM d)
WHERE t.max_repeats * coalesce(d.n, 0) < t.target_share * a""",
}
