"""Queries that find the place of a link's anchor, over the derived documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import snippets as N
from linkloom.plans.derived import DERIVED, _line, derived_units
from linkloom.plans.detection import sql_str

QUERIES, SQL = {}, {}
ANCHORS = ["Section 1.{a}", "section_ref_9_{a}", "Table {a}.{b}", "figure_ref_{c}", "{s} LN, {y}", "ref_smithjones_1999", "Declaration of Helsinki", "no such words {n}", "Section {a}.{b}", "Appendix {b}"]

_REQS = "(" + " UNION ALL ".join(f"SELECT doc * 100 + {i} AS req, {_line(t)} AS anchor, -1 - doc AS doc, doc % 2 AS rank FROM (SELECT DISTINCT -1 - doc_id AS doc FROM {DERIVED})" for i, t in enumerate(ANCHORS)) + ")"


def requests(spark, sf_dir):
    """Ten anchors for each derived document, itself the only candidate."""
    docs = derived_units(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc")).distinct()
    each = docs.select("doc", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(_line(t)).alias("anchor")) for i, t in enumerate(ANCHORS)])).alias("x"))
    return each.select((F.col("doc") * 100 + F.col("x.i")).alias("req"), "x.anchor", (-1 - F.col("doc")).alias("doc"), (F.col("doc") % 2).alias("rank"))


def qry_01_snippets(spark, sf_dir):
    ps = derived_units(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("para"), "text")
    return N.find_snippets(ps, requests(spark, sf_dir))


def qry_02_entries(spark, sf_dir):
    ps = derived_units(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("para"), "text")
    r = requests(spark, sf_dir).select("doc", "anchor", N.anchor_facts(F.col("anchor")).alias("f")).select("doc", "anchor", "f.surname", "f.year")
    return N.entry_places(ps, r)


QUERIES = {"qry_01_snippets": qry_01_snippets, "qry_02_entries": qry_02_entries}

_NUM = f"CASE WHEN regexp_matches(anchor, '{N.DOTTED}') THEN regexp_extract(anchor, '{N.DOTTED}') WHEN regexp_matches(lower(anchor), '{N.KEYED}') THEN replace(regexp_extract(lower(anchor), '{N.KEYED}', 1), '_', '.') ELSE regexp_extract(lower(anchor), '{N.TYPED}', 1) END"
_TABLE = "regexp_matches(lower(anchor), 'table|figure|listing|appendix')"
_FACTS = f"""(SELECT *, {_NUM} AS num, {_TABLE} AS t, NOT {_TABLE} AND regexp_matches(lower(anchor), 'section|sect\\.|sec\\.|§') AS s,
  regexp_replace(CASE WHEN regexp_matches(anchor, {sql_str(N.SLUG)}) THEN regexp_extract(anchor, {sql_str(N.SLUG)}, 1) ELSE lower(regexp_extract(anchor, {sql_str(N.HUMAN)}, 1)) END, '[''’-]', '', 'g') AS surname,
  CASE WHEN regexp_matches(anchor, {sql_str(N.SLUG)}) THEN regexp_extract(anchor, {sql_str(N.SLUG)}, 2) ELSE regexp_extract(anchor, {sql_str(N.HUMAN)}, 2) END AS year FROM {_REQS})"""
_PS = f"(SELECT doc_id AS doc, line_no AS para, trim(text) AS text, lead(trim(text)) OVER w AS n1, lead(trim(text), 2) OVER w AS n2 FROM {DERIVED} WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"
_PLAIN = "regexp_replace(lower(text), '[''’-]', '', 'g')"
_WITH = f"""WITH r AS MATERIALIZED {_FACTS}, p AS MATERIALIZED {_PS}, h AS (SELECT doc, min(para) AS head FROM p WHERE regexp_matches(text, {sql_str(N.BIBLIOGRAPHY)}) GROUP BY 1),
e AS (SELECT doc, anchor, coalesce(min(para) FILTER (para > head), max(para)) AS para FROM r JOIN p USING (doc) LEFT JOIN h USING (doc) WHERE surname <> '' AND year <> '' AND starts_with({_PLAIN}, surname) AND NOT regexp_matches(substring({_PLAIN}, length(surname) + 1, 1), '[a-z]') AND contains({_PLAIN}, year) GROUP BY 1, 2)"""
_HAS = "(num <> '' AND regexp_matches(text, '(^|[^0-9.])' || replace(num, '.', '[.]') || '($|[^0-9.]|[.]$|[.][^0-9])'))"
_CAP, _SEC = "regexp_matches(lower(text), '^(table|figure|listing|appendix)')", "regexp_matches(lower(text), '^(section|sect\\.|sec\\.|§)')"
SQL = {
    "qry_02_entries": f"{_WITH} SELECT doc, anchor, para FROM e",
    "qry_01_snippets": f"""{_WITH}, m AS (SELECT r.req, r.doc, p.para, CASE WHEN {_HAS} AND NOT s AND ({_CAP} OR {_SEC}) THEN 1 WHEN {_HAS} AND (starts_with(text, num) OR regexp_matches(lower(text), '^(section|sect|sec|§)\\s*' || replace(num, '.', '[.]'))) THEN 2 WHEN {_HAS} AND NOT (s AND {_CAP}) THEN 3 WHEN contains(lower(text), lower(trim(anchor))) THEN 5 ELSE 9 END AS step FROM r JOIN p USING (doc)
 UNION ALL SELECT r.req, r.doc, e.para, 4 FROM r JOIN e USING (doc, anchor) WHERE num = '' AND NOT t AND NOT s),
b AS (SELECT req, arg_min({{'doc': doc, 'para': para, 'step': step}}, (step, para)) AS x FROM m GROUP BY 1)
SELECT req, p.doc, x.step <> 9 AS matched, left(text, 200) AS heading, left(CASE WHEN x.step = 1 THEN text WHEN x.step = 4 THEN coalesce(n1, text) WHEN x.step = 9 THEN concat_ws(' ', n1, n2) ELSE coalesce(nullif(concat_ws(' ', n1, n2), ''), text) END, 400) AS snippet FROM b JOIN p ON p.doc = x.doc AND p.para = x.para""",
}
