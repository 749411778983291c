"""Queries over the passes after detection: groups, targets, compounds, citations, anchor index, leaves of references."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.operators import anchors as A
from linkloom.operators import detection as D
from linkloom.operators import resolution as R
from linkloom.plans.detection import UNITS, guarded_sql, re2, span_sql, sql_str, units
from linkloom.plans.structure import _LEAVES, leaves, links, references
from linkloom.plans.structure import SQL as STRUCTURE_SQL
from linkloom.runtime import cut, table

QUERIES, SQL = {}, {}
WITH = f"WITH RECURSIVE units AS MATERIALIZED {UNITS}"
CAPTIONS = ["TABLE_REF_NUMBERED_V1", "FIGURE_REF_NUMBERED_V1", "FIGURE_REF_LETTER_V1", "LISTING_REF_NUMBERED_V1", "APPENDIX_REF_NUMBERED_V1", "APPENDIX_REF_LETTER_V1"]
EVERY = [p.id for p in P.ALL_PATTERNS]
BY_ID = {p.id: p for p in P.ALL_PATTERNS}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _matches(ids: list[str], source: str = "units") -> str:
    """Guarded matches of patterns with the text of their line (DuckDB)."""
    return " UNION ALL ".join(f"SELECT doc_id, line_no, '{i}' AS pattern_id, '{BY_ID[i].label}' AS label, span_start, span_end, text AS m FROM ({guarded_sql(BY_ID[i]).replace(UNITS, source)})" for i in ids)


def _group(pattern_id: str, name: str, of: str = "m") -> str:
    return f"regexp_extract({of}, {sql_str(re2(BY_ID[pattern_id].regex)[0])}, {P.GROUP_NAMES[pattern_id].index(name) + 1})"


_GROUPS = " UNION ALL ".join(f"SELECT doc_id, line_no, span_start, pattern_id, '{n}' AS name, {_group(i, n)} AS value FROM m WHERE pattern_id = '{i}'" for i, ns in P.GROUP_NAMES.items() for n in ns)


@query(f"{WITH}, m AS MATERIALIZED ({_matches(list(P.GROUP_NAMES))}) SELECT * FROM ({_GROUPS}) WHERE value <> ''")
def doc_01_groups(spark, sf_dir):
    """The named groups of every match; absent ones have no row."""
    m = D.matches_of(units(spark, sf_dir), list(P.GROUP_NAMES))
    return m.select("doc_id", "line_no", "span_start", "pattern_id", F.explode("groups").alias("name", "value"))


_TARGET = (
    "CASE WHEN label = 'URL' THEN m WHEN pattern_id = 'EXT_REF_DOI_V1' THEN 'https://doi.org/' || m WHEN pattern_id = 'EXT_REF_HELSINKI_V1' THEN 'https://www.wma.net/policies-post/wma-declaration-of-helsinki/'"
    " WHEN pattern_id = 'EXT_REF_ICH_V1' THEN 'https://www.ich.org/page/ich-guidelines'"
    f" WHEN pattern_id = 'EXT_REF_CFR_V1' THEN 'https://www.ecfr.gov/current/title-' || coalesce(nullif({_group('EXT_REF_CFR_V1', 'title')}, ''), '21') || '/part-' || {_group('EXT_REF_CFR_V1', 'part')}"
    " WHEN label = 'DOC_REF' THEN 'doc_ref' WHEN label = 'DOC_ID' THEN 'doc_id' WHEN pattern_id = 'STUDY_ID_NCT_V1' THEN 'https://clinicaltrials.gov/study/' || m WHEN label = 'STUDY_ID' THEN 'study_' || replace(m, '-', '_')"
    f" WHEN label = 'VISIT_REF' THEN 'visit_ref_' || lower({_group('VISIT_REF_V1', 'unit')}) || '_' || {_group('VISIT_REF_V1', 'n')}"
    f" WHEN pattern_id = 'CTD_LEAF_PATH_V1' THEN 'm' || m[2:2] || '_' || replace(replace(m[4:], '.', '_'), '/', '_')"
    " WHEN pattern_id = 'CTD_LEAF_MODULE_V1' THEN rtrim('m' || regexp_extract(m, '([1-5])', 1) || '_' || replace(regexp_extract(m, '[1-5]\\.(.*)$', 1), '.', '_'), '_')"
    " ELSE lower(label) || '_' || replace(replace(regexp_extract(m, '([0-9][0-9.-]*|[A-Z])$', 1), '.', '_'), '-', '_') END"
)


@query(f"{WITH}, m AS MATERIALIZED ({_matches(EVERY)}) SELECT doc_id, line_no, span_start, pattern_id, {_TARGET} AS target, CASE WHEN {_TARGET} LIKE 'http%' THEN 'external_url' ELSE 'internal_bookmark' END AS kind FROM m")
def res_01_all_labels(spark, sf_dir):
    m = D.matches_of(units(spark, sf_dir), EVERY)
    t = R.target_of(F.col("pattern_id"), F.col("label"), F.col("match"), F.col("groups"))
    return m.select("doc_id", "line_no", "span_start", "pattern_id", t.alias("t")).select("doc_id", "line_no", "span_start", "pattern_id", "t.target", "t.kind")


# compounds

_PLAIN = D.COMPOUND.replace("(?<![A-Za-z])", "")
_C0 = span_sql(_PLAIN, "(SELECT doc_id, line_no, text, text AS whole FROM units)", "doc_id, line_no, whole")
_PART = lambda i: f"trim(regexp_extract(text, {sql_str(_PLAIN)}, {i}))"
COMPOUNDS = f"""SELECT doc_id, line_no, span_start, span_end, text, CASE WHEN h = 'study id' THEN 'DOC_ID' ELSE 'DOC_REF' END AS label,
  CASE WHEN h <> 'study id' THEN CASE h {' '.join(f"WHEN '{n}' THEN '{P.ACRONYMS[i].lower()}'" for i, n in P.SPELLED.items())} ELSE h END END AS doc_type, nullif(i, '') AS id_token,
  CASE WHEN s <> '' THEN CASE WHEN lower(s) LIKE 'sect%' THEN 'section' ELSE lower(regexp_extract(s, '^[A-Za-z]+')) END || '_ref_' || replace(replace(regexp_extract(s, '[0-9][0-9.-]*$'), '.', '_'), '-', '_') END AS anchor_key
FROM (SELECT *, regexp_replace(lower({_PART(1)}), '\\s+', ' ', 'g') AS h, {_PART(2)} AS i, {_PART(3)} AS s FROM ({_C0}) WHERE NOT regexp_matches(substring(whole, span_start, 1), '[A-Za-z]'))
WHERE i <> '' OR (s <> '' AND h <> 'study id')"""


@query(f"{WITH} {COMPOUNDS}")
def doc_05_compounds(spark, sf_dir):
    return D.compound_references(units(spark, sf_dir))


_PIECES = ["DOC_REF_PROTOCOL_V1", "DOC_REF_SAP_V1", "DOC_REF_CSR_V1", "DOC_ID_V1", "SECTION_REF_LABELED_V1", "TABLE_REF_NUMBERED_V1", "FIGURE_REF_NUMBERED_V1"]


@query(f"""{WITH}, c AS MATERIALIZED ({COMPOUNDS}), m AS MATERIALIZED ({_matches(_PIECES)})
SELECT doc_id, line_no, pattern_id, label, span_start, span_end, m AS text FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND c.line_no = m.line_no AND c.span_start <= m.span_start AND m.span_end <= c.span_end)
UNION ALL SELECT doc_id, line_no, 'COMPOUND_REF_V1', label, span_start, span_end, text FROM c""")
def doc_05_applied(spark, sf_dir):
    u = units(spark, sf_dir)
    found = D.matches_of(u, _PIECES).drop("text").withColumnRenamed("match", "text")
    return D.apply_compounds(found, D.compound_references(u), ["doc_id", "line_no"]).drop("confidence")


_DOCS = list(P.ACRONYMS)


@query(f"""{WITH}, m AS MATERIALIZED ({_matches(_DOCS)}), s AS (SELECT * FROM m WHERE m IN ('SAP', 'CSR', 'ISS', 'ISE'))
SELECT doc_id, line_no, pattern_id, span_start FROM m x WHERE m IN ('SAP', 'CSR', 'ISS', 'ISE') OR NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = x.doc_id AND s.line_no = x.line_no AND s.pattern_id = x.pattern_id AND s.span_start BETWEEN x.span_end AND x.span_end + 8)""")
def doc_04_acronyms(spark, sf_dir):
    found = D.matches_of(units(spark, sf_dir), _DOCS).drop("text").withColumnRenamed("match", "text")
    return D.without_spelled_names(found, ["doc_id", "line_no"]).select("doc_id", "line_no", "pattern_id", "span_start")


_LINKTEXT = "(SELECT link_id AS doc_id, 0 AS line_no, any_value(link_text) AS text FROM link_records WHERE coalesce(trim(target_doc), '') = '' AND link_text IS NOT NULL GROUP BY 1)"


@query(f"WITH units AS MATERIALIZED {_LINKTEXT}, m AS ({_matches(EVERY)}) SELECT doc_id AS link_id, pattern_id, label, m AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(m) DESC, span_start, pattern_id) AS r FROM m) WHERE r = 1")
def doc_08_placeholders(spark, sf_dir):
    """Links without a target are classified by the longest reference in their text; others are left as they are."""
    rows = table(spark, sf_dir, "link_records").where("coalesce(trim(target_doc), '') = '' and link_text is not null").groupBy("link_id").agg(F.min("link_text").alias("text"))
    found = D.matches_of(rows, EVERY).withColumn("n", -F.length("match"))
    best = found.groupBy("link_id").agg(F.min(F.struct("n", "span_start", "pattern_id", "label", "match")).alias("b"))
    return best.select("link_id", "b.pattern_id", "b.label", F.col("b.match").alias("text"))


# citations

_AY = D.AUTHOR_YEAR
CITES = f"(SELECT doc_id, line_no, span_start, span_end, regexp_extract(text, {sql_str(_AY)}, 1) AS surname, regexp_extract(text, {sql_str(_AY)}, 3) AS year FROM ({span_sql(_AY, 'units')}) WHERE lower(surname) NOT IN ({', '.join(map(sql_str, D.MONTHS))}))"
RANGES = f"(SELECT u.doc_id, first_line, coalesce(min(CASE WHEN line_no > first_line AND length(text) <= 60 AND regexp_matches(text, {sql_str(D.NEXT_HEAD)}) THEN line_no END), max(line_no) + 1) AS end_line FROM units u JOIN (SELECT doc_id, min(line_no) AS first_line FROM units WHERE length(text) <= 40 AND regexp_matches(text, {sql_str(D.REFERENCES_HEAD)}) GROUP BY 1) h USING (doc_id) GROUP BY ALL)"
_KEY = "CASE WHEN regexp_matches(text, '^\\s*\\d{1,3}[.)]\\s+') THEN 'ref_' || CAST(CAST(regexp_extract(text, '^\\s*(\\d{1,3})[.)]', 1) AS INT) AS VARCHAR) WHEN regexp_matches(text, '^\\s*[A-Z][A-Za-z''’-]+') AND regexp_matches(text, '\\b(?:19|20)\\d\\d\\b') THEN 'ref_' || regexp_replace(lower(regexp_extract(text, '^\\s*([A-Z][A-Za-z''’-]+)', 1)), '[^a-z]', '', 'g') || '_' || regexp_extract(text, '\\b((?:19|20)\\d\\d)\\b', 1) END"
INSIDE = f"(SELECT u.*, r.first_line FROM units u JOIN {RANGES} r ON r.doc_id = u.doc_id AND u.line_no >= r.first_line AND u.line_no < r.end_line)"
ENTRIES = f"(SELECT doc_id, line_no, CASE WHEN line_no = first_line THEN 'ref_heading' ELSE {_KEY} END AS ref_key, text, line_no = first_line AS is_head FROM {INSIDE})"
VOCABULARY = f"(SELECT doc_id, surname, arg_min(year, line_no) AS year, arg_min(ref_key, line_no) AS ref_key FROM (SELECT *, lower(regexp_extract(text, '^\\s*([A-Z][A-Za-z''’-]+)', 1)) AS surname, regexp_extract(text, '\\b((?:19|20)\\d\\d)\\b', 1) AS year FROM {ENTRIES} WHERE NOT is_head AND NOT regexp_matches(text, '^\\s*\\d')) WHERE surname <> '' AND year <> '' AND surname NOT IN ({', '.join(map(sql_str, D.MONTHS))}) GROUP BY 1, 2)"
# every place of every surname, sign by sign
_PLACES = f"""(SELECT u.doc_id, u.line_no, i - 1 AS span_start, v.surname, v.year, v.ref_key, substring(text, i + length(v.surname), 40) AS near,
    list_min(list_filter(range(1, 38), lambda j: substring(near, j, 4) = v.year AND NOT regexp_matches(substring(near, j - 1, 1), '^[A-Za-z0-9_]$') AND NOT regexp_matches(substring(near, j + 4, 1), '^[A-Za-z0-9_]$'))) AS y_at
  FROM units u JOIN v ON v.doc_id = u.doc_id, range(1, 400) r(i)
  WHERE i <= length(text) AND lower(substring(text, i, length(v.surname))) = v.surname AND NOT regexp_matches(substring(text, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), '[A-Za-z''’-]') AND NOT regexp_matches(substring(text, i + length(v.surname), 1), '[A-Za-z]'))"""
HITS = f"(SELECT doc_id, line_no, CAST(span_start AS INT) AS span_start, CAST(span_start + length(surname) + y_at + 3 AS INT) AS span_end, surname, year, ref_key FROM {_PLACES} WHERE y_at IS NOT NULL)"
VOCAB = f"{WITH}, v AS MATERIALIZED {VOCABULARY}, h0 AS MATERIALIZED {HITS}, h AS (SELECT * FROM h0 x WHERE NOT EXISTS (SELECT 1 FROM h0 y WHERE y.doc_id = x.doc_id AND y.line_no = x.line_no AND y.span_start < x.span_end AND x.span_start < y.span_end AND (y.span_start < x.span_start OR (y.span_start = x.span_start AND y.span_end > x.span_end))))"


def _units(spark, sf_dir):
    """The lines as a table, for passes that read them several times."""
    return cut(units(spark, sf_dir))


def _entries(u):
    return A.bibliography_entries(u, D.bibliography(u), D.entry_key)


def _vocabulary(u):
    inside = u.join(D.bibliography(u), "doc_id").where("line_no > first_line and line_no < end_line")
    return D.reference_vocabulary(inside.select("doc_id", "line_no", "text"))


@query(f"{WITH} SELECT doc_id, surname, year, ref_key FROM {VOCABULARY}")
def cit_04_vocabulary(spark, sf_dir):
    return _vocabulary(_units(spark, sf_dir))


@query(f"{VOCAB} SELECT * FROM h")
def cit_05_vocabulary_hits(spark, sf_dir):
    u = _units(spark, sf_dir)
    return D.vocabulary_hits(_vocabulary(u), u)


@query(f"{VOCAB}, c AS {CITES} SELECT doc_id, line_no, span_start, span_end, surname, year, 'regex' AS layer FROM c UNION ALL SELECT doc_id, line_no, span_start, span_end, surname, year, 'model' FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = h.doc_id AND c.line_no = h.line_no AND c.span_start < h.span_end AND h.span_start < c.span_end)")
def cit_02_merged(spark, sf_dir):
    """The hits of the closed vocabulary stand for a model's."""
    u = _units(spark, sf_dir)
    return D.merged_citations(D.author_year(u), D.vocabulary_hits(_vocabulary(u), u))


@query(f"{WITH} SELECT c.* FROM {CITES} c LEFT JOIN {RANGES} r USING (doc_id) WHERE first_line IS NULL OR line_no < first_line OR line_no >= end_line")
def cit_07_outside(spark, sf_dir):
    u = _units(spark, sf_dir)
    return D.outside_bibliography(D.author_year(u), D.bibliography(u))


@query(f"{WITH} SELECT doc_id, line_no, ref_key FROM {ENTRIES} WHERE ref_key IS NOT NULL")
def anc_12_entries(spark, sf_dir):
    return _entries(_units(spark, sf_dir))


# the anchor index

_STYLED = "(SELECT doc_id, line_no, text, trim(text) AS l, CASE WHEN line_no % 11 IN (0, 8) THEN 'Heading 2' WHEN line_no % 13 = 5 THEN 'Title' ELSE 'Normal' END AS style, line_no % 7 = 6 AS bold FROM units)"
_SIGNAL = "(style LIKE 'Heading%' OR style LIKE 'Title%' OR bold)"


def _caption(label: str, bare: str) -> str:
    shape = rf"(?i)^{A.CAPTION_WORDS[label]}\s+({A.CAPTION_NUMBERS.get(label, A.NUMBER)})\b"
    n, rest = f"regexp_extract(l, {sql_str(shape)}, 1)", f"ltrim(substring(l, length(regexp_extract(l, {sql_str(shape)})) + 1))"
    ok = f"({rest} = '' AND {bare}) OR ({rest}[1] IN (':', '.', '-', '—', chr(9)) AND (trim(substring({rest}, 2)) <> '' OR {bare})) OR ({rest} <> '' AND {rest}[1] NOT IN (':', '.', '-', '—', chr(9)) AND regexp_matches({rest}, '^\\p{{Lu}}') AND length(l) <= 200)"
    return f"CASE WHEN {n} <> '' AND NOT regexp_matches(l, {sql_str(A.CONTENTS_LINE)}) AND ({ok}) THEN '{label.lower()}_' || replace(replace(CASE WHEN length({n}) = 1 THEN upper({n}) ELSE {n} END, '.', '_'), '-', '_') END"


_FIRST = "regexp_extract(text, '(?:^|[^\\p{L}\\p{N}_])(\\p{Nd}+(?:\\.\\p{Nd}+){0,4})(?:$|[^\\p{L}\\p{N}_])', 1)"
_HEAD = f"regexp_extract(l, {sql_str(A.HEADING)}, 1)"
_T = f"trim(regexp_extract(l, {sql_str(A.HEADING)}, 2))"
_SOURCES = " UNION ALL ".join(
    [f"SELECT doc_id, line_no, 2 AS p, {_caption(k, _SIGNAL)} AS anchor_key FROM s" for k in A.CAPTION_WORDS]
    + [
        f"SELECT doc_id, line_no, 3, CASE WHEN style LIKE 'Heading%' AND {_FIRST} <> '' THEN 'section_ref_' || replace({_FIRST}, '.', '_') END FROM s",
        f"SELECT doc_id, line_no, 4, CASE WHEN {_SIGNAL} AND regexp_matches(l, {sql_str(A.HEADING)}) AND length(l) <= 80 AND NOT regexp_matches(l, {sql_str(A.CONTENTS_LINE)}) AND regexp_matches({_T}, '^\\p{{Lu}}') AND NOT (regexp_matches(l, '[.?!;,]$') AND {_T} <> upper({_T})) THEN 'section_ref_' || replace({_HEAD}, '.', '_') END FROM s",
        "SELECT doc_id, line_no, 5, CASE WHEN (style LIKE 'Heading%' OR style LIKE 'Title%') AND regexp_matches(text, '(?i)\\b(?:Week|Day|Month)\\s+\\d+\\b') THEN 'visit_ref_' || lower(regexp_extract(text, '(?i)\\b(Week|Day|Month)\\s+(\\d+)\\b', 1)) || '_' || regexp_extract(text, '(?i)\\b(Week|Day|Month)\\s+(\\d+)\\b', 2) END FROM s",
        f"SELECT doc_id, line_no, 6, ref_key FROM {ENTRIES}",
        f"SELECT m.doc_id, m.line_no, 1, CASE WHEN k IS NOT NULL THEN lower(label) || '_' || replace(replace(regexp_extract(m, '([0-9][0-9.-]*|[A-Z])$', 1), '.', '_'), '-', '_') END FROM ({_matches(CAPTIONS)}) m JOIN (SELECT doc_id, line_no, unnest([{', '.join(_caption(k, 'false') for k in A.CAPTION_WORDS)}]) AS k FROM s) c ON c.doc_id = m.doc_id AND c.line_no = m.line_no AND starts_with(c.k, lower(m.label))",
    ]
)
INDEX = f"{WITH}, s AS MATERIALIZED {_STYLED}, f AS MATERIALIZED ({_SOURCES}), x AS MATERIALIZED (SELECT doc_id, anchor_key, p AS src_priority, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor_key ORDER BY p, line_no) AS r FROM f WHERE anchor_key IS NOT NULL) WHERE r = 1)"


def _index(u):
    style = F.when((F.col("line_no") % 11).isin(0, 8), "Heading 2").when(F.col("line_no") % 13 == 5, "Title").otherwise("Normal")
    lines = u.select("*", style.alias("style"), (F.col("line_no") % 7 == 6).alias("bold"))
    found = cut(D.matches_of(u, CAPTIONS).select("doc_id", "line_no", "label", "text", F.try_element_at("groups", F.lit("num")).alias("num")))
    return A.first_definitions(A.anchor_sources(lines, found, _entries(u)), ["doc_id", "anchor_key"], ["src_priority", "line_no"])


@query(f"{INDEX} SELECT * FROM x")
def anc_07_six_sources(spark, sf_dir):
    return _index(_units(spark, sf_dir))


@query(f"{INDEX} SELECT doc_id, anchor_key, src_priority, line_no FROM x WHERE anchor_key LIKE 'visit_ref_%'")
def anc_11_visits(spark, sf_dir):
    return _index(_units(spark, sf_dir)).where("anchor_key like 'visit_ref_%'")


@query(f"""{INDEX}, k AS (SELECT DISTINCT doc_id, 'ref_' || lower(surname) || '_' || year AS anchor_key FROM {CITES}), h AS (SELECT doc_id, line_no AS head FROM x WHERE anchor_key = 'ref_heading')
SELECT k.doc_id, k.anchor_key, coalesce(x.line_no, h.head) AS line_no, x.line_no IS NULL AND h.head IS NOT NULL AS fallback FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.anchor_key = k.anchor_key LEFT JOIN h ON h.doc_id = k.doc_id""")
def res_14_fallback(spark, sf_dir):
    u = _units(spark, sf_dir)
    cites = D.author_year(u).select("doc_id", F.concat_ws("_", F.lit("ref"), F.lower("surname"), "year").alias("anchor_key"))
    return A.with_fallback(cites, cut(_index(u)))


# leaves of references

_CTD = ["CTD_LEAF_PATH_V1", "CTD_LEAF_MODULE_V1"]
_MODULE = (
    "CASE WHEN pattern_id = 'CTD_LEAF_PATH_V1' THEN CASE WHEN contains(f, '-') AND length(d) >= 2 THEN 'm' || d[1:1] || '.' || array_to_string(string_split(d[2:], ''), '.') ELSE 'm' || m[2:2] || '.' || f END"
    " ELSE rtrim('m' || regexp_extract(m, '([1-5])', 1) || '.' || regexp_extract(m, '[1-5]\\.(.*)$', 1), '.') END"
)
_REFS = f"(SELECT doc_id || ':' || line_no || ':' || span_start AS ref_id, label, {_MODULE} AS module FROM (SELECT *, split_part(m[4:], '/', 1) AS f, regexp_replace(split_part(m[4:], '/', 1), '[^0-9]', '', 'g') AS d FROM m WHERE label = 'CTD_LEAF') UNION ALL SELECT doc_id || ':' || line_no || ':' || span_start, label, NULL FROM m WHERE label <> 'CTD_LEAF')"
_L = f"l AS MATERIALIZED {_LEAVES}, f AS MATERIALIZED (SELECT module AS known, arg_min(leaf_id, ord) AS leaf_id FROM l WHERE module IS NOT NULL GROUP BY 1)"


def _module_refs(spark, sf_dir):
    m = D.matches_of(units(spark, sf_dir), [*_CTD, "STUDY_ID_NCT_V1"])
    return m.select(F.concat_ws(":", "doc_id", "line_no", "span_start").alias("ref_id"), "label", R.module_of_groups(F.col("groups")).alias("module"))


@query(f"{WITH}, m AS MATERIALIZED ({_matches(_CTD)}) SELECT ref_id, module FROM {_REFS}")
def leaf_06_modules(spark, sf_dir):
    return _module_refs(spark, sf_dir).where("label = 'CTD_LEAF'").select("ref_id", "module")


@query(f"""{WITH}, m AS MATERIALIZED ({_matches([*_CTD, 'STUDY_ID_NCT_V1'])}), {_L}, r AS MATERIALIZED (SELECT *, CASE WHEN label <> 'CTD_LEAF' THEN 'label' WHEN split_part(module, '.', 1) <> 'm5' THEN 'other family' END AS why FROM {_REFS})
SELECT r.ref_id, b.leaf_id, coalesce(why, CASE WHEN b.leaf_id IS NULL THEN 'no leaf' END) AS reason FROM r LEFT JOIN (SELECT ref_id, arg_max(leaf_id, length(known)) AS leaf_id FROM r JOIN f ON starts_with(r.module, f.known) WHERE why IS NULL GROUP BY 1) b USING (ref_id)""")
def xrf_01_in_family(spark, sf_dir):
    return R.in_family(_module_refs(spark, sf_dir), leaves(spark, sf_dir), "m5")


@query(f"WITH c AS (SELECT ref_id, leaf_id, confidence, strategy, 1 AS k FROM ({STRUCTURE_SQL['leaf_01_02_by_module']}) UNION ALL SELECT ref_id, leaf_id, CAST(confidence AS DOUBLE), 'study_id', 2 FROM ({STRUCTURE_SQL['leaf_03_by_study']})), b AS (SELECT ref_id, arg_min({{'l': leaf_id, 'c': confidence, 's': strategy}}, k) AS x FROM c GROUP BY 1) SELECT doc_id AS ref_id, x.l AS leaf_id, x.c AS confidence, x.s AS strategy FROM documents LEFT JOIN b ON b.ref_id = documents.doc_id")
def leaf_05_cascade(spark, sf_dir):
    return R.leaf_cascade(references(spark, sf_dir).withColumn("title", F.lit(None).cast("string")), leaves(spark, sf_dir))


@query()
def res_09_documents(spark, sf_dir):
    """Every link's text resolved to a file of its source's dossier; tested per branch on literal rows."""
    from linkloom.functions.spelling import path_key
    from linkloom.operators.routing import resolve_documents

    docs = table(spark, sf_dir, "dossier_docs").select("dossier_id", path_key(F.col("source_path")).alias("source_path"), "file_id").where("source_path is not null")
    files = docs.groupBy("dossier_id", "source_path").agg(F.min("file_id").alias("ord"))
    of = docs.groupBy("source_path").agg(F.min("dossier_id").alias("dossier_id"))
    label = F.when(F.col("link_kind") == "external_url", "URL").when(F.col("link_kind") == "internal_bookmark", "SECTION_REF").when(F.rlike("link_text", F.lit(r"[A-Z]{3}-\d{4}-\d{3}")), "STUDY_ID").otherwise("DOC_REF")
    l = links(spark, sf_dir).select(F.col("link_id").alias("ref_id"), label.alias("label"), F.lit(None).cast("string").alias("pattern_id"), F.col("link_text").alias("text"), F.col("link_text").alias("context"), path_key(F.col("source_doc")).alias("source_path"))
    return resolve_documents(l.join(of, "source_path").withColumn("qualifier", F.lit(None).cast("string")), files)


@query(f"SELECT link_id, CASE WHEN t = '' THEN '' ELSE t END AS doc_type FROM (SELECT link_id, coalesce(list_max(list_transform(list_filter([{', '.join(f'''{{'p': length(x) - strpos(reverse(x), reverse('{w}')) - {len(w)} + 1, 'k': {-k}, 't': '{t}', 'h': contains(x, '{w}')}}''' for k, (w, t) in enumerate([*R.SPELLED_TYPES, ('protocol', 'protocol'), *((t, t) for t in ('sap', 'csr', 'iss', 'ise'))]))}], lambda z: z.h), lambda z: {{'p': z.p, 'k': z.k, 't': z.t}})).t, '') AS t FROM (SELECT link_id, lower(right(link_text, 48)) AS x FROM (SELECT DISTINCT ON (link_id) * FROM link_records ORDER BY link_id, loaded_at DESC) WHERE link_text IS NOT NULL))")
def res_07_qualifiers(spark, sf_dir):
    """The document type named last in the text before a reference that would follow each link's text."""
    l = links(spark, sf_dir).where("link_text is not null")
    return l.select("link_id", R.qualifier(F.concat("link_text", F.lit("\u0001")), F.lit("\u0001")).alias("doc_type"))
