"""Queries over detected references: one per pattern, the cascade, citations, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.operators import detection as D
from linkloom.plans.derived import DERIVED, derived_units
from linkloom.runtime import table

#: The lines of the documents and the derived lines.
UNITS = f"(SELECT doc_id, line_no, text FROM {DERIVED} UNION ALL SELECT doc_id, CAST(i - 1 AS INT) AS line_no, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE trim(text) <> '')"


def units(spark, sf_dir):
    return D.text_units(table(spark, sf_dir, "documents")).unionByName(derived_units(spark, sf_dir))


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(regex: str) -> tuple[str, int]:
    """A pattern for DuckDB, which lacks look-around: guards become captured neighbours, so the match needs trimming."""
    for bad in ("[A-Z0-9]", r"[\d.]", "[A-Za-z0-9]", "[A-Za-z]"):
        regex = regex.replace(f"(?<!{bad})", "").replace(f"(?!{bad})", "")
    return regex, 0


def span_sql(regex: str, source: str = UNITS, keys: str = "doc_id, line_no") -> str:
    """Spans of a pattern in DuckDB; where the pattern has look-around, neighbours are tested after the match."""
    plain, _ = re2(regex)
    q = sql_str(plain)
    before = next((b for b in ("[A-Z0-9]", r"[\d.]", "[A-Za-z0-9]", "[A-Za-z]") if f"(?<!{b})" in regex), None)
    guard = "" if before is None else (
        f" WHERE NOT regexp_matches(substring(unit, span_start, 1), {sql_str('^' + before + '$')}) AND NOT regexp_matches(substring(unit, span_end + 1, 1), {sql_str('^' + before + '$')})"
    )
    return f"""
SELECT {keys}, span_start, span_end, text FROM (
  SELECT {keys}, unit, m[i] AS text,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS span_start,
         CAST(span_start + length(m[i]) AS INT) AS span_end
  FROM (SELECT {keys}, unit, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT {keys}, text AS unit, regexp_extract_all(text, {q}) AS m, string_split_regex(text, {q}) AS g FROM {source} u WHERE regexp_matches(text, {q})))){guard}"""


def _window_sql(n: int) -> str:
    return f"substring(unit, greatest(span_start - {n}, 0) + 1, span_end + {n} - greatest(span_start - {n}, 0))"


def guarded_sql(p: P.Pattern) -> str:
    core = span_sql(p.regex, keys="doc_id, line_no, unit").replace("text AS unit, regexp_extract_all", "unit, regexp_extract_all").replace("SELECT doc_id, line_no, unit, unit, m", "SELECT doc_id, line_no, unit, m")
    core = core.replace("SELECT doc_id, line_no, unit, unit, ", "SELECT doc_id, line_no, unit, ").replace(f"FROM {UNITS} u", f"FROM (SELECT doc_id, line_no, text, text AS unit FROM {UNITS}) u")
    if p.id == "SECTION_REF_DOTTED_V1":
        cues = " OR ".join(f"contains(lower({_window_sql(28)}), {sql_str(c)})" for c in P.SECTION_CUES)
        # RE2 knows ASCII word bounds only; the pattern's are Unicode's
        edge = r"[^\p{L}\p{N}_]"
        stat = P.STATISTIC.replace(r"\bCI\b", rf"(?:^|{edge})CI(?:$|{edge})").replace(r"\bp\s", rf"(?:^|{edge})p\s").replace(r"\bn\s", rf"(?:^|{edge})n\s").replace(r"\b(?:years", rf"(?:^|{edge})(?:years").replace(r"cells?)\b", rf"cells?)(?:$|{edge})")
        where = f"({cues}) AND NOT regexp_matches({_window_sql(28)}, {sql_str(stat)})"
    elif p.id == "DOC_REF_PROTOCOL_V1":
        nxt = "lower(regexp_extract(substring(unit, span_end + 1), '^[\\s\\-,.:;()]*([A-Za-z'']+)', 1))"
        prev = "lower(regexp_extract(substring(unit, greatest(span_start - 12, 0) + 1, span_start - greatest(span_start - 12, 0)), '([A-Za-z'']+)[\\s\\-]*$', 1))"
        where = f"{nxt} NOT IN ({', '.join(map(sql_str, P.PROTOCOL_NEXT))}) AND {prev} <> 'per'"
    elif p.id in P.ACRONYMS:
        a = P.ACRONYMS[p.id]
        where = f"(lower(text) <> '{P.SPELLED[p.id]}' OR NOT regexp_matches(lower(substring(unit, span_end + 1, {len(a) + 4})), '^\\s*\\(?\\s*{a.lower()}'))"
    else:
        where = "true"
    return f"SELECT doc_id, line_no, span_start, span_end, text FROM ({core}) WHERE {where}"


def _one(p: P.Pattern):
    return lambda spark, sf_dir: D.match_one(units(spark, sf_dir), p.id)


QUERIES, SQL = {}, {}
for _n, _p in enumerate(P.ALL_PATTERNS, 1):
    _name = f"det_{_n:02d}_{_p.id.lower().removesuffix('_v1')}"
    QUERIES[_name] = _one(_p)
    SQL[_name] = guarded_sql(_p)
for _p in P.NER_PATTERNS:
    _name = _p.id.lower().removesuffix("_v1")
    QUERIES[_name] = _one(_p)
    SQL[_name] = span_sql(_p.regex)


def mrg_01_resolved(spark, sf_dir):
    return D.detect(units(spark, sf_dir)).select("doc_id", "line_no", "pattern_id", "span_start", "span_end", "text")


def mrg_02_sorted(spark, sf_dir):
    return D.detect(units(spark, sf_dir), mode="regex", resolve=False).groupBy("doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", (-F.col("confidence")).alias("c"), "pattern_id"))), lambda m: F.concat_ws("@", m["pattern_id"], m["span_start"])), " ").alias("matches"))


def ext_03_layers(spark, sf_dir):
    return D.layer_summary(D.detect(units(spark, sf_dir)))


def agg_09_trace(spark, sf_dir):
    return D.detection_trace(D.detect(units(spark, sf_dir)))


def ref_01_gate(spark, sf_dir):
    return D.refine_gate(D.detect(units(spark, sf_dir))).groupBy("source_layer", "refine").agg(F.count(F.lit(1)).alias("n"))


_TABLE_REF = P.ALL_PATTERNS[7]


def ref_02_context(spark, sf_dir):
    hits = units(spark, sf_dir).where(F.rlike("text", F.lit(_TABLE_REF.regex))).select("doc_id", "line_no", "text", F.explode(D.spans(F.col("text"), _TABLE_REF.regex)).alias("m"))
    return hits.select("doc_id", "line_no", "m.span_start", D.context_window(F.col("text"), F.col("m.span_start"), F.col("m.span_end")).alias("context"))


def ref_02_candidates(spark, sf_dir):
    """The at most six best candidates of each unit, as a refiner gets them: the limit is the operator's."""
    found = D.detect(units(spark, sf_dir), resolve=False).select("doc_id", "line_no", "pattern_id", "confidence", "span_start", F.length("text").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), "span_start", "pattern_id"))), 1, D.MOST_CANDIDATES)
    return found.groupBy("doc_id", "line_no").agg(F.array_join(F.transform(best, lambda m: F.concat_ws("@", m["pattern_id"], m["span_start"])), " ").alias("candidates"))


def ref_03_refined(spark, sf_dir):
    found = D.detect(units(spark, sf_dir), resolve=False).where("confidence < 0.7").select("doc_id", "line_no", "pattern_id", "confidence", "span_start", "text", "source_layer")
    return D.stub_refinement(found, ["doc_id", "line_no"])


CITES = "(SELECT entry_id AS doc_id, 0 AS line_no, concat(split_part(leaf.title, ' ', 1), ' LN, ', regexp_extract(leaf.title, '-([0-9]{4})-', 1), '; see [', CAST(ord AS VARCHAR), ']') AS text FROM (SELECT DISTINCT ON (entry_id) * FROM timeline_entries) WHERE leaf.title IS NOT NULL)"


def cite_units(spark, sf_dir):
    """Derived text: a citation per leaf title."""
    t = table(spark, sf_dir, "timeline_entries").where("leaf.title is not null").groupBy("entry_id").agg(F.min(F.struct("leaf.title", "ord")).alias("r"))
    text = F.concat(F.split("r.title", " ")[0], F.lit(" LN, "), F.regexp_extract("r.title", "-([0-9]{4})-", 1), F.lit("; see ["), F.col("r.ord").cast("string"), F.lit("]"))
    return t.select(F.col("entry_id").alias("doc_id"), F.lit(0).alias("line_no"), text.alias("text"))


def cit_01_author_year(spark, sf_dir):
    return D.author_year(cite_units(spark, sf_dir))


def cit_03_numbered(spark, sf_dir):
    return D.numbered(cite_units(spark, sf_dir))


def cit_06_bibliography(spark, sf_dir):
    return D.bibliography(units(spark, sf_dir))


def cit_08_entry_keys(spark, sf_dir):
    return cite_units(spark, sf_dir).select("doc_id", D.entry_key(F.col("text")).alias("ref_key"))


def _gold(spark, sf_dir):
    rows = table(spark, sf_dir, "refs_dev").groupBy("example_id").agg(F.max(F.struct("text", "entities")).alias("r"))
    return rows.select(F.col("example_id").alias("unit"), "r.text", "r.entities")


def agg_11_span_scores(spark, sf_dir):
    g = _gold(spark, sf_dir)
    found = D.detect(g.select("unit", "text"), mode="regex")
    wanted = g.select("unit", F.explode("entities").alias("e")).select("unit", "e.label", "e.span_start", "e.span_end")
    return D.span_scores(found.select("unit", "label", "span_start", "span_end"), wanted)


def agg_17_label_histogram(spark, sf_dir):
    g = _gold(spark, sf_dir)
    return g.where("size(entities) > 0").select(F.explode("entities").alias("e")).groupBy("e.label").agg(F.count(F.lit(1)).alias("n"))


for _f in (mrg_01_resolved, mrg_02_sorted, ext_03_layers, agg_09_trace, ref_01_gate, ref_02_context, ref_02_candidates, ref_03_refined, cit_01_author_year, cit_03_numbered, cit_06_bibliography, cit_08_entry_keys, agg_11_span_scores, agg_17_label_histogram):
    QUERIES[_f.__name__] = _f

_C = f"SELECT doc_id, line_no, span_start, span_end, regexp_extract(text, {sql_str(D.AUTHOR_YEAR)}, 1) AS surname, regexp_extract(text, {sql_str(D.AUTHOR_YEAR)}, 3) AS year FROM ({span_sql(D.AUTHOR_YEAR, CITES)})"
_C = f"SELECT * FROM ({_C}) WHERE lower(surname) NOT IN ({', '.join(map(sql_str, D.MONTHS))})"
SQL |= {
    "ref_02_context": f"SELECT doc_id, line_no, span_start, trim({_window_sql(80)}) AS context FROM ({guarded_sql(_TABLE_REF).replace('SELECT doc_id, line_no, span_start, span_end, text FROM', 'SELECT doc_id, line_no, span_start, span_end, unit FROM', 1)})",
    "cit_01_author_year": _C,
    "cit_03_numbered": f"SELECT doc_id, line_no, span_start, span_end, CAST(regexp_extract(text, '\\d+') AS INT) AS num FROM ({span_sql(D.NUMBERED, CITES)})",
    "cit_06_bibliography": f"WITH u AS {UNITS}, h AS (SELECT doc_id, min(line_no) AS first_line FROM u WHERE length(text) <= 40 AND regexp_matches(text, {sql_str(D.REFERENCES_HEAD)}) GROUP BY 1) SELECT u.doc_id, first_line, coalesce(min(CASE WHEN line_no > first_line AND length(text) <= 60 AND regexp_matches(text, {sql_str(D.NEXT_HEAD)}) THEN line_no END), max(line_no) + 1) AS end_line FROM u JOIN h USING (doc_id) GROUP BY ALL",
    "cit_08_entry_keys": f"SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*([A-Z][A-Za-z''’\\-]+)') AND regexp_matches(text, '\\b((?:19|20)\\d{{2}})\\b') THEN concat('ref_', regexp_replace(lower(regexp_extract(text, '^\\s*([A-Z][A-Za-z''’\\-]+)', 1)), '[^a-z]', '', 'g'), '_', regexp_extract(text, '\\b((?:19|20)\\d{{2}})\\b', 1)) END AS ref_key FROM {CITES}",
    "agg_17_label_histogram": "SELECT label, count(*) AS n FROM (SELECT unnest(entities).label AS label FROM (SELECT DISTINCT ON (example_id) * FROM refs_dev)) GROUP BY 1",
}


def union_sql(mode: str) -> str:
    """The matches of all patterns of a mode as one relation over the common table ``units``."""
    parts = []
    for p in P.registry(mode):
        one = (guarded_sql(p) if p.layer == "regex" else span_sql(p.regex)).replace(UNITS, "units")
        parts.append(f"SELECT doc_id, line_no, '{p.id}' AS pattern_id, '{p.layer}' AS source_layer, CAST({p.confidence} AS DOUBLE) AS confidence, {p.ordinal} AS ordinal, span_start, span_end, text FROM ({one})")
    return " UNION ALL ".join(parts)


#: Greedy choice per line, match by match in order of confidence, length, start and registry.
RESOLVED = f"""
WITH RECURSIVE units AS MATERIALIZED {UNITS}, matches AS MATERIALIZED ({union_sql("regex+ner")}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY confidence DESC, span_end - span_start DESC, span_start, ordinal) AS k FROM matches),
g AS (
  SELECT doc_id, line_no, CAST(1 AS BIGINT) AS k, [{{'s': span_start, 'e': span_end, 'k': k}}] AS kept FROM ranked WHERE k = 1
  UNION ALL
  SELECT g.doc_id, g.line_no, r.k, CASE WHEN len(list_filter(g.kept, lambda z: z.s < r.span_end AND r.span_start < z.e)) > 0 THEN g.kept ELSE list_append(g.kept, {{'s': r.span_start, 'e': r.span_end, 'k': r.k}}) END
  FROM g JOIN ranked r ON r.doc_id = g.doc_id AND r.line_no = g.line_no AND r.k = g.k + 1),
last AS (SELECT doc_id, line_no, arg_max(kept, k) AS kept FROM g GROUP BY 1, 2),
resolved AS (SELECT r.* FROM (SELECT doc_id, line_no, unnest(kept).k AS k FROM last) x JOIN ranked r USING (doc_id, line_no, k))
"""
_UNION = f"WITH units AS MATERIALIZED {UNITS}, matches AS MATERIALIZED"
_BEST = "row_number() OVER (PARTITION BY doc_id, line_no ORDER BY confidence DESC, length(text) DESC, span_start, pattern_id) AS r"
SQL |= {
    "mrg_01_resolved": RESOLVED + "SELECT doc_id, line_no, pattern_id, span_start, span_end, text FROM resolved",
    "mrg_02_sorted": f"{_UNION} ({union_sql('regex')}) SELECT doc_id, line_no, string_agg(pattern_id || '@' || span_start, ' ' ORDER BY span_start, confidence DESC, pattern_id) AS matches FROM matches GROUP BY 1, 2",
    "ext_03_layers": RESOLVED + "SELECT source_layer, count(*) AS n FROM resolved GROUP BY 1",
    "agg_09_trace": RESOLVED + "SELECT doc_id, count(*) AS total, count(*) FILTER (source_layer = 'regex') AS n_regex, count(*) FILTER (source_layer = 'ner') AS n_ner FROM resolved GROUP BY 1",
    "ref_01_gate": RESOLVED + "SELECT CASE WHEN confidence < 0.7 THEN 'llm' ELSE source_layer END AS source_layer, confidence < 0.7 AS refine, count(*) AS n FROM resolved GROUP BY 1, 2",
    "ref_02_candidates": f"{_UNION} ({union_sql('regex+ner')}) SELECT doc_id, line_no, string_agg(pattern_id || '@' || span_start, ' ' ORDER BY r) AS candidates FROM (SELECT *, {_BEST} FROM matches) WHERE r <= 6 GROUP BY 1, 2",
    "ref_03_refined": f"{_UNION} ({union_sql('regex+ner')}) SELECT doc_id, line_no, pattern_id, round(confidence, 2) AS confidence, span_start, text, 'llm' AS source_layer FROM (SELECT *, {_BEST} FROM matches WHERE confidence < 0.7) WHERE r = 1",
}
