"""Queries over anchors, files, leaves and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions.spelling import anchor_key, path_key
from linkloom.operators import anchors as A
from linkloom.operators import resolution as R
from linkloom.plans.data_quality import _anchor, _path
from linkloom.plans.detection import UNITS, sql_str, units
from linkloom.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ENTITIES = "(SELECT example_id, e.label AS label, e.span_start AS span_start, e.span_end AS span_end, substring(text, e.span_start + 1, e.span_end - e.span_start) AS ref FROM (SELECT example_id, text, unnest(entities) AS e FROM (SELECT DISTINCT ON (example_id) * FROM refs_dev)))"
ENTRIES = "(SELECT DISTINCT ON (entry_id) entry_id, snapshot_id, dossier_id, ord, leaf.leaf_id AS leaf_id, leaf.relative_path AS relative_path, leaf.module AS module, leaf.operation AS operation, leaf.checksum AS checksum, leaf.title AS title FROM timeline_entries)"
LINKS = "(SELECT * FROM link_records QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY loaded_at DESC) = 1)"


def entities(spark, sf_dir):
    rows = table(spark, sf_dir, "refs_dev").groupBy("example_id").agg(F.max(F.struct("text", "entities")).alias("r"))
    return rows.select("example_id", "r.text", F.explode("r.entities").alias("e")).select("example_id", "e.label", "e.span_start", "e.span_end", F.substring("text", F.col("e.span_start") + 1, F.col("e.span_end") - F.col("e.span_start")).alias("ref"))


def entries(spark, sf_dir):
    rows = table(spark, sf_dir, "timeline_entries").groupBy("entry_id").agg(F.max(F.struct("snapshot_id", "dossier_id", "ord", "leaf")).alias("r"))
    return rows.select("entry_id", "r.snapshot_id", "r.dossier_id", "r.ord", "r.leaf.*").drop("checksum_type")


def links(spark, sf_dir):
    """Each link once, as last loaded."""
    rows = table(spark, sf_dir, "link_records")
    rest = [c for c in rows.columns if c not in ("link_id", "loaded_at")]
    return A.first_definitions(rows.withColumn("age", -F.unix_micros(F.col("loaded_at").cast("timestamp"))).drop("loaded_at"), ["link_id"], ["age"]).select("link_id", *rest)


@query(f"SELECT example_id, span_start, concat(lower(label), '_', replace(replace(regexp_extract(ref, '[0-9][0-9.-]*$'), '.', '_'), '-', '_')) AS anchor_key FROM {ENTITIES} WHERE label <> 'STUDY_ID'")
def anc_01_canonical_keys(spark, sf_dir):
    e = entities(spark, sf_dir).where("label <> 'STUDY_ID'")
    return e.select("example_id", "span_start", A.canonical_key(F.col("label"), F.regexp_extract("ref", "[0-9][0-9.-]*$", 0)).alias("anchor_key"))


@query(f"SELECT regexp_matches(text, {sql_str(A.CONTENTS_LINE)}) AS is_contents, count(*) AS n FROM {UNITS} GROUP BY 1")
def anc_03_contents_lines(spark, sf_dir):
    return units(spark, sf_dir).groupBy(A.is_contents_line(F.col("text")).alias("is_contents")).agg(F.count(F.lit(1)).alias("n"))


def _caption_sql(label: str) -> str:
    shape = rf"(?i)^{A.CAPTION_WORDS[label]}\s+({A.CAPTION_NUMBERS.get(label, A.NUMBER)})\b"
    return f"""SELECT doc_id, line_no, 1 AS src_priority, concat('{label.lower()}_', replace(replace(CASE WHEN length(n) = 1 AND regexp_matches(n, '[A-Za-z]') THEN upper(n) ELSE n END, '.', '_'), '-', '_')) AS anchor_key FROM (
  SELECT *, ltrim(substring(l, length(regexp_extract(l, {sql_str(shape)})) + 1)) AS rest FROM (SELECT *, trim(text) AS l, regexp_extract(trim(text), {sql_str(shape)}, 1) AS n FROM {UNITS}))
  WHERE n <> '' AND NOT regexp_matches(l, {sql_str(A.CONTENTS_LINE)})
    AND (rest = '' OR (rest <> '' AND (rest[1] IN (':', '.', '-', '—', chr(9)) OR (regexp_matches(rest, '^\\p{{Lu}}') AND length(l) <= 200))))"""


_HEADING = f"""SELECT doc_id, line_no, 2 AS src_priority, concat('section_ref_', replace(regexp_extract(l, {sql_str(A.HEADING)}, 1), '.', '_')) AS anchor_key FROM (SELECT *, trim(text) AS l, trim(regexp_extract(trim(text), {sql_str(A.HEADING)}, 2)) AS t FROM {UNITS})
  WHERE regexp_matches(l, {sql_str(A.HEADING)}) AND length(l) <= 80 AND NOT regexp_matches(l, {sql_str(A.CONTENTS_LINE)}) AND regexp_matches(t, '^\\p{{Lu}}') AND NOT (regexp_matches(l, '[.?!;,]$') AND t <> upper(t))"""
_DEFS = " UNION ALL ".join([*map(_caption_sql, A.CAPTION_WORDS), _HEADING])


@query(_DEFS)
def anc_04_05_definitions(spark, sf_dir):
    return A.caption_definitions(units(spark, sf_dir))


@query(f"SELECT doc_id, anchor_key, min(src_priority) AS src_priority, CAST(min(src_priority * 1000000 + line_no) % 1000000 AS INT) AS line_no FROM ({_DEFS}) GROUP BY 1, 2")
def anc_07_index_of_texts(spark, sf_dir):
    return A.first_definitions(A.caption_definitions(units(spark, sf_dir)), ["doc_id", "anchor_key"], ["src_priority", "line_no"])


@query(f"SELECT doc_id, a AS anchor, min(src_priority) AS src_priority, CAST(min(src_priority * 1000000 + line_no) % 1000000 AS INT) AS line_no FROM (SELECT *, {_anchor('anchor_key')} AS a FROM anchor_def) GROUP BY 1, 2")
def anc_07_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "anchor_def").select("doc_id", anchor_key(F.col("anchor_key")).alias("anchor"), "src_priority", "line_no")
    return A.first_definitions(d, ["doc_id", "anchor"], ["src_priority", "line_no"])


_NUMBER = r"(?:^|[^\p{L}\p{N}_])(\p{Nd}+(?:\.\p{Nd}+){0,4})(?:$|[^\p{L}\p{N}_])"


@query(f"SELECT doc_id, line_no, regexp_extract(text, {sql_str(_NUMBER)}, 1) AS num FROM {UNITS} WHERE regexp_matches(text, {sql_str(_NUMBER)})")
def anc_06_first_number(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "line_no", A.first_number(F.col("text")).alias("num")).where("num is not null")


@query("SELECT page_id, body_size, chars FROM (SELECT page_id, s AS body_size, CAST(sum(length(text)) AS BIGINT) AS chars, row_number() OVER (PARTITION BY page_id ORDER BY sum(length(text)) DESC, s) AS r FROM (SELECT DISTINCT page_id, word_no, text, CAST(round(y1_px - y0_px) AS INT) AS s FROM ocr_words) GROUP BY page_id, s) WHERE r = 1")
def anc_08_body_size(spark, sf_dir):
    w = table(spark, sf_dir, "ocr_words").select("page_id", "word_no", "text", F.round(F.col("y1_px") - F.col("y0_px")).cast("int").alias("size")).distinct()
    return A.modal_size(w, "page_id", "size", "text")


@query(f"SELECT label, count(*) AS cited, count(k) AS anchored, round(count(k) / count(*), 6) AS share FROM (SELECT DISTINCT {_path('target_doc')} AS doc, {_anchor('target_anchor')} AS anchor, substring({_anchor('target_anchor')}, 1, 3) AS label FROM {LINKS} WHERE {_path('target_doc')} IS NOT NULL AND {_anchor('target_anchor')} IS NOT NULL) c LEFT JOIN (SELECT DISTINCT d.doc, a.anchor, 1 AS k FROM (SELECT doc_id, {_anchor('anchor_key')} AS anchor FROM anchor_def) a JOIN (SELECT DISTINCT file_id, {_path('source_path')} AS doc FROM dossier_docs) d ON d.file_id = a.doc_id) USING (doc, anchor) GROUP BY 1")
def anc_13_coverage(spark, sf_dir):
    cited = links(spark, sf_dir).select(path_key(F.col("target_doc")).alias("doc"), anchor_key(F.col("target_anchor")).alias("anchor")).where("doc is not null and anchor is not null").withColumn("label", F.substring("anchor", 1, 3))
    return A.coverage(cited, defined_anchors(spark, sf_dir), ["doc", "anchor"])


def defined_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "dossier_docs").select(F.col("file_id").alias("doc_id"), path_key(F.col("source_path")).alias("doc")).distinct()
    return table(spark, sf_dir, "anchor_def").select("doc_id", anchor_key(F.col("anchor_key")).alias("anchor")).join(docs, "doc_id").select("doc", "anchor").distinct()


@query("SELECT page_id, word_no, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT DISTINCT page_id, word_no, text FROM ocr_words)")
def par_02_run_offsets(spark, sf_dir):
    return A.run_offsets(table(spark, sf_dir, "ocr_words").select("page_id", "word_no", "text").distinct(), ["page_id"], "word_no", "text")


@query("SELECT page_id, string_agg(text, ' ' ORDER BY word_no) AS text, count(*) AS n_words FROM (SELECT DISTINCT page_id, word_no, text FROM ocr_words) GROUP BY 1")
def par_03_page_text(spark, sf_dir):
    w = table(spark, sf_dir, "ocr_words").select("page_id", "word_no", "text").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("page_id").agg(joined.alias("text"), F.count(F.lit(1)).alias("n_words"))


@query("SELECT page_id, CAST(floor(y0_px) AS INT) AS line_y, string_agg(text, ' ' ORDER BY word_no) AS text, CAST(floor(min(x0_px)) AS INT) AS x0, CAST(ceil(max(x1_px)) AS INT) AS x1 FROM (SELECT DISTINCT page_id, word_no, text, x0_px, x1_px, y0_px FROM ocr_words) GROUP BY 1, 2")
def par_17_lines(spark, sf_dir):
    w = table(spark, sf_dir, "ocr_words").select("page_id", "word_no", "text", "x0_px", "x1_px", "y0_px").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("page_id", F.floor("y0_px").cast("int").alias("line_y")).agg(joined.alias("text"), F.floor(F.min("x0_px")).cast("int").alias("x0"), F.ceil(F.max("x1_px")).cast("int").alias("x1"))


@query("SELECT entry_id, CASE WHEN m = '' THEN 'unknown' WHEN contains(n, '-') THEN concat('m', replace(n, '-', '.')) ELSE m END AS module_label FROM (SELECT entry_id, regexp_extract(f, '^(m\\d)(?:/|$)', 1) AS m, regexp_extract(f, '^m\\d/(\\d+(?:-\\d+)*)(?:-|/|$)', 1) AS n FROM (SELECT entry_id, lower(regexp_replace(replace(relative_path, '\\', '/'), '^[./]+', '')) AS f FROM " + ENTRIES + "))")
def par_11_module_labels(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", R.module_of_path(F.col("relative_path")).alias("module_label"))


_CHAIN = "(SELECT module, array_to_string((string_split(module, '.'))[1:i], '.') AS ancestor, CAST(i AS INT) AS depth FROM (SELECT DISTINCT lower(module) AS module FROM " + ENTRIES + " WHERE module IS NOT NULL), range(1, 10) r(i) WHERE i <= len(string_split(module, '.')) AND regexp_matches(module, '^m\\d+(\\.\\d+)*$'))"


@query(f"SELECT * FROM {_CHAIN}")
def par_12_module_chain(spark, sf_dir):
    m = entries(spark, sf_dir).where("module is not null").select(F.lower("module").alias("module")).distinct()
    return m.select("module", F.posexplode(R.module_chain(F.col("module"))).alias("p", "ancestor")).select("module", "ancestor", (F.col("p") + 1).alias("depth"))


@query("SELECT doc_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM " + UNITS + " GROUP BY 1")
def par_13_counts(spark, sf_dir):
    return units(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(f"SELECT example_id, span_start, CASE WHEN label = 'STUDY_ID' THEN concat('study_', replace(ref, '-', '_')) ELSE concat(lower(label), '_', replace(replace(regexp_extract(ref, '[0-9][0-9.-]*$'), '.', '_'), '-', '_')) END AS target, 'internal_bookmark' AS kind FROM {ENTITIES}")
def res_01_targets(spark, sf_dir):
    e = entities(spark, sf_dir)
    t = R.target_of(F.lit(""), F.col("label"), F.col("ref"), F.create_map(F.lit("num"), F.regexp_extract("ref", "[0-9][0-9.-]*$", 0)))
    return e.select("example_id", "span_start", t.alias("t")).select("example_id", "span_start", "t.target", "t.kind")


@query(f"SELECT link_id, regexp_replace(lower(link_text), '[^a-z0-9]', '', 'g') AS norm FROM {LINKS}")
def res_02_normal(spark, sf_dir):
    return links(spark, sf_dir).select("link_id", R.normal(F.col("link_text")).alias("norm"))


_STEM = "regexp_replace(regexp_extract(source_path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')"
_INDEX = f"""SELECT source_path, stem, nstem, regexp_extract(nstem, '\\d{{4}}\\d{{2,3}}') AS study_key,
  CASE WHEN regexp_matches(nstem, 'nct\\d{{8}}') THEN regexp_extract(nstem, 'nct\\d{{8}}') WHEN regexp_matches(c, '[a-z]{{2,5}}\\d{{4}}\\d{{3,4}}') THEN regexp_extract(c, '[a-z]{{2,5}}\\d{{4}}\\d{{3,4}}')
       ELSE coalesce(list_reverse_sort(list_transform(regexp_extract_all(c, '\\d{{4,}}'), lambda x: lpad(CAST(length(x) AS VARCHAR), 4, '0') || x))[1][5:], '') END AS study_key_v2,
  CASE {' '.join(f"WHEN contains(nstem, '{t}') THEN '{t}'" for t in R.DOC_TYPES)} WHEN contains(nstem, 'analysisplan') THEN 'sap' WHEN contains(nstem, 'clinicalstudyreport') THEN 'csr' ELSE 'other' END AS doc_type,
  (contains(nstem, 'csr') OR contains(nstem, 'body')) AND NOT contains(nstem, 'protocol') AS is_csr_body
FROM (SELECT *, regexp_replace(nstem, {sql_str(R.STUDY_NOISE)}, '', 'g') AS c FROM (SELECT source_path, {_STEM} AS stem, regexp_replace(lower({_STEM}), '[^a-z0-9]', '', 'g') AS nstem FROM (SELECT DISTINCT {_path('source_path')} AS source_path FROM dossier_docs)))"""


@query(_INDEX)
def res_06_file_index(spark, sf_dir):
    return R.file_index(table(spark, sf_dir, "dossier_docs").select(path_key(F.col("source_path")).alias("source_path")).distinct())


@query("SELECT link_text, CASE WHEN contains(t, 'protocol') THEN 'protocol' " + " ".join(f"WHEN contains(t, '{w}') OR regexp_matches(t, '\\b{k}\\b') THEN '{k}'" for w, k in R.SPELLED_TYPES) + " ELSE '' END AS doc_type FROM (SELECT DISTINCT link_text, lower(link_text) AS t FROM link_records)")
def res_05_text_types(spark, sf_dir):
    return table(spark, sf_dir, "link_records").select("link_text").distinct().select("link_text", R.doc_type_of_text(F.col("link_text")).alias("doc_type"))


_SIB = f"""SELECT file_id, CASE WHEN n = 1 THEN a WHEN nf = 1 THEN f WHEN nd = 1 THEN d END AS picked FROM (
  SELECT s.file_id, count(*) AS n, min(c.p) AS a, count(*) FILTER (c.x = s.x) AS nf, min(c.p) FILTER (c.x = s.x) AS f, count(*) FILTER (c.g = s.g) AS nd, min(c.p) FILTER (c.g = s.g) AS d
  FROM k s JOIN k c ON c.dossier_id = s.dossier_id AND c.doc_kind = s.doc_kind AND c.p <> s.p GROUP BY 1)"""


@query(f"WITH k AS (SELECT file_id, dossier_id, doc_kind, p, lower(regexp_extract(p, '\\.([^.]*)$', 1)) AS x, regexp_extract(p, '^(.*)/', 1) AS g FROM (SELECT DISTINCT file_id, dossier_id, doc_kind, {_path('source_path')} AS p FROM dossier_docs WHERE doc_kind IS NOT NULL)) {_SIB}")
def res_08_siblings(spark, sf_dir):
    d = table(spark, sf_dir, "dossier_docs").where("doc_kind is not null").select("file_id", "dossier_id", "doc_kind", path_key(F.col("source_path")).alias("p")).distinct()
    group = ["dossier_id", "doc_kind"]
    picked = R.sibling_pick(d.select("file_id", *group, F.col("p").alias("source"), "p"), d.select(*group, F.col("p").alias("candidate"), "p"), "file_id", group, "p")
    # a file without any other of its kind has no row
    others = d.groupBy(*group).agg(F.countDistinct("p").alias("n")).where("n > 1")
    return picked.join(d.join(others, group).select("file_id").distinct(), "file_id")


@query(f"SELECT DISTINCT l.link_text, list_sum(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(f, '[-_]', ' ', 'g'), '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: length(x) >= 3 AND contains(l.n, x)), lambda x: length(x))) AS score, f AS stem FROM (SELECT DISTINCT link_text, regexp_replace(lower(link_text), '[^a-z0-9]', '', 'g') AS n FROM link_records WHERE link_kind <> 'external_url') l, (SELECT DISTINCT regexp_replace(regexp_extract(doc_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS f FROM shared_docs) WHERE score >= 4")
def res_10_token_overlap(spark, sf_dir):
    texts = table(spark, sf_dir, "link_records").where("link_kind <> 'external_url'").select("link_text").distinct().withColumn("n", R.normal(F.col("link_text")))
    stems = table(spark, sf_dir, "shared_docs").select(R.stem(F.col("doc_path")).alias("stem")).distinct()  # a fixed table
    both = texts.join(F.broadcast(stems.withColumn("words", F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace("stem", "[-_]", " "), r"\s+"), R.normal), lambda t: F.length(t) >= 3))).select("stem", F.explode("words").alias("w"))), F.contains("n", F.col("w")))
    return both.select("link_text", "n", "stem").distinct().select("link_text", R.token_overlap(F.col("stem"), F.col("n")).cast("bigint").alias("score"), "stem").where("score >= 4")


@query(f"SELECT link_id, k IS NOT NULL AS has_anchor FROM (SELECT link_id, {_path('target_doc')} AS doc, {_anchor('target_anchor')} AS anchor FROM {LINKS} WHERE link_kind = 'cross_doc') LEFT JOIN (SELECT DISTINCT d.doc, a.anchor, 1 AS k FROM (SELECT doc_id, {_anchor('anchor_key')} AS anchor FROM anchor_def) a JOIN (SELECT DISTINCT file_id, {_path('source_path')} AS doc FROM dossier_docs) d ON d.file_id = a.doc_id) USING (doc, anchor)")
def res_12_subanchors(spark, sf_dir):
    l = links(spark, sf_dir).where("link_kind = 'cross_doc'").select("link_id", path_key(F.col("target_doc")).alias("doc"), anchor_key(F.col("target_anchor")).alias("anchor"))
    known = defined_anchors(spark, sf_dir).withColumn("k", F.lit(True))
    return l.join(known, ["doc", "anchor"], "left").select("link_id", F.col("k").isNotNull().alias("has_anchor"))


@query(f"SELECT doc, count(*) AS n_anchors FROM (SELECT DISTINCT d.doc, a.anchor FROM (SELECT doc_id, {_anchor('anchor_key')} AS anchor FROM anchor_def) a JOIN (SELECT DISTINCT file_id, {_path('source_path')} AS doc FROM dossier_docs) d ON d.file_id = a.doc_id SEMI JOIN (SELECT {_path('target_doc')} AS doc, {_anchor('target_anchor')} AS anchor FROM link_records) l ON l.doc = d.doc AND l.anchor = a.anchor) GROUP BY 1")
def res_13_incoming_anchors(spark, sf_dir):
    wanted = table(spark, sf_dir, "link_records").select(path_key(F.col("target_doc")).alias("doc"), anchor_key(F.col("target_anchor")).alias("anchor"))
    return defined_anchors(spark, sf_dir).join(wanted, ["doc", "anchor"], "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n_anchors"))


@query(f"SELECT link_id FROM (SELECT link_id, {_path('target_doc')} AS doc FROM {LINKS} WHERE link_kind IN ('cross_doc', 'cross_module')) l WHERE doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dossier_docs d WHERE {_path('d.source_path')} = l.doc) AND NOT EXISTS (SELECT 1 FROM shared_docs s WHERE {_path('s.doc_path')} = l.doc)")
def res_15_unresolved(spark, sf_dir):
    l = links(spark, sf_dir).where("link_kind in ('cross_doc', 'cross_module')").select("link_id", path_key(F.col("target_doc")).alias("doc")).where("doc is not null")
    known = table(spark, sf_dir, "dossier_docs").select(path_key(F.col("source_path")).alias("doc")).unionByName(table(spark, sf_dir, "shared_docs").select(path_key(F.col("doc_path")).alias("doc"))).distinct()
    return l.join(known, "doc", "left_anti").select("link_id")


_LEAVES = f"(SELECT leaf_id, arg_min_null(lower(module), entry_id) AS module, arg_min_null(title, entry_id) AS title, arg_min_null(relative_path, entry_id) AS path, min(entry_id) AS ord FROM {ENTRIES} GROUP BY 1)"


def leaves(spark, sf_dir):
    """Each leaf once, as first listed."""
    e = entries(spark, sf_dir).select("leaf_id", "entry_id", F.lower("module").alias("module"), "title", F.col("relative_path").alias("path"))
    return e.groupBy("leaf_id").agg(*[F.min_by(c, "entry_id").alias(c) for c in ("module", "title", "path")], F.min("entry_id").alias("ord"))


def references(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), F.concat("module", F.lit(".1")).alias("module"), "study_id")


@query(f"""WITH l AS {_LEAVES}, f AS (SELECT module AS known, arg_min(leaf_id, ord) AS leaf_id FROM l WHERE module IS NOT NULL GROUP BY 1), r AS (SELECT doc_id AS ref_id, module || '.1' AS module FROM documents WHERE module IS NOT NULL)
SELECT ref_id, leaf_id, confidence, CASE WHEN e THEN 'module' ELSE 'module_prefix' END AS strategy FROM (
 SELECT r.ref_id, f.leaf_id, f.known = r.module AS e, CAST(CASE WHEN f.known = r.module THEN 0.95 ELSE greatest(0.6, round(0.9 - 0.1 * abs(len(string_split(f.known, '.')) - len(string_split(r.module, '.'))), 6)) END AS DOUBLE) AS confidence,
   row_number() OVER (PARTITION BY r.ref_id ORDER BY f.known = r.module DESC, length(f.known) DESC, f.known DESC) AS k FROM r JOIN f ON starts_with(f.known, r.module) OR starts_with(r.module, f.known)) WHERE k = 1""")
def leaf_01_02_by_module(spark, sf_dir):
    return R.leaf_by_module(references(spark, sf_dir), leaves(spark, sf_dir))


@query(f"WITH l AS {_LEAVES} SELECT doc_id AS ref_id, arg_min(leaf_id, ord) AS leaf_id, 0.92 AS confidence FROM documents d JOIN (SELECT *, upper(concat_ws(' ', title, path, leaf_id)) AS t FROM l) ON contains(t, upper(d.study_id)) GROUP BY 1")
def leaf_03_by_study(spark, sf_dir):
    return R.leaf_by_study(references(spark, sf_dir), leaves(spark, sf_dir))


def leaf_04_by_title(spark, sf_dir):
    """Titles to look up: those of the shared documents, and those of the leaves without their first word."""
    shared = table(spark, sf_dir, "shared_docs").select(F.concat_ws("|", "doc_path", "anchor_key").alias("ref_id"), "title")
    own = entries(spark, sf_dir).where("title is not null").select(F.concat(F.lit("e:"), F.col("entry_id").cast("string")).alias("ref_id"), F.regexp_replace("title", r"^\S+ ", "").alias("title"))
    return R.leaf_by_title(shared.unionByName(own), leaves(spark, sf_dir))


_W = "list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]{2,}'))"
query(f"""WITH l AS {_LEAVES}, q AS (SELECT concat_ws('|', doc_path, anchor_key) AS ref_id, title FROM shared_docs UNION ALL SELECT 'e:' || entry_id, regexp_replace(title, '^\\S+ ', '') FROM {ENTRIES} WHERE title IS NOT NULL), a AS (SELECT list_sort({_W}) AS t, list(ref_id) AS ids FROM q GROUP BY 1), b AS (SELECT list_sort({_W}) AS t, arg_min(leaf_id, ord) AS leaf_id, min(ord) AS ord FROM l WHERE title IS NOT NULL GROUP BY 1)
SELECT unnest(ids) AS ref_id, leaf_id, round(s, 6) AS confidence FROM (SELECT a.ids, leaf_id, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS s, row_number() OVER (PARTITION BY a.t ORDER BY s DESC, ord) AS k FROM a, b) WHERE k = 1 AND s >= 0.55""")(leaf_04_by_title)


@query(None)
def xrf_04_relative_uris(spark, sf_dir):
    l = links(spark, sf_dir).where("link_kind in ('cross_doc', 'cross_module')").select("link_id", path_key(F.col("source_doc")).alias("s"), path_key(F.col("target_doc")).alias("t"), anchor_key(F.col("target_anchor")).alias("a")).where("t is not null")
    return l.select("link_id", R.relative_uri(F.col("s"), F.col("t"), F.col("a")).alias("uri"))


@query(f"SELECT example_id, span_start, CASE WHEN label = 'STUDY_ID' THEN concat('study_', replace(ref, '-', '_')) ELSE concat(lower(string_split(label, '_')[1]), '_', replace(replace(replace(regexp_extract(ref, '[0-9][0-9.-]*$'), '.', '_'), '-', '_'), ' ', '_')) END AS slug FROM {ENTITIES}")
def xrf_05_slugs(spark, sf_dir):
    e = entities(spark, sf_dir)
    num = F.translate(F.regexp_extract("ref", "[0-9][0-9.-]*$", 0), ".- ", "___")
    slug = F.when(F.col("label") == "STUDY_ID", F.concat(F.lit("study_"), F.translate("ref", "-", "_"))).otherwise(F.concat_ws("_", F.lower(F.split("label", "_")[0]), num))
    return e.select("example_id", "span_start", slug.alias("slug"))


_RUNS = "(SELECT example_id, CAST(i AS INT) AS run, w[i] AS text, CAST(coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0) AS INT) AS run_start FROM (SELECT example_id, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM (SELECT DISTINCT ON (example_id) * FROM refs_dev)))"


def runs(spark, sf_dir):
    rows = table(spark, sf_dir, "refs_dev").groupBy("example_id").agg(F.max("text").alias("text"))
    words = rows.select("example_id", F.posexplode(F.split("text", " ")).alias("p", "text")).select("example_id", (F.col("p") + 1).alias("run"), "text")
    return A.run_offsets(words, ["example_id"], "run", "text").select("example_id", "run", "text", F.col("offset").cast("int").alias("run_start"), (F.col("offset") + F.length("text")).cast("int").alias("run_end"))


@query(f"SELECT example_id, span_start, span_end, min(run) AS run, greatest(span_start, arg_min(run_start, run)) AS clip_start, least(span_end, CAST(arg_min(run_start + length(text), run) AS INT)) AS clip_end FROM {ENTITIES} e JOIN {_RUNS} r USING (example_id) WHERE run_start + length(text) > span_start AND run_start < span_end GROUP BY 1, 2, 3")
def doc_03_span_runs(spark, sf_dir):
    return A.overlapping_run(entities(spark, sf_dir).select("example_id", "span_start", "span_end"), runs(spark, sf_dir).drop("text"), "example_id")


@query(f"SELECT example_id, min(run) AS first_run, max(run) AS last_run, string_agg(text, ' ' ORDER BY run) AS text FROM (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY example_id ORDER BY run) AS g FROM (SELECT *, regexp_matches(text, '[0-9]') AS f FROM {_RUNS})) WHERE f GROUP BY example_id, g")
def doc_06_islands(spark, sf_dir):
    return A.islands(runs(spark, sf_dir).withColumn("flag", F.rlike("text", F.lit("[0-9]"))), "example_id", "run", "flag", "text")
