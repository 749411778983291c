"""Queries over the graph, sequences, checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions.spelling import anchor_key, path_key
from linkloom.operators import checks as C
from linkloom.operators import graphs as G
from linkloom.operators import reporting as P
from linkloom.operators import sequences as S
from linkloom.plans.data_quality import _anchor, _path
from linkloom.plans.detection import UNITS, units
from linkloom.plans.structure import ENTRIES, LINKS, defined_anchors, entries, leaves, links
from linkloom.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EDGES = f"(SELECT DISTINCT src, dst FROM (SELECT {_path('source_doc')} AS src, {_path('target_doc')} AS dst FROM link_records WHERE link_kind IN ('cross_doc', 'cross_module')) WHERE src IS NOT NULL AND dst IS NOT NULL)"


def edges(spark, sf_dir):
    l = table(spark, sf_dir, "link_records").where("link_kind in ('cross_doc', 'cross_module')")
    return G.reference_edges(l.select(path_key(F.col("source_doc")).alias("src"), path_key(F.col("target_doc")).alias("dst")))


@query(f"SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {EDGES} UNION ALL SELECT dst, 0, 1 FROM {EDGES}) GROUP BY 1")
def gr_05_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query(f"""WITH c AS (SELECT leaf_id, lower(module) AS m FROM {ENTRIES} WHERE regexp_matches(lower(module), '^m\\d+(\\.\\d+)*$')), k AS (SELECT leaf_id, array_to_string(string_split(m, '.')[1:i], '.') AS a, i, len(string_split(m, '.')) AS n FROM c, range(1, 12) r(i) WHERE i <= len(string_split(m, '.')))
SELECT DISTINCT x.a AS parent, y.a AS child FROM k x JOIN k y ON x.leaf_id = y.leaf_id AND y.i = x.i + 1 AND starts_with(y.a, x.a || '.') UNION SELECT a, leaf_id FROM k WHERE i = n""")
def gr_01_module_edges(spark, sf_dir):
    return G.module_edges(entries(spark, sf_dir))


@query(f"SELECT DISTINCT array_to_string(string_split(m, '.')[1:i], '.') AS module, leaf_id FROM (SELECT leaf_id, lower(module) AS m FROM {ENTRIES} WHERE regexp_matches(lower(module), '^m\\d+(\\.\\d+)*$')), range(1, 12) r(i) WHERE i <= len(string_split(m, '.'))")
def gr_04_leaves_under(spark, sf_dir):
    return G.leaves_under(entries(spark, sf_dir))


@query(f"SELECT count(*) AS edges, count(*) FILTER (src = dst) AS self_links, (SELECT count(*) FROM (SELECT src FROM {EDGES} UNION SELECT dst FROM {EDGES})) AS nodes FROM {EDGES}")
def gr_10_stats(spark, sf_dir):
    return G.stats(edges(spark, sf_dir))


TIMELINE = f"(SELECT e.*, s.seq, s.delivered_at, {_path('e.relative_path')} AS path FROM {ENTRIES} e JOIN (SELECT DISTINCT ON (snapshot_id) snapshot_id, delivered_at, lpad(CAST(CAST(coalesce(nullif(regexp_extract(sequence_number, '([0-9]+)\\s*$', 1), ''), '0') AS BIGINT) AS VARCHAR), 4, '0') AS seq FROM snapshots) s USING (snapshot_id))"


def timeline(spark, sf_dir):
    return S.timeline(table(spark, sf_dir, "snapshots"), entries(spark, sf_dir))


def _latest(key: str, other: str) -> str:
    return f"SELECT dossier_id, {key}, seq, {other} FROM (SELECT *, row_number() OVER (PARTITION BY dossier_id, {key} ORDER BY seq DESC, delivered_at DESC, ord DESC, entry_id DESC) AS r FROM {TIMELINE}) WHERE r = 1 AND coalesce(lower(operation), 'new') <> 'delete'"


@query(_latest("path", "leaf_id"))
def seq_02_latest_by_path(spark, sf_dir):
    return S.latest(timeline(spark, sf_dir), ["dossier_id", "path"])


@query(_latest("leaf_id", "path"))
def seq_02_latest_by_leaf(spark, sf_dir):
    return S.latest(timeline(spark, sf_dir), ["dossier_id", "leaf_id"])


@query(f"SELECT dossier_id, study, max(seq) AS seq FROM (SELECT l.dossier_id, l.seq, regexp_extract(t.title, '[A-Z]{{3}}-[0-9]{{4}}-[0-9]{{3}}') AS study FROM ({_latest('leaf_id', 'path')}) l JOIN (SELECT dossier_id, leaf_id, max(title) AS title FROM {TIMELINE} GROUP BY 1, 2) t USING (dossier_id, leaf_id)) WHERE study <> '' GROUP BY 1, 2")
def seq_03_latest_for_study(spark, sf_dir):
    t = timeline(spark, sf_dir)
    titles = t.groupBy("dossier_id", "leaf_id").agg(F.max("title").alias("title"))
    alive = S.latest(t, ["dossier_id", "leaf_id"]).join(titles, ["dossier_id", "leaf_id"])
    return alive.withColumn("study", F.regexp_extract("title", "[A-Z]{3}-[0-9]{4}-[0-9]{3}", 0)).where("study <> ''").groupBy("dossier_id", "study").agg(F.max("seq").alias("seq"))


@query(f"SELECT dossier_id, path, string_agg(seq, ',' ORDER BY seq) AS versions FROM (SELECT DISTINCT dossier_id, path, seq FROM {TIMELINE}) GROUP BY 1, 2")
def seq_04_history(spark, sf_dir):
    return S.history(timeline(spark, sf_dir))


@query(f"SELECT dossier_id, leaf_id, entry_id, x.field AS field, x.before AS before, x.after AS after FROM (SELECT dossier_id, leaf_id, entry_id, unnest([{{'field': 'title', 'before': lt, 'after': title}}, {{'field': 'module', 'before': lm, 'after': module}}]) AS x FROM (SELECT *, lag(title) OVER w AS lt, lag(module) OVER w AS lm, lag(1) OVER w AS s FROM {ENTRIES} WINDOW w AS (PARTITION BY dossier_id, leaf_id ORDER BY entry_id)) WHERE s = 1) WHERE x.before IS DISTINCT FROM x.after")
def inj_04_field_changes(spark, sf_dir):
    return S.field_changes(entries(spark, sf_dir), ["dossier_id", "leaf_id"], "entry_id", ["title", "module"])


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(trim(u), '') = '' OR NOT regexp_matches(lower(u), '^(http|https|ftp|mailto):') OR (NOT starts_with(lower(u), 'mailto:') AND NOT regexp_matches(u, '^[A-Za-z]+://[^/?#]+')) THEN 'broken' ELSE 'unverified' END AS status FROM (SELECT target_doc AS u FROM link_records)) GROUP BY 1")
def val_01_urls(spark, sf_dir):
    return table(spark, sf_dir, "link_records").groupBy(C.url_status(F.col("target_doc")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_KNOWN = f"(SELECT DISTINCT {_path('source_path')} AS doc FROM dossier_docs UNION SELECT {_path('doc_path')} FROM shared_docs)"
_ANCHORS = f"(SELECT DISTINCT d.doc, a.anchor FROM (SELECT doc_id, {_anchor('anchor_key')} AS anchor FROM anchor_def) a JOIN (SELECT DISTINCT file_id, {_path('source_path')} AS doc FROM dossier_docs) d ON d.file_id = a.doc_id UNION SELECT {_path('doc_path')}, {_anchor('anchor_key')} FROM shared_docs)"
_L = f"(SELECT link_id, link_kind, link_text, target_doc AS target, CASE WHEN link_kind = 'internal_bookmark' THEN coalesce({_path('target_doc')}, {_path('source_doc')}) ELSE {_path('target_doc')} END AS doc, {_path('source_doc')} AS source, {_anchor('target_anchor')} AS anchor FROM {LINKS})"


def probes(spark, sf_dir):
    l = links(spark, sf_dir)
    doc = F.when(F.col("link_kind") == "internal_bookmark", F.coalesce(path_key(F.col("target_doc")), path_key(F.col("source_doc")))).otherwise(path_key(F.col("target_doc")))
    return l.select("link_id", "link_kind", "link_text", F.col("target_doc").alias("target"), doc.alias("doc"), path_key(F.col("source_doc")).alias("source"), anchor_key(F.col("target_anchor")).alias("anchor"))


def known_docs(spark, sf_dir):
    return table(spark, sf_dir, "dossier_docs").select(path_key(F.col("source_path")).alias("doc")).unionByName(table(spark, sf_dir, "shared_docs").select(path_key(F.col("doc_path")).alias("doc"))).distinct()


def known_anchors(spark, sf_dir):
    shared = table(spark, sf_dir, "shared_docs").select(path_key(F.col("doc_path")).alias("doc"), anchor_key(F.col("anchor_key")).alias("anchor"))
    return defined_anchors(spark, sf_dir).unionByName(shared).distinct()


_STATUS = f"SELECT l.link_id, CASE WHEN link_kind = 'external_url' THEN 'unverified' WHEN k.doc IS NULL THEN 'broken' WHEN l.anchor IS NOT NULL AND a.anchor IS NULL THEN 'broken' ELSE 'ok' END AS found_status FROM {_L} l LEFT JOIN {_KNOWN} k ON k.doc = l.doc LEFT JOIN {_ANCHORS} a ON a.doc = l.doc AND a.anchor = l.anchor"


@query(f"SELECT link_id, found_status, CAST(CASE WHEN found_status = 'ok' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS found_confidence FROM ({_STATUS})")
def val_03_link_status(spark, sf_dir):
    return C.link_status(probes(spark, sf_dir), known_docs(spark, sf_dir), known_anchors(spark, sf_dir)).select("link_id", "found_status", "found_confidence")


_DEFA = f"(SELECT DISTINCT {_path('doc_path')} AS doc, {_anchor('anchor_key')} AS anchor, min(title) AS title FROM shared_docs GROUP BY 1, 2)"
_TOK = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


@query(f"SELECT link_id, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS similarity FROM (SELECT l.link_id, {_TOK('l.link_text')} AS x, {_TOK('a.title')} AS y FROM {_L} l JOIN {_DEFA} a ON a.doc = l.doc AND a.anchor = l.anchor)")
def val_05_text_similarity(spark, sf_dir):
    t = table(spark, sf_dir, "shared_docs").groupBy(path_key(F.col("doc_path")).alias("doc"), anchor_key(F.col("anchor_key")).alias("anchor")).agg(F.min("title").alias("title"))
    return probes(spark, sf_dir).join(t, ["doc", "anchor"]).select("link_id", F.round(C.text_similarity(F.col("link_text"), F.col("title")), 6).alias("similarity"))


@query("SELECT a.vec_id, CAST(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS DOUBLE) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def val_06_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


@query(f"""SELECT issue, count(*) AS n FROM (SELECT CASE WHEN s.doc IS NULL THEN 'missing_source' WHEN l.doc IS NULL THEN 'missing_target' WHEN l.doc = l.source THEN 'self_reference' WHEN k.doc IS NULL THEN 'missing_file' WHEN l.anchor IS NOT NULL AND a.anchor IS NULL THEN 'missing_anchor' ELSE 'ok' END AS issue
FROM {_L} l LEFT JOIN {_KNOWN} s ON s.doc = l.source LEFT JOIN {_KNOWN} k ON k.doc = l.doc LEFT JOIN {_ANCHORS} a ON a.doc = l.doc AND a.anchor = l.anchor WHERE link_kind = 'cross_module') GROUP BY 1""")
def val_08_integrity(spark, sf_dir):
    docs = known_docs(spark, sf_dir)
    l = probes(spark, sf_dir).where("link_kind = 'cross_module'")
    seen = l.join(docs.select(F.col("doc").alias("source"), F.lit(True).alias("s")), "source", "left").join(docs.withColumn("k", F.lit(True)), "doc", "left").join(known_anchors(spark, sf_dir).withColumn("a", F.lit(True)), ["doc", "anchor"], "left")
    issue = C.integrity_issue(F.col("s").isNotNull(), F.col("doc").isNotNull(), F.col("doc") == F.col("source"), F.col("k").isNotNull(), F.col("anchor").isNull() | F.col("a").isNotNull())
    return seen.groupBy(issue.alias("issue")).agg(F.count(F.lit(1)).alias("n"))


_ID = "[A-Z]{2,5}-[0-9]{4}-[0-9]{3,4}"
# The registry's own examples.
WITHDRAWN = ["SP-2019-001", "PROT-ABC-0001", "NCT00000001"]
_GONE = f"(SELECT DISTINCT regexp_extract(title, '{_ID}') AS id FROM {ENTRIES} WHERE lower(operation) = 'delete' AND regexp_matches(title, '{_ID}') UNION SELECT unnest({WITHDRAWN}))"
# every sign that can't belong to an id becomes two spaces, so that neighbouring ids don't share one
_PADDED = f"(SELECT doc_id, line_no, ' ' || regexp_replace(text, '[^A-Z0-9-]', '  ', 'g') || ' ' AS t FROM {UNITS})"


@query(f"SELECT doc_id, line_no, id, CAST((length(t) - length(replace(t, ' ' || id || ' ', ''))) / (length(id) + 2) AS BIGINT) AS n FROM {_PADDED} JOIN {_GONE} ON contains(t, ' ' || id || ' ')")
def ano_03_withdrawn_ids(spark, sf_dir):
    gone = entries(spark, sf_dir).where("lower(operation) = 'delete' and title is not null").select(F.regexp_extract("title", _ID, 0).alias("id")).where("id <> ''")
    return C.deprecated_ids(units(spark, sf_dir), gone.unionByName(spark.createDataFrame([(i,) for i in WITHDRAWN], "id string")))


_DG = lambda c: f"list_distinct(regexp_extract_all({c}, '\\d+'))"
_OTHER = f"(SELECT *, CASE WHEN link_id % 2 = 0 THEN 'sec:' || link_id % 9 || '.' || link_id % 5 ELSE target_anchor END AS other FROM {LINKS})"


@query(f"SELECT link_id, round(1 - j, 3) AS confidence FROM (SELECT link_id, a, b, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS j FROM (SELECT link_id, {_DG('link_text')} AS a, {_DG('other')} AS b FROM {_OTHER} WHERE status <> 'broken' AND other IS NOT NULL) WHERE len(a) > 0 AND len(b) > 0) WHERE j < 0.5")
def ano_04_suspicious_targets(spark, sf_dir):
    """Every second link gets an anchor made of its number, since the texts and anchors of the table agree."""
    other = F.when(F.col("link_id") % 2 == 0, F.concat_ws("", F.lit("sec:"), F.col("link_id") % 9, F.lit("."), F.col("link_id") % 5)).otherwise(F.col("target_anchor"))
    l = links(spark, sf_dir).where("status <> 'broken'").select("link_id", "link_text", other.alias("other")).where("other is not null")
    return l.select("link_id", C.suspicious_target(F.col("link_text"), F.col("other")).alias("confidence")).where("confidence is not null")


@query(f"SELECT entry_id, concat_ws('; ', CASE WHEN n <> lower(n) THEN 'contains uppercase characters' END, CASE WHEN contains(n, ' ') THEN 'contains spaces' END, CASE WHEN starts_with(n, '_') THEN 'starts with underscore' END, CASE WHEN regexp_matches(n, '[^\\x00-\\x7f]') THEN 'contains non-ASCII characters' END) AS problems FROM (SELECT entry_id, regexp_extract(relative_path, '([^/]*)$', 1) AS n FROM {ENTRIES}) WHERE problems <> ''")
def rul_05_file_names(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", C.file_name_problems(F.col("relative_path")).alias("problems")).where("problems <> ''")


@query()
def rul_07_sjis(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", C.sjis_round_trip("text").alias("round_trips"))


_COUNTS = f"SELECT module, count(*) AS links, count(*) FILTER (status = 'broken') AS broken, count(*) FILTER (status = 'suspicious') AS suspicious, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'ok') AS ok FROM (SELECT regexp_extract({_path('source_doc')}, '^(m[0-9])/', 1) AS module, status FROM {LINKS}) GROUP BY 1"


@query(f"SELECT module, ok, suspicious, unverified, broken, links AS total FROM ({_COUNTS}) UNION ALL SELECT 'TOTAL', sum(ok), sum(suspicious), sum(unverified), sum(broken), sum(links) FROM ({_COUNTS})")
def agg_08_13_module_matrix(spark, sf_dir):
    l = links(spark, sf_dir).withColumn("module", F.regexp_extract(path_key(F.col("source_doc")), "^(m[0-9])/", 1))
    return P.pivot_with_totals(l, "module", "status", ["ok", "suspicious", "unverified", "broken"])


@query(f"SELECT source, link_kind, count(*) AS n, count(*) FILTER (status = 'broken') AS broken FROM (SELECT {_path('source_doc')} AS source, link_kind, status FROM {LINKS}) GROUP BY 1, 2")
def agg_10_kinds_per_document(spark, sf_dir):
    return links(spark, sf_dir).groupBy(path_key(F.col("source_doc")).alias("source"), "link_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "broken").alias("broken"))


@query(f"SELECT tp, round(p, 6) AS precision, round(r, 6) AS recall, CAST(round(2 * round(p, 6) * round(r, 6) / (round(p, 6) + round(r, 6)), 6) AS DOUBLE) AS f1 FROM (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND b) / count(*) FILTER (a) AS p, count(*) FILTER (a AND b) / count(*) FILTER (b) AS r FROM (SELECT status = 'broken' AS a, found_status = 'broken' AS b FROM ({_STATUS}) JOIN {LINKS} USING (link_id)))")
def agg_12_status_scores(spark, sf_dir):
    found = C.link_status(probes(spark, sf_dir), known_docs(spark, sf_dir), known_anchors(spark, sf_dir)).where("found_status = 'broken'").select("link_id")
    return P.set_scores(links(spark, sf_dir).where("status = 'broken'").select("link_id"), found, ["link_id"])


@query(f"SELECT link_id, source_doc, status FROM {LINKS} WHERE status = 'broken' ORDER BY source_doc, link_id LIMIT 50 OFFSET 20")
def agg_14_link_page(spark, sf_dir):
    return P.link_table(links(spark, sf_dir), "broken", offset=20, limit=50).select("link_id", "source_doc", "status")


@query(f"SELECT status, link_kind, detected_by, count(*) AS n FROM {LINKS} GROUP BY CUBE (status, link_kind, detected_by)")
def agg_15_cube(spark, sf_dir):
    return links(spark, sf_dir).cube("status", "link_kind", "detected_by").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src, dst, count(*) AS n_links FROM (SELECT {_path('source_doc')} AS src, {_path('target_doc')} AS dst FROM {LINKS} WHERE link_kind <> 'external_url') WHERE dst IS NOT NULL GROUP BY 1, 2")
def snk_11_document_edges(spark, sf_dir):
    l = links(spark, sf_dir).where("link_kind <> 'external_url'").select(path_key(F.col("source_doc")).alias("src"), path_key(F.col("target_doc")).alias("dst")).where("dst is not null")
    return l.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_links"))


@query("SELECT file_id, version_no, lag(version_no) OVER (PARTITION BY file_id ORDER BY version_no) AS supersedes, deleted_at IS NULL AS is_current FROM (SELECT DISTINCT ON (file_id, version_no) * FROM dossier_docs)")
def snk_13_supersedes(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "dossier_docs").groupBy("file_id", "version_no").agg(F.max("deleted_at").alias("deleted_at"))
    return d.select("file_id", "version_no", F.lag("version_no").over(Window.partitionBy("file_id").orderBy("version_no")).alias("supersedes"), F.col("deleted_at").isNull().alias("is_current"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def str_03_latest_status(spark, sf_dir):
    from linkloom.streaming.status import latest_status

    return latest_status(table(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_ext_windows(spark, sf_dir):
    from linkloom.streaming.status import window_counts

    return window_counts(table(spark, sf_dir, "events"), "1 hour")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL")
def src_02_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query("SELECT snapshot_id, CASE WHEN regexp_extract(sequence_number, '([0-9]{4})\\s*$', 1) <> '' THEN regexp_extract(sequence_number, '([0-9]{4})\\s*$', 1) ELSE sequence_number END AS sequence, coalesce(region, 'unknown') AS region FROM (SELECT DISTINCT ON (snapshot_id) * FROM snapshots)")
def src_11_12_snapshot_facts(spark, sf_dir):
    s = table(spark, sf_dir, "snapshots").dropDuplicates(["snapshot_id"])
    tail = F.regexp_extract("sequence_number", r"([0-9]{4})\s*$", 1)
    return s.select("snapshot_id", F.when(tail != "", tail).otherwise(F.col("sequence_number")).alias("sequence"), F.coalesce("region", F.lit("unknown")).alias("region"))


@query(f"SELECT leaf_id, arg_min_null(title, entry_id) AS title, arg_min_null(operation, entry_id) AS operation FROM {ENTRIES} GROUP BY 1")
def src_14_first_leaf_wins(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.groupBy("leaf_id").agg(F.min_by("title", "entry_id").alias("title"), F.min_by("operation", "entry_id").alias("operation"))


@query(f"SELECT class, count(*) AS n, count(DISTINCT source) AS n_documents FROM (SELECT CASE WHEN link_kind = 'external_url' THEN 'external' WHEN t IS NULL OR t = source THEN 'internal' ELSE 'cross_doc' END AS class, source FROM (SELECT link_kind, {_path('target_doc')} AS t, {_path('source_doc')} AS source FROM {LINKS})) GROUP BY 1")
def qry_09_link_classes(spark, sf_dir):
    l = links(spark, sf_dir).select("link_kind", path_key(F.col("target_doc")).alias("t"), path_key(F.col("source_doc")).alias("source"))
    return l.groupBy(P.link_class(F.col("link_kind"), F.col("source"), F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_documents"))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN source_doc IN (SELECT source_doc FROM {LINKS} WHERE status = 'suspicious') THEN 'suspicious' ELSE status END AS status FROM {LINKS}) GROUP BY 1")
def qry_05_edited_links(spark, sf_dir):
    """Every link of a document with a suspicious link becomes suspicious: an edit by document."""
    l = links(spark, sf_dir)
    edits = l.where("status = 'suspicious'").select("source_doc").distinct().withColumn("status", F.lit("suspicious"))
    return P.apply_edits(l.select("source_doc", "status"), edits, ["source_doc"], ["status"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT entry_id, c AS color, (b >= 128 AND b - greatest(r, g) >= 40) AS blue FROM (SELECT entry_id, c, CAST('0x' || c[1:2] AS INT) AS r, CAST('0x' || c[3:4] AS INT) AS g, CAST('0x' || c[5:6] AS INT) AS b FROM (SELECT entry_id, substring(checksum, 1, 6) AS c FROM {ENTRIES} WHERE checksum IS NOT NULL AND regexp_matches(checksum, '^[0-9a-fA-F]{{6}}')))")
def par_05_blue(spark, sf_dir):
    e = entries(spark, sf_dir).where("checksum is not null").where(F.rlike("checksum", F.lit("^[0-9a-fA-F]{6}")))
    return e.select("entry_id", F.substring("checksum", 1, 6).alias("color")).withColumn("blue", P.blueish(F.col("color")))


@query("SELECT event_id, lpad(upper(format('{:x}', (event_id * 7919) & 16777215)), 6, '0') AS color FROM events")
def par_07_packed_colors(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.packed_color(F.col("event_id") * 7919).alias("color"))


@query("SELECT page_id, count(*) AS n_words, count(*) FILTER (w.text = substring(p.text, w.char_start + 1, w.char_end - w.char_start)) AS n_placed FROM (SELECT DISTINCT page_id, word_no, text, char_start, char_end FROM ocr_words) w JOIN (SELECT DISTINCT page_id, text FROM ocr_pages) p USING (page_id) GROUP BY 1")
def src_07_word_places(spark, sf_dir):
    w = table(spark, sf_dir, "ocr_words").select("page_id", "word_no", F.col("text").alias("word"), "char_start", "char_end").distinct()
    p = table(spark, sf_dir, "ocr_pages").select("page_id", "text").distinct()
    placed = F.col("word") == F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return w.join(p, "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(placed).alias("n_placed"))


_SIM = f"(SELECT DISTINCT l.link_id, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS s FROM (SELECT l.link_id, {_TOK('l.link_text')} AS x, {_TOK('a.title')} AS y FROM {_L} l JOIN {_DEFA} a ON a.doc = l.doc AND a.anchor = l.anchor) l)"


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.status = 'ok' AND s.s < 0.75 THEN 'suspicious' ELSE l.status END AS status FROM {LINKS} l LEFT JOIN {_SIM} s USING (link_id)) GROUP BY 1")
def val_07_annotated(spark, sf_dir):
    sim = val_05_text_similarity(spark, sf_dir)
    l = links(spark, sf_dir).select("link_id", "status").join(sim, "link_id", "left")
    status = F.when((F.col("status") == "ok") & (F.col("similarity") < 0.75), "suspicious").otherwise(F.col("status"))
    return l.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
