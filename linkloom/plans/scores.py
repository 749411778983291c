"""Queries over scores, gates, rules, anomalies, viewers, checksums and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions.spelling import anchor_key, path_key
from linkloom.operators import checks as C
from linkloom.operators import detection as D
from linkloom.operators import graphs as G
from linkloom.operators import reporting as P
from linkloom.operators import sequences as S
from linkloom.plans.data_quality import _anchor, _path
from linkloom.plans.detection import RESOLVED, units
from linkloom.plans.reports import _ANCHORS, _KNOWN, _L, _STATUS, EDGES, TIMELINE, edges, known_anchors, known_docs, probes, timeline
from linkloom.plans.structure import ENTITIES, ENTRIES, LINKS, entities, entries, leaves, links
from linkloom.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# anomalies as the link table shows them: suspicious targets, unexplained errors, dead addresses
_ANOMALIES = f"(SELECT doc, kind, severity FROM (SELECT {_path('source_doc')} AS doc, CASE WHEN status = 'suspicious' THEN 'suspicious_target' WHEN status = 'unverified' THEN 'orphaned_reference' WHEN status = 'broken' AND link_kind = 'external_url' THEN 'deprecated_id' END AS kind, CASE WHEN status = 'broken' THEN 'blocker' ELSE 'warning' END AS severity FROM {LINKS}) WHERE kind IS NOT NULL)"


def _doc_links(spark, sf_dir):
    return links(spark, sf_dir).withColumn("doc", path_key(F.col("source_doc")))


def _anomalies(spark, sf_dir):
    l = _doc_links(spark, sf_dir)
    kind = F.when(F.col("status") == "suspicious", "suspicious_target").when(F.col("status") == "unverified", "orphaned_reference").when((F.col("status") == "broken") & (F.col("link_kind") == "external_url"), "deprecated_id")
    return l.select("doc", kind.alias("kind"), F.when(F.col("status") == "broken", "blocker").otherwise("warning").alias("severity")).where("kind is not null")


_TOTALS = f"(SELECT (SELECT count(*) FROM {LINKS} WHERE status = 'broken') AS broken, count(*) FILTER (kind = 'orphaned_reference') AS orphan, count(*) FILTER (severity = 'blocker') AS blocker, count(*) FILTER (severity = 'warning') AS warning FROM {_ANOMALIES})"


@query(f"SELECT w AS weights, CAST(broken * wb + orphan * wo + blocker * wk + warning * ww AS DOUBLE) AS deduction, CAST(greatest(0, 100 - (broken * wb + orphan * wo + blocker * wk + warning * ww)) AS DOUBLE) AS score FROM {_TOTALS}, (VALUES ('default', 5.0, 2.0, 10.0, 2.0), ('strict', 8.0, 3.0, 15.0, 3.0), ('lenient', 3.0, 1.0, 5.0, 1.0)) v(w, wb, wo, wk, ww)")
def agg_01_readiness(spark, sf_dir):
    """The whole dossier's score under each set of weights; the deduction shows what the clamp at 0 hides."""
    a = _anomalies(spark, sf_dir).agg(F.count_if(F.col("kind") == "orphaned_reference").alias("orphan"), F.count_if(F.col("severity") == "blocker").alias("blocker"), F.count_if(F.col("severity") == "warning").alias("warning"))
    t = _doc_links(spark, sf_dir).agg(F.count_if(F.col("status") == "broken").alias("broken")).crossJoin(F.broadcast(a))  # one row each
    counts = {c: F.col(c) for c in ("broken", "orphan", "blocker", "warning")}
    rows = F.array(*[F.struct(F.lit(w).alias("weights"), P.deduction(counts, w).alias("deduction"), P.readiness(F.col("broken"), F.col("orphan"), F.lit(0), F.col("blocker"), F.col("warning"), w).alias("score")) for w in P.WEIGHTS])
    return t.select(F.explode(rows).alias("r")).select("r.*")


@query(f"""WITH m AS (SELECT DISTINCT regexp_extract(doc, '^([^/]+)/', 1) AS module, doc FROM (SELECT {_path('source_path')} AS doc FROM dossier_docs) WHERE doc IS NOT NULL),
b AS (SELECT {_path('source_doc')} AS doc, count(*) FILTER (status = 'broken') AS broken FROM {LINKS} GROUP BY 1), a AS (SELECT doc, count(*) FILTER (kind = 'orphaned_reference') AS orphan, count(*) FILTER (severity = 'blocker') AS blocker, count(*) FILTER (severity = 'warning') AS warning FROM {_ANOMALIES} GROUP BY 1),
s AS (SELECT module, count(*) AS documents, coalesce(sum(broken), 0) AS broken, coalesce(sum(orphan), 0) AS orphan, coalesce(sum(blocker), 0) AS blocker, coalesce(sum(warning), 0) AS warning FROM m LEFT JOIN b USING (doc) LEFT JOIN a USING (doc) GROUP BY 1)
SELECT module, documents, CAST(broken AS BIGINT) AS broken, CAST(orphan AS BIGINT) AS orphan, CAST(blocker AS BIGINT) AS blocker, CAST(warning AS BIGINT) AS warning, CAST(3.0 * broken + orphan + 5 * blocker + warning AS DOUBLE) AS deduction, CAST(round(greatest(0, 100 - (3.0 * broken + orphan + 5 * blocker + warning)), 2) AS DOUBLE) AS score FROM s""")
def agg_03_module_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "dossier_docs").select(path_key(F.col("source_path")).alias("doc")).where("doc is not null")
    return P.module_scores(docs.select(F.regexp_extract("doc", "^([^/]+)/", 1).alias("module"), "doc"), _doc_links(spark, sf_dir), _anomalies(spark, sf_dir), "lenient")


_PER_DOC = f"(SELECT {_path('source_doc')} AS doc, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'broken') AS broken, count(*) FILTER (status = 'unverified') AS unverified FROM {LINKS} GROUP BY 1)"
_GRADE = lambda x, steps: "CASE " + " ".join(f"WHEN {x} >= {n} THEN '{g}'" for n, g in steps) + " ELSE 'F' END"
_HELD = lambda x: f"greatest(0, least(100, {x}))"
_RUN, _REP, _PUSH = _HELD("100 - 5.0 * broken"), _HELD("100.0 - 5 * broken - CAST(unverified AS DOUBLE) * 5 / total"), _HELD("100 - 5 * broken - 0.5 * unverified")


@query(f"SELECT *, CAST(round({_RUN}, 1) AS DOUBLE) AS run_score, {_GRADE(_RUN, [(95, 'A'), (85, 'B'), (70, 'C')])} AS run_grade, CAST(round({_REP}, 1) AS DOUBLE) AS report_score, {_GRADE(_REP, [(90, 'A'), (80, 'B'), (70, 'C')])} AS report_grade, CAST(round({_PUSH}, 1) AS DOUBLE) AS pushed_score, {_GRADE(_PUSH, [(90, 'A'), (80, 'B'), (70, 'C')])} AS pushed_grade, {_REP} >= 85 AND broken = 0 AS is_ready FROM {_PER_DOC}")
def agg_05_06_status_scores(spark, sf_dir):
    return P.status_scores(_doc_links(spark, sf_dir), ["doc"])


@query(f"SELECT doc, CASE WHEN s >= 90 AND blockers = 0 THEN 'ready' WHEN blockers > 0 THEN 'blockers' WHEN broken > 0 THEN 'broken links' ELSE 'conditional' END AS verdict FROM (SELECT d.doc, broken, coalesce(k, 0) AS blockers, greatest(0, 100 - 5 * broken - 10 * coalesce(k, 0)) AS s FROM {_PER_DOC} d LEFT JOIN (SELECT doc, count(*) FILTER (severity = 'blocker') AS k FROM {_ANOMALIES} GROUP BY 1) a ON a.doc = d.doc)")
def agg_04_verdicts(spark, sf_dir):
    per = P.status_scores(_doc_links(spark, sf_dir), ["doc"]).join(C.anomaly_report([_anomalies(spark, sf_dir)]), "doc", "left")
    blockers, zero = F.coalesce("blockers", F.lit(0)), F.lit(0)
    score = P.readiness(F.col("broken"), zero, zero, blockers, zero)
    return per.select("doc", P.verdict(score, blockers, F.col("broken")).alias("verdict"))


@query(f"SELECT count(*) AS documents, CAST(sum(total) AS BIGINT) AS links, CAST(sum(broken) AS BIGINT) AS broken, round(sum(broken) / sum(total), 6) AS broken_rate, round(count(*) * 3600.0 / 90, 2) AS docs_per_hour FROM {_PER_DOC}")
def agg_07_batch_totals(spark, sf_dir):
    """As of a run of 90 seconds."""
    return P.batch_totals(_doc_links(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("status") == "broken").alias("broken")), 90.0)


@query(RESOLVED + "SELECT count(DISTINCT doc_id) AS documents, count(*) AS total, count(*) FILTER (source_layer = 'regex') AS n_regex, count(*) FILTER (source_layer = 'ner') AS n_ner FROM resolved")
def agg_16_trace_totals(spark, sf_dir):
    return D.detection_trace(D.detect(units(spark, sf_dir))).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("total", "n_regex", "n_ner")])


_GATE_ROW = f"(SELECT count(*) AS documents, avg(100.0 * ok / total) AS score, (SELECT count(DISTINCT doc) FROM {_ANOMALIES} WHERE severity = 'blocker') AS blocker_docs, (SELECT count(*) FILTER (found_status = 'ok') / count(*) FROM ({_STATUS})) AS pass_rate FROM {_PER_DOC})"


@query(f"SELECT g.gate AS gate, CAST(round(g.value, 6) AS DOUBLE) AS value, g.passed AS passed FROM (SELECT unnest([{{'gate': 'throughput', 'value': CAST(documents AS DOUBLE), 'passed': documents >= 100}}, {{'gate': 'readiness', 'value': score, 'passed': score >= 85}}, {{'gate': 'blocker documents', 'value': blocker_docs / documents, 'passed': blocker_docs / documents < 0.2}}, {{'gate': 'viewers', 'value': pass_rate, 'passed': pass_rate >= 0.5}}]) AS g FROM {_GATE_ROW})")
def agg_18_gates(spark, sf_dir):
    per = _doc_links(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    docs = per.agg(F.count(F.lit(1)).alias("documents"), F.avg(100.0 * F.col("ok") / F.col("n")).alias("score"))
    blocked = _anomalies(spark, sf_dir).where("severity = 'blocker'").agg(F.countDistinct("doc").alias("blocker_docs"))
    status = C.link_status(probes(spark, sf_dir).withColumn("link_kind", F.col("link_kind")), known_docs(spark, sf_dir), known_anchors(spark, sf_dir))
    passed = status.agg((F.count_if((F.col("found_status") == "ok") & (F.col("link_kind") != "external_url")) / F.count(F.lit(1))).alias("pass_rate"))
    return P.acceptance_gates(docs.crossJoin(F.broadcast(blocked)).crossJoin(F.broadcast(passed)), 100, 90.0)  # one row each


# runs with colours, out of the labelled paragraphs

_RUNS = "(SELECT example_id AS doc, i AS run, w[i] AS text, lpad(upper(format('{:x}', (example_id * 7919 + i * 104729) & 16777215)), 6, '0') AS color, (example_id + i) % 4 = 0 AS is_hyperlink FROM (SELECT example_id, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM (SELECT DISTINCT ON (example_id) * FROM refs_dev)))"
_BLUE = f"(SELECT * FROM {_RUNS} WHERE NOT is_hyperlink AND trim(text) <> '' AND CAST('0x' || color[5:6] AS INT) >= 128 AND CAST('0x' || color[5:6] AS INT) - greatest(CAST('0x' || color[1:2] AS INT), CAST('0x' || color[3:4] AS INT)) >= 40)"


def colored_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "refs_dev").groupBy(F.col("example_id").alias("doc")).agg(F.max("text").alias("t"))
    words = rows.select("doc", F.posexplode(F.split("t", " ")).alias("p", "text")).withColumn("run", F.col("p") + 1)
    return words.select("doc", "run", "text", P.packed_color(F.col("doc") * 7919 + F.col("run") * 104729).alias("color"), ((F.col("doc") + F.col("run")) % 4 == 0).alias("is_hyperlink"))


@query(f"SELECT doc, text, 'blue_text_no_link' AS kind, 'warning' AS severity, CAST(0.85 AS DOUBLE) AS confidence FROM {_BLUE}")
def ano_01_blue_text(spark, sf_dir):
    return C.blue_text(colored_runs(spark, sf_dir))


_REFS2 = f"(SELECT {_path('source_doc')} AS doc, ref FROM {ENTITIES} e JOIN (SELECT DISTINCT ON (example_id) example_id, source_doc FROM refs_dev ORDER BY example_id, source_doc NULLS LAST) r USING (example_id))"


@query(f"SELECT doc, ref, count(*) AS n FROM {_REFS2} x WHERE NOT EXISTS (SELECT 1 FROM link_records l WHERE {_path('l.source_doc')} = x.doc AND l.link_text = x.ref) GROUP BY 1, 2")
def ano_02_unlinked_references(spark, sf_dir):
    of = table(spark, sf_dir, "refs_dev").groupBy("example_id").agg(path_key(F.min("source_doc")).alias("doc"))
    refs = entities(spark, sf_dir).join(of, "example_id").select("doc", "ref")
    linked = table(spark, sf_dir, "link_records").select(path_key(F.col("source_doc")).alias("doc"), "link_text")
    return C.orphaned_references(refs, linked).groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, severity, count(*) AS n, count(DISTINCT doc) AS documents, count(DISTINCT doc) FILTER (severity = 'blocker') AS documents_with_blockers FROM {_ANOMALIES} GROUP BY 1, 2")
def ano_06_summary(spark, sf_dir):
    blocked = F.countDistinct(F.when(F.col("severity") == "blocker", F.col("doc")))
    return _anomalies(spark, sf_dir).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("documents"), blocked.alias("documents_with_blockers"))


@query(f"SELECT doc, count(*) AS n, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings FROM {_ANOMALIES} WHERE kind <> 'suspicious_target' GROUP BY 1")
def ano_05_toggled(spark, sf_dir):
    return C.anomaly_report([_anomalies(spark, sf_dir)], {"suspicious_target": False})


# rules; the PDFs' bookmarks are the files' anchors, their metadata follow from the file's number

_PDFS = f"(SELECT path, min(file_id) AS file_id FROM (SELECT {_path('source_path')} AS path, file_id FROM dossier_docs) WHERE path LIKE '%.pdf' GROUP BY 1)"
_DEPTH = f"(SELECT p.path, coalesce(max(length(a.k) - length(replace(a.k, '.', '')) + 1), 0) AS depth, max(p.file_id) AS file_id FROM {_PDFS} p LEFT JOIN (SELECT doc_id, {_anchor('anchor_key')} AS k FROM anchor_def) a ON a.doc_id = p.file_id GROUP BY 1)"
_LEAF = f"(SELECT leaf_id, arg_min_null(title, entry_id) AS title, regexp_extract(arg_min_null(relative_path, entry_id), '([^/]*)$', 1) AS n FROM {ENTRIES} GROUP BY 1)"
RULES = [
    {"rule_id": "us-depth", "region": "us", "severity": "blocker", "validator": "fda_bookmark_depth_min_3"},
    {"rule_id": "eu-depth", "region": "eu", "severity": "warning", "validator": "ema_bookmark_depth_min_2"},
    {"rule_id": "jp-depth", "region": "jp", "severity": "warning", "validator": "pmda_bookmark_depth_min_3", "params": {"min_depth": 4}},
    {"rule_id": "us-pdfa", "region": "us", "severity": "warning", "validator": "pdf_a_1b_or_2b_compliance"},
    {"rule_id": "us-blue", "region": "us", "severity": "warning", "validator": "hyperlink_color_blue"},
    {"rule_id": "us-title", "region": "us", "severity": "warning", "validator": "leaf_title_max_length", "params": {"max_length": 20}},
    {"rule_id": "eu-name", "region": "eu", "severity": "blocker", "validator": "espre_filename_convention"},
    {"rule_id": "ca-other", "region": "ca", "severity": "blocker", "validator": "not_known"},
]
_VIOLATIONS = f"""(SELECT 'us-depth' AS rule_id, 'us' AS region, 'blocker' AS severity, path AS target FROM {_DEPTH} WHERE depth < 3 UNION ALL SELECT 'eu-depth', 'eu', 'warning', path FROM {_DEPTH} WHERE depth < 2 UNION ALL SELECT 'jp-depth', 'jp', 'warning', path FROM {_DEPTH} WHERE depth < 4
UNION ALL SELECT 'us-pdfa', 'us', 'warning', path FROM {_PDFS} WHERE file_id % 3 <> 0 UNION ALL SELECT DISTINCT 'us-blue', 'us', 'warning', CAST(doc AS VARCHAR) FROM {_BLUE} UNION ALL SELECT 'us-title', 'us', 'warning', leaf_id FROM {_LEAF} WHERE length(title) > 20
UNION ALL SELECT 'eu-name', 'eu', 'blocker', leaf_id FROM {_LEAF} WHERE n <> lower(n) OR contains(n, ' ') OR starts_with(n, '_') OR regexp_matches(n, '[^\\x00-\\x7f]'))"""


def _pdfs(spark, sf_dir):
    d = table(spark, sf_dir, "dossier_docs").select(path_key(F.col("source_path")).alias("path"), "file_id").where(F.endswith("path", F.lit(".pdf")))
    return d.groupBy("path").agg(F.min("file_id").alias("file_id")).withColumn("format", F.when(F.col("file_id") % 3 == 0, " pdf/a-2b").otherwise("PDF 1.7"))


def _bookmarks(spark, sf_dir):
    a = table(spark, sf_dir, "anchor_def").select(F.col("doc_id").alias("file_id"), F.size(F.split(anchor_key(F.col("anchor_key")), r"\.")).alias("level"))
    return _pdfs(spark, sf_dir).join(a, "file_id").select("path", "level")


def _violations(spark, sf_dir):
    facts = {"leaves": leaves(spark, sf_dir), "pdfs": _pdfs(spark, sf_dir), "bookmarks": _bookmarks(spark, sf_dir), "runs": colored_runs(spark, sf_dir).withColumn("doc", F.col("doc").cast("string"))}
    return C.evaluate_rules(RULES, facts)


@query(f"SELECT * FROM {_VIOLATIONS}")
def rul_01_violations(spark, sf_dir):
    return _violations(spark, sf_dir)[0].select("rule_id", "region", "severity", "target")


@query("SELECT 'ca-other' AS rule_id")
def rul_01_skipped(spark, sf_dir):
    return spark.createDataFrame([(r,) for r in _violations(spark, sf_dir)[1]], "rule_id string")


@query(f"SELECT path AS target, 'depth ' || depth || ', at least 3 wanted' AS detail FROM {_DEPTH} WHERE depth < 3")
def rul_02_bookmark_depth(spark, sf_dir):
    return C.bookmark_depth_violations(_pdfs(spark, sf_dir), _bookmarks(spark, sf_dir), 3)


@query(f"SELECT path, file_id % 3 = 0 AS is_pdf_a FROM {_PDFS}")
def rul_03_pdf_a(spark, sf_dir):
    return _pdfs(spark, sf_dir).select("path", C.is_pdf_a(F.col("format")).alias("is_pdf_a"))


@query(f"SELECT CAST(doc AS VARCHAR) AS target, count(*) || ' blue runs without link' AS detail FROM {_BLUE} GROUP BY doc")
def rul_04_blue_runs(spark, sf_dir):
    return C.rule_checks()["hyperlink_color_blue"]({"runs": colored_runs(spark, sf_dir)}, {}).withColumn("target", F.col("target").cast("string"))


@query(f"SELECT coalesce(region, 'TOTAL') AS region, count(*) AS n, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'blocker') = 0 AS passed FROM {_VIOLATIONS} GROUP BY ROLLUP (region)")
def rul_08_report(spark, sf_dir):
    return C.rule_report(_violations(spark, sf_dir)[0])


# sequences

_CS = "(SELECT entry_id, p, CASE entry_id % 4 WHEN 0 THEN upper(md5(p)) WHEN 1 THEN sha256(p) WHEN 2 THEN c ELSE NULL END AS checksum, CASE WHEN entry_id % 4 = 1 THEN 'SHA256' WHEN entry_id % 8 = 2 THEN 'crc' WHEN entry_id % 4 = 2 THEN 'md5' END AS t, entry_id % 5 = 0 AS gone FROM (SELECT entry_id, checksum AS c, " + _path("relative_path") + f" AS p0, coalesce(p0, '') || '#' || entry_id AS p FROM {ENTRIES}))"


@query(f"SELECT entry_id, CASE WHEN gone THEN 'missing_file' WHEN coalesce(checksum, '') = '' OR a IS NULL THEN 'no_checksum' WHEN lower(checksum) = a THEN 'ok' ELSE 'mismatch' END AS status, CASE WHEN NOT gone AND coalesce(checksum, '') <> '' THEN a END AS actual FROM (SELECT *, CASE coalesce(lower(t), 'md5') WHEN 'md5' THEN md5(p) WHEN 'sha256' THEN sha256(p) END AS a FROM {_CS})")
def seq_06_checksums(spark, sf_dir):
    """Files made of their path; every fifth is missing, checksums are right, of another kind, foreign or absent in turn."""
    e = entries(spark, sf_dir)
    path = F.concat(F.coalesce(path_key(F.col("relative_path")), F.lit("")), F.lit("#"), F.col("entry_id").cast("string"))
    k = F.col("entry_id") % 4
    given = F.when(k == 0, F.upper(F.md5("path"))).when(k == 1, F.sha2("path", 256)).when(k == 2, F.col("checksum"))
    kind = F.when(k == 1, "SHA256").when(F.col("entry_id") % 8 == 2, "crc").when(k == 2, "md5")
    rows = e.withColumn("path", path).select("entry_id", "path", given.alias("checksum"), kind.alias("checksum_type"))
    files = rows.where("entry_id % 5 <> 0").select("path", F.col("path").cast("binary").alias("content"))
    return S.verify_checksums(rows, files)


@query(f"""WITH s AS (SELECT dossier_id, seq, leaf_id, max(checksum) AS checksum, max(coalesce(operation, 'new')) AS op FROM {TIMELINE} GROUP BY 1, 2, 3), o AS (SELECT dossier_id, seq, lag(seq) OVER (PARTITION BY dossier_id ORDER BY seq) AS prev FROM (SELECT DISTINCT dossier_id, seq FROM {TIMELINE}))
SELECT o.dossier_id, o.seq, k.leaf_id, CASE WHEN b.leaf_id IS NULL THEN 'added' WHEN a.leaf_id IS NULL THEN 'removed' WHEN CASE WHEN b.checksum IS NOT NULL AND a.checksum IS NOT NULL THEN lower(b.checksum) <> lower(a.checksum) ELSE a.op <> 'new' END THEN 'modified' ELSE 'unchanged' END AS change
FROM o JOIN (SELECT DISTINCT dossier_id, seq, leaf_id FROM s) k ON k.dossier_id = o.dossier_id AND k.seq IN (o.seq, o.prev) LEFT JOIN s a ON a.dossier_id = o.dossier_id AND a.seq = o.seq AND a.leaf_id = k.leaf_id LEFT JOIN s b ON b.dossier_id = o.dossier_id AND b.seq = o.prev AND b.leaf_id = k.leaf_id WHERE o.prev IS NOT NULL GROUP BY ALL""")
def seq_07_diffs(spark, sf_dir):
    return S.consecutive_diffs(timeline(spark, sf_dir))


@query(f"SELECT entry_id, leaf_id, lower(module) AS module FROM {ENTRIES} WHERE starts_with(lower(module), 'm5.3') AND lower(operation) IN ('replace', 'append', 'delete')")
def seq_08_modified_under(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.where(F.startswith(F.lower("module"), F.lit("m5.3")) & F.lower("operation").isin("replace", "append", "delete")).select("entry_id", "leaf_id", F.lower("module").alias("module"))


_VERSIONS = f"(SELECT dossier_id, path, leaf_id || '@' || seq AS id, seq, delivered_at, ord, entry_id FROM {TIMELINE})"
_CHAIN = f"(SELECT DISTINCT dossier_id, path, src, dst FROM (SELECT dossier_id, path, id AS dst, lag(id) OVER (PARTITION BY dossier_id, path ORDER BY seq, delivered_at, ord, entry_id) AS src FROM {_VERSIONS}) WHERE src IS NOT NULL AND src <> dst)"


def _version_edges(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return S.sequence_edges(t.withColumn("leaf_id", F.concat_ws("@", "leaf_id", "seq")))


@query(f"SELECT * FROM {_CHAIN}")
def seq_05_edges(spark, sf_dir):
    """Versions of a leaf are told apart by their sequence."""
    return _version_edges(spark, sf_dir)


_VE = f"(SELECT src, max(dst) AS dst FROM (SELECT dossier_id || '|' || path || '|' || src AS src, dossier_id || '|' || path || '|' || dst AS dst FROM {_CHAIN}) GROUP BY 1)"


@query(f"WITH RECURSIVE e AS MATERIALIZED {_VE}, r AS (SELECT src AS node, dst AS latest, 1 AS n FROM e UNION ALL SELECT r.node, e.dst, n + 1 FROM r JOIN e ON e.src = r.latest), b AS (SELECT node, arg_max(latest, n) AS latest FROM r GROUP BY 1) SELECT * FROM b UNION ALL SELECT DISTINCT dst, dst FROM e WHERE dst NOT IN (SELECT src FROM e)")
def gr_08_latest(spark, sf_dir):
    name = lambda c: F.concat_ws("|", "dossier_id", "path", c)
    return S.latest_along(_version_edges(spark, sf_dir).select(name("src").alias("src"), name("dst").alias("dst")))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src AS node FROM r WHERE src = dst")
def gr_06_cycle_nodes(spark, sf_dir):
    return G.cycle_nodes(edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT (SELECT min(src) FROM e) AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 40) SELECT (SELECT min(src) FROM e) AS source, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 2")
def gr_09_hops_from_first(spark, sf_dir):
    """From the first document to every one it reaches."""
    e = edges(spark, sf_dir)
    return G.distances(e, e.agg(F.min("src").alias("node")))


_CM = EDGES.replace("IN ('cross_doc', 'cross_module')", "= 'cross_module'")


@query(f"SELECT DISTINCT doc AS node FROM (SELECT {_path('source_path')} AS doc FROM dossier_docs) WHERE doc IS NOT NULL AND doc NOT IN (SELECT src FROM {_CM} UNION SELECT dst FROM {_CM})")
def gr_07_orphans(spark, sf_dir):
    """Documents that no link between modules touches."""
    nodes = table(spark, sf_dir, "dossier_docs").select(path_key(F.col("source_path")).alias("node")).where("node is not null")
    l = table(spark, sf_dir, "link_records").where("link_kind = 'cross_module'")
    return G.orphans(nodes, G.reference_edges(l.select(path_key(F.col("source_doc")).alias("src"), path_key(F.col("target_doc")).alias("dst"))))


# validation

_P0 = f"(SELECT link_id, link_kind, coalesce(doc, '') || CASE WHEN anchor IS NULL THEN '' ELSE '#' || anchor END AS t, doc, anchor, nullif(link_id % 9, 0) AS page FROM {_L})"
_P1 = f"(SELECT p.*, k.doc IS NOT NULL AS has_file, coalesce(p.doc LIKE '%.pdf', false) AS is_pdf, CASE WHEN link_id % 11 > 0 THEN 5 END AS n_pages, CASE WHEN link_id % 13 > 0 THEN a.anchor IS NOT NULL END AS has_mark FROM {_P0} p LEFT JOIN {_KNOWN} k ON k.doc = p.doc LEFT JOIN {_ANCHORS} a ON a.doc = p.doc AND a.anchor = p.anchor)"


@query(f"""SELECT kind, status, count(*) AS n FROM (SELECT kind, CASE WHEN kind = 'external_url' THEN CASE WHEN contains(t, '.') THEN 'ok' ELSE 'broken' END WHEN coalesce(doc, '') = '' THEN 'unverified' WHEN NOT has_file THEN 'broken' WHEN kind = 'cross_doc' AND anchor IS NULL THEN 'ok'
 WHEN is_pdf THEN CASE WHEN n_pages IS NULL THEN 'unverified' WHEN page IS NULL OR page <= n_pages THEN 'ok' ELSE 'unverified' END WHEN has_mark IS NULL THEN 'unverified' WHEN has_mark THEN 'ok' ELSE 'broken' END AS status
 FROM (SELECT *, CASE WHEN link_kind = 'external_url' AND NOT regexp_matches(lower(t), '^https?://') THEN 'cross_doc' ELSE link_kind END AS kind FROM {_P1})) GROUP BY 1, 2""")
def val_04_pipeline_status(spark, sf_dir):
    """Page numbers, page counts and files that can't be read follow from the link's number."""
    p = probes(spark, sf_dir).withColumn("t", F.concat(F.coalesce("doc", F.lit("")), F.when(F.col("anchor").isNull(), "").otherwise(F.concat(F.lit("#"), "anchor"))))
    seen = p.join(known_docs(spark, sf_dir).withColumn("k", F.lit(True)), "doc", "left").join(known_anchors(spark, sf_dir).withColumn("a", F.lit(True)), ["doc", "anchor"], "left")
    i = F.col("link_id")
    s = C.pipeline_status(F.col("link_kind"), F.col("t"), F.col("k").isNotNull(), F.coalesce(F.endswith("doc", F.lit(".pdf")), F.lit(False)), F.nullif(i % 9, F.lit(0)), F.when(i % 11 > 0, 5), F.when(i % 13 > 0, F.col("a").isNotNull()))
    return seen.select(s.alias("s")).groupBy("s.kind", "s.status").agg(F.count(F.lit(1)).alias("n"))


_ISSUES = f"(SELECT l.link_id, CASE WHEN s.doc IS NULL THEN 'missing_source' WHEN l.doc IS NULL THEN 'missing_target' WHEN l.doc = l.source THEN 'self_reference' WHEN k.doc IS NULL THEN 'missing_file' WHEN l.anchor IS NOT NULL AND a.anchor IS NULL THEN 'missing_anchor' ELSE 'ok' END AS issue FROM {_L} l LEFT JOIN {_KNOWN} s ON s.doc = l.source LEFT JOIN {_KNOWN} k ON k.doc = l.doc LEFT JOIN {_ANCHORS} a ON a.doc = l.doc AND a.anchor = l.anchor WHERE link_kind = 'cross_module')"


def _issues(spark, sf_dir):
    docs = known_docs(spark, sf_dir)
    l = probes(spark, sf_dir).where("link_kind = 'cross_module'")
    seen = l.join(docs.select(F.col("doc").alias("source"), F.lit(True).alias("s")), "source", "left").join(docs.withColumn("k", F.lit(True)), "doc", "left").join(known_anchors(spark, sf_dir).withColumn("a", F.lit(True)), ["doc", "anchor"], "left")
    issue = C.integrity_issue(F.col("s").isNotNull(), F.col("doc").isNotNull(), F.col("doc") == F.col("source"), F.col("k").isNotNull(), F.col("anchor").isNull() | F.col("a").isNotNull())
    return seen.select("link_id", issue.alias("issue"))


@query(f"SELECT link_id, CASE issue WHEN 'ok' THEN 'ok' WHEN 'self_reference' THEN 'suspicious' ELSE 'broken' END AS status, issue AS error_msg FROM {_ISSUES}")
def val_10_link_records(spark, sf_dir):
    i = _issues(spark, sf_dir)
    return i.select("link_id", C.issue_status(F.col("issue")).alias("status"), F.col("issue").alias("error_msg"))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT (SELECT count(*) FROM {_ISSUES} WHERE issue = 'ok') AS n_ok, (SELECT count(*) FROM {_ISSUES} WHERE issue <> 'ok') AS n_failed, (SELECT count(*) FROM r WHERE src = dst) AS n_on_cycles, (SELECT count(DISTINCT node) FROM ({SQL['gr_07_orphans']})) AS n_orphans")
def val_09_audit(spark, sf_dir):
    i = _issues(spark, sf_dir).agg(F.count_if(F.col("issue") == "ok").alias("n_ok"), F.count_if(F.col("issue") != "ok").alias("n_failed"))
    c = gr_06_cycle_nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_on_cycles"))
    o = gr_07_orphans(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_orphans"))
    return i.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(o))  # one row each


_VL = f"(SELECT s.link_id, {_path('l.source_doc')} AS doc, CASE WHEN link_kind = 'external_url' THEN NULL ELSE found_status = 'ok' END AS resolves FROM ({_STATUS}) s JOIN {LINKS} l ON l.link_id = s.link_id)"
_VR = f"(SELECT 'headless' AS viewer, CASE WHEN resolves IS NULL THEN 'unverified' WHEN resolves THEN 'ok' ELSE 'broken' END AS status FROM {_VL} UNION ALL SELECT v, 'unverified' FROM {_VL}, (SELECT unnest(['adobe_acrobat_pro', 'fda_esg', 'ema_espre', 'pmda_gateway']) AS v) UNION ALL SELECT v, 'unverified' FROM (SELECT DISTINCT doc FROM {_VL}), (SELECT unnest(['adobe_acrobat_pro', 'fda_esg', 'ema_espre', 'pmda_gateway']) AS v) UNION ALL SELECT 'structural', CASE WHEN doc IS NULL OR length(doc) % 7 = 0 THEN 'unverified' WHEN length(doc) % 7 = 1 THEN 'structural_error' ELSE 'ok' END FROM (SELECT DISTINCT doc FROM {_VL}))"


@query(f"SELECT viewer, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'broken') AS broken, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'structural_error') AS structural_errors, round(count(*) FILTER (status = 'ok') / count(*), 6) AS pass_rate FROM {_VR} GROUP BY 1")
def val_11_12_viewers(spark, sf_dir):
    """What the structural checker says follows from the length of a document's path."""
    s = C.link_status(probes(spark, sf_dir), known_docs(spark, sf_dir), known_anchors(spark, sf_dir)).withColumn("doc", F.col("source"))
    rows = s.select("doc", "link_kind", F.when(F.col("link_kind") != "external_url", F.col("found_status") == "ok").alias("resolves"))
    sound = rows.select("doc").distinct().where("doc is not null and length(doc) % 7 <> 0").select("doc", (F.length("doc") % 7 != 1).alias("sound"))
    return C.viewer_report(C.viewer_results(rows, sound))


# reports

@query(f"SELECT link_id, coalesce(source_doc, '') AS source_doc, coalesce(link_text, '') AS link_text, coalesce(link_location_descriptor, '') AS link_location, coalesce(target_doc, '') AS target_doc, coalesce(target_anchor, '') AS target_anchor, coalesce(status, '') AS status, coalesce(printf('%.3f', confidence), '') AS confidence, coalesce(error_msg, '') AS error_msg, coalesce(detected_by, '') AS detected_by, CASE WHEN detected_by = 'ner' THEN 'NER_' || link_id % 5 ELSE '' END AS ner_pattern, CASE WHEN link_id % 4 = 0 THEN 'yes' ELSE 'no' END AS llm_called, CASE WHEN link_id % 4 = 0 THEN coalesce(printf('%.3f', confidence), '') ELSE '' END AS llm_confidence_before, '' AS llm_confidence_after FROM {LINKS}")
def snk_01_csv_rows(spark, sf_dir):
    l = links(spark, sf_dir).withColumn("ner_pattern", F.when(F.col("detected_by") == "ner", F.concat(F.lit("NER_"), (F.col("link_id") % 5).cast("string"))))
    l = l.withColumn("llm_called", F.col("link_id") % 4 == 0).withColumn("llm_confidence_before", F.when(F.col("link_id") % 4 == 0, F.col("confidence")))
    return P.csv_rows(l)


@query(f"SELECT link_id, coalesce(source_doc, '') AS source_doc, coalesce(link_text, '') AS link_text, coalesce(link_location_descriptor, '') AS link_location_descriptor, coalesce(target_doc, '') AS target_doc, coalesce(target_anchor, '') AS target_anchor, coalesce(status, '') AS status, coalesce(detected_by, '') AS detected_by, coalesce(error_msg, '') AS error_msg FROM {LINKS}")
def snk_03_run_rows(spark, sf_dir):
    return P.csv_rows(links(spark, sf_dir), P.RUN_COLUMNS).drop("confidence")


@query(f"SELECT kind, severity, suggested_fix, count(*) AS n, round(sum(confidence), 4) AS confidence FROM (SELECT CASE status WHEN 'broken' THEN 'broken_link' ELSE 'unverified_link' END AS kind, CASE status WHEN 'broken' THEN 'blocker' ELSE 'warning' END AS severity, CASE status WHEN 'broken' THEN 'Check target: ' || coalesce(target_doc, '') ELSE 'Manually verify target exists in submission package' END AS suggested_fix, coalesce(CAST(printf('%.3f', confidence) AS DOUBLE), CASE status WHEN 'broken' THEN 0.9 ELSE 0.7 END) AS confidence FROM {LINKS} WHERE status IN ('broken', 'unverified')) GROUP BY 1, 2, 3")
def src_17_anomalies_of_report(spark, sf_dir):
    """Anomalies of a report that was written as text and read again."""
    found = P.report_from_rows(P.csv_rows(links(spark, sf_dir)))
    return found.groupBy("kind", "severity", "suggested_fix").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


_PARA = f"(SELECT link_id, {_path('source_doc')} AS source, CAST(nullif(regexp_extract(link_location_descriptor, '^p([0-9]+)', 1), '') AS INT) AS para FROM {LINKS})"


@query(f"SELECT p.source, p.para, count(*) AS n FROM (SELECT DISTINCT source, para FROM {_PARA} WHERE para IS NOT NULL) p JOIN {_PARA} l ON l.source = p.source AND (l.para = p.para OR l.para IS NULL) GROUP BY 1, 2")
def aux_13_links_per_paragraph(spark, sf_dir):
    """Links whose place can't be read count for every paragraph of their document; they are summed before they meet them."""
    para = F.nullif(F.regexp_extract("link_location_descriptor", "^p([0-9]+)", 1), F.lit("")).cast("int")
    per = links(spark, sf_dir).groupBy(path_key(F.col("source_doc")).alias("source"), para.alias("para")).agg(F.count(F.lit(1)).alias("n"))
    anywhere = per.where("para is null").select("source", F.col("n").alias("anywhere"))
    return per.where("para is not null").join(anywhere, "source", "left").select("source", "para", (F.col("n") + F.coalesce("anywhere", F.lit(0))).alias("n"))


_TARGETS = f"(SELECT {_path('target_doc')} AS target, count(*) AS n, count(DISTINCT link_text) AS n_texts FROM {LINKS} WHERE link_kind IN ('cross_doc', 'cross_module') GROUP BY 1)"


@query(f"SELECT target, n, n_texts, rank FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rank FROM {_TARGETS} WHERE target IS NOT NULL) WHERE rank <= 25")
def aux_12_related_documents(spark, sf_dir):
    """The 25 documents most links point to (ties included): a top-k report. Ranks come from the at most 25 largest counts."""
    l = links(spark, sf_dir).where("link_kind in ('cross_doc', 'cross_module')").select(path_key(F.col("target_doc")).alias("target"), "link_text").where("target is not null")
    per = l.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("link_text").alias("n_texts"))
    sizes = per.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(25)
    from pyspark.sql import Window

    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 25 rows
    ranks = sizes.select("n", (above + 1).alias("rank")).where("rank <= 25")
    return per.join(F.broadcast(ranks), "n").select("target", "n", "n_texts", "rank")


@query("WITH h AS (SELECT doc_id, text, event_type, ts FROM (SELECT event_id AS doc_id, event_type AS text, event_type, ts FROM events)) SELECT user_id, arg_max(event_type, (live, ts, event_id)) AS status FROM (SELECT *, event_id % 3 = 0 AS live FROM events) GROUP BY 1")
def str_05_live_wins(spark, sf_dir):
    """Stored rows and live ones together: a live copy wins, then the newer one."""
    from linkloom.streaming.status import hydrated

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("status"))
    return hydrated(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), "user_id", ["ts", "event_id"]).select("user_id", "status")
