"""Reference operators on small literal tables and against plain Python."""

import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.functions import patterns as P
from linkloom.operators import anchors as A
from linkloom.operators import checks as C
from linkloom.operators import detection as D
from linkloom.operators import graphs as G
from linkloom.operators import reporting as R
from linkloom.operators import resolution as Z
from linkloom.operators import sequences as Q
from linkloom.runtime import heavy_keys, join_unique
from tests.conftest import rows

PIECES = ["Section 4.2", "sec. 1", "§ 3.1.2", "Table 14-2", "Figure A", "Appendix B", "SP-2024-001", "PROT-ABC-1234", "NCT01234567", "see 5.3.1", "Module 5.3", "m2/25-over/x", "21 CFR Part 11.10", "ICH E6 (R2)", "10.1000/abc", "the protocol deviation", "per protocol", "protocol", "statistical analysis plan (SAP)", "SAP", "AB-12_34", "𝒳é", "12.5 mg", "\t", "https://x.org/a/", ".", ","]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map(" ".join), min_size=150, max_size=150))
def spans_agree_with_regex(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for p in [*P.ALL_PATTERNS, *P.NER_PATTERNS]:
        got = {r.i: [(m.span_start, m.span_end, m.text) for m in r.s] for r in df.select("i", D.spans(F.col("text"), p.regex).alias("s")).collect()}
        want = {i: [(m.start(), m.end(), m.group()) for m in regex.finditer(p.regex, t)] for i, t in enumerate(texts)}
        assert got == want, p.id


def test_spans_agree_with_regex(spark):
    spans_agree_with_regex()


def greedy(ms):
    kept = []
    for m in sorted(ms, key=lambda m: (-m["confidence"], -(m["span_end"] - m["span_start"]), m["span_start"], m["ordinal"])):
        if all(k["span_end"] <= m["span_start"] or m["span_end"] <= k["span_start"] for k in kept):
            kept.append(m)
    return sorted((m["span_start"], m["ordinal"]) for m in kept)


def test_overlaps_against_greedy(spark):
    rnd = random.Random(1)
    data = []
    for i in range(60):
        ms = []
        for o in range(rnd.randrange(7)):
            s = rnd.randrange(20)
            ms.append({"confidence": rnd.choice([0.5, 0.9]), "span_start": s, "span_end": s + rnd.randrange(1, 6), "ordinal": o})
        data.append((i, ms))
    df = spark.createDataFrame(data, "i int, ms array<struct<confidence:double,span_start:int,span_end:int,ordinal:int>>")
    got = {r.i: [(m.span_start, m.ordinal) for m in r.o] for r in df.select("i", D.resolve_overlaps(F.col("ms")).alias("o")).collect()}
    assert got == {i: greedy(ms) for i, ms in data}


def test_detect_edges(spark):
    df = spark.createDataFrame([(1, 0, ""), (2, 0, None), (3, 0, "Table 4 and Section 4.2"), (4, 0, "statistical analysis plan (SAP)"), (5, 0, "protocol deviation; the protocol")], "doc_id int, line_no int, text string")
    got = [(r.doc_id, r.pattern_id, r.span_start) for r in D.detect(df).orderBy("doc_id", "span_start").collect()]
    assert got == [(3, "TABLE_REF_NUMBERED_V1", 0), (3, "SECTION_REF_LABELED_V1", 12), (4, "DOC_REF_SAP_V1", 27), (5, "DOC_REF_PROTOCOL_V1", 24)]
    assert rows(D.detect(df.limit(0))) == []


def test_registry_rejects_twins():
    r = P.registry()
    assert len(list(P.registry("regex"))) == 25 and r.label_for("nope") == "UNKNOWN"
    with pytest.raises(ValueError):
        r.register(P.ALL_PATTERNS[0])


def test_span_scores(spark):
    s = "unit int, label string, span_start int, span_end int"
    pred = spark.createDataFrame([(1, "A", 0, 5), (1, "A", 3, 8), (2, "A", 0, 2), (1, "B", 0, 1)], s)
    gold = spark.createDataFrame([(1, "A", 4, 9), (2, "A", 5, 6), (3, "C", 0, 1)], s)
    assert rows(D.span_scores(pred, gold)) == [("A", 1, 2, 1, 0.333333, 0.5, 0.4), ("B", 0, 1, 0, 0.0, 0.0, 0.0), ("C", 0, 0, 1, 0.0, 0.0, 0.0)]


def test_captions_and_headings(spark):
    lines = ["Table 14.2.1 Summary", "Table 14.2.1 shows", "TABLE 3: Title", "Table 1 ..... 12", "appendix b", "4.2 Study design", "4.2 lower", "4.2 A sentence.", None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, text string").withColumn("doc_id", F.lit(1))
    got = [(r.line_no, r.anchor_key) for r in A.caption_definitions(df).orderBy("line_no").collect()]
    assert got == [(0, "table_ref_14_2_1"), (2, "table_ref_3"), (4, "appendix_ref_B"), (5, "section_ref_4_2")]


def test_routing_columns(spark):
    f = lambda e, *v: spark.range(1).select(e).first()[0]
    assert f(Z.study_key(F.lit("csrsp2026002body"))) == "sp2026002" and f(Z.study_key(F.lit("nct04089566sap"))) == "nct04089566" and f(Z.study_key(F.lit("notes"))) == ""
    assert f(Z.stem(F.lit("a/b.c/d.tar.gz"))) == "d.tar" and f(Z.doc_type(F.lit("myanalysisplan"))) == "sap" and f(Z.doc_type(F.lit("x"))) == "other"
    assert f(Z.qualifier(F.lit("the protocol and SAP Section 6.2"), F.lit("Section 6.2"))) == "sap"
    assert f(Z.qualifier(F.lit("nothing Section 6.2"), F.lit("Section 6.2"))) == ""
    assert f(Z.relative_uri(F.lit("m1/a/x.pdf"), F.lit("m1/b/y.pdf"), F.lit("s"))) == "../b/y.pdf#s" and f(Z.relative_uri(F.lit("x"), F.lit("y/z"))) == "y/z"
    assert f(Z.module_of_path(F.lit("m5/5-3-1-bio/x"))) == "m5.3.1" and f(Z.module_of_path(F.lit("m1/us/x"))) == "m1" and f(Z.module_of_path(F.lit("z"))) == "unknown"
    assert f(Z.module_chain(F.lit("m2.5.3"))) == ["m2", "m2.5", "m2.5.3"] and f(Z.module_chain(F.lit("x"))) == []


def test_leaf_strategies(spark):
    leaves = spark.createDataFrame([("l1", "m2.5", "Study plan AB-2020-001", "p", 2), ("l2", "m2.5", "Other title here", "p", 1), ("l3", "m2", None, "p", 3)], "leaf_id string, module string, title string, path string, ord int")
    refs = spark.createDataFrame([(1, "m2.5", "AB-2020-001", "other title"), (2, "m2.5.9", None, None), (3, "m2.50", None, "study plan"), (4, "m9", "ZZ-2020-001", "zzz"), (5, None, None, "")], "ref_id int, module string, study_id string, title string")
    assert rows(Z.leaf_by_module(refs, leaves)) == [(1, "l2", 0.95, "module"), (2, "l2", 0.8, "module_prefix"), (3, "l2", 0.9, "module_prefix")]
    assert rows(Z.leaf_by_study(refs, leaves)) == [(1, "l1", 0.92)]
    assert rows(Z.leaf_by_title(refs, leaves)) == [(1, "l2", 0.666667)]


def test_siblings(spark):
    cases = {1: ["d/b.docx"], 2: ["d/b.docx", "e/c.pdf"], 3: ["d/b.docx", "e/c.docx"], 4: ["e/b.docx", "e/c.docx"], 5: [], 6: ["d/a.docx", "e/z.pdf", "e/z.pdf"]}
    files = spark.createDataFrame([(k, c, c) for k, cs in cases.items() for c in cs], "g int, candidate string, own string")
    refs = spark.createDataFrame([(k, k, "d/a.docx", "d/a.docx") for k in cases], "k int, g int, source string, own string")
    assert rows(Z.sibling_pick(refs, files, "k", ["g"], "own")) == [(1, "d/b.docx"), (2, "d/b.docx"), (3, "d/b.docx"), (4, None), (5, None), (6, "e/z.pdf")]


def test_sibling_pick_against_all_pairs(spark):
    rnd = random.Random(4)
    paths = [f"{d}/{n}.{x}" for d in "pq" for n in "abc" for x in ("pdf", "docx")]
    groups = {g: rnd.sample(paths, rnd.randrange(1, 5)) for g in range(40)}
    data = [(g, p, p) for g, ps in groups.items() for p in ps]
    asked = {g: rnd.choice(paths) for g in groups}
    want = {}
    for g, s in asked.items():
        others = [p for p in groups[g] if p != s]
        same = [p for p in others if p.split(".")[1] == s.split(".")[1]]
        near = [p for p in others if p[0] == s[0]]
        want[g] = next((x[0] for x in (others, same, near) if len(x) == 1), None)
    refs = spark.createDataFrame([(g, g, s, s) for g, s in asked.items()], "k int, g int, source string, own string")
    assert dict(rows(Z.sibling_pick(refs, spark.createDataFrame(data, "g int, candidate string, own string"), "k", ["g"], "own"))) == want


def test_guards_of_acronyms(spark):
    texts = ["Statistical Analysis Plan (SAP v2)", "statistical analysis plan SAP", "statistical analysis plan (sap", "statistical analysis plan of SAP", "statistical  analysis plan (SAP)", "statistical analysis plan"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, line_no int, text string")
    got = [(r.doc_id, r.text) for r in D.match_one(df, "DOC_REF_SAP_V1").orderBy("doc_id", "span_start").collect()]
    assert got == [(0, "SAP"), (1, "SAP"), (3, "statistical analysis plan"), (3, "SAP"), (4, "statistical  analysis plan"), (4, "SAP"), (5, "statistical analysis plan")]


def test_targets_of_all_labels(spark):
    f = lambda p, la, t, **g: tuple(spark.range(1).select(Z.target_of(F.lit(p), F.lit(la), F.lit(t), F.create_map(*[F.lit(x) for kv in g.items() for x in kv]) if g else F.create_map().cast("map<string,string>")).alias("t")).first().t)
    assert f("VISIT_REF_V1", "VISIT_REF", "Week 2 Visit", unit="Week", n="2") == ("internal_bookmark", "visit_ref_week_2")
    assert f("REF_CITE_V1", "REF_CITE", "O'Brien 2019", surname="O'Brien", year="2019")[1] == "ref_obrien_2019" and f("", "REF_CITE", "[7]", num="07")[1] == "ref_7" and f("", "REF_CITE", "?")[1] == "ref_heading"
    assert f("COMPOUND_REF_V1", "DOC_REF", "SAP Section 5.3", compound_anchor_key="section_ref_5_3")[1] == "section_ref_5_3" and f("EXT_REF_CFR_V1", "EXT_REF", "CFR 11", part="11")[1].endswith("title-21/part-11")
    assert f("CTD_LEAF_PATH_V1", "CTD_LEAF", "m5/53-x/y", mod="5", subpath="53-x/y")[1] == "m5_53-x_y"
    m = lambda **g: spark.range(1).select(Z.module_of_groups(F.create_map(*[F.lit(x) for kv in g.items() for x in kv]))).first()[0]
    assert [m(mod="5", subpath="53-clin/x"), m(mod="2", sub="5.3"), m(mod="2"), m(x="1"), m(mod="3", subpath="7-a")] == ["m5.3", "m2.5.3", "m2", None, "m3.7-a"]


def test_deprecated_ids_of_any_shape(spark):
    u = spark.createDataFrame([(1, 0, "SP-2019-001B PROT-ABC-0001, NCT00000001;PROT-ABC-0001 (SP-2019-001) xSP-2019-001"), (2, 0, None), (3, 0, "")], "doc_id int, line_no int, text string")
    reg = spark.createDataFrame([("SP-2019-001",), ("PROT-ABC-0001",), ("NCT00000001",), (None,)], "id string")
    assert rows(C.deprecated_ids(u, reg)) == [(1, 0, "NCT00000001", 1), (1, 0, "PROT-ABC-0001", 2), (1, 0, "SP-2019-001", 2)]
    with pytest.raises(ValueError):
        C.deprecated_ids(u, spark.createDataFrame([("a b",)], "id string"))


def test_rules(spark):
    facts = {
        "leaves": spark.createDataFrame([("l1", "日本", "A b.pdf"), ("l2", None, "ok.pdf"), ("l3", "𝒳", "x.pdf")], "leaf_id string, title string, path string"),
        "pdfs": spark.createDataFrame([("p", " pdf/a-2b"), ("q", None)], "path string, format string"), "bookmarks": spark.createDataFrame([("p", 1), ("p", 3)], "path string, level int"),
        "runs": spark.createDataFrame([("d", "x", "0000FF", False), ("d", "y", "0000FF", True), ("e", " ", "0000FF", None)], "doc string, text string, color string, is_hyperlink boolean"),
    }
    rules = [{"rule_id": v, "region": "us", "severity": "blocker" if "depth" in v else "warning", "validator": v} for v in (*C.rule_checks(), "nope")]
    found, skipped = C.evaluate_rules(rules, facts)
    assert {(r.rule_id, r.target) for r in found.collect()} == {
        ("fda_bookmark_depth_min_3", "q"), ("ema_bookmark_depth_min_2", "q"), ("pmda_bookmark_depth_min_3", "q"), ("hc_bookmark_depth_min_3", "q"), ("pdf_a_2b_compliance", "q"), ("pdf_a_1b_or_2b_compliance", "q"),
        ("hyperlink_color_blue", "d"), ("espre_filename_convention", "l1"), ("pmda_sjis_round_trip", "l3"),
    } and skipped == ["nope"]
    assert C.evaluate_rules(rules, facts, ["eu"]) == (None, [])
    assert rows(C.rule_report(found)) == [("TOTAL", 9, 4, 5, False), ("us", 9, 4, 5, False)]


def test_components_of_cycles(spark):
    rnd = random.Random(6)
    e = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(34)}
    reach = {n: set() for n in range(25)}
    for n in reach:
        todo = [b for a, b in e if a == n]
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += [b for a, b in e if a == x]
    got = {r.node: r.component for r in G.cycle_components(spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in e], "src string, dst string")).collect()}
    assert set(got) == {f"{n:02}" for n in reach if n in reach[n]}
    assert all((got[f"{a:02}"] == got[f"{b:02}"]) == (b in reach[a] and a in reach[b]) for a in reach if a in reach[a] for b in reach if b in reach[b])
    path = G.shortest_path(spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string"), "a", "e")
    assert rows(path) == [(0, "a"), (1, "b"), (2, "d"), (3, "e")]


def test_refiner_replies(spark):
    f = lambda t: spark.range(1).select(D.parse_refiner_reply(F.lit(t)).alias("r")).first().r
    assert tuple(f('say {"id": "a", "confidence": 1.7, "rationale": "x"} done')) == ("a", 1.0, "x") and f("none") is None and f('{"confidence": 1}') is None
    c = spark.createDataFrame([(1, 0.5, 0, "ab", "regex"), (1, 0.5, 3, "abc", "ner"), (2, 0.666, 0, "a", "ner")], "unit int, confidence double, span_start int, text string, source_layer string")
    assert [(r.unit, r.text, r.confidence, r.source_layer) for r in D.stub_refinement(c, ["unit"]).orderBy("unit").collect()] == [(1, "abc", 0.5, "llm"), (2, "a", 0.67, "llm")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("y", "z")], "src string, dst string")
    assert sorted(r.node for r in G.cycle_nodes(e).collect()) == ["a", "b", "c", "x"]
    n = spark.createDataFrame([("a",), ("q",), ("x",)], "node string")
    assert rows(G.orphans(n, e)) == [("q",)]
    assert rows(G.distances(e, n.where("node = 'a'"))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(G.cycle_nodes(e.limit(0))) == []


def test_sequence_diff_and_fields(spark):
    s = "k string, checksum string, operation string"
    b = spark.createDataFrame([("1", "A", None), ("2", "x", None), ("3", None, None), ("4", "q", None)], s)
    a = spark.createDataFrame([("1", "a", "replace"), ("2", "y", "new"), ("3", "z", "replace"), ("5", None, None)], s)
    assert rows(Q.diff_pair(b, a, ["k"])) == [("1", "unchanged"), ("2", "modified"), ("3", "modified"), ("4", "removed"), ("5", "added")]
    f = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "b", None), ("k", 3, "b", "m")], "k string, o int, t string, m string")
    assert rows(Q.field_changes(f, ["k"], "o", ["t", "m"])) == [("k", 2, "t", "a", "b"), ("k", 3, "m", None, "m")]


def test_checks(spark):
    f = lambda e: spark.range(1).select(e).first()[0]
    assert [f(C.url_status(F.lit(u))) for u in ("", "http://", "ftp://h/x", "mailto:a@b", "javascript:1", "https://x.org")] == ["broken", "broken", "unverified", "unverified", "broken", "unverified"]
    assert f(C.text_similarity(F.lit(""), F.lit(None).cast("string"))) == 1.0 and f(C.text_similarity(F.lit("a b"), F.lit("b c"))) == pytest.approx(1 / 3)
    assert f(C.suspicious_target(F.lit("Table 1.2"), F.lit("tbl:9.9"))) == 1.0 and f(C.suspicious_target(F.lit("x"), F.lit("1"))) is None
    assert f(C.file_name_problems(F.lit("a/_B é.pdf"))) == "contains uppercase characters; contains spaces; starts with underscore; contains non-ASCII characters"
    df = spark.createDataFrame([("plain",), ("日本",), ("𝒳",), (None,)], "t string")
    assert [r[0] for r in df.select(C.sjis_round_trip(F.col("t"))).collect()] == [True, True, False, True]


def test_reports(spark):
    f = lambda e: spark.range(1).select(e).first()[0]
    z = F.lit(0)
    assert f(R.readiness(F.lit(1), z, z, z, F.lit(2))) == 91.0 and f(R.readiness(F.lit(99), z, z, z, z)) == 0.0 and f(R.grade(F.lit(85.0))) == "B" and f(R.rate(z, z)) == 0.0
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "r string, c string")
    assert rows(R.pivot_with_totals(df, "r", "c", ["x", "y"], ["a", "b", "z"])) == [("TOTAL", 2, 1, 3), ("a", 1, 1, 2), ("b", 1, 0, 1), ("z", 0, 0, 0)]
    e = spark.createDataFrame([], "k int")
    assert rows(R.set_scores(e, e, ["k"])) == [(0, 1.0, 1.0, 1.0)]


def test_runs_and_islands(spark):
    r = spark.createDataFrame([(1, 1, "ab", True), (1, 2, "c", True), (1, 3, "d", False), (1, 4, "e", True)], "u int, run int, text string, f boolean")
    assert [x.offset for x in A.run_offsets(r, ["u"], "run", "text").orderBy("run").collect()] == [0, 3, 5, 7]
    assert rows(A.islands(r, "u", "run", "f", "text")) == [(1, 1, 2, "ab c"), (1, 4, 4, "e")]


def test_join_unique_splits_hot_keys(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"), "id")
    small = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [r.k for r in heavy_keys(big, ["k"], 500).collect()] == [7]
    for how in ("inner", "left", "left_semi"):
        assert rows(join_unique(big, small, ["k"], how, 500).na.fill(-1)) == rows(big.join(small, "k", how).na.fill(-1))


def test_streaming_status(spark, tmp_path):
    from linkloom.streaming import status

    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "a", 1.0), (2, "2024-01-01 00:10:00", 7, "b", 2.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = status.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.last_type, r.n) for r in spark.sql("select * from latest").collect()] == [(7, "b", 2)]
    assert status.sessions(spark.read.parquet(str(src)), "5 minutes").count() == 2


def test_entry_runs(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and {"p2_found", "p3_found"} <= set(names)
    assert entry.entry(spark).count() > 0


def test_derived_texts_hold_every_shape(spark, tmp_path):
    from linkloom.plans.derived import LINES, derived_units

    spark.range(1, 121).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    u = derived_units(spark, str(tmp_path))
    assert u.count() == 120 and u.where("text is null").count() == 0 and len(LINES) == 60
    found = D.matches_of(u, [p.id for p in D.ALL])
    assert {r.pattern_id for r in found.select("pattern_id").distinct().collect()} == {p.id for p in D.ALL}
    near_misses = ["SP-24-1", "PROT-A-12", "XNCT", "ftp://", "ISSUE", "CSRs", "TMX-1234_", "m7/", "Module 6", "ICH X", "Form XYZ", "May 2"]
    hits = [r.match for r in found.select("match").collect()]
    assert not [h for h in hits for n in near_misses if h.startswith(n)]


def test_title_similarity_against_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    leaves, refs = [], []
    for i in range(120):
        n = rnd.choice([1, 2, 3, 5, 6, 6, 7, 9, 12, 20])
        leaves.append((f"l{i}", " ".join(rnd.sample(vocabulary[: rnd.choice([12, 40])] if n < 12 else vocabulary, n)), i))
    for i in range(300):
        t = rnd.choice(leaves)[1].split()
        t = rnd.sample(t, rnd.randrange(1, len(t) + 1)) + rnd.sample(vocabulary, rnd.randrange(3))
        refs.append((i, " ".join(t)))
    hundred = [f"v{k}" for k in range(100)]
    leaves += [("l900", " ".join(hundred), 900)]
    refs += [(900, " ".join(hundred[:55])), (901, "w1"), (902, None), (903, "-")]  # 55 of 100 is 0.55
    want = []
    for i, t in refs:
        a = set((t or "").split()) - {"-"}
        s, o, leaf = max((len(a & set(u.split())) / len(a | set(u.split())), -o, leaf) for leaf, u, o in leaves)
        if s >= 0.55:
            want.append((i, leaf, round(s, 6)))
    dl = spark.createDataFrame(leaves, "leaf_id string, title string, ord int")
    dr = spark.createDataFrame(refs, "ref_id int, title string")
    assert rows(Z.leaf_by_title(dr, dl)) == want and (900, "l900", 0.55) in want
    monkeypatch.setattr(Z, "MOST_KEYS", 4)
    assert rows(Z.leaf_by_title(dr, dl)) == want
