"""Snapshot deltas and orphan references against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.functions.spelling import anchor_key, path_key, sequence_key
from linkloom.operators import orphan_refs as O
from linkloom.operators import snapshot_delta as S
from tests.conftest import rows

SNAP = "snapshot_id long, dossier_id string, sequence_number string, schema_version string, region string, delivered_at timestamp_ntz, leaf_count int, title string"
LEAF = "entry_id long, snapshot_id long, dossier_id string, sequence_number string, leaf struct<leaf_id:string,relative_path:string,module:string,operation:string,checksum:string,checksum_type:string,title:string>, ord int"
LINK = "link_id long, source_doc string, target_doc string, target_anchor string, link_kind string, validated_at timestamp_ntz, loaded_at timestamp_ntz, status string, doc string"
DOC = "file_id long, version_no int, source_path string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
ANCHOR = "doc_id long, anchor_key string, defined_at timestamp_ntz, removed_at timestamp_ntz"
SHARED = "doc_path string, anchor_key string, title string"
T = datetime(2024, 1, 31, 23, 0)
h = lambda n: T + timedelta(hours=n)


@pytest.mark.parametrize("given,want", [("A\\b//C.Docx ", "a/b/c.docx"), ("./a/x/../b", "a/b"), ("/a/./b/", "a/b"), ("../a", "../a"), ("a/b/../../c", "c"), (" ", None), (None, None), (".", None), ("x/..", None), ("a.b./c", "a.b./c"), ("a/.../b", "a/.../b")])
def test_path_key(spark, given, want):
    df = spark.createDataFrame([(given,)], "p string")
    assert df.select(path_key(F.col("p"))).first()[0] == want


def test_other_keys(spark):
    df = spark.createDataFrame([("# Sec: 1.2",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(anchor_key(F.col("p"))).collect()] == ["sec:1.2", None, None]
    df = spark.createDataFrame([("us0012",), (" 7 ",), (None,), ("none",), ("12345",)], "p string")
    assert [r[0] for r in df.select(sequence_key(F.col("p"))).collect()] == ["0012", "0007", "0000", "0000", "12345"]


def test_changes_edge_cases(spark):
    snaps = [
        (1, "d", "1", None, None, h(0), 1, "x"), (2, "d", "seq-0003", None, None, h(5), 1, "x"), (3, "d", " 0003", None, None, h(4), 9, "x"),
        (4, "d", None, None, None, h(1), 1, "x"), (5, None, "1", None, None, h(1), 1, "x"), (6, "e", "1", None, None, None, 1, "x"), (6, "e", "1", None, None, None, 1, "x"),
    ]
    leaf = lambda i, p="a/b", m="m1", o="new", c="c", t="t": (i, p, m, o, c, "md5", t)
    ents = [
        (1, 1, "d", "1", leaf("same"), 0), (2, 1, "d", "1", leaf("spelt", "A//b", "M 1", "new", "C", "T "), 0), (3, 1, "d", "1", leaf("null", None), 0),
        (4, 1, "d", "1", leaf("moved"), 0), (5, 1, "d", "1", leaf("gone"), 0), (6, 1, "d", "1", leaf("cut"), 0),
        (11, 2, "d", "3", leaf("same", o="replace"), 0), (12, 2, "d", "3", leaf("spelt"), 0), (13, 2, "d", "3", leaf("null"), 0),
        (14, 2, "d", "3", leaf("moved", "a/c"), 0), (16, 2, "d", "3", leaf("cut", o="delete"), 0), (17, 2, "d", "3", leaf("fresh", o=None), 0),
        (17, 2, "d", "3", leaf("fresh", o=None), 0), (18, 3, "d", "3", leaf("wrong delivery"), 0), (19, 4, "d", None, leaf("same"), 0), (20, 99, "d", None, leaf("nowhere"), 0), (21, 2, "d", "3", leaf(None), 0),
    ]
    got = rows(S.snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(ents, LEAF)))
    assert got == sorted(
        [("d", "0001", x, "added") for x in ("spelt", "null", "moved", "gone", "cut")]
        + [("d", "0003", "moved", "changed"), ("d", "0003", "gone", "removed"), ("d", "0003", "cut", "removed"), ("d", "0003", "fresh", "added")]
    )


def test_changes_random_and_empty(spark):
    rnd = random.Random(3)
    snaps = [(10 * d + s, f"d{d}", str(s), None, None, h(s), 0, "") for d in range(3) for s in range(4)]
    state, ents, n = {}, [], 0
    for sid, d, s, *_ in snaps:
        state[sid] = {f"l{k}": rnd.choice("ab") for k in range(40) if rnd.random() < 0.8}
        for k, c in state[sid].items():
            n += 1
            ents.append((n, sid, d, s, (k, "p", "m", "new", c, "md5", "t"), 0))
    want = []
    for d in range(3):
        for s in range(1, 4):
            a, b = state[10 * d + s - 1], state[10 * d + s]
            for k in {*a, *b}:
                kind = "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else None
                want += [(f"d{d}", f"{s:04d}", k, kind)] if kind else []
    sdf, edf = spark.createDataFrame(snaps, SNAP), spark.createDataFrame(ents, LEAF)
    assert rows(S.snapshot_changes(sdf, edf)) == sorted(want)
    assert rows(S.snapshot_changes(sdf.limit(0), edf)) == [] == rows(S.snapshot_changes(sdf, edf.limit(0)))


def test_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(S, "KEYS_PER_RANGE", 1)
    snaps = [(s, "d", str(s), None, None, h(s), 0, "") for s in (1, 2)]
    leaf = lambda k, c: (f"l{k}", "p", "m", "new", c, "md5", "t")
    ents = [(100 * s + k, s, "d", s, leaf(k, "b" if s == 2 and k == 7 else "a"), 0) for s in (1, 2) for k in range(70) if (s, k) != (2, 9)]
    leaves = S.with_depth(S.present_leaves(spark.createDataFrame(ents, LEAF), S.chosen_deliveries(spark.createDataFrame(snaps, SNAP))))
    assert {r.depth for r in leaves.select("depth").collect()} == {3}
    levels = S.merkle_levels(leaves)
    assert len(levels) == 4 and levels[0].count() == 2
    steps = spark.createDataFrame([("d", 2)], "dossier_id string, ord int")
    assert S.differing_ranges(levels, steps).count() <= 2  # the ranges of the two leaves that differ
    got = rows(S.snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(ents, LEAF)))
    assert got == [("d", "0002", "l7", "changed"), ("d", "0002", "l9", "removed")]


def test_signed_counts_carry_on(spark):
    D = O.DAY_US
    deltas = [("a", 5, 1, 1), ("a", D + 5, -1, 0), ("b", 2 * D, 1, 1)]
    refs = [("a", 1, 1), ("a", 6, 1), ("b", 3, 1), ("b", 3, 1), ("c", 4, 1)]
    df = lambda d: spark.createDataFrame(d, "k string, t bigint, d int, s int")
    rf = lambda r: spark.createDataFrame(r, "k string, v bigint, sign int")
    whole = O.daily_counts(rf(refs), df(deltas), ["k"])
    parts = O.daily_counts(rf(refs[3:]), df(deltas[1:]), ["k"], O.daily_counts(rf(refs[:3]), df(deltas[:1]), ["k"]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert [(r.k, r.day, r.refs, r.d, r.total) for r in O.orphan_days(whole, ["k"]).orderBy("k").collect()] == [("a", 0, 2, 0, 1), ("b", 0, 2, 0, 1), ("c", 0, 1, 0, 0)]
    gone = O.daily_counts(rf([("c", 4, -1)]), df(deltas).limit(0), ["k"], whole)
    assert "c" not in {r.k for r in O.orphan_days(gone, ["k"]).collect()}


def test_orphans_edge_cases(spark):
    docs = [(1, 1, "a/one.pdf", h(0), h(10)), (1, 2, "A/one.pdf", h(20), None), (1, 2, "A/one.pdf", h(20), None), (2, 1, "a/two.pdf", h(5), None), (3, 1, None, h(0), None)]
    anchors = [(1, "sec:1", h(0), h(5)), (2, "SEC:2", h(6), None), (2, "sec:2", h(6), None)]
    shared = [("shared/s.pdf", "sec:9", "t")]
    L = lambda i, v, doc, a=None, kind="cross_doc", src="a/one.pdf": (i, src, doc, a, kind, v, h(99), "ok", "clash")
    links = [
        L(1, h(3), "a/one.pdf"), L(2, h(10), "a/one.pdf"), L(3, h(20), "./a/ONE.pdf "), L(4, h(1), "a/two.pdf"), L(5, h(1), "nope.pdf"), L(6, h(1), "http://x", kind="external_url"),
        L(7, h(1), None), L(8, h(12), None, kind="internal_bookmark"), L(9, h(3), "", "sec:1", "internal_bookmark"), L(10, h(5), "a/one.pdf", "#Sec: 1"), L(11, h(5), "a/two.pdf", "sec:2"),
        L(12, h(7), "a/two.pdf", "sec:2"), L(13, h(7), "a/two.pdf", "sec:8"), L(14, h(1), "shared/s.pdf", "sec:1"), L(15, h(1), "shared/s.pdf", "sec:9"), L(16, h(1), "shared/s.pdf"), L(17, None, "nope.pdf"),
        L(5, h(1), "nope.pdf"), L(18, h(3), "a/one.pdf", " "),
    ]
    dfs = [spark.createDataFrame(r, s) for r, s in ((links, LINK), (docs, DOC), (anchors, ANCHOR), (shared, SHARED))]
    month = lambda n: h(n).strftime("%Y-%m")
    assert rows(O.orphan_links(*dfs)) == sorted([
        (2, "dossier_docs", month(10), "deleted"), (4, "dossier_docs", month(1), "late"), (5, "dossier_docs", month(1), "missing"), (8, "dossier_docs", month(12), "deleted"),
        (10, "anchor_def", month(5), "deleted"), (11, "anchor_def", month(5), "late"), (13, "anchor_def", month(7), "missing"), (14, "shared_docs", month(1), "missing"),
    ])
    assert rows(O.orphan_links(dfs[0].limit(0), *dfs[1:])) == []
    none = rows(O.orphan_links(dfs[0], *(d.limit(0) for d in dfs[1:])))
    assert {r[3] for r in none} == {"missing"} and {r[1] for r in none} == {"dossier_docs"}


def test_orphans_hot_key_random(spark):
    rnd = random.Random(5)
    docs = [(f, v, f"f{f}", h(rnd.randrange(100)), rnd.choice([None, h(rnd.randrange(100))])) for f in range(6) for v in range(3)]
    links = [(i, "x", "f0" if i % 3 else f"f{rnd.randrange(8)}", None, "cross_doc", h(rnd.randrange(100)), h(0), "ok", "") for i in range(600)]
    want = []
    for i, _, t, _, _, v, *_ in links:
        mine = [d for d in docs if d[2] == t]
        if sum((d[3] <= v) - (d[4] is not None and d[4] <= v) for d in mine) > 0:
            continue
        want.append((i, "missing" if not mine else "late" if all(d[3] > v for d in mine) else "deleted"))
    got = O.orphan_links(spark.createDataFrame(links, LINK), spark.createDataFrame(docs, DOC), spark.createDataFrame([], ANCHOR), spark.createDataFrame([], SHARED))
    assert sorted((r.link_id, r.reason) for r in got.collect()) == sorted(want)
