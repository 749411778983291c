"""Training-data operators against brute force, round trips and invariants, with nulls, empties, ties, repeats and clashes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.llm import components, encoding, mixing, overlaps, packing, plans, scans
from linkloom.llm import scan_lattice as lattice
from linkloom.llm.tokens import VOCABULARY, TokenCounter
from tests.conftest import rows

REFS = "example_id long, text string, entities array<struct<span_start:int,span_end:int,label:string>>, source_doc string, paragraph_index int, split string, key string"
DOCS = "doc_id long, text string, lang string, source string, key string, h long"
PAGES = "page_id long, scan_id string, page_index int, text string, confidence double, noise string"


def union_find(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


def groups(pairs):
    out = {}
    for x, r in pairs:
        out.setdefault(r, set()).add(x)
    return sorted(map(sorted, out.values()))


# p1


@pytest.mark.parametrize("small", [0, components.SMALL_GRAPH])
def test_components_against_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_GRAPH", small)
    rnd = random.Random(2)
    e = [(f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}") for _ in range(90)] + [("hub", f"s{k}") for k in range(60)] + [(f"c{k}", f"c{k + 1}") for k in range(30)]
    df = spark.createDataFrame([*e, e[0], ("lone", "lone"), (None, "x"), ("x", None)], "a string, b string")
    got = groups((r.node, r.root) for r in components.components(df).collect())
    assert got == groups(union_find([p for p in e if p[0] != p[1]]).items())


def refs(spark):
    ent = lambda t, s: [(t.index(s), t.index(s) + len(s), "STUDY_ID")]
    t = "In study AB-2020-001 it was"
    data = [
        (5, t, ent(t, "AB-2020-001"), "a/x.docx", 1, "train", ""), (5, t, ent(t, "AB-2020-001"), "a/x.docx", 1, "train", ""), (3, t.lower(), ent(t.lower(), "ab-2020-001"), None, None, "dev", ""),
        (7, "no", [], "A//x.docx ", 2, None, ""), (9, "no", None, "b", 0, "test", ""), (8, None, [(0, 3, "STUDY_ID")], None, 0, "test", ""), (1, "", [(0, 0, "STUDY_ID")], " ", 0, "test", ""), (None, "x", [], "a/x.docx", 0, "dev", ""),
    ]
    return spark.createDataFrame(data, REFS)


def test_linked_groups_edges(spark):
    got = rows(components.linked_groups(refs(spark)))
    assert got == [(1, 1, 1), (3, 3, 3), (5, 3, 3), (7, 3, 3), (8, 8, 1), (9, 9, 1)]
    assert rows(components.linked_groups(refs(spark).limit(0))) == []


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(4)
    data = [(i, "t", [], "hot" if i % 3 == 0 else f"d{rnd.randrange(400)}", 0, "train", "") for i in range(3000)]
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, target_share double")
    out = components.linked_splits(spark.createDataFrame(data, REFS), targets).collect()
    assert len(out) == 3000 and all(len({r.split for r in out if r.group_id == g}) == 1 for g in {r.group_id for r in out})
    share = Counter(r.split for r in out)
    assert abs(share["train"] - 2400) < 60 and abs(share["dev"] - 300) < 60 and abs(share["test"] - 300) < 60
    assert rows(components.linked_splits(refs(spark).limit(0), targets)) == []


# p4


def pages(spark, data):
    return spark.createDataFrame([(p, s, i, t, None, "clash") for p, s, i, t in data], PAGES)


def corpus(n=12):
    good = "The committee reviewed the standard protocol and the carton was tested again.\nEach two-sided pathway carries a standard measure that is soluble.\nThe laboratory examined the carton and the standard committee reviewed it."
    name = lambda k, m: "".join(chr(97 + (k * 7 + m * 3 + x * x) % 26) for x in range(6))
    edge = lambda k, m: "\n".join(f"{name(k, m + x)} {name(k + 5, m + x)}" for x in range(3))
    return [(100 + k, f"bulk-{k % 3}", k // 3, f"{edge(k, 0)}\n{good}\n{edge(k, 9)}\n{k // 3 + 1}") for k in range(n)]


def test_scan_noise(spark):
    scan = [
        (1, "s", 0, "Annual carton report\n\nThe committee revi-\newed the stan\xad\n1"), (1, "s", 0, "Annual carton report\n\nThe committee revi-\newed the stan\xad\n1"),
        (2, "s", 1, "ANNUAL CARTON REPORT\ndard protocol and each two-\nsided cartori was tested.\nIn study ABC-2O20-001 the labora-\ntory examined it\n2"),
        (3, "s", 2, "Annuol carton report\nagain.\n\n5.4.\n3"), (4, None, None, None), (5, None, None, ""), (6, None, 0, "again."),
    ]
    got = {r for r in rows(scans.scan_noise(pages(spark, scan + corpus()))) if r[0] < 100}
    assert got == {
        (1, 0, "running_head"), (2, 0, "running_head"), (3, 0, "running_head"), (1, 4, "page_number"), (2, 5, "page_number"), (3, 4, "page_number"),
        (1, 2, "hyphen_break"), (1, 3, "hyphen_break"), (2, 3, "hyphen_break"), (2, 2, "char_error"), (2, 3, "char_error"),
    }
    assert rows(scans.scan_noise(pages(spark, scan).limit(0))) == []


def test_scan_paragraphs(spark):
    scan = [(1, "s", 0, "Annual carton report\nThe committee revi-\newed the stan\xad\n1"), (2, "s", 1, "Annual carton report\ndard protocol and the cartori.\n\nEach two-\nsided carton was tested.\n2")]
    got = [(r.para_no, r.text) for r in scans.scan_paragraphs(pages(spark, scan + corpus())).where("scan_id = 's'").orderBy("para_no").collect()]
    assert got == [(0, "The committee reviewed the standard protocol and the carton."), (1, "Each two-sided carton was tested.")]


def test_page_numbers_and_folds():
    assert [scans.page_number(x) for x in ("[5l]", "- 12 -", "Page 3 of l2", "p. 7", "xiv", "4/9", "12", "1.5", "Sec 4", "mild")] == [(51, True), (12, True), (3, True), (7, True), (14, False), (4, False), (12, False), None, None, None]
    for read, meant in [("cornrnittee", "committee"), ("assessrnerit", "assessment"), ("instriiment", "instrument"), ("c1inical", "clinical"), ("cliriical", "clinical"), ("(ommit", "commit"), ("paecliatric", "paediatric"), ("hmit", "limit")]:
        assert set(lattice.folds(read)) & set(lattice.folds(meant)) and lattice.confusions_between(read, meant), read
    assert lattice.confusions_between("cat", "dog") is None and lattice.confusions_between("same", "same") == ()


def test_ids_of_the_catalogue_are_sound():
    assert [lattice.id_reading(x) for x in ("SP-2024-001", "ABCD-2024-012", "ABC-2024-0123,", "word-2024-abc", "plain")] == [None] * 5
    assert [lattice.id_reading(x) for x in ("ABC-2O20-001", "(A8C-20l9-0S1).", "SP-2024-00l")] == ["ABC-2020-001", "ABC-2019-051", "SP-2024-001"]


def facts_of(words, pairs=(), likely=None, compounds=()):
    n = Counter(words)
    letters = Counter(x[i : i + 2] for w, k in n.items() for x in ["^" + w + "$"] for i in range(len(x) - 1) for _ in range(k))
    costs = lattice.Costs({}, {}, letters, sum(n.values()), len(n))
    found = {"w:" + w: {"n": k} for w, k in n.items()} | {f"b:{a} {b}": {"n": k} for (a, b), k in dict(pairs).items()} | {"c:" + c: {"n": k} for c, k in dict(compounds).items()}
    for form, meant in (likely or {}).items():
        own, r = lattice.form_readings(form, n[form], 0, [(m, n[m], lattice.confusions_between(form, m)) for m in meant], costs)
        found["r:" + form] = {"n": n[form], "own": own, "readings": [dict(zip(("word", "n", "cost", "differs"), x)) for x in r], "splits": [{"a": "of", "b": "the", "na": n["of"], "nb": n["the"]}] if form == "ofthe" else None}
    return lattice.Facts(costs, found), {w for w, k in n.items() if k <= lattice.SELDOM}


def said(text, facts, rare):
    lines = [{"line_no": i, "text": x} for i, x in enumerate(text.split("\n"))]
    return [(what, words) for _, _, words, what, _ in lattice.decode(lattice.stream(1, lines, None, False), facts, rare)]


def test_lattice_weighs_words_and_neighbours():
    base = ["the"] * 900 + ["of"] * 800 + ["east"] * 100 + ["plaster"] * 20 + ["wing"] * 90 + ["committee"] * 200 + ["standard"] * 60 + ["two"] * 40 + ["sided"] * 30
    facts, rare = facts_of(base + ["cast"] * 5 + ["cornrnittee", "stan", "dard", "ofthe"], {("plaster", "cast"): 5, ("east", "wing"): 80, ("the", "east"): 60, ("committee", "of"): 60, ("the", "wing"): 60}, {"cast": ["east"], "cornrnittee": ["committee"], "ofthe": []}, {"two-sided": 9})
    assert said("plaster cast", facts, rare) == [("keep", ("plaster",)), ("keep", ("cast",))]  # a sound word, though rarer than its look-alike
    assert said("the cast wing", facts, rare)[1] == ("read", ("east",))  # its neighbours speak for the look-alike
    assert said("the cornrnittee", facts, rare)[1] == ("read", ("committee",))
    assert ("merge", ("standard",)) in said("the stan dard", facts, rare) and ("split", ("of", "the")) in said("committee ofthe wing", facts, rare)
    assert said("the commit-\ntee", facts, rare)[1] == ("join", ("committee",)) and said("the two-\nsided", facts, rare)[1:] == [("keep", ("two",)), ("keep", ("sided",))]


def test_path_is_the_best_of_all_paths():
    rnd = random.Random(8)
    words = ["the", "east", "wing", "of", "cast", "ofthe", "st", "and", "stand"]
    facts, rare = facts_of([w for w in words for _ in range(rnd.randrange(1, 40))] + ["stand"] * 20, {(a, b): rnd.randrange(9) for a in words for b in words}, {"cast": ["east"], "ofthe": []})
    own = {f[2:]: v["own"] for f, v in facts.found.items() if f[:2] == "r:"}

    def every(slots, i, prev):
        if i == len(slots):
            yield 0.0
            return
        near = i > 0 and slots[i - 1].glue in (" ", "\n", "-")
        beside = (slots[i - 1].form, slots[i].form) if near else (None, None)
        options = lattice.edges(slots, i, facts, rare) if lattice.ambiguous(slots, facts, rare)[i] else [(1, (slots[i].form,), 0.0, "keep", "")]
        for taken, said_, c, *_ in options:
            for rest in every(slots, i + taken, said_[-1]):
                yield rest + c - (lattice.affinity(prev, said_[0], facts, own, beside) if near else 0.0)

    for _ in range(40):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6)))
        slots = lattice.stream(1, [{"line_no": 0, "text": text}], None, False)
        least, cost, prev = min(every(slots, 0, "")), 0.0, ""
        for i, taken, out, what, _ in lattice.decode(slots, facts, rare):
            near = i > 0 and slots[i - 1].glue in (" ", "\n", "-")
            c = next(e[2] for e in lattice.edges(slots, i, facts, rare) if e[1] == out and e[3] == what) if lattice.ambiguous(slots, facts, rare)[i] else 0.0
            cost += c - (lattice.affinity(prev, out[0], facts, own, (slots[i - 1].form, slots[i].form)) if near else 0.0)
            prev = out[-1]
        assert cost == pytest.approx(least)


def test_paragraph_ends_against_all_cuts():
    rnd = random.Random(9)
    for _ in range(40):
        lines, no = [], 0
        for _ in range(rnd.randrange(1, 8)):
            no += rnd.choice([1, 1, 2])
            lines.append({"line_no": no, "text": rnd.choice(["The end.", "goes on and on here", "Goes on and on here", "x."])})
        width = max(len(x["text"]) for x in lines)

        def cost(ends):
            total, start = 0.0, 0
            for end in ends:
                total += scans.PARAGRAPH + (scans.LOW_START if start and lines[start]["text"][0].islower() else 0) + (scans.OPEN_END if end < len(lines) and lines[end - 1]["text"][-1] != "." else 0)
                for k in range(start + 1, end):
                    total += (scans.BLANK_INSIDE if lines[k]["line_no"] - lines[k - 1]["line_no"] > 1 else 0) + (scans.SHORT_INSIDE if lines[k - 1]["text"][-1] == "." and len(lines[k - 1]["text"]) < 0.7 * width else 0)
                start = end
            return total

        n = len(lines)
        every = [[k for k in range(1, n) if m >> k & 1] + [n] for m in range(0, 2**n, 2)]
        assert cost(scans.paragraph_ends(lines)) == pytest.approx(min(map(cost, every)))


# p5


def near(rnd, words, n):
    w = list(words)
    for _ in range(n):
        k, i = rnd.randrange(3), rnd.randrange(len(w))
        if k == 0:
            w[i] = f"new{rnd.randrange(999)}"
        elif k == 1:
            w.insert(i, f"ins{rnd.randrange(999)}")
        elif len(w) > 3:
            del w[i]
    return w


def brute_pairs(data):
    seen = {}
    for i, t, *_, split, _ in data:
        if i is not None and t and split in ("train", "dev", "test") and (w := overlaps.words_of(t)):
            seen.setdefault((i, split == "train"), w)
    out = set()
    for (i, a), v in seen.items():
        for (j, b), w in seen.items():
            if a and not b and i != j and overlaps.edits(v, w, max(len(v), len(w)) // 5) is not None:
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("per_task", [20, overlaps.PER_TASK])
def test_overlaps_against_brute_force(spark, monkeypatch, per_task):
    monkeypatch.setattr(overlaps, "PER_TASK", per_task)
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    boiler = [rnd.choice(vocabulary) for _ in range(12)]
    data, i = [], 0
    for _ in range(40):
        n = rnd.choice([1, 2, 4, 5, 7, 10, 11, 15, 19, 20, 24, 25, 40, 60])
        base = [rnd.choice(vocabulary) for _ in range(n)]
        if n > 30 and rnd.random() < 0.6:
            base[5:17] = boiler
        for split in ("train", "train", "dev", "test"):
            i += 1
            data.append((i, " ".join(near(rnd, base, rnd.randrange(0, n // 5 + 1))).upper() + "!", [], "d", 0, split, ""))
    data += [data[0], (900, None, [], "d", 0, "dev", ""), (901, "", [], "d", 0, "train", ""), (902, "...", [], "d", 0, "dev", ""), (903, data[3][1], [], "d", 0, None, ""), (None, data[2][1], [], "d", 0, "dev", "")]
    df = spark.createDataFrame(data, REFS)
    got = {(r.id_a, r.id_b) for r in overlaps.cross_split_pairs(df).collect()}
    assert got == brute_pairs(data) and len(got) > 60
    assert rows(overlaps.cross_split_pairs(df.limit(0))) == []


def test_overlaps_of_templates_shuffle_no_meetings(spark):
    rnd = random.Random(3)
    boiler = [[f"b{k}x{j}" for j in range(7)] for k in range(6)]
    data = []
    for i in range(600):  # 42 of 60 words are those of all texts, 18 are not
        words = [w for block in boiler for w in [*block, *(f"w{rnd.randrange(5000)}" for _ in range(3))]]
        data.append((i, " ".join(words), [], "d", 0, rnd.choice(["train", "dev"]), ""))
    data += [(900, data[0][1] + " more", [], "d", 0, "train", ""), (901, data[0][1], [], "d", 0, "dev", "")]
    df = spark.createDataFrame(data, REFS)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {(r.id_a, r.id_b) for r in overlaps.cross_split_pairs(df).collect()}
    assert got == brute_pairs(data) and (900, 901) in got
    assert written() - before < 1_500_000


def test_words_ignore_typography():
    assert overlaps.words_of("The ofﬁcial “re-­view” of 5 µg—it’s") == overlaps.words_of("the official \"RE-VIEW\" of 5 μg it's")


# p6, p7


def test_counter_is_exact():
    import base64

    import tiktoken

    from linkloom.llm.tokens import PATTERN

    ranks = open(VOCABULARY, "rb").read()
    full = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    counter, rnd = TokenCounter(ranks), random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice(["a", " ", "  ", "\n", "it's ", "1234", "é", "日本", "<|endoftext|>", ". ", "\t", "word "]) for _ in range(rnd.randrange(30)))
        assert counter.count(t) == len(full.encode_ordinary(t)), repr(t)


def test_pack_histogram_invariants():
    rnd = random.Random(3)
    for _ in range(60):
        cap = rnd.choice([1, 5, 50, 2048])
        hist = {rnd.randrange(1, cap + 1): rnd.randrange(1, 300) for _ in range(rnd.randrange(0, 30))}
        used, packs, placed = Counter(), {}, Counter()
        for length, pattern, n, each in packing.pack_histogram(hist, cap):
            used[pattern] += length * each
            assert packs.setdefault(pattern, n) == n and each > 0
            placed[length] += n * each
        assert placed == Counter(hist) and all(u <= cap for u in used.values())


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, "clash", 1) for i, (t, s) in enumerate(texts)], DOCS)


def test_packing(spark):
    rnd = random.Random(5)
    texts = [(" ".join(["word"] * rnd.choice([1, 3, 3, 3, 9, 30, 64, 65, 200])), "s") for _ in range(400)] + [(None, "s"), ("", "s")]
    placed = packing.pack_documents(docs(spark, texts), 64).collect()
    counter = TokenCounter(open(VOCABULARY, "rb").read())
    want = {i: counter.count(t) for i, (t, _) in enumerate(texts) if t}
    total, room = Counter(), Counter()
    for r in placed:
        total[r.doc_id] += r.n_tokens
        room[r.container_id] += r.n_tokens
    assert dict(total) == want and max(room.values()) <= 64
    assert all(r.n_pieces == 1 for r in placed if want[r.doc_id] <= 64) and all(r.n_pieces == -(-want[r.doc_id] // 64) for r in placed)
    assert len(room) <= 1.05 * -(-sum(want.values()) // 64) + 1
    empty = packing.pack_documents(docs(spark, texts).limit(0), 64)
    assert rows(empty) == [] and packing.packing_report(empty, 64).first().containers == 0


def test_mixing(spark):
    rnd = random.Random(6)
    texts = [("word " * rnd.randrange(1, 30), rnd.choice([" Big", "BIG", "big", "big", "small", None, ""])) for _ in range(1500)] + [(None, "big"), ("", "small"), ("x y", "other")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("Small ", 0.4, 3), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    mixed, budgets = mixing.mix(docs(spark, texts), targets)
    report = {r.source.strip().lower(): r for r in mixing.mix_report(mixed, budgets).collect()}
    counter = TokenCounter(open(VOCABULARY, "rb").read())
    size = Counter()
    for t, s in texts:
        if t and s and s.strip():
            size[s.strip().lower()] += counter.count(t)
    for s, share, most in (("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 9)):
        r, wanted = report[s], share * sum(size.values())
        assert r.size == size[s] and r.reachable == (most * size[s] >= wanted) and r.most_copies <= most
        assert abs(r.used - min(wanted, most * size[s])) <= 31
    assert rows(mixing.mix_report(*mixing.mix(docs(spark, texts).limit(0), targets)))[0][5] == 0


# p8

SOUND = ["L’étude « modérée » a été validée après le résumé.", "Während der Prüfung wurden die Größe und die Behörde geändert.", "Se completó el análisis según la sección 4.2.", "The applicant’s “final” dose was ± 3 °C – twice.", "申請の規格は承認された。"]
ODD = ["Preço: € 12; fração ½ ou ¾; AÇÃO.", "SÃO BELVÃO, ÂMBAR", "α = 0.05, √2 Ω", "Название без перевода", "┌──┬──┐\n│ A │", "été deux", "The ofﬁcial “Ŵ-grade”", "«único» L’étude „Gefäß“"]


def broken(t, channel):
    if channel == "lost":
        return t.encode("cp1252").decode("utf-8", "replace")
    if channel == "twice":
        return broken(broken(t, "cp1252"), "cp1252")
    if ">" in channel:
        a, b = channel.split(">")
        return t.encode(a).decode(b)
    return "".join(bytes([x]).decode(channel, "ignore") or chr(x) for x in t.encode("utf-8"))


@pytest.fixture(scope="module")
def restored(spark):
    texts = SOUND * 30 + ODD * 2
    start = len(texts)
    cases = [(t, c) for t in SOUND[:4] for c in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "twice", "lost")] + [(SOUND[4], "cp1252")]
    cases += [(SOUND[4], "cp932>latin-1"), (SOUND[4], "euc_jp>latin-1")]
    cases += [(t, c) for t in SOUND[:3] for c in ("cp1252>cp437", "cp1252>mac_roman", "cp1252>cp1251")if t.encode("cp1252", "ignore").decode("cp1252") == t]
    texts += [broken(t, c) for t, c in cases] + [None, ""]
    df = docs(spark, [(t, "s") for t in texts])
    return start, cases, {r.doc_id: r.restored for r in encoding.restore_texts(df).collect()}


def test_only_garbled_texts_are_found(restored):
    start, cases, got = restored
    assert set(got) == {start + k for k in range(len(cases))}


def test_garbled_texts_are_restored(restored):
    start, cases, got = restored
    right = [got[start + k] == t for k, (t, _) in enumerate(cases)]
    assert sum(right) >= 0.85 * len(cases), [(c, got[start + k]) for k, (t, c) in enumerate(cases) if not right[k]]


def test_every_lost_place_is_in_the_lattice():
    texts = {t for _, t, _ in encoding.candidates("rÃsumÃ")}
    assert "r\ufffdsum\ufffd" in texts and "applicant\ufffds" in {t for _, t, _ in encoding.candidates("applicantâs")}
    deep = "é"
    for _ in range(5):
        deep = broken(deep, "cp1252")
    assert "é" in {t for _, t, _ in encoding.candidates(deep)}


def test_garbled_empty(spark):
    assert rows(encoding.restore_texts(docs(spark, [("x", "s")]).limit(0))) == []


def test_queries_are_named():
    assert {f"p{n}_found" for n in (1, 4, 5, 6, 7, 8)} <= set(plans.QUERIES) and set(plans.SQL) <= set(plans.QUERIES)
    assert F is not None
