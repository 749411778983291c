"""Lost signs against a search over all fillings, and in context."""

import itertools
import random

import pytest

from linkloom.llm import encoding
from linkloom.llm import lost_signs as S
from tests.conftest import rows

DOCS = "doc_id long, text string"
SOUND = ["El estudio comparó la dosis.", "L’étude a comparé la dose.", "Le mot « dose » figure ici.", "Dose 3 – 5 mg.", "Dose 7 – 9 mg.", "Résumé", "El «mínimo» fue medido.", "§7.1 et §8.1", "Größe"]


def lost(t):
    return t.encode("cp1252").decode("utf-8", "replace")


#: Lead bytes whose rest is lost: two in one chunk, and one of three bytes, in texts whose channel shows.
TRUNCATED = ["Le rÃsumÃ â€“ Ã©tude", "The applicantâs dose â€“ twice."]


@pytest.fixture(scope="module")
def restored(spark):
    texts = SOUND * 20 + ["Dose 1 – 2 mg."] * 40 + ["El estudio comparó la dosis."] * 40
    cases = ["L’étude a comparé la dose.", "Le mot « dose » figure ici.", "Dose 4 – 8 mg.", "El estudio comparó la dosis.", "Le résumé (Größe),", "Der GRÖßE", "El «Größe» fue", "§9.1", "x ÿÿÿ y"]
    # a garbled form is no filling, however often it occurs
    texts += ["Größe".encode().decode("cp1252")] * 60
    texts += ["The applicant’s dose."] * 30
    df = spark.createDataFrame(list(enumerate(texts + list(map(lost, cases)) + TRUNCATED + [None, ""])), DOCS)
    got = {r.doc_id: r.restored for r in encoding.restore_texts(df).collect()}
    return dict(zip(cases + TRUNCATED, (got.get(len(texts) + i) for i in range(len(cases) + len(TRUNCATED)))))


@pytest.mark.parametrize("text", ["L’étude a comparé la dose.", "Le mot « dose » figure ici.", "Dose 4 – 8 mg.", "El estudio comparó la dosis."])
def test_neighbours_decide(restored, text):
    assert restored[text] == text


@pytest.mark.parametrize("text", ["Le résumé (Größe),", "El «Größe» fue", "§9.1"])
def test_case_punctuation_and_edges_do_not_matter(restored, text):
    assert restored[text] == text


def test_truncated_sequences(restored):
    assert [restored[t] for t in TRUNCATED] == ["Le résumé – étude", "The applicant’s dose – twice."]


def test_unknown_stays(restored):
    assert restored["x ÿÿÿ y"] == "x ��� y"


def test_empty(spark):
    assert rows(encoding.restore_texts(spark.createDataFrame([(1, "x")], DOCS))) == []


def test_path_is_the_best_of_all():
    rnd = random.Random(2)
    for _ in range(60):
        slots, pos = [], 0
        for _ in range(rnd.randrange(1, 5)):
            pos += rnd.choice([1, 1, 2])
            words = [f"{pos}{c}" for c in "abc"][: rnd.randrange(0, 4)]
            everything = {s: rnd_counter(rnd) for s in ("left", "right")}
            rs = {w: {"text": w, "context": rnd.choice("pqr"), "score": rnd.uniform(-3, 0), "left": rnd_counter(rnd), "right": rnd_counter(rnd), "nl": 2, "nr": 3, "n": 30, "all": everything, "everything": 90} for w in words}
            slots.append({"pos": pos, "left": "p", "right": "q", "readings": rs})
        for a, b in zip(slots, slots[1:]):
            if b["pos"] == a["pos"] + 1:
                a["right"] = b["left"] = S.LOST

        def score(choice):
            total = 0.0
            for i, (s, w) in enumerate(zip(slots, choice)):
                if w is None:
                    continue
                r = s["readings"][w]
                total += r["score"] + sum(S.affinity(r, k, s[k]) for k in ("left", "right") if s[k] != S.LOST)
                if i and choice[i - 1] and slots[i - 1]["pos"] == s["pos"] - 1:
                    e = slots[i - 1]["readings"][choice[i - 1]]
                    total += (S.affinity(r, "left", e["context"]) + S.affinity(e, "right", r["context"])) / 2
            return total

        best = max(itertools.product(*[list(s["readings"]) or [None] for s in slots]), key=score)
        assert score(S.best_fillings(slots)) == pytest.approx(score(best))


def rnd_counter(rnd):
    return S.Counter({c: rnd.randrange(10) for c in "pqr"})
