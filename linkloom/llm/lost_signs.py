"""Lost signs (U+FFFD) as wildcards: filled by forms of sound texts, weighed with the neighbouring words."""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import cut, join_unique

LOST = "�"
GAP = re.compile(r"[ \t\r\n]+")
#: Distinct counts a task holds before it hands them on, and chunks it remembers.
FLUSH, MEMORY = 300_000, 100_000

_DIGIT = re.compile(r"\d")
_BEYOND = re.compile(r"[^\x00-\x7f]")


def split(text: str) -> list[str]:
    return GAP.split(text) if "\t" in text or "\r" in text or "\n" in text else text.split(" ")


def core(chunk: str) -> str:
    """A chunk without ASCII punctuation around it, composed, digits alike; the chunk itself if nothing else is in it."""
    chunk = unicodedata.normalize("NFC", chunk)
    return _DIGIT.sub("0", chunk.strip(string.punctuation) or chunk)


def _lower(form: str) -> str:
    return "".join(x if len(x := s.lower()) == 1 else s for s in form)


def context(chunk: str) -> str:
    """The form under which a neighbour is counted."""
    return _lower(core(chunk))


def skeleton(form: str) -> str:
    """What forms that differ only in signs beyond ASCII, and in case, share."""
    return _BEYOND.sub(LOST, _lower(form))


def _merges(signs: str) -> bool:
    """Whether bytes of these signs, read as UTF-8, leave one lost sign: a lead byte with some of its rest."""
    try:
        return signs.encode("cp1252").decode("utf-8", "replace") == LOST
    except UnicodeEncodeError:
        return False


def units(form: str) -> list[str]:
    """A form's signs; those that are lost as one are together."""
    out, i = [], 0
    while i < len(form):
        k = next((k for k in (3, 2) if i + k <= len(form) and form[i] >= "à" and _merges(form[i : i + k])), 1)
        out.append(form[i : i + k])
        i += k
    return out


def skeletons(form: str) -> set[str]:
    """Under which a form is looked up: each sign lost on its own, and as bytes of one single-byte encoding are lost."""
    parts = units(form)
    return {skeleton(form)} | ({skeleton("".join(u if len(u) == 1 else LOST for u in parts))} if len(parts) < len(form) else set())


def _kind(s: str) -> str:
    return "L" if s.isalpha() or s == LOST else "D" if s.isdigit() else "S"


def edges(form: str) -> list[tuple[str, str]]:
    """(place, sign) of signs beyond ASCII, no letters, that begin or end a form."""
    out = []
    if len(form) > 1:
        out += [("^" + _kind(form[1]), form[0])] if form[0] >= "\x80" and not form[0].isalnum() else []
        out += [(_kind(form[-2]) + "$", form[-1])] if form[-1] >= "\x80" and not form[-1].isalnum() else []
    return out


def lookups(chunk: str) -> list[tuple[str, str, str, str]]:
    """(core, skeleton, place of a lost sign before, place of one after) of the ways to look a chunk up: whole, or with a
    lost first or last sign taken as one that stands around a word, or the last one as a letter and such a sign.
    """
    whole, out = core(chunk), []
    for i in (0, 1):
        for j in (0, 1, 2):
            inner = whole[i : len(whole) - j % 2]
            if (i and whole[0] != LOST) or (j and whole[-1] != LOST) or ((i or j) and not any(s.isalnum() for s in inner)):
                continue
            out.append((inner, skeleton(inner), "^" + _kind(whole[1]) if i else "", "L$" if j == 2 else _kind(whole[-2]) + "$" if j else ""))
    return out


def filling(inner: str, form: str) -> list[str] | None:
    """What of ``form`` stands at the lost places of ``inner``, in its case; None if the two differ elsewhere."""
    parts = list(form) if len(form) == len(inner) else units(form)
    if len(inner) != len(parts) or any(a != LOST and _lower(a) != _lower(b) for a, b in zip(inner, parts)):
        return None
    rest = [(a, b) for a, b in zip(inner, parts) if a != LOST and a.isalpha()]
    signs = [b for a, b in zip(inner, parts) if a == LOST]
    if all(a == b for a, b in rest):
        return signs
    if len(rest) > 1 and all(a.isupper() for a, _ in rest):
        return [x if len(x := s.upper()) == len(s) else s for s in signs]
    return [s if i == 0 and inner[0] == LOST else _lower(s) for i, s in enumerate(signs)]


def fill(chunk: str, signs: list[str]) -> str:
    it = iter(signs)
    return "".join(next(it) if s == LOST else s for s in chunk)


def readings(chunk: str, found: list[dict], total: float) -> dict[str, dict]:
    """Fillings of a chunk: text to its log-frequency and what its forms' neighbours are. ``found``: per lookup its
    ``inner``, ``forms`` (form, n, nl, nr), ``before`` and ``after`` (sign, n), ``left`` and ``right`` (form, context, n).
    """
    out: dict[str, dict] = {}
    for v in found:
        ends = []
        for k in ("before", "after"):
            ends.append([("", 0.0)] if v[k] is None else [(s["form"], math.log(s["n"] / total)) for s in v[k]])
        cells = {k: Counter() for k in ("left", "right")}
        byform: dict[str, dict[str, Counter]] = {}
        for k in cells:
            for c in v[k] or ():
                byform.setdefault(c["form"], {"left": Counter(), "right": Counter()})[k][c["context"]] += c["n"]
        joined = v["inner"].count(LOST) + (v["before"] is not None) + (v["after"] is not None) > chunk.count(LOST)
        whole: dict[tuple[str, ...], dict] = {}
        for f in v["forms"] or ():
            signs = filling(v["inner"], f["form"])
            if signs is None:
                continue
            signs = tuple(signs)
            w = whole.setdefault(signs, {"n": 0, "left": Counter(), "right": Counter(), "nl": 0, "nr": 0})
            w["n"], w["nl"], w["nr"] = w["n"] + f["n"], w["nl"] + f["nl"], w["nr"] + f["nr"]
            for k in cells:
                w[k].update(byform.get(f["form"], {}).get(k, {}))
        everything = sum(w["n"] for w in whole.values())
        for k in cells:
            for w in whole.values():
                cells[k].update(w[k])
        for signs, w in whole.items():
            for a, la in ends[0]:
                for z, lz in ends[1]:
                    if joined and not _merges(signs[-1] + z):
                        continue
                    fills = ([] if v["before"] is None else [a]) + list(signs) + ([] if v["after"] is None or joined else [z])
                    if joined:
                        fills[-1] += z
                    text, score = fill(chunk, fills), math.log(w["n"] / total) + la + lz
                    if text not in out or score > out[text]["score"]:
                        out[text] = {"text": text, "score": score, "context": context(text), **w, "all": cells, "everything": everything}
    return out


def affinity(r: dict, side: str, neighbour: str) -> float:
    """Log of how much likelier a neighbour is beside this filling than beside all of the same skeleton (Witten-Bell)."""
    usual = (r["all"][side][neighbour] + 1) / (r["everything"] + 1)
    kinds = r["nl" if side == "left" else "nr"] + 1
    return math.log((r[side][neighbour] / usual + kinds) / (r["n"] + kinds))


def best_fillings(slots: list[dict]) -> list[str | None]:
    """Viterbi over the damaged chunks of a text, in order: each slot has ``pos``, ``left`` and ``right`` (contexts) and
    ``readings``. Chunks next to each other are settled together; a chunk without readings stands as it is (None).
    """
    back: list[dict[str, str | None]] = []
    best: dict[str, float] = {}
    for i, s in enumerate(slots):
        joint = i > 0 and slots[i - 1]["pos"] == s["pos"] - 1 and slots[i - 1]["readings"]
        new, came = {}, {}
        for text, r in s["readings"].items():
            node = r["score"] + (affinity(r, "right", s["right"]) if LOST not in s["right"] else 0.0)
            if joint:
                earlier = slots[i - 1]["readings"]
                pair = lambda t: best[t] + (affinity(r, "left", earlier[t]["context"]) + affinity(earlier[t], "right", r["context"])) / 2  # noqa: B023, E731
                came[text] = max(earlier, key=lambda t: (pair(t), t))
                new[text] = node + pair(came[text])
            else:
                came[text] = None
                new[text] = node + (affinity(r, "left", s["left"]) if LOST not in s["left"] else 0.0)
        back.append(came)
        best = new
        s["best"] = max(new, key=lambda t: (new[t], t)) if new else None
    out: list[str | None] = [None] * len(slots)
    for i in range(len(slots) - 1, -1, -1):
        following = out[i + 1] if i + 1 < len(slots) and slots[i + 1]["pos"] == slots[i]["pos"] + 1 else None
        out[i] = back[i + 1][following] if following is not None and back[i + 1][following] is not None else slots[i]["best"]
    return out


class Evidence:
    """Counts (skeleton, form, side, context) of the forms beyond ASCII in sound texts; edges count under their place, all
    chunks under the empty one."""

    def __init__(self) -> None:
        self.counts: Counter[tuple[str, str, str, str]] = Counter()
        self.known: dict[str, tuple[set, str, list]] = {}
        self.contexts: dict[str, str] = {"": ""}

    def beside(self, chunk: str) -> str:
        if (c := self.contexts.get(chunk)) is None:
            if len(self.contexts) > MEMORY:
                self.contexts.clear()
            c = self.contexts[chunk] = context(chunk)
        return c

    def add(self, text: str) -> None:
        if text.isascii():
            return
        chunks, counts = split(text), self.counts
        for i, c in enumerate(chunks):
            if c.isascii() or LOST in c:
                continue
            if (k := self.known.get(c)) is None:
                if len(self.known) > MEMORY:
                    self.known.clear()
                form = core(c)
                k = self.known[c] = (skeletons(form), form, edges(form))
            counts["", "", "", ""] += 1
            left, right = self.beside(chunks[i - 1]) if i else "", self.beside(chunks[i + 1]) if i + 1 < len(chunks) else ""
            for key in k[0]:
                counts[key, k[1], "", ""] += 1
                counts[key, k[1], "left", left] += 1
                counts[key, k[1], "right", right] += 1
            for place, sign in k[2]:
                counts[place, sign, "", ""] += 1


_SLOT = "doc_id bigint, pos int, raw string, left string, right string, left_key string, right_key string"
_COUNT = "key string, form string, side string, context string, n bigint"
_LOOKUP = "raw string, left_key string, right_key string, v int, part string, key string, side string, beside string"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, fixes in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "fixes"))):
            chunks = split(text)
            for f in fixes:
                chunks[f["pos"]] = f["text"]
            for f in fixes:
                if LOST in f["text"]:
                    i = f["pos"]
                    left, right = context(chunks[i - 1]) if i else "", context(chunks[i + 1]) if i + 1 < len(chunks) else ""
                    rows.append((doc_id, i, f["text"], left, right, skeleton(left), skeleton(right)))
        yield _batch(rows, ["doc_id", "pos", "raw", "left", "right", "left_key", "right_key"], [pa.int64(), pa.int32()] + [pa.string()] * 5)


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split(" ")[0] for x in _LOOKUP.split(", ")], [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 4
    for b in batches:
        rows = []
        for raw, left, right in zip(*(b.column(c).to_pylist() for c in ("raw", "left_key", "right_key"))):
            for v, (_, key, before, after) in enumerate(lookups(raw)):
                asked = [("forms", key, "", ""), ("left", key, "left", left), ("right", key, "right", right)]
                asked += [(part, place, "", "") for part, place in (("before", before), ("after", after)) if place]
                rows += [(raw, left, right, v, *a) for a in asked]
        yield _batch(rows, names, types)


def _together(raw: str, parts: list[dict]) -> list[dict]:
    """What ``readings`` takes: the parts found, by lookup; an edge that was asked for but is unknown gives no signs."""
    found = []
    for v, (inner, _, before, after) in enumerate(lookups(raw)):
        f = {"inner": inner, "forms": [], "left": [], "right": [], "before": [] if before else None, "after": [] if after else None}
        found.append(f | {p["part"]: p["cells"] for p in parts if p["v"] == v})
    return found


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["key", "form", "side", "context", "n"], [pa.string()] * 4 + [pa.int64()]
    e = Evidence()

    def flush() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in e.counts.items()]
        e.counts.clear()
        return _batch(rows, names, types)

    for b in batches:
        for text in b.column("text").to_pylist():
            e.add(text)
            if len(e.counts) > FLUSH:
                yield flush()
    yield flush()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, total, slots in zip(*(b.column(c).to_pylist() for c in ("doc_id", "total", "slots"))):
            slots.sort(key=lambda s: s["pos"])
            for s in slots:
                s["readings"] = readings(s["raw"], _together(s["raw"], s["found"]), float(total))
            rows += [(doc_id, s["pos"], text) for s, text in zip(slots, best_fillings(slots)) if text is not None]
        yield _batch(rows, ["doc_id", "pos", "text"], [pa.int64(), pa.int32(), pa.string()])


def fill_lost(documents: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, pos, text) of the chunks of ``fixes`` (doc_id, fixes) whose lost signs known forms fill.

    Every lost sign is a wildcard. Its fillings are forms of the documents that ``fixes`` does not name, so no garbled form
    is among them; each is weighed by its count and by the counts beside its neighbours, chunks next to each other jointly.
    Forms are met by skeleton through joins; what is broadcast is one row and the bounded heavy keys.
    """
    damaged = fixes.where(F.exists("fixes", lambda f: F.contains(f["text"], F.lit(LOST))))
    slots = cut(documents.where("text is not null").select("doc_id", "text").join(damaged, "doc_id").mapInArrow(_slots, _SLOT))
    ways = cut(slots.select("raw", "left_key", "right_key").distinct().mapInArrow(_lookups, _LOOKUP))
    keys = ways.select("key").union(ways.select(F.lit("").alias("key")).limit(1)).distinct()

    sound = documents.where("length(text) < octet_length(text)").select("doc_id", "text").join(fixes.select("doc_id"), "doc_id", "left_anti")
    counts = sound.select("text").mapInArrow(_evidence, _COUNT).groupBy("key", "form", "side", "context").agg(F.sum("n").alias("n"))
    counts = cut(counts.join(keys, "key", "left_semi"))  # summed before, so that a key's rows are distinct
    total = counts.where("key = ''").agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    times = lambda s: F.count(F.when(F.col("side") == s, 1))
    forms = counts.groupBy("key", "form").agg(F.coalesce(F.sum(F.when(F.col("side") == "", F.col("n"))), F.lit(0)).alias("n"), times("left").alias("nl"), times("right").alias("nr"))
    beside = F.regexp_replace("context", r"[^\x{0}-\x{7f}]", LOST).alias("beside")
    zero = F.lit(0).cast("long")
    cells = forms.select("key", F.lit("").alias("side"), F.lit("").alias("beside"), "form", F.lit("").alias("context"), "n", "nl", "nr").unionByName(
        counts.where("side <> ''").select("key", "side", beside, "form", "context", "n", zero.alias("nl"), zero.alias("nr"))
    )
    cells = cells.join(ways.select("key", "side", "beside").distinct(), ["key", "side", "beside"], "left_semi")
    known = cells.groupBy("key", "side", "beside").agg(F.collect_list(F.struct("form", "context", "n", "nl", "nr")).alias("cells"))  # signs that fit one skeleton
    found = join_unique(ways, cut(known), ["key", "side", "beside"]).groupBy("raw", "left_key", "right_key").agg(F.collect_list(F.struct("v", "part", "cells")).alias("found"))
    met = join_unique(slots, cut(found), ["raw", "left_key", "right_key"])
    texts = met.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "raw", "left", "right", "found")).alias("slots"))  # one document's chunks
    return texts.crossJoin(F.broadcast(total)).mapInArrow(_settle, "doc_id bigint, pos int, text string")  # total: one row
