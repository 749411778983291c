"""Lattices over the signs of a page's de-lined text: confusions with fitted costs, splits, merges, hyphens; Viterbi."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

from linkloom.functions.patterns import ALL_PATTERNS

# What scanners make of signs, as (read, meant). How often each happens is fitted from the corpus.
CONFUSIONS = [
    ("é", "e"), ("è", "e"), ("í", "i"), ("c", "e"), ("(", "c"), ("f", "t"), ("o", "a"), ("0", "o"), ("1", "i"), ("1", "l"), ("|", "l"), ("|", "i"), ("!", "l"), ("l", "i"), ("i", "l"),
    ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("b", "h"), ("v", "y"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("h", "li"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
]
#: Before any evidence a confusion happens to this share of the signs it may happen to; the evidence of PRIOR signs weighs as much.
USUAL, PRIOR = 0.005, 200.0
#: Pairs of a rare and a frequent form from which confusions are fitted: how many times more frequent the one must be.
FIT_RATIO = 8
#: Share of all words that the corpus holds nowhere else.
UNSEEN = 0.01
#: Forms seen at most so often may be two words run together or a part of one torn apart; words seen so often take part in that.
SELDOM, OFTEN = 2, 8
#: Costs (nats) of running two words together and of tearing one apart.
RUN_TOGETHER, TORN = 4.0, 4.0
#: Log-odds by which the neighbours can speak against a form's own frequency; readings further off are no edges.
CONTEXT = 6.0
#: Costs of a compound that is parted at its hyphen: never seen whole; parts that are no words; a sign compounds aren't written with.
NEW_COMPOUND, NO_WORD, ODD_SIGN = 6.0, 6.0, 4.0
#: Pairs of words that are taken as seen beside what chance gives.
CHANCE = 0.5

BREAKS = "-‐\xad¬"
_CORE = re.compile(r"^[\"'“”‘’\[{(]*(.*?)[\"'“”‘’\]})!?.,;:]*$")
_ID = re.compile("|".join(p.regex for p in ALL_PATTERNS if p.id == "STUDY_ID_SPONSOR_V1"))
_ID_LIKE = re.compile(r"[A-Z0-9|(]{2,5}-[0-9A-Za-z|]{4}-[0-9A-Za-z|]{3,4}")
_TO_DIGIT = str.maketrans("lI|OoSZBbgqzs", "1110052869925")
_TO_LETTER = str.maketrans("01|5862(9", "OIISBGZCG")
_HYPHEN = re.compile(r"[-‐]")


@lru_cache(maxsize=100_000)
def folds(word: str) -> tuple[str, ...]:
    """Keys under which a word and whatever it may be misread as meet; two, since confusions of several signs may overlap."""
    w = unicodedata.normalize("NFKD", word.lower())
    w = "".join(s for s in w if not unicodedata.combining(s))
    w = w.translate(str.maketrans("1|!l0(569", "iiiioesbg")).replace("c", "e").replace("a", "o").replace("f", "t").replace("y", "v").replace("8", "b")
    out = []
    for order in (("ii", "ri"), ("ei", "ri", "ii")):
        x = w.replace("vv", "w")
        for pair in (*order, "ei"):
            x = x.replace(pair, {"ii": "b", "ri": "n", "ei": "d"}[pair])
        out.append(x.replace("rn", "m").replace("u", "b").replace("h", "b"))
    return tuple(dict.fromkeys(out))


def confusions_between(read: str, meant: str) -> tuple[int, ...] | None:
    """The fewest confusions (numbers in CONFUSIONS) that turn ``meant`` into ``read``; None if they can't."""
    start = 0
    while start < len(read) and start < len(meant) and read[start] == meant[start]:
        start += 1
    start = max(0, start - 1)  # an equal sign may still belong to a confusion of several signs
    best: dict[tuple[int, int], tuple[int, ...]] = {(start, start): ()}
    for i in range(start, len(read) + 1):
        for j in range(start, len(meant) + 1):
            at = best.get((i, j))
            if at is None:
                continue
            if i < len(read) and j < len(meant) and read[i] == meant[j]:
                k = (i + 1, j + 1)
                if k not in best or len(best[k]) > len(at):
                    best[k] = at
            for c, (r, m) in enumerate(CONFUSIONS):
                if read.startswith(r, i) and meant.startswith(m, j):
                    k = (i + len(r), j + len(m))
                    if k not in best or len(best[k]) > len(at) + 1:
                        best[k] = (*at, c)
    return best.get((len(read), len(meant)))


@lru_cache(maxsize=200_000)
def core_of(token: str) -> str:
    """A token without outer punctuation, in lower case; an opening bracket that isn't closed stays if letters follow."""
    if token.startswith("(") and ")" not in token and token[1:2].isalpha():
        return "(" + _CORE.match(token)[1].lower()
    core = _CORE.match(token)[1].lower()
    return core[:-2] if core.endswith(("'s", "’s")) else core


def id_like(token: str) -> bool:
    return bool(_ID_LIKE.fullmatch(token.strip(".,;:()\"'[]")))


@lru_cache(maxsize=200_000)
def parts_of(token: str) -> tuple[str, ...]:
    """The words of a token that can be judged: the parts of compounds; numbers, units and study ids are none."""
    core = core_of(token)
    if not core or "/" in core or id_like(token):
        return ()
    return tuple(p for p in _HYPHEN.split(core) if len(p) > 1 and any(s.isalpha() for s in p))


def id_reading(token: str) -> str | None:
    """What a token that looks like a study id but has none of the catalogue's shapes means: digits for letters among the
    digits, letters for digits in the prefix; None if it has a sound shape or that doesn't give one.
    """
    t = token.strip(".,;:()\"'[]")
    if not _ID_LIKE.fullmatch(t) or _ID.fullmatch(t) or sum(s.isdigit() for s in t) < 4:
        return None
    a, b, c = t.split("-")
    fixed = "-".join((a.translate(_TO_LETTER), b.translate(_TO_DIGIT), c.translate(_TO_DIGIT)))
    return fixed if _ID.fullmatch(fixed) else t  # not even so: misread beyond repair


class Slot:
    """One word of the stream: where it stands, its form, and what parts it from the next: a space, a line's end, a hyphen
    inside the token, or a break sign at a line's end (then ``sign``); empty where nothing may join.
    """

    __slots__ = ("page", "line", "token", "form", "glue", "sign", "fragment")

    def __init__(self, page: int, line: int, token: int, form: str):
        self.page, self.line, self.token, self.form, self.glue, self.sign, self.fragment = page, line, token, form, "", "", False


def _lettered(line: str) -> bool:
    return any(s.isalpha() for s in line)


def _breaks(text: str) -> bool:
    t = text.rstrip()
    return len(t) > 1 and t[-1] in BREAKS and (t[-2].isalnum() or t[-2] in "|(éíﬁﬀ")


def stream(page: int, lines: list[dict], nxt: tuple[int, int, str] | None, carried: bool) -> list[Slot]:
    """The words of a page's body without its lines: a word broken at the foot goes on in ``nxt`` (page, line, text), and if
    one came over from the page before (``carried``) the first word here is that page's.
    """
    out: list[Slot] = []
    todo = [(page, x["line_no"], x["text"]) for x in lines]
    last = next((k for k in range(len(todo) - 1, -1, -1) if todo[k][2].strip()), None)
    if last is not None and nxt and _breaks(todo[last][2]):
        todo.append((nxt[0], nxt[1], nxt[2].split()[0] if nxt[2].split() else ""))
    joint: Slot | None = None
    for p, no, text in todo:
        tokens = text.split()
        if joint is not None and tokens and not _lettered(text):
            tokens = []  # figures between the halves of a broken word
        ends = _breaks(text)
        for i, t in enumerate(tokens):
            broken = ends and i == len(tokens) - 1
            parts = parts_of(t.rstrip(BREAKS) if broken else t)
            if joint is not None and i == 0:
                first = _HYPHEN.split(core_of(t))[0]
                if first and any(s.isalpha() for s in first):
                    if not parts or parts[0] != first:
                        parts = (first, *parts)
                else:
                    joint.glue, joint.sign, joint.fragment = "", "", False
            if broken:
                final = _HYPHEN.split(core_of(t.rstrip()[: len(t.rstrip()) - 1]))[-1]
                if final and any(s.isalpha() for s in final) and (not parts or parts[-1] != final):
                    parts = (*parts, final)
                elif not final or not any(s.isalpha() for s in final):
                    broken = False
            if not parts:
                if out and out[-1].glue in (" ", "\n"):
                    out[-1].glue = ""
                continue
            for k, form in enumerate(parts):
                s = Slot(p, no, i, form)
                s.glue = "-" if k + 1 < len(parts) else " " if t[-1:].isalnum() else ""
                out.append(s)
            head = out[-len(parts)]
            if i == 0 and joint is not None and joint.glue == "=":
                head.fragment = True
            if carried and not any(x.page == page for x in out[: -len(parts)]):
                head.fragment = True
            if broken:
                s = out[-1]
                s.glue, s.sign, s.fragment = "=", t.rstrip()[-1], True
        if tokens:
            joint = out[-1] if out and ends and out[-1].glue == "=" and out[-1].line == no and out[-1].page == p else None
            if out and not ends and out[-1].glue == " ":
                out[-1].glue = "\n"
    if out and out[-1].glue == "=":
        out[-1].glue, out[-1].sign, out[-1].fragment = "", "", False
    if carried and out and out[0].fragment and out[0].page == page:
        first = out.pop(0)  # the page before decodes it
        if first.glue == "=" and out:
            out[0].fragment = False
    return out


class Costs:
    """Costs of confusions and of spellings, fitted from the corpus: what confusions did to the signs they may happen to,
    and which letters follow which. Bounded by CONFUSIONS and by 28 x 28 pairs of letters.
    """

    def __init__(self, happened: dict[int, float], chances: dict[int, float], letters: dict[str, float], total: float, kinds: float):
        self.confusion = [-math.log((happened.get(c, 0.0) + USUAL * PRIOR) / (chances.get(c, 0.0) + happened.get(c, 0.0) + PRIOR)) for c in range(len(CONFUSIONS))]
        self.total, self.kinds = max(total, 1.0), max(kinds, 1.0)
        after: Counter[str] = Counter()
        for pair, n in letters.items():
            after[pair[0]] += n
        self.letters, self.after = letters, after

    def channel(self, confusions: tuple[int, ...]) -> float:
        return sum(self.confusion[c] for c in confusions)

    def spelling(self, form: str) -> float:
        """Log-probability of a word's letters, each given the one before."""
        p, x = 0.0, "^" + "".join(map(letter, form)) + "$"
        for a, b in zip(x, x[1:]):
            p += math.log((self.letters.get(a + b, 0) + 0.1) / (self.after.get(a, 0) + 2.8))
        return p

    def unseen(self, form: str) -> float:
        """Log-probability of a word the corpus holds nowhere else."""
        return math.log(UNSEEN) + self.spelling(form)

    def is_word(self, form: str, n: int, expected: float) -> float:
        """Probability that a form seen ``n`` times is a word of its own although confusions of others make it ``expected``
        times: how likely its spelling is among the kinds of words, against how likely so many confusions are. Confusions
        come in clusters, by scan, so their number is taken as geometric.
        """
        odds = math.log(self.kinds) + self.spelling(form) - n * math.log(expected / (1 + expected))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def letter(s: str) -> str:
    return s if "a" <= s <= "z" else "?"


def form_readings(form: str, n: int, bare: int, likely: list[tuple[str, int, tuple[int, ...]]], costs: Costs) -> tuple[float, list[tuple[str, int, float, bool]]]:
    """(own, readings): the form's own count, less what confusions of frequent words explain, less the occurrence that is
    judged and as far as it is a word; and (word, count, cost, differs) of each word it may be a reading of, near enough for neighbours to decide.
    """
    expected = sum(m * math.exp(-costs.channel(c)) for _, m, c in likely)
    own = max(0.0, n - 1 - expected) * (costs.is_word(form, n, expected) if expected else 1.0)
    here = max(math.log(own / costs.total) if own else -math.inf, costs.unseen(form))
    out = [(w, m, costs.channel(c), True) for w, m, c in likely if m > n and math.log(m / costs.total) - costs.channel(c) > here - CONTEXT]
    if form.startswith("(") and bare:
        out.append((form[1:], bare, 0.0, False))
    return own, out


class Facts:
    """What a page's lattice needs to know, looked up in the corpus: readings of forms, counts of words, pairs and compounds."""

    def __init__(self, costs: Costs, found: dict[str, dict]):
        self.costs, self.found = costs, found

    def count(self, key: str) -> int:
        f = self.found.get(key)
        return f["n"] if f and f["n"] else 0

    def readings(self, form: str) -> tuple[float, list[tuple[str, int, float, bool]]] | None:
        f = self.found.get("r:" + form)
        return None if f is None or f["readings"] is None else (f["own"], [(r["word"], r["n"], r["cost"], r["differs"]) for r in f["readings"]])


def edges(slots: list[Slot], i: int, facts: Facts, rare: set[str]) -> list[tuple[int, tuple[str, ...], float, str, str]]:
    """Edges of the lattice from slot i: (slots taken, words, cost without neighbours, what happened, surface form).

    What happened: keep, read (confusions), split, merge, join (the break sign goes) or part (the compound keeps it).
    """
    s, costs, out = slots[i], facts.costs, []
    log = lambda n, form: max(math.log(n / costs.total) if n > 0 else -math.inf, costs.unseen(form))
    known = facts.readings(s.form)
    own = known[0] if known else float(facts.count("w:" + s.form))
    extra = 0.0
    joint = s.glue == "=" and i + 1 < len(slots)
    if joint or (i and slots[i - 1].glue == "="):
        own = float(facts.count("w:" + s.form))  # a fragment isn't among the words counted
    if joint:
        t = slots[i + 1]
        whole = s.form + t.form
        n_pair = facts.count(f"c:{s.form}-{t.form}")
        # both halves' own frequencies come with their edges; a compound that was seen replaces them
        halves = log(facts.count("w:" + s.form), s.form) + log(facts.count("w:" + t.form), t.form)
        if n_pair:
            extra = halves - math.log(n_pair / costs.total)
        else:
            extra = NEW_COMPOUND + NO_WORD * ((facts.count("w:" + s.form) < 2) + (facts.count("w:" + t.form) < 2))
        extra += ODD_SIGN if s.sign != "-" else 0.0
        k = facts.readings(whole)
        out.append((2, (whole,), -log(facts.count("w:" + whole), whole), "join", whole))
        for w, n, cost, differs in k[1] if k else ():
            if differs:
                out.append((2, (w,), cost - math.log(n / costs.total), "join", whole))
    out.append((1, (s.form,), extra - log(own, s.form), "keep", s.form))
    for w, n, cost, differs in known[1] if known else ():
        if s.form.startswith("(") and not differs:
            out.append((1, (w,), extra - math.log(n / costs.total), "keep", s.form))
        elif differs:
            out.append((1, (w,), extra + cost - math.log(n / costs.total), "read", s.form))
    if not joint and s.form in rare:
        f = facts.found.get("r:" + s.form)
        for x in (f or {}).get("splits") or ():
            out.append((1, (x["a"], x["b"]), RUN_TOGETHER - math.log(x["na"] / costs.total) - math.log(x["nb"] / costs.total), "split", s.form))
    if s.glue in (" ", "\n") and i + 1 < len(slots) and not slots[i + 1].fragment and (s.form in rare or slots[i + 1].form in rare):
        whole = s.form + slots[i + 1].form
        n = facts.count("w:" + whole)
        if n >= OFTEN:
            out.append((2, (whole,), TORN - math.log(n / costs.total), "merge", whole))
    return out


def affinity(a: str | None, b: str | None, facts: Facts, own: dict[str, float], surfaces: tuple[str | None, str | None]) -> float:
    """Log of how much more often two words stand together than chance has it; the occurrence judged doesn't count."""
    if a is None or b is None:
        return 0.0
    together = facts.count(f"b:{a} {b}") - (surfaces == (a, b))
    na, nb = (own.get(x, float(facts.count("w:" + x))) for x in (a, b))
    usual = na * nb / facts.costs.total
    return math.log((max(together, 0) + CHANCE) / (usual + CHANCE))


def ambiguous(slots: list[Slot], facts: Facts, rare: set[str]) -> list[bool]:
    """Slots whose lattice has more than the edge of the form as it stands."""
    return [
        s.glue == "=" or (i > 0 and slots[i - 1].glue == "=") or s.form in rare or (i > 0 and slots[i - 1].form in rare and slots[i - 1].glue in (" ", "\n")) or bool((k := facts.readings(s.form)) and k[1])
        for i, s in enumerate(slots)
    ]


def wanted(slots: list[Slot], facts: Facts, rare: set[str]) -> set[str]:
    """Keys of what the lattice asks the corpus for beyond the readings of its forms."""
    open_, keys = ambiguous(slots, facts, rare), set()
    words = [[w for w in {s.form, *(r[0] for r in (facts.readings(s.form) or (0, []))[1])}] for s in slots]
    for i, s in enumerate(slots):
        if open_[i]:
            keys.update("w:" + w for w in words[i])
        if s.glue == "=" and i + 1 < len(slots):
            t = slots[i + 1]
            keys |= {"r:" + s.form + t.form, "w:" + s.form + t.form, f"c:{s.form}-{t.form}"}
        if s.glue in (" ", "\n") and i + 1 < len(slots) and (s.form in rare or slots[i + 1].form in rare):
            keys.add("w:" + s.form + slots[i + 1].form)
        if s.glue and s.glue != "=" and i + 1 < len(slots) and (open_[i] or open_[i + 1]):
            keys.update(f"b:{a} {b}" for a in words[i] for b in words[i + 1])
            keys.update("w:" + w for w in words[i])
            keys.update("w:" + w for w in words[i + 1])
    return keys


def decode(slots: list[Slot], facts: Facts, rare: set[str]) -> list[tuple[int, int, tuple[str, ...], str, str]]:
    """The best path through the lattice: (first slot, slots taken, words, what happened, surface form), in order."""
    open_ = ambiguous(slots, facts, rare)
    n = len(slots)
    best: list[dict[str, tuple[float, tuple | None, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0][""] = (0.0, None, None)
    own = {s.form: k[0] for s in slots if (k := facts.readings(s.form))}
    for i in range(n):
        if not best[i]:
            continue
        s = slots[i]
        near = i > 0 and slots[i - 1].glue in (" ", "\n", "-")
        if not open_[i] and (not near or not open_[i - 1]):
            done = min(best[i].items(), key=lambda x: (x[1][0], x[0]))
            best[i + 1][s.form] = (done[1][0], (i, done[0]), (i, 1, (s.form,), "keep", s.form))
            continue
        options = edges(slots, i, facts, rare) if open_[i] else [(1, (s.form,), 0.0, "keep", s.form)]
        for prev, (cost, _, _) in list(best[i].items()):
            for taken, words, c, what, surface in options:
                if i + taken > n:
                    continue
                beside = (slots[i - 1].form, s.form) if near else (None, None)
                total = cost + c - (affinity(prev or None, words[0], facts, own, beside) if near else 0.0)
                at = best[i + taken]
                if words[-1] not in at or total < at[words[-1]][0]:
                    at[words[-1]] = (total, (i, prev), (i, taken, words, what, surface))
    path, at = [], n
    word = min(best[n].items(), key=lambda x: (x[1][0], x[0]))[0] if n else ""
    while at:
        _, back, edge = best[at][word]
        path.append(edge)
        at, word = back
    return path[::-1]
