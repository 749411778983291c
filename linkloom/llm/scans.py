"""Text of scanned pages: running heads, page numbers, broken and misread words; repaired paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import scan_lattice as L
from linkloom.llm.scan_lattice import folds, id_like
from linkloom.runtime import cut, join_unique, spread

#: Lines from the top and from the foot of a page where running heads and page numbers stand.
MARGIN = 3
#: Distinct counts a task holds before it hands them on.
FLUSH = 300_000
#: A margin line recurs if this share of its scan's pages, and two pages at least, have it.
RECURS = 0.25
#: Costs of paragraph boundaries: each paragraph, a blank line inside one, an end without a full stop, a short line inside
#: one, a start in lower case.
PARAGRAPH, BLANK_INSIDE, OPEN_END, SHORT_INSIDE, LOW_START = 2.0, 5.0, 4.0, 1.0, 4.0

_DIGITS = str.maketrans("lI|OoSZBbgq", "11100528699")
_NUM = r"[0-9lI|OoSZBbgq]{1,4}"
_ROMAN = re.compile(r"[ivxlc]+")
_STYLED = [re.compile(p) for p in (rf"\[\s*({_NUM})\s*\]", rf"\(\s*({_NUM})\s*\)", rf"[-–—]\s*({_NUM})\s*[-–—]", rf"([A-Za-zé]{{1,5}})\.?\s*({_NUM})(?:\s*(?:of|0f|oí|/)\s*{_NUM})?")]
_PLAIN = [re.compile(rf"({_NUM})\s*/\s*{_NUM}"), re.compile(rf"({_NUM})")]


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, whether its form shows that it is one) of a line that holds a number alone, allowing misread digits."""
    t = line.strip()
    for p in _STYLED:
        m = p.fullmatch(t)
        if m:
            if m.re.groups == 2 and not (set(folds(m[1])) & {*folds("page"), *folds("p"), *folds("pg")}):
                continue
            n = m[m.re.groups].translate(_DIGITS)
            return (int(n), True) if n.isdigit() else None
    for p in _PLAIN:
        m = p.fullmatch(t)
        if m and (n := m[1].translate(_DIGITS)).isdigit():
            return int(n), False
    low = t.lower()
    if _ROMAN.fullmatch(low):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        digits = [value[s] for s in low]
        return sum(-d if any(e > d for e in digits[k + 1 : k + 2]) else d for k, d in enumerate(digits)), False
    return None


def head_key(line: str) -> str:
    """What a running head keeps from page to page: its words, without numbers, in folded signs."""
    words = [w for w in re.split(r"\s+", line.strip()) if 3 * sum(s.isdigit() for s in w) < len(w) and not id_like(w)]
    words = [w for w in words if not (set(folds(w)) & {*folds("page"), *folds("of"), *folds("p.")}) and not re.fullmatch(r"[-–—/|lIO\[\]]+", w)]
    if len(words) > 1 and re.fullmatch(r"[-–—(\[]*[ivxlcIVXLC]+[-–—)\]]*", words[-1]):
        words.pop()
    return re.sub(r"\W|_", "", folds("".join(words))[0])


_LINES = pa.schema([("page_id", pa.int64()), ("scan_id", pa.string()), ("page_index", pa.int32()), ("line_no", pa.int32()), ("text", pa.string()), ("margin", pa.bool_()), ("key", pa.string()), ("number", pa.int32()), ("styled", pa.bool_())])
_LINES_DDL = "page_id bigint, scan_id string, page_index int, line_no int, text string, margin boolean, key string, number int, styled boolean"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page, scan, index, text in zip(*(b.column(c).to_pylist() for c in ("page_id", "scan_id", "page_index", "text"))):
            lines = text.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            edge = {*full[:MARGIN], *full[-MARGIN:]}
            for i in full:
                number = page_number(lines[i]) if i in edge else None
                key = head_key(lines[i]) if i in edge else ""
                rows.append((page, scan, index, i, lines[i], i in edge, key if len(key) > 2 else None, number[0] if number else None, number[1] if number else None))
        cols = list(zip(*rows)) if rows else [()] * len(_LINES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LINES)], schema=_LINES)


def page_lines(pages: DataFrame) -> DataFrame:
    """Every line with text of every page, with ``noise`` running_head, page_number or null (body).

    A page counts once (its longest text, if rows of one page_id differ); null texts and pages without page_id give no
    lines; a null scan_id makes the page a scan of its own and a null page_index counts as 0.
    """
    text = F.max(F.struct(F.length("text").alias("n"), "text", "scan_id", "page_index")).alias("p")
    once = pages.where("page_id is not null and text is not null").groupBy("page_id").agg(text).select(
        "page_id", F.coalesce("p.scan_id", F.concat(F.lit("page-"), "page_id")).alias("scan_id"), F.coalesce("p.page_index", F.lit(0)).cast("int").alias("page_index"), "p.text"
    )
    lines = cut(once.mapInArrow(_split, _LINES_DDL))
    n_pages = lines.groupBy("scan_id").agg(F.countDistinct("page_id").alias("pages"))
    edge = lines.where("margin")
    heads = edge.where("key is not null and number is null").groupBy("scan_id", "key").agg(F.countDistinct("page_id").alias("n")).join(n_pages, "scan_id").where(F.col("n") >= F.greatest(F.lit(2.0), F.col("pages") * RECURS)).select("scan_id", "key", F.lit(True).alias("recurs"))
    offset = edge.where("number is not null").groupBy("scan_id", (F.col("number") - F.col("page_index")).alias("offset")).agg(F.countDistinct("page_id").alias("n"))
    offsets = offset.groupBy("scan_id").agg(F.max(F.struct("n", "offset"))["offset"].alias("shift"), F.max("n").alias("support"))
    marked = join_unique(join_unique(edge, cut(heads), ["scan_id", "key"], "left"), cut(offsets), ["scan_id"], "left")
    fits = (F.col("number") - F.col("page_index") == F.col("shift")) & (F.col("support") >= 2)
    noise = F.when(F.col("number").isNotNull() & (F.coalesce("styled", F.lit(False)) | fits), "page_number").when(F.col("recurs") & F.col("number").isNull(), "running_head")
    keep = ["page_id", "scan_id", "page_index", "line_no", "text"]
    return cut(marked.select(*keep, noise.alias("noise")).unionByName(lines.where("not margin").select(*keep, F.lit(None).cast("string").alias("noise"))))


def body_pages(lines: DataFrame) -> DataFrame:
    """(page_id, scan_id, page_index, lines, next_line, next_page, next_no, carried): a page's body lines in order, the line its
    text goes on with, and whether its first word began on the page before. A page without words in its body ends the text
    that would go on there.
    """
    body = lines.where("noise is null")
    pages = body.groupBy("page_id", "scan_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("lines"))  # one page's lines
    worded = F.filter("lines", lambda x: F.rlike(x["text"], F.lit(r"\p{L}")))
    first = pages.where(F.size(worded) > 0).groupBy("scan_id", (F.col("page_index") - 1).alias("page_index")).agg(F.min(F.struct("page_id", F.element_at(worded, 1)["text"].alias("text"), F.element_at(worded, 1)["line_no"].alias("line_no"))).alias("f"))
    whole = pages.join(first, ["scan_id", "page_index"], "left").select("page_id", "scan_id", "page_index", "lines", F.col("f.text").alias("next_line"), F.col("f.page_id").alias("next_page"), F.col("f.line_no").alias("next_no"))
    broken = F.rlike(F.element_at("lines", -1)["text"], F.lit(r"[\p{L}\p{N}|(][-\x{2010}\x{ad}\x{ac}]\s*$"))
    carried = whole.where("next_page is not null").where(broken).select(F.col("next_page").alias("page_id")).distinct().withColumn("carried", F.lit(True))
    return cut(whole.join(carried, "page_id", "left").withColumn("carried", F.coalesce("carried", F.lit(False))))


def _pages(b: pa.RecordBatch) -> Iterator[tuple[dict, list[L.Slot]]]:
    for r in b.to_pylist():
        yield r, L.stream(r["page_id"], r["lines"], (r["next_page"], r["next_no"], r["next_line"]) if r["next_line"] else None, r["carried"])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


_COUNT = pa.schema([("key", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (w:), pairs of neighbours (b:), compounds (c:) and of words broken over lines (j:)."""
    seen: Counter[str] = Counter()
    for b in batches:
        for _, slots in _pages(b):
            for i, s in enumerate(slots):
                later = slots[i + 1] if i + 1 < len(slots) else None
                joined = i > 0 and slots[i - 1].glue == "="
                if not s.fragment and not joined:
                    seen["w:" + s.form] += 1
                if s.glue == "=" and later:
                    seen["j:" + s.form + later.form] += 1
                elif s.glue and later:
                    seen[f"b:{s.form} {later.form}"] += 1
                if s.glue == "-" and not (i and slots[i - 1].glue == "-"):
                    k = i
                    while k + 1 < len(slots) and slots[k].glue == "-":
                        k += 1
                    seen["c:" + "-".join(x.form for x in slots[i : k + 1])] += 1
        if len(seen) > FLUSH:
            yield _rows(list(seen.items()), _COUNT)
            seen.clear()
    yield _rows(list(seen.items()), _COUNT)


_FOLD = pa.schema([("fold", pa.string()), ("form", pa.string()), ("n", pa.int64())])


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _rows([(k, w, n) for w, n in zip(b.column("form").to_pylist(), b.column("n").to_pylist()) for k in folds(w)], _FOLD)


_PAIR = pa.schema([("form", pa.string()), ("n", pa.int64()), ("word", pa.string()), ("m", pa.int64()), ("confusions", pa.list_(pa.int32()))])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for form, n, word, m in zip(*(b.column(c).to_pylist() for c in ("form", "n", "word", "m"))):
            c = L.confusions_between(form, word)
            if c:
                rows.append((form, n, word, m, c))
        yield _rows(rows, _PAIR)


def _chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the signs of each confusion (k) and each pair of letters (l) occur."""
    seen: Counter[str] = Counter()
    for b in batches:
        for form, n in zip(b.column("form").to_pylist(), b.column("n").to_pylist()):
            for k, (_, meant) in enumerate(L.CONFUSIONS):
                if meant in form:
                    seen[f"k{k}"] += n * form.count(meant)
            x = "^" + "".join(map(L.letter, form)) + "$"
            for i in range(len(x) - 1):
                seen["l" + x[i : i + 2]] += n
    yield _rows(list(seen.items()), _COUNT)


def fitted_costs(lexicon: DataFrame, pairs: DataFrame) -> L.Costs:
    """Costs of confusions from aligned pairs of rare and frequent forms, each rare form paired with its most frequent one.
    What comes to the driver is a row per confusion and per pair of letters, under 900 in all.
    """
    clear = pairs.where((F.col("n") > 0) & (F.col("m") >= L.FIT_RATIO * F.col("n"))).groupBy("form").agg(F.max(F.struct("m", "word", "n", "confusions")).alias("p"))
    happened = clear.select(F.col("p.n").alias("n"), F.explode("p.confusions").alias("c")).groupBy(F.concat(F.lit("h"), "c").alias("key")).agg(F.sum("n").alias("n"))
    chances = lexicon.mapInArrow(_chances, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    sums = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("k"))
    rows = happened.unionByName(chances).unionByName(sums.select(F.lit("t").alias("key"), F.col("t").alias("n"))).unionByName(sums.select(F.lit("s").alias("key"), F.col("k").alias("n"))).collect()
    of = lambda kind, key=lambda x: x: {key(r.key[1:]): float(r.n) for r in rows if r.key[0] == kind}
    return L.Costs(of("h", int), of("k", int), of("l"), of("t").get("", 0.0), of("s").get("", 0.0))


_FACT_DDL = "key string, n bigint, own double, readings array<struct<word:string,n:bigint,cost:double,differs:boolean>>, splits array<struct<a:string,b:string,na:bigint,nb:bigint>>"
_READING = pa.struct([("word", pa.string()), ("n", pa.int64()), ("cost", pa.float64()), ("differs", pa.bool_())])
_SPLIT = pa.struct([("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64())])
_FACT = pa.schema([("key", pa.string()), ("n", pa.int64()), ("own", pa.float64()), ("readings", pa.list_(_READING)), ("splits", pa.list_(_SPLIT))])


def _readings(costs: L.Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for form, n, bare, likely, splits in zip(*(b.column(c).to_pylist() for c in ("form", "n", "bare", "likely", "splits"))):
                own, readings = L.form_readings(form, n, bare or 0, [(x["word"], x["m"], tuple(x["confusions"])) for x in likely or ()], costs)
                if readings or splits or 0 < n <= L.SELDOM:
                    rows.append(("r:" + form, n, own, [dict(zip(("word", "n", "cost", "differs"), r)) for r in readings], splits))
            yield _rows(rows, _FACT)

    return run


def corpus_facts(counts: DataFrame) -> tuple[DataFrame, DataFrame, L.Costs]:
    """(readings, facts, costs) from the counts of the whole corpus. readings: a row per form that is rare or may be a reading
    of other words; facts: the counts by key and the readings. All candidates meet by equal folded signs.
    """
    words = counts.where("key like 'w:%'").select(F.expr("substring(key, 3)").alias("form"), "n")
    lexicon = cut(words)
    joined = counts.where("key like 'j:%'").select(F.expr("substring(key, 3)").alias("form")).join(lexicon, "form", "left_anti").select("form", F.lit(0).cast("bigint").alias("n"))
    forms = cut(lexicon.unionByName(joined))
    ddl = "fold string, form string, n bigint"
    known = lexicon.where("n >= 2 and form rlike '^[A-Za-z]+$'").mapInArrow(_fold_rows, ddl).select("fold", F.col("form").alias("word"), F.col("n").alias("m"))
    met = forms.mapInArrow(_fold_rows, ddl).join(known, "fold").where("m > n and form <> word and abs(length(form) - length(word)) <= length(form)").select("form", "n", "word", "m").distinct()
    pairs = cut(met.mapInArrow(_align, "form string, n bigint, word string, m bigint, confusions array<int>"))
    costs = fitted_costs(lexicon, pairs)
    often = lexicon.where(F.col("n") >= L.OFTEN)
    cuts = lexicon.where((F.col("n") <= L.SELDOM) & (F.length("form") >= 6)).withColumn("k", F.explode(F.sequence(F.lit(2), F.length("form") - 2))).select("form", F.expr("left(form, k)").alias("a"), F.expr("substring(form, k + 1)").alias("b"))
    halves = cuts.join(often.toDF("a", "na"), "a").join(often.toDF("b", "nb"), "b").groupBy("form").agg(F.collect_list(F.struct("a", "b", "na", "nb")).alias("splits"))  # at most one per letter
    alike = pairs.groupBy("form").agg(F.collect_list(F.struct("word", "m", "confusions")).alias("likely"))  # more frequent words of the same folded signs
    bare = lexicon.where("n >= 2").select(F.concat(F.lit("("), "form").alias("form"), F.col("n").alias("bare"))
    asked = forms.join(alike, "form", "left").join(bare, "form", "left").join(halves, "form", "left").where(F.col("likely").isNotNull() | F.col("bare").isNotNull() | F.col("splits").isNotNull() | (F.col("n") <= L.SELDOM))
    readings = cut(spread(cut(asked)).mapInArrow(_readings(costs), _FACT_DDL))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("own", "double"), ("readings", readings.schema["readings"].dataType), ("splits", readings.schema["splits"].dataType))]
    return readings, counts.where("key not like 'j:%'").select("key", "n", *none).unionByName(readings), costs


_KEYS = pa.schema([("page_id", pa.int64()), ("key", pa.string())])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _rows([(r["page_id"], k) for r, slots in _pages(b) for k in sorted({"r:" + s.form for s in slots})], _KEYS)


def _facts(costs: L.Costs, *found: list[dict] | None) -> tuple[L.Facts, set[str]]:
    known = {f["key"]: f for fs in found for f in fs or ()}
    return L.Facts(costs, known), {k[2:] for k, f in known.items() if k[:2] == "r:" and f["n"] and f["n"] <= L.SELDOM}


def _wants(costs: L.Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(r["page_id"], k) for r, slots in _pages(b) for k in sorted(L.wanted(slots, *_facts(costs, r["found"])))], _KEYS)

    return run


_DONE_DDL = "page_id bigint, scan_id string, page_index int, noise array<struct<page_id:bigint,line_no:int,noise:string>>, said array<struct<line_no:int,text:string,source:string>>, next_line string"
_NOISE = pa.struct([("page_id", pa.int64()), ("line_no", pa.int32()), ("noise", pa.string())])
_SAID = pa.struct([("line_no", pa.int32()), ("text", pa.string()), ("source", pa.string())])
_DONE = pa.schema([("page_id", pa.int64()), ("scan_id", pa.string()), ("page_index", pa.int32()), ("noise", pa.list_(_NOISE)), ("said", pa.list_(_SAID)), ("next_line", pa.string())])


def _like(token: str, old: str, new: str) -> str:
    """``token`` with the word ``old`` in it replaced, its capitals and punctuation kept."""
    at = token.lower().find(old)
    if at < 0:
        return token
    seen = token[at : at + len(old)]
    new = new.upper() if seen.isupper() and len(seen) > 1 else new[:1].upper() + new[1:] if seen[:1].isupper() else new
    return token[:at] + new + token[at + len(old) :]


def read_path(page: dict, slots: list[L.Slot], path: list[tuple[int, int, tuple[str, ...], str, str]]) -> tuple[set[tuple[int, int, str]], dict[int, list[str]]]:
    """(noise, tokens): what the best path says about lines as (page, line, noise), and the repaired tokens of each line."""
    noise: set[tuple[int, int, str]] = set()
    tokens = {x["line_no"]: x["text"].split() for x in page["lines"]}
    after = (page["next_line"] or "").split()
    for x in page["lines"]:
        for i, t in enumerate(tokens[x["line_no"]]):
            fixed = L.id_reading(t)
            if fixed:
                noise.add((page["page_id"], x["line_no"], "char_error"))
                tokens[x["line_no"]][i] = t.replace(t.strip(".,;:()\"'[]"), fixed)

    def at(s: L.Slot) -> str:
        if s.page != page["page_id"]:
            return after[0] if after else ""
        return tokens[s.line][s.token]

    def put(s: L.Slot, text: str) -> None:
        if s.page == page["page_id"]:
            tokens[s.line][s.token] = text

    if page["carried"] and page["lines"] and (not slots or (slots[0].line, slots[0].token) != (page["lines"][0]["line_no"], 0)):
        line = next((x["line_no"] for x in page["lines"] if L._lettered(x["text"])), None)
        if line is not None and tokens[line]:
            tokens[line][0] = ""  # it stands on the page before
    for i, taken, words, what, surface in path:
        s = slots[i]
        z = slots[i + 1] if i + 1 < len(slots) else None
        if what in ("read", "split"):
            put(s, _like(at(s), surface, " ".join(words)))
            if what == "read":
                noise.add((s.page, s.line, "char_error"))
        elif what == "merge":
            put(s, at(s) + at(z))
            put(z, "")
        elif what == "join":
            noise.add((s.page, s.line, "hyphen_break"))
            w, rest = words[0], at(z)
            put(s, _like(at(s).rstrip(L.BREAKS), s.form, w) + rest[rest.lower().find(z.form) + len(z.form) :])
            put(z, "")
            if w != surface:
                if not w.startswith(s.form):
                    noise.add((s.page, s.line, "char_error"))
                if w.startswith(s.form) or not w.endswith(z.form):
                    noise.add((z.page, z.line, "char_error"))
    for i, s in reversed(list(enumerate(slots))):
        if s.glue == "=" and i + 1 < len(slots) and at(s)[-1:] in L.BREAKS and at(s):
            put(s, at(s).rstrip(L.BREAKS) + "-" + at(slots[i + 1]))
            put(slots[i + 1], "")
    return noise, tokens


def _decode(costs: L.Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, slots in _pages(b):
                noise, tokens = read_path(r, slots, L.decode(slots, *_facts(costs, r["found"], r["more"])))
                said = [{"line_no": x["line_no"], "text": " ".join(t for t in tokens[x["line_no"]] if t), "source": x["text"]} for x in r["lines"]]
                rows.append((r["page_id"], r["scan_id"], r["page_index"], [dict(zip(("page_id", "line_no", "noise"), x)) for x in sorted(noise)], said, r["next_line"]))
            yield _rows(rows, _DONE)

    return run


def decoded_pages(bodies: DataFrame) -> DataFrame:
    """The best path through the lattice of each page's de-lined text: its noise by line and its repaired lines.

    Words, pairs of neighbours, compounds and confusions are counted over all pages; each page then asks for the readings of
    its forms, and for the counts its lattice compares, through joins in which frequent words are spread.
    """
    bodies = spread(bodies)
    counts = cut(bodies.mapInArrow(_count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    readings, facts, costs = corpus_facts(counts)
    fact = F.struct("key", "n", "own", "readings", "splits")
    asked = cut(bodies.mapInArrow(_forms, "page_id bigint, key string"))
    found = join_unique(asked, readings, ["key"]).groupBy("page_id").agg(F.collect_list(fact).alias("found"))  # one page's forms
    first = cut(bodies.join(found, "page_id", "left"))
    wants = cut(spread(first).mapInArrow(_wants(costs), "page_id bigint, key string"))
    more = join_unique(wants, facts, ["key"]).groupBy("page_id").agg(F.collect_list(fact).alias("more"))  # one page's
    return cut(spread(cut(first.join(more, "page_id", "left"))).mapInArrow(_decode(costs), _DONE_DDL))


def scan_noise(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, noise): hyphen_break, char_error, running_head or page_number, each at most once per line.

    Errors and breaks are read off the best path of decoded_pages. Empty tables give no rows; further columns are ignored;
    empty lines are counted but are no noise.
    """
    lines = page_lines(pages)
    done = decoded_pages(body_pages(lines))
    return lines.where("noise is not null").select("page_id", "line_no", "noise").unionByName(done.select(F.explode("noise").alias("x")).select("x.*")).distinct()


def paragraph_ends(lines: list[dict]) -> list[int]:
    """Dynamic programming over a page's body lines: the ends (exclusive) of its paragraphs. Linear: what a paragraph costs
    inside is a difference of sums, so the best start for each end is the best so far.
    """
    width = max((len(x["text"]) for x in lines), default=0)
    closed = [x["text"].rstrip()[-1:] in '.!?:"”' for x in lines]
    gap = [k > 0 and x["line_no"] - lines[k - 1]["line_no"] > 1 for k, x in enumerate(lines)]
    low = [x["text"].lstrip()[:1].islower() for x in lines]
    inside = [0.0]
    for k in range(1, len(lines)):
        inside.append(inside[-1] + (BLANK_INSIDE if gap[k] else 0) + (SHORT_INSIDE if closed[k - 1] and len(lines[k - 1]["text"]) < 0.7 * width else 0))
    best, back, lead = [0.0], [0], (float("inf"), 0)
    for end in range(1, len(lines) + 1):
        j = end - 1
        lead = min(lead, (best[j] + (LOW_START if j and low[j] else 0) - inside[j], j))
        tail = OPEN_END if end < len(lines) and not closed[end - 1] else 0.0
        best.append(lead[0] + PARAGRAPH + tail + inside[end - 1])
        back.append(lead[1])
    ends, k = [], len(lines)
    while k:
        ends.append(k)
        k = back[k]
    return ends[::-1]


_PARTS = pa.schema([("scan_id", pa.string()), ("page_index", pa.int32()), ("page_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("n_parts", pa.int32()), ("open", pa.bool_()), ("n_lines", pa.int32())])


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            source = [{"line_no": x["line_no"], "text": x["source"]} for x in r["said"]]
            if not source:
                continue
            ends, start = paragraph_ends(source), 0
            last = source[-1]["text"].rstrip()
            is_open = bool(r["next_line"]) and (last[-1:] not in '.!?:"”' or r["next_line"].lstrip()[:1].islower())
            for k, end in enumerate(ends):
                rows.append((r["scan_id"], r["page_index"], r["page_id"], k, " ".join(x["text"] for x in r["said"][start:end] if x["text"]), len(ends), is_open, end - start))
                start = end
        yield _rows(rows, _PARTS)


def scan_paragraphs(pages: DataFrame) -> DataFrame:
    """(scan_id, para_no, text, n_lines): each scan's text as continuous paragraphs, without running heads and page numbers,
    with broken words joined and misread ones restored, by the best path of decoded_pages. Study ids that can't be read for
    certain stay as they are.

    Paragraphs go on over pages. They are numbered by sums over blocks of 1024 pages, so a scan that holds many pages is
    not one task. Empty tables give no rows.
    """
    done = decoded_pages(body_pages(page_lines(pages)))
    parts = cut(done.mapInArrow(_paragraphs, "scan_id string, page_index int, page_id bigint, part int, text string, n_parts int, open boolean, n_lines int"))
    heads = parts.where("part = 0").select("scan_id", "page_index", "page_id", "n_parts", "open")
    goes_on = heads.where("open").groupBy("scan_id", (F.col("page_index") + 1).alias("page_index")).agg(F.lit(1).alias("joined"))
    counted = heads.join(goes_on, ["scan_id", "page_index"], "left").withColumn("joined", F.coalesce("joined", F.lit(0))).withColumn("starts", F.col("n_parts") - F.col("joined")).withColumn("block", F.shiftright("page_index", 10))
    blocks = counted.groupBy("scan_id", "block").agg(F.sum("starts").alias("starts"))
    earlier = blocks.select("scan_id", "block", F.coalesce(F.sum("starts").over(Window.partitionBy("scan_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("starts").over(Window.partitionBy("scan_id", "block").orderBy("page_index", "page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counted.withColumn("before", inside).join(earlier, ["scan_id", "block"]).select("page_id", (F.col("before") + F.col("earlier") - F.col("joined")).alias("base"))
    piece = F.struct("page_index", "page_id", "part", "text")
    return (
        parts.join(numbered, "page_id").groupBy("scan_id", (F.col("base") + F.col("part")).alias("para_no"))
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("n_lines").alias("n_lines"))  # one paragraph's pieces
        .select("scan_id", "para_no", F.array_join(F.transform("pieces", lambda x: x["text"]), " ").alias("text"), "n_lines")
    )
