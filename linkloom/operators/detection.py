"""References in text units: spans of patterns, guards, overlap resolution, cascade, citations. JVM expressions throughout."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.runtime import spread


def text_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, text): the lines with text of each document, counted from 0. Null and blank texts have none."""
    lines = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return lines.where(F.trim("text") != "")


def spans(text: Column, regex: str) -> Column:
    """All matches of a pattern as array of struct(span_start, span_end, text): code points from 0, half-open, left to right.

    The gaps between matches come from a split at the pattern; positions are running sums of gap and match lengths. For
    patterns that can't match nothing. Null text gives null, text without a match an empty array.
    """
    return _positions(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1))


def _positions(hits: Column, gaps: Column) -> Column:
    size = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + F.length(x))

    def place(both: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            start = size(F.slice(both["gaps"], 1, i + 1)) + size(F.slice(both["hits"], 1, i))
            return F.struct(start.alias("span_start"), (start + F.length(hit)).alias("span_end"), hit.alias("text"))

        return F.transform(both["hits"], one)

    # bound to a lambda variable, so that the pattern runs once per text and not once per match
    return F.flatten(F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), place))


def near_cue(text: Column, start: Column, end: Column, cues: Iterable[str], window: int) -> Column:
    """Whether one of ``cues`` stands within ``window`` signs of the span, letter case aside."""
    around = F.lower(_window(text, start, end, window))
    found = F.lit(False)
    for c in cues:
        found = found | F.contains(around, F.lit(c))
    return found


def _window(text: Column, start: Column, end: Column, window: int) -> Column:
    left = F.greatest(start - window, F.lit(0))
    return F.substring(text, left + 1, end + window - left)


def guard(p: P.Pattern, text: Column, m: Column) -> Column:
    """The predicate a match of ``p`` must meet; true for patterns without one."""
    start, end = m["span_start"], m["span_end"]
    if p.id == "SECTION_REF_DOTTED_V1":
        return near_cue(text, start, end, P.SECTION_CUES, P.CUE_WINDOW) & ~F.rlike(_window(text, start, end, P.CUE_WINDOW), F.lit(P.STATISTIC))
    after = F.substring(text, end + 1, F.length(text))
    if p.id == "DOC_REF_PROTOCOL_V1":
        left = F.greatest(start - P.PREVIOUS_WINDOW, F.lit(0))
        following = F.lower(F.regexp_extract(after, r"^[\s\-,.:;()]*([A-Za-z']+)", 1))
        previous = F.lower(F.regexp_extract(F.substring(text, left + 1, start - left), r"([A-Za-z']+)[\s\-]*$", 1))
        return ~following.isin(P.PROTOCOL_NEXT) & ~previous.isin(P.PROTOCOL_PREVIOUS)
    if p.id in P.ACRONYMS:
        # the spelled-out name is dropped where its acronym follows, in any letter case, after a bracket or not
        acronym = P.ACRONYMS[p.id].lower()
        near = F.regexp_replace(F.lower(F.substring(after, 1, len(acronym) + 4)), r"^\s+", "")
        bare = F.when(F.startswith(near, F.lit("(")), F.regexp_replace(F.substring(near, 2, len(acronym) + 4), r"^\s+", "")).otherwise(near)
        return (F.lower(m["text"]) != P.SPELLED[p.id]) | ~F.startswith(bare, F.lit(acronym))
    return F.lit(True)


def pattern_matches(p: P.Pattern, text: Column) -> Column:
    """Guarded matches of one pattern as array of match structs."""
    kept = F.filter(spans(text, p.regex), lambda m: guard(p, text, m))
    return F.transform(
        kept,
        lambda m: F.struct(
            F.lit(p.id).alias("pattern_id"), F.lit(p.label).alias("label"), F.lit(p.layer).alias("source_layer"), F.lit(p.confidence).alias("confidence"),
            m["span_start"].alias("span_start"), m["span_end"].alias("span_end"), m["text"].alias("text"), F.lit(p.ordinal).alias("ordinal"),
        ),
    )


def match_groups(pattern_id: Column, text: Column, patterns: Iterable[P.Pattern] | None = None) -> Column:
    """map of the named groups of a match of ``patterns`` (none given: any); groups that took no part are absent, patterns without
    groups give an empty map.
    """
    out = F.create_map().cast("map<string,string>")
    for p in ALL if patterns is None else patterns:
        names = P.GROUP_NAMES.get(p.id)
        if names:
            pairs = [x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(text, p.regex, i))]
            out = F.when(pattern_id == p.id, F.map_filter(F.create_map(*pairs), lambda _, v: v != "")).otherwise(out)
    return out


ALL = [*P.ALL_PATTERNS, *P.NER_PATTERNS]
_MATCHES = "array<struct<pattern_id:string,label:string,source_layer:string,confidence:double,span_start:int,span_end:int,text:string,ordinal:int>>"


def may_match(p: P.Pattern, low: Column) -> Column:
    """Whether a text in lower case holds what a pattern needs; true for patterns nothing is known of."""
    found = F.lit(p.id not in P.NEEDS)
    for sign in P.NEEDS.get(p.id, []):
        found = found | F.contains(low, F.lit(sign))
    return found


def all_matches(text: Column, low: Column, patterns: Iterable[P.Pattern]) -> Column:
    """Matches of all patterns in registry order, overlaps kept; ``low`` is the text in lower case."""
    none = F.array().cast(_MATCHES)
    return F.concat(*[F.when(may_match(p, low) & F.rlike(text, F.lit(p.regex)), pattern_matches(p, text)).otherwise(none) for p in patterns])


def resolve_overlaps(matches: Column) -> Column:
    """The matches that are left when, in order of confidence, length, start and registry, each is kept that overlaps none
    kept before; by start. An empty array stays empty.
    """
    ranked = F.array_sort(F.transform(matches, lambda m: F.struct((-m["confidence"]).alias("a"), (m["span_start"] - m["span_end"]).alias("b"), m["span_start"].alias("c"), m["ordinal"].alias("d"), m.alias("m"))))
    kept = F.aggregate(
        ranked,
        F.slice(matches, 1, 0),
        lambda acc, r: F.when(F.exists(acc, lambda k: (k["span_start"] < r["m"]["span_end"]) & (r["m"]["span_start"] < k["span_end"])), acc).otherwise(F.concat(acc, F.array(r["m"]))),
    )
    return F.transform(F.array_sort(F.transform(kept, lambda m: F.struct(m["span_start"].alias("s"), m.alias("m")))), lambda x: x["m"])


def detect(units: DataFrame, mode: str = "regex+ner", visits: bool = False, resolve: bool = True) -> DataFrame:
    """One row per reference: (unit columns but text, match fields). Resolution runs inside each unit: no shuffle."""
    keys = [c for c in units.columns if c != "text"]
    # explode of a one-element array keeps the optimizer from copying the matches into every place that uses them
    lowered = spread(units).select(*keys, F.explode(F.array(F.struct("text", F.lower("text").alias("low")))).alias("u"))
    found = lowered.select(*keys, F.explode(F.array(all_matches(F.col("u.text"), F.col("u.low"), P.registry(mode, visits)))).alias("found")).where(F.size("found") > 0)
    if resolve:
        found = found.withColumn("found", F.when(F.size("found") > 1, resolve_overlaps(F.col("found"))).otherwise(F.col("found")))
    return found.select(*keys, F.explode("found").alias("m")).select(*keys, "m.*").drop("ordinal")


def match_one(units: DataFrame, pattern_id: str) -> DataFrame:
    """Guarded matches of a single pattern."""
    p = next(x for x in [*P.ALL_PATTERNS, *P.NER_PATTERNS] if x.id == pattern_id)
    keys = [c for c in units.columns if c != "text"]
    hit = units.where(F.rlike("text", F.lit(p.regex)))  # the scan keeps only units that match at all
    return hit.select(*keys, F.explode(pattern_matches(p, F.col("text"))).alias("m")).select(*keys, "m.span_start", "m.span_end", "m.text")


def matches_of(units: DataFrame, pattern_ids: list[str]) -> DataFrame:
    """Guarded matches of several patterns, overlaps kept: (unit columns, pattern_id, label, confidence, span_start, span_end,
    match, groups), the unit's text staying as ``text``; ``groups`` is a map of named groups.
    """
    chosen = [p for p in ALL if p.id in pattern_ids]
    found = units.select("*", F.explode(F.array(all_matches(F.col("text"), F.lower("text"), chosen))).alias("found")).where(F.size("found") > 0)
    rows = found.select(*units.columns, F.explode("found").alias("m"))
    return rows.select(*units.columns, *[F.col(f"m.{c}").alias(c) for c in ("pattern_id", "label", "confidence", "span_start", "span_end")], F.col("m.text").alias("match"), match_groups(F.col("m.pattern_id"), F.col("m.text"), chosen).alias("groups"))


def context_window(text: Column, start: Column, end: Column, width: int = 80) -> Column:
    """The text around a span, trimmed."""
    return F.trim(_window(text, start, end, width))


def refine_gate(references: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds ``refine``: whether a reference is uncertain enough for a refiner; the layer of refined ones becomes llm."""
    refine = F.col("confidence") < threshold
    return references.withColumn("refine", refine).withColumn("source_layer", F.when(refine, "llm").otherwise(F.col("source_layer")))


#: A refiner is asked about at most so many candidates of a unit, the best ones.
MOST_CANDIDATES = 6

# Month names, which author-year citations must not take for surnames.
MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
# Shapes of citations.
AUTHOR_YEAR = r"\b([A-Z][a-z]{2,})[,\s]+(?:([A-Z]{1,3})[,\s]+)?((?:19|20)\d{2})\b"
NUMBERED = r"\[(\d{1,3})\]"


def author_year(units: DataFrame) -> DataFrame:
    """(unit keys, span_start, span_end, surname, year) of author-year citations; months are no surnames."""
    keys = [c for c in units.columns if c != "text"]
    hits = units.where(F.rlike("text", F.lit(AUTHOR_YEAR))).select(*keys, F.explode(spans(F.col("text"), AUTHOR_YEAR)).alias("m"))
    parts = hits.select(*keys, "m.span_start", "m.span_end", F.regexp_extract("m.text", AUTHOR_YEAR, 1).alias("surname"), F.regexp_extract("m.text", AUTHOR_YEAR, 3).alias("year"))
    return parts.where(~F.lower("surname").isin(MONTHS))


def numbered(units: DataFrame) -> DataFrame:
    """Bracketed citation numbers."""
    keys = [c for c in units.columns if c != "text"]
    hits = units.where(F.rlike("text", F.lit(NUMBERED))).select(*keys, F.explode(spans(F.col("text"), NUMBERED)).alias("m"))
    return hits.select(*keys, "m.span_start", "m.span_end", F.regexp_extract("m.text", NUMBERED, 1).cast("int").alias("num"))


# What begins and ends a bibliography.
REFERENCES_HEAD = r"^\s*(?:\d{1,2}[.)]?\s+)?(?i:references)\b"
NEXT_HEAD = r"^\s*(?:(?i:appendix|appendices|annex|annexes|glossary|abbreviations?|acknowledge?ments?|bibliography|list of|tables?|figures?|listings?)\b|\d{1,2}[.)]\s+[A-Z][A-Z0-9 &/()_'-]{2,}$)"


def bibliography(units: DataFrame) -> DataFrame:
    """(doc_id, first_line, end_line): from the first short references heading to the next heading, or the document's end."""
    head = units.where((F.length("text") <= 40) & F.rlike("text", F.lit(REFERENCES_HEAD))).groupBy("doc_id").agg(F.min("line_no").alias("first_line"))
    ends = units.withColumn("is_end", (F.length("text") <= 60) & F.rlike("text", F.lit(NEXT_HEAD)))
    return ends.join(head, "doc_id").groupBy("doc_id", "first_line").agg(F.coalesce(F.min(F.when(F.col("is_end") & (F.col("line_no") > F.col("first_line")), F.col("line_no"))), F.max("line_no") + 1).alias("end_line"))


def entry_key(text: Column) -> Column:
    """Key of a bibliography entry: its leading number, else leading surname and first year; null if it has neither."""
    number = F.regexp_extract(text, r"^\s*(\d{1,3})[.)]\s+", 1)
    surname = F.regexp_replace(F.lower(F.regexp_extract(text, r"^\s*([A-Z][A-Za-z'’\-]+)", 1)), "[^a-z]", "")
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(number != "", F.concat(F.lit("ref_"), number.cast("int").cast("string"))).when((surname != "") & (year != ""), F.concat_ws("_", F.lit("ref"), surname, year))


#: How far after a surname its year may stand.
YEAR_WINDOW = 40


def reference_vocabulary(entries: DataFrame) -> DataFrame:
    """(doc_id, surname, year, ref_key) from a document's bibliography lines (doc_id, line_no, text): leading surname in lower
    case and first year; months and numbered entries are none; the first entry of a surname wins.
    """
    surname = F.regexp_extract("text", r"^\s*([A-Z][A-Za-z'’\-]+)", 1)
    year = F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1)
    named = entries.where(~F.rlike("text", F.lit(r"^\s*\d"))).select("doc_id", "line_no", F.lower(surname).alias("surname"), year.alias("year"), entry_key(F.col("text")).alias("ref_key"))
    named = named.where((F.col("surname") != "") & (F.col("year") != "") & ~F.col("surname").isin(MONTHS))
    return named.groupBy("doc_id", "surname").agg(F.min(F.struct("line_no", "year", "ref_key")).alias("e")).select("doc_id", "surname", "e.year", "e.ref_key")


def vocabulary_hits(vocabulary: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, line_no, span_start, span_end, surname, year, ref_key): uses of the surnames of the document's own bibliography,
    in any letter case and with no letter, apostrophe or dash before them, whose year follows within YEAR_WINDOW signs; every
    occurrence, the earlier and longer of overlapping ones. Surnames are cut out of the text and met by equality.
    """
    shape = r"(?<![\p{L}'’\-])[A-Za-z][A-Za-z'’\-]+(?![A-Za-z])"
    words = units.select("doc_id", "line_no", "text", F.explode(spans(F.col("text"), shape)).alias("m"))
    # a surname may be followed by a dash or an apostrophe: each head of a word up to one is a candidate as well
    pieces = F.split("m.text", "(?=['’\\-])")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), ""))
    cands = words.select("doc_id", "line_no", "text", F.col("m.span_start").alias("span_start"), F.explode(F.array_distinct(heads)).alias("form"))
    met = cands.withColumn("surname", F.lower("form")).join(vocabulary, ["doc_id", "surname"])
    at = F.expr(f"regexp_instr(substring(text, span_start + length(form) + 1, {YEAR_WINDOW}), concat('\\\\b', year, '\\\\b'))")
    hits = met.withColumn("at", at).where("at > 0").withColumn("span_end", (F.col("span_start") + F.length("form") + F.col("at") + 3).cast("int"))
    items = F.array_sort(F.collect_list(F.struct("span_start", (-F.col("span_end")).alias("o"), "span_end", "surname", "year", "ref_key")))
    per = hits.groupBy("doc_id", "line_no").agg(items.alias("c"))  # one line's
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: (k["span_start"] < x["span_end"]) & (x["span_start"] < k["span_end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select("doc_id", "line_no", F.explode(kept).alias("k")).select("doc_id", "line_no", "k.span_start", "k.span_end", "k.surname", "k.year", "k.ref_key")


def outside_bibliography(citations: DataFrame, ranges: DataFrame) -> DataFrame:
    """Citations (doc_id, line_no, ...) that stand in no bibliography (doc_id, first_line, end_line)."""
    inside = (F.col("line_no") >= F.col("first_line")) & (F.col("line_no") < F.col("end_line"))
    return citations.join(ranges.select("doc_id", "first_line", "end_line"), "doc_id", "left").where(F.col("first_line").isNull() | ~inside).drop("first_line", "end_line")


def merged_citations(regex_hits: DataFrame, model_hits: DataFrame) -> DataFrame:
    """Hits of the pattern, and those of a model that overlap none of them: (doc_id, line_no, span_start, span_end, surname, year, layer)."""
    a, b = regex_hits.alias("a"), model_hits.alias("b")
    lap = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.line_no") == F.col("b.line_no")) & (F.col("a.span_start") < F.col("b.span_end")) & (F.col("b.span_start") < F.col("a.span_end"))
    cols = ["doc_id", "line_no", "span_start", "span_end", "surname", "year"]
    return regex_hits.select(*cols, F.lit("regex").alias("layer")).unionByName(b.join(a, lap, "left_anti").select(*cols, F.lit("model").alias("layer")))


# What a compound reference is made of.
COMPOUND = (
    r"(?<![A-Za-z])((?i:study\s+id)|(?i:protocol)|(?i:statistical\s+analysis\s+plan)|SAP|(?i:clinical\s+study\s+report)|CSR"
    r"|(?i:integrated\s+summary\s+of\s+safety)|ISS|(?i:integrated\s+summary\s+of\s+efficacy)|ISE)"
    r"(\s+[A-Z]{2,6}-\d{1,3}_\d{1,4})?(\s+(?i:section|sect\.?|table|figure|listing|appendix)\s+\d+(?:[.\-]\d+){0,4})?"
)


def compound_references(units: DataFrame) -> DataFrame:
    """(unit keys, span_start, span_end, text, label, doc_type, id_token, anchor_key) of whole phrases of a document word with
    an id or a part of a document. "Study id" needs the id and leads by it (DOC_ID), other words by their type (DOC_REF).
    """
    keys = [c for c in units.columns if c != "text"]
    hits = units.where(F.rlike("text", F.lit(COMPOUND))).select(*keys, F.explode(spans(F.col("text"), COMPOUND)).alias("m"))
    part = lambda i: F.trim(F.regexp_extract("m.text", COMPOUND, i))
    rows = hits.select(*keys, "m.span_start", "m.span_end", "m.text", F.regexp_replace(F.lower(part(1)), r"\s+", " ").alias("head"), part(2).alias("id_token"), part(3).alias("part"))
    by_id = F.col("head") == "study id"
    rows = rows.where((F.col("id_token") != "") | (~by_id & (F.col("part") != "")))
    kind = F.lower(F.regexp_extract("part", r"^([A-Za-z]+)", 1))
    label = F.when(F.startswith(kind, F.lit("sect")), "section_ref").otherwise(F.concat(kind, F.lit("_ref")))
    anchor = F.when(F.col("part") != "", F.concat_ws("_", label, F.translate(F.regexp_extract("part", r"(\d+(?:[.\-]\d+)*)$", 1), ".-", "__")))
    types = F.col("head")
    for i, name in P.SPELLED.items():
        types = F.when(F.col("head") == name, P.ACRONYMS[i].lower()).otherwise(types)
    return rows.select(*keys, "span_start", "span_end", "text", F.when(by_id, "DOC_ID").otherwise("DOC_REF").alias("label"), F.when(~by_id, types).alias("doc_type"), F.nullif("id_token", F.lit("")).alias("id_token"), anchor.alias("anchor_key"))


def apply_compounds(references: DataFrame, compounds: DataFrame, keys: list[str]) -> DataFrame:
    """References without those a compound phrase holds whole, and a COMPOUND_REF_V1 of confidence 0.9 for each phrase."""
    r, c = references.alias("r"), compounds.alias("c")
    inside = (F.col("c.span_start") <= F.col("r.span_start")) & (F.col("r.span_end") <= F.col("c.span_end"))
    for k in keys:
        inside = inside & (F.col(f"r.{k}") == F.col(f"c.{k}"))
    cols = [*keys, "pattern_id", "label", "confidence", "span_start", "span_end", "text"]
    new = compounds.select(*keys, F.lit("COMPOUND_REF_V1").alias("pattern_id"), "label", F.lit(0.9).alias("confidence"), "span_start", "span_end", "text")
    return r.join(c, inside, "left_anti").select(*cols).unionByName(new.select(*cols))


def without_spelled_names(references: DataFrame, keys: list[str], reach: int = 8) -> DataFrame:
    """References without spelled-out document names that the acronym of the same pattern follows within ``reach`` signs, in
    whichever run of the unit it stands.
    """
    acronyms = list(P.ACRONYMS.values())
    short = references.where(F.col("text").isin(acronyms) & F.col("pattern_id").isin(list(P.ACRONYMS))).select(*keys, "pattern_id", F.col("span_start").alias("s"))
    long = references.where(F.col("pattern_id").isin(list(P.ACRONYMS)) & ~F.col("text").isin(acronyms))
    gone = long.join(short, [*keys, "pattern_id"]).where((F.col("s") >= F.col("span_end")) & (F.col("s") - F.col("span_end") <= reach)).select(*keys, "pattern_id", "span_start").distinct()
    return references.join(gone, [*keys, "pattern_id", "span_start"], "left_anti")


def stub_refinement(candidates: DataFrame, unit: list[str]) -> DataFrame:
    """The deterministic refiner: per unit the candidate of the highest confidence, the longer text and earlier start among
    equals; its layer is llm and its confidence has two decimals.
    """
    rest = [c for c in candidates.columns if c not in unit]
    best = candidates.groupBy(*unit).agg(F.max(F.struct(F.col("confidence").alias("_c"), F.length("text").alias("_n"), (-F.col("span_start")).alias("_s"), F.struct(*rest).alias("_r")))["_r"].alias("r")).select(*unit, "r.*")
    return best.withColumn("confidence", F.round("confidence", 2)).withColumn("source_layer", F.lit("llm"))


def parse_refiner_reply(reply: Column) -> Column:
    """struct(id, confidence, rationale) of a refiner's reply: its first JSON object; confidence is kept within 0 and 1, the
    rationale within 240 signs. Null where there is no object that can be read; the caller then keeps the original.
    """
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})", 1), "id string, confidence double, rationale string")
    held = F.struct(found["id"].alias("id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), found["confidence"])).alias("confidence"), F.substring(found["rationale"], 1, 240).alias("rationale"))
    return F.when(found["id"].isNotNull(), held)


def layer_summary(references: DataFrame) -> DataFrame:
    return references.groupBy("source_layer").agg(F.count(F.lit(1)).alias("n"))


def detection_trace(references: DataFrame) -> DataFrame:
    """References per document and layer, documents in order."""
    count = lambda c: F.count_if(F.col("source_layer") == c)
    return references.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), count("regex").alias("n_regex"), count("ner").alias("n_ner"))


def span_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per label: tp, fp, fn, precision, recall, f1 (0 where undefined). A prediction takes the first gold span of its unit
    and label that it overlaps and no prediction before it took. Both: (unit, label, span_start, span_end).
    """
    item = F.struct("span_start", "span_end")
    p = predicted.groupBy("unit", "label").agg(F.array_sort(F.collect_list(item)).alias("p"))
    g = gold.groupBy("unit", "label").agg(F.array_sort(F.collect_list(item)).alias("g"))
    none = F.array().cast("array<struct<span_start:int,span_end:int>>")
    both = p.join(g, ["unit", "label"], "full").select("label", F.coalesce("p", none).alias("p"), F.coalesce("g", none).alias("g"))

    def take(left: Column, x: Column) -> Column:
        hits = F.filter(left["rest"], lambda y: (y["span_start"] < x["span_end"]) & (x["span_start"] < y["span_end"]))
        first = F.array_position(left["rest"], F.get(hits, F.lit(0))).cast("int")
        rest = F.when(F.size(hits) > 0, F.concat(F.slice(left["rest"], 1, first - 1), F.slice(left["rest"], first + 1, F.size(left["rest"])))).otherwise(left["rest"])
        return F.struct(rest.alias("rest"), (left["tp"] + F.when(F.size(hits) > 0, 1).otherwise(0)).alias("tp"))

    matched = F.aggregate("p", F.struct(F.col("g").alias("rest"), F.lit(0).alias("tp")), take)["tp"]
    sums = both.select("label", matched.alias("tp"), F.size("p").alias("np"), F.size("g").alias("ng")).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "np", "ng")])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return sums.select("label", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), ratio("tp", "np").alias("precision"), ratio("tp", "ng").alias("recall"), F.round(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("np") + F.col("ng")), F.lit(0.0)), 6).alias("f1"))
