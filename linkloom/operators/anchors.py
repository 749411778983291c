"""Definitions that references point to: canonical keys, captions, headings, first definition wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What introduces each kind of caption, and the shapes of its number.
CAPTION_WORDS = {"TABLE_REF": "Table", "FIGURE_REF": "Figure", "LISTING_REF": "Listing", "APPENDIX_REF": "Appendix"}
CAPTION_NUMBERS = {"APPENDIX_REF": r"\d+(?:\.\d+){0,3}|[A-Za-z]"}
NUMBER = r"\d+(?:[.\-]\d+){0,4}"
# Shapes of contents lines and headings, longest caption and heading.
CONTENTS_LINE = r"\.{3,}|(?:\.\s){3,}|…|(?:·\s*){3,}"
HEADING = r"^(\d{1,2}(?:\.\d{1,3}){0,3})\.?\s+([A-Za-z].*)$"
LONGEST_CAPTION, LONGEST_HEADING = 200, 80
#: Spelt out, as what \b takes for a word differs between Java's versions.
WORD_SIGN = r"[\p{L}\p{N}_]"


def canonical_key(label: Column, number: Column) -> Column:
    """Key on which a citation and its definition agree."""
    return F.concat_ws("_", F.lower(label), F.translate(number, ".-", "__"))


def visit_key(unit: Column, n: Column) -> Column:
    return F.concat(F.lit("visit_ref_"), F.lower(unit), F.lit("_"), n.cast("string"))


def is_contents_line(text: Column) -> Column:
    """Whether a line is an entry of a table of contents (leaders)."""
    return F.rlike(text, F.lit(CONTENTS_LINE))


def caption_number(text: Column, label: str, require_title: bool = False) -> Column:
    """The number a line defines as a caption of ``label``; null for mid-sentence citations, contents lines and null text."""
    shape = rf"(?i)^{CAPTION_WORDS[label]}\s+({CAPTION_NUMBERS.get(label, NUMBER)})\b"
    bare = F.lit(not require_title)

    def number_of(m: Column) -> Column:
        line, number, rest = m["line"], m["number"], m["rest"]
        first = F.substring(rest, 1, 1)
        ok = (
            F.when(rest == "", bare)
            .when(first.isin(":", ".", "-", "—", "\t"), (F.trim(F.substring(rest, 2, F.length(rest))) != "") | bare)
            .otherwise(F.rlike(first, F.lit(r"^\p{Lu}")) & (F.length(line) <= LONGEST_CAPTION))
        )
        lone = F.rlike(number, F.lit("^[A-Za-z]$"))
        return F.when((number != "") & ~is_contents_line(line) & ok, F.when(lone, F.upper(number)).otherwise(number))

    def parts(line: Column) -> Column:
        rest = F.ltrim(F.substring(line, F.length(F.regexp_extract(line, shape, 0)) + 1, F.length(line)))
        return F.struct(line.alias("line"), F.regexp_extract(line, shape, 1).alias("number"), rest.alias("rest"))

    return _bound(_bound(F.trim(text), parts), number_of)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def heading_number(text: Column) -> Column:
    """The number of a numbered heading line by its shape; null otherwise."""
    def number_of(m: Column) -> Column:
        line, title = m["line"], m["title"]
        sentence = F.rlike(line, F.lit("[.?!;,]$")) & (title != F.upper(title))
        ok = (F.length(line) <= LONGEST_HEADING) & ~is_contents_line(line) & F.rlike(title, F.lit(r"^\p{Lu}")) & ~sentence
        return F.when(F.rlike(line, F.lit(HEADING)) & ok, F.regexp_extract(line, HEADING, 1))

    parts = lambda line: F.struct(line.alias("line"), F.trim(F.regexp_extract(line, HEADING, 2)).alias("title"))
    return _bound(_bound(F.trim(text), parts), number_of)


def first_number(text: Column) -> Column:
    """The first dotted number of a line, between Unicode word bounds; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?<!{WORD_SIGN})(\p{{Nd}}+(?:\.\p{{Nd}}+){{0,4}})(?!{WORD_SIGN})", 1), F.lit(""))


def caption_definitions(units: DataFrame) -> DataFrame:
    """(doc_id, line_no, anchor_key) of caption and heading lines. Captions are of priority 1, headings of priority 2."""
    found = [F.struct(F.lit(1).alias("src_priority"), canonical_key(F.lit(k), caption_number(F.col("text"), k)).alias("anchor_key"), caption_number(F.col("text"), k).alias("n")) for k in CAPTION_WORDS]
    found.append(F.struct(F.lit(2).alias("src_priority"), canonical_key(F.lit("SECTION_REF"), heading_number(F.col("text"))).alias("anchor_key"), heading_number(F.col("text")).alias("n")))
    return units.select("doc_id", "line_no", F.explode(F.array(*found)).alias("d")).where("d.n is not null").select("doc_id", "line_no", "d.src_priority", "d.anchor_key")


def first_definitions(definitions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``. A max over a struct, which Spark combines before the shuffle; no window."""
    rest = [c for c in definitions.columns if c not in keys and c not in order]
    return definitions.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("d")).select(*keys, "d.*")


def coverage(citations: DataFrame, definitions: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per label: distinct cited keys, how many of them are defined, and the share."""
    cited = citations.select(label, *keys).distinct()
    known = definitions.select(*keys).distinct().withColumn("known", F.lit(1))
    sums = cited.join(known, keys, "left").groupBy(label).agg(F.count(F.lit(1)).alias("cited"), F.count("known").alias("anchored"))
    return sums.withColumn("share", F.round(F.col("anchored") / F.col("cited"), 6))


def modal_size(spans: DataFrame, group: str, size: str, text: str) -> DataFrame:
    """The size of most characters per group; the smaller of equals."""
    per = spans.where(F.col(size).isNotNull()).groupBy(group, size).agg(F.sum(F.length(text)).alias("n"))
    return per.groupBy(group).agg(F.max(F.struct("n", (-F.col(size)).alias("s"))).alias("m")).select(group, (-F.col("m.s")).alias("body_size"), F.col("m.n").alias("chars"))


def run_offsets(runs: DataFrame, group: list[str], order: str, text: str, gap: int = 1) -> DataFrame:
    """Adds ``offset``: where each run starts if a group's runs are joined with ``gap`` signs between."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("offset", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)))


def overlapping_run(spans: DataFrame, runs: DataFrame, unit: str) -> DataFrame:
    """(unit, span_start, span_end, run, clipped): the first run of its unit each span overlaps, and the span clipped to it.

    spans: (unit, span_start, span_end); runs: (unit, run, run_start, run_end). Runs of one unit are bounded by its text.
    """
    both = spans.join(runs, unit).where((F.col("run_end") > F.col("span_start")) & (F.col("run_start") < F.col("span_end")))
    first = both.groupBy(unit, "span_start", "span_end").agg(F.min(F.struct("run", "run_start", "run_end")).alias("r"))
    return first.select(unit, "span_start", "span_end", "r.run", F.greatest("span_start", "r.run_start").alias("clip_start"), F.least("span_end", "r.run_end").alias("clip_end"))


def islands(runs: DataFrame, unit: str, order: str, flag: str, text: str) -> DataFrame:
    """(unit, first_run, last_run, text): maximal stretches of neighbouring flagged runs (gaps and islands)."""
    w = Window.partitionBy(unit).orderBy(order)
    marked = runs.withColumn("island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)).where(F.col(flag))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return marked.groupBy(unit, "island").agg(F.min(order).alias("first_run"), F.max(order).alias("last_run"), joined.alias("text")).drop("island")


#: Where a visit is named in a heading.
VISIT = r"(?i)\b(Week|Day|Month)\s+(\d+)\b"
#: Key of a bibliography's heading, to which citations without an entry lead.
REFERENCES_KEY = "ref_heading"


def heading_signal(style: Column, bold: Column) -> Column:
    """Whether a line looks like a heading: by its style, or since a part of it is bold."""
    low = F.lower(F.coalesce(style, F.lit("")))
    return F.startswith(low, F.lit("heading")) | F.startswith(low, F.lit("title")) | F.coalesce(bold, F.lit(False))


def anchor_sources(lines: DataFrame, detections: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, anchor_key, src_priority, line_no) of every place that may define an anchor, by source: 1 titled captions among
    the detections, 2 captions by shape, bare ones only where a heading shows, 3 sections of heading styles, 4 numbered
    headings that show as such, 5 visits in headings, 6 bibliography entries and their heading.

    lines: (doc_id, line_no, text, style, bold); detections: (doc_id, line_no, label, text, num), text being the line's;
    entries: (doc_id, line_no, ref_key).
    """
    signal = heading_signal(F.col("style"), F.col("bold"))
    styled = F.startswith(F.lower(F.coalesce("style", F.lit(""))), F.lit("heading"))
    titled = styled | F.startswith(F.lower(F.coalesce("style", F.lit(""))), F.lit("title"))
    unit, n = F.regexp_extract("text", VISIT, 1), F.regexp_extract("text", VISIT, 2)
    # one branch a source, each behind a cheap test: in a single expression they'd outgrow the code generator
    own = None
    for label, word in CAPTION_WORDS.items():
        full, bare = caption_number(F.col("text"), label, True), caption_number(F.col("text"), label, False)
        likely = lines.where(F.rlike("text", F.lit(rf"(?i)^\s*{word}\s")))
        found = likely.select("doc_id", "line_no", F.coalesce(full, F.when(signal, bare)).alias("n")).where("n is not null").select("doc_id", canonical_key(F.lit(label), F.col("n")).alias("anchor_key"), F.lit(2).alias("src_priority"), "line_no")
        own = found if own is None else own.unionByName(found)
    section = lambda df, p: df.where("n is not null").select("doc_id", canonical_key(F.lit("SECTION_REF"), F.col("n")).alias("anchor_key"), F.lit(p).alias("src_priority"), "line_no")
    own = own.unionByName(section(lines.where(styled).select("doc_id", "line_no", first_number(F.col("text")).alias("n")), 3))
    own = own.unionByName(section(lines.where(signal & F.rlike("text", F.lit(r"^\s*\d"))).select("doc_id", "line_no", heading_number(F.col("text")).alias("n")), 4))
    own = own.unionByName(lines.where(titled & F.rlike("text", F.lit(VISIT))).select("doc_id", visit_key(unit, n).alias("anchor_key"), F.lit(5).alias("src_priority"), "line_no"))
    captions = None
    for label in CAPTION_WORDS:
        one = detections.where((F.col("label") == label) & F.rlike("text", F.lit(rf"(?i)^\s*{CAPTION_WORDS[label]}\s"))).where(caption_number(F.col("text"), label, True).isNotNull())
        captions = one if captions is None else captions.unionByName(one)
    first = captions.where("num <> ''").select("doc_id", canonical_key(F.col("label"), F.col("num")).alias("anchor_key"), F.lit(1).alias("src_priority"), "line_no")
    refs = entries.select("doc_id", F.col("ref_key").alias("anchor_key"), F.lit(6).alias("src_priority"), "line_no").where("anchor_key is not null")
    return own.unionByName(first).unionByName(refs)


def bibliography_entries(units: DataFrame, ranges: DataFrame, entry_key) -> DataFrame:
    """(doc_id, line_no, ref_key): entries between a bibliography's heading and its end, and the heading itself as REFERENCES_KEY."""
    inside = units.join(ranges, "doc_id").where((F.col("line_no") >= F.col("first_line")) & (F.col("line_no") < F.col("end_line")))
    key = F.when(F.col("line_no") == F.col("first_line"), F.lit(REFERENCES_KEY)).otherwise(entry_key(F.col("text")))
    return inside.select("doc_id", "line_no", key.alias("ref_key")).where("ref_key is not null")


def with_fallback(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, anchor_key, line_no, fallback): where each wanted key of a document is defined; citations without an entry lead
    to the bibliography's heading, and line_no is null where there is neither. index: one row per document and key.
    """
    heads = index.where(F.col("anchor_key") == REFERENCES_KEY).select("doc_id", F.col("line_no").alias("head"))
    both = keys.select("doc_id", "anchor_key").distinct().join(index.select("doc_id", "anchor_key", "line_no"), ["doc_id", "anchor_key"], "left").join(heads, "doc_id", "left")
    lost = F.col("line_no").isNull() & F.startswith("anchor_key", F.lit("ref_")) & F.col("head").isNotNull()
    return both.select("doc_id", "anchor_key", F.when(lost, F.col("head")).otherwise(F.col("line_no")).alias("line_no"), lost.alias("fallback"))
