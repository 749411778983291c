"""Where in a document a link's anchor is, and the text to show for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How captions and sections begin, and the shapes of numbers, citations and bibliography headings.
CAPTIONS = ["table", "figure", "listing", "appendix"]
SECTIONS = ["section", "sect.", "sec.", "§"]
DOTTED = r"\d+(?:\.\d+)+"
KEYED = r"_ref_(\d+(?:_\d+)*)"
TYPED = r"(?:section|sect\.?|sec\.?|table|figure|listing|appendix|§)\s*\.?\s*(\d+)\b"
SLUG = r"^ref_([a-z][a-z'’\-]*)_((?:19|20)\d{2})$"
HUMAN = r"^([A-Z][A-Za-z'’\-]+)[,\s]+(?:[A-Z]{1,3}\.?\s*,?\s*)?((?:19|20)\d{2})\b"
BIBLIOGRAPHY = r"(?i)^(?:\d+\.?\s+)?(?:references?|bibliography)\s*$"
HEADING_CUT, EXCERPT_CUT = 200, 400


def anchor_facts(anchor: Column) -> Column:
    """struct(num, wants_table, wants_section, needle, surname, year) of an anchor key or a link's text; empty where it has none."""
    low = F.lower(F.coalesce(anchor, F.lit("")))
    dotted, keyed, typed = F.regexp_extract(anchor, DOTTED, 0), F.regexp_extract(low, KEYED, 1), F.regexp_extract(low, TYPED, 1)
    num = F.when(dotted != "", dotted).when(keyed != "", F.translate(keyed, "_", ".")).otherwise(typed)
    holds = lambda words: F.array_max(F.array(*[F.contains(low, F.lit(w)) for w in words]))
    table = holds(CAPTIONS)
    section = ~table & (holds(SECTIONS) | F.startswith(low, F.lit("section_ref")))
    text = F.trim(F.coalesce(anchor, F.lit("")))
    slug = F.regexp_extract(F.lower(text), SLUG, 1)
    surname = F.when(slug != "", slug).otherwise(F.lower(F.regexp_extract(text, HUMAN, 1)))
    year = F.when(slug != "", F.regexp_extract(F.lower(text), SLUG, 2)).otherwise(F.regexp_extract(text, HUMAN, 2))
    return F.struct(F.coalesce(num, F.lit("")).alias("num"), table.alias("wants_table"), section.alias("wants_section"), F.trim(low).alias("needle"), F.regexp_replace(surname, "['’-]", "").alias("surname"), year.alias("year"))


def paragraphs_with_context(paragraphs: DataFrame) -> DataFrame:
    """(doc, para, text, next_1, next_2): paragraphs with text, trimmed, and the two that follow. paragraphs: (doc, para, text)."""
    w = Window.partitionBy("doc").orderBy("para")
    full = paragraphs.select("doc", "para", F.trim("text").alias("text")).where("text <> ''")
    return full.select("*", F.lead("text").over(w).alias("next_1"), F.lead("text", 2).over(w).alias("next_2"))


def entry_places(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc, anchor, para): the bibliography entry of each author-year request (doc, anchor, surname, year): a paragraph that
    begins with the surname and holds the year, the first after a bibliography's heading, else the last of all.
    """
    plain = F.regexp_replace(F.lower("text"), "['’-]", "")
    heads = paragraphs.where(F.rlike("text", F.lit(BIBLIOGRAPHY))).groupBy("doc").agg(F.min("para").alias("head"))
    begins = paragraphs.select("doc", "para", plain.alias("plain"), F.regexp_extract(plain, r"^(\p{L}+)", 1).alias("surname"))
    hits = requests.where("surname <> '' and year <> ''").join(begins, ["doc", "surname"]).where(F.contains("plain", F.col("year"))).join(heads, "doc", "left")
    after = F.min(F.when(F.col("para") > F.col("head"), F.col("para")))
    return hits.groupBy("doc", "anchor").agg(F.coalesce(after, F.max("para")).alias("para"))


def find_snippets(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, doc, matched, heading, snippet) of each request: the best place in its candidate documents, in their order.

    requests: (req, anchor, doc, rank), a row per candidate. In each document the first of these that is found: a caption with
    the number (never for a section), a paragraph that begins with the number, one that holds it, the bibliography entry of
    an author and year, one that holds the anchor's text; else the opening of the first candidate. Equal requests for a
    document are searched once; numbers match whole only (6.1 isn't in 6.1.1).
    """
    ps = paragraphs_with_context(paragraphs)
    asked = requests.select("doc", "anchor").distinct().withColumn("f", anchor_facts(F.col("anchor"))).select("doc", "anchor", "f.*")
    low = F.lower("text")
    begins = lambda words: F.array_max(F.array(*[F.startswith(low, F.lit(w)) for w in words]))
    number = F.concat(F.lit(r"(?<![\d.])"), F.regexp_replace("num", r"\.", "[.]"), F.lit(r"(?!\.?\d)"))
    has = (F.col("num") != "") & F.call_function("regexp_like", F.col("text"), number)
    leads = F.startswith("text", F.col("num")) | F.call_function("regexp_like", low, F.concat(F.lit(r"^(?:section|sect|sec|§)\s*"), F.regexp_replace("num", r"\.", "[.]")))
    caption = begins(CAPTIONS)
    step = (
        F.when(has & ~F.col("wants_section") & (caption | begins(SECTIONS)), 1).when(has & leads, 2).when(has & ~(F.col("wants_section") & caption), 3)
        .when((F.col("needle") != "") & F.contains(low, F.col("needle")), 5)
    )
    found = asked.join(ps, "doc").withColumn("step", step).where("step is not null").select("doc", "anchor", "para", "step")
    entries = entry_places(ps, asked.where("num = '' and not wants_table and not wants_section")).withColumn("step", F.lit(4))
    opening = asked.select("doc", "anchor").join(ps.groupBy("doc").agg(F.min("para").alias("para")), "doc").withColumn("step", F.lit(9))
    best = found.unionByName(entries).unionByName(opening).groupBy("doc", "anchor").agg(F.min(F.struct("step", "para")).alias("b")).select("doc", "anchor", "b.step", "b.para")
    shown = requests.join(best, ["doc", "anchor"]).groupBy("req").agg(F.min(F.struct((F.col("step") == 9).alias("late"), "rank", "doc", "step", "para")).alias("r")).select("req", "r.doc", "r.step", "r.para")
    two = F.concat_ws(" ", "next_1", "next_2")
    excerpt = F.when(F.col("step") == 1, F.col("text")).when(F.col("step") == 4, F.coalesce("next_1", "text")).when(F.col("step") == 9, two).otherwise(F.when(two == "", F.col("text")).otherwise(two))
    return shown.join(ps, ["doc", "para"]).select("req", "doc", (F.col("step") != 9).alias("matched"), F.substring("text", 1, HEADING_CUT).alias("heading"), F.substring(excerpt, 1, EXCERPT_CUT).alias("snippet"))
