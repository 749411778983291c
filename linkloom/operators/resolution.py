"""Where references lead: file routing, manifest leaves, relative addresses."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import MAX_HEAVY_KEYS, cut

# Document types by what a file name or a text says, in order.
DOC_TYPES = ["protocol", "sap", "csr", "listing", "appendix", "iss", "ise"]
SPELLED_TYPES = [("statistical analysis plan", "sap"), ("clinical study report", "csr"), ("integrated summary of safety", "iss"), ("integrated summary of efficacy", "ise")]
STUDY_NOISE = r"(?:protocol|sap|csr|listings?|appendices|appendix|annex|body|amendment|amd|module|vol)\d*"
STRUCTURAL = ["SECTION_REF", "TABLE_REF", "FIGURE_REF", "LISTING_REF", "APPENDIX_REF"]
QUALIFIER_WINDOW = 48
#: Most tokens of a key under which titles meet, and most keys that a title makes for one size of the other.
KEY_TOKENS, MOST_KEYS = 3, 60


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def study_key(name: Column) -> Column:
    """Study identifier in a normalised stem: registry number, else letters with 7 or 8 digits once document words are gone,
    else the longest run of 4 digits or more (the first of equals); empty if there is none.
    """
    registry = F.regexp_extract(name, r"nct\d{8}", 0)
    clean = F.regexp_replace(name, STUDY_NOISE, "")
    sponsor = F.regexp_extract(clean, r"[a-z]{2,5}\d{4}\d{3,4}", 0)
    runs = F.regexp_extract_all(clean, F.lit(r"\d{4,}"), F.lit(0))
    longest = F.get(F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, F.length))), F.lit(0))
    return F.when(registry != "", registry).when(sponsor != "", sponsor).otherwise(F.coalesce(longest, F.lit("")))


def doc_type(name: Column) -> Column:
    """Document type of a normalised stem."""
    out = F.when(F.contains(name, F.lit(DOC_TYPES[0])), DOC_TYPES[0])
    for t in DOC_TYPES[1:]:
        out = out.when(F.contains(name, F.lit(t)), t)
    return out.when(F.contains(name, F.lit("analysisplan")), "sap").when(F.contains(name, F.lit("clinicalstudyreport")), "csr").otherwise("other")


def doc_type_of_text(text: Column) -> Column:
    """Document type a reference text names; empty if none."""
    low = F.lower(text)
    out = F.when(F.contains(low, F.lit("protocol")), "protocol")
    for words, t in SPELLED_TYPES:
        out = out.when(F.contains(low, F.lit(words)) | F.rlike(low, F.lit(rf"\b{t}\b")), t)
    return out.otherwise("")


def qualifier(context: Column, text: Column) -> Column:
    """Document type named last in the 48 signs before the reference; empty if none. Of equal places the first listed wins."""
    at = F.coalesce(F.nullif(F.position(text, context), F.lit(0)) - 1, F.length(context))
    left = F.lower(F.substring(context, F.greatest(at - QUALIFIER_WINDOW, F.lit(0)) + 1, F.least(at, F.lit(QUALIFIER_WINDOW))))
    kinds = [*SPELLED_TYPES, ("protocol", "protocol"), *((t, t) for t in ("sap", "csr", "iss", "ise"))]
    last = lambda words: F.when(F.contains(left, F.lit(words)), F.length(left) - F.length(F.substring_index(left, words, -1)) - len(words)).otherwise(-1)
    places = F.array(*[F.struct(last(words).alias("at"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, (words, t) in enumerate(kinds)])
    best = F.array_max(places)
    return F.when(best["at"] >= 0, best["t"]).otherwise("")


def file_index(files: DataFrame, path: str = "source_path") -> DataFrame:
    """Adds stem, normal name, short and robust study keys, type, and whether it is a study report's body."""
    name = normal(F.col("stem"))
    body = (F.contains("nstem", F.lit("csr")) | F.contains("nstem", F.lit("body"))) & ~F.contains("nstem", F.lit("protocol"))
    return (
        files.withColumn("stem", stem(F.col(path)))
        .withColumn("nstem", name)
        .withColumn("study_key", F.regexp_extract("nstem", r"\d{4}\d{2,3}", 0))
        .withColumn("study_key_v2", study_key(F.col("nstem")))
        .withColumn("doc_type", doc_type(F.col("nstem")))
        .withColumn("is_csr_body", body)
    )


def sibling_pick(references: DataFrame, files: DataFrame, key: str, group: list[str], own: str) -> DataFrame:
    """(key, picked): of the files of each reference's group the only one, else the only one of the source's format, else the
    only one in its folder, else null. Files that share ``own`` (a path or a stem) with the source are no candidates.

    references: (key, *group, source, own); files: (*group, candidate, own). Files are counted per group, per format and per
    folder, and a group's only candidate is its first or its last file by ``own``; files never meet files.
    """
    suffix = lambda c: F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/", 1)
    once = files.select(*group, "candidate", own).distinct()
    out, picks = references.select(key, *group, "source", own), []
    for n, part in enumerate((lambda c: F.lit(""), suffix, folder)):
        cols = [*group, f"_part{n}"]
        f = once.withColumn(cols[-1], part(F.col("candidate")))
        item = F.struct(own, "candidate")
        stats = f.groupBy(*cols).agg(F.count(F.lit(1)).alias(f"_n{n}"), F.min(item).alias(f"_lo{n}"), F.max(item).alias(f"_hi{n}"))
        mine = f.groupBy(*cols, own).agg(F.count(F.lit(1)).alias(f"_m{n}"))
        out = out.withColumn(cols[-1], part(F.col("source"))).join(stats, cols, "left").join(mine, [*cols, own], "left")
        other = F.when(F.col(f"_lo{n}.{own}") != F.col(own), F.col(f"_lo{n}.candidate")).otherwise(F.col(f"_hi{n}.candidate"))
        picks.append(F.when(F.col(f"_n{n}") - F.coalesce(f"_m{n}", F.lit(0)) == 1, other))
    return out.select(key, F.coalesce(*picks).alias("picked"))


def token_overlap(name: Column, text: Column) -> Column:
    """Letters of the stem's tokens (3 signs or more) that the normalised text contains."""
    tokens = F.transform(F.split(F.regexp_replace(name, "[-_]", " "), r"\s+"), normal)
    return F.aggregate(F.filter(tokens, lambda t: (F.length(t) >= 3) & F.contains(text, t)), F.lit(0), lambda acc, t: acc + F.length(t))


# Public addresses of standards and registries.
ADDRESSES = {
    "doi": "https://doi.org/", "helsinki": "https://www.wma.net/policies-post/wma-declaration-of-helsinki/", "ich": "https://www.ich.org/page/ich-guidelines",
    "cfr": "https://www.ecfr.gov/current/title-", "nct": "https://clinicaltrials.gov/study/",
}


def target_of(pattern_id: Column, label: Column, text: Column, groups: Column) -> Column:
    """struct(kind, target) of a reference by its label: an address outside, or a bookmark key. ``groups``: its named groups
    (a map; absent ones are missing), for citations surname and year or num, for compounds compound_anchor_key.
    """
    url = lambda x: F.struct(F.lit("external_url").alias("kind"), x.alias("target"))
    mark = lambda x: F.struct(F.lit("internal_bookmark").alias("kind"), x.alias("target"))
    g = lambda k: F.coalesce(F.try_element_at(groups, F.lit(k)), F.lit(""))
    sub = F.when(g("sub") != "", g("sub")).otherwise(g("subpath"))
    letters = F.regexp_replace(F.lower(g("surname")), "[^a-z]", "")
    return (
        F.when(label == "URL", url(text))
        .when(pattern_id == "EXT_REF_DOI_V1", url(F.concat(F.lit(ADDRESSES["doi"]), text)))
        .when(pattern_id == "EXT_REF_HELSINKI_V1", url(F.lit(ADDRESSES["helsinki"])))
        .when(pattern_id == "EXT_REF_ICH_V1", url(F.lit(ADDRESSES["ich"])))
        .when(pattern_id == "EXT_REF_CFR_V1", url(F.concat(F.lit(ADDRESSES["cfr"]), F.when(g("title") != "", g("title")).otherwise("21"), F.lit("/part-"), g("part"))))
        .when(label == "EXT_REF", url(text))
        .when(label.isin("DOC_REF", "DOC_ID") & (g("compound_anchor_key") != ""), mark(g("compound_anchor_key")))
        .when(label == "DOC_REF", mark(F.lit("doc_ref")))
        .when(label == "DOC_ID", mark(F.lit("doc_id")))
        .when((label == "REF_CITE") & (g("surname") != "") & (g("year") != ""), mark(F.concat_ws("_", F.lit("ref"), letters, g("year"))))
        .when((label == "REF_CITE") & (g("num") != ""), mark(F.concat(F.lit("ref_"), F.regexp_replace(g("num"), "^0+(?=.)", ""))))
        .when(label == "REF_CITE", mark(F.lit("ref_heading")))
        .when(label.isin(STRUCTURAL), mark(F.concat_ws("_", F.lower(label), F.translate(F.when(g("num") != "", g("num")).otherwise(text), ".-", "__"))))
        .when(label == "VISIT_REF", mark(F.concat(F.lit("visit_ref_"), F.lower(g("unit")), F.lit("_"), g("n"))))
        .when(pattern_id == "STUDY_ID_NCT_V1", url(F.concat(F.lit(ADDRESSES["nct"]), text)))
        .when(label == "STUDY_ID", mark(F.concat(F.lit("study_"), F.translate(text, "-", "_"))))
        .when((label == "CTD_LEAF") & (sub != ""), mark(F.concat(F.lit("m"), g("mod"), F.lit("_"), F.translate(sub, "./", "__"))))
        .when((label == "CTD_LEAF") & (g("mod") != ""), mark(F.concat(F.lit("m"), g("mod"))))
        .when(label == "CTD_LEAF", mark(F.lit("m?")))
        .otherwise(mark(text))
    )


def module_of_groups(groups: Column) -> Column:
    """Module a leaf reference names: digits of a hyphenated first path segment joined by dots if there are two or more, else
    m<mod>.<first segment>, else m<mod>; null without a module.
    """
    g = lambda k: F.coalesce(F.try_element_at(groups, F.lit(k)), F.lit(""))
    first = F.split(F.when(g("sub") != "", g("sub")).otherwise(g("subpath")), "/")[0]
    digits = F.regexp_replace(first, "[^0-9]", "")
    dotted = F.concat(F.lit("m"), F.substring(digits, 1, 1), F.lit("."), F.array_join(F.split(F.substring(digits, 2, 99), ""), "."))
    return F.when(g("mod") != "", F.when(F.contains(first, F.lit("-")) & (F.length(digits) >= 2), dotted).when(first != "", F.concat(F.lit("m"), g("mod"), F.lit("."), first)).otherwise(F.concat(F.lit("m"), g("mod"))))


def best_leaf(references: DataFrame, leaves: DataFrame) -> DataFrame:
    """(ref_id, leaf_id): the first leaf of exactly the module, else of the longest module that begins it (one direction)."""
    first = leaves.where("module is not null").groupBy("module").agg(F.min(F.struct("ord", "leaf_id"))["leaf_id"].alias("leaf_id"))
    wanted = references.where("module is not null").select("module").distinct()
    heads = wanted.select("module", F.explode(F.transform(F.sequence(F.lit(1), F.length("module")), lambda n: F.expr("module").substr(F.lit(1), n))).alias("head"))
    best = heads.join(first.withColumnRenamed("module", "head"), "head").groupBy("module").agg(F.max(F.struct(F.length("head").alias("n"), "leaf_id"))["leaf_id"].alias("leaf_id"))
    return references.join(best, "module").select("ref_id", "leaf_id")


def in_family(references: DataFrame, leaves: DataFrame, current_module: str | None = None) -> DataFrame:
    """(ref_id, leaf_id, reason) of each reference (ref_id, label, module): its leaf, or why it has none. Only leaf references of
    the current module's family are resolved here, of all families without one.
    """
    head = lambda c: F.split(c, r"\.")[0]
    why = F.when(F.col("label") != "CTD_LEAF", "label").when(F.col("module").isNull(), "no module")
    if current_module is not None:
        why = why.when(head(F.col("module")) != head(F.lit(current_module)), "other family")
    rows = references.withColumn("reason", why)
    found = best_leaf(rows.where("reason is null"), leaves)
    return rows.join(found, "ref_id", "left").select("ref_id", "leaf_id", F.coalesce("reason", F.when(F.col("leaf_id").isNull(), "no leaf")).alias("reason"))


def leaf_cascade(references: DataFrame, leaves: DataFrame, least: float = 0.55) -> DataFrame:
    """(ref_id, leaf_id, confidence, strategy) of every reference: by module, else by study id, else by title; null if none."""
    ranked = (
        leaf_by_module(references, leaves).withColumn("rank", F.lit(1))
        .unionByName(leaf_by_study(references, leaves).select("*", F.lit("study_id").alias("strategy"), F.lit(2).alias("rank")))
        .unionByName(leaf_by_title(references, leaves, least).select("*", F.lit("title").alias("strategy"), F.lit(3).alias("rank")))
    )
    best = ranked.groupBy("ref_id").agg(F.min(F.struct("rank", "leaf_id", "confidence", "strategy")).alias("b"))
    return references.select("ref_id").join(best, "ref_id", "left").select("ref_id", "b.leaf_id", "b.confidence", "b.strategy")


def module_of_path(path: Column) -> Column:
    """Module label of a leaf path: mN, with the leading numbers of the next folder if it has two or more; else unknown."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", ""))
    module = F.regexp_extract(flat, r"^(m\d)(?:/|$)", 1)
    numbers = F.regexp_extract(flat, r"^m\d/(\d+(?:-\d+)*)(?:-|/|$)", 1)
    dotted = F.concat(F.lit("m"), F.translate(numbers, "-", "."))
    return F.when(module == "", "unknown").when(F.contains(numbers, F.lit("-")), dotted).otherwise(module)


def module_chain(module: Column) -> Column:
    """Ancestors of a module from the top: m2.5.3 gives m2, m2.5, m2.5.3; empty for malformed labels."""
    parts = F.split(module, r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.when(F.rlike(module, F.lit(r"^m\d+(\.\d+)*$")), chain).otherwise(F.array().cast("array<string>"))


def leaf_by_module(references: DataFrame, leaves: DataFrame) -> DataFrame:
    """(ref_id, leaf_id, confidence, strategy): the first leaf of exactly the module (.95), else of the longest module that
    is a prefix of it or has it as prefix (.9 less .1 per level between, .6 at least).

    references: (ref_id, module); leaves: (leaf_id, module, ord). Modules, not leaves, are compared for prefixes, so the
    inner product is over distinct labels; those have a few levels and are looked up by equality of truncated labels.
    """
    first = leaves.where("module is not null").groupBy("module").agg(F.min(F.struct("ord", "leaf_id"))["leaf_id"].alias("leaf_id"))
    wanted = references.where("module is not null").select("module").distinct()
    cut_labels = lambda df: df.select("module", F.explode(F.transform(F.sequence(F.lit(2), F.length("module")), lambda n: F.expr("module").substr(F.lit(1), n))).alias("head"))
    down = cut_labels(wanted).join(first.select(F.col("module").alias("head"), F.col("module").alias("known"), "leaf_id"), "head")
    up = cut_labels(first.select("module")).withColumnRenamed("module", "known").join(wanted.withColumn("head", F.col("module")), "head").join(first.withColumnRenamed("module", "known"), "known")
    level = lambda c: F.size(F.split(c, r"\."))
    exact = F.col("known") == F.col("module")
    ranked = down.select("module", "known", "leaf_id").unionByName(up.select("module", "known", "leaf_id")).distinct()
    ranked = ranked.withColumn("confidence", F.when(exact, 0.95).otherwise(F.greatest(F.lit(0.6), F.round(0.9 - 0.1 * F.abs(level("known") - level("module")), 6)))).withColumn("exact", exact)
    best = ranked.groupBy("module").agg(F.max(F.struct("exact", F.length("known").alias("n"), "known", "leaf_id", "confidence")).alias("b"))
    out = references.join(best, "module").select("ref_id", "b.leaf_id", "b.confidence", F.when(F.col("b.exact"), "module").otherwise("module_prefix").alias("strategy"))
    return out


def leaf_by_study(references: DataFrame, leaves: DataFrame) -> DataFrame:
    """(ref_id, leaf_id, confidence): the first leaf whose title, path or id holds the reference's study id (.92), whatever the
    id's shape and whatever stands around it.

    A search for substrings as an equi-join: the pieces of the leaves' text that begin like an id (its first four signs, all
    of a shorter one) and have its length meet the ids whole.
    """
    text = F.upper(F.concat_ws(" ", "title", "path", "leaf_id"))
    ids = references.where("study_id is not null and trim(study_id) <> ''").select(F.upper("study_id").alias("study_id")).distinct()
    heads = ids.select(F.expr("left(study_id, 4)").alias("head"), F.length("study_id").alias("n")).distinct()
    texts = leaves.select("leaf_id", "ord", text.alias("t"))
    places = texts.select("leaf_id", "ord", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i")).where("t <> ''")
    pieces = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.expr("t").substr(F.col("i"), k))
    near = places.select("leaf_id", "ord", "t", "i", F.explode(F.array_distinct(pieces)).alias("head")).join(heads, "head")
    met = near.select("leaf_id", "ord", F.col("t").substr(F.col("i"), F.col("n")).alias("study_id")).join(ids, "study_id", "left_semi")
    first = met.groupBy("study_id").agg(F.min(F.struct("ord", "leaf_id"))["leaf_id"].alias("leaf_id"))
    return references.where("study_id is not null").select("ref_id", F.upper("study_id").alias("study_id")).join(first, "study_id").select("ref_id", "leaf_id", F.lit(0.92).alias("confidence"))


def words(text: Column) -> Column:
    """Distinct lower-case tokens of letters and digits, of two signs or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct items; ``both_empty`` if neither has any, 0 if one has none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def title_keys(titles: DataFrame, sizes: DataFrame, least: float, of_leaf: bool) -> DataFrame:
    """(k, columns of ``titles`` but r): keys under which a title meets the similar ones of the sizes ``m`` that the other side has.

    ``r`` holds a title's tokens, rare ones first. Sets of n and m tokens whose similarity is ``least`` or more share o tokens, so
    the first n - o + l of the one and m - o + l of the other share l; each choice of l of them is a key. l is KEY_TOKENS, or
    less where that makes more than MOST_KEYS keys. Keys of different tokens may be equal: the similarity decides.
    """
    n, m, o, p = (F.col(c) for c in ("n", "m", "o", "p"))
    of = dict.fromkeys(range(2, KEY_TOKENS + 1), 0)  # most tokens to choose from
    for l in of:
        while math.comb(of[l] + 1, l) <= MOST_KEYS:
            of[l] += 1
    rows = [(l, q, *c, *["cast(null as int)"] * (KEY_TOKENS - l)) for l, most in of.items() for q in range(l, most + 1) for c in combinations(range(q), l)]
    choices = titles.sparkSession.sql("VALUES " + ", ".join(f"({', '.join(map(str, r))})" for r in rows)).toDF("shared", "p", *[f"i{j}" for j in range(KEY_TOKENS)])
    df = titles.withColumn("n", F.size("r")).join(F.broadcast(sizes)).withColumn("o", F.greatest(F.lit(1), F.ceil((n + m) * (least / (1 + least)) - 1e-6)).cast("int")).where(o <= F.least(n, m))
    each = F.lit(1)
    for l, most in of.items():
        each = F.when((o >= l) & (F.greatest(n, m) - o + l <= most), l).otherwise(each)
    df = df.withColumn("shared", each).withColumn("p", n - o + F.col("shared"))
    pair = [m, n] if of_leaf else [n, m]
    kept = [F.col(c) for c in titles.columns if c != "r"]
    one = df.where("shared = 1").select(F.explode(F.slice("r", F.lit(1), p)).alias("w"), *pair, *kept).select(F.xxhash64(*pair, "w").alias("k"), *kept)
    return one.unionByName(df.join(F.broadcast(choices), ["shared", "p"]).select(F.xxhash64(*pair, *[F.get("r", F.col(f"i{j}")) for j in range(KEY_TOKENS)]).alias("k"), *kept))


def leaf_by_title(references: DataFrame, leaves: DataFrame, least: float = 0.55) -> DataFrame:
    """(ref_id, leaf_id, confidence): the leaf with the most similar title, the first of equals, if ``least`` or more.

    Each distinct set of tokens is looked up once. No leaf is better than one with the same tokens, and only those better than one
    with a single further token; both are found by equality. The other sets meet the leaves by keys of their rarest tokens (see
    title_keys), which all similar sets share, so nothing is lost.
    """
    left = cut(references.where("title is not null").select("ref_id", F.sort_array(words(F.col("title"))).alias("t"))).where("size(t) > 0")
    right = cut(leaves.where("title is not null").groupBy(F.sort_array(words(F.col("title"))).alias("t")).agg(F.min(F.struct("ord", "leaf_id")).alias("l"))).where("size(t) > 0")
    whole = F.struct(F.concat_ws(" ", "t").alias("k"), F.lit(0).alias("more"))
    less = F.transform("t", lambda w: F.struct(F.concat_ws(" ", F.array_remove("t", w)).alias("k"), F.lit(1).alias("more")))
    nearest = right.select(F.explode(F.concat(F.array(whole), F.when((F.size("t") - 1) / F.size("t") >= least, less).otherwise(F.array().cast("array<struct<k:string,more:int>>")))).alias("x"), "l").groupBy("x.k").agg(F.min(F.struct("x.more", "l")).alias("x"))
    asked = cut(left.select("t").distinct().withColumn("k", F.concat_ws(" ", "t")).join(nearest, "k", "left").select("t", (F.size("t") / (F.size("t") + F.col("x.more"))).alias("s"), F.col("x.l").alias("l")))

    counts = right.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    # rows of at most 1,000 tokens, whatever the input; those below come first, in the order of their letters
    frequent = counts.join(F.broadcast(counts.agg(F.sum("f").alias("all"))), F.col("f") > F.col("all") / MAX_HEAVY_KEYS).select("w", "f")

    def ranked(df: DataFrame) -> DataFrame:
        tokens = df.select(*df.columns, F.explode("t").alias("w")).join(F.broadcast(frequent), "w", "left").groupBy(*df.columns).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w"))).alias("r"))
        return tokens.withColumn("r", F.col("r.w"))

    rest = asked.where("l is null").select("t")
    sizes = lambda df: df.select(F.size("t").alias("m")).distinct()
    met = title_keys(cut(ranked(rest)), sizes(right), least, False).join(title_keys(cut(ranked(right)), sizes(rest), least, True).select("k", "l"), "k").select("t", "l").distinct()
    scored = met.join(right.withColumnRenamed("t", "u"), "l").select("t", jaccard(F.col("t"), F.col("u")).alias("s"), "l").where(F.col("s") >= least)
    order = F.struct("s", (-F.col("l.ord")).alias("o"), F.col("l.leaf_id").alias("leaf_id"))
    found = asked.where("l is not null").unionByName(scored).groupBy("t").agg(F.max(order).alias("b"))
    best = left.join(found, "t").groupBy("ref_id").agg(F.max("b").alias("b"))
    return best.select("ref_id", "b.leaf_id", F.round("b.s", 6).alias("confidence"))


def relative_uri(source: Column, target: Column, anchor: Column | None = None) -> Column:
    """POSIX path from the folder of ``source`` to ``target``, with #anchor if one is given. Paths in one spelling."""
    here = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1)
    there = F.split(target, "/")
    same = F.aggregate(F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["go"] & x).alias("go"), F.when(acc["go"] & x, acc["n"] + 1).otherwise(acc["n"]).alias("n")))["n"]
    rest = F.slice(there, same + 1, F.size(there))
    path = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(here) - same), rest), "/")
    path = F.when(path == "", ".").otherwise(path)
    return path if anchor is None else F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(path, F.lit("#"), anchor)).otherwise(path)
