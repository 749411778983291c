"""Cross-document resolution: which file of its dossier a reference leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import resolution as R
from linkloom.runtime import cut

#: Letters a stem's tokens must share with a reference to be its target.
LEAST_OVERLAP = 4


def resolve_documents(references: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, target, strategy) of every reference; target is null where it leads outside, to its own document or nowhere.

    references: (ref_id, dossier_id, label, pattern_id, text, context, source_path, qualifier), qualifier being a document
    type found before, or null. files: (dossier_id, source_path, ord); the first by ord wins among equals.

    The strategies are tried in order and each only on what the ones before left open; a strategy may also end the search
    without a target. Each is an equi-join within the dossier, on type and study key, or on study keys cut out of the text.
    """
    index = cut(R.file_index(files.where("source_path is not null")))
    src = R.normal(R.stem(F.col("source_path")))
    dt = F.coalesce(F.nullif(F.col("qualifier"), F.lit("")), F.when(F.col("label") == "DOC_REF", R.doc_type_of_text(F.col("text"))), F.lit(""))
    search = F.concat(R.normal(F.col("text")), R.normal(F.coalesce("context", F.lit(""))))
    refs = cut(
        references.select("ref_id", "dossier_id", "label", F.coalesce("pattern_id", F.lit("")).alias("pattern_id"), F.coalesce("text", F.lit("")).alias("text"), "context", "source_path", "qualifier")
        .withColumn("src_stem", R.stem(F.col("source_path"))).withColumn("src_type", R.doc_type(src)).withColumn("src_norm", src)
        .withColumn("src_key", R.study_key(src)).withColumn("dt", dt).withColumn("ntext", R.normal(F.col("text"))).withColumn("search", search)
    )
    done = lambda df, target, name: df.select("ref_id", target.cast("string").alias("target"), F.lit(name).alias("strategy"))
    out = []

    def settle(found: DataFrame, open_refs: DataFrame) -> DataFrame:
        found = cut(found)
        out.append(found)
        return cut(open_refs.join(found.select("ref_id"), "ref_id", "left_anti"))

    outside = (F.col("ntext") == "") | (F.col("pattern_id") == "STUDY_ID_NCT_V1") | F.col("label").isin("EXT_REF", "URL")
    rest = settle(done(refs.where(outside), F.lit(None), "outside"), refs)

    # a document by type: of the same study, else picked among the dossier's files of that type
    typed = rest.where(F.col("label").isin("DOC_REF", "DOC_ID") & (F.col("dt") != ""))
    rest = settle(_typed(typed, index, True), rest)
    rest = settle(done(rest.where("label = 'DOC_REF'"), F.lit(None), "no_type"), rest)

    # a study key in the text, or else in text and context
    keys = index.where("study_key <> ''").select("dossier_id", "study_key", "stem", "nstem", "is_csr_body", "ord", F.col("source_path").alias("path"))
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(6), F.lit(7)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: c.substr(i, n)))))
    digits = lambda c: F.filter(pieces(c), lambda p: F.rlike(p, F.lit(r"^\d{6,7}$")))
    named_in = lambda c: F.filter(F.array(*map(F.lit, R.DOC_TYPES)), lambda k: F.contains(c, k))
    own = rest.select("ref_id", "dossier_id", F.explode(digits(F.col("ntext"))).alias("study_key")).join(keys, ["dossier_id", "study_key"]).select("ref_id").distinct().withColumn("in_text", F.lit(True))
    searched = rest.join(own, "ref_id", "left").withColumn("where", F.when(F.col("in_text"), F.col("ntext")).otherwise(F.col("search"))).withColumn("named", named_in(F.col("where")))
    hits = searched.select("ref_id", "dossier_id", "src_stem", "src_norm", "named", F.explode(digits(F.col("where"))).alias("study_key")).join(keys, ["dossier_id", "study_key"]).where("stem <> src_stem")
    fits = F.exists("named", lambda k: F.contains(F.col("nstem"), k))
    first = lambda cond: F.min(F.when(cond, F.struct((~F.col("is_csr_body")).cast("int").alias("o"), "ord", "path")))
    per = hits.groupBy("ref_id", "named", "src_norm").agg(first(fits).alias("typed"), F.min(F.when(F.col("is_csr_body"), F.struct("ord", "path"))).alias("body"))
    any_named = F.size("named") > 0
    own_named = F.exists("named", lambda k: F.contains(F.col("src_norm"), k))
    is_body = F.contains("src_norm", F.lit("csr")) | F.contains("src_norm", F.lit("body"))
    target = F.when(any_named, F.col("typed.path")).otherwise(F.col("body.path"))
    stop = F.when(any_named, own_named).otherwise(is_body)
    rest = settle(done(per.where(target.isNotNull() | stop), target, "study_key"), rest)

    # table, section and the like, qualified by a document type
    near = rest.where(F.col("label").isin(R.STRUCTURAL)).withColumn("dt", F.coalesce(F.nullif(F.col("qualifier"), F.lit("")), R.qualifier(F.coalesce("context", F.lit("")), F.col("text")))).where("dt <> ''")
    rest = settle(_typed(near, index, False).where("target is not null"), rest)

    # tokens of the file name in the text
    best = _by_tokens(rest, index)
    rest = settle(done(best, F.col("path"), "tokens"), rest)
    out.append(done(rest, F.lit(None), "none"))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def _by_tokens(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(ref_id, path): the file of the dossier, not of the source's stem, whose stem's tokens make up most letters of the text.

    Distinct texts and tokens of a dossier meet at the tokens' first three signs. Per text the best file and the best of
    another stem are kept, one of which is not the source's; references meet these two.
    """
    parts = F.transform(F.split(F.regexp_replace("stem", "[-_]", " "), r"\s+"), R.normal)
    files = index.select("dossier_id", "stem", "ord", F.col("source_path").alias("path"), F.explode(parts).alias("token")).where("length(token) >= 3")
    texts = refs.select("dossier_id", "ntext").where("length(ntext) >= 3").distinct()
    heads = texts.select("dossier_id", "ntext", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("ntext") - 2), lambda i: F.col("ntext").substr(i, F.lit(3))))).alias("head"))
    tokens = files.select("dossier_id", "token", F.expr("left(token, 3)").alias("head")).distinct()
    held = heads.join(tokens, ["dossier_id", "head"]).where(F.contains("ntext", F.col("token"))).select("dossier_id", "ntext", "token")
    scored = held.join(files, ["dossier_id", "token"]).groupBy("dossier_id", "ntext", "stem", "ord", "path").agg(F.sum(F.length("token")).alias("score")).where(F.col("score") >= LEAST_OVERLAP)
    top = lambda df: df.groupBy("dossier_id", "ntext").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "path", "stem")).alias("b"))
    scored = cut(scored.groupBy("dossier_id", "ntext", "stem").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "path")).alias("b")).select("dossier_id", "ntext", "stem", "b.score", (-F.col("b.o")).alias("ord"), "b.path"))
    first = top(scored)
    second = top(scored.join(first.select("dossier_id", "ntext", F.col("b.stem").alias("stem")), ["dossier_id", "ntext", "stem"], "left_anti")).withColumnRenamed("b", "c")
    both = refs.select("ref_id", "dossier_id", "ntext", "src_stem").join(first, ["dossier_id", "ntext"]).join(second, ["dossier_id", "ntext"], "left")
    return both.select("ref_id", F.when(F.col("b.stem") != F.col("src_stem"), F.col("b.path")).otherwise(F.col("c.path")).alias("path")).where("path is not null")


def _typed(refs: DataFrame, index: DataFrame, own_type_ends: bool) -> DataFrame:
    """The first file of the wanted type and the source's study; else, unless the source itself is of that type and that
    ends the search, the pick among the dossier's files of that type. A row for every reference.

    Files of one type and study are reduced to the first and the first of another stem before references meet them.
    """
    files = index.select("dossier_id", F.col("doc_type").alias("dt"), "stem", "study_key_v2", "ord", F.col("source_path").alias("candidate"))
    group = ["dossier_id", "dt", "study_key_v2"]
    stems = files.where("study_key_v2 <> ''").groupBy(*group, "stem").agg(F.min(F.struct("ord", "candidate")).alias("x"))
    first = stems.groupBy(*group).agg(F.min(F.struct("x.ord", "x.candidate", "stem")).alias("b"))
    second = stems.join(first.select(*group, F.col("b.stem").alias("stem")), [*group, "stem"], "left_anti").groupBy(*group).agg(F.min(F.struct("x.ord", "x.candidate", "stem")).alias("c"))
    met = refs.select("ref_id", "dossier_id", "dt", "src_stem", F.col("src_key").alias("study_key_v2")).join(first, group).join(second, group, "left")
    same = met.select("ref_id", F.when(F.col("b.stem") != F.col("src_stem"), F.col("b.candidate")).otherwise(F.col("c.candidate")).alias("same"))
    picked = R.sibling_pick(refs.select("ref_id", "dossier_id", "dt", F.col("source_path").alias("source"), F.col("src_stem").alias("stem")), files.select("dossier_id", "dt", "candidate", "stem"), "ref_id", ["dossier_id", "dt"], "stem")
    both = refs.select("ref_id", "src_type", "dt").join(same, "ref_id", "left").join(picked, "ref_id", "left")
    ends = F.lit(own_type_ends) & (F.col("src_type") == F.col("dt"))
    return both.select("ref_id", F.coalesce("same", F.when(~ends, F.col("picked"))).alias("target"), F.when(F.col("same").isNotNull(), "same_study").when(ends, "self").otherwise("sibling").alias("strategy"))
