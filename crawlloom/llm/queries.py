"""Queries of the corpus problems (p1, p2, p3, p7, p8, p9, p10) and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.llm import encoding, language, mixing, packing, reading, residue, stuffing, tokens
from crawlloom.session import stage
from crawlloom.tables import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "page_id", "url", "host", "lang", "text")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every document beside what the crawl says of its page."""
    pages = table(spark, d, "pages", "page_id", "word_count", "internal_links_count", "text_to_html_ratio")
    return stuffing.with_page(stuffing.stuffed(_documents(spark, d), pages), pages)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(_documents(spark, d), _counts(spark, d)).where("found").select("doc_id")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "word_count", "internal_links_count")


def _clean(docs: DataFrame, every: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id of ``docs`` that neither p1 nor p7 finds."""
    bad = stuffing.stuffed(docs, pages).where("found").select("doc_id").unionByName(residue.residue(residue.corpus_lines(docs), residue.corpus_lines(every)).select(F.col("id").alias("doc_id")))
    return docs.select("doc_id").join(bad, "doc_id", "left_anti")


def _profiles(spark: SparkSession, d: str) -> language.Profiles:
    return language.fit(_documents(spark, d), table(spark, d, "doc_labels", "doc_id", "reviewed_lang"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and page (segment null), of each segment of a
    document in one language, and of title and description where they differ."""
    docs = _documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    profiles = _profiles(spark, d)
    rest = ["segment", "field", "start", "n_chars", "lang", "confidence"]
    of_docs = language.segments(docs, profiles, True).select(F.lit("documents").alias("table_name"), F.col("id").alias("record_id"), F.lit("text").alias("field"), *[c for c in rest if c != "field"])
    pages = language.page_languages(table(spark, d, "pages", "page_id", "title", "meta_description", "language"), profiles, True)
    of_pages = pages.select(F.lit("pages").alias("table_name"), F.col("page_id").alias("record_id"), "field", "segment", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("n_chars"), "lang", "confidence")
    return of_docs.unionByName(of_pages).select("table_name", "record_id", *rest)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    profiles = _profiles(spark, d)
    docs = _documents(spark, d)
    told = language.told(docs.select(F.col("doc_id").alias("id"), "text"), profiles).withColumn("are", language.document_languages(None)).select("id", "are")
    label = language.label_code("lang")
    doc_cases = docs.select(F.col("doc_id").alias("id"), label.alias("label")).join(told, "id").where("are is not null and (size(are) > 1 or label is null or label <> are[0])").select("id", "are")
    doc_cases = stage(doc_cases, "cases")
    suspects = docs.join(doc_cases.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    clean = _clean(suspects, docs, _counts(spark, d)).select(F.col("doc_id").alias("id"))
    of_docs = doc_cases.join(clean, "id", "left_semi").select(F.lit("documents").alias("table_name"), F.col("id").alias("record_id"), F.explode("are").alias("lang"))

    pages = table(spark, d, "pages", "page_id", "title", "meta_description", "language")
    cases = language.page_languages(pages, profiles)
    cases = stage(cases.where("size(are) > 1 or label is null or label <> are[0]"), "page_cases")
    fields = pages.join(cases.select("page_id"), "page_id", "left_semi")
    bad = residue.field_residue(fields).select(F.col("id").alias("page_id")).distinct()
    of_pages = cases.join(bad, "page_id", "left_anti").select(F.lit("pages").alias("table_name"), F.col("page_id").alias("record_id"), F.explode("are").alias("lang"))
    return of_docs.unionByName(of_pages)


def _values(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "pages", "page_id", "title", "meta_description"), table(spark, d, "documents", "doc_id", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).where("damage is not null").select("table_name", "record_id", "field")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Damaged values with the restored text and the class of damage; lost ones without text."""
    v = _values(spark, d).where("damage is not null")
    return v.select("table_name", "record_id", "field", "damage", F.when(F.col("damage") != "lost", F.col("restored")).alias("restored"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    of_docs = residue.residue(residue.corpus_lines(_documents(spark, d))).select(F.lit("documents").alias("table_name"), F.col("id").alias("record_id"))
    of_pages = residue.field_residue(table(spark, d, "pages", "page_id", "title", "meta_description")).select(F.lit("pages").alias("table_name"), F.col("id").alias("record_id")).distinct()
    return of_docs.unionByName(of_pages)


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents that stay in the corpus."""
    docs = _documents(spark, d)
    bad = residue.residue(residue.corpus_lines(docs)).select(F.col("id").alias("doc_id"))
    return docs.join(bad, "doc_id", "left_anti").select("doc_id", "url", "host")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.sized(table(spark, d, "documents", "doc_id", "source", "text"), "doc_id", "source")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), table(spark, d, "pack_limits", "limit_id", "capacity_tokens"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_pack(spark, d), table(spark, d, "pack_limits", "limit_id", "capacity_tokens"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "source_targets", "source", "target_share", "max_repeats"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "source_targets", "source", "target_share"))


def p9_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shard_sizes(p9_mix(spark, d))


def _model(spark: SparkSession, d: str) -> reading.Levels:
    return reading.fit(reading.reviewed(_documents(spark, d), table(spark, d, "doc_labels", "doc_id", "reviewed_lang", "reading_level")))


def _english(docs: DataFrame, profiles: language.Profiles) -> DataFrame:
    told = language.told(docs.select(F.col("doc_id").alias("id"), "text"), profiles).withColumn("are", language.document_languages(None))
    return told.where("are = array('en')").select(F.col("id").alias("doc_id"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document, by the model of its language; null where none can be told."""
    docs = _documents(spark, d)
    models = reading.fit_each(reading.reviewed_each(docs, table(spark, d, "doc_labels", "doc_id", "reviewed_lang", "reading_level")))
    return reading.levels_each(docs, models, _profiles(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Levels are told first: words of other languages have no difficulty, so what isn't
    English mostly drops out there, and the rest of the work sees level 3 only."""
    docs = _documents(spark, d)
    hard = stage(reading.hard(docs, _model(spark, d)), "hard")
    at_three = docs.join(hard, "doc_id", "left_semi")
    english = stage(_english(at_three, _profiles(spark, d)), "english")
    return _clean(docs.join(english, "doc_id", "left_semi"), docs, _counts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_scores, p2_found, p2_languages, p3_found, p3_restored, p7_found, p7_kept, p8_pack, p8_fill, p9_mix, p9_shares, p9_shards, p10_found, p10_levels)
}
# Byte-pair merges, automata, ciphers and iterative fits have no SQL: see tests/llm.
ORACLE: dict[str, str] = {}
