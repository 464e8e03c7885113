"""The registered queries of the operators in this folder."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspoor.llm import markup, mixing, neardup, personal, ranking, reading, relevance, tokenize, vectors
from turfspoor.session import table, written

FIELDS = ("titel", "sectie", "tekst")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, folder, "stuk")).pairs().select("id_a", "id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, folder, "stuk")).groups()


def _personal(spark: SparkSession, folder: str):
    chunks, tasks = table(spark, folder, "stuk"), table(spark, folder, "taken")
    texts = chunks.select(F.col("tekst").alias("t")).unionAll(tasks.select(F.col("omschrijving").alias("t")))
    return chunks, tasks, personal.learn_lexicon(texts, "t", table(spark, folder, "naamlijst"))


#: Where the session names no key, each driver has its own, and nobody can undo its pseudonyms.
OWN_KEY = secrets.token_bytes(32)


def _key(spark: SparkSession) -> bytes:
    given = spark.conf.get("spark.turfspoor.sleutel", None)
    return given.encode() if given else OWN_KEY


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks, tasks, lexicon = _personal(spark, folder)
    rows = chunks.select(F.lit("stuk").alias("tabel"), F.col("id").alias("sleutel"), F.col("tekst").alias("t"))
    rows = rows.unionAll(tasks.select(F.lit("taken"), F.col("regel").cast("string"), F.col("omschrijving")))
    return personal.find_values(rows, ["tabel", "sleutel"], "t", lexicon, _key(spark)).drop("pseudoniem")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    chunks, tasks, lexicon = _personal(spark, folder)
    rows = chunks.select(F.lit("stuk").alias("tabel"), F.col("id").alias("sleutel"), F.col("tekst").alias("tekst"))
    rows = rows.unionAll(tasks.select(F.lit("taken"), F.col("regel").cast("string"), F.col("omschrijving")))
    return personal.mask_values(rows, "tekst", lexicon, _key(spark))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = relevance.distinctive_terms(table(spark, folder, "stuk"), "id", FIELDS, min_tf=3, min_df=2, max_df=8)
    return scored.select("id", "term").distinct()


def p3_weights(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.distinctive_terms(table(spark, folder, "stuk"), "id", FIELDS).withColumn("weight", F.round("weight", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.residue(table(spark, folder, "stuk"), "id", ["tekst", "ruw"])


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.analyse(table(spark, folder, "stuk"), "id", ["tekst", "ruw"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    near = vectors.most_similar(table(spark, folder, "vector"), min_cosine=0.9, relax=5.0)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def _ranked(spark: SparkSession, folder: str):
    names = ("treffer", "stuk", "vector", "vraag")
    facts = written(ranking.candidates(*[table(spark, folder, n) for n in names]), "candidates")
    return facts, ranking.rank_walk(facts, "vraag_id", "id", ranking.SCORES)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    facts, ranked = _ranked(spark, folder)
    return ranking.leaders(ranked, facts)


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder)[1].select("vraag_id", "id", "plaats", F.round("kans", 6).alias("kans"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mengdoel"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mengdoel"))[1]


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "leesoordeel"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.ends_of_scale(_levels(spark, folder))


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("doc_id", F.round("moeilijkheid", 2).alias("moeilijkheid"), F.round("w", 6).alias("w"), F.round("l", 6).alias("l"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_masked, p3_found, p3_weights, p4_found, p4_clean, p6_found, p7_found, p7_order, p8_ids, p9_mix, p9_shares, p10_found, p10_levels)}
