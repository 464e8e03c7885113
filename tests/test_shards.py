import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turfspoor.functions import text as T
from turfspoor.operators import fusion, lexical, semantic, shards

WORDS = "storing server printer kabel mail sleutel deur kast planning sensor sensoren sensorkast zit zit zit".split()


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(n, f"c{n:03d}", rng.choice(["a", "b", None]), "vol" if n % 3 == 0 else f"p{n % 20}", n, text(1), text(2), text(rng.randint(0, 9))) for n in range(300)]
    chunks = spark.createDataFrame(rows, "ord long, chunk_id string, source string, path string, ordinal int, title string, section string, text string")
    return lexical.LexicalIndex.of(chunks, keep=True)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(4)
    rows = [(n, " ".join(rng.choice([*WORDS, "onbekend"]) for _ in range(rng.randint(0, 4))), rng.choice([None, "", "a", "zonder"])) for n in range(40)]
    return spark.createDataFrame(rows, "question_id long, question string, source string")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_hybrid_search_takes_the_best_of_each_question_out_of_the_shards(index, asked, monkeypatch):
    monkeypatch.setattr(shards, "ASKED", 20)  # several blocks of questions
    phrases, some = lexical.attempts(asked), F.col("attempt") == 3
    only = lexical.only_of(asked)
    hits = index.match(phrases, F.when(some, "or").otherwise("and")).withColumn("score", F.round("score", 12)).join(only, "question_id").filter("only is null or only = source")
    found = index.best_matches(phrases, some, 5, only)
    columns = ["question_id", "attempt", "ord", "score", "rank"]
    assert rows_of(lexical.best(found, columns[:2], 5).select(columns)) == rows_of(lexical.best(hits, columns[:2], 5).select(columns))
    # before, a row for every chunk that a word of a question meets went through the shuffles
    shown = found.groupBy("question_id", "attempt").count().agg(F.max("count")).first()[0]
    assert shown <= 5 * asked.sparkSession.sparkContext.defaultParallelism and found.count() < hits.count()


def test_sibling_chunks_are_the_best_two_of_each_document(index, asked):
    hits = index.match(lexical.attempts(asked), F.lit("or")).filter("attempt = 3").select("question_id", "ord", "source", "path").filter("ord % 7 = 0")
    names = F.array().cast("array<array<string>>")
    got = fusion.siblings(index, hits, asked, names, 2)
    words = asked.select("question_id", F.posexplode(T.coarse_stems(T.content_words(F.col("question")))).alias("phrase_no", "x"))
    phrases = words.select("question_id", F.lit(1).alias("attempt"), "phrase_no", T.tokens(F.col("x.token")).alias("tokens"), F.col("x.prefix").alias("prefix"), F.array(F.lit("section"), F.lit("text")).alias("cols"))
    others = index.match(phrases, F.lit("or")).withColumn("score", F.round("score", 12)).join(hits.select("question_id", "source", "path").distinct(), ["question_id", "source", "path"]).join(hits, ["question_id", "ord"], "left_anti")
    w = Window.partitionBy("question_id", "source", "path").orderBy(F.desc("score"), "ord")
    want = others.withColumn("at", F.row_number().over(w)).filter("at <= 2").select("question_id", "source", "path", "ord")
    assert rows_of(got.select("question_id", "source", "path", F.explode("siblings"))) == rows_of(want)
    assert "vol" in {r.path for r in got.collect()}


def test_full_search_scans_the_vectors_once_for_many_questions(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(60, 4)), 10, axis=0)
    vectors = spark.createDataFrame([(n, "ab"[n % 2], v.tolist()) for n, v in enumerate(x)], "ord long, source string, vec array<double>").repartition(3)
    q = rng.normal(size=(4100, 4))
    asked = spark.createDataFrame([(n, "b" if n % 3 == 0 else None, v.tolist()) for n, v in enumerate(q)], "question_id long, source string, vec array<double>")
    monkeypatch.setattr(semantic, "WIDE", 100)  # several cuts; workers that are forked later see it
    found = semantic.top_similar(asked, vectors, 4, 12)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1
    got = {}
    for r in found.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.ord)
    sims = np.round(q @ x.T, 12)
    for n in range(len(q)):
        ids = np.arange(600) if n % 3 else np.arange(1, 600, 2)
        assert got[n] == ids[np.lexsort((ids, -sims[n][ids]))][:12].tolist()


def test_nearest_rows_survive_many_cuts():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(3, 5)), np.repeat(rng.normal(size=(500, 5)), 4, axis=0)
    nearest = semantic.Nearest(q, 6)
    for a in range(0, 2000, 40):
        nearest.see(x[a : a + 40], np.arange(a, min(a + 40, 2000)))
    nearest.cut()
    sims = np.round(q @ x.T, 12)
    for n in range(3):
        assert nearest.ord[nearest.question == n].tolist() == np.lexsort((np.arange(2000), -sims[n]))[:6].tolist()
