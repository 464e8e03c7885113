"""Hybrid search of many questions in one plan: word list, semantic list, name lists, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.config import Settings
from turfspoor.functions.arrow import snippets
from turfspoor.functions.text import coarse_stems, content_words, fold, names
from turfspoor.operators import fusion, grammar, lexical, semantic
from turfspoor.session import written

WORDS, MEANING, NAMES = "woorden", "betekenis", "namen"


def ranked_lists(index: lexical.LexicalIndex, vectors: DataFrame | None, questions: DataFrame, settings: Settings) -> DataFrame:
    """(question_id, list_no, list_name, ord, rank, weight) of all lists of ordinary questions."""
    words = lexical.word_list(index, questions, settings.stemmer)
    lists = words.select("question_id", F.lit(0).alias("list_no"), F.lit(WORDS).alias("list_name"), "ord", "rank", "weight")
    if vectors is not None and "vec" in questions.columns:
        near = semantic.top_similar(questions, vectors, settings.dim)
        lists = lists.unionByName(near.select("question_id", F.lit(1).alias("list_no"), F.lit(MEANING).alias("list_name"), "ord", "rank", F.lit(1.0).alias("weight")))
    if settings.name_weight:
        named = lexical.name_lists(index, questions, names(F.col("question")), settings.name_weight)
        lists = lists.unionByName(named.select("question_id", (F.col("list_no") + 2).alias("list_no"), F.lit(NAMES).alias("list_name"), "ord", "rank", "weight"))
    return lists


def search(index: lexical.LexicalIndex, chunks: DataFrame, questions: DataFrame, settings: Settings | None = None, vectors: DataFrame | None = None, as_of: Column | None = None, default_k: int = 8) -> DataFrame:
    """The hits of each question (question_id, question, optional source, k, vec), best first.

    A hit has place, score, signals, the fields of its chunk and ``siblings`` (on the best hit of a
    document: the order numbers of its other chunks that fit). A null or empty question has none.
    """
    settings = settings or Settings()
    asked = questions.filter(F.col("question_id").isNotNull())
    asked = asked.withColumn("k", F.coalesce(F.col("k"), F.lit(default_k)) if "k" in questions.columns else F.lit(default_k))
    lists = ranked_lists(index, vectors, asked, settings)
    fused = fuse(lists)
    facts = fused.join(chunks.select("ord", "chunk_id", "source", "path", "title", "section", "date", "status"), "ord").join(asked.select("question_id", "k"), "question_id")
    top = fusion.rerank(facts, F.col("k"), ["question_id"], settings.recency_bonus, settings.recency_days, as_of)
    hits = top.select("question_id", "place", "ord", "chunk_id", "source", "path", "title", "section", "date", "status", "score", "signals")
    if settings.siblings:
        hits = written(hits, "hits")
        more = fusion.siblings(index, hits, asked, names(F.col("question")), settings.siblings)
        first = F.row_number().over(Window.partitionBy("question_id", "source", "path").orderBy("place")) == 1
        hits = hits.withColumn("_first", first).join(more, ["question_id", "source", "path"], "left").withColumn("siblings", F.when(F.col("_first"), F.col("siblings"))).drop("_first")
    if settings.snippets:
        words = content_words(F.col("question"))
        stems = F.transform(F.filter(coarse_stems(words), lambda x: x.getField("prefix")), lambda x: F.concat(fold(x.getField("token")), F.lit("*")))
        terms = asked.select("question_id", F.concat(F.transform(words, fold), stems, F.flatten(names(F.col("question")))).alias("terms"))
        hits = hits.join(chunks.select("ord", "text"), "ord").join(terms, "question_id").withColumn("fragment", snippets(F.col("text"), F.col("terms"), settings.snippet_marks)).drop("text", "terms")
    return hits


def fuse(lists: DataFrame, k: int = lexical.RRF_K) -> DataFrame:
    """(question_id, ord, score, signals, first_list, first_rank): the sum over the lists in their order."""
    part = lists.withColumn("part", F.col("weight") / (F.lit(k) + F.col("rank")))
    ordered = F.array_sort(F.collect_list(F.struct("list_no", "part", "list_name", "rank")))
    grouped = part.groupBy("question_id", "ord").agg(ordered.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x.getField("part"))
    signals = F.array_distinct(F.transform("parts", lambda x: x.getField("list_name")))
    return grouped.select("question_id", "ord", score.alias("score"), signals.alias("signals"), F.col("parts")[0]["list_no"].alias("first_list"), F.col("parts")[0]["rank"].alias("first_rank"))


def search_one(index: lexical.LexicalIndex, chunks: DataFrame, question: str, settings: Settings | None = None, vectors: DataFrame | None = None, k: int = 8, source: str | None = None, as_of: Column | None = None, embedder: semantic.Embedder | None = None) -> DataFrame:
    """The hits of one question, which may be in the query language.

    A valid query is searched as it stands, in the words alone and without siblings; one that is not
    valid loses its signs and is an ordinary question.
    """
    settings = settings or Settings()
    spark = chunks.sparkSession
    if grammar.is_syntax(question):
        try:
            found = grammar.search_raw(index, question, source)
        except grammar.QuerySyntaxError:
            question = grammar.without_syntax(question)
        else:
            listed = found.select("question_id", F.lit(0).alias("list_no"), F.lit(WORDS).alias("list_name"), "ord", "rank", F.lit(1.0).alias("weight"))
            facts = fuse(listed).join(chunks.select("ord", "chunk_id", "source", "path", "title", "section", "date", "status"), "ord")
            top = fusion.rerank(facts, F.lit(k), ["question_id"], settings.recency_bonus, settings.recency_days, as_of)
            return top.select("question_id", "place", "ord", "chunk_id", "source", "path", "title", "section", "date", "status", "score", "signals")
    asked = spark.createDataFrame([(0, question, source, k)], "question_id long, question string, source string, k int")
    if vectors is not None:
        asked = asked.withColumn("vec", (embedder or semantic.TrigramEmbedder(settings.dim)).questions(F.col("question")))
    return search(index, chunks, asked, settings, vectors, as_of)
