"""Retrieval quality: reciprocal rank, found and completeness over a set of questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation set of a JSON list: vraag and verwacht, optional bron, k and verwacht_alle.

    Raises ValueError where a question lacks a field, a pattern does not compile or k is not positive.
    """
    rows = []
    for n, r in enumerate(spark.read.json(path, multiLine=True).toLocalIterator()):
        q = r.asDict()
        if not q.get("vraag") or not q.get("verwacht"):
            raise ValueError(f"question {n} needs vraag and verwacht")
        every = q.get("verwacht_alle") or []
        if isinstance(every, str):
            raise ValueError(f"question {n}: verwacht_alle is a list")
        try:
            for p in [q["verwacht"], *every]:
                re.compile(p)
        except re.error as e:
            raise ValueError(f"question {n}: {e}") from e
        k = q.get("k")
        if k is not None and (not isinstance(k, int) or k <= 0):
            raise ValueError(f"question {n}: k is a positive number")
        rows.append((n, q["vraag"], q["verwacht"], q.get("bron"), k, list(every)))
    return spark.createDataFrame(rows, "question_id long, question string, expected string, source string, k int, expected_all array<string>")


def matches(pattern: str, *columns: str):
    """Whether a pattern, which is a column itself, is found in any of the columns, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.expr(f"coalesce({c}, '') rlike concat('(?i)', {pattern})")
    return hit


def ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, rank): the place of the first hit whose path or title is expected, else null.

    ``hits`` has question_id, place, path and title.
    """
    good = hits.join(questions.select("question_id", "expected"), "question_id").filter(matches("expected", "path", "title"))
    first = good.groupBy("question_id").agg(F.min("place").alias("rank"))
    return questions.select("question_id").join(first, "question_id", "left")


def met_patterns(questions: DataFrame, hits: DataFrame, shown: DataFrame) -> DataFrame:
    """(question_id, pattern, hit): whether each expected pattern is in a hit or a sibling of one.

    ``shown`` has question_id and section of the siblings; questions without patterns are left out.
    """
    patterns = questions.select("question_id", F.explode("expected_all").alias("pattern"))
    fields = hits.select("question_id", "path", "title", "section").unionByName(shown.select("question_id", F.lit("").alias("path"), F.lit("").alias("title"), "section"))
    met = patterns.join(fields, "question_id", "left").withColumn("hit", matches("pattern", "path", "title", "section"))
    return met.groupBy("question_id", "pattern").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))


def complete(questions: DataFrame, hits: DataFrame, shown: DataFrame) -> DataFrame:
    """(question_id, complete): whether all expected patterns of a question are met."""
    return met_patterns(questions, hits, shown).groupBy("question_id").agg(F.bool_and("hit").alias("complete"))


def details(questions: DataFrame, ranked: DataFrame, met: DataFrame) -> DataFrame:
    """(question_id, question, rank, asked, missing): each question with the patterns that nothing shows."""
    lists = met.groupBy("question_id").agg(F.count(F.lit(1)).alias("asked"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("pattern")))).alias("missing"))
    return questions.select("question_id", "question").join(ranked, "question_id").join(lists, "question_id", "left").select("question_id", "question", "rank", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def summary(ranked: DataFrame) -> DataFrame:
    """One row: questions, found, mrr (three places)."""
    return ranked.agg(F.count(F.lit(1)).alias("questions"), F.count("rank").alias("found"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"))


def report(rows: list, total, seconds: float) -> str:
    """Each question with its rank and what is missing, and the totals, as text for people."""
    lines = [f"{r.rank if r.rank else '-':>4}  {r.question}" + (f"  (missing: {', '.join(r.missing)})" if r.missing else "") for r in rows]
    whole = [not r.missing for r in rows if r.asked]
    lines.append(f"found {total.found} of {total.questions}, MRR {total.mrr:.3f}, {seconds:.1f} s")
    return "\n".join(lines + ([f"complete {sum(whole)} of {len(whole)}"] if whole else []))
