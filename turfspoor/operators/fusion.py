"""Fusion of ranked lists, re-ranking, siblings and the merge of several indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.functions.text import ENDED, coarse_stems, content_words, recency, tokens
from turfspoor.operators.lexical import RRF_K, LexicalIndex


def rrf(lists: DataFrame, keys: list[str] = (), k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (keys, list_no, list_name, position, id, weight).

    An id that repeats in a list counts at its first place and takes up no place after it. The
    contributions are added in the order of the lists, so equal inputs give equal sums to the bit.
    """
    keys = list(keys)
    first = lists.groupBy(*keys, "list_no", "list_name", "id").agg(F.min("position").alias("position"), F.first("weight").alias("weight"))
    place = Window.partitionBy(*keys, "list_no").orderBy("position")
    ranked = first.withColumn("part", F.col("weight") / (F.lit(k) + F.row_number().over(place)))
    return fused(ranked, [*keys, "id"])


def fused(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, signals) from rows (keys, list_no, list_name, part)."""
    ordered = F.array_sort(F.collect_list(F.struct("list_no", "part", "list_name")))
    grouped = parts.groupBy(*keys).agg(ordered.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x.getField("part"))
    return grouped.select(*keys, score.alias("score"), F.transform("parts", lambda x: x.getField("list_name")).alias("signals"))


def halved(score: Column, status: Column) -> Column:
    """Half the score for an ended status, in any case."""
    return F.when(F.lower(F.coalesce(status, F.lit(""))).isin(*ENDED), score * 0.5).otherwise(score)


def with_recency(score: Column, date: Column, as_of: Column, bonus: float = 0.25, horizon: int = 730, k: int = RRF_K) -> Column:
    """A bonus, as a share of the best single-list score, that falls to zero at the horizon."""
    return score + F.lit(bonus) * (1.0 / (k + 1)) * recency(date, as_of, horizon)


def rerank(scored: DataFrame, k: Column, keys: list[str], bonus: float = 0.25, horizon: int = 730, as_of: Column | None = None) -> DataFrame:
    """Status, then recency, then the best ``k`` of each key by the rounded score.

    ``scored`` has score, status, date and, for ties, first_list and first_rank.
    """
    as_of = F.current_date() if as_of is None else as_of
    final = F.round(with_recency(halved(F.col("score"), F.col("status")), F.col("date"), as_of, bonus, horizon), 5)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "first_list", "first_rank")
    return scored.withColumn("score", final).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def siblings(index: LexicalIndex, hits: DataFrame, questions: DataFrame, names: Column, limit: int = 2) -> DataFrame:
    """(question_id, source, path, siblings): other chunks of the documents that were hit.

    They hold a name of the question or, without names, one of its words (coarse from seven letters
    on), in section or text; at most ``limit`` of a document, the best by score, in document order.
    ``hits`` has question_id, ord, source, path, and a chunk that is shown already is no sibling.
    """
    asked = questions.select("question_id", names.alias("names"), content_words(F.col("question")).alias("words"))
    by_name = asked.filter(F.size("names") > 0).select("question_id", F.posexplode(F.transform("names", lambda n: F.struct(F.array_join(n, " ").alias("token"), F.lit(False).alias("prefix")))).alias("phrase_no", "x"))
    by_word = asked.filter((F.size("names") == 0) & (F.size("words") > 0)).select("question_id", F.posexplode(coarse_stems(F.col("words"))).alias("phrase_no", "x"))
    cols = F.array(F.lit("section"), F.lit("text"))
    phrases = by_name.unionByName(by_word).select("question_id", F.lit(1).alias("attempt"), "phrase_no", tokens(F.col("x.token")).alias("tokens"), F.col("x.prefix").alias("prefix"), cols.alias("cols"))
    found = index.best_matches(phrases, F.lit(True), limit, documents=hits.select("question_id", "source", "path", "ord"))
    others = found.join(index.lengths.select("ord", "source", "path", "ordinal"), "ord")
    order = Window.partitionBy("question_id", "source", "path").orderBy(F.desc("score"), "ord")
    top = others.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= limit)
    sorted_ = F.array_sort(F.collect_list(F.struct("ordinal", "ord")))
    return top.groupBy("question_id", "source", "path").agg(F.transform(sorted_, lambda x: x.getField("ord")).alias("siblings"))


def merge_indexes(main: DataFrame, extra: DataFrame, most: int = 2, least_signals: int = 2) -> DataFrame:
    """One list from the hits of the own index and of others, without the others pushing it away.

    ``main`` and ``extra`` have question_id, index_no, id, score, signals and arrival. Of each other
    index at most ``most`` hits with ``least_signals`` signals or more compete by score; the rest
    comes behind, index by index, by score. Ties keep the order of arrival, the own index first.
    """
    score = F.coalesce("score", F.lit(0.0))
    ordered = Window.partitionBy("question_id", "index_no").orderBy(F.desc(score), "arrival")
    seen = extra.withColumn("by_score", F.row_number().over(ordered)).withColumn("strong", F.size(F.coalesce("signals", F.array().cast("array<string>"))) >= least_signals)
    nth = F.sum(F.col("strong").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    tiered = seen.withColumn("tier", F.when(F.col("strong") & (nth <= most), 0).otherwise(1))
    both = main.withColumn("tier", F.lit(0)).withColumn("by_score", F.col("arrival")).unionByName(tiered.drop("strong"), allowMissingColumns=True)
    place = Window.partitionBy("question_id").orderBy("tier", F.when(F.col("tier") == 1, F.col("index_no")), F.when(F.col("tier") == 0, score).desc(), F.when(F.col("tier") == 0, F.col("index_no")), "by_score")
    return both.withColumn("place", F.row_number().over(place)).drop("tier", "by_score")
