"""How distinctive a term is per record: probabilistic relevance weighting (BM25).

weight(t, d) = idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean_len))
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5))

Terms are letter words: longest runs of Unicode letters, lower-cased. N, df and the mean length
cover every row of the table, also those that a selection later leaves out.

Cost: one scan makes the document frequencies. Each text is tokenised into its distinct terms
inside the scan and pre-aggregated per task, so the shuffle carries (term, partial count) only and a
term that is in every record is one row per task. A second scan makes the terms of each record.
A floor on the term frequency is applied inside that scan, before any row leaves it. Terms of very
many records meet their frequency without a shuffle (``join_hot``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspoor.session import join_hot, written


def joined_text(fields: list[str]) -> Column:
    """The fields joined by blanks, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def letter_words(text: Column) -> Column:
    """Lower-cased longest runs of letters. Runs are cut out before lower-casing, since a lower-cased
    letter may come with a combining mark, which would end the run."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.lower(w))


def document_frequencies(df: DataFrame, fields: list[str]) -> DataFrame:
    """(term, df) for each term, and one row with a null term: df = N and total = sum of lengths."""
    tokens = df.select(letter_words(joined_text(fields)).alias("tokens"))
    marked = tokens.select(F.size("tokens").cast("long").alias("len"), F.explode_outer(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    length = F.when(F.col("term").isNull(), F.col("len"))
    return marked.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(length).alias("total"))


def record_terms(df: DataFrame, key: str, fields: list[str], min_tf: int) -> DataFrame:
    """(key, term, tf, len) of each distinct term that occurs at least ``min_tf`` times in its record.

    In the sorted tokens a term is put out at each place that has the same term ``min_tf`` - 1 places
    before, so rarer terms are gone before a row is made of them. The tokens are named once, as the
    variable of an outer ``transform``: an expression that is named again is evaluated again.
    """
    tokens = F.array_sort(letter_words(joined_text(fields)))
    often = f"filter(zip_with(slice(t, {min_tf}, greatest(size(t), 1)), slice(t, 1, greatest(size(t) - {min_tf - 1}, 0)), (x, y) -> if(x = y, x, null)), x -> x is not null)" if min_tf > 1 else "t"
    found = df.select(F.col(key).alias("_key"), F.array(tokens).alias("tokens"))
    found = found.select("_key", F.expr(f"transform(tokens, t -> named_struct('len', size(t), 'often', {often}))").alias("found"))
    # outer: a plain explode would test the size of its array first and evaluate it twice for that
    rows = found.select("_key", F.explode_outer("found").alias("x")).select("_key", F.col("x.len").alias("len"), F.explode_outer("x.often").alias("term")).filter(F.col("term").isNotNull())
    counted = rows.groupBy("_key", "len", "term").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_key").alias(key), "term", (F.col("n") + (min_tf - 1)).cast("int").alias("tf"), "len")


def weight_of(tf: Column, df: Column, length: Column, n: Column, total: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """The relevance weight; it grows with ``tf`` and falls with ``df``."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(total / n, F.lit(1e-9))))


def distinctive_terms(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("titel", "sectie", "tekst"), k1: float = 1.2, b: float = 0.75, min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """(key, term, tf, df, weight) for the terms of every record.

    Null fields count as empty; a record without letter words has no rows but counts in N and in the
    mean length. Terms equal in weight are all kept. Rows that repeat a key are one record for tf
    (their occurrences add up only if their length is equal too) but each counts in N and df: make
    keys unique before. Only ``key`` and ``fields`` are read, so extra columns cannot clash. An empty
    table gives an empty result. ``min_tf``, ``min_df`` and ``max_df`` select rows and leave the
    weights of the others as they are.
    """
    fields = list(fields)
    freq = written(document_frequencies(df, fields), "df")
    totals = freq.filter(F.col("term").isNull()).agg(F.max("df").alias("_n"), F.max("total").alias("_total"))
    kept = freq.filter(F.col("term").isNotNull() & (F.col("df") >= min_df))
    if max_df is not None:  # a frequent term need not go through the join
        kept = kept.filter(F.col("df") <= max_df)
    terms = record_terms(df, key, fields, min_tf)
    scored = join_hot(terms, kept.select("term", "df"), ["term"], F.col("df")).crossJoin(F.broadcast(totals))  # one row
    weight = lambda tf, n: weight_of(tf, n, F.col("len"), F.col("_n"), F.col("_total"), k1, b)
    scored = scored.withColumn("weight", weight(F.col("tf").cast("double"), F.col("df").cast("double")))
    if max_df is not None:
        # what the weight must be at least in a record of this length; the counts decide what is left
        scored = scored.filter((F.col("weight") >= weight(F.lit(float(min_tf)), F.lit(float(max_df))) * (1 - 1e-9)) & (F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df))
    return scored.select(key, "term", "tf", "df", "weight")
