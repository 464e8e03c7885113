"""Lexical search: postings, BM25 with column weights, phrases, prefixes, attempts.

An index is four tables: ``postings`` (term, ord, col, pos), ``lengths`` (ord, chunk_id, source,
path, ordinal, len), the distinct terms and a row of statistics. ``ord`` is the order of the chunks
and breaks ties. Postings may hold chunks that are no longer in the index: what is in ``lengths``, is.

Phrases to look up are rows (question_id, attempt, phrase_no, tokens, prefix, cols): all questions
are searched by one plan. Tokens join postings on the term, so only the postings of words that
were asked for are shuffled; an occurrence of a phrase is a start position at which all its tokens
stand, which serves single words, phrases and prefixes alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.functions.text import coarse_stems, content_words, tokens
from turfspoor.operators import shards
from turfspoor.session import written

# --- fixed values: weights of the columns and parameters of the score ------------------------------
WEIGHTS = {"title": 6.0, "section": 3.0, "text": 1.0, "stems": 1.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
LIST_SIZE, RRF_K = 40, 60
ATTEMPT_WEIGHTS = {1: 1.0, 2: 0.7, 3: 0.5}
#: Asked words up to which they are broadcast to the postings instead of shuffling these.
WORDS_SENT = 400_000
# ---------------------------------------------------------------------------------------------------

PHRASES = "question_id long, attempt int, phrase_no int, tokens array<string>, prefix boolean, cols array<string>"


class LexicalIndex:
    """The tables of a lexical index over chunks (ord, chunk_id, source, path, title, section, text)."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, terms: DataFrame | None = None, stats: tuple[int, float] | None = None, dead: bool = False):
        self.postings, self.lengths, self.dead = postings, lengths, dead
        self.terms = postings.select("term").distinct() if terms is None else terms
        self.stats = stats

    @classmethod
    def of(cls, chunks: DataFrame, stems: Column | None = None, keep: bool = False) -> LexicalIndex:
        """The index of chunks, worked out by each search or, with ``keep``, from the lists of their tokens, which are written once.

        The lists cost no shuffle and no sort, so they suit a table of questions, which reads most postings.
        """
        cols = [c for c in ("title", "section", "text") if c in chunks.columns]
        ordinal = F.col("ordinal") if "ordinal" in chunks.columns else F.lit(0)
        parts = {c: tokens(F.col(c)) for c in cols}
        if stems is not None:
            parts["stems"] = stems
        split = chunks.select("ord", "chunk_id", "source", "path", ordinal.cast("int").alias("ordinal"), *[e.alias(f"t_{c}") for c, e in parts.items()])
        split = split.withColumn("len", sum((F.size(f"t_{c}") for c in parts), F.lit(0)))
        if keep:
            split = written(split, "tokens")
        lists = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"t_{c}").alias("t")) for c in parts])
        postings = split.select("ord", F.explode_outer(lists).alias("x")).select("ord", "x.col", F.posexplode_outer("x.t").alias("pos", "term")).filter("term is not null")
        found = cls(postings.select("term", "ord", "col", "pos"), split.select("ord", "chunk_id", "source", "path", "ordinal", "len"))
        return cls(found.postings, found.lengths, written(found.terms, "terms"), tuple(found.statistics().first())) if keep else found

    def stored(self) -> LexicalIndex:
        """The same index with its tables written to the shared folder, for searches that use them often.

        Postings are sorted by term, so that reading the postings of a few words skips most row groups.
        """
        postings = written(self.postings.repartitionByRange("term").sortWithinPartitions("term", "ord"), "postings")
        lengths = written(self.lengths, "lengths")
        found = LexicalIndex(postings, lengths, written(sorted_terms(postings), "terms"))
        return LexicalIndex(postings, lengths, found.terms, tuple(found.statistics().first()))

    def statistics(self) -> DataFrame:
        """One row: number of chunks and mean length."""
        if self.stats is not None:
            return self.lengths.sparkSession.createDataFrame([self.stats], "n_chunks long, mean_len double")
        return self.lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("len").alias("mean_len"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (ord, ...) of chunks that are in the index."""
        return rows.join(self.lengths.select("ord"), "ord", "left_semi") if self.dead else rows

    def document_frequency(self) -> DataFrame:
        return self.live(self.postings).groupBy("term").agg(F.count_distinct("ord").alias("df"))

    def occurrences(self, phrases: DataFrame, many: bool = False) -> DataFrame:
        """(question_id, attempt, phrase_no, ord, col, start, size) of every occurrence of a phrase.

        With ``many`` the asked words are counted and, if they are few enough, sent to the postings.
        """
        keys = ["question_id", "attempt", "phrase_no"]
        words = phrases.filter(F.size("tokens") > 0).select(*keys, "cols", F.size("tokens").alias("size"), F.posexplode("tokens").alias("k", "token"), "prefix")
        words = words.withColumn("starts_with", F.col("prefix") & (F.col("k") == F.col("size") - 1)).drop("prefix")
        exact = words.filter("not starts_with").withColumnRenamed("token", "term")
        prefixed = words.filter("starts_with")
        asked = exact.unionByName(self._widened(prefixed, exact.columns)) if prefixed.take(1) else exact
        if many:
            asked = written(asked, "asked")
            asked = F.broadcast(asked) if asked.count() <= WORDS_SENT else asked
        found = self.live(self.postings.join(asked, "term").filter(F.col("cols").isNull() | F.array_contains("cols", F.col("col"))))
        starts = found.withColumn("start", F.col("pos") - F.col("k"))
        one = starts.filter("size = 1").select(*keys, "ord", "col", "start", "size")
        if not phrases.filter(F.size("tokens") > 1).take(1):
            return one
        many = starts.filter("size > 1").groupBy(*keys, "ord", "col", "start", "size").agg(F.count_distinct("k").alias("met")).filter("met = size").drop("met")
        return one.unionByName(many)

    def _widened(self, prefixed: DataFrame, columns: list[str]) -> DataFrame:
        """The prefixes with each term of the vocabulary that begins with them."""
        # a prefix meets the vocabulary on its first characters, not each term with each prefix
        heads = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("term", 1, n).alias("head")) for n in (1, 2, 3)])).alias("h")
        vocabulary = self.terms.filter("term <> ''").select("term", heads).select("term", "h.n", "h.head")
        wide = prefixed.withColumn("n", F.least(F.length("token"), F.lit(3))).withColumn("head", F.expr("substring(token, 1, n)"))
        return wide.join(vocabulary, ["n", "head"]).filter(F.col("term").startswith(F.col("token"))).select(*columns)

    def score(self, occurrences: DataFrame, counted: DataFrame | None = None) -> DataFrame:
        """(question_id, attempt, phrase_no, ord, part): the share of each phrase in the score.

        ``counted`` has the occurrences that say how common a phrase is, if these are others.
        """
        keys = ["question_id", "attempt", "phrase_no"]
        f = occurrences.groupBy(*keys, "ord").agg(F.sum(column_weight()).alias("f"))
        if counted is None:
            n = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        else:
            n = counted.groupBy(*keys).agg(F.count_distinct("ord").alias("n"))
        facts = f.join(n, keys).join(self.lengths.select("ord", "len"), "ord").crossJoin(F.broadcast(self.statistics()))  # one row
        return facts.select(*keys, "ord", bm25_part().alias("part"))

    def best_matches(self, phrases: DataFrame, any_of: Column, limit: int, only: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
        """(question_id, attempt, ord, score): of a table of questions the best ``limit`` chunks of each attempt, and some more.

        Each phrase is looked up once, and shards of chunks answer with their own best (``shards.py``), so
        the true best are still to be taken. ``any_of`` says over the attempts whether any phrase will do.
        ``only`` (question_id, only) restricts questions to a source. With ``documents`` (question_id, source,
        path, ord), chunks that are shown, the limit is for each of their documents and they don't count.
        """
        form = F.to_json(F.struct("tokens", "prefix", "cols"))
        phrases = written(phrases.withColumn("form", form), "phrases")
        forms = written(phrases.groupBy("form").agg(*[F.first(c).alias(c) for c in ("tokens", "prefix", "cols")]).withColumn("phrase", F.monotonically_increasing_id()), "forms")
        each = forms.select(F.col("phrase").alias("question_id"), F.lit(1).alias("attempt"), F.lit(0).alias("phrase_no"), "tokens", "prefix", "cols")
        weighed = self.occurrences(each, many=True).groupBy("question_id", "ord").agg(F.sum(column_weight()).alias("f"))
        found = written(weighed.withColumnRenamed("question_id", "phrase"), "found")
        asked = phrases.join(forms.select("form", "phrase"), "form").select("question_id", F.col("attempt").cast("int").alias("attempt"), "phrase_no", "phrase", any_of.alias("any"))
        lengths = self.lengths.select("ord", "source", "path", "len")
        group, asked = F.lit(-1).cast("long"), asked.withColumn("only", F.lit(None).cast("long"))
        if documents is not None:
            keys = ["source", "path"]
            codes = written(documents.filter("source is not null and path is not null").select(*keys).distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
            hit = documents.join(codes, keys, "left").groupBy("question_id").agg(F.collect_set("group").alias("groups"), F.collect_set("ord").alias("shown"))
            asked = asked.join(hit, "question_id")
        elif only is not None:
            keys = ["source"]
            codes = written(only.filter("only is not null").select(F.col("only").alias("source")).distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
            asked = asked.drop("only").join(only.join(codes.select(F.col("source").alias("only"), F.col("group").alias("code")), "only", "left"), "question_id").select(*asked.drop("only").columns, F.col("code").alias("only"))
        if documents is not None or only is not None:
            lengths, group = lengths.join(codes, keys, "left"), F.coalesce("group", F.lit(-1).cast("long"))
        count = max(self.lengths.sparkSession.sparkContext.defaultParallelism, -(-found.count() // shards.SHARD))
        n = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
        known = found.join(F.broadcast(n) if forms.count() <= WORDS_SENT else n, "phrase")
        dealt = known.join(lengths.select("ord", "len", group.alias("group")), "ord").crossJoin(F.broadcast(self.statistics()))
        # behind the join, which may split and merge its partitions: all parts of a chunk must be in one shard
        parts = dealt.select("phrase", "ord", "group", bm25_part().alias("part")).repartition(count, "ord")
        return shards.matches(written(asked, "asked"), parts, limit)

    def match(self, phrases: DataFrame, mode: Column) -> DataFrame:
        """(question_id, attempt, ord, chunk_id, source, path, score) of the chunks that match.

        ``mode`` is ``and`` (all phrases of the attempt) or ``or`` (any), a column over the attempts.
        Phrases without a token can match nothing: an ``and`` with one is empty.
        """
        wanted = phrases.groupBy("question_id", "attempt").agg(F.count_distinct("phrase_no").alias("wanted"))
        # the order of the sum is that of the phrases, so equal chunks have equal scores
        ordered = F.aggregate(F.array_sort(F.collect_list(F.struct("phrase_no", "part"))), F.lit(0.0), lambda a, x: a + x.getField("part"))
        parts = self.score(self.occurrences(phrases))
        summed = parts.groupBy("question_id", "attempt", "ord").agg(ordered.alias("score"), F.count_distinct("phrase_no").alias("met"))
        hit = summed.join(wanted, ["question_id", "attempt"]).filter((mode == "or") | (F.col("met") == F.col("wanted")))
        return hit.join(self.lengths, "ord").select("question_id", "attempt", "ord", "chunk_id", "source", "path", "score")


def column_weight() -> Column:
    """The weight of the column that an occurrence is in."""
    return F.coalesce(*[F.when(F.col("col") == c, F.lit(w)) for c, w in WEIGHTS.items()], F.lit(1.0))


def bm25_part() -> Column:
    """The share of a phrase in the score of a chunk, of n, f, len, n_chunks and mean_len."""
    ratio = (F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5)
    idf = F.greatest(F.log(ratio), F.lit(IDF_FLOOR))
    return idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))


def sorted_terms(postings: DataFrame) -> DataFrame:
    """The distinct terms in their order, so that the terms of a prefix stand together."""
    return postings.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")


def best(hits: DataFrame, keys: list[str], limit: int = LIST_SIZE) -> DataFrame:
    """The best ``limit`` rows of each key by score, ties by global order, with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def attempts(questions: DataFrame, stemmer: str = "grof") -> DataFrame:
    """The phrases of the attempts of each question (question_id, question).

    1: all content words; 2: all coarse stems; 3: any coarse stem, if there is more than one. A word
    of the question may hold an underscore, which the index splits at, so it becomes a phrase.
    """
    words = questions.select("question_id", content_words(F.col("question")).alias("w")).filter(F.size("w") > 0)
    flat = words.select("question_id", F.size("w").alias("count"), F.posexplode(F.transform("w", lambda x: F.struct(x.alias("token"), F.lit(False).alias("prefix")))).alias("phrase_no", "x"))
    stems = words.select("question_id", F.size("w").alias("count"), F.posexplode(coarse_stems(F.col("w"))).alias("phrase_no", "x"))
    if stemmer == "nl":
        from turfspoor.functions.arrow import dutch_stems

        stems = words.select("question_id", F.size("w").alias("count"), F.posexplode(F.transform(dutch_stems(F.col("w")), lambda x: F.struct(x.alias("token"), F.lit(False).alias("prefix")))).alias("phrase_no", "x"))
    cols = F.array(F.lit("stems")) if stemmer == "nl" else F.lit(None).cast("array<string>")
    shape = lambda df, n, c: df.select("question_id", F.lit(n).alias("attempt"), "phrase_no", tokens(F.col("x.token")).alias("tokens"), F.col("x.prefix").alias("prefix"), c.alias("cols"))
    out = shape(flat, 1, F.lit(None).cast("array<string>"))
    if stemmer != "uit":
        out = out.unionByName(shape(stems, 2, cols)).unionByName(shape(stems.filter("count > 1"), 3, cols))
    return out


def only_of(questions: DataFrame) -> DataFrame | None:
    """(question_id, only): the source to which each question is restricted, if questions can be."""
    return questions.select("question_id", F.nullif(F.col("source"), F.lit("")).alias("only")) if "source" in questions.columns else None


def word_list(index: LexicalIndex, questions: DataFrame, stemmer: str = "grof", limit: int = LIST_SIZE) -> DataFrame:
    """(question_id, ord, chunk_id, rank, weight): the word list of each question.

    The attempts fill the list one after the other while it has fewer than ``limit`` chunks; each
    brings its best ``limit`` and only chunks that are not yet in, so a list may end above the limit.
    ``questions`` may have a column ``source`` that restricts a question to one source.
    """
    hits = index.best_matches(attempts(questions, stemmer), F.col("attempt") == 3, limit, only_of(questions))
    # written: the list is put together out of several looks at its hits
    top = written(best(hits, ["question_id", "attempt"], limit), "top")
    first = Window.partitionBy("question_id", "ord").orderBy("attempt")
    once = top.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    by_attempt = Window.partitionBy("question_id").orderBy("attempt").rangeBetween(Window.unboundedPreceding, -1)
    # how many chunks the attempts before this one have put in
    filled = once.groupBy("question_id", "attempt").agg(F.count(F.lit(1)).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(by_attempt), F.lit(0)))
    kept = once.join(filled.filter(F.col("before") < limit).select("question_id", "attempt"), ["question_id", "attempt"])
    place = Window.partitionBy("question_id").orderBy("attempt", "rank")
    weight = F.coalesce(*[F.when(F.col("attempt") == n, F.lit(w)) for n, w in ATTEMPT_WEIGHTS.items()])
    ranked = kept.select("question_id", "ord", F.row_number().over(place).alias("rank"), weight.alias("weight"))
    return ranked.join(index.lengths.select("ord", "chunk_id"), "ord").select("question_id", "ord", "chunk_id", "rank", "weight")


def name_lists(index: LexicalIndex, questions: DataFrame, names: Column, weight: float = 0.7, limit: int = LIST_SIZE) -> DataFrame:
    """(question_id, list_no, ord, chunk_id, rank, weight): a list for each name of a question.

    From two names on there is one more list, of the chunks that hold all of them. Names are looked
    up as phrases in title, section and text, not in the stems.
    """
    found = questions.select("question_id", names.alias("names"))
    each = found.select("question_id", F.posexplode("names").alias("list_no", "words"), F.size("names").alias("count"))
    cols = F.array(F.lit("title"), F.lit("section"), F.lit("text"))
    shape = lambda df, attempt, phrase: df.select("question_id", attempt.cast("int").alias("attempt"), phrase.cast("int").alias("phrase_no"), tokens(F.array_join("words", " ")).alias("tokens"), F.lit(False).alias("prefix"), cols.alias("cols"))
    phrases = shape(each, F.col("list_no"), F.lit(0)).unionByName(shape(each.filter("count > 1"), F.col("count"), F.col("list_no")))
    hits = index.best_matches(phrases, F.lit(False), limit, only_of(questions))
    top = best(hits, ["question_id", "attempt"], limit).join(index.lengths.select("ord", "chunk_id"), "ord")
    return top.select("question_id", F.col("attempt").alias("list_no"), "ord", "chunk_id", "rank", F.lit(weight).alias("weight"))
