"""From sources to chunks: select, opt out, mask, cut, refer, de-duplicate, number.

Opted-out and excluded text is dropped before masking and before anything is written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfspoor.config import Settings, Source
from turfspoor.functions import arrow
from turfspoor.functions import text as T
from turfspoor.operators import dedup
from turfspoor.session import written
from turfspoor.sources import readers

CHUNK = ["chunk_id", "source", "path", "title", "section", "date", "status", "text", "refs", "ordinal", "file", "raw_fp"]


def masked(text: Column, settings: Settings) -> Column:
    """The masking passes in their order, or the text as it is where masking is off."""
    if not settings.mask:
        return text
    return arrow.mask_dashed_runs(T.mask_long_runs(T.mask_known_tokens(T.mask_named_values(T.mask_key_blocks(text)))))


def hidden_count(before: Column, after: Column) -> Column:
    """How many secrets a masking hid: the placeholders that were not there before."""
    mark = F.lit(r"\[verborgen\]")
    return F.regexp_count(after, mark) - F.regexp_count(before, mark)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def markdown_chunks(documents: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of documents (source, path, text, date, file, order): text that is masked already.

    Also for text that comes from no file. Front matter gives title, status, date and a description,
    which stands before each chunk, or is the only chunk of a document without text.
    """
    described = documents.select("*", T.front_body(F.col("text")).alias("body"))
    named = described.select("source", "path", "file", "order", "body", F.coalesce(T.first_field(F.col("text"), "titel", "title", "name", "naam"), stem_of(F.col("path"))).alias("title"), F.coalesce(T.first_field(F.col("text"), "status"), F.lit("")).alias("status"), F.coalesce(T.first_field(F.col("text"), "datum", "date"), T.blank(F.col("date"))).alias("date"), F.coalesce(T.first_field(F.col("text"), "description", "omschrijving", "beschrijving"), F.lit("")).alias("about"))
    cut = named.withColumn("parts", arrow.markdown_chunks(F.col("body"), F.col("title")))
    alone = F.array(F.struct(F.lit("").alias("section"), F.col("about").alias("text")))
    parts = F.when((F.size("parts") == 0) & (F.col("about") != ""), alone).otherwise(F.col("parts"))
    flat = cut.select("*", (F.size("parts") == 0).alias("bare"), F.posexplode(parts).alias("ordinal", "part"))
    prefixed = ~F.col("bare") & (F.col("about") != "") & (F.col("part.section") != F.col("title"))
    text = F.when(prefixed, F.concat("about", F.lit("\n\n"), F.col("part.text"))).otherwise(F.col("part.text"))
    rows = flat.select("source", "path", "title", F.col("part.section").alias("section"), "date", "status", text.alias("text"), "ordinal", "file", "order")
    return rows.select(T.short_id(F.col("source"), F.col("path"), F.col("section"), F.col("ordinal")).alias("chunk_id"), "*", F.array_join(T.references(F.col("text"), patterns=settings.reference_patterns), ",").alias("refs"), F.lit(None).cast("string").alias("raw_fp"))


class Earlier(NamedTuple):
    """What the last index has: its chunks, and its ledger of files (source, path, modified, size, intact)."""

    chunks: DataFrame
    ledger: DataFrame


def unchanged_files(spark: SparkSession, source: Source, earlier: Earlier) -> DataFrame:
    """(source, path) of the files that are as the ledger has them and lost no chunk to de-duplication."""
    now = readers.listing(spark, source).filter("not excluded").select("source", "path", "modified", "size")
    return now.join(earlier.ledger.filter("intact"), ["source", "path", "modified", "size"], "left_semi").select("source", "path")


def markdown_source(spark: SparkSession, source: Source, settings: Settings, earlier: Earlier | None = None) -> DataFrame:
    """The chunks of a folder; those of unchanged files come from the last index and are not made anew."""
    if earlier is not None:
        same = unchanged_files(spark, source, earlier)
        kept = earlier.chunks.join(same.withColumnRenamed("path", "file"), ["source", "file"], "left_semi")
        return _read_markdown(spark, source, settings, same).select(*CHUNK, "order").unionByName(kept.select(*CHUNK, readers.walk_key(F.col("file")).alias("order")))
    return _read_markdown(spark, source, settings, None)


def _read_markdown(spark: SparkSession, source: Source, settings: Settings, unchanged: DataFrame | None) -> DataFrame:
    files = readers.markdown_files(spark, source, unchanged).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    open_ = files.filter(~T.opted_out(F.col("text"), settings.opt_out_keys)).withColumn("text", masked(F.col("text"), settings))
    dated = open_.withColumn("date", T.derived_date(F.concat(F.lit(source.path.rstrip("/") + "/"), F.col("path")), F.col("text"), F.col("modified")))
    return markdown_chunks(dated.select("source", "path", "text", "date", F.col("path").alias("file"), F.col("walk").alias("order")), settings)


def json_chunks(items: DataFrame, source: Source, settings: Settings) -> DataFrame:
    """One chunk for each item and, for lists of two and more, one that names them all."""
    get = readers.item_field
    kept = items.filter(~readers.item_excluded(source))
    own, title = get(source.id_field), get(source.title_field)
    number = F.when(own != "", own).otherwise(F.col("ordinal").cast("string"))
    if source.all_fields:
        body = arrow.readable_json(F.expr("to_json(map_filter(from_json(item, 'map<string,variant>'), (k, v) -> not array_contains(array({}), k)))".format(", ".join("'" + x.replace("'", "\\'") + "'" for x in (source.id_field, source.title_field, source.exclude_field) if x))))
    else:
        body = get(source.text_field)
    text = masked(F.concat(title, F.lit("\n\n"), body), settings)
    shown = masked(title, settings) if settings.mask_titles else title
    named = kept.select("source", "file", "ordinal", own.alias("own"), number.alias("number"), title.alias("plain"), shown.alias("shown"), get(source.section_field).alias("section"), get(source.date_field).alias("date"), get(source.status_field).alias("status"), text.alias("text"))
    refs = F.array_join(T.references(F.col("text"), F.col("own"), settings.reference_patterns), ",")
    order = F.format_string("%018d", F.col("ordinal"))
    chunks = named.select(T.short_id(F.col("source"), F.col("number")).alias("chunk_id"), "source", F.concat("file", F.lit("#"), F.col("number")).alias("path"), F.when(F.col("own") != "", F.concat("own", F.lit(" - "), F.col("shown"))).otherwise(F.col("shown")).alias("title"), "section", "date", "status", "text", refs.alias("refs"), F.lit(0).alias("ordinal"), "file", F.lit(None).cast("string").alias("raw_fp"), order.alias("order"))
    return chunks.unionByName(overview(named, settings)) if source.overview else chunks


def overview(named: DataFrame, settings: Settings) -> DataFrame:
    """One chunk for each list (source, file) with a line for every item: id - title (section, status)."""
    join = lambda sep, *cs: F.array_join(F.filter(F.array(*cs), lambda x: x != ""), sep)
    extra = join(", ", F.col("section"), F.col("status"))
    line = F.concat(join(" - ", F.col("own"), F.col("plain")), F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))
    lines = named.select("source", "file", F.struct("ordinal", line.alias("line")).alias("x"))
    all_ = lines.groupBy("source", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.getField("line")), "\n").alias("text"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    none = F.lit("")
    return all_.select(T.short_id(F.col("source"), F.lit("overzicht"), F.lit(0)).alias("chunk_id"), "source", F.concat("file", F.lit("#overzicht")).alias("path"), F.concat("source", F.lit(" - overzicht ("), F.col("n").cast("string"), F.lit(" items)")).alias("title"), F.lit("overzicht").alias("section"), none.alias("date"), none.alias("status"), masked(F.col("text"), settings).alias("text"), none.alias("refs"), F.lit(0).alias("ordinal"), "file", F.lit(None).cast("string").alias("raw_fp"), F.lit("~").alias("order"))


def known_rows(rows: DataFrame) -> DataFrame:
    """Rows of the caller with their id, ordinal and raw fingerprint; the text is as it came.

    The default ordinal is the order of arrival in the document.
    """
    arrived = F.row_number().over(Window.partitionBy("source", "path").orderBy("arrival")) - 1
    raw = rows.withColumn("given", F.coalesce("ordinal", F.lit(0))).withColumn("ordinal", F.coalesce("ordinal", arrived))
    own = F.when(F.col("chunk_id") != "", F.col("chunk_id")).otherwise(T.short_id(F.col("source"), F.col("path"), F.col("section"), F.col("given")))
    print_ = T.fingerprint(own, *[F.col(c) for c in ("source", "path", "title", "section", "date", "status", "text", "refs")], F.col("ordinal"))
    order = F.format_string("%018d", F.col("arrival"))
    return raw.select(own.alias("chunk_id"), "source", "path", "title", "section", "date", "status", "text", "refs", "ordinal", F.lit("").alias("file"), print_.alias("raw_fp"), order.alias("order"))


def rows_print(rows: DataFrame) -> list:
    """What tells whether the caller's rows, their order included, are those of another time."""
    found = known_rows(readers.caller_rows(rows)).agg(F.count(F.lit(1)), F.sum(F.xxhash64("chunk_id", "raw_fp", "order").cast("decimal(38,0)"))).first()
    return [found[0], str(found[1])]


def row_chunks(rows: DataFrame, settings: Settings, earlier: Earlier | None = None) -> DataFrame:
    """Chunks of rows of the caller. A row whose id and raw fingerprint the last index has is not masked again."""
    known = known_rows(rows)
    if earlier is None:
        return _masked_rows(known, settings)
    before = earlier.chunks.filter("raw_fp is not null").select("chunk_id", "raw_fp", F.struct("title", "text", "refs").alias("was"))
    paired = known.join(before, ["chunk_id", "raw_fp"], "left")
    same = paired.filter("was is not null").select(*[F.col(f"was.{c}").alias(c) if c in ("title", "text", "refs") else F.col(c) for c in known.columns])
    return _masked_rows(paired.filter("was is null").select(*known.columns), settings).unionByName(same)


def _masked_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    hidden = rows.withColumn("text", masked(F.col("text"), settings))
    named = hidden.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(stem_of(F.col("path"))))
    return named.withColumn("refs", F.when(F.col("refs") != "", F.col("refs")).otherwise(F.array_join(T.references(F.col("text"), patterns=settings.reference_patterns), ",")))


def numbered(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``ord``, which grows with ``keys`` over the whole table. A range-partitioned sort numbers
    its partitions in their order; the numbers have gaps and are no counts."""
    return chunks.orderBy(*keys).withColumn("ord", F.monotonically_increasing_id())


def gather(spark: SparkSession, settings: Settings, rows: DataFrame | None = None, earlier: Earlier | None = None) -> DataFrame:
    """All chunks of all sources and of the caller's rows in their order, repeats included."""
    parts = []
    for n, source in enumerate(settings.sources):
        if source.kind == "markdown":
            part = markdown_source(spark, source, settings, earlier)
        else:
            part = json_chunks(readers.json_items(spark, source), source, settings)
        parts.append(part.select(*CHUNK, "order").withColumn("source_no", F.lit(n)))
    if rows is not None:
        parts.append(row_chunks(readers.caller_rows(rows), settings, earlier).select(*CHUNK, "order").withColumn("source_no", F.lit(len(settings.sources))))
    if not parts:
        raise ValueError("there is nothing to index: no source and no rows")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # the order is written before it is used twice, since a sort may be planned anew
    return written(numbered(union, ["source_no", "order", "ordinal"]).drop("order", "source_no"), "chunks")


def finish(gathered: DataFrame) -> DataFrame:
    """The chunks without repeats, with distinct ids and fingerprints."""
    unique = dedup.repair_ids(dedup.first_of_each_text(gathered))
    return unique.withColumn("content_fp", T.fingerprint(*[F.col(c) for c in ("chunk_id", "source", "path", "title", "section", "date", "status", "text", "refs", "ordinal")]))


def collect(spark: SparkSession, settings: Settings, rows: DataFrame | None = None) -> DataFrame:
    return finish(gather(spark, settings, rows))


def intact_files(gathered: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, path, intact): whether all chunks of a file are in the index under their own ids."""
    own = gathered.filter("file <> ''").select("source", "file", "ord", "chunk_id")
    kept = chunks.select("ord", "chunk_id", F.lit(1).alias("kept"))
    return own.join(kept, ["ord", "chunk_id"], "left").groupBy("source", F.col("file").alias("path")).agg((F.count("kept") == F.count(F.lit(1))).alias("intact"))
