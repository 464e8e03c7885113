"""Readers: markdown trees, JSON lists and rows of the caller, all to raw tables.

Each reader keeps the order that decides which of two equal texts stays: a file tree is walked
folder by folder, the files of a folder in order before its sub-folders.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspoor.config import Source
from turfspoor.functions.text import blank, is_true, selected

LINE_ENDS = r"\r\n?"


def walk_key(path: Column) -> Column:
    """Sorts paths as a walk does: in each folder files come before folders.

    A folder part begins with U+0001, a file with U+0000, and each part ends with U+0000.
    """
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == last, F.lit("\u0001")).otherwise(F.lit("\u0002")), p)), "\u0001")


FILES = "source string, path string, modified timestamp, size long, walk string, excluded boolean, uri string"
#: So many changed files are read by name; beyond that their folder is read and joined.
BY_NAME = 20_000


def listing(spark: SparkSession, source: Source, uris: list[str] | None = None, content: bool = False) -> DataFrame:
    """The ``*.md`` files below a folder, without reading them unless ``content`` is asked for.

    Hidden files and folders are left out. ``excluded`` tells the files that the patterns of the
    source leave out. A folder that does not exist has no files.
    """
    root = source.path.rstrip("/")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) or uris == []:
        if uris is None:
            print(f"warning: source {source.name!r} has no folder {root}")
        return spark.createDataFrame([], FILES + (", content binary" if content else ""))
    base = fs.getFileStatus(place).getPath().toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(uris or root)
    # the path is percent-encoded in the file column
    relative = F.expr("url_decode(replace(path, '+', '%2B'))").substr(F.lit(len(base) + 2), F.lit(1_000_000))
    named = files.select(relative.alias("rel"), "modificationTime", "length", F.col("path").alias("uri"), *(["content"] if content else []))
    kept = named.filter(~F.concat(F.lit("/"), F.col("rel")).rlike(r"/\."))
    chosen = selected(F.col("rel"), list(source.only), list(source.without))
    return kept.select(F.lit(source.name).alias("source"), F.col("rel").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), walk_key(F.col("rel")).alias("walk"), (~chosen).alias("excluded"), "uri", *(["content"] if content else []))


def markdown_files(spark: SparkSession, source: Source, unchanged: DataFrame | None = None) -> DataFrame:
    """(source, path, modified, size, walk, text) of the readable files that the patterns let in.

    Files that are no UTF-8 are left out; BOMs go and line ends are unified. Files in ``unchanged``
    (source, path) are not read: a few changed ones are read by name, many by a join.
    """
    uris = None
    if unchanged is not None:
        changed = listing(spark, source).filter("not excluded").join(unchanged, ["source", "path"], "left_anti")
        some = [r.uri for r in changed.select("uri").limit(BY_NAME + 1).collect()]
        uris = some if len(some) <= BY_NAME else None
    files = listing(spark, source, uris, content=True).filter("not excluded")
    if unchanged is not None and uris is None:
        files = files.join(unchanged, ["source", "path"], "left_anti")
    text = F.regexp_replace(F.regexp_replace(F.expr("decode(content, 'UTF-8')"), "\ufeff", ""), LINE_ENDS, "\n")
    valid = F.expr("is_valid_utf8(cast(content as string))")
    return files.filter(valid).select("source", "path", "modified", "size", "walk", text.alias("text"))


def json_items(spark: SparkSession, source: Source) -> DataFrame:
    """(source, file, ordinal, item): the objects of a JSON list, as variants.

    The list is at ``list_field`` or the root; anything else is an error. Items that are no objects
    are left out but count in the ordinals. A file that does not exist has no items.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(source.path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "source string, file string, ordinal long, item string"
    if not fs.exists(place):
        print(f"warning: source {source.name!r} has no file {source.path}")
        return spark.createDataFrame([], schema)
    whole = spark.read.text(source.path, wholetext=True).select(F.regexp_replace("value", "﻿", "").alias("value"))
    at = f"$.{source.list_field}" if source.list_field else "$"
    listed = F.expr(f"variant_get(parse_json(value), '{at}', 'string')")
    items = whole.select(F.when(F.coalesce(F.substring(F.ltrim(listed), 1, 1), F.lit("")) == "[", F.from_json(listed, "array<variant>")).otherwise(F.raise_error(F.lit(f"source {source.name}: a list was expected at {at}"))).alias("items"))
    each = items.select(F.posexplode("items").alias("ordinal", "item")).select("ordinal", F.to_json("item").alias("item"))
    return each.filter(F.col("item").startswith("{")).select(F.lit(source.name).alias("source"), F.lit(source.path.rsplit("/", 1)[-1]).alias("file"), F.col("ordinal").cast("long"), "item")


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file from the driver; its folder is made."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def list_status(spark: SparkSession, source: Source) -> list[tuple[str, int, int]]:
    """(path, modified, size) of the file of a JSON list, or of each below a folder; none where it does not exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source.path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    try:
        files = fs.listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getName().endswith("FileNotFoundException"):
            raise
    return sorted(found)


def item_field(name: str) -> Column:
    """A field of an item as text. Missing, null, false, zero, empty lists and objects are empty."""
    value = F.get_json_object("item", f"$['{name}']") if name else F.lit(None).cast("string")
    return F.when(value.isNull() | value.isin("false", "0", "0.0", "[]", "{}"), "").otherwise(value)


def item_excluded(source: Source) -> Column:
    return is_true(F.get_json_object("item", f"$['{source.exclude_field}']")) if source.exclude_field else F.lit(False)


REQUIRED = ("source", "path", "text")
OPTIONAL = ("title", "section", "date", "status", "chunk_id", "refs")


def caller_rows(rows: DataFrame, arrival: str | None = None) -> DataFrame:
    """Rows of the caller with all columns of a chunk; missing ones are empty.

    source, path and text are required: a row without one fails when it is read. ``arrival`` names a
    column that gives the order of arrival; without it the order of the table is taken as it comes.
    """
    if lacking := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"rows lack {', '.join(lacking)}")
    must = lambda c: F.when(blank(F.col(c).cast("string")) == "", F.raise_error(F.lit(f"a row lacks {c}")).cast("string")).otherwise(F.col(c).cast("string"))
    given = [must(c).alias(c) for c in REQUIRED] + [(blank(F.col(c).cast("string")) if c in rows.columns else F.lit("")).alias(c) for c in OPTIONAL]
    number = F.expr("try_cast(ordinal as int)") if "ordinal" in rows.columns else F.lit(None).cast("int")
    order = F.col(arrival).cast("long") if arrival else F.monotonically_increasing_id()
    return rows.select(*given, number.alias("ordinal"), order.alias("arrival"))
