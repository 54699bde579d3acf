"""Readers and writers: review CSV files, landed API pages, the partitioned review
table, CSV / JSON exports, stop-word files and changed-file detection (2-A)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.functions import coerce_epoch, normalize_flag
from plaudit.session import path_exists
from plaudit.sources.schema import FLAG_COLUMNS, REVIEW_FIELDS, REVIEW_SCHEMA

# ------------------------------------------------------------------ CSV


def read_review_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None,
                    corrupt: str | None = None) -> DataFrame:
    """Header CSV with quoted multi-line text, all columns read as strings (typed
    later with ``try_cast``), plus the source ``file_name``. ``path`` may be a glob or
    a list; all files must have one header (``read_review_glob`` takes any). A file
    whose header differs from ``columns`` raises. With ``corrupt`` (and ``columns``) a
    column of that name holds the whole record where it has too few or too many fields,
    and is null elsewhere; ``file_path`` tells files of one name apart."""
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
         .option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("enforceSchema", False))
    if columns is not None:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *([corrupt] if corrupt else [])]]))
    if corrupt:  # fields are counted only where all are parsed
        r = r.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
    df = r.csv(path)
    if corrupt:
        df = df.withColumn("file_path", plain_path(F.col("_metadata.file_path")))
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def plain_path(c: Column) -> Column:
    """A file's path without the percent signs of its URI, and with three slashes where
    it names no host (Spark writes both forms)."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9+.-]+):/(?!/)", "$1:///")


def files_of(spark: SparkSession, path_glob: str) -> list[str]:
    """Plain paths of all files, empty ones (which no scan shows) included."""
    return sorted(re.sub("^([A-Za-z0-9+.-]+):/(?!/)", r"\1:///", unquote(p)) for p in spark.read.format("binaryFile").load(path_glob).inputFiles())


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, header): the first line of every file, found by a distributed scan of
    the files' first blocks."""
    lines = (spark.read.text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                     "value").where("at = 0").withColumn("n", F.monotonically_increasing_id()))
    return lines.groupBy("path").agg(F.min_by("value", "n").alias("header"))


def read_review_glob(spark: SparkSession, directory: str, pattern: str = "*_reviews.csv",
                     corrupt: str | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """All review files of a folder, each by its own header: one scan per distinct
    header, columns matched by (canonical) name, missing ones null. ``corrupt`` names
    the column of broken records (``read_review_csv``); files in ``skip`` are left out."""
    import csv
    by_header: dict[tuple, list[str]] = {}
    files: str | list[str] = f"{directory.rstrip('/')}/{pattern}"
    if skip:
        files = sorted(set(files_of(spark, files)) - set(skip))
    for r in file_headers(spark, files).collect() if files else []:  # one row per file
        names = tuple(next(csv.reader([r["header"].lstrip("\ufeff")])))
        by_header.setdefault(names, []).append(unquote(r["path"]))
    parts = [canonicalize_columns(read_review_csv(spark, sorted(paths), list(names), corrupt))
             for names, paths in sorted(by_header.items())]
    if not parts:
        return spark.createDataFrame([], "recommendation_id string, review string, file_name string"
                                     + (f", file_path string, `{corrupt}` string" if corrupt else ""))
    return merge_page_schemas(*parts)


def _broken_gzip(batches):
    """Paths of the files whose compressed stream is damaged or cut short."""
    import zlib

    import pyarrow as pa
    for batch in batches:
        bad = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data, ok = memoryview(content.as_buffer()), len(content.as_buffer()) > 0
            try:
                while ok and len(data):  # a file may hold several streams
                    z = zlib.decompressobj(31)
                    while data and not z.eof:
                        z.decompress(data[:1 << 20])
                        used = min(1 << 20, len(data)) - len(z.unused_data)
                        data = data[used:]
                    ok = z.eof
            except zlib.error:
                ok = False
            if not ok:
                bad.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["path"])


def broken_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path) of the ``.gz`` files that can't be read to their end. Text files without
    compression can always be read; a damaged record of theirs is a corrupt record."""
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path_glob)
    return packed.select(plain_path(F.col("_metadata.file_path")).alias("path"), "content").mapInArrow(_broken_gzip, "path string")


def source_from_filename(c) -> Column:
    """'Game Name_appid_reviews.csv' -> struct(game_name, app_id); without an
    underscore the whole stem is the name and the id is null."""
    base = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/\\]*)$", 1)
    stem = F.replace(base, F.lit("_reviews.csv"), F.lit(""))
    has = stem.contains("_")
    name = F.when(has, F.translate(F.regexp_extract(stem, r"^(.*)_[^_]*$", 1), "_", " ")).otherwise(stem)
    app = F.when(has, F.regexp_extract(stem, r"_([^_]*)$", 1))
    return F.struct(name.alias("game_name"), app.alias("app_id"))


def app_id_from_filename(c) -> Column:
    """First all-digit '_' part of the file stem, else 'unknown'."""
    base = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    digits = F.filter(F.split(stem, "_"), lambda x: x.rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(digits, F.lit(1)), F.lit("unknown"))


# ------------------------------------------------------------------ API pages

AUTHOR = T.StructType([T.StructField("steamid", T.StringType()),
                       T.StructField("num_games_owned", T.LongType()),
                       T.StructField("num_reviews", T.LongType()),
                       T.StructField("playtime_forever", T.DoubleType()),
                       T.StructField("playtime_last_two_weeks", T.DoubleType())])
PAGE_REVIEW = T.StructType([
    T.StructField("recommendationid", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("review", T.StringType()), T.StructField("timestamp_created", T.LongType()),
    T.StructField("timestamp_updated", T.LongType()), T.StructField("voted_up", T.BooleanType()),
    T.StructField("votes_up", T.LongType()), T.StructField("votes_funny", T.LongType()),
    T.StructField("weighted_vote_score", T.StringType()),
    T.StructField("written_during_early_access", T.BooleanType()),
    T.StructField("received_for_free", T.BooleanType()),
    T.StructField("primarily_steam_deck", T.BooleanType()), T.StructField("author", AUTHOR)])
PAGE_SCHEMA = T.StructType([T.StructField("success", T.IntegerType()),
                            T.StructField("cursor", T.StringType()),
                            T.StructField("app_id", T.StringType()),
                            T.StructField("reviews", T.ArrayType(PAGE_REVIEW))])


def read_api_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """Landed JSON pages (one page object per line): keep ``success == 1`` pages and
    emit one row per review (page-level columns kept)."""
    pages = spark.read.schema(schema).json(path).where(F.col("success") == 1)
    keep = [c for c in pages.columns if c not in ("reviews", "success")]
    return pages.select(*keep, F.explode("reviews").alias("r")).select(*keep, "r.*")


def read_variant_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages (one page object a line) of any shape: (app_id, cursor, review)
    with a review as a VARIANT, for ``success == 1`` pages. A page without a list of
    reviews has none; fields that drift between pages are found later (``lift_fields``)."""
    pages = spark.read.option("singleVariantColumn", "page").json(path)
    get = lambda f, t: F.try_variant_get("page", f"$.{f}", t).alias(f)
    return (pages.where(F.try_variant_get("page", "$.success", "int") == 1)
            .select(get("app_id", "string"), get("cursor", "string"),
                    F.explode(F.try_variant_get("page", "$.reviews", "array<variant>")).alias("review")))


def variant_fields(df: DataFrame, col: str) -> dict[str, str]:
    """Fields of the objects in a VARIANT column and a type that holds all their values:
    bigint, double, boolean, string, ``json`` (objects and arrays) or ``mixed``. One
    aggregate over the column; the driver gets one schema."""
    ddl = df.agg(F.schema_of_variant_agg(col)).first()[0]
    if not (ddl or "").startswith("OBJECT<"):
        return {}
    found = T.DataType.fromDDL(ddl.replace("OBJECT<", "STRUCT<"))
    kinds = {T.LongType: "bigint", T.DoubleType: "double", T.FloatType: "double", T.DecimalType: "double",
             T.BooleanType: "boolean", T.StringType: "string", T.NullType: "string", T.StructType: "json",
             T.ArrayType: "json"}
    return {f.name: kinds.get(type(f.dataType), "mixed") for f in found.fields}


def lift_fields(df: DataFrame, col: str, prefix: str, fields: dict[str, str] | None = None) -> DataFrame:
    """The fields of a VARIANT column as typed columns ``prefix`` + name in the order of
    their names; the column goes. Objects and arrays are JSON text, fields whose type
    differs between rows are text. Rows without the field, or without an object, are null.
    ``fields``: those of ``variant_fields``, found here if not given."""
    fields = variant_fields(df, col) if fields is None else fields

    def value(name, kind):
        if "'" in name and '"' in name:
            raise ValueError(f"no path can name the field {name}")
        path = f'$["{name}"]' if "'" in name else f"$['{name}']"
        if kind in ("json", "mixed"):
            whole = F.to_json(F.try_variant_get(col, path, "variant"))
            whole = F.when(whole != "null", whole)
            return whole if kind == "json" else F.coalesce(F.try_variant_get(col, path, "string"), whole)
        return F.try_variant_get(col, path, kind)

    return df.select(*[c for c in df.columns if c != col],
                     *[value(n, fields[n]).alias(prefix + n) for n in sorted(fields)])


def flatten_review(df: DataFrame, struct_col: str = "author", prefix: str = "author_") -> DataFrame:
    """Lift the nested author struct into top-level ``author_<field>`` columns;
    a missing struct gives nulls; the struct column is dropped."""
    if struct_col not in df.columns:
        return df
    fields = df.schema[struct_col].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != struct_col],
                     *[F.col(f"{struct_col}.{f}").alias(f"{prefix}{f}") for f in fields])


def merge_page_schemas(*dfs: DataFrame) -> DataFrame:
    """Union of differently-shaped page frames: columns are the sorted union of
    keys, missing ones null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


# ------------------------------------------------------------------ canonical table

RENAMES = {"recommendationid": "recommendation_id", "appid": "app_id",
           "author_steamid": "author_steam_id", "author.steamid": "author_steam_id",
           "author.playtime_forever": "author_playtime_forever",
           "author.num_games_owned": "author_num_games_owned",
           "author.num_reviews": "author_num_reviews"}


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Map alternate names onto the canonical ones (coalescing when both exist)."""
    cols = set(df.columns)
    out = df
    for src, dst in RENAMES.items():
        if src in cols:
            s = F.col(f"`{src}`")
            if dst in out.columns:
                out = out.withColumn(dst, F.coalesce(F.col(dst), s)).drop(src)
            else:
                out = out.withColumnRenamed(src, dst)
    if "author_playtime_forever" in out.columns and "playtime_forever" not in out.columns:
        out = out.withColumn("playtime_forever", F.col("author_playtime_forever"))
    return out


def project_to_schema(df: DataFrame, schema: T.StructType = REVIEW_SCHEMA,
                      keep_extra: bool = False) -> DataFrame:
    """Keep the known columns, typed (text flags normalised, numbers via try_cast),
    typed nulls for the missing ones."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f"`{f.name}`")
            if f.name in FLAG_COLUMNS:
                c = normalize_flag(c)
            elif f.name.startswith("timestamp_"):
                c = coerce_epoch(c)
            elif isinstance(f.dataType, T.StringType):
                c = c.cast("string")
            elif not isinstance(f.dataType, T.TimestampType):
                c = c.cast("string").try_cast(f.dataType)
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in schema.fieldNames()] if keep_extra else []
    return df.select(*cols, *extra)


def write_reviews_table(df: DataFrame, path: str, mode: str = "append", observation=None) -> None:
    """Parquet table partitioned by app, rows sorted by time inside each file so
    min/max statistics prune time ranges (the index replacement). Rows are dealt by
    ranges of (app, time, id), so an app with most of the rows is written by many
    tasks. ``observation`` counts the written rows as ``n`` (after the exchange, whose
    sampling pass would count them too)."""
    dealt = df.repartitionByRange("app_id", "timestamp_created", "recommendation_id") \
        .sortWithinPartitions("app_id", "timestamp_created")
    if observation is not None:
        dealt = dealt.observe(observation, F.count(F.lit(1)).alias("n"))
    (dealt.write.mode(mode).partitionBy("app_id").parquet(path))


def read_reviews_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, app_id: str | None = None) -> None:
    """Newest-first CSV export (optionally one app)."""
    if app_id is not None:
        df = df.where(F.col("app_id") == str(app_id))
    (df.orderBy(F.col("timestamp_created").desc(), "recommendation_id")
       .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def export_json(df: DataFrame, path: str, app_id: str | None = None) -> None:
    """JSON Lines export, UTF-8, non-ASCII kept."""
    if app_id is not None:
        df = df.where(F.col("app_id") == str(app_id))
    df.write.mode("overwrite").json(path)


def load_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, stripped, blanks dropped; a missing file is empty (any
    other failure is raised)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "word string")
    t = spark.read.text(path)
    return t.select(F.trim("value").alias("word")).where(F.col("word") != "")


WHOLE_FILE = 1 << 30
BLOCK = 64 << 20


def _block_md5(batches):
    """MD5 of every (path, at, size) range of a file, read in pieces of a megabyte."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs
    for batch in batches:
        sums = []
        for path, at, size in zip(*batch.to_pydict().values()):
            system, name = fs.FileSystem.from_uri(quote(path, safe=":/"))
            md5 = hashlib.md5()
            with system.open_input_file(name) as f:
                f.seek(at)
                while size and (piece := f.read(min(size, 1 << 20))):
                    md5.update(piece)
                    size -= len(piece)
            if size:
                raise OSError(f"{path} became shorter while it was read")
            sums.append(md5.digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.binary())],
                                         ["path", "at", "md5"])


def content_sums(spark: SparkSession, path_glob: str, whole: int = WHOLE_FILE, block: int = BLOCK) -> DataFrame:
    """(path, modificationTime, md5) of files of any size, by all of their content. Files
    of less than ``whole`` bytes are one value each (plain MD5); a larger one, which a
    Spark value could not hold, is read in blocks by many tasks, and its sum is the MD5
    of the sums of its blocks in order, with ``-`` and their number behind it. The blocks
    lie at fixed places, so the sum does not depend on how Spark splits the work."""
    found = spark.read.format("binaryFile").load(path_glob)
    small = found.where(F.col("length") < whole).select("path", "modificationTime", F.md5("content").alias("md5"))
    large = found.where(F.col("length") >= whole).select("path", "modificationTime", "length")
    ranges = (large.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("length") - 1).cast("long"),
                                                                  F.lit(block).cast("long"))).alias("at"))
              .select("path", "at", F.least(F.lit(block).cast("long"), F.col("length") - F.col("at")).alias("size"))
              .repartition(F.col("path"), F.col("at")))
    sums = ranges.mapInArrow(_block_md5, "path string, at long, md5 binary").groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("at", "md5"))).alias("blocks"))  # 24 bytes a block
    folded = F.concat(F.md5(F.aggregate("blocks", F.lit(b""), lambda s, b: F.concat(s, b["md5"]))), F.lit("-"),
                      F.size("blocks").cast("string"))
    return small.unionByName(large.join(sums, "path").select("path", "modificationTime", folded.alias("md5")))


def changed_files(spark: SparkSession, path_glob: str, manifest: DataFrame | None = None,
                  max_age_hours: float = 24.0, now=None, whole: int = WHOLE_FILE, block: int = BLOCK) -> DataFrame:
    """Files whose content sum is not in the manifest (path, md5, checked_at), or whose
    last check is older than ``max_age_hours``; newest first. Content is compared at any
    size (``content_sums``), never length or time in its place."""
    files = content_sums(spark, path_glob, whole, block)
    if manifest is None:
        return files.withColumn("reason", F.lit("new")).orderBy(F.col("modificationTime").desc())
    now_c = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    m = manifest.select("path", F.col("md5").alias("m_md5"), "checked_at")
    j = files.join(m, "path", "left")
    reason = (F.when(F.col("m_md5").isNull(), "new").when(F.col("m_md5") != F.col("md5"), "changed")
              .when(F.col("checked_at") < now_c - F.expr(f"INTERVAL {int(max_age_hours * 3600)} SECONDS"),
                    "stale"))
    return (j.withColumn("reason", reason).where(F.col("reason").isNotNull())
             .select("path", "modificationTime", "md5", "reason").orderBy(F.col("modificationTime").desc()))
