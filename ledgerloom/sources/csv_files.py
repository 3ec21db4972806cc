"""Published CSV files landed as text: encodings by file, headings mapped to one schema, rows numbered as in the file.

Nothing is inferred and nothing dropped.  A file is UTF-8 if it starts with a byte-order mark, else Windows-1252.  Its
header is its first record; headings are matched without letter case, blanks and marks.  What doesn't fit is reported.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.drift import heading_key

#: Columns that are read at first; if a record has more, the files are read with as many as it has.
WIDEST = 120
LINEAGE = ("_source_file", "_source_url", "_retrieved_at", "_period", "_row_num")
_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}
_LATIN_TO_WINDOWS = ("".join(_WINDOWS), "".join(_WINDOWS.values()))


@dataclass(frozen=True)
class Landed:
    """``rows``: the canonical columns and ``LINEAGE``, all text but ``_row_num``; ``problems``: (source_file, problem, detail)."""

    rows: DataFrame
    problems: DataFrame


def encodings(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The encoding of each file by its first three bytes, which is all that is read of it; folders and patterns stand for their files."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for p in paths:
        pattern = jvm.org.apache.hadoop.fs.Path(p)
        fs = pattern.getFileSystem(conf)
        found = list(fs.globStatus(pattern) or [])
        if not found:
            raise FileNotFoundError(p)
        inside = [f for s in found if s.isDirectory() for f in fs.listStatus(s.getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"]
        for f in (*[s for s in found if s.isFile()], *inside):
            stream = fs.open(f.getPath())
            mark = bytes(x for x in (stream.read() for _ in range(3)) if x >= 0)
            stream.close()
            out[f.getPath().toString()] = "UTF-8" if mark == b"\xef\xbb\xbf" else "windows-1252"
    return out


def records(spark: SparkSession, paths: Sequence[str], widest: int = WIDEST) -> DataFrame:
    """(source_file, row_num, cells): every record of every file with its place in the file; the header is row 0.

    Quoted line breaks stay inside their record, so a file is read by one task; files are read side by side.  A wholly
    blank line is no record.  Missing cells at a record's end are left off.  No cell is cut: ``widest`` is only the width tried first.
    """
    parts = []
    for encoding in sorted(set((by := encodings(spark, paths)).values())):
        files = [p for p, e in by.items() if e == encoding]
        # Spark reads Latin-1 but not Windows-1252; the two differ in 27 characters, which are put right afterwards
        width, df = widest, None
        while df is None:
            schema = T.StructType([*[T.StructField(f"c{k}", T.StringType()) for k in range(width)], T.StructField("_over", T.StringType())])
            df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_over").option("columnPruning", False).option("maxColumns", max(20_480, 2 * width)).option("encoding", "UTF-8" if encoding == "UTF-8" else "ISO-8859-1").option("multiLine", True).option("header", False).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(files)
            # _over holds the text of records of another width; their cells are told by the commas outside of quoted fields
            bare = F.regexp_replace("_over", r'(^|,)"(?:[^"]++|"")*+("|$)', "$1")
            most = df.select("c0", (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).alias("n")).agg(F.max("n"), F.count("c0")).first()[0] or 0
            if most > width:
                width, df = most, None
        cells = F.array(*[F.col(f"c{k}") if encoding == "UTF-8" else F.translate(f"c{k}", *_LATIN_TO_WINDOWS) for k in range(width)])
        used = F.array_max(F.transform(cells, lambda x, k: F.when(x.isNotNull(), k + 1).otherwise(0)))
        parts.append(df.select(F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("_id"), F.slice(cells, 1, F.greatest(used, F.lit(1))).alias("cells")))
    if not parts:
        return spark.createDataFrame([], "source_file string, row_num bigint, cells array<string>")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # ids grow inside a file's one task, so their order is the file's
    own = Window.partitionBy("source_file").orderBy("_id")
    return whole.select("source_file", (F.row_number().over(own) - 1).cast("bigint").alias("row_num"), "cells")


def land(spark: SparkSession, paths: Sequence[str], headings: Mapping[str, Sequence[str]], provenance: DataFrame | None = None, widest: int = WIDEST) -> Landed:
    """Rows of all files under the canonical columns of ``headings`` (canonical name -> headings publishers use for it).

    Columns that a file lacks are empty.  ``provenance`` (source_file, source_url, retrieved_at, period) fills the lineage.
    Problems: an unknown heading, data under no heading, a heading twice, and a match that needed letter case ignored.
    """
    known = {h.replace(" ", "").lower(): c for c, hs in headings.items() for h in (c, *hs)}
    exact = {h for hs in headings.values() for h in hs} | set(headings)
    all_ = records(spark, paths, widest)
    canonical = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    heads = all_.where("row_num = 0").select("source_file", F.col("cells").alias("head"), F.transform("cells", lambda h: F.try_element_at(canonical, heading_key(h))).alias("names"))
    rows = all_.where("row_num > 0").join(heads, "source_file")
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.nullif(F.array_position("names", c), F.lit(0)).cast("int")), F.lit(""))
    body = rows.select("source_file", "row_num", *[cell(c).alias(c) for c in headings])
    if provenance is not None:
        body = body.join(provenance.select("source_file", "source_url", "retrieved_at", "period").dropDuplicates(["source_file"]), "source_file", "left")
    else:
        body = body.select("*", *[F.lit(None).cast("string").alias(c) for c in ("source_url", "retrieved_at", "period")])
    out = body.select(*headings, F.col("source_file").alias("_source_file"), F.col("source_url").alias("_source_url"), F.col("retrieved_at").cast("string").alias("_retrieved_at"), F.col("period").alias("_period"), F.col("row_num").alias("_row_num"))
    h = heads.select("source_file", "names", F.posexplode("head").alias("k", "heading")).withColumn("name", F.element_at("names", F.col("k") + 1))
    bare = F.coalesce(F.trim("heading"), F.lit("")) == ""
    told = lambda df, p, d: df.select("source_file", F.lit(p).alias("problem"), d.alias("detail"))
    problems = told(h.where(~bare & F.col("name").isNull()), "unknown heading", F.col("heading"))
    problems = problems.unionByName(told(h.where(F.col("name").isNotNull() & ~F.col("heading").isin(*exact)), "heading matched loosely", F.col("heading")))
    problems = problems.unionByName(told(h.where("name IS NOT NULL").groupBy("source_file", "name").count().where("count > 1"), "heading twice", F.col("name")))
    stray = F.exists(F.transform("cells", lambda x, k: (F.trim(F.coalesce(x, F.lit(""))) != "") & (F.trim(F.coalesce(F.try_element_at("head", k + 1), F.lit(""))) == "")), lambda b: b)
    problems = problems.unionByName(told(rows.where(stray), "data under no heading", F.col("row_num").cast("string")))
    return Landed(out, problems)


def read_register(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A register file as text under trimmed column names; short records are padded with NULL, none is lost."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    names = {c.strip(): c for c in df.columns}
    return df.select(*[F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns])


def records_per_file(spark: SparkSession, paths: Sequence[str], expected: DataFrame | None = None, widest: int = WIDEST) -> DataFrame:
    """(source_file, records[, expected, verdict]): records after the header in each file, beside a census where one is given."""
    counted = records(spark, paths, widest).groupBy("source_file").agg((F.count(F.lit(1)) - 1).alias("records"))
    if expected is None:
        return counted
    j = counted.join(expected.select("source_file", "expected"), "source_file", "full")
    return j.withColumn("verdict", F.when(F.col("records").eqNullSafe(F.col("expected").cast("bigint")), "PASS").otherwise("FAIL"))


def columns_census(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, columns_n, not_text_n): how many columns each table has and how many are no text."""
    rows = [(n, len(df.dtypes), sum(t != "string" for _, t in df.dtypes)) for n, df in frames.items()]
    return next(iter(frames.values())).sparkSession.createDataFrame(rows, "table_name string, columns_n int, not_text_n int")


def checksums(spark: SparkSession, paths: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """(source_file, sha256[, verdict]): each file's checksum, compared with the expected one where given."""
    found = spark.read.format("binaryFile").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return found
    j = found.join(expected.select("source_file", F.lower("sha256").alias("expected")), "source_file", "full")
    return j.select("source_file", "sha256", F.when(F.col("sha256") == F.col("expected"), "PASS").otherwise("FAIL").alias("verdict"))


def diagnose(raw: DataFrame, record: str = "raw_record", file: str = "source_file", row: str = "row_num") -> DataFrame:
    """Per file: blank records, records with line breaks inside, quoting faults, and records of another width than the header."""
    from ledgerloom.operators.record_parsing import classify_records

    blank = F.coalesce(F.trim(record), F.lit("")) == ""
    return classify_records(raw, record, file, row).groupBy(file).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(blank).alias("blank"), F.count_if(F.col(record).rlike(r"[\r\n].")).alias("with_breaks"), F.count_if(F.col("reason") == "quoting").alias("quoting"), F.count_if(F.col("reason") == "column_count").alias("other_width"), F.count_if(F.col("reason") == "bad_value").alias("bad_value"))


def export_csv(df: DataFrame, path: str, order: Sequence[str], single: bool = True) -> None:
    """Write a table as CSV in a stable order, text in UTF-8: one file for tables of export size, else range-sorted parts."""
    columns = [F.col(c).asc_nulls_first() for c in order]
    out = df.orderBy(*columns).coalesce(1) if single else df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
