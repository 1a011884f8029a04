"""Reading and writing evaluation tables by file suffix."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}
SEPARATORS = {"csv": ",", "tsv": "\t"}


def format_of(path: str, fmt: str | None = None) -> str:
    """Explicit format, else the one the suffix names."""
    name = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if name not in FORMATS.values():
        raise ValueError(f"unknown table format for {path!r}")
    return name


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """csv / tsv (quoted, multi-line), json (one array or object per file), jsonl, parquet.

    Without a schema, csv columns are strings: nothing is inferred by an extra pass over the data.
    """
    kind = format_of(path if isinstance(path, str) else path[0], fmt)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in SEPARATORS:
        return reader.options(header=True, sep=SEPARATORS[kind], quote='"', escape='"', multiLine=True, encoding="UTF-8").csv(path)
    if kind == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    return reader.json(path, multiLine=kind == "json")


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """csv / tsv with every field quoted, json lines, or parquet; one file per task."""
    kind = format_of(path, fmt)
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if kind in SEPARATORS:
        writer.options(header=True, sep=SEPARATORS[kind], quote='"', escape='"', quoteAll=True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)


def parquet_to_tsv(spark: SparkSession, src: str, dst: str) -> None:
    """Nested columns are written as JSON text."""
    df = spark.read.parquet(src)
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    write_table(df.select(*flat), dst, "tsv")


def read_parts(spark: SparkSession, paths: Sequence[str], schema=None, fmt: str | None = None) -> DataFrame:
    """One benchmark stored in several part files."""
    parts = [read_table(spark, p, schema, fmt) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


ANNOTATION = (
    "index string, image string, question string, `multi-choice options` array<string>, answer string, "
    "category string, `l2-category` string"
)


def shape_annotations(rows: DataFrame, lead: str = "The choices are listed below:\n") -> DataFrame:
    """Annotation records to items: options A..E without their 4-character label, and as prompt text."""
    options = F.col("multi-choice options")
    letters = [F.substring(F.get(options, F.lit(i)), 5, 2147483647).alias(c) for i, c in enumerate("ABCDE")]
    prompt = F.concat(F.lit(lead), F.array_join(options, "\n"))
    return rows.select("index", "image", "question", prompt.alias("options_text"), *letters, "answer", "category", "l2-category")


def read_json_annotations(spark: SparkSession, folder: str, lead: str = "The choices are listed below:\n") -> DataFrame:
    """A folder of annotation files, each holding an array of records."""
    return shape_annotations(spark.read.schema(ANNOTATION).json(folder, multiLine=True), lead)


def detect_kind(columns: Sequence[str]) -> tuple[str, str]:
    """(modality, type) from the columns of a table."""
    if "question" not in columns:
        raise ValueError("a benchmark table needs a question column")
    modality = "IMAGE" if "image" in columns or "image_path" in columns else "TEXT"
    return modality, "MCQ" if "A" in columns and "B" in columns else "VQA"


def agreed_kind(tables: Mapping[str, Sequence[str]]) -> tuple[str, str]:
    """The kind all members of a concatenated benchmark share."""
    kinds = {detect_kind(cols) for cols in tables.values()}
    if len(kinds) != 1:
        raise ValueError(f"members differ in kind: {sorted(kinds)}")
    return kinds.pop()


def profile(df: DataFrame, index: str = "index", question: str = "question") -> DataFrame:
    """Largest index below 1e5 and share of Chinese questions, with the table they point to."""
    small = F.max(F.when(F.col(index) < 100000, F.col(index)))
    chinese = F.avg(F.when(F.col(question).rlike("[一-鿿]"), 1.0).otherwise(0.0))
    stats = df.agg(small.alias("max_index"), F.round(chinese, 6).alias("cjk_share"))
    return stats.withColumn("language", F.when(F.col("cjk_share") > 0.5, "cn").otherwise("en"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint: row count, xor and sum of the rows' md5 heads."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    sums = df.select(head.alias("h")).agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"))
    return sums.select("n", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "x", "s")])).alias("fingerprint"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """md5 of every file under ``path`` (files up to 2 GB, the limit of one binary value; ``checksums.file_crc32`` has none)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.md5("content").alias("md5"), "length")


def verify_checksum(df: DataFrame, columns: Sequence[str], expected: str) -> None:
    """Raise when the table's fingerprint is not the expected one."""
    found = fingerprint(df, columns).first()["fingerprint"]
    if found != expected:
        raise ValueError(f"table fingerprint {found} differs from {expected}")


def predictions_path(model: Column, eval_id: Column, dataset: Column, judge: Column | None = None) -> Column:
    """Folder of the predictions (or, with a judge, of the judged results) of one run."""
    parts = [F.lit("model="), model, F.lit("/eval_id="), eval_id, F.lit("/dataset="), dataset]
    return F.concat(*parts) if judge is None else F.concat(*parts, F.lit("/judge="), judge)


def write_predictions(df: DataFrame, root: str) -> None:
    """Append to the prediction table partitioned by model, run and dataset."""
    write_table(df, root, "parquet", "append", ["model", "eval_id", "dataset"])


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{os.urandom(8).hex()}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="scoreloom-"), name)
