"""Documents, tables and digests of files; atomic reports."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Columns of a bulletin of published readings; blank fields of the last two numbers are null.
BULLETIN = T.StructType([T.StructField("year", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("metric", "value", "unit", "observation_system", "center_location", "contour_threshold", "funnel_area", "source_status"))])


def read_document(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


#: Names in a stored fit's document, by column.
_FIT = {"rmse": "rmse", "mae": "mae", "pixel_count": "pixel_count", "ske_min": "Ske_min", "ske_max": "Ske_max", "cu": "Cu_global", "lag_c": "lag_c_days"}


def stored_fits(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """A row for each fold whose document of a stored fit is there, from its part "validation"."""
    rows = []
    for fold, path in paths.items():
        if Path(path).exists():
            found = read_document(path)["validation"]
            rows.append((fold, *(int(found[k]) if c == "pixel_count" else float(found[k]) for c, k in _FIT.items())))
    return spark.createDataFrame(rows, "fold_id long, rmse double, mae double, pixel_count long, ske_min double, ske_max double, cu double, lag_c double")


def stored_errors(*paths: str) -> dict[int, float]:
    """The error of each fold from the first of some documents that is there."""
    for path in paths:
        if Path(path).exists():
            return {int(r["fold_id"]): float(r["validation_rmse"]) for r in read_document(path).get("rows", [])}
    raise FileNotFoundError(", ".join(paths))


def optional_document(path: str | None) -> dict[str, Any]:
    """A document, or nothing where it isn't there."""
    return read_document(path) if path and Path(path).exists() else {}


def write_report(report: Mapping[str, Any], path: str) -> None:
    """JSON with sorted keys, whole or not at all."""
    text = json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, default=lambda x: x.item())
    write_text(text + "\n", path)


def write_text(text: str, path: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    held = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    held.write_text(text, encoding="utf-8")
    os.replace(held, target)


def write_table(df: DataFrame, path: str, fields: Iterable[str]) -> None:
    """CSV with a header and these fields in this order; missing values are empty."""
    have = set(df.columns)
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in fields)).write.mode("overwrite").csv(path, header=True, emptyValue="")


def digest(values: Mapping[str, Any]) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def file_digest(path: str, chunk: int = 8 << 20) -> str:
    """SHA-256 of a file of any size."""
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            found.update(block)
    return found.hexdigest()


def small_file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of the files below a path, each small enough for one row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def file_digests(files: DataFrame, path: str = "path") -> DataFrame:
    """files(path, ...) with size_bytes and sha256 of each, read by tasks a piece at a time: files of any size; null where there is none."""
    out = T.StructType([*files.schema.fields, T.StructField("size_bytes", T.LongType()), T.StructField("sha256", T.StringType())])

    def look(batches):
        for batch in batches:
            found = []
            for where in batch.column(path).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(where) if where else (None, None)
                if not where or fs.get_file_info(at).type != pyarrow.fs.FileType.File:
                    found.append((None, None))
                    continue
                own, size = hashlib.sha256(), 0
                with fs.open_input_stream(at) as f:
                    while piece := f.read(8 << 20):
                        own.update(piece)
                        size += len(piece)
                found.append((size, own.hexdigest()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], out.names)

    return files.mapInArrow(look, out)


def nested_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, body variant) of the JSON files below a path, one document a file; document is the file's name.

    A file that isn't JSON has a null body.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("document"), F.try_parse_json("value").alias("body"))


def leaves(documents: DataFrame, depth: int = 4) -> DataFrame:
    """(document, path, kind, value) of what lies at the ends of nested bodies, parts joined by dots; elements by number.

    kind is the type's name as Spark gives it to variants, value the text. What lies deeper than depth stays as JSON.
    """
    rows, out = documents.select("document", F.lit("").alias("path"), F.col("body").alias("v")), None
    for level in range(depth + 1):
        rows = rows.withColumn("kind", F.schema_of_variant("v"))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        ends = rows if level == depth else rows.where(~nested)
        ends = ends.where("path <> ''").select("document", "path", F.when(nested, "JSON").otherwise(F.regexp_replace("kind", r"\(.*", "")).alias("kind"), F.when(nested, F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string")).alias("value"))
        out = ends if out is None else out.unionByName(ends)
        inner = documents.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "inside")
        rows = rows.where(nested).lateralJoin(inner).select("document", F.concat_ws(".", F.nullif(F.col("path"), F.lit("")), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("inside").alias("v"))
    return out


def read_bulletin(spark: SparkSession, path: str) -> DataFrame:
    """The bulletin with an explicit schema; numbers are trimmed before the cast, so that a blank is null."""
    rows = spark.read.schema(BULLETIN).csv(path, header=True)
    return with_numbers(rows, "value", "contour_threshold", "funnel_area")


def with_numbers(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS DOUBLE)") for c in columns})


def save_parameters(spark: SparkSession, path: str, name: str, theta: Iterable[float]) -> None:
    """Appends a parameter vector to the table of them."""
    rows = [(name, i, float(v)) for i, v in enumerate(theta)]
    spark.createDataFrame(rows, "param_set string, idx int, value double").write.mode("append").parquet(path)


def load_parameters(spark: SparkSession, path: str, name: str) -> list[float]:
    """The latest values of a parameter vector, in order; the vector is a handful of numbers."""
    rows = spark.read.parquet(path).where(F.col("param_set") == name).orderBy("idx").collect()
    if [r["idx"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"{path} has no single vector {name!r}")
    return [r["value"] for r in rows]


def existence(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """(product, status): present where the path is there, by the driver."""
    return spark.createDataFrame([(k, "present" if Path(v).exists() else "missing") for k, v in names.items()], "product string, status string")
