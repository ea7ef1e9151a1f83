"""Writers. Tables go out as Parquet or JSON; single files are for results small enough to read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import flat_path
from assayer.sources.tables import exists


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, through the path's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _indented(batches: Iterator[pa.RecordBatch], indent: int, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Each row's JSON as an item of a list or, ``keyed``, as an entry of a sorted object (key, json), indented for its place."""
    for batch in batches:
        out = []
        for key, line in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            text = json.dumps({key: json.loads(line)}, ensure_ascii=False, indent=2, sort_keys=True)[4:-2] if keyed else json.dumps(json.loads(line), ensure_ascii=False, indent=2)
            out.append(" " * indent + (text if keyed else text.replace("\n", "\n" + " " * indent)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def _items(df: DataFrame, folder: str, indent: int, key: str | None = None) -> list[Any]:
    """Writes rows as parts of a JSON list or object, in the order of the rows; gives the files, in order, of those that hold something."""
    name = F.col(key).cast("string") if key else F.lit("")
    lines = df.select(name.alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    lines.mapInArrow(partial(_indented, indent=indent, keyed=key is not None), "value string").write.mode("overwrite").option("lineSep", ",\n").text(folder)
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(target)
    return sorted((f for f in found if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())


def _join(spark: SparkSession, path: str, parts: list[str | list[Any]]) -> None:
    """One file from texts and lists of part files. Files are copied from stream to stream; the separator after the last row of a list is left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            if isinstance(part, str):
                out.write(bytearray(part.encode()))
                continue
            for file in part:
                stream = file.getPath().getFileSystem(conf).open(file.getPath())
                try:
                    held = jvm.org.apache.commons.io.input.BoundedInputStream(stream, file.getLen() - 2) if file is part[-1] else stream
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
                finally:
                    stream.close()
    finally:
        out.close()


def _remove(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def evaluation(path: str, scores: DataFrame, results: DataFrame, aggregate: DataFrame) -> None:
    """scores, results and aggregate in one indented JSON file. Executors write the rows as parts beside it, which are joined through the file system: the driver
    holds means alone. A failed write leaves no file with a part of the rows."""
    spark, listed = scores.sparkSession, lambda files: ["[\n", files, "\n  ]"] if files else ["[]"]
    first, second = _items(scores, f"{path}.parts/scores", 4), _items(results, f"{path}.parts/results", 4)
    means = json.dumps({r["metric_name"]: r["mean_value"] for r in aggregate.collect()}, ensure_ascii=False, indent=2).replace("\n", "\n  ")
    _join(spark, path, ['{\n  "scores": ', *listed(first), ',\n  "results": ', *listed(second), f',\n  "aggregate": {means}\n}}'])
    _remove(spark, f"{path}.parts")


def envelope(rows: DataFrame, component: str, metadata: dict[str, Any], key: str = "results") -> DataFrame:
    """(metadata, <key>) as one JSON text for each row: what a stage hands on, with where it comes from."""
    about = json.dumps({"component": component, **metadata}, ensure_ascii=False, sort_keys=True)
    return rows.select(F.lit(about).alias("metadata"), F.to_json(F.struct("*")).alias(key))


def documents(path: str, docs: DataFrame) -> None:
    """Canonical documents as one table."""
    docs.write.mode("errorifexists").parquet(path)


def text_files(path: str, docs: DataFrame) -> None:
    """Each document as a file of its own below a folder that all executors mount, for tools that want files; partitions write theirs.

    The engine itself reads and writes tables (see documents), which go to any store.
    """

    def run(rows: Iterator[Any]) -> None:
        import os

        for r in rows:
            target = os.path.join(path, r["canonical_path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8") as f:
                f.write(r["text"])

    docs.select("canonical_path", "text").foreachPartition(run)


def manifest(path: str, entries: DataFrame) -> None:
    entries.write.mode("errorifexists").json(path)


def staged(docs: DataFrame) -> DataFrame:
    """Documents under flat names. Two paths with one flat name fail the query."""
    named = docs.withColumn("name", flat_path(F.col("canonical_path")))
    twice = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    clash = F.raise_error(F.concat(F.lit("several documents would be called "), F.col("name"))).cast("boolean")
    return named.join(twice, "name", "left").filter(F.when(F.col("n").isNotNull(), clash).otherwise(True)).drop("n")


def versioned(path: str, df: DataFrame) -> str:
    """Writes the next version below a folder and returns its path; no version is ever written over."""
    version = 0
    while exists(df.sparkSession, f"{path}/v{version}"):
        version += 1
    df.write.parquet(f"{path}/v{version}")
    return f"{path}/v{version}"


def csv_documents(path: str, docs: DataFrame) -> None:
    docs.select("id", "title", "text").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_steps(path: str, steps: DataFrame) -> None:
    steps.select("step", "exit_code", "log").write.mode("append").json(path)


def prompt_file(spark: SparkSession, path: str, text: str) -> None:
    write_text(spark, path, text.rstrip() + "\n")


def upsert_settings(text: str, values: dict[str, str]) -> str:
    """KEY=value lines with the values put in: in place where a key is there, else at the end."""
    left, out = dict(values), []
    for line in text.splitlines():
        key = line.split("=", 1)[0].strip()
        out.append(f"{key}={left.pop(key)}" if key in left and "=" in line else line)
    return "\n".join([*out, *(f"{k}={v}" for k, v in left.items())]) + "\n"


def state(path: str, rows: DataFrame, key: str) -> None:
    """A JSON object by key, sorted, joined like an evaluation; keys are unique."""
    files = _items(rows.orderBy(F.col(key).cast("string")), f"{path}.parts", 2, key)
    _join(rows.sparkSession, path, ["{\n", files, "\n}\n"] if files else ["{}\n"])
    _remove(rows.sparkSession, f"{path}.parts")
