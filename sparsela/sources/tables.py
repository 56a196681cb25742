"""Sources and sinks: signals, NumPy files, models."""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import arrays as A
from ..operators.encode import atoms_of, atoms_table, list_column


def signals(spark: SparkSession, path: str, id_col: str, x: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, x, ...) from a Parquet table with a vector column; only these columns are read."""
    return spark.read.parquet(path).select(F.col(id_col).alias("sample_id"), A.doubles(x).alias("x"), *keep)


def write_signals(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def npy_signals(spark: SparkSession, path: str, columns: bool = True) -> DataFrame:
    """Signals of ``.npy`` files read through Spark, one task a file: columns of features x samples, or
    rows. Sample ids continue over files in the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def matrix(content: bytes) -> np.ndarray:
        m = np.load(io.BytesIO(content), allow_pickle=False)
        if m.ndim != 2:
            raise ValueError("a signal file has two dimensions")
        return (m.T if columns else m).astype(float)

    def sizes(batches):
        for b in batches:
            n = [len(matrix(c)) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["path", "n"])

    count = sorted((r["path"], r["n"]) for r in files.mapInArrow(sizes, "path string, n long").collect())
    starts = dict(zip((p for p, _ in count), np.cumsum([0, *(n for _, n in count)]).tolist()))

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = matrix(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m)) + starts[p]), list_column(m)], ["sample_id", "x"])

    return files.mapInArrow(run, "sample_id long, x array<double>")


class NpySource(DataSource):
    """``spark.read.format("npy_columns")``: column blocks of one memory-mapped ``.npy`` file.

    Options: path, batch_size (10000), start_col (0), end_col. For files that every executor can
    open; ``npy_signals`` reads through Spark instead."""

    @classmethod
    def name(cls) -> str:
        return "npy_columns"

    def schema(self) -> str:
        return "sample_id long, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _Block(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size, self.start = int(options.get("batch_size", 10_000)), int(options.get("start_col", 0))
        m = np.load(self.path, mmap_mode="r")
        if m.ndim != 2:
            raise ValueError("a signal file has two dimensions")
        self.end = min(int(options.get("end_col", m.shape[1])), m.shape[1])

    def partitions(self):
        return [_Block(i, min(i + self.size, self.end)) for i in range(self.start, self.end, self.size)] or [_Block(0, 0)]

    def read(self, block):
        m = np.asarray(np.load(self.path, mmap_mode="r")[:, block.start : block.end], float).T
        for i, row in enumerate(m):
            yield block.start + i, row.tolist()


def estimate_memory(n: int, p: int, k: int, batch_size: int, item: int = 4) -> dict:
    """Megabytes of input, output, dictionary and working arrays, and the number of batches."""
    mb = lambda c: c * item / 1e6
    parts = {"input_mb": mb(p * n), "output_mb": mb(k * n), "dictionary_mb": mb(p * k), "working_mb": mb(batch_size * (p + 3 * k))}
    return parts | {"total_mb": sum(parts.values()), "total_batches": math.ceil(n / batch_size)}


def checksum(d: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(d, "<f8").tobytes()).hexdigest()


def save_model(spark: SparkSession, d, path: str, config: dict | None = None, name: str = "model", version: str = "1") -> None:
    """atoms and a one-row manifest with the checksum, as Parquet under ``path``."""
    d = atoms_of(d)
    atoms_table(spark, d).coalesce(1).write.parquet(f"{path}/atoms")
    row = (name, version, datetime.datetime.now(datetime.timezone.utc), d.shape[1], d.shape[0], json.dumps(config or {}, sort_keys=True), checksum(d))
    spark.createDataFrame([row], "name string, version string, created timestamp, p int, k int, config string, checksum string").coalesce(1).write.parquet(f"{path}/manifest")


def load_model(spark: SparkSession, path: str, verify: bool = True) -> tuple[np.ndarray, dict]:
    """The dictionary and its manifest; a wrong checksum raises."""
    d = atoms_of(spark.read.parquet(f"{path}/atoms"))
    m = spark.read.parquet(f"{path}/manifest").first().asDict()
    if verify and m["checksum"] != checksum(d):
        raise ValueError(f"the dictionary in {path} does not have the checksum of its manifest")
    m["config"] = json.loads(m["config"])
    return d, m


def list_models(spark: SparkSession, directory: str) -> DataFrame:
    """Manifests of all models under a directory."""
    return spark.read.parquet(f"{directory}/*/manifest").withColumn("path", F.regexp_replace(F.input_file_name(), "/manifest/[^/]*$", ""))


def export_numpy(d, path: str) -> None:
    """The dictionary as features x atoms in a ``.npy`` file of the driver."""
    np.save(path, atoms_of(d).T)


def export_sql(d, lam: float, x: str = "x") -> str:
    """One-shot encoder soft_threshold(D x, lam) as a Spark SQL expression, for use without Python."""
    rows = ", ".join("array(" + ", ".join(f"{v!r}D" for v in map(float, r)) + ")" for r in atoms_of(d))
    dot = f"aggregate(zip_with(d, {x}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    return f"transform(transform(array({rows}), d -> {dot}), c -> sign(c) * greatest(abs(c) - {float(lam)!r}D, 0D))"


def deployment_package(spark: SparkSession, d, lam: float, path: str, card: dict | None = None, config: dict | None = None) -> None:
    """Everything that encoding elsewhere needs, under ``path``: the model (``save_model``) and ``files``, a
    table (name, content) of the encoder as a Spark SQL expression, the model card, and how to use them."""
    save_model(spark, d, f"{path}/model", config)
    usage = f"SELECT sample_id, <encoder.sql> AS a FROM signals  -- x: array<double> of {atoms_of(d).shape[1]} values"
    files = [("encoder.sql", export_sql(d, lam)), ("card.json", json.dumps(card or {}, sort_keys=True)), ("usage.txt", usage)]
    spark.createDataFrame(files, "name string, content string").coalesce(1).write.parquet(f"{path}/files")


def images(spark: SparkSession, path: str, decode, glob: str = "*.{png,jpg,jpeg,bmp,tif,tiff,npy}") -> DataFrame:
    """images(image_id, h, w, pix) of the files under ``path``; ``decode`` (bytes -> 2-D array) is the
    caller's, as no image library is part of this package."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for b in batches:
            m = [np.asarray(decode(c), float) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.shape[0] for i in m], pa.int32()), pa.array([i.shape[1] for i in m], pa.int32()), pa.array([i.tolist() for i in m], pa.list_(pa.list_(pa.float64())))], ["path", "h", "w", "pix"])

    return files.select(F.col("path"), "content").mapInArrow(run, "path string, h int, w int, pix array<array<double>>").withColumn("image_id", F.xxhash64("path"))
