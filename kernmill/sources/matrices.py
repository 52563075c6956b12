"""Readers and writers: matrices as CSV, text or doubles, exact densities,
neighbour lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import dense_index


def read_csv_matrix(spark: SparkSession, path: str, first: int, last: int, header: bool = False, rows: int | None = None, sep: str = ",", float32: bool = True) -> DataFrame:
    """id (row number in the order of the files) and x, columns first to last
    inclusive; an empty field is 0. Fields are read as 32-bit floats by default."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(last + 1)])
    raw = spark.read.csv(path, schema=schema, header=header, sep=sep, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    kind = "float" if float32 else "double"
    x = F.array(*[F.coalesce(F.col(f"c{k}").try_cast(kind).cast("double"), F.lit(0.0)) for k in range(first, last + 1)])
    out = _numbered(raw, x)
    return out.where(F.col("id") < rows) if rows else out


def read_text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """id and x from lines of numbers between white space."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    x = F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.cast("double"))
    return _numbered(raw, x)


def _numbered(raw: DataFrame, x) -> DataFrame:
    """id and x: rows numbered by file name, then place in the file."""
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")]
    return dense_index(raw.select(*at, x.alias("x")), ["_f", "_b", "_m"], "id").select("id", "x")


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """_f, _k and record: the records of so many bytes, by their file's place among the names and their own in it.
    Files are split like any others; a file that holds no whole number of records raises."""
    files = sorted((r["path"], r["length"]) for r in listing(spark, path).collect())  # a name a file
    if any(length % size for _, length in files):
        raise ValueError(f"a file's length is no multiple of {size}")
    context, kind = spark.sparkContext, "org.apache.spark.input.FixedLengthBinaryInputFormat"
    read = lambda f: context.newAPIHadoopFile(f, kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(size)})
    rows = [read(f).map(lambda r, k=k: (k, r[0], bytes(r[1]))) for k, (f, length) in enumerate(files) if length]
    return spark.createDataFrame(context.union(rows) if rows else [], "_f int, _k long, record binary")


def read_binary_matrix(spark: SparkSession, path: str, d: int) -> DataFrame:
    """id and x from files of little-endian doubles, row after row; files in the order of their names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = pa.array(np.frombuffer(b"".join(b.column(2).to_pylist()), "<f8"))
            x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * d, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["_f", "_k", "x"])

    raw = _records(spark, path, 8 * d).mapInArrow(rows, "_f int, _k long, x array<double>")
    return dense_index(raw, ["_f", "_k"], "id").select("id", "x")


def _write_records(rows: DataFrame, path: str, packed: Callable[[pa.RecordBatch], bytes]) -> None:
    """Raw bytes in a folder of any store that pyarrow's file systems reach, a file a
    task. A task writes under the name of its attempt and renames the whole file, so
    a repeated one puts the same bytes in the same place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, at = FileSystem.from_uri(re.sub("^file:/+", "/", path))
        task, n = TaskContext.get(), 0
        store.create_dir(at, recursive=True)
        own = f"{at}/_{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            for b in batches:
                out.write(packed(b))
                n += b.num_rows
        store.move(own, f"{at}/part-{task.partitionId():05d}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.sparkSession.createDataFrame([], "value string").write.text(path)  # the folder, which must be new
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_binary_matrix(points: DataFrame, path: str) -> None:
    """Little-endian doubles, row after row, of (id, x) in the order of the ids."""
    _write_records(in_order(points.select("id", "x"), "id").select("x"), path, lambda b: b.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())


def read_exact(spark: SparkSession, path: str) -> DataFrame:
    """density and idx."""
    return spark.read.csv(path, schema="density double, idx long")


def write_exact(densities: DataFrame, path: str) -> None:
    """Lines `density,idx` of (qid, density)."""
    densities.select("density", F.col("qid").alias("idx")).write.csv(path)


def write_matrix(points: DataFrame, path: str, sep: str = ", ") -> None:
    points.select(F.array_join(F.transform("x", lambda v: v.cast("string")), sep).alias("value")).write.text(path)


def write_knn(lists: DataFrame, path: str) -> None:
    """A line for each query: the query, then distance and id by rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "dist2", "id")))
    body = F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", r["dist2"].cast("string"), r["id"].cast("string"))), " ")
    lists.groupBy("qid").agg(body.alias("b")).select(F.concat_ws(" ", F.col("qid").cast("string"), "b").alias("value")).write.text(path)


def write_queries(queries: DataFrame, path: str, sep: str = ", ") -> None:
    """Lines of numbers of (qid, q), in the order of the ids."""
    write_matrix(in_order(queries.select("qid", F.col("q").alias("x")), "qid"), path, sep)


def write_potentials(potentials: DataFrame, path: str, column: str = "potential") -> None:
    """A line `qid potential` for each target, in the order of the ids, whatever order they were computed in."""
    in_order(potentials, "qid").select(F.concat_ws(" ", F.col("qid").cast("string"), F.col(column).cast("string")).alias("value")).write.text(path)


def read_potentials(spark: SparkSession, path: str) -> DataFrame:
    """qid and potential."""
    p = F.split("value", " ")
    return spark.read.text(path).select(p[0].cast("long").alias("qid"), p[1].cast("double").alias("potential"))


def write_clusters(assigned: DataFrame, centers: list[list[float]], path: str) -> None:
    """Under path/members lines `id cluster` in the order of the ids, under path/centers the centers as a matrix."""
    spark = assigned.sparkSession
    in_order(assigned, "id").select(F.concat_ws(" ", F.col("id").cast("string"), F.col("cluster").cast("string")).alias("value")).write.text(f"{path}/members")
    rows = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centers)], "id long, x array<double>")
    write_matrix(in_order(rows, "id"), f"{path}/centers", " ")


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, cluster), and the centers as (id, x)."""
    p = F.split("value", " ")
    return spark.read.text(f"{path}/members").select(p[0].cast("long").alias("id"), p[1].cast("int").alias("cluster")), read_text_matrix(spark, f"{path}/centers")


def in_order(rows: DataFrame, id_: str) -> DataFrame:
    """Rows dealt by ranges of the ids and sorted, so that files in their order, and lines in them, ascend."""
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_).sortWithinPartitions(id_)


def read_knn(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank, dist2, id."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    n = F.expr("(size(p) - 1) div 2")
    rows = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.cast("int").alias("rank"), F.element_at("p", (2 * k).cast("int")).cast("double").alias("dist2"), F.element_at("p", (2 * k + 1).cast("int")).cast("long").alias("id")))
    return parts.where("size(p) > 2").select(F.element_at("p", 1).cast("long").alias("qid"), F.explode(rows).alias("r")).select("qid", "r.*")


def _list_record(k: int) -> np.dtype:
    return np.dtype([("q", "<i8"), ("n", [("d", "<f8"), ("i", "<i8")], (k,))])


def write_knn_binary(lists: DataFrame, path: str, k: int) -> None:
    """Records as read_knn_binary() takes them, in the order of the queries; a shorter list ends in distances without end."""

    def packed(b: pa.RecordBatch) -> bytes:
        out = np.empty(b.num_rows, _list_record(k))
        out["q"], out["n"]["d"], out["n"]["i"] = b.column(0).to_numpy(), np.inf, -1
        for row, found in zip(out["n"], b.column(1).to_pylist(), strict=True):
            row["d"][: len(found)], row["i"][: len(found)] = [x["dist2"] for x in found], [x["id"] for x in found]
        return out.tobytes()

    own = F.array_sort(F.collect_list(F.struct("rank", "dist2", "id"))).alias("found")
    _write_records(in_order(lists.where(F.col("rank") <= k).groupBy("qid").agg(own), "qid"), path, packed)


def read_knn_binary(spark: SparkSession, path: str, k: int) -> DataFrame:
    """qid, rank, dist2, id from files of records: the query's id, then k pairs of distance (double) and id, all of 64 bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.frombuffer(b"".join(b.column(2).to_pylist()), _list_record(k))
            rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(m["q"], k)), pa.array(rank), pa.array(m["n"]["d"].ravel()), pa.array(m["n"]["i"].ravel())], ["qid", "rank", "dist2", "id"])

    read = _records(spark, path, _list_record(k).itemsize).mapInArrow(rows, "qid long, rank int, dist2 double, id long")
    return read.where(F.col("dist2") < float("inf"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files that a path or pattern names, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def convert_inputs(points: DataFrame, densities: DataFrame, points_path: str, queries_path: str) -> None:
    """Points as lines of numbers, and as queries the rows that exact densities (density, idx) name."""
    write_matrix(points, points_path, " ")
    write_matrix(points.join(densities.select(F.col("idx").alias("id")), "id"), queries_path, " ")


def with_charges(points: DataFrame, kind: str, salt: str = "charge") -> DataFrame:
    """points with charge: ones (1 / sqrt n), rand (uniform, of unit norm), norm, zeros or debug (the id)."""
    from ..functions.random import normal, uniform

    if kind == "ones":
        return points.crossJoin(F.broadcast(points.agg((1 / F.sqrt(F.count("*"))).alias("charge"))))
    if kind == "rand":
        own = points.withColumn("_u", uniform("id", salt))
        return own.crossJoin(F.broadcast(own.agg(F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("_n")))).withColumn("charge", F.col("_u") / F.col("_n")).drop("_u", "_n")
    value = {"norm": normal("id", salt), "zeros": F.lit(0.0), "debug": F.col("id").cast("double")}[kind]
    return points.withColumn("charge", value)
