"""Open file formats: point tables, number matrices, simple fields (text header and floats) and PGM images.

Text is read by Spark's own readers, line by line in parallel; binary files are read
one file a row, so many files are parallel and a single one must fit a task.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CELLS = "path string, field_id bigint, row int, col int, z double"
_KIND = b" Simple Field 1.0"  # fixed value: how the first line of the open format ends


def read_points(spark: SparkSession, path: str, separator: str = r"[\s,;]+") -> DataFrame:
    """``surface_id, x, y, z`` of text lines of three numbers; other lines are left out."""
    parts = F.split(F.trim("value"), separator)
    lines = spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("surface_id"), parts.alias("p"))
    x, y, z = (F.try_element_at("p", F.lit(i)).try_cast("double") for i in (1, 2, 3))
    return lines.select("surface_id", x.alias("x"), y.alias("y"), z.alias("z")).where("x is not null and y is not null and z is not null")


def write_points(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in "xyz"))).write.text(path)


def read_matrix(spark: SparkSession, path: str, separator: str = r"[\s,;]+") -> DataFrame:
    """A field of each file of numbers; ``#`` starts a comment line.

    A file's lines are numbered by their places, which the text reader keeps; the
    window holds one row a line of one file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("_id"))
    kept = lines.where("trim(value) != '' and not startswith(trim(value), '#')")
    row = F.row_number().over(Window.partitionBy("path").orderBy("block", "_id")) - 1
    cells = kept.withColumn("row", row).select("path", "row", F.posexplode(F.split(F.trim("value"), separator)).alias("col", "v"))
    return cells.select("path", F.xxhash64("path").alias("field_id"), "row", "col", F.col("v").try_cast("double").alias("z"))


def write_matrix(field: DataFrame, path: str) -> None:
    """A text line for each row, in order; a row must fit a task."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("col", "z"))), lambda e: e["z"].cast("string"))
    lines = field.groupBy("field_id", "row").agg(F.array_join(row, "\t").alias("value"))
    lines.repartitionByRange("field_id", "row").sortWithinPartitions("field_id", "row").select("value").write.text(path)


def pack_simple_field(z: np.ndarray, writer: str = "Terrace", **header: object) -> bytes:
    """A field as bytes: a first line, header lines, NULs up to a multiple of four, 32-bit little-endian floats.

    Readers may know the format by the whole first line; ``writer`` is what stands before the format's name in it.
    """
    lines = {"XRes": z.shape[1], "YRes": z.shape[0], **header}
    head = writer.encode() + _KIND + b"\n" + "".join(f"{k} = {v}\n" for k, v in lines.items()).encode()
    return head + b"\0" * (4 - len(head) % 4) + np.ascontiguousarray(z, "<f4").tobytes()


def unpack_simple_field(raw: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and values; a wrong first line, missing sizes or short data raise ValueError."""
    first, _, rest = raw[: raw.find(b"\0")].partition(b"\n")
    if b"\0" not in raw or not first.endswith(_KIND):
        raise ValueError("not a simple field")
    end = raw.index(b"\0")
    pairs = (line.split("=", 1) for line in rest.decode().splitlines() if "=" in line)
    header = {k.strip(): v.strip() for k, v in pairs}
    try:
        xres, yres = int(header["XRes"]), int(header["YRes"])
    except KeyError as missing:
        raise ValueError(f"no {missing} in the header") from None
    start = end + 4 - end % 4
    if xres < 1 or yres < 1 or len(raw) < start + 4 * xres * yres:
        raise ValueError("sizes and data do not fit")
    return header, np.frombuffer(raw, "<f4", xres * yres, start).reshape(yres, xres)


def unpack_pgm(raw: bytes) -> np.ndarray:
    """Values of a binary PGM image of 8 or 16 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    if fields[0] != b"P5":
        raise ValueError("not a binary PGM image")
    width, height, top = map(int, fields[1:])
    return np.frombuffer(raw, ">u2" if top > 255 else "u1", width * height, at + 1).reshape(height, width)


def _read_binary(spark: SparkSession, path: str, unpack) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("field_id"), "content")

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                z = unpack(bytes(r.content))
                row, col = np.indices(z.shape, np.int32)
                yield pd.DataFrame({"path": r.path, "field_id": r.field_id, "row": row.ravel(), "col": col.ravel(), "z": z.ravel().astype(float)})

    return files.mapInPandas(run, _CELLS)


def read_simple_fields(spark: SparkSession, path: str) -> DataFrame:
    return _read_binary(spark, path, lambda raw: unpack_simple_field(raw)[1])


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    return _read_binary(spark, path, unpack_pgm)


def read_raw(spark: SparkSession, path: str, xres: int, yres: int, kind: str = "<f4", skip: int = 0, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Files of bare numbers of a numpy ``kind``, after ``skip`` bytes."""
    return _read_binary(spark, path, lambda raw: np.frombuffer(raw, kind, xres * yres, skip).reshape(yres, xres).astype(float) * scale + offset)


def pack_pgm(z: np.ndarray) -> bytes:
    """Values scaled to 16 bits from minimum to maximum."""
    low, high = float(z.min()), float(z.max())
    grey = np.zeros(z.shape) if high == low else (z - low) / (high - low) * 65535
    return b"P5\n%d %d\n65535\n" % (z.shape[1], z.shape[0]) + np.round(grey).astype(">u2").tobytes()


def unpack_points(raw: bytes) -> np.ndarray:
    """Points of the binary XYZ format with a text header: rows of three doubles."""
    end = raw.index(b"\0")
    head = dict(line.split(" = ", 1) for line in raw[:end].decode().splitlines()[1:] if " = " in line)
    start = end + 8 - end % 8
    n = int(head["NPoints"])
    return np.array(struct.unpack_from(f"<{3 * n}d", raw, start)).reshape(n, 3)
