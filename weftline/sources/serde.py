"""Binary records: students in protobuf and XDR form, the packed game snapshot, and CSV and binary files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrays import GRADES, chosen_id, grade_names

STUDENT = T.StructType([T.StructField("key", T.LongType()), T.StructField("nr_albumu", T.LongType()), T.StructField("email", T.StringType()), T.StructField("nazwisko", T.StringType()), T.StructField("imie", T.StringType()), T.StructField("oceny", T.ArrayType(T.IntegerType()))])
#: Longest name of the XDR schema.
NAME = 20


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def to_protobuf(nr: int | None, email: str | None, last: str, first: str, grades: list[int]) -> bytes:
    """SK2: fields 1 (number) or 2 (address) of the union, 3, 4 names, 5 packed grades."""
    text = lambda k, s: _varint(k << 3 | 2) + _varint(len(s.encode())) + s.encode()
    out = _varint(1 << 3) + _varint(nr) if nr is not None else text(2, email) if email is not None else b""
    packed = b"".join(map(_varint, grades))
    return out + text(3, last) + text(4, first) + (_varint(5 << 3 | 2) + _varint(len(packed)) + packed if grades else b"")


def from_protobuf(data: bytes) -> tuple:
    """SC4: absent fields are null, or empty."""
    nr, email, last, first, grades, at = None, None, "", "", [], 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 == 0:
            value, at = _read_varint(data, at)
            if tag >> 3 == 1:
                nr = value
            elif tag >> 3 == 5:
                grades.append(value)
            continue
        size, at = _read_varint(data, at)
        part, at = data[at : at + size], at + size
        if tag >> 3 == 2:
            email = part.decode()
        elif tag >> 3 == 3:
            last = part.decode()
        elif tag >> 3 == 4:
            first = part.decode()
        elif tag >> 3 == 5:
            k = 0
            while k < len(part):
                value, k = _read_varint(part, k)
                grades.append(value)
    return nr, email, last, first, grades


def to_xdr(nr: int | None, email: str | None, last: str, first: str, grades: list[int]) -> bytes:
    """SK3: big-endian units of four bytes: discriminant and arm (2: none), names, counted grades."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    arm = struct.pack(">II", 0, nr) if nr is not None else struct.pack(">I", 1) + text(email) if email is not None else struct.pack(">I", 2)
    return arm + text(last) + text(first) + struct.pack(f">I{len(grades)}I", len(grades), *grades)


def from_xdr(data: bytes) -> tuple:
    """SC5."""
    at = 0

    def uint() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">I", data, at - 4)[0]

    def text() -> str:
        nonlocal at
        n = uint()
        raw = data[at : at + n]
        at += n + -n % 4
        return raw.decode()

    kind = uint()
    nr, email = (uint(), None) if kind == 0 else (None, text()) if kind == 1 else (None, None)
    last, first = text(), text()
    return nr, email, last, first, [uint() for _ in range(uint())]


def _mapped(df: DataFrame, schema: T.StructType, one) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)], columns=schema.names)

    return df.mapInPandas(run, schema)


def encoded_students(students: DataFrame) -> DataFrame:
    """key, protobuf, xdr of students."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("protobuf", T.BinaryType()), T.StructField("xdr", T.BinaryType())])

    def one(r):
        x = (None if r.nr_albumu is None else int(r.nr_albumu), r.email, r.nazwisko[:NAME], r.imie[:NAME], [int(g) for g in r.oceny])
        return int(r.key), to_protobuf(*x), to_xdr(*x)

    return _mapped(students, schema, one)


def decoded_students(records: DataFrame, column: str) -> DataFrame:
    """Students of a column of records; column is protobuf or xdr."""
    read = {"protobuf": from_protobuf, "xdr": from_xdr}[column]
    return _mapped(records.select("key", F.col(column).alias("data")), STUDENT, lambda r: (int(r.key), *read(bytes(r.data))))


def read_records(spark: SparkSession, path: str, column: str) -> DataFrame:
    """SC4, SC5: students of binary files, a record a file; key is a hash of the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return decoded_students(files.select(F.xxhash64("path").alias("key"), F.col("content").alias(column)), column)


def sample_students(docs: DataFrame) -> DataFrame:
    """Students that stand on the documents' ids: even ones have a number, odd ones an address."""
    even = F.col("doc_id") % 2 == 0
    grades = F.transform(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 4), lambda k: F.pmod(F.col("doc_id") + k - 1, F.lit(len(GRADES))).cast("int"))
    return docs.select(F.col("doc_id").alias("key"), F.when(even, F.col("doc_id")).alias("nr_albumu"), F.when(~even, F.concat("lang", F.lit("@x"))).alias("email"), F.col("source").alias("nazwisko"), F.col("lang").alias("imie"), F.when(F.col("doc_id") % 4 > 0, grades).otherwise(F.array().cast("array<int>")).alias("oceny"))


def roundtrip(students: DataFrame) -> DataFrame:
    """doc_id, grades by name, chosen id, and whether both formats give back the record."""
    records = encoded_students(students)
    cols = [c for c in STUDENT.names if c != "key"]
    out = students.select("key", F.struct(*cols).alias("a"))
    for name in ("protobuf", "xdr"):
        out = out.join(decoded_students(records, name).select("key", F.struct(*cols).alias(name)), "key")
    same = F.col("a").eqNullSafe(F.col("protobuf")) & F.col("a").eqNullSafe(F.col("xdr"))
    return out.select(F.col("key").alias("doc_id"), F.array_join(grade_names(F.col("xdr.oceny")), ",").alias("grades"), chosen_id(F.col("protobuf")).alias("id"), same.alias("same"))


SNAPSHOT = "<Bffffhh"


def snapshot_roundtrip(rows: DataFrame) -> DataFrame:
    """SK6, ST12: op and score packed into a snapshot (little-endian: op, four floats, two shorts) and read from it again; op is also the first byte (SC13)."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("packed", T.BinaryType())])
    packed = _mapped(rows, schema, lambda r: (int(r.event_id), struct.pack(SNAPSHOT, int(r.op), 0.5, 0.25, 0.75, 1.0, int(r.left_score), 0)))
    unpacked = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("left_score", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    back = _mapped(packed, unpacked, lambda r: (int(r.event_id), struct.unpack(SNAPSHOT, bytes(r.packed))[5], bytes(r.packed)))
    op = F.conv(F.hex(F.substring("packed", 1, 1)), 16, 10).cast("int")
    return back.select("event_id", op.alias("op"), "left_score", F.length("packed").alias("n_bytes"))


def write_csv(df: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    """SK1 with a header; SK10 appended without one."""
    df.write.mode("append" if append else "overwrite").option("header", header).csv(path)


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    """M18: benchmark rows of a CSV file with a header; the schema is stated, so no pass infers it."""
    return spark.read.csv(path, header=True, schema="producers INT, consumers INT, items_per_producer INT, capacity INT, total_duration_s DOUBLE, ops_per_second DOUBLE, avg_latency_ms DOUBLE")


def write_records(records: DataFrame, column: str, path: str) -> None:
    """SK2, SK3: records as a Parquet column of bytes: written by the executors, read with decoded_students."""
    records.select("key", column).write.mode("overwrite").parquet(path)
