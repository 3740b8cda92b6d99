"""Scalar functions: strings, numbers, bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299_792_458.0


def interfaces(text: Column) -> Column:
    """ST2: names after 'Interface'."""
    return F.regexp_extract_all(text, F.lit(r"Interface\s+(\w+)"), F.lit(1))


def tx_power(text: Column, default: str = "unknown") -> Column:
    """ST3: the power with its unit, or default."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"txpower\s+([\d\.]+\s+dBm)", 1), F.lit("")), F.lit(default))


def words_with_prefix(text: Column, prefix: str, n: int) -> Column:
    """ST4: first n words that start with prefix."""
    return F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.startswith(w, F.lit(prefix))), 1, n)


def joined_or(args: Column, default: str) -> Column:
    """ST5: arguments joined by a space, or default where there are none."""
    return F.coalesce(F.nullif(F.array_join(args, " "), F.lit("")), F.lit(default))


def utf8(body: Column) -> Column:
    """ST6."""
    return F.decode(body, "UTF-8")


def reversed_bits(n: Column, width: int) -> Column:
    """ST8: binary digits, padded with zeros, last one first."""
    return F.reverse(F.lpad(F.bin(n), width, "0"))


def line_fields(df: DataFrame, text: str, key: str) -> DataFrame:
    """ST13: a row for each line of a listing that has a known prefix: line number, field, value (a number's leading digits for signal)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    found = lines.withColumns({"interface": F.regexp_extract("line", r"Interface (\S+)", 1), "driver": F.regexp_extract("line", r"driver: *(\S+)", 1), "signal": F.regexp_extract("line", r"signal: *(-?\d+)", 1)})
    field = F.when(F.col("interface") != "", "interface").when(F.col("driver") != "", "driver").when(F.col("signal") != "", "signal")
    return found.select(key, "line_no", field.alias("field"), F.concat("interface", "driver", "signal").alias("value")).where("field IS NOT NULL")


def annualised(gain: Column, years: Column) -> Column:
    """MA1: yearly percentage of a total gain in per cent."""
    return (F.pow(1 + gain / 100, 1 / years) - 1) * 100


def doppler(period: Column, beta: Column) -> Column:
    """MA2."""
    return period * F.sqrt((1 + beta) / (1 - beta))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """MA15: i and x, n points with both ends."""
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * ((stop - start) / (n - 1))).alias("x"))


def mw_to_dbm(mw: Column) -> Column:
    """MA3: truncated towards zero; null for what has no logarithm."""
    return F.when(mw > 0, (10 * F.log10(mw)).cast("int"))


def rssi_to_dbm(level: Column) -> Column:
    """MA4: levels from 64 up are counted from 256, others from 100."""
    return F.when(level >= 64, level - 256).otherwise(level - 100)


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """MA5: n and F(n) from 0, exact up to n = 183; each row folds its own pair, so rows need no order."""
    big = "DECIMAL(38,0)"
    start = F.struct(F.lit(0).cast(big).alias("a"), F.lit(1).cast(big).alias("b"))
    steps = F.when(F.col("id") > 1, F.sequence(F.lit(2).cast("long"), F.col("id"))).otherwise(F.array().cast("array<bigint>"))
    pair = F.aggregate(steps, start, lambda p, _: F.struct(p["b"].alias("a"), (p["a"] + p["b"]).cast(big).alias("b")))
    return spark.range(n + 1).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") == 0, F.lit(0).cast(big)).otherwise(pair["b"]).alias("fib"))


def power_by_squaring(base: Column, exponent: int) -> Column:
    """MA6: integer power by repeated squaring; null beyond 64 bits."""
    out, square = F.lit(1).cast("long"), base.cast("long")
    while exponent:
        if exponent & 1:
            out = F.try_multiply(out, square)
        exponent >>= 1
        square = F.try_multiply(square, square) if exponent else square
    return out


def calculate(op: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """MA7: result (null on error) and error (null if none) of add, subtract, multiply, divide, power."""
    result = F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).when(op == "divide", F.try_divide(a, b)).when(op == "power", F.pow(a, b))
    error = F.when((op == "divide") & (b == 0), "division by zero").when(~F.coalesce(op.isin("add", "subtract", "multiply", "divide", "power"), F.lit(False)), "unknown operation")
    return result, error


def parity_sign(state: Column, mask: Column) -> Column:
    """MA8: 1 where state and mask share an even number of bits, else -1."""
    return 1 - 2 * F.pmod(F.bit_count(state.bitwiseAND(mask)), F.lit(2))


def bit_of(n: Column, k: Column | int) -> Column:
    """MA9."""
    return F.call_function("shiftright", n, F.lit(k) if isinstance(k, int) else k).bitwiseAND(F.lit(1))


def metropolis(beta: Column | float, spin: Column, field: Column) -> Column:
    """MA10: weight of a flip, exp(beta * 2 * s * E)."""
    return F.exp(F.lit(beta) * 2 * spin * field)


def register_sizes(n: Column, eps: float) -> tuple[Column, Column]:
    """MA11: qubits of the number and of the phase."""
    size = F.ceil(F.log2(n))
    return size, 2 * size + 1 + F.ceil(F.log2(F.lit(2 + 1 / (2 * eps))))


def modular_times(x: Column, i: Column, n: Column) -> Column:
    """MA12."""
    return F.pmod(x * i, n)


def memory_target(mb: Column) -> Column:
    """MA13: log2 of the complex numbers that fit."""
    return F.log2(mb * (1 << 20) / 16)


def transfer_matrix(beta_j: Column) -> Column:
    """MA16: entries of the matrix with cosh on the diagonal and sinh beside it."""
    return F.array(F.array(F.cosh(beta_j), F.sinh(beta_j)), F.array(F.sinh(beta_j), F.cosh(beta_j)))


def formatted(seconds: Column) -> tuple[Column, Column]:
    """Date and time of Unix seconds, and the ISO form."""
    at = F.timestamp_seconds(seconds)
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
