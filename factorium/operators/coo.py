"""Sparse matrices as coordinate tables (i, j, x). Every operation is a join, a filter or a grouped sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dedupe(m: DataFrame) -> DataFrame:
    """Entries of one place are summed."""
    return m.groupBy("i", "j").agg(F.sum("x").alias("x"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    return dedupe(a.select("i", "j", (F.col("x") * alpha).alias("x")).unionByName(b.select("i", "j", (F.col("x") * beta).alias("x"))))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: a joined with b on the inner index, summed by place; map-side sums come before the shuffle."""
    left = a.select("i", F.col("j").alias("k"), F.col("x").alias("xa"))
    right = b.select(F.col("i").alias("k"), "j", F.col("x").alias("xb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


def times_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """(i, x) of the product with the vector (i, x)."""
    return m.join(v.select(F.col("i").alias("j"), F.col("x").alias("xv")), "j").groupBy("i").agg(F.sum(F.col("x") * F.col("xv")).alias("x"))


def gaxpy(m: DataFrame, v: DataFrame, y: DataFrame) -> DataFrame:
    """(i, x) of y + m v."""
    return times_vector(m, v).unionByName(y.select("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))


def permute(m: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Rows and columns renamed by tables (old, new)."""
    out = m
    if rows is not None:
        out = out.join(rows.select(F.col("old").alias("i"), F.col("new").alias("__new")), "i").select(F.col("__new").alias("i"), "j", "x")
    if columns is not None:
        out = out.join(columns.select(F.col("old").alias("j"), F.col("new").alias("__new")), "j").select("i", F.col("__new").alias("j"), "x")
    return out


def upper(m: DataFrame) -> DataFrame:
    return m.where("i <= j")


def lower(m: DataFrame) -> DataFrame:
    return m.where("i >= j")


def permute_symmetric(m: DataFrame, order: DataFrame) -> DataFrame:
    """The upper triangle of P A P' of a matrix given by its upper triangle."""
    p = permute(upper(m), order, order)
    return p.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "x")


def inverse_permutation(order: DataFrame) -> DataFrame:
    return order.select(F.col("new").alias("old"), F.col("old").alias("new"))


def permute_vector(v: DataFrame, order: DataFrame) -> DataFrame:
    return v.join(order.select(F.col("old").alias("i"), "new"), "i").select(F.col("new").alias("i"), "x")


def random_permutation(n: DataFrame, seed: int = 1) -> DataFrame:
    """(old, new) for the indices of n(i): by hash, so that it repeats."""
    return n.select(F.col("i").alias("old"), (F.row_number().over(Window.orderBy(F.xxhash64("i", F.lit(seed)), "i")) - 1).cast("long").alias("new"))


def drop_small(m: DataFrame, tolerance: float) -> DataFrame:
    return m.where(F.abs("x") > tolerance)


def drop_zeros(m: DataFrame) -> DataFrame:
    return m.where("x <> 0")


def keep_if(m: DataFrame, predicate: Column) -> DataFrame:
    return m.where(predicate)


def norm1(m: DataFrame) -> DataFrame:
    """One row: the largest column sum of sizes."""
    return m.groupBy("j").agg(F.sum(F.abs("x")).alias("s")).agg(F.max("s").alias("norm1"))


def norm_frobenius(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))


def structure_sum(m: DataFrame) -> DataFrame:
    """Places of A + A'."""
    return m.select("i", "j").unionByName(transpose(m).select("i", "j")).distinct()


def structure_product(m: DataFrame) -> DataFrame:
    """Places of A'A: pairs of columns that share a row."""
    a = m.select("i", "j").distinct()
    return a.join(a.select("i", F.col("j").alias("j2")), "i").select(F.col("j").alias("i"), F.col("j2").alias("j")).distinct()


def column_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.count("*").alias("n"))


def offsets(counts: DataFrame, key: str = "j", n: str = "n") -> DataFrame:
    """Running sums before each key: dimensions to offsets. One row a vertex goes through one task."""
    running = F.sum(n).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(key, n, (running - F.col(n)).alias("offset"))


def submatrix(m: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Rows [i0, i1) and columns [j0, j1), counted from 0."""
    return m.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1)).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "x")


def stack_columns(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """b to the right of a."""
    return a.unionByName(b.select("i", (F.col("j") + width).alias("j"), "x"))


def stack_rows(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    return a.unionByName(b.select((F.col("i") + height).alias("i"), "j", "x"))


def scale(m: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Rows and columns times the entries of vectors (i, x)."""
    out = m
    if rows is not None:
        out = out.join(rows.select("i", F.col("x").alias("__s")), "i").select("i", "j", (F.col("x") * F.col("__s")).alias("x"))
    if columns is not None:
        out = out.join(columns.select(F.col("i").alias("j"), F.col("x").alias("__s")), "j").select("i", "j", (F.col("x") * F.col("__s")).alias("x"))
    return out


def part(m: DataFrame, which: str, last: int) -> DataFrame:
    """last_block, column (last), diagonal or full of a square matrix whose last index is `last`."""
    if which == "last_block":
        return m.where((F.col("i") == last) & (F.col("j") == last))
    if which == "last_column":
        return m.where(F.col("j") == last)
    if which == "diagonal":
        return m.where("i = j")
    return m


def subtract_part(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of a whose place isn't in b."""
    return a.join(b.select("i", "j").distinct(), ["i", "j"], "left_anti")


def sorted_check(v: DataFrame, key: str, order: str, strict: bool = False) -> DataFrame:
    """One row: whether v is sorted by key in the given order. Neighbours meet in one task."""
    before = F.lag(key).over(Window.orderBy(order))
    bad = (before >= F.col(key)) if strict else (before > F.col(key))
    return v.select(bad.alias("bad")).agg((~F.coalesce(F.bool_or("bad"), F.lit(False))).alias("is_sorted"))


def count_nans(v: DataFrame, *columns: str) -> DataFrame:
    return v.agg(*[F.count_if(F.isnan(c)).alias(f"nan_{c}") for c in columns])


def to_matrix_market(m: DataFrame, rows: int, columns: int) -> DataFrame:
    """Lines (n, value) of the coordinate format, one-based, column by column; n orders them."""
    body = m.select((F.col("j") * rows + F.col("i") + 2).alias("n"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("x").cast("string")).alias("value"))
    head = m.agg(F.count("*").alias("c")).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value")), F.struct(F.lit(1).cast("long").alias("n"), F.concat(F.lit(f"{rows} {columns} "), F.col("c").cast("string")).alias("value")))).alias("x")).select("x.n", "x.value")
    return head.unionByName(body)


def from_matrix_market(lines: DataFrame) -> DataFrame:
    """(i, j, x) from lines (line, value): comments and the size line are passed over; a symmetric file gives both triangles; a pattern file ones."""
    text = lines.withColumn("value", F.trim(F.regexp_replace("value", "\\s+", " ")))
    banner = text.where("value LIKE '\\%\\%%'").agg(F.coalesce(F.bool_or(F.lower("value").contains("symmetric")), F.lit(False)).alias("symmetric"))
    data = text.where("value <> '' AND value NOT LIKE '\\%%'")
    size = data.agg(F.min("line").alias("size_line"))
    entries = data.crossJoin(F.broadcast(size)).where("line > size_line").crossJoin(F.broadcast(banner))  # one row each
    p = F.split("value", " ")
    e = entries.select((p[0].cast("long") - 1).alias("i"), (p[1].cast("long") - 1).alias("j"), F.when(F.size(p) > 2, F.try_element_at(p, F.lit(3)).cast("double")).otherwise(1.0).alias("x"), "symmetric")
    return e.select("i", "j", "x").unionByName(e.where("symmetric AND i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "x"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", " ").schema("i long, j long, x double").csv(path)


def histogram_image(m: DataFrame, cell: int) -> DataFrame:
    """The subsampled picture of a matrix: entries by cell."""
    return m.groupBy(F.floor(F.col("i") / cell).alias("ci"), F.floor(F.col("j") / cell).alias("cj")).agg(F.count("*").alias("n"))
