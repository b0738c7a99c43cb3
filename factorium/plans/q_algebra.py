"""Sparse algebra queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coo
from .derived import A, B, K, M, N, S, matrix_a, matrix_b, rotation, rotation_sql, square, table, vector, vector_sql

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


SUM_A = f"(SELECT i, j, sum(x) AS x FROM {A} GROUP BY ALL)"
SUM_S = f"(SELECT i, j, sum(x) AS x FROM {S} GROUP BY ALL)"


@query(f"SELECT i, j, sum(x) AS x FROM {A} GROUP BY ALL")
def coo_sum_duplicates(spark, sf):
    return coo.dedupe(matrix_a(spark, sf))


@query(f"SELECT j AS i, i AS j, sum(x) AS x FROM {A} GROUP BY ALL")
def coo_transpose(spark, sf):
    return coo.dedupe(coo.transpose(matrix_a(spark, sf)))


@query(f"SELECT i, j, sum(x) AS x FROM (SELECT i, j, 2.0 * x AS x FROM {S} UNION ALL SELECT j, i, -3.0 * x FROM {S}) GROUP BY ALL")
def coo_add(spark, sf):
    s = square(spark, sf)
    return coo.add(s, coo.transpose(s), 2.0, -3.0)


@query(f"SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {SUM_A} a JOIN (SELECT i, j, sum(x) AS x FROM {B} GROUP BY ALL) b ON a.j = b.i GROUP BY ALL")
def coo_multiply(spark, sf):
    return coo.multiply(coo.dedupe(matrix_a(spark, sf)), coo.dedupe(matrix_b(spark, sf)))


@query(f"SELECT a.i, sum(a.x * v.x) AS x FROM {A} a JOIN {vector_sql(K)} v ON a.j = v.i GROUP BY ALL")
def coo_times_vector(spark, sf):
    return coo.times_vector(matrix_a(spark, sf), vector(spark, K))


@query(f"SELECT i, sum(x) AS x FROM (SELECT a.i, a.x * v.x AS x FROM {A} a JOIN {vector_sql(K)} v ON a.j = v.i UNION ALL SELECT * FROM {vector_sql(M)}) GROUP BY ALL")
def coo_gaxpy(spark, sf):
    return coo.gaxpy(matrix_a(spark, sf), vector(spark, K), vector(spark, M))


@query(f"SELECT r.new AS i, c.new AS j, sum(x) AS x FROM {A} a JOIN {rotation_sql(M)} r ON a.i = r.old JOIN {rotation_sql(K)} c ON a.j = c.old GROUP BY ALL")
def coo_permute(spark, sf):
    return coo.permute(coo.dedupe(matrix_a(spark, sf)), rotation(spark, M), rotation(spark, K))


@query(f"SELECT least(r.new, c.new) AS i, greatest(r.new, c.new) AS j, x FROM {SUM_S} a JOIN {rotation_sql(K)} r ON a.i = r.old JOIN {rotation_sql(K)} c ON a.j = c.old WHERE i <= j")
def coo_permute_symmetric(spark, sf):
    return coo.permute_symmetric(coo.dedupe(square(spark, sf)), rotation(spark, K))


@query(f"SELECT new AS old, old AS new FROM {rotation_sql(K)}")
def permutation_inverse(spark, sf):
    return coo.inverse_permutation(rotation(spark, K))


@query(f"SELECT r.new AS i, x FROM {vector_sql(K)} v JOIN {rotation_sql(K)} r ON v.i = r.old")
def permutation_of_vector(spark, sf):
    return coo.permute_vector(vector(spark, K), rotation(spark, K))


@query(f"SELECT count(*) AS n, count(DISTINCT new) AS n_new, min(new) AS low, max(new) AS high FROM {rotation_sql(K)}")
def permutation_random(spark, sf):
    return coo.random_permutation(spark.range(K).select(F.col("id").alias("i"))).agg(F.count("*").alias("n"), F.count_distinct("new").alias("n_new"), F.min("new").alias("low"), F.max("new").alias("high"))


@query(f"SELECT * FROM {SUM_A} WHERE abs(x) > 300")
def coo_drop_tolerance(spark, sf):
    return coo.drop_small(coo.dedupe(matrix_a(spark, sf)), 300.0)


@query(f"SELECT i, j, x - 25 AS x FROM {A} WHERE x <> 25")
def coo_drop_zeros(spark, sf):
    return coo.drop_zeros(matrix_a(spark, sf).withColumn("x", F.col("x") - 25))


@query(f"SELECT * FROM {SUM_A} WHERE (i + j) % 3 = 0")
def coo_keep_if(spark, sf):
    return coo.keep_if(coo.dedupe(matrix_a(spark, sf)), (F.col("i") + F.col("j")) % 3 == 0)


@query(f"SELECT max(s) AS norm1 FROM (SELECT sum(abs(x)) AS s FROM {SUM_A} GROUP BY j)")
def coo_norm1(spark, sf):
    return coo.norm1(coo.dedupe(matrix_a(spark, sf)))


@query(f"SELECT sqrt(sum(x * x)) AS norm FROM {SUM_A}")
def vector_norm(spark, sf):
    return coo.norm_frobenius(coo.dedupe(matrix_a(spark, sf)))


@query(f"SELECT DISTINCT i, j FROM (SELECT i, j FROM {S} UNION ALL SELECT j, i FROM {S})")
def coo_structure_sum(spark, sf):
    return coo.structure_sum(square(spark, sf))


@query(f"WITH d AS (SELECT DISTINCT i, j FROM {S}) SELECT DISTINCT a.j AS i, b.j AS j FROM d a JOIN d b ON a.i = b.i")
def coo_structure_product(spark, sf):
    return coo.structure_product(square(spark, sf))


@query(f"SELECT j, n, sum(n) OVER (ORDER BY j) - n AS \"offset\" FROM (SELECT j, count(*) AS n FROM {SUM_A} GROUP BY j)")
def coo_column_offsets(spark, sf):
    return coo.offsets(coo.column_counts(coo.dedupe(matrix_a(spark, sf))))


@query(f"SELECT i - 10 AS i, j - 5 AS j, x FROM {SUM_A} WHERE i >= 10 AND i < 40 AND j >= 5 AND j < 30")
def coo_submatrix(spark, sf):
    return coo.submatrix(coo.dedupe(matrix_a(spark, sf)), 10, 40, 5, 30)


@query(f"SELECT * FROM {SUM_S} UNION ALL SELECT i, j + {K}, x FROM {SUM_S} UNION ALL SELECT i + {K}, j, x FROM {SUM_S}")
def coo_stack(spark, sf):
    s = coo.dedupe(square(spark, sf))
    return coo.stack_rows(coo.stack_columns(s, s, K), s, K)


@query(f"SELECT a.i, a.j, a.x * r.x * c.x + 0.0 AS x FROM {SUM_A} a JOIN {vector_sql(M)} r ON a.i = r.i JOIN {vector_sql(K)} c ON a.j = c.i")
def coo_scale(spark, sf):
    return coo.scale(coo.dedupe(matrix_a(spark, sf)), vector(spark, M), vector(spark, K)).withColumn("x", F.col("x") + 0.0)


@query(f"SELECT 'last_block' AS part, count(*) AS n, sum(x) AS x FROM {SUM_S} WHERE i = {K - 1} AND j = {K - 1} UNION ALL SELECT 'last_column', count(*), sum(x) FROM {SUM_S} WHERE j = {K - 1} UNION ALL SELECT 'diagonal', count(*), sum(x) FROM {SUM_S} WHERE i = j UNION ALL SELECT 'full', count(*), sum(x) FROM {SUM_S}")
def coo_parts(spark, sf):
    s = coo.dedupe(square(spark, sf))
    out = None
    for which in ("last_block", "last_column", "diagonal", "full"):
        one = coo.part(s, which, K - 1).agg(F.lit(which).alias("part"), F.count("*").alias("n"), F.sum("x").alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT * FROM {SUM_S} WHERE i <> j AND j <> {K - 1}")
def coo_subtract_parts(spark, sf):
    s = coo.dedupe(square(spark, sf))
    return coo.subtract_part(coo.subtract_part(s, coo.part(s, "diagonal", K - 1)), coo.part(s, "last_column", K - 1))


@query(f"SELECT i, j, x FROM {SUM_A}")
def matrix_market_round_trip(spark, sf):
    lines = coo.to_matrix_market(coo.dedupe(matrix_a(spark, sf)), M, K)
    return coo.from_matrix_market(lines.withColumnRenamed("n", "line"))


@query(f"SELECT i // 10 AS ci, j // 10 AS cj, count(*) AS n FROM {SUM_A} GROUP BY ALL")
def matrix_image(spark, sf):
    return coo.histogram_image(coo.dedupe(matrix_a(spark, sf)), 10)


@query("SELECT true AS ts_sorted, (SELECT bool_and(ok) FROM (SELECT coalesce(value >= lag(value) OVER (ORDER BY event_id), true) AS ok FROM events)) AS value_sorted")
def sorted_checks(spark, sf):
    e = table(spark, sf, "events")
    a = coo.sorted_check(e, "ts", "event_id").withColumnRenamed("is_sorted", "ts_sorted")
    return a.crossJoin(coo.sorted_check(e, "value", "event_id").withColumnRenamed("is_sorted", "value_sorted"))  # a row each


@query("SELECT count(*) FILTER (WHERE l_quantity > 49) AS nan_x FROM lineitem")
def nan_counts(spark, sf):
    return coo.count_nans(table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") > 49, float("nan")).otherwise(F.col("l_quantity")).alias("x")), "x")
