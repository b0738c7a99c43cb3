"""Text sinks: states, graphs, matrices; and the readers of two reconstruction formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_lines(states: DataFrame) -> DataFrame:
    """(token, id, value): a line a vertex from (id, token, state)."""
    return states.select("token", "id", F.concat_ws(" ", "token", F.col("id").cast("string"), F.transform("state", lambda x: x.cast("string"))).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(eid, value): a line an edge from (eid, token, ids, z, info)."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    return edges.select("eid", F.concat_ws(" ", "token", text("ids"), text("z"), text("info")).alias("value"))


def write_states(states: DataFrame, path: str) -> None:
    """By id, in ranges, so that files follow each other."""
    state_lines(states).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def write_graph(states: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices, then edges."""
    state_lines(states).sortWithinPartitions("id").select("value").write.text(path)
    edge_lines(edges).sortWithinPartitions("eid").select("value").write.mode("append").text(path)


def write_matrix(m: DataFrame, rows: int, columns: int, path: str) -> None:
    from ..operators.coo import to_matrix_market

    to_matrix_market(m, rows, columns).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)


def block_layout(dims: list[int]) -> str:
    """The layout file beside a block matrix: where blocks begin."""
    ends = [0]
    for d in dims:
        ends.append(ends[-1] + d)
    return f"{ends[-1]} {len(dims)}\n" + " ".join(map(str, ends)) + "\n"


def matlab_vector(name: str, x: list[float]) -> str:
    return f"{name} = [" + " ".join(f"{v:.10g}" for v in x) + "];"


def matlab_matrix(name: str, m: list[list[float]]) -> str:
    return f"{name} = [" + "; ".join(" ".join(f"{v:.10g}" for v in row) for row in m) + "];"


def matlab_sparse(m: DataFrame, name: str, rows: int, columns: int) -> DataFrame:
    """(n, value): lines that fill a sparse matrix."""
    return m.select((F.col("j") * rows + F.col("i")).alias("n"), F.concat(F.lit(f"{name}("), F.concat_ws(",", F.col("i") + 1, F.col("j") + 1), F.lit(") = "), F.col("x").cast("string"), F.lit(";")).alias("value"))


_OBSERVED = "file string, kind string, id long, cam long, values array<double>"


def _bundler(content: str) -> Iterator[tuple]:
    words = [w for line in content.splitlines() if not line.lstrip().startswith("#") for w in line.split()]
    at = 0

    def take(n: int) -> list[float]:
        nonlocal at
        out = [float(w) for w in words[at : at + n]]
        if len(out) < n:
            raise ValueError("the reconstruction ends early")
        at += n
        return out

    cams, points = map(int, take(2))
    for c in range(cams):
        yield "camera", c, None, take(15)  # f, k1, k2, rotation, translation
    for p in range(points):
        xyz, _ = take(3), take(3)
        yield "point", p, None, xyz
        for _ in range(int(take(1)[0])):
            cam, _, u, v = take(4)
            yield "observation", p, int(cam), [u, v]


def _nvm(content: str) -> Iterator[tuple]:
    lines = iter([x for x in content.splitlines() if x.strip()])
    if not next(lines).startswith("NVM_V3"):
        raise ValueError("not an NVM_V3 file")
    for c in range(int(next(lines))):
        yield "camera", c, None, [float(w) for w in next(lines).split()[1:]]  # f, quaternion, centre, distortion
    for p in range(int(next(lines, "0"))):
        w = next(lines).split()
        yield "point", p, None, [float(x) for x in w[:3]]
        for i in range(int(w[6])):
            cam, _, u, v = w[7 + 4 * i : 11 + 4 * i]
            yield "observation", p, int(cam), [float(u), float(v)]


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches):
        for b in batches:
            for file, text in zip(b["file"], b["value"]):
                rows = [(file, *r) for r in parse(text)]
                yield pd.DataFrame(rows, columns=["file", "kind", "id", "cam", "values"]).astype({"cam": "Int64"})

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, _OBSERVED)


def read_bundler(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, id, cam, values) of `.out` reconstructions: camera, point and observation rows. A file is one record."""
    return _read(spark, path, _bundler)


def read_nvm(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _nvm)


def read_poses(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    """(idx, p): 3 or 6 numbers a line, as they are or inverted."""
    import numpy as np

    from ..functions.spatial import inverse

    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), F.split(F.trim("value"), "\\s+").cast("array<double>").alias("p")).where(F.size("p").isin(3, 6))
    if not invert:
        return lines

    def run(batches):
        for b in batches:
            yield b.assign(p=[list(map(float, inverse(np.array(p)) if len(p) == 6 else -np.array(p))) for p in b["p"]])

    return lines.mapInPandas(run, "idx long, p array<double>")
