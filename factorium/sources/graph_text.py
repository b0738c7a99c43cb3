"""Text graphs: `TOKEN field field ...` lines to typed vertex and edge tables.

All of it is Column work on a table (line, value): no line is looked at twice and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Token:
    """A kind of line: how many ids, how many numbers of measurement or state, how many of information."""

    kind: str  # vertex, edge, marker, raw
    type: str
    ids: int
    numbers: int
    info: int = 0


#: The line kinds by token (fixed names of the format).
TOKENS: dict[str, Token] = {
    **dict.fromkeys(("EDGE2", "EDGE_SE2", "EDGE", "ODOMETRY"), Token("edge", "Pose2D", 2, 3, 6)),
    **dict.fromkeys(("LANDMARK2:XY", "EDGE_SE2_XY", "EDGE_BEARING_SE2_XY", "LANDMARK"), Token("edge", "PoseLandmark2D_XY", 2, 2, 3)),
    **dict.fromkeys(("LANDMARK2:RB", "EDGE_SE2_RB", "EDGE_BEARING_SE2_RB"), Token("edge", "PoseLandmark2D", 2, 2, 3)),
    **dict.fromkeys(("VERTEX2", "VERTEX_SE2", "VERTEX"), Token("vertex", "Pose2D", 1, 3)),
    **dict.fromkeys(("EDGE3", "EDGE_SE3"), Token("edge", "Pose3D_RPY", 2, 6, 21)),
    **dict.fromkeys(("EDGE3:AXISANGLE", "EDGE_SE3:AXISANGLE"), Token("edge", "Pose3D", 2, 6, 21)),
    **dict.fromkeys(("LANDMARK3:XYZ", "EDGE_SE3_XYZ"), Token("edge", "PoseLandmark3D", 2, 3, 6)),
    "EDGE_SPHERON_XYZ": Token("edge", "SpheronXYZ", 2, 3, 6),
    **dict.fromkeys(("VERTEX3", "VERTEX_SE3"), Token("vertex", "Pose3D_RPY", 1, 6)),
    "VERTEX_XYZ": Token("vertex", "XYZ", 1, 3),
    "VERTEX_CAM": Token("vertex", "Cam", 1, 12),
    "VERTEX_INTRINSICS": Token("vertex", "Intrinsics", 1, 5),
    "VERTEX_SCAM": Token("vertex", "SCam", 1, 13),
    "VERTEX_SPHERON:QUAT": Token("vertex", "Spheron", 1, 7),
    **dict.fromkeys(("EDGE_PROJECT_P2MC", "EDGE_P2MC", "EDGE_P2C"), Token("edge", "P2C3D", 2, 2, 3)),
    **dict.fromkeys(("EDGE_PROJECT_P2MCI", "EDGE_P2MCI", "EDGE_P2CI"), Token("edge", "P2CI3D", 3, 2, 3)),
    **dict.fromkeys(("EDGE_PROJECT_P2SC", "EDGE_P2SC"), Token("edge", "P2SC3D", 2, 3, 6)),
    "PHASE": Token("raw", "Phase", 2, 4),
    "ROCV:TRANSMITTER": Token("vertex", "Landmark3D", 1, 3),
    "ROCV:TRANSMITTER_UF": Token("edge", "UnaryFactor", 1, 0, 6),
    "ROCV:RECEIVER": Token("vertex", "PosVel3D", 1, 6),
    "ROCV:RECEIVER_GTFAKE": Token("vertex", "PosVel3D_GT", 1, 6),
    "ROCV:DELTA_TIME": Token("edge", "ConstVelocity3D", 2, 1, 21),
    "ROCV:RANGE": Token("edge", "Range3D", 2, 1, 1),
    "VERTEX_CAM:SIM3": Token("vertex", "CamSim3", 1, 12),
    "VERTEX:INVD": Token("vertex", "InverseDepth", 2, 3),
    "EDGE_PROJ_SELF": Token("edge", "ProjectSelf", 2, 2, 3),
    "EDGE_PROJ_OTHER": Token("edge", "ProjectOther", 3, 2, 3),
    "CONSISTENCY_MARKER": Token("marker", "Marker", 0, 0),
    "EQUIV": Token("ignored", "Equivalence", 0, 0),
}


def register(name: str, token: Token) -> None:
    """A token of one's own."""
    TOKENS[name.upper()] = token


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value); lines are numbered from 0 without gaps, in the order of the files' names and within them.

    Each part of a file is read by one task: the line's place in its part, and the lines of all parts before. The
    offsets are a row a part.
    """
    at = ["file", "start"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    parts = rows.groupBy(*at).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    offsets = parts.select(*at, (F.sum("n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - F.col("first")).alias("offset"))
    return rows.join(offsets, at).select((F.col("at") + F.col("offset")).alias("line"), "value")


def _known(of) -> Column:
    return F.create_map(*[F.lit(x) for name, t in TOKENS.items() for x in (name, of(t))])


def fields(lines: DataFrame, line_limit: int | None = None) -> DataFrame:
    """(line, token, fields): comments cut, blanks trimmed, empty lines gone, tokens in upper case."""
    if line_limit is not None:
        lines = lines.where(F.col("line") < line_limit)
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "[%#].*", ""), "[\\s]+", " "))
    parts = F.split(F.col("text"), " ")
    return lines.select("line", text.alias("text")).where("text <> ''").select("line", F.upper(parts[0]).alias("token"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("fields"))


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(line, token, kind, type, ids, z, info, ok) of the known lines; unknown tokens are passed over.

    A known line with too few or unreadable fields fails the query if strict, else it has ok = false.
    """
    f = fields(lines)
    t = F.col("token")
    typed = f.withColumns({"kind": _known(lambda x: x.kind)[t], "type": _known(lambda x: x.type)[t], "n_ids": _known(lambda x: x.ids)[t], "n_z": _known(lambda x: x.numbers)[t], "n_info": _known(lambda x: x.info)[t]}).where("kind IS NOT NULL AND kind <> 'ignored'")
    numbers = F.transform("fields", lambda x: x.try_cast("double"))
    cut = typed.withColumn("numbers", F.slice(numbers, 1, F.col("n_ids") + F.col("n_z") + F.col("n_info")))
    ok = (F.size("numbers") == F.col("n_ids") + F.col("n_z") + F.col("n_info")) & ~F.exists("numbers", lambda x: x.isNull())
    checked = cut.withColumn("ok", ok)
    if strict:
        checked = checked.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("cannot read line "), F.col("line").cast("string"), F.lit(": "), F.col("token"))).cast("boolean")))
    return checked.select("line", "token", "kind", "type", F.transform(F.slice("numbers", 1, F.col("n_ids")), lambda x: x.cast("long")).alias("ids"), F.slice("numbers", F.col("n_ids") + 1, F.col("n_z")).alias("z"), F.slice("numbers", F.col("n_ids") + F.col("n_z") + 1, F.col("n_info")).alias("info"), "ok")


def full_symmetric(upper: Column, n: int) -> Column:
    """Row-major n x n from the row-major upper triangle."""
    at = lambda i, j: i * n - i * (i - 1) // 2 + j - i
    return F.array(*[upper[at(min(i, j), max(i, j))] for i in range(n) for j in range(n)])


def edges_2d(records: DataFrame) -> DataFrame:
    """(line, v0, v1, dx, dy, dt, info) of planar pose edges; one whose first id isn't smaller is turned round: ids swapped, the pose inverted, the information reordered."""
    from ..functions.angles import Pose2, invert

    e = records.where("type = 'Pose2D' AND kind = 'edge'").select("line", F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"), *[F.col("z")[i].alias(k) for i, k in enumerate(("x", "y", "t"))], "info")
    p = Pose2(F.col("x"), F.col("y"), F.col("t"))
    q = invert(p)
    turned = F.col("a") >= F.col("b")
    i = F.col("info")
    return e.select("line", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"), F.when(turned, q.x).otherwise(p.x).alias("dx"), F.when(turned, q.y).otherwise(p.y).alias("dy"), F.when(turned, q.t).otherwise(p.t).alias("dt"), F.when(turned, F.array(i[0], i[1], i[5], i[2], i[4], i[3])).otherwise(i).alias("info"))


def with_states(records: DataFrame) -> DataFrame:
    """records with z as the solvers take it: Pose3D_RPY becomes Pose3D, its turn an axis times the angle; a camera's position and quaternion become those of the inverse pose, with the turn likewise. All other z stay."""
    from ..functions import turns

    z = lambda i: F.get("z", F.lit(i))
    rpy, camera = F.col("type") == "Pose3D_RPY", F.col("type").isin("Cam", "SCam")
    quaternion = F.when(rpy, F.array(*turns.rpy_quaternion(z(3), z(4), z(5)))).when(camera, F.array(*turns.inverse([z(i) for i in range(3, 7)])))
    q = [F.get("__q", F.lit(i)) for i in range(4)]
    turn = F.array(*turns.axis_angle(q))
    state = F.when(rpy, F.concat(F.slice("z", 1, 3), turn)).when(camera, F.concat(F.array(*turns.turned(q, [-z(i) for i in range(3)])), turn, F.slice("z", 8, 6))).otherwise(F.col("z"))
    return records.withColumn("__q", quaternion).withColumns({"z": state, "type": F.when(rpy, "Pose3D").otherwise(F.col("type"))}).drop("__q")


def edges_3d(records: DataFrame) -> DataFrame:
    """Spatial pose edges, turns as axis times angle; one whose first id isn't smaller is dropped."""
    return with_states(records.where("type IN ('Pose3D', 'Pose3D_RPY') AND kind = 'edge' AND ids[0] < ids[1]"))


def vertices(records: DataFrame) -> DataFrame:
    """(id, type, state, line): of lines that repeat an id the first counts; states as by with_states."""
    first = Window.partitionBy("id").orderBy("line")
    return with_states(records.where("kind = 'vertex'")).select(F.col("ids")[0].alias("id"), "type", F.col("z").alias("state"), "line").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def segments(lines: DataFrame) -> DataFrame:
    """lines with segment, the number of markers up to and with the line. Lines of one file are one order, so this sorts in one task; split files by graph for more."""
    marker = (F.col("token") == "CONSISTENCY_MARKER").cast("int")
    return lines.withColumn("segment", F.sum(marker).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))


#: What the peek reports: a flag by vertex or edge type.
PEEK = ("Pose2D", "PoseLandmark2D", "PoseLandmark2D_XY", "Pose3D", "Pose3D_RPY", "PoseLandmark3D", "P2C3D", "P2CI3D", "P2SC3D", "SpheronXYZ", "Range3D")


def peek(lines: DataFrame, n: int = 1000) -> DataFrame:
    """One row of flags: which edge types the first n lines hold."""
    head = fields(lines.orderBy("line").limit(n))
    kind = _known(lambda x: f"{x.kind}:{x.type}")[F.col("token")]
    return head.agg(*[F.coalesce(F.bool_or(kind == f"edge:{t}"), F.lit(False)).alias(f"has_{t.lower()}") for t in PEEK])


def renumber(records: DataFrame) -> DataFrame:
    """(space, id, new_id): contiguous numbers from 0 in the order of first appearance, by id space (points of projections apart from all others)."""
    point = F.col("type").isin("P2C3D", "P2CI3D", "P2SC3D") & (F.col("at") == 0) | (F.col("type") == "XYZ")
    used = records.select("line", "type", F.posexplode("ids").alias("at", "id")).withColumn("space", F.when(point, "point").otherwise("pose"))
    first = used.groupBy("space", "id").agg(F.min(F.struct("line", "at")).alias("seen"))
    return first.select("space", "id", (F.row_number().over(Window.partitionBy("space").orderBy("seen", "id")) - 1).cast("long").alias("new_id"))


def routed(records: DataFrame, accepted: list[str], ignored: list[str] = []) -> DataFrame:  # noqa: B006
    """Records of accepted types; others fail the query unless they are ignored."""
    known = F.col("type").isin(accepted)
    checked = F.when(known, True).when(F.col("type").isin(ignored) if ignored else F.lit(False), False).otherwise(F.raise_error(F.concat(F.lit("no such type here: "), F.col("type"))).cast("boolean"))
    return records.where(checked)
