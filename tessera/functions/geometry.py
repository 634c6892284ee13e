"""Plane geometry as column functions: homographies, angles, quads, boxes. A point is a struct (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.alias("x") if isinstance(x, Column) else F.lit(x).alias("x"), y.alias("y") if isinstance(y, Column) else F.lit(y).alias("y"))


def project(h: Column, x: Column, y: Column) -> Column:
    """the point's image under a 3x3 matrix (array of rows); null where it goes to infinity."""
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    return F.when(F.abs(w) > 1e-12, point((h[0][0] * x + h[0][1] * y + h[0][2]) / w, (h[1][0] * x + h[1][1] * y + h[1][2]) / w))


def invert(h: Column) -> Column:
    """inverse of a 3x3 matrix by its adjugate; null if it has none."""
    c = lambda i, j: h[(i + 1) % 3][(j + 1) % 3] * h[(i + 2) % 3][(j + 2) % 3] - h[(i + 1) % 3][(j + 2) % 3] * h[(i + 2) % 3][(j + 1) % 3]
    det = h[0][0] * c(0, 0) + h[0][1] * c(0, 1) + h[0][2] * c(0, 2)
    return F.when(F.abs(det) > 1e-15, F.array(*[F.array(*[c(j, i) / det for j in range(3)]) for i in range(3)]))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def angle_at(a: Column, b: Column, c: Column) -> Column:
    """angle a-b-c in degrees; null if a side has no length."""
    na, nc = distance(a, b), distance(c, b)
    dot = (a["x"] - b["x"]) * (c["x"] - b["x"]) + (a["y"] - b["y"]) * (c["y"] - b["y"])
    return F.when((na > 1e-9) & (nc > 1e-9), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / (na * nc))))))


def direction(a: Column, b: Column) -> Column:
    """direction from a to b in degrees."""
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def wrap_line_angle(degrees: Column) -> Column:
    """the same line's angle in [-90, 90)."""
    return F.pmod(degrees + 90, F.lit(180.0)) - 90


def area(quad: Column) -> Column:
    """area of a polygon (array of points) by the shoelace formula."""
    n = F.size(quad)
    terms = F.transform(quad, lambda p, i: p["x"] * F.element_at(quad, ((i + 1) % n + 1).cast("int"))["y"] - F.element_at(quad, ((i + 1) % n + 1).cast("int"))["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def centroid(quad: Column) -> Column:
    """mean of the corners."""
    total = F.aggregate(quad, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    return point(total["x"] / F.size(quad), total["y"] / F.size(quad))


#: The eight orders of a quad's corners that keep neighbours together.
QUAD_ORDERS = [tuple((s + d * i) % 4 for i in range(4)) for d in (1, -1) for s in range(4)]


def align_corners(quad: Column, to: Column) -> Column:
    """the corners in that of the eight orders that lies nearest to ``to`` (sum of squares, first of equals)."""
    def off(order: tuple[int, ...]) -> Column:
        return sum(((quad[o]["x"] - to[i]["x"]) ** 2 + (quad[o]["y"] - to[i]["y"]) ** 2 for i, o in enumerate(order)), F.lit(0.0))

    tried = F.array(*[F.struct(off(o).alias("off"), F.lit(k).alias("k")) for k, o in enumerate(QUAD_ORDERS)])
    best = F.array_min(tried)["k"]
    orders = F.array(*[F.array(*[F.lit(i) for i in o]) for o in QUAD_ORDERS])
    return F.transform(orders[best], lambda i: quad[i])


def order_along_long_edges(quad: Column) -> Column:
    """corners turned by one if edges 0 and 2 are together shorter than edges 1 and 3."""
    edge = lambda i: distance(quad[i], quad[(i + 1) % 4])
    return F.when(edge(0) + edge(2) >= edge(1) + edge(3), quad).otherwise(F.array(*[quad[(i + 1) % 4] for i in range(4)]))


def in_quad(quad: Column, u: Column, v: Column) -> Column:
    """the bilinear point at (u, v) of a quad."""
    mix = lambda k: (1 - u) * (1 - v) * quad[0][k] + u * (1 - v) * quad[1][k] + u * v * quad[2][k] + (1 - u) * v * quad[3][k]
    return point(mix("x"), mix("y"))


def along_edge(p: Column, start: Column, end: Column) -> Column:
    """F16: share of the way from start to end at which p projects, to 5 places."""
    ex, ey = end["x"] - start["x"], end["y"] - start["y"]
    length = ex * ex + ey * ey
    return F.when(length > 1e-12, F.round(((p["x"] - start["x"]) * ex + (p["y"] - start["y"]) * ey) / length, 5))


def to_box(p: Column, box: Column) -> Column:
    """a point relative to a box (x0, y0, x1, y1)."""
    return point((p["x"] - box["x0"]) / F.greatest(box["x1"] - box["x0"], F.lit(1e-6)), (p["y"] - box["y0"]) / F.greatest(box["y1"] - box["y0"], F.lit(1e-6)))


def from_box(p: Column, box: Column) -> Column:
    """the inverse of to_box."""
    return point(box["x0"] + p["x"] * F.greatest(box["x1"] - box["x0"], F.lit(1e-6)), box["y0"] + p["y"] * F.greatest(box["y1"] - box["y0"], F.lit(1e-6)))


def box_jumped(box: Column, last: Column, move: float = 0.20, shrink: float = 0.75, grow: float = 1.33) -> Column:
    """whether a box moved more than ``move`` of the last one's diagonal or changed its size beyond [shrink, grow]."""
    mid = lambda b: point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)
    diagonal = lambda b: F.hypot(b["x1"] - b["x0"], b["y1"] - b["y0"])
    ratio = diagonal(box) / F.greatest(diagonal(last), F.lit(1e-6))
    return (distance(mid(box), mid(last)) > move * diagonal(last)) | ~ratio.between(shrink, grow)


def detector_confidence(parallel: Column, length: Column, law: Column) -> Column:
    """0.35, 0.25 and 0.40 of the three shares."""
    return 0.35 * parallel + 0.25 * length + 0.40 * law


def hand_confidence(presence: Column, spread: Column, evenness: Column) -> Column:
    """0.5, 0.3 and 0.2 of the three shares."""
    return 0.5 * presence + 0.3 * spread + 0.2 * evenness


def active_finger(named: Column, offsets: Column, order: tuple[str, ...]) -> Column:
    """the named finger if its offset is known, else the one of the least |offset|, in ``order``."""
    known = F.filter(F.array(*[F.struct(F.abs(offsets[f]).alias("off"), F.lit(i).alias("i"), F.lit(f).alias("finger")) for i, f in enumerate(order)]), lambda s: s["off"].isNotNull())
    return F.when(offsets[named].isNotNull(), named).otherwise(F.array_min(known)["finger"])
