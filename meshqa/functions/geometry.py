"""Planar geometry as Spark columns. A point is struct<x,y>, a line array<struct<x,y>>, a ring a closed or open line.
All of it is JVM-side column arithmetic, but for hulls and polygon clipping, which work on arrays in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"), F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def steps(line: Column) -> Column:
    """The elementary segments of a line: array<struct<a,b>>."""
    return F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def length(line: Column) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda s, p: s + distance(p["a"], p["b"]))


def ring_area(ring: Column) -> Column:
    """Shoelace; the ring may be open or closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.abs(F.aggregate(steps(closed), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def polygon_area(rings: Column) -> Column:
    """The first ring less the holes."""
    return ring_area(F.element_at(rings, 1)) - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area(r))


def centroid(line: Column) -> Column:
    """Of a line: its segments' middles, weighed by length."""
    total = length(line)
    along = lambda k: F.aggregate(steps(line), F.lit(0.0), lambda s, p: s + distance(p["a"], p["b"]) * (p["a"][k] + p["b"][k]) / 2) / total
    return F.struct(along("x").alias("x"), along("y").alias("y"))


def direction_angle(p: Column, q: Column) -> Column:
    """Degrees between the first steps of two lines, folded to at most 90."""
    def step(line, k):
        return F.element_at(line, 2)[k] - F.element_at(line, 1)[k]

    dot = step(p, "x") * step(q, "x") + step(p, "y") * step(q, "y")
    det = step(p, "x") * step(q, "y") - step(p, "y") * step(q, "x")
    angle = F.abs(F.degrees(F.atan2(det, dot)))
    return F.when(angle > 90, 180 - angle).otherwise(angle)


def folded_angle(px: str, py: str, qx: str, qy: str) -> Column:
    """Degrees between two steps, given by columns of their parts, folded to at most 90."""
    angle = F.abs(F.degrees(F.atan2(F.expr(f"{px}*{qy}-{py}*{qx}"), F.expr(f"{px}*{qx}+{py}*{qy}"))))
    return F.least(angle, 180 - angle)


def hausdorff(p: Column, q: Column) -> Column:
    """Discrete Hausdorff distance over vertices."""
    one = lambda a, b: F.array_max(F.transform(a, lambda s: F.array_min(F.transform(b, lambda t: distance(s, t)))))
    return F.greatest(one(p, q), one(q, p))


def canonical(line: Column) -> Column:
    """The same for a line and its reverse."""
    return F.least(line, F.reverse(line))


def unzip(line: Column) -> Column:
    """The two-point lines of a line."""
    return F.transform(steps(line), lambda p: F.array(p["a"], p["b"]))


def positions(line: Column) -> Column:
    """How far along a line its vertices are: 0 first, its length last."""
    return F.aggregate(steps(line), F.array(F.lit(0.0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + distance(p["a"], p["b"]))))


def substring(line: Column, start: Column, end: Column) -> Column:
    """The part of a line between two positions along it."""
    return between(line, positions(line), start, end)


def between(line: Column, run: Column, start: Column, end: Column) -> Column:
    """The same where the positions of the line's vertices are known. These do not fall, so that those before a place are
    counted and no step is tried one by one."""
    before = lambda at: F.size(F.filter(run, lambda r: r < at))
    until = lambda at: F.size(F.filter(run, lambda r: r <= at))

    def place(at: Column) -> Column:
        # the first step that has a length and ends here or later
        n = F.when(at > 0, before(at)).otherwise(until(F.lit(0.0)))
        a, b, lo, hi = F.get(line, n - 1), F.get(line, n), F.get(run, n - 1), F.get(run, n)
        t = (at - lo) / (hi - lo)
        return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

    first = until(start)
    inner = F.slice(line, first + 1, F.greatest(before(end) - first, F.lit(0)))
    return F.concat(F.array(place(start)), inner, F.array(place(F.least(end, F.element_at(run, -1)))))


def pieces(total: Column, size: float) -> Column:
    """Start and end of the pieces of a line of length `total`: of `size` each, a last one below a third of it merged."""
    whole = F.floor(total / size)
    rest = total - whole * size
    n = F.greatest(F.lit(1), F.when(rest >= size / 3, whole + 1).otherwise(whole)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * F.lit(float(size))).alias("start"), F.when(i == n - 1, total).otherwise((i + 1) * F.lit(float(size))).alias("end")))


def foot(px, py, x1, y1, x2, y2) -> str:
    """SQL for where on a segment its point nearest to another is, 0 to 1; the arguments are SQL."""
    return f"(CASE WHEN ({x2})=({x1}) AND ({y2})=({y1}) THEN 0.0 ELSE greatest(0.0, least(1.0, ((({px})-({x1}))*(({x2})-({x1}))+(({py})-({y1}))*(({y2})-({y1})))/((({x2})-({x1}))*(({x2})-({x1}))+(({y2})-({y1}))*(({y2})-({y1}))))) END)"


def point_segment(px, py, x1, y1, x2, y2, t: str | None = None) -> str:
    """SQL for the distance of a point to a segment; the arguments are SQL. t: its foot, where that is known."""
    t = t or foot(px, py, x1, y1, x2, y2)
    return f"sqrt(pow(({px})-(({x1})+{t}*(({x2})-({x1}))),2)+pow(({py})-(({y1})+{t}*(({y2})-({y1}))),2))"


def crosses(a: str, b: str) -> str:
    """SQL: the segments a.(x1,y1,x2,y2) and b.(...) meet in a point inside both."""
    side = lambda s, p, k: f"(({s}.x2-{s}.x1)*({p}.y{k}-{s}.y1)-({s}.y2-{s}.y1)*({p}.x{k}-{s}.x1))"
    return f"({side(a, b, 1)}*{side(a, b, 2)}<0 AND {side(b, a, 1)}*{side(b, a, 2)}<0)"


def meets_inside(a: str, b: str) -> str:
    """SQL: the lines of the segments a and b (x1, y1, x2, y2, first, last) meet in these, in a point that is an end of
    neither line. Segments that run along each other don't."""
    side = lambda s, p, k: f"(({s}.x2-{s}.x1)*({p}.y{k}-{s}.y1)-({s}.y2-{s}.y1)*({p}.x{k}-{s}.x1))"
    b1, b2, a1, a2 = side(a, b, 1), side(a, b, 2), side(b, a, 1), side(b, a, 2)
    ends = f"NOT ({a}.first AND {a1}=0) AND NOT ({a}.last AND {a2}=0) AND NOT ({b}.first AND {b1}=0) AND NOT ({b}.last AND {b2}=0)"
    return f"({b1}*{b2}<=0 AND {a1}*{a2}<=0 AND {b1}<>{b2} AND {ends})"


def _ends(a: str, b: str) -> list[tuple[str, ...]]:
    return [(f"{p}.x{k}", f"{p}.y{k}", f"{s}.x1", f"{s}.y1", f"{s}.x2", f"{s}.y2") for p, s in ((a, b), (b, a)) for k in (1, 2)]


def feet(a: str, b: str) -> dict[str, str]:
    """SQL for the feet of the segments' ends on each other, by name, for segment_distance."""
    return {f"_t{k}": foot(*e) for k, e in enumerate(_ends(a, b))}


def segment_distance(a: str, b: str, known: bool = False) -> str:
    """SQL for the distance of the segments a and b; known: the columns of feet(a, b) are there."""
    ends = [point_segment(*e, f"_t{k}" if known else None) for k, e in enumerate(_ends(a, b))]
    return f"(CASE WHEN {crosses(a, b)} THEN 0.0 ELSE least({', '.join(ends)}) END)"


def nearest(a: str, b: str) -> str:
    """SQL for struct<d, x, y> of the segments a and b: their distance and the middle between their nearest points, or the
    point where they cross. Of equal distances the least point."""
    tried = []
    for p, s in ((a, b), (b, a)):
        for k in (1, 2):
            px, py = f"{p}.x{k}", f"{p}.y{k}"
            dx, dy = f"({s}.x2-{s}.x1)", f"({s}.y2-{s}.y1)"
            t = f"coalesce(greatest(0.0D, least(1.0D, try_divide(({px}-{s}.x1)*{dx}+({py}-{s}.y1)*{dy}, {dx}*{dx}+{dy}*{dy}))), 0.0D)"
            x, y = f"({s}.x1+{t}*{dx})", f"({s}.y1+{t}*{dy})"
            tried.append(f"named_struct('d', round(sqrt(({px}-{x})*({px}-{x})+({py}-{y})*({py}-{y})), 9), 'x', round(({px}+{x})/2, 6), 'y', round(({py}+{y})/2, 6))")
    side = lambda k: f"(({b}.x2-{b}.x1)*({a}.y{k}-{b}.y1)-({b}.y2-{b}.y1)*({a}.x{k}-{b}.x1))"
    at = f"try_divide({side(1)}, {side(1)}-{side(2)})"
    cross = f"named_struct('d', 0.0D, 'x', round({a}.x1+{at}*({a}.x2-{a}.x1), 6), 'y', round({a}.y1+{at}*({a}.y2-{a}.y1), 6))"
    return f"(CASE WHEN {crosses(a, b)} THEN {cross} ELSE array_min(array({', '.join(tried)})) END)"


def clipped(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> tuple[str, str]:
    """SQL for the part of a segment inside a rectangle: where it enters and leaves, 0 to 1 (Liang-Barsky by slabs)."""
    def slab(p, q, lo, hi):
        d = f"(({q})-({p}))"
        enter = f"(CASE WHEN {d}=0 THEN (CASE WHEN ({p})>=({lo}) AND ({p})<({hi}) THEN 0.0 ELSE 2.0 END) ELSE least((({lo})-({p}))/{d},(({hi})-({p}))/{d}) END)"
        leave = f"(CASE WHEN {d}=0 THEN 1.0 ELSE greatest((({lo})-({p}))/{d},(({hi})-({p}))/{d}) END)"
        return enter, leave

    (ex, lx), (ey, ly) = slab(x1, x2, xmin, xmax), slab(y1, y2, ymin, ymax)
    return f"greatest(0.0,{ex},{ey})", f"least(1.0,{lx},{ly})"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6371009 m (a fixed value), to the millimetre."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * 6371009 * F.asin(F.sqrt(F.least(F.lit(1.0), a))), 3)


#: Fixed values of the WGS 84 ellipsoid and of UTM: equatorial radius, flattening, scale and false origin.
RADIUS, FLATTENING, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """Degrees to metres in a UTM zone, by the series in the third flattening up to its third power: to a millimetre or so
    within a few degrees of the zone's middle. A point, as struct<x,y>."""
    n = FLATTENING / (2 - FLATTENING)
    rectifying = SCALE * RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    turn, s = F.radians(lon - (6 * zone - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EAST + rectifying * x).alias("x"), ((NORTH if south else 0.0) + rectifying * y).alias("y"))


def hull(points) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise, of (x, y) pairs."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(of):
        out = []
        for p in of:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(ordered[::-1])


def clip_convex(subject, window):
    """A polygon's part inside a convex, counter-clockwise window (one half-plane after another)."""
    out = list(subject)
    for (ax, ay), (bx, by) in zip(window, [*window[1:], window[0]]):
        ring, out = out, []
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        for p, q in zip(ring, [*ring[1:], *ring[:1]]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if (s > 0 > t) or (s < 0 < t):
                k = s / (s - t)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
    return out


def merged(lines) -> list[list[tuple[float, float]]]:
    """Lines joined end to end where exactly two ends meet."""
    lines = [list(line) for line in lines if len(line) > 1]
    ends: dict = {}
    for k, line in enumerate(lines):
        for e in (line[0], line[-1]):
            ends.setdefault(e, []).append(k)
    alive = {k: line for k, line in enumerate(lines)}
    owner = list(range(len(lines)))

    def find(k):
        while owner[k] != k:
            k = owner[k]
        return k

    for e, touching in ends.items():
        if len(touching) != 2 or (a := find(touching[0])) == (b := find(touching[1])):
            continue
        one, two = alive[a], alive[b]
        one = one if one[-1] == e else one[::-1]
        two = two if two[0] == e else two[::-1]
        alive[a] = one + two[1:]
        owner[b] = a
        del alive[b]
    return list(alive.values())
