"""Geometry in DuckDB SQL for the oracles, in other ways than the operators': segments meet where the parameters of their
lines' common point lie in 0 to 1, a distance is a projection's or an end's, and pieces are cut by joins."""

from __future__ import annotations

#: Edges with their vertices as a list.
VERTS = "(SELECT id, u, v, list_filter([{'x': x1, 'y': y1}, {'x': xm, 'y': ym}, {'x': xk, 'y': yk}, {'x': x2, 'y': y2}], lambda p: p.x IS NOT NULL) AS line FROM edge)"
SAME_COURSE = "least(e.u, e.v) = least(o.u, o.v) AND greatest(e.u, e.v) = greatest(o.u, o.v) AND (e.line = o.line OR e.line = list_reverse(o.line))"
#: Edges with the least id of those of their course.
COURSES = f"(SELECT e.id, e.u, e.v, min(o.id) AS first FROM {VERTS} e JOIN {VERTS} o ON {SAME_COURSE} GROUP BY e.id, e.u, e.v)"


def seg_cells(seg: str, grow: float, cell: int = 200) -> str:
    """Segments by the cells of their boxes, grown on all sides."""
    span = lambda k: f"range(floor((least({k}1, {k}2) - {grow}) / {cell})::INT, floor((greatest({k}1, {k}2) + {grow}) / {cell})::INT + 1)"
    return f"(SELECT *, unnest({span('y')}) AS cy FROM (SELECT *, unnest({span('x')}) AS cx FROM {seg}) q)"


def _parameters(l: str, r: str) -> tuple[str, str, str]:
    """Numerators and denominator of the parameters of the lines' common point on l and on r."""
    lx, ly, rx, ry = (f"({s}.{c}2-{s}.{c}1)" for s in (l, r) for c in "xy")
    qx, qy = (f"({r}.{c}1-{l}.{c}1)" for c in "xy")
    return f"({qx}*{ry}-{qy}*{rx})", f"({qx}*{ly}-{qy}*{lx})", f"({lx}*{ry}-{ly}*{rx})"


def _meet(l: str, r: str) -> tuple[str, str, str]:
    t, u, d = _parameters(l, r)
    return f"{d}<>0", f"({t}/nullif({d},0))", f"({u}/nullif({d},0))"


def crossing_pairs(seg: str) -> str:
    some, t, u = _meet("l", "r")
    ends = f"NOT (l.k=0 AND {t}=0) AND NOT (l.k=l.many-1 AND {t}=1) AND NOT (r.k=0 AND {u}=0) AND NOT (r.k=r.many-1 AND {u}=1)"
    cells = seg_cells(seg, 0)
    return f"(SELECT l.id, r.id AS other FROM {cells} l JOIN {cells} r ON l.cx = r.cx AND l.cy = r.cy AND l.id <> r.id WHERE {some} AND {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 AND {ends})"


def point_distance(x: str, y: str, s: str) -> str:
    dx, dy = f"({s}.x2-{s}.x1)", f"({s}.y2-{s}.y1)"
    dot, whole = f"(({x}-{s}.x1)*{dx}+({y}-{s}.y1)*{dy})", f"({dx}*{dx}+{dy}*{dy})"
    to = lambda k: f"sqrt(({x}-{s}.x{k})*({x}-{s}.x{k})+({y}-{s}.y{k})*({y}-{s}.y{k}))"
    return f"(CASE WHEN {dot}<=0 THEN {to(1)} WHEN {dot}>={whole} THEN {to(2)} ELSE abs(({x}-{s}.x1)*{dy}-({y}-{s}.y1)*{dx})/sqrt({whole}) END)"


def distance(l: str, r: str) -> str:
    some, t, u = _meet(l, r)
    ends = ", ".join(point_distance(f"{p}.x{k}", f"{p}.y{k}", s) for p, s in ((l, r), (r, l)) for k in (1, 2))
    return f"(CASE WHEN {some} AND {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 THEN 0.0 ELSE least({ends}) END)"


def nearest(l: str, r: str) -> str:
    """A list of {d, x, y}: the distance and the middle of each end and its place on the other segment, or the crossing."""
    some, t, u = _meet(l, r)
    out = []
    for p, s in ((l, r), (r, l)):
        for k in (1, 2):
            dx, dy = f"({s}.x2-{s}.x1)", f"({s}.y2-{s}.y1)"
            at = f"greatest(0, least(1, (({p}.x{k}-{s}.x1)*{dx}+({p}.y{k}-{s}.y1)*{dy})/({dx}*{dx}+{dy}*{dy})))"
            out.append(f"{{'d': round({point_distance(f'{p}.x{k}', f'{p}.y{k}', s)}, 9), 'x': round(({p}.x{k}+{s}.x1+{at}*{dx})/2, 6), 'y': round(({p}.y{k}+{s}.y1+{at}*{dy})/2, 6)}}")
    cross = f"{{'d': 0.0::DOUBLE, 'x': round({l}.x1+{t}*({l}.x2-{l}.x1), 6), 'y': round({l}.y1+{t}*({l}.y2-{l}.y1), 6)}}"
    return f"CASE WHEN {some} AND {t} > 0 AND {t} < 1 AND {u} > 0 AND {u} < 1 THEN [{cross}] ELSE [{', '.join(out)}] END"


def folded(l: str, r: str) -> str:
    turn = f"abs(degrees(atan2({l}.y2-{l}.y1, {l}.x2-{l}.x1) - atan2({r}.y2-{r}.y1, {r}.x2-{r}.x1)))"
    return f"least({turn} % 180, 180 - {turn} % 180)"


def inside(seg: str, window: list[tuple[float, float]]) -> str:
    """id, inside: segments cut wherever they meet a border's line; each piece is in or out as its middle is."""
    borders = list(zip(window, [*window[1:], window[0]]))
    side = lambda a, b, x, y: f"(({b[0] - a[0]}) * ({y} - ({a[1]})) - ({b[1] - a[1]}) * ({x} - ({a[0]})))"
    at = [f"CASE WHEN {side(a, b, 'x1', 'y1')} * {side(a, b, 'x2', 'y2')} < 0 THEN {side(a, b, 'x1', 'y1')} / ({side(a, b, 'x1', 'y1')} - {side(a, b, 'x2', 'y2')}) END" for a, b in borders]
    middle = " AND ".join(side(a, b, "(x1 + (f + t) / 2 * (x2 - x1))", "(y1 + (f + t) / 2 * (y2 - y1))") + " >= 0" for a, b in borders)
    return f"(SELECT id, (t - f) * len AS inside FROM (SELECT *, unnest(ts[:-2]) AS f, unnest(ts[2:]) AS t FROM (SELECT *, list_sort(list_distinct(list_filter([0.0::DOUBLE, 1.0::DOUBLE, {', '.join(at)}], lambda q: q IS NOT NULL))) AS ts FROM {seg}) q) q WHERE {middle} AND (t - f) * len > 1e-9)"


def vertices(seg: str, key: str) -> str:
    return f"(SELECT {key} AS key, x1 AS x, y1 AS y FROM {seg} UNION ALL SELECT {key}, x2, y2 FROM {seg} WHERE k = many - 1)"


def hausdorff(pairs: str, left: str, right: str, _: str = "") -> str:
    """ref, match, h of pairs (ref, match) of lines whose vertices are rows (key, x, y)."""
    far = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
    both = f"{pairs} p JOIN {left} a ON a.key = p.ref JOIN {right} b ON b.key = p.match"
    return f"(SELECT ref, match, max(m) AS h FROM (SELECT ref, match, a.x, a.y, min({far}) AS m FROM {both} GROUP BY ALL UNION ALL SELECT ref, match, b.x, b.y, min({far}) FROM {both} GROUP BY ALL) q GROUP BY ref, match)"


def pieces(source: str, seg: str, size: float) -> str:
    """Tables of a WITH, {k} standing for a name: piece (source's columns, seg, part, a, b), vert (seg, pos, x, y) and step
    (seg, k, many, x1, y1, x2, y2, len) of the pieces of lines."""
    run = f"(SELECT *, sum(len) OVER (PARTITION BY id ORDER BY k) AS hi, sum(len) OVER (PARTITION BY id ORDER BY k) - len AS lo FROM {seg})"
    at = lambda p: f"SELECT p.seg, p.{p} AS pos, r.x1 + greatest(0, least(1, (p.{p} - r.lo) / r.len)) * (r.x2 - r.x1) AS x, r.y1 + greatest(0, least(1, (p.{p} - r.lo) / r.len)) * (r.y2 - r.y1) AS y FROM piece_{{k}} p JOIN {run} r ON r.id = p.id AND r.lo <= p.{p} + 1e-9 AND p.{p} <= r.hi + 1e-9 QUALIFY row_number() OVER (PARTITION BY p.seg ORDER BY r.k) = 1"
    return f"""piece_{{k}} AS MATERIALIZED (SELECT * REPLACE (b - a AS length) FROM (SELECT *, concat(id, '_', part) AS seg, part * {size} AS a, CASE WHEN part = many - 1 THEN length ELSE (part + 1) * {size} END AS b
      FROM (SELECT *, unnest(range(many)) AS part FROM (SELECT *, greatest(1, floor(length / {size})::INT + (length - floor(length / {size}) * {size} >= {size} / 3)::INT) AS many FROM {source}) q) q) q),
    vert_{{k}} AS MATERIALIZED ({at('a')} UNION ALL (SELECT p.seg, r.lo, r.x1, r.y1 FROM piece_{{k}} p JOIN {run} r ON r.id = p.id AND r.k > 0 AND r.lo > p.a + 1e-9 AND r.lo < p.b - 1e-9) UNION ALL ({at('b')})),
    step_{{k}} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY seg) AS many, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM (
      SELECT seg, row_number() OVER w - 1 AS k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vert_{{k}} WINDOW w AS (PARTITION BY seg ORDER BY pos)) q WHERE x2 IS NOT NULL)"""
