"""DuckDB SQL of resampled and turned volumes (plane, y, x, v), as common table expressions: every target voxel joins its sources."""

from __future__ import annotations

from math import prod

from stackloom.operators import render

AXES = ("plane", "y", "x")


def grid(shape: tuple[int, int, int]) -> str:
    """All voxels of a shape."""
    n = prod(shape)
    return f"SELECT i // {shape[1] * shape[2]} AS plane, i // {shape[2]} % {shape[1]} AS y, i % {shape[2]} AS x FROM (SELECT unnest(range({n})) AS i)"


def ones(name: str, shape: tuple[int, int, int]) -> str:
    return f"{name} AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS v FROM ({grid(shape)}))"


def edges(name: str, shape: tuple[int, int, int], t: int) -> str:
    near = " + ".join(f"({c} < {t} OR {c} > {n - 1 - t})::INT" for c, n in zip(AXES, shape, strict=True))
    return f"{name} AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS v FROM ({grid(shape)}) WHERE {near} >= 2)"


def resampled(name: str, source: str, of: tuple[int, int, int], to: tuple[int, int, int]) -> str:
    at = ", ".join(f"{c} * ({n - 1}::DOUBLE / {max(1, m - 1)}) AS f{c}" for c, n, m in zip(AXES, of, to, strict=True))
    weight = " * ".join(f"abs(1 - t{c} - (f{c} - floor(f{c})))" for c in AXES)
    taps = ", ".join(f"(VALUES (0), (1)) {c}t(t{c})" for c in AXES)
    on = " AND ".join(f"m.{c} = floor(f{c}) + t{c}" for c in AXES)
    return f"{name} AS MATERIALIZED (SELECT g.plane, g.y, g.x, sum(coalesce(m.v * ({weight}), 0)) AS v FROM (SELECT *, {at} FROM ({grid(to)})) g, {taps} LEFT JOIN {source} m ON {on} GROUP BY g.plane, g.y, g.x)"


def turned(name: str, source: str, shape: tuple[int, int, int], axes: tuple[str, str], angle: float, nearest: bool) -> tuple[str, tuple[int, int, int]]:
    """The source turned in the plane of two axes, and its new shape."""
    p, q = axes
    (other,) = set(AXES) - {p, q}
    n = dict(zip(AXES, shape, strict=True))
    c, s, (rows, columns), (a, b) = render.turn(n[p], n[q], angle)
    new = tuple({other: n[other], p: rows, q: columns}[x] for x in AXES)
    at = f"round({c!r} * {p} + {s!r} * {q} + {a!r}, 9) AS fp, round({c!r} * {q} - {s!r} * {p} + {b!r}, 9) AS fq"
    inside = f"fp BETWEEN 0 AND {n[p] - 1} AND fq BETWEEN 0 AND {n[q] - 1}"
    if nearest:
        return f"{name} AS MATERIALIZED (SELECT g.plane, g.y, g.x, CASE WHEN {inside} THEN coalesce(m.v, 0) ELSE 0 END AS v FROM (SELECT *, {at} FROM ({grid(new)})) g LEFT JOIN {source} m ON m.{other} = g.{other} AND m.{p} = floor(fp + 0.5) AND m.{q} = floor(fq + 0.5))", new
    weight = f"CASE WHEN {inside} THEN abs(1 - tp - (fp - floor(fp))) * abs(1 - tq - (fq - floor(fq))) ELSE 0 END"
    return f"""{name} AS MATERIALIZED (SELECT g.plane, g.y, g.x, sum(coalesce(m.v * ({weight}), 0)) AS v FROM (SELECT *, {at} FROM ({grid(new)})) g, (VALUES (0), (1)) pt(tp), (VALUES (0), (1)) qt(tq)
      LEFT JOIN {source} m ON m.{other} = g.{other} AND m.{p} = floor(fp) + tp AND m.{q} = floor(fq) + tq GROUP BY g.plane, g.y, g.x)""", new


def seen_from(name: str, source: str, shape: tuple[int, int, int], azimuth: float, elevation: float, nearest: bool) -> tuple[str, tuple[int, int, int]]:
    one, shape = turned(f"{name}_", source, shape, ("y", "x"), azimuth, nearest)
    two, shape = turned(name, f"{name}_", shape, ("plane", "y"), elevation, nearest)
    return f"{one}, {two}", shape


def views(source: str, shape: tuple[int, int, int], z_step: float, pixel: float, azimuth: float = -20.0, elevation: float = 28.0, pad: int = 4) -> tuple[str, str]:
    """(common table expressions, query) of render.views()."""
    size = (max(2, round(shape[0] * z_step / pixel)), *shape[1:])
    ctes = [resampled("iso", source, shape, size), ones("one_", size), seen_from("sn", "iso", size, azimuth, elevation, False)[0], seen_from("ft", "one_", size, azimuth, elevation, True)[0]]
    ctes.append("bo AS MATERIALIZED (SELECT * FROM (SELECT y, x, max(v) AS v FROM sn GROUP BY y, x) JOIN (SELECT y, x, max(v) AS foot FROM ft GROUP BY y, x) USING (y, x))")
    ctes.append(f"bx AS (SELECT greatest(min(y) - {pad}, 0) AS ly, max(y) + {pad} AS hy, greatest(min(x) - {pad}, 0) AS lx, max(x) + {pad} AS hx FROM bo WHERE foot > 0)")
    return ", ".join(ctes), f"""SELECT 'oblique' AS view, y - ly AS y, x - lx AS x, CASE WHEN foot > 0 THEN v ELSE 'NaN'::DOUBLE END AS v FROM bo, bx WHERE y BETWEEN ly AND hy AND x BETWEEN lx AND hx
      UNION ALL SELECT 'axial', y, x, max(v) FROM {source} GROUP BY y, x UNION ALL SELECT 'side', plane, x, max(v) FROM iso GROUP BY plane, x"""


def cuboid(source: str, shape: tuple[int, int, int], spacing: tuple[float, float, float], most: int, threshold: float, azimuth: float = -35.0, elevation: float = 32.0, opacity: float = 0.14, thickness: int = 1, padding: float = 0.12) -> tuple[str, str]:
    """(common table expressions, query) of render.cuboid() with a dilation of one step."""
    spans = [a * b for a, b in zip(shape, spacing, strict=True)]
    step = max(min(spacing), max(spans) / most)
    size = tuple(max(2, round(s / step)) for s in spans)
    seen, full = seen_from("sn", "iso", size, azimuth, elevation, False)
    ctes = [resampled("iso", source, shape, size), ones("one_", size), edges("ed", size, thickness), seen, seen_from("ft", "one_", size, azimuth, elevation, True)[0], seen_from("ln", "ed", size, azimuth, elevation, True)[0]]
    ctes += [
        f"sg AS (SELECT plane, y, x, least(greatest((v - {threshold}) / {1 - threshold}, 0), 1) AS s FROM sn)", "fr_ AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY y, x ORDER BY plane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM sg)",
        f"sh AS (SELECT y, x, sum(exp(-{opacity} * f) * (1 - exp(-{opacity} * s)) * s) AS v FROM fr_ GROUP BY y, x)", "fo AS MATERIALIZED (SELECT DISTINCT y, x FROM ft WHERE v > 0)",
        f"eg AS (SELECT DISTINCT y + i AS y, x + j AS x FROM (SELECT DISTINCT y, x FROM ln WHERE v > 0), (VALUES (-1), (0), (1)) p(i), (VALUES (-1), (0), (1)) r(j) WHERE abs(i) + abs(j) <= 1 AND y + i BETWEEN 0 AND {full[1] - 1} AND x + j BETWEEN 0 AND {full[2] - 1})",
        "bx AS (SELECT min(y) AS ly, max(y) AS hy, min(x) AS lx, max(x) AS hx FROM fo)", f"mg AS (SELECT *, greatest(12, ceil(greatest(hy - ly + 1, hx - lx + 1) * {padding}))::BIGINT AS m FROM bx)",
        "cv AS (SELECT ty, unnest(range(hx - lx + 1 + 2 * m)) AS tx, ly, hy, lx, hx, m FROM (SELECT *, unnest(range(hy - ly + 1 + 2 * m)) AS ty FROM mg))",
    ]
    return ", ".join(ctes), """SELECT ty AS y, tx AS x, CASE WHEN fo.y IS NOT NULL THEN sh.v ELSE 'NaN'::DOUBLE END AS v, fo.y IS NOT NULL AS support, eg.y IS NOT NULL AND py BETWEEN ly AND hy AND px BETWEEN lx AND hx AS edge
      FROM (SELECT *, ty + ly - m AS py, tx + lx - m AS px FROM cv) c LEFT JOIN fo ON fo.y = py AND fo.x = px LEFT JOIN eg ON eg.y = py AND eg.x = px LEFT JOIN sh ON sh.y = py AND sh.x = px"""
