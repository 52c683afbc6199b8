"""DuckDB SQL of rigid registration on 8 x 8 images: discrete Fourier transforms are joins with a table of roots of unity.

Each function gives common table expressions. Images are rows (plane, y, x, v) or, of frames, (plane, local_index, y, x, v). The shift that moves a frame onto
a reference is the peak of the inverse transform of their cross-spectrum, refined by evaluating that transform on a grid of tenths
of a pixel around it.
"""

from __future__ import annotations

N, UP, REACH = 8, 10, 8
FRAME = "plane, local_index"
CORR = "CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 'NaN'::DOUBLE END"
#: Roots of unity for whole frequencies and positions, k being the frequency as a whole number from -4 to 3.
ROOTS = f"""rt AS MATERIALIZED (SELECT u, CASE WHEN u < {N // 2} THEN u ELSE u - {N} END AS k, p, cos(2 * pi() * u * p / {N}) AS c, sin(2 * pi() * u * p / {N}) AS s FROM (SELECT unnest(range({N})) AS u), (SELECT unnest(range({N})) AS p))"""


def transform(name: str, source: str, key: str) -> str:
    """(key, u, w, re, im) of the images of ``source``."""
    return f"""{name}1 AS MATERIALIZED (SELECT {key}, u, x, sum(v * c) AS re, -sum(v * s) AS im FROM {source} JOIN rt ON p = y GROUP BY {key}, u, x),
    {name} AS MATERIALIZED (SELECT {key}, {name}1.u, rt.u AS w, sum(re * c + im * s) AS re, sum(im * c - re * s) AS im FROM {name}1 JOIN rt ON p = x GROUP BY {key}, {name}1.u, rt.u)"""


def shifts(name: str, reference: str, frames: str) -> str:
    """(plane, local_index, dy, dx, error, corr) of each frame against the image of its plane."""
    n = name
    top = lambda v: f"arg_max({v}, (mag, -pos))"
    fine = lambda axis, base: f"2 * pi() * ({base} + i / {UP}.0::DOUBLE) * {axis} / {N}"
    return f"""{transform(n + 'r', reference, 'plane')}, {transform(n + 'f', frames, FRAME)},
    {n}c AS MATERIALIZED (SELECT {FRAME}, f.u, f.w, r.re * f.re + r.im * f.im AS re, r.im * f.re - r.re * f.im AS im FROM {n}f f JOIN {n}r r USING (plane, u, w)),
    {n}q AS (SELECT {FRAME}, sqrt(sum(r.re * r.re + r.im * r.im) * sum(f.re * f.re + f.im * f.im)) / {N * N} AS power FROM {n}f f JOIN {n}r r USING (plane, u, w) GROUP BY {FRAME}),
    {n}i AS (SELECT {FRAME}, w, p AS y, sum(re * c - im * s) AS re, sum(im * c + re * s) AS im FROM {n}c JOIN rt USING (u) GROUP BY {FRAME}, w, p),
    {n}j AS (SELECT {FRAME}, y, p AS x, y * {N} + p AS pos, sqrt(sum(re * c - im * s) ** 2 + sum(im * c + re * s) ** 2) AS mag FROM {n}i JOIN rt ON rt.u = w GROUP BY {FRAME}, y, p),
    {n}k AS MATERIALIZED (SELECT {FRAME}, CASE WHEN {top('y')} > {N // 2} THEN {top('y')} - {N} ELSE {top('y')} END AS py, CASE WHEN {top('x')} > {N // 2} THEN {top('x')} - {N} ELSE {top('x')} END AS px FROM {n}j GROUP BY {FRAME}),
    {n}y AS (SELECT {FRAME}, px, py, i, w, sum(re * cos({fine('k', 'py')}) - im * sin({fine('k', 'py')})) AS re, sum(im * cos({fine('k', 'py')}) + re * sin({fine('k', 'py')})) AS im
      FROM {n}c JOIN {n}k USING ({FRAME}) JOIN (SELECT u, k FROM rt WHERE p = 0) USING (u), (SELECT unnest(range(-{REACH}, {REACH + 1})) AS i) GROUP BY {FRAME}, px, py, i, w),
    {n}x AS (SELECT {FRAME}, px, py, j, i, j * 100 + i AS pos, sqrt(sum(re * cos({fine('k', 'px')}) - im * sin({fine('k', 'px')})) ** 2 + sum(im * cos({fine('k', 'px')}) + re * sin({fine('k', 'px')})) ** 2) / {N * N} AS mag
      FROM (SELECT * RENAME (i AS j) FROM {n}y) JOIN (SELECT u AS w, k FROM rt WHERE p = 0) USING (w), (SELECT unnest(range(-{REACH}, {REACH + 1})) AS i) GROUP BY {FRAME}, px, py, j, i),
    {n}b AS (SELECT {FRAME}, first(py) + {top('j')} / {UP}.0::DOUBLE AS dy, first(px) + {top('i')} / {UP}.0::DOUBLE AS dx, max(mag) AS best FROM {n}x GROUP BY {FRAME}),
    {n} AS MATERIALIZED (SELECT {FRAME}, dy, dx, sqrt(greatest(0, 1 - (best / power) ** 2)) AS error, corr FROM {n}b JOIN {n}q USING ({FRAME}) JOIN ({correlation(reference, frames)}) USING ({FRAME}))"""


def correlation(reference: str, frames: str) -> str:
    """(plane, local_index, corr) over the pixels that are finite in both."""
    return f"SELECT {FRAME}, {CORR} AS corr FROM (SELECT {FRAME}, r.v AS a, f.v AS b FROM {frames} f JOIN {reference} r USING (plane, y, x) WHERE isfinite(r.v) AND isfinite(f.v)) GROUP BY {FRAME}"


def moved(name: str, frames: str, by: str, nearest: bool = False) -> str:
    """The frames moved by dy, dx with linear interpolation: NaN where the source is outside, or, with ``nearest``, the pixel at the border."""
    at = (lambda c: f"least(greatest({c} - d{c}, 0), {N - 1})") if nearest else (lambda c: f"{c} - d{c}")
    return f"""{name} AS MATERIALIZED (SELECT {FRAME}, y, x, CASE WHEN bool_or(v IS NULL AND weight > 0) THEN 'NaN'::DOUBLE ELSE sum(coalesce(v * weight, 0)) END AS v FROM (
      SELECT g.plane, g.local_index, g.y, g.x, m.v, abs(1 - a - (sy - floor(sy))) * abs(1 - b - (sx - floor(sx))) AS weight FROM (SELECT f.plane, f.local_index, f.y, f.x, {at('y')} AS sy, {at('x')} AS sx FROM {frames} f JOIN {by} USING ({FRAME})) g,
        (VALUES (0), (1)) p(a), (VALUES (0), (1)) r(b) LEFT JOIN {frames} m ON m.plane = g.plane AND m.local_index = g.local_index AND m.y = floor(sy) + a AND m.x = floor(sx) + b) GROUP BY {FRAME}, y, x)"""


def means(name: str, frames: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT plane, y, x, coalesce(avg(v) FILTER (isfinite(v)), 'NaN'::DOUBLE) AS v FROM {frames} GROUP BY plane, y, x)"


def frame_shifts() -> str:
    """``fsh``: shifts of the frames ``vox`` in two rounds, against the medians ``med`` and then the mean of what was moved; ``mv1`` are the frames moved at last."""
    steps = [ROOTS, shifts("s0", "med", "vox"), moved("mv0", "vox", "s0"), means("mn0", "mv0"), shifts("s1", "mn0", "vox"), moved("mv1", "vox", "s1"), means("mn1", "mv1")]
    return ", ".join([*steps, f"fsh AS MATERIALIZED (SELECT {FRAME}, s1.dy, s1.dx, s1.error, s0.corr AS corr_before, t.corr AS corr_after FROM s1 JOIN s0 USING ({FRAME}) JOIN ({correlation('mn1', 'mv1')}) t USING ({FRAME}))"])


def rule(source: str, most: float, corr_k: float, error_k: float, gain: float, least: float = 0.3) -> str:
    """``rule``: the rows of ``source`` with bounds, reasons and what is kept (see register.registration_keep())."""
    from stackloom.operators import register as r

    ok = lambda c: f"valid AND isfinite({c})"
    return f"""ra AS (SELECT *, sqrt(dy * dy + dx * dx) AS magnitude, corr_after - corr_before AS gain, sqrt(dy * dy + dx * dx) <= {most} AS valid FROM {source}),
    rb AS (SELECT plane, coalesce(median(corr_after) FILTER ({ok('corr_after')}) - {corr_k} * 1.4826 * mad(corr_after) FILTER ({ok('corr_after')}), 'Infinity'::DOUBLE) AS corr_bound, coalesce(median(error) FILTER ({ok('error')}) + {error_k} * 1.4826 * mad(error) FILTER ({ok('error')}), '-Infinity'::DOUBLE) AS error_bound FROM ra GROUP BY plane),
    rc AS (SELECT ra.*, corr_bound, error_bound, {ok('corr_after')} AND corr_after >= corr_bound AND isfinite(error) AND error <= error_bound AND isfinite(gain) AND gain >= {gain} AS ok, {ok('corr_after')} AS may FROM ra JOIN rb USING (plane)),
    rd AS (SELECT *, sum(ok::INT) OVER w < greatest(1, ceil(count(*) OVER w * {least})) AS relaxed, greatest(1, ceil(count(*) OVER w * {least})) AS need, row_number() OVER (PARTITION BY plane ORDER BY may DESC, CASE WHEN isfinite(corr_after) THEN corr_after ELSE '-Infinity'::DOUBLE END DESC, local_index DESC) AS rk FROM rc WINDOW w AS (PARTITION BY plane)),
    rule AS MATERIALIZED (SELECT {FRAME}, dy, dx, error, corr_before, corr_after, magnitude, gain, valid, corr_bound, error_bound, relaxed, CASE WHEN relaxed THEN may AND rk <= need ELSE ok END AS keep,
      concat_ws(';', CASE WHEN magnitude > {most} THEN '{r.SHIFT}' END, CASE WHEN isfinite(corr_after) AND corr_after < corr_bound THEN '{r.CORRELATION}' END, CASE WHEN isfinite(error) AND error > error_bound THEN '{r.ERROR}' END, CASE WHEN isfinite(gain) AND gain < {gain} THEN '{r.GAIN}' END) AS reasons FROM rd)"""


def cross_plane(k: float = 3.0, most: float = 10.0) -> str:
    """``cp``: steps between neighbouring planes of ``med``, gated, and their running sums."""
    return ", ".join([
        ROOTS, "cf AS (SELECT plane, 0 AS local_index, y, x, v FROM med)", "cb AS (SELECT plane + 1 AS plane, y, x, v FROM med)", shifts("cs", "cb", "cf"),
        f"cg AS (SELECT *, isfinite(corr) AND corr >= (SELECT coalesce(median(corr) FILTER (isfinite(corr)) - {k} * 1.4826 * mad(corr) FILTER (isfinite(corr)), 'Infinity'::DOUBLE) FROM cs) AND sqrt(dy * dy + dx * dx) <= {most} AS reliable FROM cs)",
        "cp AS MATERIALIZED (SELECT plane, dy, dx, error, corr, reliable, sum(CASE WHEN reliable THEN dy ELSE 0 END) OVER w AS cum_dy, sum(CASE WHEN reliable THEN dx ELSE 0 END) OVER w AS cum_dx FROM cg WINDOW w AS (ORDER BY plane))",
    ])


def corrected() -> str:
    """``co``: the planes of ``med`` moved by their running drift, borders repeated; the first one stays."""
    by = "(SELECT DISTINCT f.plane, 0 AS local_index, coalesce(cum_dy, 0) AS dy, coalesce(cum_dx, 0) AS dx FROM med f LEFT JOIN cp USING (plane))"
    return ", ".join([cross_plane(), f"cd AS MATERIALIZED {by}", moved("co", "cf", "cd", nearest=True)])


def within(n: int = 5) -> str:
    """``dw``: the shift of the mean of each plane's last n frames to that of its first n."""
    return ", ".join([
        ROOTS, f"el AS MATERIALIZED (SELECT plane, y, x, avg(v) FILTER (local_index < {n}) AS early, avg(v) FILTER (local_index >= f - {n}) AS late FROM vox JOIN (SELECT plane, count(*) AS f FROM fr GROUP BY plane) USING (plane) GROUP BY ALL)",
        "ea AS (SELECT plane, y, x, early AS v FROM el)", "la AS (SELECT plane, 0 AS local_index, y, x, late AS v FROM el)", shifts("dw0", "ea", "la"), moved("dw1", "la", "dw0"),
        f"dw AS (SELECT plane, dy, dx, sqrt(dy * dy + dx * dx) AS magnitude, error, dw0.corr AS corr_before, t.corr AS corr_after FROM dw0 JOIN ({correlation('ea', 'dw1')}) t USING ({FRAME}))",
    ])


def methods() -> str:
    """``me``: the mean of all frames (A), of those that the plain filter keeps (B), of all moved ones (C), and of those that the rule keeps (D)."""
    mean = lambda name, source: f"SELECT plane, '{name}' AS method, y, x, coalesce(avg(v) FILTER (isfinite(v)), 'NaN'::DOUBLE) AS v FROM {source} GROUP BY plane, y, x"
    only = lambda source, kept: f"(SELECT * FROM {source} SEMI JOIN {kept} USING ({FRAME}))"
    return f"me AS MATERIALIZED ({mean('A', 'vox')} UNION ALL {mean('B', only('vox', 'kept'))} UNION ALL {mean('C', 'mv1')} UNION ALL {mean('D', only('mv1', '(SELECT * FROM rule WHERE keep)'))})"


def runs(source: str, name: str) -> str:
    """The longest run of frames that are not kept, for each plane."""
    return f"SELECT plane, coalesce(max(n) FILTER (NOT keep), 0) AS {name} FROM (SELECT plane, keep, isl, count(*) AS n FROM (SELECT plane, keep, row_number() OVER (PARTITION BY plane ORDER BY local_index) - row_number() OVER (PARTITION BY plane, keep ORDER BY local_index) AS isl FROM {source}) GROUP BY ALL) GROUP BY plane"


def summary() -> str:
    """A row a plane of both filters and all methods."""
    side = lambda c: f"CASE WHEN lag(v) OVER w{c} IS NULL THEN lead(v) OVER w{c} - v WHEN lead(v) OVER w{c} IS NULL THEN v - lag(v) OVER w{c} ELSE (lead(v) OVER w{c} - lag(v) OVER w{c}) / 2 END"
    sharp = f"SELECT plane, method, avg(gy * gy + gx * gx) / var_pop(v) AS t FROM (SELECT plane, method, v, {side('y')} AS gy, {side('x')} AS gx FROM me WINDOW wy AS (PARTITION BY plane, method, x ORDER BY y), wx AS (PARTITION BY plane, method, y ORDER BY x)) GROUP BY ALL"
    p95 = lambda c, n: f"quantile_cont({c}, 0.95) AS {n}"
    return f"""SELECT * FROM (SELECT plane, count(*) AS frames, count_if(keep) AS kept, CASE WHEN count_if(keep) = 0 THEN 'nothing_kept' ELSE 'pass' END AS status, avg(keep::INT) AS kept_share, bool_or(relaxed) AS relaxed, first(corr_bound) AS corr_bound, first(error_bound) AS error_bound, median(magnitude) AS shift_p50, {p95('magnitude', 'shift_p95')}, max(magnitude) AS shift_max, {p95('magnitude', 'shift_um_p95')},
      avg(corr_before) AS corr_before, avg(corr_after) AS corr_after, avg(gain) AS gain, avg(error) AS error_mean, {p95('error', 'error_p95')} FROM rule GROUP BY plane)
      JOIN (SELECT plane, count_if(keep) AS legacy_kept, avg(keep::INT) AS legacy_kept_share, first(threshold) AS legacy_bound FROM kp GROUP BY plane) USING (plane) JOIN ({runs('rule', 'longest_rejected')}) USING (plane) JOIN ({runs('kp', 'legacy_longest_rejected')}) USING (plane)
      JOIN (SELECT plane, {', '.join(f"max(t) FILTER (method = '{m}') AS sharpness_{m}" for m in 'ABCD')} FROM ({sharp}) GROUP BY plane) USING (plane)"""
