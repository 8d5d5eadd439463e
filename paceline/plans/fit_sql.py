"""The SQL of clustering fits: chained common table expressions, one set for each superstep."""

from __future__ import annotations

E = "(2.0 / (1.1 - 1.0))"
POINTS = "pts AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS total FROM embeddings)"
TASKS = ", tp AS (SELECT id, x, total, (rn * 4 // total)::INT AS task0, rn FROM pts), pos AS (SELECT id, x, total, task0 AS task, rn - min(rn) OVER (PARTITION BY task0) AS pos, count(*) OVER (PARTITION BY task0) AS n FROM tp)"


def _start(model: str, k: int) -> str:
    if model == "fcm":
        return f"SELECT (j - 1)::INT AS j, list_transform(range(1, 65), lambda i: j::DOUBLE) AS c, NULL::DOUBLE[] AS v, NULL::DOUBLE AS p FROM range(1, {k + 1}) t(j)"
    return f"SELECT rn::INT AS j, x AS c, list_transform(x, lambda a: 1.0::DOUBLE) AS v, 1.0 / {k} AS p FROM pts WHERE rn < {k}"


def _project(model: str, s: int) -> str:
    d = f"d{s} AS (SELECT id, j, x, list_distance(x, c) AS d, v, p, c FROM pts CROSS JOIN c{s - 1})"
    if model == "kmeans":
        return f"{d}, q{s} AS (SELECT id, j, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY d, j) = 1 THEN 1.0 ELSE 0.0 END AS w, min(d) OVER (PARTITION BY id) AS o FROM d{s})"
    if model == "fcm":
        return f"{d}, u{s} AS (SELECT a.id, a.j, a.d, pow(1.0 / sum(pow(a.d / b.d, {E})), 1.1) AS w FROM d{s} a JOIN d{s} b ON a.id = b.id GROUP BY a.id, a.j, a.d), q{s} AS (SELECT id, j, w, sum(w * d * d) OVER (PARTITION BY id) AS o FROM u{s})"
    log = "ln(p) - 0.5 * (len(x) * ln(2 * pi()) + list_sum(list_transform(v, lambda a: ln(a))) + list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]) / v[i])))"
    return f"{d}, l{s} AS (SELECT id, j, {log} AS l FROM d{s}), m{s} AS (SELECT id, j, l, max(l) OVER (PARTITION BY id) AS top FROM l{s}), n{s} AS (SELECT id, j, l, top + ln(sum(exp(l - top)) OVER (PARTITION BY id)) AS o FROM m{s}), q{s} AS (SELECT id, j, exp(l - o) AS w, o FROM n{s})"


def fit_sql(model: str, k: int, windows: list[str | None]) -> str:
    """A WITH clause that ends in q<s> (projections), t<s> (state: id, j, w, o) and c<s> (parameters).
    ``windows``: for each update the condition of its window over (task, pos, n), or None for all."""
    parts = [POINTS + (TASKS if any(windows) else ""), f"c0 AS ({_start(model, k)})"]
    for s, window in enumerate(windows, 1):
        parts.append(_project(model, s))
        if window is None:
            parts.append(f"t{s} AS (SELECT id, j, w, o FROM q{s})")
        else:
            parts.append(f"t{s} AS (SELECT q.id, q.j, CASE WHEN {window} THEN q.w ELSE t.w END AS w, CASE WHEN {window} THEN q.o ELSE t.o END AS o FROM q{s} q JOIN t{s - 1} t ON q.id = t.id AND q.j = t.j JOIN pos ON pos.id = q.id)")
        parts.append(
            f"a{s} AS (SELECT t.j, i, sum(w * x[i]) AS sx, sum(w * x[i] * x[i]) AS ss, sum(w) AS r, count(*) AS n FROM t{s} t JOIN pts ON pts.id = t.id CROSS JOIN range(1, 65) g(i) GROUP BY t.j, i),"
            f" c{s} AS (SELECT j, list(sx / r ORDER BY i) AS c, list(ss / r - (sx / r) * (sx / r) ORDER BY i) AS v, max(r) / max(n) AS p FROM a{s} GROUP BY j)"
        )
    return "WITH " + ", ".join(parts) + " "


def trace_sql(model: str, k: int, windows: list[str | None], report: list[int]) -> str:
    """Objective of the reported updates, renumbered from 1."""
    value = "avg(o)" if model == "gmm" else "sum(o)"
    rows = " UNION ALL ".join(f"SELECT {n} AS superstep, round({value}, 4) AS objective FROM (SELECT DISTINCT id, o FROM t{s})" for n, s in enumerate(report, 1))
    return fit_sql(model, k, windows) + f"SELECT superstep::INT AS superstep, objective FROM ({rows})"
