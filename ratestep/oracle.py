"""Text of the SQL that the queries are compared with: the exact sums as chains of common table expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def lse(source: str, keys: str, value: str = "x") -> str:
    """Grouped log-sum-exp of a derived table."""
    return f"SELECT {keys}, any_value(mx) + ln(sum(exp({value} - mx))) AS v FROM (SELECT *, max({value}) OVER (PARTITION BY {keys}) AS mx FROM ({source})) GROUP BY {keys}"


DAILY = """
    types AS (SELECT DISTINCT event_type AS series_id FROM events WHERE event_type IS NOT NULL),
    counted AS (SELECT event_type AS series_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS k, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2),
    ser AS (SELECT types.series_id, r.k::INTEGER AS k, coalesce(y, 0.0)::DOUBLE AS y, 1.0::DOUBLE AS e
        FROM types CROSS JOIN (SELECT unnest(range(30)) AS k) r LEFT JOIN counted c ON c.series_id = types.series_id AND c.k = r.k),
    prior AS (SELECT series_id, 1.0::DOUBLE AS p1, 1.0 / (greatest(sum(y), 0.5) / sum(e)) AS p2 FROM ser GROUP BY 1)"""

HOURLY = """
    types AS (SELECT DISTINCT event_type AS series_id FROM events WHERE event_type IS NOT NULL),
    counted AS (SELECT event_type AS series_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS k, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2)"""

HOURS = HOURLY + """,
    ser AS (SELECT types.series_id, r.k::INTEGER AS k, coalesce(y, 0.0)::DOUBLE AS y, 1.0::DOUBLE AS e
        FROM types CROSS JOIN (SELECT unnest(range(720)) AS k) r LEFT JOIN counted c ON c.series_id = types.series_id AND c.k = r.k),
    prior AS (SELECT series_id, 1.0::DOUBLE AS p1, 1.0 / (greatest(sum(y), 0.5) / sum(e)) AS p2 FROM ser GROUP BY 1)"""

FOLDED = HOURLY + """,
    flat AS (SELECT types.series_id, r.k::INTEGER AS k, coalesce(y, 0.0)::DOUBLE AS y, 1.0::DOUBLE AS e
        FROM types CROSS JOIN (SELECT unnest(range(720)) AS k) r LEFT JOIN counted c ON c.series_id = types.series_id AND c.k = r.k),
    ser AS (SELECT series_id, k % 24 AS k, sum(y) AS y, sum(e) AS e FROM flat GROUP BY 1, 2),
    prior AS (SELECT series_id, 1.0::DOUBLE AS p1, 1.0 / (greatest(sum(y), 0.5) / sum(e)) AS p2 FROM ser GROUP BY 1)"""

USERS = """
    once AS (SELECT DISTINCT lpad(user_id::VARCHAR, 12, '0') || strftime(ts, '-%Y-%m-%d') AS trial, hour(ts)::INTEGER AS k FROM events WHERE user_id IS NOT NULL),
    users AS (SELECT trial, row_number() OVER (ORDER BY trial) AS r FROM (SELECT DISTINCT trial FROM once))"""


def user_series(name: str, where: str) -> str:
    return f"""
    {name}n AS (SELECT count(*) AS n FROM users WHERE {where}),
    {name} AS (SELECT 'users' AS series_id, r.k::INTEGER AS k, coalesce(s, 0)::DOUBLE AS y, (n - coalesce(s, 0))::DOUBLE AS e
        FROM (SELECT unnest(range(24)) AS k) r CROSS JOIN {name}n
        LEFT JOIN (SELECT k, count(*) AS s FROM once JOIN users USING (trial) WHERE {where} GROUP BY 1) c ON c.k = r.k)"""


@dataclass
class Chain:
    """CTEs of one set of series: bins, forward and backward sums, evidences. ``ser`` has series_id, k, y, e (s, g for Bernoulli)."""

    T: int
    M: int
    kind: str = "poisson"
    ser: str = "ser"
    prior: str = "prior"
    p: str = ""
    ctes: list[str] = field(default_factory=list)

    def bins(self) -> Chain:
        p = self.p
        self.ctes.append(f"""{p}pre AS (SELECT s.series_id, k, y, e, p1, p2, sum(y) OVER w AS c1, sum(e) OVER w AS c2 FROM {self.ser} s JOIN {self.prior} USING (series_id)
            WINDOW w AS (PARTITION BY s.series_id ORDER BY k ROWS UNBOUNDED PRECEDING))""")
        ev = {"poisson": "p1 * ln(p2) - lgamma(p1) + lgamma(n1) - n1 * ln(n2)", "bernoulli": "lgamma(p1 + p2) - lgamma(p1) - lgamma(p2) + lgamma(n1) + lgamma(n2) - lgamma(n1 + n2)"}[self.kind]
        m1, m2 = {"poisson": ("n1 / n2", "n1 * (n1 + 1) / (n2 * n2)"), "bernoulli": ("n1 / (n1 + n2)", "n1 * (n1 + 1) / ((n1 + n2) * (n1 + n2 + 1))")}[self.kind]
        self.ctes.append(f"""{p}tot AS (SELECT x.series_id, x.k AS a, z.k AS b, z.c1 - x.c1 + x.y + x.p1 AS n1, z.c2 - x.c2 + x.e + x.p2 AS n2, x.p1, x.p2
            FROM {p}pre x JOIN {p}pre z ON x.series_id = z.series_id AND x.k <= z.k)""")
        self.ctes.append(f"{p}bins AS MATERIALIZED (SELECT series_id, a, b, n1, n2, {ev} AS l, {m1} AS m1, {m2} AS m2 FROM {p}tot)")
        return self

    def forward(self, name: str = "f", weight: str = "l", bins: str | None = None, M: int | None = None) -> Chain:
        p, b = self.p, bins or f"{self.p}bins"
        self.ctes.append(f"{p}{name}0 AS (SELECT series_id, b AS k, {weight} AS v FROM {b} WHERE a = 0)")
        for m in range(1, (self.M if M is None else M) + 1):
            src = f"SELECT q.series_id, q.b AS k, f.v + q.{weight} AS x FROM {p}{name}{m - 1} f JOIN {b} q ON q.series_id = f.series_id AND q.a = f.k + 1"
            self.ctes.append(f"{p}{name}{m} AS MATERIALIZED ({lse(src, 'series_id, k')})")
        return self

    def backward(self) -> Chain:
        p = self.p
        self.ctes.append(f"{p}g0 AS (SELECT series_id, a - 1 AS k, l AS v FROM {p}bins WHERE b = {self.T - 1} AND a > 0)")
        for m in range(1, self.M + 1):
            src = f"SELECT q.series_id, q.a - 1 AS k, g.v + q.l AS x FROM {p}g{m - 1} g JOIN {p}bins q ON q.series_id = g.series_id AND q.b = g.k WHERE q.a > 0"
            self.ctes.append(f"{p}g{m} AS MATERIALIZED ({lse(src, 'series_id, k')})")
        return self

    def evidences(self) -> Chain:
        p, n = self.p, self.T - 1
        const = f"SELECT series_id, sum(CASE WHEN y > 0 THEN y * ln(e) ELSE 0 END - lgamma(y + 1)) AS c FROM {self.ser} GROUP BY 1" if self.kind == "poisson" else f"SELECT DISTINCT series_id, 0.0::DOUBLE AS c FROM {self.ser}"
        self.ctes.append(f"{p}con AS ({const})")
        parts = " UNION ALL ".join(f"SELECT series_id, {m} AS m, v AS last, v - (lgamma({n + 1}) - lgamma({m + 1}) - lgamma({n - m + 1})) AS u FROM {p}f{m} WHERE k = {n}" for m in range(self.M + 1))
        self.ctes.append(f"{p}ev AS (SELECT series_id, m, last, u + c AS ev FROM ({parts}) JOIN {p}con USING (series_id))")
        self.ctes.append(f"""{p}post AS (SELECT series_id, m, last, ev, mx + ln(s) AS total, exp(ev - mx - ln(s)) AS p FROM (
            SELECT *, sum(exp(ev - mx)) OVER (PARTITION BY series_id) AS s FROM (SELECT *, max(ev) OVER (PARTITION BY series_id) AS mx FROM {p}ev)))""")
        return self

    def bin_posterior(self, least: float = 1e-12, weights: bool = True) -> Chain:
        """``weights`` False: a table c (series_id, m, c) and one row for m = 0 in post are there already."""
        p = self.p
        if weights:
            self.ctes.append(f"{p}c AS (SELECT series_id, m, ln(p / sum(p) OVER (PARTITION BY series_id)) - last AS c FROM {p}post WHERE p >= {least})")
        left = f"SELECT series_id, 0 AS i, 0 AS a, 0.0::DOUBLE AS v FROM {p}post WHERE m = 0"
        right = f"SELECT series_id, 0 AS j, {self.T - 1} AS b, 0.0::DOUBLE AS v FROM {p}post WHERE m = 0"
        for m in range(1, self.M + 1):
            left += f" UNION ALL SELECT series_id, {m}, k + 1, v FROM {p}f{m - 1} WHERE k < {self.T - 1}"
            right += f" UNION ALL SELECT series_id, {m}, k, v FROM {p}g{m - 1}"
        self.ctes += [f"{p}lft AS ({left})", f"{p}rgt AS ({right})"]
        src = f"SELECT r.series_id, c.m - r.j AS i, r.b, c.c + r.v AS x FROM {p}rgt r JOIN {p}c c ON c.series_id = r.series_id AND c.m >= r.j"
        self.ctes.append(f"{p}fold AS MATERIALIZED ({lse(src, 'series_id, i, b')})")
        src = f"""SELECT q.series_id, q.a, q.b, l.v + r.v + q.l AS x FROM {p}bins q JOIN {p}lft l ON l.series_id = q.series_id AND l.a = q.a
            JOIN {p}fold r ON r.series_id = q.series_id AND r.b = q.b AND r.i = l.i"""
        self.ctes.append(f"{p}w AS MATERIALIZED (SELECT z.series_id, z.a, z.b, exp(z.v) AS w, q.m1, q.m2, q.n1, q.n2 FROM ({lse(src, 'series_id, a, b')}) z JOIN {p}bins q ON q.series_id = z.series_id AND q.a = z.a AND q.b = z.b)")
        return self

    def rates(self) -> Chain:
        p = self.p
        self.ctes.append(f"""{p}rates AS (SELECT s.series_id, s.k, sum(w * m1) / sum(w) AS rate, sqrt(greatest(sum(w * m2) / sum(w) - (sum(w * m1) / sum(w)) * (sum(w * m1) / sum(w)), 0)) AS rate_std,
            CASE WHEN s.k < {self.T - 1} THEN sum(CASE WHEN b = s.k THEN w ELSE 0 END) END AS p_boundary
            FROM {self.ser} s JOIN {p}w q ON q.series_id = s.series_id AND q.a <= s.k AND q.b >= s.k GROUP BY 1, 2)""")
        return self


def full(T: int, M: int, kind: str = "poisson", **kw) -> Chain:
    return Chain(T, M, kind, **kw).bins().forward().backward().evidences().bin_posterior().rates()


def query(*parts: str | Chain, select: str, recursive: bool = False) -> str:
    texts = [x.strip() if isinstance(x, str) else ",\n    ".join(x.ctes) for x in parts if x]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n    ".join(texts) + "\n" + select


def gamma_tail(level: float) -> str:
    """P(rate > level) of a bin with a whole shape n1: a Poisson sum."""
    return f"list_sum(list_transform(range(n1::BIGINT), lambda j: exp(j * ln(n2 * {level}) - n2 * {level} - lgamma(j + 1))))"
