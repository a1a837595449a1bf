"""DuckDB/ANSI SQL equivalents of the registered queries (the correctness oracle).

Built from reusable CTEs so every oracle reads the same supplied tables.
"""

from __future__ import annotations

from ..functions.expressions import REPUTATION_SCORES, SNAP_SHIFT
from ..operators.features import FEATURES
from ..sources.listings import LISTINGS_SQL

REP_CASE = "CASE seller_reputation " + " ".join(
    f"WHEN '{k}' THEN {float(v)}" for k, v in REPUTATION_SCORES.items()) + " END"

CTE = {}
CTE["listings"] = LISTINGS_SQL
CTE["lf"] = f"""
SELECT *,
  CASE WHEN regular_price IS NULL OR regular_price = 0 THEN CAST(0 AS DOUBLE)
       ELSE (regular_price - price) / regular_price END AS discount_pct,
  CAST(length(titulo) AS DOUBLE) AS title_len,
  CAST(COALESCE({REP_CASE}, 0) AS DOUBLE) AS rep_score
FROM listings"""
CTE["sf"] = """
SELECT seller_nickname,
  CAST(COUNT(DISTINCT category_id) AS DOUBLE) AS categorias_distintas,
  AVG(ln(1 + price)) AS log_price_avg,
  AVG(ln(1 + CAST(stock AS DOUBLE))) AS log_stock_avg,
  CAST(COUNT(*) AS DOUBLE) AS num_publicaciones,
  AVG(discount_pct) AS porc_descuento,
  AVG(CAST(is_refurbished AS DOUBLE)) AS proporcion_refurb,
  AVG(CASE WHEN condition = 'used' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS proporcion_usados,
  AVG(rep_score) AS rep_score,
  AVG(title_len) AS titulo_length_avg
FROM lf WHERE seller_nickname IS NOT NULL GROUP BY seller_nickname"""
CTE["qp"] = "SELECT " + ",\n  ".join(
    f"quantile_cont({f}, {p}) AS {f}__{n}" for f in FEATURES for p, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))
) + " FROM sf"
CTE["sp"] = "SELECT " + ",\n  ".join(
    f"{f}__median, {f}__q25, {f}__q75, CASE WHEN {f}__q75 - {f}__q25 = 0 OR {f}__q75 - {f}__q25 IS NULL THEN CAST(1 AS DOUBLE) ELSE {f}__q75 - {f}__q25 END AS {f}__scale"
    for f in FEATURES) + " FROM qp"
CTE["imputed"] = "SELECT seller_nickname, " + ", ".join(
    f"COALESCE({f}, {f}__median) AS {f}" for f in FEATURES) + " FROM sf CROSS JOIN sp"
CTE["scaled"] = "SELECT seller_nickname, " + ", ".join(
    f"(COALESCE({f}, {f}__median) - {f}__median) / {f}__scale AS {f}" for f in FEATURES) + " FROM sf CROSS JOIN sp"
CTE["cents"] = "\nUNION ALL\n".join(
    f"SELECT {i} AS cluster_id, " + ", ".join(f"quantile_cont({f}, {p}) AS {f}" for f in FEATURES) + " FROM scaled"
    for i, p in enumerate((0.1, 0.5, 0.9)))


def _dist(i: int) -> str:
    return " + ".join(f"(s.{f} - c{i}.{f}) * (s.{f} - c{i}.{f})" for f in FEATURES)


CTE["dist"] = ("SELECT s.*, " + ", ".join(f"{_dist(i)} AS d{i}" for i in range(3)) +
               " FROM scaled s " + " ".join(f"CROSS JOIN (SELECT * FROM cents WHERE cluster_id = {i}) c{i}" for i in range(3)))
CTE["assigned"] = """
SELECT *, CASE WHEN d0 <= least(d0, d1, d2) THEN 0 WHEN d1 <= least(d0, d1, d2) THEN 1 ELSE 2 END AS cluster_id,
  least(d0, d1, d2) AS distance2
FROM dist"""

ORDER = ["listings", "lf", "sf", "qp", "sp", "imputed", "scaled", "cents", "dist", "assigned"]


def with_ctes(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with every CTE it (transitively, by name) refers to."""
    import re
    defs = dict(CTE)
    names = list(ORDER)
    for n, sql in extra:
        defs[n] = sql
        names.append(n)
    text = body + " " + " ".join(sql for _, sql in extra)
    needed = set()
    changed = True
    while changed:
        changed = False
        for n in names:
            if n not in needed and re.search(rf"\b{n}\b", text):
                needed.add(n)
                text += " " + defs[n]
                changed = True
    parts = [f"{n} AS ({defs[n]})" for n in names if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def snap(expr: str, bits: int = 20) -> str:
    """Same IEEE steps as ``functions.expressions.snap`` (grid 2^-bits, large values as they are)."""
    f, x = 2 ** bits, f"CAST({expr} AS DOUBLE)"
    shift = f"CAST({int(SNAP_SHIFT)} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < CAST({2 ** (51 - bits)} AS DOUBLE) THEN "
            f"({x} * CAST({f} AS DOUBLE) + {shift} - {shift}) / CAST({f} AS DOUBLE) ELSE {x} END)")


def rnd(expr: str, alias: str, bits: int = 20) -> str:
    return f"{snap(expr, bits)} AS {alias}"
