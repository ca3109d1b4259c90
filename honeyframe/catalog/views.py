"""The stand-in tables as DuckDB common table expressions."""

PX = """px AS (
  SELECT frame_id, grp, pos, pos % 8 AS q, pos // 8 AS r,
         CAST(floor(abs(CAST(v AS DOUBLE)) * 20) AS BIGINT) AS value,
         CAST(CASE WHEN v < -0.25 THEN 16 WHEN v > 0.25 THEN 4 ELSE 1 END AS BIGINT) AS mask
  FROM (SELECT vec_id AS frame_id, label AS grp,
               CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
               unnest(embedding) AS v FROM embeddings))"""

HX = PX + """,
hx0 AS (SELECT *, q - (r - r % 2) // 2 - 2 AS x, r - 4 AS z FROM px),
hx AS (SELECT *, -x - z AS y,
         CAST(row_number() OVER (PARTITION BY frame_id ORDER BY x, z) - 1 AS BIGINT) AS hp
       FROM hx0 WHERE x >= -4 AND x < 4 AND -x - z > -4 AND -x - z <= 4 AND z >= -4 AND z < 4)"""

EV = """ev AS (
  SELECT user_id AS line,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
         value FROM events)"""

PT = """pt AS (
  SELECT o_orderkey AS id, (o_orderkey * 7919 % 1009) / 10.0::DOUBLE AS x,
         (o_orderkey * 104729 % 997) / 10.0::DOUBLE AS y,
         CAST(floor(o_totalprice / 10000) AS BIGINT) AS w FROM orders)"""

RP = """rp AS (
  SELECT *, hex_avg * contrast AS hex_std FROM (
  SELECT o_orderkey AS frame_id, o_orderpriority AS grp,
         concat(CAST(o_orderkey AS VARCHAR), '_', CAST(o_custkey AS VARCHAR), '_', '7.tif') AS label,
         o_totalprice / 10000 AS hex_merit, o_totalprice / 1000 AS hex_avg,
         (o_custkey % 50) / 100.0::DOUBLE AS contrast,
         (o_orderkey % 360 - 180) * pi() / 180 AS tilt, o_custkey % 13 AS n_sf FROM orders))"""

# The twelve operations for bond length 4 on radius 4 (one lattice point).
SYM12 = """sym AS (
  SELECT CAST(s AS BIGINT) AS sym, CAST(s % 6 AS BIGINT) AS rot, CAST(s // 6 AS BIGINT) AS mirror
  FROM range(12) t(s))"""

MODELS = """models AS (
  SELECT CAST(grp AS BIGINT) AS m, hp, least(15, CAST(round(avg(value) * 3) AS BIGINT)) AS level
  FROM hx GROUP BY ALL)"""


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def wrap_home(src: str, n: int, cols: str, x: str = "x", z: str = "z") -> str:
    """SELECT that folds (x, z) of ``src`` home by trying every near shift."""
    return f"""SELECT {cols}, {x} + shx AS wx, {z} + shz AS wz
      FROM {src}, (SELECT {n} * (2 * i - j) AS shx, {n} * (2 * j - i) AS shz
                   FROM range(-4, 5) a(i), range(-4, 5) b(j)) shifts
      WHERE {x} + shx >= -{n} AND {x} + shx < {n} AND {z} + shz >= -{n} AND {z} + shz < {n}
        AND -({x} + shx) - ({z} + shz) > -{n} AND -({x} + shx) - ({z} + shz) <= {n}"""
