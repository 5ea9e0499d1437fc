"""Rasters, polygons and objects derived from the star-schema tables, as DataFrames and as SQL for the twins.

There are no images in the tables, so pixels are sums over line items: maps of 32 x 32, one for each MAP_ROWS of them and
three at least, so that pixels grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, LEAST_MAPS, MAP_ROWS = 32, 3, 6000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, y, x, r, g, b, m, gt): a dense raster, its predicted mask and the true one."""
    items = table(spark, sf_dir, "lineitem")
    maps = max(LEAST_MAPS, items.count() // MAP_ROWS)  # the files' own counts
    at = [(F.col(c) % n).cast("int").alias(k) for c, n, k in (("l_suppkey", maps, "map_id"), ("l_orderkey", SIDE, "y"), ("l_partkey", SIDE, "x"))]
    keys = ["map_id", "y", "x"]
    sums = items.select(*at, "l_quantity", "l_linenumber").groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("q"), F.sum(F.col("l_linenumber") * 37).cast("long").alias("s"), F.count("*").alias("n"))
    i = F.col("id")
    grid = spark.range(maps * SIDE * SIDE).select(F.floor(i / SIDE**2).cast("int").alias("map_id"), (F.floor(i / SIDE) % SIDE).cast("int").alias("y"), (i % SIDE).cast("int").alias("x"))
    band = lambda c: F.coalesce(c, F.lit(255)).cast("int")
    flag = lambda n: F.coalesce(F.col("q") % n < 40, F.lit(False))
    return grid.join(sums, keys, "left").select(*keys, band(F.col("q") % 256).alias("r"), band(F.col("s") % 256).alias("g"), band(F.col("n") * 16 % 256).alias("b"), flag(97).alias("m"), flag(89).alias("gt"))


PX = f"""
maps AS MATERIALIZED (SELECT greatest({LEAST_MAPS}, count(*) // {MAP_ROWS}) AS k FROM lineitem),
grid AS (SELECT CAST(i // {SIDE**2} AS INT) AS map_id, CAST((i // {SIDE}) % {SIDE} AS INT) AS y, CAST(i % {SIDE} AS INT) AS x FROM (SELECT unnest(range(k * {SIDE * SIDE})) AS i FROM maps)),
sums AS (SELECT CAST(l_suppkey % (SELECT k FROM maps) AS INT) AS map_id, CAST(l_orderkey % {SIDE} AS INT) AS y, CAST(l_partkey % {SIDE} AS INT) AS x,
  CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(l_linenumber * 37) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
px AS MATERIALIZED (SELECT map_id, y, x, CAST(coalesce(q % 256, 255) AS INT) AS r, CAST(coalesce(s % 256, 255) AS INT) AS g, CAST(coalesce(n * 16 % 256, 255) AS INT) AS b,
  coalesce(q % 97 < 40, false) AS m, coalesce(q % 89 < 40, false) AS gt FROM grid LEFT JOIN sums USING (map_id, y, x))"""


def on_px(sql: str) -> str:
    return f"WITH RECURSIVE {PX}{',' if not sql.lstrip().upper().startswith('SELECT') else ''} {sql}"


def blocks(df: DataFrame, flag: str, shift: int) -> DataFrame:
    """(map_id, y, x, label): the flagged pixels, labelled by blocks of 5 x 5 that begin `shift` columns earlier."""
    return df.where(flag).select("map_id", "y", "x", (F.floor(F.col("y") / 5) * 100 + F.floor((F.col("x") + shift) / 5) + 1).cast("long").alias("label"))


BLOCKS = """p AS (SELECT map_id, y, x, CAST(y // 5 * 100 + x // 5 + 1 AS BIGINT) AS label FROM px WHERE m),
t AS (SELECT map_id, y, x, CAST(y // 5 * 100 + (x + 1) // 5 + 1 AS BIGINT) AS label FROM px WHERE gt)"""


def labelled_sql(flag: str, diagonal: bool, name: str = "labelled") -> str:
    """The components of the pixels for which flag holds, by reachability; a pixel is known by y * 2**24 + x."""
    near = "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"""{name}_p AS MATERIALIZED (SELECT map_id, y, x, CAST(y AS BIGINT) * 16777216 + x AS id FROM px WHERE {flag}),
{name}_e AS MATERIALIZED (SELECT a.map_id, a.id AS a, b.id AS b FROM {name}_p a JOIN {name}_p b ON a.map_id = b.map_id AND {near}),
{name}_r AS (SELECT map_id, id, id AS l FROM {name}_p UNION SELECT e.map_id, e.b, r.l FROM {name}_r r JOIN {name}_e e ON e.map_id = r.map_id AND e.a = r.id WHERE r.l < e.b),
{name} AS MATERIALIZED (SELECT p.map_id, p.y, p.x, r.l AS label FROM {name}_p p JOIN (SELECT map_id, id, min(l) AS l FROM {name}_r GROUP BY 1, 2) r USING (map_id, id))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, poly, x, y): customers as points with whole coordinates, by nation."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_nationkey").alias("poly"), F.floor(F.col("c_acctbal") / 10).cast("long").alias("x"), (c * 7919 % 1000).alias("y"))


PTS = "pts AS MATERIALIZED (SELECT c_custkey AS id, c_nationkey AS poly, CAST(floor(c_acctbal / 10) AS BIGINT) AS x, c_custkey * 7919 % 1000 AS y FROM customer)"
#: Rings: the points by their angle around the mean; seq from 0, and the next vertex.
RING = PTS + """,
seqs AS (SELECT id, p.poly, x, y, row_number() OVER (PARTITION BY p.poly ORDER BY atan2(y - my, x - mx), id) - 1 AS seq FROM pts p JOIN (SELECT poly, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY 1) c ON p.poly = c.poly),
ring AS MATERIALIZED (SELECT poly, seq, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM seqs WINDOW w AS (PARTITION BY poly ORDER BY seq))"""
HULL = """hull AS MATERIALIZED (SELECT a.poly, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM (SELECT DISTINCT poly, x, y FROM pts) a JOIN (SELECT DISTINCT poly, x, y FROM pts) b ON a.poly = b.poly AND (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.poly = a.poly AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND ((c.x - a.x) * (c.x - b.x) > 0 OR (c.y - a.y) * (c.y - b.y) > 0)))))"""


def star_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly, ring): each nation's points by their angle around the mean."""
    from ..operators.geometry import rings_of

    pts = points(spark, sf_dir)
    centre = pts.groupBy("poly").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    placed = pts.join(centre, "poly").withColumn("angle", F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")))
    return rings_of(placed, ["poly"], [F.col("angle"), F.col("id")])
