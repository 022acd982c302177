"""How the driver tables stand in for telemetry, and the same bindings as SQL text.

Operators are generic over (entity, cycle, point); a binding only renames and
scales columns of a given table, row by row.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resampling import poisson_thresholds

HORIZONS = [5, 10, 20, 30]
NOMINAL = 1.1
CURVE_POINTS = 64


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that engines agree on the last digits of sums."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(covers: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query under its function name; ``doubles`` names the columns the SQL must round."""

    def register(fn):
        text = None
        if sql is not None:
            cols = doubles.split()
            rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
            text = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) result" if cols else sql
        REGISTRY[fn.__name__] = Query(fn.__name__, lambda spark, sf: tidy(fn(spark, sf), digits), text, covers)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------- entity series

SERIES_SQL = """ev AS (
  SELECT user_id, event_id, event_type, value, count(*) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cycle_idx
  FROM events),
series AS (
  SELECT user_id AS cell_id, event_id, cycle_idx,
    1.1 - value / 1013.7 AS qd, 1.1 - value / 1013.7 + 0.001 * (event_id % 7) AS qc,
    CASE WHEN event_type = 'error' THEN 0.0 ELSE 0.01 + value / 20306.1 END AS ir,
    20.0 + value / 30.7 AS t_bml_chg, 30.0 + value / 25.3 AS t_chg, 15.0 + value / 60.9 AS t_dis, 5.0 + value / 91.3 AS t_cv,
    3.0 + value / 41.1 AS t_rest, 3.3 - value / 907.3 AS e_dis, 3.5 + value / 811.3 AS e_chg, 3.0 + value / 709.3 AS v_dis_avg,
    4.0 + value / 203.3 AS i_chg_mean, 0.1 + value / 307.3 AS i_chg_std, 5.0 + value / 103.7 AS i_max,
    30.0 + value / 53.3 AS temp_mean, 31.0 + value / 53.3 + event_id % 5 AS temp_max, 29.0 + value / 53.3 - event_id % 3 AS temp_min
  FROM ev)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """One event = one cycle of the user; all events. A query with a horizon filters by ``cycle_idx`` itself."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    ev = ev.withColumn("rn", F.row_number().over(w))
    v, k = F.col("value"), F.col("event_id")
    return ev.select(
        F.col("user_id").alias("cell_id"), "event_id", (F.col("rn") - 1).alias("cycle_idx"),
        (1.1 - v / 1013.7).alias("qd"), (1.1 - v / 1013.7 + 0.001 * (k % 7)).alias("qc"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(0.01 + v / 20306.1).alias("ir"),
        (20.0 + v / 30.7).alias("t_bml_chg"), (30.0 + v / 25.3).alias("t_chg"), (15.0 + v / 60.9).alias("t_dis"), (5.0 + v / 91.3).alias("t_cv"),
        (3.0 + v / 41.1).alias("t_rest"), (3.3 - v / 907.3).alias("e_dis"), (3.5 + v / 811.3).alias("e_chg"), (3.0 + v / 709.3).alias("v_dis_avg"),
        (4.0 + v / 203.3).alias("i_chg_mean"), (0.1 + v / 307.3).alias("i_chg_std"), (5.0 + v / 103.7).alias("i_max"),
        (30.0 + v / 53.3).alias("temp_mean"), (31.0 + v / 53.3 + k % 5).alias("temp_max"), (29.0 + v / 53.3 - k % 3).alias("temp_min"),
    )


CURVED_SQL = SERIES_SQL + """,
curved AS (
  SELECT s.*, e.embedding AS qdlin FROM series s, (SELECT max(vec_id) + 1 AS n FROM embeddings) m, embeddings e
  WHERE e.vec_id = s.event_id % m.n)"""


def curved_series(spark: SparkSession, sf: str) -> DataFrame:
    """The series with one embedding per cycle as its discharge curve."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("qdlin"))
    n = emb.agg((F.max("vec_id") + 1).alias("n"))  # one row
    s = series(spark, sf).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("event_id") % F.col("n"))
    return s.join(emb, "vec_id").drop("vec_id", "n")


# ------------------------------------------------------------- points

POINTS_SQL = """pts AS (
  SELECT user_id AS cell_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 604800000000.0) AS INTEGER) AS cycle_idx,
    event_id AS pt_idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0 AS t,
    CASE event_type WHEN 'view' THEN 1.0 + value / 103.7 WHEN 'purchase' THEN -1.0 - value / 103.7
      WHEN 'click' THEN value / 2011.7 WHEN 'error' THEN -value / 103.7 ELSE value / 103.7 END AS i,
    3.0 + (value % 80.0) / 101.3 AS v, 25.0 + value / 20.9 AS temp, value / 103.7 AS qd, value / 91.7 AS qc
  FROM events)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One event = one point; a week of a user = one cycle."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    v, e = F.col("value"), F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("cell_id"), F.floor(us / 604800000000.0).cast("int").alias("cycle_idx"), F.col("event_id").alias("pt_idx"),
        (us / 60000000.0).alias("t"),
        F.when(e == "view", 1.0 + v / 103.7).when(e == "purchase", -1.0 - v / 103.7).when(e == "click", v / 2011.7)
        .when(e == "error", -v / 103.7).otherwise(v / 103.7).alias("i"),
        (3.0 + (v % 80.0) / 101.3).alias("v"), (25.0 + v / 20.9).alias("temp"), (v / 103.7).alias("qd"), (v / 91.7).alias("qc"),
    )


# ------------------------------------------------------------- curves

PAIRS_SQL = """pairs AS (
  SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS late, list_transform(b.embedding, lambda x: x::DOUBLE) AS early
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)"""


def curve_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring embeddings as the late and the early curve of one entity."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("late"))
    prev = emb.select((F.col("vec_id") + 1).alias("vec_id"), F.col("late").alias("early"))
    return emb.join(prev, "vec_id")


def smooth_sql(c: str, half: int = 10) -> str:
    return (
        f"list_transform(range(1, len({c}) + 1), lambda i: list_median({c}[greatest(1, i - {half}):least(len({c}), i + {half})]))"
    )


# ------------------------------------------------------------- entities and predictions

CELLS_SQL = """cells AS (
  SELECT c_custkey AS cell_id, c_acctbal + 2000.0 AS life, c_mktsegment AS protocol,
    CASE WHEN c_custkey % 2 = 1 THEN 'train' ELSE 'test' END AS partition
  FROM customer)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cell_id"), (F.col("c_acctbal") + 2000.0).alias("life"), F.col("c_mktsegment").alias("protocol"),
        F.when(F.col("c_custkey") % 2 == 1, "train").otherwise("test").alias("partition"),
    )


# two seeds and three formula models per order
PREDS_SQL = """preds AS (
  SELECT o_orderkey AS cell_id, seed, model, o_totalprice / 103.7 + 101.0 AS y_true,
    (CASE model WHEN 'a' THEN (o_totalprice / 103.7 + 101.0) * (0.9137 + (o_orderkey % 7) / 41.3)
      WHEN 'b' THEN 700.0 + 0.4537 * (o_totalprice / 103.7) + 10.37 * (o_custkey % 11)
      ELSE 0.8171 * (o_totalprice / 103.7) + 300.0 - 25.13 * (o_orderkey % 5) END) * (1.0 + seed / 53.7) AS y_pred,
    o_orderpriority AS protocol
  FROM orders, (VALUES (0), (1)) s(seed), (VALUES ('a'), ('b'), ('c')) m(model))"""
MODELS = ["a", "b", "c"]


def preds(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    rows = o.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    x, k = F.col("o_totalprice") / 103.7, F.col("o_orderkey")
    p = (
        F.when(F.col("model") == "a", (x + 101.0) * (0.9137 + (k % 7) / 41.3))
        .when(F.col("model") == "b", 700.0 + 0.4537 * x + 10.37 * (F.col("o_custkey") % 11))
        .otherwise(0.8171 * x + 300.0 - 25.13 * (k % 5))
    )
    return rows.select(
        k.alias("cell_id"), "seed", "model", (x + 101.0).alias("y_true"), (p * (1.0 + F.col("seed") / 53.7)).alias("y_pred"),
        F.col("o_orderpriority").alias("protocol"),
    )


ALARMS_SQL = """alarms AS (
  SELECT d.doc_id AS cell_id, d.lang, d.n_chars, d.n_chars / (d.n_chars + 900.0) AS p_fail, -(d.n_chars / (d.n_chars + 900.0)) AS score,
    l.toxic = 1 AS early_failure, l.quality = 1 AS good, d.doc_id % 5 AS fold
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def alarms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a class label; the failure probability is a formula of the length."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    p = F.col("n_chars") / (F.col("n_chars") + 900.0)
    return d.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("cell_id"), "lang", "n_chars", p.alias("p_fail"), (-p).alias("score"),
        (F.col("toxic") == 1).alias("early_failure"), (F.col("quality") == 1).alias("good"), (F.col("doc_id") % 5).alias("fold"),
    )


# fail/pass sets at checkpoints: formulas of the failure probability and the checkpoint
CHECKPOINTS = [5, 10, 20, 50]
POLICIES = {"every_checkpoint": [5, 10, 20, 50], "from_20": [20, 50], "single_50": [50]}
SETS_SQL = ALARMS_SQL + """,
sets AS (
  SELECT cell_id, repeat, T, 200.0 + n_chars AS y_true, early_failure, alpha,
    p_fail + (cell_id * 7 + T * 3 + repeat * 5) % 13 / 26.0 > 0.75 - 0.004 * T + alpha AS fail_in_set,
    p_fail - (cell_id * 5 + T + repeat * 3) % 11 / 22.0 < 0.55 - alpha AS pass_in_set
  FROM alarms, (VALUES (5), (10), (20), (50)) c(T), (VALUES (0.05), (0.2)) a(alpha), (VALUES (0), (1)) r(repeat)),
pol(policy, T) AS (VALUES ('every_checkpoint', 5), ('every_checkpoint', 10), ('every_checkpoint', 20), ('every_checkpoint', 50),
  ('from_20', 20), ('from_20', 50), ('single_50', 50))"""


def decision_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = alarms(spark, sf)
    for name, values in (("T", CHECKPOINTS), ("alpha", [0.05, 0.2]), ("repeat", [0, 1])):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    k, t, r, a = F.col("cell_id"), F.col("T"), F.col("repeat"), F.col("alpha")
    mille = F.round(1000 * a)  # bounds are decimals: summed as doubles, 0.75 - 0.2 + 0.05 lies above 0.6
    return rows.select(
        "cell_id", "repeat", "T", (200.0 + F.col("n_chars")).alias("y_true"), "early_failure", "alpha",
        (F.col("p_fail") + (k * 7 + t * 3 + r * 5) % 13 / 26.0 > (750 - 4 * t + mille) / 1000).alias("fail_in_set"),
        (F.col("p_fail") - (k * 5 + t + r * 3) % 11 / 22.0 < (550 - mille) / 1000).alias("pass_in_set"),
    )


# attribution rows: fixed weights over line items
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
FEATURE_GROUPS = {"volume": ["l_quantity", "l_extendedprice"], "terms": ["l_discount"], "charge_proxy": ["l_tax"]}
GROUPS_SQL = """grp_map(feature, grp) AS (VALUES ('l_quantity', 'volume'), ('l_extendedprice', 'volume'), ('l_discount', 'terms'), ('l_tax', 'charge_proxy'))"""
PHI_SQL = """wts(model, feature, w) AS (VALUES
  ('m1', 'l_quantity', -0.004), ('m1', 'l_discount', 1.5), ('m1', 'l_tax', 2.0), ('m1', 'l_extendedprice', -0.000003),
  ('m2', 'l_quantity', 0.006), ('m2', 'l_discount', -2.0), ('m2', 'l_tax', 1.0), ('m2', 'l_extendedprice', -0.000006)),
mu AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, avg(l_extendedprice) AS d FROM lineitem),
items AS (SELECT l_orderkey, l_linenumber, l_returnflag, u.feature, u.value, u.mean
  FROM lineitem, mu, LATERAL (VALUES ('l_quantity', l_quantity, a), ('l_discount', l_discount, b), ('l_tax', l_tax, c),
    ('l_extendedprice', l_extendedprice, d)) u(feature, value, mean)),
phi AS (SELECT w.model, i.l_returnflag AS source, i.l_orderkey, i.l_linenumber, i.feature, i.value, w.w * (i.value - i.mean) AS phi
  FROM items i JOIN wts w ON w.feature = i.feature)"""
LINEAR_WEIGHTS = {
    "m1": {"l_quantity": -0.004, "l_discount": 1.5, "l_tax": 2.0, "l_extendedprice": -0.000003},
    "m2": {"l_quantity": 0.006, "l_discount": -2.0, "l_tax": 1.0, "l_extendedprice": -0.000006},
}


def phi_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Exact linear attribution of two fixed models; the return flag plays the run source."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *FEATURES)
    mu = li.agg(*[F.avg(f).alias(f"mean_{f}") for f in FEATURES])  # one row
    parts = [
        F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.col(f).alias("value"),
                 (F.lit(w) * (F.col(f) - F.col(f"mean_{f}"))).alias("phi"))
        for m, ws in LINEAR_WEIGHTS.items() for f, w in ws.items()
    ]
    return li.crossJoin(F.broadcast(mu)).select(
        F.col("l_returnflag").alias("source"), "l_orderkey", "l_linenumber", F.inline(F.array(*parts))
    ).select("model", "source", "l_orderkey", "l_linenumber", "feature", "value", "phi")


PHI_COLUMNS = {(m, f): f"phi_{m}_{f}" for m, ws in LINEAR_WEIGHTS.items() for f in ws}


def phi_items(spark: SparkSession, sf: str) -> DataFrame:
    """The same attribution with one row per line item and one column per (model, feature), named by PHI_COLUMNS."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *FEATURES)
    mu = li.agg(*[F.avg(f).alias(f"mean_{f}") for f in FEATURES])  # one row
    return li.crossJoin(F.broadcast(mu)).select(
        F.col("l_returnflag").alias("source"), "l_orderkey", "l_linenumber",
        *[(F.lit(LINEAR_WEIGHTS[m][f]) * (F.col(f) - F.col(f"mean_{f}"))).alias(c) for (m, f), c in PHI_COLUMNS.items()],
    )


def features_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as entities with numeric features, a positive target and a fold."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate)")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") / 103.7 + 101.0).alias("y"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x1"), (day / 103.7).alias("x2"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("x3"), F.col("c_nationkey").cast("double").alias("x4"),
        (F.sqrt("o_totalprice") / 10.7 + F.col("o_orderkey") % 13).alias("x5"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_totalprice") < 150000.0).alias("flag"),
    )


MATRIX_SQL = """fm AS (
  SELECT o_orderkey AS cell_id, o_totalprice / 103.7 + 101.0 AS y, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x1,
    floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) / 86400000000.0) / 103.7 AS x2,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x3, CAST(c_nationkey AS DOUBLE) AS x4, sqrt(o_totalprice) / 10.7 + o_orderkey % 13 AS x5, CAST(o_orderkey % 5 AS INTEGER) AS fold,
    o_totalprice < 150000.0 AS flag
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


# ------------------------------------------------------------- resamples


def resamples_sql(ids: str, seed: int, n_boot: int) -> str:
    """Table bw (b, cell_id, w): the multiplicities of each entity of table ``ids`` in every resample, in 64-bit integer steps."""
    product = lambda x, c: f"(({x})::UHUGEINT * {c}::UHUGEINT & 18446744073709551615::UHUGEINT)::UBIGINT"
    w = " + ".join(f"(z >= {t})::INTEGER" for t in poisson_thresholds())
    return f"""bits AS MATERIALIZED (SELECT cell_id, ('0x' || substr(md5('{seed},' || cell_id), 1, 15))::UBIGINT::UHUGEINT AS h FROM {ids}),
  steps AS MATERIALIZED (SELECT b::INTEGER AS b, (b + 1)::UHUGEINT * 11400714819323198485::UHUGEINT & 18446744073709551615::UHUGEINT AS s FROM range({n_boot}) t(b)),
  bw0 AS (SELECT cell_id, b, ((h + s) & 18446744073709551615::UHUGEINT)::UBIGINT AS z FROM bits, steps),
  bw1 AS (SELECT cell_id, b, {product("xor(z, z >> 30)", 13787848793156543929)} AS z FROM bw0),
  bw2 AS (SELECT cell_id, b, {product("xor(z, z >> 27)", 10723151780598845931)} AS z FROM bw1),
  bw3 AS (SELECT cell_id, b, xor(z, z >> 31) >> 11 AS z FROM bw2),
  bw AS (SELECT b, cell_id, {w} AS w FROM bw3)"""
