"""Registered queries: each operator on a driver table, with the SQL that must give the same rows.

Doubles are rounded to 6 places on both sides, since engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import plots, stats
from ..operators import drift, ensemble, models, provenance, quality, text, transforms, workflow
from ..operators import partition as P
from ..streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(df: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """Doubles rounded to 6 places; with ``keep``, only those columns."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in (keep or df.columns)])


# Profiles and checks

PROFILED = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "lineitem": [("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_returnflag", "string"), ("l_linestatus", "string")],
}


def profile_sql(table: str) -> str:
    parts = []
    for c, kind in PROFILED[table]:
        base = f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS \"count\", count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 1)::DOUBLE AS missing_pct, count(DISTINCT {c}) AS \"unique\""
        if kind == "string":
            parts.append(base + f", NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS median, (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)::DOUBLE AS top_freq, (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top FROM {table}")
        else:
            parts.append(base + f", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS median, NULL::DOUBLE AS top_freq, NULL AS top FROM {table}")
    return " UNION ALL ".join(parts)


def _profile(table: str):
    def run(spark, d):
        t = quality.profile(load(spark, d, table).select(*[c for c, _ in PROFILED[table]]))
        return six(t.withColumn("top_freq", F.col("top_freq").cast("double")), places=4)

    return run


for _t in PROFILED:
    QUERIES[f"profile_{_t}"] = _profile(_t)
    ORACLE_SQL[f"profile_{_t}"] = profile_sql(_t)


@query("SELECT o_orderstatus AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) OVER () AS n_classes, count(*) / sum(count(*)) OVER () < 0.2 AS minority FROM orders GROUP BY 1")
def profile_target(spark, d):
    return six(quality.profile_target(load(spark, d, "orders"), "o_orderstatus"))


@query("SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)")
def check_correlations(spark, d):
    return six(quality.correlations(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM (SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)")
def check_duplicate_rows(spark, d):
    return quality.duplicate_rows(load(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("""
SELECT 'id_like' AS "check", 'c_custkey' AS feature, 1.0::DOUBLE AS value, 'warning' AS severity FROM customer HAVING count(DISTINCT c_custkey) = count(*)
UNION ALL SELECT 'id_like', 'c_name', 1.0, 'warning' FROM customer HAVING count(DISTINCT c_name) = count(*)
UNION ALL SELECT 'zero_variance', 'one', 1.0, 'warning'
UNION ALL SELECT 'many_nulls', 'sparse', round(1 - avg(CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.0 END), 6), 'warning' FROM customer
UNION ALL SELECT 'infinite', 'ratio', count(*)::DOUBLE, 'error' FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT 'correlated', 'c_acctbal~twice', 1.0, 'warning'
""")
def check_data(spark, d):
    t = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("one"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("sparse"), F.when(F.col("c_custkey") % 50 == 0, F.lit(float("inf"))).otherwise(0.0).alias("ratio"), (F.col("c_acctbal") * 2).alias("twice"))
    return six(quality.check_data(t))


# Leakage

@query("SELECT feature, round(value, 6) AS value FROM (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS value FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem)")
def leak_correlation(spark, d):
    return six(quality.target_correlations(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


def auc_sql(y: str, s: str, source: str) -> str:
    return f"""WITH t AS (SELECT {s} AS s, sum(CASE WHEN {y} THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN {y} THEN 0 ELSE 1 END) AS neg FROM {source} GROUP BY 1),
    c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
    SELECT sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM c"""


@query(f"SELECT 'l_quantity' AS feature, round(greatest(auc, 1 - auc), 6) AS value FROM ({auc_sql("l_linestatus = 'O'", 'l_quantity', 'lineitem')})")
def leak_single_auc(spark, d):
    return six(quality.single_auc(load(spark, d, "lineitem"), F.col("l_linestatus") == "O", "l_quantity"))


@query("""
WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lineitem),
c AS (SELECT len(list_filter(e, lambda x: l_extendedprice >= x)) AS b, l_returnflag AS y, count(*) AS n FROM lineitem, e GROUP BY ALL),
s AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM c)
SELECT 'l_extendedprice' AS feature, round(greatest(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (nb::DOUBLE * ny))), 0), 6) AS value FROM s
""")
def leak_mutual_information(spark, d):
    return six(quality.mutual_information(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("""
WITH tr AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem WHERE l_orderkey % 5 <> 0),
te AS (SELECT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem WHERE l_orderkey % 5 = 0),
s AS (SELECT count(*) AS shared FROM (SELECT * FROM te INTERSECT SELECT * FROM tr)), r AS (SELECT count(*) AS rows FROM te)
SELECT shared, rows, round(shared::DOUBLE / rows, 6) AS share FROM s, r
""")
def leak_shared_rows(spark, d):
    t = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return six(quality.duplicate_share(t.where("l_orderkey % 5 <> 0").drop("l_orderkey"), t.where("l_orderkey % 5 = 0").drop("l_orderkey")))


@query("""
WITH m AS (SELECT max(o_orderdate) AS last FROM orders WHERE o_orderkey % 5 <> 0)
SELECT sum(CASE WHEN o_orderdate < last THEN 1 ELSE 0 END)::BIGINT AS before, count(*) AS rows, round(avg(CASE WHEN o_orderdate < last THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders, m WHERE o_orderkey % 5 = 0
""")
def leak_time_overlap(spark, d):
    t = load(spark, d, "orders")
    return six(quality.temporal_overlap(t.where("o_orderkey % 5 <> 0"), t.where("o_orderkey % 5 = 0"), "o_orderdate"))


@query("""
SELECT 'id_column' AS "check", 'o_orderkey' AS feature, 1.0::DOUBLE AS value, 'warning' AS severity
UNION ALL SELECT 'id_column', 'user_id', round(count(DISTINCT o_custkey) / count(*)::DOUBLE, 6), 'warning' FROM orders
UNION ALL SELECT 'target_name', 'o_orderstatus_after', 1.0, 'warning'
""")
def leak_names(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.lit("x").alias("o_orderstatus_after"), "o_orderstatus")
    return six(quality.leak(t, "o_orderstatus").where("check IN ('id_column', 'target_name')"))


# Drift

NEW = "CASE WHEN l_shipdate >= TIMESTAMP '1995-06-17' THEN 1 ELSE 0 END"


@query(f"""
WITH t AS (SELECT l_extendedprice AS v, sum(1 - {NEW}) AS a, sum({NEW}) AS b FROM lineitem GROUP BY 1),
c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM t WINDOW w AS (ORDER BY v))
SELECT round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 6) AS d, max(na)::BIGINT AS n_ref, max(nb)::BIGINT AS n_new FROM c
""")
def drift_ks(spark, d):
    return six(drift.ks_statistic(load(spark, d, "lineitem"), "l_extendedprice", F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp_ntz")))


@query("""
WITH t AS (SELECT o_orderpriority AS v, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) AS a, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1),
s AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb, count(*) OVER () - 1 AS dof FROM t),
e AS (SELECT *, (a + b) * na::DOUBLE / (na + nb) AS ea, (a + b) * nb::DOUBLE / (na + nb) AS eb FROM s)
SELECT round(sum(power(a - ea, 2) / ea + power(b - eb, 2) / eb), 6) AS chi2, max(dof) AS dof FROM e
""")
def drift_chi2(spark, d):
    return six(drift.chi2_statistic(load(spark, d, "orders"), "o_orderpriority", F.col("o_orderkey") % 3 == 0))


@query("""
WITH t AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d') AS day, event_type, n, round(n / sum(n) OVER (PARTITION BY s), 6) AS share FROM t
""")
def drift_windowed_counts(spark, d):
    t = drift.windowed_counts(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    return six(t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "share"))


@query()
def drift_report(spark, d):
    t = load(spark, d, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey")
    return drift.drift(t.where("o_custkey % 2 = 0"), t.where("o_custkey % 2 = 1"), exclude=("o_custkey",))


@query()
def drift_adversarial(spark, d):
    t = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    r = drift.adversarial(t.where("p_partkey % 2 = 0"), t.where("p_partkey % 2 = 1"), ["p_partkey"], folds=2, trees=5)
    return spark.createDataFrame([(r["auc"], r["distinguishable"], r["severity"])], "auc double, distinguishable boolean, severity string")


# Splits and folds

def hashed(id_col: str, seed: int = 42) -> str:
    return f"md5({id_col} || ':{seed}')"


def role_sql(rn: str, n: str, least: str = "") -> str:
    a, b = (f"greatest({least}, round_even({n} * {r}, 0))" if least else f"round_even({n} * {r}, 0)" for r in (0.6, 0.2))
    return f"CASE WHEN {rn} <= {a} THEN 'train' WHEN {rn} <= {a} + {b} THEN 'valid' ELSE 'test' END"


def _roles(s: P.Split, key: str) -> DataFrame:
    return s.data.select(key, F.col(P.ROLE).alias("role"))


@query(f"WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hashed('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {role_sql('rn', 'n')} AS role FROM t")
def split_random(spark, d):
    return _roles(P.split(load(spark, d, "orders"), id_cols="o_orderkey"), "o_orderkey")


@query(f"WITH t AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hashed('o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, {role_sql('rn', 'n', '1')} AS role FROM t")
def split_stratified(spark, d):
    return _roles(P.split(load(spark, d, "orders"), "o_orderstatus", id_cols="o_orderkey"), "o_orderkey")


@query(f"WITH t AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hashed('o_orderkey', 7)}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, CASE WHEN rn <= greatest(1, round_even(n * 0.8, 0)) THEN 'train' ELSE 'test' END AS role FROM t")
def split_two_way(spark, d):
    return _roles(P.split(load(spark, d, "orders"), "o_orderstatus", id_cols="o_orderkey", seed=7, ratio=(0.8, 0.2)), "o_orderkey")


@query(f"WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {role_sql('rn', 'n')} AS role FROM t")
def split_temporal(spark, d):
    return _roles(P.split_temporal(load(spark, d, "orders"), time="o_orderdate", id_cols="o_orderkey"), "o_orderkey")


@query(f"WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {hashed('o_custkey')}, o_custkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, {role_sql('rn', 'n', '1')} AS role FROM orders JOIN g USING (o_custkey)")
def split_group(spark, d):
    return _roles(P.split_group(load(spark, d, "orders"), groups="o_custkey"), "o_orderkey")


@query(f"WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hashed('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT count(*) AS n FROM t WHERE {role_sql('rn', 'n')} IN ('train', 'valid')")
def split_dev(spark, d):
    return P.split(load(spark, d, "orders"), id_cols="o_orderkey").dev.agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, (ntile(5) OVER (ORDER BY {hashed('o_orderkey')}, o_orderkey) - 1)::INT AS fold FROM orders")
def cv_kfold(spark, d):
    return P.cv(load(spark, d, "orders"), id_cols="o_orderkey").data.select("o_orderkey", F.col(P.FOLD).alias("fold"))


@query(f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hashed('o_orderkey')}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def cv_stratified(spark, d):
    return P.cv(load(spark, d, "orders"), id_cols="o_orderkey", target="o_orderstatus").data.select("o_orderkey", F.col(P.FOLD).alias("fold"))


@query(f"SELECT o_orderkey, (ntile(3) OVER (ORDER BY {hashed('o_orderkey')}, o_orderkey) - 1)::INT AS fold FROM orders UNION ALL SELECT o_orderkey, (ntile(3) OVER (ORDER BY {hashed('o_orderkey', 43)}, o_orderkey) + 2)::INT FROM orders")
def cv_repeated(spark, d):
    return P.cv(load(spark, d, "orders"), id_cols="o_orderkey", folds=3, repeats=2).data.select("o_orderkey", F.col(P.FOLD).alias("fold"))


def temporal_sql(start: str, embargo: int, more: str = "") -> str:
    return f"""
    WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n, count(*) OVER () // 5 AS fs FROM orders),
    f AS (SELECT *, CASE WHEN i >= {start} AND i < (k + 1) * fs THEN 'train' WHEN i >= (k + 1) * fs + {embargo} AND i < CASE WHEN k = 3 THEN n ELSE (k + 2) * fs END THEN 'valid' END AS role
          FROM r, (SELECT unnest([0, 1, 2, 3]) AS k)),
    q AS (SELECT * FROM f WHERE role IS NOT NULL)
    SELECT o_orderkey, k::INT AS fold, role FROM q {more}"""


def _temporal(spark, d, **options) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return P.cv_temporal(t, time="o_orderdate", id_cols="o_orderkey", folds=4, **options).select("o_orderkey", F.col(P.FOLD).alias("fold"), F.col(P.ROLE).alias("role"))


@query(temporal_sql("0", 0))
def cv_temporal(spark, d):
    return _temporal(spark, d)


@query(temporal_sql("greatest(0, (k + 1) * fs - 1000)", 50))
def cv_temporal_sliding(spark, d):
    return _temporal(spark, d, window="sliding", window_size=1000, embargo=50)


@query(temporal_sql("0", 0, "WHERE NOT (role = 'train' AND EXISTS (SELECT 1 FROM q v WHERE v.k = q.k AND v.role = 'valid' AND v.o_custkey = q.o_custkey))"))
def cv_temporal_purged(spark, d):
    return _temporal(spark, d, groups="o_custkey")


@query(f"WITH g AS (SELECT o_custkey, ((row_number() OVER (ORDER BY {hashed('o_custkey')}, o_custkey) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, fold FROM orders JOIN g USING (o_custkey)")
def cv_group(spark, d):
    return P.cv_group(load(spark, d, "orders"), groups="o_custkey").data.select("o_orderkey", F.col(P.FOLD).alias("fold"))


@query()
def cv_group_stratified(spark, d):
    t = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") > 0).cast("string").alias("y"))
    return P.cv_group(t, groups="s_nationkey", folds=3, target="y", stratify=True).data.groupBy(F.col(P.FOLD).alias("fold"), "y").agg(F.count(F.lit(1)).alias("n"))


# Transforms

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, c_acctbal" + "".join(f", CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def encode_onehot(spark, d):
    t = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return transforms.encode(t, ["c_mktsegment"], "onehot")(t)


@query("SELECT p_partkey, coalesce((dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE, -1) AS p_brand FROM part")
def encode_ordinal(spark, d):
    t = load(spark, d, "part").select("p_partkey", "p_brand")
    return transforms.encode(t, ["p_brand"], "ordinal")(t)


SHRUNK = "(1 / (1 + exp(-(n - 5.0)))) * m + (1 - 1 / (1 + exp(-(n - 5.0)))) * o"


@query(f"WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n, (SELECT avg(c_acctbal) FROM customer) AS o FROM customer GROUP BY 1) SELECT c_custkey, round({SHRUNK}, 6) AS c_mktsegment FROM customer JOIN s USING (c_mktsegment)")
def encode_target(spark, d):
    t = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return six(transforms.encode(t, ["c_mktsegment"], "target", target="c_acctbal")(t), "c_custkey", "c_mktsegment")


@query("""
WITH s AS (SELECT o_orderpriority AS k, count(*) AS n, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS m1, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS m2 FROM orders GROUP BY 1),
o AS (SELECT avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS o1, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS o2 FROM orders)
SELECT o_orderkey, round(n / (n + 10.0) * m1 + 10.0 / (n + 10.0) * o1, 6) AS o_orderpriority_te_1, round(n / (n + 10.0) * m2 + 10.0 / (n + 10.0) * o2, 6) AS o_orderpriority_te_2 FROM orders JOIN s ON o_orderpriority = k, o
""")
def encode_target_classes(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return six(transforms.encode(t, ["o_orderpriority"], "target", target="o_orderstatus", smoothing=10)(t), "o_orderkey", "o_orderpriority_te_1", "o_orderpriority_te_2")


@query(f"""
WITH t AS (SELECT c_custkey, c_mktsegment AS k, c_acctbal AS y, c_custkey % 3 AS f FROM customer),
r AS (SELECT a.k, a.f, avg(b.y) AS m, count(b.y) AS n FROM (SELECT DISTINCT k, f FROM t) a JOIN t b ON a.k = b.k AND a.f <> b.f GROUP BY 1, 2),
o AS (SELECT a.f, avg(b.y) AS o FROM (SELECT DISTINCT f FROM t) a JOIN t b ON a.f <> b.f GROUP BY 1)
SELECT c_custkey, round({SHRUNK}, 6) AS te FROM t JOIN r USING (k, f) JOIN o USING (f)
""")
def encode_target_out_of_fold(spark, d):
    t = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_custkey") % 3).alias("f"))
    return six(transforms.target_out_of_fold(t, "c_mktsegment", "c_acctbal", "f", out="te"), "c_custkey", "te")


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_type) / count(*) OVER ()::DOUBLE, 6) AS p_type FROM part")
def encode_frequency(spark, d):
    t = load(spark, d, "part").select("p_partkey", "p_type")
    return six(transforms.encode(t, ["p_type"], "frequency")(t))


WOE = """WITH t AS (SELECT l_returnflag AS level, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS events, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END)::BIGINT AS others FROM lineitem GROUP BY 1),
s AS (SELECT *, (events + 0.5) / (sum(events) OVER () + 0.5 * count(*) OVER ()) AS de, (others + 0.5) / (sum(others) OVER () + 0.5 * count(*) OVER ()) AS dn FROM t) """


@query(WOE + "SELECT level, events, others, round(ln(de / dn), 6) AS woe, round((de - dn) * ln(de / dn), 6) AS iv FROM s")
def encode_woe_table(spark, d):
    return six(transforms.woe_table(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "O"))


@query(WOE + "SELECT round(ln(de / dn), 6) AS l_returnflag, count(*) AS n FROM lineitem JOIN s ON l_returnflag = level GROUP BY 1")
def encode_woe(spark, d):
    t = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return six(transforms.encode(t, ["l_returnflag"], "woe", target="l_linestatus")(t)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ts_is_weekend, hour(ts)::INT AS ts_hour FROM events")
def encode_datetime(spark, d):
    t = load(spark, d, "events").select("event_id", "ts")
    return transforms.encode(t, ["ts"], "datetime")(t)


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS code FROM orders")
def label_encode(spark, d):
    t = load(spark, d, "orders")
    return t.select("o_orderkey", models._code("o_orderstatus", list(transforms.label_index(t, "o_orderstatus"))).cast("int").alias("code"))


def _scaled(spark, d, method):
    t = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return six(transforms.scale(t, ["p_size", "p_retailprice"], method)(t))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query("WITH q AS (SELECT quantile_cont(p_size, [0.25, 0.5, 0.75]) AS a, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS b FROM part) SELECT p_partkey, round((p_size - a[2]) / (a[3] - a[1]), 6) AS p_size, round((p_retailprice - b[2]) / (b[3] - b[1]), 6) AS p_retailprice FROM part, q")
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


GAPS = "(SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS s, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS r, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS b FROM part)"


def _gaps(spark, d) -> DataFrame:
    return load(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 7 <> 0 THEN cast(p_size AS double) END AS s", "CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS r", "CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS b")


@query(f"SELECT p_partkey, round(coalesce(s::DOUBLE, (SELECT quantile_cont(s, 0.5) FROM {GAPS})), 6) AS s, round(coalesce(r, (SELECT quantile_cont(r, 0.5) FROM {GAPS})), 6) AS r, b FROM {GAPS}")
def impute_median(spark, d):
    t = _gaps(spark, d)
    return six(transforms.impute(t, method="median")(t))


@query(f"SELECT p_partkey, round(coalesce(s::DOUBLE, (SELECT avg(s) FROM {GAPS})), 6) AS s, round(coalesce(r, (SELECT avg(r) FROM {GAPS})), 6) AS r, b FROM {GAPS}")
def impute_mean(spark, d):
    t = _gaps(spark, d)
    return six(transforms.impute(t, method="mean")(t))


@query(f"SELECT p_partkey, coalesce(s, (SELECT s FROM {GAPS} WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s, coalesce(b, (SELECT b FROM {GAPS} WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1)) AS b FROM {GAPS}")
def impute_mode(spark, d):
    t = _gaps(spark, d).drop("r")
    return transforms.impute(t, method="mode")(t)


@query(f"SELECT p_partkey, s, r, coalesce(b, 'none') AS b FROM {GAPS}")
def impute_constant(spark, d):
    t = _gaps(spark, d)
    return transforms.impute(t, ["b"], "constant", "none")(t)


@query(f"SELECT *, (s IS NULL)::TINYINT AS s_is_null, (r IS NULL)::TINYINT AS r_is_null, (b IS NULL)::TINYINT AS b_is_null FROM {GAPS}")
def null_flags(spark, d):
    t = _gaps(spark, d)
    return transforms.null_flags(t)(t)


@query(f"WITH e AS (SELECT quantile_cont(r, [0.2, 0.4, 0.6, 0.8]) AS e, quantile_cont(r, 0.5) AS m FROM {GAPS}) SELECT p_partkey, len(list_filter(e, lambda x: coalesce(r, m) >= x))::INT AS r FROM {GAPS}, e")
def discretize_quantile(spark, d):
    t = _gaps(spark, d).select("p_partkey", "r")
    return transforms.discretize(t, ["r"])(t)


@query("WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, (CASE WHEN p_retailprice >= lo + (hi - lo) * 1 / 4 THEN 1 ELSE 0 END + CASE WHEN p_retailprice >= lo + (hi - lo) * 2 / 4 THEN 1 ELSE 0 END + CASE WHEN p_retailprice >= lo + (hi - lo) * 3 / 4 THEN 1 ELSE 0 END)::INT AS p_retailprice FROM part, e")
def discretize_uniform(spark, d):
    t = load(spark, d, "part").select("p_partkey", "p_retailprice")
    return transforms.discretize(t, ["p_retailprice"], 4, "uniform")(t)


@query(f"WITH f AS (SELECT p_partkey, coalesce(r, (SELECT quantile_cont(r, 0.5) FROM {GAPS})) AS r, (r IS NULL)::TINYINT AS r_is_null FROM {GAPS}) SELECT p_partkey, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS r, r_is_null FROM f")
def pipe(spark, d):
    t = _gaps(spark, d).select("p_partkey", "r")
    flags, fill = transforms.null_flags(t, ["r"]), transforms.impute(t, ["r"])
    return six(transforms.pipe(flags, fill, transforms.scale(fill(t), ["r"]))(t))


# Text

TERMS = r"SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents"
VOCABULARY = f"WITH c AS (SELECT doc, term, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2), s AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1), v AS (SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1 AS idf FROM s ORDER BY total DESC, term LIMIT 100) "


@query(VOCABULARY + "SELECT term, row_number() OVER (ORDER BY term)::INT - 1 AS index, df, round(idf, 6) AS idf FROM v")
def tokenize_vocabulary(spark, d):
    return six(text.tokenize(load(spark, d, "documents"), "doc_id", "text").vocabulary)


@query(VOCABULARY + "SELECT doc, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc)), 6) AS weight FROM c JOIN v USING (term)")
def tokenize_weights(spark, d):
    t = load(spark, d, "documents")
    return six(text.tokenize(t, "doc_id", "text").long(t, "doc_id", "text"), "doc", "term", "weight")


# Metrics

SCORED = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, least(0.99, greatest(0.01, l_discount * 6 + l_tax * 2)) AS p,
CASE WHEN l_discount * 6 + l_tax * 2 >= 0.5 THEN 1 ELSE 0 END AS h, l_returnflag AS label, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS guess,
l_extendedprice AS v, l_quantity * 1500.0 AS w, l_quantity AS weight FROM lineitem)"""


def _scored(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y", "least(0.99D, greatest(0.01D, l_discount * 6 + l_tax * 2)) AS p",
        "CASE WHEN l_discount * 6 + l_tax * 2 >= 0.5D THEN 1 ELSE 0 END AS h", "l_returnflag AS label", "CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS guess",
        "l_extendedprice AS v", "l_quantity * 1500.0D AS w", "l_quantity AS weight",
    )


@query(f"SELECT label AS actual, guess AS predicted, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def metric_confusion(spark, d):
    return M.confusion(_scored(spark, d), "label", "guess")


PER_LABEL = f"""WITH l AS (SELECT DISTINCT label FROM {SCORED} UNION SELECT DISTINCT guess FROM {SCORED}),
t AS (SELECT l.label, sum(CASE WHEN s.label = l.label AND guess = l.label THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN s.label <> l.label AND guess = l.label THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN s.label = l.label AND guess <> l.label THEN 1 ELSE 0 END)::BIGINT AS fn FROM l, {SCORED} s GROUP BY 1),
r AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM t),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r) """


@query(PER_LABEL + "SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def metric_per_label(spark, d):
    return six(M.per_label(_scored(spark, d), "label", "guess"))


@query(PER_LABEL + "SELECT round(avg(precision), 6) AS precision_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(avg(recall), 6) AS recall_macro, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM m")
def metric_averaged(spark, d):
    return six(M.averaged(_scored(spark, d), "label", "guess"))


@query(f"WITH t AS (SELECT sum(y * h) AS tp, sum((1 - y) * h) AS fp, sum(y * (1 - h)) AS fn FROM {SCORED}) SELECT round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM t")
def metric_binary(spark, d):
    t = _scored(spark, d)
    return six(M.binary(t, "y", "h", M.positive_label(t, "y")))


@query(f"SELECT round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0 END), 6) AS accuracy FROM {SCORED}")
def metric_accuracy(spark, d):
    return six(_scored(spark, d).agg(M.accuracy("label", "guess").alias("accuracy")))


@query(f"SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM ({auc_sql('y = 1', 'p', SCORED)})")
def metric_roc_auc(spark, d):
    return six(M.roc_auc(_scored(spark, d), F.col("y") == 1, "p").withColumn("gini", 2 * F.col("auc") - 1))


OVR = {"A": "p", "N": "1 - p", "R": "p * p"}


@query("WITH " + ", ".join(f"{k} AS ({auc_sql(f'''label = '{k}' ''', e, SCORED)}), {k}n AS (SELECT count(*) AS n FROM {SCORED} WHERE label = '{k}')" for k, e in OVR.items()) + " SELECT round((A.auc * An.n + N.auc * Nn.n + R.auc * Rn.n) / (An.n + Nn.n + Rn.n), 6) AS auc FROM A, An, N, Nn, R, Rn")
def metric_roc_auc_ovr(spark, d):
    t = _scored(spark, d).selectExpr("label", *[f"{e} AS p_{k}" for k, e in OVR.items()])
    return six(M.roc_auc_ovr(t, "label", {k: f"p_{k}" for k in OVR}))


@query(f"SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM {SCORED}")
def metric_probability(spark, d):
    return six(_scored(spark, d).agg(M.log_loss(F.col("y"), F.col("p")).alias("log_loss"), M.brier(F.col("y"), F.col("p")).alias("brier")))


@query(f"""SELECT round(sqrt(avg((v - w) * (v - w))), 6) AS rmse, round(avg(abs(v - w)), 6) AS mae, round(1 - avg((v - w) * (v - w)) / var_pop(v), 6) AS r2, round(avg(abs((v - w) / v)), 6) AS mape,
round(avg(2 * abs(v - w) / (abs(v) + abs(w))), 6) AS smape, round(sqrt(avg(power(ln(1 + w) - ln(1 + v), 2))), 6) AS rmsle, round(avg(abs(w - v) + ln(1 + exp(-2 * abs(w - v))) - 0.6931471805599453), 6) AS log_cosh FROM {SCORED}""")
def metric_regression(spark, d):
    v, w = F.col("v"), F.col("w")
    return six(_scored(spark, d).agg(*[getattr(M, m)(v, w).alias(m) for m in ("rmse", "mae", "r2", "mape", "smape", "rmsle", "log_cosh")]))


@query(f"""WITH k AS (SELECT label, guess, count(*)::DOUBLE AS n FROM {SCORED} GROUP BY 1, 2), a AS (SELECT label AS l, sum(n) AS t FROM k GROUP BY 1), b AS (SELECT guess AS l, sum(n) AS p FROM k GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM k WHERE label = guess) AS c, (SELECT sum(n) FROM k) AS s, (SELECT sum(t * p) FROM a JOIN b USING (l)) AS tp, (SELECT sum(p * p) FROM b) AS pp, (SELECT sum(t * t) FROM a) AS tt)
SELECT round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc FROM s""")
def metric_mcc(spark, d):
    return six(M.mcc(_scored(spark, d), "label", "guess"))


def kappa_sql(cost: str) -> str:
    return f"""WITH k AS (SELECT CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i, CASE guess WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS j, count(*)::DOUBLE AS n FROM {SCORED} GROUP BY 1, 2),
    a AS (SELECT i, sum(n) AS a FROM k GROUP BY 1), b AS (SELECT j, sum(n) AS b FROM k GROUP BY 1)
    SELECT round(1 - (SELECT sum({cost} * n) * sum(n) FROM k) / (SELECT sum({cost} * a * b) FROM a, b), 6) AS kappa"""


@query(kappa_sql("(CASE WHEN i = j THEN 0 ELSE 1 END)"))
def metric_kappa(spark, d):
    return six(M.kappa(_scored(spark, d), "label", "guess"))


@query(kappa_sql("((i - j) * (i - j))"))
def metric_qwk(spark, d):
    return six(M.kappa(_scored(spark, d), "label", "guess", "quadratic"))


@query(f"""SELECT round(sqrt(sum(weight * (v - w) * (v - w)) / sum(weight)), 6) AS rmse_weighted, round(sum(weight * abs(v - w)) / sum(weight), 6) AS mae_weighted,
round(1 - sum(weight * (v - w) * (v - w)) / sum(weight) / (sum(weight * v * v) / sum(weight) - power(sum(weight * v) / sum(weight), 2)), 6) AS r2_weighted, round(sum(weight * CASE WHEN y = h THEN 1 ELSE 0 END) / sum(weight), 6) AS accuracy_weighted FROM {SCORED}""")
def metric_weighted(spark, d):
    w = F.col("weight")
    return six(_scored(spark, d).agg(*M.weighted(F.col("v"), F.col("w"), w, "regression"), *M.weighted(F.col("y"), F.col("h"), w, "classification")))


@query("SELECT o_orderstatus, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM orders GROUP BY 1")
def metric_class_weights(spark, d):
    return six(M.class_weights(load(spark, d, "orders"), "o_orderstatus"))


@query(f"SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed FROM {SCORED} GROUP BY 1")
def calibration_bins(spark, d):
    return six(M.calibration_bins(_scored(spark, d), F.col("y"), "p"))


@query(f"""WITH t AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORED} GROUP BY 1)
SELECT round(p, 6) AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr FROM t WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def plot_roc(spark, d):
    return six(plots.roc_points(_scored(spark, d), F.col("y") == 1, "p"))


@query(f"SELECT floor((v - w) / 5000)::BIGINT AS bin, count(*) AS n FROM {SCORED} GROUP BY 1")
def plot_residuals(spark, d):
    return plots.residual_bins(_scored(spark, d), "v", "w", 5000)


@query(f"""WITH x AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold),
t AS (SELECT threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN p < threshold THEN y ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN p < threshold THEN 1 - y ELSE 0 END)::BIGINT AS tn FROM x, {SCORED} GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM t""")
def threshold_sweep(spark, d):
    return six(ensemble.threshold_table(_scored(spark, d), F.col("y") == 1, "p", [0.1, 0.3, 0.5, 0.7, 0.9]))


@query(f"""WITH t AS (SELECT sum(CASE WHEN h = y AND g <> y THEN 1 ELSE 0 END) AS b, sum(CASE WHEN h <> y AND g = y THEN 1 ELSE 0 END) AS c FROM (SELECT y, h, CASE WHEN weight > 25 THEN 1 ELSE 0 END AS g FROM {SCORED}))
SELECT b::BIGINT AS b, c::BIGINT AS c, round(power(abs(b - c) - 1, 2) / (b + c), 6) AS statistic FROM t""")
def test_mcnemar(spark, d):
    r = stats.mcnemar(_scored(spark, d).withColumn("g", (F.col("weight") > 25).cast("int")), "y", "h", "g")
    return spark.createDataFrame([(r["b"], r["c"], round(r["statistic"], 6))], "b long, c long, statistic double")


@query(f"SELECT count(g) AS n, round(avg(g) / (stddev_samp(g) / sqrt(count(g))), 6) AS statistic FROM (SELECT abs(v - w) - abs(v - w * 0.9) AS g FROM {SCORED})")
def test_paired_t(spark, d):
    r = stats.paired_t(_scored(spark, d).withColumn("x", F.col("w") * 0.9), "v", "w", "x")
    return spark.createDataFrame([(r["n"], round(r["statistic"], 6))], "n long, statistic double")


PVALUES = "(SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE power((s_suppkey * 37 % 101) / 101.0, 3) END AS p FROM supplier)"


def _adjusted(spark, d, method):
    t = load(spark, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE power((s_suppkey * 37 % 101) / 101.0D, 3D) END AS p")
    return six(stats.adjust(t, "p", method, ties=["s_suppkey"]), "s_suppkey", "p_adj", "significant")


def adjust_sql(raw: str, over: str) -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY p, s_suppkey) AS k, count(*) OVER () AS m FROM {PVALUES} WHERE p IS NOT NULL), a AS (SELECT s_suppkey, least({over.format(raw)}, 1.0) AS p_adj FROM r)
    SELECT s.s_suppkey, round(p_adj, 6) AS p_adj, coalesce(p_adj <= 0.05, false) AS significant FROM supplier s LEFT JOIN a USING (s_suppkey)"""


@query(adjust_sql("p * m / k", "min({}) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)"))
def correct_bh(spark, d):
    return _adjusted(spark, d, "bh")


@query(adjust_sql("p * (m - k + 1)", "max({}) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)"))
def correct_holm(spark, d):
    return _adjusted(spark, d, "holm")


@query(adjust_sql("p * m", "{}"))
def correct_bonferroni(spark, d):
    return _adjusted(spark, d, "bonferroni")


@query()
def metric_bootstrap(spark, d):
    t = load(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice AS v", "o_custkey * 20.0D AS w")
    gap = F.abs(F.col("v") - F.col("w"))
    return M.interval(M.bootstrap(t, ["o_orderkey"], F.sum(F.col("__w") * gap) / F.sum("__w"), 100))


# Blends and calibration

BLENDED = "(SELECT o_orderkey, o_totalprice / 612345.678 AS a, (o_custkey % 100) / 100.0 AS b FROM orders)"


def _blend(spark, d, method, **options):
    t = load(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice / 612345.678D AS a", "(o_custkey % 100) / 100.0D AS b")
    return six(ensemble.blend(t, ["a", "b"], method, [0.3, 0.7], id_cols=["o_orderkey"], **options), "o_orderkey", "blend")


@query(f"SELECT o_orderkey, round(0.3 * a + 0.7 * b, 6) AS blend FROM {BLENDED}")
def blend_mean(spark, d):
    return _blend(spark, d, "mean")


@query(f"SELECT o_orderkey, round(0.3 * row_number() OVER (ORDER BY a, o_orderkey) / count(*) OVER () + 0.7 * row_number() OVER (ORDER BY b, o_orderkey) / count(*) OVER (), 6) AS blend FROM {BLENDED}")
def blend_rank(spark, d):
    return _blend(spark, d, "rank")


@query(f"SELECT o_orderkey, round(exp(0.3 * ln(least(greatest(a, 1e-15), 1 - 1e-15)) + 0.7 * ln(least(greatest(b, 1e-15), 1 - 1e-15))), 6) AS blend FROM {BLENDED}")
def blend_geometric(spark, d):
    return _blend(spark, d, "geometric")


@query(f"SELECT o_orderkey, round(power(0.3 * power(a, 3) + 0.7 * power(b, 3), 1 / 3.0), 6) AS blend FROM {BLENDED}")
def blend_power(spark, d):
    return _blend(spark, d, "power", power=3.0)


@query("SELECT o_orderkey, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS vote FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_custkey % 3 AS b, o_orderkey % 2 AS c FROM orders)")
def blend_vote(spark, d):
    t = load(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 3 AS a", "o_custkey % 3 AS b", "o_orderkey % 2 AS c")
    return ensemble.vote(t, ["a", "b", "c"]).select("o_orderkey", "vote")


@query()
def calibrate_isotonic(spark, d):
    t = _scored(spark, d)
    return six(ensemble.calibrate(t, F.col("y") == 1, "p", "isotonic").transform(t.select("p").distinct(), "p"))


@query()
def optimize_threshold(spark, d):
    r = ensemble.optimize_threshold(_scored(spark, d), F.col("y") == 1, "p")
    return spark.createDataFrame([(r["threshold"], r["f1"])], "threshold double, f1 double")


# Models

NB_FEATURES = ("l_quantity", "l_extendedprice", "l_discount")
_NB = "WITH s AS (SELECT l_returnflag AS c, count(*) AS n, " + ", ".join(f"avg({f}) AS m{i}, var_pop({f}) AS v{i}" for i, f in enumerate(NB_FEATURES)) + " FROM lineitem GROUP BY 1), "
_NB += "e AS (SELECT 1e-9 * greatest(" + ", ".join(f"var_pop({f})" for f in NB_FEATURES) + ") AS e FROM lineitem), "
_NB += "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, c, ln(n / (SELECT count(*) FROM lineitem)::DOUBLE)" + "".join(f" - 0.5 * ln(2 * pi() * (v{i} + e)) - ({f} - m{i}) * ({f} - m{i}) / (2 * (v{i} + e))" for i, f in enumerate(NB_FEATURES)) + " AS lp FROM lineitem, s, e), "
_NB += "b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ORDER BY lp DESC, c) AS r FROM l) "


@query(_NB + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c AS prediction FROM b WHERE r = 1")
def model_naive_bayes(spark, d):
    t = load(spark, d, "lineitem")
    m = models.fit(t, "l_returnflag", "naive_bayes", features=list(NB_FEATURES))
    return m.predict(t, proba=False).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS weight, round(regr_intercept(l_extendedprice, l_quantity), 6) AS bias FROM lineitem")
def model_linear(spark, d):
    m = models.fit(load(spark, d, "lineitem"), "l_extendedprice", "linear", features=["l_quantity"], task="regression", alpha=0.0)
    return spark.createDataFrame([(round(float(m.kernel.weights[0]), 6), round(float(m.kernel.bias), 6))], "weight double, bias double")


_V = ", ".join(f"round(embedding[{i}]::DOUBLE, 4) AS x{i}" for i in range(1, 9))
_D = " + ".join(f"(q.x{i} - t.x{i}) * (q.x{i} - t.x{i})" for i in range(1, 9))


@query(f"""WITH v AS (SELECT vec_id, label, {_V} FROM embeddings), n AS (SELECT q.vec_id, t.label AS y, {_D} AS d FROM v q, v t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, y) AS r FROM n), c AS (SELECT vec_id, y, count(*) AS k FROM r WHERE r <= 5 GROUP BY 1, 2)
SELECT vec_id, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, y) AS r FROM c) WHERE r = 1""")
def model_knn(spark, d):
    t = load(spark, d, "embeddings").select("vec_id", "label", *[F.round(F.col("embedding")[i - 1].cast("double"), 4).alias(f"x{i}") for i in range(1, 9)])
    m = models.fit(t.where("vec_id % 5 <> 0"), "label", "knn", features=[f"x{i}" for i in range(1, 9)], task="classification", k=5)
    return m.predict(t.where("vec_id % 5 = 0"), proba=False).select("vec_id", "prediction")


def _fitted(name: str, target: str, **params):
    def run(spark, d):
        t = load(spark, d, "part").selectExpr("p_partkey", "p_size", "p_retailprice", "p_partkey % 10 AS tail", "p_size + p_retailprice / 100 + p_partkey % 7 AS value", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind")
        s = P.split(t, target, id_cols="p_partkey")
        m = models.fit(s.train, target, name, features=["p_size", "p_retailprice", "tail"], **params)
        return spark.createDataFrame(sorted(workflow.rounded(workflow.bundle(m, s.valid)).items()), "metric string, value double")

    return run


for _n, _k, _o in (("logistic", "kind", {}), ("elastic_net", "value", {"alpha": 0.1}), ("decision_tree", "kind", {}), ("random_forest", "value", {"n_estimators": 5}), ("extra_trees", "kind", {"n_estimators": 5}), ("gradient_boosting", "kind", {"n_estimators": 3}), ("adaboost", "kind", {"n_estimators": 3}), ("svm", "kind", {})):
    QUERIES[f"model_{_n}"] = _fitted(_n, _k, **_o)


@query()
def workflow_stack(spark, d):
    t = load(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal", "s_nationkey", "s_acctbal * 2 + s_nationkey AS y")
    m = workflow.stack(t, "y", ["linear", "decision_tree"], id_cols=["s_suppkey"], folds=2)
    return m.predict(t).select("s_suppkey", F.round("prediction", 4).alias("prediction"))


@query()
def workflow_explain(spark, d):
    t = load(spark, d, "part").selectExpr("p_partkey", "p_size", "p_retailprice", "p_size * 3 + p_retailprice / 1000 AS y")
    m = models.fit(t, "y", "linear", features=["p_size", "p_retailprice"], task="regression")
    found = workflow.explain(m, t, id_cols=["p_partkey"], method="permutation", repeats=1)
    return spark.createDataFrame(list(found.items()), "feature string, importance double")


# Provenance

@query("""WITH l AS (SELECT n_nationkey AS seq, n_name AS body, sha256(n_name) AS own FROM nation) SELECT count(*) AS rows, sum(CASE WHEN seq = 0 THEN 1 ELSE 0 END)::BIGINT AS valid FROM l""")
def audit_chain(spark, d):
    log = load(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("body"), F.sha2("n_name", 256).alias("hash"))
    return provenance.verify_chain(log).agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"))


@query("SELECT count(*) AS rows FROM orders")
def fingerprint(spark, d):
    t = load(spark, d, "orders")
    a, b = provenance.fingerprint_frame(t), provenance.fingerprint_frame(t.select(*reversed(t.columns)))
    return a.join(b, ["rows", "high", "low"]).select("rows")


# What the operators rest on, as plain queries

@query("SELECT n_name, count(*) AS customers, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def relational_join(spark, d):
    n, c, o = (load(spark, d, t) for t in ("nation", "customer", "orders"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def relational_semi_anti(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    kept = c.join(o.where("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_semi")
    return kept.join(o.where("o_orderpriority = '1-URGENT'"), kept.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def relational_grouping_sets(spark, d):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return load(spark, d, "lineitem").groupingSets([[f, s], [f], []], f, s).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def relational_top(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


# Streams, run over a table

@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1, 2")
def stream_window_profile(spark, d):
    t = monitor.window_profile(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day")
    return six(t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean", "low", "high"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""")
def stream_sessions(spark, d):
    t = monitor.session_profile(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
