"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them.

Order cells are orders with their customer: segment as environment, urgent against low priority as arms, nation as pair
key, price as the measured value. Event cells are one user's events of one type in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, columns, effects, special
from ..operators import bursts, discovery, frames, improvement, paired, ranks, regression, strata
from ..operators import mediation as traced
from .bridge import analysis, claim_bridge, evaluate, extent_hash
from .contrast import Contrast
from . import multigraph
from .materialise import compact, materialise, stored
from .panel import Panel, from_cache, metric, to_cache

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CELLS = """cells AS (SELECT o_orderkey AS id, c_mktsegment AS env_name, CASE o_orderpriority WHEN '1-URGENT' THEN 'treatment' WHEN '5-LOW' THEN 'baseline' ELSE o_orderpriority END AS arm_key,
    c_nationkey AS seed, o_totalprice AS source, c_acctbal AS balance, o_orderstatus AS status, o_custkey AS customer FROM orders JOIN customer ON o_custkey = c_custkey)"""
PAIRS = CELLS + """, deltas AS (SELECT env_name, seed, avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline') AS delta
    FROM cells WHERE arm_key IN ('treatment', 'baseline') GROUP BY env_name, seed HAVING count(*) FILTER (WHERE arm_key = 'treatment') > 0 AND count(*) FILTER (WHERE arm_key = 'baseline') > 0)"""
GS = PAIRS + """, g0 AS (SELECT env_name, count(delta) AS n_pairs, avg(delta) AS mean_diff, stddev_samp(delta) AS sd, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS helped FROM deltas GROUP BY env_name),
    gs AS (SELECT *, mean_diff / sd * (1 - 3.0 / (4 * n_pairs - 5)) AS g FROM g0), ge AS (SELECT *, sqrt(1.0 / n_pairs + g * g / (2.0 * n_pairs)) AS g_se FROM gs)"""
PANEL = CELLS + """, p0 AS (SELECT env_name, count(*) FILTER (WHERE arm_key = 'treatment') AS n_t, count(*) FILTER (WHERE arm_key = 'baseline') AS n_b,
    avg(source) FILTER (WHERE arm_key = 'treatment') AS mean_t, avg(source) FILTER (WHERE arm_key = 'baseline') AS mean_b,
    stddev_samp(source) FILTER (WHERE arm_key = 'treatment') AS sd_t, stddev_samp(source) FILTER (WHERE arm_key = 'baseline') AS sd_b FROM cells GROUP BY env_name),
    p1 AS (SELECT *, mean_t - mean_b AS delta, (mean_t - mean_b) / sqrt((sd_t * sd_t + sd_b * sd_b) / 2) AS d FROM p0 WHERE n_t >= 3 AND n_b >= 3),
    panel AS (SELECT *, sqrt((n_t + n_b)::DOUBLE / (n_t * n_b) + d * d / (2.0 * (n_t + n_b - 2))) AS d_se FROM p1)"""
SERIES = """series AS (SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS x, count(*) AS n FROM events GROUP BY user_id, event_type)"""
BURSTS = SERIES + """, long AS (SELECT user_id, event_type, i, x[i + 1] AS v, n FROM (SELECT *, unnest(range(n)) AS i FROM series)),
    bursts AS (SELECT user_id, event_type, b AS burst, avg(v) AS v FROM (SELECT l.*, k.b FROM long l JOIN (SELECT unnest(range(4)) AS b) k ON l.i >= floor(l.n * k.b / 4.0) AND l.i < floor(l.n * (k.b + 1) / 4.0)) GROUP BY user_id, event_type, b),
    arms AS (SELECT *, CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'baseline' END AS arm_key, user_id // 2 AS seed FROM bursts)"""


def query(sql: str | None = None):
    def made(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return made


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    o, c = _read(spark, d, "orders"), _read(spark, d, "customer")
    arm = F.when(F.col("o_orderpriority") == "1-URGENT", "treatment").when(F.col("o_orderpriority") == "5-LOW", "baseline").otherwise(F.col("o_orderpriority"))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("env_name"), arm.alias("arm_key"), F.col("c_nationkey").alias("seed"), F.col("o_totalprice").alias("source"), F.col("c_acctbal").alias("balance"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))


def event_cells(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("_e"))
    arm = F.when(F.col("user_id") % 2 == 1, "treatment").otherwise("baseline")
    return e.select("user_id", "event_type", arm.alias("arm_key"), F.floor(F.col("user_id") / 2).alias("seed"), F.transform("_e", lambda x: x["value"]).alias("x"))


def burst_cells(spark: SparkSession, d: str) -> DataFrame:
    return event_cells(spark, d).withColumn("m", arrays.by_burst(F.col("x"), 4))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(columns.col(n), digits).alias(n) if t == "double" else columns.col(n) for n, t in df.dtypes])


@query(f"WITH {CELLS} SELECT env_name, round(avg(source), 4) AS mean, round(stddev_samp(source), 4) AS std, round(median(source), 4) AS median, count(source) AS n FROM cells GROUP BY env_name")
def per_stratum(spark, d):
    return _rounded(strata.per_stratum_aggregates(order_cells(spark, d), "source", ["env_name"], ["mean", "std", "median"]), 4)


@query(f"WITH {PANEL} SELECT env_name, n_t, n_b, round(delta, 4) AS delta, round(d, 8) AS d, round(d_se, 8) AS d_se FROM panel")
def stratum_panel(spark, d):
    p = strata.stratum_panel(order_cells(spark, d), "source", ["env_name"])
    return p.select("env_name", "n_t", "n_b", F.round("delta", 4).alias("delta"), F.round("d", 8).alias("d"), F.round("d_se", 8).alias("d_se"))


@query(f"""WITH {CELLS} SELECT env_name, round(avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline'), 4) AS delta_source,
    round(avg(balance) FILTER (WHERE arm_key = 'treatment') - avg(balance) FILTER (WHERE arm_key = 'baseline'), 4) AS delta_balance FROM cells GROUP BY env_name""")
def stratum_effects(spark, d):
    return _rounded(strata.stratum_effects(order_cells(spark, d), ["source", "balance"], ["env_name"]), 4)


POOL = """, w AS (SELECT {y} AS y, 1 / ({s} * {s}) AS w FROM {t}), f AS (SELECT sum(w) AS sw, sum(w * w) AS sw2, sum(w * y) / sum(w) AS fixed, count(*) AS k FROM w),
    q AS (SELECT any_value(f.sw) AS sw, any_value(f.sw2) AS sw2, any_value(f.k) AS k, sum(w.w * (w.y - f.fixed) ** 2) AS q FROM w, f), t2 AS (SELECT *, greatest(0.0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
    r AS (SELECT 1 / (1 / w.w + t2.tau2) AS v, w.y FROM w, t2)
    SELECT (SELECT k FROM t2) AS k, round((SELECT q FROM t2), 6) AS q, round((SELECT tau2 FROM t2), 8) AS tau2, round(sum(v * y) / sum(v), 8) AS pooled, round(sqrt(1 / sum(v)), 8) AS pooled_se FROM r"""


def _pool(p: DataFrame) -> DataFrame:
    return p.select("k", F.round("q", 6).alias("q"), F.round("tau2", 8).alias("tau2"), F.round("pooled", 8).alias("pooled"), F.round("pooled_se", 8).alias("pooled_se"))


@query(f"""WITH {PANEL}, level AS (SELECT avg(balance) AS floor FROM cells WHERE arm_key = 'baseline'), kept AS (SELECT env_name FROM cells, level WHERE arm_key = 'baseline' GROUP BY env_name HAVING avg(balance) > any_value(floor) - 100),
    scoped AS (SELECT * FROM panel WHERE env_name IN (SELECT env_name FROM kept))""" + POOL.format(y="d", s="d_se", t="scoped"))
def arm_diff_pooled(spark, d):
    cells = order_cells(spark, d)
    floor = cells.where("arm_key = 'baseline'").agg(F.avg("balance")).first()[0] - 100
    return _pool(strata.arm_diff_pooled(cells, "source", ["env_name"], "balance", floor)[1])


@query(f"WITH {GS} SELECT env_name, n_pairs, round(mean_diff, 4) AS mean_diff, round(helped, 8) AS helped, round(g, 8) AS g, round(g_se, 8) AS g_se FROM ge")
def paired_g(spark, d):
    g = paired.paired_g(paired.pairs(order_cells(spark, d), "source", ["seed"], ["env_name"]), ["env_name"])
    return g.select("env_name", "n_pairs", F.round("mean_diff", 4).alias("mean_diff"), F.round("helped", 8).alias("helped"), F.round("g", 8).alias("g"), F.round("g_se", 8).alias("g_se"))


@query(f"WITH {GS}" + POOL.format(y="g", s="g_se", t="ge"))
def paired_comparison(spark, d):
    g = paired.paired_g(paired.pairs(order_cells(spark, d), "source", ["seed"], ["env_name"]), ["env_name"])
    return _pool(effects.dl_pool(g, "g", "g_se"))


@query(f"""WITH {PAIRS}, c AS (SELECT env_name, count(*) AS n_pairs, (count(*) FILTER (WHERE delta > 0) - count(*) FILTER (WHERE delta < 0))::DOUBLE / count(*) AS cliff FROM deltas GROUP BY env_name)
    SELECT env_name, n_pairs, round(cliff, 8) AS cliff, round(sqrt((1 - cliff * cliff) / (n_pairs - 1)), 8) AS cliff_se FROM c""")
def cliff_delta_paired(spark, d):
    c = paired.cliff_delta(paired.pairs(order_cells(spark, d), "source", ["seed"], ["env_name"]), ["env_name"])
    return _rounded(c.select("env_name", "n_pairs", "cliff", "cliff_se"), 8)


@query(f"""WITH {PANEL}, v AS (SELECT *, sd_t ** 2 / n_t AS a, sd_b ** 2 / n_b AS b FROM panel)
    SELECT env_name, round(delta / sqrt(a + b), 6) AS t, round((a + b) ** 2 / (a * a / (n_t - 1) + b * b / (n_b - 1)), 4) AS df FROM v""")
def arm_mean_diff(spark, d):
    w = paired.welch(order_cells(spark, d), "source", ["env_name"])
    return w.select("env_name", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query(f"""WITH {CELLS}, m AS (SELECT env_name, seed, avg(source) FILTER (WHERE arm_key = 'treatment') AS a, avg(source) FILTER (WHERE arm_key = '2-HIGH') AS b, avg(source) FILTER (WHERE arm_key = '3-MEDIUM') AS c,
    avg(source) FILTER (WHERE arm_key = 'baseline') AS d FROM cells GROUP BY env_name, seed), k AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
    l AS (SELECT env_name, 'first' AS contrast, b - a AS delta FROM k UNION ALL SELECT env_name, 'second', c - a FROM k UNION ALL SELECT env_name, 'first_given_second', d - c FROM k UNION ALL SELECT env_name, 'second_given_first', d - b FROM k UNION ALL SELECT env_name, 'interaction', (d - c) - (b - a) FROM k)
    SELECT env_name, contrast, count(*) AS n_pairs, round(avg(delta) / stddev_samp(delta) * (1 - 3.0 / (4 * count(*) - 5)), 8) AS g FROM l GROUP BY env_name, contrast""")
def factorial_2x2(spark, d):
    f = paired.factorial(order_cells(spark, d), "source", ["seed"], ("treatment", "2-HIGH", "3-MEDIUM", "baseline"), ["env_name"])
    return f.select("env_name", "contrast", "n_pairs", F.round("g", 8).alias("g"))


@query(f"WITH {PANEL} SELECT count(*) FILTER (WHERE d > 0) AS positive, count(*) FILTER (WHERE d <= 0) AS not_positive, count(*) AS strata FROM panel")
def cross_env_consistency(spark, d):
    return strata.sign_counts(strata.stratum_panel(order_cells(spark, d), "source", ["env_name"]))


@query(f"""WITH {CELLS}, e AS (SELECT env_name, avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline') AS x, avg(balance) FILTER (WHERE arm_key = 'treatment') - avg(balance) FILTER (WHERE arm_key = 'baseline') AS y FROM cells GROUP BY env_name)
    SELECT count(*) FILTER (WHERE (x > 0) = (y > 0)) AS same, count(*) AS strata FROM e""")
def cross_env_sign_alignment(spark, d):
    cells = order_cells(spark, d)
    return strata.sign_alignment(strata.stratum_panel(cells, "source", ["env_name"]), strata.stratum_panel(cells, "balance", ["env_name"]), ["env_name"])


@query(f"""WITH {CELLS}, c AS (SELECT env_name, source AS v, count(*) FILTER (WHERE arm_key = 'treatment') AS t, count(*) FILTER (WHERE arm_key = 'baseline') AS b FROM cells WHERE arm_key IN ('treatment', 'baseline') GROUP BY env_name, source),
    w AS (SELECT *, t * (coalesce(sum(b) OVER (PARTITION BY env_name ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2.0) AS won FROM c)
    SELECT env_name, sum(t)::BIGINT AS n_t, sum(b)::BIGINT AS n_b, round((sum(won) / (sum(t) * sum(b)))::DOUBLE, 8) AS p FROM w GROUP BY env_name""")
def probability_of_improvement(spark, d):
    return strata.probability_of_improvement(order_cells(spark, d), "source", ["env_name"]).select("env_name", "n_t", "n_b", F.round("p", 8).alias("p"))


RANKS = CELLS + """, r AS (SELECT env_name, rank() OVER (PARTITION BY env_name ORDER BY source) + (count(*) OVER (PARTITION BY env_name, source) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY env_name ORDER BY balance) + (count(*) OVER (PARTITION BY env_name, balance) - 1) / 2.0::DOUBLE AS y,
    rank() OVER (PARTITION BY env_name ORDER BY customer) + (count(*) OVER (PARTITION BY env_name, customer) - 1) / 2.0::DOUBLE AS z FROM cells), c AS (SELECT env_name, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY env_name)"""


@query(f"WITH {RANKS} SELECT env_name, n, round(xy, 7) AS rho FROM c")
def spearman(spark, d):
    return _rounded(ranks.spearman(order_cells(spark, d), "source", "balance", ["env_name"]), 7)


@query(f"WITH {RANKS} SELECT env_name, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 7) AS rho FROM c")
def partial_spearman(spark, d):
    return _rounded(ranks.partial_spearman(order_cells(spark, d), "source", "balance", "customer", ["env_name"]), 7)


@query(f"WITH {RANKS} SELECT round(tanh(sum((n - 3) * atanh(xy)) / sum(n - 3)), 7) AS rho, count(*) AS strata, sum(n)::BIGINT AS n FROM c")
def stratified_spearman(spark, d):
    return _rounded(ranks.stratified_spearman(order_cells(spark, d), "source", "balance", ["env_name"]).select("rho", "strata", "n"), 7)


@query(f"""WITH {CELLS}, e AS (SELECT seed, avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline') AS x, avg(balance) FILTER (WHERE arm_key = 'treatment') - avg(balance) FILTER (WHERE arm_key = 'baseline') AS y FROM cells GROUP BY seed HAVING least(count(*) FILTER (WHERE arm_key = 'treatment'), count(*) FILTER (WHERE arm_key = 'baseline')) >= 3),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS y FROM e) SELECT count(*) AS n, round(corr(x, y), 7) AS rho FROM r""")
def cross_stratum_slope(spark, d):
    return _rounded(ranks.cross_stratum_slope(order_cells(spark, d), "source", "balance", ["seed"]), 7)


@query(f"""WITH {CELLS} SELECT env_name AS env, unnest(['source', 'low']) AS metric, unnest([avg(CASE WHEN source IS NOT NULL THEN 1.0 ELSE 0.0 END), round(avg(CASE WHEN balance < 0 THEN 1.0 ELSE 0.0 END), 8)]) AS share,
    unnest(['uniform', 'partial']) AS status FROM cells GROUP BY env_name""")
def availability(spark, d):
    cells = order_cells(spark, d).withColumn("low", F.when(F.col("balance") < 0, F.col("balance")).otherwise(F.lit(float("nan"))))
    return _rounded(strata.availability(cells, "env_name", ["source", "low"]), 8)


@query(f"WITH {CELLS} SELECT env_name, count(*) AS n_cells, avg(CASE WHEN source IS NOT NULL THEN 1.0 ELSE 0.0 END) AS finite_source, count(DISTINCT (seed, status)) AS n_configs FROM cells GROUP BY env_name")
def diagnostics(spark, d):
    return strata.diagnostics(order_cells(spark, d), ["env_name"], ["source"], ["seed", "status"])


@query(f"""WITH {CELLS}, v AS (SELECT env_name AS env, count(*) FILTER (WHERE status = 'O') AS held, count(*) FILTER (WHERE status = 'F') AS invariant_violation, count(*) FILTER (WHERE status = 'P') AS power_insufficient, count(*) FILTER (WHERE status NOT IN ('O', 'F', 'P')) AS other FROM cells GROUP BY env_name),
    g AS (SELECT *, greatest(held, invariant_violation, power_insufficient, other) AS top FROM v)
    SELECT env, held, invariant_violation, power_insufficient, other, CASE WHEN (held = top)::INT + (invariant_violation = top)::INT + (power_insufficient = top)::INT + (other = top)::INT > 1 THEN '' WHEN held = top THEN 'held' WHEN invariant_violation = top THEN 'invariant_violation' WHEN power_insufficient = top THEN 'power_insufficient' ELSE 'other' END AS dominant FROM g""")
def verdict_distribution(spark, d):
    v = F.when(F.col("status") == "O", "HELD").when(F.col("status") == "F", "Invariant_Violation").when(F.col("status") == "P", "power_insufficient").otherwise("x")
    return strata.verdict_distribution(order_cells(spark, d).withColumn("verdict", v), "env_name", "verdict")


@query(f"WITH {CELLS} SELECT arm_key, 'status' AS leaf, count(DISTINCT status) AS n FROM cells GROUP BY arm_key UNION ALL SELECT arm_key, 'seed', count(DISTINCT seed) FROM cells GROUP BY arm_key")
def arm_leaves(spark, d):
    return strata.arm_leaves(order_cells(spark, d), ["arm_key"], ["status", "seed"]).select("arm_key", "leaf", F.size("values").cast("long").alias("n"))


@query(f"""WITH {CELLS}, s AS (SELECT env_name, count(*) AS n, avg(source) AS m, var_pop(source) AS v FROM cells GROUP BY env_name), w AS (SELECT sum(n)::BIGINT AS n, sum(n * v) / sum(n) AS within, sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2 AS across FROM s)
    SELECT n, round(within / (within + across), 6) AS within_share, CASE WHEN within / (within + across) > 0.95 THEN 'within' WHEN within / (within + across) < 0.05 THEN 'across' ELSE 'both' END AS scope FROM w""")
def variable_scope(spark, d):
    return _rounded(strata.classify_scope(order_cells(spark, d), "source", ["env_name"]).select("n", "within_share", "scope"), 6)


@query(f"WITH {CELLS} SELECT id, round((source - avg(source) OVER (PARTITION BY env_name)) / stddev_samp(source) OVER (PARTITION BY env_name), 6) AS source_z FROM cells")
def within_env_zscore(spark, d):
    return _rounded(strata.within_zscore(order_cells(spark, d), "source", "env_name").select("id", "source_z"))


@query(f"""WITH {CELLS}, a AS (SELECT count(*) FILTER (WHERE status = 'O') AS n1, count(*) FILTER (WHERE status = 'F') AS n2, avg(source) FILTER (WHERE status = 'O') AS m1, avg(source) FILTER (WHERE status = 'F') AS m2, var_samp(source) FILTER (WHERE status = 'O') AS v1, var_samp(source) FILTER (WHERE status = 'F') AS v2 FROM cells)
    SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4.0 * (n1 + n2) - 9)), 8) AS g FROM a""")
def mediator_differential(spark, d):
    return _rounded(strata.group_differential(order_cells(spark, d), "source", "status", "O", "F").select("n1", "n2", "g"), 8)


@query("""WITH u AS (SELECT n_nationkey AS id, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation
    UNION ALL SELECT NULL, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, n_name, -1 FROM nation UNION ALL SELECT 5, n_name, -2 FROM nation) SELECT coalesce(min(id), -1) AS id, n_name, n_regionkey FROM u GROUP BY n_name, n_regionkey""")
def dedup_by_content(spark, d):
    n = _read(spark, d, "nation").withColumnRenamed("n_nationkey", "id")
    nobody, five = F.lit(None).cast("int"), F.lit(5)
    return frames.dedup_by_content(frames.diagonal_union([n, n, n.withColumn("id", (F.col("id") + 100).cast("int")), n.withColumn("id", nobody), n.withColumns({"id": nobody, "n_regionkey": F.lit(-1)}), n.withColumns({"id": five, "n_regionkey": F.lit(-2)})])).withColumn("id", F.coalesce("id", F.lit(-1)))


@query("WITH k AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey HAVING count(*) > 1) SELECT * FROM (SELECT 'o_orderstatus' AS \"column\", count(*) FILTER (WHERE s > 1) AS buckets FROM k UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE p > 1) FROM k) WHERE buckets > 0")
def distinguishing_columns(spark, d):
    return frames.distinguishing_columns(_read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), ["o_custkey"])


@query("""SELECT p_partkey AS id, 'trace_without_run' AS kind FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'run_without_trace' FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)""")
def trace_contamination(spark, d):
    return frames.contamination(_read(spark, d, "part").select(F.col("p_partkey").alias("id")), _read(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("""WITH e AS (SELECT l_orderkey AS id, l_linenumber AS c, count(*) AS attempted, count(l_extendedprice) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey, l_linenumber), g AS (SELECT max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS alls FROM lineitem),
    s AS (SELECT e.*, (c - lag(c) OVER w) * (m + lag(m) OVER w) / 2 AS area FROM e WINDOW w AS (PARTITION BY id ORDER BY c))
    SELECT id, coalesce(max(attempted) FILTER (WHERE c = g.last), 0) AS attempted, coalesce(max(n) FILTER (WHERE c = g.last), 0) AS n, round(max(m) FILTER (WHERE c = g.last), 4) AS mean, round(CASE WHEN count(m) = any_value(g.alls) AND max(c) > min(c) THEN sum(area) / (max(c) - min(c)) END, 4) AS auc FROM s, g GROUP BY id""")
def derive_outcomes(spark, d):
    return _rounded(frames.outcomes(_read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice"), 4)


@query(f"""WITH {SERIES} SELECT user_id, event_type, list_avg(x[floor(n * 0.25)::INT + 1 : greatest(floor(n * 0.5)::INT, floor(n * 0.25)::INT + 1)]) AS mid, list_avg(x[n - greatest(floor(n * 0.1)::INT, 1) + 1 :]) AS late,
    list_avg(x[n // 2 + 1 :]) AS half, list_max(list_transform(x, lambda v: abs(v))) AS biggest, list_stddev_pop(x) AS spread, (list_sum(x) - (x[1] + x[-1]) / 2) / (n - 1) AS area, len(list_distinct(x)) AS n_unique FROM series WHERE n >= 2""")
def array_reductions(spark, d):
    x = F.col("x")
    rows = event_cells(spark, d).where(F.size("x") >= 2)
    return rows.select("user_id", "event_type", arrays.mean_window(x, 0.25, 0.5).alias("mid"), arrays.late_mean(x).alias("late"), arrays.mean(arrays.late_half(x)).alias("half"), arrays.max_abs(x).alias("biggest"), arrays.std(x).alias("spread"), arrays.auc(x).alias("area"), arrays.distinct(x).cast("long").alias("n_unique"))


@query(f"""WITH {SERIES}, l AS (SELECT user_id, event_type, n, unnest(range(n)) AS i, unnest(x) AS v FROM series WHERE n >= 8), a AS (SELECT user_id, event_type, i, v, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY i) AS u FROM l)
    SELECT user_id, event_type, round(regr_slope(v, i), 6) AS slope, round(corr(v, u), 6) AS lag1 FROM a GROUP BY user_id, event_type""")
def series_dynamics(spark, d):
    rows = event_cells(spark, d).where(F.size("x") >= 8)
    return _rounded(rows.select("user_id", "event_type", arrays.slope(F.col("x")).alias("slope"), arrays.autocorrelation(F.col("x"), 1).alias("lag1")))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type), t AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p FROM p) SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM t GROUP BY user_id""")
def series_entropy(spark, d):
    return _rounded(strata.entropy(_read(spark, d, "events"), ["user_id"], "event_type"))


@query(f"""WITH {BURSTS}, k AS (SELECT event_type, burst, seed, avg(v) FILTER (WHERE arm_key = 'treatment') - avg(v) FILTER (WHERE arm_key = 'baseline') AS delta FROM arms GROUP BY event_type, burst, seed)
    SELECT event_type, burst, count(delta) AS n_pairs, round(avg(delta) / stddev_samp(delta) * (1 - 3.0 / (4 * count(delta) - 5)), 6) AS g FROM k WHERE delta IS NOT NULL GROUP BY event_type, burst""")
def paired_g_per_burst(spark, d):
    g = bursts.paired_g_per_burst(burst_cells(spark, d), "m", "event_type", ["seed"])
    return _rounded(g.select("event_type", F.col("burst").cast("long").alias("burst"), "n_pairs", "g"))


@query(f"""WITH {BURSTS}, p AS (SELECT event_type, burst, avg(v) FILTER (WHERE arm_key = 'treatment') AS mt, avg(v) FILTER (WHERE arm_key = 'baseline') AS mb, stddev_samp(v) FILTER (WHERE arm_key = 'treatment') AS st, stddev_samp(v) FILTER (WHERE arm_key = 'baseline') AS sb FROM arms GROUP BY event_type, burst)
    SELECT event_type, burst, round((mt - mb) / sqrt((st * st + sb * sb) / 2), 6) AS d FROM p""")
def stratum_effect_panel_per_burst(spark, d):
    e = bursts.effects_per_burst(burst_cells(spark, d), "m", "event_type")
    return _rounded(e.select("event_type", F.col("burst").cast("long").alias("burst"), "d"))


def _linked(spark, d):
    cells = burst_cells(spark, d).withColumn("s", arrays.by_burst(F.col("x"), 4, arrays.std))
    return bursts.link_per_burst(cells, "m", "s", "event_type", ["seed"])


@query(f"""WITH {BURSTS}, sd AS (SELECT user_id, event_type, b AS burst, stddev_pop(v) AS s FROM (SELECT l.*, k.b FROM long l JOIN (SELECT unnest(range(4)) AS b) k ON l.i >= floor(l.n * k.b / 4.0) AND l.i < floor(l.n * (k.b + 1) / 4.0)) GROUP BY user_id, event_type, b), j AS (SELECT a.*, sd.s FROM arms a JOIN sd USING (user_id, event_type, burst)),
    k AS (SELECT event_type, burst, seed, avg(v) FILTER (WHERE arm_key = 'treatment') - avg(v) FILTER (WHERE arm_key = 'baseline') AS dp, avg(s) FILTER (WHERE arm_key = 'treatment') - avg(s) FILTER (WHERE arm_key = 'baseline') AS dt FROM j GROUP BY event_type, burst, seed)
    SELECT event_type, burst, count(*) AS n_pairs, round(corr(-dp, dt), 6) AS r, round(regr_slope(dt, -dp), 6) AS slope FROM k WHERE dp IS NOT NULL AND dt IS NOT NULL GROUP BY event_type, burst""")
def paired_link_per_burst(spark, d):
    return _rounded(_linked(spark, d).select("event_type", F.col("burst").cast("long").alias("burst"), "n_pairs", "r", "slope"))


STATS = BURSTS + """, sd AS (SELECT user_id, event_type, b AS burst, stddev_pop(v) AS s FROM (SELECT l.*, k.b FROM long l JOIN (SELECT unnest(range(4)) AS b) k ON l.i >= floor(l.n * k.b / 4.0) AND l.i < floor(l.n * (k.b + 1) / 4.0)) GROUP BY user_id, event_type, b),
    j AS (SELECT a.*, sd.s FROM arms a JOIN sd USING (user_id, event_type, burst))"""
LINKS = STATS + """, k AS (SELECT event_type, burst, seed, avg(v) FILTER (WHERE arm_key = 'treatment') - avg(v) FILTER (WHERE arm_key = 'baseline') AS dp, avg(s) FILTER (WHERE arm_key = 'treatment') - avg(s) FILTER (WHERE arm_key = 'baseline') AS dt FROM j GROUP BY event_type, burst, seed),
    links AS (SELECT event_type, burst, count(*) AS n, corr(-dp, dt) AS r FROM k WHERE dp IS NOT NULL AND dt IS NOT NULL GROUP BY event_type, burst)"""


def _average_rank(over: str, v: str) -> str:
    return f"rank() OVER ({over} ORDER BY {v}) + (count(*) OVER ({over.replace('PARTITION BY ', 'PARTITION BY ' + v + ', ') if over else 'PARTITION BY ' + v}) - 1) / 2.0::DOUBLE"


DYNAMIC = STATS + f""", t AS (SELECT event_type, burst, CASE WHEN arm_key = 'treatment' THEN 1.0 ELSE 0.0 END AS a, v AS o, s AS m FROM j), r AS (SELECT event_type, burst, {_average_rank('PARTITION BY event_type, burst', 'a')} AS a, {_average_rank('PARTITION BY event_type, burst', 'o')} AS o, {_average_rank('PARTITION BY event_type, burst', 'm')} AS m FROM t),
    c AS (SELECT event_type, burst, count(*) AS n, corr(a, o) AS ao, corr(a, m) AS am, corr(o, m) AS om FROM r GROUP BY event_type, burst), dynamic AS (SELECT event_type, burst, n, ao AS marginal, (ao - am * om) / sqrt((1 - am * am) * (1 - om * om)) AS conditional FROM c)"""


def _sign_p(k: str, n: str) -> str:
    """Two-sided sign-test p in SQL."""
    return f"least(1.0, 2 * list_sum(list_transform(range(greatest({k}, {n} - {k}), {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))))"


def _t_p(r: str, n: str) -> str:
    """Two-sided p in SQL of a correlation by the t test with n - 2 degrees of freedom: the distribution's finite series, whose angle has the sine |r|."""
    c2 = f"(1 - {r} * {r})"
    even = f"abs({r}) * list_sum(list_transform(range(0, (({n}) // 2 - 1)::INT), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * {c2} ** j))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt({c2}) * coalesce(list_sum(list_transform(range(0, (({n} - 3) // 2)::INT), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * {c2} ** j)), 0))"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0 WHEN ({n}) % 2 = 0 THEN 1 - ({even}) ELSE 1 - ({odd}) END"


def _tail(k: str, n: str, p: str) -> str:
    """P(X >= k) of k of n in SQL."""
    return f"least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))))"


@query(f"WITH {LINKS}, p AS (SELECT *, {_t_p('r', 'n')} AS p FROM links), h AS (SELECT event_type, coalesce(p < 0.05 AND r < 0, false) AS held FROM p), a AS (SELECT event_type, count(*) AS bursts, count(*) FILTER (WHERE held) AS significant, avg(held::INT) AS share FROM h GROUP BY event_type) SELECT event_type, bursts, significant, share, round({_tail('significant', 'bursts', '0.025')}, 8) AS p FROM a")
def phase_link_consistency(spark, d):
    return bursts.phase_consistency(_linked(spark, d), -1, by=["event_type"]).withColumn("p", F.round("p", 8))


def _dynamic(spark, d):
    cells = burst_cells(spark, d).withColumn("s", arrays.by_burst(F.col("x"), 4, arrays.std))
    return bursts.dynamic_partial(cells, "s", "m", "event_type")


@query(f"WITH {DYNAMIC} SELECT event_type, burst, n, marginal, conditional FROM dynamic")
def dynamic_partial_spearman(spark, d):
    return _dynamic(spark, d).withColumn("burst", F.col("burst").cast("long"))


@query(f"WITH {DYNAMIC} SELECT event_type, burst, n, marginal, conditional, 'ok' AS status FROM dynamic")
def dynamic_partial_spearman_multi(spark, d):
    cells = burst_cells(spark, d).withColumn("s", arrays.by_burst(F.col("x"), 4, arrays.std))
    return bursts.dynamic_partial_multi(cells, ["s"], "m", "event_type").withColumn("burst", F.col("burst").cast("long"))


def traced_cells(spark, d, coarse=40):
    """One cell per user and type: the series as outcome per burst, two mediators that are the outcome in coarse and in fine steps, and the arm by the mean."""
    cells = event_cells(spark, d).withColumn("arm_key", F.when(arrays.mean(F.col("x")) > 50, "treatment").otherwise("baseline"))
    step = lambda size: F.transform("x", lambda v: F.floor(v / size).cast("double"))
    return cells.withColumn("coarse", step(coarse)).withColumn("fine", step(5))


def _traced(replicates: int, least: int, coarse: int = 40) -> str:
    """SQL: per type, burst and replicate the weighted rank correlations of arm, outcome and both mediators."""
    steps = ", ".join(map(str, traced.poisson_steps()))
    rank = lambda v: f"sum(k) OVER (PARTITION BY event_type, burst, r ORDER BY {v}) - (sum(k) OVER (PARTITION BY event_type, burst, r, {v}) - 1) / 2.0 AS {v}"
    corr = lambda x, y: f"CASE WHEN vx{x} > 1e-9 AND vx{y} > 1e-9 THEN greatest(-1, least(1, (s{x}{y} - s{x} * s{y} / n) / sqrt(vx{x} * vx{y}))) END AS {x}{y}"
    pairs = [("a", "o"), ("a", "c"), ("a", "f"), ("o", "c"), ("o", "f"), ("c", "f")]
    given = lambda xy, xz, yz: f"CASE WHEN 1 - {xz} * {xz} > 1e-12 AND 1 - {yz} * {yz} > 1e-12 THEN ({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz})) END"
    return SERIES + f""", cells AS (SELECT user_id, event_type, x, CASE WHEN list_avg(x) > 50 THEN 1 ELSE 0 END AS a FROM series),
    t AS (SELECT user_id, event_type, i AS burst, a, x[i + 1] AS o, floor(x[i + 1] / {coarse}) AS c, floor(x[i + 1] / 5) AS f FROM (SELECT *, unnest(range(len(x))) AS i FROM cells)),
    u AS (SELECT user_id, r, ('0x' || substr(md5('42:' || user_id || ':' || (r - 1) // 4), ((r - 1) % 4 * 8 + 1)::INT, 8))::BIGINT AS u FROM (SELECT DISTINCT user_id FROM t), (SELECT unnest(range(1, {replicates + 1})) AS r)),
    w AS (SELECT user_id, r, len(list_filter([{steps}], lambda s: s <= u)) AS k FROM u UNION ALL SELECT DISTINCT user_id, 0, 1 FROM t),
    k AS (SELECT event_type, burst, r, k, a, o, c, f FROM t JOIN w USING (user_id) WHERE k > 0),
    q AS (SELECT event_type, burst, r, k::DOUBLE AS k, {', '.join(map(rank, 'aocf'))} FROM k),
    s AS (SELECT event_type, burst, r, sum(k)::BIGINT AS n, {', '.join(f'sum(k * {v}) AS s{v}, sum(k * {v} * {v}) - sum(k * {v}) ** 2 / sum(k) AS vx{v}' for v in 'aocf')}, {', '.join(f'sum(k * {x} * {y}) AS s{x}{y}' for x, y in pairs)} FROM q GROUP BY event_type, burst, r),
    m AS (SELECT event_type, burst, r, n, {', '.join(corr(x, y) for x, y in pairs)} FROM s WHERE n >= {least}),
    m1 AS (SELECT *, {given('ao', 'ac', 'oc')} AS ao_c, {given('af', 'ac', 'cf')} AS af_c, {given('of', 'oc', 'cf')} AS of_c FROM m),
    tr AS (SELECT s.event_type, s.burst, s.r, s.n, ao AS marginal, CASE WHEN s.n > 4 THEN ao_c END AS given_coarse, CASE WHEN s.n > 5 THEN {given('ao_c', 'af_c', 'of_c')} END AS given_both FROM s LEFT JOIN m1 USING (event_type, burst, r))"""


def _pooled(rho: str, offset: int, name: str) -> str:
    """SQL: per type and replicate the correlations over the bursts pooled by DerSimonian-Laird on Fisher's z."""
    z = f"atanh(greatest(-0.999999, least(0.999999, {rho})))"
    return f"""{name}0 AS (SELECT event_type, r, {z} AS z, (n - {offset})::DOUBLE AS w FROM tr WHERE {rho} IS NOT NULL AND n > {offset}),
    {name}1 AS (SELECT event_type, r, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * z) / sum(w) AS fixed FROM {name}0 GROUP BY event_type, r),
    {name}2 AS (SELECT event_type, r, k, fixed, sw, sw2, sum(w * (z - fixed) ** 2) AS q FROM {name}0 JOIN {name}1 USING (event_type, r) GROUP BY ALL),
    {name}3 AS (SELECT event_type, r, k, fixed, q, CASE WHEN k >= 2 THEN greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) END AS tau2 FROM {name}2),
    {name} AS (SELECT event_type, r, k, tanh(fixed) AS fixed, tau2, CASE WHEN k >= 2 THEN greatest(0, (q - (k - 1)) / q) END AS i2, CASE WHEN k >= 2 THEN tanh(sum(z / (1 / w + tau2)) / sum(1 / (1 / w + tau2))) END AS dl
        FROM {name}0 JOIN {name}3 USING (event_type, r) GROUP BY event_type, r, k, fixed, tau2, q)"""


STATUS = """st AS (SELECT event_type, CASE WHEN count(marginal) = 0 THEN 'UNDERPOWERED_BURSTS' WHEN bool_or(marginal >= 0.05) AND bool_or(marginal <= -0.05) THEN 'SIGN_FLIP_DETECTED'
    WHEN max(abs(marginal)) FILTER (WHERE abs(marginal) >= 0.05) > 2 * min(abs(marginal)) FILTER (WHERE abs(marginal) >= 0.05) THEN 'WEAK_TIME_VARYING' ELSE 'CONSISTENT_DIRECTION' END AS status FROM tr WHERE r = 0 GROUP BY event_type)"""
MEDIATION = f"""WITH {{traced}}, {_pooled('marginal', 3, 'pm')}, {{pooled}}, {STATUS},
    x AS (SELECT event_type, max(CASE WHEN r = 0 THEN k END) AS marginal_bursts, max(CASE WHEN r = 0 THEN fixed END) AS fm, max(CASE WHEN r = 0 THEN dl END) AS marginal_dl, max(CASE WHEN r = 0 THEN tau2 END) AS marginal_tau2, max(CASE WHEN r = 0 THEN i2 END) AS marginal_i2,
        quantile_cont(CASE WHEN r > 0 THEN dl END, [0.025, 0.5, 0.975]) AS qm FROM pm GROUP BY event_type),
    y AS (SELECT event_type, max(CASE WHEN r = 0 THEN k END) AS partial_bursts, max(CASE WHEN r = 0 THEN fixed END) AS fp, max(CASE WHEN r = 0 THEN dl END) AS partial_dl, max(CASE WHEN r = 0 THEN tau2 END) AS partial_tau2, max(CASE WHEN r = 0 THEN i2 END) AS partial_i2,
        quantile_cont(CASE WHEN r > 0 THEN dl END, [0.025, 0.5, 0.975]) AS qp FROM pp GROUP BY event_type)
    SELECT event_type, status, round(CASE WHEN status <> 'SIGN_FLIP_DETECTED' THEN fm END, 6) AS rho_marginal, round(CASE WHEN status <> 'SIGN_FLIP_DETECTED' THEN fp END, 6) AS rho_partial, marginal_bursts, round(marginal_dl, 6) AS marginal_dl, round(marginal_tau2, 6) AS marginal_tau2, round(marginal_i2, 6) AS marginal_i2,
        coalesce(partial_bursts, 0) AS partial_bursts, round(partial_dl, 6) AS partial_dl, round(partial_tau2, 6) AS partial_tau2, round(partial_i2, 6) AS partial_i2, round(qm[1], 6) AS marginal_lower, round(qm[2], 6) AS marginal_median, round(qm[3], 6) AS marginal_upper, round(qp[1], 6) AS partial_lower, round(qp[2], 6) AS partial_median, round(qp[3], 6) AS partial_upper
    FROM st JOIN x USING (event_type) LEFT JOIN y USING (event_type)"""


@query(MEDIATION.format(traced=_traced(60, 5), pooled=_pooled("given_coarse", 4, "pp")))
def dynamic_mediation_interval(spark, d):
    return _rounded(_whole(traced.mediation(traced_cells(spark, d), ["coarse"], "x", ["event_type"], "user_id", replicates=60)))


@query(MEDIATION.format(traced=_traced(20, 5), pooled=_pooled("given_both", 5, "pp")))
def dynamic_mediation_joint(spark, d):
    return _rounded(_whole(traced.mediation(traced_cells(spark, d), ["coarse", "fine"], "x", ["event_type"], "user_id", replicates=20)))


def _whole(df: DataFrame) -> DataFrame:
    """Counts of array elements as long."""
    return df.select(*[columns.col(n).cast("long").alias(n) if t == "int" else columns.col(n) for n, t in df.dtypes])


def _edges(given: str, mediators: int) -> str:
    """SQL: edges of the traced bursts given a set of mediators."""
    return f"""e AS (SELECT *, {_t_p('marginal', 'n')} AS p_marginal, CASE WHEN n > {3 + mediators} AND {given} IS NOT NULL THEN abs(atanh(greatest(-0.999999, least(0.999999, {given})))) * sqrt(n - {3 + mediators}) END AS z FROM tr),
    ed AS (SELECT event_type, burst, r, coalesce(p_marginal < 0.05, false) AS edge, coalesce(z > 1.959963984540054, false) AS linked FROM e)"""


@query(f"WITH {_traced(0, 8)}, {_edges('given_coarse', 1)} SELECT event_type, count(*) AS bursts, count(*) FILTER (WHERE edge) AS marginal_edges, count(*) FILTER (WHERE edge AND NOT linked) AS separated, count(*) FILTER (WHERE edge AND linked) AS direct FROM ed GROUP BY event_type")
def dynamic_pc_adjacency(spark, d):
    return traced.edge_counts(traced_cells(spark, d), ["coarse"], "x", ["event_type"], "user_id", min_n=8).select("event_type", "bursts", "marginal_edges", "separated", "direct")


@query(f"""WITH {_traced(40, 8)}, {_edges('given_coarse', 1)}, n AS (SELECT event_type, r, count(*) FILTER (WHERE edge) AS m, count(*) FILTER (WHERE edge AND NOT linked) AS s, count(*) FILTER (WHERE edge AND linked) AS d FROM ed GROUP BY event_type, r),
    iv AS (SELECT event_type, quantile_cont(m, [0.025, 0.5, 0.975]) AS m, quantile_cont(s, [0.025, 0.5, 0.975]) AS s, quantile_cont(d, [0.025, 0.5, 0.975]) AS d FROM n WHERE r > 0 GROUP BY event_type)
    SELECT event_type, {', '.join(f'round_even({c}[{i}], 0)::BIGINT AS {n}_{b}' for c, n in (('m', 'marginal_edges'), ('s', 'separated'), ('d', 'direct')) for i, b in ((1, 'lower'), (2, 'median'), (3, 'upper')))} FROM iv""")
def dynamic_edge_intervals(spark, d):
    out = traced.edge_counts(traced_cells(spark, d), ["coarse"], "x", ["event_type"], "user_id", min_n=8, replicates=40)
    return out.drop("bursts", "marginal_edges", "separated", "direct")


def _leak(mediator: str, edges_joint: str) -> str:
    return f"""SELECT '{mediator}' AS mediator, event_type, count(*) FILTER (WHERE n >= 8 AND edge) AS edges, count(*) FILTER (WHERE n >= 8 AND edge AND sib) AS ns, count(*) FILTER (WHERE n >= 8 AND edge AND {edges_joint}) AS nj,
        count(*) FILTER (WHERE n >= 8 AND edge AND {edges_joint} AND NOT sib) AS b, count(*) FILTER (WHERE n >= 8 AND edge AND sib AND NOT {edges_joint}) AS c FROM k2 GROUP BY event_type"""


@query(f"""WITH {_traced(0, 8, 150)}, k1 AS (SELECT *, coalesce({_t_p('marginal', 'n')} < 0.05, false) AS edge, coalesce(abs(atanh(given_coarse)) * sqrt(n - 4) > 1.959963984540054, false) AS dc, coalesce(abs(atanh(given_both)) * sqrt(n - 5) > 1.959963984540054, false) AS db FROM tr), k2 AS (SELECT *, edge AND NOT dc AS sib, edge AND NOT db AS both_sep FROM k1), l AS ({_leak('fine', 'both_sep')})
    SELECT mediator, event_type, edges AS marginal_edges, CASE WHEN edges >= 3 THEN round(100.0 * ns / edges, 6) END AS separated_siblings, CASE WHEN edges >= 3 THEN round(100.0 * nj / edges, 6) END AS separated_joint, CASE WHEN edges >= 3 THEN b ELSE 0 END AS b, CASE WHEN edges >= 3 THEN c ELSE 0 END AS c,
        CASE WHEN edges >= 3 AND b + c > 0 THEN round((b - c - sign(b - c)) / sqrt(b + c), 6) END AS z, CASE WHEN edges >= 3 AND b + c > 0 THEN round({_tail('b', '(b + c)', '0.5')}, 8) END AS p,
        CASE WHEN edges < 3 THEN 'UNDERPOWERED' WHEN b + c < 5 THEN 'UNDERPOWERED_FOR_GENUINE' WHEN {_tail('b', '(b + c)', '0.5')} <= 0.04947146803364814 THEN 'GENUINE' ELSE 'LEAK' END AS disposition FROM l""")
def mediator_leak_adjudication(spark, d):
    out = traced.leak_adjudication(traced_cells(spark, d, 150), "fine", ["coarse"], "x", ["event_type"], "user_id")
    return _rounded(out.select(F.lit("fine").alias("mediator"), "*").withColumn("p", F.round("p", 8)), 8).withColumns({c: F.round(c, 6) for c in ("z", "separated_siblings", "separated_joint")})


@query(f"WITH {CELLS}, k AS (SELECT env_name FROM cells GROUP BY env_name HAVING avg(balance) > 4400) SELECT env_name, count(*) AS n FROM cells WHERE env_name IN (SELECT env_name FROM k) GROUP BY env_name")
def deferred_scope(spark, d):
    return Panel(order_cells(spark, d), ("env_name",)).surviving("balance", "mean", "value > 4400").cells.groupBy("env_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS}, w AS (SELECT *, median(source) OVER (PARTITION BY env_name) AS m FROM cells) SELECT env_name, count(*) AS n FROM w WHERE source > m AND balance > 0 GROUP BY env_name")
def partition_scope(spark, d):
    cells = columns.with_aggregates(order_cells(spark, d), ["env_name"], _m=F.median("source"))
    return cells.where((F.col("source") > F.col("_m")) & columns.finite_gt("balance", 0)).groupBy("env_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT CASE WHEN status = 'O' THEN 'baseline' ELSE 'treatment' END AS contrast_arm, count(*) AS n, round(avg(source), 4) AS mean FROM cells WHERE status IN ('O', 'F') AND seed = 7 GROUP BY 1")
def value_contrast(spark, d):
    c = Contrast.from_values({"status": "F", "seed": 7}, {"status": "O", "seed": 7.0})
    return _rounded(c.applied(order_cells(spark, d)).groupBy("contrast_arm").agg(F.count(F.lit(1)).alias("n"), F.avg("source").alias("mean")), 4)


@query("WITH s AS (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) SELECT round(corr(l_quantity, l_extendedprice), 7) AS qp, round(corr(l_quantity, l_discount), 7) AS qd, round(corr(l_extendedprice, l_discount), 7) AS pd, count(*) AS n FROM s")
def pairwise_correlations(spark, d):
    r = ranks.gram(_read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).first()
    c = ranks.correlations(r)
    return spark.createDataFrame([(round(float(c[0, 1]), 7), round(float(c[0, 2]), 7), round(float(c[1, 2]), 7), r["n"])], "qp double, qd double, pd double, n long")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 7) AS r2, count(*) AS n FROM lineitem")
def least_squares(spark, d):
    f = regression.ols(_read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(f.coefficients[1]), 4), round(float(f.coefficients[0]), 4), round(float(f.r2), 7), f.n)], "slope double, intercept double, r2 double, n long")


def _effects(spark, d) -> DataFrame:
    cells = order_cells(spark, d).withColumn("cell_balance", F.col("balance") / 1000)
    panel = strata.stratum_panel(cells, "source", ["env_name", "seed"])
    return panel.join(cells.groupBy("env_name", "seed").agg(F.avg("cell_balance").alias("z")), ["env_name", "seed"]).where("d_se > 0")


EFFECTS = CELLS + """, e0 AS (SELECT env_name, seed, count(*) FILTER (WHERE arm_key = 'treatment') AS n_t, count(*) FILTER (WHERE arm_key = 'baseline') AS n_b, avg(source) FILTER (WHERE arm_key = 'treatment') AS mt, avg(source) FILTER (WHERE arm_key = 'baseline') AS mb,
    stddev_samp(source) FILTER (WHERE arm_key = 'treatment') AS st, stddev_samp(source) FILTER (WHERE arm_key = 'baseline') AS sb, avg(balance / 1000) AS z FROM cells GROUP BY env_name, seed),
    e1 AS (SELECT env_name, seed, z, n_t, n_b, (mt - mb) / sqrt((st * st + sb * sb) / 2) AS d FROM e0 WHERE n_t >= 3 AND n_b >= 3),
    effects AS (SELECT * FROM (SELECT env_name, seed, z, d AS y, sqrt((n_t + n_b)::DOUBLE / (n_t * n_b) + d * d / (2.0 * (n_t + n_b - 2))) AS s FROM e1) WHERE s > 0)"""
#: Random-effects regression of y on z with errors s, from a table ``effects``.
META = """, mw AS (SELECT y, z, 1 / (s * s) AS w FROM effects), m0 AS (SELECT sum(w) AS sw, sum(w * z) / sum(w) AS zc, sum(w * y) / sum(w) AS yc, sum(w * w) AS sw2, count(*) AS n FROM mw),
    m1 AS (SELECT sum(w * (z - zc) ** 2) AS szz, sum(w * (z - zc) * (y - yc)) AS szy, sum(w * w * (z - zc) ** 2) AS szz2, any_value(sw) AS sw, any_value(sw2) AS sw2, any_value(zc) AS zc, any_value(yc) AS yc, any_value(n) AS n FROM mw, m0),
    m2 AS (SELECT sum(w * (y - yc - szy / szz * (z - zc)) ** 2) AS q, any_value(sw - sw2 / sw - szz2 / szz) AS c, any_value(n) AS n FROM mw, m1), m3 AS (SELECT CASE WHEN c > 0 THEN greatest(0.0, (q - (n - 2)) / c) ELSE 0.0 END AS tau2 FROM m2),
    v AS (SELECT y, z, 1 / (s * s + tau2) AS w, tau2 FROM effects, m3), v0 AS (SELECT sum(w) AS sw, sum(w * z) / sum(w) AS zc, sum(w * y) / sum(w) AS yc, count(*) AS n FROM v),
    v1 AS (SELECT sum(w * (z - zc) ** 2) AS szz, sum(w * (z - zc) * (y - yc)) AS szy, any_value(sw) AS sw, any_value(zc) AS zc, any_value(yc) AS yc, any_value(n) AS n FROM v, v0),
    v2 AS (SELECT sum(w * (y - yc - szy / szz * (z - zc)) ** 2) / (any_value(n) - 2) AS s2, any_value(szy / szz) AS slope, any_value(yc - szy / szz * zc) AS base, any_value(1 / szz) AS v11, any_value(1 / sw + zc * zc / szz) AS v00, any_value(tau2) AS tau2 FROM v, v1)
    SELECT 'intercept' AS term, base AS estimate, sqrt(s2 * v00) AS se, tau2 FROM v2 UNION ALL SELECT '{term}', slope, sqrt(s2 * v11), tau2 FROM v2"""


def _fit(spark: SparkSession, f: regression.Fit) -> DataFrame:
    return spark.createDataFrame([(n, float(b), float(e), float(f.tau2)) for n, b, e in zip(f.names, f.coefficients, f.errors, strict=True)], "term string, estimate double, se double, tau2 double")


@query(f"WITH {EFFECTS}" + META.format(term="z"))
def meta_regression(spark, d):
    return _fit(spark, regression.meta_regression(_effects(spark, d), "d", "d_se", ["z"]))


@query(f"WITH {EFFECTS}" + META.format(term="thousands"))
def meta_regression_unpaired_d(spark, d):
    cells = order_cells(spark, d).withColumn("thousands", F.col("balance") / 1000)
    return _fit(spark, regression.meta_regression_unpaired_d(cells, "source", ["env_name", "seed"], ["thousands"]))


@query(f"WITH {GS}, b AS (SELECT env_name, avg(balance) AS z FROM cells GROUP BY env_name), effects AS (SELECT g AS y, g_se AS s, z FROM ge JOIN b USING (env_name) WHERE g_se > 0)" + META.format(term="balance"))
def meta_regression_paired_g(spark, d):
    return _fit(spark, regression.meta_regression_paired_g(order_cells(spark, d), "source", "env_name", ["seed"], ["balance"]))


BURST_G = BURSTS + """, k AS (SELECT event_type, burst, seed, avg(v) FILTER (WHERE arm_key = 'treatment') - avg(v) FILTER (WHERE arm_key = 'baseline') AS delta FROM arms GROUP BY event_type, burst, seed),
    g0 AS (SELECT event_type, burst, count(delta) AS n, avg(delta) / stddev_samp(delta) * (1 - 3.0 / (4 * count(delta) - 5)) AS g FROM k WHERE delta IS NOT NULL GROUP BY event_type, burst), g AS (SELECT event_type, burst, g AS y, sqrt(1.0 / n + g * g / (2.0 * n)) AS s FROM g0)"""


@query(f"WITH {BURST_G}, effects AS (SELECT y, s, burst::DOUBLE AS z FROM g)" + META.format(term="burst"))
def meta_regression_per_burst(spark, d):
    return _fit(spark, regression.meta_regression_per_burst(burst_cells(spark, d), "m", "event_type", ["seed"], []))


@query()
def meta_regression_folds(spark, d):
    found = regression.cross_validate(_effects(spark, d), "d", "d_se", ["z"])
    return spark.createDataFrame([(n, v["mean"], v["sd"], v["same_sign"]) for n, v in found.items()], "term string, mean double, sd double, same_sign double")


#: Between and within slopes of y on x by stratum with weights w, from a table ``rows``: the two parts are taken apart in turn.
MUNDLAK = """, mb AS (SELECT *, avg(x) OVER (PARTITION BY k) AS b FROM rows), c0 AS (SELECT y, b, x - b AS h, w, (sum(w * y) OVER ()) / (sum(w) OVER ()) AS yc, (sum(w * b) OVER ()) / (sum(w) OVER ()) AS bc, (sum(w * (x - b)) OVER ()) / (sum(w) OVER ()) AS hc FROM mb),
    t AS (SELECT sum(w * (b - bc) ** 2) AS bb, sum(w * (h - hc) ** 2) AS hh, sum(w * (b - bc) * (h - hc)) AS bh, sum(w * (b - bc) * (y - yc)) AS by_, sum(w * (h - hc) * (y - yc)) AS hy, count(*) AS n FROM c0)
    SELECT n, (by_ * hh - hy * bh) / (bb * hh - bh * bh) AS between, (hy * bb - by_ * bh) / (bb * hh - bh * bh) AS within FROM t"""


@query(f"WITH {EFFECTS}, rows AS (SELECT env_name AS k, z AS x, y, 1 / (s * s) AS w FROM effects)" + MUNDLAK)
def mundlak_decomposition(spark, d):
    m = regression.mundlak(_effects(spark, d), "env_name", "z", "d", "d_se")
    return spark.createDataFrame([(m["n"], m["between"], m["within"])], "n long, between double, within double")


@query()
def mundlak_hausman(spark, d):
    m = regression.mundlak(_effects(spark, d), "env_name", "z", "d", "d_se")
    return spark.createDataFrame([(m["hausman_t"], m["hausman_p"])], "hausman_t double, hausman_p double")


@query(f"WITH {BURST_G}, x AS (SELECT event_type, burst, avg(v) AS x FROM arms GROUP BY event_type, burst), rows AS (SELECT event_type AS k, x, y, 1 / (s * s) AS w FROM g JOIN x USING (event_type, burst))" + MUNDLAK)
def mundlak_paired_g_per_burst(spark, d):
    m = regression.mundlak_paired_g_per_burst(burst_cells(spark, d), "m", "m", "event_type", ["seed"])
    return spark.createDataFrame([(m["n"], m["between"], m["within"])], "n long, between double, within double")


def _partialled(table: str, y: str, t: str, given: list[str]) -> str:
    """CTEs f0 to fk: y and t freed from each of ``given`` in turn (which are freed from one another), so that the slope of y on t in
    the last is the coefficient in the joint regression."""
    names = ["y", "t", *[f"x{i}" for i in range(len(given))]]
    out = f"f0 AS (SELECT {', '.join(f'({c})::DOUBLE - avg({c}) OVER () AS {n}' for c, n in zip((y, t, *given), names))} FROM {table})"
    for k in range(len(given)):
        rest = [n for n in names if n in ("y", "t") or n[0] == "x" and int(n[1:]) > k]
        out += f", b{k} AS (SELECT {', '.join(f'sum({n} * x{k}) / sum(x{k} * x{k}) AS s_{n}' for n in rest)} FROM f{k}), f{k + 1} AS (SELECT {', '.join(f'{n} - s_{n} * x{k} AS {n}' for n in rest)} FROM f{k}, b{k})"
    return out


@query(f"WITH a AS (SELECT regr_slope(l_extendedprice, l_quantity) AS total FROM lineitem), {_partialled('lineitem', 'l_extendedprice', 'l_quantity', ['l_discount', 'l_tax'])}, c AS (SELECT sum(y * t) / sum(t * t) AS direct FROM f2) SELECT total, direct, total - direct AS indirect, (total - direct) / total AS share FROM a, c")
def mediation(spark, d):
    m = regression.mediation(_read(spark, d, "lineitem"), "l_quantity", ["l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([tuple(m.values())], ", ".join(f"{k} double" for k in m))


_EDGES = {("l_tax", "l_quantity"), ("l_tax", "l_extendedprice"), ("l_quantity", "l_extendedprice")}


@query(f"WITH {_partialled('lineitem', 'l_extendedprice', 'l_quantity', ['l_tax'])}, c AS (SELECT sum(y * t) / sum(t * t) AS ate, sum(t * t) AS tt, count(*) AS n FROM f1), r AS (SELECT sum((y - ate * t) ** 2) AS rss FROM f1, c) SELECT 'l_tax' AS adjusted_for, ate, sqrt(rss / (n - 3) / tt) AS se, n FROM c, r")
def backdoor_ate(spark, d):
    a = regression.backdoor_ate(_read(spark, d, "lineitem"), _EDGES, "l_quantity", "l_extendedprice", ["l_tax", "l_discount"])
    return spark.createDataFrame([(",".join(a["adjusted_for"]), a["ate"], a["se"], a["n"])], "adjusted_for string, ate double, se double, n long")


@query()
def refuters(spark, d):
    rows = _read(spark, d, "lineitem")
    return spark.createDataFrame([(regression.refute_placebo(rows, "l_quantity", "l_extendedprice", ["l_tax"]), regression.refute_common_cause(rows, "l_quantity", "l_extendedprice", ["l_tax"]))], "placebo double, drift double")


@query(f"""WITH w AS (SELECT l_extendedprice AS x, l_discount AS y, l_extendedprice * (1 - 5 * l_discount) AS c FROM lineitem), r AS (SELECT {_average_rank('', 'x')} AS x, {_average_rank('', 'y')} AS y, {_average_rank('', 'c')} AS c FROM w),
    z AS (SELECT abs(atanh(corr(x, y))) * sqrt(count(*) - 3) AS xy, abs(atanh(corr(x, c))) * sqrt(count(*) - 3) AS xc, abs(atanh(corr(y, c))) * sqrt(count(*) - 3) AS yc FROM r)
    SELECT unnest(['l_extendedprice', 'l_discount']) AS a, 'charge' AS b, true AS directed FROM z WHERE xy < 1.959964 AND xc > 10 AND yc > 10""")
def pc_discovery(spark, d):
    rows = _read(spark, d, "lineitem").withColumn("charge", F.col("l_extendedprice") * (1 - 5 * F.col("l_discount")))
    found = discovery.pc(rows, ["l_extendedprice", "l_discount", "charge"])
    return spark.createDataFrame([(*p, k == "directed") for k in found for p in found[k]], "a string, b string, directed boolean")


@query()
def bootstrap_paired_g(spark, d):
    return paired.bootstrap_g(paired.pairs(order_cells(spark, d), "source", ["seed"], ["env_name"]))


@query(f"""WITH {PAIRS} SELECT env_name, count(*)::DOUBLE AS n, abs(skewness(delta)) > 1 AS skewed, kurtosis(delta) > 5 AS heavy FROM deltas GROUP BY env_name""")
def assumption_flags(spark, d):
    return paired.shape_flags(paired.pairs(order_cells(spark, d), "source", ["seed"], ["env_name"]), ["env_name"]).select("env_name", "n", "skewed", "heavy")


@query()
def paired_directional(spark, d):
    rows = paired.paired_g(paired.pairs(order_cells(spark, d), "source", ["seed"], ["env_name"]), ["env_name"]).collect()
    out = [(r["env_name"], x["t"], x["p"], x["dz"], x["dz_low"], x["dz_high"], special.mde_paired(r["n_pairs"])) for r in rows for x in [paired.directional(r, "positive")] if "t" in x]
    return spark.createDataFrame(out, "env_name string, t double, p double, dz double, dz_low double, dz_high double, mde double")


@query("""WITH i AS (SELECT DISTINCT o_orderkey::VARCHAR AS i FROM orders JOIN customer ON o_custkey = c_custkey), h AS (SELECT count(*) AS n, sum(('0x' || substr(md5(i), 1, 13))::BIGINT)::HUGEINT AS h1, sum(('0x' || substr(md5(i), 14, 13))::BIGINT)::HUGEINT AS h2 FROM i)
    SELECT sha256(concat_ws(':', n::VARCHAR, h1::VARCHAR, h2::VARCHAR)) AS extent FROM h""")
def extent(spark, d):
    return extent_hash(order_cells(spark, d))


@analysis
def pooled(cells: DataFrame, source: str, by: list[str], arm: str, treatment: str, baseline: str):
    return strata.arm_diff_pooled(cells, source, by, arm=arm, treatment=treatment, baseline=baseline)[1].first()


@claim_bridge(source="source", target="price", contrast=Contrast(), pair_by=("env_name", "seed"), stratify_by=("env_name",), scope="balance > 0", scope_columns=("balance",), predicted="positive", tier="interventional")
def urgent_orders_cost_more(pooled, predicted_sign: str = "positive") -> str:
    return effects.random_effects_verdict(pooled, predicted_sign)


@query()
def claim_verdict(spark, d):
    r = evaluate(urgent_orders_cost_more, order_cells(spark, d))
    return spark.createDataFrame([(r.name, r.verdict, ";".join(f"{f.level}:{f.gate}" for f in r.findings), r.extent)], "claim string, verdict string, findings string, extent string")


@query(f"WITH {PANEL}, a AS (SELECT count(*) FILTER (WHERE d > 0) AS k, count(*) AS n FROM panel) SELECT k AS positive, n AS strata, {_sign_p('k', 'n')} AS p FROM a")
def cross_env_consistency_p(spark, d):
    counts = strata.sign_counts(strata.stratum_panel(order_cells(spark, d), "source", ["env_name"]))
    return strata.with_sign_p(counts, "positive", "strata").select("positive", "strata", "p")


IMPROVEMENT = CELLS + """, c AS (SELECT env_name, source AS v, count(*) FILTER (WHERE arm_key = 'treatment') AS t, count(*) FILTER (WHERE arm_key = 'baseline') AS b FROM cells WHERE arm_key IN ('treatment', 'baseline') GROUP BY env_name, source),
    w AS (SELECT *, t * (coalesce(sum(b) OVER (PARTITION BY env_name ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2.0) AS won FROM c), poi AS (SELECT env_name, (sum(won) / (sum(t) * sum(b)))::DOUBLE AS p FROM w GROUP BY env_name)"""


def _improved(floor: int, count: int) -> str:
    """SQL: the probability of improvement of each stratum with enough cells, for the sample and its resamples by order."""
    steps = ", ".join(map(str, traced.poisson_steps()))
    return CELLS + f""", arms AS (SELECT env_name, seed, id, source AS v, arm_key = 'treatment' AS t FROM cells WHERE arm_key IN ('treatment', 'baseline')),
    e AS (SELECT env_name, seed FROM arms GROUP BY env_name, seed HAVING count(*) FILTER (WHERE t) >= {floor} AND count(*) FILTER (WHERE NOT t) >= {floor}), h AS (SELECT arms.* FROM arms JOIN e USING (env_name, seed)),
    w AS (SELECT h.*, r, len(list_filter([{steps}], lambda s: s <= ('0x' || substr(md5('42:' || id || ':' || (r - 1) // 4), ((r - 1) % 4 * 8 + 1)::INT, 8))::BIGINT)) AS k FROM h, (SELECT unnest(range(1, {count + 1})) AS r) UNION ALL SELECT *, 0, 1 FROM h),
    c AS (SELECT env_name, seed, r, v, coalesce(sum(k) FILTER (WHERE t), 0) AS nt, coalesce(sum(k) FILTER (WHERE NOT t), 0) AS nb FROM w GROUP BY env_name, seed, r, v),
    o AS (SELECT *, nt * (coalesce(sum(nb) OVER (PARTITION BY env_name, seed, r ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + nb / 2.0::DOUBLE) AS won FROM c),
    poi AS (SELECT env_name, seed, r, CASE WHEN sum(nt) * sum(nb) > 0 THEN sum(won) / (sum(nt) * sum(nb)) END AS p FROM o GROUP BY env_name, seed, r)"""


@query(f"""WITH {IMPROVEMENT}, x AS (SELECT p - 0.5 AS x, row_number() OVER (ORDER BY env_name) - 1 AS i FROM poi), n AS (SELECT count(*) AS n, sum(x) AS s FROM x), f AS (SELECT unnest(range(1 << (SELECT n FROM n)::INT)) AS m),
    g AS (SELECT m, sum(CASE WHEN (m >> i::INT) & 1 = 1 THEN -x ELSE x END) AS s FROM f, x GROUP BY m) SELECT (SELECT count(*) FROM poi) AS strata, (SELECT round(avg(p), 10) FROM poi) AS mean, avg(CASE WHEN g.s >= n.s - 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END) AS p, 1::BIGINT << (SELECT n FROM n) AS flips, true AS exact FROM g, n""")
def cross_env_probability_of_improvement(spark, d):
    out = improvement.mean_improvement(order_cells(spark, d), "source", ["env_name"], "id", count=0)
    return out.select("strata", F.round("mean", 10).alias("mean"), "p", "flips", "exact")


@query(f"""WITH {_improved(5, 60)}, m AS (SELECT r, avg(p) AS mean, count(p) AS strata FROM poi GROUP BY r), d AS (SELECT '{{"env_name":"' || env_name || '","seed":' || seed || '}}' AS k, p - 0.5 AS d FROM poi WHERE r = 0),
    f AS (SELECT m, sum(CASE WHEN substr(md5('42:' || k || ':' || m), 1, 1) < '8' THEN d ELSE -d END) AS s FROM d, (SELECT unnest(range(2000)) AS m) GROUP BY m)
    SELECT (SELECT strata FROM m WHERE r = 0) AS strata, (SELECT round(mean, 10) FROM m WHERE r = 0) AS mean, round(quantile_cont(mean, 0.025), 10) AS lower, round(quantile_cont(mean, 0.975), 10) AS upper,
        (SELECT avg((s >= (SELECT sum(d) FROM d) - 1e-12)::INT) FROM f) AS p, 2000::BIGINT AS flips, false AS exact FROM m WHERE r > 0""")
def improvement_interval(spark, d):
    out = improvement.mean_improvement(order_cells(spark, d), "source", ["env_name", "seed"], "id", count=60, most=0, draws=2000)
    return out.withColumns({c: F.round(c, 10) for c in ("mean", "lower", "upper")})


@query(f"WITH {RANKS}, zs AS (SELECT atanh(xy) AS z, 1 / sqrt(n - 3) AS z_se FROM c), pool AS (SELECT * FROM (" + "WITH dummy AS (SELECT 1)" + POOL.format(y="z", s="z_se", t="zs").replace("round(", "(").replace(", 6)", ")").replace(", 8)", ")") + ")) SELECT k, q, tau2, pooled, pooled_se, tanh(pooled) AS rho FROM pool")
def fisher_z_dl_pool(spark, d):
    rows = ranks.spearman(order_cells(spark, d), "source", "balance", ["env_name"])
    return bursts.fisher_z_dl_pool(rows, "rho", "n", 3).select("k", "q", "tau2", "pooled", "pooled_se", "rho")


@query(f"WITH {RANKS} SELECT env_name, n, xy AS rho, atanh(xy) * sqrt(n - 3) AS z FROM c")
def marginal_spearman_z(spark, d):
    return ranks.with_fisher_p(ranks.spearman(order_cells(spark, d), "source", "balance", ["env_name"])).select("env_name", "n", "rho", "z")


LINE_RANKS = f"ranks AS (SELECT {_average_rank('', 'l_extendedprice')} AS y, {_average_rank('', 'l_quantity')} AS t, {_average_rank('', 'l_discount')} AS u, {_average_rank('', 'l_tax')} AS v FROM lineitem)"


@query(f"WITH {LINE_RANKS}, {_partialled('ranks', 'y', 't', ['u', 'v'])} SELECT count(*) AS n, corr(y, t) AS rho, atanh(corr(y, t)) * sqrt(count(*) - 5) AS z FROM f2")
def partial_spearman_multi(spark, d):
    return ranks.partial_spearman_multi(_read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_discount", "l_tax"], []).select("n", "rho", "z")


DELTAS = CELLS + """, p AS (SELECT env_name, seed, avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline') AS x, avg(balance) FILTER (WHERE arm_key = 'treatment') - avg(balance) FILTER (WHERE arm_key = 'baseline') AS y, avg(balance) FILTER (WHERE arm_key = 'baseline') AS z
    FROM cells GROUP BY env_name, seed HAVING least(count(*) FILTER (WHERE arm_key = 'treatment'), count(*) FILTER (WHERE arm_key = 'baseline')) >= 3)"""


@query(f"""WITH {DELTAS}, m AS (SELECT {_average_rank('', 'x')} AS x, {_average_rank('', 'y')} AS y FROM p), r AS (SELECT env_name, {_average_rank('PARTITION BY env_name', 'x')} AS x, {_average_rank('PARTITION BY env_name', 'y')} AS y, {_average_rank('PARTITION BY env_name', 'z')} AS z FROM p),
    c AS (SELECT env_name, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY env_name), q AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS pr FROM c)
    SELECT 'marginal' AS kind, CASE WHEN count(*) >= 4 THEN corr(x, y) END AS rho, count(*) AS n FROM m UNION ALL SELECT 'stratified', tanh(sum((n - 3) * atanh(xy)) / sum(n - 3)), sum(n)::BIGINT FROM c WHERE n >= 4 AND xy IS NOT NULL
    UNION ALL SELECT 'stratified_partial', tanh(sum((n - 4) * atanh(greatest(-0.999999, least(0.999999, pr)))) / sum(n - 4)), sum(n)::BIGINT FROM q WHERE n >= 5 AND pr IS NOT NULL""")
def stratum_panel_jci_spearman(spark, d):
    return ranks.jci_panel(order_cells(spark, d), "source", "balance", "env_name", ["env_name", "seed"])


@query(f"WITH {EFFECTS}, r AS (SELECT {_average_rank('', 'z')} AS x, {_average_rank('', 'y')} AS y FROM effects) SELECT count(*) AS n, corr(x, y) AS rho, atanh(corr(x, y)) * sqrt(count(*) - 3) AS z FROM r")
def cross_stratum_property_slope(spark, d):
    cells = order_cells(spark, d)
    panel = strata.steady_panel(cells, "source", ["env_name", "seed"]).where("d_se > 0")
    levels = columns.steady_sums(cells, ["env_name", "seed"], z=F.col("balance") / 1000).select("env_name", "seed", (F.col("z") / F.col("z_n")).alias("z"))
    return ranks.property_slope(panel.join(levels, ["env_name", "seed"]), "d", "z").select("n", "rho", "z")


@query(f"""WITH {CELLS}, p AS (SELECT seed, avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline') AS x, avg(balance) FILTER (WHERE arm_key = 'treatment') - avg(balance) FILTER (WHERE arm_key = 'baseline') AS y, avg(customer) FILTER (WHERE arm_key = 'treatment') - avg(customer) FILTER (WHERE arm_key = 'baseline') AS z
    FROM cells GROUP BY seed HAVING least(count(*) FILTER (WHERE arm_key = 'treatment'), count(*) FILTER (WHERE arm_key = 'baseline')) >= 3), r AS (SELECT {_average_rank('', 'x')} AS x, {_average_rank('', 'y')} AS y, {_average_rank('', 'z')} AS z FROM p), c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r)
    SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS rho FROM c""")
def cross_stratum_partial_spearman(spark, d):
    return ranks.cross_stratum_slope(order_cells(spark, d), "source", "balance", ["seed"], confound="customer")


@query("WITH c AS (SELECT count(*) FILTER (WHERE l_quantity > 25 AND l_discount <= 0.05) AS b, count(*) FILTER (WHERE l_quantity <= 25 AND l_discount > 0.05) AS c FROM lineitem) SELECT b, c, greatest(abs(b - c) - 1, 0) / sqrt(b + c) * CASE WHEN b >= c THEN 1 ELSE -1 END AS z FROM c")
def mcnemar(spark, d):
    rows = _read(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("first"), (F.col("l_discount") > 0.05).alias("second"))
    m = paired.mcnemar(rows, "first", "second")
    return spark.createDataFrame([(m["b"], m["c"], float(m["z"]))], "b long, c long, z double")


@query(f"""WITH {DELTAS}, k AS (SELECT p.y - avg(p.y) OVER w AS y, p.z - avg(p.z) OVER w AS x FROM p WINDOW w AS (PARTITION BY env_name)) SELECT sum(x * y) / sum(x * x) AS slope, count(*) AS n FROM k""")
def stratum_baseline_predictor_link(spark, d):
    f = regression.stratum_baseline_predictor_link(order_cells(spark, d).join(_complete(spark, d), ["env_name", "seed"], "left_semi"), "balance", "balance", "env_name", ["seed"])
    return spark.createDataFrame([(float(f.coefficients[1]), f.n)], "slope double, n long")


def _complete(spark, d):
    """(env_name, seed) with three orders or more in both arms."""
    n = order_cells(spark, d).groupBy("env_name", "seed").agg(*[F.count_if(F.col("arm_key") == a).alias(a) for a in ("treatment", "baseline")])
    return n.where("treatment >= 3 and baseline >= 3").select("env_name", "seed")


@query(f"""WITH {STATS}, p AS (SELECT event_type, burst, avg(v) FILTER (WHERE arm_key = 'treatment') - avg(v) FILTER (WHERE arm_key = 'baseline') AS dp, avg(s) FILTER (WHERE arm_key = 'treatment') - avg(s) FILTER (WHERE arm_key = 'baseline') AS dt FROM j GROUP BY event_type, burst),
    c AS (SELECT dp - avg(dp) OVER (PARTITION BY burst) AS x, dt - avg(dt) OVER (PARTITION BY burst) AS y FROM p) SELECT sum(x * y) / sum(x * x) AS slope, count(*) AS n FROM c""")
def stratum_delta_link(spark, d):
    cells = burst_cells(spark, d).withColumn("s", arrays.by_burst(F.col("x"), 4, arrays.std))
    f = regression.stratum_delta_link(cells, "m", "s", "event_type")
    return spark.createDataFrame([(float(f.coefficients[1]), f.n)], "slope double, n long")


@query(f"WITH {PAIRS} SELECT regr_slope(delta, seed) AS slope, regr_intercept(delta, seed) AS intercept, count(*) AS n FROM deltas")
def paired_continuous_do(spark, d):
    f = regression.paired_continuous_do(order_cells(spark, d), "source", "seed", ["env_name"])
    return spark.createDataFrame([(float(f.coefficients[1]), float(f.coefficients[0]), f.n)], "slope double, intercept double, n long")


#: Thresholds that reach every class of env; BUILDING has none.
LEVELS = {"AUTOMOBILE": 100_000.0, "FURNITURE": 300_000.0, "HOUSEHOLD": 1e9, "MACHINERY": 150_000.0}
LEVEL = "CASE env_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " END"


@query(f"""WITH {CELLS}, e AS (SELECT env_name AS env, count(*) AS n, avg(balance) AS best, avg(source) AS final, avg(CASE WHEN {LEVEL} IS NOT NULL THEN (balance >= {LEVEL})::INT END) AS best_rate, avg(CASE WHEN {LEVEL} IS NOT NULL THEN (source >= {LEVEL})::INT END) AS final_rate FROM cells GROUP BY env_name)
    SELECT *, CASE WHEN final_rate IS NULL THEN 'absent' WHEN final_rate >= 0.5 THEN 'solved' WHEN final_rate > 0 THEN 'partial' ELSE 'unsolved' END AS class FROM e""")
def classify_envs(spark, d):
    return strata.classify_envs(order_cells(spark, d), "env_name", "balance", "source", LEVELS)


@query(f"""WITH {CELLS}, t AS (SELECT env_name, max(source) AS top FROM cells GROUP BY env_name), c AS (SELECT cells.env_name, CASE WHEN source IS NULL THEN 'missing' WHEN top - source <= 0.001 THEN 'saturated' WHEN cells.env_name = 'BUILDING' THEN 'no_threshold' WHEN source >= {LEVEL.replace('env_name', 'cells.env_name')} THEN 'solved' ELSE 'unsolved' END AS cell_class FROM cells JOIN t USING (env_name))
    SELECT env_name, cell_class, count(*) AS n FROM c GROUP BY env_name, cell_class""")
def cell_classes(spark, d):
    return strata.with_cell_class(order_cells(spark, d), "env_name", "source", LEVELS).groupBy("env_name", "cell_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT env_name, avg(source) AS source, avg(balance) AS balance FROM cells GROUP BY env_name")
def env_means(spark, d):
    return strata.env_means(order_cells(spark, d), "env_name", ["source", "balance"])


@query(f"WITH {CELLS} SELECT arm_key, string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) AS seeds, string_agg(DISTINCT status, ',' ORDER BY status) AS status FROM cells GROUP BY arm_key")
def arm_leaves_wide(spark, d):
    w = strata.arm_leaves_wide(order_cells(spark, d), ["arm_key"], ["status", "seed"])
    return w.select("arm_key", F.array_join(F.sort_array("seed"), ",").alias("seeds"), F.array_join("status", ",").alias("status"))


@query(f"""WITH {CELLS}, l AS (SELECT status, unnest(['source', 'balance']) AS metric, unnest([(source - avg(source) OVER w) / stddev_samp(source) OVER w, (balance - avg(balance) OVER w) / stddev_samp(balance) OVER w]) AS v FROM cells WINDOW w AS (PARTITION BY env_name)),
    a AS (SELECT metric, count(v) FILTER (WHERE status = 'O') AS n1, count(v) FILTER (WHERE status = 'F') AS n2, avg(v) FILTER (WHERE status = 'O') AS m1, avg(v) FILTER (WHERE status = 'F') AS m2, var_samp(v) FILTER (WHERE status = 'O') AS v1, var_samp(v) FILTER (WHERE status = 'F') AS v2 FROM l GROUP BY metric)
    SELECT metric, n1, n2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4.0 * (n1 + n2) - 9)) AS g FROM a""")
def mediator_differential_zscore(spark, d):
    return strata.multi_differential(order_cells(spark, d), ["source", "balance"], "env_name", "status", "O", "F", "zscore")


@query("SELECT p_partkey AS id, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def cache_anti_join(spark, d):
    return frames.not_yet(_read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), _read(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT c_mktsegment AS corpus, count(*) AS n FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1) GROUP BY c_mktsegment")
def cache_without_again(spark, d):
    cache = _read(spark, d, "customer").withColumnRenamed("c_mktsegment", "corpus")
    return frames.without(cache, cache.where("c_custkey = 1")).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT c_nationkey AS corpus, count(*) AS cached FROM customer GROUP BY c_nationkey), b AS (SELECT s_nationkey AS corpus, count(*) AS current FROM supplier GROUP BY s_nationkey)
    SELECT corpus, coalesce(cached, 0) AS cached, coalesce(current, 0) AS current, CASE WHEN current IS NULL THEN 'gone' WHEN cached IS NULL THEN 'new' WHEN cached = current THEN 'fresh' ELSE 'stale' END AS state FROM a FULL JOIN b USING (corpus)""")
def cache_against_sources(spark, d):
    return frames.cache_against_sources(_read(spark, d, "customer").withColumnRenamed("c_nationkey", "corpus"), _read(spark, d, "supplier").withColumnRenamed("s_nationkey", "corpus")).fillna(0, ["cached", "current"])


@query("""WITH e AS (SELECT l_suppkey AS id, l_linenumber AS c, count(*) AS attempted, count(l_extendedprice) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey, l_linenumber), g AS (SELECT max(l_linenumber) AS last FROM lineitem)
    SELECT id, max(m) FILTER (WHERE c = last) AS price_mean, coalesce(max(n) FILTER (WHERE c = last), 0) AS price_terminal_n, max(m) FILTER (WHERE c = 1) AS price_mean_at_1, max(m) FILTER (WHERE c = 2) AS price_mean_at_2 FROM e, g GROUP BY id""")
def derived_outcomes(spark, d):
    rows = _read(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice"))
    return frames.derived_outcomes(rows, "l_suppkey", "l_linenumber", ["price"]).select("id", "price_mean", "price_terminal_n", "price_mean_at_1", "price_mean_at_2")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
def merged_shards(spark, d):
    o = _read(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    whole = frames.merged_shards([o.where(F.col("o_orderstatus") == s) for s in "FOP"])
    return whole.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(f"WITH {CELLS} SELECT env_name, count(*) AS n, avg(source) AS mean FROM cells GROUP BY env_name")
def panel_cache(spark, d):
    import uuid

    path = f"{columns.shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    to_cache(Panel(order_cells(spark, d), ("env_name",)), path)
    return from_cache(spark, path).cells.groupBy("env_name").agg(F.count(F.lit(1)).alias("n"), F.avg("source").alias("mean"))


@query()
def moderation(spark, d):
    m = regression.moderation(_read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", 0.05, "l_returnflag")
    return spark.createDataFrame([tuple(m.values())], "slope double, interaction double, se double, p double, n long")


@query("SELECT 1.0 / 3 AS reads_jaccard, regr_r2(l_extendedprice, l_quantity) AS quantity, regr_r2(l_extendedprice, l_tax) AS tax FROM lineitem")
def tautology_audit(spark, d):
    t = regression.tautology_audit(_read(spark, d, "lineitem"), {"l_extendedprice": {"a", "b"}, "l_discount": {"b", "c"}}, "l_extendedprice", "l_discount", ["l_quantity", "l_tax"])
    return spark.createDataFrame([(t["reads_jaccard"], float(t["r2"]["l_quantity"]), float(t["r2"]["l_tax"]))], "reads_jaccard double, quantity double, tax double")


metric("order_log_price", "source")(lambda: F.when(columns.number("source") > 0, F.ln("source")))
metric("order_price_by_balance", "source", "balance")(lambda: F.when(columns.number("balance") > 0, F.col("source") / F.col("balance")))
metric("order_price_score", "order_log_price", "order_price_by_balance")(lambda: F.col("order_log_price") + F.ln("order_price_by_balance"))
MEASURED = CELLS + """, m AS (SELECT id, status, CASE WHEN source > 0 THEN ln(source) END AS order_log_price, CASE WHEN balance > 0 THEN source / balance END AS order_price_by_balance FROM cells),
    s AS (SELECT *, order_log_price + ln(order_price_by_balance) AS order_price_score FROM m)"""


def _store(spark, d) -> tuple[str, list]:
    """A store that is filled in three passes, the last of which forces one metric, and what each pass computed."""
    import uuid

    root, cells = f"{columns.shared_dir(spark)}/measured-{uuid.uuid4().hex}", order_cells(spark, d)
    passes = [materialise(spark, root, cells.where("status = 'F'"), ["order_price_by_balance"])]
    passes.append(materialise(spark, root, cells, ["order_price_score"]))
    passes.append(materialise(spark, root, cells.where("status = 'P'"), ["order_price_score"], force={"order_log_price"}))
    return root, [(k, n, c) for k, counts in enumerate(passes) for n, c in counts.items()]


@query(f"""WITH {MEASURED}, c AS (SELECT 0 AS pass, 'order_price_by_balance' AS metric, count(*) AS computed FROM s WHERE status = 'F'
    UNION ALL SELECT 1, 'order_price_by_balance', count(*) FILTER (WHERE status <> 'F' OR order_price_by_balance IS NULL) FROM s UNION ALL SELECT 1, 'order_log_price', count(*) FROM s UNION ALL SELECT 1, 'order_price_score', count(*) FROM s
    UNION ALL SELECT 2, unnest(['order_log_price', 'order_price_by_balance', 'order_price_score']), unnest([count(*), count(*) FILTER (WHERE order_price_by_balance IS NULL), count(*) FILTER (WHERE order_price_score IS NULL)]) FROM s WHERE status = 'P')
    SELECT * FROM c WHERE computed > 0""")
def measurement_passes(spark, d):
    return spark.createDataFrame(_store(spark, d)[1], "pass int, metric string, computed long")


@query(f"WITH {MEASURED} SELECT id, round(order_log_price, 8) AS order_log_price, round(order_price_by_balance, 8) AS order_price_by_balance, round(order_price_score, 8) AS order_price_score FROM s")
def stored_measurements(spark, d):
    root, _ = _store(spark, d)
    compact(spark, root)
    return _rounded(stored(spark, root).select("id", "order_log_price", "order_price_by_balance", "order_price_score"), 8)


#: A graph of numbers: each line item is an edge from its part's number to its supplier's.
GRAPH = """e AS (SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS flag, l_linestatus AS status FROM lineitem), far AS (SELECT max(source) AS node FROM e),
    b(node, depth) AS (SELECT node, 0 FROM far UNION SELECT target, depth + 1 FROM b JOIN e ON b.node = e.source WHERE depth < 9), d AS (SELECT node, min(depth) AS depth FROM b GROUP BY node),
    lv AS (SELECT d.node, d.depth, min(p.node) AS parent FROM d LEFT JOIN (e JOIN d p ON e.source = p.node) ON e.target = d.node AND p.depth = d.depth - 1 GROUP BY d.node, d.depth)"""


def _graph(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


@query(f"WITH RECURSIVE {GRAPH} SELECT node, depth, coalesce(parent, -1) AS parent FROM lv")
def graph_levels(spark, d):
    edges = _graph(spark, d)
    return multigraph.levels(edges, edges.agg(F.max("source").alias("node"))).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query(f"""WITH RECURSIVE {GRAPH}, last AS (SELECT node FROM lv ORDER BY depth DESC, node LIMIT 1), w(node, parent, depth) AS (SELECT lv.node, parent, depth FROM lv JOIN last USING (node) UNION ALL SELECT lv.node, lv.parent, lv.depth FROM w JOIN lv ON lv.node = w.parent)
    SELECT depth - 1 AS step, parent AS source, w.node AS target, min(flag || status)[1] AS flag, min(flag || status)[2] AS status FROM w JOIN e ON e.source = w.parent AND e.target = w.node GROUP BY w.depth, w.parent, w.node""")
def graph_path(spark, d):
    edges = _graph(spark, d)
    start = edges.agg(F.max("source")).first()[0]
    far = multigraph.levels(edges, edges.agg(F.max("source").alias("node"))).agg(F.min(F.struct(-F.col("depth"), "node"))).first()[0]["node"]
    return multigraph.first_path(edges, start, far)


@query("""WITH a AS (SELECT l_partkey % 50 AS source, l_suppkey % 50 AS target, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_partkey % 50 AS source, l_suppkey % 50 AS target, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'left' ELSE 'right' END AS side, source, target, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n FROM a FULL JOIN b USING (source, target) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def graph_difference(spark, d):
    folded = lambda flag: _graph(spark, d).where(F.col("flag") == flag).select((F.col("source") % 50).alias("source"), (F.col("target") % 50).alias("target"))
    return multigraph.difference(folded("A"), folded("R"))


@query("SELECT l_partkey AS source, l_suppkey AS target, count(*) FILTER (WHERE l_returnflag = 'A') AS first, count(*) FILTER (WHERE l_returnflag = 'R') AS second FROM lineitem GROUP BY l_partkey, l_suppkey HAVING first > 0 AND second > 0")
def conflicting_pairs(spark, d):
    return multigraph.conflicting(_graph(spark, d), "flag", ("A", "R"))


@query(f"""WITH {CELLS}, p0 AS (SELECT env_name, seed, avg(source) FILTER (WHERE arm_key = 'treatment') - avg(source) FILTER (WHERE arm_key = 'baseline') AS dx, avg(balance) FILTER (WHERE arm_key = 'treatment') - avg(balance) FILTER (WHERE arm_key = 'baseline') AS dy
        FROM cells GROUP BY env_name, seed), k AS (SELECT count(*) AS strata, count(*) FILTER (WHERE (dx > 0) = (dy > 0)) AS same FROM p0 WHERE dx IS NOT NULL AND dy IS NOT NULL), a AS (SELECT unnest(['same', 'opposite']) AS alignment, unnest([same, strata - same]) AS aligned, strata FROM k)
    SELECT alignment, aligned, strata, CASE WHEN strata > 0 THEN round({_tail('aligned', 'strata', '0.5')}, 8) END AS p FROM a""")
def alignment_p(spark, d):
    """Differences of arm means stand in for d here, as strata of one nation are small."""
    cells = order_cells(spark, d)
    x, y = (strata.stratum_effects(cells, [m], ["env_name", "seed"]).withColumnRenamed(f"delta_{m}", "d") for m in ("source", "balance"))
    tests = [strata.alignment_test(x, y, ["env_name", "seed"], a).select(F.lit(a).alias("alignment"), "aligned", "strata", F.round("p", 8).alias("p")) for a in ("same", "opposite")]
    return tests[0].unionByName(tests[1])
