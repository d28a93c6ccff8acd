"""One query per strategy, primitive, report, metric and vote, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.operators import binning, diagnostics, ensemble, features, metrics
from shardwright.operators.centroid import NearestCentroid
from shardwright.operators.strategies.balance import StratifiedBalanced
from shardwright.operators.strategies.clustering import FeatureClustering, TSNEClustering
from shardwright.operators.strategies.difficulty import DifficultySplit, UncertaintySplit, entropy, split_by_score
from shardwright.operators.strategies.random import RandomSplit
from shardwright.operators.strategies.regression import RegressionBinning, RegressionStratified
from shardwright.operators.strategies.stratified import HierarchicalStratified, MultilabelStratified, StratifiedKFold, TrainTestSplit
from shardwright.operators.strategies.temporal import TemporalSplit

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(made):
        QUERIES[made.__name__] = made
        if sql is not None:
            SQL[made.__name__] = sql
        return made

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Random splits ------------------------------------------------------------------------------

_RANDOM = "SELECT 'partition_' || (ntile(5) OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) AS partition, * FROM orders"


def _random(spark, sf_dir):
    return RandomSplit(["o_orderkey"], 5).materialize(read(spark, sf_dir, "orders"))


@query(f"SELECT partition, o_orderkey FROM ({_RANDOM})")
def random_split(spark, sf_dir):
    return RandomSplit(["o_orderkey"], 5).assign(read(spark, sf_dir, "orders"))


@query(f"SELECT partition, o_orderstatus, count(*) AS n FROM ({_RANDOM}) GROUP BY ALL")
def random_split_summary(spark, sf_dir):
    return diagnostics.fold_summary(_random(spark, sf_dir), "o_orderstatus")


@query(
    f"""SELECT partition, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice_mean,
    round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, round(var_samp(o_totalprice), 2) AS o_totalprice_var
    FROM ({_RANDOM}) GROUP BY partition"""
)
def partition_moments(spark, sf_dir):
    found = diagnostics.partition_moments(_random(spark, sf_dir), ["o_totalprice"])
    return found.select("partition", "n", *[F.round(f"o_totalprice_{s}", d).alias(f"o_totalprice_{s}") for s, d in (("mean", 4), ("std", 4), ("var", 2))])


# Stratified folds ---------------------------------------------------------------------------


def _quota_sql(counts: str, label: str, k: int) -> str:
    """CTEs that end in ``quota(label, n, quota)``, from ``counts(label, n)``."""
    return f"""
    exact AS (SELECT {label}, n, (sum(n) OVER () - ceil(sum(n) OVER () / CAST({k} AS DOUBLE))) AS rest,
                     (sum(n) OVER () - ceil(sum(n) OVER () / CAST({k} AS DOUBLE))) * n / CAST(sum(n) OVER () AS DOUBLE) AS e FROM {counts}),
    placed AS (SELECT {label}, n, floor(e) AS fl, rest - sum(floor(e)) OVER () AS short,
                      row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, {label}) AS place FROM exact),
    quota AS (SELECT {label}, n, CAST(n - fl - CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM placed)"""


def _hier_sql(table: str, key: str, label: str, k: int, few: int) -> str:
    """CTEs that end in ``folds(fold, label, key)``."""
    return f"""
    classes AS (SELECT {label}, count(*) AS n, count(*) < {k * few} AS is_rare FROM {table} GROUP BY {label}),
    frequent AS (SELECT {label}, n FROM classes WHERE NOT is_rare),
    {_quota_sql("frequent", label, k)},
    fold_list AS (SELECT CAST(range AS INTEGER) AS fold FROM range({k})),
    ordered AS (SELECT fold, t.{label}, t.{key}, quota,
                       row_number() OVER (PARTITION BY fold, t.{label} ORDER BY md5('42:' || fold || ':' || t.{key}), t.{key}) AS rn
                FROM {table} t JOIN quota USING ({label}), fold_list),
    folds AS (SELECT fold, {label}, {key} FROM ordered WHERE rn <= quota
              UNION ALL SELECT fold, t.{label}, t.{key} FROM {table} t JOIN classes USING ({label}), fold_list WHERE is_rare)"""


_KFOLD = """
    counts AS (SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1),
    offsets AS (SELECT o_orderpriority, sum(c) OVER (ORDER BY o_orderpriority) - c AS off FROM counts),
    kfold AS (SELECT CAST((off + row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold,
                     o_orderpriority, o_orderkey FROM orders JOIN offsets USING (o_orderpriority))"""


@query(f"WITH {_KFOLD} SELECT 'partition_' || fold AS partition, o_orderkey FROM kfold")
def stratified_kfold(spark, sf_dir):
    return StratifiedKFold(["o_orderkey"], "o_orderpriority", 5).assign(read(spark, sf_dir, "orders"))


def _nations(spark, sf_dir):
    return HierarchicalStratified(["c_custkey"], "c_nationkey", 30, min_samples_per_class=2), read(spark, sf_dir, "customer")


_NATIONS = f"WITH {_hier_sql('customer', 'c_custkey', 'c_nationkey', 30, 2)}"


@query(f"{_NATIONS} SELECT 'chunk_' || fold AS partition, c_custkey FROM folds")
def hier_stratified(spark, sf_dir):
    strategy, data = _nations(spark, sf_dir)
    return strategy.assign(data)


@query(f"{_NATIONS} SELECT c_nationkey, n, is_rare FROM classes")
def hier_rare_classes(spark, sf_dir):
    strategy, data = _nations(spark, sf_dir)
    return strategy.class_table(data)


@query(f"{_NATIONS} SELECT c_nationkey, n, quota FROM quota")
def hier_quotas(spark, sf_dir):
    from shardwright.operators.quotas import draw_quotas

    strategy, data = _nations(spark, sf_dir)
    return draw_quotas(strategy.class_table(data).where(~F.col("is_rare")).drop("is_rare"), "c_nationkey", 30)


@query(
    f"""{_NATIONS}, per AS (SELECT fold, c_nationkey, count(*) AS n FROM folds GROUP BY ALL)
    SELECT fold, CAST(sum(n) AS BIGINT) AS test_size, count(*) AS test_n_classes, min(n) AS test_min_class, max(n) AS test_max_class FROM per GROUP BY fold"""
)
def fold_statistics(spark, sf_dir):
    strategy, data = _nations(spark, sf_dir)
    return diagnostics.fold_statistics(strategy.folds(data), "c_nationkey")


@query(
    f"""{_NATIONS} SELECT fold, count(DISTINCT c_nationkey) AS n_classes,
    count(DISTINCT c_nationkey) = (SELECT count(DISTINCT c_nationkey) FROM customer) AS complete FROM folds GROUP BY fold"""
)
def fold_validation(spark, sf_dir):
    strategy, data = _nations(spark, sf_dir)
    total = data.select("c_nationkey").distinct().count()
    return diagnostics.fold_validation(strategy.folds(data), "c_nationkey", total)


@query(
    """WITH c AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)
    SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS total, min(n) AS min_count, max(n) AS max_count, count(*) FILTER (n < 60) AS small_classes FROM c"""
)
def class_distribution(spark, sf_dir):
    return diagnostics.class_distribution(read(spark, sf_dir, "customer"), "c_nationkey", 60)


@query(
    f"""WITH counts AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), {_quota_sql("counts", "o_orderpriority", 5)},
    r AS (SELECT o_orderkey, quota, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn
          FROM orders JOIN quota USING (o_orderpriority))
    SELECT CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS partition, o_orderkey FROM r"""
)
def train_test_split(spark, sf_dir):
    return TrainTestSplit(["o_orderkey"], "o_orderpriority", 5).assign(read(spark, sf_dir, "orders"))


@query()
def multilabel_stratified(spark, sf_dir):
    return MultilabelStratified(["doc_id"], ["quality", "toxic"], 5).assign(read(spark, sf_dir, "labels"))


@query(
    """WITH v AS (SELECT 'quality=' || quality AS item FROM labels UNION ALL SELECT 'toxic=' || toxic FROM labels UNION ALL SELECT 'rows' FROM labels)
    SELECT item, count(*) AS n, 5::BIGINT AS folds, true AS even FROM v GROUP BY item"""
)
def multilabel_shares(spark, sf_dir):
    """Every label's rows over the folds: a fifth of them in each, to within one and a half rows."""
    labels = read(spark, sf_dir, "labels")
    dealt = multilabel_stratified(spark, sf_dir).join(labels, "doc_id")
    items = F.explode(F.array(F.concat(F.lit("quality="), F.col("quality").cast("string")), F.concat(F.lit("toxic="), F.col("toxic").cast("string")), F.lit("rows")))
    counts = dealt.select("partition", items.alias("item")).where("item IS NOT NULL").groupBy("item", "partition").agg(F.count("*").alias("c"))
    gap = F.max(F.abs(F.col("c") - F.col("n") / 5))
    sizes = counts.groupBy("item").agg(F.sum("c").alias("n"))
    return counts.join(sizes, "item").groupBy("item", "n").agg(F.count("*").alias("folds"), (gap <= 1.5).alias("even"))


# Time ---------------------------------------------------------------------------------------

_SERIES = """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def _temporal(spark, sf_dir, method):
    return TemporalSplit(["event_id"], "ts", "user_id", 4, method).assign(read(spark, sf_dir, "events"))


@query(
    f"""{_SERIES} SELECT 'split_' || ((floor(1 * (CAST(n AS DOUBLE) / 4)) <= pos)::INT + (floor(2 * (CAST(n AS DOUBLE) / 4)) <= pos)::INT
    + (floor(3 * (CAST(n AS DOUBLE) / 4)) <= pos)::INT) AS partition, user_id, event_id FROM r"""
)
def temporal_sequential(spark, sf_dir):
    return _temporal(spark, sf_dir, "sequential")


@query(
    f"""{_SERIES} SELECT 'split_' || (pos // (n // 4)) AS partition, user_id, event_id FROM r
    WHERE n // 4 > 0 AND pos // (n // 4) < 4 AND (pos // (n // 4) + 1) * (n // 4) <= n"""
)
def temporal_sliding(spark, sf_dir):
    return _temporal(spark, sf_dir, "sliding_window")


@query("SELECT 'split_' || (hour(ts) % 24) AS partition, user_id, event_id FROM events")
def temporal_seasonal(spark, sf_dir):
    return _temporal(spark, sf_dir, "seasonal")


# Bins ---------------------------------------------------------------------------------------

_QCUT = """edges AS (SELECT DISTINCT unnest(quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM orders),
    binned AS (SELECT o_orderkey, CAST(greatest((SELECT count(*) FROM edges WHERE e < o_totalprice) - 1, 0) AS INTEGER) AS bin FROM orders)"""


def _even_bins(bins: str) -> str:
    """A CTE ``binned`` over ``s(low, high, bins)``: left-closed bins of equal width."""
    return f"""s AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, {bins} AS bins FROM orders),
    edges AS (SELECT low + (high - low) * i / bins AS e FROM s, range(1, CAST(bins AS BIGINT)) t(i)),
    binned AS (SELECT o_orderkey, CAST((SELECT count(*) FROM edges WHERE e <= o_totalprice) AS INTEGER) AS bin FROM orders)"""


_FD = "greatest(1, ceil((max(o_totalprice) - min(o_totalprice)) / (2 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / cbrt(count(*)))))"
_SCOTT = "greatest(1, ceil((max(o_totalprice) - min(o_totalprice)) / (3.5 * stddev_samp(o_totalprice) / cbrt(count(*)))))"


def _prices(spark, sf_dir, column):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", column(orders).alias("bin"))


@query(f"WITH {_QCUT} SELECT * FROM binned")
def bin_quantile(spark, sf_dir):
    return _prices(spark, sf_dir, lambda o: binning.bin_by_edges("o_totalprice", binning.quantile_edges(o, "o_totalprice", 5)))


@query(f"WITH {_even_bins('5')} SELECT * FROM binned")
def bin_uniform(spark, sf_dir):
    return _prices(spark, sf_dir, lambda o: binning.digitize("o_totalprice", binning.uniform_edges(o, "o_totalprice", 5)))


@query()
def bin_kmeans(spark, sf_dir):
    return _prices(spark, sf_dir, lambda o: binning.digitize("o_totalprice", binning.kmeans_edges(o, "o_totalprice", 5)))


@query(f"WITH {_even_bins(_FD)} SELECT * FROM binned")
def bin_freedman_diaconis(spark, sf_dir):
    return _prices(spark, sf_dir, lambda o: binning.digitize("o_totalprice", binning.rule_edges(o, "o_totalprice", "freedman_diaconis")))


@query(f"WITH {_even_bins(_SCOTT)} SELECT * FROM binned")
def bin_scott(spark, sf_dir):
    return _prices(spark, sf_dir, lambda o: binning.digitize("o_totalprice", binning.rule_edges(o, "o_totalprice", "scott")))


@query(
    """WITH edges AS (SELECT DISTINCT unnest(quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM orders),
    inner_edges AS (SELECT e FROM edges WHERE e > (SELECT min(e) FROM edges) AND e < (SELECT max(e) FROM edges))
    SELECT o_orderkey, CAST((SELECT count(*) FROM inner_edges WHERE e <= o_totalprice) AS INTEGER) AS bin FROM orders"""
)
def bin_quantile_rule(spark, sf_dir):
    return _prices(spark, sf_dir, lambda o: binning.digitize("o_totalprice", binning.rule_edges(o, "o_totalprice", "quantile", 5)))


def _merge_sql(counts: str, least: str) -> str:
    """CTEs that end in ``merged(bin, merged)``: small bins of ``counts(bin, n)`` merged from left to right."""
    return f"""
    steps AS (SELECT list(n ORDER BY bin) AS sizes, list([bin] ORDER BY bin) AS bins, 1::BIGINT AS pos, ({least})::BIGINT AS least FROM {counts}
              UNION ALL
              SELECT CASE WHEN small THEN sizes[:first - 1] || [sizes[first] + sizes[first + 1]] || sizes[first + 2:] ELSE sizes END,
                     CASE WHEN small THEN bins[:first - 1] || [bins[first] || bins[first + 1]] || bins[first + 2:] ELSE bins END,
                     CASE WHEN small THEN first ELSE pos + 1 END, least
              FROM (SELECT *, sizes[pos] < least AS small, CASE WHEN pos > 1 AND (pos = len(sizes) OR sizes[pos - 1] <= sizes[pos + 1]) THEN pos - 1 ELSE pos END AS first
                    FROM steps WHERE pos <= len(sizes) AND len(sizes) > 1)),
    ended AS (SELECT bins FROM steps WHERE NOT (pos <= len(sizes) AND len(sizes) > 1)),
    merged AS (SELECT unnest(bins[i]) AS bin, CAST(i - 1 AS INTEGER) AS merged FROM ended, (SELECT unnest(range(1, len(bins) + 1)) AS i FROM ended))"""


@query(
    f"""WITH RECURSIVE counts AS (SELECT c_nationkey AS bin, count(*) AS n FROM customer GROUP BY 1), {_merge_sql("counts", "sum(n) // 20")}
    SELECT bin, merged, n FROM merged JOIN counts USING (bin)"""
)
def bin_merge(spark, sf_dir):
    """Sizes of nations, small ones merged into a neighbour."""
    data = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("bin"))
    counts = {r["bin"]: r["count"] for r in data.groupBy("bin").count().collect()}
    merged = binning.merge_small_bins(counts, sum(counts.values()) // 20)
    return spark.createDataFrame([(int(b), int(to), counts[b]) for b, to in sorted(merged.items())], "bin int, merged int, n long")


@query(f"WITH {_QCUT}, {_hier_sql('binned', 'o_orderkey', 'bin', 5, 1)} SELECT 'chunk_' || fold AS partition, o_orderkey FROM folds")
def regression_stratified(spark, sf_dir):
    return RegressionStratified(["o_orderkey"], "o_totalprice", 5).assign(read(spark, sf_dir, "orders"))


@query(
    f"""WITH {_QCUT}, {_hier_sql('binned', 'o_orderkey', 'bin', 5, 1)}, per AS (SELECT 'chunk_' || fold AS partition, bin, count(*) AS n FROM folds GROUP BY ALL)
    SELECT partition, bin, n, round(n / CAST(sum(n) OVER (PARTITION BY partition) AS DOUBLE), 9) AS share FROM per"""
)
def bin_distribution(spark, sf_dir):
    folds = RegressionStratified(["o_orderkey"], "o_totalprice", 5).folds(read(spark, sf_dir, "orders"))
    found = diagnostics.bin_distribution(folds.withColumn("partition", F.concat(F.lit("chunk_"), F.col("fold").cast("string"))))
    return found.withColumn("share", F.round("share", 9))


@query(
    f"""WITH RECURSIVE s AS (SELECT min(p_retailprice) AS low, max(p_retailprice) AS high,
    greatest(1, ceil((max(p_retailprice) - min(p_retailprice)) / (3.5 * stddev_samp(p_retailprice) / cbrt(count(*))))) AS bins FROM part),
    edges AS (SELECT low + (high - low) * i / bins AS e FROM s, range(1, CAST(bins AS BIGINT)) t(i)),
    raw AS (SELECT p_partkey, CAST((SELECT count(*) FROM edges WHERE e <= p_retailprice) AS INTEGER) AS bin FROM part),
    counts AS (SELECT bin, count(*) AS n FROM raw GROUP BY 1), {_merge_sql("counts", "5")},
    binned AS (SELECT p_partkey, merged AS bin FROM raw JOIN merged USING (bin)), {_hier_sql("binned", "p_partkey", "bin", 5, 1)}
    SELECT 'chunk_' || fold AS partition, p_partkey FROM folds"""
)
def regression_binning(spark, sf_dir):
    return RegressionBinning(["p_partkey"], "p_retailprice", 5, bin_rule="scott").assign(read(spark, sf_dir, "part"))


# Difficulty and uncertainty -----------------------------------------------------------------

#: A made-up distribution: the sizes of all coordinates of a vector, over their sum.
_PARTS = "list_transform(embedding, lambda e: abs(e::DOUBLE) + 0.01)"
_ENTROPY = (
    f"WITH a AS (SELECT vec_id, {_PARTS} AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda v: v / list_sum(a)) AS p FROM a), "
    "s AS (SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-8))) / ln(len(p)), 8) AS score FROM p)"
)


def _probabilities(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("_a", F.transform("embedding", lambda e: F.abs(e.cast("double")) + 0.01))
    total = F.aggregate("_a", F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", "label", F.transform("_a", lambda v: v / total).alias("probability"))


@query(f"{_ENTROPY} SELECT vec_id, round(score, 6) AS score FROM s")
def uncertainty_entropy(spark, sf_dir):
    return _probabilities(spark, sf_dir).select("vec_id", F.round(F.round(entropy(F.col("probability")), 8), 6).alias("score"))


@query(f"{_ENTROPY} SELECT 'uncertainty_level_' || (ntile(3) OVER (ORDER BY score, vec_id) - 1) AS partition, vec_id FROM s")
def uncertainty_rank(spark, sf_dir):
    scored = _probabilities(spark, sf_dir).select("vec_id", F.round(entropy(F.col("probability")), 8).alias("score"))
    return split_by_score(scored, ["vec_id"], "score", 3, None, "high_uncertainty", "low_uncertainty", "uncertainty_level")


def _price_error(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    error = F.abs(F.col("o_totalprice") - 150000.0)
    largest = orders.agg(F.max(error)).first()[0]
    return orders.select("o_orderkey", (error / (F.lit(largest) + 1e-8)).alias("score"))


_PRICE_ERROR = "WITH s AS (SELECT o_orderkey, abs(o_totalprice - 150000.0) / ((SELECT max(abs(o_totalprice - 150000.0)) FROM orders) + 1e-8) AS score FROM orders)"


@query(f"{_PRICE_ERROR} SELECT CASE WHEN score > 0.4 THEN 'hard' ELSE 'easy' END AS partition, o_orderkey FROM s")
def difficulty_threshold(spark, sf_dir):
    return split_by_score(_price_error(spark, sf_dir), ["o_orderkey"], "score", 2, 0.4, "hard", "easy", "chunk")


@query(f"{_PRICE_ERROR} SELECT 'chunk_' || (ntile(4) OVER (ORDER BY score, o_orderkey) - 1) AS partition, o_orderkey FROM s")
def difficulty_rank(spark, sf_dir):
    return split_by_score(_price_error(spark, sf_dir), ["o_orderkey"], "score", 4, None, "hard", "easy", "chunk")


def _wide(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])


def _labelled(spark, sf_dir):
    wide = _wide(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    return wide, [c for c in wide.columns if c.startswith("e")]


#: Out-of-fold probabilities of the nearest centroid over whole vectors.
_CENTROID = """counts AS (SELECT label::VARCHAR AS y, count(*) AS c FROM embeddings GROUP BY 1),
    offsets AS (SELECT y, sum(c) OVER (ORDER BY y) - c AS off, dense_rank() OVER (ORDER BY y) - 1 AS place FROM counts),
    dealt AS (SELECT vec_id, y, place, (off + row_number() OVER (PARTITION BY y ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold
              FROM (SELECT vec_id, label::VARCHAR AS y FROM embeddings) JOIN offsets USING (y)),
    points AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    sums AS MATERIALIZED (SELECT fold, place, i, sum(x) AS sx, count(*) AS n FROM points JOIN dealt USING (vec_id) GROUP BY ALL),
    centres AS MATERIALIZED (SELECT f.fold, place, i, sum(sx) / sum(n) AS m FROM sums s JOIN (SELECT DISTINCT fold FROM dealt) f ON s.fold <> f.fold GROUP BY ALL),
    far AS MATERIALIZED (SELECT d.vec_id, d.place AS own, c.place, sum((x - m) * (x - m)) AS d2 FROM dealt d JOIN points USING (vec_id) JOIN centres c USING (fold, i) GROUP BY ALL),
    near AS (SELECT vec_id, own, place, exp(min(d2) OVER (PARTITION BY vec_id) - d2) AS e FROM far),
    p AS (SELECT vec_id, own, place, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM near)"""


@query(f"WITH {_CENTROID} SELECT CASE WHEN 1 - p > 0.9 THEN 'hard' ELSE 'easy' END AS partition, vec_id FROM p WHERE place = own")
def difficulty_model(spark, sf_dir):
    data, columns = _labelled(spark, sf_dir)
    return DifficultySplit(["vec_id"], "label", columns, threshold=0.9, estimator=NearestCentroid()).assign(data)


@query(
    """WITH r AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, ntile(5) OVER (ORDER BY p_partkey) AS fold FROM part),
    m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r JOIN (SELECT DISTINCT fold FROM r) f ON r.fold <> f.fold GROUP BY f.fold),
    e AS (SELECT p_partkey, abs(y - (a * x + b)) AS e FROM r JOIN m USING (fold))
    SELECT 'chunk_' || (ntile(3) OVER (ORDER BY e / ((SELECT max(e) FROM e) + 1e-8), p_partkey) - 1) AS partition, p_partkey FROM e"""
)
def difficulty_linear(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression

    line = LinearRegression(solver="normal", regParam=0.0, standardization=False)
    return DifficultySplit(["p_partkey"], "p_retailprice", ["p_size"], 3, estimator=line).assign(read(spark, sf_dir, "part"))


@query()
def difficulty_regression(spark, sf_dir):
    return DifficultySplit(["p_partkey"], "p_retailprice", ["p_size", "p_partkey"], 3).assign(read(spark, sf_dir, "part"))


@query(
    f"""WITH {_CENTROID}, s AS (SELECT vec_id, -sum(p * ln(p + 1e-8)) / ln(count(*)) AS score FROM p GROUP BY vec_id)
    SELECT 'uncertainty_level_' || (ntile(3) OVER (ORDER BY score, vec_id) - 1) AS partition, vec_id FROM s"""
)
def uncertainty_model(spark, sf_dir):
    data, columns = _labelled(spark, sf_dir)
    return UncertaintySplit(["vec_id"], "label", columns, 3, estimator=NearestCentroid()).assign(data)


@query()
def difficulty_forest(spark, sf_dir):
    """The default model, a random forest, over whole vectors."""
    data, columns = _labelled(spark, sf_dir)
    return DifficultySplit(["vec_id"], "label", columns, 3).assign(data)


# Balance ------------------------------------------------------------------------------------


def _two_classes(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    point = F.transform("embedding", lambda e: e.cast("double"))
    return rows.select("vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"), point.alias("features"))


_TWO = """two AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, embedding::DOUBLE[] AS x FROM embeddings),
    class_counts AS (SELECT y, count(*) AS c FROM two GROUP BY y),
    class_offsets AS (SELECT y, sum(c) OVER (ORDER BY y) - c AS off FROM class_counts),
    base AS MATERIALIZED (SELECT 'partition_' || CAST((off + row_number() OVER (PARTITION BY y ORDER BY md5('42:' || vec_id), vec_id) - 1) % 2 AS INTEGER) AS partition,
                    vec_id, y, x, 'k:' || vec_id AS id FROM two JOIN class_offsets USING (y)),
    sizes AS (SELECT partition, y, count(*) AS n FROM base GROUP BY ALL),
    span AS (SELECT partition, y, n, min(n) OVER (PARTITION BY partition) AS least, max(n) OVER (PARTITION BY partition) AS most FROM sizes)"""


def _d2(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


#: ``wanted(partition, y, vec_id, copy)`` comes before; picks a neighbour of the class and a place between.
_MADE = f"""
    near_own AS MATERIALIZED (SELECT a.partition, a.y, a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.partition, a.y, a.vec_id ORDER BY {_d2("a.x", "b.x")}, b.vec_id) AS place
                 FROM base a JOIN base b ON a.partition = b.partition AND a.y = b.y AND a.vec_id <> b.vec_id),
    picks AS (SELECT w.*, CAST('0x' || substr(md5('42:' || copy || ':' || vec_id), 9, 8) AS BIGINT) % least({{k}}, n - 1) + 1 AS place,
                     CAST('0x' || substr(md5('42:' || copy || ':' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
              FROM wanted w JOIN span USING (partition, y)),
    made AS MATERIALIZED (SELECT p.partition, p.y, list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] + p.u * (b.x[i] - a.x[i])) AS x, 's' || row_number() OVER (ORDER BY p.partition, p.y, p.vec_id, copy) AS id
             FROM picks p JOIN near_own o ON p.partition = o.partition AND p.y = o.y AND p.vec_id = o.vec_id AND p.place = o.place
             JOIN base a ON a.vec_id = p.vec_id JOIN base b ON b.vec_id = o.other),
    filled AS MATERIALIZED (SELECT partition, vec_id, y, x, id, false AS synthetic FROM base UNION ALL SELECT partition, NULL, y, x, id, true FROM made)"""

_SMOTE = (
    """
    ordered AS (SELECT partition, y, vec_id, row_number() OVER (PARTITION BY partition, y ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rk FROM base),
    wanted AS (SELECT partition, y, vec_id, unnest(range(CAST((most - n) // n + CASE WHEN rk < (most - n) % n THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM ordered JOIN span USING (partition, y)),"""
    + _MADE.replace("{k}", "greatest(least - 1, 1)")
)


def _near_all(rows: str, k: int) -> str:
    return f"""near_all AS MATERIALIZED (SELECT * FROM (SELECT a.partition, a.id, a.y, b.id AS other, b.y AS other_y,
      row_number() OVER (PARTITION BY a.partition, a.id ORDER BY {_d2("a.x", "b.x")}, b.id) AS place
      FROM {rows} a JOIN {rows} b ON a.partition = b.partition AND a.id <> b.id) WHERE place <= {k})"""


_ADASYN = (
    f"""
    {_near_all("base", 5)},
    hard AS (SELECT partition, y, id, avg(CASE WHEN other_y <> y THEN 1.0 ELSE 0.0 END) AS r FROM near_all GROUP BY ALL),
    need AS (SELECT b.partition, b.y, b.vec_id, r, sum(r) OVER (PARTITION BY b.partition, b.y) AS total, most - n AS lack
             FROM hard JOIN base b USING (partition, y, id) JOIN span USING (partition, y) WHERE n < most),
    wanted AS (SELECT partition, y, vec_id, unnest(range(CAST(floor(r / total * lack + 0.5) AS BIGINT))) AS copy FROM need WHERE total > 0),"""
    + _MADE.replace("{k}", "5")
)
_OUT = "SELECT partition, coalesce(vec_id, -1) AS vec_id, y, round(x[1], 6) AS x1, round(list_sum(x), 6) AS total, synthetic FROM"
_MINORITY = "minority AS (SELECT partition, y FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY n, y) AS r FROM sizes) WHERE r = 1)"


def _balanced(spark, sf_dir, method):
    found = StratifiedBalanced(["vec_id"], "y", 2, balance_method=method).materialize(_two_classes(spark, sf_dir))
    # A synthetic row has no key; -1 stands for it here.
    return found.select("partition", F.coalesce("vec_id", F.lit(-1).cast("long")).alias("vec_id"), "y", F.round(F.get("features", F.lit(0)), 6).alias("x1"), F.round(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), "synthetic")


@query(
    f"""WITH {_TWO}, r AS (SELECT b.*, row_number() OVER (PARTITION BY partition, y ORDER BY md5('42:' || vec_id), vec_id) AS rn, least FROM base b JOIN span USING (partition, y))
    SELECT partition, vec_id, y, round(x[1], 6) AS x1, round(list_sum(x), 6) AS total, false AS synthetic FROM r WHERE rn <= least"""
)
def balance_rus(spark, sf_dir):
    return _balanced(spark, sf_dir, "rus")


@query(f"WITH {_TWO}, {_SMOTE} {_OUT} filled")
def balance_smote(spark, sf_dir):
    return _balanced(spark, sf_dir, "smote")


@query(f"WITH {_TWO}, {_ADASYN} {_OUT} filled")
def balance_adasyn(spark, sf_dir):
    return _balanced(spark, sf_dir, "adasyn")


@query(
    f"""WITH {_TWO}, {_MINORITY}, {_near_all("base", 3)}, lost AS (SELECT DISTINCT partition, id FROM near_all n ANTI JOIN minority m USING (partition, y) WHERE other_y <> n.y)
    {_OUT} (SELECT *, false AS synthetic FROM base ANTI JOIN lost USING (partition, id))"""
)
def balance_enn(spark, sf_dir):
    return _balanced(spark, sf_dir, "enn")


@query(
    f"""WITH {_TWO}, {_MINORITY}, {_near_all("base", 1)},
    links AS (SELECT a.partition, a.id, a.y FROM near_all a JOIN near_all b ON a.partition = b.partition AND a.id = b.other AND a.other = b.id WHERE a.y <> b.y),
    lost AS (SELECT partition, id FROM links ANTI JOIN minority USING (partition, y))
    {_OUT} (SELECT *, false AS synthetic FROM base ANTI JOIN lost USING (partition, id))"""
)
def balance_tomek(spark, sf_dir):
    return _balanced(spark, sf_dir, "tomek")


@query(
    f"""WITH {_TWO}, {_SMOTE}, {_near_all("filled", 3)}, lost AS (SELECT DISTINCT partition, id FROM near_all WHERE other_y <> y)
    {_OUT} (SELECT * FROM filled ANTI JOIN lost USING (partition, id))"""
)
def balance_smoteenn(spark, sf_dir):
    return _balanced(spark, sf_dir, "smoteenn")


@query(
    f"""WITH {_TWO}, {_SMOTE}, {_near_all("filled", 1)},
    lost AS (SELECT a.partition, a.id FROM near_all a JOIN near_all b ON a.partition = b.partition AND a.id = b.other AND a.other = b.id WHERE a.y <> b.y)
    {_OUT} (SELECT * FROM filled ANTI JOIN lost USING (partition, id))"""
)
def balance_smotetomek(spark, sf_dir):
    return _balanced(spark, sf_dir, "smotetomek")


@query(f"WITH {_TWO} {_OUT} (SELECT *, false AS synthetic FROM base)")
def balance_none(spark, sf_dir):
    return _balanced(spark, sf_dir, None)


# Features and clusters ----------------------------------------------------------------------


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def zscore(spark, sf_dir):
    scaled = features.zscore(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return scaled.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


_GAPS = "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS p FROM part"


@query(f"WITH g AS ({_GAPS}) SELECT p_partkey, round(coalesce(p, (SELECT avg(p) FROM g)), 6) AS p FROM g")
def mean_impute(spark, sf_dir):
    data = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("p"))
    return features.mean_impute(data, ["p"]).select("p_partkey", F.round("p", 6).alias("p"))


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label_index FROM orders")
def label_encode(spark, sf_dir):
    return features.label_encode(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query()
def feature_kmeans(spark, sf_dir):
    return FeatureClustering(["vec_id"], 5, feature_cols=["embedding"]).assign(read(spark, sf_dir, "embeddings"))


@query(
    """WITH RECURSIVE z AS MATERIALIZED (SELECT c_custkey AS k, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a,
                    (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS b FROM customer),
    near AS MATERIALIZED (SELECT u.k AS u, v.k AS v, (u.a - v.a) * (u.a - v.a) + (u.b - v.b) * (u.b - v.b) AS d2 FROM z u JOIN z v
             ON abs(u.a - v.a) <= 0.15 AND abs(u.b - v.b) <= 0.15 AND (u.a - v.a) * (u.a - v.a) + (u.b - v.b) * (u.b - v.b) <= 0.15 * 0.15),
    core AS MATERIALIZED (SELECT u AS k FROM near GROUP BY u HAVING count(*) >= 4),
    reach AS (SELECT k AS u, k AS v FROM core UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u WHERE n.v IN (SELECT k FROM core)),
    found AS (SELECT u AS k, min(v) AS root FROM reach GROUP BY u),
    owner AS (SELECT n.u AS k, arg_min(f.root, {'d': n.d2, 'v': n.v}) AS root FROM near n JOIN found f ON n.v = f.k GROUP BY n.u)
    SELECT 'chunk_' || (dense_rank() OVER (ORDER BY root) - 1) AS partition, k AS c_custkey FROM owner"""
)
def feature_dbscan(spark, sf_dir):
    data = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return FeatureClustering(["c_custkey"], method="dbscan", feature_cols=["c_acctbal", "c_nationkey"], eps=0.15, min_samples=4).assign(data)


@query()
def feature_tsne(spark, sf_dir):
    return TSNEClustering(["vec_id"], 5, feature_cols=["embedding"]).assign(read(spark, sf_dir, "embeddings"))


# Metrics, reports on predictions, votes -----------------------------------------------------

#: A made-up prediction: every seventh order is taken for the next priority in line.
_GUESS = "SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS guess FROM orders"


def _guessed(spark, sf_dir):
    guess = F.when(F.col("o_orderkey") % 7 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").withColumn("guess", guess)


@query(
    f"""WITH g AS ({_GUESS}), c AS (SELECT o_orderpriority AS c FROM g UNION SELECT guess FROM g),
    f AS (SELECT c, (SELECT count(*) FROM g WHERE o_orderpriority = c) AS s, (SELECT count(*) FROM g WHERE guess = c) AS p,
                 (SELECT count(*) FROM g WHERE guess = c AND o_orderpriority = c) AS h FROM c),
    v AS (SELECT *, CASE WHEN s + p > 0 THEN 2.0 * h / (s + p) ELSE 0 END AS f1 FROM f)
    SELECT round(CAST(sum(h) AS DOUBLE) / sum(s), 6) AS accuracy, round(CAST(avg(f1) AS DOUBLE), 6) AS f1_macro, round(CAST(sum(f1 * s) AS DOUBLE) / sum(s), 6) AS f1_weighted FROM v"""
)
def metrics_classification(spark, sf_dir):
    found = metrics.classification_metrics(_guessed(spark, sf_dir), "o_orderpriority", "guess")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    """WITH g AS (SELECT o_totalprice AS y, o_totalprice * 0.9 + o_orderkey % 100 AS p FROM orders)
    SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM g"""
)
def metrics_regression(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 100).alias("p"))
    found = metrics.regression_metrics(rows, "o_totalprice", "p")
    return found.select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"WITH a AS (SELECT label, {_PARTS} AS a FROM embeddings) SELECT round(-avg(ln(a[label + 1] / list_sum(a))), 6) AS log_loss FROM a")
def metrics_log_loss(spark, sf_dir):
    rows = _probabilities(spark, sf_dir).select(F.get("probability", F.col("label")).alias("p"))
    return metrics.log_loss(rows, "p").select(F.round("log_loss", 6).alias("log_loss"))


@query(f"WITH g AS ({_GUESS}), r AS (SELECT partition, o_orderkey FROM ({_RANDOM})) SELECT partition, o_orderpriority, guess, count(*) AS n FROM g JOIN r USING (o_orderkey) GROUP BY ALL")
def confusion_by_partition(spark, sf_dir):
    rows = RandomSplit(["o_orderkey"], 5).materialize(_guessed(spark, sf_dir))
    return diagnostics.confusion(rows, "o_orderpriority", "guess")


@query(
    f"""WITH g AS ({_GUESS}), r AS (SELECT partition, o_orderkey FROM ({_RANDOM})), e AS (SELECT partition, count(*) FILTER (guess <> o_orderpriority) AS errors, count(*) AS total
    FROM g JOIN r USING (o_orderkey) GROUP BY partition) SELECT partition, errors, total, round(100.0 * errors / total, 6) AS error_pct FROM e"""
)
def error_rates(spark, sf_dir):
    rows = RandomSplit(["o_orderkey"], 5).materialize(_guessed(spark, sf_dir))
    return diagnostics.error_rates(rows, "o_orderpriority", "guess").withColumn("error_pct", F.round("error_pct", 6))


@query(
    f"""WITH g AS ({_GUESS}), r AS (SELECT partition, o_orderkey FROM ({_RANDOM})) SELECT partition, round(avg(o_totalprice), 4) AS mean_score,
    round(avg(CASE WHEN guess <> o_orderpriority THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(*) AS n FROM g JOIN r USING (o_orderkey) GROUP BY partition"""
)
def score_report(spark, sf_dir):
    rows = RandomSplit(["o_orderkey"], 5).materialize(_guessed(spark, sf_dir))
    found = diagnostics.score_report(rows, "o_totalprice", "o_orderpriority", "guess")
    return found.select("partition", F.round("mean_score", 4).alias("mean_score"), F.round("error_rate", 6).alias("error_rate"), "n")


_VOTES = "SELECT o_orderkey, unnest([o_orderkey % 3, o_custkey % 3, (o_orderkey + o_custkey) % 3, o_orderkey % 2]) AS prediction FROM orders"


def _votes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(k % 3, c % 3, (k + c) % 3, k % 2)).alias("prediction"))


@query(
    f"""WITH v AS ({_VOTES}), n AS (SELECT o_orderkey, prediction, count(*) AS n FROM v GROUP BY ALL)
    SELECT o_orderkey, prediction FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC, prediction) AS r FROM n) WHERE r = 1"""
)
def ensemble_vote(spark, sf_dir):
    return ensemble.hard_vote(_votes(spark, sf_dir), ["o_orderkey"])


@query(f"WITH v AS ({_VOTES}) SELECT o_orderkey, round(avg(prediction), 6) AS prediction FROM v GROUP BY o_orderkey")
def ensemble_mean(spark, sf_dir):
    return ensemble.mean_vote(_votes(spark, sf_dir), ["o_orderkey"]).withColumn("prediction", F.round("prediction", 6))


@query(f"WITH v AS ({_VOTES}) SELECT o_orderkey, round(sum(prediction * (prediction + 1)) / CAST(sum(prediction + 1) AS DOUBLE), 6) AS prediction FROM v GROUP BY o_orderkey")
def ensemble_weighted_mean(spark, sf_dir):
    rows = _votes(spark, sf_dir).withColumn("weight", F.col("prediction") + 1)
    return ensemble.mean_vote(rows, ["o_orderkey"], weight="weight").withColumn("prediction", F.round("prediction", 6))


#: Three made-up models: the distribution itself, backwards, and sharpened.
_MODELS = " UNION ALL ".join(
    f"SELECT vec_id, {w}::DOUBLE AS w, {p} AS a FROM (SELECT vec_id, {_PARTS} AS a FROM embeddings)"
    for w, p in ((0.5, "a"), (0.8, "list_reverse(a)"), (0.3, "list_transform(a, lambda v: v * v)"))
)


@query(
    f"""WITH m AS ({_MODELS}), e AS (SELECT vec_id, w, generate_subscripts(a, 1) AS c, unnest(a) AS p FROM m),
    t AS (SELECT vec_id, c, sum(p * w) / sum(w) AS p FROM e GROUP BY ALL)
    SELECT vec_id, CAST(arg_max(c, {{'p': round(p, 9), 'c': -c}}) - 1 AS INTEGER) AS prediction, round(sum(p), 6) AS total FROM t GROUP BY vec_id"""
)
def ensemble_weighted(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("_a", F.transform("embedding", lambda e: F.abs(e.cast("double")) + 0.01))
    one = lambda w, p: F.struct(F.lit(w).alias("weight"), p.alias("probability"))
    votes = rows.select("vec_id", F.inline(F.array(one(0.5, F.col("_a")), one(0.8, F.reverse("_a")), one(0.3, F.transform("_a", lambda v: v * v)))))
    classes = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    found = ensemble.soft_vote(votes, ["vec_id"], classes, weight="weight")
    return found.select("vec_id", "prediction", F.round(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(
    f"""WITH r AS (SELECT partition, o_custkey::DOUBLE AS x, o_totalprice AS y FROM ({_RANDOM})),
    m AS (SELECT partition, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r GROUP BY partition)
    SELECT o_orderkey, round(avg(a * o_custkey + b), 2) AS prediction FROM orders, m GROUP BY o_orderkey"""
)
def ensemble_trained(spark, sf_dir):
    """A line fitted on every partition; their mean says the price of every order."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assemble = VectorAssembler(inputCols=["o_custkey"], outputCol="features")
    ready = assemble.transform(read(spark, sf_dir, "orders").withColumn("label", F.col("o_totalprice")))
    partitioned = RandomSplit(["o_orderkey"], 5).materialize(ready)
    fitted = ensemble.PartitionEnsemble(lambda: LinearRegression(solver="normal", regParam=0.0, standardization=False), "regression").fit(partitioned)
    return fitted.predict(ready, ["o_orderkey"]).select("o_orderkey", F.round("prediction", 2).alias("prediction"))
