"""Parts by clusters of features: k-means, density clusters, and k-means on a t-SNE map."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.operators.base import Strategy, names
from shardwright.operators.features import NUMERIC, mean_impute, numeric_columns, zscore
from shardwright.operators.graph import checkpointed, components
from shardwright.operators.knn import smallest, squared_distances
from shardwright.workers import ship_code

#: With more features than this, their first principal components are clustered.
MOST_FEATURES = 50


class FeatureClustering(Strategy):
    """Numeric columns are imputed by the mean, scaled and clustered: ``chunk_<cluster>``.

    An array of numbers counts as so many columns as its longest row has places; without
    ``feature_cols`` all numeric columns and arrays are taken.

    ``method`` ``kmeans`` takes ``k`` (by default ``n_partitions``) and MLlib's options; ``dbscan``
    takes ``eps`` and ``min_samples`` and leaves noise out. Clusters of ``dbscan`` are numbered by
    their least key.
    """

    prefix = "chunk"

    def __init__(self, key_cols: list[str], n_partitions: int = 5, random_state: int = 42, method: str = "kmeans", feature_cols: list[str] | None = None, feature_engineering: str = "auto", **cluster_kwargs) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        if method not in ("kmeans", "dbscan"):
            raise ValueError(f"{method!r} does not cluster; known: kmeans, dbscan")
        if method == "dbscan" and len(key_cols) != 1:
            raise ValueError("dbscan needs a single key column")
        self.method, self.feature_cols, self.cluster_kwargs, self.feature_engineering = method, feature_cols, cluster_kwargs, feature_engineering

    def scaled(self, data: DataFrame) -> tuple[DataFrame, list[str]]:
        """Keys and scaled features; beyond ``MOST_FEATURES`` columns their principal components."""
        kinds = dict(data.dtypes)
        arrays = [c for c, kind in data.dtypes if kind.startswith("array<") and kind[6:-1] in (*NUMERIC, "decimal") and c not in self.key_cols]
        chosen = self.feature_cols or [*numeric_columns(data, self.key_cols), *arrays]
        if not chosen:
            raise ValueError("there is no numeric column to cluster by")
        wide = [c for c in chosen if kinds[c].startswith("array")]
        sizes = data.agg(*[F.max(F.size(c)).alias(c) for c in wide]).first().asDict() if wide else {}
        expanded = []
        for c in chosen:
            if c in wide:
                expanded += [F.get(c, F.lit(i)).cast("double").alias(f"{c}_{i}") for i in range(max(sizes[c] or 0, 0))]
            else:
                expanded.append(F.col(c))
        data = data.select(*self.key_cols, *expanded)
        columns = data.columns[len(self.key_cols) :]
        rows = zscore(mean_impute(data, columns), columns)
        if len(columns) <= MOST_FEATURES:
            return rows, columns
        from pyspark.ml.feature import PCA, VectorAssembler
        from pyspark.ml.functions import vector_to_array

        vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(rows)
        reduced = PCA(k=MOST_FEATURES, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors).withColumn("_a", vector_to_array("_p"))
        parts = [f"pc_{i}" for i in range(MOST_FEATURES)]
        return reduced.select(*self.key_cols, *[F.get("_a", F.lit(i)).alias(p) for i, p in enumerate(parts)]), parts

    def clusters(self, data: DataFrame) -> DataFrame:
        """Keys and ``cluster``; null for noise."""
        rows, columns = self.scaled(data)
        if self.method == "dbscan":
            return dbscan(rows, self.key_cols[0], columns, **self.cluster_kwargs)
        return kmeans(rows, self.key_cols, columns, self.n_partitions, self.random_state, **self.cluster_kwargs)

    def assign(self, data: DataFrame) -> DataFrame:
        found = self.clusters(data).where("cluster IS NOT NULL")
        return found.select(names(F.col("cluster"), self.prefix).alias("partition"), *self.key_cols)


def kmeans(rows: DataFrame, keys: list[str], columns: list[str], k: int, seed: int, n_clusters: int | None = None, **options) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = checkpointed(VectorAssembler(inputCols=columns, outputCol="_v").transform(rows).select(*keys, "_v"))
    model = KMeans(k=n_clusters or k, seed=seed, featuresCol="_v", predictionCol="cluster", **options).fit(vectors)
    return model.transform(vectors).select(*keys, "cluster")


#: Squared distances that a task of ``dbscan`` holds at once.
AT_ONCE = 1_000_000


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each side that the box around the other side, ``eps`` wider, holds."""
    wide = eps * (1 + 1e-9)
    return tuple(np.flatnonzero(((x >= y.min(0) - wide) & (x <= y.max(0) + wide)).all(1)) for x, y in ((a, b), (b, a)))


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any row of ``a`` lies within ``eps`` of one of ``b``."""
    near_a, near_b = _within(a, b, eps)
    a, b = a[near_a], b[near_b]
    step = 256
    for s in range(0, len(a), step):
        for t in range(0, len(b), 4 * step):
            if (squared_distances(a[s : s + step], b[t : t + 4 * step]) <= eps * eps).any():
                return True
    return False


def _spans(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts rows of a box together, the boxes, and where each starts (and the last ends)."""
    found, which = np.unique(boxes, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    return order, found, np.searchsorted(which[order], np.arange(len(found) + 1))


def _pairs_of_boxes(found: np.ndarray, starts: np.ndarray, reach: int):
    """Every box with the boxes whose places differ by at most ``reach`` in each dimension (itself included)."""
    for i, box in enumerate(found):
        low, high = np.searchsorted(found[:, 0], [box[0] - reach, box[0] + reach + 1])
        yield i, low + np.flatnonzero((np.abs(found[low:high] - box) <= reach).all(1))


def dbscan(rows: DataFrame, key: str, columns: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Density clusters (Ester et al. 1996): ``key, cluster``, null for noise.

    Core rows within ``eps`` of each other are one cluster; a border row joins its nearest core
    row. Equal points are one point that counts so many times. Points are put into boxes whose
    diagonal is ``eps``: a box of ``min_samples`` rows is core as a whole and one node of the
    graph, in other boxes (Gunawan 2013) a core point is a node. Pairs are never written out.

    The first features (at most three) are cut into cells, and a task has a cell with the rows
    around it: so cells have to be ``eps`` wide at least, and pairs within ``eps`` lie in the same
    or touching cells. Distances are over all features.
    """
    ship_code(rows.sparkSession)
    points = rows.select(F.array(*columns).alias("_x"), F.col(key).alias("_k")).groupBy("_x").agg(F.min("_k").alias("_k"), F.count("*").alias("_n"))
    side = eps / np.sqrt(len(columns)) * (1 - 1e-9)
    grid = range(min(3, len(columns)))
    points = checkpointed(points)
    kind = dict(points.dtypes)["_k"]
    cells = [f"_c{i}" for i in grid]

    def around(table: DataFrame) -> DataFrame:
        """Every point for its own cell (``_own``) and the touching ones."""
        moves = F.array(*[F.array(*[F.lit(m) for m in move]) for move in product((-1, 0, 1), repeat=len(grid))])
        out = table.select("*", F.explode(moves).alias("_m"))
        # A cell a little wider than eps keeps pairs at just that distance in touching cells, however floor rounds.
        place = [(F.floor(F.get("_x", F.lit(i)) / (eps * (1 + 1e-9))) + F.get("_m", F.lit(i))).cast("long").alias(c) for i, c in zip(grid, cells, strict=True)]
        return out.select(*table.columns, F.forall("_m", lambda m: m == 0).alias("_own"), *place)

    def opened(part: pd.DataFrame):
        part = part.sort_values("_k")
        x = np.stack(part["_x"].to_numpy()).astype(float)
        boxes = np.floor(x / side).astype(np.int64)
        order, found, starts = _spans(boxes)
        part, x = part.iloc[order], x[order]
        return part, x, found, starts, part["_own"].to_numpy(bool)

    reach = int(np.ceil(eps / side))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        """Own points with ``_core`` and ``_node``: the least key of a full box, or their own."""
        part, x, found, starts, own = opened(part)
        n, keys = part["_n"].to_numpy(), part["_k"].to_numpy()
        core, node = np.zeros(len(part), bool), keys.copy()
        for i, near in _pairs_of_boxes(found, starts, reach):
            here = slice(starts[i], starts[i + 1])
            if not own[here].any():
                continue
            if n[here].sum() >= min_samples:
                core[here], node[here] = True, keys[here].min()
                continue
            there = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in near])
            total = np.zeros(starts[i + 1] - starts[i])
            for s in range(0, len(there), AT_ONCE // min_samples + 1):
                at = there[s : s + AT_ONCE // min_samples + 1]
                total += ((squared_distances(x[here], x[at]) <= eps * eps) * n[at]).sum(1)
                if (total >= min_samples).all():
                    break
            core[here] = total >= min_samples
        return pd.DataFrame({"_x": part["_x"], "_k": keys, "_n": n, "_core": core, "_node": node})[own]

    counted = around(points).groupBy(*cells).applyInPandas(count, f"_x array<double>, _k {kind}, _n long, _core boolean, _node {kind}")
    counted = checkpointed(counted)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        """Links between nodes of core points; for other own points the nearest core point, if within ``eps``."""
        part, x, found, starts, own = opened(part)
        core, node, keys = part["_core"].to_numpy(bool), part["_node"].to_numpy(), part["_k"].to_numpy()
        u, v, kinds = [], [], []
        parent = {k: k for k in node[core]}

        def root(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for i, near in _pairs_of_boxes(found, starts, reach):
            here = np.arange(starts[i], starts[i + 1])
            if not own[here].any():
                continue
            # Every pair has a row in its own cell, whose task sees the other one; other boxes may be seen in part.
            there = [np.arange(starts[j], starts[j + 1]) for j in near]
            there = [t[core[t]] for t in there if core[t].any()]
            for a in _by_node(here[core[here]], node):
                for t in there:
                    for b in _by_node(t, node):
                        p, q = root(node[a[0]]), root(node[b[0]])
                        if p != q and _touch(x[a], x[b], eps):
                            parent[max(p, q)] = min(p, q)
                            u.append(node[a[0]]), v.append(node[b[0]]), kinds.append(0)
            rest = here[~core[here]]
            rest = rest[own[rest]]
            if len(rest) and there:
                there = np.concatenate(there)
                best = [(np.inf, None)] * len(rest)
                for s in range(0, len(there), AT_ONCE // min_samples + 1):
                    at = there[s : s + AT_ONCE // min_samples + 1]
                    at = at[np.argsort(keys[at], kind="stable")]
                    d2 = squared_distances(x[rest], x[at])
                    for r, c in enumerate(d2.argmin(1)):
                        if d2[r, c] <= eps * eps and (best[r][1] is None or (d2[r, c], keys[at[c]]) < (best[r][0], keys[best[r][1]])):
                            best[r] = (d2[r, c], at[c])
                for r, (_, c) in zip(rest, best, strict=True):
                    if c is not None:
                        u.append(keys[r]), v.append(node[c]), kinds.append(1)
        return pd.DataFrame({"u": pd.Series(u, dtype=keys.dtype), "v": pd.Series(v, dtype=keys.dtype), "kind": pd.Series(kinds, dtype="int32")})

    linked = checkpointed(around(counted).groupBy(*cells).applyInPandas(link, f"u {kind}, v {kind}, kind int"))
    nodes = counted.where("_core").select(F.col("_node").alias("node")).distinct()
    found = components(nodes, linked.where("kind = 0").select("u", "v"))
    owner = counted.where("_core").select("_x", "_node").unionByName(
        counted.where("NOT _core").join(linked.where("kind = 1").select(F.col("u").alias("_k"), F.col("v").alias("_of")), "_k").select("_x", F.col("_of").alias("_node"))
    )
    # The least core key of a cluster; nodes are named by a key of theirs, which is the least of a full box.
    placed = owner.join(found.select(F.col("node").alias("_node"), F.col("component").alias("_root")), "_node").select("_x", "_root")
    roots = found.select(F.col("component").alias("_root")).distinct()
    numbered = roots.withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_root")) - 1)
    placed = placed.join(numbered, "_root").select(F.col("_x").alias("_at"), "cluster")
    base = rows.select(F.col(key), F.array(*columns).alias("_x"))
    return base.join(placed, F.col("_x") == F.col("_at"), "left").select(key, "cluster")


def _by_node(places: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Places of one box by node: one piece for a full box, else one for each point."""
    if not len(places):
        return []
    if (node[places] == node[places[0]]).all():
        return [places]
    return [places[i : i + 1] for i in range(len(places))]


def tsne(x: np.ndarray, components_: int = 2, perplexity: float = 30.0, seed: int = 42, rounds: int = 300) -> np.ndarray:
    """A map of the rows in few dimensions (van der Maaten and Hinton 2008), exact gradients."""
    n = len(x)
    if n < 2:
        return np.zeros((n, components_))
    perplexity = min(perplexity, max(1.0, (n - 1) / 3))
    d2 = np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(50):  # all precisions at once, by halving
        p = np.exp(-d2 * beta[:, None])
        np.fill_diagonal(p, 0)
        s = np.maximum(p.sum(1), 1e-12)
        h = np.log(s) + beta * (d2 * p).sum(1) / s
        wide = h > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = p / s[:, None]
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, step, gains = rng.normal(0, 1e-4, (n, components_)), np.zeros((n, components_)), np.ones((n, components_))
    for t in range(rounds):
        q = 1 / (1 + np.maximum(0, (y * y).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * y @ y.T))
        np.fill_diagonal(q, 0)
        force = ((12.0 if t < 100 else 1.0) * p - q / q.sum()) * q
        gradient = 4 * (force.sum(1)[:, None] * y - force @ y)
        gains = np.maximum(0.01, np.where(np.sign(gradient) == np.sign(step), gains * 0.8, gains + 0.2))
        step = (0.5 if t < 100 else 0.8) * step - max(n / 48, 50) * gains * gradient
        y = y + step - (y + step).mean(0)
    return y


def affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares of a row's nearest rows (a row each) whose entropy is that of ``perplexity`` equal ones."""
    d2 = d2 - d2[:, :1]
    low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
    for _ in range(50):
        p = np.exp(-d2 * beta[:, None])
        s = p.sum(1)
        wide = np.log(s) + beta * (d2 * p).sum(1) / s > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p / s[:, None]


def _attraction(y: np.ndarray, near: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sums of p q (y_i - y_j), where p is the mean of the shares of both ways over all rows."""
    n, out = len(y), np.zeros_like(y)
    for s in range(0, n, 10_000):
        at = near[s : s + 10_000]
        apart = [y[s : s + 10_000, c][:, None] - y[:, c][at] for c in range(y.shape[1])]
        w = share[s : s + 10_000] / (2 * n) / (1 + sum(d * d for d in apart))
        for c, d in enumerate(apart):
            pull = w * d
            out[s : s + 10_000, c] += pull.sum(1)
            out[:, c] -= np.bincount(at.ravel(), pull.ravel(), n)
    return out


def _repulsion(y: np.ndarray, step: float = 1 / 3) -> np.ndarray:
    """Sums of q^2 (y_i - y_j) over the sum of all q.

    In two dimensions by cubic interpolation on a grid, whose nodes are summed up by Fourier
    transforms (Linderman et al. 2019); otherwise pair by pair.
    """
    n = len(y)
    if y.shape[1] != 2:
        out, total = np.zeros_like(y), 0.0
        rows = max(1, 4_000_000 // n)
        for s in range(0, n, rows):
            q = 1 / (1 + squared_distances(y[s : s + rows], y))
            total += q.sum()
            q *= q
            out[s : s + rows] = q.sum(1)[:, None] * y[s : s + rows] - q @ y
        return out / max(total - n, 1e-12)
    low = y.min(0)
    step = min(step, max(float((y.max(0) - low).max()), 1e-9) / 50)
    size = int(((y.max(0) - low) / step).max()) + 4
    wide = 1 << (2 * size - 1).bit_length()
    wide = 3 * wide // 4 if 3 * wide // 4 >= 2 * size else wide
    place = (y - low) / step
    first = np.floor(place).astype(int)
    t = place - first + 1  # the four nodes around lie at 0, 1, 2, 3
    weights = np.stack([(t - 1) * (t - 2) * (t - 3) / -6, t * (t - 2) * (t - 3) / 2, t * (t - 1) * (t - 3) / -2, t * (t - 1) * (t - 2) / 6], -1)
    nodes = ((first[:, 0, None, None] + np.arange(4)[:, None]) * wide + first[:, 1, None, None] + np.arange(4)).reshape(n, 16)
    weights = (weights[:, 0, :, None] * weights[:, 1, None, :]).reshape(n, 16)
    lag = np.minimum(np.arange(wide), wide - np.arange(wide)) * step
    kernel = 1 / (1 + lag[:, None] ** 2 + lag[None, :] ** 2)
    once, twice = np.fft.rfft2(kernel), np.fft.rfft2(kernel * kernel)

    def spread(charge: np.ndarray) -> np.ndarray:
        return np.fft.rfft2(np.bincount(nodes.ravel(), (weights * charge[:, None]).ravel(), wide * wide).reshape(wide, wide))

    def gathered(spectrum: np.ndarray) -> np.ndarray:
        return (np.fft.irfft2(spectrum, (wide, wide)).ravel()[nodes] * weights).sum(1)

    z = y - y.mean(0)
    ones = spread(np.ones(n))
    at = np.stack(np.divmod(np.arange(16), 4), -1) * step
    itself = 1 / (1 + squared_distances(at, at))  # what a row counts for itself on the grid
    total = max(gathered(ones * once).sum() - ((weights @ itself) * weights).sum(), 1e-12)
    all_ = gathered(ones * twice)
    return np.stack([all_ * z[:, c] - gathered(spread(z[:, c]) * twice) for c in range(2)], 1) / total


def tsne_of_neighbours(near: np.ndarray, share: np.ndarray, components_: int = 2, seed: int = 42, rounds: int = 300) -> np.ndarray:
    """``tsne`` whose attraction is that of the nearest rows (places ``near``) with their ``share``; all rows repel."""
    n = len(near)
    rng = np.random.default_rng(seed)
    y, step, gains = rng.normal(0, 1e-4, (n, components_)), np.zeros((n, components_)), np.ones((n, components_))
    for t in range(rounds):
        gradient = 4 * ((12.0 if t < 100 else 1.0) * _attraction(y, near, share) - _repulsion(y))
        gains = np.maximum(0.01, np.where(np.sign(gradient) == np.sign(step), gains * 0.8, gains + 0.2))
        step = (0.5 if t < 100 else 0.8) * step - max(n / 48, 50) * gains * gradient
        y = y + step - (y + step).mean(0)
    return y


class TSNEClustering(FeatureClustering):
    """k-means on a t-SNE map of the scaled features: ``tsne_cluster_<cluster>``.

    Up to ``EXACT_ROWS`` rows all pairs count. Above that the nearest three times ``perplexity``
    rows attract (found exactly, by many tasks that each hold the features) and all rows repel; one
    task holds the map and the nearest rows. A table above ``max_rows``, if given, is refused.
    """

    EXACT_ROWS = 5000

    prefix = "tsne_cluster"

    def __init__(self, key_cols: list[str], n_partitions: int = 5, random_state: int = 42, n_components: int = 2, perplexity: float = 30.0, feature_cols: list[str] | None = None, max_rows: int | None = None, **cluster_kwargs) -> None:
        super().__init__(key_cols, n_partitions, random_state, "kmeans", feature_cols, **cluster_kwargs)
        self.n_components, self.perplexity, self.max_rows = n_components, perplexity, max_rows

    def clusters(self, data: DataFrame) -> DataFrame:
        ship_code(data.sparkSession)
        rows, columns = self.scaled(data)
        n = rows.count()
        if self.max_rows is not None and n > self.max_rows:
            raise ValueError(f"t-SNE is to take at most {self.max_rows} rows; use feature_clustering for larger tables")
        parts = [f"t_{i}" for i in range(self.n_components)]
        kinds = dict(rows.dtypes)
        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in self.key_cols], *[f"{p} double" for p in parts]])
        keys, perplexity, seed = self.key_cols, self.perplexity, self.random_state

        def embed(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(keys)
            y = tsne(part[columns].to_numpy(float), len(parts), perplexity, seed)
            return pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(y, columns=parts)], axis=1)

        if n > self.EXACT_ROWS:
            mapped = self._large(rows, columns, schema)
        else:
            mapped = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(embed, schema)
        return kmeans(mapped, self.key_cols, parts, self.n_partitions, self.random_state, **self.cluster_kwargs)

    def _large(self, rows: DataFrame, columns: list[str], schema: str) -> DataFrame:
        spark, keys, parts, perplexity, seed = rows.sparkSession, self.key_cols, self.n_components, self.perplexity, self.random_state
        kinds = dict(rows.dtypes)
        table = rows.select(*keys, F.array(*columns).alias("_x")).toArrow().sort_by([(k, "ascending") for k in keys])
        n = table.num_rows
        points = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(columns))
        shared = spark.sparkContext.broadcast((table.select(keys), points))
        tasks = max(12, n // 4000)
        k = min(n - 1, int(3 * perplexity))

        def search(batches):
            names, x = shared.value
            for batch in batches:
                for i in batch["id"]:
                    at = np.arange(n * i // tasks, n * (i + 1) // tasks)
                    _, near, d2 = smallest(x[at], x, at, k)
                    share = affinities(d2.reshape(len(at), k), min(perplexity, max(1.0, k / 3)))
                    found = names.slice(at[0], len(at)).to_pandas() if len(at) else names.slice(0, 0).to_pandas()
                    yield found.assign(_row=at, _near=list(near.reshape(len(at), k).astype(np.int32)), _share=list(share))

        found = spark.range(0, tasks, 1, tasks).mapInPandas(search, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "_row long, _near array<int>, _share array<double>"]))

        def embed(piece: pa.Table) -> pa.Table:
            piece = piece.sort_by("_row")
            near, share = (piece.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, k) for c in ("_near", "_share"))
            names = piece.select(keys)
            del piece
            y = tsne_of_neighbours(near, share, parts, seed)
            for c in range(parts):
                names = names.append_column(f"t_{c}", pa.array(y[:, c]))
            return names

        return checkpointed(checkpointed(found).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(embed, schema))
