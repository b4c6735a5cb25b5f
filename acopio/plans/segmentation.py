"""Segmentation of institutions: features, standardisation, K-Means, PCA, silhouette."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import pin

SAMPLE = 10_000     # rows from which fits start


def institution_rates(totals: DataFrame) -> DataFrame:
    """Rates inferred from their names: graduates/enrolled, admitted/applied, enrolled/admitted,
    staff/enrolled. A zero denominator gives null."""
    def rate(a, b):
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return (totals.withColumn("Tasa_Graduacion", rate("Total_Graduados", "Total_Matriculados"))
            .withColumn("Tasa_Admision", rate("Total_Admitidos", "Total_Inscritos"))
            .withColumn("Tasa_Absorcion", rate("Total_Matriculados", "Total_Admitidos"))
            .withColumn("Ratio_Docentes_Matriculados", rate("Total_Docentes", "Total_Matriculados")))


def feature_table(df: DataFrame, id_col: str, features: list[str] = K.FEATURES) -> DataFrame:
    return df.select(id_col, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant feature becomes 0.

    One aggregate gives all means and deviations; they come back as scalar subqueries.
    """
    stats = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = df.withColumn("_s", one)
    cols = {f: F.when(F.col(f"_s.s_{f}") == 0, 0.0).otherwise((F.col(f) - F.col(f"_s.m_{f}")) / F.col(f"_s.s_{f}"))
            for f in features}
    return out.withColumns(cols).drop("_s")


def with_vector(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


@dataclass
class Fit:
    """One K-Means fit: its centres, and once it has been rated its cost and the sizes of its clusters."""

    centres: np.ndarray
    seed: int = 0
    cost: float = np.inf
    sizes: np.ndarray | None = None


def starting_centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k points, each chosen with a chance that grows with its squared distance to those chosen before."""
    rng = np.random.default_rng([seed, k])
    chosen = [points[rng.integers(len(points))]]
    near = np.full(len(points), np.inf)
    while len(chosen) < k:
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(axis=1))
        total = near.sum()
        chosen.append(points[rng.choice(len(points), p=near / total) if total > 0 else rng.integers(len(points))])
    return np.array(chosen)


def _round(scaled: DataFrame, features: list[str], fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(sizes, sums, cost) of each fit's clusters, all fits in one pass. Tasks add up before anything is moved."""
    centres = [f.centres for f in fits]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(c), dtype=np.int64) for c in centres]
        sums, costs = [np.zeros_like(c) for c in centres], np.zeros(len(centres))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            norms = (x * x).sum(axis=1)
            for i, c in enumerate(centres):
                far = norms[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
                own = far.argmin(axis=1)
                costs[i] += np.maximum(far[np.arange(len(x)), own], 0).sum()
                n[i] += np.bincount(own, minlength=len(c))
                np.add.at(sums[i], own, x)
        at = [(i, j) for i, c in enumerate(centres) for j in range(len(c))]
        columns = [[i for i, _ in at], [j for _, j in at], np.concatenate(n), [costs[i] if j == 0 else 0.0 for i, j in at], *np.concatenate(sums).T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["fit", "cluster", "n", "cost", *[f"s{i}" for i in range(len(features))]]
    schema = "fit bigint, cluster bigint, n bigint, cost double, " + ", ".join(f"{s} double" for s in names[4:])
    parts = scaled.select(*features).mapInArrow(add, schema).groupBy("fit", "cluster").agg(*[F.sum(c).alias(c) for c in names[2:]])
    out = [(np.zeros(len(c), dtype=np.int64), np.zeros_like(c), 0.0) for c in centres]
    for r in parts.collect():       # a row per fit and cluster
        n, sums, cost = out[r["fit"]]
        n[r["cluster"]], sums[r["cluster"]] = r["n"], [r[c] for c in names[4:]]
        out[r["fit"]] = n, sums, cost + r["cost"]
    return out


def advance(scaled: DataFrame, features: list[str], fits: list[Fit], rounds: int = 300, tol: float = 1e-4) -> None:
    """Lloyd's iteration of all fits together: a pass over the data moves every centre of every fit that still moves.
    A last pass rates them."""
    moving = list(fits)
    for _ in range(rounds):
        still = []
        for fit, (n, sums, _) in zip(moving, _round(scaled, features, moving)):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], fit.centres)
            if ((new - fit.centres) ** 2).sum(axis=1).max() > tol * tol:
                still.append(fit)
            fit.centres = new
        moving = still
        if not moving:
            break
    for fit, (n, _, cost) in zip(fits, _round(scaled, features, fits)):
        fit.sizes, fit.cost = n, cost


def _scaled(df: DataFrame, features: list[str], keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Standardised features, and a sample of at most ``SAMPLE`` rows from which fits start."""
    scaled = pin(standardize(df.select(*keep, *features), features))
    drawn = scaled.select(*features).orderBy(F.xxhash64(*features)).limit(SAMPLE).collect()
    return scaled, np.array([list(r) for r in drawn], dtype=float).reshape(-1, len(features))


def best_fits(scaled: DataFrame, features: list[str], sample: np.ndarray, ks, seed: int, inits: int) -> dict[int, Fit]:
    """Per k the cheapest of several seeded fits. The cost never rises with k: a k that is not cheaper than the one
    before starts once more from the centres of that one and the point furthest from them."""
    fits = {k: [Fit(starting_centres(sample, k, s), s) for s in range(seed, seed + inits)] for k in ks}
    advance(scaled, features, [f for some in fits.values() for f in some])
    best = {k: min(some, key=lambda f: (f.cost, f.seed)) for k, some in fits.items()}
    for k in sorted(best):
        if k - 1 in best and best[k].cost > best[k - 1].cost:
            before = best[k - 1].centres
            far = ((sample[:, None, :] - before) ** 2).sum(axis=2).min(axis=1)
            best[k] = Fit(np.vstack([before, sample[far.argmax()]]), seed)
            advance(scaled, features, [best[k]])
    return best


def labelled(scaled: DataFrame, features: list[str], fit: Fit) -> DataFrame:
    """Add ``Cluster``, the nearest centre; clusters are numbered by falling size, so that names are stable."""
    order = sorted(range(len(fit.centres)), key=lambda c: (-fit.sizes[c], c))
    far = [F.struct(sum(((F.col(f) - float(x)) ** 2 for f, x in zip(features, fit.centres[c])), F.lit(0.0)).alias("d"), F.lit(i).alias("c"))
           for i, c in enumerate(order)]
    return scaled.withColumn("Cluster", F.array_min(F.array(*far))["c"])


def kmeans_assign(df: DataFrame, id_col: str, features: list[str], k: int = K.K_FINAL,
                  seed: int = K.KMEANS_SEED, inits: int = K.KMEANS_INITS) -> DataFrame:
    """Input rows with a ``Cluster`` number, of the cheapest of several seeded fits."""
    scaled, sample = _scaled(df, features, [id_col])
    if not len(sample):
        return df.withColumn("Cluster", F.lit(0))
    best = best_fits(scaled, features, sample, [k], seed, inits)[k]
    return df.join(pin(labelled(scaled, features, best).select(id_col, "Cluster")), id_col)


def kmeans_sweep(df: DataFrame, features: list[str], ks=K.K_SWEEP, seed: int = K.KMEANS_SEED,
                 inits: int = K.KMEANS_INITS) -> DataFrame:
    """(k, inercia, silueta) for each k below the number of rows; the fits of all k advance together."""
    spark = df.sparkSession
    base = df.select(F.monotonically_increasing_id().alias("_id"), *features)
    scaled, sample = _scaled(base, features, ["_id"])
    n = scaled.count()
    best = best_fits(scaled, features, sample, [k for k in ks if k < n], seed, inits)
    rows = [(k, float(f.cost), silhouette(labelled(scaled, features, f), "_id", "Cluster", features)) for k, f in best.items()]
    return spark.createDataFrame(rows, "k int, inercia double, silueta double")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))


def cluster_outliers(assigned: DataFrame, min_size: int) -> DataFrame:
    """Members of clusters smaller than ``min_size``; there are k cluster rows."""
    small = cluster_sizes(assigned).where(F.col("n") < min_size).select("Cluster")
    return assigned.join(F.broadcast(small), "Cluster", "left_semi")


def kmeans_without_outliers(df: DataFrame, id_col: str, features: list[str], min_size: int,
                            k: int = K.K_FINAL, inits: int = K.KMEANS_INITS) -> DataFrame:
    """Drop the members of small clusters, then standardise and cluster what is left."""
    first = kmeans_assign(df, id_col, features, k, inits=inits)
    small = cluster_outliers(first, min_size).select(id_col)
    rest = pin(df.join(small, id_col, "left_anti"))
    return kmeans_assign(rest, id_col, features, k, inits=inits)


def cluster_profile(assigned: DataFrame, features: list[str], digits: int = 2) -> DataFrame:
    return assigned.groupBy("Cluster").agg(*[F.round(F.avg(f), digits).alias(f) for f in features])


def pca(df: DataFrame, id_col: str, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Components of standardised features; each one's largest loading is made positive."""
    scaled = with_vector(standardize(df.select(id_col, *features), features), features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(scaled)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    arr = vector_to_array("pc")
    out = model.transform(scaled).select(id_col, *[(arr[i] * signs[i]).alias(f"PCA{i + 1}") for i in range(k)])
    return out, [float(x) for x in model.explainedVariance]


def silhouette_samples(df: DataFrame, id_col: str, cluster: str, features: list[str]) -> DataFrame:
    """Silhouette value per row under squared distances, in one aggregation and one pass.

    A row's mean squared distance to a cluster follows from the cluster's size, sums and sum of squared
    norms, so no two rows meet. One row per cluster comes back as a scalar. A row alone in its cluster has 0.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    norm = sum((F.col(f).cast("double") ** 2 for f in features), F.lit(0.0))
    base = df.select(id_col, F.col(cluster).cast("int").alias(cluster), x.alias("_x"), norm.alias("_q"))
    each = base.groupBy(F.col(cluster).alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_q").alias("q"),
        F.array(*[F.sum(F.get("_x", F.lit(i))) for i in range(len(features))]).alias("s"))
    stats = each.agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("k")).scalar()

    def total(k):
        """Sum of a row's squared distances to the members of a cluster."""
        dot = F.aggregate(F.zip_with("_x", k["s"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(k["n"] * F.col("_q") - 2 * dot + k["q"], F.lit(0.0))

    far = F.transform("_k", lambda k: F.struct((k["c"] == F.col(cluster)).alias("own"), k["n"].alias("n"), total(k).alias("d")))
    own = F.get(F.filter("_f", lambda f: f["own"]), F.lit(0))
    base = base.withColumn("_k", stats).withColumn("_f", far).select(
        id_col, cluster, F.try_divide(own["d"], own["n"] - 1).alias("a"),
        F.array_min(F.transform(F.filter("_f", lambda f: ~f["own"]), lambda f: f["d"] / f["n"])).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return base.select(id_col, cluster, value.alias("silueta"))


def silhouette(df: DataFrame, id_col: str, cluster: str, features: list[str]) -> float:
    """Mean of the rows' values, in the same linear form at every size."""
    return silhouette_samples(df, id_col, cluster, features).agg(F.avg("silueta").alias("s")).first()["s"]


def assignment_checks(df: DataFrame, assigned: DataFrame, id_col: str, features: list[str], k: int) -> DataFrame:
    """One row of what holds for any K-Means labelling: rows, rows without label, clusters in use (at most k),
    sum of the sizes, sizes out of order, and rows closer to another cluster's mean than to their own's."""
    scaled = standardize(df.select(id_col, *features), features).join(assigned.select(id_col, "Cluster"), id_col, "left")
    means = scaled.where("Cluster IS NOT NULL").groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f) for f in features]).alias("m"))
    stats = pin(means)     # one row per cluster
    centres = stats.agg(F.collect_list(F.struct("Cluster", "m")).alias("k")).scalar()
    x = F.array(*[F.col(f) for f in features])

    def far(c):
        return F.aggregate(F.zip_with(x, c["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    near = F.array_min(F.transform("_k", far))
    own = F.array_min(F.transform(F.filter("_k", lambda c: c["Cluster"] == F.col("Cluster")), far))
    rows = scaled.withColumn("_k", centres).agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("Cluster").isNull()).alias("sin_cluster"),
        F.count_if(own > near + 1e-3 * (1 + near)).alias("fuera_de_centro"))
    by_size = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("Cluster", "n"))).alias("z")).select(
        F.size("z").alias("u"), F.aggregate("z", F.lit(0).cast("bigint"), lambda a, v: a + v["n"]).alias("t"),
        F.size(F.filter("z", lambda v, i: (i > 0) & (v["n"] > F.get("z", i - 1)["n"]))).alias("o"))
    one = F.struct(*by_size.columns)
    return rows.withColumn("_s", by_size.select(one.alias("s")).scalar()).select(
        "filas", "sin_cluster", (F.col("_s.u") <= k).alias("clusters_ok"), F.col("_s.t").alias("suma_tamanos"),
        F.col("_s.o").cast("bigint").alias("desordenados"), "fuera_de_centro")
