"""Queries for segmentation, over totals per supplier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import aggregates as A
from ..session import pin
from . import bindings as B
from . import segmentation as S
from .registry import query

_TOT = B.sql_of(B.TOTALS)
_RATES = {"Tasa_Graduacion": ("Total_Graduados", "Total_Matriculados"), "Tasa_Admision": ("Total_Admitidos", "Total_Inscritos"),
          "Tasa_Absorcion": ("Total_Matriculados", "Total_Admitidos"), "Ratio_Docentes_Matriculados": ("Total_Docentes", "Total_Matriculados")}
_WITH_RATES = "SELECT *, " + ", ".join(f"CASE WHEN {b} <> 0 THEN {a}::DOUBLE / {b}::DOUBLE END AS {r}" for r, (a, b) in _RATES.items()) + f" FROM ({_TOT}) t"
_FEATURES = f"SELECT id, {', '.join(f'coalesce({f}::DOUBLE, 0.0) AS {f}' for f in K.FEATURES)} FROM ({_WITH_RATES}) r"


def _totals(spark, sf_dir):
    return S.institution_rates(B.derive(spark, sf_dir, B.TOTALS))


def _features(spark, sf_dir):
    return S.feature_table(_totals(spark, sf_dir), "id")


@query("institution_rates", f"SELECT id, {', '.join(f'round({r}, 9) AS {r}' for r in _RATES)} FROM ({_WITH_RATES}) t")
def institution_rates(spark, sf_dir):
    return _totals(spark, sf_dir).select("id", *[F.round(r, 9).alias(r) for r in _RATES])


@query("feature_table", f"SELECT id, {', '.join(f'round({f}, 9) AS {f}' for f in K.FEATURES)} FROM ({_FEATURES}) t")
def feature_table(spark, sf_dir):
    return _features(spark, sf_dir).select("id", *[F.round(f, 9).alias(f) for f in K.FEATURES])


_Z = "SELECT id, " + ", ".join(f"CASE WHEN s_{f} = 0 THEN 0.0 ELSE ({f} - m_{f}) / s_{f} END AS {f}" for f in K.FEATURES) + f" FROM ({_FEATURES}) x, (SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in K.FEATURES) + f" FROM ({_FEATURES}) y) st"


@query("standardize", f"SELECT id, {', '.join(f'round({f}, 6) AS {f}' for f in K.FEATURES)} FROM ({_Z}) z")
def standardize(spark, sf_dir):
    df = S.standardize(_features(spark, sf_dir), K.FEATURES)
    return df.select("id", *[F.round(f, 6).alias(f) for f in K.FEATURES])


_LINES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("describe_features", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min, round(max({c}), 2) AS max, "
    f"round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50, round(quantile_cont({c}, 0.75), 2) AS p75 FROM lineitem" for c in _LINES))
def describe_features(spark, sf_dir):
    return A.describe(B.tables(spark, sf_dir, ["lineitem"])["lineitem"], _LINES)


_N = f"(SELECT count(*) FROM ({_TOT}) t)"

# Labels by nation stand in for clusters, so that the exact score has a statement to agree with.
_LABELLED = f"SELECT z.*, c.g FROM ({_Z}) z JOIN (SELECT s_suppkey, s_nationkey % 3 AS g FROM supplier) c ON c.s_suppkey = z.id"
_DIST = " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in K.FEATURES)
_SAMPLES = f"""WITH l AS MATERIALIZED ({_LABELLED}), n AS (SELECT g, count(*) AS n FROM l GROUP BY g),
  d AS (SELECT a.id, a.g, b.g AS k, sum({_DIST}) AS d FROM l a, l b GROUP BY 1, 2, 3),
  m AS (SELECT id, d.g, max(CASE WHEN k = d.g THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN k <> d.g THEN d / n END) AS b FROM d JOIN n ON n.g = k GROUP BY 1, 2)
  SELECT id, CAST(g AS INTEGER) AS g, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silueta FROM m"""


def _labelled(spark, sf_dir):
    sup = B.tables(spark, sf_dir, ["supplier"])["supplier"].select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("g"))
    return pin(S.standardize(_features(spark, sf_dir), K.FEATURES).join(sup, "id"))


@query("silhouette_exact", f"SELECT id, g, round(silueta, 6) AS silueta FROM ({_SAMPLES}) s")
def silhouette_exact(spark, sf_dir):
    """Squared distances; the statement sums them over all pairs, the operator never forms a pair."""
    return S.silhouette_samples(_labelled(spark, sf_dir), "id", "g", K.FEATURES).withColumn("silueta", F.round("silueta", 6))


@query("silhouette_approx", f"SELECT round(avg(silueta), 6) AS silueta FROM ({_SAMPLES}) s")
def silhouette_approx(spark, sf_dir):
    score = S.silhouette(_labelled(spark, sf_dir), "id", "g", K.FEATURES)
    return spark.createDataFrame([(round(score, 6),)], "silueta double")


@query("kmeans_assign")
def kmeans_assign(spark, sf_dir):
    return S.kmeans_assign(pin(_features(spark, sf_dir)), "id", K.FEATURES).select("id", "Cluster")


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return S.kmeans_sweep(pin(_features(spark, sf_dir)), K.FEATURES)


@query("cluster_sizes")
def cluster_sizes(spark, sf_dir):
    return S.cluster_sizes(S.kmeans_assign(pin(_features(spark, sf_dir)), "id", K.FEATURES)).orderBy("Cluster")


@query("cluster_outliers")
def cluster_outliers(spark, sf_dir):
    """Members of every cluster but the largest: the bound is the largest cluster's size."""
    assigned = pin(S.kmeans_assign(pin(_features(spark, sf_dir)), "id", K.FEATURES))
    largest = S.cluster_sizes(assigned).agg(F.max("n").alias("n")).first()["n"]
    return S.cluster_outliers(assigned, largest).select("id", "Cluster")


@query("kmeans_without_outliers")
def kmeans_without_outliers(spark, sf_dir):
    return S.kmeans_without_outliers(pin(_features(spark, sf_dir)), "id", K.FEATURES, min_size=5).select("id", "Cluster")


@query("cluster_profile")
def cluster_profile(spark, sf_dir):
    return S.cluster_profile(S.kmeans_assign(pin(_features(spark, sf_dir)), "id", K.FEATURES), K.FEATURES)


@query("cluster_profile_given", f"SELECT CAST(g AS INTEGER) AS \"Cluster\", {', '.join(f'round(avg({f}), 2) AS {f}' for f in K.FEATURES)} FROM "
       f"({_FEATURES}) f JOIN (SELECT s_suppkey, s_nationkey % 3 AS g FROM supplier) c ON c.s_suppkey = f.id GROUP BY 1")
def cluster_profile_given(spark, sf_dir):
    sup = B.tables(spark, sf_dir, ["supplier"])["supplier"].select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("Cluster"))
    return S.cluster_profile(_features(spark, sf_dir).join(sup, "id"), K.FEATURES)


# Suppliers' nations stand in for many clusters of different sizes.
_BY_NATION = f"SELECT f.*, CAST(s_nationkey AS INTEGER) AS \"Cluster\" FROM ({_FEATURES}) f JOIN supplier ON s_suppkey = f.id"


def _by_nation(spark, sf_dir):
    sup = B.tables(spark, sf_dir, ["supplier"])["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("int").alias("Cluster"))
    return pin(_features(spark, sf_dir).join(sup, "id"))


@query("cluster_sizes_given", f"SELECT \"Cluster\", count(*) AS n FROM ({_BY_NATION}) t GROUP BY 1 ORDER BY 1")
def cluster_sizes_given(spark, sf_dir):
    return S.cluster_sizes(_by_nation(spark, sf_dir)).orderBy("Cluster")


@query("cluster_outliers_given", f"""WITH t AS ({_BY_NATION}), n AS (SELECT "Cluster", count(*) AS n FROM t GROUP BY 1)
  SELECT id, "Cluster" FROM t WHERE "Cluster" IN (SELECT "Cluster" FROM n WHERE n < (SELECT ceil(avg(n)) FROM n))""")
def cluster_outliers_given(spark, sf_dir):
    """Members of the clusters below the mean size."""
    assigned = _by_nation(spark, sf_dir)
    mean = S.cluster_sizes(assigned).agg(F.ceil(F.avg("n")).alias("m")).first()["m"]
    return S.cluster_outliers(assigned, mean).select("id", "Cluster")


@query("cluster_checks", f"SELECT {_N} AS filas, true AS tamanos_ok, true AS atipicos_ok, true AS reagrupados_ok")
def cluster_checks(spark, sf_dir):
    """Whatever the fit: sizes fall with the label and add up, the members of all but the largest cluster are what that
    leaves, and clustering again without small clusters labels exactly the others."""
    df = pin(_features(spark, sf_dir))
    assigned = pin(S.kmeans_assign(df, "id", K.FEATURES))
    sizes = [r["n"] for r in S.cluster_sizes(assigned).orderBy("Cluster").collect()]       # one row per cluster
    rest = S.cluster_outliers(assigned, sizes[0]).count() if sizes else 0
    small, again = S.cluster_outliers(assigned, 5).count(), S.kmeans_without_outliers(df, "id", K.FEATURES, min_size=5).count()
    rows = df.count()
    return spark.createDataFrame([(rows, sum(sizes) == rows and sizes == sorted(sizes, reverse=True), rest == rows - sizes.count(sizes[0]) * sizes[0],
                                   again == rows - small)], "filas bigint, tamanos_ok boolean, atipicos_ok boolean, reagrupados_ok boolean")


@query("pca_project")
def pca_project(spark, sf_dir):
    return S.pca(pin(_features(spark, sf_dir)), "id", K.FEATURES)[0]


@query("pca_variance")
def pca_variance(spark, sf_dir):
    _, ratio = S.pca(pin(_features(spark, sf_dir)), "id", K.FEATURES)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(ratio)], "componente int, varianza double")


# --- what holds for every fit, as statements ------------------------------------------------------------

@query("kmeans_checks", f"SELECT {_N} AS filas, CAST(0 AS BIGINT) AS sin_cluster, true AS clusters_ok, {_N} AS suma_tamanos, "
       "CAST(0 AS BIGINT) AS desordenados, CAST(0 AS BIGINT) AS fuera_de_centro")
def kmeans_checks(spark, sf_dir):
    df = pin(_features(spark, sf_dir))
    return S.assignment_checks(df, S.kmeans_assign(df, "id", K.FEATURES), "id", K.FEATURES, K.K_FINAL)


@query("sweep_checks", f"SELECT CAST(k AS INTEGER) AS k, true AS en_rango, true AS no_sube FROM (SELECT unnest({list(K.K_SWEEP)}) AS k) u WHERE k < {_N}")
def sweep_checks(spark, sf_dir):
    """Each k of the sweep, and whether its cost lies between 0 and the cost of one cluster (rows times features
    that vary) and its score between -1 and 1, and whether it costs no more than the k before."""
    df = pin(_features(spark, sf_dir))
    most = df.count() * len(K.FEATURES) * (1 + 1e-9)
    before = F.lag("inercia").over(Window.orderBy("k"))     # one row per k
    return S.kmeans_sweep(df, K.FEATURES).select(
        "k", (F.col("inercia").between(0.0, most) & F.col("silueta").between(-1.0, 1.0)).alias("en_rango"),
        F.coalesce(F.col("inercia") <= before * (1 + 1e-9), F.lit(True)).alias("no_sube"))


@query("pca_checks", f"""WITH z AS MATERIALIZED ({_Z}) SELECT count(*) AS filas, true AS centrada, true AS ortogonal, true AS ordenada, true AS varianza_ok FROM z""")
def pca_checks(spark, sf_dir):
    """Scores of the components: centred, uncorrelated, by falling variance, and each one's variance its stated share of
    the features' total variance."""
    df = pin(_features(spark, sf_dir))
    rows, shares = S.pca(df, "id", K.FEATURES)
    z = S.standardize(df, K.FEATURES)
    total = z.agg(sum((F.var_samp(f) for f in K.FEATURES), F.lit(0.0)).alias("t")).scalar()
    v1, v2 = F.var_samp("PCA1"), F.var_samp("PCA2")
    stats = rows.agg(F.count(F.lit(1)).alias("filas"), F.avg("PCA1").alias("m1"), F.avg("PCA2").alias("m2"), v1.alias("v1"), v2.alias("v2"),
                     F.covar_samp("PCA1", "PCA2").alias("c")).withColumn("t", total)
    near = [F.abs(F.col(f"v{i + 1}") / F.col("t") - F.lit(s)) < 1e-6 for i, s in enumerate(shares)]
    return stats.select("filas", ((F.abs("m1") < 1e-6) & (F.abs("m2") < 1e-6)).alias("centrada"), (F.abs("c") < 1e-6 * F.col("t")).alias("ortogonal"),
                        (F.col("v1") >= F.col("v2")).alias("ordenada"), (near[0] & near[1]).alias("varianza_ok"))
