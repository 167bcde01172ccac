"""Projection sweep: feature selection thresholds x projection sizes, scored by the silhouette."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.operators import features as X
from peakforge.operators.blocks import shape
from peakforge.operators.features import project
from peakforge.operators.neighbours import bounded_neighbourhood
from peakforge.operators.silhouette import silhouette, silhouette_by
from peakforge.session import cut_lineage

SWEEP = "target string, threshold double, n_features int, n_components int, silhouette double"


def sweep_pca(df: DataFrame, thresholds, sizes, by: str = "corr", positive=0, exact: bool = True) -> DataFrame:
    """(threshold, n_features, n_components, silhouette). Statistics are computed once, the projection is fitted once per
    threshold at its largest size; smaller sizes are its leading positions. Points with fewer than two features and sizes
    beyond min(rows, features) are skipped."""
    data = cut_lineage(X.min_max(df).select("sample_id", "features", "label"))
    stats = cut_lineage(X.feature_stats(data, positive=positive))
    n, rows = shape(data)[0], []
    for t in thresholds:
        kept = X.select_correlation(stats, t) if by == "corr" else X.select_variance(stats, t)
        usable = [s for s in sizes if s <= min(n, len(kept))]
        if len(kept) < 2 or not usable:
            continue
        scores = cut_lineage(X.pca_project(X.take_features(data, kept), max(usable)))
        for s in usable:
            value = silhouette(X.leading(scores, s), exact).first()[0]
            rows.append((float(t), len(kept), int(s), float(value)))
    return df.sparkSession.createDataFrame(rows, "threshold double, n_features int, n_components int, silhouette double")


def sweep_embeddings(embeddings: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Silhouette of every supplied 2-D embedding, one per distinct value of ``keys`` (few: the points of a grid)."""
    points = [tuple(r) for r in embeddings.select(*keys).distinct().orderBy(*keys).collect()]
    rows = []
    for point in points:
        match = F.lit(True)
        for k, v in zip(keys, point):
            match = match & F.col(k).eqNullSafe(F.lit(v))
        rows.append((*point, float(silhouette(embeddings.filter(match), exact).first()[0])))
    kinds = {f.name: f.dataType.simpleString() for f in embeddings.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", silhouette double"
    return embeddings.sparkSession.createDataFrame(rows, schema)


def with_targets(df: DataFrame, letters: DataFrame) -> DataFrame:
    """Rows (``target``, sample_id, features, label): every vector once per target that has a letter for it."""
    return df.select("sample_id", "features").join(letters.filter("label is not null").select("sample_id", "target", "label"), "sample_id")


def project_targets(df: DataFrame, letters: DataFrame, loads, sizes) -> DataFrame:
    """(target, n_components, n, silhouette) on given loadings: the first positions of one projection, whose distances all targets share."""
    scores = with_targets(project(df, loads), letters)
    n = F.explode(F.array(*[F.lit(int(s)) for s in sizes]))
    points = scores.withColumn("n_components", n).withColumn("features", F.slice("features", F.lit(1), F.col("n_components")))
    return silhouette_by(points, ["target", "n_components"], shared=["n_components"])


def sweep_targets(df: DataFrame, letters: DataFrame, thresholds, sizes, positive=0, method: str = "auto") -> DataFrame:
    """(target, threshold, n_features, n_components, silhouette) for every target, as ``letters`` (sample_id, target, label) has them.

    The correlations of all targets come from one pass over the joined rows, and their class sizes from the same table. A target
    with one row, and sizes beyond what its rows and kept features allow, are skipped; one class only gives NaN. A projection is fitted
    per target and set of kept features; thresholds that keep the same features share it, and so do targets with letters for the same rows.
    """
    joined = cut_lineage(with_targets(X.min_max(df), letters))
    stats = cut_lineage(X.feature_stats(joined, positive=positive, keys=["target"]))
    rows = {r["target"]: r["n"] for r in stats.groupBy("target").agg(F.max("n").alias("n")).collect()}
    mark = F.struct(*[F.sum(F.xxhash64(F.lit(i), "sample_id", "features").cast("decimal(38,0)")) for i in range(2)])
    same_rows = {r["target"]: tuple(r["mark"]) if r["n"] == r["ids"] else r["target"] for r in joined.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("ids"), mark.alias("mark")).collect()}
    fits: dict[tuple, dict[str, list]] = {}
    for target in sorted(rows):
        for t in thresholds:
            kept = tuple(X.select_correlation(stats.filter(F.col("target") == target), t))
            if len(kept) >= 2:
                fits.setdefault((kept, same_rows[target]), {}).setdefault(target, []).append(float(t))
    points, shape_of = None, {}
    for number, ((kept, _), members) in enumerate(fits.items()):
        first = next(iter(members))
        most = bounded_neighbourhood(int(rows[first]) + 1, len(kept))
        usable = [int(s) for s in sizes if s <= (most or 0)]
        if not usable:
            continue
        scores = X.pca_project(X.take_features(joined.filter(F.col("target") == first), list(kept)), max(usable), method)
        if len(members) > 1:
            letters_of = joined.filter(F.col("target").isin(list(members))).select("sample_id", "target", "label")
            scores = scores.select("sample_id", "features").join(letters_of, "sample_id")
        asked = F.coalesce(*[F.when(F.col("target") == a, F.lit(same[0])) for a, same in members.items()])
        each = scores.withColumn("n_components", F.explode(F.array(*[F.lit(s) for s in usable]))).withColumn(
            "features", F.slice("features", F.lit(1), F.col("n_components"))).withColumn("threshold", asked).withColumn("fit", F.lit(number))
        each = each.select("sample_id", "target", "label", "features", "n_components", "threshold", "fit")
        points = each if points is None else points.unionByName(each)
        shape_of.update({(a, t): (len(kept), same[0]) for a, same in members.items() for t in same})
    if points is None:
        return df.sparkSession.createDataFrame([], SWEEP)
    scored = silhouette_by(cut_lineage(points), ["target", "threshold", "n_components"], shared=["fit", "n_components"])
    grid = df.sparkSession.createDataFrame([(a, t, n, first) for (a, t), (n, first) in shape_of.items()],
                                           "target string, asked double, n_features int, threshold double")
    return grid.join(scored, ["target", "threshold"]).select(
        "target", F.col("asked").alias("threshold"), "n_features", "n_components", "silhouette")
