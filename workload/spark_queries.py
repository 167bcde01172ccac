"""One Spark query per operator, on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions.arrays import tof_to_mz
from peakforge.functions.scalars import canonical_id, recode
from peakforge.operators import (
    amr, binning, boosting, catalog, features as X, identification, kernel_map, metrics, models, neighbours, pike, resample, silhouette,
    spectra as S, tuning,
)
from peakforge.plans import sweep, train
from peakforge.session import cut_lineage
from peakforge.sources.archives import parse_analytes
from peakforge.sources.readers import decode_acquisition
from workload import views as V

NAMES = {0: "R", 1: "S"}


def _r(c, digits=6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _long(df: DataFrame, digits=6) -> DataFrame:
    """Spectra as rows (spectrum_id, pos, mz, intensity)."""
    return (df.select("spectrum_id", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p"))
            .select("spectrum_id", F.col("pos").cast("bigint").alias("pos"), _r(F.col("p.mz")).alias("mz"),
                    _r(F.col("p.intensity"), digits).alias("intensity")))


def _vectors(df: DataFrame, *keys, digits=6) -> DataFrame:
    """Feature vectors as rows (sample_id, keys, pos, value)."""
    return df.select("sample_id", *keys, F.posexplode("features").alias("pos", "v")).select(
        "sample_id", *keys, F.col("pos").cast("bigint").alias("pos"), _r("v", digits).alias("value"))


def _spectrum_query(step):
    return lambda spark, sf: _long(V.spectra(spark, sf).transform(step))


def _filled(spark, sf, step) -> DataFrame:
    """Bins of array spectra that are not 0."""
    return _long(V.spectra(spark, sf).transform(step)).filter("intensity <> 0").select("spectrum_id", "pos", "intensity")


def _bins(bins: DataFrame) -> DataFrame:
    return bins.select("spectrum_id", F.col("bin").cast("bigint").alias("bin"), _r("value").alias("value"))


def _labelled(spark, sf) -> DataFrame:
    return V.features(spark, sf).select("sample_id", "features", "label")


def _ids(df: DataFrame) -> DataFrame:
    return df.select("sample_id", F.col("label").cast("int").alias("label"))


def _resampled(method, **params):
    def run(spark, sf):
        return _ids(resample.resample(_labelled(spark, sf), method, **params))
    return run


def _resampled_vectors(method, **params):
    def run(spark, sf):
        out = resample.resample(_labelled(spark, sf), method, **params)
        return _vectors(out.withColumn("label", F.col("label").cast("int")), "label")
    return run


def _split(spark, sf):
    train_side, test_side = resample.split(cut_lineage(_labelled(spark, sf)))
    return cut_lineage(train_side), cut_lineage(test_side)


def _model(name, **params):
    def run(spark, sf):
        train_side, test_side = _split(spark, sf)
        return metrics.evaluate(models.fit(name, train_side, **params).predict(test_side), names=NAMES)
    return run


# ---- cleaning and counting ------------------------------------------------------------------------------------------

def validate_matches(spark, sf):
    return identification.validate_matches(V.matches(spark, sf)).select(
        "extern_id", "target_position", "genus", "species", "status", "reason", "warning")


def trial_matches(spark, sf):
    """Trial mode: the first 100 accepted identifications."""
    found = identification.accepted(identification.validate_matches(V.matches(spark, sf)), limit=100)
    return found.select("extern_id", "target_position", "genus", "species")


def _accepted(spark, sf):
    return identification.accepted(identification.validate_matches(V.matches(spark, sf)))


def species_report(spark, sf):
    return catalog.species_report(_accepted(spark, sf))


def nested_report(spark, sf):
    entries = F.transform(F.array_sort(F.map_entries("species")),
                          lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return catalog.nested_report(_accepted(spark, sf)).select("genus", F.array_join(entries, ",").alias("species"))


def parse_analyte_documents(spark, sf):
    """One small XML document per order, parsed back into matches."""
    match = F.transform("matches", lambda m: F.concat(
        F.lit('<MspMatch referencePatternName="'), m["pattern"], F.lit('" globalMatchValue="'),
        m["score"].cast("string"), F.lit('"/>')))
    xml = F.concat(F.lit('<Results><Analyte externId="'), F.col("extern_id"), F.lit('" targetPosition="'),
                   F.col("target_position"), F.lit('"><List>'), F.array_join(match, ""), F.lit("</List></Analyte></Results>"))
    documents = V.matches(spark, sf).select(F.lit("a").alias("archive"), F.col("extern_id").alias("member"),
                                            xml.cast("binary").alias("content"))
    rows = parse_analytes(documents)
    return rows.select("extern_id", "target_position", F.posexplode("matches").alias("at", "m")).select(
        "extern_id", "target_position", (F.col("at") + 1).cast("bigint").alias("n"), F.col("m.pattern").alias("pattern"),
        _r(F.col("m.score")).alias("score"))


def normalise_species(spark, sf):
    raw = V.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit("MIX!"), F.col("p_name"), F.lit("["), F.col("p_brand"), F.lit("]")))
        .when(F.col("p_size") > 5, F.concat(F.col("p_name"), F.lit("[A]"))).otherwise(F.element_at(F.split("p_name", " "), 1))
        .alias("species"))
    return identification.normalise_species(raw)


def counts_with_total(spark, sf):
    return catalog.counts_with_total(V.catalog(spark, sf))


def species_counts(spark, sf):
    listed = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = listed.select(F.col("r_name").alias("genus"), F.col("n_name").alias("species"))
    extra = listed.select(F.col("genus"), F.concat(F.col("species"), F.lit("_UNSEEN")).alias("species"))
    return catalog.species_counts(V.catalog(spark, sf), [1996, 1997, 1998], listed.unionByName(extra))


def dataset_totals(spark, sf):
    return catalog.dataset_totals(V.catalog(spark, sf))


def top_species(spark, sf):
    return catalog.top_species(V.catalog(spark, sf)).select(
        "dataset", "genus", "species", "total", F.col("rank").cast("bigint").alias("rank"))


def global_stats(spark, sf):
    return catalog.global_stats(V.catalog(spark, sf))


def _known(spark, sf):
    return V.catalog(spark, sf).filter(F.col("dataset") == "MACHINERY")


def keep_known(spark, sf):
    return amr.keep_known(V.amr(spark, sf), _known(spark, sf))[0].select("o_orderkey", "extern_id", "antibiotic", "sir")


def not_found(spark, sf):
    return amr.keep_known(V.amr(spark, sf), _known(spark, sf))[1].select("o_orderkey", "extern_id")


def _valid(spark, sf):
    return V.catalog(spark, sf).select("extern_id", "target_position").distinct()


def match_folders(spark, sf):
    found, _ = catalog.match_folders(_valid(spark, sf), V.members(spark, sf))
    return found.select("extern_id", "target_position", "folder", "files", "folder_status")


def missing_folders(spark, sf):
    return catalog.match_folders(_valid(spark, sf), V.members(spark, sf))[1]


def _label_rows(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"),
                                               F.col("o_custkey").cast("string").alias("code"))
    spectra = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("string").alias("code")).distinct()
    return rows, spectra


def match_labels(spark, sf):
    return catalog.match_labels(*_label_rows(spark, sf))[0]


def missing_labels(spark, sf):
    return catalog.match_labels(*_label_rows(spark, sf))[1]


def fingerprint(spark, sf):
    return catalog.fingerprint(V.blobs(spark, sf))


def duplicate_report(spark, sf):
    return catalog.duplicate_report(catalog.fingerprint(V.blobs(spark, sf)))


def one_per_sample(spark, sf):
    return catalog.one_per_sample(V.catalog(spark, sf)).select("extern_id", "target_position", "replicate", "path")


def pruned_levels(spark, sf):
    rows = V.catalog(spark, sf)
    return catalog.pruned_levels(rows, rows.filter((F.col("dataset") == "MACHINERY") & (F.col("replicate") == "1")))


# ---- susceptibility -------------------------------------------------------------------------------------------------

def canonical_ids(spark, sf):
    raw = V.amr_wide(spark, sf)
    return raw.select("Muestra", canonical_id("Muestra").alias("extern_id"))


def recode_letters(spark, sf):
    return V.letters(spark, sf).select("o_orderkey", recode("raw", "merge_i").alias("merged"), recode("raw", "keep_i").alias("kept"))


def amr_long(spark, sf):
    return amr.amr_long(V.amr_wide(spark, sf), "merge_i")


def amr_long_by_origin(spark, sf):
    return amr.amr_long(V.amr_wide(spark, sf), "keep_i", origin="MACHINERY")


def complete_cases(spark, sf):
    return amr.complete_cases(amr.amr_wide(V.amr_wide(spark, sf), "keep_i")).select("extern_id", *V.ANTIBIOTICS)


def sir_counts(spark, sf):
    return amr.sir_counts(V.amr(spark, sf))


def labelled(spark, sf):
    rows = amr.labelled(V.features(spark, sf).drop("label", "group"), V.amr(spark, sf), "1-URGENT")
    return rows.select("sample_id", "extern_id", "o_orderkey", "sir", "label",
                       _r(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def _rare(method):
    """Rebalancing of one group against all others, on which several rounds run before a stop rule ends them."""
    def run(spark, sf):
        rows = V.features(spark, sf).select("sample_id", "features", F.when(F.col("group") < 1, 0).otherwise(1).alias("label"))
        return _ids(resample.resample(rows, method))
    return run


def _joined_sizes(method):
    """Class sizes after rebalancing the rows of a join in which samples have several letters."""
    def run(spark, sf):
        rows = amr.labelled(V.features(spark, sf).drop("label", "group"), V.amr(spark, sf))
        rows = cut_lineage(rows.select(F.col("row_id").alias("sample_id"), "features", "label"))
        out = resample.resample(rows, method)
        return out.groupBy(F.col("label").cast("int").alias("label")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_ids"))
    return run


def class_distribution(spark, sf):
    return metrics.class_distribution(V.amr(spark, sf), "sir")


# ---- scores ---------------------------------------------------------------------------------------------------------

def evaluate(spark, sf):
    out = metrics.evaluate(V.predictions(spark, sf), names=NAMES)
    return out.select(*[_r(c).alias(c) for c in out.columns])


def per_class(spark, sf):
    out = metrics.per_class(V.predictions(spark, sf))
    return out.select("class", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"), "support")


def macro_f1(spark, sf):
    return metrics.macro_f1(V.predictions(spark, sf)).select(_r("macro_f1").alias("macro_f1"))


def prediction_dump(spark, sf):
    return models.dump(V.predictions(spark, sf))


def run_summary(spark, sf):
    runs = V.table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("score"))
    return metrics.run_summary(runs).select(_r("mean_accuracy").alias("mean_accuracy"), _r("std_accuracy").alias("std_accuracy"))


def histogram(spark, sf):
    out = metrics.histogram(V.table(spark, sf, "events"), "value", 30)
    return out.select(F.col("bin").cast("bigint").alias("bin"), _r("low").alias("low"), _r("high").alias("high"), "count")


def reject_curve(spark, sf):
    rows = V.table(spark, sf, "events").select(
        (F.col("value") / 500).alias("confidence"), (F.col("value") > 50).cast("int").alias("label"),
        (F.col("event_type") == "click").cast("int").alias("prediction"))
    out = metrics.reject_curve(rows, (0.1, 0.5, 0.75))
    return out.select("threshold", _r("reject_rate").alias("reject_rate"), _r("accepted_accuracy").alias("accepted_accuracy"))


def confidence(spark, sf):
    """Largest class probability of every event."""
    p = F.col("value") / 500
    rows = V.table(spark, sf, "events").select("event_id", F.array(p / 2, 1 - p, p / 2).alias("probability"))
    return metrics.confidence(rows).select("event_id", _r("confidence").alias("confidence"))


def append_results(spark, sf):
    """Score rows of two prediction sets in one table with a column only one of them has."""
    a = evaluate(spark, sf).withColumn("method", F.lit("none"))
    b = macro_f1(spark, sf).withColumn("method", F.lit("Macro"))
    return metrics.append_results(a.select("method", "accuracy"), b)


# ---- spectra --------------------------------------------------------------------------------------------------------

def tof_calibration(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        tof_to_mz(F.lit(2.5e6) + F.col("l_quantity"), 100 + F.col("l_tax"),
                  F.when(F.col("l_linenumber") > 3, 0.0).otherwise(F.col("l_discount") / 1000),
                  F.col("l_extendedprice")).alias("mz"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", _r("mz", 4).alias("mz"))


def decode_signals(spark, sf):
    """Document bytes read as whole signals: the header's number of points is that of the bytes."""
    header = "\n".join(["##$DELAY= 19000", "##$DW= 0.5", "##$ML1= 2500000.0", "##$ML2= 100.0",
                        "##$ML3= 0.001", "##$BYTORDA= 0"])
    points = F.expr("octet_length(fid) div 4").cast("string")
    raw = V.blobs(spark, sf).select("path", F.concat(F.lit("##$TD= "), F.coalesce(points, F.lit("0")), F.lit("\n" + header)).alias("acqu"), "fid")
    return decode_acquisition(raw).select(
        "path", F.size("mz").cast("bigint").alias("points"),
        _r(F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v), 0).alias("total"),
        _r(F.try_element_at("mz", F.lit(1)), 4).alias("first_mz"))


def standard_features(spark, sf):
    return (_vectors(S.build_features(V.spectra(spark, sf)), digits=8).filter("value <> 0"))


def resampled_chain(spark, sf):
    return _long(V.spectra(spark, sf).transform(S.resampled_chain(1000)), 8)


def trace_steps(spark, sf):
    steps = S.trace_steps(V.spectra(spark, sf))
    return steps.select("spectrum_id", "step_no", "step", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select(
        "spectrum_id", "step_no", "step", F.col("pos").cast("bigint").alias("pos"), _r(F.col("p.mz")).alias("mz"),
        _r(F.col("p.intensity")).alias("intensity"))


def before_after(spark, sf):
    rows = S.before_after(V.spectra(spark, sf), 1000)
    return rows.select("spectrum_id", "stage", F.posexplode("intensity").alias("pos", "v")).select(
        "spectrum_id", "stage", F.col("pos").cast("bigint").alias("pos"), _r("v").alias("intensity"))


def sequential_steps(spark, sf):
    steps = S.chain(S.stabilise("sqrt"), S.baseline("snip"), S.tic(), S.trim(3000, 19000), S.filter_peaks(top=10))
    return _long(V.spectra(spark, sf).transform(steps), 8)


def densify(spark, sf):
    """Dense vectors of all spectra: their width, total and the values that are not 0."""
    dense = binning.densify(binning.bin_points_log(V.points(spark, sf)), 100)
    total = _r(F.aggregate("features", F.lit(0.0), lambda a, v: a + v))
    filled = F.filter(F.transform("features", lambda v, i: F.struct(i.cast("bigint").alias("bin"), v.alias("v"))),
                      lambda e: e["v"] != 0)
    return dense.select("spectrum_id", F.size("features").cast("bigint").alias("width"), total.alias("total"),
                        F.explode(filled).alias("e")).select("spectrum_id", "width", "total", "e.bin", _r("e.v").alias("value"))


def _points_stat(agg):
    return lambda spark, sf: _bins(binning.bin_points_log(V.points(spark, sf), n=100, agg=agg))


# ---- features -------------------------------------------------------------------------------------------------------

def feature_stats(spark, sf):
    out = X.feature_stats(_labelled(spark, sf))
    return out.select(F.col("feature").cast("bigint").alias("feature"), F.col("n").cast("bigint").alias("n"),
                      *[_r(c).alias(c) for c in ("mean", "min", "max", "var_pop", "corr")])


def select_variance(spark, sf):
    stats = X.feature_moments(X.min_max(_labelled(spark, sf)))
    return stats.filter(F.col("var_pop") > 0.025).select(F.col("feature").cast("bigint").alias("feature"), _r("var_pop").alias("var_pop"))


def select_correlation(spark, sf):
    stats = X.feature_stats(_labelled(spark, sf))
    kept = X.select_correlation(stats, 0.05)
    return X.take_features(_labelled(spark, sf), kept).transform(_vectors)


def min_max(spark, sf):
    return _vectors(X.min_max(_labelled(spark, sf)))


def standardise(spark, sf):
    return _vectors(X.standardise(_labelled(spark, sf)))


def pca_project(spark, sf):
    return _vectors(X.pca_project(X.min_max(_labelled(spark, sf)), 5))


def pca_spread(spark, sf):
    """Total variance is kept by a full rotation: the sum over all component variances, and the means."""
    scores = X.feature_moments(X.pca_project(_labelled(spark, sf), 64))
    return scores.agg(_r(F.sum("var_pop")).alias("total_variance"), _r(F.sum(F.abs("mean"))).alias("abs_mean"),
                      F.count(F.lit(1)).alias("components"))


# ---- neighbours -----------------------------------------------------------------------------------------------------

def _knn(metric):
    def run(spark, sf):
        rows = _labelled(spark, sf)
        out = neighbours.knn_join(rows, rows, 5, metric)
        return out.select("src", "dst", F.col("rank").cast("bigint").alias("rank"), _r("dist").alias("dist"))
    return run


def knn_join_blocks(spark, sf):
    """The same join through the block path, with blocks small enough to have many of them."""
    rows = _labelled(spark, sf)
    out = neighbours.knn_join(rows, rows, 5, strategy="blocks", block_bytes=64 * 1024)
    return out.select("src", "dst", F.col("rank").cast("bigint").alias("rank"), _r("dist").alias("dist"))


def neighbour_graph(spark, sf):
    graph = neighbours.neighbour_graph(_labelled(spark, sf), 45)
    return neighbours.at_most(graph, 10).groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"), _r(F.sum("dist")).alias("reach"))


def knn_classify(spark, sf):
    train_side, test_side = resample.split(_labelled(spark, sf), stratify=False)
    out = neighbours.knn_classify(test_side, train_side, 5)
    return out.select("sample_id", "label", F.col("prediction").cast("int").alias("prediction"),
                      _r(F.get("probability", F.lit(1))).alias("share_s"))


def silhouette_samples(spark, sf):
    out = silhouette.silhouette_samples(_labelled(spark, sf))
    return out.select("sample_id", F.col("label").cast("int").alias("label"), _r("silhouette").alias("silhouette"))


def silhouette_samples_blocks(spark, sf):
    """The same through the block path, with blocks small enough to have many tiles."""
    out = silhouette.silhouette_samples(_labelled(spark, sf), strategy="blocks", block_bytes=8 * 1024)
    return out.select("sample_id", F.col("label").cast("int").alias("label"), _r("silhouette").alias("silhouette"))


def mean_silhouette(spark, sf):
    return silhouette.silhouette(_labelled(spark, sf)).select(_r("silhouette").alias("silhouette"))


def squared_silhouette(spark, sf):
    return silhouette.silhouette(_labelled(spark, sf), exact=False).select(_r("silhouette").alias("silhouette"))


def _peak_kernel(spark, sf, **way):
    rows = V.features(spark, sf)
    mean = (rows.select("group", F.posexplode("features").alias("i", "v")).groupBy("group", "i").agg(F.avg("v").alias("v"))
            .groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("features"))
            .select(F.concat(F.lit("g"), F.col("group")).alias("sample_id"), "features"))
    out = pike.pike_kernel(rows, mean, [2000 + 281.25 * i for i in range(64)], t=1e4, **way)
    return out.select("id_x", "id_y", _r("k", 9).alias("k"))


def pike_kernel(spark, sf):
    """Kernel of every spectrum with the mean spectrum of each group."""
    return _peak_kernel(spark, sf)


def pike_kernel_blocks(spark, sf):
    """The same through the block path, with blocks small enough to have many tiles."""
    return _peak_kernel(spark, sf, strategy="blocks", block_bytes=4 * 1024)


# ---- split and rebalancing ------------------------------------------------------------------------------------------

def split_stratified(spark, sf):
    a, b = resample.split(_labelled(spark, sf))
    return _ids(a).withColumn("side", F.lit("train")).unionByName(_ids(b).withColumn("side", F.lit("test")))


def split_plain(spark, sf):
    a, b = resample.split(_labelled(spark, sf), stratify=False)
    return _ids(a).withColumn("side", F.lit("train")).unionByName(_ids(b).withColumn("side", F.lit("test")))


# ---- models ---------------------------------------------------------------------------------------------------------

def stratified_folds(spark, sf):
    return tuning.with_folds(_labelled(spark, sf), 5).select("sample_id", F.col("label").cast("int").alias("label"), "fold")


def grid_search(spark, sf):
    train_side, _ = _split(spark, sf)
    scores, _, _ = tuning.grid_search(train_side, "logistic", {"C": [0.1, 1.0, 10.0]}, refit=False)
    return scores


def grid_search_three_classes(spark, sf):
    rows = V.features(spark, sf).select("sample_id", "features", F.when(F.col("group") < 3, 0).when(
        F.col("group") < 7, 1).otherwise(2).alias("label"))
    train_side, _ = resample.split(cut_lineage(rows), stratify=False)
    scores, _, _ = tuning.grid_search(train_side, "gradient_boosting", {"trees": [3], "depth": [2, 3]}, refit=False)
    return scores


def grid_search_svm(spark, sf):
    """All 32 settings of the kernel machine: four costs, four kernels, two widths."""
    train_side, _ = _split(spark, sf)
    grid = {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly", "sigmoid"], "gamma": ["scale", "auto"], "size": [100]}
    return tuning.grid_search(train_side, "svm", grid, refit=False)[0]


def kernel_products(spark, sf):
    """Dot products of mapped landmarks: the polynomial kernel between them."""
    rows = _labelled(spark, sf)
    mapped = kernel_map.kernel_map(rows, "poly", 0.05, degree=2, offset=1.0, landmarks=40)
    own = cut_lineage(mapped(kernel_map.landmark_rows(rows, 40)).select("sample_id", "features"))
    other = own.select(F.col("sample_id").alias("b"), F.col("features").alias("g"))
    pairs = own.select(F.col("sample_id").alias("a"), "features").join(other, F.col("a") <= F.col("b"))
    dot = F.aggregate(F.zip_with("features", "g", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return pairs.select("a", "b", _r(dot, 4).alias("k"))


def compare_methods(spark, sf):
    train_side, test_side = _split(spark, sf)
    return tuning.compare(train_side, test_side, {"logistic": {}, "knn": {}},
                          ("none", "smote", "random_under", "tomek"))


def rfecv_scores(spark, sf):
    train_side, _ = _split(spark, sf)
    return tuning.rfecv(train_side, min_features=16)[1]


def line_up(spark, sf):
    train_side, test_side = _split(spark, sf)
    return train.line_up(train_side, test_side, {
        "knn": {"weights": "uniform"}, "gaussian_bayes": {}, "svm": {"gamma": "scale", "C": 1.0, "size": 200},
        "decision_tree": {"max_depth": 10}, "random_forest": {"trees": 20, "weighted": False},
        "xgboost_like": {"trees": 5}, "neural_net": {"hidden": (10,), "epochs": 20},
    }, step=0.5, folds=2, min_features=16, trees=10)


def confidence_report(spark, sf):
    train_side, test_side = _split(spark, sf)
    return train.confidence_report(train_side, test_side)[2]


def confidence_histogram(spark, sf):
    train_side, test_side = _split(spark, sf)
    return train.confidence_report(train_side, test_side)[1]


def projection_sweep(spark, sf):
    return sweep.sweep_pca(_labelled(spark, sf), thresholds=(0.0, 0.05, 0.1), sizes=(2, 5, 10))


def target_stats(spark, sf):
    """Correlation of every feature with the first letter of every target, all targets in one pass."""
    stats = X.feature_stats(sweep.with_targets(_labelled(spark, sf), V.target_letters(spark, sf)), keys=["target"])
    return stats.select("target", F.col("feature").cast("bigint").alias("feature"), F.col("n").cast("bigint").alias("n"),
                        _r("corr").alias("corr"))


def target_projection(spark, sf):
    """Silhouettes of every target on fixed loadings, for two, three and five components."""
    loads = [[math.cos((i + 1) * (j + 2)) for j in range(5)] for i in range(64)]
    out = sweep.project_targets(_labelled(spark, sf), V.target_letters(spark, sf), loads, (2, 3, 5))
    return out.select("target", "n_components", "n", _r("silhouette").alias("silhouette"))


def target_sweep(spark, sf):
    return sweep.sweep_targets(_labelled(spark, sf), V.target_letters(spark, sf), (0.0, 0.05, 0.1), (2, 5, 10))


def pca_components(spark, sf):
    """What principal components must be, of the randomised fit: uncorrelated, spreads in order, the first above any feature's."""
    rows = _labelled(spark, sf)
    scores = X.pca_project(rows, 8, method="randomised", extra=16, passes=12)
    at = [F.get("features", F.lit(i)) for i in range(8)]
    spread = scores.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(at)], *[
        F.covar_pop(at[i], at[j]).alias(f"c{i}{j}") for i in range(8) for j in range(i)])
    most = X.feature_moments(rows).agg(F.max("var_pop").alias("most"))
    off = F.greatest(*[F.abs(F.col(f"c{i}{j}")) for i in range(8) for j in range(i)])
    order = F.least(*[F.col(f"v{i}") - F.col(f"v{i + 1}") for i in range(7)])
    return spread.crossJoin(F.broadcast(most)).select(
        (off < 1e-6 * F.col("v0")).alias("uncorrelated"), (order >= -1e-9 * F.col("v0")).alias("ordered"),
        (F.col("v0") >= F.col("most")).alias("above_features"))


def embedding_sweep(spark, sf):
    """Supplied two-dimensional embeddings: the first positions of every vector, once plain and once doubled."""
    rows = _labelled(spark, sf).withColumn("features", F.slice("features", 1, 2))
    both = rows.withColumn("scale", F.lit(1)).unionByName(
        rows.withColumn("scale", F.lit(2)).withColumn("features", F.transform("features", lambda v: v * 2)))
    return sweep.sweep_embeddings(both, ["scale"]).select("scale", _r("silhouette").alias("silhouette"))


def bayes_predictions(spark, sf):
    """Class and probability of every row under the Gaussian model of all rows."""
    rows = cut_lineage(_labelled(spark, sf))
    out = models.fit("gaussian_bayes", rows).predict(rows)
    return out.select("sample_id", F.col("prediction").cast("int").alias("prediction"), _r(F.get("probability", F.lit(1)), 5).alias("p"))


def boosting_rounds(spark, sf):
    """Three rounds of one-split trees on given borders: the split, its gain and the worth of both leaves."""
    nodes = boosting.fit(_labelled(spark, sf), trees=3, depth=1, cuts=[-0.2, -0.1, 0.0, 0.1, 0.2]).splits(spark)
    side = {s: nodes.select("round", F.col("node").alias(s), F.col("rows").cast("bigint").alias(f"{s}_rows"),
                            _r("value").alias(f"{s}_value")) for s in ("left", "right")}
    split = nodes.filter(F.col("feature") >= 0).join(side["left"], ["round", "left"]).join(side["right"], ["round", "right"])
    return split.select("round", "feature", "cut", _r("gain").alias("gain"), "left_rows", "right_rows", "left_value", "right_value")


QUERIES = {
    # cleaning and counting
    "validate_matches": validate_matches, "trial_matches": trial_matches, "species_report": species_report, "nested_report": nested_report,
    "parse_analyte_documents": parse_analyte_documents, "normalise_species": normalise_species,
    "counts_with_total": counts_with_total, "species_counts": species_counts, "dataset_totals": dataset_totals,
    "top_species": top_species, "global_stats": global_stats, "keep_known": keep_known, "not_found": not_found,
    "match_folders": match_folders, "missing_folders": missing_folders, "match_labels": match_labels,
    "missing_labels": missing_labels, "fingerprint": fingerprint, "duplicate_report": duplicate_report,
    "one_per_sample": one_per_sample, "pruned_levels": pruned_levels,
    # susceptibility
    "canonical_ids": canonical_ids, "recode_letters": recode_letters, "amr_long": amr_long,
    "amr_long_by_origin": amr_long_by_origin, "complete_cases": complete_cases, "sir_counts": sir_counts,
    "labelled": labelled, "class_distribution": class_distribution,
    **{f"joined_{m}_sizes": _joined_sizes(m) for m in ("random_over", "random_under", "smote")},
    # scores
    "evaluate": evaluate, "per_class": per_class, "macro_f1": macro_f1, "prediction_dump": prediction_dump,
    "run_summary": run_summary, "histogram": histogram, "confidence": confidence, "reject_curve": reject_curve, "append_results": append_results,
    # spectra
    "tof_calibration": tof_calibration, "decode_signals": decode_signals,
    "stabilise_sqrt": _spectrum_query(S.stabilise("sqrt")), "stabilise_log": _spectrum_query(S.stabilise("log")),
    "stabilise_log2": _spectrum_query(S.stabilise("log2")), "stabilise_log10": _spectrum_query(S.stabilise("log10")),
    "smooth": _spectrum_query(S.smooth()), "baseline_snip": _spectrum_query(S.baseline("snip")),
    "baseline_als": _spectrum_query(S.baseline("als")), "baseline_arpls": _spectrum_query(S.baseline("arpls")),
    "tic": lambda spark, sf: _long(V.spectra(spark, sf).transform(S.tic()), 8), "trim": _spectrum_query(S.trim()),
    "binarise": _spectrum_query(S.binarise(600.0)), "scale_by_min": _spectrum_query(S.scale_by_min),
    "filter_peaks": _spectrum_query(S.filter_peaks(top=8, min_intensity=700.0)),
    "jitter_normal": _spectrum_query(S.jitter_normal()), "jitter_uniform": _spectrum_query(S.jitter_uniform()),
    "persistence": _spectrum_query(S.persistence()), "persistence_peaks": _spectrum_query(S.persistence(False)),
    "resample_grid": _spectrum_query(S.resample_grid(1000)),
    "bin_equal": lambda spark, sf: _filled(spark, sf, S.bin_equal()),
    "bin_log": lambda spark, sf: _filled(spark, sf, S.bin_log()),
    "bin_table": lambda spark, sf: _filled(spark, sf, S.bin_table()),
    "bin_table_literal": lambda spark, sf: _filled(spark, sf, S.bin_table(S.MASS_TABLE_LITERAL)),
    "standard_features": standard_features, "resampled_chain": resampled_chain, "trace_steps": trace_steps,
    "before_after": before_after, "sequential_steps": sequential_steps,
    "bin_points_equal": lambda spark, sf: _bins(binning.bin_points_equal(V.points(spark, sf))),
    "bin_points_log": lambda spark, sf: _bins(binning.bin_points_log(V.points(spark, sf))),
    "bin_points_table": lambda spark, sf: _bins(binning.bin_points_table(V.points(spark, sf))),
    "bin_points_table_literal": lambda spark, sf: _bins(binning.bin_points_table(V.points(spark, sf), S.MASS_TABLE_LITERAL)),
    **{f"bin_points_{a}": _points_stat(a) for a in ("mean", "std", "median", "min", "max", "count")},
    "densify": densify,
    # features
    "feature_stats": feature_stats, "select_variance": select_variance, "select_correlation": select_correlation,
    "min_max": min_max, "standardise": standardise, "pca_project": pca_project, "pca_spread": pca_spread,
    # neighbours
    "knn_join": _knn("euclidean"), "knn_join_manhattan": _knn("manhattan"), "knn_join_blocks": knn_join_blocks,
    "neighbour_graph": neighbour_graph, "knn_classify": knn_classify, "silhouette_samples": silhouette_samples,
    "silhouette_samples_blocks": silhouette_samples_blocks, "target_stats": target_stats,
    "target_projection": target_projection, "kernel_products": kernel_products, "grid_search_svm": grid_search_svm, "target_sweep": target_sweep, "boosting_rounds": boosting_rounds, "bayes_predictions": bayes_predictions, "pca_components": pca_components, "pike_kernel_blocks": pike_kernel_blocks,
    "mean_silhouette": mean_silhouette, "squared_silhouette": squared_silhouette, "pike_kernel": pike_kernel,
    # split and rebalancing
    "split_stratified": split_stratified, "split_plain": split_plain,
    "resample_none": _resampled("none"), "random_under": _resampled("random_under"),
    "random_over": _resampled_vectors("random_over"), "smote": _resampled_vectors("smote"),
    "adasyn": _resampled_vectors("adasyn"), "borderline_smote": _resampled_vectors("borderline_smote"),
    "svm_smote": _resampled_vectors("svm_smote"), "edited": _resampled("edited"),
    "repeated_edited": _resampled("repeated_edited"), "all_knn": _resampled("all_knn"),
    "repeated_edited_rare": _rare("repeated_edited"), "all_knn_rare": _rare("all_knn"),
    "smote_edited": _resampled("smote_edited"), "tomek": _resampled("tomek"),
    "condensed": _resampled("condensed"), "one_sided": _resampled("one_sided"),
    "neighbourhood_cleaning": _resampled("neighbourhood_cleaning"), "near_miss": _resampled("near_miss"),
    "instance_hardness": _resampled("instance_hardness"),
    "cluster_centroids": _resampled_vectors("cluster_centroids"),
    # models
    "model_logistic": _model("logistic"), "model_random_forest": _model("random_forest"),
    "model_knn": _model("knn"), "model_adaboost": _model("adaboost"),
    "model_gradient_boosting": _model("gradient_boosting"),
    "model_xgboost_like": _model("xgboost_like", trees=10, subsample=0.8, columns="0.8"),
    "model_lightgbm_like": _model("lightgbm_like", trees=5), "model_extra_trees": _model("extra_trees"),
    "model_svm_rbf": _model("svm"), "model_svm_linear": _model("svm", kernel="linear", C=1.0),
    "model_gaussian_bayes": _model("gaussian_bayes"), "model_decision_tree": _model("decision_tree"),
    "model_neural_net": _model("neural_net"),
    "stratified_folds": stratified_folds, "grid_search": grid_search, "grid_search_three_classes": grid_search_three_classes, "compare_methods": compare_methods,
    "rfecv_scores": rfecv_scores, "line_up": line_up, "confidence_report": confidence_report,
    "confidence_histogram": confidence_histogram, "projection_sweep": projection_sweep, "embedding_sweep": embedding_sweep,
}
