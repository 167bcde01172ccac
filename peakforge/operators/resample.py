"""Train/test split and the eighteen class-rebalancing methods.

Input and output: (sample_id text, features array<double>, label). Random choices are hash draws of the row id, so they do
not depend on partitioning. Class sizes are a tiny grouped count; nothing else reaches the driver. Neighbour-based
methods stand on the exact neighbour join; loops cut their lineage every round.
"""

from __future__ import annotations

import itertools

from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions.scalars import hash_uniform
from peakforge.operators.blocks import fits, shape
from peakforge.operators.kernel_map import LANDMARKS, kernel_map
from peakforge.operators.neighbours import knn_lists
from peakforge.operators.ranking import lowest, quantile, ranked, smallest
from peakforge.session import cut_lineage

COLUMNS = ["sample_id", "features", "label"]
SEED = 42
# Neighbours that ``repeated_edited`` lists beyond those a round asks for, so that few lists run out.
SPARE = 12
# Rows that are joined with a large table by a single pass over it.
FEW = 1024
LIST = "array<struct<id:string,label:double>>"


def class_sizes(df: DataFrame) -> dict:
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}


def minority(sizes: dict):
    return min(sizes, key=lambda c: (sizes[c], c))


def majority(sizes: dict):
    return max(sizes, key=lambda c: (sizes[c], c))


def _draw(tag, seed) -> Column:
    return hash_uniform(F.col("sample_id"), F.lit(tag), F.lit(seed))


# ---- split ----------------------------------------------------------------------------------------------------------

def split(df: DataFrame, test: float = 0.35, seed: int = SEED, stratify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test). Stratified: exactly the rounded share of every class with the lowest draws goes to the test side.
    Plain: every row by its own draw, without a shuffle."""
    if not stratify:
        u = _draw("split", seed)
        return df.filter(u >= test), df.filter(u < test)
    counts = {c: int(n * test + 0.5) for c, n in class_sizes(df).items()}
    held = lowest(df, _draw("split", seed), counts)
    return df.filter(~held), df.filter(held)


# ---- random sampling ------------------------------------------------------------------------------------------------

def none(df: DataFrame, seed: int = SEED) -> DataFrame:
    return df.select(*COLUMNS)


def random_under(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Every class cut to the smallest one, without replacement."""
    sizes = class_sizes(df)
    return df.filter(lowest(df, _draw("under", seed), dict.fromkeys(sizes, min(sizes.values())))).select(*COLUMNS)


def _draws(df: DataFrame, n: int, tag: str, seed: int, n_seeds: int) -> DataFrame:
    """``n`` numbered draws: the rank of a seed row, a neighbour share and a gap."""
    i = F.col("draw")
    return df.sparkSession.range(n).withColumnRenamed("id", "draw").select(
        "draw", F.floor(hash_uniform(i, F.lit(tag), F.lit("seed"), F.lit(seed)) * n_seeds).alias("rank"),
        hash_uniform(i, F.lit(tag), F.lit("nn"), F.lit(seed)).alias("share"),
        hash_uniform(i, F.lit(tag), F.lit("gap"), F.lit(seed)).alias("gap"))


def random_over(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Every class drawn up to the largest one, with replacement."""
    sizes, out = class_sizes(df), df.select(*COLUMNS)
    top = max(sizes.values())
    for c, n in sizes.items():
        if n == top:
            continue
        rows = df.filter(F.col("label") == c).select(*COLUMNS)
        drawn = (_draws(df, top - n, f"over{c}", seed, n).join(ranked(rows.select("sample_id"), ["sample_id"]), "rank")
                 .join(rows, "sample_id"))
        out = out.unionByName(drawn.select(F.concat(F.lit(f"over:{c}:"), F.col("draw")).alias("sample_id"),
                                           "features", "label"))
    return out


# ---- synthetic rows -------------------------------------------------------------------------------------------------

def _synthesise(draws: DataFrame, pool: DataFrame, tag: str, label) -> DataFrame:
    """Rows (draw, sample_id, nn, share, gap) to points between the row and its drawn neighbour."""
    at = F.floor(F.col("share") * F.size("nn")).cast("int")
    picked = draws.select("draw", "sample_id", "gap", F.get("nn", at)["id"].alias("_other"))
    start = pool.select("sample_id", F.col("features").alias("_from"))
    other = pool.select(F.col("sample_id").alias("_other"), F.col("features").alias("_to"))
    point = F.zip_with("_from", "_to", lambda a, b: a + F.col("gap") * (b - a))
    return picked.join(start, "sample_id").join(other, "_other").select(
        F.concat(F.lit(f"{tag}:{label}:"), F.col("draw")).alias("sample_id"), point.alias("features"),
        F.lit(label).alias("label"))


def _from_seeds(df: DataFrame, seeds: DataFrame, pool: DataFrame, n: int, tag: str, label, seed: int,
                stretch: float = 1.0) -> DataFrame:
    """``n`` synthetic rows whose starting rows are drawn uniformly from ``seeds`` (with neighbour lists ``nn``).

    Ids and neighbour lists are ranked and stored; vectors are joined to the draws afterwards.
    """
    placed = ranked(seeds.select("sample_id", "nn"), ["sample_id"])
    count = placed.count()
    if count == 0 or n <= 0:
        return df.select(*COLUMNS).limit(0)
    drawn = (_draws(df, n, f"{tag}{label}", seed, count).join(placed, "rank")
             .withColumn("gap", F.col("gap") * stretch))
    return _synthesise(drawn, pool, tag, label)


def _targets(df: DataFrame):
    """(class, rows to add) of every class below the largest."""
    sizes = class_sizes(df)
    top = max(sizes.values())
    return [(c, top - n) for c, n in sizes.items() if n < top]


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label").cast(like.schema["label"].dataType))


def smote(df: DataFrame, seed: int = SEED, k: int = 5) -> DataFrame:
    """Points on the segments between a class row and one of its k neighbours of the same class."""
    out = df.select(*COLUMNS)
    for c, n in _targets(df):
        rows = df.filter(F.col("label") == c).select(*COLUMNS)
        made = _from_seeds(df, knn_lists(rows, rows, k), rows, n, "smote", c, seed)
        out = out.unionByName(_typed(made, df))
    return out


def _foreign(label) -> Column:
    return F.size(F.filter("nn", lambda x: x["label"] != F.lit(float(label))))


def adasyn(df: DataFrame, seed: int = SEED, k: int = 5) -> DataFrame:
    """As SMOTE, with the number of points per row in proportion to the foreign share among its k neighbours."""
    out = df.select(*COLUMNS)
    for c, n in _targets(df):
        rows = df.filter(F.col("label") == c).select(*COLUMNS)
        hard = cut_lineage(knn_lists(rows, df, k).select(
            "sample_id", (_foreign(c) / F.size("nn")).alias("ratio")))
        total = hard.agg(F.sum("ratio")).first()[0]
        if not total:
            raise ValueError("no row of the class has a neighbour of another class")
        each = hard.select("sample_id", F.rint(F.col("ratio") / total * n).cast("int").alias("g")).filter("g > 0")
        lists = knn_lists(rows, rows, k).join(each, "sample_id")
        drawn = lists.select("sample_id", "nn", F.explode(F.sequence(F.lit(1), F.col("g"))).alias("i")).select(
            F.concat_ws(".", "sample_id", "i").alias("draw"), "sample_id", "nn",
            hash_uniform(F.col("sample_id"), F.col("i"), F.lit("nn"), F.lit(seed)).alias("share"),
            hash_uniform(F.col("sample_id"), F.col("i"), F.lit("gap"), F.lit(seed)).alias("gap"))
        out = out.unionByName(_typed(_synthesise(drawn, rows, "adasyn", c), df))
    return out


def _danger(foreign: Column, n: Column) -> Column:
    return (foreign >= n / 2) & (foreign < n)


def borderline_smote(df: DataFrame, seed: int = SEED, k: int = 5, m: int = 10) -> DataFrame:
    """SMOTE from the rows for which at least half, but not all, of the m neighbours are foreign."""
    out = df.select(*COLUMNS)
    for c, n in _targets(df):
        rows = df.filter(F.col("label") == c).select(*COLUMNS)
        edge = knn_lists(rows, df, m).filter(_danger(_foreign(c), F.size("nn"))).select(*COLUMNS)
        made = _from_seeds(df, knn_lists(edge, rows, k), rows, n, "border", c, seed)
        out = out.unionByName(_typed(made, df))
    return out


def margin_rows(df: DataFrame, positive, C: float = 1.0, gamma: float | str = "scale", landmarks: int = LANDMARKS, seed: int = SEED) -> DataFrame:
    """(sample_id) of class rows on or inside the margin of the kernel machine between ``positive`` and all other classes.

    The margin is that of the exact machine if every row is a landmark, and of its restriction to the landmarks' span beyond that.
    """
    n = df.count()
    mapped = kernel_map(df, "rbf", gamma, landmarks=landmarks, seed=seed)(df)
    ready = cut_lineage(mapped.select("sample_id", array_to_vector("features").alias("_v"), (F.col("label") == positive).cast("double").alias("_y")))
    model = LinearSVC(featuresCol="_v", labelCol="_y", maxIter=300, tol=1e-8, regParam=1.0 / (C * n), standardization=False).fit(ready)
    return (model.transform(ready.filter("_y = 1")).filter(F.get(vector_to_array("rawPrediction"), F.lit(1)) <= 1 + 1e-3)
            .select("sample_id"))


def svm_smote(df: DataFrame, seed: int = SEED, k: int = 5, m: int = 10, share: float = 0.5,
              out_step: float = 0.5) -> DataFrame:
    """Starts from the support vectors of a class: its rows inside the margin of an RBF kernel machine (``margin_rows``), without
    those that have only foreign neighbours.

    Where the neighbourhood is mostly foreign the point lies towards a neighbour, elsewhere it moves away from it.
    """
    out = df.select(*COLUMNS)
    for c, n in _targets(df):
        inside = margin_rows(df, c, seed=seed)
        rows = df.filter(F.col("label") == c).select(*COLUMNS)
        support = rows.join(inside, "sample_id", "left_semi")
        placed = cut_lineage(knn_lists(support, df, m).filter(_foreign(c) < F.size("nn"))
                             .withColumn("_edge", _danger(_foreign(c), F.size("nn"))).select(*COLUMNS, "_edge"))
        edge, safe = (placed.filter("_edge").drop("_edge"), placed.filter("not _edge").drop("_edge"))
        both = {r["_edge"]: r["count"] for r in placed.groupBy("_edge").count().collect()}
        n_edge = n if not both.get(False) else 0 if not both.get(True) else int(n * share)
        for side, count, tag, stretch in ((edge, n_edge, "svm-in", 1.0), (safe, n - n_edge, "svm-out", -out_step)):
            if count and both:
                made = _from_seeds(df, knn_lists(side, rows, k), rows, count, tag, c, seed, stretch)
                out = out.unionByName(_typed(made, df))
    return out


# ---- cleaning by neighbours -----------------------------------------------------------------------------------------

def _agrees(kind: str) -> Column:
    """Whether the neighbours confirm the label: all of them, or the most frequent class (ties to the smaller)."""
    label = F.col("label").cast("double")
    if kind == "all":
        return F.forall("nn", lambda x: x["label"] == label)
    own = F.size(F.filter("nn", lambda x: x["label"] == label))
    return F.forall("nn", lambda x: (x["label"] == label) | (
        F.size(F.filter("nn", lambda y: y["label"] == x["label"])) < own) | (
        (F.size(F.filter("nn", lambda y: y["label"] == x["label"])) == own) & (label < x["label"])))


def edited(df: DataFrame, seed: int = SEED, k: int = 3, classes: str = "not minority", kind: str = "all") -> DataFrame:
    """Drop rows whose k neighbours do not confirm their class; the smallest class is kept unless ``classes='all'``."""
    keep = _agrees(kind)
    if classes != "all":
        keep = keep | (F.col("label") == minority(class_sizes(df)))
    return knn_lists(df.select(*COLUMNS), df, k).filter(keep).select(*COLUMNS)


def _shrunk(before: dict, after: dict) -> bool:
    """A class vanished, or another class fell below the smallest one."""
    low = minority(before)
    return len(after) < len(before) or any(n < before[low] for c, n in after.items() if c != low)


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``row``, a text of their own that sorts as their id does (NULL last), and the length of the part of it that rows
    of the same id share."""
    rows = ranked(df.select(*COLUMNS), [F.col("sample_id").isNull(), F.col("sample_id").cast("string"), F.xxhash64("features", "label")])
    width = len(str(rows.count()))
    rows = rows.withColumn("row", F.lpad(F.col("rank").cast("string"), width, "0"))
    twice = (rows.groupBy(F.col("sample_id").alias("_id")).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    rows = rows.join(twice, F.col("sample_id").eqNullSafe(F.col("_id")), "left")
    return cut_lineage(rows.select(F.concat(F.coalesce("_first", "row"), "row").alias("row"), *COLUMNS)), width


def _judged(state: DataFrame, k: int, low, width: int) -> DataFrame:
    """``state`` with ``ok``, whether ``edited`` keeps the row, and ``open``, whether its list has become too short to say so."""
    near = F.filter(F.slice("list", 1, k + 1), lambda x: F.left(x["id"], F.lit(width)) != F.left("row", F.lit(width)))
    spared, agrees = F.col("label") == low, _agrees("all")
    open_ = F.col("more") & (F.size("list") <= k) & agrees & ~F.coalesce(spared, F.lit(False))
    return state.withColumn("nn", F.slice(near, 1, k)).withColumns(
        {"ok": F.coalesce(agrees | spared, F.lit(False)), "open": F.coalesce(open_, F.lit(False))}).drop("nn")


def _listed(rows: DataFrame, state: DataFrame, wanted: DataFrame, n_wanted: int, n: int) -> DataFrame:
    """The first ``n`` rows of ``state``, the row itself among them, for every row of ``wanted``; ``more``: there may be others."""
    right = rows.select(F.col("row").alias("sample_id"), "features", "label").join(state.select(F.col("row").alias("sample_id")), "sample_id", "left_semi")
    size, width = shape(right)
    few = n_wanted <= FEW and fits(n_wanted, width) and not fits(size, width)
    right = right if few else cut_lineage(right)
    left = right.join(wanted.select(F.col("row").alias("sample_id")), "sample_id", "left_semi")
    found = knn_lists(left, right, n, exclude_self=False, strategy="few" if few else "auto")
    return found.select(F.col("sample_id").alias("row"), "label", F.transform("nn", lambda x: F.struct(x["id"], x["label"])).cast(LIST).alias("list"),
                        (F.size("nn") >= n).alias("more"))


def _without(state: DataFrame, gone: DataFrame) -> DataFrame:
    """``state`` with the rows of ``gone`` taken out of the lists."""
    hit = (state.select("row", F.explode("list.id").alias("_id")).join(gone.select(F.col("row").alias("_id")), "_id", "left_semi")
           .groupBy("row").agg(F.collect_list("_id").alias("_hit")))
    left = F.when(F.col("_hit").isNull(), F.col("list")).otherwise(F.filter("list", lambda x: ~F.array_contains("_hit", x["id"])))
    return state.join(hit, "row", "left").withColumn("list", left).drop("_hit")


def repeated_edited(df: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    """``edited`` until nothing changes, or until the next round would lose a class or make another class the smallest.

    That round is not taken: the rows of the round before it are returned. Every round but the last drops a row.

    Distances do not change from round to round, so the rows are joined once with ``SPARE`` more neighbours than a round asks for: the
    neighbours of a round are the first of the list that are left. Only a row whose list runs out is joined again, with the rows left
    by then; a row of the smallest class has no list until another class is the smallest. Rows that repeat an id are judged one by
    one, and are no neighbours of each other.
    """
    rows, width = _numbered(df)
    start = sizes = class_sizes(rows)
    state = cut_lineage(rows.select("row", "label", F.array().cast(LIST).alias("list"), F.lit(True).alias("more")))
    columns = state.columns
    while True:
        judged = _judged(state, k, minority(sizes), width)
        found = judged.groupBy("label").agg(F.count_if("ok").alias("n"), F.count_if("open").alias("open")).collect()
        n_open = sum(r["open"] for r in found)
        if n_open:
            again = _listed(rows, state, judged.filter("open"), n_open, k + 1 + SPARE)
            state = cut_lineage(judged.filter("not open").select(*columns).unionByName(again))
            continue
        new = {r["label"]: r["n"] for r in found if r["n"]}
        if _shrunk(start, new) or new == sizes:
            return rows.join(state.select("row"), "row", "left_semi").select(*COLUMNS)
        gone = cut_lineage(judged.filter("not ok").select("row"))
        state = cut_lineage(_without(judged.filter("ok").select(*columns), gone))
        sizes = new


def all_knn(df: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    """``edited`` with 1, 2, ... k neighbours in turn; a round that would lose a class or make another class the smallest is
    not taken and ends the rounds."""
    out = cut_lineage(df.select(*COLUMNS))
    start = class_sizes(out)
    for i in range(1, k + 1):
        after = cut_lineage(edited(out, k=i))
        if _shrunk(start, class_sizes(after)):
            break
        out = after
    return out


def smote_edited(df: DataFrame, seed: int = SEED) -> DataFrame:
    """SMOTE, then ``edited`` over all classes."""
    return edited(cut_lineage(smote(df, seed)), classes="all")


def tomek(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Drop the larger-class member of every mutual nearest pair of different classes."""
    low = minority(class_sizes(df))
    nearest = cut_lineage(knn_lists(df.select(*COLUMNS), df, 1).select(
        "sample_id", "label", F.get("nn", F.lit(0))["id"].alias("other"),
        F.get("nn", F.lit(0))["label"].alias("other_label")).filter(F.col("label") != F.col("other_label")))
    back = nearest.select(F.col("other").alias("sample_id"), F.col("sample_id").alias("other"))
    links = nearest.join(back, ["sample_id", "other"], "left_semi").filter(F.col("label") != low).select("sample_id")
    return df.select(*COLUMNS).join(links, "sample_id", "left_anti")


def _misjudged(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose nearest stored row has another class."""
    return knn_lists(rows.select(*COLUMNS), store, 1, exclude_self=False).filter(
        F.get("nn", F.lit(0))["label"] != F.col("label")).select(*COLUMNS)


def _first_store(df: DataFrame, seed: int):
    """All rows of the smallest class and one drawn row of each other class; and the rows left over."""
    low = minority(class_sizes(df))
    pick = (df.filter(F.col("label") != low).groupBy("label")
            .agg(F.min(F.struct(_draw("store", seed), F.col("sample_id").alias("sample_id"))).alias("p"))
            .select(F.col("p.sample_id").alias("sample_id")))
    flagged = df.select(*COLUMNS).join(pick.withColumn("_first", F.lit(True)), "sample_id", "left")
    flagged = cut_lineage(flagged.withColumn("stored", (F.col("label") == low) | F.coalesce("_first", F.lit(False)))
                          .drop("_first"))
    return flagged


def condensed(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Grow a store until its nearest row judges every left-over row right.

    Each round adds a drawn half of the misjudged rows at once instead of one row after the other, and at least one, so the
    rounds end. Every left-over row carries its nearest stored row so far; a round compares it with the rows added in that
    round only, so all rounds together compare each row with each stored row once.
    """
    state = _first_store(df, seed)

    def nearest(rows, store):
        found = knn_lists(rows, store, 1, exclude_self=False)
        best = F.get("nn", F.lit(0))
        return found.withColumn("_found", F.struct(best["dist"].alias("dist"), best["id"].alias("id"), best["label"].alias("label"))).drop("nn")
    stored = state.filter("stored").select(*COLUMNS)
    left = cut_lineage(nearest(state.filter("not stored").select(*COLUMNS), stored).withColumnRenamed("_found", "_best"))
    for i in itertools.count():
        wrong = cut_lineage(left.filter(F.col("_best.label") != F.col("label")).select("sample_id", _draw(f"add{i}", seed).alias("u")))
        low = wrong.agg(F.min("u")).first()[0]
        if low is None:
            break
        chosen = wrong.filter((F.col("u") < 0.5) | (F.col("u") <= low)).select("sample_id")
        added = cut_lineage(left.join(chosen, "sample_id", "left_semi").select(*COLUMNS))
        rest = left.join(chosen, "sample_id", "left_anti")
        left = cut_lineage(nearest(rest, added).withColumn("_best", F.least("_best", "_found")).drop("_found"))
    return df.select(*COLUMNS).join(left.select("sample_id"), "sample_id", "left_anti")


def one_sided(df: DataFrame, seed: int = SEED) -> DataFrame:
    """One pass of the store rule from a single drawn row, then ``tomek``."""
    state = _first_store(df, seed)
    wrong = _misjudged(state.filter("not stored"), state.filter("stored"))
    return tomek(cut_lineage(state.filter("stored").select(*COLUMNS).unionByName(wrong)))


def neighbourhood_cleaning(df: DataFrame, seed: int = SEED, k: int = 3, share: float = 0.5) -> DataFrame:
    """Drop larger-class rows that a majority of k neighbours contradicts, and the larger-class neighbours of
    contradicted rows of the smallest class (for classes above ``share`` of its size)."""
    sizes = class_sizes(df)
    low = minority(sizes)
    large = [float(c) for c, n in sizes.items() if c != low and n > share * sizes[low]]
    judged = cut_lineage(knn_lists(df.select(*COLUMNS), df, k).withColumn("_ok", _agrees("mode"))
                         .select("sample_id", "label", "_ok", "nn"))
    wrong = judged.filter(~F.col("_ok"))
    noisy = wrong.filter(F.col("label") != low).select("sample_id")
    around = (wrong.filter(F.col("label") == low).select(F.explode("nn").alias("n"))
              .filter(F.col("n.label").isin(large)).select(F.col("n.id").alias("sample_id")))
    gone = noisy.unionByName(around).distinct()
    return df.select(*COLUMNS).join(gone, "sample_id", "left_anti")


def near_miss(df: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    """Keep of every larger class the rows with the smallest mean distance to their k nearest smallest-class rows."""
    sizes = class_sizes(df)
    low = minority(sizes)
    small = df.filter(F.col("label") == low).select(*COLUMNS)
    out = small
    for c in sizes:
        if c == low:
            continue
        near = knn_lists(df.filter(F.col("label") == c).select(*COLUMNS), small, k, exclude_self=False)
        mean = F.aggregate("nn", F.lit(0.0), lambda a, x: a + x["dist"]) / F.size("nn")
        kept = smallest(near.select("sample_id", mean.alias("_mean")), ["_mean", "sample_id"], sizes[low])
        out = out.unionByName(df.select(*COLUMNS).join(kept, "sample_id", "left_semi"))
    return out


def instance_hardness(df: DataFrame, seed: int = SEED, folds: int = 5, trees: int = 100) -> DataFrame:
    """Keep of every larger class the rows whose held-out forest probability reaches the quantile that leaves the size
    of the smallest class."""
    sizes = class_sizes(df)
    low, codes = minority(sizes), sorted(sizes)
    code = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("label")) - 1
    ready = df.select(*COLUMNS).withColumns({
        "_v": array_to_vector("features"), "_y": code.cast("double"),
        "_fold": F.floor(_draw("fold", seed) * folds).cast("int")})
    scored = None
    for i in range(folds):
        model = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(
            ready.filter(F.col("_fold") != i))
        part = model.transform(ready.filter(F.col("_fold") == i)).select(
            "sample_id", "label", F.get(vector_to_array("probability"), F.col("_y").cast("int")).alias("_p"))
        scored = part if scored is None else scored.unionByName(part)
    scored = cut_lineage(scored)
    keep = F.col("label") == low
    for c, n in sizes.items():
        if c != low:
            rows = scored.filter(F.col("label") == c)
            keep = keep | ((F.col("label") == c) & (F.col("_p") >= quantile(rows, "_p", 1 - sizes[low] / n, n)))
    return df.select(*COLUMNS).join(scored.filter(keep), "sample_id", "left_semi")


def _centroids(rows: DataFrame, k: int, seed: int, moved: float) -> DataFrame:
    """Lloyd rounds with the centres kept as a table: assign by neighbour join, average per position, until no centre moves
    by more than ``moved``.

    The first centres are the rows with the lowest draws. A centre without rows (a copy of another one) stays where it is.
    The sum of squares falls in every round that moves a centre, so the rounds end.
    """
    centres = cut_lineage(smallest(rows.select("sample_id", "features"), [_draw("centre", seed), "sample_id"], k))
    while True:
        near = knn_lists(rows.select("sample_id", "features"), centres, 1, exclude_self=False)
        # One vector per task and centre crosses the shuffle.
        mean = (near.select(F.get("nn", F.lit(0))["id"].alias("sample_id"), array_to_vector("features").alias("_v"))
                .groupBy("sample_id").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mean")))
        step = F.aggregate(F.zip_with("features", "_mean", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: F.greatest(a, v))
        new = cut_lineage(centres.join(mean, "sample_id", "left")
                          .withColumn("_step", F.coalesce(step, F.lit(0.0)))
                          .select("sample_id", F.coalesce("_mean", "features").alias("features"), "_step"))
        centres = new.drop("_step")
        if new.filter(F.col("_step") > moved).isEmpty():
            return centres


def cluster_centroids(df: DataFrame, seed: int = SEED, moved: float = 1e-9) -> DataFrame:
    """Replace every larger class by as many k-means centres as the smallest class has rows.

    One algorithm at every size: the centres are a distributed table. Centres are numbered in the order of the rows they
    started from.
    """
    sizes = class_sizes(df)
    low = minority(sizes)
    out = df.filter(F.col("label") == low).select(*COLUMNS)
    for c in sizes:
        if c == low:
            continue
        centres = _centroids(df.filter(F.col("label") == c).select(*COLUMNS), sizes[low], seed, moved)
        out = out.unionByName(_typed(centres.select(F.concat(F.lit(f"centre:{c}:"), "sample_id").alias("sample_id"),
                                                    "features", F.lit(c).alias("label")), df))
    return out


METHODS = {method.__name__: method for method in (
    adasyn, all_knn, borderline_smote, cluster_centroids, condensed, edited, instance_hardness, near_miss,
    neighbourhood_cleaning, none, one_sided, random_over, random_under, repeated_edited, smote, smote_edited, svm_smote, tomek)}


def resample(train: DataFrame, method: str, seed: int = SEED, **params) -> DataFrame:
    """Rebalanced training rows by one of ``METHODS``."""
    return METHODS[method](train, seed=seed, **params)
