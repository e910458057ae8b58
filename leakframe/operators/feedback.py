"""Review feedback: validation, counts, and false-positive shapes learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import classify, masks, text
from leakframe.operators.patterns import like_join
from leakframe.operators.ranking import first_n, prefix_sum
from leakframe.operators.suppress import review_hints
from leakframe.session import BROADCAST_BYTES, cut_lineage, measured


def _is_fp() -> Column:
    return F.col("is_true_positive") == F.lit(False)


def _percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part * 100.0 / whole, digits)


def anonymise(reviews: DataFrame) -> DataFrame:
    """Reviewed secrets without their values: hash, length, shape, extension, file class, hint.

    Needs value_hash, value, secret_type, severity, path (first file), is_true_positive."""
    path = F.coalesce(F.col("path"), F.lit(""))
    hint = F.nullif(review_hints(F.col("value"), F.lower(path)), F.lit(""))
    return reviews.select(
        *[c for c in ("submission_id", "received_at") if c in reviews.columns],
        "value_hash", "secret_type", "severity",
        F.length("value").alias("value_length"),
        masks.shape(F.col("value")).alias("value_pattern"),
        text.suffix(path).alias("file_extension"),
        F.when(path == "", F.lit("unknown")).otherwise(classify.file_class(path)).alias("file_type"),
        hint.alias("context_hint"),
        "is_true_positive",
    )


def review_summary(items: DataFrame) -> DataFrame:
    """One row: detected, confirmed, false positives and their share."""
    fp = F.count_if(_is_fp())
    total = F.count(F.lit(1))
    return items.agg(
        total.alias("total_detected"),
        F.count_if("is_true_positive").alias("confirmed_secrets"),
        fp.alias("false_positives"),
        F.coalesce(_percent(fp, F.nullif(total, F.lit(0))), F.lit(0.0)).alias("false_positive_rate"),
    )


def check_submissions(submissions: DataFrame, now: Column) -> DataFrame:
    """Add ``reject_reason`` (NULL is valid) to submissions of schemas.FEEDBACK_SUBMISSION."""
    summary = F.col("summary")
    items = F.concat(
        F.coalesce("confirmed_secrets", F.array().cast(submissions.schema["confirmed_secrets"].dataType)),
        F.coalesce("false_positives", F.array().cast(submissions.schema["false_positives"].dataType)),
    )
    bad = lambda c: c.isNull() | (c < 0) | (c > 10000)
    when = F.try_to_timestamp(F.col("timestamp"))
    hour = F.expr("INTERVAL 1 HOUR")
    reason = text.first_hit(
        [
            (when.isNull(), F.lit("Invalid timestamp format")),
            (when > now + hour, F.lit("Timestamp in the future")),
            (when < now - hour, F.lit("Timestamp too old")),
            (
                (F.size("confirmed_secrets") > 1000) | (F.size("false_positives") > 1000),
                F.lit("Too many items in list"),
            ),
            (
                F.exists(items, lambda i: i.value_hash.isNull() | (F.length(i.value_hash) < 8)),
                F.lit("Invalid value_hash"),
            ),
            (F.exists(items, lambda i: bad(i.value_length)), F.lit("Invalid value_length")),
            (
                bad(summary["total_detected"]) | bad(summary["confirmed_secrets"]) | bad(summary["false_positives"]),
                F.lit("Invalid count"),
            ),
            (
                summary["total_detected"] != F.size(items),
                F.lit("Data inconsistency: total_detected doesn't match items"),
            ),
        ]
    )
    return submissions.withColumn("reject_reason", reason)


def check_items(items: DataFrame) -> DataFrame:
    """Item rules alone, for feedback that is already one row per item."""
    n = F.col("value_length")
    reason = text.first_hit(
        [
            (F.col("value_hash").isNull() | (F.length("value_hash") < 8), F.lit("Invalid value_hash")),
            (n.isNull() | (n < 0) | (n > 10000), F.lit("Invalid value_length")),
        ]
    )
    return items.withColumn("reject_reason", reason)


def explode_items(submissions: DataFrame) -> DataFrame:
    """Submissions to one row per reviewed item; a missing list is an empty one."""

    def tag(name: str, verdict: bool) -> Column:
        listed = F.coalesce(name, F.array().cast(submissions.schema[name].dataType))
        return F.transform(listed, lambda i: F.struct(F.lit(verdict).alias("is_true_positive"), i.alias("i")))

    tagged = F.concat(tag("confirmed_secrets", True), tag("false_positives", False))
    keys = [c for c in ("submission_id", "client_id", "received_at") if c in submissions.columns]
    return submissions.select(*keys, F.explode(tagged).alias("t")).select(*keys, "t.is_true_positive", "t.i.*")


# ------------------------------------------------------------------ folds
REVIEWS = "reviews"  # in folded tables: how many reviews a row stands for


def fold_shapes(reviews: DataFrame) -> DataFrame:
    """``value_pattern``, ``is_true_positive``, ``reviews``.

    Equal values are counted before the shape is made, so a value that is reviewed a million times
    is shaped once, and a hot value is combined in the map tasks."""
    values = reviews.groupBy("value", "is_true_positive").agg(F.count(F.lit(1)).alias(REVIEWS))
    shaped = values.select(masks.shape(F.col("value")).alias("value_pattern"), "is_true_positive", REVIEWS)
    return shaped.groupBy("value_pattern", "is_true_positive").agg(F.sum(REVIEWS).alias(REVIEWS))


def fold_hints(reviews: DataFrame) -> DataFrame:
    """``context_hint``, ``is_true_positive``, ``reviews``.  Of a path only two words matter."""
    low = F.lower(F.coalesce(F.col("path"), F.lit("")))
    said = F.concat_ws(" ", *[F.when(low.contains(word), F.lit(word)) for word in ("certificate", "pin")])
    values = reviews.groupBy("value", said.alias("said"), "is_true_positive").agg(F.count(F.lit(1)).alias(REVIEWS))
    hint = F.nullif(review_hints(F.col("value"), F.col("said")), F.lit(""))
    return values.select(hint.alias("context_hint"), "is_true_positive", REVIEWS).groupBy("context_hint", "is_true_positive").agg(F.sum(REVIEWS).alias(REVIEWS))


def fold_dimensions(reviews: DataFrame) -> DataFrame:
    """``dimension`` (value_pattern, file_type, secret_type), ``verdict``, ``name``, ``n``.

    One pass counts equal values, paths and types; only what is distinct is shaped and classified."""
    raw = {"value_pattern": "value", "file_type": "path", "secret_type": "secret_type"}
    flat = reviews.select(*raw.values(), _verdict().alias("verdict"))
    counted = flat.groupingSets([[c, "verdict"] for c in raw.values()], *raw.values(), "verdict").agg(
        *[F.grouping(c).alias(f"_{c}") for c in raw.values()], F.count(F.lit(1)).alias("n")
    )
    path = F.coalesce(F.col("path"), F.lit(""))
    named = {
        "value_pattern": masks.shape(F.col("value")),
        "file_type": F.when(path == "", F.lit("unknown")).otherwise(classify.file_class(path)),
        "secret_type": F.col("secret_type"),
    }
    own = lambda d: F.col(f"_{raw[d]}") == 0
    dimension = F.coalesce(*[F.when(own(d), F.lit(d)) for d in raw])
    name = F.coalesce(*[F.when(own(d), named[d]) for d in raw], F.lit("unknown"))
    return counted.select(dimension.alias("dimension"), "verdict", name.alias("name"), "n").groupBy("dimension", "verdict", "name").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ rates
# Counts below take single reviews or folded ones, which have a column ``reviews``.
def _n(items: DataFrame) -> Column:
    return F.sum(REVIEWS) if REVIEWS in items.columns else F.count(F.lit(1))


def _n_fp(items: DataFrame) -> Column:
    return F.coalesce(F.sum(F.when(_is_fp(), F.col(REVIEWS))), F.lit(0)) if REVIEWS in items.columns else F.count_if(_is_fp())


def _verdict() -> Column:
    return F.when(_is_fp(), F.lit("false_positives")).otherwise(F.lit("true_positives"))


def totals(items: DataFrame) -> DataFrame:
    fp, n = _n_fp(items), _n(items)
    return items.agg(n.alias("total_items"), fp.alias("false_positives"), _percent(fp, F.nullif(n, F.lit(0))).alias("fp_rate_percent"))


def dimension_counts(items: DataFrame, n: int = 20) -> DataFrame:
    """Counts by shape, file type and secret type split by verdict, the top n of each.

    One pass over three grouping sets; ranking limits groups before the shuffle."""
    dims = ["value_pattern", "file_type", "secret_type"]
    flat = items.select(*[F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in dims], _verdict().alias("verdict"))
    counted = flat.groupingSets([[d, "verdict"] for d in dims], *dims, "verdict").agg(
        *[F.grouping(d).alias(f"_{d}") for d in dims], F.count(F.lit(1)).alias("n")
    )
    dimension = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims])
    name = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dims])
    return top_names(counted.select(dimension.alias("dimension"), "verdict", name.alias("name"), "n"), n)


def top_names(counts: DataFrame, n: int = 20) -> DataFrame:
    return first_n(counts, ["dimension", "verdict"], [F.desc("n"), "name"], n)


def known_false_positives(items: DataFrame, min_samples: int = 10, above: float = 0.8) -> DataFrame:
    """Shapes that reviewers reject: enough samples and a rate strictly above the cut."""
    shape = F.coalesce("value_pattern", F.lit("unknown"))
    return (
        items.groupBy(shape.alias("pattern"))
        .agg(_n(items).alias("sample_count"), _n_fp(items).alias("_fp"))
        .where((F.col("sample_count") >= min_samples) & (F.col("_fp") / F.col("sample_count") > above))
        .select(
            "pattern",
            F.round(F.col("_fp") / F.col("sample_count"), 2).alias("confidence"),
            "sample_count",
            F.lit(fv.KNOWN_FP_REASON).alias("reason"),
        )
    )


def _rate_by(items: DataFrame, key: str, total: str = "total") -> DataFrame:
    fp, n = _n_fp(items), _n(items)
    return items.groupBy(key).agg(
        n.alias(total), fp.alias("false_positives"), _percent(fp, n).alias("fp_rate")
    )


def top_shapes(items: DataFrame, min_uses: int = 5, n: int = 10) -> DataFrame:
    return (
        _rate_by(items, "value_pattern", "occurrences")
        .where(F.col("occurrences") >= min_uses)
        .orderBy(F.desc("fp_rate"), F.desc("occurrences"), "value_pattern")
        .limit(n)
    )


def rate_by_file_type(items: DataFrame) -> DataFrame:
    return _rate_by(items, "file_type").drop("false_positives")


def rate_by_hint(items: DataFrame) -> DataFrame:
    return _rate_by(items.where(F.col("context_hint").isNotNull()), "context_hint").drop("false_positives")


def new_shapes(items: DataFrame, known: DataFrame, min_uses: int = 3) -> DataFrame:
    """False-positive shapes that are not known yet.  Shapes are counted before the anti join,
    so the join sees one row per shape."""
    counted = (
        items.where(_is_fp())
        .groupBy("value_pattern")
        .agg(_n(items).alias("occurrences"))
        .where(F.col("occurrences") >= min_uses)
    )
    return counted.join(known.select(F.col("pattern").alias("value_pattern")), "value_pattern", "left_anti")


def known_effectiveness(items: DataFrame, known: DataFrame) -> DataFrame:
    """Expected and actual false-positive rate of each known LIKE pattern.

    Items are counted per shape first.  Patterns without wildcards join on equality, the others
    through an index of their literal pieces (see ``patterns``).
    """
    shapes = cut_lineage(items.groupBy("value_pattern").agg(_n(items).alias("n"), _n_fp(items).alias("fp")))
    wild = F.rlike("pattern", F.lit(r"[%_\\]"))
    known = known.select("pattern", "confidence")
    exact = shapes.join(known.where(~wild), F.col("value_pattern") == F.col("pattern"))
    like = like_join(shapes, "value_pattern", known.where(wild), "pattern")
    return (
        exact.unionByName(like)
        .groupBy("pattern", F.col("confidence").alias("expected_fp_rate"))
        .agg(F.sum("n").alias("sample_size"), F.sum("fp").alias("_fp"))
        .select(
            "pattern", "expected_fp_rate",
            _percent(F.col("_fp"), F.col("sample_size")).alias("actual_fp_rate"), "sample_size",
        )
    )


def filter_known(detections: DataFrame, known: DataFrame, defaults: list = fv.DEFAULT_KNOWN_FP) -> DataFrame:
    """Mark detections that a known pattern covers: by equal shape, or by a literal default
    inside the value."""
    learned = known.select(F.col("pattern").alias("value_pattern"), F.col("confidence").alias("_conf"))
    literal = text.first_hit(
        (F.col("value").contains(p) | (F.col("value_pattern") == p), F.lit(c)) for p, c, _ in defaults
    )
    return (
        detections.join(learned, "value_pattern", "left")
        .withColumn("known_confidence", F.greatest("_conf", literal))
        .drop("_conf")
    )


def label_balance(items: DataFrame) -> DataFrame:
    """Share of each label.  Counts come first, the window runs over two rows."""
    counted = items.groupBy("is_true_positive").agg(_n(items).alias("n"))
    share = _percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1))))
    return counted.select("is_true_positive", "n", share.alias("percentage"))


def feature_availability(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("value_pattern").alias("has_pattern"),
        F.count("file_type").alias("has_file_type"),
        F.count("context_hint").alias("has_context"),
    )


def daily_trend(submissions: DataFrame, now: Column | None = None, days: int = 30) -> DataFrame:
    """Per day: submissions, false positives and mean rate, over the last days if ``now`` is given."""
    recent = submissions
    if now is not None:
        recent = recent.where(F.col("received_at") > now - F.make_dt_interval(F.lit(days)))
    rate = F.col("false_positives").cast("double") / F.nullif(F.col("total_detected"), F.lit(0))
    return recent.groupBy(F.to_date("received_at").alias("day")).agg(
        F.count(F.lit(1)).alias("submissions"),
        F.sum("false_positives").alias("total_fp"),
        F.round(F.avg(rate) * 100, 2).alias("avg_fp_rate"),
    )


def weekly_alerts(items: DataFrame, jump: float = 10.0) -> DataFrame:
    """Weeks whose false-positive rate rose by more than ``jump`` points over the week before."""
    fp, n = F.count_if(_is_fp()), F.count(F.lit(1))
    weekly = items.groupBy(F.date_trunc("week", "received_at").alias("week")).agg(
        n.alias("total"), (fp * 100.0 / n).alias("_rate")
    )
    # one row per week, so this window is small whatever the input
    before = F.lag("_rate").over(Window.partitionBy(F.lit(1)).orderBy("week"))
    return weekly.withColumn("_rise", F.col("_rate") - before).select(
        "week", "total", F.round("_rate", 2).alias("fp_rate"), F.round("_rise", 2).alias("rise"),
        F.coalesce(F.col("_rise") > jump, F.lit(False)).alias("alert"),
    )


def shape_alerts(items: DataFrame, known: DataFrame, min_samples: int = 20, above: float = 90.0) -> DataFrame:
    """Unknown shapes with many samples that are almost always rejected."""
    rates = _rate_by(items, "value_pattern", "samples").where(
        (F.col("samples") > min_samples) & (F.col("false_positives") * 100.0 / F.col("samples") > above)
    )
    return rates.join(known.select(F.col("pattern").alias("value_pattern")), "value_pattern", "left_anti")


def requests_last_hour(requests: DataFrame) -> DataFrame:
    """Requests of the client in the hour up to and including each request.

    A range window would sort all requests of a client in one task.  Here each request is three
    marks on the time line of its client: it enters, it asks, and an hour later it leaves.  The
    answer is a running total over the marks, which is summed range by range (see ``ranking``),
    so one client may hold any share of the requests.
    """
    at = F.unix_micros("ts")
    row = F.struct(*requests.columns)
    mark = lambda when, phase, add, own: F.struct(
        when.alias("_at"), F.lit(phase).alias("_phase"), F.lit(add).cast("bigint").alias("_add"), own.alias("_row")
    )
    none = F.when(F.lit(False), row)
    marks = requests.select("client_id", F.inline(F.array(mark(at, 0, 1, none), mark(at, 1, 0, row), mark(at + 3_600_000_000, 2, -1, none))))
    summed = prefix_sum(marks, ["client_id"], ["_at", "_phase"], F.col("_add"), "_n")
    return summed.where(F.col("_phase") == 1).select("_row.*", F.col("_n").alias("requests_last_hour"))


HASHED = 64  # columns for the categories of shape class, secret type and file type
FEATURES = ["shape_class", "kind", "file_type", "value_length", "is_test_file"]


def classifier_features(items: DataFrame) -> DataFrame:
    shape_class = F.regexp_extract("value_pattern", r"\[(\w+):", 1)
    own = [c for c in items.columns if c not in ("kind", "label", "shape_class", "is_test_file")]
    return items.select(
        *own,
        shape_class.alias("shape_class"),
        F.col("secret_type").alias("kind"),
        F.col("file_type").contains("test").cast("double").alias("is_test_file"),
        F.col("is_true_positive").cast("double").alias("label"),
    )


def held_out(value_hash: Column, part: int = 5) -> Column:
    """One ``part`` of the values, by their hash: all reviews of a value are on one side."""
    return F.conv(F.substring(value_hash, 1, 2), 16, 10).cast("int") % part == 0


def fold_features(reviews: DataFrame) -> DataFrame:
    """``held_out``, the ``FEATURES``, ``label`` and ``reviews``.

    Values are counted with their type, file class and verdict before any is shaped, so that a task folds
    what it reads; by path, of which each value has many, nothing would fold.  Paths are classified once
    each, unless they are too many to be sent around.  Then values with equal features are one row,
    however many reviews there are."""
    path = F.coalesce(F.col("path"), F.lit(""))
    file_type = F.when(path == "", F.lit("unknown")).otherwise(classify.file_class(path))
    classes, size = measured(reviews.select("path").distinct().select(F.col("path").alias("_path"), file_type.alias("_class")))
    if size <= BROADCAST_BYTES:
        reviews = reviews.join(F.broadcast(classes), F.col("path").eqNullSafe(F.col("_path")))
        file_type = F.col("_class")
    values = reviews.groupBy("value", "value_hash", "secret_type", file_type.alias("file_type"), "is_true_positive").agg(F.count(F.lit(1)).alias(REVIEWS))
    rows = values.withColumn("value_length", F.length("value")).withColumn("value_pattern", masks.shape(F.col("value")))
    rows = classifier_features(rows.withColumn("held_out", held_out(F.col("value_hash"))))
    return rows.groupBy("held_out", *FEATURES, "label").agg(F.sum(REVIEWS).alias(REVIEWS))


def fp_classifier(items: DataFrame, trees: int = 100, seed: int = 7):
    """Random forest on shape class, length, secret type, file type and test-file flag.  Takes
    anonymised items or a folded feature table.  Returns a fitted pipeline model, which scores
    rows of ``classifier_features`` or ``fold_features``.

    Categories are hashed into a fixed number of columns, so any number of them will do.  Items
    with equal features are fitted as one weighted row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import FeatureHasher, VectorAssembler

    rows = items if "label" in items.columns else classifier_features(items)
    data = rows.groupBy(*FEATURES, "label").agg(_n(rows).cast("double").alias("weight"))
    hasher = FeatureHasher(inputCols=["shape_class", "kind", "file_type"], outputCol="hashed", numFeatures=HASHED)
    assembler = VectorAssembler(inputCols=["value_length", "is_test_file", "hashed"], outputCol="features")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed
    )
    return Pipeline(stages=[hasher, assembler, forest]).fit(data)


def chance_of_rejection(model, features: DataFrame) -> DataFrame:
    """``features`` with ``false_positive_chance``; the model's label 0 is a false positive."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features)
    return scored.select(*features.columns, F.round(vector_to_array("probability")[0], 6).alias("false_positive_chance"))


def confusion(scored: DataFrame) -> DataFrame:
    """One row for each chance that occurs, from the highest: what a threshold there would reject.
    ``caught`` false positives, ``lost`` secrets, ``precision``, ``recall``."""
    weighted = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col(REVIEWS))), F.lit(0))
    steps = scored.groupBy("false_positive_chance").agg(weighted(0.0).alias("_caught"), weighted(1.0).alias("_lost"))
    # as many rows as the forest has different answers for distinct features
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("false_positive_chance")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    counted = steps.select(
        "false_positive_chance", F.sum("_caught").over(above).alias("caught"), F.sum("_lost").over(above).alias("lost"), F.sum("_caught").over(every).alias("_all")
    )
    return counted.select(
        F.col("false_positive_chance").alias("threshold"), "caught", "lost",
        (F.col("caught") / F.nullif(F.col("caught") + F.col("lost"), F.lit(0))).alias("precision"),
        (F.col("caught") / F.nullif(F.col("_all"), F.lit(0))).alias("recall"),
    )


def choose_threshold(scored: DataFrame, min_precision: float = 0.9) -> float | None:
    """The lowest chance at which rejections of the training part are precise enough; None if none is."""
    return confusion(scored).where(F.col("precision") >= min_precision).agg(F.min("threshold")).first()[0]


def evaluate(features: DataFrame, trees: int = 100, min_precision: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Fit on the rows that are not held out, choose the threshold on them, and judge all.

    Returns the judged features (``false_positive_chance``, ``rejected``) and, for both parts, the
    confusion counts.  Without a precise threshold nothing is rejected."""
    rows = cut_lineage(features)
    scored = cut_lineage(chance_of_rejection(fp_classifier(rows.where(~F.col("held_out")), trees), rows))
    threshold = choose_threshold(scored.where(~F.col("held_out")), min_precision)
    rejected = F.lit(False) if threshold is None else F.col("false_positive_chance") >= threshold
    judged = scored.withColumn("rejected", rejected)
    part = lambda fp, out: F.coalesce(F.sum(F.when((F.col("label") == (0.0 if fp else 1.0)) & (F.col("rejected") == F.lit(out)), F.col(REVIEWS))), F.lit(0))
    counts = judged.groupBy("held_out").agg(
        part(True, True).alias("caught"), part(True, False).alias("missed"), part(False, True).alias("lost"), part(False, False).alias("kept")
    )
    return judged, counts.withColumn("precision", F.round(F.col("caught") / F.nullif(F.col("caught") + F.col("lost"), F.lit(0)), 4)).withColumn(
        "recall", F.round(F.col("caught") / F.nullif(F.col("caught") + F.col("missed"), F.lit(0)), 4)
    )
