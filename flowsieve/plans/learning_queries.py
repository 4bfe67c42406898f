"""Registered queries of labelling fallbacks, streams, learning and exploration."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest as RF
from ..operators import learning as L
from ..operators import matching as M
from ..streaming.labelling import replay_labels
from . import standins as S
from .exploration import explore

F8_FEATURES = ["q", "p", "d", "t"]


def q_label_stream(spark, sf_dir):
    """F2 flows and labels as two streams, 24 h tolerance (oracle: the batch match, any key class, forward)."""
    return replay_labels(spark, S.f2_flows(spark, sf_dir), S.f2_labels(spark, sf_dir), S.F2_TOLERANCE_MS)


def q_label_majority(spark, sf_dir):
    """Flows the one-minute match left unlabelled get the label of more than 70 % of their key's label rows."""
    flows, labels = S.f9_flows(spark, sf_dir), S.f9_labels(spark, sf_dir)
    matched = M.match_flows(flows, labels, 60_000, directions="forward")
    return M.label_majority(matched, labels, 0.7).select("flow_id", "label", "match_pass")


def q_train_test_split(spark, sf_dir):
    """Part of every row; a conversation is never in both parts."""
    return L.train_test_split(S.f8_classes(spark, sf_dir), 0.2).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flow_key", "label", "part")


def q_classification_metrics(spark, sf_dir):
    """Scores of a rule that never predicts one class and predicts one that does not exist."""
    return L.classification_metrics(S.f8_predicted(spark, sf_dir))


def q_feature_vectors(spark, sf_dir):
    """Vectors fitted on complete columns, applied where a column has nulls; unpacked to entries."""
    fitted = L.fit_vectors(S.f8_classes(spark, sf_dir), F8_FEATURES)
    holes = S.f8_classes(spark, sf_dir).withColumn("p", F.when(F.col("l_linenumber") != 3, F.col("p")))
    v = L.to_vectors(holes, fitted)
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.arrays_zip(
        F.col("features.indices").alias("i"), F.col("features.values").alias("v"))).alias("e")).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("e.i").alias("position"), F.round("e.v", 6).alias("value"))


def _parts(spark, sf_dir, columns=None):
    """Train and test part, of ``columns`` only if given."""
    split = L.train_test_split(S.f8_classes(spark, sf_dir), 0.2)
    split = L.materialize(split.select(*columns, "part") if columns else split, "learning-split")
    return split.where("part = 'train'"), split.where("part = 'test'")


def q_forest_scores(spark, sf_dir):
    """A random forest fitted on the train part, scored on the test part."""
    train, test = _parts(spark, sf_dir)
    model = RF.fit_forest(train, F8_FEATURES, trees=8, depth=5, per_node=3)
    return L.classification_metrics(RF.predict_forest(test, model))


def q_linear_svm_scores(spark, sf_dir):
    """One-vs-rest linear classifiers fitted on the train part, scored on the test part."""
    train, test = _parts(spark, sf_dir, [*F8_FEATURES, "label"])
    model, _ = L.fit_linear_svm(train, F8_FEATURES)
    return L.classification_metrics(L.predict_linear(test, model))


def q_explore(spark, sf_dir):
    """The exploration of the lineitem features as one run."""
    return explore(S.f5_features(spark, sf_dir))


QUERIES = {
    "label_stream": q_label_stream,
    "label_majority": q_label_majority,
    "train_test_split": q_train_test_split,
    "classification_metrics": q_classification_metrics,
    "feature_vectors": q_feature_vectors,
    "forest_scores": q_forest_scores,
    "linear_svm_scores": q_linear_svm_scores,
    "explore": q_explore,
}
