"""The feed moves only vectors that it can score, and no score that a user's threshold rules out."""

import pytest

from newsgraph.operators.curate import _depth0_reads, nearest_articles
from newsgraph.operators.vectors import best_in_groups


def test_vectors_of_articles_in_no_list_are_not_placed(spark):
    served = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "user_id long, seed string")
    ae = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "c"), ("z", "d")], "article_id string, node string")
    av = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0, 1.0]), ("w", [0.5, 1.0])], "article_id string, vec array<float>")
    uv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "user_id long, vec array<float>")
    _, lists, placed, users = _depth0_reads(served, ae, uv, av, 2)
    assert sorted(r["iid"] for r in placed.collect()) == ["x", "y"]
    assert sorted(tuple(r) for r in lists.select("node", "iid").collect()) == [("a", "x"), ("b", "y")]
    assert dict(users.dtypes)["uvec"] == "array<float>"
    best, _ = nearest_articles(served, ae, uv, av, 2)
    assert sorted((r["user_id"], r["article_id"], r["relevance_score"]) for r in best.collect()) == [(1, "x", 1.0), (2, "x", 0.7), (2, "y", 1.0)]


def test_scores_below_the_threshold_are_left_out(spark):
    asked = spark.createDataFrame([("g", 1, [1.0, 0.0], 0.5), ("g", 2, [1.0, 0.0], None)], "cell string, qid long, vec array<double>, tau double")
    members = spark.createDataFrame([("g", "a", [1.0, 0.0]), ("g", "b", [1.0, 1.0]), ("g", "c", [0.0, 1.0])], "cell string, iid string, vec array<double>")
    got = sorted((r["qid"], r["iid"], r["score"]) for r in best_in_groups(asked, members, 3).collect())
    assert [x[:2] for x in got] == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")]
    assert [x[2] for x in got] == pytest.approx([1.0, 0.707107, 1.0, 0.707107, 0.0])
