"""A task's models are fitted at the same time, from one written training part, and score the test part once each."""

from threading import Barrier

from pyspark.sql import functions as F

from ledgerlark.operators import ml as M


def test_models_of_a_task_are_fitted_at_the_same_time_and_read_the_parts_once(spark, monkeypatch):
    rows = spark.range(600).select("id", (F.rand(1) * 4).alias("a"), F.rand(2).alias("b"))
    rows = rows.withColumn("flag", (F.col("a") + F.col("b") > 2.5).cast("int")).cache()
    written, real, meet = [], M.stable, Barrier(2, timeout=60)
    monkeypatch.setattr(M, "stable", lambda df, name="stable": written.append(name) or real(df, name))
    split = M.Split(rows, ["a", "b"], "flag", "id", balance=True)

    def keep(split, est):
        meet.wait()  # fails unless both are under way
        return split.fit(est)

    got = M.train_and_evaluate(split, {"one": M.decision_tree(1), "other": M.decision_tree(2)}, keep=keep).collect()
    assert sorted(r["model"] for r in got) == ["one", "other"] and all(r["auc"] > 0.9 and r["accuracy"] > 0.9 for r in got)
    assert written.count("train") == 1 and written.count("test") == 1 and written.count("scored") == 2
