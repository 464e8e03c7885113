import pytest
from pyspark.sql import functions as F

from turfspoor import session


def test_frequent_keys_are_joined_like_all_others(spark):
    left = spark.createDataFrame([(n % 7 if n < 70 else 99, n, "x") for n in range(100)] + [(None, -1, "x")], "k int, v int, c string")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 3")
    want = sorted((r.k, r.v, r.c, r.n) for r in left.join(right, ["k"]).collect())
    for hot in (0, 10, 20, 1000):
        assert sorted((r.k, r.v, r.c, r.n) for r in session.join_hot(left, right, ["k"], F.col("n"), hot).collect()) == want
    assert session.join_hot(left, right.limit(0), ["k"], F.col("n")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://x:7077")

    class Fake:
        class sparkContext:
            master, getCheckpointDir = "yarn", staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="share"):
        session.shared_folder(Fake)
