import pytest

from vantage.session import ensure_checkpoint_dir, recommended_conf, shared_path


def test_recommended_conf_scales_with_input():
    small = recommended_conf(1 << 30, cores=8)
    big = recommended_conf(100 << 40, cores=8000)  # 100 TB on 8000 cores
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # two waves of 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_shared_path_under_checkpoint_dir(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or \
        spark.conf.get("spark.checkpoint.dir", None)
    p = shared_path(spark, "staged")
    assert base and p.startswith(base.rstrip("/") + "/vantage/staged/")
    assert shared_path(spark, "staged") != p  # a new folder per call


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
