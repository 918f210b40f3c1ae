"""Results do not depend on input order or partitioning; the checkpoint folder
named by the session is used as is."""

import pytest
from pyspark.sql import functions as F

from relmine.operators import consistency as SC
from relmine.operators import drift as DR
from relmine.session import checkpoint_dir
from relmine.sources import tables as S


def _rounded(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("parts", ["3", "13"])
def test_consistency_is_order_and_partition_independent(spark, sf_dir, parts):
    q = S.conversation_prompts(spark, sf_dir)
    s = S.conversation_samples(spark, sf_dir)
    cols = ["prompt_id", *SC.METRICS]
    base = _rounded(SC.analyze(q, s), cols)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        shuffled = s.orderBy(F.rand(7)).repartition(int(parts))
        other = _rounded(SC.analyze(q.orderBy(F.desc("prompt_id")), shuffled), cols)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base == other


def test_drift_is_order_and_partition_independent(spark, sf_dir):
    ev = S.event_sequences(spark, sf_dir)
    cols = ["user_id", "event_id", "sentence_idx", "detected_drift_point", "post_drift"]
    base = _rounded(DR.label_sequences(ev, ["user_id"], ["ts", "event_id"]), cols)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        other = _rounded(DR.label_sequences(ev.orderBy(F.rand(3)).repartition(7), ["user_id"], ["ts", "event_id"]), cols)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base == other


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.value if self.value is not None else default


class _Context:
    """Like Spark's, it works in a folder of its own below the one that is set."""

    def __init__(self, current=None, master="local[2]"):
        self.current, self.master, self.set_to = current, master, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, d):
        self.set_to, self.current = d, f"{d}/own"


class _Session:
    def __init__(self, named, current=None, master="local[2]"):
        self.conf, self.sparkContext = _Conf(named), _Context(current, master)


def test_checkpoint_dir_reads_the_session_setting():
    s = _Session("hdfs://shared/ckpt")
    assert checkpoint_dir(s) == "hdfs://shared/ckpt/own" and s.sparkContext.set_to == "hdfs://shared/ckpt"
    s = _Session("hdfs://shared/ckpt", current="hdfs://shared/ckpt/uuid")
    assert checkpoint_dir(s) == "hdfs://shared/ckpt/uuid" and s.sparkContext.set_to is None


def test_checkpoint_dir_only_creates_one_when_unset():
    s = _Session(None)
    d = checkpoint_dir(s)
    assert d and d == f"{s.sparkContext.set_to}/own"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        checkpoint_dir(_Session(None, master="spark://host:7077"))


def test_checkpoint_dir_on_the_live_session(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
