import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import _shared as S


@pytest.mark.parametrize("cuts", [[3, 3], [1, 1, 1, 1, 1, 1], [6], [2, 0, 4]])
def test_sorted_groups_keep_keys_whole(cuts):
    rows, at, batches = [1, 1, 2, 2, 2, 3], 0, []
    for n in cuts:
        batches.append(pa.RecordBatch.from_pydict({"k": pa.array(rows[at : at + n], pa.int64())}))
        at += n
    groups = [t.column("k").to_pylist() for t in S.sorted_groups(iter(batches), "k")]
    assert sum(groups, []) == rows
    assert all(not set(a) & set(b) for i, a in enumerate(groups) for b in groups[i + 1 :])


def test_materialize_and_forget(spark):
    from pathlib import Path

    df = S.materialize(spark.range(3).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 3 and S.materialize(spark.range(0), "none").count() == 0
    mine = Path(S._written[-2].removeprefix("file://"))
    assert mine.exists() and mine.parent == Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    S.forget(spark)
    assert not mine.exists()


def test_a_folder_of_its_own_where_none_is_set(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId, master = "a", "local[2]"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    a, b = S.shared_folder(Session(), "x"), S.shared_folder(Session(), "x")
    assert a.startswith("file:///") and a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    del S._written[-2:]


def test_a_cluster_without_a_setting_uses_its_warehouse():
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://w/"}.get(key, default)

    class Context:
        applicationId, master = "b", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    assert S.shared_folder(Session(), "x").startswith("hdfs://w/docloom-steps/x-")
    del S._written[-1:]


def test_rounds_keep_the_last_table_only(spark):
    from pathlib import Path

    rounds = S.Rounds(spark, "r")
    first = rounds.store(spark.range(3))
    old = rounds.last
    assert rounds.store(first.where("id > 0")).count() == 2 and not Path(old.removeprefix("file://")).exists() and Path(rounds.last.removeprefix("file://")).exists()
