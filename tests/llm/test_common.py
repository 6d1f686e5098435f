from types import SimpleNamespace

import pytest

from cairn.llm.common import materialize, remove, work_dir


class Conf(dict):
    set = dict.__setitem__


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"])
def test_no_machine_local_folder_on_a_cluster(master):
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getConf=Conf, master=master), conf=Conf())
    with pytest.raises(RuntimeError):
        work_dir(spark)
    spark.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert work_dir(spark) == "hdfs://shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_folder_of_its_own_in_one_jvm(master):
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getConf=Conf, master=master), conf=Conf())
    assert work_dir(spark) == work_dir(spark) != ""


def test_what_is_written_is_read_back(spark):
    df = materialize(spark.range(3), "test")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    remove(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
