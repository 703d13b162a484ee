"""Tables of a database by JDBC, on an embedded one."""

import pytest
from py4j.protocol import Py4JJavaError

from sqlsift.sources import tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    tables._in_one(spark, url, ['CREATE TABLE t ("uid" VARCHAR(40) NOT NULL PRIMARY KEY, "n" BIGINT CHECK ("n" < 1000), "name" VARCHAR(100))'], driver=DRIVER)
    return url


def test_merge_and_read_in_ranges(spark, url):
    frame = lambda rows: spark.createDataFrame(rows, "uid string, n long, name string")
    read = lambda **k: sorted(map(tuple, tables.read_table(spark, url, "t", driver=DRIVER, **k).collect()))
    assert tables.bounds(spark, url, "t", "n", driver=DRIVER) is None and read(column="n") == []
    tables.merge_table(frame([(f"k{i}", i, "old") for i in range(50)] + [(None, 1, "x")]).repartition(4), url, "t", driver=DRIVER)
    tables.merge_table(frame([("k1", 100, "new"), ("k1", 100, "new"), ("k99", None, "none")]), url, "t", driver=DRIVER)
    tables.merge_table(frame([("k2", 200, "new"), ("k98", 98, "é'\"")]), url, "t", wins=False, driver=DRIVER)
    want = sorted([(f"k{i}", i, "old") for i in range(50) if i != 1] + [("k1", 100, "new"), ("k99", None, "none"), ("k98", 98, "é'\"")])
    assert read() == want == read(column="n", parts=5) and tables.bounds(spark, url, "t", "n", driver=DRIVER) == (0, 100)
    assert tables.read_table(spark, url, "t", "n", 5, driver=DRIVER).rdd.getNumPartitions() == 5
    assert "PushedFilters: [*IsNotNull(n), *EqualTo(n,7)]" in tables.read_table(spark, url, "t", driver=DRIVER).filter("n = 7")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Py4JJavaError):  # one row breaks the table's rule: none is taken, and nothing is left behind
        tables.merge_table(frame([("k3", 5, "new"), ("kx", 5000, "bad")]), url, "t", tries=2, driver=DRIVER)
    assert read() == want
    left = spark.read.format("jdbc").option("url", url).option("driver", DRIVER).option("query", "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load()
    assert [r[0] for r in left.collect()] == ["T"]
