"""SQL texts: queries of all kinds run, everything else is refused before it does anything."""

import pytest
from pyspark.sql.utils import ParseException

from vitalstream.operators import adhoc

READS = [
    "SELECT 1",
    "VALUES (1, 'a'), (2, 'b')",
    "TABLE t",
    "FROM t SELECT k WHERE v > 1",
    "WITH a AS (SELECT k, sum(v) AS s FROM t GROUP BY k HAVING sum(v) > 0), b(x) AS (SELECT max(s) FROM a) SELECT * FROM a JOIN b ON a.s = b.x",
    "SELECT k, v, rank() OVER w FROM t WINDOW w AS (PARTITION BY k ORDER BY v) ORDER BY k LIMIT 3 OFFSET 1",
    "SELECT k, sum(v) FROM t GROUP BY ROLLUP (k)",
    "SELECT k, v, count(*) FROM t GROUP BY GROUPING SETS ((k), (v), ())",
    "SELECT * FROM t PIVOT (sum(v) FOR k IN ('a', 'b'))",
    "SELECT * FROM t UNPIVOT (x FOR name IN (v))",
    "SELECT DISTINCT k FROM t UNION SELECT 'z' EXCEPT SELECT 'a' INTERSECT SELECT 'b'",
    "SELECT * FROM t WHERE v IN (SELECT max(v) FROM t) OR EXISTS (SELECT 1 FROM t AS u WHERE u.k = t.k AND u.v > t.v)",
    "SELECT /*+ BROADCAST(u) */ t.k FROM t LEFT JOIN t AS u USING (k)",
    "SELECT e FROM t LATERAL VIEW explode(array(v, v)) x AS e",
    "SELECT * FROM t, LATERAL (SELECT t.v + 1 AS w)",
    "SELECT * FROM range(3) AS r(n)",
    "FROM t |> WHERE v > 1 |> AGGREGATE sum(v) AS s GROUP BY k |> ORDER BY k",
    "SELECT (SELECT max(v) FROM t) AS m, CASE WHEN k LIKE 'drop table%' THEN 1 END FROM t TABLESAMPLE (50 PERCENT)",
]
REFUSED = [
    "DROP TABLE t",
    "CREATE TABLE x AS SELECT 1",
    "CREATE TEMP VIEW x AS SELECT 1",
    "INSERT INTO t VALUES ('a', 1)",
    "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
    "FROM t INSERT INTO a SELECT k INSERT INTO b SELECT v",
    "DELETE FROM t",
    "UPDATE t SET v = 1",
    "MERGE INTO t USING u ON t.k = u.k WHEN MATCHED THEN DELETE",
    "TRUNCATE TABLE t",
    "ALTER TABLE t ADD COLUMN c INT",
    "SET spark.sql.shuffle.partitions = 3",
    "CACHE TABLE t",
    "ADD JAR '/tmp/never.jar'",
    "USE x",
    "DECLARE v INT",
    "EXECUTE IMMEDIATE 'DROP TABLE t'",
    "SELECT TRANSFORM (k) USING 'cat' FROM t",
    "SELECT * FROM (SELECT TRANSFORM (k) USING 'cat' AS (x) FROM t)",
    "WITH a AS (SELECT TRANSFORM (k) USING 'cat' AS (x) FROM t) SELECT * FROM a",
    "SELECT 1 WHERE 'a' IN (SELECT TRANSFORM (k) USING 'cat' AS (x) FROM t)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.name')",
    "SELECT k FROM t WHERE length(Java_Method('java.lang.System', 'getProperty', k)) > 1",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name')",
    "SELECT system.builtin.`reflect`('java.lang.System', 'getProperty', 'user.name')",
    "WITH a AS (SELECT try_reflect('java.lang.System', 'exit', 1)) SELECT * FROM a",
]


@pytest.fixture
def tables(spark):
    return {"t": spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")}


@pytest.mark.parametrize("text", READS)
def test_reads(spark, tables, text):
    adhoc.query(spark, text, tables).collect()


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, tables, text):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.query(spark, text, tables)
    assert not spark.catalog.tableExists("t")


@pytest.mark.parametrize("text", ["", "SELEC 1", "SELECT 1; DROP TABLE t"])
def test_no_sql(spark, tables, text):
    with pytest.raises(ParseException):
        adhoc.query(spark, text, tables)


def test_views_of_the_session_come_back(spark, tables):
    spark.range(7).createOrReplaceTempView("t")
    assert adhoc.query(spark, "SELECT count(*) AS n FROM t", tables).first().n == 3
    assert spark.table("t").count() == 7
    spark.catalog.dropTempView("t")
