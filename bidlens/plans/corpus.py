"""A corpus of tender documents rendered from the star schema, in SQL that Spark and DuckDB both run.

Every value that rules should find is known from the tables, so a query's expected result can be
written without any regex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("orders", "customer", "lineitem", "nation")

_DIGIT = "零壹贰叁肆伍陆柒捌玖"


def _cn_digit(x: str) -> str:
    return f"substr('{_DIGIT}', CAST({x} AS INT) + 1, 1)"


#: Known values of an order's document.
FACTS = f"""
SELECT o.o_orderkey AS doc_id, o.o_custkey AS cust, n.n_name AS nation, li.total AS amount, CAST(CAST(floor(li.total / 50) AS BIGINT) AS DECIMAL(18,2)) AS deposit,
  CAST(year(o.o_orderdate) + 30 AS INT) AS y, CAST(month(o.o_orderdate) AS INT) AS m, CAST(day(o.o_orderdate) AS INT) AS d,
  'PRJ-' || CAST(o.o_orderkey AS VARCHAR(20)) || '-' || CAST(o.o_custkey AS VARCHAR(20)) AS project_number,
  n.n_name || '市第' || CAST(o.o_custkey AS VARCHAR(20)) || '学校' AS buyer,
  '13' || lpad(CAST(o.o_custkey AS VARCHAR(20)), 9, '0') AS mobile,
  'c' || CAST(o.o_custkey AS VARCHAR(20)) || '@example.com' AS email,
  CASE o.o_custkey % 4 WHEN 0 THEN '张三' WHEN 1 THEN '李小四' WHEN 2 THEN '欧阳明月' ELSE '王五' END AS person,
  '110101' || CAST(1950 + o.o_custkey % 50 AS VARCHAR(4)) || lpad(CAST(1 + o.o_custkey % 12 AS VARCHAR(2)), 2, '0') || lpad(CAST(1 + o.o_custkey % 28 AS VARCHAR(2)), 2, '0') || lpad(CAST(o.o_custkey % 1000 AS VARCHAR(3)), 3, '0') AS id17,
  CAST(1 + o.o_orderkey % 9 AS INT) AS tens, CAST(1 + o.o_custkey % 9 AS INT) AS ones
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey"""

#: Weights of the identity number's check digit.
_SUM = " + ".join(f"CAST(substr(id17, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)))

CHECKED = f"SELECT *, id17 || substr('10X98765432', ({_SUM}) % 11 + 1, 1) AS id18 FROM ({FACTS}) f"

_PARTS = [
    "'# 采购项目文件'",
    "'## 第一章 基本信息'",
    "'项目名称：' || nation || '设备采购第' || CAST(doc_id AS VARCHAR(20)) || '号项目'",
    "'项目编号：' || project_number",
    "'采购人：' || buyer",
    "'法定代表人：' || person",
    "''",
    "'## 第二章 报价'",
    "'投标总报价：人民币' || CAST(amount AS VARCHAR(30)) || '元'",
    "'投标保证金：' || CASE WHEN doc_id % 5 = 0 THEN '人民币' || CAST(CAST(amount * 2 AS DECIMAL(18,2)) AS VARCHAR(30)) || '元' ELSE CAST(deposit AS VARCHAR(30)) || '元' END",
    f"'履约保证金（大写）：' || {_cn_digit('tens')} || '拾' || {_cn_digit('ones')} || '万元整'",
    "'### 时间安排'",
    "'投标截止时间：' || CAST(y AS VARCHAR(4)) || '年' || CAST(m AS VARCHAR(2)) || '月' || CAST(d AS VARCHAR(2)) || '日'",
    "'本项目自2020年1月' || CAST(1 + doc_id % 28 AS VARCHAR(2)) || '日起立项。'",
    "''",
    "'## 第三章 联系方式'",
    "'联系电话：' || mobile",
    "'邮箱：' || email",
    "'姓名：' || person || '，身份证号：' || id18",
    "'注册建造师证书编号：JZS' || lpad(CAST(cust AS VARCHAR(20)), 8, '0') || '，有效期至：2031年' || CAST(1 + cust % 12 AS VARCHAR(2)) || '月1日'",
]

CONTENT = " || chr(10) || ".join(_PARTS)
#: doc_id and content.
CORPUS = f"SELECT doc_id, {CONTENT} AS content FROM ({CHECKED}) k"


def to_spark(sql: str) -> str:
    """The SQL with Spark's strings: bounded VARCHARs would cut, not cast."""
    import re

    return re.sub(r"VARCHAR\(\d+\)", "STRING", sql)


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows that are small and dear to work on, dealt to several tasks a core.

    The planner goes by bytes and would put them into a few. Dealt by ``key`` itself they could stay as a join left them,
    which the planner has put into as many tasks as there are cores and one more.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content of a tender document per order with line items."""
    return dealt(facts(spark, sf_dir), "doc_id").selectExpr("doc_id", f"{to_spark(CONTENT)} AS content")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir)
    return spark.sql(to_spark(CHECKED))
