"""Running columns in chunks against plain windows; one document holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.ordered import numbered, running, span


def rows(spark):
    rnd = random.Random(3)
    data = []
    for doc in (1, 1, 1, 2):
        for _ in range(150):
            data.append((doc, rnd.randrange(40), rnd.randrange(1000000), rnd.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "doc_id long, page_no int, seq int, v int").dropDuplicates(["doc_id", "page_no", "seq"])


def test_running_equals_window(spark):
    df = rows(spark)
    order = [F.col("page_no"), F.col("seq")]
    got = running(
        df, ["doc_id"], order, span("page_no", 3),
        sums={"s": F.coalesce("v", F.lit(0))}, previous={"p": F.col("v")}, latest={"l": F.col("v")}, highest={"h": F.col("v")},
    )
    w = Window.partitionBy("doc_id").orderBy("page_no", "seq")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"), F.lag("v").over(w).alias("p"),
        F.last("v", True).over(ahead).alias("l"), F.max("v").over(ahead).alias("h"),
    )
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_numbered_is_dense(spark):
    out = numbered(rows(spark), ["doc_id"], [F.col("page_no"), F.col("seq")], span("page_no", 2), "n")
    for doc, lo, hi, n in out.groupBy("doc_id").agg(F.min("n"), F.max("n"), F.countDistinct("n")).collect():
        assert lo == 1 and hi == n
