from pyspark.sql import functions as F

from quarry.functions import scalars as S


def test_scalars(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], "it's", "b.y = A.x")], "a array<double>, b array<double>, t string, j string")
    r = df.select(S.dot(F.col("a"), F.col("b")).alias("dot"), S.length(F.col("a")).alias("len"), S.length(F.array(F.lit(0.0))).alias("zero"), S.sigmoid(F.lit(0.0)).alias("half"), S.quoted(F.col("t")).alias("q"), S.sided(F.col("j")).alias("j")).first()
    assert tuple(r) == (11.0, 5.0, 1.0, 0.5, "'it''s'", "a.x=b.y")
    assert spark.sql("SELECT timestamp_ntz'1970-01-02 00:00:01.9' AS t").select(S.epoch(F.col("t"))).first()[0] == 86_401
