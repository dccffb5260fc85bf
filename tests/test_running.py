from pyspark.sql import functions as F

from lakeloom.operators.running import running


def test_running_sums(spark):
    rows = [("g" if i % 3 else "h", (i * 37) % 101, i, i % 7 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, p long, id long, v long")
    got = {r.id: r.before for r in running(df, ["g"], F.expr("p div 10"), ["p", "id"], "v").collect()}
    for g in "gh":
        at = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[i] == at
            at += v
