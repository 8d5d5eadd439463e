from paceline.operators import prep


def test_dense_rows_keep_every_user(spark):
    rows = [(7, 1, 3.0), (7, 4, 2.0), (7, 4, 5.0), (3, 9, 4.0), (5, 2, None), (5, None, 1.0), (9, 5, 1.0), (None, 1, 1.0), (9, 0, 2.0)]
    df = spark.createDataFrame(rows, "u long, i int, r double")
    got = [(r.row, r.user, list(r.v)) for r in prep.dense_rows(df, "u", "i", "r", 5).orderBy("row").collect()]
    none = [0.01] * 5
    assert got == [(0, 3, none), (1, 5, none), (2, 7, [3.0, 0.01, 0.01, 5.0, 0.01]), (3, 9, [0.01] * 4 + [1.0])]
