"""The recommender's blocks."""

from lakejobs.operators import recommend


def test_blocks_of_the_recommender_are_few(spark, monkeypatch):
    asked = []

    def parts(df, least, rows_per_part=5_000_000):
        asked.append(max(least, -(-170_000_000 // rows_per_part)))
        return 2

    monkeypatch.setattr(recommend, "parts_for", parts)
    train = spark.createDataFrame([(u, i, float(u % 2 + i % 2)) for u in range(6) for i in range(6)], "u int, i int, r double")
    assert recommend.fit_als(train, "u", "i", "r", max_iter=1).userFactors.count() == 6
    # 170 million ratings had 34 blocks, and every factor was sent to nearly all of them.
    assert asked == [recommend.ALS_BLOCKS]
