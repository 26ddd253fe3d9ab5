import pytest

from tallywick.operators import breaks as b


def numbers(spark, *values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize(
    "low, high, cuts",
    [
        (0, 100, [0, 20, 40, 60, 80, 100]),
        (1, 10, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
        # raw step 13.4: 20 overshoots it by 6.6, more than 1.5 * 3.4, so the step stays 10
        (3, 97, [10, 20, 30, 40, 50, 60, 70, 80, 90]),
        (0, 1, [0, 0.2, 0.4, 0.6, 0.8, 1]),
        (120, 4100, [500, 1000, 1500, 2000, 2500, 3000, 3500, 4000]),
        (-7, 7, [-6, -4, -2, 0, 2, 4, 6]),
    ],
)
def test_round_cuts_inside_the_range(spark, low, high, cuts):
    rows = sorted(b.legend_breaks_numeric(numbers(spark, low, None, high), "x").collect())
    assert [r.cut for r in rows] == pytest.approx(cuts)
    assert [r.position for r in rows] == pytest.approx([(c - low) / (high - low) for c in cuts])


def test_single_value_and_no_value(spark):
    rows = b.legend_breaks_numeric(numbers(spark, 10.0), "x").collect()
    assert all(r.cut == 10.0 and r.position is None for r in rows)
    assert b.legend_breaks_numeric(numbers(spark, None), "x").collect() == []


def test_given_cuts(spark):
    rows = b.legend_breaks_numeric(numbers(spark, 1.0, 9.0), "x", [0, 5, 10]).collect()
    assert [(r.cut, r.position) for r in rows] == [(5.0, 0.5)]
    with pytest.raises(ValueError):
        b.legend_breaks_numeric(numbers(spark, 1.0, 9.0), "x", [0, 5, 11])


def test_midpoints(spark):
    df = spark.createDataFrame([([0.0, 10.0, 30.0],)], "cuts array<double>")
    assert [tuple(r) for r in b.legend_breaks_bin(df, "cuts").collect()] == [(0, 5.0), (1, 20.0)]
    one = spark.createDataFrame([([1.0],)], "cuts array<double>")
    assert b.legend_breaks_bin(one, "cuts").collect() == []


def test_quantiles(spark):
    rows = b.legend_breaks_quantile(numbers(spark, 1, 2, 3, None, 4), "x", [0.0, 0.5, 1.0]).collect()
    assert [tuple(r) for r in rows] == [
        ("cut", 0.0, 1.0), ("cut", 0.5, 2.5), ("cut", 1.0, 4.0), ("mid", 0.25, 1.75), ("mid", 0.75, 3.25),
    ]


def test_factors(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    assert [r.x for r in b.legend_breaks_factor(df, "x").collect()] == ["a", "b"]
    assert [r.x for r in b.legend_breaks_factor(df, "x", decreasing=True).collect()] == ["b", "a"]


def test_positions(spark):
    rows = b.color_position(numbers(spark, 10, 20, 30, None), "x").collect()
    assert {r.x: r.position for r in rows} == {10: 0.0, 20: 0.5, 30: 1.0, None: None}
    assert [r.position for r in b.color_position(numbers(spark, 5, 5), "x").collect()] == [None, None]
