"""Distribution tails written as Column expressions."""

import pytest

from factlane.functions import stats as S


@pytest.mark.parametrize("df,crit", [(1, 12.706205), (3, 3.182446), (4, 2.776445), (5, 2.570582), (30, 2.042272)])
def test_t_critical(df, crit):
    assert S.t_critical(df) == pytest.approx(crit, abs=1e-6)


def test_t_tail_columns(spark):
    rows = [(2.0, 4), (6.0, 4), (1.0, 1), (2.5, 7), (0.0, 3)]
    df = spark.createDataFrame(rows, "t double, df int")
    got = [r[0] for r in df.select(S.t_two_sided_p("t", "df")).collect()]
    # two-sided p-values of Student's t (published tables / closed forms)
    assert got == pytest.approx([0.116117, 0.003883, 0.5, 0.040992, 1.0], abs=1e-6)


def test_chi2_tail(spark):
    df = spark.createDataFrame([(1.125,), (1 / 6,), (3.841459,), (0.0,), (200.0,)], "x double")
    got = [r[0] for r in df.select(S.chi2_1_sf("x")).collect()]
    assert got == pytest.approx([0.288844, 0.683091, 0.05, 1.0, 0.0], abs=1e-6)


def test_t_critical_join(spark):
    df = spark.createDataFrame([(4,), (2000,)], "df int")
    rows = {r["df"]: r["t_crit"] for r in S.with_t_critical(df, "df").collect()}
    assert rows[4] == pytest.approx(2.776445, abs=1e-6)
    assert rows[2000] == pytest.approx(1.961151, abs=1e-5)
