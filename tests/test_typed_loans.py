"""Loans are typed before they are written: the same rows as with types made afterwards, and plans without text."""

from pyspark.sql import functions as F

from ledgerlark.functions import expr as X
from ledgerlark.operators import clean as C
from ledgerlark.operators import encode as E
from ledgerlark.operators import ml as M
from ledgerlark.sources.domain import Tables, raw_loans


def test_text_that_does_not_parse_counts_as_a_value_when_columns_are_dropped(spark, sf):
    raw = raw_loans(Tables(spark, sf))
    raw = raw.withColumns({"last_pymnt_d": F.when(F.col("loan_id") % 5 != 0, F.lit("never")), "last_credit_pull_d": F.when(F.col("loan_id") % 5 == 0, F.col("last_credit_pull_d")),
                           "revol_util": F.lit(None).cast("string")})
    one, other = C.clean_loans(raw), C.clean_loans(raw, materialize=False)
    assert one.dtypes == other.dtypes and "last_pymnt_d" in one.columns and not {"last_credit_pull_d", "revol_util", "mths_since_last_delinq"} & set(one.columns)
    assert one.count() > 0 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_consumers_of_loans_parse_no_text(spark, sf):
    loans = C.clean_loans(raw_loans(Tables(spark, sf)))
    plan = E.prepare_features(loans, M.DEFAULT_FEATURES, keep=["loan_id"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract" not in plan and "gettimestamp" not in plan and "replace(" not in plan and "as string" not in plan, plan


def test_numbers_come_out_as_they_went_through_text(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 1e-320), (3, -1.7976931348623157e308), (4, float("inf")), (5, float("nan")), (6, None), (7, 123456789.123456789)], "i int, x double")
    got = E.prepare_features(rows, ["i", "x", "absent"]).collect()
    assert [(r["i"], r["x"], r["absent"]) for r in got] == [(float(i), 0.0 if x is None or x != x else x, 0.0) for i, x in [(r["i"], r["x"]) for r in rows.collect()]]
    assert E.prepare_features(rows.withColumn("x", F.col("x").cast("string")), ["x"]).collect() == E.prepare_features(rows, ["x"]).collect()


def test_a_stage_too_large_to_compile_is_not_generated_whole(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_months_are_read_as_the_parser_reads_them(spark):
    names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    texts = [f"{m}-{y}" for m in names for y in ("2015", "1600", "1599", "0001", "0000", "9999", "15")]
    texts += ["DEC-2015", "dec-2015", "Dec-2015\n", " Dec-2015", "Dec 2015", "Dec-20155", "December-2015", "Dez-2015", "Dec-2O15", "anF-2015", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", X.parse_month_year(F.col("t")).alias("own"), F.try_to_timestamp("t", F.lit("MMM-yyyy")).cast("date").alias("parser"))
    assert got.filter(~F.col("own").eqNullSafe(F.col("parser"))).select("t").collect() == []
    assert got.filter("own is not null").count() >= 36
