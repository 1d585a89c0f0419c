import datetime as dt

from pyspark.sql import functions as F

from matchlake.functions import dates as D
from matchlake.functions import scalar as X


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_rounding_and_ratios(spark):
    row = one(
        spark, X.rounded(F.lit(2.345), 2), X.rounded(F.lit(-1.25), 1), X.ratio(F.lit(1), F.lit(0), 50.0),
        X.ratio(F.lit(1), F.lit(4), times=100), X.share(F.lit(0.0), F.lit(0.0)), X.share(F.lit(3.0), F.lit(1.0)),
    )
    assert list(row) == [2.35, -1.2, 50.0, 25.0, 50.0, 75.0]


def test_text_numbers(spark):
    row = one(
        spark, X.signed(F.lit(4)), X.signed(F.lit(0)), X.signed(F.lit(-2)), X.tolerant_int(F.lit(" 12,344 ")),
        X.tolerant_int(F.lit("n/a")), X.tolerant_double(F.lit(" 0.97")),
    )
    assert list(row) == ["+4", "0", "-2", 12344, None, 0.97]


def test_bands_and_labels(spark):
    row = one(
        spark, X.score_band(F.lit(0.75)), X.score_band(F.lit(0.5)), X.score_band(F.lit(0.1)),
        X.map_count(F.lit(30.0), F.lit(70.0)), X.map_count(F.lit(61.0), F.lit(39.0)),
        X.confidence_text(F.lit(30.0)), X.confidence_image(F.lit(30.0)), X.form_mark(F.lit(-0.31)),
    )
    assert list(row) == ["3-0", "2-3", "0-3", "0-3", "3-1", "MODERATE", "HIGH", "cold"]


def test_decay_is_clamped_and_half_at_thirty_days(spark):
    day = F.lit("2026-01-01").cast("date")
    row = one(
        spark, X.decay(F.lit("2025-12-02").cast("date"), day), X.decay(F.lit("2020-01-01").cast("date"), day),
        X.decay(F.lit("2026-05-01").cast("date"), day), X.decay(F.lit(None).cast("date"), day),
    )
    assert abs(row[0] - 0.5) < 1e-3 and list(row)[1:] == [0.01, 1.0, 0.5]


def test_roster_expressions(spark):
    a = F.array(*[F.lit(x) for x in "abcd"])
    b = F.array(*[F.lit(x) for x in "cdxy"])
    row = one(spark, X.overlap(a, b), X.roster_key(b), X.overlap(a, F.lit(None).cast("array<string>")))
    assert list(row) == [0.5, "c|d|x|y", 0.0]


def test_date_repair(spark):
    ref = F.lit("2026-02-27").cast("date")
    rows = spark.createDataFrame(
        [("2026-30-01",), ("2026-01-30",), ("2026-12-02",), ("2026-13-13",), ("soon",), ("2026-05-20",)], "t string"
    ).select(
        D.normalize_match_date("t", ref).alias("d"), D.date_repair_reason("t", ref).alias("r"),
        D.normalize_match_date("t").alias("plain"),
    ).collect()
    assert [r.d for r in rows] == [
        dt.date(2026, 1, 30), dt.date(2026, 1, 30), dt.date(2026, 2, 12), None, None, dt.date(2026, 5, 20)
    ]
    assert [r.r for r in rows] == ["swapped", "kept", "future", "invalid", "invalid", "kept"]
    assert rows[2].plain == dt.date(2026, 12, 2)


def test_slash_dates(spark):
    row = one(spark, D.slash_date(F.lit("on 3/2/2026 at")), D.slash_date(F.lit("3/2/2026"), False), D.slash_date(F.lit("-")))
    assert list(row) == ["2026-02-03", "2026-03-02", None]
