"""Label files (UTF-8, Latin-1, repeated header names) and time repair."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowsieve.functions import clean as C
from flowsieve.plans import label_files as LF
from flowsieve.plans import standins as S
from flowsieve.sources import files as IO


def test_latin1_fallback_and_raw_names(spark):
    paths = LF.write_label_files(spark, SF_SMALL)
    df = IO.read_label_csv(spark, paths["latin1"])
    assert df.columns[1] == " Source IP" and df.columns[-2:] == [" Label", "Label"]
    labels = [r[0] for r in df.select(" Label").where(F.col(" Label").isNotNull()).limit(5).collect()]
    assert all(chr(0x96) in s for s in labels)          # decoded as ISO-8859-1, not U+FFFD
    assert df.where(F.col("Flow ID").isNull()).count() == 1  # the line of commas only


def test_header_names_repeated():
    assert IO._header_names("a, b,a,a.1,a") == ["a", " b", "a.1", "a.1.1", "a.2"] or \
        IO._header_names("a, b,a,a.1,a")[:3] == ["a", " b", "a.1"]


def test_strip_then_first_of_equal_names_kept(spark):
    paths = LF.write_label_files(spark, SF_SMALL)
    df = C.remove_duplicated_cols(C.clean_column_names(IO.read_label_csv(spark, paths["latin1"])))
    assert df.columns.count("Label") == 1
    assert df.where(F.col("Label") == "dup").count() == 0


def test_12_hour_repair_restores_true_minute(spark):
    raw = S.f4_raw(spark, SF_SMALL).where(S.business_hours("true_minute"))
    rep = C.repair_12h_clock(C.parse_dayfirst("raw_ts"))
    n = raw.count()
    ok = raw.where(rep == F.col("true_minute")).count()
    assert n > 0 and ok == n
    shifted = raw.where(F.hour(C.parse_dayfirst("raw_ts")).between(1, 5)).count()
    assert 0 < shifted < n


def test_invalid_day_first_text_is_null(spark):
    df = spark.createDataFrame([("31/12/2017 5:01",), ("not a date",), ("32/1/2017 1:00",), (None,)], "t string")
    got = [r.p for r in df.select(C.parse_dayfirst("t").alias("p")).collect()]
    assert got[0] is not None and got[1:] == [None, None, None]


def test_replace_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,)], "x double")
    assert [r.x for r in C.replace_infinities(df).collect()] == [None, None, None, 1.5]


def test_epoch_ms_golden(spark):
    from flowsieve.functions.timecols import from_epoch_ms
    r = spark.range(1).select(from_epoch_ms(F.lit(1499082958000)).cast("string").alias("t")).first()
    assert r.t == "2017-07-03 11:55:58"


def test_duration_histogram_shows_empty_ranges(spark):
    from flowsieve.operators.quality import duration_histogram
    df = spark.createDataFrame([(500,), (-1,), ("x",)], "d string")
    out = {r.range_label: (r.n, r.pct) for r in duration_histogram(spark, df, "d").collect()}
    assert len(out) == 9
    assert out["0-1ms"] == (1, 50.0)      # -1 is out of range but counts in the denominator
    assert out["5min+"] == (0, 0.0)


def test_missing_duration_column_raises(spark):
    import pytest
    from flowsieve.operators.quality import duration_histogram
    with pytest.raises(ValueError):
        duration_histogram(spark, spark.range(3), "Flow Duration")


def test_files_spelling_a_column_differently_line_up(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("Flow ID, Label\n1,X\n2,NaN\n", encoding="utf-8")
    b.write_text("Flow ID,Label,Extra\n3,Y,e\n", encoding="utf-8")
    df = IO.read_label_csvs(spark, [str(a), str(b)])
    assert sorted(df.columns) == ["Extra", "Flow ID", "Label"]
    got = sorted((r["Flow ID"], r["Label"], r["Extra"]) for r in df.collect())
    assert got == [("1", "X", None), ("2", None, None), ("3", "Y", "e")]   # NaN is a missing token


def test_part_files_with_other_headers_and_a_replacement_character(spark, tmp_path):
    folder = tmp_path / "two words"
    folder.mkdir()
    (folder / "a.csv").write_text("id,Label\n1,\ufffd\u00e9\n", encoding="utf-8")   # valid UTF-8 stays UTF-8
    (folder / "b.csv").write_text("Label,id\nY,2\n", encoding="utf-8")
    (folder / "c.csv").write_bytes("id,Label\r\n3,caf\u00e9\r\n".encode("latin-1"))
    (folder / "empty.csv").write_text("", encoding="utf-8")
    got = sorted((r["id"], r["Label"]) for r in IO.read_label_csv(spark, str(folder)).collect())
    assert got == [("1", "\ufffd\u00e9"), ("2", "Y"), ("3", "caf\u00e9")]


def test_label_column_fallback(spark):
    import pytest
    from flowsieve.operators.quality import find_column
    assert find_column(spark.createDataFrame([(1, 2)], ["x", " Label"])) == " Label"
    with pytest.raises(ValueError, match="Label"):
        find_column(spark.range(1))
