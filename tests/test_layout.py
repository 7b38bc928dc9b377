from pyspark.sql import functions as F

from lexloom.operators import lines as L
from lexloom.operators import patch as P


def test_reading_order(spark):
    rows = []
    for k in range(6):
        rows += [(1, 2 * k, 100.0 + 10 * k, 50.0, 250.0, f"l{k}"), (1, 2 * k + 1, 100.0 + 10 * k, 300.0, 500.0, f"r{k}")]
    rows.append((1, 99, 90.0, 50.0, 500.0, "head"))
    rows += [(2, k, 100.0 + k, 50.0, 500.0, f"x{k}") for k in range(3)]
    found = L.reading_order(spark.createDataFrame(rows, "page int, seq int, baseline double, x0 double, x1 double, text string")).orderBy("page", "place")
    assert [r["text"] for r in found.collect()] == ["head", *(f"l{k}" for k in range(6)), *(f"r{k}" for k in range(6)), "x0", "x1", "x2"]


def test_line_ends(spark):
    rows = [(1, k, 100.0 if k % 5 else 60.0) for k in range(20)]
    found = L.line_ends(spark.createDataFrame(rows, "doc_id int, line_no int, x1 double"))
    assert {(r["line_no"] % 5 == 0, r["line_end"]) for r in found.collect()} == {(True, "HARD"), (False, "SOFT")}


def test_body_size(spark):
    rows = [(1, 9.0, 70), (1, 7.0, 30), (2, 7.0, 20), (2, 9.0, 20), (2, 5.0, 30), (2, 6.0, 20), (2, 4.0, 10)]
    assert {tuple(r) for r in L.body_size(spark.createDataFrame(rows, "page int, size double, n int")).collect()} == {(1, 9.0), (2, 5.0)}


def test_set_wise_patches(spark):
    texts = ["ein Wort hier.", "Wort und Wort", "Worte", "Wort, dann", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    status, struck = P.strike_words(F.col("t"), "Wort")
    got = {r["k"]: (r["s"], r["x"]) for r in df.select("k", status.alias("s"), struck.alias("x")).collect()}
    assert got[0] == ("APPLIED", "ein hier.") and got[1] == ("AMBIGUOUS", "Wort und Wort") and got[2] == ("TARGET_MISSING", "Worte") and got[3] == ("APPLIED", ", dann")
    s, x = P.insert_words(F.col("t"), "Wort", "$1 \\ neu")
    assert df.where("k = 0").select(x).first()[0] == "ein Wort $1 \\ neu hier."
