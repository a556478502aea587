"""Writers and readers side by side: one forecast a key, one version of all views."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidemark.operators import issuance


def test_of_writers_of_one_key_one_wins(spark, tmp_path):
    root, key = str(tmp_path / "root"), ("2024-01-01", "m", 24)
    rows = [spark.range(50).withColumn("writer", F.lit(k)) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda df: issuance.publish_once(root, key, df), rows))
    assert sum(won) == 1
    got = spark.read.parquet(issuance.forecast_folder(root, *key))
    assert got.count() == 50 and [r["writer"] for r in got.select("writer").distinct().collect()] == [won.index(True)]
    assert not issuance.publish_once(root, key, rows[0]) and issuance.publish_once(root, (*key, "other"), rows[0])
    assert not list((tmp_path / "root" / "staged").iterdir())


def test_a_name_that_is_taken_is_kept(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).withColumn("n", F.lit(name)).write.parquet(str(tmp_path / name))
    assert issuance.claim(spark, str(tmp_path / "a"), str(tmp_path / "x" / "final"))
    assert not issuance.claim(spark, str(tmp_path / "b"), str(tmp_path / "x" / "final"))
    assert {r["n"] for r in spark.read.parquet(str(tmp_path / "x" / "final")).collect()} == {"a"}


def test_readers_see_one_version_of_all_views(spark, tmp_path):
    root = str(tmp_path / "views")
    issuance.publish_views(spark, root, {n: spark.range(1).withColumn("mark", F.lit(-1)) for n in ("u", "v")})

    def write(k):
        return issuance.publish_views(spark, root, {n: spark.range(20).withColumn("mark", F.lit(k)) for n in ("u", "v")})

    def read(_):
        views = issuance.read_views(spark, root, ["u", "v"])
        return {r["mark"] for v in views.values() for r in v.collect()}

    with ThreadPoolExecutor(6) as pool:
        written = [pool.submit(write, k) for k in range(4)]
        seen = list(pool.map(read, range(12)))
        numbers = sorted(f.result() for f in written)
    assert numbers == [2, 3, 4, 5] and all(len(s) == 1 for s in seen)
    assert read(None) != {-1}
