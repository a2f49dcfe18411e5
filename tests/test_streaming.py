import shutil

import pytest

from quernwork.streaming import postings as S


@pytest.fixture()
def folder(tmp_path, spark, sf):
    p = spark.read.parquet(f"{sf}/postings.parquet")
    p = p.withColumns({"seen_at": p.seen_at.cast("timestamp")})
    for n in range(3):
        p.filter(f"ingest_seq % 3 = {n}").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        shutil.copy(part, tmp_path / "in" / f"{n}.parquet")
    return tmp_path


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_first_sightings(spark, folder):
    got = run(S.first_sightings(S.posting_stream(spark, str(folder / "in"), 3), "3650 days"), folder, "firsts")
    assert got.count() == spark.read.parquet(str(folder / "in")).select("source", "source_id").distinct().count()


def test_changes(spark, folder):
    got = run(S.change_stream(S.posting_stream(spark, str(folder / "in"), 3)), folder, "changes")
    src = spark.read.parquet(str(folder / "in"))
    assert got.count() == src.count()
    assert got.filter("label = 'new'").count() == src.select("source", "source_id").distinct().count()


def test_merge_batches(spark, folder):
    at = [spark.createDataFrame([], "source string, source_id string, url string, raw string, apply_url string, first_seen timestamp, last_seen timestamp, gone_at timestamp")]

    def write(df, n):
        df.write.mode("overwrite").parquet(str(folder / f"snap{n}"))
        at[0] = spark.read.parquet(str(folder / f"snap{n}"))

    q = S.posting_stream(spark, str(folder / "in")).writeStream.foreachBatch(S.merge_batches(lambda: at[0], write)).option("checkpointLocation", str(folder / "cp-m")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert at[0].count() == spark.read.parquet(str(folder / "in")).select("source", "source_id").distinct().count()
