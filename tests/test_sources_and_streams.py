import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sentrylake.sources import archives
from sentrylake.streaming import watch


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "."), body)
    return out.getvalue()


def test_folder_and_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"caf\xe9 ok")
    inner = zipped(x__txt=b"inside")
    (tmp_path / "b.zip").write_bytes(zipped(one__txt=b"first", in__zip=inner, bomb__bin=b"0" * 3_000_000))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    files = archives.scan_folder(spark, f"file://{tmp_path}")
    assert {r["path"] for r in files.select("path").collect()} == {"d/a.txt", "b.zip", "bad.zip"}
    assert {r["path"] for r in archives.scan_folder(spark, f"file://{tmp_path}", depth=0).select("path").collect()} == {"b.zip", "bad.zip"}
    assert "ok" in files.where("path = 'd/a.txt'").select(archives.text_of()).first()[0]
    found = {r["path"]: (r["content"], r["protection"]) for r in archives.with_entries(files).collect()}
    assert bytes(found["b.zip::one.txt"][0]) == b"first" and bytes(found["b.zip::in.zip::x.txt"][0]) == b"inside"
    assert found["b.zip::bomb.bin"] == (None, "archive_limit") and len(found) == 7
    assert [r["protection"] for r in archives.entries(files).where("path = 'bad.zip'").collect()] == ["bad_archive"]


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("u", start + timedelta(seconds=20 * k)) for k in range(6)]
    spark.createDataFrame(rows, "user string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, ts timestamp").parquet(f"{tmp_path}/in")
    counts = watch.exceeding(watch.failure_counts(stream, "user", "ts", "2 minutes", "1 minute"), 6)
    query = counts.writeStream.format("memory").queryName("failing").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("failing").select(F.max("failures")).first()[0] == 6

    scans = spark.createDataFrame([("t", 1, 0), ("t", 2, 3)], "tenant_id string, scan_id long, critical long")
    scans.write.parquet(f"{tmp_path}/scans")
    told = []
    arriving = spark.readStream.schema(scans.schema).parquet(f"{tmp_path}/scans")
    watch.watch_scans(arriving, lambda df, _: told.extend(df.collect()), f"{tmp_path}/check").awaitTermination(120)
    assert [r["scan_id"] for r in told] == [2]
