import io
import zipfile

from pyspark.sql import functions as F

from sentrylake.operators import report
from sentrylake.plans import catalogue
from sentrylake.sources import documents


def test_shares_and_profiles(spark):
    shares = [r[0] for r in spark.createDataFrame([("data",), ("C$",), ("IPC$",), ("x1$",)], "s string").where(report.keep_share("s", admin=True)).collect()]
    assert shares == ["data", "C$"]
    paths = [("c:\\Users\\Jo\\a",), ("/users/jo.corp/b",), ("/users/corp.jo/c",), ("/users/joan/d",), ("/data/jo/e",)]
    assert spark.createDataFrame(paths, "p string").where(report.of_profile("p", " JO ")).count() == 3


def test_document_text(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<d><p>hello</p><p>there</p></d>")
        z.writestr("other/x.xml", "<d>no</d>")
    files = [("a.docx", bytearray(out.getvalue())), ("b.pdf", bytearray(b"%PDF (one) x (two)")), ("c.docx", bytearray(b"plain")), ("d.txt", bytearray(b"text")), ("e.bin", bytearray(b"x")), ("f.pdf", None)]
    got = dict(tuple(r) for r in documents.with_text(spark.createDataFrame(files, "path string, content binary")).collect())
    assert got == {"a.docx": "hello there", "b.pdf": "one\ntwo", "c.docx": "", "d.txt": "text", "e.bin": "", "f.pdf": ""}


def test_register_is_written(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rows = catalogue.assessed(spark, folder)
    report.write_register(rows, f"{tmp_path}/register")
    back = spark.read.json(f"{tmp_path}/register")
    assert back.count() == 200 and back.where(F.col("ticket").rlike(r"^TICKET-\d{5}$")).count() == 200
