"""Sources, sinks and stores that write on their way."""

import hashlib
import io
import os
import resource
import shutil
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sentrylake.operators import findings, observed, report_store, rescan, rollups
from sentrylake.plans import catalogue, flows
from sentrylake.sources import inflate, inventory, listings, stored, walk
from sentrylake.streaming import sinks, tokens

SMALL = "/root/testdata/sf0.001"


# -- listings ------------------------------------------------------------------------------


def answer(folder, kind, target, *lines):
    path = listings.target_folder(str(folder), kind, target)
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.txt", "a") as out:
        out.write("\n".join(lines))


def test_filters_reach_the_source_and_bad_pages_do_not_fail(spark, tmp_path):
    one = '{"records": [{"doc_id": 1, "path": "/a", "size": 3}, {"doc_id": 2, "path": "/b"}], "diagnostics": {"denied": 1}}'
    answer(tmp_path, "host", "pc 1/x", one, one.replace("1", "7"))
    answer(tmp_path, "host", "pc2", one, "no json", '{"records": [], "diagnostics": {"error": "refused"}}')
    answer(tmp_path, "share", "C$", one)
    os.makedirs(listings.target_folder(str(tmp_path), "share", "empty"))
    pages = listings.answers(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() == 4
    for condition, parts in (("kind = 'host'", 2), ("target IN ('pc2', 'C$')", 2), ("target LIKE 'pc%'", 2), ("kind = 'share' AND target = 'pc2'", 1), ("kind = 'host' AND page > 0", 2)):
        assert pages.where(condition).rdd.getNumPartitions() == parts, condition
    assert pages.where("kind = 'share' AND target = 'pc2'").count() == 0
    assert listings.records(pages).where("kind = 'host'").count() == 6
    told = {r["target"]: r for r in listings.diagnostics(pages).collect()}
    assert (told["pc2"]["bad_pages"], told["pc2"]["errors"], told["pc2"]["pages"], told["pc 1/x"]["records"]) == (1, 1, 3, 4)
    assert "empty" not in told
    names = spark.createDataFrame([(n,) for n in ("data", "C$", "D$", "ipc$", "Admin$", "print$")], "target string")
    kept = lambda drive: [r[0] for r in names.where(listings.ordinary_shares(admin_drive=drive)).collect()]
    assert kept(None) == ["data"] and kept("d") == ["data", "D$"]


def test_a_target_that_cannot_be_read_says_so(spark, tmp_path):
    reader = listings.Answers(str(tmp_path))
    rows = list(reader.read(listings.Target("host", "gone", f"{tmp_path}/kind=host/target=gone")))
    assert len(rows) == 1 and '"error"' in rows[0][3]


# -- folders ---------------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for path in ("a/one.txt", "a/b/two.csv", "a/b/c/three.txt", "a/b/c/d/four.txt", ".git/x.txt", "a/node_modules/y.txt", "Windows/z.txt", "a/_draft.txt", "a/.env", "a/UPPER.TXT"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    (root / "empty").mkdir()
    os.symlink(root / "a", root / "link")
    os.symlink("/etc/hostname", root / "a/link.txt")
    return root


def test_walk_opens_only_what_it_keeps(spark, tree):
    def names(**options):
        found = walk.walk(spark, str(tree), **options).toPandas()
        return set(found.path[found.reason.isna()]), {(p, r) for p, r in zip(found.path, found.reason) if isinstance(r, str)}

    kept, out = names(depth=2)
    assert kept == {"/a/one.txt", "/a/b/two.csv", "/a/_draft.txt", "/a/.env", "/a/UPPER.TXT"} | {"/.git/x.txt"} - {"/.git/x.txt"}
    assert out == {("/.git", "skipped"), ("/a/node_modules", "skipped"), ("/Windows", "system"), ("/a/b/c", "too deep"), ("/link", "link"), ("/a/link.txt", "link")}
    kept, out = names(depth=None, include_hidden=False, include_system=True, include_skipped=True, extensions=["TXT"])
    assert kept == {"/a/one.txt", "/a/b/c/three.txt", "/a/b/c/d/four.txt", "/a/node_modules/y.txt", "/Windows/z.txt", "/a/_draft.txt", "/a/UPPER.TXT"}
    assert {("/.git", "hidden"), ("/a/.env", "hidden"), ("/a/b/two.csv", "extension")} <= out
    assert names(modified_after=datetime(2999, 1, 1))[0] == set()


def test_contents_of_a_walk(spark, tree):
    found = {r["path"]: r for r in walk.contents(walk.walk(spark, str(tree)), str(tree)).collect()}
    assert found["/a/b/two.csv"]["sha256"] == hashlib.sha256(b"a/b/two.csv").hexdigest() and found["/a/b/two.csv"]["preview"] == "a/b/two.csv"
    one = walk.walk(spark, str(tree / "a/one.txt"))
    assert [r["path"] for r in one.collect()] == ["/one.txt"]
    with pytest.raises(FileNotFoundError):
        walk.walk(spark, str(tree / "missing"))
    assert walk.walk(spark, str(tree / "empty")).count() == 0


# -- counts beside rows ------------------------------------------------------------------------


def test_counts_come_from_the_pass_that_filters(spark, tmp_path):
    rows = spark.range(1000).withColumn("odd", F.when(F.col("id") > 900, None).otherwise(F.col("id") % 2 == 1))
    left, seen = observed.filtered(rows, {"odd": F.col("odd"), "small": F.col("id") < 100})
    spark.sparkContext.setJobGroup("observed", "")
    left.write.parquet(f"{tmp_path}/kept")
    told = seen.get
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert told == {"seen": 1000, "odd": 450, "small": 50, "kept": 500} and spark.read.parquet(f"{tmp_path}/kept").count() == 500


# -- a scan after a scan -------------------------------------------------------------------------


def test_rescan_reads_what_differs_and_equals_a_full_run(spark, tmp_path):
    every = inventory.normalise(inventory.stand_in(spark, SMALL)).cache()
    store = f"{tmp_path}/store"
    _, seen = rescan.refresh(spark, store, every)
    assert seen.get["detected"] == every.count()
    secret = F.concat("content", F.lit("\npassword = Hidden2024x"))
    changed = F.col("doc_id") % 50 == 3
    now = every.where("doc_id <> 5").withColumn("sha256", F.when(changed, F.sha2(secret, 256)).otherwise(F.col("sha256"))).withColumn("content", F.when(changed, secret).otherwise(F.col("content")))
    now = now.withColumn("principals", F.when(F.col("doc_id") == 7, F.array(F.lit("Everyone"))).otherwise(F.col("principals"))).cache()
    table, seen = rescan.refresh(spark, store, now)
    assert seen.get["detected"] == now.where(changed).count() == table.where("fresh").count()
    full = rescan.risk.assess(findings.classify(now))
    pick = lambda df: sorted((r["doc_id"], r["score"], r["level"], len(r["findings"])) for r in df.collect())
    assert pick(table) == pick(full)

    def broken(rows):
        return findings.classify(rows.withColumn("content", F.raise_error(F.lit("lost"))))

    with pytest.raises(Exception, match="lost"):
        rescan.refresh(spark, store, every.withColumn("sha256", F.lit("new")), broken)
    assert pick(rescan.current(spark, store)) == pick(table)
    assert rescan.tidy(spark, store) >= 1 and pick(rescan.current(spark, store)) == pick(table)
    assert rescan.current(spark, f"{tmp_path}/none") is None


def test_of_two_that_fill_a_folder_one_stays(spark, tmp_path):
    source = f"{SMALL}/region.parquet"
    calls = []

    def write(path):
        calls.append(path)
        if len(calls) == 1:  # another session is quicker
            stored.kept("race", source, write, spark, tmp_path)
        spark.range(3).write.parquet(path)

    path = stored.kept("race", source, write, spark, tmp_path)
    assert len(calls) == 2 and spark.read.parquet(path).count() == 3 and not stored.exists(spark, calls[0])
    assert stored.kept("race", source, write, spark, tmp_path) == path and len(calls) == 2
    assert stored.kept("race", source, write, spark, "other rules") != path


# -- streams ---------------------------------------------------------------------------------------


def test_revocations_survive_a_restart_and_expire(spark, tmp_path):
    start, schema = datetime(2024, 1, 1), "token_id string, revoked_at timestamp"
    batches = [[("a", 0), ("b", 1)], [("a", 3), (None, 3)], [("c", 6)], [("d", 30)], [("e", 31)]]
    source, table = f"{tmp_path}/source", f"{tmp_path}/table"

    def arrive(number):
        rows = [(t, start + timedelta(days=d)) for t, d in batches[number]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        with flows.set_conf(spark, *tokens.STORE):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = tokens.revocation_changes(stream, 7).writeStream.foreachBatch(sinks.append_once(table)).option("checkpointLocation", f"{tmp_path}/checkpoint")
            query.trigger(availableNow=True).start().awaitTermination()

    for number in range(len(batches)):  # each run is a new query from the same checkpoint
        arrive(number)
        run()
    changes = sinks.appended(spark, table, tokens.CHANGE)
    got = sorted((r["token_id"], (r["until"] - start).days, r["change"]) for r in changes.collect())
    assert got == [("a", 7, "revoked"), ("a", 10, "expired"), ("a", 10, "revoked"), ("b", 8, "expired"), ("b", 8, "revoked"), ("c", 13, "expired"), ("c", 13, "revoked"), ("d", 37, "revoked"), ("e", 38, "revoked")]
    at = lambda day: sorted(r[0] for r in tokens.revoked_at_moment(changes, F.lit(start + timedelta(days=day))).collect())
    assert at(7.5) == ["a", "b", "c", "d", "e"] and at(9) == ["a", "c", "d", "e"] and at(20) == ["d", "e"]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    table = f"{tmp_path}/log"
    assert sinks.appended(spark, table, "id long").count() == 0
    put, other = sinks.append_once(table), sinks.append_once(table, "second")
    for number in (0, 1, 1, 0):
        put(spark.range(number * 10, number * 10 + 5), number)
    other(spark.range(100, 101), 0)
    assert sorted(r[0] for r in sinks.appended(spark, table, "id long").collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 100]
    assert not [n for n in os.listdir(table) if n.startswith(".") and not n.endswith(".crc")]


# -- reports -----------------------------------------------------------------------------------------


def test_reports_of_any_shape(spark):
    moment = datetime(2024, 1, 1)
    rows = [(1, 1, moment, '{"summary": {"critical": 3, "total_files": 9}}'), (1, 2, moment, '{"version": 2, "scan": {"counts": {"critical": "4"}}}'), (1, 3, moment, "[1, 2]"), (1, 4, moment, "{broken"), (1, 5, moment, None)]
    kept = report_store.parsed(spark.createDataFrame(rows, "tenant_id long, scan_id long, created_at timestamp, report string"))
    assert [r["scan_id"] for r in kept.where("broken").collect()] == [4]
    kept = kept.drop("broken")
    later = [(1, 1, moment + timedelta(days=1), '{"version": 3, "critical_files": 8, "total": 2}'), (1, 1, moment, '{"critical_files": 5}'), (2, 1, moment, "{}")]
    new = report_store.parsed(spark.createDataFrame(later, "tenant_id long, scan_id long, created_at timestamp, report string")).drop("broken")
    out = {(r["tenant_id"], r["scan_id"]): (r["generation"], r["critical"], r["total_files"]) for r in report_store.counters(report_store.keep_last(kept, new)).collect()}
    assert out == {(1, 1): (3, 8, 2), (1, 2): (2, 4, 0), (1, 3): (1, 0, 0), (1, 4): (1, 0, 0), (1, 5): (1, 0, 0), (2, 1): (1, 0, 0)}


# -- archives ------------------------------------------------------------------------------------------


def test_archives_are_read_in_pieces_under_caps(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
        z.writestr("third.zip", b"PK")
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", "one")
        z.writestr("zeros.bin", bytes(3 << 20))
        z.writestr("inner.ZIP", inner.getvalue())
        z.mkdir("folder")
    (tmp_path / "broken.zip").write_bytes(b"not an archive")
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)
    names = ["a.zip", "broken.zip", "missing.txt", "large.bin", None]
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    found = {r["entry"]: r for r in inflate.contents(spark.createDataFrame([(n,) for n in names], "path string"), str(tmp_path)).collect()}
    assert found["a.zip::one.txt"]["sha256"] == hashlib.sha256(b"one").hexdigest() and found["a.zip::zeros.bin"]["protection"] == "archive_limit"
    assert found["a.zip::inner.ZIP::deep.txt"]["preview"] == "deep" and found["a.zip::inner.ZIP::third.zip"]["protection"] is None
    assert found["broken.zip"]["protection"] in (None, "bad_archive") and found["missing.txt"]["protection"] == "unreadable"
    assert found["large.bin"]["entry_size"] == 3 << 30 and resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 1 << 20
    shutil.rmtree(tmp_path)


def test_inner_archive_of_a_repeated_line_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Vich. " * 20_000, "en", "web", 120_000), (2, "plain", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["entry"]: r["size"] for r in catalogue.QUERIES["archive_entries"](spark, str(tmp_path)).collect()}
    assert found["/part_0.zip::inner.zip::doc_1.csv"] == found["/part_0.zip::doc_1.csv"] > 120_000 and len(found) == 3


# -- one pass ------------------------------------------------------------------------------------------


def test_seven_rollups_from_one_scan(spark):
    found = rollups.dashboard(catalogue.assessed(spark, SMALL))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    rows = found.collect()
    own = {r["value"]: (r["files"], r["critical"], r["high"], r["score"]) for r in rows if r["rollup"] == "department"}
    assert own == {r["department"]: (r["files"], r["critical"], r["high"], r["score"]) for r in rollups.by_department(catalogue.assessed(spark, SMALL)).collect()}
    assert {r["rollup"] for r in rows} == {"department", "folder", "label", "level", "bucket", "finding", "category"}


def test_files_of_a_walk_are_dealt_out(spark, tree):
    """Paths take a few bytes, so Spark would put them all into one part, whose task then reads every file."""
    found = walk.walk(spark, str(tree), depth=None, include_system=True, include_skipped=True).where("NOT is_folder")
    assert found.count() > 2
    parts = lambda rows: rows.groupBy(F.spark_partition_id().alias("part")).count().count()
    assert parts(inflate.contents(found.select("path"), str(tree))) > 1 and parts(walk.contents(found, str(tree))) > 1


def test_revocations_are_rows_of_microseconds():
    """A token's rows need no frame, and its moments no zone."""

    class Held:
        now = None
        get = lambda self: self.now

        def update(self, value):
            self.now = value

    kept = tokens.Revocations(1)
    kept.until, timers, day = Held(), [], 86_400_000_000
    kept.handle = type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    assert [tuple(r) for r in kept.handleInputRows(("a",), iter([Row(moment=5), Row(moment=7)]), None)] == [("a", day + 7, "revoked")]
    assert list(kept.handleInputRows(("a",), iter([Row(moment=6)]), None)) == [] and timers == [(day + 7) // 1000] and kept.until.now == (day + 7,)
