import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import props
from sentrylake.operators import compliance, filters, findings, history, keywords, risk, rollups
from sentrylake.sources import inventory

RECORD = (
    "doc_id long, source string, share string, path string, name string, size long, is_hidden boolean, is_system boolean, content string, principals array<string>, "
    "permissions array<string>, has_acl boolean, content_status string, scan_error string, protection_type string, protected_flag boolean, owner string, created_at timestamp, sha256 string"
)
FINDINGS = "array<struct<pos:int,type:string,risk:string,count:int,samples:array<string>,category:string,label:string>>"


def record(k, path="/x/a.txt", content="", **more):
    base = dict(
        doc_id=k, source="local", share="", path=path, name="", size=len(content or ""), is_hidden=False, is_system=False, content=content, principals=None, permissions=None, has_acl=False,
        content_status="", scan_error="", protection_type="", protected_flag=False, owner="", created_at=datetime(2024, 1, 1), sha256=f"{k}",
    )
    return tuple((base | more).values())


def assessed(spark, *rows, overrides=()):
    frame = inventory.normalise(spark.createDataFrame(list(rows), RECORD))
    return {r["doc_id"]: r for r in risk.assess(findings.classify(frame), overrides).collect()}


def folded_in_python(levels):
    total = 0
    for level in levels:
        total += {"CRITICAL": 45, "HIGH": 35, "MEDIUM": 20}.get(level, 5)
        total = max(total, {"CRITICAL": 90, "HIGH": 70}.get(level, 0))
    return total


def test_fold_depends_on_order(spark):
    cases = [c for n in range(4) for c in itertools.product(risk.LEVELS, repeat=n)]
    rows = [(k, [(p, "t", level, 1, [], None, None) for p, level in enumerate(c)]) for k, c in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"k int, findings {FINDINGS}").select("k", risk.folded("findings").alias("fold"))
    assert {r["k"]: r["fold"] for r in frame.collect()} == {k: folded_in_python(c) for k, c in enumerate(cases)}
    assert folded_in_python(["MEDIUM", "HIGH"]) == 70 and folded_in_python(["HIGH", "MEDIUM"]) == 90


def test_known_scores(spark):
    rows = assessed(
        spark, record(1, content="hello world"), record(2, content="jo@example.org"), record(3, content="password = abcdefg1"), record(4), record(5, source="smb", content="hello"),
        record(6, content="hello", principals=["CORP\\Domain Users"], permissions=["FULL_CONTROL"], has_acl=True), record(7, path="/finance/k.pem", content="x"), record(8, content=None),
    )
    assert {k: (r["score"], r["level"]) for k, r in rows.items()} == {
        1: (10, "LOW"), 2: (40, "MEDIUM"), 3: (90, "CRITICAL"), 4: (70, "HIGH"), 5: (15, "LOW"), 6: (45, "MEDIUM"), 7: (40, "MEDIUM"), 8: (70, "HIGH"),
    }
    assert rows[1]["access"]["issues"] == ["no access list"] and rows[6]["access"]["score"] == 35


def test_first_override_wins(spark):
    forced = [("", "HIGH", "x"), ("a.txt", "nonsense", "x"), ("email", "low", ""), ("/x/", "CRITICAL", "y")]
    rows = assessed(spark, record(1, content="jo@example.org"), record(2, content="hello"), overrides=forced)
    assert (rows[1]["level"], rows[1]["score"]) == ("LOW", 20) and (rows[2]["level"], rows[2]["score"]) == ("CRITICAL", 95)


def test_findings_are_ordered_capped_and_redacted(spark):
    text = " ".join(f"user{k}@mail.example.org" for k in range(15)) + "\npassword: hunter2000"
    found = findings.long_form(findings.classify(spark.createDataFrame([(1, text), (2, None)], "doc_id long, content string"))).orderBy("pos").collect()
    assert [(r["type"], r["count"]) for r in found] == [("email", 10), ("password", 1)]
    assert found[0]["samples"][0] == "use***rg" and found[1]["samples"] == ["pas***00"]


def test_scan_filter_truth_table(spark):
    flags = list(itertools.product((".a", ".b"), (False, True), (False, True)))
    frame = spark.createDataFrame(flags, "extension string, is_hidden boolean, is_system boolean")
    for ext, hidden, system, only_hidden, only_system in itertools.product(([], ["A"]), *[(False, True)] * 4):
        kept = {tuple(r) for r in frame.where(filters.scan_filter(ext, hidden, system, only_hidden, only_system)).collect()}
        expected = {
            f for f in flags
            if (not ext or f[0] == ".a") and (f[1] if only_hidden else hidden or not f[1]) and (f[2] if only_system else system or not f[2])
        }
        assert kept == expected


@pytest.mark.parametrize(
    ("path", "expected"), [("/a/b.tar.GZ", ".gz"), ("/a/.env", ".env"), ("/a/.env.local", ".local"), ("/x/Dockerfile", ".dockerfile"), ("/x/plain", ""), ("c:\\d\\e.TXT", ".txt"), ("", "")]
)
def test_extensions(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(props.extension("p")).first()[0] == expected


def test_folders_and_departments(spark):
    rows = [("s", "/s/HR_Team/x/a.txt", "local"), ("", "/q/r/s/a.txt", "local"), ("s", "/a.txt", "smb"), ("", "", "smb")]
    got = spark.createDataFrame(rows, "share string, path string, source string").select(props.department().alias("d"), props.folder().alias("f"), props.heat_group().alias("h")).collect()
    assert [tuple(r) for r in got] == [("HR Team", "s/HR_Team/x", "s"), ("r", "r/s", "s"), ("s", "s/root", "s"), ("smb", "smb", "smb")]


def test_preview(spark):
    rows = [("\r\n".join("abcdefghij"),), ("x" * 2000,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(props.preview("c")).collect()]
    assert got[0]["lines"] == list("abcdefgh") and got[0]["truncated"] and len(got[1]["lines"][0]) == 1800 and got[1]["truncated"]
    assert not got[2]["available"] and not got[3]["available"]


def test_compliance_parts(spark):
    """Scores worked out by hand: exported contacts, and a card file."""
    columns = f"doc_id long, name string, path string, share string, extension string, score int, findings {FINDINGS}, access struct<score:int,wide:boolean,writable:boolean,privileged:boolean,issues:array<string>>, is_hidden boolean, is_system boolean, protected boolean, content_status string"
    rows = [
        (1, "customers.csv", "/exports/customers.csv", "", ".csv", 55, [(1, "email", "MEDIUM", 5, [], None, None)], (20, True, False, False, []), False, False, False, "scanned"),
        (2, "cards.xlsx", "/x/cards.xlsx", "", ".xlsx", 70, [(1, "credit_card", "HIGH", 2, [], None, None)], (0, False, False, False, []), False, False, False, "scanned"),
        (3, "n.txt", "/x/n.txt", "", ".txt", 10, [], (0, False, False, False, []), False, False, False, "scanned"),
    ]
    got = {(r["doc_id"], r["framework"]): r for r in compliance.evaluate(spark.createDataFrame(rows, columns)).collect()}
    parts = lambda r: [r[c] for c in ("base", "data", "evidence", "exposure", "location", "protection", "compliance_score")]
    assert parts(got[2, "pci_dss"]) == [24, 25, 16, 0, 5, 5, 75] and got[2, "pci_dss"]["control"] == "Cardholder Data Storage Risk"
    assert parts(got[1, "gdpr"]) == [19, 17, 13, 15, 10, 5, 79] and got[1, "gdpr"]["control"] == "Unauthorized Disclosure Risk"
    assert not any(k[0] == 3 for k in got)


def test_compliance_golden_cases(spark):
    """Five files whose scores were worked out by hand from the formulas."""
    columns = f"doc_id long, name string, path string, share string, extension string, score int, findings {FINDINGS}, access struct<score:int,wide:boolean,writable:boolean,privileged:boolean,issues:array<string>>, is_hidden boolean, is_system boolean, protected boolean, content_status string"
    row = lambda k, path, ext, score, kind, level, n, category, access: (k, path.split("\\")[-1], path, "", ext, score, [(1, kind, level, n, [], category, None)], access, False, False, False, "scanned")
    rows = [
        row(1, "C:\\Exports\\customers.csv", ".csv", 55, "email", "MEDIUM", 5, None, (20, True, False, False, [])),
        row(2, "C:\\Finance\\cardholder-data.xlsx", ".xlsx", 70, "credit_card", "HIGH", 2, None, (0, False, False, False, [])),
        row(3, "C:\\Health\\patient-notes.docx", ".docx", 75, "phi_context", "HIGH", 1, None, (35, True, True, False, [])),
        row(4, "C:\\HR\\names.txt", ".txt", 20, "gdpr_full_name", "LOW", 1, "pii", (0, False, False, False, [])),
        row(5, "C:\\Desktop\\medical.xlsx", ".xlsx", 90, "gdpr_health_medical_record", "HIGH", 4, "phi", (35, True, True, False, [])),
    ]
    frame = spark.createDataFrame(rows, columns)
    got = {(r["doc_id"], r["framework"]): r for r in compliance.evaluate(frame, ["GDPR", "pci-dss", "hipaa", "gdpr"]).collect()}
    parts = lambda k, f: [got[k, f][c] for c in ("base", "data", "evidence", "exposure", "location", "protection", "compliance_score")]
    assert parts(1, "gdpr") == [19, 17, 13, 15, 10, 5, 79]
    assert parts(2, "pci_dss") == [24, 28, 16, 0, 5, 5, 78]
    assert parts(3, "hipaa") == [26, 24, 15, 20, 0, 5, 90]
    assert parts(4, "gdpr") == [7, 18, 4, 0, 0, 5, 34]
    assert parts(5, "gdpr") == [31, 27, 18, 20, 10, 5, 100]
    with pytest.raises(ValueError, match="unknown"):
        compliance.evaluate(frame, ["gdpr", "nothing"])


def test_compliance_summary_and_evidence(spark):
    rows = risk.assess(findings.classify(inventory.normalise(spark.createDataFrame([record(1, "/exports/a.csv", "mail a@b.org salary 4111 1111 1111 1111"), record(2)], RECORD))))
    one = compliance.summary(rows, ["gdpr"]).first()
    assert one["enabled"] and one["total_compliance_findings"] == 1 and [x["doc_id"] for x in one["top_risky_files"]] == [1]
    assert one["top_violated_categories"][0]["files"] == 1 and not compliance.summary(rows, ["gdpr"], enabled=False).first()["enabled"] and not compliance.summary(rows, []).first()["enabled"]
    every = {r["doc_id"]: r for r in compliance.per_file(compliance.evaluate(rows), rows).collect()}
    assert (every[2]["score"], every[2]["severity"], every[2]["criticality"]) == (0, "NONE", "none") and every[1]["score"] > 0
    shown = [r for r in compliance.evidence(rows).collect() if r["type"] == "email"]
    assert shown[0]["label"] == "Email" and "Personal data" in shown[0]["data_types"]
    advice = {r["doc_id"]: r["a"] for r in rows.select("doc_id", risk.recommendations().alias("a")).collect()}
    assert any("payment" in a for a in advice[1]) and advice[2]
    assert risk.rule_catalogue(spark).count() >= 20


def test_posture_rounds_half_to_even_and_half_up(spark):
    one = spark.createDataFrame([(2, 1, 0, 0, 1), (0, 0, 0, 0, 0), (200, 101, 0, 99, 0)], "total_files long, critical long, high long, medium long, low long")
    assert [r[0] for r in one.select(rollups.posture_from_counts()).collect()] == [42, 100, 25]
    assert rollups.posture_from_files(spark.createDataFrame([(57,), (58,)], "score int")).first()[0] == 42
    assert rollups.posture_from_files(spark.createDataFrame([], "score int")).first()[0] == 100


def test_scans_compared(spark):
    columns = "doc_id long, source string, share string, path string, name string, sha256 string"
    now = spark.createDataFrame([(1, "l", "", "/a", "a", "H1"), (2, "l", "", "/b", "b", "h2"), (3, "l", "", "/C", "c", "h1"), (4, "l", "", "/d", "d", ""), (5, "l", "", "/A", "a", "h1")], columns)
    old = spark.createDataFrame([(1, "l", "", "/a", "a", "h0"), (2, "l", "", "/b", "b", "h2"), (9, "l", "", "/z", "z", "h9")], columns)
    assert [(r["key"], r["previous_hash"], r["current_hash"]) for r in history.changed(now, old).collect()] == [("l||/a", "h0", "h1")]
    assert [r["key"] for r in history.only_in(now, old).collect()] == ["l||/c"] and [r["key"] for r in history.only_in(old, now).collect()] == ["l||/z"]
    (group,) = history.duplicate_groups(now).collect()
    assert (group["hash"], group["files"], group["first_key"], len(group["paths"])) == ("h1", 2, "l||/a", 2)


def test_time_ranges(spark):
    rows = spark.sql("SELECT explode(array(timestamp'2024-01-19 11:59:59', timestamp'2024-01-19 12:00:00', timestamp'2024-01-20 23:59:59', timestamp'2024-01-21 00:00:00', cast(null as timestamp))) AS ts")
    now = datetime(2024, 1, 20, 12)
    count = lambda **k: filters.in_range(rows, "ts", now=now, **k).count()
    assert (count(days=1), count(days=2), count(start="2024-01-20", end="2024-01-20"), count()) == (3, 4, 1, 5)


def test_failures_in_window(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 0, 5, 11)] + [("b", datetime(2024, 1, 1))]
    got = history.failures_in_window(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 10).orderBy("k", "second").collect()
    assert [r["failures"] for r in got] == [2, 3, 2, 1]


def test_keyword_library(spark):
    columns = "framework string, language string, category string, type string, terms array<string>, ord int"
    have = spark.createDataFrame([("gdpr", "en", "pii", "mail", ["E-Mail", "inbox"], 0), ("gdpr", "de", "pii", "mail", ["Post"], 1)], columns)
    more = spark.createDataFrame([("gdpr", "en", "pii", "mail", ["inbox", "Mailbox", "mailbox"], 2), ("gdpr", "en", "pii", "name", ["Surname"], 3)], columns)
    assert tuple(keywords.preview(have, more).first()) == (2, 2)
    merged = {(r["language"], r["type"]): r["terms"] for r in keywords.apply_import(have, more).collect()}
    assert merged == {("en", "mail"): ["E-Mail", "inbox", "Mailbox"], ("de", "mail"): ["Post"], ("en", "name"): ["Surname"]}
    replaced = {(r["language"], r["type"]): r["terms"] for r in keywords.apply_import(have, more, "replace_language").collect()}
    assert replaced == {("en", "mail"): ["inbox", "Mailbox"], ("de", "mail"): ["Post"], ("en", "name"): ["Surname"]}
    text = spark.createDataFrame([(' * "full name" ; nick,\tnick | ',)], "t string").select(keywords.split_terms(F.col("t"))).first()[0]
    assert text == ["full name", "nick"]
