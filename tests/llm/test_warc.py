import io

from sentrylake.llm.warc import archive, decide, frames, read, record, round_trip


def test_round_trip(spark, tmp_path):
    long_page = "<p>ü</p>" * 300
    rows = [(1, "http://a/1", long_page), (2, "http://a/2", long_page), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "x" * 999), (6, "http://a/6", "x" * 999), (7, "u v", long_page + "!"), (None, "n", long_page), (2, "http://a/2", long_page), (8, "http://a/8", "\r\n\r\nWARC/1.1" + "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    index, folder = archive(pages, f"file://{tmp_path}/warc")
    back = read(index.select("archive").distinct(), folder).toPandas()
    assert len(back) == len(rows)
    own = back.dropna(subset=["page_id"]).drop_duplicates("page_id").set_index("page_id")
    assert own.record_type[1] == "revisit" and own.refers_to[1] == 2 and own.record_type[2] == "response"
    assert (own.record_type[[3, 4, 5, 6, 7, 8]] == "response").all() and own.html[8] == rows[-1][2] and own.html[2] == long_page
    assert own.payload_bytes[1] == len(long_page.encode()) and own.payload_bytes[3] == 0 and own.payload_digest[1] == own.payload_digest[2]
    assert (back[back.page_id.isna()].record_type == "revisit").all()
    # one record alone, from its offset and the dictionary
    entry = index.where("page_id = 7").first()
    with open(f"{tmp_path}/warc/{entry['archive']}", "rb") as f:
        head = f.read(8)
        dictionary = f.read(int.from_bytes(head[4:], "little"))
        f.seek(entry["offset"])
        alone = f.read(entry["length"])
    assert head[:4] == b"\x5d\x2a\x4d\x18"
    (raw,) = frames(io.BytesIO(head + dictionary + alone))
    assert b"urn:x-page:7" in raw and (long_page + "!").encode() in raw


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_record_has_no_payload_when_it_revisits():
    row = {"page_id": 1, "url": "http://x", "html": "body", "payload_digest": "00" * 20, "record_type": "revisit", "refers_to": 2}
    raw = record(row, "2000-01-01T00:00:00Z")
    assert b"body" not in raw and b"Content-Length: 4\r\n" in raw and b"WARC-Refers-To: <urn:x-page:2>" in raw


def test_decisions_are_the_same_without_a_broadcast(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "y" * (990 + k % 20)) for k in range(200)], "page_id long, url string, html string")
    columns = ["page_id", "payload_digest", "record_type", "refers_to"]
    one, two = (decide(pages, most_broadcast=n).select(columns) for n in (10**6, 0))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert one.where("record_type = 'revisit'").count() == 90
