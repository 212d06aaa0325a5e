import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import scratch
from ledgerloom.llm.warc import assemble, base32_of_hex, parse_warc, read_records, write_warc

ROWS = [(5, "http://a.example/x?y=1#z", "<p>é</p>"), (3, "http://b.example", "<p>é</p>"), (7, None, None), (8, "no url at all", ""), (9, "http://c.example/\r\nWARC-Type: evil", "x\r\n\r\nWARC/1.1\r\n\r\n\r\n"), (10, "http://d.example/", "z" * 300_000), (11, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (5, "http://a.example/x?y=1#z", "<p>é</p>")]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", F.lit("own").alias("sha"), F.lit("own").alias("bytes"))


@pytest.mark.parametrize("least", [0, 9, 100])
def test_round_trip(spark, least):
    path = scratch(spark, "warc")
    write_warc(pages(spark, ROWS), path, least=least, file_bytes=2000)
    captures = assemble(read_records(spark, path)).collect()
    first = {}
    for i, _, h in ROWS:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    want = set()
    for i, _, h in ROWS:
        b = (h or "").encode()
        revisit = len(b) >= least and i is not None and first[b] != i
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response"))
    got = {(int(c.metadata[0].fields["pageid"]) if c.metadata[0].fields["pageid"] else None, c.response.payload_bytes, c.response.payload_digest, c.response.record_type) for c in captures}
    assert got == want
    payloads = {bytes(c.response.payload) for c in captures if c.response.record_type == "response"}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}
    ids = {c.response.record_id: c for c in captures}
    for c in captures:
        assert len(c.requests) == len(c.metadata) >= 1
        if c.response.record_type == "revisit":
            assert ids[c.response.refers_to_id].response.payload_digest == c.response.payload_digest


def test_empty_table_and_base32(spark):
    path = scratch(spark, "warc")
    write_warc(pages(spark, []), path)
    assert read_records(spark, path).count() == 0
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(50)]
    got = spark.createDataFrame([(h,) for h in hexes], "h string").select(base32_of_hex(F.col("h")).alias("b")).collect()
    assert [r.b for r in got] == [base64.b32encode(bytes.fromhex(h)).decode() for h in hexes]


def test_query_bears_odd_pages(spark, tmp_path):
    from ledgerloom.llm.warc import op9_warc

    pages(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in op9_warc(spark, str(tmp_path)).collect())
    assert ("None", 9, "response", "None") in got and ("5", 9, "revisit", "3") in got and ("11", 9, "revisit", "3") in got and ("7", 0, "response", "None") in got and ("8", 0, "revisit", "7") in got


def test_few_writers_roll_their_files(spark):
    rows = [(k, f"http://h.example/{k}", f"<p>{k % 40}</p>" * 30) for k in range(200)]
    whole, rolled = scratch(spark, "warc"), scratch(spark, "warc")
    write_warc(pages(spark, rows), whole)
    write_warc(pages(spark, rows), rolled, file_bytes=20_000, writers=2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(rolled).select("content").collect()
    assert len(files) > 10 and max(len(gzip.decompress(bytes(f.content))) for f in files) < 60_000

    def captures(path):
        return sorted((c.metadata[0].fields["pageid"], c.response.payload_digest, c.response.record_type, str(c.response.refers_to_id), len(c.requests)) for c in assemble(read_records(spark, path)).collect())

    assert captures(rolled) == captures(whole) and len(captures(whole)) == 200


def test_damage_is_an_error(spark):
    path = scratch(spark, "warc")
    write_warc(pages(spark, ROWS[:2]), path)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(f"{path}/*.gz").collect())
    assert len(list(parse_warc(data))) == 6
    for bad in (data[:-3], data[:-5], b"x" + data, data.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises((ValueError, KeyError)):
            list(parse_warc(bad))


def test_every_page_is_a_capture_of_its_own(spark, tmp_path):
    from ledgerloom.llm.warc import op9_warc

    rows = [*ROWS, (5, "http://other.example/", "<p>é</p>"), (3, "http://b.example/again", "<p>é</p>"), (7, "not null", None), (None, None, None), (None, "v", None), (None, "n", "<p>é</p>")]
    path = scratch(spark, "warc")
    write_warc(pages(spark, rows), path, file_bytes=2000)
    captures = assemble(read_records(spark, path)).collect()
    assert all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    got = [(c.metadata[0].fields["pageid"], c.response.payload_bytes, (c.response.target_uri or "").replace("%0D%0A", "\r\n")) for c in captures]
    assert sorted(got) == sorted((str(i) if i is not None else "", len((h or "").encode()), u or "") for i, u, h in rows)
    ids = [c.response.record_id for c in captures if c.response.record_type == "response"]
    assert len(ids) == len(set(ids)) and {c.response.refers_to_id for c in captures if c.response.record_type == "revisit"} <= set(ids)

    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in op9_warc(spark, str(tmp_path)).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert found == sorted((str(i), len((h or "").encode()), "revisit", str(first[h or ""])) if i is not None and first[h or ""] != i else (str(i), len((h or "").encode()), "response", "None") for i, _, h in rows)
