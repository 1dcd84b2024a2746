"""Archives written and read back, whole and damaged, against plain versions."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kilnflow.llm import warc
from kilnflow.llm.queries import WARC_SQL, op11_warc

LONG = "<p>long enough é</p>" * 60
PAGES = [
    (1, "https://a.example/1", LONG),
    (9, "https://a.example/9", LONG),
    (5, None, LONG),
    (None, "https://a.example/null", LONG),
    (9, "https://a.example/9", LONG),
    (2, "https://a.example/2", "short"),
    (3, "https://a.example/3", "short"),
    (4, "https://a.example/a b\r\nX: y é", None),
    (6, "https://a.example/6", ""),
    (7, "https://a.example/7", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" * 40),
    (8, "https://a.example/8", "x" * 3_000_000 + "漢字🙂"),
    (None, None, "y" * 2000),
    (None, None, "y" * 2000),
]
SCHEMA = "page_id long, url string, html string"


def plain(pages):
    tops = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            tops[data] = max(i, tops.get(data, i))
    rows = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        top = tops.get(data) if len(data) >= 1000 else None
        again = top is not None and top != i
        rows[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    return rows


def read(spark, path):
    rows = warc.records(warc.read_archives(spark, str(path)))
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.warc_type, r.refers_to) for r in rows.collect())


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("archive_bytes", [1, 1 << 25])
def test_round_trip(spark, tmp_path, compress, archive_bytes):
    pages = spark.createDataFrame(PAGES, SCHEMA).select("*", F.lit(1).alias("n"), F.lit("x").alias("digest"), F.lit(0).alias("salt")).repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=archive_bytes, compress=compress)
    assert read(spark, tmp_path / "w") == plain(PAGES)
    rows = warc.read_archives(spark, str(tmp_path / "w"))
    assert warc.gaps(rows).isEmpty()
    texts = Counter(bytes(r.payload) for r in rows.filter("warc_type = 'response'").collect())
    assert set(texts) == {(h or "").encode() for _, _, h in PAGES}
    assert rows.filter("page_id = 4").first().target_uri == "https://a.example/a%20b%0D%0AX:%20y%20%C3%A9"
    assert rows.filter("warc_type = 'revisit' AND page_id IS NOT NULL").select("refers_to").distinct().collect() == [(9,)]


def test_whole_files_are_plain_gzip(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), str(tmp_path / "w"))
    import gzip

    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        assert not data or gzip.decompress(data).startswith(b"WARC/1.1\r\n") and gzip.decompress(data).endswith(b"\r\n\r\n")


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_query_reads_the_pages(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({WARC_SQL})").fetchall())
    assert Counter(tuple(r) for r in op11_warc(spark, sf_dir).select(*names).collect()) == want


# --- damage ------------------------------------------------------------------


def make(n=6, compress=True):
    raw = [warc.record_bytes(i, f"https://x.example/{i}", (f"page {i} " * (50 + i)).encode(), len(f"page {i} " * (50 + i)), hashlib.sha1((f"page {i} " * (50 + i)).encode()).hexdigest(), False, None, "2024-01-01T00:00:00Z") for i in range(n)]
    return [zlib.compress(r, 6, wbits=31) if compress else r for r in raw]


def outcome(data):
    """Ids of the records found, and the gaps; what is returned covers the whole archive."""
    found, gaps, at = [], [], 0
    for x in warc.salvage(data):
        assert x.offset == at
        at += x.length
        if isinstance(x, warc.Gap):
            gaps.append((x.offset, x.length, x.reason))
        else:
            found.append(x.fields["warc-record-id"])
    assert at == len(data)
    return [int(i[len("<urn:kilnflow:page:") : -1]) for i in found], gaps


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_the_damaged_records_only(compress):
    parts = make(compress=compress)
    data, starts = b"".join(parts), [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    assert outcome(data) == (list(range(6)), [])
    block = 10 if compress else parts[2].index(b"\r\n\r\n") + 4
    for place in range(starts[2], starts[3], 7):  # a wrong byte anywhere in the third record
        rows = list(warc.salvage(data[:place] + bytes([data[place] ^ 0x55]) + data[place + 1 :]))
        ids = [int(x.fields["warc-record-id"][-2]) for x in rows if isinstance(x, warc.Record) and x.offset != starts[2]]
        assert ids == [0, 1, 3, 4, 5] and rows[2].offset == starts[2] and rows[2].length == len(parts[2])
        assert isinstance(rows[2], warc.Gap) or place < starts[2] + block  # plain headers have no checksum
    lost = data[: starts[1] + 30] + data[starts[4] - 25 :]  # bytes missing over several records
    found, gaps = outcome(lost)
    assert found == [0, 4, 5] and [g[:2] for g in gaps] == [(starts[1], 55)]
    assert outcome(data[:-9])[0] == [0, 1, 2, 3, 4] and outcome(data[:-9])[1][0][0] == starts[5]
    assert outcome(b"junk" + data)[0] == list(range(6)) and outcome(data + b"junk")[1][0][:2] == (len(data), 4)
    assert outcome(b"no archive at all") == ([], [(0, 17, "no version line")])


def test_every_byte_of_a_member_is_checked():
    parts = make(3)
    at = len(parts[0])
    for place in range(at + 10, at + len(parts[1])):  # after the member's header
        data = b"".join(parts)
        found, gaps = outcome(data[:place] + bytes([data[place] ^ 1]) + data[place + 1 :])
        assert found == [0, 2] and len(gaps) == 1


def test_records_between_both_kinds_and_inside_payloads():
    inner = make(1, compress=False)[0]
    outer = warc.record_bytes(70, None, inner, len(inner), hashlib.sha1(inner).hexdigest(), False, None, "2024-01-01T00:00:00Z")
    mixed = make(2)[0] + outer + make(2)[1] + zlib.compress(b"", wbits=31)
    records = list(warc.salvage(mixed))
    assert [r.fields["warc-record-id"] for r in records] == ["<urn:kilnflow:page:0>", "<urn:kilnflow:page:70>", "<urn:kilnflow:page:1>"]
    assert records[1].payload == inner


def test_foreign_records():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    fields = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Folded: a\r\n b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
    data = fields % len(block) + block + b"\r\n\r\n"
    (record,) = warc.salvage(data)
    assert record.payload == b"body" and record.fields["x-folded"] == "a b" and record.payload_digest == hashlib.sha1(b"body").hexdigest()
    (gap,) = warc.salvage(data.replace(b"Content-Length: 29", b"Content-Length: 28").replace(b"Content-Length: %d" % len(block), b"Content-Length: 5"))
    assert gap.reason == "length"


def test_gaps_of_damaged_files(spark, tmp_path):
    parts = make()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(parts[:2]) + b"\0" * 40 + b"".join(parts[2:]))
    (tmp_path / "a" / "two.warc.gz").write_bytes(b"".join(parts)[:-3])
    rows = warc.read_archives(spark, str(tmp_path / "a"))
    log = warc.gaps(rows).orderBy("archive").collect()
    assert [(r.length, r.gap) for r in log] == [(40, "no version line"), (len(parts[5]) - 3, "member cut off")]
    assert Counter(r.page_id for r in warc.records(rows).collect()) == Counter({0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1})
