"""Archives: round trip, revisits, salvage of damaged bytes."""

import base64
import gzip
import hashlib
from collections import Counter

from tessella.llm import warc


def pages_of(spark):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/\r\nX: y", "<p>é</p>"), (2, None, None), (9, "u", ""), (4, "http://c/", "x" * 70000), (None, "n", "lone"), (5, "d", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "e", "twice"), (6, "e", "twice"), (None, "n", "twice")]
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, payload string, row int"), rows


def expected(rows):
    least = {}
    for page, _, html in rows:
        least.setdefault(html or "", []).append(page)
    first = {h: min((p for p in ids if p is not None), default=None) for h, ids in least.items()}
    seen, out = set(), Counter()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        kind = ("revisit", first[html or ""]) if (html or "") in seen else ("response", None)
        seen.add(html or "")
        out[(page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), *kind)] += 1
    return out


def test_round_trip(spark, monkeypatch):
    pages, rows = pages_of(spark)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for roll in (4_000_000, 1):
        monkeypatch.setattr(warc, "ROLL", roll)
        got = warc.read_archives(warc.write_archives(pages)).collect()
        assert Counter(tuple(r[c] for c in columns) for r in got) == expected(rows)
        assert all(r.gap is None for r in got)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for *_, h in rows}
    assert warc.write_archives(pages.limit(0)).count() == 0
    loose = warc.read_archives(warc.write_archives(pages, least_bytes=6)).collect()
    assert Counter(r.record_type for r in loose) == Counter(response=9, revisit=1)


def records(n):
    return [warc.write_record(i, i, f"http://h/{i}", f"page {i} ".encode() * 50) for i in range(n)]


def ids(found):
    return [r["page_id"] for _, _, r, _ in found if r]


def gaps(found):
    return [(a, b) for a, b, r, _ in found if r is None]


def test_salvage_of_compressed_members():
    members = [warc.member(r) for r in records(6)]
    starts = [sum(map(len, members[:k])) for k in range(7)]
    data = bytearray(b"".join(members))
    data[starts[2] + 30 : starts[2] + 34] = b"\0\0\0\0"
    found = list(warc.salvage(bytes(data)))
    assert ids(found) == [0, 1, 3, 4, 5] and gaps(found) == [(starts[2], starts[3])]
    found = list(warc.salvage(b"junk" + bytes(data[:-9])))
    assert ids(found) == [0, 1, 3, 4] and gaps(found) == [(0, 4), (4 + starts[2], 4 + starts[3]), (4 + starts[5], len(data) - 5)]
    assert list(warc.salvage(b"")) == []
    assert [x[3] for x in warc.salvage(b"no archive at all")] == ["no version line"]


def test_salvage_inside_a_member():
    import random

    r = random.Random(2)
    plain = [warc.write_record(i, i, f"http://h/{i}", f"page {i} ".encode() + r.randbytes(9000)) for i in range(6)]
    hurt = b"".join(plain).replace(b"page 2 ", b"pagE 2 ", 1)
    for level in (0, 6):
        whole = gzip.compress(hurt, level)
        found = list(warc.salvage(whole + warc.member(records(8)[7])))
        assert ids(found) == [0, 1, 3, 4, 5, 7] and gaps(found) == [(0, len(whole))]
        good = gzip.compress(b"".join(plain), level)
        cut = good[: len(good) * 3 // 4]
        found = list(warc.salvage(cut))
        assert ids(found) == [0, 1, 2, 3] and gaps(found) == [(0, len(cut))]
        found = list(warc.salvage(cut + warc.member(records(8)[7])))
        assert ids(found) == [0, 1, 2, 3, 7] and gaps(found) == [(0, len(cut))]
        found = list(warc.salvage(good[:-8] + b"12345678" + warc.member(records(8)[7])))
        assert ids(found) == [0, 1, 2, 3, 4, 5, 7] and gaps(found) == [(0, len(good))]


def test_salvage_of_plain_records():
    plain = records(5)
    starts = [sum(map(len, plain[:k])) for k in range(6)]
    data = b"".join(plain)
    assert ids(warc.salvage(data)) == [0, 1, 2, 3, 4]
    hurt = data.replace(b"page 1 page 1", b"pagE 1 page 1", 1)
    found = list(warc.salvage(hurt))
    assert ids(found) == [0, 2, 3, 4] and gaps(found) == [(starts[1], starts[2])]
    found = list(warc.salvage(data[: starts[3] + 40] + data[starts[4] :]))
    assert ids(found) == [0, 1, 2, 4] and gaps(found) == [(starts[3], starts[3] + 40)]


def test_reads_files_and_several_records_in_a_member(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records(3))) + gzip.compress(records(1)[0]))
    (tmp_path / "b.warc").write_bytes(b"".join(records(2)))
    got = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert Counter(r.archive.rsplit("/", 1)[1] for r in got) == {"a.warc.gz": 4, "b.warc": 2}
