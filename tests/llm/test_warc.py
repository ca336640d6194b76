import io
from collections import Counter

import pytest

from sitequill.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, digest string")


def brute(rows):
    first = {}
    for i, _, html in rows:
        key = html or ""
        first[key] = min((x for x in (first.get(key), i) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = first[html or ""] == i
        out.append((i, len(data), warc.payload_digest(data), "response" if same else "revisit", None if same else first[html or ""]))
    return Counter(out)


ROWS = [
    (1, "https://a.example/x y\r\nWARC/1.1", "<p>é😀</p>"), (2, None, "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""),
    (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n"), (7, "u", "é" * 100_000), (8, "u", "é" * 100_000),
    (9, "u", "x" * warc.CHUNK), (9, "u", "x" * warc.CHUNK), (None, "u", "orphan"), (None, "u", "same"), (None, None, None),
    (10, "u", "y" * warc.SEGMENT * 3), (10, "u", "y" * warc.SEGMENT * 3),
]


def test_round_trip(spark, tmp_path):
    got = warc.round_trip(pages(spark, ROWS), str(tmp_path / "a")).collect()
    assert Counter(map(tuple, got)) == brute(ROWS)
    read = warc.read_archives(spark, str(tmp_path / "a"))
    payloads = {bytes(r.payload).decode() for r in read.where("kind = 'response'").collect()}
    assert payloads == {html or "" for _, _, html in ROWS}
    assert read.where("not complete").count() == 0


def test_empty_table_and_least_size(spark, tmp_path):
    assert warc.round_trip(pages(spark, []), str(tmp_path / "e")).collect() == []
    warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), str(tmp_path / "l"), least=5)
    kinds = Counter(r.kind for r in warc.read_archives(spark, str(tmp_path / "l")).collect())
    assert kinds == {"response": 3, "revisit": 1}


def test_segments_of_other_files_out_of_order_and_missing(spark, tmp_path):
    parts = warc.response_records(1, "u", b"z" * 100_000)
    assert len(parts) > 3
    for n, order in enumerate(([3, 0], [2, 1])):
        (tmp_path / f"f{n}.warc").write_bytes(b"".join(parts[i] + b"\r\n\r\n" for i in order))
    row = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.complete, bytes(r.payload)) for r in row] == [(True, b"z" * 100_000)]
    other = tmp_path / "missing"
    other.mkdir()
    (other / "f.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in parts[:-2] + parts[-1:]))
    assert [(r.complete, r.payload) for r in warc.read_archives(spark, str(other)).collect()] == [(False, None)]


def test_chunks():
    for data in (b"", b"a", b"ab\r\n0\r\n\r\n" * 9000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    for broken in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcX0\r\n\r\n"):
        assert warc.unchunked(broken) is None
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"not a record\r\n")))
