import base64
import hashlib

import pytest

from lectern.llm.warc import locate, read_records, typed_pages, warc_record, parse_record, write_packages
from lectern.llm.zipfiles import Package, package
from lectern.plans.stage import fresh_path


@pytest.mark.parametrize("zip64", [False, True])
def test_package_round_trip(zip64, tmp_path):
    import zipfile

    members = [("a/é.txt", b"hello"), ("empty", b""), ("big", bytes(range(256)) * 500)]
    data = package(members, zip64)
    path = tmp_path / "x.zip"
    path.write_bytes(data)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    reads = []
    p = Package(lambda at, n: reads.append(n) or data[at : at + n], len(data))
    assert [(m, p.content(p.members[m])) for m in p.members] == members
    assert data[p.start(p.members["a/é.txt"]) :][:5] == b"hello"


def test_foreign_package(tmp_path):
    import zipfile

    path = tmp_path / "y.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("s", b"stored" * 99)
        z.writestr("d", b"deflated" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"
    data = path.read_bytes()
    p = Package(lambda at, n: data[at : at + n], len(data))
    assert p.content(p.members["s"]) == b"stored" * 99 and p.content(p.members["d"]) == b"deflated" * 99
    with pytest.raises(ValueError):
        Package(lambda at, n: b"x" * n, 100)


def test_record_round_trip():
    r = parse_record(warc_record(5, "http://a/\r\nX: y", "é".encode(), None))
    assert (r["page_id"], r["payload"], r["record_type"], r["refers_to"]) == (5, "é".encode(), "response", None) and "\n" not in r["url"]
    r = parse_record(warc_record(-5, None, b"abc", 3))
    assert (r["page_id"], r["payload_bytes"], r["payload"], r["record_type"], r["refers_to"]) == (-5, 3, None, "revisit", 3)


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("zip64,least", [(False, 0), (True, 4)])
def test_pages_round_trip(spark, zip64, least):
    long = "<p>ü\r\n\r\n" * 40_000
    rows = [(1, "http://a", "<x>"), (2, "http://b", "<y>é"), (3, None, "<x>"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "v", long), (2, "w", "<y>é"), (8, "u", "<y>é"), (None, "n", "<x>"), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, sha string, n int").repartition(3)
    packages = write_packages(typed_pages(pages, least), fresh_path(spark, "t"), 4096, zip64)
    got = read_records(locate(packages)).collect()
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != i
        want.append((i, len(b), sha(b), "revisit" if again else "response", first[b] if again else None, None if again else b))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got), key=str) == sorted(want, key=str)
    assert packages.agg({"records": "sum"}).first()[0] == len(rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_records(locate(write_packages(typed_pages(pages), fresh_path(spark, "t")))).count() == 0


def test_several_members_and_a_failed_write(spark, tmp_path):
    """A foreign package with two archives and two indexes; and a write that fails leaves no package behind."""
    import gzip
    import json

    members = []
    for k, ids in enumerate(((1, 2), (3,))):
        raws = [gzip.compress(warc_record(i, f"http://h/{i}", b"p%d" % i, None)) for i in ids]
        lines = [json.dumps({"offset": str(sum(map(len, raws[:n]))), "length": str(len(r)), "filename": f"d{k}.warc.gz"}) for n, r in enumerate(raws)]
        members += [(f"archive/d{k}.warc.gz", b"".join(raws)), (f"indexes/i{k}.cdxj", "".join(f"com,h)/ 2024 {x}\n" for x in lines).encode())]
    (tmp_path / "foreign.wacz").write_bytes(package(members))
    paths = spark.createDataFrame([(f"file://{tmp_path}/foreign.wacz",)], "path string")
    assert sorted((r.page_id, bytes(r.payload)) for r in read_records(locate(paths)).collect()) == [(1, b"p1"), (2, b"p2"), (3, b"p3")]
    rows = spark.range(40).selectExpr("id as page_id", "'u' as url", "if(id = 39, cast(raise_error('lost') as string), repeat('x', 500)) as html", "cast(null as bigint) as refers_to").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        write_packages(rows, f"file://{tmp_path}/out")
    assert not list(tmp_path.glob("out/*.wacz"))
