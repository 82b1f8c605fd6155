import gzip
import hashlib
import io
import random

import duckdb
import pytest

from veritab.llm import op11_warc as op11
from veritab.llm.op11_warc import chunked, decided, read_archives, records_of, resolved, write_archives

SCHEMA = "page_id long, url string, html string, digest string, chunk string, record string, bytes string, upto string"


def odd_pages(spark):
    rnd = random.Random(3)
    body = "".join(rnd.choice("abc é日\r\n<p>") for _ in range(3000))
    rows = [(1, "http://a/", body), (2, "http://b/", body), (9, None, body), (None, "http://n/", body), (9, None, body), (3, "http://c/x\r\ny z", None),
            (4, "", ""), (5, "http://d/", "x" * 999), (6, "http://d/", "x" * 999), (7, "http://e/", "y" * 1000), (8, "http://f/", "y" * 1000),
            (10, "http://g/", "\r\n\r\nWARC/1.1\r\n" * 200), (11, "http://h/", "long " * 300_000), (None, None, None)]
    return spark.createDataFrame([(*r, "d", "c", "r", "b", "u") for r in rows], SCHEMA)


def brute(rows):
    """What each page should be: the largest page_id of equal payloads of 1000 bytes stays."""
    out, best = [], {}
    data = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    for i, (p, x) in enumerate(data):
        if len(x) >= 1000 and (x not in best or (p if p is not None else -1) > (data[best[x]][0] if data[best[x]][0] is not None else -1)):
            best[x] = i
    for i, (p, x) in enumerate(data):
        again = len(x) >= 1000 and best[x] != i
        out.append((p, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", data[best[x]][0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1000, 1 << 18])
def test_archives_round_trip(spark, tmp_path, size):
    pages = odd_pages(spark).repartition(3)
    chunks = chunked(pages, size)
    assert chunks.selectExpr("max(octet_length(bytes))").first()[0] <= size
    manifest = write_archives(chunks, decided(chunks), str(tmp_path / "warc"))
    read = read_archives(manifest, size=size).cache()
    got = read.filter("last").select("page_id", "upto", "digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd_pages(spark).collect())
    short = read_archives(manifest, payloads=False).select(*got.columns)
    assert short.exceptAll(got).isEmpty() and got.exceptAll(short).isEmpty()
    content = {}
    for r in resolved(read).orderBy("record_id", "chunk").collect():
        text, sha = content.setdefault((r.record_id, r.page_id, r.url), (bytearray(), hashlib.sha1()))
        text.extend(r.bytes)
        sha.update(r.bytes)
        assert (len(text), sha.hexdigest()) == (r.upto, r.digest)
    expected = sorted(((p, u and op11.target(u), (h or "").encode()) for p, u, h, *_ in odd_pages(spark).collect()), key=str)
    assert sorted(((p, u, bytes(x)) for (_, p, u), (x, _) in content.items()), key=str) == expected


def test_files_are_plain_warc(spark, tmp_path):
    chunks = chunked(odd_pages(spark).repartition(2))
    manifest = write_archives(chunks, decided(chunks), str(tmp_path / "warc")).collect()
    assert sum(r.n_records for r in manifest) == 14
    for r in manifest:
        with gzip.open(r.path) as file:
            data = file.read()
        seen = 0
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert data[n: n + 4] == b"\r\n\r\n"
            data, seen = data[n + 4:], seen + 1
        assert seen == r.n_records


def test_damage_is_found(spark, tmp_path):
    chunks = chunked(odd_pages(spark).coalesce(1))
    (row,) = write_archives(chunks.coalesce(1), decided(chunks), str(tmp_path / "warc")).filter("n_records > 1").limit(1).collect()
    data = gzip.open(row.path).read()
    for wrong in (data[:-2], data[:-40], data.replace(b"WARC/1.1", b"XARC/1.1", 1), data.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1)):
        with pytest.raises(ValueError):
            for _, payload in records_of(io.BytesIO(gzip.compress(wrong))):
                list(payload)
    with open(row.path, "wb") as file:
        file.write(gzip.compress(data.replace(b"long long", b"long lung", 1)))
    with pytest.raises(Exception, match="damaged"):
        read_archives(spark.createDataFrame([row]), payloads=False).collect()


def test_no_pages(spark, tmp_path):
    chunks = chunked(odd_pages(spark).limit(0))
    manifest = write_archives(chunks, decided(chunks), str(tmp_path / "warc"))
    assert manifest.isEmpty() and read_archives(manifest).isEmpty()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op11.op11_warc(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(op11.ORACLE).fetchall())
    assert len(got) == 250
