import gzip
import hashlib
import io

from tomewright.llm import queries, warc


def test_pages_come_back(spark, tmp_path):
    big, hot = "<p>" + "x" * 200, "é" * 60
    rows = [(5, "u", big), (2, "u\r\nEvil: 1", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 3_000_000), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(100 + i, "h", hot) for i in range(40)]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in queries.op6_warc_normalise(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "").encode() == raw)
        refers = first if len(raw) >= 100 and first != i else None
        assert (out[i].payload_bytes, out[i].payload_digest, out[i].refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), refers)
        assert out[i].record_type == ("revisit" if refers is not None else "response")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_warc_normalise(spark, str(tmp_path)).count() == 0


def test_every_record_becomes_a_member(tmp_path):
    records = [warc.record("response", f"urn:page:{i}", "u", b"z" * n, hashlib.sha256(b"z" * n).hexdigest(), n) for i, n in enumerate((0, 5, 3_000_000, 1))]
    for name, data in (("one", gzip.compress(b"".join(records))), ("many", b"".join(gzip.compress(r) for r in records))):
        (tmp_path / name).write_bytes(data)
        index = warc.normalise(str(tmp_path / name), str(tmp_path / f"{name}.out"), "a0")
        assert warc.read_index(str(tmp_path / f"{name}.out")) == index
        whole = (tmp_path / f"{name}.out").read_bytes()
        assert [gzip.decompress(whole[at : at + n]) for _, at, n in index] == records
        assert gzip.decompress(whole) == b"".join(records)
        with io.BytesIO(whole) as f:
            headers, record = warc.read_member(f, *index[1][1:])
        assert warc.block_of(headers, record) == b"zzzzz"


def test_null_page_ids(spark, tmp_path):
    big = "b" * 150
    rows = [(None, big), (4, big), (None, "c" * 150), (None, "c" * 150), (2, "d" * 150)]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op6_warc_normalise(spark, str(tmp_path)).collect()
    digest = {h: hashlib.sha256(h.encode()).hexdigest() for _, h in rows}
    got = sorted((str(r.page_id), r.payload_digest, r.record_type, str(r.refers_to)) for r in out)
    want = [("None", digest[big], "revisit", "4"), ("4", digest[big], "response", "None"), ("2", digest["d" * 150], "response", "None")]
    assert got == sorted([*want, *[("None", digest["c" * 150], "response", "None")] * 2])
