import gzip
import hashlib
from collections import Counter

from semloom.llm import warc


def brute(pages):
    out = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        top = max(same, default=None)
        revisit = len(data) >= 1000 and top is not None and i != top
        out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    return out


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    pages = [(i, f"http://{'www.' * (i % 3)}h{i % 7}.example.com/p{i % 11}?q=é#f", "x" * (i % 5) * 700 + ("é\r\n\r\n" if i % 2 else "")) for i in range(150)]
    pages += [(900, None, None), (901, "no url", ""), (902, "http://a b\n.com/\tc", "y" * 1000), (903, "http://z.com", "y" * 1000), (None, "http://z.com", "y" * 1000), (None, None, "z"), (7, pages[7][1], pages[7][2]), (7, pages[7][1], pages[7][2])]
    pages += [(904, "http://h.com/", "w" * 999), (905, "http://h.com/", "w" * 999)] + [(-3, "http://same.com/", f"{i}") for i in range(20)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    captures, ranges = warc.archive(df, str(tmp_path))
    rows = warc.read_back(captures.select("entry"), ranges, str(tmp_path)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(pages)
    whole = Counter((r.page_id, r.payload and bytes(r.payload)) for r in rows if r.record_type == "response")
    assert all(k in {(i, (h or "").encode()) for i, _, h in pages} for k in whole)
    found = sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in tmp_path.glob("*.warc.gz"))
    assert found == len(pages) == captures.count()
    assert warc.read_back(spark.createDataFrame([("com,nobody) 1",)], "entry string"), ranges, str(tmp_path)).count() == 0
    captures, ranges = warc.archive(df.limit(0), str(tmp_path / "none"))
    assert warc.read_back(captures.select("entry"), ranges, str(tmp_path / "none")).count() == 0
