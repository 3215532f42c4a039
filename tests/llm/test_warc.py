"""Archives: round trips through monolithic files, single members, revisits, damage."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from reelmill.llm import warc

DATE = "2024-01-01T00:00:00Z"
SAME, LARGE = "s" * 1000, "z" * (3 << 20) + "\u00e9\r\n\r\nWARC/1.1\r\n\r\n"
PAGES = [
    (1, "http://a/", SAME), (2, "http://b/", SAME), (9, None, SAME), (None, "http://n/", SAME), (9, None, SAME),
    (3, "x\r\ny", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", LARGE), (8, "u", LARGE), (10, "u", "t" * 999), (11, "u", "t" * 999),
    (None, "m", "q" * 2000), (None, "m2", "q" * 2000),
]


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}"
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, key string").repartition(3)
    warc.write_archives(pages, f"{path}/whole", "page_id", "url", "html", DATE)
    return path, warc.normalise(spark, f"{path}/whole", f"{path}/records").persist()


def test_records_equal_pages(spark, archives):
    records = warc.read_records(archives[1], with_payload=True)
    rows = records.collect()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    wanted = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = max((p[0] for p in PAGES if p[2] == html and p[0] is not None), default=None)
        revisit = len(raw) >= 1000 and first is not None and i != first
        wanted.append((name(i), "revisit" if revisit else "response", name(first) if revisit else "", len(raw), hashlib.sha1(raw).hexdigest(), b"" if revisit else raw))
    assert sorted((r[0], r[1], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"], bytes(r["payload"] or b"")) for r in rows) == sorted(wanted)
    assert {r["target_uri"] for r in rows if r["record_id"] == name(3)} == {"x%0D%0Ay"}


def test_revisits_resolve(archives):
    rows = warc.resolve_revisits(warc.read_records(archives[1], with_payload=True)).collect()
    assert len(rows) == len(PAGES)
    assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in rows)


def test_index_gives_single_members(archives):
    entries = archives[1].collect()
    assert len(entries) == len(PAGES)
    for e in entries:
        with open(e["archive"].removeprefix("file://"), "rb") as file:
            file.seek(e["offset"])
            raw = gzip.decompress(file.read(e["length"]))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {e['record_id']}\r\n".encode() in raw
    by = {}
    for e in entries:
        by.setdefault(e["archive"], []).append((e["offset"], e["length"]))
    for archive, places in by.items():
        assert sum(n for _, n in places) == os.path.getsize(archive.removeprefix("file://"))
    folder = archives[0].removeprefix("file://") + "/records"
    assert not [f for f in os.listdir(folder) if f.startswith("_") and not f.startswith("_SUCCESS")]
    assert all(json.loads(line)["archive"] for f in os.listdir(folder) if f.endswith(".index") for line in open(f"{folder}/{f}"))


def test_any_part_of_an_index(archives):
    part = archives[1].where(F.col("record_id").isin("<urn:page:7>", "<urn:page:4>"))
    assert {r["record_id"]: r["payload_bytes"] for r in warc.read_records(part).collect()} == {"<urn:page:4>": 5, "<urn:page:7>": len(LARGE.encode())}


def test_normalised_twice_is_the_same(spark, archives):
    again = warc.normalise(spark, f"{archives[0]}/records", f"{archives[0]}/again")
    columns = ["record_id", "record_type", "payload_digest", "payload_bytes", "length"]
    order = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())
    assert order(again) == order(archives[1])


@pytest.mark.parametrize("damage", ["cut", "garbage", "short", "long", "digest"])
def test_damage_is_reported(spark, tmp_path, damage):
    payload = b"hello"
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    digest = hashlib.sha1(b"other" if damage == "digest" else payload).hexdigest().encode()
    size = {"short": 9, "long": 3}.get(damage, 5)
    raw = gzip.compress(b"nonsense" * 50 + b"\r\n\r\n" if damage == "garbage" else (head % (digest, size) + payload + b"\r\n\r\n") * 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(raw[:-12] if damage == "cut" else raw)
    with pytest.raises(Exception, match="a.warc.gz"):
        warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")


def test_a_foreign_archive_of_one_stream(spark, tmp_path):
    """Other record types, blocks that are no HTTP messages, no digests."""
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nwarc-record-id: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    raw = b"".join(record % (t, n, len(b), b) for n, (t, b) in enumerate([(b"warcinfo", b"a: b\r\n\r\n"), (b"resource", b""), (b"metadata", b"x" * 70_000)]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(raw))
    index = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    found = {r["record_id"]: (r["record_type"], bytes(r["payload"])) for r in warc.read_records(index, with_payload=True).collect()}
    assert found == {"<0>": ("warcinfo", b"a: b\r\n\r\n"), "<1>": ("resource", b""), "<2>": ("metadata", b"x" * 70_000)}
