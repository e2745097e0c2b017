import base64
import gzip
import hashlib
import shutil

import pytest

from grainmill.llm import warc_files as W


def record(i, body=None, kind="response", http=True, **more):
    """One record as another tool would write it."""
    payload = f"<p>page {i} é</p>\r\n\r\nWARC/1.0 is no start".encode() * (i % 5) if body is None else body
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload if http else payload
    sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{i}>", "warc-target-uri": f"http://a/{i}", "WARC-Date": "2024-05-01T00:00:00Z", "WARC-Payload-Digest": sha,
            "Content-Type": "application/http; msgtype=response" if http else "text/plain", **more, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n", payload


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "a b"
    (root / "deep").mkdir(parents=True)
    rows = [record(i)[0] for i in range(30)]
    (root / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, rows[:12])))
    (root / "deep" / "several.warc.gz").write_bytes(gzip.compress(b"".join(rows[12:20])) + gzip.compress(rows[20]))
    (root / "plain.warc").write_bytes(b"".join(rows[21:]))
    (root / "none.warc").write_bytes(b"")
    (root / "notes.txt").write_text("no archive")
    return root, rows


def test_every_record_of_every_kind_of_file(spark, folder):
    root, rows = folder
    got = sorted(W.read_files(spark, str(root)).collect(), key=lambda r: (r["name"], r["seq"]))
    assert [r["name"] for r in got] == ["deep/several.warc.gz"] * 9 + ["one.warc.gz"] * 12 + ["plain.warc"] * 9
    assert [bytes(r["record"]) for r in got] == rows[12:21] + rows[:12] + rows[21:]
    assert all(r["intact"] and r["digest_ok"] and r["type"] == "response" for r in got)
    ids = [*range(12, 21), *range(12), *range(21, 30)]
    assert [r["uri"] for r in got] == [f"http://a/{i}" for i in ids]
    assert [bytes(r["payload"]) for r in got] == [record(i)[1] for i in ids]
    for r in got:  # the place is that of the stored bytes
        raw = (root / r["name"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert bytes(r["record"]) in (gzip.decompress(raw) if r["name"].endswith("gz") else raw)


def test_header_forms_and_digests():
    raw, payload = record(3, http=False, **{"X-Long": "a\r\n  b"})
    (offset, length, data, block), = W.stored(raw)
    assert (offset, length, data) == (0, len(raw), raw) and W.header_fields(data[:block])["x-long"] == "a b"
    assert W.fields_of(data, block)[5:] == (payload, True)
    assert W.fits("sha256:" + hashlib.sha256(b"x").hexdigest().upper(), b"x") and W.fits("sha1:AAAA", b"x") is False
    assert W.fits("md5:00", b"x") is None and W.fits(None, b"x") is None
    bad = raw.replace(b"page 3", b"page 4", 1)
    assert W.fields_of(*next(iter(W.stored(bad)))[2:])[6] is False
    bare = raw.replace(b"\r\n", b"\n")
    assert [x[3] is None for x in W.stored(b"WARC/1.0\nContent-Length: 0\n\n\n\n" + b"WARC/1.1\nContent-Length: 2\n\nab\n\n")] == [False, False]
    assert W.record_end(bare[:40], 0) is None


@pytest.mark.parametrize("zipped", [True, False])
def test_damage_is_one_row_and_reading_goes_on(zipped):
    rows = [record(i)[0] for i in range(5)]
    parts = [gzip.compress(r) for r in rows] if zipped else rows
    broken = parts[2][: len(parts[2]) // 2] + b"\xff\x00\xff" + parts[2][len(parts[2]) // 2 + 3 :] if zipped else parts[2].replace(b"WARC/1.0\r\n", b"WARC-1.0\r\n", 1)
    data = b"".join([*parts[:2], broken, *parts[3:]])
    got = list(W.stored(data))
    assert [g[2] for g in got if g[3] is not None] == rows[:2] + rows[3:]
    assert sum(g[1] for g in got) == len(data) and len(got) == 5
    cut = list(W.stored(data[:-4]))
    assert cut[-1][3] is None or not zipped and cut[-1][2] == rows[4][:-4]
    assert sum(g[1] for g in cut) == len(data) - 4
    assert [g[3] for g in W.stored(b"no archive at all")] == [None]


def test_audit_of_two_folders(spark, folder, tmp_path):
    root, rows = folder
    other = tmp_path / "copy"
    shutil.copytree(root, other)
    found, report = W.audit_files(spark, str(root), str(other))
    assert found.collect() == [] and report["compared"] == []
    raw = bytearray((other / "plain.warc").read_bytes())
    at = raw.index(b"page 23")
    raw[at] ^= 1
    (other / "plain.warc").write_bytes(bytes(raw))
    shutil.copy(root / "plain.warc", other / "new.warc")
    (other / "deep" / "several.warc.gz").unlink()
    found, report = W.audit_files(spark, str(root), str(other), fanout=4)
    got = sorted((r["name"], r["seq"], r["state"]) for r in found.collect())
    assert got == sorted([("plain.warc", 2, "changed")] + [("new.warc", i, "added") for i in range(9)] + [("deep/several.warc.gz", i, "lost") for i in range(9)])
    hit = next(r for r in found.collect() if r["state"] == "changed")
    assert hit["offset"] <= at < hit["offset"] + hit["length"]
