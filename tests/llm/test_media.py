import hashlib
import zlib

import pytest

from stemforge.llm import media as M
from stemforge.llm.shared import new_dir

SCHEMA = "doc_id long, text string, member string"
ROWS = [(1, None, "x"), (2, "", "x"), (3, "é" * 100, None), (3, "é" * 100, None), (None, "a" * 192, "x"), (4, "z" * 300_000, "x")]


def test_payloads_come_back(spark):
    got = M.media_digests(spark.createDataFrame(ROWS, SCHEMA), splitBytes=5000).collect()
    assert len(got) == len(ROWS)
    for doc_id, text, _ in ROWS:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = next(r for r in got if r["doc_id"] == doc_id and r["n_bytes"] == len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = M.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert M.from_png(media) == payload


def test_each_member_is_read_once_whatever_the_ranges(spark):
    folder = new_dir(spark, "media")
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50), "m") for i in range(200)], SCHEMA).repartition(3)
    assert M.write_archives(docs, folder) == 200
    for split in (1000, 20_000, 1 << 30):
        rows = M.read_archives(spark, folder, splitBytes=split).collect()
        assert len({r["member"] for r in rows if r["media"]}) <= len(rows) == 200


def test_a_damaged_member_is_told_and_others_are_read(spark):
    import pathlib

    folder = new_dir(spark, "media")
    M.write_archives(spark.createDataFrame([(i, f"text {i}" * 40, "m") for i in range(5)], SCHEMA).coalesce(1), folder)
    (file,) = pathlib.Path(folder.removeprefix("file://")).glob("*.zip")
    data = bytearray(file.read_bytes())
    data[120] ^= 255
    file.write_bytes(data)
    pathlib.Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    rows = M.read_archives(spark, folder, onError="keep", retries=0).collect()
    assert sum(r["media"] is None for r in rows) == 1 and sum(r["error"] is not None for r in rows) == 1 and len(rows) == 5
    with pytest.raises(Exception, match="damaged|no member"):
        M.read_archives(spark, folder, retries=0).collect()


def test_empty_table(spark):
    assert M.media_digests(spark.createDataFrame([], SCHEMA)).count() == 0
