"""Archives on disk: round trips, damage in bytes against what was done to them, text keys of the audit."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwell.llm import fixity, warc

from .test_operators import fixed


def pages(spark):
    rows = [(k, f"http://h/{k}", ("é" if k % 3 else "\r\n\r\nWARC/1.1\r\nWARC-Type: resource\r\n\r\n") * (k % 7) + "x" * (k * 37 % 3000)) for k in range(120)] + [(500, None, None), (501, "u", ""), (502, "u", None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compressed", [False, True])
def test_archives_are_read_back(spark, tmp_path, compressed):
    rows, d = pages(spark)
    records = d.select("page_id", fixity.warc_record("url", "html", "page_id").alias("record"))
    files = warc.write_warc(records, f"file://{tmp_path}/a", order=["page_id"], compressed=compressed, parts=3)
    assert files.agg(F.sum("records")).first()[0] == len(rows) and files.count() == 3
    for r in files.collect():
        body = open(r.path[7:], "rb").read()
        assert len(body) == r.bytes and (gzip.decompress(body) if compressed else body).startswith(b"WARC/1.1\r\n")
    got = warc.read_warc(spark, files, range_bytes=5000)
    assert sorted(map(str, ((r.uri, bytes(r.block).decode()) for r in got.collect()))) == sorted(map(str, ((u, h or "") for _, u, h in rows)))
    assert {r.type for r in got.collect()} == {"resource"} and got.select("record_id").distinct().count() == len(rows)
    first = min(warc.index(files).where("place = 0").collect(), key=lambda r: r.uri)
    assert first.offset == 0 and first.sha256 == hashlib.sha256(fixed("0", *rows[0][1:])).hexdigest()
    (tmp_path / "none.warc").write_bytes(b"")
    assert warc.index(spark.createDataFrame([(f"file://{tmp_path}/none.warc",), (None,)], "path string")).count() == 0


@pytest.mark.parametrize("compressed", [False, True])
def test_damage_is_found_where_it_was_done(spark, tmp_path, compressed):
    rng = np.random.default_rng(int(compressed))
    records = [fixed(str(k), f"u{k}", "y" * int(rng.integers(5, 400)) + str(k)) for k in range(60)]
    packed = [gzip.compress(r, mtime=0) if compressed else r for r in records]
    at = np.append(0, np.cumsum([len(p) for p in packed])).tolist()
    whole, end = b"".join(packed), "warc.gz" if compressed else "warc"
    for side in "lr":
        (tmp_path / side).mkdir()
        (tmp_path / side / f"b.{end}").write_bytes(whole)  # a file that agrees
    (tmp_path / "l" / f"a.{end}").write_bytes(whole)
    cut = at[40], at[41]  # record 40 is lost, the others move
    broken = bytearray(whole)
    if compressed:
        for k in (5, 20):
            broken[at[k] + 12] ^= 0xFF
    else:
        broken[at[6] - 6] ^= 1  # the last byte of the body of 5
        broken[at[20] + 3] ^= 1  # the version line of 20
    broken = bytes(broken[: cut[0]]) + bytes(broken[cut[1] :])
    (tmp_path / "r" / f"a.{end}").write_bytes(broken)
    frames = [spark.createDataFrame([(f"file://{tmp_path}/{side}/{n}.{end}",) for n in "ab"], "path string") for side in "lr"]
    rows = warc.audit_archives(*frames).collect()
    assert {r.file for r in rows} == {f"a.{end}"}
    left = {r.left_offset: r for r in rows if r.left_offset is not None}
    assert sorted(left) == [at[5], at[20], at[40]] and left[at[40]].status == "lost" and left[at[40]].left_bytes == at[41] - at[40]
    assert all(left[at[k]].left_sha256 == hashlib.sha256(records[k]).hexdigest() for k in (5, 20, 40))
    right = {r.right_offset: r for r in rows if r.right_offset is not None}
    assert sorted(right) == [at[5], at[20]] and right[at[20]].right_error and (compressed or left[at[5]].status == "changed")
    assert all(right[at[k]].right_bytes == at[k + 1] - at[k] for k in (5, 20))
    assert warc.audit_archives(frames[0], frames[0]).count() == 0 and warc.audit_archives(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_audit_by_text_keys(spark):
    rows = [(f"k{k:03d}", f"v{k}") for k in range(300)] + [("k007", "twice"), (None, "n")]
    left = spark.createDataFrame(rows, "id string, record string")
    right = spark.createDataFrame([(k, v + "!" if k == "k100" else v) for k, v in rows if k != "k200"] + [("new", "x")], "id string, record string")
    got = {r.id: (r.status, r.left_bytes, r.right_bytes) for r in fixity.audit(left, right, key="id", record="record").collect()}
    assert got == {"k100": ("changed", 4, 5), "k200": ("lost", 4, None), "new": ("added", None, 1)}
    days = [t.withColumn("id", F.to_date(F.lit("2020-01-01")) + F.length("record")) for t in (left, left)]
    assert fixity.audit(*days, key="id", record="record").count() == 0


def test_only_parts_that_differ_are_read(spark):
    left = spark.range(40_000).select("id", F.md5(F.col("id").cast("string")).alias("record"))
    right = left.withColumn("record", F.when(F.col("id") == 12_345, "x").otherwise(F.col("record")))
    out = fixity.audit(left, right, key="id", record="record")
    assert [r.id for r in out.collect()] == [12_345]
    tree = fixity.tree(left, "id", "record", -1, 3)
    assert [t.rows.select("part").distinct().count() for t in tree] == [10, 10, 10, 1]
    scan = tree[0].under([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in scan or "part#" in scan.split("PartitionFilters: [")[1].split("]")[0]
