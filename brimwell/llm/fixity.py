"""Merkle fixity audit of two replicas of an archive of WARC records, in DataFrame operations alone.

A record's leaf is the SHA-256 of its bytes.  Records lie in the archive by their ordinals; a node of level k
covers the ordinals of WIDTH**k places, and so one range of bytes of the archive.  It holds the SHA-256 of its children's
places, bytes and hashes in order, so a group has at most WIDTH rows and a tree of n records has few levels.
Roots are compared first; below, only the children of nodes that differ are compared, level by level, down to the
records.  The byte offset of a node comes down the same way: its parent's, and the bytes of the siblings before it.

Keys that are whole numbers are the ordinals; keys of any other type are ranked over both replicas first.  Levels are written in parts, by their
uppermost nodes, and only parts with nodes that differ are read again.  Archives of WARC files are read by llm/warc.

Defined results: a null url leaves its header line away, a null body is empty; rows of one ordinal are one leaf, of the
sum of their hashes where there are several, so that no group is collected; records of null ordinal come first in the
archive, by their hash, and have a null key; empty replicas agree; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .text import discarded, scratch, written

BITS = 6
WIDTH = 1 << BITS
LOOSE = (1 << 40) - 1  # places that records of null ordinal are dealt to, by hash


def warc_record(url: str, body: str, key: str, date: str = "1970-01-01T00:00:00Z") -> Column:
    """The text of a WARC resource record; its ID is a UUID made of the key, so replicas share it."""
    line = lambda *x: F.concat(*x, F.lit("\r\n"))
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    own = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    uuid = F.concat_ws("-", *[F.substring(own, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    uri = F.when(F.col(url).isNotNull(), line(F.lit("WARC-Target-URI: "), F.col(url).cast("string"))).otherwise("")
    return F.concat(
        line(F.lit("WARC/1.1")), line(F.lit("WARC-Type: resource")), line(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), line(F.lit(f"WARC-Date: {date}")), uri,
        line(F.lit("Content-Type: text/html; charset=utf-8")), line(F.lit("Content-Length: "), F.octet_length(text).cast("string")), line(), text, line(), line(),
    )


def leaves(records: DataFrame, key: str, record: str, base: int) -> DataFrame:
    """(node, hash, bytes) of level 0; null keys lie at `base` and before."""
    own = records.select(F.col(key).cast("long").alias("key"), F.sha2(F.col(record).cast("binary"), 256).alias("hash"), F.octet_length(record).cast("long").alias("bytes"))
    node = F.coalesce("key", F.lit(base) - F.xxhash64("hash").bitwiseAND(F.lit(LOOSE)))
    parts = [F.sum(F.conv(F.substring("hash", 1 + k, 11), 16, 10).cast("decimal(20,0)")) for k in range(0, 64, 11)]
    one = own.groupBy(node.alias("node")).agg(F.count("*").alias("n"), F.min("hash").alias("h"), F.concat_ws(":", *[p.cast("string") for p in parts]).alias("sums"), F.sum("bytes").alias("bytes"))
    return one.select("node", F.when(F.col("n") == 1, F.col("h")).otherwise(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "sums"), 256)).alias("hash"), "bytes")


def parents(level: DataFrame) -> DataFrame:
    """The next level: ordered hashes of up to WIDTH children, and the bytes they cover."""
    up = level.groupBy(F.shiftright("node", BITS).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash", "bytes"))).alias("c"))
    child = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["bytes"].cast("string"), x["hash"])), ",")
    return up.select(F.col("up").alias("node"), F.sha2(child, 256).alias("hash"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["bytes"]).alias("bytes"))


class Level:
    """A level of a tree, written in parts of nodes that lie under one node `up` levels higher; parts are read alone."""

    def __init__(self, rows: DataFrame, up: int) -> None:
        self.path = scratch(rows.sparkSession)
        part = F.shiftright("node", BITS * up)
        rows.withColumn("part", part).write.partitionBy("part").parquet(self.path)
        self.rows, self.up = rows.sparkSession.read.schema(rows.schema.add("part", "long")).parquet(self.path), up

    def under(self, parts: list[int] | None) -> DataFrame:
        return (self.rows if parts is None else self.rows.where(F.col("part").isin(parts))).drop("part")


def tree(records: DataFrame, key: str, record: str, base: int, depth: int) -> list[Level]:
    """The levels, from records to the top; a level has 2 * WIDTH parts at most."""
    levels = [Level(leaves(records, key, record, base), max(0, depth - 1))]
    for k in range(1, depth + 1):
        levels.append(Level(parents(levels[-1].rows.drop("part")), max(0, depth - 1 - k)))
    return levels


def audit(left: DataFrame, right: DataFrame, *, key: str, record: str) -> DataFrame:
    """A row for each place whose records differ: key, status (changed, lost, added), and hash, byte offset and bytes in both replicas."""
    if left.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return _audit(left.select(key, record), right.select(key, record), key, record)
    keys = left.select(key).unionByName(right.select(key)).where(F.col(key).isNotNull()).distinct()
    places = written(ranked(keys.select(F.col(key).alias("key")), [], [F.col("key")], "place"))
    placed = lambda t: t.select(F.col(key).alias("key"), F.col(record).alias("record")).join(places, "key", "left").select("place", "record")
    out = _audit(placed(left), placed(right), "place", "record")
    return out.join(places, "place", "left").select(F.col("key").alias(key), *[c for c in out.columns if c != "place"])


def _audit(left: DataFrame, right: DataFrame, key: str, record: str) -> DataFrame:
    both = left.select(key).unionByName(right.select(key))
    low, high, loose = both.agg(F.min(key), F.max(key), F.count(F.when(F.col(key).isNull(), 1))).first()
    base = (low or 0) - 1
    span = max(abs(high or 0), abs(base - (LOOSE if loose else 0)))
    depth = 1
    while span >> (BITS * depth):
        depth += 1
    trees = {"left": tree(left, key, record, base, depth), "right": tree(right, key, record, base, depth)}
    bad = None
    for k in range(depth, -1, -1):
        sides, parts = [], None
        if bad is not None:
            shift = BITS * (trees["left"][k].up - 1)
            part = F.shiftright("node", shift) if shift >= 0 else F.shiftleft("node", -shift)  # a node of the level above and its children are of one part
            parts = [r.part for r in bad.select(part.alias("part")).distinct().collect()] if shift >= 0 else None  # 2 * WIDTH at most
        for side, levels in trees.items():
            own = levels[k].under(parts).select("node", F.col("hash").alias(f"{side}_hash"), F.col("bytes").alias(f"{side}_bytes"))
            if bad is None:  # the top has two nodes at most, of the places below and from 0
                begin, within = F.lit(0), Window.partitionBy(F.lit(0))
            else:
                up = bad.select(F.col("node").alias("up"), F.col(f"{side}_offset").alias("begin"))
                own = own.join(up, F.shiftright("node", BITS) == F.col("up"))
                begin, within = F.col("begin"), Window.partitionBy("up")
            before = F.sum(f"{side}_bytes").over(within.orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
            sides.append(own.select("node", f"{side}_hash", (begin + F.coalesce(before, F.lit(0))).alias(f"{side}_offset"), f"{side}_bytes"))
        above, bad = bad, sides[0].join(sides[1], "node", "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        bad = written(bad)
        discarded(*[above] if above is not None else [])
    status = F.when(F.col("right_hash").isNull(), "lost").when(F.col("left_hash").isNull(), "added").otherwise("changed")
    place = F.when(F.col("node") > base, F.col("node")).alias(key)
    return bad.select(place, status.alias("status"), *[f"{side}_{c}" for side in trees for c in ("hash", "offset", "bytes")])


def decayed(pages: DataFrame) -> DataFrame:
    """A replica of the pages with damage by rule: one in 97 changed, one in 89 lost, one in 83 of another address."""
    p = F.col("page_id")
    return pages.select("page_id", F.when(p % 83 == 5, F.concat("url", F.lit("#"))).otherwise(F.col("url")).alias("url"), F.when(p % 97 == 13, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")).alias("html")).where(p % 89 != 7)


def merkle_digest(pages: DataFrame) -> DataFrame:
    """The audit of pages against a damaged replica; -1 for the place of a record that a replica lacks."""
    archived = lambda t: t.select("page_id", warc_record("url", "html", "page_id").alias("record"))
    out = audit(archived(pages), archived(decayed(pages)), key="page_id", record="record")
    return out.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in out.columns if c.endswith(("_offset", "_bytes"))})


_RECORD = """'WARC/1.1'||n||'WARC-Type: resource'||n||'WARC-Record-ID: <urn:uuid:'||substring(m,1,8)||'-'||substring(m,9,4)||'-'||substring(m,13,4)||'-'||substring(m,17,4)||'-'||substring(m,21,12)||'>'||n
 ||'WARC-Date: 1970-01-01T00:00:00Z'||n||CASE WHEN url IS NULL THEN '' ELSE 'WARC-Target-URI: '||url||n END
 ||'Content-Type: text/html; charset=utf-8'||n||'Content-Length: '||strlen(coalesce(html, ''))||n||n||coalesce(html, '')||n||n"""
_PLACED = f"SELECT page_id, sha256(w) AS hash, CAST(strlen(w) AS BIGINT) AS bytes, CAST(coalesce(sum(strlen(w)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM (SELECT page_id, {_RECORD} AS w FROM (SELECT *, md5(CAST(page_id AS VARCHAR)) AS m FROM {{}}), (SELECT chr(13)||chr(10) AS n))"
ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN page_id%83=5 THEN url||'#' ELSE url END AS url, CASE WHEN page_id%97=13 THEN '?'||substring(html,2) ELSE html END AS html FROM pages WHERE page_id%89<>7),
a AS ({_PLACED.format('pages')}), b AS ({_PLACED.format('r')})
SELECT page_id, CASE WHEN b.hash IS NULL THEN 'lost' WHEN a.hash IS NULL THEN 'added' ELSE 'changed' END AS status,
 a.hash AS left_hash, coalesce(a.at, -1) AS left_offset, coalesce(a.bytes, -1) AS left_bytes, b.hash AS right_hash, coalesce(b.at, -1) AS right_offset, coalesce(b.bytes, -1) AS right_bytes
FROM a FULL JOIN b USING (page_id) WHERE a.hash IS DISTINCT FROM b.hash
"""
