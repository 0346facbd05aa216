"""Secret scans with one combined automaton for all rules.

All rules are compiled together (subset construction, minimisation) into an automaton that reads a
text once, from its end: it accepts at every byte where a match of some rule begins.  At the leftmost
such byte behind the previous match, the rule's own small automaton finds the longest match.  So the
spans of a rule are its leftmost, longest, non-overlapping matches, as `re.finditer` gives for these rules.

Defined results: a null or empty text has no spans; equal rows give equal rows; the result holds the
id and the spans only, so further columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import compile_rules, scan_backwards
from .text import blocks, readable, text_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `head` then `body`; a match whose body is shorter than `least` is dropped, though it still takes its place."""

    kind: str
    head: str
    body: str
    least: int = 1


# The kinds of secrets looked for, in the order in which spans of one place are listed.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]{24,}"),
    # through the END line; where there is none, through the lines of base64
    Rule("pem", r"", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[\r\n]+[A-Za-z0-9+/=]+)*|(?:[A-Za-z0-9+/=:,.\\ \t\r\n]|[A-Za-z0-9]-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)"),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("forge", r"gh[opsur]_", r"[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("cloud", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("payment", r"[rs]k_live_", r"[A-Za-z0-9]+", 20),
    Rule("url", r"[a-z][a-z0-9+]*://[^ \t\r\n:/@\xff]+:", r"[^ \t\r\n/@\xff]+@", 4),
)
BASE = ("assign", "access", "hex")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        whole = [r.head + r.body for r in rules]
        self.starts = compile_rules(whole, anywhere=True, reverse=True)
        self.whole = [compile_rules([p], anywhere=False) for p in whole]
        self.heads = [compile_rules([r.head], anywhere=False) if r.head else None for r in rules]
        self.kinds = [[k for k in range(len(rules)) if m >> k & 1] for m in self.starts.masks]

    def spans(self, text: bytes, places: list[int], states: list[int]) -> list[tuple[int, int, int]]:
        """(start, rule, end) of one text from the places where matches begin, sorted."""
        found, until = [], [0] * len(self.rules)
        for at, s in zip(places, states):
            for k in self.kinds[s]:
                if at >= until[k] and (end := self.whole[k].longest(text, at)) > at:
                    until[k] = end
                    body = self.heads[k].longest(text, at) if self.heads[k] else at
                    if end - body >= self.rules[k].least:
                        found.append((at, k, end))
        return sorted(found)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(text, spans) of the texts that have any; places are bytes from the text's begin."""
        place, state = scan_backwards(self.starts, data, offsets)
        if not len(place):
            return []
        text = np.searchsorted(offsets, place, "right") - 1
        cut = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(text))):
            t = int(text[a])
            own = data[offsets[t] : offsets[t + 1]].tobytes()
            if spans := self.spans(own, (place[a:b] - offsets[t]).tolist(), state[a:b].tolist()):
                out.append((t, spans))
        return out


@cache
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once, on the driver; tasks get the transition arrays by broadcast."""
    return Scanner(rules)


def _code_points(data: np.ndarray) -> np.ndarray | None:
    """Code point number of each byte place, or None where they are the same."""
    if (data < 128).all():
        return None
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def scan_secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document: its id and `spans` array<struct<kind, start, end>> (code points, end exclusive), by start, then kind as listed."""
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scanner_of(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        names = [r.kind for r in rules]
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                count = np.zeros(part.num_rows, np.int64)
                kinds, begins, ends = [], [], []
                for t, spans in scanner.block(data, offsets):
                    count[t] = len(spans)
                    points = _code_points(data[offsets[t] : offsets[t + 1]])
                    for a, k, b in spans:
                        kinds.append(names[k])
                        begins.append(a if points is None else int(points[a]))
                        ends.append(b if points is None else int(points[b]))
                flat = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], fields=list(SPAN))
                at = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(at, flat)], names=["id", "spans"])

    out = docs.select(F.col(id).alias("id"), text_bytes(text).alias("text")).mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.select(F.col("id").alias(id), "spans")


def redact_secrets(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by the mark of its kind; overlapping spans become one mark, of the first. Null stays null."""
    frame, own = readable(docs, text)
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(scanner_of(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        marks = [mark.format(r.kind.upper()).encode() for r in rules]
        for batch in batches:
            column = batch.column(text)
            new: dict[int, str] = {}
            i = 0
            for part, d, offsets in blocks(batch, own):
                for t, spans in scanner.block(d, offsets):
                    one = d[offsets[t] : offsets[t + 1]].tobytes()
                    pieces, done = [], 0
                    for a, k, b in spans:
                        if a >= done:
                            pieces += [one[done:a], marks[k]]
                        done = max(done, b)
                    new[i + t] = (b"".join(pieces) + one[done:]).decode("utf-8", "replace")
                i += part.num_rows
            if new:
                values = column.to_pylist()
                for t, x in new.items():
                    values[t] = x
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if n == text else batch.column(n) for n in schema.names], names=schema.names)

    return frame.mapInArrow(scan, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(spans: DataFrame) -> DataFrame:
    """The counts and digests of what scan_secrets returns."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _placed(rule: Rule) -> str:
    """SQL for (r, kind, start, end) of a rule: the matches and what lies between them give the places."""
    pattern = rule.head + rule.body
    if rule.kind == "pem":  # here the first alternative that fits is taken, not the longest: the END line goes first
        lines, whole = rule.body.split("(?:", 1)[1].removesuffix(")").rsplit("|(?:[A-Za-z0-9+/=:", 1)
        pattern = rule.body.split("(?:", 1)[0] + "(?:(?:[A-Za-z0-9+/=:" + whole + "|" + lines + ")"
    quote = lambda x: "'" + x.replace("\\xff", "").replace("'", "''") + "'"
    body = f"length(regexp_extract(m, {quote('^(?:' + rule.head + ')(' + rule.body + ')$')}, 1))" if rule.least > 1 else "1"
    return f"""SELECT r, '{rule.kind}' AS kind, s AS a, s + length(m) AS b FROM (SELECT r, unnest(e) AS m, unnest(list_transform(range(1, len(e) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(e[1:i - 1], lambda x: length(x))), 0))) AS s
 FROM (SELECT r, regexp_extract_all(text, {quote(pattern)}) AS e, regexp_split_to_array(text, {quote(pattern)}) AS g FROM t) WHERE len(e) > 0) WHERE {body} >= {rule.least}"""


ORACLE = f"""
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(map(_placed, RULES))}),
k AS (SELECT *, CAST(a AS BIGINT) AS place, list_position({[rule.kind for rule in RULES]}, kind) AS rank, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS name, kind IN {BASE} AS base FROM s),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(name, ',' ORDER BY place, rank) FILTER (base) AS bases, string_agg(name, ',' ORDER BY place, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (r)
"""
