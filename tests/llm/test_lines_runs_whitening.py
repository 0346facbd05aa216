"""Line dedup, periodic runs and whitening against plain re-computation."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwell.llm import line_dedup, periodic_runs, whitening

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_dedup(rows, chars, documents):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= documents and i != max(h, key=lambda d: (d is not None, d or 0)) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [(10_000, 5_000), (20, 3)])
def test_lines(spark, monkeypatch, hot):
    """Few and many salts: ties of case and blanks, repeated ids, null ids and texts, lines that repeat in a text, final line feeds."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot[0])
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot[1])
    rng = np.random.default_rng(3)
    pool = ["x" * 8, " " + "X" * 8 + "\r", "É" + "a" * 8, "é" + "a" * 8, "short", "", "\t", "12345678", "1234567 8\x0b", "\U0001f600" * 8, "a" * 8 + "\xa0"]
    rows = [(int(i), "\n".join(rng.choice(pool, rng.integers(0, 9)))) for i in rng.integers(0, 40, 60)]
    rows += [(None, None), (None, "x" * 8 + "\n" + "y" * 9 + "\n"), (None, "y" * 9), (7, ""), (7, "\n\n"), (39, "x" * 8), (39, "x" * 8), (-5, ("z" * 8 + "\n") * 3000)] + [(i, "z" * 8) for i in range(-9, -4)]
    d = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, N_Lines string")
    got = line_dedup.dedup_lines(d, least_chars=8, least_docs=3)
    assert got.columns == ["doc_id", "text", "N_Lines", "n_lines_", "n_dropped", "kept_text"]
    assert sorted(((r.doc_id, r.n_lines_, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == plain_dedup(rows, 8, 3)
    assert line_dedup.line_digest(d.limit(0)).count() == 0


def test_line_digest(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain_dedup([(r.doc_id, r.text) for r in d.collect()], 40, 5)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digest(d).collect()), key=str) == sorted([(*w[:3], sha(w[3])) for w in want], key=str)


def test_dedup_runs_no_python(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.line_digest(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in out.items())


def plain_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng, n, kinds):
    """Words with repeated parts inside repeated parts."""
    w = rng.choice(kinds, n).tolist()
    for _ in range(4):
        a, p, k = int(rng.integers(0, max(1, n))), int(rng.integers(1, max(2, n // 5))), int(rng.integers(2, 9))
        w[a : a + p * k] = (w[a : a + p] * (k + 1))[: len(w[a : a + p * k])]
    return w


def test_runs(spark, monkeypatch):
    """Random and nested repeats of two to two hundred different words, marks of spaces, and odd rows."""
    monkeypatch.setattr(periodic_runs, "CELLS", 64)
    rng = np.random.default_rng(5)
    texts = [repetitive(rng, int(rng.integers(0, 500)), [f"w{k}é" for k in range(kinds)]) for kinds in (2, 3, 5, 40, 200) for _ in range(12)]
    fib = ["a"], ["a", "b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    texts += [fib[1], ["x"] * 700, ["x", "y"] * 300 + ["x"], [*"abcdefghijk"] * 9, []]
    blanks = [" ", "\t", "\n\n", "\x0b ", "\r\x0c"]
    joined = ["".join(x for v in w for x in (v, blanks[int(rng.integers(5))])) for w in texts] + [None, "", " \n ", "\xa0 " * 6, "word " * 6]
    d = spark.createDataFrame([(k, t, "own") for k, t in enumerate(joined)] * 2, "id long, text string, Runs string").repartition(3)
    got = periodic_runs.periodic_runs(d)
    assert got.columns == ["id", "text", "Runs", "runs_", "collapsed_text"] and got.count() == 2 * len(joined)
    some = 0
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", joined[r.id] or "")
        want = plain_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs_] == want
        assert r.collapsed_text == plain_collapsed(w, want)
        some += len(want)
    assert some > 200
    assert periodic_runs.run_digest(d.select(F.col("id").alias("doc_id"), "text").limit(0)).count() == 0


@pytest.mark.parametrize("b", [8, 64, 1024])
def test_occurrences_are_exact(b):
    """Numbers so large that the sum of squared differences needs all three primes."""
    rng = np.random.default_rng(b)
    ids = rng.integers(0, 3, 40 * b)
    ids[5 * b : 9 * b] = np.tile(ids[5 * b : 5 * b + b + 3], 4)[: 4 * b]
    ids[rng.integers(0, len(ids), 3)] = 2**30
    starts = np.arange(0, len(ids) - b, b)
    want = {(int(s), d) for s in starts for d in range(b, 2 * b) if s + d + b <= len(ids) and (ids[s : s + b] == ids[s + d : s + d + b]).all()}
    s, d = periodic_runs.occurrences(ids, starts, b)
    assert set(zip(s.tolist(), d.tolist())) == want and want


@pytest.mark.parametrize("p, g", periodic_runs.PRIMES)
def test_transform(p, g):
    assert p - 1 == (p - 1 & 1 - p) * ((p - 1) // (p - 1 & 1 - p)) and all(pow(g, (p - 1) // f, p) != 1 for f in range(2, 70) if (p - 1) % f == 0)
    x = np.random.default_rng(0).integers(0, p, (3, 16)).astype(np.uint64)
    y = periodic_runs.transformed(x, p, g)
    root = pow(g, (p - 1) // 16, p)
    assert [[int(v) for v in r] for r in y] == [[sum(int(v) * pow(root, i * k, p) for i, v in enumerate(r)) % p for k in range(16)] for r in x]
    assert (periodic_runs.transformed(y, p, g, back=True) == x).all()


def test_run_digest(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in d.collect()} | {None: "a b " * 9, 10**12: None}
    d = spark.createDataFrame(list(text.items()), d.schema)
    for r in periodic_runs.run_digest(d).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if r.doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        top = min(((-m, s, q) for s, m, q in runs), default=None)
        want = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r.collapsed_sha256 == sha(plain_collapsed(w, runs))


def test_long_text_with_long_periods(spark):
    rng = np.random.default_rng(8)
    words = [f"{v:x}" for v in rng.integers(0, 10**9, 30_000)]
    w = words[:7000] + words[7000:18_000] * 5 + words[18_000:]
    (r,) = periodic_runs.periodic_runs(spark.createDataFrame([(" ".join(w),)], "text string")).collect()
    assert [(x.start, x.length, x.period) for x in r.runs] == [(7000, 55_000, 11_000)] and r.collapsed_text == " ".join(words)


def plain_whitening(vectors):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(axis=0)
    c = fit.astype(float) - (s / n).astype(float)
    v = c.T @ c / n
    return x, n, s, v


@pytest.mark.parametrize("dims, rows", [(3, 40), (16, 400), (5, 5), (1, 9)])
def test_whitening(spark, dims, rows):
    rng = np.random.default_rng(dims)
    good = (rng.standard_normal((rows, dims)) * rng.random(dims) * 3 + 1).astype(np.float32).tolist()
    good += good[: rows // 3] * 3
    table = [(k, v) for k, v in enumerate(good)] + [(-1, None), (-2, [None] * dims), (-3, [math.nan] * dims), (-4, [math.inf] * dims), (-5, [1.0] * (dims + 1)), (-6, []), (None, good[0])]
    d = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(3)
    x, n, s, v = plain_whitening(good)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    mean = np.array(s / n, float)
    out = whitening.whitening_digest(d).collect()
    m = min(4, dims)
    assert len(out) == (len(good) + 1) * m
    sign = {}
    for r in out:
        own = x[r.vec_id if r.vec_id is not None else 0]
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(own, s))
        k = r.component - 1
        assert r.explained == pytest.approx(max(values[k], 0) / np.trace(v), rel=1e-9, abs=1e-14)
        if values[k] > 1e-12 * np.trace(v):
            want = (np.array(own) - mean) @ vectors[k] / math.sqrt(values[k])
            sign.setdefault(k, np.sign(want * r.whitened) if abs(want) > 1e-3 else None) if sign.get(k) is None else None
            assert r.whitened == pytest.approx(want * (sign[k] or np.sign(want * r.whitened)), abs=1e-7) and r.identity_error < 1e-9
        else:
            assert r.whitened is None


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitening_digest(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitening_digest(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    flat = whitening.whitening_digest(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect()
    assert len(flat) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(1, 0, None, None, None)}
    far = spark.createDataFrame([(1, [4e9, 1.0]), (2, [-4e9, 1.0]), (3, [0.0, 1.0])], schema)
    rows = whitening.whitening_digest(far).orderBy("vec_id", "component").collect()
    assert [r.deviation for r in rows] == [None] * 4 + [0, 0] and [r.whitened for r in rows[1::2]] == [None] * 3
    own = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 5.0], "b")], "vec_id long, embedding array<double>, WHITENED string")
    got, model = whitening.whitened(own, components=1)
    assert got.columns == ["vec_id", "embedding", "WHITENED", "deviation", "whitened_"] and model.n == 2
    assert sorted(round(abs(r.whitened_[0]), 9) for r in got.collect()) == [1.0, 1.0]


@pytest.mark.parametrize("kind", ["random", "cluster", "identity", "blocks", "low rank", "nought"])
def test_components(kind):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    spectrum = {"random": rng.random(24), "cluster": [1, 1 + 1e-14, 1 - 1e-9, 1 - 1e-6, *rng.random(20) / 2], "identity": [2.0] * 24, "low rank": [3.0, 1.0] + [0.0] * 22, "nought": [0.0] * 24}.get(kind)
    v = (q * np.array(spectrum)) @ q.T if spectrum is not None else np.kron(np.eye(4), (a := rng.standard_normal((6, 6))) @ a.T)
    v = (v + v.T) / 2 if kind != "identity" else 2 * np.eye(24)
    values, vectors = whitening.leading_components(v, 4)
    size = max(np.abs(v).max(), 1e-300)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:4], rtol=0, atol=1e-13 * size * 24)
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12) and np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-12 * size * 24
