"""The pipeline against plain re-computation, stage by stage, each on what its predecessor kept."""

import re

import corpus_pipeline as pipeline
from brimwell.llm import pieces, registry, secret_scan, toxicity

from .test_operators import words

SF = "/root/testdata/sf0.001"


def key(r):
    return str((r.doc_id, r.text))


def test_stages_by_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = d.limit(60).collect()
    odd = [rows[3], rows[3], rows[3].asDict() | {"doc_id": None}, rows[4].asDict() | {"doc_id": rows[3].doc_id}, {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 10**9, "text": "", "lang": "en", "source": "s", "n_chars": 0}, {"doc_id": 10**9 + 1, "text": rows[5].text + " " + benchmark[0], "lang": "en", "source": "s", "n_chars": 1}]
    docs = spark.createDataFrame([*rows, *[o if isinstance(o, dict) else o.asDict() for o in odd]], d.schema)
    toxic, near, clean, redact, encode = (f for _, f in pipeline.STAGES)

    model = toxicity.train_chain(d, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {key(r) for r in toxicity.toxicity(docs, model).where("is_toxic").collect()}
    a = toxic(spark, docs, SF).collect()
    assert sorted(map(key, a)) == sorted(key(r) for r in docs.collect() if key(r) not in bad)

    b = near(spark, spark.createDataFrame(a, d.schema), SF).collect()
    sets = [{tuple(x[i : i + min(5, len(x))]) for i in range(len(x) - min(5, len(x)) + 1)} if (x := words(r.text)) else set() for r in a]
    label = list(range(len(a)))
    for _ in range(5):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and len(x & y) >= 0.8 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    wanted = []
    for k in set(label):
        members = [r for r, own in zip(a, label) if own == k]
        ids = [r.doc_id for r in members if r.doc_id is not None]
        wanted.append(min(ids) if ids else None)
    assert sorted(str(r.doc_id) for r in b) == sorted(map(str, wanted)) and {key(r) for r in b} <= {key(r) for r in a}

    c = clean(spark, spark.createDataFrame(b, d.schema), SF).collect()
    spans = {tuple(x[i : i + min(13, len(x))]) for t in benchmark if (x := words(t)) for i in range(len(x) - min(13, len(x)) + 1)}

    def contaminated(text):
        x, hit = words(text), set()
        for n in {len(s) for s in spans}:
            for i in range(len(x) - n + 1):
                if tuple(x[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(x)

    assert sorted(map(key, c)) == sorted(key(r) for r in b if not contaminated(r.text)) and len(c) < len(b)

    e = redact(spark, spark.createDataFrame(c, d.schema), SF).collect()
    spans_of = {key(r): r for r in c}
    scanned = {str(r.doc_id): r.spans for r in secret_scan.scan_secrets(spark.createDataFrame([(key(r), r.text) for r in c], "doc_id string, text string")).collect()}
    want = []
    for k, r in spans_of.items():
        text, done, out = r.text, 0, ""
        for s in scanned[k]:
            if s.start >= done:
                out += text[done : s.start] + f"[{s.kind.upper()}]"
            done = max(done, s.end)
        want.append((str(r.doc_id), None if text is None else out + text[done:]))
    assert sorted((str(r.doc_id), r.text) for r in e) == sorted(want, key=lambda x: (x[0], str(x[1]))) if None not in [t for _, t in want] else sorted(map(str, ((str(r.doc_id), r.text) for r in e))) == sorted(map(str, want))
    assert not any(re.search("AKIA[A-Z0-9]{16}", r.text or "") for r in e) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in e)

    coder = pieces.Encoder(*pieces.load_pieces(registry.PIECES))
    out = {str((r.doc_id, tuple(r.pieces) if r.pieces is not None else None)): r.n_pieces for r in encode(spark, spark.createDataFrame(e, d.schema), SF).collect()}
    assert out.keys() == {str((r.doc_id, tuple(coder.encode(r.text)) if r.text is not None else None)) for r in e}


def test_run_and_empty_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = pipeline.run(spark, SF)
    assert 0 < got.count() < d.count() and got.columns == ["doc_id", "n_pieces", "pieces"]
    none = d.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
