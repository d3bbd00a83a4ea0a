"""Each stage of the pipeline against a plain version, and what it does with nulls, repeats and clashing columns."""

import re

import pytest

import corpus_pipeline
from kmerweave.llm import packing, toxicity

SPACED = re.compile("[^\\x20\\x09-\\x0d]+")
#: Names that the operators use themselves.
NAMES = ["_id", "_key", "_kept", "id", "key", "kept", "row", "score", "gain", "windows", "hits", "items", "n_words", "number", "component_id", "text_key", "start", "a.b", "row.text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in NAMES) + ", tags map<string,int>"


def row(i, text):
    return (i, text, "en", "s", None if text is None else len(text), *(1000 * (i or 0) + j for j in range(len(NAMES))), {"a": 1})


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    clean = [" ".join(f"word{(i * 37 + j * j) % 997}x{i}" for j in range(60)) for i in range(30)]
    bad = [" ".join("vile scum filth" if j % 6 == 0 else f"word{(i * 31 + j) % 997}x{i}" for j in range(60)) for i in range(30)]
    passage = " ".join(f"shared{j}" for j in range(60))
    leak = " ".join(f"bench{j}" for j in range(15))
    texts = dict(enumerate(clean))
    texts |= {100 + i: t for i, t in enumerate(bad)}
    texts |= {200: clean[0], 201: clean[1] + " extra", 202: clean[2] + " " + passage, 203: passage + " " + clean[3][:200], 204: clean[4][:250] + " " + leak.upper(), 205: "", 206: None, 207: passage}
    rows = [row(i, t) for i, t in texts.items()] + [row(5, clean[5]), row(None, "no id here at all"), row(None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def found(df):
    """Rows as plain values, in an order; other columns must be those the row came with."""
    out = []
    for r in df.collect():
        base = 1000 * (r.doc_id or 0)
        assert [r[n] for n in NAMES] == [base + j for j in range(len(NAMES))] and r.tags == {"a": 1}
        out.append((r.doc_id is not None, r.doc_id or 0, r.text or "", r.text is None, r.n_chars))
    return sorted(out, key=repr)


def words(t):
    return SPACED.findall(t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_toxicity_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert got.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [r for r in docs.collect() if model.rate([(r.text or "").encode()])[0] < corpus_pipeline.TOXIC]
    assert found(got) == found(spark.createDataFrame(want, docs.schema))
    left = {r.doc_id for r in want}
    assert left >= set(range(30)) and len(left & set(range(100, 130))) <= 3


def test_near_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    rows = docs.collect()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(lower(r.text))) else set() for r in rows if r.doc_id is not None}
    root = {d: d for d in sets}
    for _ in sets:  # the smallest id reachable
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        break
    want = [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id]
    assert found(got) == found(spark.createDataFrame(want, docs.schema))
    assert 200 not in {r.doc_id for r in want} and 201 not in {r.doc_id for r in want}


def test_substring_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.cut_repeats(spark, docs, sf)
    assert got.columns == docs.columns
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    seen, want, done = {}, [], {}
    for r in rows:
        w = words(r.text)
        if (r.doc_id, r.text) not in done:
            gone = set()
            for i in range(len(w) - 19):
                if seen.setdefault(tuple(w[i : i + 20]), (r.doc_id, i)) != (r.doc_id, i):
                    gone |= set(range(i, i + 20))
            done[r.doc_id, r.text] = gone
        gone = done[r.doc_id, r.text]
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone:
            want.append(r)
        elif kept:
            want.append(tuple(kept if c == "text" else len(kept) if c == "n_chars" else r[c] for c in docs.columns))
    assert found(got) == found(spark.createDataFrame(want, docs.schema))
    assert 207 not in {r[0] for r in want}


def test_benchmark_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.drop_benchmark_leaks(spark, docs, sf)
    want = [r for r in docs.collect() if r.doc_id != 204]
    assert got.columns == docs.columns and found(got) == found(spark.createDataFrame(want, docs.schema))


def test_whole_pipeline(spark, sf, tmp_path):
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    encode = packing.encoder()
    want = sum(len(encode(r.text or "")) + 1 for r in docs.select("text").collect())
    assert sum(r.length for r in got) == want and not {204, 200, 201} & {r.doc_id for r in got}
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
