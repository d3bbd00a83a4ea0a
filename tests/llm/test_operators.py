"""Each operator against a brute-force version and on awkward rows: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns of clashing names."""

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerweave.llm import decontaminate, language, licenses, near_dedup, neighbors, packing, quality, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, id long, words string, score double, row string, component_id long"
ALNUM, SPACED = rb"[0-9a-z\x80-\xff]+", rb"[^\x20\x09-\x0d]+"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, pattern, lower=True):
    raw = (text or "").encode()
    return [w.decode() for w in re.findall(pattern, raw.translate(LOWER) if lower else raw)]


def corpus(n=60, seed=4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdéxyz") for _ in range(r.randint(2, 6))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    texts = []
    for i in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120)))
        if i % 7 == 0:
            t += "\n" + passage + " " + r.choice(vocabulary)
        texts.append(t)
    for i in range(0, n, 5):  # near copies, some of near copies
        w = texts[i].split()
        for j in range(0, len(w), 60):
            w[j] = "CHANGED"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1], texts[1].upper(), "", None, "  \t\n", "one", "One", "one two", "ÉÀ ñ", " ".join(t or "" for t in texts[:30])]
    return texts


def frame(spark, texts, extra=()):
    rows = [(i, t, "en", 7, "w", 0.5, "r", 3) for i, t in enumerate(texts)]
    rows += [(2, texts[2], "en", 7, "w", 0.5, "r", 3), (None, "null id text here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + list(extra), DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 packing


def test_packing_is_a_round_trip(docs):
    rows = packing.pack(docs, block_tokens=3000).collect()
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append(r)
    for pieces in at.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total <= 1024 and total & (total - 1) == 0  # nothing is padded
    by_doc = defaultdict(list)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 2:
            by_doc[r.doc_id].append(r)
    encode = packing.encoder()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces])
        assert ids.tolist() == [*encode(texts[d] or "").tolist(), 0] and {p.doc_tokens for p in pieces} == {len(ids)}
    assert sum(r.length for r in rows if r.doc_id is None) == len(encode("null id text here")) + 2
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * (len(encode(texts[2])) + 1)


def test_ids_are_those_of_the_json_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    texts = corpus()[:40] + ["a<|endoftext|>b", "  x\n\n\ty ", "don't I'LL", "\x00\x7f\u2028é́🙂日本", "".join(chr(r.choice([32, 10, 65, 233, 0x4E00, 0x1F600, 48])) for _ in range(500))]
    for text in filter(None, texts):
        assert t.encode(text, add_special_tokens=False).ids == packing.encoder()(text).tolist()


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\t" * 900_000 + "b", "x\n" + "\n" * 900_000, " \t\n" * 400_000 + "end"])
def test_long_white_space(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode(text, add_special_tokens=False).ids == packing.encoder()(text).tolist()


def test_balance_prefers_low_cost():
    out = packing.balance(np.array([900, 800, 700, 300, 200, 100, 72]), 1024, 1.0, 1 / 512)
    assert sum(n for s in out for _, _, n in s) == 3072 and all(sum(n for *_, n in s) == 1024 for s in out)


# 2 licences


def test_licenses(spark, empty):
    texts = ["x CC BY-NC 4.0. cc by", "GNU General Public\nLicense, general public license", "All Rights Reserved", None, "", "all rights", "by cc by", "Released under the MIT License.", "GENERAL public license all RIGHTS reserved cc-by", "Licensed under the Apache License, Version 2.0", "ccé by"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t, ALNUM)
        places = sorted((p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(w) and sorted((x.start, x.label) for x in got[i].places) == places
    labels = lambda i: {x.label for x in got[i].found}
    assert "mit" in labels(7) and "apache-2.0" in labels(9) and "cc-by-nc" in labels(0) and not labels(5)
    assert licenses.scan(empty).count() == 0


def test_titles_of_licenses(spark):
    texts = ["GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "GNU General Public License, version 2", "Apache License\nVersion 2.0, January 2004", "The MIT License (MIT)", "Mozilla Public License Version 2.0", "GNU Lesser General Public License version 3", "apache server, mit press"]
    got = {r.doc_id: {x.label for x in r.found} for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(7)] == [{"gpl-3.0"}, {"gpl-2.0"}, {"apache-2.0"}, {"mit"}, {"mpl-2.0"}, {"lgpl"}, set()]


def test_licenses_by_sql(spark, tmp_path):
    """The query against its SQL, with a rare-word index, on notices cut at either end, repeated rows and nulls."""
    from kmerweave.llm.registry import ORACLES

    whole = [*licenses.PHRASES, *(t for t, _, _ in licenses.TEMPLATES)]
    texts = ["", None, "cc", *whole, *(" ".join(t.split()[i:]) + " x" for t in whole for i in (1, 2)), *(" ".join(t.split()[:-1]) for t in whole), " ".join(whole), ", ".join(whole).upper()]
    spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op2_licenses(spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(f"select {', '.join(got.columns)} from ({ORACLES['op2_licenses']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_many_and_long_templates(spark):
    """Lists of any size, each template found by its own two words; quotes in a template are no words."""
    r = random.Random(9)
    some = [" ".join(f"t{r.randrange(4000)}" for _ in range(40)) for _ in range(700)]
    templates = [(t, f"x{i}", " ".join(t.split()[10:14])) for i, t in enumerate(some)] + [("it's quoted", "q", "it's quoted"), ("long " * 30_000 + "end of it", "long", "end of it")]
    texts = [some[5], "so " + some[699] + " it", " ".join(some[7].split()[3:]), " ".join(some[8].split()[:12]), "long " * 30_000 + "end of it", "end of it", "it's quoted", "word " * 50_000 + some[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(f.start, f.label, round(f.share, 3)) for f in r.found] for r in licenses.scan(df, templates=templates).collect()}
    assert got == {0: [(0, "x5", 1.0)], 1: [(1, "x699", 1.0)], 2: [(-3, "x7", 0.925)], 3: [], 4: [(0, "long", 1.0)], 5: [], 6: [], 7: [(50_000, "x3", 1.0)]}


# 3 decontamination


@pytest.mark.parametrize("limit", [10**9, 900])
def test_decontamination(spark, docs, empty, limit):
    texts = corpus()
    items = [(1, " ".join(texts[0].split()[-40:])), (2, "ONE two"), (3, "one"), (4, None), (5, ""), (6, texts[8]), (7, texts[8]), (10, " ".join(texts[8].split()[:9])), (None, texts[9])]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = decontaminate.search(docs, bench, max_item_chars=limit).collect()
    assert len(got) == docs.count() and decontaminate.search(empty, bench).count() == 0
    seen = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        w, hit, owners = words(t, ALNUM), set(), set()
        for item, text in items:
            x = words(text, ALNUM)
            n = min(10, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n and item is not None else set()
            for p in range(len(w) - n + 1 if grams else 0):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    owners.add(item)
        assert (seen[i].n_words, sorted(owners)) == (len(w), seen[i]["items"])
        assert hit == {q for h in seen[i].hits for q in range(h.start, h.stop)}
    assert decontaminate.search(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


# 4 URLs


def test_urls(spark):
    given = ["http://A.example.com/en/1", "http://www.example.com/en/x?q#z", "https://net/es/", "https://x.NET/fr/1", "http://notcom/en/", "no scheme", None, "", "http://xcom.org?a=://b", "http://a.net", "x://com#/en/", "http://cheap-pills.casino.test/en/1"]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(given)], "page_id long, url string, host string, path string, label int")
    labelled = spark.createDataFrame(urls.LABELLED, "url string, label int")
    got = {r.page_id: r for r in urls.judge(pages, urls.RULES, labelled).collect()}
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.encode().translate(LOWER).decode()
        fits = [r for r in urls.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
        best = max(fits, key=lambda r: len(r[0]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        assert got[i].verdict == best[1] if best else got[i].verdict in ("allow", "block")
    assert got[11].verdict == "block" and got[9].verdict == "allow"
    assert {r.verdict for r in urls.judge(pages, [], labelled.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), urls.RULES, labelled).count() == 0


# 5 language, 8 toxicity, 9 quality


@pytest.fixture(scope="module")
def two_tongues(spark):
    r = random.Random(7)
    make = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60)))
    rows = [(i, make(["the", "an", "ing", "wh"]), "aa") if i % 3 else (i, make(["eau", "qué", "ou", "re"]), "bb") for i in range(400)]
    return rows


def test_language(spark, two_tongues, empty):
    rows = [(*r, 7, "w", 0.5, "r", 3) for r in two_tongues]
    extra = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", None), (903, "the thing " * 9000, None), (None, "eau qué ou", "bb"), (904, "the", "aa"), (904, "the", "aa")]
    docs = spark.createDataFrame(rows + [(*x, 7, "w", 0.5, "r", 3) for x in extra], DOCS)
    model = language.train(docs, usable=F.col("doc_id") % 4 != 2, most=100)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang in two_tongues if i % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "aa"
    assert language.identify(empty, language.train(empty)).count() == 0


def test_toxicity(spark, two_tongues, empty):
    r = random.Random(8)
    rows, labels = [], []
    for i, t, _ in two_tongues:
        w = t.split()
        if bad := i % 4 == 0:
            for x in ("worthless", "idiot", "loserish"):
                w.insert(r.randrange(len(w) + 1), x)
        rows.append((i, " ".join(w), None, 7, "w", 0.5, "r", 3))
        labels.append((i, int(bad), "t"))
    extra = [(900, None), (901, ""), (902, "the " * 30000 + "worthless idiot"), (None, "idiot"), (903, " \n")]
    docs = spark.createDataFrame(rows + [(*x, None, 7, "w", 0.5, "r", 3) for x in extra], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (5000, None, "t"), (None, 1, "t")], "doc_id long, toxic int, text string"))
    got = toxicity.rate(docs, model).collect()
    by = {x.doc_id: x for x in got}
    held = [(by[i].score >= 0.7, bool(y)) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a and not b for a, b in held) <= 1 and sum(a and b for a, b in held) >= 0.85 * sum(b for _, b in held)
    assert len(got) == docs.count() and by[900].score < 0.7 and by[900].windows == 0 and by[902].windows > 1500
    kept = toxicity.rate(docs, model, keep=docs.columns)
    assert kept.columns == ["row", "score", "gain", "windows"] and kept.select("row.*").columns == docs.columns and kept.count() == docs.count()
    assert toxicity.rate(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_quality(spark, two_tongues, empty):
    junk = ("", "!!", "%%%", "!! %%%")
    rows = [(i, " ".join(w + junk[i % 3] for w in t.split()), None, 7, "w", 0.5, "r", 3) for i, t, _ in two_tongues]
    docs = spark.createDataFrame([*rows, (900, None, *rows[0][2:]), (901, "", *rows[0][2:]), (None, "x", *rows[0][2:])], DOCS)
    ratings = spark.createDataFrame([(i, 2 - i % 3, "t") for i in range(0, 400, 2)] + [(1, None, "t"), (None, 1, "t"), (3, 9, "t")], "doc_id long, grade int, text string")
    model = quality.train(docs, ratings, 3)
    assert (np.diff(model.thresholds()) > 0).all()
    by = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    assert len(by) == docs.count() and np.mean([by[i].grade == 2 - i % 3 for i in range(1, 400, 2)]) > 0.9
    mean = lambda g: np.mean([by[i].expected_grade for i in range(1, 400, 2) if 2 - i % 3 == g])
    assert mean(0) < mean(1) < mean(2)
    assert quality.grade(empty, quality.train(empty, ratings, 3)).count() == 0


# 6 near duplicates


def components(texts, n):
    def sets(t):
        w = words(t, SPACED)
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    s = {i: sets(t) for i, t in enumerate(texts)}
    root = dict(zip(s, s))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in s:
        for b in s:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    r = random.Random(2)
    base = [f"w{r.randrange(5000)}" for _ in range(90)]
    chain = []  # a chain of edits whose ends are unlike, and a cloud of edits of one text
    for i in range(24):
        base[(7 * i) % 90] = f"e{i}"
        chain.append(" ".join(base))
    cloud = [" ".join(f"c{i}" if j == (5 * i) % 90 else w for j, w in enumerate(base)) for i in range(12)]
    texts = corpus() + chain + cloud
    docs = frame(spark, texts)
    got = near_dedup.near_duplicates(docs, words=n).collect()
    want = components(texts, n)
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "far off")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


# 7 nearest neighbours


def test_neighbors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 16)).astype(np.float32) * r.uniform(0.5, 2, (600, 1)).astype(np.float32)
    x[50:90] = x[40]  # ties
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)] + [(700, None, 1, 0.5), (701, [0.0] * 16, 1, 0.5), (720, [float("nan")] * 16, 1, 0.5), (740, [None] * 16, 1, 0.5), (None, x[0].tolist(), 1, 0.5), (760, [1.0], 1, 0.5), (780, [float("inf")] * 16, 1, 0.5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double").repartition(3)
    g = x.astype(float) @ x.astype(float).T
    for share, least in ((1.0, 1.0), (0.2, 0.9)):
        got = defaultdict(list)
        for row in neighbors.search(vectors, vectors.where("vec_id % 20 = 0"), share=share, block_queries=12).orderBy("query_id", "rank").collect():
            got[row.query_id].append((row.vec_id, row.score))
        assert set(got) == set(range(0, 600, 20)) and all(len(v) == 20 for v in got.values())
        hits = 0
        for q, found in got.items():
            best = sorted((i for i in range(600) if i != q), key=lambda i: (-float((x[i].astype(float) * x[q]).sum()), i))[:20]
            hits += len({v for v, _ in found} & set(best))
            assert all(abs(s - g[q, v]) < 1e-12 for v, s in found) and found == sorted(found, key=lambda t: (-t[1], t[0]))
        assert hits >= least * 20 * len(got)
    assert neighbors.search(vectors.limit(0), vectors).count() == 0 and neighbors.search(vectors, vectors.limit(0)).count() == 0
    few = vectors.where("vec_id < 3")
    assert neighbors.search(few, few).count() == 6


def test_neighbors_beside_a_longer_vector(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, [1.0] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbors.search(vectors, vectors.where("vec_id in (0, 99)"), k=5, share=1.0).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, i) for i in sorted(range(1, 30), key=lambda i: -float(x[i] @ x[0]))[:5]]


def test_neighbors_of_repeated_rows(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 900 + [(0, x[0].tolist())] * 300
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for at in (0, 13):
        score = {i: float((x[i] * x[at]).sum()) for i in range(40)}
        best = sorted((i for i, _ in rows if i != at), key=lambda i: (-score[i], i))[:20]
        # One block of vectors, and several: the same rows.
        for block_rows in (8192, 8):
            got = neighbors.search(vectors, vectors.where(f"vec_id = {at}"), block_rows=block_rows, share=1.0).orderBy("rank").collect()
            assert [r.vec_id for r in got] == best and [r["rank"] for r in got] == list(range(1, 21))


def test_op7_query(spark):
    """The query's rows against brute force over the whole table: recall at its own parameters, exact scores, order."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.vec_id is not None and r.embedding is not None]
    rows = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = defaultdict(list)
    for r in neighbors.op7_neighbors(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = [i for _, i in sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)][:20]
        hits += len({i for i, _, _ in found} & set(best))
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in {i for i, _, _ in found}
        assert all(abs(s - score[ids == i][0]) < 1e-12 for i, s, _ in found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert hits >= 0.9 * 20 * len(got)


# 10 substrings


def test_substrings(spark, docs, empty):
    texts = corpus()
    got = {(r.doc_id, r.text_key): r for r in substrings.repeats(docs).collect()}
    seen = set()
    by_id = {r.doc_id: r for r in got.values()}
    for i, t in enumerate(texts):
        w = words(t, SPACED, lower=False)
        out = [False] * len(w)
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if x in seen:
                out[p : p + 20] = [True] * 20
            seen.add(x)
        assert by_id[i].n_words == len(w) and by_id[i].kept == " ".join(x for x, y in zip(w, out) if not y)
        assert {q for r in by_id[i].removed for q in range(r.start, r.stop)} == {q for q, y in enumerate(out) if y}
    assert substrings.repeats(docs).count() == docs.count() and substrings.repeats(empty).count() == 0


def test_substrings_of_branching_texts(spark):
    r = random.Random(5)
    parts = [" ".join(r.choice("ab") for _ in range(30)) if i % 2 else " ".join(f"x{r.randrange(40)}" for _ in range(25)) for i in range(8)]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.kept for x in substrings.repeats(rows).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w = t.split()
        out = [False] * len(w)
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in seen:
                out[p : p + 20] = [True] * 20
            seen.add(tuple(w[p : p + 20]))
        assert got[i] == " ".join(x for x, y in zip(w, out) if not y)




def test_substrings_of_long_windows(spark):
    text = " ".join(f"w{i}" for i in range(6000))
    rows = spark.createDataFrame([(0, text)] + [(i, f"x{i} {text} y{i}") for i in range(1, 7)], "doc_id long, text string")
    got = {x.doc_id: x.kept for x in substrings.repeats(rows, window=400).collect()}
    assert got == {0: text} | {i: f"x{i} y{i}" for i in range(1, 7)}
    with pytest.raises(ValueError):
        substrings.repeats(rows, window=65536)


def near_copies(n, seed=6):
    """Texts of which each differs from one base in a few words, and from each other in more."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(160)]
    out = []
    for i in range(n):
        w = base.copy()
        for j in range(i % 9):
            w[r.randrange(160)] = f"x{i}y{j}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_hubs_and_exact(spark, monkeypatch):
    texts = near_copies(500)
    seen = []
    hubs = near_dedup.hubs_of
    monkeypatch.setattr(near_dedup, "hubs_of", lambda posts: seen.append(hubs(posts).count()) or hubs(posts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=2).collect()}
    assert seen[0] < 500  # one pair a class
    sets = [{tuple(w[j : j + 2]) for j in range(len(w) - 1)} for w in (t.split() for t in texts)]
    few = range(0, 500, 5)
    assert all(got[i] == got[j] for i in few for j in few if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=2, exact=True).collect()} == got


@pytest.mark.parametrize("n", [800])
def test_near_duplicates_about_the_threshold(spark, monkeypatch, n):
    """A group whose pairs lie about the threshold is joined with pairs in proportion to its classes."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(n):
        w = base.copy()
        for j in r.sample(range(200), 6):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    pairs, write = [], near_dedup.durable

    def counted(df):
        out = write(df)
        if {"a", "b"} <= set(out.columns):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "durable", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, words=2).collect()}
    assert sum(pairs) <= 30 * n and max(pairs) <= 10 * n
    sets = [{tuple(w[j : j + 2]) for j in range(len(w) - 1)} for w in (t.split() for t in texts)]
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same) and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {i: top(i) for i in range(n)}


def test_fits_take_stretches_of_long_texts(spark):
    docs = spark.createDataFrame([(i, f"begin{i} " + "w " * (5000 * i) + f"end{i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", lambda c: F.lit(True), 100, 4096)
    assert len(rows) == 6 and all(0 < len(t) <= 4096 for t, _ in rows) and sorted(y for _, y in rows) == [0, 0, 0, 1, 1, 1]
    assert toxicity.labelled(docs, labels, "toxic", lambda c: F.lit(True), 100, 4096) == rows


def test_language_by_a_plain_network(two_tongues, spark):
    """Scores of a forward pass that is written out: embedding, filter by filter and place by place, largest response, softmax, mean."""
    model = language.train(spark.createDataFrame(two_tongues, "doc_id long, text string, lang string"), most=40)
    texts = [t for _, t, _ in two_tongues[:3]] + ["x", "É" * 300, "der und " * 100]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        data, logs = text.encode(), []
        for at in range(0, len(data), language.SPAN):
            e = model.embed[np.frombuffer(data[at : at + language.SPAN].ljust(language.SPAN, b"\0"), np.uint8)].astype(float)
            pooled = [max(0.0, max(float((e[p : p + len(f)] * f[:, :, c]).sum()) for p in range(len(e) - len(f) + 1))) for f in model.filters for c in range(f.shape[2])]
            z = np.array(pooled) @ model.out + model.bias
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        mean = np.mean(logs, 0)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[i].lang_pred == model.classes[p.argmax()] and abs(got[i].score - p.max()) < 1e-3 and got[i].windows == len(logs)


def test_toxicity_by_plain_compression(spark):
    r = random.Random(2)
    ordinary = [" ".join(r.choice("lorum ipsen dolar sitta amet".split()) + str(r.randrange(9)) for _ in range(50)) for _ in range(160)]
    bad = [t.replace("lorum1", "vile scum").replace("ipsen2", "filthy rat") for t in ordinary]
    model = toxicity.Model([t.encode() for t in ordinary + bad], [0] * 160 + [1] * 160)
    texts = [ordinary[0], bad[1], "", None, "vile", " ".join(bad[:5]), "É" * 100]
    got = {x.doc_id: x for x in toxicity.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    packers = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
    for i, t in enumerate(texts):
        w = words(t, SPACED)
        spans = [" ".join(w[a : a + toxicity.WORDS]) for a in range(0, max(1, len(w) - 1), toxicity.STEP)] if w else []
        saved = [len(packers[1].compress(x.encode())) - len(packers[0].compress(x.encode())) for x in spans]
        counts = [sum(s >= k for s in saved) for k in toxicity.LEVELS]
        want = model.score(np.log1p(np.array([[*counts, len(saved), min(20, max([0, *saved]))]])))[0]
        assert (got[i].windows, got[i].gain) == (len(saved), max([0, *saved])) and abs(got[i].score - want) < 1e-12
    assert got[1].score > 0.7 > got[0].score
