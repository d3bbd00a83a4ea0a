"""The registered queries over a given small table: the columns of their contracts, from plain Python or SQL."""

import os
import re
import struct
import zlib

import duckdb
import pytest

from kmerweave.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()))


def test_op1(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in tables.sql("select doc_id, text from documents").fetchall()}
    pieces, sequences = {}, {}
    for r in QUERIES["op1_packing"](spark, SF).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for spans, whole in [*((p, len(ids[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 1024
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 1024) * 1.05 + 2


RULES = [("com", "/", "allow", "com/"), ("example.com", "/en/", "block", "example.com/en/"), ("www.example.com", "/en/", "allow", "www.example.com/en/"), ("net", "/es/", "block", "net/es/"), ("net", "/fr/", "block", "net/fr/")]


def test_op4(spark, tables):
    urls = dict(tables.sql("select page_id, url from pages").fetchall())
    rows = QUERIES["op4_url_filter"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (found[1], found[2]) if found else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r.host, r.path) == (host, path)
        fits = [(len(name), v, name) for h, p, v, name in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (r.verdict, r.rule) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict in ("allow", "block")


def test_op5(spark, tables):
    texts = dict(tables.sql("select doc_id, text from documents").fetchall())
    langs = {x for (x,) in tables.sql("select distinct lang from documents where lang is not null").fetchall()}
    rows = QUERIES["op5_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in langs if any(c.isalpha() for c in texts[r.doc_id] or "") else r.lang_pred == "und"


@pytest.mark.parametrize("name,mod,rest,flag,score,least", [("op8_toxicity", 3, 1, "predicted", "score", 0.7), ("op9_quality", 4, 2, "selected", "tail", 0.5)])
def test_scores(spark, tables, name, mod, rest, flag, score, least):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for (i,) in tables.sql("select doc_id from documents").fetchall())
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % mod == rest) and 0 <= r[score] <= 1 and bool(r[flag]) == (r[score] >= least)


def test_op7(spark, tables):
    import numpy as np

    ids, vectors = zip(*tables.sql("select vec_id, embedding from embeddings order by vec_id").fetchall(), strict=True)
    x = np.array(vectors, float)
    rows = {}
    for r in QUERIES["op7_neighbors"](spark, SF).collect():
        rows.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i, q in enumerate(ids):
        if q % 20 == 0:
            scores = x @ x[i]
            best = sorted((-s, j) for j, s in zip(ids, scores.tolist(), strict=True) if j != q)[:20]
            got = sorted(rows.pop(q))
            assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s - scores[ids.index(v)]) < 1e-9 for _, v, s in got)
            hits += len({v for _, v, _ in got} & {j for _, j in best})
            total += 20
    assert not rows and hits >= 0.9 * total
