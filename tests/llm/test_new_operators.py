"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kmerweave.llm import conversations, divergence, topk

# --- conversations ---

START, S, U, A = range(4)


def cheapest(rows, most=40):
    """(cost, audit) by uniform-cost search over all edits, least audit first."""
    import heapq

    heap, done = [(0, "", 0, START)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (START, A):
            return cost, audit
        follows = A if state == U else U
        heapq.heappush(heap, (cost + 3, audit + "I", i, follows))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not gone:
                kept = S if initial == "s" and state == START else follows if initial == "ua"[follows - 2] else None
                if kept is not None:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, kept))
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, follows))


def kinds(rows):
    return bytes({"s": 1, "u": 2, "a": 3}.get(i, 0) + 4 * gone + 8 * cut for i, gone, cut in rows)


def test_repair_is_cheapest_and_least():
    every = [(i, gone, cut) for i in "suax" for gone, cut in ((False, False), (True, False), (False, True))]
    for n in range(4):
        for rows in itertools.product(every, repeat=n):
            assert conversations.repair(kinds(rows)) == cheapest(rows)
    rng = random.Random(3)
    for n in (6, 9, 14, 40):
        for _ in range(150):
            rows = [(rng.choice("suauax"), rng.random() < 0.15, False) for _ in range(n)]
            rows = [(i, g, not g and rng.random() < 0.2) for i, g, _ in rows]
            assert conversations.repair(kinds(rows)) == cheapest(rows)


@pytest.mark.parametrize("row", [("s", False, False), ("u", False, True), ("x", False, False), ("a", True, False)])
def test_repair_of_long_conversations(row):
    """Work and memory in proportion to the rows."""
    rows = [row, ("u", False, False)] * 20_000
    cost, audit = conversations.repair(kinds(rows))
    assert len(audit.replace("I", "")) == len(rows)
    assert (cost, audit) == cheapest(rows)


def brute(rows, hurt=True):
    """conv_id -> result, from (conv_id, turn, role, text)."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        role, text = space(role), space(text)
        tie, kept = hashlib.sha256(f"{role}:{text}".encode()).hexdigest(), by[conv]
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if hurt else 9
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [((turn is not None, turn or 0), tie, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for conv, found in by.items():
        found.sort(key=lambda r: r[:2])
        seen, states, counts, illegal = set(), [], Counter(), 0
        for _, _, _, role, text in found:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            counts[fault] += 1
            seen.add((role, text))
            states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        for a, b in itertools.pairwise(states):
            illegal += a[0] + b[0] not in ("su", "ua", "au")
        turns = [r[2] for r in found if r[2] is not None]
        cost, audit = cheapest(states)
        lines, i, state = [], 0, START
        for edit in audit:
            follows = A if state == U else U
            name = "assistant" if follows == A else "user"
            if edit == "K":
                lines.append(f"{found[i][3]}:{found[i][4]}")
                state = S if states[i][0] == "s" else follows
            elif edit in "RI":
                lines.append(f"{name}:{found[i][4] if edit == 'R' else ''}")
                state = follows
            i += edit != "I"
        gaps = min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TALK = "conv_id long, turn long, role string, text string"


def talks():
    rng = random.Random(8)
    says = ["Yes.", "Why?", "no end", "", " \t", "Yes. \n", "Oh!", None, "é…", "b. ", "c. \r\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice(says)) for c in range(120) for t in range(rng.randrange(1, 10))]
    rows += [(None, t, "user", "Hm.") for t in range(5)] + [(7, None, "system", "Be kind."), (7, None, "user", "Now."), (500, 3, "user", "x"), (500, 3, "user", "y."), (500, 3, "user", "y.")]
    rows += [(501, 2**62, "user", "Far."), (501, -(2**63), "assistant", "Apart."), (502, 0, "user", "word " * 60_000 + "."), (502, 1, "assistant", " " * 100_000)]
    return rows + rows[:40]


@pytest.mark.parametrize("hurt", [True, False])
def test_conversations(spark, hurt):
    rows = talks()
    frame = spark.createDataFrame(rows, TALK).repartition(5).selectExpr("*", "1 as kind", "2 as copy", "3 as tie", "'a' as `x.y`")
    out = conversations.mend(conversations.damage(frame) if hurt else conversations.whole(frame)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == brute(rows, hurt)
    assert len(out) == len({r[0] for r in rows})


def test_conversations_of_nothing(spark):
    assert conversations.mend(conversations.damage(spark.createDataFrame([], TALK))).collect() == []
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = conversations.mend(conversations.damage(spark.createDataFrame([(conv, 0, "user", "Hi.")], TALK))).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_streams_over_batches(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(30_000)]
    (row,) = conversations.mend(conversations.whole(spark.createDataFrame(rows, TALK))).collect()
    assert (row["cost"], row["audit"]) == (0, "K" * 30_000)
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()


# --- exact top-k ---

VECTORS = "vec_id long, embedding array<double>"


def nearest(rows, queries, k):
    from math import floor, isfinite

    usable = lambda rows: [(i, [floor(256 * x) if abs(x) < 1e15 else int(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(usable(queries)):
        asked.setdefault(i, v)
    out = []
    for i, q in asked.items():
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in usable(rows) if j != i)[:k]  # noqa: B905
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def vectors(kind, n=900, dims=20):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dims))
    if kind == "uneven":
        x *= np.exp(rng.standard_normal((n, 1)) * 2) * np.exp(-np.arange(dims))
    if kind == "ties":
        x = rng.integers(-1, 2, (n, dims)) / 256
    if kind == "large":
        x *= 10.0 ** rng.integers(0, 12, (n, 1))
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("kind", ["plain", "uneven", "ties", "large"])
def test_topk(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "1 as part", "2 as block", "3 as v", "4 as score")
    got = topk.search(df, df.where("vec_id % 50 = 0"), block_rows=200, block_queries=7, step=3)
    assert sorted(map(tuple, got.collect())) == nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-3.0, 1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0]), (7, [5.0]), (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (9, [-1e-9, 0.0]), (10, [1e300, 2.0]), (11, [1.0, 1.0]), (11, [1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    asked = df.where("vec_id % 50 = 0")
    assert sorted(map(tuple, topk.search(df, asked).collect())) == nearest(rows, rows[:3], 5)
    assert topk.search(df.limit(0), asked).collect() == [] == topk.search(df, asked.limit(0)).collect()


def test_topk_leaves_candidates_out():
    """The bounds close the columns up before the last block where the mass is uneven."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((4000, 64)) * np.exp(-np.arange(64) / 4))
    columns = topk.Columns(np.arange(4000), x, np.ones(4000, int))
    seen, real = [], topk.np.flatnonzero
    topk.np.flatnonzero = lambda a: seen.append(len(real(a))) or real(a)
    try:
        ids, scores = columns.best(-1, x[3], 5, 8, True)
    finally:
        topk.np.flatnonzero = real
    want = sorted(range(4000), key=lambda i: (-(x[i] @ x[3]), i))[:5]
    assert ids.tolist() == want and scores == [int(x[i] @ x[3]) for i in want]
    assert seen and min(seen) < 400


# --- divergence ---


def audited(rows, least=3, ranks=200):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t, _, _ in rows]
    docs, group, lang_count = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for i, ((_, lang, source), found) in enumerate(zip(rows, terms, strict=True)):
        group[lang, source].update(found)
        lang_count[lang].update(found)
        for t in found:
            docs[lang, t].add(i)
    out = []
    kept = {lang: sorted(t for t in c if len(docs[lang, t]) >= least) for lang, c in lang_count.items()}

    def shares(count, lang):
        n = sum(count[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 1) // n for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in group.items()}
    whole = {lang: shares(c, lang) for lang, c in lang_count.items()}
    for (lang, source), mine in p.items():
        pairs = [(-sum((mine[t] - q) ** 2 // q for t, q in p[lang, other].items()), other.encode()) for one, other in p if one == lang and other != source]
        over = [(-((mine[t] - q) ** 2 // q), t.encode()) for t, q in whole[lang].items() if group[lang, source][t] and mine[t] > q]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:ranks])):
            out += [(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def texts(n=400):
    rng = random.Random(11)
    stock = ["a", "Ab", "abcdefgh", "abcdefghi", "éé", "ééééé", "x" * 16, "x" * 17, "x" * 18, "X" * 33, "z" * 300, "日本語の長い文章です", "naïve", "o'clock", "b2b", "q" * 5000]
    stock += ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 22))) for _ in range(150)]
    rows = [(" ".join(rng.choices(stock, k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, "xx"]), f"s{min(rng.randrange(9), rng.randrange(9))}") for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "en", "none"), ("only here", "fr", None), (None, None, None), ("1 2 3", "nn", "a"), ("", "nn", "b")] + rows[:30]


@pytest.mark.parametrize("terms, sources", [(4096, 64), (20, 2)])
def test_divergence(spark, terms, sources):
    rows = texts()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4).selectExpr("*", "1 as term", "2 as n", "3 as i", "4 as p", "5 as value", "6 as `a.b`")
    assert sorted(map(tuple, divergence.audit(df, ranks=20, block_terms=terms, block_sources=sources).collect())) == audited(rows, ranks=20)


def test_divergence_edges(spark):
    shape = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], shape)).collect() == []
    rows = [("word " * 80_000 + "w" * 200_000, "en", "a"), ("word w", "en", "a"), ("word", "en", "b"), ("word", "en", "b")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, shape)).collect())) == audited(rows)


def test_radix_order():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> np.uint64(s) for s in (0, 57))
    assert (divergence.radix_order(a, b) == np.lexsort((a, b))).all()
    assert (divergence.radix_order(b, b) == np.argsort(b, kind="stable")).all()
    assert divergence.radix_order(np.zeros(3, np.uint64)).tolist() == [0, 1, 2] and len(divergence.radix_order(a[:0])) == 0


def test_queries_equal_their_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from kmerweave.llm import registry

    talk, vecs = talks(), vectors("ties", 120, 8)
    said = [(t, lang, s) for t, lang, s in texts(150)]
    tables = {
        "conversations": {c: [r[i] for r in talk if r[1] is None or abs(r[1]) < 2**40] for i, c in enumerate(("conv_id", "turn", "role", "text"))},
        "embeddings": {"vec_id": [i for i, _ in vecs] + [None, 500], "embedding": [v for _, v in vecs] + [vecs[0][1], None]},
        "documents": {"doc_id": list(range(len(said))), **{c: [r[i] for r in said] for i, c in enumerate(("text", "lang", "source"))}},
    }
    con = duckdb.connect()
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in ("op11_source_divergence", "op12_exact_topk", "op13_conversation_repair"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
        assert got.columns == want.columns and got.count() > 0
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall())), name
