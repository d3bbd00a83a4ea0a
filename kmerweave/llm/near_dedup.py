"""MinHash near-duplicate detection with odd sketches (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import LOWER, SPACED, chunks, durable, find_words, hash_runs, hash_words, session, table

#: Bands and rows of the banding: a pair of similarity 0.8 shares no band with odds of 3e-7. Bits of an odd sketch.
BANDS, ROWS, SKETCH = 44, 5, 1024
#: Classes, of 24 bytes, that are broadcast at most.
IDS_TO_SEND = 400_000
#: A pair goes on to the exact check unless its sketches differ in more bits than similarity 0.8 does in all but a
#: few of a million cases.
MARGIN = 5.0
#: Rounds, at most, in which classes meet members of their buckets' commonest components.
DRAWS = 12


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of n words (of all its words, where it has fewer), sorted within the text, and each text's first."""
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    of = np.repeat(np.arange(len(size)), count)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    runs = hash_runs(words, start, np.minimum(size, n)[of])
    order = np.lexsort((runs, of))
    of, runs = of[order], runs[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (runs[1:] != runs[:-1])
    return runs[new], np.searchsorted(of[new], np.arange(len(size) + 1))


_SEEDS = np.random.default_rng(8128).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def minhash(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sampled smallest values of each non-empty set, under BANDS * ROWS multiplicative orders."""
    out = np.empty((len(at) - 1, len(_SEEDS)), np.uint64)
    for i, seed in enumerate(_SEEDS):
        v = sets * seed
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = np.minimum.reduceat(v, at[:-1])
    return out


def sign(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and odd sketches: each (order, smallest value) flips one of SKETCH bits."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ samples[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    bits = np.zeros((len(samples), SKETCH), np.uint8)
    place = ((samples + _SEEDS) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(54)).astype(np.int64) % SKETCH
    for i in range(samples.shape[1]):
        bits[np.arange(len(samples)), place[:, i]] ^= 1
    return keys, np.packbits(bits, axis=1)


def parity(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Odd sketches of the full sets: two of them differ in no more bits than their sets do in members."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    counts = np.bincount(of * SKETCH + (sets >> np.uint64(54)).astype(np.int64) % SKETCH, minlength=(len(at) - 1) * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, SKETCH), axis=1)


def bound(similarity: float) -> int:
    """The most differing bits that a pair of this similarity shows, but for MARGIN deviations.

    2 (1 - J) m flips of the m samples fall on the XOR of two sketches (each differing sample flips two bits); a bit is odd
    with probability (1 - (1 - 2/n)^flips) / 2.
    """
    m = BANDS * ROWS
    differ = m * (1 - similarity) + MARGIN * np.sqrt(m * similarity * (1 - similarity))
    odd = SKETCH * (1 - (1 - 2 / SKETCH) ** (2 * min(differ, m))) / 2
    return int(np.ceil(odd + 2 * np.sqrt(odd)))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids on undirected edges (a, b): the smallest id reachable.

    Each id takes the smallest one next to it as its parent, and parents' parents until none moves, so chains halve.
    Edges are then those between the roots, fewer each round, until none is left; ids find their last root on the way
    back. What a round leaves is written. Hot ids cost a partial aggregate. ``edges`` should be a written table.
    """
    levels = []
    while not levels or not edges.isEmpty():
        both = edges.selectExpr("a as id", "b as to").union(edges.selectExpr("b as id", "a as to"))
        parents, moved = both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), True
        while moved:
            above = parents.select(F.col("id").alias("component"), F.col("component").alias("root"))
            step = durable(parents.join(above, "component").select("id", F.col("root").alias("component"), (F.col("root") < F.col("component")).alias("moved")))
            parents, moved = step.select("id", "component"), not step.where("moved").isEmpty()
        levels.append(parents)
        roots = edges.join(parents.toDF("a", "x"), "a").join(parents.toDF("b", "y"), "b").where("x <> y")
        edges = durable(roots.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    parts = levels.pop()
    for level in reversed(levels):
        parts = durable(level.join(parts.toDF("component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")))
    return parts


def hubs_of(posts: DataFrame) -> DataFrame:
    """One pair (a, b) at most for each class of (bucket, id, component). A bucket's hub is its class of most company
    (members of its buckets, together): in a group of near copies the one least edited. Of the hubs of other components
    in its buckets a class takes the one with which it shares most, the smallest of equals."""
    sizes = posts.groupBy("bucket").agg(F.count("*").alias("members"))
    company = posts.join(sizes, "bucket").groupBy("id").agg(F.sum("members").alias("company"))
    hubs = posts.join(company, "id").groupBy("bucket").agg(F.min(F.struct((-F.col("company")).alias("c"), "id", "component")).alias("hub"))
    met = posts.join(hubs.selectExpr("bucket", "hub.id as y", "hub.component as to"), "bucket").where("component <> to").groupBy("id", "y").agg(F.count("*").alias("c"))
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("c"), "y")).alias("r"))
    return best.select(F.least("id", "r.y").alias("a"), F.greatest("id", "r.y").alias("b")).distinct()


def prefixes(sets: np.ndarray, at: np.ndarray, percent: int) -> list[np.ndarray]:
    """So many of each set's smallest hashes that two sets of that similarity share one of them at least."""
    return [sets[i : i + (j - i) - -(-percent * (j - i) // 100) + 1] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """Groups of documents that links of Jaccard similarity of at least ``similarity`` join.

    Takes (doc_id, text); returns (doc_id, text_key, n_shingles, component_id, kept), a row for each input row. Words are parted
    by ASCII white space, A-Z lower-cased; a document's set has its distinct runs of ``words`` words (its whole
    sequence, if shorter). component_id is the smallest doc_id reachable; kept says that it is the row's own.

    1. Documents of equal sets are one class, known by a number; only classes go on, so that copies cost nothing.
    2. Each class has MinHash samples, band keys and two odd sketches: the parity of its samples' places, and that of
       its full set, whose differing bits can't outnumber the differing shingles.
    3. Each class meets one hub: of the central classes of its band buckets the one with which it shares most. Pairs
       whose sketches are near and whose full sets confirm it are linked, so a group of true copies becomes one component
       for a pair a class.
    4. In rounds, each class outside its bucket's commonest component meets members of it drawn anew, one for each of its buckets, and
       the nearest by sketch is confirmed, as long as that links a tenth of them: a group whose pairs lie about the threshold,
       half of them links, halves what is left each round.
    5. In buckets that hold more than one component then, every class that is not in the bucket's commonest component
       meets every class of another component whose sketches are near. The nearest such pair of each component is confirmed
       first; pairs that then lie within one component need not be. No pair is left out for the size of its bucket.

    The bands miss a pair of similarity 0.8 with odds of 3e-8 and the sketch of samples with odds of about 1e-6. With ``exact``,
    nothing is left to odds: buckets are the hashes that the smallest (1 - similarity) of two similar sets must share, and the
    full sets' sketches alone reject; long texts then post a fifth of their shingles.

    Null, empty or wordless text: no shingles, linked with nothing, its own component. Null doc_id: component_id null,
    kept true, and it links nothing. Repeated rows: each kept as the first. Other columns are not read.
    """
    session(docs)
    percent, bits = round(100 * similarity), [f"s{i}" for i in range(SKETCH // 32)]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    one = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary())])

    def measured(batches: Iterator[pa.RecordBatch], full: bool):
        for batch in batches:
            for part, data, at in chunks(batch):
                lower = LOWER[data]
                starts, ends, first = find_words(lower, at, SPACED)
                yield part, *shingles(hash_words(lower, starts, ends), first, words)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, at in measured(batches, False):
            # Two sums over a set's hashes, of 64 bits each, name it.
            empty = np.diff(at) == 0
            pad = np.append(sets, np.uint64(0))
            a, b = (np.add.reduceat(f(pad), np.minimum(at[:-1], len(sets))) for f in (lambda x: x, lambda x: (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) ^ x))
            names = [None if e else x.tobytes() for e, x in zip(empty, np.stack([a, b], -1), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at)), pa.array(names, pa.binary())], schema=one)

    sized = durable(base.mapInArrow(keys, "doc_id long, text_key long, n_shingles long, set_key binary"))
    classes = sized.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    # Written with their numbers, which are then fixed. A doc_id that stands with several texts may name several classes.
    classes = durable(classes.select(F.col("r.doc_id").alias("doc_id"), F.col("r.text_key").alias("text_key"), "set_key", F.monotonically_increasing_id().alias("id")))
    ids = classes.select("doc_id", "text_key", "id")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, at in measured(batches, True):
            full = np.flatnonzero(np.diff(at))
            if len(full):
                bounds = np.append(at[full], len(sets))
                k, sketch = sign(minhash(sets, bounds))
                k = prefixes(sets, bounds, percent) if exact else k
                sketch = np.concatenate([sketch, parity(sets, bounds)], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), part.column(1).take(pa.array(full)), pa.array(np.diff(at)[full]), pa.array([x.view(np.int64) for x in k], pa.list_(pa.int64())), *(pa.array(c) for c in np.ascontiguousarray(sketch.T))], names=["doc_id", "text_key", "n", "bands", *bits])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, at in measured(batches, True):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.astype(np.int64)))], names=["id", "set"])

    # Signatures are made where the texts lie, copies' too: those are a sixth of a text, so only they are moved. A
    # class may have several rows of one id and text; one stands for it.
    signs = base.where("doc_id is not null").mapInArrow(signed, "doc_id long, text_key long, n long, bands array<long>, " + ", ".join(f"{b} long" for b in bits))
    signs = durable(signs.join(ids, ["doc_id", "text_key"]).dropDuplicates(["id"]))
    # Only classes that share a band with another go on.
    posted = signs.select("id", "n", F.posexplode("bands").alias("band", "key"))
    bucket = F.col("key") if exact else F.xxhash64("band", "key")
    slim = posted.select("id", bucket.alias("bucket"))
    shared = slim.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    posts = durable(slim.join(shared, "bucket"))
    sketches = durable(signs.select("id", "n", *bits).join(posts.select("id").distinct(), "id", "left_semi"))
    # Plain columns, not arrays: the comparison of two sketches stays small enough to be compiled.
    wide = lambda s, to: s.select(F.col("id").alias(to), F.col("n").alias(f"n_{to}"), *(F.coalesce(b, F.lit(0)).alias(f"{b}_{to}") for b in bits))
    apart = lambda start: " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in bits[start : start + SKETCH // 64])
    sides = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    near = f"{100 + percent} * ({apart(SKETCH // 64)}) <= {100 - percent} * (n_a + n_b)" + ("" if exact else f" and {apart(0)} <= {bound(similarity)}")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches are near and whose full sets are similar enough."""
        close = durable(pairs.join(wide(sketches, "a"), "a").join(wide(sketches, "b"), "b").where(f"{sides} and {near}").select("a", "b", "n_a", "n_b"))
        need = durable(close.selectExpr("a as id").union(close.selectExpr("b as id")).distinct().join(ids, "id"))
        # A list of ids of checked size goes to the texts; a longer one meets them in a shuffle.
        few = F.broadcast(need) if need.count() <= IDS_TO_SEND else need
        sets = base.join(few, ["doc_id", "text_key"]).select("id", "text_key", "text").mapInArrow(listed, "id long, set array<long>").dropDuplicates(["id"])
        met = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        same = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        return durable(met.withColumn("same", same).where(f"100 * same >= {percent} * (n_a + n_b - same)").select("a", "b"))

    links = confirmed(hubs_of(posts.withColumn("component", F.col("id"))))
    parts = components(links)
    placed = mixed(posts, parts)
    for turn in range(DRAWS):
        outside = by_main(placed).where("component <> main")
        left = outside.select("id").distinct().count()
        if not left:
            break
        drawn = by_main(placed).where("component = main").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id"))["id"].alias("b"))
        met = outside.select("bucket", F.col("id").alias("a")).join(drawn, "bucket").select("a", "b").distinct()
        some = met.join(wide(sketches, "a"), "a").join(wide(sketches, "b"), "b").where(f"{sides} and {near}")
        nearest = some.groupBy("a").agg(F.min(F.struct(F.expr(f"({apart(SKETCH // 64)}) / (n_a + n_b)").alias("d"), "b"))["b"].alias("b"))
        new = confirmed(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = new.count()
        if found:
            links = links.union(new)
            parts = components(links)
            placed = mixed(posts, parts)
        if 10 * found < left:
            break
    # Whatever is not of a bucket's commonest component meets all others there; the sketches decide within the join.
    known = by_main(placed)
    left = known.where("component <> main").join(wide(sketches, "a"), known["id"] == F.col("a")).drop("id", "main").withColumnRenamed("component", "part_a")
    right = known.join(wide(sketches, "b"), known["id"] == F.col("b")).drop("id").selectExpr("*", "component as part_b").drop("component")
    met = left.join(right, (left["bucket"] == right["bucket"]) & F.expr(f"part_a <> part_b and (part_b = main or a < b) and {sides} and {near}"))
    open_pairs = durable(met.selectExpr("least(a, b) as a", "greatest(a, b) as b", "if(a < b, part_a, part_b) as x", "if(a < b, part_b, part_a) as y", f"({apart(SKETCH // 64)}) / (n_a + n_b) as d").distinct())
    # While these outnumber the classes, the nearest pair of each component is confirmed first, so that most others lie
    # within one component when their turn comes. What is left then, of no more pairs than classes, is confirmed at once.
    classes_met, linked = sketches.count(), True
    while linked and open_pairs.count() > classes_met:
        ends = open_pairs.select(F.explode(F.array("x", "y")).alias("end"), F.struct("d", "a", "b").alias("r"))
        first = durable(ends.groupBy("end").agg(F.min("r").alias("r")).select("r.a", "r.b").distinct())
        new = confirmed(first)
        linked = not new.isEmpty()
        links = links.union(new)
        parts = components(links)
        moved = open_pairs.join(first, ["a", "b"], "left_anti").join(parts.toDF("a", "p"), "a", "left").join(parts.toDF("b", "q"), "b", "left")
        open_pairs = durable(moved.selectExpr("a", "b", "coalesce(p, x) as x", "coalesce(q, y) as y", "d").where("x <> y"))
    new = confirmed(open_pairs.select("a", "b"))
    if not new.isEmpty():
        parts = components(links.union(new))
    # A component's name is the smallest doc_id of its classes.
    members = durable(classes.join(parts, "id", "left").select("set_key", F.col("doc_id").alias("own"), F.coalesce("component", "id").alias("component")))
    least = members.groupBy("component").agg(F.min("own").alias("least"))
    named = sized.join(durable(members.join(least, "component")).select("set_key", "least"), "set_key", "left")
    whole = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least", "doc_id"))
    out = named.select("doc_id", "text_key", "n_shingles", whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def mixed(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """(bucket, id, component) of the buckets that hold several components."""
    placed = posts.join(parts, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return durable(placed.join(several, "bucket"))


def by_main(placed: DataFrame) -> DataFrame:
    """The rows with ``main``, their bucket's commonest component."""
    main = placed.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    return placed.join(main, "bucket")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
