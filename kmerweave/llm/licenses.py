"""Licence scans with a positional rare-token index, in DataFrame expressions only (operator 2)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import table

# Phrases of the contract (words, label), found at every place where the words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further templates (words, label, mandatory key phrase), found where enough words stand in their places.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license"),
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "free of charge to any person obtaining a copy"),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "general public license version 3"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "general public license version 2"),
    ("gnu lesser general public license", "lgpl", "lesser general public license"),
    ("gnu affero general public license", "agpl", "affero general public license"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "by sa"),
    ("licensed under the mozilla public license version 2 0", "mpl-2.0", "mozilla public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
    # Titles, which must be whole: without "gnu" a version's phrase may be of the lesser or the affero licence.
    ("apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("apache license 2 0", "apache-2.0", "apache license 2 0"),
    ("mit license", "mit", "mit license"),
    ("gnu general public license version 3", "gpl-3.0", "gnu general public license version 3"),
    ("gnu general public license version 2", "gpl-2.0", "gnu general public license version 2"),
    ("mozilla public license version 2 0", "mpl-2.0", "mozilla public license version 2 0"),
]

#: Groups that the index's words fall into by hash, so that a lookup meets a few of them.
SHELVES = 256

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text"):
    """The lower-cased words of a whole text as an array; none for null."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def listed(vocabulary) -> str:
    """Words as SQL literals. Words hold no quotes; what does can't be met and is left out."""
    return ", ".join(f"'{w}'" for w in vocabulary if not set(w) & {"'", "\\"}) or "''"


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency, over all documents, of the words that templates use: as many counts as those."""
    found = docs.select(words().alias("words")).select(F.explode(F.expr(f"array_distinct(filter(words, w -> w in ({listed(vocabulary)})))")).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in found.collect()}
    return {w: 1.0 / (1 + seen.get(w, 0)) for w in vocabulary}


def postings(idf: dict[str, float], phrases: dict[str, str], templates: list[tuple[str, str, str]]) -> tuple[list, list]:
    """(templates, postings): templates as (t, words, key, n, label, exact), ``key`` and ``n`` the place and length of the key phrase, which must
    be there (a phrase is its own key); postings as (word, t, at, nth, last): the two rarest words of each key phrase, rarest first, at
    their places in the template; ``last`` marks the last of its template."""
    known, posts = [], []
    for text, label, phrase, exact in [*((t, label, t, True) for t, label in phrases.items()), *((*t, False) for t in templates)]:
        ws, ks = text.split(), phrase.split()
        key, t = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks), len(known)
        known.append((t, ws, key, len(ks), label, exact))
        rare = sorted(range(key, key + len(ks)), key=lambda i: (-idf[ws[i]], i))[:2]
        posts += [(ws[at], t, at, nth, nth == len(rare)) for nth, at in enumerate(rare, 1)]
    return known, posts


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str, str]] | None = None, least: float = 0.7) -> DataFrame:
    """Licence notices in documents.

    Takes (doc_id, text), returns (doc_id, n_words, places, found): places array<struct<start,phrase>> for the exact
    phrases, found array<struct<start,label,share>> for the templates of which at least ``least`` of the words stand
    at their relative positions with the key phrase whole.

    The index is a table of postings (word, template, place): the two words of highest inverse document frequency over the corpus of
    each template's key phrase. A document's words that it holds are looked up; a hit says where the template would start, and the starts
    that the postings of a template's both words give are intersected. There the key phrase is compared, and the template's other
    words are met at their relative positions. Index and templates are two literals of the plan, as large as the templates given;
    the plan's expressions don't grow with them. All happens within a row, so neither common words nor large groups move any
    data; the only shuffle counts the templates' own words.

    Null or empty text: no words, nothing found. Null doc_id and repeated rows: a row each. Other columns aren't read.
    """
    phrases, templates, spark = phrases or PHRASES, templates or TEMPLATES, docs.sparkSession
    vocabulary = sorted({w for t in [*phrases, *(t for t, _, _ in templates)] for w in t.split()})
    known, posts = postings(rarity(docs, vocabulary), phrases, templates)
    many, longest = len(known), max(len(t[1]) for t in known)
    shelf = lambda w: F.pmod(F.xxhash64(w), F.lit(SHELVES)).cast("int")
    # SHELVES maps from words to their postings, and the templates by number: two literals, which the optimizer reads once.
    shelf_of = {r["word"]: r["shelf"] for r in spark.createDataFrame([(w,) for w in {p[0] for p in posts}], "word string").select("word", shelf(F.col("word")).alias("shelf")).collect()}
    shelves: list[dict] = [{} for _ in range(SHELVES)]
    for word, t, at, nth, last in posts:
        shelves[shelf_of[word]].setdefault(word, []).append({"t": t, "at": at, "nth": nth, "last": last})
    index = F.from_json(F.lit(json.dumps(shelves)), "array<map<string,array<struct<t:bigint,at:int,nth:int,last:boolean>>>>")
    kept = F.from_json(F.lit(json.dumps([dict(zip(("words", "key", "n", "label", "exact"), t[1:], strict=True)) for t in known])), "array<struct<words:array<string>,key:int,n:int,label:string,exact:boolean>>")

    held = ", ".join(sorted({w for w, *_ in posts}))
    rows = docs.select("doc_id", words().alias("words"))
    rows = rows.withColumn("hits", F.expr(f"filter(transform(words, (w, i) -> case when w in ({listed(held.split(', '))}) then i end), i -> i is not null)"))
    # A start of a template in one number: (start + longest) * many + template.
    place = lambda i, p: (i - p["at"] + longest).cast("long") * many + p["t"]
    posted = lambda w: F.element_at(F.get(index, shelf(w)), w)
    starts = lambda which: F.flatten(F.transform("hits", lambda i: F.transform(F.filter(posted(F.get("words", i)), which), lambda p: place(i, p))))
    some_hits = F.size("hits") > 0
    rows = rows.withColumn("starts", F.when(some_hits, F.array_intersect(starts(lambda p: p["nth"] == 1), starts(lambda p: p["last"]))))
    met = F.transform("starts", lambda c: F.struct((F.floor(c / F.lit(many)) - longest).cast("int").alias("start"), F.get(kept, (c % many).cast("int")).alias("t")))
    same = lambda c: (c["start"] + c["t"]["key"] >= 0) & (F.slice("words", F.greatest(c["start"] + c["t"]["key"], F.lit(0)) + 1, c["t"]["n"]) == F.slice(c["t"]["words"], c["t"]["key"] + 1, c["t"]["n"]))
    rows = rows.withColumn("met", F.filter(met, same))

    def notice(c):
        there = F.size(F.filter(F.transform(c["t"]["words"], lambda w, i: F.get("words", c["start"] + i).eqNullSafe(w)), lambda x: x))
        return F.struct(c["start"].alias("start"), c["t"]["label"].alias("label"), (there / F.size(c["t"]["words"])).alias("share"))

    none = F.array().cast("array<struct<start:int,label:string,share:double>>")
    some = lambda which: F.coalesce(F.filter(F.transform(F.filter("met", which), notice), lambda x: x["share"] >= least), none)
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), some(lambda c: c["t"]["exact"]).alias("places"), some(lambda c: ~c["t"]["exact"]).alias("found"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as bigint) as n_base",
        "cast(array_min(transform(places, p -> p.start)) as bigint) as first_word",
        "cast(array_max(transform(places, p -> p.start)) as bigint) as last_word",
        "array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',') as base_labels",
        "array_join(array_sort(array_distinct(transform(concat(places, found), p -> p.label))), ',') as labels",
        "coalesce(array_max(transform(concat(places, found), p -> p.share)), 0.0D) as score",
    )
