"""The queries of registry in DuckDB's SQL, written independently of them; hash_sql has what concerns hashes and recursive rules."""

from __future__ import annotations

from kmerweave import hash_sql
from kmerweave.functions import scores

#: Bases of a k-mer, and of an l-mer of the score tables and of the hash families.
K, L, LH = 31, 8, 9

READS = "reads as (select o_orderkey as seq_id, translate(" + " || ".join(f"md5(concat(o_orderkey, '-{i}'))" for i in range(5)) + ", '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from orders)"


#: The reads of three order keys joined, in place of the reads.
JOINED = READS.replace("o_orderkey as seq_id", "o_orderkey // 3 as c, o_orderkey as o", 1).replace("reads as", "single as", 1) + ", reads as (select c as seq_id, string_agg(seq, '' order by o) as seq from single group by c)"


def _value(text: str, n: int, start: str = "0") -> str:
    return "(" + " + ".join(f"instr('CGT', substr({text}, cast({start} as bigint) + {i + 1}, 1))::bigint * {4 ** (n - 1 - i)}" for i in range(n)) + ")"


def _rc(v: str, n: int) -> str:
    return "(" + " + ".join(f"(3 - (({v} >> {2 * i}) & 3)) * {4 ** (n - 1 - i)}" for i in range(n)) + ")"


def _reverse(text: str) -> str:
    return f"reverse(translate({text}, 'ACGTacgt', 'TGCAtgca'))"


def _lmers_sql(l: int) -> str:
    return f"lmers as (select seq_id, n, pos, {_value('t', l)} as lmer from (select seq_id, length(seq) as n, pos, substr(seq, pos + 1, {l}) as t from (select seq_id, seq, unnest(range(0, length(seq) - {l - 1})) as pos from reads)))"


def _good(v: str, l: int, s: int) -> str:
    parts = "[" + ", ".join(f"(({v} >> {2 * (l - s - i)}) & {4**s - 1})" for i in range(l - s + 1)) + "]"
    return f"(case when {v} in (0, {4**l - 1}) then 1 when list_position({parts}, list_min({parts})) in (1, {l - s + 1}) then 0 else 1 end)"


def _uhs(v: str, l: int) -> str:
    from kmerweave.functions.scores import UHS_PATTERNS

    ry = "(" + " + ".join(f"(({v} >> {2 * i}) & 1) * {2**i}" for i in range(l)) + ")"
    back = "(" + " + ".join(f"(1 - (({v} >> {2 * i}) & 1)) * {2 ** (l - 1 - i)}" for i in range(l)) + ")"
    among = "(" + ", ".join(map(str, UHS_PATTERNS[l])) + ")"
    return f"(case when {v} in (0, {4**l - 1}) then 1 when {ry} in {among} or {back} in {among} then 0 else 1 end)"


def _dims(l: int, score: str) -> str:
    """dims(lmer, score, canon, is_rc); score speaks of v and c."""
    return f"dims as (select v as lmer, cast({score} as bigint) as score, c as canon, c < v as is_rc from (select v, least(v, {_rc('v', l)}) as c from (select unnest(range({4**l})) as v)))"


def _tie(base: str, tie: str) -> str:
    return f"({base}) * 2147483648 + (({tie}) & 2147483647)"


XOR = f"xor(c, {scores.XOR})"
SCORES = {
    "syncmer": (8, _good("v", 8, 2)),
    "syncmer_l9": (9, _good("v", 9, 2)),
    "msp": (8, _tie(_good("c", 8, 2), "c")),
    "mspxor": (8, _tie(_good("c", 8, 2), XOR)),
    "mspxor_s3": (8, _tie(_good("c", 8, 3), XOR)),
    "mspxor_l9": (9, _tie(_good("c", 9, 2), XOR)),
    "uhs7": (7, _uhs("v", 7)),
    "uhs8": (8, _uhs("v", 8)),
    "uhs9": (9, _uhs("v", 9)),
    "uhs11": (11, _uhs("v", 11)),
    "uhs_mspxor": (8, _tie(_uhs("c", 8), XOR)),
    "kmc2": (8, "c + case when c >> 14 = 0 or " + " or ".join(f"((c >> {2 * i}) & 15) in (0, 1)" for i in range(7)) + " then 65536 else 0 end"),
    "lexicographic": (8, "case when v = 0 then 4294967295 else v end"),
}


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def _superkmers_sql(name: str, rightmost: bool = False, canonical: bool = True) -> str:
    l, score = SCORES[name]
    w = K - l
    tie = "2147483647 - pos" if rightmost else "pos"
    back = "2147483647 - key % 2147483648" if rightmost else "key % 2147483648"
    return (
        _dims(l, score) + f", {_lmers_sql(l)}, "
        f"keyed as (select seq_id, n, pos, min(score::hugeint * 2147483648 + {tie}) over (partition by seq_id order by pos rows between current row and {w} following) as key from lmers join dims using (lmer)), "
        f"best as (select seq_id, n, pos, cast({back} as bigint) as p from keyed where pos <= n - {K}), "
        "moved as (select *, lag(p) over (partition by seq_id order by pos) as was from best), "
        f"runs as (select seq_id, n, pos, p, coalesce(lead(pos) over (partition by seq_id order by pos) + {K - 1}, n) as stop from moved where was is null or was <> p), "
        f"sk as (select r.seq_id, r.pos::bigint as start, {'canon' if canonical else 'm.lmer'}::int as mint, (stop - r.pos)::int as size, (p - r.pos)::int as mpos, {'is_rc' if canonical else 'false'} as mint_is_rc from runs r join lmers m on m.seq_id = r.seq_id and m.pos = r.p join dims d on d.lmer = m.lmer)"
    )


def _seen(l: int, score: str, kind: str = "bigint") -> str:
    """dims of the l-mers that occur in lmers."""
    return f"dims as materialized (select v as lmer, cast({score} as {kind}) as score, c as canon, c < v as is_rc from (select v, least(v, {_rc('v', l)}) as c from (select distinct lmer as v from lmers)))"


_MINTED = "join lmers m on m.seq_id = r.seq_id and m.pos = r.p join dims d on d.lmer = m.lmer"


def _sticky_sql(score: str, l: int, mint: str = "canon", rc: str = "is_rc", source: str = READS) -> str:
    return (
        "with recursive " + ", ".join((source, _lmers_sql(l), _seen(l, score), "scored as (select seq_id, n, pos, score from lmers join dims using (lmer))", hash_sql.sticky("scored", K - l + 1, K)))
        + f", runs as (select w.seq_id, i, p, coalesce(lead(i) over (partition by w.seq_id order by i) + {K - 1}, n) as stop from walked w join (select distinct seq_id, n from lmers) using (seq_id)), "
        f"sk as (select r.seq_id, i::bigint as start, {mint}::int as mint, (stop - i)::int as size, (p - i)::int as mpos, {rc} as mint_is_rc from runs r {_MINTED}) "
    )


def _islands(best: str) -> str:
    """runs(seq_id, start, p, size) of neighbouring k-mers of best(seq_id, pos, p) with one place."""
    return (
        f"best as materialized ({best}), moved as (select *, coalesce(lag(p) over o <> p or lag(pos) over o <> pos - 1, true) as new from best where p is not null window o as (partition by seq_id order by pos)), "
        "grouped as (select *, sum(new::int) over (partition by seq_id order by pos) as g from moved), "
        f"runs as (select seq_id, min(pos) as start, any_value(p) as p, max(pos) - min(pos) + {K} as size from grouped group by seq_id, g)"
    )


def _best(key: str, back: str, source: str = "lmers join dims using (lmer)") -> str:
    """Each k-mer's place p, from the smallest key of its l-mers; null where all keys are."""
    return f"select seq_id, n, pos, cast({back} as bigint) as p from (select seq_id, n, pos, min({key}) over (partition by seq_id order by pos rows between current row and {K - LH} following) as key from {source}) where pos <= n - {K}"


_LEFT, _LEFT_BACK = "score::hugeint * 2147483648 + pos", "key % 2147483648"
_RIGHT, _RIGHT_BACK = "score::hugeint * 2147483648 + 2147483647 - pos", "2147483647 - key % 2147483648"
_OF_RUNS = f"select r.seq_id, start::bigint as start, canon::int as mint, size::int as size, (p - start)::int as mpos, is_rc as mint_is_rc from runs r {_MINTED}"
_TEXTS = "texts as (select r.seq_id, start, size, p - start as mpos{more}, substr(seq, start + 1, size) as text from runs r join reads using (seq_id))"


def _kept(l: int) -> str:
    """lmers, evaluated once."""
    return _lmers_sql(l).replace("lmers as (", "lmers as materialized (", 1)


def _candidates_sql(mode: str, source: str = READS) -> str:
    rank = {"sticky": "case when c = 0 then 1 else 0 end", "classical": "0", "msp": "c + case when c = 0 then 4294967296 else 0 end", "mspxor": f"{XOR} + case when c = 0 then 4294967296 else 0 end"}[mode]
    head = ", ".join((source, _kept(LH), _seen(LH, f"case when {hash_sql.candidate('v', LH)} then {rank} end")))
    best = _best(_RIGHT, _RIGHT_BACK)
    if mode != "sticky":
        return f"with {head}, {_islands(best)} {_OF_RUNS}"
    walked = "walked(seq_id, n, i, p) as (select seq_id, n, pos, p from picks where pos = 0 union all select s.seq_id, s.n, s.pos, s.p from walked w join picks s on s.seq_id = w.seq_id and s.pos = coalesce(w.p, w.i) + 1)"
    return f"with recursive {head}, picks as materialized ({best}), {walked}, runs as (select seq_id, i as start, p, least(p, n - {K}) - i + {K} as size from walked where p is not null) {_OF_RUNS}"


def _naive_sql(rightmost: bool) -> str:
    parts = "[" + ", ".join(f"((v >> {2 * (LH - 2 - i)}) & 15)" for i in range(LH - 1)) + "]"
    head = ", ".join((READS, _lmers_sql(LH), _seen(LH, f"case when list_position({parts}, list_min({parts})) in (1, {LH - 1}) then 0 end")))
    best = _best(_RIGHT, _RIGHT_BACK) if rightmost else _best(_LEFT, _LEFT_BACK)
    mpos, flip = hash_sql.oriented(LH)
    return f"with {head}, {_islands(best)}, {_TEXTS.format(more='')} select seq_id, start::bigint as start, 0::int as mint, size::int as size, ({mpos})::int as mpos, {flip} as mint_is_rc from texts"


def _quarantine_sql(source: str = READS, l: int = LH) -> str:
    """CTEs up to q(seq_id, start, size, mpos, mint_is_rc, text)."""
    canon = lambda x: f"least({x}, {_reverse(x)})"
    m = canon(f"substr(text, mpos + 1, {l})")
    there = lambda j: (f"{canon(f'substr(text, ({j} + 1)::bigint, {l})')} = m", f"{canon(f'substr(text, (size - {l} - {j} + 1)::bigint, {l})')} = m")
    mpos, flip = hash_sql.oriented(l)
    fwd, rev = there("j")
    return ", ".join((
        source, _kept(l), _seen(l, hash_sql.nthash("v", l), "ubigint"),
        f"keyed as (select seq_id, n, pos, min({_LEFT}) over o as a, min({_RIGHT}) over o as b from lmers join dims using (lmer) window o as (partition by seq_id order by pos rows between current row and {K - l} following))",
        f"best as (select seq_id, pos, cast(a % 2147483648 as bigint) as p, a % 2147483648 <> 2147483647 - b % 2147483648 as many from keyed where pos <= n - {K})",
        "moved as (select *, coalesce(lag(p) over (partition by seq_id order by pos) <> p, true) or many as new from best)",
        "grouped as (select *, sum(new::int) over (partition by seq_id order by pos) as g from moved)",
        f"runs as (select seq_id, min(pos) as start, any_value(p) as p, max(pos) - min(pos) + {K} as size, arg_min(many, pos) as many from grouped group by seq_id, g)",
        _TEXTS.format(more=", many"),
        f"named as (select *, {m} as m from texts)",
        f"first as (select *, case when many then list_position(list_transform(range(0, mpos), lambda j: {there('j')[0]} or {there('j')[1]}), true) - 1 end as j from named)",
        f"q as (select seq_id, start::bigint as start, size::int as size, (case when many then coalesce(j, mpos) else {mpos} end)::int as mpos, case when many then coalesce({rev} and (not {fwd} or {_reverse('text')} < text), false) else {flip} end as mint_is_rc, text from first)",
    ))


def _multi_sql(n: int, source: str = READS) -> str:
    parts = [source, _lmers_sql(LH), _seen(LH, "0"), f"scrambled as materialized (select lmer, dims.canon, {', '.join(f's{j}' for j in range(n))} from dims join {hash_sql.schemes('(select distinct canon from dims)', n)} x on x.canon = dims.canon)"]
    for j in range(n):
        key = f"s{j} * 2147483648 + pos"
        parts.append(f"m{j} as (select seq_id, n, pos, p, max(pos) over (partition by seq_id, p) as e from ({_best(key, _LEFT_BACK, 'lmers join scrambled using (lmer)')}))")
    every = " union all ".join(f"select *, e * 16 - {j} as rank from m{j}" for j in range(n))
    parts.append(f"picks as materialized (select seq_id, pos, arg_max(p, rank) as p, max(e) as e from ({every}) group by seq_id, pos)")
    parts.append("walked(seq_id, i, p, e) as (select seq_id, pos, p, e from picks where pos = 0 union all select s.seq_id, s.pos, s.p, s.e from walked w join picks s on s.seq_id = w.seq_id and s.pos = w.e + 1)")
    return f"with recursive {', '.join(parts)}, runs as (select seq_id, i as start, p, e - i + {K} as size from walked) {_OF_RUNS}"


_SK = READS + ", " + _superkmers_sql("mspxor")
_COUNTS = _SK + f", counts as (select mint, sum(size - {K - 1})::bigint as kmers, count(*) as superkmers from sk group by mint)"
_KMERS = _SK + f", kmers as (select seq_id, pos, substr(seq, pos + 1, {K}) as kmer, mint from (select seq_id, mint, unnest(range(start, start + size - {K - 1})) as pos from sk) join reads using (seq_id))"
_SYNC = "select seq_id, pos::int as pos, kmer from (select seq_id, pos, substr(seq, pos + 1, 15) as kmer from (select seq_id, seq, unnest(range(0, length(seq) - 14)) as pos from reads)) where list_position({p}, list_min({p})) in ({t})"
_PARTS = "[" + ", ".join(f"substr(kmer, {i + 1}, 5)" for i in range(11)) + "]"


def _words(text: str) -> str:
    v = " + ".join(f"instr('CGT', substr(t, 32 * i + {j + 1}, 1))::hugeint * {4 ** (31 - j)}" for j in range(32))
    return f"select seq_id, i::int as i, cast(case when w >= 9223372036854775808 then w - 18446744073709551616 else w end as bigint) as word from (select seq_id, i, {v} as w from (select seq_id, {text} as t, unnest(range(0, (length(seq) + 31) // 32)) as i from reads))"


_DOCS_N = "docs as (select doc_id as seq_id, regexp_replace(replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'), chr(10), 'N'), '[^acgtN]', '', 'g') as seq from documents)"
_PARTS_N = "parts as (select seq_id, list_extract(p, i) as part, length(list_extract(p, i)) as len, sum(length(list_extract(p, i)) + 1) over (partition by seq_id order by i) - length(list_extract(p, i)) - 1 as o from (select seq_id, p, unnest(range(1, length(p) + 1)) as i from (select seq_id, string_split_regex(seq, '[Nn]') as p from docs)))"
_DOCS = "reads as (select doc_id as seq_id, upper(regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'), '[^acgt]', '', 'g')) as seq from documents)"
_BOTH = READS.replace("reads as", "one as", 1) + f", reads as (select seq_id * 2 as seq_id, seq from one union all select seq_id * 2 + 1, {_reverse('seq')} from one)"


def _crossbucket_sql(sk: str) -> str:
    return sk + f", kmers as (select substr(seq, pos + 1, {K}) as kmer, mint from (select seq_id, mint, unnest(range(start, start + size - {K - 1})) as pos from sk) join reads using (seq_id)) select least(kmer, {_reverse('kmer')}) as kmer, count(distinct mint) as mints from kmers group by 1 having count(distinct mint) > 1"


def _context_sql() -> str:
    """Conflicts of minimizers among overlapping tiles of reads and texts on both strands: 500 bases from every 400th, which hold each k-mer."""
    whole = READS.replace("reads as", "one as", 1) + ", docs as (select regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'), '[^acgt]', '', 'g') as seq from documents), both_kinds as (select seq from one union all select upper(seq) from docs), "
    strands = f"cut as (select substr(seq, p + 1, 500) as seq from (select seq, unnest(range(0, length(seq), 400)) as p from both_kinds)), tiles as (select unnest([seq, {_reverse('seq')}]) as seq from cut), reads as (select row_number() over () as seq_id, seq from tiles)"
    found = f"kmers as (select substr(seq, pos + 1, {K}) as kmer, mint from (select seq_id, mint, unnest(range(start, start + size - {K - 1})) as pos from sk) join reads using (seq_id))"
    return "with " + whole + strands + ", " + _superkmers_sql("mspxor") + ", " + found + f" select least(kmer, {_reverse('kmer')}) as kmer, min(mint) as least, max(mint) as most from kmers group by 1 having min(mint) <> max(mint)"


def _forms_sql(name: str) -> str:
    """CTEs up to sk, from windows over all l-mers, and other: the same superkmers from each k-mer's own l-mers, listed."""
    l, score = SCORES[name]
    listed = "[" + ", ".join(f"(score_{i})::hugeint * 64 + {i}" for i in range(K - l + 1)) + "]"
    ahead = ", ".join(f"lead(score, {i}) over o as score_{i}" for i in range(K - l + 1))
    return (
        f"{READS}, {_superkmers_sql(name)}, scored as (select seq_id, n, pos, score, {ahead} from lmers join dims using (lmer) window o as (partition by seq_id order by pos)), "
        f"found as (select seq_id, n, pos, pos + cast(list_min({listed}) % 64 as bigint) as p from scored where pos <= n - {K}), "
        "grouped as (select seq_id, n, p, min(pos) as start, max(pos) as stop from found group by all), "
        f"other as (select g.seq_id, start::bigint as start, canon::int as mint, (stop - start + {K})::int as size, (p - start)::int as mpos, is_rc as mint_is_rc from grouped g join lmers m on m.seq_id = g.seq_id and m.pos = g.p join dims d on d.lmer = m.lmer) "
    )


_R = _with(READS)

def _everywhere_sql(length: int, values: str) -> str:
    return _R + f"select seq_id, pos::int as pos, {values} from (select seq_id, seq, pos, substr(seq, pos + 1, {length}) as part from (select seq_id, seq, unnest(range(0, length(seq) - {length - 1})) as pos from reads))"


ORACLES = {
    "revcomp": _R + f"select seq_id, {_reverse('seq')} as rc from reads",
    "revcomp_min": _R + f"select seq_id, seq < {_reverse('seq')} as smaller from reads",
    "valid_texts": "select doc_id, regexp_full_match(translate(lower(text), 'abcdefghij', 'acgtacgtac'), '[ACGTacgt]*') as valid from documents",
    "valid_words": "select doc_id, (i - 1)::int as i, regexp_full_match(list_extract(w, i), '[ACGTacgt]*') as valid from (select doc_id, w, unnest(range(1, length(w) + 1)) as i from (select doc_id, string_split(translate(lower(text), 'abcdefghij', 'acgtacgtac'), ' ') as w from documents))",
    "canonical_kmers_all": _everywhere_sql(K, f"least(part, {_reverse('part')}) as kmer"),
    "encode_bases_all": _everywhere_sql(1, "instr('CGT', part)::bigint as code, instr('CGT', part)::bigint as bits"),
    "ry_patterns_all": _everywhere_sql(L, " + ".join(f"(substr(part, {i + 1}, 1) in ('C', 'T'))::bigint * {2 ** (7 - i)}" for i in range(8)) + " as ry, " + " + ".join(f"(substr(part, {i + 1}, 1) in ('A', 'G'))::bigint * {2**i}" for i in range(8)) + " as ry_rc"),
    "packed_kmers_all": _everywhere_sql(K, f"{_value('part', K)} as value"),
    "encode_lmers": _with(READS, _lmers_sql(L)) + "select seq_id, pos::int as pos, lmer from lmers",
    "canonical_lmers": _with(READS, _lmers_sql(L)) + f"select seq_id, pos::int as pos, least(lmer, {_rc('lmer', L)}) as canon from lmers",
    "pack_words": _R + _words("seq"),
    "pack_words_rc": _R + _words(_reverse("seq")),
    "complements": _with(_DOCS_N) + "select seq_id, translate(seq, 'ACGTacgt', 'TGCAtgca') as complement from docs",
    "pack_words_rc_with_n": _R + _words("reverse(translate(replace(seq, 'ACG', 'NCG'), 'ACGTN', 'TGCAT'))"),
    "pack_bytes": _R + "select seq_id, i::int as i, (" + " + ".join(f"instr('CGT', substr(seq, 4 * i + {j + 1}, 1)) * {4**j}" for j in range(4)) + ")::int as byte from (select seq_id, seq, unnest(range(0, (length(seq) + 3) // 4)) as i from reads)",
    "split_n": _with(_DOCS_N, _PARTS_N) + f'select seq_id, o::bigint as "offset", len::bigint as length from parts where len >= {K}',
    "syncmers_open": _R + _SYNC.format(p=_PARTS, t="4"),
    "syncmers_closed": _R + _SYNC.format(p=_PARTS, t="1, 11"),
    **{f"scores_{n}": _with(READS, _lmers_sql(SCORES[n][0]), _dims(*SCORES[n])) + "select lmer, count(*) as n, any_value(score) as score, any_value(canon) as canon, any_value(is_rc) as is_rc from lmers join dims using (lmer) group by lmer" for n in SCORES if n != "mspxor_l9"},
    **{n: _with(READS, _superkmers_sql(*a)) + "select * from sk" for n, a in {
        "superkmers_classical": ("syncmer", True), "superkmers_msp": ("msp",), "superkmers_mspxor": ("mspxor",), "superkmers_windowed": ("mspxor",), "superkmers_l9": ("mspxor_l9",),
        "superkmers_classical_forward": ("syncmer", True, False), "superkmers_msp_forward": ("msp", False, False), "superkmers_mspxor_forward": ("mspxor", False, False),
        "uhs_classical": ("uhs8", True), "uhs_msp": ("uhs8",), "uhs_mspxor": ("uhs_mspxor",),
    }.items()},
    "bucket_counts": _with(_COUNTS) + "select * from counts",
    "bucket_stats": _with(_COUNTS) + "select count(*) as minimizers, sum(kmers)::bigint as kmers, sum(superkmers)::bigint as superkmers, avg(kmers) as mean, min(kmers) as least, max(kmers) as most, max(kmers) / avg(kmers) as most_by_mean, max(median) as median, max(kmers) / max(median) as most_by_median from counts, (select kmers as median from (select kmers, row_number() over (order by kmers) - 1 as i, count(*) over () as n from counts) where i = n // 2)",
    "bucket_percentiles": _with(_COUNTS) + "select p::int as p, kmers from (select kmers, row_number() over (order by kmers) - 1 as i, count(*) over () as n from counts) join (select unnest([1, 5, 25, 50, 75, 90, 95, 99]) as p) on i = n * p // 100",
    "bucket_histogram": _with(_COUNTS) + "select bin::int as bin, (1::bigint << (bin - 1)::int) as low, (1::bigint << bin::int) - 1 as high, count(*) as minimizers, sum(kmers)::bigint as kmers, sum(kmers) * 100.0::double / sum(sum(kmers)) over () as percent from (select *, length(format('{:b}', kmers)) as bin from counts) group by bin",
    "bucket_top20": _with(_COUNTS) + "select * from counts order by kmers desc, mint limit 20",
    "bucket_report": _with(_COUNTS + ", placed as (select kmers, row_number() over (order by kmers) - 1 as i, count(*) over () as n from counts)") + """
        select 1 as section, n::int as n, line from (select unnest(range(6)) as n, unnest(['minimizers ' || count(*), 'kmers ' || sum(kmers), 'superkmers ' || sum(superkmers), 'least ' || min(kmers),
            'median ' || (select kmers from placed where i = n // 2), 'most ' || max(kmers)]) as line from counts)
        union all select 2, p::int, 'P' || p || ' ' || kmers from placed join (select unnest([1, 5, 25, 50, 75, 90, 95, 99]) as p) on i = n * p // 100
        union all select 3, bin::int, (1::bigint << (bin - 1)::int) || '-' || ((1::bigint << bin::int) - 1) || ' ' || count(*) || ' ' || sum(kmers) from (select *, length(format('{:b}', kmers)) as bin from counts) group by bin
        union all select 4, n::int, """ + " || ".join(f"substr('ACGT', ((mint >> {2 * (L - 1 - i)}) & 3) + 1, 1)" for i in range(L)) + """ || ' ' || kmers from (select *, row_number() over (order by kmers desc, mint) as n from counts) where n <= 20""",
    "kmers_of_superkmers": _with(_KMERS) + "select * from kmers",
    "tiling_check": _sticky_sql(SCORES["syncmer"][1], 8, source=_DOCS) + f", placed as (select seq_id, unnest(range(start, start + size - {K - 1})) as pos from sk), times as (select seq_id, pos, count(*) as c from placed group by all), "
        f"covers as (select seq_id, sum(c)::bigint as covered, max(c) as most, count(*) as places from times where pos >= 0 group by seq_id) "
        f"select seq_id, (length(seq) - {K - 1})::bigint as kmers, coalesce(covered, 0)::bigint as covered, coalesce(most = 1 and places = length(seq) - {K - 1}, false) as tiles from reads left join covers using (seq_id) where length(seq) >= {K}",
    "crossbucket_mspxor": _crossbucket_sql(_with(_BOTH, _superkmers_sql("mspxor"))),
    "crossbucket_sticky": _crossbucket_sql(_sticky_sql(SCORES["syncmer"][1], 8, source=_BOTH)),
    "superkmers_sticky": _sticky_sql(SCORES["syncmer"][1], 8) + "select * from sk",
    "superkmers_sticky_forward": _sticky_sql(SCORES["syncmer"][1], 8, "m.lmer", "false") + "select * from sk",
    "uhs_sticky": _sticky_sql(SCORES["uhs8"][1], 8) + "select * from sk",
    "kmc2": _sticky_sql(SCORES["kmc2"][1], 8, rc="false") + "select * from sk",
    **{f"lexicographic_l{l}": _sticky_sql(SCORES["lexicographic"][1], l, "m.lmer", "false") + "select * from sk" for l in (8, 10, 12)},
    **{f"syncmer_sticky_l{l}": _sticky_sql(_good("v", l, 2), l) + "select * from sk" for l in (10, 12)},
    "superkmers_with_n": _with(_DOCS_N, _PARTS_N, f"reads as (select seq_id * 1048576 + o::bigint as seq_id, upper(part) as seq from parts where len >= {K})", _superkmers_sql("mspxor")) + "select seq_id // 1048576 as seq_id, start + seq_id % 1048576 as start, mint, size, mpos, mint_is_rc from sk",
    "syncmers_sampled": _R + ", closed as (" + _SYNC.format(p=_PARTS, t="1, 11") + "), " + hash_sql.xxh64("closed", 15) + f" select seq_id, pos, kmer from hashed where h < {int((2**64 - 1) * 0.25)}::uhugeint",
    "hash_minimizers": _with(READS, _kept(LH), _seen(LH, hash_sql.nthash("v", LH), "ubigint"), _islands(_best(_LEFT, _LEFT_BACK))) + _OF_RUNS,
    "nthash_quarantine": _with(_quarantine_sql()) + "select seq_id, start, 0::int as mint, size, mpos, mint_is_rc from q",
    "nthash_verbose": _with(_quarantine_sql()) + f"select *, substr(sequence, mpos + 1, {LH}) as minimizer from (select seq_id, start, case when mint_is_rc then {_reverse('text')} else text end as sequence, mpos from q)",
    **{f"candidates_{m}": _candidates_sql(m) for m in ("sticky", "classical", "msp", "mspxor")},
    "naive_syncmers_right": _naive_sql(True),
    "naive_syncmers_left": _naive_sql(False),
    **{f"multi_minimizers_{n}": _multi_sql(n) for n in (2, 4, 8)},
    "context_independence": _context_sql(),
    "superkmers_forms_differ": "with recursive " + _forms_sql("mspxor") + "select *, 'left' as side from (select * from sk except all select * from other) union all select *, 'right' as side from (select * from other except all select * from sk)",
    "joined_mspxor": _with(JOINED, _superkmers_sql("mspxor")) + "select * from sk",
    "joined_sticky": _sticky_sql(SCORES["syncmer"][1], 8, source=JOINED) + "select * from sk",
    "joined_kmc2": _sticky_sql(SCORES["kmc2"][1], 8, rc="false", source=JOINED) + "select * from sk",
    "joined_quarantine_l14": _with(_quarantine_sql(JOINED, 14)) + "select seq_id, start, 0::int as mint, size, mpos, mint_is_rc from q",
    "joined_candidates_sticky": _candidates_sql("sticky", JOINED),
    "joined_multi_minimizers_2": _multi_sql(2, JOINED),
    "fasta_sticky": _sticky_sql(SCORES["syncmer"][1], 8) + "select * from sk",
    "line_reads": _R + "select seq from reads",
    "read_tiles": _R + f"""
        , spans as (select seq_id, seq, len, unnest(list_distinct(list_append(range(0, length(seq) - len + 1, len // 3), length(seq) - len))) as start from (select *, unnest([100, 150, 200, 500]) as len from reads) where length(seq) >= len)
        select seq_id, len::int as length, start::int as start, strand, case when strand = '+' then t else {_reverse('t')} end as seq
        from (select seq_id, len, start, substr(seq, start + 1, len) as t, unnest(['+', '-']) as strand from spans)""",
    "kmer_counts_both_strands": _R + f"select least(kmer, {_reverse('kmer')}) as kmer, 2 * count(*) as count from (select substr(seq, pos + 1, {K}) as kmer from (select seq, unnest(range(0, length(seq) - {K - 1})) as pos from reads)) group by 1",
    "score_sum": _with(READS, _lmers_sql(L), _dims(*SCORES["mspxor"])) + "select sum(score)::varchar as total from lmers join dims using (lmer)",
    **dict.fromkeys(("kmer_counts", "kmer_counts_bucketed"), _R + f"select least(kmer, {_reverse('kmer')}) as kmer, count(*) as count from (select substr(seq, pos + 1, {K}) as kmer from (select seq, unnest(range(0, length(seq) - {K - 1})) as pos from reads)) group by 1"),
}

#: Names under which the whole job of an operator was first registered for one place of a text.
ORACLES |= {one: ORACLES[every] for one, every in (("valid_bases", "valid_texts"), ("encode_bases", "encode_bases_all"), ("ry_patterns", "ry_patterns_all"), ("canonical_kmers", "canonical_kmers_all"), ("packed_kmers", "packed_kmers_all"))}
