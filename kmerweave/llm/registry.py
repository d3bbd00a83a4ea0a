"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from kmerweave.llm.conversations import op13_conversation_repair
from kmerweave.llm.decontaminate import op3_decontamination
from kmerweave.llm.divergence import op11_source_divergence
from kmerweave.llm.language import op5_language
from kmerweave.llm.licenses import PHRASES, TEMPLATES, op2_licenses
from kmerweave.llm.near_dedup import op6_near_dedup
from kmerweave.llm.neighbors import op7_neighbors
from kmerweave.llm.packing import op1_packing
from kmerweave.llm.quality import op9_quality
from kmerweave.llm.substrings import op10_substring_dedup
from kmerweave.llm.topk import op12_exact_topk
from kmerweave.llm.toxicity import op8_toxicity
from kmerweave.llm.urls import op4_url_filter

QUERIES = {q.__name__: q for q in (op1_packing, op2_licenses, op3_decontamination, op4_url_filter, op5_language, op6_near_dedup, op7_neighbors, op8_toxicity, op9_quality, op10_substring_dedup, op11_source_divergence, op12_exact_topk, op13_conversation_repair)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


#: Each template as a row: its words, those of its key phrase, the place of these in it from 0, label, whether it is a base phrase.
_NOTICES = ", ".join(
    f"({_list(text)}, {_list(key)}, {text.split().index(key.split()[0])}, '{label}', {exact})"
    for text, label, key, exact in [*((t, label, t, True) for t, label in PHRASES.items()), *((*t, False) for t in TEMPLATES)]
)

ORACLES: dict[str, str] = {
    "op2_licenses": f"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
        t(tw, kw, k, label, exact) as (values {_NOTICES}),
        keys as (select r, w, tw, k, label, exact, unnest(list_filter(range(1, len(w) + 1), lambda p: w[p] = kw[1] and w[p:p + len(kw) - 1] = kw)) - k as p
            from d, t where list_contains(w, kw[1])),
        met as (select r, p - 1 as start, label, exact,
            len(list_filter(range(0, len(tw)), lambda i: p + i >= 1 and w[p + i] = tw[i + 1])) / len(tw) as share from keys),
        found as (select r, count(*) filter (where exact) as n_base, min(start) filter (where exact) as first_word, max(start) filter (where exact) as last_word,
            string_agg(distinct label, ',' order by label) filter (where exact) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score
            from met where share >= 0.7 group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
            coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
        from d left join found using (r)""",
    "op3_decontamination": f"""
        with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
        i as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark where item_id is not null),
        iw as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p, w from i where len(w) > 0),
        windows as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as t from iw),
        dw as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as t from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from windows) where len(w) >= n)),
        hits as (select doc_id, p, n, item_id from dw join windows using (n, t)),
        words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
        items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
            sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (doc_id) left join items using (doc_id)""",
    "op6_near_dedup": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as g from d),
        n as (select doc_id, count(*) as c from s group by doc_id),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as same from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 80 * (x.c + y.c - same)),
        ends as (select a, b from links union select b, a from links),
        reach(id, root) as (select doc_id, doc_id from d union select e.b, r.root from reach r join ends e on e.a = r.id where r.root < e.b),
        parts as (select id as doc_id, min(root) as component_id from reach group by id)
        select doc_id, coalesce(c, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d join parts using (doc_id) left join n using (doc_id)""",
    "op10_substring_dedup": f"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
        wins as (select doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d where len(w) >= 20)),
        ranked as (select doc_id, p, row_number() over (partition by h order by doc_id, p) as r from wins),
        gone as (select distinct doc_id, unnest(range(p, p + 20)) as q from ranked where r > 1),
        lists as (select doc_id, list(q) as qs, count(*) as c from gone group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(c, 0)::bigint as n_removed,
            sha256(array_to_string(case when c is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(qs, i)), lambda i: w[i]) end, ' ')) as kept_sha256
        from d left join lists using (doc_id)""",
}


def _repair_sql() -> str:
    """SQL of the cheapest edits: the best (cost, edits, lines) for each place in a conversation's order, row by row."""
    add = lambda s, cost, edit, line: f"case when {s} is not null then {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t{line}}} end"
    least = lambda *x: "list_min(list_filter([" + ", ".join(x) + "], lambda z: z is not null))"
    said = lambda role, text: f" || chr(10) || {role} || ':'{text}"
    user, assistant = said("'user'", ""), said("'assistant'", "")
    inserted = lambda rows: (
        f"select *, {least('x3', add('x2', 3, 'I', assistant))} as y3 from (select * exclude (s0, s1, s2, s3), s0 as x0, s1 as x1, s3 as x3, "
        f"{least('s2', *(add(s, 3, 'I', user) for s in ('s0', 's1', 's3')))} as x2 from ({rows}))"
    )
    own, more = said("role", " || text"), "(case when cut then 3 else 0 end)"
    keep = lambda s, to: f"case when initial = '{to}' and not gone then {add(s, more, 'K', own)} end"
    rerole = lambda s, role: f"case when not gone then {add(s, f'(3 + {more})', 'R', said(chr(39) + role + chr(39), ' || text'))} end"
    drop = lambda s: add(s, 4, "D", "")
    step = (
        f"{drop('x0')} as s0, {least(drop('x1'), keep('x0', 's'))} as s1, "
        f"{least(drop('x2'), *(keep(s, 'u') for s in ('x0', 'x1', 'y3')), *(rerole(s, 'user') for s in ('x0', 'x1', 'y3')))} as s2, "
        f"{least(drop('y3'), keep('x2', 'a'), rerole('x2', 'assistant'))} as s3"
    )
    kind = "struct(c bigint, a varchar, t varchar)"
    crc = "list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"
    return f"""
        with recursive given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
        crcs as (select k, xor({crc}, 4294967295) % 20 as h from (select distinct k from given)),
        hurt as (select conv_id, turn, sha256(role || ':' || text) as tie, case when h = 4 then 'user' else role end as role,
            case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 0 then 0 when h = 3 then 2 else 1 end)) as copy
            from given join crcs using (k)),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, tie, copy) as i, substr(role, 1, 1) as initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from hurt),
        told as (select *, bare = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, right(bare, 1) not in ('.', '!', '?') as open, lag(initial) over (partition by conv_id order by i) as before from placed),
        faulty as materialized (select *, blank or again as gone, not (blank or again) and open as cut from told),
        counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
            count(*) filter (where cut) as truncated, count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from faulty group by conv_id),
        walked(conv_id, i, s0, s1, s2, s3) as (
            select distinct conv_id, 0::bigint, {{'c': 0, 'a': '', 't': ''}}::{kind}, null::{kind}, null::{kind}, null::{kind} from counts
            union all select conv_id, i, {step} from ({inserted("select f.conv_id, f.i, f.role, f.text, f.initial, f.gone, f.cut, w.s0, w.s1, w.s2, w.s3 from walked w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1")})),
        ended as (select conv_id, {least('x0', 'y3')} as best from ({inserted("select w.* from walked w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i")}))
        select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
            coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 2), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id"""


_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::double))"
ORACLES |= {
    "op11_source_divergence": f"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        t as (select r, lang, source, unnest(w) as term from d),
        kept as materialized (select lang, term, count(*) as c from t group by lang, term having count(distinct r) >= 3),
        own as (select lang, source, term, count(*) as c from t group by all),
        groups as (select distinct lang, source from d),
        langs as (select lang, count(*) as v, sum(c) as n from kept group by lang),
        cells as (select g.lang, g.source, k.term, coalesce(o.c, 0) as c, k.c as lc from groups g join kept k using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
        totals as (select lang, source, sum(c) as n from cells group by all),
        p as materialized (select lang, source, term, cells.c, (1 + 1000000000::hugeint * (cells.c + 1) // (totals.n + langs.v))::hugeint as p, (1 + 1000000000::hugeint * (lc + 1) // (langs.n + langs.v))::hugeint as q
            from cells join totals using (lang, source) join langs using (lang)),
        sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        rows as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where c > 0 and p > q)
        select lang, source, part, item, value::bigint as value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows) where part = 'pair' or rank <= 200""",
    "op12_exact_topk": f"""
        with v as (select vec_id, {_WHOLE} as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.v, v.v)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
        select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5""",
    "op13_conversation_repair": _repair_sql(),
}
