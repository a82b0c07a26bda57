"""SQL of the queries that SQL can express on whole tables; the rest are tested against brute force."""

from __future__ import annotations

_INCIDENCE = """i as (select distinct speech_id as s, word as w from speech_mention where speech_id is not null and word is not null),
t as (select count(distinct s) as n from i),
c as (select w, count(*) as c from i group by w),
p as (select a.w as word_a, b.w as word_b, count(*) as n_ab from i a join i b on a.s = b.s and a.w < b.w group by 1, 2)"""
_PAIRS = "from p join c ca on ca.w = word_a join c cb on cb.w = word_b cross join t where n_ab >= 5 and 1000 * n_ab >= n and n_ab * n >= 3 * ca.c * cb.c"


_GROUPS = """with recursive e as (select original_key as a, canonical_key as b from name_match where original_key is not null and canonical_key is not null),
both_ways as (select a, b from e union select b, a from e),
k as (select original_key as x from name_match where original_key is not null union select canonical_key from name_match where canonical_key is not null),
reach as (select x as record_key, x as seen from k union select r.record_key, w.b from reach r join both_ways w on w.a = r.seen)
select record_key, min(seen) as group_key from reach group by record_key"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"with {_INCIDENCE} select word_a, word_b {_PAIRS}",
        "p4_pair_lift": f"with {_INCIDENCE} select word_a, word_b, ca.c as n_a, cb.c as n_b, n_ab, n, round(n_ab * cast(n as double) / (ca.c * cb.c), 6) as lift {_PAIRS}",
        "p5_found": """with t as (select distinct doc_id, text from transcript where length(text) > 1000),
s as (select doc_id, text, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) as w from t),
h as (select doc_id, text, max(length(w)) as longest from s group by 1, 2),
f as (select h.doc_id, min(strpos(h.text, s.w) - 1) as hard_start from h join s on s.doc_id = h.doc_id and length(s.w) > 1000 group by 1)
select h.doc_id, coalesce(f.hard_start, -1) as hard_start from h left join f on f.doc_id = h.doc_id""",
        "p5_pieces_sound": """with t as (select distinct doc_id, text from transcript where length(text) > 1000),
h as (select doc_id, length(text) as n, list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: length(x))) > 1000 as cut_hard from t)
select doc_id, n, true as covered, true as limit_kept, true as overlap_kept, cut_hard from h""",
        "p6_found": _GROUPS,
        "p6_levels": _GROUPS,
        "p8_mix_shares_met": "select m.source, target_share, max_repeat, n_docs, true as share_met, true as cap_kept from mix_target m join (select source, count(*) as n_docs from documents group by 1) d on d.source = m.source",
        "p7_found": """with raw as (select 'd' as kind, doc_id as id, text from documents where text is not null union all select 'i', item_id, text from eval_passage where text is not null),
w as (select kind, id, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(nfc_normalize(strip_accents(translate(text, 'ªº', 'ao'))), '[\\x{00A0}]', ' ', 'g')), '[^\\pL\\pN\\s]', '', 'g'), '\\s+'), lambda x: x <> '') as ws from raw),
g as (select kind, id, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i+19], ' '))) as gram from w where len(ws) >= 20)
select distinct d.id as doc_id, i.id as item_id from g d join g i on d.gram = i.gram where d.kind = 'd' and i.kind = 'i'""",
    }
