"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

#: A-Z lower-cased, words of a text and its 5-word shingles.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, WHITE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

OP1 = f"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
  grams as (select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [concat(len(w), ' ', array_to_string(w, ' '))] else [] end) as g from words),
  sizes as (select doc_id, count(*) as n from grams group by 1),
  shared as (select x.doc_id as a, y.doc_id as b, count(*) as i from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
  links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * i >= 75 * (p.n + q.n - i)),
  both_ways as (select a, b from links union select b, a from links),
  reach as (select doc_id as node, doc_id as other from documents union select r.node, e.b from reach r join both_ways e on e.a = r.other)
select r.node as doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.other) as component_id from reach r left join sizes s on s.doc_id = r.node group by 1"""

#: formatted_chars: every example up to and with each assistant turn, and the whole conversation if it ends otherwise.
OP3 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  marks as (select *, len(regexp_extract_all(text, '\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|</?SYS|<\|')) + len(regexp_extract_all(text, '\|>')) + len(regexp_extract_all(text, '\\')) as more from t),
  sized as (select *, row_number() over w as k, count(*) over (partition by conv_id) as n, sum(length(role) + length(text) + more + 5 + 5) over w as upto from marks window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or k = n) as bigint) as formatted_chars from sized group by 1"""

OP5 = f"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size, doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256 from d"""


OP11 = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
  words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
  lengths as (select unnest([1, 2, 3, 4, 5]) as k),
  grams as (select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase from words, lengths where len(w) >= k),
  counts as (select lang, k, phrase, count(*) as f from grams group by 1, 2, 3),
  totals as (select lang, sum(f)::bigint as n from counts where k = 1 group by 1),
  found as (select lang, phrase, k, f, string_split(phrase, ' ') as w from counts where k > 1 and f >= 100),
  cuts as (select lang, phrase, k, f, w, unnest(range(1, k)) as c from found),
  scored as (select x.lang, x.phrase, x.f as a, p.f as l, q.f as r, n, c, (1000::hugeint * x.f * n) // (p.f::hugeint * q.f) as score
    from cuts x join totals using (lang) join counts p on p.lang = x.lang and p.k = c and p.phrase = array_to_string(w[1:c], ' ')
    join counts q on q.lang = x.lang and q.k = x.k - c and q.phrase = array_to_string(w[c + 1:], ' ')),
  least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
  spans as (select lang, f, k, w, unnest(range(2, k)) as m from found),
  inside as (select lang, array_to_string(w[s:s + m - 1], ' ') as phrase, max(f) as within from (select lang, f, w, m, unnest(range(1, k - m + 2)) as s from spans) group by 1, 2),
  kept as (select least.* from least left join inside using (lang, phrase) where within is null or 100 * within < 100 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as t from documents),
  stats as (select count(*) filter (len(t) > 0) as n_docs, sum(len(t))::bigint as n_terms from d),
  q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark) group by 1, 2),
  tfs as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) where term in (select term from q) group by 1, 2),
  weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tfs, stats group by term, n_docs),
  scores as (select item_id, d.r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * n_docs) // n_terms))))::bigint as score
    from q join tfs using (term) join weights using (term) join d using (r), stats group by 1, 2, 3)
select item_id, rank::integer as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op3_chat_format": OP3, "op5_exact_dedup": OP5, "op11_collocations": OP11, "op13_lexical_search": OP13}
