"""The queries that SQL can express, for DuckDB."""

_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
grams as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as g from w, unnest(range(1, len(ws) - 33)) t(i)),
repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from grams) where c > 1),
covered as (select distinct doc_id, i + k as j from repeated, range(0, 35) r(k)),
words as (select doc_id, j, ws[j] as word from w, unnest(range(1, len(ws) + 1)) t(j)),
left_ as (select doc_id, string_agg(word, ' ' order by j) as kept, count(*) as n from words anti join covered using (doc_id, j) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join left_ using (doc_id)
"""

EMBEDDING_DEDUP = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
          where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as vec_id, min(b) as component_id from reach group by a),
degree as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from least left join degree using (vec_id)
"""

CHAT_FORMAT = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, regexp_replace(role, '([\\#<\[])', '\\\1', 'g') as r,
        case when contains(text, ' </turn>' || chr(10)) then regexp_replace(text, '([\\#<\[])', '\\\1', 'g') else text end as x from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### [0]:  </turn>' || chr(10)) + length(r) + length(x))::bigint as formatted_chars
from f group by conv_id
"""

JACCARD_JOIN = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
grams as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) where len(ws) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select a as doc_id, coalesce(max(n), 0)::bigint as n_shingles, min(b) as component_id from reach left join sizes on sizes.doc_id = a group by a
"""

RESAMPLING = r"""
with recursive step(v, k, c) as (
  select v, 0, v::bigint from range(256) t(v)
  union all select v, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
crc as (select list(c order by v) as tab from step where k = 8),
texts as (
  select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as (select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
grams as (
  select side, id, ws[i] as f from w, unnest(range(1, len(ws) + 1)) t(i)
  union all select side, id, ws[i] || ' ' || ws[i + 1] from w, unnest(range(1, len(ws))) t(i)),
hexed as (select f, hex(encode(f)) as x from (select distinct f from grams)),
hashed as (
  select f, (xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(0, length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000) as bucket from hexed, crc),
coded as (select side, id, bucket, count(*) as n from grams join hashed using (f) group by all),
sums as (select b as bucket, coalesce(sum(n) filter (side = 0), 0)::bigint as s, coalesce(sum(n) filter (side = 1), 0)::bigint as t
         from range(10000) r(b) left join coded on bucket = b group by b),
gain as (select bucket, floor(1000 * ln(((t + 1) * ((sum(s) over ())::bigint + 10000))::double
         / ((s + 1) * ((sum(t) over ())::bigint + 10000))::double))::bigint as g from sums),
weights as (select id, sum(n)::bigint as n, floor(sum(n * g)::double / sum(n)::double)::bigint as weight from coded join gain using (bucket) where side = 0 group by id),
hex8 as (select doc_id, len(ws) as n_words, sha256('7:' || doc_id)[1:8] as x from documents join w on side = 0 and id = doc_id),
noise as (select doc_id, n_words, list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', x[i]) - 1)),
          lambda a, d: a * 16 + d) as h from hex8),
scored as (select doc_id, n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
           coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score
           from noise left join weights on id = doc_id),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as size from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 25 * size // 100 then r end as rank from scored left join ranked using (doc_id)
"""

COLLOCATIONS = r"""
with recursive p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
sizes as (select lang, sum(len(ws))::bigint as n from w group by lang),
f as (select lang, ws[i:i + k - 1] as p, count(*) as f from w, unnest(range(1, 5)) a(k), unnest(range(1, len(ws) + 1)) t(i)
      where i + k - 1 <= len(ws) group by all having count(*) >= 30),
cand as (select lang, p, f as a, len(p) as m from f where len(p) > 1),
inside as (select distinct c.lang, c.p from cand c join cand x on x.lang = c.lang and x.m > c.m and 100 * x.a >= 80 * c.a
           and list_has_any([x.p[i:i + c.m - 1] for i in range(1, x.m - c.m + 2)], [c.p])),
cuts as (select c.lang, c.p, a, k, x.f as l, y.f as r, (2000000::hugeint * a // (x.f + y.f))::bigint as score
         from cand c, unnest(range(1, m)) t(k) join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:]),
best as (select lang, p, a, min({'score': score, 'k': k, 'l': l, 'r': r}) as s from cuts anti join inside using (lang, p) group by all),
ranked as (select lang, array_to_string(p, ' ') as phrase, a, s.l as l, s.r as r, s.score as score,
           row_number() over (partition by lang order by s.score desc, a desc, array_to_string(p, ' ')) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
"""
