"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, secrets

#: the contract's patterns, with the test that a match must pass (fixed values)
_BASE = (
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    (r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    (r"[0-9a-f]+", r"^.{24,}$"),
)
_ENTROPY_CASES = " ".join(f"when regexp_matches(hit, '{p}') then {secrets.least_sum(bits)}" for _, p, bits in secrets.CLASSES)
_ALLOWED = " or ".join(f"regexp_matches(hit, '{p}')" for p in secrets.ALLOW if "\\1" not in p)
_XLOGX = "[" + ", ".join(f"{x}::bigint" for x in secrets.XLOGX) + "]"


def _hits(kind: str, pattern: str, test: str) -> str:
    pattern, test = pattern.replace("'", "''"), test.replace("'", "''")
    return f"""
  select doc_id, {kind} as kind, i, hits[i] as hit,
         list_sum([length(x) for x in gaps[1:i]])::bigint + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0)::bigint as s
  from (select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as i
        from (select doc_id, regexp_extract_all(t, '{pattern}') as hits, regexp_split_to_array(t, '{pattern}') as gaps from d) where len(hits) > 0)
  where regexp_matches(hits[i], '{test}')"""


OP9 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
base as ({' union all '.join(_hits(str(r), p, t) for r, (p, t) in enumerate(_BASE))}),
cand as (select * from ({_hits('3', secrets.CANDIDATE, '.')}) where not ({_ALLOWED}) and len(list_distinct(string_split(hit, ''))) > 1),
win as (select doc_id, i, s, hit, w, substr(hit, w, {secrets.WINDOW}) as x, case {_ENTROPY_CASES} end as most
        from (select *, unnest(range(1, length(hit) - {secrets.WINDOW} + 2)) as w from cand)),
good as (select doc_id, i, s, w from win
         where list_sum([{_XLOGX}[1 + length(x) - length(replace(x, c, ''))] for c in list_distinct(string_split(x, ''))]) <= most),
ent as (select doc_id, 3 as kind, s + min(w) - 1 as s, s + max(w) - 1 + {secrets.WINDOW} as e from good group by doc_id, i, s),
spans as (select doc_id, kind, s, s + length(hit) as e from base union all select * from ent),
named as (select *, case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'entropy' end || ':' || s || ':' || e as word from spans),
agg as (select doc_id, count(*) filter (kind = 0) as na, count(*) filter (kind = 1) as nc, count(*) filter (kind = 2) as nh,
               string_agg(word, ',' order by s, kind) filter (kind < 3) as b, string_agg(word, ',' order by s, kind) as a from named group by doc_id)
select d.doc_id, coalesce(na, 0)::bigint as n_assign, coalesce(nc, 0)::bigint as n_access, coalesce(nh, 0)::bigint as n_hex,
       sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from d left join agg on d.doc_id = agg.doc_id
"""

_U = "(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::bigint::double / 4503599627370496.0)"
OP5 = f"""
with recursive s as (select coalesce(source, chr(0) || 'null') as src, count(*) as n from documents group by 1),
r as (select src, 1.0::double * (select sum(n) from s)::double / (select count(*) from s)::double / n as rate from s),
q(src, rate, k, p, cdf) as (
  select src, rate, 0, exp(-rate), exp(-rate) from r
  union all select src, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from q where k + 1 < {mixing.last_term(mixing.MAX_RATE)}),
d as (select *, coalesce(source, chr(0) || 'null') as src, {_U.format(seed=42, key="coalesce(doc_id::varchar, 'null')")} as u from documents),
c as (select d.*, unnest(range(0, (select count(*) from q where q.src = d.src and d.u >= q.cdf))) as copy from d)
select doc_id, text, lang, source, n_chars, copy::int as copy,
       {_U.format(seed=43, key="coalesce(doc_id::varchar, 'null') || '|' || copy")} as shuffle_key
from c
"""

OP8 = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i+12], ' ') as x from (select *, unnest(range(1, len(w) - 11)) as i from d)),
f as (select x, min(doc_id) as lo from win group by x),
hit as (select win.doc_id, i from win join f on win.x = f.x where f.lo < win.doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from hit),
g as (select doc_id, list(p) as ps from gone group by doc_id),
k as (select d.doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed,
             array_to_string([w[p] for p in range(1, len(w) + 1) if not list_contains(coalesce(ps, []), p)], ' ') as kept
      from d left join g on d.doc_id = g.doc_id)
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from k
"""

OP4 = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) as (select vec_id, vec_id from e union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as m from r group by a), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(m, vec_id)::bigint as component_id, vec_id = coalesce(m, vec_id) as kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""

#: windows of 400 bytes as 800 hexadecimal digits
OP3 = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, i, md5(substr(x, 2 * i + 1, 800)) as m from (select r, x, unnest(range(0, length(x) // 2 - 399)) as i from d where length(x) >= 800)),
hit as (select r, i from w where m in (select m from w group by m having count(*) > 1)),
turn as (select r, i, case when lag(i) over (partition by r order by i) + 400 >= i then 0 else 1 end as new from hit),
runs as (select r, min(i) as a, max(i) + 400 as z from (select r, i, sum(new) over (partition by r order by i) as g from turn) group by r, g),
gaps as (select runs.r, a, z, substr(x, 2 * coalesce(lag(z) over (partition by runs.r order by a), 0) + 1, 2 * (a - coalesce(lag(z) over (partition by runs.r order by a), 0))) as piece from runs join d on runs.r = d.r),
k as (select r, count(*) as n_spans, sum(z - a) as n_removed, max(z) as z, string_agg(piece, '' order by a) as kept from gaps group by r)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(k.z, 0) + 1))) as kept_sha256
from d left join k on d.r = k.r
"""

ORACLES = {"op3_suffix_dedup": OP3, "op4_embedding_dedup": OP4, "op5_mixing": OP5, "op8_phrase_dedup": OP8, "op9_secrets": OP9}
