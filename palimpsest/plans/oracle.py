"""The same results in plain SQL for an independent engine.

Written without any code of the operators: matches are found by the other
engine's regular expressions, MACs are nested digests, base62 is arithmetic,
greedy choices are recursive queries.
"""

from __future__ import annotations

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ASSIGNED = r"""(?i:token|secret|password|api_key)[ ]*[=:][ ]*["'']?[A-Za-z0-9\-_./+]{12,}"""
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
A, B, C = "chr(57344)", "chr(57345)", "chr(57346)"
SECRET = "0f" * 32
B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def pieces(source: str, keys: str) -> str:
    """CTEs ``flat``/``spans``: pieces of texts marked by one leftmost scan."""
    return f"""
marked as (select {keys}, regexp_replace(text, '({ASSIGNED})|({EMAIL})|({IPV4})',
    {A} || '\\1' || {B} || '\\2' || {B} || '\\3' || {C}, 'g') as m from ({source})),
cut as (select {keys}, string_split_regex(m, '[' || {A} || {C} || ']') as ps from marked),
listed as (select {keys}, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i from cut),
flat as (select {keys}, i, replace(p, {B}, '') as t, i % 2 = 0 as hit,
    case when i % 2 = 1 then null when starts_with(p, {B} || {B}) then 'IP'
         when starts_with(p, {B}) then 'EMAIL' else 'SECRET' end as ty from listed),
placed as (select *, coalesce(sum(length(t)) over w, 0)::bigint as start,
    coalesce(sum(strlen(t)) over w, 0)::bigint as byte_start from flat
    window w as (partition by {keys} order by i rows between unbounded preceding and 1 preceding)),
spans as (select * from placed where hit)"""


def words(source: str, keys: str) -> str:
    """CTEs ``flat``/``spans`` of the small glossary, longest term first."""
    return f"""
marked as (select {keys}, regexp_replace(text, '(queeau|schein|tion|que|sch|the)',
    {A} || '\\1' || {C}, 'g') as m from ({source})),
cut as (select {keys}, string_split_regex(m, '[' || {A} || {C} || ']') as ps from marked),
listed as (select {keys}, unnest(ps) as t, unnest(range(1, len(ps) + 1)) as i from cut),
flat as (select {keys}, i, t, i % 2 = 0 as hit,
    case when t in ('schein', 'tion') then 'NOUN' else 'WORD' end as ty from listed),
placed as (select *, coalesce(sum(length(t)) over w, 0)::bigint as start from flat
    window w as (partition by {keys} order by i rows between unbounded preceding and 1 preceding)),
spans as (select * from placed where hit)"""


def b62(n: str) -> str:
    digits = " || ".join(f"substr('{B62}', (({n}) // {62**k}) % 62 + 1, 1)" for k in range(5, -1, -1))
    return f"coalesce(nullif(ltrim({digits}, '0'), ''), '0')"


def _pad(key_hex: str, hi: str, lo: str, byte: str) -> str:
    return (
        f"unhex(array_to_string(list_transform(range(1, 65), lambda q: "
        f"substr(case when q % 2 = 1 then '{hi}' else '{lo}' end, "
        f"strpos('0123456789abcdef', substr({key_hex}, q, 1)), 1)), '') || repeat('{byte}', 32))"
    )


def _perm(x: int) -> str:
    return "".join(f"{i ^ x:x}" for i in range(16))


def hmac(key_hex: str, message: str) -> str:
    inner = f"unhex(sha256({_pad(key_hex, _perm(3), _perm(6), '36')} || {message}))"
    return f"sha256({_pad(key_hex, _perm(5), _perm(12), '5c')} || {inner})"


def scope_key(scope: str) -> str:
    return hmac(f"'{SECRET}'", f"encode(({scope})::varchar)")


def _le(h: str) -> str:
    return " || ".join(f"substr({h}, {p}, 2)" for p in (7, 5, 3, 1))


def tag(key_hex: str, n: str) -> str:
    h = f"printf('%08x', ({n})::bigint)"
    mac = hmac(key_hex, f"unhex({_le(h)})")
    return f"('0x' || list_transform([{mac}], lambda z: {_le('z')})[1])::bigint"


def masked(keys: str, scope: str, ids: str, typed: bool = True, extra: str = "") -> str:
    """CTE ``masked``; ``ids`` gives (scope, t, id) in a CTE named ``ids``."""
    ty = "':' || f.ty" if typed else "''"
    on = " and ".join(f"x.{c} = f.{c}" for c in scope.split(", ")) if scope else "true"
    scope_expr = scope if scope else "'corpus'"
    return f"""
ids as ({ids}),
scopes as (select distinct {scope_expr} as sk from spans),
keyed as (select sk, {scope_key('sk')} as k from scopes),
tags as (select x.*, {tag('kk.k', 'x.id')} as tg from ids x join keyed kk on kk.sk = {"x." + scope if scope else "'corpus'"}),
masked as (select {", ".join("f." + c.strip() for c in keys.split(","))},
    coalesce(string_agg(case when f.hit then '⟦S' || {ty} || '·' || {b62('x.id')} || '·' || {b62('x.tg')} || '⟧' else f.t end, '' order by f.i), '') as masked
    from flat f left join tags x on f.hit and {on} and x.t = f.t group by {", ".join("f." + c.strip() for c in keys.split(","))})"""


DOCS = "select doc_id, source, lang, text from documents"
REQUEST_IDS = (
    "select doc_id, t, row_number() over (partition by doc_id order by min(i)) - 1 as id "
    "from spans group by doc_id, t"
)
SUMMARY = """summaries as (select doc_id, string_agg(ty || '=' || n, ',' order by ty) as summary, sum(n)::bigint as total,
    from (select doc_id, ty, count(*) as n from spans group by all) group by doc_id)"""
CORPUS_IDS = "select t, row_number() over (order by min(doc_id * 1000000000 + i)) - 1 as id from spans group by t"
SHARD_IDS = """select t, sh * 1048576 + row_number() over (partition by sh order by t) - 1 as id
    from (select distinct t, ('0x' || substr(md5(t), 1, 8))::bigint % 4096 as sh from spans)"""

REQUEST = f"with {pieces(DOCS, 'doc_id')}, {masked('doc_id', 'doc_id', REQUEST_IDS)}, {SUMMARY}"
REQUEST_MASKED = f"{REQUEST} select doc_id, masked, coalesce(summary, '') as summary from masked left join summaries using (doc_id)"
SESSION_IDS = (
    "select conv_id, t, row_number() over (partition by conv_id order by min(turn * 1000000 + i)) - 1 as id "
    "from spans group by conv_id, t"
)
SESSION = f"with {words('select * from conversations', 'conv_id, turn')}, {masked('conv_id, turn', 'conv_id', SESSION_IDS)}"

# The event table as a request log.
REQS = """reqs as (select *, '/' || event_type || case when event_id % 3 = 0 then '/v1/' || user_id else '' end as path,
    'k' || (user_id % 6) as key, 'h' || (user_id % 3) || '.example.com' as host from events)"""
ROUTED = """routed as (select *, case when path = '/click' or starts_with(path, '/click/') then 0
    when path = '/view/v1' or starts_with(path, '/view/v1/') then 1
    when path = '/view' or starts_with(path, '/view/') then 2
    when path = '/purchase' or starts_with(path, '/purchase/') then 6 end as r from reqs)"""
TENANT = "case when key = 'k1' then 'acme' when key in ('k2', 'k3') then 'globex' end"

TYPES_JSON = "case when event_id % 5 > 0 then '{\"EMAIL\":' || (event_id % 5) || '}' else '{}' end"
CHAIN = f"""recs as (select event_type as chain, event_id, floor(epoch(ts))::bigint as s,
    row_number() over (partition by event_type order by floor(epoch(ts))::bigint, event_id) - 1 as pos,
    user_id, {TYPES_JSON} as types from events),
heads as (select *, pos // 500 as segment, pos % 500 as seq,
    '{{"seq":' || (pos % 500) || ',"ts":' || s || ',"route":"/' || chain || '","tenant":' ||
    case when user_id % 4 <> 0 then '"t' || (user_id % 4) || '"' else 'null' end ||
    ',"mode":"' || case when event_id % 2 = 0 then 'enforce' else 'dry-run' end || '","detected":' || (event_id % 5) ||
    ',"types":' || types || ',"prev":"' as head from recs),
links as (select chain, segment, seq, event_id, '' as prev, sha256(head || '","hash":""}}') as hash from heads where seq = 0
    union all select h.chain, h.segment, h.seq, h.event_id, l.hash, sha256(l.hash || h.head || l.hash || '","hash":""}}')
    from links l join heads h on h.chain = l.chain and h.segment = l.segment and h.seq = l.seq + 1)"""
# Positions per segment, for the tampering queries.
SEGMENTS = """recs as (select event_type as chain, row_number() over (partition by event_type order by floor(epoch(ts))::bigint, event_id) - 1 as pos from events),
segs as (select chain, pos // 500 as segment, count(*)::bigint as n from recs group by all)"""

# Candidates of the mixed rule set, one row each, in order of arrival.
MIXED = rf"""with {pieces(DOCS, 'doc_id')},
lit_marked as (select doc_id, regexp_replace(text, '(example\.com|token|mail)', {A} || '\1' || {C}, 'g') as m from documents),
lit_cut as (select doc_id, string_split_regex(m, '[' || {A} || {C} || ']') as ps from lit_marked),
lit_list as (select doc_id, unnest(ps) as t, unnest(range(1, len(ps) + 1)) as i from lit_cut),
lit as (select *, coalesce(sum(length(t)) over w, 0)::bigint as s, coalesce(sum(strlen(t)) over w, 0)::bigint as b from lit_list
    window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
tok_marked as (select doc_id, regexp_replace(text, '([A-Za-z0-9+/=_-]{{20,}})', {A} || '\1' || {C}, 'g') as m from documents),
tok_cut as (select doc_id, string_split_regex(m, '[' || {A} || {C} || ']') as ps from tok_marked),
tok_list as (select doc_id, unnest(ps) as t, unnest(range(1, len(ps) + 1)) as i from tok_cut),
tok as (select *, coalesce(sum(length(t)) over w, 0)::bigint as s, coalesce(sum(strlen(t)) over w, 0)::bigint as b from tok_list
    window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
bits as (select t, -sum((n / length(t)) * log2(n / length(t))) as h from
    (select t, c, count(*)::double as n from (select t, unnest(string_split(t, '')) as c from (select distinct t from tok where i % 2 = 0)) group by all) group by t),
cands as (
    select doc_id, s, b, length(t) as n, strlen(t) as bn, case t when 'token' then 'WORD' when 'mail' then 'WORD' else 'HOST' end as ty,
        case t when 'token' then 55 when 'mail' then 70 else 5 end as prio, 'literal' as det, 0 as src from lit where i % 2 = 0
    union all select doc_id, start, byte_start, length(t), strlen(t), ty, case ty when 'EMAIL' then 50 when 'SECRET' then 60 else 40 end,
        case ty when 'EMAIL' then 'email' when 'SECRET' then 'assigned' else 'ipv4' end, 1 from spans
    union all select doc_id, s, b, length(t), strlen(t), 'RANDOM', 58, 'entropy', 2 from tok join bits using (t) where i % 2 = 0 and h >= 3.0 - 1e-7),
ranked as (select *, row_number() over (partition by doc_id order by prio desc, bn desc, b, src, s) as rk from cands),
kept(doc_id, rk, list) as (
    select doc_id, 0::bigint, []::struct(lo bigint, hi bigint, rk bigint)[] from (select distinct doc_id from ranked)
    union all select r.doc_id, r.rk, case when len(list_filter(k.list, lambda z: z.lo < r.b + r.bn and r.b < z.hi)) = 0
        then list_append(k.list, {{'lo': r.b, 'hi': r.b + r.bn, 'rk': r.rk}}) else k.list end
    from kept k join ranked r on r.doc_id = k.doc_id and r.rk = k.rk + 1),
last as (select doc_id, max_by(list, rk) as list from kept group by doc_id),
chosen as (select r.* from (select doc_id, unnest(list).rk as rk from last) x join ranked r using (doc_id, rk))"""

MD5_KEY = "md5(o_orderkey::varchar)"
CURATED = f"""case o_orderkey % 9 when 0 then 'AKIA' || upper(substr({MD5_KEY}, 1, 16)) when 1 then 'ghp_' || {MD5_KEY} || 'abcd'
    when 2 then 'glpat-' || substr({MD5_KEY}, 1, 20) when 3 then 'xoxb-' || {MD5_KEY} when 4 then 'sk_live_' || {MD5_KEY}
    when 5 then 'AIza' || {MD5_KEY} || 'xyz' when 6 then 'sk-ant-' || {MD5_KEY} when 7 then 'npm_' || {MD5_KEY} || 'WXYZ'
    else 'u' || {MD5_KEY} || '@mail.example.org' end"""

TERMS = """words as (select string_split(text, ' ') as w from benchmark),
terms as (select distinct array_to_string(w[i : i + 3], ' ') as term from
    (select w, unnest(range(1, len(w) - 2)) as i from words where len(w) >= 4)),
hits as (select doc_id, text, term from documents, terms where contains(text, term)),
seen(doc_id, text, term, pos) as (
    select doc_id, text, term, strpos(text, term)::bigint from hits
    union all select doc_id, text, term, pos + strpos(substr(text, pos + 1), term) from seen
    where strpos(substr(text, pos + 1), term) > 0),
longest as (select doc_id, pos - 1 as s, max(pos - 1 + length(term)) as e from seen group by all),
ordered as (select *, row_number() over (partition by doc_id order by s) as rk from longest),
swept(doc_id, rk, reach, s, e, ok) as (
    select doc_id, rk, e, s, e, true from ordered where rk = 1
    union all select o.doc_id, o.rk, case when o.s >= x.reach then o.e else x.reach end, o.s, o.e, o.s >= x.reach
    from swept x join ordered o on o.doc_id = x.doc_id and o.rk = x.rk + 1)"""

_ROUND_TRIP_DOCS = "select doc_id, text as rehydrated from documents"
_LEAVES = """select leaf_path, n, chars::bigint as chars from (select 'e' as leaf_path, count(*)::bigint as n, sum(length(event_type))::bigint as chars from events
union all select 'list[0]', count(*), sum(length(event_type)) from events
union all select 'list[1]', count(*), sum(length('{"v":' || value || '}')) from events
union all select 'o.z', count(*), sum(length(props)) from events)"""

ORACLE: dict[str, str] = {
    "detect_email_counts": f"""select doc_id, len(regexp_extract_all(text, '{EMAIL}'))::bigint as emails from documents
        where len(regexp_extract_all(text, '{EMAIL}')) > 0""",
    "detect_spans_multi": f"""with {pieces(DOCS, 'doc_id')} select doc_id, start, start + length(t) as "end", byte_start,
        byte_start + strlen(t) as byte_end, ty, t as original from spans""",
    "detect_pages": f"""with {pieces('select page_id, html as text from pages', 'page_id')}
        select page_id, start, ty, t as original from spans""",
    "glossary_spans": f"""with {words("select 'd' || doc_id as id, text from documents union all select 'c-' || conv_id || '-' || turn, text from conversations", 'id')}
        select id, start, start + length(t) as "end", ty from spans""",
    "glossary_large": f"""with recursive {TERMS} select w.doc_id, w.s as start, w.e as "end", substr(d.text, w.s + 1, w.e - w.s) as original
        from swept w join documents d using (doc_id) where ok""",
    "glossary_reports": f"""with recursive {TERMS} select d.doc_id, count(w.doc_id)::bigint as detected
        from documents d left join (select doc_id from swept where ok) w using (doc_id) group by all""",
    "entropy_tokens": """with toks as (select doc_id, regexp_replace(text, '([A-Za-z0-9+/=_-]{20,})', chr(57344) || '\\1' || chr(57346), 'g') as m from documents),
        cut as (select doc_id, string_split_regex(m, '[' || chr(57344) || chr(57346) || ']') as ps from toks),
        listed as (select doc_id, unnest(ps) as token, unnest(range(1, len(ps) + 1)) as i from cut),
        placed as (select *, coalesce(sum(length(token)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from listed),
        bits as (select token, -sum((n / length(token)) * log2(n / length(token))) as h from
            (select token, c, count(*)::double as n from (select token, unnest(string_split(token, '')) as c from (select distinct token from placed where i % 2 = 0)) group by all) group by token)
        select doc_id, start, token from placed join bits using (token) where i % 2 = 0 and h >= 3.5 - 1e-7""",
    "shannon": f"""with chars as (select o_orderkey, c, count(*)::double as n from
            (select o_orderkey, unnest(string_split({MD5_KEY}, '')) as c from orders) group by all)
        select o_orderkey, round(-sum((n / 32) * log2(n / 32)), 3) as bits from chars group by o_orderkey""",
    "resolve_mixed": f"""{MIXED.replace("with ", "with recursive ", 1)} select doc_id, s as start, s + n as "end", ty, prio::bigint as priority from chosen""",
    "coverage": f"""{MIXED.replace("with ", "with recursive ", 1)} select det as detector, count(*)::bigint as candidates, count(c.rk)::bigint as accepted,
        (count(*) - count(c.rk))::bigint as shadowed from ranked r left join (select doc_id, rk from chosen) c on c.doc_id = r.doc_id and c.rk = r.rk group by det""",
    "prefilter_rows": f"""select lang, count(*) filter (regexp_matches(text, '({ASSIGNED})|({EMAIL})|({IPV4})'))::bigint as rows_hit,
        0::bigint as rows_missed from documents group by lang""",
    "curated_rules": f"""select o_orderkey, case o_orderkey % 9 when 0 then 'AWS_KEY' when 1 then 'GITHUB_TOKEN' when 2 then 'GITLAB_TOKEN'
        when 3 then 'SLACK_TOKEN' when 4 then 'STRIPE_KEY' when 5 then 'GCP_KEY' when 6 then 'ANTHROPIC_KEY' when 7 then 'NPM_TOKEN'
        else 'EMAIL' end as ty, {CURATED} as original from orders""",
    "names_heuristic": """select event_id, upper(event_type[1]) || event_type[2:] || ' Connor|James ' || upper(event_type[1]) || event_type[2:] ||
        '|O''' || upper(event_type[1]) || event_type[2:] as names from events""",
    "custom_detector": """select doc_id, (strpos(text, '#') - 1)::bigint as start, strlen(substr(text, 1, strpos(text, '#') - 1))::bigint as byte_start
        from documents where contains(text, '#')""",
    "tenant_terms": """with n as (select source, (length(text) - length(replace(text, 'tion', ''))) // 4 as a,
            case when source = 'src3' then (length(text) - length(replace(text, 'que', ''))) // 3
                 when source = 'src5' then (length(text) - length(replace(text, 'the', ''))) // 3 else 0 end as b from documents)
        select source, 'WORD' as ty, sum(a)::bigint as n from n group by source having sum(a) > 0
        union all select source, 'OWN', sum(b)::bigint from n group by source having sum(b) > 0""",
    "mask_request_scope": f"""{REQUEST}, held as (select doc_id, count(distinct t) as originals from spans group by doc_id)
        select doc_id, masked, coalesce(summary, '') as summary, coalesce(originals, 0)::bigint as originals
        from masked left join summaries using (doc_id) left join held using (doc_id)""",
    "mask_bare_style": f"""with {pieces(DOCS, 'doc_id')}, {masked('doc_id', 'doc_id', REQUEST_IDS, typed=False)} select doc_id, masked from masked""",
    "dry_run_reports": f"""with {pieces(DOCS, 'doc_id')}, {SUMMARY} select doc_id, text, coalesce(total, 0)::bigint as total,
        coalesce(summary, '') as summary from documents left join summaries using (doc_id)""",
    "reports_by_key": f"""with {pieces(DOCS, 'doc_id, source')} select source, sum(n)::bigint as total, string_agg(ty || '=' || n, ',' order by ty) as summary
        from (select source, ty, count(*) as n from spans group by all) group by source""",
    "mask_session_scope": f"{SESSION} select conv_id, turn, masked from masked",
    "mask_sharded": f"with {pieces(DOCS, 'doc_id')}, {masked('doc_id', '', SHARD_IDS)} select doc_id, masked from masked",
    "intern_sharded_vault": f"""with {pieces(DOCS, 'doc_id')}, ids as ({SHARD_IDS})
        select 'corpus' as scope_key, id, t as original, min_by(ty, doc_id * 1000000 + i) as ty, count(*)::bigint as uses
        from spans join ids using (t) group by id, t""",
    "intern_overflow": f"""with {pieces(DOCS, 'doc_id')}, d as (select distinct t, ('0x' || substr(md5(t), 1, 8))::bigint % 16 as sh from spans),
        n as (select t, sh, row_number() over (partition by sh order by t) - 1 as c from d)
        select case when c < 2 then sh * 1048576 + c else 4294967295 end as id, t as original from n""",
    "intern_hot_scope": f"with {pieces(DOCS, 'doc_id')}, ids as ({CORPUS_IDS}) select 'corpus' as scope_key, id, t as original from ids",
    "vault_merge": f"""with {pieces("select 0 as g, doc_id as k, text from documents union all select 1, page_id, html from pages", 'g, k')}
        select 'corpus' as scope_key, row_number() over (order by min(g * 1000000000000 + k * 100000 + i)) - 1 as id, t as original from spans group by t""",
    "vault_store_roundtrip": f"{SESSION} select cast(conv_id as varchar) as scope_key, id, t as original from ids where conv_id % 5 = 0",
    "vault_own_space": f"with {pieces(DOCS, 'doc_id')}, ids as ({SHARD_IDS}) select id, t as original from ids where id >= 1073741824 and id < 2147483648",
    "seal_roundtrip": f"""with {pieces(DOCS, 'doc_id')} select distinct t as original, t as opened, 28::bigint as overhead, true as wrong_key_fails from spans""",
    "tag_keys": f"""with k as (select user_id, {scope_key('user_id')} as k from (select distinct user_id from events))
        select event_id, {tag('k.k', 'event_id')} as tag from events join k using (user_id)""",
    "sentinels": f"""with t as (select *, {tag(f"'{SECRET}'", 'o_orderkey')} as tg from orders)
        select o_orderkey, '⟦S:' || o_orderpriority[1] || '·' || {b62('o_orderkey')} || '·' || {b62('tg')} || '⟧' as sentinel from t""",
    "rehydrate_join": _ROUND_TRIP_DOCS,
    "round_trip": "select 0::bigint as failures, sum(length(text))::bigint as chars from documents",
    "round_trip_failures": "select conv_id, turn from conversations where false",
    "leaks_after_rehydration": "select doc_id from documents where contains(text, '⟦S')",
    "sentinel_audit": f"""with {pieces(DOCS, 'doc_id, source')}, n as (select count(*) as docs, (select count(*) from spans) as spans,
            count(*) filter (source in (select source from spans)) as known from documents)
        select 'resolved' as verdict, spans::bigint as n from n union all select 'malformed', docs from n union all select 'overflow', docs from n
        union all select 'forged', known from n union all select 'unknown', docs - known from n where docs > known""",
    "chunk_rehydrate": _ROUND_TRIP_DOCS,
    "sse_rehydrate": "select conv_id || '-' || turn as response_id, 'choices[0].delta.content' as leaf_path, text as rehydrated from conversations",
    "sse_lines": """select conv_id || '-' || turn as response_id, (greatest((length(text) - 1) // 9, 0) + 2)::bigint as lines,
        (greatest((length(text) - 1) // 9, 0) + 1)::bigint as payloads from conversations""",
    "rehydrate_json_body": "select doc_id, text from documents",
    "json_path_leaves": """with n as (select *, row_number() over (partition by conv_id order by turn) - 1 as k from conversations)
        select conv_id, k::bigint as leaf_ord, 'messages[' || k || '].content' as leaf_path, text from n""",
    "all_leaves": _LEAVES,
    "all_leaves_typed": _LEAVES,
    "mask_json_bodies": REQUEST_MASKED,
    "mask_json_all": f"{REQUEST} select doc_id, masked, coalesce(total, 0)::bigint as total from masked left join summaries using (doc_id)",
    "mask_json_typed_columns": REQUEST_MASKED,
    "mask_json_in_session": f"{SESSION} select conv_id, turn, masked from masked",
    "json_unmatched": """select 'messages[].parts[].text' as path, count(distinct conv_id)::bigint as n from conversations
        union all select 'model[]', count(distinct conv_id) from conversations""",
    "fail_closed": """select conv_id, turn, case when turn % 3 = 0 and turn % 2 = 0 then 'rejected' else 'forwarded' end as outcome from conversations""",
    "oversized_bodies": "select doc_id, case when strlen(text) <= 4000 then 'accepted' else 'refused' end as outcome from documents",
    "route_match": f"""with {REQS}, {ROUTED} select event_id, r::bigint as route_ord, case when r is null then null
        when r = 1 then coalesce(nullif(path[9:], ''), '/') when r = 0 then coalesce(nullif(path[7:], ''), '/')
        when r = 2 then coalesce(nullif(path[6:], ''), '/') else coalesce(nullif(path[10:], ''), '/') end as rest from routed""",
    "host_match": f"with {REQS} select event_id, case when host = 'h1.example.com' then 4::bigint end as host_route_ord from reqs",
    "tenant_attribution": f"with {REQS} select event_id, {TENANT} as tenant from reqs",
    "authorize": f"with {REQS} select event_id, key in ('k1', 'k2', 'k3', 'k5') as authorized from reqs",
    "rejected_requests": f"with {REQS} select event_id, key from reqs where key in ('k0', 'k4')",
    "effective_policy": f"""with {REQS}, {ROUTED}, t as (select *, {TENANT} as tenant from routed)
        select event_id, case when tenant = 'acme' or r = 1 then 'dry-run' else 'enforce' end as mode,
        case when tenant = 'globex' or r in (1, 6) then 'session' else 'request' end as scope,
        case when tenant = 'globex' or r = 2 then 'bare-sentinel' else 'typed-sentinel' end as style from t""",
    "lint_policy": f"""with {REQS}, {ROUTED}, bad(route_ord, problem) as (values (2::bigint, 'unknown profile'), (2, 'no scan paths'), (4, 'no scan paths'), (6, 'no scan paths'))
        select route_ord, problem, count(*)::bigint as requests from routed join bad on r = route_ord group by all""",
    "scan_gate": """select conv_id, turn, case when role <> 'user' then 'not json' when conv_id % 5 = 0 then 'no scan paths'
        when turn % 4 = 0 or text = '' then 'empty' else 'scan' end as scan_status from conversations""",
    "header_rules": "select event_id, 'accept-encoding=identity;x-user=' || user_id as sent from events",
    "session_namespaces": f"""with {REQS}, t as (select *, {TENANT} as tenant from reqs)
        select event_id, hex(case when tenant is null then 'g' || chr(31) || user_id else 't' || chr(31) || tenant || chr(31) || user_id end) as ns from t""",
    "internal_targets": """with ips as (select (l_orderkey % 256) || '.' || (l_partkey % 256) || '.' || (l_suppkey % 256) || '.' || (l_linenumber - 1) as ip from lineitem)
        select ip, count(*)::bigint as n from ips where starts_with(ip, '127.') or starts_with(ip, '169.254.') or ip = '0.0.0.0' group by ip""",
    "sessionize_ttl": """with g as (select *, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) >= 21600 then 1 else 0 end as f from events)
        select event_id, (sum(f) over (partition by user_id order by ts rows unbounded preceding))::bigint as generation from g""",
    "compliance": f"""with {pieces(DOCS, 'doc_id, lang, source')} select lang, source, ty, count(*)::bigint as detected,
        count(distinct doc_id)::bigint as rows_hit from spans group by all""",
    "originals_per_scope": f"with {pieces(DOCS, 'doc_id, source')} select source, count(distinct t)::bigint as originals from spans group by source",
    "worst_sources": f"""with {pieces(DOCS, 'doc_id, source')}, n as (select source, count(*) as c from spans group by source)
        select d.source, coalesce(c, 0)::bigint as detected from (select distinct source from documents) d left join n using (source)
        order by detected desc, source limit 5""",
    "audit_chain": f"with recursive {CHAIN} select chain, segment, seq, event_id, prev, hash from links",
    "audit_verify": f"""with {SEGMENTS} select chain, segment, case when segment = 1 and n > 7 then 7 when segment = 2 and n > 9 then 9 else n end as count,
        case when segment = 1 and n > 7 then 7 when segment = 2 and n > 10 then 10 end::bigint as broken_at from segs""",
    "audit_tampering": f"""with {SEGMENTS} select chain, segment, case segment when 1 then 7 else 10 end::bigint as "at",
        case segment when 1 then 'record altered' else 'predecessor missing' end as problem from segs
        where (segment = 1 and n > 7) or (segment = 2 and n > 10)""",
    "audit_history": """with n as (select event_type as chain, count(*)::bigint as n from events group by all)
        select chain, "case", size, least(n, place)::bigint as count, n <= place as intact
        from n, (values ('edit', 57), ('segment', 100), ('tail', 145), ('whole', 1000000000000)) c("case", place), (values (50), (10000)) s(size)""",
    "transactions_bounded": f"""with {words('select * from conversations', 'conv_id, turn')}, n as (select conv_id, turn, count(*) as c from spans group by all),
        cutoff as (select *, list_max(list_filter(range(0, 102), lambda k: strlen(substr(text, 1, k)) <= 101)) as k from conversations)
        select substr(sha256(conv_id || chr(31) || turn), 1, 16) as id, conv_id * 100 + turn as ts, coalesce(c, 0)::bigint as detected,
        case when strlen(text) <= 101 then text else substr(text, 1, k) || case when strlen(substr(text, 1, k)) < 101 then chr(65533) else '' end end as request,
        strlen(text) > 101 as request_truncated, strlen(text) > 101 as response_truncated
        from cutoff left join n using (conv_id, turn)""",
    "secret_free": f"with {pieces(DOCS, 'doc_id, source')} select distinct -doc_id - 1 as doc_id from documents d where exists (select 1 from spans s where s.source = d.source and contains(d.text, s.t))",
    "base62": f"""with k as (select distinct (l_orderkey * 7919 + l_partkey * 104729) % 4294967296 as n from lineitem)
        select n, {b62('n')} as code, n as back from k""",
    "json_escapes": r"""select doc_id, (to_json(text)::varchar)[2:-2] as escaped from documents""",
    "durations": """select o_orderkey, case o_orderkey % 7 when 0 then o_orderkey * 60 when 1 then o_orderkey * 3600
        when 2 then o_orderkey when 3 then o_orderkey else 99 end::bigint as seconds from orders""",
    "id_spaces": """select o_orderkey, (o_orderkey % 4096) * 1048576 as base,
        least((o_orderkey % 4096) * 1048576 + 1048576, 4294967295) as upper from orders""",
    "request_ids": "select conv_id, turn, substr(sha256(conv_id || chr(31) || turn), 1, 16) as id from conversations",
    "dotenv_terms": """select distinct case o_orderkey % 4 when 0 then 'v-' || o_orderkey || '-secret' else 'q ' || o_orderkey end as term,
        'SECRET' as ty, 80::bigint as priority from orders
        where o_orderkey % 4 = 0 or (o_orderkey % 4 = 1 and length('q ' || o_orderkey) >= 5)""",
    "line_terms": """select distinct trim(l, ' ') as term from (select unnest(string_split(text, chr(10))) as l from documents)
        where trim(l, ' ') <> '' and not starts_with(trim(l, ' '), '#') and strlen(trim(l, ' ')) >= 5""",
    "kv_terms": "select distinct 'key-' || o_orderkey as term from orders where length('key-' || o_orderkey) >= 5",
    "stream_mask": REQUEST_MASKED,
    "stream_mask_session": f"{SESSION} select conv_id || '-' || turn as row_id, masked from masked",
    "stream_rehydrate": "select conv_id || '-' || turn as response_id, text as rehydrated from conversations",
    "stream_metrics": """select epoch(date_trunc('hour', ts))::bigint as window_start, ty, count(*)::bigint as detected
        from events, (values ('EMAIL'), ('IP')) v(ty) group by all""",
}
