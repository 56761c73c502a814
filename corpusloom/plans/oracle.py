"""SQL that checks the core's queries: the same results by other means where there are others."""

from __future__ import annotations

import hashlib
import re

from .queries import GOLDEN, QUESTION, QUESTIONS

# White space, as RE2 writes it.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INLINE = r"[ \t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _blank(x: str) -> str:
    return f"({x} is null or {_strip(x)} = '')"


def _decoded(x: str) -> str:
    return f"regexp_replace(try(decode({x})), '\\r\\n?', chr(10), 'g')"


# Lines, then a running count of headings; the engine splits the text before headings instead.
_CHUNKS = f"""
lines as (
  select doc_id, lang, unnest(string_split_regex(text, '{_BREAK}')) as line, unnest(range(len(string_split_regex(text, '{_BREAK}')))) as n
  from documents where not {_blank('text')}),
marked as (
  select *, regexp_matches(line, '^#{{1,6}}{_INLINE}') as is_heading,
    sum(case when regexp_matches(line, '^#{{1,6}}{_INLINE}') then 1 else 0 end) over (partition by doc_id order by n) as sec
  from lines),
bodies as (
  select doc_id, any_value(lang) as lang, sec,
    max(case when is_heading then {_strip("regexp_replace(line, '^#{1,6}" + _INLINE + "+', '')")} end) as heading,
    {_strip("coalesce(string_agg(case when not is_heading then line end, chr(10) order by n), '')")} as body
  from marked group by doc_id, sec),
pieces as (
  select doc_id, lang, sec, heading, i, substring(body, (i * 850 + 1)::int, 1000) as text
  from (select *, unnest(range(case when length(body) <= 1000 then 1 else ceil((length(body) - 1000) / 850.0)::int + 1 end)) as i from bodies where body <> '')),
chunked as (
  select doc_id, lang, heading, text, (row_number() over (partition by doc_id order by sec, i) - 1)::int as chunk_index from pieces)
"""

_TOKENS = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))"
_BUCKET = "(('0x' || sha256(token)[1:8])::bigint % 256)::int"


def _question_weights() -> str:
    words = re.findall("[a-z0-9]+", QUESTION.lower())
    buckets = [int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 256 for w in words]
    return ", ".join(f"({b}, {buckets.count(b)})" for b in sorted(set(buckets)))


def _golden() -> str:
    bucket = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 256
    return ", ".join(f"('{w}', {bucket(w)})" for w in GOLDEN)


def _asked() -> str:
    rows = []
    for i, (q, _) in enumerate(QUESTIONS):
        buckets = [int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 256 for w in re.findall("[a-z0-9]+", q.lower())]
        rows += [f"({i}, {b}, {buckets.count(b)})" for b in sorted(set(buckets))]
    return ", ".join(rows)


def _questions() -> str:
    return ", ".join(f"({i}, '{q}', {min(5 if k is None else k, 20)})" for i, (q, k) in enumerate(QUESTIONS))


_LATEST = """
  select s.* from snapshot_chunks s join (
    select rel, max(coalesce(delivered_at, timestamp '0001-01-01')) as at from snapshot_chunks where rel is not null group by rel) l
  on s.rel = l.rel and coalesce(s.delivered_at, timestamp '0001-01-01') = l.at"""

_SERIES = """
  select rel, regexp_extract(rel, '^((?:.*/)?[^/]+)-(\\d{4}-\\d{2}-\\d{2})(?:\\.[^./]*)?$', 1) as series,
    regexp_extract(rel, '^((?:.*/)?[^/]+)-(\\d{4}-\\d{2}-\\d{2})(?:\\.[^./]*)?$', 2) as snapshot_date from """

# A chunk is kept unless the file before has as many of its key; its owner is the last one kept in its line.
def _plan_of(keyed: str, rels: str) -> str:
    """CTEs up to plan, from (rel, chunk_index, key) and (rel)."""
    return f"""
keyed as ({keyed}),
dated as ({_SERIES} ({rels})),
numbered as (select *, row_number() over (partition by series order by snapshot_date, rel) as n, count(*) over (partition by series) as files from dated where series <> ''),
c as (
  select k.rel, k.chunk_index, k.key, d.series, d.snapshot_date, d.n,
    row_number() over (partition by k.rel, k.key order by k.chunk_index) as j
  from keyed k join numbered d on k.rel = d.rel where d.files >= 3),
kept as (
  select a.*, not exists (select 1 from c b where b.series = a.series and b.key = a.key and b.j = a.j and b.n = a.n - 1) as is_kept from c a),
owned as (
  select k.*, (select max(o.n) from kept o where o.series = k.series and o.key = k.key and o.j = k.j and o.is_kept and o.n <= k.n) as owner_n from kept k),
plan as (
  select k.rel, k.chunk_index, o.rel as owner_rel, o.chunk_index as owner_index, k.is_kept, k.series, k.snapshot_date, k.n, k.key, k.j,
    case when k.is_kept then (select coalesce(string_agg(r.snapshot_date, ',' order by r.n), '') from owned r
      where r.series = k.series and r.key = k.key and r.j = k.j and not r.is_kept and r.owner_n = k.n) end as dates
  from owned k join kept o on o.series = k.series and o.key = k.key and o.j = k.j and o.n = k.owner_n)
"""


_KEY = "sha256(encode(coalesce(heading, '')) || '\\x00'::blob || encode(text))[1:16]"
_KEYED = f"select distinct rel, chunk_index, {_KEY} as key from latest"
_PLAN = f"latest as ({_LATEST}), " + _plan_of(_KEYED, "select distinct rel from latest")
_GAPS = f"""latest as ({_LATEST}), gone as (
  select rel from (select rel, row_number() over (partition by series order by snapshot_date, rel) as g, count(*) over (partition by series) as f
    from ({_SERIES} (select distinct rel from latest)) where series <> '') where f >= 3 and g % 3 = 0),
""" + _plan_of(_KEYED + " where rel not in (from gone)", "select distinct rel from latest")

# Two states of a folder, as <run>:<rel>; what each ingest should find there follows from the text alone.
_FOLDERS = f"""
notes as (select distinct file_no, batch_no, 'notes/' || rel as rel, content from files),
snaps as ({_LATEST}),
parts as (select distinct rel, chunk_index, coalesce(heading, '') as h, '## ' || coalesce(heading, '') || chr(10) || chr(10) || coalesce(text, '') as part from snaps),
dated_files as (select 'dated/' || rel as rel, md5(rel)[1:1] < 'c' as early, string_agg(part, chr(10) || chr(10) order by chunk_index, h, part) as text from parts group by all),
folder as (
  select 1 as run, rel, content from notes where batch_no <= 4
  union all select 2, rel, case when file_no % 5 = 0 then content || encode(chr(10) || chr(10) || '# Added' || chr(10) || chr(10) || 'One more line.' || chr(10)) else content end from notes where file_no % 7 <> 0
  union all select 1, rel, encode(text) from dated_files where early
  union all select 2, rel, encode(text) from dated_files),
seen as (select run, run || ':' || rel as rel, {_decoded('content')} as text from folder),
"""
_RUNS = f"""{_FOLDERS} {_CHUNKS.replace('select doc_id, lang,', 'select rel as doc_id, null as lang,', 1).replace('from documents', 'from seen', 1)},
{_plan_of(f"select doc_id as rel, chunk_index, {_KEY} as key from chunked", "select rel from seen")},
sums as (select rel as srel, sha256(text) as sha from seen where text is not null),
selected as (
  select c.doc_id as rel, c.chunk_index, coalesce(c.heading, '') as heading, c.text, p.snapshot_date, p.dates from chunked c
  left join plan p on p.rel = c.doc_id and p.chunk_index = c.chunk_index where p.is_kept is null or p.is_kept),
per as (select doc_id as rel, count(*)::int as chunks from chunked group by 1),
held as (select rel, string_agg(chunk_index::varchar, ',' order by chunk_index) as kept, count(*) as n from selected group by 1),
signed as (select rel, sha256(string_agg(chunk_index || ':' || dates, '|' order by chunk_index))[1:16] as spanh from plan where dates <> '' group by rel),
listed as (
  select per.rel, left(per.rel, 1)::int as run, sums.sha as sha256, per.chunks, case when coalesce(held.n, 0) <> per.chunks then coalesce(held.kept, '') end as kept, signed.spanh
  from per join sums on srel = per.rel left join held on held.rel = per.rel left join signed on signed.rel = per.rel)
"""


_MANIFEST = f"""
m as (
  select rel, r.sha256 as sha256, r.chunks as chunks, r.kept as kept from (
    select rel, arg_max({{'sha256': sha, 'chunks': chunks, 'kept': kept}}, (coalesce(sha, ''), chunks, kept is not null, kept)) as r from (
      select rel, lower({_strip('sha256')}) as sha, chunks, kept from manifest) group by rel)),
ids as (
  select rel || '::' || unnest(coalesce(kept, range(chunks)::int[])) as id from m)
"""
_DIFF = f"""
now as (
  select rel, arg_max(sha256(text), (batch_no, file_no, sha256(text))) as sha from (select rel, batch_no, file_no, {_decoded('content')} as text from files) where not {_blank('text')} group by rel),
diff as (
  select coalesce(n.rel, m.rel) as rel,
    case when n.rel is null then 'gone' when m.rel is null then 'new' when n.sha = m.sha256 then 'unchanged' else 'changed' end as state
  from now n full join m on n.rel = m.rel)
"""
_FIRST = """
first_rows as (
  select *, row_number() over (partition by collection, id order by coalesce(ingested_at, timestamp '0001-01-01'), coalesce(heading, '')) as k
  from chunks join (select distinct collection from run_identity) using (collection))
"""
_STORED = "collection, id, coalesce(heading, '') as heading, repeat_count, md5(text) as text_md5"
_RECORDS = f"""
latest as ({_LATEST}),
rows as (
  select distinct replace(rel, '-' || snapshot_date || '.md', '') as series, snapshot_date, coalesce(heading, '') as heading,
    replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text
  from latest where snapshot_date is not null),
days as (select series, snapshot_date, lead(snapshot_date) over (partition by series order by snapshot_date) as after from (select distinct series, snapshot_date from rows)),
old as (select r.series, d.after as snapshot_date, r.heading, r.text from rows r join days d using (series, snapshot_date) where d.after is not null),
new as (select r.* from rows r join (select series, after as snapshot_date from days where after is not null) d using (series, snapshot_date)),
changes as (
  select coalesce(o.series, n.series) as series, coalesce(o.snapshot_date, n.snapshot_date) as snapshot_date, coalesce(o.heading, n.heading) as heading,
    case when o.series is null then 'added' when n.series is null then 'removed' else 'changed' end as change_kind, md5(o.text) as old_md5, md5(n.text) as new_md5
  from old o full join new n on o.series = n.series and o.snapshot_date = n.snapshot_date and o.heading = n.heading
  where o.series is null or n.series is null or o.text <> n.text)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "content_hash_files": f"""
            select distinct file_no, batch_no, length(t) as n_chars, {_blank('t')} as skipped, sha256(t) as sha256
            from (select file_no, batch_no, {_decoded('content')} as t from files)""",
        "corpus_select": r"""
            with named as (select text, case doc_id % 9 when 1 then '_x/.y/' || rel when 2 then 'Routines/Wikilink Scan' || rel when 3 then 'infrastructure/claude-config-backup/' || rel
              when 4 then rel || '.MARKDOWN' when 5 then rel || '.txt' when 6 then 'drafts/' || rel when 7 then 'a[1]/b c%20/' || rel else rel end as rel from documents where rel is not null)
            select rel, md5(coalesce(text, '')) as md5 from named where regexp_matches(lower(rel), '[^/]\.(md|markdown)$')
            and not starts_with(rel, 'infrastructure/claude-config-backup/') and not starts_with(rel, 'Routines/Wikilink Scan') and not starts_with(rel, 'drafts/gear')""",
        "skip_blank": f"select doc_id, length(text) as n_chars from documents where {_blank('text')}",
        "chunk_documents": f"with {_CHUNKS} select doc_id, chunk_index, heading, length(text) as n_chars, md5(text) as text_md5 from chunked",
        "chunk_stats": f"""with {_CHUNKS} select coalesce(lower(lang), 'none') as label, count(*) as chunks, count(distinct doc_id) as docs,
            sum(length(text))::bigint as chars, max(chunk_index) as last_index from chunked group by 1""",
        "chunk_keys": r"""
            select sha256(encode(coalesce(heading, '')) || '\x00'::blob || encode(text))[1:16] as key, count(distinct id) as ids, min(id) as first_id
            from chunks group by 1""",
        "token_counts": f"select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, {_TOKENS} as token from documents) group by token",
        "token_buckets": f"select {_BUCKET} as bucket, count(*) as n from (select {_TOKENS} as token from documents) group by 1",
        "hash_embed_sparse": f"""
            select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as weight from (
              select doc_id, {_BUCKET} as bucket, count(*) as n from (select doc_id, {_TOKENS} as token from documents) group by 1, 2)""",
        "topk_cosine": """
            select vec_id, round(greatest(0, s), 4) as score from (
              select vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)) as s from embeddings)
            order by s desc, vec_id limit 10""",
        "topk_batch": """
            select query_id, vec_id, round(greatest(0, s), 4) as score, rank from (
              select q.vec_id as query_id, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as s,
                row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) as rank
              from embeddings q, embeddings e where q.vec_id % 100 = 0) where rank <= 5""",
        "search_documents": f"""
            with {_CHUNKS},
            counted as (select doc_id, chunk_index, {_BUCKET} as bucket, count(*) as n from (select doc_id, chunk_index, {_TOKENS} as token from chunked) group by all),
            asked as (select * from (values {_question_weights()}) t(bucket, q)),
            scored as (
              select c.doc_id, c.chunk_index, round(coalesce(sum(c.n * a.q), 0) / (sqrt(sum(c.n * c.n)) * (select sqrt(sum(q * q)) from asked)), 4) as score
              from counted c left join asked a using (bucket) group by 1, 2),
            best as (select * from scored order by score desc, doc_id, chunk_index limit 5)
            select b.doc_id, b.chunk_index, b.score,
              json_object('source', d.rel, 'heading', nullif(c.heading, ''), 'chunk_index', c.chunk_index)::varchar as citation
            from best b join chunked c using (doc_id, chunk_index) join documents d using (doc_id)""",
        "search_scoped": """
            select file_no, form::int as form, form in (0, 2, 3, 5) as inside from (select distinct file_no, rel from files), unnest(range(7)) t(form)""",
        "citations": """
            select distinct id, case
              when coalesce(snapshot_date, '') = '' then json_object('source', source, 'heading', nullif(heading, ''), 'chunk_index', chunk_index)
              when coalesce(repeat_dates, '') = '' then json_object('source', source, 'heading', nullif(heading, ''), 'chunk_index', chunk_index, 'snapshot_date', snapshot_date)
              else json_object('source', source, 'heading', nullif(heading, ''), 'chunk_index', chunk_index, 'snapshot_date', snapshot_date,
                'also_unchanged_on', repeat_dates, 'snapshots_covered', repeat_count) end::varchar as citation
            from chunks""",
        "query_validation": f"select doc_id, case when {_blank('text')} or length(text) > 4000 then 'invalid_query' else 'ok' end as verdict from documents",
        "clamp_k": """
            select n::int as n, asked, greatest(1, least(20, coalesce(try_cast(case when regexp_matches(asked, '^-?\\d+$') then asked end as int), 5)))::int as k
            from (values (0, '-3'), (1, '0'), (2, '1'), (3, '5'), (4, '20'), (5, '21'), (6, '1000'), (7, ''), (8, 'ten'), (9, '1e400')) t(n, asked)""",
        "series_parse": f"""
            select rel, nullif(series, '') as series, nullif(snapshot_date, '') as snapshot_date from (
            {_SERIES} (select rel from manifest union select rel from snapshot_chunks))""",
        "series_group": f"""
            select rel, series, snapshot_date, n from (
              select *, row_number() over (partition by series order by snapshot_date, rel) as n, count(*) over (partition by series) as files
              from ({_SERIES} (select distinct rel from snapshot_chunks)) where series <> '') where files >= 3""",
        "snapshot_plan_rows": f"with {_PLAN} select rel, chunk_index, owner_rel, owner_index, is_kept, dates from plan",
        "snapshot_plan_gaps": f"with {_GAPS} select rel, chunk_index, owner_rel, owner_index, is_kept, dates from plan",
        "ingest_manifest": f"with {_RUNS} select rel[3:] as rel, sha256, chunks, kept, spanh from listed where run = 2",
        "ingest_table": f"""with {_RUNS}
            select rel[3:] || '::' || chunk_index as id, rel[3:] as source, heading, chunk_index, md5(text) as text_md5, snapshot_date,
              case when snapshot_date is not null then case when dates = '' then 1 else len(string_split(dates, ',')) + 1 end end::int as repeat_count,
              case when snapshot_date is not null then case when len(string_split(dates, ',')) <= 60 then dates
                else string_split(dates, ',')[1] || '..' || string_split(dates, ',')[-1] || ' (' || len(string_split(dates, ',')) || ' snapshots)' end end as repeat_dates, 16 as dim
            from selected where starts_with(rel, '2:')""",
        "ingest_reports": f"""with {_RUNS},
            files_of as (select run, count(*) as files_seen from seen group by 1),
            ids as (select left(rel, 1)::int as run, rel[3:] as rel, chunk_index from selected),
            old as (select rel[3:] as rel, sha256 from listed where run = 1), new as (select rel[3:] as rel, sha256 from listed where run = 2),
            per_file as (
              select n.rel, coalesce(n.sha256 = o.sha256, false) as same, count(i.chunk_index) filter (not coalesce(n.sha256 = o.sha256, false) or s.rel is null) as added
              from new n left join old o using (rel) left join ids i on i.run = 2 and i.rel = n.rel left join ids s on s.run = 1 and s.rel = i.rel and s.chunk_index = i.chunk_index group by all),
            gone as (select count(*) as n from ids s where s.run = 1 and not exists (select 1 from ids i where i.run = 2 and i.rel = s.rel and i.chunk_index = s.chunk_index)),
            counts as (select run, (select count(*) from listed l where l.run = f.run) as listed, files_seen, (select count(*) from ids i where i.run = f.run) as stored,
              (select count(*) from plan where not is_kept and starts_with(rel, f.run || ':')) as deduped from files_of f),
            unchanged as (select count(*) as n, (select sum(added) from per_file) as added from per_file where same and added = 0)
            select run, files_seen::int as files_seen, (listed - u)::int as files_ingested, u::int as files_unchanged, (files_seen - listed)::int as files_skipped, added::int as chunks_added,
              deleted::int as chunks_deleted, deduped::int as chunks_deduped, run > 1 as incremental, stored::int as store_count
            from (
              select 1 as run, files_seen, listed, 0 as u, stored as added, 0 as deleted, deduped, stored from counts where run = 1
              union all select 2, files_seen, listed, n, added, (select n from gone), deduped, stored from counts, unchanged where run = 2
              union all select 3, files_seen, listed, listed, 0, 0, deduped, stored from counts where run = 2)""",
        "hash_embed_golden": f"""
            with words as (select doc_id, {_TOKENS} as token from documents), buckets as (select * from (values {_golden()}) t(token, bucket)),
            n as (select doc_id, bucket, count(*) as n from words join buckets using (token) group by all)
            select doc_id, bucket::int as bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 3) as weight from n""",
        "store_search": f"""
            with {_CHUNKS}, counted as (select doc_id, chunk_index, {_BUCKET} as bucket, count(*) as n from (select doc_id, chunk_index, {_TOKENS} as token from chunked) group by all),
            norms as (select doc_id, chunk_index, sqrt(sum(n * n)) as norm from counted group by all),
            asked as (select * from (values {_asked()}) t(q, bucket, m)), questions as (select * from (values {_questions()}) t(q, query, k)),
            lengths as (select q, sqrt(sum(m * m)) as length from asked group by 1),
            met as (select q, doc_id, chunk_index, sum(n * m) as dot from counted join asked using (bucket) group by all),
            scored as (
              select q.q, q.k, c.doc_id, c.chunk_index, coalesce(m.dot / (o.norm * l.length), 0) as s, case when c.doc_id % 3 = 0 then '../outside/' || d.rel else d.rel end || '::' || c.chunk_index as id
              from chunked c join documents d using (doc_id) cross join questions q join lengths l on l.q = q.q
              left join met m on m.q = q.q and m.doc_id = c.doc_id and m.chunk_index = c.chunk_index left join norms o on o.doc_id = c.doc_id and o.chunk_index = c.chunk_index where d.rel is not null),
            best as (select * from scored qualify row_number() over (partition by q order by round(s, 9) desc, id) <= k)
            select q.q as n, true as ok, q.query, q.k, count(*) filter (not starts_with(id, '..'))::int as count, count(*) filter (starts_with(id, '..'))::int as dropped,
              max(round(round(s, 4), 3)) filter (not starts_with(id, '..')) as best, min(round(round(s, 4), 3)) filter (not starts_with(id, '..')) as worst, true as in_order
            from questions q left join best b on b.q = q.q group by all""",
        "search_errors": """
            select name as case_name, false as ok, type, k, 0 as results from (values
              ('null', 'invalid_query', null), ('blank', 'invalid_query', null), ('number', 'invalid_query', null), ('too long', 'invalid_query', null), ('longest', 'empty_store', 5),
              ('invalid before down', 'invalid_query', null), ('down', 'store_unreachable', 20), ('fails', 'store_unreachable', 3), ('empty', 'empty_store', 1), ('infinite k', 'empty_store', 5),
              ('no k', 'empty_store', 5), ('other tool', 'unknown_tool', null), ('tool', 'empty_store', 2), ('configuration', 'config_error', null)) t(name, type, k)""",
        "store_guards": """
            select * from (values
              ('count', '1'), ('other dimension', 'DimensionMismatchError'), ('other collection', '0'), ('opened again', '1'), ('add nothing', '1'), ('delete unknown', '1'), ('no answers for k 0', '0'),
              ('manifest of none', '0'), ('overlap too large', 'ValueError'), ('unknown embedder', 'ValueError'), ('weights absent', 'RuntimeError'), ('prefix on queries alone', '[''Find: pump'', ''pump'']'),
              ('settings missing', 'ValueError'), ('settings', '(''knowledge'', ''hash'')'), ('settings with a wrong embedder', 'ValueError'), ('lock live stale', 'False'), ('lock none stale', 'True'),
              ('lock dead stale', 'True'), ('lock no time stale', 'True'), ('lock old stale', 'True'), ('lock elsewhere stale', 'False'), ('command without a verb', '[''x/'']'),
              ('tool schema', '[(''search_knowledge'', [''query''])]')) t(case_name, outcome)""",
        "snapshot_spans": f"""with {_PLAN} select rel, sha256(string_agg(chunk_index || ':' || dates, '|' order by chunk_index))[1:16] as spanh
            from plan where dates <> '' group by rel""",
        "snapshot_shown": """
            select distinct rel, chunk_index, case when len(repeat_dates) <= 60 then coalesce(array_to_string(repeat_dates, ','), '')
              else repeat_dates[1] || '..' || repeat_dates[-1] || ' (' || len(repeat_dates) || ' snapshots)' end as shown, (len(repeat_dates) + 1)::int as repeat_count
            from snapshot_plan where is_kept""",
        "suppressed": f"""
            select nullif(d.series, '') as series, count(*) as chunks, sum(case when not p.is_kept then 1 else 0 end)::bigint as suppressed
            from (select distinct * from snapshot_plan) p join ({_SERIES} (select distinct rel from snapshot_plan)) d using (rel) group by 1""",
        "manifest_diff": f"with {_MANIFEST}, {_DIFF} select rel, state from diff",
        "ingest_counts": f"""with {_MANIFEST}, {_DIFF} select sum((state = 'new')::int)::bigint as files_new, sum((state = 'changed')::int)::bigint as files_changed,
            sum((state = 'unchanged')::int)::bigint as files_unchanged, sum((state = 'gone')::int)::bigint as files_gone from diff""",
        "stale_chunks": f"with {_MANIFEST} select id from ids except select id from chunks",
        "missing_chunks": f"with {_MANIFEST} select id from chunks except select id from ids",
        "upsert_chunks": f"with {_FIRST} select {_STORED} from first_rows qualify row_number() over (partition by collection, id order by k desc) = 1",
        "delete_chunks": f"with {_FIRST} select {_STORED} from first_rows where k = 1 and chunk_index % 5 <> 0",
        "refresh_metadata": f"""with {_FIRST} select collection, id, coalesce(heading, '') as heading,
            (repeat_count + case when snapshot_date is not null then 1 else 0 end)::int as repeat_count, md5(text) as text_md5 from first_rows where k = 1""",
        "store_sources": "select collection, source, count(distinct id) as chunks from chunks join (select distinct collection from run_identity) using (collection) group by all",
        "store_count": "select i.collection, count(distinct c.id) as chunks from (select distinct collection from run_identity) i left join chunks c using (collection) group by all",
        "p2_found": f"with {_RECORDS} select series, snapshot_date, heading, change_kind from changes",
        "p2_values": f"with {_RECORDS} select * from changes",
    }
