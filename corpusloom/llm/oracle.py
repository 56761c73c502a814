"""SQL that checks this package's queries on whole tables, where SQL is fast enough.

There is none for p6_packed and p6_waste (packings are not unique; p6_placed checks their rules), p8 (fitted statistics),
p3_pieces (cuts are not unique; p3_rebuilt checks their rules) and the reports of passages; tests hold these against brute
force on small tables.
"""

from __future__ import annotations

from ..plans.oracle import _blank, _decoded, _strip

_RECORDS = """
rows_ as (
  select id, heading, coalesce(text, '') as text, collection,
    row_number() over (partition by id order by coalesce(heading, '') = '', coalesce(ingested_at, timestamp '0001-01-01') desc) as k
  from chunks where id is not null),
records as (select * from rows_ where k = 1)
"""

# A place may be cut after a line end or a CJK full stop, or after . ! ? before white space.
_GAPS = f"""
{_RECORDS},
long_ as (
  select r.id, r.text, i.max_chars from records r join (select collection, min(max_chars) as max_chars from run_identity group by 1) i using (collection)
  where length(r.text) > i.max_chars),
chars as (select id, max_chars, length(text) as size, unnest(regexp_extract_all(text, '(?s).')) as c, unnest(range(1, length(text) + 1)) as pos from long_),
places as (
  select id, max_chars, size, pos from (select *, lead(c) over (partition by id order by pos) as next from chars)
  where pos = size or c = chr(10) or c = chr(12290) or (c in ('.', '!', '?') and regexp_matches(next, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))),
gaps as (select id, max_chars, pos - coalesce(lag(pos) over (partition by id order by pos), 0) as gap from places)
"""

_SHINGLES = f"""
{_RECORDS},
words as (select id, regexp_extract_all(lower(coalesce(heading, '') || ' ' || text), '[a-z0-9]+') as w from records),
runs as (
  select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s
  from (select id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 20)),
sizes as (select id, count(*) as n from runs group by id)
"""


_SPANS = f"""
            {_RECORDS},
            places as (select id, i as s, substring(text, i + 1, 200) as piece from (select id, text, unnest(range(length(text) - 199)) as i from records where length(text) >= 200)),
            shared as (select md5_number(piece) as h from places group by 1 having min(id) <> max(id)),
            hits as (select p.id, p.s from places p join shared on md5_number(p.piece) = shared.h),
            marked as (select id, s, case when s <= lag(s) over (partition by id order by s) + 200 then 0 else 1 end as new from hits),
            grouped as (select id, s, sum(new) over (partition by id order by s) as g from marked),
            spans as (select id, min(s)::bigint as span_start, (max(s) + 200)::bigint as span_end from grouped group by id, g)
"""

_PAIRS = f"""
            {_SHINGLES},
            met as (select a.id as id_a, b.id as id_b, count(*) as m from runs a join runs b on a.s = b.s and a.id < b.id group by 1, 2),
            pairs as (select id_a, id_b from met join sizes x on x.id = id_a join sizes y on y.id = id_b where m * 8 >= 3 * (x.n + y.n))
"""

# Each file that takes part once, history as batch 0; whom it is alike; then one file after the other.
_FILES = f"""
            rows_ as (select file_no, batch_no, {_decoded('content')} as text from files where file_no is not null and batch_no is not null),
            texts as (
              select file_no, case when file_no in (select file_no from manifest where file_no is not null) or r.batch_no < 0 then 0 else r.batch_no end as batch_no, sha256(r.text) as sha, r.text
              from (select file_no, arg_min({{'batch_no': batch_no, 'text': text}}, (batch_no, sha256(text))) as r from rows_ where not {_blank('text')} group by 1)),
            words as (select file_no, regexp_extract_all(lower(text), '[a-z0-9]+') as w from texts),
            runs as (select distinct file_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select file_no, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)),
            sizes as (select file_no, count(*) as n from runs group by 1),
            met as (select a.file_no as x, b.file_no as y, count(*) as m from runs a join runs b on a.s = b.s and a.file_no <> b.file_no group by 1, 2),
            alike as (
              select x, y from met join sizes a on a.file_no = x join sizes b on b.file_no = y where 17 * m >= 7 * (a.n + b.n)
              union select a.file_no, b.file_no from texts a join texts b on a.sha = b.sha and a.file_no <> b.file_no),
            listed as (select distinct file_no, lower({_strip('sha256')}) as sha from manifest where file_no is not null and sha256 is not null and file_no not in (select file_no from files where file_no is not null)),
            held as (
              select x as file_no, y as other from alike join texts t on t.file_no = y and t.batch_no = 0
              union select t.file_no, l.file_no from texts t join listed l using (sha)),
            queue as (select file_no, batch_no, row_number() over (order by batch_no, file_no) as k from texts where batch_no > 0),
            steps as (
              select q.k, q.file_no, exists (select 1 from held h where h.file_no = q.file_no) as told,
                coalesce((select list(p.file_no) from alike a join queue p on p.file_no = a.y where a.x = q.file_no and p.k < q.k), []) as before from queue q),
            walk as (
              select 0::bigint as k, []::bigint[] as accepted
              union all select s.k, case when s.told or list_has_any(s.before, w.accepted) then w.accepted else list_append(w.accepted, s.file_no) end from walk w join steps s on s.k = w.k + 1),
            last as (select accepted from walk order by k desc limit 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_SPANS} select * from spans",
        "p1_report": f"""
            with {_SPANS}
            select r.id, length(r.text)::bigint as n_chars, coalesce(sum(span_end - span_start), 0)::bigint as shared_chars, count(span_start) as spans
            from records r left join spans s on s.id = r.id group by r.id, r.text""",
        "p3_found": f"with {_GAPS} select id, max((gap > max_chars)::int)::bigint as forced from gaps group by id",
        "p3_rebuilt": f"with {_GAPS} select id, md5(text) as text_md5, 0 as wrong, 1 as headings from long_",
        "p4_found": f"with {_PAIRS} select id_a, id_b from pairs",
        "p4_groups": f"""
            with recursive {_PAIRS},
            links as (select id_a as a, id_b as b from pairs union all select id_b, id_a from pairs),
            reach as (select id, id as root from sizes union select l.b, r.root from reach r join links l on l.a = r.id),
            same as (select id, md5(string_agg(s, '|' order by s)) as h from runs group by id)
            select id, (select min(root) from reach r where r.id = s.id) as group_id, (select count(*) - 1 from same t where t.h = s.h) as copies,
              (select count(*) from links l where l.a = s.id) as links from same s""",
        "p5_found": f"""
            with recursive {_FILES},
            refused as (select file_no, k from queue, last where not list_contains(accepted, file_no)),
            cases as (
              select file_no, other from refused join held using (file_no)
              union select r.file_no, a.y from refused r join alike a on a.x = r.file_no join queue p on p.file_no = a.y and p.k < r.k, last where list_contains(accepted, a.y))
            select least(file_no, other) as file_no_a, greatest(file_no, other) as file_no_b from cases""",
        "p6_placed": """
            select container, capacity, count(distinct doc_id) as docs, 0 as cut, 0 as broken, 0 as overfull from documents, (select distinct container, capacity from containers where capacity >= 1)
            where text <> '' and doc_id is not null group by all""",
        "p7_found": """
            with w as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
            windows as (
              select item_id, w[i:i + least(13, len(w)) - 1] as g
              from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from w where len(w) > 0)),
            d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
            sizes as (select distinct len(g) as n from windows),
            runs as (
              select doc_id, w[i:i + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n))
            select distinct doc_id, item_id from runs join windows using (g)""",
    }
