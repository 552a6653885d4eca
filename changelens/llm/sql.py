"""DuckDB SQL of the queries that SQL can express on whole tables."""

OP1 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

OP8 = r"""
with parts as (
  select *, regexp_replace(url, '#.*$', '', 's') as bare from pages
), canon as (
  select page_id, url, html,
    case when regexp_matches(url, '^[^:/?#]+://') then concat(
      regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.|:(80|443)$', '', 'g'),
      regexp_replace(regexp_extract(bare, '^[^:/?#]+://[^/?#]*([^?]*)', 1), '/+$', ''),
      case when len(kept) > 0 then concat('?', array_to_string(kept, '&')) else '' end) else url end as canonical_url
  from (select *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=.*)?$')) as kept from parts)
), s as (
  select *, (page_id * 7919) % (86400 * 30) as at from canon
), r as (
  select canonical_url, page_id * 4 + k as id, s.at + [0, 43200, 129600][k + 1] as at, case when k = 1 then html else url end as body,
    case when page_id % 4 < 2 then concat('v', page_id * 4 + k) end as etag, case when page_id % 4 = 2 then concat('v', page_id * 4 + k) end as modified
  from s, (values (0), (1), (2)) as t(k)
), v as (
  select *, case when page_id % 4 < 2 then tag end as etag, case when page_id % 4 = 2 then tag end as modified
  from (select page_id, canonical_url, s.at + 86400 as at, case when page_id % 5 = 0 then 'new' else concat('v', page_id * 4 + 1) end as tag from s)
), hits as (
  select v.page_id, v.canonical_url, v.etag, v.modified, max(struct_pack(a := r.at, i := r.id)) filter (r.id is not null) as hit
  from v left join r on r.canonical_url = v.canonical_url and r.at < v.at group by all
), m as (
  select h.page_id, h.canonical_url, h.hit.i as response_id, r.body, case when h.hit is null then 'orphan'
    when h.etag is not null and r.etag is not null then if(h.etag = r.etag, 'resolved', 'mismatch')
    when h.modified is not null and r.modified is not null then if(h.modified = r.modified, 'resolved', 'mismatch') else 'unvalidated' end as status
  from hits h left join r on r.id = h.hit.i
)
select page_id, canonical_url, response_id, status, case when status = 'resolved' then cast(page_id * 4 + 3 as varchar) end as merged_date,
  case when status = 'resolved' then 'origin' end as merged_server, case when status = 'resolved' then sha256(body) end as body_sha256
from m
"""

SQL = {"op1_exact_dedup": OP1, "op8_warc": OP8}
