"""DuckDB SQL for the queries whose rows SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op8_line_dedup"] = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), lines as (
  select r, doc_id, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as pos
  from docs
), keyed as (
  select r, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), shared as (
  select k, min(doc_id) as keeper from keyed where length(k) >= 10
  group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.*, shared.k is not null and keyed.doc_id <> shared.keeper as gone
  from keyed left join shared on keyed.k = shared.k
)
select any_value(doc_id) as doc_id, count(*) as n_lines,
       count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by r
"""

#: CRC-32 (the reflected polynomial EDB88320) from a table that SQL makes; letters above ASCII have two bytes.
ORACLES["op11_spelling_groups"] = r"""
with recursive poly as (
  select list(c order by i) as tbl from (
    select i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) t(i))
), runs as (
  select coalesce(cast(doc_id as varchar), '') || ':' as id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
  from documents where text is not null
), counted as (
  select id, run, count(*) as n from runs group by id, run
), bytes as (
  select run, n, list_prepend(4294967295, flatten(list_transform(string_split(id || run, ''),
    lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [195::bigint, cast(unicode(c) - 64 as bigint)] end))) as b
  from counted
), hashed as (
  select run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) as h
  from bytes, poly
), words as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2)
                else run end as word, n from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3
), plain as (
  select word, n, translate(word, hi, lo) as w from words,
    (select string_agg(chr(cast(x as int)), '' order by x) as hi from range(192, 256) t(x)),
    (select string_agg(chr(cast(x as int)), '' order by x) as lo from range(33, 97) t(x))
), variants as (
  select word, w, w as v from plain
  union all
  select word, w, substr(w, 1, i - 1) || substr(w, i + 1) from plain, lateral (select unnest(range(1, length(w) + 1)) as i)
), near as (
  select distinct a.word, b.word as near from variants a join variants b on a.v = b.v and a.word <> b.word
  where levenshtein(a.w, b.w) = 1
), about as (
  select near.word, count(*) as n_near, min_by(struct_pack(form := near.near, form_n := other.n), struct_pack(x := -other.n, y := near.near)) as best
  from near join words other on other.word = near.near group by near.word
), formed as (
  select words.word, words.n, coalesce(n_near, 0) as n_near,
         case when best.form_n >= 2 * words.n then best.form end as form,
         case when best.form_n >= 2 * words.n then best.form_n end as form_n
  from words left join about on about.word = words.word
), walk as (
  select word, word as root, form as next from formed
  union all
  select walk.word, formed.word, formed.form from walk join formed on formed.word = walk.next
)
select formed.word, formed.form, walk.root, formed.n, cast(formed.n_near as bigint) as n_near, formed.form_n
from formed join walk on walk.word = formed.word and walk.next is null
"""

ORACLES["op12_fill_in_middle"] = r"""
with docs as (
  select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as parts,
         sha256('7:' || coalesce(cast(doc_id as varchar), '')) as digest
  from documents
), numbered as (
  select *, len(parts) - case when parts[-1] = '' then 1 else 0 end as n,
         cast('0x' || substr(digest, 1, 8) as bigint) as h1, cast('0x' || substr(digest, 9, 8) as bigint) as h2,
         cast('0x' || substr(digest, 25, 8) as bigint) as h4
  from docs
), cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from numbered
), pieces as (
  select *, case when a = 0 then '' else array_to_string(parts[1:a], chr(10)) || case when a < len(parts) then chr(10) else '' end end as head,
         case when b = 0 then '' else array_to_string(parts[1:b], chr(10)) || case when b < len(parts) then chr(10) else '' end end as both_
  from cuts
), named as (
  select *, substr(both_, length(head) + 1) as middle, substr(t, length(both_) + 1) as tail from pieces
)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(head) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'spm' then '<S>' || tail || '<P>' || head || '<M>' || middle
              else '<P>' || head || '<S>' || tail || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from named
"""
