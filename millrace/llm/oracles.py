"""Equivalent SQL (DuckDB) of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

#: Folding as in text.py, for the letters that the corpus has.
_FOLD = (
    "lower(translate(regexp_replace({0}, '[\\p{{Mn}}\\p{{Me}}\\p{{Mc}}\\p{{Cf}}ـ]', '', 'g'), "
    "'آأإٱؤئۓۂۀيىكهھە٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'ااااویےہہییکہہہ01234567890123456789'))"
)
_PATH = "regexp_replace(regexp_replace(lower(source_path), '[\\\\/]+', '/', 'g'), '^(\\./)*/?', '')"
_FOLDER = f"regexp_replace({_PATH}, '/?[^/]*$', '')"
_DIGITS = "translate({0}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"

P2_FOUND = f"""
with rec as (
  select uid, regexp_extract({_FOLDER}, '^[^/]*(/[^/]*)?') as src, min(text) as text
  from build where source in ('newspaper', 'web') and uid is not null and source_path is not null group by 1, 2
),
split as (select uid, src, string_split(coalesce(text, ''), chr(10)) as ls from rec),
lines as (select uid, src, unnest(range(len(ls)))::int as line_no, unnest(ls) as line from split),
keyed as (select uid, src, line_no, regexp_replace({_FOLD.format("line")}, '[^\\p{{L}}]', '', 'g') as k from lines),
often as (
  select src, k from keyed where k <> '' group by src, k
  having count(distinct uid) >= 4 and count(distinct uid) >= 0.1 * (select count(*) from rec r where r.src = keyed.src)
)
select uid, line_no from keyed join often using (src, k)
"""

P2_CLEANED = P2_FOUND.replace("select uid, line_no from keyed join often using (src, k)", "").rstrip() + f""",
b as (select row_number() over () as r, uid, text, case when source in ('newspaper', 'web') then regexp_extract({_FOLDER}, '^[^/]*(/[^/]*)?') end as src from build where uid is not null),
bl as (select r, src, unnest(range(len(string_split(text, chr(10)))))::int as i, unnest(string_split(text, chr(10))) as line from b where text is not null),
gone as (select r, i, line, k is not null as bad from (select r, i, line, src, regexp_replace({_FOLD.format("line")}, '[^\\p{{L}}]', '', 'g') as key from bl) x left join often o on o.src = x.src and o.k = x.key and x.key <> ''),
made as (select r, string_agg(line, chr(10) order by i) filter (where not bad) as text, count(*) filter (where bad)::int as lines_removed from gone group by r)
select distinct b.uid, case when b.text is null then null else coalesce(m.text, '') end as text, coalesce(m.lines_removed, 0) as lines_removed from b left join made m using (r)
"""

_KEYS = f"""
recs as (
  select uid, source, {_FOLDER} as folder, regexp_extract({_PATH}, '^[^/]+/([^/]+)/', 1) as slug,
    regexp_extract(regexp_extract({_DIGITS.format("coalesce(issue, '')")}, '(\\d+)', 1), '^0*(\\d+)$', 1) as num,
    case when date_precision = 'day' then regexp_extract(date, '^\\d{{4}}-\\d\\d-\\d\\d') end as day
  from build where uid is not null and source in ('newspaper', 'book') and source_path is not null
),
dated as (select *, {_DIGITS.format("folder")} as f from recs),
keyed as (
  select case when source = 'newspaper' and num <> '' then 'issue:' || slug || ':' || num else 'dir:' || folder end as key, source, slug, day, f,
    regexp_extract(f, '(?:^|\\D)((?:19|20)\\d\\d)[-./_ ](\\d{{1,2}})[-./_ ](\\d{{1,2}})(?:\\D|$)', ['y', 'm', 'd']) as a,
    regexp_extract(f, '(?:^|\\D)(\\d{{1,2}})[-./_ ](\\d{{1,2}})[-./_ ]((?:19|20)\\d\\d)(?:\\D|$)', ['d', 'm', 'y']) as b
  from dated
),
attrs as (
  select key, 'day:' || slug || ':' || day as attr from keyed where source = 'newspaper' and day is not null and day <> ''
  union select key, 'day:' || slug || ':' || a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') from keyed where source = 'newspaper' and a.y <> ''
  union select key, 'day:' || slug || ':' || b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') from keyed where source = 'newspaper' and b.y <> '' and a.y = ''
  union select key, 'farma:' || regexp_extract(regexp_extract(f, 'farma\\D*?(\\d+)', 1), '^0*(\\d+)$', 1) from keyed where source = 'book' and regexp_extract(f, 'farma\\D*?(\\d+)', 1) <> ''
  union select 'run:' || id, 'arm:' || regexp_extract(regexp_extract(' ' || {_DIGITS.format("id")} || ' ', '[^A-Za-z0-9][Aa](\\d+)[^A-Za-z0-9]', 1), '^0*(\\d+)$', 1)
    from health_gates_and_support where id is not null and regexp_extract(' ' || {_DIGITS.format("id")} || ' ', '[^A-Za-z0-9][Aa](\\d+)[^A-Za-z0-9]', 1) <> ''
)"""

P3_FOUND = f"""
with recursive {_KEYS},
edges as (select distinct x.key as a, y.key as b from attrs x join attrs y using (attr)),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a)
select a as key_a, b as key_b from reach where a < b
"""

P3_CHECKS = f"""
with recursive {_KEYS},
edges as (select distinct x.key as a, y.key as b from attrs x join attrs y using (attr)),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
least as (select a, min(b) as component from reach group by a),
own as (
  select uid, false as run, min(case when source = 'newspaper' and num <> '' then 'issue:' || slug || ':' || num when source in ('newspaper', 'book') then 'dir:' || folder else 'uid:' || uid end) as key
  from (select uid, source, {_FOLDER} as folder, regexp_extract({_PATH}, '^[^/]+/([^/]+)/', 1) as slug,
    regexp_extract(regexp_extract({_DIGITS.format("coalesce(issue, '')")}, '(\\d+)', 1), '^0*(\\d+)$', 1) as num from build where uid is not null) group by uid
  union all select distinct id, true, 'run:' || id from health_gates_and_support where id is not null
)
select count(*) as n_records, count(distinct coalesce(l.component, o.key)) as n_components, 0 as torn_keys, 0 as torn_attributes from own o left join least l on l.a = o.key
"""

P8_FOUND = """
select distinct capacity_tokens, doc_id from documents, containers
where doc_id is not null and text <> '' and strlen(text) + 1 > capacity_tokens
"""

P9_FOUND = f"""
with dw as (select doc_id, regexp_extract_all({_FOLD.format("text")}, '[\\p{{L}}\\p{{Nd}}]+') as w from documents where text is not null),
iw as (select item_id, regexp_extract_all({_FOLD.format("text")}, '[\\p{{L}}\\p{{Nd}}]+') as w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[i:i + 13], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 12)) as i from dw)),
ig as (select item_id, array_to_string(w[i:i + 13], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 12)) as i from iw))
select distinct doc_id, item_id from dg join ig using (g)
"""

P9_ITEMS = f"""
with found as ({P9_FOUND})
select i.item_id, i.suite, count(f.doc_id) as n_documents from (select distinct item_id, suite from eval_items) i left join found f using (item_id) group by 1, 2
"""

ORACLES = {"p2_found": P2_FOUND, "p2_cleaned": P2_CLEANED, "p3_found": P3_FOUND, "p3_checks": P3_CHECKS, "p8_found": P8_FOUND, "p9_found": P9_FOUND, "p9_items": P9_ITEMS}
