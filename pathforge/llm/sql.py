"""DuckDB SQL of the queries that SQL can express on whole tables."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""with d as (select doc_id, {WORDS} as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
firsts as (select g, min(doc_id) as first_id from windows group by g),
gone as (select distinct doc_id, i + k as p from (select doc_id, i, unnest(range(13)) as k from windows join firsts using (g) where first_id < doc_id)),
words as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
kept as (select words.doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by words.p) filter (where gone.p is null) as body
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by words.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join kept using (doc_id)"""

CONTAINED = f"""with d as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (
  select doc_id, w, unnest(range(1, len(w) - 3)) as i from (select doc_id, {WORDS} as w from documents))),
b as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as g from (
  select item_id, w, unnest(range(1, len(w) - 3)) as i from (select item_id, {WORDS} as w from benchmark))),
sizes as (select item_id, count(*) as n from b group by item_id),
shared as (select doc_id, item_id, count(*) as m from d join b using (g) group by doc_id, item_id)
select doc_id, item_id, n as n_shingles, m as n_shared, cast(m as double) / n as containment from shared join sizes using (item_id) where m >= 0.8 * n"""

RECORDS = """with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as size from pages),
g as (select *, case when size >= 100 then min(page_id) over (partition by body) else page_id end as first_id from p)
select page_id, cast(size as bigint) as payload_bytes, sha256(body) as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from g"""
