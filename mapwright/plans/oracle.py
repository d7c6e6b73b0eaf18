"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from .adapters import PHRASES, RUN_TS, SECOND_RUN, SQL_ARTICLES, SQL_EDGES, SQL_JOBS, SQL_LINES, SQL_MENTIONS, sql_norm, sql_relation, sql_slug

_PHRASES = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_GENERIC = r"^(the |a |an |this |that )?(new|old|legacy|current|existing|updated|original|previous)\b.*\b(service|microservice|api|system|gateway|layer|app|application|component|database|db|pipeline|engine|cluster|worker|endpoint|module|tool)\b"

#: mentions with the first spelling of their normalised name
_RESOLVED = (
    SQL_MENTIONS
    + rf""",
norms as (select *, {sql_norm("raw_name")} norm from mentions),
known as (select company_name, norm, raw_name known_name, extracted_at k_at, article_id k_id
  from (select *, row_number() over (partition by company_name, norm order by extracted_at, article_id, item) r from norms) where r = 1),
resolved as (
  select norms.*, known_name as "name", case when (k_at, k_id) < (extracted_at, article_id) then 'exact' end "method",
    {sql_slug("company_name")} || '--' || {sql_slug("known_name")} "key"
  from norms join known using (company_name, norm))"""
)

_ENTITIES = (
    _RESOLVED
    + r""",
firsts as (select * from (select *, row_number() over (partition by company_name, "key" order by extracted_at, article_id, item) r from resolved) where r = 1),
descs as (select company_name, "key", description from (
  select *, row_number() over (partition by company_name, "key" order by extracted_at, article_id, item) r from resolved where description <> '') where r = 1),
sizes as (select company_name, "key", count(*) n_mentions from resolved group by all),
entities as (
  select f.company_name, f."key", f."name", f.kind, f."domain", f.article_id first_seen_article_id, d.description, n_mentions
  from firsts f left join descs d using (company_name, "key") join sizes using (company_name, "key"))"""
)


def _fold(edges: str) -> str:
    """CTEs that fold ``edges`` (with "key", source_key): folded, with first_at and first_id."""
    return rf"""
last_of as (select * from (select *, row_number() over (partition by company_name, "key" order by extracted_at desc, article_id desc, item desc) r from {edges}) where r = 1),
first_of as (select * from (select company_name, "key", extracted_at first_at, article_id first_id, row_number() over (partition by company_name, "key" order by extracted_at, article_id, item) r from {edges}) where r = 1),
ids as (select company_name, "key", string_agg(article_id::varchar, ',' order by a, article_id) article_ids
  from (select company_name, "key", article_id, min(extracted_at) a from {edges} group by all) group by all),
folded as (
  select l.company_name, l."key", l.source_key, l.source, l.target, l.relation, l.relation_phrase, l.as_of, article_ids, first_at, first_id
  from last_of l join first_of using (company_name, "key") join ids using (company_name, "key"))"""


def _close(edges: str) -> str:
    return rf"""
closes as (select company_name, source_key, extracted_at c_at, article_id c_id, item c_item, coalesce(nullif(as_of, ''), '{RUN_TS}') closed_at from {edges} where relation = 'replaced_by'),
closed as (
  select f.*, case when relation <> 'replaced_by' then closed_at end invalid_at
  from folded f left join (
    select company_name, "key", closed_at from (
      select f.company_name, f."key", closed_at, row_number() over (partition by f.company_name, f."key" order by c_at, c_id, c_item) r
      from folded f join closes c on f.company_name = c.company_name and f.source_key = c.source_key and (c_at, c_id) >= (first_at, first_id)) where r = 1
  ) using (company_name, "key"))"""


#: the graph with ends named as their entities
_GRAPH = (
    _ENTITIES
    + ",\n"
    + SQL_EDGES.removeprefix(SQL_MENTIONS).lstrip(",\n")
    + rf""",
named as (
  select e.company_name, e.article_id, e.extracted_at, e.item, coalesce(s.known_name, e.source) source, coalesce(t.known_name, e.target) target, e.relation, e.relation_phrase, e.as_of
  from edges e left join known s on s.company_name = e.company_name and s.norm = {sql_norm("e.source")} left join known t on t.company_name = e.company_name and t.norm = {sql_norm("e.target")}),
stated as (select *, {sql_slug("company_name")} || '--' || {sql_slug("source")} || '--' || {sql_slug("relation")} || '--' || {sql_slug("target")} as "key",
  {sql_slug("company_name")} || '--' || {sql_slug("source")} source_key from named),
{_fold("stated")},
{_close("stated")},
nodes as (select company_name, {sql_slug('"name"')} id, "name" as "label", kind, "domain" from entities where kind is distinct from 'team'),
shown as (select company_name, "name" from entities where kind is distinct from 'team'),
gedges as (
  select c.company_name, c."key", {sql_slug("c.source")} source, {sql_slug("c.target")} target, replace(relation, '_', ' ') || case when as_of <> '' then ' (' || as_of || ')' else '' end "label", relation
  from closed c where coalesce(invalid_at, '') = ''
    and exists (select 1 from shown s where s.company_name = c.company_name and s."name" = c.source) and exists (select 1 from shown s where s.company_name = c.company_name and s."name" = c.target))"""
)

_STORED = (
    SQL_LINES
    + rf""",
raw as (select company_name, article_id, extracted_at, line item, supplier_name source, p_type target, raw_relation relation, null::varchar relation_phrase, as_of,
  {sql_slug("company_name")} || '--' || {sql_slug("supplier_name")} || '--' || {sql_slug("raw_relation")} || '--' || {sql_slug("p_type")} as "key", {sql_slug("company_name")} || '--' || {sql_slug("supplier_name")} source_key from lines),
{_fold("raw")},
stored as (select *, case when length("key") % 3 = 0 then '{RUN_TS}' end invalid_at from folded),
canon as (select relation old, {sql_relation("relation")} new_relation from (select distinct relation from stored)),
moved as (
  select s.*, new_relation, relation <> new_relation changed,
    case when relation <> new_relation then {sql_slug("company_name")} || '--' || {sql_slug("source")} || '--' || {sql_slug("new_relation")} || '--' || {sql_slug("target")} else "key" end new_key
  from stored s join canon on relation = old)"""
)

#: similar names scored once for each pair of sorted words; then articles one by one decide which names lead
_RESOLVE = (
    SQL_MENTIONS.replace("lines as", "recursive lines as", 1)
    + rf""",
m as materialized (select *, {sql_norm("raw_name")} norm from mentions),
seen as materialized (
  select company_name, norm, first(raw_name order by extracted_at, article_id, item) known_name, min((extracted_at, article_id)) first_at from m group by all),
sorted as materialized (select norm, list_aggregate(list_sort(list_filter(string_split(norm, ' '), lambda w: w <> '')), 'string_agg', ' ') x from (select distinct norm from seen) where length(norm) >= 5),
xs as (select distinct x from sorted),
close as materialized (
  select a.x, b.x y from xs a join xs b on length(a.x) <= length(b.x) and a.x <> b.x and 200 * length(a.x) >= 92 * (length(a.x) + length(b.x))
    and levenshtein(a.x, b.x) <= 0.08 * (length(a.x) + length(b.x)) + 0.000001),
masks as (
  select x, y, (1::hugeint << length(x)) - 1 full_, list_transform(string_split(y, ''), lambda c:
    list_sum(list_transform(range(1, length(x) + 1), lambda i: case when substring(x, i::int, 1) = c then (1::hugeint << (i - 1)::int) else 0::hugeint end))::hugeint) k from close),
scores as materialized (
  select x, y, 200.0 * (length(x) - bit_count(list_reduce(list_concat([full_], k), lambda st, k: ((st + (st & k)) | (st & (full_ - k))) & full_))) / (length(x) + length(y)) score from masks),
near as materialized (
  select a.norm, b.norm other, score from (select x, y, score from scores union all select y, x, score from scores union all select x, x, 100.0 from xs) p
    join sorted a on a.x = p.x join sorted b on b.x = p.y where score >= 92 and a.norm <> b.norm),
around as (select s.company_name, s.norm, s.first_at, list(n.other) others from seen s join near n using (norm) join seen o on o.company_name = s.company_name and o.norm = n.other group by all),
steps as materialized (
  select company_name, dense_rank() over (partition by company_name order by first_at) k, list((norm, others)) items from around group by company_name, first_at),
go as (
  select company_name, 1::bigint k, []::varchar[] led from (select distinct company_name from steps)
  union all
  select go.company_name, go.k + 1, list_concat(led, list_transform(list_filter(items, lambda i: not list_has_any(i[2], led)), lambda i: i[1])) from go join steps using (company_name, k)),
leaders as materialized (select company_name, unnest(led) norm from (select company_name, arg_max(led, k) led from go group by company_name)
  union all select company_name, norm from seen anti join around using (company_name, norm)),
known as materialized (select seen.* from seen join leaders using (company_name, norm)),
ask as (select distinct m.company_name, m.norm, (m.extracted_at, m.article_id) here from m left join known using (company_name, norm) where first_at is null or first_at >= (m.extracted_at, m.article_id)),
best as (
  select ask.company_name, ask.norm, here, first((k.known_name, score) order by score desc, k.first_at, k.norm) b
  from ask join near using (norm) join known k on k.company_name = ask.company_name and k.norm = near.other where k.first_at < here group by all),
resolved as (
  select m.company_name, m.article_id, m.item, m.raw_name, case when known.first_at < (m.extracted_at, m.article_id) then known.known_name when b is not null then b[1] else coalesce(known.known_name, m.raw_name) end "name",
    case when known.first_at < (m.extracted_at, m.article_id) then 'exact' when b is not null then 'fuzzy:' || round_even(b[2], 0)::int end as "method"
  from m left join known using (company_name, norm) left join best on best.company_name = m.company_name and best.norm = m.norm and best.here = (m.extracted_at, m.article_id))"""
)

_ARTICLE_URL = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) not in ('', '/') and not regexp_matches(url, '/tagged/|/tag/|/category/|/categories/|/author/|/about')"

ORACLE_SQL: dict[str, str] = {
    "q01_url_key": f'with {SQL_ARTICLES} select page_id, "key" from articles',
    "q02_slug": f"select page_id, {sql_slug('url')} slug from pages",
    "q03_entity_key": f"with {SQL_MENTIONS} select distinct company_name, raw_name, {sql_slug('company_name')} || '--' || {sql_slug('raw_name')} \"key\" from mentions",
    "q04_relationship_key": f'with {SQL_EDGES} select distinct "key", relation from keyed',
    "q05_normalized_names": f"select p_partkey, {sql_norm("p_name || '/' || p_brand")} norm from part",
    "q06_is_generic": rf"""select p_partkey, "name", regexp_matches(trim("name"), '{_GENERIC}', 'i') "generic" from (
      select p_partkey, (['The new ', 'legacy ', 'New', '', 'a previous '])[p_partkey % 5 + 1] || p_name || ([' service', ' Relic', ' database cluster', '', ' APIs', ' tool set'])[p_partkey % 6 + 1] as "name" from part)""",
    "q07_labels": "select p_partkey, p_name || ' ' || lower(p_type) || ' x' as \"label\" from part",
    "q08_canonical_relation": f"""select p_partkey, raw, relation, case when trim(raw) <> relation then trim(raw) end phrase from (
      select p_partkey, raw, {sql_relation("raw")} relation from (select p_partkey, ({_PHRASES})[p_partkey % {len(PHRASES)} + 1] || case when p_partkey % 2 = 0 then ' ' || p_name else '' end raw from part))""",
    "q09_fallback_rate": f"""select relation, count(*) n, count(*) filter (raw in ('userland thing', 'frobnicates')) n_fallback from (
      select raw, {sql_relation("raw")} relation from (select ({_PHRASES})[(l_linenumber + l_suppkey) % {len(PHRASES)} + 1] raw from lineitem)) group by relation""",
    "q10_sitemap_entries": f"""with p as (select page_id // 10 n, 'https://maps.example.com/' || (page_id // 10) path, url from pages)
      select path, url, null reason from p where n % 10 not in (3, 5, 7) and {_ARTICLE_URL}
      union all select distinct path, null, case n % 10 when 3 then 'broken XML' when 5 then 'an HTML page, not a sitemap' else 'empty' end from p where n % 10 in (3, 5, 7)""",
    "q11_sitemap_crawl": """with recursive p as (select page_id // 10 n, url from pages),
      r as (select 0::bigint n union select r.n + k from r, (select unnest([1, 2, 3]) k) where r.n % 3 = 0 and exists (select 1 from p where p.n = r.n))
      select 'https://maps.example.com/' || n path, url from p semi join r using (n) where n % 3 <> 0""",
    "q12_stage_filter": "select case page_id % 4 when 0 then 'clean' else 'extract' end stage, page_id from pages where page_id % 4 in (0, 1)",
    "q13_summaries": f'with {SQL_ARTICLES} select "key", source_url, company_name, scraped_at, stage, case when state >= 2 then page_id % 7 + 1 end entity_count from articles',
    "q15_page": f"""with {SQL_ARTICLES}, en as (select *, row_number() over (order by scraped_at desc, "key") r, least(2, greatest(1, ceil(count(*) over () / 20.0))) p from articles where company_name = 'en')
      select "key", page_id, scraped_at from en where r > (p - 1) * 20 and r <= p * 20""",
    "q16_page_count": f"with {SQL_ARTICLES} select company_name, count(*) total, greatest(1, (count(*) + 19) // 20)::bigint n_pages from articles group by company_name",
    "q17_article_count": "select count(*) n from pages",
    "q18_pending_companies": f"with {SQL_ARTICLES} select distinct company_name from articles where state = 2",
    "q19_company_union": f"with {SQL_ARTICLES} select company_name from articles where company_name <> '' union select n_name from nation",
    "q20_recent_jobs": f"with {SQL_JOBS} select event_id, job_id, status, created_at from jobs order by created_at desc, job_id limit 25",
    "q21_article_urls": """select page_id, url from (select page_id, url || (['', '/tag/x', '', '/about-us', ''])[page_id % 5 + 1] url from pages)
      where """ + _ARTICLE_URL,
    "q22_batch_dedup": f'with {SQL_ARTICLES} select "key", min(page_id) page_id from articles group by "key"',
    "q23_new_rows": f'with {SQL_ARTICLES} select "key", min(page_id) page_id from articles where "key" not in (select "key" from articles where page_id % 3 = 0) group by "key"',
    "q24_challenges": "select page_id, url from pages where page_id % 9 <> 0 and not regexp_matches(html, 'Attention Required! \\| Cloudflare|Just a moment\\.\\.\\.|cf-chl')",
    "q25_chunk_entities": f"""with {SQL_MENTIONS} select article_id, name_key, "name", kind, "domain", description from (
      select article_id, lower(trim(raw_name)) name_key, raw_name "name", kind, "domain", description, row_number() over (partition by article_id, lower(trim(raw_name)) order by item % 3, item) r from mentions) where r = 1""",
    "q26_chunk_edges": f"""with {SQL_EDGES} select article_id, source_lc, target_lc, relation, source, target, relation_phrase, as_of from (
      select *, lower(source) source_lc, lower(target) target_lc, row_number() over (partition by article_id, lower(source), lower(target), relation order by item % 3, item) r from edges) where r = 1""",
    "q27_entity_fold": f"with {_ENTITIES} select * from entities",
    "q28_aliases": f"""with {_RESOLVED}, latest as (select * from (
      select *, row_number() over (partition by company_name, "key", raw_name order by extracted_at desc, article_id desc, item desc) r from resolved where raw_name <> "name") where r = 1)
      select company_name, "key", string_agg(raw_name || '=' || coalesce("method", '-'), ';' order by raw_name) aliases from latest group by all""",
    "q29_edge_fold": f'with {SQL_EDGES}, {_fold("keyed")} select company_name, "key", source, target, relation, relation_phrase, as_of, article_ids from folded',
    "q30_close_windows": f'with {SQL_EDGES}, {_fold("keyed")}, {_close("keyed")} select company_name, "key", invalid_at from closed',
    "q31_merge_counters": f"""with {_RESOLVED}, per as (select company_name, article_id, extracted_at, "key", min(item) item from resolved group by all),
      flagged as (select *, row_number() over (partition by company_name, "key" order by extracted_at, article_id, item) = 1 is_new from per),
      rels as (select company_name, article_id, count(*) relationship_count from lines group by all)
      select company_name, article_id, count(*) filter (is_new) new_count, count(*) filter (not is_new) matched_count, 0::bigint llm_count, coalesce(any_value(relationship_count), 0) relationship_count
      from flagged left join rels using (company_name, article_id) group by all""",
    "q32_exact_tier": f'with {_RESOLVED} select company_name, article_id, item, raw_name, "name", "method" from resolved',
    "q33_name_scores": rf"""with pairs as (select distinct p_brand || ' ' || p_name a, split_part(p_name, ' ', -1) || '-' || p_brand || 's' b from part),
      s as (select a, b, list_aggregate(list_sort(list_filter(string_split({sql_norm("a")}, ' '), lambda w: w <> '')), 'string_agg', ' ') x,
        list_aggregate(list_sort(list_filter(string_split({sql_norm("b")}, ' '), lambda w: w <> '')), 'string_agg', ' ') y from pairs),
      m as (select *, (1::hugeint << length(x)) - 1 full_ from s),
      run as (select *, list_reduce(list_concat([full_], list_transform(string_split(y, ''), lambda c:
          list_sum(list_transform(range(1, length(x) + 1), lambda i: case when substring(x, i::int, 1) = c then (1::hugeint << (i - 1)::int) else 0::hugeint end))::hugeint)),
          lambda st, k: ((st + (st & k)) | (st & (full_ - k))) & full_) st from m)
      select a, b, round(case when x = y then 100.0 else 200.0 * (length(x) - bit_count(st)) / (length(x) + length(y)) end, 6)::double score from run""",
    "q34_resolve": f'with {_RESOLVE} select * from resolved',
    "q36_tier_counts": f"""with {_RESOLVE} select company_name, count(*) filter ("method" is null) n_new, count(*) filter ("method" = 'exact') n_exact, count(*) filter ("method" like 'fuzzy%') n_fuzzy from resolved group by company_name""",
    "q37_graph_nodes": f"with {_GRAPH} select * from nodes",
    "q38_graph_edges": f"with {_GRAPH} select * from gedges",
    "q39_graph_bundles": f"""with {_GRAPH},
      own as (select company_name, id, "domain" from (select *, row_number() over (partition by company_name, id order by "label" desc, "domain" desc) r from nodes) where r = 1),
      par as (select company_name, target id, source parent from (select *, row_number() over (partition by company_name, target order by "key" desc, source desc) r from gedges where relation = 'composes') where r = 1),
      at_ as (select o.company_name, o.id, case when o."domain" in ('D1', 'D2') then '__domain__' || o."domain" when parent is not null and coalesce(p."domain", '') not in ('D1', 'D2') then parent else o.id end as "at"
        from own o left join par using (company_name, id) left join own p on p.company_name = o.company_name and p.id = par.parent),
      moved as (select e.company_name, e."key", e."label", s."at" source, t."at" target from gedges e join at_ s on s.company_name = e.company_name and s.id = e.source join at_ t on t.company_name = e.company_name and t.id = e.target)
      select company_name, source, target, count(*) n, (list("label" order by "key"))[1] || case when count(*) > 1 then ' (+' || (count(*) - 1) || ' more)' else '' end as "label" from moved where source <> target group by all""",
    "q40_backfill": f"""with {_STORED},
      l as (select * from (select *, row_number() over (partition by company_name, new_key order by changed desc, "key" desc) r from moved) where r = 1),
      ex as (select company_name, new_key, changed, "key" k, unnest(string_split(article_ids, ',')) id, generate_subscripts(string_split(article_ids, ','), 1) pos from moved),
      ranked as (select *, row_number() over (partition by company_name, new_key order by changed, k, pos) o from ex),
      uni as (select company_name, new_key, id, min(o) o from ranked group by all),
      ids2 as (select company_name, new_key, string_agg(id, ',' order by o) article_ids from uni group by all),
      inv as (select company_name, new_key, max(invalid_at) filter (new_key = "key") invalid_at from moved group by all)
      select l.company_name, l.new_key as "key", source, target, new_relation relation, case when changed then relation else relation_phrase end relation_phrase, as_of, inv.invalid_at, ids2.article_ids
      from l join ids2 using (company_name, new_key) join inv using (company_name, new_key)""",
    "q40_backfill_counters": f"""with {_STORED}, w as (
      select *, row_number() over (partition by company_name, new_key order by changed, "key") > 1 later, exists (select 1 from stored s where s.company_name = moved.company_name and s."key" = moved.new_key) and new_key <> "key" taken from moved)
      select company_name, count(*) examined, count(*) filter (changed) rewritten, count(*) filter (changed and (taken or later)) collapsed from w group by company_name""",
    "q41_chunk_count": r"""select doc_id, n_tokens, case when n_tokens <= 200 then 1 else 1 + ((n_tokens - 200 + 179) // 180) end::bigint n_chunks from (
      select doc_id, len(regexp_extract_all(text, '\s*\S+|\s+'))::int n_tokens from documents)""",
    "q42_chunks": r"""select doc_id, chunk, chunk * 180 first_token, len(t[chunk * 180 + 1 : chunk * 180 + 200])::int n_tokens, length(array_to_string(t[chunk * 180 + 1 : chunk * 180 + 200], ''))::int n_chars from (
      select doc_id, t, unnest(range(0, case when len(t) <= 200 then 1 else 1 + ((len(t) - 200 + 179) // 180) end)) chunk from (select doc_id, regexp_extract_all(text, '\s*\S+|\s+') t from documents))""",
    "q43_cleaned_pages": r"""with pieces as (
        select page_id, list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'), lambda x: regexp_replace(
          replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '^\s+|\s+$', '', 'g')) p from pages)
      select page_id, regexp_replace(regexp_replace(array_to_string(list_filter(p, lambda x: x <> ''), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') "text" from pieces""",
    "q44_reachable": f"""with {SQL_EDGES}, e as (select distinct company_name, {sql_slug("source")} s, {sql_slug("target")} t from edges where relation in ('replaced_by', 'composes')),
      one as (select company_name, s "start", t id, 1 hops from e), two as (select distinct one.company_name, "start", t id, 2 hops from one join e on one.company_name = e.company_name and id = s),
      three as (select distinct two.company_name, "start", t id, 3 hops from two join e on two.company_name = e.company_name and id = s)
      select company_name, "start", id, min(hops) hops from (select * from one union all select * from two union all select * from three) group by all""",
    "q45_listing": f"""with {_GRAPH} select company_name, 0 part, '[' || kind || '] ' || "name" || ' (' || "domain" || ')' line from entities
      union all select company_name, 1, source || ' --' || relation || '--> ' || target || case when as_of <> '' then ' (as_of=' || as_of || ')' else '' end from closed""",
    "q46_job_recovery": f"""with {SQL_JOBS}, l as (select * from (select *, row_number() over (partition by job_id order by created_at desc, status desc) r from jobs) where r = 1)
      select job_id, case when status in ('done', 'error') then status else 'error' end status, case when status not in ('done', 'error') then 'interrupted' end "error", created_at from l""",
    "q47_job_retention": f"""with {SQL_JOBS}, l as (select * from (select *, row_number() over (partition by job_id order by created_at desc, status desc) r from jobs) where r = 1),
      f as (select job_id, row_number() over (order by created_at, job_id) k from l where status in ('done', 'error'))
      select job_id, status, created_at from l where job_id not in (select job_id from f where k <= (select count(*) - 30 from l))""",
    "q48_components": f"with {_GRAPH} select company_name, source id, count(*) components from gedges where relation = 'composes' group by all",
    "q49_domain_groups": f"""with {_GRAPH} select company_name, "domain", count(*) members from nodes where "domain" in ('D1', 'D3') group by all""",
    "q50_reply_checks": f"""with {SQL_MENTIONS},
      ents as (select article_id, count(*) n, count(*) filter (item % 97 = 0) robots, count(*) filter (item % 97 <> 0 and kind = 'service') services from mentions group by article_id),
      rels as (select article_id, count(*) r, count(as_of) dated from lines group by article_id),
      checked as (select *, not (article_id % 3 <> 0 and article_id % 7 = 0) and (robots = 0 or article_id % 19 = 0) and article_id % 17 <> 0 and not (article_id % 11 = 0 and article_id % 13 <> 0 and dated > 0) ok from ents join rels using (article_id))
      select article_id, ok as "valid", case when ok then n end n_entities, case when ok then case when article_id % 19 = 0 then n else services end end n_services,
        case when ok then case when article_id % 13 = 0 then 0 else r end end n_relationships
      from checked""",
    "q51_incremental_edges": f"""with {SQL_EDGES}, {_fold("keyed")}, {_close("keyed")}
      select company_name, "key", source, target, relation, relation_phrase, as_of, invalid_at, article_ids from closed""",
    "q52_incremental_entities": f"""with {_ENTITIES}, other as (select distinct company_name, "key", raw_name from resolved where raw_name <> "name"),
      al as (select company_name, "key", string_agg(raw_name, ';' order by raw_name) aliases from other group by all)
      select e.*, coalesce(aliases, '') aliases from entities e left join al using (company_name, "key")""",
    "q53_stream_names": f"""with m as (select p_type company_name, p_partkey // 3 article_id, p_partkey::bigint item,
        case when p_partkey % 2 = 0 then upper(p_name) when p_partkey % 7 = 0 then 'the new ' || split_part(p_name, ' ', 1) || ' service' when p_partkey % 11 = 0 then '..' else p_name end raw_name from part),
      n as (select *, {sql_norm("raw_name")} norm, regexp_matches(trim(raw_name), '{_GENERIC}', 'i') generic from m),
      r as (select *, first_value(raw_name) over w f, min(article_id) over w a from n window w as (partition by company_name, norm order by article_id, item, raw_name))
      select company_name, article_id::bigint article_id, item, raw_name, case when generic or norm = '' then raw_name else f end "name", case when not generic and norm <> '' and a < article_id then 'exact' end as "method" from r""",
    "q54_graph_json": f"""with {_GRAPH},
      n as (select company_name, string_agg(to_json({{'id': id, 'label': "label", 'kind': kind, 'domain': "domain"}})::varchar, ',' order by "label", id, kind, "domain") js from nodes group by company_name),
      numbered as (select *, row_number() over (partition by company_name order by "key", source, target, "label", relation) - 1 i from gedges),
      e as (select company_name, string_agg(to_json({{'id': '__edge_' || i, 'source': source, 'target': target, 'label': "label", 'relation': relation}})::varchar, ',' order by i) js from numbered group by company_name)
      select company_name, '{{"nodes":[' || n.js || '],"edges":[' || coalesce(e.js, '') || ']}}' as "graph" from n left join e using (company_name)""",
    "q55_stream_resolve": f'with {_RESOLVE} select * from resolved',
    "q56_repaired_replies": f"""with {SQL_MENTIONS}, r as (select *, row_number() over (partition by article_id order by item desc) back from mentions)
      select article_id, true "valid", count(*) filter (back > 1 or article_id % 8 <> 2) n_entities, coalesce(string_agg(raw_name, '|' order by item) filter (back > 1 or article_id % 8 <> 2), '') "names" from r group by article_id""",
    "q58_article_marks": f"""with {SQL_ARTICLES},
      a as (select *, state = 0 and min(page_id) filter (state = 0) over (partition by "key") = page_id and page_id % 3 = 0 own from articles),
      b as (select *, bool_or(own) over (partition by "key") c, bool_or(state = 2 and page_id % 5 = 0) over (partition by "key") m from a),
      d as (select *, case when c then 'text of ' || "key" end cleaned, case when m then '{RUN_TS}' when state = 3 then scraped_at end graph_merged_at from b)
      select page_id, state = 0 and not c has_html, cleaned, graph_merged_at,
        case when graph_merged_at is not null then 'merged' when state >= 2 then 'extracted' when state = 1 or c then 'cleaned' else 'scraped' end stage from d""",
    "q59_method_texts": """select l_orderkey, l_linenumber, ((l_quantity * 2 + l_linenumber) / 2)::double score, 'fuzzy:' || round_even((l_quantity * 2 + l_linenumber) / 2, 0)::int as "method",
      strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') short from lineitem""",
    "q60_attributes": r"""select page_id, replace(replace(replace(replace(replace(to_json({'url': url, 'title': regexp_extract(html, '(?s)<title>(.*?)</title>', 1)})::varchar,
      '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as "attribute" from pages""",
    "q61_reviewed_relations": f"""with {SQL_LINES}, w as (select distinct raw_relation r, {sql_relation("raw_relation")} rel from lines)
      select article_id, line item, case r when 'frobnicates' then 'calls' else rel end relation, case when trim(r) <> rel then trim(r) end relation_phrase, false needs_review from lines join w on raw_relation = r""",
    "q62_settled_names": f"""with {_RESOLVED} select company_name, article_id, item, raw_name, case when "method" is null then trim(lower(company_name || ' ' || raw_name)) else "name" end "name",
      coalesce("method", 'llm') as "method" from resolved""",
    "q63_code_blocks": r"""with d as (select doc_id, coalesce("text", '') t, length(coalesce("text", '')) - length(replace(coalesce("text", ''), chr(10), '')) + 1 n from documents),
      c as (select *, 'Before' || chr(10) || case when n > 15 then '[code omitted: ' || n || ' lines, language: sql]' || chr(10) else case when regexp_replace(t, '^\s+|\s+$', '', 'g') = '' then '' else regexp_replace(t, '^\s+|\s+$', '', 'g') || chr(10) end end || 'after' x from d)
      select doc_id, md5(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) digest, n > 15 omitted from c""",
    "q64_resolve_known": f"""with {_RESOLVE},
      fixed as (select company_name, norm, min(raw_name) filter (r = 1) known_name from (
        select *, row_number() over (partition by company_name, norm order by extracted_at, article_id, item) r from m where extracted_at < timestamp '{SECOND_RUN}') group by all),
      late as (select distinct company_name, raw_name, norm from m where extracted_at >= timestamp '{SECOND_RUN}'),
      liked as (select a.company_name, a.norm, first((f.known_name, score) order by score desc, f.norm) b
        from (select distinct company_name, norm from late) a join near using (norm) join fixed f on f.company_name = a.company_name and f.norm = near.other group by all)
      select l.company_name, l.raw_name, coalesce(f.known_name, b[1]) "name", case when f.known_name is not null then 'exact' when b is not null then 'fuzzy:' || round_even(b[2], 0)::int end as "method"
      from late l left join fixed f using (company_name, norm) left join liked using (company_name, norm)""",
    "q65_limits": f"""with {SQL_ARTICLES}
      select 'merge' part, page_id from (select *, row_number() over (partition by company_name order by scraped_at, "key") r from articles where state = 2) where r <= 3
      union all select 'scrape', page_id from (select min(page_id) page_id from articles where "key" not in (select "key" from articles where page_id % 3 = 0) group by "key" order by 1 limit 50)""",
}
