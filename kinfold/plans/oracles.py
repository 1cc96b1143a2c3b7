"""DuckDB statements for the linkage queries, written apart from the Spark expressions (RE2 has no look-around)."""

from __future__ import annotations

from ..functions.features import ADDRESS_KEY_STOP_WORDS, ADDRESS_STOP_WORDS, NAME_STOP_WORDS
from ..functions.normalize import ADDRESS_WORDS
from ..sources.tables import NA_WORDS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def normal(c: str) -> str:
    folded = f"lower(replace(replace(replace(strip_accents(coalesce({c}, '')), '&', ' and '), 'ß', 'ss'), 'ẞ', 'SS'))"
    words = rf"string_split(trim(regexp_replace(regexp_replace({folded}, '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return rf"array_to_string(list_transform({words}, lambda x: regexp_replace(x, '^0+(\d+)$', '\1')), ' ')"


def name(c: str) -> str:
    c = normal(c)
    for old, new in (("corporation", "corp"), ("company", "co"), ("private", "pvt"), ("limited", "ltd"), ("incorporated", "inc")):
        c = rf"regexp_replace({c}, '\b{old}\b', '{new}', 'g')"
    c = rf"regexp_replace({c}, '\b sociedades? anonimas?\b', 'sa', 'g')"
    c = rf"regexp_replace({c}, '\bgesellschaft mit beschrankter haftung\b', 'gmbh', 'g')"
    return rf"regexp_replace({c}, '\bsociete a responsabilite limitee\b', 'sarl', 'g')"


def address(c: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in ADDRESS_WORDS.items())
    return f"array_to_string(list_transform(string_split({normal(c)}, ' '), lambda x: case x {cases} else x end), ' ')"


def soundex(c: str) -> str:
    s = f"regexp_replace({c}, '[^a-z]', '', 'g')"
    codes = "translate({0}, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    digits = f"concat({codes.format(f'{s}[1]')}, {codes.format(f"regexp_replace({s}[2:], '[hw]', '', 'g')")})"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"case when {s} = '' then '' else concat(upper({s}[1]), rpad(replace(({digits})[2:], '0', '')[1:3], 3, '0')) end"


def sorted_tokens(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


_PREFIX = "case when {0} % 5 = 0 then 'S1-' when {0} % 5 <= 2 then 'S2-' else 'S3-' end || lpad(cast({0} as varchar), 8, '0')"
BIZ = rf"""
words as (select *, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') as w from documents),
biz as (
  select {_PREFIX.format("doc_id")} as entity_id, array_to_string(w[1:4], ' ') as business_name,
    array_to_string(w[greatest(1, len(w) - 5):], ' ') as business_address, upper(lang) as country from words
)"""
NORM = f"""{BIZ},
norm0 as (select *, {name("business_name")} as normalized_name, {address("business_address")} as normalized_address from biz),
norm as (select *, {soundex("normalized_name")} as phonetic_key, {sorted_tokens("normalized_name")} as sorted_token_key from norm0)"""
PARTS = f"""
parts0 as (select {_PREFIX.format("p_partkey")} as entity_id, {name("p_name")} as normalized_name, {address("p_type")} as normalized_address, p_brand as country from part),
norm as (select *, {soundex("normalized_name")} as phonetic_key, {sorted_tokens("normalized_name")} as sorted_token_key from parts0)"""

_CLEAN = r"list_transform(list_filter(string_split({0}, ' '), lambda t: t <> ''), lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '', 'g'))"


def significant(c: str, n: int) -> str:
    clean = _CLEAN.format(c)
    kept = f"list_filter({clean}, lambda t: length(t) >= 3 and not list_contains({_list(NAME_STOP_WORDS)}, t))"
    other = f"coalesce(({clean})[1], '')" if n == 1 else "''"
    return f"coalesce(({kept})[{n}], {other})"


def skeleton(c: str) -> str:
    s = rf"regexp_replace(regexp_replace({c}, '[^\p{{L}}]', '', 'g'), '[aeiou]', '', 'g')"
    each = f"list_filter(range(1, length({s}) + 1), lambda i: i = 1 or ({s})[i] <> ({s})[i - 1])"
    return f"array_to_string(list_transform({each}, lambda i: ({s})[i]), '')[1:6]"


def tokens(c: str, stop) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 3 and not list_contains({_list(stop)}, t))))"


def key(*parts: str) -> str:
    return " || '|' || ".join(parts)


_N, _A, _C = "normalized_name", "normalized_address", "trim(country)"
#: Key expression, bound for a cap of 10,000, and whether it has several values.
FAMILIES = {
    "phon_pref3": (key("phonetic_key", f"{_N}[1:3]"), 500, False),
    "sorted_token": ("sorted_token_key", 500, False),
    "country_word1": (key(_C, significant(_N, 1)), 30, False),
    "country_word2": (key(_C, significant(_N, 2)), 20, False),
    "addr4_name3": (key(_C, f"{_A}[1:4]", f"{_N}[1:3]"), 25, False),
    "country_phon": (key(_C, "phonetic_key"), 20, False),
    "addr6": (key(_C, f"{_A}[1:6]"), 500, False),
    "addr_tokens": (tokens(_A, ADDRESS_STOP_WORDS), 10_000, True),
    "skeleton": (key(_C, skeleton(_N)), 500, False),
}
#: Families whose bound does not follow the candidate cap.
FIXED = ("country_word1", "country_word2", "addr4_name3", "country_phon", "addr_tokens")
VALID = "k not in ('', 'nan') and len(list_filter(string_split(k, '|'), lambda p: trim(p) in ('', 'nan'))) = 0"


def hits(families: list[str], cap: int = 10_000, base: str = NORM, order: str = "md5(entity_id || '|' || k)", country: str | None = None) -> str:
    """CTEs that end in hits (s1_id, cand_id)."""
    src = "norm" if country is None else f"(select * replace ('{country}' as country) from norm)"
    keys, cut = [], []
    for f in families:
        expr, bound, multi = FAMILIES[f]
        rows = f"select entity_id, '{f}' as f, trim({f'unnest({expr})' if multi else expr}) as k from {src}"
        keys.append(f"select * from ({rows})" + ("" if multi else f" where {VALID}"))
        cut.append(f"when '{f}' then {bound if f in FIXED else min(bound, cap)}")
    return f"""with {base},
keys as ({" union all ".join(keys)}),
posted as (
  select * from (select *, row_number() over (partition by f, k order by {order}, entity_id) as n from keys where entity_id not like 'S1-%')
  where n <= case f {" ".join(cut)} end
),
hits as (select a.entity_id as s1_id, p.entity_id as cand_id from keys a join posted p using (f, k) where a.entity_id like 'S1-%')"""


ALL = list(FAMILIES)
VOTES = "votes as (select s1_id, cand_id, count(*) as votes from hits group by 1, 2)"
RANKED = f"""{hits(ALL, 100)}, {VOTES},
ranked as (select * from (select *, cast(row_number() over (partition by s1_id order by votes desc, cand_id) as integer) as rnk from votes) where rnk <= 100)"""
TRUTH = f"""
ids as (select {_PREFIX.format("doc_id")} as id, text from documents),
truth as (
  select a.id as source1_entity_id, coalesce(string_agg(b.id, ',' order by b.id), '') as matched_entity_ids
  from (select * from ids where id like 'S1-%') a left join (select * from ids where id not like 'S1-%') b using (text) group by 1
),
pairs as (select source1_entity_id as s1_id, unnest(string_split(matched_entity_ids, ',')) as true_id from truth where matched_entity_ids <> '')"""
_S1 = "(select entity_id as s1_id from norm where entity_id like 'S1-%')"
_POOL = "(select count(*) from norm where entity_id not like 'S1-%')"
MISSED = f"{hits(['country_phon'])}, {TRUTH}, missed as (select * from pairs p where not exists (from hits h where h.s1_id = p.s1_id and h.cand_id = p.true_id))"
F05 = f"""{hits(["sorted_token"])}, {TRUTH},
found as (select distinct s1_id, cand_id as true_id from hits),
counts as (
  select s1_id, (select count(*) from found f where f.s1_id = s.s1_id) as np, (select count(*) from pairs p where p.s1_id = s.s1_id) as nt,
    (select count(*) from found f join pairs p using (s1_id, true_id) where f.s1_id = s.s1_id) as tp from {_S1} s
),
pr as (select *, case when np > 0 then tp / np else 0.0::double end as p, case when nt > 0 then tp / nt else 0.0::double end as r from counts),
scored as (
  select s1_id, p, r, case when nt = 0 then case when np = 0 then 1.0::double else 0.0 end when tp = 0 then 0.0 else 1.25 * p * r / (0.25 * p + r) end as f05 from pr
)"""
GRAMS = r"flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, length(w) + 4 - n), lambda i: (' ' || w || ' ')[i : i + n - 1])))))"
WEAK = f"""{RANKED},
weak as (select s.s1_id, count(r.cand_id) as n_candidates from {_S1} s left join ranked r using (s1_id) group by 1 having count(r.cand_id) < 100)"""
NEAR = f"""{WEAK},
theirs as (select entity_id as id, trim(country) as c, normalized_name || ' ' || normalized_address as t from norm where entity_id not like 'S1-%'),
ours as (select entity_id as id, trim(country) as c, normalized_name || ' ' || normalized_address as t from norm where entity_id in (select s1_id from weak)),
g2 as (select id, c, g, count(*) as tf from (select id, c, unnest({GRAMS.format("t")}) as g from theirs) group by all),
g1 as (select id, c, g, count(*) as tf from (select id, c, unnest({GRAMS.format("t")}) as g from ours) group by all),
sizes as (select c, count(*) as n from theirs group by 1),
idf as (select c, g, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf from g2 join sizes using (c) group by 1, 2),
w2 as (select id, c, g, tf * idf as w, sqrt(sum(tf * idf * tf * idf) over (partition by id)) as l from g2 join idf using (c, g)),
w1 as (select id, c, g, tf * idf as w, sqrt(sum(tf * idf * tf * idf) over (partition by id)) as l from g1 join idf using (c, g)),
sim as (select a.id as s1_id, b.id as cand_id, round(sum((a.w / a.l) * (b.w / b.l)), 6) as similarity from w1 a join w2 b using (c, g) group by 1, 2),
near as (select * from (select *, row_number() over (partition by s1_id order by similarity desc, cand_id) as n from sim) where n <= 15)"""
LINES = """
l0 as (select doc_id as line, 'S1-' || lpad(cast(doc_id as varchar), 8, '0') as own, 'S2-' || lpad(cast(doc_id + 1 as varchar), 8, '0') as s2,
  'S3-' || lpad(cast(doc_id + 3 as varchar), 8, '0') as s3 from documents where doc_id % 5 = 0),
lines as (select line, case line % 35 when 5 then own || ' ' || s2 when 10 then own || chr(9) || s2 || ',' || s2 when 15 then own || chr(9) || s2 || ', ' || s3
  when 20 then own || chr(9) || own || ',' || s3 when 25 then 'S1-99' || lpad(cast(line % 3 as varchar), 6, '0') || chr(9) || s2
  when 30 then own || chr(9) else own || chr(9) || s2 || ',' || s3 end as value from l0),
rows_ as (select line, string_split(value, chr(9))[1] as id, case when string_split(value, chr(9))[2] = '' then [] else string_split(string_split(value, chr(9))[2], ',') end as l
  from lines where contains(value, chr(9))),
m as (select id, unnest(l) as member from rows_),
required as (select entity_id as id from biz where entity_id like 'S1-%'),
valid as (select entity_id as member from biz where entity_id not like 'S1-%')"""
_CHECKS = {
    "dups": """select 'duplicate_row' as "check", 'error' as severity, id as line_id, cast(count(*) as varchar) as detail from rows_ group by id having count(*) > 1
union all select 'repeated_id', 'error', id, cast(len(l) - len(list_distinct(l)) as varchar) from rows_ where len(l) <> len(list_distinct(l))
union all select 'no_tab', 'error', value, value from lines where not contains(value, chr(9))""",
    "prefix": """select 'own_source_id' as "check", 'error' as severity, id as line_id, member as detail from m where member like 'S1-%'
union all select 'bad_prefix', 'error', id, member from m where not regexp_matches(member, '^S[123]-')""",
    "unknown": """select 'unknown_id' as "check", 'error' as severity, id as line_id, member as detail from m
where regexp_matches(member, '^S[23]-') and member not in (from valid)""",
    "missing_extra": """select 'missing_row' as "check", 'error' as severity, id as line_id, id as detail from required where id not in (select id from rows_)
union all select distinct 'extra_row', 'error', id, id from rows_ where id not in (from required)""",
    "subset": """select 'outside_candidates' as "check", 'warning' as severity, id as line_id, out as detail from (
  select a.id, array_to_string(list_sort(list_filter(list_distinct(a.l), lambda x: not list_contains(coalesce(c.l, []), x))), ',') as out
  from (select id, arg_max(l, line) as l from rows_ group by id) a left join (select id, arg_max(l, line) as l from rows_ where line % 2 = 0 group by id) c using (id)) where out <> ''""",
}


def _select(columns: str) -> str:
    return f"with {NORM} select entity_id, {columns} from norm"


def _part(column: str, of: str) -> str:
    return f"with p as (select p_partkey, {name('p_name')} as n from part) select p_partkey, {column} as {of} from p"


def _check(which: str) -> str:
    return f"with {BIZ}, {LINES} {_CHECKS[which]}"


ORACLES = {
    "normalize_text_documents": f"select doc_id, {normal('text')} as normal from documents",
    "normalize_name_docs": _select(_N),
    "normalize_name_customer": f"select c_custkey, {name('c_name')} as name from customer",
    "normalize_address_docs": _select(_A),
    "normalize_records": _select("business_name, normalized_name, business_address, normalized_address, phonetic_key, sorted_token_key, country"),
    "phonetic_key_part": _part(soundex("n"), "phonetic_key"),
    "sorted_token_key_part": _part(sorted_tokens("n"), "sorted_token_key"),
    "prefixes_docs": _select(f"{_N}[1:3] as name3, {_A}[1:4] as addr4, {_A}[1:6] as addr6, lower({_N}[1]) as bucket"),
    "significant_words_docs": _select(f"{significant(_N, 1)} as w1, {significant(_N, 2)} as w2"),
    "consonant_skeleton_part": _part(skeleton("n"), "skeleton"),
    "address_tokens_docs": _select(f"array_to_string({tokens(_A, ADDRESS_STOP_WORDS)}, ',') as tokens"),
    "address_token_set_key_docs": _select(f"array_to_string({tokens(_A, ADDRESS_KEY_STOP_WORDS)}, '_') as key"),
    "key_validity": f"select entity_id, k as key, {VALID} as valid from ({_select(key(_C, significant(_N, 2)) + ' as k')})",
    "char_ngrams_docs": f"with {NORM}, g as (select entity_id, unnest({GRAMS.format(_N)}) as gram from norm) select gram, count(*) as n, count(distinct entity_id) as df from g group by 1",
    **{f"block_{f}": f"{hits([f])}, {VOTES} select * from votes" for f in FAMILIES},
    "block_parts_bounded": f"{hits(['sorted_token', 'country_word1', 'country_word2', 'country_phon'], base=PARTS)}, {VOTES} select * from votes",
    "block_parts_ordinal": f"{hits(['country_word1', 'country_phon'], base=PARTS, order='entity_id')}, {VOTES} select * from votes",
    "unseen_label": f"{hits(['sorted_token', 'addr6', 'skeleton'], 1000, country='TEST_UNSEEN_COUNTRY')}, {VOTES} select * from votes",
    "votes_union": f"{hits(ALL)}, {VOTES} select * from votes",
    "ranked_capped": f"{RANKED} select * from ranked",
    "weak_coverage": f"{WEAK} select * from weak",
    "tfidf_topk": f"{NEAR} select s1_id, cand_id, similarity from near",
    "fallback_merge": f"""{NEAR},
both_ as (select s1_id, cand_id, votes, 0 as stage, rnk as n from ranked union all select s1_id, cand_id, 0, 1, 0 from near anti join ranked using (s1_id, cand_id))
select s1_id, cand_id, votes, stage, rnk from (
  select s1_id, cand_id, votes, stage, cast(row_number() over (partition by s1_id order by stage, n, cand_id) as integer) as rnk from both_) where rnk <= 100""",
    "candidate_lists": f"{RANKED} select s.s1_id as source1_entity_id, coalesce(string_agg(cand_id, ',' order by rnk), '') as candidate_entity_ids from {_S1} s left join ranked using (s1_id) group by 1",
    "coverage_report": f"""{RANKED}, each_ as (select s.s1_id, count(cand_id) as n from {_S1} s left join ranked using (s1_id) group by 1)
select count(*) as n_records, cast(sum(n) as bigint) as n_candidates, count(*) filter (n > 0) as n_nonempty, count(*) filter (n = 0) as n_empty, max(n) as most, round(avg(n), 6) as mean from each_""",
    "eval_recall": f"""{RANKED}, {TRUTH},
each_ as (select t.source1_entity_id as s1_id, count(cand_id) as n from truth t left join ranked r on r.s1_id = t.source1_entity_id group by 1),
h as (select count(*) as true_pairs, count(r.cand_id) as captured from pairs p left join ranked r on r.s1_id = p.s1_id and r.cand_id = p.true_id),
v as (select count(*) as n_evaluated, cast(sum(n) as bigint) as total_candidates, avg(n) as a, max(n) as max_candidates, count(*) filter (n = 0) as zero_candidates from each_)
select true_pairs, captured, n_evaluated, total_candidates, round(a, 9) as avg_candidates, max_candidates, zero_candidates, true_pairs - captured as missed,
  round(coalesce(captured / nullif(true_pairs, 0), 0), 9) as candidate_recall,
  round(total_candidates / ((select count(*) from {_S1}) * {_POOL}), 9) as reduction_ratio from h, v""",
    "missed_pairs": f"{MISSED} select * from missed",
    "missed_pair_detail": f"""{MISSED} select s1_id, true_id, coalesce(a.normalized_name, 'N/A') as s1_normalized_name, coalesce(a.normalized_address, 'N/A') as s1_normalized_address,
  coalesce(a.country, 'N/A') as s1_country, coalesce(b.normalized_name, 'N/A') as true_normalized_name, coalesce(b.normalized_address, 'N/A') as true_normalized_address,
  coalesce(b.country, 'N/A') as true_country from missed left join norm a on a.entity_id = s1_id left join norm b on b.entity_id = true_id""",
    "reduction_ratio": f"""{hits(ALL)}, {VOTES}, t as (select count(*) as total_candidates, (select count(*) from {_S1}) as n_s1, {_POOL} as n_pool from votes)
select *, round(total_candidates / (n_s1 * n_pool), 9) as reduction_ratio from t""",
    "f05_records": f"{F05} select s1_id, round(p, 6) as precision, round(r, 6) as recall, round(f05, 6) as f05 from scored",
    "f05_macro": f"{F05} select round(avg(f05), 6) as macro_f05, count(*) as n_records from scored",
    "profile_shape": "select count(*) as n_rows, 5::bigint as n_columns, 'doc_id,text,lang,source,n_chars' as columns from documents",
    "profile_missing": " union all ".join(
        f"select '{c}' as \"column\", round(avg(case when {c} is null then 1 else 0 end) * 100, 6) as missing_pct from events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
    "profile_distinct": f"with {BIZ} "
    + " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from biz" for c in ("entity_id", "business_name", "business_address", "country")),
    "profile_value_counts": f"with {BIZ} select country as value, count(*) as n from biz group by 1",
    "profile_duplicates": f"with {BIZ}, g as (select count(*) as n from biz group by business_name, business_address, country) select cast(sum(n) as bigint) as n_rows, count(*) as n_distinct, cast(sum(n) as bigint) - count(*) as n_duplicates from g",
    "match_count_hist": f"with {TRUTH} select case when matched_entity_ids = '' then 0 else len(string_split(matched_entity_ids, ',')) end as n_matches, count(*) as n from truth group by 1",
    "singleton_pct": f"with {TRUTH} select round(avg(case when matched_entity_ids = '' then 1 else 0 end) * 100, 6) as singleton_pct from truth",
    "seeded_sample": f"with {BIZ} select * from biz order by md5('42|' || entity_id), entity_id limit 200",
    "first_rows": f"with {BIZ} select * from biz order by entity_id limit 200",
    "lookup_rows": f"with {BIZ}, {TRUTH} select * from biz where entity_id in (select true_id from pairs)",
    **{f"validate_{k}": _check(k) for k in _CHECKS},
    "validate_counts": f"with {BIZ}, {LINES} select count(*) as n_rows, count(*) filter (len(l) = 0) as n_empty, count(*) filter (len(l) > 0) as n_nonempty from rows_",
    "validate_summary": f"""with {BIZ}, {LINES}, found as ({" union all ".join(f"({_CHECKS[k]})" for k in ("dups", "prefix", "unknown", "missing_extra"))})
select a."check", a.severity, total, sample from (select "check", severity, count(*) as total from found group by all) a join (
  select "check", severity, string_agg(line_id, ',' order by line_id) as sample
  from (select *, row_number() over (partition by "check", severity order by line_id, detail) as n from found) where n <= 5 group by all) b using ("check", severity)""",
}


def full(query: str) -> str:
    """The statement of a query with the cap and neighbours of full runs."""
    sql = ORACLES[query].replace(hits(ALL, 100), hits(ALL, 10_000))
    return sql.replace("rnk <= 100", "rnk <= 10000").replace("where n <= 15)", "where n <= 300)")


ORACLES |= {f"{q}_full": full(q) for q in ("weak_coverage", "tfidf_topk", "candidate_lists", "coverage_report", "eval_recall")}
ORACLES |= {"ranked_full": full("ranked_capped"), "candidates_full": full("fallback_merge")}


_NA = ", ".join("'" + w + "'" for w in NA_WORDS)
_BLANK = "case when {0} is null or {0} in (" + _NA + ") then '' else {0} end as {0}"
_BUCKET = """trim(country) || '|' || case when (select count(*) from norm z where z.entity_id not like 'S1-%' and trim(z.country) = trim(norm.country)) > 10
  then lower(normalized_name[1]) else '*' end as c"""
ORACLES |= {
    "records_round_trip": f"with {BIZ} select " + ", ".join(_BLANK.format(c) for c in ("entity_id", "business_name", "business_address", "country")) + " from biz",
    "projected_round_trip": f"with {BIZ} select entity_id, {_BLANK.format('country')} from biz",
    "match_targets": f"with {BIZ} select entity_id from biz where entity_id not like 'S1-%'",
    "id_list_round_trip": f"with {BIZ}, {TRUTH} select source1_entity_id as id, matched_entity_ids as ids from truth",
    "validate_unknown_ids": _check("unknown").replace("where entity_id not like 'S1-%')", "where entity_id not like 'S1-%' and cast(entity_id[4:] as bigint) % 7 <> 3)"),
    "tfidf_buckets": ORACLES["tfidf_topk"].replace("trim(country) as c", _BUCKET),
}
