"""The same in SQL for DuckDB, where SQL can say it."""

from tallyweave.llm import places

TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
VOTER = TRIM.format("voterId")
KEYS = f"""
keys as (
  select 'vote_cast' tbl, arrival_seq, case when {VOTER} <> '' then {VOTER} end k from vote_cast
  union all select 'rejected', arrival_seq, originalReceipt from rejected),
ranked as (select *, case when k is not null then row_number() over (partition by tbl, k order by arrival_seq) end i from keys)
"""



def clean(c: str) -> str:
    """A typed name in one spelling."""
    t = f"regexp_replace({TRIM.format(c)}, '{places.ENTITY}', '\\1', 'g')"
    for bad, good in places.MOJIBAKE.items():
        t = f"replace({t}, 'Ã{bad}', '{good}')"
    t = f"translate(lower({t}), '{places.ACCENTED}{places.DIGITS}', '{places.PLAIN}{places.LOOKALIKE}')"
    t = rf"regexp_replace({t}, '[\x{{0300}}-\x{{036f}}\x{{200b}}-\x{{200d}}\x{{feff}}''\x{{2019}}]', '', 'g')"
    return f"regexp_replace(trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')), '{places.OFFICE}', '')"


def letter_pairs(name: str) -> str:
    text = f"('^' || replace({name}, ' ', '') || '$')"
    return f"list_distinct(list_transform(range(1, greatest(length({text}) - 1, 1) + 1), lambda i: substr({text}, i, 2)))"


def edits(a: str, b: str) -> str:
    return f"levenshtein({a}, {b}) / cast(greatest(length({a}), length({b})) as double)"


#: Typed places against every entry of their scope, without prefixes and filters.
PLACES = f"""
listed as (select *, {letter_pairs('name')} bits from (select mun_code, upper({TRIM.format('uf')}) uf, {clean('municipio')} name, coalesce(peso, 0) peso from municipios) where name <> ''),
codes as (select list(uf order by uf) known from (select distinct uf from listed where uf is not null)),
inexact as (select arrival_seq, coalesce(state, '') state, city from vote_cast v where coalesce({TRIM.format('city')}, '') <> ''
  and not exists (select 1 from municipios m where m.uf = upper({TRIM.format('v.state')}) and m.municipio = {TRIM.format('v.city')})),
spelt as (select *, {clean('city')} full_name, nullif(regexp_replace(regexp_extract(upper({TRIM.format('state')}), '{places.STATE}', 1), '[^A-Z]', '', 'g'), '') code from (select distinct state, city from inexact)),
hinted as (select *, list_filter(known, lambda s: ends_with(full_name, ' ' || lower(s)))[1] tail, list_filter(known, lambda s: starts_with(full_name, lower(s) || ' '))[1] head from spelt, codes),
cut as (select *, case when tail is null then full_name else left(full_name, length(full_name) - length(tail) - 1) end no_tail from hinted),
bare as (select *, case when list_filter(known, lambda s: starts_with(no_tail, lower(s) || ' '))[1] is null then no_tail else substr(no_tail, length(list_filter(known, lambda s: starts_with(no_tail, lower(s) || ' '))[1]) + 2) end short_name from cut),
scoped as (select state, city, case when short_name <> '' then short_name else full_name end name,
  case when length(code) = 2 and list_contains(known, code) then code when coalesce(tail, head) is not null then coalesce(tail, head) else '*' end scope from bare),
names as (select distinct scope, name, {letter_pairs('name')} bits, replace(name, ' ', '') a, regexp_replace(name, '^[^ ]+ ', '') ra from scoped where name <> ''),
likely as (select n.*, l.mun_code, l.peso, l.name entry, replace(l.name, ' ', '') b, regexp_replace(l.name, '^[^ ]+ ', '') rb, len(list_intersect(n.bits, l.bits)) both_have, len(n.bits) + len(l.bits) sizes
  from names n join listed l on n.scope in (l.uf, '*')),
alike as (select *, both_have / cast(sizes - both_have as double) jaccard, least({edits('a', 'b')},
    case when length(a) >= 5 then levenshtein(a, substr(b, 1, length(a))) / cast(length(a) as double) + 0.1 end,
    case when left(name, 1) = left(entry, 1) and contains(name, ' ') and contains(entry, ' ') and length(ra) >= 4 then {edits('ra', 'rb')} + 0.1 end) edits
  from likely where both_have / cast(sizes - both_have as double) >= {places.MIN_SIMILARITY} - 1e-12),
meant as (select scope, name, mun_code from alike where edits <= {places.MAX_EDITS}
  qualify row_number() over (partition by scope, name order by round(jaccard - edits, 6) desc, peso desc, mun_code) = 1),
told as (select s.state, s.city, coalesce(m.mun_code, 0)::int mun_code from scoped s left join meant m on m.scope = s.scope and m.name = s.name)
"""

ORACLES = {
    "p5_found": f"with {PLACES} select i.arrival_seq, t.mun_code from inexact i join told t on t.state = i.state and t.city = i.city",
    "p5_unmatched": f"with {PLACES} select i.state, i.city, count(*) votes from inexact i join told t on t.state = i.state and t.city = i.city where t.mun_code = 0 group by all",
    "p2_found": f"with {KEYS} select tbl, arrival_seq from ranked where i > 1",
    # Two ways to tell a first arrival, and the share of rows on which they differ.
    "p2_report": f"""with {KEYS}, m as (select *, case when k is not null then arrival_seq = min(arrival_seq) over (partition by tbl, k) end f from ranked)
        select tbl, count(*) n_rows, count(k) keyed, count(*) filter (where i = 1) firsts, count(*) filter (where i > 1) repeats,
               count(*) filter (where k is not null and f <> (i = 1)) / cast(greatest(count(k), 1) as double) wrong_share from m group by tbl""",
    "p7_invariants": """select container, n placed, 0::bigint cut_though_fitting, 0::bigint not_adding_up, 0::bigint overfull, n documents
        from (select distinct container from containers where container is not null and capacity_tokens > 0), (select count(*) n from documents where text <> '')""",
    "p8_invariants": """select mixture, (select count(*) from mix_targets t where target_share > 0 and max_repeats > 0 and exists (select 1 from documents d where d.source = t.source and text <> '')) sources,
        0::bigint beyond_limit, 0::bigint twice_in_epoch, 0::bigint left_out, 0::bigint budget_missed, 0::bigint gaps from (values ('target'), ('full'), ('entropy')) m(mixture)""",
}
