"""The same queries in SQL for DuckDB."""

TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
INSTANT = (
    r"^(\d{4})[-/._ ]?(\d{2})[-/._ ]?(\d{2})[T _]+(\d{2})[:.\-_hH ]?(\d{2})(?:[:.\-_mM ]?(\d{2})(?:[.,](\d{1,9}))?)?"
    r"\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)\s*(?:/.*)?$"
)


def trim(c: str) -> str:
    return TRIM.format(c)


def instant(c: str) -> str:
    """Epoch milliseconds of the instant that a window id names, or null."""
    t = f"upper({trim(c)})"
    g = lambda i: f"regexp_extract({t}, '{INSTANT}', {i})"
    zone = f"(case when {g(8)} in ('Z','UTC','GMT') then '+00:00' else substr({g(8)},1,3) || ':' || (case when length({g(8)})>3 then substr(replace({g(8)},':',''),4,2) else '00' end) end)"
    sec = f"(case when {g(6)}='' then '00' else {g(6)} end)"
    text = f"{g(1)}||'-'||{g(2)}||'-'||{g(3)}||' '||{g(4)}||':'||{g(5)}||':'||{sec}||'.'||rpad(substr({g(7)},1,6),6,'0')||{zone}"
    return f"(case when regexp_matches({t}, '{INSTANT}') then epoch_ms(try_cast({text} as timestamptz)) end)"


#: Rows of both tables: message, window start in ms and arrival in ms.
TIMED = f"""
timed as (
  select 'vote_cast' tbl, arrival_seq, lower({trim('receipt')}) r, {trim('voterId')} v,
         epoch_ms(castAt) - ((epoch_ms(castAt) % 15000) + 15000) % 15000 ws, epoch_ms(arrivedAt) a from vote_cast
  union all
  select 'accepted', arrival_seq, lower({trim('receipt')}), {trim('voterId')}, {instant('windowId')}, epoch_ms(arrivedAt) from accepted),
firsts as (
  select * from (select *, case when coalesce(r,'')='' or coalesce(v,'')='' then cast(arrival_seq as varchar) else '' end alone from timed)
  qualify row_number() over (partition by tbl, case when alone='' then r end, case when alone='' then v end, alone order by arrival_seq) = 1),
stat as (
  select *, case when ws is null then 'NO_WINDOW' when a is null or a < ws + 20000 then 'ON_TIME' when a < ws + 315000 then 'LATE' else 'TOO_LATE' end status from firsts)
"""
MS = "make_timestamptz(({0}) * 1000)"


def revisions(rows: str, size: int, groups: str) -> str:
    """Emissions from rows (groups, ws, a), ws being the start of a window that holds the row."""
    g = f"{groups}, " if groups else ""
    return f"""
revs as (select {g}ws, greatest(cast(floor((coalesce(a, ws) - ws - {size} - 5000) / 5000.0) as bigint) + 1, 0) revision from {rows} where ws is not null),
deltas as (select {g}ws, revision, count(*) delta from revs where revision <= 59 group by all)
select {g}{MS.format('ws')} window_start, {MS.format(f'ws + {size}')} window_end, revision,
       {MS.format(f'ws + {size} + 5000 + revision * 5000')} emitted_at, delta,
       cast(sum(delta) over (partition by {g}ws order by revision) as bigint) n from deltas"""


REFS = f"""
refs as (
  select 'vote_cast' tbl, 'candidateId' field, {trim('candidateId')} k, epoch_ms(castAt) t, epoch_ms(arrivedAt) arr, arrival_seq from vote_cast
  union all
  select 'vote_cast', 'partyId', {trim('partyId')}, epoch_ms(castAt), epoch_ms(arrivedAt), arrival_seq from vote_cast
  union all
  select 'accepted', 'windowId', {trim('windowId')}, epoch_ms(arrivedAt), epoch_ms(arrivedAt), arrival_seq from accepted),
marks as (
  select k, min(ms) filter (where not gone) f, bool_or(gone and last) gone from (
    select {instant('windowId')} k, epoch_ms(arrivedAt) ms, (count is null and windowStart is null and windowEnd is null) gone,
           row_number() over (partition by {instant('windowId')} order by arrival_seq desc) = 1 last from window_marker) where k is not null group by k),
cand as (select numero, min(epoch_ms(registeredAt)) f from candidatos group by numero),
good as (
  select distinct r.arrival_seq from refs r join candidatos c on r.field='candidateId' and c.numero = r.k
  and (r.t is null or (r.t >= coalesce(epoch_ms(c.registeredAt), r.t) and (c.removedAt is null or r.t < epoch_ms(c.removedAt))))),
judged as (
  select r.*, case when field='candidateId' then case when c.numero is null then 'MISSING' when g.arrival_seq is not null then 'OK' when r.t < c.f then 'LATE' else 'DELETED' end
       when field='partyId' then case when p.sigla is null then 'MISSING' else 'OK' end
       else case when m.k is null then 'MISSING' when m.gone then 'DELETED' when r.t is not null and m.f is not null and r.t < m.f then 'LATE' else 'OK' end end status
  from (select *, case when field='windowId' then {instant('k')} end w from refs where coalesce(k,'') <> '') r
  left join cand c on r.field='candidateId' and c.numero = r.k
  left join good g on r.field='candidateId' and g.arrival_seq = r.arrival_seq
  left join (select distinct sigla from partidos) p on r.field='partyId' and p.sigla = r.k
  left join marks m on r.field='windowId' and m.k = r.w)
"""

COPIES = f"""
copies as (
  select 'vote_cast' tbl, arrival_seq, arrivedAt, lower({trim('receipt')}) r, {trim('voterId')} v from vote_cast
  union all
  select 'accepted', arrival_seq, arrivedAt, lower({trim('receipt')}), {trim('voterId')} from accepted),
ranked as (
  select *, row_number() over (partition by tbl, r, v, case when coalesce(r,'')='' or coalesce(v,'')='' then arrival_seq end order by arrival_seq) i from copies)
"""

ORACLES = {
    "p1_found": f"with {TIMED} select tbl, arrival_seq from stat where status = 'LATE'",
    "p1_lateness_summary": f"with {TIMED} select tbl, status, count(*) messages from stat group by all",
    "p1_window_counts": f"with {TIMED}, {revisions('firsts', 15000, 'tbl')}",
    "p1_sliding_counts": f"""with w as (
        select epoch_ms(castAt) - ((epoch_ms(castAt) % 15000) + 15000) % 15000 - 15000 * i ws, epoch_ms(arrivedAt) a
        from vote_cast, range(4) s(i) where castAt is not null), {revisions('w', 60000, '')}""",
    "p3_found": f"""
        with k as (select 'state' dim, upper({trim('state')}) key_value from vote_cast union all select 'candidateId', {trim('candidateId')} from vote_cast)
        select dim, key_value from k where coalesce(key_value,'') <> '' group by all having count(*) * 20 >= (select count(*) from vote_cast)
        union all
        select distinct 'municipio', uf || '/' || municipio from municipios where peso * 20 >= (select sum(peso) from municipios)""",
    "p3_key_counts": f"""
        with k as (select 'state' dim, upper({trim('state')}) key_value, {trim('voterId')} voter from vote_cast union all select 'candidateId', {trim('candidateId')}, {trim('voterId')} from vote_cast)
        select dim, key_value, count(*) n, count(distinct voter) voters,
               case when dim = 'state' then (select count(*) from municipios where upper(uf) = key_value) else (select count(*) from candidatos where {trim('numero')} = key_value) end entries
        from k where coalesce(key_value,'') <> '' group by all""",
    "p4_found": f"with {REFS} select tbl, field, arrival_seq from judged where status in ('MISSING','DELETED') or (status='LATE' and field <> 'windowId')",
    "p4_report": f"with {REFS} select tbl, field, make_timestamptz((arr - arr % 3600000) * 1000) period, status, count(*) refs from judged group by all",
    "p6_found": f"with {COPIES} select tbl, arrival_seq from ranked where i > 1",
    "p6_kept_per_day": f"with {COPIES} select tbl, strftime(arrivedAt at time zone 'UTC', '%Y-%m-%d') as day, count(*) messages from ranked where i = 1 group by all",
}
