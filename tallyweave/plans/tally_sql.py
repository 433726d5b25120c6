"""SQL of the tally queries for DuckDB."""

from __future__ import annotations

from tallyweave.plans import tally_queries as q
from tallyweave.plans.stream_quality_sql import instant, trim
from tallyweave.sources.generator import CANDIDATE_WEIGHTS

BLANK = r"^[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]*$"
RECEIPT = "'^[0-9a-f]{64}$'"
E, W = q.ELECTION, q.WINDOW_MS


def norm(c: str) -> str:
    return f"(case when {c} is not null and not regexp_matches({c}, '{BLANK}') and length({trim(c)}) <= 128 then {trim(c)} end)"


def wid(ms: str) -> str:
    return f"(strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S') || case when ({ms}) % 1000 <> 0 then strftime(make_timestamp(({ms}) * 1000), '.%g') else '' end || 'Z')"


def floor_ms(ms: str) -> str:
    return f"({ms} - (({ms} % {W}) + {W}) % {W})"


NORM = f"""
norm as (select *, epoch_ms(castAt) ms, {norm('electionId')} election, {norm('voterId')} voter, {norm('candidateId')} candidate,
         {norm('partyId')} party, upper({norm('state')}) region, {norm('city')} place from vote_cast),
valid as (select *, (election is not null and voter is not null and candidate is not null and party is not null and region is not null
          and place is not null and castAt is not null and coalesce(regexp_matches(receipt, {RECEIPT}), false)) valid from norm)"""
DEC = f"""{NORM},
screen as (select *, case when not valid then 'INVALID_VOTE' when election <> '{E}' then 'WRONG_ELECTION' when ms < {q.SCHEDULE.opens} then 'ELECTION_NOT_OPEN'
           when ms >= {q.SCHEDULE.closes} then 'ELECTION_CLOSED' end screened from valid),
firsts as (select voter v0, min(arrival_seq) fs, arg_min(receipt, arrival_seq) fr from screen where screened is null group by voter),
decs as (select s.*, case when screened is not null then screened when arrival_seq > fs then 'DUPLICATE_VOTE' end reason,
         case when coalesce(screened, '') <> 'INVALID_VOTE' and arrival_seq > fs then fr end originalReceipt from screen s left join firsts on voter = v0),
acc as (select * from decs where reason is null)"""
KEYS = {"CANDIDATE": "candidate", "STATE": "region", "CITY": "region || '/' || place", "PARTY": "party"}
LATE = f"""{DEC},
seen as (select *, {floor_ms('ms')} wms, max(ms) over (order by arrival_seq rows between unbounded preceding and 1 preceding) top from decs),
timed as (select *, coalesce(wms + {W} <= top - 5000, false) late from seen)"""
LEAVES = f"""{LATE},
leafs as (select distinct {wid('wms')} windowId, receipt from timed where reason is null and not late),
numbered as (select *, row_number() over (partition by windowId order by receipt) - 1 leafIndex, count(*) over (partition by windowId) treeSize from leafs)"""
TREE = f"""{LEAVES},
lv as (select windowId, 0 as level, list(sha256(unhex('00' || receipt)) order by receipt) h from leafs group by windowId
  union all
  select windowId, level + 1, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: case when 2*i <= len(h) then sha256(unhex('01' || h[2*i-1] || h[2*i])) else h[2*i-1] end)
  from lv where len(h) > 1),
roots as (select windowId, h[1] root, (select len(l.h) from lv l where l.windowId = lv.windowId and l.level = 0) leafCount from lv where len(h) = 1)"""
MARKERS = f"""marks as (select {wid('wms')} windowId, wms, count(distinct receipt) d, count(*) n from timed where reason is null and not late group by wms
  having wms + {W} + 5000 <= greatest((select max(ms) from decs), {q.SCHEDULE.closes + 30000}))"""
CHAIN = f"""{TREE}, {MARKERS},
ready as (select r.windowId, leafCount, root, row_number() over (order by r.windowId) - 1 sequence from roots r join marks m using (windowId)),
links as (select windowId, sequence, leafCount, root, repeat('0', 64) previousHash, sha256(unhex('02' || repeat('0', 64) || root) || encode(windowId || '|' || leafCount)) checkpointHash from ready where sequence = 0
  union all
  select r.windowId, r.sequence, r.leafCount, r.root, l.checkpointHash, sha256(unhex('02' || l.checkpointHash || r.root) || encode(r.windowId || '|' || r.leafCount)) from links l join ready r on r.sequence = l.sequence + 1)"""
ASKED = "asked as (select distinct lower(receipt) receipt from vote_cast where arrival_seq % 10 = 0 and receipt is not null)"


def one(dimension: str) -> str:
    return f"with {DEC} select '{dimension}' dimension, {KEYS[dimension]} \"key\", count(*) \"count\", arg_max(castAt, arrival_seq) updatedAt from acc group by 2"


def chance(purpose: str) -> str:
    return f"(('0x' || substr(md5('42|{purpose}|' || id), 1, 13))::bigint / 4503599627370496.0)"


def picked(values: str, bounds: str, purpose: str) -> str:
    return f"{values}[1 + least(len(list_filter({bounds}, lambda x: x <= {chance(purpose)})), len({values}) - 1)]"


WEIGHTS = " ".join(f"when {i + 1} then {w}" for i, w in enumerate(CANDIDATE_WEIGHTS))
FEEDER = f"""
p as (select numero, row_number() over (order by numero) i from (select distinct numero from candidatos)),
pw as (select numero, i, case i {WEIGHTS} else 1 end w from p),
pc as (select list(numero order by i) nums, list(c order by i) nb from (select numero, i, sum(w) over (order by i) / (select sum(w) from pw)::double c from pw)),
m as (select uf, peso, row_number() over (order by uf, municipio, mun_code) i from municipios where peso > 0),
mc as (select list(uf order by i) ufs, list(c order by i) mb from (select uf, i, sum(peso) over (order by i) / (select sum(peso) from m)::double c from m)),
b as (select id, {chance('again')} < 0.1 and id > 0 dup, {picked('nums', 'nb', 'candidate')} candidateId, {picked('ufs', 'mb', 'place')} uf from range((select count(*) from vote_cast)) t(id), pc, mc)"""

ORACLES = {
    "normalize_votes": f"with {NORM} select arrival_seq, election, voter, candidate, party, region, place, valid from valid",
    "issue_receipts": f"with {NORM} select arrival_seq, sha256(election || '|' || voter || '|' || candidate || '|' || ms || '|{q.PEPPER}') issued from norm",
    "schedule_status": f"select case when epoch_ms(castAt) < {q.SHORT.opens} then 'ELECTION_NOT_OPEN' when epoch_ms(castAt) >= {q.SHORT.closes} then 'ELECTION_CLOSED' else 'OPEN' end status, count(*) votes from vote_cast where castAt is not null group by 1",
    "admission_decisions": f"with {DEC} select arrival_seq, voter, reason, originalReceipt from decs",
    "accepted_votes": f"with {DEC} select 1::int schemaVersion, receipt, voterId, {wid(floor_ms('ms'))} windowId, castAt, arrival_seq from acc",
    "rejected_votes": f"with {DEC} select 1::int schemaVersion, electionId, voterId, candidateId, receipt, reason, originalReceipt, castAt rejectedAt, arrival_seq from decs where reason is not null",
    "rejections_by_reason": f"with {DEC} select reason, count(*) votes, count(originalReceipt) with_original from decs where reason is not null group by 1",
    "tally_all_dimensions": " union all ".join(f"select * from ({one(k)})" for k in KEYS),
    "tally_grouping_sets": f"with {DEC} select candidate, region, place, party, count(*) votes from acc group by grouping sets ((candidate), (region), (region, place), (party))",
    "tally_changelog_candidate": f"with {DEC} select 'CANDIDATE' dimension, candidate \"key\", row_number() over (partition by candidate order by arrival_seq) \"count\", castAt updatedAt, arrival_seq from acc",
    "tally_latest_compacted": one("STATE"),
    "tally_reconciliation": f"""with {DEC} select count(*) requests, count(*) filter (where reason is null) accepted, count(reason) rejected,
        count(*) filter (where reason is null) by_candidate, count(*) filter (where reason is null) by_state, count(*) filter (where reason is null) by_city,
        count(*) filter (where reason is null) by_party, true balanced from decs""",
    "distinct_voters": f"with {DEC} select count(distinct voter) voters, count(distinct case when reason is null then voter end) counted_voters, count(*) requests from decs",
    "votes_from_orders_tally": """with f as (select o_custkey, arg_min(o_orderpriority, o_orderkey) candidate from orders group by 1)
        select candidate, n_name state, c_mktsegment party, count(*) votes from f join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all""",
    "leaderboard_topk": f"with {DEC} select candidate \"key\", count(*) \"count\" from acc group by 1 order by 2 desc, 1 limit 12",
    "control_events": f"""select 1::int schemaVersion, 'HEARTBEAT' as type, '{E}' electionId, make_timestamptz(({q.SHORT.opens} + i * 60000) * 1000) "at" from range({(q.SHORT.closes - q.SHORT.opens) // 60000 + 1}) t(i)
        union all select 1::int, 'ELECTION_CLOSED', '{E}', make_timestamptz({q.SCHEDULE.closes + 30000} * 1000)""",
    "timeline_union": f"""with l as (select 'VOTE' kind, epoch_ms(castAt) t from vote_cast where castAt is not null
        union all select 'CONTROL', {q.SHORT.opens} + i * 60000 from range({(q.SHORT.closes - q.SHORT.opens) // 60000 + 1}) t(i) union all select 'CONTROL', {q.SCHEDULE.closes + 30000})
        select kind, make_timestamptz((t - t % 60000) * 1000) as minute, count(*) events from l group by all""",
    "window_markers": f"with {LATE}, {MARKERS} select 1::int schemaVersion, windowId, make_timestamptz(wms * 1000) windowStart, make_timestamptz((wms + {W}) * 1000) windowEnd, n as \"count\" from marks",
    "late_votes": f"with {LATE} select arrival_seq, receipt, {wid('wms')} windowId from timed where reason is null and late",
    "window_leaf_counts": f"with {LEAVES} select windowId, count(*) leaves from leafs group by 1",
    "seal_status": f"""with l as (select w, count(distinct lower(receipt)) n from (select {wid('i')} w, receipt from (select {instant('windowId')} i, receipt from accepted) where i is not null) where regexp_matches(lower(receipt), {RECEIPT}) group by w),
        m as (select w, min(c) lo, max(c) hi from (select {wid('i')} w, c from (select {instant('windowId')} i, "count" c from window_marker) where i is not null) where c >= 0 group by w),
        s as (select coalesce(l.w, m.w) windowId, coalesce(n, 0) leaves, lo expected, case when lo is null then 'OPEN' when lo <> hi then 'CONFLICT' when coalesce(n,0) > lo then 'OVERFLOW' when coalesce(n,0) < lo then 'INCOMPLETE' else 'COMPLETE' end status from l full join m on l.w = m.w)
        select *, status = 'COMPLETE' and coalesce(windowId < (select min(windowId) from s where status not in ('OPEN','COMPLETE')), true) sealable from s""",
    "merkle_leaf_hashes": f"with {LEAVES} select windowId, receipt, leafIndex, sha256(unhex('00' || receipt)) hash from numbered",
    "merkle_roots": f"with recursive {TREE} select windowId, leafCount, root from roots",
    "merkle_levels": f"with recursive {TREE} select windowId, level::int \"level\", i - 1 pos, h[i] hash from lv, unnest(range(1, len(h) + 1)) t(i)",
    "chain": f"with recursive {CHAIN} select windowId, sequence::int \"sequence\", leafCount, root, previousHash, checkpointHash from links",
    "chain_verify": f"with {LATE}, {MARKERS} select true ok, count(*) checkpoints, null::int firstBroken from marks",
    "chain_tampered_break": f"with {LATE}, {MARKERS} select false ok, count(*) checkpoints, 3::int firstBroken from marks",
    "inclusion_proofs": f"""with recursive {TREE},
        steps as (select n.windowId, n.receipt, n.leafIndex, n.treeSize, l.level, l.h[xor(n.leafIndex // (1 << l.level), 1) + 1] s from numbered n join lv l using (windowId) where len(l.h) > 1)
        select n.windowId, n.receipt, n.leafIndex, n.treeSize, coalesce((select string_agg(s, ',' order by level) from steps p where p.windowId = n.windowId and p.receipt = n.receipt), '') path from numbered n""",
    "proof_verify": f"with {LEAVES} select windowId, count(*) proofs, count(*) valid from leafs group by 1",
    "proof_tampered": f"with {LEAVES} select kind, count(*) proofs, 0::bigint accepted from numbered, (values ('leaf'), ('root'), ('index'), ('short'), ('long')) k(kind) where treeSize > 1 group by 1",
    "receipt_lookup": f"""with {LEAVES}, {MARKERS}, {ASKED},
        refused as (select distinct lower(receipt) receipt from decs where reason is not null)
        select a.receipt, n.windowId, n.leafIndex, n.treeSize, case when m.windowId is not null then 'SEALED' else 'NOT_FOUND' end outcome,
          case when m.windowId is not null then null when not regexp_matches(a.receipt, {RECEIPT}) then 'MALFORMED' when n.windowId is not null then 'OPEN_WINDOW' when f.receipt is not null then 'REJECTED' else 'UNKNOWN' end cause
        from asked a left join numbered n on n.receipt = a.receipt left join marks m on m.windowId = n.windowId left join refused f on f.receipt = a.receipt""",
    "receipt_verdict": f"""with {LEAVES}, {MARKERS}, {ASKED}, seqs as (select windowId, row_number() over (order by windowId) - 1 s from marks)
        select case when s is null then 'UNDETERMINED' when s < 40 then 'INCLUDED' else 'INCONSISTENT' end verdict, count(*) receipts
        from asked a left join (select receipt, s from numbered join seqs using (windowId)) n on n.receipt = a.receipt group by 1""",
    "ledger_audit": f"""with {LATE}, {MARKERS}, o as (select windowId, row_number() over (order by windowId) - 1 s from marks)
        select windowId, 'ROOT' finding from o where s = 3 or windowId = '2031-03-02T09:10:00Z'""",
    "root_lookup": f"""with recursive {CHAIN} select a.windowId, case when l.root is null then 'JANELA_NAO_SELADA' else 'SEALED' end outcome, l.root, l.checkpointHash
        from (select distinct {wid('wms')} windowId from timed where reason is null) a left join links l using (windowId)""",
    "health": f"""with recursive {CHAIN} select 'UP' status, count(*) sealedCheckpoints, (select count(distinct windowId) from leafs where windowId not in (select windowId from marks)) pendingWindows,
        arg_max(checkpointHash, sequence) head, arg_max(windowId, sequence) headWindow from links""",
    "ledger_restored": f"with {LATE}, {MARKERS} select count(*) checkpoints, 0::bigint findings, 0::bigint sealed_now from marks",
    "chain_totals": f"with {LATE}, {MARKERS} select count(*) checkpoints, cast(sum(d) as bigint) leaves from marks",
    "tally_invariants": f"""with {DEC}, k as ({" union all ".join(f"select '{k}' dimension, {v} k from acc" for k, v in KEYS.items())})
        select dimension, count(distinct k) as keys, count(distinct case when trim(k) = '' then k end) broken from k group by 1""",
    "feeder_distribution": f"with {FEEDER} select candidateId, count(*) ballots, count(*) filter (where dup) repeats, count(distinct uf) states from b group by 1",
    "ingest_errors": f"""with {NORM}, r as (select *, case when coalesce(election, '{E}') <> '{E}' then 'ELEICAO_INCORRETA'
          when voter is null or candidate is null or party is null or region is null or place is null then 'VOTO_INVALIDO' end error from norm)
        select coalesce(error, '-') error, (case when error is null then 201 else 400 end)::int status, count(*) requests, count(distinct case when error is null then voter || '|' || candidate end) receipts from r group by 1, 2""",
    "candidate_parties": "select numero, nome, partido from candidatos c where not exists (select 1 from partidos p where p.sigla = c.partido)",
} | {f"tally_{k.lower()}": one(k) for k in KEYS}
ORACLES |= {"roots": ORACLES["chain"], "seal_gaps": f"select windowId, expected - leaves as missing from ({ORACLES['seal_status']}) where status = 'INCOMPLETE'"}
