"""The same queries as plain SQL for DuckDB, over the given tables."""

from __future__ import annotations

_UUID = "concat('00000000-0000-0000-0000-', lpad(cast({0} as varchar), 12, '0'))"
_US = "concat('US', lpad(cast({0} as varchar), 10, '0'))"

TRANSACTIONS = f"""
transactions as (
 select {_UUID.format('event_id')} as id,
  cast(case when event_id % 200 in (198, 199) then (event_id % 2) * 20000
       else cast(value as decimal(19,4)) * 100 end as decimal(19,4)) as amount,
  case when event_id % 3 = 0 then 'USD' when event_id % 3 = 1 then 'EUR' else 'GBP' end as currency,
  case when event_id % 200 in (198, 199) then concat('ZM', lpad(cast(event_id // 200 as varchar), 10, '0'))
       else {_US.format('user_id')} end as from_account,
  case when event_id % 200 in (198, 199) then concat('ZN', lpad(cast(event_id // 200 as varchar), 10, '0'))
       else {_US.format('(event_id * 31) % 150')} end as to_account,
  case when event_id % 101 = 0 then 'Suspected Money  Launder ring'
       when event_id % 103 = 0 then 'Possible sanction violation'
       when event_id % 107 = 0 then 'Gift to a TERRORIST group'
       when event_id % 109 = 0 then 'Illicit funds after a sanctions violation'
       when event_id % 11 = 0 then 'Mail anna.k+x@mail.example.org, SSN 987-65-4321, dial 212-555-0199'
       when event_id % 13 = 0 then 'Desk phone (646) 555-0142'
       else 'Groceries and fuel' end as description,
  ts as occurred_at
 from events)"""

ACTIVITY = """
activity as (
 select from_account as account, true as is_from, t.* from transactions t
 union all
 select to_account as account, false as is_from, t.* from transactions t where to_account <> from_account)"""

FEATURES = """
features as (
 select id, amount, currency, from_account, to_account, description, occurred_at,
  velocity, history_count, history_sum
 from (
  select *, count(*) over v as velocity, count(*) over h as history_count,
   cast(sum(amount) over h as decimal(29,4)) as history_sum
  from activity
  window v as (partition by account order by epoch_us(occurred_at)
               range between 3599999999 preceding and current row),
         h as (partition by account order by occurred_at, id rows between 20 preceding and 1 preceding))
 where is_from)"""

# Written out here and not shared with the engine, so that a wrong value shows.
_PATTERN = r"""case when regexp_matches(description, '(?i)money\s*launder') then '(?i)money\s*launder'
 when regexp_matches(description, '(?i)terrorist') then '(?i)terrorist'
 when regexp_matches(description, '(?i)sanctions?\s*violation') then '(?i)sanctions?\s*violation'
 when regexp_matches(description, '(?i)illicit\s*fund') then '(?i)illicit\s*fund' end"""

GATED = f"""
gated as (
 select * exclude (pattern),
  case when pattern is not null then 'BLOCK' when velocity > 2 or amount > 10000 then 'FLAG'
       else 'APPROVE' end as gate_decision,
  cast(case when pattern is not null then 95 when velocity > 2 or amount > 10000 then 50
       else 10 end as decimal(5,2)) as gate_score,
  case when pattern is not null then 'Sanctioned pattern detected: ' || pattern
       when velocity > 2 then 'High velocity: ' || velocity || ' transactions exceed limit of 2'
       when amount > 10000 then 'High amount: ' || amount || ' exceeds threshold of 10000'
       else 'No risk indicators detected' end as gate_reason
 from (select *, {_PATTERN} as pattern from features))"""

_EMBEDDINGS = f"""
vectors as (select {_UUID.format('vec_id')} as id, cast(embedding as double[]) as v from embeddings)"""


def _nearest(name: str, queries: str, k: int, extra: str = "") -> str:
    return f"""
{name} as (
 select * from (
  select *, row_number() over (partition by query_id order by similarity desc, id) as rank from (
   select q.id as query_id, c.id, round((1 + list_cosine_similarity(q.v, c.v)) / 2, 9) as similarity
   from {queries} q join vectors c on q.id <> c.id) {extra})
 where rank <= {k})"""


_TEXT = "amount || ' ' || currency || ' from ' || from_account || ' to ' || to_account || ': ' || description"

def _similar(dimensions: int) -> str:
    return f"""
texts as (select id, epoch_us(occurred_at) as at_us, {_TEXT} as text from transactions),
words as (
 select id, cast(('0x' || substr(md5(w), 1, 8)) as bigint) % {dimensions} as bucket
 from (select id, unnest(regexp_split_to_array(lower(text), '\\W+')) as w from texts) where w <> ''),
counts as (select id, bucket, count(*) as n from words group by id, bucket),
norms as (select id, sqrt(cast(sum(n * n) as double)) as norm from counts group by id),
stored as (
 select t.id, any_value(t.at_us) as at_us,
  cast(list_transform(range({dimensions}), lambda b: coalesce(map_from_entries(list((c.bucket, cast(cast(n / norm as float) as double))))[b], 0))
   as double[{dimensions}]) as v
 from texts t join counts c on t.id = c.id join norms m on t.id = m.id group by t.id),
asked as (select * from stored where id in (select id from gated where gate_decision = 'FLAG')),
near as (
 select * from (
  select *, row_number() over (partition by query_id order by similarity desc, id) as rank from (
   select q.id as query_id, c.id, round((1 + array_cosine_similarity(q.v, c.v)) / 2, 9) as similarity
   from asked q join stored c on c.at_us < q.at_us or (c.at_us = q.at_us and c.id <= q.id)))
 where rank <= 5 and id <> query_id),
alike as (
 select query_id as id, count(*) as similar_count,
  cast(sum(cast(similarity as decimal(12,9))) as double) / count(*) as similar_mean
 from near group by query_id)"""


SIMILAR = _similar(384)

_EXACT2 = "cast(round(cast(cast({0} as varchar) as decimal(38,18)), 2) as decimal(20,2))"

_ALL_ALIKE = "g.id = s.id"
_SOME_ALIKE = "g.id = s.id and cast(substr(g.id, 25) as bigint) % 7 <> 0"

_ASSESSED = f"""
points as (
 select g.*, s.similar_count, s.similar_mean,
  cast(least(100.00, round(g.amount * 0.005, 2)) as decimal(20,2)) as amount_points,
  case when coalesce(s.similar_count, 0) = 0 then cast(10 as decimal(20,2))
       else {_EXACT2.format('cast(-20 as double) * s.similar_mean')} end as similarity_points
 from gated g left join alike s on {{alike}} where g.gate_decision = 'FLAG'),
assessed as (
 select *,
  cast(greatest(0.00, least(100.00, amount_points + similarity_points)) as decimal(5,2)) as assessment_risk,
  '[Stub] Heuristic: amount-based=' || cast(round(amount_points, 1) as decimal(20,1))
   || ', similarity-adj=' || cast(round(similarity_points, 1) as decimal(20,1))
   || ', similar-count=' || coalesce(similar_count, 0) as assessment_reasoning,
  cast(case when history_count = 0 then 60 when history_sum = 0 then 50 else
   {_EXACT2.format('''least(cast(100 as double), greatest(cast(0 as double),
    (cast(amount as double) / (cast(history_sum as double) / history_count) - 1) * 30 + 30))''')}
  end as decimal(5,2)) as history_risk
 from points)"""

ASSESSED = _ASSESSED.replace("{alike}", _ALL_ALIKE)

DECIDED = """
scored as (
 select *, cast(round(gate_score * 0.20 + assessment_risk * 0.50 + history_risk * 0.30, 2) as decimal(5,2)) as risk_score
 from assessed),
decided as (
 select id, amount, currency, from_account, to_account, description, occurred_at, gate_decision,
  gate_decision as decision, gate_score as risk_score,
  case when gate_decision = 'APPROVE' then 'Rule gate: approved' else 'Rule gate: ' || gate_reason end as reasoning,
  occurred_at as evaluated_at
 from gated where gate_decision <> 'FLAG'
 union all
 select id, amount, currency, from_account, to_account, description, occurred_at, gate_decision,
  case when floor(risk_score) < 30 then 'APPROVE' when floor(risk_score) < 70 then 'FLAG' else 'BLOCK' end as decision,
  risk_score,
  'Rule gate: ' || gate_reason || ' | LLM: ' || assessment_reasoning
   || ' | History: ' || history_count || ' recent transactions | Weighted score: ' || risk_score as reasoning,
  occurred_at as evaluated_at
 from scored)"""

TO_GATE = ", ".join([TRANSACTIONS, ACTIVITY, FEATURES, GATED])
TO_ASSESSED = ", ".join([TO_GATE, SIMILAR, ASSESSED])
TO_PARTLY_ASSESSED = ", ".join([TO_GATE, SIMILAR, _ASSESSED.replace("{alike}", _SOME_ALIKE)])
TO_DECIDED = ", ".join([TO_ASSESSED, DECIDED])


def _instant(ts: str) -> str:
    us = f"(epoch_us({ts}) % 1000000)"
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when {us} = 0 then '' "
        f"when {us} % 1000 = 0 then '.' || lpad(cast({us} // 1000 as varchar), 3, '0') "
        f"else '.' || lpad(cast({us} as varchar), 6, '0') end || 'Z'"
    )


_RECEIVED_JSON = (
    """'{"id":' || to_json(id) || ',"amount":' || amount || ',"currency":' || to_json(currency)"""
    """ || ',"fromAccount":' || to_json(from_account) || ',"toAccount":' || to_json(to_account)"""
    """ || ',"description":' || to_json(description) || ',"occurredAt":"' || """ + _instant("occurred_at") + """ || '"'"""
)
_EVALUATED_JSON = (
    _RECEIVED_JSON + """ || ',"decision":"' || decision || '","riskScore":' || risk_score"""
    """ || ',"reasoning":' || to_json(reasoning) || ',"evaluatedAt":"' || """ + _instant("evaluated_at") + """ || '"}'"""
)


def _uuid_of(text: str) -> str:
    return (f"concat_ws('-', substr(md5({text}), 1, 8), substr(md5({text}), 9, 4), substr(md5({text}), 13, 4), "
            f"substr(md5({text}), 17, 4), substr(md5({text}), 21, 12))")


OUTBOX = f"""
outbox as (
 select {_uuid_of("'TransactionReceived|' || id || '|'")} as id, 'Transaction' as aggregate_type,
  id as aggregate_id, 'TransactionReceived' as event_type, {_RECEIVED_JSON} || '}}' as payload,
  occurred_at as created_at
 from transactions
 union all
 select {_uuid_of("'TransactionEvaluated|' || id || '|'")} as id, 'Transaction' as aggregate_type,
  id as aggregate_id, 'TransactionEvaluated' as event_type, {_EVALUATED_JSON} as payload,
  evaluated_at as created_at
 from decided)"""

TO_OUTBOX = ", ".join([TO_DECIDED, OUTBOX])

RAW_EVENTS = f"""
raw_events as (
 select event_id,
  case when event_id % 37 = 0 then null when event_id % 41 = 0 then 'TransactionMoved'
       when event_id % 5 = 0 then 'TransactionEvaluated' else 'TransactionReceived' end as event_type,
  case when event_id % 43 = 0 then 'no json' else concat(
   '{{"id":"', case when event_id % 61 = 0 then 'no-uuid' else {_UUID.format('event_id')} end,
   '","amount":', case when event_id % 67 = 0 then 'null' when event_id % 71 = 0 then '10000000000000000.5'
     else cast(cast(case when event_id % 47 = 0 then -75.25 else value end as decimal(19,4)) as varchar) end,
   ',"currency":"', case when event_id % 53 = 0 then 'QQQ' when event_id % 2 = 0 then 'USD' else 'DEM' end,
   '","fromAccount":"', case when event_id % 59 = 0 then 'US12' else {_US.format('user_id')} end,
   '","toAccount":"FR0000000777","description":', case when event_id % 73 = 0 then 'null' else '"Library fees"' end,
   ',"occurredAt":"', case when event_id % 79 = 0 then strftime(ts, '%Y-%m-%d') else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end, '"',
   case when event_id % 5 = 0 then concat(
    ',"decision":"', case when event_id % 83 = 0 then 'MAYBE' else 'FLAG' end,
    '","riskScore":', case when event_id % 89 = 0 then '100.5' else cast(event_id % 100 as varchar) end,
    ',"reasoning":"checked by hand","evaluatedAt":"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '"') else '' end,
   '}}') end as value
 from events)"""

# Codes of the test tables only; 'DEM' is a code of the past.
_CODES = "'USD', 'EUR', 'GBP', 'DEM'"

VALIDATED = f"""
parsed as (select *, case when json_valid(value) then cast(value as json) end as j from raw_events),
wire as (
 select event_id, event_type, value, j, event_type = 'TransactionEvaluated' as is_evaluated,
  cast(j->>'$.amount' as decimal(38,18)) as wire_amount, cast(j->>'$.riskScore' as decimal(38,18)) as wire_score
 from parsed),
fields as (
 select *,
  case when regexp_full_match(lower(j->>'$.id'), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') then lower(j->>'$.id') end as id,
  try_cast(round(wire_amount, 4) as decimal(19,4)) as amount, j->>'$.currency' as currency,
  j->>'$.fromAccount' as from_account, j->>'$.toAccount' as to_account, j->>'$.description' as description,
  cast(try_strptime(j->>'$.occurredAt', '%Y-%m-%dT%H:%M:%SZ') as timestamp) as occurred_at,
  case when is_evaluated then j->>'$.decision' end as decision,
  case when is_evaluated then cast(wire_score as decimal(5,2)) end as risk_score,
  case when is_evaluated then j->>'$.reasoning' end as reasoning,
  case when is_evaluated then cast(try_strptime(j->>'$.evaluatedAt', '%Y-%m-%dT%H:%M:%SZ') as timestamp) end as evaluated_at
 from wire),
validated as (
 select * exclude (j), case
  when event_type is null then 'missing event type'
  when event_type not in ('TransactionReceived', 'TransactionEvaluated') then 'unknown event type'
  when j is null then 'unparseable payload'
  when id is null then 'invalid id'
  when wire_amount is null then 'missing amount'
  when wire_amount < 0 then 'negative amount'
  when amount is null then 'amount out of range'
  when currency not in ({_CODES}) then 'unknown currency'
  when not (regexp_full_match(from_account, '[A-Z]{{2}}[0-9]{{10}}')
            and regexp_full_match(to_account, '[A-Z]{{2}}[0-9]{{10}}')) then 'invalid account'
  when description is null then 'missing description'
  when occurred_at is null then 'invalid time'
  when is_evaluated and not coalesce(decision in ('APPROVE', 'FLAG', 'BLOCK') and reasoning is not null, false) then 'invalid decision'
  when is_evaluated and not coalesce(wire_score between 0 and 100, false) then 'invalid risk score'
  when is_evaluated and evaluated_at is null then 'invalid time' end as reject_reason
 from fields)"""

REQUESTS = f"""
requests as (
 select event_id,
  cast(case when event_id % 29 = 0 then null when event_id % 31 = 0 then -50.0 else value end as decimal(19,4)) as amount,
  case when event_id % 37 = 0 then chr(9) when event_id % 41 = 0 then 'QQQ' else 'USD' end as currency,
  case when event_id % 43 = 0 then null when event_id % 47 = 0 then 'US12' else {_US.format('user_id')} end as from_account,
  case when event_id % 53 = 0 then '' else 'FR0000000777' end as to_account,
  case when event_id % 59 = 0 then null else 'Library fees' end as description
 from events),
field_checks as (
 select *, concat_ws('; ',
   case when amount is null then 'missing amount' when amount <= 0 then 'amount not positive' end,
   case when coalesce(trim(currency, concat(' ', chr(9))), '') = '' then 'blank currency' end,
   case when coalesce(trim(from_account, concat(' ', chr(9))), '') = '' then 'blank from account' end,
   case when coalesce(trim(to_account, concat(' ', chr(9))), '') = '' then 'blank to account' end) as field_reasons
 from requests),
checked as (
 select * exclude (field_reasons),
  case when field_reasons <> '' then field_reasons
       when currency not in ({_CODES}) then 'unknown currency'
       when not (regexp_full_match(from_account, '[A-Z]{{2}}[0-9]{{10}}')
                 and regexp_full_match(to_account, '[A-Z]{{2}}[0-9]{{10}}')) then 'invalid account'
       when description is null then 'missing description' else '' end as reject_reasons
 from field_checks)"""

DELIVERIES = TRANSACTIONS + """,
deliveries as (
 select id, amount, currency, from_account, to_account, description, occurred_at,
  cast(substr(id, 25) as bigint) as ingest_seq from transactions
 union all
 select id, cast(amount + 1 as decimal(19,4)), currency, from_account, to_account, description, occurred_at,
  cast(substr(id, 25) as bigint) + 1000000000 from transactions where cast(substr(id, 25) as bigint) % 7 = 0),
latest as (
 select * from deliveries qualify row_number() over (partition by id order by ingest_seq desc) = 1)"""



def _words(source: str) -> str:
    return f"""
texts as (select id, {_TEXT} as text from {source}),
words as (
 select id, cast(('0x' || substr(md5(w), 1, 8)) as bigint) % 384 as bucket
 from (select id, unnest(regexp_split_to_array(lower(text), '\\W+')) as w from texts) where w <> ''),
counts as (select id, bucket, count(*) as n from words group by id, bucket),
norms as (select id, sqrt(cast(sum(n * n) as double)) as norm from counts group by id),
weights as (
 select c.id, c.bucket, cast(cast(n / norm as float) as decimal(9,6)) as weight
 from counts c join norms on c.id = norms.id)"""


def _scrubbed(column: str) -> str:
    for pattern, mark in (
        (r"\d{3}-\d{2}-\d{4}", "[REDACTED_SSN]"),
        (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
        (r"(\+?\d{1,3}[\-.\s]?)?\(?\d{3}\)?[\-.\s]?\d{3}[\-.\s]?\d{4}", "[REDACTED_PHONE]"),
    ):
        column = f"regexp_replace({column}, '{pattern}', '{mark}', 'g')"
    return column


USAGE = """
usage as (
 select conv_id, turn,
  case conv_id % 7 when 0 then 'gpt-4o' when 1 then 'gpt-4o-mini-2024-07-18' when 2 then 'gpt-4-0613'
   when 3 then 'all-MiniLM-L6-v2' when 4 then null when 5 then 'gpt-3.5-turbo' else 'gpt-4-turbo-preview' end as model,
  case when role = 'assistant' then 0 else length(text) end as input_tokens,
  case when role = 'assistant' then length(text) else 0 end as output_tokens
 from conversations),
prices(name, price_in, price_out) as (
 select name, cast(i as decimal(18,9)), cast(o as decimal(18,9)) from (values
  ('gpt-4o', '0.0025', '0.01'), ('gpt-4o-mini', '0.00015', '0.0006'), ('gpt-4-turbo', '0.01', '0.03'),
  ('gpt-4', '0.03', '0.06'), ('gpt-3.5-turbo', '0.0005', '0.0015'), ('text-embedding-3-small', '0.00002', '0'),
  ('text-embedding-3-large', '0.00013', '0')) p(name, i, o)),
priced as (
 select u.*, p.* from usage u left join prices p on starts_with(u.model, p.name)
 qualify row_number() over (partition by conv_id, turn order by length(p.name) desc nulls last) = 1),
costs as (
 select conv_id, turn, model, input_tokens, output_tokens,
  coalesce(cast(cast(input_tokens as decimal(19,0)) * cast(price_in * 0.001 as decimal(18,12)) as decimal(38,12))
   + cast(cast(output_tokens as decimal(19,0)) * cast(price_out * 0.001 as decimal(18,12)) as decimal(38,12)), 0) as c
 from priced)"""

DATED = USAGE + """,
dated as (select *, cast(date '2024-01-01' + cast(conv_id % 60 as integer) as date) as day from usage),
table_prices as (
 select name, price_in * 2 as price_in, price_out * 2 as price_out, null::date as valid_from, date '2024-02-01' as valid_to from prices
 union all select name, price_in, price_out, date '2024-02-01', case when name = 'gpt-3.5-turbo' then date '2024-02-20' end from prices
 union all select 'all-MiniLM', price_in, price_out, date '2024-02-10', null from prices where name = 'gpt-4o'),
dated_prices as (
 select u.*, p.price_in, p.price_out from dated u left join table_prices p on starts_with(u.model, p.name)
  and (p.valid_from is null or p.valid_from <= u.day) and (p.valid_to is null or u.day < p.valid_to)
 qualify row_number() over (partition by conv_id, turn order by length(p.name) desc nulls last) = 1)"""

_REDELIVERED = f"""
first as (select * from transactions where occurred_at < timestamp '2024-01-10'),
delivered as (
 select 0 as delivery, * from first
 union all select 0, * from first where cast(substr(id, 25) as bigint) % 10 = 0
 union all select 1, * from transactions where occurred_at >= timestamp '2024-01-10' and occurred_at < timestamp '2024-01-20'
 union all select 1, * from first where cast(substr(id, 25) as bigint) % 15 = 0
 union all select 2, * from transactions where occurred_at >= timestamp '2024-01-20'
 union all select 2, id, cast(amount + 1000 as decimal(19,4)), currency, {_US.format('cast(substr(id, 25) as bigint) % 150')},
  to_account, description, occurred_at from first where cast(substr(id, 25) as bigint) % 21 = 0),
standing as (
 select n.upto, d.* from (values (0), (1), (2)) n(upto) join delivered d on d.delivery <= n.upto
 qualify row_number() over (partition by n.upto, d.id order by d.delivery desc) = 1),
sides as (
 select from_account as account, true as is_from, s.* from standing s
 union all
 select to_account, false, s.* from standing s where to_account <> from_account),
answers as (
 select upto, id, is_from, count(*) over v as velocity, count(*) over h as history_count,
  cast(sum(amount) over h as decimal(29,4)) as history_sum
 from sides
 window v as (partition by upto, account order by epoch_us(occurred_at) range between 3599999999 preceding and current row),
        h as (partition by upto, account order by occurred_at, id rows between 20 preceding and 1 preceding))"""

_TX = "id, amount, currency, from_account, to_account, description, occurred_at"


def oracle_sql() -> dict[str, str]:
    return {
        "read_transactions": f"with {TRANSACTIONS} select {_TX} from transactions",
        "transaction_by_id": f"with {TRANSACTIONS} select {_TX} from transactions where id = {_UUID.format(42)}",
        "transactions_by_ids":
            f"with {TRANSACTIONS} select {_TX} from transactions where id in "
            f"(select {_UUID.format('doc_id * 17')} from documents)",
        "newer_than":
            f"with {TRANSACTIONS} select {_TX} from transactions where occurred_at > timestamp '2024-01-15 12:00:00'",
        "account_rows":
            f"with {TRANSACTIONS} select {_TX} from transactions "
            "where from_account = 'US0000000042' or to_account = 'US0000000042'",
        "account_history":
            f"with {TRANSACTIONS} select {_TX} from transactions "
            "where from_account = 'US0000000042' or to_account = 'US0000000042' order by occurred_at desc, id limit 20",
        "account_activity":
            f"with {TRANSACTIONS}, {ACTIVITY} select account, is_from, {_TX} from activity",
        "velocity_as_of":
            f"with {TRANSACTIONS}, {ACTIVITY} select account, count(*) as velocity from activity "
            "where occurred_at > timestamp '2024-01-15 12:00:00' - interval 1 hour group by account",
        "velocity": f"with {TO_GATE} select id, from_account, velocity from features",
        "history_window":
            f"with {TO_GATE} select id, from_account, history_count, history_sum, "
            "cast(history_sum as double) / nullif(history_count, 0) as history_mean from features",
        "recent_transactions":
            f"with {TRANSACTIONS}, {ACTIVITY} select account, id, amount, occurred_at, recency from (select *, "
            "row_number() over (partition by account order by occurred_at desc, id) as recency from activity) "
            "where recency <= 20",
        "transaction_text": f"with {TRANSACTIONS} select id, {_TEXT} as text from transactions",
        "redact_transactions":
            f"with {TRANSACTIONS} select id, amount, substr(sha256(from_account), 1, 8) as redacted_from_account, "
            f"substr(sha256(to_account), 1, 8) as redacted_to_account, {_scrubbed('description')} as redacted_description, "
            "occurred_at from transactions",
        "redact_documents": f"select doc_id, {_scrubbed('text')} as text from documents",
        "rule_gate": f"with {TO_GATE} select id, velocity, gate_decision, gate_score, gate_reason from gated",
        "gate_counts":
            f"with {TO_GATE} select gate_decision, count(*) as n from gated group by gate_decision",
        "knn": f"with {_EMBEDDINGS}, {_nearest('nearest', 'vectors', 5)} select query_id, id, similarity, rank from nearest",
        "knn_self_takes_slot": f"""with {_EMBEDDINGS},
 ranked as (
  select q.id as query_id, c.id, round((1 + list_cosine_similarity(q.v, c.v)) / 2, 9) as similarity
  from vectors q cross join vectors c),
 taken as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from ranked)
 select query_id, id, similarity, rank from taken where rank <= 5 and id <> query_id""",
        "similar_within":
            f"with {_EMBEDDINGS}, {_nearest('nearest', 'vectors', 10, 'where similarity > 0.7')} "
            "select query_id, id, similarity, round(2.0 * (1.0 - similarity), 8) as distance, rank from nearest",
        "knn_blocks": f"with {_EMBEDDINGS}, {_nearest('nearest', 'vectors', 5)} select query_id, id, similarity, rank from nearest",
        "similar_blocks":
            f"with {_EMBEDDINGS}, {_nearest('nearest', 'vectors', 10, 'where similarity > 0.7')} "
            "select query_id, id, similarity, round(2.0 * (1.0 - similarity), 8) as distance, rank from nearest",
        "similar_transactions": f"with {TO_GATE}, {SIMILAR} select query_id, id, similarity, rank from near",
        "similar_transactions_embed": f"with {TO_GATE}, {_similar(32)} select query_id, id, similarity, rank from near",
        "audit_stream":
            f"with {RAW_EVENTS}, {VALIDATED} select {_TX}, decision, risk_score, reasoning, evaluated_at from validated "
            "where reject_reason is null and event_type = 'TransactionEvaluated'",
        "velocity_split": f"with {TO_GATE} select id, from_account, velocity from features",
        "history_split":
            f"with {TO_GATE} select id, from_account, history_count, history_sum, "
            "cast(history_sum as double) / nullif(history_count, 0) as history_mean from features",
        "stream_velocity_open":
            f"with {TO_GATE} select id, from_account, velocity, history_count, history_sum from features",
        "assess_with_model": f"""with {TO_GATE}, {SIMILAR},
 larger as (
  select near.query_id as id, count(*) as n, count(*) filter (where t.amount > q.amount) as larger
  from near join transactions t on near.id = t.id join transactions q on near.query_id = q.id group by 1),
 told as (
  select g.id, g.from_account, coalesce(l.n, 0) as n, coalesce(l.larger, 0) as larger,
   cast(substr(g.id, 25) as bigint) % 9 <> 0 as ok
  from gated g left join larger l on g.id = l.id where gate_decision = 'FLAG')
 select id, ok as assessment_ok, case when ok then cast(100.0 * larger / greatest(n, 1) as decimal(5,2)) end as assessment_risk,
  case when ok then larger || ' of ' || n || ' from ' || substr(sha256(from_account), 1, 8) end as assessment_reasoning
 from told""",
        "embed_transactions": f"with {TRANSACTIONS}, {_words('transactions')} select id, bucket, weight from weights",
        "store_embeddings":
            f"with {DELIVERIES}, {_words('latest')} select w.id, l.ingest_seq, w.bucket, w.weight "
            "from weights w join latest l on w.id = l.id",
        "assess":
            f"with {TO_ASSESSED} select id, coalesce(similar_count, 0) as similar_count, assessment_risk, "
            "assessment_reasoning from assessed",
        "history_risk": f"with {TO_ASSESSED} select id, history_count, history_risk from assessed",
        "score": f"""with {TO_PARTLY_ASSESSED},
 parts as (select *, substr(id, 25)::bigint % 5 <> 0 as a, substr(id, 25)::bigint % 3 <> 0 as h from assessed),
 cents as (select *,
  cast((gate_score * 0.20 + case when a then assessment_risk * 0.50 else 0 end
   + case when h then history_risk * 0.30 else 0 end) * 10000 as bigint) as total,
  case when a and h then 10 when a then 7 when h then 5 else 2 end as tenths from parts),
 weighted as (select *,
  cast(cast((total * 20 + 100 * tenths) // (200 * tenths) as decimal(20,0)) * 0.01 as decimal(5,2)) as risk_score
  from cents)
 select id, a as assessment_ok, h as history_ok, risk_score,
  case when floor(risk_score) < 30 then 'APPROVE' when floor(risk_score) < 70 then 'FLAG' else 'BLOCK' end as decision,
  'Rule gate: ' || gate_reason || case when a then ' | LLM: ' || assessment_reasoning else '' end
   || case when h then ' | History: ' || history_count || ' recent transactions' else '' end
   || ' | Weighted score: ' || risk_score as reasoning
 from weighted""",
        "decide":
            f"with {TO_GATE} select id, gate_decision as decision, gate_score as risk_score, "
            "case when gate_decision = 'APPROVE' then 'Rule gate: approved' else 'Rule gate: ' || gate_reason end "
            "as reasoning from gated where gate_decision <> 'FLAG'",
        "evaluate":
            f"with {TO_DECIDED} select id, amount, gate_decision, decision, risk_score, reasoning from decided",
        "assertions": f"""with {TO_DECIDED}, {_EMBEDDINGS}, {_nearest('pairs', 'vectors', 5)}
 select 'decision' as promise, count(*) as faults from decided where cast(substr(id, 25) as bigint) % 40 = 0
 union all select 'score', count(*) from decided where cast(substr(id, 25) as bigint) % 41 = 0
 union all select 'gate', count(*) from gated where cast(substr(id, 25) as bigint) % 42 = 0
 union all select 'redaction', count(*) from transactions where cast(substr(id, 25) as bigint) % 43 = 0
 union all select 'similarity', count(*) from pairs where cast(substr(query_id, 25) as bigint) % 44 = 0""",
        "audit_log":
            f"with {TO_DECIDED} select {_TX}, decision, risk_score, reasoning, evaluated_at from decided",
        "decode_evaluated":
            f"with {RAW_EVENTS}, {VALIDATED} select {_TX}, decision, risk_score, reasoning, evaluated_at from validated "
            "where reject_reason is null and event_type = 'TransactionEvaluated'",
        "to_outbox":
            f"with {TO_OUTBOX} select id, aggregate_type, aggregate_id, event_type, payload, created_at from outbox",
        "route_outbox":
            f"with {TO_OUTBOX} select 'outbox.event.' || aggregate_type as topic, aggregate_id as key, "
            "payload as value, event_type from outbox",
        "outbox_scores":
            f"with {TO_OUTBOX} select event_type, aggregate_id, "
            "cast(json_extract_string(payload, '$.riskScore') as decimal(5,2)) as score "
            "from outbox where event_type = 'TransactionEvaluated'",
        "outbox_retained":
            f"with {TO_OUTBOX} select id, event_type, created_at from outbox "
            "where created_at >= timestamp '2024-01-24 00:00:00'",
        "outbox_purge_count":
            f"with {TO_OUTBOX} select count(*) as purged from outbox where created_at < timestamp '2024-01-24 00:00:00'",
        "decode_received":
            f"with {RAW_EVENTS}, {VALIDATED} select {_TX} from validated "
            "where reject_reason is null and event_type = 'TransactionReceived'",
        "route_events":
            f"with {RAW_EVENTS}, {VALIDATED} select event_id, case when reject_reason is not null then 'rejected' "
            "when event_type = 'TransactionReceived' then 'received' else 'evaluated' end as route from validated",
        "validate_events":
            f"with {RAW_EVENTS}, {VALIDATED} select event_id, event_type, id, amount, currency, from_account, "
            "to_account, description, occurred_at, reject_reason from validated",
        "reject_counts":
            f"with {RAW_EVENTS}, {VALIDATED} select coalesce(reject_reason, 'ok') as reason, count(*) as n "
            "from validated group by 1",
        "validate_requests": f"with {REQUESTS} select event_id, reject_reasons from checked",
        "request_to_transaction":
            f"with {REQUESTS} select {_uuid_of('cast(event_id as varchar)')} as id, amount, currency, from_account, "
            "to_account, description, timestamp '2024-02-01 00:00:00' as occurred_at from checked "
            "where reject_reasons = ''",
        "upsert_latest": f"with {DELIVERIES} select {_TX}, ingest_seq from latest",
        "read_event_stream":
            f"with {TRANSACTIONS} select id as key, 'TransactionReceived' as event_type, {_RECEIVED_JSON} || '}}' as value, "
            "occurred_at as timestamp from transactions",
        "read_outbox_stream":
            f"with {TO_OUTBOX} select id, aggregate_type, aggregate_id, event_type, payload, created_at from outbox "
            "where event_type = 'TransactionReceived'",
        "relay_outbox":
            f"with {TO_OUTBOX} select 'outbox.event.' || aggregate_type as topic, aggregate_id as key, "
            "payload as value, event_type from outbox where event_type = 'TransactionReceived'",
        "relay_outbox_both":
            f"with {TO_OUTBOX} select 'outbox.event.' || aggregate_type as topic, aggregate_id as key, "
            "payload as value, event_type from outbox",
        "stream_velocity_expiring":
            f"with {TO_GATE} select id, from_account, velocity, history_count, history_sum from features",
        "stream_velocity":
            f"with {TO_GATE} select id, from_account, velocity, history_count, history_sum from features",
        "run_stream":
            f"with {TO_DECIDED} select {_TX}, decision, risk_score, reasoning, evaluated_at from decided",
        "reject_stream":
            f"with {RAW_EVENTS}, {VALIDATED} select event_id, event_type, value, reject_reason from validated "
            "where reject_reason is not null",
        "redelivery":
            f"with {TRANSACTIONS}, {_REDELIVERED} select cast(d.delivery as bigint) as delivery, d.id, d.from_account, d.amount, "
            "a.velocity, a.history_count, a.history_sum from delivered d "
            "join answers a on a.upto = d.delivery and a.id = d.id and a.is_from",
        "purge_outbox":
            f"with {TO_OUTBOX} select id, aggregate_type, aggregate_id, event_type, payload, created_at from outbox "
            "where event_type = 'TransactionReceived' and created_at >= timestamp '2024-01-17 07:30:00'",
        "compact_store": f"with {DELIVERIES} select {_TX}, cast(1 as bigint) as batch_id from latest",
        "llm_cost":
            f"with {USAGE} select conv_id, turn, model, input_tokens, output_tokens, cast(c as decimal(38,12)) as cost_usd, "
            "cast(nullif(c, 0) as decimal(38,12)) as emitted_cost_usd from costs",
        "llm_cost_dated": f"""with {DATED},
dated_costs as (
 select conv_id, turn, model, input_tokens, output_tokens, day,
  coalesce(cast(cast(input_tokens as decimal(19,0)) * cast(price_in * 0.001 as decimal(18,12)) as decimal(38,12))
   + cast(cast(output_tokens as decimal(19,0)) * cast(price_out * 0.001 as decimal(18,12)) as decimal(38,12)), 0) as c
 from dated_prices)
select conv_id, turn, model, input_tokens, output_tokens, day, cast(c as decimal(38,12)) as cost_usd,
 cast(nullif(c, 0) as decimal(38,12)) as emitted_cost_usd from dated_costs""",
        "llm_cost_by_model":
            f"with {USAGE} select model, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, "
            "cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(c) as decimal(38,12)) as cost_usd "
            "from costs group by model",
    }
