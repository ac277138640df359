"""Registered queries of resampling, mixing and conversation repair, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxatrend.llm.common import table
from taxatrend.llm.conversation_repair import damage_and_repair
from taxatrend.llm.source_mixing import mix, taken_words
from taxatrend.llm.target_resampling import resample

#: CRC-32 of the bytes ``b``, with its table of 256 steps made by the rule of the polynomial.
CRC_TABLE = """
bits as (select list(c order by i) as steps from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from (select unnest(range(256)) as i)
))"""
CRC = "xor(list_reduce(list_concat([4294967295::bigint], {bytes}), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
BYTES = "list_transform(range(1, 2 * octet_length(encode({s})), 2), lambda i: cast('0x' || substr(hex(encode({s})), i, 2) as bigint))"

OP11 = rf"""
with {CRC_TABLE},
d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
dw as (select row, unnest(words) as word from d), bw as (select unnest(words) as word from b),
buckets as (select word, {CRC.format(bytes=BYTES.format(s="word"))} % 10000 as bucket from (select word from dw union select word from bw), bits),
s as (select bucket, count(*) as n from dw join buckets using (word) group by 1), t as (select bucket, count(*) as n from bw join buckets using (word) group by 1),
g as (
  select k.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) as bigint) as gain
  from (select unnest(range(10000)) as bucket) k left join s using (bucket) left join t using (bucket)
), w as (select row, cast(floor(sum(gain) / count(*)) as bigint) as weight from dw join buckets using (word) join g using (bucket) group by 1),
scored as (
  select d.row, doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from d left join w using (row)
), ranked as (select row, row_number() over (order by score desc, doc_id nulls last, n_features) as place from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * (select count(*) from ranked) // 100 then place end as rank from scored left join ranked using (row)
"""


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn in proportion to their likeness to the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; ``pieces`` and ``shards`` say how it is spread."""
    return taken_words(*mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source", "pieces", "shards")


def least(*ways: str) -> str:
    """SQL: the cheapest of several {c, a, r} (cost, audit, repaired lines), of equals the least audit; null where none."""
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w.c is not null))"


def step(way: str, cost: str, edit: str, line: str | None = None) -> str:
    """SQL: ``way`` with an edit more."""
    return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{edit}', 'r': {way}.r || {f'chr(10) || {line}' if line else repr('')}}}"


#: One turn at a time: first what may be inserted before it, then its deletion, its keeping and its relabelling. ``e`` nothing put out, then the last initial.
ADD = "case when fault = 'truncated' then 5 else 0 end"
OP13 = rf"""
with recursive {CRC_TABLE},
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {CRC.format(bytes=BYTES.format(s="coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"))} % 20 as kind
  from conversations, bits
), left_over as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from keyed where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as same,
    lag(role) over (partition by conv_id order by turn nulls first, role, text, copy) as before, regexp_extract_all(text, '[^ 	-]') as visible
  from left_over
), t as (
  select conv_id, i, turn, role, text, before, case when len(visible) = 0 then 'blank' when same > 1 then 'duplicate' when visible[-1] not in ('.', '!', '?') then 'truncated' else 'none' end as fault
  from placed
), w as (
  select conv_id, cast(0 as bigint) as i, {{'c': cast(0 as bigint), 'a': '', 'r': ''}} as e, {{'c': cast(null as bigint), 'a': '', 'r': ''}} as s, {{'c': cast(null as bigint), 'a': '', 'r': ''}} as u, {{'c': cast(null as bigint), 'a': '', 'r': ''}} as a
  from (select distinct conv_id from t)
  union all
  select conv_id, i, n.e, coalesce(n.s, {{'c': null, 'a': '', 'r': ''}}), coalesce(n.u, {{'c': null, 'a': '', 'r': ''}}), coalesce(n.a, {{'c': null, 'a': '', 'r': ''}}) from (
    select conv_id, i, {{
      'e': {step("e", "2", "D")},
      's': {least(step("s", "2", "D"), "case when free and role[1] = 's' then " + step("e", ADD, "K", "role || ':' || text") + " end")},
      'u': {least(step("u", "2", "D"), *["case when free and role[1] = 'u' then " + step(x, ADD, "K", "role || ':' || text") + " end" for x in "esa"], *["case when free then " + step(x, "1 + " + ADD, "R", "'user:' || text") + " end" for x in "esa"])},
      'a': {least(step("a", "2", "D"), "case when free and role[1] = 'a' then " + step("u", ADD, "K", "role || ':' || text") + " end", "case when free then " + step("u", "1 + " + ADD, "R", "'assistant:' || text") + " end")}
    }} as n from (
      select conv_id, i, role, text, fault, free, e, s, u, coalesce({least("a", step("u", "5", "I", "'assistant:'"))}, a) as a from (
        select t.conv_id, t.i, t.role, t.text, t.fault, t.fault in ('none', 'truncated') as free, e, s, a, coalesce({least("u", *[step(x, "5", "I", "'user:'") for x in "esa"])}, u) as u
        from w join t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1
      )
    )
  )
), last as (
  select w.conv_id, {least("e", "a", step("u", "5", "I", "'assistant:'"), "{'c': s.c + 10, 'a': s.a || 'II', 'r': s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}")} as best
  from w join (select conv_id, max(i) as i from t group by 1) m on m.conv_id is not distinct from w.conv_id and m.i = w.i
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before[1] || role[1] not in ('su', 'ua', 'au')) as illegal
  from t group by 1
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts f on f.conv_id is not distinct from o.conv_id left join last l on l.conv_id is not distinct from o.conv_id
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by a hash, described and repaired at least cost."""
    return damage_and_repair(table(spark, sf_dir, "conversations"))
