"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL
functions alone.

A source's rows, in a seeded hash order, are cut into blocks of equal size.  With
quotas q (blocks of each source in a cycle of Q = sum(q) slots) the j-th block of
a source is released at floor(j * Q / q) and due at ceil((j + 1) * Q / q); the
slots go, earliest deadline first, to blocks that are released.  Every block then
runs within its window, so after any number of slots a source is less than one
block away from its share.  Lags are zero at the end of a cycle, so a cycle's
pattern repeats and the order of all rows is arithmetic: no row waits for another.

When a source runs out, its place in the cycle shrinks to what it has left and is
then gone, and the rest share the cycle in the same proportions; a cycle's
pattern depends on its quotas alone, of which there are at most two new sets for
each source.  The fold over a pattern's slots runs once for each.

The rank of a row in its source comes from a rank in a bucket of the hash order
and the counts of the buckets before it, so a source with a third of all rows is
spread over all tasks.  Nothing is dropped or repeated.

Defined results: a null source and sources without a quota form one stream,
`other`; rows without an id are ordered by what they hold; repeated rows each get a
place; an empty table gives an empty result;
columns of the input named slot, place, stream or block give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash-order buckets of a source: their counts are the only global state.
BUCKETS = 4096
BLOCK = 16
SEED = "mix"
#: Blocks of each source in a cycle of 100 slots, and those of all other sources.
QUOTAS = {"src0": 20} | {f"src{k}": 4 for k in range(1, 20)}
OTHER = 4


def _classes(per: DataFrame, quotas: list[int], block: int) -> DataFrame:
    """A row for each run of cycles with the same quotas: since, until (cycle
    numbers), quota (array), slots (in a cycle), before (slots before `since`)."""
    q = F.array(*[F.lit(x).cast("long") for x in quotas])
    have = (
        per.groupBy("stream")
        .agg(F.sum("n").alias("rows"))
        .agg(F.map_from_entries(F.collect_list(F.struct("stream", F.ceil(F.col("rows") / block).cast("long")))).alias("m"))
        .select(F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("long")) for k in range(len(quotas))]).alias("have"))
    )
    out = have.select("have", q.alias("q")).selectExpr(
        "have", "q", "explode(array_distinct(concat(array(0L), transform(have, (h, i) -> h div q[i]), transform(have, (h, i) -> h div q[i] + 1L)))) as since"
    )
    out = out.selectExpr(
        "since",
        "zip_with(have, q, (h, n) -> least(n, greatest(0L, h - since * n))) as quota",
        "aggregate(zip_with(have, q, (h, n) -> least(h, since * n)), 0L, (a, x) -> a + x) as before",
    )
    out = out.selectExpr("*", "aggregate(quota, 0L, (a, x) -> a + x) as slots")
    # at most two rows for each stream and one more: one task is enough
    return out.withColumn("until", F.coalesce(F.lead("since").over(Window.orderBy("since")), F.lit(2**62))).where("slots > 0")


#: Earliest deadline first, by (deadline, stream), among streams with a released block left.
_PICK = """array_min(filter(transform(acc.served, (x, i) ->
    if(x < quota[i] and (x * slots) div greatest(quota[i], 1L) <= t,
       named_struct('due', ((x + 1L) * slots + quota[i] - 1L) div greatest(quota[i], 1L), 'i', i), null)), z -> z is not null)).i"""
_FOLD = f"""aggregate(sequence(0L, slots - 1L),
    cast(named_struct('served', transform(quota, x -> 0L), 'picks', array()) as struct<served: array<bigint>, picks: array<struct<stream: int, k: bigint>>>),
    (acc, t) -> transform(array({_PICK}), p -> cast(named_struct(
        'served', transform(acc.served, (x, i) -> if(i = p, x + 1L, x)),
        'picks', concat(acc.picks, array(named_struct('stream', p, 'k', acc.served[p]))))
        as struct<served: array<bigint>, picks: array<struct<stream: int, k: bigint>>>))[0],
    acc -> acc.picks)"""


def mixed(docs: DataFrame, quotas: dict[str, int] | None = None, other: int = OTHER, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """docs with `slot` (of the row's block, over all sources), `place` (in the
    block), `stream` and `block` (of the stream). Ordering by (slot, place) mixes."""
    quotas = QUOTAS if quotas is None else quotas
    names, amounts = list(quotas), [other, *quotas.values()]
    stream = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("source")), F.lit(0)).cast("int") if names else F.lit(0)
    kept = [c for c in docs.columns if c not in ("slot", "place", "stream", "block")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    # rows without an id are dealt by what they hold
    order = F.when(F.col("doc_id").isNotNull(), F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed)))).otherwise(F.md5(F.concat_ws(":", F.to_json(row, {"ignoreNullFields": "false"}), F.lit(seed))))
    keyed = docs.select("doc_id", stream.alias("stream"), order.alias("_h"), row.alias("_row"))
    keyed = keyed.withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    per = keyed.groupBy("stream", "_bucket").agg(F.count("*").alias("n"))  # BUCKETS rows a stream at most
    before = per.select("stream", "_bucket", (F.sum("n").over(Window.partitionBy("stream").orderBy("_bucket")) - F.col("n")).alias("_before"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("stream", "_bucket").orderBy("_h", "doc_id", F.xxhash64("_row"))))
    # dealt by the join's keys already, so the counts come to the rows, not the rows to the counts
    ranked = ranked.join(before, ["stream", "_bucket"]).withColumn("_r", F.col("_before") + F.col("_r") - 1)
    own = F.element_at(F.array(*[F.lit(x).cast("long") for x in amounts]), F.col("stream") + 1)
    ranked = ranked.withColumns({"block": F.expr(f"_r div {block}"), "place": F.expr(f"cast(_r % {block} as int)"), "_q": own})
    ranked = ranked.withColumns({"_cycle": F.expr("block div _q"), "_k": F.expr("block % _q")})
    pattern = (
        _classes(per, amounts, block)
        .selectExpr("since", "until", "before", "slots", f"{_FOLD} as picks")
        .selectExpr("since", "until", "before", "slots", "posexplode(picks) as (_t, _pick)")
        .selectExpr("since", "until", "before", "slots", "_t", "_pick.stream as stream", "_pick.k as _k")
    )  # (2 x streams + 1) x slots of a cycle at most
    out = ranked.join(F.broadcast(pattern), ["stream", "_k"]).where("since <= _cycle and _cycle < until")
    out = out.withColumn("slot", F.expr("before + (_cycle - since) * slots + _t"))
    return out.select("_row.*", "slot", "place", "stream", "block")


def oracle(quotas: dict[str, int] | None = None, other: int = OTHER, block: int = BLOCK, seed: str = SEED, docs: str = "documents") -> str:
    """SQL for (doc_id, source, stream, block, place, slot) of mixed()."""
    quotas = QUOTAS if quotas is None else quotas
    amounts, names = [other, *quotas.values()], ", ".join(f"'{x}'" for x in quotas)
    q, n = f"{amounts}::bigint[]", len(amounts)
    return f"""
with recursive keyed as (
    select doc_id, source, coalesce(list_position([{names}], source), 0)::int as stream,
        row_number() over (partition by coalesce(list_position([{names}], source), 0)
            order by md5(concat_ws(':', coalesce(doc_id::varchar, to_json({{'doc_id': doc_id, 'source': source}})::varchar), '{seed}')), doc_id nulls first) - 1 as r from {docs}),
have as (select list(h order by s) as have, {q} as q from (
    select s, coalesce((n + {block - 1}) // {block}, 0)::bigint as h from range({n}) t(s)
        left join (select stream, count(*) as n from keyed group by 1) on stream = s)),
starts as (select distinct unnest(list_concat([0::bigint], list_transform(range(1, {n + 1}), lambda i: have[i] // q[i]),
    list_transform(range(1, {n + 1}), lambda i: have[i] // q[i] + 1))) as since from have),
classes as (select *, list_sum(quota)::bigint as slots, coalesce(lead(since) over (order by since), 4611686018427387904) as until from (
    select since, list_transform(range(1, {n + 1}), lambda i: least(q[i], greatest(0, have[i] - since * q[i]))::bigint) as quota,
        list_sum(list_transform(range(1, {n + 1}), lambda i: least(have[i], since * q[i])))::bigint as before from starts, have)),
edf as (
    select since, 0::bigint as t, list_transform(quota, lambda x: 0::bigint) as served, 0::bigint as pick, 0::bigint as k from classes where slots > 0
    union all
    select since, t + 1, list_transform(range(1, {n + 1}), lambda i: served[i] + (i = p)::bigint), p, served[p] from (
        select e.*, c.slots, list_min(list_filter(list_transform(range(1, {n + 1}), lambda i:
            case when served[i] < quota[i] and (served[i] * slots) // greatest(quota[i], 1) <= t
            then (((served[i] + 1) * slots + quota[i] - 1) // greatest(quota[i], 1)) * 100000 + i end), lambda x: x is not null)) % 100000 as p
        from edf e join classes c using (since) where t < c.slots)),
placed as (select *, r // {block} as b, ({q})[stream + 1] as own from keyed)
select doc_id, source, stream, b as block, (r % {block})::int as place, before + (b // own - c.since) * slots + e.t - 1 as slot
from placed join classes c on c.since <= b // own and b // own < c.until
join edf e on e.since = c.since and e.t > 0 and e.pick = stream + 1 and e.k = b % own"""
