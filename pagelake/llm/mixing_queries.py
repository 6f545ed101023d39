"""op10: all ``documents`` mixed by the weights of their sources."""

from pagelake.llm.mixing import mixed_single_source
from pagelake.llm.registry import query, table

OP10_SQL = r"""
with sized as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
        md5(concat('mix', coalesce(cast(doc_id as varchar), 'null'))) as place
    from documents),
sources as (
    select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight
    from (select source, cast(sum(size) as bigint) as source_size from sized group by source)),
ranked as (
    select *, row_number() over (order by 2.0 * source_size / weight, source nulls last) as k, sum(source_size) over () as total,
        coalesce(sum(2 * source_size) over (order by 2.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
        sum(weight) over (order by 2.0 * source_size / weight, source nulls last rows between current row and unbounded following) as open_weight
    from sources),
levels as (select *, (1.5 * cast(total as double) - cast(capped as double)) / cast(open_weight as double) as level from ranked),
stop as (select arg_min(k, k) as at, arg_min(level, k) as level from levels where level * weight <= 2 * source_size),
targets as (
    select l.source, l.source_size,
        case when l.k >= s.at then s.level * l.weight else cast(2 * l.source_size as double) end as target
    from levels l left join stop s on true),
running as (
    select d.doc_id, d.size, t.source_size, t.target,
        case when t.source_size = 0 then 0 else cast(floor(t.target) as bigint) // t.source_size end as whole,
        case when t.source_size = 0 then 0 else cast(floor(t.target) as bigint) % t.source_size end as rest,
        sum(d.size) over (partition by d.source order by d.place, d.size rows unbounded preceding) as through
    from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * (whole + case when through <= rest then 1 else 0 end) as bigint) as taken
from running
"""


@query("op10_mixing_to_target_weights", OP10_SQL)
def mixing_to_target_weights(spark, sf_dir):
    return mixed_single_source(table(spark, sf_dir, "documents")).drop("repeats")
