"""op13: equal texts of ``documents``, white space aside."""

from pagelake.llm.exact_copies import exact_copies
from pagelake.llm.registry import query, table

OP13_SQL = r"""
with texts as (
    select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
    from documents),
groups as (
    select text_sha256, arg_min(doc_id, (-chars, doc_id)) as keep_id, count(*) as group_size from texts group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from texts join groups using (text_sha256)
"""


@query("op13_exact_dedup", OP13_SQL)
def exact_dedup(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"))
