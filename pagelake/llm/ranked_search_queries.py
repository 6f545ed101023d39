"""op12: the documents that rank highest for each item of ``benchmark``."""

from pagelake.llm.ranked_search import TOP, ranked_documents
from pagelake.llm.registry import query, table

TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12_SQL = rf"""
with tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TERMS}) as term from documents) group by 1, 2),
lengths as (select doc_id, sum(tf)::bigint as n from tf group by 1),
totals as (select count(*) as docs, sum(n)::bigint as words from lengths),
weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, totals group by term, docs),
damped as (select doc_id, 100 - 50 + (50 * n * docs) // words as m from lengths, totals),
wanted as (select distinct item_id, unnest({TERMS}) as term from benchmark),
scored as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
    from wanted join weights using (term) join tf using (term) join damped using (doc_id) group by 1, 2),
ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0)
select * from ranked where rank <= {TOP}
"""


@query("op12_ranked_lexical_search", OP12_SQL)
def ranked_lexical_search(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
