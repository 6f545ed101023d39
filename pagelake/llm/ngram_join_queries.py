"""op9: Jaccard join of all ``documents``."""

from pagelake.llm.ngram_join import similar_components
from pagelake.llm.registry import query, table

WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP9_SQL = f"""
with recursive words as (select doc_id, {WORDS} as w from documents),
grams as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as gram
    from words),
sizes as (select doc_id, count(*) as n from grams group by 1),
links as (
    select a.doc_id as a, b.doc_id as b from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id
    join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    group by 1, 2 having 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach as (select doc_id, doc_id as low from documents union select r.doc_id, l.b from reach r join links l on l.a = r.low)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.low) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id join reach r on r.doc_id = d.doc_id group by 1
"""


@query("op9_ngram_jaccard_join", OP9_SQL)
def ngram_jaccard_join(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"))
