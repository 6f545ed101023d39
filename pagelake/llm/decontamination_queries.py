"""op1: items of ``benchmark`` found inside ``documents``."""

from pagelake.llm.decontamination import PERCENT, contained_items
from pagelake.llm.registry import query, table

WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = f"""
with item_words as (select item_id, {WORDS.format(text="coalesce(text, '')")} as w from benchmark),
item_grams as (
    select item_id, unnest(list_distinct(case when len(w) = 0 then []
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as gram,
        least(len(w), 5) as k
    from item_words),
doc_words as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
doc_grams as (
    select distinct doc_id, k, unnest(case when len(w) < k then []
        else list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) end) as gram
    from doc_words, (select distinct k from item_grams)),
item_sizes as (select item_id, count(*) as n_item from item_grams group by 1)
select d.doc_id, i.item_id, count(*) as n_shared, any_value(s.n_item) as n_item
from doc_grams d join item_grams i on d.gram = i.gram and d.k = i.k join item_sizes s on s.item_id = i.item_id
group by 1, 2 having 100 * count(*) >= {PERCENT} * any_value(s.n_item)
"""


@query("op1_benchmark_decontamination", OP1_SQL)
def benchmark_decontamination(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
