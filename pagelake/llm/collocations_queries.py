"""op11: phrases of ``documents`` that occur together more often than their parts would."""

from pagelake.llm.collocations import COVER_PERCENT, MIN_COUNT, TOP, collocations
from pagelake.llm.registry import query, table

OP11_SQL = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
phrases as (
    select lang, size, phrase, count(*) as f
    from (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
        from words, (values (1), (2), (3)) sizes(size))
    group by all),
totals as (select lang, sum(f)::bigint as n from phrases where size = 1 group by 1),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from phrases where size > 1 and f >= {MIN_COUNT}),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest
    from candidates, (values (1), (2)) places(k) where k < size),
scored as (
    select c.lang, c.phrase, a, k, h.f as l, r.f as r, (1000000::hugeint * a * a) // (h.f::hugeint * r.f) as score
    from cuts c join phrases h on h.lang = c.lang and h.phrase = c.head join phrases r on r.lang = c.lang and r.phrase = c.rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covers as (
    select lang, part, max(a) as longer
    from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from candidates where size = 3)
    group by 1, 2),
ranked as (
    select l.lang, row_number() over (partition by l.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score::bigint as score
    from lowest l left join covers c on c.lang = l.lang and c.part = l.phrase
    where longer is null or 100 * longer < {COVER_PERCENT} * a)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {TOP}
"""


@query("op11_phrase_collocations", OP11_SQL)
def phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
