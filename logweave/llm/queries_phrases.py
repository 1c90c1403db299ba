"""Query of the phrase mining."""

from __future__ import annotations

from logweave.llm import collocations
from logweave.llm.registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op12_collocations",
    rf"""
    with pieces as (
        select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents),
    split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
    grams as (select lang, m, array_to_string(w[s:s + m - 1], ' ') as phrase
              from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from split, range(1, 5) sizes(m) where len(w) >= m)),
    counted as (select lang, phrase, m, count(*) as c from grams group by all),
    totals as (select lang, sum(c) as n from counted where m = 1 group by lang),
    candidates as (select lang, phrase, m, c as a, string_split(phrase, ' ') as w from counted where m > 1 and c >= 30),
    cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first_part, array_to_string(w[k + 1:], ' ') as rest
             from candidates, range(1, 4) ks(k) where k < m),
    scored as (select cuts.lang, cuts.phrase, a, l.c as l, r.c as r, k, (2000000::hugeint * a) // (l.c + r.c)::hugeint as score
               from cuts join counted l on l.lang = cuts.lang and l.phrase = first_part
                         join counted r on r.lang = cuts.lang and r.phrase = rest),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inner_parts as (
        select lang, array_to_string(w[s:s + q - 1], ' ') as phrase, max(a) as longer
        from candidates, range(2, 4) sizes(q), range(1, 4) starts(s) where q < m and s + q - 1 <= m group by all),
    kept as (select best.* from best left join inner_parts i on i.lang = best.lang and i.phrase = best.phrase
             where longer is null or 100::hugeint * longer < 80::hugeint * a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select ranked.lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
    from ranked join totals on totals.lang = ranked.lang where rank <= 2000
    """,
)
def _op12(spark, sf):
    return collocations.collocations(table(spark, sf, "documents").select("lang", "text"))
