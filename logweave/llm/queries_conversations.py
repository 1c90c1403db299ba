"""Query of the conversation repair."""

from __future__ import annotations

from logweave.llm import conversation_repair
from logweave.llm.registry import query, table
from logweave.llm.sql import crc32

_ID = "coalesce(cast(conv_id as varchar), '')"


@query(
    "op11_conversation_repair",
    rf"""
    with recursive table_of as ({crc32.table}),
    raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   {crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as d
            from conversations, table_of),
    damaged as (select conv_id, turn, case when d = 4 then 'user' else role end as role,
                       case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                       unnest(case when d = 3 then [1, 2] else [1] end) as copy
                from raw where d <> 0),
    ordered as (select {_ID} as id, *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k
                from damaged),
    marked as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                              when row_number() over (partition by id, role, text order by k) > 1 then 'duplicate'
                              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
                      lag(role) over (partition by id order by k) as role_before
               from ordered),
    sums as (select id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                    count(*) filter (fault = 'truncated') as truncated,
                    count(*) filter (role_before is not null and left(role_before, 1) || left(role, 1) not in ('su', 'ua', 'au'))
                        as illegal, count(*) as n
             from marked group by id),
    inserts(origin, edits, price, said, state) as (values
        (0, '', 0, [], 0), (0, 'I', 3, ['user:'], 2), (0, 'II', 6, ['user:', 'assistant:'], 3),
        (1, '', 0, [], 1), (1, 'I', 3, ['user:'], 2), (1, 'II', 6, ['user:', 'assistant:'], 3),
        (2, '', 0, [], 2), (2, 'I', 3, ['assistant:'], 3), (2, 'II', 6, ['assistant:', 'user:'], 2),
        (3, '', 0, [], 3), (3, 'I', 3, ['user:'], 2), (3, 'II', 6, ['user:', 'assistant:'], 3)),
    acts(state, initial, edit, price, state_after, title) as (values
        (0, null, 'D', 4, 0, null), (1, null, 'D', 4, 1, null), (2, null, 'D', 4, 2, null), (3, null, 'D', 4, 3, null),
        (0, null, 'R', 3, 2, 'user'), (1, null, 'R', 3, 2, 'user'), (2, null, 'R', 3, 3, 'assistant'), (3, null, 'R', 3, 2, 'user'),
        (0, 's', 'K', 0, 1, null), (0, 'u', 'K', 0, 2, null), (1, 'u', 'K', 0, 2, null), (2, 'a', 'K', 0, 3, null),
        (3, 'u', 'K', 0, 2, null)),
    step as (
        select id, 0::bigint as k, 0 as state, {{'cost': 0::bigint, 'audit': '', 'said': []::varchar[]}} as best from sums
        union all
        select s.id, s.k + 1, a.state_after,
               min({{'cost': s.best.cost + i.price + a.price + case when a.edit <> 'D' and m.fault = 'truncated' then 3 else 0 end,
                    'audit': s.best.audit || i.edits || a.edit,
                    'said': s.best.said || i.said || case when a.edit = 'D' then [] else [coalesce(a.title, m.role) || ':' || m.text] end}})
        from step s join marked m on m.id = s.id and m.k = s.k + 1 join inserts i on i.origin = s.state
             join acts a on a.state = i.state
                  and (a.edit = 'D' or (m.fault not in ('blank', 'duplicate') and (a.edit = 'R' or a.initial = left(m.role, 1))))
        group by s.id, s.k, a.state_after),
    ends as (select s.id, min({{'cost': s.best.cost + i.price, 'audit': s.best.audit || i.edits, 'said': s.best.said || i.said}}) as best
             from step s join sums on sums.id = s.id and s.k = sums.n
                  join inserts i on i.origin = s.state and (i.state = 3 or (s.state = 0 and i.state = 0)) group by s.id),
    ids as (select distinct conv_id, {_ID} as id from conversations)
    select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost,
           coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) as repaired_sha256
    from ids left join sums using (id) left join ends using (id)
    """,
)
def _op11(spark, sf):
    return conversation_repair.repair_damaged(table(spark, sf, "conversations"))
