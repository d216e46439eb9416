"""SQL of the conversation, negative and URL queries, for DuckDB."""

from __future__ import annotations

import itertools

GAP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: crc32 bit by bit: the list starts with the register and goes on with the message's bits.
CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, strlen(k) + 1),
    lambda i: list_transform(range(0, 8), lambda j: ((ascii(k[i]) >> j) & 1)::bigint)))),
    lambda acc, m: xor(xor(acc, m) >> 1, 3988292384::bigint * (xor(acc, m) & 1))), 4294967295::bigint)"""


def conversations() -> str:
    """One recursion over the rows of all conversations.

    v0 to v3 hold, for each grammar state, nine digits of cost and the letters: their order as
    texts is that of the paths.
    """
    follow = {"-s": 1, "-u": 2, "su": 2, "ua": 3, "au": 2}  # previous role, next role; '-' is the beginning
    name = "-sua"

    def walk(state: int, roles: str) -> int | None:
        for x in roles:
            key = name[state] + x
            if key not in follow:
                return None
            state = follow[key]
        return state

    def term(state: int, cost: str, letters: str, when: str) -> str:
        return f"case when {when} then lpad((v{state}[1:9]::bigint + {cost})::varchar, 9, '0') || v{state}[10:] || '{letters}' end"

    steps: list[list[str]] = [["null"] for _ in range(4)]
    for state, inserts in itertools.product(range(4), ("", "u", "a", "ua", "au")):
        at = walk(state, inserts)
        if at is None:
            continue
        cost, letters = 3 * len(inserts), "I" * len(inserts)
        steps[at].append(term(state, str(cost + 4), letters + "D", "true"))
        for x in "sua":
            to = walk(at, x)
            if to is not None:
                steps[to].append(term(state, f"{cost} + late", letters + "K", f"not gone and initial = '{x}'"))
                if x != "s":
                    steps[to].append(term(state, f"{cost + 3} + late", letters + "R", "not gone"))
    ends = [term(s, str(3 * len(p)), "I" * len(p), "true") for s in range(4) for p in ("", "u", "a", "ua", "au") if walk(s, p) in (0, 3)]
    values = ", ".join(f"least({', '.join(x)}) as v{to}" for to, x in enumerate(steps))
    # Roles of the repaired rows follow from their place: an s that is kept comes first, then u and a in turn.
    return f"""with recursive
        raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
        hit as (select *, ({CRC}) % 20 as how from raw),
        hurt as (select conv_id, turn, case when how = 4 then 'user' else role end as role,
            case when how = 1 then '' when how = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(case when how = 3 then [1, 2] else [1] end) as copy from hit where how <> 0),
        nth as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as n from hurt),
        seen as (select *, rtrim(text, {GAP}) as own from nth),
        judged as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, n) as i, role[1:1] as initial,
            case when own = '' then 1 when n > 1 then 2 when right(own, 1) not in ('.', '!', '?') then 3 else 0 end as fault from seen),
        placed as (select *, fault in (1, 2) as gone, 3 * (fault = 3)::int as late,
            lag(initial) over (partition by conv_id order by i) || initial as pair from judged),
        path as (select conv_id, 0::bigint as i, '000000000' as v0, null::varchar as v1, null::varchar as v2, null::varchar as v3 from (select distinct conv_id from raw)
            union all
            select p.conv_id, q.i, {values} from path p join placed q on q.conv_id is not distinct from p.conv_id and q.i = p.i + 1),
        last as (select conv_id, least({', '.join(ends)}) as best from path
            qualify row_number() over (partition by conv_id order by i desc) = 1),
        told as (select conv_id, best[1:9]::bigint as cost, best[10:] as audit from last),
        spelt as (select conv_id, unnest(range(1, len(audit) + 1)) as spot, audit from told),
        letters as (select conv_id, spot, audit[spot:spot] as letter, len(replace(audit[1:spot], 'I', '')) as i from spelt),
        left_ as (select l.conv_id, l.spot, l.letter, q.role, q.text,
            row_number() over (partition by l.conv_id order by l.spot) as place,
            first_value(l.letter = 'K' and q.initial = 's') over (partition by l.conv_id order by l.spot) as with_s
            from letters l left join placed q on q.conv_id is not distinct from l.conv_id and q.i = l.i where l.letter <> 'D'),
        rows_ as (select conv_id, place, case when letter = 'K' then role when (place - with_s::int) % 2 = 1 then 'user' else 'assistant' end || ':' ||
            case when letter = 'I' then '' else text end as line from left_),
        full_ as (select conv_id, string_agg(line, chr(10) order by place) as whole from rows_ group by conv_id),
        counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
            count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
            count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from placed group by conv_id)
        select t.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
            coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost, audit, sha256(coalesce(whole, '')) as repaired_sha256
        from told t left join counts c on c.conv_id is not distinct from t.conv_id left join full_ f on f.conv_id is not distinct from t.conv_id"""


def urls() -> str:
    """Rules, votes, counted links and all rounds of both walks, one common table per round."""
    rules = "(values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""[hH][rR][eE][fF]\s*=\s*["'']?\s*((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^"''\s<>]+)"""
    rounds = [f"w{i} as (select kind, host, sum(weight)::bigint as weight from (select w.kind, dst as host, floor(weight * share)::bigint as weight from ways join w{i - 1} w "
              "on w.kind = ways.kind and w.host = ways.src union all select kind, host, weight from w0) group by kind, host)" for i in range(1, 17)]
    return f"""with
        p as (select page_id, html, coalesce({lower("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') as host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as row from pages),
        fits as (select row, arg_max(r.h || r.s, len(r.h || r.s)) as rule, arg_max(r.v, len(r.h || r.s)) as verdict
            from p join {rules} r(h, s, v) on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.s) group by row),
        votes as (select host, count(*) as pages, count(*) filter (where verdict = 'allow') - count(*) filter (where verdict = 'block') as more
            from p left join fits using (row) group by host),
        links as (select src, dst, count(*) as n from (select host as src, coalesce({lower("regexp_extract(link, '^(?s:.*?)//([^/?#]*)', 1)")}, '') as dst
            from (select host, unnest(regexp_extract_all(html, '{link}', 1)) as link from p)) where src <> '' and dst <> '' and src <> dst group by all),
        both_ as (select 'trust' as kind, src, dst, n from links union all select 'distrust', dst, src, n from links),
        ways as (select kind, src, dst, 0.85::double * n / sum(n) over (partition by kind, src)::double as share from both_),
        w0 as (select case when more > 0 then 'trust' else 'distrust' end as kind, host, (abs(more) * 1048576)::bigint as weight from votes where host <> '' and more <> 0),
        {", ".join(rounds)},
        hosts as (select v.host, v.pages, coalesce(max(weight) filter (where kind = 'trust'), 0) as trust, coalesce(max(weight) filter (where kind = 'distrust'), 0) as distrust
            from votes v left join w16 w on w.host = v.host where v.host <> '' group by v.host, v.pages)
        select page_id, host, path, rule, coalesce(verdict, case when distrust - trust >= 0.5 * 1048576 * pages then 'block' else 'allow' end) as verdict,
            coalesce(trust, 0) / 1048576::double as trust, coalesce(distrust, 0) / 1048576::double as distrust
        from p left join fits using (row) left join hosts using (host)"""


def negatives() -> str:
    """All anchors against all rows."""
    return """with
        fine as (select vec_id, label, embedding from embeddings where vec_id is not null and label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) as q from fine),
        scored as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as s
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        near as (select a, b, s, row_number() over (partition by a order by s desc, b) as r from scored where same qualify r <= 5)
        select near.a as anchor_id, near.b as positive_id, row_number() over (partition by near.a, near.b order by n.s desc, n.b)::int as rank,
            n.b as negative_id, near.s as positive_score, n.s as negative_score
        from near join scored n on n.a = near.a and not n.same and 30 * near.s <= 100 * n.s and 100 * n.s <= 90 * near.s
        qualify rank <= 10"""
