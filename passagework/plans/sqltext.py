"""SQL fragments shared by the oracles (DuckDB dialect)."""

from __future__ import annotations

from passagework import constants as K
from passagework.functions.text import WHITESPACE, WS

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_LIT = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {WS_LIT})"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def fold(e: str) -> str:
    src = K.DASHES + K.SINGLE_QUOTES + K.DOUBLE_QUOTES + K.SPACES
    dst = "-" * len(K.DASHES) + "'" * len(K.SINGLE_QUOTES) + '"' * len(K.DOUBLE_QUOTES) + " " * len(K.SPACES)
    return squeeze(f"translate({e}, {lit(src)}, {lit(dst)})")


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[a-z0-9]+')"


# Documents as pages of bounded documents: a document is one source and one thousand consecutive ids.
PAGES = """pg as (
  select source || '-' || (doc_id // 1000) as document_id, source, doc_id, text,
         row_number() over (partition by source || '-' || (doc_id // 1000) order by doc_id) as page_number,
         doc_id % 3 as image_count
  from documents)"""

TOPIC_LINES = "repeat('Topic entry ....... 12' || chr(10), 12)"

# The same pages with headers, headings, contents lines, licence lines and page numbers written around the text.
GUIDE = PAGES + f""", gp as (
  select document_id, source, doc_id, page_number, image_count,
    case when page_number % 10 = 7 then '' else
      'Handbook of ' || source || chr(10)
      || case page_number % 5
           when 0 then page_number || '.1 Managing the case' || chr(10)
           when 1 then 'Care Plan Review' || chr(10)
           when 2 then 'Annex ' || page_number || ': Dose table' || chr(10) || 'for adults' || chr(10)
           else '' end
      || case when page_number % 8 = 6 then 'Copyright notice. Some rights reserved.' || chr(10) else '' end
      || case when page_number % 9 = 4 then {TOPIC_LINES} else '' end
      || text || chr(10) || chr(10) || '1.2.3' || chr(10) || 'Page ' || page_number || ' of 50'
    end as text
  from pg)"""

LINES = f"""ln as (
  select document_id, page_number, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos, len(l) as n
  from (select document_id, page_number, string_split(text, chr(10)) as l from gp)),
sl as (select *, {strip('line')} as s, pos < 8 or pos >= n - 8 as is_edge,
    regexp_replace(lower({strip('line')}), '[^a-z]', '', 'g') as key,
    regexp_matches({strip('line')}, '^[0-9]+(\\.[0-9]+)+$') as protected,
    regexp_matches({strip('line')}, '(?i)^([0-9]{{1,4}}|page\\s+[0-9]+(\\s+of(\\s+[0-9]+)?)?|[0-9]+\\s+of\\s+[0-9]+)$')
      as numbered
  from ln)"""

FURNITURE = f"""{GUIDE}, {LINES},
tot as (select document_id, count(*) as pages from gp group by 1),
fu as (
  select document_id, key, count(*) as pages from (
    select distinct document_id, page_number, key from sl
    where is_edge and s <> '' and length(s) <= 250 and not protected and key <> '')
  group by 1, 2),
furniture as (select f.document_id, f.key, f.pages from fu f join tot t using (document_id)
  where t.pages >= 4 and f.pages >= greatest(4, t.pages // 2))"""

STRIPPED = f"""{FURNITURE},
judged as (select s.*, s.is_edge and s.s <> '' and not s.protected and (f.key is not null or s.numbered) as gone
  from sl s left join furniture f on f.document_id = s.document_id and f.key = s.key),
st as (select g.document_id, g.source, g.page_number, g.text as raw,
    {strip("regexp_replace(coalesce(k.t, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as text
  from gp g left join (
    select document_id, page_number, string_agg(line, chr(10) order by pos) as t from judged where not gone
    group by 1, 2) k using (document_id, page_number))"""

_light = "regexp_replace(replace(text, chr(160), ' '), '\\.{4,}', ' ', 'g')"
_light = f"regexp_replace({_light}, '[ \\t]{{2,}}', ' ', 'g')"
_light = strip(f"regexp_replace({_light}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _phrases(e: str, phrases) -> str:
    return "(" + " + ".join(f"contains(lower({e}), {lit(p)})::int" for p in phrases) + ")"


def toc_ratio(e: str) -> str:
    lines = f"list_filter(list_transform(string_split({e}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    return (f"case when len({lines}) < 8 then 0 else len(list_filter({lines}, "
            f"lambda x: regexp_matches(x, '(\\s[0-9]{{1,3}}$)|(^[0-9]{{1,3}}$)')))::double / len({lines}) end")


COPYRIGHT = _phrases("text", K.COPYRIGHT_PHRASES) + " >= 2"
TOC = f"({_phrases('text', K.TOC_WORDS)} >= 2 or {toc_ratio('text')} >= 0.3)"

CLASSIFIED = f"""{STRIPPED},
lc as (select document_id, source, page_number, raw, {_light} as text from st),
cp as (select *, case when {COPYRIGHT} then 'copyright' when {TOC} then 'table_of_contents' else 'content' end
    as page_type, length(text) as char_count from lc where {strip('text')} <> '')"""


def split_sql(src: str, key: str = "id") -> str:
    """CTEs that cut ``src(key, text)`` as ``split_overlapping`` does; the result is ``ck(key, start, chunk)``.

    Atoms are pieces below 1000 characters at the coarsest separator; greedy packing is a walk along precomputed jumps
    from each atom to the atom the next chunk starts with.
    """
    def level(name, parent, sep, keys, where):
        s = f"string_split(x, {sep})"
        cols = ", ".join(["id", *keys[:-1]])
        return (f"{name} as (select {cols}, {keys[-1]}, case when {keys[-1]} = 1 then y else {sep} || y end as x from (select {cols}, "
                f"unnest({s}) as y, generate_subscripts({s}, 1) as {keys[-1]} from {parent} {where}) "
                f"where {keys[-1]} > 1 or y <> '')")

    big = "where length(x) >= 1000"
    return f"""a0 as (select {key} as id, text as x from {src}),
{level('ap', 'a0', "(chr(10) || chr(10))", ['i'], '')},
{level('al', 'ap', "chr(10)", ['i', 'j'], big)},
{level('az', 'al', "'. '", ['i', 'j', 'k'], big)},
{level('aw', 'az', "' '", ['i', 'j', 'k', 'm'], big)},
ac as (select *, greatest(ceil((length(x) - 1000) / 850.0)::bigint, 0) as last from aw {big}),
aa as (
  select id, i, 0 as j, 0 as k, 0 as m, 0 as n, x as t, 'r' as run, length(x) as adv from ap where length(x) < 1000
  union all select id, i, j, 0, 0, 0, x, 'r.' || i, length(x) from al where length(x) < 1000
  union all select id, i, j, k, 0, 0, x, 'r.' || i || '.' || j, length(x) from az where length(x) < 1000
  union all select id, i, j, k, m, 0, x, 'r.' || i || '.' || j || '.' || k, length(x) from aw where length(x) < 1000
  union all select id, i, j, k, m, n, substr(x, n * 850 + 1, 1000), 'r.' || i || '.' || j || '.' || k || '.' || m || '#' || n,
      case when n < last then 850 else length(x) - 850 * last end
    from (select *, unnest(range(0, last + 1)) as n from ac)),
ab as (select *, row_number() over w as q, coalesce(sum(adv) over (partition by id order by i, j, k, m, n
    rows between unbounded preceding and 1 preceding), 0) as s,
    case when run = lag(run) over w then 0 else 1 end as fresh from aa window w as (partition by id order by i, j, k, m, n)),
ad as (select id, q, s, s + length(t) as e, sum(fresh) over (partition by id order by q) as g from ab),
-- The atom that no longer fits a chunk starting at each atom.
ae as (select a.id, a.g, a.q, a.s, min(b.q) as nq from ad a left join ad b
    on b.id = a.id and b.g = a.g and b.q > a.q and b.e - a.s > 1000 and b.s - a.s <= 1000 group by 1, 2, 3, 4),
af as (select a.*, x.s as xs, x.e as xe from ae a left join ad x on x.id = a.id and x.q = a.nq),
ag as (select a.id, a.g, a.q, a.s, a.nq, a.xs, min(c.q) as jump from af a left join ad c
    on c.id = a.id and c.g = a.g and c.q > a.q and c.q <= a.nq and (c.q = a.nq or (a.xs - c.s <= 150 and a.xe - c.s <= 1000))
  group by all),
ah as (select id, g, min(q) as q, max(e) as ge from ad group by 1, 2),
walk as (select id, g, q, ge from ah
  union all select w.id, w.g, a.jump, w.ge from walk w join ag a on a.id = w.id and a.q = w.q where a.nq is not null),
aj as (select w.id, a.s, coalesce(a.xs, w.ge) as e from walk w join ag a on a.id = w.id and a.q = w.q),
ak as (select a.id, a.s, substr(z.x, a.s::bigint + 1, (a.e - a.s)::bigint) as c from aj a join a0 z on z.id = a.id),
ck as (select id as {key}, (s + length(c) - length(ltrim(c, {WS_LIT})))::bigint as start, {strip('c')} as chunk from ak
  where {strip('c')} <> '')"""
