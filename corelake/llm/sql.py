"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": op6(), "op7_decontamination": op7(), "op11_embedding_dedup": op11(), "op12_ranked_search": op12()}


def pattern(items: list) -> str:
    """A parsed license template as a regular expression over words that each end with a space."""
    out = ""
    for item in items:
        if isinstance(item, bytes):
            out += item.decode() + " "
        elif item[0] == "optional":
            out += f"(?:{pattern(item[1])})?"
        elif item[0] == "choice":
            out += f"(?:{'|'.join(pattern(x) for x in item[1])})"
        elif item[2] is None:
            out += "(?:[^ ]+ )" + "*+"[bool(item[1])]
        else:
            out += f"(?:.{{1,{item[2]}}} )" + "?"[bool(item[1]) :]
    return out


def op6() -> str:
    """Phrases by comparison of words; templates and declarations by regular expressions over the text's words."""
    from . import licenses

    def trimmed(template: str) -> list:
        items = licenses.parsed(template)
        skips = lambda x: isinstance(x, tuple) and (x[0] == "optional" or x[0] == "any")
        while skips(items[0]):
            items.pop(0)
        while isinstance(items[-1], tuple) and items[-1][0] == "any":
            items.pop()
        return items

    places = [f"list_transform(list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()}), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in licenses.PHRASES.items()]
    whole = ", ".join(f"case when regexp_matches(s, ' {pattern(trimmed(t))}') then '{label}' end" for label, t in licenses.TEMPLATES.items())
    denied = "|".join(sorted(x.decode() for x in licenses._DENIALS))
    named = ", ".join(
        f"case when len(list_filter(regexp_extract_all(s, ' ((?:[^ ]+ ){{0,3}}){pattern(trimmed(t))}', 1), lambda p: not regexp_matches(' ' || p, ' (?:{denied}) '))) > 0 then '{label}' end" for label, t in licenses.DECLARATIONS.items()
    )
    return f"""
with d as (select doc_id, {_WORDS} as w, ' ' || array_to_string(w, ' ') || ' ' as s from documents),
p as (select *, list_concat({places[0]}, list_concat({places[1]}, list_concat({places[2]}, {places[3]}))) as places from d),
l as (select *, list_transform(places, lambda x: x.label) as base, list_filter([{whole}], lambda x: x is not null) as whole, list_filter([{named}], lambda x: x is not null) as named from p)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(places) as bigint) as n_base,
  cast(list_min(list_transform(places, lambda x: x.at)) as bigint) as first_word, cast(list_max(list_transform(places, lambda x: x.at)) as bigint) as last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, list_concat(whole, named)))), ','), '') as labels,
  cast(case when len(whole) > 0 then 1 when len(named) > 0 then 0.75 when len(base) > 0 then 0.5 else 0 end as double) as score
from l"""


def op7(window: int = 13) -> str:
    """Windows of each item joined with the windows of each document, by their words."""
    return f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where text is not null),
pattern as (
  select distinct item_id, least(len(w), {window}) as size, array_to_string(w[s:s + least(len(w), {window}) - 1], ' ') as words
  from i, unnest(range(1, greatest(2, len(w) - {window} + 2))) as u(s) where len(w) > 0),
sizes as (select distinct size from pattern),
place as (
  select doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') as words
  from d, sizes, unnest(range(1, len(w) - size + 2)) as u(s) where len(w) >= size),
found as (select doc_id, s, size, item_id from place join pattern using (size, words)),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + size)) as p from (select distinct doc_id, s, size from found)) group by 1),
own as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, cast(item_id as varchar) as item_id from found where item_id is not null) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
  cast(coalesce(own.n, 0) as bigint) as n_items, sha256(coalesce(own.items, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join own using (doc_id)"""


def op12(k: int = 20) -> str:
    """Scores of every document that shares a term with an item, in whole numbers."""
    return f"""
with d as (select doc_id, row_number() over () as row, {_WORDS} as w from documents),
size as (select row, doc_id, len(w) as n from d where len(w) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from size),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_WORDS}) as term from (select distinct item_id, text from benchmark where text is not null)) group by 1, 2),
tf as (select row, term, count(*) as tf from (select row, unnest(w) as term from d) where term in (select term from q) group by 1, 2),
weight as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, total group by 1),
impact as (
  select row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) as impact
  from tf join size using (row) join weight using (term), total),
score as (select item_id, row, any_value(doc_id) as doc_id, cast(sum(times * impact) as bigint) as score from q join impact using (term) group by 1, 2)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score where score > 0) where rank <= {k}"""


def op11(cosine: float = 0.98) -> str:
    """Every pair of vectors of a label, and what links reach by recursion."""
    return f"""
with recursive v as (
  select row_number() over () as row, vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.row as i, b.row as j from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.row <> b.row where list_cosine_similarity(a.e, b.e) >= {cosine}),
reach as (select row as i, row as j from v union select reach.i, link.j from reach join link on reach.j = link.i),
least as (select i, min(vec_id) as component_id from reach join v on v.row = j group by 1),
degree as (select i, count(*) as n_links from link group by 1)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from v join least on least.i = v.row left join degree on degree.i = v.row
union all
select vec_id, 0, vec_id, true from embeddings
where vec_id is null or label is null or embedding is null or len(embedding) = 0
  or len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0"""
