"""DuckDB forms of the queries: a chain of common tables and a last select for each."""

from __future__ import annotations

import re
from dataclasses import fields

from lectern.functions import lines as L
from lectern.functions import phrases as P
from lectern.functions.text import LINE_END, d_n_words, d_strip, d_words, q
from lectern.operators import buckets as B
from lectern.operators.keyphrases import BREAK
from lectern.operators.pages import SEPARATOR
from lectern.plans.queries import MARKUP, NEAR, TEMPLATE, UNQUOTABLE
from lectern.schema import BUCKETS, RELATIONS
from lectern.settings import Settings
from lectern.sources.readers import HTML_BREAKS, HTML_ENTITIES, HTML_LEADS, HTML_SKIPPED

KEY = "doc_id, slide_id, page_number"


def _rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def _sub(x: str, pattern: str, by: str = "''", flags: str = "'g'") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, {flags})"


def _bar(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def _flat(*names: str) -> str:
    return ", ".join(f"{_bar(n)} as {n}, cast(len({n}) as bigint) as n_{n}" for n in names)


_HEADS = " or ".join(f"starts_with(s, {q(h)})" for h in B.NOT_BULLET)
_QUOTED = d_strip(_sub("s", r"^>\s*", flags="''"))
_SPLIT_CELLS = L.d_cells("s")
_ROW = f"list_transform({_SPLIT_CELLS}, lambda c: {L.d_strip_inline('c')})"

CHAIN: list[tuple[str, str]] = [
    ("docs", "select doc_id, text, lang, source from documents where text is not null"),
    ("slides", f"select printf('slide_%03d', doc_id) as slide_id, doc_id as page_number, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {MARKUP.format(l='l', i='(i - 1)')}), chr(10)) as raw_markdown, coalesce(source, '') as doc_id, lang from docs"),
    ("alllines", f"select doc_id, slide_id, page_number, lang, unnest(list_transform(ls, lambda l, i: {{'i': i - 1, 'l': l}})) as x from (select *, regexp_split_to_array(raw_markdown, {q(LINE_END)}) as ls from slides)"),
    ("lines", f"select * from (select {KEY}, lang, x.i as line_no, {d_strip('x.l')} as s from alllines) where s <> ''"),
    # notebook routing
    ("f0", f"select *, starts_with(s, '```') as is_fence, coalesce(sum(case when starts_with(s, '```') then 1 else 0 end) over (partition by {KEY} order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as in_fence from lines"),
    ("f1", f"select *, {_QUOTED} as quoted, case when is_fence then 'fence' when in_fence then (case when {L.d_prose_label('s')} then 'fence_label' else 'fence_code' end) when starts_with(s, '#') then 'heading' when starts_with(s, '>') then (case when starts_with({_QUOTED}, 'OCR:') then 'ocr' else 'caption' end) when {_rx('s', B.BULLET_NB)} and not ({_HEADS}) then 'bullet' when {_rx('s', L.DINGBAT_LED)} then 'beamer' when starts_with(s, '|') and s like '%|' then 'table' else 'body' end as kind from f0"),
    ("f2", f"select *, case kind when 'fence_label' then {L.d_unbulleted('s')} when 'heading' then {_sub('s', r'^#+\s*')} when 'caption' then quoted when 'ocr' then {d_strip('substr(quoted, 5)')} when 'bullet' then {_sub('s', B.BULLET_NB)} when 'beamer' then {_sub('s', L.BULLET, flags=chr(39) * 2)} else s end as raw from f1"),
    ("f3", f"select *, case when kind in ('fence_code', 'ocr', 'table', 'fence') then raw else {L.d_strip_inline('raw')} end as t0 from f2"),
    ("f4", f"select *, case when kind = 'beamer' then {d_strip(_sub('t0', L.BULLET, flags=chr(39) * 2))} else t0 end as t from f3"),
    ("f5", f"select *, t = '' or {L.d_noise('t')} as bad0 from f4"),
    ("f6", f"select *, not bad0 and kind in ('ocr', 'bullet', 'beamer', 'body') and {L.d_code('t')} as is_code, bad0 or (kind = 'ocr' and {L.d_ocr_noise('t')}) as bad from f5"),
    ("f7", f"select *, case when kind = 'fence' then 'fence' when kind = 'table' then 'table_cells' when bad then 'dropped' when kind = 'ocr' then (case when is_code then 'code_lines' when starts_with(t, '#') then 'headings' when {_rx('t', B.OCR_BULLET)} then 'bullets' when starts_with(t, '|') and t like '%|' then 'table_cells' else 'body_text' end) when kind = 'fence_code' or is_code then 'code_lines' when kind = 'heading' then 'headings' when kind = 'caption' then 'captions' when kind = 'body' then 'body_text' else 'bullets' end as bucket, case when kind = 'table' then {_ROW} else []::varchar[] end as row_ from f6"),
    (
        "routed",
        f"select {KEY}, line_no, s, kind, bucket, kind = 'ocr' as ocr, case when bucket in ('dropped', 'fence') then []::varchar[] when kind = 'table' then (case when {L.d_separator_row('row_')} or {L.d_header_row('row_')} then []::varchar[] else list_filter(row_, lambda c: c <> '' and not {L.d_noise('c')}) end) when kind = 'ocr' and bucket = 'table_cells' then (case when {_rx('t', B.OCR_RULE)} then []::varchar[] else {L.d_cells('t')} end) else list_filter([case when kind = 'ocr' and bucket = 'headings' then {d_strip(_sub('t', r'^#+\s*'))} when kind = 'ocr' and bucket = 'bullets' then {d_strip(_sub('t', L.BULLET, flags=chr(39) * 2))} else t end], lambda x: x <> '') end as items from f7",
    ),
    # backend routing
    ("b1", f"select *, case when starts_with(s, '#') then 'heading' when (starts_with(s, '-') or starts_with(s, '*')) and not ({_HEADS}) then (case when {_rx('s', B.BULLET_BE)} then 'bullet' else 'marked' end) when starts_with(s, '|') and s like '%|' then 'table' when starts_with(s, '>') then 'caption' else 'body' end as kind from lines"),
    ("b2", f"select *, case kind when 'heading' then {_sub('s', r'^#+\s*')} when 'bullet' then {_sub('s', B.BULLET_BE)} when 'caption' then {_sub('s', r'^>\s*')} else s end as raw from b1"),
    ("b3", f"select *, case when kind = 'table' then raw else {L.d_strip_inline('raw')} end as t, case when kind = 'table' then {_ROW} else []::varchar[] end as row_ from b2"),
    ("b4", f"select *, t = '' or {L.d_noise('t', 'backend')} as bad, kind = 'body' and {L.d_code('t', 'backend')} as is_code from b3"),
    ("routed_be", f"select {KEY}, line_no, s, kind, bucket, case when kind = 'table' then (case when {L.d_separator_row('row_')} then []::varchar[] else list_filter(row_, lambda c: c <> '' and not {L.d_noise('c', 'backend')}) end) when bucket = 'dropped' then []::varchar[] else [t] end as items, false as ocr from (select *, case when kind = 'table' then 'table_cells' when bad then 'dropped' when is_code then 'code_lines' when kind = 'heading' then 'headings' when kind = 'bullet' then 'bullets' when kind = 'caption' then 'captions' else 'body_text' end as bucket from b4)"),
]

_NAMES = (*BUCKETS, "code_lines")


def _content(routed: str) -> str:
    lists = ", ".join(f"coalesce(flatten(list(items order by line_no) filter (where bucket = '{b}')), []) as {b}" for b in _NAMES)
    cols = ", ".join(f"coalesce({b}, []::varchar[]) as {b}" for b in _NAMES)
    return f"select s.doc_id, s.slide_id, s.page_number, {cols}, coalesce(ocr_applied, false) as ocr_applied from slides s left join (select {KEY}, {lists}, bool_or(ocr) as ocr_applied from {routed} group by {KEY}) c on s.doc_id = c.doc_id and s.slide_id = c.slide_id and s.page_number = c.page_number"


def _resolve(triples: str, forms: str) -> str:
    cols = "t.* replace (coalesce(a.canonical, t.subject) as subject, coalesce(b.canonical, t.object) as object)"
    on = lambda x, end: f"{x}.doc_id = t.doc_id and {x}.slide_id = t.slide_id and {x}.page_number = t.page_number and {x}.form = t.{end}"
    return f"select * from (select {cols} from {triples} t left join {forms} a on {on('a', 'subject')} left join {forms} b on {on('b', 'object')}) where subject <> object"


_ALL = " || ".join(BUCKETS)
_SAID = f"coalesce(array_to_string({_ALL}, ' '), '')"
_ARTICLE = f"regexp_replace(x, {q('^[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+$')}, '', 'g')"
_GRAM = "array_to_string(list_slice(w, i, i + k - 1), ' ')"
_CELL = d_strip(_sub("c", BREAK, "' '"))
_LISTED = ", ".join(map(q, P.TOC_HEADINGS))
_PAIR_TEXT = (
    "list_transform(list_filter(list_transform(case when len(table_cells) >= 2 then range(1, len(table_cells), 2) else []::bigint[] end, "
    f"lambda i: {{'k': {_CELL.replace('(c,', '(table_cells[i],')}, 'v': {_CELL.replace('(c,', '(table_cells[i + 1],')}}}), "
    f"lambda p: p.k <> '' and p.v <> '' and not {L.d_noise('p.k')} and not {L.d_noise('p.v')}), lambda p: concat(p.k, ': ', p.v, '.'))"
)
_ODD = f"case when len(table_cells) % 2 = 1 then [{_CELL.replace('(c,', '(table_cells[len(table_cells)],')}] else []::varchar[] end"
_STOPS = ", ".join(map(q, P.STOP_WORDS))
_SENTENCE = "coalesce(list_filter(string_split(regexp_replace(clean_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), phrase))[1], left(clean_text, 200))"


def _hex(x: str, at: int) -> str:
    return f"(instr('0123456789abcdef', substr({x}, {at}, 1)) - 1)"

CHAIN += [
    ("content0", _content("routed")),
    ("content", f"select *, {d_strip(_SAID)} as clean_text from content0"),
    ("content_be", f"select *, {_SAID} as clean_text from ({_content('routed_be')})"),
    ("toc0", f"select *, coalesce({d_strip('lower(headings[1])')} in ({_LISTED}), false) or (len(body_text) = 0 and len(table_cells) = 0 and len(captions) = 0 and len(bullets) > 0 and list_sum(list_transform(bullets, lambda b: {d_n_words('b')})) / greatest(len(bullets), 1) <= 5 and {d_n_words('clean_text')} < 40) as toc, {d_n_words('clean_text')} as nw from content"),
    ("gate", "select *, not (page_number = 1 and nw < 40) and nw >= 8 and not toc as ok from toc0"),
    ("tt", f"select *, coalesce(array_to_string(headings, ' '), '') as heading, coalesce(array_to_string(body_text || bullets || captions, ' '), '') as prose, case when len(table_cells) > 0 and len(bullets) = 0 and len(body_text) = 0 then coalesce(array_to_string({_PAIR_TEXT} || {_ODD}, ' '), '') else coalesce(array_to_string(list_transform(table_cells, lambda c: {_sub('c', BREAK, chr(39) + ' ' + chr(39))}), ' '), '') end as tab from gate"),
    ("tr0", f"select *, case when tab <> '' then {d_strip('concat(prose, ' + q(' ') + ', tab)')} else prose end as rest from tt"),
    ("texts", f"select *, {d_strip(_sub(_sub('joined', '<[^>]+>', chr(39) + ' ' + chr(39)), r'\s{2,}', chr(39) + ' ' + chr(39)))} as text from (select *, case when heading <> '' and rest <> '' then {d_strip('concat(heading, ' + q('. ') + ', rest)')} when heading <> '' then heading else rest end as joined from tr0)"),
    ("lexicon", "select phrase, concat('L', cast(length(phrase) % 3 as varchar)) as label, cast(30 + 7 * (length(phrase) % 10) as double) / 100 as score from (select distinct unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as phrase from benchmark) where length(phrase) >= 5"),
    ("wordlists", f"select {KEY}, list_transform({d_words('lower(text)')}, lambda x: {_ARTICLE}) as w from texts where ok"),
    ("places", "select doc_id, slide_id, page_number, w, unnest(range(1, len(w) + 1)) as i from wordlists"),
    ("gramrows", f"select doc_id, slide_id, page_number, (i - 1) * 4 + k as ord, {_GRAM} as phrase from (select *, unnest(range(1, least(4, len(w) - i + 1) + 1)) as k from places)"),
    ("found", f"select g.doc_id, g.slide_id, g.page_number, g.ord, g.phrase, l.label, l.score from gramrows g join lexicon l on g.phrase = l.phrase where l.score >= 0.35 and {d_strip('g.phrase')} <> ''"),
    ("best", f"select {KEY}, phrase, max(score) as score, min(ord) as ord from (select {KEY}, {d_strip('lower(phrase)')} as phrase, score, ord from found) where {P.d_valid('phrase')} group by {KEY}, phrase"),
    ("placed", "select b.*, t.clean_text, case when len(list_filter(headings, lambda x: contains(lower(x), b.phrase))) > 0 then 'heading' when len(list_filter(bullets, lambda x: contains(lower(x), b.phrase))) > 0 then 'bullet' when len(list_filter(table_cells, lambda x: contains(lower(x), b.phrase))) > 0 then 'table' when len(list_filter(captions, lambda x: contains(lower(x), b.phrase))) > 0 then 'caption' else 'body' end as source_type from best b join texts t on b.doc_id = t.doc_id and b.slide_id = t.slide_id and b.page_number = t.page_number"),
    ("phrases", f"select * from (select *, row_number() over (partition by {KEY} order by score desc, ord) as rank from (select * replace (round(case when source_type = 'heading' then least(score + 0.15, 1.0) else score end, 4) as score) from placed)) where rank <= 25"),
    ("nextp", f"select *, lead(phrase) over (partition by {KEY} order by rank) as nxt from phrases"),
    ("onet", f"""select {KEY}, rank, concat('{{"subject": "', case when rank % 4 = 0 then concat(translate(phrase, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ') else phrase end, '", "relation": "', ([{", ".join(map(q, (*RELATIONS, "knows")))}])[rank % 9 + 1], '", "object": "', nxt, '", "evidence": "', case when rank % 3 = 1 then regexp_replace({_SENTENCE}, {q(UNQUOTABLE)}, ' ', 'g') else concat('of ', phrase) end, '", "confidence": ', case when rank % 11 = 10 then '"high"' else concat('0.', cast(60 + rank * 7 % 40 as varchar)) end, '}}') as t from nextp where nxt is not null"""),
    ("responses", f"""select {KEY}, case when page_number % 5 = 0 then concat('{{"note": "x", "triples": [', b, ']}}') when page_number % 17 = 0 then 'oops' else concat('[', b, ']') end as response from (select {KEY}, string_agg(t, ', ' order by rank) as b from onet group by {KEY})"""),
    ("jsons", f"select {KEY}, case when starts_with(response, '[') then response when starts_with(response, '{{') then json_extract(response, '$.triples')::varchar end as body from responses"),
    ("rawt", f"select {KEY}, i - 1 as ord, json_extract_string(x, '$.subject') as subject, json_extract_string(x, '$.relation') as relation, json_extract_string(x, '$.object') as object, json_extract_string(x, '$.evidence') as evidence, json_extract_string(x, '$.confidence') as confidence from (select {KEY}, js[i] as x, i from (select {KEY}, js, unnest(range(1, len(js) + 1)) as i from (select {KEY}, from_json(body, '[\"JSON\"]') as js from jsons where body is not null)))"),
    ("normt", f"select {KEY}, ord, {d_strip('lower(subject)')} as subject, {d_strip('relation')} as relation, {d_strip('lower(object)')} as object, {d_strip('evidence')} as evidence, coalesce(try_cast(confidence as double), 0) as confidence from rawt"),
    ("anchors", f"select distinct {KEY}, unnest([lower(phrase)] || list_filter([{P.d_without_parens('lower(phrase)')}, {P.d_without_calls('lower(phrase)')}], lambda x: length(x) >= 2)) as anchor from phrases"),
    ("anchored", f"select * from normt n where subject <> object and relation in ({', '.join(map(q, RELATIONS))}) and not {P.d_structural_label('subject')} and not {P.d_structural_label('object')} and exists (select 1 from anchors a where a.doc_id = n.doc_id and a.slide_id = n.slide_id and a.page_number = n.page_number and a.anchor = n.subject) and exists (select 1 from anchors a where a.doc_id = n.doc_id and a.slide_id = n.slide_id and a.page_number = n.page_number and a.anchor = n.object)"),
    ("forms", f"select {KEY}, form, arg_min(canonical, way * 1000000 + rank) as canonical from (select {KEY}, lower(phrase) as canonical, rank, unnest([0, 1, 1]) as way, unnest([lower(phrase), {P.d_without_parens('lower(phrase)')}, {P.d_without_calls('lower(phrase)')}]) as form from phrases) group by {KEY}, form"),
    ("resolvedt", _resolve("anchored", "forms")),
    ("said", "select distinct doc_id, slide_id, page_number, evidence, clean_text from normt join content using (doc_id, slide_id, page_number) where evidence <> ''"),
    ("bagwords", f"select t, unnest({d_words('lower(t)')}) as w from (select distinct evidence as t from said union select distinct clean_text from said)"),
    ("bags", f"select t, ({_hex('h', 1)} % 4) * 16 + {_hex('h', 2)} as d, sum(case when {_hex('h', 4)} % 2 = 1 then 1 else -1 end)::double as v from (select t, sha256(w) as h from bagwords) group by t, d"),
    ("sizes", "select t, sum(v * v) as n from bags group by t"),
    ("dots", "select s.evidence, s.clean_text, sum(a.v * b.v) as dot from (select distinct evidence, clean_text from said) s join bags a on a.t = s.evidence join bags b on b.t = s.clean_text and b.d = a.d group by s.evidence, s.clean_text"),
    ("sims", "select s.doc_id, s.slide_id, s.page_number, s.evidence, case when x.n > 0 and y.n > 0 then coalesce(dot, 0) / (sqrt(x.n) * sqrt(y.n)) end as similarity from said s left join sizes x on x.t = s.evidence left join sizes y on y.t = s.clean_text left join dots p on p.evidence = s.evidence and p.clean_text = s.clean_text"),
    ("poort", f"select {KEY}, bool_and(score = 0.4) as fallback from phrases group by {KEY}"),
    ("passedt", "select r.* from resolvedt r join sims using (doc_id, slide_id, page_number, evidence) left join poort using (doc_id, slide_id, page_number) where confidence >= 0.7 and evidence <> '' and similarity >= case when coalesce(fallback, false) then 0.5 else 0.65 end"),
    ("paired", f"select * from (select {KEY}, ord, subject, object, confidence from normt union all select {KEY}, ord + 1000, object, concat(subject, ' of it'), confidence from normt union all select {KEY}, ord + 2000, subject, object, confidence + 0.01 * (ord % 3 - 1) from normt) where subject <> object"),
    ("grams", "select distinct case i % 8 when 0 then concat('to ', p) when 1 then concat(p, '(', p, ')') when 2 then concat('summary ', p, ' 1/2') when 3 then concat(p, '{5}') when 4 then concat('this ', p) when 5 then concat(p, '()') when 6 then '12, 3.4' else p end as p from (select i, array_to_string(list_slice(w, i, i + k - 1), ' ') as p from (select w, i, unnest(range(1, 6)) as k from (select w, unnest(range(1, len(w) + 1)) as i from (select regexp_split_to_array(lower(text), ' +') as w from benchmark))))"),
    ("chunk0", f"select {KEY}, list_filter(list_transform(string_split(array_to_string(list_transform({d_words(_sub('lower(text)', r'[^\p{L}\p{N}\s_-]+', chr(39) + ' | ' + chr(39)))}, lambda w: case when w in ('|', {_STOPS}) then '|' else w end), ' '), '|'), lambda x: {d_strip('x')}), lambda x: x <> '') as parts from texts where ok"),
    ("chunks", f"select {KEY}, chunk, min(i - 1) as ord from (select {KEY}, i, {P.d_clean('raw')} as chunk from (select {KEY}, i, parts[i] as raw from (select *, unnest(range(1, len(parts) + 1)) as i from chunk0)) where len({d_words('raw')}) <= 4) where length(chunk) >= 3 and not regexp_matches(chunk, '^\\d') group by {KEY}, chunk"),
    ("strings", "select distinct p from (select p from grams union all select phrase from found union all select chunk from chunks union all select subject from rawt union all select object from rawt) where p is not null"),
    ("gwords", f"select distinct {d_strip('lower(p)')} as p from strings where {d_strip('lower(p)')} <> ''"),
    ("gpairs", "select p, unnest([{'way': 0, 'o': p}, {'way': 1, 'o': string_split(p, ' ')[1]}, {'way': 2, 'o': coalesce(array_to_string(list_transform(list_filter(string_split(regexp_replace(p, '[^a-z ]', '', 'g'), ' '), lambda w: w <> ''), lambda w: w[1]), ''), '')}, {'way': 3, 'o': concat('x', p)}]) as x from gwords"),
    ("vecs", "select label, vec_id, embedding::double[] as v from embeddings"),
    ("firstv", "select label, arg_min(v, vec_id) as f from vecs group by label"),
    ("cosines", "select vec_id, list_cosine_similarity(v, f) as c from vecs join firstv using (label)"),
    ("deckpages", "select lang as doc_id, row_number() over (partition by lang order by text, doc_id) as page_number, text as raw_markdown from docs where lang is not null"),
    ("decks", "select doc_id, list({'p': page_number, 'w': list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(raw_markdown), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> ''))} order by page_number) as xs from deckpages group by doc_id"),
    ("neardup", "select doc_id, unnest(list_reduce(xs, lambda acc, x: case when len(x.w) >= 5 and len(list_filter(acc[-2:], lambda k: len(k.w) > 0 and len(list_intersect(k.w, x.w)) / greatest(len(list_distinct(k.w || x.w)), 1) >= 0.5)) > 0 then acc else list_append(acc, x) end, xs[1:0])) as x from decks"),
    ("loaded0", "select coalesce(source, '') as doc_id, doc_id as page_number, string_split(text, chr(10)) as ls from docs"),
    ("loaded", "select doc_id, page_number, [ls[1]] as headings, ['{4}', ls[1], concat(ls[1], ' and more')] || list_transform(ls, lambda l, i: case when (i - 1) % 3 = 1 then concat(l, ';') else l end) as body, list_transform(ls, lambda l, i: case when (i - 1) % 2 = 0 then concat(' ◮ - ', l) when (i - 1) % 5 = 1 then '•  ' else l end) as bul from loaded0"),
    ("fixed0", f"select doc_id, page_number, headings, {d_strip('lower(headings[1])')} as h, list_filter(list_transform(bul, lambda x: {d_strip(_sub('x', B.BULLET_LEAD, flags=chr(39) * 2))}), lambda x: x <> '') as bullets, body from loaded"),
    ("fixed1", f"select *, list_filter(list_transform(list_filter(body, lambda x: not regexp_matches({d_strip('x')}, '^\\{{\\d+\\}}$') and {d_strip('lower(x)')} <> h), lambda x: case when starts_with({d_strip('lower(x)')}, concat(h, ' ')) or starts_with({d_strip('lower(x)')}, concat(h, chr(9))) then {d_strip('substr(x, length(h) + 1)')} else x end), lambda x: x <> '') as kept from fixed0"),
    ("fixed", f"select doc_id, page_number, headings, bullets, list_filter(kept, lambda x: not {L.d_code(d_strip('x'), 'backend')}) as body_text, list_filter(kept, lambda x: {L.d_code(d_strip('x'), 'backend')}) as code_lines from fixed1"),
]


def _filtered(content: str, names: tuple[str, ...], least: int) -> str:
    every = " || ".join(names)
    noise = f"select doc_id, block from (select doc_id, block, count(*) as n from (select doc_id, slide_id, unnest(list_distinct({every})) as block from {content}) group by doc_id, block) join (select doc_id, count(*) as total from {content} group by doc_id) using (doc_id) where total >= {least} and n > total * 0.04"
    lists = f"select doc_id, list(block) as bad from ({noise}) group by doc_id"
    cols = ", ".join(f"list_filter(c.{n}, lambda x: not coalesce(list_contains(b.bad, x), false)) as {n}" for n in names)
    return f"select doc_id, page_number, {_flat(*names)} from (select c.doc_id, c.page_number, {cols} from {content} c left join ({lists}) b using (doc_id))"


def _flags(flag: str) -> str:
    return f"select lang, count(*) filter (where {flag}) as flagged, count(*) as n_lines from (select lang, s, list_filter(list_transform(string_split(s, '|'), lambda x: {d_strip('x')}), lambda x: x <> '') as row_ from lines) group by lang"


def _items(kinds: str, routed: str = "routed") -> str:
    return f"select doc_id, page_number, line_no, bucket, {_bar('items')} as items, cast(len(items) as bigint) as n_items from {routed} where kind in ({kinds})"


def selects() -> dict[str, str]:
    low = d_strip("lower(p)")
    empty = d_strip("raw_markdown")
    t1 = _sub(_sub(_sub("line_", r"!\[.*?\]\(.*?\)"), r"\{\d+\}"), r"[#>\-*|]")
    dp = f"select * from (select *, min(ord) over (partition by {KEY}, subject, object) as place, row_number() over (partition by {KEY}, subject, object order by confidence desc, ord) as rn from {{src}}) where rn = 1"
    paired = dp.format(src="paired")
    clash = f"({P.d_synonyms('x.subject', 'k.subject')} and {P.d_synonyms('x.object', 'k.object')}) or ({P.d_synonyms('x.subject', 'k.object')} and {P.d_synonyms('x.object', 'k.subject')})"

    def sem(src: str) -> str:
        return f"select {KEY}, unnest(list_reduce(xs, lambda acc, x: case when len(list_filter(acc, lambda k: {clash})) > 0 then acc else list_append(acc, x) end, xs[1:0])) as x from (select {KEY}, list({{'subject': subject, 'object': object, 'confidence': confidence, 'relation': relation_}} order by confidence desc, place, subject, object) as xs from (select *, {'relation' if src == 'passedt' else chr(39) * 2} as relation_ from ({dp.format(src=src)})) group by {KEY})"

    p = "doc_id, page_number"
    return {
        "pg_split": f"select source as doc_id, i as page_number, {d_strip('parts[i]')} as raw_markdown from (select source, parts, unnest(range(1, len(parts) + 1)) as i from (select source, string_split(string_agg(text, {q(SEPARATOR)} order by doc_id), {q(SEPARATOR)}) as parts from docs group by source))",
        "src_pdf_dl": f"select doc_id, i as page_number, {d_strip(f'coalesce(parts[i], {q(str())})')} as raw_markdown from (select doc_id, parts, unnest(range(1, doc_id % 4 + 1)) as i from (select doc_id, string_split(concat(text, {q(SEPARATOR)}, lang), {q(SEPARATOR)}) as parts from docs))",
        "src_ocr": f"select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_strip('x')}), lambda x: x <> ''), lambda x: concat('> OCR: ', x)), chr(10)) as ocr from documents",
        "pg_collapse_blank": "select doc_id, regexp_replace(replace(text, '. ', '.' || repeat(chr(10), 4)), '\\n{3,}', chr(10) || chr(10), 'g') as t from documents",
        "pg_is_empty": f"select {p}, count(*) filter (where length({d_strip(t1)}) < 10) as n_empty, count(*) as n from (select {p}, {d_strip('x.l')} as line_ from alllines) group by {p}",
        "pg_word_set": f"select {p}, cast(len(w) as bigint) as n, array_to_string(list_sort(w), ' ') as words from (select {p}, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(raw_markdown), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> '')) as w from slides)",
        "pg_near_dup": "select doc_id, x.p as page_number from neardup",
        "pg_emit": f"select slide_id, page_number, regexp_replace(raw_markdown, '\\n{{3,}}', chr(10) || chr(10), 'g') as raw_markdown, doc_id from slides where {empty} <> ''",
        "pg_counts": f"select a.doc_id, n_pages, n_empty, n_ocr, n_kept, n_pages - n_kept as n_skipped from (select doc_id, count(*) as n_pages, count(*) filter (where length({d_strip(t1.replace('line_', empty))}) < 10) as n_empty, count(*) filter (where starts_with(raw_markdown, '> OCR:')) as n_ocr from deckpages group by doc_id) a join (select doc_id, count(*) as n_kept from neardup group by doc_id) b using (doc_id)",
        "ln_noise_nb": _flags(L.d_noise("s")),
        "ln_noise_be": _flags(L.d_noise("s", "backend")),
        "ln_code_nb": _flags(L.d_code("s")),
        "ln_code_be": _flags(L.d_code("s", "backend")),
        "ln_ocr_noise": _flags(L.d_ocr_noise("s")),
        "ln_prose_label": _flags(L.d_prose_label("s")),
        "ln_bullet_re": _flags(_rx("s", L.BULLET)),
        "ln_header_row": _flags(L.d_header_row("row_")),
        "ln_sep_row": _flags(L.d_separator_row("row_")),
        "ln_strip_inline": f"select {p}, line_no, {L.d_strip_inline('s')} as t from lines",
        "bk_lines": f"select {p}, line_no, s from lines",
        "bk_fence": _items("'fence', 'fence_label', 'fence_code'"),
        "bk_heading": _items("'heading'"),
        "bk_blockquote": _items("'caption', 'ocr'"),
        "bk_ocr": _items("'ocr'"),
        "bk_bullet": _items("'bullet'"),
        "bk_beamer": _items("'beamer'"),
        "bk_table": _items("'table'"),
        "bk_body": _items("'body'"),
        "bk_backend_order": _items("'heading', 'bullet', 'marked', 'table', 'caption', 'body'", "routed_be"),
        "bk_collect": f"select {p}, ocr_applied, clean_text, {_flat(*_NAMES)} from content",
        "bucket_counts": "select doc_id, bucket, count(*) as n_lines, cast(sum(len(items)) as bigint) as n_items from routed group by doc_id, bucket",
        "xs_filter_nb": _filtered("content", BUCKETS, 5),
        "xs_filter_be": _filtered("content_be", _NAMES, 2),
        "as_clean_text": f"select {p}, clean_text from content",
        "as_content": f"select {p} from content where {d_strip('clean_text')} <> ''",
        "as_content_be": f"select {p} from content_be where len(bullets) >= 2 or length({d_strip('clean_text')}) > 200",
        "as_stats": f"select {KEY}, " + ", ".join(f"cast(len({v}) as bigint) as {k}" for k, v in (("n_headings", "headings"), ("n_bullets", "bullets"), ("n_table_cells", "table_cells"), ("n_captions", "captions"), ("n_body", "body_text"))) + ", length(clean_text) as clean_text_len from content",
        "as_deck_stats": f"select doc_id, count(*) as n_slides, count(*) filter (where {d_strip('clean_text')} <> '') as n_content, count(*) filter (where ocr_applied) as n_ocr, count(*) filter (where len(bullets) > 0) as n_bullet_slides from content group by doc_id",
        "ld_rebuild": f"select {p}, array_to_string(headings || body_text || bullets, ' ') as clean_text, {_flat('body_text', 'bullets', 'code_lines')} from fixed",
        "ld_page_ref": f"select {p}, {_flat('body_text')} from fixed",
        "ld_bullet_lead": f"select {p}, {_flat('bullets')} from fixed",
        "ld_heading_dedup": f"select {p}, {_flat('body_text')} from fixed",
        "ld_code_route": f"select {p}, {_flat('code_lines')} from fixed",
        "kp_pedagogical": f"select {p}, ok from gate",
        "kp_toc": f"select {p}, toc from gate",
        "kp_text_nb": f"select {p}, text as t from texts",
        "kp_text_be": f"select {p}, case when heading <> '' and rest <> '' then {d_strip('concat(heading, ' + q('. ') + ', rest)')} else concat(heading, rest) end as t from (select {p}, coalesce(array_to_string(headings, ' '), '') as heading, coalesce(array_to_string(list_filter(body_text || bullets, lambda x: not {L.d_code(d_strip('x'), 'backend')}) || captions || table_cells, ' '), '') as rest from content_be)",
        "kp_ner": f"select {p}, ord, phrase, label, score from found",
        "kp_max_score": f"select {p}, phrase, score, ord from best",
        "kp_label_dist": "select label, count(*) as n from found group by label",
        "kp_clean": f"select p, {P.d_clean('p')} as cleaned from strings",
        "kp_valid": f"select p, {P.d_valid(low)} as ok from strings",
        "kp_label": f"select p, {P.d_slide_label(low)} as ok from strings",
        "kp_linguistic": f"select p, length(p) >= 3 and len(list_filter({d_words('p')}, lambda w: w not in ({_STOPS}))) > 0 as ok from strings",
        "kp_noun_chunks": f"select {p}, chunk, ord from chunks",
        "kp_chunk_xval": "select b.doc_id, b.page_number, b.phrase from best b where exists (select 1 from chunks c where c.doc_id = b.doc_id and c.slide_id = b.slide_id and c.page_number = b.page_number and c.chunk = b.phrase)",
        "kp_source_type": f"select {p}, phrase, source_type from phrases",
        "kp_boost": f"select {p}, phrase, score from phrases",
        "kp_sentence": f"select {p}, phrase, {_SENTENCE} as appears_in from phrases",
        "kp_limit": f"select {p}, phrase, rank from (select *, row_number() over (partition by {KEY} order by score desc, ord) as rank from best) where rank <= 3",
        "kp_topk": f"select {p}, phrase, score from (select *, row_number() over (partition by {KEY} order by score desc, ord) as rank from best) where rank <= 4 and score >= 0.5",
        "kp_stats": "select doc_id, coalesce(n_phrases, 0) as n_phrases, n_slides, round_even(coalesce(n_phrases, 0) / n_slides, 4) as mean_phrases from (select doc_id, count(*) as n_slides from content group by doc_id) left join (select doc_id, count(*) as n_phrases from phrases group by doc_id) using (doc_id)",
        "kp_top": f"select {p}, count(*) as n_phrases, array_to_string(list(phrase order by rank)[1:3], ', ') as top3, array_to_string(list(phrase order by rank)[1:5], ', ') as top5 from phrases group by {p}",
        "kp_score_cos": "select vec_id, round(c, 4) as score from cosines",
        "kp_dedup": f"select cast(label as varchar) as doc_id, x.id as vec_id from (select label, unnest(list_reduce(xs, lambda acc, x: case when len(list_filter(acc, lambda k: list_cosine_similarity(k.v, x.v) >= {NEAR})) > 0 then acc else list_append(acc, x) end, xs[1:0])) as x from (select label, list({{'id': vec_id, 'v': v}} order by vec_id) as xs from vecs group by label))",
        "kp_fallback": f"select {p}, phrase, score from (with n as (select {KEY}, count(*) as n from best group by {KEY}), poor as (select t.doc_id, t.slide_id, t.page_number from texts t left join n on n.doc_id = t.doc_id and n.slide_id = t.slide_id and n.page_number = t.page_number where t.ok and coalesce(n.n, 0) <= 3 and {d_n_words('t.text')} >= 20) select b.doc_id, b.slide_id, b.page_number, b.phrase, b.score from best b anti join poor o on b.doc_id = o.doc_id and b.slide_id = o.slide_id and b.page_number = o.page_number union all select c.doc_id, c.slide_id, c.page_number, {d_strip('lower(c.chunk)')}, 0.4 from chunks c semi join poor o on c.doc_id = o.doc_id and c.slide_id = o.slide_id and c.page_number = o.page_number where {P.d_valid(d_strip('lower(c.chunk)'))})",
        "tr_prompt": f"select c.doc_id, c.page_number, replace(replace({q(TEMPLATE)}, '{{keyphrases}}', k), '{{slide_text}}', clean_text) as prompt from content c join (select {KEY}, string_agg(concat('- ', phrase), chr(10) order by rank) as k from phrases group by {KEY}) f on c.doc_id = f.doc_id and c.slide_id = f.slide_id and c.page_number = f.page_number",
        "tr_parse": f"select {p}, ord, subject, relation, object, evidence, confidence from rawt",
        "tr_normalize": f"select {p}, ord, subject, relation, object, evidence, confidence from normt",
        "tr_anchor_set": f"select p, array_to_string(list_sort(list_distinct([p] || list_filter([{P.d_without_parens('p')}, {P.d_without_calls('p')}], lambda x: length(x) >= 2))), '|') as anchors from strings",
        "tr_anchor": f"select {p}, ord, subject, object from anchored",
        "tr_label": f"select p, {P.d_structural_label(low)} as ok from strings",
        "tr_confidence": f"select {p}, ord, confidence from normt where confidence >= 0.7",
        "tr_evidence": "select vec_id from cosines where c >= case when vec_id % 2 = 0 then 0.15 else 0.3 end",
        "tr_validate_all": f"select {p}, ord, subject, relation, object, evidence, confidence from passedt",
        "tr_pair_dedup": f"select {p}, subject, object, confidence, ord, place from ({paired})",
        "tr_synonym": f"select p, cast(x.way as bigint) as way, x.o as o, {P.d_synonyms('p', 'x.o')} as same from gpairs",
        "tr_sem_dedup": f"select {p}, x.subject as subject, x.object as object, x.confidence as confidence from ({sem('paired')})",
        "tr_rel_dist": "select relation, count(*) as n from passedt group by relation",
        "tr_stats": f"select doc_id, n_slides, n_slides - coalesce(n_busy, 0) as n_skipped, coalesce(n_raw, 0) as n_raw, coalesce(n_passed, 0) as n_passed, coalesce(n_kept, 0) as n_kept, case when coalesce(n_raw, 0) > 0 then round_even(coalesce(n_passed, 0) / n_raw, 4) else 0.0 end as pass_rate from (select doc_id, count(*) as n_slides from content group by doc_id) left join (select doc_id, count(*) as n_raw, count(distinct slide_id) as n_busy from rawt group by doc_id) using (doc_id) left join (select doc_id, count(*) as n_passed from passedt group by doc_id) using (doc_id) left join (select doc_id, count(*) as n_kept from ({dp.format(src='passedt')}) group by doc_id) using (doc_id)",
        "tr_resolve": _resolved_strings(),
        "src_cache": "select doc_id, sha256(text) as sha from docs d where not exists (select 1 from docs e where e.lang = 'en' and e.text = d.text)",
        "src_upload": "select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) as stem from pages",
        "snk_step2_stats": "",
        "snk_step3": f"select {p}, string_agg(phrase, '|' order by rank) as phrases from phrases group by {p}",
        "snk_step4_report": f"select c.doc_id, c.page_number, k as keyphrases, coalesce(r.n, 0) as raw_count, coalesce(v.n, 0) as validated_count from content c left join (select {p}, string_agg(phrase, '|' order by rank) as k from phrases group by {p}) f using ({p}) left join (select {p}, count(*) as n from rawt group by {p}) r using ({p}) left join (select {p}, count(*) as n from passedt group by {p}) v using ({p})",
        "edges": f"select doc_id, slide_id, x.subject as subject, x.relation as relation, x.object as object, x.confidence as confidence, 'extraction' as source from ({sem('passedt')})",
        "vertices": "select doc_id, name, count(*) as degree from (select doc_id, subject as name from passedt union all select doc_id, object from passedt) group by doc_id, name",
    }


def _resolved_strings() -> str:
    """Strings as phrases: of a string's bare form, itself if it is a string, else the first string with that bare form."""
    named = "select 'd' as doc_id, left(p, 2) as slide_id, 1 as page_number, p as phrase, row_number() over (partition by left(p, 2) order by p) as rank from strings where p <> ''"
    forms = f"select {KEY}, form, arg_min(canonical, way * 1000000000 + rank) as canonical from (select {KEY}, lower(phrase) as canonical, rank, unnest([0, 1, 1]) as way, unnest([lower(phrase), {P.d_without_parens('lower(phrase)')}, {P.d_without_calls('lower(phrase)')}]) as form from named) group by {KEY}, form"
    raw = f"select {KEY}, rank, {P.d_without_parens('lower(phrase)')} as subject, 'zzz' as object from named"
    return f"select slide_id, rank, subject from (with named as ({named}), nforms as ({forms}), nraw as ({raw}) {_resolve('nraw', 'nforms')})"


def _html() -> str:
    t = _sub("html", HTML_SKIPPED)
    for tag, lead in HTML_LEADS:
        t = _sub(t, rf"(?is)<{tag}\b[^>]*>", f"chr(10) || {q(lead)}")
    t = _sub(_sub(t, HTML_BREAKS, "chr(10)"), r"<[^>]*>", "' '")
    for name, char in HTML_ENTITIES:
        t = f"replace({t}, {q(name)}, {q(char)})"
    return d_strip(_sub(_sub(t, r"[ \t]+", "' '"), r" ?\n[ \n]*", "chr(10)"))


def _step3() -> str:
    """Phrases of rich slides, and of poor ones what the splitter offers."""
    p = "doc_id, page_number"
    kind = "case when len(list_filter(headings, lambda x: contains(lower(x), phrase))) > 0 then 'heading' when len(list_filter(bullets, lambda x: contains(lower(x), phrase))) > 0 then 'bullet' when len(list_filter(table_cells, lambda x: contains(lower(x), phrase))) > 0 then 'table' when len(list_filter(captions, lambda x: contains(lower(x), phrase))) > 0 then 'caption' else 'body' end"
    low = d_strip("lower(c.chunk)")
    n = f"select {KEY}, count(*) as n from best group by {KEY}"
    poor = f"select t.* from texts t left join n on n.doc_id = t.doc_id and n.slide_id = t.slide_id and n.page_number = t.page_number where t.ok and coalesce(n.n, 0) <= 3 and {d_n_words('t.text')} >= 20"
    own = f"select {KEY}, phrase, round(case when source_type = 'heading' then least(score + 0.15, 1.0) else score end, 4) as score, source_type, {_SENTENCE} as appears_in, ord from placed b anti join poor o using ({KEY})"
    more = f"select {KEY}, phrase, 0.4 as score, {kind} as source_type, {_SENTENCE} as appears_in, ord from (select o.*, {low} as phrase, c.ord from chunks c join poor o using ({KEY}) where {P.d_valid(low)})"
    return f"select {p}, phrase, score, source_type, appears_in, rank from (with n as ({n}), poor as ({poor}), every as ({own} union all {more}) select *, row_number() over (partition by {KEY} order by score desc, ord) as rank from every) where rank <= 25"


def _settings() -> str:
    rows = [(p, f.name, str(getattr(Settings.of(p), f.name))) for p in ("notebook", "backend") for f in fields(Settings) if f.name != "profile"]
    return "select * from (values " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in rows) + ") t(profile, field, value)"


def _io() -> dict[str, str]:
    """What comes back from sinks and readers is what went in, repaired by the loader where it does that."""
    p = "doc_id, page_number"
    pdf = "select doc_id, sha256(body) as sha, unnest(range(1, len(string_split(body, chr(12))) + 1)) as page_number, string_split(body, chr(12)) as parts from (select concat('d', doc_id) as doc_id, replace(text, '. ', '. ' || chr(12)) as body from docs)"
    md = d_strip("regexp_replace(parts[page_number], '\\n{3,}', chr(10) || chr(10), 'g')")
    return {
        "src_settings": _settings(),
        "src_html": f"select page_id, {_html()} as markdown from pages",
        "src_pdf_text": f"select * from (select doc_id, sha, page_number, {md} as raw_markdown from ({pdf})) where raw_markdown <> ''",
        "src_parsed_json": "select slide_id, page_number, raw_markdown, 'deck' as doc_id from slides",
        "src_preprocessed_json": f"select printf('slide_%03d', page_number) as slide_id, page_number, 'deck' as doc_id, array_to_string(headings || body_text || bullets, ' ') as clean_text, {_flat('body_text', 'bullets', 'code_lines')} from fixed",
        "snk_step1": "select doc_id, slide_id, page_number, raw_markdown from slides",
        "snk_step2": f"select {p}, clean_text, {_bar('bullets')} as bullets, cast(len(headings) as bigint) as n_headings, length(clean_text) as clean_text_len from content",
        "snk_md_files": "select case when doc_id = '' then 'none' else doc_id end as doc_id, slide_id, concat(raw_markdown, chr(10)) as value from slides",
        "kp_step3": _step3(),
        "tr_similarity": f"select {p}, evidence, round(similarity, 9) as similarity from sims",
    }


def oracle_sql() -> dict[str, str]:
    out = selects() | _io()
    p = "doc_id, page_number"
    kept = f"select {p}, count(*) as n, string_agg(concat_ws('>', subject, relation, object), '|' order by subject, relation, object) as triples from (select *, cast(replace(slide_id, 'slide_', '') as bigint) as page_number from ({out['edges']})) group by {p}"
    out["snk_step4"] = f"select c.doc_id, c.page_number, coalesce(r.n, 0) as raw_count, coalesce(r.n, 0) as n_raw, coalesce(k.n, 0) as validated_count, k.triples as triples from content c left join (select {p}, count(*) as n from rawt group by {p}) r using ({p}) left join ({kept}) k using ({p})"
    out["snk_step2_stats"] = out["as_stats"].replace("slide_id, ", "")
    out["tr_llm"] = f"select doc_id, page_number, response from (select distinct {KEY} from phrases) left join responses using ({KEY})"
    return {k: _whole(v) for k, v in out.items()}


def _whole(last: str) -> str:
    tables = ", ".join(f"{n} as ({s})" for n, s in _needed(last))
    return f"with {tables} {last}" if tables else last


def _needed(last: str) -> list[tuple[str, str]]:
    """The tables of the chain that a select needs, in order."""
    need, kept = set(re.findall(r"\w+", last)), []
    for name, body in reversed(CHAIN):
        if name in need:
            need |= set(re.findall(r"\w+", body))
            kept.append((name, body))
    return kept[::-1]


