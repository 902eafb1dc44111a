"""Document and retrieval queries: elements, chunks, dense and lexical search, fusion, gates, verification.

Chunks are the lines of ``documents``; questions are the ``benchmark`` items; dense search runs over ``embeddings``,
each vector against all others.
"""

from __future__ import annotations

from collections.abc import Callable

from basalt.plans.dialect import Dialect

CANDIDATES, TOP = 18, 6
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
MIN_TERM, CONTAINED = 4, 0.6
WINDOW, STEP, HEADING = 800, 680, 40  # characters of a fixed chunk and between two; a shorter line heads a section
MAX_LINES = 1000  # from here on two lines of a document get one chunk_id


def doc(d: Dialect) -> str:
    """A document's id in a chunk's; Spark's concat makes null of a null, DuckDB's leaves it out."""
    return "coalesce(cast(doc_id as string), '')" if d.spark else "cast(doc_id as string)"


def lines(d: Dialect) -> str:
    """chunks: one a non-blank line, numbered within the document."""
    if d.spark:
        cut = "select doc_id, source, lang, pos + 1 as n, line from (select doc_id, source, lang, posexplode(split(text, '\\n')) as (pos, line) from documents) as x"
    else:
        cut = "select doc_id, source, lang, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, unnest(string_split(text, chr(10))) as line from documents"
    return f"pieces as ({cut}), chunks as (select doc_id, source, lang, cast(n as bigint) as n, concat({doc(d)}, '#line#', lpad(cast(n as string), 3, '0')) as chunk_id, line from pieces where trim(line) <> '')"


def sections(d: Dialect) -> str:
    """chunks: the lines of a document from a heading up to the next share one chunk_id."""
    numbered = f"numbered as (select doc_id, n, line, cast(sum(case when length(line) < {HEADING} then 1 else 0 end) over (partition by doc_id order by n, line rows between unbounded preceding and current row) as bigint) as section from line_chunks)"
    return lines(d).replace("chunks as", "line_chunks as") + f", {numbered}, chunks as (select doc_id, concat({doc(d)}, '#section#', cast(section as string)) as chunk_id, line from numbered)"


def windows(d: Dialect) -> str:
    """chunks: windows of WINDOW characters, one every STEP, up to the end of the text."""
    n = f"greatest({d.idiv(f'length(text) + {2 * STEP - WINDOW - 1}', str(STEP))}, 1)"
    at = f"explode(sequence(0, cast({n} as int) - 1))" if d.spark else f"unnest(range(0, {n}))"
    return f"windows as (select doc_id, text, {at} as n from documents where text is not null), pieces as (select doc_id, n, substr(text, cast(n * {STEP} + 1 as int), {WINDOW}) as line from windows), chunks as (select doc_id, concat({doc(d)}, '#fixed#', cast(n as string)) as chunk_id, line from pieces where trim(line) <> '')"


VARIANTS = {"line": lines, "section": sections, "fixed": windows}


def terms(d: Dialect, cut: Callable[[Dialect], str] = lines) -> str:
    return cut(d) + f""", tokens as (select chunk_id, {d.explode(d.words('line'))} as term from chunks),
      questions as (select item_id, text from benchmark), asked as (select item_id, {d.explode(d.words('text'))} as term from questions)"""


def bm25(d: Dialect, cut: Callable[[Dialect], str] = lines) -> str:
    """Okapi scores; a repeated query term counts each time, negative idf becomes a share of the mean idf."""
    return terms(d, cut) + f""", tf as (select chunk_id, term, cast(count(*) as double) as tf from tokens group by chunk_id, term), length as (select chunk_id, cast(count(*) as double) as len from tokens group by chunk_id),
      corpus as (select cast(count(*) as double) as n, avg(len) as mean_len from length), df as (select term, cast(count(*) as double) as df from tf group by term),
      raw_idf as (select term, ln(n - df + 0.5e0) - ln(df + 0.5e0) as idf from df cross join corpus), mean_idf as (select avg(idf) as m from raw_idf),
      idf as (select term, case when idf < 0 then {EPSILON}e0 * m else idf end as idf from raw_idf cross join mean_idf), query as (select item_id, term, cast(count(*) as double) as times from asked group by item_id, term),
      lexical as (select q.item_id, t.chunk_id, round(sum(q.times * i.idf * t.tf * {K1 + 1}e0 / (t.tf + {K1}e0 * ({1 - B}e0 + {B}e0 * l.len / c.mean_len))), 6) as score
        from query q join tf t on t.term = q.term join idf i on i.term = q.term join length l on l.chunk_id = t.chunk_id cross join corpus c group by q.item_id, t.chunk_id),
      lexical_top as (select * from (select *, cast(row_number() over (partition by item_id order by score desc, chunk_id) as bigint) as place from lexical) as x where place <= {CANDIDATES})"""


def dot(a: str, b: str, d: Dialect) -> str:
    if d.spark:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0e0, (s, x) -> s + x)"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"


def dense(d: Dialect) -> str:
    """Cosine neighbours of every vector among all others."""
    return f"""asked_vectors as (select vec_id as item_id, embedding as q, sqrt({dot('embedding', 'embedding', d)}) as q_norm from embeddings),
      near as (select a.item_id, e.vec_id, round({dot('a.q', 'e.embedding', d)} / (q_norm * sqrt({dot('e.embedding', 'e.embedding', d)})), 6) as cosine from embeddings e join asked_vectors a on e.vec_id <> a.item_id),
      dense_top as (select * from (select *, cast(row_number() over (partition by item_id order by cosine desc, vec_id) as bigint) as place from near) as x where place <= {CANDIDATES})"""


def coverage(d: Dialect) -> str:
    return terms(d) + f""", vocabulary as (select distinct term from tokens), content as (select distinct item_id, term from asked where length(term) >= {MIN_TERM}),
      covered as (select q.item_id, round(count(v.term) / cast(count(c.term) as double), 6) as coverage from questions q join content c on c.item_id = q.item_id left join vocabulary v on v.term = c.term group by q.item_id)"""


JUDGED = """judged as (select *, case when share >= 0.6 then 1 else 0 end as relevant from hits),
      at_place as (select item_id, place, relevant, sum(relevant) over (partition by item_id order by place rows between unbounded preceding and current row) / cast(place as double) as precision_at from judged)"""
PRECISION = "select item_id, round(coalesce(sum(precision_at * relevant) / nullif(cast(sum(relevant) as double), 0), 0), 6) as precision_ from at_place group by item_id"
RECALL = "select item_id, max(relevant) as recalled from judged group by item_id"


def contained(d: Dialect, cut: Callable[[Dialect], str] = lines) -> str:
    """Share of a question's distinct terms that each retrieved chunk holds."""
    return bm25(d, cut) + f""", distinct_asked as (select distinct item_id, term from asked), asked_n as (select item_id, cast(count(*) as double) as n from distinct_asked group by item_id),
      hits as (select l.item_id, l.chunk_id, l.place, count(t.term) / max(a.n) as share from lexical_top l join asked_n a on a.item_id = l.item_id join distinct_asked q on q.item_id = l.item_id left join tf t on t.chunk_id = l.chunk_id and t.term = q.term group by l.item_id, l.chunk_id, l.place),
      {JUDGED}"""


def summary(variant: str, chunks: str = "count(distinct chunk_id) from chunks") -> str:
    return f"select '{variant}' as variant, round(avg(p), 6) as precision_, round(avg(r), 6) as recall, (select {chunks}) as n_chunks from (select item_id, coalesce(sum(precision_at * relevant) / nullif(cast(sum(relevant) as double), 0), 0) as p, cast(max(relevant) as double) as r from at_place group by item_id) as x"


FUSED = f"""fused as (select coalesce(l.item_id, v.item_id) as item_id, coalesce(l.chunk_id, v.chunk_id) as chunk_id, coalesce(1.0e0 / ({RRF_K} + l.place), 0) + coalesce(1.0e0 / ({RRF_K} + v.place), 0) as score, case when l.place is null then 'dense' when v.place is null then 'lexical' else 'hybrid' end as origin from lexical_top l full outer join (select item_id, concat(cast(vec_id as string), '#line#001') as chunk_id, place from dense_top) v on l.item_id = v.item_id and l.chunk_id = v.chunk_id), ranked as (select *, cast(row_number() over (partition by item_id order by round(score, 9) desc, chunk_id) as bigint) as place from fused)"""
FUSED_TOP = f"select item_id, chunk_id, origin, round(score, 9) as score, place from ranked where place <= {TOP}"

QUERIES = {
    "document_header": lambda d: "select doc_id, source, lang, case when n_chars >= 5000 then 'manual' when n_chars >= 1500 then 'report' else 'procedure' end as genre, lower(text) like '%all rights reserved%' as confidential from documents",
    "paragraph_elements": lambda d: f"with {lines(d)} select chunk_id, case when line like '%|%' then 'table' when length(line) < 40 then 'heading' else 'prose' end as kind, cast(length(line) as bigint) as n_chars from chunks",
    "chunk_by_section": lambda d: f"with {lines(d)}, s as (select *, sum(case when length(line) < 40 then 1 else 0 end) over (partition by doc_id order by n rows between unbounded preceding and current row) as section from chunks) select doc_id, cast(section as bigint) as section, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from s group by doc_id, section",
    "table_merge": lambda d: f"with {lines(d)}, t as (select *, case when line like '%|%' then 1 else 0 end as is_table from chunks), g as (select *, sum(case when is_table = 1 and was = 0 then 1 else 0 end) over (partition by doc_id order by n rows between unbounded preceding and current row) as island from (select *, coalesce(lag(is_table) over (partition by doc_id order by n), 0) as was from t) as x) select doc_id, cast(island as bigint) as island, count(*) as n_rows from g where is_table = 1 group by doc_id, island",
    "dense_topk": lambda d: f"with {dense(d)} select item_id, vec_id, cosine, place from dense_top where place <= {TOP}",
    "bm25_topk": lambda d: f"with {bm25(d)} select item_id, chunk_id, score, place from lexical_top where place <= {TOP}",
    "hybrid_search_rrf": lambda d: f"with {bm25(d)}, {dense(d)}, {FUSED} {FUSED_TOP}",
    "term_coverage": lambda d: f"with {coverage(d)} select item_id, coverage from covered",
    "domain_gate": lambda d: f"with {coverage(d)} select item_id, coverage, coverage >= 0.482e0 as accepted from covered",
    "gate_calibration": lambda d: f"with {coverage(d)}, s as (select coverage, 1 as good from covered union all select coverage * 0.6e0, 0 from covered), t as (select distinct round(coverage, 6) as cut from s), c as (select t.cut, count(case when (s.coverage >= t.cut) = (s.good = 1) then 1 end) as correct from t cross join s group by t.cut) select cut, correct from (select *, row_number() over (order by correct desc, cut) as n from c) as x where n = 1",
    "context_precision": lambda d: f"with {contained(d)} {PRECISION}",
    "reference_recall": lambda d: f"with {contained(d)} {RECALL}",
    "ablation_summary": lambda d: " union all ".join(f"select * from (with {contained(d, cut)} {summary(v)}) as {v}" for v, cut in VARIANTS.items()),
    "strip_prefix": lambda d: f"with {lines(d)}, b as (select chunk_id, concat('[', source, ' · ', lang, '] ', line) as body from chunks) select chunk_id, regexp_replace(body, '^[^\\]]*\\] ', '') as body from b" if not d.spark else f"with {lines(d)}, b as (select chunk_id, concat('[', source, ' · ', lang, '] ', line) as body from chunks) select chunk_id, regexp_replace(body, r'^[^\\]]*\\] ', '') as body from b",
    "reply_turns": lambda d: "select conv_id, count(*) as n_turns, cast(sum(case when role = 'assistant' then 1 else 0 end) as bigint) as n_replies, cast(max(length(text)) as bigint) as longest from conversations group by conv_id",
    "vocabulary": lambda d: f"with {lines(d)}, w as (select {d.explode(d.words('line'))} as term, chunk_id from chunks) select term, count(*) as n, count(distinct chunk_id) as n_chunks from w where length(term) >= {MIN_TERM} group by term",
}
