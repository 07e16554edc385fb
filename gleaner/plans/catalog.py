"""All core queries by name, with the SQL of those that SQL can express.

Texts go through the plain analyzer here (unstemmed, accents of Latin letters), which SQL can repeat; stemmed variants have
no twin. Arrays are compared as joined texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.functions import lang, text as T, urls as U
from gleaner.functions.html import extract_pages
from gleaner.functions.porter import stem_column
from gleaner.operators import analyze as A, batch as B, bm25 as R, explain as E, frontier as C, index as I, rerank as K, spelling as S
from gleaner.plans import sql as Q
from gleaner.session import materialize, workspace
from gleaner.sources.fetch import robots_allowed
from gleaner.sources.files import replace_text
from gleaner.sources.tables import load_checkpoint, read_queries, result_lines, save_checkpoint
from gleaner.streaming.ingest import visits_by_window

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pages(spark, d: str) -> DataFrame:
    return A.latest_pages(spark.read.parquet(f"{d}/raw_pages.parquet"))


def _docs(spark, d: str) -> DataFrame:
    return I.one_per_id(spark.read.parquet(f"{d}/preprocessed_pages.parquet"))


def _index(spark, d: str) -> I.Index:
    return I.build_index(spark.read.parquet(f"{d}/preprocessed_pages.parquet"))


def _queries(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/queries.parquet")


def _analysed(spark, d: str) -> DataFrame:
    return R.analyse_queries(_queries(spark, d), A.PLAIN)


def _corrected(spark, d: str, index: I.Index) -> DataFrame:
    return S.correct(_analysed(spark, d), index.vocabulary)


def _found(spark, d: str) -> tuple[I.Index, DataFrame, DataFrame]:
    index = _index(spark, d)
    asked = _corrected(spark, d, index)
    # a sum's last bits depend on its order, so ties are cut off for the comparison
    return index, asked, R.candidates(R.query_terms(asked), index, digits=9)


def _joined(c, by: str = " "):
    return F.array_join(c, by)


# --- texts, terms and the index


@query(f"with {Q.PAGES} select doc_id, array_to_string({Q.tokens('title')}, ' ') as title_terms, array_to_string({Q.tokens('body')}, ' ') as body_terms from pages")
def tokenize_pages(spark, d):
    return _pages(spark, d).select("doc_id", _joined(A.PLAIN(F.col("title"))).alias("title_terms"), _joined(A.PLAIN(F.col("body"))).alias("body_terms"))


@query(f"select doc_id, cast(len({Q.tokens('text')}) as bigint) as terms from documents")
def tokenize_documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(A.PLAIN(F.col("text"))).cast("bigint").alias("terms"))


@query(f"""with w as (select unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) as word from documents)
  select word, count(*) as n from w where list_contains({Q.STOP}, word) group by word""")
def token_stopword_filter(spark, d):
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.where(F.col("word").isin(*T.STOPWORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {Q.DOCS}, {Q.POSTINGS} select term, doc_id, cast(tf as int) as tf from postings")
def term_frequency(spark, d):
    return I.term_frequencies(_docs(spark, d)).select("term", "doc_id", "tf")


@query(f"with {Q.DOCS}, {Q.POSTINGS} select term, df from vocab")
def document_frequency(spark, d):
    return _index(spark, d).vocabulary


@query("select term, sum(df)::bigint as df from document_frequencies group by term")
def stored_document_frequency(spark, d):
    """The stored map of the shards as one collection."""
    return spark.read.parquet(f"{d}/document_frequencies.parquet").groupBy("term").agg(F.sum("df").alias("df"))


@query(f"with {Q.DOCS}, {Q.POSTINGS} select term, string_agg(doc_id || ':' || tf, ',' order by doc_id) as postings from postings group by term")
def postings_list(spark, d):
    lists = I.postings_lists(I.term_frequencies(_docs(spark, d)))
    return lists.select("term", _joined(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), ",").alias("postings"))


@query(f"""with {Q.DOCS} select 'body' as field, doc_id, cast(doc_length as int) as length from docs union all
  select 'title', doc_id, cast(len(title_tokens) as int) from docs union all select 'heading', doc_id, cast(len(heading_tokens) as int) from docs""")
def field_lengths(spark, d):
    return I.field_lengths(_docs(spark, d))


@query(f"with {Q.DOCS} select count(*) as n_docs, round(avg(doc_length::double), 6) as avgdl from docs")
def avg_doc_length(spark, d):
    return I.statistics(I.metadata(_docs(spark, d))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"""with {Q.INDEX} select count(*) as num_docs, (select count(*) from vocab) as vocabulary_size, round(avg(doc_length::double), 4) as average_document_length,
  count(*) filter (len(outgoing_links) > 0) as documents_with_outgoing_links from docs""")
def index_summary(spark, d):
    index = _index(spark, d)
    return I.summary(index.docs, index.vocabulary)


@query(f"""with {Q.DOCS} select doc_id, url, fetched_url, canonical_url, title, snippet, array_to_string(title_tokens, ' ') as title_terms, array_to_string(heading_tokens, ' ') as heading_terms,
  cast(doc_length as int) as doc_length, cast(len(outgoing_links) as int) as links from docs""")
def doc_metadata(spark, d):
    m = I.metadata(_docs(spark, d))
    return m.select("doc_id", "url", "fetched_url", "canonical_url", "title", "snippet", _joined("title_tokens").alias("title_terms"), _joined("heading_tokens").alias("heading_terms"), "doc_length", F.size("outgoing_links").alias("links"))


@query(f"with {Q.PAGES} select count(*) as num_pages, sum(len({Q.tokens('body')}))::bigint as total_body_tokens from pages")
def preprocess_totals(spark, d):
    return A.totals(A.preprocess(_pages(spark, d), A.PLAIN))


@query(f"""with {Q.PAGES}, t as (select doc_id, regexp_replace(coalesce(body, ''), '^[\\s\\x{{85}}\\x{{A0}}]+|[\\s\\x{{85}}\\x{{A0}}]+$', '', 'g') as b from pages)
  select doc_id, case when length(b) <= 160 then b else regexp_replace(substring(b, 1, 160), ' [^ ]*$', '') || '...' end as snippet from t""")
def snippets(spark, d):
    return _pages(spark, d).select("doc_id", T.snippet(F.col("body"), 160).alias("snippet"))


@query()
def stemmed_vocabulary(spark, d):
    """Stems of the collection's distinct terms: each is stemmed once and joined back by its users."""
    return _index(spark, d).vocabulary.withColumn("stem", stem_column("term")).groupBy("stem").agg(F.sum("df").alias("uses"), F.count(F.lit(1)).alias("terms"))


@query()
def preprocess_stemmed(spark, d):
    """The default analyzer over all pages."""
    return A.preprocess(_pages(spark, d)).select("doc_id", _joined("title_tokens").alias("title_terms"), _joined("heading_tokens").alias("heading_terms"), _joined("body_tokens").alias("body_terms"), "body_length")


_LINKS = f"""with {Q.DOCS},
  owners as (select link, arg_max(doc_id, doc_id * 3 + i) as dst from (select doc_id, unnest([url, fetched_url, canonical_url]) as link, unnest([0, 1, 2]) as i from docs) where link <> '' group by link),
  edges as (select distinct doc_id as src, dst from (select doc_id, unnest(outgoing_links) as link from docs) join owners using (link) where doc_id <> dst)"""


@query(f"{_LINKS} select src, dst from edges")
def link_edges(spark, d):
    return I.link_edges(_docs(spark, d))


@query(f"{_LINKS} select d.doc_id, coalesce(string_agg(dst::varchar, ',' order by dst), '') as targets from docs d left join edges e on d.doc_id = e.src group by d.doc_id")
def link_graph(spark, d):
    return I.link_graph(_docs(spark, d)).select("doc_id", _joined(F.col("targets").cast("array<string>"), ",").alias("targets"))


# --- retrieval


@query(f"with {Q.INDEX} select term, round(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)), 6) as idf from vocab, stats")
def idf_table(spark, d):
    index = _index(spark, d)
    return index.vocabulary.select("term", F.round(R.idf(index.stats[0], F.col("df")), 6).alias("idf"))


@query(f"with {Q.ANALYSED} select query_id, pos, array_to_string(toks, ' ') as terms from analysed")
def query_analysis(spark, d):
    return _analysed(spark, d).select("query_id", "pos", _joined("query_tokens").alias("terms"))


@query(f"with {Q.INDEX}, {Q.ANALYSED}, {Q.SPELLED} select token, term, df, cast(dist as int) as dist from near where dist <= d")
def spell_candidates(spark, d):
    index = _index(spark, d)
    tokens = _analysed(spark, d).select(F.explode("query_tokens").alias("token")).distinct()
    unknown = tokens.join(index.vocabulary, F.col("token") == F.col("term"), "left_anti")
    return S.candidates(unknown, index.vocabulary)


@query(f"with {Q.INDEX}, {Q.ANALYSED}, {Q.SPELLED} select query_id, array_to_string(toks, ' ') as terms from corrected")
def spell_correct(spark, d):
    return _corrected(spark, d, _index(spark, d)).select("query_id", _joined("query_tokens").alias("terms"))


@query(f"""with {Q.INDEX}, {Q.ANALYSED}, {Q.SPELLED} select query_id, a as entered, b as corrected from
  (select query_id, unnest(entered) as a, unnest(toks) as b from corrected) where a <> b""")
def spell_corrections_shown(spark, d):
    return S.shown_corrections(_corrected(spark, d, _index(spark, d)))


@query(f"{Q.SEARCH} select query_id, doc_id, round(bm25, 4) as bm25, array_to_string(matched, ' ') as matched_terms from scored")
def bm25_matches(spark, d):
    index = _index(spark, d)
    m = R.matches(R.query_terms(_corrected(spark, d, index)), index)
    return m.select("query_id", "doc_id", F.round("bm25", 4).alias("bm25"), _joined("matched_terms").alias("matched_terms"))


@query(f"{Q.SEARCH} select query_id, doc_id, bm25_score, cast(bm25_rank as int) as bm25_rank from best")
def bm25_batch_topk(spark, d):
    return _found(spark, d)[2].select("query_id", "doc_id", "bm25_score", "bm25_rank")


@query(f"{Q.SEARCH} select query_id, doc_id, bm25_score from best where bm25_rank <= 10")
def bm25_top10(spark, d):
    return _found(spark, d)[2].where("bm25_rank <= 10").select("query_id", "doc_id", "bm25_score")


@query(f"{Q.SEARCH}, {Q.RERANK} select query_id, doc_id, raw as boost from joined")
def field_boost(spark, d):
    index, asked, best = _found(spark, d)
    j = best.join(index.docs.select("doc_id", "title", "title_tokens", "heading_tokens"), "doc_id").join(asked.select("query_id", "query_tokens"), "query_id")
    title = F.when(F.size("title_tokens") > 0, F.col("title_tokens")).otherwise(A.PLAIN(F.col("title")))
    return j.select("query_id", "doc_id", (K.field_boost(F.col("query_tokens"), title, 2.0) + K.field_boost(F.col("query_tokens"), F.col("heading_tokens"), 1.0)).alias("boost"))


def _reranked(spark, d):
    index, asked, best = _found(spark, d)
    found = best.join(index.docs.select("doc_id", "url", "fetched_url", "canonical_url", "title", "snippet"), "doc_id", "left")
    return index, asked, K.rerank(found, asked, index.docs, analyzer=A.PLAIN)


@query(f"{Q.SEARCH}, {Q.RERANK} select query_id, doc_id, round(nb, 4) as normalized_bm25, round(field, 4) as normalized_field_boost from ranked")
def minmax_normalize(spark, d):
    return _reranked(spark, d)[2].select("query_id", "doc_id", F.col("score_details.normalized_bm25").alias("normalized_bm25"), F.col("score_details.normalized_field_boost").alias("normalized_field_boost"))


@query(f"{Q.SEARCH}, {Q.RERANK} select query_id, doc_id, cast(rank as int) as rank, score from ranked")
def rerank_topk(spark, d):
    return _reranked(spark, d)[2].select("query_id", "doc_id", "rank", "score")


_URL = "coalesce(nullif(url, ''), nullif(fetched_url, ''), nullif(canonical_url, ''), '')"


@query(f"{Q.SEARCH}, {Q.RERANK} select query_id, cast(rank as int) as rank, {_URL} as url, printf('%.6f', score) as score from ranked where {_URL} <> ''")
def batch_rows_tsv(spark, d):
    return B.result_rows(_reranked(spark, d)[2])


@query(f"{Q.SEARCH} select query_id, cast(bm25_rank as int) as rank, {_URL} as url, printf('%.6f', bm25_score) as score from best join docs using (doc_id) where {_URL} <> ''")
def batch_no_rerank(spark, d):
    index, _, best = _found(spark, d)
    found = best.join(index.docs, "doc_id", "left").withColumn("score", F.col("bm25_score")).withColumn("rank", F.col("bm25_rank"))
    return B.result_rows(found)


@query("select query_id, count(*) as rows, count(distinct doc_id) as docs, max(rank) as last_rank from results group by query_id")
def stored_results_summary(spark, d):
    r = spark.read.parquet(f"{d}/results.parquet")
    return r.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("docs"), F.max("rank").alias("last_rank"))


@query()
def search_stemmed(spark, d):
    """The whole pipeline with the default analyzer: pages, index, spelling, BM25, re-ranking."""
    index = I.build_index(A.preprocess(_pages(spark, d)))
    return B.search(_queries(spark, d), index).select("query_id", "doc_id", "rank", "score")


# --- pages and links

_ALL_LINKS = "links as (select distinct unnest(outgoing_links) as url from raw_pages)"


def _links(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/raw_pages.parquet").select(F.explode("outgoing_links").alias("url")).distinct()


@query(f"with {_ALL_LINKS} select url, {Q.normal('url')} as normal from links")
def normalize_url(spark, d):
    return _links(spark, d).select("url", U.normalize_url(F.col("url")).alias("normal"))


@query(f"select k, count(*) as rows from (select {Q.key('url')} as k from visited) group by k")
def url_key_dedup(spark, d):
    return spark.read.parquet(f"{d}/visited.parquet").groupBy(U.url_key(F.col("url")).alias("k")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"select {Q.domain('url')} as domain, count(*) as visits from visited group by all")
def registrable_domain(spark, d):
    return spark.read.parquet(f"{d}/visited.parquet").groupBy(U.registrable_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("visits"))


@query(f"with {_ALL_LINKS} select url from links where {Q.is_page('url')}")
def html_url_filter(spark, d):
    return _links(spark, d).where(U.is_page_url(F.col("url")))


@query(f"with {_ALL_LINKS}, e as (select url, {Q.domain('url')} as domain from links) select url from e where domain = 'relekecol.example' or domain like '%.relekecol.example'")
def blacklist_filter(spark, d):
    return _links(spark, d).where(U.is_blacklisted(U.registrable_domain(F.col("url")), ("relekecol.example",)))


@query(f"""with {Q.PAGES} select doc_id, regexp_matches(lower(coalesce(url, '') || ' ' || coalesce(title, '') || ' ' || coalesce(body, '')), {Q.quote(T.TOPIC_PATTERN)}) as related from pages""")
def topic_filter(spark, d):
    return _pages(spark, d).select("doc_id", T.is_on_topic(F.col("url"), F.col("title"), F.col("body")).alias("related"))


@query(f"""with {Q.PAGES} select doc_id, case when coalesce(language, '') = 'en' then true when coalesce(language, '') not in ('', 'unknown') then false
  else coalesce(contains(lower({Q.path('url')}), '/en'), null) end as english from pages""")
def looks_english(spark, d):
    return _pages(spark, d).select("doc_id", lang.looks_english(F.col("url"), F.col("language")).alias("english"))


def _words_of(words: list[str]) -> str:
    return f"len(list_filter(words, lambda w: list_contains([{', '.join(map(Q.quote, words))}], w)))"


@query(f"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') as words from documents),
  n as (select doc_id, {', '.join(f'{_words_of(ws)} as n_{x}' for x, ws in lang.PROFILES.items())} from w), m as (select *, greatest({', '.join(f'n_{x}' for x in lang.PROFILES)}) as most from n)
  select doc_id, case when most = 0 then 'unknown' {' '.join(f"when n_{x} = most then '{x}'" for x in lang.PROFILES)} end as detected from m""")
def language_by_words(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", lang.detect_language(F.col("text")).alias("detected"))


@query()
def language_detect(spark, d):
    """The fitted n-gram model over all documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = lang.detect_by_ngrams(F.col("text"), lang.fit_languages(docs, "text", "lang"))
    return docs.select("doc_id", "lang", found.alias("f")).select("doc_id", "lang", F.col("f.lang").alias("detected"), F.round("f.confidence", 4).alias("confidence"))


_WHITE = r"[\s\x{85}\x{A0}\x{1C}-\x{1F}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WHITE}', ' ', 'g'))"


@query(f"""with {Q.PAGES}, h as (select *, coalesce(list_filter(list_transform(headings, lambda x: {_one_line("coalesce(x, '')")}), lambda x: x <> ''), []) as hs, coalesce(url, 'https://here.example/') as here from pages)
  select doc_id, case when title is null then here else {_one_line('title')} end as title, array_to_string(hs, ' / ') as headings, {_one_line("array_to_string(hs, ' ') || ' ' || coalesce(body, '')")} as body,
    coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(outgoing_links, lambda x: x is not null and {Q.is_page('x')}), lambda x: {Q.normal('x')}))), ' '), '') as links, coalesce(language, '') as html_lang from h""")
def html_roundtrip(spark, d):
    """Stored pages written as HTML with scripts, frames and e-mail links around them, and taken apart again."""
    esc = lambda c: E.escape_html(F.coalesce(c, F.lit("")))
    each = lambda c, f: F.coalesce(F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), f), ""), F.lit(""))
    html = F.concat(
        F.lit("<html lang='"), F.coalesce("language", F.lit("")), F.lit("'><head>"), F.when(F.col("title").isNotNull(), F.concat(F.lit("<title>"), esc(F.col("title")), F.lit("</title>"))).otherwise(""),
        F.lit("<style>p {}</style></head><body><nav>menu</nav><script>var a = '<p>';</script><main>"), each("headings", lambda x: F.concat(F.lit("<h2>"), esc(x), F.lit("</h2>"))), F.lit("<p>"), esc(F.col("body")), F.lit("</p>"),
        each("outgoing_links", lambda x: F.concat(F.lit('<a href="'), esc(x), F.lit('"></a>'))), F.lit("<a href='mailto:a@b.example'></a></main><main>another</main></body></html>"),
    )
    pages = _pages(spark, d).select("doc_id", F.coalesce("url", F.lit("https://here.example/")).alias("fetched_url"), html.alias("html"))
    return extract_pages(pages).select("doc_id", "title", _joined("headings", " / ").alias("headings"), "body", _joined("outgoing_links").alias("links"), "html_lang")


@query(f"with {Q.PAGES} select doc_id, array_to_string({Q.tokens("array_to_string(coalesce(headings, []), ' ')")}, ' ') as terms from pages")
def tokenize_headings(spark, d):
    return _pages(spark, d).select("doc_id", _joined(A.PLAIN.list(F.col("headings"))).alias("terms"))


@query("""with r as (select *, coalesce(score, bm25_score, 0) as s from results)
  select query_id, doc_id, coalesce(rank, row_number() over (partition by query_id order by s desc, doc_id)) as rank, s as score, greatest(0.0, least(1.0, coalesce(bm25_score, 0))) as shown, coalesce(len(list_distinct(matched_terms)), 0) as terms from r""")
def results_adapted(spark, d):
    """Stored results for display: filled scores and ranks, a score within 0..1, distinct terms."""
    return E.adapt_results(spark.read.parquet(f"{d}/results.parquet")).select("query_id", "doc_id", "rank", "score", E.score_value(F.col("bm25_score")).alias("shown"), F.size("matched_terms").cast("bigint").alias("terms"))


@query("""with n as (select doc_id, coalesce(n_chars, 0) as s from documents) select doc_id, case when s >= 3600 then printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then printf('%dm%02ds', s // 60, s % 60) else printf('%ds', s) end as long,
  case when s < 1 then '<0.001s' else printf('%.3fs', s / 1000.0) end as short from n""")
def durations(spark, d):
    """Lengths of texts read as seconds and milliseconds, as they are shown."""
    s = F.coalesce("n_chars", F.lit(0))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.duration(s).alias("long"), T.runtime(s / 1000.0).alias("short"))


@query("select query_id, query, pos from (select trim(query_id) as query_id, trim(query) as query, row_number() over (order by pos) - 1 as pos from queries where trim(coalesce(query, '')) <> '' and query_id is not null)")
def query_file_roundtrip(spark, d):
    """The queries written as a TSV file and read again."""
    path = f"{workspace(spark)}/gleaner/queries-{uuid.uuid4().hex}.tsv"
    rows = _queries(spark, d).where("query_id is not null and trim(coalesce(query, '')) != ''").orderBy("pos").select("query_id", "query").collect()
    replace_text(spark, path, result_lines(rows))
    return read_queries(spark, path)


@query()
def extract_body(spark, d):
    """Documents' texts read as HTML, as some hold left-over tags."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit("https://here.example/").alias("fetched_url"), F.col("text").alias("html"))
    return extract_pages(docs).select("doc_id", "title", "body", F.size("outgoing_links").alias("links"))


@query(f"""with e as (select {Q.domain('url')} as src, {Q.domain('link')} as dst from (select url, unnest(outgoing_links) as link from raw_pages where url is not null))
  select src, dst, count(*) as links from e where src <> dst group by all""")
def domain_graph(spark, d):
    e = spark.read.parquet(f"{d}/raw_pages.parquet").where("url is not null").select(U.registrable_domain(F.col("url")).alias("src"), F.explode("outgoing_links").alias("link"))
    return e.select("src", U.registrable_domain(F.col("link")).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


_ROUTED = f"""with {_ALL_LINKS}, from_pages as (select unnest(outgoing_links) as link, coalesce(is_tuebingen_related, false) and coalesce(language, '') = 'en' as promote from raw_pages),
  normal as (select {Q.normal('link')} as url, promote from from_pages),
  ok as (select url, max(promote) as promote from normal where {Q.domain('url')} <> '' and {Q.is_page('url')} and {Q.domain('url')} <> 'archive.org' group by url),
  seen as (select distinct {Q.normal('url')} as url from visited where url is not null),
  routed as (select url, case when promote then 'high' else 'low' end as level, {Q.domain('url')} as domain from ok where url not in (select url from seen where url is not null))"""


def _routed(spark, d) -> DataFrame:
    pages = spark.read.parquet(f"{d}/raw_pages.parquet")
    promote = F.coalesce("is_tuebingen_related", F.lit(False)) & (F.coalesce("language", F.lit("")) == "en")
    links = pages.select(F.explode("outgoing_links").alias("link"), promote.alias("promote")).select(U.normalize_url(F.col("link")).alias("url"), "promote")
    seen = spark.read.parquet(f"{d}/visited.parquet").where("url is not null").select(U.normalize_url(F.col("url")).alias("url"))
    return C.route(links, seen)


@query(f"{_ROUTED} select level, domain, url from routed")
def frontier_routing(spark, d):
    return _routed(spark, d)


@query(f"{_ROUTED} select level, domain, url from (select *, row_number() over (partition by domain order by level, url) as r from routed) where r = 1")
def frontier_claim(spark, d):
    waiting = _routed(spark, d).select("level", "domain", F.lit(0).cast("bigint").alias("seq"), "url", F.lit(0).alias("attempts"))
    return C.claim(waiting, spark.createDataFrame([], "domain string, next_time double"), 0.0).select("level", "domain", "url")


@query(f"{_ROUTED} select level, count(*) as urls, count(distinct domain) as domains, count(distinct domain) as ready_domains from routed group by level")
def frontier_sizes(spark, d):
    return C.frontier_sizes(_routed(spark, d), spark.createDataFrame([], "domain string, next_time double"), 0.0)


@query(f"with {_ALL_LINKS} select url from links where {Q.normal('url')} not in (select {Q.normal('url')} from visited where url is not null)")
def visited_antijoin(spark, d):
    seen = spark.read.parquet(f"{d}/visited.parquet").where("url is not null").select(U.normalize_url(F.col("url")).alias("n")).distinct()
    return _links(spark, d).join(seen, U.normalize_url(F.col("url")) == F.col("n"), "left_anti")


@query(f"{_ROUTED} select url, cast(row_number() over (order by url) + 999 as bigint) as doc_id from routed")
def doc_id_assignment(spark, d):
    return C.number_new(_routed(spark, d).select("url"), 999, "doc_id", ["url"]).select("url", F.col("doc_id").cast("bigint").alias("doc_id"))


@query("""select case when regexp_full_match(status_code, '[0-9]+') then cast(status_code as int) end as http_status,
  case when not regexp_full_match(status_code, '[0-9]+') then status_code end as outcome, count(*) as n from visited group by all""")
def visited_status_split(spark, d):
    """The state that is a number or a word, as two columns."""
    s = F.col("status_code")
    number = s.rlike("^[0-9]+$")
    return spark.read.parquet(f"{d}/visited.parquet").groupBy(F.when(number, s.cast("int")).alias("http_status"), F.when(~number, s).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_WHEN = "try_cast(regexp_replace(replace(visited_at, 'T', ' '), 'Z$', '') as timestamp)"


@query(f"select date_trunc('day', {_WHEN}) as start, status_code, count(*) as visits from visited where {_WHEN} is not null group by all")
def visits_by_day(spark, d):
    """The streaming window count as a batch query."""
    v = spark.read.parquet(f"{d}/visited.parquet")
    at = F.expr("try_to_timestamp(regexp_replace(replace(visited_at, 'T', ' '), 'Z$', ''))")
    return visits_by_window(v.select(at.alias("visited_at"), "status_code").where("visited_at is not null"))


# --- explanations


def _shown(spark, d) -> DataFrame:
    """The best ten results of each query with the page's text and the query's words as they were entered."""
    index, asked, best = _found(spark, d)
    docs = index.docs.select("doc_id", "url", "title", "snippet", "title_tokens", "heading_tokens")
    top = materialize(best.where("bm25_rank <= 10").select("query_id", "doc_id", "matched_terms"), "top")
    shown = spark.read.parquet(f"{d}/raw_pages.parquet").join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    body = A.latest_pages(shown).select("doc_id", "body")
    return top.join(docs, "doc_id").join(body, "doc_id", "left").join(asked.select("query_id", "query", "query_tokens"), "query_id")


_SHOWN = f"""{Q.SEARCH}, {Q.PAGES},
  shown as (select b.query_id, b.doc_id, b.matched, d.url, d.title, d.snippet, d.title_tokens, d.heading_tokens, p.body, c.toks from best b join docs d using (doc_id)
    left join pages p using (doc_id) join corrected c using (query_id) where bm25_rank <= 10),
  low as (select *, replace(replace(lower(title || ' ' || url || ' ' || snippet || ' ' || coalesce(body, '')), 'tübingen', 'tubingen'), 'tuebingen', 'tubingen') as page from shown)"""


@query(f"""{_SHOWN}, each as (select query_id, doc_id, page, unnest(list_distinct(toks)) as t from low)
  select query_id, doc_id, coalesce(string_agg(t, ' ' order by t) filter (regexp_matches(page, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')), '') as found,
   coalesce(string_agg(t, ' ' order by t) filter (not regexp_matches(page, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')), '') as missing from each group by query_id, doc_id""")
def found_missing_terms(spark, d):
    s = _shown(spark, d).withColumn("page", E.page_text(F.col("title"), F.col("url"), F.col("snippet"), F.col("body")))
    return s.select("query_id", "doc_id", _joined(F.array_sort(E.found_terms(F.col("page"), F.col("query_tokens")))).alias("found"), _joined(F.array_sort(E.missing_terms(F.col("page"), F.col("query_tokens")))).alias("missing"))


_ESCAPED = "replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""{_SHOWN}, t as (select *, list_filter(list_distinct(toks), lambda x: length(x) > 2) as long from shown)
  select query_id, doc_id, case when len(long) > 0 then regexp_replace({_ESCAPED}, '(' || (select string_agg(x, '|' order by length(x) desc, x) from unnest(long) as u(x)) || ')', '<mark>\\1</mark>', 'gi') else {_ESCAPED} end as marked from t""")
def highlight(spark, d):
    return _shown(spark, d).select("query_id", "doc_id", E.highlight(F.col("title"), F.col("query_tokens")).alias("marked"))


def _hits(c: str) -> str:
    return f"list_sort(list_intersect(list_distinct(toks), {c}))"


@query(f"""{_SHOWN}, h as (select query_id, doc_id, {_hits('s.title_tokens')} as t, {_hits('s.heading_tokens')} as g, {_hits('body_tokens')} as b, {_hits(Q.tokens('s.url'))} as u, matched from shown s join docs using (doc_id)),
  d as (select query_id, doc_id, max(score_details.field_boost) as field, max(score_details.prf) as prf, max(score_details.link) as link, max(score_details.lsa) as lsa from results group by all)
  select query_id, doc_id, array_to_string(list_filter([case when len(t) > 0 then 'Matched query term in title: ' || array_to_string(t, ', ') end,
   case when len(g) > 0 then 'Matched query term in headings: ' || array_to_string(g, ', ') end, case when len(u) > 0 then 'Matched query term in URL' end,
   'Matched indexed terms: ' || array_to_string((case when len(b) > 0 then b else matched end)[1:6], ', '), case when field > 0 then 'Title or heading Field Boost contributed' end,
   case when prf > 0 then 'Boosted by PRF terms: ' || array_to_string(matched[1:5], ', ') end, case when link > 0 then 'Internal LinkScore contributed' end,
   case when lsa > 0 then 'Semantic LSA similarity contributed' end], lambda x: x is not null), ' / ') as reasons from h left join d using (query_id, doc_id)""")
def why_reasons(spark, d):
    """Every kind of reason; the stored results give the parts of the scores, the matched terms stand for feedback terms."""
    parts = {"field": "field_boost", "prf": "prf", "link": "link", "lsa": "lsa"}
    details = spark.read.parquet(f"{d}/results.parquet").groupBy("query_id", "doc_id").agg(*[F.max(f"score_details.{c}").alias(f"d_{n}") for n, c in parts.items()])
    s = _shown(spark, d).join(_docs(spark, d).select("doc_id", "body_tokens"), "doc_id").join(details, ["query_id", "doc_id"], "left")
    reasons = E.why_reasons(
        F.col("query_tokens"), F.col("title_tokens"), F.col("heading_tokens"), F.col("body_tokens"), F.col("matched_terms"), {n: F.col(f"d_{n}") for n in parts}, A.PLAIN(F.col("url")), F.array_sort("matched_terms")
    )
    return s.select("query_id", "doc_id", _joined(reasons, " / ").alias("reasons"))


@query(f"""with {Q.PAGES}, s as (select doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(coalesce(body, ''), '[\\s\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))) as sentence from pages)
  select doc_id, count(*) as sentences, sum(length(sentence))::bigint as chars from s where length(trim(sentence)) between 35 and 340 group by doc_id""")
def sentence_split(spark, d):
    s = _pages(spark, d).select("doc_id", F.explode(T.sentences(F.col("body"))).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


def _sentences(x: str, least: int = 35, most: int = 340) -> str:
    clean = f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"
    return f"list_filter(string_split(regexp_replace({clean}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) between {least} and {most})"


@query(f"""{_SHOWN}, base as (select query_id, doc_id, snippet, list_distinct(toks) as q, list_distinct({Q.tokens('title')}) as t, {_sentences('substring(body, 1, 12000)')} as own, {_sentences('snippet')} as short from shown),
  pick as (select *, (case when len(own) > 0 then own else short end)[1:80] as s from base), one as (select query_id, doc_id, q, t, unnest(s) as sentence, unnest(range(1, len(s) + 1)) as pos from pick),
  words as (select *, list_distinct({Q.tokens('sentence')}) as w from one), valued as (select *, 3.0 * len(list_intersect(w, q)) + len(list_intersect(w, t)) as score from words),
  placed as (select *, row_number() over (partition by query_id, doc_id order by score desc, pos) as r from valued where score > 0), told as (select query_id, doc_id, string_agg(trim(sentence), ' ' order by pos) as text from placed where r <= 2 group by all)
  select query_id, doc_id, coalesce(text, snippet, '') as summary from base left join told using (query_id, doc_id)""")
def smart_summary(spark, d):
    return E.smart_summary(_shown(spark, d).withColumnRenamed("query_tokens", "query_terms"), A.PLAIN)


_CLEAN = "trim(regexp_replace(coalesce({}, ''), '[\\s\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"


@query(f"""{_SHOWN}, q as (select b.query_id, b.doc_id, {_CLEAN.format('p.body')} as t, list_distinct(list_filter(list_transform(regexp_extract_all(query, '[A-Za-zÄÖÜäöüß]+'), lambda x: lower(x)), lambda w: length(w) > 2)) as words
    from best b left join pages p using (doc_id) join (select query_id, arg_min(query, pos) as query from queries group by query_id) using (query_id) where bm25_rank <= 10),
  kept as (select *, array_to_string(list_filter(list_transform({_sentences('substring(t, 12001)', 31, 1 << 30)}, lambda s: trim(s)), lambda s: len(list_filter(words, lambda w: contains(lower(s), w))) > 0), ' ') as k from q)
  select query_id, doc_id, case when length(t) <= 24000 then t else {_CLEAN.format("substring(t, 1, 12000) || ' ... ' || substring(case when k <> '' then k else right(t, 11920) end, 1, 11920)")} end as context from kept""")
def prompt_context(spark, d):
    return _shown(spark, d).select("query_id", "doc_id", E.compact_context(F.col("body"), F.col("query")).alias("context"))


@query()
def prompts(spark, d):
    """The prompt of each shown result, with where its text is from; the mode goes by the result's place."""
    s = _shown(spark, d).withColumn("c", E.page_context(F.col("title"), F.col("url"), F.col("snippet"), [F.col("body")], F.col("query")))
    modes = F.element_at(F.array(F.lit("relevance"), F.lit("summary"), F.lit("custom")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return s.select("query_id", "doc_id", F.col("c.source").alias("source"), E.prompts(modes, F.col("query"), F.col("c.context"), F.lit("List the places that the page names.")).alias("prompt"))


# --- the crawl

_VISIT = f"""visits as (select url, visited_at, status_code, case when regexp_full_match(status_code, '[0-9]+') then cast(status_code as int) end as status,
    coalesce(status_code, '') <> 'robots_blocked' as allowed, {Q.key('url')} as k, cast(row_number() over (partition by {Q.key('url')} order by visited_at nulls first, status_code nulls first) - 1 as int) as attempts from visited where url is not null),
  known as (select {Q.key('coalesce(canonical_url, url)')} as k, bool_or(coalesce(is_tuebingen_related, false)) as related, bool_or(coalesce(language, '') = 'en') as english from raw_pages where url is not null group by 1),
  saved as (select distinct {Q.key('canonical_url')} as k from preprocessed_pages where canonical_url is not null)"""


def _visits(spark, d) -> DataFrame:
    """Stored visits as fetched rows: states, tries so far, and what the stored pages say of the URL."""
    s = F.col("status_code")
    v = spark.read.parquet(f"{d}/visited.parquet").where("url is not null").withColumn("k", U.url_key(F.col("url")))
    tries = F.row_number().over(W.partitionBy("k").orderBy(F.col("visited_at").asc_nulls_first(), s.asc_nulls_first())) - 1
    v = v.select("url", "k", F.when(s.rlike("^[0-9]+$"), s.cast("int")).alias("status"), (F.coalesce(s, F.lit("")) != "robots_blocked").alias("allowed"), tries.alias("attempts"))
    pages = spark.read.parquet(f"{d}/raw_pages.parquet").where("url is not null")
    pages = pages.groupBy(U.url_key(F.coalesce("canonical_url", "url")).alias("k")).agg(F.bool_or(F.coalesce("is_tuebingen_related", F.lit(False))).alias("related"), F.bool_or(F.coalesce("language", F.lit("")) == "en").alias("english"))
    return v.join(pages, "k", "left")


def _saved_keys(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/preprocessed_pages.parquet").where("canonical_url is not null").select(U.url_key(F.col("canonical_url")).alias("k")).distinct()


@query(f"""with {_VISIT}, done as (select case when not allowed then 'robots_blocked' when status is null or status in (429, 500, 502, 503, 504) then case when attempts + 1 <= 3 then 'retry' else 'given_up' end
    when status <> 200 then 'not_html' when not coalesce(related, false) then 'not_related' when not coalesce(english, false) then 'not_english' when s.k is not null then 'duplicate' else 'saved' end as outcome
    from visits v left join known n on v.k = n.k left join saved s on v.k = s.k) select outcome, count(*) as n from done group by outcome""")
def crawl_outcomes(spark, d):
    """The outcomes of all stored visits, by the cascade that a crawl's rounds use."""
    v = _visits(spark, d).join(_saved_keys(spark, d).withColumn("known", F.lit(True)), "k", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return v.groupBy(C.outcome(F.col("status"), F.lit("text/html"), F.col("allowed"), F.col("attempts"), no("related"), no("english"), no("known")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_VISIT}, t as (select k, unnest(range(0, 6)) as attempts from visits where status is null or status in (429, 500, 502, 503, 504))
  select cast(attempts as int) as attempts, count(*) filter (attempts + 1 <= 3) as retried, count(*) filter (attempts + 1 > 3) as given_up from t group by attempts""")
def crawl_retries(spark, d):
    """How failed visits fare after none to five further tries: three are made."""
    failed = _visits(spark, d).where(F.col("status").isNull() | F.col("status").isin(*C.TRANSIENT))
    t = failed.select("status", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempts"))
    yes = F.lit(True)
    t = t.withColumn("o", C.outcome(F.col("status"), F.lit("text/html"), yes, F.col("attempts"), yes, yes, F.lit(False)))
    return t.groupBy("attempts").agg(F.count_if(F.col("o") == "retry").alias("retried"), F.count_if(F.col("o") == "given_up").alias("given_up"))


@query(f"""with {_VISIT}, one as (select url, min({Q.key('canonical_url')}) as k from raw_pages where url is not null and canonical_url is not null group by url)
  select one.url, row_number() over (partition by one.k order by one.url) > 1 as again, s.k is not null as known from one left join saved s on one.k = s.k""")
def crawl_dedup(spark, d):
    """Which pages a round would drop: those whose canonical key was saved, and of several with one key all but the first."""
    pages = spark.read.parquet(f"{d}/raw_pages.parquet").where("url is not null and canonical_url is not null").groupBy("url").agg(F.min(U.url_key(F.col("canonical_url"))).alias("k"))
    pages = pages.join(_saved_keys(spark, d).withColumn("known", F.lit(True)), "k", "left")
    return pages.select("url", C.again("k", F.lit(True), "url").alias("again"), F.coalesce("known", F.lit(False)).alias("known"))


_ROBOTS = "select host, (array[200, 200, 404, 403])[cast(length(host) % 4 as int) + 1] as status from (select distinct {host} as host from links) where host <> ''"


@query(f"""with {_ALL_LINKS}, r as ({_ROBOTS.format(host=Q.host('url'))})
  select url, case when status = 403 then false when status = 404 then true else not (starts_with({Q.path('url')}, '/a') or starts_with({Q.path('url')}, '/p')) end as allowed from links join r on {Q.host('url')} = r.host""")
def robots_filter(spark, d):
    """All links under rules of their hosts: two of four hosts forbid paths, one has no rules, one forbids all."""
    links = _links(spark, d)
    hosts = links.select(U.host(F.col("url")).alias("host")).distinct().where("host != ''")
    status = F.element_at(F.array(F.lit(200), F.lit(200), F.lit(404), F.lit(403)), (F.length("host") % 4 + 1).cast("int"))
    rules = hosts.select("host", status.alias("status"), F.lit("User-agent: *\nDisallow: /a\nDisallow: /p\n").alias("body"))
    return robots_allowed(links.where(U.host(F.col("url")) != ""), rules, "gleaner").select("url", "allowed")


@query("select url, visited_at, status_code, count(*) as n from visited group by all")
def checkpoint_roundtrip(spark, d):
    """The visits after two saved versions of a checkpoint, read back."""
    folder = f"{workspace(spark)}/gleaner/checkpoint-{uuid.uuid4().hex}"
    visits = spark.read.parquet(f"{d}/visited.parquet")
    save_checkpoint(spark, folder, 1, visited=visits.limit(0))
    save_checkpoint(spark, folder, 2, visited=visits)
    return load_checkpoint(spark, folder)[1]["visited"].groupBy("url", "visited_at", "status_code").agg(F.count(F.lit(1)).alias("n"))
