"""Registered queries of retrieval within documents and collections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, answers, indexes, latent, retrieval, sections
from ..storage import apart, kept, sized, stored
from .queries import _TOKEN_SQL, _WIDE_SQL, _t, query

#: Each document is read as a policy of its own: six lines a page, 24 lines a section, categories in turn.
CATEGORIES = ["coverage", "definitions", "exclusions"]


def document_lines(spark, d) -> DataFrame:
    """(doc_id, block, page, line_no, line, title, category) of all documents, dealt by document."""
    rows = _t(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    rows = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.trim("line").alias("line")).where("line != ''")
    block = F.floor(F.col("i") / 24).cast("int")
    category = F.get(F.array(*map(F.lit, CATEGORIES)), block % len(CATEGORIES))
    return rows.select("doc_id", block.alias("block"), (F.floor(F.col("i") / 6) + 1).cast("int").alias("page"), F.col("i").alias("line_no"), "line", F.concat(F.lit("Part "), (block + 1).cast("string")).alias("title"), category.alias("category"))


#: Chunks: lines of a section until 1,000 characters, the last 150 and more of which begin the next chunk.
_CHUNK_SQL = f"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l1 AS (SELECT doc_id, i // 24 AS block, i // 6 + 1 AS page, i, trim(line) AS line FROM l0 WHERE trim(line) <> ''),
b AS (SELECT doc_id, block, list(line ORDER BY i) AS t, list(length(line) ORDER BY i) AS n, list(page ORDER BY i) AS p FROM l1 GROUP BY ALL),
cut AS (WITH RECURSIVE s AS (
 SELECT doc_id, block, n, 0::BIGINT AS i, 1::BIGINT AS first, 0::BIGINT AS size, false AS made, 0::BIGINT AS made_from FROM b UNION ALL
 SELECT doc_id, block, n, i + 1, CASE WHEN whole THEN coalesce(list_max(list_filter(range(first, i + 2), lambda s: list_sum(n[s:i + 1]) >= {sections.OVERLAP})), first) ELSE first END,
  CASE WHEN whole THEN list_sum(n[coalesce(list_max(list_filter(range(first, i + 2), lambda s: list_sum(n[s:i + 1]) >= {sections.OVERLAP})), first):i + 1])::BIGINT ELSE size + n[i + 1] + 1 END, whole, first
 FROM (SELECT *, size + n[i + 1] + 1 >= {sections.CHUNK} OR i + 1 = len(n) AS whole FROM s WHERE i < len(n)))
 SELECT doc_id, block, made_from AS a, i AS z FROM s WHERE made),
c0 AS (SELECT doc_id, block, z, array_to_string(t[a:z], chr(10)) AS body, p[a] AS page_start, p[z] AS page_end, 'Part ' || (block + 1) AS title, ['coverage', 'definitions', 'exclusions'][(block % 3 + 1)::INT] AS category FROM cut JOIN b USING (doc_id, block)),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, z) AS chunk, CASE WHEN starts_with(body, title) THEN body ELSE '[' || title || ']' || chr(10) || body END AS text, page_start, page_end, title, category
 FROM c0 WHERE length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) > {sections.LEAST})"""


@query(f"WITH {_CHUNK_SQL} SELECT doc_id, chunk, md5(text) AS text_md5, page_start::INT AS page_start, page_end::INT AS page_end, title, category, 'doc ' || doc_id || ', ' || CASE WHEN page_start = page_end THEN 'p.' || page_start ELSE 'pp.' || page_start || '-' || page_end END || ', § ' || title AS citation FROM c")
def document_chunks(spark, d):
    """Overlapping chunks of the sections of all documents, and how each is cited."""
    got = sections.chunks(document_lines(spark, d))
    cited = sections.citation(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("page_start"), F.col("page_end"), F.col("title"))
    return got.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("text_md5"), "page_start", "page_end", "title", "category", cited.alias("citation"))


_STOPPED = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in indexes.STOP_WORDS) + "], w))"
_TERMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def _scored_sql(texts: str, by: str, key: str) -> str:
    """CTEs from texts(by, key, text), asks(by, query_id) and questions(query_id, text) to sparse(by, query_id, key, sparse)."""
    return f"""x0 AS (SELECT {by}, {key}, {_STOPPED.format('text')} AS w FROM {texts}),
x1 AS (SELECT {by}, {key}, unnest({_TERMS}) AS term FROM x0), x2 AS (SELECT {by}, {key}, term, count(*) AS tf FROM x1 GROUP BY ALL),
x3 AS (SELECT {by}, count(*) AS n FROM {texts} GROUP BY {by}), x4 AS (SELECT {by}, term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM x2 JOIN x3 USING ({by}) GROUP BY {by}, term, n),
x5 AS (SELECT {by}, {key}, term, (1 + ln(tf)) * idf AS w, idf FROM x2 JOIN x4 USING ({by}, term)), x6 AS (SELECT {by}, {key}, sqrt(sum(w * w)) AS norm FROM x5 GROUP BY ALL),
y0 AS (SELECT query_id, {_STOPPED.format('text')} AS w FROM questions), y1 AS (SELECT query_id, unnest({_TERMS}) AS term FROM y0), y2 AS (SELECT query_id, term, 1 + ln(count(*)) AS qtf FROM y1 GROUP BY ALL),
y3 AS (SELECT {by}, query_id, term, qtf * idf AS qw FROM asks JOIN y2 USING (query_id) JOIN x4 USING ({by}, term)), y4 AS (SELECT {by}, query_id, sqrt(sum(qw * qw)) AS length FROM y3 GROUP BY ALL),
sparse AS (SELECT {by}, query_id, {key}, sum(w / norm * qw) / any_value(length) AS sparse FROM x5 JOIN x6 USING ({by}, {key}) JOIN y3 USING ({by}, term) JOIN y4 USING ({by}, query_id) GROUP BY {by}, query_id, {key})"""


_ASK_SQL = f"questions AS (SELECT query_id, {_WIDE_SQL} AS text FROM (SELECT item_id AS query_id, text AS q FROM benchmark))"
_WORTH = f"sparse * CASE WHEN category = 'definitions' AND NOT coalesce(regexp_matches(lower(b.text), '\\bmean|defin'), false) THEN 0.8 ELSE 1 END * CASE WHEN category = '{CATEGORIES[0]}' THEN 1.15 ELSE 1 END"


def _asked(spark, d) -> tuple[DataFrame, DataFrame]:
    """(questions(query_id, text) with synonyms, meaning(query_id, asks_meaning)): a question for each benchmark passage."""
    b = kept(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return b.select("query_id", answers.expanded(F.col("text")).alias("text")), b.select("query_id", F.coalesce(F.lower("text").rlike(r"\bmean|defin"), F.lit(False)).alias("asks_meaning"))


def _hits(spark, d, asks: DataFrame, k: int, asked: tuple[DataFrame, DataFrame] | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each document for what asks(doc_id, query_id) puts to it, without their text."""
    questions, meaning = asked or _asked(spark, d)
    chunks = (sections.chunks(document_lines(spark, d)) if chunks is None else chunks).withColumn("chunk", F.col("chunk").cast("long"))
    chunks = chunks.withColumn("size", F.length("text") + F.length("title") + F.length(F.col("page_start").cast("string")) + 9)
    index = stored(indexes.indexed(chunks, "doc_id", "chunk", questions, indexes.STOP_WORDS, asks=asks))
    scores = indexes.sparse_scores(index, "doc_id", "chunk", asks, questions, indexes.STOP_WORDS)
    about = index.select("doc_id", "chunk", "category", "page_start", "page_end", "title", "size")
    scores = scores.join(apart(about), ["doc_id", "chunk"]).join(F.broadcast(meaning), "query_id").withColumnsRenamed({"sparse": "score"}).withColumn("wanted", F.array(F.lit(CATEGORIES[0])))
    return indexes.best(retrieval.adjusted(scores), ["doc_id", "query_id"], "chunk", k)


@query(f"""WITH {_CHUNK_SQL}, {_ASK_SQL}, asks AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS query_id FROM documents WHERE text IS NOT NULL),
{_scored_sql('c', 'doc_id', 'chunk')},
r AS (SELECT doc_id, query_id, chunk, page_start, {_WORTH} AS score FROM sparse JOIN c USING (doc_id, chunk) JOIN benchmark b ON b.item_id = query_id),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id ORDER BY round(score, 6) DESC, chunk) AS rank FROM r WHERE score > 0)
SELECT doc_id, query_id, rank, chunk, page_start::INT AS page_start, round(score, 5) AS score FROM z WHERE rank <= 5""")
def policy_search(spark, d):
    """An index for each document, which is asked one of the questions: its five best chunks."""
    n = _t(spark, d, "benchmark").count()
    asks = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.col("doc_id") % n).alias("query_id"))
    got = _hits(spark, d, asks, 5)
    return got.select("doc_id", "query_id", F.col("rank").cast("long").alias("rank"), "chunk", "page_start", F.round("score", 5).alias("score"))


GROUPS, EACH, BUDGET = 2, 3, 2_500


@query(f"""WITH RECURSIVE {_CHUNK_SQL}, {_ASK_SQL}, asks AS (SELECT DISTINCT doc_id, (doc_id + 7 * j) % (SELECT count(*) FROM benchmark) AS query_id, j FROM documents, range({GROUPS * EACH}) r(j) WHERE text IS NOT NULL),
{_scored_sql('c', 'doc_id', 'chunk').replace('FROM asks JOIN', 'FROM (SELECT DISTINCT doc_id, query_id FROM asks) JOIN')},
r AS (SELECT doc_id, query_id, chunk, length(c.text) + length(title) + length(page_start::VARCHAR) + 9 AS size, {_WORTH} AS score FROM sparse JOIN c USING (doc_id, chunk) JOIN benchmark b ON b.item_id = query_id),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id ORDER BY round(score, 6) DESC, chunk) AS rank FROM r WHERE score > 0),
h AS (SELECT doc_id, j // {EACH} AS part, j AS q, rank, chunk, size, row_number() OVER (PARTITION BY doc_id, j // {EACH} ORDER BY j, rank) AS seq FROM z JOIN asks USING (doc_id, query_id) WHERE rank <= 4),
f AS (SELECT doc_id, part, 0::BIGINT AS seq, 0::BIGINT AS size, NULL::BIGINT AS ended, []::BIGINT[] AS keys FROM h GROUP BY ALL UNION ALL
 SELECT f.doc_id, f.part, h.seq, CASE WHEN past OR NOT fits THEN f.size ELSE f.size + h.size END, CASE WHEN NOT past AND NOT fits THEN h.q ELSE f.ended END, CASE WHEN past OR NOT fits THEN f.keys ELSE list_append(f.keys, h.chunk) END
 FROM f JOIN h ON h.doc_id = f.doc_id AND h.part = f.part AND h.seq = f.seq + 1, LATERAL (SELECT list_contains(f.keys, h.chunk) OR coalesce(f.ended = h.q, false) AS past, f.size + h.size <= {BUDGET} AS fits)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY seq DESC) = 1)
SELECT doc_id, part, array_to_string(keys, ' ') AS chunks, size FROM o""")
def packed_contexts(spark, d):
    """For two groups of three questions to each document, the chunks that fit a context of bounded size, in order."""
    n = _t(spark, d, "benchmark").count()
    j = F.explode(F.sequence(F.lit(0), F.lit(GROUPS * EACH - 1))).alias("j")
    asks = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", j).select("doc_id", ((F.col("doc_id") + 7 * F.col("j")) % n).alias("query_id"), "j")
    got = _hits(spark, d, asks.select("doc_id", "query_id").distinct(), 4)
    rows = got.join(apart(asks), ["doc_id", "query_id"]).select("doc_id", F.floor(F.col("j") / EACH).alias("part"), F.col("j").alias("query"), "rank", F.col("chunk").alias("key"), "size")
    return indexes.packed(rows, ["doc_id", "part"], BUDGET).select("doc_id", "part", F.array_join("parts", " ").alias("chunks"), "size")


@query(f"""WITH t AS (SELECT doc_id // 100 AS shelf, doc_id, text FROM documents), v AS (SELECT vec_id // 100 AS shelf, vec_id AS doc_id, embedding AS v FROM embeddings),
questions AS (SELECT doc_id AS query_id, left(text, 300) AS text FROM documents WHERE doc_id % 50 = 0), asks AS (SELECT query_id // 100 AS shelf, query_id FROM questions),
{_scored_sql('t', 'shelf', 'doc_id')}, q AS (SELECT doc_id AS query_id, shelf, v AS qv FROM v WHERE doc_id % 50 = 0),
dense AS (SELECT shelf, query_id, doc_id, list_dot_product(v::DOUBLE[], qv::DOUBLE[]) AS dense FROM v JOIN q USING (shelf)),
m AS (SELECT DISTINCT shelf FROM v), b AS (SELECT shelf, query_id, doc_id, coalesce(sparse, 0) AS s, coalesce(dense, 0) AS d, shelf IN (SELECT shelf FROM m) AS hybrid FROM sparse FULL JOIN dense USING (shelf, query_id, doc_id)),
r AS (SELECT *, CASE WHEN hybrid THEN {indexes.SPARSE} * s + {indexes.DENSE} * greatest(d, 0) ELSE s END AS score FROM b),
z AS (SELECT *, row_number() OVER (PARTITION BY shelf, query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT shelf, query_id, doc_id, rank, round(score, 5) AS score, CASE WHEN hybrid THEN 'hybrid' ELSE 'TF-IDF' END AS mode FROM z WHERE rank <= 5""")
def fused_search(spark, d):
    """Shelves of a hundred documents, each an index; words and vectors together where a shelf has vectors."""
    texts = _t(spark, d, "documents").select(F.expr("doc_id div 100").alias("shelf"), "doc_id", "text")
    vectors = _t(spark, d, "embeddings").select(F.expr("vec_id div 100").alias("shelf"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    own = F.col("doc_id") % 50 == 0
    questions = kept(texts.where(own).select(F.col("doc_id").alias("query_id"), F.left("text", F.lit(300)).alias("text")))
    asks = questions.select(F.expr("query_id div 100").alias("shelf"), "query_id")
    index = stored(indexes.indexed(texts.repartition("shelf"), "shelf", "doc_id", questions, indexes.STOP_WORDS, asks=asks))
    sparse = indexes.sparse_scores(index, "shelf", "doc_id", asks, questions, indexes.STOP_WORDS)
    asked = vectors.where(own).select(F.col("doc_id").alias("query_id"), F.col("v").alias("qv"))
    dense = indexes.dense_scores(vectors, "shelf", "doc_id", asked.select(F.expr("query_id div 100").alias("shelf"), "query_id"), asked)
    mode = kept(indexes.modes(texts, vectors, "shelf"))
    got = indexes.fused(sparse, dense, "shelf", "doc_id", mode).join(mode, "shelf")
    return got.select("shelf", "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"), F.when(F.col("hybrid"), "hybrid").otherwise("TF-IDF").alias("mode"))


@query()
def hybrid_policy_search(spark, d):
    """R03-R12 together: a document's chunks by words and by vectors of their own decomposition (R04), its one question, the five best."""
    questions, _ = _asked(spark, d)
    questions = kept(questions)
    n = questions.count()
    chunks = stored(sections.chunks(document_lines(spark, d)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text"))
    asks = chunks.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % n).alias("query_id"))
    index = stored(indexes.indexed(chunks.repartition("doc_id"), "doc_id", "chunk", questions, indexes.STOP_WORDS, asks=asks))
    sparse = indexes.sparse_scores(index, "doc_id", "chunk", asks, questions, indexes.STOP_WORDS)
    named = chunks.select(F.struct("doc_id", "chunk").alias("id"), "text")
    model = latent.fit(named, "id", indexes.STOP_WORDS)
    vectors = model.own().select("id.doc_id", "id.chunk", "v")
    asked = model.vectors(questions, "query_id").withColumnRenamed("v", "qv")
    dense = indexes.dense_scores(vectors, "doc_id", "chunk", asks, asked)
    mode = chunks.select("doc_id", F.lit(True).alias("hybrid")).distinct()
    got = indexes.fused(sparse, dense, "doc_id", "chunk", mode)
    return got.select("doc_id", "query_id", "chunk", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


_SENTENCES_SQL = r"""list_filter(list_transform(string_split(list_reduce(string_split(regexp_replace(replace(text, chr(10), ' '), '([.;])\s+([A-Z(\d"''“])', '\1' || chr(1) || '\2', 'g'), chr(1)),
 lambda a, p: a || CASE WHEN regexp_matches(a, '(?i)(?:(?:^|[^\p{L}\p{N}_])(?:rs|no|nos|e\.g|i\.e|viz|etc|sr|dr|mr|mrs|ms|st|vs|approx|max|min|cl|sec|art)|(?:^|[^\p{L}\p{N}_])[a-z]|\d)\.$') THEN ' ' ELSE chr(2) END || p), chr(2)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"""
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_SYNONYM_SQL = "CASE t " + " ".join(f"WHEN {_QUOTED(k)} THEN list_has_any({_TOKEN_SQL(_QUOTED(v))}, said)" for k, v in answers.SYNONYMS.items()) + " ELSE false END"
_WORD_SQL = {k: _TOKEN_SQL(k) for k in ("q", "wide", "sentence", "text")}


@query(f"""WITH {_CHUNK_SQL}, asked AS (SELECT item_id * 2 + a AS query_id, text || CASE WHEN a = 1 THEN ' Should I buy it?' ELSE '' END AS q FROM benchmark, range(2) r(a)), questions AS (SELECT query_id, {_WIDE_SQL} AS text FROM asked),
asks AS (SELECT doc_id, (doc_id % (SELECT count(*) FROM benchmark)) * 2 + (doc_id % 3 = 0)::INT AS query_id FROM documents WHERE text IS NOT NULL), {_scored_sql('c', 'doc_id', 'chunk')},
r AS (SELECT doc_id, query_id, chunk, c.text, title, page_start, page_end, q, {_WORTH.replace('b.text', 'q')} AS score FROM sparse JOIN c USING (doc_id, chunk) JOIN asked USING (query_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, chunk) AS rank FROM r WHERE score > 0 QUALIFY rank <= 5),
h AS (SELECT *, 'doc ' || doc_id || ', ' || CASE WHEN page_start = page_end THEN 'p.' || page_start ELSE 'pp.' || page_start || '-' || page_end END || ', § ' || title AS cited, {_SENTENCES_SQL} AS s FROM z),
x AS (SELECT doc_id, rank, q, {_WIDE_SQL} AS wide, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM h),
w AS (SELECT *, {_WORD_SQL['q']} AS asked, {_WORD_SQL['wide']} AS wider, {_WORD_SQL['sentence']} AS words FROM x),
y AS (SELECT *, round((2 * len(list_intersect(asked, words)) + len(list_intersect(wider, words)))::DOUBLE - 0.3::DOUBLE * rank + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.5 ELSE 0 END - CASE WHEN contains(lower(sentence), ' means ') AND NOT regexp_matches(lower(q), '\\bmean|defin') THEN 2 ELSE 0 END, 6) AS points
 FROM w WHERE len(list_intersect(asked, words)) > 0 AND length(sentence) > 30),
e AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, left(sentence, 50) ORDER BY points DESC, rank, pos) = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, rank, pos) AS n FROM e QUALIFY n <= 3),
l AS (SELECT doc_id, string_agg('- ' || left(sentence, 350) || ' [S' || rank || ']', chr(10) ORDER BY n) AS lines FROM g GROUP BY doc_id),
m AS (SELECT doc_id, any_value(q) AS q, max(score) AS best, count(*) AS n_hits, list_distinct(flatten(list({_WORD_SQL['text']}))) AS said, list(cited ORDER BY rank) AS cited, string_agg('[S' || rank || '] (' || cited || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY doc_id),
o AS (SELECT *, list_sort(list_filter({_WORD_SQL['q']}, lambda t: length(t) > 2 AND NOT list_contains(said, t) AND NOT list_contains([{", ".join(_QUOTED(v) for v in answers.GENERIC)}], t) AND NOT {_SYNONYM_SQL})) AS missing FROM m),
a AS (SELECT o.*, CASE WHEN best >= {answers.WEAK} AND lines IS NOT NULL THEN CASE WHEN len(missing) > 0 THEN {_QUOTED(answers.NOT_FOUND + ' The document does not mention: ')} || array_to_string(missing, ', ') || '. ' || {_QUOTED(answers.CLOSEST)} ELSE {_QUOTED(answers.FOUND)} END || lines || {_QUOTED(answers.VERIFY)} ELSE {_QUOTED(answers.NOT_FOUND)} END AS extract,
 doc_id % 3 = 0 AS advice FROM o LEFT JOIN l USING (doc_id)),
fin AS (SELECT *, CASE WHEN advice THEN {_QUOTED(analysis.PREAMBLE + 'what the document says so you can discuss it with a licensed advisor:')} || chr(10) || chr(10) ELSE '' END || extract AS own FROM a)
SELECT doc_id, n_hits, round(best, 5) AS best, advice, advice AND doc_id % 6 = 0 OR (best >= {answers.WEAK} AND NOT contains(own, {_QUOTED(answers.NOT_FOUND)})) AS grounded, md5(context) AS context_md5,
 md5(CASE WHEN advice AND doc_id % 6 = 0 THEN {_QUOTED(analysis.PREAMBLE + 'a factual summary to discuss with a licensed advisor:')} || chr(10) || chr(10) || 'Facts of ' || doc_id WHEN best < {answers.WEAK} THEN {_QUOTED(answers.NOT_FOUND + ' Please ask the insurer to point you to the exact clause.')}
 WHEN regexp_matches(own, '\\[S\\d+\\]') OR contains(own, {_QUOTED(answers.NOT_FOUND)}) THEN own ELSE own || chr(10) || chr(10) || 'Sources: ' || array_to_string(list_transform(cited[1:3], lambda v, i: '[S' || i || '] ' || v), '; ') END) AS answer_md5 FROM fin""")
def policy_answers(spark, d):
    """From a question to a cited answer: each document's index, its best chunks, their sentences, refusals and routes."""
    b = _t(spark, d, "benchmark")
    n = b.count()
    say = F.concat("text", F.when(F.col("a") == 1, " Should I buy it?").otherwise(""))
    asked = kept(b.select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("a")).select((F.col("item_id") * 2 + F.col("a")).alias("query_id"), say.alias("question")))
    questions = asked.select("query_id", answers.expanded(F.col("question")).alias("text"))
    meaning = asked.select("query_id", F.coalesce(F.lower("question").rlike(r"\bmean|defin"), F.lit(False)).alias("asks_meaning"))
    asks = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", ((F.col("doc_id") % n) * 2 + (F.col("doc_id") % 3 == 0).cast("int")).alias("query_id"))
    chunks = stored(sections.chunks(document_lines(spark, d)))
    best = _hits(spark, d, asks, 5, (questions, meaning), chunks.repartition("doc_id"))
    cited = sections.citation(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("page_start"), F.col("page_end"), F.col("title"))
    hits = best.join(apart(chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")), ["doc_id", "chunk"]).join(sized(asked), "query_id")
    hits = stored(hits.select(F.col("doc_id").alias("question_id"), "question", "rank", "text", "score", cited.alias("citation"), "page_start"))
    lists = hits.groupBy("question_id").agg(F.first("question").alias("question"), F.max("score").alias("best"), F.count("*").alias("n_hits"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda x: x["citation"]).alias("citations"))
    rows = lists.join(apart(answers.answered(hits).select("question_id", F.col("answer").alias("extract"))), "question_id")
    rows = rows.withColumn("decision", F.when(F.col("question_id") % 6 == 0, F.concat(F.lit("Facts of "), F.col("question_id").cast("string"))))
    got = analysis.routed(rows).join(apart(lists.select("question_id", "best", "n_hits")), "question_id").join(apart(answers.context(hits).select("question_id", "context")), "question_id")
    return got.select(F.col("question_id").alias("doc_id"), "n_hits", F.round("best", 5).alias("best"), "advice", "grounded", F.md5("context").alias("context_md5"), F.md5("answer").alias("answer_md5"))
