"""The registered queries of the reference's operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, clauses, cleaning, comparison, evaluation, retrieval, scoring, sections, validation
from ..operators.cleaning import first_of
from ..storage import dealt, kept, nearby, sized

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """df for costly expressions of each row: dealt over all cores where its files leave some idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- cleaning
@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(line, '[ \t\x{00A0}]+', ' ', 'g')) AS line FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '' AND NOT regexp_matches(line, '(?i)^\s*(page\s*)?\d{1,3}(\s*(of|/)\s*\d{1,3})?\s*$')) AS n_kept,
       sum(length(line))::BIGINT AS n_chars FROM n GROUP BY doc_id""")
def line_cleaning(spark, d):
    """Lines of whole documents, normal and without page numbers."""
    rows = _dealt(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.lines(T.dehyphenate(F.col("text")))).alias("line")).withColumn("line", T.normal_line(F.col("line")))
    keep = (F.col("line") != "") & ~T.page_number(F.col("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(keep).alias("n_kept"), F.sum(F.length("line")).alias("n_chars"))


def _as_pages(spark, d) -> DataFrame:
    """Documents as pages of six lines each."""
    rows = _dealt(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.groupBy("doc_id", F.floor(F.col("i") / 6).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i // 6 AS page, i, trim(line) AS line FROM l WHERE trim(line) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) AS z FROM s),
e AS (SELECT DISTINCT doc_id, page, line FROM r WHERE a <= 3 OR z <= 3),
c AS (SELECT doc_id, regexp_replace(line, '\d+', '#', 'g') AS masked, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT doc_id, count(DISTINCT i // 6) AS pages FROM l GROUP BY doc_id)
SELECT doc_id, masked FROM c JOIN p USING (doc_id) WHERE pages >= 3 AND n >= greatest(2, pages // 2)""")
def repeated_edge_lines(spark, d):
    """Running headers and footers."""
    return cleaning.repeated_lines(_as_pages(spark, d))


def _masks_sql(text: str) -> str:
    """The masks in order; where a look at the neighbours is needed, these are captured, and a second pass sees those that two matches share."""
    for pattern, put in T.MASKS:
        put = put.replace("$1", "\\1")
        if "(?<!\\d)" in pattern:
            inner = pattern.replace("(?<!\\d)", "").replace("(?!\\d)", "")
            pattern, put = rf"(^|[^0-9])({inner})([^0-9]|$)", rf"\1{put}\3"
            text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
        text = f"""regexp_replace({text}, '{pattern.replace("'", "''")}', '{put}', 'g')"""
    return text


@query(f"SELECT doc_id, md5({_masks_sql('text')}) AS masked_md5 FROM documents")
def personal_data_masked(spark, d):
    """All seven masks on whole texts."""
    return _dealt(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(T.anonymize(F.col("text"))).alias("masked_md5"))


@query("SELECT doc_id, sum(length(text))::BIGINT AS chars, sum(length(text)) >= 200 AS ok FROM documents GROUP BY doc_id")
def minimum_text(spark, d):
    """Documents with enough text to be analysed."""
    return cleaning.long_enough(_t(spark, d, "documents").select("doc_id", "text"))


_HEADS = ["Waiting Period for pre-existing disease", "Code - Excl02 Specified disease", "Code - Excl18 MATERNITY", "SECTION D CO-PAYMENT", "CLAIMS AND CASHLESS", "Renewal and portability", "Definitions", "Scope of benefits", "General terms", "List of stones"]


def _heads(col) -> Column:
    return F.element_at(F.array(*map(F.lit, _HEADS)), (F.pmod(col, F.lit(len(_HEADS))) + 1).cast("int"))


_HEAD_SQL = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END"
_CATEGORY_SQL = (
    r"CASE WHEN regexp_extract(lower(h), 'excl\s?-?\s?(\d{1,2})', 1) <> '' THEN CASE WHEN regexp_extract(lower(h), 'excl\s?-?\s?(\d{1,2})', 1)::INT <= 3 THEN 'waiting_period' ELSE 'exclusions' END "
    + " ".join(f"WHEN {' OR '.join(f"contains(lower(h), '{w}')" for w in ws)} THEN '{c}'" for c, ws in T.CATEGORIES) + " END"
)


@query(rf"""
WITH r AS (SELECT p_partkey, p_size, p_size || '. ' || {_HEAD_SQL} || CASE WHEN p_size % 3 = 0 THEN ' ' || p_name ELSE '' END AS h FROM part),
m AS (SELECT *, length(regexp_replace(h, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(h, '\P{{Lu}}', '', 'g')) AS caps, len(list_filter(regexp_split_to_array(h, '\s+'), lambda w: w <> '')) AS words FROM r)
SELECT p_partkey, {_CATEGORY_SQL} AS category, letters >= 5 AND caps > 0.8 * letters AS is_upper,
  length(h) BETWEEN 3 AND 95 AND NOT regexp_matches(h, '[,;/\-&]\s*$') AND letters >= 3 AND
  ((letters >= 5 AND caps > 0.8 * letters AND words <= 12 AND NOT regexp_matches(h, '\.$')) OR
   (regexp_matches(h, '(?i)^(section\s+[a-z0-9]+\b|part\s+[a-z0-9]+\b|[a-z]?\d{{1,2}}(\.\d{{1,2}}){{0,3}}[.)]?\s*[A-Za-z(]|[a-z]\.\d{{1,2}}(\.\d{{1,2}})?\s+[A-Z]|code\s*[-:]?\s*excl\s?\d+)') AND words <= 12 AND NOT regexp_matches(h, '\.\s*$')) OR
   (regexp_matches(h, '(?i)code\s*[-:]?\s*excl\s?\d{{1,2}}') AND words <= 14)) AS is_heading,
  p_size AS number FROM m""")
def headings(spark, d):
    """Category, capitals, heading test and number of headings made from parts."""
    h = F.concat(F.col("p_size").cast("string"), F.lit(". "), _heads(F.col("p_partkey")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    rows = _dealt(_t(spark, d, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", h.alias("h"))
    return rows.select("p_partkey", T.category(F.col("h")).alias("category"), T.upper_case(F.col("h")).alias("is_upper"), T.heading(F.col("h")).alias("is_heading"), T.section_number(F.col("h"))["top"].cast("int").alias("number"))


@query(r"""
WITH p AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.;])\s+([A-Z(\d"''“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x) AS parts, text FROM documents)
SELECT doc_id, 1 + len(list_filter(range(2, len(parts) + 1), lambda i: NOT regexp_matches(parts[i - 1],
  '(?i)(?:(?:^|[^\p{L}\p{N}_])(?:rs|no|nos|e\.g|i\.e|viz|etc|sr|dr|mr|mrs|ms|st|vs|approx|max|min|cl|sec|art)|(?:^|[^\p{L}\p{N}_])[a-z]|\d)\.$'))) AS n_sentences FROM p WHERE trim(regexp_replace(text, '\s', '', 'g')) <> ''""")
def sentence_split(spark, d):
    """Sentences of whole documents."""
    return _dealt(_t(spark, d, "documents").select("doc_id", "text")).where(F.col("text").rlike(r"\S")).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


# ---------------------------------------------------------------- features and score
def _policies(spark, d) -> DataFrame:
    """A policy for each customer, its values drawn from the key and the balance."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    mod = lambda n: F.pmod(k, F.lit(n))
    return _t(spark, d, "customer").select(
        k.alias("policy_id"), F.when(mod(7) != 0, (mod(50) + 1) * 100_000).alias("sum_insured"), F.when(b > 0, F.floor(b * 10).cast("long")).alias("annual_premium"),
        F.when(mod(5) != 0, mod(9) * 6).alias("waiting_period_months"), F.when(mod(11) != 0, mod(5) * 12).alias("pre_existing_disease_waiting_period_months"),
        F.when(mod(3) != 0, mod(4) * 10.0).alias("copayment_percentage"), F.when(mod(13) != 0, mod(24)).alias("exclusion_count"), mod(2).alias("room_rent_limit_present"), F.when(mod(6) > 2, 1).otherwise(0).alias("icu_limit_present"),
        mod(8).alias("disease_sub_limit_count"), mod(2).alias("restoration_benefit_present"), F.when(mod(4) > 1, 1).otherwise(0).alias("no_claim_bonus_present"), F.when(mod(10) > 6, 1).otherwise(0).alias("child_coverage_present"),
        F.when(mod(9) > 4, 1).otherwise(0).alias("maternity_coverage_present"), scoring.claim_clarity([mod(2) == 0, mod(3) == 0, mod(5) == 0, mod(7) == 0, mod(11) == 0]).alias("claim_process_clarity_score"), mod(9).alias("ambiguous_clause_count"),
    )


_POLICIES_SQL = """
p0 AS (SELECT c_custkey AS k, c_custkey AS policy_id, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50 + 1) * 100000 END AS sum_insured, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal * 10)::BIGINT END AS annual_premium,
 CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 9 * 6 END AS waiting_period_months, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 5 * 12 END AS pre_existing_disease_waiting_period_months,
 CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 * 10.0::DOUBLE END AS copayment_percentage, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 24 END AS exclusion_count, c_custkey % 2 AS room_rent_limit_present, (c_custkey % 6 > 2)::INT AS icu_limit_present,
 c_custkey % 8 AS disease_sub_limit_count, c_custkey % 2 AS restoration_benefit_present, (c_custkey % 4 > 1)::INT AS no_claim_bonus_present, (c_custkey % 10 > 6)::INT AS child_coverage_present, (c_custkey % 9 > 4)::INT AS maternity_coverage_present,
 least(100, 35 + 13 * ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT + (c_custkey % 11 = 0)::INT)) AS claim_process_clarity_score, c_custkey % 9 AS ambiguous_clause_count FROM customer),
p1 AS (SELECT * REPLACE (""" + ", ".join(f"coalesce({k}, {v}) AS {k}" for k, v in scoring.IMPUTED.items()) + "), " + " + ".join(f"({k} IS NULL)::INT" for k in scoring.IMPUTED) + """ AS n_unclear FROM p0),
p2 AS (SELECT *, format('{:.4f}', (annual_premium / greatest(sum_insured, 1))::DOUBLE)::DOUBLE AS premium_to_coverage_ratio FROM p1),
p3 AS (SELECT * REPLACE (""" + ", ".join(f"least(greatest({k}, {lo}), {hi}) AS {k}" for k, (lo, hi) in scoring.RANGES.items()) + ") FROM p2),\np4 AS (SELECT *, " + " + ".join(f"({f} {op} {b})::INT" for f, op, b, _ in scoring.FLAGS) + """ AS risk_flags_count FROM p3),
p5 AS (SELECT *, least(100.0, greatest(0.0, 103.0 + """ + " + ".join(f"{k}::DOUBLE * {w}::DOUBLE" for k, w in scoring.WEIGHTS.items()) + ")) AS raw_score FROM p4)"  # fmt: skip


@query(f"WITH {_POLICIES_SQL} SELECT policy_id, n_unclear, premium_to_coverage_ratio::DOUBLE AS premium_to_coverage_ratio, sum_insured::BIGINT AS sum_insured, exclusion_count::BIGINT AS exclusion_count, risk_flags_count::BIGINT AS risk_flags_count FROM p4")
def policy_features(spark, d):
    """Filled, clipped, flagged features."""
    return scoring.featured(_policies(spark, d)).select("policy_id", F.size("unclear").alias("n_unclear"), F.col("premium_to_coverage_ratio").cast("double").alias("premium_to_coverage_ratio"), F.col("sum_insured").cast("long").alias("sum_insured"), F.col("exclusion_count").cast("long").alias("exclusion_count"), F.col("risk_flags_count").cast("long").alias("risk_flags_count"))


@query(f"WITH {_POLICIES_SQL} SELECT policy_id, raw_score, round_even(raw_score, 0)::INT AS score, CASE WHEN raw_score >= 80 THEN 'Strong Coverage' WHEN raw_score >= 58 THEN 'Moderate Coverage' WHEN raw_score >= 38 THEN 'Caution Required' ELSE 'High Risk' END AS label, "
       + " + ".join(f"(abs(({k} * {w})::DOUBLE) >= 0.5)::INT" for k, w in scoring.WEIGHTS.items()) + " AS n_reasons FROM p5")
def policy_scores(spark, d):
    """The transparent score with its reasons and label."""
    return scoring.scored(scoring.featured(_policies(spark, d))).select("policy_id", "raw_score", "score", "label", F.size("reasons").alias("n_reasons"))


@query(f"WITH {_POLICIES_SQL} SELECT policy_id, i - 1 AS ord, f.severity AS severity, f.flag AS flag FROM (SELECT policy_id, unnest(l) AS f, generate_subscripts(l, 1) AS i FROM (SELECT policy_id, list_filter(["
       + ", ".join(f"CASE WHEN {f} {op} {b} THEN {{'severity': '{'High' if f in scoring.HIGH else 'Medium'}', 'flag': '{t}'}} END" for f, op, b, t in scoring.FLAGS) + "], lambda x: x IS NOT NULL) AS l FROM p4))")
def risk_flags(spark, d):
    """Flags in order with their severity."""
    return scoring.featured(_policies(spark, d)).select("policy_id", F.posexplode("flags").alias("ord", "f")).select("policy_id", F.col("ord").cast("long").alias("ord"), "f.severity", "f.flag")


@query(f"WITH {_POLICIES_SQL}, s AS (SELECT CASE WHEN raw_score >= 80 THEN 'Strong Coverage' WHEN raw_score >= 58 THEN 'Moderate Coverage' WHEN raw_score >= 38 THEN 'Caution Required' ELSE 'High Risk' END AS label, raw_score, risk_flags_count, annual_premium FROM p5) SELECT label, count(*) AS n, min(raw_score) AS least, max(raw_score) AS most, round(avg(risk_flags_count), 6) AS mean_flags, quantile_cont(annual_premium, 0.5)::DOUBLE AS median_premium FROM s GROUP BY label")
def label_profile(spark, d):
    """Labels with counts, ranges, means and quartiles."""
    s = scoring.scored(scoring.featured(_policies(spark, d)))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.min("raw_score").alias("least"), F.max("raw_score").alias("most"), F.round(F.avg("risk_flags_count"), 6).alias("mean_flags"), F.percentile("annual_premium", F.lit(0.5)).cast("double").alias("median_premium"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr_quantity, round(corr(l_discount, l_extendedprice), 8) AS corr_discount, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def correlations(spark, d):
    """Correlations with a target and a line fitted by least squares."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return _t(spark, d, "lineitem").agg(F.round(F.corr(x, y), 8).alias("corr_quantity"), F.round(F.corr("l_discount", y), 8).alias("corr_discount"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))


@query("SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS \"column\", count(*) AS rows, unnest([sum((event_id IS NULL)::INT), sum((ts IS NULL)::INT), sum((user_id IS NULL)::INT), sum((event_type IS NULL)::INT), sum((value IS NULL)::INT), sum((props IS NULL)::INT)])::BIGINT AS nulls FROM events")
def null_profile(spark, d):
    """Rows and nulls of each column."""
    return evaluation.null_profile(_t(spark, d, "events"))


# ---------------------------------------------------------------- questions
@query(r"""SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '(?i)\b(should i|shall i|do i|must i|is it (good|better|worth)|which (one|policy) (is|should)|recommend|buy|switch|port|cancel|worth it)\b') AS advice,
 md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace('You should buy it. ' || text, '(?i)\byou should (definitely )?(buy|purchase|switch|cancel|port|take)\b', 'you may want to discuss with an advisor whether to', 'g'),
 '(?i)\b(i|we) recommend (buying|switching|cancelling|purchasing)\b', 'an advisor can help you evaluate', 'g'), '(?i)\b(do not|don''t) (buy|switch|cancel)\b', 'carefully evaluate before you', 'g'),
 '(?i)\bthis is the best policy\b', 'this policy appears stronger in some areas', 'g')) AS safe_md5 FROM conversations""")
def guardrails(spark, d):
    """Q01, Q02: questions for advice; advice that isn't given replaced."""
    return _t(spark, d, "conversations").select("conv_id", "turn", T.asks_advice(F.col("text")).alias("advice"), F.md5(T.sanitize(F.concat(F.lit("You should buy it. "), F.col("text")))).alias("safe_md5"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\\-]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP) + "], w))), ' ') AS tokens FROM conversations")
def question_tokens(spark, d):
    """Q03: distinct words of weight."""
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.tokens(F.col("text"))), " ").alias("tokens"))


@query("SELECT text, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1")
def first_questions(spark, d):
    """Each question where it is first asked."""
    return first_of(_t(spark, d, "conversations").where("role = 'user'").select("text", "conv_id", "turn"), ["text"], ["conv_id", "turn"])


@query("""WITH a AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
q AS (SELECT conv_id, string_split(lower(text), ' ') AS k FROM conversations WHERE role = 'user' AND turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND role = 'user')),
w AS (SELECT conv_id, list_filter(list_transform(k, lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, '|')) AS k FROM q)
SELECT conv_id, CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(answer, x))) / len(k) END AS recall FROM w LEFT JOIN a USING (conv_id)""")
def keyword_recall(spark, d):
    """Share of a first question's words that the answers hold; 0 without an answer."""
    c = _t(spark, d, "conversations")
    a = c.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.lower(x["text"])), " ").alias("answer"))
    q = first_of(c.where("role = 'user'"), ["conv_id"], ["turn"]).select("conv_id", F.array_join(F.filter(F.split(F.lower("text"), " "), lambda x: ~F.contains(x, F.lit("|"))), "|").alias("keys"))
    return q.join(a, "conv_id", "left").select("conv_id", evaluation.keyword_recall(F.col("keys"), F.col("answer")).alias("recall"))


# ---------------------------------------------------------------- evaluation
@query("SELECT toxic, fold, count(*) AS n FROM (SELECT toxic, (row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM labels) GROUP BY ALL")
def stratified_folds(spark, d):
    """Folds dealt within each label."""
    return evaluation.stratified(_t(spark, d, "labels"), "doc_id", "toxic", 5).groupBy("toxic", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


_GUESS = "CASE WHEN l.quality = 1 AND d.n_chars % 3 <> 0 THEN 1 ELSE 0 END"


def _guessed(spark, d) -> DataFrame:
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("guess", F.when((F.col("quality") == 1) & (F.col("n_chars") % 3 != 0), 1).otherwise(0))


@query(f"SELECT l.quality AS quality, count(*) FILTER ({_GUESS} = 0) AS \"0\", count(*) FILTER ({_GUESS} = 1) AS \"1\" FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality")
def confusion_matrix(spark, d):
    """True against predicted."""
    return evaluation.confusion(_guessed(spark, d), "quality", "guess", [0, 1])


@query(f"""WITH g AS (SELECT l.quality AS t, {_GUESS} AS p FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT unnest([0, 1]) AS label)
SELECT label, coalesce(count(*) FILTER (t = label AND p = label) / nullif(count(*) FILTER (p = label), 0), 0)::DOUBLE AS "precision", coalesce(count(*) FILTER (t = label AND p = label) / nullif(count(*) FILTER (t = label), 0), 0)::DOUBLE AS recall,
 coalesce(2 * count(*) FILTER (t = label AND p = label) / nullif(count(*) FILTER (t = label) + count(*) FILTER (p = label), 0), 0)::DOUBLE AS f1, count(*) FILTER (t = label) AS support FROM k, g GROUP BY label""")
def class_report(spark, d):
    """Precision, recall and F1 of each class."""
    return evaluation.class_report(_guessed(spark, d), "quality", "guess")


# ---------------------------------------------------------------- retrieval
@query(r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM documents UNION ALL SELECT 'q', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') FROM benchmark),
g AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT side, id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tf, n WHERE side = 'd' GROUP BY term, n),
v AS (SELECT side, id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
u AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM v),
s AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS score FROM u q JOIN u d USING (term) WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""")
def lexical_search(spark, d):
    """The five documents nearest to each benchmark passage by TF-IDF."""
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    s = retrieval.lexical_heads(_t(spark, d, "documents").select("doc_id", "text"), q, "doc_id", [])
    return retrieval.top_k(s, "doc_id").select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, 0.55 * greatest(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 0) * CASE WHEN e.label = q.label THEN 1.15 ELSE 1 END AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s WHERE score > 0)
SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""")
def dense_search(spark, d):
    """Exact inner products of a stated query set with all vectors, with category boost."""
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    s = retrieval.dense_heads(q, e.select("vec_id", F.col("embedding").alias("v"), "label"), "vec_id")
    s = s.select("query_id", "vec_id", (retrieval.DENSE * F.greatest("dense", F.lit(0.0))).alias("score"), F.lit("").alias("category"), F.lit(False).alias("asks_meaning"), F.when(F.col("same"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")).alias("wanted"))
    return retrieval.top_k(retrieval.adjusted(s), "vec_id").select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- clauses of policies written from customers
def policy_pages(spark, d) -> DataFrame:
    """(doc_id, page, text): a policy of four pages for each customer, its terms drawn from the key and the balance."""
    k = F.col("c_custkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rupees = lambda n: F.format_number(n, 0)
    premium = F.floor(F.abs(F.col("c_acctbal")) * 10).cast("long") + 1800
    codes = F.transform(F.slice(F.sequence(F.lit(4), F.lit(13)), F.lit(1), mod(10).cast("int")), lambda i: F.format_string("E.%d Treatment of kind %d - Code Excl%02d\nSuch expenses are excluded.", i - 3, i, i))
    head = say("Harbour Light Health Insurance Company Limited | Policy of ", F.col("c_name"), "\n")
    one = say(
        head, "HARBOUR LIGHT HEALTH INSURANCE COMPANY LIMITED\nHarbour Care Plan ", k, " - Policy Wording\nUIN: HARHLIP", F.lpad(mod(100_000).cast("string"), 5, "0"), "V012122\nPREAMBLE\nThis policy is a contract of insurance.\nPOLICY SCHEDULE\n",
        F.when(mod(7) != 0, say("Sum Insured: Rs. ", rupees((mod(50) + 1) * 100_000), " on family floater basis. ")).otherwise("As the certificate says. "),
        "Annual premium: Rs. ", rupees(premium), " with taxes. Policy period: ", mod(3) + 1, " years.\nSECTION A - DEFINITIONS\nA.1 Room Rent means the amount charged by a hospital.\nSECTION B - COVERAGE\n1.1 In-patient Hospitalisation\nIn-patient care is payable.\n1.2 Room Rent\n",
        F.when(mod(2) == 0, "There is no capping on room rent. ").otherwise("Room rent is payable up to 1% of the Sum Insured. "), "\n1.3 Intensive Care\n", F.when(mod(3) == 0, "ICU charges are payable at actuals.\n").otherwise("ICU expenses are payable up to Rs. 10,000 per day.\n"),
        "1.4 Pre-hospitalisation Expenses\nExpenses of the ", (mod(4) + 1) * 15, " days before admission are covered.\n1.5 Restoration of Sum Insured\n", F.when(mod(5) < 2, "Restoration benefit is not available.\n").otherwise("The Sum Insured is restored once a year.\n"),
        F.when(mod(6) < 3, "").otherwise("1.6 Maternity\nMaternity expenses are covered up to Rs. 50,000.\n"),
        "1.7 Road Ambulance\nAmbulance charges are paid up to Rs. ", (mod(4) + 1) * 500, " per stay.\n1.8 Day Care Procedures\n", F.when(mod(4) == 1, "Day care treatment is not covered.\n").otherwise("Day care treatment is covered.\n"),
        "1.9 Domiciliary Care\n", F.when(mod(5) == 2, "Domiciliary care is not covered.\n").otherwise("Domiciliary care is covered.\n"), "1.10 AYUSH Treatment\n", F.when(mod(3) == 0, "AYUSH treatment is not covered.\n").otherwise("AYUSH treatment is covered.\n"),
        "1.11 OPD\n", F.when(mod(2) == 1, "OPD visits are not covered.\n").otherwise("OPD visits are covered once a year.\n"), "1.12 Cumulative Bonus\n", F.when(mod(3) == 1, "A cumulative bonus is not available here.\n").otherwise("A cumulative bonus of 10% is added each year.\n"),
        "1.13 New Born Cover\n", F.when(mod(4) == 0, "A new born baby is not covered.\n").otherwise("A new born baby is covered from the first day.\n"), F.when(mod(5) == 4, "").otherwise("1.14 Family\nDependent children up to age 25 can be included.\n"),
        "1.15 Post-hospitalisation Expenses\nExpenses of the ", (mod(3) + 1) * 30, " days after discharge are covered.\nPage 1",
    )
    two = say(
        head, "SECTION C - CO-PAYMENT AND SUB-LIMITS\n2.1 Co-payment\n", F.when(mod(4) == 0, "There is no co-payment under this policy.\n").otherwise(say("Each claim is subject to a co-payment of ", mod(4) * 5, "% of the amount.\n")),
        "2.2 Sub-limits\nCataract surgery is limited to Rs. 40,000 per eye. ", F.when(mod(3) == 1, "Knee replacement is limited to Rs. 1,50,000. ").otherwise(""), "\nSECTION D - WAITING PERIODS\nD.1 Pre-Existing Diseases - Code Excl01\nTreatment shall be excluded until the expiry of ",
        F.when(mod(5) == 0, "24/36 months").otherwise(say((mod(4) + 1) * 12, " months")), " of continuous coverage.\nD.2 Specified Diseases - Code Excl02\nListed conditions shall be excluded until the expiry of ", F.when(mod(3) == 0, "2 years").otherwise("12 months"),
        " of continuous coverage.\nD.3 Initial Waiting Period - Code Excl03\nIllness within 30 days of the start is excluded.\nPage 2",
    )
    three = say(head, "SECTION E - EXCLUSIONS\nThe following are no part of this policy.\n", F.array_join(codes, "\n"), "\n", F.when(mod(6) < 3, "E.19 Childbirth\nMaternity expenses are excluded.\n").otherwise(""), F.when(mod(5) == 1, "E.20 Non-payable items\nConsumables are not paid.\n").otherwise(""), "Page 3")
    four = say(
        head, "SECTION F - CLAIM PROCEDURE\nF.1 Cashless Claims\nCashless care needs notice within ", (mod(3) + 1) * 24, " hours of admission.\nF.2 Settlement of Claims\nThe Company shall settle a claim within ", (mod(2) + 1) * 15, " days of the last document.\n",
        "Payment is at the sole discretion of the Company.\n", F.when(mod(3) == 2, "").otherwise("F.3 Reimbursement Claims\nReimbursement needs the claim form and the bills as documents.\n"), "SECTION G - RENEWAL\nG.1 Renewal\nThe policy is ordinarily renewable for life.\nG.2 Grace Period\nA grace period of ", (mod(2) + 1) * 15, " days is allowed.\n", F.when(mod(4) < 2, "G.3 Portability\nPortability credit is given in writing. The moratorium is eight years.\n").otherwise(""), "Page 4",
    )
    pages = F.posexplode(F.array(one, two, three, four)).alias("page", "text")
    return _dealt(_t(spark, d, "customer")).select(k.alias("doc_id"), pages).withColumn("page", F.col("page") + 1)


def _extracted(pages: DataFrame) -> DataFrame:
    """Clauses of pages, dealt by document once; clean pages, their sections and sentences are each made once and kept for all the fields."""
    pages = dealt(pages, "doc_id")
    clean = nearby(cleaning.clean_pages(pages))
    lines = nearby(sections.sectioned(sections.page_lines(clean), repeating=True))
    return clauses.extract(clean, lines, nearby(sections.sentences(lines, repeating=True)), pages, numbered=True, repeating=True)


#: The terms as they were written, field by field.
_TERMS_SQL = {
    "insurer_name": "'Harbour Light Health Insurance Company Limited'", "uin": "'HARHLIP' || lpad((k % 100000)::VARCHAR, 5, '0') || 'V012122'", "policy_name": "'Harbour Care Plan ' || k", "policy_type": "CASE WHEN k % 7 <> 0 THEN 'Family Floater' ELSE 'Individual Health' END",
    "sum_insured": "CASE WHEN k % 7 <> 0 THEN (k % 50 + 1) * 100000 END", "sum_insured_options": "NULL::VARCHAR", "annual_premium": "floor(abs(c_acctbal) * 10)::BIGINT + 1800", "policy_term_years": "(k % 3 + 1)::DOUBLE",
    "pre_hospitalization_days": "((k % 4 + 1) * 15)::INT", "post_hospitalization_days": "((k % 3 + 1) * 30)::INT", "inpatient_hospitalization": "true", "day_care_covered": "k % 4 <> 1", "domiciliary_covered": "k % 5 <> 2", "ayush_covered": "k % 3 <> 0", "opd_covered": "k % 2 = 0",
    "ambulance_cover": "'Ambulance charges are paid up to Rs. ' || (k % 4 + 1) * 500 || ' per stay.'", "restoration_benefit": "k % 5 >= 2", "restoration_details": "CASE WHEN k % 5 < 2 THEN 'Restoration benefit is not available.' ELSE 'The Sum Insured is restored once a year.' END",
    "no_claim_bonus": "k % 3 <> 1", "no_claim_bonus_details": "CASE WHEN k % 3 = 1 THEN 'A cumulative bonus is not available here.' ELSE 'A cumulative bonus of 10% is added each year.' END",
    "maternity_covered": "k % 6 >= 3", "maternity_details": "CASE WHEN k % 6 >= 3 THEN 'Maternity expenses are covered up to Rs. 50,000.' END", "newborn_covered": "k % 4 <> 0", "child_coverage": "CASE WHEN k % 5 <> 4 THEN true END",
    "child_coverage_details": "CASE WHEN k % 5 <> 4 THEN 'Dependent children up to age 25 can be included.' END", "ped_waiting_period_months": "CASE WHEN k % 5 = 0 THEN 36 ELSE (k % 4 + 1) * 12 END::INT", "specific_disease_waiting_period_months": "CASE WHEN k % 3 = 0 THEN 24 ELSE 12 END::INT",
    "initial_waiting_period_days": "30::INT", "copayment_percentage": "(k % 4 * 5)::DOUBLE", "copayment_conditions": "CASE WHEN k % 4 = 0 THEN 'There is no co-payment under this policy.' ELSE 'Each claim is subject to a co-payment of ' || k % 4 * 5 || '% of the amount.' END",
    "room_rent_limit_present": "k % 2 <> 0", "room_rent_limit": "CASE WHEN k % 2 = 0 THEN '…re is no capping on room rent.' ELSE 'Room rent is payable up to 1% of the Sum Insured.' END", "icu_limit_present": "k % 3 <> 0",
    "icu_limit": "CASE WHEN k % 3 = 0 THEN 'ICU charges are payable at actuals.' ELSE 'ICU expenses are payable up to Rs. 10,000 per day.' END", "exclusion_count": "CASE WHEN k % 10 >= 2 THEN 3 + k % 10 + (k % 6 < 3)::INT ELSE nullif(k % 10 + (k % 6 < 3)::INT + (k % 5 = 1)::INT, 0) END::INT",
    "non_payable_items_mentioned": "k % 5 = 1", "cashless_available": "true", "reimbursement_available": "CASE WHEN k % 3 <> 2 THEN true END", "claim_documents_listed": "CASE WHEN k % 3 <> 2 THEN true END", "claim_intimation_timeline": "'within ' || (k % 3 + 1) * 24 || ' hours of admission'",
    "claim_settlement_timeline": "'within ' || (k % 2 + 1) * 15 || ' days'", "grace_period_days": "((k % 2 + 1) * 15)::INT", "renewal_conditions": "'The policy is ordinarily renewable for life.'", "portability_mentioned": "CASE WHEN k % 4 < 2 THEN true END", "moratorium_mentioned": "CASE WHEN k % 4 < 2 THEN true END",
    "extraction_method": "'rules'",
}
_LISTS_SQL = {
    "disease_sub_limits": "CASE WHEN k % 3 = 1 THEN 'Cataract: Cataract surgery is limited to Rs. 40,000 per eye.; Knee: Knee replacement is limited to Rs. 1,50,000.' ELSE 'Cataract: Cataract surgery is limited to Rs. 40,000 per eye.' END",
    "permanent_exclusions": "array_to_string(list_concat(list_transform(range(4, 4 + k % 10), lambda i: 'Treatment of kind ' || i), list_filter([CASE WHEN k % 6 < 3 THEN 'Childbirth' END, CASE WHEN k % 5 = 1 THEN 'Non-payable items' END], lambda x: x IS NOT NULL)), '; ')",
    "temporary_exclusions": "'Treatment shall be excluded until the expiry of ' || CASE WHEN k % 5 = 0 THEN '24/36' ELSE ((k % 4 + 1) * 12)::VARCHAR END || ' months of continuous coverage.; Listed conditions shall be excluded until the expiry of ' || CASE WHEN k % 3 = 0 THEN '2 years' ELSE '12 months' END || ' of continuous coverage.; Illness within 30 days of the start is excluded.'",
    "ambiguous_clauses": "'p.4: “Payment is at the sole discretion of the Company.”' || CASE WHEN k % 5 = 0 THEN '; p.2: waiting period has options ''24/36 months'' - depends on plan/schedule or condition; longest used for scoring' ELSE '' END",
}
_PAGES_SQL = {
    "annual_premium": "1", "ambulance_cover": "1", "ayush_covered": "1", "child_coverage": "CASE WHEN k % 5 <> 4 THEN 1 END", "claim_intimation_timeline": "4", "claim_settlement_timeline": "4", "copayment_percentage": "2", "day_care_covered": "1", "disease_sub_limits": "2", "domiciliary_covered": "1",
    "grace_period_days": "4", "icu_limit_present": "1", "initial_waiting_period_days": "2", "inpatient_hospitalization": "1", "maternity_covered": "CASE WHEN k % 6 >= 3 THEN 1 ELSE 3 END", "newborn_covered": "1", "no_claim_bonus": "1", "opd_covered": "1", "ped_waiting_period_months": "2",
    "post_hospitalization_days": "1", "pre_hospitalization_days": "1", "restoration_benefit": "1", "room_rent_limit_present": "1", "specific_disease_waiting_period_months": "2", "sum_insured": "CASE WHEN k % 7 <> 0 THEN 1 END",
}
_FOUND_SQL = "array_to_string(list_filter([" + ", ".join(f"'{f} p.' || ({p})" for f, p in sorted(_PAGES_SQL.items())) + "], lambda x: x IS NOT NULL), '; ')"
_CLAUSES_SQL = "WITH c AS (SELECT c_custkey AS k, c_acctbal FROM customer) SELECT k AS doc_id, " + ", ".join(f"{v} AS {f}" for f, v in (_TERMS_SQL | _LISTS_SQL).items()) + f", {_FOUND_SQL} AS found FROM c"


@query(_CLAUSES_SQL)
def clause_extraction(spark, d):
    """Sections, sentences and every typed clause of whole policies, with the pages of their evidence; the SQL states the terms that were written."""
    got = _extracted(policy_pages(spark, d))
    found = F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit(" p."), e["value"]["page"].cast("string"))))
    return got.select("doc_id", *_TERMS_SQL, *[F.array_join(c, "; ").alias(c) for c in _LISTS_SQL], F.array_join(found, "; ").alias("found"))


# ---------------------------------------------------------------- comparison and validation
def _comparable(spark, d) -> DataFrame:
    """Policies with extraction x, features f, what was given, and the score."""
    own = _policies(spark, d)
    f = scoring.scored(scoring.featured(own)).select("policy_id", F.struct("sum_insured", "annual_premium", "disease_sub_limit_count", "claim_process_clarity_score").alias("f"), "score")
    k = F.col("policy_id")
    flag = lambda c: F.when(F.pmod(k, F.lit(17)) != 0, F.col(c) == 1)
    days = lambda n: F.pmod(k, F.lit(n)) * 15
    x = own.select("policy_id", F.struct(
        F.col("pre_existing_disease_waiting_period_months").alias("ped_waiting_period_months"), F.col("waiting_period_months").alias("specific_disease_waiting_period_months"), days(3).alias("initial_waiting_period_days"),
        "copayment_percentage", flag("room_rent_limit_present").alias("room_rent_limit_present"), flag("icu_limit_present").alias("icu_limit_present"), "exclusion_count", flag("restoration_benefit_present").alias("restoration_benefit"),
        flag("no_claim_bonus_present").alias("no_claim_bonus"), days(5).alias("pre_hospitalization_days"), days(7).alias("post_hospitalization_days"), (k % 3 == 0).alias("day_care_covered"), (k % 4 == 0).alias("ayush_covered"),
        flag("maternity_coverage_present").alias("maternity_covered"), (k % 5 == 0).alias("newborn_covered"), flag("child_coverage_present").alias("child_coverage"),
    ).alias("x"), F.struct("sum_insured", "annual_premium").alias("given"))
    return x.join(f, "policy_id")


def _pairs(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    profile = F.struct((k % 90).cast("int").alias("age"), (k % 3 == 1).alias("planning_child"), (k % 4 == 2).alias("has_ped")).alias("profile")
    return _t(spark, d, "customer").where(k % 2 == 1).select(k.alias("pair_id"), k.alias("current"), (k + 1).alias("proposed"), profile)


_FLAG = lambda c: f"CASE WHEN policy_id % 17 <> 0 THEN {c}::DOUBLE END"
_VALUES = [  # (value, known) of each aspect in SQL over p5 with what was given as g
    ("p.sum_insured", "g.sum_insured IS NOT NULL"), ("p.annual_premium", "coalesce(g.annual_premium, 0) <> 0"), ("g.pre_existing_disease_waiting_period_months", ""), ("g.waiting_period_months", ""), ("p.policy_id % 3 * 15", ""), ("g.copayment_percentage", ""),
    (_FLAG("g.room_rent_limit_present"), ""), (_FLAG("g.icu_limit_present"), ""), ("p.disease_sub_limit_count", "true"), ("g.exclusion_count", ""), (_FLAG("g.restoration_benefit_present"), ""), (_FLAG("g.no_claim_bonus_present"), ""),
    ("p.policy_id % 5 * 15", ""), ("p.policy_id % 7 * 15", ""), ("(p.policy_id % 3 = 0)", ""), ("(p.policy_id % 4 = 0)", ""), (_FLAG("g.maternity_coverage_present"), ""), ("(p.policy_id % 5 = 0)", ""), (_FLAG("g.child_coverage_present"), ""),
    ("p.claim_process_clarity_score", "true"), ("round_even(p.raw_score, 0)", "true"),
]
_VALUES = [(v.replace("policy_id", "p.policy_id").replace("p.p.", "p."), k) for v, k in _VALUES]
_ASPECT_SQL = _POLICIES_SQL + ",\na AS (" + " UNION ALL ".join(
    f"SELECT p.policy_id AS policy_id, {i} AS ord, ({v})::DOUBLE AS v, {k or f'({v}) IS NOT NULL'} AS known, {i in (6, 7, 10, 11, 14, 15, 16, 17, 18)} AS flag, {i in (0, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20) and i != 8} AS up FROM p5 p JOIN p0 g ON g.policy_id = p.policy_id"
    for i, (v, k) in enumerate(_VALUES)
) + """),
t AS (SELECT *, CASE WHEN NOT known THEN CASE WHEN ord < 2 THEN 'Not provided' ELSE 'Not found' END WHEN flag THEN CASE WHEN v <> 0 THEN 'Yes' ELSE 'No' END
 WHEN v = floor(v) AND v >= 10000 AND ord < 20 THEN format('{:,}', v::BIGINT) WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS text FROM a),
c AS (SELECT x.policy_id AS pair_id, x.ord AS ord, x.text AS "current", y.text AS proposed, CASE WHEN NOT (x.known AND y.known) THEN 'Unclear' WHEN x.v = y.v THEN 'Same' WHEN x.ord = 1 THEN CASE WHEN y.v > x.v THEN 'Higher cost' ELSE 'Lower cost' END
 WHEN (y.v > x.v) = x.up THEN 'Improved' ELSE 'Worse' END AS change FROM t x JOIN t y ON y.policy_id = x.policy_id + 1 AND y.ord = x.ord WHERE x.policy_id % 2 = 1)"""


@query(f'WITH {_ASPECT_SQL} SELECT pair_id, ord, "current", proposed, change FROM c')
def policy_comparison(spark, d):
    """Aspects of pairs of policies with verdicts, as shown."""
    return comparison.compared(_pairs(spark, d), _comparable(spark, d)).drop("aspect")


@query(f"WITH {_ASPECT_SQL} SELECT pair_id, count(*) FILTER (change = 'Improved') AS n_improved, count(*) FILTER (change = 'Worse') AS n_worse, count(*) FILTER (change = 'Unclear') AS n_unclear FROM c GROUP BY pair_id")
def comparison_summary(spark, d):
    """Aspects that improve, become worse, or stay unclear."""
    rows = comparison.summary(comparison.compared(_pairs(spark, d), _comparable(spark, d)))
    return rows.select("pair_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("improved", "worse", "unclear")])


@query(f"""WITH {_POLICIES_SQL} SELECT x.policy_id AS pair_id, CASE WHEN coalesce(gx.annual_premium, 0) <> 0 AND coalesce(gy.annual_premium, 0) <> 0 THEN round_even((y.annual_premium - x.annual_premium) * 100.0::DOUBLE / x.annual_premium, 1) END AS premium_change_pct,
 3 + (coalesce(coalesce(gx.pre_existing_disease_waiting_period_months, 0) < gy.pre_existing_disease_waiting_period_months, false))::INT + (y.sum_insured > x.sum_insured)::INT AS n_risks,
 (x.policy_id % 90 >= 55 AND coalesce(gy.copayment_percentage, 0) > 0)::INT + (x.policy_id % 3 = 1 AND NOT (y.policy_id % 17 <> 0 AND gy.maternity_coverage_present = 1))::INT + (x.policy_id % 4 = 2)::INT AS n_cautions
 FROM p5 x JOIN p5 y ON y.policy_id = x.policy_id + 1 JOIN p0 gx ON gx.policy_id = x.policy_id JOIN p0 gy ON gy.policy_id = y.policy_id WHERE x.policy_id % 2 = 1""")
def switching_outlook(spark, d):
    """The premium's change, risks of a switch, cautions for a profile."""
    rows = comparison.outlook(_pairs(spark, d), _comparable(spark, d))
    return rows.select("pair_id", "premium_change_pct", F.size("switching_risks").alias("n_risks"), F.size("cautions").alias("n_cautions"))


@query("""
WITH r AS (SELECT p_partkey AS doc_id, p_size * 3 AS ours, CASE p_partkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN p_size || ' months' WHEN 2 THEN (p_size % 9) || ' years' WHEN 3 THEN 'about ' || p_size * 3 WHEN 4 THEN NULL ELSE 'none' END AS said FROM part),
n AS (SELECT *, CASE doc_id % 6 WHEN 1 THEN ours // 3 WHEN 2 THEN ours // 3 % 9 * 12 WHEN 3 THEN ours END AS theirs FROM r)
SELECT doc_id, CASE WHEN ours > 96 THEN NULL ELSE ours::VARCHAR END AS value, array_to_string(list_filter([
 CASE WHEN theirs <> ours THEN 'ped_waiting_period_months: LLM read ''' || theirs || ''', rule extractor found ''' || ours || ''' (p.?) - kept the rule value (base wording); verify in the document.' END,
 CASE WHEN ours > 96 THEN 'ped_waiting_period_months=' || ours || ' is outside the plausible range [0, 96] - ignored.' END], lambda x: x IS NOT NULL), chr(10)) AS notes FROM n""")
def merged_values(spark, d):
    """Another reader's values typed, the rules' kept where they stand, ranges checked."""
    p = _t(spark, d, "part")
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    said = F.when(k % 6 == 0, "N/A").when(k % 6 == 1, F.concat(n, F.lit(" months"))).when(k % 6 == 2, F.concat((F.col("p_size") % 9).cast("string"), F.lit(" years"))).when(k % 6 == 3, F.concat(F.lit("about "), (F.col("p_size") * 3).cast("string"))).when(k % 6 == 5, "none")
    rules = p.select(k.alias("doc_id"), F.lit("ped_waiting_period_months").alias("field"), (F.col("p_size") * 3).cast("string").alias("value"))
    other = p.select(k.alias("doc_id"), F.lit("ped_waiting_period_months").alias("field"), said.alias("value"))
    return validation.merged(rules, other).select("doc_id", "value", F.array_join("notes", "\n").alias("notes"))


_LIST_SQL = lambda a, n: f"""'[' || array_to_string(['"{a}1"', '"{a}2"', '"{a}3"'][1:{n}], ',') || ']'"""


@query(f"""
WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part),
v AS (SELECT k, 'sum_insured' AS field, (CASE WHEN k % 3 = 0 THEN n * 100000 ELSE n * 10000 END)::VARCHAR AS value, 0 AS n_notes FROM p
 UNION ALL SELECT k, 'copayment_percentage', n || '.0', (k % 2 = 0)::INT FROM p
 UNION ALL SELECT k, 'restoration_benefit', CASE WHEN k % 4 = 3 THEN 'false' ELSE 'true' END, (k % 4 = 1)::INT FROM p
 UNION ALL SELECT k, 'claim_settlement_timeline', 'within ' || CASE WHEN k % 2 = 0 THEN n ELSE 30 END || ' days', 0 FROM p
 UNION ALL SELECT k, 'disease_sub_limits', CASE WHEN k % 7 = 0 THEN {_LIST_SQL('r', 'k % 4')} WHEN k % 5 = 0 THEN CASE WHEN k % 4 > 1 THEN {_LIST_SQL('r', 'k % 4')} ELSE '["Cataract: 40,000"]' END
  WHEN k % 4 > k % 3 THEN {_LIST_SQL('r', 'k % 4')} ELSE {_LIST_SQL('t', 'k % 3')} END, 0 FROM p)
SELECT k AS doc_id, field, value, n_notes, (CASE WHEN k % 3 = 0 THEN 10 ELSE 1 END + k % 9)::INT AS page FROM v""")
def merged_field_types(spark, d):
    """Numbers, flags, texts and lists of both readers, with evidence."""
    k, n = F.col("p_partkey"), F.col("p_size")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    first = lambda m, *xs: F.to_json(F.slice(F.array(*map(F.lit, xs)), F.lit(1), m.cast("int")))
    theirs = F.from_json(first(k % 3, "t1", "t2", "t3"), "array<string>")
    fields = {
        "sum_insured": (text(n * 10_000), F.when(k % 3 == 0, text(n, " lakh")).when(k % 3 == 1, "n/a")), "copayment_percentage": (text(n.cast("double")), F.when(k % 2 == 0, text(n + 1, "%"))),
        "restoration_benefit": (F.when(k % 4 != 3, "true"), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "not covered").when(k % 4 == 2, "maybe").otherwise("no")),
        "claim_settlement_timeline": (F.lit("within 30 days"), F.when(k % 2 == 0, text(" within ", n, " days "))),
        "disease_sub_limits": (first(k % 4, "r1", "r2", "r3"), F.when(k % 7 == 0, None).when(k % 5 == 0, "Cataract: 40,000").otherwise(F.to_json(F.array_append(theirs, F.lit(" "))))),
    }
    rows = _t(spark, d, "part").select(k.alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), a.alias("ours"), b.alias("theirs")) for f, (a, b) in fields.items()])))
    page = lambda start: F.struct((start + F.col("doc_id") % 9).cast("int").alias("page"), F.lit("here").alias("quote"))
    rules = rows.select("doc_id", "field", F.col("ours").alias("value"), page(1).alias("evidence"))
    other = rows.select("doc_id", "field", F.col("theirs").alias("value"), F.when(F.col("doc_id") % 3 == 0, page(10)).alias("evidence"))
    return validation.merged(rules, other).select("doc_id", "field", "value", F.size("notes").alias("n_notes"), F.col("evidence")["page"].alias("page"))


# ---------------------------------------------------------------- answers
_ASKS = ["Is there a room rent cap?", "How long is the waiting time for a claim?", "What does maternity mean?", "Can I switch and keep my bonus?", "Which documents for admission?", "Is the schedule paid within days?"]
_ASK_SQL = lambda k: f"CASE {k} % {len(_ASKS)} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ASKS)) + " END"
_WIDE_SQL = "q || ' ' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(q), '\\b{k}') THEN '{v}' END" for k, v in answers.SYNONYMS.items()) + "], lambda x: x IS NOT NULL), ' ')"
_TOKEN_SQL = lambda t: f"list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z][a-z\\-]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP) + "], w))"


def _ask(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _ASKS)), (F.pmod(k, F.lit(len(_ASKS))) + 1).cast("int"))


@query(f"WITH c AS (SELECT conv_id, turn, {_ASK_SQL('(conv_id + turn)')} AS q FROM conversations) SELECT conv_id, turn, {_WIDE_SQL} AS wide FROM c")
def expanded_questions(spark, d):
    """Questions with synonyms."""
    return _t(spark, d, "conversations").select("conv_id", "turn", answers.expanded(_ask(F.col("conv_id") + F.col("turn"))).alias("wide"))


_HITS_SQL = f"""h AS (SELECT p_partkey // 5 AS question_id, p_partkey % 5 + 1 AS rank, {_ASK_SQL('(p_partkey // 5)')} AS q,
 ['The ' || p_name || ' claim is paid within ' || p_size || ' days of admission here.', 'Room rent means ' || p_type || ' as the schedule says.', 'Documents of the ' || p_brand || ' are kept.'] AS s FROM part)"""


def _hits(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("The "), "p_name", F.lit(" claim is paid within "), F.col("p_size").cast("string"), F.lit(" days of admission here. Room rent means "), "p_type", F.lit(" as the schedule says.\nDocuments of the "), "p_brand", F.lit(" are kept."))
    q = F.floor(k / 5).cast("long")
    return _t(spark, d, "part").select(q.alias("question_id"), _ask(q).alias("question"), (k % 5 + 1).alias("rank"), text.alias("text"), (F.col("p_size") / 100.0).alias("score"))


@query(f"""WITH {_HITS_SQL}, x AS (SELECT question_id, rank, q, {_WIDE_SQL} AS wide, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM h),
w AS (SELECT *, {_TOKEN_SQL('q')} AS asked, {_TOKEN_SQL('wide')} AS wider, {_TOKEN_SQL('sentence')} AS words FROM x),
c AS (SELECT *, round((2 * len(list_intersect(asked, words)) + len(list_intersect(wider, words)))::DOUBLE - 0.3::DOUBLE * rank + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.5 ELSE 0 END - CASE WHEN contains(lower(sentence), ' means ') AND NOT regexp_matches(lower(q), '\\bmean|defin') THEN 2 ELSE 0 END, 6) AS score
 FROM w WHERE len(list_intersect(asked, words)) > 0 AND length(sentence) > 30),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id, left(sentence, 50) ORDER BY score DESC, rank, pos) AS m FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank, pos) AS n FROM f WHERE m = 1)
SELECT question_id, n, rank, sentence, score FROM r WHERE n <= 3""")
def answer_sentences(spark, d):
    """Q04, Q06: the three best distinct sentences for each question."""
    return answers.sentences(_hits(spark, d)).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {_HITS_SQL}, w AS (SELECT question_id, first(q) AS q, list_distinct(flatten(list({_TOKEN_SQL("array_to_string(s, ' ')")}))) AS said FROM h GROUP BY question_id)
SELECT question_id, array_to_string(list_sort(list_filter({_TOKEN_SQL('q')}, lambda t: length(t) > 2 AND NOT list_contains(said, t) AND NOT list_contains([{", ".join(f"'{g}'" for g in answers.GENERIC)}], t)
 AND NOT CASE t {" ".join(f"WHEN '{k}' THEN list_has_any({_TOKEN_SQL(chr(39) + v + chr(39))}, said)" for k, v in answers.SYNONYMS.items())} ELSE false END)), ' ') AS missing FROM w""")
def missing_terms(spark, d):
    """Q05: words of a question that the retrieved text doesn't hold."""
    return answers.missing(_hits(spark, d)).select("question_id", F.array_join("missing", " ").alias("missing"))


@query("""SELECT avg((conv_id % 3 = 0)::INT)::DOUBLE AS citation_rate, avg((turn % 4 = 1)::INT)::DOUBLE AS unsafe_rate, round(avg(CASE WHEN conv_id % 5 < 3 THEN turn / 10 END), 9) AS recall,
 round(avg(CASE WHEN conv_id % 5 = 4 THEN (conv_id % 2 = 0)::INT END), 9) AS refused, round(avg(CASE WHEN conv_id % 5 < 3 THEN (conv_id % 2 = 0)::INT END), 9) AS refused_falsely FROM conversations""")
def answer_rates(spark, d):
    """Flags of answers and their rates."""
    c, t = F.col("conv_id"), F.col("turn")
    say = F.concat(F.when(c % 3 == 0, "As said [S1]. ").otherwise(""), F.when(t % 4 == 1, "You should buy it. ").otherwise(answers.ALLOWED + ". "), F.when(c % 2 == 0, answers.NOT_FOUND).otherwise(""))
    rows = _t(spark, d, "conversations").select(say.alias("answer"), F.when(c % 5 < 3, "yes").when(c % 5 == 4, "no").otherwise("decision").alias("answerable"), (t / 10).alias("keyword_recall"))
    got = answers.rates(rows.withColumns(answers.flags(F.col("answer"))))
    return got.select("citation_rate", "unsafe_rate", *[F.round(x, 9).alias(x) for x in ("recall", "refused", "refused_falsely")])
