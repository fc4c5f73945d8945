"""Registered queries: text analytics (K) and résumé matching (L)."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from jobweave import rules
from jobweave.catalog import layers as L
from jobweave.catalog import oracle as O
from jobweave.catalog.market_queries import SKILL_CAT_SQL, rounded
from jobweave.catalog.registry import query
from jobweave.functions import experience, roles, skills
from jobweave.operators import keywords as KW
from jobweave.operators import matching as MT
from jobweave.operators import gold as G
from jobweave.plans import warehouse
from jobweave.sources import derived as D

STOP = O.sql_list(KW.STOP_WORDS)


def kw_clean(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), 'https?://\\S+', ' ', 'g'), "
            f"'[^a-z0-9+#À-ỹ ]+', ' ', 'g'), '\\s+', ' ', 'g'))")


def kw_tokens(x):
    return (f"list_filter(list_transform(string_split({kw_clean(x)}, ' '), lambda s: "
            f"regexp_extract(s, '(?:^|[+#])([a-zÀ-ỹ][a-zÀ-ỹ0-9+#]*[a-zÀ-ỹ0-9])', 1)), "
            f"lambda s: s <> '' AND NOT list_contains({STOP}, s))")


def bigrams(x):
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"


def tfidf(src, text, doc, by="", max_features=300, min_df=1):
    """CTEs ending in kw(by, doc, term, weight, n_docs)."""
    g = f"{by}, " if by else ""
    on = lambda a, b: f" AND {a}.{by} = {b}.{by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""kd AS (SELECT {g}{doc}, {kw_tokens(text)} AS tk FROM {src} WHERE trim(coalesce({text}, '')) <> ''),
kn AS (SELECT {g}count(*) AS n_docs FROM kd {'GROUP BY ' + by if by else ''}),
kt AS (SELECT {g}{doc}, unnest(list_concat(tk, {bigrams('tk')})) AS term FROM kd),
kf AS (SELECT {g}{doc}, term, count(*) AS tf FROM kt GROUP BY ALL),
kv AS (SELECT {g}term, sum(tf) AS cf, count(*) AS df FROM kf GROUP BY {g}term HAVING count(*) >= {min_df}
  QUALIFY row_number() OVER ({part}ORDER BY sum(tf) DESC, term) <= {max_features}),
kw0 AS (SELECT kf.*, n_docs, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS w FROM kf JOIN kv ON kv.term = kf.term{on('kv', 'kf')} JOIN kn ON true{on('kn', 'kf')}),
kw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY {g}{doc})) AS weight FROM kw0)"""


# -- K ---------------------------------------------------------------------------------
_KEY = "trim(regexp_replace(regexp_replace(lower(trim(translate({x}, '.-', '  '))), '[^a-z0-9+#/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_NTEXT = "' ' || trim(regexp_replace(regexp_replace(replace(lower({x}), '.', ' '), '[^a-z0-9+#/À-ỹ ]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"


@query("k1_normalize_text", f"SELECT doc_id, {_NTEXT.format(x='text')} AS body FROM documents")
def _(spark, d):
    return D.documents(spark, d).select("doc_id", skills.normalize_text_col("text").alias("body"))


def skills_sql(x, table=None):
    """Distinct canonical skills sorted by lower case, one pattern per alias."""
    table = table or skills.text_alias_table()
    cases = ", ".join(f"CASE WHEN regexp_matches({x}, {O.q('(^|[^a-z0-9+#/])' + re.escape(k) + '([^a-z0-9+#/]|$)')}) THEN {O.q(v)} END"
                      for k, v in table.items())
    found = f"list_distinct(list_filter([{cases}], lambda s: s IS NOT NULL))"
    return (f"list_transform(list_sort(list_transform({found}, lambda s: lower(s) || chr(1) || s)), "
            f"lambda s: string_split(s, chr(1))[2])")


_JD_RAW = "job_title || chr(10) || skills_required || chr(10) || job_description"


@query("k2_extract_skills", O.over(
    f"{O.RAW}, t AS (SELECT ingest_seq, {_NTEXT.format(x=_JD_RAW)} AS b FROM raw_jobs)",
    f"SELECT ingest_seq, array_to_string({skills_sql('b')}, '|') AS skills FROM t"))
def _(spark, d):
    jd = F.concat_ws("\n", "job_title", "skills_required", "job_description")
    return L.raw(spark, d).select("ingest_seq", F.array_join(skills.extract_skills(jd), "|").alias("skills"))


PROSE = {"of the": "of-the", "the": "The", "la": "La", "une": "Une", "nicht": "Nicht", "thing": "Thing", "tion": "Tion"}


@query("k2_extract_phrases_documents",
       f"SELECT doc_id, array_to_string({skills_sql('b', PROSE)}, '|') AS skills FROM (SELECT doc_id, {_NTEXT.format(x='text')} AS b FROM documents)")
def _(spark, d):
    return D.documents(spark, d).select("doc_id", F.array_join(skills.extract_skills("text", PROSE), "|").alias("skills"))


@query("k3_extracted_skill_frequency", O.over(
    f"{O.RAW}, t AS (SELECT {_NTEXT.format(x=_JD_RAW)} AS b FROM raw_jobs), e AS (SELECT unnest({skills_sql('b')}) AS skill FROM t)",
    f"SELECT skill, {SKILL_CAT_SQL.replace('trim(skill)', 'trim(skill)')} AS category, count(*) AS n FROM e GROUP BY 1, 2 ORDER BY n DESC, skill LIMIT 50"))
def _(spark, d):
    df = L.raw(spark, d).withColumn("jd", F.concat_ws("\n", "job_title", "skills_required", "job_description"))
    return KW.extracted_skill_frequency(df, "jd")


@query("k4_clean_keyword_text", f"SELECT doc_id, {kw_clean('text')} AS body FROM documents")
def _(spark, d):
    return D.documents(spark, d).select("doc_id", KW.clean_keyword_text("text").alias("body"))


def _top(select, n, order="score DESC, keyword"):
    return f"{select} ORDER BY {order} LIMIT {n}"


@query("k5_corpus_keywords", O.over(
    tfidf("documents", "text", "doc_id", max_features=200, min_df=2),
    _top("SELECT term AS keyword, round(sum(weight) / max(n_docs), 9) AS score FROM kw GROUP BY 1", 20)))
def _(spark, d):
    return KW.corpus_keywords(D.documents(spark, d), "text", "doc_id", n=20, max_features=200, min_df=2)


@query("k6_document_keywords", O.over(
    tfidf("documents", "text", "doc_id", max_features=350, min_df=3) + ", r AS (SELECT doc_id, term, round(weight, 9) AS weight FROM kw)",
    "SELECT doc_id, term, weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM r QUALIFY rank <= 10"))
def _(spark, d):
    return KW.document_keywords(D.documents(spark, d), "text", "doc_id", 10, max_features=350, min_df=3)


_FREQ = (f"list_filter(string_split({kw_clean('text')}, ' '), lambda s: length(s) > 2 AND "
         f"(NOT list_contains({STOP}, s) OR list_contains({O.sql_list(rules.KEEP_WORDS)}, s)))")


@query("k7_frequency_keywords", f"""
WITH t AS (SELECT {_FREQ} AS w FROM documents WHERE trim(text) <> ''), e AS (SELECT unnest(list_concat(w, {bigrams('w')})) AS keyword FROM t)
SELECT keyword, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, keyword LIMIT 100""")
def _(spark, d):
    return KW.frequency_keywords(D.documents(spark, d), "text", 100)


@query("k8_role_keywords", O.over(
    O.GOLD + ", " + tfidf("gold", "job_description", "job_hash", "role_category", 300, 1),
    """SELECT role_category, keyword, score FROM (SELECT role_category, term AS keyword, round(sum(weight) / max(n_docs), 9) AS score FROM kw GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY role_category ORDER BY score DESC, keyword) <= 8"""))
def _(spark, d):
    return KW.role_keywords(L.gold(spark, d))


@query("k8_language_keywords", O.over(
    tfidf("documents", "text", "doc_id", "lang", 300, 2),
    """SELECT lang, keyword, score FROM (SELECT lang, term AS keyword, round(sum(weight) / max(n_docs), 9) AS score FROM kw GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, keyword) <= 8"""))
def _(spark, d):
    return KW.corpus_keywords(D.documents(spark, d), "text", "doc_id", ["lang"], 8, max_features=300, min_df=2)


@query("k9_company_keywords", O.over(
    "topd AS (SELECT * FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 10)), "
    + tfidf("topd", "text", "doc_id", "source", 300, 1),
    """SELECT source, keyword, score FROM (SELECT source, term AS keyword, round(sum(weight) / max(n_docs), 9) AS score FROM kw GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, keyword) <= 5"""))
def _(spark, d):
    return KW.company_keywords(D.documents(spark, d), "text", "doc_id", "source")


@query("k10_skill_pairs", O.gold("""
WITH e AS (SELECT DISTINCT job_hash, unnest(dash_skills) AS s FROM gold)
SELECT a.s AS skill_a, b.s AS skill_b, count(*) AS n FROM e a JOIN e b ON a.job_hash = b.job_hash AND a.s < b.s GROUP BY 1, 2
ORDER BY n DESC, skill_a, skill_b LIMIT 30"""))
def _(spark, d):
    return KW.pair_rankings(L.gold(spark, d), "dash_skills")


@query("k11_topics", O.over(
    tfidf("documents", "text", "doc_id", max_features=300, min_df=1),
    """SELECT CAST(floor((r - 1) / 5) + 1 AS BIGINT) AS topic, string_agg(keyword, '|' ORDER BY r) AS keywords FROM (
    SELECT keyword, row_number() OVER (ORDER BY score DESC, keyword) AS r FROM (
      SELECT term AS keyword, round(sum(weight) / max(n_docs), 9) AS score FROM kw GROUP BY 1) QUALIFY r <= 40) GROUP BY 1"""))
def _(spark, d):
    out = KW.topics(D.documents(spark, d), "text", "doc_id")
    return out.select("topic", F.array_join("keywords", "|").alias("keywords"))


_PATTERNS = {"ml": r"(?i)\b(pytorch|tensorflow|nlp|sklearn)\b", "english": r"(?i)english", "big_data": r"(?i)\b(spark|kafka)\b"}


@query("k12_keyword_share", O.raw(" UNION ALL ".join(
    f"SELECT '{k}' AS metric, round(avg(CASE WHEN regexp_matches({_JD_RAW}, {O.q(p)}) THEN 1.0 ELSE 0 END), 6) AS value FROM raw_jobs"
    for k, p in _PATTERNS.items())))
def _(spark, d):
    df = L.raw(spark, d).withColumn("jd", F.concat_ws("\n", "job_title", "skills_required", "job_description"))
    return rounded(KW.keyword_share(df, "jd", _PATTERNS), "value")


# -- L ---------------------------------------------------------------------------------
RES = f"res AS ({D.RESUMES_SELECT.format(documents='documents')})"
_YEARS = ("list_concat(" + ", ".join(f"regexp_extract_all(lower({{x}}), {O.q(p)}, 1)" for p in rules.YEARS_PATTERNS) + ")")


def years_sql(x, agg):
    return f"list_{agg}(list_transform({_YEARS.format(x=x)}, lambda v: CAST(v AS DOUBLE)))"


def resumes(spark, d):
    return D.resumes(spark, d)


@query("l1_clean_resume", O.over(RES, r"""SELECT resume_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g') AS body FROM res"""))
def _(spark, d):
    return resumes(spark, d).select("resume_id", MT.clean_resume("text").alias("body"))


_HEAD = "trim(regexp_replace(regexp_replace(lower(line), '[^a-zÀ-ỹ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_SECTIONS = list(rules.SECTION_ALIASES)


@query("l2_sections", O.over(RES + f""",
l0 AS (SELECT resume_id, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda s: trim(s)), lambda s: s <> '') AS ls FROM res),
l1 AS (SELECT resume_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM l0),
l2 AS (SELECT *, {O.sql_map(MT.header_table())}[{_HEAD}] AS sec FROM l1),
l3 AS (SELECT *, count(sec) OVER (PARTITION BY resume_id ORDER BY pos) AS seg FROM l2),
l4 AS (SELECT resume_id, seg, max(sec) AS sec, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (sec IS NULL), '') AS body FROM l3 GROUP BY 1, 2),
l5 AS (SELECT * FROM l4 WHERE seg > 0 QUALIFY row_number() OVER (PARTITION BY resume_id, sec ORDER BY seg DESC) = 1),
l6 AS (SELECT resume_id, string_agg(line, chr(10) ORDER BY pos) AS whole FROM l1 GROUP BY 1),
l7 AS (SELECT resume_id, max(seg) AS segs FROM l3 GROUP BY 1)""",
    "SELECT l0.resume_id, " + ", ".join(
        f"coalesce((SELECT body FROM l5 WHERE l5.resume_id = l0.resume_id AND sec = '{s}'), '') AS {s}" for s in _SECTIONS if s != "summary")
    + """, CASE WHEN segs = 0 THEN whole ELSE coalesce(nullif((SELECT body FROM l5 WHERE l5.resume_id = l0.resume_id AND sec = 'summary'), ''),
      (SELECT body FROM l4 WHERE l4.resume_id = l0.resume_id AND seg = 0), '') END AS summary
    FROM l0 LEFT JOIN l6 USING (resume_id) LEFT JOIN l7 USING (resume_id)"""))
def _(spark, d):
    return MT.with_sections(resumes(spark, d)).select("resume_id", *_SECTIONS)


@query("l3_candidate_years", O.over(RES, f"SELECT resume_id, {years_sql('text', 'max')} AS years FROM res"))
def _(spark, d):
    return resumes(spark, d).select("resume_id", experience.candidate_years("text").alias("years"))


@query("l4_required_years", O.raw(f"SELECT ingest_seq, {years_sql('job_description', 'min')} AS years FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", experience.required_years("job_description").alias("years"))


# applications: the postings of company n get résumé n, beginning again after the last one
_DOCS = f"""{O.RAW}, {RES},
cv AS (SELECT resume_id, text, {skills_sql('b')} AS rs, {years_sql('text', 'max')} AS ry FROM (SELECT *, {_NTEXT.format(x='text')} AS b FROM res)),
jd0 AS (SELECT ingest_seq AS job_id, o_custkey, regexp_replace({_JD_RAW}, '^\\s+|\\s+$', '', 'g') AS jt FROM raw_jobs),
jd AS (SELECT job_id, o_custkey, jt, {skills_sql('b')} AS js, {years_sql('jt', 'min')} AS jy FROM (SELECT *, {_NTEXT.format(x='jt')} AS b FROM jd0))"""
_FIT = ("CASE WHEN jy IS NULL THEN 1.0 WHEN ry IS NULL THEN 0.4 WHEN ry >= jy THEN 1.0 "
        "ELSE greatest(0, least(1, ry / greatest(jy, 0.5))) END")
_SKILL = "CASE WHEN len(js) > 0 THEN len(list_filter(js, lambda s: list_contains(rs, s))) / len(js) ELSE 0 END"
_PAIR_TERMS = f"""prs AS (SELECT resume_id, job_id, rs, ry, js, jy FROM jd JOIN cv ON resume_id = o_custkey % (SELECT count(*) FROM documents)),
cvt AS (SELECT resume_id, term, count(*) AS tf FROM (SELECT resume_id, unnest(list_concat(tk, {bigrams('tk')})) AS term FROM (SELECT resume_id, {kw_tokens('text')} AS tk FROM cv)) GROUP BY ALL),
jdt AS (SELECT job_id, term, count(*) AS tf FROM (SELECT job_id, unnest(list_concat(tk, {bigrams('tk')})) AS term FROM (SELECT job_id, {kw_tokens('jt')} AS tk FROM jd)) GROUP BY ALL)"""
# all terms of the posting, in falling order of their counts
_ALL_TERMS = """rk AS (SELECT prs.resume_id, job_id, j.term, j.tf AS o, c.tf IS NOT NULL AS found FROM prs JOIN jdt j USING (job_id)
  LEFT JOIN cvt c ON c.resume_id = prs.resume_id AND c.term = j.term)"""
# the best terms of each side by TF-IDF over the two documents, within their most used terms
_BEST_TERMS = f"""al AS (SELECT resume_id, job_id, term, sum(a) AS a, sum(b) AS b FROM (
  SELECT resume_id, job_id, term, tf AS a, 0 AS b FROM prs JOIN cvt USING (resume_id)
  UNION ALL SELECT resume_id, job_id, term, 0, tf FROM prs JOIN jdt USING (job_id)) GROUP BY ALL),
vo AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY resume_id, job_id ORDER BY a + b DESC, term) <= {MT.DASHBOARD_LIMITS['features']}),
wt AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE {math.log(1.5) + 1!r} END AS idf FROM vo),
rk0 AS (SELECT *, row_number() OVER (PARTITION BY resume_id, job_id, b > 0 ORDER BY round(b * idf, 9) DESC, term) AS jr,
  row_number() OVER (PARTITION BY resume_id, job_id, a > 0 ORDER BY round(a * idf, 9) DESC, term) AS cr FROM wt),
rk AS (SELECT resume_id, job_id, term, -jr AS o, a > 0 AND cr <= {MT.DASHBOARD_LIMITS['resume_terms']} AS found FROM rk0
  WHERE b > 0 AND jr <= {MT.DASHBOARD_LIMITS['jd_terms']})"""


def match_sql(terms):
    return f"""{_DOCS},
{_PAIR_TERMS},
{terms},
ko AS (SELECT resume_id, job_id, count(*) AS asked, count(*) FILTER (found) AS hit,
  string_agg(term, '|' ORDER BY o DESC, term) FILTER (found) AS matched_keywords FROM rk GROUP BY ALL),
m0 AS (SELECT prs.*, {_SKILL} AS so, coalesce(hit / asked, 0) AS ks, coalesce(matched_keywords, '') AS matched_keywords, {_FIT} AS es
  FROM prs LEFT JOIN ko USING (resume_id, job_id)),
mt AS (SELECT *, {O.half_even('(0.6 * so + 0.2 * ks + 0.2 * es) * 100', 1)} AS score, {O.half_even('so * 100', 1)} AS skill_score,
  {O.half_even('ks * 100', 1)} AS keyword_score, {O.half_even('es * 100', 1)} AS experience_score,
  list_filter(js, lambda s: NOT list_contains(rs, s)) AS missing FROM m0)"""


MATCH, DASHBOARD_MATCH = match_sql(_ALL_TERMS), match_sql(_BEST_TERMS)


def _bykey(x):
    key = _KEY.format(x="s")
    return (f"list_transform(list_sort(list_transform({x}, lambda s: {key} || chr(1) || s)), lambda s: string_split(s, chr(1))[2])")


def _resume_features(spark, d, keywords=True, limited=False):
    return MT.document_features(resumes(spark, d), "resume_id", "text", experience.candidate_years("text"), keywords=keywords, ranked=limited)


def _posting_features(jobs, keywords=True):
    return MT.document_features(jobs, "job_id", "jt", experience.required_years("jt"), keywords=keywords)


def features(spark, d, keywords=True, limited=False):
    cv = _resume_features(spark, d, keywords, limited)
    jobs = _posting_texts(L.raw(spark, d))
    jd = _posting_features(jobs, keywords)
    many = D.table(spark, d, "documents").agg(F.count("*")).scalar()
    pairs = jobs.select((F.col("o_custkey") % many).alias("resume_id"), "job_id")
    return pairs, cv, jd


def matched(spark, d, limits=None):
    return MT.match_pairs(*features(spark, d, limited=limits is not None), limits=limits)


_J = lambda c: F.array_join(c, "|").alias(c)


@query("l5_skill_overlap", O.over(MATCH, f"""
SELECT resume_id, job_id, array_to_string({_bykey('list_filter(js, lambda s: list_contains(rs, s))')}, '|') AS matched_skills,
  array_to_string({_bykey('missing')}, '|') AS missing_skills,
  array_to_string({_bykey('list_filter(rs, lambda s: NOT list_contains(js, s))')}, '|') AS resume_only_skills, round(so, 6) AS skill_overlap FROM mt"""))
def _(spark, d):
    pairs, cv, jd = features(spark, d, keywords=False)
    df = (pairs.join(jd.select("job_id", MT.keyed_skills("skills").alias("js")), "job_id")
          .join(cv.select("resume_id", MT.keyed_skills("skills").alias("rs")), "resume_id"))
    df = MT.with_skill_overlap(df, "rs", "js", keyed=True)
    return df.select("resume_id", "job_id", _J("matched_skills"), _J("missing_skills"), _J("resume_only_skills"),
                     F.round("skill_overlap", 6).alias("skill_overlap"))


@query("l6_keyword_overlap", O.over(MATCH, "SELECT resume_id, job_id, keyword_score, matched_keywords FROM mt"))
def _(spark, d):
    return matched(spark, d).select("resume_id", "job_id", "keyword_score", _J("matched_keywords"))


@query("l6_keyword_overlap_dashboard", O.over(DASHBOARD_MATCH, "SELECT resume_id, job_id, score, keyword_score, matched_keywords FROM mt"))
def _(spark, d):
    return matched(spark, d, MT.DASHBOARD_LIMITS).select("resume_id", "job_id", "score", "keyword_score", _J("matched_keywords"))


@query("l7_experience_alignment", O.over(MATCH, "SELECT resume_id, job_id, ry, jy, round(es, 6) AS fit FROM mt"))
def _(spark, d):
    pairs, cv, jd = features(spark, d, keywords=False)
    df = pairs.join(jd.select("job_id", F.col("years").alias("jy")), "job_id").join(
        cv.select("resume_id", F.col("years").alias("ry")), "resume_id")
    return df.withColumn("fit", F.round(experience.experience_alignment("ry", "jy"), 6))


@query("l8_match_scores", O.over(MATCH, "SELECT resume_id, job_id, score, skill_score, keyword_score, experience_score FROM mt"))
def _(spark, d):
    return matched(spark, d).select("resume_id", "job_id", "score", "skill_score", "keyword_score", "experience_score")


_ATS = (f"{O.RAW}, k AS (SELECT ingest_seq, {kw_tokens('job_description')} AS tk FROM raw_jobs), "
        f"e AS (SELECT ingest_seq, unnest(list_concat(tk, {bigrams('tk')})) AS keyword FROM k)")
_ATS_RANK = """SELECT ingest_seq, keyword, count(*) AS tf, CAST(row_number() OVER (PARTITION BY ingest_seq ORDER BY count(*) DESC, keyword) AS INTEGER) AS rank
FROM e GROUP BY 1, 2"""


@query("l9_ats_keywords", O.over(_ATS, _ATS_RANK))
def _(spark, d):
    return MT.ats_keywords(L.raw(spark, d), "ingest_seq", "job_description")


@query("l9_ats_top_keywords", O.over(_ATS, _ATS_RANK + " QUALIFY rank <= 20"))
def _(spark, d):
    return MT.ats_keywords(L.raw(spark, d), "ingest_seq", "job_description", 20)


_REC = (f"list_transform({_bykey('missing')}, lambda s: coalesce({O.sql_map(rules.LEARNING_SUGGESTIONS)}[s], "
        f"{O.q(rules.LEARNING_TEMPLATE[0])} || s || {O.q(rules.LEARNING_TEMPLATE[1])}))")


@query("l10_recommendations", O.over(MATCH, f"SELECT resume_id, job_id, array_to_string({_REC}, '|') AS recommendations FROM mt"))
def _(spark, d):
    return matched(spark, d).select("resume_id", "job_id", _J("recommendations"))


@query("l11_skills_frame", O.over(MATCH, """
SELECT resume_id, job_id, 'matched' AS type, unnest(list_filter(js, lambda s: list_contains(rs, s))) AS skill FROM mt
UNION ALL SELECT resume_id, job_id, 'missing', unnest(missing) FROM mt
UNION ALL SELECT resume_id, job_id, 'resume_only', unnest(list_filter(rs, lambda s: NOT list_contains(js, s))) FROM mt"""))
def _(spark, d):
    return MT.skills_frame(matched(spark, d))


@query("l11_summary_frame", O.over(MATCH, """SELECT resume_id, job_id, score AS match_score, skill_score, keyword_score, experience_score,
  ry AS candidate_experience, jy AS required_experience FROM mt"""))
def _(spark, d):
    return MT.summary_frame(matched(spark, d))


@query("l12_normalize_items", O.raw(
    f"SELECT ingest_seq, array_to_string(list_transform(list_sort(list_transform(list_distinct({O.comma_list('skills_required')}), "
    "lambda s: lower(s) || chr(1) || s)), lambda s: string_split(s, chr(1))[2]), '|') AS items FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", F.array_join(skills.normalize_items(F.split("skills_required", ",")), "|").alias("items"))


_TOP = f"""{_DOCS},
jc AS (SELECT jt, any_value(js) AS js, any_value(jy) AS jy, min(job_id) AS c, list(job_id ORDER BY job_id)[1:10] AS ids FROM jd @where GROUP BY 1),
jcl AS (SELECT c, js, jy, ids, list_distinct(list_concat(tk, {bigrams('tk')})) AS tl FROM (SELECT *, {kw_tokens('jt')} AS tk FROM jc)),
cvl AS (SELECT resume_id, rs, ry, list_distinct(list_concat(tk, {bigrams('tk')})) AS rl FROM (SELECT *, {kw_tokens('text')} AS tk FROM cv)),
hits AS (SELECT resume_id, c, count(*) AS h FROM (SELECT c, unnest(tl) AS term FROM jcl) JOIN (SELECT resume_id, unnest(rl) AS term FROM cvl) USING (term) GROUP BY ALL),
parts AS (SELECT resume_id, ids, {_SKILL} AS so, coalesce(h / len(tl), 0) AS ks, {_FIT} AS es FROM cvl CROSS JOIN jcl LEFT JOIN hits USING (resume_id, c)),
fl AS (SELECT resume_id, unnest(ids) AS job_id, {O.half_even('(0.6 * so + 0.2 * ks + 0.2 * es) * 100', 1)} AS score FROM parts)"""
_TOP_RANK = """SELECT resume_id, job_id, score, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, job_id) AS INTEGER) AS rank
FROM fl QUALIFY rank <= 10"""


def _posting_texts(raw):
    return raw.select(F.col("ingest_seq").alias("job_id"), "o_custkey", G.posting_text(skills_col="skills_required").alias("jt"))


def _ranked(spark, d, raw, k=10):
    # postings of one text score alike: features are found for the first k of each
    jobs = MT.top_per_group(_posting_texts(raw).drop("o_custkey"), ["jt"], [F.col("job_id")], k).drop("rank")
    return MT.top_postings(_resume_features(spark, d), _posting_features(jobs), k)


@query("l13_top_postings", O.over(_TOP.replace("@where", ""), _TOP_RANK))
def _(spark, d):
    return _ranked(spark, d, L.raw(spark, d))


@query("l13_top_postings_of_a_role", O.over(_TOP.replace("@where", f"""WHERE job_id IN (
  SELECT ingest_seq FROM raw_jobs WHERE {O.role('job_title')} = 'Data Engineer')"""), _TOP_RANK))
def _(spark, d):
    return _ranked(spark, d, L.raw(spark, d).where(roles.role_category() == "Data Engineer"))


@query("j6_keyword_set_overlap", O.over(
    tfidf("documents", "text", "doc_id", max_features=350, min_df=3) + """, r AS (SELECT doc_id, term, round(weight, 9) AS weight FROM kw),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 20),
ks AS (SELECT doc_id, list(term) AS terms FROM t GROUP BY 1)""",
    """SELECT a.doc_id, b.doc_id AS other_id, array_to_string(list_sort(list_filter(a.terms, lambda s: list_contains(b.terms, s))), '|') AS shared
    FROM ks a JOIN ks b ON b.doc_id = a.doc_id + 1"""))
def _(spark, d):
    docs = D.documents(spark, d)
    lists = KW.keyword_lists(docs, "text", "doc_id", 20, max_features=350, min_df=3)
    pairs = docs.select("doc_id", (F.col("doc_id") + 1).alias("other_id"))
    out = KW.keyword_set_overlap(pairs, lists, "doc_id", "other_id", "doc_id")
    return out.withColumn("shared", F.array_join("shared", "|"))


@query("o6_radar", O.over(MATCH, " UNION ALL ".join(
    f"SELECT resume_id, job_id, '{a}' AS axis, {c} AS value FROM mt"
    for a, c in (("skills", "skill_score"), ("keywords", "keyword_score"), ("experience", "experience_score"), ("total", "score")))))
def _(spark, d):
    return MT.radar(matched(spark, d))


@query("a14_full_report", O.over(MATCH, f"""
SELECT resume_id, job_id, 'summary' AS section, score AS match_score, skill_score, keyword_score, experience_score, ry AS candidate_experience,
  jy AS required_experience FROM mt
UNION ALL BY NAME SELECT resume_id, job_id, 'skills' AS section, 'matched' AS type, unnest(list_filter(js, lambda s: list_contains(rs, s))) AS skill FROM mt
UNION ALL BY NAME SELECT resume_id, job_id, 'skills' AS section, 'missing' AS type, unnest(missing) AS skill FROM mt
UNION ALL BY NAME SELECT resume_id, job_id, 'skills' AS section, 'resume_only' AS type, unnest(list_filter(rs, lambda s: NOT list_contains(js, s))) AS skill FROM mt
UNION ALL BY NAME SELECT resume_id, job_id, 'keywords' AS section, CASE WHEN found THEN 'matched' ELSE 'missing' END AS type, term AS keyword FROM rk
UNION ALL BY NAME SELECT resume_id, job_id, 'recommendations' AS section, unnest({_REC}) AS recommendation FROM mt"""))
def _(spark, d):
    return MT.full_report(matched(spark, d))
