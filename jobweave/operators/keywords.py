"""Keyword analytics: cleaning, TF-IDF, fallback counts, topics, pairs.

Weights follow the smooth form: idf = ln((1 + N) / (1 + df)) + 1, weight = tf * idf,
each document scaled to length 1; a corpus score is the mean over all N documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import explode_each, inline_each, let, run_lengths, text
from jobweave.functions.skills import extract_skills, phrases, skill_category, skill_pairs
from jobweave.operators import counts as K
from jobweave.plans.warehouse import written

# A word: starts with a letter, two characters or more, ends before trailing '+' and '#'.
# All other characters separate words, so the look-behind stands for a word boundary.
TOKEN = r"(?<![a-z0-9À-ỹ])[a-zÀ-ỹ][a-z0-9+#À-ỹ]*[a-z0-9À-ỹ]"
STOP_WORDS = rules.STOP_WORDS_VI + rules.STOP_WORDS_EN
LARGE_PARTS = 1000
#: Words that may be literals of a plan.
FEW_WORDS = 10_000


def _no_links(c: str | Column) -> Column:
    return let(F.lower(text(c)), lambda low: F.when(
        low.contains("http"), F.regexp_replace(low, r"https?://\S+", " ")).otherwise(low))


def clean_keyword_text(c: str | Column) -> Column:
    """Lower case, links removed, every run of other characters one space."""
    return F.trim(F.regexp_replace(_no_links(c), r"[^a-z0-9+#À-ỹ]+", " "))


def tokens(c: str | Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of a text; a word holds no character that cleaning replaces, so the text is cut without it."""
    found = F.regexp_extract_all(_no_links(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def with_terms(df: DataFrame, text_col: str, ngrams: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Keep columns and ``terms``: (term, tf) for words and word runs of each non-blank text.

    Occurrences are counted inside the row, so later steps handle a term once
    per document and need no shuffle by document to count it.
    """
    df = df.where(F.trim(text(text_col)) != "").select(*keep, tokens(text_col).alias("_tokens"))
    runs = [phrases(F.col("_tokens"), n) for n in range(2, ngrams + 1)]
    df = df.withColumn("_grams", F.concat("_tokens", *runs) if runs else F.col("_tokens"))
    return df.select(*keep, run_lengths(F.col("_grams")).alias("terms"))


def vocabulary(docs: DataFrame, by: Sequence[str], max_features: int, min_df: int) -> DataFrame:
    """Most used terms with corpus and document frequency; counts merge before the shuffle."""
    counts = (inline_each(docs, "terms", "term", by).groupBy(*by, "term")
              .agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where(F.col("df") >= min_df))
    if by:
        return K.top_per_group(counts, by, [F.desc("cf"), F.col("term")], max_features).drop("rank")
    return counts.orderBy(F.desc("cf"), "term").limit(max_features)


def keyword_weights(df: DataFrame, text_col: str, doc: str, by: Sequence[str] = (),
                    max_features: int = 300, min_df: int = 1, ngrams: int = 2) -> DataFrame:
    """(by..., doc, term, weight, docs) for the vocabulary terms of each document.

    The terms of a text that can be in the vocabulary are counted once and written, then
    read twice: first to choose the vocabulary, then to keep only its terms.  The one
    shuffle by document thus carries at most ``max_features`` short rows per document.
    """
    by = list(by)
    docs = written(_candidate_terms(df, text_col, doc, by, max_features, min_df, ngrams), "terms")
    vocab = vocabulary(docs, by, max_features, min_df)
    if by:
        vocab = vocab.join(docs.groupBy(*by).agg(F.count("*").alias("docs")), by)
    else:
        vocab = vocab.withColumn("docs", docs.agg(F.count("*")).scalar())
    idf = F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    vocab = vocab.select(*by, "term", "docs", idf.alias("idf"))
    if by:
        hits = _term_hits(docs, doc, by, written(vocab, "vocabulary"))
    else:                                                  # max_features rows
        hits = inline_each(docs, "terms", "term", [doc]).join(F.broadcast(vocab), "term")
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(*by, doc)))
    return hits.select(*by, doc, "term", (raw / norm).alias("weight"), "docs")


def _candidate_terms(df: DataFrame, text_col: str, doc: str, by: list[str], max_features: int, min_df: int, ngrams: int) -> DataFrame:
    """``with_terms``, less terms that cannot be in a vocabulary.

    A run of words is no more frequent than each of its words.  So the words of
    which ``max_features`` are as frequent bound the vocabulary from below, and runs with a
    rarer word are left out.  Where these words are more than ``FEW_WORDS`` (many groups, or
    many ties), all terms stay.
    """
    keep = [*by, doc]
    cut = df.where(F.trim(text(text_col)) != "").select(*keep, tokens(text_col).alias("_tokens"))
    cut = written(cut, "tokens")
    counts = (inline_each(cut.select(*by, run_lengths(F.col("_tokens")).alias("terms")), "terms", "term", by).groupBy(*by, "term")
              .agg(F.sum("tf").alias("cf"), F.count("*").alias("df")))
    counts = written(counts, "words")
    enough = counts.where(F.col("df") >= min_df)
    if by:
        least = (K.top_per_group(enough, by, [F.desc("cf"), F.col("term")], max_features).groupBy(*by)
                 .agg(F.min("cf").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") == max_features))
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
        words = counts.alias("a").join(least.alias("b"), same, "left").where(F.col("_least").isNull() | (F.col("cf") >= F.col("_least")))
        words = words.select("a.term").distinct()
    else:
        least = enough.orderBy(F.desc("cf"), "term").limit(max_features).agg(F.min("cf").alias("_least"), F.count("*").alias("_n"))
        words = counts.crossJoin(F.broadcast(least)).where((F.col("_n") < max_features) | (F.col("cf") >= F.col("_least"))).select("term")
    few = [r.term for r in words.limit(FEW_WORDS + 1).collect()]
    if 0 < len(few) <= FEW_WORDS:                          # one text, as thousands of literals are slow to hand over; a word holds no quote
        one_of = ", ".join(f"'{w}'" for w in few)
        cut = cut.withColumn("_tokens", F.expr(f"transform(_tokens, t -> CASE WHEN t IN ({one_of}) THEN t END)"))
    runs = [_whole_runs(F.col("_tokens"), n) for n in range(2, ngrams + 1)]
    return cut.select(*keep, run_lengths(F.concat(F.array_compact("_tokens"), *runs)).alias("terms"))


def _whole_runs(words: Column, n: int) -> Column:
    """``phrases`` without those that have a NULL."""
    sides = [F.slice(words, i + 1, F.greatest(F.size(words) - n + 1, F.lit(0))).alias(f"t{i}") for i in range(n)]
    joined = lambda z: F.concat(z["t0"], *[F.concat(F.lit(" "), z[f"t{i}"]) for i in range(1, n)])
    return F.array_compact(F.transform(F.arrays_zip(*sides), joined))


def large_groups(df: DataFrame, by: Sequence[str], parts: int = LARGE_PARTS) -> DataFrame:
    """Groups with at least 1/``parts`` of all rows, so at most ``parts`` of them; NULL is no group."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    return counts.where(some & (F.col("_n") * parts >= df.agg(F.count("*")).scalar())).select(*by)


def _grouped_hits(df: DataFrame, text_col: str, doc: str, by: list[str], ngrams: int, vocab: DataFrame) -> DataFrame:
    """``_term_hits`` of texts."""
    return _term_hits(written(with_terms(df, text_col, ngrams, [*by, doc]), "terms"), doc, by, vocab)


def _term_hits(docs: DataFrame, doc: str, by: list[str], vocab: DataFrame) -> DataFrame:
    """Term counts of the documents (by..., doc, terms), reduced to their group's vocabulary.

    Documents of large groups meet the vocabularies of these by broadcast, at most
    ``LARGE_PARTS`` times ``max_features`` rows whatever the size of the table: none of their terms is
    shuffled, so a group with a third of all documents is spread like its files.  Terms of
    the other groups are shuffled by group and term, a key with less than 1/``LARGE_PARTS``
    of all documents.
    """
    large = written(large_groups(docs, by), "large_groups")

    def hits(how: str, small) -> DataFrame:
        return inline_each(docs.join(F.broadcast(large), by, how), "terms", "term", [*by, doc]).join(
            small(vocab.join(F.broadcast(large), by, how)), [*by, "term"])

    return hits("left_semi", F.broadcast).unionByName(hits("left_anti", lambda v: v))


def corpus_keywords(df: DataFrame, text_col: str, doc: str, by: Sequence[str] = (), n: int = 30,
                    **fit) -> DataFrame:
    """Top n (keyword, score), per group when ``by`` is given."""
    w = keyword_weights(df, text_col, doc, by, **fit)
    scores = w.groupBy(*by, F.col("term").alias("keyword")).agg(
        F.round(F.sum("weight") / F.first("docs"), 9).alias("score"))
    if by:
        return K.top_per_group(scores, by, [F.desc("score"), F.col("keyword")], n).drop("rank")
    return K.top_by(scores, "score", "keyword", n)


def document_keywords(df: DataFrame, text_col: str, doc: str, n: int = 10, **fit) -> DataFrame:
    """Top n terms of every document with the fitted vocabulary."""
    w = keyword_weights(df, text_col, doc, **fit).withColumn("weight", F.round("weight", 9))
    return K.top_per_group(w, [doc], [F.desc("weight"), F.col("term")], n).select(doc, "rank", "term", "weight")


def keyword_lists(df: DataFrame, text_col: str, doc: str, n: int = 20, **fit) -> DataFrame:
    """(doc, keywords): the n best terms of every document that has one, as an array in order of the term."""
    top = document_keywords(df, text_col, doc, n, **fit)
    return top.groupBy(doc).agg(F.sort_array(F.collect_list("term")).alias("keywords"))


def keyword_set_overlap(pairs: DataFrame, lists: DataFrame, left: str, right: str, doc: str) -> DataFrame:
    """pairs with ``shared``, the keywords that both documents' lists hold; pairs of listed documents only."""
    a = lists.select(F.col(doc).alias(left), F.col("keywords").alias("_a"))
    b = lists.select(F.col(doc).alias(right), F.col("keywords").alias("_b"))
    both = pairs.join(a, left).join(b, right)
    return both.withColumn("shared", F.array_sort(F.array_intersect("_a", "_b"))).drop("_a", "_b")


def role_keywords(df: DataFrame, text_col="job_description", doc="job_hash", role="role_category",
                  n: int = 8, **fit) -> DataFrame:
    return corpus_keywords(df, text_col, doc, [role], n, **fit)


def company_keywords(df: DataFrame, text_col="job_description", doc="job_hash", company="company_name",
                     companies: int = 10, n: int = 5, **fit) -> DataFrame:
    return corpus_keywords(K.semi_top(df, company, companies), text_col, doc, [company], n, **fit)


def frequency_keywords(df: DataFrame, text_col: str, n: int | None = None) -> DataFrame:
    """Plain counts of words over two characters and of neighbouring word pairs."""
    words = F.filter(F.split(clean_keyword_text(text_col), " "), lambda t: (F.length(t) > 2) & (
        ~t.isin(*STOP_WORDS) | t.isin(*rules.KEEP_WORDS)))
    docs = df.where(F.trim(text(text_col)) != "").select(words.alias("w"))
    each = explode_each(docs, F.concat("w", phrases(F.col("w"), 2)), "keyword")
    return K.value_counts(each, "keyword", n)


def topics(df: DataFrame, text_col: str, doc: str, n_topics: int = 8, size: int = 5, **fit) -> DataFrame:
    """The best keywords cut into groups of ``size`` (at most n_topics * size rows)."""
    top = corpus_keywords(df, text_col, doc, (), n_topics * size, **fit)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "keyword"))
    cut = top.withColumn("r", rank).withColumn("topic", F.floor((F.col("r") - 1) / size) + 1)
    items = F.sort_array(F.collect_list(F.struct("r", "keyword")))
    return cut.groupBy("topic").agg(F.transform(items, lambda s: s["keyword"]).alias("keywords"))


def keyword_share(df: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """Share of rows whose text matches each pattern, one pass."""
    one = df.agg(*[F.avg(text(text_col).rlike(p).cast("int")).alias(k) for k, p in patterns.items()])
    return K.unpivot_metrics(one, list(patterns))


def extracted_skill_frequency(df: DataFrame, text_col: str, n: int | None = 50, table=None) -> DataFrame:
    each = explode_each(df, extract_skills(text_col, table), "skill")
    return K.value_counts(each, "skill", n).withColumn("category", skill_category("skill"))


def pair_rankings(df: DataFrame, skills: str, n: int | None = 30) -> DataFrame:
    """Most frequent pairs of distinct skills within a row."""
    each = explode_each(df, skill_pairs(skills), "p")
    out = each.groupBy(F.col("p.a").alias("skill_a"), F.col("p.b").alias("skill_b")).agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), "skill_a", "skill_b").limit(n)
