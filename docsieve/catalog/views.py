"""Views over the given tables, defined alike for Spark and for DuckDB.

``documents`` plays the corpus, ``labels.toxic`` the class, ``embeddings`` the
vectors; a fixed lexicon rule plays a classifier where a query needs predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expand import elements, records
from ..operators.rows import select_labelled
from ..operators.splits import BASE_SEED, assign_splits, holdout_cuts, rounds_of

POSITIVE = "Relevant"
NEGATIVE = "Not Relevant"
LEXICON = ("clown", "idiot", "moron", "pathetic", "scum")
STOP_WORDS = (
    "a", "and", "are", "as", "at", "by", "der", "des", "die", "el", "en", "for", "from", "he",
    "in", "is", "it", "la", "le", "les", "of", "on", "that", "the", "this", "to", "und", "was", "with",
)
# Lexicon rules that play experiments: words that make a document Relevant.
RULES = {
    "res_title": ("title", LEXICON),
    "res_abstract": ("abstract", LEXICON),
    "res_all": ("text", LEXICON + ("loser", "worthless")),
    "res_optimal": ("text", LEXICON),
    "res_mesh": ("text", ("idiot", "clown", "hend")),
    "other_rule": ("text", ("moron", "that")),
}
WORDS = r"[\p{L}\d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_corpus(table(spark, sf_dir, "documents"))


def as_corpus(docs: DataFrame) -> DataFrame:
    """Title = first line, abstract = the rest."""
    cut = F.instr("text", "\n")
    return docs.select(
        F.col("doc_id").alias("pmid"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(cut > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise("").alias("abstract"),
        F.col("source").alias("journal"),
        F.concat(F.lit("L:"), "lang", F.lit("; S:"), "source").alias("publication_types"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pmid"),
        F.when(F.col("toxic") == 1, POSITIVE).otherwise(NEGATIVE).alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements 1-32 play the title part, 33-64 the abstract part."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pmid"),
        F.slice("embedding", 33, 32).alias("abstracts_embedded"),
        F.slice("embedding", 1, 32).alias("titles_embedded"),
    )


def words(col: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(WORDS), F.lit(0))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, tokens) of the whole text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("pmid"), words("text").alias("tokens"))


def labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, tokens) of labelled documents: rows are dropped before any text work."""
    scan = table(spark, sf_dir, "documents")
    kept = select_labelled(scan.select(F.col("doc_id").alias("pmid"), "text"), labels(spark, sf_dir))
    return kept.select("pmid", words("text").alias("tokens"))


def tokens_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, label, tokens) of labelled documents: one join, which also drops the rest before any text work."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), "text")
    return docs.join(labels(spark, sf_dir), "pmid").select("pmid", "label", words("text").alias("tokens"))


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus view of labelled documents, reduced at the scan."""
    return select_labelled(corpus(spark, sf_dir), labels(spark, sf_dir))


def split_tokens(spark: SparkSession, sf_dir: str, rounds: int, size: float = 0.2) -> DataFrame:
    """(label, pmid, tokens, splits) of labelled documents."""
    return assign_splits(tokens_and_label(spark, sf_dir), holdout_cuts(labels(spark, sf_dir), rounds, size))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, hits) of labelled documents: each text is tokenised once, all
    rules are read off the same lists."""
    listed = labelled_corpus(spark, sf_dir).select(
        "pmid", words("title").alias("title"), words("abstract").alias("abstract")
    )
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("experiment"),
                F.arrays_overlap(
                    F.concat("title", "abstract") if field == "text" else F.col(field), F.array(*map(F.lit, lex))
                ).alias("hit"),
            )
            for name, (field, lex) in RULES.items()
        ]
    )
    return listed.select("pmid", rules.alias("hits"))


def predictions(
    spark: SparkSession, sf_dir: str, rounds: int, size: float = 0.2, experiments: tuple[str, ...] | None = None
) -> DataFrame:
    """(experiment, round, pmid, label, prediction) of the test parts."""
    lab = labels(spark, sf_dir)
    rows = assign_splits(rule_hits(spark, sf_dir).join(lab, "pmid"), holdout_cuts(lab, rounds, size))
    test = rows.select("pmid", "label", "hits", rounds_of("test").alias("_rounds"))
    if experiments:
        test = test.withColumn("hits", F.filter("hits", lambda h: h["experiment"].isin(*experiments)))
    each = elements(test, ["pmid", "label", "hits"], "_rounds", "round")
    return records(each, ["round", "pmid", "label"], "hits", "experiment").select(
        "experiment", "round", "pmid", "label",
        F.when(F.col("hit"), POSITIVE).otherwise(NEGATIVE).alias("prediction"),
    )


# --- The same views for DuckDB ---------------------------------------------

def in_list(words_: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words_)


SQL_CORPUS = """corpus AS (
  SELECT doc_id AS pmid, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract,
         source AS journal, 'L:' || lang || '; S:' || source AS publication_types
  FROM documents)"""

SQL_LABELS = f"""labels_v AS (
  SELECT doc_id AS pmid, CASE WHEN toxic = 1 THEN '{POSITIVE}' ELSE '{NEGATIVE}' END AS label FROM labels)"""

SQL_VECTORS = """vectors AS (
  SELECT vec_id AS pmid, embedding[33:64] AS abstracts_embedded, embedding[1:32] AS titles_embedded
  FROM embeddings)"""


def sql_words(expr: str) -> str:
    return rf"regexp_extract_all(lower({expr}), '[\p{{L}}\d]+')"


SQL_TOKENS = f"tokens AS (SELECT doc_id AS pmid, {sql_words('text')} AS tokens FROM documents)"


def sql_splits(rounds: int, size: float = 0.2) -> str:
    """CTEs ending in splits(round, pmid, label, split): plain ranks per class."""
    return f"""{SQL_LABELS},
  class_n AS (SELECT label, count(*) AS n_class FROM labels_v GROUP BY label),
  shares AS (SELECT label, n_class, (sum(n_class) OVER ())::BIGINT AS n_all,
                    ceil({size} * (sum(n_class) OVER ()))::BIGINT AS n_val FROM class_n),
  bases AS (SELECT *, n_class * n_val // n_all AS base, n_class * n_val % n_all AS rest FROM shares),
  quota AS (SELECT label, n_class, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                   <= n_val - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM bases),
  ranked AS (SELECT r.round::INTEGER AS round, pmid, label,
                    row_number() OVER (PARTITION BY r.round, label
                      ORDER BY md5(({BASE_SEED} + r.round)::VARCHAR || ':' || pmid::VARCHAR), pmid) AS rk
             FROM labels_v, range(0, {rounds}) r(round)),
  splits AS (SELECT round, pmid, ranked.label,
                    CASE WHEN rk <= quota THEN 'val' WHEN rk <= 2 * quota THEN 'test' ELSE 'train' END AS split
             FROM ranked JOIN quota ON ranked.label = quota.label)"""


def sql_hits() -> str:
    rules = " UNION ALL ".join(
        f"SELECT pmid, '{name}' AS experiment, list_has_any({field}_w, [{in_list(lex)}]) AS hit FROM doc_words"
        for name, (field, lex) in RULES.items()
    )
    return f"""{SQL_CORPUS},
  title_abs AS (SELECT pmid, {sql_words('title')} AS title_w, {sql_words('abstract')} AS abstract_w
                FROM corpus WHERE pmid IN (SELECT doc_id FROM labels)),
  doc_words AS (SELECT *, list_concat(title_w, abstract_w) AS text_w FROM title_abs),
  hits AS ({rules})"""


def sql_predictions(rounds: int, size: float = 0.2, experiments: tuple[str, ...] | None = None) -> str:
    """CTEs ending in predictions(experiment, round, pmid, label, prediction)."""
    only = f" AND experiment IN ({in_list(experiments)})" if experiments else ""
    return f"""{sql_splits(rounds, size)},
  {sql_hits()},
  predictions AS (
    SELECT experiment, round, splits.pmid, label,
           CASE WHEN hit THEN '{POSITIVE}' ELSE '{NEGATIVE}' END AS prediction
    FROM splits JOIN hits ON splits.pmid = hits.pmid WHERE split = 'test'{only})"""


SQL_COUNTS = f"""count(*) FILTER (label = '{POSITIVE}' AND prediction = '{POSITIVE}') AS tp,
           count(*) FILTER (label <> '{POSITIVE}' AND prediction = '{POSITIVE}') AS fp,
           count(*) FILTER (label = '{POSITIVE}' AND prediction <> '{POSITIVE}') AS fn,
           count(*) FILTER (label <> '{POSITIVE}' AND prediction <> '{POSITIVE}') AS tn"""

SQL_PRF = """coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision,
           coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall,
           coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0.0) AS f1"""


def sql_metrics(rounds: int, by: str = "experiment, round", size: float = 0.2) -> str:
    """CTEs ending in metrics(by, tp, fp, fn, tn, precision, recall, f1)."""
    return f"""{sql_predictions(rounds, size)},
  counted AS (SELECT {by}, {SQL_COUNTS} FROM predictions GROUP BY {by}),
  metrics AS (SELECT *, {SQL_PRF} FROM counted)"""
