"""Projections, predicates, joins and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import concat_vectors
from ..functions.naming import experiment_name
from ..functions.text import MASK, PLACEHOLDER
from ..operators import checks, metrics, rows, splits
from ..operators.expand import records
from ..operators.report import DISPLAY_NAMES, display_names
from ..sources.readers import cast_key
from . import views as V
from .registry import query

ROUNDS = 3


@query(
    "p1_cast_key",
    """SELECT doc_id, TRY_CAST(doc_id::VARCHAR || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END AS BIGINT) AS pmid
       FROM documents""",
)
def cast_keys(spark, sf_dir):
    """Dirty keys (a letter at the end) become NULL."""
    raw = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))
    return V.table(spark, sf_dir, "documents").select("doc_id", cast_key(raw).alias("pmid"))


@query("p2_project", "SELECT doc_id AS pmid, lang, n_chars FROM documents")
def project(spark, sf_dir):
    return (
        V.table(spark, sf_dir, "documents").drop("text", "source").select(F.col("doc_id").alias("pmid"), "lang", "n_chars")
    )


@query(
    "p3_fill_defaults",
    """SELECT d.doc_id AS pmid, coalesce(l.quality, 0) AS quality,
              coalesce(CASE WHEN d.lang <> 'en' THEN d.lang END, '') AS lang
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_defaults(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang")
    )
    joined = docs.join(V.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.normalise(joined, {"quality": 0, "lang": ""}).select(
        F.col("doc_id").alias("pmid"), "quality", "lang"
    )


@query(
    "p4_placeholder",
    f"""WITH {V.SQL_CORPUS}
        SELECT pmid, CASE WHEN abstract = '' THEN '{PLACEHOLDER}' ELSE abstract END AS abstract FROM corpus""",
)
def placeholder(spark, sf_dir):
    return rows.normalise(V.corpus(spark, sf_dir), {}, {"abstract": PLACEHOLDER}).select("pmid", "abstract")


NAMES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in DISPLAY_NAMES.items())


@query(
    "p5_rename_lookup",
    f"""WITH {V.sql_hits()}, names(name, display) AS (VALUES {NAMES_SQL})
        SELECT coalesce(display, experiment) AS experiment, count(*) AS n_docs,
               count(*) FILTER (hit) AS n_hits
        FROM hits LEFT JOIN names ON experiment = name GROUP BY ALL""",
)
def rename(spark, sf_dir):
    hits = records(V.rule_hits(spark, sf_dir), ["pmid"], "hits", "experiment")
    counts = hits.groupBy("experiment").agg(F.count("*").alias("n_docs"), F.count_if("hit").alias("n_hits"))
    return rows.rename_values(counts, "experiment", display_names(counts))


@query(
    "p7_every_nth",
    f"""WITH {V.sql_metrics(41)}
        SELECT experiment, round, tp, fp, fn FROM metrics WHERE round % 20 = 0""",
)
def nth_round(spark, sf_dir):
    scored = metrics.binary_metrics(V.predictions(spark, sf_dir, 41), ["experiment", "round"])
    return rows.every_nth(scored, "round", 20).select("experiment", "round", "tp", "fp", "fn")


@query(
    "p8_correct_flag",
    f"""WITH {V.sql_predictions(ROUNDS)}
        SELECT experiment, round, pmid, (label = prediction)::INTEGER AS correct FROM predictions""",
)
def correct_flag(spark, sf_dir):
    return rows.with_correct(V.predictions(spark, sf_dir, ROUNDS)).select("experiment", "round", "pmid", "correct")


@query(
    "p9_experiment_name",
    """WITH files AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'dev_optimal_' WHEN 1 THEN 'training_title_'
                             WHEN 2 THEN 'dev_all_' ELSE 'training_optimal_' END || source ||
                             CASE WHEN doc_id % 3 = 0 THEN '.jsonl' ELSE '.parquet' END AS file_name FROM documents),
            names AS (SELECT doc_id, file_name, replace(replace(replace(replace(file_name, 'dev_', ''),
                             'training_', ''), '.parquet', ''), '.jsonl', '') AS name FROM files)
       SELECT doc_id, file_name, name AS plain,
              CASE WHEN contains(name, 'optimal') THEN name || '_idf' ELSE name END AS with_idf,
              name || '_bow' AS with_bow FROM names""",
)
def names_of_files(spark, sf_dir):
    kind = F.element_at(
        F.array(*map(F.lit, ("dev_optimal_", "training_title_", "dev_all_", "training_optimal_"))),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    ending = F.when(F.col("doc_id") % 3 == 0, ".jsonl").otherwise(".parquet")
    files = V.table(spark, sf_dir, "documents").select("doc_id", F.concat(kind, "source", ending).alias("file_name"))
    return files.select(
        "doc_id",
        "file_name",
        experiment_name("file_name").alias("plain"),
        experiment_name("file_name", use_idf=True).alias("with_idf"),
        experiment_name("file_name", use_bow=True).alias("with_bow"),
    )


@query(
    "j1_label_subset",
    f"WITH {V.SQL_CORPUS} SELECT pmid, title, journal FROM corpus WHERE pmid IN (SELECT doc_id FROM labels)",
)
def label_subset(spark, sf_dir):
    return V.labelled_corpus(spark, sf_dir).select("pmid", "title", "journal")


@query(
    "j2_features_labels",
    f"""WITH {V.SQL_TOKENS}, {V.SQL_LABELS}
        SELECT tokens.pmid, label, len(tokens)::INTEGER AS n_tokens
        FROM tokens JOIN labels_v ON tokens.pmid = labels_v.pmid""",
)
def features_labels(spark, sf_dir):
    lab = V.labels(spark, sf_dir)
    sized = V.labelled_tokens(spark, sf_dir).select("pmid", F.size("tokens").alias("n_tokens"))
    return rows.attach_labels(sized, lab, strict=True)


@query(
    "j3_three_way",
    f"""WITH {V.SQL_TOKENS}, {V.SQL_LABELS}, {V.SQL_VECTORS}
        SELECT t.pmid, label, len(tokens)::INTEGER AS n_tokens,
               round(list_concat(abstracts_embedded, titles_embedded)[1]::DOUBLE, 6) AS first_element,
               len(list_concat(abstracts_embedded, titles_embedded))::INTEGER AS width
        FROM tokens t JOIN vectors v ON t.pmid = v.pmid JOIN labels_v l ON t.pmid = l.pmid""",
)
def three_way(spark, sf_dir):
    vectors = V.vectors(spark, sf_dir).select(
        "pmid", concat_vectors("abstracts_embedded", "titles_embedded").alias("embedding")
    )
    bow = V.tokens(spark, sf_dir).select("pmid", F.size("tokens").alias("n_tokens"))
    joined = rows.attach_features(bow, vectors, V.labels(spark, sf_dir), strict=False)
    return joined.select(
        "pmid", "label", "n_tokens",
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_element"),
        F.size("embedding").alias("width"),
    )


@query(
    "j4_tally_left_join",
    f"""WITH {V.sql_predictions(ROUNDS, experiments=("res_optimal",))},
        done AS (SELECT pmid, count(*) AS times_test,
                        (sum((label = prediction)::INTEGER))::BIGINT AS times_correct FROM predictions GROUP BY pmid)
        SELECT l.pmid, label, coalesce(times_correct, 0) AS times_correct, coalesce(times_test, 0) AS times_test,
               round(100.0::DOUBLE * times_correct / times_test, 6) AS pct
        FROM labels_v l LEFT JOIN done ON l.pmid = done.pmid""",
)
def tally_left_join(spark, sf_dir):
    scored = rows.with_correct(V.predictions(spark, sf_dir, ROUNDS, experiments=("res_optimal",)))
    return metrics.doc_tally(V.labels(spark, sf_dir), scored).withColumn("pct", F.round("pct", 6))


@query(
    "j5_zip_by_key",
    """SELECT d.doc_id AS pmid, length(d.text) AS n_text, len(e.embedding)::INTEGER AS width
       FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def zip_tables(spark, sf_dir):
    left = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pmid"), F.length("text").cast("bigint").alias("n_text")
    )
    right = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pmid"), F.size("embedding").alias("width")
    )
    return rows.zip_by_key(left, right)


@query(
    "j6_round_expand",
    f"WITH {V.SQL_LABELS} SELECT pmid, label, r.round::INTEGER AS round FROM labels_v, range(0, 5) r(round)",
)
def expand_rounds(spark, sf_dir):
    return splits.round_expand(V.labels(spark, sf_dir), 5)


@query(
    "j7_lexicon_mask",
    f"""WITH {V.SQL_TOKENS}
        SELECT pmid, array_to_string(list_transform(tokens, lambda t: CASE WHEN t IN ({V.in_list(V.LEXICON)})
                                     THEN '{MASK}' ELSE t END), ' ') AS masked,
               len(list_filter(tokens, lambda t: t IN ({V.in_list(V.LEXICON)}))) AS n_masked
        FROM tokens""",
)
def lexicon_mask(spark, sf_dir):
    lexicon = spark.createDataFrame([(w,) for w in V.LEXICON], "token string")
    masked = rows.mask_tokens(V.tokens(spark, sf_dir), lexicon, MASK)
    return masked.select(
        "pmid",
        F.array_join("tokens", " ").alias("masked"),
        F.size(F.filter("tokens", lambda t: t == MASK)).cast("bigint").alias("n_masked"),
    )


@query(
    "c1_id_parity",
    """WITH a AS (SELECT doc_id AS k, count(*) AS n FROM documents GROUP BY 1),
            b AS (SELECT vec_id % 400 AS k, count(*) AS n FROM embeddings GROUP BY 1)
       SELECT count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right,
              count(*) FILTER (a.n > 1) AS repeated_left, count(*) FILTER (b.n > 1) AS repeated_right
       FROM a FULL JOIN b ON a.k = b.k""",
)
def parity(spark, sf_dir):
    a = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"))
    b = V.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 400).alias("pmid"))
    return checks.id_parity(a, b)


@query(
    "c1b_same_multiset",
    """SELECT 'again' AS side, count(*) AS n_left, count(*) AS n_right, true AS same FROM documents UNION ALL
       SELECT 'one less', count(*), count(*) - 1, false FROM documents UNION ALL
       SELECT 'one changed', count(*), count(*), count(*) = 0 FROM documents""",
)
def multisets(spark, sf_dir):
    """All columns of the corpus against itself dealt anew, without its first row, and with one changed."""
    docs = V.table(spark, sf_dir, "documents")
    first = F.col("doc_id") == docs.agg(F.min("doc_id")).first()[0]
    others = {
        "again": docs.repartition("doc_id"), "one less": docs.where(~first),
        "one changed": docs.withColumn("text", F.when(first, F.lit("?")).otherwise(F.col("text"))),
    }
    found = [checks.same_multiset(docs, o, *docs.columns).withColumn("side", F.lit(n)) for n, o in others.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("c2_two_labels", f"WITH {V.SQL_LABELS} SELECT count(DISTINCT label) AS n_values FROM labels_v")
def two_labels(spark, sf_dir):
    lab = V.labels(spark, sf_dir)
    checks.require_n_values(lab, "label", 2)
    return checks.distinct_values(lab, "label")
