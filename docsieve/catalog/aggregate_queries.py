"""Aggregations, running statistics, splits, orderings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.naming import interval_text, leading_number
from ..operators import features, metrics, pooling, report, rows, splits
from ..operators.expand import elements, records
from ..session import materialise
from . import views as V
from .registry import query

ROUNDS = 8
SHOW = ("precision", "recall", "f1")


def _metrics(spark, sf_dir, rounds=ROUNDS):
    return metrics.binary_metrics(V.predictions(spark, sf_dir, rounds), ["experiment", "round"])


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _sql_round(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query(
    "top_relevant_terms",
    f"""WITH {V.SQL_TOKENS}, {V.SQL_LABELS},
        terms AS (SELECT DISTINCT t.pmid, label, unnest(tokens) AS token
                  FROM tokens t JOIN labels_v l ON t.pmid = l.pmid),
        counted AS (SELECT token, count(*) AS df, count(*) FILTER (label = '{V.POSITIVE}') AS df_positive
                    FROM terms GROUP BY token HAVING count(*) >= 2)
        SELECT token, df, df_positive, round(df_positive / df::DOUBLE, 6) AS share FROM counted
        ORDER BY df_positive / df::DOUBLE DESC, df DESC, token LIMIT 20""",
)
def top_relevant_terms(spark, sf_dir):
    """One scan, one reducing join, one combined shuffle, one top-k."""
    shares = features.term_share(V.tokens_and_label(spark, sf_dir), "label", V.POSITIVE, min_df=2)
    top = rows.head(shares, [F.desc("share"), F.desc("df"), F.asc("token")], 20)
    return _rounded(top, "share")


@query(
    "a1_balance_factor",
    f"""WITH {V.sql_splits(ROUNDS)},
        c AS (SELECT round, count(*) FILTER (label <> '{V.POSITIVE}') AS n_neg,
                     count(*) FILTER (label = '{V.POSITIVE}') AS n_pos
              FROM splits WHERE split = 'train' GROUP BY round)
        SELECT round, n_neg, n_pos, round(n_neg::DOUBLE / nullif(n_pos, 0), 6) AS factor FROM c""",
)
def balance_factor(spark, sf_dir):
    train = splits.holdout_splits(V.labels(spark, sf_dir), ROUNDS).where(F.col("split") == "train")
    return _rounded(metrics.class_balance(train, ["round"], positive=V.POSITIVE), "factor")


@query(
    "a2_class_share",
    f"""WITH {V.SQL_LABELS}, c AS (SELECT label, count(*) AS n FROM labels_v GROUP BY label)
        SELECT label, n, round(100.0::DOUBLE * n / (SELECT count(*) FROM labels_v), 6) AS pct FROM c""",
)
def class_share(spark, sf_dir):
    return _rounded(metrics.class_share(V.labels(spark, sf_dir)), "pct")


FIELDS = ("title", "abstract", "journal", "publication_types", "keywords")


def _with_gaps(spark, sf_dir):
    """The corpus with a ``keywords`` field that is NULL, empty or filled."""
    gap = F.when(F.col("pmid") % 3 == 0, F.lit(None)).when(F.col("pmid") % 3 == 1, F.lit("")).otherwise("k")
    return V.corpus(spark, sf_dir).withColumn("keywords", gap)


_KEYWORDS = "CASE pmid % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'k' END"
_FILL = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, round(100.0::DOUBLE * count(*) FILTER (coalesce(length({e}), 0) > 0) / count(*), 6) AS pct,
               round(100.0::DOUBLE * count(*) FILTER (coalesce(length({e}), 1) > 0) / count(*), 6) AS pct_null_filled
        FROM corpus"""
    for f, e in [(f, _KEYWORDS if f == "keywords" else f) for f in FIELDS]
)


@query("a3_fill_rate", f"WITH {V.SQL_CORPUS} {_FILL}")
def fill_rate(spark, sf_dir):
    docs = _with_gaps(spark, sf_dir)
    strict = metrics.fill_rate(docs, FIELDS)
    loose = metrics.fill_rate(docs, FIELDS, null_is_empty=False).withColumnRenamed("pct", "pct_null_filled")
    return _rounded(strict.join(loose, "field"), "pct", "pct_null_filled")


@query(
    "a4_prf_by_round",
    f"""WITH {V.sql_metrics(ROUNDS)}
        SELECT experiment, round, tp, fp, fn, tn, {_sql_round(SHOW)},
               round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM metrics""",
)
def prf_by_round(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), *SHOW, "accuracy")


@query(
    "a5_accuracy",
    f"""WITH {V.sql_predictions(ROUNDS)}
        SELECT experiment, round(avg((label = prediction)::INTEGER), 6) AS accuracy, count(*) AS n
        FROM predictions GROUP BY experiment""",
)
def accuracy(spark, sf_dir):
    scored = rows.with_correct(V.predictions(spark, sf_dir, ROUNDS))
    return _rounded(metrics.accuracy(scored, ["experiment"]), "accuracy")


@query(
    "a6_doc_tally",
    f"""WITH {V.sql_predictions(ROUNDS)}
        SELECT experiment, pmid, sum((label = prediction)::INTEGER)::BIGINT AS times_correct, count(*) AS times_test,
               round(100.0::DOUBLE * sum((label = prediction)::INTEGER) / count(*), 6) AS pct
        FROM predictions GROUP BY experiment, pmid""",
)
def doc_tally(spark, sf_dir):
    scored = rows.with_correct(V.predictions(spark, sf_dir, ROUNDS))
    counted = metrics.tally(scored, ["experiment", "pmid"])
    pct = F.try_divide(F.col("times_correct") * F.lit(100.0), F.col("times_test"))
    return counted.withColumn("pct", F.round(pct, 6))


_QUANTILES = ", ".join(
    f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in SHOW for q, n in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))
)


@query(
    "a7_metric_percentiles",
    f"WITH {V.sql_metrics(20)} SELECT experiment, {_QUANTILES} FROM metrics GROUP BY experiment",
)
def metric_percentiles(spark, sf_dir):
    wide = metrics.metric_percentiles(_metrics(spark, sf_dir, 20))
    return _rounded(wide, *[c for c in wide.columns if c != "experiment"])


def _sql_summary(rounds: int) -> str:
    """CTEs ending in summary(experiment, <metric>_lo/mid/hi in percent, iqv)."""
    wide = ", ".join(
        f"quantile_cont({c}, {q}) AS {c}_{n}" for c in SHOW for q, n in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))
    )
    pct = ", ".join(
        f"round_even(round_even({c}_{n}, 4) * 100, 1) AS {c}_{n}" for c in SHOW for n in ("lo", "mid", "hi")
    )
    return f"""{V.sql_metrics(rounds)},
      wide AS (SELECT experiment, {wide} FROM metrics GROUP BY experiment),
      summary AS (SELECT experiment, {pct} FROM wide)"""


_TEXTS = ", ".join(f"printf('%.1f (%.1f,%.1f)', {c}_mid, {c}_lo, {c}_hi) AS {c}_text" for c in SHOW)


@query(
    "a8_interval_summary",
    f"WITH {_sql_summary(20)} SELECT *, {_TEXTS}, round(f1_hi - f1_lo, 6) AS iqv FROM summary",
)
def interval_summary(spark, sf_dir):
    return report.interval_summary(_metrics(spark, sf_dir, 20))


@query(
    "a9_median_std",
    f"""WITH {V.sql_metrics(20)} SELECT experiment,
        {', '.join(f'round(median({c}), 6) AS {c}_median, round(stddev_samp({c}), 6) AS {c}_std' for c in SHOW)}
        FROM metrics GROUP BY experiment""",
)
def median_std(spark, sf_dir):
    out = metrics.median_std(_metrics(spark, sf_dir, 20))
    return _rounded(out, *[c for c in out.columns if c != "experiment"])


@query(
    "a10_histogram",
    """WITH few AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, count(*) AS n,
                           quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM documents),
            widths AS (SELECT lo, hi, (hi - lo) / (log2(n) + 1) AS a, 2 * iqr / power(n, 1 / 3.0::DOUBLE) AS b FROM few),
            span AS (SELECT lo, hi, ceil((hi - lo) / (CASE WHEN b > 0 THEN least(a, b) ELSE a END))::INTEGER AS k FROM widths),
            binned AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS n
                       FROM documents, span GROUP BY 1),
            frame AS (SELECT unnest(range(0, k)) AS bin, lo AS low, (hi - lo) / k AS w FROM span)
       SELECT frame.bin, round(low + frame.bin * w, 4) AS lo, round(low + (frame.bin + 1) * w, 4) AS hi,
              coalesce(n, 0) AS n
       FROM frame LEFT JOIN binned ON frame.bin = binned.bin""",
)
def histogram(spark, sf_dir):
    return _rounded(metrics.histogram(V.table(spark, sf_dir, "documents"), "n_chars"), "lo", "hi", digits=4)


@query(
    "a10c_f1_auto_histogram",
    f"""WITH {V.sql_metrics(20)}, one AS (SELECT f1 FROM metrics WHERE experiment = 'res_title'),
        few AS (SELECT min(f1) AS lo, max(f1) AS hi, count(*) AS n, quantile_cont(f1, 0.75) - quantile_cont(f1, 0.25) AS iqr FROM one),
        widths AS (SELECT lo, hi, (hi - lo) / (log2(n) + 1) AS a, 2 * iqr / power(n, 1 / 3.0::DOUBLE) AS b FROM few)
        SELECT ceil((hi - lo) / (CASE WHEN b > 0 THEN least(a, b) ELSE a END))::BIGINT AS n_bins, 20::BIGINT AS n FROM widths""",
)
def f1_auto_histogram(spark, sf_dir):
    """Bins and values of the F1 histogram without a stated number of bins."""
    one = materialise(_metrics(spark, sf_dir, 20).where(F.col("experiment") == "res_title"), "metrics")
    return metrics.histogram(one, "f1").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n"))


@query(
    "a10b_f1_histogram",
    f"""WITH {V.sql_metrics(20)}, one AS (SELECT f1 FROM metrics WHERE experiment = 'res_title'),
        span AS (SELECT min(f1) AS lo, max(f1) AS hi, 6 AS k FROM one),
        binned AS (SELECT least(floor((f1 - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS n
                   FROM one, span GROUP BY 1),
        frame AS (SELECT unnest(range(0, k)) AS bin, lo AS low, (hi - lo) / k AS w FROM span)
        SELECT frame.bin, round(low + frame.bin * w, 6) AS lo, round(low + (frame.bin + 1) * w, 6) AS hi,
               coalesce(n, 0) AS n
        FROM frame LEFT JOIN binned ON frame.bin = binned.bin""",
)
def f1_histogram(spark, sf_dir):
    # The range and the bins read their input once each: write it first.
    one = materialise(_metrics(spark, sf_dir, 20).where(F.col("experiment") == "res_title"), "metrics")
    return _rounded(metrics.histogram(one, "f1", bins=6), "lo", "hi")


_BOX = ((0.025, "p2_5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.975, "p97_5"))
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in report.DISPLAY_NAMES.items())


@query(
    "a11_boxplot",
    f"""WITH {V.sql_metrics(20)}, names(name, display) AS (VALUES {_NAMES}),
        box AS (SELECT experiment, {', '.join(f'round(100 * quantile_cont(f1, {q}), 6) AS {n}' for q, n in _BOX)}
                FROM metrics GROUP BY experiment)
        SELECT coalesce(display, experiment) AS experiment, {', '.join(n for _, n in _BOX)}
        FROM box LEFT JOIN names ON experiment = name ORDER BY p50""",
)
def boxplot(spark, sf_dir):
    return _rounded(report.boxplot_table(_metrics(spark, sf_dir, 20)), *[n for _, n in _BOX])


@query(
    "a12_doc_frequency",
    f"""WITH {V.SQL_TOKENS}, {V.sql_splits(3)},
        seen AS (SELECT DISTINCT round, s.pmid, unnest(tokens) AS token
                 FROM splits s JOIN tokens t ON s.pmid = t.pmid WHERE split = 'train')
        SELECT round, token, count(*) AS df FROM seen GROUP BY round, token HAVING count(*) >= 2""",
)
def doc_frequency(spark, sf_dir):
    return features.training_frequency(V.split_tokens(spark, sf_dir, 3), 3, min_df=2)


@query(
    "a13_term_counts",
    f"""WITH {V.SQL_TOKENS}, t AS (SELECT pmid, unnest(tokens) AS token FROM tokens)
        SELECT pmid, token, count(*) AS n FROM t GROUP BY pmid, token""",
)
def term_counts(spark, sf_dir):
    return features.term_counts(V.tokens(spark, sf_dir))


@query(
    "a14_vector_pooling",
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
            p AS (SELECT label, pos, avg(v) AS mean, max(v) AS mx, min(v) AS mn FROM x GROUP BY label, pos),
            l AS (SELECT label, pos - 1 AS pos, mean AS v FROM p UNION ALL SELECT label, 64 + pos - 1, mx FROM p
                  UNION ALL SELECT label, 128 + pos - 1, mn FROM p)
       SELECT label, pos::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM l""",
)
def vector_pooling(spark, sf_dir):
    pooled = pooling.pool_vectors(V.table(spark, sf_dir, "embeddings"), "label")
    return pooled.select("label", F.posexplode("pooled").alias("pos", "v")).withColumn(
        "v", F.round("v", 6) + F.lit(0.0)
    )


# Parameter sets of a small grid: which rule to apply is the parameter.
_GRID = ("other_rule", "res_abstract", "res_all", "res_mesh", "res_optimal", "res_title")
FOLD_SQL = f"""{V.SQL_LABELS},
  ranked AS (SELECT pmid, label, row_number() OVER (PARTITION BY label
               ORDER BY md5('{splits.BASE_SEED}:' || pmid::VARCHAR), pmid) AS rk FROM labels_v),
  folds AS (SELECT pmid, label, ((rk - 1) % 5)::INTEGER AS fold FROM ranked)"""


def _fold_scores(spark, sf_dir):
    folds = splits.stratified_folds(V.labels(spark, sf_dir), 5)
    hits = records(V.rule_hits(spark, sf_dir), ["pmid"], "hits", "experiment")
    said = F.when(F.col("hit"), V.POSITIVE).otherwise(V.NEGATIVE)
    scored = folds.join(hits, "pmid").withColumn("prediction", said)
    order = F.array_position(F.array(*map(F.lit, _GRID)), F.col("experiment"))
    return metrics.binary_metrics(scored, ["experiment", "fold"]).withColumn("param_order", order)


@query(
    "a15_best_params",
    f"""WITH {FOLD_SQL}, {V.sql_hits()},
        predictions AS (SELECT experiment, fold, label,
                               CASE WHEN hit THEN '{V.POSITIVE}' ELSE '{V.NEGATIVE}' END AS prediction
                        FROM folds JOIN hits ON folds.pmid = hits.pmid),
        counted AS (SELECT experiment, fold, {V.SQL_COUNTS} FROM predictions GROUP BY experiment, fold),
        metrics AS (SELECT *, {V.SQL_PRF} FROM counted),
        means AS (SELECT experiment, avg(f1) AS mean_score FROM metrics GROUP BY experiment)
        SELECT experiment, round(mean_score, 6) AS mean_score FROM means
        ORDER BY mean_score DESC, list_position([{V.in_list(_GRID)}], experiment) LIMIT 1""",
)
def best_params(spark, sf_dir):
    return _rounded(metrics.best_params(_fold_scores(spark, sf_dir), ["experiment"]), "mean_score")


@query(
    "a16_feature_count",
    f"""WITH {V.SQL_TOKENS}, t AS (SELECT DISTINCT pmid, unnest(tokens) AS token FROM tokens),
        v AS (SELECT token FROM t GROUP BY token HAVING count(*) >= 2),
        a AS (SELECT count(*) AS n_terms FROM v),
        b AS (SELECT max(len(embedding))::BIGINT AS n_vector FROM embeddings)
        SELECT n_terms, n_vector, n_terms + n_vector AS n_features FROM a, b""",
)
def feature_count(spark, sf_dir):
    vocabulary = features.document_frequency(V.tokens(spark, sf_dir), min_df=2)
    return features.feature_count(vocabulary, V.table(spark, sf_dir, "embeddings"))


@query("w1_stratified_split", f"WITH {V.sql_splits(ROUNDS)} SELECT round, pmid, label, split FROM splits")
def stratified_split(spark, sf_dir):
    return splits.holdout_splits(V.labels(spark, sf_dir), ROUNDS)


@query("w2_stratified_folds", f"WITH {FOLD_SQL} SELECT pmid, label, fold FROM folds")
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(V.labels(spark, sf_dir), 5)


@query(
    "w3_running_median",
    f"""WITH {V.sql_metrics(20)}
        SELECT experiment, round, round(f1, 6) AS f1,
               round(quantile_cont(f1, 0.5) OVER (PARTITION BY experiment ORDER BY round
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS f1_running_median
        FROM metrics""",
)
def running_median(spark, sf_dir):
    out = metrics.running_median(_metrics(spark, sf_dir, 20).select("experiment", "round", "f1"))
    return _rounded(out, "f1", "f1_running_median")


# Iteration i of the early-stopping query applies the first i words.
_STEPS = ("loser", "that", "idiot", "clown", "moron", "worthless", "scum", "pathetic", "the", "hend", "und", "tion")
_PATIENCE = 3


@query(
    "w4_best_iteration",
    f"""WITH RECURSIVE {V.SQL_TOKENS}, {V.sql_splits(4)},
        steps AS (SELECT i, [{V.in_list(_STEPS)}][1:i] AS words FROM range(1, {len(_STEPS) + 1}) s(i)),
        predictions AS (SELECT round, i AS iteration, label,
                          CASE WHEN list_has_any(tokens, words) THEN '{V.POSITIVE}' ELSE '{V.NEGATIVE}' END AS prediction
                        FROM splits JOIN tokens ON splits.pmid = tokens.pmid, steps WHERE split = 'val'),
        counted AS (SELECT round, iteration, {V.SQL_COUNTS} FROM predictions GROUP BY round, iteration),
        scores AS (SELECT round, iteration, 1.0 - f1 AS err FROM (SELECT *, {V.SQL_PRF} FROM counted)),
        walk AS (
          SELECT round, iteration, err AS low, iteration AS best, false AS stopped FROM scores WHERE iteration = 1
          UNION ALL
          SELECT s.round, s.iteration, least(low, err), CASE WHEN err < low THEN s.iteration ELSE best END,
                 s.iteration - CASE WHEN err < low THEN s.iteration ELSE best END >= {_PATIENCE}
          FROM walk w JOIN scores s ON s.round = w.round AND s.iteration = w.iteration + 1 WHERE NOT w.stopped)
        SELECT round, arg_max(best, iteration)::INTEGER AS best_iteration FROM walk GROUP BY round""",
)
def best_iteration(spark, sf_dir):
    first_hit = F.array_min(
        F.array(
            *[F.when(F.array_contains("tokens", w), F.lit(i)) for i, w in enumerate(_STEPS, 1)]
        )
    )
    docs = V.split_tokens(spark, sf_dir, 4).select(
        "label", first_hit.alias("first_hit"), splits.rounds_of("val").alias("_rounds")
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(_STEPS)))).alias("iteration")
    scored = elements(docs, ["label", "first_hit"], "_rounds", "round").select("*", steps)
    hit = F.coalesce(F.col("first_hit") <= F.col("iteration"), F.lit(False))
    scored = scored.withColumn("prediction", F.when(hit, V.POSITIVE).otherwise(V.NEGATIVE))
    scores = metrics.binary_metrics(scored, ["round", "iteration"]).select(
        "round", "iteration", (F.lit(1.0) - F.col("f1")).alias("err")
    )
    return metrics.best_iteration(scores, _PATIENCE)


@query(
    "o2_hardest_docs",
    f"""WITH {V.sql_predictions(ROUNDS, experiments=("res_mesh",))},
        done AS (SELECT pmid, count(*) AS times_test, sum((label = prediction)::INTEGER)::BIGINT AS times_correct
                 FROM predictions GROUP BY pmid),
        t AS (SELECT l.pmid, label, coalesce(times_correct, 0) AS times_correct, coalesce(times_test, 0) AS times_test,
                     100.0::DOUBLE * times_correct / times_test AS pct FROM labels_v l LEFT JOIN done ON l.pmid = done.pmid)
        SELECT pmid, label, times_correct, times_test, round(pct, 6) AS pct FROM t
        ORDER BY t.pct ASC NULLS LAST, pmid LIMIT 20""",
)
def hardest_docs(spark, sf_dir):
    scored = rows.with_correct(V.predictions(spark, sf_dir, ROUNDS, experiments=("res_mesh",)))
    return _rounded(report.hardest_docs(metrics.doc_tally(V.labels(spark, sf_dir), scored), 20), "pct")


@query(
    "o3_leaderboard",
    f"""WITH {_sql_summary(20)}
        SELECT row_number() OVER (ORDER BY f1_mid DESC, f1_lo DESC, f1_hi DESC, experiment)::INTEGER AS place,
               experiment, {_TEXTS}, round(f1_hi - f1_lo, 6) AS iqv, f1_mid AS f1 FROM summary""",
)
def leaderboard(spark, sf_dir):
    board = report.leaderboard(report.interval_summary(_metrics(spark, sf_dir, 20)))
    place = F.row_number().over(report.leaderboard_order())  # one row per experiment
    return board.select(
        place.alias("place"), "experiment", *[f"{m}_text" for m in SHOW], "iqv", F.col("f1_mid").alias("f1")
    )


@query(
    "o5_head",
    f"WITH {V.SQL_CORPUS} SELECT pmid, title, journal FROM corpus ORDER BY pmid LIMIT 6",
)
def head(spark, sf_dir):
    return rows.head(V.corpus(spark, sf_dir).select("pmid", "title", "journal"), [F.asc("pmid")], 6)


@query(
    "t18_interval_text",
    f"""WITH {_sql_summary(20)}
        SELECT experiment, printf('%.1f (%.1f,%.1f)', f1_mid, f1_lo, f1_hi) AS f1_text, f1_mid AS f1 FROM summary""",
)
def interval_texts(spark, sf_dir):
    """Rendered, then read back from the text."""
    summary = report.interval_summary(_metrics(spark, sf_dir, 20))
    text = interval_text("f1_mid", "f1_lo", "f1_hi")
    return summary.select("experiment", text.alias("f1_text")).withColumn("f1", leading_number("f1_text"))


@query(
    "u1_stack_results",
    f"""WITH {V.sql_metrics(3)}
        SELECT experiment, round, tp, fp, fn, tn FROM metrics WHERE experiment IN ('res_title', 'res_abstract', 'res_all')""",
)
def stack_results(spark, sf_dir):
    """Each experiment evaluated on its own, tables stacked by name; the predictions are written once."""
    names = ("res_title", "res_abstract", "res_all")
    said = materialise(V.predictions(spark, sf_dir, 3, experiments=names), "predictions")
    parts = [
        metrics.binary_metrics(said.where(F.col("experiment") == e), ["experiment", "round"]).select(
            "experiment", "round", "tp", "fp", "fn", "tn"
        )
        for e in names
    ]
    return report.stack_results(*parts)
