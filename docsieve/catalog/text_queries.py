"""Text, list and vector functions, feature weights and preprocessing."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import concat_vectors, slice_vector, vector_entries
from ..functions.token_rules import replace_tokens
from ..operators import abbreviations, features, phrases, pooling
from ..operators.expand import records
from ..plans import model as M
from ..plans import preprocess as P
from ..session import materialise
from . import views as V
from .porter_sql import stem_ctes
from .registry import query

# --- SQL twins of the token expressions ------------------------------------
STRIP = r"regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')"


def sql_clean(tokens: str) -> str:
    return rf"""flatten(list_transform({tokens}, lambda t: CASE
      WHEN NOT regexp_matches(t, '\d') THEN [t]
      WHEN regexp_matches({STRIP}, '^\d') THEN list_transform(regexp_extract_all({STRIP}, '\p{{L}}+|\d+'),
           lambda x: CASE WHEN regexp_matches(x, '^\d') THEN '##' ELSE x END)
      ELSE [{STRIP}] END))"""


def sql_full(col: str) -> str:
    return rf"""list_filter(list_transform(string_split_regex({col}, '[\s\p{{Z}}]+'),
      lambda t: regexp_replace(t, '^\p{{P}}+|\p{{P}}+$', '', 'g')), lambda t: t <> '')"""


def sql_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: lower(t) NOT IN ({V.in_list(V.STOP_WORDS)}))"


def sql_mask(tokens: str) -> str:
    return f"""list_transform({tokens}, lambda t: CASE WHEN lower(t) IN ({V.in_list(V.LEXICON)})
      THEN '{T.MASK}' ELSE lower(t) END)"""


def sql_suffix(tokens: str, field: str) -> str:
    return f"list_transform({tokens}, lambda t: t || '{T.FIELD_SUFFIX[field]}')"


def sql_list_field(field: str) -> str:
    return f"""list_transform(string_split({field}, ';'), lambda x: CASE WHEN x = '' THEN ''
      ELSE trim(x, ' ' || chr(9) || chr(10) || chr(13)) || '{T.FIELD_SUFFIX[field]}' END)"""


def sql_grams(tokens: str, n: int) -> str:
    words = " || ' ' || ".join(f"{tokens}[i + {j}]" for j in range(n))
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {words})"


def sql_ngrams(tokens: str, n: int) -> str:
    parts = ", ".join([tokens] + [sql_grams(tokens, k) for k in range(2, n + 1)])
    return tokens if n == 1 else f"CASE WHEN len({tokens}) >= {n} THEN list_concat({parts}) ELSE {tokens} END"


def joined(tokens: str) -> str:
    return f"array_to_string({tokens}, '{T.SEPARATOR}')"


# Every metadata field, derived from the given columns.
META = {
    "author": ("concat('A', lang, '; B', source, ';')", "'A' || lang || '; B' || source || ';'"),
    "affiliation": ("concat('Dept ', source, ' ; ')", "'Dept ' || source || ' ; '"),
    "chemical_list": ("if(n_chars % 2 = 0, '', concat(lang, ';', lang))",
                      "CASE WHEN n_chars % 2 = 0 THEN '' ELSE lang || ';' || lang END"),
    "keywords": ("concat(lang, ';', source)", "lang || ';' || source"),
    "medline_ta": ("if(n_chars % 3 = 0, '', source)", "CASE WHEN n_chars % 3 = 0 THEN '' ELSE source END"),
    "mesh_terms": ("concat('M', n_chars % 10, '; ', source)", "'M' || (n_chars % 10)::VARCHAR || '; ' || source"),
}
SQL_FULL_CORPUS = f"""{V.SQL_CORPUS},
  wide AS (SELECT c.*, {', '.join(f'{sql} AS {name}' for name, (_, sql) in META.items())}
           FROM corpus c JOIN documents d ON c.pmid = d.doc_id)"""


def full_corpus(spark, sf_dir):
    """The corpus with all nine fields."""
    cut = F.instr("text", "\n")
    docs = V.documents(spark, sf_dir)
    return docs.select(
        F.col("doc_id").alias("pmid"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(cut > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise("").alias("abstract"),
        F.concat(F.lit("L:"), "lang", F.lit("; S:"), "source").alias("publication_types"),
        *[F.expr(expr).alias(name) for name, (expr, _) in META.items()],
    )


def _text(spark, sf_dir):
    return V.documents(spark, sf_dir).select(F.col("doc_id").alias("pmid"), "text")


@query("t1_tokenize", f"WITH {V.SQL_TOKENS} SELECT pmid, array_to_string(tokens, ' ') AS tokens FROM tokens")
def tokenize(spark, sf_dir):
    return _text(spark, sf_dir).select("pmid", F.array_join(T.tokenize("text"), " ").alias("tokens"))


@query("t1_full_mode", f"SELECT doc_id AS pmid, array_to_string({sql_full('text')}, ' ') AS tokens FROM documents")
def tokenize_full(spark, sf_dir):
    return _text(spark, sf_dir).select("pmid", F.array_join(T.tokenize("text", "full"), " ").alias("tokens"))


@query(
    "t1b_stopwords",
    f"WITH {V.SQL_TOKENS} SELECT pmid, array_to_string({sql_stop('tokens')}, ' ') AS tokens FROM tokens",
)
def stopwords(spark, sf_dir):
    kept = T.drop_stopwords("tokens", V.STOP_WORDS)
    return V.tokens(spark, sf_dir).select("pmid", F.array_join(kept, " ").alias("tokens"))


@query(
    "t4_number_cleanup",
    f"""WITH f AS (SELECT doc_id AS pmid, {sql_full('text')} AS tokens FROM documents)
        SELECT pmid, array_to_string({sql_clean('tokens')}, ' ') AS tokens FROM f""",
)
def number_cleanup(spark, sf_dir):
    full = _text(spark, sf_dir).select("pmid", T.tokenize("text", "full").alias("tokens"))
    return full.select("pmid", F.array_join(replace_tokens("tokens"), " ").alias("tokens"))


_COUNTED = f"""{V.SQL_TOKENS},
  counted AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token)"""


@query(
    "t6_stem_rollup",
    f"""WITH {_COUNTED}, {stem_ctes('counted')}
        SELECT stem, count(*) AS n_forms, sum(n)::BIGINT AS n FROM stemmed GROUP BY stem""",
)
def stem_rollup(spark, sf_dir):
    return features.stem_rollup(V.tokens(spark, sf_dir))


@query("t6b_stem_vocabulary", f"WITH {_COUNTED}, {stem_ctes('counted')} SELECT token, stem FROM stemmed")
def stem_vocabulary(spark, sf_dir):
    return features.stem_vocabulary(V.tokens(spark, sf_dir))


@query(
    "t7_field_suffix",
    f"""WITH {V.SQL_CORPUS} SELECT pmid, array_to_string({sql_suffix(V.sql_words('title'), 'title')}, ' ') AS title,
               array_to_string({sql_suffix(V.sql_words('abstract'), 'abstract')}, ' ') AS abstract,
               array_to_string({sql_suffix(V.sql_words('journal'), 'keywords')}, ' ') AS keywords FROM corpus""",
)
def field_suffix(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "pmid",
        F.array_join(T.suffix(T.tokenize("title"), "title"), " ").alias("title"),
        F.array_join(T.suffix(T.tokenize("abstract"), "abstract"), " ").alias("abstract"),
        F.array_join(T.suffix(T.tokenize("journal"), "keywords"), " ").alias("keywords"),
    )


def _sql_gram_query(n: int) -> str:
    return f"""WITH {V.SQL_CORPUS}, s AS (SELECT pmid, {sql_suffix(V.sql_words('title'), 'title')} AS t,
               {sql_suffix(V.sql_words('abstract'), 'abstract')} AS a FROM corpus)
        SELECT pmid, {joined(sql_ngrams('t', n))} AS title, {joined(sql_ngrams('a', n))} AS abstract FROM s"""


def _gram_query(spark, sf_dir, n):
    fields = ("title", "abstract")
    texts = V.corpus(spark, sf_dir).select("pmid", *[T.suffix(T.tokenize(f), f).alias(f) for f in fields])
    return texts.select("pmid", *[T.join_tokens(T.ngrams(f, n)).alias(f) for f in fields])


@query("t8_bigrams", _sql_gram_query(2))
def bigrams(spark, sf_dir):
    return _gram_query(spark, sf_dir, 2)


@query("t8b_trigrams", _sql_gram_query(3))
def trigrams(spark, sf_dir):
    return _gram_query(spark, sf_dir, 3)


@query(
    "t9_join_split",
    f"""WITH {V.SQL_TOKENS}, j AS (SELECT pmid, {joined('tokens')} AS bow FROM tokens)
        SELECT pmid, bow, len(string_split(bow, '{T.SEPARATOR}'))::INTEGER AS n_tokens,
               string_split(bow, '{T.SEPARATOR}')[-1] AS last_token FROM j""",
)
def join_split(spark, sf_dir):
    stored = V.tokens(spark, sf_dir).select("pmid", T.join_tokens("tokens").alias("bow"))
    back = stored.withColumn("_t", T.split_tokens("bow"))
    return back.select("pmid", "bow", F.size("_t").alias("n_tokens"), F.element_at("_t", -1).alias("last_token"))


@query(
    "t10_list_field",
    f"""WITH per_user AS (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '; ')
                                 || CASE WHEN user_id % 2 = 0 THEN ';' ELSE '' END AS mesh_terms
                          FROM events GROUP BY user_id)
        SELECT user_id, {joined(sql_list_field('mesh_terms'))}
               AS items FROM per_user""",
)
def list_field(spark, sf_dir):
    """Event kinds per user play a multi-valued field; some end in ``;``."""
    kinds = F.concat(
        F.array_join(F.sort_array(F.collect_set("event_type")), "; "),
        F.when(F.col("user_id") % 2 == 0, ";").otherwise(""),
    )
    per_user = V.table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("kinds"))
    return per_user.select("user_id", T.join_tokens(T.list_field("kinds", "mesh_terms")).alias("items"))


@query(
    "t11_scalar_suffix",
    f"WITH {SQL_FULL_CORPUS} SELECT pmid, medline_ta || 'J' AS journal FROM wide",
)
def scalar_suffix(spark, sf_dir):
    return full_corpus(spark, sf_dir).select("pmid", T.scalar_field("medline_ta", "medline_ta").alias("journal"))


@query(
    "t13_bag_and_text",
    f"""WITH {SQL_FULL_CORPUS}, f AS (SELECT pmid, title, abstract, {sql_list_field('mesh_terms')} AS m,
                {sql_list_field('publication_types')} AS p FROM wide)
        SELECT pmid, {joined("list_filter(list_concat(m, p), lambda t: t <> '')")} AS bow, title, abstract FROM f""",
)
def bag_and_text(spark, sf_dir):
    docs = full_corpus(spark, sf_dir)
    lists = docs.select(
        "pmid", "title", "abstract",
        *[T.list_field(f, f).alias(f) for f in ("mesh_terms", "publication_types")],
    )
    out = P.bag_and_text(lists, ["mesh_terms", "publication_types"], ["title", "abstract"])
    return out.select("pmid", T.join_tokens("tokens").alias("bow"), "title", "abstract")


def _sql_sentences(field: str) -> str:
    return rf"""SELECT pmid, '{field}' AS field, list_filter(list_transform(
            regexp_extract_all({field}, '(?s).+?(?:[.!?]+(?:[ \t\n\f\r]+|\z)|\z)'),
            lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS parts FROM corpus"""


@query(
    "t14_sentences",
    f"""WITH {V.SQL_CORPUS}, s AS ({_sql_sentences('title')} UNION ALL {_sql_sentences('abstract')})
        SELECT pmid, field, (unnest(range(1, len(parts) + 1)) - 1)::INTEGER AS sentence_no, unnest(parts) AS sentence FROM s""",
)
def sentence_table(spark, sf_dir):
    docs = V.corpus(spark, sf_dir)
    title, abstract = (features.sentences_table(docs, f).withColumn("field", F.lit(f)) for f in ("title", "abstract"))
    return title.unionByName(abstract)


@query(
    "t15_vector_slice",
    "SELECT vec_id AS pmid, (unnest(range(0, 16)))::INTEGER AS pos, unnest(embedding[1:16])::DOUBLE AS v FROM embeddings",
)
def vector_slice(spark, sf_dir):
    part = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pmid"), F.posexplode(slice_vector("embedding", 16)).alias("pos", "v")
    )
    return part.withColumn("v", F.col("v").cast("double"))


@query(
    "t16_vector_concat",
    f"""WITH {V.SQL_VECTORS}, c AS (SELECT pmid, list_concat(abstracts_embedded, titles_embedded) AS e FROM vectors)
        SELECT pmid, (unnest(range(0, 64)))::INTEGER AS pos, unnest(e)::DOUBLE AS v FROM c""",
)
def vector_concat(spark, sf_dir):
    whole = V.vectors(spark, sf_dir).select(
        "pmid", F.posexplode(concat_vectors("abstracts_embedded", "titles_embedded")).alias("pos", "v")
    )
    return whole.withColumn("v", F.col("v").cast("double"))


_LAYERED = """toks AS (SELECT label AS doc, vec_id // 16 AS sentence, vec_id AS tok, embedding FROM embeddings),
  edged AS (SELECT doc, sentence, embedding, (row_number() OVER s - 1)::INTEGER AS tok, count(*) OVER t AS n FROM toks
            WINDOW s AS (PARTITION BY doc, sentence ORDER BY tok), t AS (PARTITION BY doc, sentence)),
  summed AS (SELECT doc, sentence, tok, p AS pos, embedding[1 + p]::DOUBLE + embedding[17 + p]::DOUBLE
                    + embedding[33 + p]::DOUBLE + embedding[49 + p]::DOUBLE AS v
             FROM edged, range(0, 16) r(p) WHERE tok > 0 AND tok < n - 1)"""


def _layered(spark, sf_dir):
    """16-wide slices of a vector play four layers; blocks of 16 ids play sentences."""
    slices = F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)])
    tokens = V.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc"), F.expr("vec_id div 16").alias("sentence"),
        F.struct(F.col("vec_id").alias("tok"), slices.alias("layers")).alias("token"),
    )
    listed = F.sort_array(F.collect_list("token"))  # 16 ids at most
    sentences = tokens.groupBy("doc", "sentence").agg(F.transform(listed, lambda t: t["layers"]).alias("layers"))
    return pooling.token_vectors(sentences, n=4)


@query(
    "t17_layer_sum",
    f"WITH {_LAYERED} SELECT doc, sentence, tok, pos::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM summed",
)
def layer_sum(spark, sf_dir):
    out = _layered(spark, sf_dir).select("doc", "sentence", "tok", F.posexplode("vec").alias("pos", "v"))
    return out.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(
    "t17b_sentence_pooling",
    f"""WITH {_LAYERED} SELECT doc, pos::INTEGER AS pos, round(avg(v), 6) + 0.0 AS v FROM summed GROUP BY doc, pos""",
)
def sentence_pooling(spark, sf_dir):
    """Token vectors of all sentences pooled to one vector per document."""
    pooled = pooling.pool_vectors(_layered(spark, sf_dir), "doc", "vec", maxmin=False)
    return pooled.select("doc", F.posexplode("pooled").alias("pos", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))


RUNS = {**P.FIELD_RUNS, **P.NGRAM_RUNS}


def _sql_run(name: str) -> str:
    fields, n = RUNS[name]
    parts = ", ".join(sql_ngrams(f"f_{f}", n) if f in T.TEXT_FIELDS else f"f_{f}" for f in fields)
    whole = f"list_concat({parts})" if len(fields) > 1 else parts
    return f"SELECT '{name}' AS run, pmid, list_filter({whole}, lambda t: t <> '') AS bag FROM lists"


def _sql_field(f: str) -> str:
    if f in T.TEXT_FIELDS:
        return f"coalesce((SELECT bag FROM stemmed_fields s WHERE s.pmid = wide.pmid AND field = '{f}'), []) AS f_{f}"
    return f"[{f} || 'J'] AS f_{f}" if f in T.SCALAR_FIELDS else f"{sql_list_field(f)} AS f_{f}"


def _sql_cleaned(f: str) -> str:
    tokens = sql_clean(sql_mask(sql_stop(sql_full(f))))
    return f"SELECT pmid, '{f}' AS field, '{T.FIELD_SUFFIX[f]}' AS mark, {tokens} AS tokens FROM wide"


# The whole text path: tokens in their places, stemmed by the SQL rules, back in order with their suffix.
_LISTS = f"""cleaned AS ({' UNION ALL '.join(map(_sql_cleaned, T.TEXT_FIELDS))}),
  placed AS (SELECT pmid, field, mark, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cleaned),
  counted AS (SELECT token, count(*) AS n FROM placed GROUP BY token), {stem_ctes('counted')},
  stemmed_fields AS (SELECT pmid, field, list(stem || mark ORDER BY pos) AS bag
                     FROM placed JOIN stemmed ON placed.token = stemmed.token GROUP BY pmid, field),
  lists AS (SELECT pmid, {', '.join(_sql_field(f) for f in P.run_fields(RUNS))} FROM wide)"""


@query(
    "t19_run_matrix",
    f"""WITH {SQL_FULL_CORPUS}, {_LISTS}, runs AS ({' UNION ALL '.join(_sql_run(r) for r in RUNS)})
        SELECT run, pmid, len(bag)::INTEGER AS n_tokens, md5({joined('bag')}) AS bow_md5 FROM runs""",
)
def run_matrix(spark, sf_dir):
    lists = P.field_tokens(full_corpus(spark, sf_dir), P.run_fields(RUNS), V.STOP_WORDS, V.LEXICON)
    return P.run_matrix(lists, RUNS, made={"n_tokens": F.size, "bow_md5": lambda tokens: F.md5(T.join_tokens(tokens))})


@query(
    "u2_field_union",
    f"""WITH {SQL_FULL_CORPUS}, f AS (SELECT pmid, {sql_suffix(V.sql_words('title'), 'title')} AS t,
                {V.sql_words('abstract')} AS a, {sql_list_field('keywords')} AS k FROM wide)
        SELECT pmid, {joined('list_concat(t, a, k)')} AS bow FROM f""",
)
def field_union(spark, sf_dir):
    lists = full_corpus(spark, sf_dir).select(
        "pmid", T.suffix(T.tokenize("title"), "title").alias("title"), T.tokenize("abstract").alias("abstract"),
        T.list_field("keywords", "keywords").alias("keywords"),
    )
    out = P.combine_fields(lists, ["title", "abstract", "keywords"])
    return out.select("pmid", T.join_tokens("tokens").alias("bow"))


@query(
    "m2_l1_tf",
    f"""WITH {V.SQL_TOKENS}, t AS (SELECT pmid, unnest(tokens) AS token FROM tokens),
        c AS (SELECT pmid, token, count(*) AS n FROM t GROUP BY pmid, token)
        SELECT pmid, token, round(n / (sum(n) OVER (PARTITION BY pmid))::DOUBLE, 6) AS weight FROM c""",
)
def l1_tf(spark, sf_dir):
    return features.l1_frequency(V.tokens(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    "m3_idf_l1",
    f"""WITH {V.SQL_TOKENS}, {V.sql_splits(2)},
        t AS (SELECT round, split, s.pmid, unnest(tokens) AS token FROM splits s JOIN tokens t ON s.pmid = t.pmid),
        vocab AS (SELECT round, token, count(DISTINCT pmid) AS df FROM t WHERE split = 'train'
                  GROUP BY round, token HAVING count(DISTINCT pmid) >= 2),
        size AS (SELECT round, count(*) AS n_docs FROM splits WHERE split = 'train' GROUP BY round),
        c AS (SELECT round, pmid, token, count(*) AS n FROM t WHERE split = 'val' GROUP BY round, pmid, token),
        raw AS (SELECT c.round, pmid, c.token, n * (ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1) AS w
                FROM c JOIN vocab v ON c.round = v.round AND c.token = v.token JOIN size ON size.round = c.round)
        SELECT round, pmid, token, round(w / sum(w) OVER (PARTITION BY round, pmid), 6) AS weight FROM raw""",
)
def idf_l1(spark, sf_dir):
    """Vocabulary and IDF from each round's training part, weights of its validation
    part, as the shipped encoder gives them; its sparse vectors are unfolded."""
    docs = materialise(V.split_tokens(spark, sf_dir, 2), "split-tokens")
    params, out = M.TreeParams(min_df=2, use_idf=True), []
    found = features.training_frequency(docs, 2, params.min_df).join(features.round_sizes(docs), "round")
    terms = materialise(found, "holdout-terms", partition_by="round")
    for i in range(2):
        part = docs.withColumn("split", F.get("splits", F.lit(i))["split"])
        stages = M.term_encoder(terms.where(F.col("round") == i), params) or M.encoder([], [], params)
        encoded = PipelineModel(stages).transform(part.where("split = 'val'"))
        out.append(unfold_terms(encoded, stages[0].vocabulary).withColumn("round", F.lit(i)))
    return out[0].unionByName(out[1]).withColumn("weight", F.round("weight", 6))


def unfold_terms(encoded, vocabulary):
    """(pmid, token, weight) of the non-zero term weights."""
    items = records(encoded, ["pmid"], vector_entries("term_weights"), "place").where("value <> 0")
    # Written, so that its size is known and the entries need not be shuffled for a small one.
    words = materialise(encoded.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, token string"), "words")
    return items.join(words, "place").select("pmid", "token", F.col("value").alias("weight"))


@query(
    "m13_preprocess",
    f"""WITH {SQL_FULL_CORPUS}, {_LISTS}, runs AS ({_sql_run('bigrams')})
        SELECT pmid, {joined('bag')} AS bow FROM runs""",
)
def preprocess(spark, sf_dir):
    bags = P.preprocess(full_corpus(spark, sf_dir), P.OPTIMAL, 2, V.STOP_WORDS, V.LEXICON)
    return bags.select("pmid", T.join_tokens("tokens").alias("bow"))


_PHRASES = ("the thing", "the", "of the", "und der die", "der die", "that the", "he was", "en la")


@query(
    "j7b_phrase_mask",
    f"""WITH {V.SQL_TOKENS} SELECT pmid, trim(replace(regexp_replace('  ' || array_to_string(tokens, '  ') || '  ',
           ' ({'|'.join(sorted((p.replace(' ', '  ') for p in _PHRASES), key=len, reverse=True))}) ', ' {T.MASK} ', 'g'), '  ', ' ')) AS tokens
        FROM tokens""",
)
def phrase_mask(spark, sf_dir):
    """A lexicon of words and phrases, the longest first, in one pass over the tokens."""
    lexicon = spark.createDataFrame([(p,) for p in _PHRASES], "phrase string")
    return phrases.mask_phrases(V.tokens(spark, sf_dir), lexicon).select("pmid", F.array_join("tokens", " ").alias("tokens"))


_CORES = r"""list_filter(list_transform(regexp_split_to_array(text, '[\s\p{Z}]+'),
  lambda p: lower(regexp_replace(p, '^[^\p{L}\d]+|[^\p{L}\d.]+$', '', 'g'))), lambda c: regexp_matches(c, '\p{L}') AND NOT regexp_matches(c, '\d'))"""


@query(
    "t14b_abbreviation_scores",
    rf"""WITH cores AS (SELECT unnest({_CORES}) AS core FROM documents),
        counted AS (SELECT regexp_replace(core, '\.+$', '') AS word, count(*) FILTER (core LIKE '%.') AS n_with,
                           count(*) FILTER (core NOT LIKE '%.') AS n_without FROM cores GROUP BY 1),
        total AS (SELECT sum(n_with)::DOUBLE / sum(n_with + n_without) AS p FROM counted),
        measured AS (SELECT word, n_with, n_without, length(replace(word, '.', '')) AS letters,
                            2 * (n_with * ln(0.99) + n_without * ln(1 - 0.99) - n_with * ln(p) - n_without * ln(1 - p)) AS ratio
                     FROM counted, total WHERE n_with > 0)
        SELECT word, n_with, n_without,
               round(ratio * exp(-letters) * (length(word) - letters + 1) * pow(letters::DOUBLE, -n_without), 6) + 0.0 AS score FROM measured""",
)
def abbreviation_scores(spark, sf_dir):
    """How far each word that takes a full stop is an abbreviation, over all texts."""
    found = abbreviations.abbreviation_scores(V.documents(spark, sf_dir), "text")
    return found.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("t14c_learned_sentences")
def learned_sentences(spark, sf_dir):
    """Sentences of all texts, not cut after the abbreviations learned from them."""
    docs = V.corpus(spark, sf_dir)
    return features.sentences_table(docs, abbreviations=abbreviations.learned_abbreviations(docs, "abstract"))
