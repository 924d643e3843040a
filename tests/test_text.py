"""Golden strings of the text path, and brute-force checks of list expressions."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions import stemming
from docsieve.functions import text as T
from docsieve.functions.stemming import stem, stem_tokens
from docsieve.functions.token_rules import replace_tokens
from docsieve.plans import preprocess as P

# Sample sentences and the token strings they must give.
CANDIDA = (
    "Candida infections have increased due to the growth and expansion of susceptible patient populations."
)
CLEARANCE = "The clearance (CLz) of midazolam was 3.25l/h"


def bag(spark, texts, field, ngram=1, lexicon=(), stop=None, keep_empty=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"pmid bigint, {field} string")
    words = T.default_stop_words(spark) if stop is None else stop
    out = P.preprocess(df, [field], ngram, words, lexicon, keep_empty=keep_empty)
    return [r[0] for r in out.orderBy("pmid").select(T.join_tokens("tokens")).collect()]


def test_plain_golden(spark):
    got = bag(spark, [CANDIDA, CLEARANCE, "", None], "abstract")
    assert got == [
        "candida ;; infect ;; increas ;; growth ;; expans ;; suscept ;; patient ;; popul",
        "clearanc ;; clz ;; midazolam ;; ## ;; lh",
        "",
        "",
    ]


def test_masked_and_suffixed_golden(spark):
    assert bag(spark, [CLEARANCE], "title", lexicon=["Midazolam"]) == ["clearancT ;; clzT ;; drugnamT ;; ##T ;; lhT"]


def test_ngram_goldens(spark):
    unigrams = "candidaT infectT increasT growthT expansT susceptT patientT populT".split()
    pairs = [f"{a} {b}" for a, b in zip(unigrams, unigrams[1:])]
    assert bag(spark, [CANDIDA], "title", 2)[0].split(T.SEPARATOR) == unigrams + pairs
    one = "clearancT clzT drugnamT ##T lhT".split()
    two = [" ".join(one[i : i + 2]) for i in range(4)]
    three = [" ".join(one[i : i + 3]) for i in range(3)]
    assert bag(spark, [CLEARANCE], "title", 3, ["midazolam"])[0].split(T.SEPARATOR) == one + two + three


def test_short_lists_keep_unigrams_only(spark):
    assert bag(spark, ["liver", "liver cell"], "abstract", 3) == ["liver", "liver ;; cell"]
    assert bag(spark, ["liver", "liver cell"], "abstract", 2) == ["liver", "liver ;; cell ;; liver cell"]


def one_list(spark, tokens, expr):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "token,want",
    [
        ("4323L/min", ["##", "Lmin"]),
        ("43.23", ["##"]),
        ("l/min", ["l/min"]),
        ("cyp3a4", ["cyp3a4"]),
        ("cyp-3a4", ["cyp3a4"]),
        ("3.25l/h", ["##", "lh"]),
        ("a\nb", ["ab"]),
        ("1\n2", ["##"]),
        ("12µg7", ["##", "µg", "##"]),
    ],
)
def test_number_cleanup(spark, token, want):
    assert one_list(spark, [token], T.clean_numbers("t")) == want


def test_list_and_scalar_fields(spark):
    df = spark.createDataFrame([("A; B;",), ("",), (None,), (" ;x",)], "v string")
    lists = [r[0] for r in df.select(T.join_tokens(T.list_field("v", "mesh_terms"))).collect()]
    assert lists == ["AMSH ;; BMSH ;; ", "", "", "MSH ;; xMSH"]
    assert [r[0] for r in df.select(T.scalar_field("v", "medline_ta")).collect()] == ["A; B;J", "J", "J", " ;xJ"]


def test_unknown_field_is_refused(spark):
    df = spark.createDataFrame([(1, "x")], "pmid bigint, country string")
    with pytest.raises(ValueError, match="country"):
        P.preprocess(df, ["country"])


def test_keep_empty_reproduces_joined_strings(spark):
    df = spark.createDataFrame([(1, "", "A;B", "")], "pmid bigint, title string, keywords string, medline_ta string")
    fields = ["title", "keywords", "medline_ta"]
    kept = P.preprocess(df, fields, keep_empty=True).first()["tokens"]
    dropped = P.preprocess(df, fields).first()["tokens"]
    assert kept == ["", "AKW", "BKW", "J"] and dropped == ["AKW", "BKW", "J"]


def test_ngrams_never_cross_fields(spark):
    df = spark.createDataFrame([(1, "alpha beta", "gamma delta")], "pmid bigint, title string, abstract string")
    tokens = P.preprocess(df, ["title", "abstract"], 2, stem=False).first()["tokens"]
    assert tokens == ["alphaT", "betaT", "alphaT betaT", "gamma", "delta", "gamma delta"]


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Dose was 3.25 mg. It worked!  Did it? yes")], "pmid bigint, abstract string")
    from docsieve.operators.features import sentences_table

    got = [tuple(r) for r in sentences_table(df).orderBy("sentence_no").collect()]
    assert got == [(1, 0, "Dose was 3.25 mg."), (1, 1, "It worked!"), (1, 2, "Did it?"), (1, 3, "yes")]


def test_placeholder(spark):
    df = spark.createDataFrame([("",), (None,), ("a",)], "v string")
    assert [r[0] for r in df.select(T.placeholder_if_empty("v")).collect()] == ["xxxxx", "xxxxx", "a"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "##", "cc", "é"]), max_size=12), min_size=1, max_size=20))
def test_term_runs_count_like_a_counter(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "pmid bigint, tokens array<string>")
    got = {}
    for r in df.select("pmid", F.inline(T.term_runs("tokens"))).collect():
        got[(r["pmid"], r["token"])] = r["n"]
    want = {(i, t): n for i, d in enumerate(docs) for t, n in Counter(d).items()}
    assert got == want


@pytest.mark.parametrize(
    "word,want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("flies", "fli"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("troubled", "troubl"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("enjoy", "enjoy"),
        ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("electricity", "electr"),
        ("hopeful", "hope"), ("adoption", "adopt"), ("homologous", "homolog"), ("controlling", "control"),
        ("rate", "rate"), ("cease", "ceas"), ("dying", "die"), ("skies", "sky"), ("##", "##"), ("DRUGNAME", "drugnam"),
    ],
)
def test_stem_examples(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("stems", [False, True])
def test_token_rules_equal_the_column_path(spark, stems):
    """One step over distinct tokens gives what the expressions give token by token."""
    lists = [
        ["The", "the", "4323L/min", "43.23", "l/min", "cyp-3a4", "a\nb", "1\n2", "12µg7", "IDIOT", "Idiots", "running"], [], None,
        ["THE"], ["3.25l/h", None, "x"], ["١٢", "Ünder", "--", "a1-b2", ""], ["running"] * 40 + ["the", "1a"] * 20,
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<string>").repartition(2)
    stop, names = ["the", "A"], ["idiot"]
    plain = T.clean_numbers(T.mask_words(T.drop_stopwords("t", stop), names))
    want = df.select("i", (stem_tokens(plain) if stems else plain).alias("o"))
    got = df.select("i", replace_tokens("t", stop, names, stems=stems).alias("o"))
    # The expressions drop a NULL token with the stop words; the rules keep it.
    keep = {r.i: r.o for r in got.collect()}
    assert keep[4] == (["##", "lh", None, "x"])
    assert {i: o for i, o in keep.items() if i != 4} == {r.i: r.o for r in want.collect() if r.i != 4}
    only_low = df.select("i", replace_tokens("t", clean=False, lexicon=()).alias("o")).collect()
    assert {r.i: r.o for r in only_low}[3] == ["the"]


def test_pieces_are_trimmed_in_the_whole_text(spark):
    texts = ["(a) «b», --c--d.. ... e.\u0085f. g.\u0085", "..\u2003x!\u2028?y?", "", None, "a", "!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    each = F.filter(F.transform(F.split(T.filled("x"), r"[\s\p{Z}]+"), lambda t: F.regexp_replace(t, r"^\p{P}+|\p{P}+$", "")), lambda t: t != "")
    got = df.select(T.tokenize("x", "full").alias("g"), each.alias("w")).collect()
    assert [r.g for r in got] == [r.w for r in got] and got[2].g == []


GOLDEN_SENTENCES = [
    ("We used dr. Smith's data. It was good.", ["We used dr. Smith's data.", "It was good."]),
    ("Given i.v. (10 mg) at noon. See Lee et al. 2003. Done!", ["Given i.v. (10 mg) at noon.", "See Lee et al. 2003.", "Done!"]),
    ("Ends in approx.", ["Ends in approx."]),
    ("approx. approx. end. Next", ["approx. approx. end.", "Next"]),
    ("No stop (e.g. this).  Two\n\nspaces?  Yes.", ["No stop (e.g. this).", "Two\n\nspaces?", "Yes."]),
    ("", []),
]


@pytest.mark.parametrize("text,want", GOLDEN_SENTENCES)
def test_sentences_with_abbreviations(spark, text, want):
    found = spark.createDataFrame([(text,)], "x string").select(T.sentences("x", ["dr", "i.v", "al", "approx", "e.g"]).alias("s")).first().s
    assert found == want


def test_abbreviations_are_learned(spark):
    import math

    from docsieve.operators import abbreviations as A

    rows = ["Lee et al. found it. They took approx. ten mg.", "Smith et al. (2003) agree, e.g. here.", "It is here. They agree."] * 40
    df = spark.createDataFrame([(t,) for t in [*rows, None, "", "12.5 -- 3."]], "x string")
    got = {r.word: r for r in A.abbreviation_scores(df, "x").collect()}
    assert set(got) == {"al", "it", "approx", "mg", "e.g", "here", "agree"}
    assert (got["al"].n_with, got["al"].n_without, got["agree"].n_with, got["agree"].n_without) == (80, 0, 40, 40)
    stops, words = 80 + 40 + 40 + 40 + 40 + 80 + 40, 40 * 9 + 40 * 6 + 40 * 5  # "ten", "(2003)" and numbers aside
    words = sum(r.n_with + r.n_without for r in A.word_stops(df, "x").collect())
    p = stops / words
    ratio = 2 * (80 * math.log(0.99) - 80 * math.log(p))
    assert got["al"].score == pytest.approx(ratio * math.exp(-2))
    learned = A.learned_abbreviations(df, "x")
    assert "al" in learned and "e.g" in learned and "agree" not in learned
    with pytest.raises(ValueError, match="threshold"):
        A.MOST, before = 0, A.MOST
        try:
            A.learned_abbreviations(df, "x")
        finally:
            A.MOST = before
    assert A.learned_abbreviations(df.limit(0), "x") == []


@pytest.mark.parametrize("block", [1_000, 1])
def test_phrases_are_masked_whole(spark, block):
    from docsieve.operators.phrases import mask_phrases

    lists = [["New", "york", "city", "new", "york"], ["york"], [], None, ["a", "new", None, "york"], ["b", "a", "b", "a", "b", "c"]]
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(lists)], "i int, tokens array<string>, more array<string>").repartition(2)
    lexicon = spark.createDataFrame([(p,) for p in ("new york", "NEW York City", "a b", "b a b c", None, "", "york")], "phrase string")
    got = {r.i: (r.tokens, r.more) for r in mask_phrases(df, lexicon, ["tokens", "more"], block_tokens=block).collect()}
    want = [["DRUGNAME", "DRUGNAME"], ["DRUGNAME"], [], None, ["a", "new", None, "DRUGNAME"], ["b", "DRUGNAME", "DRUGNAME", "c"]]
    assert [got[i][0] for i in range(6)] == want == [got[i][1] for i in range(6)]
    none = mask_phrases(df, lexicon.limit(0)).select("i", "tokens").collect()
    assert {r.i: r.tokens for r in none} == dict(enumerate(lists))


def test_words_that_no_step_looks_at_skip_the_steps():
    """A word without an end that some step looks for is its own stem, and is not worked through."""
    plain = ["bezulich", "Heoka", "elleierb", "a1b2", "échê", "storan", "x", ""]
    before = stemming._stem.cache_info().misses
    assert [stemming.stem(w) for w in plain] == [w.lower() for w in plain]
    assert stemming._stem.cache_info().misses == before
    ends = ["", "s", "ies", "ied", "eed", "ing", "y", "ally", "logy", "fulness", "ization", "ement", "ll", "e", "ion", "us"]
    for word in [root + end for root in ("hop", "relat", "tr", "sk", "agr", "ha") for end in ends] + list(stemming.IRREGULAR):
        assert stemming.stem(word) == stemming._stem.__wrapped__(word)
