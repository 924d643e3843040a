"""Secret scans: sliding-window Shannon entropy over candidate strings.

Written patterns find known kinds of secrets.  Other runs of token characters are
judged by the entropy of their windows: one pass over a run keeps the count of each
character in the current window, each step changes two counts and the running sum
``c * log2(c)``.  Limits depend on the run's character class; strings that only look
random (UUIDs, placeholders, content digests, plain words) are on an allow list.

Everything stays in the row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: kind -> (pattern, a match counts only if this fits it, plain sign that a text may hold one)
PATTERNS = {
    "assign": (
        KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""",
    ),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12,}"),
    "hex": (r"[0-9a-f]{32,}", None),
}
KINDS = (*PATTERNS, "entropy")
#: Runs of token characters that the entropy test looks at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least bits a character of a window, by character class; a window of 20 holds 4.32 at most.
LIMITS = {"hex": 3.0, "mixed": 3.7}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates, or what is left of them, that only look random.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUID
    r"^[^0-9]*$",  # words
    r"^[^A-Za-z]*$",  # numbers
)
#: A candidate with one of these signs is cut at what ``COVERED`` fits; the rest of it is judged.
SIGNS = (
    r"^sha(256|384|512)-",  # content digest
    r"(?i)example|placeholder|changeme|xxxx|your[_-]",
    r"^/|/[a-z]+/|//",  # paths
    r"\x20",  # base spans, blanked
)
_WORD = r"(?:[A-Z]?[a-z]{1,15}(?:[A-Z][a-z]{2,15}){0,4}[0-9]{0,4}|[A-Z]{2,12}[0-9]{0,4}|[0-9]{1,4})"
COVERED = (
    r"\x20+",
    r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])",
    r"^sha256-(?:[0-9A-Fa-f]{64}|[A-Za-z0-9+/]{1,43}=?)",
    r"^sha384-(?:[0-9A-Fa-f]{96}|[A-Za-z0-9+/]{1,64})",
    r"^sha512-(?:[0-9A-Fa-f]{128}|[A-Za-z0-9+/]{1,86}={0,2})",
    # a placeholder with the plain words around it
    r"(?:(?<![A-Za-z0-9])[A-Za-z]{1,15}[_-]){0,4}[A-Za-z]{0,15}(?i:example|placeholder|changeme|xxxx+|your(?=[_-]))"
    r"(?:[A-Za-z]{1,15}(?![A-Za-z0-9]))?(?:[_-](?:[A-Za-z]{1,15}|[0-9]{1,6})(?![A-Za-z0-9])){0,6}",
    # a path's short segment of words
    r"/*(?<![^/\x20])(?=[^/\x20]{3})" + _WORD + "(?:[_+=-]" + _WORD + r"){0,12}(?:/+|(?![^\x20]))",
)
MARK = "[SECRET]"


def running_sum(lengths: Column, block: int = 256) -> Column:
    """Sums of the elements before each one, in blocks so that long lists stay linear."""
    empty = F.array().cast("array<bigint>")

    def before(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), empty.alias("out"))
        return F.aggregate(
            xs,
            start,
            lambda s, x: F.struct(
                (s["sum"] + x.cast("bigint")).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")
            ),
            lambda s: s["out"],
        )

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))

    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(block))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(block)))
    return F.flatten(
        F.zip_with(
            blocks,
            before(F.transform(blocks, total)),
            lambda xs, offset: F.transform(before(xs), lambda x: x + offset),
        )
    )


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), in code points from 0; a match is never empty."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # What stands before a match: gaps and matches by turns.
    steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.length(g) + F.length(h))
    ends = F.zip_with(running_sum(steps), steps, lambda s, n: s + n)
    return F.zip_with(
        hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("match"))
    )


def _spans(kind: str, found: Column) -> Column:
    order = F.lit(KINDS.index(kind))
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), order.alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def _fitting(found: Column, pattern: str) -> Column:
    return F.filter(found, lambda m: m["match"].rlike(pattern))


def _of_kind(spans: str | Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


NO_SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def pattern_spans(text: Column) -> dict[str, Column]:
    """Spans of each written kind; a text without a sign of one is only looked through once."""
    out = {}
    for kind, (pattern, needs) in PATTERNS.items():
        found = matches(text, pattern)
        if needs is not None:
            found = _fitting(found, f"^(?:{needs})$")
        sign = text.contains("AKIA") if kind == "access" else text.rlike(pattern)
        out[kind] = F.when(sign, _spans(kind, found)).otherwise(F.array().cast(NO_SPANS))
    return out


def random_part(token: Column, window: int, limit: Column) -> Column:
    """(first, last): starts of the first and last window of the token whose entropy
    reaches ``limit`` bits a character; null without one.

    The state holds the count of each character of the alphabet in the window.
    """
    chars = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # What enters and what leaves the window at each step, laid side by side so that a step does not read the token.
    before = F.concat(F.array_repeat(F.lit(0), window), chars)
    moves = F.zip_with(chars, F.slice(before, F.lit(1), F.length(token)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    moves = F.transform(moves, lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), (i + 1).alias("i")))

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(s: Column, x: Column) -> Column:
        new, old, i = x["new"], x["old"], x["i"]
        n_new = F.element_at(s["counts"], new)
        n_old = F.when((old > 0) & (old != new), F.element_at(s["counts"], F.greatest(old, F.lit(1))))
        counts = F.when(
            old == new, s["counts"]
        ).otherwise(F.transform(s["counts"], lambda c, k: c + (k + 1 == new).cast("int") - (k + 1 == old).cast("int")))
        total = F.when(old == new, s["sum"]).otherwise(
            s["sum"] + weight(n_new + 1) - weight(n_new)
            + F.coalesce(weight(n_old - 1) - weight(n_old), F.lit(0.0))
        )
        bits = F.log2(F.lit(window)) - total / window
        hit = (i >= window) & (bits >= limit)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(hit & s["first"].isNull(), i - window).otherwise(s["first"]).alias("first"),
            F.when(hit, i - window).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(moves, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _blanked(run: Column, base: Column) -> Column:
    """The run (start, end, match) as text, spaces in place of the base spans that touch it."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        low = F.greatest(b["start"] - run["start"], s["at"])
        high = F.greatest(F.least(b["end"], run["end"]) - run["start"], low)
        gap = F.substring(run["match"], (s["at"] + 1).cast("int"), (low - s["at"]).cast("int"))
        return F.struct(high.alias("at"), F.concat(s["out"], F.array(gap, F.repeat(F.lit(" "), (high - low).cast("int")))).alias("out"))

    def finish(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(run["match"], (s["at"] + 1).cast("int"), F.length(run["match"])))

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.when(F.size(touching) == 0, run["match"]).otherwise(F.aggregate(touching, start, step, finish))


def _pieces(start: Column, run: Column, signs: str, covered: str) -> Column:
    """(start, match) of what no covered pattern fits of a run."""
    whole = F.array(F.struct(start.alias("start"), run.alias("match")))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(matches(run, covered), lambda c: c["end"]))
    left = F.zip_with(F.split(run, covered, -1), starts, lambda p, at: F.struct((start + at).alias("start"), p.alias("match")))
    return F.when(run.rlike(signs), left).otherwise(whole)


def entropy_spans(
    text: Column, base: Column, window: int = WINDOW, allowed: Sequence[str] = ALLOWED,
    signs: Sequence[str] = SIGNS, covered: Sequence[str] = COVERED,
) -> Column:
    """Random-looking parts of candidate strings.  Base spans and what covered patterns fit
    are cut out of a candidate; the pieces left that no allowed pattern fits are judged."""
    runs = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), _blanked(m, base).alias("match")))
    either, sign, cut = ("|".join(f"(?:{p})" for p in ps) for ps in (allowed, signs, covered))
    free = F.flatten(F.transform(runs, lambda m: _pieces(m["start"], m["match"], sign, cut))) if cut and sign else runs
    free = F.filter(free, lambda m: F.length(m["match"]) >= window)
    if either:
        free = F.filter(free, lambda m: ~m["match"].rlike(either))

    def part(m: Column) -> Column:
        limit = F.when(m["match"].rlike("^[0-9A-Fa-f]+$"), LIMITS["hex"]).otherwise(LIMITS["mixed"])
        return F.struct(m["start"].alias("start"), random_part(m["match"], window, limit).alias("part"))

    parts = F.filter(F.transform(free, part), lambda p: p["part"]["first"].isNotNull())
    spans = F.transform(
        parts,
        lambda p: F.struct((p["start"] + p["part"]["first"]).alias("start"), (p["start"] + p["part"]["last"] + window).alias("end")),
    )
    return F.when(text.rlike(CANDIDATE), _spans("entropy", spans)).otherwise(F.array().cast(NO_SPANS))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, in place of columns of these names: (start, order, end, kind) in code points, end
    exclusive, sorted by start and kind; ``spans`` holds the base spans and those the
    entropy test adds.  A null or empty text has none; long texts are scanned whole."""
    whole = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kinds = whole.withColumns({f"_{k}": v for k, v in pattern_spans(F.col("_t")).items()})
    base = kinds.withColumn("base", F.sort_array(F.concat(*(F.col(f"_{k}") for k in PATTERNS))))
    added = base.withColumn("_e", entropy_spans(F.col("_t"), F.col("base")))
    return added.withColumn("spans", F.sort_array(F.concat("base", "_e"))).drop("_t", "_e", *(f"_{k}" for k in PATTERNS))


def show_spans(spans: str | Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, overlapping spans once;
    ``n_chars``, if there, is counted anew where something was replaced."""
    text = docs["text"].cast("string")
    found = scan_secrets(docs.select(text.alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap, F.lit(mark)))).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        rest = F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))
        return F.concat(F.array_join(s["out"], ""), rest)

    changed = F.size("spans") > 0
    clean = F.when(changed, F.aggregate("spans", start, step, finish)).otherwise(F.col("text"))
    out = found.select("row", changed.alias("changed"), clean.alias("clean"))
    length = F.when(F.col("changed"), F.length("clean").cast("long"))
    return out.select(*(
        F.col("clean").alias(c) if c == "text"
        else F.coalesce(length, F.col("row.n_chars")).alias(c) if c == "n_chars"
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {f"n_{k}": F.size(_of_kind("base", k)).cast("long") for k in PATTERNS}
    return found.select(
        "doc_id", *(v.alias(k) for k, v in count.items()),
        F.sha2(show_spans("base"), 256).alias("base_sha256"), show_spans("spans").alias("spans"),
    )
