"""Personal data by base patterns and bootstrapped context. DataFrame functions only.

Base entities are regular expression matches, leftmost and non-overlapping for each kind, of which some fail a check and are
dropped. They and secrets of unmistakable form (long hexadecimal runs, keys with a vendor's prefix) seed the bootstrap. Three
lexical patterns tell where an instance stands or what it looks like: the word before it ("tel"), that word with the signs
between ("token=" and an opening quote), and, for what isn't a seed, its shape (24 letters and digits). An instance is a seed, another run of
characters that holds a digit, or a few groups of digits. The pattern-instance graph is scored in rounds. A pattern's score for
a kind is the weighted share of instances of that kind among all that it has; an instance that isn't a seed scores
1 - prod(1 - score) over its patterns. So a context that secrets follow lends its trust to other instances there, and those to
their shape. In the end, identifiers with a pattern of high score and support that overlap no base entity are found too, as
kind `other`; a secret's form alone is not enough. A word that precedes all kinds alike (an article) scores low for each.

The regular expressions are written for linear time and constant stack on texts of any length: possessive loops, and starts
only where a run of characters begins or the last match ended. Positions are code points. They come from the lengths of
matches and of what stands between them, summed in blocks.

Defined results: a null text is empty; null and repeated ids are rows of their own; an empty table gives an empty result;
other columns play no part. docs must be a table or a result that is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import cut, join_hot

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of fewer than 13 digits fail in any case
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without one of these characters a text holds no match.
NEEDS = {"email": "@", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CUED = r"\p{L}[\p{L}\p{M}_-]{0,30}"
_GROUP = r"\(?[0-9][0-9().-]*+(?![^\s,;:!?])"
#: At a start of a run, after an opening quotation mark there, or after a cue and ":" or "=" (and a quotation mark) there: up to eight
#: groups of digits with spaces between, or a run with a digit.
CANDIDATE = rf"(?:(?<!\S)(?!{_CUED}[:=][^\s/])(?![\"'])|(?<=(?<!\S)[\"'])|(?<=[:=])(?<=(?<!\S){_CUED}[:=])(?=[^\s/\"'])|(?<=[:=][\"'])(?<=(?<!\S){_CUED}[:=][\"']))(?:\+?{_GROUP}(?:\x20{_GROUP}){{1,7}}+|(?=[^\s\"']*?[0-9])[^\s\"']{{5,}}+)"
#: Forms of secrets: hexadecimal digests and keys, and keys with a vendor's prefix.
SECRET = r"^(?:(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}|(?=.*[0-9])(?=.*[A-F])[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)$"
SEEDS = (*KINDS, "secret")
CUE_CHARS, ROUNDS, LEAST_SCORE, LEAST_SUPPORT = 40, 3, 0.7, 3.0
BLOCK = 64


def _running(a: Column, start: Column) -> Column:
    """Inclusive prefix sums of a short array<long>."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(a, F.struct(start.alias("s"), none.alias("l")), lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["l"], F.array(t["s"] + x)).alias("l")))["l"]


def _prefix_sums(a: Column) -> Column:
    """Inclusive prefix sums of array<long>, in blocks, so that the work isn't quadratic.

    Arrays that a lambda needs are arguments of its function, since an expression inside a lambda is evaluated for each element.
    """
    zero = F.lit(0).cast("long")
    n = F.ceil(F.size(a) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda t, y: t + y))
    before = F.concat(F.array(zero), _running(sums, zero))
    summed = F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), n), _running))
    return F.when(F.size(a) > 0, summed).otherwise(F.array().cast("array<bigint>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: _holds(kind, x["m"])


def _span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _seed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["m"]).alias("m"), _patterns(x["before"]).alias("patterns"))


def _with_spans(df: DataFrame, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """Adds name: array<struct<s long, e long, m string, before string>> of the pattern's matches in _text."""
    has = F.contains("_text", F.lit(needs)) if needs else F.col("_text").rlike(pattern)
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    step = F.transform("_m", lambda m, i: F.length(F.get("_p", i)).cast("long") + F.when(i > 0, F.length(F.get("_m", i - 1))).otherwise(0))
    df = df.withColumn("_n", step).withColumn("_s", _prefix_sums(F.col("_n")))
    spans = F.transform("_m", lambda m, i: F.struct(F.get("_s", i).alias("s"), (F.get("_s", i) + F.length(m)).alias("e"), m.alias("m"), F.substring(F.get("_p", i), -CUE_CHARS, CUE_CHARS).alias("before")))
    return df.withColumn(name, spans).drop("_m", "_p", "_n", "_s")


_BEFORE = r"(\p{L}[\p{L}\p{M}_-]*+)([^\p{L}\s]{0,3}\s{0,2}(?:[:=]\s{0,2}[\"']?|[\"'])?)$"


def _patterns(before: Column, *more: Column) -> Column:
    """The word before, lower-cased, as `w:word`, and if there is more than white space between, with that, as `f:word=`; none if there is
    no word in the same window. more: further patterns."""
    word, signs = F.lower(F.regexp_extract(before, _BEFORE, 1)), F.regexp_replace(F.regexp_extract(before, _BEFORE, 2), r"\s+", "")
    near = F.when(word == "", F.array().cast("array<string>")).when(signs == "", F.array(F.concat(F.lit("w:"), word)))
    return F.concat(near.otherwise(F.array(F.concat(F.lit("w:"), word), F.concat(F.lit("f:"), word, signs))), F.array(*more).cast("array<string>"))


def _shape(m: Column) -> Column:
    """What an instance is made of, and its length."""
    made = F.when(m.rlike("^[0-9]+$"), "digits").when(m.rlike("^[0-9A-Fa-f]+$"), "hex").when(m.rlike("^[0-9A-Za-z]+$"), "alnum").when(m.rlike("^[0-9A-Za-z_-]+$"), "key")
    return F.concat(F.lit("s:"), made.otherwise("mixed"), F.lit(":"), F.length(m).cast("string"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, and base and found: array<struct<kind string, s long, e long>>, by kind (in the order of KINDS, then other), then start."""
    df = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    for k in KINDS:
        df = _with_spans(df, k, PATTERNS[k], NEEDS.get(k))
        df = df.withColumn(k, F.filter(k, _valid(k)))
    df = _with_spans(df, "_c", CANDIDATE)
    base = F.concat(*[F.transform(k, _span(k)) for k in KINDS])
    seeds = F.concat(*[F.transform(k, _seed(k)) for k in KINDS])
    df = df.withColumn("base", base).withColumn("_seeds", seeds)
    clean = F.transform("_c", lambda x: F.struct(x["s"].alias("s"), F.regexp_replace(x["m"], r"[^\p{L}\p{N}]++$", "").alias("m"), x["before"].alias("before")))
    df = df.withColumn("_c", F.filter(clean, lambda x: F.length(x["m"]) >= 5))
    kind = lambda m: F.when(m.rlike(SECRET), "secret").otherwise("other")
    bare = F.transform("_c", lambda x: F.struct(kind(x["m"]).alias("kind"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), F.lower(x["m"]).alias("m"), F.when(x["m"].rlike(SECRET), _patterns(x["before"])).otherwise(_patterns(x["before"], _shape(x["m"]))).alias("patterns")))
    df = df.withColumn("_free", bare)
    others = F.filter("_free", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    df = df.withColumn("_others", F.when(F.size("base") > 0, others).otherwise(F.col("_free")))
    table = cut(df.select(id_col, "base", "_seeds", "_others").withColumn("_row", F.monotonically_increasing_id()))

    met = table.select(F.explode(F.concat("_seeds", "_others")).alias("x")).select(F.explode("x.patterns").alias("cue"), F.col("x.m").alias("instance"), "x.kind")
    cues = accepted_cues(met)
    found = table.where(F.size("_others") > 0).select("_row", F.explode("_others").alias("x")).select("_row", F.struct(F.lit("other").alias("kind"), "x.s", "x.e").alias("span"), F.explode("x.patterns").alias("cue"))
    found = found.join(cues.select("cue"), "cue", "left_semi").groupBy("_row").agg(F.sort_array(F.collect_set("span")).alias("found"))
    out = table.join(found, "_row", "left")
    return out.select(id_col, "base", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def accepted_cues(edges: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_support: float = LEAST_SUPPORT) -> DataFrame:
    """(cue, kind, score) of patterns to trust, from occurrences (cue, instance, kind: of a seed, or `other`).

    A pattern's support is the sum of its different instances' scores; so three seeds, or some more that other patterns vouch for."""
    seed = [F.max((F.col("kind") == k).cast("double")).alias(k) for k in SEEDS]
    graph = cut(edges.groupBy("cue", "instance").agg(F.count("*").alias("n"), *seed))
    n_edges = graph.count()
    known = graph.groupBy("instance").agg(*[F.max(k).alias(f"i_{k}") for k in SEEDS], F.count("*").alias("n_cues"))
    graph = cut(join_hot(graph.drop(*SEEDS), known, "instance", "n_cues", n_edges).drop("n_cues"))
    scored = graph
    for r in range(rounds):
        share = [(F.sum(F.col("n") * F.col(f"i_{k}")) / (F.sum("n") + 1)).alias(f"p_{k}") for k in SEEDS]
        cues = cut(scored.groupBy("cue").agg(*share, *[F.sum(f"i_{k}").alias(f"support_{k}") for k in SEEDS], F.count("*").alias("n_instances")))
        if r + 1 == rounds:
            break
        trust = [F.when(F.col(f"p_{k}") >= 0.5, F.least(F.col(f"p_{k}"), F.lit(0.99))).otherwise(0.0) for k in SEEDS]
        odds = join_hot(graph, cues, "cue", "n_instances", n_edges).groupBy("instance").agg(*[(1 - F.exp(F.sum(F.log1p(-t)))).alias(f"o_{k}") for k, t in zip(SEEDS, trust, strict=True)], F.count("*").alias("n_cues"))
        odds = join_hot(graph, cut(odds), "instance", "n_cues", n_edges)
        scored = cut(odds.select("cue", "instance", "n", *[F.greatest(f"i_{k}", f"o_{k}").alias(f"i_{k}") for k in SEEDS]))
    best = F.array_max(F.array(*[F.struct(F.col(f"p_{k}").alias("score"), F.lit(k).alias("kind"), F.col(f"support_{k}").alias("support")) for k in SEEDS]))
    return cues.select("cue", best.alias("b")).where((F.col("b.score") >= least_score) & (F.col("b.support") >= least_support)).select("cue", "b.kind", "b.score")
