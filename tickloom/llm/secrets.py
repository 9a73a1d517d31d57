"""Secret scans: fixed patterns, and a battery of randomness tests on every long token.

A token's encoding (hex, base32, base64) is inferred from its characters. Statistics say how far its symbols are from random
draws of that alphabet: chi-squared uniformity, over all symbols and over the two cells of common and rare ones, runs above
and below the middle, and lag-1 serial correlation. A find must be unlike two kinds of tokens, so its p-value is the larger
of two:

* language, whose letters repeat and are mostly common ones: chi-squared grows with the token's length there, so "as even
  as this by chance" is the less likely the longer the token, and so are as many rare letters and runs of digits. The two
  p-values are combined by Fisher's method, as a short token has few of each of 32 symbols but enough rare ones;
* structured tokens, whose order repeats or climbs: their runs and their serial correlation are off by a share at
  least (Battery.structure), which stands out the more the longer the token. The two p-values of "as near to random as
  this" are combined by Fisher's method.

Over all tokens of the corpus that overlap no fixed pattern, the p-values are cut by the Benjamini-Hochberg rule, which
bounds the share of words and structured tokens among the finds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, table
from .unicodeform import let

#: The base kinds in order, each with its pattern and the least length of its match (assign: of group 2).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    "access": (r"AKIA[A-Z0-9]+", 16),
    "hex": (r"[0-9a-f]+", 32),
}
#: Where a document can't hold a match at all, the costlier extraction is left out.
MAY_HOLD = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
KINDS = [*BASE, "random"]
SPAN = "struct<start:int,kind:int,end:int,body:string>"


@dataclass(frozen=True)
class Battery:
    """Parameters of the randomness tests."""

    least: int = 24  # characters that a token needs to be looked at; LEAST has what each encoding needs
    alpha: float = 0.01  # false-discovery rate
    structure: float = 0.8  # share of runs, and serial correlation, by which structured tokens are off at least
    repeat: float = 0.065  # chance that two letters of a language's text agree
    rare: float = 0.25  # share of rare letters and runs of digits in language and names, at most
    bins_a_decade: int = 8  # p-values are ranked in bins of log10


#: Matches or spans that one fold goes over: what a fold gathers is copied at each step, so long lists are gathered in parts.
PART = 256


def _in_parts(items: Column, first: Column, fold: Callable[[Column, Column], Column], kind: str) -> Column:
    """fold(at, some items) -> struct(at, out), one after the other over parts of PART items; the last at, and all out of
    type array<kind> one after the other. Time is in proportion to the items."""
    parts = lambda items: F.sequence(F.lit(0), F.floor(F.size(items) / PART).cast("int"))
    more = lambda at, x: F.struct(x["at"].alias("at"), F.concat(at["out"], F.array(x["out"])).alias("out"))
    step = lambda items: lambda at, i: let(fold(at["at"], F.slice(items, i * PART + 1, F.lit(PART))), lambda x: more(at, x))
    start = F.struct(first.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return let(items, lambda items: F.aggregate(parts(items), start, step(items), lambda at: F.struct(at["at"].alias("at"), F.flatten(at["out"]).alias("out"))))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost matches of a pattern as spans; positions are code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"), h.alias("body")))

    def step(at: Column, p: Column) -> Column:
        start = at["at"] + p["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + p["n"]).alias("end"), p["body"].alias("body"))
        return F.struct((start + p["n"]).alias("at"), F.concat(at["out"], F.array(span)).alias("out"))

    none = F.array().cast(f"array<{SPAN}>").alias("out")
    return _in_parts(parts, F.lit(0), lambda at, some: F.aggregate(some, F.struct(at.alias("at"), none), step), SPAN)["out"]


def _pattern(kind: str) -> str:
    """Runs of the hex alphabet are maximal, so asking for the length in the pattern finds the same runs."""
    pattern, least = BASE[kind]
    return pattern.replace("]+", f"]{{{least},}}") if kind == "hex" else pattern


def _fits(kind: str) -> Callable[[Column], Column]:
    """Whether a match's body is long enough."""
    if kind == "assign":
        return lambda body: F.length(F.regexp_extract(body, BASE["assign"][0], 2)) >= BASE["assign"][1]
    return lambda body: F.length(body) >= BASE[kind][1]


def _of_body(fits: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda span: fits(span["body"])


def _marked(fits: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda hit: F.when(fits(hit), F.translate(hit, TOKEN, MARK * len(TOKEN))).otherwise(hit)


def base_spans(text: Column) -> Column:
    """The fixed kinds' spans in a text, by start and then by kind."""
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(text.rlike(MAY_HOLD[kind]), F.filter(_found(text, _pattern(kind), k), _of_body(_fits(kind)))).otherwise(none) for k, kind in enumerate(BASE)]
    return F.array_sort(F.concat(*found))


#: What tokens are made of, and two characters that stand for it: inside a base span, and for itself in a text.
TOKEN, MARK, OTHER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "\x01", "\x02"


def _overlapped(text: Column, battery: Battery) -> Column:
    """For each token, in order, whether a base span overlaps it; empty where the text has no base span.

    Base spans are marked in the text, character by character, so that tokens are where they were and those that hold a
    mark are told by looking at each once.
    """
    pattern = f"[A-Za-z0-9+/_={MARK}-]{{{battery.least},}}"
    told = []
    for kind in BASE:
        hits, gaps = F.regexp_extract_all(text, F.lit(_pattern(kind)), F.lit(0)), F.split(text, _pattern(kind), -1)
        marked = F.transform(hits, _marked(_fits(kind)))
        whole = F.array_join(F.zip_with(gaps, marked, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        held = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda x: F.contains(x, F.lit(MARK)))
        told.append(F.when(text.rlike(MAY_HOLD[kind]), held).otherwise(F.array().cast("array<boolean>")))
    either = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))
    return either(either(told[0], told[1]), told[2])


def tokens(text: Column, battery: Battery = Battery()) -> Column:
    """Spans of the tokens long enough for the battery."""
    pattern = f"[A-Za-z0-9+/_=-]{{{battery.least},}}"
    return F.when(text.rlike(pattern), _found(text, pattern, len(BASE))).otherwise(F.array().cast(f"array<{SPAN}>"))


#: Letters that are rare in languages of the Latin alphabet; a run of digits counts as one more.
RARE = "bfgjkpqvwxyz"
#: Characters from which each encoding's random tokens are found nine times in ten; shorter ones aren't tested.
LEAST = {"hex": 26, "base32": 30, "upper": 28, "base64": 24}


def _normal_cdf(z: Column) -> Column:
    """By the rational approximation 26.2.17 of Abramowitz and Stegun's handbook; its error is below 1e-7."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z < 0, tail).otherwise(F.lit(1.0) - tail)


#: Encodings in order of trial: what all characters must be, and the alphabet.
ALPHABETS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7=]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "upper": ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
}
#: A word's excess of chi-squared a character in hex, whose letters are few.
HEX_EXCESS = 1.7


def tested(spans: Column, battery: Battery = Battery()) -> Column:
    """Array of (span, encoding, chi2, z_rare, z_runs, z_serial, p_language, p_order, p), one for each token of LEAST
    characters in an array of spans. z_rare is standard normal for names with battery.rare rare letters; null without letters.

    z_runs and z_serial are standard normal for random tokens. A token of one repeated symbol has neither runs nor
    correlation to test and isn't random: they are null, p_order and p are 1.
    """
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    named = lambda s, *names: [s[n].alias(n) for n in names]

    def choose(s: Column, values: dict) -> Column:
        out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
        for name, (pattern, _) in ALPHABETS.items():
            out = out.when(s["body"].rlike(pattern), F.lit(values[name])) if pattern else out.otherwise(F.lit(values[name]))
        return out

    rows = F.transform(
        spans,
        lambda s: F.struct(
            s.alias("span"),
            choose(s, {n: n for n in ALPHABETS}).alias("encoding"),
            choose(s, {n: letters for n, (_, letters) in ALPHABETS.items()}).alias("alphabet"),
        ),
    )
    rows = F.transform(
        rows,
        lambda s: F.struct(
            *named(s, "span", "encoding"),
            F.length(s["alphabet"]).cast("double").alias("k"),
            F.transform(
                F.split(F.when(s["encoding"] == "hex", F.lower(s["span"]["body"])).otherwise(F.rtrim(s["span"]["body"], F.lit("="))), ""),
                lambda c: F.greatest(F.position(c, s["alphabet"]) - 1, F.lit(0)).cast("double"),
            ).alias("v"),
        ),
    )
    enough = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv]), s["encoding"])
    rows = F.filter(rows, lambda s: F.size(s["v"]) >= F.greatest(enough(s), F.lit(4)))
    rows = F.transform(
        rows,
        lambda s: F.struct(
            *named(s, "span", "encoding", "k", "v"),
            _z_rare(F.lower(s["span"]["body"]), battery).alias("z_rare"),
            F.size(s["v"]).cast("double").alias("n"),
            (total(s["v"], lambda x: x) / F.size(s["v"])).alias("mean"),
            F.zip_with(F.slice(s["v"], F.lit(1), F.size(s["v"]) - 1), F.slice(s["v"], F.lit(2), F.size(s["v"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"),
        ),
    )
    rows = F.transform(
        rows,
        lambda s: F.struct(
            *named(s, "span", "encoding", "k", "n", "z_rare"),
            (s["k"] / s["n"] * total(F.array_distinct(s["v"]), lambda c: F.pow(F.size(F.filter(s["v"], lambda x: x == c)).cast("double"), F.lit(2.0))) - s["n"]).alias("chi2"),
            F.size(F.filter(s["v"], lambda x: x >= s["k"] / 2)).cast("double").alias("high"),
            F.size(F.filter(s["pairs"], lambda p: (p["a"] >= s["k"] / 2) != (p["b"] >= s["k"] / 2))).cast("double").alias("turns"),
            total(s["pairs"], lambda p: (p["a"] - s["mean"]) * (p["b"] - s["mean"])).alias("cov"),
            total(s["v"], lambda x: (x - s["mean"]) * (x - s["mean"])).alias("var"),
        ),
    )
    rows = F.transform(
        rows,
        lambda s: F.struct(
            *named(s, "span", "encoding", "n", "chi2", "turns", "cov", "var", "z_rare"),
            (F.lit(2.0) * s["high"] * (s["n"] - s["high"]) / s["n"] + 1).alias("runs"),
            (s["k"] - 1).alias("freedom"),
            F.when(s["encoding"] == "hex", s["n"] * HEX_EXCESS).otherwise(s["n"] * F.greatest(s["k"] * battery.repeat - 1, F.lit(0.5))).alias("excess"),
        ),
    )
    spread = lambda s: (s["runs"] - 1) * (s["runs"] - 2) / (s["n"] - 1)
    rows = F.transform(
        rows,
        lambda s: F.struct(
            *named(s, "span", "encoding", "chi2", "z_rare"),
            F.when(spread(s) > 0, (s["turns"] + 1 - s["runs"]) / F.sqrt(spread(s))).alias("z_runs"),
            F.when(s["var"] > 0, (s["cov"] / s["var"] + F.lit(1.0) / s["n"]) * F.sqrt(s["n"])).alias("z_serial"),
            _normal_cdf((s["chi2"] - s["freedom"] - s["excess"]) / F.sqrt(F.lit(2.0) * (s["freedom"] + F.lit(2.0) * s["excess"]))).alias("p_even"),
            F.coalesce(_normal_cdf(-s["z_rare"]), F.lit(1.0)).alias("p_rare"),
            # how likely a structured token is to come so near to random
            F.when(spread(s) > 0, _normal_cdf(F.abs(s["turns"] + 1 - s["runs"]) / F.sqrt(spread(s)) - s["runs"] * battery.structure / F.sqrt(spread(s)))).otherwise(1.0).alias("p_runs"),
            F.when(s["var"] > 0, _normal_cdf((F.abs(s["cov"] / s["var"] + F.lit(1.0) / s["n"]) - battery.structure) * F.sqrt(s["n"]))).otherwise(1.0).alias("p_serial"),
        ),
    )
    both = lambda s, a, b: F.greatest(s[a], F.lit(1e-30)) * F.greatest(s[b], F.lit(1e-30))
    fisher = lambda q: q * (F.lit(1.0) - F.ln(q))
    rows = F.transform(rows, lambda s: F.struct(*named(s, "span", "encoding", "chi2", "z_rare", "z_runs", "z_serial"), fisher(both(s, "p_even", "p_rare")).alias("p_language"), fisher(both(s, "p_runs", "p_serial")).alias("p_order")))
    return F.transform(rows, lambda s: F.struct(*named(s, "span", "encoding", "chi2", "z_rare", "z_runs", "z_serial", "p_language", "p_order"), F.greatest(s["p_language"], s["p_order"]).alias("p")))


def _z_rare(low: Column, battery: Battery) -> Column:
    """By how many deviations a lower-case token has more rare letters and runs of digits than language; null without a
    letter."""
    letters, digits = F.regexp_count(low, F.lit("[a-z]")), F.regexp_count(low, F.lit("[0-9]+"))
    n, hits = (letters + digits).cast("double"), (F.regexp_count(low, F.lit(f"[{RARE}]")) + digits).cast("double")
    return F.when(letters > 0, (hits - F.lit(0.5) - n * battery.rare) / F.sqrt(n * (battery.rare * (1 - battery.rare))))


def _bin(test: Column, battery: Battery) -> Column:
    """Of a token's p-value, the higher the lower p is: few bins, so that the corpus' histogram stays small."""
    return F.floor(F.least(F.lit(30.0), -F.log10(F.greatest(F.least(test["p"], F.lit(1.0)), F.lit(1e-30)))) * battery.bins_a_decade).cast("int")


def candidates(text: Column, battery: Battery = Battery()) -> Column:
    """The tests of a text's tokens that overlap no base span."""
    plain = F.translate(text, MARK, OTHER)
    apart = lambda x: F.filter(x["tokens"], lambda s, i: ~F.coalesce(F.get(x["overlapped"], i), F.lit(False)))
    return tested(let(F.struct(tokens(plain, battery).alias("tokens"), _overlapped(plain, battery).alias("overlapped")), apart), battery)


def discovery_cut(docs: DataFrame, text_col: str = "text", battery: Battery = Battery()) -> int | None:
    """The lowest bin that Benjamini and Hochberg's rule accepts at battery.alpha over all candidates of docs; or None.

    A bin's p-value is its largest. The histogram has at most 30 * bins_a_decade + 1 rows, so its running sum is a small
    window and one number reaches the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = only(docs, text_col).filter(text.rlike(f"[A-Za-z0-9+/_=-]{{{battery.least}}}"))
    tests = long.select(F.explode(candidates(text, battery)).alias("t"))
    bins = tests.groupBy(_bin(F.col("t"), battery).alias("bin")).agg(F.count("*").alias("n"))
    down = W.orderBy(F.desc("bin"))
    ranked = bins.select("bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(W.partitionBy()).alias("tokens"))
    most = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(battery.bins_a_decade)))
    return ranked.agg(F.min(F.when((F.col("bin") > 0) & (most * F.col("tokens") <= F.col("rank") * battery.alpha), F.col("bin")))).first()[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", battery: Battery = Battery()) -> DataFrame:
    """The input's columns and `base`, `spans`: arrays of (start, kind, end, body), base kinds alone and all kinds.

    kind is an index of KINDS; positions are code points, the end exclusive. Random tokens that overlap a base span
    aren't listed again. Null and empty texts have no spans; repeated rows have the same spans; an empty table gives an
    empty one. Input columns called `base` or `spans` are replaced. Equal p-values are accepted or left together. A text of
    any length and with any number of tokens is one row, worked on in time in proportion to both. No text is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = discovery_cut(docs, text_col, battery)
    out = docs.withColumn("base", base_spans(text))
    if cut is None:
        return out.withColumn("spans", F.col("base"))
    kept = F.transform(F.filter(candidates(text, battery), lambda t: _bin(t, battery) >= cut), lambda t: t["span"])
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base"), kept)))


def redacted(text: Column, spans: Column, mask: str = "<SECRET>") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask. Spans stand by their start."""

    def fold(at: Column, some: Column) -> Column:
        upto = F.greatest(at, F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), at))

        def within(piece: Column) -> Column:  # a part's spans look at their own piece of the text
            def step(now: Column, s: Column) -> Column:
                fresh = F.concat(F.substring(piece["text"], now["at"] - piece["at"] + 1, s["start"] - now["at"]), F.lit(mask))
                return F.struct(F.greatest(now["at"], s["end"]).alias("at"), F.concat(now["out"], F.array(F.when(s["start"] >= now["at"], fresh).otherwise(F.lit("")))).alias("out"))

            return F.aggregate(piece["some"], F.struct(piece["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)

        return let(F.struct(some.alias("some"), at.alias("at"), F.substring(text, at + 1, upto - at).alias("text")), within)

    whole = let(_in_parts(spans, F.lit(0), fold, "string"), lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
