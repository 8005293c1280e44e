"""Secret scans: patterns, and a randomness test battery for what patterns don't know.

Base spans (assign, access, hex; leftmost, not overlapping within a kind) are always kept. Other long tokens (20 and more
characters of an encoding's alphabet, with = only behind them as padding, so that a name before = is no part of its value)
are tested for randomness. The encoding is inferred (hex, base32, base64), and
four tests of the hypothesis "characters are drawn uniformly and independently" give p-values:

* chi-squared of the character counts, by the Wilson-Hilferty transform, one-sided (text uses few characters often);
* runs above and below the alphabet's middle;
* serial correlation at lag one;
* likelihood: the log odds of a model of text (letter frequencies; digits, capitals and small letters stay together)
  against the hypothesis, summed over neighbouring characters, one-sided.

A token that the battery rejects as random (the least of the four, times four, below ``ALPHA``) is no secret. For the others, the
hypothesis is that they are *text*: their p-value is the probability that the text model gives log odds as low as theirs
(a normal distribution with the chain's mean and long-run variance, wider by ``SPREAD``, as tokens vary more than a chain). Within bands of encoding and
length, the Benjamini-Hochberg step-up over all tokens of the corpus (rejected ones with a p-value of 1) tells which aren't text: of
those reported, a share of ``FDR`` at most is expected to be text. Runs of 20 and more letters and digits within a longer token (behind
a path or a prefix with _) are tokens of their own, reported if the longer one isn't. A token is only judged if it has
a digit and a letter. P-values are counted in bins (bands times bins: a small table), so that the step-up needs no ranking of the corpus.

Only DataFrame functions are used. Defined results: a null text is empty and has no spans; very long texts are scanned whole; repeated rows are judged one by one,
and each counts in the step-up, as do ties; an empty table gives an empty result. Positions are code points, end exclusive. A random token that overlaps a base span is dropped.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stage, sums_before

# The base patterns and what their matches must have.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_START = r"(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
RANDOM = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
PIECE = r"[A-Za-z0-9]{20,}"

#: Alphabets by encoding; characters outside of them rule an encoding out.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: The model of text: letters by hundredths (1 at least), and how likely the next character is of the same class.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 1.0, 1.0, 4.0, 2.4, 6.7, 7.5, 1.9, 1.0, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 1.0, 2.0, 1.0), strict=True))
STAY = 0.85
#: How much wider than the model's the log odds of real text are: paths and identifiers of many styles are base64 by their characters.
SPREAD = {"hex": 1.0, "base32": 1.1, "base64": 1.25}
#: Share of text among the tokens reported, and the p-value below which a token isn't random.
FDR, ALPHA = 0.05, 0.001
#: P-values are counted in steps of a tenth of a power of ten, down to 10^-30.
STEPS, LOWEST = 10, 30
#: Lower edges of the length bands.
BANDS = (20, 24, 28, 32, 40, 48, 64, 96, 128)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of leftmost matches of a pattern without groups: gaps and matches add up to positions."""
    both = rf"(?s)(.*?)({pattern}|\z)"
    gaps, found = F.regexp_extract_all(text, F.lit(both), F.lit(1)), F.regexp_extract_all(text, F.lit(both), F.lit(2))
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))

    def placed(p: Column) -> Column:
        ends = let(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), sums_before)
        return F.filter(F.zip_with(p, ends, lambda x, at: let(at + F.length(x["g"]), lambda s: F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m")))), lambda x: x["e"] > x["s"])

    return let(pairs, placed)


def _spans(text: Column, pattern: str, kind: int, guard: str, keep=None) -> Column:
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    found = matches(text, pattern.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+"))
    if keep is not None:
        found = F.filter(found, keep)
    return F.when(text.rlike(guard), F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Sorted array<struct<s, k, e>> of the base spans."""
    long_enough = lambda m: F.length(F.regexp_extract(m["m"], ASSIGN, 1)) >= 6
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, ASSIGN_START, long_enough), _spans(text, ACCESS, 1, ACCESS), _spans(text, HEX, 2, HEX)))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by Abramowitz and Stegun's formula 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoding(token: Column) -> Column:
    plain = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    return (
        F.when(plain.rlike("^[0-9a-fA-F]+$") & ((plain == F.lower(plain)) | (plain == F.upper(plain))), "hex")
        .when(plain.rlike("^[A-Z2-7]+$"), "base32")
        .when(plain.rlike("^[A-Za-z0-9+/]+$"), "base64")
    )


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def text_model(name: str) -> tuple[list[float], float, float, float, float, float]:
    """Log odds of each character within its class, of staying in a class, of leaving it; of a pair, under the hypothesis: mean, variance, covariance with the next pair."""
    alphabet = ALPHABETS[name]
    k, classes = len(alphabet), sorted({_class(c) for c in alphabet})
    often = {c: 1.0 if name == "hex" else LETTERS.get(c.lower(), 10.0) for c in alphabet}
    own = [math.log(k * often[c] / sum(often[x] for x in alphabet if _class(x) == _class(c))) for c in alphabet]
    stay, leave = math.log(STAY), math.log((1 - STAY) / (len(classes) - 1))
    pair = [[own[j] + (stay if _class(a) == _class(b) else leave) for j, b in enumerate(alphabet)] for a in alphabet]
    mean = sum(map(sum, pair)) / k**2
    variance = sum(x * x for r in pair for x in r) / k**2 - mean**2
    ahead, behind = [sum(r) / k for r in pair], [sum(r[j] for r in pair) / k for j in range(k)]
    return own, stay, leave, mean, variance, sum(x * y for x, y in zip(ahead, behind, strict=True)) / k - mean**2


def text_odds(name: str) -> tuple[float, float]:
    """Mean and long-run variance of a pair's log odds under the model of text (a stationary chain; classes are left for each other alike)."""
    alphabet = ALPHABETS[name]
    own, stay, leave, *_ = text_model(name)
    classes = sorted({_class(c) for c in alphabet})
    often = np.array([1.0 if name == "hex" else LETTERS.get(c.lower(), 10.0) for c in alphabet])
    kind = np.array([_class(c) for c in alphabet])
    within = often / np.array([often[kind == k].sum() for k in kind])
    same = kind[:, None] == kind[None, :]
    chain = np.where(same, STAY, (1 - STAY) / (len(classes) - 1)) * within
    always = within / len(classes)
    score = np.array(own)[None, :] + np.where(same, stay, leave)
    mean = float((always[:, None] * chain * score).sum())
    off = score - mean
    variance = float((always[:, None] * chain * off**2).sum())
    into, ahead = (always[:, None] * chain * off).sum(axis=0), (chain * off).sum(axis=1)
    for _ in range(60):  # covariances with later pairs die out as classes are left
        variance += 2 * float(into @ ahead)
        ahead = chain @ ahead
    return mean, variance


def _parameters(enc: Column) -> Column:
    """Struct of what the tests need of an encoding."""
    out, at = None, 0
    for name, alphabet in ALPHABETS.items():
        _, stay, leave, mean, variance, cov = text_model(name)
        text_mean, text_variance = text_odds(name)
        values = {"alphabet": alphabet, "k": float(len(alphabet)), "at": at, "stay": stay, "leave": leave, "mean": mean, "variance": variance, "cov": cov, "text_mean": text_mean, "text_sd": SPREAD[name] * math.sqrt(text_variance)}
        one = F.struct(*[F.lit(v).alias(n) for n, v in values.items()])
        out = F.when(enc == name, one) if out is None else out.when(enc == name, one)
        at += len(alphabet)
    return out


def _p_value(plain: Column, enc: Column) -> Column:
    """The p-value of a token under the hypothesis that it is text; 1 if the battery rejects that it is random."""
    return let(F.struct(plain.alias("m"), _parameters(enc).alias("p")), lambda t: let(F.transform(F.filter(F.split(t["m"], "", -1), lambda c: c != ""), lambda c: F.instr(t["p"]["alphabet"], c) - 1), lambda ranks: _least(ranks, t["p"])))


def _least(ranks: Column, p: Column) -> Column:
    own = F.array(*[F.lit(x) for name in ALPHABETS for x in text_model(name)[0]])
    classes = F.array(*[F.lit(_class(c)) for alphabet in ALPHABETS.values() for c in alphabet])
    k, n = p["k"], F.size(ranks).cast("double")
    d, middle = k - 1, (k - 1) / 2
    tail = lambda z: let(z, _normal_tail)
    # the squares of the counts: the j-th of equal characters adds 2j - 1
    tally = F.aggregate(
        F.array_sort(ranks),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("j"), F.lit(0.0).alias("sum")),
        lambda s, x: let(F.when(s["last"] == x, s["j"] + 1).otherwise(1.0), lambda j: F.struct(x.alias("last"), j.alias("j"), (s["sum"] + 2 * j - 1).alias("sum"))),
    )
    chi = tally["sum"] * k / n - n
    chi_p = tail((F.pow(F.greatest(chi, F.lit(1e-9)) / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d)))
    state = F.struct(F.lit(-1).alias("last"), *[F.lit(0.0).alias(x) for x in ("runs", "high", "cross", "square", "odds")])
    first = lambda s: s["last"] < 0
    class_of = lambda x: F.get(classes, p["at"] + x)
    walked = F.aggregate(
        ranks,
        state,
        lambda s, x: F.struct(
            x.alias("last"),
            (s["runs"] + F.when(first(s) | ((s["last"] > middle) != (x > middle)), 1.0).otherwise(0.0)).alias("runs"),
            (s["high"] + F.when(x > middle, 1.0).otherwise(0.0)).alias("high"),
            (s["cross"] + F.when(first(s), 0.0).otherwise((s["last"] - middle) * (x - middle))).alias("cross"),
            (s["square"] + (x - middle) * (x - middle)).alias("square"),
            (s["odds"] + F.when(first(s), 0.0).otherwise(F.get(own, p["at"] + x) + F.when(class_of(s["last"]) == class_of(x), p["stay"]).otherwise(p["leave"]))).alias("odds"),
        ),
    )

    def judged(w: Column) -> Column:
        mean = 2 * w["high"] * (n - w["high"]) / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        runs_p = 2 * tail(F.abs(w["runs"] - mean) / F.sqrt(spread))
        serial_p = 2 * tail(F.abs(w["cross"] / F.greatest(w["square"], F.lit(1e-9))) * F.sqrt(n))
        odds_p = tail((w["odds"] - (n - 1) * p["mean"]) / F.sqrt((n - 1) * p["variance"] + 2 * (n - 2) * p["cov"]))
        text_p = tail(((n - 1) * p["text_mean"] - w["odds"]) / (F.sqrt(n - 1) * p["text_sd"]))
        return F.when(4 * F.least(chi_p, runs_p, serial_p, odds_p) < ALPHA, F.lit(1.0)).otherwise(text_p)

    return let(walked, judged)


def _tested(tokens: Column) -> Column:
    """array<struct<s, e, enc, band, bin>> of tokens (array<struct<s, e, m>>) mixed enough to be judged."""
    mixed = F.filter(tokens, lambda m: m["m"].rlike("[0-9]") & m["m"].rlike("[A-Za-z]"))
    told = F.transform(mixed, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), encoding(m["m"]).alias("enc"), F.regexp_replace(F.translate(m["m"], "-_", "+/"), "=+$", "").alias("m")))
    plain = lambda m: F.when(m["enc"] == "hex", F.lower(m["m"])).otherwise(m["m"])
    band = lambda n: sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    bin_ = lambda p: let(p, lambda x: F.least(F.lit(STEPS * LOWEST), F.floor(-F.log10(F.greatest(x, F.lit(10.0**-LOWEST))) * STEPS)).cast("int"))
    return F.transform(F.filter(told, lambda m: m["enc"].isNotNull()), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.concat(m["enc"], F.lit(":"), band(F.length(m["m"])).cast("string")).alias("band"), bin_(_p_value(plain(m), m["enc"])).alias("bin")))


def step_up(counts: list[tuple[str, int, int]], fdr: float = FDR) -> dict[str, int]:
    """By band, the least bin whose tokens are rejected as text by the Benjamini-Hochberg step-up (a bin's p-values count as its upper edge)."""
    out: dict[str, int] = {}
    for band in {b for b, _, _ in counts}:
        own = sorted(((k, n) for b, k, n in counts if b == band), reverse=True)
        total, seen, cut = sum(n for _, n in own), 0, STEPS * LOWEST + 1
        for k, n in own:
            seen += n
            if 10 ** (-k / STEPS) <= fdr * seen / total:
                cut = k
        out[band] = cut
    return out


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = docs.select(F.col(doc_id).alias("doc_id"), base_spans(t).alias("base"), F.when(t.rlike(RANDOM), matches(t, RANDOM)).otherwise(none).alias("whole"), F.when(t.rlike(PIECE), matches(t, PIECE)).otherwise(none).alias("pieces"))
    inner = F.filter("pieces", lambda m: ~F.exists("whole", lambda w: (w["s"] == m["s"]) & (F.regexp_replace(w["m"], "=+$", "") == m["m"])))
    found = found.select("doc_id", "base", F.concat("whole", inner).alias("tokens"))
    free = F.filter("tokens", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    found = stage(found.select("doc_id", "base", _tested(free).alias("tests")), "secrets")
    # bands and bins: at most 30 times 301 rows
    counts = [(r.band, r.bin, r["count"]) for r in found.select(F.explode("tests").alias("t")).groupBy(F.col("t.band").alias("band"), F.col("t.bin").alias("bin")).count().collect()]
    cuts = step_up(counts)
    random = lambda m: F.coalesce(*[F.when(m["band"] == b, m["bin"] >= k) for b, k in sorted(cuts.items())], F.lit(False))
    chosen = F.filter("tests", random)
    # a piece of a token that is reported isn't reported again
    longest = F.filter(chosen, lambda m: ~F.exists(chosen, lambda w: (w["s"] <= m["s"]) & (m["e"] <= w["e"]) & (w["e"] - w["s"] > m["e"] - m["s"])))
    more = F.transform(longest, lambda m: F.struct(m["s"].alias("s"), F.lit(3).alias("k"), m["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", more))).alias("spans"))
