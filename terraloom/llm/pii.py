"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone; leftmost, not overlapping within a kind) are always kept. Further candidates are
spans of looser patterns: spelled-out emails, national phone numbers, social security numbers, IBANs, and names (behind a title, or
a listed given name and a surname). On each
candidate and each base span, labelers vote for, against, or not at all:

* ``format``: stricter rules of the pattern (area codes, checksums, domain shape);
* ``gazetteer``: lists (top-level domains, given names, IBAN countries);
* ``context``: words before the span that announce such data, or other things that look like it;
* ``company``: other personal data nearby;
* ``shape``: repeated or counted-up digits speak against.

The votes of all documents are counted by pattern (a table whose size is bounded by the number of vote patterns). Expectation
maximisation on these counts estimates each labeler's reliability (Dawid and Skene's model with two classes) and the
probability of each pattern. A logistic regression over the spans themselves is trained on these probabilities: its features are the
kind, the span's shape and length, and the words and characters around it, hashed to ``FEATURES`` places; so it decides also
where labelers don't vote. It is trained on about ``SAMPLE`` spans of each kind, chosen by a hash of what it sees of them, and decides on each span that isn't
a base span. Everything but the small table, the sample and the model stays distributed.

Defined results: a null text is empty and has no spans; very long texts are scanned whole; repeated rows and ties are judged one by one, alike; an empty table gives an empty result.
Positions are code points, end exclusive. Spans of the method that overlap base spans are dropped. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, stage

KINDS = ("email", "ip", "card", "phone", "spelled_email", "national_phone", "ssn", "iban", "name")
BASE = 4
CONTEXT = 60
#: Places of the classifier's hashed features, spans of a kind that it is trained on, words around a span that it sees.
FEATURES, SAMPLE, AROUND = 1 << 14, 5_000, 3
#: Code points within which another span is company.
NEARBY = 200

EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._+-]{2,40} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,40}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,20}){1,3}(?!\w)")
NATIONAL = re.compile(r"(?<![\w+.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![\w-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
PAIR = re.compile(r"(?<!\w)([A-Z][a-zà-ÿ]{1,20}) (?:[A-Z]\. )?[A-Z][a-zà-ÿ]{1,20}(?!\w)")
NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-zà-ÿ]{1,20}(?: [A-Z][a-zà-ÿ]{1,20})?(?!\w)")
TITLES = ("Mr", "Ms", "Dr", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor")

# Gazetteers and context words.
TLDS = frozenset("com org net edu gov mil int info biz io ai app dev de fr es uk eu co us ca ch at it nl be se no dk fi pl cz pt ie gr ru ua tr il in jp cn kr tw hk sg au nz br mx ar cl za ng ke eg ae sa example test".split())
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark margaret donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward stephanie anna maria peter hans klaus jürgen wolfgang stefan andreas ursula monika petra sabine heike katrin lukas jonas felix laura julia lena sophie marie jean pierre michel philippe alain nicolas françois nathalie isabelle sylvie catherine camille chloé jose josé carmen luis juan antonio manuel francisco javier miguel pedro ana isabel lucía marta pilar elena sofía pablo carlos jorge diego raúl".split()
)
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "PL": 28, "SE": 24, "NO": 15, "DK": 18, "FI": 18, "IE": 22, "GR": 27, "CZ": 24, "LU": 20}
FOR = re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|phone|tel|telephone|call|fax|mobile|card|visa|mastercard|credit|ssn|social security|iban|account|konto|ip|address|host|server|telefon|kontakt|courriel|correo|teléfono|téléphone|name|patient|signed)\b")
AGAINST = re.compile(r"(?i)\b(?:isbn|issn|doi|version|release|invoice|order|part|section|page|figure|table|chapter|serial|id|no|number of|rfc|build)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; looks only around at-signs, so that long words cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(m.span())
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, 0)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def further_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser patterns."""
    out = []
    if " dot " in text or "dot]" in text or "dot)" in text:
        out += [(4, *m.span()) for m in SPELLED.finditer(text)]
    titled = [m.span() for m in NAME.finditer(text)] if any(t in text for t in TITLES) else []
    longest = max((e - s for s, e in titled), default=0)
    out += [(8, *x) for x in titled]
    out += [(8, *m.span()) for m in PAIR.finditer(text) if m[1].lower() in GIVEN and not _overlaps(titled, longest, *m.span())]
    if DIGIT.search(text):
        out += [(5, *m.span()) for m in NATIONAL.finditer(text)] + [(6, *m.span()) for m in SSN.finditer(text)] + [(7, *m.span()) for m in IBAN.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, others: list[int]) -> str:
    """A character for each labeler: + for, - against, 0 no vote. ``others`` are the distinct starts of the document's spans, ascending."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = re.sub("[^0-9]", "", span)
    tail = re.split(r"\.| dot |\[dot\]|\(dot\)", span)[-1].strip().lower()
    if kind in (0, 4):
        form = "+" if tail.isalpha() and 2 <= len(tail) <= 10 else "-"
        known = "+" if tail in TLDS else "-" if kind == 4 else "0"
    elif kind == 1:
        form, known = ("-" if span.startswith("0") or span.endswith(".0") else "+"), "0"
    elif kind == 2:
        form, known = ("+" if len(digits) in (14, 15, 16) else "-"), ("+" if digits[0] in "3456" else "-")
    elif kind in (3, 5):
        form, known = ("+" if 10 <= len(digits) <= 13 else "-"), "0"
    elif kind == 6:
        form, known = ("-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"), "0"
    elif kind == 7:
        plain = span.replace(" ", "")
        value = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        form = "+" if int(value) % 97 == 1 else "-"
        known = "+" if IBAN_LENGTH.get(plain[:2]) == len(plain) else "-"
    else:
        words = span.split()
        titled = any(span.startswith(t.strip()) for t in TITLES)
        form, known = ("+" if titled and len(words) == 3 else "0"), ("+" if words[titled].lower() in GIVEN else "0")
    context = "+" if FOR.search(before) else "-" if AGAINST.search(before) else "0"
    i, j = bisect.bisect_left(others, start), bisect.bisect_right(others, start)  # the nearest starts are the one before i and the one at j
    company = "+" if (i > 0 and start - others[i - 1] <= NEARBY) or (j < len(others) and others[j] - start <= NEARBY) else "0"
    shape = "0" if not digits else "-" if len(set(digits)) <= 2 or digits in "01234567890123456789" else "0"
    return form + known + context + company + shape


KIND = "struct<base:array<struct<k:int,s:int,e:int>>,more:array<struct<k:int,s:int,e:int,p:string,f:array<int>>>,patterns:array<string>,seen:array<struct<p:string,f:array<int>>>>"
_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_SEEN = pa.struct([("p", pa.string()), ("f", pa.list_(pa.int32()))])
_MORE = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("p", pa.string()), ("f", pa.list_(pa.int32()))])
_TYPE = pa.struct([("base", pa.list_(_SPAN)), ("more", pa.list_(_MORE)), ("patterns", pa.list_(pa.string())), ("seen", pa.list_(_SEEN))])

_SHAPES = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}})
_RUNS = re.compile(r"(.)\1+")
_WORD = re.compile(r"\w+")


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Places of what the classifier sees of a span: its kind alone, and by kind its shape and length, its ends, and what is around it."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    shape = _RUNS.sub(r"\1", span.translate(_SHAPES))
    left, right = _WORD.findall(before.lower())[-AROUND:], _WORD.findall(after.lower())[:AROUND]
    named = [f"shape {shape[:24]}", f"length {(end - start) // 4}", f"tail {_WORD.findall(span.lower())[-1:]}", f"head {span[:3].translate(_SHAPES)}", f"before {before[-1:].translate(_SHAPES)}", f"after {after[:1].translate(_SHAPES)}"]
    named += [f"left {w}" for w in left] + [f"right {w}" for w in right] + [f"next to {left[-1:]}"]
    return [kind, *sorted({len(KINDS) + zlib.crc32(f"{kind} {x}".encode()) % (FEATURES - len(KINDS)) for x in named})]


def size_class(kind: int, start: int, end: int) -> int:
    return min(3, (end - start) // 12)


def scan(text: str | None) -> dict:
    """Base spans, further candidates, the vote patterns of all of them, and those with what the classifier is trained on."""
    if not text:
        return {"base": [], "more": [], "patterns": [], "seen": []}
    base = sorted(base_spans(text))
    taken = sorted((s, e) for _, s, e in base)
    longest = max((e - s for s, e in taken), default=0)
    further = [c for c in further_spans(text) if not _overlaps(taken, longest, c[1], c[2])]
    if not base and not further:
        return {"base": [], "more": [], "patterns": [], "seen": []}
    others = sorted({s for _, s, _ in base} | {s for _, s, _ in further})
    pattern = lambda k, s, e: f"{k}|{votes(text, k, s, e, others)}|{size_class(k, s, e)}"
    more = [{"k": k, "s": s, "e": e, "p": pattern(k, s, e), "f": features(text, k, s, e)} for k, s, e in sorted(further)]
    seen = [{"p": pattern(k, s, e), "f": features(text, k, s, e)} for k, s, e in base] + [{"p": m["p"], "f": m["f"]} for m in more]
    return {"base": [{"k": k, "s": s, "e": e} for k, s, e in base], "more": more, "patterns": [x["p"] for x in seen], "seen": seen}


def _overlaps(taken: list[tuple[int, int]], longest: int, start: int, end: int) -> bool:
    """Whether a span overlaps one of ``taken`` (sorted); none of them is longer than ``longest``, so none that starts farther before reaches it."""
    i = bisect.bisect_left(taken, (start - longest,))
    while i < len(taken) and taken[i][0] < end:
        if taken[i][1] > start:
            return True
        i += 1
    return False


def _scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([scan(t) for texts in sliced(b) for t in texts], type=_TYPE)


#: What is assumed of a labeler's votes (+, -) before any is seen, by class, and how many votes that is worth.
PRIOR, PRIOR_VOTES = np.array([[0.85, 0.15], [0.25, 0.75]]), 20


def reliabilities(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """EM over vote patterns (``kind|votes|size``): probability of each, and P(vote | class) by labeler, class (0: personal data), vote (+, -).

    A labeler that doesn't vote says nothing about the class: whether it votes depends on the kind above all.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    kinds = np.array([int(k.split("|")[0]) for k in keys])
    v = np.array([["+-0".index(c) for c in k.split("|")[1]] for k in keys])
    share = np.where(np.arange(len(KINDS)) < BASE, 0.9, 0.5)  # what the base patterns find is mostly what they look for
    prior = share.copy()
    like = np.repeat(PRIOR[None], v.shape[1], axis=0)
    for _ in range(rounds):
        p = np.stack([share[kinds], 1 - share[kinds]], axis=1)
        for j, own in enumerate(like):
            p = p * np.concatenate([own, np.ones((2, 1))], axis=1)[:, v[:, j]].T
        p /= p.sum(axis=1, keepdims=True)
        new = np.empty_like(like)
        for j in range(len(like)):
            for c in (0, 1):
                w = np.array([(n * p[:, c])[v[:, j] == x].sum() for x in (0, 1)]) + PRIOR_VOTES * PRIOR[c]
                new[j, c] = w / w.sum()
        for k in range(len(KINDS)):
            m = kinds == k
            share[k] = ((n * p[:, 0])[m].sum() + 10 * prior[k]) / (n[m].sum() + 10)
        moved, like = np.abs(new - like).max(), new
        if moved < 1e-7:
            break
    return {k: float(x) for k, x in zip(keys, p[:, 0], strict=True)}, like


def train(rows: list[tuple[list[int], float, float]], rounds: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on (features, probability, count), by gradient steps scaled by each weight's past ones."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    own = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    place = np.concatenate([np.array(f) for f, _, _ in rows])
    y, n = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows], dtype=float)
    n /= n.sum()
    past = np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        z = np.bincount(own, w[place], len(rows))
        off = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.bincount(place, off[own], FEATURES) + ridge / len(rows) * w
        past += slope**2
        w -= 0.5 * slope / np.sqrt(past)
    return np.round(w, 9)


def _decide(weights: np.ndarray, spark):
    shared = spark.sparkContext.broadcast(weights)
    kind = pa.list_(_SPAN)

    @F.arrow_udf("array<struct<k:int,s:int,e:int>>")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for b in batches:
            yield pa.array([[{"k": m["k"], "s": m["s"], "e": m["e"]} for m in own or () if w[m["f"]].sum() >= 0] for own in b.to_pylist()], type=kind)

    return decide


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spark = docs.sparkSession
    small_batches(spark)
    found = stage(docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(_scanned, KIND)(F.col(text).cast("string")).alias("f")), "pii")
    # one row for each pattern: 9 kinds, 3^5 votes and 4 sizes at most
    counts = {r.p: r["count"] for r in found.select(F.explode("f.patterns").alias("p")).groupBy("p").count().collect()}
    soft, _ = reliabilities(counts) if counts else ({}, None)
    # what the classifier sees of a span, counted; of each kind, about SAMPLE spans by hash
    every = [sum(n for p, n in counts.items() if int(p.split("|")[0]) == k) for k in range(len(KINDS))]
    of_kind = F.get(F.array(*[F.lit(max(n, 1)) for n in every]), F.get("x.f", F.lit(0)))
    seen = found.select(F.explode("f.seen").alias("x")).where(F.pmod(F.xxhash64("x.p", "x.f"), of_kind) < SAMPLE)
    sample = seen.groupBy("x.p", "x.f").count().collect()
    weights = train(sorted((list(r.f), soft[r.p], float(r["count"]) ** 0.5) for r in sample))  # the root, lest one line that is repeated outweighs all
    spans = "array<struct<k:int,s:int,e:int>>"
    judged = F.when(F.size("f.more") > 0, _decide(weights, spark)(F.col("f.more"))).otherwise(F.array().cast(spans))
    found = found.select("doc_id", "f", judged.alias("kept"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("f.base", lambda m: m["k"] == k)).cast("bigint")
    both = F.array_sort(F.concat(F.col("f.base"), F.col("kept")))
    return found.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(BASE)], F.sha2(joined(F.array_sort("f.base")).cast("binary"), 256).alias("base_sha256"), joined(both).alias("spans"))
