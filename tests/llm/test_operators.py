import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import decontam, license_scan, merkle, mixing, neardup, pii, queries, secret_scan, tokenfile, toxicity, urlfilter
from terraloom.llm.common import table, tokenizer_path

from . import brute

SF = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


# ---- 1


def test_decontaminate_against_brute_force(spark, docs, texts):
    bench = table(spark, SF, "benchmark")
    item = bench.first()
    extra = spark.createDataFrame([(10**6, "start " + item.text + " end"), (10**6 + 1, "Tiny item"), (10**6 + 2, "a b tiny item c")], "doc_id bigint, text string")
    items = bench.unionByName(spark.createDataFrame([(999, "tiny ITEM!"), (998, None), (997, " ")], "item_id bigint, text string"))
    found = {r.doc_id: r for r in decontam.decontaminate(docs.select("doc_id", "text").unionByName(extra), items).collect()}
    windows = {}
    for r in items.collect():
        w = brute.words(r.text)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(str(r.item_id))
    for d, t in {**texts, **{r.doc_id: r.text for r in extra.collect()}}.items():
        w, hit, ids = brute.words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        assert tuple(found[d])[1:] == (len(w), len(hit), len(ids), sha(sorted(ids)), len(ids) >= 2)


def test_wu_manber_finds_overlaps():
    s = decontam.WuManber([b" a b a ", b" b a b "], 3)
    raw = b" a b a b a "
    assert sorted(s.find(raw + b"\0" * 8)) == [(0, 0), (2, 1), (4, 0)]


def test_shards_of_items_agree(spark, docs):
    bench = table(spark, SF, "benchmark")
    one, many = decontam.decontaminate(docs, bench), decontam.decontaminate(docs, bench, shard_bytes=3000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


# ---- 2 and 4


def test_personal_data_against_brute_force(spark, docs, texts):
    more = {10**6: "a@b.c_d@e.f g@h i.j@k-l.m.n", 10**6 + 1: "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.2.3.4", 10**6 + 2: "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (555) 123-4567 +12", 10**6 + 3: "9" * 5000}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    for r in pii.personal_data(both).collect():
        base = brute.personal({**texts, **more}[r.doc_id])
        assert r.base_sha256 == sha(base) and set(base) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]


def test_weak_supervision_accepts_what_labelers_back(spark):
    good = [(i, f"please call our phone line at (212) 555-01{i:02d} or mail me at x{i}@mail.example.com today") for i in range(60)]
    bad = [(100 + i, f"order number 212-555-11{i:02d}") for i in range(30)]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(good + bad, "doc_id bigint, text string")).collect()}
    assert all("national_phone" in found[i].spans for i, _ in good)
    soft, like = pii.reliabilities({"5|++++0|1": 50, "5|-0-0-|1": 50})
    assert soft["5|++++0|1"] > 0.9 > 0.1 > soft["5|-0-0-|1"] and np.allclose(like.sum(axis=2), 1)


def test_planted_personal_data_is_added_and_look_alikes_are_not(spark):
    rng = random.Random(4)
    n = lambda a, b: rng.randrange(a, b)
    good = [
        lambda: ("ssn", f"her social security number {n(100, 660)}-{n(10, 99)}-{n(1000, 9999)} is on file, mail a{n(1, 999)}@mail.example.com"),
        lambda: ("national_phone", f"call {rng.choice(['us', 'me'])} by phone: ({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}"),
        lambda: ("spelled_email", f"contact bob{n(1, 99)} at example{n(1, 9)} dot com for help"),
        lambda: ("name", f"the patient {rng.choice(['Maria', 'Peter', 'Anna', 'Hans'])} {rng.choice(['Keller', 'Smith', 'Novak', 'Ortega'])} was seen"),
    ]
    bad = [
        lambda: ("ssn", f"part number 000-{n(10, 99)}-0000 section {n(1, 9)}"),
        lambda: ("national_phone", f"order no {n(200, 999)}-{n(200, 999)}-1111 and version {n(1, 9)}"),
    ]
    made = [rng.choice(good)() + (True,) if i % 3 else rng.choice(bad)() + (False,) for i in range(900)]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(made)], "doc_id bigint, text string")).collect()}
    hit = [k in found[i] for i, (k, _, _) in enumerate(made)]
    assert np.mean([h for h, (_, _, y) in zip(hit, made, strict=True) if y]) > 0.9
    assert np.mean([h for h, (_, _, y) in zip(hit, made, strict=True) if not y]) < 0.1


def test_the_classifier_sees_the_surroundings():
    rows = [(pii.features(f"call {x} now", 5, 5, 17), 0.95, 1.0) for x in ["212-555-0100", "313-555-0199"]] + [(pii.features(f"item {x} lot", 5, 5, 17), 0.05, 1.0) for x in ["212-555-0100", "313-555-0199"]]
    w = pii.train(rows)
    assert w[pii.features("call 414-555-0123 now", 5, 5, 17)].sum() > 0 > w[pii.features("item 414-555-0123 lot", 5, 5, 17)].sum()
    assert pii._overlaps([(0, 100), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14)], 100, 50, 60) and not pii._overlaps([(0, 3), (70, 80)], 10, 3, 70)


def test_company_is_exact_in_long_documents():
    line = "please call our phone line at (212) 555-0142 or mail x@mail.example.com today" + "." * 400 + "\n"
    alone, many = pii.scan(line), pii.scan(line * 3000)
    assert len(many["more"]) == 3000 and {m["p"] for m in many["more"]} == {m["p"] for m in alone["more"]} == {"5|+0++0|1"}
    assert set(many["patterns"]) == set(alone["patterns"])
    found = pii.scan("\n".join(f"x{i}@a.example.com" + "." * (i % 7 * 50) for i in range(500)))
    starts = [m["s"] for m in found["base"]]
    assert [v.split("|")[1][3] for v in found["patterns"]] == ["+" if any(0 < abs(o - s) <= 200 for o in starts) else "0" for s in starts]


def test_secrets_against_brute_force(spark, docs, texts):
    more = {10**6: "token=token: abcdefg Secret : 'a.b/c=d_e' API_KEY=\"short\" apikey==abcdef", 10**6 + 1: "AKIA" + "A" * 16 + " AKIASHORT " + "0123456789abcdef" * 2, 10**6 + 2: "é\n" * 50 + "password=hunter22"}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    for r in secret_scan.scan_secrets(both).collect():
        base = brute.secrets({**texts, **more}[r.doc_id])
        assert r.base_sha256 == sha(base) and set(base) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]


def test_random_tokens_are_told_from_words(spark):
    import base64

    rng = random.Random(1)
    tokens = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(40)]
    plain = ["thisisaverylongidentifierwithwords123andmoreandmore", "the/path/to/some/file/in/the/system/v1/readme", "a1" * 40]
    found = [r.spans for r in rows_of(secret_scan.scan_secrets(spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(tokens + plain)], "doc_id bigint, text string")))]
    assert sum("random" in s for s in found[:40]) >= 36 and not any("random" in s for s in found[40:])
    assert secret_scan.step_up([("b", 100, 5), ("b", 0, 95)]) == {"b": 100}


def test_random_tokens_behind_names_and_short_ones(spark):
    import base64

    rng = random.Random(2)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    makes = [lambda: base64.b64encode(rng.randbytes(28)).decode(), lambda: draw("0123456789ABCDEF", 32), lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), lambda: draw("0123456789ABCDEF", 20), lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 22)]
    values = [m() for m in makes for _ in range(40)]
    heads = ["AWS_SECRET_ACCESS_KEY=", "sig=", "x ", "/srv/deploy/releases/of/the/current/application/"]
    texts = [heads[i % 4] + v for i, v in enumerate(values)]
    plain = ["INVOICENUMBERFORCLIENT25", "getUserAccountInfoV2", "1234567890123456789A", "the/path/to/file/v1x", "sha256WithRSAEncryption", "AWS_SECRET_ACCESS_KEY_NUMBER_2=value", "lib/python3/site/packages"]
    found = [r.spans for r in rows_of(secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))]
    hit = [f"random:{len(t) - len(v)}:{len(t)}" in s or (t[0] == "/" and "random" in s) for t, v, s in zip(texts, values, found, strict=False)]
    for j in range(5):
        assert sum(hit[40 * j : 40 * j + 40]) >= 34, j
    # by themselves, as in ordinary text: among many random tokens of a length, the step-up asks for more evidence
    assert not any("random" in r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(plain)), "doc_id bigint, text string")).collect())


def plain_p_value(token, enc):
    """The battery and the text model's p-value in plain Python."""
    alphabet = secret_scan.ALPHABETS[enc]
    own, stay, leave, mean, variance, cov = secret_scan.text_model(enc)
    r, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi, d = sum(c * c for c in Counter(r).values()) * k / n - n, k - 1
    chi_p = tail(((max(chi, 1e-9) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    middle = (k - 1) / 2
    runs = 1 + sum((a > middle) != (b > middle) for a, b in itertools.pairwise(r))
    high = sum(x > middle for x in r)
    expected = 2 * high * (n - high) / n + 1
    runs_p = 2 * tail(abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9)))
    cross, square = sum((a - middle) * (b - middle) for a, b in itertools.pairwise(r)), sum((x - middle) ** 2 for x in r)
    serial_p = 2 * tail(abs(cross / max(square, 1e-9)) * math.sqrt(n))
    kind = secret_scan._class
    odds = sum(own[b] + (stay if kind(alphabet[a]) == kind(alphabet[b]) else leave) for a, b in itertools.pairwise(r))
    odds_p = tail((odds - (n - 1) * mean) / math.sqrt((n - 1) * variance + 2 * (n - 2) * cov))
    text_mean, text_variance = secret_scan.text_odds(enc)
    return 1.0 if 4 * min(chi_p, runs_p, serial_p, odds_p) < secret_scan.ALPHA else tail(((n - 1) * text_mean - odds) / math.sqrt((n - 1) * text_variance) / secret_scan.SPREAD[enc])


def test_p_values_against_plain_python(spark):
    rng, F = random.Random(8), secret_scan.F
    rows = [("".join(rng.choice(a) for _ in range(rng.randrange(20, 90))), e) for e, a in secret_scan.ALPHABETS.items() for _ in range(40)]
    rows += [("lib/python3/site/packages", "base64"), ("a1" * 40, "hex"), ("INVOICENUMBERFORCLIENT25", "base32"), ("a" * 30, "base64")]
    for r in spark.createDataFrame(rows, "t string, e string").select("t", "e", secret_scan._p_value(F.col("t"), F.col("e")).alias("p")).collect():
        assert r.p == pytest.approx(plain_p_value(r.t, r.e), rel=0.02, abs=1e-7), r.t


def test_planted_tokens_are_added_and_text_is_not(spark):
    rng = random.Random(9)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["user_profile_image_2019_11_05_final", "com/example/app/MainActivity2", "node_modules/lodash4/fp/_mapping", "section4subsection12paragraph3", "getUserAccountInformationV2", "x86_64-unknown-linux-gnu"]
    rows = [(i, "see " + (names[i % 6] + f"{i}" if i % 3 else "".join(rng.choice(alnum) for _ in range(rng.randrange(24, 44)))) + " for more") for i in range(600)]
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    planted = sum(found[i] == f"random:4:{len(t) - 9}" for i, t in rows if i % 3 == 0)
    false = sum(bool(found[i]) for i, _ in rows if i % 3)
    assert planted >= 180 and false <= 0.05 * (planted + false) + 3


def test_positions_of_very_many_matches(spark):
    text = "".join(f"é{i % 10} " + "0123456789abcdef" * 2 + "\n" for i in range(3000))
    r = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r.n_hex == 3000 and r.base_sha256 == sha(brute.secrets(text))


# ---- 3


def test_licenses(spark, docs, texts):
    for r in license_scan.scan_licenses(docs).collect():
        names = {x.split(":")[0] for x in r.licenses.split(",") if x}
        assert names >= {n for n, s in license_scan.TEMPLATES.items() if s in texts[r.doc_id]}
        assert r.n_licenses == len(names)
    mit = license_scan.TEMPLATES["MIT"].split()
    cases = [(1, " ".join([f"w{i}" for i in range(500)] + mit + [f"x{i}" for i in range(500)])), (2, " ".join(w if i % 25 else "zzz" for i, w in enumerate(mit))), (3, " ".join(mit[:20]))]
    found = rows_of(license_scan.scan_licenses(spark.createDataFrame(cases, "doc_id bigint, text string")))
    assert [r.licenses.split(":")[0] for r in found] == ["MIT", "MIT", ""]
    assert 1 - (1 - 0.3) ** license_scan.bands_needed(0.3) >= license_scan.FOUND


def test_license_recall_over_all_windows(spark, monkeypatch):
    """Copies altered at random, against the exact containment of each template in each window of each text."""
    rng, F = random.Random(6), license_scan.F
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    triples = lambda t: [tuple(x) for x in zip(*(w[k:] for k in range(3)))] if len(w := word.findall(t.translate(brute.LOW))) >= 3 else []
    rows, names = [], sorted(license_scan.TEMPLATES)
    for i in range(400):
        w = license_scan.TEMPLATES[names[i % len(names)]].split()
        for _ in range(rng.randrange(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(150))] + w + [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(150))])))
    own = {n: set(triples(t)) for n, t in license_scan.TEMPLATES.items()}
    templates = spark.createDataFrame([(len(t),) for t in own.values()], "n int").select(F.expr("sequence(1, n)").alias("t"))
    strides = {end: stride for end, stride, _ in license_scan.length_classes(templates, 0.8, 0.99)}
    want = set()
    for i, t in rows:
        h = triples(t)
        for n, x in own.items():
            stride = strides[min(c for c in license_scan.CLASSES if len(x) <= c)]
            if any(len(x & set(h[s : s + 2 * stride])) >= 0.8 * len(x) for s in range(0, max(1, len(h)), stride)):
                want.add((i, n))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = lambda found: {(r.doc_id, x.rsplit(":", 1)[0]) for r in found.collect() for x in r.licenses.split(",") if x}
    found = of(license_scan.scan_licenses(df))
    assert found <= want and len(found) >= 0.99 * len(want) > 200
    monkeypatch.setattr(license_scan, "FILTER_KEYS", 0)
    monkeypatch.setattr(license_scan, "BROADCAST_SHINGLES", 0)
    assert of(license_scan.scan_licenses(df)) == found
    none = spark.createDataFrame([(None, "x"), ("short", "two words"), ("null", None)], license_scan.TEMPLATE_SCHEMA)
    assert {(r.n_licenses, r.licenses, r.best) for r in license_scan.scan_licenses(df, none).collect()} == {(0, "", None)}


def test_licenses_with_words_inserted_at_any_place(spark):
    mit = license_scan.TEMPLATES["MIT"].split()
    # words inserted at four places break eight shingles of some sixty, and make the copy longer than the template
    copy = [x for i, w in enumerate(mit) for x in ([w, "zq1", "zq2", "zq3"] if i in (1, 14, 28, len(mit) - 4) else [w])]
    cases = [(n, " ".join([f"w{i}" for i in range(n)] + copy + [f"x{i}" for i in range(200)])) for n in range(90)]
    found = rows_of(license_scan.scan_licenses(spark.createDataFrame(cases, "doc_id bigint, text string")))
    assert len({r.licenses for r in found}) == 1 and found[0].licenses.startswith("MIT:0.8")


# ---- 5


def test_merkle_edits(spark, docs, texts):
    ids = sorted(texts)
    found = {r.doc_id: r for r in merkle.compare_edits(docs).collect()}
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, k, r = texts[d], len(texts[d]) // 4, found[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + texts[after][:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = Counter(r.fingerprint for r in found.values())
    assert len(prints) == len(set(texts.values()))
    assert np.median([r.near_edited for r in found.values()]) > 0.5 > np.quantile([r.near_next for r in found.values()], 0.9)


def plain_tree(text):
    """The fingerprint, and its leaves with their lengths, in plain Python."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()[:32]
    named = lambda x: digest(x) + ":" + x
    leaf = re.compile(r"(?s)[^.!?;|]{1,60}[.!?;|]{0,60}\s?|[.!?;|]{1,60}\s?")
    own = {}

    def paragraph(p):
        found = leaf.findall(p)
        own.update((x, len(x)) for x in found)
        assert "".join(found) == p
        return named(",".join(f"{digest(x)}.{len(x)}" for x in found))

    sections = "/".join(named(";".join(map(paragraph, s.split("\n")))) for s in text.split("\n\n"))
    return digest(sections) + "|" + sections, own


def test_merkle_against_plain_trees(spark, docs, texts):
    ids = sorted(texts)
    found = {r.doc_id: r for r in merkle.compare_edits(docs).collect()}
    like = lambda a, b: 1.0 if a == b else sum(a[1][x] for x in a[1].keys() & b[1].keys()) / max(1, sum({**a[1], **b[1]}.values()))
    trees = {d: plain_tree(t) for d, t in texts.items()}
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, k, r = texts[d], len(texts[d]) // 4, found[d]
        edited = plain_tree(t[: len(t) - k] + texts[after][:k])
        assert (r.fingerprint, r.edited_fingerprint) == (trees[d][0], edited[0])
        assert r.near_edited == pytest.approx(like(trees[d], edited)) and r.near_next == pytest.approx(like(trees[d], trees[after]))


def test_merkle_branches(spark):
    a, b = "One. Two.\nThree.\n\nFour.\nFive.", "One. Two.\nThree.\n\nFour.\nSix."
    r = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(merkle.F.col("a")).alias("a"), merkle.fingerprint(merkle.F.col("b")).alias("b"))
    assert r.select(merkle.differing_sections(merkle.F.col("a"), merkle.F.col("b")).alias("d")).first().d == ["1.1"]


def test_next_ids(spark):
    ids = [5, -7, 0, 10**15, 4095, 4096, 2**40, 5]
    found = {r.doc_id: r.next_id for r in merkle.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id bigint")).collect()}
    order = sorted(set(ids))
    assert found == dict(zip(order, order[1:] + order[:1], strict=True))


# ---- 6


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = {-1: "don't  stop\n\n\tit's½ ²x café\u0301 __a__ \u00a0 x\x1cy <|endoftext|>", -2: "", -3: " lead\n", -4: "日本語 1½ naïve"}
    tokenfile.write_token_files(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(odd.items()), "doc_id bigint, text string")), f"file://{tmp_path}/t", tokenizer=path, parts=3)
    at, all_texts = 0, {**odd, **texts}
    found = {r.doc_id: r for r in tokenfile.read_token_files(spark, f"file://{tmp_path}/t", ids=True).collect()}
    for d in sorted(all_texts):
        ids = np.array([*t.encode(all_texts[d], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), d
        at += len(ids)
    assert tokenfile.read_document(spark, f"file://{tmp_path}/t", -1) == [found[-1].ids]
    assert 50256 in found[-1].ids  # the library gives an added token's string that token's id


def test_a_hot_doc_id_is_split(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)] + [(20, f"another text {i} of the hot one") for i in range(400)]
    tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/t", tokenizer=tokenizer_path("byte_bpe_50k.json"), parts=8)
    blocks = spark.read.parquet(f"file://{tmp_path}/t/blocks").groupBy("part").agg({"n_docs": "sum"}).collect()
    assert max(r[1] for r in blocks) < 200
    found = sorted(tokenfile.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert [r.start for r in found] == [0, *itertools.accumulate(r.n_tokens for r in found)][:-1]


# ---- 7


def test_near_duplicates_against_brute_force(spark, docs, texts):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    more = {}
    for i in range(300):  # a large group of near copies, and copies among them
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        more[10**6 + i] = " ".join(w)
    everything = {**texts, **more}
    found = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(list(everything.items()), "doc_id bigint, text string")).collect()}
    pairs = brute.links(everything)
    degree = Counter(x for p in pairs for x in p)
    parent = {d: d for d in everything}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for d, t in everything.items():
        if brute.words(t):
            assert (found[d].n_links, found[d].class_id) == (degree[d], root(d))


def test_blocks_of_large_groups_agree(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"e{rng.random()}" for w in base)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, neardup.near_duplicates(df).select("doc_id", "class_id", "n_links").collect()))
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "TILE", 16)
    assert sorted(map(tuple, neardup.near_duplicates(df).select("doc_id", "class_id", "n_links").collect())) == whole


def test_runs_reach_the_recall():
    n = neardup.runs_needed(0.8, neardup.RECALL)
    assert n <= neardup.COORDINATES and 0.55 < neardup.least_agreement(0.8) < 0.7
    assert neardup.found_at(0.8, 1) == 0.8 and 0.2 < neardup.found_at(0.8, neardup.DEPTH) < 0.5


def near_copies(n, words=160, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_rows_of_near_copies_grow_in_proportion(spark, monkeypatch):
    staged, stage = [], neardup.stage

    def counted(df, name, *a):
        out = stage(df, name, *a)
        staged[-1] += out.count()
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    for n in (300, 600, 1200):
        staged.append(0)
        neardup.near_duplicates(spark.createDataFrame(near_copies(n), "doc_id bigint, text string"))
    assert staged[1] < 2.4 * staged[0] and staged[2] < 2.4 * staged[1]


def rows_generated(spark, word, since):
    """Rows that Spark counted at the Generate nodes with this word, in executions after ``since``; and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for i in (runs.apply(k).executionId() for k in range(runs.size())):
        last = max(last, i)
        if i > since:
            values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if node.name() == "Generate" and word in node.desc():
                    for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                            rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows, last


def test_rows_below_large_buckets_are_made_once_and_in_proportion(spark, monkeypatch):
    due, stage = [], neardup.stage

    def counted(df, name, *a):
        out = stage(df, name, *a)
        if name.startswith("judged"):
            due[-1] += out.where("stays").select(F.sum(F.size(neardup._children(F.col("path"), neardup.THRESHOLD)))).first()[0] or 0
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    rng = random.Random(6)
    line = [f"c{i}" for i in range(60)]  # every text has a line of two fifths of its words, so it stays in the large buckets
    for n in (600, 1200):
        texts = [(i, " ".join([*line, *(f"u{rng.randrange(10**9)}" for _ in range(90))])) for i in range(n)]
        due.append(0)
        before = rows_generated(spark, "fork", -1)[1]
        neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"))
        assert rows_generated(spark, "fork", before)[0] == due[-1] > n
    assert due[1] < 2.4 * due[0]


def test_pairs_at_the_threshold_within_a_large_bucket_are_found(spark):
    rng = random.Random(2)
    line, rows, texts = [f"c{i}" for i in range(60)], [], {}
    for p in range(600):  # every text has a line of a third of its words
        w = [f"u{rng.randrange(10**9)}" for _ in range(85)]
        v = [*w[:40], "new", *w[41:70], f"other{p}", *w[71:]]
        texts |= {2 * p: " ".join(line + w), 2 * p + 1: " ".join(line + v)}
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    pairs = {(2 * p, 2 * p + 1) for p in range(600) if len(brute.shingles(texts[2 * p]) & brute.shingles(texts[2 * p + 1])) >= 0.8 * len(brute.shingles(texts[2 * p]) | brute.shingles(texts[2 * p + 1]))}
    found = sum(r.n_links for r in rows) / 2
    assert len(pairs) == 600 and 0.9 * len(pairs) <= found <= len(pairs)


def test_components_fail_loudly(spark):
    chain = spark.createDataFrame([(i.to_bytes(4, "big"), (i + 1).to_bytes(4, "big")) for i in range(40)], "a binary, b binary")
    assert neardup.components(chain).select("root").distinct().count() == 1
    with pytest.raises(RuntimeError):
        neardup.components(chain, rounds=1)


# ---- 8


def test_url_rules_by_either_way(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://com/en/", "ftp://xcom/en/1", "no scheme", None, "http://example.net/de/8/9", "http://b.net/de/9#x", "x://a.org", "x://a..org/es/", "http://example.com:80/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = spark.createDataFrame(queries.URL_RULES, urlfilter.RULE_SCHEMA)
    a = sorted(map(tuple, urlfilter.judge_urls(pages, rules).collect()))
    b = sorted(map(tuple, urlfilter.judge_urls(pages, rules, broadcast_rules=0).collect()))
    assert a == b
    assert [(r[3], r[4]) for r in a] == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "block"), (None, "allow"), ("org/es/", "block"), (None, "allow")]
    assert {r[4] for r in urlfilter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_of_the_contract(spark):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://b.net/de/9", "http://example.net/de/8", "http://x.org/es/"]
    found = urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), spark.createDataFrame(queries.URL_RULES, urlfilter.RULE_SCHEMA)).collect()
    assert [(r.rule, r.verdict) for r in sorted(found)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_odd_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, urlfilter.RULE_SCHEMA)
    long = "http://" + "a." * 20_000 + "net/de/" + "x" * 50_000
    schema = "page_id bigint, url string, host string, path string, head string, start string, n string, h string, best string"
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "http://net/de/"), (6, "HTTP://X.NET"), (7, "://")]
    pages = spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], schema)
    found = urlfilter.judge_urls(pages, rules).collect()
    assert Counter((r.page_id, r.verdict) for r in found) == Counter([(1, "allow"), (2, "allow"), (3, "block"), (4, "block"), (4, "block"), (None, "block"), (6, "allow"), (7, "allow")])
    assert {(r.host, r.path) for r in found if r.page_id in (1, 2, 7)} == {("", "")}
    assert urlfilter.judge_urls(pages.limit(0), rules).collect() == []


def test_hot_urls_by_shuffle_and_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 5 and i}.com/en/{i}") for i in range(3000)]
    pages, rules = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(queries.URL_RULES, urlfilter.RULE_SCHEMA)
    whole = sorted(map(tuple, urlfilter.judge_urls(pages, rules).collect()))
    join = urlfilter.join_hot
    monkeypatch.setattr(urlfilter, "join_hot", lambda *a: join(*a, most=50))  # above 60 rows a key is hot
    assert sorted(map(tuple, urlfilter.judge_urls(pages, rules).collect())) == whole and len(whole) == 3000


# ---- 9


def test_mix(spark, docs):
    found = mixing.mix(docs).collect()
    sources = {r.doc_id: r.source for r in docs.collect()}
    sums, target = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        sums[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    total = sum(r.size for r in found)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(sums[s] - t) <= 4 * mixing.BLOCK for s, t in target.items())
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect())) == sorted(map(tuple, found))


def test_many_sources_are_mixed_alike(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 97), f"s{min(i % 40, 30):02d}") for i in range(2000)] + [(10000, "w " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = sorted(map(repr, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(df).collect())) == found


def test_mixed_documents_are_repeated(spark, docs):
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    times = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(abs(times[d] - r.taken / r.size) <= 0.5 for d, r in taken.items() if r.size)


# ---- 10


def test_toxicity_holds_out(spark):
    sf = "/root/testdata/sf0.1"  # 120 toxic rows held out; the smaller tables have too few to tell
    found = toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    p, n = [r.score for r in found if r.held_out and r.toxic], [r.score for r in found if r.held_out and not r.toxic]
    assert np.mean([(a > b) + (a == b) / 2 for a in p for b in n]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_toxicity_learns_from_all_labels(spark):
    # three rows of 20,000 have the rare insult: a sample misses it
    texts = [(i, "such an idiot of this town" if i % 10 == 0 else "such an hour of this town") for i in range(20_000)] + [(20_000 + i, "such an blorgface of this town") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(text not like '%hour%') as toxic")
    learned = [r.doc_id for r in docs.where("doc_id >= 20000").where(~toxicity.held_out(toxicity.F.col("doc_id"))).orderBy("doc_id").limit(3).collect()]
    some = labels.where(toxicity.F.col("doc_id").isin(learned) | (toxicity.F.col("doc_id") < 20_000))
    g = toxicity.fit(docs, some)
    assert g.weight("blorgface") > 2 and g.score("what a blorgface") > g.score("what a town")


def test_grammar():
    g = toxicity.Grammar({"idiot": 4.0}, {"scum": 4.0})
    weight = lambda t: g.features(t)[0]
    plain, aimed = weight("what an idiot"), weight("you idiot")
    assert aimed > plain > weight("he said what an idiot") > 0
    assert plain > weight("not idiot") > 0 and weight("scumbag") > 0
    assert weight("kill you") > 0 == weight("kill time") and weight("i will kill all of you") == toxicity.THREAT
    assert weight("he wrote: you idiot") == weight("he wrote you idiot") < aimed  # a colon doesn't end a clause
    assert [w for _, _, w in g.clauses('"what a day. an idiot" an idiot')] == [0.0, plain + toxicity.REPORTED + plain + toxicity.FURTHER]
    assert [w for _, _, w in g.clauses('"an idiot\nan idiot')] == [plain + toxicity.REPORTED, plain]  # a quotation ends with its line
    assert weight("idiot" + " x" * toxicity.TARGET_REACH + " you") == plain and weight("idiot" + " x" * (toxicity.TARGET_REACH - 1) + " you") == aimed
    assert g.features(None) == g.features("") == (0.0, 0.0, 0.0)


def test_best_path_against_all_paths():
    rng, g = random.Random(1), toxicity.Grammar({"idiot": 4.0, "fool": 2.5, "kill": 0.5}, {"scum": 3.0})
    words = ["idiot", "fool", "scumbag", "you", "not", "said", '"', "kill", "burn", "x", "y"]
    for _ in range(150):
        clause, quoted = [rng.choice(words) for _ in range(rng.randrange(1, 8))], rng.random() < 0.3
        best = 0.0
        for choice in itertools.product(*map(g.readings, clause)):  # each way to read the clause goes through the five machines, one after the other
            tapes = [("".join(c for c, _ in choice), sum(w for _, w in choice))]
            for machine in (toxicity.negation(), toxicity.report(quoted), toxicity.target(), toxicity.insult(), toxicity.threat()):
                tapes = [(out, w + v) for tape, w in tapes for out, v in machine.paths(tape)]
            best = max([best, *(w for _, w in tapes)])
        assert g.clause(clause, quoted) == pytest.approx(best), clause
    whole = toxicity.grammar_transducer()
    assert sorted(whole.paths("ITO")) == sorted((o, w) for a, u in toxicity.target().paths("ITO") for o, w in [(a, u)])
    for n in range(6, 12):  # other words beyond every reach are left out
        assert g.clause(["idiot", *"x" * n, "you", "fool"]) == toxicity.automaton(False).best([g.readings(w) for w in ["idiot", *"x" * n, "you", "fool"]])


def test_telling_entries_by_either_way(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["bad", "baddest", "vile"]) if y and rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(12)).replace("w5", "x"), y) for y in [i % 4 == 0 for i in range(800)]]
    df = spark.createDataFrame([(t, int(y)) for t, y in rows], "t string, y int")
    a, b = toxicity._telling(df, 200, 600), toxicity._telling(df, 200, 600, broadcast=0)
    assert a == b and {"vile", "bad*"} <= {e for e, _, _ in a}
    for e, toxic, _ in a:
        own = [y for t, y in rows if any(w == e or (e[-1] == "*" and w.startswith(e[:-1]) and len(w) >= len(e)) for w in toxicity.WORD.findall(t))]
        assert sum(own) == toxic


# ---- odd input


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (None, "two words"), (3, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for run in (
        lambda d: decontam.decontaminate(d, bench),
        pii.personal_data,
        license_scan.scan_licenses,
        secret_scan.scan_secrets,
        merkle.compare_edits,
        tokenfile.encode_documents,
        neardup.near_duplicates,
        mixing.mix,
        lambda d: toxicity.score_documents(d, labels),
    ):
        found = run(odd_docs).collect()
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd_docs.collect())
        assert run(no_docs).collect() == []
    near = {r.doc_id: r for r in neardup.near_duplicates(odd_docs).collect()}
    assert near[1].class_id == near[2].class_id == 1 and near[1].n_links == 2 and near[3].class_id == near[4].class_id == 3


def test_stages_keep_columns(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    for run in (lambda d: toxicity.drop_toxic(d, labels), neardup.drop_near_duplicates, lambda d: decontam.drop_contaminated(d, bench), mixing.mixed_documents):
        found = run(odd_docs)
        assert found.columns == odd_docs.columns and found.count() > 0
        assert run(no_docs).count() == 0
    kept = [r.doc_id for r in neardup.drop_near_duplicates(odd_docs).collect()]
    assert sorted(kept, key=lambda x: (x is None, x or 0)) == [1, 3, 5, 6, 7, 8, 9, None]
    assert Counter(r.doc_id for r in decontam.drop_contaminated(odd_docs, bench).collect())[1] == 0
