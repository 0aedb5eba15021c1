"""Language id, personal data, the language model and near duplicates."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from sitespan.llm import hpylm, langid, neardup, pii
from sitespan.llm.common import held_out
from sitespan.llm.hashing import word_hashes


def sentences(seed, n):
    rng = random.Random(seed)
    langs = {"en": "the of and to in a is that it for on was with".split(), "de": "der die und in den von zu das mit sich des auf für".split(), "fr": "de la le et les des en un du une que est pour".split()}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(langs))
        out.append((i, " ".join(rng.choice(langs[lang]) + rng.choice(["", "x", "e"]) for _ in range(rng.randint(5, 40))), lang))
    return out


def test_language_id(spark, odd, none):
    d = spark.createDataFrame(sentences(1, 600), "doc_id long, text string, lang string")
    model = langid.train(d, ~held_out("doc_id", 5, 0))
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    test = langid.predicted(d.filter(held_out("doc_id", 5, 0)), model).collect()
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in test)
    rows = langid.predicted(odd, model).collect()
    assert len(rows) == odd.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {0, 1, 2} <= und and 5 not in und
    assert langid.predicted(none, model).count() == 0
    empty = langid.train(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predicted(odd, empty).collect()} == {"und"}
    assert langid.kept(odd, model).columns == odd.columns
    assert 0.3 < model.zero < 1  # the penalties leave few weights


def test_language_frequencies_are_of_all_texts(spark):
    texts = [t for _, t, _ in sentences(3, 40)]
    got = langid.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(1 << langid.BITS, int)
    for t in texts:
        want[np.unique(langid.places(t))] += 1
    assert (got == want).all()


def test_temperature_follows_held_apart_errors():
    """Of labels that are wrong a third of the time, the model is about as unsure on new texts as it is often wrong."""
    rng = random.Random(4)
    noisy = lambda rows: [(t, lang if rng.random() < 0.67 else rng.choice(["en", "de", "fr"])) for _, t, lang in rows]
    m = langid.fit(noisy(sentences(9, 900)))
    new = noisy(sentences(10, 900))
    sure = np.mean([m.predict(t)[1] for t, _ in new])
    right = np.mean([m.predict(t)[0] == lang for t, lang in new])
    assert abs(sure - right) < 0.15


def test_rare_labels_are_learned(spark):
    rows = [(i, f"zu{i % 7}ab der die", f"l{i % 230:03d}") for i in range(460)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(m.languages) == 230


def test_one_language_only():
    m = langid.fit([("abc def", "en"), ("ghi", "en")])
    assert m.predict("xyz") == ("en", 1.0) and m.predict("123")[0] == "und"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_fixed_kinds_against_regular_expressions(spark, odd, none):
    rng = random.Random(11)
    parts = ["a.b", "@", "c.com", ".", "-", "_", "10.0.0.1", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-1234", "+49.30", "12", " ", "é", "𝒳", "\n", "x@y.z_d@e.f", "%+", "(", ")"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for got, (_, text) in zip(pii.personal_data(d).orderBy("doc_id").collect(), rows, strict=True):
        for kind, want in plain_pii(text).items():
            assert [(m["start"], m["end"]) for m in got[kind]] == want, (kind, text)
    got = pii.personal_data(odd)
    assert got.count() == odd.count() and pii.personal_data(none).count() == 0


def test_long_runs_stay_linear(spark):
    texts = ["9" * 200_000, "a" * 200_000, "1 " * 100_000, "a@" * 50_000, "1.2." * 50_000, "+1" * 50_000, "a.b@c.de " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(d).collect()}
    assert len(rows[6]["email"]) == 3000 and not rows[1]["email"]


def test_masking(spark):
    d = spark.createDataFrame([(1, "write to a.b@c.de or +1 (555) 555-1234!", "x"), (2, None, "y"), (3, "né 10.0.0.1", None)], "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in pii.masked(d).collect()}
    assert got[1]["text"] == "write to [EMAIL] or [PHONE]!" and got[2]["text"] is None and got[3]["text"] == "né [IP]" and got[1]["row"] == "x"


def test_weak_supervision_learns_which_labeler_to_trust():
    rows = [("number", 1, 1, 1, 10, 400), ("number", 1, 1, 0, 10, 300), ("number", -1, 0, 0, 8, 3000), ("number", -1, 0, -1, 8, 900), ("number", 0, 0, 1, 9, 20)]
    like, reliability = pii.expectation_maximisation(rows)
    assert like[0] > 0.95 and like[1] > 0.9 and like[2] < 0.1 and like[3] < 0.05
    assert all(0 < v < 1 for v in reliability.values())
    model = pii.classifier(rows)
    assert model.odds["number", "form", 1] > 0 > model.odds["number", "form", -1]
    assert pii.classifier([]).start == {}


def test_classifier_adds_spans(spark):
    """Planted spans of every loose kind, and number-like decoys; the classifier alone decides."""
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    words = lambda n: " ".join(pick(*"sand river stone window paper garden".split()) for _ in range(n))
    kinds = {
        "number": lambda i: f"{pick('phone', 'tel', 'call')} 555-{100 + i % 900}-{1000 + i}",
        "address": lambda i: f"{pick('write', 'mail')} jo{i} (at) site{i % 9} (dot) {pick('org', 'com', 'de')}",
        "name": lambda i: f"dear {pick('Mr', 'Dr')}. {pick('John', 'Peter')} {pick('Miller', 'Smith')}",
        "street": lambda i: f"lives {i + 1} {pick('Oak', 'Mill')} {pick('Street', 'Road')}",
        "account": lambda i: "iban DE89 3704 0044 0532 0130 00",
    }
    rows, want = [], {}
    for i in range(400):
        k = pick(*kinds)
        rows.append((i, f"{words(4)} {kinds[k](i)} {words(3)}"))
        want[i] = [k]
    for i in range(400, 1200):
        rows.append((i, f"{words(4)} {pick('total', 'order', 'version', 'about')} {rng.randrange(10**7, 10**12)} {words(3)}"))
        want[i] = []
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_data(d).collect()}
    right = sum(want[i][0] in got[i] for i in range(400))  # the digits of an account are a number, too
    wrong = sum(bool(got[i]) for i in range(400, 1200))
    assert right >= 0.9 * 400, right  # recall
    assert wrong <= 0.05 * right, wrong  # precision
    assert pii.account_check(F.lit("x")) is not None


def test_candidates_are_cut_around_fixed_spans(spark):
    text = "tel 212-555-1234 10.0.0.1 212-555-9999 and +1 (555) 555-1234"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.found(d).first()
    assert [text[c["start"] : c["end"]] for c in r["_candidates"]] == ["212-555-1234", "212-555-9999"]
    assert [text[m["start"] : m["end"]] for m in r["_ip"]] == ["10.0.0.1"]
    for c in r["_candidates"]:
        for k in pii.KINDS:
            assert all(c["end"] <= m["start"] or m["end"] <= c["start"] for m in r[f"_{k}"])


def test_many_matches_in_one_text(spark):
    n = 200_000
    text = " ".join(f"u{i}@h{i % 7}.example.com x" for i in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.personal_data(d).select(F.size("email").alias("n"), F.element_at("email", -1).alias("last")).first()
    assert r["n"] == n and text[r["last"]["start"] : r["last"]["end"]] == r["last"]["value"]
    assert time.time() - began < 60


def plain_counts(rows):
    counts = {}
    n_pairs = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            before = "<s>"
            for w in [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]:
                counts[w] = counts.get(w, 0) + 1
                n_pairs[before, w] = n_pairs.get((before, w), 0) + 1
                before = w
    return counts, n_pairs


def test_language_model(spark, odd, none):
    rows = sentences(2, 300) + sentences(2, 10) + [(900, None, None), (901, "", None), (901, "", None), (902, "never seen words", None), (903, "one two three " * 900, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, _ = plain_counts([(i, t) for i, t, _ in rows])
    n, v = sum(counts.values()), len(counts)
    texts = {i: t for i, t, _ in rows}
    for sizes in ({}, {"chunk_tokens": 300, "bucket_tokens": 900, "hot": 100}):  # one chunk and bucket, and many; texts longer than a chunk
        got = hpylm.scored(d, ~held_out("doc_id", 7, 2), **sizes).collect()
        assert len(got) == len(rows)
        for r in got:
            w = [*re.findall(rb"[^\x20\x09-\x0D]+", (texts[r["doc_id"]] or "").encode().lower()), b""]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
            assert abs(r["base_score"] - sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6
            assert r["score"] < 0
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > 1.02 * sum(r["base_score"] for r in out)  # these words follow no order
    assert hpylm.scored(odd, F.lit(True)).count() == odd.count()
    assert hpylm.scored(odd, F.lit(False)).count() == odd.count()
    assert hpylm.scored(none, F.lit(True)).count() == 0


def test_language_model_learns_what_follows_each_word(spark):
    """400 words with equal ends, each with a successor of its own, in any order."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"a{k}zz b{k}zz" for k in rng.choices(range(400), k=40))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"chunk_tokens": 2000, "bucket_tokens": 4000}):
        got = hpylm.scored(d, ~held_out("doc_id", 7, 2), **sizes).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        assert got[0] > 0.6 * got[1], sizes


def plain_gibbs(rows, sweeps, rng):
    """Seatings of the same model one customer at a time, with exact totals throughout; mean of log10 predictions of each pair."""
    counts, pairs = plain_counts(rows)
    once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d1 = hpylm.discount(once, twice)
    contexts = {}
    for _, w in pairs:
        contexts[w] = contexts.get(w, 0) + 1
    d0 = hpylm.discount(sum(n == 1 for n in contexts.values()), sum(n == 2 for n in contexts.values()))
    s1, s0, base = hpylm.STRENGTH["context"], hpylm.STRENGTH["root"], 1 / (len(counts) + 1)
    room = {}
    for (u, _), n in pairs.items():
        room[u] = room.get(u, 0) + n
    t = dict.fromkeys(pairs, 1)
    t0 = dict.fromkeys(counts, 1)
    sums = {}
    for sweep in range(sweeps):
        c0 = dict.fromkeys(counts, 0)
        for (_, w), k in t.items():
            c0[w] += k
        for w, c in c0.items():
            t0[w] = 1
            for j in range(1, c):
                a = (s0 + d0 * sum(t0.values())) * base
                t0[w] += rng.random() < a / (a + j - d0 * t0[w])
        all0, tables0 = sum(c0.values()), sum(t0.values())
        p0 = {w: (c0[w] - d0 * t0[w] + (s0 + d0 * tables0) * base) / (s0 + all0) for w in counts}
        tables = {}
        for (u, _), k in t.items():
            tables[u] = tables.get(u, 0) + k
        if sweep >= sweeps // 2:
            for (u, w), n in pairs.items():
                p = (n - d1 * t[u, w] + (s1 + d1 * tables[u]) * p0[w]) / (s1 + room[u])
                sums.setdefault((u, w), []).append(p)
        for (u, w), n in pairs.items():
            a = (s1 + d1 * tables[u]) * p0[w]
            k = 1
            for j in range(1, n):
                k += rng.random() < a / (a + j - d1 * k)
            t[u, w] = k
    return {k: np.log10(np.mean(v)) for k, v in sums.items()}


def test_language_model_against_plain_sampling(spark):
    """Scores of training texts against a sampler of single customers with exact totals."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.25)), 30)}" for _ in range(rng.randint(3, 30)))) for i in range(120)]
    want = plain_gibbs(rows, 24, rng)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"chunk_tokens": 200, "bucket_tokens": 700}):
        got = {r["doc_id"]: r["score"] for r in hpylm.scored(d, ~held_out("doc_id", 7, 2), **sizes).filter("not held_out").collect()}
        plain = {}
        for i, t in rows:
            if i in got:
                w = ["<s>", *t.encode().split(), b""]
                plain[i] = sum(want[a, b] for a, b in zip(w, w[1:], strict=False))
        a, b = (np.array([x[i] for i in got]) for x in (got, plain))
        assert abs(a.sum() / b.sum() - 1) < 0.01, (sizes, a.sum(), b.sum())
        assert np.abs(a - b).max() < 0.05 * np.abs(b).max()


def test_model_is_a_distribution():
    """Predictions of all words and the unknown one add up to one in every context."""
    rng = np.random.default_rng(4)
    n_words, rooms = 40, 12
    pairs = sorted({(int(w), int(c)) for w, c in zip(rng.integers(0, n_words, 300), rng.integers(0, rooms, 300), strict=True)} | {(w, 0) for w in range(n_words)})
    word, ctx = (np.array(x) for x in zip(*pairs, strict=True))
    n = rng.integers(1, 400, len(word))
    customers = np.bincount(ctx, n)
    c = np.bincount(word, n)
    all_words, all_tokens = (np.bincount(hpylm.magnitude(c), x, 64) for x in (np.ones(n_words), c))
    size = np.floor(hpylm.STEPS * np.log2(customers[ctx])).astype(int)
    kept = hpylm.gibbs(word, size, n, np.ones(n_words), all_words, all_tokens, rng)
    for t, _, t0 in kept:
        assert (t >= 1).all() and (t <= n).all() and (t0 >= 1).all()
    model = {"words": n_words, "d1": 0.8, "d0": 0.6, "c0": [k[1].sum() for k in kept], "t0": [k[2].sum() for k in kept]}
    for u in range(rooms):
        there = {w: k for k, (w, x) in enumerate(zip(word, ctx, strict=True)) if x == u}
        at = [there.get(w, -1) for w in range(n_words)]
        seats = [np.append([k[0][i] if i >= 0 else 0 for i in at], 0) for k in kept]
        tables = [np.full(n_words + 1, k[0][ctx == u].sum()) for k in kept]
        lp = hpylm.predicted(np.append([n[i] if i >= 0 else 0 for i in at], 0), seats, np.full(n_words + 1, customers[u]), tables, [np.append(k[1], 0) for k in kept], [np.append(k[2], 0) for k in kept], model)
        assert abs((10**lp).sum() - 1) < 1e-9


def test_packed_arrays():
    rng = np.random.default_rng(3)
    for a in (np.zeros(0, int), np.zeros(9, int), rng.integers(0, 2**40, 1000), np.array([2**64 - 1, 0], np.uint64)):
        assert (hpylm.unpacked(hpylm.packed(a)) == np.asarray(a, np.uint64)).all()
        assert (hpylm.unpacked(hpylm.packed(np.sort(a), True)) == np.sort(np.asarray(a, np.uint64))).all()


def test_word_hashes():
    long = "x" * 300_000
    texts = ["A b\tC", None, "", " \n", f"{long} b", "b " * 150_000, "y" * 70_000, "a\u00a0b é"]
    h, n = word_hashes(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert n.tolist() == [len((t or "").encode().split()) for t in texts]
    seen = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_seating_follows_the_restaurant_rule():
    rng = np.random.default_rng(1)
    for n, a, d in ((30, 2.0, 0.5), (3000, 5.0, 0.7)):
        fast = hpylm.seated(np.full(3000, n), np.full(3000, a), d, rng)
        slow = []
        for _ in range(300):
            t = 1
            for j in range(1, n):
                t += rng.random() < a / (a + j - d * t)
            slow.append(t)
        assert abs(fast.mean() - np.mean(slow)) < 4 * np.std(slow) / np.sqrt(300) + 0.02 * np.mean(slow)


def plain_neardup(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return {k: (len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows)}


def corpus(seed, groups, copies, edits, words=80):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"v{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += ["", None, "one two", "one two", "One  Two", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark, odd, none):
    for rows in (corpus(1, 30, 6, 3), corpus(2, 2, 120, 3)):  # small groups, and groups larger than a region
        d = spark.createDataFrame(rows, "doc_id long, text string")
        want = plain_neardup(rows)
        for r in neardup.near_duplicates(d).collect():
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_shingles"] == by[2]["n_shingles"] == 0 and by[6]["component_id"] == 5 and by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_family_of_thousands(spark):
    """2500 texts of one boilerplate: most link with the few of little own text alone, some with none."""
    shared = " ".join(f"b{i}" for i in range(104))  # 100 shingles
    own = [8 if i in (701, 1300, 1999) else 70 if i % 250 == 7 else 22 + i % 4 for i in range(2500)]
    d = spark.createDataFrame([(i, shared + "".join(f" o{i}x{k}" for k in range(n))) for i, n in enumerate(own)], "doc_id long, text string")
    # own words are in no other text: the similarity of two follows from their numbers
    few = [i for i, n in enumerate(own) if n == 8]
    want = [0 if i in few or 10000 >= 75 * (100 + n + 8) else i for i, n in enumerate(own)]
    assert want.count(0) == 2490
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d).collect()}
    assert [got[i] for i in range(2500)] == want


def test_near_duplicates_close_to_the_limit(spark):
    """Pairs of graded similarity around the limit, none else alike: every one is decided as all pairs decide."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        w = [f"q{rng.randrange(10**7)}" for _ in range(rng.randint(30, 160))]
        v = list(w)
        for k in rng.sample(range(len(v)), max(1, round(len(v) * rng.uniform(0.012, 0.05)))):
            v[k] = f"r{rng.randrange(10**7)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    want = plain_neardup(rows)
    assert 100 < sum(c != k for k, (_, c) in want.items()) < 290
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_over_many_range_partitions(spark, monkeypatch):
    """Runs that go on over the ends of partitions, some of them empty or of few rows, lose nothing."""
    monkeypatch.setattr(neardup, "ORDERED", 400)
    rows = corpus(5, 12, 5, 3) + [(i + 10**6, t) for i, t in corpus(6, 1, 60, 3)[:60]]
    want = plain_neardup(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_neighbours_are_those_with_the_longest_common_prefix(spark):
    """Every pair of a run of up to REGION rows, in any of several cuts into partitions; of larger runs the next in the order and deeper runs."""
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 2, (900, 16), dtype=np.uint8)
    keys[:, 0] = rng.integers(0, 3, 900)
    keys[:250, 1:10] = 7  # a large region
    rows = [(*map(int, k.view(">i8")), i) for i, k in enumerate(keys)]
    by_depth = {d: {} for d in neardup.DEPTHS}
    for i, k in enumerate(keys):
        for d in neardup.DEPTHS:
            by_depth[d].setdefault(bytes(k[: d + 1]), []).append(i)
    order = sorted(range(900), key=lambda i: rows[i])
    must = {tuple(sorted(p)) for p in zip(order, order[1:]) if bytes(keys[p[0]][: neardup.LEAST + 1]) == bytes(keys[p[1]][: neardup.LEAST + 1])}
    for d in neardup.DEPTHS:
        must |= {(i, j) for g in by_depth[d].values() if len(g) <= neardup.REGION for i in g for j in g if i < j}
    regional = {i for g in by_depth[neardup.LEAST].values() if len(g) > neardup.REGION for i in g}
    for parts in (1, 7, 60):
        cut = spark.createDataFrame(rows, "hi long, lo long, id long").repartitionByRange(parts, "hi", "lo", "id").sortWithinPartitions("hi", "lo", "id")
        inner = neardup.neighbours(cut).collect()
        edges = spark.createDataFrame([(r["hi"], r["lo"], r["a"]) for r in inner if r["kind"] == neardup.EDGE], "hi long, lo long, id long")
        found = inner + neardup.neighbours(edges.repartition(1).sortWithinPartitions("hi", "lo", "id"), inner=False).collect()
        pairs = {(r["a"], r["b"]) for r in found if r["kind"] == neardup.PAIR}
        assert must <= pairs
        assert {r["a"] for r in found if r["kind"] == neardup.REGIONAL} == regional
        if parts == 1:
            assert {(r["a"], r["b"]) for r in inner if r["kind"] == neardup.PAIR} == must


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 300), (200, 300), (7, 7)]
    links = spark.createDataFrame(rows, "a long, b long")
    for at_once in (0, 1 << 19):  # by stars, and in one task
        got = {r["v"]: r["c"] for r in neardup.components(links, at_once).collect()}
        assert got == {**dict.fromkeys(range(1, 61), 0), 200: 100, 300: 100}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[:780], np.unique(rng.integers(0, 2**63, 110).astype(np.uint64))])
    true = 780 / (len(a) + len(b) - 780)
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - true) < 0.12
    assert hashlib.sha256(neardup.signature(a).tobytes()).hexdigest() == hashlib.sha256(neardup.signature(a[::-1].copy()).tobytes()).hexdigest()


def test_masking_keeps_columns_of_any_name(spark):
    rows = [("mail a.b@c.example.com now", "x", 1, "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, `odd``name` string, `with.dot` int, row string")
    got = pii.masked(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("mail [EMAIL] now", "x", 1, "y"), (None, None, None, None)], key=repr)
