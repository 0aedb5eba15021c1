"""License scans against a plain search for every phrase and template in every text."""

import math
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest import LONG, TEXTS  # noqa: E402

from sitespan.llm import licenses, queries  # noqa: E402

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEMPLATES = tuple(licenses.template(*t) for t in licenses.TEMPLATES)


def words_of(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def places(words, phrase):
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == tuple(phrase)]


def plain(texts, slack=12):
    docs = [words_of(t) for t in texts]
    known = licenses.all_words(TEMPLATES)
    idf = {w: math.log((len(docs) + 1) / (sum(w in set(d) for d in docs) + 1)) for w in known}
    out = []
    for d in docs:
        base = [(i, label) for phrase, label in licenses.BASE for i in places(d, phrase.split())]
        spans = []
        for t in TEMPLATES:
            rare = max(t.phrases, key=lambda p: (max(idf[w] for w in p[1]), len(p[1]), -p[0]))
            for s in places(d, rare[1]):
                a = s - rare[0]
                if all(any(abs(q - a - at) <= slack for q in places(d, p)) for at, p in t.phrases):
                    there = [any(d[q] == w for q in range(max(0, a + i - slack), min(len(d), a + i + slack + 1))) for i, w in enumerate(t.words)]
                    whole = sum(idf[w] for w in t.words)
                    share = min(1.0, sum(idf[w] for w, ok in zip(t.words, there, strict=True) if ok) / whole) if whole > 0 else 1.0
                    spans.append((max(0, a), min(len(d), a + len(t.words)), t.label, round(share, 9)))
        labels = sorted({x for _, x in base} | {x[2] for x in spans})
        score = max((x[3] for x in spans), default=0.5 if base else 0.0)
        at = sorted(i for i, _ in base)
        out.append((len(d), len(base), at[0] if at else None, at[-1] if at else None, sorted({x for _, x in base}), labels, round(score, 9), sorted(spans)))
    return out


def planted(seed=2):
    rng = random.Random(seed)
    fill = lambda n: " ".join(rng.choice(["the", "of", "license", "public", "version", "général", "日本", "Copyright", "x1", "may"]) for _ in range(n))
    texts = []
    for label, text in licenses.TEMPLATES:
        whole = text.replace("[", "").replace("]", "")
        texts += [fill(30) + ". " + whole.capitalize() + "! " + fill(5), whole.upper(), whole.replace(" ", "\n * ") + " " + whole]
        cut = whole.split()
        k = rng.randrange(len(cut))
        texts.append(" ".join([*cut[:k], *fill(rng.choice([1, 5, 14])).split(), *cut[k:]]))  # words in between
        texts.append(" ".join(cut[:k]))
    texts += ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "cc by", "cc  \x00 by", "cc", "by cc", "mit-license Apache_License", "apache", "license"]
    texts += [LONG + " MIT License " + LONG, "y" * 700_000 + " cc by " + "é" * 300_000, "cc by " * 60_000]
    return texts + TEXTS


def test_against_a_plain_scan(spark):
    texts = planted()
    want = plain([t if t is None or len(t) < 300_000 or "MIT" in t else None for t in texts])
    df = spark.createDataFrame([(i, t if t is None or len(t) < 300_000 or "MIT" in t else None, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, spans string, labels string").repartition(3)
    got = {r.doc_id: r for r in licenses.licensed(df, licenses.indexed(df, TEMPLATES)).collect()}
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), sorted((s["start"], s["end"], s["label"], round(s["share"], 9)) for s in r.spans)) == w, texts[i]


def test_blocks_do_not_split_words(monkeypatch):
    """Blocks of any size give the same words and places."""
    texts = [t for t in planted() if t is None or len(t) < 5000]
    whole = licenses.Vocabulary(licenses.all_words(TEMPLATES)).occurrences(texts)
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(licenses, "BLOCK", block)
        for a, b in zip(whole, licenses.Vocabulary(licenses.all_words(TEMPLATES)).occurrences(texts), strict=True):
            assert (a == b).all()
    v = licenses.Vocabulary(licenses.all_words(TEMPLATES))
    n, at, numbers = whole
    assert n.tolist() == [len(words_of(t)) for t in texts]
    flat = [w for t in texts for w in words_of(t)]
    assert [(i, v.number[w]) for i, w in enumerate(flat) if w in v.number] == list(zip(at.tolist(), numbers.tolist(), strict=True))


def test_long_texts():
    scanner = licenses.Scanner(licenses.Index(TEMPLATES, dict.fromkeys(licenses.all_words(TEMPLATES), 1.0), 12))
    got = scanner.scan(["y" * 700_000 + " cc by " + "é" * 300_000, "cc by " * 60_000, None])
    assert got["n_words"] == [4, 120_000, 0]
    assert got["n_base"] == [1, 60_000, 0]
    assert got["last_word"] == [1, 119_998, None]


def test_no_rows_and_repeats(spark, none, odd):
    assert licenses.license_digests(none).collect() == []
    assert licenses.license_digests(odd).count() == odd.count()


def test_templates_that_cannot_be_found():
    with pytest.raises(ValueError, match="mandatory"):
        licenses.template("x", "no phrase")
    with pytest.raises(ValueError, match="16 bytes"):
        licenses.template("x", "[averyveryverylongword]")


def test_query(spark, tmp_path):
    texts = planted()
    spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    gpl = next(i for i, t in enumerate(texts) if t and t.startswith("This work is licensed"))
    assert (got[gpl].n_words, got[gpl].n_base, got[gpl].first_word, got[gpl].base_labels, got[gpl].labels) == (12, 1, 6, "gpl", "gpl,gpl-3.0")
    nc = next(i for i, t in enumerate(texts) if t and t.startswith("Licensed under CC BY-NC 4.0. L"))
    assert (got[nc].n_base, got[nc].first_word, got[nc].last_word, got[nc].labels) == (2, 2, 9, "cc-by,cc-by-nc-4.0")
