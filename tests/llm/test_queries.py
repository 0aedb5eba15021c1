"""Every registered query over a table of odd cases, all contract columns against plain code; the SQL twins in DuckDB."""

import hashlib
import os
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from conftest import TEXTS  # noqa: E402
from test_models import plain_neardup, plain_pii, sentences  # noqa: E402
from test_simple_operators import plain_secrets  # noqa: E402

from sitespan.llm import bpe, media, queries  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(i, t, lang, f"s{i % 3}") for i, t, lang in sentences(3, 60)] + [(100 + i, t, None if i % 2 else "en", None) for i, t in enumerate(TEXTS)] + [(200, TEXTS[6], "en", "s1")]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, lang, src, len(t or "")) for i, t, lang, src in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", rng.choice([None, "", "<p>same</p>", f"<p>é {i}</p>" * rng.randint(1, 400)])) for i in range(80)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    vectors = [(i, [rng.choice([-1, 0, 1]) / 4 if i % 3 else rng.gauss(0, 0.2) for _ in range(64)], rng.choice([None, 1, 2])) for i in range(90)]
    vectors += [(100, None, 1), (101, vectors[0][1][:63] + [None], 1), (102, vectors[0][1][:63] + [float("nan")], 2), (103, [float("inf")] * 64, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return top


def by_id(df, key="doc_id"):
    rows = df.collect()
    got = {r[key]: r for r in rows}
    assert len(got) == len(rows)
    return got


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_lm_score(spark, tables):
    got = by_id(queries.op2_lm_score(spark, tables))
    tokens = {i: [*WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or "")), None] for i, t, _, _ in ROWS}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = {}
    for i, w in tokens.items():
        for x in () if i in held else w:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 and r["score"] < 0


def test_media(spark, tables):
    got = by_id(queries.op3_media(spark, tables))
    by_text = {}
    for i, t, _, _ in ROWS:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        wav = media.to_wav(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r["feature"] == f"{len(r['times'])}:" + sha(",".join(map(str, r["times"])) + ";" + ",".join(map(str, r["hashes"])))
        assert by_text.setdefault(payload, r["feature"]) == r["feature"]


def test_quality(spark, tables):
    got = by_id(queries.op4_quality_rules(spark, tables))
    for i, t, _, _ in ROWS:
        assert got[i]["n_words"] == len(WORDS.findall(t or "")) and not (got[i]["kept"] and got[i]["base_failed"])


def test_secrets(spark, tables):
    got = by_id(queries.op5_secrets(spark, tables))
    for i, t, _, _ in ROWS:
        want = [(k, a, b) for a, k, b in plain_secrets(t or "")]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert r["base_sha256"] == sha(joined(want)) and set(filter(None, joined(want).split(","))) <= set(r["spans"].split(","))


def test_packing(spark, tables):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    rows = queries.op6_packing(spark, tables).collect()
    bins, got = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t, _, _ in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert sorted(got[i]) == [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / 4096 + 2


def test_language_id(spark, tables):
    got = by_id(queries.op7_language_id(spark, tables))
    for i, t, _, _ in ROWS:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and r["lang_pred"] in ("und", "en", "de", "fr")


def test_personal_data(spark, tables):
    got = by_id(queries.op8_pii(spark, tables))
    for i, t, _, _ in ROWS:
        want = [(k, a, b) for k, found in plain_pii(t or "").items() for a, b in found]
        r = got[i]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == x for x, _, _ in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(joined(want)) and r["spans"].startswith(joined(want))


def test_byte_bpe(spark, tables):
    enc: tiktoken.Encoding = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = by_id(queries.op9_byte_bpe(spark, tables))
    for i, t, _, _ in ROWS:
        ids = enc.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))


def test_near_duplicates(spark, tables):
    got = by_id(queries.op10_near_duplicates(spark, tables))
    for i, (n, c) in plain_neardup([(i, t) for i, t, _, _ in ROWS]).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, tables)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
