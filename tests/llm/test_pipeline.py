"""The pipeline on a small table against a plain version of every stage."""

import os
import random
import sys

import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_models import plain_neardup, plain_pii, sentences  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from sitespan.llm import langid, pipeline, repetition  # noqa: E402
from sitespan.llm.common import held_out  # noqa: E402


def masked(text):
    spans = sorted((a, b, k) for k, found in plain_pii(text).items() for a, b in found)
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"{t} {rng.randrange(10**6)}x", lang) for i, t, lang in sentences(5, 120) if len(t.split()) >= 22]
    base = rows[3][1] + " " + rows[4][1] + " " + rows[5][1]
    rows += [(1000, base, "en"), (1001, base + " end", "en"), (1002, base, None), (1003, "same words again " * 30, "en"), (1004, None, "en"), (1005, "1 2 3 4 5 " * 6, "en")]
    rows += [(1006, " ".join(reversed(rows[7][1].split())) + " mail a.b@c.de now +1 (555) 555-1234", rows[7][2])]
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [(i, t, lang) for i, t, lang in rows if repetition.measure(t, repetition.Rules())[6]]
    assert {1003, 1004, 1005}.isdisjoint(i for i, _, _ in good)
    model = langid.train(spark.createDataFrame(good, "doc_id long, text string, lang string"), ~held_out("doc_id", 5, 0))
    known = [(i, t) for i, t, _ in good if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.5]
    groups = plain_neardup(known)
    left = [(i, masked(t)) for i, t in known if groups[i][1] == i]
    assert {1001, 1002}.isdisjoint(i for i, _ in left) and "[EMAIL] now [PHONE]" in dict(left)[1006]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    assert sorted((r["doc_id"], r["length"]) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def run_stages(spark, docs, stages):
    for _, stage in stages:
        docs = stage(spark, docs, None)
    return docs


def test_unlike_texts_under_one_id_all_stay(spark):
    fresh = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**9)}x{k}" for k in range(60))
    rows = [(1, fresh(1), "a", 1), (1, fresh(2), "a", 2), (2, fresh(3), "b", 3), (None, fresh(4), None, 4), (None, fresh(4), None, 5), (9, fresh(3) + " end", "b", 6), (0, fresh(2), "c", 7), (5, None, None, 8), (5, "", None, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept int")
    got = pipeline.near_duplicates(spark, d, None)
    assert got.columns == d.columns
    assert sorted(r["kept"] for r in got.collect() if r["kept"] not in (4, 5)) == [1, 3, 7, 8, 9]  # of equal texts that with the smallest id
    assert sum(r["kept"] in (4, 5) for r in got.collect()) == 1


def test_stages_on_odd_tables(spark, odd, none):
    wide = odd.withColumn("n_chars", F.lit(0).cast("long")).withColumn("_row", F.lit("r")).withColumn("row", F.lit(1))
    stages = pipeline.STAGES[:-1]
    assert run_stages(spark, wide, stages).columns == wide.columns
    for name, stage in stages:
        empty = stage(spark, none, None)
        assert empty.columns == none.columns and empty.count() == 0, name
        assert stage(spark, wide, None).columns == wide.columns, name
    assert pipeline.packed(spark, none, None).count() == 0
    masked_rows = pipeline.personal_data(spark, wide, None).collect()
    assert len(masked_rows) == wide.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in masked_rows)
    assert {r["doc_id"] for r in pipeline.packed(spark, wide, None).collect()} == {r["doc_id"] for r in wide.collect()}
