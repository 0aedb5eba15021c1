"""The operators' queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, compression, hpylm, langid, licenses, media, neardup, packing, pii, repetition, secrets, warc
from .common import held_out, table


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers installed on the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def named(spans: str):
    """An array of (kind, start, end) as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_pages(table(spark, sf_dir, "pages"), revisit_from=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scored(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_columns(table(spark, sf_dir, "documents"))
    feature = F.concat(F.col("n_pairs").cast("string"), F.lit(":"), F.sha2(F.concat(F.array_join("times", ","), F.lit(";"), F.array_join("hashes", ",")), 256))
    return m.withColumn("feature", feature)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.secret_spans(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    d = d.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*base)))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return d.select("doc_id", *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), size=4096, end_id=1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = langid.train(d, ~held_out("doc_id", 5, 0))
    out = langid.predicted(d, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.personal_data(table(spark, sf_dir, "documents"))
    d = d.withColumn("base", F.concat(*(F.transform(k, pii.kind_span(k)) for k in pii.KINDS)))
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS), F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2_lm_score SQL can state: counts and the base score, to three places."""
    d = op2_lm_score(spark, sf_dir)
    return d.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_lm_score": op2_lm_score,
    "op3_media": op3_media,
    "op4_quality_rules": op4_quality_rules,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_vector_codes": op11_vector_codes,
    "op12_licenses": op12_licenses,
    "op13_clusters": op13_clusters,
    "pipeline": pipeline,
    "lm_base": lm_base,
    "media_base": media_base,
    "quality_base": quality_base,
    "secret_counts": secret_counts,
    "personal_data_counts": personal_data_counts,
    "license_base": license_base,
}

# Words of a text, and crc32 of an id's digits, in SQL.
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL_CRC32 = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda c, b: list_reduce(range(8), lambda h, i: xor(h >> 1, (h & 1) * 3988292384), xor(c, b)), cast(4294967295 as bigint)), 4294967295)"""
SQL_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"

SQL_KEPT = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def sql_rounds(rounds: int, cut: int) -> str:
    """Rounds of assignment over p (id, part, x) and floor means, from k0 (part, e, c); the last assignment is a{rounds}."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
        d{i} as materialized (select id, p.part, x, e, list_sum(list_transform(range(1, {cut + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as d from p join k{i} k on k.part = p.part),
        a{i} as materialized (select id, part, any_value(x) as x, arg_min(e, d * 1000 + e) as e, min(d) as d from d{i} group by id, part)""")
        if i < rounds:
            out.append(f"""
        s{i} as (select part, e, i, sum(x[i]) as s, count(*) as n from a{i}, range(1, {cut + 1}) t(i) group by part, e, i),
        m{i} as (select part, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{i} group by part, e),
        k{i + 1} as materialized (select k.part, k.e, coalesce(m.c, k.c) as c from k{i} k left join m{i} m on m.part = k.part and m.e = k.e)""")
    return ",".join(out)


ORACLE_SQL = {
    "op11_vector_codes": f"""
        with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as q from embeddings where {SQL_KEPT}),
        p as materialized (select vec_id as id, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] as x from v, range(8) r(part)),
        k0 as materialized (select part, row_number() over (partition by part order by id) - 1 as e, x as c from p where id in (select vec_id from v order by vec_id limit 16)),
        {sql_rounds(6, 8)},
        f as (select id, string_agg(printf('%02x', e), '' order by part) as code, cast(sum(d) as bigint) as error from a6 group by id),
        b as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as h from k6)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from v join f on f.id = v.vec_id, b""",
    "op13_clusters": f"""
        with v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings where {SQL_KEPT} and len(embedding) = 64),
        p as materialized (select vec_id as id, 0 as part, q as x from v),
        k0 as materialized (select 0 as part, row_number() over (order by sha256('3:' || vec_id)) - 1 as e, q as c from v qualify e < 8),
        {sql_rounds(10, 64)},
        h as (select e, sha256(array_to_string(c, ',')) as h from k10)
        select id as vec_id, cast(a.e as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.e) as bigint) as cluster_inertia,
          cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
        from a10 a join h on h.e = a.e""",
    # base32 by hand: 5 hex digits of the digest are 4 letters
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        t as (select page_id, h, max(page_id) over (partition by h) as top from p)
        select page_id, cast(strlen(h) as bigint) as payload_bytes,
          array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((cast('0x' || substr(sha1(h), cast(1 + 5 * (i // 4) as integer), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') as payload_digest,
          case when page_id < top then 'revisit' else 'response' end as record_type,
          case when page_id < top then top end as refers_to
        from t""",
    "lm_base": f"""
        with w as (select doc_id, {SQL_CRC32} % 7 = 2 as held_out, list_append({SQL_WORDS.format(SQL_LOWER)}, '') as w from documents),
        t as (select doc_id, held_out, unnest(w) as w from w),
        c as (select w, count(*) as c from t where not held_out group by w),
        n as (select coalesce(sum(c), 0) as n, count(*) as v from c)
        select doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c) as n_known, cast(any_value(n) as bigint) as train_tokens,
          round(sum(log10((coalesce(c, 0) + 1.0) / (n + v + 1.0))), 3) as base_score
        from t left join c using (w), n group by doc_id""",
    "media_base": """
        with d as (select doc_id, coalesce(text, '') as t, cast(greatest(192, (strlen(coalesce(text, '')) + 191) // 192 * 192) as bigint) as p from documents)
        select doc_id, cast(strlen(t) as bigint) as n_bytes, p as payload_bytes, sha256(t || repeat(' ', p - strlen(t))) as payload_sha256, p + 44 as media_bytes from d""",
    "quality_base": rf"""
        with d as (select doc_id, coalesce(text, '') as t, {SQL_WORDS.format("coalesce(text, '')")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
        g as (select doc_id, i, array_to_string(w[i:i+7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
        r as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
        c as (select doc_id, count(distinct i + k) as n from r, range(8) as ks(k) where n > 1 group by doc_id),
        f as (select doc_id, len(w) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
            cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
          from d left join c using (doc_id))
        select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f""",
    "secret_counts": r"""
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id,
          len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as n_assign,
          len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access,
          len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
        from d""",
    "personal_data_counts": rf"""
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id,
          len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
          len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: cast(p as hugeint) > 255)) = 0)) as n_ip,
          len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse({SQL_DIGITS})), lambda x: length(x) between 16 and 19
            and list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 1 then cast(x[i] as bigint) when cast(x[i] as bigint) > 4 then 2 * cast(x[i] as bigint) - 9 else 2 * cast(x[i] as bigint) end)) % 10 = 0)) as n_card,
          len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({SQL_DIGITS}) between 8 and 15)) as n_phone
        from d""",
    "license_base": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
        f(label, p) as (values ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
        h as (select doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) as i from d, f where list_contains(w, p[1])),
        b as (select doc_id, count(*) as n, min(i) as a, max(i) as z, array_to_string(list_sort(list(distinct label)), ',') as l from h group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, a as first_word, z as last_word, coalesce(l, '') as base_labels from d left join b on b.doc_id = d.doc_id""",
    "op10_near_duplicates": r"""
        with recursive w as (
          select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
          from documents),
        s as (
          select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s
          from w),
        e as (select doc_id, unnest(s) as g from s),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        l as (select c.a, c.b from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
        both_ways as (select a, b from l union all select b, a from l),
        r(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, k.b from r join both_ways k on k.a = r.other),
        m as (select doc_id, min(other) as component_id from r group by 1)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept
        from s join m on m.doc_id = s.doc_id""",
}
