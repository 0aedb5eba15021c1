"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are words and one end mark a text. Every word that comes before a token
has a context restaurant of its own, whatever its count, and a text's first
token has one, too. All context restaurants share one parent, the root
restaurant over all words, whose base gives each of the V known words and one
unknown word the same chance. A customer who opens a table in a context is a
customer of the root. So the model grows with the corpus: one restaurant a
known word, one dish a pair of words.

Seating is sampled by Gibbs sweeps: a dish's customers in a restaurant leave
and sit down again by the Chinese-restaurant rule, given all else. After
BURN sweeps, SAMPLES seatings are kept; a token's probability is the mean of
what they predict. Discounts come from the numbers of pairs, and of words by
their contexts, seen once and twice. Seating is sampled in parallel over blocks
of dishes, which a hash of the word draws. A pair seen once has one table in
any seating. While sampling, totals that a block cannot see (tables of a
context, customers and tables of the root) are estimated from the block by
strata: contexts by size in steps of a quarter of a power of two, words by
powers of two of their count against the exact numbers of words and tokens of
the whole corpus. Predictions use the exact totals of what was sampled.

Words and pairs do not move as rows. Texts are read once, into chunks of about
CHUNK tokens in files of the shared folder. A chunk asks for facts of its
distinct words and pairs; what it asks of one bucket of words (by their hash)
is one row of packed, sorted arrays, and so is the answer. A bucket merges what
all chunks ask of it. A word takes at most one place in a chunk's rows, and the
pairs of a word that is very frequent are dealt over several buckets, so no
bucket grows with a single word. Buckets hold about BUCKET tokens' pairs.

Words are known by 64 bits of a hash; of V words two share one with a chance of
V**2 / 2**65.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, new_path, remove, scratch, stored
from .hashing import word_hashes

CHUNK = 1 << 20  # tokens of a chunk, about
BUCKET = 1 << 21  # tokens whose pairs go to one bucket, about
HOT = 1 << 20  # a word's pairs go to as many buckets as it has this many tokens
START, END = np.uint64(2**64 - 1), np.uint64(2**64 - 2)  # what stands before a text's first token, and the end mark
BURN, SAMPLES = 3, 3
STRENGTH = {"context": 1.0, "root": 10.0}
STEPS = 4  # strata of contexts to a power of two

# kinds of rows that move
ASKED, IDS, TABLE, STATS, PAIRS, SEATS, TOTALS, ROOT, FACTS, META = range(10)
_SHAPE = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("data", pa.list_(pa.binary()))])
_SQL = "kind int, chunk long, bucket long, x double, y double, data array<binary>"


# --- packed arrays -------------------------------------------------------------


def packed(a: np.ndarray, sorted_: bool = False) -> bytes:
    """An array of integers from 0 up, as compressed byte planes; sorted ones by their steps."""
    a = np.ascontiguousarray(a, np.uint64)
    if sorted_ and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    planes = a.view(np.uint8).reshape(-1, 8).T
    k = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    return bytes([k, sorted_]) + len(a).to_bytes(6, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:k]).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    k, sorted_, n = b[0], b[1], int.from_bytes(b[2:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if k and n:
        out[:, :k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:], max_output_size=k * n), np.uint8).reshape(k, n).T
    out = out.view(np.uint64)[:, 0]
    return np.cumsum(out, dtype=np.uint64) if sorted_ else out


def message(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, chunk, bucket, x, y, data) that move."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SHAPE, strict=True)], schema=_SHAPE) if rows else pa.RecordBatch.from_pylist([], schema=_SHAPE)


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([message(rows)])


def entries(t: pa.Table, kind: int) -> list[dict]:
    """The rows of one kind, by chunk, then bucket."""
    rows = t.filter(pc.equal(t["kind"], kind)).select(["chunk", "bucket", "data"]).to_pylist()
    return sorted(rows, key=lambda r: (r["chunk"], r["bucket"]))


# --- chunks of texts ------------------------------------------------------------


class Segments:
    """Tokens of texts, or of parts of one: for each its context first, then its tokens."""

    def __init__(self) -> None:
        self.ids, self.rows, self.train, self.parts, self.size = [], [], [], [], 0

    def add(self, key: int | None, row: int, train: bool, words: np.ndarray) -> None:
        self.ids.append(key)
        self.rows.append(row)
        self.train.append(train)
        self.parts.append(words)
        self.size += len(words) - 1


def chunked(d: DataFrame, folder: str, chunk_tokens: int) -> DataFrame:
    """Writes the tokens of (doc_id, text, train) in chunks; for each: x tokens, y training texts, and where it lies, its distinct words and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hpylm")
        fs, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path, out, at, made, row, s = f"{root}/{part:06d}-{uuid.uuid4().hex}", None, 0, 0, 0, Segments()

        def closed() -> pa.RecordBatch:
            nonlocal out, at, made, s
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path, compression=None)
            lens = np.array([len(p) for p in s.parts])
            words, local = np.unique(np.concatenate(s.parts), return_inverse=True)
            first = np.cumsum(lens) - lens
            counts = np.repeat(np.array(s.train, np.float64), lens)
            inner = np.ones(len(local), bool)
            inner[first] = False  # the context before a text's part is no token of it; the start counts as often as it stands
            counts = np.bincount(local, counts * (inner | (words[local] == START)), len(words)).astype(np.int64)
            arrays = [np.array([x is None for x in s.ids]), np.array([x or 0 for x in s.ids], np.int64).view(np.uint64), np.array(s.rows), np.array(s.train), lens, local]
            blobs = [packed(x) for x in arrays]
            meta = {"path": path, "at": at, "sizes": [len(b) for b in blobs]}
            for b in blobs:
                out.write(b)
                at += len(b)
            row_ = (META, (part << 24) + made, 0, float(s.size), float(sum(s.train)), [json.dumps(meta).encode(), packed(words, True), packed(counts)])
            made, s = made + 1, Segments()
            return message([row_])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids, texts, train = (c.to_pylist() for c in batch.slice(k, 256).columns)
                h, counts = word_hashes(texts)
                for key, learn, w in zip(ids, train, np.split(h, np.cumsum(counts)[:-1]), strict=True):
                    w = np.concatenate([[START], w, [END]])
                    for i in range(0, len(w) - 1, chunk_tokens):
                        s.add(key, (part << 40) + row, learn, w[i : i + chunk_tokens + 1])
                        if s.size >= chunk_tokens:
                            yield closed()
                    row += 1
        if s.size:
            yield closed()
        if out is not None:
            out.close()

    return d.select("doc_id", "text", "train").mapInArrow(run, _SQL)


def reread(folder: str, meta: bytes) -> list[np.ndarray]:
    """A chunk's arrays: null ids, ids, rows, train, lengths, tokens."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    meta = json.loads(meta)
    with fs.open_input_file(meta["path"]) as f:
        data = f.read_at(sum(meta["sizes"]), meta["at"])
    ends = np.cumsum(meta["sizes"])
    lacks, ids, rows, train, lens, tokens = (unpacked(data[e - n : e]) for e, n in zip(ends, meta["sizes"], strict=True))
    return [lacks > 0, ids.view(np.int64), rows.view(np.int64), train > 0, lens.view(np.int64), tokens.view(np.int64)]


def pairs_of(lens: np.ndarray, local: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs (w, u), by w, then u, and the pair of each token."""
    token = np.ones(len(local), bool)
    token[np.cumsum(lens) - lens] = False
    at = np.flatnonzero(token)
    key, pair = np.unique(local[at] * n_words + local[at - 1], return_inverse=True)
    return key // n_words, key % n_words, pair


def bucket_of(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)


def dealt(w: np.ndarray, u: np.ndarray, words: np.ndarray, c: np.ndarray, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each pair, and over how many buckets its word's pairs are dealt."""
    k = np.minimum(1 + c[w] // hot, 1 << bits)
    part = ((words[u] >> np.uint64(7)) % k.astype(np.uint64)).astype(np.int64)
    return (bucket_of(words, bits)[w] + part * max(1, (1 << bits) // 61)) % (1 << bits), k


# --- words -----------------------------------------------------------------------


def asked(chunks: DataFrame, bits: int) -> DataFrame:
    """For each chunk and bucket the chunk's words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hpylm")
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                _, words, counts = data.as_py()
                words, counts = unpacked(words), unpacked(counts)
                b = bucket_of(words, bits)
                cuts = np.flatnonzero(np.diff(b)) + 1
                yield message([(ASKED, chunk, int(k[0]), None, None, [packed(x, True), packed(n)]) for k, x, n in zip(*(np.split(a, cuts) for a in (b, words, counts)), strict=True)])

    return chunks.mapInArrow(run, _SQL)


def magnitude(c: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(c, 1)).astype(np.int64)


def numbered(rows: DataFrame, bits: int) -> DataFrame:
    """Numbers and counts of a bucket's words, for each chunk that asks; the bucket's counts; words (x) and tokens (y) by magnitude (as chunk)."""

    def run(t: pa.Table) -> pa.Table:
        claim("hpylm")
        got = entries(t, ASKED)
        bucket = got[0]["bucket"]
        words = [unpacked(r["data"][0]) for r in got]
        each, at = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpacked(r["data"][1]) for r in got])).astype(np.int64)
        order = np.argsort(-c, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(c), np.int64)
        rank[order] = np.arange(len(c))
        out = [(TABLE, -1, bucket, None, None, [packed(c[order])])]
        for r, own in zip(got, np.split(at, np.cumsum([len(w) for w in words])[:-1]), strict=True):
            out.append((IDS, r["chunk"], bucket, None, None, [packed(rank[own]), packed(c[own])]))
        seen = (c > 0) & (each != START)
        m = magnitude(c[seen])
        out += [(STATS, int(k), bucket, float((m == k).sum()), float(c[seen][m == k].sum()), []) for k in np.unique(m)]
        return table(out)

    return rows.groupBy("bucket").applyInArrow(run, _SQL)


# --- pairs and seating -------------------------------------------------------------


def asked_pairs(rows: DataFrame, folder: str, bits: int, hot: int) -> DataFrame:
    """From chunks with their words' numbers: for each chunk and bucket the chunk's pairs, by w, then u."""

    def run(t: pa.Table) -> pa.Table:
        claim("hpylm")
        meta = entries(t, META)[0]
        words = unpacked(meta["data"][1])
        got = entries(t, IDS)
        rank, c = (np.concatenate([unpacked(r["data"][i]) for r in got]).astype(np.int64) for i in range(2))
        ids = (rank << bits) + bucket_of(words, bits)
        _, _, _, train, lens, local = reread(folder, meta["data"][0])
        w, u, pair = pairs_of(lens, local, len(words))
        n = np.bincount(pair, np.repeat(train, lens - 1), len(w)).astype(np.int64)
        to, k = dealt(w, u, words, c, bits, hot)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        size = np.floor(STEPS * np.log2(np.maximum(c[u], 1))).astype(np.int64)
        arrays = [x[order] for x in (ids[w], ids[u], n, size, k - 1)]
        parts = [np.split(x, cuts) for x in (to[order], *arrays)]
        return table([(PAIRS, meta["chunk"], int(b[0]), None, None, [packed(x) for x in rest]) for b, *rest in zip(*parts, strict=True)])

    return rows.groupBy("chunk").applyInArrow(run, _SQL)


def seated(n: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after n customers of a dish sit down one by one; `weight` is the new table's, against each earlier customer's one less the discounts.

    Up to 64 customers one at a time, then in groups of a twentieth of those
    seated, over which the chance hardly changes.
    """
    t = np.minimum(n, 1).astype(np.float64)
    live = np.flatnonzero(n > 1)
    j = 1
    while len(live):
        left = n[live] - j
        m = 1 if j < 64 else max(1, j // 20)
        a = weight[live]
        chance = a / (a + (j + (m - 1) / 2) - discount * t[live])
        t[live] += rng.random(len(live)) < chance if m == 1 else rng.binomial(np.minimum(m, left).astype(np.int64), chance)
        j += m
        live = live[n[live] > j]
    return t


def discount(once: float, twice: float) -> float:
    return float(min(0.95, max(0.1, once / (once + 2 * twice)))) if once else 0.5


def over_all(values: np.ndarray, weights: np.ndarray, kind: np.ndarray, whole: np.ndarray) -> float:
    """A block's sum of values carried to the whole corpus: by kind, in proportion to weights; kinds the block lacks go by the next below."""
    got, by = (np.bincount(kind, x, len(whole)) for x in (values, weights))
    have = np.flatnonzero(by > 0)
    near = have[np.maximum(np.searchsorted(have, np.arange(len(whole)), "right") - 1, 0)]
    return float((whole * got[near] / by[near]).sum())


def gibbs(word: np.ndarray, size: np.ndarray, n: np.ndarray, parts: np.ndarray, all_words: np.ndarray, all_tokens: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Seatings of a block of dishes: for each kept sweep tables by pair, root customers by word, root tables by word.

    word: dishes of the pairs, 0 up; size: stratum of each pair's context; n:
    customers, one or more; parts: over how many blocks a word's pairs are
    dealt. all_words, all_tokens: of the whole corpus, by magnitude of count.
    """
    n_words = len(parts)
    s1, s0, base = STRENGTH["context"], STRENGTH["root"], 1 / (all_words.sum() + 1)
    c = np.bincount(word, n, n_words) * parts
    kind = np.minimum(magnitude(c), len(all_words) - 1)
    d1 = discount((n == 1).sum(), (n == 2).sum())
    contexts = np.bincount(word, minlength=n_words) * parts
    d0 = discount((contexts == 1).sum(), (contexts == 2).sum())
    room = 2.0 ** ((np.arange(size.max() + 1) + 0.5) / STEPS)  # customers of a context, by stratum
    customers = np.bincount(size, n)
    many = np.flatnonzero(n > 1)
    t = np.ones(len(n))
    t0 = np.ones(n_words)
    kept = []
    for sweep in range(BURN + SAMPLES):
        c0 = np.bincount(word, t, n_words) * parts
        all0 = over_all(c0, c, kind, all_tokens)
        new0 = (s0 + d0 * over_all(t0, np.ones(n_words), kind, all_words)) * base
        t0 = seated(c0, np.full(n_words, new0), d0, rng)
        new0 = (s0 + d0 * over_all(t0, np.ones(n_words), kind, all_words)) * base
        p0 = (c0 - d0 * t0 + new0) / (s0 + all0)
        if sweep >= BURN:
            kept.append((t, c0 / parts, t0))
        tables = np.bincount(size, t) / np.maximum(customers, 1) * room
        t = t.copy()
        t[many] = seated(n[many], (s1 + d1 * tables[size[many]]) * p0[word[many]], d1, rng)
    return kept


def sampled(rows: DataFrame, bits: int, all_words: np.ndarray, all_tokens: np.ndarray) -> DataFrame:
    """From pairs asked by chunks: SEATS for each chunk (customers, and tables of those with two or more), TOTALS of contexts by their bucket, ROOT facts of words by theirs, STATS."""

    def run(t: pa.Table) -> pa.Table:
        claim("hpylm")
        got = entries(t, PAIRS)
        bucket = got[0]["bucket"]
        parts = [[unpacked(b).astype(np.int64) for b in r["data"]] for r in got]
        lens = [len(p[0]) for p in parts]
        w, u, n, size, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, w = np.unique(w, return_inverse=True)
        contexts, u = np.unique(u, return_inverse=True)
        _, first, pair = np.unique(w * len(contexts) + u, return_index=True, return_inverse=True)
        n = np.bincount(pair, n).astype(np.int64)
        w, u, size = w[first], u[first], size[first]
        over = np.ones(len(words))
        over[w] = k[first] + 1
        live = np.flatnonzero(n)
        tables = np.zeros((SAMPLES, len(n)), np.int64)
        out = []
        if len(live):
            known, word = np.unique(w[live], return_inverse=True)
            kept = gibbs(word, size[live], n[live], over[known], all_words, all_tokens, np.random.default_rng([bucket, 5]))
            own = (words[known] & ((1 << bits) - 1)) == bucket
            for s, (seats, c0, t0) in enumerate(kept):
                tables[s, live] = seats
                out.append((STATS, s, bucket, float(c0.sum()), float(t0[own].sum()), []))
            # the last two of the model's totals: pairs, and words by contexts, seen once and twice
            contexts_of = np.bincount(word, minlength=len(known)) * over[known]
            out.append((STATS, -1, bucket, float((n == 1).sum()), float((n == 2).sum()), []))
            out.append((STATS, -2, bucket, float((contexts_of == 1)[own].sum()), float((contexts_of == 2)[own].sum()), []))
            home = words[known] & ((1 << bits) - 1)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            facts = [words[known] >> bits, *(k[1].astype(np.int64) for k in kept), *(k[2].astype(np.int64) for k in kept)]
            for b, *rest in zip(*(np.split(x[order], cuts) for x in (home, *facts)), strict=True):
                out.append((ROOT, bucket, int(b[0]), None, None, [packed(x) for x in rest]))
            home = contexts & ((1 << bits) - 1)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            sums = [np.bincount(u, x, len(contexts)).astype(np.int64) for x in tables]
            for b, i, *rest in zip(*(np.split(x[order], cuts) for x in (home, contexts >> bits, *sums)), strict=True):
                has = rest[0] > 0
                out.append((TOTALS, bucket, int(b[0]), None, None, [packed(i[has], True), *(packed(x[has]) for x in rest)]))
        for r, own in zip(got, np.split(pair, np.cumsum(lens)[:-1]), strict=True):
            more = own[n[own] > 1]
            out.append((SEATS, r["chunk"], bucket, None, None, [packed(n[own]), *(packed(x[more]) for x in tables)]))
        return table(out)

    return rows.groupBy("bucket").applyInArrow(run, _SQL)


def facts(rows: DataFrame) -> DataFrame:
    """From a bucket's TABLE, TOTALS, ROOT and the numbers that chunks ask: for each chunk count, tables as a context, root customers and root tables of its words."""

    def run(t: pa.Table) -> pa.Table:
        claim("hpylm")
        top = entries(t, TABLE)[0]
        c = unpacked(top["data"][0])
        tables, c0, t0 = (np.zeros((SAMPLES, len(c)), np.int64) for _ in range(3))
        for r in entries(t, TOTALS):
            i, *sums = (unpacked(b).astype(np.int64) for b in r["data"])
            for s in range(SAMPLES):
                tables[s, i] += sums[s]  # an index stands once in a row
        for r in entries(t, ROOT):
            i, *got = (unpacked(b).astype(np.int64) for b in r["data"])
            for s in range(SAMPLES):
                c0[s, i] += got[s]
                if r["chunk"] == top["bucket"]:  # of a word dealt over several buckets its own samples the root's tables
                    t0[s, i] = got[SAMPLES + s]
        out = []
        for r in entries(t, IDS):
            i = unpacked(r["data"][0]).astype(np.int64)
            out.append((FACTS, r["chunk"], top["bucket"], None, None, [packed(c[i]), *(packed(x[i]) for m in (tables, c0, t0) for x in m)]))
        return table(out)

    return rows.groupBy("bucket").applyInArrow(run, _SQL)


# --- scores --------------------------------------------------------------------------


def predicted(n: np.ndarray, t: np.ndarray, c: np.ndarray, tables: np.ndarray, c0: np.ndarray, t0: np.ndarray, model: dict) -> np.ndarray:
    """log10 of the mean prediction for pairs: customers and tables of the pair, of its context, and of its word at the root; tables, c0 and t0 by sample."""
    s1, s0, d1, d0 = STRENGTH["context"], STRENGTH["root"], model["d1"], model["d0"]
    out = np.zeros(len(n))
    for s in range(SAMPLES):
        base = (s0 + d0 * model["t0"][s]) / (model["words"] + 1)
        root = (np.maximum(c0[s] - d0 * t0[s], 0) + base) / (s0 + model["c0"][s])
        out += (np.maximum(n - d1 * t[s], 0) + (s1 + d1 * tables[s]) * root) / (s1 + c)
    return np.log10(out / SAMPLES)


def segment_scores(rows: DataFrame, folder: str, bits: int, hot: int, model: dict) -> DataFrame:
    """Sums over the tokens of each text, or of each part of one, of chunks with all their facts."""
    shape = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        claim("hpylm")
        meta = entries(t, META)[0]
        words = unpacked(meta["data"][1])
        c, *rest = (np.concatenate(x).astype(np.int64) for x in zip(*([unpacked(b) for b in r["data"]] for r in entries(t, FACTS)), strict=True))
        tables, c0, t0 = (rest[i * SAMPLES : (i + 1) * SAMPLES] for i in range(3))
        lacks, ids, row, train, lens, local = reread(folder, meta["data"][0])
        w, u, pair = pairs_of(lens, local, len(words))
        order = np.argsort(dealt(w, u, words, c, bits, hot)[0], kind="stable")
        n, *seats = (np.concatenate(x).astype(np.int64) for x in zip(*([unpacked(b) for b in r["data"]] for r in entries(t, SEATS)), strict=True))
        seated_ = []
        for x in seats:
            full = n.copy()  # one customer has one table
            full[n > 1] = x
            seated_.append(full)
        w, u = w[order], u[order]
        lp = np.empty(len(w))
        lp[order] = predicted(n, seated_, c[u], [x[u] for x in tables], [x[w] for x in c0], [x[w] for x in t0], model)
        token = np.ones(len(local), bool)
        token[np.cumsum(lens) - lens] = False
        c = c[local[token]]
        lens = lens - 1
        first = np.cumsum(lens) - lens
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10((c + 1.0) / (model["tokens"] + model["words"] + 1.0)), lp[pair])]
        return pa.table([pa.array(row), pa.array(ids, mask=lacks), pa.array(train), pa.array(lens), *map(pa.array, sums)], schema=shape)

    return rows.groupBy("chunk").applyInArrow(run, "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def scored(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK, bucket_tokens: int = BUCKET, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `train` says which rows are learned from. base_score is the sum of log10 of
    (count + 1) / (tokens + words + 1), score the model's log10 probability of
    the text. Null and empty texts are the end mark alone. Rows that repeat
    count as often as they stand and get equal scores, whatever their ids.
    Without training rows every token is unknown. An empty table gives none;
    other columns, whatever their names, are not looked at (`train` may name them).
    """
    spark = df.sparkSession
    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    folder = new_path(spark, "lm-tokens")
    with scratch(spark) as keep:
        chunks = stored(chunked(d, folder, chunk_tokens), "lm-chunks")
        n_chunks, n_tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("x"), F.lit(0.0))).first()
        bits = max(0, int(np.ceil(np.log2(max(1, n_tokens / bucket_tokens)))))
        over = lambda key, n: lambda rows: rows.repartition(max(1, min(n, 4096)), key)  # noqa: E731  packed rows are small for their work: partitions are not to be merged
        by_bucket, by_chunk = over("bucket", 1 << bits), over("chunk", n_chunks)
        words = stored(numbered(by_bucket(asked(chunks, bits)), bits), "lm-words")
        stats = {r["chunk"]: r for r in words.filter(F.col("kind") == STATS).groupBy("chunk").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}  # 64 magnitudes at most
        all_words, all_tokens = (np.array([stats[k][c] if k in stats else 0.0 for k in range(64)]) for c in "xy")
        ids = words.filter(F.col("kind") == IDS)
        pairs = asked_pairs(by_chunk(chunks.union(ids)), folder, bits, hot)
        seats = stored(sampled(by_bucket(pairs), bits, all_words, all_tokens), "lm-seats")
        totals = {r["chunk"]: (r["x"], r["y"]) for r in seats.filter(F.col("kind") == STATS).groupBy("chunk").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
        none = (0.0, 0.0)
        model = {
            "words": all_words.sum(), "tokens": all_tokens.sum(), "d1": discount(*totals.get(-1, none)), "d0": discount(*totals.get(-2, none)),
            "c0": [totals.get(s, none)[0] for s in range(SAMPLES)], "t0": [totals.get(s, none)[1] for s in range(SAMPLES)],
        }
        known = facts(by_bucket(words.filter(F.col("kind").isin(TABLE, IDS)).union(seats.filter(F.col("kind").isin(TOTALS, ROOT)))))
        rows = by_chunk(chunks.union(known).union(seats.filter(F.col("kind") == SEATS)))
        out = keep(stored(segment_scores(rows, folder, bits, hot, model), "lm-scores"))
        remove(spark, folder)
    # parts of a text longer than a chunk are added up
    each = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return each.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(model["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")
