"""Integer vectors, code compression and clustering against plain Python, with ties, repeats, odd and huge rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from sitespan.llm import clustering, compression, queries, vectors

NAN, INF = float("nan"), float("inf")


def exact(v, scale):
    return [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_rounds(rows, start, rounds):
    """Lloyd's rounds with floor means; final assignment as (entry, distance) of each row."""
    c = [list(s) for s in start]
    for r in range(rounds + 1):
        near = [min((gap(x, e), i) for i, e in enumerate(c)) for x in rows]
        if r == rounds:
            return c, near
        for i in range(len(c)):
            mine = [x for x, (_, j) in zip(rows, near, strict=True) if j == i]
            if mine:
                c[i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]


def order(v):
    return [(x is not None, x) for x in v]


def plain_codes(rows, parts=8, entries=16, scale=4096, rounds=6):
    kept = [r for r in rows if good(r[1])]
    can = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not can:
        return {}, None
    size = len(can[0][1])
    cut = size // parts
    first = [exact(r[1], scale) for r in can if len(r[1]) == size][:entries]
    fit = [(n, exact(r[1], scale)) for n, r in enumerate(kept) if len(r[1]) == size]
    codes, errors, books = {n: "" for n, _ in fit}, {n: 0 for n, _ in fit}, []
    for p in range(parts):
        s = slice(p * cut, (p + 1) * cut)
        c, near = plain_rounds([x[s] for _, x in fit], [f[s] for f in first], rounds)
        books += [v for e in c for v in e]
        for (n, _), (d, e) in zip(fit, near, strict=True):
            codes[n] += f"{e:02x}"
            errors[n] += d
    out = []
    for n, r in enumerate(kept):
        same = [errors.get(m) for m, q in enumerate(kept) if q[2] == r[2]]
        whole = sum(same) if None not in same and max(same) < 2**63 and sum(same) < 2**63 else None
        e = errors.get(n)
        out.append((r[0], codes.get(n), e if e is None or e < 2**63 else None, whole))
    return sorted(out, key=repr), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def plain_clusters(rows, size=64, k=8, scale=1024, rounds=10):
    kept = [r for r in rows if good(r[1]) and len(r[1]) == size]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    first = [exact(r[1], scale) for r in sorted(kept, key=key)[:k]]
    if not kept:
        return []
    c, near = plain_rounds([exact(r[1], scale) for r in kept], first, rounds)
    by = [sum(d for d, j in near if j == i) for i in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in c]
    long = lambda v: v if v < 2**63 else None
    return sorted(((r[0], j, long(d), long(by[j]), long(sum(by)), sha[j]) for r, (d, j) in zip(kept, near, strict=True)), key=repr)


def table(n=160, seed=1, size=64):
    rng = random.Random(seed)
    some = [[rng.gauss(0, 0.2) for _ in range(size)] for _ in range(n // 2)]
    coarse = [[rng.choice([-1, 0, 1]) / 4 for _ in range(size)] for _ in range(n // 4)]  # many equal distances
    rows = [(i, v, rng.choice([None, 1, 2])) for i, v in enumerate(some + coarse + coarse[: n // 8] + some[:3])]
    rows += [(5, rows[5][1], 1), (None, rows[7][1], 2), (None, [0.5] * size, None)]
    odd = [None, [], [1.0], [0.25] * (size + 8), [0.1] * (size - 1) + [None], [0.1] * (size - 1) + [NAN], [INF] * size, [-INF] + [0.0] * (size - 1)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, kind="double"):
    # columns whose names are also those of results and helpers
    return spark.createDataFrame([(*r, "x", 1.5, None) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, distance double, error long").repartition(3)


def codes_of(df):
    got = df.collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr), {r.codebooks_sha256 for r in got}


@pytest.mark.parametrize("scale_up", [1.0, 2.0**14, 2.0**60])  # within int64, across its bound, far beyond it
def test_codes(spark, scale_up):
    rows = [(i, v and [x if x is None else x * (scale_up if i is not None and i % 5 == 0 else 1) for x in v], lab) for i, v, lab in table()]
    want, sha = plain_codes(rows)
    got, shas = codes_of(compression.compressed(frame(spark, rows)))
    assert got == want
    assert shas == {sha}


@pytest.mark.parametrize("scale_up", [1.0, 2.0**16, 2.0**62])
def test_clusters(spark, scale_up):
    rows = [(i, v and [x if x is None else x * (scale_up if i is not None and i % 5 == 0 else 1) for x in v], lab) for i, v, lab in table()]
    got = clustering.clustered(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=repr) == plain_clusters(rows)


def test_few_and_no_rows(spark):
    few = table()[:6]
    assert codes_of(compression.compressed(frame(spark, few)))[0] == plain_codes(few)[0]
    assert len(clustering.clustered(frame(spark, few)).collect()) == len(plain_clusters(few))
    for rows in ([], [(1, None, 1), (2, [NAN] * 64, 2)]):
        assert compression.compressed(frame(spark, rows)).collect() == []
        assert clustering.clustered(frame(spark, rows)).collect() == []
    only = [(1, [], 1), (2, [1.0], 1)]  # nothing that can be cut
    assert codes_of(compression.compressed(frame(spark, only)))[0] == [(1, None, None, None), (2, None, None, None)]


def test_the_queries_on_float_columns(spark, tmp_path):
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in table()]
    frame(spark, rows, "float").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, sha = plain_codes(rows)
    got, shas = codes_of(queries.op11_vector_codes(spark, str(tmp_path)))
    assert (got, shas) == (want, {sha})
    got = queries.op13_clusters(spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=repr) == plain_clusters(rows)


def test_screening_never_loses_the_nearest():
    """Entries that float32 cannot tell apart: distances differ by little against numbers of 25 bits, or not at all."""
    rng = np.random.default_rng(3)
    for high in (10, 1 << 12, 1 << 25):
        base = rng.integers(-high, high, 8)
        c = base + rng.integers(-2, 3, (16, 8))
        x = base + rng.integers(-3, 4, (4000, 8))
        at, d = compression.Screen(c).nearest(x)
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all()
        assert (d == every.min(axis=1)).all()


def test_abandoning_changes_the_work_only():
    rng = np.random.default_rng(5)
    c = rng.integers(-400, 400, (8, 64))
    x = c[rng.integers(0, 8, 3000)] + rng.integers(-60, 60, (3000, 64))
    x[::7] = (c[0] + c[1]) // 2  # equal or nearly equal distances
    c[5] = c[2]
    order = np.argsort(-x.var(axis=0))
    search = clustering.PartialSearch(clustering.Centroids(1, c, order))
    at, d = search.nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all()
    assert (d == every.min(axis=1)).all()
    assert search.finished < 0.5 * every.size


def test_sums_beyond_a_long():
    s = vectors.Sums(1, 2, 2)
    big = np.array([[2**80, -(2**79)]], object)
    s.add(0, np.array([1]), big)
    s.add(0, np.array([1, 0]), np.array([[3, -5], [-(2**20), 7]]))
    found = {}
    for p, e, i, limb, total in zip(*(c.to_pylist() for c in s.batch().columns), strict=True):
        found[p, e, i] = found.get((p, e, i), 0) + (total << (vectors.LIMB * limb))
    assert found == {(0, 1, 0): 2**80 + 3, (0, 1, 1): -(2**79) - 5, (0, 1, 2): 2, (0, 0, 0): -(2**20), (0, 0, 1): 7, (0, 0, 2): 1}


def test_group_totals_with_hot_groups(spark):
    rows = [(k, 1) for k in ["a"] * 50 + [None] * 40 + ["b", "c", "c", "d"]] + [("d", None), ("e", 2**62), ("e", 2**62)]
    got = vectors.with_group_total(spark.createDataFrame(rows, "k string, v long"), "k", "v", "s", hot=2)
    assert got.columns == ["k", "v", "s"]
    assert sorted({(r.k or "", r.s) for r in got.collect()}, key=repr) == sorted({("a", 50), ("", 40), ("b", 1), ("c", 2), ("d", None), ("e", None)}, key=repr)
    assert got.count() == len(rows)
