"""Near duplicates: MinHash signatures in an LSH forest, and exact checks.

A document's set is its distinct five-word shingles. Documents with the same
words are one class, found by a digest and stood for by the smallest id; the
rest runs over classes.

* Signatures: VALUES minima of permutations of the shingles' hashes. Each of
  TREES trees is a sorted order of all classes by its own sequence of signature
  values. The orders are one table, sorted over range partitions; a class's
  neighbours there are those with the longest common prefixes.
* Depth adapts. Classes whose common prefix has LEAST or more values form a
  region, which is a run of the order. A run of up to REGION classes gives all
  its pairs. A larger one is looked at by deeper prefixes until its runs are
  small; within all of it each class pairs with the next in the order, too.
  So no large group is expanded, and no key gathers a region in one task.
* Runs that reach a partition's ends go on in the next one: up to REGION
  classes of each end are sorted once more and looked at together.
* Pairs pass a check on whole signatures (an estimate far below the limit
  drops out); those that stay are confirmed on full shingle sets. Of a class's
  pairs the likeliest is confirmed first; pairs within one component then need
  no further look.
* Of large regions a few trees give pairs that way. What then still lies
  between components in the large regions of any tree is compared exactly, on
  full sets and in blocks of bounded size.
* Components: links counted to be few enough are united in one task; beyond
  that, alternating large and small stars take a logarithmic number of rounds
  of joins, each written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, dropped, scratch, stored
from .hashing import mixed, word_hashes

WORDS = 5
VALUES, TREES, LEAST = 160, 64, 6
CHAIN_TREES = 6  # trees whose large regions give pairs in the first round
DEPTHS = (LEAST, 8, 10, 12, 15)
ORDERED = 1 << 18  # rows of the sorted orders in a range partition, about
REGION = 24
LIMIT = 0.75
BLOCK, BLOCK_SHINGLES = 512, 1 << 18  # a block of classes that is compared with another in one task: about so many, and so many shingles
SALTS = 16  # parts over which the copies of a text are dealt while they find their class, and the classes of a region
# A signature shows a true similarity of LIMIT with a standard deviation of sqrt(.75 * .25 / 160) = 0.034; six of them lie between.
CHECK = 0.54
_ODD = (np.random.default_rng(20).integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_ADD = np.random.default_rng(21).integers(0, 2**32, VALUES, dtype=np.uint32)
_ORDER = np.stack([np.random.default_rng(100 + t).permutation(VALUES)[: DEPTHS[-1]] for t in range(TREES)])
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of word hashes; fewer words: of the whole sequence."""
    if not len(words):
        return words
    n = min(WORDS, len(words))
    k = len(words) - n + 1
    out = np.full(k, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _P + words[i : i + k]
    return np.unique(mixed(out))


def word_sequence(text: str | None) -> bytes:
    """A text's words with A-Z in lower case, joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list[np.ndarray]]]:
    """Batches of (id, text) in small slices, with the texts and their shingle sets."""
    claim("neardup")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(1).to_pylist()
            h, counts = word_hashes(texts)
            yield part, texts, [shingles(w) for w in np.split(h, np.cumsum(counts)[:-1])]


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each of VALUES minima; of a bounded block of shingles at a time."""
    low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sig = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 512):
            block = low[at : at + 512, None] * _ODD[None, :]
            block += _ADD
            block ^= block >> np.uint32(15)
            block *= np.uint32(0x2C1B3C6D)
            np.minimum(sig, block.min(axis=0), out=sig)
    return (sig & np.uint32(0xFFFF)).astype(np.uint16)


def order_keys(sigs: np.ndarray) -> np.ndarray:
    """Sort keys of signatures in all trees (rows x 2 integers): a byte for the tree, then one of each value in the tree's sequence."""
    key = np.empty((len(sigs), TREES, 16), np.uint8)
    key[:, :, 0] = np.arange(TREES)
    key[:, :, 1:] = (sigs & np.uint16(0xFF)).astype(np.uint8)[:, _ORDER]
    return key.reshape(-1, 16).view(">i8").astype(np.int64)


def signed(d: DataFrame) -> DataFrame:
    """doc_id, n_shingles, words (digest of the word sequence; null without words), sig (binary)."""
    shape = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("words", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, sets in shingled(batches):
            digests = [hashlib.blake2b(word_sequence(t), digest_size=16).digest() if len(x) else None for t, x in zip(texts, sets, strict=True)]
            sigs = [signature(x).tobytes() if len(x) else None for x in sets]
            n = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=shape)

    return d.mapInArrow(run, "doc_id long, n_shingles long, words binary, sig binary")


def ordered(reps: DataFrame) -> DataFrame:
    """From (id, sig): hi, lo, id for each tree, sorted over range partitions of about ORDERED rows, whatever values are frequent."""
    shape = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                key = order_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, VALUES))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(ids)], schema=shape)

    parts = max(1, -(-reps.count() * TREES // ORDERED))
    rows = reps.select("id", "sig").mapInArrow(run, "hi long, lo long, id long")
    return rows.repartitionByRange(parts, "hi", "lo", "id").sortWithinPartitions("hi", "lo", "id")


def runs(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run each row is in, and its size; `common` is the prefix a row shares with the one before."""
    of = np.cumsum(common < depth) - 1
    return of, np.bincount(of)[of]


PAIR, REGIONAL, EDGE = range(3)


def neighbours(rows: DataFrame, inner: bool = True) -> DataFrame:
    """From sorted (hi, lo, id), a partition at a time: PAIR (a, b), REGIONAL (a: a class, b: the large region it is in), and, for the inner of a table, EDGE (a, hi, lo): rows of runs at the partition's ends."""
    shape = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def made(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.nulls(len(cols[0]), pa.int64())] * (4 - len(cols))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *arrays], schema=shape)

    def near(ids: np.ndarray, of: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        """Pairs of rows of one run at a distance of up to `most`."""
        for k in range(1, min(most, len(ids) - 1) + 1):
            i = np.flatnonzero(of[:-k] == of[k:])
            if not len(i):
                return
            yield made(PAIR, np.minimum(ids[i], ids[i + k]), np.maximum(ids[i], ids[i + k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        hi, lo, ids = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(3))
        key = np.stack([hi, lo], axis=1).astype(">i8").view(np.uint8).reshape(-1, 16)
        differs = key[1:] != key[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), 16) - 1  # the first byte is the tree
        common = np.concatenate([[-1], common])
        of, size = runs(common, LEAST)
        if inner:
            place = np.arange(len(ids))
            first = (of == 0) & (place < REGION)
            last = (of == of[-1]) & (place >= len(ids) - REGION)
            i = np.flatnonzero(first | last)
            yield made(EDGE, ids[i], ids[i] * 0, hi[i], lo[i])
        small = size <= REGION
        yield from near(ids[small], of[small], REGION - 1)
        live = np.flatnonzero(~small)
        with np.errstate(over="ignore"):
            region = mixed((hi[live] >> 8).view(np.uint64) * _P)  # the tree and LEAST values
        yield made(REGIONAL, ids[live], region.view(np.int64))
        live = live[key[live, 0] < CHAIN_TREES]
        yield from near(ids[live], of[live], 1)
        for depth in DEPTHS[1:]:
            # runs of a depth lie within those of the one before, so the rows that are left are whole runs
            of, size = runs(common, depth)
            small = size[live] <= REGION
            yield from near(ids[live[small]], of[live[small]], REGION - 1)
            live = live[~small]

    return rows.mapInArrow(run, "kind int, a long, b long, hi long, lo long")


def ids_of(rows: DataFrame, *cols: str) -> DataFrame:
    out = rows.select(F.col(cols[0]).alias("id"))
    for c in cols[1:]:
        out = out.union(rows.select(F.col(c).alias("id")))
    return out.distinct()


def bounded(ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A list of ids, marked for broadcast if it is counted to be small; else joined by shuffling."""
    return F.broadcast(ids) if ids.count() <= most else ids


def checked(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, like: pairs whose signatures' agreement is CHECK or more."""
    left = pairs.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    both = left.join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("like", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, VALUES) for i in (2, 3))
            like = (x == y).mean(axis=1).astype(np.float32)
            keep = like >= CHECK
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(like[keep])], schema=shape)

    return both.mapInArrow(run, "a long, b long, like float")


def sets(d: DataFrame, ids: DataFrame) -> DataFrame:
    """id and set (64-bit shingle hashes) of the documents named."""
    shape = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, made in shingled(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in made], shape[1].type)], schema=shape)

    return d.join(ids, d["doc_id"] == ids["id"], "left_semi").select("doc_id", "text").mapInArrow(run, "id long, set array<long>")


def confirmed(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as LIMIT; rows of long sets stay in the JVM, where they can spill."""
    full = stored(sets(d, bounded(ids_of(pairs, "a", "b"))), "neardup-sets")
    left = pairs.select("a", "b").join(full.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = left.join(full.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    # 100 n >= 75 (x + y - n)
    good = both.filter(7 * F.size(F.array_intersect("sa", "sb")) >= 3 * (F.size("sa") + F.size("sb")))
    out = stored(good.select("a", "b"), "neardup-links")
    dropped(d.sparkSession, full)
    return out


def united(links: DataFrame) -> DataFrame:
    """v, c as components() gives them, of links that fit in one task: union by the smaller node."""
    shape = pa.schema([("v", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        v = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array([root(x) for x in v], pa.int64())], schema=shape)

    return links.select("a", "b").coalesce(1).mapInArrow(run, "v long, c long").filter("v != c")


def components(links: DataFrame, at_once: int = 1 << 19) -> DataFrame:
    """v, c: the smallest node reachable, for each node of the links (a, b) that is not that node itself.

    Links counted to be at most `at_once` are united in one task; more go
    through alternating large and small stars, until a round changes nothing.
    """
    if links.count() <= at_once:
        return stored(united(links), "neardup-components")
    spark = links.sparkSession
    now = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("c")).filter("v != c")
    before, old = None, None
    while True:
        both = now.union(now.select(F.col("c").alias("v"), F.col("v").alias("c")))
        low = both.groupBy("v").agg(F.least(F.min("c"), F.col("v")).alias("m"))
        large = both.join(low, "v").filter("c > v").select(F.col("c").alias("v"), F.col("m").alias("c"))
        low = large.groupBy("v").agg(F.min("c").alias("m"))
        small = large.join(low, "v")
        nxt = small.select(F.col("c").alias("v"), F.col("m").alias("c")).union(low.select("v", F.col("m").alias("c"))).filter("v != c").distinct()
        now = stored(nxt, "neardup-stars")
        state = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("c").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "c"))).first()
        if old is not None:
            dropped(spark, old)
        if state == before or not state[0]:
            return now
        before, old = state, now


def labelled(ids: DataFrame, comp: DataFrame, col: str, name: str) -> DataFrame:
    """Adds the component of a column's class; a class without links is its own."""
    c = comp.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
    return ids.join(c, ids[col] == c["_v"], "left").withColumn(name, F.coalesce("_c", col)).drop("_v", "_c")


def linked(pairs: DataFrame, links: DataFrame | None, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links, those there were included, and their components, after all checked pairs (a, b, like) that matter.

    Of each class the likeliest pair is confirmed first, then what still lies between components.
    """
    best = pairs.groupBy("b").agg(F.max(F.struct("like", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    got = confirmed(best, d)
    links = got if links is None else links.union(got)
    comp = components(links)
    rest = labelled(labelled(pairs, comp, "a", "ca"), comp, "b", "cb").filter("ca != cb").select("a", "b")
    rest = stored(rest.join(best, ["a", "b"], "left_anti"), "neardup-rest")
    if rest.limit(1).count():
        got = confirmed(rest, d)
        if got.limit(1).count():
            links = links.union(got)
            comp = components(links)
    return links, comp


def compared(rows: DataFrame) -> DataFrame:
    """From (task, side, id, c, set): links (a, b) that join what is linked between components c; of all pairs of a task's two sides, or within the one side it has."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        side, ids, c = (part.column(k).to_numpy() for k in ("side", "id", "c"))
        sets = [x.values.to_numpy() for x in part.column("set")]
        sizes = np.array([len(x) for x in sets])
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        often = times > 1  # others are in no two sets
        new = np.cumsum(often) - 1
        row, col = row[often[col]], new[col[often[col]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if (side == 1).any() else x
        common = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, int(often.sum()), 8192):
            k = slice(*np.searchsorted(col, (at, at + 8192)))
            has = np.zeros((len(sets), 8192), np.float32)
            has[row[k], col[k] - at] = 1
            common += has[x] @ has[y].T
        n = common.astype(np.int64)
        good = (n > 0) & (100 * n >= 75 * (sizes[x][:, None] + sizes[y][None, :] - n)) & (c[x][:, None] != c[y][None, :])
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (t := up.get(v, v)) != v:
                up[v] = up.get(t, t)
                v = t
            return v

        a, b = [], []
        for i, j in zip(*(v.tolist() for v in np.nonzero(good)), strict=True):
            i, j = x[i], y[j]
            u, v = root(int(c[i])), root(int(c[j]))
            if u != v:
                up[max(u, v)] = min(u, v)
                a.append(int(min(ids[i], ids[j])))
                b.append(int(max(ids[i], ids[j])))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=shape)

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def between_components(large: DataFrame, comp: DataFrame, d: DataFrame) -> DataFrame | None:
    """Links between components among the classes of large regions that hold several, on full sets; None: no such region.

    Regions that share a class are one crowd. Its classes are dealt to blocks by
    a hash, those of a component that fills blocks to its own, and each two
    blocks are compared in a task, but for two of one component.
    """
    rows = labelled(large.select("id", "k0"), comp, "id", "c")
    several = rows.groupBy("k0").agg(F.min("id").alias("hub"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high")
    several = several.select("k0", "hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a region may hold a third of all classes
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = stored(rows.join(several, ["k0", "salt"]).select("id", "c", "hub").distinct(), "neardup-mixed")
    if not rows.limit(1).count():
        return None
    crowds = components(rows.filter("hub != id").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    rows = labelled(rows.select("id", "c").distinct(), crowds, "id", "crowd")
    # an id that stands for several texts has several sets; each is compared
    rows = stored(rows.join(sets(d, bounded(rows.select("id").distinct())), "id"), "neardup-sets")
    of = rows.groupBy("crowd", "c").agg(F.sum(F.lit(1.0) / BLOCK + F.size("set") / BLOCK_SHINGLES).alias("n")).withColumn("own", F.when(F.col("n") >= 0.5, F.col("c")))
    many = of.groupBy("crowd", "own").agg(F.ceil(F.sum("n")).alias("blocks"))
    full = rows
    rows = rows.select("id", "c", "crowd").distinct().join(of.drop("n"), ["crowd", "c"])
    rows = rows.join(many.withColumnsRenamed({"crowd": "_crowd", "own": "_own"}), (F.col("crowd") == F.col("_crowd")) & F.col("own").eqNullSafe(F.col("_own")))
    block = F.concat_ws(":", F.col("crowd").cast("string"), F.coalesce(F.col("own").cast("string"), F.lit("-")), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("string"))
    rows = stored(rows.select("id", "c", "crowd", "own", block.alias("block")), "neardup-blocks")
    blocks = rows.select("crowd", "own", "block").distinct()
    x, y = (blocks.select("crowd", F.col("own").alias(f"own_{k}"), F.col("block").alias(k)) for k in "xy")
    tasks = x.join(y, "crowd").filter("x <= y and (own_x is null or own_y is null or own_x != own_y)").select(F.concat_ws("|", "x", "y").alias("task"), "x", "y")
    sides = tasks.select("task", F.lit(0).alias("side"), F.col("x").alias("block")).union(tasks.filter("x != y").select("task", F.lit(1), "y"))
    got = stored(compared(sides.join(rows.join(full.select("id", "set"), "id").select("block", "id", "c", "set"), "block").select("task", "side", "id", "c", "set")), "neardup-links")
    dropped(d.sparkSession, full)
    return got


def classes_linked(reps: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all classes which are connected, and their components."""
    inner = stored(neighbours(ordered(reps)), "neardup-neighbours")
    # a few rows a partition: what runs over from one into the next
    edges = inner.filter(F.col("kind") == EDGE).select("hi", "lo", F.col("a").alias("id")).repartition(1).sortWithinPartitions("hi", "lo", "id")
    found = inner.filter(F.col("kind") != EDGE).union(stored(neighbours(edges, inner=False), "neardup-edges"))
    pairs = stored(found.filter(F.col("kind") == PAIR).select("a", "b").filter("a != b").distinct(), "neardup-pairs")
    links, comp = linked(stored(checked(pairs, reps), "neardup-checked"), None, d)
    large = found.filter(F.col("kind") == REGIONAL).select(F.col("a").alias("id"), F.col("b").alias("k0"))
    if large.limit(1).count():
        more = between_components(large.distinct(), comp, d)
        if more is not None:
            links = links.union(more)
            comp = components(links)
    return links, comp


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts without words have no shingles and are linked with nothing. Rows with
    the same words are in one component. An id that stands for several texts is
    one node, linked with what any of them is linked with; a null id is linked
    with nothing, its component_id is null and it is kept. An empty table gives
    none; other columns, whatever their names, are not looked at.
    """
    spark = df.sparkSession
    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    with scratch(spark) as keep:
        all_rows = stored(signed(d), "neardup-signed")
        named = all_rows.filter("words is not null and doc_id is not null")
        # copies of a text may be a third of all rows: they are counted before they move, and their class is dealt out over SALTS parts
        classes = named.groupBy("words").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).filter("n > 1").select("words", "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = all_rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        own = F.when(F.col("words").isNotNull(), F.col("doc_id"))
        of_row = keep(stored(salted.join(classes, ["words", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("id", own).alias("id"), "sig"), "neardup-rows"))
        reps = stored(of_row.filter("doc_id = id").groupBy("id").agg(F.min("sig").alias("sig")), "neardup-classes")
        dropped(spark, all_rows)
        copies = of_row.filter("doc_id is not null and id is not null and doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        links, comp = classes_linked(reps, d)
        # an id with several texts has several classes; where that happens the components of copies are joined, too
        shared = of_row.filter("doc_id is not null and id is not null").groupBy("doc_id").agg(F.count_distinct("id").alias("n")).filter("n > 1")
        if shared.limit(1).count():
            comp = components(links.union(copies))
        keep(comp)
    out = labelled(of_row.withColumn("node", F.coalesce("id", "doc_id")), comp, "node", "component_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
