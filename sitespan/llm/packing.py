"""Best-fit packing of token sequences into fixed-length training sequences.

Bounded-space online best-fit: each task keeps a fixed number of open bins,
filed in a bitset by their free space. A piece goes to the bin with the least
free space that holds it; when none does, a new bin opens, and if that is one
too many, the fullest closes. What each task leaves open at its end goes, as
pieces of their own (bin contents move whole), through the same packing again
in groups of a bounded number of tasks.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import claim, stored

OPEN = 128
GROUP = 256  # tasks whose open bins are packed again together

# What a tokenizer file has to say for its words to be encoded one by one: white space is dropped and never joined across.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
# Characters on which normalisation is lower-casing alone; other words go through the whole tokenizer.
PLAIN = regex.compile(r"[!-~À-įı-ɏ]+")


class Memory(dict):
    """A dictionary of bounded size: when full, what was not asked for since the last time is forgotten."""

    def __init__(self, most: int, make) -> None:
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Words:
    """Token ids of white-space-separated words, as packed 32-bit integers.

    A text's ids are its words' ids one after the other if the tokenizer drops
    white space and never joins across it. Whether it does, and how it splits
    words, comes from its file; a file that says otherwise raises ValueError.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        first, *rest = said["pre_tokenizer"].get("pretokenizers", [said["pre_tokenizer"]])
        rule = first.get("pattern", {}).get("Regex", "")
        whole = said["normalizer"] == {"type": "Sequence", "normalizers": NORMAL} and said["model"]["type"] == "BPE" and not said["model"].get("byte_fallback") and not said["post_processor"]
        split = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not (rest[0]["add_prefix_space"] or rest[0]["use_regex"])
        probes = (" a", "a b", "a ", " 1", "! !", "\n\t", "a\nb", " '", "1 1")
        if not (whole and split) or any(regex.search(r"\s", m[0]) for x in probes for m in regex.finditer(rule, x)):
            raise ValueError(f"{path}: words of this tokenizer cannot be encoded one by one")
        self.split = regex.compile(rule)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes = str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(hidden)})
        self.known = Memory(most, self.word)
        self.letters = all(self.split.findall(x) == [x] for x in ("a", "word", "st", "z" * 99))  # whether a run of letters is one part

    def part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.bytes))
        return array("I", [t.id for t in tokens]).tobytes()

    def word(self, data: bytes) -> bytes:
        if self.letters and data.isalpha():  # letters of ASCII stand for themselves
            return array("I", [t.id for t in self.model.tokenize(data.lower().decode())]).tobytes()
        w = data.decode()
        if not PLAIN.fullmatch(w):
            return array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()
        parts = self.split.findall(w.lower())
        if len(parts) == 1:
            return self.part(parts[0])
        # a part is a word, too: one memory serves both
        return b"".join([self.known[x.encode()] for x in parts])

    def ids(self, text: str | None) -> np.ndarray:
        known = self.known
        return np.frombuffer(b"".join([known[w] for w in (text or "").encode("utf-8", "replace").split()]), np.uint32)


def words(path: str) -> Words:
    held = claim("packing")
    if path not in held:
        held[path] = Words(path)
    return held[path]


class Bins:
    """Open bins of one size, by free space."""

    def __init__(self, size: int, most: int = OPEN) -> None:
        self.size, self.most = size, most
        self.mask = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.opened = self.open = 0

    def file(self, bin_: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.mask |= 1 << free

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        return out

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it where a piece goes."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self.take(free)
        else:
            bin_, free = self.opened, self.size
            self.opened += 1
            self.open += 1
        left = free - length
        if left:
            self.file(bin_, left)
        else:
            self.open -= 1
        if self.open > self.most:
            self.take((self.mask & -self.mask).bit_length() - 1)
            self.open -= 1
        return bin_, self.size - free

    def left(self) -> Iterator[tuple[int, int]]:
        """Open bins and what they hold."""
        for free, bins in self.by_free.items():
            for b in bins:
                yield b, self.size - free


def pack(df: DataFrame, tokenizer_file: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its text's ids and `end_id` (null or empty text: that alone).
    Only a document of more than `size` ids is cut, into pieces of `size`; a
    full piece is a sequence by itself. Ids may be null or repeat: rows are
    placed one by one. An empty table gives none; other columns, whatever their
    names, are not looked at.
    """
    fields = [
        pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()),
        pa.field("ids_crc32", pa.int64()), pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()),
    ]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    shape = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bins = words(tokenizer_file), Bins(size)
        base = TaskContext.get().partitionId() << 40

        def made(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, shape, strict=True)], schema=shape)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [[] for _ in fields]
                for key, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    ids = np.append(w.ids(text), np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), size)):
                        part = ids[start : start + size]
                        bin_, offset = bins.put(len(part))
                        for c, v in zip(out, (key, k, start, len(part), zlib.crc32(part.tobytes()), base + bin_, offset, part), strict=False):
                            c.append(v)
                yield made(out)
        if left := list(bins.left()):  # piece -1: what an open bin holds
            n = len(left)
            yield made([[None] * n, [-1] * n, [0] * n, [x for _, x in left], [0] * n, [base + b for b, _ in left], [0] * n, [None] * n][: len(fields)])

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    placed = stored(d.mapInArrow(run, schema), "packed")

    def again(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "sequence_id"], ascending=[False, True])
        bins = Bins(size)
        to = [bins.put(int(x)) for x in left["length"]]
        first: dict[int, int] = {}  # a new bin is named after the first that it takes in
        names = [first.setdefault(b, old) for (b, _), old in zip(to, left["sequence_id"], strict=True)]
        return pd.DataFrame({"old": left["sequence_id"], "new": names, "shift": [x for _, x in to]})

    open_bins = placed.filter("piece = -1").select("sequence_id", "length", F.floor(F.shiftright("sequence_id", 40) / GROUP).alias("g"))
    moves = open_bins.groupBy("g").applyInPandas(again, "old long, new long, shift long")
    p = placed.filter("piece >= 0")
    joined = p.join(moves, p["sequence_id"] == moves["old"], "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("new", "sequence_id").alias("sequence_id"),
        (p["offset"] + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )
