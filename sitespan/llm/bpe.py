"""Byte-level BPE by a local rank file: encoding, and decoding to raw bytes.

The tiktoken library does the merges. A long text is cut beforehand at places
where the pre-splitting pattern must end one match and begin another, so each
call gets a bounded text and the ids are those of the whole text: between a
character that is not white space and a single U+0020 before another such
character. No alternative of the pattern holds an inner space, and the space
there always begins a match (a run of white space is never cut).

Null and empty texts give no ids; an id may repeat or be null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import claim, row_mapper

SAFE = re.compile(r"(?<=\S) (?=\S)")

def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; kept for the life of the worker."""
    held, key = claim(__name__), (rank_file, pattern)
    if key not in held:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return held[key]


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str | None, size: int = 1 << 16) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in enc.encode_ordinary(part)]


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, and its text's token ids (empty for null or empty texts)."""

    def make():
        enc = encoding(rank_file, pattern)
        return lambda cols: [cols[0], [encode(enc, t) for t in cols[1]]]

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return row_mapper(d, "doc_id long, ids array<int>", [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int32()))], make)


def bpe_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id, and the raw bytes that its token ids stand for (null ids: empty)."""

    def make():
        enc = encoding(rank_file, pattern)
        return lambda cols: [cols[0], [enc.decode_bytes(x or []) for x in cols[1]]]

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids"))
    return row_mapper(d, "doc_id long, bytes binary", [pa.field("doc_id", pa.int64()), pa.field("bytes", pa.binary())], make)


def bpe_digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding, then decoding of those ids, reduced to digests in the same task so that no ids are moved.

    Null texts are empty ones. Rows that repeat all stay, null ids stay; an
    empty table gives none; other columns, whatever their names, are not looked at.
    """

    def make():
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        sha = hashlib.sha256

        def work(cols):
            n, a, b = [], [], []
            for text in cols[1]:
                ids = encode(enc, text)
                n.append(len(ids))
                a.append(sha(" ".join([names[i] for i in ids]).encode()).hexdigest())
                b.append(sha(enc.decode_bytes(ids)).hexdigest())
            return [cols[0], n, a, b]

        return work

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return row_mapper(d, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", fields, make)
