"""Quality rules by repetition coverage: how much of a text lies inside n-grams and lines that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import MIX_1, blocks, mixed, raw

SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars double, dup_5gram_chars double, dup_7gram_chars double, dup_10gram_chars double, symbol_share double, reasons string"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; a document fails above any of them."""

    min_words: int = 50
    repeat_words_percent: int = 50
    dup_line_chars: float = 0.30
    symbols_per_word_char: float = 0.10
    #: n-gram length in words: largest share of word characters inside n-grams that occur more than once.
    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.30, 10: 0.30})


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an ``n``-word window that occurs twice or more; overlapping occurrences count.

    A window's polynomial hash comes from the hash of the window one word shorter, so that all lengths share the work;
    here it is built by doubling, in numpy, over the whole text.
    """
    covered = np.zeros(len(ids), dtype=bool)
    m = len(ids) - n + 1
    if m < 2:
        return covered
    h, have = ids, 1
    acc, at = None, 0
    left = n
    while left:  # binary expansion of n: windows of 1, 2, 4 ... words joined end to end
        if left & 1:
            part = h[at : at + m]
            acc = part if acc is None else mixed(acc * MIX_1 + part)
            at += have
        left >>= 1
        if left:
            h = mixed(h[: len(h) - have] * MIX_1 + h[have:]) if len(h) > have else h[:0]
            have *= 2
    order = np.argsort(acc, kind="stable")
    s = acc[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(m, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(text: bytes, rules: Rules) -> tuple:
    """All columns of one text but its doc_id."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    continued = np.frombuffer(joined, dtype=np.uint8) & 0xC0 == 0x80
    word_chars = len(joined) - int(continued.sum())
    if n and word_chars != len(joined):
        sizes = sizes - np.add.reduceat(continued.astype(np.int64), np.cumsum(sizes) - sizes)
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))

    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(b"".join(line.split()).decode("utf-8", "replace"))
            else:
                seen.add(line)

    numbers: dict[bytes, int] = {}
    ids = mixed(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=n) + MIX_1)
    n_repeat = int(repeated(ids, 3).sum())
    total = max(word_chars, 1)
    coverage = {k: float(sizes[repeated(ids, k)].sum() / total) for k in rules.ngram_chars}
    base_failed = n < rules.min_words or 100 * n_repeat > rules.repeat_words_percent * n
    reasons = [f"{k}-gram" for k, most in rules.ngram_chars.items() if coverage[k] > most]
    if dup_line_chars / total > rules.dup_line_chars:
        reasons.append("lines")
    if n_symbols / total > rules.symbols_per_word_char:
        reasons.append("symbols")
    if base_failed:
        reasons.insert(0, "base")
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, not reasons, dup_line_chars / total, *(coverage.get(k, 0.0) for k in (5, 7, 10)), n_symbols / total, ",".join(reasons)


def repetition_coverage(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per document row with its measures and verdict; no shuffle.

    A null text counts as an empty one, which fails the base rule. Repeated rows give repeated results, a null doc_id stays null,
    other columns are ignored, and an empty table gives an empty result. Texts are measured whole, however long.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
        for batch in blocks(batches):
            rows = [measures(text or b"", rules) for text in raw(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in zip(*rows, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
