"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and stripped to words joined by single spaces, with one more space on either side
that counts as a letter: so an item without edits stands between word boundaries ("cat" isn't found in "concatenate").
An item of m characters may occur with up to k = floor(error_rate * m) edits. It is split into k + 1 pieces, one of which
must then occur as it is. An automaton finds all piece hits in a text in one pass; around each the item is verified by
Myers' bit-parallel distance.

The items are a stated query set: they are read in blocks of bounded size, each of which passes over all texts. Items
without a word match nothing; null and empty texts hold nothing; each occurrence counts, a row (doc_id, item_id) is
returned once with its least distance, first end and number of hit places; rows with equal doc_id are judged apart;
empty tables give no rows.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, in_pieces, table, text_or_empty

ERROR_RATE = 0.06
BLOCK_BYTES = 4 << 20
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower-case words between spaces; empty if there are none."""
    words = _GAP.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def budget(item: str, error_rate: float = ERROR_RATE) -> int:
    """The edits that a normal item may have; the spaces around it don't count."""
    return int(math.floor(error_rate * (len(item) - 2) + 1e-9))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their offsets."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """Least distance of the pattern to any substring of text and its first end; (k + 1, -1) if that exceeds k."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = ones, 0, m, k + 1, -1
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph = (ph << 1) & ones
        pv = ((mh << 1) | ~(xv | ph)) & ones
        mv = ph & xv
    return best, end


def masks_of(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items = [(i, t, budget(t, error_rate), masks_of(t)) for i, t in ((i, normal(t)) for i, t in items) if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.memo: dict[tuple[int, str], tuple[int, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, least distance, its first end in the normal text, number of separate places)."""
        if not self.items or not text:
            return []
        text = normal(text)
        found: dict[int, list[tuple[int, int]]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                _, item, k, masks = self.items[n]
                low, high = end + 1 - size - at - k, end + 1 - size - at + len(item) + k
                spans = tried.setdefault(n, [])
                if spans and spans[-1] == (low, high):
                    continue
                spans.append((low, high))
                low = max(0, low)
                window = text[low:high]
                if (n, window) not in self.memo:
                    if len(self.memo) > 20_000:
                        self.memo.clear()
                    exact = window.find(item)
                    self.memo[n, window] = (0, exact + len(item)) if exact >= 0 else myers(masks, len(item), window, k)
                best, stop = self.memo[n, window]
                if best <= k:
                    found.setdefault(n, []).append((best, low + stop))
        out = []
        for n, hits in found.items():
            best, end = min(hits)
            ends = sorted({e for _, e in hits})
            places = 1 + sum(b - a > len(self.items[n][1]) // 2 for a, b in zip(ends, ends[1:], strict=False))
            out.append((self.items[n][0], best, end, places))
        return sorted(out, key=lambda x: (x[0] is None, x[0]))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items, a bounded block at a time, as lists on the driver."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for i in range(n if size else 0):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def find_items(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, end, n_places for every item that a document holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, end long, n_places int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items):

        def run(batches, block=block):
            matcher = Matcher(block, error_rate)
            for batch in in_pieces(batches):
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in matcher.find(t)]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.record_batch(columns, names=["doc_id", "item_id", "distance", "end", "n_places"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """docs without those rows whose text holds an item."""
    for block in item_blocks(items):
        docs = docs.filter(_cleanness(block, error_rate)("text"))
    return docs


def _cleanness(block: list[tuple[int, str]], error_rate: float):
    from collections.abc import Iterator

    import pandas as pd

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block, error_rate)
        for texts in parts:
            yield pd.Series([not matcher.find(t or "") for t in texts], dtype=bool)

    clean.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(clean, "boolean")


def op9_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
