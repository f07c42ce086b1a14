"""Token ids in grammar-compressed blocks (Re-Pair) with random access.

Documents are dealt by range of doc_id, encoded, and gathered into blocks. In a block, rounds replace frequent
adjacent pairs of ids by nonterminals until no pair is frequent; no pair holds an end id, so each document is a run of
the compressed sequence. A block keeps its rules, the expansion length of each nonterminal and where each document starts,
and so gives any document, or any single id, without expanding the rest.

Blocks are rows of a Parquet table in the shared folder, written by Spark's committer: a lost executor's blocks are
written again by others. Null texts are encoded as empty ones, which hold the end id alone; rows with equal doc_id are
in order of their text; a null doc_id comes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, scratch, text_or_empty
from tidemark.llm.tokens import gather, grouped, shared_encoder

BLOCK_IDS = 1 << 20
LEAST = 12
SLOT_BITS = 17
MAGIC = b"RPB1"
_HEAD = struct.Struct("<4sIIIIB")
BLOCKS = "part int, block int, start_in_part long, n_ids long, doc_ids array<bigint>, payload binary"


def _by_pair(left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the pairs that stand at least times in ascending order, how often each does, where in turn)."""
    bits, low = int(max(left.max(), right.max())).bit_length(), size.bit_length()
    fits = 2 * bits + low <= 64  # the pair and its place are one key
    if fits:
        keys = (((left.astype(np.uint64) << np.uint64(bits)) | right) << np.uint64(low)) | at.astype(np.uint64)
        keys.sort()
        pairs = keys >> np.uint64(low)
    else:
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.argsort(pairs, kind="stable")
        pairs, at = pairs[order], at[order]
    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    sizes = np.diff(np.r_[starts, len(pairs)])
    big = np.repeat(sizes >= least, sizes)
    at = (keys[big] & np.uint64((1 << low) - 1)).astype(np.int64) if fits else at[big]
    codes = pairs[starts[sizes >= least]]
    if fits:
        codes = ((codes >> np.uint64(bits)) << np.uint64(32)) | (codes & np.uint64((1 << bits) - 1))
    return codes, sizes[sizes >= least], at


def compress(ids: np.ndarray, end: int, least: int = LEAST):
    """(first nonterminal, rules as an array of pairs, compressed sequence); no rule holds an end id.

    Rounds go on until no pair occurs least times without overlap. A round counts exactly and replaces a pair where no
    pair that overlaps it has a higher rank. Ranks go by the counts' powers of two, then by a hash, so that rounds are
    few even where counts fall all along a text; the first in rank is always replaced wholly. A pair's count never
    rises, so a round looks only at pairs that were frequent and at those of new nonterminals.
    """
    n = len(ids)
    base = int(ids.max()) + 1 if n else 1
    seq = np.r_[ids, end].astype(np.uint32)  # the place n stands for both ends, as next of the last and previous of the first
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    alive, mark = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    none = np.iinfo(np.int32).max
    ranks = np.full(n + 1, none, np.int32)
    rules: list[np.ndarray] = []
    first = base
    live = np.flatnonzero((seq[:-1] != end) & (seq[1:] != end))
    while len(live) >= least:
        left, right = seq[live], seq[after[live]]
        slot = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)
        some = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot])  # others are in no frequent pair
        if len(some) < least:
            break
        places = live[some]
        kept, sizes, at = _by_pair(left[some], right[some], places, n, least)
        group = np.repeat(np.arange(len(kept)), sizes)
        free = np.ones(len(at), bool)
        twins = np.flatnonzero(np.repeat((kept >> np.uint64(32)) == (kept & np.uint64(0xFFFFFFFF)), sizes))
        twins = twins[twins > 0]
        follows = twins[(group[twins] == group[twins - 1]) & (after[at[twins - 1]] == at[twins])]
        if len(follows):  # of pairs of equal ids that overlap in a run every second one, from the left
            place = np.arange(len(follows))
            run = np.where(np.r_[True, np.diff(follows) != 1], place, 0)
            free[follows] = (place - np.maximum.accumulate(run)) % 2 == 1
        counts = np.bincount(group[free], minlength=len(kept))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        level = np.frexp(counts[good].astype(float))[1]
        good = good[np.lexsort((kept[good] * np.uint64(0x9E3779B97F4A7C15), -level))]
        rank = np.full(len(kept), none, np.int32)
        rank[good] = np.arange(len(good))
        ranks[at] = np.where(free, rank[group], none)
        own = ranks[places]  # from here on in order of places, which memory likes
        wins = (own < ranks[before[places]]) & (own < ranks[after[places]])
        ranks[places] = none
        spot, won = places[wins], good[own[wins]]
        enough = np.bincount(won, minlength=len(kept)) >= least
        keep = enough[won]
        spot, number = spot[keep], (np.cumsum(enough) - 1)[won[keep]]
        used = kept[enough]
        rules.append(np.stack([used >> np.uint64(32), used & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        gone = after[spot]
        follow = after[gone]
        seq[spot] = (first + number).astype(np.uint32)
        alive[gone] = False
        after[spot], before[follow] = follow, spot
        first += len(used)
        mark[at], mark[spot], mark[before[spot]] = True, True, True
        mark[gone] = mark[n] = False
        live = np.flatnonzero(mark)
        mark[live] = False
        live = live[(seq[live] != end) & (seq[after[live]] != end)]
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq[:-1][alive[:-1]]


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1))
    return np.array(lengths, np.int64)


def pack(ids: np.ndarray, sizes: np.ndarray, end: int) -> bytes:
    """A block of documents of the given sizes, each ending in the end id."""
    base, rules, seq = compress(ids, end)
    lengths = expansion_lengths(base, rules)
    reach = np.cumsum(np.where(seq >= base, lengths[np.maximum(seq.astype(np.int64) - base, 0)] if len(rules) else 1, 1))
    starts = np.r_[0, np.searchsorted(reach, np.cumsum(sizes)) + 1].astype("<u4")
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = _HEAD.pack(MAGIC, len(sizes), len(rules), len(seq), base, width)
    return head + starts.tobytes() + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + seq.astype(kind).tobytes()


class Block:
    """A block read back."""

    def __init__(self, payload: bytes):
        magic, docs, rules, n, self.base, width = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = _HEAD.size
        self.starts = np.frombuffer(payload, "<u4", docs + 1, at)
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at := at + 4 * (docs + 1)).reshape(-1, 2)
        self.lengths = np.frombuffer(payload, "<u4", rules, at := at + 8 * rules)
        self.seq = np.frombuffer(payload, f"<u{width}", n, at + 4 * rules)

    def _counts(self, seq: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        counts = np.ones(len(seq), np.int64)
        big = np.flatnonzero(seq >= self.base)
        counts[big] = self.lengths[seq[big].astype(np.int64) - self.base]
        return counts

    def _by_rules(self, seq: np.ndarray) -> np.ndarray:
        """The ids that seq stands for, all symbols replaced by their rules until none is left."""
        seq = seq.astype(np.uint32)
        while len(seq) and (big := seq >= self.base).any():
            out = np.repeat(seq, 1 + big)
            at = np.flatnonzero(big) + np.arange(int(big.sum()))
            pair = self.rules[seq[big] - self.base]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """The same, with each used symbol expanded once where that is the smaller part of the work."""
        seq = seq.astype(np.uint32)
        big = np.flatnonzero(seq >= self.base)
        if not len(big):
            return seq
        counts = self._counts(seq)
        used = np.flatnonzero(np.bincount(seq[big] - self.base))
        widths = self.lengths[used].astype(np.int64)
        if 2 * int(widths.sum()) > int(counts.sum()):
            return self._by_rules(seq)
        starts = np.arange(len(seq))
        begin = np.zeros(len(self.rules), np.int64)
        begin[used] = len(seq) + np.cumsum(widths) - widths
        starts[big] = begin[seq[big] - self.base]
        return gather(np.concatenate([seq, self._by_rules((used + self.base).astype(np.uint32))]), starts, counts)

    def all_ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.seq[self.starts[i] : self.starts[i + 1]])

    def sizes(self) -> np.ndarray:
        total = np.r_[0, np.cumsum(self._counts(self.seq))]
        return np.diff(total[self.starts])

    def id_at(self, i: int, k: int) -> int:
        """The k-th id of document i, down the rules by expansion lengths alone."""
        run = self.seq[self.starts[i] : self.starts[i + 1]].astype(np.int64)
        reach = np.cumsum(np.where(run >= self.base, self.lengths[np.maximum(run - self.base, 0)] if len(self.rules) else 1, 1))
        j = int(np.searchsorted(reach, k, side="right"))
        k -= int(reach[j - 1]) if j else 0
        x = int(run[j])
        while x >= self.base:
            a, b = (int(v) for v in self.rules[x - self.base])
            width = int(self.lengths[a - self.base]) if a >= self.base else 1
            x, k = (a, k) if k < width else (b, k - width)
        return x


def _to_blocks(tokenizer: str, end: int, block_ids: int):
    def run(batches):
        encoder, part = shared_encoder(tokenizer), TaskContext.get().partitionId()
        start, number = 0, 0
        ids, sizes, keys = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def block(n: int):
            """The first n documents held."""
            size = int(sizes[:n].sum())
            columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (number, pa.int32()), (start, pa.int64()), (size, pa.int64()), (keys[:n], pa.list_(pa.int64())), (pack(ids[:size], sizes[:n], end), pa.binary()))]
            return pa.record_batch(columns, names=["part", "block", "start_in_part", "n_ids", "doc_ids", "payload"]), size

        for table, texts in grouped(batches):
            new, counts = encoder.encode_flat(texts)
            new = np.insert(new, np.cumsum(counts), np.uint32(end))  # the end id of each document
            ids, sizes, keys = np.concatenate([ids, new]), np.r_[sizes, counts + 1], keys + table.column("doc_id").to_pylist()
            while len(ids) >= block_ids:
                n = int(np.searchsorted(np.cumsum(sizes), block_ids)) + 1
                out, size = block(n)
                yield out
                ids, sizes, keys, start, number = ids[size:], sizes[n:], keys[n:], start + size, number + 1
        if keys:
            yield block(len(keys))[0]

    return run


def write_blocks(docs: DataFrame, tokenizer: str, path: str, end: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs and write their blocks, in ascending doc_id, to the Parquet folder path."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_to_blocks(tokenizer, end, block_ids), BLOCKS).write.parquet(path)


def _digests(starts: dict[int, int]):
    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one block at a time
                block = Block(row["payload"])
                data, sizes = block.all_ids().astype("<u4"), block.sizes()
                ends = np.cumsum(sizes)
                view = memoryview(data).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                first = starts[row["part"]] + row["start_in_part"]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, where its ids start among those of all documents, how many they are and their checksum."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts, total = {}, 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect())):  # a row for each written file
        starts[part] = total
        total += n
    return blocks.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(_digests(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "id-blocks")
    write_blocks(documents(spark, sf_dir), "word_bpe_49k.json", path)
    return read_digests(spark, path)
