"""Removal of bytes that stand in a long string found elsewhere, by a logarithmic family of suffix arrays.

A byte goes when a string of `length` bytes (400) that covers it also starts anywhere else, in another document or in
its own; strings are judged on the input and never cross documents.

1. Each start is given an anchor: the leftmost least hash among the 64-byte strings of its 400 bytes. Equal strings have
   equal anchors at equal offsets, so starts with one anchor (a segment, some 170 of them) need comparison only with
   segments whose anchor has the same hash. Most anchors are unique, and their starts are done.
2. Segments that look alike (same anchor, same 64-bit digest of the bytes that their starts reach and of the anchor's
   place) are one shape, of which two places are indexed and stand for the rest. An anchor of very many shapes is dealt
   by window: of each fingerprint that occurs twice or more among its windows, two places are indexed.
3. What is indexed comes in batches of documents, dealt to parts by anchor (or fingerprint). A batch gets a suffix array
   for each part and is merge-scanned against the stored levels of that part; windows of 400 equal bytes are matches.
   Levels are tables in the shared folder; levels of equal size merge into one of twice the size.

Only windows that the suffix arrays found equal, byte by byte, are removed, with those of the same shape or fingerprint.
Copies of a whole text (equal SHA-256) are one class, of which one member takes part; a class of two or more loses all
bytes where it has 400. Null texts count as empty; shorter texts keep everything; rows with equal doc_id are judged
apart; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, documents, split_join, staged
from tidemark.llm.hashing import mix, powers, prefix_sums, range_hashes
from tidemark.llm.suffixes import Level

LENGTH = 400
GRAM = 64
PIECE = 1 << 18
HOT_SHAPES = 2000
BATCHES = 4
#: Crowded anchors (9 bytes each) that are broadcast; more are joined by shuffle.
SMALL_ANCHORS = 200_000
#: Bytes of regions in a part, which one task holds at a time.
PART_BYTES = 4 << 20


def class_of(text: bytes) -> tuple[int, int]:
    return _halves(hashlib.sha256(text).digest())


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each full window, by running minima from both ends of blocks of the width."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash of the anchor, anchor, first start, last start) of all segments of the texts data[starts:ends], in order."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * powers(len(sums), "inverse")[:n])
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    anchors = (sliding_least(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(len(anchors) + 1, np.int32)
    fit = ends - starts >= length
    np.add.at(change, starts[fit], 1)
    np.add.at(change, ends[fit] - length + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    begins = valid & np.r_[True, (anchors[1:] != anchors[:-1]) | ~valid[:-1]]
    begins[starts[fit]] = True
    first = np.flatnonzero(begins)
    stops = np.r_[first[1:], len(anchors)] - 1 if len(first) else none
    owner_end = ends[np.searchsorted(starts, first, side="right") - 1] - length if len(first) else none
    return grams[anchors[first]], anchors[first], first, np.minimum(stops, owner_end)


def text_segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """The same for texts of any size, which are read in pieces: index of the text, hash, anchor, first and last start."""
    out = [[], [], [], [], []]
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal group, size
        if not group:
            return
        lengths = np.array([len(p) for *_, p in group])
        ends = np.cumsum(lengths)
        h, a, s, e = segments(np.frombuffer(b"".join(p for *_, p in group), np.uint8), ends - lengths, ends, length, gram)
        own = np.searchsorted(ends, s, side="right")
        shift = np.array([at for _, at, _ in group]) - (ends - lengths)
        for column, values in zip(out, (np.array([i for i, *_ in group])[own], h, a + shift[own], s + shift[own], e + shift[own]), strict=True):
            column.append(values)
        group, size = [], 0

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if len(piece) >= length:
                group.append((i, at, piece))
                size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


ROWS = "found int, doc_id long, text_hash long, d1 long, d2 long, n_bytes long, sha string, h long, anchor long, first long, last long"


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _scan(length: int, gram: int):
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                cut = batch.slice(lo, 250)
                texts = _bytes(cut.column("text"))
                shas = [hashlib.sha256(t) for t in texts]
                keys = [_halves(x.digest()) for x in shas]
                fresh = []
                for i, k in enumerate(keys):  # a copy of a text that this task has read adds nothing but its own row
                    if k not in seen:
                        fresh.append(i)
                        if len(seen) < 200_000:
                            seen.add(k)
                of, h, a, s, e = text_segments([texts[i] for i in fresh], length, gram)
                of = np.array(fresh, np.int64)[of.astype(np.int64)] if len(of) else np.zeros(0, np.int64)
                d = np.array(keys, np.int64).reshape(-1, 2)
                n, m = len(texts), len(of)
                none, some = pa.nulls(n, pa.int64()), pa.nulls(m, pa.int64())
                rows = [
                    (pa.array(np.zeros(n, np.int32)), pa.array(np.ones(m, np.int32))), (cut.column("doc_id"), some), (cut.column("text_hash"), some),
                    (pa.array(d[:, 0]), pa.array(d[of, 0])), (pa.array(d[:, 1]), pa.array(d[of, 1])),
                    (pa.array([len(t) for t in texts], pa.int64()), some), (pa.array([x.hexdigest() for x in shas], pa.string()), pa.nulls(m, pa.string())),
                    (none, pa.array(h.astype(np.uint64).view(np.int64))), (none, pa.array(a, pa.int64())), (none, pa.array(s, pa.int64())), (none, pa.array(e, pa.int64())),
                ]
                yield pa.record_batch([pa.concat_arrays(list(r)) for r in rows], names=[f.split()[0] for f in ROWS.split(", ")])

    return run


PLACED = "d1 long, d2 long, h long, first long, last long, shape long"
REGION = "part int, batch int, h long, shape long, whole int, region binary"
WINDOWS = "print long, h long, shape long, low long, d1 long, d2 long, at long"
LEVEL = "part int, level int, h long, shape long, whole int, low int, high int, data binary, sizes binary, names binary, starts binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return _columns(list(zip(*rows, strict=True)) or [[]] * len(fields), schema)


def _columns(columns: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _slices(batches, rows: int = 50) -> Iterator[dict]:
    """Rows as dicts, few at a time, as texts and lists may be long."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield from batch.slice(lo, rows).to_pylist()


def _shapes(length: int):
    """The shape of each segment that may repeat: a digest of the bytes that its starts reach and of its anchor's place."""

    def run(batches):
        for row in _slices(batches):
            text, out = row["text"] or b"", []
            if class_of(text) != (row["d1"], row["d2"]):
                continue
            for s in row["segments"]:
                d = hashlib.blake2b(text[s["first"] : s["last"] + length], digest_size=8)
                d.update((s["anchor"] - s["first"]).to_bytes(8, "little"))
                out.append((row["d1"], row["d2"], s["h"], s["first"], s["last"], int.from_bytes(d.digest(), "little", signed=True)))
            yield _batch(out, PLACED)

    return run


def _regions(length: int, parts: int, batches_: int):
    """The bytes that the starts of the wanted segments or windows reach, dealt to parts by anchor or fingerprint."""

    def run(batches):
        for row in _slices(batches):
            text, batch = row["text"] or b"", row["d2"] % batches_
            if class_of(text) == (row["d1"], row["d2"]):  # else another text with the same doc_id
                yield _batch([(w["h"] % parts, batch, w["h"], w["shape"], w["whole"], text[w["first"] : w["last"] + length]) for w in row["wanted"]], REGION)

    return run


def window_prints(regions: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of the regions in turn, and how many each has."""
    data = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions], np.int64)
    counts = sizes - length + 1
    base = np.repeat(np.cumsum(sizes) - sizes - np.r_[0, np.cumsum(counts)[:-1]], counts)
    starts = base + np.arange(int(counts.sum()))
    return range_hashes(prefix_sums(data), starts, starts + length), counts


class IndexFamily:
    """Levels of suffix arrays in the shared folder; sizes grow geometrically, so each suffix is merged a logarithmic
    number of times. A batch is one job: each task takes the parts dealt to it, one at a time, from all levels."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []  # sizes in batches, oldest first
        self.written: list[DataFrame] = []

    def add(self, regions: DataFrame, last: bool = False) -> DataFrame:
        """h, shape, whole, low, high: runs of windows that the batch has twice or that a level has too, on both sides.
        The last batch is scanned but leaves no level."""
        size, merges = 1, 0
        while not last and merges < len(self.levels) and self.levels[-1 - merges][0] == size:
            size, merges = 2 * size, merges + 1
        n, fields = len(self.levels), [f.split() for f in LEVEL.split(", ")]
        rows = regions.withColumnRenamed("region", "data").withColumn("level", F.lit(n))
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in fields])
        for i, (_, df) in enumerate(self.levels):
            rows = rows.unionByName(df.withColumn("level", F.lit(i)))
        run = _advance(self.length, n, merges, last)
        out = staged(rows.repartition("part").sortWithinPartitions("part", "level").mapInArrow(run, LEVEL), "level")
        if not last:
            self.levels = [*self.levels[: n - merges], (size, out.filter("part is not null"))]
        self.written.append(out)
        return out.filter("part is null").select("h", "shape", "whole", "low", "high")


def _advance(length: int, n: int, merges: int, last: bool):
    """For each part, its new regions (level n) against its stored levels 0 to n - 1, the newest of which merge."""

    def found(level: Level, starts: np.ndarray):
        names, low, high = level.runs(starts)
        none = [None] * len(low)
        if len(low):
            yield _columns([none, none, names[:, 0], names[:, 1], names[:, 2], low, high, none, none, none, none], LEVEL)

    def run(batches):
        for part, rows in groupby(_slices(batches), key=lambda r: r["part"]):
            stored: dict[int, Level] = {}
            regions, names = [], []
            for r in rows:
                if r["level"] < n:
                    stored[r["level"]] = Level.unpack(r["data"], r["sizes"], r["names"], r["starts"], length)
                else:
                    regions.append(r["data"])
                    names.append((r["h"], r["shape"], r["whole"]))
            level = None
            if regions:
                level, twice = Level.build(regions, np.array(names, np.int64), length)
                yield from found(level, twice)
            for i in range(n - 1, -1, -1):
                if (old := stored.get(i)) is None:
                    continue
                if level is None:
                    level = old if i >= n - merges else None
                    continue
                low, equal = old.scan(level)
                yield from found(level, level.order[equal])
                yield from found(old, old.order[low[equal]])
                if i >= n - merges:
                    level = old.merged(level, low, equal)
            if level is not None and not last:
                yield _columns([[part], *[[None]] * 6, *([x] for x in level.pack())], LEVEL)

    return run


def _windows(length: int):
    """The fingerprint and place of each window of the wanted segments."""

    def run(batches):
        for row in _slices(batches):
            text, wanted = row["text"] or b"", row["wanted"]
            if class_of(text) != (row["d1"], row["d2"]):
                continue
            for lo in range(0, len(wanted), 200):
                part = wanted[lo : lo + 200]
                prints, n = window_prints([text[w["first"] : w["last"] + length] for w in part], length)
                low = np.arange(len(prints)) - np.repeat(np.cumsum(n) - n, n)
                h, shape, first = (np.repeat(np.array([w[k] for w in part], np.int64), n) for k in ("h", "shape", "first"))
                yield _columns([prints.view(np.int64), h, shape, low, np.full(len(low), row["d1"]), np.full(len(low), row["d2"]), first + low], WINDOWS)

    return run


def _runs_of(df: DataFrame) -> DataFrame:
    return df.groupBy("h", "shape").agg(F.collect_set(F.struct("low", "high")).alias("matched"))


def _cut(length: int):
    def run(batches):
        for row in _slices(batches):
            text, kept, at, removed = row["text"] or b"", [], 0, 0
            if class_of(text) != (row["d1"], row["d2"]):
                continue
            merged: list[list[int]] = []
            for low, high in sorted((r["low"], r["high"] + length) for r in row["runs"]):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            for low, high in merged:
                kept.append(text[at:low])
                at, removed = high, removed + high - low
            kept.append(text[at:])
            yield _batch([(row["d1"], row["d2"], removed, len(merged), b"".join(kept))], "d1 long, d2 long, n_removed long, n_spans long, kept binary")

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_SHAPES, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(rows, changed): doc_id, d1, d2, n_bytes, sha and copies of every row; n_removed, n_spans and kept bytes of classes of one row that change."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    scan = staged(texts.mapInArrow(_scan(length, gram), ROWS), "segments", "found")
    found, rows = scan.filter("found = 1").select("d1", "d2", "h", "anchor", "first", "last"), scan.filter("found = 0").select("doc_id", "text_hash", "d1", "d2", "n_bytes", "sha")
    classes = rows.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("member"))
    ends = staged(found.groupBy("h").agg(F.count("*").alias("n"), F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("anchor").alias("c"), F.max("anchor").alias("d")), "anchors")
    shared = ends.filter("a <> b or c <> d").select("h")
    lists = split_join(found, shared, ["h"], counts=ends).groupBy("d1", "d2").agg(F.collect_set(F.struct("h", "anchor", "first", "last")).alias("segments"))
    wanted = lists.join(classes, ["d1", "d2"]).select("d1", "d2", "copies", F.col("member.doc_id").alias("class_doc"), F.col("member.text_hash").alias("class_hash"), "segments")
    own = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("class_doc")) & F.col("text_hash").eqNullSafe(F.col("class_hash")))
    own = own.select("d1", "d2", "copies", F.encode("text", "UTF-8").alias("text"), "segments")
    if rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():  # else a class has one row here
        own = own.dropDuplicates(["d1", "d2"])
    own = staged(own, "segment-texts")
    discard(ends)
    discard(scan, folder="found=1")

    placed = staged(own.mapInArrow(_shapes(length), PLACED), "placed")
    place = F.struct("d1", "d2", "first", "last")
    alike = staged(placed.groupBy("h", "shape").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("two")), "shapes")
    own = own.drop("segments")
    anchors = staged(alike.groupBy("h").agg(F.count("*").alias("n")), "anchor-shapes")
    crowded = anchors.filter(F.col("n") > hot).select("h", F.lit(True).alias("crowded"))
    n_crowded = crowded.count()
    flagged = alike.join(F.broadcast(crowded) if n_crowded <= SMALL_ANCHORS else crowded, "h", "left") if n_crowded else alike.withColumn("crowded", F.lit(None).cast("boolean"))
    pair = staged(flagged.select("h", "shape", "crowded", F.explode(F.array_distinct(F.array("one", "two"))).alias("place")).select("h", "shape", "crowded", "place.*"), "places")
    many = pair.filter("crowded").drop("crowded")
    indexed = pair.filter("crowded is null").drop("crowded").withColumn("whole", F.lit(1))

    def with_text(places: DataFrame) -> DataFrame:
        """The texts of the places' classes, each with a list of its places."""
        of = places.columns
        lists = places.groupBy("d1", "d2").agg(F.collect_list(F.struct(*[c for c in of if c not in ("d1", "d2")])).alias("wanted"))
        return own.join(lists, ["d1", "d2"]).select("d1", "d2", "text", "wanted")

    extra: list[DataFrame] = []
    if n_crowded:
        windows = staged(with_text(many).mapInArrow(_windows(length), WINDOWS), "windows")
        at = F.struct("d1", "d2", "at")
        often = windows.groupBy("print").agg(F.count("*").alias("n"), F.min(at).alias("one"), F.max(at).alias("two")).filter("n > 1")
        both = often.select("print", F.explode(F.array("one", "two")).alias("place"))
        both = both.select(F.col("print").alias("h"), F.lit(0).cast("long").alias("shape"), "place.d1", "place.d2", F.col("place.at").alias("first"), F.col("place.at").alias("last"), F.lit(0).alias("whole"))
        indexed = staged(indexed.unionByName(both), "indexed")
        extra += [windows, indexed]
    size = indexed.agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    regions = staged(with_text(indexed).mapInArrow(_regions(length, parts, batches), REGION), "regions", "batch")
    discard(pair)
    family, matched = IndexFamily(length), []
    for b in range(batches):
        matched.append(family.add(regions.filter(F.col("batch") == b).drop("batch"), last=b == batches - 1))
        discard(regions, folder=f"batch={b}")
    matched = staged(functools.reduce(DataFrame.unionByName, matched), "matched")
    discard(*family.written)
    hits = matched.filter("whole = 1").select("h", "shape", "low", "high")
    if n_crowded:
        prints = matched.filter("whole = 0").select(F.col("h").alias("print")).distinct()
        low = F.col("low").cast("int")
        hits = hits.unionByName(split_join(windows, prints, ["print"]).select("h", "shape", low.alias("low"), low.alias("high")))
    counts = alike.select("h", "shape", "n")
    by_place = split_join(placed, staged(_runs_of(hits), "runs"), ["h", "shape"], counts=counts)
    discard(anchors, alike, matched, *extra)
    spans = by_place.groupBy("d1", "d2").agg(F.flatten(F.collect_list(F.transform("matched", lambda m: F.struct((F.col("first") + m.low).alias("low"), (F.col("first") + m.high).alias("high"))))).alias("runs"))
    changed = own.filter("copies = 1").join(spans, ["d1", "d2"]).mapInArrow(_cut(length), "d1 long, d2 long, n_removed long, n_spans long, kept binary")
    copies = staged(classes.select("d1", "d2", "copies", F.col("copies").alias("n")), "copies")
    return split_join(rows, copies.drop("n"), ["d1", "d2"], counts=copies), changed


def op4_index_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, changed = cut_repeats(documents(spark, sf_dir))
    changed = changed.select("d1", "d2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    # Copies need no join: they lose all, or are too short to lose anything.
    df = rows.filter("copies = 1").join(changed, ["d1", "d2"], "left").unionByName(rows.filter("copies > 1"), allowMissingColumns=True)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return df.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
