"""Join of texts by the Jaccard similarity of their word shingles, with signature trees.

Texts link when 100 * intersection >= percent * union of their shingle sets (64-bit hashes of lower-cased words; two
sets of equal 128-bit digest are one class). The join loses no link:

1. Chunks of texts are sketched: of a set of n hashes, the smallest third or so. At most t = n - ceil(n * percent / 100)
   members of a set can be missing from a partner, so a class with a partner has at least L - t of its L sketched
   members in other texts too. Counts of who shares each member, by ranges of hashes, leave only such classes.
2. Of these, each of the t + 1 first members, the rarest ones, names a possible partner's group (one of them must be
   shared in any order that all sets keep to); groups that overlap make up candidate components.
3. The sets of a candidate component meet once (a large component as pairs of blocks of bounded size). Each block has a
   signature tree: nodes hold the OR of their members' bitmaps and the range of set sizes. Two trees are walked
   together; a pair of nodes is left when its largest possible overlap is below what its smallest sets need, or when
   its members are known to be in one component. Pairs of leaves are compared by their whole sets.
4. Links between classes make components; classes of equal sets are in one.

Null and empty texts and those without words have no set, link with nothing and are their own component. Rows with
equal doc_id are rows of their own with one name; a null doc_id gives a null component unless a partner has one. An
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, staged
from tidemark.llm.components import connected_components
from tidemark.llm.hashing import mix, shingle_sets

SIZE = 5
PERCENT = 80
CHUNK_ROWS = 4000
CHUNK_WORDS = 3_000_000
LEAST_BUCKETS, BUCKET_ROWS = 128, 4000
BLOCK_MEMBERS = 4_000_000
#: Members that are known to be common and so go last in the order; any order gives the same links.
COMMON_MEMBERS = 150_000
FANOUT = 16
BITS = 1024


def missing_at_most(n: np.ndarray | int, percent: int):
    return n - -(-n * percent // 100)


def sketch_length(n: int, percent: int) -> int:
    return min(n, missing_at_most(n, percent) + 1 + -(-n * 15 // 100))


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    salt = np.uint64(0x6A09E667F3BCC909)
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mix(one).view(np.int64), two.view(np.int64)


def _ranges(rows: int) -> tuple[int, int]:
    """(bits of the range of hashes, rows of a chunk): as many ranges as the rows need up to 2 ** 16. Beyond, ranges and
    chunks grow alike, so that neither a range's members nor the number of small pieces explode (at 3e10 rows a range
    has some 6 million members, and a chunk 32,000 rows)."""
    bits = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)).bit_length() - 1
    extra = max(0, bits - 16)
    return bits - extra + extra // 2, min(CHUNK_ROWS << (extra // 2), 60_000)


def _sketcher(size: int, percent: int, wide: bool, bucket_bits: int, chunk_rows: int):
    kind = np.uint64 if wide else np.uint32

    def flush(chunk, ids, sizes, ones, twos, sketches, hashes):
        columns = zip((ids, sizes, ones, twos, hashes), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
        meta = pa.record_batch([pa.array(c, t) for c, t in columns], names=["doc_id", "n", "d1", "d2", "text_hash"])
        first = {d: i for i, d in reversed(list(enumerate(zip(ones, twos, strict=True))))}
        own = [i for i in sorted(first.values()) if sizes[i]]
        members = np.concatenate([sketches[i] for i in own]) if own else np.zeros(0, np.uint64)
        of = np.repeat(np.array(own, np.uint16), [len(sketches[i]) for i in own]) if own else np.zeros(0, np.uint16)
        bucket = (mix(members) >> np.uint64(64 - bucket_bits)).astype(np.int64) if len(members) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << bucket_bits) + 1))
        blobs = [_to_bytes(meta)]
        numbers = [-1]
        for b in range(1 << bucket_bits):
            part = order[edges[b] : edges[b + 1]]
            if len(part):
                numbers.append(b)
                blobs.append(members[part].astype(kind).tobytes() + of[part].tobytes())
        return pa.record_batch([pa.array([chunk] * len(blobs), pa.int64()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "data"])

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        held, words = [[] for _ in range(6)], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                cut = batch.slice(lo, 250)
                sets = shingle_sets(_texts(cut.column("text")), size)
                one, two = digests(sets)
                for i, s in enumerate(sets):
                    held[4].append(s[: sketch_length(len(s), percent)].copy())
                    words += len(s)
                held[0] += cut.column("doc_id").to_pylist()
                held[1] += [len(s) for s in sets]
                held[2] += one.tolist()
                held[3] += two.tolist()
                held[5] += cut.column("text_hash").to_pylist()
                if len(held[0]) >= chunk_rows or words >= CHUNK_WORDS * chunk_rows // CHUNK_ROWS:
                    yield flush((part << 24) + n, *held)
                    held, words, n = [[] for _ in range(6)], 0, n + 1
        if held[0]:
            yield flush((part << 24) + n, *held)

    return run


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _spread(batches):
    """Rows of the documents in chunks: row is unique, and the same whenever the written sketch is read."""
    for batch in batches:
        for row in batch.to_pylist():
            t = _from_bytes(row["data"])
            rows = (row["chunk"] << 16) + np.arange(t.num_rows)
            yield pa.record_batch([pa.array(rows, pa.int64()), *(t.column(c).combine_chunks() for c in ("doc_id", "n", "d1", "d2", "text_hash"))], names=["row", "doc_id", "n", "d1", "d2", "text_hash"])


def _grouped(batches, key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows of one key, from rows in order of it."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0][key] != row[key]:
                yield rows[0][key], rows
                rows = []
            rows.append(row)
    if rows:
        yield rows[0][key], rows


def _shared(wide: bool):
    """For each chunk, how many sketched members of each document others share, of one bucket."""
    kind, width = (np.uint64, 8) if wide else (np.uint32, 4)

    def run(batches):
        for _, rows in _grouped(batches, "bucket"):
            sizes = [len(r["data"]) // (width + 2) for r in rows]
            members = np.concatenate([np.frombuffer(r["data"], kind, n) for r, n in zip(rows, sizes, strict=True)])
            order = np.argsort(members, kind="stable")
            same = members[order][1:] == members[order][:-1]
            shared = np.zeros(len(members), bool)
            shared[order] = np.r_[same, False] | np.r_[False, same]
            at = 0
            for r, n in zip(rows, sizes, strict=True):
                of = np.frombuffer(r["data"], np.uint16, n, n * width)
                counts = np.bincount(of[shared[at : at + n]]).astype(np.uint32)
                at += n
                yield pa.record_batch([pa.array([r["chunk"]], pa.int64()), pa.array([r["bucket"]], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "bucket", "data"])

    return run


def _survivors(percent: int):
    def run(batches):
        for chunk, rows in _grouped(batches, "chunk"):
            meta = _from_bytes(next(r["data"] for r in rows if r["bucket"] == -1))
            n = meta.column("n").to_numpy().astype(np.int64)
            counts = np.zeros(len(n), np.int64)
            for r in rows:
                if r["bucket"] >= 0:
                    own = np.frombuffer(r["data"], np.uint32)
                    counts[: len(own)] += own
            lengths = np.array([sketch_length(int(x), percent) for x in n])
            keep = np.flatnonzero((n > 0) & (counts > 0) & (counts >= lengths - missing_at_most(n, percent)))
            columns = [meta.column(c).combine_chunks().take(pa.array(keep)) for c in ("d1", "d2")]
            yield pa.record_batch(columns, names=["d1", "d2"])

    return run


def _whole_sets(size: int):
    """Sets of the representatives; a row whose text isn't its class's (a repeated doc_id) goes."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                cut = batch.slice(lo, 250)
                sets = shingle_sets(_texts(cut.column("text")), size)
                one, two = digests(sets)
                fit = np.flatnonzero((one == cut.column("d1").to_numpy()) & (two == cut.column("d2").to_numpy()))
                if len(fit):
                    columns = [cut.column("cls").take(pa.array(fit)), pa.array([len(sets[i]) for i in fit], pa.int32()), pa.array([sets[i].tobytes() for i in fit], pa.binary())]
                    yield pa.record_batch(columns, names=["cls", "n", "members"])

    return run


def _prefixes(percent: int, common: np.ndarray, levels: np.ndarray):
    """The t + 1 first members of each set, in an order that is the same for all sets: rare ones before common ones, then by hash."""

    def run(batches):
        for batch in batches:
            cls, n, members = batch.column("cls").to_numpy(), batch.column("n").to_numpy(), []
            for m in batch.column("members").to_pylist():
                s = np.frombuffer(m, np.uint64).view(np.int64)
                if len(common):
                    at = np.searchsorted(common, s)
                    at[at == len(common)] = 0
                    s = s[np.argsort(np.where(common[at] == s, levels[at], 0), kind="stable")]
                members.append(s[: missing_at_most(len(s), percent) + 1])
            if members:
                times = list(map(len, members))
                yield pa.record_batch([pa.array(np.concatenate(members)), pa.array(np.repeat(cls, times)), pa.array(np.repeat(n, times))], names=["member", "cls", "n"])

    return run


class SignatureTree:
    """A packed tree over sets: levels[0] are the sets, each further level ORs FANOUT nodes of the one below."""

    def __init__(self, sets: list[np.ndarray], fanout: int = FANOUT, bits: int = BITS):
        self.fanout = fanout
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            slot = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        excess = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            cuts = np.arange(0, len(maps), fanout)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(excess, cuts)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the nodes (which are of a level above 0), and which node each is of."""
        below = len(self.levels[level - 1][0])
        grid = nodes[:, None] * self.fanout + np.arange(self.fanout)
        of, at = np.nonzero(grid < below)
        return grid[of, at], of


def _possible(a: SignatureTree, b: SignatureTree, la: int, lb: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below the nodes can overlap enough: an overlap's members fill common bits, but for those that share a bit."""
    ma, low_a, high_a, ea = a.levels[la]
    mb, low_b, high_b, eb = b.levels[lb]
    need = -(-percent * (low_a[x] + low_b[y]) // (100 + percent))
    sized = (100 * high_a[x] >= percent * low_b[y]) & (100 * high_b[y] >= percent * low_a[x]) & (np.minimum(high_a[x], high_b[y]) >= need)
    at = np.flatnonzero(sized)
    common = np.bitwise_count(ma[x[at]] & mb[y[at]]).sum(1, dtype=np.int64) + np.minimum(ea[x[at]], eb[y[at]])
    sized[at] = common >= need[at]
    return sized


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Forest:
    """Union of places by links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links between places of left (and then right, counted on) that span the components of all links."""
    a = SignatureTree(left)
    b = a if right is None else SignatureTree(right)
    shift = 0 if right is None else len(left)
    sets = left if right is None else left + right
    forest, links = Forest(len(sets)), []
    ranges = None

    def label_ranges():
        out = []
        for tree, start in ((a, 0), (b, shift)):
            low = high = forest.label[start : start + len(tree.levels[0][0])]
            own = [(low, high)]
            for level in tree.levels[1:]:
                cuts = np.arange(0, len(own[-1][0]), tree.fanout)
                own.append((np.minimum.reduceat(own[-1][0], cuts), np.maximum.reduceat(own[-1][1], cuts)))
                assert len(own[-1][0]) == len(level[0])
            out.append(own)
        return out

    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, x, y = stack.pop()
        if len(x) > 20_000:
            stack += [(la, lb, x[i : i + 20_000], y[i : i + 20_000]) for i in range(0, len(x), 20_000)]
            continue
        ranges = ranges or label_ranges()
        (low_x, high_x), (low_y, high_y) = ranges[0][la], ranges[1][lb]
        one = (low_x[x] == high_x[x]) & (low_y[y] == high_y[y]) & (low_x[x] == low_y[y])
        if la == lb == 0:
            one |= (x >= y) & (right is None)
        x, y = x[~one], y[~one]
        keep = _possible(a, b, la, lb, x, y, percent)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        if la == lb == 0:
            for i, j in zip(x.tolist(), (y + shift).tolist(), strict=True):
                if forest.label[i] != forest.label[j]:
                    n = overlap(sets[i], sets[j])
                    if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                        forest.join(i, j)
                        links.append((i, j))
                        ranges = None
            continue
        if la >= lb:
            kids, of = a.children(la, x)
            x, y, la = kids, y[of], la - 1
        else:
            kids, of = b.children(lb, y)
            x, y, lb = x[of], kids, lb - 1
        if right is None and la == lb:
            x, y = x[x <= y], y[x <= y]
        stack.append((la, lb, x, y))
    return links


def _joined(percent: int):
    """Links within a group of sets: one block with itself, or two blocks with one another."""

    def ordered(rows):
        seen, out = set(), []
        for r in sorted(rows, key=lambda r: (r["n"], r["members"][:8])):
            if r["cls"] not in seen:
                seen.add(r["cls"])
                out.append(r)
        return out

    def run(batches):
        for _, rows in _grouped(batches, "pair"):
            i, j = rows[0]["i"], rows[0]["j"]
            left = ordered([r for r in rows if r["block"] == i])
            right = ordered([r for r in rows if r["block"] == j]) if i != j else []
            if len(left) + len(right) < 2 or i != j and not (left and right):
                continue
            sets = [[np.frombuffer(r["members"], np.uint64) for r in side] for side in (left, right)]
            links = tree_join(sets[0], sets[1] if i != j else None, percent)
            cls = [r["cls"] for r in left + right]
            if links:
                yield pa.record_batch([pa.array([cls[a] for a, _ in links], pa.int64()), pa.array([cls[b] for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _block_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """cls, n, members, block and a pair of blocks i, j for every pair that a set's block is in.

    A component is one block while its sets are few. Else its blocks are by set size first: sets of a step link only
    with those of the same and the next one (a step is the largest ratio of sizes that can link), so other pairs of
    blocks are never made.
    """
    whole = placed.groupBy("root").agg(F.sum("n").alias("total"))
    large = staged(whole.filter(F.col("total") > BLOCK_MEMBERS).select("root"), "large")
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    single = placed.join(large, "root", "left_anti").select("cls", "n", "members", F.lit("0").alias("block"), F.lit("0").alias("i"), F.lit("0").alias("j"), "root")
    if not large.limit(1).count():
        return single.withColumn("pair", F.col("root").cast("string")).drop("root")
    many = placed.join(large, "root").withColumn("step", step)
    counts = many.groupBy("root", "step").agg(F.ceil(F.sum("n") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    by_step = Window.partitionBy("root").orderBy("step")
    near = lambda f, d: F.when(f("step").over(by_step) == F.col("step") + d, f("blocks").over(by_step)).otherwise(0)
    counts = counts.select("root", "step", "blocks", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"))
    name = lambda step, k: F.concat_ws(".", step, k)
    own = many.join(counts, ["root", "step"]).withColumn("k", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("block", name(F.col("step"), F.col("k")))
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(numbers("blocks"), lambda o: F.struct(name(F.col("step"), F.least("k", o)).alias("i"), name(F.col("step"), F.greatest("k", o)).alias("j")))
    below = F.transform(numbers("below"), lambda o: F.struct(name(F.col("step") - 1, o).alias("i"), F.col("block").alias("j")))
    above = F.transform(numbers("above"), lambda o: F.struct(F.col("block").alias("i"), name(F.col("step") + 1, o).alias("j")))
    pairs = own.withColumn("p", F.explode(F.concat(same, below, above))).select("cls", "n", "members", "block", "p.i", "p.j", "root")
    return pairs.unionByName(single).withColumn("pair", F.concat_ws(":", "root", "i", "j")).drop("root")


def similarity_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, n_shingles, class_row, component_id, component_row (its first row) and text_hash for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = texts.count()
    wide = rows > 1 << 25  # else 32 bits of a hash, and those of its bucket, leave few members shared by chance
    bucket_bits, chunk_rows = _ranges(rows)
    sketch = staged(texts.mapInArrow(_sketcher(size, percent, wide, bucket_bits, chunk_rows), "chunk long, bucket int, data binary"), "sketch")
    metas = sketch.filter("bucket = -1")
    thin = metas.select("chunk", "data").mapInArrow(_spread, "row long, doc_id long, n int, d1 long, d2 long, text_hash long")
    classes = thin.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("first_id"), F.min_by(F.struct("doc_id", "text_hash"), "row").alias("member"))
    counts = sketch.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(wide), "chunk long, bucket int, data binary")
    by_chunk = counts.unionByName(metas).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    alive = by_chunk.mapInArrow(_survivors(percent), "d1 long, d2 long").distinct()
    wanted = alive.join(classes, ["d1", "d2"]).select(F.col("member.doc_id").alias("wanted_id"), F.col("member.text_hash").alias("wanted_hash"), "d1", "d2", "cls")
    chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))).select("text", "d1", "d2", "cls")
    sets = chosen.mapInArrow(_whole_sets(size), "cls long, n int, members binary")
    if thin.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():  # else a class has one row here
        sets = sets.dropDuplicates(["cls"])
    sets = staged(sets, "sets")

    none = np.zeros(0, np.int64)
    often = sets.mapInArrow(_prefixes(percent, none, none), "member long, cls long, n int").groupBy("member").agg(F.count("*").alias("n")).filter("n >= 8")
    top = often.orderBy(F.desc("n"), "member").limit(COMMON_MEMBERS).toPandas().sort_values("member")
    common, levels = top["member"].to_numpy(np.int64), np.log2(top["n"].to_numpy(float)).astype(np.int64)
    prefixes = staged(sets.mapInArrow(_prefixes(percent, common, levels), "member long, cls long, n int"), "prefixes")
    # Within a member's group, sets link in candidate only as far as sizes permit: those of one size class hang together,
    # and neighbouring classes if their nearest sizes do.
    sized = prefixes.withColumn("step", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    classed = sized.groupBy("member", "step").agg(F.min("cls").alias("leader"), F.max("cls").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"))
    stars = sized.join(classed.filter("leader <> last"), ["member", "step"]).select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    by_step = Window.partitionBy("member").orderBy("step")
    steps = classed.withColumn("below", F.lag("leader").over(by_step)).withColumn("below_high", F.lag("high").over(by_step))
    steps = steps.filter(100 * F.col("below_high") >= percent * F.col("low")).select(F.col("leader").alias("a"), F.col("below").alias("b"))
    candidates = stars.unionByName(steps)
    groups = staged(connected_components(candidates, "candidates"), "groups")

    placed = sets.join(groups, sets.cls == groups.node).select("cls", "n", "members", "root")
    pairs = _block_pairs(placed, percent)
    links = pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(_joined(percent), "a long, b long")
    components = staged(connected_components(links, "links"), "linked")

    known = classes.join(components, classes.cls == components.node, "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(firsts, "root").select("d1", "d2", "cls", "root", "component_id")
    return thin.join(known, ["d1", "d2"], "left").select(
        "row", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("cls", "row").alias("class_row"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "row").alias("component_row"), "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with the smallest doc_id of each component (the first row of equal ones); rows of equal doc_id and text are one."""
    joined = staged(similarity_components(docs, size, percent).select("row", "doc_id", "component_id", "component_row", "text_hash"), "components")
    least = joined.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_row").agg(F.min_by(F.struct("doc_id", "text_hash"), "row").alias("kept"))
    kept = least.select(F.col("kept.doc_id").alias("__kept_id"), F.col("kept.text_hash").alias("__kept_hash"))
    again = joined.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & F.xxhash64("text").eqNullSafe(F.col("__kept_hash"))
    out = docs.join(kept, same, "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if again else out


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
