"""Personal data by patterns, and by contexts that those patterns' finds induce.

Base spans come from four expressions (email, ip, card, phone). They are seeds: the two words before one, and the words
on both its sides, are lexical patterns. What fills the slot of a pattern elsewhere is an instance: a word, or a run of
up to MOST_WORDS words that each hold a digit ("0171 555 1234"). Spark scores the graph of patterns and instances in
turns: a pattern's confidence is the share of its instances that are trusted, scaled by how many distinct ones there
are; an instance's trust is that of its patterns together. Trusted instances induce patterns wherever they stand, which
are scored in the next turn. Instances of confident patterns become spans of the kind that the pattern's seeds have
most, marked as found by context.

Patterns and instances are 64-bit hashes of folded words (lower case, without ASCII punctuation; in patterns all digits
are alike). Each pass reads all texts and asks for known patterns by a Bloom filter of fixed size; what it lets through
by error goes when Spark joins the exact table. A pattern is scored while its trusted instances have gathered LEAST_TRUST
and hold a tenth of its occurrences.

Offsets are code points, ends exclusive. Null and empty texts have no spans; instances that overlap base spans are
dropped; repeated rows each get their own result; equal scores are settled by name; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, in_pieces, split_join, staged
from tidemark.llm.hashing import mix, prefix_sums, range_hashes

KINDS = ("email", "ip", "card", "phone")
LEAST_TRUST = 5.0
LEAST_SHARE = 0.1
LEAST_CONFIDENCE = 0.8
TURNS = 2
ROUNDS = 3
MOST_WORDS = 5
LEAST_CHARS = 3
BLOOM_BITS = 23
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts where a run of digits does; the lookbehind keeps a long run from being read again from each digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`.,;:!?[]{}<>"
SPAN = "struct<kind:string,start:int,end:int>"
FOUND = "doc_id long, row long, spans array<" + SPAN + ">, hits array<struct<pattern:bigint,start:int,end:int,digit:boolean>>"
EDGES = "pattern long, words string, instance long, seed string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """The leftmost matches in turn, by way of the signs @ alone: a match starts in the run of local characters before one."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _LOCAL.match(text, start) if start < at else None
        if m:
            yield "email", m.start(), m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in _parts(m.group()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


def _parts(address: str) -> list[str]:
    """Parts without leading zeros, cut so that long ones stay cheap to read."""
    return [(p.lstrip("0") or "0")[:4] for p in address.split(".")]


_SPACE, _PUNCT, _NUMBER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_NUMBER[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALIKE = _LOWER.copy()
_ALIKE[48:58] = 48


class Bloom:
    """A set of 64-bit hashes in a fixed number of bits."""

    def __init__(self, words: np.ndarray, bits: int = BLOOM_BITS):
        self.words, self.bits = words, bits

    @staticmethod
    def of(keys: DataFrame, bits: int = BLOOM_BITS) -> Bloom | None:
        """Of the only column of keys; at most 2 ** bits / 64 rows come to the driver."""
        key = F.col(keys.columns[0])
        places: list[Column] = [F.shiftrightunsigned(key, 20 * i).bitwiseAND((1 << bits) - 1) for i in range(3)]
        at = keys.select(F.explode(F.array(*places)).alias("at"))
        rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).collect()
        if not rows:
            return None
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[[r.word for r in rows]] = np.array([r.set for r in rows], np.int64).view(np.uint64)
        return Bloom(words, bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for i in range(3):
            at = (keys >> np.uint64(20 * i)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


class Units:
    """The words of some texts, joined to units: runs of words with digits, base spans, and single words otherwise."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.spans = [base_spans(t) for t in texts]
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(space & np.r_[False, ~space[:-1]]) if len(data) else np.zeros(0, np.int64)
        plain = ~space & ~_PUNCT[data]
        clean = np.r_[0, np.cumsum(plain)]
        self.low, self.high = clean[starts], clean[ends]
        letters = data[plain]
        self.sums = prefix_sums(_LOWER[letters])
        self.words = range_hashes(prefix_sums(_ALIKE[letters]), self.low, self.high)
        bounds = np.cumsum([len(e) + 1 for e in encoded])
        self.text = np.searchsorted(bounds, starts, side="right")
        # Code points before each byte, counted from the text's start.
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        base = points[np.r_[0, bounds[:-1]]] if len(bounds) else points[:0]
        self.start, self.end = points[starts] - base[self.text], points[ends] - base[self.text]
        numbers, lines = np.r_[0, np.cumsum(_NUMBER[data])], np.r_[0, np.cumsum(data == 10)]
        digit = numbers[ends] > numbers[starts]
        span_of = np.full(len(starts), -1)
        self.bases: list[tuple[int, int, int, str]] = []  # first word, last word, text, kind
        firsts = np.searchsorted(self.text, np.arange(len(texts) + 1))
        for i, spans in enumerate(self.spans):
            a, b = firsts[i], firsts[i + 1]
            for kind, s, e in spans:
                x, y = a + int(np.searchsorted(self.end[a:b], s, side="right")), a + int(np.searchsorted(self.start[a:b], e)) - 1
                span_of[x : y + 1] = len(self.bases)
                self.bases.append((x, y, i, kind))
        free = span_of < 0
        n = len(starts)
        joined = np.zeros(n, bool)
        if n:
            joined[1:] = digit[1:] & digit[:-1] & free[1:] & free[:-1] & (self.text[1:] == self.text[:-1]) & (lines[starts[1:]] == lines[ends[:-1]])
        first = np.flatnonzero(~joined)
        last = np.r_[first[1:], n] - 1 if len(first) else first
        fit = free[first] & (last - first < MOST_WORDS) & (self.high[last] - self.low[first] >= LEAST_CHARS)
        x, y = (np.array([b[k] for b in self.bases], np.int64) for k in (0, 1))
        self.first, self.last = np.r_[first[fit], x], np.r_[last[fit], y]
        self.seeded = len(self.first) - len(x)  # units from here on are base spans

    def instances(self) -> np.ndarray:
        return range_hashes(self.sums, self.low[self.first], self.high[self.last])

    def patterns(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(units that have the pattern, its hash) of each of the two kinds."""
        n, t = len(self.words), self.text
        f, a = self.first, self.last
        one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        left = np.flatnonzero((f >= 2) & (t[np.maximum(f - 2, 0)] == t[f])) if n else f
        before = np.flatnonzero((f >= 1) & (a + 1 < n) & (t[np.maximum(f - 1, 0)] == t[f]) & (t[np.minimum(a + 1, n - 1)] == t[a])) if n else f
        return [
            (left, mix(self.words[f[left] - 2] * one + self.words[f[left] - 1] * two + np.uint64(1))),
            (before, mix(self.words[f[before] - 1] * one + self.words[a[before] + 1] * two + np.uint64(2))),
        ]

    def label(self, kind: int, unit: int) -> str:
        f, a, text = self.first[unit], self.last[unit], self.texts[self.text[self.first[unit]]]
        at = (f - 2, f - 1) if kind == 0 else (f - 1, a + 1)
        return "LB"[kind] + " " + " ".join(_DIGIT.sub("0", text[self.start[w] : self.end[w]].lower()) for w in at)

    def span(self, unit: int) -> tuple[int, int, int]:
        """Text, start and end of a unit without the punctuation at its edges."""
        i, s, e = int(self.text[self.first[unit]]), int(self.start[self.first[unit]]), int(self.end[self.last[unit]])
        core = self.texts[i][s:e]
        for edge in (_EDGE, _EDGE + "()"):
            cut = core.lstrip(edge)
            s, core = s + len(core) - len(cut), cut.rstrip(edge)
            if core.count("(") == core.count(")"):
                break
        return i, s, s + len(core)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _contexts(trusted: Bloom | None):
    """Edges of base spans and of trusted instances, with the words of their patterns."""

    def run(batches):
        for batch in in_pieces(batches):
            units = Units(_texts(batch))
            keys = units.instances()
            wanted = np.arange(len(keys)) >= units.seeded
            if trusted:
                wanted |= trusted.holds(keys)
            rows = []
            for kind, (of, pattern) in enumerate(units.patterns()):
                for j in np.flatnonzero(wanted[of]).tolist():
                    u = int(of[j])
                    rows.append((int(pattern.view(np.int64)[j]), units.label(kind, u), int(keys.view(np.int64)[u]), units.bases[u - units.seeded][3] if u >= units.seeded else None))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["pattern", "words", "instance", "seed"])

    return run


def _occurrences(known: Bloom):
    """How often each pattern that may be known occurs, a row for each piece of the texts."""

    def run(batches):
        for batch in in_pieces(batches):
            units = Units(_texts(batch))
            found = [pattern[known.holds(pattern)] for _, pattern in units.patterns()]
            pattern, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(pattern.view(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    return run


def _instances(known: Bloom):
    """Pattern and instance wherever a pattern that may be known occurs."""

    def run(batches):
        for batch in in_pieces(batches):
            units = Units(_texts(batch))
            keys = units.instances().view(np.int64)
            kinds = np.array([None] * units.seeded + [b[3] for b in units.bases], object)
            for of, pattern in units.patterns():
                some = known.holds(pattern)
                if some.any():
                    yield pa.record_batch([pa.array(pattern[some].view(np.int64)), pa.array(keys[of[some]]), pa.array(kinds[of[some]], pa.string())], names=["pattern", "instance", "seed"])

    return run


def _spans(known: Bloom | None):
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        hit = pa.list_(pa.struct([("pattern", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digit", pa.bool_())]))
        for batch in in_pieces(batches):
            texts = _texts(batch)
            hits: list[list[dict]] = [[] for _ in texts]
            if known:
                units = Units(texts)
                found = units.spans
                for of, pattern in units.patterns():
                    for j in np.flatnonzero(known.holds(pattern) & (of < units.seeded)).tolist():
                        i, s, e = units.span(int(of[j]))
                        if s < e:
                            hits[i].append({"pattern": int(pattern.view(np.int64)[j]), "start": s, "end": e, "digit": bool(_DIGIT.search(texts[i], s, e))})
            else:
                found = [base_spans(t) for t in texts]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.record_batch([batch.column("doc_id"), rows, pa.array(spans, span), pa.array(hits, hit)], names=["doc_id", "row", "spans", "hits"])

    return run


def scored(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence, gathered) and (instance, seed, trust), by scores passed to and fro; edges: distinct pairs, with seeds."""
    instances = edges.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("trust", F.col("seed").isNotNull().cast("double"))
    for _ in range(rounds):
        seen = split_join(edges.select("pattern", "instance"), instances.select("instance", "trust"), ["instance"])
        patterns = seen.groupBy("pattern").agg(F.avg("trust").alias("share"), F.count("*").alias("distinct"), F.sum("trust").alias("gathered"))
        patterns = staged(patterns.select("pattern", (F.col("share") * (1 - F.pow(F.lit(2.0), -F.col("distinct")))).alias("confidence"), "gathered"), "private-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        raised = split_join(edges, patterns.select("pattern", "confidence"), ["pattern"]).groupBy("instance").agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
        instances = staged(raised.select("instance", "seed", F.when(F.col("seed").isNotNull(), 1.0).otherwise(1 - F.col("doubt")).alias("trust")), "private-instances")
    return patterns, instances


def confident_patterns(docs: DataFrame, turns: int = TURNS, least_trust: float = LEAST_TRUST, least: float = LEAST_CONFIDENCE) -> DataFrame | None:
    """pattern, words, kind, confidence of the patterns whose instances are personal data; None if there are none."""
    texts = docs.select("text")
    trusted, strong, best, names = None, None, None, None
    for _ in range(turns):
        bloom = Bloom.of(trusted.select("instance")) if trusted is not None else None
        seen = texts.mapInArrow(_contexts(bloom), EDGES).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("words").alias("words"), F.count("*").alias("n"))
        seen = staged(seen, "private-contexts")
        known = seen.withColumn("trust", F.col("seed").isNotNull().cast("double"))
        if trusted is not None:
            known = split_join(seen, trusted.select("instance", F.col("trust").alias("raised")), ["instance"], "left")
            known = known.withColumn("trust", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("raised", F.lit(0.0))))
        gathered = known.groupBy("pattern").agg(F.sum("trust").alias("gathered"), F.sum(F.col("n") * F.col("trust")).alias("places"), F.max("words").alias("words"))
        names = staged(gathered.filter(F.col("gathered") >= least_trust), "private-strong")
        fresh = names.select("pattern") if strong is None else names.select("pattern").subtract(strong)
        bloom = Bloom.of(names.select("pattern")) if fresh.limit(1).count() else None
        if bloom is None:
            break
        times = texts.mapInArrow(_occurrences(bloom), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
        strong = staged(names.join(times, "pattern").filter(F.col("places") >= LEAST_SHARE * F.col("n")).select("pattern"), "private-kept")
        bloom = Bloom.of(strong)
        if bloom is None:
            break
        found = texts.mapInArrow(_instances(bloom), "pattern long, instance long, seed string").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
        edges = staged(split_join(found, strong, ["pattern"]), "private-graph")
        patterns, instances = scored(edges)
        sure = patterns.filter((F.col("confidence") >= least) & (F.col("gathered") >= least_trust))
        kinds = edges.select("pattern", F.col("seed").alias("kind"))
        if trusted is not None:
            kinds = split_join(edges, trusted.select("instance", "kind"), ["instance"], "left").select("pattern", F.coalesce("seed", "kind").alias("kind"))
        kinds = kinds.filter("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max(F.struct("n", "kind")).getField("kind").alias("kind"))
        best = staged(sure.join(kinds, "pattern").join(names.select("pattern", "words"), "pattern").select("pattern", "words", "kind", "confidence"), "private-best")
        raised = split_join(edges, best.select("pattern", "kind", "confidence"), ["pattern"]).groupBy("instance").agg(F.max(F.struct("confidence", "kind")).getField("kind").alias("kind"))
        trusted = staged(raised.join(instances.filter((F.col("trust") >= least) & F.col("seed").isNull()), "instance").select("instance", "kind", "trust"), "private-trusted")
        if not trusted.limit(1).count():
            break
    return best


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base, as structs) and found (spans by context, as structs) of every row."""
    patterns = confident_patterns(docs)
    bloom = Bloom.of(patterns.select("pattern")) if patterns is not None else None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(_spans(bloom), FOUND)
    none = F.array().cast(f"array<{SPAN}>")
    if bloom is None:
        return rows.select("doc_id", "spans", none.alias("found"))
    rows = staged(rows, "private-spans")
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    hits = split_join(hits, patterns, ["pattern"]).groupBy("row", "start", "end", "digit").agg(F.max(F.struct("confidence", "kind")).alias("best"), F.count("*").alias("patterns"))
    hits = hits.filter("digit or patterns > 1")
    span = F.struct(F.concat(F.lit("context_"), "best.kind").alias("kind"), "start", "end")
    extra = hits.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    return rows.select("doc_id", "row", "spans").join(extra, "row", "left").select("doc_id", "spans", F.coalesce("found", none).alias("found"))


def op5_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_private(documents(spark, sf_dir))
    written = "transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end))"
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(F.expr(f"array_join({written.format('spans')}, ',')"), 256).alias("base_sha256")
    return df.select("doc_id", *counts, base, F.expr(f"array_join(concat({written.format('spans')}, {written.format('found')}), ',')").alias("spans"))
