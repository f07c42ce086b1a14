"""Operators on documents against brute force, with nulls, empties, ties, copies and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import ORACLE, same_rows
from tidemark.llm import components, decontamination, line_dedup, mixing, near_duplicates, private_data, quality, queries, repeats, sharding
from tidemark.llm.common import split_join
from tidemark.llm.components import connected_components


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_joins_equal_plain_ones(spark, how):
    left = spark.createDataFrame([(1, "a", i) for i in range(4000)] + [(2, "b", i) for i in range(1500)] + [(i, "c", i) for i in range(300)], "k long, t string, v long")
    right = spark.createDataFrame([(1, "a", 10), (5, "c", 50), (7, "c", 70), (9, "x", 90)], "k long, t string, w long")
    got = split_join(left, right, ["k", "t"], how).collect()
    assert order(map(tuple, got)) == order(map(tuple, left.join(right, ["k", "t"], how).collect()))
    assert len(got) == {"inner": 4002, "left": 5800, "left_semi": 4002}[how]


# ---- lines ----


def test_lines_equal_sql(spark, duck):
    same_rows(queries.QUERIES["op2_line_chunks"](spark, ORACLE), duck, queries.ORACLES["op2_line_chunks"])


def test_lines_hard(spark, hard, nothing):
    rows = line_dedup.drop_repeated_chunks(hard).collect()
    assert len(rows) == hard.count() and line_dedup.drop_repeated_chunks(nothing).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].kept_text is None and by[1].n_lines == 0 and by[2].kept_text == "" and by[7].n_removed_lines == 0
    assert by[8].n_removed_lines > 30 and by[9].kept_text.endswith("end")
    for r in rows:
        assert r.n_lines - r.n_removed_lines == (0 if r.kept_text is None or (r.kept_text == "" and r.n_removed_lines == r.n_lines) else len(r.kept_text.split("\n")))


# ---- near duplicates ----


def brute_components(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return out


def order(rows):
    return sorted(rows, key=str)


def test_components_equal_brute_force(hard, nothing):
    got = near_duplicates.similarity_components(hard).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute_components(pairs(hard)))
    assert near_duplicates.similarity_components(nothing).count() == 0


def test_blocks_and_chunks_change_nothing(spark, hard, monkeypatch):
    for name, value in (("BLOCK_MEMBERS", 200), ("CHUNK_ROWS", 7), ("COMMON_MEMBERS", 5)):
        monkeypatch.setattr(near_duplicates, name, value)
    got = near_duplicates.similarity_components(hard).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute_components(pairs(hard)))


def test_rows_without_ids_are_not_multiplied(spark):
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 500, 40))
    base = [text() for _ in range(60)]
    rows = [(None, t) for t in base] + [(None, t + " end") for t in base[:30]] + [(None, base[0])] * 5 + [(7, base[3]), (7, base[4])]
    got = near_duplicates.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute_components(rows))


def test_ranges_follow_the_rows():
    bits = [near_duplicates._ranges(n) for n in (0, 10**5, 10**6, 10**8, 10**9, 3 * 10**10)]
    assert bits == sorted(bits) and bits[0] == (7, 4000) and bits[-1][0] == 19 and bits[-1][1] <= 60_000


def test_one_of_each_group_stays(hard):
    kept = near_duplicates.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    rows = pairs(kept)
    left = brute_components(rows)
    assert len({c for _, n, c in left if n and c is not None}) == len([1 for _, n, c in left if n and c is not None])
    assert {d for d, _ in rows} >= {1, 2, 3, 4, 7, 10} and not {8, 9, 11, 12} & {d for d, _ in rows}
    assert len([d for d, _ in rows if d == 5]) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=14), min_size=2, max_size=60))
def test_tree_join_loses_no_link(sets):
    sets = [np.array(sorted(s), np.uint64) for s in {frozenset(x) for x in sets}]

    def components(links):
        label = list(range(len(sets)))
        for a, b in links:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == v) for v in set(label)}

    real = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
    got = near_duplicates.tree_join(sets, None, 80)
    assert set(map(frozenset, got)) <= set(map(frozenset, real)) and components(got) == components(real)
    half = len(sets) // 2
    across = near_duplicates.tree_join(sets[:half], sets[half:], 80) if half else []
    assert set(across) <= {(i, j) for i, j in real if i < half <= j}


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_components_of_paths(spark, small, monkeypatch):
    monkeypatch.setattr(components, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 150), (150, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 150: 150, 200: 150, 300: 150}


# ---- repeats ----


def brute_repeats(rows, length):
    seen = collections.Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        out.append((len(t), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), bytes(x for x, c in zip(t, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize("hot,batches", [(2000, 4), (1, 3), (2000, 1)])
def test_repeats_equal_brute_force(hard, nothing, hot, batches, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 3000)
    rows, changed = repeats.cut_repeats(hard, hot=hot, batches=batches)
    changed = {(r.d1, r.d2): r for r in changed.collect()}
    got = []
    for r in rows.collect():
        c = changed.get((r.d1, r.d2))
        if r.copies > 1 and r.n_bytes >= 400:
            got.append((r.doc_id, r.n_bytes, r.n_bytes, 1, hashlib.sha256(b"").hexdigest()))
        else:
            got.append((r.doc_id, r.n_bytes, c.n_removed if c else 0, c.n_spans if c else 0, hashlib.sha256(c.kept).hexdigest() if c else r.sha))
    given_rows = pairs(hard)
    want = [(d, n, k, s, hashlib.sha256(kept).hexdigest()) for (d, _), (n, k, s, kept) in zip(given_rows, brute_repeats([(t or "").encode() for _, t in given_rows], 400), strict=True)]
    assert order(got) == order(want)
    assert repeats.cut_repeats(nothing)[0].count() == 0


def test_repeats_of_texts_with_one_id(spark):
    a, b = (" ".join(f"{k}{i * i}" for i in range(300)) for k in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (1, a + "!"), (None, b + "?"), (None, a + "?"), (2, None)], "doc_id long, text string")
    rows, changed = repeats.cut_repeats(docs)
    changed = {(r.d1, r.d2): (r.n_removed, r.n_spans, r.kept) for r in changed.collect()}
    got = [(r.n_bytes, *(changed.get((r.d1, r.d2)) or (0, 0, None))[:2]) for r in rows.collect()]
    want = [(n, k, s) for n, k, s, _ in brute_repeats([(r.text or "").encode() for r in docs.collect()], 400)]
    assert order(got) == order(want) and len(changed) == 5


def passage(mark, size):
    """59 words, as many as the longest benchmark item has, of so many bytes."""
    plain = " ".join(f"{'é' if i % 2 else 'e'}{mark}{i:03}" for i in range(59))
    return plain + "x" * (size - len(plain.encode()))


def test_repeats_query_goes_by_400_bytes_and_not_by_words(spark, hard, tmp_path):
    sizes = {"p": 394, "q": 399, "r": 400, "s": 401}
    rows = [(1000 + 2 * i + j, f"{sides}{mark}{sides[0]}{passage(mark, size)}{sides[1]}{mark}") for i, (mark, size) in enumerate(sizes.items()) for j, sides in enumerate(("[]", "()"))]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    given_rows = pairs(docs)
    want = [(d, n, k, s, hashlib.sha256(kept).hexdigest()) for (d, _), (n, k, s, kept) in zip(given_rows, brute_repeats([(t or "").encode() for _, t in given_rows], 400), strict=True)]
    got = [tuple(r) for r in queries.QUERIES["op4_index_family"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert order(got) == order(want)
    assert [k for d, _, k, *_ in sorted(r for r in got if (r[0] or 0) >= 1000)] == [0, 0, 0, 0, 400, 400, 401, 401]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("ab\x00", min_size=8, max_size=30), min_size=1, max_size=5), min_size=1, max_size=5))
def test_levels_are_suffix_arrays(batches):
    length, levels, matched, everything, number = 8, [], set(), [], 0
    for texts in batches:
        regions = [t.encode() for t in texts]
        names = np.array([(number + i, 0, 1) for i in range(len(regions))], np.int64)
        number += len(regions)
        everything += regions
        level, twice = repeats.Level.build(regions, names, length)
        matched |= {bytes(level.data[s : s + length]) for s in twice}
        for old in reversed(levels):
            low, equal = old.scan(level)
            matched |= {bytes(level.data[s : s + length]) for s in level.order[equal]}
            assert all(bytes(old.data[s : s + length]) in matched for s in old.order[low[equal]])
        while levels and len(levels[-1].order) <= 2 * len(level.order):
            old = levels.pop()
            level = old.merged(level, *old.scan(level))
        level = repeats.Level.unpack(*level.pack(), length)
        assert (wins := [bytes(level.data[s : s + length]) for s in level.order]) == sorted(set(wins))
        levels.append(level)
    counts = collections.Counter(r[i : i + length] for r in everything for i in range(len(r) - length + 1))
    assert matched == {w for w, n in counts.items() if n > 1}
    names, low, high = level.runs(level.order)
    assert all(0 <= a <= b for a, b in zip(low, high, strict=True))


# ---- personal data ----


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "a@b.c", "-", "+", " ", "9", "12", "x.y", "é", "(", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 123-4567", "999", "\n"]), max_size=14).map("".join))
def test_base_spans(text):
    assert private_data.base_spans(text) == plain_spans(text)


def test_contexts_find_unseen(spark):
    rows = [(i, f"write to contact me: user{i}@mail.org thanks a lot") for i in range(30)] + [(100, "write to contact me: agent-0077x thanks a lot"), (101, "the number was 12345 and not me"), (102, None)]
    df = private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in df.collect()}
    assert [s.kind for s in got[100].found] == ["context_email"] and rows[30][1][got[100].found[0].start : got[100].found[0].end] == "agent-0077x"
    assert not got[101].found and not got[102].spans and len(got[3].spans) == 1


def test_contexts_of_groups_and_of_words_without_digits(spark):
    seeds = [(i, f"please call the office line +1 (555) 010-{1000 + i} before noon") for i in range(20)] + [(50 + i, f"my secret handle is u{i}@mail.org okay then") for i in range(20)]
    unseen = [(100, "please call the office line 0171 555 1234 before noon"), (101, "my secret handle is blueFalcon okay then"), (102, "an office line was quiet")]
    text = dict(unseen)
    df = private_data.find_private(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))
    got = {r.doc_id: [(s.kind, text[r.doc_id][s.start : s.end]) for s in r.found] for r in df.collect() if r.doc_id >= 100}
    assert got == {100: [("context_phone", "0171 555 1234")], 101: [("context_email", "blueFalcon")], 102: []}


def test_finds_raise_new_patterns(spark):
    """An identifier found under one pattern induces another one, which finds what the seeds' contexts don't show."""
    rows = [(i, f"send it to account u{i}@mail.org right now") for i in range(40)]
    rows += [(100 + i, f"send it to account zz{i}k right now") for i in range(8)] + [(200 + i, f"we have closed ticket zz{i}k for good") for i in range(8)]
    rows += [(300, "we have closed ticket qq77x for good")]
    got = {r.doc_id: [s.kind for s in r.found] for r in private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ["context_email"] and got[200] == ["context_email"] and got[300] == ["context_email"]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "7" + "x" * 1_000_000, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "a." * 500_000, "é" * 500_000 + "1"])
def test_long_runs_take_linear_time(text):
    import time

    began = time.process_time()
    private_data.Units([text])
    assert time.process_time() - began < 4


def test_private_query_equals_brute_force(spark, hard, tmp_path):
    rng = np.random.default_rng(7)
    parts = ["a.b@c.org", "10.0.0.300", "10.0.0.30", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "x@y", "é", "日本", "word", "\n", "9" * 30, "call me on"]
    more = spark.createDataFrame([(1000 + i, " ".join(rng.choice(parts, 30))) for i in range(60)], "doc_id long, text string")
    docs = hard.select("doc_id", "text").unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, t in pairs(docs):
        spans = plain_spans(t or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((d, *(sum(s[0] == k for s in spans) for k in private_data.KINDS), hashlib.sha256(written.encode()).hexdigest(), written))
    got = queries.QUERIES["op5_bootstrap"](spark, str(tmp_path)).collect()
    assert order((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(x for x in r.spans.split(",") if x and not x.startswith("context_"))) for r in got) == order(want)


def test_bloom_forgets_nothing(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    bloom = private_data.Bloom.of(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert bloom.holds(keys.view(np.uint64)).all()
    assert bloom.holds(np.arange(1, 10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.01
    assert private_data.Bloom.of(spark.createDataFrame([], "k long")) is None


def test_private_hard(hard, nothing):
    assert private_data.find_private(hard).count() == hard.count() and private_data.find_private(nothing).count() == 0


# ---- quality ----


def test_quality_counts_equal_brute_force(hard, nothing):
    got = quality.judge_documents(hard, quality.PRIOR, quality.PRIOR_TRANSITIONS).collect()
    want = []
    for d, t in pairs(hard):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        spots = collections.defaultdict(list)
        for i in range(len(w) - 7):
            spots[tuple(w[i : i + 8])].append(i)
        again = len({k for at in spots.values() if len(at) > 1 for i in at for k in range(i, i + 8)})
        lines, dup = [], 0
        for x in (t or "").split("\n"):
            dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines
            lines.append(x)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, again, len(w) < 20 or 100 * again > 30 * len(w)))
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == order(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge_documents(nothing, quality.PRIOR, quality.PRIOR_TRANSITIONS).count() == 0


def test_field_learns_and_falls_back(spark, nothing):
    docs, labels = (spark.read.parquet(f"{ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.filter("doc_id % 2 = 0")
    theta, trans = quality.fitted(docs, even)
    held = quality.judge_documents(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id", "left_semi"), theta, trans).join(labels, "doc_id").collect()
    agree = np.mean([r.kept == bool(r.quality) for r in held if not r.base_failed])
    assert agree > 0.95
    assert (quality.fitted(docs, labels.filter("false"))[0] == quality.PRIOR).all()
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        emit, trans = rng.normal(size=6), rng.normal(size=(2, 2))
        score = lambda y: sum(e for e, k in zip(emit, y, strict=True) if k) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023,E731
        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert tuple(quality.viterbi(emit.tolist(), trans.tolist())) == best


# ---- shards ----


@pytest.mark.parametrize("n", [1, 8])
def test_shards(hard, nothing, n):
    df = sharding.shard_by_bytes(hard, n)
    rows = df.collect()
    assert len(rows) == hard.count() and sharding.shard_by_bytes(nothing, n).count() == 0
    for k in range(n):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows} <= set(range(n)) and all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)


def test_shards_are_even(spark):
    q = queries.QUERIES["op8_histogram_sort"](spark, ORACLE)
    by = {r.shard: r.b for r in q.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(by) == 8 and max(by.values()) < 1.06 * min(by.values())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{ORACLE}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in q.collect())


@pytest.mark.parametrize("n", [2, 8])
def test_shards_equal_a_plain_sort(spark, hard, n):
    """Rows in order of (hash, doc_id): shards are runs of it, slots count along them, edges meet the tolerance."""
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, f"text number {i * i} " * (i % 9 + 1)) for i in range(3000)], "doc_id long, text string"))
    key = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("b")).alias("key")
    rows = sorted((tuple(r.key), r["size"], r.shard, r.slot) for r in sharding.shard_by_bytes(docs, n).select(key, "size", "shard", "slot").collect())
    total, reach, last = sum(size for _, size, _, _ in rows), 0, None
    slots: dict[int, list[int]] = collections.defaultdict(list)
    for k, size, shard, slot in rows:
        assert last is None or shard >= last[1]
        if last and shard > last[1]:  # an edge: no key in reach is nearer to its target by more than the tolerance
            assert abs(reach - total * shard / n) <= max(0.001 * total / n, max(s for _, s, _, _ in rows)) + 1
        slots[shard].append(slot)
        reach, last = reach + size, (k, shard)
    assert set(slots) == set(range(n)) and all(x == list(range(len(x))) for x in slots.values())


def test_a_hot_group_is_split(spark):
    rows = [(i, "the very same text in all of these rows") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(1500)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 8 and max(r.b for r in got) < 1.02 * min(r.b for r in got) and all(r.m + 1 == r.n for r in got)


# ---- decontamination ----


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        old, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (p != t))
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
def test_myers(pattern, text):
    k = len(pattern)
    best, _ = decontamination.myers(decontamination.masks_of(pattern), len(pattern), text, k)
    assert min(best, len(pattern)) == distance(pattern, text)


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_pieces_miss_nothing(data):
    item = " ".join(data.draw(st.lists(st.text("abcd", min_size=2, max_size=6), min_size=6, max_size=10)))
    text = list(item)
    for _ in range(decontamination.budget(decontamination.normal(item), 0.1)):
        at = data.draw(st.integers(0, len(text)))
        text[at : at + data.draw(st.integers(0, 1))] = data.draw(st.text("xy", max_size=1))
    body = "start " + "".join(text) + " stop"
    want = distance(decontamination.normal(item), decontamination.normal(body))
    got = decontamination.Matcher([(1, item)], 0.1).find(body)
    assert (got[0][1] if got else 10**6) == (want if want <= decontamination.budget(decontamination.normal(item), 0.1) else 10**6)


def test_short_items_stand_between_word_boundaries():
    find = lambda item, text: [h[1] for h in decontamination.Matcher([(1, item)]).find(text)]
    assert not find("cat", "concatenate") and not find("a b", "banana bob") and not find("7", "1970")
    assert find("cat", "The Cat!") == [0] and find("a b", "x, a--b") == [0] and find("cat", "cat") == [0]


def test_items_query_equals_brute_force(spark, hard, tmp_path):
    texts = [t for _, t in pairs(hard) if t]
    items = [(1, " ".join(texts[5].split()[:30])), (2, "cat"), (3, "one two three"), (4, texts[-10][20:160]), (5, texts[-10][20:80] + "XX" + texts[-10][82:160])]
    hard.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for d, t in pairs(hard):
        body = decontamination.normal(t or "")[:4000]  # what the items can be in lies before that
        for i, item in items:
            own = decontamination.normal(item)
            if body and own in body:
                want.append((d, i, 0))
            elif body and len(body) < 1500 and (n := distance(own, body)) <= decontamination.budget(own):
                want.append((d, i, n))
    got = [(r.doc_id, r.item_id, r.distance) for r in queries.QUERIES["op9_pigeonhole_edit"](spark, str(tmp_path)).collect()]
    assert order(got) == order(want) and len(want) > 5


def test_items_hard(spark, hard, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "no ID here, at all friend"), (None, "one two three four"), (5, "one two three four")], "item_id long, text string")
    got = decontamination.find_items(hard, items).collect()
    assert order((r.doc_id, r.item_id) for r in got) == order([(None, 3), (5, None), (5, None), (6, None), (5, 5), (5, 5), (6, 5)])
    kept = decontamination.drop_contaminated(hard, items)
    assert kept.columns == hard.columns and kept.count() == hard.count() - 4
    assert decontamination.find_items(nothing, items).count() == 0 and decontamination.find_items(hard, items.filter("false")).count() == 0


# ---- mixing ----


def test_mixture_meets_its_targets(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i < 3000 else "small" if i < 4000 else "tiny") for i in range(4300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.plan_mixture(docs, 2.0).collect()}
    due = {s: r.passes * r.words + r.rest for s, r in plan.items()}
    share = {s: r.words / sum(x.words for x in plan.values()) for s, r in plan.items()}
    weights = {s: share[s] ** plan[s].exponent for s in share}
    total = sum(weights.values())
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9 and all(abs(plan[s].weight - weights[s] / total) < 1e-9 for s in share)
    assert abs(max(due[s] / plan[s].words for s in due) - 2.0) < 0.01 and min(due[s] / plan[s].words for s in due) == 1
    out = mixing.mix(docs, 2.0)
    took = {r.source: r.n for r in out.withColumn("w", mixing.n_words()).groupBy("source").agg(F.sum("w").alias("n")).collect()}
    assert all(0 <= due[s] - took[s] <= 12 for s in due)
    copies = out.groupBy("doc_id").count().collect()
    assert len(copies) == 4300 and max(r["count"] for r in copies) <= 2
    entropy = mixing.plan_mixture(docs, None, 0.9).collect()
    h = -sum(r.weight * np.log(r.weight) for r in entropy)
    assert abs(h / np.log(3) - 0.9) < 1e-3


def test_mixture_budget(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i % 3 else "y") for i in range(900)], "doc_id long, text string, source string")
    out = mixing.mix(docs, 1.5, budget=1000)
    assert abs(4 * out.count() - 1000) <= 8


def test_mixture_equals_brute_force(spark, monkeypatch):
    """Which rows the last pass takes: whole blocks in their order while they fit, then rows of the next block."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rows = [(i, "w " * (1 + i * i % 11), "big" if i < 900 else "mid" if i < 1300 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.plan_mixture(docs, 1.7).collect()}
    want = collections.Counter()
    for source, p in plan.items():
        own = docs.filter(F.col("source").eqNullSafe(F.lit(source))).withColumn("__block", mixing._block(F.lit(p.n_blocks)))
        facts = own.select("doc_id", mixing.n_words().alias("w"), "__block", mixing._block_order(F.lit(p.passes).cast("long")).alias("o"), mixing._row_order(F.lit(p.passes).cast("long")).alias("r")).collect()
        blocks = collections.defaultdict(list)
        for x in facts:
            want[x.doc_id] += p.passes
            blocks[x.o, x["__block"]].append(x)
        room = p.rest
        for _, members in sorted(blocks.items()):
            if sum(x.w for x in members) <= room:
                room -= sum(x.w for x in members)
                want.update(x.doc_id for x in members)
                continue
            for x in sorted(members, key=lambda x: x.r):
                room -= x.w
                if room < 0:
                    break
                want[x.doc_id] += 1
            break
    assert plan["big"].n_blocks == 18 and any(p.rest for p in plan.values())
    assert collections.Counter(r.doc_id for r in mixing.mix(docs, 1.7).collect()) == want


def test_mixture_hard(hard, nothing):
    plan = mixing.plan_mixture(hard)
    out = mixing.realise(hard, plan, epoch="e2", order="o2")
    assert out.columns == [*hard.columns, "e2", "o2"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in hard.collect()}
    assert mixing.realise(hard, plan).columns == [*[c for c in hard.columns if c != "epoch"], "epoch", "mix_order"]
    assert mixing.mix(nothing).count() == 0
