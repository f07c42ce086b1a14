"""Token counts and compressed ids against the library itself."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries, repair, token_counts
from tidemark.llm.tokens import Encoder

NAME = "word_bpe_49k.json"
library = Tokenizer.from_file(public_tokenizers.path(NAME))
encoder = Encoder(NAME)


def direct(text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'aAbBsStTéÉ<|endoftext|>0 ́ \x1c　İΣς")), st.characters(codec="utf-8")), max_size=60))
def test_pieces_equal_the_library(text):
    assert encoder.encode([text])[0] == np.array(direct(text), "<u4").tobytes()


def test_other_kinds():
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert len(Encoder(name).encode(["hello  world", ""])[0]) > 0


def test_counts_and_cache(spark, hard, nothing, tmp_path):
    cache = str(tmp_path / "cache")
    rows = token_counts.count_tokens(hard, NAME, cache, 100).collect()
    assert len(rows) == hard.count()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(direct(r.text)), len(direct(r.text)) > 100) for r in hard.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    stored = token_counts.read_cache(spark, cache).count()
    assert spark.read.parquet(cache).count() == stored
    token_counts.count_tokens(hard, NAME, cache).count()
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    assert token_counts.count_tokens(nothing, NAME, cache).count() == 0
    assert token_counts.count_tokens(nothing, NAME, str(tmp_path / "empty")).count() == 0


def test_a_second_query_encodes_nothing(spark, hard, tmp_path, monkeypatch):
    hard.write.parquet(str(tmp_path / "documents.parquet"))
    first = queries.QUERIES["op7_digest_cache"](spark, str(tmp_path)).collect()
    monkeypatch.setattr(token_counts, "_counts", None)  # an encoder that can't be called
    again = queries.QUERIES["op7_digest_cache"](spark, str(tmp_path)).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(direct(r.text)), len(direct(r.text)) > 2048) for r in hard.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in first) == want
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_all_words_of_the_documents_equal_the_library():
    """Pieces that the merges encode, over every distinct word of the 0.1 documents."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()
    words = pc.unique(pc.split_pattern_regex(pc.drop_null(texts), r"\s+").flatten()).to_pylist()
    ids, counts = encoder.encode_flat(pa.array(words))
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert len(words) > 10_000 and counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_blocks_round_trip(spark, hard, tmp_path, block_ids):
    path = str(tmp_path / "blocks")
    repair.write_blocks(hard, NAME, path, block_ids=block_ids)
    got = repair.read_digests(spark, path).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in hard.select("doc_id", "text").collect()))
    start = 0
    assert len(got) == len(rows)
    for g, (known, d, text) in zip(got, rows, strict=True):
        ids = np.array([*direct(text), 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d if known else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_blocks(spark, nothing, tmp_path):
    repair.write_blocks(nothing, NAME, str(tmp_path / "none"))
    assert repair.read_digests(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(3, 8), max_size=80), min_size=1, max_size=12))
def test_random_access(docs):
    ids = [np.array([*d, 2], "<u4") for d in docs]
    base, rules, seq = repair.compress(np.concatenate(ids), 2, least=2)
    block = repair.Block(repair.pack(np.concatenate(ids), np.array([len(d) for d in ids]), 2))
    assert (block.all_ids() == np.concatenate(ids)).all() and block.sizes().tolist() == [len(d) for d in ids]
    for i, d in enumerate(ids):
        assert (block.document(i) == d).all()
        assert [block.id_at(i, k) for k in range(len(d))] == d.tolist()


def test_it_compresses():
    ids = np.array(([5, 6, 7, 8, 9] * 400 + [2]) * 20, "<u4")
    _, rules, seq = repair.compress(ids, 2)
    assert len(seq) + 2 * len(rules) < len(ids) / 10


def test_a_stem_is_merged_once(monkeypatch):
    texts = ["word word, Word. WORD! (word) other", "wörd WÖRD; word's --", "other..."]
    merge, given_ = encoder.merges.encode, []
    monkeypatch.setattr(encoder.merges, "encode", lambda data, starts, lengths: given_.extend(data[a : a + n].tobytes().decode() for a, n in zip(starts, lengths, strict=True)) or merge(data, starts, lengths))
    assert encoder.encode(texts) == [np.array(direct(t), "<u4").tobytes() for t in texts]
    assert sorted(given_) == ["other", "word", "wörd"]


@pytest.mark.parametrize("ids", [np.tile(np.arange(5, 905), 30), np.r_[np.tile(np.arange(5, 45), 14), np.arange(50, 3000)], np.full(4000, 7), np.arange(5, 65), np.r_[np.full(20, 65535), np.arange(5, 30)], np.arange(65500, 65536)])
def test_a_symbol_is_expanded_once(ids, monkeypatch):
    """Where copies of symbols abound, rules are followed for one of each; else for the sequence."""
    rows = [np.r_[x, 2].astype(np.uint32) for x in np.array_split(ids, 3)]
    block = repair.Block(repair.pack(np.concatenate(rows), np.array(list(map(len, rows))), 2))
    plain, followed = repair.Block._by_rules, []
    monkeypatch.setattr(repair.Block, "_by_rules", lambda self, seq: followed.append(seq) or plain(self, seq))
    assert block.all_ids().tolist() == np.concatenate(rows).tolist() == plain(block, block.seq).tolist()
    assert block.sizes().tolist() == list(map(len, rows))
    assert [block.document(i).tolist() for i in range(3)] == [r.tolist() for r in rows]
    assert all(len(seq) <= len(block.seq) for seq in followed)
