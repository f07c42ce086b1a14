"""Token ids of whole texts, by their distinct words where the tokenizer permits it."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that callers gather for one call: the more, the fewer distinct words a text.
GROUP_BYTES = 7_000_000
#: Runs of signs that a worker remembers the ids of.
MOST_MARKS = 100_000
#: ASCII signs that may follow letters as a token run of their own: not those that begin contractions or special tokens.
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = True


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name) if os.sep not in name else name


class Merges:
    """Byte-pair merging of many words at once, as the model's merge list has it.

    Words of equal length are rows of a matrix. A step merges in each row the pair of lowest rank, the leftmost of equal
    ones, so that rows stay equally long; a row without a pair to merge is done.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.zeros(1 << 19, np.uint64), np.full(1 << 19, self.NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # open addressing: what finds its slot taken goes on to the next
            free = self.ranks[at] == self.NONE
            first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]
            won = first[free[first]]
            self.keys[at[won]], self.ranks[at[won]] = keys[left[won]], left[won]
            rest = np.setdiff1d(np.arange(len(left)), won)
            left, at = left[rest], (at[rest] + 1) & ((1 << 19) - 1)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((out == self.NONE) & (self.ranks[at] != self.NONE))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << 19) - 1)
            slot = at[open_]
            hit = self.keys[slot] == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            open_ = open_[~hit & (self.ranks[slot] != self.NONE)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words data[start:start + length] in turn, how many each has); a word has a byte at least."""
        counts, done_rows, done_ids = np.zeros(len(starts), np.int64), [], []
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            letters = data[starts[rows][:, None] + np.arange(n)]
            symbols = np.concatenate([self.inner[letters[:, :-1]], self.last[letters[:, -1:]]], 1)
            ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), n - 1)
            while len(rows):
                width = symbols.shape[1]
                best = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
                value = ranks[np.arange(len(rows)), best] if width > 1 else np.full(len(rows), self.NONE)
                done = value == self.NONE
                if done.any():
                    counts[rows[done]] = width
                    done_rows.append(rows[done])
                    done_ids.append(symbols[done])
                    live = ~done
                    rows, symbols, ranks, best, value = rows[live], symbols[live], ranks[live], best[live], value[live]
                    if not len(rows):
                        break
                row = np.arange(len(rows))
                symbols[row, best] = self.made[value]
                stays = np.ones(symbols.shape, bool)
                stays[row, best + 1] = False
                symbols = symbols[stays].reshape(len(rows), width - 1)
                stays = np.ones(ranks.shape, bool)
                stays[row, best] = False
                ranks = ranks[stays].reshape(len(rows), width - 2)
                before, after = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
                at = best[before]
                ranks[before, at - 1] = self.rank(symbols[before, at - 1], symbols[before, at])
                at = best[after]
                ranks[after, at] = self.rank(symbols[after, at], symbols[after, at + 1])
        ids, offsets = np.empty(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for rows, symbols in zip(done_rows, done_ids, strict=True):
            ids[offsets[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        return ids, counts


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start:start + count] of all in turn."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


def distinct_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the distinct ones each data[start:start + length] is, the bytes of the distinct ones in turn, where each starts and the last ends)."""
    if not len(starts):
        return np.zeros(0, np.int64), data[:0], np.zeros(1, np.int64)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(gather(data, starts, lengths))]).dictionary_encode()
    _, bounds, found = runs.dictionary.buffers()
    return runs.indices.to_numpy(), np.frombuffer(found, np.uint8), np.frombuffer(bounds, np.int32, len(runs.dictionary) + 1).astype(np.int64)


class Encoder:
    """Encodes texts exactly as the library does, without special tokens being added.

    Some tokenizers drop white space before they split, so that no token spans a space or line feed and a text's ids
    are those of its pieces in turn. For these, the distinct pieces of many texts are encoded once. Pieces of Latin
    letters, parted from the signs after them as such tokenizers part them, are merged many at once by the model's own
    merge list; all others go to the library. Other tokenizers encode whole texts.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(name)
        self.merges: Merges | None = None
        if path.endswith(".model"):
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: self._model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()
        self._encode = lambda texts: [e.ids for e in self._model.encode_batch_fast(texts, add_special_tokens=False)]
        if drops_white_space(path):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            if model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
                self.merges = Merges(model)
                self._marks: dict[str, np.ndarray] = {}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_flat(pa.array(texts, pa.string()))
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, how many each has); texts without nulls, of less than 2 GB together."""
        if self.merges is None:
            rows = [np.asarray(x, np.uint32) for x in self._encode(texts.to_pylist())]
            return np.concatenate(rows) if rows else np.zeros(0, np.uint32), np.array(list(map(len, rows)), np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids, counts = self._distinct(words.dictionary)
        runs = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()), pa.array(ids, pa.uint32())).take(words.indices)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
        return runs.flatten().to_numpy(), np.diff(runs.offsets.to_numpy()[bounds])

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in turn, how many each has)."""
        if len(self._marks) > MOST_MARKS:
            self._marks.clear()
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset).astype(np.int64) if len(pieces) else np.zeros(1, np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8).copy() if len(pieces) and offsets[-1] else np.zeros(0, np.uint8)
        starts, ends = offsets[:-1], offsets[1:]
        after = np.r_[np.uint8(0), data[:-1]] == 0xC3 if len(data) else np.zeros(0, bool)
        capital = ((data >= 65) & (data <= 90)) | (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
        letter = capital | ((data >= 97) & (data <= 122)) | ((data == 0xC3) & ~after) | (after & (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7))
        data[capital] += 32
        place = np.r_[np.where(SIGNS[data], 0, np.arange(len(data)) + 1), 0]  # after each byte that is no sign
        some = ends > starts
        stem_ends = starts.copy()
        if some.any():
            stem_ends[some] = np.maximum(np.maximum.reduceat(place, starts[some]), starts[some])
        wrong = np.r_[0, np.cumsum(~letter)]
        fit = (stem_ends > starts) & (wrong[stem_ends] == wrong[starts])
        rows, others = np.flatnonzero(fit), np.flatnonzero(~fit)
        lengths = stem_ends[rows] - starts[rows]
        of, stems, bounds = distinct_runs(data, starts[rows], lengths)
        stem_ids, stem_counts = self.merges.encode(stems, bounds[:-1], np.diff(bounds))
        tailed = rows[stem_ends[rows] < ends[rows]]
        tail_of, signs, bounds = distinct_runs(data, stem_ends[tailed], (ends - stem_ends)[tailed])
        tails = [signs[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        fresh = [x for x in tails if x not in self._marks]
        self._marks.update(zip(fresh, (np.asarray(x, np.uint32) for x in self._encode(fresh)), strict=True))
        marks = [self._marks[x] for x in tails]
        other_ids, other_counts = self._by_library(pieces.take(pa.array(others)).to_pylist())
        tail_counts = np.array(list(map(len, marks)), np.int64)
        # Stems, tails and others stand in one array; each piece is one run of it, but for those with a tail.
        counts = np.zeros(len(pieces), np.int64)
        counts[rows], counts[others] = stem_counts[of], other_counts
        firsts = np.cumsum(np.concatenate([[0], stem_counts, other_counts]))
        begin = np.zeros(len(pieces), np.int64)
        begin[rows], begin[others] = firsts[of], firsts[len(stem_counts) : -1]
        pool = np.concatenate([stem_ids, other_ids, *marks])
        tail_begin = firsts[-1] + np.cumsum(tail_counts) - tail_counts
        two = np.zeros((len(pieces), 2, 2), np.int64)  # start and count of each half
        two[:, 0, 0], two[:, 0, 1] = begin, counts
        two[tailed, 1, 0], two[tailed, 1, 1] = tail_begin[tail_of], tail_counts[tail_of]
        flat = two.reshape(-1, 2)
        return gather(pool, flat[:, 0], flat[:, 1]), two[:, :, 1].sum(1)

    def _by_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for many pieces: the library tells which piece each id is of."""
        all_ids, counts = [], []
        for lo in range(0, len(pieces), 20_000):
            part = pieces[lo : lo + 20_000]
            encoding = self._model.encode(part, is_pretokenized=True, add_special_tokens=False)
            all_ids.append(np.asarray(encoding.ids, np.uint32))
            counts.append(np.bincount(np.asarray(encoding.word_ids, np.int64), minlength=len(part)))
        return (np.concatenate(all_ids), np.concatenate(counts)) if pieces else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@functools.lru_cache(maxsize=2)
def shared_encoder(name: str) -> Encoder:
    """A worker's encoder, for all tasks that the worker runs."""
    return Encoder(name)


def drops_white_space(path: str) -> bool:
    """Whether the file describes a tokenizer whose pieces can be encoded one by one (see Encoder)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    pattern = str((splits[0].get("pattern") or {}).get("Regex", "")) if splits else ""
    normal = {x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])}
    return (
        bool(splits)
        and splits[0]["type"] == "Split"
        and splits[0].get("behavior") == "Removed"
        and splits[0].get("invert") is True
        and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and normal <= {"NFC", "Replace", "Lowercase"}
        and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in spec.get("added_tokens", []))
    )


def grouped(batches, column: str = "text", size: int = GROUP_BYTES):
    """Record batches gathered to tables of about the size (one at least), with the column as one array without nulls."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.column(column).nbytes
        if total >= size:
            yield _joined(held, column)
            held, total = [], 0
    if held:
        yield _joined(held, column)


def _joined(held: list[pa.RecordBatch], column: str) -> tuple[pa.Table, pa.Array]:
    t = pa.Table.from_batches(held)
    return t, pc.fill_null(t.column(column).cast(pa.string()), "").combine_chunks()
