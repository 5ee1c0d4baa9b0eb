"""SentencePiece encoding and decoding in batched numpy.

A text is cut into words where a space mark follows anything else (no piece spans such a place;
this is checked when the pieces are loaded).  Distinct words of equal length advance together:
the hash of a substring, from prefix sums, probes the sorted keys of the pieces.

* Unigram pieces: Viterbi.  Position by position, vectorised maxima over the pieces that end
  there give the best score and the backpointer.
* BPE pieces: Viterbi over BPE ranks does not give the encoding that such a model means, so the
  same batches take merge steps instead: each step a vectorised maximum picks every word's best
  (leftmost among equal) pair.  Words too long for a batch merge by a heap.

Characters without a piece fall back to byte pieces, or to the unknown piece where there are none.

Edge cases: null and empty texts give no tokens and decode to the empty text; any text decodes
to itself, except that U+2581 comes back as a space; special pieces are never produced from text;
rows that repeat are encoded one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import hashing

#: Where the public vocabulary files are unless a path is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of a word that is worked on in a batch, at most.
LONG = 48
NEVER = -np.inf


@dataclass
class Pieces:
    """A model's pieces: what text can become, and what each id stands for."""

    texts: list[str]
    scores: np.ndarray
    normal: np.ndarray
    bytes_of: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    bpe: bool = True

    def __post_init__(self) -> None:
        ids = np.flatnonzero(self.normal)
        for i in ids:
            inner = self.texts[i][1:]
            if MARK in inner and self.texts[i].strip(MARK):
                raise ValueError(f"piece {i} holds a space mark after another character")
        joined = [self.texts[i].encode() for i in ids]
        data = np.frombuffer(b"".join(joined), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in joined]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        keys = hashing.range_hash(hashing.prefix(data), starts, ends) if len(ids) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int64)
        self.key_scores = self.scores[self.ids].astype(np.float64)
        self.longest = max((len(self.texts[i]) for i in ids), default=1)
        # The bytes that each id decodes to.
        byte_value = self.bytes_of
        plain = [bytes([byte_value[i]]) if i in byte_value else (t.replace(MARK, " ").encode() if self.normal[i] else b"") for i, t in enumerate(self.texts)]
        self.plain = np.frombuffer(b"".join(plain) or b"\0", dtype=np.uint8)
        self.plain_end = np.cumsum([len(x) for x in plain]).astype(np.int64)
        self.plain_size = np.array([len(x) for x in plain], dtype=np.int64)
        table = np.full(256, self.unknown, dtype=np.int64)
        for i, b in byte_value.items():
            table[b] = i
        self.byte_ids = table if byte_value else None

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, score or -inf) for each substring hash."""
        if not len(self.keys):
            return np.full(hashes.shape, -1), np.full(hashes.shape, NEVER)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.ids[at], -1), np.where(hit, self.key_scores[at], NEVER)


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a model file on the driver; a model has some ten thousand pieces, so it can be sent to every task."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    other = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    bytes_of = {i: int(texts[i][3:5], 16) for i in range(n) if model.is_byte(i)}
    scores = np.array([model.get_score(i) for i in range(n)])
    # A BPE model's scores are minus its merge ranks: whole numbers.
    ranked = scores[~np.array(other)]
    return Pieces(texts, scores, ~np.array(other), bytes_of, model.unk_id(), bool((ranked == np.round(ranked)).all()))


class Encoder:
    """Encodes runs of texts; ``pieces`` is read only."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        if texts.null_count:
            texts = texts.fill_null("")
        filled = pc.greater(pc.binary_length(texts), 0)
        marked = pc.replace_substring(texts, " ", MARK)
        marked = pc.if_else(filled, pc.binary_join_element_wise(pa.scalar(MARK, marked.type), marked, pa.scalar("", marked.type)), marked)
        data, offsets = hashing.buffers(marked)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        n = len(data)
        mark = np.zeros(n + 3, dtype=bool)
        mark[3 : n + 1] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)  # moved by 3
        begin = mark[3:][:n] & ~mark[:n]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin).astype(np.int64)
        ends = np.append(starts[1:], n).astype(np.int64)
        pre = hashing.prefix(data)
        _, at, inverse = np.unique(hashing.range_hash(pre, starts, ends), return_index=True, return_inverse=True)
        ids, sizes = self._words(data, pre, starts[at], ends[at])
        first = np.concatenate([[0], np.cumsum(sizes)])
        counts = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        out = ids[np.repeat(first[inverse] - total[:-1], counts) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, offsets)]

    def _words(self, data: np.ndarray, pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, one after the other, and their counts."""
        lead = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(lead)])
        places = np.append(np.flatnonzero(lead), len(data)).astype(np.int64)
        length = chars[ends] - chars[starts]
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, order of its tokens, id
        work = self._merge if self.pieces.bpe else self._viterbi
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            if size > LONG:
                for w in own:
                    bounds = places[chars[starts[w]] : chars[starts[w]] + size + 1]
                    one = self._merge_long(pre, bounds) if self.pieces.bpe else self._viterbi(pre, bounds[None, :])
                    rows.append(self._emit_all(data, pre, np.array([w]), one))
                continue
            for k in range(0, len(own), 1 << 16):
                part = own[k : k + (1 << 16)]
                bounds = places[chars[starts[part]][:, None] + np.arange(size + 1)]
                rows.append(self._emit_all(data, pre, part, work(pre, bounds)))
        word = np.concatenate([r[0] for r in rows])
        place = np.concatenate([r[1] for r in rows])
        ids = np.concatenate([r[2] for r in rows])
        order = np.lexsort((place, word))
        return ids[order], np.bincount(word, minlength=len(starts))

    def _emit_all(self, data, pre, words, results):
        parts = [self._emit(data, pre, words[rows], s, e) for rows, s, e in results]
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    def _emit(self, data: np.ndarray, pre: np.ndarray, words: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens [s, e) of words (a row each, -1 for none) as (word, order, id), with byte fallback."""
        there = s >= 0
        word = np.repeat(words, there.sum(axis=1))
        s, e = s[there], e[there]
        ids, _ = self.pieces.probe(hashing.range_hash(pre, s, e))
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return word, s, ids
        kept = np.flatnonzero(ids >= 0)
        if self.pieces.byte_ids is None:
            ids[missing] = self.pieces.unknown
            return word, s, ids
        size = (e - s)[missing]
        at = np.repeat(s[missing] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.concatenate([word[kept], np.repeat(word[missing], size)]), np.concatenate([s[kept], at]), np.concatenate([ids[kept], self.pieces.byte_ids[data[at]]])

    def _merge(self, pre: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge steps for words of one length; ``bounds`` are the places of their characters."""
        rows = np.arange(len(bounds))
        score = self.pieces.probe(hashing.range_hash(pre, bounds[:, :-2], bounds[:, 2:]))[1] if bounds.shape[1] > 2 else np.zeros((len(bounds), 0))
        out = []
        while len(rows):
            width = bounds.shape[1] - 1
            if width < 2:
                out.append((rows, bounds[:, :-1], bounds[:, 1:]))
                break
            best = score.argmax(axis=1)
            over = score[np.arange(len(rows)), best] == NEVER
            if over.any():
                out.append((rows[over], bounds[over, :-1], bounds[over, 1:]))
                rows, bounds, score, best = rows[~over], bounds[~over], score[~over], best[~over]
                if not len(rows):
                    break
            # Tokens best and best + 1 become one: the bound between them goes.
            take = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            bounds = np.take_along_axis(bounds, take, axis=1)
            if width > 2:
                take = np.arange(width - 2)[None, :]
                score = np.take_along_axis(score, take + (take >= best[:, None]), axis=1)
                line = np.arange(len(rows))
                for beside in (best - 1, best):
                    ok = (beside >= 0) & (beside < width - 2)
                    r, c = line[ok], beside[ok]
                    score[r, c] = self.pieces.probe(hashing.range_hash(pre, bounds[r, c], bounds[r, c + 2]))[1]
        return out

    def _merge_long(self, pre: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for one long word: the best pair from a heap."""
        n = len(bounds) - 1
        start, end = bounds[:-1].tolist(), bounds[1:].tolist()
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n

        def scores(left: list[int], right: list[int]) -> list[float]:
            s, e = np.array([start[i] for i in left]), np.array([end[i] for i in right])
            return self.pieces.probe(hashing.range_hash(pre, s, e))[1].tolist()

        first = self.pieces.probe(hashing.range_hash(pre, bounds[:-2], bounds[2:]))[1] if n > 1 else np.zeros(0)
        heap = [(-s, i, i + 1, end[i + 1] - start[i]) for i, s in enumerate(first.tolist()) if s != NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not alive[i] or not alive[j] or after[i] != j or end[j] - start[i] != size:
                continue
            end[i], alive[j], after[i] = end[j], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            pairs = [(a, b) for a, b in ((before[i], i), (i, after[i])) if a >= 0 and b >= 0]
            if pairs:
                for (a, b), s in zip(pairs, scores([a for a, _ in pairs], [b for _, b in pairs]), strict=True):
                    if s != NEVER:
                        heapq.heappush(heap, (-s, a, b, end[b] - start[a]))
        kept = [i for i in range(n) if alive[i]]
        return [(np.zeros(1, np.int64), np.array([[start[i] for i in kept]]), np.array([[end[i] for i in kept]]))]

    def _viterbi(self, pre: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Best segmentation of words of one length by the sum of scores; characters without a piece cost 10 below the worst piece."""
        n, size = len(bounds), bounds.shape[1] - 1
        poor = float(self.pieces.key_scores.min(initial=0.0)) - 10.0
        best = np.full((n, size + 1), NEVER)
        best[:, 0] = 0.0
        back = np.zeros((n, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.pieces.longest), end):
                s = self.pieces.probe(hashing.range_hash(pre, bounds[:, start], bounds[:, end]))[1]
                if end - start == 1:
                    s = np.where(s == NEVER, poor, s)
                total = best[:, start] + s
                more = total > best[:, end]
                best[more, end], back[more, end] = total[more], start
        s = np.full((n, size), -1, dtype=np.int64)
        e = np.full((n, size), -1, dtype=np.int64)
        at = np.full(n, size)
        line = np.arange(n)
        for k in range(size - 1, -1, -1):
            on = at > 0
            r = line[on]
            e[r, k] = bounds[r, at[on]]
            at[on] = back[r, at[on]]
            s[r, k] = bounds[r, at[on]]
        return [(line, s, e)]


def decode(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The text of each run of ids, without the space that encoding puts in front."""
    size = pieces.plain_size[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    data = pieces.plain[np.repeat(pieces.plain_end[ids] - size - total[:-1], size) + np.arange(total[-1])].tobytes()
    at = total[offsets].tolist()
    return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode_documents(documents: DataFrame, pieces: Pieces | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then n_tokens, ids, text_sha256 (of the decoded text) and round_trip (it is the text, U+2581 read as a space)."""
    if clash := {"n_tokens", "ids", "text_sha256", "round_trip"} & set(keep):
        raise ValueError(f"keep names output columns: {sorted(clash)}")
    shared = documents.sparkSession.sparkContext.broadcast(pieces or load_pieces())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        encoder = Encoder(own)
        for batch in batches:
            column = batch.column("text_")
            _, offsets = hashing.buffers(column)
            for a, b in hashing.chunks(offsets):
                texts = column.slice(a, b - a)
                ids, first = encoder.encode(texts)
                back = decode(own, ids, first)
                same = [(t or "").replace(MARK, " ").encode() == x for t, x in zip(texts.to_pylist(), back, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in keep], pa.array(np.diff(first), pa.int64()), lists, pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array(same)],
                    names=[*keep, "n_tokens", "ids", "text_sha256", "round_trip"],
                )

    texts = documents.select(*keep, F.col("text").cast("string").alias("text_"))
    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids array<int>, text_sha256 string, round_trip boolean")
