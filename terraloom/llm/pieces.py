"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and scores come from a BPE model file (never trained here).  A
text is cut into chunks that no merge can cross; in a chunk the candidate
merges form an agenda, best score first.  Every candidate that comes up, in
every occurrence of a chunk, is skipped for good with probability ``dropout``,
by a keyed hash of seed, document, copy number, place and number of the
candidate: the hash gives how many candidates go by until the next skip, as
independent draws would.  What a chunk becomes depends only on which of its
candidates are skipped, so that a task may remember (bounded) the pieces for a
chunk and its skips, as a cache that changes no result.  All occurrences of a
batch are drawn for in one pass of arrays, round by round: only those whose
next skip falls on a candidate that comes up go on, and their agendas are worked
off side by side.  Long chunks, and those with characters outside the
vocabulary, are worked off one by one, each in one pass over its own skips.
With ``dropout`` 0 the pieces are those of the model itself.

A space becomes U+2581, and one is put in front of a text that isn't empty.
Characters outside the vocabulary, and U+2581 itself, become byte pieces, so
decoding gives back exactly the text that was encoded.

Null texts have null pieces (``ids``) and 0 tokens, empty texts none.  Null
document ids count as one document.  Repeated rows get equal pieces unless a
column numbers the copies.  Other
columns are ignored.  Whole texts are encoded; nothing is shuffled.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import table

MODEL_PATH, DROPOUT, SEED = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 11
SPACE = "▁"
MEMORY = 200_000  # remembered chunks, and twice as many chunks with skips, about 80 MB; then a task starts anew, as it does at its end
FAR = 1 << 40  # beyond any number of candidates
MASK, NONE, LONG = (1 << 64) - 1, 1 << 60, 40
CHUNKS = 250_000  # occurrences of a batch that are in arrays at once


class Codec:
    """Encoder and decoder for one model file, dropout and seed; ``variants`` no longer bounds anything."""

    def __init__(self, model_path: str, dropout: float = DROPOUT, seed: int = SEED, variants: int = 0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        by_name = {p: i for i, p in enumerate(self.pieces)}
        self.bytes = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        self.decoded = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        levels = {x: n for n, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = levels[self.scores[p]] << 32 | i
        self.pairs = np.array(sorted(found), np.int64)
        self.merges = np.array([found[k] for k in sorted(found)], np.int64)
        self.char_ids = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "\n" if not any("\n" in p for p in self.ids) else ""
        self.chunk = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|\n+")
        self.dropout, self.seed = dropout, seed
        self.kind = np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered.

        A state is a chunk with its skips.  Chunks have their state without skips
        in ``index`` (-1: to be worked off one by one), and ``child`` leads from a
        state and the candidate skipped next to the state with that skip, too.
        """
        self.index: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.chunks: list[str] = []
        self.n_states = 0
        # of each state: number of its chunk, skips as bits in two words, candidates that come up, where its pieces are
        self.chunk_of, self.low, self.high = np.zeros(1024, np.int32), np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.came, self.first, self.size = np.zeros(1024, np.int16), np.zeros(1024, np.int64), np.zeros(1024, np.int16)
        self.pool, self.pooled = np.zeros(4096, self.kind), 0

    def _add(self, chunk_of: np.ndarray, low: np.ndarray, high: np.ndarray, came: np.ndarray, size: np.ndarray, flat: np.ndarray) -> int:
        """New states; gives the number of the first."""
        at, to = self.n_states, self.n_states + len(size)
        while to > len(self.came):
            for name in ("chunk_of", "low", "high", "came", "first", "size"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.chunk_of[at:to], self.low[at:to], self.high[at:to], self.came[at:to], self.size[at:to] = chunk_of, low, high, came, size
        self.first[at:to] = self.pooled + np.cumsum(size) - size
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self.n_states, self.pooled = to, self.pooled + len(flat)
        return at

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Level and piece of the merge of two pieces, as one number; NONE if there is none."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merges[at], NONE)

    def _segment_many(self, chunks: list[str], skips: list[int]) -> list[bytes]:
        """Packed pieces of many chunks; bit n of a chunk's skips: the n-th candidate that comes up is skipped."""
        plain = self._plain(chunks)
        out = [b"" if ok else array(self.code, self._segment(c, s)).tobytes() for c, s, ok in zip(chunks, skips, plain)]
        rows = np.flatnonzero(plain)
        low, high = (np.array([skips[i] >> at & MASK for i in rows], np.uint64) for at in (0, 64))
        order, flat, sizes, _ = self._work_off([chunks[i] for i in rows], low, high)
        for i, x in zip(rows[order].tolist(), np.split(flat, np.cumsum(sizes)[:-1]) if len(rows) else []):
            out[i] = x.tobytes()
        return out

    def _plain(self, chunks: list[str]) -> np.ndarray:
        """True for the chunks that can be worked off side by side."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        strange = np.append(0, np.cumsum(self.char_ids[codes] < 0))
        ends = np.cumsum(lengths)
        return (lengths <= LONG) & (strange[ends] == strange[ends - lengths])

    def _work_off(self, chunks: list[str], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of many chunks, whose agendas are worked off side by side, as they get done: order, pieces, their numbers, numbers of candidates.

        Chunks of like length form a matrix; in every round each chunk takes
        the best candidate of its agenda, which is skipped or merged.
        """
        order, flats, sizes, cames = [np.zeros(0, np.int64)], [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        every = self.char_ids[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(lengths) - lengths
        shortest = 0
        for longest in (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, LONG):
            rows = np.flatnonzero((lengths > shortest) & (lengths <= longest))
            shortest = longest
            if not len(rows):
                continue
            cols = np.arange(longest)
            inside = cols < lengths[rows][:, None]
            ids = np.where(inside, every[np.minimum(starts[rows][:, None] + cols, len(every) - 1)], -1)
            words = low[rows], high[rows]
            some = bool((words[0] | words[1]).any())
            came = 0
            agenda = np.full(ids.shape, NONE, np.int64)
            agenda[:, :-1] = np.where(inside[:, 1:], self._look_up(ids[:, :-1], np.maximum(ids[:, 1:], 0)), NONE)
            while len(rows):
                best = agenda.argmin(axis=1)
                at = np.arange(len(rows))
                top = agenda[at, best]
                done = top == NONE
                if done.any():
                    kept = ids[done]
                    order.append(rows[done])
                    flats.append(kept[kept >= 0].astype(self.kind))
                    sizes.append((kept >= 0).sum(axis=1))
                    cames.append(np.full(len(kept), came))
                    go = ~done
                    rows, ids, agenda, best, top, words = rows[go], ids[go], agenda[go], best[go], top[go], (words[0][go], words[1][go])
                    at = at[: len(rows)]
                if not len(rows):
                    break
                m = at
                if some and came < 128:
                    skip = words[came >> 6] >> np.uint64(came & 63) & np.uint64(1) == 1
                    if skip.any():
                        agenda[at[skip], best[skip]] = NONE
                        m = np.flatnonzero(~skip)
                came += 1
                b, new = best[m], top[m] & 0xFFFFFFFF
                source = np.minimum(cols + (cols > b[:, None]), longest - 1) + m[:, None] * longest
                for x in (agenda, ids):
                    x[m] = x.ravel()[source]
                ids[m, -1] = -1
                agenda[m, -1] = NONE
                ids[m, b] = new
                right = np.minimum(b + 1, longest - 1)
                has = (b + 1 < longest) & (ids[m, right] >= 0)
                agenda[m, b] = NONE
                agenda[m[has], b[has]] = self._look_up(new[has], ids[m[has], right[has]])
                has = b > 0
                agenda[m[has], b[has] - 1] = self._look_up(ids[m[has], b[has] - 1], new[has])
        return np.concatenate(order), np.concatenate(flats), np.concatenate(sizes), np.concatenate(cames)

    def _segment(self, chunk: str, skips: int) -> list[int]:
        """Piece ids of a chunk by its agenda of merges."""
        return self._segment_counted(chunk, skips)[0]

    def _segment_counted(self, chunk: str, skips: int) -> tuple[list[int], int]:
        return self._agenda(chunk, (n for n in range(skips.bit_length()) if skips >> n & 1))

    def _agenda(self, chunk: str, skipped: Iterator[int]) -> tuple[list[int], int]:
        """Piece ids of a chunk, and how many candidates came up; the numbers of the skipped ones are taken as they are needed."""
        scores, ids, came, skip = self.scores, self.ids, 0, next(skipped, -1)
        n = len(chunk)
        symbols: list[str | None] = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            score = scores.get(both)
            if score is not None:
                agenda.append((-score, i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(both) or left + symbols[j] != both:
                continue  # one side has changed meanwhile
            came += 1
            if skip == came - 1:
                skip = next(skipped, -1)
                continue
            symbols[i], symbols[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                more = both + symbols[k]
                score = scores.get(more)
                if score is not None:
                    heapq.heappush(agenda, (-score, i, more))
            h = before[i]
            if h >= 0:
                more = symbols[h] + both
                score = scores.get(more)
                if score is not None:
                    heapq.heappush(agenda, (-score, h, more))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            found = ids.get(s)
            if found is None:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(found)
        return out, came

    def _chunks(self, text: str) -> tuple[list[str], list[int]]:
        """Chunks of a text, and which of them are a literal U+2581."""
        chunks: list[str] = []
        literal = []
        for n, part in enumerate(text.split(SPACE) if SPACE in text else (text,)):
            if n:
                literal.append(len(chunks))
                chunks.append(SPACE)
            chunks += self.chunk.findall((part if n else " " + part).replace(" ", SPACE))
        return chunks, literal

    def _draw(self, own: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
        """How many candidates go by until the next skip, for occurrences named by a number: geometric, by a keyed hash."""
        if not self.dropout:
            return np.full(len(own), FAR)
        steps = (np.atleast_1d(turn).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (own + steps) ^ np.uint64(self.seed * 0xC2B2AE3D27D4EB4F & MASK)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        if self.dropout >= 1:
            return np.zeros(len(own), np.int64)
        uniform = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        return np.minimum(np.log(uniform) / np.log1p(-self.dropout), FAR).astype(np.int64)

    def _skips_of(self, own: int, gaps: list[int]) -> Iterator[int]:
        """All skips of one occurrence, drawn some at a time; ``gaps`` are its first draws."""
        at, turn = -1, 0
        while at < FAR:
            for gap in gaps:
                at += 1 + gap
                yield at
            turn += len(gaps)
            gaps = self._draw(np.full(256, own, np.uint64), np.arange(turn, turn + 256)).tolist()

    def _occurrences(self, every: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all chunks in a row, and how many each has; ``own`` names the occurrences for the draws."""
        index, child = self.index, self.child
        new = list(set(every).difference(index))
        if new:
            plain = self._plain(new)
            index.update((new[i], -1) for i in np.flatnonzero(~plain).tolist())
            new = [new[i] for i in np.flatnonzero(plain).tolist()]
            none = np.zeros(len(new), np.uint64)
            order, flat, sizes, came = self._work_off(new, none, none)
            at = self._add(order + len(self.chunks), none, none, came, sizes, flat)
            self.chunks += new
            index.update(zip(map(new.__getitem__, order.tolist()), range(at, self.n_states)))
        state = np.fromiter(map(index.__getitem__, every), np.int64, len(every))
        alone = np.flatnonzero(state < 0)
        # round by round: occurrences whose next skip falls on a candidate that comes up get one skip more
        at = self._draw(own, 0)
        open_ = np.flatnonzero((at < self.came[state]) & (state >= 0))
        at, turn = at[open_], 0
        while len(open_):
            turn += 1
            key, back = np.unique(state[open_] << 7 | at, return_inverse=True)
            found = np.fromiter((child.get(k, -1) for k in key.tolist()), np.int64, len(key))
            missing = np.flatnonzero(found < 0)
            if len(missing):
                parent, skip = key[missing] >> 7, (key[missing] & 127).astype(np.uint64)
                bit = np.uint64(1) << (skip & np.uint64(63))
                low, high = self.low[parent] | np.where(skip < 64, bit, np.uint64(0)), self.high[parent] | np.where(skip < 64, np.uint64(0), bit)
                chunk = self.chunk_of[parent]
                order, flat, sizes, came = self._work_off(list(map(self.chunks.__getitem__, chunk.tolist())), low, high)
                first = self._add(chunk[order], low[order], high[order], came, sizes, flat)
                found[missing[order]] = np.arange(first, self.n_states)
                child.update(zip(key[missing].tolist(), found[missing].tolist()))
            state[open_] = found[back]
            at = at + 1 + self._draw(own[open_], turn)
            go = at < self.came[state[open_]]
            open_, at = open_[go], at[go]
        sizes = np.where(state < 0, 0, self.size[state]).astype(np.int64)
        one_by_one = {}
        gaps = self._draw(np.repeat(own[alone], 4), np.tile(np.arange(4), len(alone))).reshape(-1, 4).tolist()
        for i, drawn in zip(alone.tolist(), gaps):
            one_by_one[i] = np.array(self._agenda(every[i], self._skips_of(int(own[i]), drawn))[0], self.kind)
            sizes[i] = len(one_by_one[i])
        ends = np.cumsum(sizes)
        known = sizes if not len(alone) else np.where(state < 0, 0, sizes)
        out = np.zeros(int(ends[-1]), self.kind)
        shift = np.repeat(self.first[state] - (np.cumsum(known) - known), known)
        pieces = self.pool[shift + np.arange(len(shift))]
        if len(alone):
            out[np.repeat(state >= 0, sizes)] = pieces
            for i, x in one_by_one.items():
                out[ends[i] - len(x) : ends[i]] = x
        else:
            out = pieces
        if len(self.chunks) > MEMORY or len(child) > 2 * MEMORY or len(index) > 2 * MEMORY:
            self.forget()
        return out, sizes

    def encode_many(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; its key names the document, and with the seed decides the draws."""
        cut = [self._chunks(t) if t else ([], []) for t in texts]
        n_chunks = np.array([len(c) for c, _ in cut], np.int64)
        every = [c for chunks, _ in cut for c in chunks]
        literal = np.array([first + i for first, (_, own) in zip((np.cumsum(n_chunks) - n_chunks).tolist(), cut) for i in own], np.int64)
        del cut
        if not every:
            return [np.zeros(0, self.kind) for _ in texts]
        place = np.concatenate([np.arange(n, dtype=np.uint64) for n in n_chunks.tolist()])
        named = np.array([k & MASK for k in keys], np.uint64)
        named = (named ^ (named >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        own = np.repeat(named ^ (named >> np.uint64(29)), n_chunks) + place * np.uint64(0xA0761D6478BD642F)
        parts = [self._occurrences(every[at : at + CHUNKS], own[at : at + CHUNKS]) for at in range(0, len(every), CHUNKS)]
        flat, sizes = (np.concatenate(x) for x in zip(*parts))
        del parts, place
        if len(literal):
            # a U+2581 of the text itself becomes its bytes
            mark = np.array([self.bytes[b] for b in SPACE.encode()], self.kind)
            ends = np.cumsum(sizes)
            pieces, before = [], 0
            for i in literal.tolist():
                pieces += [flat[before : ends[i] - sizes[i]], mark]
                before = ends[i]
            flat = np.concatenate([*pieces, flat[before:]])
            sizes[literal] = len(mark)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n_chunks))]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.decoded.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def codec(model_path: str, dropout: float, seed: int) -> Codec:
    """One codec for all batches that a worker process sees."""
    return Codec(model_path, dropout, seed)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, lossless (the pieces decode to the text) of every row.

    ``copy_col`` numbers the copies of a document, from 0; each has draws of its own.

    ``model_path`` must be readable on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, dropout, seed)
        for batch in batches:
            doc_ids, texts, copies = (batch.column(c).to_pylist() for c in ("doc_id", "text", "copy"))
            at = 0
            while at < len(texts):
                first = at
                size = 0
                while at < len(texts) and size < 2_000_000:
                    size += len(texts[at] or "")
                    at += 1
                part = [t or "" for t in texts[first:at]]
                gc.disable()  # millions of tuples, none in a cycle
                found = own.encode_many(part, [(d or 0) * 0x5851F42D4C957F2D + (n or 0) * 0xD1342543DE82EF95 for d, n in zip(doc_ids[first:at], copies[first:at])])
                gc.enable()
                same = [own.decode(f.tolist()) == t for f, t in zip(found, part)]
                cuts = np.append(0, np.cumsum([len(f) for f in found]))
                missing = np.array([t is None for t in texts[first:at]])
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at - first), pa.array(np.diff(cuts), pa.int64()), ids, pa.array(same)], ["doc_id", "n_tokens", "ids", "lossless"])
        own.forget()

    copy = docs[copy_col].cast("long") if copy_col else F.lit(0).cast("long")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), copy.alias("copy"))
    return own.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def encode_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` with draws of its own for every copy of a row; rows are shuffled by id and text, so many rows without id spread."""
    same = Window.partitionBy("id", F.xxhash64("text")).orderBy("text")
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return encode_documents(own.withColumn("copy", F.row_number().over(same) - 1), "id", copy_col="copy")


def decode_documents(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with the text of its pieces as ``out_col``."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path, 0.0, 0)
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else own.decode(ids))

    return encoded.withColumn(out_col, decode(encoded[ids_col]))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
