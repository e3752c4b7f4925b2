"""Exact removal of repeated 13-word passages by difference-cover anchors.

Two equal windows of 13 words start at any positions i and j of their documents.
With the period 7 and its difference cover {0, 1, 3} there is always a shift
d < 7 with (i + d) mod 7 and (j + d) mod 7 both in the cover, so both windows
hold the same 7-word anchor at the same shift.  Three positions in seven are
hashed instead of all:

1. Anchors are dealt into hash blocks, where those that stand in two documents
   or more are found and reported back to their documents.
2. In the documents each such anchor is extended to the windows around it.
   Only these windows are hashed, and dealt into hash blocks again, where the
   smallest document of each window is found.
3. Windows with a smaller document are reported back, and their words go.

Before each deal a batch of documents is combined: what repeats inside the
batch is known at once, and each anchor or window sends one document's entries
only.  So a passage in a third of all documents sends one entry per batch.
Entries are dealt as arrays, the number of blocks follows the input partitions.
Texts are shuffled once and used twice (Spark reuses that exchange).

A window is known by a 64-bit hash inside a block that another hash chose.

Null and empty texts have no words and the digest of the empty string.  Null
ids neither remove nor lose words.  Repeated rows of one id are judged each
against smaller ids only.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import blocks_for, table

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
U64 = np.uint64

ENTRIES = "bucket int, known boolean, doc_id array<long>, row array<long>, block array<int>, n array<int>, pos array<int>, hash array<long>"
FOUND = "block int, doc_id array<long>, row array<long>, n array<int>, pos array<int>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Finaliser of a 64-bit hash, different for each salt."""
    h = h ^ U64(salt)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= U64(base)
        h += words[k : k + n]
    return h


class _Texts:
    """Words of a batch of documents, hashed and strung together."""

    def __init__(self, texts: list[str | None], skip: np.ndarray | None = None):
        digest = xxhash.xxh3_64_intdigest
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = np.fromiter((digest(w) for ws in self.words for w in ws), U64, int(self.starts[-1]))
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.pos = np.arange(len(self.hashes)) - self.starts[self.doc]
        self.left = self.counts[self.doc] - self.pos  # words from here to the document's end
        if skip is not None and len(self.doc):
            self.left = np.where(skip[self.doc], 0, self.left)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _runs(doc: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run-length form of ``doc`` where runs also end at ``cuts``: first of each run, length, cuts among the runs."""
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    inner = cuts[cuts < len(doc)]
    fresh[inner] = True
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(doc))), np.searchsorted(first, cuts)


def _deal(key: np.ndarray, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, doc_id, row, block, known: bool) -> pa.RecordBatch:
    """Entries as one row per key, in order of document and position inside it."""
    order = np.lexsort((pos, doc, key))
    key, h, doc, pos = key[order], h[order], doc[order], pos[order]
    keys, cuts = np.unique(key, return_index=True)
    cuts = np.append(cuts, len(key))
    first, n, run_cuts = _runs(doc, cuts)
    d = doc[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int32()),
            pa.array(np.full(len(keys), known)),
            _lists(doc_id[d], run_cuts, pa.int64()),
            _lists(row[d], run_cuts, pa.int64()),
            _lists(block[d], run_cuts, pa.int32()),
            _lists(n, run_cuts, pa.int32()),
            _lists(pos, cuts, pa.int32()),
            _lists(h.view(np.int64) if not known else np.zeros(0, np.int64), cuts if not known else np.zeros(len(cuts), np.int32), pa.int64()),
        ],
        ["bucket", "known", "doc_id", "row", "block", "n", "pos", "hash"],
    )


def _combine(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, any_id: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices to send and indices known to repeat, from the entries of one batch.

    any_id: an entry repeats if its hash stands in another document (anchors);
    else if it stands in one with a smaller id (windows).  Only the document of
    the smallest id sends; an anchor known to repeat sends one entry as a sign.
    """
    order = np.lexsort((pos, doc, ids[doc], h))
    hs, who = h[order], ids[doc[order]]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    later = who != who[starts][group]
    if not any_id:
        return order[~later], order[later]
    shared = np.zeros(len(starts), bool)
    shared[group[later]] = True
    in_shared = shared[group]
    return order[~in_shared | new], order[in_shared]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc_id, row, block, pos, hash of every entry in rows of ENTRIES."""
    get = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    n = get("n")
    return np.repeat(get("doc_id"), n), np.repeat(get("row"), n), np.repeat(get("block"), n), get("pos"), get("hash")


def _report(doc_id, row, block, pos) -> pa.RecordBatch:
    """Entries as rows of FOUND, one per block of documents."""
    order = np.lexsort((pos, row, doc_id, block))
    doc_id, row, block, pos = doc_id[order], row[order], block[order], pos[order]
    blocks, cuts = np.unique(block, return_index=True)
    cuts = np.append(cuts, len(block))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (doc_id[1:] != doc_id[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(fresh)
    n, run_cuts = np.diff(np.append(first, len(row))), np.searchsorted(first, cuts)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), _lists(doc_id[first], run_cuts, pa.int64()), _lists(row[first], run_cuts, pa.int64()), _lists(n, run_cuts, pa.int32()), _lists(pos, cuts, pa.int32())],
        ["block", "doc_id", "row", "n", "pos"],
    )


def _judge(any_id: bool):
    """Group function over a hash block: reports the entries that repeat."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.filter(batch.column("known"))
            if known.num_rows:
                yield _report(*_flat(known)[:4])
            fresh = batch.filter(pa.compute.invert(batch.column("known")))
            if fresh.num_rows:
                held.append(_flat(fresh))
        if not held:
            return
        doc_id, row, block, pos, h = (np.concatenate(x) for x in zip(*held))
        del held
        order = np.lexsort((doc_id, h))
        hs, who = h[order], doc_id[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        later = who != who[starts][group]
        if any_id:
            shared = np.zeros(len(starts), bool)
            shared[group[later]] = True
            later = shared[group]
        hit = order[later]
        if len(hit):
            yield _report(doc_id[hit], row[hit], block[hit], pos[hit])

    return judge


def _send(texts: _Texts, at: np.ndarray, h: np.ndarray, bucket: np.ndarray, ids, row, block, any_id: bool, blocks: int) -> Iterator[pa.RecordBatch]:
    doc, pos = texts.doc[at], texts.pos[at]
    out, known = _combine(h, doc, pos, ids, any_id)
    if len(out):
        yield _deal(bucket[out], h[out], doc[out], pos[out], ids, row, block, False)
    if len(known):
        # already judged: any block may hand these on, so the documents' own blocks spread them
        yield _deal(block[doc[known]] % blocks, h[known], doc[known], pos[known], ids, row, block, True)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _pieces(texts: list, most: int = 1 << 24) -> Iterator[slice]:
    """Slices of a batch with about ``most`` characters each, one document at least."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _anchors(blocks: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_null = _ids(batch.column("doc_id"))
            all_row, all_block, all_texts = batch.column("row").to_numpy(), batch.column("block").to_numpy(), batch.column("text").to_pylist()
            for part in _pieces(all_texts):
                texts = _Texts(all_texts[part], all_null[part])
                h = _rolling(texts.hashes, ANCHOR, 0x9E3779B97F4A7C15)
                if not len(h):
                    continue
                n = len(h)
                at = np.flatnonzero(np.isin(texts.pos[:n] % PERIOD, COVER) & (texts.left[:n] >= ANCHOR) & (texts.counts[texts.doc[:n]] >= WINDOW))
                full = _mix(h[at], 1)
                bucket = ((full >> U64(32)) % U64(blocks)).astype(np.int32)
                yield from _send(texts, at, full & U64(0xFFFFFFFF), bucket, all_ids[part], all_row[part], all_block[part], True, blocks)

    return anchors


def _marks(texts: _Texts, doc_id: np.ndarray, row: np.ndarray, found: pa.Table) -> np.ndarray:
    """True at the words whose position was reported for their document."""
    mark = np.zeros(len(texts.hashes), bool)
    if not found.num_rows:
        return mark
    get = lambda name: found.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids, rows, n, pos = get("doc_id"), get("row"), get("n"), get("pos")
    cuts = np.append(0, np.cumsum(n))
    own: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(ids.tolist(), rows.tolist())):
        own.setdefault(key, []).append(i)
    for k, key in enumerate(zip(doc_id.tolist(), row.tolist())):
        for i in own.get(key, ()):
            mark[texts.starts[k] + pos[cuts[i] : cuts[i + 1]]] = True
    return mark


def _reach(mark: np.ndarray, width: int) -> np.ndarray:
    """True where one of the ``width`` places from here on is marked."""
    total = np.append(0, np.cumsum(mark))
    return total[np.minimum(np.arange(len(mark)) + width, len(mark))] > total[:-1]


def _windows(blocks: int):
    def windows(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        all_ids, all_null = _ids(docs.column("doc_id").combine_chunks())
        all_row, all_block, all_texts = docs.column("row").to_numpy(), docs.column("block").to_numpy(), docs.column("text").to_pylist()
        for part in _pieces(all_texts if found.num_rows else []):
            ids, row = all_ids[part], all_row[part]
            texts = _Texts(all_texts[part], all_null[part])
            near = _reach(_marks(texts, ids, row, found), PERIOD)
            h = _rolling(texts.hashes, WINDOW, 0xD6E8FEB86659FD93)
            n = len(h)
            at = np.flatnonzero(near[:n] & (texts.left[:n] >= WINDOW))
            if len(at):
                other = _rolling(texts.hashes, WINDOW, 0xA0761D6478BD642F)[at]
                bucket = (_mix(other, 2) % U64(blocks)).astype(np.int32)
                out += _send(texts, at, _mix(h[at], 3), bucket, ids, row, all_block[part], False, blocks)
        return pa.Table.from_batches(out) if out else _empty(ENTRIES)

    return windows


def _empty(ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))]).empty_table()


def _finish(with_text: bool):
    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        all_ids, all_null = _ids(docs.column("doc_id").combine_chunks())
        all_row, all_texts = docs.column("row").to_numpy(), docs.column("text").to_pylist()
        ids, n_words, n_removed, sha, kept = [], [], [], [], []
        for part in _pieces(all_texts):
            texts = _Texts.__new__(_Texts)
            texts.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in all_texts[part]]
            texts.counts = np.array([len(w) for w in texts.words], np.int64)
            texts.starts = np.concatenate([[0], np.cumsum(texts.counts)])
            texts.hashes = np.zeros(int(texts.starts[-1]), bool)
            starts = _marks(texts, all_ids[part], all_row[part], found)
            step = np.zeros(len(starts) + WINDOW, np.int64)
            step[: len(starts)] += starts
            step[WINDOW:] -= starts
            gone = np.cumsum(step)[: len(starts)] > 0
            for k, words in enumerate(texts.words):
                cut = gone[texts.starts[k] : texts.starts[k + 1]]
                if cut.any():
                    words = [w for w, c in zip(words, cut.tolist()) if not c]
                joined = b" ".join(words)
                ids.append(None if all_null[part][k] else int(all_ids[part][k]))
                n_words.append(len(cut))
                n_removed.append(len(cut) - len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "surrogatepass") if with_text else None)
        arrays = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.table([*arrays, pa.array(kept, pa.string())], [*names, "kept"]) if with_text else pa.table(arrays, names)

    return finish


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; ``with_text`` adds the kept words as ``kept``."""
    blocks = blocks_for(docs)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    own = own.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod(F.col("row"), F.lit(blocks)).cast("int"))
    shared = own.mapInArrow(_anchors(blocks), ENTRIES).groupBy("bucket").applyInArrow(_judge(True), FOUND)
    repeated = own.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_windows(blocks), ENTRIES).groupBy("bucket").applyInArrow(_judge(False), FOUND)
    schema = RESULT if with_text else RESULT.rpartition(",")[0]
    return own.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_finish(with_text), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM docs
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts
), firsts AS (
  SELECT s, min(doc_id) AS d FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT w.r, w.i + k AS i FROM windows w JOIN firsts f USING (s), range(0, 13) t(k) WHERE w.doc_id > f.d
), lost AS (
  SELECT r, list(i) AS g FROM gone GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(g, i)], ' ') END, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r)
"""
