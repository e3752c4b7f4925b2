"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments.
The Manhattan distance of two embeddings is never above the Hamming distance of
the fingerprints, so the grid cells of the embedding serve as a range join:
two fingerprints within 3 bits have embeddings within 3, hence a half of the
embedding (16 segments) that differs by 1 at most.  Each fingerprint looks up,
for either half, its own cell and the cells one step up in one segment; what
it meets is tested for Manhattan distance, then for the exact Hamming distance.
The counts are kept in unary (0 -> 00, 1 -> 01, 2 -> 11), so that a Manhattan
distance is a bit count and a step up sets one bit.

Only distinct fingerprints are joined: copies, however many, are one row there,
and the number of distinct fingerprints in a cell and within reach is bounded by
combinatorics, not by the size of a group of copies.  Links are turned into
components by alternating large-star and small-star steps, each a join and a
combined minimum, with a checkpoint after each.

Random fingerprints meet by chance in about 7e-6 of all pairs, each costing one
bit count in the join.

``near_texts`` serves a wider reach, as similar texts need, by the same steps.  Its
fingerprints have 512 bits, of the set of words and word pairs, and are embedded
as the bit counts of their 256 two-bit segments.  The grid is laid over
``TABLES`` drawn subspaces of ``SEGMENTS`` segments each; texts that share a cell
of one are at Manhattan distance zero there and meet.  What meets is tested for
the Manhattan distance of the first 32 segments and of the whole embeddings, then for the exact Hamming
distance, and for that of another 1024 bits of the set of five-word shingles; all
reaches are far above what similarity 0.8 gives.  What is left is tested for the
exact Jaccard similarity of the shingle sets.  Two texts of similarity 0.8 come so
far with probability of about 0.99, closer ones with more.  In a cell all texts
first meet its smallest only; after that the smallest is done, and pairs that are
in one component already are left out, so a large group of near copies makes pairs
in proportion to its size, and no link between components is lost.

Null and empty texts have fingerprint zero and link like any other.  Null ids
get a fingerprint and the smallest id of their component, if there is one.
Repeated rows give repeated results.  Other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import cut, table
from terraloom.plans.components import connected_components as components

SEED, SHINGLE, REACH = 42, 3, 3
LOW_BITS = 0x5555555555555555
HALF_SEGMENTS = 16
CHUNK = 1 << 16
TABLES, SEGMENTS, CELL_BITS = 64, 14, 23
WIDE, WIDE_REACH = 8, 80  # words of 64 bits; at similarity 0.8 the distance is 45 with a deviation of 6, in the embedding 42 and 6
FINE, FINE_REACH = 16, 184  # likewise 148 and 10
FIRST_REACH = 18  # of the first 32 segments; at similarity 0.8 their distance is 5 with a deviation of 2
SIMILAR, WORDS = 0.8, 5


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles (fewer words: of the whole sequence)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
        return hashes[0]
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:to], ends[at + SHINGLE - 1 : to + SHINGLE - 1])), np.uint64, to - at)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(compute, "doc_id long, fp long")


def unary(fp: Column) -> Column:
    """The embedding: bit counts of the two-bit segments, in unary."""
    up = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(up).bitwiseAND(F.lit(LOW_BITS))
    some = fp.bitwiseOR(up).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(both, 1).bitwiseOR(some)


def _half(emb: Column, half: int) -> Column:
    return F.shiftrightunsigned(emb, 32) if half else emb.bitwiseAND(F.lit(0xFFFFFFFF))


def _steps_up(cell: Column) -> Column:
    """The cells at one step up, one for each segment whose count is below 2."""

    def step(j: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), (j * 2).cast("int"))
        return F.when(cell.bitwiseAND(low) == 0, cell.bitwiseOR(low)).otherwise(cell.bitwiseOR(low * 2))

    every = F.transform(F.sequence(F.lit(0), F.lit(HALF_SEGMENTS - 1)), step)
    return F.filter(every, lambda c: c != cell)


def links(distinct: DataFrame, reach: int = REACH) -> DataFrame:
    """From distinct fingerprints (fp): pairs (a, b) at most ``reach`` (up to 3) bits apart."""
    if not 0 <= reach <= 3:
        raise ValueError("two halves with one step cover distances up to 3")
    emb = unary(F.col("fp"))
    halves = [F.struct(F.lit(h).alias("half"), _half(emb, h).alias("cell")) for h in (0, 1)]
    index = distinct.select("fp", F.explode(F.array(*halves)).alias("k")).select(F.col("fp").alias("b"), F.col("k.half").alias("half"), F.col("k.cell").alias("cell"))
    own = index.select(F.col("b").alias("a"), "half", F.col("cell").alias("home"))
    probe = own.select("a", "half", F.explode(F.concat(F.array("home"), _steps_up(F.col("home")))).alias("probe"), "home")
    a, b = F.col("a"), F.col("b")
    near = (F.bit_count(unary(a).bitwiseXOR(unary(b))) <= reach) & (F.bit_count(a.bitwiseXOR(b)) <= reach)
    once = (F.col("probe") != F.col("home")) | (a < b)
    pairs = probe.join(index.withColumnRenamed("half", "half_b"), (F.col("half") == F.col("half_b")) & (F.col("probe") == F.col("cell")) & once & near)
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    own = cut(fingerprints(docs, id_col, text_col))
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = components(links(firsts.select("fp"), reach))
    of_fp = firsts.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of_fp.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return own.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def wide_sketch(text: str | None, shingle: int = WORDS) -> tuple[int, int, bool, list[int]]:
    """Key of the words of a text (two longs), whether it has words, and ``WIDE`` longs of a SimHash of its set of words and word pairs and ``FINE`` longs of one of its shingle set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words), SEED), "<i8").tolist()
    if not words:
        return (*key, False, [0] * (WIDE + FINE))
    parts = {a + b" " + b for a, b in zip(words, words[1:])}.union(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    return (*key, True, _many_bits(hashes, WIDE) + _many_bits(_shingles(words, shingle).view(np.uint64), FINE))


def _many_bits(hashes: np.ndarray, longs: int) -> list[int]:
    """A SimHash of several longs, each of other bits made from the same hashes."""
    out = []
    for k in range(longs):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            h = hashes[at : at + CHUNK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(31)
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out


PRINT = [f"f{k}" for k in range(WIDE)] + [f"g{k}" for k in range(FINE)]
COUNTS = [f"e{k}" for k in range(WIDE)]


def _shingles(own: list[bytes], words: int) -> np.ndarray:
    ends = list(accumulate(len(w) + 1 for w in own))
    starts, joined, digest = [0, *ends], b" ".join(own), xxhash.xxh3_64_intdigest
    n = max(1, len(own) - words + 1)
    hashes = {digest(joined[s : e - 1]) for s, e in zip(starts[:n], ends[min(words, len(own)) - 1 :])}
    return np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text (fewer words: of the whole sequence; none: empty)."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return _shingles(own, words) if own else np.zeros(0, np.int64)


def _drawn() -> np.ndarray:
    """The segments of each table."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(32 * WIDE, SEGMENTS, replace=False) for _ in range(TABLES)])


def _embedded(fp: Column) -> Column:
    """The embedding of a wide fingerprint: the bit counts of its two-bit segments, in unary."""
    return F.struct(*[unary(fp[n]).alias(e) for n, e in zip(PRINT, COUNTS)])


def _first_shared(a: Column, b: Column, table: Column) -> Column:
    """Two embeddings that share a cell of this table share none of a table before it, so that a pair comes out once."""
    masks = [[sum(3 << 2 * (int(i) % 32) for i in own if i // 32 == k) for k in range(WIDE)] for own in _drawn()]
    signed = [[m - (1 << 64) if m >> 63 else m for m in own] for own in masks]
    every = F.from_json(F.lit(json.dumps(signed)), "array<array<long>>")
    apart = [a[n].bitwiseXOR(b[n]) for n in COUNTS]

    def same(mask: Column) -> Column:
        return reduce(lambda x, y: x & y, [d.bitwiseAND(mask[k]) == 0 for k, d in enumerate(apart)])

    return ~F.exists(F.slice(every, F.lit(1), table.cast("int")), same)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each table: cell (the counts of the table's segments, with its number), node, first (a long of the fingerprint)."""
    drawn = _drawn()
    weigh = 3 ** np.arange(SEGMENTS, dtype=np.int64)
    for batch in batches:
        node = batch.column("node").to_numpy()
        f = np.stack([batch.column("print").field(n).to_numpy() for n in PRINT[:WIDE]], axis=1)
        counts = np.unpackbits(f.astype("<i8").view(np.uint8), axis=1, bitorder="little").reshape(len(f), -1, 2).sum(axis=2)
        for t in range(TABLES):
            cell = counts[:, drawn[t]].astype(np.int64) @ weigh | t << CELL_BITS
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(node), pa.array(f[:, 0].copy())], ["cell", "node", "first"])


def _sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of few short columns, cut off its plan; to be broadcast if it is counted and found small, else joined by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def _apart(a: Column, b: Column, names: list[str]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[n].bitwiseXOR(b[n])) for n in names])


def _near_prints(a: Column, b: Column, counts_a: Column, counts_b: Column, reach: int) -> Column:
    """The embeddings of two texts, then both fingerprints (structs of longs) are within their reach."""
    return (_apart(counts_a, counts_b, COUNTS) <= reach) & (_apart(a, b, PRINT[:WIDE]) <= reach) & (_apart(a, b, PRINT[WIDE:]) <= FINE_REACH)


def _close(pairs: DataFrame, prints: DataFrame, reach: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose fingerprints (node, print) are near."""
    both = pairs.join(prints.toDF("a", "pa"), "a").join(prints.toDF("b", "pb"), "b")
    a, b = F.col("pa"), F.col("pb")
    return both.where(_near_prints(a, b, _embedded(a), _embedded(b), reach)).select("a", "b")


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (node, text) have shingle sets of at least that Jaccard similarity, as (u, v)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            cuts = np.append(0, np.cumsum([len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))], ["node", "set"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = cut(texts.join(_sized(asked), "node", "left_semi").mapInArrow(sets, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set")))  # one text a node
    held = known.agg(F.sum(F.size("set"))).first()[0] or 0
    if held <= 8_000_000:  # 64 MB; more are joined by shuffle
        known = F.broadcast(known)
    both = pairs.join(known.toDF("a", "sa"), "a").join(known.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    # as a quotient, like the definition
    return both.where(common / (F.size("sa") + F.size("sb") - common) >= similar).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR, reach: int = WIDE_REACH) -> DataFrame:
    """doc_id, component_id: the smallest id reachable by links between texts whose shingle sets are similar.

    Texts of the same words (letter case aside) are one node, known by its
    smallest id, so copies make no pairs; texts without words link to each
    other only.  Rows of one id count as one document; rows with a null id
    don't come out.  Empty tables give an empty result.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [wide_sketch(t.as_py(), words) for t in batch.column("text")]
            columns = list(zip(*rows)) or [[]] * 4
            longs = np.array(columns[3], np.int64).reshape(-1, len(PRINT))
            prints = pa.StructArray.from_arrays([pa.array(longs[:, k].copy()) for k in range(len(PRINT))], PRINT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:2]), prints, pa.array(columns[2], pa.bool_())], ["doc_id", "k1", "k2", "print", "some"])

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL")
    kind = "struct<" + ",".join(f"{n}:long" for n in PRINT) + ">"
    sketches = cut(own.mapInArrow(sketch, f"doc_id long, k1 long, k2 long, print {kind}, some boolean"))
    nodes = cut(sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("print").alias("print"), F.max("some").alias("some")))  # equal for equal keys
    texts = own.withColumnRenamed("doc_id", "node")
    prints = cut(nodes.where("some").groupBy("node").agg(F.min("print").alias("print")))
    index = prints.mapInArrow(_cells, "cell long, node long, first long")

    def shared(cells: DataFrame, label: str) -> DataFrame:
        """Cells with more than one label, and the smallest."""
        return cells.groupBy("cell").agg(F.min(label).alias("head"), F.max(label).alias("last")).where("head < last").select(F.col("cell").alias("at"), "head")

    # only cells that texts share go on; all other texts meet the smallest, and a cell of two is done with that
    heads = index.groupBy("cell").agg(F.min("node").alias("head"), F.min_by("first", "node").alias("head_first"), F.count(F.lit(1)).alias("held")).where("held > 1").withColumnRenamed("cell", "at")
    near_head = F.bit_count(unary(F.col("first")).bitwiseXOR(unary(F.col("head_first")))) <= FIRST_REACH
    met = cut(index.join(_sized(heads), (F.col("cell") == F.col("at")) & (F.col("node") != F.col("head")) & ((F.col("held") > 2) | near_head)).select("cell", "node", "head", "held", near_head.alias("near")))
    first = cut(_close(met.where("near").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), prints, reach))
    links = cut(similar_pairs(first, texts, words, similar))
    parts = components(links)
    named = cut(met.where("held > 2").join(parts.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("cell", "node", F.coalesce("root", "node").alias("part")))
    mixed = named.join(_sized(shared(named, "part").select("at")), F.col("cell") == F.col("at"), "left_semi")
    left = cut(mixed.join(prints, "node").select("node", "cell", "part", "print", _embedded(F.col("print")).alias("counts")))
    other = left.toDF("b", "cell_b", "part_b", "print_b", "counts_b")
    near = _near_prints(F.col("print"), F.col("print_b"), F.col("counts"), F.col("counts_b"), reach)
    once = _first_shared(F.col("counts"), F.col("counts_b"), F.shiftright("cell", CELL_BITS))
    rest = left.join(other, (F.col("cell") == F.col("cell_b")) & (F.col("part") < F.col("part_b")) & near & once).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    rest = cut(rest.join(first, ["a", "b"], "left_anti"))
    parts = components(links.union(cut(similar_pairs(rest, texts, words, similar))))
    of_text = nodes.join(parts.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.coalesce("root", "node").alias("component_id"))
    return sketches.join(of_text, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))).select("doc_id", "component_id")


def _without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (gone_id), one of each id, and all with a null id.

    Whole rows are shuffled only where an id repeats.
    """
    names = docs.columns
    whole = F.struct(*[docs[c] for c in names])
    rows = docs.select(docs[id_col].cast("long").alias("key"), whole.alias("row"), F.xxhash64(*[docs[c] for c in names]).alias("hash"))
    twice = _sized(rows.groupBy("key").count().where("count > 1 AND key IS NOT NULL").select(F.col("key").alias("twice")))
    left = rows.join(_sized(gone.distinct()), F.col("key") == F.col("gone_id"), "left_anti")
    same_id = Window.partitionBy("key").orderBy("hash")
    firsts = left.join(twice, F.col("key") == F.col("twice"), "left_semi").withColumn("nth", F.row_number().over(same_id)).where("nth = 1").drop("nth")
    every = left.join(twice, F.col("key") == F.col("twice"), "left_anti").union(firsts)
    return every.select(*[F.col("row").getField(c).alias(c) for c in names])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` without those that have a near duplicate with a smaller id in their component.

    Of repeated rows of one id one stays; rows with a null id all stay.
    """
    found = near_duplicates(docs, id_col, text_col, reach)
    return _without(docs, found.where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")), id_col)


def keep_first_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without those that ``near_texts`` links to a smaller id.

    Of repeated rows of one id one stays; rows with a null id all stay.
    """
    found = near_texts(docs, id_col, text_col, words, similar)
    return _without(docs, found.where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")), id_col)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
