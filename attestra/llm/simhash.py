"""Operator 10, SimHash near-dedup: pivot distance tables.

Every document has a 64-bit fingerprint of its word shingles. Fingerprints that differ in `bits` or fewer places are
linked. Copies fall together first: what follows sees each distinct fingerprint once. By the pigeonhole principle two
linked fingerprints agree in three of six blocks of bits, so the twenty choices of three blocks deal them into
buckets that miss no link. In a bucket, the distances of each fingerprint to fixed reference fingerprints are
tabled; by the triangle inequality a pair whose distances to some reference differ by more than `bits` is no link and
is discarded, and the survivors are verified. A bucket gives the links of a spanning forest, not all its pairs.

Defined results: null text has no words and the fingerprint zero; zero fingerprints link like any other; repeated
rows each give their row; a null doc_id is never the smallest of its component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import beside, hot_keys_join, read_table, ship, text_key, written
from attestra.llm.components import components

ship(__name__)

SHINGLE, BITS, SEED = 3, 3, 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
N_PIVOTS = 16
#: Above so many fingerprints in a bucket, looking up all neighbours of each is cheaper than the table.
DENSE = 60_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned: a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprinter(shingle: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "fp"])

    return fingerprints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) as (doc_id, fp): fp is the fingerprint as a signed number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprinter(shingle), f"doc_id {kind}, fp bigint")


def pivots() -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(N_PIVOTS)], dtype=np.uint64)


class _Forest:
    """Union-find over places 0 to n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs; the smaller place becomes the root."""
        up = self.up
        for x, y in {(int(x), int(y)) for x, y in np.unique(np.stack([up[a], up[b]], axis=1), axis=0)} if len(a) else ():
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up[:] = up[up]


def bucket_roots(fps: np.ndarray, refs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For distinct fingerprints of a bucket, the place of each one's root in a spanning forest of their links."""
    n = len(fps)
    forest = _Forest(n)
    if n > DENSE:
        _dense(fps, forest, bits)
        return forest.up
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = table[order], fps[order]
    first = table[:, 0]
    step = max(1, (1 << 22) // n)
    for i in range(0, n, step):
        j = min(n, i + step)
        high = int(np.searchsorted(first, first[j - 1] + bits, side="right"))
        a, b = np.nonzero(np.abs(first[i:j, None] - first[None, i:high]) <= bits)
        keep = b > a
        a, b = a[keep] + i, b[keep] + i
        for p in range(1, table.shape[1]):  # the largest difference of a coordinate
            keep = np.abs(table[a, p] - table[b, p]) <= bits
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(sorted_fps[a] ^ sorted_fps[b]) <= bits
        forest.join(order[a[keep]], order[b[keep]])
    return forest.up


def _dense(fps: np.ndarray, forest: _Forest, bits: int) -> None:
    order = np.argsort(fps)
    ranked = fps[order]
    varies = [i for i in range(64) if len(np.unique((fps >> np.uint64(i)) & np.uint64(1))) > 1]
    for k in range(1, bits + 1):
        for flips in combinations(varies, k):
            other = ranked ^ np.uint64(sum(1 << i for i in flips))
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = ranked[at] == other
            forest.join(order[np.flatnonzero(hit)], order[at[hit]])


def _linker(bits: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, fp), ordered by bucket, as links (a, b)."""
        refs = pivots()
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # of the bucket that is not complete yet

        def links(buckets: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(buckets)))
            out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            twos = starts[sizes == 2]
            near = np.all(np.abs(np.bitwise_count(fps[twos, None] ^ refs).astype(np.int16) - np.bitwise_count(fps[twos + 1, None] ^ refs).astype(np.int16)) <= bits, axis=1)
            twos = twos[near]
            twos = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= bits]
            out_a.append(fps[twos])
            out_b.append(fps[twos + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                part = fps[s : s + n]
                roots = bucket_roots(part, refs, bits)
                moved = roots != np.arange(n)
                out_a.append(part[moved])
                out_b.append(part[roots[moved]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

        def told() -> pa.RecordBatch:
            return links(*[np.concatenate(x) for x in zip(*parts, strict=True)])

        for batch in batches:
            b, f = batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(b):
                continue
            last = parts[-1][0][-1] if parts else b[0]
            cut = int(np.searchsorted(b, b[-1]))  # what is before the batch's last bucket is complete
            if b[-1] != last:
                parts.append((b[:cut], f[:cut]))
                yield told()
                parts = [(b[cut:], f[cut:])]
            else:
                parts.append((b, f))
        if parts:
            yield told()

    return linked


def fingerprint_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """distinct (fp) as links (a, b) that connect what differs in bits or fewer places. bits is at most 3."""
    if not 0 <= bits <= 3:
        raise ValueError("the blocks find links of at most 3 bits")
    keys = []
    for k, chosen in enumerate(combinations(BLOCKS, 3)):
        key, width = F.lit(k).cast("long"), 0
        for low, n in chosen:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1).cast("long")))
            width += n
        keys.append(key)
    dealt = distinct.select(F.explode(F.array(*keys)).alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(_linker(bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) as (doc_id, fp, component_id): component_id is the smallest doc_id that doc_id reaches over
    links, itself included."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    rooted = _rooted(distinct, bits)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m"))
    n_fps = distinct.count()
    by_fp = hot_keys_join(rooted, lowest, ["root"], "m", n_fps).select("fp", "component_id", "n")
    return hot_keys_join(marked, by_fp, ["fp"], "n", marked.count()).select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame, bits: int) -> DataFrame:
    """distinct (fp, ...) with the smallest fingerprint that each one reaches, as root."""
    roots = components(fingerprint_links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of docs (doc_id, text, ...) for each component: that of the smallest doc_id, null last, then of the smallest
    hash of its text. Rows that share an id are told apart by their texts; of equal rows one stays."""

    def keep(docs: DataFrame) -> DataFrame:
        # one type on both sides of the join, or it deals the texts out anew
        kind = f"struct<none:boolean,doc_id:{docs.schema['doc_id'].dataType.simpleString()},text:bigint>"
        key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_key(F.col("text")).alias("text")).cast(kind)
        marked = written(fingerprints(docs.select(key.alias("doc_id"), "text"), shingle), "fingerprints")
        distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
        lowest = _rooted(distinct, bits).groupBy("root").agg(F.min("low").alias("__key")).select("__key")
        # equal rows first fall together where they lie, so none of them makes a hot key
        return docs.withColumn("__key", key).dropDuplicates(["__key"]).join(lowest.hint("merge"), "__key", "left_semi")

    return beside(docs, ("doc_id", "text"), keep)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
