"""Operator 9, substring dedup: fixed-block anchors, and windows of words that occur more than once.

A window of 35 words holds a whole block of 18, counted from the start of its text. So of two places with the same
window, a rolling window of the one meets a reference block of the other, and no repeat is missed if

1. every text's non-overlapping blocks are indexed and its rolling windows of 18 words probe them,
2. around each hit the windows of 35 words that hold it are verified, and maximal exact repeats are the runs of those
   that occur again.

Comparing places pair by pair would be quadratic in the copies of a passage, so a hit is extended by one window after
the other: every window of 35 words that holds the hit is looked up among those of all other hits.

Texts are dealt into groups of a few megabytes by a hash of their row, so copies of one row are spread like any others. A
group sends each of its distinct hashes once to the bucket of its leading bits - five bytes for a rolling window, twelve
for a window of 35 words - so a passage of any number of copies costs a bucket one entry a group; the bucket answers each
group with those that were found elsewhere. Both rounds do so, and all of them read one shuffle of the texts.

Defined results: null text has no words; a text of fewer than 35 words keeps them all; repeated rows are copies of
each other like any others; an empty table gives no rows; other columns are ignored. The first round only proposes, so a
clash of its short hashes removes nothing; windows of 35 words are told apart by 95 bits, made of 128 bits of each word:
among 10**13 windows one false pair is expected in a thousand such tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestra.llm.common import read_table, ship, text_key

ship(__name__)

WINDOW = 35
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
_ODD = 0x9E3779B97F4A7C15
_LOW = 38
_HELD = 400_000
_cache: dict[bytes, bytes] = {}
#: A window of full size: 64 bits of hash, 31 more, and whether its group has it more than once in the lowest bit.
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4")])


def block_size(window: int) -> int:
    """The longest block that every window holds whole, wherever it starts."""
    return (window + 1) // 2


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits of each word as two columns."""
    if len(_cache) > _HELD:
        _cache.clear()
    for w in set(words).difference(_cache):
        _cache[w] = xxhash.xxh3_128_digest(w)
    return np.frombuffer(b"".join(map(_cache.__getitem__, words)), "<u8").reshape(-1, 2)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size words from each place (n - size + 1 of them)."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= np.uint64(_ODD)
        h += words[k : k + n]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    return h ^ (h >> np.uint64(31))


class _Texts:
    """The texts of a group, in a fixed order, as one array of word hashes."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.words = [(texts[i] or "").encode().split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        both = np.concatenate([_word_hashes(w) for w in self.words] or [np.zeros((0, 2), np.uint64)])
        self.hashes, self.others = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        # words from a place to the end of its text, and from its start
        self.left = np.repeat(self.ends, self.sizes) - np.arange(len(self.hashes))
        self.done = np.repeat(self.sizes, self.sizes) - self.left

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of whole windows, and their hashes."""
        h = window_hashes(self.hashes, size)
        at = np.flatnonzero(self.left[: len(h)] >= size)
        return at, h[at]

    def entries(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of whole windows, and their hashes as _ENTRY with the lowest bit clear."""
        at, a = self.windows(size)
        out = np.empty(len(at), _ENTRY)
        out["a"] = a
        out["b"] = (window_hashes(self.others, size)[at] >> np.uint64(32)).astype(np.uint32) & ~np.uint32(1)
        return at, out


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2**40, five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _sent(g: int, hashes: np.ndarray, packed: np.ndarray, n_buckets: int, pack) -> pa.Table:
    bucket = _bucket(hashes, n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, packed = bucket[order], packed[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = [*starts[1:].tolist(), len(bucket)]
    blobs = [pack(packed[s:e]) for s, e in zip(starts.tolist(), ends, strict=False)]
    return pa.table({"bucket": pa.array(bucket[starts].astype(np.int64)), "g": pa.array(np.full(len(starts), g, np.int64)), "blob": pa.array(blobs, pa.binary())})


_SENT = "bucket bigint, g bigint, blob binary"
_ANSWER = "g bigint, hits binary"


def _anchors(window: int, n_buckets: int):
    size = block_size(window)

    def send(key, table):
        """A group's distinct rolling windows of block size, marked if a block has that hash and if several do."""
        texts = _Texts(table)
        at, h = texts.windows(size)
        # a text with no whole window of the greater size has nothing to find or give
        use = (texts.left[at] + texts.done[at]) >= window
        at, h = at[use], h[use]
        block = texts.done[at] % size == 0
        order = np.lexsort([~block, h])
        h, block = h[order], block[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        many = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
        h, block = h[new], block[new]
        mask = np.uint64((1 << _LOW) - 1)
        packed = ((h & mask) << np.uint64(2)) | (block.astype(np.uint64) << np.uint64(1)) | many.astype(np.uint64)
        return _sent(key[0].as_py(), h, packed, n_buckets, _pack)

    return send


def _sorted_entries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by hash, and where a new hash begins in that order."""
    order = np.lexsort([x["b"], x["a"]])
    a, b = x["a"][order], x["b"][order] >> np.uint32(1)
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(x) else np.zeros(0, bool)


def _answers(groups: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(groups, kind="stable")
    groups, values = groups[order], values[order]
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    ends = [*starts[1:].tolist(), len(groups)]
    return pa.table({"g": pa.array(groups[starts]), "hits": pa.array([values[s:e].tobytes() for s, e in zip(starts.tolist(), ends, strict=False)], pa.binary())})


def _received(table: pa.Table, unpack, kind) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's groups and values."""
    blobs = [unpack(b) for b in table.column("blob").to_pylist()]
    return np.repeat(table.column("g").to_numpy(), [len(b) for b in blobs]), np.concatenate(blobs or [np.zeros(0, kind)])


def _probe(key, table):
    """The values that a block has, and that occur at two places or more, back to each group that sent them."""
    groups, values = _received(table, _unpack, np.uint64)
    if not len(values):
        return _answers(groups, values)
    order = np.argsort(values)
    groups, values = groups[order], values[order]
    plain = values >> np.uint64(2)
    new = np.append(True, plain[1:] != plain[:-1])
    run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    several = np.add.reduceat(np.ones(len(values), np.int64) + (values & np.uint64(1)).astype(np.int64), starts) > 1
    block = np.bitwise_or.reduceat(values & np.uint64(2), starts) > 0
    hit = (several & block)[run]
    full = (values[hit] >> np.uint64(2)) | (np.uint64(key[0].as_py()) << np.uint64(_LOW))
    return _answers(groups[hit], full)


def _is_in(x: np.ndarray, table: pa.Table) -> np.ndarray:
    known = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in table.column("hits").to_pylist()] or [np.zeros(0, np.uint64)]))
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _has_entry(x: np.ndarray, table: pa.Table) -> np.ndarray:
    """Which entries are among those that came back."""
    known = np.concatenate([np.frombuffer(b, _ENTRY) for b in table.column("hits").to_pylist()] or [np.zeros(0, _ENTRY)])
    order, new = _sorted_entries(known)
    known = known[order][new]
    out = np.zeros(len(x), bool)
    if not len(known) or not len(x):
        return out
    first = np.searchsorted(known["a"], x["a"])
    for k in range(int(np.unique(known["a"], return_counts=True)[1].max())):  # one, unless two share 64 bits
        at = np.minimum(first + k, len(known) - 1)
        out |= (known["a"][at] == x["a"]) & (known["b"][at] >> np.uint32(1) == x["b"] >> np.uint32(1))
    return out


def _extensions(window: int, n_buckets: int):
    size = block_size(window)

    def send(key, left, right):
        """A group's distinct windows that hold a hit; the lowest bit tells whether the group has it twice."""
        if not left.num_rows or not right.num_rows:
            return _sent(0, np.zeros(0, np.uint64), np.zeros(0, _ENTRY), n_buckets, bytes)
        texts = _Texts(left)
        at, h = texts.windows(size)
        hit = at[_is_in((_bucket(h, n_buckets) << np.uint64(_LOW)) | (h & np.uint64((1 << _LOW) - 1)), right)]
        edge = np.zeros(len(texts.hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(hit - (window - size), hit - texts.done[hit]), 1)  # windows that start from there
        np.add.at(edge, hit + 1, -1)  # to the hit itself hold it
        held = np.cumsum(edge) > 0
        at, entries = texts.entries(window)
        entries = entries[held[at]]
        order, new = _sorted_entries(entries)
        entries = entries[order]
        many = np.diff(np.append(np.flatnonzero(new), len(entries))) > 1
        entries = entries[new]
        entries["b"] |= many.astype(np.uint32)
        return _sent(key[0].as_py(), entries["a"], entries, n_buckets, lambda x: x.tobytes())

    return send


def _verify(key, table):
    """The windows that occur at two places or more, back to each group that sent them."""
    groups, values = _received(table, lambda b: np.frombuffer(b, _ENTRY), _ENTRY)
    if not len(values):
        return _answers(groups, values)
    order, new = _sorted_entries(values)
    groups, values = groups[order], values[order]
    run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    several = np.add.reduceat(np.ones(len(values), np.int64) + (values["b"] & np.uint32(1)).astype(np.int64), starts) > 1
    hit = several[run]
    return _answers(groups[hit], values[hit])


def _cut(window: int, kind: pa.DataType):
    def cut(left, right):
        texts = _Texts(left)
        gone = np.zeros(len(texts.hashes), bool)
        if right.num_rows:
            at, entries = texts.entries(window)
            at = at[_has_entry(entries, right)]
            edge = np.zeros(len(gone) + 1, np.int64)
            edge[at] += 1
            edge[at + window] -= 1
            gone = np.cumsum(edge)[:-1] > 0
        removed, kept, start = [], [], 0
        for words, end in zip(texts.words, texts.ends.tolist(), strict=True):
            part = gone[start:end]
            n = int(part.sum())
            removed.append(n)
            kept.append(b" ".join(words if not n else [w for w, x in zip(words, part.tolist(), strict=True) if not x]).decode())
            start = end
        return pa.table({"doc_id": pa.array(texts.ids, kind), "n_words": pa.array(texts.sizes), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return cut


def dedup_substrings(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_words, n_removed, kept): kept is the words that no repeated window covers, joined
    by one space. window is at least 2."""
    if window < 2:
        raise ValueError("window must be at least 2")
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups, n_buckets = max(1, math.ceil(total / group_bytes)), max(1, math.ceil(total / bucket_bytes))
    # a row's number is the same whenever its partition is read again
    grouped = docs.select(F.pmod(F.xxhash64("doc_id", text_key(F.col("text")), F.monotonically_increasing_id()), F.lit(n_groups)).alias("g"), "doc_id", "text")
    sent = grouped.groupBy("g").applyInArrow(_anchors(window, n_buckets), _SENT)
    hits = sent.groupBy("bucket").applyInArrow(_probe, _ANSWER)
    longer = grouped.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_extensions(window, n_buckets), _SENT)
    repeats = longer.groupBy("bucket").applyInArrow(_verify, _ANSWER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return grouped.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(_cut(window, to_arrow_type(docs.schema["doc_id"].dataType)), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, how many go, and the digest of what stays."""
    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') as g from d, unnest(range(0, len(w) - 34)) as t(i)),
r as (select g from g group by g having count(*) > 1),
gone as (select distinct doc_id, i + k as i from g join r using (g), unnest(range(0, 35)) as t(k)),
words as (select doc_id, i, w[i + 1] as word from d, unnest(range(0, len(w))) as t(i)),
k as (select words.doc_id, count(gone.i) as n_removed, string_agg(word, ' ' order by words.i) filter (where gone.i is null) as kept
  from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by words.doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
