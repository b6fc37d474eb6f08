"""Operator 6, benchmark decontamination: suffix arrays over the training texts, searched by every test suffix.

The documents of a task are cut into shards of bounded size. A shard's words become integers by the benchmark's
vocabulary, and its suffix array holds every place from which at least `shortest` words run on in pairs that the
benchmark has; no other place can match. Every test suffix is found in it by binary search on its first 13 words (a
shorter item: all of it), the matches are extended to maximal ones, and their places are told. Documents of which
enough words lie inside matches are contaminated.

Equal test suffixes share one search, and items of equal words one test. Of the places and suffixes that match, only
those with different words to their left are listed, found by the left neighbour in the sorted suffixes; the others
continue a match. So a shard's work grows with its places and the matches it tells.

A benchmark of at most block_bytes is handed to every task, and documents need no shuffle. A larger one is dealt into
blocks of that size: hashes of its windows meet those of the documents' by a shuffle, which tells the blocks that a
document can match; each block then searches only those documents, whose texts are compared word by word as above.

Defined results: null text has no words; a null item has no window; repeated items count one by one, by their
item_id, and matches name the first of items of equal words; an item_id of null is left out of items; an empty benchmark hits nothing; an empty table gives no rows. Words are told
apart by their bytes, so there are no false matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import beside, held, let, read_table, running, ship, text_key, written

ship(__name__)

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_CHARS = 4 << 20
#: Bytes as word characters in lower case, all others as spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Items:
    """A block of the benchmark: its vocabulary, word pairs and test suffixes. names has, for each sequence of words, the
    item_ids that have it."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list] = {}
        for name, text in rows:
            if words := split_words(text):
                found.setdefault(tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words), []).append(name)
        self.names = [sorted((x for x in v if x is not None)) for v in found.values()]
        sizes = np.array([len(s) for s in found], dtype=np.int64)
        self.words = np.array([i for s in found for i in (*s, 0)], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(sizes) else np.zeros(0, np.int64)
        self.base = len(self.vocab) + 1
        pairs = self.words[:-1] * self.base + self.words[1:] if len(self.words) else self.words
        self.pairs = np.unique(pairs[(self.words[:-1] > 0) & (self.words[1:] > 0)]) if len(self.words) else pairs
        short = np.minimum(sizes, window)
        many = sizes - short + 1
        owner = np.repeat(np.arange(len(sizes)), many)
        starts = np.repeat(self.first, many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        lengths = short[owner]
        # suffixes in the order of their length and first words, and of the word to their left
        padded = np.concatenate([self.words, np.zeros(window, np.int64)])
        heads = np.stack([np.where(lengths > k, padded[starts + k], 0) for k in range(window)], axis=1) if len(starts) else np.zeros((0, window), np.int64)
        left = np.where(starts > 0, self.words[np.maximum(starts - 1, 0)], 0) if len(starts) else starts
        order = np.lexsort([left, *heads.T[::-1], lengths])
        self.starts, self.owner, self.left, heads, lengths = starts[order], owner[order], left[order], heads[order], lengths[order]
        new = np.append(True, (heads[1:] != heads[:-1]).any(axis=1) | (lengths[1:] != lengths[:-1])) if len(order) else np.zeros(0, bool)
        #: classes of equal suffixes: their words, length, and the range of suffixes
        self.class_start = np.flatnonzero(new)
        self.class_end = np.append(self.class_start[1:], len(order)) if len(order) else self.class_start
        self.heads, self.lengths = heads[new], lengths[new]
        self.class_of = np.cumsum(new) - 1
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        # items by class, each once
        both = np.unique(self.class_of * max(1, len(sizes)) + self.owner) if len(order) else order
        self.item_of = both % max(1, len(sizes))
        self.item_ends = np.searchsorted(both // max(1, len(sizes)), np.arange(len(self.class_start) + 1))


def suffix_array(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places ordered by the depth words from each; words is padded by depth zeros."""
    keys = [words[places + k] for k in range(depth - 1, -1, -1)]
    return places[np.lexsort(keys)]


def _search(words: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For every class of test suffixes, the range of array whose first words are its own, by simultaneous binary search."""
    bounds = []
    for side in ("left", "right"):
        low, high = np.zeros(len(items.lengths), np.int64), np.full(len(items.lengths), len(array), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k in range(items.window):
                use = same & (k < items.lengths)
                if not use.any():
                    break
                a, b = words[at + k], items.heads[:, k]
                less |= use & (a < b)
                same &= ~use | (a == b)
            go = less | (same & (side == "right"))
            low, high = np.where(open_ & go, mid + 1, low), np.where(open_ & ~go, mid, high)
        bounds.append(low)
    return bounds[0], bounds[1]


def _each(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges, one after the other, and which range each is from."""
    many = end - start
    which = np.repeat(np.arange(len(many)), many)
    return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + start[which], which


def shard_places(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place in words, class) of all test suffixes' occurrences in a shard, at most one of each length at a place; words
    has 0 between texts and -1 for words that the benchmark lacks."""
    none = (np.zeros(0, np.int64),) * 2
    if not len(words) or not len(items.lengths):
        return none
    depth = items.window
    padded = np.concatenate([words, np.zeros(depth, np.int64)])
    known = words > 0
    ok = known[:-1] & known[1:]
    pair = words[:-1] * items.base + words[1:]
    at = np.minimum(np.searchsorted(items.pairs, pair), max(len(items.pairs) - 1, 0))
    ok &= (items.pairs[at] == pair) if len(items.pairs) else False
    # run: words that run on from a place in known pairs
    n = len(words)
    breaks = np.where(~np.append(ok, False), np.arange(n), n)
    run = np.minimum.accumulate(breaks[::-1])[::-1] - np.arange(n) + 1
    places = np.flatnonzero(known & (run >= items.shortest))
    if not len(places):
        return none
    array = suffix_array(padded, places, depth)
    at, which = _each(*_search(padded, array, items))
    return array[at], which


def shard_matches(words: np.ndarray, items: Items, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches (place in words, length, item, place in the item's words) among shard_places()."""
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    n = len(words)
    before = np.where(at > 0, words[np.maximum(at - 1, 0)], 0)
    # a suffix with the same word to its left continues a match that starts earlier: leave out these of the class
    base = len(items.vocab) + 2
    key = items.class_of * base + items.left
    want = which * base + np.maximum(before, 0)
    low, high = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
    low, high = (np.where(before > 0, x, items.class_start[which]) for x in (low, high))
    one, a = _each(items.class_start[which], low)
    two, b = _each(high, items.class_end[which])
    suffix, pair = np.concatenate([one, two]), np.concatenate([a, b])
    at, length = at[pair], items.lengths[which[pair]].copy()
    start = items.starts[suffix]
    grows = np.arange(len(at))
    while len(grows):
        a, b = at[grows] + length[grows], start[grows] + length[grows]
        here = np.where(a < n, words[np.minimum(a, n - 1)], 0)
        grows = grows[(here > 0) & (here == items.words[np.minimum(b, len(items.words) - 1)])]
        length[grows] += 1
    return at, length, items.owner[suffix], start - items.first[items.owner[suffix]]


def _hits(words: np.ndarray, items: Items, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many words before each place, and before the end, lie inside occurrences."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + items.lengths[which], -1)
    return np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))


_MATCH = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
_FOUND = "row bigint, doc_id {}, n_words bigint, n_hit bigint, item_ids array<string>, matches array<struct<start:bigint,length:bigint,item:string,item_start:bigint>>"


def _shards(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about most characters; a longer text is one of its own."""
    for batch in batches:
        sizes = np.array([len(t) if (t := x.as_py()) else 0 for x in batch.column(text)], dtype=np.int64)
        start, total = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if i > start and total + s > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += s
        if start < batch.num_rows:
            yield batch.slice(start)


def _shard_words(texts: list[str | None], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts as numbers, 0 after each text; the texts' sizes and starts."""
    ids, sizes = [], []
    get = items.vocab.get
    for text in texts:
        found = [get(w, -1) for w in split_words(text)]
        sizes.append(len(found))
        ids += found
        ids.append(0)
    n = np.array(sizes, dtype=np.int64)
    return np.array(ids, dtype=np.int64), n, np.cumsum(n + 1) - n - 1


def _cleaner(handed, text: int, shard_chars: int):
    """mapInArrow function: the rows that are not contaminated."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held(handed, Items)
        for shard in _shards(batches, text, shard_chars):
            words, sizes, first = _shard_words(shard.column(text).to_pylist(), items)
            hit = _hits(words, items, *shard_places(words, items))
            n_hit = hit[first + sizes] - hit[first]
            yield shard.filter(pa.array(~((n_hit > 0) & (n_hit * 20 >= sizes))))

    return clean


def _told(shard: pa.RecordBatch, items: Items) -> pa.RecordBatch:
    """Rows (row, doc_id, text) as (row, doc_id, n_words, n_hit, item_ids, matches), places being in the text."""
    words, sizes, first = _shard_words(shard.column(2).to_pylist(), items)
    places, which = shard_places(words, items)
    hit = _hits(words, items, places, which)
    rows = len(sizes)
    # items of each row, by the classes that occur in it
    seen = np.unique((np.searchsorted(first, places, side="right") - 1) * (len(items.lengths) + 1) + which) if len(places) else places
    row, cls = seen // (len(items.lengths) + 1), seen % (len(items.lengths) + 1)
    each, pair = _each(items.item_ends[cls], items.item_ends[cls + 1]) if len(seen) else (seen, seen)
    ids: list[set[str]] = [set() for _ in range(rows)]
    for r, k in zip(row[pair].tolist(), items.item_of[each].tolist(), strict=True):
        ids[r].update(items.names[k])
    at, length, item, place = shard_matches(words, items, places, which)
    order = np.lexsort([place, item, length, at])
    at, length, item, place = at[order], length[order], item[order], place[order]
    row = np.searchsorted(first, at, side="right") - 1
    ends = np.searchsorted(row, np.arange(rows + 1), side="left").astype(np.int32)
    names = pa.array([x[0] if x else None for x in items.names], pa.string())
    flat = pa.StructArray.from_arrays([pa.array(at - first[row] if len(at) else at), pa.array(length), names.take(pa.array(item)), pa.array(place)], fields=list(_MATCH))
    return pa.RecordBatch.from_arrays(
        [shard.column(0), shard.column(1), pa.array(sizes), pa.array(hit[first + sizes] - hit[first]), pa.array([sorted(x) for x in ids], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
        names=["row", "doc_id", "n_words", "n_hit", "item_ids", "matches"])


def _matcher(handed, shard_chars: int):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held(handed, Items)
        for shard in _shards(batches, 2, shard_chars):
            yield _told(shard, items)

    return matches


def _small(items: DataFrame, block_bytes: int) -> list[tuple[str | None, str | None]] | None:
    """The benchmark's rows with words, if they are not over block_bytes."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    size = rows.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)))).first()[0] or 0
    return None if size > block_bytes else [(r[0], r[1]) for r in rows.orderBy("item_id", "text").collect()]


def _window_keys(of: int, sizes: list[int], whole: bool):
    """mapInArrow function: the column `of` and the distinct hashes of a text's windows: of all given sizes, or with whole
    of an item's own size only. Hashes only lead to the blocks where words are compared."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], []
            for owner, text in zip(batch.column(of).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = split_words(text)
                used = [min(WINDOW, len(words))] if whole else sizes
                found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + n])) - (1 << 63) for n in used if n for i in range(len(words) - n + 1)}
                owners += [owner] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(out, pa.int64())], names=["of", "key"])

    return keys


def _block_matcher(shard_chars: int):
    def matches(left: pa.Table, right: pa.Table) -> pa.Table:
        items = Items(list(zip(right.column("item_id").to_pylist(), right.column("text").to_pylist(), strict=True)))
        shards = _shards(iter(left.select(["row", "doc_id", "text"]).combine_chunks().to_batches()), 2, shard_chars)
        return pa.Table.from_batches([_told(x, items) for x in shards])

    return matches


def _by_blocks(docs: DataFrame, items: DataFrame, block_bytes: int, shard_chars: int) -> DataFrame:
    """match_items() for a benchmark of several blocks. docs (row, doc_id, text) is a written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    block = F.pmod(F.xxhash64("text"), F.lit(math.ceil(size / block_bytes)))
    items = written(items.select(F.col("item_id").cast("string").alias("item_id"), "text", block.cast("long").alias("block")).where("text is not null"), "benchmark-blocks")
    words = F.size(F.filter(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != ""))
    sizes = [r[0] for r in items.select(F.least(words, F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect()]
    theirs = items.select("block", "text").mapInArrow(_window_keys(0, [], True), "of bigint, key bigint").distinct().withColumnRenamed("of", "block")
    ours = docs.select("row", "text").mapInArrow(_window_keys(0, sizes, False), "of bigint, key bigint").withColumnRenamed("of", "row")
    meet = written(ours.join(theirs, "key").select("row", "block").distinct(), "benchmark-meetings")
    # a block that many documents meet is searched by several tasks, each of them with the block's items
    load = docs.select("row", F.octet_length("text").alias("size")).join(meet, "row").groupBy("block").agg((F.floor(F.sum("size") / F.lit(16 * shard_chars)) + 1).cast("long").alias("n"))
    load = written(load, "benchmark-load")
    asked = meet.join(load, "block").select("row", "block", F.pmod(F.xxhash64("row"), "n").alias("share"))
    left = docs.join(asked, "row")
    right = items.join(load, "block").select("block", "item_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("share"))
    found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(_block_matcher(shard_chars), _FOUND.format(kind))
    merged = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    base = docs.select("row", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("n_words")).join(merged, "row", "left")
    ends = F.transform("matches", lambda m: m["start"] + m["length"])

    def covered(matches, done):
        gain = F.transform(matches, lambda m, i: F.greatest(F.lit(0), m["start"] + m["length"] - F.greatest(m["start"], F.when(i > 0, F.get(done, i - 1)).otherwise(0))))
        return F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x)

    n_hit = let(running(ends, most=True), lambda done: covered(F.col("matches"), done))
    empty = F.array().cast("array<string>")
    return base.select("row", "doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", empty).alias("item_ids"), F.coalesce("matches", F.array().cast(base.schema["matches"].dataType)).alias("matches"))


def match_items(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs (doc_id, text) as (row, doc_id, n_words, n_hit, item_ids, matches). matches are the maximal verbatim ones:
    array<struct<start,length,item,item_start>>, in words, item as item_id string; item_ids: the items with an
    occurring window, distinct and sorted as strings. row tells rows apart where the benchmark has several blocks, else
    it is null."""
    docs = docs.select("doc_id", "text")
    small = _small(items, block_bytes)
    if small is None:
        return _by_blocks(written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate-docs"), items, block_bytes, shard_chars)
    handed = docs.sparkSession.sparkContext.broadcast({"content": small})
    rows = docs.select(F.lit(None).cast("long").alias("row"), "doc_id", "text")
    return rows.mapInArrow(_matcher(handed, shard_chars), _FOUND.format(docs.schema["doc_id"].dataType.simpleString()))


def contaminated():
    """A document is contaminated if a twentieth of its words or more lie inside matches."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) without the contaminated documents: for one block of the benchmark in one pass without a
    shuffle, for several by a join on doc_id and text."""
    small = _small(items, block_bytes)
    if small is not None:
        handed = docs.sparkSession.sparkContext.broadcast({"content": small})
        return docs.mapInArrow(_cleaner(handed, docs.columns.index("text"), SHARD_CHARS), docs.schema)

    def clean(docs: DataFrame) -> DataFrame:
        found = match_items(docs.select(F.struct("doc_id", text_key(F.col("text")).alias("key")).alias("doc_id"), "text"), items, block_bytes)
        bad = found.where(contaminated()).select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.key").alias("__key")).distinct()
        return docs.join(bad.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__id")) & (text_key(docs["text"]) == F.col("__key")), "left_anti")

    return beside(docs, ("doc_id", "text"), clean)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and matched items of all documents."""
    found = match_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP6_SQL = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') as g from b, unnest(range(0, len(w) - least(13, len(w)) + 1)) as t(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as g from d, sizes, unnest(range(0, len(w) - n + 1)) as t(i)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
c as (select doc_id, count(distinct i + k) as n_hit from h, unnest(range(0, n)) as t(k) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join m using (doc_id)
"""
