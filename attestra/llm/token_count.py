"""Operator 8, token counts: rank-synchronous array merging.

The pre-tokens of a batch of texts that are not known yet are held as one ragged array of symbols. In each round every
sequence finds its pair of lowest rank and merges all its occurrences, all sequences at once, until none has a pair
to merge; a sequence's tokens are the symbols that are left. A pair that a merge makes possible has a higher rank
than it in a vocabulary that was built by merging, so this gives what merging one at a time does.

Supported: tokenizers files of the kind word_bpe_49k.json (BPE with or without an end-of-word mark, NFC, runs of white
space replaced, lower case, a split pattern that keeps matches, byte-level symbols, special tokens that are cut out of
the raw text); what a file asks for beyond that is refused. Texts are normalised by the tokenizers package. The split
pattern is run by the regex package; where its classes of letters, numbers and white space differ from those of the
tokenizers package, which is asked about every code point once, a character of the right class stands in.

Defined results: null text is empty and has no tokens; repeated rows each give their row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import held, read_table, ship

ship(__name__)

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a worker remembers; beyond that it starts anew.
HELD = 400_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable in
    Latin-1, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in shown else chr(256 + sum(1 for x in range(b) if x not in shown)) for b in range(256)]


#: The classes of a split pattern, and a character of each that no contraction has; the last is of none of them.
_CLASSES = {r"\p{L}": "é", r"\p{N}": "½", r"\s": " ", "": "\x01"}


def class_exceptions() -> dict[int, str]:
    """Code points that the regex package puts in another class than the tokenizers package, with a character of the class
    that the latter puts them in."""
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    theirs, ours = np.zeros(len(every), np.int8), np.zeros(len(every), np.int8)
    for k, name in enumerate(list(_CLASSES)[:3], 1):
        theirs[:] = np.where(theirs, theirs, k)
        for _, (start, end) in tokenizers.pre_tokenizers.Split(tokenizers.Regex(name), "removed").pre_tokenize_str(every):
            theirs[start:end] = np.where(theirs[start:end] == k, 0, theirs[start:end])
        for m in regex.finditer(f"[{_unicode(name)}]+", every):
            ours[m.start() : m.end()] = np.where(ours[m.start() : m.end()], ours[m.start() : m.end()], k)
    stand_in = [_CLASSES[""], *list(_CLASSES.values())[:3]]
    return {ord(every[i]): stand_in[theirs[i]] for i in np.flatnonzero(theirs != ours).tolist()}


class BpeCounter:
    """spec is the content of a tokenizers file; exceptions are class_exceptions(), which are found where not given."""

    def __init__(self, spec: str | tuple[str, dict[int, str]]):
        spec, exceptions = spec if isinstance(spec, tuple) else (spec, class_exceptions())
        d = json.loads(spec)
        model = d["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE model")
        steps = d["normalizer"]["normalizers"] if (d["normalizer"] or {}).get("type") == "Sequence" else [d["normalizer"]] if d["normalizer"] else []
        for s in steps:
            if s["type"] not in ("NFC", "Replace", "Lowercase"):
                raise ValueError(f"unknown normalizer {s['type']}")
        self.normalizer = tokenizers.Tokenizer.from_str(spec).normalizer if steps else None
        self.exceptions = exceptions
        self.exceptional = re.compile(_ranges(sorted(exceptions))) if exceptions else None
        split, level = d["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("unknown pre-tokenizer")
        self.split = regex.compile(_unicode(split["pattern"]["Regex"]))
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"]):
            raise ValueError("unknown kind of added token")
        special = sorted((t["content"] for t in d["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        vocab, shown, end = model["vocab"], byte_symbols(), model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab.get(c, -1) for c in shown], dtype=np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in shown], dtype=np.int64)
        self.base = max(vocab.values()) + 2
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def surviving(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        raw = [t.encode() for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), sizes)
        symbols = self.inner[ids]
        ends = np.cumsum(sizes) - 1
        ends = ends[sizes > 0]
        symbols[ends] = self.last[ids[ends]]
        keep = symbols >= 0  # what the vocabulary lacks is left out
        symbols, owner = symbols[keep], owner[keep]
        counts = np.bincount(owner, minlength=len(raw))
        rank = np.where(owner[:-1] == owner[1:], self._rank(symbols[:-1], symbols[1:]), _NONE) if len(symbols) > 1 else np.zeros(0, np.int64)
        while len(rank) and (rank < _NONE).any():
            # only sequences that can still merge stay in the array
            live = np.zeros(len(raw), bool)
            live[owner[:-1][rank < _NONE]] = True
            keep = live[owner]
            symbols, owner = symbols[keep], owner[keep]
            rank = np.where(owner[:-1] == owner[1:], self._rank(symbols[:-1], symbols[1:]), _NONE)
            lowest = np.full(len(raw), _NONE)
            np.minimum.at(lowest, owner[:-1], rank)
            hit = (rank < _NONE) & (rank == lowest[owner[:-1]])
            # of hits that overlap, as in a run of one letter, every second one from the left
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            counts -= np.bincount(owner[at], minlength=len(raw))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
            rank = np.where(owner[:-1] == owner[1:], self._rank(symbols[:-1], symbols[1:]), _NONE)
        return counts

    def pre_tokens(self, text: str) -> list[str]:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if text.isascii() or not self.exceptional or not self.exceptional.search(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.exceptions))]

    def count(self, texts: list[str | None]) -> list[int]:
        totals, parts = [], []
        for t in texts:
            n, found = 0, []
            if t:
                pieces = self.special.split(t) if self.special else [t]
                n = len(pieces) - 1
                for p in pieces:
                    if p:
                        found += self.pre_tokens(p)
            totals.append(n)
            parts.append(found)
        if len(self.known) > HELD:
            self.known.clear()
        known = self.known
        new = list({w for found in parts for w in found if w not in known})
        for i in range(0, len(new), 1 << 16):
            some = new[i : i + (1 << 16)]
            known.update(zip(some, self.surviving(some).tolist(), strict=True))
        return [n + sum(map(known.__getitem__, found)) for n, found in zip(totals, parts, strict=True)]


def _ranges(points: list[int]) -> str:
    """A character class of sorted code points."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]"


def _unicode(pattern: str) -> str:
    """White space is what Unicode calls so."""
    return pattern.replace(r"\s", r"\p{White_Space}")


def _counter(handed, limit: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(handed, BpeCounter)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                texts = b.column(1).to_pylist()
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return counts


def count_tokens(docs: DataFrame, spec: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_bytes, n_tokens, over_limit). spec is the content of a tokenizers file, of a few
    megabytes; it is handed to every worker once."""
    exceptions = class_exceptions()
    BpeCounter((spec, exceptions))  # refuse here what the workers would
    handed = docs.sparkSession.sparkContext.broadcast({"content": (spec, exceptions)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(_counter(handed, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op8_token_count(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of all documents; path is the tokenizers file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return count_tokens(read_table(spark, sf_dir, "documents"), spec)
