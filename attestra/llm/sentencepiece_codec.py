"""Operator 3, SentencePiece encoding and decoding: streaming Viterbi over the pieces of a .model file.

The segmentation is built from left to right over a lattice whose arcs are pieces. An automaton, built as texts need it,
names the arcs that end at a place, longest first. Only a window is kept: for each place in it the surviving way back.
When the ways back of all places from which a piece can still go on meet in one boundary, whatever follows keeps what
lies before it, so its ids are committed and forgotten. Between two characters that stand side by side in no piece all
ways meet by construction; what lies between two such boundaries is a run, and a worker remembers what it has committed
for a run. Every run that it does not know goes through the window.

Weights: a unigram model's arcs weigh its own scores, in whole millionths, ties going to the longer last piece. A model
of merges holds no scores but an order of merges. There an arc may follow another only if merging the text of both
leaves just these two, and all arcs weigh the same. A sequence of pieces is what merging gives for its text if and only
if that holds for all its neighbours: merges inside two neighbours come in the same order whatever stands around them,
so the first merge across a boundary would show in that pair alone. So each place has exactly one way back, the last
piece of what merging gives for the text up to there, and the ids are the library's. A character without a piece is a
symbol of its own, becoming its UTF-8 bytes where the model has byte pieces, else the unknown id; in a unigram model it
costs more than any piece.

Defined results: null text is empty and gives no ids; decode(encode(text)) is the text wherever the model has byte
pieces, texts that contain the space mark itself apart, which decode to spaces; repeated rows each give their row; an
empty table gives no rows; other columns are kept, one named like a result (token_ids, n_commits, decoded, restored) is
replaced by it.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import held, read_table, ship

ship(__name__)

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of runs whose ids a worker remembers; beyond that it starts anew.
HELD_CHARS = 6_000_000
#: Steps between states, and pairs of symbols, that it remembers; beyond that it starts anew.
HELD_STEPS = 1_000_000
_FIRST = 2**31
_FREE = None  # the symbol before a boundary that no piece crosses


class _Memory(dict):
    """What make(key) gave, by key."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out


class Codec:
    """Encoder and decoder for the content of a .model file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        own = [sp.get_score(i) for i in plain]
        self.merges = all(float(s).is_integer() for s in own)
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.text = {i: pieces[i] for i in plain}
        self.size = {i: len(p) for i, p in self.text.items()}
        #: place in the order of merges, for a model of merges
        self.order = {pieces[i]: -s for i, s in zip(plain, own, strict=True)} if self.merges else {}
        millionths = [round(1e6 * s) for s in own]
        self.unknown = sp.unk_id()
        self.penalty = min(millionths) - 10_000_000
        self.reach = max(len(pieces[i]) for i in plain)
        # trie: character -> [children, (id, weight) or None]
        self.trie: dict = {}
        for i, s in zip(plain, millionths, strict=True):
            node = self.trie
            for c in pieces[i][:-1]:
                node = node.setdefault(c, [{}, None])[0]
            node.setdefault(pieces[i][-1], [{}, None])[1] = (i, s)
        self.pairs = {p[i : i + 2] for p in self.text.values() for i in range(len(p) - 1)}
        self.parts = self._first_cut()
        spoken = [b""] * n
        for i, p in self.text.items():
            spoken[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            spoken[i] = bytes([b])
        if self.unknown >= 0:
            spoken[self.unknown] = " ⁇ ".encode()
        self.spoken = spoken
        #: what has been committed for a run: its ids, four bytes each, the first one of each commit less 2**31
        self.known = _Memory(self._streamed)
        self.held_chars = 0
        #: by symbol: the symbols before it, and whether it may follow them
        self.stays: dict[int, dict[int | None, bool]] = {}
        self.states: dict[str, tuple[dict, list, str]] = {}
        self.steps = 0

    def _first_cut(self) -> re.Pattern:
        """Cuts a text of space marks and other characters at boundaries that no piece crosses, as far as classes of
        characters tell: at characters of no longer piece, before marks, and between a letter or digit and what is
        neither. A part may have more such boundaries."""
        bound = {c for p in self.pairs for c in p} - {MARK}
        letters = {c for c in bound if c.isalnum()}
        others = bound - letters
        of = lambda chars: "".join(map(re.escape, sorted(chars)))
        if any(p[1] == MARK for p in self.pairs if p[0] != MARK) or not letters or not others:
            return re.compile(f"[{of(bound | {MARK})}]+|[\\s\\S]")
        after = f"[{of(others)}]*[{of(letters)}]*"
        if any(p[0] in letters and p[1] in others for p in self.pairs):
            after = f"[{of(bound)}]*"
        return re.compile(f"{MARK}+{after}|(?=[{of(bound)}]){after}|[\\s\\S]")

    def _stay(self, left: int, right: int) -> bool:
        """Whether merging the text of two symbols, earliest merge first and from the left, leaves just these two: whether
        no merge goes across. A symbol is an id, or ~code point of a character without a piece."""
        a, b = (self.text[x] if x >= 0 else chr(~x) for x in (left, right))
        rank, symbols, edge = self.order.get, [*a, *b], len(a)
        ranks = [rank(x + y, math.inf) for x, y in itertools.pairwise(symbols)]
        while True:
            best = min(ranks)
            if best == math.inf:
                return True
            k = ranks.index(best)
            if k == edge - 1:
                return False
            if k < edge:
                edge -= 1
            symbols[k : k + 2] = merged, = (symbols[k] + symbols[k + 1],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank(symbols[k - 1] + merged, math.inf)
            if k < len(ranks):
                ranks[k] = rank(merged + symbols[k + 1], math.inf)

    def _state(self, held: str) -> tuple[dict, list, str]:
        """What matters of a text whose longest end that starts a piece is held, or whose last character is: the states
        after it by their characters, filled as they come up, and the arcs that end here, longest first. An arc: how
        many places ago it begins, its symbol, and its weight or, with merges, whether it may follow a symbol, as far
        as that is known."""
        state = self.states.get(held)
        if state is None:
            arcs = []
            for k in range(len(held)):
                entry = self._entry(held[k:])
                own = entry and entry[1] or (None if k < len(held) - 1 else (~ord(held[k]), self.penalty))
                if own:
                    arcs.append((k - len(held), own[0], self.stays.setdefault(own[0], {_FREE: True}) if self.merges else own[1]))
            state = self.states[held] = {}, arcs, held
        return state

    def _entry(self, head: str) -> list | None:
        """The trie's entry for a text that starts a piece."""
        node, entry = self.trie, None
        for c in head:
            entry = node.get(c)
            if entry is None:
                return None
            node = entry[0]
        return entry

    def _next(self, held: str, c: str) -> tuple[dict, list, str]:
        """The state after character c in state held."""
        went, held = self._state(held)[0], held + c
        while len(held) > 1 and self._entry(held) is None:
            held = held[1:]
        out = went[c] = self._state(held)
        self.steps += 1
        return out

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text of space marks and letters, in the runs in which they are committed."""
        reach, pairs, merges = self.reach, self.pairs, self.merges
        block = 4 * reach
        buffer = iter(chars)
        window = list(itertools.islice(buffer, block))
        n, ended = len(window), len(window) < block
        piece, score = [_FREE], [0]  # of each place up to pos: the last symbol, and the weight
        start = pos = first = 0  # what lies before start is committed, and forgotten before first
        go, _, held = self._state("")
        while True:
            if n - pos < reach and not ended:
                if start - first > 16 * reach:
                    drop, first = start - reach, reach
                    window, piece, score = window[drop:], piece[drop:], score[drop:]
                    pos, start = pos - drop, reach
                more = list(itertools.islice(buffer, block))
                ended = len(more) < block
                window += more
                n = len(window)
            if pos == n:
                break
            stop = min(n if ended else n - reach + 1, pos - pos % reach + reach)
            for c in window[pos:stop]:
                try:
                    go, arcs, held = go[c]
                except KeyError:
                    go, arcs, held = self._next(held, c)
                if held == c:
                    pos = len(piece) - 1
                    if pos and window[pos - 1] + c not in pairs:  # no piece goes across: all ways meet here
                        if pos > start:
                            yield self._ids(window, piece, pos, start)
                        start, piece[pos] = pos, _FREE
                if merges:
                    for ago, symbol, fits in arcs:
                        last = piece[ago]
                        try:
                            fit = fits[last]
                        except KeyError:
                            fit = fits[last] = self._stay(last, symbol)
                            self.steps += 1
                        if fit:
                            piece.append(symbol)
                            break
                else:
                    most, best = -math.inf, _FREE
                    for ago, symbol, weight in arcs:
                        if score[ago] + weight > most:
                            most, best = score[ago] + weight, symbol
                    score.append(most)
                    piece.append(best)
            pos = stop
            if pos - start >= 2 * reach and not pos % reach:
                cut = self._meeting(window, piece, score, pos, start)
                if cut > start:
                    yield self._ids(window, piece, cut, start)
                    start = cut
        if n > start:
            yield self._ids(window, piece, n, start)

    def _meeting(self, window: list[str], piece: list[int], score: list[int], pos: int, start: int) -> int:
        """The last boundary through which the ways back go, from pos and from all places beyond it that arcs from before
        it reach."""
        best: dict[int, tuple[float, int]] = {}
        for at in range(pos + 1 - self.reach, pos):
            node, j = self.trie, at
            while j < len(window) and (entry := node.get(window[j])) is not None:
                j += 1
                node, own = entry
                if j > pos and own:
                    if not self.merges:
                        if j not in best or score[at] + own[1] > best[j][0]:
                            best[j] = score[at] + own[1], at
                    elif j not in best and self._stay(piece[at], own[0]):
                        best[j] = 0, at
        fronts = {at for _, at in best.values()} | {pos}
        while len(fronts) > 1:
            far = max(fronts)
            if far <= start:
                return start
            fronts.remove(far)
            fronts.add(far - self.size.get(piece[far], 1))
        return fronts.pop()

    def _ids(self, window: list[str], piece: list[int], end: int, start: int) -> list[int]:
        out, size = [], self.size
        while end > start:
            symbol = piece[end]
            if symbol >= 0:
                out.append(symbol)
                end -= size[symbol]
            else:
                end -= 1
                if self.bytes:
                    out += [self.bytes[b] for b in reversed(window[end].encode())]
                else:
                    out.append(self.unknown)
        out.reverse()
        return out

    def _streamed(self, part: str) -> bytes:
        """What stream() commits for a part: for what lies between two boundaries that no piece crosses, each by itself."""
        self.held_chars += len(part)
        if self.pairs.issuperset(map(operator.add, part, part[1:])):
            ids = []
            for run in self.stream(part):
                run[0] -= _FIRST
                ids += run
            return array("i", ids).tobytes()
        cuts = [i for i, pair in enumerate(map(operator.add, part, part[1:]), 1) if pair not in self.pairs]
        return b"".join([self.known[part[i:j]] for i, j in itertools.pairwise([0, *cuts, len(part)])])

    def encode_counted(self, text: str | None) -> tuple[bytes, int]:
        """encode() as little-endian numbers of four bytes, and in how many commits they came."""
        if not text:
            return b"", 0
        if self.held_chars > HELD_CHARS:
            self.known.clear()
            self.held_chars = 0
        if self.steps > HELD_STEPS:
            self.states.clear()
            self.stays.clear()
            self.steps = 0
        found = map(self.known.__getitem__, self.parts.findall(MARK + text.replace(" ", MARK)))
        ids = np.frombuffer(b"".join(found), np.int32)
        return (ids & (_FIRST - 1)).tobytes(), int(np.count_nonzero(ids < 0))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_counted(text)[0], np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.spoken.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _encoder(handed, checked: bool):
    """Adds token_ids and n_commits, and with checked whether decoding gives the text back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(handed, Codec)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                texts = b.column(b.num_columns - 1).to_pylist()
                found = [codec.encode_counted(t) for t in texts]
                more, names = [_lists([x for x, _ in found]), pa.array([n for _, n in found], pa.int64())], ["token_ids", "n_commits"]
                if checked:
                    same = [codec.decode(np.frombuffer(x, np.int32).tolist()) == (t or "") for (x, _), t in zip(found, texts, strict=True)]
                    more, names = [*more, pa.array(same, pa.bool_())], [*names, "restored"]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    return encode


def _decoder(handed):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(handed, Codec)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                texts = [codec.decode(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return decode


def _mapped(df: DataFrame, last: str, function, added: dict[str, T.DataType], model: bytes) -> DataFrame:
    """df with what function makes of column last, which the function sees at the end."""
    Codec(model)  # refuse here what the workers would
    rows = df.select(*[c for c in df.columns if c != last and c not in added], last)
    handed = df.sparkSession.sparkContext.broadcast({"content": model})
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, v) for k, v in added.items()]])
    return rows.mapInArrow(function(handed), schema)


_IDS = {"token_ids": T.ArrayType(T.IntegerType()), "n_commits": T.LongType()}


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (text, ...) with token_ids array<int> and n_commits, in how many commits they came. model is the content of a
    .model file, of a few megabytes."""
    return _mapped(docs, "text", lambda handed: _encoder(handed, False), _IDS, model)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded (token_ids, ...) with decoded string."""
    return _mapped(encoded, "token_ids", _decoder, {"decoded": T.StringType()}, model)


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (text, ...) with token_ids, n_commits and restored: whether decoding them gives the text (null: empty) back.
    Encoder and decoder run in one pass, so texts go to the workers once."""
    return _mapped(docs, "text", lambda handed: _encoder(handed, True), _IDS | {"restored": T.BooleanType()}, model)


def model_bytes(path: str | None = None) -> bytes:
    """The content of a .model file; MODEL of the public tokenizers by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def op3_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of all documents, and whether decoding gives each text back; path is the .model file."""
    out = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model_bytes(path))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_ids"), "n_commits", F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"), "restored")
