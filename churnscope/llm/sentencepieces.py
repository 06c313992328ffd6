"""SentencePiece encoding and decoding with a weighted finite-state transducer.

``Transducer`` compiles a SentencePiece model file:

* the normaliser: optional rewrite rules (leftmost longest), white space to
  the meta symbol, and the leading blank of a text;
* the lexicon: a prefix automaton of the pieces, whose arcs read a piece and
  write its id;
* byte fallback: a character outside the lexicon is read by an arc that
  writes the ids of its UTF-8 bytes (the unknown id if the model has none).

It is composed with the input lazily: a state is a position and the piece
that ends there, and the tropical shortest path over these states is the
encoding.  In a unigram model an arc weighs minus the piece's score.  In a
BPE model the order of merges decides, which is a property of neighbours: a
sequence of pieces is the result of the merges if and only if every pair of
neighbours is.  So the arc from piece ``s`` to piece ``t`` weighs 0 if merging
``s + t`` gives back ``s, t``, and infinity otherwise.  One state survives for
each position, any path of weight 0 is the shortest, and the search runs
backwards from the end through the arcs of weight 0, longest piece first, so
most positions are never expanded.  Pair weights are compiled on demand and
remembered.

No piece continues behind a blank that follows another character, so a text
falls into units (blanks and the characters up to the next blank) that are
composed on their own; a unit that occurs again is looked up.  If a model has
pieces across blanks the whole text is one unit.

Edge cases: a null text gives null ids, an empty text none; characters no
piece has fall back to bytes; a text of any length is encoded whole; a
literal meta symbol in a text is a blank after decoding, as in the format;
repeated rows are encoded alike; an empty table gives an empty result; other
columns can be kept, and one called like an output column is replaced.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.textblock import blocks, buffer_of, sums

#: Where the models lie, and the one of the registered query: parameters.
TOKENIZER_DIR, MODEL = "/opt/tokenizers", "piece_bpe_32k.model"
META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Units and pairs a task remembers; longer units than UNIT_CHARS are not kept.
UNITS, PAIRS, UNIT_CHARS = 250_000, 1_000_000, 64
BLOCK = 4 << 20
#: States: ids of pieces, the start, and characters outside the lexicon from OUTSIDE on.
START, OUTSIDE = (1 << 20) - 1, 1 << 20


class Transducer:
    def __init__(self, model: bytes, rules: Mapping[str, str] | None = None):
        from sentencepiece import sentencepiece_model_pb2 as format_pb2
        proto = format_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("give the normaliser of this model as rewrite rules")
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.rules = dict(rules or {})
        self.rewrite = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))) \
            if self.rules else None
        pieces = proto.pieces
        self.lexicon = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
        self.score = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p.type == UNKNOWN), 0)
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        #: the prefix automaton: a text leads to a piece's id, or to -1 on the way to one
        self.automaton: dict[str, int] = {}
        for piece, i in self.lexicon.items():
            for n in range(1, len(piece)):
                self.automaton.setdefault(piece[:n], -1)
            self.automaton[piece] = i
        self.spellings = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
            else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN
            else p.piece.replace(META, " ").encode() for p in pieces]
        self.names = {i: p for p, i in self.lexicon.items()}
        #: the same automaton read backwards, for the search from the end
        self.backward: dict[str, int] = {}
        for piece in self.lexicon:
            for n in range(1, len(piece)):
                self.backward.setdefault(piece[n:], -1)
        self.backward |= self.lexicon
        self.units_apart = not any(META in p.lstrip(META) for p in self.lexicon)
        self.pairs: dict[int, bool] = {}
        self.units: dict[bytes, bytes] = {}

    # ---- weights of a BPE model ------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text, best score and leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def name(self, state: int) -> str:
        """The piece, or the character outside the lexicon, that a state stands for."""
        return chr(state - OUTSIDE) if state >= OUTSIDE else self.names.get(state, "")

    def follows(self, one: int, two: int) -> bool:
        """Whether the arc from state ``one`` (START at the start) to ``two`` has weight 0."""
        key = one << 22 | two
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = "" if one == START else self.name(one), self.name(two)
            known = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    # ---- shortest path ---------------------------------------------------

    def path(self, text: str) -> list[int]:
        """States on the shortest path through the composition with ``text``."""
        return self.searched(text) if self.kind == BPE else self.relaxed(text)

    def searched(self, text: str) -> list[int]:
        """Depth-first from the end through arcs of weight 0 (the only path there is)."""
        backward, pairs, follows = self.backward.get, self.pairs.get, self.follows
        n = len(text)
        last = [-1] * (n + 1)   # the surviving state of a position, once known
        open_: list = [None] * (n + 1)  # its candidate arcs (begin, state), longest last
        last[0] = START
        stack = [n]
        while stack:
            i = stack[-1]
            if last[i] >= 0:
                stack.pop()
                continue
            arcs = open_[i]
            if arcs is None:
                arcs, j = [], i - 1
                while j >= 0:
                    state = backward(text[j:i])
                    if state is None:
                        break
                    if state >= 0:
                        arcs.append((j, state))
                    j -= 1
                if not arcs or arcs[0][0] != i - 1:  # the fallback arc
                    arcs.insert(0, (i - 1, OUTSIDE + ord(text[i - 1])))
                open_[i] = arcs
            j, state = arcs[-1]
            before = last[j]
            if before < 0:
                stack.append(j)
                continue
            arcs.pop()
            ok = pairs(before << 22 | state)
            if follows(before, state) if ok is None else ok:
                last[i] = state
                stack.pop()
            elif not arcs:
                raise ValueError(f"no path through {text[:50]!r}")
            open_[i] = arcs
        out, at = [], n
        while at:
            state = last[at]
            out.append(state)
            at -= 1 if state >= OUTSIDE else len(self.names[state])
        return out[::-1]

    def relaxed(self, text: str) -> list[int]:
        """Forward over all arcs, weighed by the pieces' scores."""
        n = len(text)
        cost = [0.0] + [float("inf")] * n
        last = [START] * (n + 1)
        for at in range(n):
            arcs, end = [], at + 1
            while end <= n and (state := self.automaton.get(text[at:end])) is not None:
                if state >= 0:
                    arcs.append((end, state, cost[at] - self.score[text[at:end]]))
                end += 1
            if not arcs or arcs[0][0] != at + 1:
                arcs.append((at + 1, OUTSIDE + ord(text[at]), cost[at] - self.worst))
            for end, state, total in arcs:
                if total < cost[end]:
                    cost[end], last[end] = total, state
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.name(last[at]))
        return out[::-1]

    def ids(self, states: list[int]) -> list[int]:
        out: list[int] = []
        for state in states:
            if state < OUTSIDE:
                out.append(state)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(state - OUTSIDE).encode())
            else:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        if self.rewrite is not None:
            text = self.rewrite.sub(lambda m: self.rules[m[0]], text)
        return self.prefix + text if text else ""

    def unit(self, raw: bytes) -> bytes:
        """Ids (32 bit) of a unit of a normalised text."""
        known = self.units.get(raw)
        if known is None:
            text = raw.decode().replace(" ", META)
            ids = self.path(text)
            if max(ids) >= OUTSIDE:
                ids = self.ids(ids)
            known = array("i", ids).tobytes()
            if len(text) <= UNIT_CHARS:
                if len(self.units) >= UNITS:
                    self.units.clear()
                self.units[raw] = known
        return known

    # ---- columns ---------------------------------------------------------

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text begins in them) of a column of normalised texts."""
        offsets, data = buffer_of(column)
        if self.units_apart:
            blank = data == 32
            first = blank.copy()
            first[1:] &= ~blank[:-1]
        else:
            first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(first)
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(np.concatenate((starts, [len(data)])).astype(np.int64)),
             pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known = [self.unit(t) for t in coded.dictionary.to_pylist()]
        if not known:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        heads = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"".join(known), np.int32)
        n = sizes[codes]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1])) - np.repeat(ends - n - heads[codes], n)
        return flat[take], np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]

    def decode_column(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become U+FFFD."""
        parts = pa.array(self.spellings, pa.large_binary()).take(pa.array(ids))
        ends, data = buffer_of(parts)
        raw, out = data.tobytes(), []
        for a, b in zip(offsets, offsets[1:]):
            text = raw[ends[a]:ends[b]].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


_COMPILED: dict[tuple, Transducer] = {}


def compiled(model: bytes, rules: tuple[tuple[str, str], ...]) -> Transducer:
    """The transducer of a model; a worker process compiles it once."""
    key = (hash(model), rules)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model, dict(rules))
    return _COMPILED[key]


def read_model(path: str = os.path.join(TOKENIZER_DIR, MODEL)) -> bytes:
    """A model file that the driver sees; tasks get its content (half a megabyte)."""
    with open(path, "rb") as src:
        return src.read()


def encode(df: DataFrame, model: bytes, text_column: str = "text", ids_column: str = "ids",
           rules: Mapping[str, str] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and the token ids of ``text_column``."""
    kept = [c for c in (df.columns if keep is None else keep) if c != ids_column]
    pairs = tuple(sorted((rules or {}).items()))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value, pairs)
        for block in blocks(batches, column=0, limit=BLOCK):
            raw = block.column(0)
            # the plain normaliser is one blank in front, which the plan has already put there
            texts = pa.array([None if t is None else machine.normalise(t) for t in raw.to_pylist()],
                             pa.string()) if machine.rewrite is not None else raw
            ids, offsets = machine.encode_column(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()),
                                             mask=raw.is_null() if raw.null_count else None)
            yield pa.RecordBatch.from_arrays([*block.columns[1:], lists], [*kept, ids_column])

    text = F.col(text_column).cast("string")
    if not pairs and compiled(model, pairs).prefix:
        text = F.when(text == "", text).otherwise(F.concat(F.lit(" "), text))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for c in kept for f in df.schema.fields if f.name == c]
    return (df.select(text.alias("_text"), *(F.col(f"`{c}`") for c in kept))
            .mapInArrow(run, ", ".join([*schema, f"`{ids_column}` array<int>"])))


def round_trip(df: DataFrame, model: bytes, text_column: str = "text",
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ids, n_tokens, n_bytes (tokens of byte fallback) and whether decoding
    gives the text back."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_column).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value, ())
        is_byte = np.zeros(len(machine.spellings), np.int64)
        is_byte[list(machine.bytes.values())] = 1
        for block in blocks(batches, column=0, limit=BLOCK):
            raw = block.column(0)
            ids, offsets = machine.encode_column(raw)
            decoded = machine.decode_column(ids, offsets)
            skip = len(machine.prefix)
            same = [None if t is None else t[skip:].replace(META, " ") == d
                    for t, d in zip(raw.to_pylist(), decoded)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()),
                                             mask=raw.is_null() if raw.null_count else None)
            yield pa.RecordBatch.from_arrays(
                [*block.columns[1:], lists, pa.array(np.diff(offsets)), pa.array(sums(is_byte[ids], offsets)),
                 pa.array(same, pa.bool_())], names)

    names = [*keep, "ids", "n_tokens", "n_bytes", "round_trip"]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    if compiled(model, ()).prefix:
        text = F.when(text == "", text).otherwise(F.concat(F.lit(" "), text))
    return df.select(text.alias("_text"), *keep).mapInArrow(run, ", ".join(
        [*kinds, "ids array<int>", "n_tokens long", "n_bytes long", "round_trip boolean"]))


def decode(df: DataFrame, model: bytes, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; null ids give a null text."""
    kept = [c for c in df.columns if c != text_column]
    place = kept.index(ids_column)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value, ())
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                block = batch.slice(first, 512)
                lists = block.column(place)
                sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                texts = pa.array(machine.decode_column(lists.flatten().to_numpy(), offsets), pa.string())
                if lists.null_count:
                    texts = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([*block.columns, texts], [*kept, text_column])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for c in kept for f in df.schema.fields if f.name == c]
    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(
        run, ", ".join([*schema, f"`{text_column}` string"]))
