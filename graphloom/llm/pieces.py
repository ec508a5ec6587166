"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

A model is compiled once, into three machines. The normaliser is a sequential transducer: a
trie of the texts that it rewrites, the longest match first. The pieces are arcs from text to
ids with weights. Byte fallback is an arc for each character that is no piece, from the
character to the ids of its bytes (or to the unknown id). Composed with an input, normaliser
first, this is a lattice over the places between characters, and the encoding is its path of
least weight in the tropical semiring (min, +), found place by place.

- Unigram models: an arc weighs minus its piece's score; a fallback arc, ten more than the
  worst piece.
- Byte-pair models order their merges and have no additive score. Their encodings are the
  sequences in which every two neighbours stay apart when the merges are run on the two
  alone, so a state is (place, last piece), arcs weigh 0, and a step weighs 1 if its piece may
  not follow the last one. Which pairs may is found from the merges once per pair. Every text
  has one path of weight 0, so a place needs its lightest state only.

User-defined pieces are cut out of the text first, the longest at each place: no rewriting and
no other arc crosses them. Texts are further cut where no arc can cross: between characters
that stand side by side in no piece. The parts recur, and each worker keeps their paths in a
bounded table.

Defined cases: null gives null; an empty text has no ids; any Unicode text, white space
and control characters included, is encoded; repeated rows get equal ids; a text of any
length is done whole; an empty table has no rows; extra columns are kept, but ids and decoded
take the place of input columns of these names.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow, named, others, packed, unpacked
from graphloom.llm.textbytes import mixed

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Paths that a worker keeps in each of two tables, the young and the old.
KEPT = 300_000
LONG = 64  # longer words are cut further, and not kept
BATCH_CHARS = 400_000
MOST_SLOTS = 1 << 22
MODEL_BYTES = 64 << 20  # greatest model that is sent to the executors


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


def _rewrites(charsmap: bytes) -> dict[bytes, bytes]:
    """The normaliser's arcs: every key of its double-array trie with its replacement."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
    texts = charsmap[4 + size :]
    out: dict[bytes, bytes] = {}

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    todo = [(offset(units[0]), b"")]
    while todo:
        node, key = todo.pop()
        for label in range(1, 256):
            child = node ^ label
            if child < len(units) and units[child] & (1 << 31 | 255) == label:
                unit, word = units[child], key + bytes([label])
                below = child ^ offset(unit)
                if unit >> 8 & 1:
                    value = units[below] & ((1 << 31) - 1)
                    out[word] = texts[value : texts.index(b"\0", value)]
                todo.append((below, word))
    return out


class Table:
    """Numbers to numbers, looked up many at once (open addressing). Without an entry the
    answer is -1 or, if `judge` is given, what it says, which is then kept."""

    def __init__(self, judge: Callable[[int], int] | None = None, size: int = 1 << 17) -> None:
        self.judge = judge
        self._clear(size)

    def _clear(self, size: int) -> None:
        self.keys, self.values, self.used = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.keys) - 1
        slots = (mixed(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
        going = np.arange(len(keys))
        while len(going):
            here = self.keys[slots[going]]
            going = going[(here != keys[going]) & (here != -1)]
            slots[going] = (slots[going] + 1) & mask
        return slots

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not in the table, each once."""
        while 2 * (self.used + len(keys)) >= len(self.keys):
            full, old_keys, old_values = self.keys >= 0, self.keys, self.values
            grown = 4 * len(old_keys) <= MOST_SLOTS
            self._clear(4 * len(old_keys) if grown else len(old_keys))
            if grown:
                self.put(old_keys[full], old_values[full])
            elif 2 * len(keys) >= len(self.keys):
                raise MemoryError("more keys at once than the table holds")
        self.used += len(keys)
        while len(keys):
            slots = self._slots(keys)
            self.keys[slots] = keys  # of several keys in a slot one stays
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values = keys[~won], values[~won]

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        if self.judge:
            new = keys[self.keys[slots] == -1]
            if len(new):
                new = np.unique(new)
                self.put(new, np.array([self.judge(key) for key in new.tolist()], dtype=np.int64))
                slots = self._slots(keys)
        return self.values[slots]


class Transducer:
    def __init__(self, model: bytes) -> None:
        self.kind, self.dummy_prefix, self.trim, self.escape, charsmap = 1, True, True, True, b""
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        self._compile_normaliser({k.decode(): v.decode() for k, v in _rewrites(charsmap).items()})
        self.arcs = {p: k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.arcs), default=1)
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = next((k for k, t in enumerate(self.types) if t == UNKNOWN), 0)
        # weights of the arcs by id; ids from len(pieces) on are characters' fallback arcs
        worst = min((self.scores[k] for k in self.arcs.values()), default=0.0)
        self.weights = -np.append(np.array(self.scores, dtype=np.float64), worst - 10) if self.kind == 1 else np.zeros(len(self.pieces) + 1)
        user = sorted((p for p, t in zip(self.pieces, self.types, strict=True) if t == USER and p), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        # characters that stand side by side in a piece; others can be cut apart
        self.side = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        words_apart = not any(b == SPACE and a != SPACE for a, b in self.side)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if words_apart else "(?s:.+)").findall
        self.lengths = np.array([len(p) for p in self.pieces])
        self.pairs = Table(self.may_follow)
        self.old: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        #: The greatest weight of a byte-pair path so far; above 0 the merges admit no such path.
        self.heaviest = 0.0
        self._compile_trie()
        self.texts = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]

    def _compile_trie(self) -> None:
        """The pieces' arcs; of a byte-pair model those that their own text becomes, as no other
        is ever in a path."""
        self.trie, nodes = Table(), 1
        step: dict[int, int] = {}
        ending = [-1]
        #: The piece of each single character; with one, a character has no fallback arc.
        self.single = np.full(sys.maxunicode + 1, -1, dtype=np.int32)
        for piece, k in self.arcs.items():
            if len(piece) == 1:
                self.single[ord(piece)] = k
            if self.kind == 2 and self.merged(piece) != [piece]:
                continue
            node = 0
            for c in piece:
                child = step.get(node << 21 | ord(c))
                if child is None:
                    child = step[node << 21 | ord(c)] = nodes
                    nodes += 1
                    ending.append(-1)
                node = child
            ending[node] = k
        self.trie.put(np.array(list(step), dtype=np.int64), np.array(list(step.values()), dtype=np.int64))
        self.ending = np.array(ending, dtype=np.int64)

    def _compile_normaliser(self, rewrites: dict[str, str]) -> None:
        """States of the normaliser: (state, character) -> state; state -> text it puts out."""
        self.rewrite_step: dict[tuple[int, str], int] = {}
        self.rewrite_out: dict[int, str] = {}
        for text, to in rewrites.items():
            state = 0
            for c in text:
                state = self.rewrite_step.setdefault((state, c), len(self.rewrite_step) + 1)
            self.rewrite_out[state] = to

    def _rewritten(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            state, k, put, end = 0, at, text[at], at + 1  # without a match a character passes
            while k < len(text) and (state := self.rewrite_step.get((state, text[k]))) is not None:
                k += 1
                if state in self.rewrite_out:
                    put, end = self.rewrite_out[state], k
            out.append(put)
            at = end
        return "".join(out)

    def normalised(self, text: str) -> str:
        if self.rewrite_step:
            kept = [(m.start(), m.end()) for m in self.user.finditer(text)] if self.user else []
            done, at = [], 0
            for a, b in kept:
                done += [self._rewritten(text[at:a]), text[a:b]]
                at = b
            text = "".join([*done, self._rewritten(text[at:])])
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = f" {text}"
        return text.replace(" ", SPACE) if self.escape else text

    def _parts(self, text: str) -> list[str]:
        """The normalised text in parts that no arc crosses."""
        text = self.normalised(text)
        out, at = [], 0
        for m in self.user.finditer(text) if self.user else ():
            out += [*self._words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._words(text[at:] if at else text)

    def _words(self, text: str) -> list[str]:
        return [p for w in self.split(text) for p in ((w,) if len(w) <= LONG else self._cut(w))]

    # -- byte-pair models: which pieces may stand side by side -------------------------

    def merged(self, text: str) -> list[str]:
        """The merges run on a short text: best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max((( self.scores[k], -i) for i in range(len(parts) - 1) if (k := self.arcs.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, pair: int) -> int:
        """Whether two pieces, each what its own text becomes, stay apart side by side."""
        a, b = (self.pieces[k] if k < len(self.pieces) else chr(k - len(self.pieces)) for k in (pair >> 21, pair & (1 << 21) - 1))
        return int(self.merged(a + b) == [a, b])

    # -- the shortest path -------------------------------------------------------------

    def paths(self, texts: list[str]) -> list[bytes]:
        """Ids (int32) on the path of least weight of each text."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:  # in batches of bounded size
            some.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                out += self._shortest(some)
                some, size = [], 0
        return out + self._shortest(some) if some else out

    def _shortest(self, texts: list[str]) -> list[bytes]:
        """All texts' lattices at once: (min, +) over the arcs that end at the first place of
        every text, then at the second, and so on."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts])
        base = np.concatenate(([0], np.cumsum(size)))
        word = np.repeat(np.arange(len(texts)), size)
        first, end = base[word], base[word + 1]
        # arcs: the pieces that start at each place, by walking the trie from all at once
        at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        single = self.single[chars]
        starts, stops, ids = [at], [at + 1], [np.where(single >= 0, single, len(self.pieces) + chars)]
        for depth in range(1, self.longest + 1):
            inside = at + depth <= end[at]
            at, node = at[inside], node[inside]
            child = self.trie.get(node << 21 | chars[at + depth - 1])
            at, node = at[child >= 0], child[child >= 0]
            if not len(at):
                break
            piece = self.ending[node]
            # a piece of one character stands in for its fallback arc
            wanted = (piece >= 0) & (True if depth > 1 else single[at] < 0)
            starts.append(at[wanted])
            stops.append(at[wanted] + depth)
            ids.append(piece[wanted])
        start, stop, arc = np.concatenate(starts), np.concatenate(stops), np.concatenate(ids)
        place = stop - first[start]
        order = np.lexsort((start, stop, place))
        start, stop, arc, place = start[order], stop[order], arc[order], place[order]
        weight = self.weights[np.minimum(arc, len(self.pieces))]
        fresh = start == first[start]
        cuts = np.searchsorted(place, np.arange(1, size.max(initial=0) + 2))
        least = np.zeros(len(chars))  # of the paths that end behind a character
        last = np.full(len(chars), -1, dtype=np.int64)  # the lightest path's arc into there
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, k, w = start[a:b], stop[a:b] - 1, arc[a:b], weight[a:b]
            inner = np.flatnonzero(~fresh[a:b])
            if len(inner):
                w = w.copy()
                w[inner] += least[s[inner] - 1]
                if self.kind == 2:
                    w[inner] += self.pairs.get(last[s[inner] - 1] << 21 | k[inner]) != 1
            group = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            best = np.minimum.reduceat(w, group)
            hit = np.flatnonzero(w == np.repeat(best, np.diff(np.append(group, len(e)))))
            hit = hit[np.append(True, e[hit[1:]] != e[hit[:-1]])]  # of equals the longest arc
            least[e[hit]], last[e[hit]] = best, k[hit]
        if self.kind == 2 and len(chars):
            self.heaviest = max(self.heaviest, float(least.max()))
        # back from the ends
        found_word, found_step, found_id = [], [], []
        who, upto, step = np.flatnonzero(size > 0), base[1:][size > 0].copy(), 0
        while len(who):
            k = last[upto - 1]
            found_word.append(who)
            found_step.append(np.full(len(who), step))
            found_id.append(k)
            upto = upto - np.where(k < len(self.pieces), self.lengths[np.minimum(k, len(self.pieces) - 1)], 1)
            who, upto, step = who[upto > base[who]], upto[upto > base[who]], step + 1
        if not found_id:
            return [b""] * len(texts)
        w, t, k = (np.concatenate(x) for x in (found_word, found_step, found_id))
        order = np.lexsort((-t, w))
        w, k = w[order], k[order]
        edges = np.searchsorted(w, np.arange(len(texts) + 1))
        flat = k.astype(np.int32).tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for x in set(w[k >= len(self.pieces)].tolist()):  # what fallback arcs put out
            out[x] = array("i", [i for j in k[edges[x] : edges[x + 1]].tolist() for i in self._fallback(j)]).tobytes()
        return out

    def _fallback(self, arc: int) -> list[int]:
        if arc < len(self.pieces):
            return [arc]
        return [self.bytes[b] for b in chr(arc - len(self.pieces)).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _cut(self, word: str) -> list[str]:
        """A long word, cut where no piece can cross."""
        out, start = [], 0
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in self.side:
                out.append(word[start:k])
                start = k
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        parted = [None if t is None else self._parts(t) for t in texts]
        table: dict[str, bytes] = {}
        missing = []
        for word in set().union(*(p for p in parted if p)):
            ids = self.young.get(word)
            if ids is None and self.user and self.user.fullmatch(word):
                ids = array("i", [self.arcs[word]]).tobytes()
            if ids is None and (ids := self.old.get(word)) is None:
                missing.append(word)
            else:
                table[word] = self.young[word] = ids
        for word, ids in zip(missing, self.paths(missing), strict=True):
            table[word] = ids
            if len(word) <= LONG:
                self.young[word] = ids
        if len(self.young) > KEPT:  # words that recur are taken over from the old table
            self.old, self.young = self.young, {}
        out: list[np.ndarray | None] = []
        for parts in parted:
            if parts is None:
                out.append(None)
                continue
            ids = np.frombuffer(b"".join(map(table.__getitem__, parts)), dtype=np.int32)
            if not self.bytes and len(ids) > 1:  # neighbouring unknowns are one
                ids = ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))]
            out.append(ids)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model is larger than {MODEL_BYTES} bytes")
    return data


_compiled: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
    return _compiled[model]


def encoded(docs: DataFrame, model: bytes, *, text: str = "text", decode: bool = True) -> DataFrame:
    """docs with `ids` (array<int>) of the texts and, if `decode`, `decoded`, the text that
    the ids stand for."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = others(docs, "ids", "decoded")
    added = ["ids", "decoded"][: 1 + decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                ids = machine.encode_all(some.column(1).to_pylist())
                arrays = [some.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    arrays.append(pa.array([None if x is None else machine.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", *added])

    rows = docs.select(packed(own), named(text).alias("_text"))
    return in_arrow(rows, run, "ids array<int>" + ", decoded string" * decode).select(*unpacked(own), *added)


def decoded(docs: DataFrame, model: bytes, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text that the column `ids` stands for; an id outside the model is an error."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = others(docs, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(sent.value)
        for batch in batches:
            texts = [None if x is None else machine.decode(np.array(x, dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    rows = docs.select(packed(own), named(ids).cast("array<int>").alias("_ids"))
    return in_arrow(rows, run, "_text string").select(*unpacked(own), F.col("_text").alias(to))
