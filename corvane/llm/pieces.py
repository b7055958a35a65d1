"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each position its output links give every piece that ends there; each such piece is
a link from its start to this position, and the best way to reach the position is kept (Viterbi). What "best" means
comes from the model:

* unigram models: the largest sum of piece scores; ties go to the longer last piece;
* BPE models: their scores are merge ranks, and a largest sum of ranks is not what the library computes. The links are
  the same, but one is taken only if its piece and the piece before it would not be merged otherwise. Exactly one
  last piece then remains at each position, and the result is the merge result.

Characters that are no piece become byte pieces if the model has them, else the unknown piece.

No piece has a blank after its first letter, so a text is cut before each run of blanks. Distinct parts are remembered;
new ones go through the automaton many at a time, one byte of each in a step of array operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct parts that are remembered; the memory is emptied when it is full, so it stays bounded.
REMEMBER = 600_000
#: Longer parts are encoded anew each time.
LONGEST = 64
#: Bytes of parts that go through the automaton together.
TOGETHER = 1 << 20

_START, _BARE = -1, -2  # before the first piece; a character that is no piece
_PAIRS = 21  # the table of known pairs has 2^21 places


class PieceModel:
    """Pieces, scores and types of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        rows = [(sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i), special(i)) for i in range(sp.get_piece_size())]
        self._load(rows, sp.unk_id(), _is_bpe(path))

    @classmethod
    def of(cls, pieces: list[tuple[str, float, bool, bool]], unk: int = 0, bpe: bool = False) -> PieceModel:
        """A model from (piece, score, is byte, is special) rows."""
        out = cls.__new__(cls)
        out._load(pieces, unk, bpe)
        return out

    def _load(self, pieces: list[tuple[str, float, bool, bool]], unk: int, bpe: bool) -> None:
        self.bpe, self.unk = bpe, unk
        self.ids = {p: i for i, (p, _, byte, special) in enumerate(pieces) if not byte and not special and p}
        self.texts = [p for p, *_ in pieces]
        self.scores = np.array([s for _, s, _, _ in pieces], np.float64)
        self.bytes = np.full(256, unk, np.int32)
        for i, (p, _, byte, _) in enumerate(pieces):
            if byte:
                self.bytes[int(p[3:5], 16)] = i
        self.has_bytes = any(byte for _, _, byte, _ in pieces)
        self.bare_score = min((float(self.scores[i]) for i in self.ids.values()), default=0.0) - 10.0
        self._build()
        whole = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.cut: Callable[[str], list[str]] = re.compile(" *[^ ]+| +").findall if whole else (lambda s: [s] if s else [])
        self.known: dict[str, bytes] = {}
        self._keys, self._fit = np.zeros(1 << _PAIRS, np.uint64), np.zeros(1 << _PAIRS, bool)
        #: what a piece decodes to
        self.out = [p.replace(SPACE, " ").encode() for p in self.texts]
        for i, (p, _, byte, special) in enumerate(pieces):
            if special:
                self.out[i] = " ⁇ ".encode() if i == unk else b""
            if byte:
                self.out[i] = bytes([int(p[3:5], 16)])

    # -- the automaton

    def _build(self) -> None:
        """Aho-Corasick over the pieces' UTF-8 bytes, as a full table of next states."""
        child: list[dict[int, int]] = [{}]
        piece = [-1]
        for p, i in self.ids.items():
            at = 0
            for b in p.encode():
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                    piece.append(-1)
                at = child[at][b]
            piece[at] = i
        n = len(child)
        self.piece = np.array(piece, np.int32)
        self.length = np.array([len(t.encode()) for t in self.texts], np.int32)
        #: for each state, the longest proper suffix state that is a piece (0: none)
        self.link = np.zeros(n, np.int32)
        self.next = np.zeros((n, 256), np.int32)
        fail, queue = [0] * n, list(child[0].values())
        for b, c in child[0].items():
            self.next[0, b] = c
        for s in queue:
            f = fail[s]
            self.link[s] = f if piece[f] >= 0 else self.link[f]
            self.next[s] = self.next[f]
            for b, c in child[s].items():
                fail[c] = int(self.next[f, b])
                self.next[s, b] = c
                queue.append(c)

    def solve(self, parts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of escaped parts, all read side by side."""
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        size = np.array([len(parts[i]) for i in order])
        if not len(size) or not size[0]:
            return [np.zeros(0, np.int32) for _ in parts]
        width = int(size[0])
        grid = np.frombuffer(b"".join(parts[i].ljust(width + 1, b"\0") for i in order), np.uint8).reshape(-1, width + 1)
        rows = np.arange(len(order))
        last = np.full((len(order), width + 1), _BARE, np.int32)
        last[:, 0] = _START
        back = np.zeros((len(order), width + 1), np.int32)
        score = None if self.bpe else np.zeros((len(order), width + 1))
        state, begin = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        live = np.searchsorted(-size, -np.arange(1, width + 1), side="right")
        for j in range(1, width + 1):
            a = live[j - 1]
            fresh = (grid[:a, j - 1] & 0xC0) != 0x80
            begin[:a][fresh] = j - 1
            state[:a] = self.next[state[:a], grid[:a, j - 1]]
            back[:a, j] = j - 1  # inside a character, or as bare bytes
            r = rows[:a][(grid[:a, j] & 0xC0) != 0x80]
            if score is not None:
                score[r, j] = score[r, begin[r]] + self.bare_score
            node = state[r]
            node = np.where(self.piece[node] >= 0, node, self.link[node])
            while True:
                on = node > 0
                if not on.any():
                    break
                r, node = r[on], node[on]
                ids = self.piece[node]
                start = j - self.length[ids]
                if score is None:
                    take = (start == begin[r]) | self._fits(last[r, start], ids)
                    rest = ~take
                else:
                    value = score[r, start] + self.scores[ids]
                    one = start == begin[r]
                    # a character that is a piece is never bare
                    take = (value > score[r, j]) | (one & (last[r, j] == _BARE))
                    rest = slice(None)
                    score[r[take], j] = value[take]
                last[r[take], j] = ids[take]
                back[r[take], j] = start[take]
                r, node = r[rest], self.link[node[rest]]
        return self._trace(order, size, grid, last, back)

    def _trace(self, order, size, grid, last, back) -> list[np.ndarray]:
        rows, at = np.arange(len(order)), size.copy()
        found, who = [], []
        while len(rows):
            ids = last[rows, at]
            bare = ids == _BARE
            ids[bare] = self.bytes[grid[rows[bare], at[bare] - 1]]
            found.append(ids)
            who.append(rows)
            at = back[rows, at]
            on = at > 0
            rows, at = rows[on], at[on]
        ids, who = np.concatenate(found[::-1]), np.concatenate(who[::-1])
        by = np.argsort(who, kind="stable")
        split = np.split(ids[by], np.cumsum(np.bincount(who, minlength=len(order)))[:-1])
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(order)
        for k, i in enumerate(order):
            out[i] = split[k]
            if not self.has_bytes:  # neighbouring unknown characters are one unknown piece
                out[i] = out[i][np.r_[True, (out[i][1:] != self.unk) | (out[i][:-1] != self.unk)]]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves exactly the pieces a, b of their joined letters (or b alone at the start)."""
        out = np.ones(len(a), bool)
        ask = np.flatnonzero(a != _BARE)
        keys = (a[ask] + 2).astype(np.uint64) << np.uint64(32) | b[ask].astype(np.uint64)
        at = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIRS)
        got = self._fit[at]
        miss = np.flatnonzero(self._keys[at] != keys)
        if len(miss):
            new, first, where = np.unique(keys[miss], return_index=True, return_inverse=True)
            value = np.array([self._fit_of(int(a[ask[miss[f]]]), int(b[ask[miss[f]]])) for f in first])
            got[miss] = value[where]
            self._keys[at[miss[first]]], self._fit[at[miss[first]]] = new, value
        out[ask] = got
        return out

    def _fit_of(self, a: int, b: int) -> bool:
        pieces = ([] if a == _START else [self.texts[a]]) + [self.texts[b]]
        return self.merged("".join(pieces)) == pieces

    def merged(self, s: str) -> list[str]:
        """Byte-pair merging by definition: always the best-scored adjacent pair, the leftmost of equals."""
        ids, scores = self.ids, self.scores
        sym, nxt, prv = list(s), [*range(1, len(s)), -1], [-1, *range(len(s) - 1)]

        def pair(i: int):
            j = nxt[i]
            k = ids.get(sym[i] + sym[j]) if j >= 0 else None
            return None if k is None else (-scores[k], i, sym[i] + sym[j])

        heap = [x for i in range(len(s)) if (x := pair(i))]
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            if not sym[i] or nxt[i] < 0 or sym[i] + sym[nxt[i]] != joined:
                continue
            j = nxt[i]
            sym[i], sym[j], nxt[i] = joined, "", nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for k in (i, prv[i]):
                if k >= 0 and (x := pair(k)):
                    heappush(heap, x)
        return [x for x in sym if x]

    # -- encoding

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text as little-endian int32."""
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        cut = [self.cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        long: dict[str, bytes] = {}
        todo = [p for p in {p for parts in cut for p in parts} if p not in known]
        todo.sort(key=len)
        while todo:
            n = 1
            while n < len(todo) and (n + 1) * len(todo[n]) <= TOGETHER:
                n += 1
            group, todo = todo[:n], todo[n:]
            for p, ids in zip(group, self._parts(group), strict=True):
                (known if len(p) <= LONGEST else long)[p] = ids.astype("<i4").tobytes()
        if long:
            return [b"".join([known[p] if p in known else long[p] for p in parts]) for parts in cut]
        return [b"".join([known[p] for p in parts]) for parts in cut]

    def _parts(self, parts: list[str]) -> list[np.ndarray]:
        if self.bpe:  # pieces of blanks alone share one rank, which leaves their order to the merges
            odd = {p for p in parts if p.startswith("  ")}
            out = dict(zip(plain := [p for p in parts if p not in odd], self.solve([_escape(p) for p in plain]), strict=True))
            for p in odd:
                ids = [[self.ids[x]] if x in self.ids else self.bytes[list(x.encode("utf-8", "replace"))] for x in self.merged(p.replace(" ", SPACE))]
                out[p] = np.concatenate(ids).astype(np.int32)
            return [out[p] for p in parts]
        return self.solve([_escape(p) for p in parts])

    # -- decoding

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD."""
        out = self.out
        text = b"".join([out[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _escape(part: str) -> bytes:
    return part.replace(" ", SPACE).encode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> PieceModel:
    """The model of a file, once per Python worker."""
    return PieceModel(path)


def _is_bpe(path: str) -> bool:
    """The model type in the model file (protocol buffer: field 2 is the trainer's message, its field 3 the type)."""
    with open(path, "rb") as f:
        data = f.read()
    for field, value in _fields(data):
        if field == 2:
            return dict(_fields(value)).get(3, 1) == 2
    return False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, piece_ids array<int>, n_pieces, round_trip for every row of ``docs(doc_id, text)``.

    ``round_trip`` tells whether decoding the ids gives the text again (a literal U+2581 counts as the blank that it
    stands for in the model). Null and empty texts have no pieces. Repeated rows and null ids are encoded like any
    other; an empty table gives no rows; other columns are not looked at. Memory: one Arrow batch and a bounded store
    of distinct parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch = whole.slice(lo, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                raw = model.encode(texts)
                arrays = [np.frombuffer(r, "<i4") for r in raw]
                back = [model.decode(a) == t.replace(SPACE, " ") for a, t in zip(arrays, texts, strict=True)]
                ends = np.cumsum([0, *map(len, arrays)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), ids, pa.array(np.diff(ends), pa.int64()), pa.array(back)],
                    ["doc_id", "piece_ids", "n_pieces", "round_trip"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(
        run, f"doc_id {kind}, piece_ids array<int>, n_pieces long, round_trip boolean"
    )
