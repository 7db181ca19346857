"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

The transducer is compiled from a model file: the normaliser (white-space escape, prefix), one arc path for each piece, and byte fallback arcs
for characters that no piece has. Composed with an input it is a lattice whose arcs are pieces; the
encoding is its shortest path in the tropical semiring (weights add along a path, the smallest path wins).

* Unigram models: an arc weighs minus the piece's score.
* BPE models: a piece's score is the order of its merge, and adding scores doesn't give what merging gives. There, the
  lattice is composed with one more acceptor that reads pairs of neighbouring pieces: weight 0 if merging the text of the pair
  gives just this pair, infinite otherwise. A sequence all of whose neighbours agree with the merges is the
  merges' own result, and each prefix has one finite path, so a state per position suffices.

No piece has the escaped space after another character, so shortest paths never cross the start of an escaped space and
the composition is done word by word; equal words are composed once for a worker (a bounded cache, kept from query to query).

Files are read from a path (a parameter) on the driver and shipped as a table of pieces: at most `MOST` of them.

Defined cases: a null text gives null ids; an empty text no ids; texts of any length are encoded whole; repeated rows are encoded
each; an empty table gives an empty result; further columns are ignored. Decoding gives the text back, except that U+2581 comes back as a space.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST = 1_000_000
#: Words and pairs of pieces that a worker keeps: about 40 MB each.
CACHED = 200_000
AGREED = 400_000
LONG = 48
SPACE = "▁"
INF = float("inf")


@dataclass
class Model:
    """What a model file says, in plain values."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    bpe: bool
    prefix: bool
    escape: bool
    trims: bool

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        n, t = proto.normalizer_spec, proto.trainer_spec
        if n.precompiled_charsmap:
            raise ValueError("only the identity character map is supported")
        if len(proto.pieces) > MOST or t.model_type not in (1, 2):
            raise ValueError("not a unigram or BPE model of a supported size")
        p = proto.pieces
        return Model([x.piece for x in p], [x.score for x in p], [x.type for x in p], t.model_type == 2, n.add_dummy_prefix, n.escape_whitespaces, n.remove_extra_whitespaces)


@dataclass
class Transducer:
    """The compiled transducer: arcs by piece text, byte arcs, and (for BPE) the acceptor of neighbouring pieces."""

    model: Model
    arcs: dict[str, int] = field(default_factory=dict)
    byte: list[int] = field(default_factory=list)
    unknown: int = 0
    worst: float = 0.0
    prefixes: dict[str, int] = field(default_factory=dict)
    plain: list[str] = field(default_factory=list)
    high: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    chars: set[str] = field(default_factory=set)
    rank: list[int] = field(default_factory=list)
    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    agree: dict[int, bool] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        m = self.model
        self.arcs = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] in (1, 4)}
        at = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == 6}
        self.byte = [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else []
        self.unknown = m.kinds.index(2)
        self.worst = min(m.scores) - 10.0
        self.chars = set().union(*self.arcs)
        if any(SPACE in p.lstrip(SPACE) for p in self.arcs):
            raise ValueError("a piece has an escaped space inside")
        # a segment starts at escaped spaces; characters that only byte arcs read end it as well
        stop = "" if "\n" in self.chars else "\n"
        self.segment = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|{stop}" if stop else ""))
        if m.bpe:
            # equal scores are equal ranks, lower merges first; single characters aren't merged
            order = {s: r for r, s in enumerate(sorted(set(m.scores), reverse=True))}
            self.rank = [order[s] for s in m.scores]
            for p, i in self.arcs.items():
                if len(p) > 1 and (last := self._last_merge(p)) is not None:
                    self.split[i] = last
            self.arcs = {p: i for p, i in self.arcs.items() if len(p) == 1 or i in self.split}  # no merge makes the others
        # arcs by text, -1 for texts that only begin a piece
        self.prefixes = {p[:n]: -1 for p in self.arcs for n in range(1, len(p))} | self.arcs
        # what a piece decodes to by itself; bytes beyond ASCII need their neighbours
        self.plain = [chr(int(p[3:5], 16)) if k == 6 else "" if k == 3 else p.replace(SPACE, " ") for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.high = np.array([k == 6 and int(p[3:5], 16) > 127 for p, k in zip(m.pieces, m.kinds, strict=True)])

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes text, if merging its characters gets there."""
        parts = list(text)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.arcs.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.rank[k] < best):
                    best, at = self.rank[k], i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = self.arcs.get(parts[0]), self.arcs.get(parts[1])
        return None if a is None or b is None else (a, b)

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a, b leaves a, b: their seam is followed back through both pieces' merges."""
        key = a << 32 | b
        if (known := self.agree.get(key)) is not None:
            return known
        pieces, rank, split, arcs = self.model.pieces, self.rank, self.split, self.arcs
        left, right, before, ok = a, b, len(pieces) + 1, True
        while True:
            seam = arcs.get(pieces[left] + pieces[right])
            if seam is not None and rank[seam] < before:
                ok = False
                break
            l, r = split.get(left), split.get(right)
            if l is None and r is None:
                break
            # undo the later merge; of equal ones the left was first
            if r is None or (l is not None and rank[left] > rank[right]):
                before, left = rank[left], l[1]
            else:
                before, right = rank[right] + 1, r[0]
        if len(self.agree) >= AGREED:
            self.agree.clear()
        self.agree[key] = ok
        return ok

    def _fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def path(self, s: str) -> list[int]:
        """The shortest path through the lattice of one segment."""
        return self._merged(s) if self.model.bpe else self._lightest(s)

    def _lightest(self, s: str) -> list[int]:
        """Dynamic programming over positions: the smallest sum of weights."""
        n, arcs, scores = len(s), self.prefixes, self.model.scores
        back: list[int] = [-1] * (n + 1)  # start of the arc that ends here
        piece: list[int] = [-1] * (n + 1)  # -1: bytes
        cost = [INF] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here = cost[i]
            if here - self.worst < cost[i + 1] and s[i] not in self.arcs:
                back[i + 1], piece[i + 1], cost[i + 1] = i, -1, here - self.worst
            for j in range(i + 1, n + 1):
                k = arcs.get(s[i:j])
                if k is None:
                    break
                if k >= 0 and here - scores[k] < cost[j]:
                    back[j], piece[j], cost[j] = i, k, here - scores[k]
        out: list[int] = []
        j = n
        while j:
            i = back[j]
            out += [piece[j]] if piece[j] >= 0 else self._fallback(s[i])[::-1]
            j = i
        return out[::-1]

    def _merged(self, s: str) -> list[int]:
        """The one finite path: depth first, longest arcs first.

        A position reached by agreeing neighbours has the merges' own prefix behind it, so one from which no arc agrees is
        on no finite path and is never entered again.
        """
        n, arcs, pieces, agree, chars = len(s), self.prefixes, self.model.pieces, self.agree, self.chars
        stack: list[tuple[int, int, list[int], int]] = []
        dead: set[int] = set()
        pos, last = 0, -1
        while pos < n:
            found: list[int] = []
            if s[pos] in chars:
                for j in range(pos + 1, n + 1):
                    k = arcs.get(s[pos:j])
                    if k is None:
                        break
                    if k >= 0:
                        found.append(k)
            else:
                found.append(-1)
            while True:
                if found:
                    k = found.pop()
                    end = pos + len(pieces[k]) if k >= 0 else pos + 1
                    if end in dead:
                        continue
                    if last >= 0 and k >= 0:
                        ok = agree.get(last << 32 | k)
                        if not (self.neighbours(last, k) if ok is None else ok):
                            continue
                    stack.append((pos, last, found, k))
                    pos, last = end, k
                    break
                if not stack:
                    raise ValueError(f"no path for {s!r}")
                dead.add(pos)
                pos, last, found, _ = stack.pop()
        out: list[int] = []
        for at, _, _, k in stack:
            if k >= 0:
                out.append(k)
            else:
                out += self._fallback(s[at])
        return out

    def normalised(self, text: str) -> str:
        if self.model.trims:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.model.escape:
            text = text.replace(" ", SPACE)
        return SPACE + text if self.model.prefix else text

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, one after the other."""
        known, parts = self.words, []
        for w in self.segment.findall(self.normalised(text)):
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.path(w), np.int32).tobytes()
                if len(w) <= LONG:
                    if len(known) >= CACHED:
                        known.clear()
                    known[w] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces are joined as UTF-8 (what isn't UTF-8 becomes U+FFFD), the prefix is taken off."""
        m = self.model
        if not self.high[ids].any():
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
        else:
            raw = b"".join(bytes([int(m.pieces[i][3:5], 16)]) if m.kinds[i] == 6 else self.plain[i].encode() for i in ids.tolist())
            text = raw.decode("utf-8", "replace")
        return text[1:] if m.prefix and text.startswith(" ") else text


_workers: dict[str, Transducer] = {}


def of_worker(name: str, shipped: object) -> Transducer:
    """A worker's transducer, with its cache: one at a time, for all queries that ship the same model."""
    if name not in _workers:
        _workers.clear()  # workers outlive queries: what an earlier model filled goes
        _workers[name] = shipped.value
    return _workers[name]


def encoded(docs: DataFrame, path: str = MODEL, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `keep`, ids (array<int>), n_ids, round_trip (whether decoding gives the text back)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Transducer(Model.load(path)))  # at most MOST pieces
    with open(path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    own_ddl = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate((key, *keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = of_worker(name, shipped)
        for b in batches:
            ids: list[np.ndarray | None] = []
            same: list[bool | None] = []
            for x in b.column(b.num_columns - 1):
                if (s := x.as_py()) is None:
                    ids.append(None)
                    same.append(None)
                    continue
                own = np.frombuffer(t.encode(s), np.int32)
                ids.append(own)
                same.append(t.decode(own) == s.replace(SPACE, " "))
            lengths = np.array([-1 if i is None else len(i) for i in ids])
            flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
            offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array(lengths < 0))
            n = pa.array(np.maximum(lengths, 0), pa.int64(), mask=lengths < 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, n, pa.array(same, pa.bool_())], [*[f"c{i}" for i in range(b.num_columns - 1)], "ids", "n_ids", "round_trip"])

    out = docs.select(key, *keep, text).mapInArrow(run, f"{own_ddl}, ids array<int>, n_ids bigint, round_trip boolean")
    return out.toDF(key, *keep, "ids", "n_ids", "round_trip")


def decoded(coded: DataFrame, path: str = MODEL, key: str = "doc_id") -> DataFrame:
    """key, text of encoded rows; null ids give a null text."""
    shipped = coded.sparkSession.sparkContext.broadcast(Transducer(Model.load(path)))
    id_type = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (i := x.as_py()) is None else shipped.value.decode(np.array(i, np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return coded.select(key, "ids").mapInArrow(run, f"k {id_type}, text string").withColumnRenamed("k", key)
