"""SentencePiece encoding and decoding by streaming Viterbi.

The pieces of a model file span a lattice over the text. For a unigram model the path of the highest sum of scores is
taken (ties: the longest last piece). For a BPE model a piece may follow another only if merging the two alone, best
score first, leaves them as they are; then one path alone leads to each boundary, and it is what all the merges give.
Only a window of the longest piece's length is kept besides the undecided part of the paths: as soon as all surviving
back pointers meet in one boundary, the ids up to it are committed. All paths of all texts meet before spaces (and
around line ends) if no piece has one inside; the windows between such boundaries are worked out one by one, and those
of up to 64 characters are remembered. Unknown characters become byte pieces where the model has them.
Nulls count as empty texts, which have no ids; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored. A literal U+2581 in a text decodes to a space, as the format has it.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, CACHE = "▁", 250_000
#: What stands before a text, and for a character that no piece has.
START, UNKNOWN = -2, -1
NONE = float("-inf")


class StreamingViterbi:
    """Takes characters and gives out ids as they become certain.

    From each boundary, as soon as so many characters after it are known as the longest piece has, the pieces that begin
    there reach later boundaries. What is kept are the boundaries that a later piece may still begin at, and those that
    their back pointers lead to before all of them meet in one.
    """

    __slots__ = ("back", "base", "best", "done", "id", "longest", "model", "text")

    def __init__(self, model: Model) -> None:
        self.model, self.longest = model, model.longest
        self.base, self.text, self.done = 0, "", 0  # the first boundary that is kept, the characters from it on, and how many are dealt with
        self.best: list[float] = [0.0]
        self.back: list[int] = [0]
        self.id: list[int] = [START]

    def _reach(self, end: int) -> None:
        """Lets pieces begin at all boundaries before end (counted from base)."""
        m, text, n = self.model, self.text, len(self.text)
        best, back, idx, trie, merges, pairs, shift, none = self.best, self.back, self.id, m.trie, m.merges, m.pairs, m.shift, NONE
        if len(best) <= n:
            more = n + 1 - len(best)
            best += [none] * more
            back += [0] * more
            idx += [UNKNOWN] * more
        for i in range(self.done, end):
            base, last, node, j, single = best[i], idx[i], trie, i, False
            if base == none:
                continue  # no path leads here
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    score, piece = node[""]
                    if j == i + 1:
                        single = True
                    if merges:
                        if best[j] < 0:
                            ok = last < 0 or pairs.get(last << shift | piece)
                            if ok is None:
                                ok = m.follows(last, piece)
                            if ok:
                                best[j], back[j], idx[j] = 0.0, i, piece
                    elif base + score > best[j]:
                        best[j], back[j], idx[j] = base + score, i, piece
            if not single:
                value = 0.0 if merges else base + m.unknown
                if value > best[i + 1]:
                    best[i + 1], back[i + 1], idx[i + 1] = value, i, UNKNOWN
        self.done = max(self.done, end)

    def _path(self, end: int) -> list[tuple[int, str]]:
        out = []
        while end:
            out.append((self.id[end], self.text[self.back[end] : end]))
            end = self.back[end]
        return out[::-1]

    def feed(self, text: str) -> list[tuple[int, str]]:
        """(id or -1, surface) of what becomes certain with these characters."""
        out: list[tuple[int, str]] = []
        for at in range(0, len(text), self.longest):
            self.text += text[at : at + self.longest]
            end = len(self.text) - self.longest
            if end > self.done:
                self._reach(end)
                out += self._commit()
        return out

    def _commit(self) -> list[tuple[int, str]]:
        """Gives out the path to the one boundary where all surviving back pointers meet, if it is not the first."""
        none = NONE
        alive = {i for i in range(self.done, len(self.best)) if self.best[i] > none}
        while len(alive) > 1:
            alive.discard(last := max(alive))
            alive.add(self.back[last])
        (meet,) = alive
        if not meet:
            return []
        found, shift = self._path(meet), self.best[meet]
        self.text, self.base, self.done = self.text[meet:], self.base + meet, max(0, self.done - meet)
        self.best = [x - shift for x in self.best[meet:]]
        self.back, self.id = [max(0, x - meet) for x in self.back[meet:]], self.id[meet:]
        return found

    def finish(self) -> list[tuple[int, str]]:
        self._reach(len(self.text))
        return self._path(len(self.text))


def model_type(path: str) -> int:
    """1: unigram, 2: BPE."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    return spec.trainer_spec.model_type


class Model:
    """Pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.merges = model_type(path) == 2
        self.pairs: dict[int, bool] = {}
        self.shift = n.bit_length()
        self.surface = [sp.id_to_piece(i) for i in range(n)]
        self.pieces: dict[str, tuple[float, int] | None] = {}
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = []
        scores = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.pieces[piece] = (sp.get_score(i), i)
                scores.append(sp.get_score(i))
                self.out.append(piece.replace(SPACE, " ").encode())
        self.unk = sp.unk_id()
        self.unknown = min(scores, default=0.0) - 10
        self.longest = max(map(len, self.pieces), default=1)
        # all paths meet before a run of spaces if no piece has one after another character, and around a line end if none has one
        spaced = all(SPACE not in p.lstrip(SPACE) for p in self.pieces)
        lines = all("\n" not in p or p == "\n" for p in self.pieces)
        self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if spaced else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

        self.trie: dict = {}
        for piece, hit in self.pieces.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = hit

    def follows(self, left: int, right: int) -> bool:
        """Whether a piece of a BPE model may stand after another."""
        if left < 0 or right < 0:
            return True
        ok = self.pairs.get(left << self.shift | right)
        if ok is None:
            if len(self.pairs) >= 3 * CACHE:
                self.pairs.clear()
            ok = self.pairs[left << self.shift | right] = self.merged(self.surface[left] + self.surface[right]) == [self.surface[left], self.surface[right]]
        return ok

    def merged(self, text: str) -> list[str]:
        """Merges of a BPE model over a few characters: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            top, at = float("-inf"), -1
            for i in range(len(parts) - 1):
                hit = self.pieces.get(parts[i] + parts[i + 1])
                if hit is not None and hit[0] > top:
                    top, at = hit[0], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stream(self, text: str) -> list[int]:
        v = StreamingViterbi(self)
        ids: list[int] = []
        if len(text) > 2 * self.longest:
            ids += self._ids(v.feed(text))
        else:  # no more than the window
            v.text = text
        return ids + self._ids(v.finish())

    def _ids(self, found: list[tuple[int, str]]) -> list[int]:
        out: list[int] = []
        for i, surface in found:
            if i >= 0:
                out.append(i)
            else:
                raw = surface.encode()
                out += [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unk]
        return out

    def _part(self, part: str) -> bytes:
        """The ids of a window between two boundaries where all paths meet; short ones are remembered.

        What was not asked for since the memory was last full is forgotten when it is full again.
        """
        ids = self.older.get(part)
        if ids is None:
            ids = array("I", self.stream(part)).tobytes()
        if len(part) <= 64:
            if len(self.known) >= CACHE:
                self.known, self.older = {}, self.known
            self.known[part] = ids
        return ids

    def coded(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if self.split is None:
            return np.array(self.stream(text), "<u4").tobytes()
        known, part = self.known.get, self._part
        return b"".join([known(p) or part(p) for p in self.split.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def model(path: str) -> Model:
    m = Model(path)
    gc.freeze()  # the collector would go through the whole trie again and again
    return m


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for docs(doc_id, text); ids are little-endian unsigned 32-bit numbers in a binary value."""

    def run(batches):
        m = model(path)
        for b in batches:
            ids = [m.coded(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) for ids(doc_id, ids)."""

    def run(batches):
        m = model(path)
        for b in batches:
            text = [m.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")
