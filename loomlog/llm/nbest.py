"""N-best segmentation into SentencePiece pieces, and decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Fixed value: the sign that stands for a space in pieces.
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Chunks of each of the two generations that a task keeps, and the longest of them.
_CACHE_CHUNKS, _CACHE_CHARS = 60_000, 40
#: How much worse than the worst piece a character is that no piece has.
UNKNOWN_PENALTY = 10.0
_LOW = -1e300


class Lattice(dict):
    """The best segmentations of chunks, kept while there is room: chunks that come again outlive the others.

    A chunk is a run of spaces and the word after it.  No piece reaches over the
    start of a chunk, so each path through a text's lattice goes through these
    borders, and its forward scores are sums of those of the chunks.  A value is
    (best score, its ids as little-endian 32-bit numbers, what the second-best
    path loses); of equal scores the path with the longer last piece is the
    better one, then the one with the longer piece before it, and so on.
    """

    def __init__(self, model_file: str, n: int):
        super().__init__()
        import sentencepiece

        self.n = n
        self.before: dict[str, tuple[float, bytes, float]] = {}
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.model.vocab_size()
        usable = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i))]
        self.ids = {self.model.id_to_piece(i): i for i in usable}
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {bytes([int(p[3:5], 16)]): i for i in range(size) if self.model.is_byte(i) for p in [self.model.id_to_piece(i)]}
        #: By character what goes on with it: the score of the piece that ends there, and the next characters.
        self.tree: dict = {}
        for piece in sorted(self.ids):  # a piece comes behind its beginnings
            at = self.tree
            for char in piece[:-1]:
                score, more = at.get(char, (None, None))
                if more is None:
                    more = {}
                    at[char] = (score, more)
                at = more
            at[piece[-1]] = (self.scores[piece], None)
        self.unknown_score = min((s for s in self.scores.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = self.model.unk_id()
        texts = {i: p.encode() for p, i in self.ids.items()} | {i: b for b, i in self.bytes.items()}
        self.texts = [texts.get(i, b"") for i in range(size)]
        self.texts[self.unknown_id] = " ⁇ ".encode()

    def unknown(self, char: str) -> list[int]:
        return [self.bytes.get(bytes([b]), self.unknown_id) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown_id]

    def put(self, chunk: str, starts: list[int]) -> array:
        """Ids of the path whose pieces begin at ``starts``, the last one first."""
        out, end, parts = array("i"), len(chunk), []
        for start in starts:
            parts.append(chunk[start:end])
            end = start
        for part in reversed(parts):
            found = self.ids.get(part)
            if found is None:
                out.extend(self.unknown(part))
            else:
                out.append(found)
        return out

    def forward(self, chunk: str) -> tuple[list | array, list | array, float]:
        """Best score up to each position, where its last piece begins, and the second-best score of the whole."""
        size, tree, nothing, unknown = len(chunk), self.tree, (None, None), self.unknown_score
        if size <= 10_000:
            best, second, back = [_LOW] * (size + 1), [_LOW] * (size + 1), [0] * (size + 1)
        else:
            best, second, back = array("d", [_LOW]) * (size + 1), array("d", [_LOW]) * (size + 1), array("i", [0]) * (size + 1)
        best[0] = 0.0
        for start in range(size):
            first, other = best[start], second[start]
            end = start + 1
            score, more = tree.get(chunk[start], nothing)
            if score is None:  # a character that is no piece stands for itself
                score = unknown
            while True:
                if score is not None:
                    new, have = first + score, best[end]
                    if new > have:
                        best[end], back[end] = new, start
                        new = have  # what was best can be second now
                    if new > second[end]:
                        second[end] = new
                    new = other + score
                    if new > second[end]:
                        second[end] = new
                if end == size or more is None:
                    break
                score, more = more.get(chunk[end], nothing)
                if score is None and more is None:
                    break
                end += 1
        return best, back, second[size]

    def search(self, chunk: str) -> list[tuple[float, array]]:
        """The n best (loss against the best, ids), by backward A* with the forward scores as exact heuristics.

        A path is a suffix that leaves an earlier path at one node by another
        piece, and the best way from the start to there; what it loses in all is
        known from the forward scores at that node.  So the cheapest one not yet
        taken is the next best, and only nodes of paths taken are looked at: the
        work is the length of the chunk times n times the longest piece.
        """
        best, back, _ = self.forward(chunk)
        pieces, unknown, n = self.scores, self.unknown_score, self.n

        def starts_of(node: tuple) -> list[int]:
            """Where the pieces of a path begin, from the last to the first."""
            _, leave, start, parent = node
            if parent is None:
                out, at = [], len(chunk)
            else:
                out, at = [], start
                for s in parent:
                    if s < leave:
                        break
                    out.append(s)
                out.append(start)
            while at:
                at = back[at]
                out.append(at)
            return out

        pool: list[tuple] = [(0.0, len(chunk) + 1, 0, None)]
        out: list[tuple[float, array]] = []
        while pool and len(out) < n:
            least = min(p[0] for p in pool)
            node = min((p for p in pool if p[0] == least), key=starts_of)
            pool.remove(node)
            loss, leave, start, parent = node
            starts = starts_of(node)
            out.append((loss, self.put(chunk, starts)))
            if len(out) == n:
                break
            at, found = len(chunk), []
            for own in starts:
                if parent is None or at <= start:
                    for other in range(max(0, at - self.longest), at):
                        if other == own:
                            continue
                        score = pieces.get(chunk[other:at])
                        if score is None:
                            if other != at - 1:
                                continue
                            score = unknown
                        lost = best[at] - best[other] - score
                        found.append((loss + lost, other > own, at if other > own else -at, other))
                at = own
            pool += [(lost, abs(at), other, starts) for lost, _, at, other in heapq.nsmallest(n, found)]
        return out

    def __missing__(self, chunk: str) -> tuple[float, bytes, float]:
        found = self.before.pop(chunk, None)
        if found is None:
            best, back, second = self.forward(chunk)
            starts, at = [], len(chunk)
            while at:
                at = back[at]
                starts.append(at)
            found = (best[-1], self.put(chunk, starts).tobytes(), best[-1] - second)
        if len(chunk) <= _CACHE_CHARS:
            if len(self) >= _CACHE_CHUNKS:
                self.before = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        if "  " in text or text[:1] == " " or SPACE in text:
            return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def nbest(self, text: str | None) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, array]]]]]:
        """The best ids, their score, and the other n - 1 best as (score, edits of the best).

        Of segmentations with equal scores the one whose last chunks rank higher
        among their own comes first.  So the n best change the n - 1 chunks
        whose second-best path loses least, and no other.
        """
        if not text:
            return b"", 0.0, []
        chunks = self.chunks(text)
        scores, ids, loss = zip(*map(self.__getitem__, chunks))
        total = sum(scores)
        others: list[tuple[float, list[tuple[int, int, array]]]] = []
        states: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        cheap = sorted(i for lost, i in heapq.nsmallest(self.n - 1, zip(loss, range(len(loss)))) if lost < 1e299)
        ways = [self.search(chunks[i]) for i in cheap]
        for found in ways:
            states = heapq.nsmallest(self.n, [(lost + more, (k, *ranks)) for lost, ranks in states for k, (more, _) in enumerate(found)])
        for lost, ranks in states[1:]:
            edits = [(sum(map(len, ids[:i])) // 4, len(ids[i]) // 4, found[k][1]) for i, found, k in zip(cheap, ways, reversed(ranks)) if k]
            others.append((total - lost, edits))
        return b"".join(ids), total, others

    def restore(self, ids: list[int]) -> str:
        """The text of ids."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


SCHEMA = "ids array<int>, score double, others array<struct<score:double,edits:array<struct<at:int,drop:int,put:array<int>>>>>, restored boolean"


def encode(docs: DataFrame, model_file: str, n: int = 3) -> DataFrame:
    """doc_id with the ids and score of the best segmentation of each whole text, and the n - 1 next.

    ``others`` has their scores and how their ids differ: at ``at``, ``drop``
    ids of the best become ``put``.  ``restored`` says that decoding the ids
    gives the text.  Null and empty texts have no ids and score 0; a null doc_id
    stays null.  Repeated rows get a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_file, n)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])))]))
        for batch in batches:
            docs_ = batch.column(0)
            for at in range(0, batch.num_rows, 200):
                found = [(*lattice.nbest(text), text or "") for text in batch.column(1).slice(at, 200).to_pylist()]
                ids = np.frombuffer(b"".join(f[0] for f in found), dtype=np.int32)
                ends = np.cumsum([0, *(len(f[0]) // 4 for f in found)]).astype(np.int32)
                restored = [lattice.restore(array("i", f[0])) == f[3] for f in found]
                others = [[{"score": s, "edits": [{"at": a, "drop": d, "put": p.tolist()} for a, d, p in edits]} for s, edits in f[2]] for f in found]
                columns = [docs_.slice(at, 200), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array([f[1] for f in found], pa.float64()), pa.array(others, kind), pa.array(restored)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "score", "others", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, " + SCHEMA)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows with ``ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
