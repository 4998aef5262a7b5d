"""Pack documents into windows of tokens, in order, by dynamic programming.

Every task of the input is a lane: its documents follow one another as one stream
of ids, each closed by an end id. Cuts may fall at document ends (free), sentence
ends (a penalty) or, in stretches without either, at fixed steps (a larger
penalty). ``best_cuts`` minimises padding plus penalties; as the cost of a window
is its length short of the size, the best start of a window is a sliding minimum,
kept in a monotone queue. There is no shuffle: lanes do not depend on each other,
a lost task repacks its lane alone, and memory holds one block of ids.

The last window of a lane is cut at the binary digits of its length, because a
sequence whose length is a power of two needs no padding.

Null text is empty: such a document is its end id. Null or repeated ids are kept
as they come, every row being a document of its own. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import slices
from pulsetally.llm.tokens import ChunkTokenizer

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
#: Tokens read before cuts are chosen; the last two windows of a block are chosen again with the next.
BLOCK = 1 << 18
#: A stretch longer than this without a sentence end may be cut every STEP tokens.
STRETCH, STEP = 64, 8


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Indices of the chosen ``places`` (ascending offsets; the first and last are taken).

    Neighbouring places are at most ``size`` apart. Minimises the sum of
    ``size - length`` over all windows but the last, plus the penalties of the cuts:
    the last window is not padded, or goes on in the next block.
    """
    at, fee = places.tolist(), penalties.tolist()
    previous, cost = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(at[0], at[0], 0)])  # cost + place, place, index
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - size:
            queue.popleft()
        best = queue[0]
        previous[j] = best[2]
        key = best[0] + size + fee[j]
        cost[j] = key - here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    j = len(at) - 1
    near = range(bisect_left(at, at[j] - size), j)
    cuts = [j]
    j = min(near, key=cost.__getitem__, default=0)
    while j:
        cuts.append(j)
        j = previous[j]
    cuts.append(0)
    return cuts[::-1]


def binary_parts(length: int) -> list[int]:
    """Powers of two that sum to ``length``, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Lane:
    """The stream of one task: documents go in, pieces come out."""

    def __init__(self, size: int, sentence_fee: int, stretch_fee: int, stops: np.ndarray, first: int):
        self.size, self.sentence_fee, self.stretch_fee = size, sentence_fee, stretch_fee
        self.is_stop = np.zeros(int(stops.max(initial=0)) + 2, bool)
        self.is_stop[stops] = True
        self.sequence = first
        self.docs: deque[list] = deque()  # doc id, ids, tokens of it that are already placed
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where cuts may fall in the ids that wait, and the fee of each."""
        parts = [ids[done:] for _, ids, done in self.docs]
        ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        # Ids beyond the table fall on its last place, which is none of the stops.
        stop = self.is_stop[np.minimum(ids, len(self.is_stop) - 1)]
        stop[ends - 1] = False
        fees = np.full(len(ids) + 1, -1, np.int64)
        fees[np.flatnonzero(stop) + 1] = self.sentence_fee
        fees[ends] = fees[0] = 0
        edges = np.flatnonzero(fees >= 0)
        for at in np.flatnonzero(np.diff(edges) > STRETCH).tolist():
            fees[edges[at] + STEP : edges[at + 1] : STEP] = self.stretch_fee
        places = np.flatnonzero(fees >= 0)
        return places, fees[places]

    def cut(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows that are settled; of all of them when ``last``."""
        if not self.waiting:
            return
        places, fees = self._places()
        ends = places[best_cuts(places, fees, self.size)]
        lengths = np.diff(ends).tolist()
        if last:
            tail = lengths.pop()
            lengths += [tail] if self.size - tail <= self.size // 64 else binary_parts(tail)
        else:
            lengths = lengths[:-2]
        for length in lengths:
            yield from self._window(length)

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc = self.docs[0]
            doc_id, ids, done = doc
            take = min(len(ids) - done, length - offset)
            yield doc_id, done, take, ids[done : done + take].tobytes(), len(ids), self.sequence, offset
            offset += take
            doc[2] += take
            if doc[2] == len(ids):
                self.docs.popleft()
        self.waiting -= length
        self.sequence += 1


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 4096,
    end_id: int = 2,
    sentence_fee: int = 4,
    stretch_fee: int = 16,
) -> DataFrame:
    """Pieces of documents with their place in a sequence (columns of ``PIECES``).

    ``ids`` are little-endian unsigned 32-bit. ``tokenizer`` is the path of a
    tokenizer file that drops white space, readable by every executor.
    """
    fields = pa.schema(
        [(n, pa.binary() if n == "ids" else pa.int64()) for n in (f.split()[0] for f in PIECES.split(", "))]
    )

    def rows(lane: Lane, last: bool) -> Iterator[pa.RecordBatch]:
        out = list(lane.cut(last))
        for i in range(0, len(out), 2000):
            part = list(zip(*out[i : i + 2000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, fields, strict=True)], schema=fields)

    def lane_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ChunkTokenizer(tokenizer)
        stops = np.concatenate([words.ids(mark)[-1:] for mark in ".!?"])
        closing = np.array([end_id], "<u4").tobytes()
        lane = Lane(size, sentence_fee, stretch_fee, stops, TaskContext.get().partitionId() << 32)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = words.pieces(text.as_py() or "")
                lane.add(doc_id, np.frombuffer(b"".join((*pieces, closing)), "<u4"))
                if lane.waiting >= max(BLOCK, 8 * size):
                    yield from rows(lane, False)
        yield from rows(lane, True)

    return documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).mapInArrow(lane_of, PIECES)
