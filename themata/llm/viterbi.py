"""SentencePiece ids by a streaming Viterbi search over the pieces of a given model, and back.

The model's scores are the order of its merges, so the search does not add them up: a piece may follow
another one only if merging could have left this pair, that is, if no merge across their boundary comes
before the merges that made them. These pairs decide everything: every beginning of a text then has one
valid last piece, and the path of valid pairs has the ids that merging gives (tests compare them with
the library's).

The search reads a text once. Ends of pieces reach at most the longest piece ahead, so the surviving
paths are as many as that; whenever their backpointers meet in one boundary, the ids up to it are
committed and forgotten, so a text of any length needs a window only. Where no piece holds a space
behind another character, all paths meet before each space, so a stretch from one space to the next has
the same ids wherever it stands and those met before are remembered. Characters that no piece has are
written as their UTF-8 bytes; nothing merges with them.

Decoding gives back every text exactly: it gets one space in front, like in the library, which is
taken off again, and the library's mark for spaces is no piece when it stands in a text itself.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.llm.common import column, slices, text_of

# Fixed value: how the library writes a space inside a piece.
SPACE = "▁"
CACHED_STRETCHES = 400_000
#: Pairs of pieces that were judged.
CACHED_PAIRS = 200_000
#: Instead of a last piece: a place that no path reaches, and one behind bytes or at the start.
NONE, FREE = -2, -1

ENCODED = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, exact boolean"


class Pieces:
    """The pieces of a model, the merges that make them, and the bytes behind each id."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.of_byte = [-1] * 256
        self.bytes: list[bytes] = []
        texts: dict[str, int] = {}
        order: dict[str, float] = {}
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(piece[3:-1], 16)
                self.of_byte[value] = number
                self.bytes.append(bytes([value]))
                continue
            if model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                self.bytes.append(b"")
                continue
            text = piece.replace(SPACE, " ")
            self.bytes.append(text.encode())
            texts[text] = number
            # Merges come by falling score; a single character is there from the start.
            order[text] = -model.get_score(number) if len(text) > 1 else -math.inf
        if min(self.of_byte) < 0:
            raise ValueError("the model has no pieces for single bytes")
        parts = {t: last_merge(t, order) for t in texts if len(t) > 1}
        # Pieces that merging their own characters does not give never occur.
        self.ids = {t: i for t, i in texts.items() if len(t) == 1 or parts[t]}
        # By string: the id of the piece or NONE, and whether longer pieces begin so.
        self.strings = {t[:n]: (NONE, True) for t in self.ids for n in range(1, len(t))}
        self.strings |= {t: (i, t in self.strings) for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.splits = all(re.search(r"[^ ] ", t) is None for t in self.ids)
        self.order = {i: order[t] for t, i in self.ids.items()}
        self.parts = {self.ids[t]: (self.ids[a], self.ids[b]) for t, (a, b) in
                      ((t, p) for t, p in parts.items() if p)}
        self.merged = {
            (self.ids[t[:n]], self.ids[t[n:]]): order[t]
            for t in self.ids for n in range(1, len(t)) if t[:n] in self.ids and t[n:] in self.ids
        }
        self.judged: dict[int, bool] = {}

    def may_follow(self, x: int, y: int) -> bool:
        """Whether merging can leave piece ``y`` behind piece ``x``.

        The later of the merges that made the two symbols at the boundary is undone, again and again.
        Before it, no merge across the boundary may have had its turn: of merges of the same piece, the
        one on the left comes first.
        """
        key = x << 32 | y
        known = self.judged.get(key)
        if known is None:
            known = self._judge(x, y)
            if len(self.judged) < CACHED_PAIRS:
                self.judged[key] = known
        return known

    def extend(self, text: str, at: int, size: int, last: list[int], back: list[int]) -> None:
        """Follow the pieces that begin at a place, up to ``size``: the last piece of the path to each
        place of the text, and where that began."""
        before, strings, judged = last[at], self.strings, self.judged
        if text[at] not in self.ids:
            last[at + 1], back[at + 1] = FREE, at
            return
        for end in range(at + 1, size + 1):
            known = strings.get(text[at:end])
            if known is None:
                return
            number, longer = known
            # A beginning of the text has one valid last piece; a place that has it is done.
            if number != NONE and last[end] == NONE:
                follows = before == FREE or judged.get(before << 32 | number)
                if follows is None:
                    follows = self.may_follow(before, number)
                if follows:
                    last[end], back[end] = number, at
            if not longer:
                return

    def steps(self, text: str, to: int, last: list[int], back: list[int]) -> list[int]:
        """The ids of the path to a place."""
        out, place = [], to
        while place:
            if last[place] != FREE:
                out.append(last[place])
            else:
                out += [self.of_byte[b] for b in reversed(text[place - 1].encode("utf-8", "surrogatepass"))]
            place = back[place]
        return out[::-1]

    def window(self, text: str) -> list[int]:
        """The ids of a text that fits a window."""
        n = len(text)
        last, back = [NONE] * (n + 1), [0] * (n + 1)
        last[0] = FREE
        for at in range(n):
            if last[at] != NONE:
                self.extend(text, at, min(n, at + self.longest), last, back)
        return self.steps(text, n, last, back)

    def _judge(self, x: int, y: int) -> bool:
        order, merged = self.order, self.merged
        turn, left_first = math.inf, False
        while True:
            across = merged.get((x, y))
            if across is not None and (across < turn or across == turn and left_first):
                return False
            if order[x] > order[y]:
                turn, left_first, x = order[x], False, self.parts[x][1]
            elif order[y] == -math.inf:
                return True
            else:
                turn, left_first, y = order[y], True, self.parts[y][0]


def last_merge(text: str, order: dict[str, float]) -> tuple[str, str] | None:
    """The two symbols that merging the characters of ``text`` joins last, if one symbol is left."""
    symbols, last = list(text), None
    while len(symbols) > 1:
        pairs = [(order.get(a + b, math.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        turn, k = min(pairs)
        if turn == math.inf:
            return None
        last = symbols[k], symbols[k + 1]
        symbols[k : k + 2] = ["".join(last)]
    return last


class StreamingEncoder:
    """Takes a text in parts of any size; gives out ids as soon as they are certain."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.text = ""  # characters that are not committed
        self.done = 0  # how many of them have been searched from
        # By place in ``text``: the last piece of the path to it, and where that began.
        self.last: list[int] = [FREE]
        self.back: list[int] = [0]
        self.largest_window = 0

    def _extend(self, at: int) -> None:
        size = min(len(self.text), at + self.pieces.longest)
        new = size + 1 - len(self.last)
        if new > 0:
            self.last += [NONE] * new
            self.back += [0] * new
        self.pieces.extend(self.text, at, size, self.last, self.back)

    def _commit(self, to: int) -> list[int]:
        out = self.pieces.steps(self.text, to, self.last, self.back)
        self.text = self.text[to:]
        self.last = self.last[to:]
        self.back = [0, *(b - to for b in self.back[to + 1 :])]
        self.done -= to
        return out

    def _meeting(self) -> int:
        """The last boundary that the paths to all open ends share."""
        ends = [p for p in range(self.done, len(self.last)) if self.last[p] != NONE]
        while len(ends) > 1:
            # The furthest end steps back; a path that reaches another one joins it.
            last = ends.pop()
            before = self.back[last]
            if before not in ends:
                ends.append(before)
                ends.sort()
        return ends[0]

    def feed(self, part: str, final: bool = False) -> list[int]:
        """Add a part of the text; returns the ids that are certain from now on."""
        self.text += part
        out: list[int] = []
        longest = self.pieces.longest
        # A place is searched from when all characters of its longest piece are there.
        while self.done < len(self.text) and (final or self.done + longest <= len(self.text)):
            if self.last[self.done] != NONE:
                self._extend(self.done)
            self.done += 1
            self.largest_window = max(self.largest_window, self.done)
            if self.done % (2 * longest) == 0 and (to := self._meeting()):
                out += self._commit(to)
        if final:
            out += self._commit(len(self.text)) if self.text else []
        return out


class Codec:
    def __init__(self, model_file: str) -> None:
        self.pieces = Pieces(model_file)
        self.cache: dict[str, bytes] = {}
        self.stretch = re.compile(r" *[^ ]+| +" if self.pieces.splits else r"(?s).+")

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts."""
        encoder, first = StreamingEncoder(self.pieces), True
        for part in parts:
            if part:
                yield from encoder.feed(" " + part if first else part)
                first = False
        yield from encoder.feed("", final=True)

    def _fresh(self, stretch: str) -> bytes:
        if len(stretch) > 2 * self.pieces.longest:
            return array("I", StreamingEncoder(self.pieces).feed(stretch, final=True)).tobytes()
        ids = array("I", self.pieces.window(stretch)).tobytes()
        if len(self.cache) < CACHED_STRETCHES:
            self.cache[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers; none for the empty text."""
        if not text:
            return b""
        stretches = self.stretch.findall(" " + text)
        found = list(map(self.cache.get, stretches))
        if None in found:
            found = [self._fresh(s) if ids is None else ids for s, ids in zip(stretches, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text behind ids; ids that no text gives may stand for broken characters."""
        data = b"".join(map(self.pieces.bytes.__getitem__, array("I", ids)))
        return data[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec for each model file and worker process."""
    return Codec(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` (doc_id, text) with the ids of each whole text: (doc_id, ids) as bytes.

    Null text is the empty text, which has no ids. Rows are encoded one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in slices(batches, "text"):
            ids = [own.encode(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(ids, pa.binary())],
                names=["doc_id", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in slices(batches, "ids"):
            texts = [own.decode(i) for i in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())],
                names=["doc_id", "text"],
            )

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids),
    decoded_crc32 (of the decoded text's UTF-8) and whether the decoded text is the text.

    Null text is the empty text, which has no ids. Null and repeated ids are kept, row by row; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], []]
            for text in column(batch, "text"):
                ids = own.encode(text)
                back = own.decode(ids)
                for target, value in zip(
                    rows, (len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == text), strict=True
                ):
                    target.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *arrays],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "exact"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, ENCODED)
