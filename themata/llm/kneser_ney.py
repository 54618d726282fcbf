"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Tokens are the words of a text in ASCII lower case and one end token. A first job counts the words by
64-bit hashes and writes the vocabulary: sorted hashes, whose places are the words' numbers. N-grams are
rows of these numbers. A task sums up a slice of them, sorts it, cuts it by shard and passes on one
compressed piece (steps between rows, byte by byte) for each; Spark shuffles the pieces by shard, and the
task that gets a shard adds its pieces up and writes its file. Shards go by an n-gram's first word; a word
that has more than a shard's worth of tokens has shards of its own, among which the second word decides.
From each level follows the next lower one, whose counts are numbers of distinct left extensions.

A file has the distinct first words with offsets, the numbers of the other words in four bytes, and
counts in one byte, with a list of those that need more. Sums over the successors of a context are stored
where there are many, and else taken when they are asked for. Files are in the shared folder. Each task
writes under a name of its own attempt and renames when done, so a repeated task replaces its files by
equal ones. Workers map files of a mounted folder in place, and those of another store from an unlinked
copy.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themata.llm.common import column, crc_fold, slices, text_of
from themata.storage import new_folder

#: Order of the registered query's model.
ORDER = 3
#: N-grams that a task sums up before it passes them on.
SUMMED = 2_000_000
#: Tokens per shard, about.
SHARD_TOKENS = 4_000_000
#: Rows and characters that are scored at once, so that a shard is searched for many n-grams together.
SCORED_ROWS, SCORED_CHARS = 8192, 8_000_000
#: Successors of a context beyond which their sums are stored.
MANY = 16
TEST_FOLDS, TEST_FOLD = 5, 1

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hash of the end of a text, and number of the place before it.
END, START = np.uint64(0x5D1C3A9B7E2F4861), 0
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)
PIECES = "shard int, piece binary"


def token_hashes(text: str) -> np.ndarray:
    """Hashes of a text's tokens, the end token last."""
    from xxhash import xxh3_64_intdigest

    # Bytes have ASCII lower case and ASCII white space.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, and the number of tokens of each."""
    each = [token_hashes(t) for t in texts]
    sizes = np.array([x.size for x in each], np.int64)
    return np.concatenate(each) if each else np.empty(0, np.uint64), sizes


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(columns[0].size, bool)
    if new.size:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _joined(columns: list[np.ndarray]) -> tuple[np.ndarray | None, list[int]]:
    """The columns' bits in one number per row, if they fit, and the bits of each column."""
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    if sum(bits) > 64:
        return None, bits
    key = columns[0].astype(np.uint64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key <<= np.uint64(b)
        key |= c.astype(np.uint64)
    return key, bits


def _order(columns: list[np.ndarray]) -> np.ndarray:
    key, _ = _joined(columns)
    ranked = list(columns)
    for at, values in enumerate(columns):
        if key is None:
            # Places among the distinct values need fewer bits.
            ranked[at] = np.searchsorted(np.unique(values), values)
            key, _ = _joined(ranked)
    return np.lexsort(columns[::-1]) if key is None else np.argsort(key)


def _counted(columns: list[np.ndarray], n: np.ndarray | None) -> list[np.ndarray]:
    """The distinct rows of the columns, sorted, with the sums of ``n``, by default of ones."""
    key, bits = _joined(columns) if n is None else (None, [])
    if key is None:
        order = _order(columns)
        columns = [c[order] for c in columns]
        at = _starts(columns)
        sums = np.diff(at, append=order.size) if n is None else np.add.reduceat(n[order], at) if at.size else n[:0]
        return [c[at] for c in columns] + [sums]
    key.sort()
    at = _starts([key])
    count, key, out = np.diff(at, append=key.size), key[at], []
    for b in bits[:0:-1]:
        out.append(key & np.uint64((1 << b) - 1))
        key = key >> np.uint64(b)
    return [key, *out[::-1], count]


class Summed:
    """Gathers rows with sums, or to be counted, and gives them out added up."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = []
        self.sums: list[np.ndarray] = []
        self.rows = 0

    def add(self, columns: list[np.ndarray], n: np.ndarray | None = None) -> None:
        self.held.append(columns)
        if n is not None:
            self.sums.append(n)
        self.rows += columns[0].size

    def take(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        n = np.concatenate(self.sums) if self.sums else None
        self.held, self.sums, self.rows = [], [], 0
        return _counted(columns, n)


# --- pieces --------------------------------------------------------------------------------------


def pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted rows and their sums as compressed bytes: the steps of a column while those before it stay."""
    codec, out = pa.Codec("zstd"), [struct.pack("<I", n.size)]
    same = np.arange(n.size) > 0
    for at, values in enumerate([*columns, n]):
        steps = values.astype(np.uint64)
        if at < len(columns):
            steps[1:] -= np.where(same[1:], values[:-1], 0).astype(np.uint64)
            same[1:] &= values[1:] == values[:-1]
        width = (int(steps.max(initial=0)).bit_length() + 7) // 8
        out.append(bytes([width]))
        planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
        for p in range(width):
            coded = codec.compress(planes[:, p].tobytes(), asbytes=True)
            out += struct.pack("<I", len(coded)), coded
    return b"".join(out)


def unpack(piece: bytes, keys: int) -> list[np.ndarray]:
    """Columns and sums of ``pack``."""
    codec, out = pa.Codec("zstd"), []
    rows, place = struct.unpack_from("<I", piece)[0], 4
    same = np.arange(rows) > 0
    for at in range(keys + 1):
        planes, width = np.zeros((rows, 8), np.uint8), piece[place]
        place += 1
        for p in range(width):
            size = struct.unpack_from("<I", piece, place)[0]
            coded = piece[place + 4 : place + 4 + size]
            planes[:, p] = np.frombuffer(codec.decompress(coded, rows, asbytes=True), np.uint8)
            place += 4 + size
        values = planes.view("<u8").reshape(-1)
        if at < keys:
            ends, first = np.cumsum(values, dtype=np.uint64), np.flatnonzero(~same)
            values = ends - np.repeat(ends[first] - values[first], np.diff(first, append=rows))
            same[1:] &= values[1:] == values[:-1]
        out.append(values)
    return [*out[:-1], out[-1].astype(np.int64)]


def pieces(columns: list[np.ndarray], n: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Sorted rows cut by shard, one row of ``PIECES`` for each."""
    order = np.argsort(shard, kind="stable")
    columns, n, shard = [c[order] for c in columns], n[order], shard[order]
    at = [*_starts([shard]), shard.size]
    packed = [pack([c[a:b] for c in columns], n[a:b]) for a, b in zip(at, at[1:], strict=False)]
    arrays = [pa.array(shard[at[:-1]].astype(np.int32)), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["shard", "piece"])


def merged(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """The shards of pieces that come sorted by shard, with their pieces added up."""
    summed, last, most = Summed(), None, SUMMED
    for batch in batches:
        for shard, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if last is not None and shard != last:
                *columns, n = summed.take()
                yield last, columns, n
                most = SUMMED
            last = shard
            *columns, n = unpack(piece.as_py(), keys)
            summed.add(columns, n)
            if summed.rows > most:
                *columns, n = summed.take()
                summed.add(columns, n)
                most = max(SUMMED, 2 * n.size)
    if last is not None:
        *columns, n = summed.take()
        yield last, columns, n


# --- files ---------------------------------------------------------------------------------------


class Store:
    """Files of one folder, by a path or URI that pyarrow can open."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        if "://" in folder or folder.startswith("file:"):
            uri = folder if "://" in folder else folder.replace("file:", "file://", 1)
            self.fs, self.path = fs.FileSystem.from_uri(uri)
        else:
            self.fs, self.path = fs.LocalFileSystem(), os.path.abspath(folder)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def names(self) -> list[str]:
        from pyarrow import fs

        return [i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))]

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Write some arrays as a file; each begins at a multiple of eight bytes."""
        head = json.dumps({k: [a.dtype.str, a.size] for k, a in arrays.items()}).encode()
        self.fs.create_dir(self.path, recursive=True)
        own = f"{self.path}/tmp-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as file:
            file.write(struct.pack("<Q", len(head)))
            for data in (head, *(a.tobytes() for a in arrays.values())):
                file.write(data + bytes(-len(data) % 8))
        self.fs.move(own, f"{self.path}/{name}")

    def get(self, name: str) -> dict[str, np.ndarray]:
        data = self._map(f"{self.path}/{name}")
        at = 8 + int(data[:8].view("<u8")[0])
        head, out = json.loads(data[8:at].tobytes()), {}
        for key, (dtype, size) in head.items():
            at += -at % 8
            end = at + np.dtype(dtype).itemsize * size
            out[key], at = data[at:end].view(dtype), end
        return out

    def _map(self, path: str) -> np.ndarray:
        if self.local:
            return np.memmap(path, np.uint8, "r").view(np.ndarray)
        import shutil
        import tempfile

        with self.fs.open_input_stream(path) as source, tempfile.NamedTemporaryFile() as copy:
            shutil.copyfileobj(source, copy)
            copy.flush()
            return np.memmap(copy.name, np.uint8, "r").view(np.ndarray)


def _small_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    often = np.flatnonzero(counts >= 255)
    small = {"counts": np.minimum(counts, 255).astype("u1")}
    return small | {"often_at": often.astype("<i8"), "often": counts[often].astype("<i8")}


def _counts_at(part: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    counts = part["counts"][at].astype(np.int64)
    if (large := np.flatnonzero(counts == 255)).size:
        counts[large] = part["often"][np.searchsorted(part["often_at"], at[large])]
    return counts


def _head(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sum and number of some counts, and how many are 1 to 4."""
    few = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
    return {"head": np.array([counts.sum(), np.count_nonzero(counts), *few], "<i8")}


def _shard_file(columns: list[np.ndarray], counts: np.ndarray) -> dict[str, np.ndarray]:
    """The sorted n-grams of a shard, of two words or more."""
    if max(int(c.max(initial=0)) for c in columns) >> 32:
        raise ValueError("more than 2^32 different words")
    first = _starts(columns[:1])
    offsets = np.append(first, counts.size).astype("<u8" if counts.size >> 32 else "<u4")
    parts = {"first": columns[0][first].astype("<u4"), "offsets": offsets}
    for at, values in enumerate(columns[1:], 1):
        parts[str(at)] = values.astype("<u4")
    context = _starts(columns[:-1])
    many = np.diff(context, append=counts.size) > MANY
    sums = [np.add.reduceat(x.astype(np.int64), context)[many].astype("<i8") for x in (counts, counts == 1, counts == 2)]
    parts |= dict(zip(("total", "ones", "twos"), sums, strict=True)) | {"many": context[many].astype("<i8")}
    return parts | _small_counts(counts)


# --- training ------------------------------------------------------------------------------------


class Vocabulary:
    """Numbers of the training words, from 1; ``size`` + 1 stands for any other word."""

    def __init__(self, folder: str) -> None:
        store = Store(folder)
        shape = store.get("shape")["shape"]
        self.bits, self.shards = int(shape[0]), int(shape[1])
        self.parts = {int(n[2:]): store.get(n) for n in store.names() if n.startswith("w-")}
        numbers = sorted(self.parts)
        sizes = np.array([self.parts[s]["hashes"].size for s in numbers], np.int64)
        self.offsets = dict(zip(numbers, (1 + np.cumsum(sizes) - sizes).tolist(), strict=True))
        self.size = int(sizes.sum())
        self.tokens = sum(int(self.parts[s]["tokens"][0]) for s in numbers)
        # Words of more tokens than a shard should have, with the shards that are theirs.
        limit = max(255, self.tokens // self.shards)
        ends = int(self.find(np.array([END]))[1][0])
        heavy = [(START, 2 * ends)] if 2 * ends > limit else []
        for s in numbers:
            large = self.parts[s]["often"] > limit
            at = self.parts[s]["often_at"][large] + self.offsets[s]
            heavy += zip(at.tolist(), self.parts[s]["often"][large].tolist(), strict=True)
        self.heavy = np.array([w for w, _ in heavy], np.int64)
        self.shares = np.array([-(-n // limit) for _, n in heavy], np.int64)
        self.bases = self.shards + np.cumsum(self.shares) - self.shares
        #: Numbers in a shard of the words themselves.
        self.span = -(-(self.size + 1) // self.shards)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of sorted hashes."""
        ids, tokens = np.full(hashes.size, self.size + 1, np.int64), np.zeros(hashes.size, np.int64)
        of = _leading(hashes, self.bits)
        at = [*_starts([of]), of.size]
        for a, b in zip(at, at[1:], strict=False):
            if (part := self.parts.get(int(of[a]))) is not None:
                place, hit = _find(part["hashes"], hashes[a:b])
                ids[a:b][hit] = place[hit] + self.offsets[int(of[a])]
                tokens[a:b][hit] = _counts_at(part, place[hit])
        return ids, tokens

    def place(self, columns: list[np.ndarray]) -> np.ndarray:
        """The shards of n-grams."""
        first = columns[0].astype(np.int64)
        if len(columns) == 1:
            return first // self.span
        bits = self.shards.bit_length() - 1
        shard = _leading((first.astype(np.uint64) + np.uint64(1)) * MIX, bits)
        if self.heavy.size:
            at, hit = _find(self.heavy, first)
            mixed = ((columns[1][hit].astype(np.uint64) + np.uint64(1)) * MIX >> np.uint64(33)).astype(np.int64)
            shard[hit] = self.bases[at[hit]] + mixed % self.shares[at[hit]]
        return shard


def _leading(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(hashes.size, np.int64)


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_values, wanted)
    at[at == sorted_values.size] = 0
    return at, sorted_values[at] == wanted


def grams(ranks: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The last ``order`` words up to each token, as columns; START stands before a text."""
    padded = np.full(ranks.size + sizes.size * (order - 1), START, np.int64)
    where = np.arange(ranks.size) + np.repeat(np.arange(1, sizes.size + 1) * (order - 1), sizes)
    padded[where] = ranks
    return [padded[where - back] for back in range(order - 1, -1, -1)]


@lru_cache(maxsize=2)
def open_vocabulary(folder: str) -> Vocabulary:
    return Vocabulary(folder)


def _power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def write_vocabulary(texts: DataFrame, folder: str, bits: int) -> int:
    """Count the words of ``texts`` (text), write them, and return the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = Summed()

        def taken() -> pa.RecordBatch:
            words, n = summed.take()
            return pieces([words], n, _leading(words, bits))

        for batch in slices(batches, "text"):
            summed.add([_hashes(column(batch, "text"))[0]])
            if summed.rows >= SUMMED:
                yield taken()
        if summed.rows:
            yield taken()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for shard, (words,), n in merged(batches, 1):
            store.put(f"w-{shard}", {"hashes": words.astype("<u8"), "tokens": np.array([n.sum()], "<i8")} | _small_counts(n))
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())])], names=["tokens"])

    rows = texts.mapInArrow(count, PIECES).repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(write, "tokens long").agg(F.sum("tokens")).first()[0] or 0


def train(docs: DataFrame, folder: str, order: int = ORDER, shards: int | None = None) -> None:
    """Count the n-grams of all texts of ``docs`` and write the model to ``folder``.

    Null text is the empty text, which has an end token; an empty table gives a model that knows no
    token. Other columns are ignored. ``shards`` is a power of two; by default it follows the
    number of tokens and the session's cores.
    """
    spark = docs.sparkSession
    texts = docs.select(text_of().alias("text"))
    bits = _power_of_two(int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length() - 1
    tokens = write_vocabulary(texts, folder, bits)
    if shards is None:
        shards = _power_of_two(max(32, 2 * spark.sparkContext.defaultParallelism, tokens // SHARD_TOKENS))
    Store(folder).put("shape", {"shape": np.array([bits, shards, order], "<i8")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, tokens = open_vocabulary(folder), [], 0

        def taken() -> pa.RecordBatch:
            hashes, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # Places among the words at hand, which are in the order of their numbers.
            distinct, ranks = np.unique(hashes, return_inverse=True)
            *columns, n = _counted(grams(ranks + 1, sizes, order), None)
            ids = np.append(START, vocabulary.find(distinct)[0])
            columns = [ids[c.astype(np.int64)] for c in columns]
            return pieces(columns, n, vocabulary.place(columns))

        for batch in slices(batches, "text"):
            held.append(_hashes(column(batch, "text")))
            tokens += held[-1][0].size
            if tokens >= SUMMED:
                yield taken()
                tokens = 0
        if held:
            yield taken()

    def level_writer(level: int):
        """Write the shards of a level and pass on the rows of the next lower one."""

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, vocabulary, summed = Store(folder), open_vocabulary(folder), Summed()

            def taken() -> pa.RecordBatch:
                *lower, n = summed.take()
                return pieces(lower, n, vocabulary.place(lower))

            for shard, columns, n in merged(batches, level):
                if level == 1:
                    counts = np.zeros(vocabulary.span, np.int64)
                    counts[columns[0].astype(np.int64) - shard * vocabulary.span] = n
                    store.put(f"1-{shard}", _small_counts(counts))
                else:
                    store.put(f"{level}-{shard}", _shard_file(columns, n))
                    summed.add([c.astype(np.uint32) for c in columns[1:]])
                store.put(f"{level}-{shard}.head", _head(n))
                if summed.rows >= SUMMED:
                    yield taken()
            if summed.rows:
                yield taken()

        return write

    rows = texts.mapInArrow(count, PIECES)
    for level in range(order, 0, -1):
        # A shard of many words and, on the average, at most two of single words go to one task.
        placed = rows.repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int"))
        rows = placed.sortWithinPartitions("shard").mapInArrow(level_writer(level), PIECES)
    rows.write.format("noop").mode("overwrite").save()


# --- scoring -------------------------------------------------------------------------------------


def discounts(often: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 or more, from how many n-grams have the counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in often)
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return np.array([0.0, min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)])


def _bound(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first places in sorted ranges whose value is not below the wanted one."""
    out = low.copy()
    todo = np.flatnonzero(low < high)
    low, high, wanted = low[todo], high[todo], wanted[todo]
    active = np.ones(todo.size, bool)
    while todo.size:
        middle = (low + high) >> 1
        below = (values.take(middle, mode="clip") < wanted) & active
        low, high = np.where(below, middle + 1, low), np.where(below, high, middle)
        active = low < high
        if np.count_nonzero(active) < 0.7 * todo.size:
            out[todo] = low
            todo, low, high, wanted = todo[active], low[active], high[active], wanted[active]
            active = np.ones(todo.size, bool)
    return out


def _ranges(
    values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The parts of sorted ranges that have the wanted value."""
    low = _bound(values, wanted, low, high)
    ends = low.copy()
    hit = np.flatnonzero((values.take(low, mode="clip") == wanted) & (low < high))
    # Most are short, so their ends are near.
    wanted, last, most = wanted[hit], low[hit], high[hit]
    todo, step = np.arange(hit.size), 1
    while todo.size:
        at = last[todo] + step
        same = (at < most[todo]) & (values.take(at, mode="clip") == wanted[todo])
        most[todo[~same]] = np.minimum(at, most[todo])[~same]
        todo, at = todo[same], at[same]
        last[todo], step = at, 2 * step
    ends[hit] = _bound(values, wanted + np.uint32(1), last + 1, most)
    return low, ends


class Model:
    """A model in its folder."""

    def __init__(self, folder: str) -> None:
        self.store, self.vocabulary = Store(folder), open_vocabulary(folder)
        self.order = int(self.store.get("shape")["shape"][2])
        self.names = set(self.store.names())
        heads = [n.split(".")[0].split("-") for n in self.names if n.endswith(".head")]
        self.heads = {(int(k), int(s)): self.store.get(f"{k}-{s}.head")["head"] for k, s in heads}
        self.sums = {
            k: sum((h for (level, _), h in self.heads.items() if level == k), np.zeros(6, np.int64))
            for k in range(1, self.order + 1)
        }
        self.tables: dict[tuple[int, int], dict[str, np.ndarray] | None] = {}

    def table(self, level: int, shard: int) -> dict[str, np.ndarray] | None:
        """A shard, mapped when first asked for."""
        if (level, shard) not in self.tables:
            name = f"{level}-{shard}"
            self.tables[level, shard] = self.store.get(name) if name in self.names else None
        return self.tables[level, shard]

    def by_shard(self, level: int, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Shards with the rows of the columns that belong to them, in order."""
        shard = self.vocabulary.place(columns)
        order = np.argsort(shard, kind="stable")
        at = [*_starts([shard[order]]), order.size]
        for a, b in zip(at, at[1:], strict=False):
            yield int(shard[order[a]]), order[a:b]

    def words(self, word: np.ndarray) -> np.ndarray:
        """Lowest-order probability of words."""
        types = np.zeros(word.size, np.int64)
        for shard, rows in self.by_shard(1, [word]):
            if (part := self.table(1, shard)) is not None:
                at = word[rows] - shard * self.vocabulary.span
                types[rows] = _counts_at(part, at)
        total, size, ones, twos = (int(x) for x in self.sums[1][:4])
        if not total:
            return np.ones(word.size)
        d = discounts(self.sums[1][2:])
        spare = d[1] * ones + d[2] * twos + d[3] * (size - ones - twos)
        return (types - d[np.minimum(types, 3)] + spare / (size + 1)) / total

    def _successors(self, part: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Sum of the counts in ranges, and how many are one and two."""
        size = high - low
        sums = [np.zeros(size.size, np.int64) for _ in range(3)]
        large = np.flatnonzero(size > MANY)
        at = np.searchsorted(part["many"], low[large])
        for out, name in zip(sums, ("total", "ones", "twos"), strict=True):
            out[large] = part[name][at]
        if (few := np.flatnonzero((size > 0) & (size <= MANY))).size:
            starts = np.cumsum(size[few]) - size[few]
            places = np.arange(size[few].sum()) + np.repeat(low[few] - starts, size[few])
            counts = _counts_at(part, places)
            for out, values in zip(sums, (counts, counts == 1, counts == 2), strict=True):
                out[few] = np.add.reduceat(values.astype(np.int64), starts)
        return sums

    def extend(self, columns: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """Probability of the last words of n-grams after the others, given that of the next lower level.

        Equal contexts stand together.
        """
        level, out = len(columns), lower.copy()
        d = discounts(self.sums[level][2:])
        for shard, rows in self.by_shard(level, columns):
            own = [c[rows] for c in columns]
            part, count = self.table(level, shard), np.zeros(rows.size, np.int64)
            context = _starts(own[:-1])
            each = np.repeat(np.arange(context.size), np.diff(context, append=rows.size))
            low = high = np.zeros(context.size, np.int64)
            if part is not None:
                at, hit = _find(part["first"], own[0][context].astype(np.uint32))
                low, high = part["offsets"][at].astype(np.int64), part["offsets"][at + 1].astype(np.int64)
                high = np.where(hit, high, low)
                for name in range(1, level - 1):
                    low, high = _ranges(part[str(name)], own[name][context].astype(np.uint32), low, high)
                values, wanted = part[str(level - 1)], own[-1].astype(np.uint32)
                place = _bound(values, wanted, low[each], high[each])
                inside = np.flatnonzero((place < high[each]) & (values.take(place, mode="clip") == wanted))
                count[inside] = _counts_at(part, place[inside])
            if level == 2 and shard >= self.vocabulary.shards:
                # The successors of such a word are in several shards, which have no others.
                total, size, ones, twos = (np.array([x]) for x in self._of_heavy(int(own[0][0]))[:4])
            elif part is None:
                continue
            else:
                size, (total, ones, twos) = high - low, self._successors(part, low, high)
            spare = d[1] * ones + d[2] * twos + d[3] * (size - ones - twos)
            known = np.flatnonzero(total[each] > 0)
            of, n = each[known], count[known]
            out[rows[known]] = (n - d[np.minimum(n, 3)] + spare[of] * lower[rows[known]]) / total[of]
        return out

    def _of_heavy(self, word: int) -> np.ndarray:
        at = int(np.flatnonzero(self.vocabulary.heavy == word)[0])
        base = int(self.vocabulary.bases[at])
        found = (self.heads.get((2, base + s)) for s in range(int(self.vocabulary.shares[at])))
        return sum((h for h in found if h is not None), np.zeros(6, np.int64))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score and log10 probability."""
        hashes, sizes = _hashes(texts)
        distinct, ranks = np.unique(hashes, return_inverse=True)
        ids, tokens = self.vocabulary.find(distinct)
        p, tokens, ids = self.words(ids)[ranks], tokens[ranks], np.append(START, ids)
        columns = grams(ranks + 1, sizes, self.order)
        for level in range(2, self.order + 1):
            near = columns[self.order - level :]
            order = _order(near)
            rows = [c[order] for c in near]
            at = _starts(rows)
            # Equal n-grams have equal lower-order probability, as that depends on their end only.
            found = self.extend([ids[c[at]] for c in rows], p[order[at]])
            p[order] = np.repeat(found, np.diff(at, append=order.size))
        floor = self.vocabulary.tokens + 0.5 * (self.vocabulary.size + 1)
        starts = np.cumsum(sizes) - sizes
        with np.errstate(divide="ignore"):
            logs = np.log10((tokens + 0.5) / floor), np.log10(p)
        return (
            sizes,
            np.add.reduceat((tokens > 0).astype(np.int64), starts),
            np.add.reduceat(logs[0], starts),
            np.add.reduceat(logs[1], starts),
        )


@lru_cache(maxsize=2)
def open_model(folder: str) -> Model:
    return Model(folder)


def score(docs: DataFrame, folder: str) -> DataFrame:
    """Score all texts of ``docs`` (doc_id, held_out, text) with the model in ``folder``.

    Null text is the empty text: its end token alone. Repeated rows are scored one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder)
        for batch in slices(batches, "text", SCORED_ROWS, SCORED_CHARS):
            n, known, base, logs = model.score(column(batch, "text"))
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            total = pa.array([model.vocabulary.tokens] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), get("held_out"), pa.array(n), pa.array(known), total, pa.array(base), pa.array(logs)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select("doc_id", "held_out", text_of().alias("text"))
    return rows.mapInArrow(run, SCORES)


def train_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learn from the documents outside the test fold and score all of them.

    The fold is the remainder of the crc32 of doc_id written as text; a null doc_id counts as the
    empty text.
    """
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "ngrams")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_fold("doc_id", TEST_FOLDS) == TEST_FOLD).alias("held_out"),
        F.col("text"),
    )
    train(rows.where(~F.col("held_out")), folder, order)
    return score(rows, folder)
