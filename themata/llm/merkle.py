"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A text's paragraphs are its lines, a paragraph's sentences end behind ``.``, ``!`` or ``?`` and a
space, and a sentence's leaves are runs of ``LEAF_WORDS`` words. Cutting and joining again gives the
text, so a tree stands for one text. A section ends behind a paragraph whose digest has its low bits
zero, wherever the paragraph stands, so an edit does not move the sections behind it.

A fingerprint is a string: the root's digest, a colon, and the sections by ``;``. A section is its digest,
``/`` and its paragraphs by ``,``; a paragraph is its digest, ``.`` and its leaves, all by the leading digits
of their digests. Equal roots mean equal texts. Two trees are compared from the top: sections of equal
digests that stand in the same order are paired and not entered, between them paragraphs are paired in
the same way, and leaves between those. What is left are the edits, and the share of paired leaves is the
likeness: paragraphs that change places do not keep it at one.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.llm.common import column, text_of

LEAF_WORDS = 4
#: Hexadecimal digits of a leaf in the fingerprint.
LEAF_DIGITS = 6
#: A section has this many paragraphs on average.
SECTION_PARAGRAPHS = 4
#: Hexadecimal digits of a section or paragraph in the fingerprint.
BRANCH_DIGITS = 8
#: Ranges of documents per shuffle partition at least, and bytes of text of a range, about.
RANGES, RANGE_BYTES = 4, 64 << 20

EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def leaves_of(paragraph: str) -> Iterator[str]:
    start, words = 0, paragraph.split(" ")
    for at, word in enumerate(words):
        if at - start + 1 == LEAF_WORDS or word.endswith((".", "!", "?")):
            yield " ".join(words[start : at + 1])
            start = at + 1
    if start < len(words):
        yield " ".join(words[start:])


class Hasher:
    """Fingerprints of texts; remembers the digests of the leaves of the last texts."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def fingerprint(self, text: str) -> str:
        known = self.known
        if len(known) > 100_000:
            known.clear()
        sections: list[list[str]] = [[]]
        branches: list[list[bytes]] = [[]]
        for paragraph in text.split("\n"):
            found = []
            for leaf in leaves_of(paragraph):
                if (d := known.get(leaf)) is None:
                    d = known[leaf] = digest(leaf.encode("utf-8", "surrogatepass"))
                found.append(d)
            branch = digest(b"p" + b"".join(found))
            leaves = "".join([d.hex()[:LEAF_DIGITS] for d in found])
            sections[-1].append(f"{branch.hex()[:BRANCH_DIGITS]}.{leaves}")
            branches[-1].append(branch)
            if branch[-1] % SECTION_PARAGRAPHS == 0:
                sections.append([])
                branches.append([])
        digests = [digest(b"s" + b"".join(b)) for b in branches]
        written = [f"{d.hex()[:BRANCH_DIGITS]}/{','.join(s)}" for d, s in zip(digests, sections, strict=True)]
        return f"{digest(b'r' + b''.join(digests)).hex()}:{';'.join(written)}"


# A node of a parsed tree: its digest, its first leaf, the number of its leaves, and its branches as text.
Node = tuple[str, int, int, str]


def _nodes(text: str, sign: str, mark: str, first: int) -> list[Node]:
    """Branches in a row, by their sign, with digests that end at the mark."""
    out = []
    for part in text.split(sign):
        name, _, rest = part.partition(mark)
        count = _leaf_count(rest)
        out.append((name, first, count, rest))
        first += count
    return out


def _leaf_count(text: str) -> int:
    """Leaves of paragraphs, or of one paragraph."""
    paragraphs = text.count(".")
    if not paragraphs:
        return len(text) // LEAF_DIGITS
    # Each paragraph has its digest, a point and, but for the first, a comma.
    return (len(text) - paragraphs * (BRANCH_DIGITS + 2) + 1) // LEAF_DIGITS


def tree(fingerprint: str) -> tuple[str, list[list[list[str]]]]:
    """The root and the leaves by section and paragraph."""
    root, _, rest = fingerprint.partition(":")
    cut = lambda p: [p[i : i + LEAF_DIGITS] for i in range(0, len(p), LEAF_DIGITS)]
    sections = [s.partition("/")[2] for s in rest.split(";")]
    return root, [[cut(p.partition(".")[2]) for p in s.split(",")] if s else [] for s in sections]


def paired(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal elements in the same order: the common beginning, the common end, and as many
    as possible between them, where the nth occurrence stands for the nth one."""
    first, n, m = 0, len(a), len(b)
    while first < min(n, m) and a[first] == b[first]:
        first += 1
    while n > first and m > first and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(first)]
    if n > first and m > first:
        places = defaultdict(list)
        for j in range(m - 1, first - 1, -1):
            places[b[j]].append(j)
        both = [(i, places[a[i]].pop()) for i in range(first, n) if places.get(a[i])]
        # The longest run of rising places: the last place of the best run of each length.
        tails: list[int] = []
        at: list[int] = []
        before = []
        for k, (_, j) in enumerate(both):
            size = bisect_left(tails, j)
            tails[size:size + 1] = [j]
            at[size:size + 1] = [k]
            before.append(at[size - 1] if size else -1)
        run, k = [], at[-1] if at else -1
        while k >= 0:
            run.append(both[k])
            k = before[k]
        out += run[::-1]
    return out + [(n + i, m + i) for i in range(len(a) - n)]


def _compare(a: list[Node], b: list[Node], level: int) -> Iterator[tuple[int, int, int, int]]:
    """Differing runs of leaves, ``(first, end)`` in a and in b, below nodes in a row."""
    names = [[x[0] for x in side] for side in (a, b)]
    i = j = 0
    for p, q in [*paired(*names), (len(a), len(b))]:
        if p > i or q > j:
            yield from _open(a[i:p], b[j:q], _place(a, i), _place(b, j), level)
        i, j = p + 1, q + 1


def _place(nodes: list[Node], at: int) -> int:
    """The first leaf of a node, or the one behind the last."""
    return nodes[at][1] if at < len(nodes) else nodes[-1][1] + nodes[-1][2] if nodes else 0


def _open(a: list[Node], b: list[Node], at: int, there: int, level: int) -> Iterator[tuple[int, int, int, int]]:
    """The same for nodes without a counterpart: their branches are compared, at the end their leaves."""
    if level == 0:
        sides = [[n for x in side if x[3] for n in _nodes(x[3], ",", ".", x[1])] for side in (a, b)]
    else:
        sides = [
            [(x[3][k : k + LEAF_DIGITS], x[1] + k // LEAF_DIGITS, 1, "") for x in side for k in range(0, len(x[3]), LEAF_DIGITS)]
            for side in (a, b)
        ]
    x, y = sides
    if not x or not y or level > 1:
        yield at, at + sum(n[2] for n in a), there, there + sum(n[2] for n in b)
        return
    yield from _compare(x, y, level + 1)


def changes(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Runs of leaves in which text a differs from text b: ``(first, end)`` in a and in b."""
    if a[:32] == b[:32]:
        return []
    sides = [_nodes(x.partition(":")[2], ";", "/", 0) for x in (a, b)]
    return list(_compare(*sides, 0))


def likeness(a: str, b: str) -> float:
    """Share of leaves that stand in paired branches of two fingerprints, 1 for equal roots.

    Unequal roots are less than 1, also where only the cut into branches differs.
    """
    if a[:32] == b[:32]:
        return 1.0
    total = sum(_leaf_count_of(x) for x in (a, b))
    apart = sum(end - first + last - there for first, end, there, last in changes(a, b))
    return (total - apart) / (total + 1) if total and not apart else (total - apart) / total if total else 0.0


def _leaf_count_of(fingerprint: str) -> int:
    return sum(n[2] for n in _nodes(fingerprint.partition(":")[2], ";", "/", 0))


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """Where text a differs from text b: (section, paragraph, leaf) of a's leaves.

    Branches with equal contents are not entered. Where b has only more text, the place is that
    of the leaf before which it stands, or one behind the last.
    """
    places = [(i, j, k) for i, s in enumerate(tree(a)[1]) for j, p in enumerate(s) for k in range(len(p))]
    behind = (places[-1][0], places[-1][1], places[-1][2] + 1) if places else (0, 0, 0)
    found = []
    for first, end, _, _ in changes(a, b):
        found += places[first:end] if end > first else [places[first] if first < len(places) else behind]
    return sorted(set(found))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with its fingerprints: (doc_id, fingerprint). Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array([hasher.fingerprint(t) for t in column(batch, "text")]),
                ],
                names=["doc_id", "fingerprint"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``part``, ascending ranges of doc_id, and ``guard``.

    The first document of each range also stands, with guard 1, behind the range before it, and that
    of the first range behind the last. So a range alone holds each of its documents and the next
    one, and the texts are shuffled once.
    """
    spark = docs.sparkSession
    # Null ids come first; order by a value that stands for them.
    keyed = docs.withColumn("at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = keyed.approxQuantile("at", shares, 1 / (4 * ranges)) if shares else []
    if cuts:
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        dealt = Bucketizer(splits=splits, inputCol="at", outputCol="part").transform(keyed)
    else:
        dealt = keyed.withColumn("part", F.lit(0.0))
    # One row per range: bounded by the number of ranges.
    heads = sorted((r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.min("at").alias("head")).collect())
    behind = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    table = spark.createDataFrame(behind, "head double, before double")
    places = F.array(
        F.struct(F.col("part").alias("to"), F.lit(0).alias("guard")),
        F.struct(F.col("before").alias("to"), F.lit(1).alias("guard")),
    )
    return (
        dealt.join(F.broadcast(table), F.col("at") == F.col("head"), "left")
        .withColumn("place", F.explode(F.filter(places, lambda p: p["to"].isNotNull())))
        .select("doc_id", "text", "at", F.col("place.to").alias("part"), F.col("place.guard").alias("guard"))
    )


def edit_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and compare it with both neighbours in time.

    The edited text is the text with its last quarter of code points (rounded down) replaced by as
    many, or all, of the first ones of the next document in ascending doc_id; after the last comes
    the first. Null text is the empty text. Rows with equal ids follow each other by a hash of their
    text; null ids come first. One document is its own next one. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    if not size:
        return spark.createDataFrame([], EDITED)
    if ranges is None:
        least = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, math.ceil(size / RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: tuple[float, int, int | None, str, str] | None = None
        out: list[tuple] = []

        def compared(text: str, print_: str, doc_id: int | None, after: str, print_after: str) -> tuple:
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            print_edited = hasher.fingerprint(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            near = likeness(print_, print_edited), likeness(print_, print_after)
            return (doc_id, len(text), sha, print_, print_edited, *near)

        for batch in batches:
            columns = (column(batch, n) for n in ("part", "guard", "doc_id", "text"))
            for part, guard, doc_id, text in zip(*columns, strict=True):
                print_ = hasher.fingerprint(text)
                # Of a range's guards, the first one follows its last document; none has a next one.
                if held is not None and held[0] == part and not held[1]:
                    out.append(compared(held[3], held[4], held[2], text, print_))
                held = (part, guard, doc_id, text, print_)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(_dicts(out), schema=EDITED_ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(_dicts(out), schema=EDITED_ARROW)

    dealt = in_ranges(rows, ranges).withColumn("tie", F.xxhash64("text"))
    return (
        dealt.repartitionById(ranges, F.col("part").cast("int"))
        .sortWithinPartitions("part", "guard", "at", "doc_id", "tie", "text")
        .select("part", "guard", "doc_id", "text")
        .mapInArrow(run, EDITED)
    )


EDITED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _dicts(rows: list[tuple]) -> list[dict]:
    return [dict(zip(EDITED_ARROW.names, r, strict=True)) for r in rows]
