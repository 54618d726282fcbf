"""Near-duplicate classes by ProbMinHash, banding and exact verification.

For each five-word shingle, a Poisson process whose rate is the shingle's weight gives arrival times,
each arrival in a random component; a component keeps the shingle that arrives first. Two texts agree in
a component with the probability Jaccard similarity of their weights. Arrivals of a shingle stop as soon
as they come later than all components' first arrivals, so a signature costs little more than reading
the shingles once.

Links are defined by the shingle sets, so the signature that finds them has equal weights: its components
agree with the Jaccard similarity of the sets. A text that repeats shingles has a second signature, in
which a shingle that occurs n times weighs 1 + ln n; without repeats it would be the same.

Signatures are cut into bands; texts that share a band's key, of either signature, are candidates. One bit
of each component of the first signature goes with them, and a pair whose bits show a similarity far under
the threshold is dropped there. So does a bitmap of each shingle set, in which a bit is set if an odd number of shingles falls on it:
two bitmaps differ in no more bits than their sets differ in shingles, so a pair whose bitmaps differ in too many bits
has no link. The others are linked if the Jaccard similarity of the shingle sets, computed exactly, is ``THRESHOLD`` or
more. Equal shingle sets are one representative, so copies make no pairs. Classes are the connected
components.

A bucket of many sets is not expanded into its pairs. In each round, a few members of a bucket, its
leaders, are compared with the members of other components, and leave the bucket: all their links in
it are then known, or lie within one component. A bucket within one component is done. This ends with
the same components as comparing all pairs. The first rounds look at few bands, so that large groups
of near copies are mostly joined before the other bands are looked at; each later round has more
leaders, so the rounds grow with the logarithm of the largest bucket. Between rounds, labels follow the
new links by one step only, as they just have to be equal for linked sets alone; at the end they
follow all links until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themata.llm.common import column, release_memory, slices, text_of, words_of
from themata.storage import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with a probability of 3e-6.
BANDS, BAND_ROWS = 42, 6
#: A pair needs this estimate of its sets' similarity to be verified: at the threshold, 5 standard errors
#: below it.
LEAST_ESTIMATE = 0.6
#: Bits of a shingle set's bitmap. It tells sets of up to twice as many shingles apart.
PARITY_BITS = 512
#: Shingles of pairs that a task compares at once.
COMPARED = 1 << 20
#: Bands that the first rounds look at; later rounds look at all.
FIRST_BANDS = (2, 12)
#: Leaders of a bucket in the first round over all bands, and their growth from round to round.
LEADERS, GROWTH = 4, 4

MIX = np.uint64(0x9E3779B97F4A7C15)
SIGNED = (
    "doc_id long, text_id long, set_id long, shingles array<int>, bands array<long>, bits array<long>, "
    "parity array<long>"
)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only give equal outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the five-word shingles in order; a shorter text with words is one shingle."""
    from xxhash import xxh3_64_intdigest

    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, (w.encode("utf-8", "surrogatepass") for w in words)), np.uint64, len(words))
    n = max(1, h.size - SHINGLE_WORDS + 1)
    out = np.full(n, np.uint64(min(h.size, SHINGLE_WORDS)))
    for k in range(min(h.size, SHINGLE_WORDS)):
        out = mix(out + h[k : k + n]) * MIX
    return out


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """ProbMinHash signatures of (distinct shingles, weights), each with at least one shingle.

    Returns, for each text and component, the shingle that arrives first.
    """
    counts = np.array([d.size for d, _ in texts])
    text = np.repeat(np.arange(len(texts)), counts)
    shingle = np.concatenate([d for d, _ in texts])
    rate = np.concatenate([w for _, w in texts]).astype(np.float64)
    first = np.full(len(texts) * size, np.inf)
    owner = np.zeros(len(texts) * size, np.uint64)
    time, state = np.zeros(shingle.size), shingle.copy()
    while shingle.size:
        state = state + MIX
        draw = mix(state)
        # 53 bits in (0, 1] for the waiting time, others for the component.
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
        at = text * size + (mix(draw ^ MIX) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        owner[at[won]] = shingle[won]
        # A shingle whose arrivals already come too late for every component is done.
        go = time < first.reshape(-1, size).max(1)[text]
        text, shingle, rate, time, state = text[go], shingle[go], rate[go], time[go], state[go]
    return owner.reshape(-1, size)


def band_keys(owners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.full((owners.shape[0], bands), MIX) + np.arange(bands, dtype=np.uint64) * MIX
    for k in range(rows):
        key = mix(key + owners[:, k::rows][:, :bands])
    return key.view(np.int64)


def component_bits(owners: np.ndarray) -> np.ndarray:
    """One bit per component, as 64-bit integers.

    The bit depends on the component too: where few shingles own all components, equal bits of two of
    them would else show in many components at once.
    """
    salts = np.arange(1, owners.shape[1] + 1, dtype=np.uint64) * MIX
    bits = (mix(owners ^ salts) & np.uint64(1)).astype(np.uint8)
    whole = np.zeros((owners.shape[0], -(-owners.shape[1] // 64) * 64), np.uint8)
    whole[:, : owners.shape[1]] = bits
    return np.packbits(whole, axis=1).view(np.int64)


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of each set of 32-bit hashes, as 64-bit integers: a bit is set if an odd number of them falls on it."""
    row = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    at = (mix(np.concatenate(sets).view(np.uint32) + MIX) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(row * PARITY_BITS + at, minlength=len(sets) * PARITY_BITS).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd.reshape(-1, PARITY_BITS), axis=1).view(np.int64)


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_id, text) to (doc_id, text_id, set_id, sorted 32-bit shingle hashes, band keys, component bits, bitmap).

    ``set_id`` is a 64-bit hash of the shingle set; texts without words have null and no bands. Texts
    that repeat shingles have the bands of their weighted signature after those of the other one. The
    bits depend on the shingle set only, and the bitmap on the 32-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t), return_counts=True) for t in column(batch, "text")]
            some = [i for i, (s, _) in enumerate(sets) if s.size]
            ids = np.zeros(len(sets), np.uint64)
            ids[some] = [xxh3_64_intdigest(sets[i][0].tobytes()) for i in some]
            keys = np.empty((len(some), 2, bands), np.int64)
            used = np.ones((len(sets), 2), bool)
            used[:, 1] = [bool((n > 1).any()) for _, n in sets]
            bits = np.empty((len(some), -(-bands * rows // 64)), np.int64)
            for a in range(0, len(some), 64):
                part = some[a : a + 64]
                owners = signatures([(sets[i][0], np.ones(sets[i][0].size)) for i in part], bands * rows)
                keys[a : a + 64, 0] = band_keys(owners, bands, rows)
                bits[a : a + 64] = component_bits(owners)
                if repeats := [i for i in part if used[i, 1]]:
                    owners = signatures([(sets[i][0], 1 + np.log(sets[i][1])) for i in repeats], bands * rows)
                    keys[a : a + 64][used[part, 1], 1] = band_keys(owners, bands, rows)
            present = np.array([s.size > 0 for s, _ in sets])
            small = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s, _ in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    batch.column(batch.schema.get_field_index("text_id")),
                    pa.array(ids.view(np.int64), mask=~present),
                    lists(np.array([x.size for x in small]), np.concatenate(small)),
                    lists(present * used.sum(1) * bands, keys[used[some]].reshape(-1)),
                    lists(present * bits.shape[1], bits.reshape(-1)),
                    lists(present * (PARITY_BITS // 64), parity_bits(small)[present].reshape(-1)),
                ],
                names=["doc_id", "text_id", "set_id", "shingles", "bands", "bits", "parity"],
            )
        release_memory()

    return docs.mapInArrow(run, SIGNED)


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(values))


def similar(batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """The rows (a, b) of (a, b, x, y) whose sorted hashes x and y reach the threshold.

    Some rows are looked at at once, so a batch of any number of rows takes little memory beside it.
    """
    x, y = (batch.column(batch.schema.get_field_index(n)) for n in ("x", "y"))
    xs, xo = x.flatten().to_numpy(), x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py()
    ys, yo = y.flatten().to_numpy(), y.offsets.to_numpy().astype(np.int64) - y.offsets[0].as_py()
    good = np.empty(batch.num_rows, bool)
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(xo + yo, xo[first] + yo[first] + COMPARED, "right")) - 1)
        dx, dy = np.diff(xo[first : end + 1]), np.diff(yo[first : end + 1])
        row = np.arange(end - first, dtype=np.uint64) << np.uint64(32)
        # Common elements: equal neighbours after sorting (pair, shingle), as sets have no repeats.
        key = np.concatenate([np.repeat(row, dx), np.repeat(row, dy)])
        key |= np.concatenate([xs[xo[first] : xo[end]], ys[yo[first] : yo[end]]]).view(np.uint32)
        key.sort()
        same = key[1:][key[1:] == key[:-1]] >> np.uint64(32)
        common = np.bincount(same.astype(np.int64), minlength=end - first)
        good[first:end] = common >= threshold * (dx + dy - common) - 1e-9
        first = end
    rows = batch.filter(pa.array(good))
    return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"])


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of the threshold or more."""
    left = reps.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = reps.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield similar(batch, threshold)

    # Sets whose sizes differ too much cannot reach the threshold.
    near = F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y")) - 1e-9
    return both.where(near).select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def hooked(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One step: every class of equal labels (id, label) takes the smallest label that a link (a, b)
    shows any of its members. Returns (id, was, label)."""
    ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    seen = ends.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b")
    low = seen.groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
    to = labels.join(low, "id", "left").select(
        "id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("to")
    )
    roots = to.groupBy(F.col("was").alias("old")).agg(F.min("to").alias("root"))
    return to.join(roots, F.col("was") == F.col("old")).select("id", "was", F.col("root").alias("label"))


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Lower the labels (id, label) until linked ids (a, b) share the smallest one.

    Each pass is written out; passes are about the logarithm of the longest chain of labels.
    """
    while True:
        step = materialise(hooked(links, labels), "labels")
        labels = step.select("id", "label")
        if not step.where(F.col("was") != F.col("label")).limit(1).count():
            return labels


def may_link(columns: list[str], components: int, threshold: float) -> str:
    """The condition, in SQL, that the sets of rows x and h may reach the threshold.

    It holds for all pairs that reach it, but for what ``LEAST_ESTIMATE`` says about component bits (s0, s1, ...).
    """
    differ = {k: " + ".join(f"bit_count(x.{c} ^ h.{c})" for c in columns if c[0] == k) for k in "sp"}
    # Of unequal components, half differ in their bit.
    most = int(components * (1 - LEAST_ESTIMATE) / 2)
    numbers = "(x.number + h.number)"
    return (
        # What two sets share is shared, so it is not more than either shares with any set.
        f"least(x.common, h.common) * {1 + threshold} >= {threshold} * {numbers} - 1e-6"
        f" AND {differ['s']} <= {most}"
        # The bitmaps (p0, p1, ...) differ in as many bits as the sets do in shingles, or fewer.
        f" AND ({differ['p']}) * {1 + threshold} <= {1 - threshold} * {numbers} + 1e-6"
    )


def linked_labels(buckets: DataFrame, held: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Component labels (id, label) of the candidate sets.

    ``buckets`` has (band, key, id) for keys of two or more sets, the sets' component bits
    (s0, s1, ...) and bitmaps (p0, p1, ...), and the numbers of their shingles, all of them and those that other sets have too;
    ``held`` has the sets' shingles.
    """
    carried = [c for c in buckets.columns if c not in ("band", "key", "id")]
    near = may_link([c for c in carried if c not in ("number", "common")], bands * rows, threshold)
    labels = held.select("id", F.col("id").alias("label"))
    links: DataFrame | None = None
    leaders, turn = LEADERS, 0
    while True:
        looked = FIRST_BANDS[turn] if turn < len(FIRST_BANDS) else bands
        turn += 1
        now = buckets.where(F.col("band") < looked).join(labels, "id")
        spread = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        live = materialise(
            now.join(spread.where("low <> high").select("key"), "key").select("band", "key", "id", "label", *carried),
            "live",
        )
        if not live.limit(1).count():
            if looked >= bands:
                return labels if links is None else components(links, labels)
            continue
        parts = leaders if looked >= bands else 1
        heads = live.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("class")).agg(
            F.min("id").alias("head"),
            F.min_by("label", "id").alias("head_label"),
            *[F.min_by(c, "id").alias(c) for c in carried],
        )
        pairs = (
            live.alias("x")
            .join(heads.alias("h"), F.expr(f"x.key = h.key AND x.label <> h.head_label AND {near}"))
            .select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
            .distinct()
        )
        found = materialise(verified(pairs, held, threshold), "links")
        links = found if links is None else links.unionByName(found)
        labels = materialise(hooked(found, labels).select("id", "label"), "labels")
        if looked >= bands:
            # Members that led leave; buckets within one component are left out from here on.
            rest = live.join(heads.select("key", F.col("head").alias("id")), ["key", "id"], "left_anti")
            buckets = materialise(rest.select("band", "key", "id", *carried), "buckets")
            leaders *= GROWTH


def shared_shingles(held: DataFrame, threshold: float) -> DataFrame:
    """``held`` with the ``number`` of shingles of each set and how many of them are ``common``, that is,
    in another set too. Sets of which less than the threshold is common have no links and are left out.

    Near copies that were changed in many places have many shingles of their own, so most pairs of
    them need no verification. Sets are counted before they are shuffled.
    """
    alone = (
        held.select("id", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .where("n = 1")
        .groupBy("id")
        .agg(F.count("*").alias("alone"))
    )
    number = F.size("shingles")
    counted = held.join(alone, "id", "left").select(
        *[c for c in held.columns if c != "shingles"], number.alias("number"), (number - F.coalesce("alone", F.lit(0))).alias("common")
    )
    return counted.where(F.col("common") >= threshold * F.col("number") - 1e-6)


def text_id() -> Column:
    return F.xxhash64(text_of())


def labelled_sets(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets (doc_id, text_id, set_id), the first doc_id of each set (set_id, first), and the
    component labels (id, label) of the candidate sets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("text_id"), text_of().alias("text"))
    signed = materialise(sign(texts, bands, rows), "signed")
    members = signed.select("doc_id", "text_id", "set_id")
    firsts = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    keyed = (
        signed.where("set_id is not null")
        .select(F.col("set_id").alias("id"), F.posexplode("bands").alias("at", "key"))
        .select("id", (F.col("at") % bands).alias("band"), "key")
        .repartition("key")
        .groupBy("key", "band", "id")
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    pairs = materialise(keyed.join(shared, "key").select("band", "key", "id"), "shared-keys")
    # One row per candidate set: that of its first document.
    chosen = pairs.select("id").distinct().join(firsts, F.col("id") == F.col("set_id")).select("id", "first")
    held = materialise(
        signed.join(chosen, (F.col("set_id") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("first")))
        .select("id", "shingles", "bits", "parity")
        .dropDuplicates(["id"]),
        "candidates",
    )
    words = -(-bands * rows // 64)
    bits = shared_shingles(held, threshold).select(
        "id",
        *[F.col("bits")[k].alias(f"s{k}") for k in range(words)],
        *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_BITS // 64)],
        "number",
        "common",
    )
    buckets = materialise(pairs.join(bits, "id"), "buckets")
    return members, firsts, linked_labels(buckets, held.select("id", "shingles"), bands, rows, threshold)


def near_duplicate_classes(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """The class of each row of ``docs`` (doc_id, text): (doc_id, class_id).

    ``class_id`` is the smallest doc_id of the class. Null text is the empty text. Texts without
    words have no near copies: their class_id is their doc_id. Rows with a null doc_id take part and
    have the class's smallest doc_id, or null. Repeated rows are kept. Other columns are ignored. An
    empty table gives no rows.
    """
    members, firsts, labels = labelled_sets(docs, threshold, bands, rows)
    named = labels.join(firsts, F.col("id") == F.col("set_id")).select("id", "label", "first")
    lowest = named.groupBy("label").agg(F.min("first").alias("class_id"))
    classes = named.join(lowest, "label").select(F.col("id").alias("set_id"), "class_id")
    every = firsts.join(classes, "set_id", "left").select("set_id", F.coalesce("class_id", "first").alias("class_id"))
    return members.join(every, "set_id", "left").select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def one_of_each_class(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """One row of ``docs`` for each class, that with the smallest doc_id; all columns stay.

    Rows with one doc_id and text count as one row. Of rows with the smallest doc_id and different
    texts, and of a class without doc_ids, the one with the smallest hash of the text stays. Texts
    without words are classes of their own.
    """
    members, _, labels = labelled_sets(docs, threshold, bands, rows)
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_id")
    found = members.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    chosen = (
        found.where("set_id is not null")
        .groupBy(F.coalesce("label", "set_id").alias("class"))
        .agg(F.min(rank).alias("kept"))
        .select("kept.doc_id", "kept.text_id")
        .union(members.where("set_id is null").select("doc_id", "text_id").distinct())
        .select(F.col("doc_id").alias("keep"), F.col("text_id").alias("text_id"))
    )
    repeated = members.groupBy("doc_id", "text_id").count().where("count > 1").limit(1).count()
    # The row stands in a column of its own, so no name of its columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_id().alias("of"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("keep")) & (F.col("of") == F.col("text_id")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["id", "of"])
    return kept.select("row.*")
