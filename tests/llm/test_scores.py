"""Language, quality, n-grams, fingerprints and pieces against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from themata.llm import crf, kneser_ney, merkle, viterbi, weak_rules
from themata.llm.common import table
from themata.llm.queries import (
    op3_merkle_tree,
    op5_crf_language,
    op7_kneser_ney,
    op8_streaming_viterbi,
    op10_weak_rules,
    vocabulary_path,
)


SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").orderBy("doc_id").collect()


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


# --- n-grams -------------------------------------------------------------------------------------


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition, over tuples of words."""
    counts = [Counter() for _ in range(order + 1)]
    unigrams = Counter()
    for words in texts:
        padded = ["<s>"] * (order - 1) + words
        unigrams.update(words)
        for at in range(order - 1, len(padded)):
            counts[order][tuple(padded[at - order + 1 : at + 1])] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    discounts = {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        if not (n[1] and n[2]):
            discounts[k] = [0, 0.5, 0.5, 0.5]
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2]]
        d.append(3 - 4 * y * n[4] / n[3] if n[3] else d[1])
        discounts[k] = [0, *(min(max(x, 0), i + 1) for i, x in enumerate(d))]
    after = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for gram, c in counts[k].items():
            after[k][gram[:-1]].append(c)
    spares = [{g: sum(discounts[k][min(x, 3)] for x in seen) for g, seen in after[k].items()} for k in range(1, order + 1)]
    totals = [{g: sum(seen) for g, seen in after[k].items()} for k in range(1, order + 1)]

    def probability(context, word):
        k = len(context) + 1
        lower = probability(context[1:], word) if k > 1 else 1 / (len(counts[1]) + 1)
        if context not in totals[k - 1]:
            return lower if k > 1 else 1.0
        c = counts[k].get((*context, word), 0)
        return (c - discounts[k][min(c, 3)] + spares[k - 1][context] * lower) / totals[k - 1][context]

    return probability, unigrams


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lower), "</s>"]


def check_scores(rows, docs, order):
    probability, unigrams = plain_model([tokens(t) for d, t in docs if fold(d, 5) != 1], order)
    total, distinct = sum(unigrams.values()), len(unigrams)
    want = []
    for doc_id, text in docs:
        words = tokens(text)
        padded = ["<s>"] * (order - 1) + words
        logs = sum(
            math.log10(probability(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(words)
        )
        base = sum(math.log10((unigrams[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        known = sum(unigrams[w] > 0 for w in words)
        want.append((str(doc_id), fold(doc_id, 5) == 1, len(words), known, total, base, logs))
    got = [(str(r["doc_id"]), *r[1:]) for r in rows]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-6)


def test_query_op7(spark, docs):
    rows = op7_kneser_ney(spark, SF).collect()
    check_scores(rows, [(r["doc_id"], r["text"]) for r in docs], kneser_ney.ORDER)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 3])
def test_other_orders(spark, docs, order):
    few = docs[:40]
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in few], "doc_id long, text string")
    check_scores(kneser_ney.train_and_score(frame, order).collect(), [(r["doc_id"], r["text"]) for r in few], order)


def test_query_op7_looks_back_two_words(spark, tmp_path):
    """The last word follows from the word two places before it, and not from the one before."""
    docs = [(i, f"{'red' if i % 2 else 'blue'} and {'sky' if i % 2 else 'sea'} {i % 7}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check_scores(op7_kneser_ney(spark, str(tmp_path)).collect(), docs, 3)


def test_odd_ngrams(spark, odd):
    check_scores(kneser_ney.train_and_score(odd).collect(), [r[:2] for r in ODD], 2)
    assert kneser_ney.train_and_score(odd.limit(0)).count() == 0


@pytest.mark.parametrize("words", [["the", "a"], []])
def test_words_with_shards_of_their_own(spark, tmp_path, words):
    """Half of all tokens are one word, or half of all n-grams begin a text; counts go beyond one byte."""
    if words:
        docs = [(i, " ".join(f"the w{(i * j) % 97}" for j in range(60))) for i in range(60)] + [(60, "a b " * 900)]
    else:
        docs = [(i, f"x w{i % 5}") for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", kneser_ney.crc_fold("doc_id", 5) == 1)
    for order in (2, 3):
        folder = str(tmp_path / str(order))
        kneser_ney.train(frame.where(~F.col("held_out")), folder, order, 4)
        vocabulary = kneser_ney.Vocabulary(folder)
        assert vocabulary.shares.max() > 1
        assert (kneser_ney.START in vocabulary.heavy) == (not words)
        check_scores(kneser_ney.score(frame, folder).collect(), docs, order)


def test_ngram_files_are_small(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kneser_ney.train(docs, str(tmp_path / "model"), 3)
    padded = [["<s>", "<s>", *tokens(r["text"])] for r in docs.collect()]
    distinct = {g for words in padded for g in zip(words, words[1:], words[2:], strict=False)}
    assert sum(f.stat().st_size for f in (tmp_path / "model").iterdir()) < 32 * len(distinct)


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 40])
def test_pieces_of_ngrams(most):
    draw = np.random.default_rng(2)
    columns = [draw.integers(0, most, 5000).astype(np.uint64) >> np.uint64(s) for s in (0, 1, 0)]
    want, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    for weights in (None, np.ones(5000, np.int64)):
        *found, sums = kneser_ney._counted(columns, weights)
        assert np.array_equal(np.stack(found, 1), want)
        assert np.array_equal(sums, n)
    back = kneser_ney.unpack(kneser_ney.pack(found, sums), 3)
    assert all(np.array_equal(a, b) for a, b in zip(back, [*found, sums], strict=True))
    assert [x.size for x in kneser_ney.unpack(kneser_ney.pack([c[:0] for c in found], sums[:0]), 3)] == [0] * 4


# --- language ------------------------------------------------------------------------------------


def test_query_op5(spark, docs):
    rows = {r["doc_id"]: r for r in op5_crf_language(spark, SF).collect()}
    assert len(rows) == len(docs)
    held = [d for d in docs if fold(d["doc_id"], 3) == 1]
    assert all(rows[d["doc_id"]]["held_out"] == (fold(d["doc_id"], 3) == 1) for d in docs)
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def brute_marginals(emission, transition):
    n, k = emission.shape
    total = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        weight = math.exp(
            sum(emission[i, p] for i, p in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False))
        )
        for i, p in enumerate(path):
            total[i, p] += weight
    return total / total[0].sum(), math.log(total[0].sum())


def test_forward_backward():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 5, 4])
    emission, transition = rng.normal(size=(13, 3)), rng.normal(size=(3, 3))
    starts = np.cumsum(sizes) - sizes
    marginal, _, logs = crf.forward_backward(emission, starts, sizes, transition)
    for a, n, z in zip(starts, sizes, logs, strict=True):
        want, log = brute_marginals(emission[a : a + n], transition)
        assert marginal[a : a + n] == pytest.approx(want)
        assert z == pytest.approx(log - math.log(3))  # all languages begin alike


def test_labels_of_switched_text(spark):
    tagger = crf.learn(table(spark, "/root/testdata/sf0.01", "documents"))
    en, de = "the of and that this with for", "der die und nicht das ist ein"
    labels = [lang for _, lang in tagger.label(f"{en} {de}")]
    assert labels == ["en"] * 7 + ["de"] * 7


def test_copies_do_not_thin_the_sample(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [("der die das kopie", "de")] * 20_000 + [(f"text von {name(i)}", "de") for i in range(60)]
    assert len(crf.sample(spark.createDataFrame(rows, "text string, lang string"))) == 61


def test_odd_languages(spark, odd):
    rows = crf.identify(odd).collect()
    assert len(rows) == len(ODD)
    by_text = {(r["doc_id"]): r for r in rows}
    for doc_id in (7, 3, 4, 6):
        assert (by_text[doc_id]["lang_pred"], by_text[doc_id]["score"]) == ("und", 0.0)
    assert by_text[5]["lang_pred"] != "und"
    numerals = spark.createDataFrame([(1, "½ ² Ⅷ ①", "en"), (2, "x² + ½", "en")], "doc_id long, text string, lang string")
    tagger = crf.fit([("en", ["a", "b"] * 9), ("de", ["ä", "ö"] * 9)])
    held = numerals.withColumn("held_out", F.lit(True))
    assert [r["lang_pred"] == "und" for r in crf.predict(held, tagger).orderBy("doc_id").collect()] == [True, False]
    assert crf.identify(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in crf.identify(unlabelled).collect()} == {"und"}


# --- quality -------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {
        j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def check_judged(rows, docs):
    want = []
    for doc_id, text in docs:
        m = plain_measures(text)
        want.append((str(doc_id), *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(want) == sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_query_op10(spark, docs):
    rows = op10_weak_rules(spark, SF).collect()
    check_judged(rows, [(r["doc_id"], r["text"]) for r in docs])


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = op10_weak_rules(spark, folder).join(table(spark, folder, "labels"), "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    clean, bad = ([r for r in judged if r["quality"] is not None and r[-2] == q] for q in (1, 0))
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_odd_quality(spark, odd):
    rows = weak_rules.judge(odd).collect()
    check_judged(rows, [r[:2] for r in ODD])
    assert weak_rules.judge(odd.limit(0)).count() == 0


def test_estimate_separates():
    # Two defects that bad texts show half of the time, and good ones hardly ever.
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.9
    share = np.where(good, 0.005, 0.5)[:, None]
    votes = np.where(rng.random((20_000, len(weak_rules.RULES))) < share, 2, 1)
    patterns, counts = np.unique(votes @ 3 ** np.arange(votes.shape[1]), return_counts=True)
    by = dict(zip(patterns, weak_rules.estimate(patterns, counts), strict=True))
    verdict = np.array([by[v] for v in votes @ 3 ** np.arange(votes.shape[1])]) >= 0.5
    assert (verdict == good).mean() > 0.99


# --- fingerprints --------------------------------------------------------------------------------


def check_edits(rows, docs):
    found = {}
    for r in rows:
        found.setdefault((r["doc_id"], r["edited_sha256"]), []).append(r)
    prints = {r["fingerprint"] for r in rows}
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = found[doc_id, hashlib.sha256(edited.encode()).hexdigest()].pop()
        hasher = merkle.Hasher()
        assert row["n_chars"] == len(text)
        assert row["fingerprint"] == hasher.fingerprint(text)
        assert row["edited_fingerprint"] == hasher.fingerprint(edited)
        assert row["near_next"] == merkle.likeness(row["fingerprint"], hasher.fingerprint(after))
        assert row["near_edited"] == merkle.likeness(row["fingerprint"], row["edited_fingerprint"])
    assert not any(found.values())
    assert len(prints) == len({t for _, t in docs})


@pytest.mark.parametrize("ranges", [None, 1, 7, 500])
def test_query_op3(spark, docs, ranges):
    pairs = [(r["doc_id"], r["text"] or "") for r in docs]
    if ranges is None:
        rows = op3_merkle_tree(spark, SF).collect()
    else:
        rows = merkle.edit_likeness(table(spark, SF, "documents"), ranges).collect()
    check_edits(rows, pairs)


def test_odd_fingerprints(spark, odd):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_edits(
        merkle.edit_likeness(one, 3).collect(),
        sorted({(r[0], r[1] or "") for r in ODD if r[0] is not None}),
    )
    assert merkle.edit_likeness(odd).count() == len(ODD)
    assert merkle.edit_likeness(odd.limit(0)).count() == 0
    single = merkle.edit_likeness(odd.where("doc_id = 8")).collect()
    assert single[0]["near_next"] == 1.0
    assert merkle.fingerprints(odd).count() == len(ODD)


def plain_likeness(a, b):
    """Leaves in common order by dynamic programming, for trees of one paragraph."""
    x, y = (merkle.tree(f)[1][0][0] for f in (a, b))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
    return 2 * best[-1][-1] / (len(x) + len(y))


def test_likeness_of_aligned_branches():
    hasher = merkle.Hasher()
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    for _ in range(60):
        words = draw.choices(vocabulary, k=draw.randint(1, 120))
        other = words[: draw.randint(0, len(words))] + draw.choices(vocabulary, k=draw.randint(0, 40))
        a, b = (hasher.fingerprint(" ".join(w)) for w in (words, other))
        if a != b and all(len(merkle.tree(f)[1]) == 1 for f in (a, b)):
            assert merkle.likeness(a, b) == pytest.approx(plain_likeness(a, b))
        assert merkle.likeness(a, b) == merkle.likeness(b, a)
    lines = [f"Paragraph {i} has words of its own. It ends with number {i}." for i in range(12)]
    whole = hasher.fingerprint("\n".join(lines))
    for order in (lines[::-1], lines[1:] + lines[:1], [lines[1], lines[0], *lines[2:]]):
        near = merkle.likeness(whole, hasher.fingerprint("\n".join(order)))
        assert near < 1
    assert near == pytest.approx(11 / 12)
    # One paragraph taken out of 12, also where that moves the cut between sections.
    for gone in range(12):
        rest = hasher.fingerprint("\n".join(lines[:gone] + lines[gone + 1 :]))
        assert merkle.likeness(whole, rest) == pytest.approx(22 / 23)
    assert merkle.likeness(whole, hasher.fingerprint("")) < 0.05
    assert merkle.likeness(hasher.fingerprint("a"), hasher.fingerprint("b")) == 0
    # The same words, cut into paragraphs in another way.
    assert 0.7 < merkle.likeness(hasher.fingerprint("a b c d\ne f g h"), hasher.fingerprint("a b c d e f g h")) < 1


def test_pairs_keep_their_order():
    draw = random.Random(8)
    for _ in range(300):
        a, b = (draw.choices("abcde", k=draw.randint(0, 12)) for _ in range(2))
        pairs = merkle.paired(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_edits_are_located():
    hasher = merkle.Hasher()
    lines = [f"Paragraph {i} has words of its own. It ends with number {i}." for i in range(60)]
    a = hasher.fingerprint("\n".join(lines))
    assert merkle.differing(a, a) == []
    changed = [*lines]
    changed[30] = lines[30].replace("words", "terms")
    b = hasher.fingerprint("\n".join(changed))
    places = merkle.differing(a, b)
    sections = merkle.tree(a)[1]
    numbers = {sum(map(len, sections[:s])) + p for s, p, _ in places}
    assert 30 in numbers and len(numbers) <= 8
    assert 0.9 < merkle.likeness(a, b) < 1


# --- pieces --------------------------------------------------------------------------------------


@lru_cache
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def library_ids(text):
    """The ids of the model's own library, which reads its mark for spaces as a space."""
    return library().encode(text)


def plain_merges(pieces, text):
    """Merging by its definition, over all symbols of the text."""
    order = {t: pieces.order[i] for t, i in pieces.ids.items() if len(t) > 1}
    symbols = list(" " + text)
    while True:
        pairs = [(order.get(a + b, math.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        turn, k = min(pairs, default=(math.inf, 0))
        if turn == math.inf:
            break
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return [i for s in symbols for i in ([pieces.ids[s]] if s in pieces.ids else [pieces.of_byte[b] for b in s.encode()])]


def test_streamed_search_is_the_whole_search():
    codec = viterbi.codec(vocabulary_path("piece_bpe_32k.model"))
    random.seed(2)
    for _ in range(400):
        text = "".join(random.choice("the aninger  \n▁日éx1==----") for _ in range(random.randint(0, 60)))
        ids = codec.encode(text)
        assert list(array("I", ids)) == (plain_merges(codec.pieces, text) if text else [])
        if "▁" not in text:
            assert list(array("I", ids)) == library_ids(text)
        assert codec.decode(ids) == text
        cuts = sorted(random.randint(0, len(text)) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert list(codec.stream(parts)) == list(array("I", ids))


def test_window_stays_bounded():
    codec = viterbi.codec(vocabulary_path("piece_bpe_32k.model"))
    random.seed(5)
    text = " " + "".join(random.choice("theaning") for _ in range(20_000))
    encoder = viterbi.StreamingEncoder(codec.pieces)
    ids = encoder.feed(text, final=True)
    assert ids == library_ids(text[1:])
    assert encoder.largest_window <= 8 * codec.pieces.longest


def test_query_op8(spark, docs):
    rows = {r["doc_id"]: r for r in op8_streaming_viterbi(spark, SF).collect()}
    assert len(rows) == len(docs) and all(r["exact"] for r in rows.values())
    for d in docs:
        assert "▁" not in (d["text"] or "")
        ids = array("I", library_ids(d["text"] or ""))
        assert (rows[d["doc_id"]]["n_ids"], rows[d["doc_id"]]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_odd_pieces(spark, odd):
    model = vocabulary_path("piece_bpe_32k.model")
    assert all(r["exact"] for r in viterbi.round_trips(odd, model).collect())
    back = viterbi.decode_documents(viterbi.encode_documents(odd, model), model).collect()
    assert sorted(map(str, back)) == sorted(map(str, odd.selectExpr("doc_id", "coalesce(text, '') text").collect()))
    assert viterbi.round_trips(odd.limit(0), model).count() == 0


def test_language_stage_frees_encoded_words():
    """A worker that packed documents before does not keep their words while it identifies languages."""
    from types import SimpleNamespace

    import pyarrow as pa

    from themata.llm import crf, encoding
    from themata.llm.queries import vocabulary_path

    encoding.encoder(vocabulary_path("byte_bpe_50k.json"))(["some words that are met"])
    assert encoding.encoder.cache_info().currsize
    tagger = crf.fit([("en", ["the", "words"] * 30), ("de", ["und", "der"] * 30)])
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    docs = SimpleNamespace(
        sparkSession=SimpleNamespace(sparkContext=context), schema=None, mapInArrow=lambda run, _: run
    )
    run = crf.keep_identified(docs, tagger, 0.4)
    batch = pa.RecordBatch.from_arrays([pa.array(["the words", None])], names=["text"])
    assert [b.num_rows for b in run(iter([batch]))] == [1]
    assert encoding.encoder.cache_info().currsize == 0
