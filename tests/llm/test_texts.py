"""Near duplicates, line removal, pages and the pipeline against plain versions."""

from __future__ import annotations

import html
import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_rows import INTERNAL, ODD
from pyspark.sql import functions as F

import corpus_pipeline
from themata.llm import line_spread, probminhash, style_tree
from themata.llm.common import table
from themata.llm.crf import learn, words_in
from themata.llm.queries import op2_style_tree, op4_probminhash, op6_line_spread
from themata.llm.weak_rules import judge
from themata.storage import materialise

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- near duplicates -----------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter()
    for held in holders.values():
        common.update((a, b) for n, a in enumerate(held) for b in held[n + 1 :])
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            parent[root(a)] = root(b)
    smallest = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[root(i)].append(doc_id)
    return sorted(
        (str(d), str(min(smallest[root(i)], default=None)) if sets[i] else str(d)) for i, (d, _) in enumerate(docs)
    )


def check_classes(frame, **options):
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    rows = probminhash.near_duplicate_classes(frame, **options).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in rows) == plain_classes(docs)


def test_query_op4(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = op4_probminhash(spark, "/root/testdata/sf0.01").collect()
    want = plain_classes([tuple(r) for r in docs.collect()])
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in rows) == want


def test_components_agree_probably():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (60, 20, 30))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    u, v = rng.integers(1, 5, x.size), rng.integers(1, 5, y.size)
    wx, wy = dict(zip(x.tolist(), u.tolist(), strict=True)), dict(zip(y.tolist(), v.tolist(), strict=True))
    every = set(wx) | set(wy)
    want = sum(
        1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in every) for d in common.tolist()
    )
    signed = probminhash.signatures([(x, u), (y, v)], 20_000)
    assert (signed[0] == signed[1]).mean() == pytest.approx(want, abs=0.015)


def test_groups_that_share_buckets(spark):
    """Chains of near copies, a large group of them, copies, and texts that share a passage only."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(150):
        text = [*base]
        for _ in range(2):
            text[random.randrange(120)] = word()
        rows.append(" ".join(text))
    chain = [word() for _ in range(150)]
    for step in range(12):
        rows.append(" ".join(chain[step * 6 :] + [word() for _ in range(6 * step)]))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(25 + i % 20)) for i in range(60)]
    rows += [rows[3]] * 40 + ["same words"] * 5 + [""] * 3
    frame = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    check_classes(frame)
    check_classes(frame, bands=60, rows=2)


def test_near_copies_with_repeated_passages(spark):
    """Sets at 0.8 or more whose texts repeat different shares of their shingles, and small sets."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(40):
        base = [word() for _ in range(189)]
        near = base[:-14] + [word() for _ in range(14)]
        rows += [" ".join(base), " ".join(near[:60] * (10 + i) + near[60:]), " ".join(base[:50] * 5 + base[50:])]
    for _ in range(200):
        few = [word() for _ in range(9)]
        rows += [" ".join(few), " ".join(few[:-1])]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert len({c for _, c in plain_classes(list(enumerate(rows)))}) == 240
    check_classes(frame)


def test_odd_classes(spark, odd):
    check_classes(odd)
    assert probminhash.near_duplicate_classes(odd.limit(0)).count() == 0
    kept = probminhash.one_of_each_class(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "7", "8", "None"]


def test_columns_of_any_name_stay(odd):
    for frame in (
        line_spread.remove_widespread(odd), judge(odd.drop("n_words", "kept")), probminhash.one_of_each_class(odd)
    ):
        rows = frame.collect()
        assert rows and all(r[n] == n for r in rows for n in INTERNAL)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 31), 1 << 31, 700, np.int64).astype(np.int32)
    sets = [np.unique(np.concatenate([base[: 700 - k], rng.integers(0, 1 << 31, k // 2).astype(np.int32)])) for k in range(0, 700, 7)]
    sets.append(np.empty(0, np.int32))
    bits = np.unpackbits(probminhash.parity_bits(sets).view(np.uint8), axis=1)
    for a in range(0, len(sets), 9):
        for b in range(len(sets)):
            unequal = np.setxor1d(sets[a], sets[b]).size
            assert (bits[a] != bits[b]).sum() <= unequal
            assert (unequal - (bits[a] != bits[b]).sum()) % 2 == 0
    assert (bits[0] != bits[1]).sum() >= 7


def test_copies_with_equal_changes_are_not_compared_all(spark, monkeypatch):
    """Copies whose changes are also found in other copies, on both sides of the threshold."""
    random.seed(14)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(7))
    base, other = [word() for _ in range(150)], [[word() for _ in range(2)] for _ in range(150)]
    rows = [" ".join(base)]
    for i in range(400):
        text = [*base]
        for at in random.sample(range(150), 1 + i % 9):
            text[at] = random.choice(other[at])
        rows.append(" ".join(text))
    compared, plain = [], probminhash.verified
    monkeypatch.setattr(probminhash, "verified", lambda p, *a: (compared.append(p.count()), plain(p, *a))[1])
    check_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sum(compared) < 4 * len(rows), compared


def test_verification_holds_few_pairs_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-(1 << 31), 1 << 31, 600, np.int64).astype(np.int32)) for _ in range(50)]
    near = [np.unique(np.concatenate([s[: 600 - 5 * k], s[600 - 5 * k :] ^ 1])) for k, s in enumerate(sets)]
    pairs = [(sets[i % 50].tolist(), near[(i if i % 3 else i + 1) % 50].tolist()) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(4000)), pa.array(range(4000)), *(pa.array(c, pa.list_(pa.int32())) for c in zip(*pairs, strict=True))],
        names=["a", "b", "x", "y"],
    )
    links = [i for i, (x, y) in enumerate(pairs) if len({*x} & {*y}) >= 0.8 * len({*x} | {*y}) - 1e-9]
    tracemalloc.start()
    found = probminhash.similar(batch.slice(0), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column(0).to_pylist() == found.column(1).to_pylist() == links
    assert 0 < len(links) < 4000 and peak < 60e6, peak
    assert probminhash.similar(batch.slice(17, 900), 0.8).column(0).to_pylist() == [i for i in links if 17 <= i < 917]
    monkeypatch.setattr(probminhash, "COMPARED", 1)
    assert probminhash.similar(batch, 0.8).column(0).to_pylist() == links


def test_changed_copies_are_not_verified(spark):
    """A group of copies that all differ in many words of their own, around one that is linked."""
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(150)]
    rows = [" ".join(base)]
    for i in range(300):
        text = [*base]
        for _ in range(1 + i % 9):
            text[random.randrange(150)] = word()
        rows.append(" ".join(text))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    check_classes(frame)
    held = probminhash.sign(
        frame.select("doc_id", F.lit(0).cast("long").alias("text_id"), "text"), probminhash.BANDS, probminhash.BAND_ROWS
    ).select(F.col("set_id").alias("id"), "shingles", "bits")
    kept = probminhash.shared_shingles(held, 0.8).collect()
    sets = [shingles(t) for t in rows]
    seen = Counter(x for s in sets for x in s)
    common = sorted((len(s), sum(seen[x] > 1 for x in s)) for s in sets)
    assert sorted((r["number"], r["common"]) for r in kept) == [c for c in common if c[1] >= 0.8 * c[0]]
    assert len(kept) < 0.9 * len(rows)


def test_one_row_of_classes_without_or_with_repeated_ids(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = [t + " more" for t in base]
    rows = [(None, base[0]), (None, near[0]), (None, base[1]), (1, near[1]), (5, base[2]), (2, near[2]), (5, base[3]), (5, base[3])]
    kept = probminhash.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 4 and {(1, near[1]), (2, near[2]), (5, base[3])} < {tuple(r) for r in kept}


# --- lines ---------------------------------------------------------------------------------------


def plain_removal(docs, min_sites):
    blanks = " \t\n\x0b\x0c\r"
    sites, keeper = defaultdict(set), {}
    for doc_id, text, site in docs:
        for line in (text or "").split("\n"):
            if bare := line.strip(blanks):
                if site is not None:
                    sites[bare].add(site)
                if doc_id is not None:
                    keeper[bare] = min(keeper.get(bare, doc_id), doc_id)
    out = []
    for doc_id, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if len(sites[x.strip(blanks)]) < min_sites or keeper.get(x.strip(blanks)) == doc_id
        ]
        out.append((str(doc_id), "\n".join(kept) if len(kept) < len(lines) else str(text), len(lines) - len(kept)))
    return sorted(out)


def test_query_op6(spark):
    rows = op6_line_spread(spark, SF).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(line_spread.oracle()).fetchall()
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in rows) == sorted(want)


@pytest.mark.parametrize("min_sites", [2, 10, 40])
def test_spread_near_the_threshold(spark, min_sites):
    random.seed(min_sites)
    docs = []
    for i in range(400):
        lines = [f"line {k}" for k in range(60) if random.random() < k / 60]
        lines += [f"own {i}", " ", f"  line {random.randrange(60)}\t"]
        random.shuffle(lines)
        docs.append((i, "\n".join(lines), f"site {random.randrange(60)}" if i % 9 else None))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = line_spread.remove_widespread(frame, "source", min_sites).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_removed"]) for r in rows) == plain_removal(docs, min_sites)


def test_odd_lines(spark, odd):
    rows = line_spread.remove_widespread(odd.withColumn("n_removed", F.lit("z")), "source", 1).collect()
    want = plain_removal([(r[0], r[1], r[3]) for r in ODD], 1)
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_removed"]) for r in rows) == want
    assert line_spread.remove_widespread(odd.limit(0)).count() == 0


# --- pages ---------------------------------------------------------------------------------------


def test_query_op2(spark):
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    rows = op2_style_tree(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        inner = re.sub(r"</?(p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert r["text"] == " ".join(html.unescape(inner).split())
        assert r["n_chars"] == len(r["text"])


def page(number, body):
    return (
        f"<html><body><div class='x1'><b>Our</b> site, all days</div><div class='x2'>{body}"
        f"<div class='x3'>Also seen: <a>one</a><a>two</a></div></div><section>Last {number % 2}</section></body>"
    )


def test_tree_finds_what_repeats(spark):
    rows = [(i, f"http://Host.example/{i}", page(i, f"<p>Text {i} &amp; more<p>and {i * 7}")) for i in range(40)]
    rows += [(i, "http://small.example/", page(i, "<p>Alone")) for i in range(40, 42)]
    rows += [(50, "http://host.example:80/c", page(1, "<article><p>Copy</p></article>"))] * 3
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = defaultdict(list)
    for r in style_tree.extract(frame).collect():
        found[r["page_id"]].append(r["text"])
    assert all(found[i] == [f"Text {i} & more and {i * 7}"] for i in range(40))
    assert found[40] == ["Our site, all days Alone Also seen: onetwo Last 0"]
    assert found[50] == ["Copy"] * 3


def nested(number):
    """Boilerplate without telling names: a frame around the text, blocks in blocks, and links."""
    links = "".join(f"<i><a>{w}</a></i>" for w in ("one", "two", "three"))
    return (
        f"<div class=a><div class=b><div class=c>All our pages</div><div class=d>{links}</div></div>"
        f"<div class=e><div class=f><p>Text {number} is <b>new</b></div><div class=g><div class=h>Call us</div></div></div>"
        f"<div class=k><div class=c>Written {number}</div></div></div>"
    )


def plain_importance(pages):
    """Importance by path from whole branches: texts and child elements, by definition."""
    shown = defaultdict(lambda: (Counter(), Counter()))
    for markup in pages:
        root = style_tree.parse(markup)
        here = defaultdict(list)

        def walk(node, path):
            for child in node.children:
                if isinstance(child, style_tree.Element) and child.tag not in style_tree.INLINE_TAGS:
                    at = (*path, child.label)
                    labels = [c.label for c in child.children if isinstance(c, style_tree.Element)]
                    runs = tuple(x for i, x in enumerate(labels) if not i or labels[i - 1] != x)
                    here[at].append((runs, tuple(style_tree.text_blocks(child, set()))))
                    if child.tag not in style_tree.TEXT_TAGS:
                        walk(child, at)

        walk(root, ())
        for at, found in here.items():
            shown[at][0][tuple(f[0] for f in found)] += 1
            shown[at][1][tuple(f[1] for f in found)] += 1
    out = {}
    for at, kinds in shown.items():
        n = sum(kinds[0].values())
        entropy = [-sum(c / n * math.log(c / n) for c in k.values()) / math.log(n) for k in kinds]
        out[at] = 0.2 * entropy[0] + 0.8 * entropy[1]
    return out


def test_the_tree_decides(spark):
    """Against a plain tree; without the tree every page keeps its boilerplate."""
    rows = [(i, "http://h.example/", nested(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in style_tree.extract(frame).collect()}
    assert found == {i: f"Text {i} is new Written {i}" for i in range(30)}
    without = {r["page_id"]: r["text"] for r in style_tree.extract(frame, least=0.0).collect()}
    assert all(without[i] != found[i] and "Call us" in without[i] for i in found)
    importance = plain_importance([r[2] for r in rows])
    low = {at for at, value in importance.items() if value < style_tree.MIN_IMPORTANCE}
    assert low == {
        ("div.a", "div.b"), ("div.a", "div.b", "div.c"), ("div.a", "div.b", "div.d"),
        ("div.a", "div.e", "div.g"), ("div.a", "div.e", "div.g", "div.h"),
    }
    hosted = frame.withColumn("host", F.lit("h"))
    assert style_tree.unimportant_paths(hosted).count() == len(low)


def test_time_grows_with_the_page():
    pages = {
        "nested": "<div>" * 8000 + "deep", "stray": "<div>" * 8000 + "</p></b></section>" * 8000,
        "lists": "<ul><li>" * 8000 + "x", "quotes": "<blockquote>" * 8000 + "<p>" * 100 + "x",
    }
    for name, markup in pages.items():
        began = time.process_time()
        style_tree.features(markup)
        style_tree.main_text(markup, set())
        assert time.process_time() - began < 1.0, name


def test_importance_is_entropy(spark):
    rows = [(i, "http://h.example/", f"<div class=a>{i % 2}</div><div class=b>{i}</div>") for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    # Two contents on eight pages: a third of the largest entropy.
    least = style_tree.CONTENT_WEIGHT / 3
    for limit, n in ((least - 0.01, 0), (least + 0.01, 1)):
        assert style_tree.unimportant_paths(frame, 4, limit).count() == n


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (None, ""),
        ("", ""),
        ("no tags at all &lt;3", "no tags at all <3"),
        ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
        ("<nav>x</nav><main><header><h1>T</h1></header><p>u</p><aside>v</aside></main><p>w</p>", "T u"),
        ("<article>a<form>f</form><div class='share-box'>s</div><section id=comments><p>c</section>b</article>", "a b"),
        ("<script>if (a < b) '<p>'</script><style>p{}</style><div hidden>h</div>x", "x"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<p>unclosed <b>bold</p></i></div> tail<!-- c --><article", "unclosed bold tail"),
        ("<div class='cookie-notice'>k</div><p title='a > b'>q</p>", "q"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_markup(markup, text):
    assert style_tree.main_text(markup or "", set()) == text


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        # Wrappers that are named after their layout.
        ("<div class='layout with-sidebar'><article>a b</article></div>", "a b"),
        ("<div id=page class=header-fixed><nav>n</nav><article>a b</article></div>", "a b"),
        ("<form id=search><main>a b</main></form>", "a b"),
        ("<div class='has-sidebar'><p>a</p><div class=sidebar>s</div></div>", "a"),
        # Names of which a role word is only a part, and whole pages in a wrapper with such a name.
        ("<div class='legal-news'><p>a b</p></div>", "a b"),
        ("<div id='side-effects'>a b<div class='ad-box'>c</div><div class=post-comments>d</div></div>", "a b"),
        ("<div class=sidebar><p>a b</p><script>s</script><nav>n</nav></div>", "a b"),
        # Parts of an article.
        ("<article>a<section id=discussion><p>b</section><p class=notice>c<div class=ad>d</div></article>", "a b c"),
        ("<article class='post category-advertising header-fixed'>a</article>", "a"),
        # Articles that are not main text.
        ("<div><p>the main text of it</div><article class=comment>c</article>", "the main text of it"),
        ("<article>a<article class='comment-body'><p>c</article></article>", "a"),
        ("<article>a</article><div class=comments><article class=comment>c</article></div>", "a"),
        ("<article>a b</article><aside><article>t</article></aside>", "a b"),
        ("<div><p>the main text of it</div><article class=card>t</article>", "the main text of it t"),
    ],
)
def test_names_of_wrappers_and_articles(markup, text):
    assert style_tree.main_text(markup, set()) == text


def test_odd_pages(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "not a url", None), (2, "http://[", "<p>b"), (3, "ftp://u@H:1/", "")]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, host string, page int")
    found = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in style_tree.extract(frame).collect())
    assert found == [("1", "a", 1), ("1", "a", 1), ("2", "b", 1), ("3", "", 0), ("None", "", 0)]
    assert style_tree.extract(frame.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality rules", "line dedup", "MinHash near-dedup", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        ids = {r["doc_id"] for r in before}
        out = materialise(stage(spark, docs, SF), "stage")
        rows = [r.asDict() for r in out.collect()]
        kept = {r["doc_id"] for r in rows}
        if name != names[-1]:
            assert out.columns == columns and len(rows) == len(kept)
        if name == names[0]:
            tagger = learn(docs)
            marginals = tagger.word_marginals([words_in(r["text"] or "") for r in before])
            good = [len(m) > 0 and m.mean(0).max() >= corpus_pipeline.MIN_LANGUAGE_SCORE for m in marginals]
            assert kept == {r["doc_id"] for r, g in zip(before, good, strict=True) if g}
        elif name == names[1]:
            assert kept == {r["doc_id"] for r in judge(docs).where("kept").collect()}
        elif name == names[2]:
            cleaned = plain_removal([(r["doc_id"], r["text"], r["source"]) for r in before], line_spread.MIN_SITES)
            left = sorted((d, t) for d, t, n in cleaned if not n or t.strip())
            assert left == sorted((str(r["doc_id"]), r["text"]) for r in rows)
        elif name == names[3]:
            classes = plain_classes([(r["doc_id"], r["text"]) for r in before])
            assert {str(k) for k in kept} == {c for _, c in classes}
        else:
            assert kept == ids
            assert sum(r["offset"] == 0 for r in rows) == len({r["sequence_id"] for r in rows})
        if name in names[:2] + names[3:4]:
            same = {r["doc_id"]: r for r in before}
            assert all(same[r["doc_id"]] == r for r in rows)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_pipeline_without_documents(spark, tmp_path):
    empty = table(spark, SF, "documents").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
