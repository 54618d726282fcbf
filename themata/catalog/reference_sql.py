"""The registered queries in SQL for DuckDB, one statement each.

The statements share common table expressions; ``statement`` puts those a query
needs in front of it. One column per topic stands for an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from themata.catalog import settings as S
from themata.functions.draws import poisson_thresholds

K = range(S.TOPICS)


def number(v: float) -> str:
    """A DOUBLE literal with all digits."""
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def each(template: str, sep: str = ", ") -> str:
    """``template`` for every topic, with ``#`` replaced by its number."""
    return sep.join(template.replace("#", str(k)) for k in K)


# Asymptotic series after twelve steps up, not the ones of the engine. Bernoulli numbers.
_STEPS_UP = 12


def digamma(x: str) -> str:
    y = f"({x} + {_STEPS_UP})"
    series = (
        f"ln({y}) - 1e0 / (2 * {y}) - 1e0 / (12 * {y} ** 2) + 1e0 / (120 * {y} ** 4) "
        f"- 1e0 / (252 * {y} ** 6) + 1e0 / (240 * {y} ** 8) - 1e0 / (132 * {y} ** 10)"
    )
    steps = " - ".join(f"1e0 / ({x} + {i})" for i in range(_STEPS_UP))
    return f"({series} - {steps})"


def trigamma(x: str) -> str:
    y = f"({x} + {_STEPS_UP})"
    series = (
        f"1e0 / {y} + 1e0 / (2 * {y} ** 2) + 1e0 / (6 * {y} ** 3) - 1e0 / (30 * {y} ** 5) "
        f"+ 1e0 / (42 * {y} ** 7) - 1e0 / (30 * {y} ** 9) + 5e0 / (66 * {y} ** 11)"
    )
    steps = " + ".join(f"1e0 / ({x} + {i}) ** 2" for i in range(_STEPS_UP))
    return f"({series} + {steps})"


# --- keyed random values: SplitMix64 in integer arithmetic ---

# Multipliers of the generator.
_GOLDEN, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(z: int) -> int:
    """One step of the generator for a constant."""
    z = (z + _GOLDEN) % 2**64
    z = (z ^ (z >> 30)) * _MIX_A % 2**64
    z = (z ^ (z >> 27)) * _MIX_B % 2**64
    return z ^ (z >> 31)


def _wide(op: str, z: str, k: int) -> str:
    return f"CAST((CAST({z} AS UHUGEINT) {op} {k}::UHUGEINT) % {2**64}::UHUGEINT AS UBIGINT)"


def mix(x: str) -> str:
    """One step of the generator for a UBIGINT. A list of one element names a value."""
    out = f"list_transform([{_wide('+', x, _GOLDEN)}], lambda z: {_wide('*', 'xor(z, z >> 30)', _MIX_A)})"
    out = f"list_transform({out}, lambda z: {_wide('*', 'xor(z, z >> 27)', _MIX_B)})"
    return f"list_transform({out}, lambda z: xor(z, z >> 31))[1]"


def _gamma_draw(state: str, shape: float = 100.0) -> str:
    """Gamma(shape, 1/shape) by rejection; the chance of three rejections is below 1e-9."""
    d = shape - 1 / 3
    c = 1 / (9 * d) ** 0.5
    tries = []
    for attempt in range(3):
        u1, u2, u3 = (
            f"((CAST({mix(f'xor({state}, {_mixed(3 * attempt + i)}::UBIGINT)')} >> 11 AS DOUBLE) "
            f"+ 0.5e0) * {number(2.0**-53)})"
            for i in range(3)
        )
        x = f"sqrt(-2e0 * ln({u1})) * cos(2e0 * pi() * {u2})"
        v = f"(1e0 + {number(c)} * x) ** 3"
        d_ = number(d)
        value = (
            f"CASE WHEN v > 0 AND ln({u3}) < 0.5e0 * x * x + {d_} - {d_} * v + {d_} * ln(v) "
            f"THEN {d_} * v / {number(shape)} END"
        )
        inner = f"list_transform([{v}], lambda v: {value})[1]"
        tries.append(f"list_transform([{x}], lambda x: {inner})[1]")
    return f"coalesce({', '.join(tries)})"


def gamma_rows(key: str, source: str, name: str, iteration: int) -> str:
    """``key`` and one draw ``<name>#`` per topic for the rows of ``source``."""
    start = _mixed(_mixed(S.SEED) ^ iteration)
    row = mix(f"xor(CAST({key} AS UBIGINT), {start}::UBIGINT)")
    states = ", ".join(f"{mix(f'xor(r, {_mixed(k)}::UBIGINT)')} AS s{k}" for k in K)
    return (
        f"SELECT {key}, {', '.join(f'{_gamma_draw(f"s{k}")} AS {name}{k}' for k in K)} FROM "
        f"(SELECT {key}, {states} FROM (SELECT {key}, {row} AS r FROM {source}))"
    )


def draws(iteration: int) -> str:
    u = (
        f"(CAST('0x' || substr(md5('{S.SEED}:{iteration}:' || CAST(doc_id AS VARCHAR)), 1, 13) "
        f"AS BIGINT) / {number(2**52)})"
    )
    return " + ".join(
        f"CAST({u} >= {number(t)} AS INTEGER)" for t in poisson_thresholds(S.FRACTION)
    )


START = (
    f"1e0 + (({S.WORD_FACTOR} * word_id + {S.TOPIC_FACTOR} * # + tf) % {S.MODULUS}) "
    f"/ {number(S.SCALE)} AS l#"
)

# name -> (names it reads, body)
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "tok": (
        (),
        "SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), "
        "lambda x: length(x) >= 3) AS t FROM documents",
    ),
    "pairs": (
        ("tok",),
        "SELECT doc_id, word, count(*) AS cnt FROM "
        "(SELECT doc_id, unnest(t) AS word FROM tok) GROUP BY doc_id, word",
    ),
    "vocab": (
        ("pairs",),
        "SELECT word, row_number() OVER (ORDER BY tf DESC, word) - 1 AS word_id, tf, df FROM "
        "(SELECT word, CAST(sum(cnt) AS BIGINT) AS tf, count(*) AS df FROM pairs GROUP BY word)",
    ),
    "bow": (
        ("pairs", "vocab"),
        "SELECT doc_id, word_id, CAST(cnt AS DOUBLE) AS cnt FROM pairs JOIN vocab USING (word)",
    ),
    "sizes": (
        ("bow",),
        "SELECT (SELECT count(*) FROM vocab) AS v, count(DISTINCT doc_id) AS d FROM bow",
    ),
    "lam": (("vocab",), f"SELECT word_id, {each(START)} FROM vocab"),
    "batch1": (
        ("bow",),
        f"SELECT * FROM (SELECT doc_id, {draws(1)} AS draws FROM "
        "(SELECT DISTINCT doc_id FROM bow)) WHERE draws > 0",
    ),
    "batch2": (
        ("bow",),
        f"SELECT * FROM (SELECT doc_id, {draws(2)} AS draws FROM "
        "(SELECT DISTINCT doc_id FROM bow)) WHERE draws > 0",
    ),
    "bow1": (
        ("bow", "batch1"),
        "SELECT doc_id, word_id, cnt * draws AS cnt FROM bow JOIN batch1 USING (doc_id)",
    ),
    "bow2": (
        ("bow", "batch2"),
        "SELECT doc_id, word_id, cnt * draws AS cnt FROM bow JOIN batch2 USING (doc_id)",
    ),
    "cells": (
        ("bow",),
        "SELECT doc_id, string_agg(CAST(word_id AS VARCHAR), ':' ORDER BY word_id) || ',' || "
        "string_agg(CAST(cnt AS VARCHAR), ':' ORDER BY word_id) AS doc FROM bow GROUP BY doc_id",
    ),
    "neighbours": (
        (),
        "SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y "
        "FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    ),
}


Shared = dict[str, tuple[tuple[str, ...], str]]


def _word_rows(tag: str, bow: str, lam: str) -> Shared:
    """``<tag>_sums``, ``<tag>_beta`` and ``<tag>_words``: the modelled words of documents."""
    log_sums = each(digamma("t#") + " AS d#")
    log_beta = each(digamma("l#") + " - d# AS lb#")
    return {
        f"{tag}_sums": ((lam,), f"SELECT {each('sum(l#) AS t#')} FROM {lam}"),
        f"{tag}_beta": (
            (lam, f"{tag}_sums"),
            f"SELECT word_id, {each('lb#')}, {each('exp(lb#) AS b#')} FROM (SELECT word_id, "
            f"{log_beta} FROM {lam} CROSS JOIN (SELECT {log_sums} FROM {tag}_sums))",
        ),
        f"{tag}_words": (
            (bow, f"{tag}_beta"),
            f"SELECT doc_id, word_id, cnt, {each('lb#')}, {each('b#')} "
            f"FROM {bow} JOIN {tag}_beta USING (word_id)",
        ),
    }


_NORM = f"({each('b# * e#', ' + ')} + 1e-100)"


def _outcomes(tag: str, last: str) -> Shared:
    """``<tag>_docs``, ``<tag>_stats`` and ``<tag>_bound`` from documents ``g#, x#, e#``."""
    top = f"greatest({each('lb# + x#')})"
    a, total_alpha = number(S.ALPHA), number(S.ALPHA * S.TOPICS)
    return {
        f"{tag}_docs": ((last,), f"SELECT * FROM {last}"),
        f"{tag}_stats": (
            (f"{tag}_words", last),
            f"SELECT word_id, {each('sum(e# * r * b#) AS s#')} FROM "
            f"(SELECT *, cnt / {_NORM} AS r FROM {tag}_words JOIN {last} USING (doc_id)) "
            "GROUP BY word_id",
        ),
        f"{tag}_bound": (
            (f"{tag}_words", last),
            f"SELECT doc_id, tokens, word_part + {each(f'({a} - g#) * x#', ' + ')} + "
            f"{each(f'lgamma(g#) - lgamma({a})', ' + ')} + lgamma({total_alpha}) - "
            f"lgamma({each('g#', ' + ')}) AS bound FROM {last} JOIN (SELECT doc_id, "
            f"sum(cnt) AS tokens, sum(cnt * (m + ln({each('exp(lb# + x# - m)', ' + ')}))) AS word_part "
            f"FROM (SELECT *, {top} AS m FROM {tag}_words JOIN {last} USING (doc_id)) "
            "GROUP BY doc_id) USING (doc_id)",
        ),
    }


def _expected(source: str, more: str = "") -> str:
    """``g#`` with E[log theta] ``x#`` and its exponential ``e#``."""
    return (
        f"SELECT doc_id, {each('g#')}, {each(f'{digamma("g#")} - ds AS x#')}, "
        f"{each(f'exp({digamma("g#")} - ds) AS e#')}{more} FROM (SELECT *, {digamma('gs')} AS ds "
        f"FROM (SELECT *, {each('g#', ' + ')} AS gs FROM ({source})))"
    )


def _e_step(tag: str, bow: str, lam: str) -> Shared:
    """Expressions ``<tag>_...`` for an E-step of INNER_STEPS steps from gamma = 1."""
    out = _word_rows(tag, bow, lam)
    ones = f"SELECT DISTINCT doc_id, {each('1e0 AS g#')} FROM {tag}_words"
    out[f"{tag}_0"] = ((f"{tag}_words",), _expected(ones))
    for i in range(S.INNER_STEPS):
        out[f"{tag}_{i + 1}"] = (
            (f"{tag}_words", f"{tag}_{i}"),
            _expected(
                f"SELECT doc_id, {each(f'any_value(e#) * sum(r * b#) + {number(S.ALPHA)} AS g#')} "
                f"FROM (SELECT *, cnt / {_NORM} AS r FROM {tag}_words JOIN {tag}_{i} USING (doc_id)) "
                "GROUP BY doc_id"
            ),
        )
    return out | _outcomes(tag, f"{tag}_{S.INNER_STEPS}")


def _settled(
    tag: str, bow: str, lam: str, iteration: int | None, most: int = 10**9
) -> Shared:
    """The same until every document has settled, or for ``most`` steps.

    Gamma starts at 1, or at the random values of an iteration. A row of the recursion is a
    document after a step; settled ones are not joined again.
    """
    out = _word_rows(tag, bow, lam)
    docs = f"(SELECT DISTINCT doc_id FROM {tag}_words)"
    if iteration is None:
        start = f"SELECT doc_id, {each('1e0 AS g#')} FROM {docs}"
    else:
        start = gamma_rows("doc_id", docs, "g", iteration)
    moved = f"({each('abs(g# - o#)', ' + ')}) / {number(S.TOPICS)}"
    step = (
        f"SELECT doc_id, any_value(steps) + 1 AS steps, {each('any_value(g#) AS o#')}, "
        f"{each(f'any_value(e#) * sum(r * b#) + {number(S.ALPHA)} AS g#')} FROM "
        f"(SELECT *, cnt / {_NORM} AS r FROM {tag}_words JOIN {tag}_run USING (doc_id) "
        f"WHERE moved >= {number(S.THRESHOLD)} AND steps < {most}) GROUP BY doc_id"
    )
    out[f"{tag}_run"] = (
        (f"{tag}_words",),
        f"RECURSIVE {_expected(start, ', 0 AS steps, 1e300 AS moved')} UNION ALL "
        f"{_expected(step, f', steps, {moved} AS moved')}",
    )
    out[f"{tag}_last"] = (
        (f"{tag}_run",),
        f"SELECT * FROM {tag}_run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY steps DESC) = 1",
    )
    return out | _outcomes(tag, f"{tag}_last")


def _m_step(
    name: str,
    tag: str,
    lam: str,
    iteration: int,
    batch_docs: str,
    sizes: str = "sizes",
    decay: float = S.DECAY,
) -> Shared:
    """The updated table; ``batch_docs`` is a subquery."""
    rho = number((decay + iteration) ** (-S.LEARNING_RATE))
    factor = f"(SELECT d / CAST({batch_docs} AS DOUBLE) FROM {sizes})"
    value = (
        f"(1e0 - {rho}) * l# + {rho} * ({number(S.ETA)} + {factor} * coalesce(s#, 0e0)) AS l#"
    )
    return {
        name: (
            (lam, f"{tag}_stats", sizes),
            f"SELECT word_id, {each(value)} FROM {lam} LEFT JOIN {tag}_stats USING (word_id)",
        )
    }


SHARED |= {
    "run_sizes": (
        ("training", "vocab"),
        "SELECT (SELECT count(*) FROM vocab) AS v, count(DISTINCT doc_id) AS d FROM training",
    ),
    "heldout_ids": (
        ("bow",),
        "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5("
        f"'{S.SEED}:0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT), doc_id) AS place FROM "
        f"(SELECT DISTINCT doc_id FROM bow)) WHERE place <= {S.HELDOUT_DOCS}",
    ),
    "training": (
        ("bow", "heldout_ids"),
        "SELECT * FROM bow WHERE doc_id NOT IN (SELECT doc_id FROM heldout_ids)",
    ),
    "heldout": (
        ("bow", "heldout_ids"),
        "SELECT * FROM bow WHERE doc_id IN (SELECT doc_id FROM heldout_ids)",
    ),
}
SHARED |= _e_step("full", "bow", "lam")
SHARED |= _settled("conv", "bow", "lam", None)
SHARED |= _settled("score", "bow", "lam", 0)
SHARED |= _m_step("lam_full", "full", "lam", 1, "d")
SHARED |= _e_step("it1", "bow1", "lam")
SHARED |= _m_step("lam1", "it1", "lam", 1, "(SELECT sum(draws) FROM batch1)")
SHARED |= _e_step("it2", "bow2", "lam1")
SHARED |= _m_step("lam2", "it2", "lam1", 2, "(SELECT sum(draws) FROM batch2)")


def _sparse(docs: str, kept: str, rows: str) -> Shared:
    """Topics with a share of at least 1/T, rescaled: one row per document, and one per topic."""
    share = f"CASE WHEN g# / gs >= {number(1 / S.TOPICS)} THEN g# / gs END AS p#"
    return {
        kept: (
            (docs,),
            f"SELECT doc_id, {each('p# / ps AS p#')} FROM (SELECT *, "
            f"{each('coalesce(p#, 0e0)', ' + ')} AS ps FROM (SELECT doc_id, {each(share)} "
            f"FROM (SELECT *, {each('g#', ' + ')} AS gs FROM {docs})))",
        ),
        rows: (
            (kept,),
            " UNION ALL ".join(
                f"SELECT doc_id, {k} AS topic, p{k} AS prob FROM {kept} WHERE p{k} IS NOT NULL"
                for k in K
            ),
        ),
    }


def _training_run() -> Shared:
    """Two iterations of the usual settings on the training documents, each with its held-out bound."""
    out: Shared = {
        "run0": (("vocab",), gamma_rows("word_id", "vocab", "l", 2**32)),
    }
    for i in range(1, S.TRAIN_ITERATIONS + 1):
        out[f"rdraws{i}"] = (
            ("training",),
            f"SELECT * FROM (SELECT doc_id, {draws(i)} AS draws FROM "
            "(SELECT DISTINCT doc_id FROM training)) WHERE draws > 0",
        )
        out[f"rbow{i}"] = (
            ("training", f"rdraws{i}"),
            f"SELECT doc_id, word_id, cnt * draws AS cnt FROM training JOIN rdraws{i} USING (doc_id)",
        )
        out |= _settled(f"r{i}", f"rbow{i}", f"run{i - 1}", i, S.MOST_STEPS)
        docs = f"(SELECT sum(draws) FROM rdraws{i})"
        out |= _m_step(f"run{i}", f"r{i}", f"run{i - 1}", i, docs, "run_sizes", S.FAST_DECAY)
        out |= _settled(f"h{i}", "heldout", f"run{i}", i, S.MOST_STEPS)
    return out


SHARED |= _training_run()
# Scoring with the model of that run, after its last iteration.
SHARED |= _settled("app", "bow", f"run{S.TRAIN_ITERATIONS}", S.TRAIN_ITERATIONS)
SHARED |= _sparse("full_docs", "kept", "topic_rows") | _sparse("score_docs", "score_kept", "score_rows")
SHARED |= _sparse("app_docs", "app_kept", "app_rows")
SHARED |= {
    name: (
        (kept, lam, sums, "sizes"),
        "SELECT doc_id, word_id, p / sum(p) OVER (PARTITION BY doc_id) AS p FROM "
        f"(SELECT doc_id, word_id, {each('coalesce(p#, 0e0) * l# / t#', ' + ')} AS p "
        f"FROM {kept} CROSS JOIN {lam} CROSS JOIN {sums}) WHERE p >= 1e0 / (SELECT v FROM sizes)",
    )
    for name, kept, lam, sums in (
        ("word_probs", "kept", "lam", "full_sums"),
        ("app_word_probs", "app_kept", f"run{S.TRAIN_ITERATIONS}", "app_sums"),
    )
}


def _alpha_step(docs: str, weight: str) -> str:
    """One Newton step of the prior, one row per topic."""
    a, n = number(S.ALPHA), "n"
    sum_a = number(S.ALPHA * S.TOPICS)
    rows = " UNION ALL ".join(f"SELECT {k} AS topic, avg(x{k}) AS m, count(*) AS n FROM {docs}" for k in K)
    return (
        "SELECT topic, round(CASE WHEN min(new) OVER () > 0 THEN new ELSE old END, 6) AS alpha FROM ("
        f"SELECT topic, {a} AS old, {a} - {weight} * (g - b) / q AS new FROM ("
        "SELECT topic, g, q, sum(g / q) OVER () / (1e0 / z + sum(1e0 / q) OVER ()) AS b FROM ("
        f"SELECT topic, {n} * (m - ({digamma(a)} - {digamma(sum_a)})) AS g, "
        f"-{n} * {trigamma(a)} AS q, {n} * {trigamma(sum_a)} AS z FROM ({rows}))))"
    )


def _rounded(name: str, digits: int) -> str:
    return each(f"round({name}#, {digits}) AS {name}#")


def _needed(names: Iterable[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for before in SHARED[name][0]:
            visit(before)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def statement(names: Iterable[str], body: str) -> str:
    parts, keyword = [], "WITH"
    for n in _needed(names):
        text = SHARED[n][1]
        if text.startswith("RECURSIVE "):
            keyword = "WITH RECURSIVE"
            parts.append(f"{n} AS ({text.removeprefix('RECURSIVE ')})")
        else:
            parts.append(f"{n} AS MATERIALIZED ({text})")
    return f"{keyword} {', '.join(parts)} {body}" if parts else body


_POSITIONS = (
    "(SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM tok)"
)
_DOC_COLUMNS = f"doc_id, {_rounded('g', 5)}"
_ESTEP = (
    f"SELECT doc_id, {_rounded('g', 5)}, round(bound, 3) AS bound, tokens, "
    f"CAST({S.INNER_STEPS} AS INTEGER) AS steps FROM full_docs JOIN full_bound USING (doc_id)"
)
_CONVERGED = (
    f"SELECT doc_id, {_rounded('g', 5)}, round(bound, 3) AS bound, tokens, "
    "CAST(steps AS INTEGER) AS steps FROM conv_docs JOIN conv_bound USING (doc_id)"
)
_TOPICS = "SELECT doc_id, topic, round(prob, 5) AS prob FROM topic_rows"
_MSTEP = f"SELECT word_id, {_rounded('l', 5)} FROM lam_full"
_TRAINED = f"SELECT word_id, {_rounded('l', 4)} FROM lam2"
_DIGEST = (
    "SELECT doc_id, count(*) AS n_words, min(word_id) AS lowest, max(word_id) AS highest, "
    "round(max(p), 9) AS top_prob, round(sum(p * (word_id % 1000)), 4) AS weighted "
    "FROM word_probs GROUP BY doc_id"
)
# Words that one of a document's topics gives a share of 1 / (V mass).
_VISITS = (
    "SELECT doc_id, CAST(sum(CAST(p >= 1e0 / v AS INTEGER)) AS BIGINT) AS kept, "
    "CAST(sum(CAST(share * (1e0 + 1e-9) >= 1e0 / (v * mass) AS INTEGER)) AS BIGINT) AS visited FROM "
    f"(SELECT doc_id, v, {each('coalesce(p#, 0e0) * l# / t#', ' + ')} AS p, "
    f"greatest({each('CASE WHEN p# > 0 THEN l# / t# END')}) AS share, "
    f"{each('coalesce(p#, 0e0)', ' + ')} AS mass, {each('CAST(p# IS NOT NULL AS INTEGER)', ' + ')} AS n "
    f"FROM kept CROSS JOIN lam CROSS JOIN full_sums CROSS JOIN sizes) WHERE n <= {S.SEARCH_TOPICS} "
    "GROUP BY doc_id"
)
_DAMAGE = (
    "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN replace(doc, ',', '') WHEN 1 THEN 'x' || doc "
    "WHEN 2 THEN split_part(doc, ',', 1) || ',' WHEN 3 THEN replace(doc, ',', ',NaN:') "
    "WHEN 4 THEN replace(doc, ',', ',-4:') WHEN 5 THEN doc || ':::' "
    "ELSE doc || ':9.5' END AS doc FROM cells"
)
_PIECES = (
    "SELECT doc_id, len(parts) AS n, "
    "list_transform(string_split(rtrim(parts[1], ':'), ':'), lambda x: TRY_CAST(x AS BIGINT)) AS ids, "
    "list_transform(string_split(rtrim(parts[2], ':'), ':'), lambda x: TRY_CAST(x AS DOUBLE)) AS cts "
    f"FROM (SELECT doc_id, string_split(rtrim(doc, ','), ',') AS parts FROM ({_DAMAGE}))"
)
_LAMBDA_SUMS = each(digamma("t#") + " AS d#")
_EXPECTED = (
    f"SELECT word_id, {each('round(' + digamma('l#') + ' - d#, 7) AS e#')}, "
    f"{each('round(' + digamma('l#') + ' - ' + digamma('ls') + ', 7) AS own#')} FROM "
    f"(SELECT *, {each('l#', ' + ')} AS ls FROM lam) CROSS JOIN "
    f"(SELECT {_LAMBDA_SUMS} FROM full_sums)"
)
_ETA = number(S.ETA)


def _topic_bound(lam: str, tag: str) -> str:
    return (
        f"SELECT part1, part2, {each(f'lgamma({_ETA} * v) - lgamma(t#)', ' + ')} AS part3 FROM "
        f"(SELECT {each(f'sum(({_ETA} - l#) * lb#)', ' + ')} AS part1, "
        f"{each(f'sum(lgamma(l#) - lgamma({_ETA}))', ' + ')} AS part2 "
        f"FROM {lam} JOIN {tag}_beta USING (word_id)) CROSS JOIN {tag}_sums CROSS JOIN sizes"
    )


_TOPIC_BOUND = _topic_bound("lam", "full")

_U = (
    f"CAST('0x' || substr(md5('{S.SEED}:0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT)"
)
_BATCHES = (
    f"SELECT doc_id, (row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1) // {S.BATCH_SIZE} "
    "AS batch FROM (SELECT DISTINCT doc_id FROM bow)"
)



def _metrics() -> str:
    rows = []
    for i in range(1, S.TRAIN_ITERATIONS + 1):
        rows += [
            f"SELECT {i} AS iter, 'batch_docs' AS metric, CAST(sum(draws) AS DOUBLE) AS value FROM rdraws{i}",
            f"SELECT {i}, 'batch_words', CAST(count(DISTINCT word_id) AS DOUBLE) FROM rbow{i}",
            f"SELECT {i}, 'peak_median', median(m) FROM ("
            + " UNION ALL ".join(f"SELECT max(l{k}) AS m FROM run{i}" for k in K)
            + ")",
            f"SELECT {i}, 'log_perplexity', -(bound + part1 + part2 + part3) / tokens FROM (SELECT "
            f"sum(bound) AS bound, sum(tokens) AS tokens FROM h{i}_bound) CROSS JOIN "
            f"({_topic_bound(f'run{i}', f'h{i}')})",
        ]
    return (
        "SELECT CAST(iter AS INTEGER) AS iter, metric, round(value, 4) AS value FROM ("
        + " UNION ALL ".join(rows)
        + ")"
    )


def _metric_names() -> list[str]:
    last = range(1, S.TRAIN_ITERATIONS + 1)
    names = ("rdraws", "rbow", "run")
    return [f"{n}{i}" for i in last for n in names] + [
        f"h{i}_{n}" for i in last for n in ("bound", "beta", "sums")
    ] + ["sizes"]


ORACLE: dict[str, Callable[[], str]] = {
    "tokenize_bow": lambda: statement(["pairs"], "SELECT doc_id, word, cnt FROM pairs"),
    "vocab_tf_rank": lambda: statement(["vocab"], "SELECT word, word_id, tf, df FROM vocab"),
    "vocab_first_seen": lambda: statement(
        ["tok"],
        "SELECT word, row_number() OVER (ORDER BY spot.doc_id, spot.pos) - 1 AS vocab_id FROM "
        f"(SELECT word, min({{'doc_id': doc_id, 'pos': pos}}) AS spot FROM {_POSITIONS} GROUP BY word)",
    ),
    "word_first_seen": lambda: statement(
        ["bow"],
        "SELECT word_id, row_number() OVER (ORDER BY spot.doc_id, spot.pos) - 1 AS dense_id FROM "
        "(SELECT word_id, min({'doc_id': doc_id, 'pos': pos}) AS spot FROM (SELECT doc_id, word_id, "
        "row_number() OVER (PARTITION BY doc_id ORDER BY word_id) AS pos FROM bow) GROUP BY word_id)",
    ),
    "bow_cell_encode": lambda: statement(["cells"], "SELECT doc_id, doc FROM cells"),
    "bow_cell_decode": lambda: statement(["bow"], "SELECT doc_id, word_id, cnt FROM bow"),
    "bow_noid": lambda: statement(
        ["bow"],
        "SELECT n_words, tokens, lowest, highest FROM (SELECT doc_id, count(*) AS n_words, "
        "sum(cnt) AS tokens, min(word_id) AS lowest, max(word_id) AS highest FROM bow GROUP BY doc_id)",
    ),
    "corrupt_cells": lambda: statement(
        ["cells"],
        "SELECT doc_id, corrupt, CASE WHEN NOT corrupt THEN k END AS n_words, "
        "CASE WHEN NOT corrupt THEN list_sum(cts[1:k]) END AS tokens FROM (SELECT *, "
        "least(len(ids), len(cts)) AS k, n < 2 OR list_contains(list_transform(ids, "
        "lambda x: x IS NULL), true) OR list_contains(list_transform(cts, lambda x: x IS NULL), "
        "true) OR list_min(ids[1:k]) < 0 OR len(list_filter(cts[1:k], "
        f"lambda x: NOT isfinite(x) OR x < 0)) > 0 AS corrupt FROM ({_PIECES}))",
    ),
    "doc_batches": lambda: statement(["bow"], _BATCHES),
    "doc_topic_batches": lambda: statement(["full_docs"], f"SELECT {_DOC_COLUMNS} FROM full_docs"),
    "heldout_draw": lambda: statement(
        ["bow"],
        f"SELECT doc_id, n_words FROM (SELECT doc_id, n_words, row_number() OVER (ORDER BY {_U}, "
        "doc_id) AS place FROM (SELECT doc_id, count(*) AS n_words FROM bow GROUP BY doc_id)) "
        f"WHERE place <= {S.HELDOUT_DOCS}",
    ),
    "heldout_split": lambda: statement(
        ["bow", "heldout_ids"],
        "SELECT doc_id, count(*) AS n_words, doc_id IN (SELECT doc_id FROM heldout_ids) AS heldout "
        "FROM bow GROUP BY doc_id",
    ),
    "explode_docs": lambda: statement(["bow"], "SELECT doc_id, word_id, cnt FROM bow"),
    "tf_filter_tokens": lambda: statement(
        ["bow"], f"SELECT sum(cnt) AS tokens FROM bow WHERE word_id >= {S.LOWEST_WORD}"
    ),
    "minibatch_sample": lambda: statement(["batch1"], "SELECT doc_id, draws FROM batch1"),
    "batch_size_merge": lambda: statement(
        ["batch1", "bow1"],
        "SELECT (SELECT count(*) FROM batch1) AS documents, "
        "(SELECT CAST(sum(draws) AS BIGINT) FROM batch1) AS batch_size, "
        "(SELECT sum(cnt) FROM bow1) AS tokens",
    ),
    "batch_word_count": lambda: statement(
        ["bow1"],
        "SELECT count(DISTINCT word_id) AS words, count(DISTINCT word_id) FILTER "
        f"(WHERE word_id >= {S.LOWEST_WORD}) AS modelled FROM bow1",
    ),
    "lambda_semi": lambda: statement(
        ["lam", "bow1"],
        f"SELECT word_id, {each('l#')} FROM lam WHERE word_id IN (SELECT word_id FROM bow1)",
    ),
    "lambda_init": lambda: statement(
        ["vocab"],
        f"SELECT word_id, {each('1e0 AS l#')} FROM vocab WHERE word_id >= {S.LOWEST_WORD}",
    ),
    "lambda_roundtrip": lambda: statement(["lam"], f"SELECT word_id, {each('l#')} FROM lam"),
    "lambda_colsum": lambda: statement(
        ["lam"],
        " UNION ALL ".join(f"SELECT {k} AS topic, sum(l{k}) AS value FROM lam" for k in K),
    ),
    "lambda_peak": lambda: statement(
        ["lam"],
        " UNION ALL ".join(f"SELECT {k} AS topic, max(l{k}) AS value FROM lam" for k in K),
    ),
    "lambda_peak_median": lambda: statement(
        ["lam"],
        "SELECT median(m) AS peak_median FROM ("
        + " UNION ALL ".join(f"SELECT max(l{k}) AS m FROM lam" for k in K)
        + ")",
    ),
    "lambda_rows": lambda: statement(["lam"], "SELECT count(*) AS num_words FROM lam"),
    "bow_join_lambda": lambda: statement(
        ["bow", "lam"],
        f"SELECT doc_id, word_id, cnt, {each('l#')} FROM bow JOIN lam USING (word_id)",
    ),
    "doc_word_rows": lambda: statement(
        ["bow"],
        "SELECT doc_id, count(*) AS n_words, string_agg(CAST(word_id AS VARCHAR), ':' "
        "ORDER BY word_id) AS words FROM bow GROUP BY doc_id",
    ),
    "dirichlet_expectation": lambda: statement(["lam", "full_sums"], _EXPECTED),
    "vector_sum_by_key": lambda: (
        "SELECT CAST(label AS BIGINT) AS label, pos, round(sum(v), 6) AS total FROM (SELECT label, "
        "CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) "
        "AS pos FROM embeddings) GROUP BY label, pos"
    ),
    "vector_sum": lambda: statement(
        ["neighbours"],
        "SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) + unnest(y) "
        "AS value FROM neighbours WHERE y IS NOT NULL",
    ),
    "vector_product": lambda: statement(
        ["neighbours"],
        "SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, "
        "unnest(x) * coalesce(unnest(y), 1e0) AS value FROM neighbours",
    ),
    "vector_distance": lambda: statement(
        ["neighbours"],
        "SELECT vec_id, round(list_distance(x, y), 6) AS distance FROM neighbours WHERE y IS NOT NULL",
    ),
    "logsumexp": lambda: (
        "SELECT vec_id, round(m + ln(list_sum(list_transform(x, lambda v: exp(v - m)))), 6) AS lse "
        "FROM (SELECT vec_id, x, list_max(x) AS m FROM "
        "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"
    ),
    "learning_rate": lambda: statement(
        ["bow"],
        f"SELECT batch, count(*) AS documents, round(pow({number(S.DECAY)} + batch + 1, "
        f"{number(-S.LEARNING_RATE)}), 9) AS rho FROM ({_BATCHES}) GROUP BY batch",
    ),
    "estep_fixed": lambda: statement(["full_docs", "full_bound"], _ESTEP),
    "estep_converged": lambda: statement(["conv_docs", "conv_bound"], _CONVERGED),
    "gamma_draws": lambda: statement(
        ["bow"],
        f"SELECT doc_id, {_rounded('g', 9)} FROM "
        f"({gamma_rows('doc_id', '(SELECT DISTINCT doc_id FROM bow)', 'g', 1)})",
    ),
    "lambda_init_gamma": lambda: statement(
        ["run0"], f"SELECT word_id, {_rounded('l', 9)} FROM run0"
    ),
    "estep_blocks": lambda: statement(["full_docs", "full_bound"], _ESTEP),
    "estep_stats": lambda: statement(
        ["full_stats"], f"SELECT word_id, {_rounded('s', 5)} FROM full_stats"
    ),
    "mstep_update": lambda: statement(["lam_full"], _MSTEP),
    "mstep_rewrite": lambda: statement(["lam_full"], _MSTEP),
    "alpha_update": lambda: statement(
        ["full_docs"], _alpha_step("full_docs", number(S.ALPHA_WEIGHT))
    ),
    "bound_topic_lgamma": lambda: statement(
        ["lam", "full_beta", "full_sums", "sizes"],
        "SELECT round(part1, 3) AS part1, round(part2, 3) AS part2, round(part3, 3) AS part3 "
        f"FROM ({_TOPIC_BOUND})",
    ),
    "perplexity": lambda: statement(
        ["lam", "full_beta", "full_sums", "sizes", "full_bound"],
        "SELECT round(bound, 2) AS corpus_bound, tokens, raw_tokens, "
        "round(-(bound + part1 + part2 + part3) / tokens, 6) AS log_perplexity FROM "
        "(SELECT sum(bound) AS bound, sum(tokens) AS tokens FROM full_bound) CROSS JOIN "
        f"(SELECT sum(cnt) AS raw_tokens FROM bow WHERE word_id >= {S.LOWEST_WORD}) "
        f"CROSS JOIN ({_TOPIC_BOUND})",
    ),
    "train_online": lambda: statement(["lam2"], _TRAINED),
    "train_resume": lambda: statement(["lam2"], _TRAINED),
    "train_resume_finished": lambda: statement(["lam2"], _TRAINED),
    "train_metrics": lambda: statement(_metric_names(), _metrics()),
    "train_alpha": lambda: statement(
        ["it1_docs"],
        _alpha_step("it1_docs", number((S.DECAY + 1) ** (-S.LEARNING_RATE))),
    ),
    "model_roundtrip": lambda: statement(
        ["lam", "full_sums", "sizes"],
        f"SELECT word_id, {each('l#')}, {number(S.ALPHA)} AS alpha, {_ETA} AS eta, "
        "v AS num_words, t0 AS sum0 FROM lam CROSS JOIN full_sums CROSS JOIN sizes",
    ),
    "topic_normalize_sparsify": lambda: statement(["topic_rows"], _TOPICS),
    "doc_topic_cell": lambda: statement(["topic_rows"], _TOPICS),
    "doc_topic_scores": lambda: statement(
        ["score_rows"], "SELECT doc_id, topic, round(prob, 4) AS prob FROM score_rows"
    ),
    "app_topics": lambda: statement(
        ["app_rows"], "SELECT doc_id, topic, round(prob, 4) AS prob FROM app_rows"
    ),
    "app_words": lambda: statement(
        ["app_word_probs"], _DIGEST.replace("FROM word_probs", "FROM app_word_probs")
    ),
    "doc_topic_stream": lambda: statement(["topic_rows"], _TOPICS),
    "doc_word_dist": lambda: statement(["word_probs"], _DIGEST),
    "doc_word_chunks": lambda: statement(["word_probs"], _DIGEST),
    "doc_word_search": lambda: statement(["word_probs"], _DIGEST),
    "doc_word_visits": lambda: statement(["kept", "lam", "full_sums", "sizes"], _VISITS),
    "doc_topic_public": lambda: statement(["topic_rows"], _TOPICS),
    "doc_word_cell": lambda: statement(["word_probs"], _DIGEST),
}
