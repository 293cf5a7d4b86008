"""Quality rules: labelled holdouts and exact binomial tests choose cutoffs that reject few good documents in each stratum."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import drop, id_map, lean, map_bits, marked, saved, table

#: At most this share of good documents may fall to the rules of a stratum, but for a chance of DELTA over all strata.
ALPHA, DELTA = 0.01, 0.05
#: Cutoffs that each rule tries, and steps of a proposal; bad documents that a step must reject for each good one.
STEPS, PRICE = 24, 20
#: Values of a rule are counted in cells, so many to each doubling of the value; cutoffs are edges of cells.
CELLS = 128
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
_BLANKS, _INNER = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_distinct long, n_marks long"

#: name -> (measure, +1 if high values are bad or -1 if low ones are).
RULES: dict[str, tuple[str, int]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 1),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 1),
    "marks": ("n_marks / greatest(n_words, 1)", 1),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1),
    "repeated": ("n_repeat_words / greatest(n_words, 1)", 1),
    "variety": ("n_distinct / greatest(sqrt(n_words), 1)", -1),
    "long_words": ("word_chars / greatest(n_words, 1)", 1),
    "short_words": ("word_chars / greatest(n_words, 1)", -1),
}


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in a 3-word window that the text has twice or more; ids number the words exactly, so nothing collides."""
    if len(ids) < 4:
        return 0
    x = ids.astype(np.int64)
    if distinct < 1 << 21:
        key = ((x[:-2] << 21) | x[1:-1]) << 21 | x[2:]
    else:
        key = np.unique(x[:-2] * distinct + x[1:-1], return_inverse=True)[1] * distinct + x[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(x), bool)
    for k in range(3):
        covered[k : len(x) - 2 + k] |= twice
    return int(covered.sum())


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def measure(text: bytes) -> tuple[int, ...]:
    """The columns of STATS after doc_id."""
    words = text.split()
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    count = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    chars = len(text.translate(None, _BLANKS + _INNER))
    return len(words), chars, count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids, len(numbers)), len(lines), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(numbers), count(b"!?|")


def stats(docs: DataFrame, carry: bool = False) -> DataFrame:
    """STATS and lang for every row of docs, one pass over whole texts; carry: the row itself too, as the struct _row."""

    names = [*[x.split()[0] for x in STATS.split(", ")], "lang", *["_row"] * carry]

    @lean
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                own = b.slice(i, 128)
                texts = pc.struct_field(own.column(1), "text") if carry else own.column(1)
                rows = [measure((t or "").encode()) for t in texts.cast(pa.string()).to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch([own.column(0), *columns, own.column(2), *[own.column(1)] * carry], names=names)

    lang = F.coalesce(docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string"), F.lit("")).alias("lang")
    text = F.struct("*").alias("_row") if carry else docs["text"].cast("string").alias("text")
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text, lang)
    kinds = [T.StructField(x.split()[0], T.LongType()) for x in STATS.split(", ")]
    return given.mapInArrow(run, T.StructType([*kinds, given.schema["lang"], *[given.schema[1]] * carry]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def rejected(values: np.ndarray, rule: int, cutoff: float) -> np.ndarray:
    side = list(RULES.values())[rule][1]
    return side * values[:, rule] > side * cutoff


def _tails() -> np.ndarray:
    return np.geomspace(0.001, 0.5, STEPS)


def _gains(values: np.ndarray, good: np.ndarray, steps: list[tuple[int, float]], tries: list[tuple[int, float]]) -> np.ndarray:
    """For each of tries what it adds to steps: bad documents rejected less PRICE for every good one."""
    gone = _first_step(values, steps) < len(steps)
    weight = np.where(good, -PRICE, 1) * ~gone
    return np.array([weight[rejected(values, r, c)].sum() for r, c in tries], np.int64)


def _first_step(values: np.ndarray, steps: list[tuple[int, float]]) -> np.ndarray:
    """The number of the first step that rejects each document; len(steps): none does."""
    out = np.full(len(values), len(steps))
    for n in range(len(steps) - 1, -1, -1):
        out[rejected(values, *steps[n])] = n
    return out


def propose(values: np.ndarray, good: np.ndarray) -> list[tuple[int, float]]:
    """Rules with cutoffs, each step adding what rejects the most bad documents beyond PRICE for every good one."""
    sides = [side for _, side in RULES.values()]
    tries = [(r, side * c) for r, side in enumerate(sides) for c in np.unique(np.quantile(side * values[:, r], 1 - _tails()))] if len(values) else []
    out: list[tuple[int, float]] = []
    while len(out) < STEPS:
        gains = _gains(values, good, out, tries)
        if not len(gains) or gains.max() <= 0:
            break
        out.append(tries[int(np.argmax(gains))])
    return out


def certify(steps: list[tuple[int, float]], values: np.ndarray, good: np.ndarray, alpha: float, delta: float) -> list[tuple[int, float]]:
    """The longest run of steps that together reject at most alpha of good documents, proved with an error of at most delta.

    values: a half of the holdout that had no part in the proposal.
    """
    return _proved(steps, np.bincount(_first_step(values[good], steps), minlength=len(steps) + 1), alpha, delta)


def _proved(steps: list[tuple[int, float]], first: np.ndarray, alpha: float, delta: float) -> list[tuple[int, float]]:
    """certify() from how many good documents each step is the first to reject; the last count is of those that none does.

    The runs are nested, so testing them in turn and stopping at the first that fails needs no correction within a stratum (fixed
    sequence); each test is the exact binomial one.
    """
    for n, k in enumerate(np.cumsum(first)[: len(steps)].tolist()):
        if binomial_cdf(k, int(first.sum()), alpha) > delta:
            return steps[:n]
    return steps


def _added(rows: DataFrame, count) -> dict[str, np.ndarray]:
    """stratum -> the sums of count(stratum, values, good), an array or None, over the rows of the stratum; '' has all rows."""

    def run(batches):
        out: dict[str, np.ndarray] = {}
        for b in batches:
            lang, good = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False)
            values = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2, b.num_columns)])
            for stratum in {"", *lang.tolist()}:
                own = lang == stratum if stratum else np.ones(len(lang), bool)
                n = count(stratum, values[own], good[own])
                if n is not None:
                    out[stratum] = out.get(stratum, 0) + n
        yield pa.record_batch([pa.array(list(out), pa.string()), pa.array([n.tolist() for n in out.values()], pa.list_(pa.int64()))], names=["lang", "n"])

    each = rows.select("lang", "good", *[f"_{r}" for r in RULES]).mapInArrow(run, "lang string, n array<long>").select("lang", F.posexplode("n").alias("k", "n"))
    sums: dict[str, dict[int, int]] = {}
    for r in each.groupBy("lang", "k").agg(F.sum("n").alias("n")).collect():  # as many rows as strata have counts
        sums.setdefault(r["lang"], {})[r["k"]] = r["n"]
    return {stratum: np.array([n[k] for k in range(len(n))], np.int64) for stratum, n in sums.items()}


def _tries(rows: DataFrame) -> dict[str, list[tuple[int, float]]]:
    """stratum -> the cutoffs that rules try: edges of cells, beyond which stand the shares of _tails(), to a cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.when(F.col(f"_{r}") > 0, F.floor(F.log2(f"_{r}") * CELLS)).alias("cell")) for k, r in enumerate(RULES)])).alias("x")
    counts: dict[str, list[dict]] = {}
    for r in rows.select("lang", cells).groupBy("lang", "x.rule", "x.cell").agg(F.count("*").alias("n")).collect():  # counts: cells are few, whatever the rows
        for stratum in {"", r["lang"]}:
            own = counts.setdefault(stratum, [{} for _ in RULES])[r["rule"]]
            own[r["cell"]] = own.get(r["cell"], 0) + r["n"]
    out: dict[str, list[tuple[int, float]]] = {}
    for stratum, by_rule in counts.items():
        out[stratum] = []
        for k, (_, side) in enumerate(RULES.values()):
            order = sorted(by_rule[k], key=lambda c: side * (-math.inf if c is None else c))
            upto = np.cumsum([by_rule[k][c] for c in order])
            at = np.searchsorted(upto, (1 - _tails()) * upto[-1])
            edges = {0.0 if order[i] is None else 2.0 ** ((order[i] + (side > 0)) / CELLS) for i in at.tolist()}
            out[stratum] += [(k, c) for c in sorted(edges, key=lambda c, s=side: s * c)]
    return out


def fit(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[tuple[int, float]]]:
    """stratum -> its rules and cutoffs; the stratum '' holds all languages and is meant for those without labels."""
    measured = saved(stats(docs))
    out = fit_measured(measured, labels, alpha, delta)
    drop(measured)
    return out


def fit_measured(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[tuple[int, float]]]:
    """fit() from stats(docs). All labelled ids count, each once, as trials have to be independent; only counts by stratum, half, rule and
    cutoff come to the driver. delta is shared out over the strata (Bonferroni).
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.min("quality") == 1).alias("good"))
    half = (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("half")
    labelled = measured.where(~base_failed()).join(own, F.col("doc_id") == F.col("_id")).select("doc_id", "lang", "good", half, *[F.expr(f"double({e})").alias(f"_{r}") for r, (e, _) in RULES.items()])
    rows = saved(labelled.groupBy("doc_id").agg(F.min(F.struct("lang", "good", "half", *[f"_{r}" for r in RULES])).alias("x")).select("x.*"))
    proposing, certifying = rows.where("half"), rows.where("not half")
    strata = ["", *sorted({r["lang"] for r in rows.select("lang").distinct().collect()} - {""})]  # a row for each language
    tries, steps = _tries(proposing), {s: [] for s in strata}
    growing = set(tries)
    while growing:
        gains = _added(proposing, lambda s, values, good, on=frozenset(growing), had=steps: _gains(values, good, had[s], tries[s]) if s in on else None)
        for s in list(growing):
            if gains[s].max() <= 0:
                growing.remove(s)
                continue
            steps[s].append(tries[s][int(np.argmax(gains[s]))])
            if len(steps[s]) == STEPS:
                growing.remove(s)
    first = _added(certifying, lambda s, values, good: np.bincount(_first_step(values[good], steps[s]), minlength=len(steps[s]) + 1))
    drop(rows)
    return {s: _proved(steps[s], first.get(s, np.zeros(len(steps[s]) + 1, np.int64)), alpha, delta / len(strata)) for s in strata}


def keep(cutoffs: dict[str, list[tuple[int, float]]]) -> Column:
    """False where a rule of the row's stratum rejects it."""
    rules, named, verdict = list(RULES.values()), sorted(set(cutoffs) - {""}), F.lit(True)
    for stratum, steps in cutoffs.items():
        fails = F.lit(False)
        for rule, c in steps:
            e, side = rules[rule]
            fails = fails | (F.expr(f"double({e})") > c if side > 0 else F.expr(f"double({e})") < c)
        verdict = verdict & ~((F.col("lang") == stratum if stratum else ~F.col("lang").isin(named)) & fails)
    return verdict


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs(doc_id, text, lang).

    Null and empty texts have no words and fail; repeated rows and null ids keep their rows; a null or missing lang is a stratum without
    labels, for which the cutoffs of all languages together hold; without labels only the base rules decide. Further columns are ignored.
    """
    measured = saved(stats(docs))
    verdict = ~base_failed() & keep(fit_measured(measured, labels))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names. Only documents that may be labelled are measured twice."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("id"))
    labelled = id_map(ids, lambda b: b.column(0).to_numpy(), map_bits(ids.count()))
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c].cast("string").alias(c) for c in ("lang",) if c in docs.columns])
    return stats(docs, carry=True).where(~base_failed() & keep(fit(marked(given, labelled), labels))).select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9's result doesn't depend on the learned cutoffs."""
    return op9_quality_rules(spark, sf_dir).drop("kept")


QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_rules_base": base_columns}
ORACLE_SQL = {
    "quality_rules_base": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM r WHERE n > 1) GROUP BY doc_id),
x AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM x"""
}
