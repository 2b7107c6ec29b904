"""Quality rules with risk-controlled thresholds.

Every rule compares an exact ratio of a document's counts with a cutoff.  The
cutoffs of each stratum are chosen on labelled documents that fit nothing else:
from the loosest cutoff on, a stricter one is taken as long as the exact
binomial (Clopper-Pearson) upper bound of its false rejections of good
documents stays under the rule's share of the allowed rate.  Walking in a fixed
order needs no correction along a rule's cutoffs (fixed-sequence testing);
across rules and strata the confidence is divided (Bonferroni).  So, with the
chosen confidence, no stratum loses more than the allowed part of its good documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import encode_words, map_texts, split_words, sum_by_row

#: Symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Rules as numerator, denominator and the candidate cutoffs of their ratio, loosest first.
CUTOFFS = tuple(x / 100 for x in (60, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1))
RULES = {
    "symbols": ("n_symbols", "word_chars", CUTOFFS),
    "duplicate_lines": ("n_dup_lines", "n_lines", CUTOFFS),
    "repeated_words": ("n_repeat_words", "n_words", CUTOFFS),
    "upper_case": ("n_upper_words", "n_words", CUTOFFS),
}
#: Largest part of a stratum's good documents that all rules together may reject, and the chance of failing in that.
ALLOWED, DELTA = 0.02, 0.05

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    r"""Columns ``keep`` and the counts of each whole text, exact.

    Words are ``[^\x20\x09-\x0D]+``.  ``word_chars``: code points in words;
    ``n_symbols``: characters of ``#*$%&|<>``; ``n_lines``: ``\n``-split lines with
    a word; ``n_dup_lines``: those equal to an earlier line; ``n_repeat_words``:
    words in 3-word windows found twice or more in the text, the first
    included; ``n_upper_words``: words of two characters or more with a letter
    and no lower-case letter.  Null and empty texts have zero counts; repeated
    rows are measured each.
    """
    def apply(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        words, rows = split_words(texts)
        distinct, codes = encode_words(words)
        chars = pc.utf8_length(distinct).to_numpy().astype(np.int64)
        upper = pc.and_(pc.and_(pc.match_substring_regex(distinct, r"\p{L}"),
                                pc.equal(pc.utf8_upper(distinct), distinct)), pc.greater(pc.utf8_length(distinct), 1))
        marks = pc.count_substring_regex(distinct, f"[{SYMBOLS}]").to_numpy().astype(np.int64)
        lines = pc.split_pattern(texts, "\n")
        line_rows = pc.list_parent_indices(lines).to_numpy()
        line_words, line_codes = encode_words(lines.flatten())
        has_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line_words)), 0).to_numpy(zero_copy_only=False)
        full = has_word[line_codes]
        line_rows, line_codes = line_rows[full], line_codes[full]
        counts = [
            np.bincount(rows, minlength=n), sum_by_row(chars[codes], rows, n), sum_by_row(marks[codes], rows, n),
            sum_by_row(~_first_of_row(line_codes.astype(np.int64), line_rows), line_rows, n),
            sum_by_row(_repeated(codes.astype(np.int64), rows, len(distinct)), rows, n),
            np.bincount(line_rows, minlength=n),
            sum_by_row(upper.to_numpy(zero_copy_only=False)[codes], rows, n)]
        return [pa.array(c.astype(np.int64)) for c in counts]

    return map_texts(df, text, lambda: apply, [T.StructField(c, T.LongType()) for c in COUNTS], keep)


def _first_of_row(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each code is the first of its kind in its row."""
    order = np.argsort(codes, kind="stable")
    c, r = codes[order], rows[order]
    first = np.ones(len(codes), bool)
    first[order[1:]] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    return first


def _repeated(codes: np.ndarray, rows: np.ndarray, n_codes: int) -> np.ndarray:
    """Whether each word lies in a 3-word window that its row holds twice or more."""
    out = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return out
    start = np.flatnonzero(rows[2:] == rows[:-2])
    if n_codes < 1 << 20:
        window = (codes[start] * n_codes + codes[start + 1]) * n_codes + codes[start + 2]
    else:
        pairs = np.unique(codes[start] * n_codes + codes[start + 1], return_inverse=True)[1]
        window = pairs * n_codes + codes[start + 2]
    order = np.argsort(window, kind="stable")
    w, r = window[order], rows[start[order]]
    same = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(start), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    at = start[twice]
    for i in range(3):
        out[at + i] = True
    return out


def base_failed() -> Column:
    """Under 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed in logarithms."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
             for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def passes(rejected: int, good: int, allowed: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, of a false rejection rate is at most ``allowed``.

    The Clopper-Pearson bound is at most ``allowed`` where so few rejections
    would come by chance at most ``delta`` of the time at that rate.
    """
    if not good or rejected > good * allowed:
        return False
    return binomial_tail(rejected, good, allowed) <= delta


def choose_cutoffs(measured: DataFrame, stratum: str, good: Column, allowed: float = ALLOWED,
                   delta: float = DELTA, rules: dict = RULES) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule, from the labelled rows of ``measured``.

    ``good`` is true for rows that must not be rejected.  Only counts per
    stratum, rule and cutoff reach the driver.  Strata that are too small to
    prove any cutoff, even if it rejected none of their good documents, are
    tested together as one pool and share its cutoffs: the bound then holds for
    the pool's good documents, not for each of its strata.  Who is in the pool
    depends on numbers of good documents only, so it costs no confidence beyond
    one more stratum.  A pool that is still too small gets no cutoff.
    """
    counts = [F.count("*").alias("good")]
    for rule, (over, under, cutoffs) in rules.items():
        counts += [F.count(F.when(F.col(over) > c * F.col(under), 1)).alias(f"{rule}_{i}") for i, c in enumerate(cutoffs)]
    found = (measured.where(good).groupBy(F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"))
             .agg(*counts).collect())
    share, level = allowed / len(rules), delta / (len(rules) * (len(found) + 1))
    tested: dict[tuple[str, ...], dict[str, int]] = {}
    pool = [r for r in found if not passes(0, r["good"], share, level)]
    for row in found:
        if row not in pool:
            tested[(row["stratum"],)] = row.asDict()
    if pool:
        tested[tuple(r["stratum"] for r in pool)] = {c: sum(r[c] for r in pool) for c in pool[0].asDict() if c != "stratum"}
    chosen: dict[str, dict[str, float]] = {}
    for members, row in tested.items():
        for rule, (_, _, cutoffs) in rules.items():
            for i, c in enumerate(cutoffs):
                if not passes(row[f"{rule}_{i}"], row["good"], share, level):
                    break
                for member in members:
                    chosen.setdefault(member, {})[rule] = c
    return chosen


def judge(measured: DataFrame, stratum: str, cutoffs: dict[str, dict[str, float]], rules: dict = RULES) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept`` (false if the base or any rule of the stratum rejects)."""
    spark = measured.sparkSession
    schema = "__stratum string, " + ", ".join(f"__{r} double" for r in rules)
    chosen = spark.createDataFrame([(s, *[c.get(r) for r in rules]) for s, c in cutoffs.items()], schema)
    key = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
    rejected = F.lit(False)
    for rule, (over, under, _) in rules.items():
        rejected = rejected | F.coalesce(F.col(over) > F.col(f"__{rule}") * F.col(under), F.lit(False))
    joined = measured.join(F.broadcast(chosen) if len(cutoffs) <= 10_000 else chosen, key == chosen["__stratum"], "left")
    return (joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)
            .drop("__stratum", *[f"__{r}" for r in rules]))
