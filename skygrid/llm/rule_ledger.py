"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once; the ledger keeps the measurements and one bit for each rule that failed.
A policy is a versioned mask of rules: applying it, or asking what would change without a rule, reads the
bits and never the texts.  All measures are linear (or n log n) in the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def without_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(same(F.get(s, k + 1), x), F.lit(False)) | ((k > 0) & F.coalesce(same(F.get(s, F.greatest(k - 1, F.lit(0))), x), F.lit(False))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last"))
            return F.aggregate(p, start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(by_hash, places), total)).otherwise(F.lit(0))

    return F.when(F.size(words) > WINDOW, let(hashes, covered)).otherwise(F.lit(0))


def measure(docs: DataFrame, text_name: str = "text") -> DataFrame:
    """The input's rows with a struct ``measured``; a null text has no words and measures zero."""
    text = F.coalesce(F.col(f"`{text_name}`").cast("string"), F.lit(""))

    def all_of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(without_chars(text, BLANK_CHARS)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without_chars(text, SYMBOLS))).cast("long").alias("n_symbols"),
            duplicate_lines(text).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        )

    return docs.withColumn("measured", let(words_of(text), all_of))


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` is set where ``failed`` holds for the measurements."""

    bit: int
    name: str
    failed: object  # (measured column) -> Column


#: Bits are never reused: a changed rule takes a new bit, so that old ledgers keep their meaning.
RULES = [
    Rule(0, "few_words", lambda m: m["n_words"] < 10),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule(2, "symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule(4, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(5, "long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule(6, "many_words", lambda m: m["n_words"] > 1_000_000),
]

#: Policy versions: the rules whose failure rejects a document.
POLICIES = {"base": (0, 1), "v1": (0, 1, 2, 3, 4, 5)}


def mask_of(policy: str | tuple[int, ...]) -> int:
    return sum(1 << k for k in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, rules: list[Rule] = RULES, text_name: str = "text") -> DataFrame:
    """The input's rows with ``measured`` and ``fail_bits``."""
    bits = None
    for r in rules:
        bit = F.when(r.failed(F.col("measured")), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text_name).withColumn("fail_bits", bits)


def kept(policy: str | tuple[int, ...], bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str | tuple[int, ...], by: list[str] | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only this rule rejects.

    One pass over the ledger: bitwise sums are pre-aggregated before the one small shuffle by ``by`` and bits.
    """
    mask = mask_of(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    seen = entries.groupBy(*(by or []), bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cells = [
        F.struct(F.lit(r.name).alias("rule"), F.col("bits").bitwiseAND(F.lit(1 << r.bit).cast("long")).cast("boolean").alias("fails"), (F.col("bits") == (1 << r.bit)).alias("alone"))
        for r in rules if mask >> r.bit & 1
    ]
    long = seen.select(*(by or []), "n", F.inline(F.array(*cells)))
    total = lambda k: F.sum(F.when(F.col(k), F.col("n")).otherwise(0))
    return long.groupBy(*(by or []), "rule").agg(total("fails").alias("n_failed"), total("alone").alias("n_only"))


def judge(docs: DataFrame, policy: str = "v1", id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """doc_id, the measurements, base_failed, kept and fail_bits of every document.

    Rows are independent: null ids, repeated rows and further columns change nothing.
    """
    own = docs.select(F.col(f"`{id_name}`").cast("long").alias("doc_id"), F.col(f"`{text_name}`").cast("string").alias("text"))
    out = ledger(own)
    m = F.col("measured")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[m[k].alias(k) for k in names], (~kept("base")).alias("base_failed"), (kept("base") & kept(policy)).alias("kept"), "fail_bits")
