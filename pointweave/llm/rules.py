"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document's row in the ledger holds its measurements and one bit for each rule
that it fails. Policies are versioned masks over those bits: applying another one, or asking what a rule
contributes, reads the ledger and never the texts. All of it is built-in Spark functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pointweave.llm.common import SPACE
from pointweave.session import cut

_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3  # words

#: Rule by bit: name and the condition under which a document fails it, in whole numbers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(BIT))


def _without(text: str, characters: str) -> Column:
    return F.translate(F.col(text), characters, "")


def measure(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, measurements) of every row.

    A null text has no word and measures zero everywhere, like an empty one. Windows are compared as 64-bit hashes
    of their words within one text. Repeated rows stay, an empty table gives an empty one, texts of any length
    are measured whole, and columns other than the key and the text are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select(
        "key",
        F.array_remove(F.split("t", SPACE), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: F.translate(line, _BLANKS, "") != "").alias("lines"),
        F.length(_without("t", _BLANKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without("t", SYMBOLS))).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    rows = rows.select(
        "key", "word_chars", "n_symbols", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).alias("windows"))
    # Only texts in which a window occurs again are looked at further.
    rows = rows.withColumn("sorted", F.when(
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.drop("windows").withColumn("starts", F.sort_array(F.transform(
        F.filter("sorted", lambda e, j: (F.get("sorted", j - 1)["h"] == e["h"]) | (F.get("sorted", j + 1)["h"] == e["h"])),
        lambda e: e["i"])))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"])
    return rows.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def ledger(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measurements of every row and ``failed``, a long with the bit of each rule that it fails.

    The ledger is written once to the shared folder. What is asked of it later, filters too, then reads the table
    and is not pushed down into the measuring of texts.
    """
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return cut(measure(df, text, key).withColumn("failed", failed.cast("long")))


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's name, version and verdict."""
    return rows.withColumns({"policy": F.lit(policy.name), "version": F.lit(policy.version), "kept": passes(policy)})


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """What each rule of each policy contributes, from one aggregation over the ledger.

    (policy, version, rule, n_rows, n_dropped, n_failing, n_only): ``n_only`` rows come back if the rule goes.
    An empty ledger gives no row.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))  # at most one row for each set of failed rules
    asked = [(p.name, p.version, p.mask, rule, BIT[rule]) for p in policies for rule in p.rules]
    out = [F.struct(F.lit(a).alias("policy"), F.lit(b).alias("version"), F.lit(c).cast("long").alias("mask"),
                    F.lit(d).alias("rule"), F.lit(e).cast("long").alias("bit")) for a, b, c, d, e in asked]
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return patterns.select("*", F.inline(F.array(*out))).groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_rows"), count(hit != 0).alias("n_dropped"),
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failing"), count(hit == F.col("bit")).alias("n_only"))


def common_failures(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: rules that some row fails and rules that every row fails, as masks."""
    return rows.groupBy(*by).agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"),
                                 F.max(F.bit_count("failed")).alias("most_failed"))
