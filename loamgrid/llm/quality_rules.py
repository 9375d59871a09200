"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric and every rule is a column expression; no user function runs. The
rules compare integers (``100 * numerator`` with ``percent * denominator``), so
SQL gives the same verdicts.

Cases: a null or empty text has no words and fails the base rule; a very long
text is read whole, its words and windows held in one row; a metric that equals
its threshold keeps the text, nothing else is ranked; repeated rows
give a row each; a null doc_id stays null; further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words_of

#: Function words of four languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her she their we there been has when who will more no if out so what up about than into them can only other".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au par plus pas ce sur se ne il sont avec son aux sa ou comme mais elle cette être leur ses été ont fait nous vous je".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low * denominator <= 100 * numerator <= high * denominator`` (a side that is None is open)."""

    name: str
    numerator: str
    denominator: str | None
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        of = F.lit(100) if self.denominator is None else F.col(self.denominator)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (100 * F.col(self.numerator) >= self.low * of)
        if self.high is not None:
            ok = ok & (100 * F.col(self.numerator) <= self.high * of)
        return ok

    def sql(self) -> str:
        of = "100" if self.denominator is None else self.denominator
        parts = [f"100 * {self.numerator} >= {self.low} * {of}"] if self.low is not None else []
        parts += [f"100 * {self.numerator} <= {self.high} * {of}"] if self.high is not None else []
        return "(" + " AND ".join(parts) + ")"


#: The base rules, and the rules of the verdict: percent of the denominator.
BASE = (
    Rule("length", "n_words", None, low=20),
    Rule("repeated_words", "n_repeat_words", "n_words", high=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclamations", "n_words", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)


def stop_words() -> list[str]:
    return sorted(set().union(*STOP_WORDS.values()))


def _repeat_words() -> Column:
    """Words that lie in an 8-word window found twice or more, from ``hashes`` and ``windows``."""
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: (a.h == b.h) & (F.slice("hashes", a.i + 1, F.lit(8)) == F.slice("hashes", b.i + 1, F.lit(8)))

    def dup(x, k):
        before = F.when(k > 0, same(x, F.element_at("placed", F.greatest(k, F.lit(1))))).otherwise(False)
        after = F.when(k + 1 < F.size("placed"), same(x, F.element_at("placed", F.least(k + 2, F.size("placed"))))).otherwise(False)
        return before | after

    return placed, dup


def metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every metric of the rules, one row per document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), words_of(F.col(text_col).cast("string")).alias("words"))
    has_word = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    counted = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: w.isin(stop_words()))).cast("long").alias("n_stop_words"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.when(F.size("hashes") >= 8, F.transform(F.sequence(F.lit(1), F.size("hashes") - 7), lambda i: F.xxhash64(F.slice("hashes", i, F.lit(8))))).otherwise(F.array().cast("array<bigint>"))
    lined = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "hashes",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(SPACES)).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(SPACES)).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
        windows.alias("windows"),
    )
    placed, dup = _repeat_words()
    none = F.size(F.array_distinct("windows")) == F.size("windows")
    sorted_ = lined.withColumn("placed", F.when(~none, placed))
    starts = F.sort_array(F.transform(F.filter("placed", dup), lambda x: x.i))
    acc = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, acc, lambda a, p: F.struct((p + 8).alias("end"), (a.n + p + 8 - F.greatest(p, a.end)).alias("n")), lambda a: a.n)
    return sorted_.withColumn("n_repeat_words", F.coalesce(F.when(F.col("placed").isNotNull(), covered), F.lit(0)).cast("long")).drop("hashes", "windows", "placed")


def quality_rules(docs: DataFrame, *, base=BASE, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics, ``base_failed``, ``kept`` and the names of the failed rules of each document."""
    both = (*base, *rules)
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in both]))
    base_failed = ~F.lit(True)
    for r in base:
        base_failed = base_failed | ~r.passes()
    out = metrics(docs, id_col=id_col, text_col=text_col).withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    return out.withColumn("kept", F.size("failed_rules") == 0)


def oracle(columns: list[str]) -> str:
    """DuckDB SQL of ``quality_rules`` over the table documents, for these columns."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words())
    sp = r"[\x20\x09-\x0D]"
    nsp = r"[^\x20\x09-\x0D]"
    base = " AND ".join(r.sql() for r in BASE)
    rules = " AND ".join(r.sql() for r in (*BASE, *RULES))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{sp}+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{nsp}')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM d WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
        len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '^{sp}*[-*•]')))::BIGINT AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){sp}*$')))::BIGINT AS n_ellipsis_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id))
SELECT {", ".join(columns)} FROM (SELECT *, NOT ({base}) AS base_failed, ({rules}) AS kept FROM m)"""
