"""Quality rules as a ledger: measurements and one bit for each failed rule, judged later by versioned policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import text_of

#: Rules in the order of their bits, never renumbered: (name, SQL condition of failure over the measurements).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("exclamations", "4 * n_exclamations > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("many_words", "n_words > 1000000"),
]


def mask(*names: str) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[n] for n in names)


#: A policy is the set of rules that reject a document; new policies are added, old ones stay.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "symbols", "exclamations", "duplicate_lines", "short_words", "long_words"),
    "v2": mask("few_words", "repeated_words", "symbols", "exclamations", "duplicate_lines", "short_words", "long_words", "many_words"),
}

SYMBOLS = "#*$%&|<>"

#: Positions of the 3-word windows found twice or more. Each window gets one number: the upper bits of its hash,
#: the position below. Sorted, equal windows stand side by side; neighbours are compared word by word, so a
#: collision of hashes counts nothing. `ws` and `ks` are bound once, by lambdas, and not computed again an element.
_REPEATS = """
transform(array(ws), ws ->
  transform(array(length(bin(size(ws)))), b ->
    transform(array(sort_array(slice(transform(ws, (w, i) -> (xxhash64(w, get(ws, i + 1), get(ws, i + 2)) & shiftleft(-1L, b)) | i), 1, greatest(size(ws) - 2, 0)))), ks ->
      transform(array(filter(ks, (k, j) -> shiftright(k, b) = shiftright(get(ks, j + 1), b) OR shiftright(k, b) = shiftright(get(ks, j - 1), b))), cs ->
        array_sort(transform(
          filter(
            transform(cs, (k, j) -> struct(
              CAST(k & ~shiftleft(-1L, b) AS INT) AS p,
              CAST(coalesce(get(cs, j + 1), k) & ~shiftleft(-1L, b) AS INT) AS r,
              CAST(coalesce(get(cs, j - 1), k) & ~shiftleft(-1L, b) AS INT) AS l)),
            c -> (c.r <> c.p AND get(ws, c.p) = get(ws, c.r) AND get(ws, c.p + 1) = get(ws, c.r + 1) AND get(ws, c.p + 2) = get(ws, c.r + 2))
              OR (c.l <> c.p AND get(ws, c.p) = get(ws, c.l) AND get(ws, c.p + 1) = get(ws, c.l + 1) AND get(ws, c.p + 2) = get(ws, c.l + 2))),
          c -> c.p))
      )[0])[0])[0])[0]
"""


def _without(text: str, signs: str) -> str:
    for s in signs:
        text = f"replace({text}, '{s}', '')"
    return text


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, failed): every rule evaluated once on every whole text; bit i of `failed` is RULES[i].

    Measurements, all long: n_words (`[^\\x20\\x09-\\x0D]+`), word_chars (code points in words), n_symbols, n_exclamations
    (`!!`), n_lines (with a word), n_dup_lines (equal to an earlier one), n_repeat_words (in 3-word windows found
    twice or more). Built-in functions only; no shuffle, so groups of copies and long texts cost their own length.
    Null and empty texts have no words, and fail few_words alone; rows and keys are kept as they come; other columns
    are not read; an empty table gives no rows.
    """
    read = docs.select(docs[key].alias("key"), text_of(docs, text).alias("t"))
    words = read.select("key", "t", F.expr(r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')").alias("ws"), F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("ls"))
    measured = words.select(
        "key",
        F.size("ws").cast("bigint").alias("n_words"),
        F.expr("CAST(length(array_join(ws, '')) AS BIGINT)").alias("word_chars"),
        F.expr(f"CAST(length(t) - length({_without('t', SYMBOLS)}) AS BIGINT)").alias("n_symbols"),
        F.expr("CAST((length(t) - length(replace(t, '!!', ''))) DIV 2 AS BIGINT)").alias("n_exclamations"),
        F.size("ls").cast("bigint").alias("n_lines"),
        F.expr("CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(f"transform(array({_REPEATS}), ps -> aggregate(transform(ps, (p, i) -> CAST(least(3, coalesce(get(ps, i + 1) - p, 3)) AS BIGINT)), 0L, (a, x) -> a + x))[0]").alias("n_repeat_words"),
    )
    failed = " | ".join(f"(CASE WHEN {rule} THEN {1 << i}L ELSE 0L END)" for i, (_, rule) in enumerate(RULES))
    return measured.withColumn("failed", F.expr(failed))


def kept(policy: str) -> Column:
    """Whether a document passes all rules of the policy."""
    return F.col("failed").bitwiseAND(POLICIES[policy]) == 0


def ablations(of: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """(policy, rule, failing, failing_alone, kept): for each rule of each policy how many documents fail it, how many
    fail nothing else of the policy (kept once it is dropped), and how many the policy keeps.

    The ledger is aggregated once, by its bit sets (at most 2 to the number of rules); policies only combine those
    counts. An empty ledger gives counts of 0 for no bit set, hence no rows.
    """
    sets = of.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit"), F.lit(m).cast("bigint").alias("mask")) for p, m in (policies or POLICIES).items() for i, (name, _) in enumerate(RULES) if m >> i & 1]
    each = sets.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("n", "c.policy", "c.rule", "c.bit", F.col("failed").bitwiseAND(F.col("c.mask")).alias("hit"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("policy", "rule").agg(
        count(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("failing"), count(F.col("hit") == F.col("bit")).alias("failing_alone"), count(F.col("hit") == 0).alias("kept")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)
),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
counted AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS k FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST((length(t) - length(replace(t, '!!', ''))) // 2 AS BIGINT) AS n_exclamations,
    CAST(coalesce(counted.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(counted.n - counted.k, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN counted ON counted.doc_id = w.doc_id
),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 4 * n_exclamations > n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END) + (CASE WHEN n_words > 1000000 THEN 128 ELSE 0 END) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 127) = 0 AS kept, CAST(failed AS BIGINT) AS failed_rules FROM f
"""
