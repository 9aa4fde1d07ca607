"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; policies are bit masks applied later, and ablations only aggregate bits.
Built-in column functions throughout: no Python runs on the executors.

Defined results: a null or empty text has no words, so every count is 0 and the `short` bit
is set; very long texts are measured whole; repeated rows each get their own ledger row;
other columns of the input pass through unless they clash with a ledger column, which then
wins; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Bit i of failed_bits is set when RULES[i] fails. Append only: stored ledgers hold these bits.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("upper_case", "10 * n_upper > 3 * word_chars"),
    ("exclamations", "10 * n_exclaim > n_words"),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repeated_words"),
    "2024-1": ("short", "repeated_words", "symbols", "duplicate_lines"),
    "2024-2": tuple(name for name, _ in RULES),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return reduce(lambda bits, name: bits | 1 << names.index(name), POLICIES[policy], 0)


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text. Windows are sorted as
    longs: a hash above, the position in as many bits as the text needs below. Neighbours with
    equal hashes are the same window when their words are."""
    n = F.size(words) - 2
    bits = F.length(F.bin(n))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def keys(w: Column, bits: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long")))

    def found(w: Column, bits: Column, low: Column, s: Column) -> Column:
        at = lambda x: x.bitwiseAND(low).cast("int")
        high = lambda x: F.call_function("shiftrightunsigned", x, bits)
        same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
        alike = lambda x, y: F.coalesce((high(x) == high(y)) & same(at(x), at(y)), F.lit(False))
        repeated = F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(repeated, at))

    def covered(p: Column) -> Column:
        step = lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), step))

    held = F.struct(words.alias("w"), bits.alias("bits"), low.alias("low"))
    sort = lambda x: _bind(F.sort_array(keys(x["w"], x["bits"])), lambda s: found(x["w"], x["bits"], x["low"], s))
    return F.when(F.size(words) < 4, 0).otherwise(_bind(held, lambda x: _bind(sort(x), covered)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and the measurements that the rules refer to, all long."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(body, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{SPACE}+"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    others = [c for c in docs.columns if c not in made]
    split = docs.select(*others, words.alias("_words"), lines.alias("_lines"), body.alias("_body"))
    whole = F.array_join("_words", "")
    figures = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(whole),
        "n_symbols": F.regexp_count("_body", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_upper": F.regexp_count("_body", F.lit(r"\p{Lu}")),
        "n_exclaim": F.char_length("_body") - F.char_length(F.replace(F.col("_body"), F.lit("!"), F.lit(""))),
    }
    return split.select(*others, *[figures[c].cast("long").alias(c) for c in made])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and failed_bits (long) for every row; each rule is evaluated once."""
    bits = " | ".join(f"IF({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES))
    return measure(docs, text).withColumn("failed_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds `kept`: no rule of the policy failed. Needs the ledger alone, not the texts."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def filter_documents(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with."""
    return apply_policy(ledger(docs.withColumns({f"_in_{c}": F.col(c) for c in docs.columns}), text), policy).where("kept").select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, documents that only it rejects (kept if
    the rule went), and documents the policy rejects. The ledger is first counted by bit
    pattern (at most 2^rules of them), so a hot pattern is summed before the shuffle."""
    names = [name for name, _ in RULES]
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << names.index(name)).cast("long").alias("bit")) for name in POLICIES[policy]])
    return (
        patterns.select("bits", "n", F.explode(table).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_by_it_alone"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("rejected_by_policy"),
        )
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read(spark, sf_dir, "documents")))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


MEASURES_SQL = r"""
    SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(l)::BIGINT AS n_lines,
        len(regexp_extract_all(body, '\p{Lu}'))::BIGINT AS n_upper,
        len(regexp_extract_all(body, '!'))::BIGINT AS n_exclaim
    FROM (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM (SELECT *, row_number() OVER () AS r, coalesce(text, '') AS body FROM documents))
"""
LEDGER_SQL = f"""
WITH m AS MATERIALIZED ({MEASURES_SQL}),
g AS (SELECT r, i, row(w[i], w[i + 1], w[i + 2]) AS g FROM m, range(1, n_words - 1) AS t(i)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM hit, range(0, 3) AS t(k) GROUP BY r),
f AS (SELECT m.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (r))
SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))})::BIGINT AS failed_bits FROM f
"""
SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (failed_bits & {mask("base")}) <> 0 AS base_failed, (failed_bits & {mask(CURRENT)}) = 0 AS kept, failed_bits
FROM ({LEDGER_SQL})
"""
QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL = {"op9_quality_rules": SQL}
