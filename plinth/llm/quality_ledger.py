"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once for each text. The ledger keeps its measurements and one bit for
each failed rule; a policy is a version and the mask of the rules that count, so verdicts of
any version, and what each rule alone rejects, follow from the ledger by bit operations.

Scale: DataFrame functions only, row by row and without a shuffle; ablations are one small
aggregate. Repeated windows are found inside a text's own arrays of hashes.

Defined cases: a null text has no words and fails ``few_words``. Repeated rows each give a
row. Extra columns are left alone; in a ledger, measurements replace columns of the same name, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and signs that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
GRAM = 8

#: The rules, in the order of their bits: name and the condition (over measurements) under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "2 * n_words > word_chars",
    "long_words": "word_chars > 20 * n_words",
    "no_letters": "n_words > 0 and n_letters = 0",
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


#: Policies by version: the mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": bit("few_words") | bit("repeated_words"),
    "v1": bit("few_words") | bit("repeated_words") | bit("no_letters"),
    "strict": (1 << len(RULES)) - 1,
}
VERSION = "v1"


def _joined(column: str, step: int) -> Column:
    """Hashes of each two values ``step`` places apart. A column, not an expression: it is read three times."""
    n = F.greatest(F.size(column) - step, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, step + 1, n), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame) -> DataFrame:
    """docs and the measurements of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # names for the steps that no column of docs begins with
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    df = docs.withColumn(f"{mark}words", words).withColumn("n_words", F.size(f"{mark}words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_letters", F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(f"{mark}lines", lines).withColumn("n_lines", F.size(f"{mark}lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size(f"{mark}lines") - F.size(F.array_distinct(f"{mark}lines"))).cast("long"))

    # windows of 1, 2, 4 and then GRAM words
    df = df.withColumn(f"{mark}h1", F.when(F.col("n_words") > GRAM, F.transform(f"{mark}words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(f"{mark}h2", _joined(f"{mark}h1", 1)).withColumn(f"{mark}h4", _joined(f"{mark}h2", 2)).withColumn(f"{mark}grams", _joined(f"{mark}h4", 4))
    # only texts with some repeated window go on to find out which words they cover
    some = F.size(f"{mark}grams") > F.size(F.array_distinct(f"{mark}grams"))
    df = df.withColumn(f"{mark}sorted", F.when(some, F.array_sort(F.transform(f"{mark}grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    at = lambda k: F.get(F.col(f"{mark}sorted"), k)["g"]
    twice = F.filter(f"{mark}sorted", lambda x, k: F.coalesce(x["g"] == at(k - 1), F.lit(False)) | F.coalesce(x["g"] == at(k + 1), F.lit(False)))
    df = df.withColumn(f"{mark}at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(f"{mark}at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + GRAM - F.greatest(a["end"], i)).alias("n"), (i + GRAM).alias("end")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop(f"{mark}words", f"{mark}lines", f"{mark}h1", f"{mark}h2", f"{mark}h4", f"{mark}grams", f"{mark}sorted", f"{mark}at")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters"]


def ledger(docs: DataFrame) -> DataFrame:
    """docs, the measurements and ``failed``, the bits of the rules that the text fails."""
    bits = [F.when(F.expr(condition), F.lit(bit(name))).otherwise(F.lit(0)) for name, condition in RULES.items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured(docs).withColumn("failed", mask.cast("long"))


def verdict(failed: Column, version: str = VERSION) -> Column:
    """True if the policy keeps a text with these failure bits."""
    return failed.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def keep(docs: DataFrame, version: str = VERSION) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    whole = docs.select(F.struct("*").alias("row"), "text")  # so that no column of docs meets a measurement of the same name
    return ledger(whole).where(verdict(F.col("failed"), version)).select("row.*")


def ablations(entries: DataFrame, version: str = "strict") -> DataFrame:
    """For each rule of a policy: texts that fail it, and texts that only it rejects (kept again without it)."""
    mask = POLICIES[version]
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))  # as many rows as combinations of rules
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(bit(name)).cast("long").alias("bit")) for name in RULES if bit(name) & mask]
    each = counts.select("failed", "n", F.explode(F.array(*rules)).alias("r"))
    within = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(within == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """The columns of the contract, and the ledger's bits."""
    entries = ledger(docs.select("doc_id", "text"))
    base = ~verdict(F.col("failed"), "base")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict(F.col("failed"))).alias("kept"), "failed")


def ablation_report(docs: DataFrame) -> DataFrame:
    """What each rule of the strict policy rejects, and what only it rejects, over all documents."""
    return ablations(ledger(docs.select("doc_id", "text")).select("failed"))


_CLEAN = r"[\x20\x09-\x0D]+"
REPORT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{_CLEAN}'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT rid, doc_id, words, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_CLEAN}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::BIGINT AS n_letters FROM w),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
f AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
       + CASE WHEN 2 * n_words > word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
       + CASE WHEN n_words > 0 AND n_letters = 0 THEN 64 ELSE 0 END)::BIGINT AS failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed & 64 = 0 AS kept, failed FROM b
"""

ABLATION_SQL = f"""SELECT rule, sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed, sum(CASE WHEN failed = bit THEN 1 ELSE 0 END)::BIGINT AS n_only
FROM ({REPORT_SQL}) CROSS JOIN (VALUES {", ".join(f"('{name}', {bit(name)}::BIGINT)" for name in RULES)}) r(rule, bit) GROUP BY rule"""
