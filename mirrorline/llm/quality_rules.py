"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements
and one ``failed_bits`` integer; policies are versioned sets of rules applied
to the bits afterwards, and ablations are aggregates over the bits, so trying
another policy never reads a text again.

Defined cases: a null or empty text has no words and fails ``few_words``; every
input row gives one ledger row (repeated rows and null ids included); an empty
table gives an empty ledger. The row's other columns are not read, so extra
columns with any name pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Rules in bit order; a measurement expression over the ledger's columns.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_density": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "exclamation_density": "10 * n_exclamations > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "upper_case": "2 * n_capitals > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versions of the policy: the rules whose failure removes a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_density", "duplicate_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words() -> Column:
    """Words inside 5-word windows that occur twice or more: windows become
    64-bit hashes, sorted to find equal neighbours; only a text that has any
    sorts (hash, position) pairs to mark positions and add up their union."""
    pairs = F.expr("sort_array(transform(_win, (x, i) -> struct(x as h, i as p)))")
    marked = F.expr(
        "sort_array(transform(filter(_pairs, (e, i) -> e.h = get(_pairs, i - 1).h or e.h = get(_pairs, i + 1).h), e -> e.p))")
    total = F.expr(
        f"aggregate(zip_with(slice(_at, 2, size(_at)), slice(_at, 1, size(_at) - 1), (b, a) -> least({WINDOW}, b - a)), {WINDOW}, (s, x) -> s + x)")
    return pairs, marked, total


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements, one row per document."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(*keep, t.alias("_t"))
    own = own.select(
        *keep,
        F.array_remove(F.split("_t", WORD_BREAK), "").alias("_w"),
        F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclamations"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    own = own.select(
        *keep, "n_symbols", "n_exclamations", "n_capitals",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(_w, w -> xxhash64(w))").alias("_h"),
    )
    shifted = ", ".join(f"get(_h, i + {k})" for k in range(1, WINDOW))
    own = own.withColumn("_win", F.expr(f"transform(slice(_h, 1, greatest(size(_h) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {shifted}))")).drop("_h")
    own = own.withColumn("_sorted", F.sort_array("_win"))
    own = own.withColumn("_has", F.expr("exists(zip_with(slice(_sorted, 2, size(_sorted)), slice(_sorted, 1, greatest(size(_sorted) - 1, 0)), (b, a) -> a = b), x -> x)"))
    pairs, marked, total = _repeat_words()
    none = F.expr("cast(array() as array<struct<h:bigint,p:int>>)")
    own = own.withColumn("_pairs", F.when(F.col("_has"), pairs).otherwise(none)).withColumn("_at", marked)
    return own.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_exclamations", "n_capitals",
        F.when(F.size("_at") > 0, total).otherwise(0).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``measure`` plus ``failed_bits``: bit i is set if rule i failed."""
    bits = None
    for name, rule in RULES.items():
        bit = F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text, keep).withColumn("failed_bits", bits)


def verdict(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that only this
    rule removes (those that come back without it), and the union of the bits
    that failed beside it. Works on counts per bit pattern, at most 2**rules rows."""
    spark = led.sparkSession
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(r, BIT[r]) for r in POLICIES[policy]], "rule string, bit int")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (patterns.join(F.broadcast(rules), hit)  # the rules are a fixed list
            .groupBy("rule", "bit")
            .agg(F.sum("n").alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.expr("bit_or(bits) ^ bit").alias("also_failed_bits")))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: the ledger of ``documents`` under the current policy."""
    from .common import table
    led = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (~base & verdict(CURRENT)).alias("kept"), "failed_bits")


OP5_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ls from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
      list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
wins as (select doc_id, p, ws[p:p + 4] as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as p from w where len(ws) >= 5)),
rep as (select distinct doc_id, p + k as q from (select doc_id, p, count(*) over (partition by doc_id, win) as n from wins), range(0, 5) r(k) where n >= 2),
reps as (select doc_id, count(*) as n from rep group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
      cast(len(array_to_string(ws, '')) as bigint) as word_chars,
      cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
      cast(len(lines) as bigint) as n_lines,
      cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
      cast(len(regexp_extract_all(t, '!')) as bigint) as n_ex,
      cast(len(regexp_extract_all(t, '[A-Z]')) as bigint) as n_cap,
      cast(coalesce(reps.n, 0) as bigint) as n_repeat_words
      from w left join reps on w.doc_id = reps.doc_id),
b as (select *, cast(
      case when n_words < 10 then 1 else 0 end
      + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
      + case when 10 * n_symbols > n_words then 4 else 0 end
      + case when 2 * n_dup_lines > n_lines then 8 else 0 end
      + case when 10 * n_ex > 3 * n_words then 16 else 0 end
      + case when word_chars < 2 * n_words then 32 else 0 end
      + case when word_chars > 15 * n_words then 64 else 0 end
      + case when 2 * n_cap > word_chars then 128 else 0 end as integer) as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from b
"""
