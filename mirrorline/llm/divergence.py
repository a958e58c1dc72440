"""Source divergence audit: how far apart the word use of a language's sources is.

Every (lang, source) group and every language gives each term of the language's
vocabulary a smoothed share in billionths, all in integers. Groups are compared
in pairs; terms that stand out in a group against its language are ranked.

Pairs are priced by a sparse merge. A group's counts are cut by term into
blocks of bounded size, each a sorted array of (term id, count). A task takes
two tiles of groups of one block, and for each unordered pair in it finds the
terms that both have by galloping through the longer array; terms that one or
both have are priced at their counts, all others at the groups' shares of an
unseen term, once per pair. A price holds both ways.

Defined cases: null text, lang or source is ''; a language without terms in
enough documents has an empty vocabulary, pairs of value 0 and no terms; a
source that is alone in its language has no pairs; repeated rows and rows of
one id are documents of their own; an empty table gives no rows. Columns other
than the three read pass by unread.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, pieces, stored, table

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
SCALE = 1_000_000_000
#: Terms of a block (about), and groups of a tile (about): what one task holds at once.
BLOCK_TERMS = 1 << 13
TILE_GROUPS = 16
#: Distinct (group, term) counts that a counting task holds before it sends them on.
HELD_COUNTS = 200_000

TERM = re.compile(rb"[a-z\x80-\xff]+")  # on lower-cased UTF-8 bytes


def _counted(batches):
    """(lang, source, term, n, df) rows, summed over as many texts as may be held."""
    held, size = {}, 0

    def rows():
        cols = [[], [], [], [], []]
        for (lang, source), (n, df) in held.items():
            cols[0] += [lang] * len(n)
            cols[1] += [source] * len(n)
            cols[2] += n.keys()
            cols[3] += n.values()
            cols[4] += [df[t] for t in n]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "df"])

    for batch in pieces(batches, "text"):
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.to_pylist(), strict=True):
            own = Counter(TERM.findall(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()))
            if not own:
                continue
            n, df = held.setdefault((lang, source), ({}, {}))
            before = len(n)
            for term, k in own.items():
                n[term] = n.get(term, 0) + k
                df[term] = df.get(term, 0) + 1
            size += len(n) - before
        if size >= HELD_COUNTS:
            yield rows()
            held, size = {}, 0
    if held:
        yield rows()


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of a term in a group, and the
    group's documents that have it. Rows lie together by (lang, term)."""
    counts = docs.select("lang", "source", "text").mapInArrow(
        _counted, "lang string, source string, term string, n bigint, df bigint")
    return (counts.repartition("lang", "term").groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / whole), exactly; null if whole is 0."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return 1 + F.call_function("div", product, F.when(whole != 0, whole.cast("decimal(20,0)")))


def _shares(n: np.ndarray, whole: int) -> np.ndarray:
    """The same of an array of counts."""
    if len(n) and int(n.max()) + SMOOTH > (2**63 - 1) // SCALE:
        n = n.astype(object)
    return (SCALE * (n + SMOOTH) // whole + 1).astype(np.int64)


def gallop(short: np.ndarray, long: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in both sorted arrays of distinct ids in 0..ids-1, of the ids
    that both have. Every id of ``short`` starts where ``long`` can have it at
    the earliest, doubles its step until it is passed, and halves it back."""
    if not len(short) or not len(long):
        none = np.zeros(0, np.int64)
        return none, none
    low = np.maximum(short.astype(np.int64) - (ids - len(long)), 0)  # long lacks ids - len(long) ids
    step = np.ones(len(short), np.int64)
    last = len(long) - 1
    while True:
        ahead = np.minimum(low + step, last)
        more = (long[ahead] < short) & (ahead < last)
        if not more.any():
            break
        low = np.where(more, ahead, low)
        step = np.where(more, step * 2, step)
    high = np.minimum(low + step, last)
    while (low < high).any():
        middle = (low + high) // 2
        below = long[middle] < short
        low, high = np.where(below, np.minimum(middle + 1, high), low), np.where(below, high, middle)
    hit = np.flatnonzero(long[low] == short)
    return hit, low[hit]


def pair_price(a, b, ids: int) -> int:
    """What the terms that a or b has add to the price of a pair in which every
    term counts as unseen by both. ``a``, ``b``: (sorted ids, counts, whole)."""
    (ids_a, n_a, whole_a), (ids_b, n_b, whole_b) = a, b
    if len(ids_a) > len(ids_b):
        return pair_price(b, a, ids)
    in_a, in_b = gallop(ids_a, ids_b, ids)
    p_a, p_b = _shares(n_a, whole_a), _shares(n_b, whole_b)
    none_a, none_b = SCALE * SMOOTH // whole_a + 1, SCALE * SMOOTH // whole_b + 1
    both = int(np.abs(p_a[in_a] - p_b[in_b]).sum())
    only_a = int(np.abs(np.delete(p_a, in_a) - none_b).sum())
    only_b = int(np.abs(np.delete(p_b, in_b) - none_a).sum())
    union = len(ids_a) + len(ids_b) - len(in_a)
    return both + only_a + only_b - union * abs(none_a - none_b)


def _pair_task(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Prices of the pairs between two tiles' groups in one block."""
    lang, _, tile_a, tile_b = (k.as_py() for k in key)

    def groups(t):
        columns = [t.column(i).to_pylist() for i in range(t.num_columns)][-5:]
        for source, whole, ids, term_ids, counts in zip(*columns, strict=True):
            yield source, ids, (np.asarray(term_ids, np.int64), np.asarray(counts, np.int64), whole)

    out = {"lang": [], "a": [], "b": [], "price": []}
    others = list(groups(right))
    for a, ids, arrays_a in groups(left):
        for b, _, arrays_b in others:
            if tile_a == tile_b and a >= b:
                continue
            out["lang"].append(lang)
            out["a"].append(a)
            out["b"].append(b)
            out["price"].append(pair_price(arrays_a, arrays_b, ids))
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("price", pa.int64())]))


def pair_prices(kept: DataFrame, terms: DataFrame, groups: DataFrame,
                block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, a, b, price): per unordered pair of a language's groups, the sum of
    ``pair_price`` over its blocks. kept(lang, source, term, n), terms(lang,
    term), groups(lang, source, whole, v)."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_groups).cast("int").alias("tiles"),
                                       F.ceil(F.max("v") / block_terms).cast("int").alias("blocks"))
    cut = terms.select("lang", "term").join(tiles.select("lang", "blocks"), "lang").select(
        "lang", "term", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"))
    in_block = Window.partitionBy("lang", "block").orderBy("term")
    ids = stored(cut.withColumn("id", (F.row_number().over(in_block) - 1).cast("bigint")))
    blocks = ids.groupBy("lang", "block").agg(F.count("*").alias("ids"))
    arrays = (kept.join(ids, ["lang", "term"]).groupBy("lang", "block", "source")
              .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held")))
    rows = (groups.join(tiles, "lang").withColumn("tile", F.expr("cast(pmod(xxhash64(source), tiles) as int)"))
            .join(blocks, "lang").join(arrays, ["lang", "block", "source"], "left"))
    none = F.array().cast("array<bigint>")
    rows = stored(rows.select("lang", "block", "source", "whole", "ids", "tile", "tiles",
                              F.coalesce("held.id", none).alias("term_ids"), F.coalesce("held.n", none).alias("counts")))
    fields = ("source", "whole", "ids", "term_ids", "counts")
    left = rows.select("lang", "block", F.col("tile").alias("tile_a"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("tile_b"), *fields)
    # Names of its own, as both sides come from one table.
    right = rows.select(F.col("lang").alias("lang_b"), F.col("block").alias("block_b"), F.explode(F.expr("sequence(0, tile)")).alias("tile_a_b"),
                        F.col("tile").alias("tile_b_b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    got = (left.groupBy("lang", "block", "tile_a", "tile_b").cogroup(right.groupBy("lang_b", "block_b", "tile_a_b", "tile_b_b"))
           .applyInArrow(_pair_task, "lang string, a string, b string, price bigint"))
    # Inside one tile a is the smaller name; between tiles either may be.
    return (got.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.sum("price").cast("bigint").alias("price")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
          block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module. docs(lang, source, text)."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    docs = docs.select(text_of("lang"), text_of("source"), text_of("text"))
    over_sources = Window.partitionBy("lang", "term")
    kept = stored(group_counts(docs)
                  .withColumn("lang_df", F.sum("df").over(over_sources)).withColumn("lang_n", F.sum("n").over(over_sources))
                  .where(F.col("lang_df") >= min_docs).select("lang", "source", "term", "n", "lang_n"))
    terms = stored(kept.select("lang", "term", "lang_n").distinct())
    langs = stored(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
                   .withColumn("lang_whole", F.col("lang_total") + SMOOTH * F.col("v")).drop("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = F.coalesce("v", F.lit(0).cast("bigint"))
    groups = stored(docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
                    .select("lang", "source", v.alias("v"), "lang_whole",
                            (F.coalesce("total", F.lit(0).cast("bigint")) + SMOOTH * v).alias("whole")))

    prices = pair_prices(kept, terms, groups, block_terms, tile_groups)
    unseen = groups.select("lang", "source", "v", share(F.lit(0).cast("bigint"), F.col("whole")).alias("unseen"))
    other = unseen.select("lang", F.col("source").alias("item"), F.col("unseen").alias("item_unseen"))
    pairs = unseen.join(other, "lang").where(F.col("source") != F.col("item"))
    pairs = (pairs.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item"))
             .join(prices, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (F.coalesce("price", F.lit(0).cast("bigint")) + F.col("v") * F.coalesce(F.abs(F.col("unseen") - F.col("item_unseen")), F.lit(0).cast("bigint"))).alias("value")))

    own = kept.join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    out = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     (share(F.col("n"), F.col("whole")) - share(F.col("lang_n"), F.col("lang_whole"))).alias("value")).where("value > 0")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(top)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as (select row_id, lang, source, unnest(ts) as term from d),
voc as (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct row_id) >= 30),
langs as (select lang, count(*) as v, sum(lang_n) as n from voc group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, source, t.term, count(*) as n from t join voc on t.lang = voc.lang and t.term = voc.term group by t.lang, source, t.term),
tot as (select lang, source, sum(n) as n from c group by lang, source),
whole as (select g.lang, g.source, coalesce(tot.n, 0) + 5 * langs.v as w, langs.n + 5 * langs.v as lw
          from g join langs on g.lang = langs.lang left join tot on g.lang = tot.lang and g.source = tot.source),
p as (select whole.lang, whole.source, voc.term, coalesce(c.n, 0) as n,
      1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5)) // cast(w as hugeint) as p,
      1 + (cast(1000000000 as hugeint) * (lang_n + 5)) // cast(lw as hugeint) as q
      from whole join voc on whole.lang = voc.lang
      left join c on c.lang = whole.lang and c.source = whole.source and c.term = voc.term),
priced as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
           from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
rows as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(priced.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join priced on priced.lang = a.lang and priced.source = a.source and priced.item = b.source
  union all
  select lang, source, 'term', term, cast(p - q as bigint) from p where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from rows)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
