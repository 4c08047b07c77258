"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. Every item is cut into windows of WORDS consecutive words (a shorter item is one window).
2. The training frequency of every benchmark term is counted over all documents.
3. Each window's terms are ordered from the rarest on. Postings of the rarest ones are stored: (row, term, position and the
   neighbouring terms as far as a window reaches), with one closing posting a document that holds its length. The
   neighbours are the parts of the other terms' lists that an intersection can need, so no further list is fetched.
4. A posting of a window's rarest term proposes the start position - offset; the lists of the next rarest terms, shifted by
   their offsets, are intersected with it in turn, and last all terms: an exact phrase. ``proximity`` relaxes the last step.

The corpus is read twice and never shuffled; what moves are matches. Broadcast sides are term and window tables of the
benchmark, and only if their counted size allows; else these joins are shuffled.

Row semantics: every document row is judged by itself, also if doc_id or text repeat; null text has no words; items without
words are ignored; items of equal id count once; hits of an item without id count, but name no item. Texts of any length are
indexed whole. An empty table gives an empty table, an empty benchmark no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, small

WORDS, LISTS = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, before letters are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = "<end>"  # no word, as "<" separates words


def lower_ascii(s: Column) -> Column:
    """A-Z in lower case, other letters as they are; ``lower`` alone does so only for ASCII."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The words of a text, letters as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(win array<string>, items: ids as strings) of all distinct windows."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), split_words(lower_ascii(F.coalesce("text", F.lit("")))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - words, F.lit(0)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, words))).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): how often each of the terms stands in all documents."""
    word = docs.select(F.explode(split_words(F.col("text"))).alias("w")).select(lower_ascii(F.col("w")).alias("term"))
    return word.join(small(terms, 80), "term").groupBy("term").agg(F.count("*").alias("df"))


def plan(wins: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """Windows with their rarest terms first: (win, items, term, off, more array<struct<df, term, off>>). Windows with a term
    that no document holds can't occur and drop out."""
    each = wins.select("win", "items", F.posexplode("win").alias("off", "term")).join(counts, "term")
    rare = each.groupBy("win").agg(F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("df", "term", "off"))).alias("r"))
    rare = rare.where(F.size("r") == F.size("win"))
    return rare.select("win", "items", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["off"].alias("off"), F.slice("r", 2, lists - 1).alias("more"))


def index(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The stored postings of the terms: (rid, doc_id, term, pos, rel, near). ``near`` holds the terms up to ``reach`` places
    before and behind, ``rel`` the posting's own place in it. A document's closing posting has term END and its length as pos."""
    all_words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(split_words(F.col("text")), F.array(F.lit(END))).alias("w"))
    each = all_words.select("rid", "doc_id", "w", F.posexplode("w").alias("pos", "word")).withColumn("term", lower_ascii(F.col("word")))
    wanted = small(terms.select("term").unionAll(docs.sparkSession.range(0, 1, 1, 1).select(F.lit(END).alias("term"))), 80)
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.when(F.col("term") != END, F.transform(F.slice("w", first + 1, 2 * reach + 1), lower_ascii))
    return settle(each.join(wanted, "term").select("rid", "doc_id", "term", "pos", (F.col("pos") - first).alias("rel"), near.alias("near")), "postings")


def matches(postings: DataFrame, planned: DataFrame) -> DataFrame:
    """(rid, start, end, items) of every exact occurrence of a window: offset-adjusted lists intersected, rarest first."""
    start = F.col("rel") - F.col("off")
    found = postings.where(F.col("term") != END).join(small(planned, 600), "term").where((start >= 0) & (start + F.size("win") <= F.size("near")))
    found = found.where(F.forall("more", lambda x: F.get("near", start + x.off) == x.term))
    found = found.where(F.slice("near", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    begin = F.col("pos") - F.col("off")
    return found.select("rid", begin.alias("start"), (begin + F.size("win")).alias("end"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row of docs (doc_id, text)."""
    wins = settle(windows(benchmark, words), "windows")
    counts = settle(frequencies(docs, wins.select(F.explode("win").alias("term")).distinct()), "frequencies")
    planned = settle(plan(wins, counts), "planned")
    postings = index(docs, planned.select("term").distinct(), words - 1)
    hits = matches(postings, planned)
    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    by_row = hits.withColumn("new", new).groupBy("rid").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    ends = postings.where(F.col("term") == END).select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return ends.join(by_row, "rid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.concat_ws(",", items).alias("items")
    )


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 5, words: int = WORDS, share: float = 1.0) -> DataFrame:
    """(doc_id, start, items, found): places where at least ``share`` of a window's distinct terms stand within its length
    plus ``slack`` words around a posting of its rarest term, in any order."""
    wins = settle(windows(benchmark, words), "windows")
    counts = settle(frequencies(docs, wins.select(F.explode("win").alias("term")).distinct()), "frequencies")
    planned = settle(plan(wins, counts), "planned")
    postings = index(docs, planned.select("term").distinct(), words - 1 + slack)
    start = F.greatest(F.col("rel") - F.col("off") - slack, F.lit(0))
    near = F.slice("near", start + 1, F.size("win") + 2 * slack)
    hit = postings.where(F.col("term") != END).join(small(planned, 600), "term").withColumn("found", F.size(F.array_intersect("win", near)))
    return hit.where(F.col("found") >= F.ceil(F.size(F.array_distinct("win")) * share)).select("doc_id", (F.col("pos") - F.col("rel") + start).alias("start"), F.concat_ws(",", "items").alias("items"), "found")


def keep_clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """docs, all columns, without the rows whose text holds a window of the benchmark; texts are told apart by their digest."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    found = decontaminate(docs.select(digest.alias("doc_id"), "text"), benchmark, words).where("contaminated")
    return docs.withColumn("_digest", digest).join(found.select(F.col("doc_id").alias("_digest")).distinct(), "_digest", "left_anti").select(*docs.columns)


SQL = r"""
with d as (
  select doc_id, row_number() over () as rid,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), x -> x <> '') as w
  from documents
), b as (
  select item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), x -> x <> '') as w
  from benchmark
), wins as (
  select distinct item_id, list_slice(w, i + 1, i + 10) as win
  from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from b where len(w) > 0)
), lens as (select distinct len(win) as n from wins),
occ as (
  select rid, s, n, win from (
    select rid, n, unnest(range(0, len(w) - n + 1)) as s, w from d, lens where len(w) >= n
  ) x cross join lateral (select list_slice(x.w, x.s + 1, x.s + x.n) as win) y
), hit as (select rid, s, n, item_id from occ join wins using (win)),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from hit) group by rid),
its as (select rid, list_sort(list_distinct(list(item_id::varchar))) as items from hit group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(array_to_string(items, ','), '') as items
from d left join pos using (rid) left join its using (rid)
"""
