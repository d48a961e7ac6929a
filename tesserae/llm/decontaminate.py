"""Benchmark decontamination with DataFrame operations only.

The windows of the test items (10 consecutive words; a shorter item is one
window as a whole) form a hash set that goes to every task as a bitmap, and so do
the first and last words of the blocks of six words in them. Each document is
scanned once: every fifth word starts a block, and any window holds one of these
blocks, so only around blocks whose bit is set are windows looked up in the hash
set. Those found are compared as words with the items'. A word inside any
occurrence of a window is hit.

The bitmaps have `BITS` bits for each window, at most `MOST_BITS` in all, so their
size is bounded whatever the benchmark: past that they only let more windows
through to the comparison. Null texts and texts without words have no windows and
are clean; so is every document where the benchmark is empty. Repeated rows, and
rows without or with the same doc_id (-1 for null), are separate documents; a
null item_id is not among the items. Columns other than doc_id and text, or
item_id and text, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import row_id
from .storage import write_table

WINDOW = 10
#: Bits of a bitmap for each window, and at most in all (8 MiB).
BITS, MOST_BITS = 16, 1 << 26
#: A word is a run of none of these, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z became a-z, and what stands between words.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    """Words of a text with A-Z, and no other letter, in lower case."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def hashed(words: Column) -> Column:
    """A hash of each word; equal words in words() have equal ones, as letter case is settled word by word."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, win (its words), ends (hashes of its blocks' first and last words) and key (of all its words), each once."""
    items = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("ws")).withColumn("hs", hashed(F.col("ws")))
    size = F.least(F.size("ws"), F.lit(window))
    at = F.when(F.size("ws") > 0, F.sequence(F.lit(1), F.size("ws") - size + 1)).otherwise(F.expr("array()").cast("array<int>"))
    each = items.select("item_id", "ws", "hs", size.alias("size"), F.explode(at).alias("at"))
    win = F.concat_ws(" ", F.slice("ws", F.col("at"), F.col("size")))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / 2).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), step - 1), lambda o: _ends(F.col("hs"), F.col("at") - 1 + o, F.col("size") - step + 1))
    return each.select("item_id", "size", win.alias("win"), ends.alias("ends"), _whole(F.col("hs"), F.col("at"), F.col("size")).alias("key")).distinct()


def _ends(hs: Column, i: Column, size: Column) -> Column:
    """Of the first and last word of the `size` words at i, counted from 0."""
    return F.get(hs, i).bitwiseXOR(F.shiftright(F.get(hs, i + size - 1), 1))


def _whole(hs: Column, at: Column, size: Column) -> Column:
    """Of the window at `at`, counted from 1."""
    return F.xxhash64(F.slice(hs, at, size))


def _bitmap(keys: DataFrame, key: str, words_of: int) -> Column:
    """array<long> with a bit set for each key: a scalar that the scan gets whole."""
    set_bits = keys.select(_word(F.col(key), words_of).alias("id"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    dense = keys.sparkSession.range(words_of).join(set_bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("all")).select(F.transform("all", lambda x: x["bits"])).scalar()


def _word(key: Column, words_of: int) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(words_of - 1).cast("long"))


def _set(bitmap: Column, key: Column, words_of: int) -> Column:
    return F.getbit(F.get(bitmap, _word(key, words_of).cast("int")), key.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def _found(n: int, words_of: int) -> Column:
    """size, start and words of each window of n words whose bits are set. The row has n words at least.

    Blocks start at every `step`-th word; a window's first block starts at one of
    its first `step` words and ends inside it.
    """
    step = max(1, n // 2)
    block, words_in = n - step + 1, F.size("hs")
    starts = F.filter(F.sequence(F.lit(1), words_in - block + 1, F.lit(step)), lambda p: _set(F.col("by_ends"), _ends(F.col("hs"), p - 1, F.lit(block)), words_of))
    around = F.flatten(F.transform(starts, lambda p: F.sequence(F.greatest(F.lit(1), p - step + 1), F.least(p, words_in - n + 1))))
    hit = F.filter(around, lambda at: _set(F.col("by_key"), _whole(F.col("hs"), at, F.lit(n)), words_of))

    def window(at: Column) -> Column:
        win = F.translate(F.concat_ws(" ", F.slice("ws", at, F.lit(n))), string.ascii_uppercase, string.ascii_lowercase)
        return F.struct(F.lit(n).alias("size"), at.alias("at"), win.alias("win"))

    return F.transform(hit, window)


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, and found: size, start and words of each window whose bits are set."""
    sizes = {r[0]: r[1] for r in windows.groupBy("size").agg(F.count("*")).collect()}  # one for each size up to the window's
    words_of = 1 << max(0, min(MOST_BITS // 64, -(-BITS * max(1, sum(sizes.values())) // 64)).bit_length() - 1)
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(F.monotonically_increasing_id().alias("rid"), row_id(), F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)).alias("ws"))
    marked = marked.withColumn("hs", hashed(F.col("ws"))).withColumns({"by_ends": _bitmap(windows.select(F.explode("ends").alias("ends")), "ends", words_of), "by_key": _bitmap(windows, "key", words_of)})
    none = F.expr("array()").cast("array<struct<size:int,at:int,win:string>>")
    found = F.concat(none, *(F.when(F.size("hs") >= n, _found(n, words_of)).otherwise(none) for n in sorted(sizes)))
    marked = marked.select("rid", "doc_id", F.size("ws").cast("long").alias("n_words"), found.alias("found"))
    return marked.withColumn("found", F.when(F.size("found") > 0, F.col("found")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit (places of hit words from 0) for every row."""
    windows = write_table(item_windows(benchmark, window), "windows")
    marked = write_table(candidates(docs, windows), "candidates")
    each = marked.where(F.col("found").isNotNull()).select("rid", F.inline("found"))
    sure = each.join(windows.select("item_id", "win"), "win")
    places = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at") - 1, F.col("at") + F.col("size") - 2)))))
    per = sure.groupBy("rid").agg(places.alias("hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    return marked.select("rid", "doc_id", "n_words").join(per, "rid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"), "hit",
    )


def _marked(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """docs with a key of each row, written, and the hit words of contaminated rows by that key."""
    keyed = write_table(docs.withColumn("_row_key", F.monotonically_increasing_id()), "keyed")
    hits = decontaminate(keyed.select(F.col("_row_key").alias("doc_id"), "text"), benchmark, window)
    return keyed, hits.where("contaminated").select(F.col("doc_id").alias("_row_key"), F.col("hit").alias("_hit"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that have no hit, columns as they are, whatever their doc_id."""
    keyed, hits = _marked(docs, benchmark, window)
    return keyed.join(hits, "_row_key", "left_anti").drop("_row_key")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without hit words and what follows each up to the next word, whatever their doc_id."""
    keyed, hits = _marked(docs, benchmark, window)
    both = keyed.join(hits, "_row_key", "left")
    parts = F.regexp_extract_all("text", F.lit(RAW_WORD + RAW_GAP), F.lit(0))
    kept = F.array_join(F.filter(parts, lambda w, i: ~F.array_contains(F.col("_hit"), i)), "")
    text = F.when(F.col("_hit").isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", "^" + RAW_GAP, 0), kept))
    return both.withColumn("text", text).drop("_row_key", "_hit")
