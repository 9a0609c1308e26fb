"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are sets of words with positions. A window that occurs in a document
shares all its words with it, so its prefix, for a containment of one, is a single word:
the rarest one. Documents are searched for such words only; length and position then say
where the window would lie, and the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither letter nor digit: words are runs of all other characters.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WINDOW = 10
#: Least and most bits of the filter that goes along with the plan, and bits for each word in between; windows and words that may be broadcast.
FILTER_BITS, MOST_FILTER_BITS, BITS_A_WORD, BROADCAST_ROWS = 1 << 18, 1 << 22, 32, 100_000


def words_of(text: Column) -> Column:
    """Words of a text: A to Z become small letters and all other ASCII but letters and digits becomes blanks, between which the words are."""
    parts = F.split(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " ")
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def _filter_of(words: DataFrame) -> list[int]:
    """A bit set of the words' hashes, of a bounded size however many words there are."""
    size = FILTER_BITS
    n = words.limit(MOST_FILTER_BITS // BITS_A_WORD).count()
    while size < n * BITS_A_WORD and size < MOST_FILTER_BITS:
        size *= 2
    bits = words.select(F.pmod(F.xxhash64("word"), F.lit(size)).alias("bit")).distinct().groupBy(F.expr("cast(bit div 64 as int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).collect()
    cells = [0] * (size // 64)
    for row in bits:
        cells[row.cell] = row.bits
    return cells


def _in_filter(word: Column, cells: list[int]) -> Column:
    bit = F.pmod(F.xxhash64(word), F.lit(64 * len(cells)))
    cell = F.get(F.lit(cells), F.call_function("shiftright", bit, F.lit(6)).cast("int"))
    return F.call_function("shiftright", cell, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window): every run of `window` words of an item, or all its words if they are fewer."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.array(words_of(F.col("text")))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.concat_ws(" ", F.slice("words", s, window)))).alias("window")).distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often all documents have each word of the vocabulary: word, times."""
    cells = _filter_of(vocabulary)
    found = docs.select(F.explode(F.filter(words_of(F.col("text")), lambda w: _in_filter(w, cells))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("times"))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """The prefix of every distinct window: window, token (its rarest word over all documents), at (where it first is), length."""
    distinct = windows.select("window").distinct()
    placed = distinct.select("window", F.posexplode(F.split("window", " ")).alias("at", "word"))
    vocabulary = placed.select("word").distinct()
    times = materialize(word_counts(docs, vocabulary).join(_small(vocabulary), "word", "left_semi"))
    counted = placed.join(_small(times), "word", "left")
    rarest = counted.groupBy("window").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), F.col("word"), F.col("at"))).alias("r"), F.count(F.lit(1)).cast("int").alias("length"))
    return rarest.select("window", F.col("r.word").alias("token"), F.col("r.at").alias("at"), "length")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text_hash: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    docs: doc_id, text. benchmark: item_id, text. Further columns, whatever their names,
    are left out. Null and wordless texts have no words and no windows; a null item_id's
    windows are found but name no item. Repeated rows give repeated results. Items that
    share a window all count. Very long texts are read whole. Without items nothing is
    contaminated; without documents there are no rows.

    with_text_hash adds of_text, xxhash64 of the text that a row was judged by. The texts
    are read once for the words' counts and once for the places where a prefix
    may be; those are few, and only they take part in the joins.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = materialize(item_windows(benchmark.select("item_id", "text"), window))
    ready = materialize(prefixes(windows, docs))
    cells = _filter_of(ready.select(F.col("token").alias("word")).distinct())
    reach = window - 1

    def hits(words: Column) -> Column:
        places = F.array_compact(F.transform(words, lambda w, i: F.when(_in_filter(w, cells), i)))
        first = lambda i: F.greatest(i - reach, F.lit(0))
        return F.transform(places, lambda i: F.struct(F.get(words, i).alias("token"), i.alias("place"), first(i).alias("first"), F.slice(words, first(i) + 1, 2 * window - 1).alias("near")))

    held = F.transform(F.array(words_of(F.col("text"))), lambda words: F.struct(F.size(words).alias("n"), hits(words).alias("hits")))
    read = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("of_text"), F.explode(held).alias("held"))
    read = materialize(read.select("doc_id", "of_text", "held.*"))
    start = F.col("place") - F.col("at")
    probes = _small(ready.select("token", "at", "length").distinct())
    lying = read.select("doc_id", "of_text", "n", F.explode("hits").alias("hit")).select("doc_id", "of_text", "n", "hit.*").join(probes, "token")
    lying = lying.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
    lying = lying.withColumn("window", F.concat_ws(" ", F.slice("near", F.col("start") - F.col("first") + 1, F.col("length"))))
    matched = lying.join(_small(windows), "window").select("doc_id", "of_text", F.struct("start", "length").alias("span"), "item_id")
    rows = read.select("doc_id", "of_text", "n", F.lit(1).alias("row")).unionByName(matched, allowMissingColumns=True)
    grouped = rows.groupBy("doc_id", "of_text").agg(F.max("n").alias("n"), F.count("row").cast("int").alias("rows"), F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    sha = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    done = grouped.select("doc_id", "of_text", F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "rows")
    each = F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")
    own = ["doc_id", "of_text"] if with_text_hash else ["doc_id"]
    return done.select(*own, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), each).drop("copy")
