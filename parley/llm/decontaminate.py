"""Benchmark decontamination with DataFrame functions only.

Windows as long as a benchmark item are fingerprinted with SimHash; their fingerprints meet those of items of that length
in a multi-index: both are cut into radius + 1 blocks, and fingerprints within the radius agree on a block at least. The
weighted Jaccard similarity of five-word shingles then decides exactly. Only windows that hold as many shingles of one item
as that similarity takes are fingerprinted, wherever in the item those stand, so that none that reaches it is left out; and
they meet only the items that they hold so many shingles of. Shingles are told apart by how often they came before, as the
similarity counts them, so that repeated ones don't move a fingerprint further than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import scratch

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.8, 24, 64
#: Up to so many rows of numbers a table is sent to all executors; beyond, joins shuffle it.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of characters other than \\x20 and \\x09-\\x0D; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(window: Column) -> Column:
    """Every five words in a row; fewer words make one shingle."""
    many = F.transform(F.sequence(F.lit(1), F.size(window) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(window, i, SHINGLE), " "))
    return F.when(F.size(window) > SHINGLE, many).otherwise(F.array(F.array_join(window, " ")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is worked out once a row: the optimizer copies no expression over a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _fingerprint(shingles: str) -> Column:
    """SimHash of a column of shingles: bit b is set if over half their hashes have it."""
    return F.expr(f"""aggregate(sequence(0, {BITS - 1}), 0L, (bits, b) -> bits | if(2 * aggregate(hashes, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int)) > size({shingles}), shiftleft(1L, b), 0L))""")


def _hashes(shingles: Column) -> Column:
    """A hash for each shingle, those that occur again told apart."""
    plain = F.transform(shingles, lambda s: F.xxhash64(s))
    nth = lambda s, i: F.size(F.filter(F.slice(shingles, F.lit(1), i), lambda x: x == s))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(F.transform(shingles, lambda s, i: F.when(nth(s, i) == 0, F.xxhash64(s)).otherwise(F.xxhash64(s, nth(s, i)))))


def _blocks(fp: str, radius: int = RADIUS) -> Column:
    """(number, value) of each of radius + 1 blocks of a fingerprint."""
    edges = [k * BITS // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))


def _places(df: DataFrame, *keep: str) -> DataFrame:
    """A row for every word of `words`: its place `at` and it with the four after it, null beyond the end, as `part`."""
    parts = F.arrays_zip(*(F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(SHINGLE)))
    return df.where(F.size("words") > 0).select(*keep, F.size("words").alias("size"), F.posexplode(parts).alias("at", "part"))


def _hash(size: int) -> Column:
    """The hash of the first `size` words of `part`; null where there are fewer."""
    return F.when(F.col(f"part.w{size - 1}").isNotNull(), F.xxhash64(*(f"part.w{k}" for k in range(size))))


def _hashed(df: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """The hash `h` of every run of so many words, for each of `sizes`."""
    rows = _places(df, *keep)
    h = _hash(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(_hash, sizes)))
    return rows.select(*keep, "size", "at", h.alias("h")).where("h is not null")


def _sent(df: DataFrame) -> DataFrame:
    """`df`, sent to all executors if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _starts(seeds: DataFrame, similarity: float) -> DataFrame:
    """(key, item_key, length, first_word): windows with as many shingles of one item as it takes to reach the similarity.

    Of two lists of n and w shingles at least s / (1 + s) (n + w) must be common. If p are the sorted places of an item's
    shingles in a text, a window holds that many where it reaches from p[i] or before to p[i + needed - 1] or beyond.
    """
    places = seeds.groupBy("key", "item_key", "length", "size").agg(F.sort_array(F.collect_set("at")).alias("p"))
    places = places.withColumn("n", F.greatest(F.lit(1), F.col("length") - (SHINGLE - 1)))
    places = places.withColumn("w", F.least("n", F.greatest(F.lit(1), F.col("size") - (SHINGLE - 1))))
    needed = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("w")) - 1e-9)).cast("int")
    places = places.withColumn("needed", needed).where("size(p) >= needed")
    spans = F.expr("transform(sequence(1, size(p) - needed + 1), i -> struct(greatest(0, element_at(p, i + needed - 1) - w + 1) as low, least(element_at(p, i), greatest(0, size - length)) as high))")
    spans = places.select("key", "item_key", "length", F.inline(F.filter(spans, lambda x: x["low"] <= x["high"])))
    return spans.select("key", "item_key", "length", F.explode(F.sequence("low", "high")).alias("first_word")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, n_windows): items that occur in documents.

    One row for each document and item with a window of the item's length (the whole text, if it is shorter) whose
    weighted shingle similarity is `similarity` or more: the best one, the first of those that tie, and how many there
    are. Null and blank texts and items match nothing; rows with the same id count as one document, null among them;
    items that repeat give a row each. Other columns are not read. An empty table on either side gives no rows.
    """
    items = _once(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "words", words(F.col("text"))).where("size(words) > 0").withColumn("length", F.size("words"))
    items = items.withColumn("item_key", F.xxhash64("words"))
    short = sorted(r.length for r in items.where(F.col("length") < SHINGLE).select("length").distinct().collect())
    own_hash = F.coalesce(_hash(SHINGLE), F.when(F.col("at") == 0, F.coalesce(*(F.when(F.col("length") == k, _hash(k)) for k in range(1, SHINGLE)))))
    index = _places(items, "item_key", "length").select(own_hash.alias("h"), "item_key", "length").where("h is not null").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    split = _once(texts, "words", words(F.col("text")))
    seeds = _hashed(split, [*short, SHINGLE], "key").join(_sent(index), "h")
    starts = scratch.write_and_read(_starts(seeds, similarity), "starts")
    grouped = starts.groupBy("key").agg(F.collect_list(F.struct("item_key", "length", "first_word")).alias("starts"))
    few = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Texts are split again only where windows start in them.
    held = texts.join(F.broadcast(grouped) if few else grouped, "key").select("doc_id", "text", "starts")
    held = _once(held, "words", words(F.col("text"))).select("doc_id", "words", F.inline("starts"))
    windows = held.select("doc_id", "item_key", "length", "first_word", F.slice("words", F.col("first_word") + 1, F.col("length")).alias("window")).distinct()
    windows = scratch.write_and_read(windows, "windows")

    def printed(df: DataFrame, source: str, shingles: str, fp: str) -> DataFrame:
        df = _once(_once(df, shingles, _shingles(F.col(source))), "hashes", _hashes(F.col(shingles)))
        return scratch.write_and_read(_once(df, fp, _fingerprint(shingles)).drop("hashes"), "fingerprints")

    texts = printed(windows.select("item_key", "window").distinct().withColumn("window_no", F.monotonically_increasing_id()), "window", "shingles", "fp")
    own = printed(items.select("item_id", "item_key", "words").withColumn("item_no", F.monotonically_increasing_id()), "words", "item_shingles", "item_fp")
    # Only numbers and fingerprints go through the blocks; shingles are fetched for what lies within the radius.
    blocks = own.select("item_no", "item_key", "item_fp", F.inline(_blocks("item_fp", radius)))
    near = texts.select("window_no", "item_key", "fp", F.inline(_blocks("fp", radius))).join(_sent(blocks), ["item_key", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("window_no", "item_no").distinct()
    near = near.join(texts.select("window_no", "item_key", "window", "shingles"), "window_no").join(own.select("item_no", "item_id", "item_shingles"), "item_no")
    both = F.expr("aggregate(array_distinct(shingles), 0, (n, s) -> n + least(size(filter(shingles, x -> x = s)), size(filter(item_shingles, x -> x = s))))")
    near = _once(near, "both", both).withColumn("similarity", F.col("both") / (F.size("shingles") + F.size("item_shingles") - F.col("both")))
    found = windows.join(near.where(F.col("similarity") >= similarity).select("item_key", "window", "item_id", "similarity"), ["item_key", "window"])
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("before")))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.max("length").alias("n_words"), F.count("*").alias("n_windows"))
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).alias("first_word"), "n_words", "n_windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item. Rows are told apart by id and text."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    found = leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text").select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(found, "key", "left_anti").select("row.*")
