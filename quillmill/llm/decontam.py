"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask of fixed word positions ("110101" reads the first, second, fourth and sixth of six
words) hashes only what it reads, so a substitution at another position leaves the hash as it
is. Hashes of all windows of documents and benchmark items are joined; each hit fixes an
alignment of the two texts, and the alignment is verified word by word: the best run in which
an equal word scores 1 and an unequal one -2 must hold enough equal words, or the whole item
must have enough of them. The masks leave no gap there: an item of six words or more with a
fifth of its words substituted, wherever they stand, shares a seed with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Fixed masks: five words each, read over six to nine, and four in a row, without which some
#: items of 7, 10 and 15 words have no seed left.
MASKS = ("111011", "1101011", "110010011", "1111")
#: Masks of short items: below six words all of them, for six words with one substituted three.
SHORT = {n: "1" * n for n in range(1, 6)} | {6: "111"}
#: Benchmark hashes (16 bytes each) and hit documents up to these numbers are broadcast.
BROADCAST_HASHES, BROADCAST_DOCS = 2_000_000, 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(df: DataFrame, keys: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(keys, at, seed) of every window of every mask; ``df`` has word hashes in ``h``."""
    offsets = sorted({i for m in masks for i, c in enumerate(m) if c == "1"})
    shifted = F.arrays_zip(*(F.slice("h", i + 1, F.greatest(F.size("h") - i, F.lit(0))).alias(f"w{i}") if i else F.col("h").alias("w0") for i in offsets))
    rows = df.where(F.size("h") >= min(len(m) for m in masks)).select(*keys, F.posexplode(shifted).alias("at", "w"))
    made = []
    for mask in masks:
        read = [F.col("w").getField(f"w{i}") for i, c in enumerate(mask) if c == "1"]
        made.append(F.when(read[-1].isNotNull(), F.xxhash64(F.lit(mask), *read)))
    return rows.select(*keys, "at", F.explode(F.array(*made)).alias("seed")).where("seed is not null")


def _equal_words(doc: Column, item: Column, diagonal: Column) -> Column:
    """(words, all): equal words of the best-scoring run, and of the whole overlap, along the
    alignment ``doc position - item position``."""
    first = F.greatest(F.lit(0), -diagonal)
    stop = F.least(F.size(item), F.size(doc) - diagonal)
    equal = F.transform(F.sequence(first, F.greatest(stop - 1, first)), lambda i: F.get(doc, i + diagonal) == F.get(item, i))
    start = F.struct(*(F.lit(0).alias(c) for c in ("score", "equal", "best", "words", "all")))

    def step(s: Column, same: Column) -> Column:
        score = F.greatest(F.lit(0), s["score"] + F.when(same, 1).otherwise(-2))
        count = F.when(score == 0, 0).otherwise(s["equal"] + F.when(same, 1).otherwise(0))
        better = score > s["best"]
        return F.struct(
            score.alias("score"), count.alias("equal"), F.when(better, score).otherwise(s["best"]).alias("best"),
            F.when(better, count).otherwise(s["words"]).alias("words"), (s["all"] + F.when(same, 1).otherwise(0)).alias("all"),
        )

    return F.aggregate(equal, start, step, lambda s: F.struct(s["words"].alias("words"), s["all"].alias("all")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", least_words: int = 12, share: float = 0.8, masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """(doc_id, mark, item_id, matched_words, item_words): verified overlaps, one row a pair.

    A pair counts if some alignment's best run holds at least ``least_words`` equal words, or
    ``share`` of the item's words if that is fewer, or if its whole overlap holds that share;
    an item below six words must be there word for word. ``matched_words`` are those of the
    run, or of the overlap where only it suffices. ``mark`` is the whole text's xxhash64, so
    that rows of one id with different texts stay apart; repeated rows give one row. Of items of
    one id with different texts the best match counts, of matches level in words the one to the
    shorter item. Null and empty texts, null item ids, and items without words match nothing; a
    null doc_id is returned as such; texts of any length are read whole; an empty table on either
    side gives an empty one; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), word_hashes(F.col(item_text).cast("string")).alias("h")).where("item_id is not null and h is not null")
    items = items.distinct().withColumn("item", F.xxhash64("h"))  # rows of one id with other texts are items of their own
    short = {r["n"]: SHORT[r["n"]] for r in items.select(F.size("h").alias("n")).where(F.col("n").isin(*SHORT)).distinct().collect()}
    asked = seeds(items.where(F.size("h") > 5), ["item_id", "item"], masks)
    for n, mask in short.items():
        asked = asked.union(seeds(items.where(F.size("h") == n), ["item_id", "item"], (mask,)))
    asked = asked.distinct().withColumnRenamed("at", "item_at")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_HASHES else asked
    found = seeds(base.withColumn("h", word_hashes(F.col("text"))), ["doc_id", "mark"], tuple(dict.fromkeys((*masks, *short.values()))))
    hits = found.join(asked, "seed").select("doc_id", "mark", "item_id", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = cut(hits, "hits")
    hit_docs = hits.select("doc_id", "mark").distinct()
    hit_docs = F.broadcast(hit_docs) if hit_docs.count() <= BROADCAST_DOCS else hit_docs
    same = base["doc_id"].eqNullSafe(hit_docs["doc_id"]) & (base["mark"] == hit_docs["mark"])
    bodies = cut(base.join(hit_docs, same, "left_semi").select("doc_id", "mark", word_hashes(F.col("text")).alias("d")), "bodies")
    at = hits.join(items, ["item_id", "item"])
    pairs = at.join(bodies, at["doc_id"].eqNullSafe(bodies["doc_id"]) & (at["mark"] == bodies["mark"])).select(at["doc_id"], at["mark"], "item_id", "diagonal", "h", "d")
    scored = pairs.select("doc_id", "mark", "item_id", F.size("h").alias("item_words"), _equal_words(F.col("d"), F.col("h"), F.col("diagonal")).alias("e"))
    part = F.when(F.col("item_words") < 6, F.col("item_words")).otherwise(F.ceil(F.col("item_words") * share))
    words = F.when(F.col("e.words") >= F.least(F.lit(least_words), part), F.col("e.words")).when(F.col("e.all") >= part, F.col("e.all"))
    best = scored.withColumn("words", words).where("words is not null").groupBy("doc_id", "mark", "item_id")
    best = best.agg(F.max(F.struct("words", (-F.col("item_words")).alias("less"))).alias("best"))
    return best.select("doc_id", "mark", "item_id", F.col("best.words").alias("matched_words"), (-F.col("best.less")).alias("item_words"))
