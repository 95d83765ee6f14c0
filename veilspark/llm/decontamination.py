"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words (PUNCTUATION deleted, case folded over all of Unicode) are hashed; a fixed mask picks some of SPAN consecutive words and ignores
the others, so that a seed survives substitutions at ignored places. The seeds of test items and of documents are
joined by hash. Around a hit, document and item are laid over one another, and the hit counts if WINDOW consecutive
places (all places, where item or document leave fewer) hold at least SHARE percent equal words, or if RUN consecutive
places are all equal.

A run of SPAN equal words has a seed of every mask, so that none is missed. With scattered substitutions some are: of
the 4845 ways to put 4 into 20 places 35 leave no seed, and more where fewer places overlap.

The seeds of the items, and later the hits, are broadcast after their number is checked; beyond MOST the joins are
shuffled. Documents are exploded into places within a task, and nothing but ids and places of hits leaves it.

Items of fewer than SPAN words have no seeds: from LEAST words on they match where all their words stand in a row.

Defined cases: null and empty texts have no words and match nothing; so do items of fewer than LEAST words; texts of any
length are read whole; of several places with equally many equal words the first is given; a row without an id is no
document; repeated ids give one row for each item they hold; other columns are dropped (contaminated) or stay as they
are (without_contaminated); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import shared

#: The places of a seed that each mask looks at.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 9), (0, 2, 3, 6, 7, 8), (0, 1, 2, 5, 8, 10))
SPAN, WINDOW, SHARE = 11, 20, 80
#: Equal words in a row that count by themselves.
RUN = 13
#: Items of fewer words than this match nothing; from it on and below SPAN words an item matches as a whole.
LEAST = 5
#: Seeds of test items, and hits, that are broadcast at most, of about 32 bytes each.
MOST = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]"


def words(text: Column) -> Column:
    # by way of capitals, so that letters with several small forms (ß and ss, σ and ς) are one; Spark would drop an upper
    # right inside a lower
    capitals = F.translate(F.upper(F.coalesce(text.cast("string"), F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(F.lower(capitals), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def seeds(df: DataFrame, place: str, *kept: str) -> DataFrame:
    """A row for each place and mask: kept, the place and the seed; df has w, the words."""
    hashed = df.where(F.size("w") >= SPAN).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    each = hashed.select(*kept, "h", F.explode(F.sequence(F.lit(0), F.size("h") - SPAN)).alias(place))
    own = [F.xxhash64(F.lit(k), *(F.get("h", F.col(place) + o) for o in mask)) for k, mask in enumerate(MASKS)]
    return each.select(*kept, place, F.explode(F.array(*own)).alias("seed"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, item_id, overlap, start): the items that a document holds, the most equal words of a window, and the word at which the item would begin."""
    spark = shared.prepared(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), words(F.col(f"`{text_col}`")).alias("w")).where("id is not null")
    test = items.select(F.col(f"`{item_col}`").alias("item"), words(F.col(f"`{item_text}`")).alias("b")).where("item is not null")
    own = seeds(test.withColumnRenamed("b", "w"), "q", "item").distinct()
    own = F.broadcast(own) if own.limit(most + 1).count() <= most else own
    # no text goes with a place: only which documents and items meet, and how they lie
    met = seeds(texts, "p", "id").join(own, "seed").select("id", "item", (F.col("p") - F.col("q")).alias("d")).distinct().checkpoint()
    few = met.limit(most + 1).count() <= most
    hits = texts.join(F.broadcast(met) if few else met, "id").join(test.distinct(), "item")
    # the item laid over the document, from its word d on; both from the first word that the two have
    first = F.greatest(F.lit(0), -F.col("d"))
    n = F.least(F.size("b"), F.size("w") - F.col("d")) - first
    same = F.zip_with(F.slice("b", first + 1, n), F.slice("w", first + F.col("d") + 1, n), lambda x, y: (x == y).cast("int"))
    laid = hits.select("id", "item", "d", same.alias("same"), F.least(F.lit(WINDOW), n).alias("size"), n.alias("n"))
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("size")), F.lit(0), lambda a, x: a + x))
    in_a_row = F.exists(F.sequence(F.lit(1), F.col("n") - RUN + 1), lambda i: F.aggregate(F.slice("same", i, RUN), F.lit(0), lambda a, x: a + x) == RUN)
    counted = laid.select("id", "item", "d", "size", F.array_max(windows).alias("overlap"), F.when(F.col("n") >= RUN, in_a_row).otherwise(False).alias("run"))
    counted = counted.where(f"run or 100 * overlap >= {SHARE} * size").select("id", "item", "d", "overlap")
    out = counted.union(_whole(texts, test, most)).groupBy("id", "item").agg(F.max(F.struct("overlap", (-F.col("d")).alias("d"))).alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.overlap").alias("overlap"), (-F.col("best.d")).alias("start"))


def _whole(texts: DataFrame, test: DataFrame, most: int) -> DataFrame:
    """(id, item, d, overlap): short items, which have no seeds, by the hash of all their words in a row."""
    short = test.where(f"size(b) between {LEAST} and {SPAN - 1}").distinct()
    sizes = [r.n for r in short.select(F.size("b").alias("n")).distinct().orderBy("n").collect()]  # at most SPAN - LEAST
    nothing = texts.select("id", F.lit(None).alias("item"), F.lit(0).cast("int").alias("d"), F.lit(0).alias("overlap")).where("false")
    if not sizes:
        return nothing.select("id", F.col("item").cast(test.schema["item"].dataType).alias("item"), "d", "overlap")
    key = lambda w: F.xxhash64(w)
    own = short.select("item", "b", F.size("b").alias("n"), key(F.col("b")).alias("key"))
    own = F.broadcast(own) if own.limit(most + 1).count() <= most else own
    each = texts.select("id", "w", F.explode(F.array(*(F.lit(n) for n in sizes))).alias("n")).where("size(w) >= n")
    at = each.select("id", "n", F.inline(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda p: F.struct(p.alias("d"), key(F.slice("w", p + 1, F.col("n"))).alias("key"), F.slice("w", p + 1, F.col("n")).alias("said")))))
    return at.join(own, ["n", "key"]).where("said = b").select("id", "item", "d", F.col("n").alias("overlap"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item."""
    gone = contaminated(docs, items, id_col, text_col, item_col, item_text).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
