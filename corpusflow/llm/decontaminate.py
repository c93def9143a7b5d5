"""Operator 2: benchmark decontamination (DataFrame functions only).

Method: winnowing.  Of the hashes of all K-grams of words, each window of SPAN - K + 1
neighbouring ones keeps its least.  A span of SPAN words that a document and an item share
holds one such window, so both keep the same value from it: every shared span is found.
Kept values are joined, and each hit is extended word by word to both sides; a document
word is hit if the run of equal words around it is SPAN long or more.

* Items of fewer than SPAN words are one window each: for every such length that occurs,
  all grams of that length are fingerprints (a winnowing window of one).
* A document looks its values up in a bitmap of the item fingerprints and carries on only
  those found, each with the few words around it that an extension can reach.  Nothing of
  the documents is shuffled but a row for each document and its verified runs.
* The item side is broadcast in blocks of about ``max_block`` fingerprints, counted first and
  dealt by a hash; a larger benchmark takes several passes over the documents.
* Runs are verified on the words themselves, not on hashes.

Edge cases: null texts and texts without words hit nothing; an item without words is
ignored; repeated documents are counted each; repeated items count as one if they share
their id, a null item id as the empty text; an empty benchmark hits nothing; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

SPAN = 10
K = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, evaluating ``value`` once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def positions(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(hashes: Column, k: int) -> Column:
    return F.transform(positions(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def minima(grams: Column, window: int) -> Column:
    """Distinct least values of all windows."""
    return F.array_distinct(F.transform(positions(F.size(grams) - (window - 1)), lambda i: F.least(*[F.get(grams, i + j) for j in range(window)])))


def places(grams: Column, window: int) -> Column:
    """Distinct places of the least values of all windows, the first of equal ones."""
    here = lambda p: F.struct(F.get(grams, p).alias("g"), p.alias("p"))
    least = F.transform(positions(F.size(grams) - (window - 1)), lambda i: F.least(*[here(i + j) for j in range(window)]))
    return F.transform(F.array_distinct(least), lambda s: s["p"])


def around(w: Column, p: Column, k: int, reach: int) -> Column:
    """The gram at ``p`` with the words around it that an extension can reach, and how many are in front."""
    front = F.least(p, F.lit(reach))
    return F.struct(
        p.alias("p"),
        front.alias("front"),
        F.slice(w, p - front + 1, front + k + reach).alias("ctx"),
    )


HITS = "array<struct<g:bigint,k:int,at:struct<p:int,front:int,ctx:array<string>>>>"


def grams_of(w: Column, k: int, use: Callable[[Column], Column]) -> Column:
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(gram_hashes(h, k), use))


def hits(w: Column, wanted: Callable[[Column], Column], k: int, span: int) -> Column:
    """If ``wanted`` holds for a winnowed value, all grams for which it does, with their surroundings."""
    window = span - k + 1

    def placed(grams: Column) -> Column:
        kept = grams if window == 1 else minima(grams, window)
        all_places = F.transform(
            F.filter(positions(F.size(grams)), lambda p: wanted(F.get(grams, p))),
            lambda p: F.struct(F.get(grams, p).alias("g"), F.lit(k).alias("k"), around(w, p, k, span - k).alias("at")),
        )
        return F.when(F.exists(kept, wanted), all_places).otherwise(F.array().cast(HITS))

    return grams_of(w, k, placed)


def fingerprints(items: DataFrame, id_col: str, text_col: str, short: list[int]) -> DataFrame:
    """A row for each item fingerprint: g, k, need, item_id and its surroundings; equal ones of an item are one."""
    base = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("w"))

    def part(rows: DataFrame, k: int, span: int) -> DataFrame:
        def placed(grams: Column) -> Column:
            kept = positions(F.size(grams)) if span == k else places(grams, span - k + 1)
            around_it = lambda p: around(F.col("w"), p, k, span - k)
            return F.transform(kept, lambda p: let(around_it(p), lambda at: F.struct(F.get(grams, p).alias("g"), at["front"].alias("front"), at["ctx"].alias("ctx"))))

        made = rows.select("item_id", F.explode(grams_of(F.col("w"), k, placed)).alias("h"))
        return made.select("h.g", F.lit(k).alias("k"), F.lit(span).alias("need"), "item_id", F.struct("h.front", "h.ctx").alias("item"))

    out = part(base.filter(F.size("w") >= SPAN), K, SPAN)
    for m in short:
        out = out.unionByName(part(base.filter(F.size("w") == m), m, m))
    return out.distinct()


def bitmap(prints: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test for membership among ``n`` fingerprints: never wrong on a member, rarely right on another."""
    bits = 12
    while (1 << bits) < 64 * n and bits < 24:
        bits += 1
    slot = lambda g: g.bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        prints.select(F.col("g"), slot(F.col("g")).alias("s"))
        .groupBy(F.floor(F.col("s") / 64).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("word"))
        .collect()  # at most 2**18 words
    )
    table = [0] * (1 << (bits - 6))
    for r in rows:
        table[r["at"]] = r["word"]
    literal = F.expr(f"array({','.join(f'{x}L' if x > -(1 << 63) else '(-9223372036854775807L - 1L)' for x in table)})")
    return lambda g: let(slot(g), lambda s: F.getbit(F.get(literal, F.floor(s / 64).cast("int")), (s % 64).cast("int")) == 1)


def same_run(back: bool, steps: int) -> Column:
    """How many words in front of (behind) the gram are equal, up to ``steps``."""
    d, i = F.col("h.at"), F.col("item")
    if back:
        room = F.least(d["front"], i["front"])
        equal = lambda s: F.get(d["ctx"], d["front"] - s) == F.get(i["ctx"], i["front"] - s)
    else:
        room = F.least(F.size(d["ctx"]) - d["front"], F.size(i["ctx"]) - i["front"]) - F.col("h.k")
        equal = lambda s: F.get(d["ctx"], d["front"] + F.col("h.k") + s - 1) == F.get(i["ctx"], i["front"] + F.col("h.k") + s - 1)
    steps_there = F.slice(F.array(*[F.lit(s) for s in range(1, steps + 1)]), F.lit(1), F.greatest(F.lit(0), room))
    return F.aggregate(steps_there, F.lit(0), lambda acc, s: F.when((acc == s - 1) & equal(s), acc + 1).otherwise(acc))


def verified(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows of ``docs`` (row, doc_id, n_words, h) with the run of equal words each hit belongs to, if it is long enough."""
    d, i = F.col("h.at"), F.col("item")
    joined = docs.join(F.broadcast(prints), (F.col("h.g") == F.col("g")) & (F.col("h.k") == F.col("k")), "left")
    gram_equal = F.slice(d["ctx"], d["front"] + 1, F.col("h.k")) == F.slice(i["ctx"], i["front"] + 1, F.col("h.k"))
    run = joined.select(
        "row", "doc_id", "n_words", "item_id", "need", F.col("h.k").alias("k"), d["p"].alias("p"), gram_equal.alias("equal"),
        same_run(True, SPAN - K).alias("back"), same_run(False, SPAN - K).alias("ahead"),
    )
    long_enough = F.col("equal") & (F.col("back") + F.col("k") + F.col("ahead") >= F.col("need"))
    return run.select(
        "row", "doc_id", "n_words",
        F.when(long_enough, F.col("item_id")).alias("item_id"),
        F.when(long_enough, F.sequence(F.col("p") - F.col("back"), F.col("p") + F.col("k") + F.col("ahead") - 1)).alias("at"),
    )


def find_leaks(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_block: int = 100_000,
) -> DataFrame:
    """For every row of ``df``: doc_id, n_words, n_hit, items (sorted ids), n_items and contaminated."""
    sizes = items.select(F.size(words(F.col(item_text_col))).alias("n")).groupBy("n").count().filter(F.col("n").between(1, SPAN - 1)).collect()
    short = sorted(r["n"] for r in sizes)  # lengths below SPAN
    prints = stored(fingerprints(items, item_id_col, item_text_col, short))
    n = prints.count()
    blocks = max(1, -(-n // max_block))
    base = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")
    )
    lengths = [(K, SPAN)] + [(m, m) for m in short]
    found = None
    for b in range(blocks):
        mine = prints.filter(F.pmod(F.xxhash64("g", "item_id", "item"), F.lit(blocks)) == b) if blocks > 1 else prints
        wanted = bitmap(mine, -(-n // blocks))
        placed = [hits(F.col("w"), wanted, k, span) for k, span in lengths]
        docs = base.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(*placed)).alias("h"))
        part = verified(docs, mine)
        found = part if found is None else found.unionByName(part)
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.collect_set("at")))).cast("long").alias("n_hit"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
        .select(
            F.col("doc_id").alias(id_col), "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated")
        )
    )


def drop_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_sent: int = 200_000, **names) -> DataFrame:
    """Rows of ``df``, all columns, that are not contaminated.

    Up to ``most_sent`` marks of contaminated rows, counted first, are broadcast; more are joined by a shuffle."""
    own = F.col(f"_row.`{text_col}`")
    whole = packed(df).withColumn("_mark", F.struct(F.xxhash64(own), F.length(own)))
    docs = whole.select(F.col("_mark").alias("_id"), own.alias("_text"))
    leaks = stored(find_leaks(docs, items, "_id", "_text", **names).filter("contaminated").select(F.col("_id").alias("_gone")).distinct())
    gone = F.broadcast(leaks) if leaks.count() <= most_sent else leaks
    return whole.join(gone, F.col("_mark") == F.col("_gone"), "left_anti").select("_row.*")
