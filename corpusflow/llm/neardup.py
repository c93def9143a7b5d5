"""Operator 7: near-duplicate detection by MinHash with tensored banding.

Two collections of M half-keys, each made of ROWS minhashes, give M * M tables: table (i, j)
has the key (A_i, B_j).  So 2 * M * ROWS minhashes do the work of M * M * 2 * ROWS; a pair of
similarity 0.75 misses every table with probability below 0.001, one of 0.85 below 1e-5.

1. One pass over the texts makes a digest of the shingle set, the half-keys and a sketch of a
   few bits a minhash.  Documents with equal sets are one class from here on, so a group of
   copies costs a row.
2. Half-keys that only one class has are dropped; a class without any shared A or any shared
   B cannot meet another, and most end here.  The keys of the rest are the pairs of their
   shared halves.
3. In each table entry every class is paired with one centre only, the class whose half-keys
   are the most shared; pairs that the sketch does not rule out are verified on the full
   sets.  This joins groups in pairs linear in their size.
4. What remains are pairs of one table entry whose components differ.  The shingles that no other
   class in question has are counted; a class that has too many of its own to be similar to any,
   and a pair of which one has too many for the other, is ruled out exactly.  In entries of many
   classes a pair also needs a shingle that few of them have, or enough of those that many have:
   a group of copies of one text, each too far from it, has neither, so its pairs are not even
   made.  All other pairs are verified, so no link is lost that could change a component.
5. Components come from large-star / small-star rounds on the verified links; every round is
   written to the shared folder.  Nothing but counts reaches the driver.

Steps are stored before they meet themselves, so that no plan holds a chain of joins twice: what the
driver keeps of a plan while it runs grows with the square of its exchanges.

The sketch rules a pair of similarity 0.75 out with probability below 1e-4.

Words are maximal runs without ASCII white space, A-Z lower-cased.  A text of fewer than
``size`` words has its whole sequence as one shingle; one without words (or null) has none,
links with nothing and is kept.  A component is named by its smallest id.  Rows that repeat
an id and a text are in one class and both kept if their id names the component; rows are
the nodes, so an id with two texts does not link them.  A row without an id is kept only if
no row of its component has one; the component is then null.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fields, giving_back, map_rows, packed, stored

SIZE = 5
M = 14
ROWS = 3
SKETCH_BITS = 3
#: Of 2 * M * ROWS * SKETCH_BITS bits, as many may differ; similarity 0.75 differs in 31.5 +- 7.2.
MOST_DIFFERING = 60
MAX_WORDS = 1_000_000
N_HASHES = 2 * M * ROWS
U = np.uint64
FACTORS = np.random.default_rng(20240607).integers(1, 1 << 63, size=N_HASHES, dtype=np.uint64) * U(2) + U(1)
SALTS = np.random.default_rng(5).integers(1, 1 << 63, size=2 * M, dtype=np.uint64)
MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX2
    return x ^ (x >> U(27))


class Shingler:
    """Distinct shingle hashes of texts.  Word hashes are remembered, up to MAX_WORDS of them."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        hashes = [known.get(w) for w in words]
        for i, h in enumerate(hashes):
            if h is None:
                w = words[i]
                hashes[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(hashes, np.uint64)
        size = min(self.size, len(h))
        n = len(h) - size + 1
        acc = np.full(n, U(size), np.uint64)
        for j in range(size):
            acc = mixed(acc * MIX1 + h[j : j + n])
        return np.unique(acc)


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minhashes(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    out = np.full(N_HASHES, ~U(0), np.uint64)
    for at in range(0, len(shingles), block):
        np.minimum(out, (shingles[at : at + block, None] * FACTORS[None, :]).min(0), out=out)
    return out


def half_keys(mins: np.ndarray) -> np.ndarray:
    """2 * M of them; the first M are the A side.  Each is salted by its place."""
    acc = SALTS.copy()
    for part in mins.reshape(2 * M, ROWS).T:
        acc = mixed(acc * MIX1 + part)
    return acc


def sketch(mins: np.ndarray) -> list[int]:
    """SKETCH_BITS bits of each minhash, 21 minhashes to a long."""
    bits = (mins >> U(40)) & U((1 << SKETCH_BITS) - 1)
    shifts = (np.arange(21, dtype=np.uint64) * U(SKETCH_BITS))[None, :]
    return (bits.reshape(-1, 21) << shifts).sum(1).astype(np.int64).tolist()


LONGS = N_HASHES // 21
SCHEMA = "n_shingles long, digest binary, halves array<long>, sketch array<long>"


def describe(df: DataFrame, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """_id with n_shingles, digest, halves and sketch; the last two are empty for sets of one shingle,
    which are only ever similar to equal ones, and all are null for empty sets."""

    schema = fields(SCHEMA)
    names = schema.names

    def start():
        shingler = Shingler(size)

        def kernel(texts):
            rows = []
            for text in texts:
                s = shingler.shingles(text)
                if len(s) < 2:
                    rows.append((len(s), digest(s) if len(s) else None, [], []))
                    continue
                mins = minhashes(s)
                rows.append((len(s), digest(s), half_keys(mins).view(np.int64).tolist(), sketch(mins)))
            return dict(zip(names, zip(*rows))) if rows else {k: [] for k in names}

        return kernel

    return map_rows(df, start, schema, ["_text"], ["_id", *keep])


def digests(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``keep``, text and digest of rows with ``_text``."""

    def start():
        shingler = Shingler(size)
        return lambda texts: {"digest": [digest(shingler.shingles(t)) for t in texts]}

    return map_rows(df.withColumnRenamed("_text", "text"), start, fields("digest binary"), ["text"], [*keep, "text"])


def similar_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (x, y) whose full shingle sets are similar enough."""
    x, y = texts.select(F.col("digest").alias("x"), F.col("text").alias("tx")), texts.select(F.col("digest").alias("y"), F.col("text").alias("ty"))

    def start():
        shingler = Shingler(size)

        def kernel(left, right):
            out, last, own = [], None, None
            for a, b in zip(left, right):
                if a != last:
                    last, own = a, shingler.shingles(a)
                out.append(similar_enough(own, shingler.shingles(b), percent))
            return {"linked": out}

        return kernel

    both = pairs.join(x, "x").join(y, "y")
    return map_rows(both, start, fields("linked boolean"), ["ty", "tx"], ["x", "y"]).filter("linked").select("x", "y")


def postings(texts: DataFrame, size: int) -> DataFrame:
    """(digest, s) for each shingle of the given classes.

    Shingles are told apart by 32 bits: two that fall together only make a set look more shared, which rules out less."""
    schema = pa.schema([("digest", pa.binary()), ("s", pa.int32())])

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.unique((shingler.shingles(text) >> U(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(s), pa.binary()), pa.array(s)], schema=schema)

    return texts.select("digest", "text").mapInArrow(giving_back(run), "digest binary, s int")


def alone(each: DataFrame) -> DataFrame:
    """(digest, alone) of ``postings``: how many shingles no other class has, for classes with any."""
    single = each.groupBy("s").agg(F.count("*").alias("n"), F.min(F.xxhash64("digest")).alias("_c")).filter("n = 1")
    return each.select("digest").distinct().withColumn("_c", F.xxhash64("digest")).join(single.groupBy("_c").agg(F.count("*").alias("alone")), "_c").select("digest", "alone")


def spread(each: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of ``postings``: (digest, common), the number of shingles that more than ``most`` classes have, for classes with any,
    and (digest, s) of the shingles that 2 to ``most`` have."""
    by = each.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    frequent = each.join(by.filter(F.col("n") > most), "s").groupBy("digest").agg(F.count("*").alias("common"))
    return frequent, each.join(by.filter(F.col("n") <= most), "s").select("digest", "s")


def sketches_agree(a: str, b: str) -> Column:
    differing = F.lit(0)
    for i in range(LONGS):
        differing = differing + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return differing <= MOST_DIFFERING


def enough(shared: str, percent: int) -> Column:
    """Whether two sets of the given sizes can be similar enough, if each shares no more than its column ``shared``:
    similarity p % needs p / (100 + p) of both sizes."""
    return F.least(f"{shared}x", f"{shared}y") * (100 + percent) >= (F.col("sizex") + F.col("sizey")) * percent


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of ``links`` (x, y); a component is named by its least node."""
    edges = stored(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.distinct())
        now = mark(after)
        discard(edges)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def find_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = 75, crowded: int = 32, scarce: int = 8,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """For every row: id, n_shingles, component_id, kept and the columns ``keep``.  ``percent`` is 75 or more (lower ones need more tables).

    Entries of more than ``crowded`` classes are paired by shingles that at most ``scarce`` of their classes have; no pair
    depends on either number."""
    if percent < 75:
        raise ValueError("the tables are laid out for a similarity of 0.75 or more")
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    rows = stored(describe(docs, size, keep))
    docs = docs.select("_id", "_text")
    classes = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch")
    )

    # Shared half-keys, and the classes that share one on either side.
    halves = classes.select("digest", F.posexplode("halves").alias("place", "h"))
    shared = halves.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    met = halves.join(shared, "h").groupBy("digest").agg(
        F.collect_list(F.when(F.col("place") < M, F.col("h"))).alias("a"),
        F.collect_list(F.when(F.col("place") >= M, F.col("h"))).alias("b"),
        F.sum("n").alias("weight"),
    )
    alive = stored(met.filter("size(a) > 0 and size(b) > 0").join(classes.select("digest", "first_id", F.col("n").alias("size"), "sketch"), "digest"))
    keys = (
        alive.select("digest", "weight", F.explode("a").alias("a"), "b")
        .select("digest", "weight", "a", F.explode("b").alias("b"))
        .select("digest", "weight", F.xxhash64("a", "b").alias("key"))
    )
    centres = keys.groupBy("key").agg(F.max(F.struct("weight", "digest")).alias("c"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("c.digest").alias("y"))
    sketches = lambda side: alive.select(F.col("digest").alias(side), F.col("sketch").alias(f"s{side}"))
    stars = keys.select(F.col("digest").alias("x"), "key").join(centres, "key").filter("x <> y").select("x", "y").distinct()
    stars = stored(stars.join(sketches("x"), "x").join(sketches("y"), "y").filter(sketches_agree("sx", "sy")).select("x", "y"))

    # Texts of the classes that can have a partner, written once.  An id may occur with several texts: only the one of the class counts.
    wanted = alive.select("digest", F.col("first_id").alias("_id"))
    named_texts = digests(wanted.filter("_id is not null").withColumnRenamed("digest", "_of").join(docs, "_id"), ["_of"], size)
    nameless = digests(docs.filter("_id is null"), [], size).join(wanted.filter("_id is null").select("digest"), "digest", "left_semi")
    texts = named_texts.filter("digest = _of").select("digest", "text").unionByName(nameless.select("digest", "text"))
    texts = stored(texts.groupBy("digest").agg(F.min("text").alias("text")))

    links = stored(verified(stars, texts, size, percent))
    first = stored(components(links))
    # Entries whose members are still in different components.
    placed = alive.select("digest", "a", "b").join(first.withColumnRenamed("node", "digest"), "digest", "left")
    placed = placed.select("digest", F.coalesce("component", "digest").alias("component"), F.explode("a").alias("a"), "b")
    placed = placed.select("digest", "component", "a", F.explode("b").alias("b")).select("digest", "component", F.xxhash64("a", "b").alias("key"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
    still = stored(placed.join(open_keys.select("key", "members"), "key"))
    each = stored(postings(texts.join(still.select("digest").distinct(), "digest", "left_semi"), size))
    able = alive.select("digest", "size", "sketch", "a", "b").join(alone(each), "digest", "left")
    likely = stored(able.withColumn("met", F.col("size") - F.coalesce("alone", F.lit(0))).filter(F.col("met") * 100 >= F.col("size") * percent))
    crowd = still.filter(F.col("members") > crowded).select("digest").distinct().join(likely, "digest", "left_semi")
    dense = stored(each.join(crowd, "digest", "left_semi"))
    common, rare = spread(dense, scarce)
    able = stored(likely.join(common, "digest", "left").select("digest", "size", "sketch", "a", "b", "met", F.coalesce("common", F.lit(0)).alias("common")))

    def side(df: DataFrame, k: str, on: str) -> DataFrame:
        return df.select(on, *[F.col(c).alias(c + k) for c in df.columns if c != on])

    def paired(rows: DataFrame, on: str, condition: Column) -> DataFrame:
        """Pairs of rows of ``rows`` (of ``still`` and ``able``) with equal ``on`` that may be links of two components."""
        # What two sets have in common is at most what each has in common with any other.
        apart = (F.col("componentx") != F.col("componenty")) & (F.col("digestx") < F.col("digesty"))
        both = side(rows, "x", on).join(side(rows, "y", on), on)
        return both.filter(apart & enough("met", percent) & condition & sketches_agree("sketchx", "sketchy")).select(F.col("digestx").alias("x"), F.col("digesty").alias("y"))

    # A pair comes from one table only, that of its least common halves.
    home = F.col("key") == F.xxhash64(F.array_min(F.array_intersect("ax", "ay")), F.array_min(F.array_intersect("bx", "by")))
    # In a crowded entry two sets share a scarce shingle, or frequent ones alone must be enough.
    sparse = F.col("members") <= crowded
    largest = F.col("common") * F.lit((100 + percent) / percent) - F.col("size")  # the largest set that frequent shingles can be enough for
    open_rows = stored(still.join(able, "digest").filter(sparse | (largest >= F.col("size") * F.lit(percent / 100))))
    by_key = paired(open_rows, "key", home & ((F.col("membersx") <= crowded) | enough("common", percent)))
    scarce_rows = stored(rare.join(still.select("digest", "component").dropDuplicates(["digest"]).join(able.drop("a", "b"), "digest"), "digest"))
    by_shingle = paired(scarce_rows, "s", F.lit(True))
    met_again = by_key.unionByName(by_shingle)
    tried = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    rest = stored(met_again.distinct().join(tried, ["x", "y"], "left_anti"))
    links_again = stored(verified(rest, texts, size, percent))
    discard(still, each, likely, dense, able, open_rows, scarce_rows, rest, texts, stars, links)

    # The components of the first links stand for them.
    last = first
    if not links_again.isEmpty():
        last = stored(components(first.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(links_again)))
    members = last.withColumnRenamed("node", "digest").join(alive.select("digest", "first_id"), "digest")
    named = members.groupBy("component").agg(F.min("first_id").alias("named"))
    linked = stored(members.join(named, "component").select("digest", "named"))
    every = classes.select("digest", "first_id").join(linked, "digest", "left").select("digest", F.coalesce("named", "first_id").alias("component_id"))
    return (
        rows.select("_id", "n_shingles", "digest", *keep)
        .join(every, "digest", "left")
        .select("_id", "n_shingles", *keep, F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
        .select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), *keep)
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, whose id is the smallest of its group.

    Decided by id and text, so of an id with several texts only those go that another document repeats."""
    own, text = F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")
    whole = packed(df).withColumn("_mark", F.xxhash64(text))
    found = find_near_duplicates(whole.select(own.alias("_key"), text.alias("_text"), "_mark"), "_key", "_text", keep=("_mark",))
    gone = found.filter("not kept").select("_key", F.col("_mark").alias("_gone")).distinct()
    return whole.join(gone, own.eqNullSafe(F.col("_key")) & (F.col("_mark") == F.col("_gone")), "left_anti").select("_row.*")
