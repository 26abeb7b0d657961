"""Operator 7, document fingerprints by Order MinHash; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

#: Tokens of a k-mer; orders of a signature. Of each order the two least k-mers are kept in text order.
K, ORDERS = 3, 24
#: K-mers of a block, of which an order remembers the least.
BLOCK = 32
#: Words in runs of at most eight letters or digits, and each other visible character alone, so that scripts without spaces have tokens too.
TOKEN = r"[\p{L}\p{M}\p{N}]{1,8}|[^\s\p{L}\p{M}\p{N}]"
#: A k-mer is one long: 32 bits of hash above 31 bits of place in the text, as many as an array can have.
PLACE = 31
HASH = (1 << 32) - 1


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def high(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(HASH)), PLACE).bitwiseOR(place.cast("long"))


def place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1))


def positions(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def kmers(text: Column, k: int = K) -> Column:
    """array<long>: the text's k-mers as (hash, place), in text order. Fewer than k tokens: one k-mer of them all; none: empty."""

    def joined(h: Column) -> Column:
        starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: packed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w)), joined)


def numbered(x: Column, nth: Column) -> Column:
    """(place, hash) of a k-mer (hash, place) hashed together with its occurrence number."""
    return F.shiftleft(place_of(x), 32).bitwiseOR(F.xxhash64(high(x), nth).bitwiseAND(F.lit(HASH)))


def occurrence_numbered(s: Column) -> Column:
    """The k-mers of s, sorted by hash, each as (place, hash together with its occurrence number in text order).

    In the sorted array a k-mer's occurrences are neighbours. The d-th repeat stands at i; i - d - 1 of the
    first occurrences come before its own, so that one's place gives the number by a look-up.
    """
    again = lambda x, i: (i > 0) & (high(x) == high(F.get(s, i - 1)))
    once = lambda a: F.transform(a, lambda x: numbered(x, F.lit(0)))

    def of(repeats: Column) -> Column:  # places in s of all but the first occurrences
        firsts = let(F.filter(positions(s), lambda i: (i == 0) | (high(F.get(s, i)) != high(F.get(s, i - 1)))), lambda f: F.concat(once(F.transform(f, lambda i: F.get(s, i))), F.transform(repeats, lambda i, d: numbered(F.get(s, i), i - F.get(f, i - d - 1)))))
        return F.when(F.size(repeats) == 0, once(s)).otherwise(firsts)

    marked = F.transform(s, lambda x, i: F.when(again(x, i), i))
    return let(F.array_compact(marked), of)


def in_text_order(text: Column, k: int = K) -> Column:
    """array<long>: 32-bit hashes of all the text's numbered k-mers, as they stand in the text."""
    return F.transform(F.sort_array(let(F.sort_array(kmers(text, k)), occurrence_numbered)), lambda x: x.bitwiseAND(F.lit(HASH)))


def blocks(a: Column) -> Column:
    """array<array<long>>: a's distinct values, as they first stand, in blocks of BLOCK. Equal hashes have equal ranks in every order, so the first of them stands for all."""
    return let(F.array_distinct(a), lambda d: F.when(F.size(d) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / BLOCK).cast("int")), lambda i: F.slice(d, i * BLOCK + 1, BLOCK))).otherwise(F.array().cast("array<array<bigint>>")))


def ranks(block: Column, n: Column) -> Column:
    return F.transform(block, lambda h: F.xxhash64(h, n))


def least(bs: Column, n: Column) -> Column:
    """array<long>: the least rank of each block in order n."""
    return F.transform(bs, lambda b: F.array_min(ranks(b, n)))


def entry(bs: Column, mins: Column, n: Column) -> Column:
    """32 bits of the hash of the two least ranks of all blocks in order n, as they stand in the text. mins: the blocks' least ranks.

    The second is the least of another block or the second of the least one's block, so only that block is gone through again.
    """

    def hashed(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b).bitwiseAND(F.lit(HASH))

    def of(x: Column, block: Column, r: Column) -> Column:  # x: the least; block: the place of its block; r: that block's ranks
        def both(here: Column, there: Column) -> Column:  # the second least of the block, the least of the others
            before = F.when(there.isNull() | (here < there), F.array_position(r, x) < F.array_position(r, here)).otherwise(block < F.array_position(mins, there))
            y = F.least(here, there)
            return F.when(y.isNull(), F.xxhash64(x).bitwiseAND(F.lit(HASH))).when(before, hashed(x, y)).otherwise(hashed(y, x))

        return let(F.array_min(F.array_remove(r, x)), lambda here: let(F.array_min(F.array_remove(mins, x)), lambda there: both(here, there)))

    return let(F.array_min(mins), lambda x: let(F.array_position(mins, x), lambda block: let(ranks(F.get(bs, (block - 1).cast("int")), n), lambda r: of(x, block, r))))


def signature(text: Column, k: int = K, orders: int = ORDERS) -> Column:
    """array<long>: for each of `orders` independent orders of all the text's numbered k-mers 32 bits of the hash of its two least, as they stand in the text. No k-mers: empty."""
    each = lambda bs: F.transform(F.sequence(F.lit(1), F.lit(orders)), lambda n: let(least(bs, n), lambda mins: entry(bs, mins, n)))
    return let(blocks(in_text_order(text, k)), lambda bs: F.when(F.size(bs) > 0, each(bs)).otherwise(F.array().cast("array<bigint>")))


def signatures(a: Column, b: Column, k: int = K, orders: int = ORDERS) -> Column:
    """array of signature(a), signature(b). The blocks that both begin with are ranked once for both, so a text that begins as another one costs its own end."""

    def each(x: Column, y: Column, same: Column) -> Column:
        rest = lambda bs: F.slice(bs, same + 1, F.size(bs))
        empty = F.array().cast("array<bigint>")

        def of(head: Column, x_rest: Column, y_rest: Column) -> Column:
            def pair(n: Column) -> Column:
                one = lambda bs, own: lambda mins: let(F.concat(mins, least(own, n)), lambda all_: F.when(F.size(bs) > 0, entry(bs, all_, n)))
                return let(least(head, n), lambda mins: F.array(one(x, x_rest)(mins), one(y, y_rest)(mins)))

            def split(done: Column) -> Column:
                return F.array(*[F.when(F.size(bs) > 0, F.transform(done, lambda e: F.get(e, F.lit(i)))).otherwise(empty) for i, bs in enumerate((x, y))])

            return let(F.transform(F.sequence(F.lit(1), F.lit(orders)), pair), split)

        return let(F.slice(x, F.lit(1), same), lambda head: let(rest(x), lambda xr: let(rest(y), lambda yr: of(head, xr, yr))))

    def shared(x: Column, y: Column) -> Column:
        """How many blocks both begin with."""
        differ = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True))
        return F.when(differ > 0, differ - 1).otherwise(F.size(x)).cast("int")

    return let(blocks(in_text_order(a, k)), lambda x: let(blocks(in_text_order(b, k)), lambda y: let(shared(x, y), lambda same: each(x, y, same))))


def likeness(a: Column, b: Column) -> Column:
    """The share of orders with equal entries; 1 for two empty signatures, 0 if one is empty."""
    same_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(ORDERS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same_)


def written(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.hex(x)), "."))


#: The least number a doc_id can be stands for a null one as a key, and so comes last.
NO_ID = -(1 << 63)


def followers(texts: DataFrame) -> DataFrame:
    """texts (key, h, n_chars, n) with the next one's (next_key, next_h), descending key; the last one's next is the first.

    Neighbours meet inside range partitions; across partitions only each one's first row is needed.
    """
    order = [F.col("key").desc(), F.col("h").asc()]
    ranges = staged(texts.repartitionByRange(partitions(texts.sparkSession), *order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    w = Window.partitionBy("part").orderBy(*order)
    row = F.struct(F.col("key").alias("key"), F.col("h").alias("h"))
    inside = ranges.select("*", F.lead(row).over(w).alias("next"), F.row_number().over(w).alias("nth"))
    firsts = inside.where("nth = 1").select("part", row.alias("first"))  # a row a partition
    across = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("then"), F.first("first").over(Window.orderBy("part")).alias("very_first"))
    linked = inside.join(F.broadcast(across), "part").withColumn("to", F.coalesce("next", "then", "very_first"))
    return linked.select("key", "h", "n_chars", "n", F.col("to.key").alias("next_key"), F.col("to.h").alias("next_h"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text: empty; texts without tokens have the empty fingerprint, and two of those are alike (1).
    Rows that share a doc_id stand in the order of their text's hash; of equal rows each but the last is followed by an equal
    one. Null doc_id: last, also by text hash. One row: it is its own next. Empty table: no rows. Other columns are dropped.

    Texts are dealt by (doc_id, text hash), so rows without an id do not meet in one task; equal rows are one until the end.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    base = rows.groupBy("key", "h").agg(F.first("text").alias("text"))  # dealt by (key, h) once: both joins below take it as it lies
    counts = rows.select("key", "h", F.length("text").cast("long").alias("n_chars")).groupBy("key", "h").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("n"))
    links = staged(followers(counts), "fingerprint-links")
    # a row for the last of equal rows, whose next is another text, and one for those before it, whose next is their own
    last = links.select("*", F.lit(1).cast("long").alias("copies"))
    earlier = links.where("n > 1").select("key", "h", "n_chars", "n", F.col("key").alias("next_key"), F.col("h").alias("next_h"), (F.col("n") - 1).alias("copies"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = last.unionByName(earlier).select(F.col("key").alias("of_key"), F.col("h").alias("of_h"), "n_chars", "copies", third.alias("third"), "next_key", "next_h")
    heads = base.join(wanted, (F.col("key") == F.col("next_key")) & (F.col("h") == F.col("next_h"))).select("of_key", "of_h", "next_key", "next_h", "n_chars", "copies", "third", F.left("text", F.col("third")).alias("head"))
    whole = base.join(heads, (F.col("key") == F.col("of_key")) & (F.col("h") == F.col("of_h")))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.col("third")).cast("int")), F.col("head"))
    about = ["key", "h", "next_key", "next_h", "n_chars", "copies"]
    both = whole.select(*about, F.array("text", edited).alias("texts"))
    signed = both.select(*about, F.sha2(F.get("texts", F.lit(1)), 256).alias("edited_sha256"), signatures(F.get("texts", F.lit(0)), F.get("texts", F.lit(1))).alias("s"))
    done = staged(signed.select(*about, "edited_sha256", F.col("s")[0].alias("sig"), F.col("s")[1].alias("edited_sig")), "fingerprint-signatures")
    other = done.where((F.col("key") != F.col("next_key")) | (F.col("h") != F.col("next_h")) | (F.col("copies") == 1)).groupBy("key", "h").agg(F.first("sig").alias("next_sig"))
    other = other.select(F.col("key").alias("other_key"), F.col("h").alias("other_h"), "next_sig")
    out = done.join(other, (F.col("next_key") == F.col("other_key")) & (F.col("next_h") == F.col("other_h")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", written(F.col("sig")).alias("fingerprint"), written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
