"""Bus packets: parsing of dump lines, bits and transitions, gaps by key, bit features, Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.windows import in_blocks

LINE = r"^\((\d+\.\d+)\)\s+(\S+)\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*)$"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, iface, id, data, packet, bits) of dump lines; hex data of odd length gets a zero to the left; other lines are left out."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    rows = lines.filter(F.col(column).rlike(LINE)).select(part(1).cast("decimal(20,6)").alias("ts"), part(2).alias("iface"), part(3).alias("id"), part(4).alias("data"))
    rows = rows.withColumn("data", F.when(F.length("data") % 2 == 1, F.concat(F.lit("0"), "data")).otherwise(F.col("data")))
    return rows.withColumn("packet", F.concat("id", "data")).withColumn("bits", bits(F.col("data")))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def bits(hexes: Column) -> Column:
    """Four binary digits for each hex digit, 0000 for any other character."""
    digit = lambda c: F.when(c.rlike("^[0-9A-Fa-f]$"), F.lpad(F.conv(c, 16, 2), 4, "0")).otherwise(F.lit("0000"))
    return F.when(F.length(hexes) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(hexes)), lambda i: digit(F.substr(hexes, i, F.lit(1)))), ""))


#: Codes of the transitions between no signal, 0 and 1 (fixed values).
TRANSITIONS = {"**": 0, "*0": 1, "0*": 2, "*1": 3, "1*": 4, "00": 5, "01": 6, "10": 7, "11": 8}


def transitions(bit_string: Column) -> Column:
    """The code of each character of a string of ``*01`` after the one before it, no signal at first."""
    table = F.create_map(*[F.lit(x) for kv in TRANSITIONS.items() for x in kv])
    line = F.concat(F.lit("*"), bit_string)
    return F.when(F.length(bit_string) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(bit_string)), lambda i: F.element_at(table, F.substr(line, i, F.lit(2)))))


def stream_transitions(packets: DataFrame, data: str = "bits", size: int = 65_536) -> DataFrame:
    """(series, idx, codes): transitions of a stream of packets (series, idx, bits); the first character follows the last one of the packet before."""
    ready = in_blocks(packets, 1, 0, lambda d, w: d.withColumn("_last", F.coalesce(F.right(F.lag(data).over(w), F.lit(1)), F.lit("*"))), size)
    table = F.create_map(*[F.lit(x) for kv in TRANSITIONS.items() for x in kv])
    line = F.concat("_last", data)
    codes = F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.element_at(table, F.substr(line, i, F.lit(2)))))
    return ready.select("series", "idx", codes.alias("codes"))


def gaps(packets: DataFrame, key: str = "key", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, gap, ts): seconds from each packet of a key to the one before it.

    A key's packets are ordered within days; the first one of a day takes the last time of the day before, from a table of one row for
    each key and day, so a chatty key is not one task.
    """
    rows = packets.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).alias("_order"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.date_trunc("day", F.col(ts)).alias("_day"))
    ends = rows.groupBy("key", "_day").agg(F.max("_us").alias("_end"))
    before = ends.select("key", "_day", F.lag("_end").over(Window.partitionBy("key").orderBy("_day")).alias("_before"))
    inside = F.lag("_us").over(Window.partitionBy("key", "_day").orderBy("ts", "_order"))
    same = rows.withColumn("_inside", inside).join(before.withColumnsRenamed({"key": "_k", "_day": "_d"}), F.col("key").eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d")))
    return same.select("key", ((F.col("_us") - F.coalesce("_inside", "_before")) / 1e6).alias("gap"), "ts")


def gap_and_size(packets: DataFrame, key: str, size: Column, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, n, mean, std, low, high, size_mean, size_std, size_low, size_high, r): gaps in microseconds, sizes of the packets before them, and their correlation."""
    sized = packets.withColumn("_size", size)
    w = Window.partitionBy(key, F.date_trunc("day", F.col(ts))).orderBy(ts, order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = sized.withColumns({"_us": us, "_last": F.lag(us).over(w), "_prev": F.lag("_size").over(w), "_day": F.date_trunc("day", F.col(ts))})
    ends = rows.groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d")).agg(F.max_by(F.struct("_us", "_size"), F.struct(F.col(ts), F.col(order))).alias("_end"))
    before = ends.withColumn("_e", F.lag("_end").over(Window.partitionBy("_k").orderBy("_d"))).select("_k", "_d", "_e")
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d")))
    pairs = joined.select(F.col(key).alias("key"), F.abs(F.col("_us") - F.coalesce("_last", "_e._us")).cast("double").alias("g"), F.coalesce("_prev", "_e._size").cast("double").alias("s")).filter("g is not null")
    four = lambda c, p: [F.avg(c).alias(f"{p}mean"), F.stddev_pop(c).alias(f"{p}std"), F.min(c).alias(f"{p}low"), F.max(c).alias(f"{p}high")]
    return pairs.groupBy("key").agg((F.count("*") + 1).alias("n"), *four("g", ""), *four("s", "size_"), F.corr("g", "s").alias("r"))


def gap_statistics(packets: DataFrame, key: str = "key") -> DataFrame:
    """(key, n, prob, mean, std): share of all packets; mean and deviation of the gaps of keys with over two packets."""
    total = packets.agg(F.count("*").alias("total"))
    stats = gaps(packets, key).groupBy("key").agg(F.count("*").alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    many = F.col("n") > 2
    return stats.join(F.broadcast(total)).select("key", "n", F.round(F.col("n") / F.col("total"), 5).alias("prob"), F.when(many, F.round("m", 2)).alias("mean"), F.when(many, F.round("s", 2)).alias("std"))  # one row


def gap_histogram(packets: DataFrame, key: str = "key", least: int = 20, bins: int = 10) -> DataFrame:
    """(key, bin, n): equal bins from the smallest gap to the largest, for keys with more than least packets."""
    many = packets.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select("key")
    return histogram(gaps(packets, key).filter("gap is not null").join(many, "key", "left_semi"), bins)


def histogram(values: DataFrame, bins: int = 10, key: str = "key", value: str = "gap") -> DataFrame:
    """(key, bin, n), empty bins included; if all values are one it is in the middle of a range of width 1."""
    ends = values.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    place = F.when(F.col("_a") == F.col("_b"), bins // 2).otherwise(F.least(F.floor((F.col(value) - F.col("_a")) / ((F.col("_b") - F.col("_a")) / bins)), F.lit(bins - 1))).cast("int")
    counts = values.join(ends, key).groupBy(key, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [key, "bin"], "left").fillna(0, ["n"])


def bit_features(packets: DataFrame, chunk: int, width: int = 64, key: str = "id", data: str = "data", binary: bool = False) -> DataFrame:
    """(id, chunk, pos, prb): share of packets with a bit set, by id, full chunk of idx and bit position up to width.

    One aggregate sums a column for each position; the rows are made of it afterwards.
    """
    chunked = packets.select(F.col(key).alias("id"), F.floor(F.col("idx") / chunk).alias("chunk"), bits(F.col(data)).alias("_bits"))
    full = chunked.groupBy("chunk").agg(F.count("*").alias("_n")).filter(F.col("_n") == chunk).select("chunk")
    ones = [F.sum((F.substr("_bits", F.lit(i + 1), F.lit(1)) == "1").cast("long")).alias(f"_{i}") for i in range(width)]
    sums = chunked.join(full, "chunk", "left_semi").groupBy("id", "chunk").agg(F.count("*").alias("_n"), F.max(F.length("_bits")).alias("_w"), *ones)
    each = sums.select("id", "chunk", "_n", F.posexplode(F.slice(F.array(*[f"_{i}" for i in range(width)]), F.lit(1), F.least(F.col("_w"), F.lit(width)))).alias("pos", "ones"))
    share = F.col("ones") / F.col("_n")
    return each.select("id", "chunk", "pos", (F.when(share >= 0.5, 1.0).otherwise(0.0) if binary else share).alias("prb"))


def bloom_size(bits_: int, rate: float) -> int:
    """Items that a filter of so many bits holds at a false-positive rate."""
    return int(-bits_ * math.log(2) ** 2 / math.log(rate))


def bloom_hashes(bits_: int, items: int) -> int:
    return max(1, int(bits_ / max(items, 1) * math.log(2)))


def bloom_bits(items: int, rate: float, k: int) -> int:
    """Bits of a filter that holds so many items with k hashes at a false-positive rate."""
    return math.ceil(-k * items / math.log1p(-(rate ** (1 / k))))


def _positions(item: Column, bits_: int, k: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(item, F.lit(i)), F.lit(bits_)) for i in range(k)]))


#: Bits of one word of a filter's bitmap, and bytes of a bitmap that may be broadcast.
WORD, BROADCAST_BYTES = 1 << 15, 64 << 20


def bloom(items: DataFrame, item: str, bits_: int, k: int) -> DataFrame:
    """(word, bitmap): the bits that the items set, in bitmaps of WORD bits; bits meet as numbers once, combined before the shuffle."""
    at = items.select(F.explode(_positions(F.col(item), bits_, k)).alias("bit")).distinct()
    return at.groupBy(F.floor(F.col("bit") / WORD).alias("word")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(WORD))).alias("bitmap"))


def bloom_check(candidates: DataFrame, item: str, filter_: DataFrame, bits_: int, k: int) -> DataFrame:
    """(item, member): whether all bits of each distinct candidate are set; false positives are members.

    The filter has bits_ / 8 bytes, known beforehand: up to BROADCAST_BYTES its bitmaps are broadcast, beyond that they are joined by a shuffle.
    """
    asked = candidates.select(F.col(item).alias("item")).distinct().withColumn("at", _positions(F.col("item"), bits_, k))
    byte = lambda bitmap, bit: F.conv(F.hex(F.substr(bitmap, (F.floor(F.pmod(bit, F.lit(WORD)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    isset = lambda bitmap, bit: F.coalesce(F.expr("1").bitwiseAND(F.call_function("shiftright", byte(bitmap, bit), F.pmod(bit, F.lit(8)).cast("int"))) == 1, F.lit(False))
    if bits_ // 8 <= BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    each = asked.select("item", F.size("at").alias("need"), F.explode("at").alias("bit"))
    found = each.join(filter_, F.floor(F.col("bit") / WORD) == F.col("word")).filter(isset(F.col("bitmap"), F.col("bit")))
    hits = found.groupBy("item", "need").agg(F.count("*").alias("got")).filter("got = need").select("item", F.lit(True).alias("member"))
    return asked.select("item").join(hits, "item", "left").fillna(False, ["member"])


def bloom_members(candidates: DataFrame, items: DataFrame, item: str, bits_: int, k: int) -> DataFrame:
    """(item, member): whether each distinct candidate is one of the items; those that their filter lets pass are looked up among the items themselves."""
    checked = bloom_check(candidates, item, bloom(items, item, bits_, k), bits_, k)
    sure = items.select(F.col(item).alias("_i")).distinct()
    return checked.join(sure, (F.col("item") == F.col("_i")) & F.col("member"), "left").select("item", F.col("_i").isNotNull().alias("member"))
