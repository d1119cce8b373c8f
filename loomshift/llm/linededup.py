"""Line deduplication by an exact set-similarity join, with DataFrame operations only.

A line is the set of its words, put in one order over the whole corpus: rarest first. Two sets of Jaccard similarity t or
more share one of their first words, as many as they may differ in and one more. Lines of equal sets are one class. Candidate
classes come in two steps: each class against the earliest class of each of its very first words, which settles groups of
near copies in a few comparisons a member; then those still standing against all classes that share one of their first
words. Length and position filters and the parities of the sets thin both before anything is shuffled again, the words
themselves decide, and the later of two matching classes is removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_SQL, cut, delete_path, numbered, scratch, tidy_shuffles

#: Counters of words, how many of them a driver row holds, and the steps to a doubling that rarity tells apart.
COUNTERS, ROW, STEPS = 1 << 18, 1 << 9, 2
#: A rank has 6 bits of rarity above these bits of the word's hash.
HASH_BITS = 57
#: Sets of so many words have parities of 128 bits, smaller ones of 64.
LONG = 64
#: By how many of its very first words a class leads others in the first step, and by how many it looks for a leader. Copies
#: with rare words of their own have the shared ones further back.
LEADS, LOOKS = 2, 6
OTHER_BLANKS = "[\\x09-\\x0D]"
SLACK = 1e-9


def parts_of(line: Column) -> Column:
    """The words of a line, repeats and empty ones included; the plain split where no blank is anything but a space."""
    return F.when(line.rlike(OTHER_BLANKS), F.split(line, SPACE_SQL)).otherwise(F.split(line, " "))


def words_of(line: Column) -> Column:
    return F.array_remove(parts_of(line), "")


def counter_of(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(COUNTERS - 1).cast("long"))


def constant(numbers: list[int]) -> Column:
    """An array of longs that the optimizer folds."""
    return F.from_json(F.lit(str(numbers).replace(" ", "")), "array<bigint>")


def characters(marks: DataFrame) -> str:
    """One character for each counter, from (at, mark) with one mark a counter. The driver reads COUNTERS / ROW rows."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "mark"))), lambda x: x["mark"])
    rows = marks.groupBy(F.shiftright("at", int(math.log2(ROW))).alias("row")).agg(F.array_join(in_order, "").alias("marks")).collect()
    return "".join(r["marks"] for r in sorted(rows, key=lambda r: r["row"]))


def counted(counts: DataFrame) -> DataFrame:
    """(at, n) of every counter, from counts (at, n) of some."""
    every = counts.sparkSession.range(0, COUNTERS, 1, 8).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("n"))
    return counts.union(every).groupBy("at").agg(F.sum("n").alias("n"))


def rarity(docs: DataFrame) -> Column:
    """A constant array: by a word's counter, its rarity.

    Counted over all texts. Words of one hash share a counter, and what other blanks than spaces and line ends part counts
    as one word: that makes the order of words rougher, but any order gives an exact join. The number of counters is fixed,
    and the driver holds one character for each.
    """
    spaced = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    counts = docs.select(F.explode(spaced).alias("word")).groupBy(counter_of(F.xxhash64("word")).alias("at")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(63), F.floor(F.log2(F.col("n") + 1) * STEPS)).cast("int")
    spark, room = docs.sparkSession, "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(room)
    spark.conf.set(room, str(int(math.log2(COUNTERS)) + 1))  # all counters in the fast map of an aggregation
    try:
        marks = characters(counted(counts).select("at", F.char(level + 33).alias("mark")))
    finally:
        spark.conf.set(room, before)
    return constant([ord(c) - 33 for c in marks])


def among(places: DataFrame) -> Column:
    """A condition that holds for (doc, row) of places, and for few others while these are few: its size is fixed."""
    marks = counted(places.groupBy(counter_of(F.xxhash64("doc", "row")).alias("at")).agg(F.count("*").alias("n")))
    given = characters(marks.select("at", F.when(F.col("n") > 0, "1").otherwise("0").alias("mark"))).encode()
    return F.substring(F.lit(given), counter_of(F.xxhash64("doc", "row")).cast("int") + 1, 1) == F.lit(b"1")


def line_classes(docs: DataFrame, levels: Column, threshold: float) -> DataFrame:
    """The first line of each set of words, the empty one included: (doc, row, line, size, first, both, odd).

    first: the ranks of which two similar sets share one. both: how many words are in each of 64 groups, modulo two. odd: how
    many of these are in the other half of their group, 0 for sets of less than LONG words. Sets are told apart by 128 bits
    of hash over the 63 bits of their words' ranks.
    """
    lines = docs.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    # Functions of arrays interpret what they do with each word: every operation that they are spared tells. So words become
    # hashes first and only different ones are ranked, as longs without nulls, which are sorted as such.
    hashes = F.array_remove(F.array_distinct(F.transform(parts_of(F.col("raw")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    rank = lambda h: F.shiftleft(F.coalesce(levels[counter_of(h)], F.lit(0)), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    sets = lines.select("doc", "row", "line", F.sort_array(F.transform(hashes, rank)).alias("ranked"))
    bits = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    parity = lambda of: F.aggregate("ranked", F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(of[w.bitwiseAND(F.lit(127).cast("long"))]))
    size = F.size("ranked")
    both, odd = parity(constant(bits + bits)), F.when(size < LONG, F.lit(0).cast("long")).otherwise(parity(constant([0] * 64 + bits)))
    first = F.slice("ranked", F.lit(1), size - F.ceil(F.lit(threshold) * size - SLACK).cast("int") + 1)
    columns = [size.alias("size"), F.xxhash64("ranked").alias("h1"), F.xxhash64(F.lit(7), "ranked").alias("h2"), first.alias("first"), both.alias("both"), odd.alias("odd")]
    order = Window.partitionBy("h1", "h2", "size").orderBy("doc", "row", "line")
    return sets.select("doc", "row", "line", *columns).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "h1", "h2")


def prefixes(classes: DataFrame, threshold: float, *columns: str, id: str = "id", most: int | None = None) -> DataFrame:
    """One row for each first word (or each of the ``most`` very first) of the classes that may resemble any other."""
    able = classes.where(F.floor(F.col("size") / F.lit(threshold) + SLACK) > F.col("size"))
    first = F.col("first") if most is None else F.slice("first", 1, most)
    return able.select(F.posexplode(first).alias("pos", "word"), id, "size", "both", "odd", *columns)


def alike(y: str, x: str, threshold: float) -> Column:
    """What rows y and x of one word must meet if their sets are similar and the word is the first that both have."""
    of = lambda side, name: F.col(f"{side}.{name}")
    sizes = of(y, "size") + of(x, "size")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * sizes - SLACK)
    length = F.least(of(y, "size"), of(x, "size")) >= F.lit(threshold) * F.greatest(of(y, "size"), of(x, "size")) - SLACK
    position = F.least(of(y, "size") - of(y, "pos"), of(x, "size") - of(x, "pos")) >= need
    odd, both = (of(y, c).bitwiseXOR(of(x, c)) for c in ("odd", "both"))
    # A word that only one set has changes one group.
    differ = F.when(F.least(of(y, "size"), of(x, "size")) < LONG, F.bit_count(both)).otherwise(F.bit_count(odd) + F.bit_count(odd.bitwiseXOR(both)))
    return length & (differ <= sizes - 2 * need) & position


def flags_of(lines: Column) -> Column:
    """A sorted array of line numbers as bytes: the byte of a line that is listed is 1. Looking one up takes no search."""
    gap = lambda n, k: n - F.when(k > 0, F.get(lines, k - 1)).otherwise(F.lit(-1)) - 1
    return F.array_join(F.transform(lines, lambda n, k: F.concat(F.repeat(F.lit("0"), gap(n, k)), F.lit("1"))), "").cast("binary")


def flagged(flags: str, line: Column) -> Column:
    return F.substring(F.col(flags), line + 1, F.lit(1)) == F.lit(b"1")


def meeting(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the classes (with ``gone``: settled before) that may be similar, but for pairs of two settled ones.

    Both sides are one shuffle: nothing in the condition tells of one side alone. key: the id, below zero if settled.
    """
    key = F.coalesce(F.when(F.col("gone"), -1 - F.col("id")).otherwise(F.col("id")), F.lit(-1).cast("long"))  # never null
    rows = prefixes(classes.withColumn("key", key).drop("id"), threshold, id="key")
    ahead = F.col("y.key") > F.greatest(F.col("x.key"), F.lit(-1).cast("long"))
    met = rows.alias("y").join(rows.alias("x"), (F.col("y.word") == F.col("x.word")) & ahead & alike("y", "x", threshold))
    return met.select(F.col("y.key").alias("a"), F.when(F.col("x.key") < 0, -1 - F.col("x.key")).otherwise(F.col("x.key")).alias("b")).distinct()


def among_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, doc, row, line) of the classes that are in pairs (a, b)."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return classes.select("id", "doc", "row", "line").join(ids, "id", "left_semi")


def removed(docs: DataFrame, places: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(id) of the later class of each pair (a, b) of which the words have a similarity of the threshold or more.

    places: (id, doc, row, line) of the classes in pairs, each once.
    """
    places = cut(places)
    wanted = places.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("line", "id"))).alias("wanted"))
    wanted = wanted.withColumn("lines", F.transform("wanted", lambda x: x["line"])).select("doc", "row", "wanted", flags_of(F.col("lines")).alias("flags"))
    texts = docs.where(among(places)).join(wanted, ["doc", "row"])
    raw = F.filter(F.split("text", "\n"), lambda _, k: flagged("flags", k))
    one = texts.select("doc", "row", F.explode(F.arrays_zip(F.col("wanted"), raw.alias("raw"))).alias("x"))
    place = F.struct("doc", "row", F.col("x.wanted.line").alias("line"))
    sets = cut(one.select(F.col("x.wanted.id").alias("id"), place.alias("place"), F.array_distinct(words_of(F.col("x.raw"))).alias("words")))
    side = lambda s: sets.select(F.col("id").alias(s), F.struct("place", "words").alias(f"of_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("of_a.words", "of_b.words"))
    sure = both >= F.lit(threshold) * (F.size("of_a.words") + F.size("of_b.words") - both) - SLACK
    return met.where(sure).select(F.when(F.col("of_a.place") > F.col("of_b.place"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def kept_lines(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc, row, line) of the lines with words that stay, for docs (doc, row, text) without nulls: of each set the first
    line, if no earlier line's set resembles it. Lines stand in order of doc, row and place."""
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        path = scratch(spark, "line-classes")
        line_classes(docs, rarity(docs), threshold).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
        classes = spark.read.parquet(path).where("id is not null and size > 0")
        place = F.struct("doc", "row", "line")
        rows = prefixes(classes.withColumn("place", place), threshold, "place", most=LEADS)
        leaders = rows.groupBy("word").agg(F.min(F.struct("place", "id", "size", "pos", "both", "odd")).alias("x"))
        looking = prefixes(classes.withColumn("place", place), threshold, "place", most=LOOKS)
        led = looking.alias("y").join(leaders.alias("leaders"), "word").where((F.col("x.place") < F.col("y.place")) & alike("y", "x", threshold))
        led = cut(led.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.col("y.place").alias("at_a"), F.col("x.place").alias("at_b")).distinct())
        places = led.select(F.col("a").alias("id"), "at_a.*").union(led.select("b", "at_b.*")).distinct()
        gone = cut(removed(docs, places, led.select("a", "b"), threshold))
        # The classes that are left meet each other and those that are settled.
        marked = classes.join(gone.withColumn("gone", F.lit(True)), "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        pairs = cut(meeting(marked, threshold))
        late = cut(removed(docs, among_pairs(classes, pairs), pairs, threshold))
        kept = cut(classes.join(gone.union(late), "id", "left_anti").select("doc", "row", "line"))
        delete_path(spark, path)
    return kept


def line_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with the later of similar lines taken out of text, and with n_lines and n_removed_lines.

    Lines are parted by \\n; a word is a run of other characters than the six ASCII blanks. Lines without words always stay.
    A text that loses all its lines becomes empty; null texts and rows without doc_id stay as they are and remove nothing.
    Rows that share a doc_id stand in an order by a hash of their texts; of rows with equal doc_id and text only one keeps
    lines with words, the first by its other columns. Columns named like the added ones are replaced; any other names are
    fine. An empty table gives an empty result, and lines may be of any length.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed_lines")]
    rows = numbered(docs, columns, F.col("doc_id").try_cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    field = {c: F.col(f"c{k}").alias(c) for k, c in enumerate(columns)}
    rows = rows.withColumn("row", F.xxhash64("text"))
    able = rows.where("doc is not null and text is not null").select("doc", "row", "text")
    stays = kept_lines(able, threshold).groupBy("doc", "row").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    joined = rows.join(stays.select("doc", "row", flags_of(F.col("lines")).alias("flags")), ["doc", "row"], "left")
    again = lambda *key: not able.groupBy(*key).count().where("count > 1").isEmpty()
    if again("doc") and again("doc", "row"):
        other = F.to_json(F.struct(*(x for c, x in field.items() if c.lower() != "text")))
        copy = F.row_number().over(Window.partitionBy("doc", "row").orderBy(other))
        joined = joined.withColumn("flags", F.when(F.col("doc").isNull() | (copy == 1), F.col("flags")))
    wordless = lambda x: ~x.rlike("[^\\x20\\x09-\\x0D]")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, k: F.coalesce(flagged("flags", k), F.lit(False)) | wordless(x))
    named = joined.select(*(f"c{k}" for k, c in enumerate(columns) if c.lower() != "text"), lines.alias("lines"), F.when(F.col("doc").isNull(), lines).otherwise(left).alias("left"))
    n_lines, n_left = (F.coalesce(F.size(c), F.lit(0)) for c in ("lines", "left"))
    return named.select(*(F.array_join("left", "\n").alias(c) if c.lower() == "text" else field[c] for c in columns), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_removed_lines"))
