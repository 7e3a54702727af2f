"""Chunking, shuffling and hierarchical batching of seeds.  Positions are columns, shuffles are orders of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions.hashing import rank_key
from graphlake.functions.store import cut


def number(df: DataFrame, key: Column, out: str = "pos", by: list[str] | None = None, levels: tuple[int, ...] = (2, 4)) -> DataFrame:
    """df with its position in the order of a hexadecimal key, within each group if ``by`` is given.

    The key's prefixes of the given lengths cut the order into ranges of ranges, each numbered apart: rows are ordered among
    those of one longest prefix only, and the counts of ranges among those of one shorter prefix.
    """
    by = by or []
    names = [f"_r{i}" for i in range(len(levels))]
    k = df.withColumn("_key", key).withColumns({n: F.substring(F.col("_key"), 1, d) for n, d in zip(names, levels, strict=True)})
    counts = k.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    befores = []
    for i in reversed(range(len(levels))):
        groups = [*by, *names[:i]]
        w = (Window.partitionBy(*groups) if groups else Window).orderBy(names[i]).rowsBetween(Window.unboundedPreceding, -1)
        befores.insert(0, counts.select(*by, *names[: i + 1], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_b{i}")))
        if i:
            counts = counts.groupBy(*by, *names[:i]).agg(F.sum("_n").alias("_n"))
    before = befores[0]
    for i, finer in enumerate(befores[1:]):
        before = finer.join(before, [*by, *names[: i + 1]])
    before = before.select(*by, *names, sum((F.col(f"_b{i}") for i in range(len(levels))), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, *names).orderBy("_key")) - 1
    placed = k.withColumn("_in", inside).join(before, [*by, *names])
    return placed.withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_key", "_in", "_before", *names)


def shuffle(df: DataFrame, key: str, epoch: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """df with ``pos``: a permutation fixed by seed and epoch, within each group if ``by`` is given."""
    return number(df, rank_key(F.col(key), epoch, seed), "pos", by)


def hex_id(id_: Column, digits: int = 16) -> Column:
    """Zero-padded hexadecimal of a number that is not negative: its order is the number's."""
    return F.lpad(F.hex(id_.cast("bigint")), digits, "0")


def degree_order(degrees: DataFrame) -> DataFrame:
    """(id, deg, pos): positions by descending degree, ties by id.  Nodes of one degree are cut by their ids, so no degree is ordered in one task."""
    key = F.concat(hex_id(F.lit(2**40) - F.col("deg")), hex_id(F.col("id")))
    return number(degrees, key, "pos", levels=(16, 24, 28)).select("id", "deg", "pos")


#: Rows of a range of targets beyond which it is cut by target and source, and how many targets make a range.
EDGE_ROWS, TARGETS = 1 << 21, 8


def edge_order(edges: DataFrame) -> DataFrame:
    """edges with ``pos`` in the order of (dst, src); ids are not negative.

    Ranges of targets are numbered apart, by whole numbers, and what lies before them is a sum over a table with a row for each range, itself in two
    levels.  A range of more than ``EDGE_ROWS`` rows is cut by its targets and their sources' ids, so the list of one target, however long, is not ordered in one task.
    """
    e = edges.withColumn("_a", F.shiftright("dst", TARGETS))
    n = F.count(F.lit(1)).alias("_n")
    wide = cut(e.groupBy("_a").agg(n))
    big = wide.where(F.col("_n") > EDGE_ROWS).select("_a")
    names = ["_a", "_b", "_c"]
    zero = F.lit(0).cast("bigint")
    ranges = wide.select("_a", zero.alias("_b"), zero.alias("_c"), "_n")
    if big.limit(1).count():
        e = e.join(big.withColumn("_big", F.lit(True)), "_a", "left").withColumns({"_b": F.when(F.col("_big"), F.col("dst")).otherwise(0), "_c": F.when(F.col("_big"), F.shiftright("src", 16)).otherwise(0)}).drop("_big")
        ranges = ranges.join(big, "_a", "left_anti").union(e.join(big, "_a", "left_semi").groupBy(*names).agg(n).select(*names, "_n"))
    else:
        e = e.withColumns({"_b": zero, "_c": zero})
    ranges = ranges.withColumn("_top", F.shiftright("_a", 12))
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = ranges.groupBy("_top").agg(F.sum("_n").alias("_n")).select("_top", upto(Window.orderBy("_top")).alias("_t"))
    before = ranges.withColumn("_f", upto(Window.partitionBy("_top").orderBy(*names))).join(tops, "_top").select(*names, (F.col("_t") + F.col("_f")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*names).orderBy("dst", "src")) - 1
    placed = e.withColumn("_in", inside).join(cut(before), names)
    return placed.withColumn("pos", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_in", "_before", *names)


def split_chunk(pos: Column, n: Column | int, size: int, keep: float = 0.0) -> Column:
    """The chunk of a position; null in a tail shorter than size * keep."""
    n = n if isinstance(n, Column) else F.lit(n)
    chunk = F.floor(pos / size)
    tail = (chunk == F.floor(n / size)) & (n % size < size * keep)
    return F.when(tail, None).otherwise(chunk)


def tensor_chunk(pos: Column, n: Column | int, size: int, drop_last: bool = False, quirk: bool = False) -> Column:
    """The chunk of a position.  drop_last: null in a short tail; quirk: also in a full last chunk."""
    n = n if isinstance(n, Column) else F.lit(n)
    chunk = F.floor(pos / size)
    if not drop_last:
        return chunk
    last = F.floor((n - 1) / size)
    gone = (chunk == last) & (F.lit(quirk) | (n % size != 0))
    return F.when(gone, None).otherwise(chunk)


def even_chunk(pos: Column, n: Column | int, size: int) -> Column:
    """The chunk of a position among floor(n / size) chunks, the remainder spread from the front in equal shares; less than size: one chunk.

    With s chunks, a remainder r goes out in shares of t = ceil(r / s): q = r div t chunks have size + t, one has
    size + r mod t, the rest have size.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    s = F.floor(n / size)
    r = n - s * size
    t = F.when(s > 0, F.ceil(r / s)).otherwise(0)
    q = F.when(t > 0, F.floor(r / F.greatest(t, F.lit(1)))).otherwise(0)
    wide = size + t
    over = pos - q * wide
    one = size + r - q * t
    far = F.when(over < one, q).otherwise(q + 1 + F.floor((over - one) / size))
    return F.when(s == 0, 0).when(pos < q * wide, F.floor(pos / wide)).otherwise(far).cast("bigint")


def global_batches(ids: DataFrame, size: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """(batch, pos, id): all seeds shuffled and evenly split."""
    n = ids.count()
    return shuffle(ids.select("id"), "id", epoch, seed).withColumn("batch", even_chunk(F.col("pos"), n, size))


def superblocks(blocks: DataFrame, num_blocks: int, epoch: int, seed: int) -> DataFrame:
    """(block, superblock): blocks in random order, num_blocks of them to one."""
    return shuffle(blocks.select("block").distinct(), "block", epoch, seed).select("block", F.floor(F.col("pos") / num_blocks).alias("superblock"))


def hier_batches(members: DataFrame, num_blocks: int, size: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """(superblock, batch, pos, id) of members(id, block): blocks are shuffled and merged, their seeds shuffled and evenly split."""
    s = members.join(superblocks(members, num_blocks, epoch, seed), "block").select("id", "superblock")
    s = shuffle(s, "id", epoch, seed, ["superblock"])
    sizes = s.groupBy("superblock").agg(F.count(F.lit(1)).alias("n"))
    return s.join(sizes, "superblock").select("superblock", even_chunk(F.col("pos"), F.col("n"), size).alias("batch"), "pos", "id")


def hier_subgraph(edges: DataFrame, members: DataFrame, num_blocks: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """(superblock, src, dst): edges with both ends in one superblock of members(id, block)."""
    s = members.join(superblocks(members, num_blocks, epoch, seed), "block").select("id", "superblock")
    e = edges.select("src", "dst").join(s.select(F.col("id").alias("src"), "superblock"), "src")
    return e.join(s.select(F.col("id").alias("dst"), "superblock"), ["dst", "superblock"]).select("superblock", "src", "dst")


def part_batches(k: int, size: int, spark, epoch: int = 0, seed: int = 0) -> DataFrame:
    """(batch, part, seq): the k parts in random order, evenly split into batches of parts."""
    parts = spark.range(k).select(F.col("id").cast("int").alias("part"))
    return shuffle(parts, "part", epoch, seed).select(even_chunk(F.col("pos"), k, size).alias("batch"), "part", F.col("pos").alias("seq"))


def repeats(df: DataFrame, n: int, out: str = "repeat") -> DataFrame:
    """Every row n times; 0: no rows."""
    return df.withColumn(out, F.explode(F.array(*map(F.lit, range(n))).cast("array<int>")))


def zip_rows(a: DataFrame, b: DataFrame, on: str = "pos") -> DataFrame:
    """Rows of equal position; the shorter side ends the result."""
    return a.join(b, on)


def batch_rows(df: DataFrame, pos: str, value: str, n: int, drop_last: bool = False) -> DataFrame:
    """(batch, items): n consecutive values to a list; drop_last: no shorter last list."""
    out = df.groupBy(F.floor(F.col(pos) / n).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("items"))
    return out.where(F.size("items") == n) if drop_last else out


def unbatch(df: DataFrame, column: str = "items", levels: int = 1) -> DataFrame:
    """Lists back to rows, one or more levels; -1: all of them."""
    while levels and df.schema[column].dataType.typeName() == "array":
        df, levels = df.withColumn(column, F.explode(column)), levels - 1
    return df


def flat_map(df: DataFrame, column: str, fn) -> DataFrame:
    """fn(column) makes an array; each element gets a row and a copy of the other fields."""
    return df.withColumn(column, F.explode(fn(F.col(column))))
