"""What the operators share: the word rule, scratch tables, size-checked joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.session import new_folder, ship

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of narrow rows (tens of bytes) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of arrays and texts up to which a side is broadcast.
BROADCAST_BYTES = 64_000_000
#: A key is split from so many rows on, and from one HOT_KEYSth of all rows: hence no more than HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that lost executors cost nothing.

    Tables that later steps replace are dropped at once; the rest go when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = new_folder(spark, name)
        self._n = 0

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._daytrace_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        where, fs = self._fs(df._daytrace_path)
        fs.delete(where, True)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, but for those with maps and variants, which can't be hashed."""
    return F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t])


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None, limit: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Join that broadcasts ``right`` if it has at most ``limit`` rows (counted unless given), else shuffles.

    Where rows hold arrays or texts, ``size`` is their length in bytes, and BROADCAST_BYTES bounds the sum as well.
    """
    total = 0
    if rows is None:
        rows, total = right.agg(F.count("*"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))).first()
    return left.join(F.broadcast(right) if rows <= limit and total <= BROADCAST_BYTES else right, on, how)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], scratch: Scratch, how: str = "inner", size: Column | None = None) -> DataFrame:
    """Join of ``left`` with ``right``, which is unique per key and has in ``c`` how many rows of ``left`` the key has.

    A small ``right`` is broadcast. Otherwise rows of ``left`` whose key has many are dealt over several tasks by a hash
    of their columns, and the key's row of ``right`` is sent to each of these: from HOT_ROWS rows and one HOT_KEYSth of
    all, so there are at most HOT_KEYS such keys. ``on`` holds no nulls; ``c`` is not in the result.
    """
    right = scratch.write(right)
    rows, total, fat = right.agg(F.count("*"), F.sum("c"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and fat <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop("c")), on, how)
    parts = F.ceil(F.col("c") / HOT_ROWS).cast("int")
    is_hot = F.col("c") > max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(right.where(is_hot).select(*on, parts.alias("_parts")))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(row_hash(left), F.col("_parts"))).otherwise(0).cast("int")
    dealt = left.join(hot, on, "left").withColumn("_salt", salt).drop("_parts")
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, parts).otherwise(1) - 1))).drop("c")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


class Salt:
    """Splits a key between wide rows, unique per key, and the many rows that they are joined to.

    A key of more than HOT_ROWS rows (and one HOT_KEYSth of all) is dealt over several tasks, and its one wide row is sent
    to each of these. Join ``deal(left)`` with ``copies(right)`` on the key and the salt's name.
    """

    def __init__(self, left: DataFrame, key: str, scratch: Scratch):
        self.key, self.name, self._parts = key, f"_salt_{key}", f"_parts_{key}"
        limit = max(HOT_ROWS, left.count() // HOT_KEYS)
        counts = left.groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") > limit)
        self.hot = F.broadcast(scratch.write(counts.select(key, F.ceil(F.col("_c") / HOT_ROWS).cast("int").alias(self._parts))))

    def deal(self, left: DataFrame) -> DataFrame:
        at = F.when(F.col(self._parts).isNotNull(), F.pmod(row_hash(left), F.col(self._parts))).otherwise(0).cast("int")
        return left.join(self.hot, self.key, "left").withColumn(self.name, at).drop(self._parts)

    def copies(self, right: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0), F.coalesce(self._parts, F.lit(1)) - 1)
        return right.join(self.hot, self.key, "left").withColumn(self.name, F.explode(every)).drop(self._parts)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (id, component) with the smallest id reachable, for every id on an edge.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"):
    every step is a minimum per node and a join that splits hubs, and rows never exceed the edges; ends when nothing
    changes.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = scratch.write(ends)
    rows, seen = now.count(), None
    while True:
        # a minimum per node is broadcast where the edges are few enough for it, by their count
        few = 2 * rows <= BROADCAST_ROWS
        meet = lambda left, low: left.join(F.broadcast(low.drop("c")), "u") if few else join_counted(left, low, ["u"], scratch)  # noqa: B023, E731
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = meet(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else scratch.write(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = meet(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        rows, seen = state[0], state
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return scratch.write(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots))
