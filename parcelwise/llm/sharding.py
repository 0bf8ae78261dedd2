"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in ``parts`` partitions, named by a hash of id and text. How many rows of each partition
go to each target block is drawn exactly as a uniform random permutation of all rows would deal them: a
matrix with the partitions' sizes as row sums and the blocks' capacities as column sums. It is drawn by
halving the list of partitions; at each halving the left half's share of every block is a hypergeometric
draw from what is left. Then rows are put in random order inside their partition, cut up by the matrix,
exchanged, and put in random order again inside their block. A shard is a fixed number of consecutive
blocks, so its slots need no count of what other tasks hold, and no task holds a whole shard.

Everything is DataFrame and SQL functions; randomness is a hash of the seed and a draw's place, so reruns
agree on the same rows and layout does not matter.

A draw with a short support is read off the distribution function; any other uses ratio-of-uniforms
rejection with the enclosing table of the hypergeometric law (Stadlober, 1990), at most ``_TRIALS`` trials (each
accepts with probability over one half; running out raises an error rather than bend the law).

Defined results: law ``rows``, shard sizes differ by one at most; a null text has size 16 and checksum 0, an empty
one too; equal rows are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.session import materialize

SHARDS = 40
ROWS_AT_ONCE = 1_000_000
SEED = 20
_TRIALS = 80
_SHORT = 96
# fixed values of the table hat: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e)
_HAT_WIDTH, _HAT_SHIFT = 1.7155277699214135, 0.8989161620588988


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def log_factorial(x: str) -> str:
    """SQL for ln(x!) by Stirling's series, moved up by seven so that small x are exact to about 1e-10."""
    z = "lf"
    product = " * ".join(f"({z} + {i})" for i in range(1, 8))
    w = f"({z} + 8)"
    series = f"({w} - 0.5D) * ln({w}) - {w} + 0.9189385332046727D + 1 / (12D * {w}) - 1 / (360D * {w} * {w} * {w})"
    return _let(f"CAST({x} AS DOUBLE)", z, f"({series} + 1 / (1260D * pow({w}, 5)) - ln({product}))")


def uniform(*key: str) -> str:
    """SQL for a number in (0, 1) fixed by the key."""
    return f"((shiftrightunsigned(xxhash64({', '.join(key)}), 11) + 0.5D) / 9007199254740992D)"


def hypergeometric(population: str, good: str, draws: str, key: str) -> str:
    """SQL for the number of good ones among ``draws`` from ``population``; arguments are SQL longs."""
    ways = lambda k: " + ".join(
        log_factorial(x) for x in (k, f"g - {k}", f"d - {k}", f"p - g - d + {k}")
    )
    short = (
        f"aggregate(sequence(low, high), named_struct('sum', 0D, 'at', CAST(NULL AS BIGINT)), (acc, k) -> "
        f"IF(acc.at IS NOT NULL, acc, {_let(f'acc.sum + exp(whole - ({ways("k")}))', 'upto', 'named_struct("sum", upto, "at", IF(upto >= ' + uniform(key, "-1") + ', k, CAST(NULL AS BIGINT)))')}), acc -> coalesce(acc.at, high))"
    )
    short = short.replace('"sum"', "'sum'").replace('"at"', "'at'")
    whole = " + ".join(
        [log_factorial("g"), log_factorial("p - g"), log_factorial("d"), log_factorial("p - d")]
    ) + f" - {log_factorial('p')}"
    mode = "CAST(floor((d + 1D) * (g + 1D) / (p + 2D)) AS BIGINT)"
    spread = "sqrt((p - d) * (d * (g / CAST(p AS DOUBLE))) * (1 - g / CAST(p AS DOUBLE)) / (p - 1D) + 0.5D)"
    trial = _let(
        uniform(key, "t", "0"), "x",
        _let(
            f"CAST(floor(d * (g / CAST(p AS DOUBLE)) + 0.5D + ({_HAT_WIDTH}D * spread + {_HAT_SHIFT}D) * ({uniform(key, 't', '1')} - 0.5D) / x) AS BIGINT)",
            "k", f"IF(k BETWEEN low AND high AND 2 * ln(x) <= top - ({ways('k')}), k, CAST(NULL AS BIGINT))",
        ),
    )
    long_ = _let(
        spread, "spread",
        _let(mode, "m", _let(ways("m"), "top",
             f"coalesce(aggregate(sequence(1, {_TRIALS}), CAST(NULL AS BIGINT), (acc, t) -> coalesce(acc, {trial})), "
             f"CAST(raise_error('no draw was accepted') AS BIGINT))")),
    )
    body = f"CASE WHEN low = high THEN low WHEN high - low <= {_SHORT} THEN {_let(whole, 'whole', short)} ELSE {long_} END"
    low, high = "greatest(0L, d + g - p)", "least(g, d)"
    inner = _let(low, "low", _let(high, "high", body))
    return _let(f"CAST({population} AS BIGINT)", "p", _let(f"CAST({good} AS BIGINT)", "g", _let(f"CAST({draws} AS BIGINT)", "d", inner)))


def split_draw(blocks: str, draws: str, key: str) -> str:
    """SQL for the share of a random subset of ``draws`` rows in each block, given the rows of each block."""
    one = hypergeometric("st.rest", "b", "st.draws", f"concat_ws('/', {key}, size(st.share))")
    step = _let(
        one, "x",
        "named_struct('rest', st.rest - b, 'draws', st.draws - x, 'share', concat(st.share, array(x)))",
    )
    start = (
        f"named_struct('rest', aggregate({blocks}, 0L, (a, b) -> a + b), 'draws', CAST({draws} AS BIGINT), "
        f"'share', CAST(array() AS ARRAY<BIGINT>))"
    )
    return f"aggregate({blocks}, {start}, (st, b) -> {step}, st -> st.share)"


def communication_matrix(sizes: DataFrame, capacity: str, parts: int, seed: int = SEED) -> DataFrame:
    """(part, share): the rows that each part sends to each block.

    ``sizes`` is one row with ``sizes``, an array of the ``parts`` partition sizes; ``capacity`` is SQL for the
    array of block capacities, whose sum must equal the sum of the sizes.
    """
    nodes = sizes.select(F.lit(0).cast("long").alias("first"), "sizes", F.expr(capacity).alias("blocks"))
    levels = max(0, (parts - 1).bit_length())
    for level in range(levels):
        half = "CAST(size(sizes) DIV 2 AS INT)"
        left_rows = f"aggregate(slice(sizes, 1, {half}), 0L, (a, b) -> a + b)"
        drawn = nodes.withColumn(
            "left", F.expr(f"IF(size(sizes) < 2, NULL, {split_draw('blocks', left_rows, f'{seed}, {level}, first')})")
        )
        both = (
            f"IF(left IS NULL, array(named_struct('first', first, 'sizes', sizes, 'blocks', blocks)), array("
            f"named_struct('first', first, 'sizes', slice(sizes, 1, {half}), 'blocks', left), "
            f"named_struct('first', first + {half}, 'sizes', slice(sizes, {half} + 1, size(sizes)), "
            f"'blocks', zip_with(blocks, left, (a, b) -> a - b))))"
        )
        nodes = drawn.select(F.explode(F.expr(both)).alias("n")).select("n.*")
        if level == 5:  # from here on the halves are spread over the cluster
            nodes = nodes.repartition("first")
    return nodes.select(F.col("first").alias("part"), F.col("blocks").alias("share"))


def slim(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, hash): what the shuffle moves instead of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("hash"),
    )


def shuffle(docs: DataFrame, shards: int = SHARDS, rows_at_once: int = ROWS_AT_ONCE, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every document in a uniformly random place."""
    rows = materialize(slim(docs, seed))
    n = rows.count()
    parts = max(128, -(-n // rows_at_once))
    per_shard = max(4, -(-n // (shards * rows_at_once)))
    blocks = shards * per_shard
    # shard s holds the places from floor(s * n / shards); its blocks split them the same way
    shard_rows = f"(({n}L * (s + 1)) DIV {shards} - ({n}L * s) DIV {shards})"
    capacity = (
        f"transform(sequence(0, {blocks - 1}), c -> transform(array(CAST(c DIV {per_shard} AS BIGINT)), s -> "
        f"({shard_rows} * (c % {per_shard} + 1)) DIV {per_shard} - ({shard_rows} * (c % {per_shard})) DIV {per_shard})[0])"
    )
    placed = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "hash"), F.lit(parts)))
    every = rows.sparkSession.range(parts).select(F.col("id").alias("part"))
    sizes = (
        every.join(placed.groupBy("part").count(), "part", "left")
        .select(F.struct("part", F.coalesce("count", F.lit(0)).cast("long").alias("n")).alias("x"))
        .agg(F.expr("transform(array_sort(collect_list(x)), y -> y.n)").alias("sizes"))
    )
    # first local order, cut by the matrix
    first = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 2), "hash"), "doc_id", "text_crc32", "size")
    queued = placed.withColumn("place", F.row_number().over(first).cast("long") - 1)
    matrix = communication_matrix(sizes, capacity, parts, seed).select("part", F.posexplode("share").alias("block", "share"))
    up_to = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = matrix.withColumn("place", F.coalesce(F.sum("share").over(up_to), F.lit(0).cast("long"))).where(F.col("share") > 0)
    merged = queued.select("part", "place", "doc_id", "size", "text_crc32", "hash", F.lit(None).cast("int").alias("cut")).unionByName(
        cuts.select("part", "place", F.col("block").cast("int").alias("cut")), allowMissingColumns=True
    )
    along = Window.partitionBy("part").orderBy("place", F.col("cut").asc_nulls_last())
    sent = (
        merged.withColumn("block", F.last("cut", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("size").isNotNull())
        .drop("cut")
    )
    # exchanged by block, second local order
    second = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 3), "hash"), "doc_id", "text_crc32", "size")
    shard = F.expr(f"block DIV {per_shard}").cast("int")
    before = F.expr(
        f"transform(array(CAST(block DIV {per_shard} AS BIGINT)), s -> ({shard_rows} * (block % {per_shard})) DIV {per_shard})[0]"
    )
    return sent.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"),
        (before + F.row_number().over(second) - 1).cast("long").alias("slot"),
    )


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shuffle with its law named; ``grown_shard`` belongs to another law and is null."""
    return shuffle(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
