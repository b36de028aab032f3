"""Mixing sources to target weights, with DataFrame and SQL functions only.

The words of each source are dealt to blocks (hash buckets of documents).  A source takes whole passes over all its
blocks and a last pass over the first blocks of a fixed permutation, the block at the end in part.  Each taken block of a
pass is an item; a multivariate-hypergeometric splitting tree deals the exact item counts of the sources to the output
shards, each shard draws its own, disjoint range of every source's permuted items, and documents are ordered in a shard
by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace

#: A word is a run of anything but white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of a source: as many as give each so many documents if the source has them all, within these bounds.
BLOCK_DOCS, BLOCKS = 20_000, (4096, 1 << 20)
#: Words of an output shard on average, the bounds of their number, and the parts of a shard that tasks write.
SHARD_WORDS, SHARDS, SHARD_PARTS = 32_000_000, (16, 1 << 16), 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_factorial(n: str) -> str:
    """Stirling's series at n + 8, carried back to n."""
    z = f"({n} + 8D)"
    back = " * ".join(f"({n} + {i}D)" for i in range(1, 8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) - ln({back}))"


def _hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """A hypergeometric variate by inversion; weights are computed within 12 standard deviations of the mean."""
    weight = "exp(h.top - ({} + {} + {} + {}))".format(
        _log_factorial("x"), _log_factorial("(h.k - x)"), _log_factorial("(h.m - x)"), _log_factorial("(h.n - h.k - h.m + x)")
    )
    at_mode = " + ".join(_log_factorial(x) for x in ("g.mode", "(g.k - g.mode)", "(g.m - g.mode)", "(g.n - g.k - g.m + g.mode)"))
    pick = (
        "cast(least(h.b, h.a - 1 + aggregate(w, named_struct('left', h.u * aggregate(w, 0D, (s, y) -> s + y), 'i', 0L),"
        " (s, y) -> if(s.left > 0 or s.i = 0L, named_struct('left', s.left - y, 'i', s.i + 1L), s), s -> s.i)) as bigint)"
    )
    chosen = _let(f"transform(sequence(h.a, h.b), x -> {weight})", "w", pick)
    with_top = _let(f"named_struct('n', g.n, 'k', g.k, 'm', g.m, 'u', g.u, 'a', g.a, 'b', g.b, 'top', {at_mode})", "h", chosen)
    spread = "cast(ceil(12 * sqrt(e.m * (e.k / e.n) * (1 - e.k / e.n) * ((e.n - e.m) / greatest(e.n - 1, 1)))) + 1 as bigint)"
    mean = "cast(e.m * (e.k / e.n) as bigint)"
    a = f"greatest(0L, e.m - (e.n - e.k), {mean} - {spread})"
    b = f"least(e.m, e.k, {mean} + {spread})"
    bounded = _let(
        f"named_struct('n', e.n, 'k', e.k, 'm', e.m, 'u', e.u, 'a', {a}, 'b', {b}, 'mode', greatest({a}, least({b}, {mean})))",
        "g",
        with_top,
    )
    drawn = _let(f"named_struct('n', {total}, 'k', {good}, 'm', {draws}, 'u', {u})", "e", bounded)
    return f"case when {good} = 0 or {draws} = 0 then 0L when {draws} >= {total} then {good} else {drawn} end"


def splitting_tree(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """counts: one row (counts array<bigint>) of items by source; returns (shard, counts), exact and disjoint.

    At each node the left half's total is fixed and its sources are drawn one after another, each from the items not
    yet passed: a multivariate hypergeometric draw.
    """
    draw = _hypergeometric("acc.n", "k.c", "acc.m", f"shiftrightunsigned(xxhash64({seed}L, lo, hi, k.i), 11) / 9007199254740992D")
    left = (
        "aggregate(transform(counts, (c, i) -> named_struct('c', c, 'i', i)),"
        " named_struct('n', total, 'm', half, 'out', cast(array() as array<bigint>)),"
        f" (acc, k) -> transform(array({draw}), x -> named_struct('n', acc.n - k.c, 'm', acc.m - x, 'out', array_append(acc.out, x)))[0],"
        " acc -> acc.out)"
    )
    nodes = counts.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    width = shards
    while width > 1:
        if width < shards and -(-shards // width) == 256:  # from here on many tasks split the nodes
            nodes = nodes.repartition("lo")
        nodes = (
            nodes.withColumn("total", F.expr("aggregate(counts, 0L, (s, x) -> s + x)"))
            .withColumn("mid", F.expr("lo + (hi - lo) div 2").cast("int"))
            .withColumn("half", F.expr("cast(total * (mid - lo) div greatest(hi - lo, 1) as bigint)"))
            .withColumn("left", F.expr(f"if(hi - lo > 1, {left}, counts)"))
            .select(
                F.explode(
                    F.expr(
                        "if(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'counts', left),"
                        " named_struct('lo', mid, 'hi', hi, 'counts', zip_with(counts, left, (a, b) -> a - b))),"
                        " array(named_struct('lo', lo, 'hi', hi, 'counts', counts)))"
                    )
                ).alias("n")
            )
            .select("n.*")
        )
        width = (width + 1) // 2
    return nodes.select(F.col("lo").alias("shard"), "counts")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: (skey, source_size), a row for each source; adds source_idx, weight and target.

    Targets share `share` times all words by weight; one above `most` times its source stops there and the excess is
    shared again by weight.  Sorted by what a unit of weight can hold, the stopped sources are a prefix.
    """
    by_name, by_room = Window.orderBy("skey"), Window.orderBy("room", "source_idx")
    return (
        sizes.withColumn("source_idx", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_idx") % len(weights)) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") * F.lit(share) - F.col("before")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("room") > F.col("level"), F.col("level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))))
        .select("skey", "source_idx", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    shards: int | None = None,
    seed: int = 20_240_607,
    whole_documents: bool = False,
) -> DataFrame:
    """Mix `docs`: a row per document with doc (a struct of `keep`, by default all columns), size, source_size, target,
    taken and draws, an array of (pass, shard, words), a draw for each copy that the mix takes.

    Sources are taken by code point, null last, and weigh `weights` in turn.  A null text has size 0 and is never drawn.
    A document is taken in part only at the end of its source's last pass; with `whole_documents` it is then taken
    whole or not at all, whichever is nearer.  Repeated rows are documents of their own; a null id is a value like any
    other.  Texts of any length are counted whole.  No column is added to `doc`, so clashing names don't matter.  An
    empty table gives an empty result.  The draws depend on `seed` and on ids, texts and sources alone, ties go by the
    other columns, so reruns agree.

    The summary by source (a row each) passes through one window; that by block has a row for some thousand documents;
    documents meet it by an equi-join on (source, block), which spreads the largest source over all its blocks, and
    rows without an id, or with the same one, by their texts.  Only rows that repeat id, text and source share a block.
    Blocks and, if `shards` isn't given, shards grow with the data.
    """
    n_blocks = min(BLOCKS[1], max(BLOCKS[0], docs.count() // BLOCK_DOCS))
    skey = F.when(F.col(source_col).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"),
        n_words(F.col(text_col)).alias("size"),
        skey.alias("skey"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("place"),
        F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, t in docs.dtypes if c in (keep or docs.columns) and c != text_col and "map<" not in t]).alias("tie"),
    ).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.lit(n_blocks)).cast("int"))
    # Written, as the summary is read several times and each reading would count the words of all texts again.
    blocks = Workspace(docs.sparkSession, "mixing", docs).write(base.groupBy("skey", "block").agg(F.sum("size").alias("words")), "blocks")
    shards = shards or min(SHARDS[1], max(SHARDS[0], int(share * (blocks.agg(F.sum("words")).first()[0] or 0)) // SHARD_WORDS))
    sources = source_targets(blocks.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, most)
    in_order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 2), "skey", "block"), "block")
    blocks = (
        blocks.join(sources, "skey")
        .withColumn("want", F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(most))).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
        .withColumn("before", F.sum("words").over(in_order) - F.col("words"))
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    )
    items = (
        blocks.select("*", F.explode(F.expr("sequence(0, passes)")).alias("pass"))
        .withColumn("item_words", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("last")))
        .filter("item_words > 0")
        .select("skey", "block", "source_idx", "pass", "item_words")
    )
    permuted = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 3), "skey", "block", "pass"), "block", "pass")
    items = items.withColumn("item", F.row_number().over(permuted) - 1)
    counts = (
        sources.join(items.groupBy("skey").agg(F.count("*").alias("n")), "skey", "left")
        .agg(F.array_sort(F.collect_list(F.struct("source_idx", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
        .select(F.expr("transform(c, x -> x.n)").alias("counts"))
    )
    by_shard = Window.partitionBy("source_idx").orderBy("shard")
    dealt = (
        splitting_tree(counts, shards, seed + 4)
        .select("shard", F.posexplode("counts").alias("source_idx", "n"))
        .withColumn("end", F.sum("n").over(by_shard))
        .filter("n > 0")
        .select("source_idx", "shard", F.explode(F.expr("sequence(cast(end - n as int), cast(end - 1 as int))")).alias("item"))
    )
    drawn = (
        items.join(dealt.hint("merge"), ["source_idx", "item"])
        .groupBy("skey", "block")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    )
    plan = blocks.select("skey", "block", "source_size", "target", "passes", "words", "last").join(drawn.hint("merge"), ["skey", "block"], "left")
    within = Window.partitionBy("skey", "block").orderBy("place", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.when(F.col("upto") - F.col("size") / 2 <= F.col("last"), F.col("size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("last") - (F.col("upto") - F.col("size"))))
    return (
        base.join(plan.hint("merge"), ["skey", "block"])
        .withColumn("upto", F.sum("size").over(within))
        .withColumn("rest", F.when(F.col("last") == F.col("words"), F.col("size")).when(F.col("last") <= 0, F.lit(0)).otherwise(whole if whole_documents else part))
        .withColumn(
            "draws",
            F.expr(
                "filter(transform(coalesce(draws, array()), d -> named_struct('pass', d.pass, 'shard', d.shard,"
                " 'words', cast(if(d.pass < passes, size, rest) as bigint))), d -> d.words > 0)"
            ),
        )
        .select(
            "doc",
            "size",
            "source_size",
            "target",
            F.expr("aggregate(draws, 0L, (s, d) -> s + d.words)").alias("taken"),
            "draws",
        )
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 20_240_607, **options) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each copy taken whole, grouped by shard and shuffled in it.

    A document without words has nothing to be drawn and isn't in the mix; for the rest see `mix`."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, seed=seed, whole_documents=True, **options)
    return (
        mixed.select("doc", F.explode("draws").alias("d"))
        .withColumn("order", F.xxhash64(F.lit(seed + 5), F.col("doc")[id_col], F.col("doc")[text_col], "d.pass"))
        .repartition("d.shard", F.pmod("order", F.lit(SHARD_PARTS)))
        .sortWithinPartitions("d.shard", "order")
        .select("doc.*")
    )
