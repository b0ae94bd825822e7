"""Temperature mixing of sources, in DataFrame functions only.

Weights: a source's share of the tokens to the power alpha, normalised. Alpha is
the least in [0, 1] that neither makes the weights' entropy exceed target_entropy
(a fraction of the logarithm of the number of sources) nor repeats a source more
than repetition_limit times; both fall as alpha rises, so it is bisected. Without
budget_tokens the budget is the least that uses every document once.

Realisation: a source's documents lie in blocks of about block_tokens, dealt by a
hash. Each epoch takes the blocks in a new order drawn by a hash; the last epoch
takes whole blocks while the source's budget lasts, and of the block where it ends
the documents, in hash order, that begin before its end. `position`, from 0 to 1,
is where a document stands in the mixture: sorted by it, the sources come at even
rates.

Tokens are words between ASCII white space. A null source is a source of its own.
Null texts and texts without words have no tokens; a source without tokens is kept
once. Equal rows stay separate rows and share a fate but for the last block, where
equal hashes come in any order of equal rows. A source has at most MOST_BLOCKS blocks
(they are larger then). The weights of all sources meet in one row: more than
MOST_SOURCES of them are an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.cluster import checkpointed, free, through_table

MOST_SOURCES, MOST_BLOCKS = 100_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 2 ** 60) drawn by the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def weights(totals: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget_tokens: float | None, steps: int = 50) -> DataFrame:
    """totals (source, tokens) with alpha, weight, target and repeats; sources without
    tokens have weight 0 and are repeated once."""
    shares = F.expr("filter(all, x -> x.tokens > 0)")
    one = totals.agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("all")).withColumn("all", shares)
    one = one.withColumn("total", F.aggregate("all", F.lit(0.0), lambda a, x: a + x["tokens"]))
    one = one.withColumn("q", F.transform("all", lambda x: x["tokens"] / F.col("total"))).withColumn("n", F.size("all"))

    def w(a: Column) -> Column:
        raw = F.transform("q", lambda q: F.pow(q, a))
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))

    def entropy(ws: Column) -> Column:
        return -F.aggregate(ws, F.lit(0.0), lambda s, x: s + x * F.log(x))

    def most(ws: Column) -> Column:
        ratio = F.zip_with(ws, "q", lambda x, q: x / q)  # repeats, up to a factor
        scale = F.lit(budget_tokens) / F.col("total") if budget_tokens is not None else 1 / F.array_min(ratio)
        return F.array_max(ratio) * scale

    def too_flat(a: Column) -> Column:
        bad = F.lit(False)
        ws = w(a)
        if target_entropy is not None:
            bad = bad | (entropy(ws) > F.lit(float(target_entropy)) * F.log(F.col("n")))
        if repetition_limit is not None:
            bad = bad | (most(ws) > F.lit(float(repetition_limit)))
        return bad

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(too_flat(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    span = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    one = one.withColumn("alpha", F.when(F.col("n") == 0, F.lit(1.0)).when(~too_flat(F.lit(0.0)), F.lit(0.0)).otherwise(span["hi"])).withColumn("w", w(F.col("alpha")))
    if budget_tokens is not None:
        one = one.withColumn("budget", F.lit(float(budget_tokens)))
    else:
        one = one.withColumn("budget", F.col("total") / F.array_min(F.zip_with("w", "q", lambda x, q: x / q)))
    flat = one.select("alpha", "budget", F.explode(F.arrays_zip("all", "w")).alias("z")).select(F.col("z.all.source").alias("s"), "alpha", F.col("z.w").alias("weight"), (F.col("z.w") * F.col("budget")).alias("target"))
    joined = totals.join(flat, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.withColumn("repeats", F.when(F.col("tokens") > 0, F.greatest(F.col("target") / F.col("tokens"), F.lit(0.0))).otherwise(F.lit(1.0))).withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def mix(docs: DataFrame, target_entropy: float | None = 0.95, repetition_limit: float | None = 4.0, budget_tokens: float | None = None, block_tokens: int = 200_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """(id_col, source, n_tokens, weight, epoch, block, position, sig): a row for each
    time that a document is used; sig is a hash of its id, source and text."""
    tokens = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sig = draw(seed, F.col(id_col), F.col(source_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = through_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), tokens.alias("n_tokens"), sig.alias("sig")), "mixing")
    totals = checkpointed(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: join them into fewer")
    plan = weights(totals, target_entropy, repetition_limit, budget_tokens)
    # one row a source from here on; a step above exact whole numbers is an epoch of its own
    eps = 1e-9
    plan = plan.withColumn("full", F.floor(F.col("repeats") + eps)).withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("tokens"), F.lit(0.0)))
    plan = plan.withColumn("rest", F.when(F.col("repeats") - F.col("full") < eps, 0.0).otherwise(F.coalesce("rest", F.lit(0.0))))
    plan = through_table(plan.withColumn("blocks", F.least(F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)), F.lit(MOST_BLOCKS))), "mixing-plan")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sources = plan.select(F.col("source").alias("s"), "weight", "repeats", "full", "rest", "blocks")
    placed = rows.join(sources, same("source", "s")).drop("s").withColumn("block", F.col("sig") % F.col("blocks"))
    # the last, partial epoch: blocks in a drawn order up to the budget
    blocks = placed.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("full").alias("epoch"), F.first("rest").alias("rest"))
    order = W.partitionBy("source").orderBy(draw(seed + 1, F.col("source"), F.col("epoch"), F.col("block")), "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = through_table(blocks.withColumn("left", F.col("rest") - before).where("left > 0").select(F.col("source").alias("bs"), F.col("block").alias("bb"), "left", "size"), "mixing-blocks")
    last = placed.where("rest > 0").join(cut, same("source", "bs") & (F.col("block") == F.col("bb"))).drop("bs", "bb")
    whole = last.where(F.col("size") <= F.col("left")).drop("left", "size")
    inside = W.partitionBy("source", "block").orderBy(draw(seed + 2, F.col("full"), F.col("sig")), "id", "sig").rowsBetween(W.unboundedPreceding, -1)
    part = last.where(F.col("size") > F.col("left")).withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("ahead < left").drop("ahead", "left", "size")
    full = placed.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    used = full.unionByName(whole.unionByName(part).withColumn("epoch", F.col("full")))
    spread = (draw(seed + 3, F.col("source"), F.col("epoch"), F.col("block")) % (1 << 30) + draw(seed + 4, F.col("epoch"), F.col("sig")) / F.lit(float(1 << 60))) / F.lit(float(1 << 30))
    length = F.when(F.col("epoch") < F.col("full"), 1.0).otherwise(F.col("repeats") - F.col("full"))
    position = (F.col("epoch") + spread * length) / F.greatest("repeats", F.lit(1e-12))
    return used.select(F.col("id").alias(id_col), "source", "n_tokens", "weight", "epoch", "block", position.alias("position"), "sig")


def take(docs: DataFrame, used: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """The rows of docs, as often as `used` (of mix with the same columns and seed) uses them."""
    sig = draw(seed, F.col(id_col), F.col(source_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    times = used.select("sig", "epoch").distinct().groupBy("sig").agg(F.count("*").alias("n"))
    key = free("_sig", docs.columns)
    n = free("_n", [*docs.columns, key])
    times = times.select(F.col("sig").alias(key), F.col("n").alias(n))
    return docs.withColumn(key, sig).join(times.hint("merge"), key).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).drop("sig").withColumns({"weight": F.round("weight", 9), "position": F.round("position", 9)})


def _draw(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"coalesce(CAST({p} AS VARCHAR), '\\N')" for p in parts)])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _flat(a: str, entropy: float, limit: float) -> str:
    total = f"list_sum(list_transform(q, lambda x: pow(x, {a})))"
    ratio = f"list_transform(q, lambda x: pow(x, {a}) / x)"
    return f"(-list_sum(list_transform(q, lambda x: pow(x, {a}) / {total} * ln(pow(x, {a}) / {total}))) > {entropy} * ln(n) OR list_max({ratio}) / list_min({ratio}) > {limit})"


#: op7 with its production parameters: the same draws, weights and cuts.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
    {_draw(5, "doc_id", "source", "md5(coalesce(text, ''))")} AS sig FROM documents),
t AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
q AS (SELECT list(tokens / CAST(total AS DOUBLE) ORDER BY source NULLS FIRST) AS q, count(*) AS n, max(total) AS total FROM t, (SELECT sum(tokens) AS total FROM t) WHERE tokens > 0),
b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN f THEN mid ELSE lo END, CASE WHEN f THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, {_flat("((lo + hi) / 2)", 0.95, 4.0)} AS f FROM b, q WHERE i < 50)),
a AS (SELECT CASE WHEN n = 0 THEN 1 WHEN NOT {_flat("0.0", 0.95, 4.0)} THEN 0 ELSE hi END AS alpha, total FROM b, q WHERE i = 50),
w AS (SELECT source, tokens, pow(tokens / CAST(total AS DOUBLE), alpha) / sum(pow(tokens / CAST(total AS DOUBLE), alpha)) OVER () AS weight, total FROM t, a WHERE tokens > 0),
g AS (SELECT source, tokens, weight, weight * min_budget AS target FROM w, (SELECT max(total) / min(weight / (tokens / CAST(total AS DOUBLE))) AS min_budget FROM w)),
p0 AS (SELECT t.source, t.tokens, coalesce(g.weight, 0) AS weight, coalesce(g.target, 0) AS target, CASE WHEN t.tokens > 0 THEN greatest(g.target / t.tokens, 0) ELSE 1 END AS repeats FROM t LEFT JOIN g ON t.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, CAST(floor(repeats + 1e-9) AS BIGINT) AS nfull, CASE WHEN repeats - floor(repeats + 1e-9) < 1e-9 THEN 0 ELSE greatest(target - floor(repeats + 1e-9) * tokens, 0) END AS rest, least(greatest(CAST(ceil(tokens / CAST(200000 AS DOUBLE)) AS BIGINT), 1), {MOST_BLOCKS}) AS blocks FROM p0),
r AS (SELECT d.*, weight, repeats, nfull, rest, sig % blocks AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
bl AS (SELECT source, block, sum(n_tokens) AS size, any_value(nfull) AS nfull, any_value(rest) AS rest FROM r WHERE rest > 0 GROUP BY source, block),
c AS (SELECT source, block, size, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY {_draw(6, "source", "nfull", "block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM bl),
l AS (SELECT r.*, c.size, c.budget, coalesce(sum(n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY {_draw(7, "nfull", "sig")}, id, sig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.block = c.block WHERE rest > 0 AND budget > 0),
u AS (SELECT id, source, n_tokens, weight, repeats, nfull, sig, block, e AS epoch FROM r, range(0, 64) x(e) WHERE e < nfull
  UNION ALL SELECT id, source, n_tokens, weight, repeats, nfull, sig, block, nfull FROM l WHERE size <= budget OR ahead < budget)
SELECT id AS doc_id, source, n_tokens, round(weight, 9) AS weight, epoch, block,
  round((epoch + ({_draw(8, "source", "epoch", "block")} % 1073741824 + {_draw(9, "epoch", "sig")} / CAST(1152921504606846976 AS DOUBLE)) / CAST(1073741824 AS DOUBLE) * CASE WHEN epoch < nfull THEN 1 ELSE repeats - nfull END) / greatest(repeats, 1e-12), 9) AS position
FROM u"""
