"""Mixing sources to target weights by hierarchical budgets; DataFrame operations only.

A token budget goes down a tree of domain, language and source. At each node it is shared among the children by weight;
a child that holds less than its share gives the rest back to its siblings, and only what no sibling can take is left to
the ancestors (a node's capacity is the sum of its leaves', so an ancestor never hands down more than fits). Each leaf
then takes whole epochs of its documents and, of the epoch after these, a prefix of the seeded order.

The prefix needs running sums over leaves of any size: documents are dealt by the order's hash to ``BUCKETS`` buckets,
bucket sums give the one in which a leaf's budget ends, and only that bucket is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import free_name, small, written

SEED, PERCENT, EPOCHS = 17, 80, 2
#: Target weights of languages; every other language, and every domain and source, has weight 1.
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}

#: 60 bits of hash; the highest 12 are the bucket.
BUCKETS, BITS = 4096, 48

LEAF = ["domain", "lang", "source"]
#: Pattern of a token.
TOKEN = "[^\\x20\\x09-\\x0D]+"


def n_tokens(text: Column) -> Column:
    """Stretches between ASCII white space: the unit in which budgets are measured. 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def with_leaf(docs: DataFrame, text: str = "text", leaf: str = "_leaf", n: str = "_n") -> DataFrame:
    """docs with the leaf (domain, lang, source; null counts as '') and the number of tokens. The domain is the letters a source's name begins with."""
    source, lang = F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))
    parts = F.struct(F.regexp_extract(source, "^[A-Za-z]*", 0).alias("domain"), lang.alias("lang"), source.alias("source"))
    return docs.withColumns({leaf: parts, n: n_tokens(F.col(text))})


def _weight(column: str, weights: dict[str, int]) -> Column:
    known = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*known), F.col(column)), F.lit(1)).cast("long") if known else F.lit(1).cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children (parent..., child, cap, weight, total) with budget: total shared among the children of each parent.

    In order of capacity per weight, a child is full if its capacity is no more than its share of what those before it
    left; the others share the rest by weight, rounded down. Exact in whole numbers.
    """
    wide = lambda c: F.col(c).cast("decimal(24,0)")
    narrow = lambda c: F.col(c).cast("decimal(13,0)")
    by = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(child).asc())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    rows = children.withColumns({"_left": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "_weights": F.sum("weight").over(onward)})
    rows = rows.withColumn("_full", wide("cap") * narrow("_weights") <= wide("_left") * narrow("weight"))
    rows = rows.withColumns({"_rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)), "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole), F.lit(1))})
    part = F.expr("cast(_rest as decimal(24,0)) * cast(weight as decimal(13,0)) div cast(_open as decimal(13,0))").cast("long")
    return rows.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_left", "_weights", "_full", "_rest", "_open")


def budgets(leaves: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, domains: dict[str, int] | None = None, languages: dict[str, int] | None = None, sources: dict[str, int] | None = None) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens).

    The whole budget is percent of all tokens; a leaf can give epochs times what it holds.
    """
    languages = LANGUAGE_WEIGHTS if languages is None else languages
    leaves = leaves.select(*LEAF, "tokens", (F.col("tokens") * epochs).alias("cap"))
    total = leaves.agg(F.expr(f"least(sum(tokens) * {int(percent)} div 100, sum(cap))").alias("total"))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("domain", domains or {}))
    one = F.lit(1).alias("_one")
    top = top.select("*", one).join(F.broadcast(total.select("total", one)), "_one").drop("_one")  # one row
    top = share_out(top.withColumn("_root", F.lit(1)), ["_root"], "domain").select("domain", F.col("budget").alias("total"))
    middle = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("lang", languages)).join(top, "domain")
    middle = share_out(middle, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("total"))
    bottom = leaves.withColumn("weight", _weight("source", sources or {})).join(middle, ["domain", "lang"])
    return share_out(bottom, ["domain", "lang"], "source").select(*LEAF, "tokens", "budget")


def _place(seed: int, epoch: str = "_whole") -> Column:
    """60 bits of the seeded order of an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, **weights: dict[str, int]) -> DataFrame:
    """Rows of docs with epoch (int, from 0) and n_tokens (long): a document comes once for each epoch it is taken in.

    docs has doc_id, text, lang and source; other columns pass, whatever their names, and those called like a new one
    are replaced. Texts without tokens (null, empty, white space) are never taken. Null languages and sources are leaves
    of their own, called ''. Of one epoch a leaf takes the longest prefix of its seeded order that its budget holds;
    repeated rows are documents of their own, in order of their tokens. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    # all columns of docs in one, so that no name of theirs meets one of the plan's
    leaf, n = free_name(kept, "_leaf"), free_name(kept, "_n")
    rows = with_leaf(docs.select(*[F.col(f"`{c}`") for c in kept]), leaf=leaf, n=n)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(leaf).alias("_leaf"), F.col(n).alias("_n")).where("_n > 0").withColumn("doc_id", F.col("_row.doc_id"))
    slim = written(rows.select("doc_id", "_leaf", "_n"), "mix-slim")
    leaves = slim.groupBy("_leaf").agg(F.sum("_n").alias("tokens")).select("_leaf.*", "tokens")
    plan = budgets(leaves, percent, epochs, **weights).select(F.struct(*LEAF).alias("_leaf"), F.expr("cast(budget div tokens as int)").alias("_whole"), (F.col("budget") % F.col("tokens")).alias("_rest"))
    plan = written(plan, "mix-plan")
    place = lambda df: df.join(small(plan), "_leaf").withColumn("_place", _place(seed)).withColumn("_bucket", F.shiftright("_place", BITS).cast("int"))
    sums = place(slim).groupBy("_leaf", "_bucket", "_rest").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the bucket in which a leaf's prefix ends, and what is left of the budget where it begins
    ends = sums.withColumn("_before", before).where("_before <= _rest and _before + _sum > _rest").select("_leaf", F.col("_bucket").alias("_last"), (F.col("_rest") - F.col("_before")).alias("_room"))
    ends = small(written(ends, "mix-ends"))
    placed = place(rows).join(ends, "_leaf", "left")
    running = F.sum("_n").over(Window.partitionBy("_leaf", "_bucket").orderBy("_place", "doc_id", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = lambda epoch: ["_row.*", epoch.alias("epoch"), F.col("_n").alias("n_tokens")]
    some = placed.where("_bucket = _last").withColumn("_running", running).where("_running <= _room").select(*out(F.col("_whole")))
    times = F.col("_whole") + F.when(F.col("_bucket") < F.col("_last"), 1).otherwise(0)
    most = placed.withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return most.select(*out(F.col("_epoch"))).union(some)


def oracle(percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, languages: dict[str, int] | None = None, table: str = "documents") -> str:
    """DuckDB SQL for (doc_id, domain, lang, source, epoch, n_tokens) of mix over a table, with weights for languages."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (LANGUAGE_WEIGHTS if languages is None else languages).items())

    def level(name: str, source: str, parent: str, child: str) -> str:
        by = f"PARTITION BY {parent} ORDER BY cap / weight, {child}"
        return f"""
{name}_a AS (SELECT *, total - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {source}),
{name}_b AS (SELECT *, cap::HUGEINT * w::HUGEINT <= l::HUGEINT * weight::HUGEINT AS f FROM {name}_a),
{name}_c AS (SELECT *, total - coalesce(sum(CASE WHEN f THEN cap END) OVER (PARTITION BY {parent}), 0) AS rest, coalesce(sum(CASE WHEN NOT f THEN weight END) OVER (PARTITION BY {parent}), 1) AS open FROM {name}_b),
{name} AS (SELECT *, CASE WHEN f THEN cap::BIGINT ELSE ((rest::HUGEINT * weight::HUGEINT) // open::HUGEINT)::BIGINT END AS budget FROM {name}_c)"""

    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract(coalesce(source, ''), '^[A-Za-z]*') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(text, '{TOKEN}')) AS n
  FROM {table} WHERE len(regexp_extract_all(text, '{TOKEN}')) > 0),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {epochs})::BIGINT AS cap FROM d GROUP BY ALL),
root AS (SELECT 1 AS root, domain, sum(cap)::BIGINT AS cap, 1 AS weight, (SELECT least((sum(tokens) * {percent}) // 100, sum(cap))::BIGINT FROM leaves) AS total FROM leaves GROUP BY domain),
{level("t", "root", "root", "domain").strip()},
langs AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang {cases} ELSE 1 END AS weight FROM leaves GROUP BY domain, lang),
{level("m", "(SELECT langs.*, t.budget AS total FROM langs JOIN t ON t.domain = langs.domain)", "domain", "lang").strip()},
{level("b", "(SELECT leaves.domain, leaves.lang, leaves.source, leaves.tokens, leaves.cap, 1 AS weight, m.budget AS total FROM leaves JOIN m ON m.domain = leaves.domain AND m.lang = leaves.lang)", "domain, lang", "source").strip()},
p AS (SELECT d.*, (b.budget // b.tokens) AS whole, b.budget % b.tokens AS rest,
       ('0x' || substr(md5('{seed}:' || (b.budget // b.tokens)::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
      FROM d JOIN b ON b.domain = d.domain AND b.lang = d.lang AND b.source = d.source),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n ROWS UNBOUNDED PRECEDING) AS running FROM p),
e AS (SELECT *, unnest(generate_series(0, (whole + CASE WHEN running <= rest THEN 1 ELSE 0 END - 1)::BIGINT)) AS epoch FROM r)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n::BIGINT AS n_tokens FROM e
"""
