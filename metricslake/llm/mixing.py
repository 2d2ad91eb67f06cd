"""Mixing sources to target weights by hierarchical budgeting (operator 4).

Documents hang as leaves under a tree of levels (domain, language, source). A token budget
goes down the tree in proportion to the weights of the children of each node. A child whose
subtree cannot supply its share (its tokens times the allowed epochs) gives what it has, and
the shortage goes to its siblings in proportion to their weights; only what a whole subtree
lacks reaches the siblings of an ancestor. Each leaf then takes whole epochs and, from one
more epoch, the token-prefix of a seeded order of its documents.

All shares are whole tokens, computed in integers, so any engine gets the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricslake.llm.common import written

#: A leaf's documents are ordered in buckets of about so many.
BUCKET_ROWS = 2000
#: Number of values of the seeded order.
ORDER_RANGE = 1 << 60
NO_VALUE = "(none)"


def tokens_of(text: Column) -> Column:
    """White-space separated words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def name_of(id_col: str, text_col: str) -> Column:
    """What a document is ordered by: its id, or a hash of its text if it has none."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def order_of(seed: int, epoch: Column, name: Column) -> Column:
    """Place of a document in the seeded order of an epoch, from 0 to ORDER_RANGE."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def weight_of(level: str, weights: dict[str, int]) -> Column:
    """The integer weight of a node by its value, 1 if it is not named."""
    if not weights:
        return F.lit(1)
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], F.lit(kv[1])), weights.items(), F).otherwise(F.lit(1))


def _wide(name: str) -> str:
    return f"cast({name} as decimal(38,0))"


def _split(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``share``: each child's part of its parent's ``budget``, at most its ``cap``.

    Children come by cap for each unit of weight; the first ones are full as long as what is
    left would give them more than they have. The others divide the rest by weight, rounded
    so that the parts add up.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ascending = by.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0), child)
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    onward = ascending.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        children.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(onward))
        .withColumn("full", F.expr(f"{_wide('cap')} * {_wide('others')} <= {_wide('left')} * {_wide('weight')}"))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)))
        .withColumn("open", F.when(F.col("full"), 0).otherwise(F.col("weight")))
        .withColumn("all_open", F.sum("open").over(by))
        .withColumn("upto", F.sum("open").over(by.orderBy(child).rowsBetween(Window.unboundedPreceding, 0)))
    )
    part = f"({_wide('rest')} * {_wide('upto')}) div all_open - ({_wide('rest')} * {_wide('upto - open')}) div all_open"
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"case when all_open > 0 then {part} else 0 end"))
    return filled.withColumn("share", share.cast("long")).drop("left", "others", "full", "rest", "open", "all_open", "upto", "budget")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], fraction: tuple[int, int], epochs: int) -> DataFrame:
    """``leaves`` (levels, ``tokens``, ``docs``) with ``share``: the tokens each leaf has to give.

    The budget is ``fraction`` (numerator, denominator) of all tokens, at most what the tree
    can supply. A node of weight 0 supplies nothing.
    """
    weighed = leaves
    for level in levels:
        weighed = weighed.withColumn(f"w_{level}", weight_of(level, weights.get(level, {})))
    positive = reduce(lambda a, b: a & b, [F.col(f"w_{level}") > 0 for level in levels])
    weighed = weighed.withColumn("cap", F.when(positive, F.col("tokens") * epochs).otherwise(0).cast("long"))
    total = F.expr(f"cast(({_wide('sum(tokens)')} * {fraction[0]}) div {fraction[1]} as bigint)")
    above = weighed.agg(F.least(total, F.sum("cap")).alias("share"))
    for depth, level in enumerate(levels):
        parent, node = levels[:depth], levels[: depth + 1]
        children = weighed.groupBy(*node).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").cast("long").alias("weight"))
        given = above.select(*parent, F.col("share").alias("budget"))
        if parent:
            children = children.join(given, parent)
        else:
            children = children.withColumn("one", F.lit(1)).join(F.broadcast(given.withColumn("one", F.lit(1))), "one").drop("one")
        above = _split(children, parent, level)
    return leaves.join(above.select(*levels, "share"), levels)


def _prefixes(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], fraction: tuple[int, int], epochs: int, seed: int, id_col: str, text_col: str
) -> DataFrame:
    """Documents with a token, equal rows as one of several ``copies``: ``id``, the levels, ``n_tokens``, ``place``,
    ``whole`` and ``rest`` (epochs and tokens of the leaf's share) and ``begins`` (tokens before the first copy)."""
    names = list(levels)
    slim = written(
        docs.select(
            F.col(id_col).alias("id"),
            name_of(id_col, text_col).alias("name"),
            *[F.coalesce(c.cast("string"), F.lit(NO_VALUE)).alias(n) for n, c in levels.items()],
            tokens_of(F.col(text_col)).alias("n_tokens"),
        ).filter("n_tokens > 0"),
        "tokens",
    )
    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    given = (
        written(budgets(leaves, names, weights, fraction, epochs), "budgets")
        .withColumn("whole", F.expr("share div tokens"))
        .withColumn("rest", F.col("share") % F.col("tokens"))
        .withColumn("width", F.expr(f"{ORDER_RANGE} div ((docs + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}) + 1"))
    )
    placed = (
        slim.join(given.select(*names, "whole", "rest", "width"), names)
        .withColumn("place", order_of(seed, F.col("whole") + 1, F.col("name")))
        .withColumn("bucket", F.expr("place div width"))
    )
    by_leaf = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    starts = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(by_leaf), F.lit(0))).drop("in_bucket")
    # many copies would be one place, and so one task's rows: they are counted where they are read
    distinct = placed.groupBy(*names, "bucket", "place", "n_tokens", "id", "whole", "rest").agg(F.count("*").alias("copies"))
    within = Window.partitionBy(*names, "bucket").orderBy("place", "n_tokens", "id").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("start") + F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(within), F.lit(0))
    return distinct.join(starts, [*names, "bucket"]).withColumn("begins", begins).drop("start", "bucket")


def select(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    fraction: tuple[int, int] = (1, 2),
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What each document gives: one row for each row of ``docs`` that gives a token.

    Returns ``id_col``, the levels (text; null is ``(none)``), ``n_tokens``, ``epochs`` (whole
    passes), ``taken_tokens`` (of all passes; the last document of a leaf's prefix may give a part),
    ``place`` (in the order of the leaf's last epoch) and ``partial``: what it gives in that epoch.

    ``weights`` are integers by level and value, 1 where none is given. A null or empty text has no token
    and is not returned. Rows with the same id in a leaf have the same place, shorter ones first; rows
    without an id are ordered by their text. Other columns are not read, so their names may clash.
    """
    names = list(levels)
    found = _prefixes(docs, levels, weights, fraction, epochs, seed, id_col, text_col)
    several = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BUCKET_ROWS}"))
    each = F.sequence(F.col("_many") * BUCKET_ROWS, F.least(F.col("copies"), (F.col("_many") + 1) * BUCKET_ROWS) - 1)
    rows = found.withColumn("_many", F.explode(several)).withColumn("_copy", F.explode(each))
    begins = F.col("begins") + F.col("_copy") * F.col("n_tokens")
    partial = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - begins))
    return (
        rows.withColumn("partial", partial.cast("long"))
        .withColumn("taken_tokens", F.col("whole") * F.col("n_tokens") + F.col("partial"))
        .filter("taken_tokens > 0")
        .select(
            F.col("id").alias(id_col),
            *names,
            "n_tokens",
            (F.col("whole") + (F.col("partial") == F.col("n_tokens")).cast("long")).alias("epochs"),
            "taken_tokens",
            "place",
            "partial",
        )
    )


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    fraction: tuple[int, int],
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that one epoch of the mix takes, whole and with their own columns.

    A leaf's prefix is known by its last place, so ``docs`` are filtered by a table with a row for each
    leaf, and texts are not shuffled. Rows that share the last place (one id, or one text without an id)
    are drawn by a seeded chance, that of the share of them that the prefix takes.
    """
    names = [f"_level_{n}" for n in levels]
    found = _prefixes(docs, levels, weights, fraction, 1, seed, id_col, text_col)
    takes = F.greatest(F.lit(0), F.least(F.col("copies"), F.ceil((F.col("rest") - F.col("begins")) / F.col("n_tokens"))))
    leaf = [F.col(n).alias(k) for n, k in zip(levels, names)]
    places = found.groupBy(*leaf, "place").agg(F.sum(takes).alias("taken"), F.sum("copies").alias("copies"), F.max("whole").alias("whole"))
    ends = places.groupBy(*names).agg(
        (F.max("whole") > 0).alias("_whole"),
        F.max(F.when(F.col("taken") > 0, F.struct("place", (F.col("taken") / F.col("copies")).alias("part")))).alias("_last"),
    )
    keyed = docs.select("*", *[F.coalesce(c.cast("string"), F.lit(NO_VALUE)).alias(k) for c, k in zip(levels.values(), names)])
    place = order_of(seed, F.lit(1), name_of(id_col, text_col))
    last = (place == F.col("_last.place")) & ((F.col("_last.part") >= 1) | (F.rand(seed) < F.col("_last.part")))
    words = tokens_of(F.col(text_col)) > 0
    return keyed.join(written(ends, "prefixes"), names).filter(words & (F.col("_whole") | (place < F.col("_last.place")) | last)).select(*docs.columns)


def oracle(levels: dict[str, str], weights: dict[str, dict[str, int]], fraction: tuple[int, int], epochs: int, seed: int) -> str:
    """The rows of :func:`select` over ``documents`` in DuckDB SQL: one running sum for each leaf."""
    names = list(levels)
    cases = {
        n: "case " + " ".join(f"when {n} = '{v}' then {w}" for v, w in weights.get(n, {}).items()) + " else 1 end" if weights.get(n) else "1"
        for n in names
    }
    parts = [
        "d as (select doc_id, "
        + ", ".join(f"coalesce(({e})::varchar, '{NO_VALUE}') as {n}" for n, e in levels.items())
        + r", text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents)",
        f"""leaf as (select *, case when {" and ".join(f"w_{n} > 0" for n in names)} then tokens * {epochs} else 0 end as cap
  from (select {", ".join(names)}, sum(n_tokens)::hugeint as tokens, {", ".join(f"max({c})::hugeint as w_{n}" for n, c in cases.items())}
    from d where n_tokens > 0 group by all))""",
        f"s0 as (select least(sum(tokens) * {fraction[0]} // {fraction[1]}, sum(cap)) as share from leaf)",
    ]
    for depth, level in enumerate(names):
        parent, node = names[:depth], names[: depth + 1]
        over = f"partition by {', '.join(parent) or '1'}"
        up = f"{over} order by case when weight > 0 then cap::double / weight::double else 0 end, {level}"
        share = "(rest * upto) // nullif(whole, 0) - (rest * (upto - open)) // nullif(whole, 0)"
        parts.append(f"""s{depth + 1} as (
  select {", ".join(node)}, case when filled then cap else coalesce({share}, 0) end as share
  from (select *, sum(open) over ({over}) as whole, sum(open) over ({over} order by {level} rows unbounded preceding) as upto
    from (select *, case when filled then 0 else weight end as open,
        budget - coalesce(sum(cap) filter (where filled) over ({over}), 0) as rest
      from (select *, cap * sum(weight) over ({up} rows between current row and unbounded following)
          <= (budget - coalesce(sum(cap) over ({up} rows between unbounded preceding and 1 preceding), 0)) * weight as filled
        from (select {", ".join(f"c.{n}" for n in node)}, c.cap, c.weight, p.share as budget
          from (select {", ".join(node)}, sum(cap) as cap, max(w_{level}) as weight from leaf group by all) c
          join s{depth} p on {" and ".join(f"c.{n} = p.{n}" for n in parent) or "true"})))))""")
    parts.append(f"""placed as (
  select d.*, share // tokens as whole, share % tokens as rest,
    ('0x' || substr(md5(concat_ws(':', '{seed}', (share // tokens + 1)::varchar, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))))), 1, 15))::bigint as place
  from d join leaf using ({", ".join(names)}) join s{len(names)} using ({", ".join(names)}) where n_tokens > 0)""")
    parts.append(f"""run as (
  select *, greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) over (
    partition by {", ".join(names)} order by place, n_tokens rows between unbounded preceding and 1 preceding), 0)))::bigint as partial
  from placed)""")
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select doc_id, {", ".join(names)}, n_tokens, (whole + (partial = n_tokens)::int)::bigint as epochs,
  (whole * n_tokens + partial)::bigint as taken_tokens, place, partial
from run where whole * n_tokens + partial > 0"""
    )
