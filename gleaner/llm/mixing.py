"""Mixing sources to target weights: hierarchical budgeting over domain, language and source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import running_sum_by_hash
from gleaner.session import written

UNKNOWN = "und"
SEED = 11


@dataclass
class Leaf:
    """One source in one language below its domain."""

    domain: str
    lang: str
    source: str
    weight: float
    tokens: int
    repeats: int
    budget: float = 0.0
    path: tuple = field(init=False)

    def __post_init__(self) -> None:
        self.path = (self.domain, self.lang)

    @property
    def capacity(self) -> int:
        return self.tokens * self.repeats


def _spread(short: float, leaves: list[Leaf]) -> float:
    """Give ``short`` tokens to leaves with room, by weight; what no leaf can take is returned."""
    while short > 1e-6:
        room = [x for x in leaves if x.capacity - x.budget > 1e-6 and x.weight > 0]
        if not room:
            break
        total, left = sum(x.weight for x in room), 0.0
        for x in room:
            share = short * x.weight / total
            taken = min(share, x.capacity - x.budget)
            x.budget += taken
            left += share - taken
        short = left
    return max(short, 0.0)


def plan_budgets(leaves: list[Leaf], total: float) -> None:
    """Set each leaf's budget: its weight's part of ``total``; shortages go to siblings, then to the ancestors' other leaves."""
    by_lang: dict[tuple, float] = {}
    for x in leaves:
        wanted = total * x.weight
        x.budget = min(wanted, x.capacity)
        by_lang[x.path] = by_lang.get(x.path, 0.0) + wanted - x.budget
    by_domain: dict[str, float] = {}
    for path, short in by_lang.items():
        left = _spread(short, [x for x in leaves if x.path == path])
        by_domain[path[0]] = by_domain.get(path[0], 0.0) + left
    rest = 0.0
    for domain, short in by_domain.items():
        rest += _spread(short, [x for x in leaves if x.domain == domain])
    _spread(rest, leaves)


def full_total(leaves: list[Leaf]) -> float:
    """The largest total at which no source that has tokens falls short of its share."""
    there = [x for x in leaves if x.capacity]
    if not there:
        return 0.0
    low, high = 0.0, float(sum(x.capacity for x in there))
    for _ in range(100):  # a shortage only grows with the total
        middle = (low + high) / 2
        ok = all(middle * x.weight <= x.capacity * (1 + 1e-12) for x in there)
        if ok:
            plan_budgets(leaves, middle)
            ok = abs(sum(x.budget for x in leaves) - middle) <= 1e-6 * max(1.0, middle)
        low, high = (middle, high) if ok else (low, middle)
    return low


def source_name(name: Column) -> Column:
    """Sources differ neither by letter case nor by blanks around them."""
    return F.lower(F.regexp_replace(name, r"^[\s ]+|[\s ]+$", ""))


def language(lang: Column) -> Column:
    """The two-letter code a language tag begins with, else 'und'."""
    code = F.regexp_extract(F.lower(lang), r"^\s*([a-z]{2})(?![a-z])", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit(UNKNOWN))


def mix(
    sizes: DataFrame, targets: DataFrame, total_tokens: dict[str, int] | None = None, seed: int = SEED
) -> DataFrame:
    """(mix_id, source, lang, doc_id, n_tokens, uses): the records of every mix and how often each is used.

    ``sizes`` has doc_id, source, lang and n_tokens, ``targets`` mix_id,
    source, target_share and max_repeats. A source's share is divided over its
    languages by their tokens. Shortages of a leaf go to the other sources of
    its language and domain (the word before the first underscore), then to the
    domain, then to the whole mix; sources without documents are short of all.
    ``total_tokens`` gives a mix's size; by default it is the largest at which
    every source that has documents holds its share within ``max_repeats``.

    A leaf uses whole epochs of its documents and of the last epoch, in the
    order of a hash of seed, mix, epoch and id, the prefix that fits into the
    rest of the budget. What whole documents leave over in a leaf goes to the
    other languages of its source: in further passes the source's shorter
    documents behind the prefix fill what is left until none fits, and a last
    pass comes as near as it can. Documents without source, id or tokens are not
    used, nor targets without share; null repeats count as 1. Equal doc_ids
    are one document. An empty table gives no rows.

    The driver sees one row per target and language (two-letter codes), never documents.
    """
    targets = targets.select("mix_id", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats"))
    targets = targets.where("mix_id is not null and source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0")
    wanted = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    docs = (
        sizes.select("doc_id", source_name(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), "n_tokens")
        .where("doc_id is not null and n_tokens > 0")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("source", "lang", "n_tokens"), F.struct("source", "lang", "n_tokens")).alias("d"))
        .select("doc_id", "d.*")
    )
    held = {}
    for r in docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).join(wanted.select("source").distinct(), "source").collect():
        held.setdefault(r["source"], {})[r["lang"]] = r["tokens"]
    mixes: dict[str, list[Leaf]] = {}
    for r in wanted.orderBy("mix_id", "source").collect():
        langs, domain = held.get(r["source"], {}), r["source"].split("_")[0]
        own = sum(langs.values())
        mixes.setdefault(r["mix_id"], []).extend(
            [Leaf(domain, lang, r["source"], r["share"] * tokens / own, tokens, r["repeats"]) for lang, tokens in sorted(langs.items())]
            or [Leaf(domain, UNKNOWN, r["source"], r["share"], 0, r["repeats"])]
        )
    plan = []
    for mix_id, leaves in mixes.items():
        shares = sum(x.weight for x in leaves)
        for x in leaves:
            x.weight /= shares
        plan_budgets(leaves, (total_tokens or {}).get(mix_id) or full_total(leaves))
        for x in leaves:
            budget = int(round(x.budget))
            if x.tokens:
                epochs = min(budget // x.tokens, x.repeats)
                spare = epochs < x.repeats
                plan.append((mix_id, x.source, x.lang, epochs, budget - epochs * x.tokens if spare else 0, spare))
    spark = sizes.sparkSession
    plan_df = spark.createDataFrame(plan, "mix_id string, source string, lang string, epochs long, rest long, spare boolean")
    # one row per target and language
    pool = docs.join(F.broadcast(plan_df), ["source", "lang"]).withColumn("__key", F.xxhash64(F.lit(seed), "mix_id", "epochs", "doc_id"))
    pool = written(_placed(pool.withColumn("more", F.lit(0).cast("long")), ["mix_id", "source", "lang"], last=False))
    asked = {}
    for x in plan:
        asked[x[:2]] = asked.get(x[:2], 0) + x[4]
    while True:
        # one row per target: what is left of its last epochs, and the shortest of its documents that can still be used
        free = F.when(F.col("spare") & (F.col("more") == 0), F.col("n_tokens"))
        now = pool.groupBy("mix_id", "source").agg(F.sum(F.when(F.col("more") == 1, F.col("n_tokens")).otherwise(0)).alias("used"), F.min(free).alias("shortest")).collect()
        left = [(r["mix_id"], r["source"], asked[r["mix_id"], r["source"]] - r["used"], r["shortest"]) for r in now]
        more = any(n and n <= rest for _, _, rest, n in left)
        rests = spark.createDataFrame([x[:3] for x in left], "mix_id string, source string, rest long")
        pool = written(_placed(pool.drop("rest").join(F.broadcast(rests), ["mix_id", "source"]), ["mix_id", "source"], last=not more))
        if not more:
            break
    uses = F.col("epochs") + F.col("more")
    return pool.withColumn("uses", uses).where("uses > 0").select("mix_id", "source", "lang", "doc_id", "n_tokens", "uses")


def _placed(pool: DataFrame, group: list[str], last: bool) -> DataFrame:
    """Marks the prefix of each group's free documents that fits into its rest; the last pass goes over it where that comes nearer."""
    fits = f"spare and more = 0 and n_tokens <= {2 if last else 1} * rest"
    placed = running_sum_by_hash(pool.where(fits), group, "__key", ["doc_id"], "n_tokens", "__before")
    near = F.col("__before") + (F.col("n_tokens") / 2 if last else F.col("n_tokens")) <= F.col("rest")
    return pool.where(f"not ({fits})").unionByName(placed.withColumn("more", near.cast("long")).drop("__before"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, records, tokens, reached_share, most_uses), one row for each target."""
    reached = mixed.groupBy("mix_id", "source").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    whole = reached.groupBy("mix_id").agg(F.sum("tokens").alias("__all"))
    return (
        targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share")
        .join(reached, ["mix_id", "source"], "left")
        .join(whole, "mix_id", "left")
        .select(
            "mix_id", "source", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("reached_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
