"""Mixing by soft membership: domain posteriors, then document rates that give each domain its target share.

A naive Bayes classifier learned from the labels table gives every document a probability of each domain. Projected
gradient descent then fits nonnegative rates whose expected tokens by domain match the targets. Both are DataFrame
code; the driver sees one row of sums for each step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, fresh, held_out, hot_joined, row_key, written

#: Domains of the labels table, in the order in which a document gets its label.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}


def domain_of(quality: Column, toxic: Column) -> Column:
    """toxic before low before clean; null where a label is missing and the other doesn't decide."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) & (toxic == 0), "clean")


def _features(docs: DataFrame, *carried: str) -> DataFrame:
    """(carried columns, n_tokens, feature): hashed distinct lower-case words of each text, and the tenth in which distinct words per
    word lies, so every row has one feature at least."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE), lambda w: w != "")
    counted = docs.select(*carried, words.alias("words")).select(*carried, F.size("words").cast("long").alias("n_tokens"), F.array_distinct("words").alias("words"))
    variety = F.concat(F.lit("\x00variety"), F.floor(F.lit(10.0) * F.size("words") / F.greatest("n_tokens", F.lit(1))).cast("string"))
    exploded = counted.select(*carried, "n_tokens", F.explode(F.concat("words", F.array(variety))).alias("w"))
    return exploded.select(*carried, "n_tokens", F.xxhash64("w").alias("feature"))


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id and domain; of several labels of one document the worst counts."""
    return (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .select("doc_id", domain_of(F.col("q"), F.col("t")).alias("domain"))
        .where("domain is not null")
    )


def _sample(rows: DataFrame, label: DataFrame, per_domain: int, max_chars: int) -> DataFrame:
    """text, domain of at most ``per_domain`` labelled documents of each domain, chosen by a hash of doc_id, whole; where a
    domain's have more than ``max_chars`` characters the longest are left out, but for its shortest."""
    sizes = rows.where((F.length("text") > 0) & ~held_out(F.col("doc_id"), 4)).groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    label = label.join(sizes, "doc_id")
    ids = None
    for d in DOMAINS:
        part = label.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        ids = part if ids is None else ids.unionByName(part)
    so_far = Window.partitionBy("domain").orderBy("chars", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ids = ids.withColumns({"total": F.sum("chars").over(so_far), "rank": F.row_number().over(so_far)}).where((F.col("total") <= max_chars) | (F.col("rank") == 1))
    return rows.where(F.length("text") > 0).join(F.broadcast(ids.select("doc_id", "domain")), "doc_id").select("text", "domain")


def posteriors(
    docs: DataFrame, labels: DataFrame, per_domain: int = 2000, max_chars: int = 40_000_000, support: int = 8, errors: float = 6.0, absence: float = 3.0
) -> DataFrame:
    """Each row of ``docs``: row_key, doc_id, n_tokens, p_<domain>.

    Learns from a bounded sample: ``per_domain`` labelled texts a domain, of ``max_chars`` characters a domain. Only features that
    surely tell a domain from the first one count, namely those in ``support`` texts or more whose share exceeds that in the first
    domain by ``errors`` standard errors, so their table (bounded by the sample) is broadcast; lacking a domain's features lowers
    its log odds by ``absence`` at most. ``support=0, errors=0, absence=inf`` gives the unpruned classifier of all features commoner
    in the domain. Null and wordless texts have no tokens and the prior; so has every text where no labels are. Rows are
    scored in one pass, without joining them to themselves.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    label = _labelled(labels)
    sample = written(_sample(rows, label, per_domain, max_chars), "mix-sample")
    count = lambda t: {r.domain: r.n for r in t.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    totals, everywhere = count(sample), count(label.where(~held_out(F.col("doc_id"), 4)))
    n = [totals.get(d, 0) for d in DOMAINS]
    prior = [(everywhere.get(d, 0) + 1) / (sum(everywhere.values()) + len(DOMAINS)) for d in DOMAINS]
    counts = _features(sample, "domain").groupBy("feature").agg(*(F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(DOMAINS)))
    weights, telling = [], F.lit(False)
    for k in range(1, len(DOMAINS)):
        p0, pk = (F.col("c0") + 0.5) / (n[0] + 1), (F.col(f"c{k}") + 0.5) / (n[k] + 1)
        both = (F.col("c0") + F.col(f"c{k}") + 0.5) / (n[0] + n[k] + 1)
        error = F.sqrt(both * (1 - both) * (1 / (n[0] + 1) + 1 / (n[k] + 1)))
        sure = (pk - p0 > errors * error) & (F.col("c0") + F.col(f"c{k}") >= support)
        telling = telling | sure
        absent = F.log((1 - pk) / (1 - p0))
        weights.append(F.when(sure, F.log(pk / p0) - absent).otherwise(0.0).alias(f"w{k}"))
        weights.append(F.when(sure, absent).otherwise(0.0).alias(f"a{k}"))
    table = written(counts.where(telling).select("feature", *weights), "mix-features")
    lacking = table.agg(*(F.sum(f"a{k}").alias(f"a{k}") for k in range(1, len(DOMAINS)))).first()
    start = [0.0] + [math.log(prior[k] / prior[0]) + max(-absence, lacking[f"a{k}"] or 0.0) for k in range(1, len(DOMAINS))]
    keyed = rows.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.monotonically_increasing_id().alias("row"))
    scored = (
        _features(keyed, "row", "row_key", "doc_id")
        .join(F.broadcast(table), "feature", "left")
        .groupBy("row", "row_key", "doc_id", "n_tokens")
        .agg(*(F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(1, len(DOMAINS))))
    )
    scores = [F.lit(0.0)] + [F.col(f"w{k}") + F.lit(start[k]) for k in range(1, len(DOMAINS))]
    top = F.greatest(*scores)
    scored = scored.select("row_key", "doc_id", "n_tokens", *(F.exp(s - top).alias(d) for s, d in zip(scores, DOMAINS, strict=True)))
    total = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    return scored.select("row_key", "doc_id", "n_tokens", *((F.col(d) / total).alias(f"p_{d}") for d in DOMAINS))


def rates(
    members: DataFrame, targets: dict[str, float], anchor: str = "clean", anchor_rate: float = 1.1, steps: int = 60, grain: int = 1000
) -> DataFrame:
    """``members`` (doc_id, n_tokens, p_<domain> and others) with their rate, number of copies, and ``gap``.

    The targets are shares of tokens; the whole is chosen so that the anchor domain gets ``anchor_rate`` times the
    tokens it has, so that documents surely in it keep a rate of 1 or more. From rates of 1, each step moves them
    against the gradient of the squared distance between the domains' expected tokens and their targets (documents
    weighted by length, domains by their tokens) and projects them to 0 or more. A rate depends on the posterior alone, so tokens are
    first added up by posterior, rounded to 1 / ``grain``, and the steps, one aggregate each, run over these few classes; every
    eighth they are written, so plans stay short. copies is the rate rounded up with a chance, from a hash of
    doc_id, equal to its fraction. ``gap`` is, on all rows alike, the largest distance of a domain's expected tokens from its
    target, as a share of its tokens: what ``steps`` steps left open, and rounding.
    """
    names = [f"p_{d}" for d in targets]
    taken = [fresh(members, f"_class_{p}") for p in names]
    rounded = members.withColumns({t: F.round(F.col(p) * grain).cast("int") for t, p in zip(taken, names, strict=True)})
    classes = rounded.groupBy(*taken).agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("size"), *(F.sum(F.col("n_tokens") * F.col(p)).alias(f"mass{k}") for k, p in enumerate(names))
    )
    classes = written(classes, "mix-classes")
    mass = [x or 0.0 for x in classes.agg(*(F.sum(f"mass{k}") for k in range(len(names)))).first()]
    at = list(targets).index(anchor)
    whole = anchor_rate * mass[at] / targets[anchor] if mass[at] else sum(mass)
    want = [whole * t / sum(targets.values()) for t in targets.values()]
    table, rate, gap = classes.withColumn("rate", F.lit(1.0)), F.col("rate"), 0.0
    for step in range(1, steps + 2):
        got = [x or 0.0 for x in table.agg(*(F.sum(rate * F.col(f"mass{k}")) for k in range(len(names)))).first()]
        left = [(g - w) / m if m else 0.0 for g, w, m in zip(got, want, mass, strict=True)]
        gap = max(map(abs, left))
        if gap < 1e-6 or step > steps:
            break
        move = sum((F.lit(x) * F.col(t) / float(grain) for x, t in zip(left[1:], taken[1:], strict=True)), F.lit(left[0]) * F.col(taken[0]) / float(grain))
        rate = F.greatest(F.lit(0.0), rate - move)
        if step % 8 == 0:
            table, rate = written(table.withColumn("rate", rate), "mix-rates"), F.col("rate")
    table = written(table.select(*taken, "size", rate.alias("rate")), "mix-rates")
    key = F.concat_ws(",", *taken)
    name, size = fresh(members, "_class"), fresh(members, "_size")
    joined = hot_joined(rounded.withColumn(name, key).drop(*taken), table.select(key.alias(name), F.col("size").alias(size), "rate"), name, size)
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("copies")), 11) / float(2**53)
    whole_part = F.floor("rate")
    copies = (whole_part + (chance < F.col("rate") - whole_part).cast("long")).cast("long")
    return joined.select(*members.columns, "rate", copies.alias("copies"), F.lit(gap).alias("gap"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Every row of ``docs``: row_key, doc_id, n_tokens, p_<domain>, rate, copies, gap (see :func:`rates`).

    ``targets``: share of tokens for each of DOMAINS. Null texts count as empty. Repeated rows are members each; an empty
    table gives no rows; without labels all documents have the same posterior and rate. Other columns are ignored.
    """
    members = written(posteriors(docs, labels), "mix-members")
    return rates(members, targets or TARGETS)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies, with the columns of ``docs``, whatever their names; rows with a null id once."""
    key, copies, nth = (fresh(docs, f"_{n}") for n in ("row_key", "copies", "nth"))
    plan = mix(docs, labels, targets).groupBy(F.col("row_key").alias(key)).agg(F.max("copies").alias(copies))
    rows = docs.withColumn(key, row_key(docs["doc_id"].cast("long"), docs["text"])).join(plan.hint("merge"), key)
    times = F.when(F.col("doc_id").isNull(), 1).otherwise(F.col(copies)).cast("int")
    return rows.withColumn(nth, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
