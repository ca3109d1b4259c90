"""Mixture of mean images: likelihoods, expectation steps and edits.

Layout: sub-frames are spread by ``sf_id`` once. Everything that is per
sub-frame (copies, models, edits) is then grouped by keys that contain it and
stays where it is. What is joined to the data (gains per model pixel and
value) grows with the models and the value range only; it is written, counted,
and broadcast when its size allows.

``sf`` tables are (sf_id, x, z, hp, value); ``models`` are (m, hp, level) and,
where neighbours matter, also x, z; ``table`` is (level, value, lp) in natural
logs. Likelihoods are in log2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from honeyframe.functions import hexgrid as H, tables as T
from honeyframe.functions.numbers import exp2
from honeyframe.operators.numbering import scalar
from honeyframe.operators.pixels import neighbor_join, offsets_within
from honeyframe.operators.runs import finish_models, parabola_vertex
from honeyframe.operators.symmetry import expand_orbit
from honeyframe.session import Store, apart, bounded, cut_lineage, spread

LN2 = math.log(2.0)

# -- likelihood -----------------------------------------------------------------


def _with_gains(data: DataFrame, gains: DataFrame, key: str = "m", max_bytes: int = 64 << 20) -> DataFrame:
    """Join data with gains (key, hp, value, ...) and never shuffle the data.

    All models of a pixel and value are one row, a list. Models are cut into
    blocks whose lists fit a broadcast, by their measured size; one block is
    the rule. The size of one model is set by the frame and the value range.
    """
    g = cut_lineage(gains)
    rest = [c for c in g.columns if c not in ("hp", "value")]
    sizes = sorted((r[key], r["count"]) for r in g.groupBy(key).count().collect())  # one row per model or edit
    row = g.select(*rest)._jdf.schema().defaultSize() + 16
    blocks, fill = [], max_bytes + 1
    for k, n in sizes:
        if fill + n * row > max_bytes:
            blocks.append([])
            fill = 0
        blocks[-1].append(k)
        fill += n * row
    out = None
    for block in blocks or [[]]:
        part = g if len(blocks) < 2 else g.filter(F.col(key).between(block[0], block[-1]))
        lists = part.groupBy("hp", "value").agg(F.collect_list(F.struct(*rest)).alias("_of"))
        d = data.join(F.broadcast(lists), ["hp", "value"])
        d = d.select(*[F.col(c) for c in data.columns], F.inline("_of"))
        out = d if out is None else out.unionByName(d)
    return out


def lookup_logp(sf: DataFrame, models: DataFrame, table: DataFrame) -> DataFrame:
    """(sf_id, m, hp, value, level, lp) of the frames as they lie."""
    gains = models.join(table, "level")  # models x values
    return _with_gains(sf.select("sf_id", "hp", "value"), gains)


def _summed(orb: DataFrame, gains: DataFrame, base: dict[int, float] | None = None, at_once: int = 32) -> DataFrame:
    """(sf_id, m, sym, ll): sums over the pixels of ``orb`` (sf_id, sym, hp, value) of
    the gains (m, hp, value, _g), plus a constant of each model.

    The gains of ``at_once`` models are the columns of one row, so a pixel stays one row
    whatever the number of models, and models only become rows after the sum. A value
    without gains is an error: it would drop out of the likelihood in silence.
    """
    g = gains
    models = sorted(base) if base is not None else sorted(r["m"] for r in g.select("m").distinct().collect())
    missing = F.raise_error(F.lit("a value of the data has no row in the probability table")).cast("double")
    out = None
    for lo in range(0, max(len(models), 1), at_once):
        part = models[lo : lo + at_once]
        if not part:
            return orb.select("sf_id", F.lit(0).cast("long").alias("m"), "sym", F.lit(0.0).alias("ll")).limit(0)
        rows = g.filter(F.col("m").isin(part)) if len(models) > at_once else g
        cols = [f"_g{i}" for i in range(len(part))]
        wide = rows.groupBy("hp", "value").agg(
            *[F.coalesce(F.sum(F.when(F.col("m") == m, F.col("_g"))), F.lit(0.0)).alias(c) for m, c in zip(part, cols)]
        )
        d = orb.join(bounded(wide), ["hp", "value"], "left").withColumn(cols[0], F.coalesce(cols[0], missing))
        d = d.groupBy("sf_id", "sym").agg(*[F.sum(c).alias(c) for c in cols])
        one = [F.struct(F.lit(m).cast("long").alias("m"), (F.col(c) + F.lit((base or {}).get(m, 0.0))).alias("ll")) for m, c in zip(part, cols)]
        d = d.select("sf_id", "sym", F.inline(F.array(*one))).select("sf_id", "m", "sym", "ll")
        out = d if out is None else out.unionByName(d)
    return out


def orbit_loglik(sf: DataFrame, models: DataFrame, table: DataFrame, n: int, bond: int) -> DataFrame:
    """log2 likelihood of each sub-frame under each model and copy, from all
    pixels. The cheaper way to the same numbers is baseline_loglik."""
    orb = expand_orbit(spread(sf, "sf_id"), n, bond, inverse=True)
    gains = models.join(table, "level").select("m", "hp", "value", (F.col("lp") / LN2).alias("_g"))
    return _summed(orb, gains)


def _sparse(sf: DataFrame) -> DataFrame:
    """Pixels with counts; position 0 stays so that no sub-frame is lost."""
    return sf.filter((F.col("value") > 0) | (F.col("hp") == 0))


def baseline_loglik(sf: DataFrame, models: DataFrame, table: DataFrame, n: int, bond: int) -> DataFrame:
    """Same as orbit_loglik: the likelihood of an empty frame per model, plus a
    correction for the pixels with counts. Most pixels of a noisy frame are
    empty, and those never enter the expansion."""
    zero = table.filter(F.col("value") == 0).select("level", F.col("lp").alias("_z"))
    rows = models.join(zero, "level").groupBy("m").agg((F.sum("_z") / LN2).alias("b")).collect()  # one row per model
    gains = models.join(table.join(zero, "level"), "level").select(
        "m", "hp", "value", ((F.col("lp") - F.col("_z")) / LN2).alias("_g")
    )
    orb = expand_orbit(spread(_sparse(sf), "sf_id"), n, bond, inverse=True)
    return _summed(orb, gains, {r["m"]: r["b"] for r in rows})


def marginal_loglik(ll: DataFrame, mode: str = "sum") -> DataFrame:
    """Sum (log-sum-exp) or maximum over the copies of a model."""
    if mode == "max":
        return ll.groupBy("sf_id", "m").agg(F.max("ll").alias("marg"))
    # the copies of one sub-frame and model: a fixed, small number of rows
    top = F.max("ll").over(W.partitionBy("sf_id", "m"))
    d = ll.withColumn("_t", top).withColumn("_e", exp2(F.col("ll") - F.col("_t")))
    return d.groupBy("sf_id", "m").agg((F.max("_t") + F.log2(F.sum("_e"))).alias("marg"))


def _best_model(marg: DataFrame, *extra: Column) -> Column:
    return F.max(F.struct(F.round("marg", 9).alias("r"), (-F.col("m")).alias("nm"), *extra))


def frame_loglik(marg: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """log2 likelihood of each sub-frame: weighted over the models, or of the
    best model only without weights."""
    if weights is None:
        return marg.groupBy("sf_id").agg(F.max("marg").alias("ll"))
    d = marg.join(bounded(weights.select("m", F.log2("weight").alias("_lw"))), "m")
    d = d.withColumn("_v", F.col("marg") + F.col("_lw"))
    d = d.withColumn("_t", F.max("_v").over(W.partitionBy("sf_id")))
    return d.groupBy("sf_id").agg((F.max("_t") + F.log2(F.sum(exp2(F.col("_v") - F.col("_t"))))).alias("ll"))


def mixture_loglik(
    marg: DataFrame, weights: DataFrame | None = None, n_sym: int = 1, offset: float = 0.0, pixels: int = 0,
    scale: float = 1.0,
) -> DataFrame:
    """Total log2 likelihood of the data.

    The constant part takes off log2 of the number of copies per frame, and
    puts back the offset of the table for every pixel.
    """
    const = pixels * offset / LN2 - math.log2(n_sym)
    return frame_loglik(marg, weights).agg(
        ((F.sum("ll") + F.count(F.lit(1)) * const) * scale).alias("total"), F.count(F.lit(1)).alias("frames")
    )


def assign_cases(marg: DataFrame) -> DataFrame:
    """Best model of each sub-frame, the smaller index on a tie."""
    b = marg.groupBy("sf_id").agg(_best_model(marg, F.col("marg")).alias("b"))
    return b.select("sf_id", (-F.col("b.nm")).alias("m"), F.col("b.marg").alias("marg"))


def count_cases(cases: DataFrame) -> DataFrame:
    return cases.groupBy("m").agg(F.count(F.lit(1)).alias("cases"))


def weights_from_cases(cases: DataFrame, models: DataFrame) -> DataFrame:
    """Weights = case shares; a model without cases gets weight 0."""
    n = count_cases(cases)
    d = models.select("m").distinct().join(n, "m", "left").withColumn("cases", F.coalesce("cases", F.lit(0)))
    d = cut_lineage(d)  # one row per model, read twice
    return d.select("m", "cases", (F.col("cases") / scalar(d, F.sum("cases"))).alias("weight"))


def responsibilities(marg: DataFrame, hard: bool = False) -> DataFrame:
    """Share c of each model in a sub-frame and the contribution made of it,
    2 / (1 + 100 (1.1 - c)^2). ``hard`` gives 1 to the best model and 0 to the
    others; on a tie odd sub-frames take the last, even ones the first."""
    w = W.partitionBy("sf_id")  # one row per model
    if hard:
        r = F.round("marg", 9)
        d = marg.withColumn("_top", r == F.max(r).over(w))
        pick = F.when(F.col("sf_id") % 2 == 1, F.max(F.when(F.col("_top"), F.col("m"))).over(w)).otherwise(
            F.min(F.when(F.col("_top"), F.col("m"))).over(w)
        )
        hit = (F.col("m") == pick).cast("double")
        return d.select("sf_id", "m", "marg", hit.alias("share"), hit.alias("contribution"))
    d = marg.withColumn("_e", exp2(F.col("marg") - F.max("marg").over(w)))
    share = F.col("_e") / F.sum("_e").over(w)
    d = d.withColumn("share", share)
    return d.select(
        "sf_id", "m", "marg", "share",
        (F.lit(2.0) / (1 + 100 * F.pow(1.1 - F.col("share"), 2))).alias("contribution"),
    )


def copy_weights(ll: DataFrame, resp: DataFrame, mode: str = "sum") -> DataFrame:
    """Weight of each copy of each sub-frame for its model: the contribution
    times the share of the copy. With ``max`` only the best copy counts."""
    d = apart(ll).join(resp.filter(F.col("contribution") > 0).select("sf_id", "m", "marg", "contribution"), ["sf_id", "m"])
    if mode == "max":
        w = W.partitionBy("sf_id", "m").orderBy(F.round("ll", 9).desc(), "sym")
        d = d.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1)
        return d.select("sf_id", "m", "sym", F.col("contribution").alias("w"))
    return d.select("sf_id", "m", "sym", (F.col("contribution") * exp2(F.col("ll") - F.col("marg"))).alias("w"))


def em_models(
    sf: DataFrame, ll: DataFrame, resp: DataFrame, n: int, bond: int, low: float, high: float, levels: int,
    mode: str = "sum", pixels: DataFrame | None = None,
) -> DataFrame:
    """Expected models: mean of the data moved back into the model frame,
    weighted by contribution and copy. Gives (m, hp, mean, level).

    Only pixels with counts enter the sums; the total weight of a model is the
    sum of its contributions, whatever the pixel.
    """
    w = copy_weights(ll, resp, mode)
    orb = expand_orbit(_sparse(sf), n, bond, inverse=True)
    if pixels is not None:
        orb = orb.join(pixels.select("hp").distinct(), "hp", "left_semi")
    s = apart(orb).join(w, ["sf_id", "sym"]).groupBy("m", "hp").agg(F.sum(F.col("w") * F.col("value")).alias("_s"))
    total = resp.groupBy("m").agg(F.sum("contribution").alias("_w"))
    if pixels is None:
        grid = total.select("m", "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3 * n * n - 1).cast("long"))).alias("hp"))
    else:
        grid = pixels.select("m", "hp").distinct().join(total, "m")
    mean = F.coalesce("_s", F.lit(0.0)) / F.nullif(F.col("_w"), F.lit(0.0))
    d = grid.join(s, ["m", "hp"], "left").select("m", "hp", mean.alias("mean"))
    return d.filter(F.col("mean").isNotNull()).withColumn("level", T.intensity_to_level("mean", low, high, levels))


def em_pixel(sf, ll, resp, pixels: DataFrame, n, bond, low, high, levels, mode="sum") -> DataFrame:
    """em_models for the chosen (m, hp) only."""
    return em_models(sf, ll, resp, n, bond, low, high, levels, mode, pixels)


def expected_histogram(ll: DataFrame, sf: DataFrame, models: DataFrame, n: int, bond: int) -> DataFrame:
    """Posterior-weighted counts of (level, value) pairs, divided by the number
    of model pixels that have the level.

    Every pixel of a model sees one value of each copy, so the weight of the value 0 is
    what the other values leave of the whole: empty pixels never enter the expansion.
    """
    w = W.partitionBy("sf_id")  # models x copies
    d = ll.withColumn("_e", exp2(F.col("ll") - F.max("ll").over(w)))
    post = cut_lineage(d.select("sf_id", "m", "sym", (F.col("_e") / F.sum("_e").over(w)).alias("w")))
    orb = expand_orbit(sf.filter(F.col("value") > 0), n, bond, inverse=True)
    s = orb.join(post, ["sf_id", "sym"]).groupBy("m", "hp", "value").agg(F.sum("w").alias("_s"))
    some = cut_lineage(s.join(models.select("m", "hp", "level"), ["m", "hp"]).groupBy("level", "value").agg(F.sum("_s").alias("_p")))
    pixels = models.groupBy("m", "level").agg(F.count(F.lit(1)).alias("_n"))
    whole = pixels.join(post.groupBy("m").agg(F.sum("w").alias("_w")), "m").groupBy("level").agg(
        F.sum(F.col("_n") * F.col("_w")).alias("_all"), F.sum("_n").alias("_n")
    )
    seen = some.groupBy("level").agg(F.sum("_p").alias("_seen"))
    rest = F.col("_all") - F.coalesce("_seen", F.lit(0.0))
    zero = whole.join(seen, "level", "left").filter(rest > 1e-12 * F.col("_all")).select("level", F.lit(0).cast("long").alias("value"), rest.alias("_p"))
    return some.withColumn("value", F.col("value").cast("long")).unionByName(zero).join(whole.select("level", "_n"), "level").select(
        "level", "value", (F.col("_p") / F.col("_n")).alias("p")
    )


# -- edits ------------------------------------------------------------------------


def home_pixels(spark: SparkSession, n: int) -> DataFrame:
    """(hp, x, z) of the home hexagon of radius n."""
    d = spark.range(-n, n).select(F.col("id").cast("int").alias("x"))
    d = d.select("x", F.explode(F.sequence(F.lit(-n), F.lit(n - 1))).alias("z")).withColumn("y", -F.col("x") - F.col("z"))
    return d.filter(H.in_home("x", "y", "z", n)).select(H.hex_index("x", "z", n).alias("hp"), "x", "z")


class EditPosts:
    """What edits (edit, m, hp, old, new) change in the likelihoods.

    ``owner`` (edit, m, base): the change of an empty frame, the same for all
    sub-frames and copies. ``deltas`` (sf_id, edit, m, sym, delta): what the counts at
    changed places add to it, only for copies that have counts there.

    The changed pixels are moved under the copies, not the frames: each (place, value)
    of the data gets the posting list of the edits that look at it, and a frame's
    pixel meets its list only. Lists are cut by edits into parts whose measured size
    can be broadcast. Frames that lie by sub-frame are not shuffled.
    """

    def __init__(self, edits: DataFrame, table: DataFrame, n: int, bond: int, store: Store, max_bytes: int = 64 << 20):
        old = table.select(F.col("level").alias("old"), "value", F.col("lp").alias("_lo"))
        new = table.select(F.col("level").alias("new"), "value", F.col("lp").alias("_ln"))
        step = edits.join(old, "old").join(new, ["new", "value"]).select(
            "edit", "m", "hp", "value", ((F.col("_ln") - F.col("_lo")) / LN2).alias("_d")
        )
        step = store.write(step)  # edits x values
        zero = step.filter(F.col("value") == 0).select("edit", "hp", F.col("_d").alias("_z"))
        self.owner = store.write(edits.select("edit", "m").distinct().join(zero.groupBy("edit").agg(F.sum("_z").alias("base")), "edit"))
        gains = step.join(zero, ["edit", "hp"]).filter((F.col("value") > 0) & (F.col("_d") != F.col("_z"))).select(
            "edit", "m", "hp", "value", (F.col("_d") - F.col("_z")).alias("_g")
        )
        moved = expand_orbit(gains.join(F.broadcast(home_pixels(edits.sparkSession, n)), "hp"), n, bond, keys=["edit", "m"], carry=["value", "_g"])
        self.posts = store.write(moved.groupBy("hp", "value").agg(F.collect_list(F.struct("edit", "m", "sym", "_g")).alias("_of"), F.count(F.lit(1)).alias("_n")))
        self.parts = max(1, -(-(self.posts.agg(F.sum("_n")).first()[0] or 0) * 40 // max_bytes))
        store.drop(step)

    def deltas(self, sf: DataFrame, only: DataFrame | None = None) -> list[DataFrame]:
        """One table for each part of the edits, or one of ``only`` some edits."""
        data, lists, out = sf.filter(F.col("value") > 0).select("sf_id", "hp", "value"), self.posts.drop("_n"), []
        if only is not None:
            rows = lists.select("hp", "value", F.inline("_of")).join(F.broadcast(only), "edit", "left_semi")
            lists = rows.groupBy("hp", "value").agg(F.collect_list(F.struct("edit", "m", "sym", "_g")).alias("_of"))
        for k in range(1 if only is not None else self.parts):
            mine = lists
            if only is None and self.parts > 1:
                part = F.filter("_of", lambda e: F.pmod(F.xxhash64(e["edit"]), F.lit(self.parts)) == k)
                mine = lists.withColumn("_of", part).filter(F.size("_of") > 0)
            d = data.join(F.broadcast(mine), ["hp", "value"]).select("sf_id", F.inline("_of"))
            out.append(d.groupBy("sf_id", "edit", "m", "sym").agg(F.sum("_g").alias("delta")))
        return out


def _both(a: Column, b: Column, weighted: bool) -> Column:
    """log2 of the sum of two numbers given as logs, or the larger one."""
    top = F.greatest(a, b)
    return top + F.log2(exp2(a - top) + exp2(b - top)) if weighted else top


def frame_terms(marg: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(sf_id, m, marg, own, others): the term of a model in its sub-frame, and that
    of all other models together (of the best one without weights)."""
    d, own = marg.select("sf_id", "m", "marg"), F.col("marg")
    if weights is not None:
        d = d.join(bounded(weights.select("m", F.log2("weight").alias("_lw"))), "m")
        own = own + F.col("_lw")
    frame = W.partitionBy("sf_id")  # one row per model
    d = d.withColumn("own", own).withColumn("_place", F.row_number().over(frame.orderBy(F.desc("own"), "m")))
    none = F.lit(-1e300)
    second = F.coalesce(F.max(F.when(F.col("_place") > 1, F.col("own"))).over(frame), none)
    d = d.withColumns({"_top": F.max("own").over(frame), "_second": second})
    if weights is None:
        others = F.when(F.col("_place") == 1, F.col("_second")).otherwise(F.col("_top"))
    else:
        # the models but one are the best and the sum without the one, or that sum
        sum_ = F.sum(F.when(F.col("_place") > 1, exp2(F.col("own") - F.col("_second")))).over(frame)
        d = d.withColumn("_rest", F.when(F.col("_second") > none, F.col("_second") + F.log2(sum_)).otherwise(none))
        less = F.greatest(1 + exp2(F.col("_rest") - F.col("_top")) - exp2(F.col("own") - F.col("_top")), F.lit(1.0))
        others = F.when(F.col("_place") == 1, F.col("_rest")).otherwise(F.col("_top") + F.log2(less))
    return d.select("sf_id", "m", "marg", "own", others.alias("others"))


def _frame_rows(ll: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per sub-frame: the share of each copy in its model (model by model), and
    for each model its marginal, own term and the others'."""
    shares = apart(ll).join(terms, ["sf_id", "m"]).withColumn("share", exp2(F.col("ll") - F.col("marg")))
    d = shares.groupBy("sf_id").agg(F.sort_array(F.collect_list(F.struct("m", "sym", "share", "marg", "own", "others"))).alias("_a"))
    first = F.filter("_a", lambda e: e["sym"] == 0)
    return d.select("sf_id", F.transform("_a", lambda e: e["share"]).alias("_shares"), first.alias("_models"))


def score_with(
    sf: DataFrame, ll: DataFrame, terms: DataFrame, posts: EditPosts, n_sym: int, weighted: bool, store: Store
) -> DataFrame:
    """(edit, m, total, gain) of the edits behind ``posts``.

    Copies without counts at changed places only differ by the base of an edit. So of
    a marginal only the copies with a delta are read, and the others keep what is left
    of the sum; where that is less than a millionth, the difference has no digits
    left, and all copies are summed. Sub-frames without any delta are summed as they
    are, and the others put right.
    """
    models = sorted(r["m"] for r in terms.select("m").distinct().collect())  # one row per model
    base = bounded(posts.owner)
    own, others = F.col("own") + F.col("base"), F.col("others")
    every = terms.join(base, "m").groupBy("edit", "m").agg(
        F.sum(_both(others, own, weighted)).alias("_t"), F.sum(_both(others, F.col("own"), weighted)).alias("_b")
    )
    place = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, i)])
    frames = store.write(_frame_rows(ll, terms))
    found = []
    for d in posts.deltas(sf):
        d = d.join(frames.hint("shuffle_hash"), "sf_id").withColumn("_i", F.element_at(place, F.col("m")))
        share = F.get("_shares", F.col("_i") * n_sym + F.col("sym"))
        per = d.groupBy("sf_id", "edit", "m").agg(
            F.sum(share).alias("_had"), F.sum(share * exp2(F.col("delta"))).alias("_has"), F.count(F.lit(1)).alias("_n"),
            F.first(F.get("_models", F.col("_i"))).alias("_of"),
        )
        left = F.when(F.col("_n") == n_sym, 0.0).otherwise(1 - F.col("_had"))
        found.append(store.write(per.select(
            "sf_id", "edit", "m", left.alias("_left"), "_has", ((F.col("_n") < n_sym) & (left < 1e-6)).alias("_hard"), "_of.marg", "_of.own", "_of.others"
        )))
    some = found[0]
    for f in found[1:]:
        some = some.unionByName(f)
    change = some.filter(~F.col("_hard")).select("sf_id", "edit", "m", "own", "others", F.log2(F.col("_left") + F.col("_has")).alias("change"))
    hard = some.filter("_hard").select("sf_id", "edit", "m", "marg", "own", "others")
    if not hard.isEmpty():
        deltas = posts.deltas(sf, hard.select("edit").distinct())[0]
        d = apart(apart(hard).join(ll, ["sf_id", "m"])).join(deltas, ["sf_id", "edit", "m", "sym"], "left")
        d = d.withColumn("_v", F.col("ll") + F.coalesce("delta", F.lit(0.0)))
        d = d.withColumn("_t", F.max("_v").over(W.partitionBy("sf_id", "edit")))  # the copies
        change = change.unionByName(d.groupBy("sf_id", "edit", "m").agg(
            F.max("own").alias("own"), F.max("others").alias("others"),
            (F.max("_t") + F.log2(F.sum(exp2(F.col("_v") - F.col("_t")))) - F.max("marg")).alias("change"),
        ))
    right = _both(others, own + F.col("change"), weighted) - _both(others, own, weighted)
    put = change.join(base.select("edit", "base"), "edit").groupBy("edit", "m").agg(F.sum(right).alias("_t"), F.lit(0.0).alias("_b"))
    out = store.write(every.unionByName(put).groupBy("edit", "m").agg(F.sum("_t").alias("total"), (F.sum("_t") - F.sum("_b")).alias("gain")))
    store.drop(frames, *found)
    return out


def score_edits(
    sf: DataFrame, ll: DataFrame, marg: DataFrame, edits: DataFrame, table: DataFrame, n: int, bond: int,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Total likelihood after each proposed edit (edit, m, hp, old, new): (edit, m,
    total, gain). Only counts at changed places are looked at (``EditPosts``)."""
    store = Store(sf.sparkSession)
    terms = store.write(frame_terms(marg, weights))
    posts = EditPosts(edits, table, n, bond, store)
    out = score_with(spread(sf, "sf_id"), ll, terms, posts, 12 * len(H.lattice_points(n, bond)), weights is not None, store)
    store.drop(terms, posts.owner, posts.posts)
    return out


def neighbor_means(models: DataFrame, n: int) -> DataFrame:
    """Rounded mean of each model pixel and its six neighbours, wrapped."""
    pushed = neighbor_join(models, n, [(0, 0), *H.NEIGHBOURS], keys=["m"], carry=["level"])
    return pushed.groupBy("m", "x", "z").agg(F.round(F.avg("level")).cast("long").alias("mean"))


def propose_steps(models: DataFrame, pixels: DataFrame, n: int, levels: int, reach: int = 5) -> DataFrame:
    """Trial levels of the chosen (m, hp): the neighbour mean first, then steps
    of 1 to ``reach`` to both sides. One row per trial; levels stay in range and
    differ from the present one."""
    d = models.join(pixels.select("m", "hp").distinct(), ["m", "hp"], "left_semi")
    d = d.join(neighbor_means(models, n), ["m", "x", "z"])
    steps = F.array_sort(F.array(*[F.struct(F.lit(2 * k - (s > 0)).alias("trial"), F.lit(s * k).alias("step"))
                                   for k in range(1, reach + 1) for s in (1, -1)]))
    first = F.array(F.struct(F.lit(0).alias("trial"), (F.col("mean") - F.col("level")).cast("int").alias("step")))
    d = d.select("m", "hp", F.col("level").alias("old"), F.inline(F.concat(first, steps)))
    new = F.col("old") + F.col("step")
    d = d.withColumn("new", new).filter((F.col("step") != 0) & (new >= 0) & (new <= levels - 1))
    return d.groupBy("m", "hp", "old", "new").agg(F.min("trial").alias("trial"))


def refine_steps(trials: DataFrame, levels: int) -> DataFrame:
    """Next level of each pixel from scored trials (m, hp, old, new, gain).

    While the farthest trial is the best one the step doubles; else the vertex
    of the parabola through the three best, or the middle of the two best.
    """
    d = trials.withColumn("_key", F.struct("m", "hp"))
    now = d.select("_key", F.col("old").alias("new"), F.lit(0.0).alias("gain")).distinct()
    pts = d.select("_key", "new", "gain").unionByName(now)
    v = parabola_vertex(pts, "_key", "new", "gain")
    far = d.groupBy("_key").agg(
        F.max_by(F.struct("new", "old"), F.struct(F.round("gain", 9), -F.col("new"))).alias("b"),
        F.max("gain").alias("_g"), F.max(F.abs(F.col("new") - F.col("old"))).alias("_far"),
    )
    d = far.join(v, "_key")
    step = F.col("b.new") - F.col("b.old")
    run = (F.col("_g") > 0) & (F.abs(step) == F.col("_far"))
    nxt = F.when(run, F.col("b.old") + 2 * step).otherwise(F.round("vertex").cast("long"))
    return d.select(
        "_key.m", "_key.hp", F.col("b.old").alias("old"),
        F.least(F.greatest(nxt, F.lit(0)), F.lit(levels - 1)).alias("new"), run.alias("doubling"),
    )


def propose_swaps(models: DataFrame, n: int, bond: int) -> DataFrame:
    """Pairs of pixels within one bond length that could exchange their
    unequal levels; every pair once."""
    far = [o for o in offsets_within(bond) if o != (0, 0)]
    d = neighbor_join(models, n, far, keys=["m"], carry=["level", "hp"])
    d = d.select("m", H.hex_index("x", "z", n).alias("hp"), F.col("hp").alias("hp2"), F.col("level").alias("level2"))
    d = d.filter(F.col("hp") < F.col("hp2")).distinct()
    d = d.join(models.select("m", "hp", "level"), ["m", "hp"])
    return d.filter(F.col("level") != F.col("level2")).select("m", "hp", "hp2", "level", "level2")


def propose_blobs(edits: DataFrame, models: DataFrame, n: int, levels: int, later: bool = False) -> DataFrame:
    """Spread every change (edit, m, hp, old, new) to the six neighbours.

    First and stepping phase: a neighbour moves to the mean of itself and the
    new value. Later phase: it gets half of the change. Changes of one pixel
    add up within an edit; those without effect are dropped.
    """
    pos = models.select("m", "hp", "x", "z", "level")
    e = edits.join(pos.select("m", "hp", "x", "z"), ["m", "hp"])
    half = ((F.col("new") - F.col("old")) / 2).cast("long")
    near = neighbor_join(
        e.filter(half != 0), n, list(H.NEIGHBOURS), keys=["edit", "m"], carry=["old", "new"]
    ).drop("dx", "dz")
    near = near.join(pos.drop("hp"), ["m", "x", "z"])
    lv = F.col("level")
    to = lv + half if later else F.floor((lv + F.col("new")) / 2)
    to = F.least(F.greatest(to, F.lit(0)), F.lit(levels - 1))
    both = near.select("edit", "m", "x", "z", (to - lv).alias("_d")).unionByName(
        e.select("edit", "m", "x", "z", (F.col("new") - F.col("old")).alias("_d"))
    )
    s = both.groupBy("edit", "m", "x", "z").agg(F.sum("_d").alias("_d")).join(pos, ["m", "x", "z"])
    new = F.least(F.greatest(F.col("level") + F.col("_d"), F.lit(0)), F.lit(levels - 1)).cast("long")
    return s.select("edit", "m", "hp", F.col("level").alias("old"), new.alias("new")).filter(F.col("new") != F.col("old"))


def smoothing(edits: DataFrame, models: DataFrame, n: int) -> DataFrame:
    """Edits (edit, m, hp, old, new) with ``smooths``: the new level is nearer to the
    mean of the pixel and its neighbours than the old one."""
    means = neighbor_means(models, n).join(models.select("m", "x", "z", "hp"), ["m", "x", "z"]).select("m", "hp", "mean")
    near = F.abs(F.col("new") - F.col("mean")) < F.abs(F.col("old") - F.col("mean"))
    return edits.join(means, ["m", "hp"]).select(*edits.columns, near.alias("smooths"))


def _gains(smooths: str | None) -> tuple[Column, Column]:
    """Rounded gain, and whether an edit is good: it gains, or ties and smooths."""
    g = F.round("gain", 9)
    return g, (g > 0) | ((g == 0) & F.col(smooths) if smooths else F.lit(False))


def accept_edits(scores: DataFrame, smooths: str | None = None) -> DataFrame:
    """Best edit of each model among those that gain, or tie and smooth.

    Edits of one model change the same likelihoods, so one per model and round
    is taken; models do not conflict.
    """
    g, ok = _gains(smooths)
    best = F.max(F.struct(g.alias("g"), (-F.col("edit")).alias("ne"), "gain")).alias("b")
    return scores.filter(ok).groupBy("m").agg(best).select("m", (-F.col("b.ne")).alias("edit"), "b.gain")


def best_three(scores: DataFrame, smooths: str | None = None) -> DataFrame:
    """The three best trials (edit, m, hp, ..., gain) of each model pixel, with their
    ``place``, and whether they could be accepted."""
    g, ok = _gains(smooths)
    w = W.partitionBy("m", "hp").orderBy(g.desc(), "edit")
    return scores.withColumns({"place": F.row_number().over(w), "good": ok}).filter(F.col("place") <= 3)


def apply_edits(models: DataFrame, edits: DataFrame) -> DataFrame:
    """Models (m, hp, ..., level) with the new levels of (m, hp, new)."""
    e = edits.select("m", "hp", "new")
    rest = [c for c in models.columns if c != "level"]
    return models.join(e, ["m", "hp"], "left").select(*rest, F.coalesce("new", "level").alias("level"))


def model_difference(models: DataFrame, start: DataFrame) -> DataFrame:
    s = start.select("m", "hp", F.col("level").alias("_s"))
    return models.join(s, ["m", "hp"]).select("m", "hp", (F.col("level") - F.col("_s")).alias("difference"))


def active_pixels(activity: DataFrame, states: DataFrame, n: int, pick: int = 28, spread_by: int = 12) -> DataFrame:
    """Which pixels to tune next, and their activity after the choice.

    ``activity`` is (m, hp, x, z, activity). It halves on each visit. A pixel is
    active unless its halved activity is negative or its model is finished or
    the lattice; being picked costs ``pick`` plus a fixed scatter from its place,
    and 2 for itself and each neighbour. Pixels that stay above 24 are moved
    first and charge no neighbours.
    """
    d = activity.join(states.select("m", "state"), "m")
    half = (F.col("activity") / 2).cast("long")
    skip = F.col("state").isin("Finished", "Lattice") | (half < 0)
    cost = pick + F.pmod(F.col("hp") * 31 + F.col("m") * 17, F.lit(spread_by))
    d = d.withColumns({"_h": half, "active": ~skip})
    d = d.withColumn("_v", F.when(F.col("active"), F.col("_h") - cost).otherwise(F.col("_h")))
    d = d.withColumn("_plain", F.col("active") & (F.col("_v") <= 24))
    charge = neighbor_join(d.filter("_plain"), n, [(0, 0), *H.NEIGHBOURS], keys=["m"], carry=[]).groupBy(
        "m", "x", "z"
    ).agg((2 * F.count(F.lit(1))).alias("_c"))
    return d.join(charge, ["m", "x", "z"], "left").select(
        "m", "hp", "active", (F.col("active") & ~F.col("_plain")).alias("move_first"),
        (F.col("_v") - F.coalesce("_c", F.lit(0))).alias("activity"),
    )


# -- weights and models -------------------------------------------------------------


def weight_search(marg: DataFrame, weights: DataFrame, factors: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.25, 2.0)) -> DataFrame:
    """Total likelihood for trial weights of one model at a time.

    The trial weight is clipped to [0.0001, 0.9999] and the others share what
    is left in their old proportion. Models whose ``state`` (a column of
    ``weights``, if there is one) is Fixed or Lattice are not tried and keep
    their weights. A sub-frame needs its sum over all models and the own term
    of the tried model only. Gives (m, factor, weight, total, best).
    """
    held = F.col("state").isin("Fixed", "Lattice") if "state" in weights.columns else F.lit(False)
    w = weights.select("m", "weight", F.coalesce(held, F.lit(False)).alias("_held"))
    free = F.when(~F.col("_held"), F.col("weight")).otherwise(0.0)
    sums = w.agg(F.sum(free).alias("_free"), F.sum(F.col("weight") - free).alias("_kept"))
    each = W.partitionBy("sf_id")  # one row per model
    d = marg.select("sf_id", "m", "marg").join(w, "m")
    d = d.withColumn("_top", F.max("marg").over(each))
    e = exp2(F.col("marg") - F.col("_top"))
    d = d.withColumns({"_e": e, "_free": scalar(sums, F.col("_free")), "_kept": scalar(sums, F.col("_kept"))})
    d = d.withColumns({
        "_all": F.sum(free * F.col("_e")).over(each), "_still": F.sum((F.col("weight") - free) * F.col("_e")).over(each),
    }).filter(~F.col("_held"))
    d = d.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    t = F.least(F.greatest(F.col("weight") * F.col("factor"), F.lit(0.0001)), F.lit(0.9999))
    d = d.withColumn("_t", t)
    rest = F.nullif(F.col("_free") - F.col("weight"), F.lit(0.0))
    others = F.greatest(F.col("_all") - F.col("weight") * F.col("_e"), F.lit(0.0))
    left = F.greatest(1 - F.col("_t") - F.col("_kept"), F.lit(0.0))
    mixed = F.col("_t") * F.col("_e") + F.col("_still") + F.coalesce(left / rest * others, F.lit(0.0))
    s = d.groupBy("m", "factor", F.col("_t").alias("weight")).agg(F.sum(F.col("_top") + F.log2(mixed)).alias("total"))
    order = W.partitionBy("m").orderBy(F.round("total", 6).desc(), "factor")  # one row per factor
    return s.withColumn("best", F.row_number().over(order) == 1)


def weight_terms(marg: DataFrame, weights: DataFrame) -> DataFrame:
    """(sf_id, m, a, b, top): a sub-frame's likelihood is ``a * t + b`` times 2^top when
    model m has weight t and the other free models share the rest as before.

    Models whose ``state`` is Fixed or Lattice keep their weights and are not tried.
    """
    held = F.col("state").isin("Fixed", "Lattice") if "state" in weights.columns else F.lit(False)
    w = weights.select("m", "weight", F.coalesce(held, F.lit(False)).alias("_held"))
    free = F.when(~F.col("_held"), F.col("weight")).otherwise(0.0)
    sums = w.agg(F.sum(free).alias("_free"), F.sum(F.col("weight") - free).alias("_kept")).first()
    each = W.partitionBy("sf_id")  # one row per model
    d = marg.select("sf_id", "m", "marg").join(bounded(w), "m").withColumn("top", F.max("marg").over(each))
    d = d.withColumn("_e", exp2(F.col("marg") - F.col("top")))
    d = d.withColumns({
        "_all": F.sum(free * F.col("_e")).over(each), "_still": F.sum((F.col("weight") - free) * F.col("_e")).over(each),
    }).filter(~F.col("_held"))
    rest = F.nullif(F.lit(sums["_free"]) - F.col("weight"), F.lit(0.0))
    share = F.coalesce(F.greatest(F.col("_all") - F.col("weight") * F.col("_e"), F.lit(0.0)) / rest, F.lit(0.0))
    return d.select(
        "sf_id", "m", (F.col("_e") - share).alias("a"), (F.col("_still") + (1 - F.lit(sums["_kept"])) * share).alias("b"), "top"
    )


def weight_totals(terms: DataFrame, trials: DataFrame) -> DataFrame:
    """(m, weight, total) of trial weights (m, weight)."""
    d = terms.join(F.broadcast(trials.select("m", "weight")), "m")
    mixed = F.greatest(F.col("a") * F.col("weight") + F.col("b"), F.lit(1e-300))
    return d.groupBy("m", "weight").agg(F.sum(F.col("top") + F.log2(mixed)).alias("total"))


def best_weights(
    marg: DataFrame, weights: DataFrame, only: list[int] | None = None, least: float = 1e-4, most: float = 0.9999, close: float = 1e-9
) -> DataFrame:
    """The best weight of each free model (or of ``only`` some) alone: (m, weight, total).

    The likelihood of one weight is concave, so its slope has one zero: Newton steps
    of all models side by side, two sums each, kept between the last weights with a
    rising and a falling slope, until none moves by more than ``close``. The state of
    the search is one row per model.
    """
    store = Store(marg.sparkSession)
    terms = weight_terms(marg, weights)
    terms = store.write(terms if only is None else terms.filter(F.col("m").isin(only)))
    rows = weights.select("m", "weight", F.col("state").isin("Fixed", "Lattice").alias("held") if "state" in weights.columns else F.lit(False).alias("held")).collect()
    most = min(most, 1 - sum(r["weight"] for r in rows if r["held"]))  # what held weights leave
    at = {r["m"]: min(max(r["weight"], least), most) for r in rows if not r["held"] and (only is None or r["m"] in only)}
    low, high = dict.fromkeys(at, least), dict.fromkeys(at, most)
    live = set(at)
    while live:
        trials = marg.sparkSession.createDataFrame([(m, at[m]) for m in sorted(live)], "m long, weight double")
        d = terms.join(F.broadcast(trials), "m")
        slope = F.col("a") / F.greatest(F.col("a") * F.col("weight") + F.col("b"), F.lit(1e-300))
        rows = d.groupBy("m").agg(F.sum(slope).alias("s"), F.sum(slope * slope).alias("c")).collect()
        live &= {r["m"] for r in rows}
        for r in rows:
            m, s, c = r["m"], r["s"], r["c"]
            if s > 0:
                low[m] = at[m]
            else:
                high[m] = at[m]
            to = at[m] + s / c if c > 0 else at[m]
            if not low[m] <= to <= high[m]:
                to = (low[m] + high[m]) / 2 if low[m] < at[m] < high[m] else (most if s > 0 else least)
                to = min(max(to, low[m]), high[m])
            if abs(to - at[m]) <= close:
                live.discard(m)
            at[m] = to
    out = weight_totals(terms, marg.sparkSession.createDataFrame(sorted(at.items()), "m long, weight double"))
    out = cut_lineage(out)
    store.drop(terms)
    return out


def clone_models(models: DataFrame, weights: DataFrame, first: int, last: int, copies: int) -> tuple[DataFrame, DataFrame]:
    """Delete (0), swap the ends of (1) or copy the models first..last.

    The first copy keeps 1 - w of its weight w and the others share the rest;
    all weights are scaled to sum to 1 and the models numbered anew.
    """
    m = F.col("m")
    inside = (m >= first) & (m <= last)
    span = last - first + 1
    if copies == 1:
        swap = F.when(m == first, last).when(m == last, first).otherwise(m).cast("long")
        return models.withColumn("m", swap), weights.withColumn("m", swap)
    if copies == 0:
        new = F.when(m > last, m - span).otherwise(m)
        keep_m, keep_w = models.filter(~inside).withColumn("m", new), weights.filter(~inside).withColumn("m", new)
    else:
        base = F.when(m > last, m + span * (copies - 1)).when(m < first, m).otherwise(first + (m - first) * copies)
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, copies - 1).otherwise(0).cast("long")))

        def renumber(df):
            rest = [c for c in df.columns if c != "m"]
            d = df.select(base.cast("long").alias("m"), *rest, inside.alias("_in"), copy.alias("_copy"))
            return d.withColumn("m", F.col("m") + F.col("_copy"))

        keep_m = renumber(models).drop("_in", "_copy")
        w, k = F.col("weight"), F.col("_copy")
        share = F.when(~F.col("_in"), w).when(k == 0, w * (1 - w)).otherwise(w * w / max(copies - 1, 1))
        keep_w = renumber(weights).withColumn("weight", share).drop("_in", "_copy")
    keep_w = keep_w.withColumn("weight", F.col("weight") / scalar(keep_w, F.sum("weight")))
    return keep_m, keep_w


def beam_convolve(models: DataFrame, beam: list[tuple[int, int, int]], n: int) -> DataFrame:
    """Blur models with a beam (dx, dz, weight) on the periodic hexagon:
    rounded division of the weighted sum by the beam sum."""
    norm = sum(w for _, _, w in beam)
    d = models.select("m", "x", "z", "level", F.inline(F.array(
        *[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz"), F.lit(w).alias("_w")) for a, b, w in beam]
    )))
    d = d.withColumns({"x": F.col("x") + F.col("dx"), "z": F.col("z") + F.col("dz"), "y": F.lit(0)})
    d = H.with_wrap(d, n)
    return d.groupBy("m", "x", "z").agg(F.sum(F.col("level") * F.col("_w")).alias("sum")).withColumn(
        "level", F.floor((F.col("sum") + norm // 2) / norm)
    )


def beam_update(blurred: DataFrame, edits: DataFrame, beam: list[tuple[int, int, int]], n: int) -> DataFrame:
    """Blurred models after edits (m, x, z, old, new): only the change is
    convolved and added to the kept sums."""
    norm = sum(w for _, _, w in beam)
    delta = edits.select("m", "x", "z", (F.col("new") - F.col("old")).alias("level"))
    d = beam_convolve(delta, beam, n).select("m", "x", "z", F.col("sum").alias("_d"))
    s = blurred.select("m", "x", "z", "sum").join(d, ["m", "x", "z"], "left")
    return s.select("m", "x", "z", (F.col("sum") + F.coalesce("_d", F.lit(0))).alias("sum")).withColumn(
        "level", F.floor((F.col("sum") + norm // 2) / norm)
    )


def fractional_rotation(models: DataFrame, step: int, steps: int, n: int) -> DataFrame:
    """Rotate models by ``step`` of ``steps`` parts of 60 degrees: the value of
    each pixel is shared by four targets. Gives the exact and rounded sum."""
    angle = -math.pi / 3 * step / steps
    # the rotation in the oblique (x, z) basis
    cos, sin3 = math.cos(angle), math.sin(angle) / math.sqrt(3)
    turned = {
        "_px": (cos + sin3) * F.col("x") + 2 * sin3 * F.col("z"),
        "_pz": (cos - sin3) * F.col("z") - 2 * sin3 * F.col("x"),
    }
    d = models.select("m", "level", *[v.alias(k) for k, v in turned.items()])
    sides = []
    for p in ("_px", "_pz"):
        low = F.floor(F.round(p, 6))  # a target that is whole but for rounding stays whole
        part = F.greatest(F.col(p) - low, F.lit(0.0))
        sides.append([(low, 1 - part), (low + 1, part)])
    parts = F.array(*[
        F.struct(tx.alias("x"), tz.alias("z"), (F.col("level") * sx * sz).alias("v")) for tx, sx in sides[0] for tz, sz in sides[1]
    ])
    d = H.with_wrap(d.select("m", F.inline(parts)).withColumn("y", F.lit(0)), n)
    return d.groupBy("m", "x", "z").agg(F.sum("v").alias("value")).withColumn(
        "level", F.round("value").cast("long")
    )


# -- the loop -----------------------------------------------------------------------


class Reconstruction:
    """Models, weights and the likelihoods that belong to them.

    ``ll`` (sf_id, m, sym, ll) and ``marg`` (sf_id, m, marg) are written tables. An
    expectation step makes them anew; edits change them by their deltas: copies of
    edited models by the base of the edit, and by the counts at changed places.
    """

    def __init__(self, sf: DataFrame, models: DataFrame, weights: DataFrame, table: DataFrame, n: int, bond: int):
        self.spark, self.table, self.n, self.bond = sf.sparkSession, table, n, bond
        self.store = Store(self.spark)
        self.sf = self.store.write(spread(sf.select("sf_id", "x", "z", "hp", "value"), "sf_id"))
        self.n_sym = 12 * len(H.lattice_points(n, bond))
        if "state" not in weights.columns:
            weights = weights.withColumn("state", F.lit("Continue"))
        self.weights = self.store.write(weights.select("m", "weight", "state"))
        self.models = self.store.write(models.select("m", "hp", "level").join(home_pixels(self.spark, n), "hp").select("m", "hp", "x", "z", "level"))
        self.frames = self.sf.select("sf_id").distinct().count()
        self.ll, self.marg, self.total = self.evaluate(self.models, self.weights)

    def evaluate(self, models: DataFrame, weights: DataFrame):
        ll = self.store.write(baseline_loglik(self.sf, models.select("m", "hp", "level"), self.table, self.n, self.bond))
        marg = self.store.write(marginal_loglik(ll))
        return ll, marg, self.total_of(marg, weights)

    def total_of(self, marg: DataFrame, weights: DataFrame) -> float:
        return mixture_loglik(marg, weights, self.n_sym).first()["total"]

    def take(self, total: float, **tables: DataFrame) -> None:
        """New tables for old ones, which are deleted."""
        for name, t in tables.items():
            self.store.drop(getattr(self, name))
            setattr(self, name, t)
        self.total = total

    # -- expectation -----------------------------------------------------------------

    def expectation(self, low: float, high: float, levels: int) -> float:
        """One step of all models and weights; returns the gain, and takes nothing
        where there is none. Models that are the lattice or finished stay, as do fixed weights."""
        em = em_models(self.sf, self.ll, responsibilities(self.marg), self.n, self.bond, low, high, levels).select("m", "hp", F.col("level").alias("_em"))
        still = self.weights.filter(F.col("state").isin("Lattice", "Finished")).select("m", F.lit(True).alias("_still"))
        d = self.models.join(em, ["m", "hp"], "left").join(bounded(still), "m", "left")
        # a model without any weight keeps its image
        level = F.when(F.col("_still"), F.col("level")).otherwise(F.coalesce("_em", "level"))
        models = self.store.write(d.select("m", "hp", "x", "z", level.alias("level")))
        share = weights_from_cases(assign_cases(self.marg), self.models).select("m", F.greatest("weight", F.lit(1e-4)).alias("_w"))
        held = F.col("state").isin("Fixed", "Lattice")
        w = cut_lineage(self.weights.join(share, "m"))
        sums = w.agg(F.coalesce(F.sum(F.when(held, F.col("weight"))), F.lit(0.0)), F.sum(F.when(~held, F.col("_w")))).first()
        new = F.when(held, F.col("weight")).otherwise(F.col("_w") * F.lit((1 - sums[0]) / (sums[1] or 1.0)))
        weights = self.store.write(w.select("m", new.alias("weight"), "state"))
        ll, marg, total = self.evaluate(models, weights)
        gain = total - self.total
        if gain > 0:
            self.take(total, models=models, weights=weights, ll=ll, marg=marg)
        else:
            self.store.drop(models, weights, ll, marg)
        return gain

    # -- edits -----------------------------------------------------------------------

    def score(self, edits: DataFrame) -> tuple[DataFrame, EditPosts]:
        """Scores of single-pixel edits, with the posting lists behind them."""
        posts = EditPosts(edits, self.table, self.n, self.bond, self.store)
        terms = self.store.write(frame_terms(self.marg, self.weights))
        scores = score_with(self.sf, self.ll, terms, posts, self.n_sym, True, self.store)
        self.store.drop(terms)
        return scores, posts

    def accept(self, edits: DataFrame, posts: EditPosts) -> float:
        """Take edits (edit, m, hp, new) of different pixels all at once if the
        likelihood rises; it is kept up from their deltas. Returns the gain."""
        chosen = edits.select("edit")
        edited = bounded(posts.owner.join(F.broadcast(chosen), "edit").groupBy("m").agg(F.sum("base").alias("_base")))
        moved = posts.deltas(self.sf, chosen)[0].groupBy("sf_id", "m", "sym").agg(F.sum("delta").alias("_delta"))
        new = self.store.write(apart(self.ll.join(edited, "m")).join(moved, ["sf_id", "m", "sym"], "left").select(
            "sf_id", "m", "sym", (F.col("ll") + F.col("_base") + F.coalesce("_delta", F.lit(0.0))).alias("ll")
        ))
        marg = self.store.write(self.marg.join(edited, "m", "left_anti").unionByName(marginal_loglik(new)))
        total = self.total_of(marg, self.weights)
        gain = total - self.total
        if gain > 0:
            ll = self.store.write(self.ll.join(edited, "m", "left_anti").unionByName(new))
            models = self.store.write(apply_edits(self.models, edits))
            self.take(total, models=models, ll=ll, marg=marg)
        else:
            self.store.drop(marg)
        self.store.drop(new)
        return gain

    def tune_weight(self, m: int) -> float:
        """The best weight of one model; the others share the rest."""
        best = {r["m"]: r["weight"] for r in best_weights(self.marg, self.weights, [m]).collect()}
        rows = {r["m"]: (r["weight"], r["state"]) for r in self.weights.collect()}
        if m not in best:
            return 0.0
        kept = sum(w for w, s in rows.values() if s in ("Fixed", "Lattice"))
        free = sum(w for k, (w, s) in rows.items() if s not in ("Fixed", "Lattice") and k != m)
        scale = max(1 - kept - best[m], 0.0) / free if free else 0.0
        new = [(k, w if s in ("Fixed", "Lattice") else best[m] if k == m else w * scale, s) for k, (w, s) in rows.items()]
        weights = self.store.write(self.spark.createDataFrame(new, "m long, weight double, state string"))
        gain = self.total_of(self.marg, weights) - self.total
        if gain > 0:
            self.take(self.total + gain, weights=weights)
        else:
            self.store.drop(weights)
        return max(gain, 0.0)

    def finish(self, tried: list[tuple[int, int, bool]], limit: int) -> None:
        """Models that failed more than ``limit`` rounds in a row are finished."""
        if not tried:
            return
        history = self.spark.createDataFrame(tried, "m long, step int, accepted boolean")
        done = finish_models(history, limit).filter(F.col("state") == "Finished").select("m", F.lit(True).alias("_done"))
        state = F.when(F.col("_done") & ~F.col("state").isin("Lattice", "Fixed"), "Finished").otherwise(F.col("state"))
        self.take(self.total, weights=self.store.write(self.weights.join(done, "m", "left").select("m", "weight", state.alias("state"))))


def _edit_ids(trials: DataFrame, n: int, levels: int) -> DataFrame:
    """Trials (m, hp, old, new), each once and numbered by itself."""
    number = (F.col("m") * (3 * n * n) + F.col("hp")) * levels + F.col("new")
    return trials.select(number.cast("long").alias("edit"), "m", "hp", "old", F.col("new").cast("long").alias("new")).dropDuplicates(["edit"])


def edit_rounds(
    state: Reconstruction, levels: int, rounds: int | None, min_gain: float, fail_limit: int = 1, reach: int = 1,
) -> list[dict]:
    """Rounds of single-pixel edits until all models are finished, a round gains less
    than ``min_gain`` for each sub-frame, or the caller's number.

    A round tries the active pixels: the mean of their neighbourhood and steps of up to
    ``reach``, and where a pixel was tried before, the next level of its line search. The
    three best trials of a pixel are kept for that. The best good trials of all pixels of
    a model are taken at once if the total rises; else the best quarter of them, and
    so on down to one of each model; else the best of all. Then one model's weight is tuned. Changes make a pixel and its
    neighbours active again. The total never falls.
    """
    spark, store, n = state.spark, state.store, state.n
    activity = store.write(state.models.select("m", "hp", "x", "z", F.lit(96).alias("activity")))
    kept, history, tried, r = None, [], [], 0
    while rounds is None or r < rounds:
        r += 1
        before = state.total
        open_ = sorted(x["m"] for x in state.weights.filter(~F.col("state").isin("Finished", "Lattice")).select("m").collect())
        if not open_:
            break
        active = store.write(active_pixels(activity, state.weights, n).join(activity.select("m", "hp", "x", "z"), ["m", "hp"]))
        pixels = active.filter("active")
        trials = propose_steps(state.models, pixels, n, levels, reach).select("m", "hp", "old", "new")
        if kept is not None:
            going = kept.join(pixels.select("m", "hp"), ["m", "hp"], "left_semi").join(
                state.models.select("m", "hp", F.col("level").alias("_now")), ["m", "hp"]
            ).filter(F.col("old") == F.col("_now"))
            more = refine_steps(going.select("m", "hp", "old", "new", "gain"), levels)
            trials = trials.unionByName(more.filter(F.col("new") != F.col("old")).select("m", "hp", "old", "new"))
        edits = store.write(smoothing(_edit_ids(trials, n, levels), state.models, n))
        if edits.isEmpty():
            store.drop(activity, edits)
            activity = store.write(active.select("m", "hp", "x", "z", "activity"))
            store.drop(active)
            continue
        scores, posts = state.score(edits)
        three = store.write(best_three(scores.join(edits, ["edit", "m"]), "smooths"))
        store.drop(kept)
        kept = three
        good = three.filter("good and place = 1")
        by_gain = W.partitionBy("m").orderBy(F.round("gain", 9).desc(), "edit")
        good = store.write(good.withColumn("nr", F.row_number().over(by_gain)))
        most = good.agg(F.max("nr")).first()[0] or 0
        took = None
        while most and took is None:
            tier = store.write(good.filter(F.col("nr") <= most).select("edit", "m", "hp", "new"))
            if state.accept(tier, posts) > 0:
                took = tier
            else:
                store.drop(tier)
                most //= 4
        if took is None:
            tier = store.write(good.filter("gain > 0").orderBy(F.desc("gain"), "edit").limit(1).select("edit", "m", "hp", "new"))
            if not tier.isEmpty() and state.accept(tier, posts) > 0:
                took = tier
        hit = set() if took is None else {x["m"] for x in took.select("m").distinct().collect()}
        tested = {x["m"] for x in edits.select("m").distinct().collect()}
        tried += [(m, sum(1 for t in tried if t[0] == m), m in hit) for m in sorted(tested)]
        # a change is rewarded where it is and around it
        paid = active.select("m", "hp", "x", "z", "activity")
        if took is not None:
            at = took.join(state.models.select("m", "hp", "x", "z"), ["m", "hp"])
            spill = neighbor_join(at, n, list(H.NEIGHBOURS), keys=["m"], carry=[]).groupBy("m", "x", "z").agg((16 * F.count(F.lit(1))).alias("_near"))
            paid = paid.join(at.select("m", "hp", F.lit(96).alias("_own")), ["m", "hp"], "left").join(spill, ["m", "x", "z"], "left")
            paid = paid.select("m", "hp", "x", "z", (F.col("activity") + F.coalesce("_own", F.lit(0)) + F.coalesce("_near", F.lit(0))).alias("activity"))
        fresh = store.write(paid.withColumn("activity", F.col("activity").cast("int")))
        count = 0 if took is None else took.count()
        store.drop(activity, active, edits, scores, posts.owner, posts.posts, good, took)
        activity = fresh
        state.tune_weight(open_[r % len(open_)])
        state.finish(tried, fail_limit)
        gain = state.total - before
        history.append({"round": r, "phase": "edit", "total": state.total, "accepted": gain > 0, "edits": count})
        if 0 < gain < min_gain * state.frames:
            break
    store.drop(activity, kept)
    return history


def reconstruct(
    sf: DataFrame, models: DataFrame, weights: DataFrame, table: DataFrame, n: int, bond: int, low: float, high: float,
    levels: int, rounds: int | None = None, min_gain: float = 1e-4, fail_limit: int = 1,
) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Models (m, hp, level), weights (m, weight, state) and the history: expectation
    rounds until one gains less than ``min_gain`` (log2) for each sub-frame, then edit
    rounds (``edit_rounds``). The total itself is no measure: its zero is the table's offset.

    A round that does not raise the likelihood is discarded, so the history never
    falls. ``rounds`` limits each of the two phases on request. ``weights`` may have a
    ``state``: Lattice models and finished ones are not edited, Fixed and Lattice weights stay.
    """
    state = Reconstruction(sf, models, weights, table, n, bond)
    history = [{"round": 0, "phase": "em", "total": state.total, "accepted": True, "edits": 0}]
    r = 0
    while rounds is None or r < rounds:
        r += 1
        gain = state.expectation(low, high, levels)
        history.append({"round": r, "phase": "em", "total": state.total + min(gain, 0.0), "accepted": gain > 0, "edits": 0})
        if gain < min_gain * state.frames:
            break
    history += [h | {"round": h["round"] + r} for h in edit_rounds(state, levels, rounds, min_gain, fail_limit)]
    return state.models.select("m", "hp", "level"), state.weights, history
