"""Operators on frame reports: one row per frame."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from honeyframe.functions.numbers import circular_mean, col, wrap_angle
from honeyframe.operators.numbering import scalar
from honeyframe.session import apart, bounded, cut_lineage, spread



@dataclass(frozen=True)
class Rule:
    """One bound of a report column: low < value <= high, None is open."""

    key: str
    low: float | None = None
    high: float | None = None
    invert: bool = False

    def condition(self) -> Column:
        c = F.lit(True)
        if self.low is not None:
            c = c & (F.col(self.key) > self.low)
        if self.high is not None:
            c = c & (F.col(self.key) <= self.high)
        return ~c if self.invert else c


@dataclass(frozen=True)
class Bin:
    """A named range of hex_std and hex_avg: lower <= value < upper."""

    name: str
    lower_hex_std: float | None = None
    upper_hex_std: float | None = None
    lower_hex_avg: float | None = None
    upper_hex_avg: float | None = None

    def condition(self, min_contrast: float) -> Column:
        c = F.col("contrast") >= min_contrast
        for low, high, name in (
            (self.lower_hex_std, self.upper_hex_std, "hex_std"),
            (self.lower_hex_avg, self.upper_hex_avg, "hex_avg"),
        ):
            if low is not None:
                c = c & (F.col(name) >= low)
            if high is not None:
                c = c & (F.col(name) < high)
        return c


def rules_from(df: DataFrame) -> list[Rule]:
    """Rules of a (key, low, high, invert) table; see read_filter_rules."""
    return [Rule(r["key"], r["low"], r["high"], r["invert"]) for r in df.collect()]  # lines of an option file


def bins_from(df: DataFrame) -> list[Bin]:
    names = ("name", "lower_hex_std", "upper_hex_std", "lower_hex_avg", "upper_hex_avg")
    rows = sorted(df.collect(), key=lambda r: r["bin_id"])
    return [Bin(*[r[n] for n in names]) for r in rows]


def passes_rules(rules: list[Rule]) -> Column:
    """Rules of one key are ORed, keys are ANDed."""
    by_key: dict[str, list[Column]] = {}
    for r in rules:
        by_key.setdefault(r.key, []).append(r.condition())
    ored = [reduce(lambda a, b: a | b, cs) for cs in by_key.values()]
    return reduce(lambda a, b: a & b, ored, F.lit(True))


def frame_bounds_filter(report: DataFrame, rules: list[Rule]) -> DataFrame:
    """A plain predicate on the report columns, so it reaches the scan."""
    return report.filter(passes_rules(rules))


def bin_frames(report: DataFrame, bins: list[Bin], min_contrast: float = 0.0) -> DataFrame:
    """One row per (frame, matching bin)."""
    hits = F.array(*[F.when(b.condition(min_contrast), F.lit(b.name)) for b in bins])
    return report.withColumn("bin", F.explode(F.array_compact(hits)))


def route_frames(
    report: DataFrame, rules: list[Rule], bins: list[Bin], min_contrast: float = 0.0,
    unique: bool = True,
) -> DataFrame:
    """Send every frame to its bin, 'uncategorized' or 'filtered'.

    With ``unique`` the first matching bin wins and ``ambiguous`` tells that
    there were more; otherwise the frame goes to every bin that matches.
    """
    hits = F.array_compact(
        F.array(*[F.when(b.condition(min_contrast), F.lit(b.name)) for b in bins])
    )
    ok = passes_rules(rules)
    d = report.withColumn("_hits", F.when(ok, hits).otherwise(F.array(F.lit("filtered"))))
    n = F.size("_hits")
    d = d.withColumn("_hits", F.when(n == 0, F.array(F.lit("uncategorized"))).otherwise(F.col("_hits")))
    if unique:
        return d.withColumns({"bin": F.get("_hits", F.lit(0)), "ambiguous": n > 1}).drop("_hits")
    return d.withColumn("bin", F.explode("_hits")).drop("_hits")


def quality_gate(
    report: DataFrame, min_clean: float = 0.5, min_peaks: int = -1, max_peaks: int = -1,
    min_contrast: float | None = None,
) -> DataFrame:
    c = F.col("graphene") >= min_clean
    if min_peaks > 0:
        c = c & (F.col("peaks") >= min_peaks)
    if max_peaks > 0:
        c = c & (F.col("peaks") <= max_peaks)
    if min_contrast is not None:
        c = c & (F.col("contrast") >= min_contrast)
    return report.filter(c)


def extract_by_match(frames: DataFrame, low: float, high: float, invert: bool = False) -> DataFrame:
    m = F.col("match")
    inside = (m > low) & (m <= high)
    return frames.filter(~F.isnan(m) & m.isNotNull() & (~inside if invert else inside))


def normalize_angles(report: DataFrame) -> DataFrame:
    """tilt into (-30, 30] degrees, ellA >= ellB, ellPhi into (-90, 90]."""
    swap = F.col("ellB") > F.col("ellA")
    phi = F.when(swap, (F.col("ellPhi") + math.pi / 2) % F.lit(math.pi)).otherwise(F.col("ellPhi"))
    d = report.withColumns(
        {
            "tilt": wrap_angle("tilt", math.pi / 3),
            "ellPhi": phi,
            "ellA": F.greatest("ellA", "ellB"),
            "ellB": F.least("ellA", "ellB"),
        }
    )
    phi = F.atan2(F.sin("ellPhi"), F.cos("ellPhi"))
    d = d.withColumn("ellPhi", phi)
    p = F.col("ellPhi")
    return d.withColumn(
        "ellPhi",
        F.when(p > math.pi / 2, p - math.pi).when(p <= -math.pi / 2, p + math.pi).otherwise(p),
    )


def angle_difference(a, b) -> Column:
    """Smallest difference of two angles, never negative."""
    d = F.abs(col(a) - col(b))
    return F.when(d > math.pi, 2 * math.pi - d).otherwise(d)


def derive_report_columns(report: DataFrame) -> DataFrame:
    return report.withColumns(
        {
            "hex_std": F.col("hex_avg") * F.col("contrast"),
            "uc_std": F.col("uc_avg") * F.col("contrast"),
            "excent": F.col("ellA") / F.nullif(F.col("ellB"), F.lit(0.0)),
            "shapeQ": F.col("mirrorQ") * F.col("positionQ"),
            "sym": F.col("hex_shape") / F.nullif(F.col("moment2"), F.lit(0.0)),
        }
    )


def parse_slice_label(df: DataFrame, label="label", frame="frame_id") -> DataFrame:
    """Split id_x_y_n; a label that does not start with id, x, y falls back to
    the frame number, 0, 0 and -1; a missing n alone keeps 0."""
    plain = F.when(
        F.col(label) != "null", F.regexp_replace(F.col(label), r"^(.+)\.(tif|dm3)[^.]*$", "$1")
    )
    d = df.withColumn("label", plain)
    p = F.split(F.col("label"), "_")
    part = [F.get(p, F.lit(i)) for i in range(4)]
    img, sx, sy = part[0].try_cast("int"), part[1].try_cast("double"), part[2].try_cast("double")
    ok = img.isNotNull() & sx.isNotNull() & sy.isNotNull()
    return d.withColumns(
        {
            "imgID": F.when(ok, img.cast("long")).otherwise(F.col(frame)),
            "stageX": F.when(ok, sx).otherwise(0.0),
            "stageY": F.when(ok, sy).otherwise(0.0),
            "stageN": F.when(ok, F.coalesce(part[3].try_cast("int"), F.lit(0))).otherwise(-1),
        }
    )


# -- joins by label ---------------------------------------------------------

def _marks(label: Column, width: int) -> Column:
    """The characters at both ends of a label."""
    return F.concat(F.left(label, F.lit(width)), F.right(label, F.lit(width)))


def _label_parts(df: DataFrame, label: str, marks: dict[int, list[str]], width: int) -> DataFrame:
    """The distinct substrings of ``label`` with one of the given lengths, and one of the
    marks of that length."""
    text, i = F.col(label), F.col("_i")
    d = spread(df).withColumn("_i", F.explode(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))))
    if 0 < width <= min(marks):
        d = d.filter(F.substr(text, i, F.lit(width)).isin(sorted({m[:width] for own in marks.values() for m in own})))
    parts = []
    for n in sorted(marks):
        ends = min(width, n)
        mark = F.concat(F.substr(text, i, F.lit(ends)), F.substr(text, i + (n - ends), F.lit(ends)))
        known = mark.isin(marks[n]) if width else F.lit(True)
        parts.append(F.when((i + (n - 1) <= F.length(text)) & known, F.substr(text, i, F.lit(n))))
    d = d.withColumn("_part", F.explode(F.array(*parts)))
    # a part that comes twice counts where it is first
    return d.filter(F.col("_part").isNotNull() & (F.position(F.col("_part"), text) == i)).drop("_i")


def contains_join(
    frames: DataFrame, report: DataFrame, frame_label: str, report_label: str, most: int = 4096
) -> DataFrame:
    """Pairs where the frame label contains the report label.

    Containment becomes an equality: the few distinct lengths of the report
    labels are read first, and every frame label is cut into its parts of
    those lengths. No pair is compared that does not match. Where the report labels have
    few beginnings and ends (up to ``most`` of two characters each, or of one), only
    parts with these are shuffled; else all parts are.
    """
    width = 3
    while width:
        width -= 1
        d = report.select(F.length(report_label).alias("n"), _marks(F.col(report_label), width).alias("m")).distinct()
        found = (d.limit(most + 1) if width else d).collect()
        if len(found) <= most:
            break
    marks = {}
    for r in found:
        if r["n"]:
            marks.setdefault(r["n"], []).append(r["m"])
    if not marks:
        return frames.join(report, F.lit(False))
    parts = _label_parts(frames, frame_label, marks, width)
    return apart(parts).join(report, parts["_part"] == report[report_label]).drop("_part")


def join_by_label(report: DataFrame, frames: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """First frame, and first mask, whose label contains the report label;
    ``missing`` marks report rows without a frame."""
    labels = report.select(F.col("label").alias("_rl")).distinct()

    def first(side: DataFrame, out: str) -> DataFrame:
        s = side.select(F.col("slice").alias("_s"), F.col("label").alias("_fl"))
        return contains_join(s, labels, "_fl", "_rl").groupBy(F.col("_rl").alias("label")).agg(
            F.min("_s").alias(out)
        )

    d = report.join(apart(first(frames, "slice")), "label", "left")
    if masks is not None:
        d = d.join(apart(first(masks, "mask_slice")), "label", "left")
    return d.withColumn("missing", F.col("slice").isNull())


def assign_reports(subframes: DataFrame, report: DataFrame) -> DataFrame:
    """Give every sub-frame the report it was cut from.

    Sub-frames (slice, label) of a report (rep_id, label, n_sf, slice_hint)
    start at the first one that carries the report label, or at slice_hint,
    and run for n_sf slices; the label must be contained. The later report
    wins where two claim one sub-frame.
    """
    r = report.select(
        "rep_id", F.col("label").alias("_rl"), "n_sf",
        *([F.col("slice_hint")] if "slice_hint" in report.columns
          else [F.lit(None).cast("long").alias("slice_hint")]),
    )
    s = subframes.select("slice", F.col("label").alias("_fl"))
    labels = r.select("_rl").distinct()
    hit = cut_lineage(contains_join(s, labels, "_fl", "_rl").select("slice", "_rl"))
    first = hit.groupBy("_rl").agg(F.min("slice").alias("_first"))
    r = r.join(apart(first), "_rl").withColumn("_first", F.coalesce("_first", "slice_hint"))
    own = (
        apart(hit).join(r, "_rl")
        .filter((F.col("slice") >= F.col("_first")) & (F.col("slice") < F.col("_first") + F.col("n_sf")))
        .groupBy("slice").agg(F.max("rep_id").alias("rep_id"))
    )
    return subframes.join(apart(own), "slice", "left")


def upsert_by_label(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The newest row per label; ``order`` breaks ties within one side."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    cols = old.columns
    pick = F.max_by(F.struct(*cols), F.struct("_side", *order)).alias("r")
    return both.groupBy("label").agg(pick).select("r.*")


# -- group statistics --------------------------------------------------------

def group_circular_mean(df: DataFrame, by: str, angle: str, weight: str, fold: int) -> DataFrame:
    return df.groupBy(by).agg(circular_mean(angle, weight, fold).alias("mean_angle"))


_MEANS = ("tilt_c", "tilt_s", "phi_c", "phi_s", "hel", "ellA", "ellB", "w")


def _good_terms(min_contrast: float) -> dict[str, Column]:
    good = (
        (F.col("state") != -2) & (F.col("hex_shape") > 0) & (F.col("hex_merit") > 0)
        & (F.col("contrast") > min_contrast)
    )
    w = F.when(good, F.col("hex_merit") * F.col("hex_merit")).otherwise(0.0)
    phi = F.pmod(F.col("ellPhi"), F.lit(math.pi))
    tilt = F.col("tilt") % F.lit(math.pi / 3)
    return {
        "tilt_c": w * F.cos(6 * tilt), "tilt_s": w * F.sin(6 * tilt),
        "phi_c": w * F.cos(2 * phi), "phi_s": w * F.sin(2 * phi),
        "hel": w * F.col("hel"), "ellA": w * F.col("ellA"), "ellB": w * F.col("ellB"),
        "w": w,
    }


def leave_one_out_mean(report: DataFrame, group: str, min_contrast: float = 0.0) -> DataFrame:
    """Means of the other good frames of the group, weighted by hex_merit^2.

    Group totals by a partial aggregate, then every frame takes its own term
    off; no window ever holds a whole group.
    """
    terms = _good_terms(min_contrast)
    d = report.withColumns({f"_t_{k}": v for k, v in terms.items()})
    totals = d.groupBy(group).agg(
        *[F.sum(f"_t_{k}").alias(f"_g_{k}") for k in _MEANS],
        F.sum(F.when(F.col("_t_w") > 0, 1).otherwise(0)).alias("_g_n"),
    )
    d = d.join(bounded(totals), group)  # one row per group
    others = F.col("_g_n") - F.when(F.col("_t_w") > 0, 1).otherwise(0)
    rest = {k: F.col(f"_g_{k}") - F.col(f"_t_{k}") for k in _MEANS}
    has = others > 0
    out = {
        "mean_tilt": F.atan2(rest["tilt_s"], rest["tilt_c"]) / 6,
        "mean_phi": F.atan2(rest["phi_s"], rest["phi_c"]) / 2,
        "mean_hel": rest["hel"] / rest["w"],
        "mean_ellA": rest["ellA"] / rest["w"],
        "mean_ellB": rest["ellB"] / rest["w"],
    }
    d = d.withColumns({k: F.when(has, v) for k, v in out.items()})
    return d.drop(*[f"_t_{k}" for k in _MEANS], *[f"_g_{k}" for k in _MEANS], "_g_n")


def bad_frames(
    report: DataFrame, group: str, width: int, height: int, min_contrast: float = 0.0
) -> DataFrame:
    """Flag frames to start again from the group means (at most two resets)."""
    d = leave_one_out_mean(report, group, min_contrast)
    hel, m = F.col("hel"), F.col("mean_hel")
    off = F.abs((F.col("tilt") - F.col("mean_tilt")) % F.lit(math.pi / 3)) > 0.05
    sign = (
        (F.col("hex_merit") < 0) | (hel < 0.96 * m) | (hel > 1.04 * m)
        | (F.col("offX") < 0) | (F.col("offY") < 0)
        | (F.col("offX") > width) | (F.col("offY") > height)
        | off | (F.col("hex_shape") < 1)
    )
    bad = (F.col("merit") < 30) & m.isNotNull() & (F.col("resets") < 2) & sign
    d = d.withColumn("bad", F.coalesce(bad, F.lit(False)))
    b = F.col("bad")
    return d.withColumns(
        {
            "tilt": F.when(b, F.col("mean_tilt")).otherwise(F.col("tilt")),
            "hel": F.when(b, m).otherwise(hel),
            "ellPhi": F.when(b, F.col("mean_phi")).otherwise(F.col("ellPhi")),
            "ellA": F.when(b, F.col("mean_ellA")).otherwise(F.col("ellA")),
            "ellB": F.when(b, F.col("mean_ellB")).otherwise(F.col("ellB")),
            "state": F.when(b, 0).otherwise(F.col("state")),
            "resets": F.col("resets") + F.when(b, 1).otherwise(0),
        }
    )


# The metrics kept per frame, in their order.
METRICS = (
    "merit", "n_sf", "uc_avg", "hex_avg", "hex_low", "contrast", "uc_std", "hex_std",
    "tilt", "hel", "ellPhi", "excent", "positionQ", "mirrorQ", "shapeQ", "time",
    "hex_high", "hex_merit", "hex_shape", "sym", "moment2",
)


def unpivot_stats(report: DataFrame, id_col: str = "frame_id") -> DataFrame:
    """One row per frame and metric, for the metrics the report has."""
    have = [m for m in METRICS if m in report.columns]
    return report.select(id_col, *[F.col(m).cast("double").alias(m) for m in have]).unpivot(
        id_col, have, "metric", "value"
    )


def rerun_state(runs: DataFrame, stability: int = 6, peak_points: int = 1) -> DataFrame:
    """Next state of each frame and run (frame_id, run, hex_merit).

    3 requeues the frame, -1 ends it. Every rerun searches two width levels
    narrower and with one more repeat, up to seven. A run looks at the run
    before it only, so an equi join on run - 1 does it.
    """
    before = runs.select(
        "frame_id", (F.col("run") + 1).alias("run"), F.col("hex_merit").alias("_old")
    )
    d = runs.join(before, ["frame_id", "run"], "left")
    gain = F.col("hex_merit") - F.col("_old")
    again = (gain > 0.1) & (gain / F.nullif(F.col("hex_merit"), F.lit(0.0)) > 0.01)
    return d.select(
        "frame_id", "run", "hex_merit", gain.alias("gain"),
        F.when(F.coalesce(again, F.lit(False)), 3).otherwise(-1).alias("state"),
        F.greatest(F.lit(0), stability - 2 * F.col("run")).alias("width_level"),
        F.least(F.lit(7), peak_points + F.col("run")).alias("repeats"),
    )


def largest_bin(frames: DataFrame, by: str = "bin") -> DataFrame:
    """The bin with most frames; the first name wins a tie."""
    n = frames.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), by).limit(1)


def natural_key(name, width: int = 20) -> Column:
    """Sort key in which numbers compare as numbers.

    The digits of every run are padded by a fixed width: prefix each run with
    zeros, then keep its last ``width`` digits.
    """
    padded = F.regexp_replace(col(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def natural_sort(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(natural_key(name), name)


def normalize_weights(weights: DataFrame) -> DataFrame:
    """Scale the free weights so that all weights sum to 1; the states Fixed
    and Lattice keep their weight."""
    fixed = F.col("state").isin("Fixed", "Lattice")
    held = scalar(weights, F.coalesce(F.sum(F.when(fixed, F.col("weight"))), F.lit(0.0)))
    free = scalar(weights, F.sum(F.when(~fixed, F.abs("weight"))))
    return weights.withColumn(
        "weight",
        F.when(fixed, F.col("weight")).otherwise(
            F.abs("weight") * (1 - held) / F.nullif(free, F.lit(0.0))
        ),
    )
