"""Reports, rules, weights, statistics, atoms and meshes on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from honeyframe.sources.lines import carry_last, numbered_lines

# Report columns in file order, their aliases and their types.
REPORT_COLUMNS = (
    "label", "slice", "graphene", "peaks", "tuning", "tilt", "ellA", "ellB", "ellPhi",
    "hel", "offX", "offY", "Nsf", "offQ", "offR", "time", "merit", "uc_avg", "hex_avg", "contrast",
    "positionQ", "mirrorQ", "hex_low", "hex_std", "uc_std", "excent", "shapeQ", "hex_high", "hex_merit",
    "hex_shape", "moment2", "state", "stageX", "stageY", "stageN", "imgID", "sym",
)
ALIASES = {
    "filename": "label", "numpeak": "peaks", "ella": "ellA", "ellb": "ellB", "ellphi": "ellPhi",
    "Hex_Shape": "hex_shape", "contrast(std/mean)": "contrast",
}
INT_COLUMNS = ("slice", "peaks", "Nsf", "offQ", "offR", "state", "stageN", "imgID")
STATES = ("Continue", "Finished", "Fixed", "Lattice", "Reset", "Noisify")


def _alias(name: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def _typed(name: str, text: Column) -> Column:
    if name == "label":
        return F.nullif(text, F.lit("null"))
    kind = "int" if name in INT_COLUMNS else "double"
    return text.try_cast(kind)


def read_frame_report(spark: SparkSession, path: str) -> DataFrame:
    """Report rows (grp, 37 columns). Every ``#label`` line sets the order of
    the keys from there on and starts a group; missing keys are NULL."""
    lines = numbered_lines(spark, path)
    d = carry_last(lines, F.col("line").startswith("#label"), F.expr("substring(line, 2)"), "_keys", "grp")
    d = d.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    keys, vals = F.split("_keys", r"[\s,]+"), F.split("line", r"[\s,]+")
    keys = F.transform(keys, _alias)
    n = F.least(F.size(keys), F.size(vals))
    # a key that comes twice keeps its first value
    pairs = F.arrays_zip(F.slice(keys, 1, n).alias("k"), F.slice(vals, 1, n).alias("v"))
    d = d.withColumn("_p", pairs)

    def pick(name):
        return F.get(F.transform(F.filter("_p", lambda e: e["k"] == name), lambda e: e["v"]), F.lit(0))

    return d.select("grp", *[_typed(c, pick(c)).alias(c) for c in REPORT_COLUMNS])


def write_frame_report(report: DataFrame, path: str, keep_skipped: bool = False, group: str | None = "grp") -> None:
    """Tab-separated text with the fixed columns. Each part file starts with the
    header line; groups go to folders of their own, so each begins with one.
    Skipped frames (state -2) are left out unless asked for."""
    d = report
    if not keep_skipped and "state" in d.columns:
        d = d.filter((F.col("state") != -2) | F.col("state").isNull())
    have = set(d.columns)
    cols = [
        (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias("#label" if c == "label" else c)
        for c in REPORT_COLUMNS
    ]
    grp = [F.col(group).alias("report_group")] if group and group in have else []
    d = d.select(*grp, *cols).select(*[F.col(g).alias(g) for g in (["report_group"] if grp else [])],
                                     *[F.coalesce(F.col(f"`{c}`"), F.lit("null" if c == "#label" else "NaN")).alias(c)
                                       for c in ["#label", *REPORT_COLUMNS[1:]]])
    w = d.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "")
    # else a value that starts with # would be quoted as a comment
    w = w.option("comment", "\x01")
    (w.partitionBy("report_group") if grp else w).csv(path)


def read_bin_rules(spark: SparkSession, path: str) -> DataFrame:
    """Bins (bin_id, name and four bounds); -1 is an open bound."""
    lines = numbered_lines(spark, path).filter(F.col("line").startswith("#"))
    tok = F.split("line", r"\s+", 2)
    lines = lines.withColumns({"_t": F.get(tok, F.lit(0)), "_a": F.trim(F.get(tok, F.lit(1)))})
    d = carry_last(lines, F.col("_t") == "#sub_stack", F.col("_a"), "name", "bin_id").filter(F.col("bin_id") >= 0)
    names = ("lower_hex_std", "upper_hex_std", "lower_hex_avg", "upper_hex_avg")
    num = F.get(F.split("_a", r"\s+"), F.lit(0)).try_cast("double")
    return d.groupBy("file", "bin_id", "name").agg(
        *[F.nullif(F.max_by(F.when(F.col("_t") == "#" + n, num), F.when(F.col("_t") == "#" + n, F.col("ord"))), F.lit(-1.0)).alias(n) for n in names]
    ).drop("file")


def read_filter_rules(spark: SparkSession, path: str, known: tuple[str, ...] = REPORT_COLUMNS) -> DataFrame:
    """Rules (key, invert, low, high, known) of lines ``[!]key low [high]``."""
    d = spark.read.text(path).select(F.trim("value").alias("line"))
    d = d.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    t = F.split("line", r"\s+")
    first = F.get(t, F.lit(0))
    key = _alias(F.regexp_replace(first, "^!", ""))
    low = F.get(t, F.lit(1)).try_cast("double")
    return d.select(
        key.alias("key"), first.startswith("!").alias("invert"), low.alias("low"),
        F.when(low.isNotNull(), F.get(t, F.lit(2)).try_cast("double")).alias("high"),
        key.isin(*known).alias("known"),
    )


def read_weights(spark: SparkSession, path: str, n_models: int, default: float | None = None) -> DataFrame:
    """(m, weight, state) for models 0..n-1. Lines are index, weight, state; a
    model without a line is Reset with the default weight, a blank or unknown
    state means Continue."""
    t = F.split(F.trim("value"), r"[\s,]+")
    d = spark.read.text(path).filter(~F.trim("value").startswith("#"))
    d = d.select(
        F.get(t, F.lit(0)).try_cast("long").alias("m"), F.get(t, F.lit(1)).try_cast("double").alias("weight"), F.get(t, F.lit(2)).alias("_s")
    ).filter(F.col("m").isNotNull())
    d = d.withColumn("state", F.when(F.col("_s").isin(*STATES), F.col("_s")).otherwise("Continue")).drop("_s")
    base = spark.range(n_models).select(F.col("id").alias("m"))
    fill = F.lit(1.0 / n_models if default is None else default)
    return base.join(d, "m", "left").select(
        "m", F.coalesce("weight", fill).alias("weight"), F.coalesce("state", F.lit("Reset")).alias("state")
    )


def write_weights(weights: DataFrame, path: str) -> None:
    d = weights.select(F.concat_ws("\t", F.col("m").cast("string"), F.col("weight").cast("string"), "state").alias("value"))
    d.write.mode("overwrite").text(path)


def write_job_stats(sf: DataFrame, path: str, model_min: float, model_max: float) -> None:
    """Range, sum, frame count and summed image, for reports without a rescan."""
    image = sf.groupBy("hp").agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("n"))
    image.write.mode("overwrite").parquet(f"{path}/image")
    # every frame has every position, so one position counts the frames
    done = sf.sparkSession.read.parquet(f"{path}/image")
    done.agg(F.sum("sum").alias("data_sum"), F.max("n").alias("frames"), F.count(F.lit(1)).alias("pixels")).withColumns(
        {"model_min": F.lit(float(model_min)), "model_max": F.lit(float(model_max))}
    ).write.mode("overwrite").parquet(f"{path}/stats")


def read_job_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/image")


def read_atoms_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, z) of four-token lines tagged ATOM or C; the first two
    lines of a file are a head."""
    d = numbered_lines(spark, path)
    head = F.row_number().over(W.partitionBy("file", "block").orderBy("ord"))
    d = d.withColumn("_n", head).filter((F.col("block") > 0) | (F.col("_n") > 2))
    t = F.split("line", r"\s+")
    d = d.filter((F.size(t) == 4) & F.get(t, F.lit(0)).isin("ATOM", "C"))
    return d.select("file", "ord", *[F.get(t, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")])


def topology_lines(nodes: DataFrame, bonds: DataFrame, rings: DataFrame, views: DataFrame, interior: DataFrame | None = None) -> DataFrame:
    """Lines (block, seq, line) of the mesh file.

    nodes (master, observers, x, y, z), bonds (a, b), rings (ring_id, seq,
    atom_id), views (view, atom_id, master, x, y, z). Bonds are written where
    both sides are interior rings (``interior``: a, b), or all of them.
    """
    def num(c):
        return F.format_string("%.4f", F.col(c))

    def line(df, block, seq, *parts):
        return df.select(block.alias("block"), seq.cast("long").alias("seq"), F.concat_ws("\t", *parts).alias("line"))

    text = lambda c: F.col(c).cast("string")
    zero = F.lit(0).cast("long")
    head = nodes.agg(F.count(F.lit(1)).alias("n")).select(zero.alias("block"), zero.alias("seq"), F.concat_ws("\t", F.lit("MASTER"), F.col("n").cast("string")).alias("line"))
    out = head.unionByName(line(nodes, zero + 1, F.col("master"), F.lit("ATOM"), text("master"), text("observers"), num("x"), num("y"), num("z")))
    b = bonds if interior is None else bonds.join(interior.select("a", "b"), ["a", "b"], "left_semi")
    out = out.unionByName(line(b, zero + 2, F.col("a"), F.lit("BOND"), text("a"), text("b")))
    r = rings.groupBy("ring_id").agg(F.sort_array(F.collect_list(F.struct("seq", "atom_id"))).alias("_c"))  # one ring
    out = out.unionByName(line(r, zero + 3, F.col("ring_id"), F.lit("RING"), F.transform("_c", lambda e: e["atom_id"].cast("string"))))
    top = views.select("view").distinct()
    out = out.unionByName(line(top, F.col("view") * 2 + 4, zero, F.lit("VIEW"), text("view")))
    master = F.coalesce("master", F.lit(-1))
    return out.unionByName(line(views, F.col("view") * 2 + 5, F.col("atom_id"), F.lit("ATOM"), master.cast("string"), num("x"), num("y"), num("z")))


def write_topology(lines: DataFrame, path: str) -> None:
    """Part files in order of block and sequence."""
    lines.repartitionByRange("block", "seq").sortWithinPartitions("block", "seq").select("line").write.mode("overwrite").text(path)


def write_signatures(signature: DataFrame, path: str) -> None:
    signature.select(F.concat_ws("\t", F.col("view").cast("string"), F.col("seed").cast("string"), F.col("level").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)


def write_frame_products(counted: DataFrame, masks: DataFrame, quality: DataFrame, path: str, per_block: int = 1000) -> None:
    """Counted images, masks and quality rows under prep, mask and report.

    Frames are kept in blocks of ``per_block`` ids: a folder per frame would
    drown the file system. Only successful frames go into the report.
    """
    block = F.floor(F.col("frame_id") / per_block).alias("block")
    for name, d in (("prep", counted), ("mask", masks)):
        d.select("*", block).write.mode("overwrite").partitionBy("block").parquet(f"{path}/{name}")
    quality.filter("success").write.mode("overwrite").parquet(f"{path}/report")
