"""Encoding operators: fixed category maps, label codes, imputation, bins, one-hot."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import stable
from . import ranking as R
from .joins import lookup

# Category codes used at serving time.
CATEGORY_MAPS: dict[str, dict[str, int]] = {
    "grade": {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4, "F": 5, "G": 6},
    "home_ownership": {"RENT": 0, "OWN": 1, "MORTGAGE": 2, "OTHER": 3},
    "purpose": {
        "debt_consolidation": 0,
        "credit_card": 1,
        "home_improvement": 2,
        "other": 3,
        "major_purchase": 4,
        "medical": 5,
        "small_business": 6,
    },
}

# Pd.cut edges and labels of the campaign bins.
AGE_BINS = ([0, 30, 45, 60, 120], ["Young", "Adult", "Mid", "Senior"])
BALANCE_BINS = ([-5000, 0, 1500, 5000, 100000], ["Negative", "Low", "Medium", "High"])
DURATION_BINS = ([0, 180, 600, 2000, 10000], ["Short", "Medium", "Long", "VeryLong"])

# The campaign features that models read, and the binned ones.
CAMPAIGN_FEATURES = ["job", "marital", "education", "default", "housing", "loan", "contact", "month", "day", "campaign",
                     "pdays", "previous", "poutcome"]
BIN_FEATURES = ["age_category", "balance_category", "duration_category"]


def _lookup(mapping: dict[str, int]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def encode_known_categories(df: DataFrame) -> DataFrame:
    """Fixed maps; grade upper+trim, purpose trim+lower, home_ownership trim only;
    unseen or missing -> 0; a numeric input column is coerced to int instead."""
    types = dict(df.dtypes)
    cols = {}
    for col, mapping in CATEGORY_MAPS.items():
        if col not in df.columns:
            continue
        if types[col] == "string":
            s = F.trim(F.col(col))
            if col == "grade":
                s = F.upper(s)
            elif col == "purpose":
                s = F.lower(s)
            cols[col] = F.coalesce(_lookup(mapping)[s], F.lit(0)).cast("int")
        else:
            cols[col] = X.safe_numeric(F.col(col), 0.0).cast("int")
    return df.withColumns(cols) if cols else df


def prepare_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Encode, add absent features as 0, select in the given order, coerce to DOUBLE
    (NULL -> 0). ``keep`` columns (ids) are carried in front."""
    enc = encode_known_categories(df)
    sel = [F.col(k) for k in keep or []]
    types = dict(enc.dtypes)
    for f in features:
        src = F.col(f) if f in types else F.lit(0.0)
        # numbers need no way through text, which gives the same value back
        sel.append(X.safe_numeric(src, 0.0, types.get(f, "double") in ("double", "int", "bigint", "smallint", "tinyint")).alias(f))
    return enc.select(*sel)


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): alphabetical 0-based codes over the distinct values, NULL as the
    text 'nan' (pandas ``astype(str)``). Codes come from a range-partitioned global
    rank of the distinct values, never one task."""
    vals = df.select(F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias("_lv")).distinct()
    ranked = R.global_row_number(vals, [F.col("_lv")], out="_code")
    return ranked.select(F.col("_lv"), (F.col("_code") - 1).cast("int").alias("_code"))


def label_codes_all(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code) for several columns from one ranking: the distinct
    (column, value) pairs are ranked within each column (skew-safe group ranking)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("_lv"))
                      for c in cols])
    vals = df.select(F.inline(pairs)).distinct()
    ranked = R.group_row_number(vals, ["_c"], [F.col("_lv")], out="_code", few=True)
    return ranked.select("_c", "_lv", (F.col("_code") - 1).cast("int").alias("_code"))


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Alphabetical 0-based codes refit on the data for every column in ``cols``."""
    codes = stable(label_codes_all(df, cols), "label_codes")
    rows = codes.count()
    out = df
    for c in cols:
        cc = codes.filter(F.col("_c") == c).drop("_c")
        out = out.withColumn("_lv", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        out = lookup(out, cc, ["_lv"], rows=rows).drop("_lv", c).withColumnRenamed("_code", c)
    return out


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULLs with the exact column median (not ``Imputer``, which is approximate).

    All columns in one job: rows are unpivoted to (column, value) and counted per
    distinct pair on the map side, then one ranking yields every column's median."""
    lf = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])))
    per_col = R.group_quantiles(lf, ["_c"], "_v", {"_m": 0.5}, few=True)  # one row per column
    med = per_col.groupBy().pivot("_c", cols).agg(F.first("_m"))
    med = med.select(*[F.col(f"`{c}`").alias(f"_med_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(med))  # one row of medians
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).drop(*[f"_med_{c}" for c in cols])


def bin_features(df: DataFrame) -> DataFrame:
    """Right-closed bins (first bin closed on the left); missing -> 0 before binning;
    outside every bin -> 'nan' (the reference's string for an empty category)."""
    def num(c: str) -> Column:
        return X.safe_numeric(F.col(c), 0.0)
    return df.withColumns({
        "age_category": X.cut(num("age"), *AGE_BINS),
        "balance_category": X.cut(num("balance"), *BALANCE_BINS),
        "duration_category": X.cut(num("duration"), *DURATION_BINS),
    })


def target_flag(col: str = "y") -> Column:
    return F.when(F.col(col) == "yes", 1).otherwise(0).alias("target")


def one_hot_columns(df: DataFrame, cat_cols: list[str]) -> list[tuple[str, str]]:
    """Sorted (column, value) pairs to encode: the distinct pairs, counted map-side in one pass
    over all columns. Each becomes a column of the design, so their number is the design's width."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cat_cols)])).alias("p"))
    found = each.select("p.i", "p.v").filter("v is not null").distinct().orderBy("i", "v")
    pairs = [(cat_cols[r.i], r.v) for r in found.toLocalIterator()]
    return pairs


def dummy_name(c: str, v: str, safe: bool = False) -> str:
    name = f"{c}_{v}"
    return re.sub(r"[^0-9A-Za-z_]", "_", name) if safe else name


def one_hot(df: DataFrame, cat_cols: list[str], pass_cols: list[str], keep: list[str] | None = None,
            pairs: list[tuple[str, str]] | None = None, safe_names: bool = False) -> tuple[DataFrame, list[str]]:
    """``pd.get_dummies``: pass-through columns first, then ``col_value`` 0/1 columns in
    column order and sorted value order. Returns the frame and its feature list.
    ``safe_names`` maps characters other than letters, digits and ``_`` to ``_`` (ML
    column references cannot contain dots)."""
    pairs = pairs if pairs is not None else one_hot_columns(df, cat_cols)
    feats = list(pass_cols) + [dummy_name(c, v, safe_names) for c, v in pairs]
    sel = [F.col(k) for k in keep or []] + [F.col(c) for c in pass_cols]
    sel += [(F.col(c).cast("string") == v).cast("int").alias(dummy_name(c, v, safe_names)) for c, v in pairs]
    return df.select(*sel), feats


def category_table(df: DataFrame, cat_cols: list[str], first: int = 0) -> DataFrame:
    """The dictionary of a one-hot design: (column, value, feature, place, index) for every distinct value of every
    column, in column order and sorted value order. place counts within a column, index over all from ``first`` on.
    A table, so the number of categories is not bounded by columns or by the driver."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_k"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cat_cols)])
    each = df.select(F.inline(pairs)).filter("value is not null").distinct()
    placed = R.global_row_number(each, [F.col("_k"), F.col("value")], out="_rn")
    low = placed.groupBy("_k").agg(F.min("_rn").alias("_low"))  # a row for each column
    placed = placed.join(F.broadcast(low), "_k")
    return stable(placed.select("column", "value", F.concat_ws("_", "column", "value").alias("feature"), (F.col("_rn") - F.col("_low")).alias("place"),
                                (F.col("_rn") - 1 + first).cast("long").alias("index")), "categories")


def sparse_design(df: DataFrame, cat_cols: list[str], pass_cols: list[str], keep: list[str] | None = None, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(frame, dictionary): ``keep`` columns and a vector ``features``, first the ``pass_cols`` as numbers (null: 0), then a
    1 for each category that the row has, placed by the dictionary (:func:`category_table`, made if not given). The
    vectors are sparse: a row has as many entries as features, whatever the number of categories. A missing
    value and one that the dictionary does not have give no entry."""
    table = category_table(df, cat_cols, len(pass_cols)) if table is None else table
    sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each column
    total = sum(sizes.values())
    out = df.select(*(keep or []), *[F.coalesce(X.safe_numeric(F.col(c), 0.0), F.lit(0.0)).alias(f"_n_{i}") for i, c in enumerate(pass_cols)], *[F.col(c).cast("string").alias(f"_v_{i}") for i, c in enumerate(cat_cols)])
    vectors = []
    for i, c in enumerate(cat_cols):
        if not sizes.get(c):
            continue
        own = table.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{i}"), F.col("place").cast("double").alias("_p"))
        out = lookup(out, own, [f"_v_{i}"], rows=total)
        # one place more than there are categories: dropped as the last, so a row without a category has no entry
        levels = {"ml_attr": {"type": "nominal", "num_vals": sizes[c] + 1}}
        out = out.withColumn(f"_p_{i}", F.coalesce("_p", F.lit(float(sizes[c]))).alias(f"_p_{i}", metadata=levels)).drop("_p")
        vectors.append(i)
    if vectors:
        encoder = OneHotEncoder(inputCols=[f"_p_{i}" for i in vectors], outputCols=[f"_o_{i}" for i in vectors], dropLast=True)
        out = encoder.fit(out).transform(out)
    parts = [f"_n_{i}" for i in range(len(pass_cols))] + [f"_o_{i}" for i in vectors]
    out = VectorAssembler(inputCols=parts, outputCol="features").transform(out)
    return out.select(*(keep or []), "features"), table


def sparse_entries(design: DataFrame, table: DataFrame, pass_cols: list[str], keep: list[str]) -> DataFrame:
    """The entries of a sparse design that are not 0 as rows: ``keep`` columns, feature, value."""
    v = F.unwrap_udt("features")
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    each = design.select(*keep, F.inline(F.arrays_zip(places.alias("index"), v["values"].alias("value")))).filter("value <> 0")
    spark = design.sparkSession
    names = table.select(F.col("index").cast("int").alias("index"), "feature")
    if pass_cols:
        names = names.union(spark.createDataFrame(list(enumerate(pass_cols)), "index int, feature string"))
    return lookup(each, names, ["index"], "inner").select(*keep, "feature", "value")


def feature_means(design: DataFrame, table: DataFrame, pass_cols: list[str]) -> DataFrame:
    """(feature, mean) over all rows of a sparse design; a feature without entries has mean 0."""
    n = design.agg(F.count(F.lit(1)).alias("_n"))
    spark = design.sparkSession
    names = table.select("feature")
    if pass_cols:
        names = names.union(spark.createDataFrame([(c,) for c in pass_cols], "feature string"))
    total = sparse_entries(design, table, pass_cols, []).groupBy("feature").agg(F.sum("value").alias("_s"))
    out = names.join(total, "feature", "left").crossJoin(F.broadcast(n))
    return out.select("feature", (F.coalesce("_s", F.lit(0.0)) / F.nullif(F.col("_n"), F.lit(0))).alias("mean"))


def campaign_columns(campaign: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """(binned campaign rows with ``target``, category columns, number columns) of the campaign design."""
    data = bin_features(campaign).withColumn("target", F.when(F.col("y") == "yes", 1).otherwise(0))
    types = dict(data.dtypes)
    cols = BIN_FEATURES + [c for c in CAMPAIGN_FEATURES if c in data.columns]
    return data, [c for c in cols if types[c] == "string"], [c for c in cols if types[c] != "string"]


def campaign_design(campaign: DataFrame, pairs: list[tuple[str, str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Campaign table -> (client_id, target, one-hot features) and the feature list."""
    data, cats, nums = campaign_columns(campaign)
    keep = [k for k in ["client_id", "target"] if k in data.columns]
    return one_hot(data, cats, nums, keep=keep, pairs=pairs, safe_names=True)


def align_features(df: DataFrame, feature_columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Re-encode new rows to a frozen training column list: absent -> 0, unseen
    categories dropped, everything numeric (NULL -> 0)."""
    data = bin_features(df)
    types = dict(data.dtypes)
    sel = [F.col(k) for k in keep or []]
    for f in feature_columns:
        if f in data.columns and types[f] != "string":
            sel.append(X.safe_numeric(F.col(f), 0.0).alias(f))
            continue
        hit = None
        for c in BIN_FEATURES + CAMPAIGN_FEATURES:
            if f.startswith(c + "_") and c in data.columns and types[c] == "string":
                hit = (F.col(c) == F.lit(f[len(c) + 1:])).cast("double")
                break
        sel.append(F.coalesce(hit, F.lit(0.0)).alias(f) if hit is not None else F.lit(0.0).alias(f))
    return data.select(*sel)
