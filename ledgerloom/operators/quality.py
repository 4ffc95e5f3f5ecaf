"""Schema inference and cleaning decisions on wide tables: one unpivot, grouped statistics, then a driver decision."""

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.numeric import finite, quantiles, ranged

#: Fixed values of the cleaning policy.
MAX_MISSING, MAX_CORR, LEAK_CORR, BLANK_GAP, PARTITION_CARD, PURITY, CATEGORIES = 0.50, 0.98, 0.90, 0.10, 60, 0.98, 30
ACTIVITY = ("AMT", "TXN", "BAL", "ALERT")
NOT_ACTIVITY = ("R_", "RA_", "D_", "DA_", "RT_", "DEV_", "MM_")
# Patterns on normalised names (capitals and digits only).
POST_OUTCOME = (
    "FRAUDSUSPECT", "SUSPECTEDFRAUD", "FALSEPOSITIVE", "TRUEPOSITIVE", "RESOLUTION", "RESOLVE(D)?DAYS", "RESOLVEDBY", "UNATTENDED", "DISPOSITION", "INVESTIGAT", "CASESTATUS", "CASEOUTCOME",
    "ALERTOUTCOME", "CONFIRMEDFRAUD", "^SAR", "^STR(FILED|RAISED)", "CHARGEBACK", "WRITEOFF", "CLOSUREREASON", "ANALYSTVERDICT",
)
STRUCTURAL = ("^MNTH$", "^MONTH$", "SNAPSHOT", "EXTRACT(DATE|MONTH|ID)?$", "^BATCH", "LOADDATE", "ASOFDATE", "^PARTITION", "^DATAMONTH", "^RUNDATE", "^FILEDATE", "^VINTAGE$")
RAW_DATE = ("DATE$", "^DT", "DTTM", "TIMESTAMP$")
IDENTIFIER = ("^UNNAMED", "^INDEX$", "^ROWID$", "^ROWNUM(BER)?$", "^ID$", "ACC(OUN)?T(NO|NUM|ID)", "CUST(OMER)?ID", "^SRNO$", "^SLNO$")
#: Target names in order of trust.
TARGET_NAMES = ("^FRAUDTGT$", "^ISMULE$", "^MULE$", "^ISFRAUD$", "FRAUD.*(TGT|TARGET|LABEL|FLAG)", "MULE.*(TGT|TARGET|LABEL|FLAG)", "^(TARGET|TGT|LABEL|CLASS|Y)$", "(TARGET|LABEL)$")
#: Vocabularies with an order, and the value of each word.
ORDINAL = (
    {"L7D": 7, "L14D": 14, "L31D": 31, "L90D": 90, "L180D": 180, "L365D": 365, "G365D": 730},
    {"NONE": 0, "LOW": 1, "MEDIUM": 2, "MED": 2, "HIGH": 3, "VERYHIGH": 4},
    {"XS": 0, "S": 1, "M": 2, "L": 3, "XL": 4},
)
#: Statistics that a column name may begin with, and the rails that one may hold, the first listed first.
FAMILY_STATS = ("RA", "DA", "D_TA", "AVG", "MAX", "MIN", "MM", "TOT", "R", "D")
FAMILY_CHANNELS = {
    "CASH": "cash", "CHQ": "cheque", "UPI": "UPI", "ATM": "ATM", "ELEC_XFER": "online transfer (IMPS/NEFT/RTGS)", "POS_PYMT": "merchant payment", "NET_BNKING": "net banking", "MBNKING": "mobile banking",
    "BBPS": "bill payment", "APB": "Aadhaar Payment Bridge", "GST": "GST", "LOAN": "loan", "STDNG": "standing instruction", "NON_CASH_CHQ": "non-cash non-cheque", "CI": "customer-induced", "BI_FEES_CHRGS": "bank fees/charges",
}


def long(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """One row a cell: keep, column, value (text, null for null or NaN)."""
    text = [F.when(F.isnan(F.col(f"`{c}`").cast("double")), F.lit(None)).otherwise(F.col(f"`{c}`").cast("string")).alias(c) if t in ("double", "float") else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes if c in names]
    return df.select(*keep, *text).unpivot(list(keep), names, "column", "value")


def pearson(a: Column, b: Column) -> Column:
    """Correlation of complete pairs; null where one side does not vary (corr raises there in ANSI mode)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def normalise(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "")


def plain(name: str) -> str:
    """normalise() of one name."""
    return re.sub("[^A-Z0-9]+", "", name.upper())


def says(name: Column, patterns: tuple[str, ...]) -> Column:
    return normalise(name).rlike("|".join(patterns))


def named(columns: list[str], patterns: tuple[str, ...]) -> list[str]:
    """The columns whose normalised name has one of the patterns."""
    return [c for c in columns if re.search("|".join(patterns), plain(c))]


def profile(df: DataFrame) -> DataFrame:
    """Per column: n, nulls, distinct, is_binary (exactly 0 and 1), is_id (name, or nearly all different), is_categorical.

    Real numbers are never identifiers for being different: every measurement is.
    """
    kinds = dict(df.dtypes)
    names = list(kinds)
    cells = long(df, names)
    v = F.expr("try_cast(value AS double)")
    g = cells.groupBy("column").agg(F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"), F.count_distinct("value").alias("distinct"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_distinct(v).alias("numbers"), F.count(v).alias("castable"))
    real = df.sparkSession.createDataFrame([(c, t in ("double", "float"), t == "string") for c, t in kinds.items()], "column string, is_real boolean, is_text boolean")
    g = g.join(F.broadcast(real), "column")
    binary = (F.col("numbers") == 2) & (F.col("lo") == 0) & (F.col("hi") == 1) & (F.col("castable") == F.col("n") - F.col("nulls"))
    ident = says(F.col("column"), IDENTIFIER) | (~F.col("is_real") & (F.col("n") > 50) & (F.col("distinct") >= 0.99 * F.col("n")))
    return g.select("column", "n", "nulls", "distinct", binary.alias("is_binary"), ident.alias("is_id"), (F.col("is_text") & (F.col("distinct") > 1) & (F.col("distinct") <= CATEGORIES)).alias("is_categorical"))


def identifiers(df: DataFrame, target: str) -> list[str]:
    """Identifier columns: those named so, and those nearly all different, unless these are more than 5 and a tenth of all columns."""
    found = {r.column for r in profile(df.drop(target)).filter("is_id").collect()}
    by_name = [c for c in df.columns if c in found and named([c], IDENTIFIER)]
    by_values = [c for c in df.columns if c in found and c not in by_name]
    return by_name + (by_values if len(by_values) <= max(5, 0.10 * len(df.columns)) else [])


def resolve_target(df: DataFrame, configured: str | None = None) -> tuple[str, str]:
    """(column, how): the configured one, else a binary column by name, the only binary column, or the last column."""
    if configured and configured in df.columns:
        return configured, "configured"
    binary = [r.column for r in profile(df).filter("is_binary").collect()]
    binary = [c for c in df.columns if c in binary]
    for pattern in TARGET_NAMES:
        for c in binary:
            if re.search(pattern, plain(c)):
                return c, "name"
    if len(binary) == 1:
        return binary[0], "only binary column"
    if binary and binary[-1] == df.columns[-1]:
        return binary[-1], f"LOW CONFIDENCE: last column; also binary: {', '.join(binary[:-1])}"
    raise ValueError("no target found; name it")


def ordinal_mapping(values: list[str]) -> dict[str, int] | None:
    """Normalised word -> value, of the vocabulary that holds all the values, given more than two."""
    seen = {plain(str(v)) for v in values if v is not None}
    return next((dict(o) for o in ORDINAL if len(seen) > 2 and seen <= set(o)), None)


def leak_names(columns: DataFrame) -> DataFrame:
    """column -> normalised, post_outcome (known only after an investigation), structural (how the table was put together), raw_date."""
    return columns.select("column", normalise(F.col("column")).alias("normalised"), says(F.col("column"), POST_OUTCOME).alias("post_outcome"), says(F.col("column"), STRUCTURAL).alias("structural"), says(F.col("column"), RAW_DATE).alias("raw_date"))


def leak_codes(dictionary: DataFrame) -> DataFrame:
    """feature, kind of a dictionary (feature, name): columns whose readable name or code says leak; post_outcome before structural."""
    either = lambda p: says(F.coalesce("name", F.lit("")), p) | says(F.col("feature"), p)
    kind = F.when(either(POST_OUTCOME), "post_outcome").when(either(STRUCTURAL), "structural")
    return dictionary.select("feature", kind.alias("kind")).filter("kind is not null")


def raw_dates(df: DataFrame, target: str) -> list[str]:
    """Columns named like dates that are not numbers."""
    kinds = dict(df.dtypes)
    number = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [c for c in named([c for c in df.columns if c != target], RAW_DATE) if kinds[c] not in number and not kinds[c].startswith("decimal")]


def name_family(columns: DataFrame) -> DataFrame:
    """column -> stat, channel, direction, window read from its name."""
    up = F.upper("column")
    stat, channel = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in reversed(FAMILY_STATS):
        stat = F.when(up.startswith(s + "_"), s).otherwise(stat)
    for token, name in reversed(FAMILY_CHANNELS.items()):
        channel = F.when(up.contains(token), name).otherwise(channel)
    direction = F.when(up.contains("_CR_") | up.endswith("_CR"), "CR").when(up.contains("_DB_") | up.endswith("_DB"), "DB")
    both = F.regexp_replace(F.regexp_extract(up, r"_L(\d+_\d+D)$", 1), "^$", "")
    one = F.regexp_extract(up, r"_L(\d+D)$", 1)
    return columns.select("column", stat.alias("stat"), channel.alias("channel"), direction.alias("direction"), F.when(both != "", both).when(one != "", one).alias("window"))


def partitions(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Columns whose values mostly hold one class: n_values, purity (null values count in n only), is_partition."""
    cells = long(df, names, target)
    by = cells.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"), F.sum(F.col(target)).alias("pos"))
    every = cells.groupBy("column").agg(F.count("*").alias("all"))
    g = by.groupBy("column").agg(F.count("*").alias("n_values"), F.sum(F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), F.col("n")).otherwise(0)).alias("pure"), F.max(F.when(F.col("pos") == F.col("n"), 1).otherwise(0)).alias("some_pos"), F.max(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("some_neg"))
    g = g.join(every, "column").withColumn("purity", F.round(F.col("pure") / F.col("all"), 6))
    ok = (F.col("n_values") > 1) & (F.col("n_values") <= PARTITION_CARD) & (F.col("purity") >= PURITY) & (F.col("some_pos") == 1) & (F.col("some_neg") == 1)
    return g.select("column", "n_values", "purity", ok.alias("is_partition"))


def row_order(df: DataFrame, target: str, order: str) -> DataFrame:
    """Does the place of a row give the class away: auroc of the place, separation, is_sorted. The order is named, never implied.

    Rank sums need row numbers only; rows are numbered within ranges of the order column that hold about equally many.
    """
    r = ranged(df.select(F.col(order).alias("_o"), F.col(target).alias("_y")), "_o")
    n = r.groupBy("_b").agg(F.count("*").alias("_n"))
    n = n.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    r = r.join(F.broadcast(n), "_b").withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_o")))
    a = r.agg(F.sum(F.when(F.col("_y") == 1, F.col("place"))).cast("double").alias("s"), F.sum("_y").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))
    a = a.select(F.round(auc, 6).alias("auroc"), F.round(2 * F.abs(auc - 0.5), 6).alias("separation"))
    return a.withColumn("is_sorted", F.col("separation") > 0.98)


def blank_gap(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    cells = long(df, names, target)
    blank = F.col("value").isNull().cast("double")
    g = cells.groupBy("column").agg(F.avg(F.when(F.col(target) == 1, blank)).alias("a"), F.avg(F.when(F.col(target) == 0, blank)).alias("b"))
    return g.select("column", F.round("a", 6).alias("blank_pos"), F.round("b", 6).alias("blank_neg"), (F.abs(F.col("a") - F.col("b")) > BLANK_GAP).alias("drop"))


def is_activity(name: str) -> bool:
    return any(a in name.upper() for a in ACTIVITY) and not name.upper().startswith(NOT_ACTIVITY)


def zero_fill(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c)).cast(t) if t in ("double", "float") else F.col(c), F.lit(0).cast(t)) for c, t in df.dtypes if is_activity(c) and t != "string"})


def sparse(df: DataFrame, names: list[str]) -> DataFrame:
    g = long(df, names).groupBy("column").agg(F.avg(F.col("value").isNull().cast("double")).alias("m"))
    return g.select("column", F.round("m", 6).alias("missing"), (F.col("m") > MAX_MISSING).alias("drop"))


def target_correlation(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    cells = long(df, names, target).withColumn("x", F.expr("try_cast(value AS double)")).filter("x is not null")
    g = cells.groupBy("column").agg(pearson(F.col("x"), F.col(target).cast("double")).alias("r"))
    return g.select("column", F.round("r", 6).alias("corr"), F.coalesce(F.abs("r") > LEAK_CORR, F.lit(False)).alias("drop"))


def constant(df: DataFrame, names: list[str]) -> DataFrame:
    g = long(df, names).groupBy("column").agg((F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("k"), F.var_pop(F.expr("try_cast(value AS double)")).alias("v"))
    return g.select("column", F.col("k").alias("n_values"), ((F.col("k") <= 1) | F.coalesce(F.col("v") == 0, F.lit(False))).alias("drop"))


def collinear(df: DataFrame, names: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """a, b, corr of column pairs (mean-filled) beyond the limit; b, the later one, is to drop unless protected.

    One distributed matrix product; only the k x k matrix comes to the driver.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    clean = lambda c: finite(F.col(c))
    means = df.agg(*[F.avg(clean(c)).alias(c) for c in names]).first()
    filled = df.select(*[F.coalesce(clean(c), F.lit(float(means[c] or 0.0))).alias(c) for c in names])
    rows = []
    if len(names) > 1 and not filled.isEmpty():
        r = Correlation.corr(VectorAssembler(inputCols=names, outputCol="_x").transform(filled), "_x").first()[0].toArray()
        rows = [(names[i], names[j], round(float(r[i, j]), 6), names[j] not in protected) for i in range(len(names)) for j in range(i + 1, len(names)) if abs(r[i, j]) > MAX_CORR]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double, drop boolean")


def separation(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Columns that part the classes: disjoint ranges, or (20 values at most) one value far likelier in a class."""
    cells = long(df, names, target).withColumn("x", F.expr("try_cast(value AS double)")).filter("x is not null")
    pos = F.col(target) == 1
    by = cells.groupBy("column", "x").agg(F.count(F.when(pos, 1)).alias("p"), F.count(F.when(~pos, 1)).alias("q"))
    every = Window.partitionBy("column")
    gap = F.col("p") / F.nullif(F.sum("p").over(every), F.lit(0)) - F.col("q") / F.nullif(F.sum("q").over(every), F.lit(0))
    g = by.withColumn("gap", gap).groupBy("column").agg(F.count("*").alias("k"), F.max("gap").alias("gap"), F.min(F.when(F.col("p") > 0, F.col("x"))).alias("p0"), F.max(F.when(F.col("p") > 0, F.col("x"))).alias("p1"), F.min(F.when(F.col("q") > 0, F.col("x"))).alias("q0"), F.max(F.when(F.col("q") > 0, F.col("x"))).alias("q1"))
    disjoint = F.coalesce((F.col("p0") > F.col("q1")) | (F.col("p1") < F.col("q0")), F.lit(False))
    share = F.when(F.col("k") <= 20, F.round("gap", 6))
    return g.select("column", disjoint.alias("disjoint"), share.alias("max_share_gap"), (disjoint | F.coalesce(share > 0.95, F.lit(False))).alias("separates"))


def encode_ordinal(column: Column, order: dict[str, int]) -> Column:
    """The value of each word, null for words outside the vocabulary."""
    table = F.create_map(*[F.lit(x) for k, v in order.items() for x in (k, float(v))])
    return F.try_element_at(table, normalise(column))


def _words(df: DataFrame, column: str) -> list[str]:
    """The different values in order, one more than CATEGORIES at most."""
    return sorted(r[0] for r in df.select(F.col(f"`{column}`").cast("string")).distinct().limit(CATEGORIES + 2).collect() if r[0] is not None)


def encode(df: DataFrame, column: str) -> DataFrame:
    """A categorical column as numbers: in place if its values have an order, else one-hot."""
    if order := ordinal_mapping(_words(df, column)):
        return df.withColumn(column, encode_ordinal(F.col(f"`{column}`").cast("string"), order))
    return encode_onehot(df, column)


def encode_onehot(df: DataFrame, column: str) -> DataFrame:
    """df with mg_<column>_<value> (0/1) for each value in order, and without the column; more than 30 values: only dropped."""
    values = _words(df, column)
    if len(values) > CATEGORIES:
        return df.drop(column)
    return df.withColumns({f"mg_{column}_{v}": F.coalesce(F.col(column).cast("string") == v, F.lit(False)).cast("int") for v in values}).drop(column)


def training_medians(df: DataFrame, names: list[str]) -> DataFrame:
    """position, column, median: the contract of a model's inputs."""
    cells = quantiles(df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in names]), names, [0.5]).select("column", F.col("value").alias("m"))
    place = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "position long, column string")
    return place.join(cells, "column", "left").select("position", "column", F.round("m", 6).alias("median"))


def map_extract(df: DataFrame, contract: DataFrame) -> tuple[DataFrame, dict]:
    """df with exactly the contract's columns (absent ones null), and its coverage; usable from half on."""
    wanted = [r.column for r in contract.orderBy("position").collect()]
    by = {plain(c): c for c in reversed(df.columns)}
    source = {w: by.get(plain(w)) for w in wanted}
    known = [w for w, s in source.items() if s]
    out = df.select(*[F.expr(f"try_cast(`{s}` AS double)").alias(w) if s else F.lit(None).cast("double").alias(w) for w, s in source.items()])
    coverage = len(known) / max(1, len(wanted))
    return out, {"coverage": round(coverage, 4), "usable": coverage >= 0.5, "absent": [w for w in wanted if not source[w]], "unrecognised": [c for c in df.columns if c not in source.values()]}


def hardened(df: DataFrame, target: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """The whole cleaning: identifiers, leak names, raw dates, categories as numbers, partitions, blank gaps, zero fill, sparse, leak correlation, constants, collinear, separation audit."""
    report: dict = {}

    def drop(df: DataFrame, step: str, names) -> DataFrame:
        gone = [c for c in names if c != target and c not in keep and c in df.columns]
        report[step] = gone
        return df.drop(*gone)

    rest = lambda d: [c for c in d.columns if c != target]
    flagged = lambda f, c="drop": [r.column for r in f.filter(c).collect()]
    from ledgerloom.sources.io import written

    df = written(df, "matrix")  # every step reads the table anew, so plans must not grow with the steps
    df = drop(df, "identifiers", identifiers(df, target))
    df = drop(df, "leak_names", named(df.columns, POST_OUTCOME + STRUCTURAL))
    df = drop(df, "raw_dates", raw_dates(df, target))
    for c in [r.column for r in profile(df).filter("is_categorical").collect()]:
        if c != target and c not in keep:
            df = encode(df, c)
    df = df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c != target else F.col(c) for c in df.columns])
    df = written(df, "matrix")
    df = drop(df, "partitions", flagged(partitions(df, target, rest(df)), "is_partition"))
    df = drop(df, "blank_gap", flagged(blank_gap(df, target, rest(df))))
    df = written(zero_fill(df), "matrix")
    df = drop(df, "sparse", flagged(sparse(df, rest(df))))
    df = drop(df, "leak_correlation", flagged(target_correlation(df, target, rest(df))))
    df = drop(df, "constant", flagged(constant(df, rest(df))))
    df = drop(df, "collinear", [r.b for r in collinear(df, rest(df)).filter("drop").collect()])
    report["separates"] = flagged(separation(df, target, rest(df)), "separates")
    return df, report


def random_columns(names: list[str], k: int, seed: int = 42) -> list[str]:
    """k of the names, without replacement, by hash; the same on every run."""
    return sorted(sorted(names, key=lambda c: (hashlib.md5(f"{c}:{seed}".encode()).hexdigest(), c))[:k])


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """The columns of a that b has too, whatever their case and signs."""
    known = {plain(c) for c in b.columns}
    return [c for c in a.columns if plain(c) in known]


def shortlist(dictionary: DataFrame, names: list[str], flag: str = "bank_final") -> tuple[list[str], list[str]]:
    """(features of the dictionary whose readable name is one of `names`, features that the institution has flagged as final), in order."""
    wanted = [plain(n) for n in names]
    by_name = dictionary.filter(normalise(F.coalesce("name", F.lit(""))).isin(*wanted)).select("feature").distinct()
    final = dictionary.filter(F.upper(F.coalesce(F.col(flag).cast("string"), F.lit(""))).isin("1", "Y", "YES", "TRUE")).select("feature").distinct() if flag in dictionary.columns else None
    return sorted(r.feature for r in by_name.collect()), sorted(r.feature for r in final.collect()) if final is not None else []


def stratified_sample(df: DataFrame, target: str, key: str, rows: int) -> DataFrame:
    """Every positive, and negatives in hash order up to `rows` in all."""
    pos = df.filter(F.col(target) == 1)
    return pos.unionByName(df.filter(F.col(target) == 0).orderBy(F.md5(F.col(key).cast("string")), key).limit(max(0, rows - pos.count())))
