"""Attack families, engineered features, vocabularies, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.running import quantiles

# The families that models may know, those held out, and the spellings of each.
KNOWN = ("Normal", "DoS", "Exploits", "Reconnaissance", "Generic")
HELD_OUT = ("Fuzzers", "Analysis", "Backdoors", "Shellcode", "Worms")
SPELLINGS = {
    "normal": "Normal", "dos": "DoS", "exploits": "Exploits", "exploit": "Exploits", "reconnaissance": "Reconnaissance", "generic": "Generic", "fuzzers": "Fuzzers",
    "fuzzer": "Fuzzers", "analysis": "Analysis", "backdoor": "Backdoors", "backdoors": "Backdoors", "shellcode": "Shellcode", "worms": "Worms", "worm": "Worms",
}
EPS = 1e-8


def family(raw) -> F.Column:
    """The canonical family of a label; blanks are Normal, unknown words are capitalised."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    text = F.lower(F.when(text.isin("nan", "NaN", "", "None", "-"), "Normal").otherwise(text))
    table = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, text), F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.expr("''")), F.substring(text, 2, 1_000_000)))


def with_family(df: DataFrame, category: str, label: str | None = None) -> DataFrame:
    out = df.withColumn("attack_cat", family(F.col(category)))
    binary = S.number(F.col(label)).cast("int") if label else (F.col("attack_cat") != "Normal").cast("int")
    return out.withColumn("label_binary", binary)


def undeclared(df: DataFrame) -> DataFrame:
    """Families that are neither known nor held out, with their rows; raise if there is any."""
    return df.where(~F.col("attack_cat").isin(*KNOWN, *HELD_OUT)).groupBy("attack_cat").agg(F.count(F.lit(1)).alias("n"))


def require_declared(df: DataFrame) -> DataFrame:
    """df, if all its families are declared; raises else."""
    found = undeclared(df).orderBy("attack_cat").limit(5).collect()
    if found:
        raise ValueError(f"undeclared families: {[r.attack_cat for r in found]}")
    return df


def feature_columns(columns: list[str]) -> dict[str, F.Column]:
    """The engineered features whose inputs are there, as doubles."""
    c, out = F.col, {}
    has = lambda *names: all(n in columns for n in names)
    positive = lambda n: F.greatest(c(n), F.lit(0.0))
    if has("sbytes", "dbytes"):
        total = c("sbytes") + c("dbytes") + EPS
        out |= {"bytes_ratio": c("sbytes") / total, "log_total_bytes": F.log1p(total), "log_sbytes": F.log1p(positive("sbytes")), "log_dbytes": F.log1p(positive("dbytes"))}
    if has("spkts", "dpkts"):
        total = c("spkts") + c("dpkts") + EPS
        out |= {"pkts_ratio": c("spkts") / total, "log_total_pkts": F.log1p(total)}
    if has("sbytes", "dur"):
        dur = F.greatest(c("dur"), F.lit(1e-6))
        packets = c("spkts") if has("spkts") else F.lit(0.0)
        out |= {"src_bps": c("sbytes") / dur, "log_src_bps": F.log1p(c("sbytes") / dur), "pkt_rate": (packets + EPS) / dur}
    if has("sload", "dload"):
        out |= {"load_asym": F.abs(c("sload") - c("dload")) / (c("sload") + c("dload") + EPS), "log_sload": F.log1p(positive("sload"))}
    if has("sttl", "dttl"):
        out |= {"ttl_diff": F.abs(c("sttl") - c("dttl")), "ttl_sum": c("sttl") + c("dttl")}
    for side, name in (("s", "src"), ("d", "dst")):
        if has(f"{side}loss", f"{side}pkts"):
            out[f"loss_rate_{name}"] = c(f"{side}loss") / (c(f"{side}pkts") + EPS)
    if has("sjit", "djit"):
        out |= {"jit_ratio": c("sjit") / (c("djit") + EPS), "log_sjit": F.log1p(positive("sjit"))}
    if has("synack", "ackdat"):
        out |= {"handshake_ratio": c("synack") / (c("ackdat") + EPS), "incomplete_tcp": ((c("synack") > 0) & (c("ackdat") == 0)).cast("double")}
    if has("sintpkt", "dintpkt"):
        out["intpkt_ratio"] = c("sintpkt") / (c("dintpkt") + EPS)
    return out


def engineered(df: DataFrame, keep_null: bool = False) -> DataFrame:
    """df with the engineered features: what is not finite is 0, or with keep_null a null input stays null."""
    features = feature_columns(df.columns)
    return df.select("*", *((x if keep_null else S.finite(x)).alias(n) for n, x in features.items()))


def vocabulary(train: DataFrame, column: str) -> DataFrame:
    """token, idx: distinct normalised categories of the training rows in order. As many rows as the column has values."""
    tokens = train.select(S.category_token(F.col(column)).alias("token")).distinct()
    return tokens.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("idx"))


def encoded(df: DataFrame, column: str, vocab: DataFrame, style: str = "code", version: str = "category-v1", limit: int = 100_000) -> DataFrame:
    """df with {column}_num by a vocabulary fitted elsewhere. Styles for unseen tokens: code (in [-2, -1)), opaque
    (known:i or oov:hash) and index (padding 0, unseen 1, known from 2)."""
    token = S.category_token(F.col(column))
    table = F.broadcast(vocab) if vocab.count() <= limit else vocab
    joined = df.withColumn("_token", token).join(table.select(F.col("token").alias("_token"), F.col("idx").alias("_idx")), "_token", "left")
    if style == "code":
        value = F.coalesce(F.col("_idx").cast("double"), S.unseen_code(column, F.col("_token"), version))
    elif style == "opaque":
        digest = F.sha2(F.concat(F.lit(f'["{version}","{column}","'), F.col("_token"), F.lit('"]')), 256)
        value = F.coalesce(F.concat(F.lit("known:"), F.col("_idx").cast("string")), F.concat(F.lit("oov:"), digest))
    else:
        value = F.coalesce(F.col("_idx") + 2, F.lit(1))
    return joined.withColumn(f"{column}_num", value).drop("_token", "_idx")


def unseen_report(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """known, unseen, unseen_rows of a column against a vocabulary."""
    joined = df.select(S.category_token(F.col(column)).alias("token")).join(vocab, "token", "left")
    return joined.agg(
        F.countDistinct(F.when(F.col("idx").isNotNull(), F.col("token"))).alias("known"), F.countDistinct(F.when(F.col("idx").isNull(), F.col("token"))).alias("unseen"),
        F.count_if(F.col("idx").isNull()).alias("unseen_rows"),
    )


def robust_fit(train: DataFrame, features: list[str]) -> DataFrame:
    """feature, center, scale: median and interquartile range (1 where it is 0), exact."""
    values = train.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("v")).select("v.*")
    stacked = quantiles(values, ["feature"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    width = F.col("q3") - F.col("q1")
    return stacked.select("feature", F.col("q2").alias("center"), F.when(width == 0, 1.0).otherwise(width).alias("scale"))


def robust_apply(df: DataFrame, fitted: DataFrame, features: list[str], clip: float = 10.0) -> DataFrame:
    """Scaled features, cut at the clip. The fit is as many rows as there are features, taken as literals."""
    by = {r.feature: r for r in fitted.collect()}
    scaled = lambda f: F.least(F.greatest((F.col(f) - by[f].center) / by[f].scale, F.lit(-clip)), F.lit(clip))
    return df.select(*(c for c in df.columns if c not in features), *(S.finite(scaled(f)).alias(f) for f in features))


def varying(df: DataFrame, features: list[str], least: float = 1e-8) -> list[str]:
    """The features whose standard deviation exceeds `least`."""
    row = df.agg(*(F.stddev_samp(f).alias(f) for f in features)).first()
    return [f for f in features if row[f] is not None and row[f] > least]


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: mean vector of each class by partial sums for each place."""
    parts = df.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg("v").alias("m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, table: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """key, label, distance of the nearest class mean; the table has a row for each class."""
    pairs = df.select(key, vector).crossJoin(F.broadcast(table))
    d = S.distance(F.col(vector).cast("array<double>"), F.col("centroid"))
    best = pairs.groupBy(key).agg(F.min(F.struct(d.alias("d"), F.col(label))).alias("b"))
    return best.select(key, F.col(f"b.{label}").alias(label), F.col("b.d").alias("distance"))
