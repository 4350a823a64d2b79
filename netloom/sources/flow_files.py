"""Readers of flow logs: CSV by explicit list and role, uploads with encoding fallback, JSON, manifests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.normalize import clean_name

# The columns of headerless benchmark files; the 47-column form lacks the last two.
RAW_COLUMNS = (
    "srcip sport dstip dsport proto state dur sbytes dbytes sttl dttl sloss dloss service sload dload spkts dpkts swin dwin stcpb dtcpb smeansz dmeansz trans_depth "
    "res_bdy_len sjit djit stime ltime sintpkt dintpkt tcprtt synack ackdat is_sm_ips_ports ct_state_ttl ct_flw_http_mthd is_ftp_login ct_ftp_cmd "
    "ct_srv_src ct_srv_dst ct_dst_ltm ct_src_ltm ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm attack_cat label"
).split()


def role_files(value: str | list[str]) -> list[str]:
    """Paths of a role: a list, or text with commas between; an empty one raises, no pattern is expanded."""
    files = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
    files = [f for f in files if f]
    if not files or any(set("*?[") & set(f) for f in files):
        raise ValueError(f"a role needs explicit files: {value!r}")
    return files


def _has_header(spark: SparkSession, path: str) -> tuple[bool, int]:
    """Whether the first line names columns, and how many there are."""
    first = spark.read.text(path).limit(1).collect()
    cells = [c.strip().strip('"') for c in first[0][0].split(",")] if first else []
    names = {clean_name(c) for c in cells}
    return bool(names & {"attack_cat", "label", "srcip", "proto", "dur", "duration", "src_ip", "flow_duration"}), len(cells)


def read_flows(spark: SparkSession, files: list[str], role: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Text columns of CSV flow files with __source_role and __source_file; malformed lines are dropped.

    Files with a header are read by name, headerless ones by the fixed list; columns are united by name. Values stay
    text: casts are tried where they are used, so that no pass infers a schema.
    """
    out = None
    for path in role_files(files):
        header, width = _has_header(spark, path)
        reader = spark.read.option("mode", "DROPMALFORMED").option("encoding", encoding)
        if header:
            df = reader.option("header", True).csv(path)
            df = df.toDF(*map(clean_name, df.columns))
        else:
            names = RAW_COLUMNS if width == 49 else RAW_COLUMNS[:47] if width == 47 else [f"col_{i}" for i in range(width)]
            df = reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
        df = df.withColumn("__source_role", F.lit(role)).withColumn("__source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_roles(spark: SparkSession, roles: dict[str, list[str]]) -> DataFrame:
    """All roles in one frame; a file in two roles raises."""
    seen: dict[str, str] = {}
    for role, files in roles.items():
        for f in role_files(files):
            if seen.setdefault(f, role) != role:
                raise ValueError(f"{f} is in roles {seen[f]} and {role}")
    out = None
    for role, files in roles.items():
        df = read_flows(spark, files, role)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_upload(spark: SparkSession, path: str, max_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV upload as UTF-8, or Latin-1 if it is not; optionally its first rows and some columns."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    df = spark.read.option("header", True).option("encoding", "ISO-8859-1" if bad else "UTF-8").csv(path)
    df = df.select(*columns) if columns else df
    return df.limit(max_rows) if max_rows else df


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, gzip by extension; give a schema to save the pass that infers it."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two manifests."""
    a, b = before.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    joined = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")
