
from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from dataclasses import dataclass, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFER = (
    "document_id string, language string, doc_type string, product_family string, technology array<string>, customer_segment array<string>, "
    "commitment_type string, usage_focus array<string>, metadata struct<title_ar: string, title_fr: string, company: string, version: string, effective_date: string>, "
    "offer_core struct<name_ar: string, name_fr: string, description_ar: string, description_fr: string, conditions_ar: array<string>, conditions_fr: array<string>, "
    "benefits_ar: array<string>, benefits_fr: array<string>, pricing_summary_ar: string, pricing_summary_fr: string>, "
    "policy_summary struct<summary_ar: string, summary_fr: string>, faq_ar array<struct<question: string, answer: string>>, faq_fr array<struct<question: string, answer: string>>, "
    "contact struct<phone: string, email: string, notes_ar: string, notes_fr: string>, keywords_ar array<string>, keywords_fr array<string>, keywords array<string>, search_text string, dense_text_primary string"
)
GUIDE = (
    "id string, title string, system string, business_process string, filename string, relative_path string, language array<string>, date string, tags array<string>, "
    "summary string, prerequisites array<string>, s3_key string, sections array<struct<section_title: string, description: string, steps: array<struct<step_number: int, action: string, details: string, ui: string>>>>"
)
CONVENTION = (
    "filename string, establishment string, beneficiaries string, purpose string, keywords array<string>, "
    "internet_offers_table array<struct<category_segment: string, offer_type: string, speed: string, price: string, benefits: string>>, telephony_offers_table array<struct<offer: string, price: string, benefits: string>>, "
    "other_tables array<struct<table_name: string, data: array<map<string, string>>>>, required_documents_new array<string>, required_documents_switch array<string>, notes array<string>"
)
CATALOGUE = "s3_key string, filename string, category string, ext string, lang string"


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_objects(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object, or one array of objects, per file, with the path of its file in `_file_path`; malformed files give no rows."""
    full = T.StructType([*_struct(schema).fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file_path")).filter("_bad is null").drop("_bad")


def read_objects(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """The objects of a folder's JSON files, and the rejects (path, reason, content, and the key as far as it was read): `malformed` files, which give no rows, and objects
    with `no <key>`, which stay among the rows. FileNotFoundError without the folder, ValueError without a JSON file in it."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if not listed(spark, path) or files(spark, path, "*.json").limit(1).count() == 0:
        raise ValueError(f"no JSON files in {path}")
    full = T.StructType([*_struct(schema).fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_path").alias("_file_path"))
    good = rows.filter("_bad is null").drop("_bad")
    bad = rows.filter("_bad is not null").select(F.col("_file_path").alias("path"), F.lit("malformed").alias("reason"), F.col("_bad").alias("content"), key)
    nameless = good.filter(F.coalesce(F.col(key), F.lit("")) == "")
    named = nameless.select(F.col("_file_path").alias("path"), F.lit(f"no {key}").alias("reason"), F.to_json(F.struct(*(c for c in good.columns if c != "_file_path"))).alias("content"), key)
    return good, bad.unionByName(named)


def json_container(spark: SparkSession, path: str, schema: str | T.StructType, keys: tuple[str, ...] = ("queries", "products", "data", "guides")) -> DataFrame:
    """The objects of files that hold a list, an object with a list under one of the keys, or a single object."""
    kind = _struct(schema).simpleString()
    outer = F.from_json("value", f"struct<{', '.join(f'`{k}`: array<{kind}>' for k in keys)}>")
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{kind}>"))
    one = F.array(F.from_json("value", kind))
    return whole.select(F.explode(F.coalesce(listed, *(outer[k] for k in keys), one)).alias("x")).select("x.*")


def files(spark: SparkSession, path: str, glob: str = "*.{pdf,docx,DOCX,odt}") -> DataFrame:
    """(path, length, modified) of the files under a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue index; an empty one if the file is missing."""
    return json_objects(spark, path, CATALOGUE).drop("_file_path") if exists(spark, path) else spark.createDataFrame([], CATALOGUE)


def made_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path; if it is missing, make() is written there first."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the predicate reaches the scan."""
    return rows.filter(F.col(key) == value)


@dataclass(frozen=True)
class Settings:
    """Limits of the pipelines."""

    sparse_k: int = 30
    dense_k: int = 30
    final_k: int = 10
    dense_weight: float = 0.8
    sparse_weight: float = 0.2
    title_boost: float = 0.2
    sparse_least: float = 0.55
    dense_least: float = 0.1

    @classmethod
    def of(cls, values: dict | None) -> Settings:
        """Known values of a dictionary (of a YAML file or the environment); others keep their defaults."""
        known = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: known[k](v) for k, v in (values or {}).items() if k in known})


def write_json(rows: DataFrame, path: str) -> None:
    """K1: JSON lines, UTF-8."""
    rows.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> str:
    """K2: a report under a name of its own, which never replaces another one. The path that was written."""
    out = f"{path.rstrip('/')}/{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    rows.write.mode("errorifexists").json(out)
    return out


def write_index(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """K5, K6, K8: a table rebuilt as a whole; a partition column stands in for a secondary index."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_catalogue(entries: DataFrame, path: str) -> None:
    """K3: the full index, the multimap and the map of unique names."""
    from talweg.operators.catalogue import multimap

    names = multimap(entries)
    write_json(entries, f"{path}/index")
    write_json(names.select("filename", "keys"), f"{path}/multimap")
    write_json(names.filter("n = 1").select("filename", F.get("keys", F.lit(0)).alias("s3_key")), f"{path}/unique")


def with_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """K7: rows with the s3_key found for them, null without one."""
    return rows.join(keys.select(key, "s3_key"), key, "left")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of the files under some paths: another one after any of them is written anew."""
    marks = []
    for path in paths:
        of = F.xxhash64("path", "length", "modified")
        marks.append(str(tuple(files(spark, path, "*").agg(F.count("*"), F.bit_xor(of), F.sum(F.pmod(of, F.lit(1 << 31)))).first())))
    return hashlib.md5("|".join([*paths, *marks]).encode()).hexdigest()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in their order; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def contents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of the files under a folder; only the files that are asked for by a filter on path are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def work_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir; one of this machine only for a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (known or f"file://{tempfile.gettempdir()}/talweg-work").rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application in the shared one. All of them are deleted when the driver's Python ends."""
    top = f"{work_folder(spark)}/{spark.sparkContext.applicationId}"
    if top not in _OWN:
        _OWN.add(top)
        atexit.register(delete, spark, top)
    return f"{top}/{name}"


_OWN: set[str] = set()


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written once in own_folder(), as several steps read it: a plan ends there."""
    path = own_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, path: str, n: int, by: str, *sort: str) -> None:
    """A table at a path in n buckets of a column, for buckets()."""
    df.write.bucketBy(n, by).sortBy(*sort).mode("overwrite").option("path", path).saveAsTable(_bucket_table(path))


def buckets(spark: SparkSession, path: str, n: int, by: str) -> DataFrame:
    """A table that write_buckets() has written. Groups and joins on its column read each bucket in place."""
    name = _bucket_table(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{by}`) into {n} buckets location '{path}'")
    return spark.table(name)


def _bucket_table(path: str) -> str:
    return f"talweg_{hashlib.md5(path.encode()).hexdigest()}"
