"""Registry documents and seed lists as DataFrames; fetching them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.license import plain_license


def seed_npm(text: DataFrame, limit: int) -> DataFrame:
    """(rank, name) of the names linked in ranked markdown lists (value); the first mention of a name counts."""
    names = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"\[([^\]]+)\]\(https://www\.npmjs\.org/package/"), F.lit(1))).alias("at", "name"))
    first = names.groupBy("name").agg(F.min("at").alias("at"))
    return first.orderBy("at").limit(limit).select(F.row_number().over(Window.orderBy("at")).alias("rank"), "name")


def seed_pypi(text: DataFrame, limit: int) -> DataFrame:
    """(rank, name, downloads) of a JSON document with rows of project and download_count."""
    rows = text.select(F.posexplode(F.from_json("value", "struct<rows:array<struct<project:string,download_count:bigint>>>")["rows"]).alias("at", "r"))
    return rows.where(F.col("at") < limit).select((F.col("at") + 1).cast("int").alias("rank"), F.col("r.project").alias("name"), F.col("r.download_count").alias("downloads"))


def npm_releases(documents: DataFrame) -> DataFrame:
    """(name, version, license_raw, repository, first_published, archive_url, integrity) of npm documents (value)."""
    schema = "struct<name:string,`dist-tags`:struct<latest:string>,time:map<string,string>,license:string,licenses:array<struct<type:string>>,repository:struct<url:string>,versions:map<string,struct<license:string,dist:struct<tarball:string,integrity:string>>>>"
    d = documents.select(F.from_json("value", schema).alias("d")).select("d.*").withColumn("version", F.col("`dist-tags`.latest"))
    of = F.col("versions")[F.col("version")]
    published = F.array_min(F.map_values(F.map_filter("time", lambda k, v: ~k.isin("created", "modified"))))
    return d.select("name", "version", F.coalesce(of["license"], "license", F.col("licenses")[0]["type"]).alias("license_raw"), F.col("repository.url").alias("repository"), F.coalesce(F.col("time")["created"], published).alias("first_published"), of["dist"]["tarball"].alias("archive_url"), of["dist"]["integrity"].alias("integrity"))


def pypi_releases(documents: DataFrame) -> DataFrame:
    """The same for PyPI documents; the first upload is the least over all releases."""
    schema = "struct<info:struct<name:string,version:string,license:string,license_expression:string,classifiers:array<string>,project_urls:map<string,string>>,releases:map<string,array<struct<upload_time_iso_8601:string>>>,urls:array<struct<packagetype:string,url:string,digests:struct<sha256:string>>>>"
    d = documents.select(F.from_json("value", schema).alias("d")).select("d.*")
    uploads = F.array_min(F.transform(F.flatten(F.map_values("releases")), lambda r: r["upload_time_iso_8601"]))
    source = F.try_element_at(F.filter("urls", lambda u: u["packagetype"] == "sdist"), F.lit(1))
    classifier = F.try_element_at(F.filter("info.classifiers", lambda c: c.startswith("License ::")), F.lit(1))
    raw = F.coalesce(F.col("info.license_expression"), F.when(F.length("info.license") > 0, F.col("info.license")), classifier)
    return d.select(F.col("info.name").alias("name"), F.col("info.version").alias("version"), raw.alias("license_raw"), F.coalesce(F.col("info.project_urls")["Source"], F.col("info.project_urls")["Homepage"]).alias("repository"), uploads.alias("first_published"), source["url"].alias("archive_url"), F.concat(F.lit("sha256-"), source["digests"]["sha256"]).alias("integrity"))


def dependency_licenses(deps: DataFrame, known: DataFrame) -> DataFrame:
    """Dependencies with the plain licence of a table (ecosystem, name, license_raw), Unknown where it has none."""
    return deps.join(known.select("ecosystem", "name", plain_license("license_raw").alias("license")), ["ecosystem", "name"], "left").withColumn("license", F.coalesce("license", F.lit("Unknown")))


def hydrate(manifest: DataFrame, entries: DataFrame, most_missing: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Manifest rows (archive, path, exact_hash, ...) with their source, and those missing or changed.

    Raises if more than most_missing of the rows cannot be restored.
    """
    from ..functions.columns import exact_hash

    read = entries.where("reason is null").select("archive", "path", F.decode("content", "utf-8").alias("source"))
    joined = manifest.join(read, ["archive", "path"], "left").withColumn("intact", F.coalesce(exact_hash("source") == F.col("exact_hash"), F.lit(False)))
    share = joined.agg(F.avg(F.when(F.col("intact"), 0.0).otherwise(1.0))).first()[0]
    if share is not None and share > most_missing:
        raise ValueError(f"{share:.0%} of the manifest cannot be restored")
    return joined.where("intact").drop("intact"), joined.where("not intact").drop("intact", "source")
