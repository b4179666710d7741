"""Shaping, searching, sorting, paging and patching resource records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capture_analytics.functions.records import frontend_url

# ---- fixed values: which attributes each kind of request keeps --------------------

POST_LIST = ("title", "posting_status", "created_at", "duplicate_of_id")
APPLICATION_LIST = ("status", "reason_code", "applied_at")
CURRENT_USER = ("username", "email", "first_name", "last_name", "is_staff", "is_active",
                "is_guest", "auto_score", "linkedin", "github", "address", "links", "onboarding")
LIST_SHAPES: dict[str, tuple[str, ...]] = {
    "companies": ("name",),
    "job_posts": POST_LIST,
    "job_applications": APPLICATION_LIST,
    "scrapes": ("url", "status", "scraped_at"),
    "scores": ("score", "status", "created_at"),
    "resumes": ("name", "title", "created_at", "favorite"),
    "questions": ("content", "created_at"),
    "answers": ("content", "created_at", "favorite"),
}
SINGLE_SHAPES: dict[str, tuple[str, ...]] = {"current_user": CURRENT_USER}
PASSTHROUGH = ("graph_trace", "scrape_statuses", "scrape_screenshots", "score_request")
CAREER_SECTIONS: dict[str, tuple[str, ...]] = {
    "resume": ("name", "created_at"),
    "skill": ("name", "category", "level"),
    "experience": ("company", "title", "started_at", "ended_at"),
    "education": ("institution", "degree", "field", "ended_at"),
    "certification": ("name", "issuer", "issued_at"),
    "cover_letter": ("title", "created_at"),
}
APPLICATION_SORT_FIELDS = ("id", "applied_at", "status", "job_post_id", "company_id", "notes")


# ---- record shape -----------------------------------------------------------------

def relationship_counts(relationships: Column) -> Column:
    """Each relationship as its size (to many) or its id (to one), NULL when empty.

    Relationship values are the JSON text of `{"data": ...}`.
    """
    def count(_: Column, blob: Column) -> Column:
        data = F.get_json_object(blob, "$.data")
        return (F.when(data.startswith("["), F.json_array_length(data).cast("string"))
                .when(data.startswith("{"), F.get_json_object(data, "$.id")))

    return F.transform_values(relationships, count)


def slim_record(df: DataFrame, attrs: Sequence[str] | None = None,
                relationships: str = "counts") -> DataFrame:
    """Keep the listed attributes; show relationships as counts, not at all, or as they are."""
    if attrs is not None:
        df = df.withColumn("attributes", F.map_filter(
            "attributes", lambda k, _: k.isin(*attrs)))
    if relationships == "omit":
        return df.drop("relationships")
    if relationships == "counts":
        return df.withColumn("relationships", relationship_counts(F.col("relationships")))
    return df


def slim_payload(df: DataFrame, resource: str, single: bool,
                 relationships: str = "counts") -> DataFrame:
    """Records of a resource in their list or single shape; included records are dropped."""
    if resource in PASSTHROUGH:
        return df
    attrs = (SINGLE_SHAPES if single else LIST_SHAPES).get(resource)
    return slim_record(df, attrs, relationships).drop("included")


def with_frontend_url(df: DataFrame) -> DataFrame:
    """Add the application path; API links and relationships are dropped for every record."""
    return df.withColumn("_frontend_url", frontend_url(F.col("type"), F.col("id"))
                         ).drop("links", "relationships")


def trim_sections(df: DataFrame) -> DataFrame:
    """Trim the records of every career section to its own fields and the id."""
    for section, attrs in CAREER_SECTIONS.items():
        if section in df.columns:
            known = df.schema[section].dataType.elementType.fieldNames()
            df = df.withColumn(section, F.transform(
                section, _trimmer([f for f in ("id", *attrs) if f in known])))
    return df


def _trimmer(fields: Sequence[str]):
    return lambda record: F.struct(*[record[f].alias(f) for f in fields])


# ---- selection --------------------------------------------------------------------

def get_by_id(df: DataFrame, record_id: int | None, list_columns: Sequence[str]) -> DataFrame:
    """One record with all columns when an id is given, else the list columns of all."""
    if record_id is not None:
        return df.where(F.col("id") == record_id)
    return df.select("id", *[c for c in list_columns if c in df.columns])


def filter_eq(df: DataFrame, **conditions) -> DataFrame:
    """Equality filters that are given (None means not asked for)."""
    for column, value in conditions.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def contains(column: Column, needle: str) -> Column:
    """Case-insensitive containment, NULL contains nothing."""
    return F.coalesce(F.lower(column).contains(needle.lower()), F.lit(False))


def search_posts(posts: DataFrame, companies: DataFrame, query: str | None = None,
                 title: str | None = None, company: str | None = None,
                 company_id: int | None = None) -> DataFrame:
    """Posts with their company name; several filters must all hold."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    if company_id is not None:
        posts = posts.where(F.col("company_id") == company_id)
    if title is not None:
        posts = posts.where(contains(F.col("title"), title))
    if company is not None:
        names = names.where(contains(F.col("company_name"), company))
    joined = posts.join(names, "company_id", "left" if company is None else "inner")
    if query is not None:
        fields = [c for c in ("title", "description", "company_name") if c in joined.columns]
        hit = F.lit(False)
        for field in fields:
            hit = hit | contains(F.col(field), query)
        joined = joined.where(hit)
    return joined


def search_companies(companies: DataFrame, query: str | None) -> DataFrame:
    """Companies whose name or display name contains the query."""
    if query is None:
        return companies
    hit = contains(F.col("name"), query)
    if "display_name" in companies.columns:
        hit = hit | contains(F.col("display_name"), query)
    return companies.where(hit)


def find_company_by_name(companies: DataFrame, name: str) -> DataFrame:
    """Matching companies with the size of the match, or one 404 row when there is none."""
    hits = search_companies(companies, name)
    total = hits.agg(F.count("*").alias("count"))
    found = hits.select(
        "id", "name", total.scalar().alias("count"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("status_code"))
    missing = total.where(F.col("count") == 0).select(
        F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("name"), "count",
        F.lit(f"No companies found matching '{name}'").alias("error"),
        F.lit(404).alias("status_code"))
    return found.unionByName(missing)


# ---- sorting and paging -----------------------------------------------------------

def sort_columns(sort: str | None, order: str | None = None, key: str = "id",
                 allowed: Sequence[str] | None = None) -> list[Column]:
    """`-field` or `order="desc"` sorts down; the key breaks ties."""
    if sort is None:
        return [F.col(key).asc()]
    field = sort.lstrip("-")
    if allowed is not None and field not in allowed:
        raise ValueError(f"cannot sort by {field!r}")
    down = sort.startswith("-") or order == "desc"
    first = F.col(field).desc() if down else F.col(field).asc()
    return [first] if field == key else [first, F.col(key).asc()]


def page(df: DataFrame, sort: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page, counted from 1. Spark keeps only `number * size` rows per task."""
    return df.orderBy(*sort).offset((number - 1) * size).limit(size)


# ---- patches ----------------------------------------------------------------------

def apply_patch(base: DataFrame, patches: DataFrame, columns: Sequence[str], key: str = "id",
                order: str | None = None) -> DataFrame:
    """Overwrite the columns a patch gives a value for.

    With `order`, several patches per record are folded first: the latest value per column.
    """
    if order is None:
        folded = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    else:
        folded = patches.groupBy(key).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}")
            for c in columns])
    joined = base.join(folded, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns])


def patch_error(columns: Sequence[str], message: str = "No fields provided to update") -> Column:
    """Error text for a patch that sets nothing, else NULL."""
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull(), F.lit(message))


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without broken rules, and the others with the names of their broken rules."""
    checked = df.withColumn("failed_rules", errors)
    good = checked.where(F.size("failed_rules") == 0).drop("failed_rules")
    return good, checked.where(F.size("failed_rules") > 0)


def child_counts(parents: DataFrame, children: DataFrame, fk: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 when there are none."""
    counts = children.groupBy(F.col(fk).alias("id")).agg(F.count("*").alias(name))
    return parents.join(counts, "id", "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def map_of(columns: Mapping[str, Column]) -> Column:
    """Attribute map of a record, values as text."""
    return F.create_map(*[part for name, col in columns.items()
                          for part in (F.lit(name), col.cast("string"))])
