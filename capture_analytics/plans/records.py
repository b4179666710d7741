"""Queries over resource records: shape, search, sort, patch, validate."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import records as R
from capture_analytics.operators import records as ops
from capture_analytics.plans.registry import query
from capture_analytics.sources.sinks import html_if_empty
from capture_analytics.sources.views import view


def _post_records(spark, folder):
    """Job posts as resource records with attribute and relationship maps."""
    posts = view(spark, folder, "job_posts")
    attributes = ops.map_of({
        "title": F.col("title"), "posting_status": F.col("posting_status"),
        "link": F.col("link"), "salary_max": F.col("salary_max")})
    relationships = F.create_map(
        F.lit("company"), F.concat(F.lit('{"data":{"type":"company","id":"'), F.col("company_id"),
                                   F.lit('"}}')),
        F.lit("scores"), F.when(F.col("posting_status") == "F", F.lit(
            '{"data":[{"type":"score","id":"1"},{"type":"score","id":"2"}]}')).otherwise(
                F.lit('{"data":[]}')),
        F.lit("resume"), F.lit('{"data":null}'))
    return posts.select(F.lit("job-post").alias("type"), F.col("id").cast("string").alias("id"),
                        attributes.alias("attributes"), relationships.alias("relationships"),
                        F.lit("x").alias("included"), F.lit("l").alias("links"))


@query("record_slim", """select cast(id as varchar) as id, 'posting_status,title' as kept, title, posting_status,
    cast(company_id as varchar) as company, case when posting_status = 'F' then '2' else '0' end as scores,
    cast(null as varchar) as resume, false as has_included from [job_posts]""")
def record_slim(spark, folder):
    slim = ops.slim_payload(_post_records(spark, folder), "job_posts", single=False)
    return slim.select(
        "id", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("kept"),
        F.col("attributes")["title"].alias("title"),
        F.col("attributes")["posting_status"].alias("posting_status"),
        *[F.col("relationships")[r].alias(r) for r in ("company", "scores", "resume")],
        F.lit("included" in slim.columns).alias("has_included"))


@query("record_modes", """select cast(id as varchar) as id, 4 as n_attributes,
    '{"data":{"type":"company","id":"' || company_id || '"}}' as company, false as omitted_has_relationships
    from [job_posts]""")
def record_modes(spark, folder):
    records = _post_records(spark, folder)
    inline = ops.slim_payload(records, "job_posts", single=True, relationships="inline")
    omitted = ops.slim_record(records, None, "omit")
    shown = omitted.select("id", F.to_json(F.struct("*")).contains('"relationships"').alias(
        "omitted_has_relationships"))
    return inline.select("id", F.size("attributes").alias("n_attributes"),
                         F.col("relationships")["company"].alias("company")).join(shown, "id")


@query("frontend_url", """select cast(id as varchar) as id, kind as type, case kind when 'job-post'
    then '/job-posts/' || id when 'score' then '/scores/' || id when 'summary' then '/summaries/' || id end as _frontend_url
from (select id, case id % 4 when 0 then 'job-post' when 1 then 'score' when 2 then 'summary' else 'widget' end
    as kind from [job_posts]) t""")
def frontend_url(spark, folder):
    kind = F.expr("case cast(id as bigint) % 4 when 0 then 'job-post' when 1 then 'score' "
                  "when 2 then 'summary' else 'widget' end")
    tagged = ops.with_frontend_url(_post_records(spark, folder).withColumn("type", kind))
    return tagged.select("id", "type", "_frontend_url")


@query("rel_counts", """select p.id, p.company_id, count(a.job_post_id) as n_applications
    from [job_posts] p left join [applications] a on a.job_post_id = p.id group by p.id, p.company_id""")
def rel_counts(spark, folder):
    return ops.child_counts(view(spark, folder, "job_posts").select("id", "company_id"),
                            view(spark, folder, "applications"), "job_post_id", "n_applications")


# every field that any section has, and one that none has
_SECTION_FIELDS = ("name", "created_at", "category", "level", "company", "title", "started_at", "ended_at",
                   "institution", "degree", "field", "issuer", "issued_at", "notes")
_SECTIONS = (("resume", "name created_at"), ("skill", "name category level"),
             ("experience", "company title started_at ended_at"),
             ("education", "institution degree field ended_at"),
             ("certification", "name issuer issued_at"), ("cover_letter", "title created_at"))


def _section_json(kept: str) -> str:
    """The JSON of one trimmed record as SQL text: the id, then the kept fields."""
    fields = "".join(f" || ',\"{f}\":\"{f} ' || {c} || '\"'" for f in kept.split() for c in ("c_name",))
    return f"""'[{{"id":' || c_custkey{fields} || '}},{{"id":' || c_custkey{fields.replace('c_name', 'c_mktsegment')} || '}}]'"""


@query("career_sections", "select c_custkey as user_id, " + ", ".join(
    f"{_section_json(kept)} as {name}" for name, kept in _SECTIONS) + " from customer")
def career_sections(spark, folder):
    def record(source: str):
        return F.struct(F.col("c_custkey").alias("id"), *[
            F.concat(F.lit(f"{f} "), F.col(source)).alias(f) for f in _SECTION_FIELDS])
    records = F.array(record("c_name"), record("c_mktsegment"))
    users = view(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), *[records.alias(name) for name, _ in _SECTIONS])
    return ops.trim_sections(users).select("user_id", *[F.to_json(name).alias(name) for name, _ in _SECTIONS])


@query("current_user", """select c_custkey as id, c_name as username,
    coalesce(nullif(trim(case when c_nationkey % 3 = 0 then '  ' else c_mktsegment end), ''), '(blank)') as address,
    2 as n_fields from customer""")
def current_user(spark, folder):
    attributes = F.create_map(
        F.lit("username"), F.col("c_name"),
        F.lit("address"), F.when(F.col("c_nationkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")),
        F.lit("password"), F.lit("hidden"))
    users = view(spark, folder, "customer").select(
        F.lit("user").alias("type"), F.col("c_custkey").alias("id"), attributes.alias("attributes"),
        F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("relationships"))
    slim = ops.slim_payload(users, "current_user", single=True)
    return slim.select("id", F.col("attributes")["username"].alias("username"),
                       R.blank_marker(F.col("attributes")["address"]).alias("address"),
                       F.size("attributes").alias("n_fields"))


@query("search_posts", """select p.id, p.title, c.name as company_name, count(*) over () as total
    from [job_posts] p left join [companies] c on c.id = p.company_id
    where (contains(lower(p.title), '12') or contains(lower(c.name), '12'))
      and contains(lower(p.title), 'r')""")
def search_posts(spark, folder):
    hits = ops.search_posts(view(spark, folder, "job_posts").select("id", "title", "company_id"),
                            view(spark, folder, "companies"), query="12", title="R"
                            ).select("id", "title", "company_name")
    return hits.withColumn("total", hits.agg(F.count("*")).scalar())


@query("search_posts_by_company", """select p.id, p.title, c.name as company_name
    from [job_posts] p join [companies] c on c.id = p.company_id
    where contains(lower(c.name), '#00000001') and p.posting_status = 'F'""")
def search_posts_by_company(spark, folder):
    posts = ops.filter_eq(view(spark, folder, "job_posts"), posting_status="F", link=None)
    return ops.search_posts(posts, view(spark, folder, "companies"), company="#00000001"
                            ).select("id", "title", "company_name")


@query("search_companies", """select id, name from [companies] where contains(lower(name), 'r#00000000')
    or contains(lower(industry), 'r#00000000')""")
def search_companies(spark, folder):
    companies = view(spark, folder, "companies").withColumnRenamed("industry", "display_name")
    return ops.search_companies(companies, "R#00000000").select("id", "name")


@query("find_company", """select id, name, count(*) over () as count, cast(null as varchar) as error,
    cast(null as integer) as status_code from [companies] where contains(lower(name), '00007')""")
def find_company(spark, folder):
    return ops.find_company_by_name(view(spark, folder, "companies"), "00007")


@query("find_company_missing", """select cast(null as bigint) as id, cast(null as varchar) as name,
    count(*) as count, 'No companies found matching ''no such name''' as error, 404 as status_code
    from [companies] where contains(lower(name), 'no such name') having count(*) = 0""")
def find_company_missing(spark, folder):
    return ops.find_company_by_name(view(spark, folder, "companies"), "no such name")


@query("filter_eq", """select id, company_id, title, posting_status from [job_posts]
    where posting_status = 'O' and title = '1-URGENT'""")
def filter_eq(spark, folder):
    return ops.filter_eq(view(spark, folder, "job_posts"), posting_status="O", title="1-URGENT",
                         company_id=None).select("id", "company_id", "title", "posting_status")


@query("get_by_id", "select * from [job_posts] where id = 77")
def get_by_id(spark, folder):
    return ops.get_by_id(view(spark, folder, "job_posts"), 77, ops.POST_LIST)


@query("get_list", "select id, title, posting_status from [job_posts]")
def get_list(spark, folder):
    return ops.get_by_id(view(spark, folder, "job_posts"), None, ops.POST_LIST)


@query("post_applications", """select a.job_post_id, a.ordinal, a.status, a.applied_at, p.title
    from [applications] a join [job_posts] p on p.id = a.job_post_id""")
def post_applications(spark, folder):
    posts = view(spark, folder, "job_posts").select(F.col("id").alias("job_post_id"), "title")
    return view(spark, folder, "applications").join(posts, "job_post_id")


@query("sort_page", """select id, salary_max from [job_posts] order by salary_max desc, id
    limit 25 offset 50""")
def sort_page(spark, folder):
    posts = view(spark, folder, "job_posts").select("id", "salary_max")
    return ops.page(posts, ops.sort_columns("-salary_max"), 3, 25)


@query("sort_applications", """select job_post_id, ordinal, applied_at from [applications]
    order by applied_at desc, job_post_id, ordinal limit 20""")
def sort_applications(spark, folder):
    order = ops.sort_columns("applied_at", "desc", key="job_post_id",
                             allowed=ops.APPLICATION_SORT_FIELDS) + [F.col("ordinal")]
    return ops.page(view(spark, folder, "applications").drop("status"), order, 1, 20)


_BAD_POSTS = """select id, case when id % 9 = 0 then '' else title end as title,
    case when id % 6 = 0 then 0 else company_id end as company_id,
    case when id % 10 = 0 then repeat('x', 101) else 'Remote' end as location,
    cast(case when id % 7 = 0 then -1 else 400000 end as integer) as salary_min,
    cast(floor(salary_max) as integer) as salary_max from [job_posts]"""


@query("post_validation", f"""select id, array_to_string(list_filter([
    case when length(title) < 1 or length(title) > 200 then 'title' end,
    case when company_id <= 0 then 'company_id' end,
    case when length(location) > 100 then 'location' end,
    case when salary_min < 0 then 'salary_min' end, case when salary_max < 0 then 'salary_max' end,
    case when salary_min > salary_max then 'salary_range' end], lambda r: r is not null), ',') as failed_rules
    from ({_BAD_POSTS}) p""")
def post_validation(spark, folder):
    posts = spark.sql(_BAD_POSTS.replace("[job_posts]", "{posts}"), posts=view(spark, folder, "job_posts"))
    errors = R.new_post_errors(*[F.col(c) for c in (
        "title", "company_id", "location", "salary_min", "salary_max")])
    good, bad = ops.split_valid(posts, errors)
    return good.select("id", F.lit("").alias("failed_rules")).unionByName(
        bad.select("id", F.array_join("failed_rules", ",").alias("failed_rules")))


@query("extracted_post_validation", """select id, array_to_string(list_filter([
    case when length(description) < 10 then 'description' end,
    case when length(company_name) < 1 then 'company_name' end,
    case when salary_min > salary_max then 'salary_range' end], lambda r: r is not null), ',') as failed_rules
from (select id, case when id % 3 = 0 then host else description end as description,
    case when id % 4 = 0 then '' else host end as company_name, id % 5 as salary_min, 2 as salary_max
    from [posts_text]) p""")
def extracted_post_validation(spark, folder):
    posts = view(spark, folder, "posts_text").selectExpr(
        "id", "case when id % 3 = 0 then host else description end as description",
        "case when id % 4 = 0 then '' else host end as company_name", "id % 5 as salary_min")
    none = F.lit(None).cast("string")
    errors = R.extracted_post_errors(
        F.lit("Title"), F.col("description"), F.col("company_name"), none, F.col("salary_min"),
        F.lit(2), none, none)
    return posts.select("id", F.array_join(errors, ",").alias("failed_rules"))


@query("company_validation", """select id, array_to_string(list_filter([
    case when length(name) < 1 or length(name) > 200 then 'name' end,
    case when length(industry) > 100 then 'industry' end], lambda r: r is not null), ',') as failed_rules
    from (select id, case when id % 8 = 0 then repeat(name, 20) when id % 5 = 0 then '' else name end as name,
        case when id % 3 = 0 then repeat(industry, 30) else industry end as industry from [companies]) c""")
def company_validation(spark, folder):
    companies = view(spark, folder, "companies").selectExpr(
        "id", "case when id % 8 = 0 then repeat(name, 20) when id % 5 = 0 then '' else name end as name",
        "case when id % 3 = 0 then repeat(industry, 30) else industry end as industry")
    errors = R.company_errors(F.col("name"), F.col("industry"), F.lit(None).cast("string"))
    return companies.select("id", F.array_join(errors, ",").alias("failed_rules"))


@query("application_input", """select job_post_id, ordinal, case when wanted <= 0 then
    'Invalid job_post_id=' || wanted || '. Look up the real ID first.' end as error
    from (select job_post_id, ordinal, job_post_id * (ordinal - 2) as wanted from [applications]) a""")
def application_input(spark, folder):
    wanted = F.col("job_post_id") * (F.col("ordinal") - 2)
    return view(spark, folder, "applications").select(
        "job_post_id", "ordinal", R.application_input_error(wanted).alias("error"))


@query("apply_patch", """select p.id, case when p.id % 3 = 0 then 'patched' else title end as title,
    coalesce(case when p.id % 5 = 0 then 'Z' end, posting_status) as posting_status, link
    from [job_posts] p""")
def apply_patch(spark, folder):
    posts = view(spark, folder, "job_posts").select("id", "title", "posting_status", "link")
    patches = posts.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select(
        "id", "seq",
        F.when(F.col("id") % 3 == 0, F.when(F.col("seq") == 1, F.lit("draft")).otherwise(
            F.lit("patched"))).alias("title"),
        F.when((F.col("id") % 5 == 0) & (F.col("seq") == 1), F.lit("Z")).alias("posting_status"))
    return ops.apply_patch(posts, patches, ["title", "posting_status"], order="seq")


@query("patch_errors", """select id, case when id % 3 <> 0 and id % 5 <> 0 then 'No fields provided to update' end as error
    from [job_posts]""")
def patch_errors(spark, folder):
    patches = view(spark, folder, "job_posts").select(
        "id", F.when(F.col("id") % 3 == 0, F.col("title")).alias("title"),
        F.when(F.col("id") % 5 == 0, F.col("company_id")).alias("company_id"))
    return patches.select("id", ops.patch_error(["title", "company_id"]).alias("error"))


@query("html_write_if_empty", """select page_id as scrape_id, length(case when page_id % 3 <> 0 then html
    when length(html || html) > 200000 then left(html || html, 200000) || chr(10) || '<!-- [truncated for debug artifact] -->'
    else html || html end) as html_length from [pages]""")
def html_write_if_empty(spark, folder):
    pages = view(spark, folder, "pages")
    scrapes = pages.select(F.col("page_id").alias("scrape_id"),
                           F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("html"))
    # an older snapshot that is the larger string, and the newest
    dom = pages.select(F.col("page_id").alias("scrape_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("captured_at"), F.concat(F.lit("~"), "html").alias("dom")),
        F.struct(F.lit(2).alias("captured_at"), F.concat("html", "html").alias("dom")))
    ).alias("s")).select("scrape_id", "s.*")
    return html_if_empty(scrapes, dom, R.DOM_CLIP).select(
        "scrape_id", F.length("html").cast("bigint").alias("html_length"))


@query("response_gate", """select page_id, status in (200, 201, 202) as ok,
    case when status not in (200, 201, 202) then status || ' - ' || left(html, 500) end as error,
    case when status not in (200, 201, 202) and status >= 400 then status end as status_code
    from (select page_id, html, case page_id % 4 when 0 then 200 when 1 then 202 when 2 then 302 else 500 end as status
    from [pages]) t""")
def response_gate(spark, folder):
    status = F.expr("case page_id % 4 when 0 then 200 when 1 then 202 when 2 then 302 else 500 end")
    return view(spark, folder, "pages").select(
        "page_id", R.response_gate(status, F.col("html")).alias("r")).select(
            "page_id", F.col("r.payload").isNotNull().alias("ok"), "r.error", "r.status_code")


@query("link_fallback", """select id, case when id % 3 = 0 and id % 2 = 0 then null
    when id % 3 = 0 then 'https://alt.example.com/' || id else link end as link from [job_posts]""")
def link_fallback(spark, folder):
    link = F.when(F.col("id") % 3 != 0, F.col("link")).otherwise(F.lit(""))
    url = F.when(F.col("id") % 2 != 0, F.concat(F.lit("https://alt.example.com/"), F.col("id")))
    return view(spark, folder, "job_posts").select("id", R.link_fallback(link, url).alias("link"))


@query("salary_band", """select s.post_id, s.score, case when s.score >= 80 then 'strong'
    when s.score >= 60 then 'reasonable' else 'gaps' end as band,
    case when d.n_chars < 1000 then d.n_chars * 2080 else d.n_chars end as annual
    from (select post_id, score - (post_id % 50) as score from [scores]) s
    join documents d on d.doc_id = s.post_id""")
def salary_band(spark, folder):
    scores = view(spark, folder, "scores").select(
        "post_id", (F.col("score") - F.col("post_id") % 50).alias("score"))
    amounts = view(spark, folder, "documents").select(F.col("doc_id").alias("post_id"), "n_chars")
    return scores.join(amounts, "post_id").select(
        "post_id", "score", R.score_band(F.col("score")).alias("band"),
        R.annualize_salary(F.col("n_chars"), F.col("n_chars") < 1000).alias("annual"))


@query("action_check", """select conv_id, turn, n_shapes = 1 as valid, turn between 1 and 3 as batch_ok from (
    select conv_id, turn, cast(role = 'user' as integer) + cast(turn % 2 = 0 as integer)
        + cast(conv_id % 3 = 0 as integer) as n_shapes from [conversations]) t""")
def action_check(spark, folder):
    valid = R.action_valid(F.when(F.col("role") == "user", F.lit("/x")),
                           F.when(F.col("turn") % 2 == 0, F.lit("m")),
                           F.when(F.col("conv_id") % 3 == 0, F.col("text")))
    return view(spark, folder, "conversations").select(
        "conv_id", "turn", valid.alias("valid"), R.batch_valid(F.col("turn")).alias("batch_ok"))


@query("patch_keys", """select conv_id, turn, case conv_id % 4 when 0 then 'favorite,title' when 1 then 'favorite,status'
    when 2 then 'favorite' else '' end as kept_keys from [conversations]""")
def patch_keys(spark, folder):
    kind = F.expr("case conv_id % 4 when 0 then 'resume' when 1 then 'cover-letter' "
                  "when 2 then 'job-post' else 'unknown' end")
    patch = F.create_map(F.lit("favorite"), F.col("role"), F.lit("title"), F.col("role"),
                         F.lit("status"), F.col("role"), F.lit("admin"), F.col("role"))
    kept = R.allowed_patch(kind, patch)
    return view(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept_keys"))


@query("hyphenate_keys", """select id, 'k-' || id || '-' || replace(lower(posting_status), '_', '-') || ',salary-max'
    as keys, title from [job_posts]""")
def hyphenate_keys(spark, folder):
    named = F.concat(F.lit("k_"), F.col("id"), F.lit("_"), F.lower("posting_status"))
    keyed = R.hyphenate_keys(F.create_map(named, F.col("posting_status"), F.lit("salary_max"), F.col("title")))
    return view(spark, folder, "job_posts").select(
        "id", F.array_join(F.array_sort(F.map_keys(keyed)), ",").alias("keys"),
        keyed["salary-max"].alias("title"))
