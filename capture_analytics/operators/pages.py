"""Captured pages against host profiles: selector checks, discovery, apply targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capture_analytics.functions.html import apply_candidates, page_title, visible_text
from capture_analytics.functions.selectors import MATCH, match_selectors
from capture_analytics.functions.text import login_wall, word_count
from capture_analytics.functions.urls import url_host

# ---- fixed values: selectors probed on pages of hosts without a profile ------------

JOB_SELECTORS = {
    "title": (
        "h1.job-title", "h1.posting-headline", "h1[data-testid*='title']",
        ".top-card-layout__title", ".jobsearch-JobInfoHeader-title",
        "h1.job-details-jobs-unified-top-card__job-title",
        "[data-automation='job-detail-title']", "h1",
    ),
    "company_name": (
        ".company-name", ".topcard__org-name-link",
        "[data-testid*='company']", "[data-automation='advertiser-name']",
        ".jobsearch-InlineCompanyRating a", ".job-details-jobs-unified-top-card__company-name",
    ),
    "description": (
        ".job-description", ".jobsearch-JobComponent-description",
        "[data-testid*='description']", "[data-automation='jobAdDetails']",
        ".jobs-description-content", "#job-details",
    ),
    "location": (
        ".job-location", ".topcard__flavor--bullet",
        "[data-testid*='location']", "[data-automation='job-detail-location']",
        ".jobsearch-JobInfoHeader-subtitle div",
        ".job-details-jobs-unified-top-card__bullet",
    ),
    "salary": (
        ".salary-range", ".salaryText", "[data-testid*='salary']",
        "[data-automation='job-detail-salary']",
        ".jobsearch-JobMetadataHeader-item",
    ),
}
MAX_CANDIDATES = 50

_READY = [s for s in JOB_SELECTORS["title"] if any(c in s for c in ".#[:")]
_NO_TEXT = "array<string>"


def _strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(_NO_TEXT))


def _values(column: Column) -> Column:
    return _strings(F.map_values(column))


# ---- links, candidates ------------------------------------------------------------

def ranked_candidates(pages: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Apply candidates of every page, best score first, equal scores in page order; all of
    them, or the first `max_candidates`. They stay in one array, so nothing is shuffled.
    """
    def order(left: Column, right: Column) -> Column:
        return F.when(left["score"] != right["score"],
                      F.when(left["score"] > right["score"], -1).otherwise(1)).otherwise(
                          F.when(left["at"] < right["at"], -1).otherwise(1))

    found = F.transform(apply_candidates(F.col("html"), F.col("url")), lambda c, i: F.struct(
        i.alias("at"), c["score"].alias("score"), c.alias("candidate")))
    usable = F.filter(found, lambda c: c["candidate"]["selector"] != "")
    ranked = F.array_sort(usable, order)
    if max_candidates is not None:
        ranked = F.slice(ranked, 1, max_candidates)
    return pages.select("page_id", url_host(F.col("url")).alias("host"),
                        F.posexplode(ranked).alias("_at", "_c")).select(
            "page_id", "host", (F.col("_at") + 1).cast("bigint").alias("rank"), "_c.candidate.*")


def candidates_by_host(candidates: DataFrame) -> DataFrame:
    """How often and how well each selector scores per host."""
    return candidates.groupBy("host", "selector").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.max("score").alias("max_score"))


# ---- selectors --------------------------------------------------------------------

def _parts(*groups: Column) -> tuple[Column, list[Column]]:
    """Selector groups as one array, and for each group its matches within `_m`: a page is
    parsed once, however many groups are asked."""
    taken, slices = F.lit(0), []
    for group in groups:
        slices.append(F.slice("_m", taken + 1, F.size(group)))
        taken = taken + F.size(group)
    return F.concat(*groups), slices


def _matched(pages: DataFrame, selectors: Column) -> DataFrame:
    """Pages with the matches `_m` of their selectors. A page without selectors is not parsed."""
    needed = F.size(selectors) > 0
    matches = F.when(needed, match_selectors(F.when(needed, F.col("html")), selectors))
    return pages.withColumn("_m", F.coalesce(matches, F.array().cast(f"array<{MATCH}>")))


def _any_found(matches: Column) -> Column:
    return F.exists(matches, lambda m: m["found"])


def _profile_groups() -> list[Column]:
    return [_values(F.col(c)) for c in ("authenticated", "blocked", "job_data")]


def _profile_columns(slices: list[Column]) -> dict[str, Column]:
    names = F.coalesce(F.map_keys("job_data"), F.array().cast(_NO_TEXT))
    fields = F.filter(F.arrays_zip(names.alias("name"), slices[2].alias("m")), lambda x: x["m"]["found"])
    return {"is_authenticated": _any_found(slices[0]), "is_blocked": _any_found(slices[1]),
            "job_data_matched": F.transform(fields, lambda x: x["name"])}


def _probe_columns(probes: Column) -> dict[str, Column]:
    """First usable candidate per job field, and the first specific title selector."""
    at, entries = 1, []
    for field, group in JOB_SELECTORS.items():
        hit = F.filter(F.slice(probes, at, len(group)), lambda m: m["found"] & (F.length(m["text"]) > 1))
        entries += [F.lit(field), F.try_element_at(hit, F.lit(1))["selector"]]
        at += len(group)
    ready = F.filter(F.slice(probes, 1, len(JOB_SELECTORS["title"])), lambda m: m["found"]
                     & (m["text"] != "") & m["selector"].isin(*_READY))
    return {"discovered": F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()),
            "candidate_ready_selector": F.try_element_at(ready, F.lit(1))["selector"]}


def _probes() -> Column:
    return F.array(*[F.lit(s) for group in JOB_SELECTORS.values() for s in group])


def selector_check(pages: DataFrame) -> DataFrame:
    """Which profile selectors match each page. `pages` carries the profile columns
    `authenticated`, `blocked` and `job_data` (name to selector maps, or NULL)."""
    selectors, slices = _parts(*_profile_groups())
    return _matched(pages, selectors).withColumns(_profile_columns(slices)).drop("_m")


def discover_selectors(pages: DataFrame) -> DataFrame:
    """Job field selectors found on the page, and its ready selector.

    Per field the first candidate whose element has more than one character of text.
    """
    return _matched(pages, _probes()).withColumns(_probe_columns(F.col("_m"))).drop("_m")


def apply_url(pages: DataFrame) -> DataFrame:
    """Apply target per page from its host's resolver config (`internal_apply_markers`,
    `apply_link_selectors`, `apply_button_selectors`, or NULL). A button needs a live
    browser, so it counts as not matched."""
    config = F.col("apply_resolver_config")
    markers = _strings(config["internal_apply_markers"])
    links = _strings(config["apply_link_selectors"])
    buttons = _strings(config["apply_button_selectors"])
    selectors, (marked, linked) = _parts(markers, links)
    found = _matched(pages, selectors)
    marker = F.try_element_at(F.filter(marked, lambda m: m["found"]), F.lit(1))["selector"]
    link = F.try_element_at(F.filter(linked, lambda m: m["found"] & F.coalesce(
        m["href"].rlike("^https?://"), F.lit(False))), F.lit(1))
    status = (F.when(F.col("html").isNull() | config.isNull(), F.lit("unknown"))
              .when(marker.isNotNull(), F.lit("internal"))
              .when(link.isNotNull(), F.lit("resolved"))
              .when(F.size(links) + F.size(buttons) > 0, F.lit("failed"))
              .otherwise(F.lit("unknown")))
    reason = (F.when(F.col("html").isNull(), F.lit("no_browser_page"))
              .when(config.isNull(), F.lit("no_config"))
              .when(marker.isNotNull(), F.concat(F.lit("internal_marker: "), marker))
              .when(link.isNotNull(), F.concat(F.lit("link_selector: "), link["selector"]))
              .when(F.size(links) + F.size(buttons) > 0, F.lit("no_selector_matched"))
              .otherwise(F.lit("config_empty")))
    return found.withColumn("apply_url_status", status).withColumn("reason", reason).withColumn(
        "apply_url", F.when(F.col("apply_url_status") == "resolved", link["href"])).drop("_m")


# ---- whole captures ---------------------------------------------------------------

def page_scan(pages: DataFrame) -> DataFrame:
    """Captured page as `(page_id, url, title, content)`."""
    return pages.select("page_id", "url", page_title(F.col("html")).alias("title"),
                        visible_text(F.col("html")).alias("content"))


def capture_result(pages: DataFrame) -> DataFrame:
    """Classify captures: blocked, login wall (unless authenticated), else content.

    `pages` carries the profile columns of `selector_check` and `ready_selector`. Content
    pages also get the selectors discovered where their profile has none yet.
    """
    wants_fields = F.size(_values(F.col("job_data"))) == 0
    wants_ready = F.coalesce("ready_selector", F.lit("")) == ""
    probes = F.when(wants_fields | wants_ready, _probes()).otherwise(F.array().cast(_NO_TEXT))
    selectors, slices = _parts(*_profile_groups(), probes)
    checked = _matched(pages, selectors).withColumns(
        {**_profile_columns(slices), "_probed": slices[3], "content": visible_text(F.col("html"))})
    checked = checked.withColumn("_walled", ~F.col("is_authenticated") & login_wall(F.col("content")))
    words = word_count(F.col("content"))
    error = (F.when(F.col("is_blocked"), F.lit("blocked_page_detected"))
             .when(F.col("_walled"), F.lit("login_wall_detected")))
    message = (F.when(F.col("is_blocked"), F.lit("Page matched a known blocked-page selector."))
               .when(F.col("_walled"), F.concat(
                   F.lit("Page appears to be a login wall ("), words.cast("string"),
                   F.lit(" words, login signals found)."))))
    fine = ~(F.col("is_blocked") | F.col("_walled"))
    found = _probe_columns(F.col("_probed"))
    return checked.withColumns({
        "error": error, "message": message, "words": words,
        "content": F.when(fine, F.col("content")).otherwise(F.lit("")),
        "discovered": F.when(fine & wants_fields, found["discovered"]),
        "candidate_ready_selector": F.when(fine & wants_ready, found["candidate_ready_selector"]),
    }).drop("_walled", "_probed", "_m")
