"""Web addresses, HTML anchors and source classification."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from publedger.functions.numbers import col
from publedger.functions.text import js_trim

# Entity spellings in the order they are decoded.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#0?39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "))
ANCHOR = r'(?is)<a(?![A-Za-z0-9_])[^>]*href="([^"#]+)"[^>]*>(.*?)</a>'
FILE_ADDRESS = r"(?i)\.(xlsx?|csv|pdf|docx?|zip|ods)(\?|$)"
FILES_FOLDER = "/sites/default/files/"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
LINK_TEXT_LENGTH, TITLE_LENGTH = 160, 200

# Publisher by host, source type by address, section by file name and title.
PUBLISHERS = (
    ("m.knesset.gov.il", "הכנסת"),
    ("main.knesset.gov.il", "הכנסת"),
    ("fs.knesset.gov.il", "הכנסת"),
    ("knesset.gov.il", "הכנסת"),
    ("mof.gov.il", "משרד האוצר"),
    ("library.mevaker.gov.il", "מבקר המדינה"),
    ("media.mevaker.gov.il", "מבקר המדינה"),
    ("data.gov.il", "data.gov.il — מאגרי מידע ממשלתיים"),
    ("www.gov.il", "מדינת ישראל — Gov.il"),
    ("next.obudget.org", "מפתח התקציב — הסדנא לידע ציבורי"),
    ("foi.gov.il", "היחידה הממשלתית לחופש המידע"),
    ("odata.org.il", "מידע לעם — התנועה לחופש המידע"),
)
SOURCE_TYPES = (
    (r"/about/documents/budget/.*\.pdf$", "budget_book", "ספר התקציב — הצעת תקציב ודברי הסבר"),
    (r"/about/pages/budget/", "budget_portal", "עמוד ריכוז מסמכי תקציב"),
    (r"globaldocs/MMM/|_cs_mmm_|MMMSummaries", "knesset_research", "מרכז המחקר והמידע של הכנסת"),
    (r"globaldocs/FINANCE/", "finance_committee_document", "מסמך שהוגש לוועדת הכספים"),
    (r"SecondaryLaw", "secondary_legislation", "חקיקת משנה"),
    (r"_cs_bg_", "committee_document", "מסמך ועדה"),
    (r"/News/PressReleases/", "press_release", "הודעה לעיתונות"),
    (r"budget-execution-reports|BudgetExecution", "budget_execution_report", "דוח ביצוע תקציב"),
    (r"mevaker\.gov\.il", "state_comptroller_report", "דוח מבקר המדינה"),
    (r"data\.gov\.il", "open_data_catalog", "קטלוג נתונים פתוחים"),
    (r"obudget\.org", "secondary_budget_layer", "שכבת עזר תקציבית (לא מקור רשמי)"),
    (r"foi\.gov\.il/he/node", "diaries_portal", "עמוד היומנים המרוכז — היחידה הממשלתית לחופש המידע"),
    (r"odata\.org\.il", "foi_repository", "מאגר מסמכי חופש מידע (שכבת עזר אזרחית)"),
    (r"/mk/government/|GovtByNumber", "government_composition", "הרכב הממשלה"),
    (r"gov\.il/(he/)?(departments|pages)", "government_page", "עמוד ממשלתי רשמי"),
)
DEFAULT_SOURCE_TYPE = ("other_official", "מקור רשמי אחר")
FILE_SECTIONS = (
    (r"Budget\d+-Transportation", "transport"),
    (r"Budget\d+-Education", "education"),
    (r"Budget\d+-Health", "health"),
    (r"Budget\d+-Environment", "environment"),
    (r"Budget\d+-Economics-Industry", "economy"),
)
TITLE_SECTIONS = (
    ("משרד התחבורה", "transport"),
    ("תקציבי? התחבורה הציבורית", "transport"),
    ("משרד החינוך", "education"),
    ("תקציב החינוך", "education"),
    ("מערכת החינוך", "education"),
    ("משרד הבריאות", "health"),
    ("מערכת הבריאות", "health"),
    ("בתחום הבריאות", "health"),
    ("להגנת הסביבה", "environment"),
    ("איכות הסביבה", "environment"),
    ("משרד הכלכלה", "economy"),
)
SECONDARY_HOSTS = ("obudget.org", "odata.org.il")
ANALYSIS_YEARS = (2023, 2024, 2025, 2026)
PERIOD_NONE, PERIOD_ONE, PERIOD_MANY = "לא זוהתה שנת תקציב בטווח הניתוח", "שנת תקציב ", "שנות תקציב "


@dataclass(frozen=True)
class SourceRules:
    """The rule lists of source classification; first match wins for publisher and type."""

    publishers: tuple = PUBLISHERS
    types: tuple = SOURCE_TYPES
    file_sections: tuple = FILE_SECTIONS
    title_sections: tuple = TITLE_SECTIONS
    secondary_hosts: tuple = SECONDARY_HOSTS
    years: tuple = field(default=ANALYSIS_YEARS)


def decode_entities(c: Column) -> Column:
    for spelled, plain in ENTITIES:
        c = F.regexp_replace(c, spelled, plain)
    return c


def url_host(c: Column | str) -> Column:
    """Host (with port) of an address in lower case; null when there is none."""
    host = F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(host != F.lit(""), F.lower(host))


def url_id(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 12)


def _drop_dot_segments(path: Column) -> Column:
    """``/a/./b/../c`` -> ``/a/c``, folding the segments from the left."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            part == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        )
        .when(part == ".", kept)
        .otherwise(F.concat(kept, F.array(part))),
    )
    return F.array_join(F.concat(folded, closing), "/")


def _encode_address(address: Column) -> Column:
    """Percent-encode what an address may not hold as it stands, such as non-ASCII letters."""
    plain = address.rlike(r"^[\x21-\x7e&&[^\"<>`]]*$")
    encoded = F.array_join(
        F.transform(
            F.split(address, ""),
            lambda c: F.when(c == " ", F.lit("%20"))
            .when(c.rlike(r"[^\x21-\x7e]|[\"<>`]"), F.url_encode(c))
            .otherwise(c),
        ),
        "",
    )
    return F.when(plain, address).otherwise(encoded)


def resolve_url(href: Column, base: Column) -> Column:
    """Address of ``href`` as seen from the page at ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    href = js_trim(href)
    own_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(own_path) + 1, F.length(href))
    absolute = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    bare_host = href.rlike(r"^https?://[^/?#]+$")
    resolved = (
        F.when(absolute & bare_host, F.concat(href, F.lit("/")))
        .when(absolute, href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, _drop_dot_segments(own_path), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), href))
        .otherwise(F.concat(origin, _drop_dot_segments(F.concat(folder, own_path)), rest))
    )
    return _encode_address(resolved)


def is_file_address(address: Column) -> Column:
    return address.rlike(FILE_ADDRESS) | F.contains(address, F.lit(FILES_FOLDER))


def html_title(c: Column | str) -> Column:
    html = col(c)
    title = F.substring(decode_entities(js_trim(F.regexp_extract(html, TITLE_TAG, 1))), 1, TITLE_LENGTH)
    return F.when(html.rlike(TITLE_TAG), title)


def parse_archive_url(c: Column | str) -> Column:
    """Struct of the archived original address and its dataset id; null when not one."""
    text = col(c)
    marker = F.instr(text, "id_/")
    original = F.when(marker > 0, F.substring(text, marker + 4, F.length(text)))
    dataset = F.regexp_extract(original, r"/dataset/([^/]+)/", 1)
    return F.when(
        original.isNotNull() & (dataset != F.lit("")),
        F.struct(original.alias("resource_url"), dataset.alias("dataset_id")),
    )


def publisher_of(host: Column, rules: SourceRules = SourceRules()) -> Column:
    result = None
    for listed, name in rules.publishers:
        hit = (host == F.lit(listed)) | F.endswith(host, F.lit("." + listed))
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return result.otherwise(host)


def source_type_of(url: Column, rules: SourceRules = SourceRules()) -> Column:
    """Type and label of the first rule whose pattern the address matches."""

    def pair(kind: str, label: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"))

    result = None
    for pattern, kind, label in rules.types:
        hit = url.rlike("(?i)" + pattern)
        result = F.when(hit, pair(kind, label)) if result is None else result.when(hit, pair(kind, label))
    return result.otherwise(pair(*DEFAULT_SOURCE_TYPE))


def _fired(pairs: tuple, text: Column, flags: str) -> tuple[Column, Column]:
    """Distinct ids and the audit texts of all patterns that match ``text``."""
    ids = F.array_compact(F.array(*[F.when(text.rlike(flags + p), F.lit(i)) for p, i in pairs]))
    notes = F.array_compact(F.array(*[F.when(text.rlike(flags + p), F.lit(f"{p} → {i}")) for p, i in pairs]))
    return F.array_sort(F.array_distinct(ids)), notes


def classify_source(url: Column | str, title: Column | str, rules: SourceRules = SourceRules()) -> list[Column]:
    """Publisher, type, sections, years, audit text and reliability of one source.

    Sections come from the file name; the title is asked only when the file name says nothing.
    """
    url, title = col(url), col(title)
    host = url_host(url)
    kind = source_type_of(url, rules)
    file_ids, file_notes = _fired(rules.file_sections, url, "(?i)")
    title_ids, title_notes = _fired(rules.title_sections, title, "")
    by_file = F.size(file_ids) > 0
    ids = F.when(by_file, file_ids).otherwise(title_ids)
    section_notes = F.when(by_file, file_notes).otherwise(title_notes)
    text = F.concat_ws(" ", url, title)
    years = F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(str(y))), F.lit(y)) for y in sorted(rules.years)])
    )
    notes = F.concat(
        F.when(F.size(section_notes) > 0, section_notes).otherwise(F.array(F.lit("no section: cross-cutting"))),
        F.array(
            F.when(F.size(years) > 0, F.concat(F.lit("years "), F.array_join(years.cast("array<string>"), ", ")))
            .otherwise(F.lit("no year"))
        ),
    )
    secondary = F.lit(False)
    for part in rules.secondary_hosts:
        secondary = secondary | F.contains(host, F.lit(part))
    return [
        publisher_of(host, rules).alias("publisher"),
        kind["type"].alias("source_type"),
        kind["label"].alias("source_type_label"),
        F.when(secondary, F.lit("secondary_helper")).otherwise(F.lit("primary_official")).alias("reliability"),
        ids.alias("section_ids"),
        years.alias("fiscal_years"),
        F.array_join(notes, " | ").alias("mapping_rule"),
    ]


def period_label_of_years(years: Column | str) -> Column:
    """Label of a sorted year array: none, one, or first–last."""
    y = col(years)
    return (
        F.when(F.size(y) == 0, F.lit(PERIOD_NONE))
        .when(F.size(y) == 1, F.concat(F.lit(PERIOD_ONE), F.get(y, F.lit(0)).cast("string")))
        .otherwise(
            F.concat(
                F.lit(PERIOD_MANY),
                F.get(y, F.lit(0)).cast("string"),
                F.lit("–"),
                F.element_at(y, -1).cast("string"),
            )
        )
    )
