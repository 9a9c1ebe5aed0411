"""Addresses and pages: normal forms, page types, link rules, HTML parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each page type, in the order that decides; a word stands between "/" or "." and "/", "?", "." or the end.
PAGE_TYPES = {
    "transfer": ("transfer", "transferring", "credit-transfer", "articulation", "advanced-standing"),
    "international": ("international", "global-education", "study-abroad", "visa", "immigration", "toefl", "ielts", "english-proficiency"),
    "admissions": ("admissions?", "apply", "application", "enrollment", "admitted", "freshman", "first-year", "prospective", "early-decision", "early-action", "acceptance", "accepted-students"),
    "diversity": ("diversity", "inclusion", "multicultural", "equity", "belonging", "dei"),
    "academics": ("academics?", "programs?", "majors?", "minors?", "degrees?", "courses?", "curriculum", "departments?", "catalog", "registrar", "honors", "undergraduate-programs?"),
    "financial_aid": ("financial-?aid", "tuition", "scholarships?", "cost-of-attendance", "net-price", "fafsa", "work-study", "bursar", "billing", "affordability"),
    "outcomes": ("career-services?", "career-center", "careers?", "outcomes?", "employment", "placement", "internships?", "post-graduation", "alumni-outcomes"),
    "safety_health": ("campus-safety", "campus-police", "safety", "police", "security", "health-services?", "counseling", "disability", "mental-health", "wellness", "clery", "accessibility"),
    "about": ("about", "overview", "mission", "history", "fast-facts", "facts-and-figures", "at-a-glance", "rankings", "accreditation", "president", "leadership", "who-we-are"),
    "campus_life": (
        "campus", "housing", "dining", "student-life", "residence", "dorms?", "athletics", "clubs?", "greek", "recreation", "student-activities", "student-organizations?", "fraternity", "sorority",
        "sports",
    ),
    "research": ("research", "faculty", "laboratories?", "institute", "publications?"),
}
# Links that are not followed, by extension, path, and pattern.
SKIP_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "7z", "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "mp3", "mp4", "avi", "mov", "wmv", "flv", "webm", "css",
    "js", "xml", "json", "rss", "atom", "exe", "msi", "dmg", "pkg", "deb", "rpm",
)
SKIP_PATHS = (
    "/admin", "/login", "/logout", "/register", "/signup", "/api/", "/ajax/", "/json/", "/xml/", "/search", "/filter", "/sort", "/print", "/download", "/export", "/calendar", "/events",
    "/news/archive", "/contact", "/feedback", "/survey",
)
SKIP_PATTERNS = (
    r".*\.pdf$",
    r".*\.doc[x]?$",
    r".*\.xls[x]?$",
    r".*\.ppt[x]?$",
    r".*\.zip$",
    r".*\.rar$",
    r".*\.exe$",
    r".*\.dmg$",
    r".*\.(jpg|jpeg|png|gif|bmp|svg|ico)$",
    r".*\.(mp3|mp4|avi|mov|wmv|flv)$",
    r".*/calendar/.*",
    r".*/events?/.*",
    r".*/news/.*",
    r".*/blog/.*",
    r".*/login.*",
    r".*/register.*",
    r".*/admin.*",
    r".*/wp-admin.*",
    r".*/wp-content.*",
    r".*facebook\.com.*",
    r".*twitter\.com.*",
    r".*instagram\.com.*",
    r".*linkedin\.com.*",
    r".*youtube\.com.*",
    r"mailto:.*",
)
# Endings of educational hosts, and parameters that only track.
EDUCATIONAL = (
    ".edu", ".ac.uk", ".ac.nz", ".ac.jp", ".ac.za", ".ac.kr", ".ac.in", ".edu.au", ".edu.uk", ".edu.sg", ".edu.cn", ".edu.tw", ".edu.my", ".edu.hk", ".edu.jp", ".edu.br", ".edu.mx", ".edu.co",
    ".edu.ar",
)
TRACKERS = r"^(utm_[^=]*|fbclid|gclid|msclkid|sessionid|phpsessid)(=|$)"

_HOST, _PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """The host, lower-cased, without user, port and one www."""
    raw = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^.*@", ""), r":\d+$", "")
    return F.regexp_replace(raw, r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalized(url: Column) -> Column:
    """Scheme and host lower-cased, default ports and double slashes out, trackers out, parameters sorted by name, no fragment, no last slash."""
    scheme, authority = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, _HOST, 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    way = F.regexp_replace(F.regexp_replace(path(url), "/{2,}", "/"), "/+$", "")
    kept = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKERS))
    numbered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), i.alias("i"), p.alias("p"))))
    params = F.array_join(F.transform(numbered, lambda s: s["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), authority, way, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))
    return F.when(scheme.isin("http", "https"), whole).otherwise(url)


def is_junk(url: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Whether an address is not worth a visit by one of the patterns; by default there are none."""
    return F.lower(url).rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def resolved(link: Column, base: Column) -> Column:
    """A link made absolute: by its own scheme, else the base's scheme, host and folder; dots in paths are followed, fragments cut."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    plain = F.regexp_replace(F.trim(link), "#.*$", "")
    whole = (
        F.when(plain.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), plain).when(plain.startswith("//"), F.concat(scheme, F.lit(":"), plain)).when(plain == "", F.regexp_replace(base, "#.*$", ""))
        .when(plain.startswith("/"), F.concat(root, plain)).when(plain.startswith("?"), F.concat(root, path(base), plain)).otherwise(F.concat(root, folder, plain))
    )
    parts = F.split(path(whole), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    q = query_of(whole)
    tidy = F.concat(F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.array_join(kept, "/"), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(whole.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), tidy).otherwise(whole)


def page_links(html: Column, base: Column) -> Column:
    """What a page's crawl would follow: targets of its links, in single, double or no quotes, and its rel=next, absolute and normalised, internal and educational, each once in order."""
    value = r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tags = F.concat(F.regexp_extract_all(html, F.lit(r"(?i)(<a\b[^>]*>)"), F.lit(1)), F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?next\b""")))
    found = F.transform(tags, lambda t: F.trim(F.concat(*[F.regexp_extract(t, f"(?i){value}", k) for k in (1, 2, 3)])))
    sound = F.filter(found, lambda u: (u != "") & ~F.lower(u).rlike("^(#|mailto:|tel:|javascript:|ftp:|data:|blob:)"))
    whole = F.transform(sound, lambda u: normalized(resolved(u, base)))
    return F.array_distinct(F.filter(whole, lambda u: is_internal(u, base) & is_educational(u)))


def canonical_key(url: Column) -> Column:
    """Host without www., path without last slash, query; no scheme and no fragment."""
    q = query_of(url)
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def page_type(url: Column) -> Column:
    low, out = F.lower(url), None
    for name, words in PAGE_TYPES.items():
        hit = low.rlike(rf"[/.](?:{'|'.join(words)})(/|$|\?|\.)")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def is_educational(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "").rlike("(" + "|".join(e.replace(".", r"\.") for e in EDUCATIONAL) + ")$")


def is_internal(url: Column, base: Column) -> Column:
    """Relative, or on the base's host or a subdomain of it and not excluded by extension, path, or pattern."""
    relative = ~url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    low, own = F.lower(url), host(base)
    inside = (host(url) == own) | F.endswith(host(url), F.concat(F.lit("."), own))
    out = low.rlike(r"^https?://") & ~F.lower(path(url)).rlike(r"\.(" + "|".join(SKIP_EXTENSIONS) + ")$")
    out = out & ~F.lower(path(url)).rlike("|".join(p.replace(".", r"\.") for p in SKIP_PATHS))
    return relative | (inside & out & ~low.rlike("|".join(SKIP_PATTERNS)))


def title(html: Column) -> Column:
    """The title, else the first heading, squeezed; empty without either."""
    found = [F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1) for tag in ("title", "h1")]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_replace(f, r"<[^>]+>", " "), r"\s+", " ")), F.lit("")) for f in found], F.lit(""))


def main_content(html: Column) -> Column:
    """The text of the first of main, article, section, else body, else all, scripts, styles, navigation and frame parts out."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    parts = [F.nullif(F.regexp_extract(out, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1), F.lit("")) for tag in ("main", "article", "section", "body")]
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(*parts, out), r"<[^>]+>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of links in order, each once: no empty ones, no fragments, no mail, telephone, script or data targets."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.trim(u)), lambda u: (u != "") & ~F.lower(u).rlike("^(#|mailto:|tel:|javascript:|ftp:|data:|blob:)")))


def is_js_heavy(html: Column, url: Column) -> Column:
    low = F.lower(html)
    scripts, tags, outer = (F.regexp_count(low, F.lit(p)) for p in (r"<script\b", r"<[a-z][^>]*>", r"<script\b[^>]*\bsrc\s*="))
    marked = low.rlike(r"__next_data__|id=\"__nuxt\"|data-reactroot|ng-app|ember|window\.__initial_state__|window\.__apollo_state__")
    dense = (scripts >= 30) | (scripts / F.greatest(tags, F.lit(1)) >= 0.25) | (outer >= 10)
    return marked | dense | url.contains("#/") | F.lower(path(url)).rlike("/app/|/wp-json/")
