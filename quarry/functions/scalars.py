"""Scalar rules as Column expressions: rounding, severities, paths, versions, licences, decay, cost, emissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounding that takes halves towards positive infinity."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def falsy_to(x: Column, other) -> Column:
    """``other`` where x is null, zero or the empty string."""
    empty = x.isNull() | (x.cast("string") == "") | (x.cast("string").isin("0", "0.0"))
    return F.when(empty, F.lit(other)).otherwise(x)


def issue_id(category: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(category, F.lit(":"), key), 256), 1, 12)


def severity_rank(severity: Column) -> Column:
    """0 for critical, then high, medium, low; 4 for others. Sorting by it puts the worst first."""
    s = F.lower(severity)
    return F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)


def map_severity(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(severity.isNull(), "medium").when(s.isin("critical", "high"), s).when(s.isin("moderate", "medium"), "medium").otherwise("low")


#: What weaknesses are called.
CWE_TITLES = {
    "CWE-94": "Code Injection", "CWE-79": "Cross-site Scripting (XSS)", "CWE-78": "OS Command Injection", "CWE-89": "SQL Injection", "CWE-1321": "Prototype Pollution", "CWE-400": "Resource Exhaustion",
    "CWE-1333": "ReDoS", "CWE-22": "Path Traversal", "CWE-601": "Open Redirect", "CWE-918": "Server-Side Request Forgery (SSRF)", "CWE-287": "Improper Authentication", "CWE-384": "Session Fixation",
    "CWE-327": "Broken Cryptography", "CWE-200": "Information Exposure", "CWE-502": "Deserialization of Untrusted Data",
}


def cwe_title(cwe: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CWE_TITLES.items() for x in pair)), cwe)


def severity_score(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", 9.5).when(s == "high", 7.5).when(s.isin("medium", "moderate"), 5.0).when(s == "low", 2.5).otherwise(0.0)


def rule_severity(setting: Column, default: str) -> Column:
    """A rule's configured severity: 'off' disables it, nothing means the default."""
    return F.when(setting == "off", F.lit(None).cast("string")).otherwise(F.coalesce(setting, F.lit(default)))


# --- paths -------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """Lower case, with its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def normalized(path: Column) -> Column:
    """Folds ``.`` and ``..``; what would climb above the root stays at it."""
    pieces = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        pieces, empty, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(folded, "/")


def joined(directory: Column, relative: Column) -> Column:
    return normalized(F.concat(directory, F.lit("/"), relative))


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest last; turns prefix joins into equality joins."""
    pieces = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))


def renamed_path(path: Column) -> Column:
    """The new name in ``dir/{old => new}/file`` and ``old => new``."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braces, r"^.* => ", ""), "//+", "/")


# --- formatting --------------------------------------------------------------------------------


def format_bytes(n: Column, places: int = 1) -> Column:
    n = n.cast("double")
    shown = lambda unit, name: F.concat(F.format_number(n / unit, places), F.lit(f" {name}"))
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, shown(1024, "KB"))
        .when(n < 1024**3, shown(1024**2, "MB"))
        .otherwise(shown(1024**3, "GB"))
    )


def format_currency(x: Column, sign: str = "£") -> Column:
    money = lambda c: F.concat(F.lit(sign), c)
    return (
        F.when(x < 0.01, money(F.lit("0")))
        .when(x < 1, money(F.format_number(x, 2)))
        .when(x < 100, money(F.format_string("%d", half_up(x).cast("long"))))
        .when(x < 10000, money(F.format_number(half_up(x), 0)))
        .otherwise(money(F.concat(F.format_string("%.1f", x / 1000), F.lit("k"))))
    )


def time_ago(days: Column) -> Column:
    d = days.cast("long")
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(d < 1, "today")
        .when(d < 7, many(d, "day"))
        .when(d < 30, many(F.floor(d / 7), "week"))
        .when(d < 365, many(F.floor(d / 30), "month"))
        .otherwise(many(F.floor(d / 365), "year"))
    )


def interval_ms(text: Column) -> Column:
    """``6h``, ``30m``, ``2d``; six hours where it can't be read."""
    n = F.try_to_number(F.regexp_extract(text, r"^(\d+)[hmd]$", 1), F.lit("999999999")).cast("long")
    unit = F.regexp_extract(text, r"^\d+([hmd])$", 1)
    ms = F.when(unit == "m", n * 60_000).when(unit == "h", n * 3_600_000).when(unit == "d", n * 86_400_000)
    return F.coalesce(ms, F.lit(21_600_000).cast("long"))


# --- versions ----------------------------------------------------------------------------------


def version(text: Column) -> Column:
    """Three whole numbers; missing or unreadable ones are 0. Arrays compare part by part."""
    pieces = F.split(F.regexp_replace(text, r"^[^0-9]*", ""), r"[.]")
    number = lambda i: F.regexp_extract(F.coalesce(F.get(pieces, F.lit(i)), F.lit("")), r"^\s*(\d+)", 1)
    return F.array(*(F.coalesce(number(i).try_cast("int"), F.lit(0)) for i in range(3)))


def update_type(current: Column, latest: Column) -> Column:
    """major, minor or patch, by the first part that is higher; patch also where none is."""
    a, b = version(current), version(latest)
    return F.when(b[0] > a[0], "major").when(b[1] > a[1], "minor").otherwise("patch")


def versions_behind_estimate(current: Column, latest: Column) -> Column:
    a, b = version(current), version(latest)
    return F.greatest(F.lit(1), 10 * (b[0] - a[0]) + 3 * (b[1] - a[1]) + (b[2] - a[2]))


def days_behind(current_released: Column, latest_released: Column) -> Column:
    """Whole days from one release to the other; 0 where either date is missing."""
    seconds = F.unix_timestamp(latest_released) - F.unix_timestamp(current_released)
    return F.coalesce(F.floor(seconds / 86400), F.lit(0)).cast("long")


def bump_type(tag: Column) -> Column:
    """prerelease if the tag, without its v, says so or has a hyphen; stable otherwise."""
    return F.when(F.regexp_replace(tag, "^v", "").rlike("alpha|beta|rc|-"), "prerelease").otherwise("stable")


def fixed_version(advisory_range: Column) -> Column:
    """The version after the first ``>`` or ``>=`` of a range."""
    found = F.regexp_extract(advisory_range, r">=?\s*([\d.]+)", 1)
    return F.when(found == "", "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def major_available(current: Column, latest: Column) -> Column:
    return version(latest)[0] > version(current)[0]


def cost_of_waiting(worst_cve: Column, days: Column, deprecated: Column, maintained: Column) -> dict[str, Column]:
    debt = F.when(days > 730, "significant").when(days > 365, "growing").when(days > 180, "moderate").otherwise("minimal")
    return {
        "security": F.when(worst_cve.isin("critical", "high"), "critical").when(worst_cve.isNotNull(), "high").otherwise("low"),
        "features": F.when(days > 365, "medium").otherwise("low"),
        "maintenance": F.when(days > 180, "medium").otherwise("low"),
        "technical_debt": F.when(deprecated, "critical").when(~maintained, "high").otherwise(debt),
    }


def release_summary(body: Column) -> Column:
    """The first plain line of release notes, else its first bullet, without marks, cut at 150 characters."""
    lines = F.split(body, "\n", -1)
    plain = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^[#*|-]"))
    bullets = F.filter(lines, lambda x: F.trim(x).startswith("- ") | F.trim(x).startswith("* "))
    told = F.coalesce(F.get(plain, F.lit(0)), F.regexp_replace(F.get(bullets, F.lit(0)), r"^[-*]\s*", ""), F.lit(""))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.replace(told, F.lit("**"), F.lit("")), r"`([^`]+)`", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1"))
    short = F.when(F.length(clean) > 150, F.concat(F.substring(clean, 1, 147), F.lit("..."))).when(clean == "", "See release notes").otherwise(clean)
    return F.when(body.isNull() | (body == ""), "No release notes").otherwise(short)


# --- licences ----------------------------------------------------------------------------------

#: Names of each class, tried whole first, and words of each class, in the order they are tried.
PERMISSIVE = (
    "MIT", "ISC", "Unlicense", "CC0-1.0", "0BSD", "Apache-2.0", "Apache 2.0", "Apache-1.1", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-3-Clause-No-Nuclear-License", "BSD*", "Artistic-2.0", "Artistic-1.0", "Zlib", "zlib-acknowledgement", "PSF-2.0", "Python-2.0",
    "Python-2.0-complete", "BlueOak-1.0.0", "CC-BY-3.0", "CC-BY-4.0", "AFL-3.0", "AFL-2.1", "MS-PL", "MulanPSL-2.0", "NCSA", "UPL-1.0",
    "Unicode-DFS-2016", "Unicode-3.0", "X11", "curl", "libpng-2.0", "OFL-1.0", "OFL-1.1", "OpenSSL", "SSLeay", "PHP-3.0", "PHP-3.01",
    "PostgreSQL", "W3C", "W3C-20150513", "Zope-2.0", "ECL-2.0", "EDL-1.0", "Boost-1.0", "BSL-1.0", "WTFPL", "Fair", "Beerware", "HPND",
    "NTP", "Sendmail", "TCL", "Vim", "FTL", "FSFAP", "ICU", "SMLNJ", "AAL", "LPPL-1.3c", "LPPL-1.3a", "Naumen", "Multics", "Eurosym",
    "blessing", "DWTFYWTPL", "JSON", "CC-PDDC", "Public Domain", "PUBLICDOMAIN",
)
COPYLEFT = (
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+", "LGPL-2.0",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.0+", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+", "LGPL-3.0",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "MPL-1.1", "EPL-1.0",
    "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "IPL-1.0", "OSL-3.0", "OSL-2.1", "CECILL-2.1", "APSL-2.0",
    "CPAL-1.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "RPL-1.5", "QPL-1.0",
)
RESTRICTIVE = (
    "SSPL-1.0", "SSPL", "Commons-Clause", "CC-BY-NC-1.0", "CC-BY-NC-2.0", "CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-1.0", "CC-BY-NC-SA-2.0",
    "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-1.0", "CC-BY-ND-2.0", "CC-BY-ND-3.0", "CC-BY-ND-4.0", "Elastic-2.0", "BSL-1.1", "Sleepycat", "Watcom-1.0",
)
PERMISSIVE_WORDS = "MIT|APACHE|BSD|CC0|PUBLIC DOMAIN|WTFPL|ZLIB|OFL|OPEN FONT|BOOST|BSL-1\\.0|PYTHON|PSF|ARTISTIC|POSTGRESQL|W3C|BLUEOAK|UNICODE|JSON|CURL"
PERMISSIVE_NAMES = ("ISC", "ISC LICENSE", "UNLICENSE", "UNLICENSED")
COPYLEFT_WORDS = "GPL|MPL|EPL|EUPL|CDDL|OSL|CC-BY-SA"
RESTRICTIVE_WORDS = "SSPL|COMMONS-CLAUSE|COMMONS CLAUSE|CC-BY-NC|CC-BY-ND|ELASTIC-2"


def _named_license(name: Column) -> Column:
    """The class of one name, not an expression; null where nothing tells it."""
    up = F.upper(name)
    return (
        F.when(name.isin(*PERMISSIVE), "permissive")
        .when(name.isin(*COPYLEFT), "copyleft")
        .when(name.isin(*RESTRICTIVE), "restrictive")
        .when(up.isin(*PERMISSIVE_NAMES) | up.rlike(PERMISSIVE_WORDS), "permissive")
        .when(up.rlike(COPYLEFT_WORDS), "copyleft")
        .when(up.rlike(RESTRICTIVE_WORDS) | (up == "BUSL-1.1"), "restrictive")
    )


def license_class(name: Column) -> Column:
    """permissive, copyleft, restrictive or unknown.

    Whole names first, then words, of which permissive ones win over the others. An expression that
    neither tells has the strictest class of its parts.
    """
    parts = F.transform(F.split(F.regexp_replace(name, "[()]", ""), r"\s+(?:OR|AND)\s+"), lambda p: _named_license(F.trim(p)))
    of_parts = F.when(F.array_contains(parts, "restrictive"), "restrictive").when(F.array_contains(parts, "copyleft"), "copyleft").when(F.array_contains(parts, "permissive"), "permissive")
    told = F.coalesce(_named_license(name), F.when(name.contains(" OR ") | name.contains(" AND "), of_parts), F.lit("unknown"))
    return F.when(name.isNull() | name.isin("", "unknown"), "unknown").otherwise(told)


#: The dashboard's own scheme, words of each risk, in the order they are tried.
HIGH_RISK = "GPL AGPL LGPL SSPL CC-BY-NC CC-BY-ND OSL SLEEPYCAT WATCOM RPL QPL".split()
MEDIUM_RISK = "MPL EPL EUPL CDDL CPL IPL MS-RL CECILL APSL CPAL CC-BY-SA ELASTIC BSL".split()
LOW_RISK = (
    *"MIT ISC BSD Apache Unlicense CC0 WTFPL 0BSD ZLIB PSF PYTHON ARTISTIC PERL RUBY BLUEOAK CC-BY-3 CC-BY-4 AFL MS-PL MULANPSL NCSA UPL".split(),
    *"SAX-PD UNICODE X11 CURL JSON LIBPNG LIBTIFF OFL SIL OPENSSL PHP POSTGRE FAIR W3C ZOPE ECL EDL NAUMEN MULTICS BOOST BST".split(),
    "PUBLIC DOMAIN",
    *"PUBLICDOMAIN AAL SIMPL LATEX LPPL HPND NTP POSTGRESQL SENDMAIL TCL VIM VOL FTL FSFAP ICU LIBTOOL MINPACK SMLNJ SPENCER BEERWARE DWTFYWTPL".split(),
)


def license_risk(name: Column) -> Column:
    """The dashboard's own scheme: high, medium, low, unknown.

    Names are compared without case, so that Apache and Unlicense are low and not unknown.
    """
    up = F.upper(name)
    any_of = lambda words: up.rlike("|".join(w.upper() for w in words))
    return F.when(name.isNull(), "unknown").when(any_of(HIGH_RISK), "high").when(any_of(MEDIUM_RISK), "medium").when(any_of(LOW_RISK), "low").otherwise("unknown")


def license_risk_rank(risk: Column) -> Column:
    return F.when(risk == "high", 0).when(risk == "medium", 1).when(risk == "unknown", 2).otherwise(3)


def license_duties(name: Column) -> dict[str, Column]:
    """What a licence asks for: attribution, source disclosure, notes of modifications."""
    risk = license_risk(name)
    return {"attribution": ~F.upper(name).rlike("UNLICENSE|CC0|WTFPL"), "source_disclosure": risk == "high", "modifications": risk.isin("high", "medium")}


# --- decay -------------------------------------------------------------------------------------

#: The weight of each signal.
WEIGHTS = {"velocity": 25, "imports": 25, "contributors": 12, "staleness": 13, "mtime": 10, "fragility": 8, "exports": 7}
#: Fixed value: files with fewer exports say nothing by the share of dead ones.
LEAST_EXPORTS = 3


def velocity_decline(c30: Column, c90: Column, c365: Column, weight: float = WEIGHTS["velocity"]) -> Column:
    base = F.greatest(c90 / 3.0, c365 / 12.0)
    r = F.try_divide(c30.cast("double"), base)
    score = F.when(c365 < 3, 0.0).when(r >= 1, 0.0).when(r >= 0.5, weight * (1 - r) * 0.6).when(r > 0, weight * (0.7 + 0.3 * (1 - r / 0.5))).otherwise(F.lit(float(weight)))
    return half_up(score, 1)


def import_decline(now: Column, before: Column, weight: float = WEIGHTS["imports"]) -> Column:
    lost = F.greatest(F.lit(0), before - now)
    return half_up(F.when(before.isNull() | (before < 2), 0.0).otherwise(weight * lost / before), 1)


def contributor_withdrawal(recent: Column, ever: Column, c90: Column, weight: float = WEIGHTS["contributors"]) -> Column:
    kept = F.try_divide(recent.cast("double"), ever)
    score = (
        F.when((ever <= 1) | (c90 == 0), 0.0)
        .when((recent == 1) & (ever >= 4), 0.8 * weight)
        .when((recent == 1) & (ever >= 2), 0.5 * weight)
        .when(kept < 0.4, weight * (1 - kept / 0.4))
        .otherwise(0.0)
    )
    return half_up(score, 1)


def staleness(days: Column, weight: float = WEIGHTS["staleness"]) -> Column:
    score = (
        F.when(days.isNull() | (days <= 180), 0.0)
        .when(days <= 365, weight * 0.5 * (days - 180) / 185)
        .when(days <= 730, weight * (0.5 + 0.35 * (days - 365) / 365))
        .otherwise(F.lit(float(weight)))
    )
    return half_up(score, 1)


def mtime_staleness(days: Column, git_staleness: Column, weight: float = WEIGHTS["mtime"]) -> Column:
    """Staleness by the file's own time, only where its history shows none."""
    return F.when(git_staleness > 0, 0.0).otherwise(staleness(days, weight))


def dead_export_share(dead: Column, total: Column, weight: float = WEIGHTS["exports"]) -> Column:
    return half_up(F.when(F.coalesce(total, F.lit(0)) < LEAST_EXPORTS, 0.0).otherwise(weight * F.coalesce(dead, F.lit(0)) / total), 1)


def import_fragility(importers: Column, weight: float = WEIGHTS["fragility"]) -> Column:
    return F.when(importers == 1, float(weight)).when(importers == 2, weight * 0.5).otherwise(0.0)


def decay_level(total: Column) -> Column:
    return F.when(total >= 75, "high").when(total >= 50, "medium").when(total >= 25, "low").otherwise("none")


# --- score, cost, emissions ----------------------------------------------------------------------


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def _capped(n: Column, each: float, most: float) -> Column:
    return F.when(n > 0, F.least(F.lit(float(most)), n * each)).otherwise(0.0)


def health_score(c: dict[str, Column]) -> Column:
    """100 less capped deductions; a critical advisory hides high ones, a restrictive licence copyleft ones."""
    advisories = F.when(c["critical"] > 0, _capped(c["critical"], 20, 40)).otherwise(_capped(c["high"], 10, 20))
    licences = F.when(c["restrictive"] > 0, _capped(c["restrictive"], 10, 15)).otherwise(_capped(c["copyleft"], 2, 5))
    patterns = _capped(c["live_critical"], 8, 25) + _capped(c["live_high"], 4, 15) + _capped(c["dead_critical"], 5, 15) + _capped(c["dead_high"], 3, 10)
    updates = _capped(c["major"], 2, 10) + _capped(c["minor"], 1, 5)
    left = 100 - _capped(c["waste_percent"], 1.5, 30) - advisories - patterns - licences - updates
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(left))).cast("int")


def pillar_scores(c: dict[str, Column]) -> dict[str, Column]:
    over = (c["co2_kg"] - 10) / 10
    floor0 = lambda x: F.greatest(F.lit(0.0), half_up(x)).cast("int")
    most = lambda n, x: F.least(F.lit(float(n)), x.cast("double"))
    return {
        "performance": floor0(25 - most(25, c["waste_percent"] * 1.25)),
        "emissions": F.when(c["co2_kg"] > 10, floor0(10 - over * 5)).otherwise(10),
        "exposure": floor0(40 - most(20, c["critical"] * 20) - most(12, c["high"] * 4) - most(8, c["medium"] * 1)),
        "risk": floor0(25 - most(10, c["major"] * 3) - most(5, c["minor"] * 0.5) - most(5, c["deprecated"] * 2) - most(5, c["restrictive"] * 3)),
    }


#: Rate an hour, team, hires a year, hours lost a hire, overhead percent; minutes to remove a file, export, dependency.
COST = {"rate": 75.0, "team": 5, "hires": 2, "hours": 8, "overhead": 10.0, "file": 5, "export": 2, "dependency": 10}


def developer_cost(waste_percent: Column, files: Column, exports: Column, dependencies: Column) -> dict[str, Column]:
    onboarding = F.lit(COST["hires"] * COST["hours"] * COST["rate"])
    upkeep = COST["team"] * 2080 * (COST["overhead"] / 100) * F.least(waste_percent / 10, F.lit(1.0)) * COST["rate"]
    cleanup = (files * COST["file"] + exports * COST["export"] + dependencies * COST["dependency"]) / 60.0 * COST["rate"]
    annual = onboarding + upkeep
    return {"onboarding": onboarding, "maintenance": upkeep, "annual": annual, "cleanup": cleanup, "roi_months": F.try_divide(cleanup, annual / 12)}


#: kWh a GB in use and in the making, by segment, and the world's grams a kWh.
IN_USE = {"data_center": 0.055, "network": 0.059, "device": 0.080}
IN_MAKING = {"data_center": 0.012, "network": 0.013, "device": 0.081}
WORLD_GRID = 494
GRID = {
    "Global": 494, "UK": 233, "France": 85, "Germany": 385, "Spain": 200, "Italy": 371, "Netherlands": 386, "Belgium": 167, "Poland": 635,
    "Sweden": 41, "Norway": 26, "Denmark": 166, "Finland": 131, "Austria": 158, "Switzerland": 48, "Ireland": 296, "Portugal": 255,
    "US": 379, "USA": 379, "Canada": 120, "Mexico": 431, "China": 582, "Japan": 471, "India": 632, "Australia": 517, "South Korea": 415,
    "Singapore": 408, "New Zealand": 118, "Brazil": 103, "South Africa": 709,
}


def grid_intensity(region: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in GRID.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(known, F.lower(region)), F.lit(WORLD_GRID))


def transfer_gb(size_bytes: Column, visitors: int = 10_000, pages: int = 3, cached: float = 0.7) -> Column:
    return visitors * pages * ((1 - cached) + cached * 0.1) * size_bytes / 1073741824.0


def monthly_grams(gb: Column, grid: Column, green: Column) -> Column:
    centre = IN_USE["data_center"] * F.when(green, 0.2).otherwise(1.0)
    used = centre * grid + IN_USE["network"] * grid + IN_USE["device"] * WORLD_GRID
    return gb * (used + sum(IN_MAKING.values()) * WORLD_GRID)


def compared_emissions(before: Column, after: Column) -> dict[str, Column]:
    """What a change saves of yearly emissions, and in percent."""
    return {"saved": before - after, "percent": F.coalesce(F.when(before > 0, (before - after) / before * 100), F.lit(0.0))}


#: What serving bytes is taken to cost, by what they are; the three differ on purpose.
SERVED = {
    "dead-file": {"loads": 30_000 * (1 - 0.8), "compressed": 1.0, "per_gb": 0.085, "co2_per_gb": 0.5},
    "dependency": {"loads": 10_000 * 0.3, "compressed": 0.3, "per_gb": 0.085, "co2_per_gb": 0.2},
    "asset": {"loads": 10_000 * (1 - 0.8), "compressed": 1.0, "per_gb": 0.08, "co2_per_gb": 0.5},
}


def served(size: Column, what: str) -> dict[str, Column]:
    """GB, cost and kg of CO2 a month of bytes that are served to users."""
    k = SERVED[what]
    gb = F.floor(size * k["compressed"]) * k["loads"] / float(1 << 30)
    return {"gb": gb, "cost": gb * k["per_gb"], "co2_kg": gb * k["co2_per_gb"]}


def dashboard_scores(waste_percent: Column, severe: Column, outdated: Column) -> dict[str, Column]:
    """The dashboard's own parts of a score: waste of 30, security of 40, updates of 20, emissions always 10."""
    zero = F.lit(0.0)
    return {
        "waste": half_up(F.greatest(zero, 30 - waste_percent * 0.5)).cast("int"), "security": half_up(F.greatest(zero, 40.0 - severe * 5)).cast("int"),
        "outdated": F.greatest(F.lit(0), 20 - outdated).cast("int"), "emissions": F.lit(10),
    }


def avoided_grams(saved_bytes: Column) -> Column:
    """Emissions a year that bytes no longer served avoid."""
    return saved_bytes * 100_000 * 6e-10 * 0.233 * 12
