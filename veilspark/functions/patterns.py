"""The candidate patterns, word lists and code tables of the detectors."""

from __future__ import annotations

#: An ASCII word boundary; Java's own `\b` also sees non-ASCII letters.
B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
S = r"[\t\n\f\r ]"

MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
SUFFIX = r"Inc|Incorporated|LLC|L\.L\.C\.|Corp|Corporation|Ltd|Limited|Co|Company|GmbH|PLC|LLP|LP|Group|Holdings"
STREET = (
    "Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Circle|Cir|Place|Pl|"
    "Highway|Hwy|Parkway|Pkwy|Terrace|Ter|Square|Sq"
)
LOCALITY = (
    "Marg|Nagar|Colony|Society|Chowk|Layout|Compound|Village|Taluka|Tehsil|Sector|Block|Peth|Vihar|Puram|"
    "Bagh|Gali|Galli|Extension|Enclave|Chawl|Wadi|Gaon|Cross|Circle|Road|Rd"
)

# Structured candidates, with ASCII classes. \b and \s stand for the ASCII forms; java() and re2() write them out.
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
PHONE = r"\+?\(?[0-9]{1,4}\)?[0-9().\-\s]{6,17}[0-9]"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IPV6 = r"[0-9A-Fa-f:]{2,45}"
DATE = r"\b[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}\b"
MDY = rf"(?i)\b(?:{MONTHS})\.?\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b"
DMY = rf"(?i)\b[0-9]{{1,2}}\s+(?:{MONTHS})\.?,?\s+[0-9]{{4}}\b"

# Pattern recognisers, with Unicode classes; \w, \b, \s and \d are the Unicode ones here.
ORG = rf"\b(?:[A-Z][\w&'-]*\s+){{0,4}}[A-Z][\w&'-]*,?\s+(?:{SUFFIX})\.?\b"
ADDRESS_US = rf"\b\d{{1,6}}\s+(?:[A-Z][a-zA-Z.]*\s+){{1,4}}(?:{STREET})\.?(?:,?\s+(?:Suite|Ste|Apt|Unit)\.?\s+\w+)?\b"
ADDRESS_IN_LOCALITY = rf"\b(?:(?:[A-Z][a-zA-Z.]*\s+){{1,4}}(?:{LOCALITY})\b|\b(?:{LOCALITY})\s+(?:No\.?\s*)?[\w-]+\b)"
ADDRESS_IN_HOUSE = r"(?i:\b(?:S(?:urvey)?\.?\s*no\.?|Plot\s*no\.?|Flat\s*no\.?|Gat\s*no\.?)\s*[:.]?\s*[\w/-]+\b)"
ADDRESS_IN_PIN = r"\b[A-Z][a-zA-Z]+\s*[-–]?\s*\d{3}\s?\d{3}\b"
SCORES = {"org_suffix": 0.85, "address_us": 0.75, "address_in_locality": 0.7, "address_in_house": 0.6, "address_in_pin": 0.65}

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_VALID = rf"^(?:{OCTET}\.){{3}}{OCTET}$"
HEXTETS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
IPV6_FULL = "^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"
IPV6_SHORT = f"^(?:{HEXTETS})?::(?:{HEXTETS})?$"
SSN_VALID = r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6(?:[0-57-9][0-9]|6[0-57-9]))-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})$"

# North American numbers by their numbering rule: the area code's second digit is not 9, it is no N11, 37X or 96X code and not 555; the exchange is no N11.
NANP = "(?:[2-9][0-8][0-9])(?:[2-9][0-9]{2})[0-9]{4}"
NANP_NOT = "^(?:[2-9]11|37[0-9]|96[0-9]|555)|^[0-9]{3}[2-9]11"
# Calling code: digits of the national number, for codes that are no North American ones.
CALLING = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (9, 11),
    "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (7, 11), "51": (8, 9),
    "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10),
    "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "94": (9, 9),
    "212": (9, 9), "234": (8, 10), "254": (9, 9), "351": (9, 9), "353": (7, 9), "358": (6, 10), "380": (9, 9), "420": (9, 9), "852": (8, 8), "886": (8, 9),
    "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
# Regions that share the North American plan.
AMERICAN = ("US", "CA", "PR", "DO", "JM", "BS", "BB", "TT")
# Region: calling code.
REGIONS = {
    "RU": "7", "EG": "20", "ZA": "27", "GR": "30", "NL": "31", "BE": "32", "FR": "33", "ES": "34", "HU": "36", "IT": "39",
    "RO": "40", "CH": "41", "AT": "43", "GB": "44", "DK": "45", "SE": "46", "NO": "47", "PL": "48", "DE": "49", "PE": "51",
    "MX": "52", "AR": "54", "BR": "55", "CL": "56", "CO": "57", "MY": "60", "AU": "61", "ID": "62", "PH": "63", "NZ": "64",
    "SG": "65", "TH": "66", "JP": "81", "KR": "82", "VN": "84", "CN": "86", "TR": "90", "IN": "91", "PK": "92", "LK": "94",
    "MA": "212", "NG": "234", "KE": "254", "PT": "351", "IE": "353", "FI": "358", "UA": "380", "CZ": "420", "HK": "852", "TW": "886",
    "SA": "966", "AE": "971", "IL": "972",
}
# By region, the national form without a calling code where more is known of it than its length.
NATIONAL = {"IN": "^0?[6-9][0-9]{9}$", "GB": "^0[1-9][0-9]{8,9}$", "DE": "^0[1-9][0-9]{5,10}$", "FR": "^0[1-9][0-9]{8}$", "IT": "^[03][0-9]{8,10}$", "RU": "^8?[3-9][0-9]{9}$", "HU": "^(?:06)?[1-9][0-9]{7,8}$"}


def national(region: str) -> str | None:
    """Digits of a number in its region's national form: as listed, else a trunk 0 or none and as many digits as its calling code allows. None for the North American plan; a ValueError for a region not listed."""
    if region in AMERICAN:
        return None
    if region not in REGIONS:
        raise ValueError(f"no numbering rule for region {region}")
    low, high = CALLING[REGIONS[region]]
    return NATIONAL.get(region, f"^0?[1-9][0-9]{{{low - 1},{high - 1}}}$")


def java(pattern: str, unicode: bool = False, ascii_classes: bool = False) -> str:
    """The pattern for Spark. ascii_classes: a pattern with Unicode classes as `re2` has it, where \\b, \\s and \\d are ASCII ones."""
    if unicode and ascii_classes:
        return re2(pattern, True).replace(r"\b", f"(?-i:{B})").replace(r"\s", S).replace(r"\d", "[0-9]").replace("(?i:", "(?iu:")
    return "(?U)" + pattern if unicode else pattern.replace(r"\b", B).replace("[0-9().\\-\\s]", "[0-9().\\-\\t\\n\\f\\r ]").replace(r"\s", S)


def re2(pattern: str, unicode: bool = False) -> str:
    """The pattern for DuckDB, whose classes are ASCII ones."""
    return pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", r"[\p{L}\p{N}_]") if unicode else pattern


def international() -> str:
    """Digits of a full international number outside North America."""
    return "^(?:" + "|".join(f"{code}[0-9]{{{low},{high}}}" for code, (low, high) in sorted(CALLING.items())) + ")$"
