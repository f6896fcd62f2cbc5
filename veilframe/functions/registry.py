"""The detectors, as rows: a pattern, the group that is the value, a confidence, and a test of the value.

Tests are SQL over ``v`` that Spark and DuckDB both read. A gate names literals of which one must stand in a text that the
pattern can match (see ``operators.detect.opens``); it only saves the search, and ``¦`` in it means ``|``. A detector's gate holds for all its patterns.
A pattern that can't take a line break (see ``functions.match.within_line``) is searched for in lines, and so its gate opens for lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# How specific a type is, and the priority of its detector.
SPECIFICITY = {
    "SSN": 100, "MRN": 95, "CREDIT_CARD": 90, "ACCOUNT": 85, "LICENSE": 85, "PASSPORT": 85, "IBAN": 85, "HEALTH_PLAN": 85,
    "EMAIL": 80, "PHONE": 75, "FAX": 75, "IP": 75, "URL": 75, "MAC_ADDRESS": 75, "BITCOIN": 75, "VEHICLE": 70, "DEVICE": 70,
    "BIOMETRIC": 70, "DATE": 60, "ZIPCODE": 55, "ADDRESS": 50, "CITY": 45, "STATE": 45, "COUNTY": 45, "AGE": 40,
    "RELATIVE_DATE": 40, "PROVIDER_NAME": 36, "NAME": 35, "OCCUPATION": 30, "CUSTOM": 20,
}
UNKNOWN_SPECIFICITY = 25
PRIORITY = {
    "SSN": 10, "CREDIT_CARD": 10, "MRN": 9, "DEVICE": 9, "ACCOUNT": 8, "LICENSE": 8, "PASSPORT": 8, "HEALTH_PLAN": 8, "DATE": 8,
    "AGE": 8, "RELATIVE_DATE": 8, "PHONE": 7, "FAX": 7, "EMAIL": 7, "NAME": 6, "PROVIDER_NAME": 6, "ADDRESS": 5, "VEHICLE": 5,
    "BIOMETRIC": 5, "ZIPCODE": 4, "URL": 3, "IP": 3, "OCCUPATION": 2,
}
DEFAULT_PRIORITY = 5


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    confidence: float
    group: int = 0
    valid: str = "true"
    priority: int | None = None
    gate: str = ""
    #: Names a text's edge or a line break, yet finds the same values in each line by itself.
    by_line: bool = False


@dataclass(frozen=True)
class Detector:
    name: str
    type: str
    patterns: tuple[Pattern, ...]
    gate: str = ""
    default: bool = True
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def priority(self, p: Pattern) -> int:
        return p.priority if p.priority is not None else PRIORITY.get(self.type, DEFAULT_PRIORITY)


_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MONTHS = "~jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_YEAR = r"(?:19|20)\d{2}"
_CAP = r"[A-Z][a-z]+"
_UP = r"[A-Z]{2,}"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Ter|Circle|Cir|Parkway|Pkwy|Square|Sq|Trail|Trl)"
_STATE = r"(?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])"
_NO = r"(?:number|no\.?|num\.?|#)"
_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
_HAS_DIGIT = "regexp_replace(v, '[^0-9]', '', 'g') <> ''"
_NUMBER = "regexp_replace(v, '[^0-9]', '', 'g')"
_MEMBER = "length(regexp_replace(v, '[-.]', '', 'g')) BETWEEN 7 AND 20 AND " + _HAS_DIGIT
# Beginnings of cards for tests, which pass as they are, as does every 15-digit number of one issuer.
_CARD = f"{_DIGITS} BETWEEN 13 AND 19 AND (luhn(v) OR {_DIGITS} = 15 AND substr({_NUMBER}, 1, 2) IN ('34', '37') OR substr({_NUMBER}, 1, 4) IN ('4532', '4556', '5425', '2221', '3782', '6011'))"
# Short labels of record numbers, as written and as scanners misread them.
_SHORT = "pat|pt|mrn|med|rec|id|acc"
_MISREAD = "reec|aacc|cac|pzt|pr|rfc|8d|bd"
_MISREAD_MED = "jed|mde|meo|m0e|mfd|ned|mep|mre|mr0|mkn"
_NOT_HEADING = "v NOT IN ('PATIENT', 'DATE', 'RECORD', 'NUMBER', 'PHONE', 'ADDRESS', 'EMAIL', 'MEMBER', 'ACCOUNT', 'STATUS')"
_OCTETS = " AND ".join(f"CAST(split_part(v, '.', {i}) AS INT) <= 255" for i in (1, 2, 3, 4))
_RELATIONS = "mother|father|wife|husband|son|daughter|brother|sister|spouse|guardian"

P = Pattern
DETECTORS: tuple[Detector, ...] = (
    Detector("ssn", "SSN", (
        P("dashed", r"\b\d{3}[-–]\d{2}[-–]\d{4}\b", 0.95, gate="#000-00|000–00"), P("spaced", r"\b\d{3}[ \t]\d{2}[ \t]\d{4}\b", 0.95, gate="#000 00|000\t00"), P("dotted", r"\b\d{3}\.\d{2}\.\d{4}\b", 0.95, gate="#000.00.0000"),
        P("labelled", r"(?i)\b(?:ssn|social security(?: number| no)?)[ \t]*[:#]?[ \t]*(\d{9})\b", 0.95, 1, gate="~ssn|social security & #000000000"), P("masked", r"[*Xx]{3}-[*Xx]{2}-\d{4}\b", 0.95, gate="~***-|*x-|x*-|xx-|**- & #-0000"),
        P("solid", r"\b\d{9}\b", 0.80, gate="#000000000"),
    ), "#000|-0000"),
    Detector("phone", "PHONE", (
        P("parens", r"\(\d{3}\)[ \t]?\d{3}[-. ]\d{4}\b", 0.90, gate="#(000)"), P("dashed", r"\b\d{3}-\d{3}-\d{4}\b", 0.90, gate="#000-000-0000"), P("dotted", r"\b\d{3}\.\d{3}\.\d{4}\b", 0.90, gate="#000.000.0000"),
        P("spaced", r"\b\d{3} \d{3} \d{4}\b", 0.90, gate="#000 000 0000"), P("international", r"\+\d{1,3}[-. ]?(?:\(\d{1,4}\)[-. ]?)?\d{2,4}(?:[-. ]\d{2,4}){2,4}\b", 0.95, gate="#+0"),
        P("extension", r"(?i)\b\d{3}[-. ]\d{3}[-. ]\d{4}[ \t]*(?:ext\.?|x)[ \t]*\d{1,6}\b", 0.95, gate="~x & #000-000|000.000|000 000"), P("vanity", r"\b1-8\d{2}-[A-Z]{3}-[A-Z]{4}\b", 0.90, gate="1-8 & #-AAA-AAAA"),
        P("british", r"\b0\d{4}[ ]\d{6}\b", 0.90, gate="#00000 000000"), P("british_city", r"\b0\d{2,3}[ ]\d{3,4}[ ]\d{4}\b", 0.90, gate="#000 0000|000 000"), P("french", r"\b0[1-9](?:[ .]\d{2}){4}\b", 0.90, gate="#00 00 00 00 00|00.00.00.00.00"),
        P("german", r"\b0\d{2,4}/\d{5,8}\b", 0.90, gate="#00/00000"), P("australian", r"\b04\d{2}[ ]\d{3}[ ]\d{3}\b", 0.90, gate="#0000 000 000"),
    ), "#0"),
    Detector("fax", "FAX", (
        P("labelled", r"(?i)\bfax(?:[ \t]*(?:number|no\.?|#))?[ \t]*[:#]?[ \t]*\(?\d{3}\)?[-. \t]?[ \t]?\d{3}[-. ]\d{4}\b", 0.95, gate="~fax"),
        P("sent", r"(?i)\b(?:send|transmit)(?:ted)? to[ \t]+\(?\d{3}\)?[-. ]?\d{3}[-. ]\d{4}\b", 0.95, gate="~send|transmit"),
    ), "#000"),
    Detector("email", "EMAIL", (P("address", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", 0.95),), "@"),
    Detector("zip", "ZIPCODE", (
        P("plus4", r"\b\d{5}-\d{4}\b", 0.85, gate="#00000-0000"), P("five", r"\b\d{5}\b", 0.85), P("with_state", rf"\b{_STATE}[ \t]+(\d{{5}}(?:-\d{{4}})?)\b", 0.85, 1, gate="#AA 00000|AA  00000|AA\t"),
    ), "#00000"),
    Detector("ipv4", "IP", (P("quad", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.95, 0, _OCTETS),), "#0.0"),
    Detector("ipv6", "IP", (
        P("full", r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b", 0.95, gate=":"), P("compressed", r"(?i)\b(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}\b", 0.95, gate="::"),
    ), ":"),
    Detector("mac", "MAC_ADDRESS", (P("pairs", r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b", 0.95),), ":|-"),
    Detector("url", "URL", (
        P("scheme", r"(?i)\b(?:https?://|www\.)[a-z0-9./?=&_%#:-]*[a-z0-9/]", 0.95, gate="~http|www."), P("portal", r"(?i)\b(?:portal|mychart)\.[a-z0-9-]+\.[a-z]{2,}(?:/[a-z0-9./?=&_-]*)?", 0.92, gate="~portal.|mychart."),
        P("query", r"(?i)[?&](?:patient|mrn|ssn|member)(?:_?id)?=[a-z0-9-]+", 0.93, gate="="), P("social", r"(?i)\b(?:facebook|twitter|linkedin|instagram)\.com/[a-z0-9._-]+", 0.90, gate="~.com/"),
        P("health", r"(?i)\b[a-z0-9-]+\.(?:hospital|clinic|health|healthcare|medical)\b(?:/[a-z0-9./?=&_-]*)?", 0.85, gate="~.hospital|.clinic|.health|.medical"),
    )),
    Detector("mrn", "MRN", (
        P("labelled", r"(?i)\b(?:mrn|medical record(?: number| no\.?| #)?|chart(?: number| no\.?| #)|record(?: number| no\.?| #))[ \t]*[:#]?[ \t]*([a-z0-9-]{4,15})\b", 0.90, 1, _HAS_DIGIT, gate="~mrn|record|chart"),
        P("prefixed", r"\bMRN-?\d{5,10}\b", 0.90, gate="MRN"), P("short", r"(?i)\bMR[ \t]?#[ \t]*:?[ \t]*([a-z0-9-]{4,15})\b", 0.90, 1, _HAS_DIGIT, gate="~mr#|mr #|mr\t#"),
        P("patient_id", rf"(?i)\b(?:patient|pt|hospital|hosp)[ \t]+(?:id|identifier|{_NO})[ \t]*[:#]?[ \t]*([a-z0-9-]{{4,15}})\b", 0.90, 1, _HAS_DIGIT, gate="~patient|pt|hosp"),
        P("visit", rf"(?i)\b(?:encounter|visit|admission|episode|accession|specimen|unit|case)[ \t]*(?:id|{_NO})[ \t]*[:#]?[ \t]*([a-z0-9-]{{4,15}})\b", 0.88, 1, _HAS_DIGIT, gate="~encounter|visit|admission|episode|accession|specimen|unit|case"),
        P("national", r"(?i)\b(?:nhs|chi|ur|hospital)[ \t]*(?:number|no\.?)[ \t]*[:#]?[ \t]*(\d{3}[ -]?\d{3}[ -]?\d{4})\b", 0.90, 1, gate="~nhs|chi|ur|hospital"),
        P("dashed_prefix", r"\b(?:MR|PT|HN|EMR|EHR)-\d{4,10}\b", 0.88, gate="MR-|PT-|HN-|EHR-"),
        P("plain", r"(?i)\b(?:mrn?|medical[ \t]+record|chart|record|patient|case|accession)[ \t]*[:#]?[ \t]*#?[ \t]*([a-z0-9][a-z0-9-]{4,14})\b", 0.90, 1, _HAS_DIGIT, gate="~mr|record|chart|patient|case|accession"), P("file", r"(?i)\bfile[ \t]*[:#]?[ \t]*#?[ \t]*(\d{4,14})\b", 0.90, 1, gate="~file & #0000"),
        P("underscored", r"(?i)\b(?:patient|pat|pt|mrn|mr|rec|chart|case|acc)_[a-z0-9_]{4,20}\b", 0.90, 0, _HAS_DIGIT, gate="_"), P("hash", r"(?:^|[ \t\r\n:;,(\[])#(\d{6,12})\b", 0.90, 1, gate="##000000", by_line=True),
        P("short_label", rf"(?i)\b(?:{_SHORT})(?:[: \t-]*{_YEAR}(?:-?\d{{5,10}}|[- \t]+\d{{4,10}})|[: \t]*\d{{1,3}}[ \t|]+\d{{3,10}}|[: \t]+[a-z0-9!@#$%^&*()_+=-]{{5,20}})\b", 0.90, 0, _HAS_DIGIT, gate=f"~{_SHORT}"),
        P("misread", rf"(?i)\b(?:(?:chart|case|{_MISREAD})[: \t]+\d{{5,14}}|(?:me0|adc)[: \t]+[a-z0-9!@#$%^&*()_+=-]{{5,20}}|(?:{_MISREAD_MED})[: \t]+[a-z0-9]{{5,14}})\b", 0.90, 0, _HAS_DIGIT, gate=f"~chart|case|{_MISREAD}|me0|adc|{_MISREAD_MED}"),
        P("piped", r"(?i)(?:mrn|med|record|patient|id|#)[: \t#]*(\d{2,6}\|\d{2,6})\b", 0.90, 1, gate="#00¦00"),
        P("split_labelled", r"(?i)(?:medical[ \t]+record|mrn|record[ \t]*#)[: \t#]*(\d{2,4}[ \t]+\d{3,6}[a-z0-9]*)\b", 0.90, 1, gate="~record|mrn & #00 0|00  |00 \t|00\t"),
    ), "#0"),
    Detector("health_plan", "HEALTH_PLAN", (
        P("labelled", r"(?i)\b(?:medicare|medicaid|member|policy|group|plan|subscriber|insurance)[ \t]*(?:id|number|no\.?|#)[ \t]*[:#]?[ \t]*([a-z0-9-]{5,20})\b", 0.85, 1, _HAS_DIGIT, gate="~medica|member|policy|group|plan|subscriber|insurance"),
        P("beneficiary", r"\b[1-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9]\d-?[AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9]\d-?[AC-HJKMNP-RT-Y]{2}\d{2}\b", 0.85, gate="#AA00"),
        P("pharmacy", r"(?i)\brx[ \t]*(?:bin|grp|group|pcn)[ \t]*[:#]?[ \t]*([a-z0-9]{4,15})\b", 0.85, 1, _HAS_DIGIT, gate="~rx"),
        P("plain", r"(?i)\b(?:medicare|medicaid|member|subscriber|insurance|policy)[ \t]*[:#]?[ \t]*([a-z0-9][a-z0-9-]{6,24})\b", 0.85, 1, _MEMBER, gate="~medica|member|subscriber|insurance|policy"), P("code", r"(?i)\b(?:plan|grp|policy|pol|pl)-[a-z0-9-]{4,24}\b", 0.85, 0, _MEMBER, gate="~plan-|grp-|policy-|pol-|pl-"),
        P("short_code", r"(?i)\bpol[ \t]*[:#]?[ \t]*([a-z0-9]{2,5}-[a-z0-9-]{3,20})\b", 0.85, 1, _MEMBER, gate="~pol & -"), P("id", r"(?i)\bid[ \t]*[:#]?[ \t]*:?[ \t]*([a-z]{1,3}\d{5,15})\b", 0.85, 1, _MEMBER, gate="~id & #00000"),
    ), "#0"),
    Detector("account", "ACCOUNT", (
        P("labelled", r"(?i)\b(?:account|acct|invoice|billing|claim)\.?[ \t]*(?:id|number|no\.?|#)[ \t]*[:#]?[ \t]*([a-z0-9-]{5,20})\b", 0.85, 1, _HAS_DIGIT, gate="~acc|invoice|billing|claim"),
        P("money", rf"(?i)\b(?:bank|checking|savings|guarantor|statement|loan)[ \t]+(?:account[ \t]+)?(?:id|{_NO})?[ \t]*[:#][ \t]*([a-z0-9-]{{5,20}})\b", 0.85, 1, _HAS_DIGIT, gate="~bank|checking|savings|guarantor|statement|loan"),
        P("routing", r"(?i)\b(?:routing|aba|sort code)[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*(\d{2}-\d{2}-\d{2}|\d{9})\b", 0.85, 1, gate="~routing|aba|sort code"),
        P("paper", rf"(?i)\b(?:reference|confirmation|order|transaction|authorization|prescription)[ \t]*(?:id|{_NO})[ \t]*[:#]?[ \t]*([a-z0-9-]{{5,20}})\b", 0.80, 1, _HAS_DIGIT, gate="~reference|confirmation|order|transaction|authorization|prescription"),
        P("plain", r"(?i)\b(?:account|acct|billing|bill)[ \t]*[:#]?[ \t]*(\d[\d-]{5,14})\b", 0.85, 1, f"{_DIGITS} BETWEEN 6 AND 15", gate="~account|acct|bill"), P("acc", r"(?i)\bacct?:[ \t]*\d{6,14}\b", 0.85, gate="~acc:|acct:"),
        P("bank_masked", r"(?i)\b(?:bank(?:ing)?|checking|savings)[ \t]+(?:account|acct)(?:[ \t]+(?:number|no|#))?[ \t]*[:#]?[ \t]*([*\d][-*\d]{3,15})\b", 0.85, 1, f"{_DIGITS} BETWEEN 4 AND 17", gate="~bank|checking|savings"),
        P("policy", r"(?i)\bpolicy(?:[ \t]+(?:number|no|#))?[ \t]*[:#]?[ \t]*([a-z]{2,4}-\d{4}-\d{4,8}|[a-z]{3,4}-\d{5,8}|\d{5}-\d{5,8})\b", 0.85, 1, gate="~policy"), P("partial", r"(?i)\b(?:account|card)[ \t]+(?:ending[ \t]+in|last[ \t]+4(?:[ \t]+digits)?)[: \t]+([*\d]{4,6})\b", 0.85, 1, gate="~account|card"),
        P("id_prefixed", r"(?i)\b(?:document|subscriber|member|patient)[ \t]+id[ \t:]+([a-z]{2,5}-\d{4,12}(?:-\d{4,12})?)\b", 0.85, 1, "v = upper(v)", gate="#A-0000"), P("coded", r"\b(?:ACCT|PID|MID|SID|REF|CONF|TXN|INV|ORD|BILL)-\d{6,12}\b", 0.85, gate="#A-000000"),
        P("yeared", r"(?i)\b(?:bill|acct|inv|pay)-(?:199\d|20\d{2}|2100)-\d{6,10}\b", 0.85, gate="~bill-|acct-|inv-|pay-"), P("group", r"(?i)\bgroup[ \t]+(?:number|no|#)[: \t]+([a-z]{3,5}-[a-z0-9]{4,12}(?:-\d{4})?)\b", 0.85, 1, "length(v) BETWEEN 8 AND 25", gate="~group"), P("transaction", r"\b[A-Z]{2,5}-[A-Z]{2,5}-\d{4,6}\b", 0.85, gate="#A-AA & #A-0000"),
    ), "#0"),
    Detector("license", "LICENSE", (
        P("driver", r"(?i)\b(?:dl|driver'?s? licen[sc]e)[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*([a-z]?\d[a-z0-9-]{4,14})\b", 0.88, 1, _HAS_DIGIT, gate="~dl|licen"),
        P("labelled", r"(?i)\blicen[sc]e[ \t]*(?:number|no\.?|#)[ \t]*[:#]?[ \t]*([a-z0-9-]{5,15})\b", 0.88, 1, _HAS_DIGIT, gate="~licen"),
        P("dea", r"(?i)\bDEA[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*([a-z]{2}\d{7})\b", 0.90, 1, gate="~dea"), P("npi", r"(?i)\bNPI[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*(\d{10})\b", 0.90, 1, gate="~npi"),
        P("clia", r"\b\d{2}D\d{7}\b", 0.85, gate="#00A0000000"), P("state", rf"\b{_STATE}[ \t]+DL[ \t]*[:#]?[ \t]*([A-Z]?\d{{5,12}})\b", 0.88, 1, gate="DL"),
    ), "#0"),
    Detector("passport", "PASSPORT", (
        P("labelled", r"(?i)\bpassport[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*([a-z]{0,2}\d{6,9})\b", 0.90, 1),
    ), "~passport", False),
    Detector("credit_card", "CREDIT_CARD", (
        P("groups", r"\b\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}\b", 0.95, 0, _CARD, gate="#0000-0000|0000 0000"), P("solid", r"\b\d{13,19}\b", 0.95, 0, _CARD, gate="#0000000000000"), P("amex", r"\b3[47]\d{2}[- ]\d{6}[- ]\d{5}\b", 0.95, gate="#0000-000000|0000 000000"),
        P("dots", r"\b\d{4}\.\d{4}\.\d{4}\.\d{4}\b", 0.95, 0, _CARD, gate="#0000.0000.0000.0000"), P("diners", r"\b3(?:0[0-5]|[68]\d)\d[- ]\d{6}[- ]\d{4}\b", 0.95, 0, _CARD, gate="#0000-000000|0000 000000"),
        P("ending", r"(?i)\bending[ \t]+in[ \t]+(\d{4})\b", 0.85, 1, gate="~ending"),
        P("labelled", r"(?i)\b(?:credit[ \t]*card|card|cc)[ \t]*[:#]?[ \t]*(\d[\d -]{11,21}\d)\b", 0.95, 1, _CARD, gate="~card|cc"), P("loose", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}\b", 0.95, 0, _CARD, gate="#00000000|0000-0000|0000 0000"), P("wide", r"\b\d{4}[ \t-]+\d{4}[ \t-]+\d{4}[ \t-]+\d{1,4}\b", 0.95, 0, _CARD),
        P("amex_fours", r"\b3[47]\d{2}[ -]?\d{4}[ -]?\d{4}[ -]?\d{3}\b", 0.95, gate="#00000000|0000-0000|0000 0000"), P("amex_wide", r"\b3[47]\d{2}[ \t]+\d{6}[ \t]+\d{5}\b", 0.95, gate="#000000"),
    ), "#0000", False),
    Detector("iban", "IBAN", (P("solid", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.90),), "#AA00"),
    Detector("bitcoin", "BITCOIN", (P("base58", r"\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b", 0.90, 0, _HAS_DIGIT),), "1|3"),
    Detector("date", "DATE", (
        P("us", rf"\b(?:0?[1-9]|1[0-2])[/-]{_DAY}[/-](?:19|20)?\d{{2}}\b", 0.95, gate="#0/0|0-0"), P("iso", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0.95, gate="#0000-00-00"),
        P("named", rf"(?i)\b{_MONTH}\.?[ \t]+\d{{1,2}}(?:st|nd|rd|th)?,?[ \t]+(?:19|20)\d{{2}}\b", 0.95, gate=f"{_MONTHS} & #0000"), P("day_first", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?[ \t]+{_MONTH}\.?,?[ \t]+(?:19|20)\d{{2}}\b", 0.95, gate=f"{_MONTHS} & #0000"),
        P("european", rf"\b{_DAY}\.(?:0?[1-9]|1[0-2])\.(?:19|20)\d{{2}}\b", 0.95, gate="#0.0"), P("slashed_iso", rf"\b{_YEAR}/(?:0?[1-9]|1[0-2])/{_DAY}\b", 0.95, gate="#0000/0"),
        P("stamp", rf"\b{_YEAR}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(?::\d{{2}})?Z?\b", 0.95, gate="#00T00|00A00"), P("compact", rf"\b{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\b", 0.85, gate="#00000000"),
        P("month_year", rf"(?i)\b{_MONTH}\.?,?[ \t]+(?:of[ \t]+)?{_YEAR}\b", 0.90, gate=f"{_MONTHS} & #0000"), P("numeric_month_year", rf"\b(?:0?[1-9]|1[0-2])[/-]{_YEAR}\b", 0.85, gate="#0/0000|0-0000"),
        P("no_year", rf"\b{_MONTH}\.?[ \t]+{_DAY}(?:st|nd|rd|th)?\b", 0.85, gate=f"{_MONTHS} & #0"), P("day_no_year", rf"\b{_DAY}(?:st|nd|rd|th)?[ \t]+(?:of[ \t]+)?{_MONTH}\b", 0.85, gate=f"{_MONTHS} & #0"),
        P("ordinal", rf"(?i)\bthe[ \t]+\d{{1,2}}(?:st|nd|rd|th)[ \t]+of[ \t]+{_MONTH}(?:,?[ \t]+{_YEAR})?\b", 0.92, gate="~st of|nd of|rd of|th of|\t"), P("dashed_month", rf"(?i)\b\d{{1,2}}-{_MONTH}-(?:19|20)?\d{{2}}\b", 0.95, gate="#0- & -"),
        P("military", r"\b\d{6}Z[ ]?[A-Z]{3}[ ]?\d{2,4}\b", 0.90, gate="#000000A"), P("quarter", rf"(?i)\bQ[1-4][ \t,]*(?:of[ \t]+)?{_YEAR}\b", 0.85, gate="~q1|q2|q3|q4"), P("fiscal", rf"(?i)\b(?:FY|fiscal[ \t]+year)[ \t]*'?(?:{_YEAR}|\d{{2}})\b", 0.85, gate="~fy|fiscal"),
        P("season", rf"(?i)\b(?:spring|summer|fall|autumn|winter)[ \t]+(?:of[ \t]+)?{_YEAR}\b", 0.85, gate="~spring|summer|fall|autumn|winter & #0000"), P("year_told", rf"(?i)\b(?:in|since|year)[ \t]+(?:early[ \t]+|late[ \t]+)?({_YEAR})\b", 0.85, 1, gate="~in|since|year & #0000"),
        P("decade", r"(?i)\b(?:early|mid|late)[ \t-]+(?:19|20)\d0s\b", 0.80, gate="#0000s"),
    ), "#0"),
    Detector("relative_date", "RELATIVE_DATE", (
        P("weekday", r"(?i)\b(?:last|next|this)[ \t]+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month|year)\b", 0.80, gate="~last|next|this"),
        P("ago", r"(?i)\b\d{1,3}[ \t]+(?:days?|weeks?|months?|years?)[ \t]+(?:ago|later|prior)\b", 0.80, gate="~ago|later|prior"), P("stay", r"(?i)\b(?:hospital|post-?op(?:erative)?)[ \t]+day[ \t]+#?\d{1,3}\b", 0.85, gate="~hospital|post"),
        P("admission", r"(?i)\bon[ \t]+(?:admission|discharge)\b", 0.75, gate="~admission|discharge"), P("gestation", r"(?i)\b\d{1,2}[ \t]+weeks?[ \t]+(?:gestation|pregnant)\b", 0.85, gate="~gestation|pregnant"),
        P("trimester", r"(?i)\b(?:first|second|third|1st|2nd|3rd)[ \t]+trimester\b", 0.80, gate="~trimester"), P("told", r"(?i)\b(?:yesterday|tomorrow)[ \t]+(?:morning|afternoon|evening|night)\b", 0.75, gate="~yesterday|tomorrow"),
    ), "", False),
    Detector("age_90_plus", "AGE", (
        P("years_old", r"(?i)\b(\d{2,3})[ \t-]+(?:years?[ \t-]+old|y/?o|years?[ \t]+of[ \t]+age)\b", 0.96, 1, "CAST(v AS INT) BETWEEN 90 AND 125", gate="~year|yo|y/o"),
        P("aged", r"(?i)\b(?:aged?|is)[ \t]*[:]?[ \t]*(\d{2,3})\b", 0.95, 1, "CAST(v AS INT) BETWEEN 90 AND 125", gate="~age|is"), P("decade", r"(?i)\bin[ \t]+(?:his|her|their)[ \t]+(?:early|mid|late)?[ \t]*(9\d)s\b", 0.92, 1, gate="#00s|00S|00A"),
        P("demographic", r"\b(9\d|1[01]\d)[ \t]?(?:M|F|yo)\b", 0.92, 1, gate="9|10|11"),
    ), "#00"),
    Detector("address", "ADDRESS", (
        P("po_box", r"(?i)\bP\.?[ \t]?O\.?[ \t]?Box[ \t]+\d+\b", 0.85, gate="~box"), P("street", rf"\b\d{{1,5}}[ \t]+(?:{_CAP}[ \t]+){{1,3}}{_STREET}\b", 0.85, gate="#0 A|0\tA|0  A|0 \t|0\t"),
        P("city_state_zip", rf"\b{_CAP}(?:[ \t]{_CAP})?,[ \t]+[A-Z]{{2}}[ \t]+\d{{5}}(?:-\d{{4}})?\b", 0.85, gate="#00000"), P("highway", r"(?i)\b(?:highway|route|interstate)[ \t]+\d{1,4}\b", 0.90, gate="~highway|route|interstate"),
        P("capitals", rf"\b\d{{1,5}}[ \t]+(?:{_UP}[ \t]+){{1,3}}(?:STREET|ST|AVENUE|AVE|ROAD|RD|BLVD|LANE|LN|DRIVE|DR)\b", 0.85, gate="#0 AA|0\tAA|0  A|0 \t|0\t"), P("rural", r"(?i)\bR\.?R\.?[ \t]*#?\d{1,3}[ \t]*,?[ \t]+box[ \t]+\d{1,5}\b", 0.85, gate="~box"),
        P("postcode_uk", r"\b[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}\b", 0.85, gate="#0 0AA|A 0AA"), P("postcode_ca", r"\b[A-Z]\d[A-Z][ -]\d[A-Z]\d\b", 0.85, gate="#A0A 0A0|A0A-0A0"),
    ), "#0"),
    Detector("address_context", "ADDRESS", (
        P("unit", r"(?i)\b(?:apt|apartment|suite|unit)\.?[ \t]+#?[a-z]?\d{1,5}\b", 0.80, gate="~apt|apartment|suite|unit"), P("intersection", rf"\b(?:corner|intersection)[ \t]+of[ \t]+{_CAP}[ \t]+and[ \t]+{_CAP}\b", 0.80, gate="corner|intersection"),
        P("lives_in", rf"\blives[ \t]+in[ \t]+({_CAP})\b", 0.75, 1, gate="lives"), P("county", rf"\b({_CAP}[ \t]+(?:County|Township))\b", 0.75, 1, gate="County|Township"), P("mile", r"(?i)\bmile[ \t]+(?:marker|post)[ \t]+\d{1,4}\b", 0.80, gate="~mile"),
    ), "", False),
    Detector("device", "DEVICE", (
        P("serial", r"(?i)\b(?:pacemaker|defibrillator|implant|pump|stent|catheter|monitor|device)[ \t]+(?:serial|id|s/n)[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*([a-z0-9-]{5,20})\b", 0.95, 1, _HAS_DIGIT, gate="~serial|s/n|id"),
        P("model", r"(?i)\bmodel[ \t]*(?:number|no\.?|#)[ \t]*[:#]?[ \t]*([a-z0-9-]{4,20})\b", 0.90, 1, _HAS_DIGIT, gate="~model"), P("bare_serial", r"(?i)\bserial[ \t]*(?:number|no\.?|#)[ \t]*[:#]?[ \t]*([a-z0-9-]{6,20})\b", 0.88, 1, _HAS_DIGIT, gate="~serial"),
        P("udi", r"\(01\)\d{14}(?:\(\d{2}\)[A-Z0-9]{1,20})*", 0.95, gate="(01)"), P("lot", r"(?i)\b(?:lot|ref)[ \t]*(?:number|no\.?|#)[ \t]*[:#]?[ \t]*([a-z0-9-]{4,20})\b", 0.85, 1, _HAS_DIGIT, gate="~lot|ref"),
    ), "#0"),
    Detector("vehicle", "VEHICLE", (
        P("vin_labelled", r"(?i)\bVIN[ \t]*[:#]?[ \t]*([A-HJ-NPR-Z0-9]{17})\b", 0.98, 1, gate="~vin"), P("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", 0.85, 0, f"{_DIGITS} BETWEEN 3 AND 14", gate="#AAA|AA0|A0A|A00|0AA|0A0|00A|000"),
        P("plate", r"(?i)\b(?:licen[sc]e[ \t]+)?plate[ \t]*(?:number|no\.?|#)?[ \t]*[:#]?[ \t]*([a-z0-9]{2,4}[- ]?[a-z0-9]{2,4})\b", 0.95, 1, _HAS_DIGIT, gate="~plate"), P("plate_seven", r"\b\d[A-Z]{3}\d{3}\b", 0.80, gate="#0AAA000"),
    )),
    Detector("biometric", "BIOMETRIC", (
        P("keyword", r"(?i)\b(?:fingerprint|retina(?:l)? scan|iris scan|voice ?print|facial recognition|palm print)[ \t]*(?:id|scan|record|sample)?[ \t]*[:#]?[ \t]*[a-z0-9-]*\d[a-z0-9-]*", 0.95, gate="~finger|retina|iris|voice|facial|palm"), P("genetic", r"(?i)\b(?:dna|genetic|genomic)[ \t]+(?:sample|test|profile|sequence)\b", 0.91, gate="~dna|geneti|genomi"),
        P("photo", r"(?i)\b(?:patient|facial|full[- ]face)[ \t]+photo(?:graph)?s?\b", 0.93, gate="~photo"), P("marks", r"(?i)\b(?:tattoo|birthmark|scar)[ \t]+(?:of|on|over)[ \t]+(?:the|his|her|their)?[ \t]*(?:left|right|upper|lower)?[ \t]*(?:arm|forearm|chest|back|neck|shoulder|leg|hand|wrist)\b", 0.90, gate="~tattoo|birthmark|scar"),
    )),
    Detector("name_last_first", "NAME", (
        P("caps", rf"\b({_UP}, {_UP})\b", 0.91, 1, gate="#A, AA"), P("mixed", rf"\b({_CAP}, {_CAP})\b", 0.93, 1),
    ), "#, A"),
    Detector("name_labelled", "NAME", (
        P("Labeled name field", rf"(?i:\b(?:patient(?: name)?|name|pt)[ \t]*:[ \t]*)({_CAP}(?:[ \t]+[A-Z]\.?)?[ \t]+{_CAP})\b", 0.92, 1), P("labelled caps", rf"(?i:\b(?:patient(?: name)?|name|pt)[ \t]*:[ \t]*)({_UP}(?:[ \t]+{_UP}){{1,2}})\b", 0.92, 1, _NOT_HEADING),
    ), ": & ~patient|name|pt"),
    Detector("name_family", "NAME", (
        P("relation", rf"(?i:\b(?:{_RELATIONS})[ \t]*[:,]?[ \t]+)({_CAP}[ \t]+{_CAP})\b", 0.90, 1, gate=f"~{_RELATIONS} & #r A|e A|d A|n A|: A|, A|  A|\t A|\tA"), P("maiden", rf"\b(?:nee|née)[ \t]+({_CAP})\b", 0.92, 1, gate="nee|née"),
        P("alias", rf"(?i:\b(?:aka|a\.k\.a\.|also known as)[ \t]+)({_CAP}(?:[ \t]+{_CAP})?)\b", 0.88, 1, gate="~aka|a.k.a|also known as"),
    )),
    Detector("name_shape", "NAME", (
        P("suffix", rf"\b({_CAP}[ \t]+{_CAP}[ \t]+(?:Jr|Sr|III|II|IV))\b", 0.92, 1, gate="Jr|Sr|II|IV"), P("possessive", rf"\b({_CAP}[ \t]+{_CAP})'s\b", 0.87, 1, gate="'s"), P("apostrophe", rf"\b((?:O'|Mc){_CAP})\b", 0.92, 1, gate="O'|Mc"),
        P("hyphenated", rf"\b({_CAP}[ \t]+{_CAP}-{_CAP})\b", 0.90, 1, gate="#-A"), P("particle", rf"\b({_CAP}[ \t]+(?:van|von|de|del|di|la)[ \t]+{_CAP})\b", 0.89, 1, gate="#van A|von A|de A|del A|di A|la A|  A|\t A|\tA"), P("initial", rf"\b([A-Z]\.[ \t]+{_CAP})\b", 0.85, 1, gate="#A. |A.\t"),
        P("age", rf"(?i:\b\d{{1,3}}[ \t-]+years?[ \t-]+old[ \t]+(?:man|woman|male|female)[ \t]+)({_CAP}[ \t]+{_CAP})\b", 0.91, 1, gate="~year & ~old"),
        P("accented", r"\b([A-Z][a-z]*[à-ÿ][a-zà-ÿ]*[ \t]+[A-Z][a-zà-ÿ]+)(?:[ \t,.;:]|$)", 0.88, 1, gate="à|á|â|ã|ä|å|æ|ç|è|é|ê|ë|ì|í|î|ï|ð|ñ|ò|ó|ô|õ|ö|÷|ø|ù|ú|û|ü|ý|þ|ÿ", by_line=True),
    )),
    Detector("name_context", "NAME", (
        P("single", rf"(?i:\b(?:pt|patient|client)[ \t]+)({_CAP})[ \t]+(?:is|was|has|had|reports|denies|states|presented)\b", 0.80, 1, gate="~pt|patient|client"), P("met", rf"(?i:\b(?:spoke with|accompanied by|signed by|cared for by|seen by|contact:?)[ \t]+)({_CAP}[ \t]+{_CAP})\b", 0.85, 1, gate="~ with| by|contact"),
        P("team", rf"(?i:\b(?:scrub|circulator|anesthesia|assistant)[ \t]*:[ \t]*)({_CAP}[ \t]+{_CAP})\b", 0.91, 1, gate="~scrub|circulator|anesthesia|assistant"), P("child", rf"\b({_CAP})[ \t]*\((?:age|aged)?[ \t]*\d{{1,2}}\)", 0.80, 1, gate="("),
    ), "", False),
    Detector("provider_name", "PROVIDER_NAME", (
        P("title", rf"\b(?:Dr|Prof|Nurse|Mr|Mrs|Ms)\.?[ \t]+{_CAP}(?:[ \t]+{_CAP})?\b", 0.92, 0, "true", 150, gate="Dr|Prof|Nurse|Mr|Ms"), P("credential", rf"\b{_CAP}[ \t]+{_CAP},[ \t]+(?:MD|DO|RN|NP|PA|PhD|DDS|PharmD)\b", 0.95, 0, "true", 150, gate="MD|DO|RN|NP|PA|PhD|DDS|PharmD"),
        P("role", rf"(?i:\b(?:attending|surgeon|physician|provider|referring)[ \t]*:[ \t]*)({_CAP}[ \t]+{_CAP})\b", 0.92, 1, "true", 150, gate="~attending|surgeon|physician|provider|referring"),
    )),
    Detector("multiline_patient", "NAME", (P("patient line", rf"(?i:\bpatient[ \t]*:[ \t]*)\n[ \t]*({_UP}(?:[ \t]+{_UP}){{1,2}})\b", 0.92, 1, _NOT_HEADING, 100),), "~patient"),
    Detector("multiline_file", "MRN", (P("file line", r"(?i:\bfile[ \t]*#[ \t]*:?[ \t]*)\n[ \t]*(\d{4,12})\b", 0.92, 1, "true", 100),), "~file"),
    Detector("gps", "CUSTOM", (P("pair", r"-?\d{1,2}\.\d{4,},[ ]?-?\d{1,3}\.\d{4,}", 0.90),), "#0.0000", False),
    Detector("unique_id", "CUSTOM", (P("uuid", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", 0.95),), "-", False),
)
BY_NAME = {d.name: d for d in DETECTORS}
DEFAULTS = tuple(d for d in DETECTORS if d.default)
