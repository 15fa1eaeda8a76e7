"""The recognizers: name, entity type, score, pattern. Users may register their own."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Recognizer:
    name: str
    entity_type: str
    score: float
    pattern: str
    check: str | None = None  # luhn or mod97: what the digits of a match must satisfy
    needs: str | None = None  # a cheaper pattern that any text with a match fits; None: every text is scanned


# The patterns and scores that results depend on.
_STREET = r"(?:Road|Street|Avenue|Ave|Drive|Lane|Place|Crescent|Close|Walk|Terrace|Quay|Way|Boulevard|Blvd|Rd|St|Dr|Ln|Pl|Court|Ct|Circle|Cir|Parkway|Pkwy|Loop|Row|Alley)"
RECOGNIZERS = [
    Recognizer("dashed_account", "ACCOUNT_NUMBER", 0.85, r"\b\d{3,6}-\d{4,8}(?:-\d{1,4})?\b"),
    Recognizer("prefix_account", "ACCOUNT_NUMBER", 0.75, r"\b[A-Z]{2,4}\d{5,12}\b"),
    Recognizer("letter_digits_letter", "ACCOUNT_NUMBER", 0.70, r"\b[A-Z]\d{4,8}[A-Z]\b"),
    Recognizer("plain_account", "ACCOUNT_NUMBER", 0.60, r"\b\d{8,12}\b"),
    Recognizer("isin", "ISIN", 0.95, r"\b[A-Z]{2}[A-Z0-9]{9}\d\b"),
    Recognizer("sg_nric", "SG_NRIC", 0.85, r"\b[STFGMstfgm]\d{7}[A-Za-z]\b"),
    Recognizer("sg_uen", "SG_UEN", 0.80, r"\b(?:\d{8,10}[A-Z]|T\d{2}[A-Z]{2}\d{4}[A-Z])\b"),
    Recognizer("sg_mobile", "SG_PHONE", 0.80, r"(?:\+?65[-\s]?)?[89]\d{3}[-\s]?\d{4}\b"),
    Recognizer("sg_landline", "SG_PHONE", 0.70, r"(?:\+?65[-\s]?)?6\d{3}[-\s]?\d{4}\b"),
    Recognizer("us_tollfree", "PHONE_NUMBER", 0.90, r"(?:\+?1[\s\-.]?)?(?:\(?(?:800|888|877|866|855|844|833|822)\)?[\s\-.]?\d{3}[\s\-.]?\d{4})\b"),
    Recognizer("us_phone", "PHONE_NUMBER", 0.90, r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]\d{3}[\s\-.]\d{4}\b"),
    Recognizer("sg_address", "ADDRESS", 0.85, rf"\b\d+[A-Z]?\s+(?:[A-Za-z]+\s+){{1,6}}{_STREET}(?:\s*[,\n]?\s*#\d{{1,3}}-\d{{1,4}}\w?)?(?:\s*[,\n]?\s*Singapore)?\s*[,\n]?\s*\d{{6}}\b"),
    Recognizer("sg_block_address", "ADDRESS", 0.85, r"\bBlk\s+\d+[A-Z]?\s+(?:[A-Za-z0-9]+\s+){1,6}(?:#\d{1,3}-\d{1,4}\w?\s+)?(?:Singapore\s+)?\d{6}\b"),
    Recognizer("us_address", "ADDRESS", 0.85, rf"\b\d+\s+(?:[A-Za-z0-9]+\s+){{1,6}}{_STREET}(?:\s+(?:NE|NW|SE|SW|N|S|E|W))?[.,]?\s+(?:[A-Za-z]+\s*){{1,4}},\s*[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?\b"),
    Recognizer("po_box", "ADDRESS", 0.75, r"\bP\.?\s?O\.?\s*Box\s+\d+(?:\s*,?\s*[A-Za-z]+){0,3}(?:\s*,?\s*[A-Z]{2})?\s*\d{5,6}\b"),
    Recognizer("sg_postal_anchor", "ADDRESS", 0.40, r"\bSingapore\s+\d{6}\b"),
    Recognizer("us_zip_anchor", "ADDRESS", 0.35, r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
    Recognizer("us_state_zip4", "ADDRESS", 0.90, r"\b[A-Z]{2}\s+\d{5}-\d{4}\b"),
]

# Built-in types, defined here: e-mail by form, cards by Luhn's sum, IBANs by remainder 97.
BUILT_IN = [
    Recognizer("email", "EMAIL_ADDRESS", 1.0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    Recognizer("credit_card", "CREDIT_CARD", 1.0, r"\b\d(?:[ -]?\d){12,18}\b", "luhn"),
    Recognizer("iban", "IBAN_CODE", 1.0, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "mod97"),
]

# What a match of each pattern can't do without; all other texts are left out before the pattern itself runs.
NEEDS = {
    "dashed_account": r"\d{3}-\d{4}", "prefix_account": r"[A-Z]{2}\d{5}", "letter_digits_letter": r"[A-Z]\d{4}", "plain_account": r"\d{8}", "isin": r"[A-Z]{2}[A-Z0-9]{9}\d",
    "sg_nric": r"\d{7}[A-Za-z]", "sg_uen": r"\d{8}[A-Z]|T\d{2}[A-Z]{2}\d{4}[A-Z]", "sg_mobile": r"[89]\d{3}[-\s]?\d{4}", "sg_landline": r"6\d{3}[-\s]?\d{4}",
    "us_tollfree": r"8\d{2}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}", "us_phone": r"\d{3}[\s\-.]\d{4}", "sg_address": r"\d{6}", "sg_block_address": r"Blk\s", "us_address": r"[A-Z]{2}\s+\d{5}",
    "po_box": r"Box\s+\d", "sg_postal_anchor": r"Singapore\s", "us_zip_anchor": r"[A-Z]{2}\s+\d{5}", "us_state_zip4": r"\d{5}-\d{4}", "email": "@", "credit_card": r"\d(?:[ -]?\d){12}", "iban": r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}",
}
RECOGNIZERS = [replace(r, needs=NEEDS[r.name]) for r in RECOGNIZERS]
BUILT_IN = [replace(r, needs=NEEDS[r.name]) for r in BUILT_IN]

THRESHOLD = 0.50
ALL = RECOGNIZERS + BUILT_IN
_REGISTERED: dict[str, Recognizer] = {r.name: r for r in ALL}


def register_recognizer(name: str, entity_type: str, pattern: str, score: float, check: str | None = None, needs: str | None = None) -> Recognizer:
    """Adds a recognizer to those that registered() gives. Without `needs` it scans every text."""
    _REGISTERED[name] = found = Recognizer(name, entity_type, score, pattern, check, needs)
    return found


def registered() -> list[Recognizer]:
    return list(_REGISTERED.values())


def recognizer(name: str) -> Recognizer:
    return _REGISTERED[name]
