"""Normalizers for names, e-mails, companies and phones, as plain column expressions."""

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesloom.config import COMPANY_SUFFIXES, GMAIL_DOMAINS, NICKNAMES
from salesloom.functions.lookup import literal_map, look_up

SPACE_RUN = r"[\s\x1c-\x1f]+"
NON_ASCII = r"[^\x00-\x7F]"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank(text: Column) -> Column:
    """Missing text: NULL, empty or blanks only."""
    return text.isNull() | (F.trim(text) == "")


@lru_cache(maxsize=1)
def _compatibility_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form has ASCII letters: one-to-one pairs and expansions."""
    sources, targets, expansions = [], [], {}
    for point in range(0x80, 0x20000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(plain) == 1:
            sources.append(char)
            targets.append(plain)
        elif plain:
            expansions[char] = plain
    return "".join(sources), "".join(targets), expansions


def _to_ascii(text: Column) -> Column:
    sources, targets, expansions = _compatibility_tables()
    singles = F.translate(text, sources, targets)
    pieces = F.transform(F.split(singles, ""), lambda c: F.coalesce(F.try_element_at(literal_map(expansions), c), c))
    widened = F.when(singles.rlike(NON_ASCII), F.array_join(pieces, "")).otherwise(singles)
    return F.regexp_replace(widened, NON_ASCII, "")


def fold(text: Column) -> Column:
    """Lower case without accents, white space collapsed; NULL becomes ''."""
    plain = F.when(text.rlike(NON_ASCII), _to_ascii(text)).otherwise(text)
    spaced = F.regexp_replace(F.lower(plain), SPACE_RUN, " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def canonical_first(name: Column) -> Column:
    """The formal name behind a nickname; other names stay as they are."""
    return F.coalesce(look_up(NICKNAMES, name), name)


def normalize_email(email: Column) -> Column:
    """Lower-case address with the mailbox rules of Gmail applied; blank becomes NULL."""
    clean = F.lower(strip(email))
    local = F.substring_index(clean, "@", 1)
    at = F.locate("@", clean)
    domain = F.when(at > 0, F.substring(clean, at + 1, F.length(clean))).otherwise(F.lit(""))
    gmail_local = F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit(""))
    address = F.when(domain.isin(*GMAIL_DOMAINS), F.concat(gmail_local, F.lit("@gmail.com"))).otherwise(
        F.concat(local, F.lit("@"), domain))
    return F.when(clean != "", address)


def email_local_key(email: Column) -> Column:
    """Local part of a normalized address with a nickname in front spelled out: bob.smith -> robert.smith."""
    tokens = F.split(fold(F.substring_index(email, "@", 1)), r"[._-]+")
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.array_join(F.concat(F.array(canonical_first(F.get(tokens, F.lit(0)))), rest), ".")


def normalize_company(name: Column) -> Column:
    """Company name without accents, punctuation and trailing legal forms."""
    words = F.regexp_replace(F.replace(fold(name), F.lit("."), F.lit("")), "[^a-z0-9 ]", " ")
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(words, " +", " ")))
    return F.trim(F.regexp_replace(padded, f"( ({'|'.join(COMPANY_SUFFIXES)}))+$", ""))


def normalize_phone(phone: Column) -> Column:
    """Last ten digits, NULL when there are fewer than seven."""
    digits = F.regexp_replace(phone, r"(?U)\D", "")
    return F.when(F.length(digits) >= 7, F.substring(digits, -10, 10))


def code_key(text: Column) -> Column:
    """Only letters and digits in lower case, the key of the import code maps."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def normalize_question(question: Column) -> Column:
    """Case, white space, quotes and closing punctuation do not change a question."""
    singles, targets, expansions = _width_tables()
    widened = F.translate(question, singles, targets)
    pieces = F.transform(F.split(widened, ""), lambda c: F.coalesce(F.try_element_at(literal_map(expansions), c), c))
    plain = F.when(question.rlike(NON_ASCII), F.array_join(pieces, "")).otherwise(question)
    unquoted = F.regexp_replace(strip(F.lower(plain)), "^[\"']+|[\"']+$", "")
    spaced = F.regexp_replace(unquoted, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.regexp_replace(spaced, r"(?U)[\s?.!]+$", "")


@lru_cache(maxsize=1)
def _width_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility characters and their composed form, for NFKC on single characters."""
    sources, targets, expansions = [], [], {}
    for point in range(0x80, 0x20000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        composed = unicodedata.normalize("NFKC", char)
        if composed == char:
            continue
        if len(composed) == 1:
            sources.append(char)
            targets.append(composed)
        else:
            expansions[char] = composed
    return "".join(sources), "".join(targets), expansions


def plural(noun: Column, n: Column) -> Column:
    many = F.when(noun.endswith("y"), F.concat(F.substring(noun, 1, F.length(noun) - 1), F.lit("ies"))).otherwise(
        F.concat(noun, F.lit("s")))
    return F.when(n == 1, noun).otherwise(many)
