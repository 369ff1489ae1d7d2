"""Value parsers of the CSV import; a value that does not parse becomes NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesloom.config import DATE_FORMATS, TITLE_LEVELS
from salesloom.functions.text import strip


SHAPES = (("yyyy", r"\d{4}"), ("M", r"\d{1,2}"), ("d", r"\d{1,2}"), ("H", r"\d{1,2}"), ("h", r"\d{1,2}"), ("m", r"\d{1,2}"),
          ("s", r"\d{1,2}"), ("a", "[AaPp][Mm]"))


def _shape(fmt: str) -> str:
    """The look of a date format as a pattern: letters become digit runs, everything else stands for itself."""
    out, rest = "", fmt.replace("'", "")
    while rest:
        for letters, pattern in SHAPES:
            if rest.startswith(letters):
                out, rest = out + pattern, rest[len(letters):]
                break
        else:
            out, rest = out + rest[0], rest[1:]
    return f"^{out}$"


def parse_date(value: Column) -> Column:
    """The accepted date format that fits, as a timestamp without zone.

    No two formats look alike, so the look picks the one to parse; a failed parse costs an exception.
    """
    clean = F.regexp_replace(strip(value), r"\s+", " ")
    out = None
    for fmt in DATE_FORMATS:
        parsed = F.try_to_timestamp(clean, F.lit(fmt)).cast("timestamp_ntz")
        fits = clean.rlike(_shape(fmt))
        out = F.when(fits, parsed) if out is None else out.when(fits, parsed)
    return out


def parse_number(value: Column) -> Column:
    """Amount without currency signs; a band like 51-200 gives its middle, a trailing + is dropped."""
    clean = F.regexp_replace(value, r"(?U)[,$€£₹\s]", "")
    low = F.regexp_extract(clean, r"^(\d+)-(\d+)$", 1)
    high = F.regexp_extract(clean, r"^(\d+)-(\d+)$", 2)
    middle = (low.try_cast("double") + high.try_cast("double")) / F.lit(2)
    plain = F.regexp_replace(clean, r"\++$", "")
    accepted = plain.rlike(r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$")
    single = F.when(accepted, F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(clean.rlike(r"^\d+-\d+$"), middle).otherwise(single)


def seniority_from_title(title: Column) -> Column:
    lowered = F.lower(title)
    out = None
    for pattern, level in TITLE_LEVELS:
        out = F.when(lowered.rlike(pattern), level) if out is None else out.when(lowered.rlike(pattern), level)
    return out.otherwise("individual")


def clean_domain(url: Column) -> Column:
    """Host of a web address without scheme, www and outer slashes; blank becomes NULL."""
    bare = F.regexp_replace(F.lower(url), r"^(https?://)?(www\.)?", "")
    host = F.regexp_replace(bare, "^/+|/+$", "")
    return F.when(host != "", host)
