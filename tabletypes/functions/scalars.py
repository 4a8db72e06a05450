"""Column expressions on headers, cells, titles and token lists. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the storage-type vote.
BOOLEAN_WORDS = ["yes", "y", "true", "t", "0", "no", "n", "false", "f", "1"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
STORAGE_WEIGHTS = {"string": 1, "boolean": 7, "integer": 6, "decimal": 4, "time": 6, "date": 6, "month": 7, "year": 7}
GENERAL_TYPES = {
    "id": "c", "string": "c", "boolean": "c", "percentage": "q", "currency": "q", "integer": "q",
    "decimal": "q", "time": "t", "date": "t", "month": "t", "year": "t",
}
NUMBER_DECORATION = ",%$€\"'"
DATE_PREFIX = r"^\d{1,4}[-/]\S+[-/]\S+"
INTEGER_FORM = r"^(0|-?[1-9]\d*)$"
TOKEN_PUNCTUATION = "'.:,/()-+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(_col(c).cast("double"), digits) + F.lit(0.0)


def canonical_header(header, longest: int = 30) -> Column:
    """Camel-case form of a header: ``File Size (kB)`` becomes ``fileSize``; long or empty gives ``-``."""
    h = _col(header)
    bare = F.regexp_replace(h, r"\([^)]*\)", "")
    spaced = F.regexp_replace(bare, r"([A-Z][a-z])", " $1")
    words = F.filter(F.split(F.lower(spaced), r"(?U)\W"), lambda w: w != "")
    camel = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    return F.when(F.length(h) > longest, F.lit("-")).when(F.size(words) == 0, F.lit("-")).otherwise(camel)


def undecorated(value) -> Column:
    """The cell without thousands separators, percent and currency signs and quotes."""
    return F.translate(_col(value), NUMBER_DECORATION, "")


def is_date(value) -> Column:
    v = _col(value)
    return (F.length(v) != 1) & v.rlike(DATE_PREFIX)


def parse_date(value) -> Column:
    """Timestamp of a cell in day-first, then month-first order, with one separator of ``- . / blank``.

    Years may lead (``1999-12-31``) or trail with two or four digits; months may be names; a clock time
    may follow after a blank, a ``T`` or nothing: hours, minutes and seconds, or hours and minutes with a zone.
    Zones are UTC, GMT, Z or an offset, by which the time is moved to UTC.
    """
    v = F.trim(_col(value))
    form = r"^(\w+)([-./ ])(\w+)\2(\d{1,4}?)(?:[T ]?(\d{2}:\d{2}(?::\d{2}|(?=[A-Za-z+-])))((?i:UTC|GMT|Z)|([+-])(\d{2}):?(\d{2}))?)?$"
    a, b, c, clock, sign, hours, minutes = (F.regexp_extract(v, form, i) for i in (1, 3, 4, 5, 7, 8, 9))
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    ahead = F.when(sign != "", F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 60 + minutes.try_cast("int"))).otherwise(0)
    year = F.when(F.length(c) == 4, c).when(
        F.length(c) == 2, F.concat(F.when(c >= "69", F.lit("19")).otherwise(F.lit("20")), c)
    )
    names = F.array(*[F.lit(m[:3].lower()) for m in MONTH_NAMES])

    def month(part):
        named = F.array_position(names, F.lower(F.substring(part, 1, 3)))
        return F.when(named > 0, named.cast("string")).otherwise(part)

    def stamp(y, m, d):
        text = F.concat(y, F.lit("-"), m, F.lit("-"), d, F.lit(" "), F.when(clock == "", F.lit("00:00:00")).otherwise(clock))
        return F.try_to_timestamp(text, F.lit("yyyy-M-d HH:mm:ss"))

    year_first = F.when(F.length(a) == 4, stamp(a, b, c))
    local = F.coalesce(year_first, stamp(year, month(b), a), stamp(year, month(a), b))
    return local - F.make_dt_interval(mins=ahead)


def storage_votes(value) -> dict[str, Column]:
    """Whether the (undecorated) cell votes for each storage type. Cells are text, so none is a clock object."""
    v = undecorated(value)
    months = [m for name in MONTH_NAMES for m in (name, name.lower(), name[:3], name[:3].lower())]
    return {
        "string": F.lit(True),
        "boolean": F.lower(F.trim(v)).isin(BOOLEAN_WORDS),
        "integer": v.rlike(INTEGER_FORM),
        "decimal": v.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"),
        "time": F.lit(False),
        "date": is_date(v),
        "month": v.isin(months),
        "year": (F.length(v) >= 4) & F.substring(v, 1, 2).isin("18", "19", "20", "21"),
    }


def storage_from_header(header) -> Column:
    """Storage type that the end of the header gives away, else NULL."""
    h = _col(header)
    out = None
    for name, endings in (
        ("date", ["date", "Date", "DATE"]),
        ("month", ["month", "Month", "MONTH"]),
        ("year", ["year", "Year", "YEAR"]),
        ("id", ["id", "ID", "Id", "name"]),
    ):
        hit = h.rlike("(" + "|".join(endings) + ")$")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def general_type(storage) -> Column:
    """``c`` categorical, ``q`` quantitative or ``t`` temporal."""
    pairs = [F.lit(x) for kv in GENERAL_TYPES.items() for x in kv]
    return F.create_map(*pairs)[_col(storage)]


def in_dictionary(value, words: list[str]) -> Column:
    return F.lower(_col(value)).isin([w.lower() for w in words])


def prefix_pattern(regex: str) -> str:
    """A pattern that matches from the start of the cell, whatever the case."""
    return f"(?i)^(?:{regex})"


def regex_hits(value, patterns: list[str]) -> Column:
    """How many of the patterns the cell matches."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(_col(value).rlike(prefix_pattern(p)).cast("int"), F.lit(0))
    return total


CELL_CLASSES = {
    "num": "[0-9]",
    "text": "[a-zA-Z]",
    "spec": '[!@#$%^&*(),.?":{}|<>]',
    "space": '[" ]',
}


def char_class_counts(value) -> dict[str, Column]:
    return {k: F.regexp_count(_col(value), F.lit(p)).cast("long") for k, p in CELL_CLASSES.items()}


def clean_tokens(text, stop: list[str]) -> Column:
    """Lower-case blank-separated tokens without punctuation and stop words, in order, repeats kept."""
    spaced = F.translate(F.lower(_col(text)), TOKEN_PUNCTUATION, " " * len(TOKEN_PUNCTUATION))
    keep = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(F.split(spaced, r"\s+"), lambda t: (t != "") & ~F.array_contains(keep, t))


def marked_tokens(text, longest: int, stop: list[str]) -> Column:
    """A cell of at most ``longest`` characters stays one token; a longer one is split and tagged ``longstr``."""
    t = _col(text)
    long = clean_tokens(t, stop)
    if longest > 0:
        long = F.concat(long, F.array(F.lit("longstr")))
    return F.when(F.length(t) > longest, long).otherwise(F.array(F.lower(t)))


def number_token(value, as_type: bool = True) -> Column:
    """Numbers become the token ``float64`` (or keep their text); other cells stay as they are."""
    v = _col(value)
    if not as_type:
        return v
    return F.when(v.try_cast("double").isNotNull(), F.lit("float64")).otherwise(v)


def column_id(table, col_idx) -> Column:
    return F.concat(_col(table), F.lit("+column_"), _col(col_idx).cast("string"))


def parse_column_id(dataset_id) -> tuple[Column, Column]:
    """(table, column number) of ``<table>+column_<n>``; the table name may hold a plus sign."""
    d = _col(dataset_id)
    return (
        F.regexp_extract(d, r"^(.*)\+column_(\d+)$", 1),
        F.regexp_extract(d, r"^(.*)\+column_(\d+)$", 2).try_cast("int"),
    )


def short_type(semantic_type) -> Column:
    """Last part of a dotted type name."""
    return F.element_at(F.split(_col(semantic_type), r"\."), -1)


def parse_list(text, element: str = "int") -> Column:
    """A Python or JSON list literal as an array, read as data and never evaluated."""
    return F.from_json(F.translate(_col(text), "'()", '"[]'), f"array<{element}>")


def clean_title(uri) -> Column:
    """Page title behind a resource address: decoded, prefix dropped, blanks for underscores."""
    u = F.regexp_replace(_col(uri), r"^<|>$", "")
    tail = F.regexp_replace(u, r"^https?://[^/]+/(resource|wiki|page)/", "")
    return F.replace(F.replace(F.url_decode(tail), F.lit("&nbsp;"), F.lit(" ")), F.lit("_"), F.lit(" "))


def strip_nonword(surface) -> Column:
    """Drop one leading and one trailing non-word character."""
    return F.regexp_replace(F.regexp_replace(_col(surface), r"^\W", ""), r"\W$", "")


def name_digest(name, n: int = 10) -> Column:
    """Hex of the first ``n`` bytes of the SHA-1 of a name."""
    return F.substring(F.sha1(_col(name)), 1, 2 * n)


def seeded_order(seed, *cols) -> Column:
    """Key of a pseudo-random order that is the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)) if not isinstance(seed, Column) else seed, *[_col(c).cast("string") for c in cols]))
