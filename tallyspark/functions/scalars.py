"""Scalar functions over ``Column``: money text, currencies, dates, tags, labels.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.schema import AMOUNT_TYPE

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as listed for results to agree).
# ---------------------------------------------------------------------------

# Ellipsis marker used when shortening text.
ELLIPSIS = "..."

# Tag validity: a word character, then word characters, dots or dashes.
TAG_PATTERN = r"^\w[\w.-]*$"

# Currency symbols as printed for the US locale; any other ISO code is its
# own symbol.
CURRENCY_SYMBOLS = {
    "$": "USD",
    "€": "EUR",
    "£": "GBP",
    "¥": "JPY",
    "₹": "INR",
    "₩": "KRW",
    "₪": "ILS",
    "₫": "VND",
    "A$": "AUD",
    "CA$": "CAD",
    "CN¥": "CNY",
    "EC$": "XCD",
    "HK$": "HKD",
    "MX$": "MXN",
    "NT$": "TWD",
    "NZ$": "NZD",
    "R$": "BRL",
    "FCFA": "XAF",
    "F CFA": "XOF",
    "CFPF": "XPF",
}

# ISO 4217 currency codes.
ISO_CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND "
    "BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU "
    "CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS "
    "GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY "
    "KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA "
    "MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD "
    "OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK "
    "SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD "
    "TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU "
    "XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWL"
).split()

# Date layouts of the inputs (Spark datetime patterns).
DATE_FORMATS = {
    "ledger": "yyyy/MM/dd",
    "iso": "yyyy-MM-dd",
    "us": "MM/dd/yyyy",
    "us_short": "MM/dd/yy",
    "period": "dd/MM/yy",
    "statement_period": "MM-dd-yy",
    "month_name": "MMM dd yyyy",
}

# Money text: optional minus, symbol (anything but digits, dot, minus and
# parentheses), optional minus, then digits with thousands commas or a bare
# fraction.
MONEY_PATTERN = r"^\s*(-?)([^0-9.()-]*?)\s*(-?)([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)\s*$"

# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_sign_symbol_number(text) -> tuple[Column, Column, Column]:
    t = _c(text)
    neg = (F.regexp_extract(t, MONEY_PATTERN, 1) == "-") | (
        F.regexp_extract(t, MONEY_PATTERN, 3) == "-")
    symbol = F.regexp_extract(t, MONEY_PATTERN, 2)
    number = F.regexp_replace(F.regexp_extract(t, MONEY_PATTERN, 4), ",", "")
    return neg, symbol, number


def parse_money(text, scale_type: T.DecimalType = AMOUNT_TYPE) -> Column:
    """Money text to decimal; null (reject) when the text is not money or has more digits than the type."""
    t = _c(text)
    neg, _, number = money_sign_symbol_number(t)
    number = F.when(t.rlike(MONEY_PATTERN), number)
    digits = F.length(F.regexp_extract(number, r"\.([0-9]*?)0*$", 1))
    value = F.when(digits <= scale_type.scale, number.try_cast(scale_type))
    return F.when(neg, -value).otherwise(value)


def money_symbol(text) -> Column:
    t = _c(text)
    _, symbol, _ = money_sign_symbol_number(t)
    return F.when(t.rlike(MONEY_PATTERN), symbol)


def currency_from_symbol(symbol) -> Column:
    """Symbol (or ISO code) to ISO code; unknown gives null."""
    s = _c(symbol)
    mapping = F.create_map(*[F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv])
    return F.coalesce(F.element_at(mapping, s),
                      F.when(s.isin(*ISO_CURRENCIES), s))


def is_currency_code(code) -> Column:
    return F.coalesce(_c(code).isin(*ISO_CURRENCIES), F.lit(False))


def parse_date(text, fmt: str) -> Column:
    """Text to date with one fixed layout (name from ``DATE_FORMATS`` or a
    Spark pattern); null on failure.  Month names match in any case."""
    pattern = DATE_FORMATS.get(fmt, fmt)
    t = F.trim(_c(text))
    if "MMM" in pattern:
        t = F.initcap(F.lower(t))
    return F.try_to_date(t, pattern)


def format_date(col, fmt: str = "ledger") -> Column:
    return F.date_format(_c(col), DATE_FORMATS.get(fmt, fmt))


def parse_period_date(text: str) -> _dt.date:
    """Driver-side parse of a rule's ``dd/MM/yy`` bound (two-digit years are 20yy)."""
    return _dt.datetime.strptime(text, "%d/%m/%y").date()


def month_day_in_period(month: Column, day: Column, begin: Column, end: Column) -> Column:
    """Year inference for a month-day inside a statement period.

    The begin year is tried first; a date before the period start takes the
    end year.  Returns a struct ``(date, out_of_period)``.
    """
    def on_year(y):
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day),
                             "yyyy-MM-dd")

    first = on_year(F.year(begin))
    chosen = F.when(first >= begin, first).otherwise(on_year(F.year(end)))
    out = (chosen.isNull() | (chosen > end) | (chosen < begin))
    return F.struct(chosen.alias("date"), out.alias("out_of_period"))



def tags_from_text(text) -> Column:
    t = F.trim(_c(text))
    arr = F.split(t, r"\s+")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(arr)))


def tags_to_text(tags) -> Column:
    return F.array_join(F.array_sort(_c(tags)), " ")


def valid_tags(tags) -> Column:
    """All tags match the tag pattern (null or empty set is valid)."""
    return F.coalesce(F.forall(_c(tags), lambda t: t.rlike(TAG_PATTERN)), F.lit(True))


def check_tag_literal(tag: str) -> str:
    import re
    if not isinstance(tag, str) or not re.match(r"^\w[\w.-]*$", tag):
        raise ValueError(f"Invalid tag value [{tag}]")
    return tag



def fold_ws(text) -> Column:
    return F.regexp_replace(F.trim(_c(text)), r"\s+", " ")


def _check_len(n: int) -> None:
    if n < len(ELLIPSIS):
        raise ValueError(f"maximum length {n} is shorter than the ellipsis")


def ellipsis(text, n: int, mode: str = "append") -> Column:
    """Cut text longer than ``n`` to ``n`` characters including the marker.

    ``append`` keeps the head; ``prepend`` keeps the tail behind the marker.
    """
    _check_len(n)
    t = _c(text)
    keep = n - len(ELLIPSIS)
    if mode == "append":
        short = F.concat(F.substring(t, 1, keep), F.lit(ELLIPSIS))
    elif mode == "prepend":
        short = F.concat(F.lit(ELLIPSIS), F.right(t, F.lit(keep)))
    else:
        raise ValueError(mode)
    return F.when(F.length(t) > n, short).otherwise(t)


def path_ellipsis(path, n: int) -> Column:
    """Shorten a path: keep the file name, shorten the folder part.

    A file name longer than ``n`` keeps its tail behind the marker; when no
    room is left for a shortened folder the bare file name is returned.
    """
    _check_len(n)
    p = _c(path)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    room = F.lit(n) - F.length(name) - F.lit(1)
    head = F.when(F.length(folder) > room,
                  F.concat(F.substring(folder, F.lit(1), room - F.lit(len(ELLIPSIS))),
                           F.lit(ELLIPSIS))).otherwise(folder)
    return (F.when(p.isNull(), F.lit(None))
            .when(F.length(p) <= n, p)
            .when(F.length(name) > n, ellipsis(name, n, "prepend"))
            .when(room < F.lit(len(ELLIPSIS)), name)
            .otherwise(F.concat(head, F.lit("/"), name)))


def plain_decimal(amount) -> Column:
    """Decimal as plain text, trailing fraction zeros removed (``1.50`` -> ``1.5``)."""
    s = _c(amount).cast("string")
    s = F.when(s.contains("."), F.regexp_replace(s, r"0+$", "")).otherwise(s)
    return F.regexp_replace(s, r"\.$", "")


def record_label(prefix: str = "") -> Column:
    """One-line text of a ledger row, fields joined by ``|``, nulls skipped."""
    c = lambda n: F.col(prefix + n)
    td, pdt = c("transaction_date"), c("posting_date")
    dates = F.when(td == pdt, td.cast("string")).otherwise(
        F.concat_ws("|", td.cast("string"), pdt.cast("string")))
    tags = F.when(c("tags").isNotNull(),
                  F.concat(F.lit("["), F.array_join(c("tags"), ", "), F.lit("]")))
    source = F.when(c("source_id").isNotNull() | c("system_id").isNotNull(),
                    F.concat_ws("|", F.coalesce(c("source_id"), F.lit("null")),
                                path_ellipsis(c("system_id"), 40)))
    return F.concat_ws(
        "|", dates, plain_decimal(c("amount")), ellipsis(c("description"), 40),
        ellipsis(c("category"), 20), tags, c("currency"), ellipsis(c("id"), 10), source)


def global_id(system_id="system_id", id_="id") -> Column:
    return F.format_string("%s-%s", _c(system_id), _c(id_))


def title_with_quantity(title, quantity) -> Column:
    q = _c(quantity)
    return F.when(q > 1, F.format_string("%s (%d)", _c(title), q.cast("int"))).otherwise(_c(title))
