"""Whether a value that a pattern found is what it looks like, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of values.
EMAIL = r"\b[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b"
PHONE = r"(?<![\w@])(?:\+994|0|\+\d{1,3})[\s().-]?\d{2,3}[\s().-]?\d{3}[\s().-]?\d{2}[\s().-]?\d{2}(?![\w@])"
USERNAME = r"@?[A-Za-z0-9][A-Za-z0-9._-]{1,78}[A-Za-z0-9]"
# What stands where a value should be, and words of addresses and relations.
TECHNICAL = ("admin", "administrator", "test", "system", "root", "null", "none", "unknown", "user", "username")
PLACEHOLDERS = (*TECHNICAL, "demo", "sample", "n/a", "na", "other", "not applicable")
GENERIC_USERNAMES = (*PLACEHOLDERS, "support", "operator", "agent", "owner", "member", "customer")
ADDRESS_MARKERS = (
    "street", "avenue", "road", "boulevard", "district", "city", "village", "apt", "apartment", "building", "house", "floor", "block", "baku",
    "azerbaijan", "kuce", "prospekt", "rayon", "seher", "qesebe", "kend", "bina", "menzil", "blok", "mertebe",
)
RELATIONS = (
    "mother", "father", "spouse", "husband", "wife", "partner", "guardian", "parent", "brother", "sister", "child", "son", "daughter", "caregiver",
    "carer", "relative", "next of kin", "legal guardian", "life partner", "ana", "ata", "valideyn", "qardas", "baci", "heyat yoldasi", "qeyyum",
    "qohum", "ovlad",
)
NO_SECRETS = ("example", "sample", "placeholder", "changeme", "your_", "_here")


def any_of(words) -> str:
    """A pattern for any of ``words``, as they stand."""
    return "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def squeezed(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def valid_email(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.forall(F.split(domain, r"\."), lambda x: ~x.startswith("-") & ~x.endswith("-"))
    return ~value.contains("..") & ~local.startswith(".") & ~local.endswith(".") & labels


def valid_phone(value: Column) -> Column:
    n, plain = F.length(digits(value)), F.btrim(value)
    kind = F.when(plain.startswith("+994"), n == 12).when(plain.startswith("0"), n == 10).otherwise(plain.startswith("+"))
    return ~value.contains("@") & n.between(10, 15) & kind


def valid_name(value: Column) -> Column:
    name = squeezed(value)
    part = F.split(name, " ")
    words = F.forall(part, lambda p: p.rlike(r"\A[A-Za-zƏəÖöÜüĞğÇçŞşİıI]{2,30}\z") & ~F.lower(p).isin(*TECHNICAL))
    return F.length(name).between(2, 100) & (F.size(part) <= 5) & words


def valid_date(value: Column, this_year: Column) -> Column:
    """Three numbers that are a day from 1900 on, year first or last, of ``this_year`` at most."""
    n = F.transform(F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    a, b, c = (F.try_element_at(n, F.lit(k)) for k in (1, 2, 3))
    year = F.when((c < 100) & (c <= 30), c + 2000).when(c < 100, c + 1900).otherwise(c)

    def real(y: Column, m: Column, d: Column) -> Column:
        day = F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")))
        return F.coalesce(y.between(1900, this_year) & day.isNotNull(), F.lit(False))

    return (F.size(n) == 3) & F.when(a > 31, real(a, b, c)).otherwise(real(year, b, a) | real(year, a, b))


def valid_address(value: Column) -> Column:
    lower = F.lower(value)
    parts = [value.rlike(r"(?U)\d"), lower.rlike(any_of(ADDRESS_MARKERS)), lower.rlike(r"\b(?:az|aze|azerbaijan|baku|city|rayon|district|zip|postal)\b")]
    return ~value.contains("@") & (F.length(F.btrim(value)) >= 8) & (sum((p.cast("int") for p in parts[1:]), parts[0].cast("int")) >= 2)


def looks_like_base64(value: Column) -> Column:
    """40 characters or more of which those of the base64 alphabet can be decoded (the first 160)."""
    compact = F.regexp_replace(value, r"(?U)\s+", "")
    some = F.regexp_replace(F.substring(compact, 1, 160), "[^A-Za-z0-9+/=]", "")
    return (F.length(compact) >= 40) & compact.rlike(r"\A\p{ASCII}*\z") & F.try_to_binary(some, F.lit("base64")).isNotNull()


def valid_free_text(value: Column, longest: int = 150) -> Column:
    text = squeezed(value)
    lower = F.lower(text)
    return (
        F.length(text).between(2, longest)
        & ~lower.isin(*PLACEHOLDERS)
        & ~lower.rlike(any_of(("http://", "https://", "<html", "{", "}", "[", "]")))
        & ~text.rlike(EMAIL)
        & ~text.rlike(PHONE)
    )


def is_relation(value: Column) -> Column:
    text = squeezed(F.lower(value))
    return ~text.isin(*PLACEHOLDERS) & (text.isin(*RELATIONS) | ((F.size(F.split(text, " ")) <= 4) & text.rlike(any_of(RELATIONS))))


# Forms of an IPv6 address.
_HEX, _V4 = "[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def valid_ip(value: Column) -> Column:
    """An IPv4 or IPv6 address; brackets, a zone and a prefix length are left out."""
    text = F.btrim(value)
    text = F.substring_index(F.substring_index(F.btrim(text, F.lit("[]")), "%", 1), "/", 1)
    # an IPv4 tail counts as two groups
    as_groups = F.regexp_replace(text, rf":{_V4}\z", ":0:0")
    halves = F.split(as_groups, "::")
    groups = F.filter(F.flatten(F.transform(halves, lambda h: F.split(h, ":"))), lambda g: g != "")
    short = (F.size(halves) == 2) & (F.size(groups) <= 7)
    full = (F.size(halves) == 1) & (F.size(groups) == 8)
    tidy = ~as_groups.rlike(r"\A:[^:]|[^:]:\z|:::")
    v6 = as_groups.contains(":") & tidy & (short | full) & F.forall(groups, lambda g: g.rlike(whole(_HEX)))
    return text.rlike(whole(_V4)) | v6


def valid_imei(value: Column) -> Column:
    n = digits(value)
    return (F.length(n) == 15) & F.call_function("luhn_check", n)


def valid_card(value: Column) -> Column:
    n = digits(value)
    return F.length(n).between(13, 19) & F.call_function("luhn_check", n) & ~n.rlike(r"\A(\d)\1*\z")


def valid_iban(value: Column) -> Column:
    """The rest modulo 97 of the rearranged number is 1, taken character by character."""
    plain = F.upper(F.regexp_replace(value, r"(?U)\s+", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4)), "")
    codes = F.transform(turned, lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int")))
    rest = F.aggregate(codes, F.lit(0), lambda r, c: (r * F.when(c > 9, 100).otherwise(10) + c) % 97)
    return F.length(plain).between(15, 34) & plain.rlike(r"\A[A-Z]{2}\d{2}[A-Z0-9]+\z") & (rest == 1)


def valid_mac(value: Column) -> Column:
    plain = F.lower(F.regexp_replace(value, "[^A-Fa-f0-9]", ""))
    return (F.length(plain) == 12) & ~plain.isin("000000000000", "ffffffffffff")


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(latitude.try_cast("double").between(-90, 90) & longitude.try_cast("double").between(-180, 180), F.lit(False))


def valid_username(value: Column) -> Column:
    name = F.btrim(F.btrim(value), F.lit("`'\"[](){}<>"))
    lower = F.ltrim(F.lower(name), F.lit("@"))
    return (
        ~lower.isin(*GENERIC_USERNAMES)
        & F.length(name).between(3, 80)
        & ~name.contains("://")
        & ~name.rlike(whole(EMAIL))
        & ~valid_ip(name)
        & ~name.rlike(r"\A\d{1,6}\z")
        & name.rlike(whole(USERNAME))
    )


def valid_text(value: Column, least: Column | int = 3, most: Column | int = 220) -> Column:
    text = squeezed(value)
    return (
        F.length(text).between(least, most) & ~F.lower(text).isin(*PLACEHOLDERS) & ~text.rlike(whole(EMAIL)) & ~text.rlike(whole(PHONE)) & ~valid_ip(text)
    )


def valid_secret(value: Column) -> Column:
    text = F.btrim(F.btrim(value), F.lit("'\""))
    lower = F.lower(text)
    return (
        F.length(text).between(6, 512)
        & ~lower.isin(*PLACEHOLDERS)
        & ~lower.rlike(any_of(NO_SECRETS))
        & ~text.rlike(r"\A[*xX.-]{6,}\z")
        & text.rlike("[A-Za-z]")
        & text.rlike(r"\d|[^A-Za-z0-9]")
    )
