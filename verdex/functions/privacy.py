"""Detectors of personal data and credentials, as columns over a text.

Java's regular expressions have the lookarounds that whole-token matching needs; checksums are folds over digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the reference's engine, inside a class; Java and RE2 know fewer characters as \s.
_WS = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_QUOTE = r"[\x27\x22]"
# Credential and path patterns, by name; quotes are written as codes, so that each stands in SQL as it is.
CREDENTIALS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "bearer": rf"Bearer[{_WS}]+[A-Za-z0-9._~+/-]{{12,}}",
    "assigned": rf"(?i)\b(?:api[_-]?key|secret|password|passwd|token)\b[{_WS}]*[:=][{_WS}]*{_QUOTE}[^\x27\x22{_WS}]{{8,}}{_QUOTE}",
    "vck": r"vck_[A-Za-z0-9]{10,}",
    "bk": r"\bbk-[A-Za-z0-9]{10,}",
    "sk": r"\bsk-[A-Za-z0-9_-]{16,}",
    "live_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{8,}",
    "hf": r"\bhf_[A-Za-z0-9]{20,}",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    "slack": r"\bxox[abpr]-[A-Za-z0-9-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "path_root": r"/root/",
    "path_users": r"/Users/",
    "path_volumes": r"/Volumes/",
    "path_home": r"/home/[a-z_][a-z0-9_-]*/",
    # Wider than the reference: values without quotes, and shorter tokens.
    "assigned_wide": rf"(?i)(?:api[_-]?key|secret|token|password)[{_WS}]*[:=][{_WS}]*{_QUOTE}?[A-Za-z0-9_-]{{16,}}",
    "github_wide": r"gh[a-z]_[A-Za-z0-9]{20,}",
}
# Published test numbers that aren't personal data, and consumer mail domains.
TEST_CARDS = (
    "4111111111111111", "4242424242424242", "5555555555554444", "378282246310005", "4012888888881881",
    "5105105105105100", "6011111111111117", "4000056655665556", "371449635398431", "30569309025904",
)
CONSUMER_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "proton.me", "protonmail.com", "aol.com", "live.com",
    "uol.com.br", "bol.com.br", "terra.com.br", "yahoo.com.br", "hotmail.com.br", "gmx.de", "mail.ru", "qq.com", "163.com", "mail.com",
    "email.com", "usa.com", "post.com", "europe.com", "consultant.com", "myself.com", "dr.com", "engineer.com", "ymail.com",
    "rocketmail.com", "googlemail.com", "me.com", "mac.com", "msn.com", "zoho.com", "yandex.ru", "yandex.com", "tutanota.com",
    "fastmail.com", "hey.com", "pm.me", "ig.com.br", "globo.com", "r7.com", "zipmail.com.br", "outlook.com.br", "hotmail.co.uk",
    "yahoo.co.uk", "web.de", "t-online.de", "orange.fr", "free.fr", "libero.it", "gmx.com", "gmx.net", "inbox.com",
)
# Account and tax numbers of published documentation, which may stay.
KNOWN_IBAN = (
    "DE89370400440532013000", "GB82WEST12345698765432", "GB29NWBK60161331926819",
    "FR1420041010050500013M02606", "NL91ABNA0417164300", "ES9121000418450200051332",
    "IT60X0542811101000000123456", "BE68539007547034", "CH9300762011623852957", "AT611904300234573201",
    "GB33BUKB20201555555555", "DE75512108001245126199", "NL02ABNA0123456789", "ES7921000813610123456789",
    "FR7630006000011234567890189", "PT50000201231234567890154", "GB94BARC10201530093459",
    "GB15MIDL40051512345678", "DE44500105175407324931", "IE29AIBK93115212345678",
    "BR1800360305000010009795493C1", "BR9700360305000010009795493P1",
)
KNOWN_CPF = ("12345678909", "11144477735", "52998224725", "98765432100", "11122233396")
#: Patterns that a release is scanned for; the others are of the sources' scan.
SCANNED = ("aws_key", "bearer", "assigned", "vck", "bk", "sk", "live_key", "hf", "github", "private_key")
#: Numbers by kind: pattern of a candidate, as Java reads it.
CANDIDATES = {
    "cpf": r"(?<!\d)\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?!\d)",
    "cnpj": r"(?<!\d)\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?!\d)",
    "card": r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "consumer_email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _fold(chars: Column, step) -> Column:
    """Sum of step(digit, index from 0) over the characters of a digit string."""
    of = F.transform(F.split(chars, ""), lambda c, i: step(c.try_cast("int"), i))
    return F.aggregate(of, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0)))


def _check_digit(value: Column, weights: list[int]) -> Column:
    """Modulo-11 check digit of the first len(weights) digits; remainders below 2 give 0."""
    table = F.array(*(F.lit(w) for w in weights))
    total = _fold(F.substring(value, 1, len(weights)), lambda d, i: d * F.get(table, i))
    return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)


def _varied(d: Column) -> Column:
    return d != F.repeat(F.substring(d, 1, 1), F.length(d))


def cpf_ok(value: Column) -> Column:
    """PII-02: eleven digits with a full stop or hyphen between some, not all equal, both check digits."""
    d = digits(value)
    at = lambda k: F.substring(d, k, 1).cast("int")
    return value.rlike("[.-]") & (F.length(d) == 11) & _varied(d) & (_check_digit(d, list(range(10, 1, -1))) == at(10)) & (_check_digit(d, list(range(11, 1, -1))) == at(11))


def cnpj_ok(value: Column) -> Column:
    """PII-03: fourteen digits with a slash between, not all equal, two weighted check digits."""
    d = digits(value)
    first = [5, 4, 3, 2, *range(9, 1, -1)]
    at = lambda k: F.substring(d, k, 1).cast("int")
    return value.contains("/") & (F.length(d) == 14) & _varied(d) & (_check_digit(d, first) == at(13)) & (_check_digit(d, [6, *first]) == at(14))


def card_ok(value: Column) -> Column:
    """PII-04: 13 to 19 digits, first 3 to 6, Luhn, no test number."""
    d = digits(value)
    return F.length(d).between(13, 19) & F.substring(d, 1, 1).isin("3", "4", "5", "6") & F.call_function("luhn_check", d) & ~d.isin(*TEST_CARDS)


def ssn_ok(value: Column) -> Column:
    """PII-05: area not 000, 666 or 9xx, group not 00, serial not 0000, not the specimen."""
    return ~F.substring(value, 1, 3).isin("000", "666") & ~value.startswith("9") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000") & (value != "123-45-6789")


def iban_ok(value: Column) -> Column:
    """PII-06: 15 to 34 characters whose number, country and check digits moved to the end, is 1 modulo 97; folded digit by digit."""
    v = F.regexp_replace(F.upper(value), " ", "")
    moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c.rlike("[0-9A-Z]"))
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return F.length(v).between(15, 34) & (rest == 1)


def consumer_mail(value: Column) -> Column:
    """PII-07: an address whose domain, in lower case, is a consumer's."""
    return F.lower(F.split_part(value, F.lit("@"), F.lit(-1))).isin(*CONSUMER_DOMAINS)


def findings(text: Column) -> Column:
    """PII-01 to PII-07: (category, value, drop) of every match in a text, which may be a row as JSON; a credential has no value.

    A text without a digit has no number, and one without an at-sign no address, so the patterns for these are left out.
    """
    found = lambda kind, value, drop: F.struct(F.lit(kind).alias("category"), value.alias("value"), drop.alias("drop"))
    none = F.array().cast("array<struct<category: string, value: string, drop: boolean>>")
    only = lambda kind: all_matches(text, CANDIDATES[kind])
    no_value, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    secrets = [F.transform(all_matches(text, CREDENTIALS[k]), lambda _: found("credential", no_value, yes)) for k in SCANNED]
    plain = lambda v: F.regexp_replace(v, " ", "")
    numbers = [
        F.transform(F.filter(only("cpf"), cpf_ok), lambda v: found("cpf", digits(v), ~digits(v).isin(*KNOWN_CPF))), F.transform(F.filter(only("cnpj"), cnpj_ok), lambda v: found("cnpj", digits(v), no)),
        F.transform(F.filter(only("card"), card_ok), lambda v: found("card", digits(v), yes)), F.transform(F.filter(only("ssn"), ssn_ok), lambda v: found("ssn", digits(v), yes)),
        F.transform(F.filter(only("iban"), iban_ok), lambda v: found("iban", plain(v), ~plain(v).isin(*KNOWN_IBAN))),
    ]
    mail = F.transform(F.filter(only("consumer_email"), consumer_mail), lambda v: found("consumer_email", F.lower(v), yes))
    return F.concat(*secrets, F.when(text.rlike("[0-9]{2}"), F.concat(*numbers)).otherwise(none), F.when(text.contains("@"), mail).otherwise(none))


#: Addresses in a dotted text: four numbers, with no further digit or full stop at either side.
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"
# Networks as (address, prefix length) that count as documentation and as private.
DOCUMENTATION = (("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24))
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("240.0.0.0", 4), ("255.255.255.255", 32),
)


def ipv4_class(value: Column) -> Column:
    """PII-10: documentation, loopback, private or public; null if a part exceeds 255 or has a leading zero."""
    p = [F.split_part(value, F.lit("."), F.lit(k)) for k in range(1, 5)]
    valid = F.lit(True)
    for x in p:
        valid = valid & (x.cast("int") <= 255) & ~x.rlike("^0[0-9]")
    number = sum((x.cast("bigint") * 256 ** (3 - k) for k, x in enumerate(p)), F.lit(0).cast("bigint"))

    def inside(networks: tuple[tuple[str, int], ...]) -> Column:
        out = F.lit(False)
        for address, length in networks:
            low = sum(int(x) * 256 ** (3 - k) for k, x in enumerate(address.split(".")))
            out = out | number.between(low, low + 2 ** (32 - length) - 1)
        return out

    return F.when(valid, F.when(inside(DOCUMENTATION), "documentation").when(inside((("127.0.0.0", 8),)), "loopback").when(inside(PRIVATE), "private").otherwise("public"))
