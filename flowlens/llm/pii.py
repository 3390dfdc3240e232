r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds of the base contract (email, ip, card, phone) are whole matches of its patterns that pass its checks. The method adds
IBANs (the country's length and mod 97) and national numbers (a pattern that only counts with a context word). Each span has a score: what its
check is worth, raised where a word of its kind stands within CONTEXT characters. Base spans stay whatever their score;
added ones need MIN_SCORE and must overlap no base span. Everything is a SQL expression on one row: no shuffle, no Python.

Patterns are linear: quantifiers that nothing after can shorten are possessive, and a local part only begins where a run of
its characters begins or the match before ended.

Defined results: null text counts as empty and has no spans; repeated rows and null ids stay; columns of the input called
like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import spans as S
from flowlens.llm.common import given_back, set_aside, table

KINDS = ["email", "ip", "card", "phone", "iban", "national"]
BASE = KINDS[:4]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The length of a country's IBANs. A match ends there, so words or amounts after it are no part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, countries: str) -> str:
    blocks, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{blocks}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


_KNOWN = f"(?:{'|'.join(_iban(*x) for x in IBAN_LENGTHS.items())})(?![A-Za-z0-9])"
#: Other countries, and lengths that no country has, as far as blocks go that do not begin a known one.
_OTHER = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_KNOWN})\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_KNOWN}|{_OTHER})"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CONTEXT = 40
MIN_SCORE = 0.5
#: What the check of a kind is worth, and the words that raise its score by 0.3.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "national": 0.3}
CONTEXT_WORDS = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf", "iban": "iban|account|bank|konto|compte|cuenta", "national": "ssn|social|security|national|identity|passport",
}

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_N = f"length({_DIGITS})"
#: Luhn: from the right, every second digit doubled and its digits added.
LUHN = f"""(aggregate(sequence(1, {_N}), 0, (a, i) -> a + case when pmod({_N} - i, 2) = 0 then cast(substring({_DIGITS}, i, 1) as int)
    else cast(substring('0246813579', 1 + cast(substring({_DIGITS}, i, 1) as int), 1) as int) end) % 10 = 0)"""
_MOVED = "concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4))"
#: mod 97: the first four characters at the end, letters as 10 to 35.
MOD97 = f"""(aggregate(sequence(1, length(replace(m, ' ', ''))), 0, (a, i) -> case when substring({_MOVED}, i, 1) between '0' and '9'
    then (a * 10 + cast(substring({_MOVED}, i, 1) as int)) % 97 else (a * 100 + ascii(substring({_MOVED}, i, 1)) - 55) % 97 end) = 1)"""


def scan(docs: DataFrame) -> DataFrame:
    """docs with base and found: arrays of kind, s, e, m; found has a score, too."""
    out = docs.withColumn("fw_text", F.expr("coalesce(cast(text as string), '')"))
    out = S.propose(out, "fw_text", "email", EMAIL, "length(m) > 0", "contains(fw_text, '@')")
    out = S.propose(out, "fw_text", "ip", IP, "forall(split(m, r'[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and cast(concat('0', regexp_replace(p, '^0+', '')) as int) <= 255)", r"rlike(fw_text, r'[0-9]\.[0-9]')")
    out = S.propose(out, "fw_text", "card", CARD, f"{_N} between 12 and 19 and {LUHN}", r"rlike(fw_text, r'[0-9][\x20-]?[0-9]')")
    out = S.propose(out, "fw_text", "phone", PHONE, f"{_N} between 9 and 15", "contains(fw_text, '+')")
    out = S.propose(out, "fw_text", "iban", IBAN, f"length(replace(m, ' ', '')) between 15 and 34 and {MOD97}", r"rlike(fw_text, r'[A-Z]{2}[0-9]{2}')")
    out = S.propose(out, "fw_text", "national", NATIONAL, "length(m) > 0", "contains(fw_text, '-')")
    out = out.withColumn("base", F.concat(*(f"fw_{k}" for k in BASE)))
    near = f"lower(substring(fw_text, greatest(x.s - {CONTEXT}, 0) + 1, x.e + {CONTEXT} - greatest(x.s - {CONTEXT}, 0)))"
    worth = " ".join(f"when '{k}' then {v}D" for k, v in WORTH.items())
    raised = " ".join(f"when x.kind = '{k}' and rlike({near}, r'{v}') then 0.3D" for k, v in CONTEXT_WORDS.items())
    score = f"least(1D, (case x.kind {worth} end) + (case {raised} else 0D end))"
    both = f"concat(base, {S.apart('fw_iban', 'base')}, {S.apart('fw_national', 'base')})"
    out = out.withColumn("found", F.expr(f"transform({both}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'm', x.m, 'score', {score}))"))
    listed = ", ".join(f"'{k}'" for k in BASE)
    out = out.withColumn("found", F.expr(f"filter(found, x -> x.kind in ({listed}) or x.score >= {MIN_SCORE})"))
    return out.drop("fw_text", *(f"fw_{k}" for k in KINDS))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by [PII], and n_chars brought up to date where docs has it. The columns stay."""
    out = scan(set_aside(docs)).withColumn("text", F.expr("cast(text as string)"))
    return given_back(out, docs, S.masked("text", "found", "[PII]"), F.size("found") > 0)


def digest(scanned: DataFrame) -> DataFrame:
    n = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return scanned.select("doc_id", *map(n, BASE), F.sha2(S.ordered(KINDS, "base"), 256).alias("base_sha256"), S.ordered(KINDS, "found").alias("spans"))


def op10(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
