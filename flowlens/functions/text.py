"""Text functions on columns: names, slots and expressions of C programs. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]"


def trim(c: Column) -> Column:
    """Blanks of the C locale off both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalize_space(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{BLANK}+", " "))


def sanitize_id(c: Column) -> Column:
    return F.when(F.length(c) == 0, "anon").otherwise(F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"))


def escape_dot(c: Column) -> Column:
    return F.regexp_replace(c, r'(["\\])', r"\\$1")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def identifiers(c: Column) -> Column:
    """Distinct identifiers in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def normalize_indirect(c: Column) -> Column:
    """Callee expressions for signatures: -> as ., no blanks, each index as [*]."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("->"), F.lit(".")), r"\s+", ""), r"\[[^\]]*\]", "[*]")


def member(c: Column) -> Column:
    """The last member of a normalised expression, empty without one."""
    return F.regexp_extract(c, r"\.([A-Za-z_][A-Za-z0-9_]*)$", 1)


def memory_slot(c: Column) -> Column:
    """A slot with its fields and indices: address and dereference marks off, -> as ., an index that is no number as [*]."""
    c = F.regexp_replace(F.replace(F.regexp_replace(c, r"\s+", ""), F.lit("->"), F.lit(".")), r"^[&*(]+", "")
    return F.regexp_replace(F.regexp_replace(c, r"\[(?![0-9]+\])[^\]]*\]", "[*]"), r"[^A-Za-z0-9_.\[\]*].*$", "")


def access_slot(c: Column) -> Column:
    """The access that an expression begins with, address and dereference marks off: `&p->a[i + 1]` gives p.a[*], a number stays an index. Empty where it begins with a parenthesis or anything else."""
    plain = F.regexp_replace(F.replace(F.regexp_replace(c, r"\s+", ""), F.lit("->"), F.lit(".")), r"^[&*]+", "")
    return F.regexp_replace(F.regexp_extract(plain, r"^([A-Za-z_]\w*(?:\.\w+|\[[^\[\]]*\])*)", 1), r"\[(?![0-9]+\])[^\]]*\]", "[*]")


def main_slot(c: Column) -> Column:
    """The access that an expression begins with, or else its plain slot."""
    return F.coalesce(F.nullif(access_slot(c), F.lit("")), canonical_slot(c))


def expression_slots(c: Column) -> Column:
    """Everything in an expression that may hold a value: its access, its plain slot, and each identifier."""
    return F.filter(F.array_distinct(F.concat(F.array(access_slot(c), canonical_slot(c)), identifiers(c))), lambda x: x != "")


def slot_root(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"^.*::", ""), r"^([^.\[]*)", 1)


def slot_aliases(c: Column) -> Column:
    """The slot, the slot with its first index as [*], its root."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"^([^\[]*)\[[^\]]*\]", r"$1[*]"), slot_root(c)))


def returned_expression(c: Column) -> Column:
    return F.regexp_extract(trim(c), r"^return\s+(.*?)\s*;?$", 1)


def leading_dereferences(c: Column) -> Column:
    return F.length(F.regexp_extract(trim(c), r"^(\**)", 1)).cast("long")


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def last_k(array: Column, k: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - k + 1, F.lit(1)), k)


#: Fixed values of the id format: the offset basis (not the published one) and the prime.
FNV_BASIS, FNV_PRIME = 1469598103934665603, 1099511628211


def call_site_id(key: Column) -> Column:
    """cs_<n>, the 64-bit FNV-1a of `function|file:line:col|direct|through|callee|args`.

    The hash is held in two halves of 32 bits: the prime is 2^40 + 435, so no product leaves 64 bits.
    """
    low, prime = FNV_BASIS & 0xFFFFFFFF, FNV_PRIME - (1 << 40)
    octets = F.regexp_extract_all(F.hex(F.encode(key, "UTF-8")), F.lit(".."), F.lit(0))
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(low).cast("long").alias("lo"))

    def step(h: Column, octet: Column) -> Column:
        lo = h["lo"].bitwiseXOR(F.conv(octet, 16, 10).cast("long"))
        hi = h["hi"] * prime + F.shiftright(lo * prime, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(0xFFFFFFFF).alias("hi"), (lo * prime).bitwiseAND(0xFFFFFFFF).alias("lo"))

    number = lambda h: (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h["lo"]).cast("decimal(20,0)").cast("string")
    return F.concat(F.lit("cs_"), F.aggregate(octets, start, step, number))


def canonical_slot(c: Column) -> Column:
    """The dotted path of an access without address marks and indices, or else the last identifier; empty without one."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("->"), F.lit(".")), r"\[[^\]]*\]", ""), r"^[&*(\s]+", "")

    def told(x: Column) -> Column:
        last = F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), F.lit(-1)), F.lit(""))
        return F.when(x.rlike(r"^\s*[A-Za-z_]\w*(\s*\.\s*[A-Za-z_]\w*)+[\s;)]*$"), F.regexp_replace(x, r"[\s;)]+", "")).otherwise(last)

    return bound(plain, told)


def callee_name(c: Column) -> Column:
    """The slot in front of the first parenthesis; empty where there is none."""
    return F.when(F.contains(c, F.lit("(")), canonical_slot(F.substring_index(c, "(", 1))).otherwise("")


def assigned_slot(c: Column) -> Column:
    """The slot that a line assigns to: before the first = that stands next to no other one."""
    return memory_slot(F.regexp_extract(F.regexp_extract(c, r"^(.*?(?<!=))=(?!=)", 1), r"([A-Za-z_]\w*(?:(?:->|\.)\w+|\[[^\[\]]*\])*)\s*$", 1))


def struct_access(c: Column) -> Column:
    """base and member (the path below it) of an access, indices left out."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("->"), F.lit(".")), r"\[[^\]]*\]", ""), r"\s+|^[&*(]+", "")
    return F.struct(F.substring_index(plain, ".", 1).alias("base"), F.regexp_extract(plain, r"^[^.]*\.(.*)$", 1).alias("member"))


#: A line with one pair of parentheses whose arguments hold no brackets but indices: its arguments can be split at the commas.
_PLAIN_CALL = r"""^[^()"'\[\]{}]*\(((?:[^()"'\[\]{},]|,|\[[^()"'\[\]{},]*\])*)\)[^()"'\[\]{}]*$"""
#: Quoted text (a quote after a backslash doesn't end it), brackets, commas, and what stands between.
_TOKENS = r"""(?s)"[^"]*(?:(?<=\\)"[^"]*)*(?:"|\z)|'[^']*(?:(?<=\\)'[^']*)*(?:'|\z)|[()\[\]{},]|[^"'()\[\]{},]+"""


def call_arguments(line: Column) -> Column:
    """The argument texts of the last call of a line; quotes and brackets are kept together.

    Plain calls are split at their commas. For others a fold over the tokens keeps the depth, the place, the start of the
    argument, the arguments of the call at hand and those of the last one that was closed.
    """
    none = F.array().cast("array<string>")
    fields = ["d", "at", "s", "parts", "found"]
    start = F.struct(F.lit(0).alias("d"), F.lit(1).alias("at"), F.lit(1).alias("s"), none.alias("parts"), none.alias("found"))

    def step(a: Column, x: Column) -> Column:
        here, after = a["at"], a["at"] + F.length(x)
        put = lambda **new: F.struct(*(after.alias(f) if f == "at" else new.get(f, a[f]).alias(f) for f in fields))
        told = F.concat(a["parts"], F.array(F.substring(line, a["s"], here - a["s"])))
        opened = put(d=a["d"] + 1, s=F.when(a["d"] == 0, after).otherwise(a["s"]), parts=F.when(a["d"] == 0, none).otherwise(a["parts"]))
        closed = put(d=a["d"] - 1, found=F.when((a["d"] == 1) & (x == ")"), told).otherwise(a["found"]))
        return F.when(x.isin("(", "[", "{"), opened).when(x.isin(")", "]", "}") & (a["d"] > 0), closed).when((x == ",") & (a["d"] == 1), put(s=after, parts=told)).otherwise(put())

    plain = F.rlike(line, F.lit(_PLAIN_CALL))
    found = F.when(plain, F.split(F.regexp_extract(line, _PLAIN_CALL, 1), ",", -1)).otherwise(F.aggregate(F.regexp_extract_all(line, F.lit(_TOKENS), F.lit(0)), start, step, lambda a: a["found"]))
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return bound(trimmed, lambda xs: F.when((F.size(xs) == 1) & (F.get(xs, 0) == ""), none).otherwise(xs))


#: Library functions that copy memory from their second to their first argument, and those that clear it.
COPIES = "memcpy memmove mempcpy __builtin_memcpy __builtin_memmove __builtin_mempcpy strcpy stpcpy strncpy strlcpy wcscpy wmemcpy wmemmove strcat strncat".split()
CLEARS = "memset bzero explicit_bzero __builtin_memset".split()


def memory_transfer(c: Column) -> Column:
    """source, target of the copy that a line makes, or the target alone of what it clears; null for other lines."""
    kind = bound(callee_name(c), lambda x: F.when(x.isin(COPIES), "copy").when(x == "bcopy", "swapped").when(x.isin(CLEARS), "cleared"))

    def told(k: Column, args: Column) -> Column:
        first, second, none = F.get(args, 0), F.get(args, 1), F.lit(None).cast("string")
        pair = lambda source, target: F.struct(source.alias("source"), target.alias("target"))
        two, one = F.size(args) >= 2, F.size(args) >= 1
        return F.when((k == "copy") & two, pair(second, first)).when((k == "swapped") & two, pair(first, second)).when((k == "cleared") & one, pair(none, first))

    return bound(kind, lambda k: F.when(k.isNotNull(), bound(call_arguments(c), lambda args: told(k, args))))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)



def strip_suffix(c: Column, suffix: str) -> Column:
    """The text without the suffix, where it ends so."""
    return F.when(F.endswith(c, F.lit(suffix)), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def replace_all(c: Column, old: str, new: str) -> Column:
    """Every occurrence replaced; an empty old text changes nothing."""
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def escape_script(c: Column) -> Column:
    """JSON text that may stand in a script element: <, > and & as escapes."""
    for mark in "<>&":
        c = F.replace(c, F.lit(mark), F.lit(f"\\u{ord(mark):04x}"))
    return c


def slot_of(c: Column) -> Column:
    """The memory slot of an expression, or else its plain slot."""
    return F.coalesce(F.nullif(memory_slot(c), F.lit("")), canonical_slot(c))


def slot_of_object(c: Column) -> Column:
    """The slot of an abstract object: what follows the last colon."""
    return F.substring_index(c, ":", -1)


def joined_or_none(names: Column, separator: str = ", ") -> Column:
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "<none>").otherwise(F.array_join(names, separator))


def is_integer_binding(c: Column) -> Column:
    return F.startswith(c, F.lit("#int:"))


def program_point(high: Column, low: Column) -> Column:
    """Two numbers of 32 bits as one of 64."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(0xFFFFFFFF))


def aligned(array: Column, like: Column) -> Column:
    """The array cut or filled with nulls to the length of the other."""
    return F.transform(like, lambda _, i: F.get(array, i))


def top_level_split(c: Column) -> Column:
    """condition, yes, no of a conditional expression without its outer parentheses; nulls where there is no ? outside of brackets.

    One fold over the characters notes the first ? at depth 0 and the : that answers it. A text with one ?, a : behind it and no brackets,
    or without any ?, is split without the fold.
    """
    return bound(stripped_parentheses(c), lambda text: F.when(text.rlike(_PLAIN_CHOICE), _plain_split(text)).otherwise(F.when(F.contains(text, F.lit("?")), _split(text)).when(text.isNotNull(), _no_choice())))


#: One ?, a : behind it, no brackets.
_PLAIN_CHOICE = r"^[^?()\[\]{}]*\?[^?:()\[\]{}]*:[^?()\[\]{}]*\z"


def _no_choice() -> Column:
    return F.struct(*(F.lit(None).cast("string").alias(x) for x in ("condition", "yes", "no")))


def _plain_split(text: Column) -> Column:
    after = F.substring_index(text, "?", -1)
    yes = F.substring_index(after, ":", 1)
    return F.struct(trim(F.substring_index(text, "?", 1)).alias("condition"), trim(yes).alias("yes"), trim(F.substring(after, F.length(yes) + 2, F.length(after))).alias("no"))


def _split(text: Column) -> Column:
    chars = F.transform(F.split(text, r"(?s)(?<=.)", -1), lambda x, i: F.struct(x.alias("c"), (i + 1).alias("i")))
    fields = ["d", "n", "ask", "tell"]
    start = F.struct(*(F.lit(0).alias(f) for f in fields))

    def step(a: Column, x: Column) -> Column:
        ch, i = x["c"], x["i"]
        put = lambda **new: F.struct(*(new.get(f, a[f]).alias(f) for f in fields))
        flat = a["d"] == 0
        return (
            F.when(ch.isin("(", "[", "{"), put(d=a["d"] + 1)).when(ch.isin(")", "]", "}"), put(d=a["d"] - 1))
            .when((ch == "?") & flat, put(n=a["n"] + 1, ask=F.when(a["ask"] == 0, i).otherwise(a["ask"])))
            .when((ch == ":") & flat & (a["n"] == 1) & (a["tell"] == 0), put(n=F.lit(0), tell=i)).when((ch == ":") & flat & (a["n"] > 1), put(n=a["n"] - 1)).otherwise(put()))

    def told(at: Column) -> Column:
        part = lambda a, b: F.when((at["ask"] > 0) & (at["tell"] > at["ask"]), trim(F.substring(text, a, b)))
        return F.struct(part(F.lit(1), at["ask"] - 1).alias("condition"), part(at["ask"] + 1, at["tell"] - at["ask"] - 1).alias("yes"), part(at["tell"] + 1, F.length(text)).alias("no"))

    return F.aggregate(chars, start, step, told)


def stripped_parentheses(c: Column) -> Column:
    """The text without the parentheses that enclose it as a whole: as many pairs as open it, end it and stay open in between.

    Characters are counted only where a text begins with a parenthesis and holds more than one pair.
    """
    return bound(trim(c), _stripped)


def _stripped(c: Column) -> Column:
    plain = F.when(~F.startswith(c, F.lit("(")) & ~F.endswith(c, F.lit(")")), c).when(c.rlike(r"^\([^()]*\)\z"), trim(F.substring(c, F.lit(2), F.length(c) - 2)))
    return F.coalesce(plain, _counted_parentheses(c))


def _counted_parentheses(c: Column) -> Column:
    lead, inner, trail = (F.regexp_extract(trim(c), r"(?s)^([(\s]*)(.*?)([)\s]*)$", i) for i in (1, 2, 3))
    opened, closed = F.regexp_count(lead, F.lit(r"\(")), F.regexp_count(trail, F.lit(r"\)"))
    start = F.struct(opened.alias("d"), opened.alias("low"))

    def step(a: Column, x: Column) -> Column:
        depth = a["d"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        return F.struct(depth.alias("d"), F.least(a["low"], depth).alias("low"))

    lowest = F.aggregate(F.split(inner, r"(?s)(?<=.)", -1), start, step, lambda a: a["low"])
    pairs = F.greatest(F.least(opened, closed, lowest), F.lit(0))
    return F.concat(F.repeat(F.lit("("), opened - pairs), inner, F.repeat(F.lit(")"), closed - pairs))


def conditional_store(c: Column) -> Column:
    """slot, condition, yes, no of a line `slot = condition ? yes : no;`; null for other lines."""
    left, right = F.regexp_extract(c, r"^\s*(.*?(?<![=!<>]))=(?!=)(.*?);?\s*$", 1), F.regexp_extract(c, r"^\s*(.*?(?<![=!<>]))=(?!=)(.*?);?\s*$", 2)
    told = lambda x: F.when(x["yes"].isNotNull(), F.struct(assigned_slot(c).alias("slot"), x["condition"].alias("condition"), x["yes"].alias("yes"), x["no"].alias("no")))
    return bound(top_level_split(F.when(trim(left) != "", right)), told)
