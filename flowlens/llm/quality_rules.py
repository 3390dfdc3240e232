r"""Quality rules, line first: rules judge each line, failing lines go, and documents that lose too much text are rejected.

Everything is a SQL expression on one row: no shuffle, no Python on the executors.

Words are `[^\x20\x09-\x0D]+`. Base measures are exact: repeated windows are found by hashes of eight words and, where two
hashes of a text agree, by the words themselves.

Defined results: null text counts as empty; a text without words has zeros everywhere and fails the base rule; blank lines
are no lines. Repeated rows and null ids stay; columns of the input called like an added one are replaced, but `clean` keeps
them all as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import given_back, set_aside, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document may lose this share of its characters in lines.
MAX_LOST = 0.5
#: More symbols a word, or more words that end in two marks, than this: the line fails on punctuation.
MAX_SYMBOLS_A_WORD = 0.3
MAX_SHOUTED = 0.3
#: A line of at most so many words without any sentence mark is a menu entry or a heading.
SHORT_LINE = 4
MAX_SEPARATORS_A_WORD = 0.2
#: A line of at most so many words with a phrase below is boilerplate; longer lines only mention it.
BOILERPLATE_WORDS = 20
#: Phrases of notices and page furniture.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of service", "terms of use", "privacy policy",
    "cookie policy", "we use cookies", "accept cookies", "enable javascript", "click here", "sign up for", "subscribe to our",
    "copyright (c)", "©", "log in", "read more", "share this", "skip to content", "back to top",
)

#: Hash of a window's word hashes; any function gives the same result.
HASH = "xxhash64({})"

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, r'{_WORDS}', 0)"


def line_rules(line: str = "x") -> dict[str, str]:
    """For each rule the SQL condition under which a line fails; n is the line's number of words."""
    n = f"regexp_count({line}, r'{_WORDS}')"
    phrases = " or ".join(f"contains(lower({line}), '{p}')" for p in BOILERPLATE)
    return {
        "punctuation": rf"regexp_count({line}, r'[#*$%&|<>]') > {MAX_SYMBOLS_A_WORD} * {n} or regexp_count({line}, r'[!?]{{2,}}(?={_SPACE}|\z)') > {MAX_SHOUTED} * {n}",
        "navigation": rf"regexp_count({line}, r'[|›»→•·]|::|>>') > {MAX_SEPARATORS_A_WORD} * {n} or ({n} <= {SHORT_LINE} and not rlike({line}, r'[.!?…。！？:;,]'))",
        "boilerplate": f"{n} <= {BOILERPLATE_WORDS} and ({phrases})",
    }


def _repeat_words(n: str = "n_words") -> list[tuple[str, str]]:
    """Steps that count the words in windows found twice or more."""
    at = ", ".join(f"get(fw_hash, i + {k})" for k in range(WINDOW))
    text = ", ".join(f"get(fw_words, i + {k})" for k in range(WINDOW))
    differ = " or ".join(f"get(fw_words, get(fw_twice, {{a}}).i + {k}) <> get(fw_words, get(fw_twice, {{b}}).i + {k})" for k in range(WINDOW))
    hash_, both = "get(fw_sorted, {a}).h = get(fw_sorted, {b}).h", "get(fw_twice, {a}).h = get(fw_twice, {b}).h"
    exact = "get(fw_exact, {a}).h = get(fw_exact, {b}).h and get(fw_exact, {a}).k = get(fw_exact, {b}).k"

    def found(array: str, same: str) -> str:
        """Elements of a sorted array that are the same as a neighbour."""
        return f"filter({array}, (x, j) -> coalesce({same.format(a='j', b='j - 1')}, false) or coalesce({same.format(a='j', b='j + 1')}, false))"

    return [
        ("fw_hash", "transform(fw_words, w -> xxhash64(w))"),
        ("fw_windows", f"case when {n} >= {WINDOW} then transform(sequence(0, cast({n} as int) - {WINDOW}), i -> {HASH.format(at)}) end"),
        ("fw_sorted", "case when size(array_distinct(fw_windows)) < size(fw_windows) then sort_array(transform(fw_windows, (h, i) -> struct(h as h, i as i))) end"),
        ("fw_twice", found("fw_sorted", hash_)),
        # windows of one hash are alike unless two hashes collide; only then are their words written out
        ("fw_exact", f"case when exists(sequence(1, size(fw_twice) - 1), j -> {both.format(a='j', b='j - 1')} and ({differ.format(a='j', b='j - 1')})) then sort_array(transform(fw_twice, x -> struct(x.h as h, concat_ws(' ', {text.replace('i + ', 'x.i + ')}) as k, x.i as i))) end"),
        ("fw_found", f"sort_array(case when fw_exact is not null then transform({found('fw_exact', exact)}, x -> x.i) else transform(fw_twice, x -> x.i) end)"),
        ("n_repeat_words", f"coalesce(aggregate(fw_found, named_struct('n', 0L, 'last', -{WINDOW}), (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p), a -> a.n), 0L)"),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """docs with the base measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = docs.withColumn("fw_text", F.expr("coalesce(cast(text as string), '')")).withColumn("fw_words", F.expr(_words("fw_text")))
    out = out.withColumns({
        "n_words": F.expr("cast(size(fw_words) as bigint)"),
        "word_chars": F.expr("cast(length(array_join(fw_words, '')) as bigint)"),
        "n_symbols": F.expr("cast(regexp_count(fw_text, r'[#*$%&|<>]') as bigint)"),
        "fw_lines": F.expr(rf"filter(split(fw_text, '\n', -1), x -> rlike(x, r'[^\x20\x09-\x0D]'))"),
    })
    out = out.withColumn("n_dup_lines", F.expr("cast(size(fw_lines) - size(array_distinct(fw_lines)) as bigint)"))
    for name, sql in _repeat_words():
        out = out.withColumn(name, F.expr(sql))
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def judge(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """docs with the base measures, clean_text (the lines that pass, in order), lost (share of the line characters that went) and kept."""
    fails = " or ".join(f"({c})" for c in line_rules().values())
    out = measure(docs).withColumn("fw_good", F.expr(f"filter(fw_lines, x -> not ({fails}))"))
    # the row number, which kept refers to, keeps Spark from moving filters below the measures: that would repeat them many times over
    out = out.withColumns({
        "clean_text": F.array_join("fw_good", "\n"),
        "lost": F.expr("1 - length(array_join(fw_good, '')) / greatest(length(array_join(fw_lines, '')), 1)"),
        "fw_row": F.monotonically_increasing_id(),
    })
    out = out.withColumn("kept", F.expr(f"not base_failed and lost <= {max_lost} and fw_row >= 0"))
    return out.drop("fw_row", "fw_text", "fw_words", "fw_lines", "fw_hash", "fw_windows", "fw_sorted", "fw_twice", "fw_exact", "fw_found", "fw_good")


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of docs that are kept, with the failing lines out of text and n_chars, where docs has it, brought up to date. The columns stay."""
    out = judge(set_aside(docs), max_lost).where("kept")
    return given_back(out, docs, F.col("clean_text"))


def op2(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
_N = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
OP2_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1) GROUP BY r),
m AS (
  SELECT w.*, coalesce(p.n, 0) AS n_repeat_words, len(w) < {MIN_WORDS} OR 100 * coalesce(p.n, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed,
    list_filter(l, lambda x: NOT (
      len(regexp_extract_all(x, '[#*$%&|<>]')) > {MAX_SYMBOLS_A_WORD} * {_N} OR len(regexp_extract_all(x, '[!?]{{2,}}([\x20\x09-\x0D]|$)')) > {MAX_SHOUTED} * {_N}
      OR len(regexp_extract_all(x, '[|›»→•·]|::|>>')) > {MAX_SEPARATORS_A_WORD} * {_N} OR ({_N} <= {SHORT_LINE} AND NOT regexp_matches(x, '[.!?…。！？:;,]'))
      OR ({_N} <= {BOILERPLATE_WORDS} AND ({_PHRASES})))) AS good
  FROM w LEFT JOIN p USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 1 - length(array_to_string(good, '')) / greatest(length(array_to_string(l, '')), 1) <= {MAX_LOST} AS kept FROM m
"""
