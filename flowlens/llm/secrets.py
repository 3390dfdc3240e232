r"""Secret scans: patterns of known secrets, and character Markov models for the others.

Two first-order Markov models over the characters of tokens, one of random strings and one of ordinary identifiers, are
trained from labelled samples (pairs counted in Spark; the table of at most N*N counts comes to the driver). A token is a
secret if its log-likelihood ratio a character is over the threshold that parts the labelled samples best. Everything is a
SQL expression on one row: no shuffle of documents, no Python on the executors.

Base spans are whole matches of the patterns of the contract; a span of the models is added where it overlaps none of them.

Defined results: null text counts as empty and has no spans; repeated rows and null ids stay; columns of the input called
like an added one are replaced; samples that are null, or a label that is null, are ignored; without samples of both labels
the models are refused (ValueError).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import spans as S
from flowlens.llm.common import given_back, set_aside, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET)
KINDS = ["assign", "access", "hex", "random"]
#: A token of the models has at least so many characters.
MIN_TOKEN = 20
#: Labelled samples of each label in default_samples.
SAMPLES = 5_000

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"

#: Ordinary words that identifiers are made of.
WORDS = (
    "account action address after agent allow array async balance batch before block buffer build button cache call change "
    "channel check class client close code collection color column command commit common compare config connection content "
    "context control convert count create current customer data date default delete description device display document "
    "domain down element enable end engine entry error event example export factory field file filter final find first font "
    "format from function get global group handler hash header height history host identifier image import index info init "
    "input instance interface internal item iterator java kernel keyboard label language last layout length level library "
    "limit line list load local location login manager map market memory message method model module name network node "
    "notification number object observer offset option order output package page parameter parent parse path payment "
    "pattern person platform point position prefix previous process product profile project property protocol provider "
    "public query queue read record reference register remote render report request resource response result return root "
    "sample schedule screen search section select sequence server service session setting shared simple size source space "
    "stack standard start state status stream string style system table target task template test text the thread time "
    "title total trace transaction transform translation transport tree type update upload user utility value vector "
    "version view visible volume width window with word worker write und der die nicht eine werden haben verbindung "
    "geschwindigkeit gesellschaft verantwortung les des dans pour avec notre entreprise gouvernement developpement que para "
    "como desde informacion desarrollo gobierno organizacion international understanding nevertheless throughout"
).split()


def default_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """value, is_secret: n random strings (base64, letters and digits, mixed lengths) and n identifiers (snake, camel, kebab, path, upper case, run together), the same each time."""
    words = ", ".join(f"'{w}'" for w in WORDS)
    pick = lambda k: f"element_at(array({words}), cast(1 + pmod(xxhash64(id, {k}), {len(WORDS)}) as int))"
    parts = f"filter(array({', '.join(pick(k) for k in range(6))}), (w, i) -> i < 3 + pmod(id, 4))"
    base = spark.range(n)
    good = base.select(F.expr(parts).alias("w"), F.expr("pmod(xxhash64(id), 7)").alias("style")).select(
        F.expr(
            """case style when 0 then array_join(w, '_') when 1 then concat(w[0], array_join(transform(slice(w, 2, 9), x -> initcap(x)), ''))
            when 2 then array_join(w, '-') when 3 then array_join(w, '/') when 4 then upper(array_join(w, '_')) when 5 then initcap(array_join(w, '')) else array_join(w, '') end"""
        ).alias("value"),
        F.lit(False).alias("is_secret"),
    )
    bad = base.select(
        F.expr(
            f"""substring(case pmod(id, 3) when 0 then base64(unhex(sha2(cast(id as string), 256)))
            when 1 then regexp_replace(base64(unhex(sha2(concat('a', id), 512))), '[+/=\\r\\n]', '')
            else upper(regexp_replace(base64(unhex(sha2(concat('b', id), 512))), '[+/=\\r\\n]', '')) end, 1, cast({MIN_TOKEN} + pmod(xxhash64(id, 1), 24) as int))"""
        ).alias("value"),
        F.lit(True).alias("is_secret"),
    )
    return good.unionByName(bad)


def _ratio_sql(ratios: list[float], token: str) -> str:
    """SQL: mean log-likelihood ratio a pair of characters of token."""
    held = ",".join(f"{x:.4f}" for x in ratios)
    at = lambda i: f"instr('{ALPHABET}', substring({token}, {i}, 1))"
    pair = f"get(cast(split('{held}', ',') as array<double>), ({at('i - 1')} - 1) * {N} + {at('i')} - 1)"
    return f"(aggregate(sequence(2, length({token})), 0D, (a, i) -> a + {pair}) / (length({token}) - 1))"


class MarkovPair:
    """Log-likelihood ratios of character pairs, and the threshold of their mean over a token."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def is_secret_sql(self, token: str) -> str:
        return f"{_ratio_sql(self.ratios, token)} > {self.threshold:.6f}"


def train(samples: DataFrame, smoothing: float = 0.5) -> MarkovPair:
    """samples: value, is_secret. The threshold lies between the 99.9 % quantile of ordinary samples and the 1 % quantile of random ones."""
    good = samples.where(F.col("value").isNotNull() & F.col("is_secret").isNotNull()).select(
        F.regexp_replace("value", r"[^A-Za-z0-9+/_=\-]", "").alias("value"), "is_secret").where("length(value) > 1")
    pairs = good.select("is_secret", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("p"))
    counts = {(r["is_secret"], r["p"]): r["n"] for r in pairs.groupBy("is_secret", "p").agg(F.count("*").alias("n")).collect()}
    if len({k for k, _ in counts}) < 2:
        raise ValueError("samples of both labels are needed")
    firsts = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (False, True) for a in ALPHABET}
    log = lambda k, a, b: math.log((counts.get((k, a + b), 0) + smoothing) / (firsts[k, a] + smoothing * N))
    ratios = [log(True, a, b) - log(False, a, b) for a in ALPHABET for b in ALPHABET]
    scored = good.select("is_secret", F.expr(_ratio_sql(ratios, "value")).alias("r"))
    low, high = scored.agg(F.expr("percentile_approx(case when not is_secret then r end, 0.999, 10000)"), F.expr("percentile_approx(case when is_secret then r end, 0.01, 10000)")).first()
    return MarkovPair(ratios, (low + high) / 2)


def scan(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """docs with base (spans of the patterns) and found (those and the models' spans), each an array of kind, s, e, m."""
    out = docs.withColumn("fw_text", F.expr("coalesce(cast(text as string), '')"))
    out = S.propose(out, "fw_text", "assign", ASSIGN, f"length(regexp_extract(m, r'{ASSIGN}', 2)) >= 6")
    out = S.propose(out, "fw_text", "access", ACCESS, "length(m) >= 20", "contains(fw_text, 'AKIA')")
    out = S.propose(out, "fw_text", "hex", HEX, "length(m) >= 24")
    out = S.propose(out, "fw_text", "random", TOKEN, model.is_secret_sql("m"))
    out = out.withColumn("base", F.concat("fw_assign", "fw_access", "fw_hex"))
    out = out.withColumn("found", F.expr(f"concat(base, {S.apart('fw_random', 'base')})"))
    return out.drop("fw_text", *(f"fw_{k}" for k in KINDS))


def redact(docs: DataFrame, model: MarkovPair, label: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by label, and n_chars brought up to date where docs has it. The columns stay."""
    out = scan(set_aside(docs), model).withColumn("text", F.expr("cast(text as string)"))
    return given_back(out, docs, S.masked("text", "found", label), F.size("found") > 0)


def digest(scanned: DataFrame) -> DataFrame:
    n = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(S.ordered(KINDS, "base"), 256).alias("base_sha256"), S.ordered(KINDS, "found").alias("spans"))


def op7(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train(default_samples(spark))))
