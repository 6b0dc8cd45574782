"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Everything is DataFrame expressions. The patterns give base spans. Two first-order Markov models
over the characters of a candidate token (``CANDIDATE``: a long run of key characters) are
compared by the logarithm of their likelihood ratio; a token at least ``MIN_RATIO`` above 0 is a
span of kind ``markov`` unless it touches a base span. The models are trained from labelled
samples of bounded size: values that the patterns found are random strings, other long tokens of
letters are ordinary identifiers.

Keys need not be written like those that the patterns find. A token of more than one of small
letters, capitals and digits is also held against an even model over its own alphabet, and the
better ratio counts. What ordinary tokens of letters can't teach says little there: a digit after a
letter is never rarer than ``DIGIT``, and digits among themselves, ``/`` and ``+`` say nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.common import prepare
from logspark.llm.spans import bound, matches_of, parts_of, places

# The patterns of the base spans.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: A candidate: so many characters that keys are written with, a letter among them, not part of a longer run.
#: A run without letters is a number (of a card, an order, a day), of which no model tells a random one.
CANDIDATE = "(?<![A-Za-z0-9_+/-])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/-"
#: Log-likelihood ratio from which a token is taken for random (about one in a million by chance).
MIN_RATIO = math.log(1e6)
#: Labelled samples: documents with base spans, and documents without, at most so many of each.
SAMPLE_DOCS = 2_000
#: Weight of an even distribution in the smoothing of each row of a model.
EVEN = 8.0
#: Least probability of a given digit after a letter in ordinary identifiers.
DIGIT = 1 / (len(ALPHABET) * EVEN)
#: Alphabets of tokens: small letters, capitals and digits, two or three of them, with and without marks.
ALPHABETS = 8


def _base(text: Column, kind: str) -> Column:
    """Spans of a kind as array of (start, end, value, kind)."""
    if kind == "assign":
        found = places(parts_of(text, ASSIGN), matches_of(text, ASSIGN))
        value = matches_of(text, ASSIGN, 2)
        long = F.filter(F.zip_with(found, value, lambda s, v: F.struct(s["start"], s["end"], v.alias("value"))), lambda s: F.char_length(s["value"]) >= ASSIGN_MIN)
    else:
        # a run is matched as far as it goes, so the least length in the pattern drops just the short ones
        pattern = f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}" if kind == "access" else f"[0-9a-f]{{{HEX_MIN},}}"
        long = places(parts_of(text, pattern), matches_of(text, pattern))
    return F.transform(long, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _chance(kind: str) -> Column:
    """A cheap test that holds wherever there is a span; searches for fixed strings go first."""
    text = F.col("text")
    if kind == "assign":
        return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [low.contains(w) for w in _WORDS]))
    if kind == "access":
        return text.contains("AKIA") & text.rlike(f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4}}}")
    return text.rlike(f"[0-9a-f]{{{HEX_MIN}}}" if kind == "hex" else "[A-Za-z0-9_+/-]{16}")


def _where(kind: str, spans: Column) -> Column:
    """Spans only where a cheap test finds a chance of one."""
    return F.when(_chance(kind), spans).otherwise(F.array()).cast(_SPANS)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: all base spans by start, then kind."""
    out = docs
    for kind in KINDS[:3]:
        out = out.withColumn(f"_{kind}", _where(kind, _base(F.col("text"), kind)))
    return out.withColumn("base", F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS[:3]])))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``tokens``: spans of candidate tokens that touch no base span."""
    found = places(parts_of(F.col("text"), CANDIDATE), matches_of(F.col("text"), CANDIDATE))
    found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    out = docs.withColumn("_all", _where("markov", found))
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return out.withColumn("tokens", F.filter("_all", apart)).drop("_all")


def _pairs(values: DataFrame) -> DataFrame:
    """Counts of neighbouring characters; at most the square of the alphabet."""
    two = F.transform(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    pairs = values.filter(F.char_length("value") > 1).select(F.explode(two).alias("pair"))
    return pairs.filter(pairs["pair"].rlike(f"^[{ALPHABET}]{{2}}$")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """Logarithm of P(second | first) under random strings over that under ordinary ones, row by row."""
    size, out = len(ALPHABET), []
    for a in ALPHABET:
        r, o = ([counts.get(a + b, 0) for b in ALPHABET] for counts in (random, ordinary))
        for x, y in zip(r, o, strict=True):
            out.append(math.log((x + EVEN / size) / (sum(r) + EVEN)) - math.log((y + EVEN / size) / (sum(o) + EVEN)))
    return out


def surprises(ordinary: dict[str, int]) -> list[float]:
    """-log P(second | first) under ordinary strings, row by row; 0 where they can't tell.

    Letters are counted without case, with backoff to the second character alone; a capital
    follows a small letter once in ``EVEN`` times, and any other character every second time.
    """
    pairs, heads, tails = Counter(), Counter(), Counter()
    for (a, b), n in ordinary.items():
        a, b = a.lower(), b.lower()
        pairs[a, b] += n
        heads[a] += n
        tails[b] += n
    size, total, out = len(set(ALPHABET.lower())), sum(tails.values()), []
    for first in ALPHABET:
        for second in ALPHABET:
            a, b = first.lower(), second.lower()
            p = (pairs[a, b] + EVEN * (tails[b] + EVEN / size) / (total + EVEN)) / (heads[a] + EVEN)
            if second.isalpha():
                capital = 1 / EVEN if first.islower() else 0.5
                p *= capital if second.isupper() else 1 - capital
            silent = (a.isdigit() and b.isdigit()) or "/" in a + b or "+" in a + b
            out.append(0.0 if silent else -math.log(max(p, DIGIT) if b.isdigit() else p))
    return out


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[list[float], list[float]]:
    """The ratio table and the surprises from at most ``sample`` texts with base spans and as many others.

    The samples are the different texts of smallest hash. Without a base span the random model is
    even.
    """
    order = F.xxhash64("text")
    hit = base_spans(docs.filter(reduce(or_, map(_chance, KINDS[:3]))).select("text")).filter(F.size("base") > 0)
    hit = hit.select(F.col("base.value").alias("values"), order.alias("o")).groupBy("o").agg(F.first("values").alias("values"))
    hit = hit.orderBy("o").limit(sample).select(F.explode("values").alias("value"))
    least = docs.select(order.alias("o")).distinct().orderBy("o").limit(sample)
    plain = docs.select("text", order.alias("o")).join(F.broadcast(least), "o", "left_semi").groupBy("o").agg(F.first("text").alias("text"))
    word = "(?<![A-Za-z0-9_+/-])[A-Za-z_-]{6,}(?![A-Za-z0-9_+/-])"
    plain = plain.select(F.explode(matches_of(F.col("text"), word)).alias("value"))
    random, ordinary = ({r["pair"]: r["n"] for r in _pairs(x).collect()} for x in (hit, plain))  # at most the square of the alphabet each
    return log_ratios(random, ordinary), surprises(ordinary)


def _codes(value: Column) -> Column:
    """Places of a value's characters in the alphabet."""
    return F.transform(F.sequence(F.lit(1), F.char_length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1)


def _over_pairs(codes: Column, table: list[float], change: Callable[[Column], Column]) -> Column:
    """Sum of the changed table values over neighbouring characters of a value of the alphabet."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded once, when planned
    steps = F.sequence(F.lit(1), F.size(codes) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + change(F.get(values, F.get(codes, i - 1) * len(ALPHABET) + F.get(codes, i))))


def ratio_of(codes: Column, table: list[float]) -> Column:
    """Log ratio under the random model that the patterns' values taught."""
    return _over_pairs(codes, table, lambda x: x)


def even_ratio_of(value: Column, codes: Column, table: list[float]) -> Column:
    """Log ratio under an even model over the value's own alphabet; null for one kind of characters."""
    kinds = [value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")]
    size = 26 * kinds[0] + 26 * kinds[1] + 10 * kinds[2] + 2 * value.rlike("[_/+-]").cast("int")
    ratio = bound(F.log(size.cast("double")), lambda even: _over_pairs(codes, table, lambda x: F.when(x > 0, x - even).otherwise(0.0)))
    return F.when(kinds[0] + kinds[1] + kinds[2] > 1, ratio - math.log(ALPHABETS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov``, ``base_sha256``, ``spans``, ``found``.

    ``found`` is the array of (start, kind, end, value), ``spans`` the same as text
    ``kind:start:end``, by start, then kind; ``base_sha256`` is the digest of that text over base
    spans alone. Places count code points, ends are exclusive. Null and empty texts hold nothing.
    Rows are scanned one by one, so repeated rows and null ids stay. Other columns are neither
    read nor returned.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table, surprise = train(rows, sample)
    out = candidates(base_spans(rows))
    random = F.filter("tokens", lambda t: bound(_codes(t["value"]), lambda c: F.greatest(ratio_of(c, table), even_ratio_of(t["value"], c, surprise)) >= min_ratio))
    out = out.withColumn("_markov", random)
    out = out.withColumn("found", F.sort_array(F.concat("base", "_markov")))
    name = lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])
    joined = lambda c: F.array_join(F.transform(c, name), ",")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    out = out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), "found")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
