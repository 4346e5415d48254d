"""Secret scans: fixed patterns and character Markov models.

Everything is DataFrame functions.  Positions are code points, ends exclusive.

Patterns.  Matches are found leftmost and without overlap by kind.  Their
positions come from the pieces between matches: splitting by the same pattern
gives the gaps, and running sums of gap and match lengths give the starts.  A
text with n matches costs n log n.

Markov models.  Two first-order character models over the characters that
tokens are made of, one of random strings and one of ordinary identifiers, are
fitted with add-one smoothing on labelled samples (``labelled_samples`` makes
them by rule; own ones can be given).  A token of 20 or more characters with a
letter and a digit is a secret if its mean log-likelihood ratio per transition
exceeds ``threshold``.  Such spans are added where no pattern's span overlaps.

Defined cases: null or empty text has no spans; spans that start at one place are
in the order of their kinds, and a token of only letters or only digits, or of fewer
than 20 characters, is no secret to the models, whatever it looks like; the models never take spans
away; very long texts are searched whole; the same row twice gives the same result
twice; an empty table gives an empty result; extra columns are carried along,
whatever their names (``spans`` is replaced).
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import carried, own_names

#: The patterns of the kinds, in their order.
ASSIGN_BASE = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run shorter than the bound holds no longer run, so the bounds can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SPANS = "array<struct<start: bigint, kind: int, end: bigint, match: string>>"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 6
#: Characters of the models; all others count as one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Parts that ordinary identifiers are made of.
PARTS = (
    "account action active address admin agent array async backup balance base batch begin binary block body buffer build button cache "
    "call card channel char check child class clean client clock close code column command commit config connect content context "
    "control copy count create current custom data date debug default delete depth device digest direct document domain driver edge "
    "element email enable encode end engine entry error event exchange execute export factory feature field file filter final find "
    "flag format frame function gateway global graph group handle handler header height hidden history host icon image import index "
    "info input insert install instance interface item job join kernel label language layer layout length level library line link "
    "list load local location lock log login machine main manager map mask master match memory menu merge message method metric "
    "model module monitor mount name network node notify number object offset open option order output owner package page parent"
).split()


def labelled_samples(count: int = 3000, seed: int = 5) -> list[tuple[str, bool]]:
    """(token, is_random), half of each, made by rule from the seed."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:62], ALPHABET[:64]]
    out: list[tuple[str, bool]] = []
    for i in range(count // 2):
        letters = alphabets[i % len(alphabets)]
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 48))), True))
        parts = [rng.choice(PARTS) for _ in range(rng.randint(3, 6))]
        style = i % 4
        if style == 0:
            name = "_".join(parts)
        elif style == 1:
            name = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 2:
            name = "-".join(parts)
        else:
            name = "_".join(parts).upper()
        out.append((name + (f"{'_-'[i % 2]}{rng.randint(0, 2030)}" if i % 3 else ""), False))
    return out


def log_ratios(samples: list[tuple[str, bool]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) for all pairs of characters, row by row."""
    n = len(ALPHABET) + 1
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    for token, is_random in samples:
        codes = [place.get(c, n - 1) for c in token]
        for a, b in zip(codes, codes[1:], strict=False):
            counts[is_random][a * n + b] += 1
    out = []
    for a in range(n):
        sums = {k: sum(v[a * n : a * n + n]) for k, v in counts.items()}
        for b in range(n):
            out.append(round(math.log(counts[True][a * n + b] / sums[True]) - math.log(counts[False][a * n + b] / sums[False]), 6))
    return out


def score_token(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.aggregate(
        F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda a, b: (a - 1) * n + b),
        F.lit(0.0),
        lambda total, at: total + F.element_at(table, at.cast("int")),
    )
    return pairs / (F.length(token) - 1)


def running(values: Column, zero: Column, combine) -> Column:
    """Running totals of an array in log2(n) doubling steps: linear work each, and no array that grows item by item."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        shift = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(acc))
        moved = F.concat(F.array_repeat(zero, shift), F.slice(acc, F.lit(1), F.size(acc) - shift))
        return F.zip_with(acc, moved, combine)

    return F.aggregate(steps, values, double)


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end, match>> of all matches; ``keep`` may drop some by their text."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, match: F.struct((F.length(gap) + F.length(match)).cast("long").alias("n"), match.alias("match")))

    def placed(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda x: x["n"]), F.lit(0).cast("long"), lambda x, y: x + y)
        span = lambda x, end: F.struct((end - F.length(x["match"])).cast("long").alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
        return F.zip_with(pieces, ends, span)

    # bound once: a column named twice would be worked out twice
    spans = F.flatten(F.transform(F.array(pieces), placed))
    spans = F.when(F.rlike(text, p), spans).otherwise(F.array().cast(SPANS))
    return F.filter(spans, keep) if keep else spans


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps: of the base spans that start before a token's end none ends after its start."""
    event = lambda at, first, end, token: F.struct(at.alias("at"), first.alias("first"), end.alias("end"), token.alias("token"))
    none = F.lit(None).cast(SPANS[6:-1])
    ends = F.transform(tokens, lambda t: event(t["end"], F.lit(0), F.lit(-1).cast("long"), t))
    starts = F.transform(base, lambda s: event(s["start"], F.lit(1), s["end"], none))

    def pick(events: Column) -> Column:
        latest = running(F.transform(events, lambda e: e["end"]), F.lit(-1).cast("long"), lambda x, y: F.greatest(x, y))
        judged = F.zip_with(events, latest, lambda e, end: F.when(end <= e["token"]["start"], e["token"]))
        return F.filter(judged, lambda t: t.isNotNull())

    sorted_ = F.array_sort(F.concat(ends, starts))
    return F.when(F.size(base) == 0, tokens).when(F.size(tokens) == 0, tokens).otherwise(F.flatten(F.transform(F.array(sorted_), pick)))


def scan(docs: DataFrame, text: str = "text", threshold: float = 0.4, samples: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Adds ``spans``: array<struct<start, kind, end, match>> by start, then kind (0..3 as in KINDS)."""
    ratios = log_ratios(samples if samples is not None else labelled_samples())
    body = F.coalesce(F.col(text), F.lit(""))
    assigned = spans_of(body, ASSIGN_BASE, 0, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_BASE, 2)) >= ASSIGN_LEAST)
    tokens = spans_of(
        body,
        TOKEN,
        3,
        lambda s: F.rlike(s["match"], F.lit("[0-9]")) & F.rlike(s["match"], F.lit("[A-Za-z]")) & (score_token(s["match"], ratios) > threshold),
    )
    base, added = own_names(docs, "base", "tokens")
    found = docs.withColumn(base, F.concat(assigned, spans_of(body, ACCESS, 1), spans_of(body, HEX, 2))).withColumn(added, tokens)
    return found.select(*carried(docs, "spans"), F.array_sort(F.concat(F.col(base), apart(F.col(added), F.col(base)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
