"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans: assignments of eight or more characters to a secret's name, access keys, and
hexadecimal runs. The battery looks for further ones among the tokens of 20 or more letters, digits and ``+/_-``
that meet no base span. The narrowest alphabet that holds a token is its inferred encoding, and every distinct
token is tested once:

* uniformity: the chi-squared statistic of the symbol counts, against the encoding's even use of its alphabet;
* runs: the number of runs in the lower and the upper half of the alphabet;
* serial correlation: neighbouring symbols' places in the alphabet.

A token that fails one of them (two-sided for the last two, with the three tests shared out) is structured, not
random. For the others the question is whether text could look as even: under text with the encoding's index of
coincidence the statistic is non-central, with an offset that grows with the length, so a long token has to look
as even as a short one only relative to its length. Those p-values go through the Benjamini-Hochberg rule within
each class of lengths, so many short tokens don't hide a long one. The rule reads a histogram of fixed size (half
octaves of p), as a step-up on its edges.

Where the matches lie follows from the lengths of the pieces between them; the texts are read once, and a match
travels as its lengths (and a token as itself), keyed by row.

Defined results: a null text is an empty one and has no spans. A row is judged by its own text, also where rows or
ids repeat or are null; equal tokens are judged alike. Positions are code points, ends exclusive. Spans that begin
together are ordered assign, access, hex, random. An empty table gives no rows; extra columns are ignored. A text
of any length is one row, its spans one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopsight.llm import common as C

KINDS = ("assign", "access", "hex", "random")
# The patterns of the base spans. A key or a run that is too short never hides a longer one.
ASSIGN = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 8

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from narrow to wide, and the index of coincidence that text written in them has at least.
ENCODINGS = (
    ("[0-9]+", _DIGITS, 0.125), ("[0-9a-f]+", _DIGITS + "abcdef", 0.1), ("[0-9A-F]+", _DIGITS + "ABCDEF", 0.1),
    ("[a-z]+", _LOWER, 0.065), ("[A-Z2-7]+", _UPPER + "234567", 0.06), ("[a-z0-9]+", _LOWER + _DIGITS, 0.06),
    ("[A-Za-z]+", _UPPER + _LOWER, 0.06), ("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS, 0.055),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/", 0.055), ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_", 0.055),
    (".*", _UPPER + _LOWER + _DIGITS + "+/-_", 0.055))
LENGTHS = (28, 40, 64)  # where the classes of lengths begin anew
STRUCTURED, FALSE_DISCOVERIES = 0.01, 0.05
_HALVES = 120  # half octaves of the histogram
# The polynomial of the normal distribution's upper tail.
_TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _found(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """All matches of one kind: characters between the match before and it, its length, whether it counts, and the token."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda piece: F.char_length(piece))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    least = LEAST_VALUE if group else 0
    cells = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda gap, match: F.struct(
        gap.alias("gap"), match.alias("match"))), value, lambda cell, v: F.struct(
        F.lit(kind).alias("kind"), cell["gap"].alias("gap"), F.char_length(cell["match"]).alias("length"),
        (F.char_length(v) >= least).alias("counts"),
        (cell["match"] if kind == 3 else F.lit(None).cast("string")).alias("token")))
    return F.when(text.rlike(pattern), cells).otherwise(F.array().cast(
        "array<struct<kind:int,gap:int,length:int,counts:boolean,token:string>>"))


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal above z (of -z below 0, turned round)."""
    t = 1 / (1 + _TAIL[0] * F.abs(z))
    poly = t * (_TAIL[1] + t * (_TAIL[2] + t * (_TAIL[3] + t * (_TAIL[4] + t * _TAIL[5]))))
    beyond = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, beyond).otherwise(1 - beyond)


def battery(tokens: DataFrame) -> DataFrame:
    """token, length class, structured, and p: the chance that text of that length looks as even."""
    alphabet, coincidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for pattern, symbols, index in reversed(ENCODINGS):
        fits = F.col("token").rlike(f"^{pattern}$")
        alphabet = F.when(fits, symbols).otherwise(alphabet)
        coincidence = F.when(fits, F.lit(index)).otherwise(coincidence)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    one = tokens.select("token", alphabet.alias("alphabet"), coincidence.alias("coincidence"),
                        F.char_length("token").alias("n")).withColumn("k", F.char_length("alphabet"))
    squares = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: n - F.char_length(
        F.replace(F.col("token"), F.substr(F.col("alphabet"), i, F.lit(1)), F.lit("")))), F.lit(0.0), lambda s, c: s + c * c)
    low = F.floor(k / 2)
    halves = F.expr("translate(token, alphabet, concat(repeat('0', k div 2), repeat('1', k - k div 2)))")
    places = F.transform(F.split("token", ""), lambda symbol: F.instr(F.col("alphabet"), symbol) - 1 - (k - 1) / 2)
    one = one.select("token", "n", "k", "coincidence", squares.alias("squares"),
                     F.char_length(F.regexp_replace(halves, "0+|1+", "x")).alias("runs"), (low / k).alias("q"), places.alias("places"))
    products = F.aggregate(F.zip_with(F.slice("places", F.lit(1), F.col("n") - 1), F.slice("places", F.lit(2), F.col("n") - 1),
                                      lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    x, df = k / n * F.col("squares") - n, k - 1
    q = F.col("q")
    s2, s3 = q * q + (1 - q) * (1 - q), q * q * q + (1 - q) * (1 - q) * (1 - q)
    spread = (n - 1) * (s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2)
    offset = n * (k * F.col("coincidence") - 1)
    one = one.select(
        "token", sum((F.when(F.col("n") >= edge, 1).otherwise(0) for edge in LENGTHS), F.lit(0)).alias("length_class"),
        ((F.cbrt(x / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("uneven"),
        (((n - F.col("runs")) - (n - 1) * s2) / F.sqrt(spread)).alias("few_runs"),
        (products / ((k * k - 1) / 12 * F.sqrt(n - 1))).alias("serial"),
        ((df + offset - x) / F.sqrt(2 * (df + 2 * offset))).alias("even"))
    worst = F.least(upper_tail(F.col("uneven")), 2 * upper_tail(F.abs("few_runs")), 2 * upper_tail(F.abs("serial")))
    return one.select("token", "length_class", (3 * worst < STRUCTURED).alias("structured"), upper_tail(F.col("even")).alias("p"))


def discoveries(tested: DataFrame) -> DataFrame:
    """The tokens that stay after the false-discovery rule of their length class."""
    halves = F.least(F.lit(_HALVES), F.floor(-2 * F.log2(F.greatest("p", F.lit(1e-30)))).cast("int"))
    tested = tested.withColumn("step", F.when(F.col("structured"), F.lit(0)).otherwise(F.greatest(F.lit(0), halves)))
    bins = tested.groupBy("length_class", "step").agg(F.count("*").alias("n"))  # at most four classes of _HALVES + 1 bins
    down = W.partitionBy("length_class").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    edges = bins.select("length_class", "step", F.sum("n").over(down).alias("rank"),
                        F.sum("n").over(W.partitionBy("length_class")).alias("all"))
    first = edges.where(F.col("step") > 0).where(
        F.col("all") * F.pow(F.lit(2.0), -F.col("step") / 2) <= FALSE_DISCOVERIES * F.col("rank")).groupBy("length_class").agg(
        F.min("step").alias("first"))
    return tested.join(F.broadcast(first), "length_class").where("step >= first").select("token")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans (kind:start:end, comma-joined) of every row."""
    docs = C.query_columns(docs, doc_id="long", text="string")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(_found(text, 0, ASSIGN, 2), _found(text, 1, ACCESS), _found(text, 2, HEX), _found(text, 3, TOKEN))
    rows = C.stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")), "matches")

    cells = rows.select("row", F.posexplode("found").alias("at", "cell")).select("row", "at", "cell.*")
    upto = F.sum(F.col("gap") + F.col("length")).over(
        W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    spans = cells.select("row", "kind", "token", "counts", (upto - F.col("length")).alias("start"), upto.alias("end")).where("counts")
    # a token that meets a base span is part of a find already
    before = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    base = F.col("kind") < 3
    spans = C.stage(spans.withColumns({"reached": F.max(F.when(base, F.col("end"))).over(before),
                                       "next": F.min(F.when(base, F.col("start"))).over(after)}).where(
        base | ((F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))), "spans")

    tokens = spans.where("kind = 3").select("token").distinct()
    flagged = discoveries(C.stage(battery(tokens), "tested"))
    random = spans.where("kind = 3").join(flagged, "token")
    columns = ["row", "kind", "start", "end"]
    everything = spans.where("kind < 3").select(*columns).union(random.select(*columns))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    each = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("span"))
    listed = everything.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.array_sort(F.collect_list(each)).alias("all"))
    joined = lambda kinds: F.array_join(F.transform(F.filter("all", lambda s: s["kind"] < kinds), lambda s: s["span"]), ",")
    listed = listed.select("row", *[f"n_{k}" for k in KINDS[:3]], joined(3).alias("base_spans"), joined(4).alias("spans"))
    none = F.lit(0).cast("long")
    return rows.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in KINDS[:3]],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])
