"""Secrets in texts: three fixed patterns, and a battery of randomness tests.

Beside the patterns, every run of at least ``MIN_RUN`` encoding characters with
a letter and a digit is a candidate.  A run that mixes signs of base64 with
those of base64url fits no encoding: its pieces between '+' and '/', and those
between '_' and '-', are the candidates instead.  A candidate's encoding is inferred (hex, base32,
base36, base62, base64, base64url) and four tests ask whether its symbols can
be uniform random draws from that alphabet: chi-squared of the symbol counts and
of the counts by class (capitals, small letters, digits, signs), which has power
where a short string leaves the symbols none (both by the Wilson-Hilferty
transformation), the runs test about the middle of the alphabet, and lag-1 serial
correlation.  Fisher's method joins the p-values.

Length-aware false-discovery control: a false discovery is structured text
reported as a secret.  How structured text does in the tests comes from the
corpus itself: each candidate has a decoy, the words in front of it run together
to as many letters (capitals at their starts, where the encoding has both cases;
from ``LEAST_PROSE`` letters on repeated as needed) and the candidate's own digits
and signs behind them; to hex, digits are letters like others, and the decoy has
none.  A candidate without enough prose in front has no decoy: it does not count
in the estimate and is judged by the threshold of its stratum; in a stratum
without any decoy only ``LEAST_P`` decides.  Within each stratum of encoding and
length class (two to each doubling), the step-up takes the lowest p-value above
which there are at most ``FDR`` times as many decoys as candidates that have one; candidates
above it are reported, if randomness itself stands (``LEAST_P``).  So where a
length leaves the tests no power against prose, its decoys pass like its
candidates and nothing is reported.  The step-up works on counts by p-value bin
(each counted whole), at most ``BINS`` rows a stratum, so no stratum is ever
ranked row by row, and its thresholds are at most one row for each of 7
encodings and 64 length classes: that table is broadcast.

Only built-in functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

# Fixed values of the contract: the kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",  # maximal runs, so the shorter ones need not be found first
    "random": r"[A-Za-z0-9+/_-]{20,}",
}
MIN_SECRET, MIN_ACCESS, MIN_RUN = 6, 20, 20
FDR, LEAST_P, BINS_PER_DECADE, BINS = 0.05, 1e-3, 20, 400
#: Code points in front of a candidate that its decoy is made of, and letters from which on they are repeated for a longer one.
CONTEXT, LEAST_PROSE = 2000, 500

HEX, B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding, what a run in it looks like, alphabet in order; the first that fits holds.
ENCODINGS = (  # and below, how prose is brought into each alphabet
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", HEX),
    ("base32", "^[A-Z2-7]+$", B32),
    ("base36 lower", "^[a-z0-9]+$", DIGITS + LOWER),
    ("base36 upper", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Classes of symbols, and how many of each an alphabet has.
CLASSES = ("[A-Z]", "[a-z]", "[0-9]", "[+/_-]")
PROSE = {"hex": ("lower", "[^a-f]"), "base32": ("upper", "[^A-Z]"), "base36 lower": ("lower", "[^a-z]"), "base36 upper": ("upper", "[^A-Z]")}
ANY_CASE = ("initcap", "[^A-Za-z]")


def found(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, version, kind, start, end, match, secret, before): all matches of these kinds' patterns, by code points.

    Between the matches lie the pieces of a split at the same pattern; a match
    starts behind all pieces and matches before it.
    """
    rows = docs.withColumns({kind: F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)) for kind in kinds})
    any_match = F.lit(False)
    for kind in kinds:
        any_match = any_match | (F.size(kind) > 0)
    rows = rows.filter(any_match)
    per_kind = [
        F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.col(kind).alias("matches"),
            (F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(2)) if kind == "assign" else F.col(kind)).alias("secrets"),
            F.transform(F.split("text", PATTERNS[kind], -1), lambda p: F.length(p)).alias("gaps"),
            (F.transform(F.split("text", PATTERNS[kind], -1), lambda p: F.right(p, F.lit(CONTEXT))) if kind == "random" else F.lit(None).cast("array<string>")).alias("before"),
        )
        for kind in kinds
    ]
    rows = rows.select("doc_id", "version", F.explode(F.array(*per_kind)).alias("k")).filter(F.size("k.matches") > 0)
    rows = rows.select("doc_id", "version", "k.kind", F.posexplode(F.arrays_zip("k.matches", "k.secrets", "k.gaps", F.coalesce("k.before", F.array().cast("array<string>")).alias("before"))).alias("place", "m"))
    rows = rows.filter(F.col("m.matches").isNotNull())  # the last piece has no match behind it
    rows = rows.select("doc_id", "version", "kind", "place", F.col("m.matches").alias("match"), F.col("m.secrets").alias("secret"), F.col("m.gaps").alias("gap"), F.col("m.before").alias("before"))
    rows = rows.dropDuplicates(["doc_id", "version", "kind", "place"])
    so_far = Window.partitionBy("doc_id", "version", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
    return rows.withColumn("start", F.col("end") - F.length("match")).select("doc_id", "version", "kind", "start", "end", "match", "secret", "before")


def pieces(runs: DataFrame) -> DataFrame:
    """The runs (of ``found``), those that fit no encoding cut at the signs of base64 and again at those of base64url.

    A piece of only letters and digits that both cuts leave is one; one of fewer than ``MIN_RUN`` is none.
    """
    mixed = F.col("match").rlike("[+/]") & F.col("match").rlike("[_-]")

    def cut(signs: str) -> Column:
        parts = F.split("match", signs, -1)
        before = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, q: n + F.length(q) + 1))
        return F.zip_with(parts, before, lambda p, n: F.struct(n.cast("bigint").alias("at"), p.alias("piece")))

    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.col("match").alias("piece")))
    own = F.filter(F.array_distinct(F.concat(cut("[+/]"), cut("[_-]"))), lambda p: F.length(p["piece"]) >= MIN_RUN)
    rows = runs.withColumn("piece", F.explode(F.when(mixed, own).otherwise(whole)))
    rows = rows.withColumns({"start": F.col("start") + F.col("piece.at"), "match": F.col("piece.piece")})
    return rows.withColumns({"end": F.col("start") + F.length("match"), "secret": F.col("match")}).select(*runs.columns)


def with_tails(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds <name>_p = P(|N(0, 1)| > |z|) for each column of z values, step by step, so no step repeats the one before.

    The rational approximation of erfc has an absolute error below 1.5e-7; results count as 1e-12 at least.
    """
    rows = rows.withColumns({f"{n}_x": F.abs(n) / F.sqrt(F.lit(2.0)) for n in names})
    rows = rows.withColumns({f"{n}_t": 1 / (1 + 0.3275911 * F.col(f"{n}_x")) for n in names})

    def tail(n: str) -> Column:
        t, x = F.col(f"{n}_t"), F.col(f"{n}_x")
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.greatest(poly * F.exp(-x * x), F.lit(1e-12))

    return rows.withColumns({f"{n}_p": tail(n) for n in names}).drop(*[f"{n}_{c}" for n in names for c in "xt"])


def with_decoys(candidates: DataFrame) -> DataFrame:
    """Candidates (match, before) that have a letter and a digit, with encoding, alphabet, token and decoy = false; and their decoys, where the text in front suffices."""
    fits = F.lit(None).cast("int")
    for i, (_, shape, _) in reversed(list(enumerate(ENCODINGS))):
        fits = F.when(F.col("match").rlike(shape), i).otherwise(fits)
    told = {"encoding": [n for n, _, _ in ENCODINGS], "alphabet": [a for _, _, a in ENCODINGS], "case": [PROSE.get(n, ANY_CASE)[0] for n, _, _ in ENCODINGS], "others": [PROSE.get(n, ANY_CASE)[1] for n, _, _ in ENCODINGS]}
    told["classes"] = [[len(re.findall(c, a)) for c in CLASSES] for _, _, a in ENCODINGS]
    facts = F.array(*[F.struct(*[F.lit(values[i]).alias(n) for n, values in told.items()]) for i in range(len(ENCODINGS))])
    rows = candidates.filter(F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]"))
    # An explode of one element keeps what follows from repeating the tests of the encodings.
    rows = rows.withColumn("f", F.explode(F.array(F.get(facts, fits)))).filter("f IS NOT NULL")
    text = F.when(F.col("f.case") == "lower", F.lower("before")).when(F.col("f.case") == "upper", F.upper("before")).otherwise(F.initcap("before"))
    rows = rows.withColumns({"encoding": F.col("f.encoding"), "alphabet": F.col("f.alphabet"), "classes": F.col("f.classes"), "prose": F.regexp_replace(text, F.col("f.others"), F.lit(""))})
    own = F.when(F.col("encoding") == "hex", F.lower("match")).otherwise(F.col("match"))
    signs = F.when(F.col("encoding") == "hex", F.lit("")).otherwise(F.regexp_replace("match", "[A-Za-z]", ""))
    letters = F.length("match") - F.length(signs)
    prose = F.length("prose")
    longer = F.repeat("prose", F.ceil(letters / F.greatest(prose, F.lit(1))).cast("int"))
    like = F.when(prose >= letters, F.concat(F.right("prose", letters), signs)).when(prose >= LEAST_PROSE, F.concat(F.right(longer, letters), signs))
    told = [F.struct(token.alias("token"), F.lit(decoy).alias("decoy"), (prose >= F.least(letters, F.lit(LEAST_PROSE))).alias("paired")) for token, decoy in ((own, False), (like, True))]
    return rows.withColumn("t", F.explode(F.array(*told))).select(*candidates.columns, "encoding", "alphabet", "classes", "t.*").filter("token IS NOT NULL")


def tested(candidates: DataFrame) -> DataFrame:
    """``with_decoys`` with n and p: the joint p-value of uniform randomness."""
    rows = with_decoys(candidates).withColumn("n", F.length("token").cast("double")).withColumn("a", F.length("alphabet").cast("double"))
    codes = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - (F.col("a") + 1) / 2)
    rows = rows.withColumn("x", codes)
    squares = F.aggregate(
        F.filter(F.split("alphabet", ""), lambda c: c != ""),
        F.lit(0.0),
        lambda s, c: s + F.pow(F.col("n") - F.length(F.replace(F.col("token"), c)), F.lit(2.0)),
    )
    rows = rows.withColumn("chi", F.col("a") / F.col("n") * squares - F.col("n"))

    def normal(chi: Column, k: Column) -> Column:
        return (F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))

    seen = F.array(*[F.length(F.regexp_replace("token", c.replace("[", "[^", 1), "")).cast("double") for c in CLASSES])
    rows = rows.withColumns({"of_class": seen, "degrees": F.size(F.filter("classes", lambda c: c > 0)).cast("double") - 1})
    expected = F.transform("classes", lambda c: F.col("n") * c / F.col("a"))
    by_class = F.aggregate(F.zip_with("of_class", expected, lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    chi_z, class_z = normal(F.col("chi"), F.col("a") - 1), normal(by_class, F.col("degrees"))
    high = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.when(v > 0, 1.0).otherwise(0.0))
    pairs = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n")
    rows = rows.withColumns({"pairs": pairs, "high": high, "mean": mean})
    changes = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.when((p["u"] > 0) != (p["v"] > 0), 1.0).otherwise(0.0))
    spread = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    lagged = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["u"] - F.col("mean")) * (p["v"] - F.col("mean")))
    rows = rows.withColumns({"runs": changes + 1, "both": 2 * F.col("high") * (F.col("n") - F.col("high")), "spread": spread, "lagged": lagged})
    both, n = F.col("both"), F.col("n")
    runs_z = F.when(both == 0, F.lit(9.0)).otherwise((F.col("runs") - 1 - both / n) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9))))
    serial_z = F.when(F.col("spread") == 0, F.lit(9.0)).otherwise((F.col("lagged") / F.col("spread") + 1 / (n - 1)) * F.sqrt(n))
    rows = with_tails(rows.withColumns({"chi_z": chi_z, "class_z": class_z, "runs_z": runs_z, "serial_z": serial_z}), ["chi_z", "class_z", "runs_z", "serial_z"])

    def above(name: str) -> Column:
        return F.greatest(F.when(F.col(name) >= 0, F.col(f"{name}_p") / 2).otherwise(1 - F.col(f"{name}_p") / 2), F.lit(1e-12))

    half = -(F.ln(above("chi_z")) + F.ln(above("class_z")) + F.ln("runs_z_p") + F.ln("serial_z_p"))  # half of Fisher's statistic, 8 degrees of freedom
    h = F.col("half")
    rows = rows.withColumn("half", half).withColumn("p", F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6))
    return rows.select(*candidates.columns, "encoding", "decoy", "paired", "n", "p")


def still_random(rows: DataFrame, fdr: float = FDR) -> DataFrame:
    """The candidates among the rows of ``tested`` that the step-up of their stratum reports."""
    rows = rows.withColumn("length_class", F.floor(2 * F.log2("n")))
    p_bin = F.least(F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) * BINS_PER_DECADE), F.lit(BINS))
    rows = rows.withColumn("p_bin", p_bin)
    stratum = ["encoding", "length_class"]
    bins = rows.groupBy(*stratum, "p_bin").agg(F.count_if(~F.col("decoy") & F.col("paired")).alias("candidates"), F.count_if("decoy").alias("decoys"))
    above = Window.partitionBy(*stratum).orderBy("p_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumns({c: F.sum(c).over(above) for c in ("candidates", "decoys")})
    # A filter on p would be moved below the steps that make p, and repeat them; so its least value is a bound of the cut.
    least = math.floor(-math.log10(LEAST_P) * BINS_PER_DECADE)
    cut = bins.filter(F.col("decoys") <= fdr * F.col("candidates")).groupBy(*stratum).agg(F.least(F.max("p_bin"), F.lit(least)).alias("cut"))
    return rows.filter(~F.col("decoy")).join(F.broadcast(cut), stratum).filter(F.col("p_bin") <= F.col("cut"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_spans, spans) for every row of ``docs``; spans are arrays of (start, kind, end).

    Kinds are numbered as in ``KINDS``; offsets are code points, the end is
    exclusive, and spans are in order of start, then kind.  A null or empty text
    has none.  Repeated rows and ids come back row by row, null ids too; the
    tests count a fully repeated row once.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    fixed = found(base, KINDS[:3]).filter(
        ((F.col("kind") == 0) & (F.length("secret") >= MIN_SECRET)) | ((F.col("kind") == 1) & (F.length("match") >= MIN_ACCESS)) | (F.col("kind") == 2)
    )
    random = still_random(tested(pieces(found(base, KINDS[3:]))), fdr)
    columns = ["doc_id", "version", "kind", "start", "end"]
    spans = fixed.select(columns).unionByName(random.select(columns))
    span = F.struct("start", "kind", "end")
    per_doc = spans.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    per_doc = per_doc.select(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version"), "spans")
    out = base.select("doc_id", "version").join(per_doc, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")), "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.filter("spans", lambda s: s["kind"] < 3).alias("base_spans"), "spans"
    )


def span_text(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
