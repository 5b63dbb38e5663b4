r"""Op 9: secret scans with a battery of randomness tests, in DataFrame functions alone.

Three kinds of spans are found by their form: assignments to secret names, access keys and hex digests. On top,
each other run of 20 or more characters that encodings use is a candidate. Its encoding is the smallest alphabet
that holds it; dashes between groups of hexadecimal digits only part them. Over that alphabet three statistics are taken: the chi-squared of uniform use (as the number of pairs
of equal characters, which it is a linear function of), the runs of its classes (lower case, capitals, digits, signs; the two
halves of an alphabet of one class) as changes between neighbours, and the serial correlation of neighbours. Each is held
against both hypotheses:

- Randomness: a candidate that one of the three tests rejects at ``REJECT`` is not random enough to be a secret.
- Natural text: the same three statistics of the corpus' own long words (``NATURAL`` characters, each different word once, over all
  documents) give their means and spreads for each encoding; few fixed numbers stand in where an encoding has hardly any words.
  Each test has the chance that a natural string of the candidate's length looks as random, and three times the least of
  them is the candidate's p-value, which holds however the three depend on each other.

A candidate that is not random has the p-value 1. Discoveries are taken by the Benjamini-Hochberg rule over different
strings inside each class of lengths, as short strings carry less evidence and are many more. The rule works on counts of 300
classes of p-values, never on sorted rows.

A found span that overlaps one of the three kinds is not added. Spans of one text are placed by running sums over
its matches, so the work is in proportion to them. Defined cases: a null text is empty; repeated rows
are scanned alike; an empty table gives no rows; equal p-values share a class; extra columns are not read. Offsets
are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import let
from .runtime import RID, keep, table, with_rid

#: The kinds in their order, their patterns, and the least length of a match (of group 2 for the first).
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
}
#: The same matches, but for those too short: a run is whole either way.
LONG_ENOUGH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
FOUND = "random"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Level under which a test of randomness rejects a candidate, and share of false discoveries.
REJECT, SHARE = 0.001, 0.05
LENGTH_CLASSES = [28, 40, 64]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by size; and what natural text is taken to give until words of the corpus tell: the chance that two of its
#: characters are equal, and that neighbours are of different classes.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS, 0.13, 0.45),
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6], 0.10, 0.25),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + UPPER[:6], 0.10, 0.25),
    ("lower", "^[a-z]+$", LOWER, 0.066, 0.4),
    ("upper", "^[A-Z]+$", UPPER, 0.066, 0.4),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567", 0.066, 0.1),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER, 0.066, 0.1),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPER, 0.066, 0.1),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 0.06, 0.2),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.06, 0.25),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.06, 0.25),
    ("mixed", "", UPPER + LOWER + DIGITS + "+/-_", 0.06, 0.25),
]
#: Groups of hexadecimal digits between dashes, as identifiers are written: the dashes are no characters of them.
GROUPS = "^(?:[0-9a-f]+(?:-[0-9a-f]+)+|[0-9A-F]+(?:-[0-9A-F]+)+)$"
CLASSES = {"l": LOWER, "u": UPPER, "d": DIGITS, "s": "+/-_"}
#: Characters of the corpus' natural words, just under those of candidates; and how many words the fixed numbers weigh.
NATURAL, PRIOR_WORDS = (12, 19), 20
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,%d}(?![A-Za-z0-9+/_-])" % NATURAL


def classes_of(alphabet: str) -> str:
    """The class of each character of an alphabet; one that has only one class is told by halves."""
    out = "".join(k for c in alphabet for k, own in CLASSES.items() if c in own)
    half = len(alphabet) // 2
    return out if len(set(out)) > 1 else "l" * half + "u" * (len(alphabet) - half)


def match_pieces(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """For each match, in order: rank of the kind, number, characters since the match before, its own, those of the group, and
    its text if the kind is FOUND."""
    order = list(KINDS).index(kind) if kind in KINDS else len(KINDS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    made = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part")),
        lambda p, k: F.struct(
            F.lit(order).alias("rank"),
            k.alias("k"),
            F.length(p["gap"]).alias("gap"),
            F.length(p["hit"]).alias("size"),
            F.length(p["part"]).alias("part"),
            (p["hit"] if kind == FOUND else F.lit(None).cast("string")).alias("hit"),
        ),
    )
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<rank:int,k:int,gap:int,size:int,part:int,hit:string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a row key, the matches and the natural words of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = [
        match_pieces(text, KINDS["assign"][0], "assign", 2),
        match_pieces(text, LONG_ENOUGH["access"], "access"),
        match_pieces(text, LONG_ENOUGH["hex"], "hex"),
        match_pieces(text, CANDIDATE, FOUND),
    ]
    return with_rid(docs.select("doc_id", "text")).select("doc_id", RID, F.concat(*pieces).alias("pieces"), F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"))


def placed(seen: DataFrame) -> DataFrame:
    """Row key, start, rank, stop, kind and hit of the spans by form, and of the candidates that overlap none."""
    rows = seen.filter(F.size("pieces") > 0).select(RID, "pieces").dropDuplicates([RID]).select(RID, F.inline("pieces"))
    before = Window.partitionBy(RID, "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)).cast("int") + F.col("gap"))
    kinds = [*KINDS, FOUND]
    least = F.element_at(F.array(*[F.lit(KINDS[k][1] if k in KINDS else 20) for k in kinds]), F.col("rank") + 1)
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("rank") + 1)
    rows = rows.filter(F.col("part") >= least).select(RID, "start", "rank", (F.col("start") + F.col("size")).alias("stop"), kind.alias("kind"), "hit")
    by_form = F.col("rank") < len(KINDS)
    # Backwards as a running minimum too: a frame that ends with the partition is added up anew for each row.
    upto = Window.partitionBy(RID).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(RID).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"reached": F.max(F.when(by_form, F.col("stop"))).over(upto), "ahead": F.min(F.when(by_form, F.col("start"))).over(onward)})
    clear = (F.coalesce("reached", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("ahead") >= F.col("stop"), F.lit(True))
    return rows.filter(by_form | clear).drop("reached", "ahead")


def _tail(z: Column) -> Column:
    """P(Z >= z), for any z."""
    return F.when(z >= 0, _normal_tail(F.abs(z))).otherwise(1 - _normal_tail(F.abs(z)))


def _normal_tail(z: Column) -> Column:
    """P(Z >= z) for a standard normal Z, to 0.0002."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def measured(rows: DataFrame) -> DataFrame:
    """Adds what the tests are made of to rows with a string column ``hit``: the encoding, its alphabet's size k, n characters, ordered
    pairs and triples of equal ones, squares and cubes of the classes' characters, changes of class, and products and squares of
    distances from a mean."""
    pick = lambda k: F.coalesce(*[F.when(F.col("bare").rlike(e[1]), F.lit(e[k])) for e in ENCODINGS if e[1]], F.lit(ENCODINGS[-1][k]))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, v: a + v)
    bare = F.rtrim(F.col("hit"), F.lit("="))
    bare = F.when(bare.rlike(GROUPS), F.replace(bare, F.lit("-"), F.lit(""))).otherwise(bare)
    out = rows.withColumn("bare", bare).withColumns({"encoding": pick(0), "alphabet": pick(2)})
    classes = F.element_at(F.create_map(*[F.lit(x) for e in ENCODINGS for x in (e[0], classes_of(e[2]))]), F.col("encoding"))
    out = out.withColumn("classes", classes).withColumn("kinds", F.expr("translate(bare, alphabet, classes)"))
    out = out.withColumns({"chars": F.split("bare", ""), "k": F.length("alphabet").cast("double"), "n": F.length("bare").cast("double")})
    x = let(F.col("alphabet"), lambda a: F.transform("chars", lambda c: F.position(c, a).cast("double") - 1))
    counts = let(F.col("chars"), lambda own: F.transform(F.array_distinct(own), lambda c: F.size(F.filter(own, lambda d: d == c)).cast("double")))
    out = out.withColumns({"x": x, "counts": counts})
    pairs = let(F.col("x"), lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    out = out.withColumns({"mean": total(F.col("x")) / F.col("n"), "pairs": F.when(F.col("n") > 1, pairs).otherwise(F.array().cast("array<struct<a:double,b:double>>"))})
    middle = (F.col("k") - 1) / 2
    own = [F.length("kinds") - F.length(F.replace(F.col("kinds"), F.lit(c), F.lit(""))) for c in CLASSES]
    # Runs of equal classes but for their first characters are no changes.
    same = F.length(F.regexp_replace("kinds", r"(.)(?=\1)", "")) - 1
    return out.withColumns(
        {
            "twos": total(F.transform("counts", lambda c: c * (c - 1))),
            "threes": total(F.transform("counts", lambda c: c * (c - 1) * (c - 2))),
            "squares": sum(c.cast("double") * c for c in own),
            "cubes": sum(c.cast("double") * c * c for c in own),
            "changes": same.cast("double"),
            "lagged": total(F.transform("pairs", lambda p: (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))),
            "spread": total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))),
            # Around the alphabet's middle, in units of a uniform character's variance.
            "along": total(F.transform("pairs", lambda p: (p["a"] - middle) * (p["b"] - middle))) * 12 / (F.col("k") * F.col("k") - 1),
        }
    ).select(*rows.columns, "encoding", "k", "n", "twos", "threes", "squares", "cubes", "changes", "lagged", "spread", "along")


def natural_model(words: DataFrame) -> DataFrame:
    """For each encoding what natural words (column ``hit``, each different one once) give: one row each."""
    n, steps = F.col("n"), F.col("n") - 1
    sums = {"of": F.lit(1.0), "pairs": n * steps, "triples": n * steps * (n - 2), "twos": F.col("twos"), "threes": F.col("threes"), "steps": steps, "steps2": steps * steps}
    sums |= {"changes": F.col("changes"), "changes2": F.col("changes") * F.col("changes"), "changes_steps": F.col("changes") * steps}
    sums |= {"along": F.col("along"), "along2": F.col("along") * F.col("along"), "along_steps": F.col("along") * steps}
    found = measured(words).groupBy("encoding").agg(*[F.sum(c).alias(f"s_{name}") for name, c in sums.items()])
    fixed = words.sparkSession.createDataFrame([(e[0], e[3], e[4]) for e in ENCODINGS], "encoding string, two0 double, change0 double")
    rows = fixed.join(F.broadcast(found), "encoding", "left").fillna(0.0)  # one row for each encoding
    # The fixed numbers count as PRIOR_WORDS words of 15 characters.
    m = float(PRIOR_WORDS)
    two = (F.col("s_twos") + F.col("two0") * 210 * m) / (F.col("s_pairs") + 210 * m)
    three = (F.col("s_threes") + F.pow("two0", F.lit(1.9)) * 2730 * m) / (F.col("s_triples") + 2730 * m)
    change = (F.col("s_changes") + F.col("change0") * 14 * m) / (F.col("s_steps") + 14 * m)
    along = F.col("s_along") / (F.col("s_steps") + 14 * m)
    rows = rows.withColumns({"two": two, "three": F.greatest(three, two * two), "change": change, "serial": along})
    wild = F.col("s_changes2") - 2 * F.col("change") * F.col("s_changes_steps") + F.col("change") * F.col("change") * F.col("s_steps2")
    tame = F.col("s_steps") * F.col("change") * (1 - F.col("change"))
    rough = F.col("s_along2") - 2 * F.col("serial") * F.col("s_along_steps") + F.col("serial") * F.col("serial") * F.col("s_steps2")
    over = F.greatest(F.lit(1.0), (wild + 14 * m) / (tame + 14 * m))
    return rows.select("encoding", "two", "three", "change", over.alias("over"), "serial", F.sqrt((rough + 14 * m) / (F.col("s_steps") + 14 * m)).alias("serial_sd"))


def tested(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """Adds to rows with a string column ``hit`` the encoding, n, p_chi2, p_runs and p_serial (of a random string), and p_natural."""
    rows = measured(candidates).join(F.broadcast(model), "encoding")
    n, k, steps = F.col("n"), F.col("k"), F.col("n") - 1
    chi2 = k / n * (F.col("twos") + n) - n
    # Wald and Wolfowitz' runs, for any number of classes.
    squares = F.col("squares")
    runs_var = (squares * (squares + n * (n + 1)) - 2 * n * F.col("cubes") - n * n * n) / (n * n * (n - 1))
    runs_z = F.abs(F.col("changes") - n + squares / n) / F.sqrt(runs_var)
    serial_z = F.abs(F.try_divide(F.col("lagged"), F.col("spread")) + 1 / n) * F.sqrt(n)
    # Natural: as few equal pairs, by the cube root of a gamma of their mean and variance.
    expected = F.col("two") * n * steps / 2
    variance = n * steps / 2 * F.col("two") * (1 - F.col("two")) + n * steps * (n - 2) * (F.col("three") - F.col("two") * F.col("two"))
    shape = expected * expected / variance
    pairs_z = (F.pow(F.col("twos") / 2 / expected, F.lit(1 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)
    # As many changes of class: Chernoff's bound, with the fitted overdispersion.
    share, change = F.col("changes") / steps, F.col("change")
    gain = F.when(share > 0, share * F.log(share / change)).otherwise(0.0) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - change))).otherwise(0.0)
    many = F.when(share > change, F.exp(-steps / F.col("over") * gain)).otherwise(1.0)
    # Neighbours as little alike as those of random strings.
    alike_z = F.signum("serial") * (F.col("serial") - F.col("along") / steps) * F.sqrt(steps) / F.col("serial_sd")
    rows = rows.withColumns(
        {
            "p_chi2": _normal_tail((chi2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)),
            "p_runs": F.when(runs_var > 0, 2 * _normal_tail(runs_z)).otherwise(0.0),
            "p_serial": F.coalesce(2 * _normal_tail(serial_z), F.lit(0.0)),
        }
    )
    random = F.least("p_chi2", "p_runs", "p_serial") >= REJECT
    least = F.least(_tail(-pairs_z), many, _tail(alike_z))
    p = F.when(random, F.least(F.lit(1.0), 3 * least)).otherwise(1.0)
    return rows.withColumn("p_natural", p).select(*candidates.columns, "encoding", "n", "p_chi2", "p_runs", "p_serial", "p_natural")


def discoveries(rows: DataFrame) -> DataFrame:
    """The tested candidates that pass the false-discovery rule of their length class."""
    classes = sum(((F.col("n") >= at).cast("int") for at in LENGTH_CLASSES), F.lit(0))
    # Class b holds p-values from 10^(-b/10) down: its upper end stands for all of them, which errs on the safe side.
    bin_ = F.least(F.lit(300), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.greatest("p_natural", F.lit(1e-300)))))).cast("int")
    rows = rows.withColumns({"class": classes, "bin": bin_})
    counts = rows.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("of"))
    down = Window.partitionBy("class").orderBy(F.col("bin").desc())
    share = F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 10) / F.sum("of").over(down)
    limits = counts.withColumn("all", F.sum("of").over(Window.partitionBy("class"))).withColumn("share", share)
    limits = limits.filter(F.col("share") <= SHARE).groupBy("class").agg(F.min("bin").alias("from_bin"))
    return rows.join(F.broadcast(limits), "class").filter("bin >= from_bin")  # a row for each class of lengths


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document doc_id, base (spans by form) and spans (those and the discovered ones), each in order."""
    seen = keep(scan(docs), "secrets")
    spans = keep(placed(seen), "secret-spans")
    model = natural_model(seen.select(F.explode("words").alias("hit")).distinct())
    strings = keep(tested(spans.filter(F.col("kind") == FOUND).select("hit").distinct(), model), "secret-tests")
    found = spans.join(discoveries(strings).select("hit"), "hit", "left_semi")
    own = F.struct("start", "rank", "stop", "kind")
    rows = spans.filter(F.col("kind") != FOUND).unionByName(found).groupBy(RID).agg(F.array_sort(F.collect_list(own)).alias("spans"))
    none = F.array().cast(rows.schema["spans"].dataType)
    out = seen.select("doc_id", RID).join(rows, RID, "left").withColumn("spans", F.coalesce("spans", none))
    return out.select("doc_id", F.filter("spans", lambda s: s["kind"] != FOUND).alias("base"), "spans")


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_secret_randomness(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
