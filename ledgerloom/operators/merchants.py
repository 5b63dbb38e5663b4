"""Merchant names: aliases (exact, contained, by pattern, fuzzy), and registry names by blocked similarity.

Every step runs on the distinct spellings alone and is joined back, so that a spelling of a million rows is
matched once. Aliases of any number are met by equi-joins (words, four-letter pieces, lengths), patterns by the literal
pieces that they cannot match without; only patterns that have none are held against every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..functions.patterns import pieces
from ..runtime import keep, left_join_spread
from ..functions.similarity import sequence_ratio_udf, token_set_ratio_udf

LEGAL_NOISE = ["SA", "SRL", "SRL.", "S.A", "S.R.L", "ROMANIA", "THE", "COMPANY"]
#: Letters by which texts and pieces of patterns meet, and blocks over which patterns without a piece are dealt.
PART, PATTERN_BLOCKS = 4, 64
RESULT = ["merchant_canonical", "normalization_source", "merchant_match_method", "mapping_method", "name_confidence"]


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """alias (canonical spelling), name, compact, order: one row for each alias; a later entry of one alias wins."""
    pairs = {}
    for name, spellings in (R.ALIASES if aliases is None else aliases).items():
        for s in spellings:
            if s and s.strip():
                pairs[s] = name
    rows = spark.createDataFrame(list(pairs.items()) or [], "spelling string, name string")
    rows = rows.select(X.canonical(F.col("spelling")).alias("alias"), "name").filter("alias != ''")
    return rows.withColumn("compact", F.when(F.col("alias").rlike(r"[*./-]"), F.regexp_replace("alias", "[^A-Z0-9]", "")))


def spellings(df: DataFrame) -> DataFrame:
    """Distinct merchant_raw that are not empty, with their canonical form."""
    return df.select("merchant_raw").filter("merchant_raw is not null and merchant_raw != ''").distinct().withColumn("norm", X.canonical(F.col("merchant_raw")))


def exact_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """norm and exact_name of the texts that are an alias."""
    return names.select("norm").distinct().join(aliases, F.col("norm") == F.col("alias")).select("norm", F.col("name").alias("exact_name"))


def contained_alias(texts: DataFrame, aliases: DataFrame, column: str = "norm") -> DataFrame:
    """column and contained_name: the longest alias that the text contains.

    Aliases that share a word of four letters or more with the text are looked at first; only texts without any such
    alias are held against all. An alias that a text contains begins with a piece of the text, so these meet by their
    first four characters (fewer, of a short compact form).
    """
    texts = texts.select(column).distinct()
    long = F.filter(F.split(column, " "), lambda t: F.length(t) >= 4)
    words = texts.select(column, F.explode(F.array_distinct(long)).alias("word"))
    # Aliases by word: an equi-join takes the place of a substring join.
    by_word = aliases.withColumn("word", F.explode(F.array_distinct(F.filter(F.split("alias", " "), lambda t: F.length(t) >= 4))))
    shared = words.join(by_word, "word").select(column, "alias", "name", "compact").distinct()
    rest = texts.join(shared.select(column).distinct(), column, "left_anti")
    compact = F.regexp_replace(column, "[^A-Z0-9]", "")

    def pieces(text: Column, size: int) -> Column:
        return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    heads = F.array(F.substring("alias", 1, 4), F.when(F.col("compact") != "", F.substring("compact", 1, 4)))
    by_head = aliases.filter(F.length("alias") >= 4).withColumn("head", F.explode(F.array_distinct(F.filter(heads, lambda h: h.isNotNull()))))
    met = rest.withColumn("head", F.explode(F.array_distinct(F.concat(pieces(F.col(column), 4), *(pieces(compact, k) for k in (1, 2, 3, 4))))))
    everything = met.join(by_head, "head").select(column, "alias", "name", "compact").distinct()
    both = shared.unionByName(everything.select(column, "alias", "name", "compact"))
    hit = (F.length("alias") >= 4) & (F.col(column).contains(F.col("alias")) | F.coalesce((F.col("compact") != "") & F.regexp_replace(column, "[^A-Z0-9]", "").contains(F.col("compact")), F.lit(False)))
    first = F.min(F.struct((-F.length("alias")).alias("l"), "alias", "name"))
    return both.filter(hit).groupBy(column).agg(first.alias("first")).select(column, F.col("first.name").alias("contained_name"))


def containing(texts: DataFrame, column: str, table: DataFrame, piece: str) -> DataFrame:
    """Rows of texts beside those of table whose ``piece`` the text in ``column`` contains; both may be of any number.

    A piece is looked up by that of its four-letter parts (itself, if shorter) which the fewest texts have, so that both meet
    by equality. Parts that no text has leave their pieces out. An empty piece is in no text here.
    """
    parts = lambda text, size: F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    pieces_ = table.select(piece).filter(F.col(piece) != "").distinct()
    wanted = pieces_.withColumn("__part", F.explode(F.array_distinct(F.when(F.length(piece) >= PART, parts(F.col(piece), PART)).otherwise(F.array(piece)))))
    some = texts.select(column).distinct()
    owned = some.select(column, F.explode(F.array_distinct(F.concat(*(parts(F.col(column), k) for k in range(1, PART + 1))))).alias("__part"))
    owned = keep(owned.join(wanted.select("__part").distinct(), "__part", "left_semi"), "text-parts")
    counts = owned.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    rare = wanted.join(counts, "__part").groupBy(piece).agg(F.min(F.struct("__n", "__part")).alias("__r"), F.count(F.lit(1)).alias("__of"))
    whole = wanted.groupBy(piece).agg(F.count(F.lit(1)).alias("__all"))
    rare = rare.join(whole, piece).filter("__of = __all").select(piece, F.col("__r.__part").alias("__part"))
    met = owned.join(rare, "__part").filter(F.col(column).contains(F.col(piece))).select(column, piece)
    return texts.join(met, column).join(table, piece)


def _with_pieces(frames):
    import pandas as pd

    for frame in frames:
        rows = [(p, n, k, piece) for p, n, k in frame.itertuples(index=False) for piece in pieces(p) or [None]]
        yield pd.DataFrame(rows, columns=["pattern", "name", "priority", "piece"])


def pattern_alias(texts: DataFrame, patterns: DataFrame, column: str = "norm") -> DataFrame:
    """column and pattern_name: the first pattern (pattern, name, priority) that is found in the text.

    A match of a pattern has one of its literal pieces, and only texts with the piece are tried. Patterns without a piece are tried
    on every text, in blocks.
    """
    texts = texts.select(column).distinct()
    kinds = {f.name: f.dataType.simpleString() for f in patterns.schema.fields}
    table = patterns.select("pattern", "name", "priority").mapInPandas(_with_pieces, f"pattern string, name string, priority {kinds['priority']}, piece string")
    table = keep(table, "pattern-pieces")
    fold = F.lower(F.upper(F.translate(column, "\u0130", "I")))
    tried = containing(texts.withColumn("text", fold), "text", table.filter("piece is not null"), "piece")
    tried = tried.select(column, "pattern", "name", "priority").distinct()
    bare = table.filter("piece is null").withColumn("block", F.pmod(F.xxhash64("pattern", "priority"), F.lit(PATTERN_BLOCKS))).drop("piece")
    used = bare.select("block").distinct().agg(F.sort_array(F.collect_list("block")).alias("used"))  # one row of PATTERN_BLOCKS numbers at most
    everywhere = texts.join(F.broadcast(used), F.lit(True)).select(column, F.explode("used").alias("block")).join(bare, "block").drop("block")
    hit = F.regexp(F.col(column), F.concat(F.lit("(?iu)"), F.col("pattern")))
    return tried.unionByName(everywhere.select(tried.columns)).filter(hit).groupBy(column).agg(F.min_by("name", "priority").alias("pattern_name"))


def fuzzy_alias(texts: DataFrame, aliases: DataFrame, least: float = R.FUZZY_ALIAS_LEAST) -> DataFrame:
    """norm, fuzzy_name, fuzzy_score: the most similar alias, if at least ``least``, of those that share a word if these are eight or
    more; of equal ones the smallest name.

    Twice the matching characters over both lengths cannot reach ``least`` unless the lengths are close: texts meet aliases by
    length, and only pairs with enough characters in common are scored.
    """
    long = F.filter(F.split("norm", " "), lambda t: F.length(t) >= 4)
    texts = texts.select("norm").distinct()
    words = texts.select("norm", F.explode(F.array_distinct(long)).alias("word"))
    by_word = aliases.select("alias", "name", F.explode(F.array_distinct(F.split("alias", " "))).alias("word"))
    shared = words.join(by_word, "word").select("norm", "alias", "name", F.lit(True).alias("shared")).distinct()
    counts = shared.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    ratio = max(least, 0.05) / (2 - max(least, 0.05))
    size = F.length("norm")
    sizes = F.sequence(F.greatest(F.lit(1), F.ceil(size * ratio - 1e-9).cast("int")), F.greatest(F.lit(1), F.floor(size / ratio + 1e-9).cast("int")))
    pairs = texts.withColumn("size", F.explode(sizes)).join(aliases.withColumn("size", F.length("alias")), "size")
    # Characters in common, in any order: the matching ones are no more.
    chars = lambda c: F.split(c, "")
    common = lambda a, b: F.aggregate(F.array_distinct(chars(a)), F.lit(0), lambda n, c: n + F.least(*[F.size(F.filter(chars(x), lambda d: d == c)) for x in (a, b)]))
    close = pairs.filter(2.0 * common("norm", "alias") >= F.lit(least - 1e-9) * (F.length("norm") + F.length("alias")))
    scored = close.select("norm", "alias", "name", sequence_ratio_udf()(F.col("norm"), F.col("alias")).alias("score")).filter(F.col("score") >= least)
    scored = scored.join(shared, ["norm", "alias", "name"], "left").join(counts, "norm", "left").filter((F.coalesce("n", F.lit(0)) < 8) | F.col("shared"))
    best = scored.groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return best.select("norm", F.col("b.name").alias("fuzzy_name"), (-F.col("b.s")).alias("fuzzy_score"))


# Registry.


def registry(firms: DataFrame) -> DataFrame:
    """firm_id, display, norm, core, tokens, prefixes of firms (firm_id, name), without those of no usable token."""
    rows = firms.select("firm_id", F.trim("name").alias("display")).filter("display is not null and display != ''")
    rows = rows.withColumn("norm", X.registry_name(F.col("display")))
    rows = rows.withColumn("tokens", X.name_tokens(F.col("norm"), True)).filter(F.size("tokens") > 0)
    return rows.withColumns({"core": F.array_join(F.array_sort("tokens"), " "), "prefixes": X.prefixes(F.col("tokens"))})


def important_tokens(tokens: Column) -> Column:
    """Up to three tokens: known brands first, then the longest, then the earliest."""
    ranked = F.transform(tokens, lambda t, k: F.struct(F.when(F.substring(t, 1, 4).isin(R.BRAND_PREFIXES), 0).otherwise(1).alias("b"), (-F.length(t)).alias("l"), k.alias("k"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(ranked), 1, 3), lambda r: r["t"])


def registry_queries(texts: DataFrame, column: str) -> DataFrame:
    """query, norm, tokens, important, prefixes of the distinct texts that have a usable token."""
    rows = texts.select(F.col(column).alias("query")).filter("query is not null and query != ''").distinct()
    rows = rows.withColumn("norm", X.registry_name(F.col("query"))).withColumn("tokens", X.name_tokens(F.col("norm"), True))
    rows = rows.filter(F.size("tokens") > 0).withColumns({"important": important_tokens(F.col("tokens")), "prefixes": X.prefixes(F.col("tokens"))})
    return rows.withColumn("core", F.array_join(F.array_sort("tokens"), " "))


def exact_registry(queries: DataFrame, firms: DataFrame) -> DataFrame:
    """query, display: equal names, else equal sets of tokens; the first firm wins."""
    first = lambda key: firms.groupBy(key).agg(F.min_by("display", "firm_id").alias("display"))
    names = queries.join(first("norm").withColumnRenamed("display", "by_name"), "norm", "left").join(first("core").withColumnRenamed("display", "by_core"), "core", "left")
    return names.select("query", F.coalesce("by_name", "by_core").alias("display")).filter("display is not null")


def postings(rows: DataFrame, key: str, keys: Column, asked: DataFrame) -> DataFrame:
    """key and atom: the keys of rows that somebody asks for (column atom of ``asked``), one row each."""
    return rows.select(key, F.explode(keys).alias("atom")).join(asked.select("atom").distinct(), "atom", "left_semi")


def common_atoms(owned: DataFrame, common: int) -> DataFrame:
    """Atoms with more than ``common`` postings; counts are added up before they are shuffled."""
    return owned.groupBy("atom").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common).select("atom")


def _atoms(tokens: Column) -> Column:
    return F.concat(F.transform(tokens, lambda t: F.concat(F.lit("="), t)), X.prefixes(tokens))


def _heads(tokens: Column, head: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: (F.length(t) >= 4) & (F.substring(t, 1, 4) == head)))


def _block_score(important: Column, tokens: Column) -> Column:
    each = F.transform(important, lambda t: F.when(F.array_contains(tokens, t), 3).otherwise(0) + F.when(F.length(t) >= 4, _heads(tokens, F.substring(t, 1, 4))).otherwise(0))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def _demands(important: Column, common: Column) -> Column:
    """What firms may share with a query by common atoms alone: for each choice of none, prefix or whole token of each
    important token, the atoms, the prefixes that count (once for each token) and the points of whole tokens."""
    nothing = F.struct(F.array().cast("array<string>").alias("atoms"), F.array().cast("array<string>").alias("heads"), F.lit(0).alias("points"))

    def choices(k: int) -> Column:
        t = F.get(important, F.lit(k))
        head = F.substring(t, 1, 4)
        heads = F.when(F.length(t) >= 4, F.array(head)).otherwise(F.array().cast("array<string>"))
        whole = F.concat(F.lit("="), t)
        some = F.array(F.struct(F.array(whole).alias("atoms"), heads.alias("heads"), F.lit(3).alias("points")), F.struct(F.array(head).alias("atoms"), heads.alias("heads"), F.lit(0).alias("points")))
        some = F.filter(some, lambda c: F.array_contains(common, c["atoms"][0]) & ((c["points"] > 0) | (F.length(t) >= 4)))
        return F.when(t.isNull(), F.array(nothing)).otherwise(F.concat(F.array(nothing), some))

    def both(a: Column, b: Column) -> Column:
        return F.struct(F.array_sort(F.array_union(a["atoms"], b["atoms"])).alias("atoms"), F.array_sort(F.concat(a["heads"], b["heads"])).alias("heads"), (a["points"] + b["points"]).alias("points"))

    pairs = F.flatten(F.transform(choices(0), lambda x: F.transform(choices(1), lambda y: both(x, y))))
    three = F.flatten(F.transform(pairs, lambda x: F.transform(choices(2), lambda y: both(x, y))))
    return F.filter(F.array_distinct(three), lambda c: F.size(c["atoms"]) > 0)


def _subsets(atoms: Column) -> Column:
    """Sorted sets of one to three of the atoms."""
    one = F.transform(F.array_sort(atoms), lambda a: F.array(a))
    grow = lambda sets: F.flatten(F.transform(sets, lambda s: F.transform(F.filter(atoms, lambda a: a > F.element_at(s, -1)), lambda a: F.concat(s, F.array(a)))))
    two = grow(one)
    return F.concat(one, two, grow(two))


def blocking_pairs(queries: DataFrame, firms: DataFrame, most: int = R.REGISTRY_CANDIDATES, common: int = R.REGISTRY_CANDIDATES) -> DataFrame:
    """query, firm_id: pairs among which the best ``most`` firms of each query are, however many firms share a token.

    An atom is a whole token or a four-letter prefix. Firms that share an atom of up to ``common`` firms are all taken. A firm
    that shares only commoner atoms shares a certain set of them; among the firms with that set, ordered by the points it
    gives and by number, it is one of the first ``most``, since each firm before it has as many points at least. So one
    list of ``most`` firms for each asked set is enough: a query has up to 6 atoms and 26 sets, whatever the registry's size. Lists are
    cut to ``most`` before they are shuffled (the group limit of ranked windows), so that no task sees all firms of a set.
    """
    asked = queries.select("query", F.explode(_atoms(F.col("important"))).alias("atom"))
    owned = keep(postings(firms, "firm_id", _atoms(F.col("tokens")), asked), "postings")
    hot = keep(common_atoms(owned, common), "common-atoms")
    rare = asked.join(hot, "atom", "left_anti").join(owned, "atom").select("query", "firm_id")
    by_query = asked.join(hot, "atom").groupBy("query").agg(F.collect_set("atom").alias("common"))
    demands = queries.join(by_query, "query").select("query", F.explode(_demands(F.col("important"), F.col("common"))).alias("d"))
    demands = demands.select("query", F.array_join("d.atoms", "|").alias("set"), "d.heads", "d.points")
    of_firm = owned.join(hot, "atom").groupBy("firm_id").agg(F.collect_set("atom").alias("common"))
    offered = of_firm.join(firms.select("firm_id", "tokens"), "firm_id").select("firm_id", "tokens", F.explode(_subsets(F.col("common"))).alias("s"))
    offered = offered.select("firm_id", "tokens", F.array_join("s", "|").alias("set")).join(demands.select("set", "heads", "points").distinct(), "set")
    worth = F.col("points") + F.aggregate("heads", F.lit(0), lambda n, h: n + _heads(F.col("tokens"), h))
    first = F.row_number().over(Window.partitionBy("set", "heads", "points").orderBy(worth.desc(), "firm_id"))
    lists = offered.withColumn("k", first).filter(F.col("k") <= most).select("set", "heads", "points", "firm_id")
    return rare.unionByName(demands.join(lists, ["set", "heads", "points"]).select("query", "firm_id")).distinct()


def blocking_scores(queries: DataFrame, firms: DataFrame, most: int = R.REGISTRY_CANDIDATES, common: int = R.REGISTRY_CANDIDATES) -> DataFrame:
    """query, firm_id, block_score: 3 for each shared important token, 1 for each token with its prefix; the best ``most``."""
    pairs = blocking_pairs(queries, firms, most, common)
    rows = pairs.join(queries.select("query", "important"), "query").join(firms.select("firm_id", "tokens"), "firm_id")
    scores = rows.select("query", "firm_id", _block_score(F.col("important"), F.col("tokens")).alias("block_score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("block_score").desc(), "firm_id"))
    return scores.withColumn("block_rank", rank).filter(F.col("block_rank") <= most)


def score_candidates(candidates: DataFrame, queries: DataFrame, firms: DataFrame) -> DataFrame:
    """Scores of blocked pairs (query, firm_id, block_rank), with the firm's display name and foreign tokens."""
    q = queries.select("query", F.col("norm").alias("q_norm"), F.col("tokens").alias("q_tokens"), "important", F.col("prefixes").alias("q_prefixes"))
    rows = candidates.join(q, "query").join(firms.select("firm_id", "display", "norm", "tokens", "prefixes"), "firm_id")
    ratio = token_set_ratio_udf()
    rows = rows.withColumn("base", F.greatest(ratio(F.col("q_norm"), F.col("norm")), ratio(F.array_join("important", " "), F.col("norm"))))
    zero = F.lit(0.0)
    brand = F.array(*map(F.lit, R.BRAND_PREFIXES))
    bonus = F.aggregate("important", zero, lambda s, t: s + F.when(F.array_contains("tokens", t), 8.0).when((F.length(t) >= 4) & F.array_contains("prefixes", F.substring(t, 1, 4)), 6.0).otherwise(0.0))
    brand_hit = F.exists("important", lambda t: ~F.array_contains("tokens", t) & (F.length(t) >= 4) & F.array_contains("prefixes", F.substring(t, 1, 4)) & F.array_contains(brand, F.substring(t, 1, 4)))
    foreign = F.size(F.filter("tokens", lambda t: ~F.array_contains("q_tokens", t) & ~((F.length(t) >= 4) & F.array_contains("q_prefixes", F.substring(t, 1, 4)))))
    centred = F.size(F.array_intersect("prefixes", F.array_intersect("q_prefixes", brand)))
    special = F.when(centred > 0, F.least(F.lit(6.0), 8.0 * centred / F.greatest(F.lit(1), F.size("tokens")))).otherwise(0.0) - 2.2 * foreign
    rows = rows.withColumns({"bonus": bonus, "brand_hit": brand_hit, "foreign": foreign, "special": special}).filter("bonus > 0")
    score = F.greatest(zero, F.least(F.lit(100.0), F.col("base") + F.col("bonus") + F.col("special")))
    return rows.withColumn("score", F.when(F.col("brand_hit"), F.greatest(score, F.lit(82.0))).otherwise(score)).select("query", "firm_id", "block_rank", "display", "foreign", "score")


def registry_winners(scored: DataFrame, least: float = R.REGISTRY_LEAST) -> DataFrame:
    """query, display, score: candidates in block order; a higher score wins, and within 0.5 of the best one the
    name of fewer foreign tokens, then the smaller name, takes its place. The order matters, hence a fold over the
    candidates (no more than the blocking leaves)."""
    candidates = F.array_sort(F.collect_list(F.struct("block_rank", "score", "foreign", "display")))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("foreign"), F.lit(None).cast("string").alias("display"))

    def step(best: Column, c: Column) -> Column:
        taken = F.struct(c["score"].alias("score"), c["foreign"].alias("foreign"), c["display"].alias("display"))
        closer = (c["foreign"] < best["foreign"]) | ((c["foreign"] == best["foreign"]) & (c["display"] < best["display"]))
        return F.when(c["score"] > best["score"] + 1e-9, taken).when(best["display"].isNotNull() & (F.abs(c["score"] - best["score"]) <= 0.5) & closer, taken).otherwise(best)

    best = scored.groupBy("query").agg(candidates.alias("c")).select("query", F.aggregate("c", none, step).alias("best"))
    return best.filter((F.col("best.display").isNotNull()) & (F.col("best.score") >= least)).select("query", "best.display", F.bround("best.score", 4).alias("score"))


def match_registry(texts: DataFrame, firms: DataFrame, column: str, most: int = R.REGISTRY_CANDIDATES, least: float = R.REGISTRY_LEAST) -> DataFrame:
    """query, display, score of the texts that a registry name fits; exact ones never reach the similarity."""
    reg, queries = registry(firms), registry_queries(texts, column)
    exact = exact_registry(queries, reg).withColumn("score", F.lit(100.0))
    open_ = queries.join(exact.select("query"), "query", "left_anti")
    scored = score_candidates(blocking_scores(open_, reg, most), open_, reg)
    return exact.unionByName(registry_winners(scored, least))


def brand_names(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, score, brand: the alias that the registry name and the text contain, or is the name, else its first two words."""
    rows = matches.withColumn("dataset", X.canonical(F.col("display"))).withColumn("both", F.concat_ws(" ", "dataset", "query"))
    rows = rows.join(contained_alias(rows, aliases, "both"), "both", "left")
    rows = rows.join(exact_alias(rows.select(F.col("dataset").alias("norm")), aliases).withColumnRenamed("norm", "dataset"), "dataset", "left")
    words = F.filter(F.split("dataset", " "), lambda t: (t != "") & ~t.isin(LEGAL_NOISE))
    short = F.nullif(F.initcap(F.array_join(F.slice(words, 1, 2), " ")), F.lit(""))
    return rows.select("query", "score", F.coalesce("contained_name", "exact_name", short, "display").alias("brand"))


def normalise_merchants(df: DataFrame, aliases: DataFrame, firms: DataFrame | None = None, patterns: DataFrame | None = None, external: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Adds merchant_canonical, normalization_source, merchant_match_method, mapping_method; sets confidence.

    Gateway texts try aliases before the registry, others after it; then similar aliases, then the external lookup.
    A row without a merchant keeps its confidence.
    """
    order = F.col("seq") if "seq" in df.columns else F.lit(0)
    # Distinct spellings are few: written out, so that the steps below do not each derive them anew.
    names = df.filter("merchant_raw is not null and merchant_raw != ''").groupBy("merchant_raw").agg(F.min(order).alias("o"))
    names = keep(names.withColumn("norm", X.canonical(F.col("merchant_raw"))), "spellings")
    norms = names.select("norm").distinct()
    norms = norms.join(exact_alias(norms, aliases), "norm", "left").join(contained_alias(norms, aliases), "norm", "left")
    if patterns is not None:
        norms = norms.join(pattern_alias(norms, patterns), "norm", "left")
    else:
        norms = norms.withColumn("pattern_name", F.lit(None).cast("string"))
    if firms is not None:
        found = brand_names(match_registry(norms, firms, "norm"), aliases).select(F.col("query").alias("norm"), F.col("score").alias("firm_score"), F.col("brand").alias("firm_name"))
        norms = norms.join(found, "norm", "left")
    else:
        norms = norms.withColumns({"firm_score": F.lit(None).cast("double"), "firm_name": F.lit(None).cast("string")})
    if fuzzy:
        left = norms.filter("exact_name is null and contained_name is null and pattern_name is null and firm_name is null")
        norms = norms.join(fuzzy_alias(left, aliases), "norm", "left")
    else:
        norms = norms.withColumns({"fuzzy_score": F.lit(None).cast("double"), "fuzzy_name": F.lit(None).cast("string")})
    if external is not None:
        norms = norms.join(external.select(F.col("query_norm").alias("norm"), F.col("name").alias("external_name")), "norm", "left")
    else:
        norms = norms.withColumn("external_name", F.lit(None).cast("string"))

    def step(name: str, source: str, method: str, mapping: str, confidence: Column) -> tuple[Column, Column]:
        fields = F.struct(F.col(name).alias("merchant_canonical"), F.lit(source).alias("normalization_source"), F.lit(method).alias("merchant_match_method"), F.lit(mapping).alias("mapping_method"), confidence.cast("double").alias("name_confidence"))
        return F.col(name).isNotNull(), fields

    exact = step("exact_name", "alias_exact", "alias_exact", "exact_alias", F.lit(1.0))
    within = step("contained_name", "alias_contains", "alias_contains", "exact_alias", F.lit(0.98))
    regex = step("pattern_name", "alias_regex", "alias_regex", "regex_alias", F.lit(0.96))
    firm = step("firm_name", "dataset", "dataset_token_set_ratio", "dataset_match", F.bround(F.least(F.lit(0.99), F.greatest(F.lit(0.7), F.col("firm_score") / 100)), 2))
    near = step("fuzzy_name", "alias_fuzzy", "alias_fuzzy", "fuzzy_alias", F.bround("fuzzy_score", 2))
    outside = step("external_name", "termene", "external_lookup", "termene_api", F.lit(0.85))

    def chain(steps: list[tuple[Column, Column]]) -> Column:
        out = F.when(*steps[0])
        for condition, fields in steps[1:]:
            out = out.when(condition, fields)
        return out

    gateway = F.col("norm").contains("PAYU*")
    named = norms.withColumn("r", F.when(gateway, chain([exact, within, regex, firm, near, outside])).otherwise(chain([firm, exact, within, regex, near, outside]))).select("norm", "r.*")
    # An unmapped text keeps the first spelling of its canonical form.
    firsts = names.groupBy("norm").agg(F.min_by("merchant_raw", F.struct("o", "merchant_raw")).alias("first_spelling"))
    named = names.join(named, "norm").join(firsts, "norm")
    named = named.select(
        "merchant_raw",
        F.coalesce("merchant_canonical", "first_spelling").alias("merchant_canonical"),
        F.coalesce("normalization_source", F.lit("unmapped")).alias("normalization_source"),
        F.coalesce("merchant_match_method", F.lit("unmapped")).alias("merchant_match_method"),
        F.coalesce("mapping_method", F.lit("unmapped")).alias("mapping_method"),
        F.coalesce("name_confidence", F.lit(0.5)).alias("name_confidence"),
    )
    rest = df.drop("merchant_canonical", "normalization_source", "merchant_match_method", "mapping_method")
    out = left_join_spread(rest, named, "merchant_raw", "raw_description" if "raw_description" in df.columns else "confidence", *(["seq"] if "seq" in df.columns else []))
    return out.withColumn("confidence", F.coalesce("name_confidence", "confidence")).drop("name_confidence")
