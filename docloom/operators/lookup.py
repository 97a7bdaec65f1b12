"""Places of a gazetteer by joins: names that are alike, and paths for masked addresses."""

from __future__ import annotations

import difflib
from itertools import combinations
from math import ceil, comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import graph
from docloom.operators.geo import FUZZY, LEVELS, MARGIN, ancestors
from docloom.sources.steps import stored

# ---- names that are alike -----------------------------------------------------------------------------------------


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def _grams(name: Column) -> Column:
    """Pairs of neighbouring letters, each with how often it has come before."""
    letters = F.split(name, "")
    made = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.concat(F.element_at(letters, i), F.element_at(letters, i + 1)))
    made = F.when(F.length(name) > 1, made).otherwise(F.array().cast("array<string>"))
    return F.transform(made, lambda g, i: F.concat(g, F.size(F.filter(F.slice(made, 1, i), lambda h: h == g)).cast("string")))


#: A name has at most so many keys for names of one length.
NAME_KEYS = 500


def _common(least: float, a: int, b: int) -> tuple[int, int]:
    """(letters, pairs): what two names of these lengths have in common, if they are alike: so many letters in their order, by which they are
    looked up, or (0, n): combinations of n of the pairs of neighbours, where names are too long for that."""
    m = ceil(least * (a + b) / 2 - 1e-9)
    pairs, long = 3 * m - (a + b) - 1, max(a, b)
    if pairs < 1 or comb(long, m) <= NAME_KEYS:
        return m, 0
    return 0, next((n for n in (3, 2) if n <= pairs and comb(long - 1 - pairs + n, n) <= NAME_KEYS), 1)


def _chosen(parts: pd.Series, many: pd.Series) -> pd.Series:
    """The distinct combinations of so many parts, in their order."""
    return pd.Series([sorted({"".join(x) for x in combinations(p, int(k))}) for p, k in zip(parts, many)])


def alike(asked: DataFrame, names: DataFrame, least: float = FUZZY) -> DataFrame:
    """(asked, name, ratio) of names whose ratio of matching letters is at least ``least``; both tables have ``name``.

    With L letters in both, of which M match, the ratio is 2M / L, so names of two lengths must have M letters in common, in their order.
    Short names are looked up by all choices of M of their letters. Of long ones these are too many: L - 2M letters do not match, so matches lie in
    at most L - 2M + 1 blocks, and at least 3M - L - 1 pairs of neighbours are common. They are looked up by combinations of up to three
    pairs, of which, rarest first, only so many are taken that the common ones cannot all be missed. Only what shares a key is compared.
    Nulls and empty names match nothing. Of repeated names each counts once.
    """
    once = lambda df: stored(df.select(F.col("name").cast("string")).where("length(name) > 0").distinct(), "alike-names")
    asked, names = once(asked), once(names)
    grams = lambda df: df.select("name", F.explode(_grams(F.col("name"))).alias("gram"))
    a, b = F.col("a"), F.col("b")
    lengths = asked.select(F.length("name").alias("a")).distinct().crossJoin(names.select(F.length("name").alias("b")).distinct()).where(2 * F.least(a, b) >= (least - 1e-9) * (a + b))
    common = F.udf(lambda x, y: _common(least, x, y), "letters int, pairs int")
    matching = F.ceil(least * (a + b) / 2 - 1e-9)
    ways = stored(lengths.withColumn("x", common("a", "b")).select("a", "b", "x.*", (3 * matching - (a + b) - 1).alias("least_pairs")), "alike-lengths")
    by_pairs = ways.where("pairs > 0").limit(1).count() > 0
    held = stored(grams(names).groupBy("gram").agg(F.count("*").alias("n")), "alike-grams") if by_pairs else None

    def keys(df: DataFrame, side: str, length: str) -> DataFrame:
        sized = df.withColumn(length, F.length("name")).join(F.broadcast(ways), length)  # a row for each two lengths
        made = sized.where("letters > 0").select("name", "a", "b", "pairs", F.split("name", "").alias("parts"), F.col("letters").alias("many"))
        if by_pairs:
            ranked = grams(df).join(held, "gram", "left").groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("ranked"))
            first = F.slice(F.transform("ranked", lambda x: F.concat(x["gram"], F.lit(" "))), F.lit(1), (F.col(length) - 1 - F.col("least_pairs") + F.col("pairs")).cast("int"))
            made = made.unionByName(sized.where("pairs > 0").join(ranked, "name").select("name", "a", "b", "pairs", first.alias("parts"), F.col("pairs").alias("many")))
        # Names come in small batches of tasks of their own: keys are many times what they are made of.
        made = made.repartition("name", "a", "b").withColumn("key", F.explode(F.pandas_udf(_chosen, "array<string>")("parts", "many")))
        return made.select(F.xxhash64("a", "b", "pairs", "key").alias("key"), F.col("name").alias(side))

    pairs = keys(asked, "asked", "a").join(keys(names, "name", "b"), "key").select("asked", "name").distinct()
    return pairs.withColumn("ratio", F.pandas_udf(_ratios, "double")("asked", "name")).where(F.col("ratio") >= least)


def fuzzy_places(asked: DataFrame, gazetteer: DataFrame, least: float = FUZZY, margin: float = MARGIN) -> DataFrame:
    """(ask, code, ratio): the one place whose name is most alike, if alike enough, clearly best, and under the known parents.

    ``asked`` are (ask, name, level, unit, parents: array of codes); a null unit fits all, and null or empty parents too. What finds
    none, or two between which the margin is too small, is left out; so are names of fewer than four letters.
    """
    places = gazetteer.select("code", F.col("level").cast("int").alias("level"), F.lower("unit").alias("place_unit"), T.fold_place(F.col("name")).alias("name"))
    asked = stored(asked.select("ask", T.fold_place(F.col("name")).alias("asked"), F.col("level").cast("int").alias("level"), "unit", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")), "asked-places")
    found = alike(asked.where(F.length("asked") >= 4).select(F.col("asked").alias("name")), places, least - margin)
    fits = asked.join(found, "asked").join(places, ["name", "level"]).where(F.col("unit").isNull() | (F.lower("unit") == F.col("place_unit")))
    above = ancestors(gazetteer).groupBy("code").agg(F.collect_set("ancestor").alias("above"))
    fits = fits.join(above, "code").where(F.size(F.array_except("parents", "above")) == 0)
    by = Window.partitionBy("ask").orderBy(F.col("ratio").desc(), "code")
    ranked = fits.withColumns({"next": F.lead("ratio").over(by), "rank": F.row_number().over(by)})
    best = ranked.where((F.col("rank") == 1) & (F.col("ratio") >= least) & (F.col("next").isNull() | (F.col("ratio") - F.col("next") >= margin)))
    return best.select("ask", "code", "ratio")


# ---- paths for masked addresses -----------------------------------------------------------------------------------


def _addresses(masked: DataFrame, id_col: str) -> DataFrame:
    """(id, entity_id, address): entities whose chains share a part are one address."""
    parts = F.array_union(F.array(F.concat_ws(":", "role", "marker")), F.coalesce("chain", F.array().cast("array<string>")))
    edges = masked.select(F.col(id_col).alias("id"), F.concat(F.lit("e:"), "entity_id").alias("a"), F.explode(F.transform(parts, lambda p: F.concat(F.lit("p:"), p))).alias("b"))
    found = graph.components(edges).where(F.col("v").startswith("e:"))
    return found.select("id", F.expr("substring(v, 3)").alias("entity_id"), F.col("label").alias("address"))


def plan_paths(masked: DataFrame, all_paths: DataFrame, seed: str | int = 42, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_id, name, reason): names for masked places so that those of one address lie under each other.

    ``masked`` are (id, entity_id, role, unit, marker, chain: array of 'role:marker' of the masked parts of its address, anchors: array
    of codes of its visible parts). An address gets a path that holds all its anchors and has one of the units asked for in each
    role, chosen by a hash of the document and its entities. Paths are numbered, and each code and unit has the bitmap of its paths;
    what an address asks for is intersected once for all that ask the same. Without a path the reason says so. An entity of
    another role takes no name.
    """
    linked = stored(masked.select(F.col(id_col).alias("id"), "entity_id", "role", F.lower("unit").alias("unit"), "anchors").join(_addresses(masked, id_col), ["id", "entity_id"]), "masked-places")
    units = F.when(F.col("role").isin(*LEVELS), F.concat_ws(":", "role", "unit"))
    asks = linked.groupBy("id", "address").agg(
        F.array_sort(F.collect_set(units)).alias("units"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("anchors", F.array().cast("array<string>")))))).alias("anchors"),
        F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entities"),
    )
    asks = stored(asks.withColumn("asks", F.xxhash64("units", "anchors")), "address-asks")
    # Numbered in the order of communes; the paths of a country are some ten thousand.
    numbered = stored(all_paths.withColumn("path", F.row_number().over(Window.orderBy("commune_code")) - 1), "numbered-paths")
    keys = F.array(F.lit("all"), *[F.concat(F.lit("code:"), F.col(f"{r}_code")) for r in LEVELS], *[F.concat(F.lit(f"unit:{r}:"), F.lower(f"{r}_unit")) for r in LEVELS])
    bits = numbered.select(F.explode(keys).alias("key"), F.expr("bitmap_bucket_number(path + 1)").alias("bucket"), F.expr("bitmap_bit_position(path + 1)").alias("bit"))
    postings = stored(bits.groupBy("key", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "path-postings")
    wanted = asks.select("asks", "units", "anchors").dropDuplicates(["asks"])
    each = F.array_union(F.array(F.struct(F.lit("all").alias("need"), F.lit("all").alias("key"))), F.array_union(
        F.transform("anchors", lambda a: F.struct(F.concat(F.lit("code:"), a).alias("need"), F.concat(F.lit("code:"), a).alias("key"))),
        F.transform("units", lambda u: F.struct(F.concat(F.lit("unit:"), F.substring_index(u, ":", 1)).alias("need"), F.concat(F.lit("unit:"), u).alias("key")))))
    needs = wanted.select("asks", F.explode(each).alias("x")).select("asks", "x.*")
    many = needs.groupBy("asks").agg(F.count_distinct("need").alias("needs"))
    either = needs.join(postings, "key").groupBy("asks", "need", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = either.groupBy("asks", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("needs")).join(many, ["asks", "needs"])
    byte = F.expr("transform(sequence(1, 4096), i -> cast(conv(hex(substring(bits, i, 1)), 16, 10) as int))")
    places = both.select("asks", "bucket", F.posexplode(byte).alias("at", "byte")).where("byte > 0").select("asks", "bucket", "at", F.explode(F.expr("filter(sequence(0, 7), b -> (byte & shiftleft(1, b)) > 0)")).alias("b"))
    fit = places.select("asks", ((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("b")).alias("path"))
    fit = stored(fit.withColumn("number", F.row_number().over(Window.partitionBy("asks").orderBy("path")) - 1), "paths-that-fit")
    count = fit.groupBy("asks").agg(F.count("*").alias("paths"))
    pick = (T.stable_u64(str(seed), F.col("id"), F.col("entities")) % F.col("paths")).cast("int")
    chosen = asks.join(count, "asks", "left").select("id", "address", "asks", pick.alias("number")).join(fit, ["asks", "number"], "left").join(numbered.select("path", *LEVELS), "path", "left")
    name = F.coalesce(*[F.when(F.col("role") == r, F.col(r)) for r in LEVELS])
    out = linked.join(chosen.select("id", "address", "path", *LEVELS), ["id", "address"])
    return out.select(F.col("id").alias(id_col), "entity_id", name.alias("name"), F.when(F.col("path").isNull(), "invalid_location_hierarchy").alias("reason"))


# ---- known names in running text ----------------------------------------------------------------------------------

GRAM = 3
LEAD = 6  # letters of a name's beginning that are asked for before whole names are
FILTER_BITS = 1 << 20  # of hashes of beginnings and names, at most; 64 make a word
TOKENS = 512  # of a text, between places that are counted from its beginning
TOKEN = r"(?U)(?:\w+|[^\w \t])"  # a word or another letter


def _without_spaces(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[ \t]", "")


def _bare(tokens: Column, text: Column) -> Column:
    """Tokens in small letters without the spaces after them. İ stays, as it alone would grow, and Σ is σ wherever it stands."""
    word = lambda x: F.substring_index(F.substring_index(x, " ", 1), "\t", 1)
    single = lambda x: F.array_join(F.transform(F.split(F.translate(word(x), "Σ", "σ"), "İ"), F.lower), "İ")
    return F.when(F.contains(text, F.lit("İ")) | F.contains(text, F.lit("Σ")), F.transform(tokens, single)).otherwise(F.transform(tokens, lambda x: F.lower(word(x))))


def find_names(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, surface, name): where ``names`` (name) stand in the texts as whole words, whatever spaces lie in them, and whatever their case.

    A whole word begins and ends where tokens do, so only what follows the beginning of a token is looked at. A bitmap of the
    names' beginnings lets few of these through; of those, what ends with a token is asked for as a whole name, first in the
    bitmap and then by a join. A name within a longer one does not count, nor does one that another name equals but for
    spaces and case, nor one of under three letters. Null texts hold none, and rows that repeat an id are texts of their
    own, whose names are not told apart.
    """
    bare = _without_spaces(F.col("name"))
    known = names.select("name").where("name is not null").distinct().select("name", bare.alias("bare")).where(F.length("bare") >= GRAM)
    known = stored(known.groupBy("bare").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1").drop("n"), "known-names")
    sizes = known.groupBy(F.least(F.length("bare"), F.lit(LEAD)).alias("lead")).agg(F.count("*").alias("n"), F.max(F.length("bare")).alias("most")).collect()  # few rows: one for each beginning's length
    leads, most = sorted(r.lead for r in sizes), max((r.most for r in sizes), default=0)
    bits = 1 << 12
    while bits < min(FILTER_BITS, 128 * sum(r.n for r in sizes)):
        bits *= 2
    slot = lambda x: F.xxhash64(x).bitwiseAND(F.lit(bits - 1))
    asked = known.select(F.explode(F.array(*[F.substring("bare", 1, k) for k in (*range(1, GRAM + 1), LEAD)], F.col("bare"))).alias("x")).select(slot(F.col("x")).alias("slot"))
    words = asked.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    held = [0] * (bits // 64)  # a bitmap: no bit, no name
    for r in words.collect():  # one for each 64 bits of the filter at most
        held[r.word] = r.bits
    passes = F.broadcast(docs.sparkSession.createDataFrame([(1, held)], "one int, passes array<long>"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(1).alias("one")).where(F.length("text") >= GRAM).join(passes, "one")
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  computed once, however often it is used
    joined = lambda x, i, k: F.array_join(F.slice(x, i + 1, k), "")

    def passing(x: Column) -> Column:
        return F.getbit(F.element_at("passes", (F.shiftright(slot(x), 6) + 1).cast("int")), slot(x).bitwiseAND(F.lit(63)).cast("int")) == 1

    def hits(given: Column, low: Column, bases: Column) -> Column:
        def begins(i: Column) -> Column:
            """The token's own first letters are a name's, and so are those with what follows."""
            some = F.lit(False)
            for k in leads:
                some = some | passing(F.substring(joined(low, i, k), 1, k))
            return passing(F.substring(F.element_at(low, i + 1), 1, GRAM)) & some

        def names_at(i: Column) -> Column:
            ahead = F.slice(low, i + 1, max(most, 1))
            reach = F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size")), lambda a, x: F.struct((a["n"] + (a["size"] < most).cast("int")).alias("n"), (a["size"] + F.length(x)).alias("size")))["n"]
            whole = F.transform(F.sequence(F.lit(1), reach), lambda k: F.struct(i.alias("i"), k.alias("k"), joined(low, i, k).alias("bare")))
            return F.filter(whole, lambda x: (F.length(x["bare"]) >= GRAM) & passing(x["bare"]))

        def placed(x: Column) -> Column:
            i, k, block = x["i"], x["k"], F.shiftright(x["i"], TOKENS.bit_length() - 1)
            last = F.length(F.element_at(low, i + k))
            size = F.length(joined(given, i, k - 1)) + last
            return F.struct(
                x["bare"].alias("bare"), (F.element_at(bases, block + 1) + F.length(joined(given, block * TOKENS, i - block * TOKENS))).alias("start"), size.alias("size"), F.substring(joined(given, i, k), F.lit(1), size).alias("surface"),
                F.when(i > 0, F.substring(F.element_at(given, F.greatest(i, F.lit(1))), -1, 1)).otherwise("").alias("before"), F.substring(joined(given, i + k - 1, 2), last + 1, F.lit(1)).alias("after"),
            )

        at = F.filter(F.sequence(F.lit(0), F.size(low) - 1), begins)
        return F.transform(F.flatten(F.transform(at, names_at)), placed)

    def bases(given: Column) -> Column:
        """The place in the text of every ``TOKENS``th token."""
        sizes = F.transform(F.sequence(F.lit(0), F.size(given) - 1, F.lit(TOKENS)), lambda i: F.length(joined(given, i, TOKENS)))
        return F.aggregate(sizes, F.array(F.length("text") - F.length(F.ltrim("text", F.lit(" \t")))), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

    tokens = F.regexp_extract_all("text", F.lit(rf"{TOKEN}[ \t]*"), F.lit(0))
    bound = let(tokens, lambda g: let(_bare(g, F.col("text")), lambda b: F.when(F.size(g) > 0, let(bases(g), lambda at: hits(g, b, at)))))
    seen = rows.select("id", F.explode(bound).alias("x")).select("id", "x.*")
    # Whole words: neither the letter before nor the one after is part of a word.
    whole = seen.where(~F.col("before").rlike(r"(?U)\w") & ~F.col("after").rlike(r"(?U)\w")).join(known, "bare")
    spans = whole.select("id", "start", (F.col("start") + F.col("size")).alias("end"), "surface", "name").distinct()
    reach = F.max("end").over(Window.partitionBy("id").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("end") > F.col("reach"))).drop("reach").withColumnRenamed("id", id_col)
