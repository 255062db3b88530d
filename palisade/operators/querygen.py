"""Synthetic query names: variants of listed names, and names that should not match.

Every choice is a hash of (seed, row, slot), so a seed always gives the same queries, on any cluster.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions.folding import split_words

# Name lists and spelling rules.
FIRST = """James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald
Steven Paul Andrew Joshua Mary Patricia Jennifer Linda Barbara Elizabeth Susan Jessica Sarah Karen Nancy Lisa Betty Margaret
Sandra Ashley Dorothy Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah""".split()
LAST = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson
Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King
Wright Scott Torres Nguyen Hill Flores""".split()
COMPANIES = ["Global Industries LLC", "Pacific Trading Co", "Atlantic Holdings Inc", "Northern Capital Group", "Eastern Resources Ltd",
             "Western Commerce Corp", "United Enterprises", "National Supply Company", "Premier Services Group", "Allied Business Partners",
             "Continental Trading LLC", "Apex Solutions Inc"]
ARABIC_FIRST = """Mohammed Mohamed Muhammad Ahmad Ahmed Hassan Hussein Ali Omar Ibrahim Khalid Abdullah Yousef Yusuf Hasan Karim
Samir Tariq Bashir Nasser Khaled Walid Rashid Faisal Hamid Amir Bilal Mustafa Adel Sami Mahmoud Marwan Wael Ramzi Imad""".split()
ARABIC_LAST = "Al-Rashid Al-Hassan Al-Hussein Al-Khalid Al-Omar Rahman Karimi Ahmadi Hosseini Mohammadi Saleh Nassar Mansour Qasim Shaikh".split()
RUSSIAN_FIRST = "Aleksandr Dmitri Sergei Andrei Nikolai Vladimir Mikhail Pavel Ivan Alexei Yuri Boris Anatoli Viktor Konstantin".split()
RUSSIAN_LAST = "Ivanov Petrov Smirnov Kuznetsov Popov Volkov Sokolov Lebedev Kozlov Novikov Morozov Orlov Fedorov Mikhailov Nikolaev".split()
SPELLINGS = (("ph", "f"), ("(?<![aeiou])f(?![aeiou])", "ph"), ("ou", "u"), ("ei", "i"), ("ae", "a"), ("ck", "k"), ("(\\w)\\1", "$1"),
             ("ah$", "a"), ("eh$", "e"), ("i$", "y"), ("y$", "i"))
SWAPS = {"a": "e", "e": "a", "i": "y", "y": "i", "o": "u", "u": "o", "s": "z", "z": "s"}
VARIANTS = ("transliterate", "reorder", "drop_middle", "misspell", "abbreviate")


def draw(n: Column | int, seed: int, *keys: Column | str) -> Column:
    """A number from 0 to n - 1 that the seed and keys fix; null where n is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.pmod(F.xxhash64(F.lit(seed), *[F.lit(k) if isinstance(k, str) else k for k in keys]), n)).cast("int")


def pick(items: Column, seed: int, *keys: Column | str) -> Column:
    return F.try_element_at(items, draw(F.size(items), seed, *keys) + 1)


def first_replaced(text: Column, pattern: str, by: str) -> Column:
    """The first place that the pattern matches, replaced."""
    groups = pattern.count("(") - pattern.count("(?")
    shifted = pattern.replace("\\1", "\\2") if groups else pattern
    return F.regexp_replace(text, f"(?s)^(.*?){shifted if groups else '(?:' + shifted + ')'}", "$1" + by.replace("$1", "$2"))


def transliterate(name: Column, seed: int, key: Column) -> Column:
    """One spelling rule that applies, at its first place; the result is in lower case. Without a rule the name as it is."""
    lower = F.lower(name)
    options = F.filter(F.array(*[F.when(lower.rlike(p), first_replaced(lower, p, by)) for p, by in SPELLINGS]), lambda x: x.isNotNull())
    return F.coalesce(pick(options, seed, key, "spelling"), name)


def reorder(name: Column) -> Column:
    """First and last word swapped."""
    w = split_words(name)
    n = F.size(w)
    return F.when(n < 2, name).otherwise(F.array_join(F.concat(F.slice(w, -1, 1), F.slice(w, 2, F.greatest(n - 2, F.lit(0))), F.slice(w, 1, 1)), " "))


def drop_middle(name: Column, seed: int, key: Column) -> Column:
    """Without one inner word; names of two words or fewer stay."""
    w = split_words(name)
    gone = draw(F.greatest(F.size(w) - 2, F.lit(0)), seed, key, "drop") + 1
    return F.when(F.size(w) < 3, name).otherwise(F.array_join(F.filter(w, lambda x, i: i != gone), " "))


def misspell(name: Column, seed: int, key: Column) -> Column:
    """One inner letter of a word of three letters or more: swapped with the next, or a vowel, s or z replaced."""
    word = pick(F.filter(split_words(name), lambda x: F.length(x) >= 3), seed, key, "word")
    at = draw(F.length(word) - 2, seed, key, "letter") + 2  # from 1, not the first
    one, two = F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.lit(1))
    other = F.translate(F.lower(one), "".join(SWAPS), "".join(SWAPS.values()))
    swapped = F.when(draw(2, seed, key, "edit") == 0, F.concat(two, one)).otherwise(F.concat(F.when(F.lower(one).isin(*SWAPS), other).otherwise(one), two))
    new = F.concat(F.substring(word, F.lit(1), at - 1), swapped, F.substring(word, at + 2, F.length(word)))
    place = F.instr(name, word)
    return F.when(word.isNull(), name).otherwise(F.concat(F.substring(name, F.lit(1), place - 1), new, F.substring(name, place + F.length(word), F.length(name))))


def abbreviate(name: Column) -> Column:
    """The first word as its initial."""
    w = split_words(name)
    return F.when(F.size(w) < 2, name).otherwise(F.array_join(F.concat(F.array(F.substring(F.try_element_at(w, F.lit(1)), 1, 1)), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))), " "))


def variant(kind: Column, name: Column, seed: int, key: Column) -> Column:
    """The variant of that kind; one that leaves the name as it is (but for case) is misspelt instead."""
    made = (F.when(kind == "transliterate", transliterate(name, seed, key)).when(kind == "reorder", reorder(name))
            .when(kind == "drop_middle", drop_middle(name, seed, key)).when(kind == "abbreviate", abbreviate(name)).otherwise(misspell(name, seed, key)))
    return F.when(F.lower(made) == F.lower(name), misspell(name, seed, key)).otherwise(made)


def sample_rows(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows with the smallest hash of (seed, keys): a top-n, not a shuffle of all rows."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def generate_positive_queries(akas: DataFrame, entities: DataFrame, n_entities: int = 100, variants_per_entity: int = 5, seed: int = 42) -> DataFrame:
    """query_name, true_entity_id, true_name, variant_type, program of variants of sampled individuals' Latin names.

    The kinds stand in a random order per name; beyond all five they are drawn again. Programs take the first one, or
    UNKNOWN.
    """
    latin = akas.filter("is_primary and script = 'Latin'").select("entity_id", "aka_name")
    people = entities.filter("entity_type = 'Individual'").select("entity_id", "programs")
    listed = (latin.join(people, "entity_id").filter(F.size(split_words(F.col("aka_name"))) >= 2)
              .withColumn("program", F.coalesce(F.try_element_at("programs", F.lit(1)), F.lit("UNKNOWN"))).select("entity_id", "aka_name", "program"))
    again = F.row_number().over(W.partitionBy("entity_id", "aka_name").orderBy("program"))  # rows may repeat
    some = sample_rows(listed.withColumn("again", again), n_entities, seed, "entity_id", "aka_name", "again").withColumn("row", F.monotonically_increasing_id())
    kinds = F.array(*[F.lit(k) for k in VARIANTS])
    order = F.transform(F.array_sort(F.transform(kinds, lambda k: F.struct(F.xxhash64(F.lit(seed), "row", k).alias("h"), k.alias("k")))), lambda x: x["k"])
    slots = some.select("*", F.explode(F.sequence(F.lit(0), F.lit(variants_per_entity - 1))).alias("slot")).withColumn("order", order)
    key = F.concat_ws("/", F.col("row"), F.col("slot"))
    kind = F.coalesce(F.try_element_at("order", F.col("slot") + 1), pick(kinds, seed, key, "kind"))
    return (slots.withColumn("variant_type", kind).select(
        variant(F.col("variant_type"), F.col("aka_name"), seed, key).alias("query_name"), F.col("entity_id").alias("true_entity_id"),
        F.col("aka_name").alias("true_name"), "variant_type", "program"))


def _array(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _full_name(first, last, seed: int, what: str) -> Column:
    return F.concat_ws(" ", pick(_array(first), seed, F.col("id"), what + " first"), pick(_array(last), seed, F.col("id"), what + " last"))


def generate_hard_negatives(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """query_name, negative_type: made-up common names, and the fixed company names."""
    people = spark.range(max(n - len(COMPANIES), 0)).select(_full_name(FIRST, LAST, seed, "us").alias("query_name"), F.lit("us_individual").alias("negative_type"), "id")
    firms = spark.range(min(n, len(COMPANIES))).select(F.try_element_at(_array(COMPANIES), (F.col("id") + 1).cast("int")).alias("query_name"), F.lit("corporate").alias("negative_type"), "id")
    return people.unionByName(firms).orderBy(F.xxhash64(F.lit(seed), "negative_type", "id")).drop("id")


def generate_near_miss_negatives(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """query_name, near_miss_type: half Arabic names, the rest Russian ones."""
    arabic = spark.range(n // 2).select(_full_name(ARABIC_FIRST, ARABIC_LAST, seed, "ar").alias("query_name"), F.lit("arabic").alias("near_miss_type"), "id")
    russian = spark.range(n - n // 2).select(_full_name(RUSSIAN_FIRST, RUSSIAN_LAST, seed, "ru").alias("query_name"), F.lit("russian").alias("near_miss_type"), "id")
    return arabic.unionByName(russian).orderBy(F.xxhash64(F.lit(seed), "near_miss_type", "id")).drop("id")


def build_query_set(akas: DataFrame, entities: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    spark = akas.sparkSession
    return {"positive": generate_positive_queries(akas, entities, seed=seed), "hard_negative": generate_hard_negatives(spark, seed=seed), "near_miss": generate_near_miss_negatives(spark, seed=seed)}
