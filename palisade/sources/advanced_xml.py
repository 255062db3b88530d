"""List XML (advanced format) as tables, by Spark's own reader.

Every section is one scan with a declared schema; ids stay strings. Reference values become one small table
(kind, id, value, parent), whose size the format bounds, so lookups broadcast it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the format: reference sets by their lookup name.
REFERENCE_SETS = {
    "country": "Country", "area_code": "AreaCode", "party_subtype": "PartySubType", "party_type": "PartyType", "feature_type": "FeatureType",
    "doc_type": "IDRegDocType", "alias_type": "AliasType", "script": "Script", "program": "SanctionsProgram", "legal_basis": "LegalBasis",
    "loc_part_type": "LocPartType", "validity": "Validity"}
# Kinds of relationship and of their quality.
RELATIONS = {
    "1555": "Associate Of", "15001": "Providing support to", "15002": "Acting for or on behalf of", "15003": "Owned or Controlled By",
    "15004": "Family member of", "91422": "Playing a significant role in", "91725": "Leader or official of", "91900": "Principal Executive Officer",
    "92019": "Owns, controls, or operates", "92122": "Property in the interest of"}
QUALITIES = {"1": "High", "1540": "High", "1541": "Medium", "1542": "Low", "1543": "Unknown"}
OWNED_BY, OWNS = "15003", "92019"

_ITEM = "array<struct<_ID: string, _VALUE: string, _Description: string, _PartyTypeID: string, _SanctionsProgramID: string>>"
_DATE = "struct<Year: string, Month: string, Day: string>"
SCHEMAS = {
    "ReferenceValueSets": ", ".join(f"{tag}Values struct<{tag}: {_ITEM}>" for tag in REFERENCE_SETS.values()),
    "SanctionsEntry": f"_ProfileID string, _ListID string, EntryEvent array<struct<Date: {_DATE}>>, SanctionsMeasure array<struct<Comment: string>>",
    "Location": "_ID string, LocationCountry array<struct<_CountryID: string, _VALUE: string>>, LocationAreaCode array<struct<_AreaCodeID: string, _VALUE: string>>, "
                "LocationPart array<struct<_LocPartTypeID: string, LocationPartValue: array<struct<Value: string>>>>",
    "IDRegDocument": "_IdentityID string, _IDRegDocTypeID string, `_IssuedBy-CountryID` string, _ValidityID string, IDRegistrationNo array<string>",
    "DistinctParty": "_FixedRef string, Profile struct<_ID: string, _PartySubTypeID: string, Identity: array<struct<_ID: string, Alias: array<struct<_AliasTypeID: string, _Primary: string, _LowQuality: string, "
                     "DocumentedName: struct<DocumentedNamePart: array<struct<NamePartValue: array<struct<_ScriptID: string, _VALUE: string>>>>>>>>>, "
                     "Feature: array<struct<_FeatureTypeID: string, FeatureVersion: array<struct<VersionLocation: array<struct<_LocationID: string, _VALUE: string>>, "
                     f"DatePeriod: struct<Start: struct<From: {_DATE}, Year: string, Month: string, Day: string>>, VersionDetail: array<struct<_DetailReferenceID: string, _VALUE: string>>>>>>>",
    "ProfileRelationship": "`_From-ProfileID` string, `_To-ProfileID` string, _RelationTypeID string, _RelationQualityID string, _Former string"}


def section(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements of that tag, with pos in document order. path: a list, or with a slash at its end a folder of sections by tag."""
    return spark.read.format("xml").option("rowTag", tag).schema(SCHEMAS[tag]).load(path + tag if path.endswith("/") else path).withColumn("pos", F.monotonically_increasing_id())


def text(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def reference_values(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, value, parent. Area codes take their description, legal bases their program; items without id are skipped."""
    sets = section(spark, path, "ReferenceValueSets")
    out = None
    for kind, tag in REFERENCE_SETS.items():
        own = F.coalesce(F.trim(F.col("x._VALUE")), F.lit(""))
        value = {"area_code": F.coalesce("x._Description", own), "legal_basis": F.col("x._SanctionsProgramID")}.get(kind, own)
        part = (sets.select(F.posexplode(F.col(f"{tag}Values.{tag}")).alias("at", "x")).filter("x._ID is not null and x._ID <> ''")
                .select(F.lit(kind).alias("kind"), F.col("x._ID").alias("id"), value.alias("value"), F.col("x._PartyTypeID").alias("parent"), "at"))
        out = part if out is None else out.unionByName(part)
    last = F.max_by(F.struct("value", "parent"), "at").alias("v")
    return out.groupBy("kind", "id").agg(last).select("kind", "id", "v.value", "v.parent")


class Lookup:
    """Left joins with one kind of reference value after another."""

    def __init__(self, refs: DataFrame):
        self.refs = refs

    def __call__(self, rows: DataFrame, kind: str, key: str, name: str, default: Column | None = None) -> DataFrame:
        side = self.refs.filter(F.col("kind") == kind).select(F.col("id").alias("_k"), F.col("value").alias("_v"))
        value = F.col("_v") if default is None else F.coalesce("_v", default)
        return rows.join(F.broadcast(side), F.col(key) == F.col("_k"), "left").withColumn(name, value).drop("_k", "_v")


def resolve_type(rows: DataFrame, refs: DataFrame, key: str, name: str, default: str | None = None) -> DataFrame:
    """The subtype's text, or the party type's where that is blank or Unknown, else the default."""
    kinds = lambda k: refs.filter(F.col("kind") == k)
    sub = kinds("party_subtype").select(F.col("id").alias("_s"), F.col("value").alias("_text"), F.col("parent").alias("_type"))
    whole = kinds("party_type").select(F.col("id").alias("_t"), F.col("value").alias("_name"))
    own = F.when((F.col("_text") != "") & (F.col("_text") != "Unknown"), F.col("_text"))
    return (rows.join(F.broadcast(sub), F.col(key) == F.col("_s"), "left").join(F.broadcast(whole), F.col("_type") == F.col("_t"), "left")
            .withColumn(name, F.coalesce(own, "_name", F.lit(default))).drop("_s", "_text", "_type", "_t", "_name"))


def _two(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def sanctions_entries(spark: SparkSession, path: str) -> DataFrame:
    """profile_id, programs, listed_date, list_id, pos of every entry."""
    date = F.filter(F.transform("EntryEvent", lambda e: e["Date"]), lambda d: d.isNotNull())
    first = F.try_element_at(date, F.lit(1))
    day = F.when(F.coalesce(first["Year"], F.lit("")) != "", F.concat_ws("-", first["Year"], _two(F.coalesce(first["Month"], F.lit("01"))), _two(F.coalesce(first["Day"], F.lit("01")))))
    programs = F.filter(F.transform(F.coalesce("SanctionsMeasure", F.array().cast("array<struct<Comment: string>>")), lambda m: F.trim(m["Comment"])), lambda x: x != "")
    return (section(spark, path, "SanctionsEntry").filter("_ProfileID is not null and _ProfileID <> ''")
            .select(F.col("_ProfileID").alias("profile_id"), programs.alias("programs"), F.expr("cast(null as date)").alias("none"), day.alias("day"), F.col("_ListID").alias("list_id"), "pos")
            .withColumn("listed_date", F.try_to_date("day", "yyyy-MM-dd")).drop("none", "day"))


def first_entries(entries: DataFrame) -> DataFrame:
    """The first entry of each profile."""
    rank = F.row_number().over(W.partitionBy("profile_id").orderBy("pos"))
    return entries.withColumn("_n", rank).filter("_n = 1").drop("_n", "pos")


def locations(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """location_id, country, area_code, city, region, postal_code, address."""
    look = Lookup(refs)
    base = section(spark, path, "Location").filter("_ID is not null and _ID <> ''").select(
        F.col("_ID").alias("location_id"), F.try_element_at("LocationCountry", F.lit(1))["_CountryID"].alias("_c"),
        F.try_element_at("LocationAreaCode", F.lit(1))["_AreaCodeID"].alias("_a"), "LocationPart", "pos")
    base = look(look(base, "country", "_c", "country"), "area_code", "_a", "area_code")
    parts = base.select("location_id", F.posexplode("LocationPart").alias("at", "p")).select(
        "location_id", "at", F.col("p._LocPartTypeID").alias("type_id"), F.try_element_at("p.LocationPartValue", F.lit(1))["Value"].alias("value")).filter("value is not null and value <> ''")
    parts = look(parts, "loc_part_type", "type_id", "type", F.col("type_id"))
    of = lambda name: F.max_by(F.when(F.col("type") == name, F.trim("value")), F.when(F.col("type") == name, F.col("at")))  # noqa: E731  the last one wins
    names = {"city": "CITY", "state": "STATE/PROVINCE", "area": "REGION", "postal_code": "POSTAL CODE", "a1": "ADDRESS1", "a2": "ADDRESS2", "a3": "ADDRESS3"}
    wide = parts.groupBy("location_id").agg(*[of(v).alias(k) for k, v in names.items()])
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    wide = wide.select(F.col("location_id").alias("_l"), "city", F.coalesce(none("state"), none("area")).alias("region"), "postal_code", F.nullif(F.concat_ws(", ", none("a1"), none("a2"), none("a3")), F.lit("")).alias("address"))
    rank = F.row_number().over(W.partitionBy("location_id").orderBy(F.desc("pos")))
    return (base.join(wide, F.col("location_id") == F.col("_l"), "left").withColumn("_n", rank).filter("_n = 1")
            .select("location_id", "country", "area_code", "city", "region", "postal_code", "address"))


def parties(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, profile_id, subtype_id, identity_id, aliases, features, pos of parties that have a profile."""
    own = section(spark, path, "DistinctParty").filter("Profile is not null")
    identity = F.try_element_at("Profile.Identity", F.lit(1))
    return own.select(F.col("_FixedRef").alias("entity_id"), F.coalesce("Profile._ID", "_FixedRef").alias("profile_id"), F.col("Profile._PartySubTypeID").alias("subtype_id"),
                      identity["_ID"].alias("identity_id"), identity["Alias"].alias("aliases"), F.col("Profile.Feature").alias("features"), "pos")


def aliases(party: DataFrame, refs: DataFrame) -> DataFrame:
    """akas with at (place in the party) and pos; aliases without a name part are skipped."""
    look = Lookup(refs)
    values = F.filter(F.flatten(F.transform(F.col("a.DocumentedName.DocumentedNamePart"), lambda p: F.slice(F.coalesce(p["NamePartValue"], F.array().cast("array<struct<_ScriptID: string, _VALUE: string>>")), 1, 1))), lambda v: v.isNotNull())
    rows = (party.select("entity_id", "pos", F.posexplode("aliases").alias("at", "a")).withColumn("parts", values).filter("size(parts) > 0")
            .select("entity_id", "pos", "at", F.trim(F.array_join(F.filter(F.transform("parts", lambda v: v["_VALUE"]), lambda x: x != ""), " ")).alias("aka_name"),
                    F.col("a._AliasTypeID").alias("_t"), F.coalesce(F.col("a._Primary") == "true", F.lit(False)).alias("is_primary"),
                    F.coalesce(F.col("a._LowQuality") == "true", F.lit(False)).alias("is_weak"), F.try_element_at("parts", F.lit(1))["_ScriptID"].alias("_s")))
    rows = look(look(rows, "alias_type", "_t", "alias_type", F.lit("A.K.A.")), "script", "_s", "script")
    return rows.select("entity_id", "aka_name", "alias_type", "is_primary", "is_weak", "script", "pos", "at")


def features(party: DataFrame, refs: DataFrame, places: DataFrame) -> DataFrame:
    """entity_id, feature_type, value, location_id: a version's location, else its date, else its texts."""
    versions = party.select("entity_id", F.explode("features").alias("f")).select("entity_id", F.col("f._FeatureTypeID").alias("_t"), F.explode("f.FeatureVersion").alias("v"))
    versions = Lookup(refs)(versions, "feature_type", "_t", "feature_type", F.col("_t"))
    place = F.try_element_at("v.VersionLocation", F.lit(1))
    start = "v.DatePeriod.Start"
    either = lambda k: F.coalesce(F.nullif(F.col(f"{start}.From.{k}"), F.lit("")), F.nullif(F.col(f"{start}.{k}"), F.lit("")))
    year, month, day = either("Year"), either("Month"), either("Day")
    date = F.concat_ws("-", year, _two(month), F.when(month.isNotNull(), _two(day)))
    linked = versions.filter(place.isNotNull()).select("entity_id", "feature_type", place["_LocationID"].alias("location_id"))
    linked = linked.join(places.select("location_id", F.col("country").alias("value")), "location_id", "left").select("entity_id", "feature_type", "value", "location_id")
    none = F.lit(None).cast("string").alias("location_id")
    dated = versions.filter(place.isNull() & F.col("v.DatePeriod").isNotNull() & year.isNotNull()).select("entity_id", "feature_type", date.alias("value"), none)
    plain = (versions.filter(place.isNull() & F.col("v.DatePeriod").isNull()).select("entity_id", "feature_type", F.explode("v.VersionDetail").alias("d"))
             .select("entity_id", "feature_type", text(F.col("d._VALUE")).alias("value"), none).filter("value is not null"))
    return linked.unionByName(dated).unionByName(plain)


def parse_all(spark: SparkSession, path: str, output_dir: str | None = None) -> dict[str, DataFrame]:
    """entities, akas, addresses, documents, features; written as Parquet below output_dir if given.

    Empty sections give empty, typed tables; a file without parties is an error, as it is no list.
    """
    refs = reference_values(spark, path)
    party = parties(spark, path)
    if party.isEmpty():
        raise ValueError("no distinct parties in " + path)
    places = locations(spark, path, refs)
    akas = aliases(party, refs)
    primary = akas.filter("is_primary").groupBy("entity_id", "pos").agg(F.max_by("aka_name", "at").alias("full_name"))  # the last one
    entries = first_entries(sanctions_entries(spark, path))
    typed = resolve_type(party.drop("aliases", "features"), refs, "subtype_id", "entity_type")
    entities = (typed.join(primary, ["entity_id", "pos"], "left").join(entries, "profile_id", "left")
                .select("entity_id", "full_name", "entity_type", F.coalesce("programs", F.array().cast("array<string>")).alias("programs"), "listed_date", "list_id"))
    found = features(party, refs, places)
    addresses = (found.filter("location_id is not null").select("entity_id", "location_id").join(places, "location_id")
                 .filter("coalesce(country, '') <> '' or coalesce(city, '') <> ''").dropDuplicates(["entity_id", "location_id"])
                 .select("entity_id", "location_id", "country", "area_code", "city", "region", "postal_code", "address"))
    look = Lookup(refs)
    papers = section(spark, path, "IDRegDocument").filter("_IdentityID is not null and _IdentityID <> ''").select(
        F.col("_IdentityID").alias("identity_id"), F.col("_IDRegDocTypeID").alias("_d"), text(F.try_element_at("IDRegistrationNo", F.lit(1))).alias("doc_number"), F.col("_IssuedBy-CountryID").alias("_c"), F.col("_ValidityID").alias("_v0"))
    papers = look(look(look(papers, "doc_type", "_d", "doc_type"), "country", "_c", "issuing_country"), "validity", "_v0", "validity")
    documents = party.select("entity_id", "identity_id").join(papers, "identity_id").select("entity_id", "doc_type", "doc_number", "issuing_country", "validity")
    tables = {"entities": entities, "akas": akas.drop("pos", "at"), "addresses": addresses, "documents": documents, "features": found}
    if output_dir:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{output_dir}/{name}.parquet")
        tables = {name: spark.read.parquet(f"{output_dir}/{name}.parquet") for name in tables}
    return tables


def build_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges (owner, asset, rel_type, quality, weight), nodes (node, entity_id, full_name, entity_type, programs, on_sdn), relations.

    Edges are present relations of the two ownership kinds between known nodes; of parallel ones the last stays. No weight
    is in the format. A node's name is the first part of its first primary alias, else #id; its programs are those of all
    its entries.
    """
    refs = reference_values(spark, path)
    party = parties(spark, path)
    first = F.try_element_at(F.filter("aliases", lambda a: a["_Primary"] == "true"), F.lit(1))
    part = F.try_element_at(F.try_element_at(first["DocumentedName"]["DocumentedNamePart"], F.lit(1))["NamePartValue"], F.lit(1))["_VALUE"]
    named = resolve_type(party.withColumn("name", text(part)), refs, "subtype_id", "entity_type", "Unknown")
    entries = sanctions_entries(spark, path).groupBy("profile_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "programs"))), lambda x: x["programs"])).alias("programs"))
    last = F.row_number().over(W.partitionBy("profile_id").orderBy(F.desc("pos")))
    nodes = (named.withColumn("_n", last).filter("_n = 1").join(entries, "profile_id", "left")
             .select(F.col("profile_id").alias("node"), "entity_id", F.coalesce("name", F.concat(F.lit("#"), "profile_id")).alias("full_name"), "entity_type", F.coalesce("programs", F.array().cast("array<string>")).alias("programs"), F.lit(True).alias("on_sdn")))
    labels = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), key)
    rel = section(spark, path, "ProfileRelationship").select(
        F.col("_From-ProfileID").alias("from_id"), F.col("_To-ProfileID").alias("to_id"), F.col("_RelationTypeID").alias("rel_type_id"),
        F.coalesce("_RelationQualityID", F.lit("")).alias("quality_id"), F.coalesce(F.col("_Former") == "true", F.lit(False)).alias("former"), "pos")
    rel = rel.withColumns({"rel_type": labels(RELATIONS, F.col("rel_type_id")), "quality": labels(QUALITIES, F.col("quality_id"))})
    for side in ("from", "to"):
        names = nodes.select(F.col("node").alias(f"{side}_id"), F.col("full_name").alias(f"{side}_name"))
        rel = rel.join(names, f"{side}_id", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", F.concat(F.lit("#"), f"{side}_id")))
    reverse = F.col("rel_type_id") == OWNED_BY
    kept = rel.filter(F.col("rel_type_id").isin(OWNED_BY, OWNS) & ~F.col("former")).select(
        F.when(reverse, F.col("to_id")).otherwise(F.col("from_id")).alias("owner"), F.when(reverse, F.col("from_id")).otherwise(F.col("to_id")).alias("asset"), F.col("rel_type_id").alias("rel_type"), F.col("quality_id").alias("quality"), "pos")
    ids = nodes.select("node")
    kept = kept.join(ids.withColumnRenamed("node", "owner"), "owner", "left_semi").join(ids.withColumnRenamed("node", "asset"), "asset", "left_semi")
    rank = F.row_number().over(W.partitionBy("owner", "asset").orderBy(F.desc("pos")))
    edges = kept.withColumn("_n", rank).filter("_n = 1").select("owner", "asset", "rel_type", "quality", F.lit(None).cast("double").alias("weight"))
    relations = rel.select("from_id", "to_id", "rel_type_id", "rel_type", "quality", "former", "from_name", "to_name")
    return edges, nodes, relations
