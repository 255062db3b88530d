"""Registered queries over a list in XML, written from the tables and parsed again.

Customers are individuals and suppliers entities; orders are their papers, nations their places, and deliveries their
relations. Every row of the tables is in the list.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.catalogue import query
from palisade.sources import advanced_xml, list_writer, scratch
from palisade.sources.flat_files import table

_DATE = "struct<Year: string, Month: string, Day: string>"


def _text(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.col(name).cast("string"))


def _alias(kind: str, primary: bool, *parts: Column) -> Column:
    value = [F.struct(F.array(F.struct(F.lit("215").alias("_ScriptID"), p.alias("_VALUE"))).alias("NamePartValue")) for p in parts]
    return F.struct(F.lit(kind).alias("_AliasTypeID"), F.lit(str(primary).lower()).alias("_Primary"), F.lit(str(not primary).lower()).alias("_LowQuality"), F.struct(F.array(*value).alias("DocumentedNamePart")).alias("DocumentedName"))


def _aliases(key: str, weak: Column, *parts: Column) -> Column:
    return F.concat(F.array(_alias("1", True, *parts)), F.when(weak, F.array(_alias("2", False, _text("ACCT ", key)))).otherwise(F.array()))


def _feature(kind: str, location: Column | None = None, date: Column | None = None, detail: Column | None = None) -> Column:
    none = lambda shape: F.lit(None).cast(shape)
    version = F.struct(
        (none("array<struct<_LocationID: string>>") if location is None else F.array(F.struct(location.alias("_LocationID")))).alias("VersionLocation"),
        (none(f"struct<Start: struct<From: {_DATE}>>") if date is None else F.struct(F.struct(date.alias("From")).alias("Start"))).alias("DatePeriod"),
        (none("array<struct<_VALUE: string>>") if detail is None else F.array(F.struct(detail.alias("_VALUE")))).alias("VersionDetail"))
    return F.struct(F.lit(kind).alias("_FeatureTypeID"), F.array(version).alias("FeatureVersion"))


# Reference values that no table has: kind, id, value, parent.
FIXED = (("alias_type", "1", "A.K.A.", None), ("alias_type", "2", "F.K.A.", None), ("feature_type", "8", "Birthdate", None), ("feature_type", "25", "Location", None), ("feature_type", "30", "Segment", None),
         ("loc_part_type", "41", "CITY", None), ("loc_part_type", "42", "ADDRESS1", None), ("loc_part_type", "43", "ADDRESS2", None), ("loc_part_type", "44", "REGION", None), ("party_type", "1", "Individual", None),
         ("party_type", "2", "Entity", None), ("party_subtype", "none", "", "2"), ("script", "215", "Latin", None), ("validity", "F", "Valid", None), ("validity", "O", "Open", None))


def sections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The list's sections by tag."""
    region, nation, customer, supplier, orders, lineitem = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier", "orders", "lineitem"))
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))

    def item(rows: DataFrame, kind: str, key: Column, value: Column, parent: str | None = None) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), key.alias("id"), value.alias("value"), F.lit(parent).cast("string").alias("parent")).distinct()

    segment = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Unknown").otherwise(F.col("c_mktsegment"))
    references = spark.createDataFrame(list(FIXED), "kind string, id string, value string, parent string")
    for rows in (item(region, "country", _text("r", "r_regionkey"), F.col("r_name")), item(nation, "area_code", _text("n", "n_nationkey"), F.col("n_name")),
                 item(customer, "party_subtype", F.col("c_mktsegment"), segment, "1"), item(orders, "doc_type", F.col("o_orderpriority"), F.col("o_orderpriority"))):
        references = references.unionByName(rows)

    part = lambda kind, value: F.struct(F.lit(kind).alias("_LocPartTypeID"), F.array(F.struct(value.alias("Value"))).alias("LocationPartValue"))
    parts = F.array(part("41", F.lit("Old town")), part("41", F.col("n_name")), part("42", F.concat(F.lit("1 "), "n_name")), part("43", F.col("r_name")), part("44", _text("Zone ", "r_regionkey")))
    locations = places.select(_text("L", "n_nationkey").alias("_ID"), F.array(F.struct(_text("r", "r_regionkey").alias("_CountryID"))).alias("LocationCountry"),
                              F.array(F.struct(_text("n", "n_nationkey").alias("_AreaCodeID"))).alias("LocationAreaCode"), parts.alias("LocationPart"))

    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    date = F.struct(*[f("since").cast("string").alias(n) for n, f in (("Year", F.year), ("Month", F.month), ("Day", F.dayofmonth))])
    people = customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # as many rows as nations
    born = F.when(F.col("since").isNotNull(), F.array(_feature("8", date=date))).otherwise(F.array())
    firms = supplier.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    located = _feature("25", location=_text("L", "n_nationkey"))
    everyone = people.select(_text("C", "c_custkey").alias("key"), F.col("c_mktsegment").alias("kind"), _aliases("c_custkey", F.col("c_acctbal") < 0, F.col("c_mktsegment"), F.col("c_name")).alias("aliases"),
                             F.concat(born, F.array(located), F.array(_feature("30", detail=F.col("c_mktsegment")))).alias("features"), F.lit("1550").alias("list"), F.when(F.col("since").isNotNull(), date).alias("date"), F.array("c_mktsegment", "r_name").alias("programs"))
    everyone = everyone.unionByName(firms.select(_text("S", "s_suppkey").alias("key"), F.lit("none").alias("kind"), _aliases("s_suppkey", F.col("s_acctbal") < 0, F.col("s_name")).alias("aliases"), F.array(located).alias("features"),
                                                 F.lit("1551").alias("list"), F.lit(None).cast(_DATE).alias("date"), F.array("r_name").alias("programs")))
    identity = F.array(F.struct(F.concat(F.lit("I"), "key").alias("_ID"), F.col("aliases").alias("Alias")))
    parties = everyone.select(F.concat(F.lit("F"), "key").alias("_FixedRef"), F.struct(F.col("key").alias("_ID"), F.col("kind").alias("_PartySubTypeID"), identity.alias("Identity"), F.col("features").alias("Feature")).alias("Profile"))
    entries = everyone.select(F.col("key").alias("_ProfileID"), F.col("list").alias("_ListID"), F.array(F.struct(F.col("date").alias("Date"))).alias("EntryEvent"), F.transform("programs", lambda p: F.struct(p.alias("Comment"))).alias("SanctionsMeasure"))

    papers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        _text("IC", "c_custkey").alias("_IdentityID"), F.col("o_orderpriority").alias("_IDRegDocTypeID"), _text("r", "n_regionkey").alias("_IssuedBy-CountryID"), F.col("o_orderstatus").alias("_ValidityID"), F.array(F.col("o_orderkey").cast("string")).alias("IDRegistrationNo"))
    sold = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.min("l_linenumber").alias("line"), F.max("l_quantity").alias("most"))
    kind = F.when(F.col("line") == 1, advanced_xml.OWNS).when(F.col("line") == 2, advanced_xml.OWNED_BY).otherwise("1555")
    relations = sold.select(_text("S", "l_suppkey").alias("_From-ProfileID"), _text("C", "o_custkey").alias("_To-ProfileID"), kind.alias("_RelationTypeID"), F.when(F.col("most") > 25, "1540").otherwise("77").alias("_RelationQualityID"), (F.col("most") < 5).cast("string").alias("_Former"))
    return {"ReferenceValueSets": list_writer.reference_row(references), "Location": locations, "DistinctParty": parties, "IDRegDocument": papers, "SanctionsEntry": entries, "ProfileRelationship": relations}


def _list(spark: SparkSession, sf_dir: str, *tags: str) -> str:
    """The list with rows in the named sections only; the others are there and empty."""
    found = sections(spark, sf_dir)
    keep = {"ReferenceValueSets", "DistinctParty", *tags}
    return list_writer.write_list({tag: rows if tag in keep else rows.limit(0) for tag, rows in found.items()}, scratch.place(spark, "list"))


PARTY_SQL = """with place as (select * from nation join region on n_regionkey = r_regionkey), since as (select o_custkey, min(o_orderdate) as since from orders group by o_custkey),
party as (select 'C' || c_custkey as key, c_mktsegment || ' ' || c_name as full_name, c_mktsegment as first_part, case when c_mktsegment = 'HOUSEHOLD' then 'Individual' else c_mktsegment end as entity_type,
    c_mktsegment || '|' || r_name as programs, strftime(since, '%Y-%m-%d') as listed_date, '1550' as list_id, c_acctbal < 0 as weak, 'ACCT ' || c_custkey as other, n_nationkey, n_name, r_regionkey, r_name, c_mktsegment
  from customer left join since on o_custkey = c_custkey join place on c_nationkey = n_nationkey
  union all select 'S' || s_suppkey, s_name, s_name, 'Entity', r_name, null, '1551', s_acctbal < 0, 'ACCT ' || s_suppkey, n_nationkey, n_name, r_regionkey, r_name, null from supplier join place on s_nationkey = n_nationkey),
sold as (select 'S' || l_suppkey as s, 'C' || o_custkey as c, min(l_linenumber) as line, max(l_quantity) as most from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""


@query(PARTY_SQL + " select 'F' || key as entity_id, full_name, entity_type, programs, listed_date, list_id from party")
def list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advanced_xml.parse_all(spark, _list(spark, sf_dir, "SanctionsEntry"))["entities"]
    return found.withColumns({"programs": F.array_join("programs", "|"), "listed_date": F.col("listed_date").cast("string")})


@query(PARTY_SQL + """ select 'F' || key as entity_id, full_name as aka_name, 'A.K.A.' as alias_type, true as is_primary, false as is_weak, 'Latin' as script from party
union all select 'F' || key, other, 'F.K.A.', false, true, 'Latin' from party where weak""")
def list_akas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.parse_all(spark, _list(spark, sf_dir))["akas"]


@query(PARTY_SQL + """ select 'F' || key as entity_id, 'L' || n_nationkey as location_id, r_name as country, n_name as area_code, n_name as city, 'Zone ' || r_regionkey as region, cast(null as varchar) as postal_code,
  '1 ' || n_name || ', ' || r_name as address from party""")
def list_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.parse_all(spark, _list(spark, sf_dir, "Location"))["addresses"]


@query("""select 'FC' || c_custkey as entity_id, o_orderpriority as doc_type, cast(o_orderkey as varchar) as doc_number, r_name as issuing_country, case o_orderstatus when 'F' then 'Valid' when 'O' then 'Open' end as validity
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.parse_all(spark, _list(spark, sf_dir, "IDRegDocument"))["documents"]


@query(PARTY_SQL + """ select 'F' || key as entity_id, 'Location' as feature_type, r_name as value, 'L' || n_nationkey as location_id from party
union all select 'F' || key, 'Birthdate', listed_date, null from party where listed_date is not null union all select 'F' || key, 'Segment', c_mktsegment, null from party where c_mktsegment is not null""")
def list_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.parse_all(spark, _list(spark, sf_dir, "Location"))["features"]


@query(PARTY_SQL + """ select case line when 1 then s else c end as owner, case line when 1 then c else s end as asset, case line when 1 then '92019' else '15003' end as rel_type,
  case when most > 25 then '1540' else '77' end as quality, cast(null as double) as weight from sold where line <= 2 and most >= 5 and s in (select key from party) and c in (select key from party)""")
def list_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.build_graph(spark, _list(spark, sf_dir, "ProfileRelationship"))[0]


@query(PARTY_SQL + " select key as node, 'F' || key as entity_id, first_part as full_name, entity_type, programs, true as on_sdn from party")
def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.build_graph(spark, _list(spark, sf_dir, "SanctionsEntry"))[1].withColumn("programs", F.array_join("programs", "|"))


@query(PARTY_SQL + """ select s as from_id, c as to_id, case line when 1 then '92019' when 2 then '15003' else '1555' end as rel_type_id,
  case line when 1 then 'Owns, controls, or operates' when 2 then 'Owned or Controlled By' else 'Associate Of' end as rel_type, case when most > 25 then 'High' else '77' end as quality, most < 5 as former,
  coalesce(a.first_part, '#' || s) as from_name, coalesce(b.first_part, '#' || c) as to_name from sold left join party a on a.key = s left join party b on b.key = c""")
def list_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advanced_xml.build_graph(spark, _list(spark, sf_dir, "ProfileRelationship"))[2]
