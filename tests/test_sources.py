"""List XML, flat files, JSON lines and kept results."""

import datetime
from types import SimpleNamespace

import pytest

from palisade.sources import advanced_xml, flat_files, scratch

LIST = """<?xml version="1.0" encoding="utf-8"?>
<Sanctions xmlns="http://example.org/list">
<ReferenceValueSets>
<AliasTypeValues><AliasType ID="1">F.K.A.</AliasType></AliasTypeValues>
<AreaCodeValues><AreaCode ID="11" Description="FR">France area</AreaCode><AreaCode ID="12">Plain</AreaCode></AreaCodeValues>
<CountryValues><Country ID="21">Freedonia</Country><Country>No id</Country></CountryValues>
<FeatureTypeValues><FeatureType ID="8">Birthdate</FeatureType><FeatureType ID="25">Location</FeatureType><FeatureType ID="224">Gender</FeatureType></FeatureTypeValues>
<IDRegDocTypeValues><IDRegDocType ID="31">Passport</IDRegDocType></IDRegDocTypeValues>
<LocPartTypeValues><LocPartType ID="41">CITY</LocPartType><LocPartType ID="42">ADDRESS1</LocPartType><LocPartType ID="43">ADDRESS2</LocPartType><LocPartType ID="44">REGION</LocPartType></LocPartTypeValues>
<PartySubTypeValues><PartySubType ID="3" PartyTypeID="2">Unknown</PartySubType><PartySubType ID="4" PartyTypeID="1">Vessel</PartySubType></PartySubTypeValues>
<PartyTypeValues><PartyType ID="1">Transport</PartyType><PartyType ID="2">Individual</PartyType></PartyTypeValues>
<ScriptValues><Script ID="215">Latin</Script><Script ID="220">Arabic</Script></ScriptValues>
<ValidityValues><Validity ID="51">Valid</Validity></ValidityValues>
</ReferenceValueSets>
<Locations>
<Location ID="100"><LocationAreaCode AreaCodeID="11"/><LocationCountry CountryID="21"/><LocationPart LocPartTypeID="41"><LocationPartValue><Value> Paris </Value></LocationPartValue></LocationPart>
<LocationPart LocPartTypeID="41"><LocationPartValue><Value>Lyon</Value></LocationPartValue></LocationPart><LocationPart LocPartTypeID="42"><LocationPartValue><Value>1 Road</Value></LocationPartValue></LocationPart>
<LocationPart LocPartTypeID="43"><LocationPartValue><Value>Floor 2</Value></LocationPartValue></LocationPart><LocationPart LocPartTypeID="44"><LocationPartValue><Value>Rhone</Value></LocationPartValue></LocationPart></Location>
<Location ID="101"><LocationPart LocPartTypeID="99"><LocationPartValue><Value>odd</Value></LocationPartValue></LocationPart></Location>
</Locations>
<IDRegDocuments>
<IDRegDocument ID="1" IDRegDocTypeID="31" IdentityID="7001" IssuedBy-CountryID="21" ValidityID="51"><IDRegistrationNo>P123</IDRegistrationNo></IDRegDocument>
<IDRegDocument ID="2" IDRegDocTypeID="31" IdentityID="7001"><IDRegistrationNo> </IDRegistrationNo></IDRegDocument>
</IDRegDocuments>
<DistinctParties>
<DistinctParty FixedRef="900"><Profile ID="800" PartySubTypeID="3"><Identity ID="7001">
<Alias AliasTypeID="1" Primary="false" LowQuality="true"><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="220">x</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
<Alias AliasTypeID="77" Primary="true" LowQuality="false"><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">DOE</NamePartValue></DocumentedNamePart><DocumentedNamePart><NamePartValue ScriptID="215">John</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
<Alias AliasTypeID="1" Primary="true" LowQuality="false"><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">DOE II</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
<Alias AliasTypeID="1" Primary="true"><DocumentedName></DocumentedName></Alias></Identity>
<Feature FeatureTypeID="8"><FeatureVersion><DatePeriod><Start><From><Year>1970</Year><Month>3</Month><Day>9</Day></From></Start></DatePeriod></FeatureVersion><FeatureVersion><DatePeriod><Start><From><Year>1971</Year></From></Start></DatePeriod></FeatureVersion></Feature>
<Feature FeatureTypeID="25"><FeatureVersion><VersionLocation LocationID="100"/></FeatureVersion><FeatureVersion><VersionLocation LocationID="100"/></FeatureVersion><FeatureVersion><VersionLocation LocationID="101"/></FeatureVersion></Feature>
<Feature FeatureTypeID="555"><FeatureVersion><VersionDetail DetailReferenceID="5"> Male </VersionDetail><VersionDetail DetailReferenceID="6"></VersionDetail></FeatureVersion></Feature>
</Profile></DistinctParty>
<DistinctParty FixedRef="901"><Profile ID="801" PartySubTypeID="4"><Identity ID="7002"><Alias AliasTypeID="1" Primary="true"><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">SHIP</NamePartValue></DocumentedNamePart></DocumentedName></Alias></Identity></Profile></DistinctParty>
<DistinctParty FixedRef="902"><Profile PartySubTypeID="88"><Identity ID="7003"></Identity></Profile></DistinctParty>
<DistinctParty FixedRef="903"></DistinctParty>
</DistinctParties>
<ProfileRelationships>
<ProfileRelationship ID="1" From-ProfileID="801" To-ProfileID="800" RelationTypeID="15003" RelationQualityID="1540" Former="false"></ProfileRelationship>
<ProfileRelationship ID="2" From-ProfileID="800" To-ProfileID="801" RelationTypeID="92019" RelationQualityID="1541" Former="false"></ProfileRelationship>
<ProfileRelationship ID="3" From-ProfileID="800" To-ProfileID="902" RelationTypeID="92019" RelationQualityID="1" Former="true"></ProfileRelationship>
<ProfileRelationship ID="4" From-ProfileID="800" To-ProfileID="404" RelationTypeID="92019" RelationQualityID="9" Former="false"></ProfileRelationship>
<ProfileRelationship ID="5" From-ProfileID="800" To-ProfileID="902" RelationTypeID="123" RelationQualityID="1542" Former="false"></ProfileRelationship>
</ProfileRelationships>
<SanctionsEntries>
<SanctionsEntry ID="1" ProfileID="800" ListID="1550"><EntryEvent ID="1"><Date><Year>2020</Year><Month>5</Month></Date></EntryEvent><SanctionsMeasure><Comment>PROG-A</Comment></SanctionsMeasure><SanctionsMeasure><Comment> </Comment></SanctionsMeasure><SanctionsMeasure><Comment>PROG-B</Comment></SanctionsMeasure></SanctionsEntry>
<SanctionsEntry ID="2" ProfileID="800" ListID="1551"><EntryEvent ID="2"><Date><Year>2021</Year><Month>1</Month><Day>2</Day></Date></EntryEvent><SanctionsMeasure><Comment>PROG-C</Comment></SanctionsMeasure></SanctionsEntry>
</SanctionsEntries>
</Sanctions>
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = tmp_path_factory.mktemp("list") / "list.xml"
    out.write_text(LIST, encoding="utf-8")
    return str(out)


def test_parse_all(spark, path, tmp_path):
    tables = advanced_xml.parse_all(spark, path, str(tmp_path))
    entities = {r.entity_id: r for r in tables["entities"].collect()}
    assert set(entities) == {"900", "901", "902"}
    assert entities["900"].asDict() == {"entity_id": "900", "full_name": "DOE II", "entity_type": "Individual", "programs": ["PROG-A", "PROG-B"], "listed_date": datetime.date(2020, 5, 1), "list_id": "1550"}
    assert (entities["901"].entity_type, entities["901"].programs, entities["901"].listed_date) == ("Vessel", [], None)
    assert (entities["902"].entity_type, entities["902"].full_name) == (None, None)
    akas = sorted(tuple(r) for r in tables["akas"].filter("entity_id = '900'").collect())
    assert akas == [("900", "DOE II", "F.K.A.", True, False, "Latin"), ("900", "DOE John", "A.K.A.", True, False, "Latin"), ("900", "x", "F.K.A.", False, True, "Arabic")]
    features = sorted(((r.feature_type, r.value, r.location_id) for r in tables["features"].collect()), key=str)
    assert features == sorted([("Birthdate", "1970-03-09", None), ("Birthdate", "1971", None), ("Location", "Freedonia", "100"), ("Location", "Freedonia", "100"), ("Location", None, "101"), ("555", "Male", None)], key=str)
    assert [tuple(r) for r in tables["addresses"].collect()] == [("900", "100", "Freedonia", "FR", "Lyon", "Rhone", None, "1 Road, Floor 2")]
    assert sorted((r.doc_type, r.doc_number, r.issuing_country, r.validity) for r in tables["documents"].fillna("").collect()) == [("Passport", "", "", ""), ("Passport", "P123", "Freedonia", "Valid")]
    report = {(r.table, r.measure, r.value): r.n for r in flat_files.smoke_report(tables).collect()}
    assert report["akas", "rows", None] == 4
    assert report["entities", "entity_type", "Vessel"] == 1


def test_build_graph(spark, path):
    edges, nodes, relations = advanced_xml.build_graph(spark, path)
    assert [tuple(r) for r in edges.collect()] == [("800", "801", "92019", "1541", None)]
    found = {r.node: r for r in nodes.collect()}
    assert found["800"].programs == ["PROG-A", "PROG-B", "PROG-C"]
    assert (found["800"].full_name, found["902"].full_name, found["902"].entity_type) == ("DOE", "#902", "Unknown")
    rel = {(r.from_id, r.to_id, r.rel_type_id): r for r in relations.collect()}
    assert len(rel) == 5
    assert (rel["801", "800", "15003"].rel_type, rel["801", "800", "15003"].quality, rel["801", "800", "15003"].from_name) == ("Owned or Controlled By", "High", "SHIP")
    assert (rel["800", "404", "92019"].to_name, rel["800", "404", "92019"].quality, rel["800", "902", "123"].rel_type) == ("#404", "9", "123")


def test_reference_values(spark, path):
    refs = {(r.kind, r.id): (r.value, r.parent) for r in advanced_xml.reference_values(spark, path).collect()}
    assert refs["area_code", "11"] == ("FR", None)
    assert refs["area_code", "12"] == ("Plain", None)
    assert refs["party_subtype", "3"] == ("Unknown", "2")
    assert sum(k == "country" for k, _ in refs) == 1


def test_no_parties(spark, tmp_path):
    (tmp_path / "none.xml").write_text("<Sanctions><Other/></Sanctions>")
    with pytest.raises(ValueError, match="no distinct parties"):
        advanced_xml.parse_all(spark, str(tmp_path / "none.xml"))


def test_flat_files(spark, tmp_path):
    own = ['36,"AEROCARIBBEAN AIRLINES",-0- ,"CUBA",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ', '37,"CAF\xc9, ""X""",individual,"A; B",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,note', "1,2,3,4,5,6,7,8,9,10,11,12,13", "38,short"]
    (tmp_path / "sdn.csv").write_bytes("\n".join(own).encode("latin-1"))
    rows = {r.ent_num: r for r in flat_files.read_flat(spark, str(tmp_path / "sdn.csv")).collect()}
    assert set(rows) == {"36", "37", "38"}
    assert (rows["36"].sdn_name, rows["36"].sdn_type, rows["37"].sdn_name, rows["37"].remarks, rows["38"].program) == ("AEROCARIBBEAN AIRLINES", None, 'CAFÉ, "X"', "note", None)
    (tmp_path / "alt.csv").write_text('36,12,"aka","AERO-CARIBBEAN",-0- \n')
    assert tuple(flat_files.read_aliases(spark, str(tmp_path / "alt.csv")).first()) == ("36", "12", "aka", "AERO-CARIBBEAN", None)


def test_entity_json(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": "Q1", "caption": "A", "schema": "Person", "properties": {"name": ["A", "B"]}}\n')
    assert flat_files.read_entities_json(spark, str(tmp_path / "e.json")).first().properties == {"name": ["A", "B"]}


def test_read_through(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert flat_files.read_through(spark, str(tmp_path / "kept"), make).count() == 3
    assert made == [1]


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: other))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(session)
