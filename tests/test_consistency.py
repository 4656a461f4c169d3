import pytest

from semloom.operators.consistency import Mapped, consistent, unsatisfiable
from semloom.plans.pattern import Named, backward, forward
from semloom.plans.pattern import Template as T

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
CLASSES = [("Visit", "Process"), ("Person", "SpatialObject"), ("Record", "InformationObject"), ("Amount", "Quantity")]
ROLE = [T("?this", "hasParticipant", "?o1"), T("?o1", TYPE, "Role"), T("?o1", "isFeatureOf", "?value")]


def test_unsatisfiable_anchors(spark):
    anchors = {
        "visit_patient": forward(ROLE, "Person", "Visit"), "patient_visit": backward(ROLE, "Visit", "Person"),
        "record_patient": forward(ROLE, "Person", "Record"), "patient_record": backward(ROLE, "Record", "Person"),
        "visit_part": forward([T("?this", "hasPart", "?value")], "Record", "Visit"), "record_refers": forward([T("?this", "refersTo", "?value")], "Person", "Record"),
        "visit_refers": forward([T("?this", "refersTo", "?value")], "Person", "Visit"), "person_value": forward([T("?this", "hasValue", "?value")], None, "Person"),
        "nested": forward([T("?this", "hasDirectPart", "?o1"), T("?o1", "hasDirectPart", "?value")], "Person", "Visit"),
    }
    got = {r.anchor for r in unsatisfiable(spark, anchors, CLASSES).collect()}
    assert got == {"record_patient", "patient_record", "visit_part", "visit_refers", "person_value", "nested"}


def test_instance_data(spark):
    types = spark.createDataFrame([("v", "Visit"), ("p", "Person"), ("r", "Role")], "s string, c string")
    edges = spark.createDataFrame([("v", "hasParticipant", "r"), ("r", "isFeatureOf", "p")], "s string, p string, o string")
    assert consistent(spark, types, edges, CLASSES)
    assert not consistent(spark, types, edges.union(spark.createDataFrame([("p", "refersTo", "v")], edges.schema)), CLASSES)


#: A clinical schema's classes by category, and its faulty properties (name, table, class of the value or XSD
#: type) by the property of the upper ontology that their pattern starts with.
CATEGORIES = {
    "Process": "VisitOccurrence ConditionOccurrence DrugExposure ProcedureOccurrence DeviceExposure",
    "InformationObject": "Measurement Observation Concept", "SpatialObject": "Person Provider Specimen",
    "Role": "PatientRole ProviderRole OutputRole", "Quantity": "MeasurementValue DoseQuantity", "Quality": "Unit",
}
FAULTY = {
    "refersTo": [
        ("drug_concept_id", "DrugExposure", "Concept"), ("visit_source_concept_id", "VisitOccurrence", "Concept"), ("condition_source_concept_id", "ConditionOccurrence", "Concept"),
        ("drug_source_concept_id", "DrugExposure", "Concept"), ("procedure_source_concept_id", "ProcedureOccurrence", "Concept"), ("device_source_concept_id", "DeviceExposure", "Concept"),
        ("specimen_source_concept_id", "Specimen", "Concept"),
    ],
    "hasParticipant": [
        ("person_id", "Measurement", "Person"), ("provider_id", "Measurement", "Provider"), ("hasMeasurementResult", "Measurement", "MeasurementValue"),
        ("person_id", "Observation", "Person"), ("provider_id", "Observation", "Provider"), ("person_id", "Specimen", "Person"),
    ],
    "hasPart": [("hasDoseQuantity", "DrugExposure", "DoseQuantity"), ("unit_concept_id", "Measurement", "Unit"), ("unit_concept_id", "Observation", "Unit"), ("unit_concept_id", "Specimen", "Unit")],
    "isPartOf": [("visit_occurrence_id", "Measurement", "VisitOccurrence"), ("visit_occurrence_id", "Observation", "VisitOccurrence")],
    "hasValue": [
        ("stop_reason", "DrugExposure", "string"), ("quantity", "DrugExposure", "decimal"), ("days_supply", "DrugExposure", "integer"), ("refills", "DrugExposure", "integer"),
        ("stop_reason", "ConditionOccurrence", "string"), ("quantity", "Specimen", "decimal"),
    ],
}
SOUND = [("hasFeature", "visit_concept_id", "VisitOccurrence", "Concept"), ("hasFeature", "measurement_concept_id", "Measurement", "Concept"), ("hasParticipant", "visit_person_id", "VisitOccurrence", "Person"), ("refersTo", "observed_person", "Observation", "Person")]
ROLES = {"Person": "PatientRole", "Provider": "ProviderRole", "MeasurementValue": "OutputRole"}
BELOW = [(c, category) for category, names in CATEGORIES.items() for c in names.split()]


def mapped(start, name, table, value):
    pattern = [T("?this", start, "?o1"), T("?o1", TYPE, ROLES[value]), T("?o1", "isFeatureOf", "?value")] if start == "hasParticipant" else [T("?this", start, "?value")]
    if start == "hasValue":
        return Mapped(name, forward(pattern, None, table), datatype=value)
    return Mapped(name, forward(pattern, value, table), backward(pattern, table, value))


MODEL = [mapped(*x) for x in SOUND] + [mapped(start, *x) for start, rows in FAULTY.items() for x in rows]
TIME = [T("?this", "atTime", "?t"), T("?t", TYPE, "TimeInstant"), T("?t", "hasValue", "?value")]
MODEL += [Mapped("visit_start_datetime", forward(TIME, None, "VisitOccurrence"), datatype="dateTime")]
MODEL += [Mapped("value_as_number", Named(c), datatype=t) for c, t in (("Measurement", "float"), ("Observation", "decimal"))]


def test_the_faulty_properties_of_a_clinical_schema(spark):
    """25 faulty properties give 44 anchors without instances; no other anchor is among them."""
    anchors = {f"{k} {m.name} {side}": x for k, m in enumerate(MODEL) for side, x in (("domain", m.domain), ("range", m.range)) if x}
    got = {r.anchor for r in unsatisfiable(spark, anchors, BELOW).collect()}
    faulty = range(len(SOUND), len(SOUND) + 25)
    assert got == {a for a in anchors if int(a.split()[0]) in faulty} and len(got) == 44


#: Instance data and whether it is consistent.
CLEAN = [("visit1", "visit_concept_id", "c1"), ("visit1", "visit_start_datetime", "2020-01-01T00:00:00"), ("visit1", "visit_person_id", "p1"), ("meas1", "measurement_concept_id", "c2"), ("obs1", "observed_person", "p1")]
CASES = {
    "coherent": (CLEAN, True), "days_supply": ([("drug1", "days_supply", "30")], False), "drug_concept_id": ([("drug1", "drug_concept_id", "c1")], False),
    "hasMeasurementResult": ([("meas1", "hasMeasurementResult", "v1")], False), "hasDoseQuantity": ([("drug1", "hasDoseQuantity", "d1")], False),
    "visit_occurrence_id": ([("obs1", "visit_occurrence_id", "visit1")], False), "value_as_number": ([("meas1", "value_as_number", "5.4")], False),
    "records": ([*CLEAN, ("drug1", "drug_concept_id", "c1"), ("drug1", "days_supply", "30"), ("meas1", "value_as_number", "5.4")], False),
}


@pytest.mark.parametrize("case", CASES)
def test_verdicts_on_instance_data(spark, case):
    data, want = CASES[case]
    types = spark.createDataFrame([("visit1", "VisitOccurrence"), ("meas1", "Measurement"), ("obs1", "Observation"), ("drug1", "DrugExposure"), ("p1", "Person"), ("c1", "Concept")], "s string, c string")
    assert consistent(spark, types, spark.createDataFrame(data, "s string, p string, o string"), BELOW, MODEL) == want
