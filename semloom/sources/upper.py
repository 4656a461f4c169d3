"""The upper ontology that schemas are aligned to, as rows of axioms."""

from __future__ import annotations

NAMESPACE = "https://w3id.org/sulo/"

#: The axioms of the upper ontology, by local name.
SUBCLASSES = [
    ("EndTime", "TimeInstant"), ("StartTime", "TimeInstant"), ("Capability", "Feature"), ("Quality", "Feature"), ("Role", "Feature"), ("InformationObject", "Feature"),
    ("Collection", "InformationObject"), ("Quantity", "InformationObject"), ("Unit", "Quantity"), ("Time", "Quantity"), ("TimeInterval", "Time"), ("Duration", "Time"),
    ("TimeInstant", "Time"), ("SpatialObject", "Object"), ("Feature", "Object"),
]
DISJOINT = [
    ("EndTime", "StartTime"), ("Collection", "Quantity"), ("Time", "Unit"), ("Feature", "SpatialObject"), ("Object", "Process"),
    ("Duration", "TimeInstant"), ("Duration", "TimeInterval"), ("TimeInstant", "TimeInterval"),
    ("Capability", "InformationObject"), ("Capability", "Quality"), ("Capability", "Role"), ("InformationObject", "Quality"), ("InformationObject", "Role"), ("Quality", "Role"),
]
DOMAINS = [("hasParticipant", "Process"), ("isParticipantIn", "Object"), ("refersTo", "InformationObject"), ("isFeatureOf", "Feature"), ("hasValue", "InformationObject"), ("atTime", "Process"), ("isTimeOf", "Time"), ("isPrecededBy", "Process"), ("precedes", "Process"), ("hasItem", "Collection")]
RANGES = [("hasParticipant", "Object"), ("isParticipantIn", "Process"), ("isReferredToIn", "InformationObject"), ("hasFeature", "Feature"), ("atTime", "Time"), ("isTimeOf", "Process"), ("isPrecededBy", "Process"), ("precedes", "Process"), ("isItemIn", "Collection")]
INVERSES = [("atTime", "isTimeOf"), ("isPrecededBy", "precedes"), ("isReferredToIn", "refersTo"), ("contains", "isIn"), ("hasFeature", "isFeatureOf"), ("hasItem", "isItemIn"), ("hasParticipant", "isParticipantIn"), ("hasDirectPart", "isDirectPartOf"), ("hasPart", "isPartOf")]
SUBPROPERTIES = [("isDirectPartOf", "isPartOf"), ("hasDirectPart", "hasPart"), ("isPartOf", "isIn"), ("hasPart", "contains")]
TRANSITIVE = ["contains", "isIn", "isPartOf", "hasPart"]
#: (class, property, filler): every value of the property at the class is in the filler.
ONLY = [(c, "hasPart", c) for c in ("SpatialObject", "Feature", "InformationObject", "Object", "Process")]
#: (class, property, filler): the class has no value of the property in the filler.
NEVER = [("Object", "hasPart", "Process")]
#: (first, second, property): a way along the first and then the second property is one of the third.
CHAINS = [("hasParticipant", "isFeatureOf", "hasParticipant")]
#: Unions: what is in the class, or is a subject or value of the property, is in one of the alternatives at least.
COVERS = [("Time", ("Duration", "TimeInstant", "TimeInterval")), ("Feature", ("Capability", "InformationObject", "Quality", "Role"))]
DOMAIN_UNIONS = [("hasFeature", ("Object", "Process"))]
RANGE_UNIONS = [("isFeatureOf", ("Object", "Process"))]
